"""The crawl as one batch: pages to articles with signals, links for the frontier, and a reason for each page left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking, signals, text, urls
from ..operators import dedup, frontier
from ..operators.tiers import with_tier
from ..session import ship
from ..sources.html import pages_to_articles


@dataclass
class Crawl:
    """judged: every page with its signals and reject_reason (null: stored); articles and signals to store; links of all pages."""

    judged: DataFrame
    articles: DataFrame
    signals: DataFrame
    links: DataFrame

    def counters(self) -> DataFrame:
        """result, n: stored, and skipped by reason."""
        kept = self.articles.select("url", F.lit(True).alias("_kept"))
        result = F.when(F.col("_kept"), "stored").when(F.col("reject_reason").isNotNull(), F.concat(F.lit("skipped: "), "reject_reason")).otherwise("skipped: duplicate")
        return self.judged.join(kept, "url", "left").groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def judged(pages: DataFrame, now: Column, **relevance) -> DataFrame:
    """pages(url, html) extracted, with tier, signals and the gate's reason."""
    ship(pages.sparkSession)
    found = pages_to_articles(pages.select("url", "html")).withColumn("host", urls.hostname(F.col("url")))
    found = with_tier(found, "host")
    found = found.withColumn("published_date", signals.parsed_date(F.col("date_raw"))).withColumns({"_title": text.nfkc(F.col("title")), "_content": text.nfkc(F.col("content"))})  # once for all that need it
    found = found.withColumn("content_hash", text.content_hash(F.col("_content"), nfkc=False))
    title, content, published = F.col("title"), F.col("content"), F.col("published_date").cast("timestamp")
    found = found.withColumns(
        {
            "quality_score": signals.quality(title, content), "readability_score": signals.readability(F.col("_content"), nfkc=False), "freshness_score": ranking.freshness_bucket(published, now),
            "popularity_score": signals.popularity(content, F.col("authority"), F.col("primary_domain")),
        }
    )
    score = signals.relevance(*(text.normalize(F.col(c), nfkc=False) for c in ("_title", "_content")), **relevance)
    found = found.withColumn("relevance_score", score).drop("_title", "_content")
    return found.withColumn("reject_reason", signals.gate_reason(title, content, F.col("quality_score"), F.col("min_quality"), F.col("relevance_score")))


def crawl(pages: DataFrame, stored: DataFrame, now: Column, **relevance) -> Crawl:
    """Persist or write `judged` before using more than one part of the result: each reads the pages anew."""
    found = judged(pages, now, **relevance)
    batch = found.where("reject_reason IS NULL").withColumn("url_normalized", urls.stored_url(F.col("url"))).withColumn("id", F.sha2("url_normalized", 256))
    batch = dedup.validated(batch, stored)
    articles = batch.select("id", "url", "url_normalized", F.col("host").alias("domain"), "title", "content", "content_hash", F.lit(False).alias("is_indexed"), now.alias("crawl_timestamp"), "published_date")
    scores = batch.select(F.col("id").alias("article_id"), "quality_score", "readability_score", "authority_score", "freshness_score", "popularity_score", now.alias("computed_at"))
    return Crawl(found, articles, scores, discovered(found))


def discovered(found: DataFrame) -> DataFrame:
    """url, source_host of the links worth following of all pages, rejected pages too, once a page."""
    links = found.select(F.col("host").alias("source_host"), F.explode(F.array_distinct("hrefs")).alias("url"))
    return frontier.admitted(links).where("reject_reason IS NULL").select("url", "source_host").distinct()
