"""The crawl frontier: which URLs are new, which are queued, what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .tiers import with_tier


def seen_urls(seeds: DataFrame, queue: DataFrame, articles: DataFrame) -> DataFrame:
    """url: all URLs known, in queue form, once."""
    stored = articles.select(F.coalesce("url_normalized", "url").alias("url"))
    return seeds.select("url").union(queue.select("url")).union(stored).select(urls.queue_url(F.col("url")).alias("url")).distinct()


def admitted(links: DataFrame) -> DataFrame:
    """links(url, source_host, ...) with url in queue form and reject_reason (null: follow)."""
    found = links.withColumn("url", urls.queue_url(F.col("url"))).withColumn("_host", urls.hostname(F.col("url")))
    found = with_tier(found, "_host")
    level = F.when(F.col("known"), F.col("authority"))
    return found.withColumn("reject_reason", urls.reject_reason(F.col("url"), F.col("source_host"), level)).select(*links.columns, "reject_reason")


def classified(links: DataFrame, seen: DataFrame) -> DataFrame:
    """links(url, source_host) with what happens to each: inserted, duplicates, invalid or discarded. The counts add up to the links."""
    found = admitted(links).withColumn("_id", F.monotonically_increasing_id())
    usable = found.where("reject_reason IS NULL")
    firsts = usable.groupBy("url").agg(F.min("_id").alias("_id")).join(seen, "url", "left_anti").select("_id", F.lit(True).alias("_new"))
    status = F.when(~urls.is_url(F.col("url")), "invalid").when(F.col("reject_reason").isNotNull(), "discarded").when(F.col("_new"), "inserted").otherwise("duplicates")
    return found.join(firsts, "_id", "left").withColumn("status", status).drop("_id", "_new")


def insert_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def new_seeds(seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """url, domain of seeds that are http, in queue form, new, once each."""
    found = seeds.where(F.lower("url").rlike("^https?://")).select(urls.queue_url(F.col("url")).alias("url")).distinct()
    return found.join(seen, "url", "left_anti").withColumn("domain", urls.bare_host(urls.hostname(F.col("url"))))


def next_seeds(seeds: DataFrame, n: int) -> DataFrame:
    return seeds.where(~F.col("crawled")).orderBy("id").limit(n)


def next_queued(queue: DataFrame, n: int) -> DataFrame:
    return queue.where(~F.col("crawled")).orderBy(F.desc("priority"), "id").limit(n)


def crawl_status(seeds: DataFrame, queue: DataFrame, articles: DataFrame) -> DataFrame:
    """total, crawled, remaining of seeds and queue, and how many articles."""
    count = lambda df, name, done: df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("total"), F.count_if(done).alias("crawled")).withColumn("remaining", F.col("total") - F.col("crawled"))
    return count(seeds, "seeds", F.col("crawled")).union(count(queue, "queue", F.col("crawled"))).union(count(articles, "articles", F.lit(True)))


def undated_page(articles: DataFrame, after: str = "", n: int = 200) -> DataFrame:
    """The next articles to look up dates for: undated, not looked at, ids after the last one, in order."""
    return articles.where(F.col("published_date").isNull() & F.col("last_crawled_at").isNull() & (F.col("id") > after)).orderBy("id").limit(n)


def schedule(pages: DataFrame, host: Column, delay: Column, least: float = 0.3, ties: str | None = None) -> DataFrame:
    """pages with start_after: seconds until each may be fetched, its host's pages one after another by url, equal urls by the column `ties`."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy("_host").orderBy("url", *([ties] if ties else []))
    return pages.withColumn("_host", host).withColumn("start_after", (F.row_number().over(order) - 1) * F.greatest(F.lit(least), delay)).drop("_host")
