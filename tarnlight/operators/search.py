"""Ranked search over an index: BM25 by fields, fused with stored signals; suggestions.

The plan reads the postings of the query's terms alone, joins lengths, adds up scores, and only then touches articles and
signals; contents are fetched for the page that is returned, not for every candidate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import ranking, text
from .index import Index


def clamp(value: object, low: int, high: int) -> int:
    """A parameter in its range; what is no number is the least."""
    try:
        return max(low, min(high, int(float(value))))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return low


class SearchEngine:
    """search and suggest over one index. stop and stems must be those the index was built with."""

    def __init__(self, index: Index, articles: DataFrame, signals: DataFrame, stop: Sequence[str] = (), stems: bool = True):
        self.index, self.articles, self.signals, self.stop, self.stems = index, articles, signals, stop, stems

    def terms(self, query: str) -> list[str]:
        return text.query_terms(query, self.stop, self.stems)

    def bm25(self, query: str, k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
        """doc_id, bm25_raw of every document that holds a term of the query."""
        of = lambda df: df.where(F.col("term").isin(self.terms(query)))
        hits = of(self.index.postings).join(of(self.index.terms), "term").join(self.index.doc_lengths, "doc_id").crossJoin(F.broadcast(self.index.stats))  # one row
        score = ranking.bm25_term(F.col("title_tf"), F.col("content_tf"), F.col("doc_length"), F.col("avg_document_length"), F.col("total_documents"), F.col("doc_freq"), k1, b)
        return hits.groupBy("doc_id").agg(F.sum(score).alias("bm25_raw"))

    def scored(
        self, query: str, now: Column, weights: Mapping[str, float] = config.WEIGHTS, min_quality: float | None = None, min_authority: float | None = None,
        date_after: Column | None = None, scale: str = "reference",
    ) -> DataFrame:
        """All matches that pass the filters, with each signal and the fused score.

        scale: "reference" fuses stored signals as they are, 0 to 100 beside 0 to 1; "unit" divides them by 100.
        Missing signals are 0; undated articles pass date_after.
        """
        fields = self.articles.select(F.col("id").alias("doc_id"), "published_date")
        scores = self.signals.select(F.col("article_id").alias("doc_id"), "quality_score", "authority_score", "freshness_score")
        found = self.bm25(query).join(fields, "doc_id").join(scores, "doc_id", "left").fillna(0.0, ["quality_score", "authority_score", "freshness_score"])
        if min_quality is not None:
            found = found.where(F.col("quality_score") >= min_quality)
        if min_authority is not None:
            found = found.where(F.col("authority_score") >= min_authority)
        if date_after is not None:
            found = found.where(F.col("published_date").isNull() | (F.col("published_date") >= date_after))
        span = found.agg(F.min("bm25_raw").alias("low"), F.max("bm25_raw").alias("high"))
        found = found.crossJoin(F.broadcast(span))  # one row
        unit = 100.0 if scale == "unit" else 1.0
        stored = F.col("freshness_score") / unit
        found = found.withColumn("bm25_normalized", ranking.min_max(F.col("bm25_raw"), F.col("low"), F.col("high")))
        found = found.withColumn("freshness", ranking.freshness_decay(F.col("published_date").cast("timestamp"), stored, now))
        final = ranking.fuse({"bm25": F.col("bm25_normalized"), "quality": F.col("quality_score") / unit, "authority": F.col("authority_score") / unit, "freshness": F.col("freshness")}, weights)
        return found.select("doc_id", "published_date", "bm25_raw", "bm25_normalized", "quality_score", "authority_score", F.col("freshness").alias("freshness_score"), final.alias("final_score"))

    def search(self, query: str, now: Column, limit: int = 10, offset: int = 0, **how) -> DataFrame:
        """The page of results: article_id, url, title, snippet, published_date, scores, final_score; ties by id."""
        page = self.scored(query, now, **how).orderBy(F.desc("final_score"), "doc_id").offset(offset).limit(limit)
        rows = page.join(self.articles.select(F.col("id").alias("doc_id"), "url", "title", "content"), "doc_id")
        scores = F.struct("bm25_raw", "bm25_normalized", "quality_score", "authority_score", "freshness_score", F.col("final_score").alias("final"))
        out = rows.select(F.col("doc_id").alias("article_id"), "url", "title", text.snippet(F.coalesce("content", F.lit("")), self.terms(query)).alias("snippet"), "published_date", scores.alias("scores"), "final_score")
        return out.orderBy(F.desc("final_score"), "article_id")

    def suggest(self, query: str, limit: int = 6, least_idf: float = config.MIN_SUGGEST_IDF) -> DataFrame:
        """term, score: other terms of the matching documents, by the sum of their idf over these documents."""
        asked = self.terms(query)
        n_docs = self.index.doc_lengths.agg(F.count(F.lit(1)).alias("total_documents"))
        idf = ranking.idf(F.col("total_documents"), F.col("doc_freq"))
        rated = self.index.beside(asked).crossJoin(F.broadcast(n_docs)).withColumn("idf", idf).where(F.col("idf") >= least_idf)
        return rated.select("term", (F.col("n") * F.col("idf")).alias("score")).orderBy(F.desc("score"), "term").limit(limit)

    def respond(self, q: str | None, now: Column, limit: object = 10, offset: object = 0, explain: bool = False) -> dict:
        """What a search service answers: total is the page's size, total_matches that of the whole answer."""
        query = (q or "").strip()
        if not query:
            raise ValueError("q is required")
        rows = self.search(query, now, clamp(limit, 1, 50), clamp(offset, 0, 1000)).collect()  # at most 50
        results = []
        for r in rows:
            item = {"title": r["title"], "url": r["url"], "snippet": r["snippet"], "date": r["published_date"].isoformat() if r["published_date"] else None, "score": round(r["final_score"], 4)}
            item = {k: v for k, v in item.items() if v is not None}
            results.append(item | {"scores": r["scores"].asDict()} if explain else item)
        return {"query": query, "total": len(results), "total_matches": self.bm25(query).count(), "results": results}


def health() -> dict:
    return {"ok": True}
