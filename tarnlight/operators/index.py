"""The inverted index: terms, postings with positions and fields, document lengths, corpus statistics.

All tables come from the articles' own rows: an article's postings, terms and length are made of its arrays of terms, without
a shuffle of tokens. Only what rows of one id make is brought together; such ids are looked up first (`_by_id`). Write the
tables once (`save`) and query them, or each query tokenises anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text
from ..session import ship


@dataclass
class Index:
    terms: DataFrame
    postings: DataFrame
    doc_lengths: DataFrame
    stats: DataFrame
    documents: DataFrame | None = None  # doc_id, terms: of an index that isn't stored

    def beside(self, asked: Sequence[str]) -> DataFrame:
        """term, doc_freq, n: the other terms of documents that hold one asked for, and how many of these hold them."""
        other = ~F.col("term").isin(asked)
        if self.documents is not None:
            held = self.documents.withColumn("hit", F.arrays_overlap("terms", F.array(*map(F.lit, asked)).cast("array<string>")))  # before terms are rows
            held = held.select("doc_id", (F.col("hit") & F.col("doc_id").isNotNull()).alias("hit"), F.explode_outer("terms").alias("term"))
            return held.where(other).groupBy("term").agg(F.count("doc_id").alias("doc_freq"), F.count_if("hit").alias("n")).where("n > 0")
        docs = self.postings.where(F.col("term").isin(asked)).select("doc_id").distinct()
        counted = self.postings.join(docs, "doc_id", "left_semi").where(other).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        return counted.join(self.terms, "term").select("term", "doc_freq", "n")

    def save(self, path: str) -> Index:
        """Writes the four tables, postings in the order of terms, so that a query reads few row groups."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        stored = from_postings(spark.read.parquet(f"{path}/postings"))
        for name in ("terms", "doc_lengths", "stats"):
            getattr(stored, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("terms", "postings", "doc_lengths", "stats")))


def indexable(articles: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Articles not indexed yet whose content has more than 50 characters; with signals, those that have some."""
    found = articles.where(~F.col("is_indexed") & F.col("content").isNotNull() & (F.length("content") > 50))
    return found if signals is None else found.join(signals.withColumnRenamed("article_id", "id"), "id")


def analyzed(articles: DataFrame, stop: Sequence[str] = (), stems: bool = True) -> DataFrame:
    """doc_id, t, c: the terms of an article's title and content, in order."""
    if stems:
        ship(articles.sparkSession)
    return articles.select(F.col("id").alias("doc_id"), text.analyzed(F.col("title"), stop, stems).alias("t"), text.analyzed(F.col("content"), stop, stems).alias("c"))


def _by_id(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The articles whose id is one row's, and the others. The ids of several rows, as a rule none, are broadcast."""
    several = F.broadcast(articles.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id")))
    same = F.col("id").eqNullSafe(F.col("_id"))
    return articles.join(several, same, "left_anti"), articles.join(several, same, "left_semi")


def postings(articles: DataFrame, stop: Sequence[str] = (), stems: bool = True) -> DataFrame:
    """term, doc_id, term_frequency, title_tf, content_tf, positions; content positions start `CONTENT_OFFSET` after the title's."""

    def of_rows(articles: DataFrame) -> DataFrame:
        place = lambda field, offset: F.transform(F.col(field), lambda x, i: F.struct(x.alias("term"), (i + offset).alias("position")))
        found = analyzed(articles, stop, stems).select("doc_id", F.size("t").alias("titles"), F.sort_array(F.concat(place("t", F.lit(0)), place("c", F.size("t") + config.CONTENT_OFFSET))).alias("s"))
        first = lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"])
        starts = F.when(F.size("s") > 0, F.filter(F.sequence(F.lit(0), F.size("s") - 1), first)).otherwise(F.array().cast("array<int>"))
        found = found.select("doc_id", "titles", "s", F.transform("s", lambda x: x["position"]).alias("p"), starts.alias("starts"))
        own = lambda i, k: F.struct(F.get("s", i)["term"].alias("term"), F.slice("p", i + 1, F.coalesce(F.get("starts", k + 1), F.size("p")) - i).alias("positions"))
        found = found.select("doc_id", "titles", F.explode_outer(F.transform("starts", own)).alias("x")).select("doc_id", "titles", "x.*").where("term IS NOT NULL")
        n, in_title = F.size("positions"), F.size(F.filter("positions", lambda p: p < F.col("titles")))
        return found.select("term", "doc_id", n.alias("term_frequency"), in_title.alias("title_tf"), (n - in_title).alias("content_tf"), "positions")

    alone, shared = map(of_rows, _by_id(articles))
    total = lambda c: F.sum(c).cast("int").alias(c)
    again = shared.groupBy("term", "doc_id").agg(*map(total, ("term_frequency", "title_tf", "content_tf")), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return alone.unionByName(again)


def documents(articles: DataFrame, stop: Sequence[str] = (), stems: bool = True) -> DataFrame:
    """doc_id, terms: each document's distinct terms."""
    alone, shared = (analyzed(x, stop, stems).select("doc_id", F.array_distinct(F.concat("t", "c")).alias("terms")) for x in _by_id(articles))
    return alone.unionByName(shared.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))


def article_lengths(articles: DataFrame, stop: Sequence[str] = (), stems: bool = True, now: Column | None = None) -> DataFrame:
    """doc_id, doc_length of documents with tokens, of their rows' numbers of tokens."""
    sizes = analyzed(articles, stop, stems).select("doc_id", (F.size("t") + F.size("c")).alias("n"))
    out = sizes.groupBy("doc_id").agg(F.sum("n").cast("int").alias("doc_length")).where("doc_length > 0")
    return out if now is None else out.withColumn("indexed_at", now)


def term_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("doc_id").alias("doc_freq"))


def lengths(found: DataFrame, now: Column | None = None) -> DataFrame:
    out = found.groupBy("doc_id").agg(F.sum("term_frequency").cast("int").alias("doc_length"))
    return out if now is None else out.withColumn("indexed_at", now)


def corpus_stats(doc_lengths: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: documents, their mean length, terms."""
    docs = doc_lengths.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_document_length"))
    return docs.crossJoin(F.broadcast(terms.agg(F.count(F.lit(1)).alias("total_terms"))))  # one row each


def from_postings(found: DataFrame, now: Column | None = None) -> Index:
    terms, doc_lengths = term_counts(found), lengths(found, now)
    return Index(terms, found, doc_lengths, corpus_stats(doc_lengths, terms))


def build(articles: DataFrame, stop: Sequence[str] = (), stems: bool = True, now: Column | None = None) -> Index:
    """The index of all articles given; a document without tokens is in no table."""
    held, doc_lengths = documents(articles, stop, stems), article_lengths(articles, stop, stems, now)
    terms = term_counts(held.select("doc_id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL"))
    return Index(terms, postings(articles, stop, stems), doc_lengths, corpus_stats(doc_lengths, terms), held)


def for_terms(articles: DataFrame, asked: Sequence[str], stop: Sequence[str] = (), stems: bool = True) -> Index:
    """What a search for these terms reads of the index of all articles: their postings without positions, lengths and the
    number and mean length of documents. One pass; a row of counts for each document is kept (persisted)."""
    count = lambda field, term: F.size(F.filter(field, lambda x: x == term))
    sizes = {"doc_length": F.size("t") + F.size("c")} | {f"{field}{k}": count(field, term) for k, term in enumerate(asked) for field in "tc"}
    rows = analyzed(articles, stop, stems).select("doc_id", *(v.alias(c) for c, v in sizes.items()))
    docs = rows.groupBy("doc_id").agg(*(F.sum(c).cast("int").alias(c) for c in sizes)).where("doc_length > 0").persist()
    each = [F.struct(F.lit(term).alias("term"), (F.col(f"t{k}") + F.col(f"c{k}")).alias("term_frequency"), F.col(f"t{k}").alias("title_tf"), F.col(f"c{k}").alias("content_tf")) for k, term in enumerate(asked)]
    each = F.array(*each) if each else F.array().cast("array<struct<term:string,term_frequency:int,title_tf:int,content_tf:int>>")
    found = docs.select("doc_id", F.explode(each).alias("x")).select("x.term", "doc_id", "x.term_frequency", "x.title_tf", "x.content_tf").where("term_frequency > 0")
    stats = docs.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_document_length"))
    return Index(term_counts(found), found, docs.select("doc_id", "doc_length"), stats)


def upserted(index: Index, articles: DataFrame, stop: Sequence[str] = (), stems: bool = True) -> Index:
    """The index with these articles' postings in place of their old ones; twice is as once."""
    new, ids = postings(articles, stop, stems), articles.select(F.col("id").alias("doc_id")).distinct()
    kept = index.postings.join(ids, "doc_id", "left_anti")
    doc_lengths = index.doc_lengths.select("doc_id", "doc_length").join(ids, "doc_id", "left_anti").unionByName(article_lengths(articles, stop, stems))
    found = from_postings(kept.select(*new.columns).unionByName(new))
    return Index(found.terms, found.postings, doc_lengths, corpus_stats(doc_lengths, found.terms))


def indexing_report(articles: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """One row: articles given, indexed, and skipped for having no tokens."""
    hit = articles.select(F.col("id").alias("doc_id")).join(doc_lengths.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return hit.agg(F.count(F.lit(1)).alias("articles"), F.count("hit").alias("articles_indexed"), (F.count(F.lit(1)) - F.count("hit")).alias("articles_skipped"))


