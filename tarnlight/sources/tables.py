"""Reading and writing the engine's tables, and the mapping of the document tables onto articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """url: the non-blank lines of a text file."""
    return spark.read.text(path).select(text.trim(F.col("value")).alias("url")).where("url <> ''")


def documents_as_articles(docs: DataFrame) -> DataFrame:
    """Documents as articles: the first line is the title, the source the domain; every seventh is undated."""
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    day = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")))
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/articles/"), "doc_id").alias("url"), F.col("source").alias("domain"), line.alias("title"), F.col("text").alias("content"), F.lit(False).alias("is_indexed"), day.cast("date").alias("published_date"))


def documents_as_signals(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Signals for the labelled documents: partial, as signals of articles may be."""
    return labels.join(docs.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("article_id"), (F.col("quality") * 60.0 + F.col("doc_id") % 25).alias("quality_score"), (F.col("doc_id") % 56 + 40.0).alias("authority_score"), (F.col("doc_id") % 61 + 40.0).alias("freshness_score")
    )


def append_new(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Insert or ignore: rows of new whose keys are not in old; of equal keys in new one comes in."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti"), allowMissingColumns=True)


def replace(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Insert or replace: rows of old whose keys are in new give way."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def add_counts(old: DataFrame, new: DataFrame, key: str, *counts: str) -> DataFrame:
    """Upsert with increment: counts of both sides are added by key."""
    return old.select(key, *counts).unionByName(new.select(key, *counts)).groupBy(key).agg(*(F.sum(c).alias(c) for c in counts))


def mark(table: DataFrame, keys: DataFrame, key: str, **values) -> DataFrame:
    """UPDATE ... WHERE key IN keys: columns set where the key is listed."""
    hit = table.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    for name, value in values.items():
        hit = hit.withColumn(name, F.when(F.col("_hit"), F.lit(value) if not isinstance(value, type(F.lit(0))) else value).otherwise(F.col(name)))
    return hit.select(*table.columns)


def published(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """Indexed articles with their signals, missing ones as 0: what is copied to the serving database."""
    scores = [c for c in signals.columns if c.endswith("_score")]
    return articles.where("is_indexed").join(signals.withColumnRenamed("article_id", "id"), "id", "left").fillna(0.0, scores)


def store(articles: DataFrame, signals: DataFrame, path: str) -> None:
    """Writes articles before signals; each write commits as a whole."""
    articles.write.mode("append").parquet(f"{path}/articles.parquet")
    signals.write.mode("append").parquet(f"{path}/signals.parquet")


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """Statements separated by semicolons, in order."""
    return [spark.sql(s) for s in script.split(";") if s.strip()]
