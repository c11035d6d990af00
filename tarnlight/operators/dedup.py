"""Duplicates of articles: by content hash and by URL, within a batch and against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def firsts(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the one that comes first; partial aggregation keeps hot keys small. Null keys all stay."""
    rest = [c for c in df.columns if c not in (key, order)]
    # a number of its own sets each row without a key apart, so that one pass does for all
    alone = df.withColumn("_alone", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    keyed = alone.groupBy(key, "_alone").agg(F.min_by(F.struct(*rest, F.col(order).alias("_order")), order).alias("_r"))
    return keyed.select(key, F.col("_r._order").alias(order), *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def validated(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Articles with a title of five characters whose content and URL are new, in the batch as in the store."""
    found = batch.where(F.length("title") >= 5)
    found = firsts(firsts(found, "content_hash", "id"), "url_normalized", "id")
    return found.join(stored.select("content_hash").where("content_hash IS NOT NULL"), "content_hash", "left_anti").join(stored.select("url_normalized").where("url_normalized IS NOT NULL"), "url_normalized", "left_anti").select(*batch.columns)
