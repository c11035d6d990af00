"""Ranking columns: inverse document frequency, BM25 by fields, normalisation, decay and fusion of signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import config


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.when(doc_freq == 0, F.lit(0.0)).otherwise(F.log((n_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1))


def weighted_tf(title_tf: Column, content_tf: Column) -> Column:
    return title_tf * config.TITLE_WEIGHT + content_tf * config.CONTENT_WEIGHT


def bm25_term(title_tf: Column, content_tf: Column, length: Column, mean_length: Column, n_docs: Column, doc_freq: Column, k1: float = config.BM25_K1, b: float = config.BM25_B) -> Column:
    tf = weighted_tf(title_tf, content_tf)
    spread = tf + k1 * (1 - b + b * length / mean_length)
    return idf(n_docs, doc_freq) * (tf * (k1 + 1) / spread)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; 0.5 where all are equal."""
    return F.when(high - low > 1e-10, (value - low) / (high - low)).otherwise(F.lit(0.5))


def min_max_over_all(value: Column) -> Column:
    everything = W.partitionBy()
    return min_max(value, F.min(value).over(everything), F.max(value).over(everything))


def freshness_decay(published: Column, stored: Column, now: Column, half_life: float = config.HALF_LIFE_DAYS) -> Column:
    """Halves each half-life; the stored score without a date; 1 for the future. published and now are timestamps."""
    days = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(86_400_000_000.0)
    return F.when(published.isNull(), stored).when(days < 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -days / half_life))


def freshness_bucket(published: Column, now: Column) -> Column:
    days = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(86_400_000_000.0)
    score = F.lit(40.0)
    for limit, value in ((1000, 60.0), (365, 70.0), (90, 80.0), (30, 90.0), (7, 100.0)):
        score = F.when(days < limit, F.lit(value)).otherwise(score)
    return F.when(published.isNull(), F.lit(60.0)).otherwise(score)


def fuse(signals: Mapping[str, Column], weights: Mapping[str, float] = config.WEIGHTS) -> Column:
    return sum((signals[k] * F.lit(float(w)) for k, w in weights.items()), F.lit(0.0))
