"""Facets of results by source, and the filter they control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import domain


def domain_facets(results: DataFrame, n: int = 8) -> DataFrame:
    """domain, n_results of the n domains with most results."""
    return results.groupBy(domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_results")).orderBy(F.desc("n_results"), "domain").limit(n)


def enabled_results(results: DataFrame, enabled: Sequence[str]) -> DataFrame:
    """Results of enabled domains; those whose URL has no host stay."""
    host = F.try_parse_url("url", F.lit("HOST"))
    return results.where(host.isNull() | domain(F.col("url")).isin(*enabled))
