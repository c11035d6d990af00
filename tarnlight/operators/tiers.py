"""Source tiers by domain: exact, or the longest listed suffix at a dot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import urls
from ..sources.schemas import TIERS


def tier_table(spark: SparkSession, profiles: tuple = config.SOURCE_PROFILES) -> DataFrame:
    """A row for each domain; of a domain listed twice the later profile holds."""
    rows = {d: (name, d, authority, primary, float(score), float(least)) for name, authority, primary, score, least, domains in profiles for d in domains}
    return spark.createDataFrame(list(rows.values()), TIERS)


def with_tier(df: DataFrame, host: str, profiles: tuple = config.SOURCE_PROFILES) -> DataFrame:
    """df with profile, authority, primary_domain, authority_score, min_quality and known (whether its host is listed).

    A host's suffixes are looked up as keys of a literal map, longest first: one pass, no join. The table is configuration,
    of fixed size.
    """
    table = {d: (name, authority, primary, float(score), float(least)) for name, authority, primary, score, least, domains in profiles for d in domains}
    entry = lambda row: F.struct(*(F.lit(v).alias(k) for k, v in zip(("profile", "authority", "primary_domain", "authority_score", "min_quality"), row)))
    name, authority, primary, score, least, _ = profiles[-1]
    bare = urls.bare_host(F.coalesce(F.col(host), F.lit("")))
    labels = F.split(bare, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.lit(None)
    if table:
        lookup = F.create_map(*(x for d, row in table.items() for x in (F.lit(d), entry(row))))
        hits = F.filter(F.transform(suffixes, lambda s: F.try_element_at(lookup, s)), lambda x: x.isNotNull())
        found = F.try_element_at(hits, F.lit(1))
    tier = F.coalesce(found, entry((name, authority, primary, float(score), float(least))))
    return df.withColumn("_tier", tier).withColumn("_known", found.isNotNull()).select("*", "_tier.*", F.col("_known").alias("known")).drop("_tier", "_known")
