"""Rules for crawlers: parsed from robots texts line by line with built-ins, matched by the longest path prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import config
from ..functions import text, urls

MOST_CHARS, DEFAULT_DELAY = 100_000, 1.0


def directives(robots: DataFrame, agent: str = "*") -> DataFrame:
    """origin, ordinal, name, value, active of each directive; active where the last user-agent line names * or the agent."""
    lines = robots.where(F.length("text") <= MOST_CHARS).select("origin", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("line", text.trim(F.col("line")))
    lines = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    at = F.locate(":", F.col("line"))
    name = F.lower(text.trim(F.when(at > 0, F.substring("line", F.lit(1), at - 1)).otherwise(F.col("line"))))
    value = F.when(at > 0, text.trim(F.substring("line", at + 1, F.length("line")))).otherwise(F.lit(""))
    parsed = lines.select("origin", "ordinal", name.alias("name"), value.alias("value"))
    here = F.when(F.col("name") == "user-agent", (F.col("value") == "*") | (F.lower("value") == agent.lower()))
    last = F.last(here, ignorenulls=True).over(W.partitionBy("origin").orderBy("ordinal"))
    return parsed.withColumn("active", F.coalesce(last, F.lit(False)))


def rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """origin, rules (array of path, allow, ordinal), delay of each origin that has a text."""
    found = directives(robots, agent)
    is_rule = F.col("active") & F.col("name").isin("allow", "disallow") & (F.col("value") != "")
    delay = F.when(F.col("active") & (F.col("name") == "crawl-delay"), F.regexp_extract("value", r"^([+-]?\d*\.?\d+)", 1).try_cast("double"))
    rule = F.when(is_rule, F.struct(F.col("value").alias("path"), (F.col("name") == "allow").alias("allow"), "ordinal"))
    return found.groupBy("origin").agg(F.collect_list(rule).alias("rules"), F.max_by(delay, F.when(delay.isNotNull(), F.col("ordinal"))).alias("delay"))


def crawlable(pages: DataFrame, robots: DataFrame, agent: str = "*", blocked: Sequence[str] = tuple(config.BLOCKED_HOSTS)) -> DataFrame:
    """pages(url, ...) with allowed and delay. The longest rule that starts the path holds, the first of equals; none allows."""
    url, path = F.col("url"), urls.path(F.col("url"))
    joined = pages.withColumn("_origin", F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))).join(rules(robots, agent).withColumnRenamed("origin", "_origin"), "_origin", "left")
    hits = F.filter(F.coalesce("rules", F.array().cast("array<struct<path:string,allow:boolean,ordinal:int>>")), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), (-r["ordinal"]).alias("o"), r["allow"].alias("allow"))))
    open_ = urls.is_url(url) & ~urls.hostname(url).isin(*blocked)
    return joined.withColumn("allowed", open_ & F.coalesce(best["allow"], F.lit(True))).withColumn("delay", F.when(open_, F.coalesce("delay", F.lit(DEFAULT_DELAY))).otherwise(F.lit(0.0))).drop("_origin", "rules")
