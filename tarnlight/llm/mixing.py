"""5. Mixing sources to target weights by weighted fair queueing.

Each source's documents, in an order drawn by a hash, get virtual finish times: words of the source up to and including
the document, divided by the source's target. All finish times together, over as many passes through a source as its
target may need, are ranged in order, and the queue is cut where the words reach the total budget.

Sources are taken by code point, null last, and weigh by the given weights in turn. They share `share` times all words;
none gets more than `most` times its own words, and what one can't use is dealt to the others by weight.

Running sums are taken in two steps, within buckets of about sqrt(rows) rows and over the buckets' sums, so that a source
with most of the rows is no more to a task than any other. Of the queue, ranges of finish times are summed, and only the
range in which the budget ends, about sqrt(rows) rows, is put in full order. The sources' sums, a row each, go to the driver.

Defined cases: a null, empty or blank text has size 0 and is never taken; rows that repeat are drawn one by one; the draw
depends on the rows alone, so reruns agree; a source without words has target 0; an empty table gives an empty result.
Columns besides doc_id, text and source, whatever their names and types, only order rows that are alike in these three. A text
of any length is counted whole, in place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import quoted, row_hash, texts, uncarried, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Words for each source: `share` of all, by weight, none above `most` times its own; the excess goes round by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def _source_key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), column), F.lit("n"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs, and with keep all its columns as one struct, row."""
    spark, passes = docs.sparkSession, max(1, math.ceil(most))

    def sized(*more: Column) -> DataFrame:
        found = texts(docs, F.col("source").cast("string").alias("source"), row_hash(docs).alias("_hash"), *more)
        kept = [c for c in found.columns if c == "row"]
        return found.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(41), "doc_id", "text").alias("_draw"), "_hash", *kept).withColumn("_key", _source_key(F.col("source")))

    narrow = written(sized(), "sizes")
    rows = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    size = {r["source"]: r["size"] for r in rows}
    goal = targets(size, weights, share, most)
    budget, n_buckets = sum(goal.values()), max(1, math.isqrt(sum(r["n"] for r in rows)))
    facts = spark.createDataFrame([("n" if s is None else "s" + s, int(size[s]), float(goal[s])) for s in size], "_key string, source_size long, target double")

    bucket = F.pmod(F.col("_draw"), F.lit(n_buckets)).cast("int")
    sums = narrow.withColumn("_bucket", bucket).groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    before = sums.withColumn("_before", F.sum("_words").over(W.partitionBy("_key").orderBy("_bucket")) - F.col("_words")).drop("_words")
    before = before.join(facts, "_key")

    def queued(found: DataFrame) -> DataFrame:
        """With _end: words of the source up to and including the document, in the order of the draw."""
        inside = W.partitionBy("_key", "_bucket").orderBy("_draw", "doc_id", "size", "_hash").rowsBetween(W.unboundedPreceding, 0)
        found = found.withColumn("_bucket", bucket).withColumn("_end", F.sum("size").over(inside)).join(before, ["_key", "_bucket"])
        return found.withColumn("_end", F.col("_end") + F.col("_before"))

    def ticket(k: int) -> Column:
        """The place in the queue of a document's k-th pass."""
        return F.struct(((F.col("_end") + F.lit(k) * F.col("source_size")) / F.col("target")).alias("finish"), F.col("_key").alias("key"), F.col("_draw").alias("draw"), F.col("doc_id").alias("doc_id"), F.col("_hash").alias("hash"))

    tickets = queued(narrow).where("size > 0").select("size", F.explode(F.array(*map(ticket, range(passes)))).alias("t")).select("size", "t", F.floor(F.col("t.finish") * n_buckets).alias("range"))
    ranges = tickets.groupBy("range").agg(F.sum("size").alias("words")).withColumn("ahead", F.sum("words").over(W.orderBy("range")) - F.col("words"))
    cut = ranges.where(F.col("ahead") + F.col("words") > F.lit(budget)).orderBy("range").first()
    if cut is None:
        times = F.lit(passes)
    else:
        near = tickets.where(F.col("range") == cut["range"]).withColumn("at", F.sum("size").over(W.orderBy("t").rangeBetween(W.unboundedPreceding, 0)) + F.lit(cut["ahead"]))
        last = near.where(F.col("at") <= F.lit(budget)).agg(F.max("t").alias("t")).first()["t"]
        if last is None:  # nothing of this range is taken
            taken = lambda k: F.floor(ticket(k)["finish"] * n_buckets) < F.lit(cut["range"])
        else:
            bound = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["key"]).alias("key"), F.lit(last["draw"]).alias("draw"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["hash"]).cast("long").alias("hash"))
            taken = lambda k: ticket(k) <= bound
        times = sum((F.when(taken(k), 1).otherwise(0) for k in range(passes)), F.lit(0))
    wide = sized(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")) if keep else narrow
    out = F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long")
    return queued(wide).select("doc_id", "size", "source_size", "target", out.alias("taken"), *(["row"] if keep else []))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix takes it."""
    found = mix(docs, keep=True, **how)
    times = (F.col("taken") / F.col("size")).cast("int")
    return uncarried(found.where("taken > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), times))), docs)
