"""6, with a threshold. One document of each group linked by Jaccard similarity of the sets of word shingles.

SimHash fingerprints are joined by their tries; each link found is verified on whole shingle sets. Fingerprints within a few
bits are only part of what is similar at 0.8 (about 10 of 64 bits differ there), and tries prune nothing at such a budget.
So pairs that differ in more bits than the budget are found exactly: texts that similar share a shingle among the first
n - ceil(0.8 n) + 1 of each, in one order of all shingles, rarest first (see line_dedup, whose postings, buckets and filters
this uses on whole texts). Pairs within the budget are the tries' alone: where all links of a component of fingerprints are
similar, they join every such pair in it. Where one is not, the component's pairs that share such a shingle are verified too.

A shingle that more than a few texts have so early makes no pairs. Its texts are first joined in blocks, each text in one
block of its commonest such shingle, a few rounds with other blocks; this collapses groups of near copies, whatever their
size, and is only a short cut. Of shingles whose texts are in several groups still, the texts of all but the largest
group are then compared with all the shingle's texts: nothing is dropped.

Defined cases: texts of the same words are one text; texts without words are one group; a text of fewer words than a
shingle is one shingle; the row that stays has the least doc_id, null last, and of several such the first by a hash of all
columns; a text is held whole, in about twenty times its size; other columns, whatever their names and types, are carried
unseen; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import line_dedup as ld
from .common import row_hash, texts, written
from .components import components
from .simhash import chosen_rows, fingerprint, trie_join

FOUND = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
#: Shingles that share a counter on average, and the most counters (64 MB when broadcast, as large in a task).
SHARED, MOST_COUNTERS = 16, 1 << 26
#: Rounds that join blocks of crowded shingles before the rest is compared exactly: any number gives the same groups.
ROUNDS = 2


def counters_for(size: int) -> int:
    """How many counters of rarity texts of so many bytes get: a power of two that grows with them. With a fixed number counts
    drown in those of other shingles, and passages that many unlike texts share come early and are compared."""
    return min(MOST_COUNTERS, max(ld.COUNTERS, 1 << (size // (6 * SHARED)).bit_length()))  # about 6 bytes a word


def _hashed(batches: Iterator[pa.RecordBatch], width: int, n_counters: int) -> Iterator[pa.RecordBatch]:
    """Of each text its fingerprint and its class (h1, h2: its words in order; 0, 0 without words); at the end the task's counts of shingles, up to 255 each, in packed parts, with the number of shingles as row of the first."""
    counts, total = np.zeros(n_counters, np.uint8), 0
    record = lambda n, **columns: pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in FOUND], schema=FOUND)
    for batch in batches:
        raw, h1, h2 = ld._raw(batch), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for s in ld.stretches(raw, width, whole=True):
            at, more = np.unique((s.tokens & np.uint64(n_counters - 1)).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + more, 255)
            total += len(s.tokens)
            h1[s.rows], h2[s.rows] = s.h1, s.h2
        prints = np.array([fingerprint(x, width) for x in raw], np.uint64).view(np.int64)
        yield record(len(raw), doc_id=batch.column("doc_id"), row=batch.column("row"), fp=pa.array(prints), h1=pa.array(h1), h2=pa.array(h2))
    for k, part in enumerate(np.split(counts, ld.CHUNKS) if total else ()):
        packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
        yield record(1, part=pa.array([k], pa.int32()), counts=pa.array([packed], pa.binary()), row=pa.array([0 if k else total], pa.int64()))


def _rarity(key: tuple, parts: Iterator[pd.DataFrame], n_counters: int) -> Iterator[pd.DataFrame]:
    """The rarity of a part's counters over all tasks, and the number of shingles as the first part has it."""
    sums, total = np.zeros(n_counters // ld.CHUNKS, np.int64), 0
    for part in parts:
        for packed in part["counts"]:
            sums += np.frombuffer(pa.decompress(packed, len(sums), codec="zstd", asbytes=True), np.uint8)
        total += int(part["row"].sum())
    yield pd.DataFrame({"part": [key[0]], "counts": [ld._code(sums).tobytes()], "row": [total]})


def _joined(key: tuple, rows: pd.DataFrame, p: int, q: int) -> pd.DataFrame:
    """Links (u, v) of a block's texts (node, root, tokens) that join roots which differ. Texts of the block's largest root ask nothing."""
    rows = rows.sort_values("node")
    node, root = rows["node"].to_numpy(), np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
    size = np.array([len(t) for t in rows["tokens"]], np.int64)
    ids = np.unique(np.concatenate(rows["tokens"].to_list()), return_inverse=True)[1]
    starts, mine, u, v = np.cumsum(size) - size, np.zeros(len(ids), bool), [], []
    for j in np.argsort(-size, kind="stable"):
        weight = np.bincount(root)
        if weight[root[j]] == weight.max() and (root[j] == weight.argmax()):
            continue
        own = ids[starts[j] : starts[j] + size[j]]
        mine[own] = True
        both = np.add.reduceat(mine[ids], starts, dtype=np.int64)
        mine[own] = False
        alike = np.flatnonzero((both * (p + q) >= (size + size[j]) * p) & (root != root[j]))
        for i in alike:
            if root[i] != root[j]:
                u.append(node[j])
                v.append(node[i])
                root[root == root[i]] = root[j]
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _links(docs: DataFrame, found: DataFrame, nodes: DataFrame, width: int, n_counters: int, t: Fraction, budget: int, most: int, hot_from: int, unit: int) -> DataFrame:
    """Links (u, v) of nodes (node, h1, h2, fp) that join all which are linked by chains of similar texts."""
    spark, p, q = docs.sparkSession, t.numerator, t.denominator

    def rarities(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rarity(key, parts, n_counters)

    parts = found.where("part IS NOT NULL").select("part", "counts", "row").groupBy("part").applyInPandas(rarities, "part int, counts binary, row long")
    parts = sorted(parts.collect(), key=lambda r: r["part"])  # a byte a counter
    codes = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in parts]) if parts else np.zeros(n_counters, np.uint8)
    source, rarity, total = texts(docs), spark.sparkContext.broadcast(codes), sum(r["row"] for r in parts)

    # by the tries of fingerprints; of equal fingerprints each text is linked with the first
    heads = nodes.groupBy("fp").agg(F.min("node").alias("of_fp"))
    near = trie_join(heads.select("fp"), budget)
    u, v = (heads.select(F.col("fp").alias(c), F.col("of_fp").alias(f"{c}_head")) for c in "uv")
    near = near.join(u, "u").join(v, "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    near = near.unionByName(nodes.select("fp", "node").join(heads, "fp").where("node <> of_fp").select(F.col("of_fp").alias("u"), F.col("node").alias("v")))
    near = written(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")

    # by shared early shingles, where fingerprints differ in more bits
    split, buckets = int(ld._code(max(hot_from, 4 * total / n_counters))), max(1, -(-int(total * (1 - float(t) + 1 / 20)) // most))
    blocks = source.mapInArrow(lambda b: ld._prefixes(b, width, p, q, rarity.value, split, buckets, whole=True), "bucket long, postings binary")
    met = written(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: ld._met(b, buckets, p, q), ld.CANDIDATE), "candidates")
    a, b = nodes.select("h1", "h2", F.col("node").alias("u"), F.col("fp").alias("u_fp")), nodes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("node").alias("v"), F.col("fp").alias("v_fp"))
    cold = met.where("token IS NULL").select("h1", "h2", "b1", "b2").distinct().join(a, ["h1", "h2"]).join(b, ["b1", "b2"])
    close = F.bit_count(F.col("u_fp").bitwiseXOR(F.col("v_fp"))) <= budget
    cold = written(cold.select("u", "v", close.alias("close")), "cold")
    pairs = near.withColumn("near", F.lit(True)).unionByName(cold.where("NOT close").select("u", "v", F.lit(False).alias("near")))
    pairs = written(pairs, "pairs")
    hot = met.where("token IS NOT NULL").select("token", "h1", "h2", "n").dropDuplicates(["token", "h1", "h2"])
    hot = written(hot.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("token", "node", "n"), "hot")

    # whole sets of the texts to compare: a filter of bounded size picks them in the last pass over the texts
    chosen = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(hot.select("node")).distinct()
    chosen = written(chosen.join(nodes.select("node", "h1", "h2"), "node"), "chosen")
    bits = min(ld.FILTER_BITS, 1 << max(10, (16 * chosen.count()).bit_length()))
    mask = spark.sparkContext.broadcast(ld._filter(chosen, bits))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = ld.Seen(), mask.value

        def wanted(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
            at = h1 % bits
            return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool) & seen.fresh(h1, h2)

        for batch in batches:
            for s in ld.stretches(ld._raw(batch), width, wanted, whole=True):
                tokens, _, _, _, n = ld._ordered(s, rarity.value)
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.h1), pa.array(s.h2), own], names=["h1", "h2", "tokens"])

    sets = source.mapInArrow(whole, "h1 long, h2 long, tokens array<long>").join(chosen, ["h1", "h2"]).select("node", "tokens").dropDuplicates(["node"])
    sets = written(sets, "sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "uv")
    both = F.size(F.array_intersect("u_tokens", "v_tokens"))
    alike = both * q >= (F.size("u_tokens") + F.size("v_tokens") - both) * p
    checked = pairs.join(x, "u").join(y, "v").select("u", "v", "near", alike.alias("alike")).where("near OR alike")
    checked = written(checked, "checked")
    links, failed = checked.where("alike").select("u", "v"), checked.where("NOT alike")
    if not failed.isEmpty():  # tries join by chains: what a link that failed held together may be similar all the same
        of = components(near)
        loose = failed.select(F.col("u").alias("node")).join(of, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
        again = cold.where("close").select("u", "v").join(of.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
        again = again.join(loose, "root", "left_semi").join(x, "u").join(y, "v").where(alike)
        links = links.unionByName(written(again.select("u", "v"), "links"))

    def live(links: DataFrame) -> DataFrame:
        """The postings of crowded shingles whose texts are in several groups, with their groups."""
        found = hot.join(components(links), "node", "left")
        now = written(found.select("token", "node", "n", F.coalesce("root", "node").alias("root")), "live")
        several = now.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("n").alias("w")).where("a < b")
        return written(now.join(several.select("token", "w"), "token"), "live")

    def settled(units: DataFrame) -> DataFrame:
        """Links found in units of (unit, token, node, root)."""
        full = units.join(sets, "node").select("unit", "token", "node", "root", "tokens")
        return written(full.groupBy("token", "unit").applyInPandas(lambda key, rows: _joined(key, rows, p, q), "u long, v long"), "links")

    now = live(links)
    n_blocks = F.ceil(F.col("w") / unit).cast("int")
    own = lambda k: F.pmod(F.xxhash64(F.lit(k), "node"), n_blocks).cast("int")
    for k in range(ROUNDS):
        if now.isEmpty():
            return links
        once = now.groupBy("node").agg(F.max(F.struct("w", F.xxhash64(F.lit(k), "token").alias("h"), "token", "root")).alias("t")).select("node", "t.w", "t.token", "t.root")
        more = settled(once.select("token", "node", "root", own(k).alias("unit")))
        if not more.isEmpty():
            links = links.unionByName(more)
            now = live(links)
    largest = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "root"))["root"].alias("largest"))
    wide = F.when(F.col("root") == F.col("largest"), F.array(own(9))).otherwise(F.sequence(F.lit(0), n_blocks - 1))
    units = now.join(largest, "token").select("token", "node", "root", F.explode(wide).alias("unit"))
    return links.unionByName(settled(units))


def one_of_each_similar(docs: DataFrame, width: int = 5, similarity: str = "0.8", budget: int = 3, most: int = ld.BUCKET, hot_from: int = ld.SPLIT, unit: int = ld.UNIT) -> DataFrame:
    """docs with one row of each group linked by Jaccard similarity of the shingle sets."""
    row = row_hash(docs)
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_counters = counters_for(size)
    found = texts(docs, row.alias("row")).mapInArrow(lambda b: _hashed(b, width, n_counters), "part int, counts binary, doc_id long, row long, fp long, h1 long, h2 long")
    found = written(found, "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("head_id"), F.col("row").alias("head_hash"))
    nodes = found.where("part IS NULL").groupBy("h1", "h2").agg(F.min("fp").alias("fp"), F.min(order).alias("head"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = _links(docs, found, nodes, width, n_counters, Fraction(similarity), budget, most, hot_from, unit)
    heads = nodes.join(components(links), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("head").alias("head"))
    return chosen_rows(docs, row, heads.select("root", "head.head_id", "head.head_hash"))
