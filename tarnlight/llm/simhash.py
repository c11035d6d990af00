"""6. SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

The self-join traverses pairs of trie nodes together, adds up the bits in which they differ and drops a pair as soon as
the sum exceeds the budget. As fingerprints within k bits of each other agree wholly in one of k + 1 blocks of bits, there
is a trie for each block, with that block's bits first: its pairs start below equal nodes, and each such node is a unit of
work. A unit with more than `crowd` fingerprints is not given to a task: its nodes' children are paired on the cluster,
again within the budget, until all units are small; a task then goes on from there. Of the links it finds, a task returns
those that join what isn't joined yet. Components are found on tables, and copies of a fingerprint count once throughout.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words than a shingle
is one shingle; a component of null doc_ids alone has a null id; repeated rows give repeated rows; a text of any length is
hashed whole, in about ten times its size; other columns, whatever their names and types, are ignored or carried unseen; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import carried, row_hash, texts, uncarried, written
from .components import components

#: The most fingerprints of a pair of nodes that one task takes; bits by which the cluster descends in a larger one.
CROWD, STEP = 4000, 6
LEAF = 48

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none of a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(words) - width + 1))


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """Bit by bit the majority of the shingles' XXH64; a text without words has 0."""
    return _majority(shingle_hashes(text, width, seed))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    digits = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(digits[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, row: Column | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and row (a long of the caller's, or null) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column("row")], names=["doc_id", "fp", "row"])

    row = F.lit(None).cast("long") if row is None else row
    return texts(docs, row.alias("row")).mapInArrow(run, "doc_id long, fp long, row long")


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sorted values (right: None for left with itself) that agree to `depth` within what remains of the budget.

    Yields arrays of values, pair by pair. Both tries are walked together; small nodes are compared value by value.
    """
    todo = [(left, right, depth, budget)]
    while todo:
        a, b, depth, budget = todo.pop()
        if budget < 0 or not len(a) or (b is not None and not len(b)):
            continue
        if depth == 64 or len(a) + (len(a) if b is None else len(b)) <= LEAF:
            low = np.uint64((1 << (64 - depth)) - 1) if depth else np.uint64(2**64 - 1)
            near = np.bitwise_count((a[:, None] ^ (a if b is None else b)[None, :]) & low) <= budget
            i, j = np.nonzero(np.triu(near, 1) if b is None else near)
            if len(i):
                yield a[i], (a if b is None else b)[j]
            continue
        bit = np.uint64(1 << (63 - depth))
        a0, a1 = _split(a, bit)
        if b is None:
            todo += [(a0, None, depth + 1, budget), (a1, None, depth + 1, budget), (a0, a1, depth + 1, budget - 1)]
        else:
            b0, b1 = _split(b, bit)
            todo += [(a0, b0, depth + 1, budget), (a1, b1, depth + 1, budget), (a0, b1, depth + 1, budget - 1), (a1, b0, depth + 1, budget - 1)]


def _split(values: np.ndarray, bit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values that agree above this bit, by the bit."""
    at = int(np.searchsorted(values & bit, bit))
    return values[:at], values[at:]


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Of the pairs those that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    u, v = [], []
    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist()):
            if (a := root(x)) != (b := root(y)):
                parent[a] = b
                u.append(x)
                v.append(y)
    return u, v


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by)) if by else values


def _walk(batches: Iterator[pa.RecordBatch], depth: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (by, a, b, err, side, rot) in the order of units to links of fingerprints."""
    rest: pa.RecordBatch | None = None

    def units(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).to_numpy() for c in table.column_names}
        keys = np.stack([cols[c] for c in ("by", "a", "b", "err")])
        starts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        out_u, out_v = [], []
        for s, e in zip([0, *starts], [*starts, table.num_rows]):
            values = cols["rot"][s:e].view(np.uint64)
            side, by = cols["side"][s:e], int(cols["by"][s])
            if cols["a"][s] == cols["b"][s]:
                if e - s < 2:
                    continue
                pairs = trie_links(np.sort(values), None, depth, budget)
            else:
                pairs = trie_links(np.sort(values[side == 0]), np.sort(values[side == 1]), depth, budget - int(cols["err"][s]))
            u, v = _forest(pairs)
            if u:
                out_u.append(_rotated(np.array(u, np.uint64), (64 - by) % 64))
                out_v.append(_rotated(np.array(v, np.uint64), (64 - by) % 64))
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_u, out_v)], names=["u", "v"])

    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in ("by", "a", "b", "err")]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last unit may go on
        yield from units(table.slice(0, last)) if last else ()
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield from units(rest)


def trie_join(values: DataFrame, budget: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) that join all of values (fp long, distinct) that are linked by chains of at most `budget` differing bits."""
    blocks = budget + 1
    cuts = [64 * k // blocks for k in range(blocks)]
    depth = min(64 * (k + 1) // blocks - c for k, c in enumerate(cuts))

    def turned(x: Column, by: int) -> Column:
        return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x

    def top(x: Column, depth: int) -> Column:
        return F.shiftrightunsigned(x, 64 - depth)

    key = ["by", "a", "b", "err"]
    roots = F.array(*(F.struct(F.lit(c).alias("by"), turned(F.col("fp"), c).alias("rot")) for c in cuts))
    todo = values.select(F.explode(roots).alias("t")).select("t.by", "t.rot")
    todo = todo.select("by", top(F.col("rot"), depth).alias("a"), top(F.col("rot"), depth).alias("b"), F.lit(0).alias("err"), F.lit(0).alias("side"), "rot")
    todo, ready = written(todo, "units"), []
    while True:
        units = todo.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("right"))
        live = units.where(F.when(F.col("a") == F.col("b"), F.col("n") > 1).otherwise((F.col("right") > 0) & (F.col("right") < F.col("n"))))
        live = written(live.select(*key, (F.col("n") > crowd).alias("crowded")), "live")
        work = todo.join(live.where(~F.col("crowded")).drop("crowded"), key).repartition(*key).sortWithinPartitions(*key)
        ready.append(work.mapInArrow(lambda batches, depth=depth: _walk(batches, depth, budget), "u long, v long"))
        if depth == 64 or live.where("crowded").isEmpty():
            break
        step = min(STEP, 64 - depth)
        flips = [m for m in range(1 << step) if m.bit_count() <= budget]
        big = todo.join(live.where("crowded").drop("crowded"), key)
        child = top(F.col("rot"), depth + step).bitwiseAND(F.lit((1 << step) - 1))
        down = lambda node, digit: F.shiftleft(node, step).bitwiseOR(digit)
        big = big.withColumn("c", child).withColumn("f", F.explode(F.array(*map(F.lit, flips)))).withColumn("d", F.col("c").bitwiseXOR(F.col("f").cast("long")))
        alone = F.col("a") == F.col("b")
        first = F.when(alone, F.col("c") <= F.col("d")).otherwise(F.col("side") == 0)  # this value's node is the pair's left one
        spent = F.col("err") + F.bit_count("f")
        todo = big.where(spent <= budget).select(
            "by",
            down(F.col("a"), F.when(first, F.col("c")).otherwise(F.col("d"))).alias("a"),
            down(F.col("b"), F.when(first, F.col("d")).otherwise(F.col("c"))).alias("b"),
            spent.alias("err"), F.when(first, 0).otherwise(1).alias("side"), "rot",
        )
        todo, depth = written(todo, "units"), depth + step
    links = ready[0]
    for more in ready[1:]:
        links = links.unionByName(more)
    return links


def _groups(docs: DataFrame, width: int, budget: int, crowd: int, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, fingerprint and `row`; each fingerprint's component and its least doc_id."""
    found = written(fingerprints(docs, width, row), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(trie_join(distinct.select("fp"), budget, crowd))
    whole = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    return found, whole.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) of each row of docs."""
    found, named = _groups(docs, width, budget, crowd)
    return found.join(named.drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = 5, budget: int = 3, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each component: that with the least doc_id, and of several such the first by a hash of all columns.

    The rows that stay are chosen on doc_id and that hash; texts are shuffled for the last join alone.
    """
    row = row_hash(docs)
    return _heads(docs, row, *_groups(docs, width, budget, crowd, row))


def _heads(docs: DataFrame, row: Column, found: DataFrame, named: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("head_id"), F.col("row").alias("head_hash"))
    heads = found.join(named, "fp").groupBy("root").agg(F.min(order).alias("head")).select("root", "head.head_id", "head.head_hash")
    return chosen_rows(docs, row, heads)


def chosen_rows(docs: DataFrame, row: Column, heads: DataFrame) -> DataFrame:
    """The row of docs for each of heads (root, head_id, head_hash)."""
    kept = carried(docs, doc_id=F.col("doc_id").cast("long"), hash=row).join(heads, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash")))
    once = kept.withColumn("k", F.row_number().over(W.partitionBy("root").orderBy("hash"))).where("k = 1")  # rows that repeat in all columns
    return uncarried(once, docs)
