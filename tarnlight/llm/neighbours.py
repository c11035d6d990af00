"""10. Nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all trees, exact scores.

The trees are grown on a bounded sample of the vectors (`sample` of them, by a hash of their ids); every vector is then
indexed in a leaf of each tree. A query keeps the trees' open branches in one queue, ordered by how far the query lies on
the wrong side of their splits, and takes leaves from it until these hold a share of all vectors, and in one tree more than
k; the share is the least of a ladder that finds `recall` of the true neighbours of sample vectors within the sample, and
ends with all leaves of all trees. What the leaves hold is scored exactly, in double precision. Inner products become distances by one more coordinate that gives all vectors one length.

Equal vectors are one entry of the index, with a number of its own and their `k + 1` least ids: no other can be among the k
nearest. A leaf with more than `block` entries is dealt to several blocks, each of which its queries visit. Trees have a
leaf for every `LEAF` vectors, as far as the sample allows.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a vector shorter than the
longest counts as if zeros followed, and is stored so; every row is a candidate for every other, those that repeat its id or
its vector too, and rows that repeat in a query's id are queries one by one; a null vec_id is no query, and as a candidate
comes last of equals; fewer than k candidates give as many rows; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import ship
from .common import written

SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.2, 1.6, 2.2, 3.0, 4.0, 6.0)

#: Vectors a leaf, and the least and most leaves of a tree (a leaf then has four vectors of a full sample at least). A query gets
#: k + 1 rows from each leaf it visits: a leaf has to be large against that, or the rows are more than the work they save.
LEAF, LEAVES = 2000, (64, 2500)


@dataclass
class Tree:
    """normal and split of inner nodes, their children, and -1 - leaf in `child` entries that are leaves."""

    normals: np.ndarray
    splits: np.ndarray
    child: np.ndarray
    leaves: int

    @classmethod
    def grow(cls, points: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
        normals, splits, child, n_leaves = [], [], [], 0
        todo = [(np.arange(len(points)), leaves, None)]
        while todo:
            rows, want, place = todo.pop()
            direction = cls.direction(points, rows, rng) if want > 1 and len(rows) > 1 else None
            if direction is None:
                at, n_leaves = -1 - n_leaves, n_leaves + 1
            else:
                at = len(normals)
                shade = points[rows] @ direction
                split = float(np.median(shade))
                right = shade > split if (shade > split).any() else shade >= split
                normals.append(direction)
                splits.append(split)
                child.append([0, 0])
                todo += [(rows[~right], want // 2, (at, 0)), (rows[right], want - want // 2, (at, 1))]
            if place:
                child[place[0]][place[1]] = at
        dim = points.shape[1]
        return cls(np.array(normals).reshape(-1, dim), np.array(splits), np.array(child, np.int64).reshape(-1, 2), n_leaves)

    @staticmethod
    def direction(points: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        """Of eight random projections through two points each, the one that spreads the points most."""
        best, spread = None, 0.0
        for _ in range(8):
            a, b = rng.choice(rows, 2, replace=False)
            way = points[a] - points[b]
            length = np.linalg.norm(way)
            if length > 0 and (s := float((points[rows] @ (way / length)).std())) > spread:
                best, spread = way / length, s
        return best

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), np.int64) if len(self.splits) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", points[inner], self.normals[node]) > self.splits[node]
            at[inner] = self.child[node, side.astype(np.int64)]
        return -1 - at


def visits(trees: list[Tree], counts: list[np.ndarray], point: np.ndarray, most: float, least: int = 0) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until they hold `most` entries, and those of one tree `least`."""
    sides = [t.normals @ point - t.splits for t in trees]
    heap = [(0.0, k, 0 if len(t.splits) else -1) for k, t in enumerate(trees)]
    out, held, of_tree = [], 0.0, [0] * len(trees)
    while heap and (held < most or max(of_tree) < least):
        off, k, node = heapq.heappop(heap)
        while node >= 0:
            side = sides[k][node]
            near, far = (trees[k].child[node, 1], trees[k].child[node, 0]) if side > 0 else (trees[k].child[node, 0], trees[k].child[node, 1])
            heapq.heappush(heap, (max(off, abs(side)), k, int(far)))
            node = int(near)
        out.append((k, -1 - node))
        held += counts[k][-1 - node]
        of_tree[k] += int(counts[k][-1 - node])
    return out


@dataclass
class Forest:
    trees: list[Tree]
    longest: float
    share: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """One more coordinate, after which all vectors are as long as the longest."""
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (vectors**2).sum(axis=1)))
        return np.column_stack([vectors, rest]) / self.longest

    def asked(self, vector: np.ndarray) -> np.ndarray:
        """A query in the lifted space."""
        return np.append(vector / np.linalg.norm(vector), 0.0)

    @classmethod
    def fit(cls, sample: np.ndarray, longest: float, trees: int, leaves: int, k: int, recall: float, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        forest = cls([], longest, float(trees))  # all leaves
        points = forest.lifted(sample)
        forest.trees = [Tree.grow(points, leaves, rng) for _ in range(trees)]
        placed = [t.leaf(points) for t in forest.trees]
        counts = [np.bincount(p, minlength=t.leaves) for p, t in zip(placed, forest.trees)]
        tests = sample[: min(100, len(sample))]
        near = min(k, len(sample) - 1)
        if near < 1:
            return forest
        order = [forest.order(q, counts) for q in tests]
        true = [np.argpartition(-np.where(np.arange(len(sample)) == i, -np.inf, sample @ q), near - 1)[:near] for i, q in enumerate(tests)]
        for share in SHARES:
            hits = 0
            for found, want in zip(order, true):
                held, seen = 0, np.zeros(len(want), bool)
                for t, leaf in found:
                    if held >= share * len(sample):
                        break
                    held += counts[t][leaf]
                    seen |= placed[t][want] == leaf
                hits += int(seen.sum())
            if hits >= recall * near * len(tests):
                forest.share = share
                break
        return forest

    def order(self, vector: np.ndarray, counts: list[np.ndarray]) -> list[tuple[int, int]]:
        return visits(self.trees, counts, self.asked(vector), len(self.trees) * counts[0].sum())


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double, all of one length) of the rows that take part."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = found.where(F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    longest = F.lit(found.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0)
    zeros = F.array_repeat(F.lit(0.0), longest - F.size("embedding"))
    return found.withColumn("embedding", F.concat(F.transform("embedding", lambda x: x + F.lit(0.0)), zeros))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 8, leaves: int | None = None, recall: float = 0.96, sample: int = 10_000, block: int = 20_000, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    ship(spark)
    found = written(usable(vectors), "vectors")
    within = lambda *by: W.partitionBy("embedding", *by).orderBy(F.col("vec_id").asc_nulls_last())
    firsts = found.withColumn("_salt", F.spark_partition_id()).withColumn("_r", F.row_number().over(within("_salt"))).where(F.col("_r") <= k + 1)
    firsts = firsts.withColumn("_r", F.row_number().over(within())).where(F.col("_r") <= k + 1)
    # at most k + 1 ids, nulls last; collected in structs, as lists drop nulls. The number is fixed once the table is written
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("n"), "vec_id"))), lambda x: x["vec_id"])
    entries = written(firsts.groupBy("embedding").agg(ids.alias("ids")).withColumn("entry", F.monotonically_increasing_id()), "entries")
    stats = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], result)
    drawn = entries.select("embedding", F.xxhash64(F.lit(seed), "embedding").alias("h")).orderBy("h", "embedding").limit(sample).collect()
    leaves = leaves or int(np.clip(min(stats["n"] / LEAF, len(drawn) / 4), *LEAVES))
    forest = Forest.fit(np.array([r["embedding"] for r in drawn]), float(np.sqrt(stats["longest"])), trees, leaves, k, recall, seed)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = forest.lifted(np.stack(f["embedding"].to_numpy()))
            yield pd.DataFrame({"entry": f["entry"], "embedding": f["embedding"], "leaves": list(np.column_stack([t.leaf(points) for t in forest.trees]).astype(np.int32))})

    placed = entries.select("entry", "embedding").mapInPandas(index, "entry long, embedding array<double>, leaves array<int>")
    placed = written(placed.select("entry", "embedding", F.posexplode("leaves").alias("tree", "leaf")), "leaves")
    held = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # trees x leaves rows
    counts = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for r in held:
        counts[r["tree"]][r["leaf"]] = r["n"]
    blocks = [np.maximum(1, -(-c // block)) for c in counts]
    most = forest.share * stats["n"]

    def queue(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[list] = [[], [], [], []]
            for entry, vector in zip(f["entry"], f["embedding"]):
                for t, leaf in visits(forest.trees, counts, forest.asked(np.asarray(vector)), most, k + 2):
                    for b in range(blocks[t][leaf]):
                        for column, value in zip(out, (entry, t, leaf, b)):
                            column.append(value)
            yield pd.DataFrame(dict(zip(("query", "tree", "leaf", "block"), out)))

    queries = found.where(F.pmod("vec_id", F.lit(every)) == 0)
    of = queries.join(entries.select("embedding", "entry"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"))
    of = written(of.withColumn("asker", F.monotonically_increasing_id()), "queries")  # rows that share an id are queries one by one
    asked = entries.join(of.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi").select("entry", "embedding")
    route = asked.repartition(max(1, spark.sparkContext.defaultParallelism), "entry").mapInPandas(queue, "query long, tree int, leaf int, block int")
    route = route.join(asked.select(F.col("entry").alias("query"), F.col("embedding").alias("vector")), "query")
    n_blocks = F.create_map(*(F.lit(x) for t, b in enumerate(blocks) for leaf, n in enumerate(b) if n > 1 for x in (t * 1_000_000 + leaf, int(n)))) if any((b > 1).any() for b in blocks) else None
    dealt = F.lit(0) if n_blocks is None else F.pmod(F.xxhash64("entry"), F.coalesce(n_blocks[F.col("tree") * 1_000_000 + F.col("leaf")], F.lit(1))).cast("int")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "entry": [], "score": [], "size": []}, dtype=np.int64).astype({"score": float, "size": float})
        items, ids = np.stack(right["embedding"].to_numpy()), right["entry"].to_numpy()
        out = []
        for a in range(0, len(left), 256):
            q = left.iloc[a : a + 256]
            asking = np.stack(q["vector"].to_numpy())
            scores, size = asking @ items.T, np.linalg.norm(asking, axis=1)
            top = min(k + 1, len(ids))
            # ties at the edge stay: all that reach the top-th score
            edge = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
            i, j = np.nonzero(scores >= (edge - 1e-12 * np.maximum(1.0, np.abs(edge)))[:, None])
            out.append(pd.DataFrame({"query": q["query"].to_numpy()[i], "entry": ids[j], "score": scores[i, j], "size": size[i]}))
        return pd.concat(out)

    key = ["tree", "leaf", "block"]
    scored = route.groupBy(*key).cogroup(placed.withColumn("block", dealt).groupBy(*key)).applyInPandas(score, "query long, entry long, score double, size double")
    near = scored.groupBy("query", "entry").agg(F.max("score").alias("rough"), F.max("size").alias("size"))
    # all that reach the (k + 1)-th score but for rounding, which is relative to the lengths
    edge = F.nth_value("rough", k + 1).over(W.partitionBy("query").orderBy(F.desc("rough")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    slack = F.col("size") * F.lit(1e-12 * forest.longest)
    near = near.withColumn("_edge", edge).where(F.col("_edge").isNull() | (F.col("rough") >= F.col("_edge") - slack))
    # Scores anew from the original vectors, summed in the order of components, then ids of equal vectors.
    near = near.join(asked.select(F.col("entry").alias("query"), F.col("embedding").alias("vector")), "query")
    near = near.join(entries.select("entry", F.col("embedding").alias("item"), "ids"), "entry")
    dot = F.aggregate(F.zip_with("item", "vector", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    near = near.select("query", "entry", dot.alias("score"), F.posexplode("ids").alias("_p", "vec_id"))
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("entry"), F.col("_p")]
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("_r") <= k + 1)
    near = near.withColumn("_copy", F.row_number().over(W.partitionBy("query", "entry", "vec_id").orderBy("_p")))
    # A query's own row is among the k + 1 or not: the others keep their order.
    own = (F.col("entry") == F.col("query")) & F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("_copy") == 1)
    full = of.join(near, "query").where(~own)
    full = full.withColumn("rank", F.row_number().over(W.partitionBy("asker").orderBy("_r"))).where(F.col("rank") <= k)
    return full.select("query_id", "rank", "vec_id", "score")
