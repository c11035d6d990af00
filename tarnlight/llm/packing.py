"""3. Packing into fixed-length sequences by linear grouping, configurations of few sizes, and best fit for small pieces.

Pieces of one length are interchangeable, so a packing is planned on the histogram of lengths: at most `capacity` numbers
whatever the corpus holds. Large lengths are dealt to groups of equal cardinality and rounded up to their group's largest;
the configurations of those few sizes are optimised by column generation and taken as often as they come in whole numbers;
actual lengths take the rounded ones' places, the last slot the longest that still fits. What is left is grouped and
optimised anew, in smaller groups each time, until no large piece is left. Small pieces then go where they fit best. The
plan is a table of runs, "ranks a.. of length l go to sequences s.. at offset o", and each piece finds its place by its rank
among the pieces of its length.

Defined cases: a null or empty text is the end id alone; equal pieces (repeated rows, ties in length) take different
places; only documents longer than the capacity are cut; other columns than doc_id and text are ignored; an empty table
gives an empty result. Rows with a null doc_id are packed like any other. A text of any length is tokenised whole, alone if it
is longer than a stretch (8 MB), in about twelve times its size.
"""

from __future__ import annotations

import bisect
import functools
import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import vocab
from .common import salt, texts, written

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, n long, first_sequence long, offset long"

Run = tuple[int, int, int, int, int]  # length, first rank, how many, first sequence, offset


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut at the capacity; with_ids adds ids (binary, little-endian unsigned 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocab.WordIds(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
        for batch in batches:
            for at, some in vocab.stretches(batch.column("text")):
                found = words.encode_all(some, end_id)
                raw, count = memoryview(found.ids.astype("<u4")).cast("B"), -(-found.sizes // capacity)
                doc = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(capacity, found.sizes[doc] - piece * capacity)
                begin = found.starts[doc] + piece * capacity
                parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
                columns = [batch.column("doc_id").take(pa.array(at + doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(map(bytes, parts), pa.binary())] if with_ids else columns, names=names)

    return texts(docs).mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def _dearest(sizes: np.ndarray, capacity: int) -> Callable[[np.ndarray], np.ndarray]:
    """For sizes of which at most three fit: prices to the dearest choice that fits, as numbers of pieces of each size."""
    k, order = len(sizes), np.argsort(sizes)
    two = np.append(sizes, 0)  # with one that isn't there
    room = capacity - two[:, None] - two[None, :]
    third = np.searchsorted(sizes[order], room, side="right")  # sizes that still fit
    third[room < 0] = -1

    def choose(prices: np.ndarray) -> np.ndarray:
        best = np.maximum.accumulate(np.append(0.0, prices[order]))
        worth = np.append(prices, 0.0)
        value = np.where(third >= 0, worth[:, None] + worth[None, :] + best[third], -np.inf)
        i, j = np.unravel_index(int(np.argmax(value)), value.shape)
        column, n = np.zeros(k + 1), int(third[i, j])
        column[i] += 1
        column[j] += 1
        if n and best[n] > 0:
            column[order[int(np.argmax(prices[order[:n]]))]] += 1
        return column[:k]

    return choose


def _filled(sizes: np.ndarray, capacity: int) -> Callable[[np.ndarray], np.ndarray]:
    """The same for any number of pieces, by dynamic programming over the capacity."""
    most = capacity // int(sizes.min())

    def choose(prices: np.ndarray) -> np.ndarray:
        # best[c]: the dearest choice of at most t pieces that fill at most c
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            now, pick = best.copy(), np.full(capacity + 1, -1)
            for g, s in enumerate(sizes):
                offer = best[: capacity + 1 - s] + prices[g]
                better = offer > now[s:] + 1e-12
                now[s:][better] = offer[better]
                pick[s:][better] = g
            picks.append(pick)
            best = now
        column, c = np.zeros(len(sizes)), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        return column

    return choose


@functools.lru_cache(8)
def configurations(sizes: tuple[int, ...], demand: tuple[int, ...], capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Cutting-stock relaxation by column generation: (pieces of each size in a sequence, how many such sequences)."""
    wide, wanted = np.array(sizes), np.array(demand, float)
    choose = _dearest(wide, capacity) if 4 * min(sizes) > capacity else _filled(wide, capacity)
    basis = np.diag([float(capacity // s) for s in sizes])
    # the inverse is kept by pivots, and without the library's threaded routines, which can hang in a process that has forked
    inverse = np.diag(1 / np.diag(basis))
    times = functools.partial(np.einsum, "ij,j->i")
    for k in range(rounds):
        if k % 200 == 199:
            inverse = _sharpened(basis, inverse)
        prices = inverse.sum(axis=0)
        column = choose(prices)
        if (column * prices).sum() <= 1 + 1e-7:
            break
        amount, enters = times(inverse, wanted), times(inverse, column)
        ratio = np.where(enters > 1e-9, amount / np.where(enters > 1e-9, enters, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / enters[out]
        inverse -= np.outer(enters, pivot)
        inverse[out] = pivot
    amount = times(_sharpened(basis, inverse), wanted)
    return [(basis[:, j].astype(int), float(x)) for j, x in enumerate(amount) if x > 0]


def _sharpened(basis: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """One step of Newton's iteration for the inverse: takes away the rounding errors of many pivots."""
    product = np.einsum("ij,jk->ik", basis, inverse)
    return 2 * inverse - np.einsum("ij,jk->ik", inverse, product)


#: Groups of the linear grouping, and the share of the capacity up to which a piece counts as small.
GROUPS, SMALL = 320, 1 / 4
#: Runs of a plan that are broadcast (40 bytes each); a longer plan is joined by a shuffle.
BROADCAST_RUNS = 200_000


class Plan:
    """Runs of places for a histogram {length: how many}, how many sequences they use, and how many large pieces stand in configurations."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL):
        self.capacity, self.runs, self.sequences, self.configured = capacity, [], 0, 0
        self.taken: dict[int, int] = defaultdict(int)  # ranks of each length that have a place
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences
        self.rooms: list[int] = []
        left = {n: c for n, c in histogram.items() if c > 0}
        if any(not 0 < n <= capacity for n in left):
            raise ValueError("a piece is empty or longer than the capacity")
        self.left = {n: c for n, c in left.items() if n > capacity * small}
        self.lengths = sorted(self.left)
        while self.left:
            self.grouped(groups)
        for n in sorted((n for n in left if n <= capacity * small), reverse=True):
            self.best_fit(n, left[n])

    def opened(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], n, sequence, offset))
        self.taken[length] += n

    def room(self, left: int, sequence: int, n: int) -> None:
        if left and n:
            if not self.free[left]:
                bisect.insort(self.rooms, left)
            self.free[left].append((sequence, n))

    def grouped(self, groups: int) -> None:
        """Linear grouping of the large pieces left, once; places one at least.

        Configurations are taken as often as they come in whole numbers. Where none does, each is taken once, those of
        the largest share first, as far as its pieces are there. What is left is grouped again, by the caller, with fewer
        pieces a group, until every group is one length. Pieces of one length stay together.
        """
        each, head, held, sizes, demand = math.ceil(sum(self.left.values()) / groups), 0, 0, [], []
        for n in reversed(self.lengths):
            if not held or held >= each or self.left[n] >= each:
                head, held = n, 0
                sizes.append(head)
                demand.append(0)
            held += self.left[n]
            demand[-1] += self.left[n]
        found = configurations(tuple(sizes), tuple(demand), self.capacity)
        least = dict(zip(sizes, [*sizes[1:], 0]))  # a group's lengths are above the next one's largest
        whole, placed = any(amount >= 1 - 1e-6 for _, amount in found), False
        # the configurations of the longest pieces choose first what fits with them
        found.sort(key=lambda f: tuple(-f[0]) if whole else -f[1])
        for pattern, amount in found:
            slots = [(s, least[s]) for s, k in zip(sizes, pattern) for _ in range(k)]
            n = math.floor(amount + 1e-6) if whole else 1
            while n and (part := self.substitute(slots, n, partly=not placed)):
                n, placed = n - part, True

    def longest(self, most: int, above: int, taken: list[int]) -> int:
        """The longest length left that is at most `most` and above `above`, besides those taken; 0 if there is none."""
        k = bisect.bisect_right(self.lengths, most) - 1
        while k >= 0 and self.lengths[k] > above:
            if self.left[self.lengths[k]] > taken.count(self.lengths[k]):
                return self.lengths[k]
            k -= 1
        return 0

    def substitute(self, slots: list[tuple[int, int]], n: int, partly: bool) -> int:
        """Up to n sequences of one configuration, with the same actual lengths in each; returns how many.

        Each slot takes the longest piece of its group; the last of several takes the longest of all that fits, as the
        others are shorter than they were rounded to. With `partly`, slots whose group is empty stay open.
        """
        lengths: list[int] = []
        for k, (most, above) in enumerate(slots):
            last = k == len(slots) - 1 and k > 0
            length = self.longest(self.capacity - sum(lengths), 0, lengths) if last else self.longest(most, above, lengths)
            if length:
                lengths.append(length)
            elif not partly:
                return 0
        if not lengths:
            return 0
        part = min([n, *(self.left[x] // lengths.count(x) for x in lengths)])
        at, offset = self.opened(part), 0
        for length in lengths:
            self.place(length, part, at, offset)
            self.configured += part
            offset += length
            self.left[length] -= part
        for length in set(lengths):
            if not self.left[length]:
                del self.left[length]
                self.lengths.pop(bisect.bisect_left(self.lengths, length))
        self.room(self.capacity - offset, at, part)
        return part

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of one length, each to the fullest sequence that has room; equal sequences are filled together."""
        while n:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = self.capacity // length
                count = math.ceil(n / each)
                self.room(self.capacity, self.opened(count), count)
                continue
            left = self.rooms[k]
            sequence, count = self.free[left].pop()
            if not self.free[left]:
                self.rooms.pop(k)
            each = min(left // length, n)
            fit = min(count, n // each)
            for j in range(each):
                self.place(length, fit, sequence, self.capacity - left + j * length)
            self.room(left - each * length, sequence, fit)
            self.room(left, sequence + fit, count - fit)
            n -= fit * each


def planned(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> Plan:
    return Plan(histogram, capacity, groups)


def packed(found: DataFrame, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32, ...).

    Ranks are counted in about sqrt(rows) salted buckets for each length, so that neither a length that a third of all
    pieces share nor the buckets' running sums meet in one task. The input is read three times: give a written table.
    """
    spark = found.sparkSession
    n_buckets = max(1, math.isqrt(found.count()))
    key = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = found.withColumn("_bucket", salt(n_buckets, *map(F.col, key)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = planned(histogram, capacity, groups)
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*key)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    places = spark.createDataFrame(plan.runs, PLAN).withColumnRenamed("length", "_length")
    if len(plan.runs) <= BROADCAST_RUNS:  # thousands, whatever the corpus holds: runs end where a length or a kind of room does
        places = F.broadcast(places)
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("n"))
    return ranked.join(places, fits).select(*found.columns, (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The places of all pieces of docs. Tokenised once, in a narrow pass; only piece descriptions are shuffled."""
    return packed(written(pieces(docs, path, end_id, capacity), "pieces"), capacity)
