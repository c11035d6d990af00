"""7. Line dedup by an exact set-similarity join of lines.

A line's tokens are its shingles of five words (of a shorter line, the line), lower-cased. Lines of the same words are one
class, and of a class only the first line, by (doc_id, row, line), can stay. The classes' first lines are joined on Jaccard
similarity of 0.8 or more: tokens are put in one order, rarest first by counts over all documents; lines that similar share
a token of their prefixes, the first n - ceil(0.8 n) + 1; pairs whose lengths or whose places of the shared token leave no
room for the overlap are dropped; the rest are verified on whole token sets. A class that has an earlier match goes too.

Postings (token, class) leave the tasks in packed blocks, dealt by token to buckets of bounded size. Of a token that more
than HOT classes hold no pairs are made. Its classes meet in units that are compared inside a task, and a unit that is too
large for one is split by longer keys: lines with an overlap of l tokens or more share l of their first
n - ceil(0.8 n) + l, so a class goes to the unit of each further token of that stretch. What four tokens can't split, lines
that are alike at the start or have very few tokens, is compared by blocks. So nothing is dropped, whatever its size.

Rarity is counted in a table of hashed counters of fixed size: any order that is the same for all lines gives the same
result, so sharing a counter costs time, never a match. Words and tokens are compared by 64-bit hashes, lines by 128 bits.

Texts are hashed in stretches of half a megabyte, cut between lines: a task holds one at a time, however long a text is
(a single line longer than that is one stretch).

Defined cases: a null text has no lines; blank lines never go and aren't counted; of rows that repeat the later ones' lines
go; documents keep their row even when all lines go; null doc_ids come first; other columns, whatever their names and
types, are ignored, or carried along unseen; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import carried, row_hash, texts, uncarried, written
from .mph import mix

#: Counters of the rarity table (a megabyte when broadcast), and the pieces in which tasks' counts are summed.
COUNTERS, CHUNKS = 1 << 20, 64
#: Bits of the filter that picks the lines to verify: 16 for each, up to 16 MB; beyond, it lets more lines pass.
FILTER_BITS, FILTER_PIECE = 1 << 27, 1 << 18
#: Bytes of text that are hashed at once, and an odd base of the words' polynomials.
CHUNK, BASE = 1 << 19, 0x9E37_79B9_7F4A_7C15
#: Postings in a bucket; classes that a token may have in a bucket before it is hot; occurrences from which it is never put in one.
BUCKET, HOT, SPLIT = 250_000, 16, 1_000_000
#: Tokens of all lines of a unit that one task compares; tokens of a unit's key; buckets for tokens that are in none.
UNIT, LEVELS, SALTS = 200_000, 4, 64


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; those of a stretch are kept, those of a longer line aren't."""
    return _powers(2 * CHUNK) if n <= 2 * CHUNK else _powers.__wrapped__(n)


def _hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in these bytes, which begin and end with white space, and their hashes: polynomials by differences of running sums, mixed with the length."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    up, down = _powers_for(len(data))
    with np.errstate(over="ignore"):
        sums = data.astype(np.uint64)
        sums *= up[: len(data)]
        np.cumsum(sums, out=sums)
        return start, mix((sums[stop - 1] - sums[start - 1]) * down[start] + (stop - start).astype(np.uint64), 12)


#: Odd multipliers of a shingle's words, of words' places, and of a line's second hash.
_WEIGHTS = mix(np.arange(64, dtype=np.uint64), 5) | np.uint64(1)
_PLACE, _SECOND = np.uint64(0xD6E8_FEB8_6659_FD93), np.uint64(0xA076_1D64_78BD_642F)


def _lowered(raw: bytes) -> bytes:
    return raw.lower() if raw.isascii() else raw.decode().lower().encode()


class Lines(NamedTuple):
    """The non-blank lines of a stretch: all tokens, their line; row and number of each line, and its class (h1, h2)."""

    tokens: np.ndarray
    line: np.ndarray
    rows: np.ndarray
    numbers: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


Choice = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _stretch(raw: list[bytes], rows: list[int], first: list[int], width: int, choose: Choice | None) -> Lines | None:
    """The lines of some pieces of texts: piece k is of row rows[k] and begins with its line number first[k]. `choose` picks lines by (h1, h2)."""
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    at, hashed = _hashed_words(data)
    if not len(hashed):
        return None
    ends = np.flatnonzero(data == 10)[1:]
    upto = np.searchsorted(at, ends)  # words before each line's end
    length = np.diff(upto, prepend=0)
    lines = np.flatnonzero(length)
    start, length = (upto - length)[lines], length[lines]
    piece_of_line = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), ends)
    piece = piece_of_line[lines]
    number = (lines - np.searchsorted(piece_of_line, piece) + np.array(first)[piece]).astype(np.int32)
    with np.errstate(over="ignore"):
        place = (np.arange(len(hashed)) - np.repeat(start, length)).astype(np.uint64)
        in_order = mix(hashed + place * _PLACE, 8)
        h1 = mix(np.add.reduceat(in_order, start), 9).view(np.int64)
        h2 = mix(np.add.reduceat((in_order ^ (in_order >> np.uint64(29))) * _SECOND, start), 11).view(np.int64)
        if choose is not None:
            picked = choose(h1, h2)
            start, length, piece, number, h1, h2 = (c[picked] for c in (start, length, piece, number, h1, h2))
            if not len(start):
                return None
        # words of a shingle have a multiplier each; a shorter line is a shingle of its words and their number
        padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
        running = padded[: len(hashed)] * _WEIGHTS[0]
        for k in range(1, width):
            running += padded[k : k + len(hashed)] * _WEIGHTS[k]
        count = np.maximum(1, length - width + 1)
        before = np.cumsum(count) - count
        line = np.repeat(np.arange(len(length)), count)
        tokens = running[np.arange(len(line)) + np.repeat(start - before, count)]
        for short in range(1, width):
            i = np.flatnonzero(length == short)
            if len(i):
                words = hashed[start[i][:, None] + np.arange(short)]
                tokens[before[i]] = (words * _WEIGHTS[:short]).sum(axis=1) + _WEIGHTS[63 - short]
        tokens = mix(tokens, 99)
    return Lines(tokens, line, np.array(rows)[piece], number, h1, h2)


def stretches(found: list[bytes], width: int, choose: Choice | None = None, whole: bool = False) -> Iterator[Lines]:
    """The lines of texts, in order, by stretches of about CHUNK bytes; long texts are cut between lines.

    With `whole` a text is one line, however long, in which A-Z alone are lower-cased.
    """
    raw, rows, first, size = [], [], [], 0
    for row, text in enumerate(found):
        text = text.replace(b"\n", b" ").lower() if whole else text
        at, number = 0, 0
        while True:
            to = len(text)
            if to - at > CHUNK and not whole:
                cut = text.rfind(b"\n", at, at + CHUNK)
                cut = text.find(b"\n", at) if cut < 0 else cut
                to = cut if cut >= 0 else to
            if raw and size + to - at > CHUNK:
                if (lines := _stretch(raw, rows, first, width, choose)) is not None:
                    yield lines
                raw, rows, first, size = [], [], [], 0
            part = text[at:to]
            raw.append(part if whole else _lowered(part))
            rows.append(row)
            first.append(number)
            size += to - at + 1
            if to == len(text):
                break
            number += part.count(b"\n") + 1
            at = to + 1
    if raw and (lines := _stretch(raw, rows, first, width, choose)) is not None:
        yield lines


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


FOUND = "part int, counts binary, uid long, doc_id long, line int, h1 long, h2 long, numbers array<int>"
_FOUND = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("numbers", pa.list_(pa.int32()))])


def _found(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _FOUND], schema=_FOUND)


def _first_pass(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each line (h1, h2: its class) and each document (h1: a hash of its id and text; numbers: of its non-blank lines); at the end the task's counts of tokens, in parts."""
    counts, uid = np.zeros(COUNTERS, np.int64), TaskContext.get().partitionId() << 36
    for batch in batches:
        ids, of_row, numbers = batch.column("doc_id"), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for s in stretches(_raw(batch), width):
            np.add.at(counts, (s.tokens & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            yield _found(len(s.rows), uid=pa.array(uid + s.rows), doc_id=ids.take(pa.array(s.rows)), line=pa.array(s.numbers), h1=pa.array(s.h1), h2=pa.array(s.h2))
            of_row.append(s.rows)
            numbers.append(s.numbers)
        ends = np.cumsum(np.bincount(np.concatenate(of_row).astype(np.int64), minlength=len(ids)))
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(numbers)))
        yield _found(len(ids), uid=pa.array(uid + np.arange(len(ids))), doc_id=ids, h1=batch.column("hash"), numbers=own)
        uid += len(ids)
    if counts.any():
        yield _found(CHUNKS, part=pa.array(range(CHUNKS), pa.int32()), counts=pa.array([c.astype("<i8").tobytes() for c in np.split(counts, CHUNKS)], pa.binary()))


def _summed(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS // CHUNKS, np.int64)
    for part in parts:
        for raw in part["counts"]:
            total += np.frombuffer(raw, "<i8")
    yield pd.DataFrame({"part": [key[0]], "counts": [total.astype("<i8").tobytes()]})


def _code(counts: np.ndarray | float) -> np.ndarray:
    """Rarity in quarters of powers of two."""
    return (4 * np.log2(np.asarray(counts, float) + 1)).clip(0, 127).astype(np.uint8)


def _ordered(lines: Lines, rarity: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tokens of each line, rarest first: tokens, their rarity, their line, their place in it, and each line's number of them."""
    rare = rarity[(lines.tokens & np.uint64(len(rarity) - 1)).astype(np.int64)]
    # one key of line, rarity and most of the token sorts faster than three; where two tokens share it, all three decide
    key = (lines.line.astype(np.uint64) << np.uint64(44)) | (rare.astype(np.uint64) << np.uint64(37)) | (lines.tokens >> np.uint64(27))
    order = np.argsort(key)
    key, tokens = key[order], lines.tokens[order]
    alike = key[1:] == key[:-1]
    if (alike & (tokens[1:] != tokens[:-1])).any() or len(lines.rows) >= 1 << 20:
        order = np.lexsort((lines.tokens, rare, lines.line))
        tokens = lines.tokens[order]
        line = lines.line[order]
        alike = (tokens[1:] == tokens[:-1]) & (line[1:] == line[:-1])
    order = order[np.concatenate([[True], ~alike])]
    line = lines.line[order]
    n = np.bincount(line, minlength=len(lines.rows))
    return lines.tokens[order], rare[order], line, np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n), n


class Seen:
    """Which classes a task has met lately, in a table of fixed size: it forgets, and never takes one class for another."""

    def __init__(self, size: int = 1 << 16):
        self.h1, self.h2, self.size = np.zeros(size, np.int64), np.zeros(size, np.int64), size

    def fresh(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = h1 & (self.size - 1)
        known = (self.h1[at] == h1) & (self.h2[at] == h2)
        self.h1[at], self.h2[at] = h1, h2
        order = np.lexsort((h2, h1))  # stable: the first of a class in this stretch stays
        again = np.zeros(len(h1), bool)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        return ~(known | again)


_POSTING = np.dtype([("token", "<u8"), ("h1", "<i8"), ("h2", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _packed(rows: np.ndarray, hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Postings as one block a bucket; those of hot tokens by class to buckets of their own."""
    bucket = np.where(hot, buckets + (rows["h1"].view(np.uint64) % np.uint64(SALTS)).astype(np.int64), ((rows["token"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    blocks = [rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "postings"])


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, p: int, q: int, rarity: np.ndarray, split: int, buckets: int, most: int = 200_000, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks of the postings of prefixes, each class once as far as the task remembers."""
    seen, held, hot, size = Seen(), [], [], 0
    for batch in batches:
        for s in stretches(_raw(batch), width, seen.fresh, whole):
            tokens, rare, line, pos, n = _ordered(s, rarity)
            n = n[line]
            pick = pos < n - -(-p * n // q) + 1
            line = line[pick]
            rows = np.empty(len(line), _POSTING)
            rows["token"], rows["h1"], rows["h2"], rows["n"], rows["pos"] = tokens[pick], s.h1[line], s.h2[line], n[pick], pos[pick]
            held.append(rows)
            hot.append(rare[pick] >= split)
            size += len(rows)
            if size > most:
                yield _packed(np.concatenate(held), np.concatenate(hot), buckets)
                held, hot, size = [], [], 0
    if size:
        yield _packed(np.concatenate(held), np.concatenate(hot), buckets)


CANDIDATE = "token long, h1 long, h2 long, n int, pos int, b1 long, b2 long"
_CANDIDATE = pa.schema([("token", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("b1", pa.int64()), ("b2", pa.int64())])


def _same(rows: np.ndarray, *names: str) -> np.ndarray:
    return np.logical_and.reduce([rows[c][1:] == rows[c][:-1] for c in names])


def _matches(blocks: list[bytes], buckets: int, bucket: int, p: int, q: int) -> Iterator[pa.RecordBatch]:
    """A bucket's candidate pairs (h1, h2, b1, b2), and the postings of its hot tokens."""
    rows = np.concatenate([np.frombuffer(b, _POSTING) for b in blocks])
    if bucket < buckets:
        rows = rows[np.argsort(rows["token"])]
        same = rows["token"][1:] == rows["token"][:-1]
        rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(rows):
        return
    rows = rows[np.lexsort((rows["h2"], rows["h1"], rows["token"]))]
    rows = rows[np.concatenate([[True], ~_same(rows, "token", "h1", "h2")])]
    starts = np.flatnonzero(np.concatenate([[True], ~_same(rows, "token")]))
    sizes = np.diff(starts, append=len(rows))
    of_token = np.repeat(sizes, sizes)
    hot = rows[(of_token > HOT) | (bucket >= buckets)]
    for a in range(0, len(hot), 50_000):
        x = hot[a : a + 50_000]
        yield _candidates(x["token"].view(np.int64), x["h1"], x["h2"], n=x["n"], pos=x["pos"])
    if bucket >= buckets:
        return
    cold = rows[(of_token > 1) & (of_token <= HOT)]
    token, n, pos = cold["token"], cold["n"].astype(np.int64), cold["pos"].astype(np.int64)
    pairs = []
    for d in range(1, min(HOT, len(cold))):
        i = np.flatnonzero(token[d:] == token[:-d])
        if not len(i):
            break
        j = i + d
        need = -(-(n[i] + n[j]) * p // (p + q))
        ok = (n[i] * p <= n[j] * q) & (n[j] * p <= n[i] * q) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
        pairs.append(np.stack([cold["h1"][i[ok]], cold["h2"][i[ok]], cold["h1"][j[ok]], cold["h2"][j[ok]]]))
    if pairs and (found := np.unique(np.concatenate(pairs, axis=1), axis=1)).size:
        yield _candidates(None, found[0], found[1], b1=found[2], b2=found[3])


def _candidates(token: np.ndarray | None, h1: np.ndarray, h2: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"token": token, "h1": h1, "h2": h2} | more
    return pa.RecordBatch.from_arrays([pa.nulls(len(h1), f.type) if columns.get(f.name) is None else pa.array(np.ascontiguousarray(columns[f.name])).cast(f.type) for f in _CANDIDATE], schema=_CANDIDATE)


def _met(batches: Iterator[pa.RecordBatch], buckets: int, p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of buckets to candidates; one bucket is held at a time."""
    at, blocks = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("postings")):
            # a bucket of hot tokens has only to drop repeats: it may go out in parts
            if blocks and (bucket != at or (bucket >= buckets and sum(map(len, blocks)) > 8 << 20)):
                yield from _matches(blocks, buckets, at, p, q)
                blocks = []
            at = bucket
            blocks.append(block.as_py())
    if blocks:
        yield from _matches(blocks, buckets, at, p, q)


def _later(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Units in order to the classes (h1, h2) that match an earlier one of their unit. No pairs leave the task."""

    def settle(unit: pa.Table) -> pa.RecordBatch | None:
        unit = unit.take(pa.compute.sort_indices(unit, [(c, "ascending") for c in ("doc_id", "uid", "line")], null_placement="at_start"))
        tokens = unit.column("tokens").combine_chunks()
        size = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.unique(tokens.flatten().to_numpy(), return_inverse=True)[1]
        starts, mine, gone = np.cumsum(size) - size, np.zeros(len(ids), bool), np.zeros(len(size), bool)
        for j in range(len(size)):
            if gone[j]:
                continue  # its own matches are of no use: it has gone, and what it matches is asked itself unless it has too
            own = ids[starts[j] : starts[j] + size[j]]
            mine[own] = True
            both = np.add.reduceat(mine[ids], starts)
            mine[own] = False
            alike = both * (p + q) >= (size + size[j]) * p
            gone[j] = alike[:j].any()
            gone[j + 1 :] |= alike[j + 1 :]
        if gone.any():
            return pa.RecordBatch.from_arrays([unit.column(c).combine_chunks().filter(pa.array(gone)) for c in ("h1", "h2")], names=["h1", "h2"])
        return None

    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if rest and keys[a] != last:
                if (out := settle(pa.Table.from_batches(rest))) is not None:
                    yield out
                rest = []
            last = keys[a]
            rest.append(batch.slice(a, b - a))
    if rest and (out := settle(pa.Table.from_batches(rest))) is not None:
        yield out


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the keys' (h1) slots, put together from pieces that the cluster makes: bits / FILTER_PIECE rows."""
    each = min(FILTER_PIECE, bits)

    def bitmap(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(each, bool)
        for part in parts:
            out[part["slot"].to_numpy() % each] = True
        yield pd.DataFrame({"piece": [key[0]], "raw": [np.packbits(out).tobytes()]})

    slots = keys.select(F.pmod("h1", F.lit(bits)).cast("int").alias("slot")).distinct().withColumn("piece", F.floor(F.col("slot") / each).cast("int"))
    table = np.zeros(bits // 8, np.uint8)
    for r in slots.groupBy("piece").applyInPandas(bitmap, "piece int, raw binary").collect():
        table[r["piece"] * each // 8 : (r["piece"] + 1) * each // 8] = np.frombuffer(r["raw"], np.uint8)
    return table


def _units(hot: DataFrame, sets: DataFrame, p: int, q: int, unit: int) -> DataFrame:
    """(unit, h1, h2) of the classes to compare with each other: those of a hot token, split by longer keys where they are too many."""
    now = hot.select(F.xxhash64("token").alias("unit"), F.col("pos").alias("last"), "h1", "h2", "n", F.lit(True).alias("open"))
    ready = []
    for level in range(2, LEVELS + 2):
        now = written(now, "units")
        weight = now.groupBy("unit").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("c"))
        crowded = written(weight.where(F.col("w") > unit).select("unit", "w"), "crowded")
        if crowded.isEmpty():
            ready.append(now.join(weight.where("c > 1"), "unit", "left_semi").select("unit", "h1", "h2"))
            break
        ready.append(now.join(weight.where(f"c > 1 AND w <= {unit}"), "unit", "left_semi").select("unit", "h1", "h2"))
        large = now.join(crowded, "unit")
        least = F.ceil(F.lit(p) * F.col("n") / F.lit(q) - F.lit(1e-9))  # of any overlap that suffices
        # lines of so few tokens that the overlap may be less than the key also stay where they are, for each other
        stay = large.where((least < level) | ~F.col("open") | F.lit(level > LEVELS))
        blocks = F.ceil(F.col("w") / unit).cast("int")
        own = F.pmod(F.xxhash64(F.lit(3), "h1", "h2"), blocks).cast("int")
        stay = stay.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        ready.append(stay.select(F.xxhash64("unit", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("unit"), "h1", "h2"))
        if level > LEVELS:
            break
        upto = F.least(F.col("n"), F.col("n") - least + F.lit(level)).cast("int")
        further = large.where(F.col("open") & (F.col("last") + 1 < upto)).join(sets, ["h1", "h2"]).withColumn("at", F.explode(F.sequence(F.col("last") + 1, upto - 1)))
        now = further.select(F.xxhash64("unit", F.element_at("tokens", F.col("at") + 1)).alias("unit"), F.col("at").alias("last"), "h1", "h2", "n", "open")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def kept_lines(docs: DataFrame, width: int = 5, similarity: str = "0.8", most: int = BUCKET, hot_from: int = SPLIT, unit: int = UNIT) -> DataFrame:
    """uid, doc_id, _text (a hash of its id and text), numbers (of its non-blank lines) and kept (of those that stay, or null) of each document. uid tells rows apart that share a doc_id."""
    spark = docs.sparkSession
    source, t = texts(docs), Fraction(similarity)
    p, q = t.numerator, t.denominator
    found = written(source.withColumn("hash", F.xxhash64("doc_id", "text")).mapInArrow(lambda b: _first_pass(b, width), FOUND), "lines")
    parts = found.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInPandas(_summed, "part int, counts binary").collect()  # COUNTERS numbers
    counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(parts, key=lambda r: r["part"])]) if parts else np.zeros(COUNTERS, np.int64)
    lines = found.where("line IS NOT NULL").select("uid", "doc_id", "line", "h1", "h2")
    place = F.struct(F.col("doc_id"), F.col("uid"), F.col("line"))
    classes = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first")), "classes")

    rarity, total = spark.sparkContext.broadcast(_code(counts)), int(counts.sum())
    split = int(_code(max(hot_from, 4 * total / COUNTERS)))
    buckets = max(1, -(-int(total * (1 - float(t) + 1 / 20)) // most))
    blocks = source.mapInArrow(lambda b: _prefixes(b, width, p, q, rarity.value, split, buckets), "bucket long, postings binary")
    met = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _met(b, buckets, p, q), CANDIDATE)
    met = written(met, "candidates")
    pairs = written(met.where("token IS NULL").select("h1", "h2", "b1", "b2").distinct(), "pairs")
    hot = met.where("token IS NOT NULL").select("token", "h1", "h2", "n", "pos").dropDuplicates(["token", "h1", "h2"])

    # Whole token sets of the lines to compare: a filter of bounded size picks them in the last pass over the texts.
    chosen = pairs.select("h1", "h2").unionByName(pairs.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).unionByName(hot.select("h1", "h2")).distinct()
    chosen = written(chosen, "chosen")
    bits = min(FILTER_BITS, 1 << max(10, (16 * chosen.count()).bit_length()))
    mask = spark.sparkContext.broadcast(_filter(chosen, bits))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table, ranks = Seen(), mask.value, rarity.value

        def wanted(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
            at = h1 % bits
            return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool) & seen.fresh(h1, h2)

        for batch in batches:
            for s in stretches(_raw(batch), width, wanted):
                tokens, _, _, _, n = _ordered(s, ranks)
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.h1), pa.array(s.h2), own], names=["h1", "h2", "tokens"])

    sets = source.mapInArrow(whole, "h1 long, h2 long, tokens array<long>").join(chosen, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    sets = written(sets.join(classes, ["h1", "h2"]).select("h1", "h2", "first", "tokens"), "sets")
    x, y = (sets.select(*(F.col(c).alias(f"{side}_{c}") for c in sets.columns)) for side in "xy")
    two = pairs.join(x, (F.col("h1") == F.col("x_h1")) & (F.col("h2") == F.col("x_h2"))).join(y, (F.col("b1") == F.col("y_h1")) & (F.col("b2") == F.col("y_h2")))
    both = F.size(F.array_intersect("x_tokens", "y_tokens"))
    alike = both * q >= (F.size("x_tokens") + F.size("y_tokens") - both) * p
    later = F.when(F.col("x_first") < F.col("y_first"), F.struct(F.col("y_h1").alias("h1"), F.col("y_h2").alias("h2"))).otherwise(F.struct(F.col("x_h1").alias("h1"), F.col("x_h2").alias("h2")))
    crowd = _units(hot, sets, p, q, unit).distinct().join(sets, ["h1", "h2"]).select("unit", "first.doc_id", "first.uid", "first.line", "tokens", "h1", "h2")
    crowd = crowd.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda b: _later(b, p, q), "h1 long, h2 long")
    matched = two.where(alike).select(later.alias("m")).select("m.h1", "m.h2").unionByName(crowd)
    # of a class its first line alone can stay: neither all lines nor all documents are joined by class
    kept = classes.join(matched, ["h1", "h2"], "left_anti").groupBy("first.uid").agg(F.collect_list("first.line").alias("kept"))  # no more than a document's lines
    documents = found.where("part IS NULL AND line IS NULL").select("uid", "doc_id", F.col("h1").alias("_text"), "numbers")
    return documents.join(kept, "uid", "left")


def _removed(docs: DataFrame, **how) -> DataFrame:
    gone = F.sort_array(F.array_except("numbers", F.coalesce("kept", F.array().cast("array<int>"))))
    return kept_lines(docs, **how).select("uid", "doc_id", "_text", F.size("numbers").cast("long").alias("n_lines"), gone.alias("removed")).withColumn("n_removed", F.size("removed").cast("long"))


def line_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that go, from 0) of each row of docs."""
    return _removed(docs, **how).select("doc_id", "n_lines", "n_removed", "removed")


def without_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with the lines that go cut from their texts; all rows and columns stay. Of rows with equal doc_id and text, each gets one's cuts."""
    cut = _removed(docs, **how).select("uid", "doc_id", "_text", "n_removed", "removed")
    cut = cut.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "_text").orderBy("uid"))).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("_text").alias("cut_hash"), F.col("k").alias("cut_k"), "removed")
    named = carried(docs, doc_id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))), order=row_hash(docs))
    named = named.repartition("hash").withColumn("k", F.row_number().over(W.partitionBy("hash", "doc_id").orderBy("order")))
    # the hash alone is the key of both the numbering and the join, so texts move once; the rest are conditions on what it brings together
    same_id = F.coalesce(F.col("doc_id") - F.col("cut_id") == 0, F.col("doc_id").isNull() & F.col("cut_id").isNull())
    found = named.join(cut, (F.col("hash") == F.col("cut_hash")) & same_id & (F.col("k") - F.col("cut_k") == 0), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)
    rest = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: lines[i]), "\n")
    return uncarried(found, docs, text=F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(rest))
