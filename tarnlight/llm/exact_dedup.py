"""8. Exact dedup by distributed MSD radix partitioning: texts are split by successive bytes until a group is one or ended.

First each task splits the texts it has read and keeps one of equal ones, with the count and the largest doc_id, so that
copies meet as at most one text a task. The kept ones are then dealt out by their leading bytes: a prefix that more than
`crowd` of them share is split by further bytes, round by round and twice as deep each time, until its groups are small or
their texts have ended. Each group is split to the end in its task. Equality is that of all bytes; no digest is compared.

Defined cases: a null text is an empty text; of equal texts the row with the largest doc_id stays, one with a null doc_id
only where there is no other, and exactly one where rows repeat; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Texts that a task splits at once, in bytes: bounds its memory.
LOCAL_BYTES = 32 << 20
#: Leading bytes of the first round, and how many texts of one prefix a task may get before it is split further.
DEPTH, CROWD = 64, 2000


def msd_groups(values: list[bytes]) -> list[list[int]]:
    """Positions of equal values, by splitting on successive stretches of bytes, each twice as long as the last."""
    done: list[list[int]] = []
    todo = [(list(range(len(values))), 0, 8)]
    while todo:
        group, at, width = todo.pop()
        if len(group) == 1:
            done.append(group)
            continue
        digits: dict[bytes, list[int]] = {}
        for i in group:
            digits.setdefault(values[i][at : at + width], []).append(i)
        for digit, members in digits.items():
            if len(digit) < width or len(members) == 1:  # ended, or alone
                done.append(members)
            else:
                todo.append((members, at + width, 2 * width))
    return done


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1: the texts kept of a block; rows of kind 0: each document's block and group."""
    task, block = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    values: list[bytes] = []
    held = 0

    def split() -> Iterator[pa.RecordBatch]:
        nonlocal block, ids, values, held
        groups = msd_groups(values)
        member = np.empty(len(values), np.int64)
        for g, rows in enumerate(groups):
            member[rows] = g
        at, sha = (task << 32) + block, [hashlib.sha256(values[rows[0]]).hexdigest() for rows in groups]
        best = [max(rows, key=lambda i: (ids[i] is not None, ids[i] or 0)) for rows in groups]
        n = len(ids)
        for a in range(0, n, 10_000):
            b = min(n, a + 10_000)
            yield _batch(at, member[a:b].tolist(), ids[a:b], range(a, b), [None] * (b - a), [None] * (b - a), [sha[g] for g in member[a:b]])
        for a in range(0, len(groups), 500):
            part = range(a, min(len(groups), a + 500))
            yield _batch(at, list(part), [ids[best[g]] for g in part], [best[g] for g in part], [values[groups[g][0]] for g in part], [len(groups[g]) for g in part], [None] * len(part))
        block, ids, values, held = block + 1, [], [], 0

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = text.encode()
            ids.append(doc_id)
            values.append(raw)
            held += len(raw) + 100
            if held > LOCAL_BYTES:
                yield from split()
    if ids:
        yield from split()


def _batch(block: int, *columns: object) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[block] * len(columns[0]), *columns], kinds)], names=["block", "group", "doc_id", "pos", "text", "n", "sha"])


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits each prefix's texts to the end; the rows come in the order of prefixes."""
    prefix, rows, values = None, [], []

    def split() -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for members in msd_groups(values):
            block, _, keep, pos, _ = max((rows[i] for i in members), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
            size = sum(rows[i][4] for i in members)
            for i in members:
                for column, value in zip(out, (*rows[i][:2], keep, block, pos, size)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["block", "group", "keep_id", "keep_block", "keep_pos", "group_size"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "group", "doc_id", "pos", "n", "prefix", "text")]
        for *row, key, text in zip(*columns):
            if key != prefix and rows:
                yield split()
                rows, values = [], []
            prefix = key
            rows.append(row)
            values.append(text)
    if rows:
        yield split()


GROUP = "block long, group long, keep_id long, keep_block long, keep_pos long, group_size long"


def exact_duplicates(docs: DataFrame, depth: int = DEPTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs. Texts are shuffled once, copies at most once a block."""
    local = written(texts(docs).mapInArrow(_local, "block long, group long, doc_id long, pos long, text binary, n long, sha string"), "local-groups")
    heads = local.where("n IS NOT NULL").drop("sha")
    small, groups = [], []
    while True:
        heads = heads.withColumn("prefix", F.substring("text", 1, depth))
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "block", "pos")).alias("best")
        crowded = heads.groupBy("prefix").agg(F.count(F.lit(1)).alias("here"), best, F.sum("n").alias("group_size")).where(F.col("here") > crowd)
        if crowded.isEmpty():
            small.append(heads)
            break
        crowded = written(crowded, "crowded")
        small.append(heads.join(crowded, "prefix", "left_anti"))
        ended = crowded.where(F.octet_length("prefix") < depth)  # all bytes agree: one group, however many blocks hold it
        groups.append(heads.select("block", "group", "prefix").join(ended, "prefix").select("block", "group", F.col("best.doc_id").alias("keep_id"), F.col("best.block").alias("keep_block"), F.col("best.pos").alias("keep_pos"), "group_size"))
        heads = heads.join(crowded.where(F.octet_length("prefix") >= depth), "prefix", "left_semi")
        depth *= 2
    for part in small:
        dealt = part.select("block", "group", "doc_id", "pos", "n", "prefix", "text").repartition("prefix").sortWithinPartitions("prefix")
        groups.append(dealt.mapInArrow(_global, GROUP))
    found = groups[0]
    for more in groups[1:]:
        found = found.unionByName(more)
    members = local.where("n IS NULL").select("block", "group", "doc_id", "pos", F.col("sha").alias("text_sha256"))
    kept = (F.col("block") == F.col("keep_block")) & (F.col("pos") == F.col("keep_pos"))
    return members.join(found, ["block", "group"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
