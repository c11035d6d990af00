"""4. Token ids in binary shards, with a minimal perfect hash index from document keys to places in the shards.

Shards hold raw little-endian ids in ascending doc_id order (null first, then ties by text), each followed by its table
of documents. The index is dealt to parts by a hash of the key; a part maps each key, through a minimal perfect hash and
a stored fingerprint, to (shard, row, rows there, further shards), so a document is found in constant time. Rows that share
a doc_id stand side by side, over as many shards as they fill: further shards begin with them.

Every attempt at a task writes files of names of its own; those of the attempt that counts are in the task's rows, so a
task that is run again, or twice at a time, never touches what another has written. Where shards and parts are is a table:
nothing that grows with the corpus is held by the driver or sent to all tasks.

Defined cases: a null or empty text is the end id alone; rows with the same doc_id are found together; a null doc_id is a
key like any other, in a part of its own; other columns are ignored; an empty table gives no row. A text of any length is
encoded whole, alone if it is longer than a stretch (8 MB), in about twelve times its size.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import mph, vocab
from .common import new_path, shards, texts, written

HEAD, FOOT = b"TLIDS001", b"TLIDSEND"
SHARD_BYTES, PART_KEYS = 64 << 20, 250_000
#: Ids that a reader holds at once, and the index part of the null key.
READ_IDS, NULL_PART = 4 << 20, -1
VALUES = ("shard", "row", "here", "further")


def opened(uri: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, kind: str, chunks: Iterator[bytes]) -> str:
    """Writes a file under a name that no other attempt uses; returns the name."""
    name = f"{name}-{uuid.uuid4().hex}{kind}"
    files, path = opened(f"{folder}/{name}")
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
    return name


@dataclass(frozen=True)
class Store:
    """Where the files are, the ids' width in bytes, how many index parts; tables of shards (shard, file, first id) and parts (part, file)."""

    path: str
    width: int
    n_parts: int
    shards: DataFrame
    parts: DataFrame


class Shard:
    """A shard file, read by rows."""

    def __init__(self, uri: str, width: int):
        files, path = opened(uri)
        self.file, self.width = files.open_input_file(path), width
        size = self.file.size()
        foot = self.file.read_at(32, size - 32)
        if foot[24:] != FOOT or self.file.read_at(8, 0) != HEAD:
            raise ValueError(f"{uri} is not a whole shard")
        self.docs, self.tokens, at = (int.from_bytes(foot[k : k + 8], "little") for k in (0, 8, 16))
        table = self.file.read_at(size - 32 - at, at)
        self.keys = np.frombuffer(table, "<i8", self.docs)
        self.nulls = np.frombuffer(table, np.uint8, self.docs, 8 * self.docs)
        self.offsets = np.frombuffer(table, "<u8", self.docs + 1, 9 * self.docs).astype(np.int64)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def leading(self) -> int:
        """How many rows share the first one's key."""
        same = (self.keys == self.keys[:1]) & (self.nulls == self.nulls[:1])
        return self.docs if same.all() else int(np.argmin(same))

    def read(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ascending rows by stretches of neighbours, READ_IDS ids at most but for longer documents: rows, and all their ids."""
        for run in np.split(rows, np.flatnonzero(np.diff(rows) != 1) + 1) if len(rows) else []:
            while len(run):
                a = self.offsets[run[0]]
                n = max(1, int(np.searchsorted(self.offsets[run + 1] - a, READ_IDS, side="right")))
                raw = self.file.read_at(int(self.offsets[run[n - 1] + 1] - a) * self.width, 8 + int(a) * self.width)
                yield run[:n], np.frombuffer(raw, f"<u{self.width}").astype("<u4")
                run = run[n:]


def keyed(frame: DataFrame, parts: int) -> DataFrame:
    """With key and part of each doc_id."""
    key = F.coalesce(F.col("doc_id"), F.lit(0))
    part = F.when(F.col("doc_id").isNull(), NULL_PART).otherwise(F.pmod(F.xxhash64(F.lit(77), key), F.lit(parts)).cast("int"))
    return frame.withColumn("key", key).withColumn("part", part)


def write_store(docs: DataFrame, path: str, end_id: int, width: int = 2) -> Store:
    """Encodes docs with the byte-level vocabulary at path, and writes shards and index. Texts are shuffled once, for the order."""
    spark = docs.sparkSession
    source, folder = texts(docs), new_path(spark, "ids")
    size = source.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_parts = shards(size["n"], PART_KEYS)
    n_shards = max(shards(size["bytes"], SHARD_BYTES), min(spark.sparkContext.defaultParallelism * 3, max(1, size["n"])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, keys, sizes = vocab.ByteLevelIds(path), TaskContext.get().partitionId(), [], []

        def chunks() -> Iterator[bytes]:
            yield HEAD
            for batch in batches:
                keys.append(batch.column("doc_id"))
                for _, some in vocab.stretches(batch.column("text")):
                    found = words.encode_all(some, end_id)
                    sizes.append(found.sizes)
                    yield found.ids.astype(f"<u{width}").tobytes()
            ids, ends = pa.chunked_array(keys, pa.int64()), np.cumsum(np.concatenate([[0], *sizes]), dtype="<u8")
            yield ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_null().to_numpy().astype(np.uint8).tobytes() + ends.tobytes()
            yield b"".join(int(x).to_bytes(8, "little") for x in (len(ids), ends[-1], 8 + ends[-1] * np.uint64(width))) + FOOT

        name = put(folder, f"shard-{shard:07d}", ".ids", chunks())
        n = pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64))
        ids, at = pa.chunked_array(keys, pa.int64()).combine_chunks(), 0
        while at < len(ids):
            k = min(10_000, len(ids) - at)
            file = pa.array([name] + [None] * (k - 1) if at == 0 else [None] * k, pa.string())
            yield pa.RecordBatch.from_arrays([ids.slice(at, k), pa.array(np.full(k, shard, np.int32)), file, pa.array(np.arange(at, at + k, dtype=np.int32)), n.slice(at, k)], names=["doc_id", "shard", "file", "row", "n"])
            at += k

    # neither an id that many rows share nor a text that they share is one shard's: the scan's partition splits them further
    order = source.withColumn("start", F.substring("text", 1, 32)).withColumn("from", F.spark_partition_id())
    ordered = order.repartitionByRange(n_shards, "doc_id", "start", "from").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    places = written(ordered.mapInArrow(encode, "doc_id long, shard int, file string, row int, n long"), "places")

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        raw = mph.dump(group["key"].to_numpy(np.int64).astype(np.uint64), {k: group[k].to_numpy(np.uint32) for k in VALUES})
        return pd.DataFrame({"part": [int(key[0])], "file": [put(folder, f"index-{int(key[0]):07d}", ".mph", iter([raw]))]})

    runs = places.groupBy("doc_id", "shard").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("here"))
    first = F.min(F.struct("shard", "row", "here"))
    found = runs.groupBy("doc_id").agg(first.alias("at"), F.max("shard").alias("last")).select("doc_id", "at.*", (F.col("last") - F.col("at.shard")).alias("further"))
    parts = written(keyed(found, n_parts).groupBy("part").applyInPandas(build, "part int, file string"), "parts")
    total = places.groupBy("shard").agg(F.sum("n").alias("n"), F.max("file").alias("file"))  # a row for each shard of SHARD_BYTES
    total = written(total.withColumn("first", F.sum("n").over(W.orderBy("shard")) - F.col("n")).drop("n"), "shards")
    return Store(folder, width, n_parts, total, parts)


def locate(store: Store, keys: DataFrame) -> DataFrame:
    """shard, row, rows of the runs of documents whose doc_id is in keys (distinct); rows null: all that lead the shard. Others give no row."""

    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        files, path = opened(f"{store_path}/{group['file'].iloc[0]}")
        with files.open_input_stream(path) as f:
            index = mph.Index(f.read(), list(VALUES))
        _, at = index.find(group["key"].to_numpy(np.int64).astype(np.uint64))
        at = {k: v.astype(np.int64) for k, v in at.items()}
        more = at["further"]
        within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        shard = np.concatenate([at["shard"], np.repeat(at["shard"], more) + 1 + within])
        rows = pd.arrays.IntegerArray(np.concatenate([at["here"], np.zeros(len(within), np.int64)]), np.arange(len(shard)) >= len(more))
        return pd.DataFrame({"shard": shard.astype(np.int32), "row": np.concatenate([at["row"], np.zeros(len(within), np.int64)]), "rows": rows})

    store_path = store.path
    asked = keyed(keys.select("doc_id"), store.n_parts).join(store.parts, "part").select("part", "key", "file")
    return asked.groupBy("part").applyInPandas(ask, "shard int, row long, rows long")


def fetch(store: Store, places: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as unsigned 32-bit little-endian binary) of the documents at places, read from the shards."""
    width, folder = store.width, store.path

    def read(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(groups))  # one row for each key of the shard
        with Shard(f"{folder}/{group['file'].iloc[0]}", width) as shard:
            rows = [np.arange(r, r + (shard.leading() if pd.isna(n) else int(n))) for r, n in zip(group["row"], group["rows"])]
            for some, ids in shard.read(np.sort(np.concatenate(rows))):
                at = shard.offsets[some] - shard.offsets[some[0]]
                sizes, raw = np.diff(shard.offsets)[some], memoryview(ids).cast("B")
                each = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), sizes.tolist())]
                out = {"doc_id": pd.arrays.IntegerArray(shard.keys[some].astype(np.int64), shard.nulls[some] == 1), "start": int(group["first"].iloc[0]) + shard.offsets[some], "n_tokens": sizes, "ids_crc32": [zlib.crc32(x) for x in each]}
                yield pd.DataFrame(out | ({"ids": [bytes(x) for x in each]} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return places.join(store.shards, "shard").groupBy("shard").applyInPandas(read, schema)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the store of docs and reads every document back by its key."""
    store = write_store(docs, path, end_id)
    return fetch(store, locate(store, texts(docs).select("doc_id").distinct()))
