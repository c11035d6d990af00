"""What the operators share: the shared folder, written tables, text columns."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only a session that is
    one process may do without and get a temporary folder; on a cluster each machine would write to a disk of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnlight-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no run has used."""
    return f"{shared_dir(spark)}/tarnlight/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Removes the tables and files that this application has written to the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tarnlight/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and further columns by name; anything else the table has is left out."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """The columns given, and docs' own as one struct `row`, so that none of them can meet a name of the operator's."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def uncarried(found: DataFrame, docs: DataFrame, **instead: Column) -> DataFrame:
    """The columns of docs out of `row`; `instead` has new values for some."""
    own = {c: F.col(f"row.{quoted(c)}") for c in docs.columns} | {c: v for c, v in instead.items() if c in docs.columns}
    return found.select(*(v.alias(c) for c, v in own.items()))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; those of types that can't be hashed (maps) go in as JSON."""
    odd = lambda f: any(x in f.dataType.json() for x in ('"type":"map"', '"variant"'))
    return F.xxhash64(*(F.to_json(F.struct(F.col(quoted(f.name)).alias("c"))) if odd(f) else F.col(quoted(f.name)) for f in docs.schema.fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(rows: int, each: int) -> int:
    """How many salts keep about `each` rows in one, for any size of input."""
    return max(1, math.ceil(rows / each))


def salt(n: int, *cols: Column) -> Column:
    """A salt in [0, n) that depends on the row's values alone, so that a rerun of a lost task deals alike."""
    return F.pmod(F.xxhash64(F.lit(911), *cols), F.lit(n))
