"""Incremental indexing and crawling on streams: each micro-batch is an idempotent upsert under a checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..operators import index as ix


def unindexed(articles: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """Articles that are in no index yet."""
    return articles.join(doc_lengths.select(F.col("doc_id").alias("id")), "id", "left_anti")


def index_stream(articles: DataFrame, path: str, checkpoint: str, stop: Sequence[str] = (), stems: bool = True) -> StreamingQuery:
    """Writes each micro-batch's postings under its batch id, so that a batch that is run again replaces itself.

    A later batch's postings of a document hold: see `stream_index`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = ix.postings(ix.indexable(batch), stop, stems).withColumn("batch", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id:012d}")

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(spark, path: str) -> ix.Index:
    """The index of all batches written; of a document in several the last holds."""
    found = spark.read.schema("term string, doc_id string, term_frequency int, title_tf int, content_tf int, positions array<int>, batch long").option("recursiveFileLookup", "true").parquet(f"{path}/postings")
    last = found.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return ix.from_postings(found.join(last, ["doc_id", "batch"], "left_semi").drop("batch"))


def new_urls(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of URLs with seen_at, each once within the watermark, in queue form."""
    return stream.withColumn("url", urls.queue_url(F.col("url"))).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["url"])
