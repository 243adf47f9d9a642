"""Incremental wiki state: a stream of documents upserts index and concept state, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.wiki import upsert


class WikiState:
    """Index state (key, first_seq, last_seq, brief) as versioned Parquet below ``folder``.

    Each batch writes a new version named after it, so a batch that is run again after a
    failure replaces its own version and reads the one before: the upsert happens once.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self, n: int) -> DataFrame:
        """State after batch ``n``; empty before the first."""
        if n < 0:
            return self.spark.createDataFrame([], "key string, first_seq bigint, last_seq bigint, brief string")
        return self.spark.read.parquet(f"{self.folder}/v{n:08d}")

    def apply(self, batch: DataFrame, n: int) -> None:
        """Upsert a batch (key, seq, brief)."""
        upsert(self.version(n - 1), batch.select("key", "seq", "brief"), "key").write.mode("overwrite").parquet(f"{self.folder}/v{n:08d}")


def run_stream(docs: DataFrame, describe: Callable[[DataFrame], DataFrame], state: WikiState, checkpoint: str) -> StreamingQuery:
    """Feed a stream of documents into the state; ``describe`` maps documents to (key, seq, brief).

    All available documents are taken, in as many batches as the source makes of them.
    """
    return docs.writeStream.foreachBatch(lambda batch, n: state.apply(describe(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_entries(docs: DataFrame) -> DataFrame:
    """(key, seq, brief) of documents (doc_id, doc_name, description)."""
    return docs.select(F.concat(F.lit("summaries/"), "doc_name").alias("key"), F.col("doc_id").alias("seq"), F.col("description").alias("brief"))
