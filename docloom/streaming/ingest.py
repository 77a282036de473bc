"""Continuous ingestion of documents into the chunk collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.domains import normalise_domain
from docloom.operators.chunking import chunk_documents
from docloom.operators.encoding import add_vectors_by_domain
from docloom.operators.id_filters import newest_rows
from docloom.session import drop_path, scratch_path, settings
from docloom.sources.collections import BY_FOLDER, ChunkStore

#: The shuffle of a batch goes as soon as the batch is written.
STAGING = {**BY_FOLDER, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of staged text in a row group, and that a task turns into points at most.
GROUP_BYTES = 4 * 1024 * 1024
TASK_BYTES = 32 * 1024 * 1024


def _small_splits(spark: SparkSession) -> dict[str, int]:
    """Settings for work that takes long per byte: several tasks a core, each of bounded size."""
    most = min(TASK_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return {"spark.sql.files.minPartitionNum": 4 * cores, "spark.sql.files.maxPartitionBytes": most}


def build_points(documents: DataFrame) -> DataFrame:
    """Documents to indexed points: all their chunks, with vectors and sparse terms."""
    return add_vectors_by_domain(chunk_documents(documents))


def start_ingest(
    documents: DataFrame, store: ChunkStore, checkpoint: str, version: str, **trigger
) -> StreamingQuery:
    """Every micro-batch replaces its documents; one that is delivered again changes nothing.

    ``documents``: streaming ``document_id, domain, content, <version>``. Of several
    versions of a document in one batch the largest counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Documents move to the folders of their chunks, so that the far larger points need not.
        placed = store.placed(batch.withColumn("domain", normalise_domain(F.col("domain"))))
        path = scratch_path(spark, "batch")
        with settings(spark, STAGING):
            placed.hint("rebalance", "domain", "bucket").write.partitionBy("domain", "bucket").option(
                "parquet.block.size", GROUP_BYTES
            ).parquet(path, compression="zstd")
        staged = spark.read.schema(placed.schema).parquet(path)
        with settings(spark, _small_splits(spark)):
            points = build_points(newest_rows(staged, "document_id", version))
            store.replace_documents(points, version, f"{checkpoint}:{number}", staged, dealt=True)
        drop_path(spark, path)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
