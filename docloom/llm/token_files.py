"""Token ids of a corpus as ORC files, in ascending order of the key.

Integer run-length encoding, row indexes and a Bloom filter on the key come
with the format: a reader takes stripes in parallel, and a lookup by key skips
stripes and row groups by their metadata.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm.common import keep, small_batches, steps
from docloom.llm.tokens import ENCODE_BYTES, checksums, encoder

INDEX_ROWS = 1000


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode whole texts, append id 0 to each and write ``key, ids`` below ``path``.

    Files and rows in them ascend by key (null first; equal keys in the order of
    their texts). A null text counts as empty; an empty table gives empty files;
    further columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for part in steps(batch, text, ENCODE_BYTES):
                ids, stops = tokens.ids(part.column(text))
                offsets = pa.array(np.concatenate(([0], stops)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], names=schema.names)

    (
        docs.select(key, text)
        .repartitionByRange(F.col(key).asc_nulls_first(), F.crc32(F.col(text)))
        .sortWithinPartitions(F.col(key).asc_nulls_first(), F.crc32(F.col(text)), text)
        .mapInArrow(encode, schema)
        .write.option("orc.bloom.filter.columns", key)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .orc(path)
    )


def token_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """From the files: key, start (ids before it in the corpus), n_tokens, ids_crc32.

    Positions are a prefix sum in two levels: running sums inside each file, and
    the totals of the files before it, of which there is one number per file.
    """
    small_batches(spark)
    files = spark.read.orc(path).select(key, "ids", F.col("_metadata.file_name").alias("_file"))
    schema = T.StructType(
        [
            T.StructField(key, files.schema[key].dataType),
            T.StructField("_file", T.StringType()),
            T.StructField("_row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            stops = offsets[1:] - offsets[0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("_file"),
                    batch.column("_row"),
                    pa.array(np.diff(offsets)),
                    pa.array(checksums(ids, stops), pa.int64()),
                ],
                names=schema.names,
            )

    numbered = files.withColumn("_row", F.monotonically_increasing_id())
    held = keep(numbered.mapInArrow(digest, schema), "token-index").withColumn(
        "_file", F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    )
    # One row per file, whatever the number of documents.
    totals = held.groupBy("_file").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select(
        F.col("_file"),
        (F.sum("_total").over(Window.orderBy("_file")) - F.col("_total")).alias("_before"),
    )
    in_file = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        held.withColumn("_own", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(F.broadcast(before), "_file")
        .select(key, (F.col("_before") + F.col("_own")).alias("start"), "n_tokens", "ids_crc32")
    )
