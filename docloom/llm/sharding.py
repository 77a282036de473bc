"""Shards of a corpus by jump consistent hashing of a stable key.

The shard is a function of the key and the number of shards alone: no ring table
is kept, and one more shard takes from every other only its share of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm.common import keep

_PART = 33  # bits below the partition in monotonically_increasing_id


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``0 .. shards - 1``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64)
    at, jump = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        at[going] = jump[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        high = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[going] = ((at[going] + 1) * (float(1 << 31) / high)).astype(np.int64)
        going = going[jump[going] < shards]
    return at


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (its shard if there were one more).

    All rows with one key, the null key too, share a shard. Columns of these two
    names are replaced; an empty table stays empty.
    """
    held = docs.drop("shard", "grown_shard").withColumn("_key", F.xxhash64(F.col(key)))
    schema = T.StructType(
        [f for f in held.schema if f.name != "_key"]
        + [T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)
            columns = [batch.column(n) for n in schema.names[:-2]]
            for n in (shards, shards + 1):
                columns.append(pa.array(jump_hash(keys, n).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return held.mapInArrow(run, schema)


def number_slots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``slot``: the row's place in its shard, gapless from 0 in the order of the key.

    Rows are sorted by (shard, key) over all tasks and numbered inside each; the
    counts of each task and shard, a table of at most tasks + shards rows, give
    what lies before. A shard may so be of any size. Equal keys get neighbouring
    slots in no fixed order. ``rows`` is written once, so keep it narrow.
    """
    at = (
        rows.repartitionByRange("shard", F.col(key).asc_nulls_first())
        .sortWithinPartitions("shard", F.col(key).asc_nulls_first())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    held = keep(at, "shards").withColumn("_part", F.shiftright("_at", _PART))
    counts = held.groupBy("_part", "shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "_part",
        "shard",
        (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_base"),
    )
    return (
        held.join(F.broadcast(before), ["_part", "shard"])
        .withColumn("slot", F.col("_at") - F.col("_base"))
        .select(*rows.columns, "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write the documents as Parquet folders ``shard=N``; many tasks may write one shard."""
    assign_shards(docs, shards, key).drop("grown_shard").write.partitionBy("shard").parquet(path)
