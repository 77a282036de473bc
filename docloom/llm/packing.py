"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: every task streams its documents past a fixed
number of open bins. A bitset keyed by free space finds the fullest bin that
still takes a piece in one step; when a new bin would exceed the number of open
ones, the fullest open bin is closed. Nothing is shuffled and the state of a
task does not grow with its input. Pieces of one step (a bounded batch) are
placed longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import small_batches, steps
from docloom.llm.tokens import ENCODE_BYTES, encoder

LENGTH = 2048
OPEN_BINS = 4096


class Bins:
    """Open bins by free space; bit ``f`` of ``held`` tells that one with ``f`` free is open."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.held, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.held &= ~(1 << free)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin for a piece and its offset there."""
        fitting = self.held >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
            self.open -= 1
        else:
            free, found = self.length, self.made
            self.made += 1
            if self.open >= self.most and size < self.length:
                self._take((self.held & -self.held).bit_length() - 1)
                self.open -= 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(found)
            self.held |= 1 << left
            self.open += 1
        return found, self.length - free


def cut(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of every piece; only the first may be shorter."""
    count = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = sizes - (count - 1) * length
    start = np.where(number == 0, 0, first[doc] + (number - 1) * length)
    return doc, number, start, np.where(number == 0, first[doc], length)


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place: key, piece, start, length, sequence_id, offset, tokens.

    ``tokens`` are little-endian unsigned 32-bit ids. A null or empty text is
    one piece with the end id alone; rows with a null or repeated key are packed
    like any other; an empty table gives no rows; further columns are not read.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        bins = Bins(length, open_bins)
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in steps(batch, text, ENCODE_BYTES):
                ids, stops = tokens.ids(part.column(text))
                sizes = np.diff(stops, prepend=0)
                doc, number, start, size = cut(sizes, length)
                held, offset = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
                order = np.argsort(-size, kind="stable")
                for at, n in zip(order.tolist(), size[order].tolist()):
                    held[at], offset[at] = bins.place(n)
                ends = np.concatenate(([0], np.cumsum(size))) * 4
                raw = pa.Array.from_buffers(
                    pa.binary(),
                    len(doc),
                    [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(doc)),
                        pa.array(number.astype(np.int32)),
                        pa.array(start),
                        pa.array(size),
                        pa.array(held + base),
                        pa.array(offset),
                        raw,
                    ],
                    names=schema.names,
                )

    return docs.select(key, text).mapInArrow(run, schema)
