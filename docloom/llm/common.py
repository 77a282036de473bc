"""Helpers shared by the training-text operators: Arrow batches, words, scratch tables.

Word splitting works on the UTF-8 bytes of a whole Arrow batch. Both word
patterns used here separate words by ASCII characters only, so a table of 256
flags decides every byte and no character is ever cut in two.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh64_intdigest

from docloom.operators.id_filters import id_filter, passing
from docloom.session import scratch_path, small_batches  # noqa: F401

#: Text bytes that one step of a task handles at once; one longer text is still taken whole.
STEP_BYTES = 2 << 20

#: Common function words of some European languages (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on be by at this from are or an not have "
    "le la les de des du un une et est que qui dans pour sur par avec pas au "
    "der die das und ist von den mit zu im für nicht auf ein eine dem sich auch als "
    "el los las y en que del se por con una su para es al lo"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that is free to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each (one row at least).

    What earlier batches have left free is given back at the end of each.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin, n = 0, batch.num_rows
    while begin < n:
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop
    give_back()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of texts; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def strings(ends: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Texts that lie one behind another in ``flat``; ``ends``: where each stops."""
    offsets = np.concatenate(([0], ends))
    kind, width = (pa.string(), np.int32) if len(flat) < 2**31 else (pa.large_string(), np.int64)
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.Array.from_buffers(kind, len(ends), buffers)


def byte_table(separators: bytes, others: bool = True) -> np.ndarray:
    held = np.full(256, others)
    held[list(separators)] = not others
    return held


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
PLAIN = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a batch of texts, in order."""

    row: np.ndarray  # index of the text of each word
    count: np.ndarray  # words of each text
    code: np.ndarray  # of each word, into distinct
    distinct: pa.Array
    ends: np.ndarray  # of each word in flat
    flat: np.ndarray  # bytes of all words without separators

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word."""
        return np.concatenate(([0], np.cumsum(self.count)[:-1]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        binary = self.distinct.cast(
            pa.large_binary() if pa.types.is_large_string(self.distinct.type) else pa.binary()
        )
        own = np.fromiter((xxh64_intdigest(w) for w in binary.to_pylist()), np.uint64, len(binary))
        return own[self.code]

    def strings(self) -> pa.Array:
        return strings(self.ends, self.flat)


def words_of(texts: pa.Array, member: np.ndarray, lower: bool = False) -> Words:
    off, buf = utf8(texts)
    if lower:
        buf = LOWER[buf]
    inside = member[buf]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = off[:-1] < off[1:]
    before[off[:-1][filled]] = False
    after[off[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    ends = np.cumsum(np.flatnonzero(inside & ~after) + 1 - start)
    count = np.diff(np.searchsorted(start, off))
    flat = buf[inside]
    held = strings(ends, flat).dictionary_encode()
    code = held.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(count)), count)
    return Words(row, count, code, held.dictionary, ends, flat)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (also across texts: see ``whole``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MIX + h[j : n + j]
    return mixed(out)


def whole(row: np.ndarray, k: int) -> np.ndarray:
    """For each position: do ``k`` words from there on belong to one text?"""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)


def anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: the position of the least of ``width`` grams, for each window of them.

    Of equal ones any may be taken: they have the same hash, which is all that
    is compared.
    """
    n = len(gram) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 20) - 1)
    at = np.arange(len(gram), dtype=np.uint64)
    least, have = (gram & ~low) | (at & low), 1
    while have < width:
        more = min(have, width - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    begin = at[:n]
    return (begin + ((least[:n] - begin) & low)).astype(np.int64)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start[i] .. start[i] + length[i] - 1``, one behind another."""
    stop = np.cumsum(length)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)



def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = np.diff(words.ends, prepend=0)
    flat = words.flat[np.repeat(keep, size)]
    size, row = size[keep], words.row[keep]
    n = len(words.count)
    later = np.zeros(len(row), np.int64)  # words that follow another one of their text
    later[1:] = row[1:] == row[:-1]
    place = np.arange(len(flat)) + np.repeat(np.cumsum(later), size)
    out = np.full(len(flat) + int(later.sum()), 0x20, np.uint8)
    out[place] = flat
    return strings(np.cumsum(np.bincount(row, size + later, n).astype(np.int64)), out)


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``dropped`` (written, as it is read twice).

    Only rows that the filter may contain are shuffled. Null keys stay.
    """
    held = id_filter(dropped, key)
    sure = passing(docs, held, key, maybe=False)
    rest = passing(docs, held, key).join(dropped.select(key), key, "left_anti")
    return sure.unionByName(rest.select(docs.columns))
