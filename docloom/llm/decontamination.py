"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every window of k-grams that makes up
``WINDOW`` words, so a shared span of that many words always has a fingerprint
in common. Training and test fingerprints are joined, and every hit is extended
word by word to both sides as far as a window reaches; only spans of equal
words that fill a window count. Every window of a longer shared span has a
fingerprint of its own, so their extensions cover the span.

An item of fewer words than a window is one window of its own length; for these
lengths (at most ``WINDOW - 1`` of them) every position of a text is looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm import common as C

WINDOW = 13
GRAM = 5
#: Largest table of test hash bits sent to the tasks: 2**24 bits are 2 MB.
MOST_BITS = 24

_CONTEXT = [
    T.StructField("_kind", T.IntegerType()),
    T.StructField("_hash", T.LongType()),
    T.StructField("_pos", T.LongType()),
    T.StructField("_at", T.IntegerType()),
    T.StructField("_words", T.ArrayType(T.StringType())),
]


def _grams_of(h: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``C.grams`` for each of some ascending lengths; each length goes on from the one before."""
    out = np.zeros(len(h), np.uint64)
    for k in range(1, min(max(lengths, default=0), len(h)) + 1):
        out = out[: len(h) - k + 1] * C.MIX + h[k - 1 :]
        if k in lengths:
            yield k, C.mixed(out)


class Fingerprints:
    """Wanted fingerprints of one step: row, kind (words of the window), hash and position in the text.

    ``wanted`` tells by kind, hashes and rows which ones to hold. A text has as many as it has words for
    every short length, so each length is looked through on its own and only these are kept.
    """

    def __init__(
        self,
        words: C.Words,
        window: int,
        gram: int,
        short: list[int],
        wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
    ) -> None:
        self.words = words
        h, row, first = words.hashes(), words.row, words.first
        found = []

        def hold(kind: int, hashes: np.ndarray, at: np.ndarray) -> None:
            keep = wanted(kind, hashes, row[at])
            found.append((np.full(np.count_nonzero(keep), kind), hashes[keep], at[keep]))

        grams = C.grams(h, gram)
        full = C.whole(row, window)
        chosen = np.unique(C.anchors(grams, window - gram + 1)[full])
        hold(window, grams[chosen], chosen)
        for n, hashes in _grams_of(h, short):
            at = np.flatnonzero(C.whole(row, n))
            hold(n, hashes[at], at)
        self.kind, self.hash, self.at = (np.concatenate(x) for x in zip(*found))
        self.row = row[self.at]
        self.pos = self.at - first[self.row]

    def table(self, window: int, gram: int) -> list[pa.Array]:
        """Context columns: the words that windows around the fingerprints can reach."""
        kind, at, row, pos = self.kind, self.at, self.row, self.pos
        left = np.where(kind == window, np.minimum(pos, window - gram), 0)
        after = self.words.count[row] - pos
        right = np.where(kind == window, np.minimum(after, window), kind)
        size = left + right
        taken = C.spans(at - left, size)
        flat = self.words.distinct.take(pa.array(self.words.code[taken]))
        offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        return [
            pa.array(kind.astype(np.int32)),
            pa.array(self.hash.view(np.int64)),
            pa.array(pos),
            pa.array(left.astype(np.int32)),
            pa.ListArray.from_arrays(offsets, flat.cast(pa.string())),
        ]


def _test_side(items: DataFrame, window: int, gram: int) -> DataFrame:
    schema = T.StructType([T.StructField("_item", T.StringType()), *_CONTEXT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                words = C.words_of(part.column("_text"), C.PLAIN, lower=True)
                short = sorted({n for n in words.count.tolist() if 0 < n < window})
                # A short item is one window of its own length.
                own = lambda kind, _, row: (kind == window) | (words.count[row] == kind)  # noqa: E731, B023
                prints = Fingerprints(words, window, gram, short, own)
                names = part.column("_item").take(pa.array(prints.row))
                yield pa.RecordBatch.from_arrays([names, *prints.table(window, gram)], names=schema.names)

    return items.mapInArrow(run, schema)


def _bits(tests: DataFrame) -> tuple[np.ndarray, int]:
    """Flags of the leading hash bits that any test fingerprint has; of bounded size."""
    n = tests.count()
    width = min(MOST_BITS, max(12, (16 * n).bit_length()))
    bit = tests.select(F.shiftrightunsigned("_hash", 64 - width).alias("bit"))
    # At most 2**MOST_BITS / 32 rows, however many fingerprints there are.
    held = (
        bit.groupBy(F.shiftright("bit", 5).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
        .collect()
    )
    words = np.zeros(1 << (width - 5), "<u4")
    words[[r["at"] for r in held]] = [r["bits"] for r in held]
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool), width


def _train_side(docs: DataFrame, tests: DataFrame, window: int, gram: int) -> DataFrame:
    """A row with ``n_words`` for each document, and one for each fingerprint the tests may have."""
    flags, width = _bits(tests)
    # At most window - 1 different lengths.
    short = sorted(r[0] for r in tests.select("_kind").distinct().collect() if r[0] < window)
    schema = T.StructType(
        [docs.schema["_row"], docs.schema["_key"], T.StructField("n_words", T.LongType()), *_CONTEXT]
    )
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(held.value).view(bool)

        def wanted(_: int, hashes: np.ndarray, __: np.ndarray) -> np.ndarray:
            return known[(hashes >> np.uint64(64 - width)).astype(np.int64)]

        for batch in batches:
            for part in C.steps(batch, "_text"):
                words = C.words_of(part.column("_text"), C.PLAIN, lower=True)
                prints = Fingerprints(words, window, gram, short, wanted)
                context = prints.table(window, gram)
                nothing = [pa.nulls(len(words.count), t.type) for t in context]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_key"), pa.array(words.count), *nothing],
                    names=schema.names,
                )
                if len(prints.row):
                    row = pa.array(prints.row)
                    none = pa.nulls(len(row), pa.int64())
                    own = [part.column(c).take(row) for c in ("_row", "_key")]
                    yield pa.RecordBatch.from_arrays(
                        [*own, none, *context],
                        names=schema.names,
                    )

    return docs.mapInArrow(run, schema)


def _runs(window: int) -> tuple[Column, Column]:
    """Equal words to the left of a hit, and from it on to the right."""
    left = F.expr(
        "aggregate(sequence(1, 1 + least(_at, _at2)), 0, (n, j) -> "
        "if(n = j - 1 and j <= least(_at, _at2) and get(_words, _at - j) = get(_words2, _at2 - j), j, n))"
    )
    right = F.expr(
        "aggregate(sequence(0, least(size(_words) - _at, size(_words2) - _at2) - 1), 0, (n, j) -> "
        "if(n = j and get(_words, _at + j) = get(_words2, _at2 + j), n + 1, n))"
    )
    return left, right


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """Hits of each document: key, n_words, n_hit, n_items, items (ids as sorted strings).

    A row for each row of ``docs``, repeated keys and null keys included. Null
    and empty texts have no words. An item without words has no window; one with
    a null id still hits words but is not listed; repeated items count once.
    Further columns are not read. Empty tables on either side give no hits.
    """
    C.small_batches(docs.sparkSession)
    items = benchmark.select(
        F.col(item).cast("string").alias("_item"), F.col(item_text).alias("_text")
    )
    tests = C.keep(_test_side(items, window, gram), "test-prints")
    numbered = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    found = C.keep(_train_side(numbered, tests, window, gram), "train-prints")
    left, right = _runs(window)
    other = tests.select(
        "_item", "_kind", "_hash", F.col("_at").alias("_at2"), F.col("_words").alias("_words2")
    )
    span = F.col("_left") + F.col("_right")
    hits = (
        found.where(F.col("_kind").isNotNull())
        .join(other, ["_kind", "_hash"])
        .withColumns({"_left": left, "_right": right})
        .where(span >= F.col("_kind"))
        .select(
            "_row",
            "_item",
            (F.col("_pos") - F.col("_left")).alias("_from"),
            (F.col("_pos") + F.col("_right")).alias("_to"),
        )
        .distinct()
    )
    # Words in the union of a document's spans: each adds what lies behind all before it.
    earlier = (
        Window.partitionBy("_row").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.coalesce(F.max("_to").over(earlier), F.lit(0))
    counted = (
        hits.select("_row", "_from", "_to")
        .distinct()
        .withColumn("_new", F.greatest(F.lit(0), F.col("_to") - F.greatest("_from", reach)))
        .groupBy("_row")
        .agg(F.sum("_new").alias("n_hit"))
    )
    listed = hits.groupBy("_row").agg(F.sort_array(F.collect_set("_item")).alias("items"))
    base = found.where(F.col("_kind").isNull()).select("_row", "_key", "n_words")
    none = F.array().cast("array<string>")
    return (
        base.join(counted, "_row", "left")
        .join(listed, "_row", "left")
        .select(
            F.col("_key").alias(key),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"),
        )
    )


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
