"""Document quality with a factorisation machine.

Inputs are hashed words, statistics of the text's structure and its size in bins.
Every pair of inputs interacts through low-rank vectors; the sum over all pairs
is half of (square of sums - sum of squares), so a text is scored in time linear
in its distinct words. The model is fitted on a bounded sample of labelled rows;
scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import common as C

#: Labelled rows the model is fitted on at most; chosen by a hash of their ids.
SAMPLE_ROWS = 8000
WORD_BUCKETS = 1 << 13
RANK = 8
EPOCHS = 12
BATCH = 256
RATE = 0.02
DECAY = 2e-4
SEED = 7
#: A text is predicted to be good from this score on.
CUT = 0.3
BINS = 12

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = True
_UPPER, _LOWER, _DIGIT, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = {w.encode() for w in C.FUNCTION_WORDS}

STATISTICS = (
    "size words symbols shouting marks digits letters word_length stops repeated distinct triples lines ends bars"
).split()
WIDTH = WORD_BUCKETS + len(STATISTICS) * BINS


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _bin(values: np.ndarray, scale: float) -> np.ndarray:
    """Bins that are finer near 0: thresholds at scale * (k / BINS) ** 2."""
    return np.minimum((np.sqrt(np.maximum(values, 0) / scale) * BINS).astype(np.int64), BINS - 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, input and value of all non-zero inputs, by ascending row."""
    n = len(texts)
    off, buf = C.utf8(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[off[1:]] - total[off[:-1]]

    size = np.diff(off)
    words = C.words_of(texts, C.SPACED)
    count, row = words.count, words.row
    upper, lower = per_text(_UPPER[buf]), per_text(_LOWER[buf])
    ends = np.zeros(len(buf), bool)
    ends[:-1] = (buf[1:] == 10) & np.isin(buf[:-1], [33, 46, 63])
    same = np.zeros(len(row), bool)
    same[1:] = (words.code[1:] == words.code[:-1]) & (row[1:] == row[:-1])
    key = row.astype(np.int64) * max(1, len(words.distinct)) + words.code
    distinct = np.bincount(np.unique(key) // max(1, len(words.distinct)), minlength=n)
    grams = C.grams(words.hashes(), 3)
    whole = C.whole(row, 3)
    # Triples of words that the text has already: all minus the different ones.
    triple = C.mixed(grams[whole] + row[: len(whole)][whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(triple, return_index=True)[1]
    triples = np.bincount(row[: len(whole)][whole], minlength=n)
    new = np.bincount(row[: len(whole)][whole][first], minlength=n)
    plain = C.words_of(texts, C.PLAIN, lower=True)
    known = np.fromiter((w in _STOP for w in plain.distinct.cast(pa.binary()).to_pylist()), bool, len(plain.distinct))
    stops = np.bincount(plain.row[known[plain.code]], minlength=n)
    lines = per_text(buf == 10)
    statistics = [
        _bin(np.log2(size + 1.0), 24.0),
        _bin(np.log2(count + 1.0), 20.0),
        _bin(_share(per_text(_SYMBOL[buf]), size), 0.5),
        _bin(_share(upper, upper + lower), 1.0),
        _bin(_share(per_text(buf == 33), size), 0.3),
        _bin(_share(per_text(_DIGIT[buf]), size), 0.3),
        _bin(1 - _share(per_text(_LETTER[buf] | (buf == 32)), size), 1.0),
        _bin(_share(size, count), 30.0),
        _bin(_share(stops, plain.count), 0.6),
        _bin(_share(np.bincount(row[same], minlength=n), count), 1.0),
        _bin(1 - _share(distinct, count), 1.0),
        _bin(1 - _share(new, triples), 1.0),
        _bin(_share(lines, count), 0.2),
        _bin(1 - _share(per_text(ends), lines), 1.0),
        _bin(_share(per_text(buf == 124), count), 1.0),
    ]
    # Words: logarithms of counts in each bucket, of unit length per text.
    bucket = (plain.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int64) if len(plain.row) else plain.row
    cell, times = np.unique(plain.row * np.int64(WORD_BUCKETS) + bucket, return_counts=True)
    at, word = cell // WORD_BUCKETS, cell % WORD_BUCKETS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(at, value * value, n))
    value = value / norm[at]
    rows = np.concatenate([at, np.repeat(np.arange(n), len(statistics))])
    names = np.concatenate(
        [word, (np.stack(statistics, 1) + WORD_BUCKETS + np.arange(len(statistics)) * BINS).reshape(-1)]
    )
    values = np.concatenate([value, np.full(n * len(statistics), 1.0)])
    order = np.argsort(rows, kind="stable")
    return rows[order], names[order], values[order]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def sums(self, cut: np.ndarray, name: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw score of each row and its sums of factors; ``cut``: where rows begin (each has inputs)."""
        if not len(cut):
            return np.zeros(0), np.zeros((0, self.factors.shape[1]))
        held = self.factors[name] * value[:, None]
        total = np.add.reduceat(held, cut, axis=0)
        squares = np.add.reduceat((held * held).sum(1), cut)
        linear = np.add.reduceat(self.linear[name] * value, cut)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares), total

    def score(self, cut: np.ndarray, name: np.ndarray, value: np.ndarray) -> np.ndarray:
        return _logistic(self.sums(cut, name, value)[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """Fit on (inputs, values, label) rows with Adam; the same rows give the same model."""
    random = np.random.default_rng(SEED)
    shapes = [(1,), (WIDTH,), (WIDTH, RANK)]
    held = [np.zeros(1), np.zeros(WIDTH), random.normal(0, 0.03, (WIDTH, RANK))]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    label = np.array([r[2] for r in rows], float)
    step = 0
    for _ in range(EPOCHS if rows else 0):
        order = random.permutation(len(rows))
        for begin in range(0, len(rows), BATCH):
            mine = order[begin : begin + BATCH]
            name = np.concatenate([rows[i][0] for i in mine])
            value = np.concatenate([rows[i][1] for i in mine])
            size = np.array([len(rows[i][0]) for i in mine])
            cut = np.cumsum(size) - size
            machine = Machine(held[0][0], held[1], held[2])
            raw, total = machine.sums(cut, name, value)
            off = (_logistic(raw) - label[mine]) / len(mine)
            each = np.repeat(off, size) * value
            used, place = np.unique(name, return_inverse=True)
            linear = np.bincount(place, each, len(used))
            pull = np.repeat(total, size, axis=0) - held[2][name] * value[:, None]
            factors = np.stack(
                [np.bincount(place, each * pull[:, f], len(used)) for f in range(RANK)], 1
            )
            step += 1
            grads = [np.array([off.sum()]), linear + DECAY * held[1][used], factors + DECAY * held[2][used]]
            for p, (where, grad) in enumerate(zip((slice(None), used, used), grads)):
                mean[p][where] = 0.9 * mean[p][where] + 0.1 * grad
                square[p][where] = 0.999 * square[p][where] + 0.001 * grad * grad
                fixed = mean[p][where] / (1 - 0.9**step)
                scale = np.sqrt(square[p][where] / (1 - 0.999**step)) + 1e-8
                held[p][where] -= RATE * fixed / scale
    return Machine(float(held[0][0]), held[1], held[2])


def held_out(key: str = "doc_id") -> Column:
    """Rows that take no part in fitting."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _rows_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, name, value = features(part.column("_text"))
    return np.searchsorted(row, np.arange(part.num_rows)), name, value


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fit on at most ``sample_rows`` labelled documents; only their inputs reach the driver."""
    C.small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    wanted = texts.join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                cut, name, value = _rows_of(part)
                offsets = pa.array(np.append(cut, len(name)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_label"),
                        pa.ListArray.from_arrays(offsets, pa.array(name.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
                    ],
                    names=["_id", "_label", "names", "values"],
                )

    schema = T.StructType(
        [
            texts.schema["_id"],
            T.StructField("_label", T.IntegerType()),
            T.StructField("names", T.ArrayType(T.IntegerType())),
            T.StructField("values", T.ArrayType(T.FloatType())),
        ]
    )
    got = wanted.mapInArrow(run, schema).toArrow().sort_by("_id").combine_chunks()
    names, values, marks = (got.column(c).to_numpy() for c in ("names", "values", "_label"))
    return fit([(a.astype(np.int64), b.astype(float), m) for a, b, m in zip(names, values, marks.tolist())])


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` (0 to 1) of every row, null and empty texts included.

    Rows with null or repeated keys are scored like any other; an empty table
    gives no rows. Further columns are not read: neither labels nor the source or
    language of a document can reach a score.
    """
    C.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                got = held.value.score(*_rows_of(part))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(got)], names=schema.names)

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, machine: Machine, cut: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose score is at least ``cut``."""
    C.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(at)], names=["_text"])
            begin = 0
            for part in C.steps(named, "_text"):
                good = held.value.score(*_rows_of(part)) >= cut
                yield batch.slice(begin, part.num_rows).filter(pa.array(good))
                begin += part.num_rows

    return docs.mapInArrow(run, docs.schema)
