"""Text to dense and sparse vectors, over tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import vectors as V
from docloom.functions.domains import KNOWN
from docloom.functions.text import tokens
from docloom.operators.id_filters import unused
from docloom.session import small_batches, spread


def add_vectors(df: DataFrame, domain: str, text: str = "text") -> DataFrame:
    """Add ``dense`` and ``terms`` columns; both stay inside the row."""
    small_batches(df.sparkSession)
    if domain in V.ENCODERS:
        return df.withColumn("dense", V.encode_dense(F.col(text), domain)).withColumn(
            "terms", V.term_weights(F.col(text))
        )
    return _both(df, rules.VECTOR_WIDTH.get(domain, rules.VECTOR_WIDTH["general"]), text)


def _both(df: DataFrame, width: int | Column, text: str) -> DataFrame:
    """Both vectors of the default encoders from one look for tokens."""
    (words,) = unused(df, "_words")
    found = df.withColumn(words, tokens(F.col(text)))
    vectors = {"dense": V.encode_words(F.col(words), width), "terms": V.word_weights(F.col(words))}
    return found.withColumns(vectors).drop(words)


def add_vectors_by_domain(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its domain's encoder.

    Domains on the default encoder share one pass with the width as a column;
    only domains with an encoder of their own are split off.
    """
    small_batches(df.sparkSession)
    own = [d for d in KNOWN if d in V.ENCODERS]
    width = F.lit(rules.VECTOR_WIDTH["general"])
    for domain, size in rules.VECTOR_WIDTH.items():
        width = F.when(F.col("domain") == domain, size).otherwise(width)
    rest = df.where(~F.coalesce(F.col("domain").isin(own), F.lit(False))) if own else df
    parts = [_both(rest, width, text), *[add_vectors(df.where(F.col("domain") == d), d, text) for d in own]]
    return reduce(DataFrame.unionByName, parts)


def encode_distinct(df: DataFrame, domain: str, text: str = "text") -> DataFrame:
    """Encode each distinct text once and join the vectors back.

    Worth its two shuffles when the encoder is an expensive model. Copies are
    removed map-side first; many copies of one text on the join side are split
    by the adaptive skew join.
    """
    small_batches(df.sparkSession)
    encoded = (
        df.select(text)
        .dropDuplicates([text])
        .withColumn("dense", V.encode_dense(F.col(text), domain))
    )
    return df.join(encoded, text, "left")


def encode_sparse(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Long form ``key, token, weight`` of the non-zero terms."""
    return df.select(key, F.inline(V.term_weights(F.col(text))))


def sparse_pool(logits: DataFrame) -> DataFrame:
    """Largest ``log1p`` of the positive activations per document and token.

    In: ``document_id, token, logit`` with one row per position. ``log1p``
    rises with its argument, so the maximum is taken first.
    """
    return (
        logits.where(F.col("logit") > 0)
        .groupBy("document_id", "token")
        .agg(F.log1p(F.max("logit")).alias("weight"))
    )


def exact_quantile(
    values: DataFrame, quantile: float, slices: int = 4096, of: Callable[[np.ndarray], np.ndarray] = np.asarray
) -> float | None:
    """The least value that at least this share of all values does not exceed, of any range.

    ``values`` has one column of numbers or of lists of them; nulls, NaN and infinities do not
    count. A histogram of ``slices`` equal slices of ``of(values)`` is counted in the tasks, and the slice that
    holds the quantile is cut again, from its least to its largest value, until it holds
    one value. Only a row per slice comes to the driver, and a pass narrows the range by
    the number of slices or more.
    """

    def summed(low: float, high: float, parts: int) -> DataFrame:
        """Number, least and largest value of every slice between two bounds."""
        width = high / parts - low / parts
        width = width if width > 0 else high - low

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, least, most = np.zeros(parts, np.int64), np.full(parts, np.inf), np.full(parts, -np.inf)
            for batch in batches:
                column = batch.column(0)
                column = column.flatten() if pa.types.is_list(column.type) else column
                v = of(column.drop_null().cast(pa.float64()).to_numpy(zero_copy_only=False))
                v = np.sort(v[np.isfinite(v) & (v >= low) & (v <= high)])
                slot = np.minimum(np.floor((v - low) / width), parts - 1).astype(np.int64) if parts > 1 else v * 0
                first = np.flatnonzero(np.diff(slot, prepend=-1))
                at, last = slot[first].astype(np.int64), np.append(first[1:], len(v)) - 1
                if len(v):
                    n[at] += last - first + 1
                    least[at] = np.minimum(least[at], v[first])
                    most[at] = np.maximum(most[at], v[last])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (at, n[at], least[at], most[at])], names=["slot", "n", "low", "high"]
            )

        found = values.mapInArrow(run, "slot long, n long, low double, high double").groupBy("slot")
        return found.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    whole = summed(-np.inf, np.inf, 1).first()
    if whole is None:
        return None
    total, low, high = whole["n"], whole["low"], whole["high"]
    rest = math.ceil(total * quantile)
    while low < high:
        for row in sorted(summed(low, high, slices).collect(), key=lambda r: r["slot"]):
            low, high = row["low"], row["high"]
            if rest <= row["n"]:
                break
            rest -= row["n"]
    return low


def quantise_int8(
    df: DataFrame, key: str, vector: str = "dense", quantile: float = rules.QUANTILE
) -> DataFrame:
    """Vectors as signed bytes, clipped at a quantile of the absolute values.

    The quantile is exact on a grid of 1e-6, whatever the range of the entries. Null
    entries stay null; where the quantile is 0, all bytes are.
    """
    df = spread(df)
    # Rounding keeps the order, so the quantile of rounded values is the rounded quantile.
    clip = exact_quantile(df.select(vector), quantile, of=np.abs)
    limit = F.round(F.lit(clip).cast("double"), 6)

    def to_byte(x):
        bounded = F.greatest(F.least(x.cast("double"), limit), -limit)
        return F.round(bounded / F.when(limit > 0, limit).otherwise(F.lit(1.0)) * 127).cast("tinyint")

    # A null entry would otherwise count as the limit.
    bytes_ = F.transform(vector, lambda x: F.when(x.isNotNull(), to_byte(x)))
    return df.select(key, limit.alias("clip"), bytes_.alias("quantised"))
