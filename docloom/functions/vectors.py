"""Vector columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docloom import rules
from docloom.functions.arrays import let
from docloom.functions.text import tokens


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )


def l2_normalise(vector: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    return let(
        norm(vector),
        lambda n: F.transform(
            vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))
        ),
    )


#: Rows that are counted at once, and words whose number a task holds.
STEP_ROWS = 512
HELD_WORDS = 100_000


@F.arrow_udf(ArrayType(FloatType()))
def _hash_counts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    number_of: dict[str, int] = {}

    def number(word: str) -> int:
        found = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4])
        if len(number_of) < HELD_WORDS:
            number_of[word] = found
        return found

    def counted(words: pa.Array, width: np.ndarray) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        begin = np.cumsum(width) - width
        # Words stay in Arrow; only the distinct ones of a step become Python strings.
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        held = number_of.get
        numbers = [number(w) if (n := held(w)) is None else n for w in coded.dictionary.to_pylist()]
        numbers = np.array(numbers, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(begin[row] + numbers[code] % width[row], minlength=int(width.sum()))
        counts = counts.astype(np.float64)
        length = np.sqrt(np.add.reduceat(counts * counts, begin))
        unit = counts / np.repeat(np.where(length > 0, length, 1.0), width)
        offsets = pa.array(np.append(begin, width.sum()).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.astype(np.float32)))

    for words_of_rows, widths in batches:
        width = widths.to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [
            counted(words_of_rows.slice(at, STEP_ROWS), width[at : at + STEP_ROWS])
            for at in range(0, len(words_of_rows), STEP_ROWS)
        ]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))


def hashed_encoder(width: int | Column) -> Callable[[Column], Column]:
    """Default dense encoder: unit-norm counts of tokens hashed to ``width`` buckets.

    The bucket of a token is the first 32 bits of its MD5 modulo ``width``, which
    may be a column, so rows of different domains share one pass.
    """
    return lambda text: encode_words(tokens(text), width)


def encode_words(words: Column, width: int | Column) -> Column:
    """The default dense encoder over tokens."""
    return _hash_counts(words, width if isinstance(width, Column) else F.lit(width))


ENCODERS: dict[str, Callable[[Column], Column]] = {}


def register_encoder(domain: str, encoder: Callable[[Column], Column]) -> None:
    """Use ``encoder`` (text column in, ``array<float>`` column out) for ``domain``."""
    ENCODERS[domain] = encoder


def encode_dense(text: Column, domain: str) -> Column:
    width = rules.VECTOR_WIDTH.get(domain, rules.VECTOR_WIDTH["general"])
    encoder = ENCODERS.get(domain) or hashed_encoder(width)
    return encoder(text)


def term_weights(text: Column, weigh: Callable[[Column], Column] = F.log1p) -> Column:
    """Default sparse encoder: ``array<struct<token, weight>>`` with ``log1p`` (``weigh``) of the count.

    Sorted tokens put equal ones side by side, so counting needs no shuffle and
    no look-up per token.
    """
    return word_weights(tokens(text), weigh)


def word_weights(all_words: Column, weigh: Callable[[Column], Column] = F.log1p) -> Column:
    """The default sparse encoder over tokens."""

    def count_runs(words: Column) -> Column:
        starts = F.filter(
            F.transform(
                words,
                lambda w, i: F.when((i == 0) | (w != F.try_element_at(words, i)), i),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda a, j: F.struct(
                    F.element_at(words, a + 1).alias("token"),
                    weigh(
                        (F.coalesce(F.try_element_at(at, j + 2), F.size(words)) - a).cast("double")
                    ).alias("weight"),
                ),
            ),
        )

    return let(
        F.sort_array(all_words),
        lambda words: F.when(F.size(words) > 0, count_runs(words)).otherwise(
            F.expr("cast(array() as array<struct<token:string,weight:double>>)")
        ),
    )
