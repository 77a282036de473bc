"""Text columns: trimming, tokens, sentences, windows and slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.arrays import empty, let, scan


def strip(text: Column) -> Column:
    """Remove white space, in the Unicode sense, from both ends."""
    return F.btrim(text, F.lit(rules.WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(rules.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(rules.WHITESPACE))


def jvm(pattern: str, flags: str = "") -> str:
    """The stated pattern with Unicode classes, ``\\n`` as the only line end, plus ``flags``."""
    return f"(?dU{flags}){pattern}"


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def tokens(text: Column) -> Column:
    """Lower-case words of any length, in order, with repeats."""
    return F.filter(F.split(F.lower(text), rules.TOKEN_SEPARATOR), lambda t: t != F.lit(""))


def count_tokens(text: Column) -> Column:
    """Estimated model tokens: characters over 3.5, at least 1."""
    return F.greatest(
        F.lit(1).cast("bigint"), F.floor(F.length(text) / F.lit(rules.BUDGET_CHARS_PER_TOKEN))
    )


def paragraphs(content: Column) -> Column:
    """Non-empty, trimmed blocks between blank lines."""
    return F.filter(
        F.transform(F.split(strip(content), "\n{2,}"), strip), lambda p: p != F.lit("")
    )


def _non_empty(pieces: Column, whole: Column) -> Column:
    kept = F.filter(F.transform(pieces, strip), lambda s: s != F.lit(""))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(strip(whole))))


def sentences_general(text: Column) -> Column:
    return _non_empty(F.split(text, jvm(rules.SENTENCE_GENERAL)), text)


def sentences_financial(text: Column) -> Column:
    """Like the general split, but never directly after a known abbreviation."""
    guard = rf"(?<!\b(?:{'|'.join(rules.ABBREVIATIONS)})[.!?])"
    # The cheap look-behind comes first; the guard is only tried after a full stop.
    after_stop = "(?<=[.!?])"
    boundary = rules.SENTENCE_GENERAL.replace(after_stop, after_stop + guard, 1)
    return _non_empty(F.split(text, jvm(boundary)), text)


def hard_cut(text: Column, max_chars: int, overlap: int) -> Column:
    """Slices of ``max_chars`` that start every ``max_chars - overlap``; stops at the end."""
    step = max(1, max_chars - overlap)
    count = F.when(F.length(text) <= max_chars, F.lit(0)).otherwise(
        F.ceil((F.length(text) - max_chars) / F.lit(step)).cast("int")
    )

    def from_steps(pieces: Column) -> Column:
        # One pass cuts the steps; a slice is a step and the begin of the steps after it.
        return F.transform(
            F.slice(pieces, F.lit(1), count + 1),
            lambda piece, i: strip(
                F.left(
                    F.concat(
                        piece,
                        *[
                            F.coalesce(F.get(pieces, i + j), F.lit(""))
                            for j in range(1, -(-max_chars // step))
                        ],
                    ),
                    F.lit(max_chars),
                )
            ),
        )

    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.filter(let(steps, from_steps), lambda s: s != F.lit(""))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n)) if n > 0 else F.lit("")


def windows(sentences: Column, max_chars: int, overlap: int) -> Column:
    """Pack sentences into windows of at most ``max_chars``.

    A new window starts with the last ``overlap`` characters of the one before
    when that still fits; a sentence above the limit is sliced.
    """

    def joined(carry: Column, sentence: Column) -> Column:
        with_carry = F.concat(carry, F.lit(" "), sentence)
        fits = (carry != F.lit("")) & (F.length(with_carry) <= max_chars)
        return F.when(fits, with_carry).otherwise(sentence)

    def carry_of(text: Column) -> Column:
        return lstrip(tail(text, overlap))

    def out(buf: Column, carry: Column, emit: Column) -> Column:
        return F.struct(
            F.struct(buf.alias("buf"), carry.alias("carry")).alias("state"), emit.alias("emit")
        )

    def step(state: Column, sentence: Column) -> Column:
        buf, carry = state["buf"], state["carry"]
        pending = F.when(buf != F.lit(""), F.array(buf)).otherwise(empty("string"))
        grown = F.concat(buf, F.lit(" "), sentence)
        return (
            F.when(
                F.length(sentence) > max_chars,
                out(
                    F.lit(""),
                    carry_of(sentence),
                    F.concat(pending, hard_cut(sentence, max_chars, overlap)),
                ),
            )
            .when(buf == F.lit(""), out(joined(carry, sentence), F.lit(""), empty("string")))
            .when(F.length(grown) <= max_chars, out(grown, F.lit(""), empty("string")))
            .otherwise(out(joined(carry_of(buf), sentence), F.lit(""), pending))
        )

    start = F.struct(F.lit("").alias("buf"), F.lit("").alias("carry"))
    return scan(
        sentences,
        start,
        step,
        "string",
        lambda s: F.when(s["buf"] != F.lit(""), F.array(s["buf"])).otherwise(empty("string")),
    )
