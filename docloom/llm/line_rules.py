"""Line-first cleaning with DataFrame functions only.

Every line of a text is judged by itself: punctuation, symbols, shouting,
navigation and boilerplate. Lines that fail are removed, and a document that
loses too much of its text this way is rejected. Nothing is shuffled: a document
is one row, its words and lines are arrays of that row, and all work on them is
sorting and single passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base counts.
SEPARATORS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED = 50, 50
GRAM = 3

#: A sentence ends with one of these, closing quotes and brackets after it aside.
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Lines of sites and licences rather than of texts, in lower case.
BOILERPLATE = (
    r"all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|"
    r"we use cookies|accept (all )?cookies|enable javascript|copyright \(c\)|©|click here to|"
    r"subscribe to our|sign up for our|follow us on|share this (page|article|post)"
)
#: Several links side by side: parts between bars, angle quotes, bullets or arrows.
NAVIGATION = r"([|»›•→][^|»›•→]{0,40}){3,}"
#: Symbols (or doubled exclamation marks) per hundred characters of a line.
MOST_SYMBOLS = 5
#: Share of its text, in percent of characters, that a document may lose.
MOST_LOST = 50


def _is_wordy(line: Column) -> Column:
    return line.rlike(WORD)


def failing(line: Column) -> Column:
    """Does a line with words break a rule?"""
    symbols = F.regexp_count(line, F.lit(SYMBOLS + "|!!"))
    shouting = (F.length(line) > 20) & (line == F.upper(line)) & (line != F.lower(line))
    return (
        ~line.rlike(SENTENCE_END)
        | (symbols * 100 > F.length(line) * MOST_SYMBOLS)
        | shouting
        | line.rlike(NAVIGATION)
        | F.lower(line).rlike(BOILERPLATE)
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, ``base_failed``, ``kept`` and ``cleaned`` (the text of the lines left).

    Columns of these names are replaced, all others kept. A null text has no words
    and fails the base rule, as an empty one does; an empty table stays empty.
    """
    held = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    held = held.withColumn("_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)))
    held = held.withColumn("_lines", F.filter(F.split("_text", "\n"), _is_wordy))
    held = held.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.expr(
                f"if(size(_words) < {GRAM}, cast(array() as array<struct<h: bigint, i: int>>), "
                f"sort_array(transform(sequence(0, greatest(size(_words), {GRAM}) - {GRAM}), i -> "
                "named_struct('h', xxhash64("
                + ", ".join(f"get(_words, i + {j})" for j in range(GRAM))
                + "), 'i', i))))"
            ),
            "_left": F.filter("_lines", lambda x: ~failing(x)),
        }
    )
    held = held.withColumn(
        "_places",
        F.expr(
            "sort_array(filter(transform(_sorted, (s, k) -> "
            "if(s.h = get(_sorted, k - 1).h or s.h = get(_sorted, k + 1).h, s.i, -1)), p -> p >= 0))"
        ),
    )
    held = held.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(_places, named_struct('n', 0L, 'reach', 0), (a, p) -> "
            f"named_struct('n', a.n + {GRAM} - greatest(0, a.reach - p), 'reach', p + {GRAM}), a -> a.n)"
        ),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    chars = {c: F.length(F.array_join(c, "")) for c in ("_left", "_lines")}
    enough = 100 * chars["_left"] >= (100 - MOST_LOST) * chars["_lines"]
    return (
        held.withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & enough)
        .withColumn("cleaned", F.array_join("_left", "\n"))
        .drop("_text", "_words", "_lines", "_sorted", "_places", "_left")
    )
