"""Clinical entities: extraction, offsets, span merging and span-safe sentences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions.arrays import empty, let, running_sums, scan

SPAN = "struct<start:bigint,end:bigint>"


def entity_patterns() -> list[str]:
    return [T.jvm(p, "i" if insensitive else "") for p, insensitive in rules.ENTITIES]


def extract_entities(text: Column, patterns: list[str] | None = None) -> Column:
    """Matches of all patterns in order, without case-insensitive repeats."""
    found = F.flatten(
        F.array(
            *[
                F.regexp_extract_all(text, F.lit(p), F.lit(0))
                for p in (patterns or entity_patterns())
            ]
        )
    )
    long_enough = F.filter(
        F.transform(found, T.strip), lambda e: F.length(e) >= rules.ENTITY_MIN_CHARS
    )
    # Sorted by lower-case form and place, equal ones lie side by side and the first leads.
    marked = F.sort_array(
        F.transform(
            long_enough,
            lambda e, i: F.struct(F.lower(e).alias("low"), i.alias("i"), e.alias("e")),
        )
    )

    def leaders(items: Column) -> Column:
        first = F.filter(
            items, lambda s, k: (k == 0) | (s["low"] != F.get(items, k - 1)["low"])
        )
        in_order = F.sort_array(F.transform(first, lambda s: F.struct(s["i"], s["e"])))
        return F.transform(in_order, lambda s: s["e"])

    return let(marked, leaders)


def has_dose(text: Column) -> Column:
    return text.rlike(entity_patterns()[0])


def _placed(gaps: Column, hits: Column) -> Column:
    """Offsets of the hits, given the texts in front of them (and what may follow the last hit)."""
    widths = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("bigint"))
    return let(
        running_sums(widths),
        lambda before: F.transform(
            hits,
            lambda h, i: let(
                F.get(before, i) + F.length(F.get(gaps, i)),
                lambda s: F.struct(
                    s.cast("bigint").alias("start"),
                    (s + F.length(h)).cast("bigint").alias("end"),
                ),
            ),
        ),
    )


def _matched(text: Column, pattern: str, body: Callable[[Column, Column], Column], none: Column) -> Column:
    """``body(texts around the matches, matches)``, or ``none`` without a match."""
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(
            F.size(hits) > 0, let(F.split(text, pattern), lambda parts: body(parts, hits))
        ).otherwise(none),
    )


def match_spans(text: Column, pattern: str) -> Column:
    """Character offsets of all matches: the gaps between them give the positions."""
    return _matched(text, pattern, _placed, empty(SPAN))


def merge_span_array(spans: Column) -> Column:
    """Union of overlapping or touching spans of one text."""

    def step(state: Column, s: Column) -> Column:
        joins = s["start"] <= state["end"]
        wider = F.struct(
            state["start"].alias("start"), F.greatest(state["end"], s["end"]).alias("end")
        )
        return F.when(
            state.isNotNull() & joins,
            F.struct(wider.alias("state"), empty(SPAN).alias("emit")),
        ).otherwise(
            F.struct(
                s.alias("state"),
                F.when(state.isNotNull(), F.array(state)).otherwise(empty(SPAN)).alias("emit"),
            )
        )

    return scan(
        F.sort_array(spans),
        F.lit(None).cast(SPAN),
        step,
        SPAN,
        lambda state: F.when(state.isNotNull(), F.array(state)).otherwise(empty(SPAN)),
    )


def entity_spans(text: Column, patterns: list[str] | None = None) -> Column:
    found = [match_spans(text, p) for p in (patterns or entity_patterns())]
    return merge_span_array(F.flatten(F.array(*found)))


def reaches_over(text: Column, patterns: list[str] | None = None) -> Column:
    """Can a match of any pattern hold a sentence boundary? It has white space first or after a full stop, then."""
    at_gap = T.jvm(r"(?:^|[.?!])\s")
    found = [
        F.exists(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda h: h.rlike(at_gap))
        for p in (patterns or entity_patterns())
    ]
    return reduce(Column.__or__, found)


def _outside(gaps: Column, spans: Column) -> Column:
    """For every gap, in order: does it begin outside all spans? The spans are sorted and apart.

    One pass over both in the order of their begins; only the last span that has begun can hold a gap.
    """
    at = lambda items, kind, end: F.transform(
        items, lambda x: F.struct(x["start"].alias("at"), F.lit(kind).alias("kind"), end(x).alias("end"))
    )
    none = F.lit(0).cast("bigint")
    events = F.sort_array(F.concat(at(spans, 0, lambda x: x["end"]), at(gaps, 1, lambda x: none)))

    def step(reach: Column, event: Column) -> Column:
        span = event["kind"] == 0
        return F.struct(
            F.when(span, event["end"]).otherwise(reach).alias("state"),
            F.when(span, empty("boolean")).otherwise(F.array(event["at"] >= reach)).alias("emit"),
        )

    return scan(events, none, step, "boolean")


def sentences_medical(text: Column, patterns: list[str] | None = None) -> Column:
    """Sentences whose boundaries do not fall inside an entity span.

    The text is split at all boundaries once; where a boundary lies in a span, the pieces on both
    sides are put together again, with what was between them. Only texts with a match that can hold
    a boundary need the places of matches.
    """
    boundary = T.jvm(rules.SENTENCE_MEDICAL)

    def rejoined(pieces: Column, gaps: Column, cuts: Column) -> Column:
        def step(held: Column, item: Column) -> Column:
            longer = F.concat(held, item["gap"], item["piece"])
            return F.struct(
                F.when(item["cut"], item["piece"]).otherwise(longer).alias("state"),
                F.when(item["cut"], F.array(T.strip(held))).otherwise(empty("string")).alias("emit"),
            )

        items = F.transform(
            gaps,
            lambda g, i: F.struct(
                F.get(cuts, i).alias("cut"), g.alias("gap"), F.get(pieces, i + 1).alias("piece")
            ),
        )
        return scan(items, F.get(pieces, F.lit(0)), step, "string", lambda held: F.array(T.strip(held)))

    def run(held: Column) -> Column:
        def with_gaps(pieces: Column, gaps: Column) -> Column:
            placed = let(
                _outside(_placed(pieces, gaps), entity_spans(held, patterns)),
                lambda cuts: rejoined(pieces, gaps, cuts),
            )
            return F.when(reaches_over(held, patterns), placed).otherwise(F.transform(pieces, T.strip))

        return _matched(held, boundary, with_gaps, F.array(T.strip(held)))

    return let(
        F.filter(let(text, run), lambda s: s != F.lit("")),
        lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(T.strip(text))),
    )


def merge_spans(
    spans: DataFrame, key: str = "document_id", start: str = "start", end: str = "end",
    block_chars: int = 65_536,
) -> DataFrame:
    """Union of overlapping or touching spans per document, over a span table.

    A document's positions are cut into blocks of ``block_chars``, and a block is the most
    that one task holds. How far earlier blocks reach, and where the stretch begins
    that is open at a block's border, are prefix maxima over one row per block; with
    both, each block tells its stretches alone, and parts of one stretch are added up by
    its start. A row without a start or an end is no span.
    """
    spans = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    blocked = spans.select(key, start, end).dropDuplicates()
    blocked = blocked.withColumn("_block", F.floor(F.col(start) / block_chars))
    earlier = (
        Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )

    def with_carry(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """Rows with the largest value of all earlier blocks of their document."""
        sums = rows.groupBy(key, "_block").agg(F.max(value).alias("_most"))
        carried = sums.select(
            F.col(key).alias("_key"), F.col("_block").alias("_number"), F.max("_most").over(earlier).alias(name)
        )
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_number"))
        return rows.join(carried, same).drop("_key", "_number")

    ordered = Window.partitionBy(key, "_block").orderBy(start, end)
    before = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.greatest(before, F.col("_far"))
    opens = F.when(reach.isNull() | (F.col(start) > reach), F.col(start))
    opened = with_carry(blocked, F.col(end), "_far").withColumn("_opens", opens)
    parts = (
        opened.withColumn("_open", F.max("_opens").over(upto))
        .groupBy(key, "_block", "_open")
        .agg(F.max(end).alias(end))
    )
    begun = F.coalesce("_open", "_begun").alias(start)
    return with_carry(parts, F.col("_open"), "_begun").groupBy(key, begun).agg(F.max(end).alias(end))
