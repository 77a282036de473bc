"""Pipe tables and HTML tables as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions.arrays import let

PIECE = "struct<text:string,row_range:string>"


def pipe_rows(text: Column) -> Column:
    """Cells of the lines that start with ``|``; NULL with fewer than two such lines."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), T.strip), lambda line: F.startswith(line, F.lit("|"))
    )

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), T.strip)

    def is_separator(row: Column) -> Column:
        return F.forall(row, lambda c: (c == "") | c.rlike(rules.TABLE_SEPARATOR_CELL))

    rows = lambda ls: F.filter(F.transform(ls, cells), lambda r: ~is_separator(r))
    return let(
        lines,
        lambda ls: F.when(
            F.size(ls) >= 2, let(rows(ls), lambda rs: F.when(F.size(rs) >= 1, rs))
        ),
    )


def render_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def render_rows(rows: Column) -> Column:
    """Rows as a pipe table with a rule line under the first row."""
    rule = lambda row: render_row(F.transform(row, lambda _c: F.lit("---")))
    return F.array_join(
        F.flatten(
            F.transform(
                rows,
                lambda row, i: F.when(i == 0, F.array(render_row(row), rule(row))).otherwise(
                    F.array(render_row(row))
                ),
            )
        ),
        "\n",
    )


def split_table(text: Column, max_chars: int = rules.MAX_TABLE_CHARS) -> Column:
    """Pieces of a table: whole when small, else row windows that repeat the header."""

    def whole(rows: Column) -> Column:
        top = F.when(
            F.size(rows) > 0, F.concat(F.lit("0-"), (F.size(rows) - 1).cast("string"))
        )
        return F.array(F.struct(text.alias("text"), top.alias("row_range")))

    def cut(rows: Column) -> Column:
        def by_windows(data: Column) -> Column:
            chars = F.aggregate(
                data,
                F.lit(0),
                lambda total, row: total + F.length(F.array_join(row, " | ")),
            )
            average = F.greatest(F.lit(1), F.floor(chars / F.size(data)).cast("int"))
            per_chunk = F.greatest(F.lit(1), F.floor(F.lit(max_chars) / average).cast("int"))

            def windows(n: Column) -> Column:
                return F.transform(
                    F.sequence(F.lit(0), F.floor((F.size(data) - 1) / n).cast("int")),
                    lambda i: let(
                        F.slice(data, i * n + 1, n),
                        lambda w: F.struct(
                            render_rows(F.concat(F.slice(rows, 1, 1), w)).alias("text"),
                            F.concat_ws(
                                "-",
                                (i * n + 1).cast("string"),
                                (i * n + F.size(w)).cast("string"),
                            ).alias("row_range"),
                        ),
                    ),
                )

            return let(per_chunk, windows)

        data = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        return let(data, by_windows)

    return let(
        pipe_rows(text),
        lambda rows: F.when(
            (F.length(text) <= max_chars) | rows.isNull() | (F.size(rows) < 2), whole(rows)
        ).otherwise(cut(rows)),
    )


def _entities(text: Column) -> Column:
    for code, char in (
        ("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"),
        ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def html_rows(html: Column) -> Column:
    """Cell texts of every ``<tr>`` that holds at least one cell."""
    row_bodies = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))

    def cell_text(cell: Column) -> Column:
        pieces = F.filter(F.split(cell, "(?s)<[^>]*>"), lambda p: p != F.lit(""))
        return T.strip(F.array_join(F.transform(pieces, lambda p: T.strip(_entities(p))), " "))

    def cells(body: Column) -> Column:
        found = F.regexp_extract_all(
            body, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)
        )
        return F.transform(found, cell_text)

    return F.filter(F.transform(row_bodies, cells), lambda row: F.size(row) > 0)


def html_table_to_pipe(html: Column) -> Column:
    """HTML table as a pipe table; NULL when it has no rows."""
    return let(html_rows(html), lambda rows: F.when(F.size(rows) > 0, render_rows(rows)))
