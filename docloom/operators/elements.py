"""From raw content to typed elements, and to the units that become chunks.

All of this is array work inside one document row; see ``functions.arrays``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions.arrays import built_once, empty, let, scan

ELEMENT = "struct<kind:string,text:string,page:int>"
JSON_ELEMENTS = (
    "array<struct<type:string,text:string,"
    "metadata:struct<page_number:int,text_as_html:string>>>"
)
UNIT = (
    "struct<kind:string,text:string,section:string,section_raw:string,page:int>"
)


def at_start(pattern: str, flags: str = "") -> str:
    """A pattern that must match at the very start of the text."""
    return T.jvm(rf"\A(?:{pattern})", flags + "m")


def general_kind(paragraph: Column) -> Column:
    return (
        F.when(paragraph.rlike(at_start(rules.HEADER_GENERAL)), "header")
        .when(paragraph.rlike(at_start(rules.LIST_GENERAL)), "list")
        .otherwise("narrative")
    )


def financial_kind(paragraph: Column) -> Column:
    pipes = F.length(paragraph) - F.length(F.replace(paragraph, F.lit("|"), F.lit("")))
    return (
        F.when(paragraph.rlike(at_start(rules.HEADER_FINANCIAL, "i")), "header")
        .when(paragraph.rlike(at_start(rules.FOOTNOTE_FINANCIAL)), "footnote")
        .when(pipes >= rules.TABLE_MIN_PIPES, "table")
        .when(paragraph.rlike(at_start(rules.LIST_FINANCIAL)), "list")
        .otherwise("narrative")
    )


def medical_kind(paragraph: Column) -> Column:
    return (
        F.when(paragraph.rlike(at_start(rules.HEADER_MEDICAL)), "header")
        .when(paragraph.rlike(at_start(rules.LIST_MEDICAL)), "list")
        .otherwise("narrative")
    )


KINDS = {"general": general_kind, "financial": financial_kind, "medical": medical_kind}


def _element(kind: Column, text: Column, page: Column | None = None) -> Column:
    page = F.lit(None).cast("int") if page is None else page
    return F.struct(kind.alias("kind"), text.alias("text"), page.alias("page"))


def plain_elements(content: Column, domain: str) -> Column:
    """Typed elements of plain text; medical lists become one element per item."""
    blocks = T.paragraphs(content)
    if domain != "medical":
        return F.transform(blocks, lambda p: _element(KINDS[domain](p), p))

    def split_items(p: Column) -> Column:
        items = F.filter(
            F.transform(F.split(p, T.jvm(rules.LIST_ITEM_BREAK)), T.strip),
            lambda item: item != F.lit(""),
        )
        return let(
            medical_kind(p),
            lambda kind: F.when(
                kind == "list", F.transform(items, lambda item: _element(kind, item))
            ).otherwise(F.array(_element(kind, p))),
        )

    return F.flatten(F.transform(blocks, split_items))


def json_elements(content: Column, domain: str) -> Column:
    """Typed elements of parsed-element JSON; NULL when the JSON is not usable."""
    kinds = F.create_map(*[F.lit(v) for v in chain(*rules.ELEMENT_KINDS[domain].items())])
    parsed = F.from_json(content, JSON_ELEMENTS, {"mode": "PERMISSIVE"})

    def typed(e: Column) -> Column:
        kind = F.coalesce(
            F.try_element_at(kinds, F.coalesce(e["type"], F.lit("UncategorizedText"))),
            F.lit("narrative"),
        )
        text = F.coalesce(e["text"], F.lit(""))
        if domain == "financial":
            from docloom.operators.tables import html_table_to_pipe

            html = e["metadata"]["text_as_html"]
            text = F.when(
                (kind == "table") & (html != ""), F.coalesce(html_table_to_pipe(html), text)
            ).otherwise(text)
        else:
            text = T.strip(text)
        return _element(kind, text, e["metadata"]["page_number"])

    # Broken JSON is NULL as a whole; an element that is no object is NULL in its place.
    return let(
        parsed,
        lambda es: F.when(~F.exists(es, lambda e: e.isNull()), F.transform(es, typed)),
    )


def elements(content: Column, domain: str) -> Column:
    """JSON elements when the content opens with ``[`` and parses, else plain text."""
    opens = F.startswith(T.lstrip(content), F.lit("["))
    return F.coalesce(
        F.when(opens, json_elements(content, domain)), plain_elements(content, domain)
    )


def clinical_section(text: Column) -> Column:
    """First matching section label."""
    (first, label), *rest = rules.SECTIONS
    found = F.when(text.rlike(T.jvm(first, "i")), label)
    for pattern, name in rest:
        found = found.when(text.rlike(T.jvm(pattern, "i")), name)
    return found.otherwise(rules.SECTION_DEFAULT)


def units(items: Column, domain: str, chunk_chars: int | None = None) -> Column:
    """Group elements into the units that are chunked together.

    Running text is gathered until it reaches ``chunk_chars``; headers, tables,
    medical list items and free-standing footnotes close the gathered text and
    stand alone. Each unit carries the section in force. A footnote after a
    table is tagged ``attached`` and joined to that table afterwards.
    """
    limit = chunk_chars or rules.CHUNK_CHARS[domain]
    glue = "\n" if domain == "general" else " "
    null = F.lit(None).cast("string")

    def unit(kind: Column, text: Column, state: Column, page: Column) -> Column:
        return F.struct(
            kind.alias("kind"),
            text.alias("text"),
            state["section"].alias("section"),
            state["section_raw"].alias("section_raw"),
            page.alias("page"),
        )

    def gathered(state: Column) -> Column:
        return F.when(
            state["open"], F.array(unit(F.lit("narrative"), state["buf"], state, state["page"]))
        ).otherwise(empty(UNIT))

    def to_state(buf, size, is_open, page, section, section_raw, table_seen) -> Column:
        return F.struct(
            buf.alias("buf"),
            size.alias("size"),
            is_open.alias("open"),
            page.alias("page"),
            section.alias("section"),
            section_raw.alias("section_raw"),
            table_seen.alias("table_seen"),
        )

    def cleared(state: Column, table_seen: Column) -> Column:
        return to_state(
            F.lit(""), F.lit(0), F.lit(False), F.lit(None).cast("int"),
            state["section"], state["section_raw"], table_seen,
        )

    def result(state: Column, emit: Column) -> Column:
        return F.struct(state.alias("state"), emit.alias("emit"))

    def step(state: Column, e: Column) -> Column:
        kind, text = e["kind"], e["text"]
        is_header = kind == "header"
        label = clinical_section(text) if domain == "medical" else T.strip(text)
        raw = text if domain == "medical" else null
        headed = to_state(
            F.lit(""), F.lit(0), F.lit(False), F.lit(None).cast("int"),
            label, raw, state["table_seen"],
        )
        grown = to_state(
            F.when(state["open"], F.concat(state["buf"], F.lit(glue), text)).otherwise(text),
            state["size"] + F.length(text),
            F.lit(True),
            F.coalesce(state["page"], e["page"]),
            state["section"],
            state["section_raw"],
            state["table_seen"],
        )
        own = F.array(unit(kind, text, state, e["page"]))
        flow = F.when(
            is_header,
            let(
                headed,
                lambda h: result(
                    h, F.concat(gathered(state), F.array(unit(kind, text, h, e["page"])))
                ),
            ),
        )
        if domain == "financial":
            flow = flow.when(
                kind == "table",
                result(cleared(state, F.lit(True)), F.concat(gathered(state), own)),
            )
            flow = flow.when(
                (kind == "footnote") & state["table_seen"],
                result(state, F.array(unit(F.lit("attached"), text, state, e["page"]))),
            )
            flow = flow.when(
                kind == "footnote",
                result(cleared(state, state["table_seen"]), F.concat(gathered(state), own)),
            )
        if domain == "medical":
            flow = flow.when(
                kind == "list",
                result(cleared(state, state["table_seen"]), F.concat(gathered(state), own)),
            )
        return flow.otherwise(
            let(
                grown,
                lambda g: F.when(
                    g["size"] >= limit, result(cleared(g, g["table_seen"]), gathered(g))
                ).otherwise(result(g, empty(UNIT))),
            )
        )

    first_section = F.lit(rules.SECTION_DEFAULT) if domain == "medical" else null
    start = to_state(
        F.lit(""), F.lit(0), F.lit(False), F.lit(None).cast("int"),
        first_section, null, F.lit(False),
    )
    return scan(items, start, step, UNIT, gathered)


def attach_footnotes(unit_array: Column) -> Column:
    """Join every ``attached`` footnote to the last table before it.

    The array is cut at its tables; inside each stretch the notes are appended
    to the table's ``notes`` and removed from the flow.
    """

    def run(held: Column) -> Column:
        table_at = F.filter(
            F.transform(held, lambda u, i: F.when(u["kind"] == "table", i)),
            lambda i: i.isNotNull(),
        )
        starts = let(
            table_at,
            lambda t: F.when(F.try_element_at(t, F.lit(1)) == 0, t).otherwise(
                F.concat(F.array(F.lit(0)), t)
            ),
        )
        ends = lambda s, j: F.coalesce(F.try_element_at(s, j + 2), F.size(held))

        def stretch(piece: Column) -> Column:
            notes = F.array_join(
                F.transform(
                    F.filter(piece, lambda u: u["kind"] == "attached"),
                    lambda u: F.concat(F.lit("\n"), u["text"]),
                ),
                "",
            )
            return let(
                notes,
                lambda n: F.transform(
                    F.filter(piece, lambda u: u["kind"] != "attached"),
                    lambda u: u.withField(
                        "notes", F.when(u["kind"] == "table", n).otherwise(F.lit(""))
                    ),
                ),
            )

        return F.when(
            F.size(held) > 0,
            F.flatten(
                let(
                    starts,
                    lambda s: F.transform(
                        s,
                        lambda at, j: let(
                            F.slice(held, at + 1, ends(s, j) - at), stretch
                        ),
                    ),
                )
            ),
        ).otherwise(F.transform(held, lambda u: u.withField("notes", F.lit(""))))

    return let(unit_array, run)


@built_once
def document_elements(domain: str, content: str = "content") -> Column:
    return elements(T.unix_lines(F.col(content)), domain)


@built_once
def document_units(domain: str, content: str = "content") -> Column:
    """Units of a document column; for financial text with footnotes at their tables."""
    gathered = units(document_elements(domain, content), domain)
    return attach_footnotes(gathered) if domain == "financial" else gathered
