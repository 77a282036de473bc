"""SQL twins of the registered queries, for checking results with DuckDB.

They are written independently of the Spark jobs: relational where the jobs use
array expressions, recursive where the jobs fold.
"""

from __future__ import annotations

from docloom import rules
from docloom.functions.guards import injection_message

ORACLES: dict[str, str] = {}

_SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    """A stated pattern in RE2 syntax with Unicode white space and digits."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
        elif pair == r"\S":
            out.append(f"[^{_SPACE}]")
        elif pair == r"\d":
            out.append(r"\p{Nd}")
        elif pair == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else r"[\p{L}\p{N}_]")
        elif pair[0] == "\\":
            out.append(pair)
        else:
            in_class = True if pair[0] == "[" else False if pair[0] == "]" else in_class
            out.append(pair[0])
            i += 1
            continue
        i += 2
    return lit((f"(?{flags})" if flags else "") + "".join(out))


def start(pattern: str, flags: str = "") -> str:
    return re2(rf"\A(?:{pattern})", flags + "m")


WS = lit(rules.WHITESPACE)
NL = "chr(10)"
DOMAIN = "CASE lang WHEN 'en' THEN 'financial' WHEN 'de' THEN 'medical' ELSE 'general' END"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


RAW = f"""docs AS (SELECT doc_id, 'doc-' || doc_id AS document_id, {DOMAIN} AS domain, source,
  text AS content FROM documents)"""

_SHAPES = [
    "'ASSESSMENT AND PLAN:\n\n' || p",
    "'- ' || replace(p, '. ', '.\n- ')",
    "'Item 7A. Market Risk\n\n' || p",
    "'| term | chars |\n| --- | :---: |\n' || array_to_string(list_transform(string_split(p, '. '),"
    " lambda s: '| ' || s || ' | ' || length(s) || ' |'), '\n')",
    "'(1) ' || p",
    "p",
    "'## Medications & Dosage\n\n- Metformin 500 mg twice daily\n- ' || p || '\n• aspirin 81 mg'",
    "'HbA1c 7.2% and eGFR 45 mL/min were noted. ' || p || ' Dr. Smith saw No. 5. Inc. Reports follow.'",
    "'1. Chief Complaint\n\n' || p",
    "p || ' Type 2 Diabetes Mellitus (E11.9), BRCA1 and hba1c 7.2% again.'",
]
_CASES = " ".join(f"WHEN {n} THEN {s}" for n, s in enumerate(_SHAPES))
STRUCTURED = f"""docs AS (SELECT doc_id, 'doc-' || doc_id AS document_id, {DOMAIN} AS domain, source,
  array_to_string(list_transform(string_split(text, {NL}),
    lambda p, i: CASE (i - 1) % 10 {_CASES} END), '\n\n') AS content FROM documents)"""


def paras(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({strip(x)}, '\\n{{2,}}'),"
        f" lambda y: {strip('y')}), lambda y: y <> '')"
    )


def explode(source: str, keys: str, expr: str, item: str, pos: str = "pos") -> str:
    return (
        f"SELECT {keys}, i AS {pos}, l[i + 1] AS {item} FROM (SELECT {keys}, {expr} AS l"
        f" FROM {source}), unnest(range(len(l))) t(i)"
    )


KIND = {
    "general": f"""CASE WHEN regexp_matches(t, {start(rules.HEADER_GENERAL)}) THEN 'header'
  WHEN regexp_matches(t, {start(rules.LIST_GENERAL)}) THEN 'list' ELSE 'narrative' END""",
    "financial": f"""CASE WHEN regexp_matches(t, {start(rules.HEADER_FINANCIAL, "i")}) THEN 'header'
  WHEN regexp_matches(t, {start(rules.FOOTNOTE_FINANCIAL)}) THEN 'footnote'
  WHEN length(t) - length(replace(t, '|', '')) > 4 THEN 'table'
  WHEN regexp_matches(t, {start(rules.LIST_FINANCIAL)}) THEN 'list' ELSE 'narrative' END""",
    "medical": f"""CASE WHEN regexp_matches(t, {start(rules.HEADER_MEDICAL)}) THEN 'header'
  WHEN regexp_matches(t, {start(rules.LIST_MEDICAL)}) THEN 'list' ELSE 'narrative' END""",
}


def sections(t: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({t}, {re2(p, 'i')}) THEN {lit(name)}" for p, name in rules.SECTIONS
    )
    return f"CASE {cases} ELSE 'General' END"


def elements(domain: str, p: str = "") -> str:
    """CTEs up to ``el`` with ``doc_id, pos, kind, t``."""
    base = explode(f"{p}docs", "doc_id", paras("content"), "t")
    if domain != "medical":
        return f"{p}el AS (SELECT doc_id, pos, t, {KIND[domain]} AS kind FROM ({base}))"
    mark = re2(r"\n(\s*[-•·*])")
    return f"""{p}pa AS (SELECT doc_id, pos AS para, t, {KIND[domain]} AS kind FROM ({base})),
{p}it AS (SELECT doc_id, para, kind, CASE WHEN kind = 'list' THEN
    list_filter(list_transform(string_split(regexp_replace(t, {mark}, chr(1) || '\\1', 'g'), chr(1)),
      lambda y: {strip("y")}), lambda y: y <> '') ELSE [t] END AS l FROM {p}pa),
{p}el AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, i) - 1 AS pos, kind,
    l[i + 1] AS t FROM {p}it, unnest(range(len(l))) u(i))"""


def units(domain: str, p: str = "") -> str:
    """CTEs from ``el`` to ``un`` with ``doc_id, g, kind, t, section, section_raw, notes``."""
    limit = rules.CHUNK_CHARS[domain]
    glue = "chr(10)" if domain == "general" else "' '"
    breaks = {
        "general": "kind = 'header'",
        "financial": "kind IN ('header', 'table', 'footnote')",
        "medical": "kind IN ('header', 'list')",
    }[domain]
    label = sections("t") if domain == "medical" else strip("t")
    raw = "t" if domain == "medical" else "NULL"
    first = "'General'" if domain == "medical" else "NULL"
    table_before = (
        "max(CASE WHEN kind = 'table' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    after = "CASE WHEN f.closed THEN 0 ELSE f.size END + length(e.t)"
    return f"""{p}tb AS (SELECT *, {table_before} AS tpos FROM {p}el),
{p}e2 AS (SELECT doc_id, pos, kind, t, {breaks} AS brk,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM {p}tb WHERE NOT (kind = 'footnote' AND tpos IS NOT NULL)),
{p}fl(doc_id, n, g, size, closed) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM {p}e2
  UNION ALL
  SELECT e.doc_id, e.n, f.g + CASE WHEN f.closed OR e.brk THEN 1 ELSE 0 END,
    CASE WHEN e.brk THEN 0 ELSE {after} END, e.brk OR {after} >= {limit}
  FROM {p}fl f JOIN {p}e2 e ON e.doc_id = f.doc_id AND e.n = f.n + 1),
{p}gr AS (SELECT e.doc_id, f.g, min(e.pos) AS pos,
    CASE WHEN bool_or(brk) THEN max(kind) ELSE 'narrative' END AS kind,
    string_agg(t, {glue} ORDER BY e.pos) AS t
  FROM {p}fl f JOIN {p}e2 e ON e.doc_id = f.doc_id AND e.n = f.n GROUP BY e.doc_id, f.g),
{p}no AS (SELECT doc_id, tpos, string_agg(chr(10) || t, '' ORDER BY pos) AS notes
  FROM {p}tb WHERE kind = 'footnote' AND tpos IS NOT NULL GROUP BY doc_id, tpos),
{p}un AS (SELECT gr.doc_id, g, kind, t,
    coalesce(last_value(CASE WHEN kind = 'header' THEN {label} END IGNORE NULLS) OVER w, {first}) AS section,
    last_value(CASE WHEN kind = 'header' THEN {raw} END IGNORE NULLS) OVER w AS section_raw,
    CASE WHEN kind = 'table' THEN coalesce(notes, '') ELSE '' END AS notes
  FROM {p}gr gr LEFT JOIN {p}no no ON no.doc_id = gr.doc_id AND no.tpos = gr.pos
  WINDOW w AS (PARTITION BY gr.doc_id ORDER BY g))"""


def sentence_list(domain: str, t: str) -> str:
    follow = r"[A-Z\"(]" if domain == "medical" else r"[A-Z\"'(]"
    marked = f"regexp_replace({t}, {re2(rf'([.!?])(\s+)({follow})')}, '\\1\\2' || chr(1) || '\\3', 'g')"
    if domain == "financial":
        names = "|".join(rules.ABBREVIATIONS)
        guard = re2(rf"(^|[^\p{{L}}\p{{N}}_])({names})([.!?])(\s+)").replace("'", "", 1)[:-1]
        marked = f"regexp_replace({marked}, '{guard}\x01', '\\1\\2\\3\\4', 'g')"
    pieces = f"list_transform(string_split({marked}, chr(1)), lambda y: {strip('y')})"
    return f"list_filter({pieces}, lambda y: y <> '')"


def cut_list(t: str, size: int, overlap: int) -> str:
    step = size - overlap
    n = f"CASE WHEN length({t}) <= {size} THEN 1 ELSE 1 + ceil((length({t}) - {size}) / {step}.0)::BIGINT END"
    return (
        f"list_filter(list_transform(range({n}), lambda k:"
        f" {strip(f'substring({t}, k * {step} + 1, {size})')}), lambda y: y <> '')"
    )


def pack(source: str, keys: str, domain: str, size: int, p: str = "") -> str:
    """CTEs ``sl``, ``pk`` and ``wi`` (keys, piece, w) over ``source`` with column ``t``."""
    overlap = rules.CHUNK_OVERLAP
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k} = f.{k}" for k in ks)
    f_keys = ", ".join(f"f.{k}" for k in ks)
    carry = f"ltrim(right(f.buf, {overlap}), {WS})"

    def joined(c: str) -> str:
        return (
            f"CASE WHEN {c} <> '' AND length({c}) + 1 + length(x) <= {size} THEN {c} || ' ' || x ELSE x END"
        )

    buf = f"""CASE WHEN length(x) > {size} THEN '' WHEN f.buf = '' THEN {joined("f.carry")}
      WHEN length(f.buf) + 1 + length(x) <= {size} THEN f.buf || ' ' || x ELSE {joined(carry)} END"""
    out = f"""CASE WHEN length(x) > {size} THEN
        list_concat(CASE WHEN f.buf <> '' THEN [f.buf] ELSE []::VARCHAR[] END, {cut_list("x", size, overlap)})
      WHEN f.buf <> '' AND length(f.buf) + 1 + length(x) > {size} THEN [f.buf] ELSE []::VARCHAR[] END"""
    next_carry = f"CASE WHEN length(x) > {size} THEN ltrim(right(x, {overlap}), {WS}) ELSE '' END"
    return f"""{p}sl AS (SELECT {keys}, {sentence_list(domain, "t")} AS l FROM {source}),
{p}pk AS (SELECT {keys}, 0::BIGINT AS i, '' AS buf, '' AS carry, []::VARCHAR[] AS o FROM {p}sl
  UNION ALL
  SELECT {f_keys}, f.i + 1, {buf}, {next_carry}, {out}
  FROM (SELECT f.*, s.l[f.i + 1] AS x FROM {p}pk f JOIN {p}sl s ON {same} WHERE f.i < len(s.l)) f),
{p}wo AS (SELECT {keys}, i, o FROM {p}pk
  UNION ALL
  SELECT {f_keys}, f.i + 1, [f.buf] FROM {p}pk f JOIN {p}sl s ON {same} WHERE f.i = len(s.l) AND f.buf <> ''),
{p}wi AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i, j) AS piece, o[j] AS w
  FROM {p}wo, unnest(range(1, len(o) + 1)) u(j))"""


def pipe_rows(t: str) -> str:
    lines = (
        f"list_filter(list_transform(string_split({t}, {NL}), lambda y: {strip('y')}),"
        " lambda y: starts_with(y, '|'))"
    )
    cells = f"list_transform(string_split(trim(y, '|'), '|'), lambda c: {strip('c')})"
    rows = (
        f"list_filter(list_transform(ls, lambda y: {cells}),"
        " lambda r: len(list_filter(r, lambda c: c <> '' AND NOT regexp_full_match(c, ':?-+:?'))) > 0)"
    )
    return f"(SELECT CASE WHEN len(ls) >= 2 AND len({rows}) >= 1 THEN {rows} END FROM (SELECT {lines} AS ls))"


def pieces(source: str, keys: str, p: str = "", size: int = rules.MAX_TABLE_CHARS) -> str:
    """CTE ``tp`` (keys, piece_no, text, row_range) over tables ``t`` in ``source``."""
    row = "'| ' || array_to_string(r, ' | ') || ' |'"
    return f"""{p}tr AS (SELECT {keys}, t, {pipe_rows("t")} AS rows FROM {source}),
{p}ts AS (SELECT *, len(rows) - 1 AS n, length(t) > {size} AND coalesce(len(rows), 0) >= 2 AS cut FROM {p}tr),
{p}tw AS (SELECT *, greatest(1, {size} // greatest(1,
    list_sum(list_transform(rows[2:], lambda r: length(array_to_string(r, ' | '))))::BIGINT // n)) AS k
  FROM {p}ts WHERE cut),
{p}tp AS (SELECT {keys}, 0 AS piece_no, t AS text,
    CASE WHEN len(rows) > 0 THEN '0-' || n END AS row_range FROM {p}ts WHERE NOT cut
  UNION ALL
  SELECT {keys}, b, array_to_string(list_concat(
      [{row.replace("r,", "rows[1],")}, '| ' || array_to_string(list_transform(rows[1], lambda r: '---'), ' | ') || ' |'],
      list_transform(rows[b * k + 2 : least(b * k + k, n) + 1], lambda r: {row})), {NL}),
    (b * k + 1) || '-' || least(b * k + k, n)
  FROM {p}tw, unnest(range((n - 1) // k + 1)) u(b))"""


def entity_list(t: str) -> str:
    found = ", ".join(
        f"regexp_extract_all({t}, {re2(pattern, 'i' if fold else '')})"
        for pattern, fold in rules.ENTITIES
    )
    kept = (
        f"list_filter(list_transform(flatten([{found}]), lambda e: {strip('e')}),"
        " lambda e: length(e) > 2)"
    )
    return (
        "(SELECT list_filter(l, lambda e, i: list_position(list_transform(l, lambda x: lower(x)),"
        f" lower(e)) = i) FROM (SELECT {kept} AS l))"
    )


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{rules.CHUNK_ID_NAMESPACE.replace('-', '')}') || encode({name}))"
    nibble = "substr('89ab', (('0x' || substr(h, 17, 1))::BIGINT & 3) + 1, 1)"
    return (
        "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
        f"{nibble} || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"
    )


def chunks(domain: str, p: str = "") -> str:
    """CTEs from ``docs`` to ``ch``: the chunk table of one domain's chunker."""
    size = rules.CHUNK_CHARS[domain]
    cap = rules.HARD_CAP_CHARS
    parts = [
        f"SELECT u.doc_id, u.g, piece, 'narrative' AS chunk_type, w AS text, section, section_raw,"
        f" NULL::VARCHAR AS table_id, NULL::VARCHAR AS row_range FROM {p}un u JOIN {p}wi w"
        f" ON w.doc_id = u.doc_id AND w.g = u.g",
        f"SELECT doc_id, g, j AS piece, kind, l[j], section, section_raw, NULL, NULL FROM"
        f" (SELECT *, {cut_list('t', cap, rules.CHUNK_OVERLAP)} AS l FROM {p}un WHERE kind = 'header'),"
        f" unnest(range(1, len(l) + 1)) v(j)",
    ]
    extra = ""
    if domain == "financial":
        extra = ",\n" + pieces(f"(SELECT doc_id, g, t FROM {p}un WHERE kind = 'table')", "doc_id, g", p)
        last = f"max(piece_no) OVER (PARTITION BY tp.doc_id, tp.g)"  # noqa: F541
        parts.append(
            f"SELECT tp.doc_id, tp.g, piece_no, 'table', {strip('tp.text')} ||"
            f" CASE WHEN piece_no = {last} THEN notes ELSE '' END, section, section_raw,"
            f" substr(sha256('doc-' || tp.doc_id || chr(10) || u.place || chr(10) || u.t), 1, 32), row_range"
            f" FROM {p}tp tp JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS place FROM {p}un) u"
            f" ON u.doc_id = tp.doc_id AND u.g = tp.g"
        )
        parts.append(
            f"SELECT doc_id, g, 0, kind, {strip('t')}, section, section_raw, NULL, NULL"
            f" FROM {p}un WHERE kind = 'footnote'"
        )
    if domain == "medical":
        dose = re2(rules.ENTITIES[0][0], "i")
        parts.append(
            f"SELECT doc_id, g, 0, CASE WHEN section = {lit(rules.SECTION_MEDICATIONS)} OR"
            f" regexp_matches(t, {dose}) THEN 'medication' ELSE 'list' END, {strip('t')}, section,"
            f" section_raw, NULL, NULL FROM {p}un WHERE kind = 'list'"
        )
    narrative = f"(SELECT doc_id, g, t FROM {p}un WHERE kind = 'narrative')"
    return f"""{elements(domain, p)},
{units(domain, p)},
{pack(narrative, "doc_id, g", domain, size, p)}{extra},
{p}pc AS ({" UNION ALL ".join(parts)}),
{p}ch AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, piece) - 1 AS chunk_index FROM {p}pc)"""


def tokens(t: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'),"
        " lambda w: w <> '')"
    )


def dense(source: str, key: str, t: str, name: str, width: int = 384) -> str:
    return f"""{name} AS (SELECT {key}, b, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v
  FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {width} AS b, count(*)::DOUBLE AS n
    FROM (SELECT {key}, unnest({tokens(t)}) AS w FROM {source}) GROUP BY ALL))"""


def sparse(source: str, key: str, t: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, w AS token, ln(1 + count(*)) AS v
  FROM (SELECT {key}, unnest({tokens(t)}) AS w FROM {source}) GROUP BY ALL)"""


SEARCH = f"""{RAW},
c AS (SELECT d.doc_id, document_id AS chunk_id, 'set-' || source AS document_id, domain,
  CASE quality WHEN 1 THEN 'public' WHEN 0 THEN 'internal' ELSE 'restricted' END AS acl,
  CASE WHEN toxic = 1 THEN 'table' ELSE 'narrative' END AS chunk_type, source, content AS text
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id),
q AS (SELECT item_id AS query_id, text AS query,
  CASE item_id % 5 WHEN 0 THEN 'financial' WHEN 4 THEN '' END AS q_domain,
  CASE WHEN item_id % 5 = 1 THEN 'set-src' || item_id % 20 END AS q_document,
  CASE item_id % 5 WHEN 2 THEN ['public', 'internal'] WHEN 4 THEN [] END AS q_acl,
  CASE WHEN item_id % 5 = 3 THEN ['table'] END AS q_types,
  CASE WHEN item_id % 5 = 3 THEN 7 ELSE 20 END AS k FROM benchmark),
cand AS (SELECT query_id, chunk_id, k FROM q, c
  WHERE (coalesce(q_domain, '') = '' OR q_domain = domain)
    AND (q_document IS NULL OR q_document = document_id)
    AND (coalesce(len(q_acl), 0) = 0 OR list_contains(q_acl, acl))
    AND (coalesce(len(q_types), 0) = 0 OR list_contains(q_types, chunk_type)))"""


def hits(cand: str = "cand", c: str = "c") -> str:
    """CTEs ``dh`` and ``sh``: dense and sparse winners."""
    return f"""{dense(c, "chunk_id", "text", "cd")}, {dense("q", "query_id", "query", "qd")},
ds AS (SELECT query_id, chunk_id, sum(qd.v * cd.v) AS s FROM qd JOIN cd USING (b) GROUP BY ALL),
{winners(cand, c)}"""


def winners(cand: str = "cand", c: str = "c") -> str:
    """The same from ``ds``, the dense scores."""
    order = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank"
    return f"""{sparse(c, "chunk_id", "text", "cs")}, {sparse("q", "query_id", "query", "qs")},
ss AS (SELECT query_id, chunk_id, sum(qs.v * cs.v) AS s FROM qs JOIN cs USING (token) GROUP BY ALL),
dh AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, {order} FROM
  (SELECT query_id, chunk_id, k, round(coalesce(s, 0), 6) AS score FROM {cand} LEFT JOIN ds USING (query_id, chunk_id)))
  WHERE rank <= k),
sh AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, {order} FROM
  (SELECT query_id, chunk_id, k, round(s, 6) AS score FROM {cand} JOIN ss USING (query_id, chunk_id)))
  WHERE rank <= k)"""


FUSED = """fu AS (SELECT query_id, chunk_id, round(f, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, seen, seen_rank, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(sum(1 / (60.0::DOUBLE + rank)), 12) AS f, min(no) AS seen,
      arg_min(rank, no) AS seen_rank
    FROM (SELECT *, 0 AS no FROM dh UNION ALL SELECT *, 1 FROM sh) GROUP BY query_id, chunk_id))
  WHERE rank <= 40)"""

OVERLAP = (
    f"(SELECT CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda w: list_contains(m, w))) / len(l)::DOUBLE"
    f" ELSE 0 END FROM (SELECT list_distinct({tokens('query')}) AS l, {tokens('text')} AS m))"
)


def reranked(c: str = "c") -> str:
    return f"""rr AS (SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS rank
  FROM (SELECT fu.query_id, fu.chunk_id, fu.rank, round({OVERLAP}, 6) AS score
    FROM fu JOIN {c} c USING (chunk_id) JOIN q USING (query_id))) WHERE rank <= 5)"""


def n_tokens(t: str) -> str:
    return f"greatest(1, floor(length({t}) / 3.5))::BIGINT"


SYSTEM_TOKENS = max(1, int(len(rules.SYSTEM_PROMPTS["general"]) / 3.5))


def fitted(rows: str, n_ctx: int) -> str:
    """CTE ``bt`` over rows with query_id, rank, query, text."""
    return f"""b0 AS (SELECT *, {n_tokens("text")} AS chunk_tokens, {n_tokens("query")} AS query_tokens,
  {n_ctx} - ({SYSTEM_TOKENS} + {n_tokens("query")} + 1024 + 64) AS room FROM {rows}),
b1 AS (SELECT *, sum(chunk_tokens) OVER (PARTITION BY query_id ORDER BY rank) <= room AS kept FROM b0),
bt AS (SELECT *, coalesce(sum(CASE WHEN kept THEN chunk_tokens END) OVER w, 0)::BIGINT AS tokens_chunks,
  NOT bool_and(kept) OVER w AS truncated, greatest(room, 0) AS budget_tokens,
  ({n_ctx} - room) + coalesce(sum(CASE WHEN kept THEN chunk_tokens END) OVER w, 0)::BIGINT AS tokens_total
  FROM b1 WINDOW w AS (PARTITION BY query_id))"""


SEARCHED = f"WITH {SEARCH}, {hits()}, {FUSED}"
FIT = f"{SEARCHED}, {fitted('(SELECT fu.*, query, text, document_id FROM fu JOIN c USING (chunk_id) JOIN q USING (query_id))', 4096)}"

# --- sources and sinks -----------------------------------------------------------

_EXT = "CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.html' WHEN 'de' THEN '.exe' ELSE '' END"
ORACLES["scan_documents"] = f"""
SELECT doc_id, {_EXT} AS ext, CASE WHEN lang NOT IN ('en', 'fr') THEN 'Unsupported file type: ' || {_EXT}
  WHEN lang = 'fr' THEN 'Unsupported file type: text/html'
  WHEN n_chars * 2000 > 52428800 THEN 'File size exceeds limit of 50 MB.' END AS problem FROM documents"""
ORACLES["join_pages"] = """
SELECT conv_id::VARCHAR AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""
_FIN = rules.ELEMENT_KINDS["financial"]
ORACLES["elements_from_json"] = f"""
WITH docs AS (SELECT doc_id, lang, text, CASE WHEN lang = 'fr' THEN '[' || text WHEN lang = 'de' THEN text ELSE
  to_json(list_transform(string_split(text, {NL}), lambda p, i: {{'type': (['Title', 'NarrativeText', 'ListItem',
    'Footer', 'Table', 'Unheard'])[(i - 1) % 6 + 1], 'text': p, 'metadata': {{'page_number': i}}}}))::VARCHAR END AS content
  FROM documents),
js AS (SELECT doc_id, from_json(content, '[{{"type":"VARCHAR","text":"VARCHAR","metadata":{{"page_number":"INTEGER"}}}}]') AS l
  FROM docs WHERE lang NOT IN ('fr', 'de') AND json_valid(content)),
pl AS ({explode("(SELECT * FROM docs WHERE lang IN ('fr', 'de'))", "doc_id", paras("content"), "t")})
SELECT doc_id, i AS pos, CASE l[i + 1].type WHEN 'Title' THEN 'header' WHEN 'ListItem' THEN 'list'
  WHEN 'Footer' THEN 'footnote' WHEN 'Table' THEN 'table' ELSE 'narrative' END AS kind, l[i + 1].text AS text,
  l[i + 1].metadata.page_number AS page_number FROM js, unnest(range(len(l))) u(i)
UNION ALL SELECT doc_id, pos, {KIND["financial"]}, t, NULL FROM pl"""
_HTML = "html"
for _old, _new in (
    ("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><th>link</th><td>"),
    ("</li>", "</td></tr>"), ("<p>", "<TR><td class='x'>"), ("</p>", "</td></TR>"),
):
    _HTML = f"replace({_HTML}, {lit(_old)}, {lit(_new)})"
_CELL = "y"
for _old, _new in (
    ("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&#x27;", "'"), ("&amp;", "&"),
):
    _CELL = f"replace({_CELL}, {lit(_old)}, {lit(_new)})"
ORACLES["html_tables_to_rows"] = f"""
WITH r AS (SELECT page_id, list_transform(regexp_extract_all({_HTML}, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1), lambda b:
  list_transform(regexp_extract_all(b, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]\\s*>', 1), lambda c:
    {strip(f"array_to_string(list_transform(list_filter(string_split_regex(c, '(?s)<[^>]*>'), lambda y: y <> ''), lambda y: {strip(_CELL)}), ' ')")}))
  AS rows FROM pages),
f AS (SELECT page_id, list_filter(rows, lambda x: len(x) > 0) AS rows FROM r)
SELECT page_id, i AS row_no, len(rows[i + 1]) AS n_cells, '| ' || array_to_string(rows[i + 1], ' | ') || ' |' AS row_text
FROM f, unnest(range(len(rows))) u(i)"""
ORACLES["route_collections"] = f"""
WITH {RAW} SELECT document_id, domain, 'rag_' || domain AS collection FROM docs"""
ORACLES["upsert_chunks"] = f"""
WITH {RAW}, k AS (SELECT doc_id, {uuid5("document_id || ':0'")} AS chunk_id, content FROM docs)
SELECT chunk_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 2 END AS seq,
  md5(CASE WHEN l.doc_id IS NULL THEN content ELSE content || '!2' END) AS content_md5
FROM k LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = k.doc_id"""
ORACLES["delete_document"] = f"""
WITH {RAW} SELECT doc_id, document_id, domain FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
ORACLES["wipe_collections"] = f"""
WITH {RAW} SELECT document_id, domain FROM docs WHERE domain NOT IN ('financial', 'medical')"""
ORACLES["archive_layout"] = f"""
WITH {RAW} SELECT document_id, domain || '/' || document_id || '/' || source || '.txt' AS key FROM docs"""
STATUS_LOG = """log AS (SELECT 'd' || user_id AS document_id, ts, event_id AS seq,
  CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'view' THEN 'processing'
    WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' AND value > 60 THEN 'failed'
    ELSE 'completed' END AS status,
  CASE WHEN event_type = 'purchase' THEN floor(value)::INTEGER END AS chunk_count,
  CASE WHEN event_type = 'error' THEN props END AS error_message FROM events)"""
ORACLES["latest_task_status"] = f"""
WITH {STATUS_LOG} SELECT document_id AS task_id, seq, status, chunk_count FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, seq DESC) AS n FROM log)
WHERE n = 1 AND ts > TIMESTAMP '2024-01-30 00:00:00'"""
_SPLIT = f"string_split(replace(text, '. ', '. ' || chr(1)), chr(1))"  # noqa: F541
_EVENTS = f"""ev AS (SELECT conv_id || ':' || turn AS request_id, role, text, {_SPLIT} AS l FROM conversations),
rows AS (SELECT request_id, 1::BIGINT AS seq, 'metadata' AS type, role AS content, NULL::VARCHAR AS usage FROM ev
  UNION ALL SELECT request_id, i + 2, 'token', l[i + 1], NULL FROM ev, unnest(range(len(l))) u(i)
  UNION ALL SELECT request_id, len(l) + 4, 'done', NULL, length(text)::VARCHAR FROM ev)"""
ORACLES["decode_stream_events"] = f"WITH {_EVENTS} SELECT request_id, seq, type, content, usage FROM rows"
ORACLES["encode_stream_events"] = """
WITH m AS (SELECT 'r' || conv_id AS request_id, count(*) AS used, max(turn) AS dropped FROM conversations GROUP BY conv_id)
SELECT request_id, 0 AS part, 0::BIGINT AS seq, 'data: {"type":"metadata","request_id":"' || request_id || '","chunks_used":'
  || used || ',"chunks_dropped":' || dropped || '}' || chr(10) || chr(10) AS frame FROM m
UNION ALL SELECT 'r' || conv_id, 1, turn, 'data: {"type":"token","content":"' || role || '"}' || chr(10) || chr(10) FROM conversations
UNION ALL SELECT request_id, 2, 0, 'data: {"type":"done"}' || chr(10) || chr(10) FROM m"""

# --- projections, filters, predicates ------------------------------------------------

_RAWDOM = """r AS (SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'medical' WHEN 'MACHINERY' THEN 'legal'
  WHEN 'AUTOMOBILE' THEN 'financial' WHEN 'BUILDING' THEN 'general' END AS raw,
  CASE WHEN c_acctbal > 5000 THEN 'medical' WHEN c_acctbal > 2000 THEN '' END AS header FROM customer)"""
ORACLES["normalise_domain"] = f"""
WITH {_RAWDOM} SELECT c_custkey, CASE WHEN raw IN ('financial', 'medical', 'general') THEN raw ELSE 'general' END AS domain FROM r"""
ORACLES["validate_domain"] = f"""
WITH {_RAWDOM} SELECT c_custkey, CASE WHEN raw <> 'legal' THEN raw END AS domain, coalesce(raw <> 'legal', false) AS accepted FROM r"""
ORACLES["resolve_domain"] = f"""
WITH {_RAWDOM} SELECT c_custkey,
  CASE WHEN coalesce(raw, 'general') <> 'general' THEN raw ELSE coalesce(nullif(header, ''), 'general') END AS ingest_domain,
  coalesce(nullif(header, ''), raw, 'general') AS query_domain FROM r"""
ORACLES["filtered_candidates"] = f"""
WITH {SEARCH} SELECT query_id, count(chunk_id) AS n_candidates FROM q LEFT JOIN cand USING (query_id) GROUP BY query_id"""
REGISTRY = """reg AS (SELECT 'd' || o_orderkey AS document_id, 'u' || o_custkey AS user_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'financial' WHEN o_orderpriority = '5-LOW' THEN 'medical'
    ELSE 'general' END AS domain,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice / 10000)::BIGINT END AS chunk_count,
  CASE WHEN o_totalprice > 300000 THEN 'parser error' END AS error_message,
  o_orderpriority = '3-MEDIUM' AS is_deleted, o_orderdate AS created_at FROM orders)"""
USERS = """us AS (SELECT 'u' || c_custkey AS user_id, lower(c_name) || '@example.com' AS email, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'viewer' ELSE 'user' END AS role,
  c_acctbal > 0 AS is_active,
  CASE c_mktsegment WHEN 'FURNITURE' THEN ['financial', 'general'] WHEN 'MACHINERY' THEN ['medical'] ELSE ['general'] END
    AS allowed FROM customer)"""
ORACLES["authorised_requests"] = f"""
WITH {REGISTRY}, {USERS} SELECT document_id, reg.user_id, domain FROM reg JOIN us USING (user_id)
WHERE is_active AND role IN ('admin', 'user') AND (role = 'admin' OR list_contains(allowed, domain))"""
_LINES = f"""{RAW}, lc AS ({explode("docs", "document_id, domain", "string_split_regex(content, '[.\\n] ?')", "text", "chunk_index")})"""
ORACLES["cap_chunks"] = f"WITH {_LINES} SELECT document_id, chunk_index, text FROM lc WHERE chunk_index < 100"
ORACLES["chunk_payload"] = f"""
WITH {RAW} SELECT CASE WHEN domain = 'medical' THEN document_id || ':' || doc_id ELSE {uuid5("document_id || ':0'")} END AS chunk_id,
  document_id, doc_id AS chunk_index, CASE WHEN domain = 'financial' THEN 'table' ELSE 'narrative' END AS chunk_type,
  content AS text, NULL::VARCHAR AS section, CASE WHEN domain = 'financial' THEN 'meta-' ELSE '' END || source AS source,
  domain, CASE WHEN domain = 'financial' THEN 'internal' ELSE 'public' END AS acl FROM docs"""
ORACLES["list_documents"] = f"""
WITH {REGISTRY} SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, document_id) AS position,
  document_id, status, count(*) OVER (PARTITION BY user_id) AS total FROM reg WHERE NOT is_deleted) WHERE position BETWEEN 3 AND 7"""
ORACLES["mask_ids"] = f"""
WITH {SEARCH}, {hits()} SELECT query_id, rank, 'Document ' || rank AS document_id, rank AS position FROM dh"""
ORACLES["document_status"] = f"""
WITH {REGISTRY} SELECT document_id, user_id, status, chunk_count,
  CASE WHEN status = 'failed' THEN coalesce(error_message, 'Ingestion failed.') END AS error FROM reg WHERE NOT is_deleted"""
ORACLES["validate_rows"] = f"""
WITH r AS (SELECT doc_id, {strip("CASE WHEN lang = 'es' THEN '  ' ELSE text END")} AS query,
  {strip(f"replace(text, {NL}, ' ')")} AS title, len(string_split(text, {NL})) AS n, n_chars % 130 AS lim,
  n_chars % 7 - 2 AS skip FROM documents)
SELECT doc_id, 'query' AS field, 'Query must be between 1 and 4096 characters.' AS message, substring(query, 1, 100) AS received
  FROM r WHERE length(query) NOT BETWEEN 1 AND 4096
UNION ALL SELECT doc_id, 'title', 'Title must be under 200 characters.', substring(title, 1, 100) FROM r WHERE length(title) > 200
UNION ALL SELECT doc_id, 'pinnedDocumentIds', 'Maximum 20 pinned documents.', n::VARCHAR FROM r WHERE n > 20
UNION ALL SELECT doc_id, 'limit', 'Limit must be 1–100.', lim::VARCHAR FROM r WHERE lim NOT BETWEEN 1 AND 100
UNION ALL SELECT doc_id, 'skip', 'Skip must be ≥ 0.', skip::VARCHAR FROM r WHERE skip < 0"""

# --- chunking --------------------------------------------------------------------------

ORACLES["paragraphs"] = f"WITH {STRUCTURED} {explode('docs', 'doc_id', paras('content'), 'text')}"
for _d in rules.DOMAINS:
    ORACLES[f"classify_{_d}"] = (
        f"WITH {STRUCTURED}, {elements(_d)} SELECT doc_id, pos, kind, t AS text FROM el"
    )
    ORACLES[f"sentences_{_d}"] = (
        f"WITH {STRUCTURED} {explode('docs', 'doc_id', sentence_list(_d, 'content'), 'sentence')}"
    )

# The space of such a boundary is another character while the text is split.
_held = r"regexp_replace(content, '([aeiou][.]) ([A-Z])', '\1' || chr(2) || '\2', 'g')"
_freed = f"list_transform({sentence_list('medical', _held)}, lambda y: replace(y, chr(2), ' '))"
ORACLES["sentences_around_spans"] = f"WITH {STRUCTURED} {explode('docs', 'doc_id', _freed, 'sentence')}"
ORACLES["clinical_section"] = f"""
WITH {STRUCTURED}, p AS ({explode("docs", "doc_id", paras("content"), "t")}) SELECT doc_id, pos, {sections("t")} AS section FROM p"""
_NO = "row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS unit_no"
ORACLES["carry_section"] = f"""
WITH RECURSIVE {STRUCTURED}, {elements("medical")}, {units("medical")}
SELECT doc_id, {_NO}, kind, section, section_raw FROM un"""
ORACLES["flush_groups"] = f"""
WITH RECURSIVE {STRUCTURED}, {elements("general")}, {units("general")} SELECT doc_id, {_NO}, kind, t AS text, section FROM un"""
ORACLES["attach_footnotes"] = f"""
WITH RECURSIVE {STRUCTURED}, {elements("financial")}, {units("financial")}
SELECT doc_id, {_NO}, kind, t AS text, notes, section FROM un"""
ORACLES["window_pack"] = f"""
WITH RECURSIVE {RAW}, {pack("(SELECT doc_id, content AS t FROM docs)", "doc_id", "general", 800)}
SELECT doc_id, piece - 1 AS window_no, w AS text FROM wi"""
ORACLES["hard_cut"] = f"WITH {RAW} {explode('docs', 'doc_id', cut_list('content', 512, 32), 'slice')}"
_TABLES = f"""tt AS (SELECT l_suppkey, '| order | line | flag | quantity |\n| --- | ---: | :---: | --- |\n' || string_agg(
  line, {NL} ORDER BY ord, line) AS t FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS ord, '| ' || l_orderkey || ' | '
    || l_linenumber || ' | ' || l_returnflag || ' | ' || l_quantity::INTEGER || ' |' AS line FROM lineitem) GROUP BY l_suppkey)"""
ORACLES["parse_pipe_tables"] = f"""
WITH {_TABLES}, r AS (SELECT l_suppkey, {pipe_rows("t")} AS rows FROM tt)
SELECT l_suppkey, i AS row_no, array_to_string(rows[i + 1], '|') AS cells FROM r, unnest(range(len(rows))) u(i)"""
ORACLES["split_tables"] = f"""
WITH {_TABLES}, {pieces("tt", "l_suppkey")} SELECT l_suppkey, piece_no, text, row_range FROM tp"""
ORACLES["table_ids"] = f"""
WITH {STRUCTURED} SELECT doc_id, substr(sha256('doc-' || doc_id || chr(10) || '0' || chr(10) || content), 1, 32) AS table_id FROM docs"""
ORACLES["medication_items"] = f"""
WITH RECURSIVE {STRUCTURED}, {chunks("medical")} SELECT doc_id, chunk_type, section, text FROM ch WHERE chunk_type IN ('medication', 'list')"""
ORACLES["extract_entities"] = f"WITH {STRUCTURED} {explode('docs', 'doc_id', entity_list('content'), 'entity')}"
ORACLES["merge_spans"] = """
WITH s AS (SELECT DISTINCT l_suppkey::VARCHAR AS document_id, l_partkey * 40 + l_linenumber AS a,
  l_partkey * 40 + l_linenumber + l_quantity::BIGINT AS b FROM lineitem),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY document_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT document_id, min(a) AS "start", max(b) AS stop FROM g GROUP BY document_id, island"""
ORACLES["chunk_index"] = f"""
WITH RECURSIVE {STRUCTURED}, {chunks("general")} SELECT doc_id, chunk_index, chunk_type, section, text FROM ch"""
ORACLES["chunk_ids"] = f"""
WITH {_LINES} SELECT document_id, chunk_index, {uuid5("document_id || ':' || chunk_index")} AS chunk_id FROM lc"""
_BY_DOMAIN = ",\n".join(
    f"{d[0]}_docs AS (SELECT * FROM docs WHERE domain = '{d}'), {chunks(d, d[0] + '_')}"
    for d in rules.DOMAINS
)
_ALL = " UNION ALL ".join(
    f"SELECT '{d}' AS domain, doc_id, chunk_index, chunk_type, section, section_raw, table_id, row_range, text FROM {d[0]}_ch"
    for d in rules.DOMAINS
)
ORACLES["chunk_documents"] = f"""
WITH RECURSIVE {STRUCTURED}, {_BY_DOMAIN}, a AS ({_ALL}),
b AS (SELECT *, 'doc-' || doc_id AS document_id, CASE WHEN domain <> 'medical' THEN NULL WHEN chunk_type = 'header'
  THEN '' ELSE coalesce(array_to_string({entity_list("text")}, '|'), '') END AS entities FROM a)
SELECT domain, document_id, chunk_index, {uuid5("document_id || ':' || chunk_index")} AS chunk_id, chunk_type, section,
  section_raw, table_id, row_range, entities, text FROM b"""
ORACLES["ingestion_summary"] = f"""
WITH {_LINES} SELECT document_id, domain, count(*) AS total_chunks, sum((length(text) > 20)::BIGINT)::BIGINT AS upserted,
  count(*) - sum((length(text) > 20)::BIGINT)::BIGINT AS failed FROM lc GROUP BY ALL"""

# --- encoding -------------------------------------------------------------------------------

ORACLES["encode_dense"] = f"""
WITH {RAW}, {dense("docs", "doc_id", "content", "v")} SELECT doc_id, b AS bucket, round(v, 6) AS value FROM v"""
ORACLES["l2_normalise"] = """
WITH s AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE * (i + 1) AS x FROM embeddings, unnest(range(len(embedding))) u(i))
SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM s"""
ORACLES["encode_sparse"] = f"""
WITH {RAW}, {sparse("docs", "doc_id", "content", "v")} SELECT doc_id, token, round(v, 6) AS weight FROM v"""
ORACLES["sparse_pool"] = """
SELECT l_orderkey AS document_id, l_returnflag || '-' || l_linestatus AS token, round(max(ln(1 + l_quantity - 25)), 6) AS weight
FROM lineitem WHERE l_quantity > 25 GROUP BY ALL"""
ORACLES["quantise_int8"] = """
WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(len(embedding))) u(i)),
s AS (SELECT quantile_disc(round(abs(x), 6), 0.99) AS clip FROM x)
SELECT vec_id, clip, i, round(greatest(least(x, clip), -clip) / clip * 127)::INTEGER AS q FROM x, s"""

# --- retrieval ----------------------------------------------------------------------------------

ORACLES["dense_topk"] = f"WITH {SEARCH}, {hits()} SELECT query_id, chunk_id, score, rank FROM dh"
ORACLES["sparse_topk"] = f"WITH {SEARCH}, {hits()} SELECT query_id, chunk_id, score, rank FROM sh"
ORACLES["bm25_topk"] = f"""
WITH d AS (SELECT doc_id AS chunk_id, {tokens("coalesce(text, '')")} AS w FROM documents),
tf AS (SELECT chunk_id, l, token, count(*) AS n FROM (SELECT chunk_id, len(w) AS l, unnest(w) AS token FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS n_all, sum(len(w)) / count(*) AS mean FROM d),
idf AS (SELECT token, ln(1 + (n_all - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY token, n_all),
q AS (SELECT query_id, token, count(*) AS m FROM (SELECT item_id AS query_id, unnest({tokens("text")}) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(m * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM q JOIN tf USING (token) JOIN idf USING (token), st GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {rules.TOP_K_SPARSE}"""
_DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
ORACLES["dense_topk_batch"] = f"""
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_DOT} AS score FROM embeddings a, embeddings b)) WHERE rank <= 10"""


def _cells(rounds: int) -> str:
    """Centres: vectors by hashed id, then the directions of their cells' sums."""
    near = "row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, cell)"
    parts = [
        """e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64),
sm AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) - 1 AS place FROM e QUALIFY place < 16384),
c0 AS MATERIALIZED (SELECT place AS cell, v AS c FROM sm WHERE place < 128)"""
    ]
    for r in range(rounds):
        parts.append(f"""m{r} AS (SELECT cell, list(s ORDER BY i) AS l FROM (SELECT cell, i, sum(v[i]) AS s
  FROM (SELECT cell, v FROM sm, c{r} QUALIFY {near} = 1), range(1, 65) t(i) GROUP BY cell, i) GROUP BY cell),
c{r + 1} AS MATERIALIZED (SELECT cell, CASE WHEN list_dot_product(l, l) > 1e-24
  THEN list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))) ELSE c END AS c FROM c{r} LEFT JOIN m{r} USING (cell))""")
    parts.append(f"""pr AS MATERIALIZED (SELECT vec_id, cell, {near} AS n FROM e, c{rounds}),
ah AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.v, b.v), 6) AS score
    FROM pr q JOIN pr h ON q.cell = h.cell AND q.n <= 72 AND h.n = 1 JOIN e a ON a.vec_id = q.vec_id JOIN e b ON b.vec_id = h.vec_id)
  QUALIFY rank <= 10)""")
    return ",\n".join(parts)


ORACLES["ann_topk"] = f"WITH {_cells(2)} SELECT query_id, chunk_id, score, rank FROM ah"
ORACLES["ann_recall"] = f"""
WITH {_cells(2)},
ex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
  QUALIFY rank <= 10)
SELECT ex.query_id, count(*) AS n, count(ah.chunk_id) AS found, round(count(ah.chunk_id) / count(*), 6) AS recall
FROM ex LEFT JOIN ah USING (query_id, chunk_id) GROUP BY ex.query_id"""
ORACLES["rrf_fuse"] = f"{SEARCHED} SELECT query_id, chunk_id, score, rank FROM fu"
ORACLES["rerank_topk"] = f"{SEARCHED}, {reranked()} SELECT query_id, chunk_id, score, rank FROM rr"
ORACLES["near_dup_chunks"] = f"""
WITH {RAW}, {dense("docs", "doc_id", "content", "v")},
p AS (SELECT a.doc_id AS chunk_id, b.doc_id AS duplicate_of, round(sum(a.v * b.v), 6) AS score FROM v a JOIN v b
  ON a.b = b.b AND b.doc_id < a.doc_id GROUP BY ALL)
SELECT chunk_id, duplicate_of, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, duplicate_of) AS n
  FROM p WHERE score >= 0.95) WHERE n = 1"""
ORACLES["admin_documents"] = f"""
WITH {REGISTRY}, {USERS}, pg AS (SELECT * FROM reg WHERE NOT is_deleted AND status = 'failed'
  ORDER BY created_at DESC, document_id LIMIT 500 OFFSET 10)
SELECT document_id, pg.user_id, email, name, domain FROM pg LEFT JOIN us USING (user_id)"""
SESSIONS = """se AS (SELECT 's' || conv_id AS session_id, 'u' || count(*) AS user_id,
  CASE sum(length(text)) % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'medical' ELSE 'general' END AS domain,
  'Conversation ' || conv_id AS title, bool_or(role = 'system') AS is_archived, sum(length(text)) AS updated_at, conv_id
  FROM conversations GROUP BY conv_id)"""
ORACLES["session_domain_check"] = f"""
WITH {SESSIONS}, r AS (SELECT CASE WHEN role = 'system' THEN 'unknown' ELSE 's' || conv_id END AS session_id, 'u' || (turn + 3) AS user_id,
  turn, CASE WHEN length(text) % 2 = 0 THEN 'financial' ELSE 'general' END AS domain FROM conversations)
SELECT r.session_id, r.user_id, turn, r.domain, se.domain AS session_domain, coalesce(se.domain = r.domain, true) AS accepted
FROM r LEFT JOIN se ON se.session_id = r.session_id AND se.user_id = r.user_id"""
_CHUNKED = f"""{RAW}, {chunks("general")},
c0 AS (SELECT *, 'doc-' || doc_id AS document_id, {uuid5("'doc-' || doc_id || ':' || chunk_index")} AS chunk_id FROM ch),
c AS (SELECT * FROM c0),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
cand AS (SELECT query_id, chunk_id, 20 AS k FROM q, c)"""
ORACLES["hybrid_search"] = f"""
WITH RECURSIVE {_CHUNKED}, {hits("cand", "c")}, {FUSED}, {reranked()},
{fitted("(SELECT rr.*, query, text, document_id FROM rr JOIN c USING (chunk_id) JOIN q USING (query_id))", 1800)}
SELECT query_id, rank, chunk_id, document_id, score, chunk_tokens, kept FROM bt"""

# --- aggregations and window-style operators -------------------------------------------------

ORACLES["stage_totals"] = f"""
{SEARCHED} SELECT query_id, 'dense' AS stage, count(*) AS total FROM dh GROUP BY ALL
UNION ALL SELECT query_id, 'sparse', count(*) FROM sh GROUP BY ALL UNION ALL SELECT query_id, 'rrf', count(*) FROM fu GROUP BY ALL"""
_FIRST = """so AS (SELECT query_id, document_id, chunk_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS n FROM bt WHERE kept) WHERE n = 1)"""
ORACLES["build_sources"] = f"""
{FIT}, {_FIRST} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_no, document_id, chunk_id, rank, score FROM so"""
ORACLES["estimate_tokens"] = f"""
{FIT} SELECT query_id, ({SYSTEM_TOKENS} + max(query_tokens) + sum(chunk_tokens) + 64 + 1024)::BIGINT AS estimated_tokens FROM bt GROUP BY query_id"""
ORACLES["token_budget"] = f"""
{FIT} SELECT query_id, rank, chunk_id, kept, tokens_chunks, tokens_total, budget_tokens, truncated, round(tokens_total / 4096, 6) AS utilisation FROM bt"""
_WARN = ", ".join(
    [f"CASE WHEN length(query) > 2000 THEN {lit(rules.WARN_LONG)} END"]
    + [
        f"CASE WHEN regexp_matches(query, {re2(p, 'i')}) THEN {lit(injection_message(p))} END"
        for p in rules.INJECTION_PATTERNS
    ]
)
_DIAGNOSIS = f"regexp_matches(query, {re2(rules.DIAGNOSIS_REQUEST, 'i')})"
ORACLES["request_metadata"] = f"""
{FIT}, {_FIRST}, n AS (SELECT query_id, sum(kept::BIGINT)::BIGINT AS used, count(*) - sum(kept::BIGINT)::BIGINT AS dropped, count(*) AS got FROM bt GROUP BY query_id),
sl AS (SELECT query_id, string_agg(document_id, '|' ORDER BY rank) AS sources FROM so GROUP BY query_id)
SELECT query_id, CASE WHEN q_domain = 'financial' THEN q_domain ELSE 'general' END AS domain, {n_tokens("query")} AS query_tokens,
  coalesce(got, 0) AS chunks_retrieved, coalesce(used, 0) AS chunks_used, coalesce(dropped, 0) AS chunks_dropped,
  array_to_string(list_filter([{_WARN}], lambda w: w IS NOT NULL), '|') AS warnings, coalesce(sources, '') AS sources
FROM q LEFT JOIN n USING (query_id) LEFT JOIN sl USING (query_id)"""
ORACLES["assemble_answers"] = f"""
WITH {_EVENTS} SELECT request_id, string_agg(content, '' ORDER BY seq) FILTER (type = 'token') AS answer, max(usage) AS usage
FROM rows GROUP BY request_id HAVING string_agg(content, '' ORDER BY seq) FILTER (type = 'token') <> ''"""
ORACLES["count_tokens"] = f"WITH {RAW} SELECT doc_id, {n_tokens('content')} AS n_tokens FROM docs"
ORACLES["history_window"] = """
SELECT 's' || conv_id AS session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
  FROM conversations) WHERE n BETWEEN 2 AND 5"""
ORACLES["message_page"] = """
WITH m AS (SELECT *, count(*) OVER w AS total, min(turn) OVER w AS first, max(CASE WHEN role = 'user' THEN turn END) OVER w AS cursor
  FROM conversations WINDOW w AS (PARTITION BY conv_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m
  WHERE cursor IS NULL OR cursor = first OR turn < cursor)
SELECT 's' || conv_id AS session_id, turn, role, total > 3 AS has_more FROM s WHERE n <= 3"""
ORACLES["list_sessions"] = f"""
WITH {SESSIONS} SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id) AS position,
  session_id, domain, title FROM se WHERE NOT is_archived) WHERE position BETWEEN 2 AND 6"""
ORACLES["update_sessions"] = f"""
WITH {SESSIONS}, u AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS title,
  max_by(length(text) % 2 = 0, turn) FILTER (role = 'assistant') AS archived, bool_or(turn = 7 AND role = 'user') AS gone
  FROM conversations WHERE conv_id % 4 <> 3 GROUP BY conv_id)
SELECT session_id, user_id, coalesce(u.title, se.title) AS title, coalesce(archived, is_archived) AS is_archived
FROM se LEFT JOIN u USING (conv_id) WHERE NOT coalesce(gone, false)"""

# --- text rules, guards, rendering --------------------------------------------------------------

ORACLES["sanitise_queries"] = f"""
WITH r AS (SELECT doc_id, {DOMAIN} AS domain, text AS query FROM documents)
SELECT doc_id, query, array_to_string(list_filter([{_WARN},
  CASE WHEN domain = 'medical' AND {_DIAGNOSIS} THEN {lit(rules.WARN_DIAGNOSIS)} END],
  lambda w: w IS NOT NULL), '|') AS warnings FROM r"""
ORACLES["diagnosis_flag"] = f"""
WITH r AS (SELECT doc_id, {DOMAIN} AS domain, text || CASE WHEN source IN ('src1', 'src2', 'src3') THEN ' Should I take it?' ELSE '' END AS query
  FROM documents) SELECT doc_id, domain = 'medical' AND {_DIAGNOSIS} AS flagged FROM r"""
_RESPONSES = f"""r0 AS (SELECT conv_id || ':' || turn AS response_id, CASE conv_id % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'medical' ELSE 'general' END AS domain,
  CASE WHEN role = 'system' THEN ' ' || {NL} ELSE text || CASE turn % 5 WHEN 0 THEN ' Take 20 mg daily for anxiety and depression.'
    WHEN 1 THEN ' We expect the outlook to improve.' WHEN 2 THEN ' 5 units were ordered.  ' || {NL} ELSE '' END END AS r, text FROM conversations)"""


def guard_steps(source: str) -> str:
    def add(test: str, text: str, sep: str) -> str:
        return (
            f"CASE WHEN {test} AND NOT contains(r, {lit(text)}) THEN rtrim(r, {WS}) || {lit(sep + text)} ELSE r END"
        )

    triggers = " OR ".join(f"contains(lower(r), {lit(t)})" for t in rules.FORWARD_LOOKING_TRIGGERS)
    med = "domain = 'medical'"
    topics, dose = re2(rules.SENSITIVE_TOPICS, "i"), re2(rules.DOSE, "i")
    rule = rules.DISCLAIMER_RULE
    return f"""g1 AS (SELECT * REPLACE (CASE WHEN r IS NULL OR {strip("r")} = '' THEN {lit(rules.EMPTY_RESPONSE)} ELSE r END AS r) FROM {source}),
g2 AS (SELECT * REPLACE (CASE WHEN domain = 'financial' AND ({triggers}) THEN {lit(rules.FORWARD_LOOKING_NOTICE)} || r ELSE r END AS r) FROM g1),
g3 AS (SELECT * REPLACE ({add(f"{med} AND regexp_matches(r, {topics})", rules.CRISIS_REFERRAL, chr(10) * 2)} AS r) FROM g2),
g4 AS (SELECT * REPLACE ({add(f"{med} AND regexp_matches(r, {dose})", rules.PRESCRIBING_NOTE, chr(10) * 2)} AS r) FROM g3),
g5 AS (SELECT * REPLACE ({add(med, rules.MEDICAL_DISCLAIMER, rule)} AS r) FROM g4),
g6 AS (SELECT * REPLACE ({add("domain = 'general'", rules.GENERAL_DISCLAIMER, rule)} AS r) FROM g5)"""


ORACLES["guard_responses"] = f"WITH {_RESPONSES}, {guard_steps('r0')} SELECT response_id, domain, r AS guarded FROM g6"
ORACLES["guard_token_stream"] = f"""
WITH {_EVENTS}, {_RESPONSES}, tk AS (SELECT request_id, seq, content FROM rows WHERE type = 'token' AND content <> ''),
an AS (SELECT request_id, string_agg(content, '' ORDER BY seq) AS r, max(seq) AS last FROM tk GROUP BY request_id),
src AS (SELECT request_id, last, domain, an.r AS raw, an.r FROM an JOIN r0 ON r0.response_id = an.request_id), {guard_steps("src")},
f AS (SELECT *, starts_with(r, {lit(rules.FORWARD_LOOKING_NOTICE)}) AS noticed FROM g6),
b AS (SELECT *, CASE WHEN noticed THEN substring(r, {len(rules.FORWARD_LOOKING_NOTICE) + 1}) ELSE r END AS body FROM f)
SELECT * FROM tk UNION ALL SELECT request_id, -1, {lit(rules.FORWARD_LOOKING_NOTICE)} FROM b WHERE noticed
UNION ALL SELECT request_id, last + 1, substring(body, length(rtrim(raw, {WS})) + 1) FROM b WHERE length(body) > length(raw)"""


def block() -> str:
    g, f, m = (rules.CONTEXT_LABELS[d] for d in ("general", "financial", "medical"))
    text = strip("text")
    score = "printf('%.4f', score)"
    date = "coalesce(date, 'N/A')"
    before, after = rules.TABLE_HINT.split("{rows}")

    def lay(labels, values, body):
        lines = f" || {NL} || ".join(f"{lit(a)} || {b}" for a, b in zip(labels, values, strict=True))
        return f"{lines} || {NL} || {NL} || {body} || {NL}"

    return f"""CASE domain WHEN 'general' THEN {lay(g, ["rank || ']'", "source", "'N/A'"], text)}
WHEN 'financial' THEN {lay(f, ["rank || ']'", "source", "'N/A'", date, "chunk_type", score], f"CASE WHEN chunk_type = 'table' THEN {lit(before + after)} ELSE '' END || {text}")}
ELSE {lay(m, ["rank || ']'", "source", "'N/A'", date, "chunk_type", "'none detected'", score], text)} END"""


_BLOCKS = f"""{SEARCHED}, {reranked()}, kp AS (SELECT rr.*, text, domain, source, chunk_type,
  CASE WHEN acl = 'public' THEN '2024-0' || (doc_id % 9 + 1) END AS date FROM rr JOIN c USING (chunk_id)),
bl AS (SELECT query_id, rank, {block()} AS block FROM kp)"""
ORACLES["context_blocks"] = f"{_BLOCKS} SELECT query_id, rank AS position, block FROM bl"


def prompt(d: str) -> str:
    before, after = rules.CONTEXT_HEADING[d].replace("{today}", "2024-01-31").split("{n}")
    note = f" || {NL} || CASE WHEN {_DIAGNOSIS} THEN {lit(rules.NOTE_DIAGNOSIS)} ELSE '' END" if d == "medical" else ""
    gap = "\n" if d == "medical" else "\n\n"
    return (
        f"{lit(rules.SYSTEM_PROMPTS[d] + chr(10) * 2 + '---' + chr(10) * 2 + before)} || coalesce(n, 0) || {lit(after + chr(10) * 2)}"
        f" || coalesce(ctx, {lit(rules.EMPTY_CONTEXT[d])}) || {lit(chr(10) * 2 + '---' + chr(10) * 2 + rules.QUERY_HEADING[d] + chr(10) * 2)}"
        f" || {strip('query')}{note} || {lit(gap + rules.INSTRUCTION[d] + chr(10))}"
    )


ORACLES["render_prompts"] = f"""
{_BLOCKS}, cx AS (SELECT query_id, string_agg(block, {NL} ORDER BY rank) AS ctx, count(*) AS n FROM bl GROUP BY query_id),
a AS (SELECT query_id, query, CASE query_id % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'medical' ELSE 'general' END AS domain, ctx, n
  FROM q LEFT JOIN cx USING (query_id))
SELECT query_id, domain, coalesce(n, 0) AS n_blocks, CASE domain WHEN 'financial' THEN {prompt("financial")}
  WHEN 'medical' THEN {prompt("medical")} ELSE {prompt("general")} END AS prompt FROM a"""
ORACLES["fallback_answers"] = f"""
{SEARCHED}, {reranked()} SELECT query_id, {lit(rules.NO_CONTEXT_ANSWER)} AS answer FROM q
WHERE query_id NOT IN (SELECT query_id FROM rr WHERE score >= 0.6)"""

# --- streams and status ------------------------------------------------------------------------------

ORACLES["status_machine"] = f"""
WITH RECURSIVE {STATUS_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, seq) AS n FROM log),
st AS (SELECT 'd' || c_custkey AS document_id, 0::BIGINT AS n, 'pending' AS status, NULL::INTEGER AS chunk_count, NULL::VARCHAR AS error_message FROM customer
  UNION ALL
  SELECT s.document_id, o.n, CASE WHEN ok THEN o.status ELSE s.status END,
    CASE WHEN ok THEN coalesce(o.chunk_count, s.chunk_count) ELSE s.chunk_count END,
    CASE WHEN ok THEN coalesce(o.error_message, s.error_message) ELSE s.error_message END
  FROM st s JOIN (SELECT * FROM o) o ON o.document_id = s.document_id AND o.n = s.n + 1,
    LATERAL (SELECT (s.status = 'pending' AND o.status IN ('processing', 'failed'))
      OR (s.status = 'processing' AND o.status IN ('completed', 'failed')) AS ok))
SELECT document_id, arg_max(status, n) AS status, max_by(struct_pack(v := chunk_count), n).v AS chunk_count,
  max_by(struct_pack(v := error_message), n).v AS error_message FROM st GROUP BY document_id"""
ORACLES["rate_limit"] = """
WITH r AS (SELECT event_id AS request_id, ts, coalesce(CASE WHEN event_type <> 'signup' THEN user_id::VARCHAR END, '10.0.0.' || user_id % 7) AS caller,
  event_type = 'view' AS exempt FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY caller, date_trunc('day', ts), exempt ORDER BY ts, request_id) AS n_in_window FROM r)
SELECT request_id, caller, n_in_window, NOT exempt AND n_in_window > 5 AS limited,
  CASE WHEN NOT exempt AND n_in_window > 5 THEN 86400 END AS retry_after FROM n"""
ORACLES["dedup_events"] = "SELECT event_id, user_id, event_type FROM events"
_STREAMED = ",\n".join(
    f"{d[0]}_docs AS (SELECT * FROM docs WHERE domain = '{d}'), {chunks(d, d[0] + '_')}"
    for d in rules.DOMAINS
)
ORACLES["stream_ingest"] = f"""
WITH RECURSIVE {RAW}, {_STREAMED}, a AS ({_ALL})
SELECT domain, 'doc-' || doc_id AS document_id, chunk_index, {uuid5("'doc-' || doc_id || ':' || chunk_index")} AS chunk_id, chunk_type
FROM a"""
ORACLES["semantic_cache_lookup"] = f"""
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE b.label * 600 > 5400 - 3600)
  WHERE score >= 0.92) WHERE n = 1"""


def _by_width(source: str, key: str, t: str, name: str) -> str:
    """Like ``dense`` with the width of each vector as a column of the source."""
    return f"""{name} AS (SELECT {key}, width, b, (n / sqrt(sum(n * n) OVER (PARTITION BY {key}, width)))::FLOAT::DOUBLE AS v
  FROM (SELECT {key}, width, ('0x' || substr(md5(w), 1, 8))::BIGINT % width AS b, count(*)::DOUBLE AS n
    FROM (SELECT {key}, width, unnest({tokens(t)}) AS w FROM {source}) GROUP BY ALL))"""


ORACLES["cross_domain_search"] = f"""
WITH RECURSIVE {RAW}, {_STREAMED}, a AS ({_ALL}),
c AS (SELECT domain, {uuid5("'doc-' || doc_id || ':' || chunk_index")} AS chunk_id, text,
  CASE WHEN domain = 'general' THEN 384 ELSE 768 END AS width FROM a),
q AS (SELECT item_id AS query_id, text AS query,
  CASE item_id % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'medical' WHEN 2 THEN 'general' END AS wanted FROM benchmark),
qw AS (SELECT query_id, query, unnest([384, 768]) AS width FROM q),
cand AS (SELECT query_id, chunk_id, 20 AS k FROM q JOIN c ON wanted IS NULL OR wanted = domain),
{_by_width("c", "chunk_id", "text", "cd")}, {_by_width("qw", "query_id", "query", "qd")},
ds AS (SELECT query_id, chunk_id, sum(qd.v * cd.v) AS s FROM qd JOIN cd USING (width, b) GROUP BY ALL),
{winners()}, {FUSED} SELECT query_id, chunk_id, score, rank FROM fu"""
ORACLES["stream_answers"] = f"""
WITH {_EVENTS}, an AS (SELECT request_id, string_agg(content, '' ORDER BY seq) FILTER (type = 'token') AS answer, max(usage) AS usage
  FROM rows GROUP BY request_id HAVING string_agg(content, '' ORDER BY seq) FILTER (type = 'token') <> ''),
ad AS (SELECT *, CASE split_part(request_id, ':', 1)::BIGINT % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'medical' ELSE 'general' END AS domain,
  answer AS r FROM an), {guard_steps("ad")} SELECT request_id, domain, answer, usage, r AS guarded FROM g6"""
