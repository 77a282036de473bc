"""Main text of web pages by block rules in two passes.

A page is cut into blocks of running text. The first pass decides blocks by
their length, the share of their text inside links and the share of function
words; blocks that these leave open get the label of their nearest decided
neighbours in the second pass. Tags and names are evidence beside the rules:
menus, forms, adverts and the like are out, and an article element draws its
open blocks in as long as most of the page's good text stands in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import common as C

#: Characters below which a block is too short to be decided by itself.
SHORT = 70
#: Characters from which a block counts as long: fewer function words will do.
LONG = 200
#: Share of function words (the lists are short) that running text has, in medium and in long blocks.
DENSE, SPARSE = 0.2, 0.1
#: Share below which a page is in a language without known function words: length and links decide.
FOREIGN = 0.03
#: Share of text inside links from which a block is navigation.
LINKED = 0.5
#: The same inside the article, where single links are common.
LINKED_INSIDE = 0.8

#: Elements whose content is no markup and is dropped to their end tag, or to the page's end.
_RAW = frozenset("script style noscript template textarea title iframe".split())
#: Elements that are dropped with all they hold where they are closed.
_DROPPED = frozenset("svg math object select button canvas audio video".split())
_OPEN = re.compile(r"<(?:[!?]|(/?)([a-z][\w:-]*+))", re.I)
#: The attributes of a tag and its end: only a value behind ``=`` may hold a ``>`` in quotes.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTR = re.compile(r"""([\w:-]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*_RAW, *_DROPPED)}
_HUGE = re.compile(r"&#0*+([1-9][0-9]{7,}+);?")
_WORD = re.compile(r"[^\W\d_]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter "
    "output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr caption figcaption pre hr br address summary option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the article.
_OUTSIDE = frozenset("head nav footer aside form menu dialog fieldset".split())
_SCOPES = frozenset("article main".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox adsense banner cookie cookies consent gdpr notice notices popup "
    "modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist disqus reply replies promo promotion sponsor sponsored newsletter subscribe signup login share "
    "sharing social related recommended widget toolbar pagination pager skip copyright legal alert notification "
    "toast hidden".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
_WORDS = frozenset(C.FUNCTION_WORDS)


@dataclass(slots=True)
class Block:
    text: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    outside: bool = False
    scope: int = 0  # 0: in no article
    parent: int = 0  # the element that holds it


def _hides(name: str, attrs: str, scope: int) -> bool:
    """Does this element hold something that is not part of an article?"""
    if name in _OUTSIDE or (name == "header" and not scope):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and name not in ("html", "body", *_SCOPES):
            if _NAMES.intersection(re.split(r"[^a-z]+", value)):
                return True
        elif key == "role" and value in _ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of running text in page order, empty ones left out; one pass forward over the page."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open containers: name, outside?, scope, number
    open_names: Counter[str] = Counter()
    unclosed: set[str] = set()  # names without an end tag in what is left
    now, links, scopes, opened = Block(), 0, 0, 0
    leaf_hidden = False

    def cut() -> None:
        nonlocal now
        if now.text:
            if any(not t.isspace() for t in now.text):
                found.append(now)
            now = Block()
        _, outside, now.scope, now.parent = stack[-1] if stack else ("", False, 0, 0)
        now.outside = outside or leaf_hidden

    def add(text: str) -> None:
        if not text:
            return
        now.text.append(text)
        if links:
            now.linked.append(text)

    def tag(closing: bool, name: str, attrs: str) -> None:
        nonlocal links, scopes, opened, leaf_hidden
        if name == "a":
            links = 0 if closing else 1
        if name in _INLINE:
            return
        if name == "br":
            add(" ")
            return
        if name in _LEAVES or name in _VOID:
            leaf_hidden = not closing and _hides(name, attrs, stack[-1][2] if stack else 0)
            cut()
            return
        leaf_hidden = False
        if not closing:
            _, outside, scope, _ = stack[-1] if stack else ("", False, 0, 0)
            outside = outside or _hides(name, attrs, scope)
            if name in _SCOPES and not scope and not outside:
                scopes += 1
                scope = scopes
            if not attrs.endswith("/"):
                opened += 1
                stack.append((name, outside, scope, opened))
                open_names[name] += 1
        else:
            if open_names[name]:
                while (top := stack.pop()[0]) != name:
                    open_names[top] -= 1
                open_names[name] -= 1
            links = 0
        cut()

    begin = at = 0  # text not yet added, and where to look for the next tag
    quoted = True
    while found_tag := _OPEN.search(page, at):
        at, name = found_tag.start(), found_tag.group(2)
        if not name:
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + (4 if comment else 1))
            add(page[begin:at])
            begin = at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        closing, after = bool(found_tag.group(1)), found_tag.end()
        rest = _REST.match(page, after) if quoted else None
        if rest:
            attrs, end = rest.group(1), rest.end()
        else:  # quotes that never end are no quotes, here and in what follows
            quoted = False
            end = page.find(">", after) + 1
            if not end:
                break
            attrs = page[after : end - 1]
        add(page[begin:at])
        name = name.lower()
        if name in _ENDS and not closing and not attrs.endswith("/") and name not in unclosed:
            close = _ENDS[name].search(page, end)
            if close or name in _RAW:
                begin = at = close.end() if close else len(page)
                continue
            unclosed.add(name)
        begin = at = end
        if name not in _ENDS:
            tag(closing, name, attrs)
    if begin < len(page):
        add(page[begin:])
    cut()
    return found


def plain(parts: list[str]) -> str:
    """Text of a block: references decoded, white space turned into single spaces."""
    return " ".join(html.unescape(_HUGE.sub("\ufffd", "".join(parts))).split())


def density(text: str) -> tuple[int, int]:
    """Function words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in _WORDS for w in words), len(words)


def first_pass(block: Block, text: str, foreign: bool = False) -> bool | None:
    """True: running text, False: not, None: the rules cannot tell.

    ``foreign``: the page's language is not known by its function words, so length and
    links decide alone. Text without them is given up outside an article only.
    """
    if block.outside:
        return False
    linked = len(plain(block.linked)) / max(1, len(text))
    if linked > (LINKED_INSIDE if block.scope else LINKED):
        return False
    if len(text) < SHORT:
        return None
    if foreign:
        return True
    known, words = density(text)
    share = known / max(1, words)
    if share >= (SPARSE if len(text) >= LONG else DENSE):
        return True
    return False if share < FOREIGN and not block.scope else None


def second_pass(labels: list[bool | None], scopes: list[int], parents: list[int]) -> list[bool]:
    """Open blocks take the label of the nearest decided block.

    Blocks of the same element are nearer than others, and inside an article only
    its own blocks are neighbours. Outside of articles the page's borders count as
    neighbours that are out. Of equally near ones that differ, a block of the same element
    or article counts as article, another one does not. A block without any decided
    neighbour is kept.
    """
    out = [bool(x) for x in labels]
    rings = [list(zip(scopes, parents)), [(x,) for x in scopes]]
    nearest = [_decided(labels, ring) for ring in rings]
    for i, label in enumerate(labels):
        if label is not None:
            continue
        out[i] = True
        for inner, found in zip((True, bool(scopes[i])), nearest):
            if found[i]:
                borders = [] if inner else [(i + 1, False), (len(labels) - i, False)]
                least = min(d for d, _ in found[i] + borders)
                told = {x for d, x in found[i] + borders if d == least}
                out[i] = told == {True} or (inner and True in told)
                break
    return out


def _decided(labels: list[bool | None], ring: list[tuple]) -> list[list[tuple[int, bool]]]:
    """For each block, distance and label of the nearest decided ones of its ring on both sides."""
    found: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict[tuple, tuple[int, bool]] = {}
        for i in order:
            if labels[i] is not None:
                last[ring[i]] = (i, labels[i])
            elif ring[i] in last:
                at, label = last[ring[i]]
                found[i].append((abs(at - i), label))
    return found


def _in_article(held: list[tuple[Block, str]], labels: list[bool | None]) -> bool:
    """Does most of the page's good text stand in articles? Open text counts if there is no good one."""
    for kind in (True, None):
        sizes = [(b.scope, len(t)) for (b, t), x in zip(held, labels) if x is kind and not b.outside]
        if sizes:
            return 2 * sum(n for scope, n in sizes if scope) >= sum(n for _, n in sizes)
    return False


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty if it has none."""
    found = blocks(page or "")
    held = [(b, t) for b, t in ((b, plain(b.text)) for b in found) if t]
    told = [density(t) for b, t in held if not b.outside and not b.linked]
    foreign = sum(n for n, _ in told) < FOREIGN * sum(n for _, n in told)
    labels = [first_pass(b, t, foreign) for b, t in held]
    if any(b.scope for b, _ in held):
        if _in_article(held, labels):
            labels = [x if b.scope else False for (b, _), x in zip(held, labels)]
        else:  # articles that hold only a small part, teasers, are elements like any other
            held = [(replace(b, scope=0), t) for b, t in held]
            labels = [first_pass(b, t, foreign) for b, t in held]
    decided = second_pass(labels, [b.scope for b, _ in held], [b.parent for b, _ in held])
    return " ".join(text for (_, text), good in zip(held, decided) if good)


def extract(pages: DataFrame, content: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every page and drop ``content``.

    A null or empty page has an empty text; unclosed, stray and nested tags never
    fail; repeated rows and null keys are treated like any other; columns named
    ``text`` and ``n_chars`` are replaced; an empty table stays empty.
    """
    C.small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (content, "text", "n_chars")]
    schema = T.StructType(
        [
            *(pages.schema[c] for c in kept),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, content):
                texts = [main_text(p) for p in part.column(content).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=schema.names,
                )

    return pages.select(*kept, F.col(content)).mapInArrow(run, schema)
