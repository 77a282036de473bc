"""Removal of word sequences that already occur in an earlier document.

Suffixes are split by their leading words into groups that fit in memory. Each group is
sorted as a suffix array, with the common prefix of neighbours, and the inner nodes of
its subtree that lie ``WINDOW`` words deep or deeper tell which windows are repeats and
in which document they start first.

1. *Prefix counts.* Of all suffixes only those at winnowed anchors are counted:
   the least 5-word prefix among the suffixes that start in a window. Every window
   has its anchor, and equal windows have equal ones, so a window whose anchor
   occurs in one document only is no repeat. This leaves out most of the text
   before any word moves. Tasks combine their own occurrences first, so one
   prefix sends a row for each combined block, whoever holds it.
2. *Groups.* Documents with shared anchors meet their positions; each shared
   anchor becomes a row with the words of all windows it stands for. Rows are
   grouped by the 5-word prefix, and a prefix with more rows than a group may hold
   by a number drawn from their document as well.
3. *Subtrees.* Windows of a group below one deep inner node are equal. All but those of
   the node's earliest document are repeats, whatever other groups of the prefix hold.
   Runs of them are the maximal repeats to remove.
4. *Longer prefixes.* Where a prefix has several groups, the earliest documents of their
   nodes are left open. They alone go on, keyed by the words of the whole window, one
   row per node and group, and lose the window if another group has an earlier one.
5. Documents with repeats meet their spans and are put together again; the
   others are passed on where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm import common as C
from docloom.operators.id_filters import id_filter, passing

WINDOW = 13
GRAM = 5
#: Rows of one prefix that a group holds on average at most.
GROUP_ROWS = 20_000
#: Occurrences that a task combines at once.
BLOCK = 1_000_000


def _fold(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Occurrences of one block: of a prefix that several of its documents share, one speaks for all."""
    order = np.argsort(key, kind="stable")
    key, doc, pos = key[order], doc[order], pos[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(begin, append=len(key))
    count = np.repeat(size, size)
    shared = np.repeat(np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin), size)
    speaks = np.zeros(len(key), bool)
    speaks[begin] = True
    own = C.mixed(key ^ C.mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)))
    key = np.where(shared & ~speaks, own, key)
    count = np.where(shared, np.where(speaks, count, 0), 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(shared),
            pa.array(doc),
            pa.array(pos.astype(np.int32)),
            pa.array(count.astype(np.int32)),
        ],
        names=["key", "shared", "doc", "pos", "n"],
    )


def _anchors(words: C.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a step: where each begins, its anchor, and the hash of every 5-word prefix."""
    grams = C.grams(words.hashes(), gram)
    begin = np.flatnonzero(C.whole(words.row, window))
    return begin, C.anchors(grams, window - gram + 1)[begin], grams


def shared_prefixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows of (key, doc, pos, total) for anchors whose prefix occurs in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in C.steps(batch, "_text"):
                words = C.words_of(part.column("_text"), C.SPACED)
                _, anchor, grams = _anchors(words, window, gram)
                at = np.unique(anchor)
                if not len(at):
                    continue
                row = words.row[at]
                doc = part.column("_doc").to_numpy(zero_copy_only=False)[row]
                held.append((grams[at], doc, at - words.first[row]))
                n += len(at)
                if n >= BLOCK:
                    yield _fold(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield _fold(*(np.concatenate(x) for x in zip(*held)))
        held = []
        C.give_back()

    found = docs.mapInArrow(run, "key long, shared boolean, doc long, pos int, n int")
    same = Window.partitionBy("key")
    return (
        found.withColumns(
            {
                "total": F.sum("n").over(same),
                "several": F.max("shared").over(same)
                | (F.min("doc").over(same) < F.max("doc").over(same)),
            }
        )
        .where("several")
        .select("key", "doc", "pos", "total", "n")
    )


_GROUP = "key long, doc long, copy int, first int, n int, words string"


def _suffixes(moved: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each shared anchor: the windows it stands for, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text", C.STEP_BYTES // 2):
                words = C.words_of(part.column("_text"), C.SPACED)
                begin, anchor, grams = _anchors(words, window, gram)
                if not len(begin):
                    continue
                places = part.column("_places")
                size = np.diff(places.offsets.to_numpy()).astype(np.int64)
                wanted = words.first.repeat(size) + places.flatten().to_numpy(zero_copy_only=False)
                # A repeated id may bring positions of another row: they are no anchors here.
                shared = np.zeros(len(words.row) + 1, bool)
                shared[wanted[wanted < len(words.row)]] = True
                # Windows with one anchor lie side by side.
                head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1))))
                n = np.diff(head, append=len(begin))
                good = shared[anchor[head]]
                head, n = head[good], n[good]
                if not len(head):
                    continue
                first, row = begin[head], words.row[begin[head]]
                size = n + window - 1
                taken = C.spans(first, size)
                context = C.Words(
                    np.repeat(np.arange(len(head)), size), size, words.code[taken], words.distinct, *_gather(words, taken)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[anchor[head]].view(np.int64)),
                        part.column("_doc").take(pa.array(row)),
                        part.column("_copy").take(pa.array(row)),
                        pa.array((first - words.first[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        C.joined(context, np.ones(len(taken), bool)),
                    ],
                    names=["key", "doc", "copy", "first", "n", "words"],
                )

    return moved.mapInArrow(run, _GROUP)


def _gather(words: C.Words, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(words.ends, prepend=0)[taken]
    return np.cumsum(size), words.flat[C.spans(words.ends[taken] - size, size)]


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), return_inverse=True)[1]


def suffix_order(code: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``depth`` words, and common words with the one before.

    Ranks of 1, 2, 4, ... words are doubled until they cover ``depth`` of them; all
    suffixes have as many. Common prefixes are counted up to ``depth``.
    """
    rank, have = code, 1
    while have < depth:
        more = min(have, depth - have)
        rank = _pairs(rank[:-more], rank[more:])
        have += more
    order = np.argsort(rank[at], kind="stable")
    common = np.zeros(len(at), np.int64)
    one, two = at[order[:-1]], at[order[1:]]
    alike = np.ones(len(one), bool)
    for j in range(depth):
        alike &= code[one + j] == code[two + j]
        common[1:] += alike
    return order, common


def _runs(row: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of chosen windows that lie side by side in a row."""
    after = np.zeros(len(row) + 1, bool)
    after[1:-1] = (row[1:] == row[:-1]) & (begin[1:] == begin[:-1] + 1) & chosen[1:] & chosen[:-1]
    return np.flatnonzero(chosen & ~after[:-1]), np.flatnonzero(chosen & ~after[1:])


def _repeats(rows: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Word spans of repeats within these groups, and windows that other groups must decide (with their words)."""
    held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    words = C.words_of(held.column("words"), C.SPACED)
    doc, first, n, parts, key, part = (
        held.column(c).to_numpy().astype(np.int64) for c in ("doc", "first", "n", "parts", "key", "part")
    )
    group = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    row = np.repeat(np.arange(len(n)), n)
    at = C.spans(words.first, n)
    order, common = suffix_order(words.code, at, window)
    # Groups side by side may hold parts of one prefix: a node is one of its group.
    of = group[row[order]]
    resorted = np.argsort(of, kind="stable")
    order, of = order[resorted], of[resorted]
    node = np.cumsum(common < window)[resorted]  # inner nodes, and leaves, of the window's depth
    fresh = np.ones(len(order), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (of[1:] != of[:-1])
    low = np.minimum.reduceat(doc[row[order]], np.flatnonzero(fresh)) if len(order) else doc[:0]
    earliest = np.empty(len(order), np.int64)
    earliest[order] = low[np.cumsum(fresh) - 1]
    gone = doc[row] > earliest
    begin = first[row] + (at - words.first[row])
    start, stop = _runs(row, begin, gone)
    left = np.flatnonzero(~gone & (parts[row] > 1))
    taken = C.spans(at[left], np.full(len(left), window))
    context = C.Words(
        np.repeat(np.arange(len(left)), window), np.full(len(left), window), words.code[taken], words.distinct, *_gather(words, taken)
    )
    where = np.concatenate((row[start], row[left]))
    return pa.RecordBatch.from_arrays(
        [
            held.column("doc").take(pa.array(where)),
            held.column("copy").take(pa.array(where)),
            pa.array(np.concatenate((begin[start], begin[left])).astype(np.int32)),
            pa.array(np.concatenate((begin[stop], begin[left])).astype(np.int32) + window),
            pa.concat_arrays([pa.nulls(len(start), pa.string()), C.joined(context, np.ones(len(taken), bool)).cast(pa.string())]),
        ],
        names=["doc", "copy", "begin", "end", "prefix"],
    )


def _subtrees(groups: DataFrame, window: int) -> DataFrame:
    """Spans of repeats, and open windows (``prefix`` is not null), of rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < 20_000:
                continue
            # The last group may go on in the next batch.
            key, part = (batch.column(c).to_numpy() for c in ("key", "part"))
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield _repeats([*held[:-1], batch.slice(0, cut)], window)
                held, n = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield _repeats(held, window)
        C.give_back()

    return groups.mapInArrow(run, "doc long, copy int, begin int, end int, prefix string")


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Per document with repeats: ``_doc, _copy`` and ``_spans``, lists of [begin, end) in words.

    ``docs`` has ``_doc`` (long, not null), ``_copy`` (tells rows with one id apart) and ``_text``.
    """
    shared = C.keep(shared_prefixes(docs.select("_doc", "_text"), window, gram), "prefixes")
    # At most one prefix in ``group_rows`` occurrences has several groups.
    parts = F.ceil(F.max("total") / group_rows).cast("int").alias("parts")
    heavy = C.keep(shared.where((F.col("n") > 0) & (F.col("total") > group_rows)).groupBy("key").agg(parts), "heavy")
    places = shared.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("pos").alias("_places"))
    moved = passing(docs, id_filter(shared, "doc"), "_doc").join(places, "_doc")
    rows = _suffixes(moved.select("_doc", "_copy", "_text", "_places"), window, gram)
    several = F.coalesce("parts", F.lit(1))
    grouped = rows.join(heavy, "key", "left").withColumns(
        {"parts": several, "part": F.pmod(F.xxhash64("doc"), several).cast("int")}
    )
    dealt = grouped.repartition("key", "part").sortWithinPartitions("key", "part")
    found = C.keep(_subtrees(dealt, window), "repeats")
    span = ["doc", "copy", "begin", "end"]
    # The windows of the earliest documents of groups of one prefix: written, so that the join may split.
    opened = found.where("prefix is not null")
    earliest = C.keep(opened.groupBy("prefix").agg(F.min("doc").alias("earliest")), "earliest")
    late = opened.join(earliest, "prefix").where(F.col("doc") > F.col("earliest")).select(span)
    spans = found.where("prefix is null").select(span).unionByName(late)
    return spans.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).agg(
        F.collect_list(F.array("begin", "end")).alias("_spans")
    )


def _rebuild(docs: DataFrame, carried: list[str]) -> DataFrame:
    schema = T.StructType(
        [
            *(docs.schema[c] for c in carried),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                words = C.words_of(part.column("_text"), C.SPACED)
                gone = np.zeros(len(words.row) + 1, np.int32)
                lists = part.column("_spans")
                size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                ends = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                base = np.repeat(words.first, size)
                np.add.at(gone, base + ends[:, 0], 1)
                np.add.at(gone, base + ends[:, 1], -1)
                keep = np.cumsum(gone[:-1]) == 0
                left = np.bincount(words.row[keep], minlength=len(words.count))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in carried),
                        pa.array(words.count.astype(np.int64)),
                        pa.array(words.count - left),
                        C.joined(words, keep).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return docs.select(*carried, "_text", "_spans").mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    group_rows: int = GROUP_ROWS,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: key, carried columns, n_words, n_removed, kept (words left, joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller key. Keys are integers. A row with a null key neither loses
    words nor makes others lose them; rows with equal keys do not count as
    earlier than each other. Null and empty texts have no words; an empty table
    gives no rows; columns that are not
    ``carried`` are not read.
    """
    C.small_batches(docs.sparkSession)
    out = list(dict.fromkeys([key, *carried]))
    rows = docs.select(
        *out,
        F.col(key).cast("long").alias("_doc"),
        F.hash(text).alias("_copy"),
        F.col(text).alias("_text"),
    )
    known = rows.where(F.col("_doc").isNotNull())
    spans = C.keep(
        repeated_spans(known.select("_doc", "_copy", "_text"), window, gram, group_rows), "spans"
    )
    held = id_filter(spans, "_doc")
    touched = passing(rows, held, "_doc").join(spans, ["_doc", "_copy"], "left")
    others = passing(rows, held, "_doc", maybe=False).withColumn("_spans", F.lit(None).cast("array<array<int>>"))
    columns = [*out, "_text", "_spans"]
    return _rebuild(touched.select(columns), out).unionByName(_rebuild(others.select(columns), out))
