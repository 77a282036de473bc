"""Near-duplicates by BagMinHash: weighted Jaccard over multisets of five-word shingles.

*Signature.* Each shingle of a text has its number of occurrences as weight. The
weight axis is cut at 1, 2, 4, 8, ...; every shingle and every stretch of the
axis has its own Poisson process of rate as long as the stretch, a function of
both alone. A point has a time, a slot of the signature and a place within the
stretch, and counts if that place lies below the weight. A slot keeps the
earliest point that counts: two texts agree in a slot with the probability of
their weighted Jaccard similarity. Points are drawn up to the time by which all
slots are filled, so most shingles are done after their first one, and a
weight of ``w`` costs about ``log2 w`` processes.

*Candidates.* A slot is kept as 16 bits, and slots are banded: texts that agree in all
slots of a band are in one bucket. Of buckets with the same members only the first
stays, and a pair is looked at in the first band that it shares, so once.

*Verification.* Members of a bucket meet in groups of bounded size, with their signatures
and the hashes of their shingles. A group goes over its members one after another: those
of other classes, of similar size, that agree in enough slots are compared exactly, as
multisets of shingles, and linked ones become one class at once. A group returns
links between classes only, at most one less than it has members; pairs are never
written or moved.

*Classes* are connected components, found by alternating star contractions over
tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import common as C
from docloom.operators.id_filters import id_filter, passing

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Shingles of the members of a bucket that meet as many others in one group, on average at most.
BLOCK_SHINGLES = 1 << 20
#: Standard deviations below its mean of the slots that a pair at the threshold agrees in.
DEVIATIONS = 6.5
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1


def shingles(words: C.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of occurrences of the distinct shingles of each text.

    A text of fewer words than a shingle, but not none, is one shingle.
    """
    h = words.hashes()
    row, gram = [], []
    at = np.flatnonzero(C.whole(words.row, size))
    row.append(words.row[at])
    gram.append(C.grams(h, size)[at])
    for n in range(1, size):
        short = np.flatnonzero(words.count == n)
        if len(short):
            row.append(short)
            gram.append(C.grams(h, n)[words.first[short]])
    rows, hashes = np.concatenate(row), np.concatenate(gram)
    if not len(rows):
        return rows, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])))
    begin = np.flatnonzero(new)
    return rows[begin], hashes[begin], np.diff(begin, append=len(rows))


def _draw(
    row: np.ndarray, gram: np.ndarray, weight: np.ndarray, until: np.ndarray, slots: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell (row * slots + slot), time and id of all points that count, up to each row's time."""
    row_, seed, low, rate, weight_ = [row], [C.mixed(gram)], [np.zeros(len(row))], [np.ones(len(row))], [weight]
    level, rest = 1, np.flatnonzero(weight > 1)
    while len(rest):  # the stretch from 2**(level - 1) to 2**level
        row_.append(row[rest])
        seed.append(C.mixed(gram[rest] + np.uint64(int(_GOLD) * level & _WORD)))
        low.append(np.full(len(rest), 2.0 ** (level - 1)))
        rate.append(np.full(len(rest), 2.0 ** (level - 1)))
        weight_.append(weight[rest])
        rest = rest[weight[rest] > 2**level]
        level += 1
    r, e, lo, speed, w = (np.concatenate(x) for x in (row_, seed, low, rate, weight_))
    time = np.zeros(len(r))
    cells, times, ids = [], [], []
    number = 0
    while len(r):
        number += 1
        x = C.mixed(e + np.uint64(int(_GOLD) * number & _WORD))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / speed
        go = time <= until[r]
        r, e, lo, speed, w, time, x = r[go], e[go], lo[go], speed[go], w[go], time[go], x[go]
        y = C.mixed(x ^ _GOLD)
        place = lo + np.floor((y >> np.uint64(32)).astype(np.float64) * 2.0**-32 * speed)
        good = place < w
        cells.append(r[good] * slots + (y[good] & np.uint64(0xFFFFFFFF)).astype(np.int64) % slots)
        times.append(time[good])
        ids.append(x[good])
    return np.concatenate(cells), np.concatenate(times), np.concatenate(ids)


def signatures(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """BagMinHash of each row that has shingles; rows without any stay 0."""
    total = np.bincount(row, weight, rows)
    until = slots * (np.log(slots) + 3) / np.maximum(total, 1)
    out = np.zeros((rows, slots), np.uint64)
    open_ = total > 0
    while open_.any():
        mine = open_[row]
        cell, time, ids = _draw(row[mine], gram[mine], weight[mine], until, slots)
        least = np.full(rows * slots, np.inf)
        np.minimum.at(least, cell, time)
        first = time == least[cell]
        done = open_ & np.isfinite(least.reshape(rows, slots)).all(axis=1)
        held = np.zeros(rows * slots, np.uint64)
        held[cell[first]] = ids[first]
        out[done] = held.reshape(rows, slots)[done]
        open_ &= ~done
        until = until * 2
    return out


def _signed(docs: DataFrame, shingle: int, slots: int) -> DataFrame:
    """_doc, _hash, n (shingles) and sign (two bytes a slot) of the texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text", C.STEP_BYTES // 2):
                words = C.words_of(part.column("_text"), C.SPACED)
                row, gram, weight = shingles(words, shingle)
                n = len(words.count)
                total = np.bincount(row, weight, n).astype(np.int64)
                have = np.flatnonzero(total)
                signed = signatures(row, gram, weight, n, slots)[have].astype(np.uint16)
                offsets = pa.py_buffer((np.arange(len(have) + 1) * 2 * slots).astype(np.int32))
                held = [None, offsets, pa.py_buffer(np.ascontiguousarray(signed))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_doc").take(pa.array(have)),
                        part.column("_hash").take(pa.array(have)),
                        pa.array(total[have].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(have), held),
                    ],
                    names=["_doc", "_hash", "n", "sign"],
                )

    return docs.mapInArrow(run, "_doc long, _hash long, n int, sign binary")


def _bags(docs: DataFrame, shingle: int) -> DataFrame:
    """_doc, _hash and bag: the ascending hashes of its shingles; the k-th occurrence of one has a hash of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                words = C.words_of(part.column("_text"), C.SPACED)
                row, gram, weight = shingles(words, shingle)
                number = (C.spans(np.zeros(len(weight), np.int64), weight)).astype(np.uint64)
                row, gram = np.repeat(row, weight), C.mixed(np.repeat(gram, weight) + number * _GOLD)
                gram = gram[np.lexsort((gram, row))]
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))
                ids = [part.column("_doc"), part.column("_hash")]
                yield pa.RecordBatch.from_arrays([*ids, held], names=["_doc", "_hash", "bag"])

    return docs.mapInArrow(run, "_doc long, _hash long, bag array<long>")


def least_agreement(slots: int, threshold: float) -> int:
    """Slots in which a pair at the threshold agrees, but for one in 10**10 of such pairs."""
    spread = (slots * threshold * (1 - threshold)) ** 0.5
    return max(1, int(slots * threshold - DEVIATIONS * spread))


def group_links(
    part: pa.Table, bands: int, rows: int, threshold: float, every: bool
) -> tuple[list[int], list[int]]:
    """Links that join the members of a group into its classes; ``every``: also within a block."""
    m = part.num_rows
    doc, n, band, mine = (part.column(c).to_numpy() for c in ("_doc", "n", "band", "mine"))
    sign = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.uint16).reshape(m, bands * rows)
    bags = part.column("bag").combine_chunks()
    flat = bags.flatten().to_numpy().view(np.uint64)
    first = np.concatenate(([0], np.cumsum(bags.value_lengths().to_numpy())))
    enough = least_agreement(bands * rows, threshold)
    root = np.arange(m)
    one, two = [], []
    for i in range(m - 1):
        fits = np.minimum(n[i + 1 :], n[i]) >= (threshold - 1e-9) * np.maximum(n[i + 1 :], n[i])
        fits &= (root[i + 1 :] != root[i]) & (band[i + 1 :] == band[i])
        if not every:
            fits &= mine[i + 1 :] != mine[i]
        other = np.flatnonzero(fits) + i + 1
        if not len(other):
            continue
        same = sign[other] == sign[i]
        shared = same.reshape(len(other), bands, rows).all(axis=2)
        here = shared[:, band[i]] & (shared.argmax(axis=1) == band[i]) & (same.sum(axis=1) >= enough)
        other = other[here]
        if not len(other):
            continue
        own = flat[first[i] : first[i + 1]]
        size = first[other + 1] - first[other]
        theirs = flat[C.spans(first[other], size)]
        at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        common = np.add.reduceat(own[at] == theirs, np.cumsum(size) - size, dtype=np.int64)
        whole = len(own) + size - common
        for j in other[common >= (threshold - 1e-9) * whole].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                one.append(doc[i])
                two.append(doc[j])
    return one, two


def _linked(dealt: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Links (a, b) of all groups (key, p, q); a group is held as a whole, and no more of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch:
            group = pa.Table.from_batches(held)
            every = last[1] == last[2]
            one, two = group_links(group, bands, rows, threshold, every) if group.num_rows > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")], 1)
            cut = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for begin, end in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
                name = tuple(names[begin].tolist())
                if held and name != last:
                    yield close()
                    held = []
                last = name
                held.append(batch.slice(begin, end - begin))
        if held:
            yield close()
        C.give_back()

    ordered = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return ordered.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component."""

    def sides(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    held = C.keep(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "links")
    before = mark(held)
    while True:
        # Larger neighbours of every node go to the least of its neighbourhood.
        near = sides(held)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Then each node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        held = C.keep(small, "links")
        after = mark(held)
        if after == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicate_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: key and ``class_id``, the least key of its class.

    Texts are linked if the weighted Jaccard similarity of their shingle multisets is
    at least ``threshold``; equal texts with words are always in one class. Keys
    are integers; rows that share a key count as one document, in the least of its
    texts' classes. Texts that are
    null or without words are in a class of their own key, rows with a null key have
    the null class. An empty table gives no rows; further columns are not read.
    """
    C.small_batches(docs.sparkSession)
    wordy = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    rows_ = docs.select(
        F.col(key).cast("long").alias("_doc"),
        F.when(wordy, F.unhex(F.sha2(text, 256))).alias("_same"),
        F.col(text).alias("_text"),
    )
    known = rows_.where(F.col("_doc").isNotNull())
    texts = known.select("_doc", F.xxhash64("_text").alias("_hash"), "_text")
    copies = known.where(F.col("_same").isNotNull()).select("_doc", "_same", F.xxhash64("_text").alias("_hash"))
    repeated = copies.groupBy("_same").agg(F.min("_doc").alias("first"), F.count("*").alias("times"))
    repeated = C.keep(repeated.where("times > 1").drop("times"), "copies")
    # One document of each text is enough: the others are copies of it.
    member = copies.join(repeated, "_same").where("_doc <> first").select("_doc", "_hash", "first")
    member = C.keep(member.distinct(), "copied")
    signed = C.keep(
        _signed(texts, shingle, bands * rows)
        .join(member.select("_doc", "_hash"), ["_doc", "_hash"], "left_anti")
        .dropDuplicates(["_doc", "_hash"]),
        "signed",
    )
    links = C.keep(_links_of(signed, texts, shingle, bands, rows, threshold), "verified")
    root = components(links)
    copied = member.join(root, member["first"] == root["node"], "left").select(
        "_doc", F.coalesce("root", "first").alias("_class")
    )
    moved = root.select(F.col("node").alias("_doc"), F.col("root").alias("_class")).union(copied)
    best = moved.groupBy("_doc").agg(F.min("_class").alias("_class"))
    out = docs.select(F.col(key), F.col(key).cast("long").alias("_doc"))
    return out.join(best, "_doc", "left").select(key, F.coalesce("_class", "_doc").alias("class_id"))


def _links_of(
    signed: DataFrame, docs: DataFrame, shingle: int, bands: int, rows: int, threshold: float
) -> DataFrame:
    """Links (a, b) between texts that share a band and are similar enough."""
    width = 2 * rows
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    keyed = signed.select("_doc", "_hash", "n", "sign", band).select(
        "_doc", "_hash", "n", "band", F.expr(f"xxhash64(band, substring(sign, {width} * band + 1, {width}))").alias("key")
    )
    buckets = (
        keyed.groupBy("key")
        .agg(
            F.count("*").alias("size"),
            F.sum(F.col("n").cast("long")).alias("words"),
            F.bit_xor(F.xxhash64("_doc", "_hash")).alias("x"),
            F.bit_xor(F.xxhash64("_hash", "_doc")).alias("y"),
            F.min("band").alias("band"),
        )
        .where("size > 1")
    )
    # Buckets with the same members: a pair is looked at in the first band it shares.
    chosen = (
        buckets.groupBy("size", "words", "x", "y")
        .agg(F.min(F.struct("band", "key")).alias("least"))
        .select("least.key", F.ceil(F.col("words") / BLOCK_SHINGLES).alias("blocks"))
    )
    members = C.keep(keyed.join(chosen, "key"), "members")
    ids = members.select("_doc").distinct()
    texts = passing(docs, id_filter(ids, "_doc"), "_doc").dropDuplicates(["_doc", "_hash"])
    entity = ["_doc", "_hash"]
    payload = _bags(texts, shingle).join(signed.select(*entity, "sign"), entity)
    mine = F.pmod(F.xxhash64("_doc", "key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (
        members.join(payload, entity)
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
                "_doc", "n", "band", "mine", "sign", "bag")
    )
    return _linked(dealt, bands, rows, threshold).where("a <> b").distinct()
