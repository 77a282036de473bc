"""Near-duplicates, repeated spans and decontamination against brute force."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import common as C
from docloom.llm import decontamination, near_duplicates, substrings
from docloom.llm.queries import QUERIES

from .conftest import SENTENCE, odd_documents, plain_words, sha, varied, words


def brute_repeats(rows, n=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i : i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("group_rows", [substrings.GROUP_ROWS, 7, 1])
def test_repeats_match_brute_force(odd, group_rows):
    got = substrings.remove_repeats(odd, group_rows=group_rows)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert Counter(map(tuple, got.collect())) == brute_repeats(odd_documents())


def test_carried_columns_survive(odd):
    got = substrings.remove_repeats(odd.drop("n_words"), carried=("text", "lang"))
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "kept"]
    assert {r.lang for r in got.collect()} == {"en"}


def test_suffixes_are_sorted_with_their_common_words():
    code = np.random.default_rng(3).integers(0, 3, 500)
    at = np.random.default_rng(4).permutation(480)
    order, common = substrings.suffix_order(code, at, 13)
    found = [tuple(code[i : i + 13]) for i in at[order]]
    assert found == sorted(found)
    for i in range(1, len(found)):
        same = [a == b for a, b in zip(found[i - 1], found[i])]
        assert common[i] == (same.index(False) if False in same else 13)


@pytest.mark.parametrize("group_rows", [50, 3])
def test_a_passage_in_very_many_documents(spark, group_rows):
    """A hot prefix over many groups, whose earliest documents must still meet."""
    rows = [(d, f"{' '.join(varied(d, 9))} {SENTENCE} {' '.join(varied(d + 1, 9))} {SENTENCE if d % 3 else ''}") for d in range(1, 200)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=group_rows)
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows)


def test_winnowing_guarantee():
    """Texts that share 13 words have an anchor in common there."""
    shared = SENTENCE.split()[:13]
    for seed in range(20):
        found = []
        for side in (1, 2):
            text = " ".join(varied(seed * 10 + side, 30) + shared + varied(seed * 10 + side + 5, 30))
            w = C.words_of(pa.array([text]), C.SPACED)
            gram = C.grams(w.hashes(), 5)
            found.append(set(gram[np.unique(C.anchors(gram, 9))].tolist()))
        assert found[0] & found[1]


ITEMS = [
    (1, SENTENCE),
    (2, " ".join(SENTENCE.split()[5:20])),
    (3, "One, two THREE!"),
    (4, ""),
    (5, None),
    (6, "same same same same same same same same same same same same same same same"),
    (7, "changed"),
    (7, "changed"),
    (12, " ".join(varied(14, 20000)[5000:5030])),
    (None, "漢字"),
]


def brute_hits(docs, items, n=13):
    out = []
    sides = []
    for item, text in items:
        w = plain_words(text)
        k = min(n, len(w))
        sides.append((item, k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()))
    for doc, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for item, k, windows in sides:
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    if item is not None:
                        ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), tuple(sorted(ids))))
    return Counter(out)


def test_decontamination_matches_brute_force(spark, odd):
    bench = spark.createDataFrame(
        [(a, b, "x") for a, b in ITEMS], "item_id long, text string, doc_id string"
    )
    got = decontamination.decontaminate(odd, bench).collect()
    want = brute_hits(odd_documents(), ITEMS)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in got) == want


def test_short_items_do_not_multiply_the_memory_of_a_step():
    """Every short length looks at every position, but only wanted fingerprints are held."""
    words_ = C.words_of(pa.array([" ".join(varied(3, 10007))] * 12), C.PLAIN)
    short = list(range(1, decontamination.WINDOW))
    asked = []

    def wanted(kind, hashes, row):
        asked.append((kind, len(hashes)))
        return (hashes & np.uint64(1023)) == 0

    tracemalloc.start()
    found = decontamination.Fingerprints(words_, decontamination.WINDOW, decontamination.GRAM, short, wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 8 * len(words_.code)
    assert [k for k, _ in asked] == [decontamination.WINDOW, *short]
    assert [n for _, n in asked[1:]] == [12 * (10007 - k + 1) for k in short]
    for k in short:
        own = found.kind == k
        grams = C.grams(words_.hashes(), k)
        assert (found.hash[own] == grams[found.at[own]]).all()
        whole = np.flatnonzero(C.whole(words_.row, k))
        assert found.at[own].tolist() == whole[(grams[whole] & np.uint64(1023)) == 0].tolist()


def test_empty_sides(spark, odd, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(odd, none).collect()
    assert len(got) == len(odd_documents()) and not any(r.n_hit for r in got)
    some = spark.createDataFrame([(1, SENTENCE)], "item_id long, text string")
    assert decontamination.decontaminate(no_documents, some).count() == 0
    assert substrings.remove_repeats(no_documents).count() == 0
    assert near_duplicates.near_duplicate_classes(no_documents).count() == 0


def bags(rows):
    found = {}
    for doc, text in rows:
        w = words(text)
        if w and doc is not None:
            found[doc] = Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    return found


def brute_classes(rows):
    held = bags(rows)
    inverted, overlap = defaultdict(list), defaultdict(int)
    for doc, bag in held.items():
        for gram in bag:
            inverted[gram].append(doc)
    for gram, docs in inverted.items():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                overlap[a, b] += min(held[a][gram], held[b][gram])
    root = {d: d for d in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in overlap.items():
        if 5 * both >= 4 * (sum(held[a].values()) + sum(held[b].values()) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {doc: find(doc) if doc in root else doc for doc, _ in rows}


def test_classes_match_brute_force(odd):
    want = brute_classes(odd_documents())
    got = near_duplicates.near_duplicate_classes(odd).collect()
    assert len(got) == len(odd_documents())
    assert all(r.class_id == want[r.doc_id] for r in got)
    assert want[3] == 1 and want[139] == 100 and want[10] == 9


def test_registered_classes_match_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_classes(rows)
    got = dict(map(tuple, QUERIES["op6_bagminhash_near_duplicates"](spark, small).collect()))
    assert got == want


def test_signatures_estimate_weighted_similarity():
    """Slots agree as often as the multisets overlap, heavy weights included."""
    slots, hits, want = 128, 0, []
    random = np.random.default_rng(5)
    for _ in range(30):
        gram = random.integers(0, 2**63, 40).astype(np.uint64)
        one, two = random.integers(1, 60, 40), random.integers(1, 60, 40)
        row = np.repeat([0, 1], 40)
        sign = near_duplicates.signatures(row, np.tile(gram, 2), np.concatenate([one, two]), 2, slots)
        hits += int((sign[0] == sign[1]).sum())
        want.append(np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(hits / (30 * slots) - np.mean(want)) < 0.03


def test_chain_of_links_is_one_class(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 30)] + [(100, 90)], "a long, b long")
    got = dict(map(tuple, near_duplicates.components(edges).collect()))
    assert all(got[i] == 1 for i in range(2, 31)) and got[100] == 90


def test_digest_of_kept_words(spark, small):
    got = QUERIES["op5_substring_dedup"](spark, small).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, gone, sha(kept)) for d, n, gone, kept in brute_repeats(rows)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_links_behind_leaders_that_resemble_nobody(spark):
    """A base in the middle and independently edited copies: most are similar to few others."""
    drawn = np.random.default_rng(11)
    base = [f"w{i}" for i in range(404)]
    rows = [(70, " ".join(base))]
    for doc in [d for d in range(1, 141) if d != 70]:
        copy = list(base)
        for at in drawn.choice(404, drawn.integers(4, 15), replace=False):
            copy[at] = f"{doc}x{at}"
        rows.append((doc, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, near_duplicates.near_duplicate_classes(docs).collect()))
    want = brute_classes(rows)
    assert 40 < Counter(want.values()).most_common(1)[0][1] < 140
    assert got == want


@pytest.mark.parametrize("block", [near_duplicates.BLOCK_SHINGLES, 900])
def test_every_link_of_a_bucket_in_blocks(spark, monkeypatch, block):
    """One base and many edited copies, around the threshold: buckets of one or many blocks give the same classes."""
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", block)
    drawn = np.random.default_rng(3)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for doc in range(1, 161):
        copy = list(base)
        for at in drawn.choice(130, drawn.integers(0, 7), replace=False):
            copy[at] = f"{doc % 23}x{at}"
        rows.append((doc, " ".join(copy)))
    rows += [(3, rows[50][1]), (3, "another text of the third document altogether"), (None, rows[9][1])]
    docs = spark.createDataFrame(rows[:160], "doc_id long, text string")
    got = dict(map(tuple, near_duplicates.near_duplicate_classes(docs).collect()))
    want = brute_classes(rows[:160])
    assert got == want and len(set(want.values())) > 3
    again = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(again) == len(rows) and [r.class_id for r in again if r.doc_id is None] == [None]


def test_two_thousand_edited_copies(spark):
    """Most are similar to few others at 0.6 to 0.9; against all pairs by a matrix of shingles."""
    drawn = np.random.default_rng(17)
    base = [f"w{i}" for i in range(104)]
    rows = []
    for doc in range(2000):
        copy = list(base)
        for at in drawn.choice(104, drawn.integers(0, 8), replace=False):
            copy[at] = f"{doc % 300}x{at}"
        rows.append((doc, " ".join(copy)))
    names = {}
    held = np.zeros((2000, 100), np.int32)
    for doc, text in rows:
        w = text.split()
        held[doc] = [names.setdefault(tuple(w[i : i + 5]), len(names)) for i in range(100)]
    # The i-th shingle stands at the same place in all copies: common ones are equal columns.
    root = np.arange(2000)
    for i in range(2000):
        common = (held == held[i]).sum(1)
        for j in np.flatnonzero(5 * common >= 4 * (200 - common)):
            if root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    got = dict(map(tuple, near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == dict(enumerate(root.tolist()))
    assert 5 < len(set(root.tolist())) < 1990


def test_registered_classes_at_a_larger_scale(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(map(tuple, QUERIES["op6_bagminhash_near_duplicates"](spark, sf).collect())) == brute_classes(rows)
