"""Source divergence, centroid clusters and toxicity against brute force and held-out labels."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import clusters, divergence, toxicity
from docloom.llm import common as C
from docloom.llm.pointer_terms import LETTERS, equal_runs, pointer_sort, pointers
from docloom.llm.queries import QUERIES

from .conftest import UPPER, odd_documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def shard(texts):
    off, buf = C.utf8(pa.array(texts))
    return off, C.LOWER[buf]


def test_pointers_are_sorted_by_their_words():
    drawn = random.Random(3)
    parts = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghz", "é", "ä", "Ü", "x" * 30, "漢字"]
    texts = [" ".join(drawn.choices(parts, k=60)) for _ in range(40)] + ["", None, "1 2 _ ^"]
    off, buf = shard(texts)
    start, length, row = pointers(off, buf, LETTERS)
    order, fresh = pointer_sort(buf, start, length)
    found = [bytes(buf[start[i] : start[i] + length[i]]) for i in order]
    assert found == sorted(found)
    assert fresh.tolist() == [True] + [a != b for a, b in pairwise(found)]
    assert Counter(row.tolist()) == Counter({i: len(terms(t)) for i, t in enumerate(texts) if terms(t)})


def test_equal_runs_count_terms_of_each_text():
    texts = [t for _, t in odd_documents()]
    off, buf = shard(texts)
    held = equal_runs(off, buf, LETTERS)
    got = {(w, r): n for w, r, n in zip(held.strings(buf, held.run).to_pylist(), held.row.tolist(), held.times.tolist())}
    assert got == Counter((w, i) for i, t in enumerate(texts) for w in terms(t))


def brute_divergence(rows, least=30, smoothing=5, scale=10**9, top=50):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        count[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    out = set()
    for lang, source in groups:
        kept = sorted(w for w, n in df[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(of, kept=kept):
            total = sum(of[w] for w in kept)
            return {w: 1 + scale * (of[w] + smoothing) // (total + smoothing * len(kept)) for w in kept}

        own = shares(count[lang, source])
        every = shares(sum((count[lang, s] for s in sources), Counter()))
        far = {s: sum(abs(own[w] - p) for w, p in shares(count[lang, s]).items()) for s in sources if s != source}
        above = {w: own[w] - every[w] for w in kept if count[lang, source][w] and own[w] > every[w]}
        for part, values, limit in (("pair", far, None), ("term", above, top)):
            ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit]
            out |= {(lang, source, part, item, value, n) for n, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize(("tile", "per_block"), [(64, 4096), (2, 3)])
def test_divergence_matches_brute_force(spark, monkeypatch, tile, per_block):
    """Null and empty columns, repeated rows, a language without kept terms, many tiles and blocks."""
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", per_block)
    drawn = random.Random(5)
    names = ["aa", "b", "Ünter", "ünter", "zoo", "cat", "Cat", "dog", "漢", "longerthaneight", "longerthanseven"]
    rows = [
        (drawn.choice(["en", "de", None, ""]), drawn.choice(["s1", "s2", "s3", "s4", "s5", None]), " ".join(drawn.choices(names, k=drawn.randint(0, 9))))
        for _ in range(300)
    ]
    rows += [("xx", "s1", "rare"), ("xx", "s2", None), ("en", "s9", None), ("en", "s1", "b b b")] + rows[:20]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "lang string, source string, text string, term string, n int")
    got = divergence.source_divergence(df, min_documents=4, top=3)
    assert [f.dataType.simpleString() for f in got.schema] == ["string"] * 4 + ["bigint", "int"]
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, least=4, top=3)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_stay_exact_for_large_counts(spark):
    n = 5 * 10**11
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(n * 7 + 3), F.lit(11).cast("long"), 10**9, 5)).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (n * 7 + 3 + 55)


def brute_clusters(rows, k, rounds, dims, seed=1):
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(mine[j]) for x in zip(*mine[j])] if mine[j] else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    spread = Counter()
    for _, j, d in found:
        spread[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, spread[j], sum(spread.values()), sha[j]) for i, j, d in found)


def test_orchard_search_is_exact_with_ties():
    drawn = np.random.default_rng(2)
    for k, dims, wide in ((1, 4, 3), (7, 2, 2), (40, 3, 4), (200, 8, 50)):
        centres = drawn.integers(-wide, wide + 1, (k, dims))
        vectors = drawn.integers(-wide, wide + 1, (500, dims))
        best, far = clusters.Orchard(centres).nearest(vectors)
        every = ((vectors[:, None, :] - centres[None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all()  # the first of equally near ones
        assert (far == every.min(1)).all()


def test_clusters_match_brute_force(spark):
    """Wrong lengths, nulls, not finite components, equal vectors, null and repeated keys."""
    drawn = random.Random(9)
    rows = [(i, [drawn.choice([-1.0, -0.26, 0.0, 0.3, 0.51]) for _ in range(3)]) for i in range(120)]
    rows += [(5, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), (None, [9.0, 9.0, -9.0])] + rows[:9]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, 2.0, None]), (204, [1.0, float("nan"), 0.0]), (205, [1.0, float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, cluster string")
    for k in (5, 40):
        got = clusters.centroid_clusters(df, clusters=k, dimensions=3)
        single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        assert Counter(tuple(r) for r in got.collect()) == brute_clusters(single, k, 3, 3)
    assert clusters.centroid_clusters(df.where("vec_id between 200 and 205"), dimensions=3).count() == 0
    assert clusters.centroid_clusters(df.limit(0), dimensions=3).count() == 0


def test_label_model_finds_accuracies_and_dependent_voters():
    drawn = np.random.default_rng(1)
    n = 4000
    truth = drawn.random(n) < 0.4
    right = [0.9, 0.8, 0.7, 0.85]
    fired = np.stack([np.where(drawn.random(n) < r, truth, ~truth) for r in right], 1)
    copy = np.where(drawn.random((n, 2)) < 0.97, fired[:, [2, 2]], ~fired[:, [2, 2]])  # two echoes of the worst voter
    fired = np.concatenate([fired, copy], 1)
    label = np.where(np.arange(n) < 400, truth, -1).astype(int)
    model = toxicity.label_model(fired, label)
    guess = model.posterior(fired)
    found = model.accuracy(fired, guess, np.ones(6, bool))
    want = (fired & truth[:, None]).sum(0) / fired.sum(0)
    assert np.abs(found - want).max() < 0.06
    joined = {frozenset((j, p)) for j, p in enumerate(model.parent.tolist()) if p >= 0 and model.dependence[j] > 0.1}
    assert joined == {frozenset((2, 4)), frozenset((2, 5))} or len(joined) == 2 and joined <= {
        frozenset(p) for p in ((2, 4), (2, 5), (4, 5))
    }
    every = {tuple(v): None for v in fired}
    # Against the posterior of the true model: the echoes must not outvote the better voters.
    best = {v: np.mean(truth[(fired == v).all(1)]) for v in every if (fired == v).all(1).sum() > 150}
    for v, share in best.items():
        assert abs(model.posterior(np.array([v]))[0] - share) < 0.12
    alone = (guess >= 0.5) == truth
    assert alone.mean() > 0.93 * max(((np.where(fired[:, j], 1, 0) == truth).mean() for j in range(6)), default=0) and alone.mean() > 0.9


def test_inputs_equal_plain_counts():
    texts = ["Idiot idiot you ABCDEFGHIJ abcdefghij! ", "", None, "1 2 3", "Über über straße", "x"]
    row, name, value = toxicity.features(pa.array(texts))
    got = {(r, f): v for r, f, v in zip(row.tolist(), name.tolist(), value.tolist())}
    want = Counter()
    for i, t in enumerate(texts):
        for w in terms(t):
            b = w.encode()
            for size, part in [(0, b)] + [(k, b[:k]) for k in toxicity.BEGINNINGS if len(b) > k]:
                want[size, i, C.xxh64_intdigest(part, size) % toxicity.WORD_BUCKETS] += 1
    per = Counter()
    for (_, i, f), n in want.items():
        per[i, f] += math.sqrt(n / len(terms(texts[i])))
    plain = {k: v for k, v in got.items() if k[1] < toxicity.WORD_BUCKETS}
    assert plain.keys() == per.keys() and all(abs(plain[k] - per[k]) < 1e-6 for k in plain)
    insults = toxicity.WORD_BUCKETS + toxicity.STATISTICS.index("insults")
    assert got[0, insults] == pytest.approx(math.sqrt(2 / 5))
    assert (3, insults) not in got


def test_scores_recomputed_word_by_word(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    classifier = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op13_weak_supervision_toxicity"](spark, small).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        _, name, value = toxicity.features(pa.array([text[i]]))
        raw = classifier.bias + sum(classifier.weights[n] * v for n, v in zip(name.tolist(), value.tolist()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-6)
        assert r.predicted == (r.score >= 0.3)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op13_weak_supervision_toxicity"](spark, sf).where("held_out")
    both = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in both) / len(both)
    caught = sum(r.predicted for r in both if r.toxic) / sum(r.toxic for r in both)
    wrong = sum(r.predicted for r in both if not r.toxic) / sum(not r.toxic for r in both)
    assert right > 0.98 and caught > 0.9 and wrong < 0.01


def test_toxicity_of_odd_rows(spark, odd, no_documents):
    labels = spark.createDataFrame(
        [(d, int(d in (12, 13)), "x") for d, _ in odd_documents() if d is not None] + [(None, 1, "x"), (3, None, "x"), (12, 0, "x")],
        "doc_id long, toxic int, text string",
    )
    classifier = toxicity.train(odd, labels)
    got = toxicity.score(odd, classifier).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in odd_documents())
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_documents, classifier).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        blank = toxicity.train(odd, none)
        assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.5}
    assert {r.score for r in toxicity.score(odd, toxicity.train(no_documents, labels)).collect()} == {0.5}
