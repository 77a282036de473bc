"""Top-k scoring against brute force, on both ways to bring queries to chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import cells, chunking, encoding, lexical, retrieval, scoring


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    x[300:] = x[5]  # a quarter of the table are copies of one vector
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, vectors, name, n=None):
    rows = [
        (i, v.tolist(), ("public", "internal")[i % 2], ("a", "b", "c")[i % 3])
        for i, v in enumerate(vectors[:n])
    ]
    return spark.createDataFrame(
        rows, f"{name} bigint, dense array<float>, acl string, domain string"
    )


def brute(vectors, q, k, allowed=lambda i: True):
    s = scoring.round6(vectors.astype(np.float64) @ vectors[q].astype(np.float64))
    order = sorted((i for i in range(len(vectors)) if allowed(i)), key=lambda i: (-s[i], i))
    return [(i, s[i]) for i in order[:k]]


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def test_dense_matches_brute_force_with_ties(spark, vectors):
    chunks = frame(spark, vectors, "chunk_id").drop("acl", "domain").repartition(5)
    asked = frame(spark, vectors, "query_id", 20).select("query_id", "dense")
    got = collect(retrieval.dense_topk(chunks, asked, 7))
    assert got == {q: brute(vectors, q, 7) for q in range(20)}


def test_blocked_join_equals_broadcast(spark, vectors, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 90)
    monkeypatch.setattr(scoring, "BROADCAST_QUERIES", 6)
    chunks = frame(spark, vectors, "chunk_id").drop("acl", "domain")
    asked = frame(spark, vectors, "query_id", 20).select("query_id", "dense")
    got = collect(retrieval.dense_topk(chunks, asked, 7, broadcast_queries=6))
    assert got == {q: brute(vectors, q, 7) for q in range(20)}


def test_filters_and_default_k(spark, vectors):
    chunks = frame(spark, vectors, "chunk_id").repartition(3)
    asked = frame(spark, vectors, "query_id", 4).select(
        "query_id",
        "dense",
        F.when(F.col("query_id") == 0, "b").when(F.col("query_id") == 1, "").alias("domain"),
        F.when(F.col("query_id") == 2, "internal").alias("acl"),
        F.when(F.col("query_id") == 3, 2).otherwise(0).alias("top_k"),
    )
    got = collect(retrieval.dense_topk(chunks, asked, 5))
    assert got[0] == brute(vectors, 0, 5, lambda i: i % 3 == 1)
    assert got[1] == brute(vectors, 1, 5)
    assert got[2] == brute(vectors, 2, 5, lambda i: i % 2 == 1)
    assert got[3] == brute(vectors, 3, 2)


def test_sparse_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["everywhere"]
    docs = [
        {w: float(rng.integers(1, 5)) for w in rng.choice(words, 6, replace=False)} | {"everywhere": 1.0}
        for _ in range(200)
    ]
    schema = "array<struct<token:string,weight:double>>"
    rows = [(f"c{i:03d}", list(d.items())) for i, d in enumerate(docs)]
    chunks = spark.createDataFrame(rows, f"chunk_id string, terms {schema}").repartition(4)
    asked = spark.createDataFrame(
        [("q1", [("w1", 1.0), ("everywhere", 0.5)]), ("q2", [("w2", 2.0)]), ("q3", [("none", 1.0)])],
        f"query_id string, terms {schema}",
    )
    got = collect(retrieval.sparse_topk(chunks, asked, 9))
    for q, wanted in (("q1", {"w1": 1.0, "everywhere": 0.5}), ("q2", {"w2": 2.0})):
        s = [(f"c{i:03d}", sum(d.get(t, 0) * w for t, w in wanted.items())) for i, d in enumerate(docs)]
        s = sorted((x for x in s if x[1] > 0), key=lambda x: (-x[1], x[0]))[:9]
        assert got[q] == s
    assert "q3" not in got


def test_near_duplicates_fold_copies(spark, vectors):
    got = {
        r["chunk_id"]: (r["duplicate_of"], r["score"])
        for r in retrieval.near_dup_within(frame(spark, vectors, "chunk_id"), 0.9).collect()
    }
    x = vectors.astype(np.float64)
    s = scoring.round6(x @ x.T)
    want = {}
    for i in range(len(x)):
        near = [(-s[i, j], j) for j in range(i) if s[i, j] >= 0.9]
        if near:
            score, j = min(near)
            want[i] = (j, -score)
    assert got == want
    assert got[399][0] == 5


def test_near_duplicates_between_tables(spark, vectors):
    known = frame(spark, vectors, "chunk_id", 50)
    fresh = frame(spark, vectors, "chunk_id").where("chunk_id >= 300")
    got = retrieval.near_dup_chunks(known, fresh, 0.99).collect()
    assert len(got) == 100 and {r["duplicate_of"] for r in got} == {5}


def test_approximate_search_by_cells(spark, vectors, tmp_path, monkeypatch):
    chunks = frame(spark, vectors, "chunk_id").select("chunk_id", "dense")
    asked = frame(spark, vectors, "query_id", 30).select("query_id", "dense")
    exact = {q: brute(vectors, q, 10) for q in range(30)}
    sample = cells.sample_vectors(chunks, 16)
    assert sample.shape == vectors.shape
    centres = cells.fit_cells(sample, 20)
    assert np.allclose((centres * centres).sum(1), 1)
    assert collect(cells.ann_topk(chunks, asked, centres, 10, probes=20)) == exact
    probes = cells.tuned_probes(sample, centres, 0.9, 10)
    assert 1 <= probes < 20
    near = collect(cells.ann_topk(chunks, asked, centres, 10, probes))
    found = sum(len(set(exact[q]) & set(near[q])) for q in exact)
    assert found / 300 >= 0.8
    # Stored by cell: only probed folders are read, with the same result.
    cells.add_cell(chunks, centres).write.partitionBy("cell").parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    one = asked.where("query_id = 3")
    got = cells.ann_topk(stored, one, centres, 10, probes)
    assert collect(got) == {3: near[3]}
    # Cells dealt out over many groups on both sides.
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 7)
    monkeypatch.setattr(scoring, "BROADCAST_QUERIES", 3)
    assert collect(cells.ann_topk(chunks, asked, centres, 10, probes)) == near


def test_cells_of_odd_vectors(spark, vectors):
    """Null, short and repeated vectors, a sample smaller than the cells, none at all, filters."""
    rows = [(i, v.tolist(), "a" if i % 2 else "b") for i, v in enumerate(vectors[:40])]
    rows += [(90, None, "a"), (91, [1.0], "a"), (92, vectors[0].tolist(), "a")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, dense array<float>, domain string")
    centres = cells.fit_cells(cells.sample_vectors(chunks, 16), 64)
    assert len(centres) == 41
    asked = spark.createDataFrame(
        [(1, vectors[0].tolist(), "a"), (2, vectors[0].tolist(), None), (3, None, None), (4, [1.0], None)],
        "query_id bigint, dense array<float>, domain string",
    )
    got = collect(cells.ann_topk(chunks, asked, centres, 2, probes=64))
    assert set(got) == {1, 2} and got[2][:2] == [(0, 1.0), (92, 1.0)] and got[1][0] == (92, 1.0)
    assert all(c % 2 or c == 92 for c, _ in got[1])
    none = cells.fit_cells(cells.sample_vectors(chunks.limit(0), 16), 64)
    assert len(none) == 0 and collect(cells.ann_topk(chunks, asked, none, 2)) == {}
    assert cells.tuned_probes(np.zeros((0, 16)), none) == 1


def test_recall_of_the_registered_search(spark):
    import __spark_entry__ as entry

    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = entry.queries()["ann_recall"](spark, f"/root/testdata/{sf}").collect()
        assert sum(r["found"] for r in rows) >= 0.9 * sum(r["n"] for r in rows), sf


def test_custom_pair_scorer(spark):
    rows = spark.createDataFrame(
        [("q", "a", "hello", "x", 1), ("q", "b", "hello", "xxxx", 2)],
        "query_id string, chunk_id string, query string, text string, rank int",
    )
    got = retrieval.rerank_topk(rows, 1, lambda q, t: F.length(t).cast("double")).collect()
    assert [(r["chunk_id"], r["score"], r["rank"]) for r in got] == [("b", 4.0, 1)]


def test_vectors_of_other_widths_and_null_vectors_never_meet(spark):
    chunks = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0, 0.0]), (4, [0.6, 0.8]), (5, [])],
        "chunk_id bigint, dense array<float>",
    ).coalesce(1)
    asked = spark.createDataFrame(
        [(1, [0.0, 1.0]), (2, [0.0, 1.0, 0.0]), (3, None)], "query_id bigint, dense array<float>"
    )
    got = collect(retrieval.dense_topk(chunks, asked, 5))
    assert got == {1: [(4, 0.8), (1, 0.0)], 2: [(3, 1.0)]}


def test_search_over_all_domains_finds_the_last_chunk_of_a_long_document(spark):
    """The README example: chunk, encode and search three domains; nothing is capped."""
    tail = "zanzibar quokka marmalade"
    long = "\n\n".join(f"# Part {i}\n\nSentence number {i} says little." for i in range(150))
    docs = spark.createDataFrame(
        [("g", "general", long + f"\n\n# End\n\nAt last {tail}."), ("f", "financial", f"Revenue of {tail} rose."),
         ("m", "medical", f"# Plan\n\nTake {tail} daily.")],
        "document_id string, domain string, content string",
    )
    chunks = encoding.add_vectors_by_domain(chunking.chunk_documents(docs))
    asked = spark.createDataFrame(
        [(1, tail, None), (2, tail, "medical")], "query_id bigint, query string, domain string"
    )
    got = retrieval.hybrid_search(chunks, retrieval.with_vectors_by_domain(asked)).collect()
    found = lambda q: {r["document_id"] for r in got if r["query_id"] == q and r["score"] > 0.9}
    assert found(1) == {"g", "f", "m"} and found(2) == {"m"}
    assert max(r["chunk_index"] for r in got if r["document_id"] == "g") > 200


def test_open_queries_count_every_chunk(spark):
    chunks = spark.createDataFrame(
        [("1", d, "public", "narrative", "x") for d in ("legal", None, "general")],
        "chunk_id string, domain string, acl string, chunk_type string, document_id string",
    )
    asked = spark.createDataFrame(
        [(1, None, None, None, None), (2, "general", None, None, None), (3, None, "x", ["public"], None)],
        "query_id bigint, domain string, document_id string, acl array<string>, chunk_types array<string>",
    )
    got = {r["query_id"]: r["n_candidates"] for r in retrieval.filtered_candidates(chunks, asked).collect()}
    assert got == {1: 3, 2: 1, 3: 3}


@pytest.mark.parametrize("slices", [2, 7, 4096])
def test_quantiles_of_any_range(spark, slices):
    rng = np.random.default_rng(11)
    cases = [
        rng.normal(size=300), rng.lognormal(0, 40, size=300), np.repeat([1.0, 2.0, 3.0], [200, 1, 99]), np.zeros(5),
        np.array([-1e308, 1e308, 5.0, 5.0]), np.array([-2.0, np.nextafter(-2.0, 0), 0.0, 5e-324, 1e-323]), [7.0],
    ]
    for values in cases[:: 1 if slices == 7 else 3]:
        rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
        held = spark.createDataFrame(rows, "v double").coalesce(2)
        for share in (0.5, 0.99):
            want = float(np.sort(values)[int(np.ceil(len(values) * share)) - 1])
            assert encoding.exact_quantile(held, share, slices) == want
    assert encoding.exact_quantile(held.limit(0), 0.5, slices) is None


def test_quantised_odd_vectors(spark):
    rows = [(1, [100.0, -50.0]), (2, [None, 25.0]), (3, None), (4, [])]
    odd = spark.createDataFrame(rows, "id long, dense array<double>")
    got = {r["id"]: (r["clip"], r["quantised"]) for r in encoding.quantise_int8(odd, "id", quantile=1.0).collect()}
    assert got == {1: (100.0, [127, -64]), 2: (100.0, [None, 32]), 3: (100.0, None), 4: (100.0, [])}
    flat = encoding.quantise_int8(odd.select("id", F.array(F.lit(0.0)).alias("dense")), "id").collect()
    assert {tuple(r["quantised"]) for r in flat} == {(0,)}
    none = encoding.quantise_int8(odd.where("id > 2"), "id").collect()
    assert {r["clip"] for r in none} == {None} and none[-1]["quantised"] in (None, [])


def test_bm25_against_brute_force(spark):
    texts = ["a b b c", "b c", "", None, "c c c c d", "a d e f g h", "a A a-a", "zz"]
    asked = [(1, "a b"), (2, "c c d"), (3, "nothing"), (4, None)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    gone = spark.createDataFrame([(99, "zz b old"), (98, None)], "chunk_id bigint, text string")
    statistics = lexical.merge_statistics(
        lexical.term_statistics(chunks.unionByName(gone)), lexical.term_statistics(gone, removed=True)
    )
    held = {r["token"]: (r["chunks"], r["tokens"]) for r in statistics.collect()}
    assert held[None] == (8, 22) and held["a"] == (3, 6) and "old" not in held
    words = [(t or "").lower().replace("-", " ").split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    want = set()
    for q, query in asked:
        scores = []
        for i, w in enumerate(words):
            score = 0.0
            for token in (query or "").split():
                df, n = sum(token in x for x in words), w.count(token)
                score += np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score > 0:
                scores.append((-round(score, 6), i))
        want |= {(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:3], 1)}
    got = lexical.bm25_topk(chunks, queries, statistics, 3).select("query_id", "chunk_id", "score", "rank").collect()
    assert {(q, i, round(float(s), 5), r) for q, i, s, r in want} == {(r[0], r[1], round(r[2], 5), r[3]) for r in got}
    assert lexical.bm25_topk(chunks.limit(0), queries, lexical.term_statistics(chunks.limit(0)), 3).count() == 0
