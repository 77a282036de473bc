"""Tables that are folders of files, and steps whose size is bounded."""

import os
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom import session
from docloom.functions import vectors
from docloom.operators import encoding, scoring
from docloom.plans.queries import QUERIES


def in_folders(spark, tmp_path, **tables):
    """The tables as folders of several files, like Spark writes them."""
    for name, rows in tables.items():
        rows.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def talk(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"One {c}. Two {t}. Take 20 mg.") for c in range(5) for t in range(3)]
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")


def test_answers_of_a_table_in_a_folder(spark, tmp_path):
    sf = in_folders(spark, tmp_path, conversations=talk(spark))
    got = QUERIES["stream_answers"](spark, sf).collect()
    assert sorted(r["request_id"] for r in got) == sorted(f"{c}:{t}" for c in range(5) for t in range(3))


def test_ingest_of_a_table_in_a_folder(spark, tmp_path):
    rows = [(d, "en" if d % 2 else "fr", f"Some text of {d}. More of it.\n\nAnd an end.") for d in range(7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = QUERIES["stream_ingest"](spark, in_folders(spark, tmp_path, documents=docs)).collect()
    assert {r["document_id"] for r in got} == {f"doc-{d}" for d in range(7)}


def common_terms(chunks, queries, terms):
    """A batch of chunks and a block of queries that all have the same terms."""
    token = [f"t{i:03}" for i in range(terms)]
    held = lambda n, name, c: pa.table(
        {name: list(range(n)), "terms": [[{"token": t, "weight": c + i + n % 7} for t in token] for i in range(n)]},
        schema=pa.schema(
            {name: pa.int64(), "terms": pa.list_(pa.struct({"token": pa.string(), "weight": pa.float64()}))}
        ),
    )
    return held(chunks, "chunk_id", 1.0), scoring.QueryBlock(held(queries, "query_id", 2.0), 5, pa.int64())


def test_sparse_scores_of_common_terms_stay_small():
    batch, block = common_terms(2000, 100, 50)
    for weights in (block.weights, None):
        block.weights = weights
        tracemalloc.start()
        got = block.sparse_scores(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # Ten million products of terms, of eight bytes in each of several arrays.
        assert peak < 80e6
        want = 50 * np.outer(1.0 + np.arange(2000) + 2000 % 7, 2.0 + np.arange(100) + 100 % 7)
        assert np.allclose(got, want)


def test_sparse_scores_in_small_steps(monkeypatch):
    monkeypatch.setattr(scoring, "TILE_LINKS", 7)
    monkeypatch.setattr(scoring, "TILE_CELLS", 5)
    batch, block = common_terms(9, 4, 3)
    assert block.weights is None
    want = 3 * np.outer(1.0 + np.arange(9) + 2, 2.0 + np.arange(4) + 4)
    assert np.allclose(block.sparse_scores(batch), want)


def in_clusters(rng, rows, width):
    """Non-negative unit vectors around a few directions, some of them nearly equal, one longer than the rest."""
    x = np.abs(rng.normal(size=(6, width)))[rng.integers(0, 6, rows)] + 0.3 * np.abs(rng.normal(size=(rows, width)))
    x[rows // 2 :: 3] = x[: len(x[rows // 2 :: 3])] * (1 + 0.01 * rng.normal(size=(len(x[rows // 2 :: 3]), 1)))
    x[::5] += 0.02 * rng.normal(size=x[::5].shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[3] *= 1.5
    return x


def test_close_pairs_are_those_of_all_products():
    rng = np.random.default_rng(3)
    for width, odd in ((300, None), (300, np.nan), (64, None)):
        left, right = in_clusters(rng, 1500, width), in_clusters(rng, 1300, width)
        right[:400] = left[:400] + 0.01 * rng.normal(size=(400, width))
        if odd is not None:
            left[7, 5] = odd
        for threshold in (0.97, 0.999):
            scores = scoring.round6(left @ right.T)
            want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(scores >= threshold)))}
            got = [x for part in scoring._close_pairs(left, right, threshold) for x in zip(*(c.tolist() for c in part))]
            assert {(i, j) for i, j, _ in got} == want and len(got) == len(want)
            assert all(abs(s - scores[i, j]) < 2e-6 for i, j, s in got)


def test_near_duplicates_compare_few_vectors_in_full(spark, monkeypatch):
    """Blocks meet once, widths stay apart, and names may be text or repeat."""
    x = in_clusters(np.random.default_rng(4), 300, 250).round(3)
    rows = [(f"c{i:03}", x[i].tolist() if i % 10 else x[i, :200].tolist()) for i in range(300)]
    rows += [rows[5], ("c000", None), (None, rows[6][1])]
    frame = spark.createDataFrame(rows, "chunk_id string, dense array<double>")
    want = {}
    for a, u in rows:
        for b, v in rows:
            if a and b and u and v and len(u) == len(v) and b < a:
                score = float(scoring.round6(np.array([np.dot(u, v)]))[0])
                if score >= 0.97:
                    want[a] = min(want.get(a, (0.0, "")), (-score, b))
    for block_rows in (40, 20_000):
        got = {r["query_id"]: (-r["score"], r["chunk_id"]) for r in scoring.closest_before(frame, 0.97, block_rows).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[a][0] - want[a][0]) < 2e-6 for a in want)


def shuffled(spark):
    """Sizes of the shuffle files of the session by name."""
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = [Path(d, f) for top in tops for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")]
    return {f.name: f.stat().st_size for f in found if f.exists()}


def test_near_duplicates_move_vectors_once(spark):
    """However many blocks there are, the shuffle holds one copy of the vectors, and ties go to the smallest id."""
    x = np.random.default_rng(8).normal(size=(300, 250))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[200:] = x[100:200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "chunk_id bigint, dense array<double>")
    held = shuffled(spark)
    got = scoring.closest_before(frame, 0.9, 15).collect()
    moved = sum(size for name, size in shuffled(spark).items() if name not in held)
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in got} == {(i, i - 100, 1.0) for i in range(200, 300)}
    assert moved < 2 * x.nbytes


def test_ingest_moves_documents_and_no_points(spark, tmp_path):
    """What stays in the shuffle is less than the texts; the staged batch goes."""
    rng = np.random.default_rng(9)
    rows = [(d, "en", " ".join(f"w{w}" for w in rng.integers(0, 10**6, 200))) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    sf = in_folders(spark, tmp_path, documents=docs)
    held, staged = shuffled(spark), set(Path(session.shared_dir(spark).removeprefix("file:")).glob("batch-*"))
    got = QUERIES["stream_ingest"](spark, sf)
    moved = sum(size for name, size in shuffled(spark).items() if name not in held)
    assert moved < sum(len(text) for _, _, text in rows) / 4
    assert {r["document_id"] for r in got.collect()} == {f"doc-{d}" for d in range(300)}
    assert set(Path(session.shared_dir(spark).removeprefix("file:")).glob("batch-*")) == staged


def test_blocks_hold_few_rows_each():
    sizes = [(1 << 33, 25), (0, 4), (2 << 33, 3), (3 << 33, 2), (4 << 33, 10)]
    got = scoring._blocks(sizes, 10)
    at = [start + i for start, n in sizes for i in range(n)]
    held = [[x for x in at if low <= x < high] for low, high in got]
    assert sorted(sum(held, [])) == sorted(at) and max(map(len, held)) <= 10 and min(map(len, held)) > 0


def test_pairs_of_different_texts_are_ruled_out_before_exact_products(monkeypatch):
    rng = np.random.default_rng(5)
    left, right = (np.abs(rng.normal(size=(1000, 384))) * (rng.random((1000, 384)) < 0.3) for _ in range(2))
    left, right = (x / np.linalg.norm(x, axis=1)[:, None] for x in (left, right))
    rounded = []
    monkeypatch.setattr(scoring, "round6", lambda x: rounded.append(x.size) or x)
    assert not sum(len(i) for i, _, _ in scoring._close_pairs(left, right, 0.95))
    assert sum(rounded) < 10_000


def test_quantised_vectors_of_one_file_are_dealt_out(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 8)), 9)
    one = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, dense array<double>").coalesce(1)
    coded = encoding.quantise_int8(one, "id", quantile=0.9)
    assert coded.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    clip = float(np.round(np.sort(np.abs(x).ravel())[3599], 6))
    got = {r["id"]: r["quantised"] for r in coded.collect()}
    assert {r["clip"] for r in coded.select("clip").distinct().collect()} == {clip}
    want = np.clip(x, -clip, clip) / clip * 127
    assert all(np.abs(np.array(got[i]) - want[i]).max() <= 0.5 + 1e-9 for i in range(500))


def test_batches_of_search_and_encoding_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def largest():
        rows = spark.range(5000, numPartitions=1).mapInArrow(count, "n long").collect()
        assert sum(r["n"] for r in rows) == 5000
        return max(r["n"] for r in rows)

    texts = spark.createDataFrame([("a", "one two", "general")], "chunk_id string, text string, domain string")
    coded = encoding.add_vectors(texts, "general")
    asked = coded.withColumnRenamed("chunk_id", "query_id")
    steps = [
        lambda: encoding.add_vectors(texts, "general"),
        lambda: encoding.add_vectors_by_domain(texts),
        lambda: encoding.encode_distinct(texts, "general"),
        lambda: scoring.score_topk(coded, asked, ("dense",), 1),
        lambda: scoring.closest_before(coded, 0.5),
    ]
    try:
        for step in steps:
            spark.conf.set(name, "10000")
            step()
            assert largest() <= 2000
        # A smaller limit of the session stays.
        spark.conf.set(name, "70")
        steps[0]()
        assert largest() <= 70
    finally:
        spark.conf.set(name, held)


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    held = [spark.conf.get(name) for name in names]

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(100_000)).alias("text"))
    try:
        spark.conf.set(names[1], "1000000000")
        encoding.add_vectors(long, "general")
        rows = long.mapInArrow(size, "n long, size long").collect()
        assert sum(r["n"] for r in rows) == 400
        assert max(r["size"] for r in rows) <= 17 * 1024 * 1024
        # A smaller limit of the session stays.
        spark.conf.set(names[1], "1000000")
        encoding.add_vectors(long, "general")
        assert spark.conf.get(names[1]) == "1000000"
    finally:
        for name, value in zip(names, held, strict=True):
            spark.conf.set(name, value)


def test_tokens_are_looked_for_once_for_both_vectors(spark, capsys):
    texts = ["One two, two.", "", None, "zwei Äpfel 2 two", "one"]
    rows = [(str(i), t, d) for i, t in enumerate(texts) for d in ("general", "medical", None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, domain string").withColumn("_WORDS", F.lit(1))
    alone = df.withColumn("dense", vectors.encode_dense(F.col("text"), "general")).withColumn(
        "terms", vectors.term_weights(F.col("text"))
    )
    key = lambda r: (r["chunk_id"], str(r["domain"]))
    for coded in (encoding.add_vectors(df, "general"), encoding.add_vectors_by_domain(df)):
        coded.explain()
        assert capsys.readouterr().out.count("split(") == 1
        assert coded.columns == alone.columns
        got, want = (sorted(x.collect(), key=key) for x in (coded, alone))
        assert [r["terms"] for r in got] == [r["terms"] for r in want]
        for a, b in zip(got, want, strict=True):
            if len(a["dense"]) == len(b["dense"]):
                assert a["dense"] == b["dense"]
            else:
                assert a["domain"] == "medical" and len(a["dense"]) == 768
