"""The pipeline stage by stage on a small table, and as a whole."""

from collections import Counter

import corpus_pipeline
from docloom.llm import quality

from .conftest import SENTENCE, odd_documents, varied, words
from .test_pairs_and_spans import brute_classes, brute_hits, brute_repeats
from .test_rows import check_packing


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def tables(spark, tmp_path, docs):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, SENTENCE), (2, " ".join(varied(14, 20000)[100:160]))], "item_id long, text string").write.parquet(
        f"{sf}/benchmark.parquet"
    )
    labels = [(d, int(d not in (12, 13))) for d, _ in odd_documents() if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    return sf


def frame(spark, rows):
    return spark.createDataFrame(
        [(d, t, "en", "src0", len(t or "")) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )


def near_rows(stage, spark, sf, rows):
    left = stage("MinHash near-dedup")(spark, frame(spark, rows), sf)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return pairs(left)


def kept_rows(rows):
    """One row of each class of rows: the least id, null last."""
    classes = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    best = {}
    for i, (doc, _) in enumerate(rows):
        rank = (doc is None, doc or 0, i)
        best[classes[i]] = min(rank, best.get(classes[i], rank))
    return Counter(rows[i] for _, _, i in best.values())


def test_stages_against_brute_force(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    sf = tables(spark, tmp_path, docs)
    rows = odd_documents()

    machine = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {(r.doc_id, r.n) for r in quality.score(docs, machine).where("score >= 0.3").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    kept = stage("quality classifier")(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {(d, n) for d, n in Counter(r.doc_id for r in kept.collect()).items()} == good

    # Rows, not ids, are judged: two texts under one id, copies under null ids.
    mixed = [*rows, (9, "quite another text of the ninth one"), (None, rows[16][1] + " more")]
    assert near_rows(stage, spark, sf, mixed) == kept_rows(mixed)

    cut = stage("substring dedup")(spark, docs, sf)
    assert cut.columns == docs.columns
    expected = Counter()
    for (doc, text), (_, n, gone, kept_) in zip(rows, [one for one in map(lambda r: next(iter(single(rows, r))), rows)]):
        if gone == 0:
            expected[doc, text] += 1
        elif gone < n:
            expected[doc, kept_] += 1
    assert pairs(cut) == expected
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    clean = stage("benchmark decontamination")(spark, docs, sf)
    items = [(1, SENTENCE), (2, " ".join(varied(14, 20000)[100:160]))]

    def bad(text):
        ((_, n, hit, _, _),) = brute_hits([(0, text)], items)
        return hit and 20 * hit >= n

    assert {d for d, t in rows if bad(t)} >= {4, 5, 6} and not bad(rows[13][1])
    assert pairs(clean) == Counter(r for r in rows if not bad(r[1]))
    mixed = [(1, SENTENCE), (1, "clean words here"), (None, SENTENCE), (None, "clean too"), (None, None)]
    again = stage("benchmark decontamination")(spark, frame(spark, mixed), sf)
    assert pairs(again) == Counter([mixed[1], mixed[3], mixed[4]])

    some = {d: t for d, t in rows if d is not None and d < 20 and d != 17}
    packed = stage("best-fit packing")(spark, docs.where("doc_id < 20 and doc_id <> 17"), sf)
    check_packing(packed.collect(), some, 2048)


def single(rows, row):
    """The brute-force result of one row among all rows."""
    every = {}
    for doc, n, gone, kept in brute_repeats(rows):
        every.setdefault((doc, n), []).append((doc, n, gone, kept))
    for found in every[row[0], len(words(row[1]))]:
        yield found


def test_run_applies_all_stages(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    sf = tables(spark, tmp_path, docs)
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "tokens"} <= set(got.columns)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    # 4 holds a benchmark passage first; 5 and 14 lose theirs as repeats of it, and 6 is nothing else.
    assert not ids & {2, 3, 4, 6, 13} and {1, 5, 9, 14} <= ids


def test_run_over_empty_documents(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, docs)).count() == 0
