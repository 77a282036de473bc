"""Collections on disk, streams against their batch twins, skewed keys, extension points."""

import pytest
from pyspark.sql import functions as F

from docloom import rules, session
from docloom.functions import guards as G
from docloom.functions import vectors
from docloom.operators import access, chunking, encoding, guarding, ordered, render
from docloom.plans import derive
from docloom.plans.extension import register_domain
from docloom.sources import files
from docloom.sources.collections import ChunkStore, latest_task_status
from docloom.streaming import ingest, status, windows


def chunks(spark, rows):
    return spark.createDataFrame(
        rows, "chunk_id string, document_id string, domain string, seq int, text string"
    )


def held(store):
    return sorted((r["chunk_id"], r["text"]) for r in store.read().collect())


def test_upsert_is_idempotent_and_local(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=4)
    first = chunks(spark, [(f"c{i}", f"d{i % 5}", "general", 0, "old") for i in range(20)])
    store.upsert(first)
    again = chunks(spark, [("c1", "d1", "general", 1, "new"), ("c1", "d1", "general", 2, "newer"),
                           ("x", "d9", "medical", 1, "x")])
    store.upsert(again)
    want = sorted([(f"c{i}", "newer" if i == 1 else "old") for i in range(20)] + [("x", "x")])
    assert held(store) == want
    store.upsert(again)
    assert held(store) == want
    assert store.read("medical").count() == 1


def test_delete_and_wipe(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    store.append(chunks(spark, [(f"c{i}", f"d{i % 3}", ("general", "medical")[i % 2], 0, "t") for i in range(12)]))
    store.delete(spark.createDataFrame([("d0",)], "document_id string"))
    assert {r["document_id"] for r in store.read().collect()} == {"d1", "d2"}
    store.wipe(("medical", "financial"))
    assert {r["domain"] for r in store.read().collect()} == {"general"}


def files_of(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    root = tmp_path / "c"
    store = ChunkStore(spark, str(root), buckets=4)
    store.append(chunks(spark, [(f"c{i}", f"d{i}", "general", 0, "t" * 50) for i in range(200)]))
    before = files_of(root)
    store.upsert(chunks(spark, [("c7", "d7", "general", 1, "new")]))
    new = sorted(set(files_of(root)) - set(before))
    assert set(before) <= set(files_of(root)) and len(new) == 1
    store.delete(spark.createDataFrame([("d8",), (None,)], "document_id string"))
    assert len([f for f in files_of(root) if f.startswith("chunks")]) == len(before) + 1
    got = dict(held(store))
    assert got["c7"] == "new" and "c8" not in got and len(got) == 199
    # A document that comes back after its end counts again.
    store.append(chunks(spark, [("c8", "d8", "general", 2, "back")]))
    assert dict(held(store))["c8"] == "back"


def test_a_shortened_document_leaves_no_tail(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    store.replace_documents(chunks(spark, [(f"d1-{i}", "d1", "general", 0, f"{i}") for i in range(5)] + [("d2-0", "d2", "general", 0, "x")]))
    store.replace_documents(chunks(spark, [("d1-0", "d1", "general", 1, "short")]))
    assert held(store) == [("d1-0", "short"), ("d2-0", "x")]
    nothing = chunks(spark, [("z", "z", "general", 0, "z")]).limit(0)
    store.replace_documents(nothing, documents=spark.createDataFrame([("d2",)], "document_id string"))
    assert held(store) == [("d1-0", "short")]


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    first = chunks(spark, [("a", "a", "general", 0, "one")])
    assert store.upsert(first, batch="feed:0") and store.upsert(chunks(spark, [("a", "a", "general", 1, "two")]), batch="feed:1")
    before = [tuple(r) for r in store.read().collect()]
    assert not store.upsert(first, batch="feed:0") and not store.upsert(first, batch="feed:1")
    assert store.upsert(chunks(spark, [("b", "b", "general", 0, "b")]), batch="other:0")
    after = [tuple(r) for r in store.read().collect()]
    assert set(before) < set(after) and len(after) == 2


def test_compaction_keeps_every_row_and_its_time(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    store.append(chunks(spark, [(f"c{i}", f"d{i % 4}", "general", 0, "t") for i in range(12)]))
    store.upsert(chunks(spark, [("c1", "d1", "general", 1, "new")]).withColumn("extra", F.lit(7)))
    store.delete(spark.createDataFrame([("d0",)], "document_id string"))
    store.append(chunks(spark, [("m", "m", "medical", 0, "m")]))
    store.wipe(("medical",))
    columns = ["chunk_id", "text", "extra", "ingested_at", "bucket", "domain"]
    rows = lambda: sorted(map(tuple, store.read().select(columns).collect()))
    before = rows()
    assert len(before) == 9 and {r[2] for r in before} == {None, 7}
    store.compact()
    assert rows() == before and store.vacuum() > 0 and rows() == before
    store.append(chunks(spark, [("m", "m", "medical", 0, "again")]))
    assert len(rows()) == 10


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    stale = store._manifest()
    store.append(chunks(spark, [("a", "a", "general", 0, "one")]))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(stale)
    assert held(store) == [("a", "one")]
    assert not [p for p in (tmp_path / "c" / "manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_scan_and_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"good \xff text")
    (tmp_path / "in" / "b.exe").write_bytes(b"no")
    accepted, rejected = files.scan_documents(spark, str(tmp_path / "in"))
    assert [r["content"] for r in accepted.collect()] == ["good � text"]
    assert [r["problem"] for r in rejected.collect()] == ["Unsupported file type: .exe"]
    docs = accepted.withColumns({"domain": F.lit("general"), "document_id": F.lit("d")})
    assert files.archive_originals(docs, str(tmp_path / "out"))
    assert (tmp_path / "out" / "domain=general" / "document_id=d").is_dir()
    assert not files.archive_originals(docs, "nosuchscheme://x/y")


def test_status_stream_equals_batch(spark, small, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    log = derive.status_events(spark, small)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    feed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "log"))
    running = (
        status.stream_status(feed)
        .writeStream.outputMode("update")
        .format("memory")
        .queryName("status_out")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    got = {r["document_id"]: tuple(r) for r in spark.table("status_out").collect()}
    known = log.select("document_id").distinct()
    want = {r["document_id"]: tuple(r) for r in status.status_machine(known, log).collect()}
    assert got == want


def _source(spark, small, name):
    schema = derive.table(spark, small, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(small)


def _drain(frame, tmp_path, name):
    out = str(tmp_path / name)
    frame.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(out)


def test_rate_limit_stream_equals_batch(spark, small, tmp_path):
    day, most = 86_400, 1
    feed = _source(spark, small, "events").select(
        F.col("event_id").alias("request_id"), "ts", "user_id", F.lit(None).cast("string").alias("ip"),
        F.when(F.col("event_type") == "view", "/health").otherwise("/query").alias("path"),
    )
    got = _drain(windows.stream_rate_limit(feed, day, most), tmp_path, "rate")
    batch = derive.table(spark, small, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.lit(None).cast("string").alias("ip"),
        F.when(F.col("event_type") == "view", "/health").otherwise("/query").alias("path"),
    )
    flagged = access.rate_limit(batch, day, most).where("limited")
    want = {
        (r["caller"], r["window_start"]): r["n"]
        for r in flagged.groupBy("caller", "window_start").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    stream = {(r["caller"], r["window_start"]): r["n_limited"] for r in got.collect()}
    # Append mode holds back windows the watermark has not passed yet.
    assert stream and all(want[k] == n for k, n in stream.items())
    last = max(w for _, w in want)
    assert {k for k in want if k[1] < last} <= set(stream)


def test_answers_stream(spark, tmp_path):
    """Tokens of several micro-batches; only closed answers come out, like in the batch form."""
    parts = [
        [("r1", 1, "token", "b", None), ("r2", 0, "token", "c", None), ("open", 0, "token", "z", None)],
        [("r1", 0, "token", "a ", None), ("r2", 9, "done", None, "7"), ("none", 3, "done", None, "1")],
        [("r1", 2, "token", "", None), ("r1", 3, "done", None, "5")],
    ]
    names = "request_id string, seq bigint, type string, content string, usage string"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, names).coalesce(1).write.parquet(str(tmp_path / "ev" / f"part={i}"))
    every = spark.read.schema(names).parquet(str(tmp_path / "ev"))
    feed = (
        spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "ev"))
    )
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    got = {tuple(r) for r in _drain(windows.stream_answers(feed), tmp_path, "answers").collect()}
    assert got == {("r1", "a b", "5"), ("r2", "c", "7")}
    batch = guarding.assemble_answers(every.where("request_id <> 'open'"))
    assert got == {(r.request_id, r.answer, r.usage) for r in batch.collect()}


def test_ingest_stream_survives_redelivery(spark, small, tmp_path):
    docs = derive.raw_documents(spark, small).select("document_id", "domain", "content", F.lit(1).alias("seq"))
    docs.write.parquet(str(tmp_path / "docs"))
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    for run in ("a", "b"):
        feed = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
        ingest.start_ingest(feed, store, str(tmp_path / f"state-{run}"), "seq").awaitTermination()
    stored = store.read()
    n = chunking.chunk_documents(docs).count()
    assert stored.count() == n == stored.select("chunk_id").distinct().count()
    wrong = stored.where(F.size("dense") != F.when(F.col("domain") == "general", 384).otherwise(768))
    assert wrong.count() == 0


def test_ingest_keeps_the_newest_version_of_a_batch(spark, tmp_path):
    """Of a document that comes twice, one without id included, the largest version counts; others stay as they are."""
    rows = [("a", "medical", "Old one.", 1), ("a", None, "New one.", 2), (None, "x", "Lost.", 1), (None, "financial", "Kept.", 3)]
    rows += [(f"d{i}", "general", f"Text {i}.", 1) for i in range(20)]
    names = "document_id string, domain string, content string, seq int"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "docs"))
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    feed = spark.readStream.schema(names).parquet(str(tmp_path / "docs"))
    ingest.start_ingest(feed, store, str(tmp_path / "state"), "seq").awaitTermination()
    got = sorted((r["document_id"] or "", r["domain"], r["text"], r["seq"]) for r in store.read().collect())
    want = [("", "financial", "Kept.", 3), ("a", "general", "New one.", 2)]
    assert got == sorted(want + [(f"d{i}", "general", f"Text {i}.", 1) for i in range(20)])


def test_rows_written_in_place_keep_one_row_an_id(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    rows = [("x", "d1", "general", 1, "old"), ("x", "d2", "medical", 2, "new"), (None, "d1", None, 1, "n"), (None, "d1", None, 1, "n")]
    rows += [(f"c{i}", "d1", "general", 1, "t") for i in range(5)]
    assert store.replace_documents(chunks(spark, rows).repartition(3), batch="w:1", dealt=True)
    assert not store.replace_documents(chunks(spark, rows), batch="w:1", dealt=True)
    got = sorted((r["chunk_id"] or "", r["text"], r["domain"] or "") for r in store.read().collect())
    assert got == sorted([("", "n", ""), ("x", "new", "medical"), *[(f"c{i}", "t", "general") for i in range(5)]])
    # What was written first is gone already, and later changes find their place.
    assert store.vacuum() == 0
    store.upsert(chunks(spark, [("x", "d2", "medical", 3, "newer")]))
    assert ("x", "newer") in [(r["chunk_id"], r["text"]) for r in store.read().collect()]


def test_expired_status_is_gone(spark):
    log = spark.createDataFrame(
        [("t1", 1, "2024-01-01 00:00:00", "processing"), ("t1", 2, "2024-01-01 05:00:00", "completed"),
         ("t2", 1, "2023-12-30 00:00:00", "processing")],
        "task_id string, seq int, ts string, status string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = latest_task_status(log, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()
    assert [(r["task_id"], r["status"]) for r in got] == [("t1", "completed")]


def test_hot_keys_give_whole_results(spark):
    """One key holds most rows; nothing is dropped and order is kept."""
    n = 5000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).otherwise("hot").alias("k"),
        F.col("id").alias("at"),
        F.concat(F.col("id").cast("string"), F.lit(".")).alias("t"),
    )
    joined = {r["k"]: r["t"] for r in ordered.concat_ordered(rows, ["k"], "at", "t", "").collect()}
    assert len(joined) == n // 10 + 1
    assert joined["hot"] == "".join(f"{i}." for i in range(n) if i % 10)
    asked = spark.range(n).select(
        F.col("id").alias("request_id"),
        F.timestamp_micros(F.col("id") * 7919 % 90_000_000).alias("ts"),
        F.lit("hot").alias("user_id"), F.lit(None).cast("string").alias("ip"), F.lit("/q").alias("path"),
    )
    got = access.rate_limit(asked, 60, 100)
    per_window = got.groupBy("window_start").agg(
        F.sum(F.col("limited").cast("int")).alias("over"), F.count(F.lit(1)).alias("n")
    )
    assert all(r["over"] == max(0, r["n"] - 100) for r in per_window.collect())


def test_window_properties(spark, small):
    docs = derive.structured_documents(spark, small).select("document_id", "content")
    for domain in rules.DOMAINS:
        made = chunking.chunk_domain(docs, domain).where("chunk_type = 'narrative'")
        assert made.agg(F.max(F.length("text"))).first()[0] <= rules.CHUNK_CHARS[domain]
    capped = chunking.chunk_domain(docs, "general", max_chunks=5)
    assert capped.agg(F.max("chunk_index")).first()[0] == 4


def test_table_cap_option(spark):
    wide = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {'x' * 900} | {i} |" for i in range(9))
    docs = spark.createDataFrame([("d", wide)], "document_id string, content string")
    made = chunking.chunk_domain(docs, "financial", cap_tables=True)
    assert made.agg(F.max(F.length("text"))).first()[0] <= rules.HARD_CAP_CHARS


def test_encode_distinct(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 2 else f"text {i}") for i in range(20)], "id int, text string")
    one = {r["id"]: list(r["dense"]) for r in encoding.encode_distinct(docs, "general").collect()}
    two = docs.withColumn("dense", vectors.encode_dense(F.col("text"), "general"))
    assert one == {r["id"]: list(r["dense"]) for r in two.collect()}


def test_guards_are_extensible_and_safe(spark):
    rows = spark.createDataFrame(
        [("medical", "Give 5 mg for anxiety"), ("financial", "Sales will rise"), ("general", None), ("general", "ok")],
        "domain string, response string",
    )
    shout = lambda response, domain: F.concat(response, F.lit("!"))
    got = guarding.guard_responses(rows, [*G.POST_GUARDS, shout]).collect()
    assert got[0]["guarded"] == (
        "Give 5 mg for anxiety\n\n" + rules.CRISIS_REFERRAL + "\n\n" + rules.PRESCRIBING_NOTE
        + "\n\n---\n" + rules.MEDICAL_DISCLAIMER + "!"
    )
    assert got[1]["guarded"] == rules.FORWARD_LOOKING_NOTICE + "Sales will rise!"
    assert got[2]["guarded"].startswith(rules.EMPTY_RESPONSE)
    column = rows.select(G.apply_post(F.col("response"), F.col("domain")).alias("v")).collect()
    assert [r["v"] + "!" for r in column] == [r["guarded"] for r in got]
    twice = guarding.guard_responses(rows.select("domain", F.col("response")).where("response = 'ok'"))
    again = guarding.guard_responses(twice.select("domain", F.col("guarded").alias("response"))).first()
    assert again["guarded"] == twice.first()["guarded"]


def test_prompt_without_chunks(spark):
    asked = spark.createDataFrame([("q", " why? ", "medical")], "query_id string, query string, domain string")
    none = spark.createDataFrame(
        [], "query_id string, domain string, rank int, chunk_type string, text string, score double, document_id string"
    )
    prompt = render.render_prompts(asked, none, "2024-01-01", {d: "S" for d in rules.DOMAINS}).first()["prompt"]
    assert rules.EMPTY_CONTEXT["medical"] in prompt
    assert prompt.startswith("S\n\n---\n\n## Retrieved Clinical Context\nThe following 0 document")
    answers = render.fallback_answers(asked, none).collect()
    assert [(r["query_id"], r["answer"]) for r in answers] == [("q", rules.NO_CONTEXT_ANSWER)]


def test_register_domain(spark):
    from docloom.functions.domains import normalise_domain, valid_domain

    def chunker(docs, cap):
        return docs.select("document_id", "domain", F.lit(0).alias("chunk_index"), F.col("content").alias("text"),
                           F.col("document_id").alias("chunk_id"), F.lit("narrative").alias("chunk_type"))

    register_domain("legal", chunker, lambda text: F.array(F.length(text).cast("float")), render.general_block)
    docs = spark.createDataFrame([("d", "legal", "abc"), ("e", "general", "Some text.")],
                                 "document_id string, domain string, content string")
    made = {r["document_id"]: r["text"] for r in chunking.chunk_documents(docs).collect()}
    assert made == {"d": "abc", "e": "Some text."}
    row = spark.range(1).select(normalise_domain(F.lit("Legal")).alias("a"), valid_domain(F.lit("legal ")).alias("b"))
    assert tuple(row.first()) == ("legal", "legal")
    coded = encoding.add_vectors_by_domain(docs.withColumnRenamed("content", "text"))
    assert {r["document_id"]: len(r["dense"]) for r in coded.collect()} == {"d": 1, "e": 384}


@pytest.fixture(autouse=True)
def _forget_extra_domains():
    yield
    from docloom.plans.extension import forget_domain

    forget_domain("legal")


def test_staged_tables_are_removed_on_request(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])
    monkeypatch.setattr(session, "shared_dir", lambda _spark: str(tmp_path))
    held = session.materialise(spark.range(5), "five")
    assert held.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert session.drop_scratch(spark) == 1 and not list(tmp_path.iterdir())
    assert session.drop_scratch(spark) == 0
