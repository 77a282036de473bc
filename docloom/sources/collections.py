"""Chunk collections as versioned Parquet deltas, and views over status logs.

Every change of a store is a delta: new chunk rows below
``root/chunks/delta=<n>/domain=<d>/bucket=<b>``, and the documents whose earlier chunks it
ends below ``root/ends/delta=<n>``. Nothing that is stored is rewritten. A change
counts once its manifest, the list of all deltas, is renamed into place; readers
take the newest manifest and merge: of equal chunk ids the row of the latest delta
stays, and chunks older than the end of their document go. ``compact`` folds the
deltas into one, apart from writers, and ``vacuum`` removes what no manifest names.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import rules
from docloom.functions.domains import collection_name
from docloom.operators.id_filters import newest_rows
from docloom.session import settings

BUCKETS = 64
#: Rows that stand by folder are written without being sorted by it.
BY_FOLDER = {"spark.sql.maxConcurrentOutputFileWriters": 16}


def route_collections(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("collection", collection_name(F.col("domain")))


def wipe_collections(chunks: DataFrame, domains: tuple[str, ...] = rules.DOMAINS) -> DataFrame:
    """What is left after dropping the collections of ``domains``."""
    return chunks.where(~F.col("domain").isin(*domains))


def latest_task_status(events: DataFrame, now: Column) -> DataFrame:
    """Last write per task; a task whose last write is over 24 h old is gone.

    ``max_by`` keeps one row per task and map task, whatever the number of writes.
    """
    columns = [F.col(c) for c in events.columns if c != "task_id"]
    alive = now - F.expr(f"interval {rules.TASK_TTL_SECONDS} seconds")
    return (
        events.groupBy("task_id")
        .agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("last"))
        .select("task_id", "last.*")
        .where(F.col("ts") > alive)
    )


class ChunkStore:
    """Reader and writer of the chunk collections below one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    # --- reading -----------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._manifest()["deltas"])

    def read(self, domain: str | None = None) -> DataFrame:
        """The chunks that count, with ``domain``, ``bucket`` and ``ingested_at`` (time of their commit)."""
        held = self._manifest()
        with_rows = [d for d in held["deltas"] if d["schema"]]
        if not with_rows:
            raise ValueError(f"no chunks have been written to {self.root}")
        rows = self._rows(with_rows)
        if domain is not None:
            rows = rows.where(F.col("domain") == domain)
        for name, since in held["wiped"].items():
            rows = rows.where((F.col("domain") != name) | (F.col("delta") > since))
        # Only ids of deltas after the first can replace anything.
        if len(with_rows) > 1:
            later = self._rows(with_rows[1:]).groupBy("chunk_id").agg(F.max("delta").alias("_last"))
            rows = rows.join(later, "chunk_id", "left").where("_last is null or delta = _last").drop("_last")
        if ended := [d["number"] for d in held["deltas"] if d["ends"]]:
            paths = [self._path("ends", n) for n in ended]
            ends = self.spark.read.option("basePath", f"{self.root}/ends").schema("document_id string, delta long")
            last = ends.parquet(*paths).groupBy("document_id").agg(F.max("delta").alias("_end"))
            rows = rows.join(last, "document_id", "left").where("_end is null or delta >= _end").drop("_end")
        moments = {d["number"]: d["at"] for d in with_rows}
        stamps = F.create_map(*[F.lit(x).cast("long") for pair in moments.items() for x in pair])
        stamp = F.coalesce(F.col("_at"), stamps[F.col("delta")]) if "_at" in rows.columns else stamps[F.col("delta")]
        return rows.withColumn("ingested_at", stamp).drop("delta", "_at")

    def _rows(self, deltas: list[dict]) -> DataFrame:
        """All rows of some deltas; columns that one lacks are NULL there."""
        fields: dict[str, T.StructField] = {}
        for d in deltas:
            for field in T.StructType.fromJson(d["schema"]).fields:
                fields.setdefault(field.name, field)
        parts = T.StructType.fromDDL("delta long, domain string, bucket int")
        schema = T.StructType([*fields.values(), *parts.fields])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/chunks")
        return reader.parquet(*[self._path("chunks", d["number"]) for d in deltas])

    # --- changes -----------------------------------------------------------------

    def append(self, chunks: DataFrame, batch: str | None = None) -> bool:
        """Add chunks; an id that is stored already is replaced."""
        return self._change(chunks, None, batch)

    def upsert(self, incoming: DataFrame, version: str = "seq", batch: str | None = None) -> bool:
        """Replace or add chunks by id: of an id's incoming rows the one with the largest version."""
        newest = Window.partitionBy("chunk_id").orderBy(F.desc(version))
        latest = incoming.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        return self._change(latest, None, batch)

    def replace_documents(
        self,
        incoming: DataFrame,
        version: str = "seq",
        batch: str | None = None,
        documents: DataFrame | None = None,
        dealt: bool = False,
    ) -> bool:
        """Upsert, and end what earlier versions of these documents had besides.

        ``documents`` names those that may have no chunk any more; else the
        documents of the chunks are taken. With ``dealt`` the rows of a folder (see
        ``placed``) stand together already and are written where they are.
        """
        if dealt:
            return self._change(incoming, incoming if documents is None else documents, batch, version)
        newest = Window.partitionBy("chunk_id").orderBy(F.desc(version))
        latest = incoming.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        return self._change(latest, incoming if documents is None else documents, batch)

    def delete(self, document_ids: DataFrame, batch: str | None = None) -> bool:
        """End all chunks of the given documents; only their ids are written."""
        return self._change(None, document_ids, batch)

    def wipe(self, domains: tuple[str, ...] = rules.DOMAINS) -> None:
        """Leave out all chunks so far of whole collections; no row is read or written."""
        held = self._manifest()
        held["wiped"].update({d: held["last"] for d in domains})
        self._commit(held)

    def compact(self) -> None:
        """Fold all deltas into one that holds the chunks that count, each with its time of ingestion."""
        held = self._manifest()
        if len(held["deltas"]) < 2 and not held["wiped"]:
            return
        live = self.read().withColumnRenamed("ingested_at", "_at").drop("bucket")
        number = held["last"] + 1
        schema = self._write(live, number)
        folded = {"number": number, "schema": schema, "ends": False, "at": int(time.time())}
        self._commit(held | {"last": number, "deltas": [folded], "wiped": {}})

    def vacuum(self) -> int:
        """Remove deltas that the newest manifest does not name, once no reader uses them; returns their number."""
        named = {d["number"] for d in self._manifest()["deltas"]}
        gone = 0
        for kind in ("chunks", "ends"):
            for path in self._children(kind):
                if int(path.getName().split("=")[1]) not in named:
                    gone += self._fs().delete(path, True)
        return gone

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows with the folder of their document: ``domain`` and ``bucket``."""
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")
        return rows.withColumn("domain", F.coalesce("domain", F.lit(""))).withColumn("bucket", bucket)

    def _change(
        self, chunks: DataFrame | None, ended: DataFrame | None, batch: str | None, version: str | None = None
    ) -> bool:
        """Write a delta and commit it. A batch, ``<writer>:<number>``, that is committed already changes nothing.

        Without ``version`` the chunk ids are distinct already; else the rows stand by folder.
        """
        held = self._manifest()
        writer, _, order = (batch or "").rpartition(":")
        if batch and held["batches"].get(writer, -1) >= int(order):
            return False
        number = held["last"] + 1
        schema = None if chunks is None else self._write(chunks, number, version is not None)
        if version is not None:
            # Ids that come twice are looked for in what is written: only then it is written again.
            rows = self._rows([{"number": number, "schema": schema}])
            if (newest := newest_rows(rows, "chunk_id", version)) is not rows:
                self._write(newest.drop("delta"), number + 1, True)
                self._fs().delete(self._hadoop(self._path("chunks", number)), True)
                number += 1
        if ended is not None:
            ids = ended.select(F.col("document_id").cast("string")).where("document_id is not null").distinct()
            ids.write.mode("overwrite").parquet(self._path("ends", number))
        delta = {"number": number, "schema": schema, "ends": ended is not None, "at": int(time.time())}
        batches = held["batches"] | ({writer: int(order)} if batch else {})
        self._commit(held | {"last": number, "deltas": [*held["deltas"], delta], "batches": batches})
        return True

    def _write(self, chunks: DataFrame, number: int, dealt: bool = False) -> dict:
        """Rows of a delta, one file per folder unless a folder has many rows; returns their schema."""
        rows = self.placed(chunks)
        with settings(rows.sparkSession, BY_FOLDER if dealt else {}):
            # What an attempt without commit has left is overwritten.
            (rows if dealt else rows.hint("rebalance", "domain", "bucket")).write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).option("compression", "zstd").partitionBy("domain", "bucket").parquet(self._path("chunks", number))
        stored = [f for f in rows.schema.fields if f.name not in ("domain", "bucket")]
        return T.StructType([T.StructField(f.name, f.dataType) for f in stored]).jsonValue()

    # --- files -------------------------------------------------------------------

    def _path(self, kind: str, number: int) -> str:
        return os.path.join(self.root, kind, f"delta={number}")

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, kind: str) -> list:
        path = self._hadoop(os.path.join(self.root, kind))
        fs = self._fs()
        return [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _manifest(self) -> dict:
        """The newest committed state."""
        found = [p for p in self._children("manifests") if p.getName().endswith(".json")]
        if not found:
            return {"version": 0, "last": 0, "deltas": [], "wiped": {}, "batches": {}}
        newest = max(found, key=lambda p: p.getName())
        stream = self._fs().open(newest)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def _commit(self, state: dict) -> None:
        """Rename the next manifest into place; fails if another writer was faster."""
        state = state | {"version": state["version"] + 1}
        folder = os.path.join(self.root, "manifests")
        draft = self._hadoop(os.path.join(folder, f".{uuid.uuid4().hex}"))
        out = self._fs().create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        place = self._hadoop(os.path.join(folder, f"{state['version']:012d}.json"))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.makeQualified(self._fs().getUri(), self._fs().getWorkingDirectory()).toUri(),
            self.spark._jsc.hadoopConfiguration(),
        )
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            # Does not replace a file that is there.
            context.rename(context.makeQualified(draft), context.makeQualified(place), none)
        except Exception as error:
            self._fs().delete(draft, False)
            raise RuntimeError(f"another writer has committed version {state['version']}") from error
