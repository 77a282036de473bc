"""WARC archives: writing captures of pages, and assembling transactions from records.

A capture is a request, a response (or a revisit of an earlier payload) and a
metadata record, tied together by ``WARC-Concurrent-To``. Writing and reading go
through Spark's own file sources, so archives live wherever Spark can write.
Records are separated by two line ends, which is what the text writer is told to
put behind every row; a reader gets the pieces between such line ends one after
another and needs only the content lengths, so that it holds one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common as C
from docloom.operators.id_filters import id_filter, passing

CRLF = "\r\n"
#: Records of one file, a unit of work of the reader.
FILE_RECORDS = 12_000
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, "
    "page_id long, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(content: Column) -> Column:
    """SHA-1 in bare upper-case base32: every five hex digits are four of its characters."""
    digest = F.sha1(content)
    parts = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _record_id(kind: str, page: Column, digest: Column, uri: Column, place: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    h = F.md5(F.concat_ws("\n", F.lit(kind), part(page), part(digest), part(uri), part(place)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)))


def _record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """Text of a record; fields that are null are left out."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")),
        *(F.concat(F.lit(f"{name}: "), value) for name, value in fields),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _told_apart(rows: DataFrame) -> DataFrame:
    """The rows with ``_place``: null, or for rows equal in page, digest and uri a number of their own.

    Rows that have equals are written first, so that their numbers stay.
    """
    name = F.md5(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("_page", "_digest", "_uri"))))
    named = rows.withColumn("_name", name)
    repeated = C.keep(named.groupBy("_name").count().where("count > 1").select("_name"), "repeated")
    none = F.lit(None).cast("long")
    if repeated.isEmpty():
        return rows.withColumn("_place", none)
    held = id_filter(repeated, "_name")
    near = passing(named, held, "_name")
    again = C.keep(near.join(repeated, "_name", "left_semi").withColumn("_place", F.monotonically_increasing_id()), "again")
    once = passing(named, held, "_name", maybe=False).unionByName(near.join(repeated, "_name", "left_anti"))
    return once.withColumn("_place", none).unionByName(again).drop("_name")


def write_captures(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a request, a response or revisit, and a metadata record for each page.

    Of pages with one payload of at least ``least_bytes`` bytes, that with the
    largest key is the response and the others revisit it. A null html is an
    empty payload; a null url leaves the target header out; a null key is never
    the largest, and its page is a response only if no other page has the payload.
    Every row is a capture of its own, rows equal in key, url and html too; of equal
    responses the others refer to one. Payloads move only if another page may have
    the same one.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("_page"),
        F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("_uri"),
        F.coalesce(F.col(html), F.lit("")).alias("_html"),
    ).withColumn("_digest", base32_sha1(F.encode("_html", "UTF-8")))
    rows = _told_apart(rows)
    lead = (
        rows.where(F.octet_length("_html") >= least_bytes)
        .groupBy("_digest")
        .agg(
            F.count("*").alias("_n"),
            F.max(F.struct("_page", F.coalesce("_uri", F.lit("")), "_uri", "_place")).alias("_lead"),
        )
        .where("_n > 1")
        .select("_digest", *(F.col(f"_lead.{c}").alias(f"_lead{c}") for c in ("_page", "_uri", "_place")))
    )
    lead = C.keep(lead, "payloads")
    held = id_filter(lead, "_digest")
    leads = ["_lead_page", "_lead_uri", "_lead_place"]
    shared = passing(rows, held, "_digest").join(lead, "_digest", "left").select(*rows.columns, *leads)
    alone = passing(rows, held, "_digest", maybe=False).select(
        *rows.columns, *(F.lit(None).cast(shared.schema[c].dataType).alias(c) for c in leads)
    )
    every = shared.unionByName(alone)
    revisit = F.col("_lead_page").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_lead_page"))
    same = [F.col(c) for c in ("_page", "_digest", "_uri", "_place")]
    own = _record_id("response", *same)
    target = [("WARC-Target-URI", F.col("_uri")), ("WARC-Date", F.lit(date))]
    tied = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("_id"), F.lit(">")))
    referred = _record_id("response", F.col("_lead_page"), F.col("_digest"), F.col("_lead_uri"), F.col("_lead_place"))
    head = F.concat(F.lit(HTTP_HEAD), F.octet_length("_html").cast("string"), F.lit(CRLF * 2))
    every = every.withColumns({"_id": own, "_revisit": revisit})
    response = _record(
        F.when(F.col("_revisit"), "revisit").otherwise("response"),
        F.col("_id"),
        [
            *target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
            ("WARC-Refers-To", F.when(F.col("_revisit"), F.concat(F.lit("<"), referred, F.lit(">")))),
            ("WARC-Profile", F.when(F.col("_revisit"), F.lit(REVISIT_PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(F.col("_revisit"), head).otherwise(F.concat(head, F.col("_html"))),
    )
    request = _record(
        F.lit("request"),
        _record_id("request", *same),
        [*target, tied, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("_uri", F.lit("/")), F.lit(" HTTP/1.1" + CRLF * 2)),
    )
    metadata = _record(
        F.lit("metadata"),
        _record_id("metadata", *same),
        [*target, tied, ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("pageId: "), F.col("_page").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    (
        every.select(F.explode(F.array(request, response, metadata)).alias("value"))
        .write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


class _Pieces(io.RawIOBase):
    """The bytes of an iterator of pieces as a stream."""

    def __init__(self, pieces: Iterator[bytes]):
        self._pieces, self._rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self._rest:
            piece = next(self._pieces, None)
            if piece is None:
                return 0
            self._rest = memoryview(piece)
        n = min(len(into), len(self._rest))
        into[:n] = self._rest[:n]
        self._rest = self._rest[n:]
        return n


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, list[str]] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(fields["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def parse(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of every record of one archive, gzipped or plain."""
    raw = io.BytesIO(content)
    return _records(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw)


def _row(fields: dict[str, list[str]], block: bytes, payloads: bool) -> dict:
    bare = lambda x: x.strip("<>") if x else None
    one = lambda name: fields.get(name, [None])[0]
    row = {
        "record_id": bare(one("warc-record-id")),
        "kind": one("warc-type"),
        "concurrent_to": [bare(x) for x in fields.get("warc-concurrent-to", [])],
        "refers_to": bare(one("warc-refers-to")),
        "uri": one("warc-target-uri"),
    }
    if row["kind"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        row["payload_bytes"] = len(payload)
        row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        row["payload"] = payload if payloads else None
    elif row["kind"] == "metadata":
        for line in block.decode("utf-8", "replace").splitlines():
            name, _, value = line.partition(":")
            if name.strip().lower() == "pageid":
                row["page_id"] = int(value)
    return row


def read_records(spark: SparkSession, path: str, payloads: bool = True, plain: bool = False) -> DataFrame:
    """A row for each record below ``path``; digest and size are those of the payload as read.

    A payload is what follows the HTTP head of a request or response. Revisits have
    none: digest and size are null. ``payloads=False`` leaves the bytes out. Gzipped
    archives (names that end in ``.gz``, with one member or many) of any size are read as a
    stream; ``plain=True`` reads archives that are not, of up to 2 GB each, whole. An archive that
    ends within a record is an error.
    """
    C.small_batches(spark)
    if plain:
        pieces = spark.read.format("binaryFile").load(path).select(
            F.xxhash64("path").alias("file"), F.col("content").alias("piece")
        )
    else:
        pieces = spark.read.option("lineSep", CRLF * 2).text(path).select(
            F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")
        )
    between = b"" if plain else (CRLF * 2).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The pieces of one file within a batch are put together at once.
        runs = (
            (file, between.join([piece for _, piece in pairs]) + between)
            for batch in batches
            for file, pairs in groupby(zip(*(batch.column(c).to_pylist() for c in ("file", "piece"))), lambda x: x[0])
        )
        rows, held = [], 0
        for _, group in groupby(runs, lambda x: x[0]):
            stream = _Pieces(piece for _, piece in group)
            for fields, block in _records(io.BufferedReader(stream, 1 << 18)):
                rows.append(_row(fields, block, payloads))
                held += len(block) if payloads else 0
                if len(rows) >= 2000 or held > C.STEP_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return pieces.mapInArrow(run, RECORD)


_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("kind", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("uri", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response``, ``request``, ``metadata``, ``refers_to``.

    Requests and metadata name their response among the ids they are concurrent
    to. The payload of a revisit is that of the response it refers to: its row has
    that record in ``refers_to`` and its size and digest in ``response``. A missing
    part is null; records that belong to no response are left out; of records
    with one id, one counts.
    """
    core = F.struct("record_id", "kind", "uri", "payload_bytes", "payload_digest", "payload")
    responses = (
        records.where(F.col("kind").isin("response", "revisit"))
        .select("record_id", "refers_to", core.alias("response"))
        .dropDuplicates(["record_id"])
    )

    def tied(kind: str) -> DataFrame:
        body = F.struct("record_id", "uri", "page_id").alias(kind)
        return (
            records.where(F.col("kind") == kind)
            .select(F.explode("concurrent_to").alias("record_id"), body)
            .groupBy("record_id")
            .agg(F.min(kind).alias(kind))
        )

    whole = responses.join(tied("request"), "record_id", "left").join(tied("metadata"), "record_id", "left")
    first = whole.where(F.col("response.kind") == "response").select(
        F.col("record_id").alias("refers_to"),
        F.struct(
            F.col("metadata.page_id").alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
        ).alias("_first"),
    )
    full = lambda name: F.coalesce(F.col(f"response.{name}"), F.col(f"_first.{name}"))
    return whole.join(first, "refers_to", "left").select(
        F.col("response")
        .withField("payload_bytes", full("payload_bytes"))
        .withField("payload_digest", full("payload_digest"))
        .alias("response"),
        "request",
        "metadata",
        F.struct("refers_to", F.col("_first.page_id").alias("page_id")).alias("refers_to"),
    )
