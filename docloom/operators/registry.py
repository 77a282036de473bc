"""Document registry, chat sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules

LISTED = (
    "document_id", "original_name", "mime_type", "size_bytes", "domain", "status",
    "chunk_count", "job_id", "created_at", "updated_at",
)


def _live(registry: DataFrame, **equals: str | None) -> DataFrame:
    rows = registry.where(~F.col("is_deleted"))
    for column, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def _pages(rows: DataFrame, key: list[str], order: list[Column], limit: int, skip: int) -> DataFrame:
    """The page of every key. The rank limit applies per task before the shuffle."""
    ranked = Window.partitionBy(*key).orderBy(*order)
    return (
        rows.withColumn("position", F.row_number().over(ranked))
        .where(F.col("position") <= skip + limit)
        .where(F.col("position") > skip)
    )


def list_documents(
    registry: DataFrame, domain: str | None = None, status: str | None = None,
    limit: int = 20, skip: int = 0,
) -> DataFrame:
    """Every owner's page of live documents, newest first, with the owner's total.

    Totals come from a map-side aggregated count, not from a window over all
    documents of an owner.
    """
    live = _live(registry, domain=domain, status=status)
    columns = [c for c in LISTED if c in registry.columns]
    totals = live.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    page = _pages(
        live.select("user_id", *columns),
        ["user_id"],
        [F.desc("created_at"), F.col("document_id")],
        limit,
        skip,
    )
    return page.join(totals, "user_id")


def list_user_documents(
    registry: DataFrame, user_id: str, limit: int = 20, skip: int = 0, **filters: str | None
) -> DataFrame:
    """One owner's page: the sort and limit run as a distributed top-n."""
    rows = _live(registry, **filters).where(F.col("user_id") == user_id)
    return (
        rows.select(*[c for c in LISTED if c in rows.columns])
        .orderBy(F.desc("created_at"), "document_id")
        .offset(skip)
        .limit(limit)
    )


def admin_documents(
    registry: DataFrame, users: DataFrame, domain: str | None = None,
    status: str | None = None, limit: int = 50, skip: int = 0,
) -> DataFrame:
    """Newest live documents of everybody with owner email and name.

    The page is taken first, so the join sees at most ``skip + limit`` rows.
    """
    page = (
        _live(registry, domain=domain, status=status)
        .orderBy(F.desc("created_at"), "document_id")
        .offset(skip)
        .limit(limit)
    )
    return page.join(users.select("user_id", "email", "name"), "user_id", "left")


def document_status(registry: DataFrame) -> DataFrame:
    """Status view of live documents; the error text shows only for failed ones."""
    error = F.coalesce(
        F.when(F.col("error_message") != "", F.col("error_message")),
        F.lit(rules.FAILED_DEFAULT_MESSAGE),
    )
    return _live(registry).select(
        "document_id",
        "user_id",
        "status",
        "chunk_count",
        "updated_at",
        F.when(F.col("status") == "failed", error).alias("error"),
    )


def delete_documents(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Soft delete by owner: ``requests`` holds ``document_id, user_id``."""
    asked = requests.select("document_id", "user_id").distinct().withColumn("_hit", F.lit(True))
    return (
        registry.join(asked, ["document_id", "user_id"], "left")
        .withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def list_sessions(
    sessions: DataFrame, domain: str | None = None, include_archived: bool = False,
    limit: int = 20, skip: int = 0,
) -> DataFrame:
    """Every user's page of sessions by recent activity."""
    rows = sessions if include_archived else sessions.where(~F.col("is_archived"))
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    return _pages(
        rows,
        ["user_id"],
        [F.desc("updated_at"), F.col("session_id")],
        limit,
        skip,
    )


def session_domain_check(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``accepted``: a request's domain must equal that of its session.

    A request whose session is unknown (or not the caller's) passes.
    """
    known = sessions.select("session_id", "user_id", F.col("domain").alias("session_domain"))
    return requests.join(known, ["session_id", "user_id"], "left").withColumn(
        "accepted",
        F.coalesce(F.col("session_domain") == F.col("domain"), F.lit(True)),
    )


def update_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply per-key updates; absent fields keep their value, ``deleted`` removes the row.

    ``updates``: ``session_id, user_id, seq, title, is_archived, pinned, deleted``.
    Only the owner's updates apply; the latest given value of each field wins.
    """
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    changes = updates.groupBy("session_id", "user_id").agg(
        latest("title"), latest("is_archived"), latest("pinned"),
        F.max(F.coalesce("deleted", F.lit(False))).alias("_deleted"),
    )
    merged = sessions.join(changes, ["session_id", "user_id"], "left").where(
        ~F.coalesce("_deleted", F.lit(False))
    )
    for field in ("title", "is_archived", "pinned"):
        merged = merged.withColumn(field, F.coalesce(f"_{field}", field)).drop(f"_{field}")
    return merged.drop("_deleted")


def history_window(messages: DataFrame, size: int = rules.HISTORY_MESSAGES) -> DataFrame:
    """The most recent ``size`` messages of every session without the newest."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= size)
        .where(F.col("_age") > 1)
        .drop("_age")
    )


def message_page(messages: DataFrame, cursors: DataFrame, limit: int = 50) -> DataFrame:
    """Per session the last ``limit`` messages before its cursor, and ``has_more``.

    ``cursors``: ``session_id, before`` (a turn, or NULL). A cursor that names no
    message, or the first one, cuts nothing. ``has_more`` compares the page size
    with all messages of the session.
    """
    size = limit
    facts = (
        messages.join(cursors, "session_id")
        .groupBy("session_id", "before")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.min("turn").alias("_first"),
            F.max(F.col("turn") == F.col("before")).alias("_known"),
        )
        .withColumn(
            "_cut",
            F.when(F.col("_known") & (F.col("before") > F.col("_first")), F.col("before")),
        )
    )
    shown = messages.join(facts.drop("before"), "session_id").where(
        F.col("_cut").isNull() | (F.col("turn") < F.col("_cut"))
    )
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return (
        shown.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= size)
        .withColumn("has_more", F.col("total") > size)
        .drop("_age", "_first", "_known", "_cut", "total")
    )
