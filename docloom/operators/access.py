"""Access, validation and rate rules over request tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.domains import valid_domain
from docloom.functions.text import strip


def authorised_requests(
    requests: DataFrame, users: DataFrame, roles: Sequence[str] | None = None
) -> DataFrame:
    """Requests of active users who may use the request's domain.

    ``requests``: ``user_id, domain``; ``users``: ``user_id, role, is_active,
    allowed_domains``. Admins pass every domain; ``roles`` narrows to any of
    the given roles; a request without a domain has no domain rule.
    """
    admitted = users.where(F.col("is_active"))
    if roles:
        admitted = admitted.where(F.col("role").isin(*roles))
    u = admitted.select(
        F.col("user_id").alias("_user"), F.col("role").alias("_role"),
        F.col("allowed_domains").alias("_allowed"),
    )
    may = (
        (F.col("_role") == "admin")
        | F.col("domain").isNull()
        | F.array_contains("_allowed", F.col("domain"))
    )
    return requests.join(u, (F.col("user_id") == F.col("_user")) & may, "left_semi")


def split_domains(requests: DataFrame, raw: str = "raw_domain") -> tuple[DataFrame, DataFrame]:
    """Accepted rows with a clean ``domain``, and rejected rows."""
    checked = requests.withColumn("domain", valid_domain(F.col(raw)))
    return checked.where("domain is not null"), checked.where("domain is null").drop("domain")


def violation(bad: Column, field: str, message: str, received: Column) -> Column:
    return F.when(
        bad,
        F.struct(
            F.lit(field).alias("field"),
            F.lit(message).alias("message"),
            F.substring(received.cast("string"), 1, 100).alias("received"),
        ),
    )


def request_violations() -> Column:
    """All rule violations of a request row, in rule order."""
    query = strip(F.col("query"))
    return F.filter(
        F.array(
            violation(
                ~F.length(query).between(1, 4096),
                "query", "Query must be between 1 and 4096 characters.", query,
            ),
            violation(
                F.length(strip(F.col("title"))) > 200,
                "title", "Title must be under 200 characters.", strip(F.col("title")),
            ),
            violation(
                F.size("pinned") > 20,
                "pinnedDocumentIds", "Maximum 20 pinned documents.", F.size("pinned"),
            ),
            violation(
                ~F.col("limit").between(1, 100), "limit", "Limit must be 1–100.", F.col("limit")
            ),
            violation(F.col("skip") < 0, "skip", "Skip must be ≥ 0.", F.col("skip")),
        ),
        lambda v: v.isNotNull(),
    )


def validate_rows(requests: DataFrame) -> DataFrame:
    """Add ``violations`` (empty: valid)."""
    return requests.withColumn("violations", request_violations())


def rate_limit(
    requests: DataFrame, window_seconds: int = 60, max_requests: int = 60
) -> DataFrame:
    """Flag requests beyond ``max_requests`` per caller and tumbling window.

    ``requests``: ``request_id, ts, user_id, ip, path``. The caller is the user
    or else the address; health checks are never limited. A busy caller's
    window is counted in slices of a second first, so it never has to pass
    through one task as a whole.
    """
    exempt = F.coalesce(F.col("path") == rules.RATE_LIMIT_EXEMPT_PATH, F.lit(False))
    keyed = (
        requests.withColumn("caller", F.coalesce(F.col("user_id").cast("string"), F.col("ip")))
        .withColumn("_sec", F.floor(F.unix_micros(F.col("ts")) / 1_000_000))
        .withColumn("_win", F.floor(F.col("_sec") / window_seconds) * window_seconds)
        .withColumn("exempt", exempt)
    )
    counted = ["caller", "_win", "_sec", "exempt"]
    upto = Window.partitionBy("caller", "_win", "exempt").orderBy("_sec")
    before = keyed.groupBy(*counted).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    )
    within = Window.partitionBy(*counted).orderBy("ts", "request_id")
    ranked = keyed.join(before.drop("_n"), counted).withColumn(
        "n_in_window", F.coalesce("_before", F.lit(0)) + F.row_number().over(within)
    )
    limited = ~F.col("exempt") & (F.col("n_in_window") > max_requests)
    return (
        ranked.withColumn("window_start", F.timestamp_seconds(F.col("_win")))
        .withColumn("limited", limited)
        .withColumn("retry_after", F.when(limited, F.lit(window_seconds)))
        .drop("_win", "_sec", "_before", "exempt")
    )
