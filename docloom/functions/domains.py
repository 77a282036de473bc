"""Domain routing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.text import strip


# The built-in domains plus those added by ``plans.extension.register_domain``.
KNOWN: list[str] = list(rules.DOMAINS)


def normalise_domain(raw: Column, default: str = "general") -> Column:
    """Lenient form: trimmed and lower-cased; unknown or missing becomes ``default``."""
    clean = F.lower(strip(raw))
    return F.when(clean.isin(*KNOWN), clean).otherwise(F.lit(default))


def valid_domain(raw: Column) -> Column:
    """Strict form: the clean value, or NULL when it must be rejected."""
    clean = F.lower(strip(raw))
    return F.when(clean.isin(*KNOWN), clean)


def ingest_domain(form: Column, header: Column) -> Column:
    """Form value unless it is the default ``general``, then the header, then ``general``."""
    return F.when(form != "general", form).otherwise(
        F.coalesce(F.when(header != "", header), F.lit("general"))
    )


def query_domain(header: Column, body: Column) -> Column:
    """For queries the header wins over the body."""
    return F.coalesce(F.when(header != "", header), body)


def collection_name(domain: Column) -> Column:
    return F.concat(F.lit(rules.COLLECTION_PREFIX), domain)
