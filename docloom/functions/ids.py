"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.arrays import let


def uuid5(name: Column, namespace: str = rules.CHUNK_ID_NAMESPACE) -> Column:
    """Name-based UUID (version 5, RFC 4122) from built-in SHA-1."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))

    def layout(digest: Column) -> Column:
        # The variant nibble keeps its two low bits below binary 10.
        nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
        variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("bigint")))
        return F.concat(
            F.substring(digest, 1, 8),
            F.lit("-"),
            F.substring(digest, 9, 4),
            F.lit("-5"),
            F.substring(digest, 14, 3),
            F.lit("-"),
            variant,
            F.substring(digest, 18, 3),
            F.lit("-"),
            F.substring(digest, 21, 12),
        )

    return let(F.sha1(raw), layout)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws(":", document_id, chunk_index.cast("string")))


def table_id(document_id: Column, position: Column, text: Column) -> Column:
    """32 hex digits of the SHA-256 of document, place in it and whole text of a table."""
    whole = F.concat_ws("\n", document_id, position.cast("string"), text)
    return F.substring(F.sha2(whole, 256), 1, 32)
