"""Joining long-form text rows back to one text per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_ordered(
    rows: DataFrame,
    keys: list[str],
    order: str,
    text: str,
    separator: str,
    block: int = 1024,
) -> DataFrame:
    """One row per key with its texts joined in ``order``.

    Pieces are joined inside blocks of ``block`` order values first, so a key
    with very many rows is spread over many tasks and only its joined blocks
    meet; the final value itself is one string by definition.
    """

    def join(df: DataFrame, by: list[str], at: str, out: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(F.col(at), F.col(out))))
        return df.groupBy(*by).agg(
            F.array_join(F.transform(ordered, lambda r: r[out]), separator).alias(out)
        )

    blocked = rows.where(F.col(text).isNotNull()).select(
        *keys, F.floor(F.col(order) / block).alias("_block"), F.col(order).alias("_at"), text
    )
    return join(join(blocked, [*keys, "_block"], "_at", text), keys, "_block", text)
