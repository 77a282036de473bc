"""Filters of a fixed size over ids, to keep rows from moving that no join will need.

A filter holds one bit per hashed id and can always be broadcast. Where it is
full it lets everything pass: the join that follows stays right and only moves
more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a filter; it has at most 2**FILTER_BITS / 32 rows, whatever the number of ids.
FILTER_BITS = 22


def _bit(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame, name: str) -> DataFrame:
    bits = F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("_bits")
    rows = ids.select(_bit(name).alias("bit"))
    return rows.groupBy(F.shiftright("bit", 5).alias("_slot")).agg(bits)


def passing(rows: DataFrame, held: DataFrame, name: str, maybe: bool = True) -> DataFrame:
    """Rows whose id the filter may contain, or (``maybe=False``) those whose id it does not."""
    bit, slot, bits = unused(rows, "_bit", "_slot", "_bits")
    held = held.toDF(slot, bits)
    found = rows.withColumn(bit, _bit(name)).withColumn(slot, F.shiftright(bit, 5))
    found = found.join(F.broadcast(held), slot, "inner" if maybe else "left")
    hit = F.expr(f"shiftright({bits}, cast({bit} % 32 as int)) & 1") == 1
    hit = F.coalesce(hit, F.lit(False))
    return found.where(hit if maybe else ~hit).select(rows.columns)


def newest_rows(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of the rows of each key (NULL is one too) the one with the largest version.

    Only hashes of the keys are counted, and only rows whose key may come twice are moved;
    ``rows`` itself comes back where none does.
    """
    seen, n = unused(rows, "_seen", "_n")
    hashed = rows.withColumn(seen, F.xxhash64(key))
    again = hashed.groupBy(seen).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    if again.isEmpty():
        return rows
    held = id_filter(again, seen)
    newest = Window.partitionBy(key).orderBy(F.desc(version))
    doubtful = passing(hashed, held, seen).withColumn(n, F.row_number().over(newest)).where(F.col(n) == 1)
    return passing(hashed, held, seen, maybe=False).unionByName(doubtful.drop(n)).drop(seen)


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column has it (letter case does not count)."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
