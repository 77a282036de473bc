"""Array helpers on top of Spark's higher-order functions.

A document is one row, bounded by the upload size limit, so order-dependent
work on its paragraphs and sentences stays inside the row as array expressions:
nothing is shuffled and no group can become hot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Reuse a large column built from plain arguments.

    Building thousands of nested calls over the Python-JVM bridge takes seconds;
    a finished column refers to its inputs by name and fits any DataFrame.
    """
    held: dict[tuple, Column] = {}

    @wraps(build)
    def run(*args, **kwargs) -> Column:
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in held:
            held[key] = build(*args, **kwargs)
        return held[key]

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(element_type: str) -> Column:
    return F.expr(f"cast(array() as array<{element_type}>)")


def scan(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    element_type: str,
    last: Callable[[Column], Column] | None = None,
) -> Column:
    """Stateful left-to-right pass that emits a list of values per item.

    ``step(state, item)`` returns ``struct(state, emit)`` with ``emit`` an
    array; ``last(state)`` returns what is left over at the end. The pass works
    on slices so that appending to the output stays near linear for long arrays.
    """

    def over_item(acc: Column, item: Column) -> Column:
        return let(
            step(acc["state"], item),
            lambda r: F.struct(
                r["state"].alias("state"), F.concat(acc["emit"], r["emit"]).alias("emit")
            ),
        )

    def over_slice(acc: Column, piece: Column) -> Column:
        return F.aggregate(
            piece,
            F.struct(acc["state"].alias("state"), empty(element_type).alias("emit")),
            over_item,
            lambda r: F.struct(
                r["state"].alias("state"),
                F.concat(acc["done"], F.array(r["emit"])).alias("done"),
            ),
        )

    def finish(r: Column) -> Column:
        done = r["done"] if last is None else F.concat(r["done"], F.array(last(r["state"])))
        return F.flatten(done)

    def run(held: Column) -> Column:
        slices = F.when(
            F.size(held) > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(held) - 1) / F.lit(_BLOCK)).cast("int")),
                lambda b: F.slice(held, b * _BLOCK + 1, F.lit(_BLOCK)),
            ),
        ).otherwise(F.array(F.slice(held, 1, 0)))
        return F.aggregate(
            slices,
            F.struct(start.alias("state"), empty(f"array<{element_type}>").alias("done")),
            over_slice,
            finish,
        )

    return let(items, run)


def running_sums(lengths: Column) -> Column:
    """Sum of all earlier entries at every position (0 first)."""
    return scan(
        lengths,
        F.lit(0).cast("bigint"),
        lambda total, n: F.struct((total + n).alias("state"), F.array(total).alias("emit")),
        "bigint",
    )
