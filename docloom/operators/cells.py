"""Approximate dense search over coarse cells.

Centres are fitted on a bounded sample (spherical k-means), every chunk belongs to the
cell of its nearest centre, and a query only meets the chunks of its ``probes`` nearest
cells: an equi-join on the cell, whose candidates are then scored exactly. ``cell``
may be stored with the chunks and be their partition column; then only
probed folders are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.operators.scoring import score_in_cells

CELLS = 128
#: Nearest cells that a query meets.
PROBES = 72
#: Vectors that centres are fitted on at most; chosen by a hash of their ids.
SAMPLE_ROWS = 16_384
ROUNDS = 2
SEED = 1


def sample_vectors(chunks: DataFrame, width: int, rows: int = SAMPLE_ROWS, seed: int = SEED) -> np.ndarray:
    """At most ``rows`` vectors of the given width, in the order of their hashed ids."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string")))
    held = (
        chunks.where(F.size("dense") == width)
        .select("dense", hashed.alias("_hash"), F.col("chunk_id").alias("_id"))
        .orderBy("_hash", "_id")
        .limit(rows)
        .toArrow()
        .sort_by([("_hash", "ascending"), ("_id", "ascending")])
    )
    if not held.num_rows:
        return np.zeros((0, width))
    return np.stack(held.column("dense").to_numpy()).astype(np.float64)


def fit_cells(sample: np.ndarray, cells: int = CELLS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres, one per row: the first vectors of the sample, moved ``rounds`` times.

    A centre becomes the direction of the sum of its vectors; one without any, or whose
    vectors add up to nothing, stays.
    """
    centres = sample[:cells].copy()
    for _ in range(rounds if len(centres) else 0):
        home = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, sample)
        length = np.sqrt((total * total).sum(axis=1))
        moved = length > 1e-12
        centres[moved] = total[moved] / length[moved, None]
    return centres


def tuned_probes(sample: np.ndarray, centres: np.ndarray, recall: float = 0.95, k: int = rules.TOP_K_DENSE) -> int:
    """The least number of probes that finds this share of the best ``k`` within the sample.

    Every twentieth vector of the sample asks; the sample is compared exactly.
    """
    asked = sample[::20]
    if not len(asked) or not len(centres):
        return 1
    home = (sample @ centres.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(rank, home[best], axis=1).ravel())
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def nearest_cells(vector: Column, centres: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` nearest cells, nearest first; NULL for null vectors and those of another width."""

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            fits = [i for i, v in enumerate(batch) if v is not None and len(v) == centres.shape[1]]
            if fits and len(centres):
                by = -(np.stack([batch.iloc[i] for i in fits]).astype(np.float64) @ centres.T)
                for i, row in zip(fits, np.argsort(by, axis=1, kind="stable")[:, :n].astype(np.int32)):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return near(vector)


def add_cell(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """The chunks with ``cell``; write them partitioned by it to read probed cells only."""
    return chunks.withColumn("cell", nearest_cells(F.col("dense"), centres, 1)[0])


def ann_topk(
    chunks: DataFrame,
    queries: DataFrame,
    centres: np.ndarray,
    k: int = rules.TOP_K_DENSE,
    probes: int = PROBES,
) -> DataFrame:
    """Best ``k`` chunks per query among those of its ``probes`` nearest cells, exactly scored.

    Queries may carry the filters of exact search. Vectors that are null or of another
    width than the centres match nothing; with no centres there is no result.
    """
    if "cell" in chunks.columns:
        asked = queries.withColumn("cells", nearest_cells(F.col("dense"), centres, probes))
        # At most one number per cell comes back.
        reached = [r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]
        chunks = chunks.where(F.col("cell").isin(reached))
    else:
        chunks = add_cell(chunks, centres)
    probed = queries.withColumn("cell", F.explode(nearest_cells(F.col("dense"), centres, probes)))
    return score_in_cells(chunks.where("cell is not null"), probed, k)


def cell_recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, n (best rows that exact search has), found (of these) and recall."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return (
        exact.where(F.col("rank") <= k)
        .join(hit, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("n"), F.count("_hit").alias("found"))
        .withColumn("recall", F.round(F.col("found") / F.col("n"), 6))
    )
