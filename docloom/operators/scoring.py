"""Top-k scoring of a large chunk table against a set of queries.

Exact similarity search has to look at every chunk for every query, but it
never has to write such pairs down. Each task turns its batches of chunks into
arrays, multiplies them with the query matrix and keeps only the best ``k``
chunks of every query, so a task emits at most ``k`` rows per query and leg.

The queries are broadcast only after their number is checked. Larger query sets
are cut into blocks and matched to blocks of chunks by an ordinary grouped
shuffle whose groups have a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import drop_path, scratch_path, settings, small_batches

BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 128 * 1024 * 1024
BLOCK_ROWS = 20_000
#: What a step holds at most: (chunk, query) cells, chunks, queries, and products of terms.
TILE_CELLS = 1_000_000
TILE_ROWS = 2_048
TILE_QUERIES = 512
TILE_LINKS = 1_000_000
MERGE_GROUPS = 64
FILTERS = ("domain", "document_id", "acl", "chunk_type")


def round6(x: np.ndarray) -> np.ndarray:
    """Round half away from zero to six digits, as SQL ``round`` does."""
    out = np.abs(x)
    out *= 1e6
    out += 0.5
    np.floor(out, out=out)
    out *= np.sign(x)
    out /= 1e6
    return out


def by_width(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each width; NULL and empty vectors are left out."""
    lists = column.combine_chunks()
    widths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = {}
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        found[width] = rows, flat.astype(np.float64).reshape(len(rows), width)
    return found


class QueryBlock:
    """Arrays of one set of queries: matrix, postings, filters and limits."""

    def __init__(self, rows: pa.Table, k: int, id_type: pa.DataType):
        names = set(rows.column_names)
        self.ids = rows["query_id"].to_pylist()
        self.id_type = id_type
        n = len(self.ids)
        asked = rows["top_k"].to_pylist() if "top_k" in names else [None] * n
        self.k = [a or k for a in asked]
        self.dense = by_width(rows["dense"]) if "dense" in names and n else {}
        self.columns: dict[str, int] = {}
        if "terms" in names:
            postings: list[list[tuple[int, float]]] = []
            for q, terms in enumerate(rows["terms"].to_pylist()):
                for term in terms or []:
                    at = self.columns.setdefault(term["token"], len(postings))
                    if at == len(postings):
                        postings.append([])
                    postings[at].append((q, term["weight"]))
            self.fan = np.array([len(p) for p in postings] or [0])
            self.first = np.concatenate([[0], np.cumsum(self.fan)])
            flat = [pair for p in postings for pair in p]
            self.to_query = np.array([q for q, _ in flat], dtype=np.int64)
            self.to_weight = np.array([w for _, w in flat], dtype=np.float64)
            self.vocabulary = pa.array(list(self.columns), pa.string())
            # A small set of queries is a plain matrix of its terms.
            self.weights = None
            if 0 < len(postings) * n <= TILE_CELLS * 2:
                at = np.repeat(np.arange(len(postings)), self.fan) * n + self.to_query
                self.weights = np.bincount(at, self.to_weight, len(postings) * n).reshape(-1, n)
        # Queries with the same filter share one mask.
        self.groups: dict[tuple, list[int]] = {}
        taken = {c: rows[c].to_pylist() for c in FILTERS if c in names}
        kinds = rows["chunk_types"].to_pylist() if "chunk_types" in names else [None] * n
        for q in range(n):
            acl = taken["acl"][q] if "acl" in taken else None
            key = (
                (taken["domain"][q] if "domain" in taken else None) or None,
                (taken["document_id"][q] if "document_id" in taken else None) or None,
                tuple(acl) if acl else None,
                tuple(kinds[q]) if kinds[q] else None,
            )
            self.groups.setdefault(key, []).append(q)

    def masks(self, batch: pa.Table) -> list[tuple[list[int], np.ndarray | None]]:
        """Which rows of the batch each group of queries may see (None: all)."""
        out = []
        for wanted, members in self.groups.items():
            mask = None
            for column, value in zip(FILTERS, wanted, strict=True):
                if value is None:
                    continue
                allowed = pa.array(value if isinstance(value, tuple) else (value,), pa.string())
                one = pc.is_in(batch[column], allowed).to_numpy(zero_copy_only=False)
                mask = one if mask is None else mask & one
            out.append((members, mask))
        return out

    def dense_scores(self, vectors: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Scores of vectors of equal width, of ``n`` chunks; others never meet."""
        out = np.full((n, len(self.ids)), -np.inf)
        for width, (rows, matrix) in vectors.items():
            if width in self.dense:
                queries, asked = self.dense[width]
                out[np.ix_(rows, queries)] = matrix @ asked.T
        return out

    def sparse_scores(self, batch: pa.Table) -> np.ndarray:
        n, width = batch.num_rows, len(self.ids)
        lists = batch["terms"].combine_chunks()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        terms = lists.flatten()
        # Field access through the struct array keeps everything in Arrow.
        token, weight = terms.field(0), terms.field(1).to_numpy(zero_copy_only=False)
        at = pc.index_in(token, self.vocabulary)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), counts)[known]
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        weight = weight[known]
        if self.weights is not None:
            return self._sparse_product(row, at, weight, n)
        fan = self.fan[at]
        # Common terms link a chunk to most queries: whole chunks go on until their links fill a step.
        upto = np.concatenate([[0], np.cumsum(np.bincount(row, fan, n))])
        entry = np.searchsorted(row, np.arange(n + 1))
        out = np.empty((n, width))
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + TILE_LINKS, "right")) - 1)
            held = slice(entry[begin], entry[end])
            links = fan[held]
            inner = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
            link = np.repeat(self.first[at[held]], links) + inner
            cell = np.repeat(row[held] - begin, links) * width + self.to_query[link]
            value = np.repeat(weight[held], links) * self.to_weight[link]
            out[begin:end] = np.bincount(cell, value, (end - begin) * width).reshape(-1, width)
            begin = end
        return out

    def _sparse_product(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Scores by a matrix of the terms that any query has, a few chunks at a time."""
        terms = len(self.weights)
        step = max(1, TILE_CELLS // terms)
        entry = np.searchsorted(row, np.arange(0, n + step, step))
        out = np.empty((n, self.weights.shape[1]))
        for i, begin in enumerate(range(0, n, step)):
            end = min(n, begin + step)
            held = slice(entry[i], entry[i + 1])
            cell = (row[held] - begin) * terms + at[held]
            matrix = np.bincount(cell, weight[held], (end - begin) * terms).reshape(-1, terms)
            np.matmul(matrix, self.weights, out=out[begin:end])
        return out


class Best:
    """Running best ``k`` per query: higher score first, then smaller id."""

    def __init__(self, block: QueryBlock):
        self.block = block
        self.score = [np.empty(0)] * len(block.ids)
        self.chunk = [None] * len(block.ids)
        self.carried = [None] * len(block.ids)
        # Score to reach per query; below any real score until k chunks are held.
        self.bar = np.full(len(block.ids), np.finfo(np.float64).min)

    def offer_all(self, members: list[int], rows: np.ndarray, matrix: np.ndarray, ids: np.ndarray,
                  carried: np.ndarray | None) -> None:
        """Offer ``rows`` to the queries ``members``; most queries are ruled out at once."""
        seen = matrix if len(rows) == len(matrix) else matrix[rows]
        held = np.asarray(members)
        for q in held[seen.max(axis=0)[held] >= self.bar[held]].tolist():
            scores = seen[:, q]
            good = np.flatnonzero(scores >= self.bar[q])
            self._offer(q, rows[good], scores[good], ids, carried)

    def _offer(self, q: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray,
               carried: np.ndarray | None) -> None:
        k = self.block.k[q]
        if len(rows) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= edge
            rows, scores = rows[keep], scores[keep]
        names = ids[rows]
        extra = None if carried is None else carried[rows]
        if self.chunk[q] is not None:
            names = np.concatenate([self.chunk[q], names])
            scores = np.concatenate([self.score[q], scores])
            extra = None if carried is None else np.concatenate([self.carried[q], extra])
        order = np.lexsort((names, -scores))[:k]
        self.score[q], self.chunk[q] = scores[order], names[order]
        self.carried[q] = None if extra is None else extra[order]
        if len(order) == k:
            self.bar[q] = self.score[q][-1]

    def rows(self, stage: str) -> pa.RecordBatch:
        used = [q for q in range(len(self.block.ids)) if self.chunk[q] is not None]
        query = [self.block.ids[q] for q in used for _ in self.score[q]]
        chunk = [c for q in used for c in self.chunk[q].tolist()]
        score = [float(s) for q in used for s in self.score[q]]
        arrays = [
            pa.array(query, self.block.query_type),
            pa.array(chunk, self.block.id_type),
            pa.array([stage] * len(chunk), pa.string()),
            pa.array(score, pa.float64()),
            pa.array([self.block.k[q] for q in used for _ in self.score[q]], pa.int32()),
        ]
        names = ["query_id", "chunk_id", "stage", "score", "_k"]
        if self.block.carry:
            held = [c for q in used for c in self.carried[q].tolist()]
            arrays.append(pa.array(held, pa.string()))
            names.append(self.block.carry)
        return pa.RecordBatch.from_arrays(arrays, names)


def _score(
    batches: Iterator[pa.RecordBatch], blocks: list[QueryBlock], legs: tuple[str, ...], options: dict
) -> Iterator[pa.RecordBatch]:
    """Every tile of chunks meets one block of queries after the other."""
    best = [{leg: Best(block) for leg in legs} for block in blocks]
    floor = options.get("threshold", -np.inf)
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = pa.Table.from_batches([batch.slice(start, TILE_ROWS)])
            ids = np.asarray(part["chunk_id"].to_pylist())
            carried = part[blocks[0].carry].to_numpy() if blocks[0].carry else None
            vectors = by_width(part["dense"]) if "dense" in legs else {}
            for block, held in zip(blocks, best, strict=True):
                masks = block.masks(part)
                for leg in legs:
                    dense = leg == "dense"
                    matrix = block.dense_scores(vectors, len(ids)) if dense else block.sparse_scores(part)
                    matrix = round6(matrix)
                    shut = matrix < floor
                    if leg == "sparse":
                        shut |= matrix <= 0
                    matrix[shut] = -np.inf
                    for members, mask in masks:
                        rows = np.arange(len(ids)) if mask is None else np.flatnonzero(mask)
                        if len(rows):
                            held[leg].offer_all(members, rows, matrix, ids, carried)
    for held in best:
        for leg in legs:
            yield held[leg].rows(leg)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    kind = df.schema[column].dataType.simpleString()
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def with_list_filters(queries: DataFrame) -> DataFrame:
    """Allow one value as well as a list for the filters that take any of several."""
    for name in ("acl", "chunk_types"):
        if name in queries.columns and queries.schema[name].dataType.simpleString() == "string":
            one = F.when(F.col(name) != "", F.array(F.col(name)))
            queries = queries.withColumn(name, one)
    return queries


def _prepared(chunks, queries, legs, k, options, carry):
    """Both sides with the columns that are used, how to build blocks of queries, and the schema of hits."""
    small_batches(chunks.sparkSession)
    needed = {"query_id", "top_k", "chunk_types", *legs_columns(legs), *FILTERS, *options.get("columns", [])}
    queries = with_list_filters(queries.select(*[c for c in queries.columns if c in needed]))
    used = [c for c in FILTERS if c in queries.columns and c in chunks.columns]
    if "chunk_types" in queries.columns and "chunk_type" not in used:
        used.append("chunk_type")
    extra = [*options.get("columns", []), *([carry] if carry and carry not in used else [])]
    chunks = chunks.select("chunk_id", *legs_columns(legs), *used, *extra)
    query_type, id_type = _arrow(queries, "query_id"), _arrow(chunks, "chunk_id")
    names = {"bigint": "bigint", "int": "int", "string": "string"}
    ddl = (
        f"query_id {names[queries.schema['query_id'].dataType.simpleString()]},"
        f"chunk_id {names[chunks.schema['chunk_id'].dataType.simpleString()]},"
        "stage string, score double, _k int"
    ) + (f", {carry} string" if carry else "")

    def build(rows: pa.Table) -> list[QueryBlock]:
        blocks = []
        for start in range(0, max(1, rows.num_rows), TILE_QUERIES):
            blocks.append(QueryBlock(rows.slice(start, TILE_QUERIES), k, id_type))
            blocks[-1].query_type, blocks[-1].carry = query_type, carry
        return blocks

    return chunks, queries, build, ddl


def score_topk(
    chunks: DataFrame,
    queries: DataFrame,
    legs: tuple[str, ...],
    k: int,
    options: dict | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    carry: str | None = None,
) -> DataFrame:
    """Best ``k`` chunks per query and leg: ``query_id, chunk_id, stage, score, rank``.

    Chunks: ``chunk_id`` with ``dense`` and/or ``terms``, plus the filter columns
    ``domain, document_id, acl, chunk_type`` that the queries use. Queries:
    ``query_id``, the same vectors, optional filters (``acl`` and ``chunk_types``
    as arrays) and optional ``top_k`` (NULL or 0: ``k``). ``carry`` names one string
    column of the chunks to hand through, such as the document id.
    """
    options = options or {}
    spark = chunks.sparkSession
    chunks, queries, build, ddl = _prepared(chunks, queries, legs, k, options, carry)

    # Bounded look: one row more than the limit is enough to decide.
    head = queries.limit(broadcast_queries + 1).toArrow()
    if head.num_rows <= broadcast_queries and head.nbytes <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(head)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _score(batches, build(held.value), legs, options)

        hits = chunks.mapInArrow(run, ddl)
    else:
        hits = _blocked(chunks, queries, build, legs, options, ddl)
    return take_best(hits)


def legs_columns(legs: tuple[str, ...]) -> list[str]:
    return [{"dense": "dense", "sparse": "terms"}[leg] for leg in legs]


def _blocked(chunks, queries, build, legs, options, ddl) -> DataFrame:
    """Blocks of chunks meet blocks of queries; block sizes are bounded by construction."""
    chunk_blocks = max(1, -(-chunks.select("chunk_id").count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.select("query_id").count() // BROADCAST_QUERIES))
    long = lambda n: F.lit(n).cast("bigint")
    block_of = lambda key, n: F.pmod(F.xxhash64(key), long(n))
    every = lambda n: F.explode(F.sequence(long(0), long(n - 1)))
    left = chunks.withColumn("_c", block_of("chunk_id", chunk_blocks)).withColumn(
        "_q", every(query_blocks)
    )
    right = queries.withColumn("_q", block_of("query_id", query_blocks)).withColumn(
        "_c", every(chunk_blocks)
    )

    return _meet(left, right, ["_c", "_q"], build, legs, options, ddl)


def _meet(left, right, keys, build, legs, options, ddl) -> DataFrame:
    """Hits of the chunks and queries with equal keys, block by block."""

    def run(block_chunks: pa.Table, block_queries: pa.Table) -> pa.Table:
        if not block_chunks.num_rows or not block_queries.num_rows:
            (empty,) = build(block_queries.slice(0, 0))
            return pa.Table.from_batches([Best(empty).rows(legs[0])])
        out = list(
            _score(iter(block_chunks.to_batches()), build(block_queries), legs, options)
        )
        return pa.Table.from_batches(out)

    # Columns of their own: both sides may come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, ddl)


def score_in_cells(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks per query by cosine among chunks of equal ``cell``; a query has a row per cell.

    A cell with many chunks, or asked by many queries, is dealt out: every block of its
    chunks meets every block of its queries in a group of its own.
    """
    chunks, queries, build, ddl = _prepared(chunks, queries, ("dense",), k, {"columns": ["cell"]}, None)
    blocks = lambda df, rows, name: df.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / rows).alias(name)
    )
    # One row per cell.
    plan = F.broadcast(
        blocks(chunks, BLOCK_ROWS, "_cs").join(blocks(queries, BROADCAST_QUERIES, "_qs"), "cell")
    )
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    left = (
        chunks.join(plan, "cell")
        .withColumn("_c", F.pmod(F.xxhash64("chunk_id"), F.col("_cs")))
        .withColumn("_q", every("_qs"))
        .drop("_cs", "_qs")
    )
    right = (
        queries.join(plan, "cell")
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_qs")))
        .withColumn("_c", every("_cs"))
        .drop("_cs", "_qs")
    )
    return take_best(_meet(left, right, ["cell", "_c", "_q"], build, ("dense",), {}, ddl))


#: Directions of the projection that rules pairs out, rows they are fitted on, and pairs scored at once.
DIRECTIONS = 96
FIT_ROWS = 2_048
PAIR_STEP = 8_192
#: Rows that others are put in order by, and cells per pair above which pairs are scored one by one.
CORNERS = 64
SPARSE = 32


def _short(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Forms whose products are never below those of the rows.

    A product is that of the projections on orthonormal directions and of the rests, and the
    latter is at most the product of their lengths.
    """
    kept = rows @ axes
    rest = np.einsum("ij,ij->i", rows, rows) - np.einsum("ij,ij->i", kept, kept)
    return np.column_stack([kept, np.sqrt(np.maximum(rest, 0.0))]).astype(np.float32)


class Side:
    """Vectors that many others are compared with: their short forms and the order they are looked through in."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.order, self.axes = rows, np.arange(len(rows)), None
        if not len(rows) or rows.shape[1] <= 2 * DIRECTIONS or not np.isfinite(rows).all():
            return
        # Any directions do; the main ones of some rows leave the shortest rests.
        seen = rows[:: -(-len(rows) // FIT_ROWS)]
        self.axes = np.linalg.eigh(seen.T @ seen)[1][:, -DIRECTIONS:]
        short = _short(rows, self.axes)
        self.corners = short[:: -(-len(rows) // CORNERS)]
        self.order = self.by_corner(short)
        self.short, self.longest = short[self.order], _longest(rows)

    def by_corner(self, short: np.ndarray) -> np.ndarray:
        """Rows of one direction stand together, so that close pairs fill few tiles."""
        return np.argsort((short @ self.corners.T).argmax(axis=1), kind="stable")


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0.0)))


def _close_pairs(
    left: np.ndarray, right: np.ndarray | Side, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of both sides and rounded products of all pairs that reach the threshold."""
    known = right if isinstance(right, Side) else Side(right)
    right, l_order, r_order, short = known.rows, np.arange(len(left)), known.order, None
    if known.axes is not None and np.isfinite(left).all():
        mine = _short(left, known.axes)
        l_order = known.by_corner(mine)
        short = mine[l_order], known.short
        # Far more than single precision loses.
        floor = np.float32(threshold - 1e-6 - 1e-4 * max(1.0, _longest(left) * known.longest))
    side = int(TILE_CELLS**0.5)
    for begin, start in product(range(0, len(left), side), range(0, len(right), side)):
        i, j = l_order[begin : begin + side], r_order[start : start + side]
        few = None
        if short is not None:
            maybe = short[0][begin : begin + side] @ short[1][start : start + side].T >= floor
            rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if not len(rows):
                continue
            few = np.nonzero(maybe[np.ix_(rows, columns)])
            i, j = i[rows], j[columns]
            if len(few[0]) * SPARSE > len(i) * len(j):
                few = np.nonzero(left[i].astype(np.float32) @ right[j].astype(np.float32).T >= floor)
        if few is None or len(few[0]) * SPARSE > len(i) * len(j):
            score = round6(left[i] @ right[j].T)
            a, b = np.nonzero(score >= threshold)
            yield i[a], j[b], score[a, b]
            continue
        for at in range(0, len(few[0]), PAIR_STEP):
            a, b = i[few[0][at : at + PAIR_STEP]], j[few[1][at : at + PAIR_STEP]]
            score = round6(np.einsum("ij,ij->i", left[a], right[b]))
            good = score >= threshold
            yield a[good], b[good], score[good]


def _best_of_pairs(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (later row, earlier row, score) the best of each later row: higher score, then smaller number."""
    later, earlier, score = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.lexsort((earlier, -score, later))
    later, earlier, score = later[order], earlier[order], score[order]
    first = np.append(True, later[1:] != later[:-1])[: len(later)]
    return later[first], earlier[first], score[first]


#: Rows and bytes of a task that meet a block at once, rows of a file of sorted vectors, and rounds whose winners are kept apart.
LEFT_ROWS = 8_192
LEFT_BYTES = 32 * 1024 * 1024
FILE_ROWS = 4_096
ROUNDS = 16


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of bounded size."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if held and (rows + batch.num_rows > LEFT_ROWS or size + batch.nbytes > LEFT_BYTES):
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _closest_in(block: pa.Table, part: pa.Table, sides: dict, threshold: float) -> tuple[np.ndarray, ...]:
    """Row numbers of the part and of the block, and scores: for each row the closest one before it of another id."""
    ids, before = (np.asarray(x["chunk_id"].to_pylist()) for x in (part, block))
    at, earlier = (x["_at"].to_numpy() for x in (part, block))
    found, size = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    for width, (rows, matrix) in by_width(part["dense"]).items():
        if width not in sides:
            continue
        known, side = sides[width]
        for i, j, score in _close_pairs(matrix, side, threshold):
            i, j = rows[i], known[j]
            good = (earlier[j] < at[i]) & (before[j] != ids[i])
            found.append((i[good], j[good], score[good]))
            size += int(good.sum())
            if size > TILE_CELLS:
                found = [_best_of_pairs(found)]
                size = 0
    return _best_of_pairs(found)


def _blocks(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Cuts rows numbered from the given starts into ranges of numbers with at most so many rows."""
    ranges, rows = [], 0
    for start, count in sorted(sizes):
        if ranges and rows + count <= most:
            ranges[-1], rows = (ranges[-1][0], start + count), rows + count
            continue
        for begin in range(0, count, most):
            rows = min(most, count - begin)
            ranges.append((start + begin, start + begin + rows))
    return ranges


def closest_before(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every id the closest row with a smaller id at or above ``threshold``: ``query_id, chunk_id, score``.

    The rows are sorted by id and written once. Then one block of bounded size after the other is
    broadcast to the rows that come after its first, so no vector is moved again, however many
    blocks there are; only the winners of a round are written. Products of short forms in single
    precision rule out almost all pairs; what is left is compared exactly.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.where("chunk_id is not null and dense is not null").select("chunk_id", "dense")
    count, cores = rows.count(), spark.sparkContext.defaultParallelism
    files = max(1, -(-count // min(FILE_ROWS, block_rows)), min(2 * cores, -(-count // 1000)))
    # Numbers rise with the ids and are consecutive in each file.
    dealt = rows.repartitionByRange(files, "chunk_id").sortWithinPartitions("chunk_id")
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path := scratch_path(spark, "sorted"))
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy(F.shiftright("_at", 33)).agg(F.min("_at"), F.count(F.lit(1)), F.max(F.size("dense"))).collect()
    most = max(1, min(block_rows, BROADCAST_BYTES // (8 * max([1, *[size[3] for size in sizes]]))))
    id_type, kind = _arrow(rows, "chunk_id"), rows.schema["chunk_id"].dataType.simpleString()
    ddl = f"query_id {kind}, chunk_id {kind}, score double"
    best = F.min(F.struct((-F.col("score")).alias("_far"), "chunk_id", "score")).alias("_best")

    def winners(paths: list[str]) -> DataFrame:
        read = spark.read.schema(ddl).parquet(*paths)
        return read.groupBy("query_id").agg(best).select("query_id", "_best.chunk_id", "_best.score")

    def written(found: DataFrame) -> str:
        found.write.parquet(out := scratch_path(spark, "closest"))
        return out

    def search(low: int, high: int) -> str:
        block = dealt.where((F.col("_at") >= low) & (F.col("_at") < high)).toArrow().sort_by("_at")
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides = {width: (known, Side(matrix)) for width, (known, matrix) in by_width(held.value["dense"]).items()}
            for part in _gathered(batches):
                i, j, score = _closest_in(held.value, part, sides, threshold)
                names = [part["chunk_id"].take(pa.array(i)), held.value["chunk_id"].take(pa.array(j))]
                columns = [*[x.combine_chunks().cast(id_type) for x in names], pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

        out = written(dealt.where(F.col("_at") >= low).mapInArrow(run, ddl))
        held.destroy()
        return out

    found: list[str] = []
    with settings(spark, {"spark.sql.files.minPartitionNum": 4 * cores}):
        for low, high in _blocks([(start, n) for _, start, n, _ in sizes], most):
            found.append(search(low, high))
            if len(found) > ROUNDS:
                merged = written(winners(found))
                for each in found:
                    drop_path(spark, each)
                found = [merged]
    drop_path(spark, path)
    return winners(found) if found else spark.createDataFrame([], ddl)


def take_best(hits: DataFrame) -> DataFrame:
    """Final ranks over the per-task winners, by way of the winners of groups of tasks.

    Every task sends its best rows of every query; the limit of a query travels with
    them. The first level keeps the best of each group of tasks, so the last one sees
    at most ``MERGE_GROUPS`` lists per query, however many tasks there were.
    """
    order = [F.desc("score"), F.col("chunk_id")]
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))
    level = Window.partitionBy("query_id", "stage", "_group").orderBy(*order)
    last = Window.partitionBy("query_id", "stage").orderBy(*order)
    return (
        hits.withColumn("_group", group)
        .withColumn("rank", F.row_number().over(level))
        .where(F.col("rank") <= F.col("_k"))
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= F.col("_k"))
        .drop("_group", "_k")
    )
