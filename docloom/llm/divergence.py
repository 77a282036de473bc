"""How far the sources of a language differ in the words they use.

*Counting.* Every task sorts pointers to the starts of words over its own shards
(see ``pointer_terms``); an equal run gives the number of texts that hold a term
and its occurrences in each source. Only these counts are shuffled, after Spark
has added up those of a task.

*Shares.* Counts become smoothed whole-number shares of a source's terms, with exact
decimal arithmetic.

*Distances.* The distance of two sources is the sum of the differences of their
shares. A term that neither has adds the same for every such term, so that
part is a product; the terms that some source has correct it, in blocks of terms and
tiles of sources of bounded size. No pair of rows is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import common as C
from docloom.llm.pointer_terms import LETTERS, equal_runs

#: Text bytes of a shard; one longer text is still taken whole.
SHARD_BYTES = 8 << 20
MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Sources of a tile; two tiles of them meet in a group.
TILE = 64
#: Terms that a group of the distances has on average at most.
TERMS = 4096


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents), once per shard.

    Every (lang, source) of a shard also has a row of the empty term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text", SHARD_BYTES):
                off, buf = C.utf8(part.column("_text"))
                buf = C.LOWER[buf]
                held = equal_runs(off, buf, LETTERS)
                lang = part.column("lang").dictionary_encode()
                source = part.column("source").dictionary_encode()
                width = len(source.dictionary)
                group, mine = np.unique(
                    lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width
                    + source.indices.to_numpy(zero_copy_only=False),
                    return_inverse=True,
                )
                cell, place = np.unique(held.run * len(group) + mine[held.row], return_inverse=True)
                n = np.bincount(place, held.times, len(cell)).astype(np.int64)
                df = np.bincount(place, minlength=len(cell))
                of = np.concatenate((cell % len(group), np.arange(len(group))))
                none = np.zeros(len(group), np.int64)
                terms = [held.strings(buf, cell // len(group)), pa.array([""] * len(group), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(group[of] // width)),
                        source.dictionary.take(pa.array(group[of] % width)),
                        pa.concat_arrays([t.cast(pa.string()) for t in terms]),
                        pa.array(np.concatenate((n, none))),
                        pa.array(np.concatenate((df, none)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(n: Column, total: Column, terms: Column, scale: int, smoothing: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(scale).cast("decimal(10,0)") * wide(n + smoothing)
    out = F.call_function("div", above, wide(total + smoothing * terms)) + 1
    return F.when(terms > 0, out)


def _distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, one, two (one < two, numbers of sources), extra: what terms of any source add to V * |base difference|.

    Every block of terms has a row without a term of every source, so that sources which
    lack all its terms take part as well.
    """
    blocks, tiles = F.ceil(F.col("terms") / TERMS), F.ceil(F.col("size") / TILE)
    tile = F.floor(F.col("number") / TILE)
    fields = ["lang", "number", "base", tiles.alias("tiles"), tile.alias("mine"), "term", "p"]
    dealt = shares.select(*fields, F.pmod(F.xxhash64("term"), blocks).alias("block")).union(
        groups.where("terms > 0")
        .withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")})
        .select(*fields, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    )
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "lang",
        "block",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        *("number", "base", "term", "p"),
    )

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lang, _, i, j = (k.as_py() for k in key)
        number = group.column("number").to_numpy()
        names, column = np.unique(number, return_inverse=True)
        base = np.zeros(len(names), np.int64)
        base[column] = group.column("base").to_numpy()
        term = group.column("term").combine_chunks()
        real = term.is_valid().to_numpy(zero_copy_only=False)
        coded = term.drop_null().dictionary_encode()
        # Terms that a source lacks have its base share.
        held = np.repeat(base[None, :], len(coded.dictionary), axis=0)
        held[coded.indices.to_numpy(), column[real]] = group.column("p").drop_null().to_numpy()
        one, two, extra = [], [], []
        for k in range(len(names)):
            # Pairs within a tile belong to the group of that tile alone.
            apart = (names // TILE != names[k] // TILE) if i != j else np.ones(len(names), bool)
            to = np.flatnonzero(apart & (names > names[k]))
            if len(to):
                far = np.abs(held[:, to] - held[:, [k]]).sum(0) - len(held) * np.abs(base[to] - base[k])
                one.append(np.full(len(to), names[k]))
                two.append(names[to])
                extra.append(far)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two, extra)]
        return pa.table(
            [pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
            names=["lang", "one", "two", "extra"],
        )

    parts = met.groupBy("lang", "block", "i", "j").applyInArrow(
        run, "lang string, one long, two long, extra long"
    )
    return parts.groupBy("lang", "one", "two").agg(F.sum("extra").alias("extra"))


def source_divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    smoothing: int = SMOOTHING,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to other sources and a source's own terms.

    Null texts, languages and sources count as empty. A language keeps the terms that
    ``min_documents`` of its documents have; repeated rows are documents of their own.
    Part ``pair`` has every other source of the language, the most distant first, also
    for sources and languages without any kept term (distance 0 there). Part ``term``
    has the ``top`` terms whose share is furthest above the language's. Ties go by the
    UTF-8 bytes of the item. An empty table gives no rows; further columns are not read.
    """
    C.small_batches(docs.sparkSession)
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    read = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("_text"))
    counts = C.keep(
        term_counts(read).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")),
        "term-counts",
    )
    common = C.keep(
        counts.where("term <> ''")
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("all_n"), F.sum("df").alias("df"))
        .where(F.col("df") >= min_documents)
        .drop("df"),
        "kept-terms",
    )
    kept = C.keep(
        counts.where("term <> ''").drop("df").join(common, ["lang", "term"]), "kept-counts"
    )
    # A row for each source and language: their numbers do not depend on the documents' number.
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    languages = common.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = (
        counts.where("term = ''").select("lang", "source")
        .join(sizes, ["lang", "source"], "left")
        .join(languages, "lang", "left")
        .select("lang", "source", number.alias("number"), F.count("*").over(Window.partitionBy("lang")).alias("size"),
                zero(F.col("total")).alias("total"), zero(F.col("terms")).alias("terms"),
                zero(F.col("all_total")).alias("all_total"))
        .withColumn("base", zero(_share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), scale, smoothing)))
    )
    groups = C.keep(groups, "sources")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "number", "size", "terms", "base", "term",
        _share(F.col("n"), F.col("total"), F.col("terms"), scale, smoothing).alias("p"),
        _share(F.col("all_n"), F.col("all_total"), F.col("terms"), scale, smoothing).alias("q"),
    )

    own = (
        shares.where("p > q")
        .withColumn("value", F.col("p") - F.col("q"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")))
        .where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )

    extra = _distances(shares, groups)
    both = extra.select("lang", F.col("one").alias("a"), F.col("two").alias("b"), "extra").union(
        extra.select("lang", "two", "one", "extra")
    )
    a = groups.select("lang", "source", "terms", F.col("number").alias("a"), F.col("base").alias("base_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("base").alias("base_b"))
    far = F.col("terms") * F.abs(F.col("base_a") - F.col("base_b")) + zero(F.col("extra"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = (
        a.join(b, "lang")
        .where("a <> b")
        .join(both, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", far.cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
    )
    return pair.unionByName(own)
