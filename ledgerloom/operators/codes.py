"""Hierarchical item codes: building, indexing, neighbours and scoring by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scores import dot, l2_normalised, shared_levels
from ledgerloom.operators.lookup import shuffled
from ledgerloom.operators.numbering import numbered
from ledgerloom.sources.durable import durable

LEVELS = ("c0", "c1", "c2")


def deduplicated(codes: DataFrame, item: str = "item_id") -> DataFrame:
    """``codes`` with ``dedup``: 0 for a code of one item, else the items' numbers 1, 2, ... in item order."""
    sizes = codes.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("leaf"))
    ranked = numbered(codes, LEVELS, [item], "rank")
    return ranked.join(sizes, list(LEVELS)).withColumn("dedup", F.when(F.col("leaf") > 1, F.col("rank")).otherwise(0)).drop("rank")


def code_key(dedup: bool = False):
    return F.concat_ws(",", *LEVELS, *([F.col("dedup").cast("string")] if dedup else []))


def prefix(depth: int):
    """The first ``depth`` levels, at least one and at most all."""
    return F.concat_ws(",", *LEVELS[: max(1, min(depth, len(LEVELS)))])


def leaf_sizes(codes: DataFrame) -> DataFrame:
    return codes.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("items"))


def health(codes: DataFrame) -> DataFrame:
    """One row: items, distinct codes, collision rate and how many codes each level uses."""
    return codes.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct(*LEVELS).alias("codes"), *(F.countDistinct(c).alias(f"used_{c}") for c in LEVELS)
    ).select("*", F.round(1 - F.col("codes") / F.col("items"), 6).alias("collision_rate"), F.round(F.log1p(F.col("items") / F.col("codes")), 6).alias("log_leaf"))


def _met(candidates: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Each candidate with each item of the history of its key: ``alike`` (codes; NULL without one on either side) and ``near`` (cosine; vectors have norm 1)."""
    past = history.select(key, *(F.col(c).alias(f"h{c}") for c in LEVELS), F.col("embedding").alias("past"))
    alike = F.when(F.col("c0").isNotNull() & F.col("hc0").isNotNull(), shared_levels([F.col(c) for c in LEVELS], [F.col(f"h{c}") for c in LEVELS]))
    return candidates.join(shuffled(past), key, "left").withColumns({"alike": alike, "near": dot(F.col("embedding"), F.col("past"))})


def blended_scores(candidates: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """(key, item_id, pos, score): 0.7 of the best likeness of codes and 0.3 of the best cosine, the former alone where
    there is no cosine; 0 without a code of the candidate or in the history. Both sides bring codes and embedding (of norm 1), NULL
    where they have none; histories must be bounded per key."""
    best = _met(candidates, history, key).groupBy(key, "item_id", "pos").agg(F.max("alike").alias("alike"), F.max("near").alias("near"))
    return best.select(key, "item_id", "pos", F.coalesce(0.7 * F.col("alike") + 0.3 * F.col("near"), "alike", F.lit(0.0)).alias("score"))


def rescored(candidates: DataFrame, history: DataFrame, key: str, best: int = 3) -> DataFrame:
    """(key, item_id, pos, score, rank): by the mean of the ``best`` largest cosines (-1 without an embedding), then by likeness
    of codes, then by ``pos``. Keys without embeddings in their history are left out."""
    from ledgerloom.functions.aggregates import bounded_heap

    met = _met(candidates.join(shuffled(history.where("embedding IS NOT NULL").select(key)), key, "left_semi"), history, key)
    s = met.groupBy(key, "item_id", "pos").agg(bounded_heap(-F.col("near"), best).alias("h"), F.coalesce(F.max("alike"), F.lit(0.0)).alias("alike"))
    mean = F.when(F.size("h") > 0, -F.aggregate("h", F.lit(0.0), lambda a, x: a + x) / F.size("h")).otherwise(-1.0)
    s = s.select(key, "item_id", "pos", F.round(mean, 9).alias("score"), F.round("alike", 9).alias("alike"))
    # A key's candidates are bounded by its draw.
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("alike"), "pos"))).drop("alike")


def quantised(vectors: DataFrame, item: str, vector: str, books: Sequence[DataFrame]) -> DataFrame:
    """(item, code0, code1, ..): residual quantisation with given codebooks (code, centre).

    At each level the nearest centre is taken, the lowest code among equals, and
    subtracted; what is left goes to the next level. Codebooks are model
    parameters, bounded by construction; each is read once and put into the plan
    as a literal array, so vectors are scanned once and nothing is shuffled.
    """
    work = vectors.select(F.col(item), F.transform(vector, lambda x: x.cast("double")).alias("rest"))
    for level, book in enumerate(books):
        rows = sorted((r["code"], [float(x) for x in r["centre"]]) for r in book.collect())
        centres = work.sparkSession.createDataFrame([([(c, v) for c, v in rows],)], "book array<struct<code:int,centre:array<double>>>")
        work = work.crossJoin(F.broadcast(centres))  # one row
        far = lambda e: dot(F.zip_with("rest", e["centre"], lambda x, y: x - y), F.zip_with("rest", e["centre"], lambda x, y: x - y))
        work = work.withColumn("best", F.array_min(F.transform("book", lambda e: F.struct(F.round(far(e), 9).alias("d"), e["code"].alias("code"), e["centre"].alias("centre")))))
        work = work.withColumn(f"code{level}", F.col("best.code")).withColumn("rest", F.zip_with("rest", F.col("best.centre"), lambda x, y: x - y)).drop("best", "book")
    return work.drop("rest")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 512, blocks: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, similarity): for each query vector its ``k`` most similar others, ties by id.

    ``queries`` and ``vectors`` have vec_id and embedding; rows without either are left out. The stated
    queries go against all vectors: ``blocks`` rows of ``block`` queries each are broadcast, each task keeps a
    heap of ``k`` per query, and only the heaps are shuffled. With more queries than that there is a pass over the
    vectors for every further blocks * block of them, whose heaps are written before the next begins.
    """
    from itertools import batched

    from ledgerloom.functions.aggregates import bounded_heap

    spark = vectors.sparkSession
    unit = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint"), l2_normalised(F.col("embedding")).alias("embedding"))
    vectors = unit(vectors)

    def against(rows: Sequence) -> DataFrame:
        asked = spark.createDataFrame([([tuple(r) for r in part],) for part in batched(rows, block)], "asked array<struct<query_id:bigint,query:array<double>>>")
        pairs = vectors.crossJoin(F.broadcast(asked)).select("vec_id", "embedding", F.inline("asked")).where("vec_id != query_id")
        heap = bounded_heap(F.struct((-F.round(dot(F.col("query"), F.col("embedding")), 9)).alias("far"), F.col("vec_id")), k)
        return pairs.groupBy("query_id").agg(heap.alias("h")).select("query_id", F.posexplode("h").alias("rank", "h")).select("query_id", (F.col("rank") + 1).alias("rank"), "h.vec_id", (-F.col("h.far")).alias("similarity"))

    out, following = None, batched(unit(queries).toLocalIterator(), block * blocks)
    rows, ahead = next(following, ()), next(following, None)
    if not ahead:
        return against(rows)
    while rows:
        part = durable(against(rows), "nearest")
        out = part if out is None else out.unionByName(part)
        rows, ahead = ahead, next(following, None)
    return out
