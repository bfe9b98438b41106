"""Models that are trained here: residual codebooks, a matrix factorisation baseline, a regression over features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.durable import durable


def residual_codes(vectors: DataFrame, item: str, vector: str, levels: int = 3, k: int = 8, seed: int = 42) -> DataFrame:
    """(item, code0, code1, ..): k-means on the vectors, then on what each level leaves over.

    Training is distributed; a level's centres (k vectors) are all that the driver holds.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    work = vectors.select(F.col(item), F.transform(vector, lambda x: x.cast("double")).alias("rest"))
    for level in range(levels):
        fit = work.withColumn("features", array_to_vector("rest"))
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"code{level}", maxIter=10).fit(fit)
        centres = work.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], f"code{level} int, centre array<double>")
        work = model.transform(fit).drop("features").join(F.broadcast(centres), f"code{level}").withColumn("rest", F.zip_with("rest", "centre", lambda a, b: a - b)).drop("centre")
    return work.select(item, *(f"code{i}" for i in range(levels)))


def covariate_shift(df: DataFrame, here: str, features: Sequence[str], folds: int = 5, key: str = "run_index") -> DataFrame:
    """One row (auc, rows): how well a logistic model on ``features`` tells rows with ``here`` from the others, each row
    judged by a model that has not seen its fold (a hash of ``key``). About 0.5: no shift. Missing features count 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from ledgerloom.operators.statistics import average_ranks

    filled = df.select(F.col(here).cast("double").alias("label"), *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    work = durable(filled, "shift")
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__ll_raw"), StandardScaler(inputCol="__ll_raw", outputCol="__ll_x", withMean=True), LogisticRegression(featuresCol="__ll_x", labelCol="label", probabilityCol="__ll_p")])
    out = None
    for fold in range(folds):
        part = steps.fit(work.where(F.col("fold") != fold)).transform(work.where(F.col("fold") == fold)).select("label", F.round(vector_to_array("__ll_p")[1], 9).alias("p"))
        out = part if out is None else out.unionByName(part)
    ranks = average_ranks(durable(out, "judged"), "p", "rank")
    s = ranks.agg(F.sum(F.when(F.col("label") == 1, F.col("rank"))).alias("r"), F.count_if(F.col("label") == 1).cast("double").alias("n"), F.count_if(F.col("label") == 0).cast("double").alias("m"))
    return s.select(F.try_divide(F.col("r") - F.col("n") * (F.col("n") + 1) / 2, F.col("n") * F.col("m")).alias("auc"), (F.col("n") + F.col("m")).cast("bigint").alias("rows"))


def factorised(log: DataFrame, user: str, item: str, weight: str, rank: int = 8, seed: int = 42):
    """An implicit-feedback model on (user, item, weight); ids must be numbers. Score pairs with ``model.transform``."""
    from pyspark.ml.recommendation import ALS

    told = log.groupBy(user, item).agg(F.sum(weight).cast("float").alias("weight"))
    als = ALS(rank=rank, maxIter=5, seed=seed, implicitPrefs=True, userCol=user, itemCol=item, ratingCol="weight", coldStartStrategy="nan")
    return als.fit(told.select(F.col(user).cast("int"), F.col(item).cast("int"), "weight"))


def held_out_regression(df: DataFrame, group: str, features: Sequence[str], target: str, regularisation: float = 1.0) -> DataFrame:
    """``df`` with ``predicted`` by a ridge fitted on all other groups, missing features filled with medians.

    One fit per group; groups are few by nature (datasets, model families).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    filled = [f"{c}_filled" for c in features]
    steps = Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__ll_raw"),
        StandardScaler(inputCol="__ll_raw", outputCol="__ll_x", withMean=True), LinearRegression(featuresCol="__ll_x", labelCol=target, predictionCol="predicted", regParam=regularisation),
    ])
    out = None
    for value in sorted(r[0] for r in df.select(group).distinct().collect()):
        part = steps.fit(df.where(F.col(group) != value)).transform(df.where(F.col(group) == value)).select(*df.columns, "predicted")
        out = part if out is None else out.unionByName(part)
    return out
