"""Queries with trained models; their results are checked by properties, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.models import covariate_shift, factorised, held_out_regression, residual_codes
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.views import gains, goals, interactions, sequences
from ledgerloom.sources.durable import durable
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()


@query()
def residual_kmeans(spark, d):
    """Three levels of eight codes each, trained on the embeddings."""
    return residual_codes(table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def factorised_rank(spark, d):
    """The target's score by a factorisation of all other interactions, per customer."""
    log = durable(interactions(spark, d), "interactions")
    goal = goals(sequences(spark, d, log))
    rest = log.join(goal.withColumnRenamed("target", "item_id"), ["user_id", "item_id"], "left_anti")
    pairs = goal.select(F.col("user_id").cast("int"), F.col("target").cast("int").alias("item_id"))
    return factorised(rest, "user_id", "item_id", "qty").transform(pairs).select("user_id", "item_id", F.nanvl("prediction", F.lit(0.0)).alias("score"))


@query()
def lodo_ridge(spark, d):
    """Gains of each dataset predicted by a ridge on the others."""
    v = gains(spark, d).select("run_index", "dataset", "hm", F.log1p(F.col("run_index") % 50).alias("size"), "voi")
    return held_out_regression(v, "dataset", ["hm", "size"], "voi").select("run_index", "dataset", F.round("voi", 6).alias("voi"), F.round("predicted", 6).alias("predicted"))


@query()
def covariate_shift_auc(spark, d):
    """Whether what is known of the runs of one half tells them from those of the other."""
    v = gains(spark, d).select("run_index", "hm", "hmt", "voi", (F.col("run_index") % 2 == 0).alias("calibration"))
    return covariate_shift(v, "calibration", ["hm", "hmt", "voi"]).select(F.round("auc", 6).alias("auc"), "rows")
