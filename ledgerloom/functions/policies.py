"""Choosing modules from evidence, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """The defaults of the evidence policy."""

    dense_reviews: int = 5
    dense_chars: int = 2000
    rich: float = 0.45
    margin: float = 0.02
    top1: float = 0.15
    sparse_reviews: int = 5


def evidence_reason(reviews: Column, chars: Column, richness: Column, margin: Column, top1: Column, t: Thresholds = Thresholds()) -> Column:
    """Why codes are shown or not: dense history and rich metadata make them redundant, a sparse history or confident codes call for them."""
    dense, rich = (reviews >= t.dense_reviews) | (chars >= t.dense_chars), richness >= t.rich
    confident = (margin >= t.margin) | (top1 >= t.top1)
    return F.when(dense & rich, "redundant").when(reviews <= t.sparse_reviews, "sparse").when(confident, "confident").otherwise("unsure")


def modules(reviews: Column, reason: Column) -> Column:
    """History if there is any, metadata always, codes if the reason calls for them."""
    return F.concat_ws("+", F.when(reviews >= 1, "H"), F.lit("M"), F.when(reason.isin("sparse", "confident"), "S"))


def scenario_modules(reviews: Column, condition: Column, sparse: int = 5) -> Column:
    """The older choice, by condition."""
    few = F.when(reviews <= sparse, "H+M+S").otherwise("H+M")
    return F.when(reviews == 0, "M+S").when(condition == "evolving_interest", "H+M").when(condition == "cold_start_user", "H+M+S").otherwise(few)
