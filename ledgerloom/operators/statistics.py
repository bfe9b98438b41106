"""Statistics over paired scores: ranks, false discovery, bootstrap, threshold search, linear fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import lookup_join
from ledgerloom.operators.numbering import running_sum


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` (ties share theirs); rows without a value are left out.

    Values are counted first, so ranking handles different values only, cut over many tasks. Ranks are looked
    up by value with the rows of every value spread, for one value may hold most rows.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__ll_n")).withColumn("__ll_all", F.lit(0))
    total = running_sum(counts, ["__ll_all"], [value], "__ll_n", "__ll_upto")
    ranks = total.select(F.col(value), (F.col("__ll_upto") - (F.col("__ll_n") - 1) / 2.0).cast("double").alias(name))
    return lookup_join(df.where(F.col(value).isNotNull()), ranks, value, F.struct(*df.columns))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """``df`` with ``p_bh``. A row per test: a family has as many rows as there are comparisons, not data."""
    family = [F.col(c) for c in by] or [F.lit(0)]
    up = Window.partitionBy(*family).orderBy(p, tie)
    down = Window.partitionBy(*family).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("__ll_r", F.row_number().over(up)).withColumn("__ll_n", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    return ranked.withColumn("p_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__ll_n") / F.col("__ll_r")).over(down))).drop("__ll_r", "__ll_n")


#: A prime below 2**31, so that squares fit 64 bits.
_P = 2_147_483_647
#: Millionths of the Poisson distribution with mean 1 up to 0, 1, 2, ...
_POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917, 999_990)


def resampled(df: DataFrame, rounds: int, key: str) -> DataFrame:
    """``df`` times ``rounds`` with ``round`` and ``weight``: how often a resample of as many rows as there are has the row.

    Weights are Poisson with mean 1 and depend on key and round alone, by arithmetic that
    any engine repeats (``RESAMPLED``). Rows are exploded lazily and meant to be summed at
    once, by round, before any shuffle.
    """
    x1 = (F.pmod(F.col(key).cast("bigint"), F.lit(1_000_003)) * 7919 + F.col("round") * 104_729 + 12_345) % _P
    x2 = (F.col("__ll_x1") * F.col("__ll_x1") + 1_013_904_223) % _P
    u = (F.col("__ll_x2") * F.col("__ll_x2") + F.col("__ll_x1")) % _P % 1_000_000
    steps = df.withColumn("round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(rounds).cast("bigint")))).withColumn("__ll_x1", x1).withColumn("__ll_x2", x2).withColumn("__ll_u", u)
    deal = sum((F.when(F.col("__ll_u") >= t, 1).otherwise(0) for t in _POISSON), F.lit(0))
    return steps.withColumn("weight", deal).drop("__ll_x1", "__ll_x2", "__ll_u")


def RESAMPLED(table: str, key: str, rounds: int) -> str:  # noqa: N802
    """The same as SQL: common table expressions of which ``z`` has the rows with round and weight."""
    deal = " + ".join(f"(u >= {t})::INT" for t in _POISSON)
    return f"""z1 AS (SELECT {table}.*, j AS round, (({key} % 1000003) * 7919 + j * 104729 + 12345) % {_P} x1 FROM {table}, range(1, {rounds + 1}) t(j)), z2 AS (SELECT *, (x1 * x1 + 1013904223) % {_P} x2 FROM z1),
z3 AS (SELECT *, (x2 * x2 + x1) % {_P} % 1000000 u FROM z2), z AS (SELECT *, {deal} weight FROM z3)"""


def fit_line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Slope and intercept from moments; NULL where x does not vary."""
    spread = n * sxx - sx * sx
    slope = F.when(F.abs(spread) > 1e-12, (n * sxy - sx * sy) / spread)
    return slope, (sy - slope * sx) / n


def best_of_grid(df: DataFrame, grid: DataFrame, thresholds: dict[str, str], decide: Column, truth: str, yes: str, no: str, by: str | None = None, weight: str | None = None, strict: Sequence[str] = ()) -> DataFrame:
    """Per grid row: agreement of ``decide`` with ``truth`` and mean of what the decision earns.

    ``thresholds`` maps a data column to the grid column it is compared with: ``decide`` reads
    ``ge_<column>``, for those in ``strict`` also ``gt_<column>``. Missing values reach nothing.
    Rows are first counted by the grid values they reach, so the grid meets a
    table as large as the product of the grid's axes, however many rows there are.
    With ``by`` each of its values has its own evaluation; ``weight`` counts a row so many times.
    """
    axes = {x: sorted(r[0] for r in grid.select(g).distinct().collect()) for x, g in thresholds.items()}  # the grid is a parameter
    reached = {x: sum((F.when(F.col(x) >= float(v), 1).otherwise(0) for v in values), F.lit(0)) for x, values in axes.items()}
    passed = {x: sum((F.when(F.col(x) > float(v), 1).otherwise(0) for v in axes[x]), F.lit(0)) for x in strict}
    flags = [c for c in df.columns if c not in thresholds and c not in (truth, yes, no, by, weight)]
    each, n = [by] if by else [], F.col(weight) if weight else F.lit(1)
    cells = df.groupBy(*(r.alias(f"at_{x}") for x, r in reached.items()), *(r.alias(f"past_{x}") for x, r in passed.items()), *flags, *each, F.col(truth).alias("truth")).agg(F.sum(n).alias("n"), F.sum(n * F.col(yes)).alias("yes"), F.sum(n * F.col(no)).alias("no"))
    # Parameters times cells of parameters; with ``by`` the cells are the larger side.
    met = cells.where("n > 0").repartition(by).crossJoin(F.broadcast(grid)) if by else grid.crossJoin(F.broadcast(cells))
    for x, g in thresholds.items():
        place = F.array_position(F.array(*(F.lit(float(v)) for v in axes[x])), F.col(g).cast("double"))
        met = met.withColumn(f"ge_{x}", F.col(f"at_{x}") >= place)
        met = met.withColumn(f"gt_{x}", F.col(f"past_{x}") >= place) if x in passed else met
    chosen = met.withColumn("use", decide)
    return chosen.groupBy(*each, *grid.columns).agg(
        F.round(F.sum(F.when(F.col("use") == F.col("truth"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("agreement"),
        F.round(F.sum(F.when(F.col("use"), F.col("yes")).otherwise(F.col("no"))) / F.sum("n"), 9).alias("earned"),
    )


def two_feature_rule(df: DataFrame, a: str, b: str, gain: str, low: float = 0.05, high: float = 0.95, least: int = 30) -> DataFrame:
    """(form, a, b, gain, rate), at most one row: the rule that earns most of those that admit neither nearly none nor nearly all.

    Forms are ``first`` (value of ``a`` at least the threshold), ``second`` and ``both``; thresholds are the nine
    percentiles from 10 to 90 of each feature. A missing value admits nothing; under ``least`` rows there is no rule.
    Equal gains go to the rate nearest one half. Rows are counted by the thresholds they reach.
    """
    usable = {x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")) for x in (a, b)}
    s = df.select(usable[a].alias("a"), usable[b].alias("b"), F.col(gain).alias("gain"))
    shares = F.array(*(F.lit(k / 10) for k in range(1, 10)))
    grids = s.agg(*(F.array_sort(F.array_distinct(F.percentile(x, shares))).alias(x) for x in ("a", "b"))).head()  # at most 9 values each
    grid = {x: grids[x] or [] for x in ("a", "b")}
    reached = {x: sum((F.when(F.col(x) >= v, 1).otherwise(0) for v in grid[x]), F.lit(0)) for x in grid}
    cells = s.groupBy(reached["a"].alias("ra"), reached["b"].alias("rb")).agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("v"))
    rules = [("first", v, None, i, 0) for i, v in enumerate(grid["a"], 1)] + [("second", None, v, 0, i) for i, v in enumerate(grid["b"], 1)]
    rules += [("both", v, w, i, j) for i, v in enumerate(grid["a"], 1) for j, w in enumerate(grid["b"], 1)]
    told = df.sparkSession.createDataFrame(rules, "form string, a double, b double, ia int, ib int")
    ok = (F.col("ra") >= F.col("ia")) & (F.col("rb") >= F.col("ib"))
    of = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0)) / F.sum("n")
    r = told.crossJoin(F.broadcast(cells)).groupBy("form", "a", "b").agg(of("v").alias("gain"), of("n").alias("rate"), F.sum("n").alias("n"))
    kept = r.where((F.col("n") >= least) & F.col("rate").between(low, high))
    return kept.orderBy(F.desc(F.round("gain", 9)), F.round(F.abs(F.col("rate") - 0.5), 9), "form", "a", "b").limit(1).drop("n")
