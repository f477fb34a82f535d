"""Ranking candidates over folds, tolerance tiers and pass/fail gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import scan

# The share of exposure that makes a tier count, the score ratio that disqualifies,
# the slack a fold may lose, and the decimals at which scores tie.
MEANINGFUL_SHARE = 0.05
CATASTROPHIC_RATIO = 1.10
FOLD_SLACK = 1.02
TIE_DECIMALS = 8


def equal_fold_summary(folds: DataFrame, candidate: str, metrics: Sequence[str], baseline: Mapping[str, str]) -> DataFrame:
    """Plain mean, best and worst fold of each metric, and how many folds beat the baseline."""
    columns = [F.count("*").alias("fold_count")]
    for m in metrics:
        columns += [F.avg(m).alias(f"mean_{m}"), F.min(m).alias(f"best_{m}"), F.max(m).alias(f"worst_{m}")]
    for m, b in baseline.items():
        columns.append(F.count_if(F.col(m) < F.col(b)).alias(f"{m}_win_count"))
    return folds.groupBy(candidate).agg(*columns)


def pareto_frontier(df: DataFrame, first: str, second: str, name: str = "on_frontier") -> DataFrame:
    """Mark rows that no other row matches or beats on both metrics and beats on one (lower is better).

    Only the smallest second metric of each distinct first metric can be on the frontier, and it is
    when nothing with a smaller first metric reaches it. That is one aggregate and one running
    minimum instead of comparing every pair.
    """
    best = df.groupBy(first).agg(F.min(second).alias("_best"))
    placed = scan.range_slices(best, [first])
    earlier = scan.ordered(placed, [], [first], scan.SLICE, before={"_earlier": ("min", F.col("_best"))})
    marked = df.join(earlier, first)
    clear = F.col("_earlier").isNull() | (F.col(second) < F.col("_earlier"))
    return marked.withColumn(name, (F.col(second) == F.col("_best")) & clear).drop("_best", "_earlier")


def rank_candidates(df: DataFrame, primary: str, simplicity: Sequence[Column], metrics: Sequence[str]) -> DataFrame:
    """Min-rank of each metric and the selection order: best primary metric, then simplicity.

    Ranks come from ordered scans, so a grid of any size is ranked in slices. A min-rank is one more
    than the number of rows with smaller values, counted once per distinct value.
    """
    result = df
    for m in metrics:
        counts = df.groupBy(m).agg(F.count("*").alias("_n"))
        smaller = scan.ordered(scan.range_slices(counts, [m]), [], [m], scan.SLICE, before={"_smaller": ("sum", F.col("_n"))})
        ranks = smaller.select(F.col(m).alias("_m"), (F.col("_smaller") + 1).cast("bigint").alias(f"{m}_rank"))
        result = result.join(ranks, F.col(m).eqNullSafe(F.col("_m"))).drop("_m")
    ranked = scan.ordered_rank(result, [F.asc(primary), *simplicity], "selection_order")
    return ranked.withColumn("selection_order", F.col("selection_order").cast("bigint"))


def tiered_choice(df: DataFrame, tiers: Sequence[tuple[str, float]], simplicity: Sequence[Column]) -> DataFrame:
    """Keep rows within tolerance of the best on each metric in turn; the simplest survivor wins."""
    kept = df
    for metric, tolerance in tiers:
        kept = kept.where(F.col(metric) <= kept.agg(F.min(metric).alias("best")).select("best").scalar() + tolerance)
    return kept.orderBy(*simplicity).limit(1)


def catastrophic_reversals(cells: DataFrame, candidate: str, baseline: str, fold: str, tier: str) -> DataFrame:
    """Fold and tier cells with meaningful exposure where a candidate is far worse than the baseline.

    ``cells``: candidate, fold, tier, score, exposure.
    """
    base = cells.where(F.col(candidate) == baseline).select(fold, tier, F.col("score").alias("_b"), F.col("exposure").alias("_e"))
    whole = base.groupBy(fold).agg(F.sum("_e").alias("_all"))
    joined = cells.where(F.col(candidate) != baseline).join(base.drop("_e"), [fold, tier]).join(whole, fold)
    counted = F.col("exposure") >= MEANINGFUL_SHARE * F.col("_all")
    bad = (F.col("_b") > 0) & (F.col("score") >= CATASTROPHIC_RATIO * F.col("_b"))
    return joined.where(counted & bad).select(candidate, fold, tier, "score", F.col("_b").alias("baseline_score"))


def gated_winner(summary: DataFrame, reversals: DataFrame, candidate: str, baseline: str, score: str, simplicity: Sequence[Column]) -> DataFrame:
    """The best candidate without reversals if it beats the baseline, else the baseline."""
    own = summary.where(F.col(candidate) != baseline).join(reversals.select(candidate).distinct(), candidate, "left_anti")
    best = own.orderBy(F.round(score, TIE_DECIMALS), *simplicity).limit(1)
    floor = summary.where(F.col(candidate) == baseline).select(score).scalar()
    return best.select(
        F.col(candidate).alias("challenger"),
        F.col(score).alias("challenger_score"),
        floor.alias("baseline_score"),
        F.when(F.col(score) < floor, F.col(candidate)).otherwise(F.lit(baseline)).alias("selected"),
    )


def fold_guards(errors: DataFrame, fold: Sequence[str], form: str, baseline: str) -> DataFrame:
    """Per form: whether every fold stays within the slack and both mean errors drop.

    ``errors``: fold columns, form, mae, rmse, continuing_mae.
    """
    base = errors.where(F.col(form) == baseline).select(
        *fold, F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"), F.col("continuing_mae").alias("_cont")
    )
    joined = errors.where(F.col(form) != baseline).join(base, list(fold))
    continuing = F.col("_cont").isNull() | (F.col("continuing_mae") <= FOLD_SLACK * F.col("_cont"))
    checks = joined.groupBy(form).agg(
        F.bool_and(F.col("mae") <= FOLD_SLACK * F.col("_mae")).alias("fold_mae_guard"),
        F.bool_and(continuing).alias("continuing_mae_guard"),
        (F.avg("mae") < F.avg("_mae")).alias("mean_mae_lower"),
        (F.avg("rmse") < F.avg("_rmse")).alias("mean_rmse_lower"),
        F.avg("mae").alias("mean_mae"),
    )
    gates = ["fold_mae_guard", "continuing_mae_guard", "mean_mae_lower", "mean_rmse_lower"]
    passed = F.col(gates[0])
    for g in gates[1:]:
        passed = passed & F.col(g)
    return checks.withColumn("passes", passed)


def all_gates(df: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """Add each named gate and whether all of them hold; an unknown gate fails."""
    known = {n: F.coalesce(g, F.lit(False)) for n, g in gates.items()}
    result = df.withColumns(known)
    together = F.lit(True)
    for n in known:
        together = together & F.col(n)
    return result.withColumn("all_gates_pass", together)
