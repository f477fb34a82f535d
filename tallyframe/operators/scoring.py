"""Proper scores, reliability and error metrics of predicted category mixes and values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import profile


def melt_models(df: DataFrame, keep: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per model and input row, the models' probability columns becoming ``probability``."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("probability")) for m in models])
    return df.select(*keep, F.inline(cells))


def environment_scores(long: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Log loss and Brier score of each key and model from its category counts.

    ``long``: keys, model, probability, observed count, all categories present.
    """
    n, p = F.col(count), F.col("probability")
    sums = long.groupBy(*keys, "model").agg(
        F.sum(n).alias("event_count"),
        F.sum(-n * F.log(p)).alias("_ll"),
        F.sum(n * p).alias("_np"),
        F.sum(p * p).alias("_pp"),
        F.sum(p).alias("probability_sum"),
    )
    total = F.col("event_count")
    return (
        sums.where("event_count > 0")
        .withColumn("log_loss", F.col("_ll") / total)
        .withColumn("brier", 1 - 2 * F.col("_np") / total + F.col("_pp"))
        .drop("_ll", "_np", "_pp")
    )


def stratified_metrics(scores: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Event-weighted and plain means per model: overall, and by every stratum, in one aggregate.

    ``stratum_type`` names the stratum column and ``stratum`` its value.
    """
    sets = [["model"]] + [["model", s] for s in strata]
    grouped = scores.groupingSets([[F.col(c) for c in s] for s in sets], "model", *strata).agg(
        F.sum("event_count").alias("event_count"),
        F.count("*").alias("row_count"),
        profile.weighted_mean(F.col("log_loss"), F.col("event_count")).alias("weighted_log_loss"),
        profile.weighted_mean(F.col("brier"), F.col("event_count")).alias("weighted_brier"),
        F.avg("log_loss").alias("mean_log_loss"),
        F.avg("brier").alias("mean_brier"),
        *[F.grouping(s).alias(f"_g_{s}") for s in strata],
    )
    kind, value = F.lit("overall"), F.lit("all")
    for s in strata:
        here = F.col(f"_g_{s}") == 0
        kind = F.when(here, F.lit(s)).otherwise(kind)
        value = F.when(here, F.col(s).cast("string")).otherwise(value)
    return grouped.withColumn("stratum_type", kind).withColumn("stratum", value).drop(*strata, *[f"_g_{s}" for s in strata])


def reliability(long: DataFrame, groups: Sequence[str], count: str, trials: str, bins: int = 10) -> DataFrame:
    """Observed and predicted rates per probability bin; the last bin includes probability one."""
    place = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("bigint")
    cells = long.where(F.col(trials) > 0).groupBy(*groups, place.alias("calibration_bin")).agg(
        F.sum(trials).alias("event_count"),
        F.sum(count).alias("observed_count"),
        F.sum(F.col("probability") * F.col(trials)).alias("_mass"),
    )
    return (
        cells.withColumn("mean_predicted", F.col("_mass") / F.col("event_count"))
        .withColumn("observed_rate", F.col("observed_count") / F.col("event_count"))
        .withColumn("absolute_error", F.abs(F.col("observed_rate") - F.col("mean_predicted")))
        .drop("_mass")
    )


def calibration_error(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Event-weighted mean and largest bin error per group."""
    return cells.groupBy(*groups).agg(
        F.sum("event_count").alias("event_count"),
        profile.weighted_mean(F.col("absolute_error"), F.col("event_count")).alias("expected_calibration_error"),
        F.max("absolute_error").alias("max_bin_error"),
        F.count("*").alias("occupied_bins"),
    )


def component_scores(long: DataFrame, category: str, count: str, trials: str, total_events: Column) -> DataFrame:
    """Each category's part of a model's log loss, and its own yes/no Brier score."""
    n, m, p = F.col(count), F.col(trials), F.col("probability")
    return (
        long.groupBy("model", category)
        .agg(
            F.sum(m).alias("event_count"),
            F.sum(n).alias("observed_count"),
            F.sum(p * m).alias("_mass"),
            F.sum(-n * F.log(p)).alias("_ll"),
            F.sum(n * (1 - p) * (1 - p) + (m - n) * p * p).alias("_b"),
        )
        .withColumn("log_loss_part", F.col("_ll") / total_events)
        .withColumn("binary_brier_part", F.col("_b") / total_events)
        .withColumn("observed_rate", F.col("observed_count") / F.col("event_count"))
        .withColumn("mean_predicted", F.col("_mass") / F.col("event_count"))
        .drop("_mass", "_ll", "_b")
    )


def paired_errors(df: DataFrame, groups: Sequence[str], truth: str, first: str, second: str) -> DataFrame:
    """MSE and MAE of two predictions of one value, with second minus first."""
    a, b = F.col(truth) - F.col(first), F.col(truth) - F.col(second)
    sums = df.groupBy(*groups).agg(
        F.count("*").alias("event_count"),
        F.avg(a * a).alias(f"{first}_mse"),
        F.avg(b * b).alias(f"{second}_mse"),
        F.avg(F.abs(a)).alias(f"{first}_mae"),
        F.avg(F.abs(b)).alias(f"{second}_mae"),
    )
    return sums.withColumn("mse_delta", F.col(f"{second}_mse") - F.col(f"{first}_mse")).withColumn(
        "mae_delta", F.col(f"{second}_mae") - F.col(f"{first}_mae")
    )


def value_calibration(df: DataFrame, groups: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """Line of the truth on its prediction; ideal intercept 0 and slope 1."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("event_count"),
        F.regr_intercept(F.col(truth), F.col(prediction)).alias("intercept"),
        F.regr_slope(F.col(truth), F.col(prediction)).alias("slope"),
    )


def paired_scores(df: DataFrame, groups: Sequence[str], losses: Mapping[str, tuple[Column, Column]], exposure: Column, name: str) -> DataFrame:
    """``exposure_scores`` of several candidates of the same rows, one output row per group and candidate.

    ``losses`` maps a candidate to its loss and secondary score. All are summed side by side in one order of the rows,
    so candidates with equal losses have equal scores to the last bit and neither beats the other.
    """
    sums = [part for i, (loss, secondary) in enumerate(losses.values()) for part in (F.sum(loss).alias(f"_loss_{i}"), F.sum(secondary).alias(f"_secondary_{i}"))]
    totals = df.where(exposure > 0).groupBy(*groups).agg(*sums, F.sum(exposure).alias("_exposure"), F.count("*").alias("_rows"))
    cells = [
        F.struct(
            F.lit(candidate).alias(name),
            (F.col(f"_loss_{i}") / F.col("_exposure")).alias("score"),
            F.col("_exposure").alias("exposure"),
            F.col("_rows").alias("observation_count"),
            (F.col(f"_secondary_{i}") / F.col("_exposure")).alias("secondary_score"),
        )
        for i, candidate in enumerate(losses)
    ]
    return totals.select(*groups, F.inline(F.array(*cells)))


def exposure_scores(df: DataFrame, groups: Sequence[str], loss: Column, secondary: Column, exposure: Column) -> DataFrame:
    """Loss per unit of exposure, with a secondary score, for each group."""
    return df.where(exposure > 0).groupBy(*groups).agg(
        (F.sum(loss) / F.sum(exposure)).alias("score"),
        F.sum(exposure).alias("exposure"),
        F.count("*").alias("observation_count"),
        (F.sum(secondary) / F.sum(exposure)).alias("secondary_score"),
    )
