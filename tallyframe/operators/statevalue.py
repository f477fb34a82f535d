"""Value of ordered transitions between states of a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import ratio
from tallyframe.operators import profile, scan

START = "START"


def transitions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, state: str, value: str, complete: Column
) -> DataFrame:
    """Put each event between the state before it and the state it leads to.

    Adds ``start_state`` (the previous event's state, or START), ``end_state``, ``value_before``
    (the partition's value so far), ``partition_value``, ``partition_complete`` (``complete``
    evaluated on the last row's state, available as column ``final_state``) and ``is_terminal``.
    """
    placed = scan.ordered(
        df,
        keys,
        order,
        slice_by,
        before={"value_before": ("sum", F.col(value))},
        whole={"partition_value": ("sum", F.col(value))},
        prior={"_prior": F.col(state)},
        final={"final_state": F.col(state)},
        last="is_terminal",
    )
    return (
        placed.withColumn("start_state", F.coalesce("_prior", F.lit(START)))
        .withColumn("end_state", F.col(state))
        .withColumn("partition_complete", complete)
        .drop("_prior")
    )


def quality_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, start: str, end: str) -> DataFrame:
    """Flag rows whose declared start state is not the state the previous row ended in."""
    placed = scan.ordered(df, keys, order, slice_by, prior={"_prior_end": F.col(end)})
    broken = F.col("_prior_end").isNotNull() & ~F.col("_prior_end").eqNullSafe(F.col(start))
    return placed.withColumn("state_break", broken).drop("_prior_end")


def expectancy(moves: DataFrame, groups: Sequence[str], partition: Sequence[str]) -> DataFrame:
    """Mean value still to come at each start state, over completed partitions only."""
    done = moves.where("partition_complete").withColumn("_rest", F.col("partition_value") - F.col("value_before"))
    # The partition count per state comes from a nested aggregate, so nothing is expanded for a distinct.
    per_partition = done.groupBy(*groups, "start_state", *partition).agg(F.count("*").alias("_n"), F.sum("_rest").alias("_s"))
    return per_partition.groupBy(*groups, "start_state").agg(
        (F.sum("_s") / F.sum("_n")).alias("expectancy"),
        F.sum("_n").alias("state_sample_size"),
        F.count("*").alias("state_partition_count"),
    )


def contextual_value(moves: DataFrame, states: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``value + E[after] - E[before]``; the last row of a partition has nothing after it.

    A state without an expectancy gives null and ``value_available`` false.
    """
    before = states.select(*groups, "start_state", F.col("expectancy").alias("expectancy_before"))
    after = states.select(*groups, F.col("start_state").alias("end_state"), F.col("expectancy").alias("_after"))
    joined = moves.join(before, [*groups, "start_state"], "left").join(after, [*groups, "end_state"], "left")
    rest = F.when(F.col("is_terminal"), F.lit(0.0)).otherwise(F.col("_after"))
    return (
        joined.withColumn("expectancy_after", rest)
        .drop("_after")
        .withColumn("context_value", F.col(value) + F.col("expectancy_after") - F.col("expectancy_before"))
        .withColumn("value_available", F.col("context_value").isNotNull())
    )


def missing_states(states: DataFrame, expected: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Expected states that no completed partition visited."""
    return expected.join(states, [*groups, "start_state"], "left_anti")


def category_value(valued: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Direct value of each category: occurrences, mean, deviation and error of the context value."""
    return profile.cell_stats(valued.where("value_available"), cells, "context_value")


def shrink(mean: Column, count: Column, prior: Column, strength: Column | float) -> Column:
    """Mean pulled toward a prior worth ``strength`` observations."""
    return (mean * count + prior * strength) / (count + strength)


def pooled_values(
    direct: DataFrame, environment: Sequence[str], pool: Sequence[str], category: str, strength: Column
) -> DataFrame:
    """Shrink each environment's category mean toward the same category in its pool's other environments.

    ``strength`` is the policy's prior-equivalent count, 0 for "keep direct" and null for an
    environment without a policy. A pooled policy without peers keeps the direct mean, uncertified.
    ``direct`` is a reduced table with one row per environment and category, so the window over a
    pool covers its environments only.
    """
    pooled = Window.partitionBy(*pool, category)
    weighted = F.col("mean_value") * F.col("occurrence_count")
    joined = (
        direct.withColumn("_strength", strength)
        .withColumn("_weighted", weighted)
        .withColumn("_n", F.sum("occurrence_count").over(pooled))
        .withColumn("_s", F.sum("_weighted").over(pooled))
        .withColumn("_k", F.count("*").over(pooled))
    )
    peers = F.col("_n") - F.col("occurrence_count")
    pooling = F.coalesce(F.col("_strength") > 0, F.lit(False))
    usable = pooling & (peers > 0)
    prior = F.when(usable, (F.col("_s") - F.col("_weighted")) / peers)
    method = (
        F.when(usable, "pooled_with_peers")
        .when(pooling, "direct_missing_peers")
        .when(F.col("_strength") == 0, "direct_by_policy")
        .otherwise("direct_without_policy")
    )
    estimate = F.when(usable, shrink(F.col("mean_value"), F.col("occurrence_count"), F.col("prior_mean"), F.col("_strength"))).otherwise(F.col("mean_value"))
    return (
        joined.withColumn("prior_mean", prior)
        .withColumn("prior_occurrence_count", F.when(usable, peers).otherwise(0).cast("bigint"))
        .withColumn("prior_environment_count", F.when(usable, F.col("_k") - 1).otherwise(0).cast("bigint"))
        .withColumn("estimated_mean", estimate)
        .withColumn("estimator_method", method)
        .withColumn("estimator_certified", method.isin("pooled_with_peers", "direct_by_policy"))
        .select(
            *environment,
            *[p for p in pool if p not in environment],
            category,
            F.col("occurrence_count"),
            F.col("mean_value"),
            "prior_mean",
            "prior_occurrence_count",
            "prior_environment_count",
            "estimated_mean",
            "estimator_method",
            "estimator_certified",
        )
    )


def pooling_strengths(
    halves: DataFrame, environment: Sequence[str], pool: Sequence[str], category: str, strengths: Sequence[int], tolerance: float
) -> DataFrame:
    """Error of each pooling strength against a held-out half, by pool group.

    ``halves`` has one row per environment and category: occurrence_count and mean_value of the candidate half and
    reference_mean of the held-out one; rows without both are left out. Priors use other environments' candidate halves
    only. The table is reduced, so the window over a pool and category covers its environments only.
    """
    rows = halves.where("mean_value is not null and reference_mean is not null").withColumn("_weighted", F.col("mean_value") * F.col("occurrence_count"))
    pools = Window.partitionBy(*pool, category)
    peers = F.sum("occurrence_count").over(pools) - F.col("occurrence_count")
    joined = rows.withColumn("_prior", ratio(F.sum("_weighted").over(pools) - F.col("_weighted"), peers))
    joined = joined.withColumn("prior_strength", F.explode(F.array(*[F.lit(s).cast("bigint") for s in strengths])))
    direct = F.col("mean_value")
    prediction = F.when(
        (F.col("prior_strength") > 0) & F.col("_prior").isNotNull(), shrink(direct, F.col("occurrence_count"), F.col("_prior"), F.col("prior_strength"))
    ).otherwise(direct)
    error = F.abs(F.col("_error"))
    report = joined.withColumn("_error", prediction - F.col("reference_mean")).groupBy(*pool, "prior_strength").agg(
        F.count("*").alias("cell_count"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(F.col("_error") * F.col("_error"))).alias("rmse"),
        (F.sum(error * F.col("occurrence_count")) / F.sum("occurrence_count")).alias("weighted_mae"),
        F.max(error).alias("max_error"),
        F.count_if(error <= tolerance).alias("within_tolerance_count"),
    )
    # One row per strength and pool group.
    best = F.min(F.struct(F.round("mae", 12).alias("mae"), "prior_strength")).over(Window.partitionBy(*pool))
    return report.withColumn("is_best", F.col("prior_strength") == best["prior_strength"])
