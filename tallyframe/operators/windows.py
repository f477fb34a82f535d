"""Ordered operators: caps, stints, pairs, latest context, samples, folds and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import scan


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key; Spark prunes to ``limit`` rows before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("row_index", position).where(F.col("row_index") <= limit)


def whole_rows_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_by: Column, amount: str, cap: float
) -> DataFrame:
    """Keep whole rows while the key's running amount stays within ``cap``.

    The running amount never falls, so the first overflow ends the key's evidence.
    """
    total = scan.running(df, keys, order, slice_by, {"running_amount": ("sum", F.col(amount))})
    return total.where(F.col("running_amount") <= cap)


def last_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "is_last") -> DataFrame:
    """Mark the final row of each key under a total order."""
    return scan.ordered(df, keys, order, slice_by, last=name)


def date_environments(df: DataFrame, entity: str, day: str, environment: str, **totals: Column) -> DataFrame:
    """One row per entity and date, marked ambiguous when it saw more than one environment."""
    return (
        df.groupBy(entity, day)
        .agg(F.min(environment).alias("_lo"), F.max(environment).alias("_hi"), *[e.alias(n) for n, e in totals.items()])
        .withColumn("ambiguous_environment", F.col("_lo") != F.col("_hi"))
        .withColumn(environment, F.when(~F.col("ambiguous_environment"), F.col("_lo")))
        .drop("_lo", "_hi")
    )


def stint_index(daily: DataFrame, entity: str, day: str, environment: str) -> DataFrame:
    """Number the runs of consecutive dates in one environment.

    Input is one row per entity and date, so a window over an entity is bounded by the calendar.
    An ambiguous date starts a new continuity segment and belongs to no stint; the stint number
    goes on counting across segments.
    """
    order = Window.partitionBy(entity).orderBy(day)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.col("ambiguous_environment")
    before = F.lag(F.col(environment)).over(order)
    starts = ~broken & ~F.coalesce(before == F.col(environment), F.lit(False))
    return (
        daily.withColumn("continuity_segment", F.sum(broken.cast("bigint")).over(upto))
        .withColumn("stint_index", F.sum(starts.cast("bigint")).over(upto))
        .where(~broken)
    )


def stint_summary(stints: DataFrame, entity: str, day: str, environment: str, amount: str) -> DataFrame:
    return stints.groupBy(entity, "continuity_segment", "stint_index", environment).agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.count("*").alias("date_count"),
        F.sum(amount).alias(amount),
    )


def stint_pairs(
    stints: DataFrame, entity: str, environment: str, amount: str, ordinal: Column, minimum: float, max_gap: int
) -> DataFrame:
    """Each stint with the one before it in the same segment, and whether the pair is usable.

    Eligibility is judged after pairing: dropping a thin stint first would join stints that were
    not neighbours. ``ordinal`` ranks environments to name promotions and demotions.
    """
    order = Window.partitionBy(entity, "continuity_segment").orderBy("stint_index")
    here = stints.withColumn("_ordinal", ordinal)
    fields = ["stint_index", environment, "first_date", "last_date", amount, "_ordinal"]
    paired = here.withColumn("_from", F.lag(F.struct(*fields)).over(order)).where("_from is not null")
    left, right = F.col(f"_from.{amount}"), F.col(amount)
    gap = F.datediff(F.col("first_date"), F.col("_from.last_date"))
    reasons = F.array_compact(
        F.array(
            F.when(left < minimum, F.lit("LOW_FROM_EVENTS")),
            F.when(right < minimum, F.lit("LOW_TO_EVENTS")),
            F.when(gap > max_gap, F.lit("GAP_EXCEEDS_MAX")),
        )
    )
    move = (
        F.when(F.col("_ordinal") > F.col("_from._ordinal"), F.lit("PROMOTION"))
        .when(F.col("_ordinal") < F.col("_from._ordinal"), F.lit("DEMOTION"))
        .otherwise(F.lit("SAME_LEVEL"))
    )
    return paired.select(
        entity,
        "continuity_segment",
        F.col("_from.stint_index").alias("from_stint_index"),
        F.col("stint_index").alias("to_stint_index"),
        F.col(f"_from.{environment}").alias("from_environment"),
        F.col(environment).alias("to_environment"),
        left.alias("from_events"),
        right.alias("to_events"),
        gap.cast("bigint").alias("gap_days"),
        move.alias("transition"),
        F.when(left + right > 0, left * right / (left + right)).otherwise(0.0).alias("pair_weight"),
        (F.size(reasons) == 0).alias("eligible"),
        F.concat_ws(";", reasons).alias("exclusion_reason"),
    )


def latest_context(df: DataFrame, entity: str, day: str, environment: str, cutoff: Column) -> DataFrame:
    """Environment on each entity's last date before the cutoff; ambiguous if it saw several."""
    past = df.where(F.col(day) < cutoff)
    daily = past.groupBy(entity, day).agg(F.min(environment).alias("_lo"), F.max(environment).alias("_hi"))
    last = daily.groupBy(entity).agg(F.max_by(F.struct(F.col(day).alias("d"), "_lo", "_hi"), F.col(day)).alias("_c"))
    same = F.col("_c._lo") == F.col("_c._hi")
    return last.select(
        entity,
        F.col("_c.d").alias("last_date"),
        (~same).alias("environment_ambiguous"),
        F.when(same, F.col("_c._lo")).alias("environment"),
    )


def spread_sample(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], slice_by: Column, size: int, single: str = "first"
) -> DataFrame:
    """Rows at positions round(i*(n-1)/(size-1)), half to even, in each group's order.

    A group of at most ``size`` rows is kept whole; a sample of one takes the ``single`` row, which is
    "first" or "middle" (position n/2, rounded down).
    """
    if single not in ("first", "middle"):
        raise ValueError(f"unknown choice of a single row: {single}")
    indexed = scan.row_index(df, groups, order, slice_by)
    sized = scan.group_totals(indexed, groups, _n=F.count("*"))
    if size == 1:
        picks = F.array(F.floor(F.col("_n") / 2) if single == "middle" else F.lit(0).cast("bigint"))
    else:
        picks = F.array(*[F.bround(F.lit(i) * (F.col("_n") - 1) / F.lit(size - 1), 0).cast("bigint") for i in range(size)])
    wanted = F.array_contains(picks, (F.col("row_index") - 1).cast("bigint")) | (F.col("_n") <= size)
    return sized.where(wanted).drop("_n")


def round_robin_fold(df: DataFrame, order: Sequence[str], slice_by: Column, folds: int) -> DataFrame:
    """Fold = position in the overall order, modulo the number of folds."""
    return scan.row_index(df, [], order, slice_by).withColumn("fold", (F.col("row_index") - 1) % folds)
