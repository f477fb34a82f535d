"""Cutoff logic: what was known before a date, what came after, and how old evidence weighs less."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import ratio
from tallyframe.operators import lookup


class EvidenceWindow(NamedTuple):
    """Evidence before a cutoff: the age in days that still counts, and the share that a day of age leaves."""

    oldest: float
    kept_per_day: float

    def holds(self, day: Column, cutoff: Column) -> Column:
        """Strictly before the cutoff, and no older than the oldest age when there is one."""
        # Comparisons of the day itself can be pushed into the scan; an age computed from it cannot.
        before = day < cutoff
        return before if math.isinf(self.oldest) else before & (day >= F.date_sub(cutoff, int(self.oldest)))

    def weight(self, day: Column, cutoff: Column) -> Column:
        return F.pow(F.lit(self.kept_per_day), F.datediff(cutoff, day))


def evidence_window(lookback_days: float = math.inf, half_life_days: float = math.inf) -> EvidenceWindow:
    """All evidence at full weight unless a lookback or a half-life, both positive, narrows it."""
    if min(lookback_days, half_life_days) <= 0:
        raise ValueError("lookback and half-life are positive numbers of days")
    return EvidenceWindow(lookback_days, 0.5 ** (1 / half_life_days))


def as_date(text: str) -> Column:
    return F.lit(text).cast("date")


def membership(day: Column, cutoff: Column, horizon_days: int) -> tuple[Column, Column, Column]:
    """(predictor, target, outside): before the cutoff, within the horizon from it, neither."""
    end = F.date_add(cutoff, horizon_days)
    predictor, target = day < cutoff, (day >= cutoff) & (day < end)
    return predictor, target, ~(predictor | target)


def month_starts(first: Column, last: Column) -> Column:
    """Array of month-start cutoffs from the month of ``first`` to ``last``."""
    return F.sequence(F.trunc(first, "month"), last, F.expr("interval 1 month"))


def event_cutoff(observations: DataFrame, games: DataFrame, game: str, day: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(observations of games on or before the cutoff, observations of games without a date)."""
    dated = observations.join(games.select(game, F.col(day).alias("_day")), game, "left")
    return dated.where(F.col("_day") <= cutoff).drop("_day"), dated.where("_day is null").drop("_day")


def vintage(
    observations: DataFrame, games: DataFrame, snapshots: DataFrame, game: str, day: str, snapshot: str, known: str, cutoff: Column
) -> DataFrame:
    """Observations of past games that were also already known at the cutoff.

    A snapshot without a knowledge time is never eligible.
    """
    past, _undated = event_cutoff(observations, games, game, day, cutoff)
    available = snapshots.where(F.col(known) <= cutoff).select(snapshot)
    return past.join(available, snapshot, "left_semi")


def recency_snapshot(
    daily: DataFrame, entity: str, day: str, environment: str, counts: Sequence[str], cutoff: Column, window: EvidenceWindow
) -> DataFrame:
    """Raw and recency-weighted totals per entity with spans and distinct counts.

    ``daily`` has one row per entity, day and environment, so the distinct day and environment
    counts are taken over calendar-bounded data.
    """
    past = daily.where(window.holds(F.col(day), cutoff)).withColumn("_w", window.weight(F.col(day), cutoff))
    per_day = past.groupBy(entity, day).agg(
        *[F.sum(c).alias(f"raw_{c}") for c in counts], *[F.sum(F.col(c) * F.col("_w")).alias(f"effective_{c}") for c in counts]
    )
    spans = per_day.groupBy(entity).agg(
        *[F.sum(f"raw_{c}").alias(f"raw_{c}") for c in counts],
        *[F.sum(f"effective_{c}").alias(f"effective_{c}") for c in counts],
        F.count("*").alias("day_count"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )
    environments = past.groupBy(entity, environment).agg(F.lit(1).alias("_one")).groupBy(entity).agg(F.count("*").alias("environment_count"))
    return spans.join(environments, entity)


def recency_profile(
    daily: DataFrame, keys: Sequence[str], day: str, category: str, count: str, cutoff: Column, window: EvidenceWindow
) -> DataFrame:
    """Raw and weighted category counts per key with their shares of the key's totals."""
    past = daily.where(window.holds(F.col(day), cutoff)).withColumn("_w", window.weight(F.col(day), cutoff))
    cells = past.groupBy(*keys, category).agg(
        F.sum(count).alias("raw_count"), F.sum(F.col(count) * F.col("_w")).alias("effective_count")
    )
    totals = cells.groupBy(*keys).agg(F.sum("raw_count").alias("raw_total"), F.sum("effective_count").alias("effective_total"))
    joined = cells.join(totals, list(keys))
    return joined.withColumn("raw_rate", ratio(F.col("raw_count"), F.col("raw_total"))).withColumn(
        "effective_rate", ratio(F.col("effective_count"), F.col("effective_total"))
    )


def fold_profiles(
    daily: DataFrame, keys: Sequence[str], day: str, category: str, count: str, cutoffs: Sequence[str], window: EvidenceWindow
) -> DataFrame:
    """Weighted profiles at many cutoffs in one job.

    ``daily`` is already reduced to entity x day x category; each of its rows is repeated once per
    cutoff it lies before, so the multiplied data is bounded by the calendar, not by the events.
    """
    folds = F.array(*[as_date(c) for c in cutoffs])
    after = F.filter(folds, lambda c: window.holds(F.col(day), c))
    exploded = daily.withColumn("cutoff", F.explode(after))
    weighted = exploded.withColumn("_w", window.weight(F.col(day), F.col("cutoff")))
    return weighted.groupBy("cutoff", *keys, category).agg(
        F.sum(count).alias("raw_count"), F.sum(F.col(count) * F.col("_w")).alias("effective_count")
    )


def future_target(
    daily: DataFrame, keys: Sequence[str], day: str, counts: Sequence[str], cutoff: Column, horizon_days: int
) -> DataFrame:
    """Totals in [cutoff, cutoff + horizon) by realised environment, with the first day's distance."""
    _past, target, _outside = membership(F.col(day), cutoff, horizon_days)
    return daily.where(target).groupBy(*keys).agg(
        *[F.sum(c).alias(f"future_{c}") for c in counts],
        F.min(F.datediff(F.col(day), cutoff)).cast("bigint").alias("first_days_after"),
        F.count_distinct(day).alias("future_day_count"),
    )


def transition_label(ambiguous: Column, was: Column, becomes: Column) -> Column:
    """Name the move from the as-of environment rank to the realised one."""
    return (
        F.when(ambiguous | was.isNull(), "AMBIGUOUS_AS_OF")
        .when(becomes > was, "PROMOTION")
        .when(becomes < was, "DEMOTION")
        .otherwise("SAME_LEVEL")
    )


def tracked_features(
    df: DataFrame, entity: str, day: str, means: Mapping[str, Column], cutoff: Column, window: EvidenceWindow, minimum: int
) -> DataFrame:
    """Recency-weighted means of tracked measures per entity, eligible from ``minimum`` rows on."""
    past = df.where(window.holds(F.col(day), cutoff)).withColumn("_w", window.weight(F.col(day), cutoff))
    grouped = past.groupBy(entity).agg(
        F.count("*").alias("raw_count"),
        F.sum("_w").alias("effective_count"),
        *[(F.sum(e * F.col("_w")) / F.sum("_w")).alias(n) for n, e in means.items()],
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )
    return grouped.withColumn("eligible", F.col("raw_count") >= minimum)


def complete_measures(df: DataFrame, keys: Sequence[str], wanted: Column, measures: Sequence[str]) -> DataFrame:
    """Rows that are wanted, carry every measure and are the only such row of their key."""
    usable = wanted
    for m in measures:
        usable = usable & F.col(m).isNotNull()
    rows = df.where(usable)
    return lookup.without_ambiguous(rows, keys)


def attach_environment(df: DataFrame, certified: DataFrame, keys: Sequence[str], environment: str) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with exactly one certified environment, keys with none or several)."""
    known = certified.groupBy(*keys).agg(F.min(environment).alias("_lo"), F.max(environment).alias("_hi"))
    joined = df.join(known, list(keys), "left")
    one = F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))
    attached = joined.where(one).withColumn(environment, F.col("_lo")).drop("_lo", "_hi")
    faults = joined.where(~one).groupBy(*keys).agg(F.count("*").alias("row_count"), F.any_value(F.col("_lo").isNotNull()).alias("several"))
    return attached, faults
