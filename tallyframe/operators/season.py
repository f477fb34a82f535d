"""Per-entity period summaries with their long category profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import ratio


def complete(profile: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Give every key all categories, absent ones with zero counts.

    One aggregate lays the fixed categories out as columns and unfolds them again, so the input is
    read once and the result stays partitioned by key.
    """
    kinds = dict(profile.dtypes)
    cells = {
        (c, n): F.coalesce(F.sum(F.when(F.col(category) == c, F.col(n))), F.lit(0)).cast(kinds[n]) for c in categories for n in counts
    }
    wide = profile.groupBy(*keys).agg(*[e.alias(f"_{categories.index(c)}_{n}") for (c, n), e in cells.items()])
    rows = [
        F.struct(F.lit(c).alias(category), *[F.col(f"_{i}_{n}").alias(n) for n in counts]) for i, c in enumerate(categories)
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def valued_summary(
    totals: DataFrame, profile: DataFrame, values: DataFrame, keys: Sequence[str], value_keys: Sequence[str], category: str, declared: str
) -> tuple[DataFrame, DataFrame]:
    """(summary, profile) of category counts valued with a per-environment category table.

    The summary carries how much of the declared total the profile covers, how many counted events
    could be valued, and the value per 100 declared units.
    ``values``: value_keys, category, estimated_mean, estimator_certified.
    """
    long = (
        profile.join(values, [*value_keys, category], "left")
        .join(totals.select(*keys, declared), list(keys), "left")
        .withColumn("share", ratio(F.col("occurrence_count"), F.col(declared)))
        .withColumn("expected_value", F.col("occurrence_count") * F.col("estimated_mean"))
    )
    valued = F.col("estimated_mean").isNotNull()
    per_key = long.groupBy(*keys).agg(
        F.sum("occurrence_count").alias("profile_event_count"),
        F.sum(F.when(valued, F.col("occurrence_count")).otherwise(0)).alias("valued_event_count"),
        F.sum("expected_value").alias("_value"),
        F.max(~F.coalesce(F.col("estimator_certified"), F.lit(False))).alias("_uncertified"),
    )
    joined = totals.join(per_key, list(keys), "left").fillna(0, subset=["profile_event_count", "valued_event_count"])
    events, worth = F.col("profile_event_count"), F.coalesce("_value", F.lit(0.0))
    summary = (
        joined.withColumn("uncovered_count", F.col(declared) - events)
        .withColumn("coverage_rate", ratio(events, F.col(declared)))
        .withColumn("unvalued_event_count", events - F.col("valued_event_count"))
        .withColumn("expected_value_total", worth)
        .withColumn("expected_value_per_100", ratio(100.0 * worth, F.col(declared)))
        .withColumn("mean_event_value", ratio(worth, F.col("valued_event_count")))
        .withColumn("has_uncertified_value", F.coalesce("_uncertified", events > 0))
        .withColumn("profile_exceeds_total", events > F.col(declared))
        .drop("_value", "_uncertified")
    )
    return summary, long


def partition_profile(
    df: DataFrame, keys: Sequence[str], total: str, parts: Mapping[str, Column], other: str, sums: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(summary, long profile) of a total split into named parts and an ``other`` rest.

    Rows of one key are added up first and keys without a positive total are left out. ``parts``
    are expressions over the summed columns.
    """
    numeric = [c for c in df.columns if c not in keys]
    added = df.where(F.col(total) > 0).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric])
    named = added.select("*", *[e.alias(n) for n, e in parts.items()])
    rest = F.col(total)
    for name in parts:
        rest = rest - F.col(name)
    summary = named.withColumn(other, rest)
    categories = [*parts, other]
    long = summary.unpivot(list(keys) + [total], categories, "category", "occurrence_count")
    return summary, long.withColumn("probability", F.col("occurrence_count") / F.col(total))


def role_profile(
    df: DataFrame, keys: Sequence[str], role: str, preferred: str, fallback: str, tie_breaks: Sequence[Column]
) -> tuple[DataFrame, DataFrame]:
    """(role shares, primary role) from preferred evidence, or fallback evidence where there is none.

    One row per key and role is expected; a key's roles are a fixed short list.
    """
    whole = Window.partitionBy(*keys)
    has_preferred = F.sum(preferred).over(whole) > 0
    rows = df.withColumn("role_evidence_mode", F.when(has_preferred, F.lit(preferred)).otherwise(F.lit(f"{fallback}_fallback")))
    rows = rows.withColumn("role_events", F.when(has_preferred, F.col(preferred)).otherwise(F.col(fallback)))
    rows = rows.withColumn("total_role_events", F.sum("role_events").over(whole)).where("total_role_events > 0")
    shares = rows.withColumn("role_share", F.col("role_events") / F.col("total_role_events"))
    order = Window.partitionBy(*keys).orderBy(F.desc("role_events"), *tie_breaks)
    first = shares.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    primary = first.select(
        *keys, F.col(role).alias("primary_role"), F.col("role_share").alias("primary_share"), "role_evidence_mode", "total_role_events"
    )
    return shares, primary


def recording_fidelity(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Per sequence: rows recorded, largest position, and how many positions are missing."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("recorded_count"), F.max(position).cast("bigint").alias("max_position"))
    return per_key.withColumn("position_gap", F.greatest(F.col("max_position") - F.col("recorded_count"), F.lit(0)))


def assign_environment(df: DataFrame, label: str, period: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the environment their label meant in that period, labels nobody declared).

    ``aliases``: label, first_period, last_period, environment, with spans that do not overlap. The
    alias spans are unfolded to single periods so the lookup stays an equality join.
    """
    spans = aliases.select(
        F.col("label").alias(label), "environment", F.explode(F.sequence("first_period", "last_period")).alias(period)
    )
    joined = df.join(spans, [label, period], "left")
    unknown = joined.where("environment is null").groupBy(label, period).agg(F.count("*").alias("row_count"))
    return joined, unknown
