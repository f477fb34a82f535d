"""Join shapes: checked lookups, reconciliations, key-set comparison, prior-period pairing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_counts(entities: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left lookup that reads "no matching rows" as zero for every numeric measure."""
    measures = [c for c in counts.columns if c not in keys]
    return entities.join(counts, list(keys), "left").fillna(0, subset=measures)


def attach_one(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(facts with the dimension's columns, duplicated dimension keys).

    The second frame must be empty for the first one to keep one row per fact; callers assert it
    with ``checks.assert_empty`` when they need to fail.
    """
    duplicated = dimension.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")
    return facts.join(dimension, list(keys), "left"), duplicated


def reconcile(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str], labels: tuple[str, str] = ("left", "right")
) -> DataFrame:
    """Full-outer comparison of two count tables: both values (missing = 0) and their difference."""
    one, two = labels
    a = left.select(*keys, *[F.col(m).alias(f"{one}_{m}") for m in measures], F.lit(True).alias(f"in_{one}"))
    b = right.select(*keys, *[F.col(m).alias(f"{two}_{m}") for m in measures], F.lit(True).alias(f"in_{two}"))
    both = a.join(b, list(keys), "full").fillna(False, subset=[f"in_{one}", f"in_{two}"])
    columns = [F.col(k) for k in keys] + [F.col(f"in_{one}"), F.col(f"in_{two}")]
    for m in measures:
        x, y = F.coalesce(F.col(f"{one}_{m}"), F.lit(0)), F.coalesce(F.col(f"{two}_{m}"), F.lit(0))
        columns += [x.alias(f"{one}_{m}"), y.alias(f"{two}_{m}"), (x - y).alias(f"{m}_difference")]
    return both.select(*columns)


def orphans(facts: DataFrame, dimension: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Facts whose key has no row in the dimension; ``on`` maps fact column -> dimension column."""
    condition = [F.col(f"f.{f}") == F.col(f"d.{d}") for f, d in on.items()]
    return facts.alias("f").join(dimension.alias("d"), condition, "left_anti")


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys on either side with null-safe matching and where each one was found."""
    a = left.select(*keys).distinct().withColumn("_side", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_side", F.lit(2))
    # groupBy treats null keys as equal, which is the null-safe match, and needs no join at all.
    sides = a.unionByName(b).groupBy(*keys).agg(F.sum("_side").alias("_sides"))
    place = F.when(F.col("_sides") == 3, "both").when(F.col("_sides") == 1, "left_only").otherwise("right_only")
    return sides.select(*keys, place.alias("place"))


def with_prior(
    df: DataFrame, keys: Sequence[str], period: str, fields: Sequence[str], back: int = 1, prefix: str = "prior_"
) -> DataFrame:
    """Attach each entity's values from ``back`` periods earlier (null when it has none)."""
    earlier = df.select(*keys, (F.col(period) + back).alias(period), *[F.col(f).alias(prefix + f) for f in fields])
    return df.join(earlier, [*keys, period], "left")


def union_sources(frames: Sequence[DataFrame], schema: Mapping[str, str]) -> DataFrame:
    """Union same-meaning frames after casting each to the one declared schema."""
    shaped = [f.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in schema.items()]) for f in frames]
    result = shaped[0]
    for frame in shaped[1:]:
        result = result.unionByName(frame)
    return result


def without_ambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every row of a key that occurs more than once.

    Only keys are counted and only the repeated ones meet the rows again, so rows are neither sorted
    nor carried through an aggregate. Null keys are keys like others.
    """
    repeated = df.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.join(repeated, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left_anti")


def overlapping_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys claimed by both sources, which must be none before they are stacked."""
    return key_overlap(left, right, keys).where("place = 'both'").select(*keys)


def attach_total(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Give every row the columns of a one-row frame, as a scalar subquery rather than a join."""
    row = totals.select(F.struct(*totals.columns)).scalar()
    return df.withColumn("_total", row).select(*df.columns, *[F.col(f"_total.{c}") for c in totals.columns])


def scalar(totals: DataFrame, column: str) -> Column:
    return totals.select(column).scalar()
