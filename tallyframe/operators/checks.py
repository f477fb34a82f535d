"""Contract checks as queries that return violations; nothing runs until a caller asks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import lookup


class ContractViolation(ValueError):
    """A check that must be empty returned rows."""


def assert_empty(violations: DataFrame, message: str, examples: int = 10) -> None:
    """The one eager helper: fail with a few example rows if a check found any."""
    found = violations.limit(examples).collect()
    if found:
        raise ContractViolation(f"{message}: {[row.asDict() for row in found]}")


def conform(df: DataFrame, schema: Mapping[str, str], required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(table cast to the declared schema, per-column counts of lossy casts and missing values)."""
    missing = [c for c in schema if c not in df.columns]
    extra = [c for c in df.columns if c not in schema]
    if missing or extra:
        raise ContractViolation(f"columns differ from the contract: missing={missing}, extra={extra}")
    shaped = df.select(*[F.col(c).try_cast(k).alias(c) for c, k in schema.items()])
    cells = []
    for column, kind in schema.items():
        lossy = F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()
        absent = F.col(column).isNull() if column in required else F.lit(False)
        cells.append(
            F.struct(F.lit(column).alias("column_name"), F.count_if(lossy).alias("lossy_cast_count"), F.count_if(absent).alias("missing_count"))
        )
    report = df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
    return shaped, report


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def broken_links(chain: Sequence[tuple[str, DataFrame, DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Orphan count of each link (label, facts, dimension, column map) of a reference chain."""
    parts = [lookup.orphans(f, d, on).agg(F.count("*").alias("orphan_count")).select(F.lit(label).alias("link"), "orphan_count") for label, f, d, on in chain]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each named rule, for all rules in one pass; an unknown result breaks it too."""
    cells = [F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(r, F.lit(False))).alias("violation_count")) for n, r in rules.items()]
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def identity_residual(df: DataFrame, total: Column, parts: Sequence[Column], name: str = "accounting_residual") -> DataFrame:
    """Add total minus the sum of its parts, a missing part counting as zero."""
    rest = total
    for part in parts:
        rest = rest - F.coalesce(part, F.lit(0))
    return df.withColumn(name, rest)


def profile_faults(
    summary: DataFrame, profile: DataFrame, keys: Sequence[str], declared: str, count: str, category: str, expected: Sequence[str] = ()
) -> DataFrame:
    """Keys whose category counts do not add up to the declared total, or miss expected categories."""
    sums = profile.groupBy(*keys).agg(F.sum(count).alias("profile_total"), F.count_distinct(category).alias("category_count"))
    both = summary.select(*keys, F.col(declared).alias("declared_total")).join(sums, list(keys), "full")
    both = both.fillna(0, subset=["declared_total", "profile_total", "category_count"])
    wrong = F.col("declared_total") != F.col("profile_total")
    if expected:
        wrong = wrong | (F.col("category_count") != len(expected))
    return both.where(wrong)


def simplex_faults(profile: DataFrame, keys: Sequence[str], probability: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose probabilities leave [0, 1] or do not add up to one."""
    sums = profile.groupBy(*keys).agg(F.sum(probability).alias("probability_sum"), F.min(probability).alias("_lo"), F.max(probability).alias("_hi"))
    return sums.where((F.abs(F.col("probability_sum") - 1) > tolerance) | (F.col("_lo") < 0) | (F.col("_hi") > 1)).select(*keys, "probability_sum")


def grain_faults(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Keys where a roll-up of the fine grain differs from the coarse table in any measure."""
    rolled = fine.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    compared = lookup.reconcile(rolled, coarse, keys, measures, ("fine", "coarse"))
    off = F.exists(F.array(*[F.col(f"{m}_difference") != 0 for m in measures]), lambda x: x)
    return compared.where(off)


def conflict_issues(resolved: DataFrame, keys: Sequence[str], entity_type: str, check: str, version: str) -> DataFrame:
    """One issue per conflicting entity, with an id that depends on its content only."""
    details = F.to_json(F.struct(F.array_sort("conflict_fields").alias("conflict_fields")))
    identity = F.concat_ws("|", F.lit(entity_type), *[F.col(k).cast("string") for k in keys], F.lit(check), F.lit(version), details)
    return resolved.where("conflict_field_count > 0").select(
        F.concat(F.lit("issue_"), F.sha2(identity, 256)).alias("quality_issue_id"),
        F.lit("source_consensus_conflict").alias("issue_code"),
        F.lit("warning").alias("severity"),
        F.lit(entity_type).alias("entity_type"),
        *keys,
        F.lit(check).alias("check_name"),
        F.lit(version).alias("check_version"),
        details.alias("details_json"),
    )


def coverage_faults(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected members that are absent and members nobody expected."""
    places = lookup.key_overlap(observed, expected, keys).where("place <> 'both'")
    return places.withColumn("fault", F.when(F.col("place") == "left_only", "unexpected").otherwise("absent")).drop("place")


def with_capability(df: DataFrame, allowed: DataFrame, keys: Sequence[str], name: str = "capable") -> DataFrame:
    """Flag rows whose key is on the allow-list; anything else is not eligible."""
    return df.join(allowed.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").fillna(False, subset=[name])


def metadata_variants(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Distinct metadata payloads of each key with their evidence counts; more than one is a violation."""
    variants = df.groupBy(*keys, *fields).agg(F.count("*").alias("evidence_row_count"))
    counts = variants.groupBy(*keys).agg(F.count("*").alias("variant_count"))
    return variants.join(counts, list(keys))


def certification(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """One row describing a table: rows, distinct keys, repeats, null cells, the share of nulls in each column, the dates.

    A repeated key is exact if all its rows are equal, null for null, and conflicting otherwise. Rows are compared by a
    64-bit hash of their values and null flags. Column ``c`` reports its share of nulls as ``null_rate_c``.
    """
    row = F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])
    per_key = df.groupBy(*keys).agg(
        F.min(row).alias("_low"),
        F.max(row).alias("_high"),
        F.count("*").alias("_n"),
        F.min(day).alias("_lo"),
        F.max(day).alias("_hi"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns],
    )
    return per_key.agg(
        F.sum("_n").alias("row_count"),
        F.count("*").alias("key_count"),
        F.count_if(F.col("_n") > 1).alias("repeated_key_count"),
        F.count_if((F.col("_n") > 1) & (F.col("_low") == F.col("_high"))).alias("exact_repeated_key_count"),
        F.count_if(F.col("_low") != F.col("_high")).alias("conflicting_key_count"),
        F.sum(sum((F.col(f"_null_{c}") for c in df.columns[1:]), F.col(f"_null_{df.columns[0]}"))).alias("null_cell_count"),
        F.min("_lo").alias("first_date"),
        F.max("_hi").alias("last_date"),
        *[(F.sum(f"_null_{c}") / F.sum("_n")).alias(f"null_rate_{c}") for c in df.columns],
    )


def source_inventory(df: DataFrame, keys: Sequence[str], source: str, period: str, left: str, right: str) -> DataFrame:
    """Periods each of two source families covers per key, as sets and their overlap.

    Periods are made distinct first, so each set is bounded by the calendar.
    """
    cells = df.where(F.col(source).isin(left, right)).select(*keys, source, period).distinct()
    sets = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col(source) == left, F.col(period)))).alias("_a"),
        F.sort_array(F.collect_list(F.when(F.col(source) == right, F.col(period)))).alias("_b"),
    )
    return sets.select(
        *keys,
        F.size("_a").cast("bigint").alias("left_period_count"),
        F.size("_b").cast("bigint").alias("right_period_count"),
        F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("shared_period_count"),
        F.size(F.array_union("_a", "_b")).cast("bigint").alias("all_period_count"),
        (F.col("_a") == F.col("_b")).alias("parity"),
    )
