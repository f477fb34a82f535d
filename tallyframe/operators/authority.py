"""Correcting a source with an authority: adjudication, overlays, ledgers, corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjudicate(
    conflicts: DataFrame, observations: DataFrame, official: DataFrame, keys: Sequence[str], fields: Sequence[str], snapshot: str
) -> DataFrame:
    """Judge every conflicting field of a key against an authority; evidence only, nothing is changed.

    ``conflicts`` names the fields of each key in ``conflict_fields``; other fields are not judged.
    ``official`` has at most one row per key. One row per key and field: values are compared as text,
    a snapshot with several values of its own makes the comparison ambiguous, and the lists hold
    snapshots in order, so a list is as long as there are snapshots of one key.
    """
    grain = [*keys, "field"]

    def cells(name: str) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]))

    listed = conflicts.select(*keys, F.explode("conflict_fields").alias("field")).distinct()
    candidates = (
        observations.select(*keys, snapshot, cells("_value"))
        .where(F.col("_value").isNotNull())
        .join(listed, grain, "left_semi")
        .groupBy(*grain, snapshot)
        .agg(F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    )
    truth = official.select(*keys, F.lit(True).alias("official_available"), cells("official_value"))
    judged = candidates.join(truth, grain, "left")
    single = F.col("_lo") == F.col("_hi")
    hit = single & F.coalesce(F.col("_lo") == F.col("official_value"), F.lit(False))

    def snapshots(which: Column, what: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, what)))

    per_field = judged.groupBy(*grain).agg(
        F.any_value("official_value").alias("official_value"),
        F.coalesce(F.any_value("official_available"), F.lit(False)).alias("official_available"),
        F.count("*").alias("candidate_snapshot_count"),
        F.count_if(~single).alias("ambiguous_snapshot_count"),
        snapshots(single, F.struct(F.col(snapshot).alias("snapshot"), F.col("_lo").alias("value"))).alias("candidate_values"),
        snapshots(~single, F.col(snapshot)).alias("ambiguous_snapshots"),
        snapshots(hit, F.col(snapshot)).alias("_hits"),
    )
    usable = F.col("official_value").isNotNull() & (F.col("ambiguous_snapshot_count") == 0)
    matching = F.when(usable, F.col("_hits")).otherwise(F.slice("_hits", 1, 0))
    matches = F.size("matching_snapshots").cast("bigint")
    status = (
        F.when(F.col("official_value").isNull(), "official_unavailable")
        .when(F.col("ambiguous_snapshot_count") > 0, "source_candidate_ambiguous")
        .when(matches == 0, "official_matches_no_source_snapshot")
        .when(matches == F.col("candidate_snapshot_count"), "official_matches_all_source_snapshots")
        .when(matches == 1, "official_matches_one_source_snapshot")
        .otherwise("official_matches_multiple_source_snapshots")
    )
    return per_field.withColumn("matching_snapshots", matching).withColumn("matching_snapshot_count", matches).withColumn("status", status).drop("_hits")


def overlay(source: DataFrame, official: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Official value first, source value as fallback, with mismatch flags and who supplied them all."""
    renamed = official.select(*keys, *[F.col(f).alias(f"official_{f}") for f in fields], F.lit(True).alias("official_found"))
    joined = source.withColumnsRenamed({f: f"source_{f}" for f in fields}).join(renamed, list(keys), "left")
    result = joined.fillna(False, subset=["official_found"])
    for f in fields:
        o, s = F.col(f"official_{f}"), F.col(f"source_{f}")
        result = result.withColumn(f"{f}_mismatch", F.coalesce(o != s, F.lit(False))).withColumn(f"working_{f}", F.coalesce(o, s))
    all_official = F.lit(True)
    all_source = F.lit(True)
    for f in fields:
        all_official = all_official & F.col(f"official_{f}").isNotNull()
        all_source = all_source & F.col(f"source_{f}").isNotNull()
    label = F.when(all_official, "official").when(all_source, "source_only").otherwise("incomplete")
    return result.withColumn("working_authority", label)


def residuals(observed: DataFrame, control: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Observed minus control count per key, a key missing on a side counting as zero there."""
    a = observed.select(*keys, F.col(count).alias("observed_count"))
    b = control.select(*keys, F.col(count).alias("control_count"))
    both = a.join(b, list(keys), "full").fillna(0, subset=["observed_count", "control_count"])
    return both.withColumn("difference", F.col("observed_count") - F.col("control_count"))


def exception_groups(residual: DataFrame, group: Sequence[str]) -> DataFrame:
    return residual.where("difference <> 0").select(*group).distinct()


def exception_overlay(
    rows: DataFrame, authority: DataFrame, exceptions: DataFrame, group: Sequence[str], keys: Sequence[str], source: str, official: str, name: str
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``name`` from the authority inside exception groups only, uncovered exception keys)."""
    marked = rows.join(exceptions.withColumn("_exception", F.lit(True)), list(group), "left")
    joined = marked.join(authority.select(*keys, F.col(official).alias("_official")), list(keys), "left")
    inside = F.coalesce(F.col("_exception"), F.lit(False))
    uncovered = joined.where(inside & F.col("_official").isNull()).select(*keys).distinct()
    result = joined.withColumn(name, F.when(inside, F.col("_official")).otherwise(F.col(source))).withColumn(
        "participant_authority", F.when(inside, "official_exception_overlay").otherwise("source_default")
    )
    return result.drop("_exception", "_official"), uncovered


def single_reassignments(residual: DataFrame, group: Sequence[str], entity: str) -> DataFrame:
    """Groups where one unit plainly belongs to the other member.

    Exactly two members are off, one by +1 and one by -1, and the +1 member has one observed unit
    against none expected.
    """
    plus, minus = F.col("difference") == 1, F.col("difference") == -1
    off = residual.where("difference <> 0").groupBy(*group).agg(
        F.count("*").alias("off"),
        F.count_if(plus & (F.col("observed_count") == 1) & (F.col("control_count") == 0)).alias("donors"),
        F.count_if(minus).alias("takers"),
        F.max(F.when(plus, F.col(entity))).alias("source_entity"),
        F.max(F.when(minus, F.col(entity))).alias("reassigned_entity"),
    )
    return off.where("off = 2 and donors = 1 and takers = 1").select(*group, "source_entity", "reassigned_entity")


def quarantine(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def apply_corrections(
    rows: DataFrame, corrections: DataFrame, group: str, entity: str, day: str, vector: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(corrected rows, status of every listed correction).

    A correction remaps an entity inside one group only while the row still shows the pinned date
    and vector. A row already held by the target is allowed, and dropped, only when it is an empty
    placeholder.
    ``corrections``: group, source_entity, corrected_entity, pinned_day, pinned_<field>.
    """
    pins = corrections.select(
        group,
        F.col("source_entity").alias(entity),
        "corrected_entity",
        "pinned_day",
        F.struct(*[F.col(f"pinned_{v}").cast("bigint").alias(v) for v in vector]).alias("_pinned"),
    )
    now = F.struct(*[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v) for v in vector])
    found = pins.join(rows.select(group, entity, F.col(day).alias("_day"), now.alias("_now")), [group, entity], "left")
    empty = F.lit(True)
    for v in vector:
        empty = empty & F.col(v).isNull()
    target = rows.select(group, F.col(entity).alias("corrected_entity"), empty.alias("_target_empty"))
    judged = found.join(target, [group, "corrected_entity"], "left").withColumn(
        "status",
        F.when(F.col("_now").isNull(), "source_row_missing")
        .when(F.col("_day") != F.col("pinned_day"), "date_drifted")
        .when(F.col("_now") != F.col("_pinned"), "vector_drifted")
        .when(~F.coalesce(F.col("_target_empty"), F.lit(True)), "target_collision")
        .otherwise("applied"),
    )
    applied = judged.where("status = 'applied'")
    placeholders = applied.select(group, F.col("corrected_entity").alias(entity))
    remap = applied.select(group, entity, "corrected_entity")
    corrected = (
        rows.join(placeholders, [group, entity], "left_anti")
        .join(remap, [group, entity], "left")
        .withColumn(entity, F.coalesce("corrected_entity", entity))
        .drop("corrected_entity")
    )
    return corrected, judged.select(group, F.col(entity).alias("source_entity"), "corrected_entity", "status")


def ledger_authority(
    source: DataFrame, ledger: DataFrame, entity: Sequence[str], game: Sequence[str], fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(corrected rows, changed-field evidence) for entities whose totals differ from the ledger.

    Inside such an entity's slice the ledger wins field by field, ledger-only positive rows are
    inserted, and source-only rows are kept but marked, for a check to refuse. Other entities are
    left as they are. The first field decides whether a row counts as positive.
    """
    key = [*entity, *game]
    totals = [F.sum(f).alias(f) for f in fields]
    ours = source.groupBy(*entity).agg(*totals).select(*entity, F.struct(*fields).alias("_ours"))
    theirs = ledger.groupBy(*entity).agg(*totals).select(*entity, F.struct(*fields).alias("_theirs"))
    residual = ours.join(theirs, list(entity)).where("_ours <> _theirs").select(*entity, F.lit(True).alias("_residual"))
    a = source.select(*key, F.struct(*fields).alias("_s"))
    b = ledger.where(F.col(fields[0]) > 0).select(*key, F.struct(*fields).alias("_l"))
    both = a.join(b, key, "full").join(residual, list(entity), "left").fillna(False, subset=["_residual"])
    both = both.where(F.col("_s").isNotNull() | F.col("_residual"))
    s, l = F.col("_s"), F.col("_l")
    action = (
        F.when(~F.col("_residual"), "source_kept")
        .when(s.isNull(), "ledger_insert")
        .when(l.isNull(), "source_only")
        .when(s != l, "ledger_overlay")
        .otherwise("source_confirmed")
    )
    acted = both.withColumn("action", action)
    use = F.col("action").isin("ledger_insert", "ledger_overlay")
    corrected = acted.select(*key, *[F.when(use, F.col(f"_l.{f}")).otherwise(F.col(f"_s.{f}")).alias(f) for f in fields], "action")
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"_s.{f}").cast("bigint").alias("source_value"), F.col(f"_l.{f}").cast("bigint").alias("ledger_value"))
            for f in fields
        ]
    )
    evidence = acted.where(use).select(*key, "action", F.inline(cells))
    changed = F.col("ledger_value") != F.coalesce(F.col("source_value"), F.lit(0))
    return corrected, evidence.where(changed)


def fill_from_sibling(rows: DataFrame, sibling: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``field`` filled and labelled, faults) from a sibling that must name exactly one value per key."""
    mapping = sibling.where(F.col(field).isNotNull()).groupBy(key).agg(F.min(field).alias("_lo"), F.max(field).alias("_hi"))
    joined = rows.join(mapping, key, "left")
    several = F.col("_lo") != F.col("_hi")
    known = F.when(~several, F.col("_lo"))
    fault = (
        F.when(several, "sibling_conflict")
        .when(F.col(field) != known, "mismatch")
        .when(F.col(field).isNull() & known.isNull(), "unmapped")
    )
    label = F.when(F.col(field).isNotNull(), "source").when(known.isNotNull(), "sibling").otherwise("missing")
    faults = joined.withColumn("fault", fault).where("fault is not null").groupBy("fault").agg(F.count("*").alias("row_count"))
    filled = joined.withColumn(f"{field}_authority", label).withColumn(field, F.coalesce(F.col(field), known)).drop("_lo", "_hi")
    return filled, faults


def compare_to_authority(source: DataFrame, official: DataFrame, keys: Sequence[str], roles: Mapping[str, str]) -> DataFrame:
    """Per role: matched, mismatched, missing and conflicting counts at the authority's grain.

    ``roles`` maps source column -> authority column. The source is first reduced to one row per
    key; a role with several values there is a conflict.
    """
    reduced = source.groupBy(*keys).agg(
        *[c for r in roles for c in (F.min(r).alias(f"_lo_{r}"), F.max(r).alias(f"_hi_{r}"))], F.lit(True).alias("_in_source")
    )
    truth = official.select(*keys, *[F.col(o).alias(f"_o_{r}") for r, o in roles.items()], F.lit(True).alias("_in_official"))
    both = reduced.join(truth, list(keys), "full")
    place = (
        F.when(F.col("_in_source").isNull(), "authority_only").when(F.col("_in_official").isNull(), "source_only").otherwise("shared")
    )

    def outcome(role: str) -> Column:
        lo, hi, o = F.col(f"_lo_{role}"), F.col(f"_hi_{role}"), F.col(f"_o_{role}")
        status = (
            F.when(place != "shared", place)
            .when(lo != hi, "conflict")
            .when(lo.isNull() | o.isNull(), "missing")
            .when(lo == o, "matched")
            .otherwise("mismatched")
        )
        return F.struct(F.lit(role).alias("role"), status.alias("status"))

    return both.select(F.inline(F.array(*[outcome(r) for r in roles]))).groupBy("role", "status").agg(F.count("*").alias("key_count"))


def count_gaps(source: DataFrame, official: DataFrame, group: Sequence[str], unit: str, count: str) -> tuple[DataFrame, DataFrame]:
    """(status of every unit, one row of totals per group) of source counts against an authority's.

    Both sides hold at most one row per group and unit. A unit that only the authority has is a gap:
    explained when the authority itself counts nothing there, else unexplained. Shared units agree on
    the count or mismatch, or lack a count on a side.
    """
    keys = [*group, unit]
    ours = source.select(*keys, F.col(count).cast("bigint").alias("source_count"), F.lit(True).alias("_s"))
    theirs = official.select(*keys, F.col(count).cast("bigint").alias("official_count"), F.lit(True).alias("_o"))
    both = ours.join(theirs, keys, "full")
    s, o = F.col("source_count"), F.col("official_count")
    status = (
        F.when(F.col("_o").isNull(), "source_only")
        .when(F.col("_s").isNull() & (o == 0), "zero_count_gap")
        .when(F.col("_s").isNull(), "unexplained_gap")
        .when(s.isNull() | o.isNull(), "count_missing")
        .when(s == o, "count_matched")
        .otherwise("count_mismatched")
    )
    units = both.withColumn("status", status).drop("_s", "_o")

    def having(name: str) -> Column:
        return F.count_if(F.col("status") == name).alias(f"{name}_count")

    names = ["source_only", "zero_count_gap", "unexplained_gap", "count_missing", "count_matched", "count_mismatched"]
    per_group = units.groupBy(*group).agg(
        F.count("*").alias("unit_count"),
        *[having(n) for n in names],
        F.sum(F.when(F.col("status") == "count_mismatched", F.abs(s - o)).otherwise(0)).alias("count_difference"),
    )
    return units, per_group


def outcome_owner(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], actor: str, strike: Column, strikeout: Column
) -> tuple[DataFrame, DataFrame]:
    """(owner of each sequence's outcome, sequences with more than two actors at stake).

    The last actor owns the outcome, except for a strikeout of exactly two actors where at least two
    strikes came before the substitute's first row: then the first actor does.
    """
    place = F.struct(*order)
    rows = df.withColumn("_strike", F.coalesce(strike, F.lit(False))).withColumn("_out", F.coalesce(strikeout, F.lit(False)))
    per_actor = rows.groupBy(*keys, actor).agg(F.min(place).alias("_first"), F.max(F.struct(place.alias("p"), F.col("_out").alias("o"))).alias("_last"))
    ends = per_actor.groupBy(*keys).agg(
        F.count("*").alias("actor_count"),
        F.min_by(actor, F.col("_first")).alias("initial_actor"),
        F.max_by(F.struct(F.col(actor).alias("who"), F.col("_last.o").alias("out"), F.col("_first").alias("since")), F.col("_last")).alias("_end"),
    )
    changed = (F.col("initial_actor") != F.col("_end.who")) & F.col("_end.out")
    before = (
        rows.join(ends.where(changed).select(*keys, F.col("_end.since").alias("_since")), list(keys))
        .where(place < F.col("_since"))
        .groupBy(*keys)
        .agg(F.count_if("_strike").alias("_strikes"))
    )
    owned = ends.join(before, list(keys), "left").fillna(0, subset=["_strikes"])
    to_first = changed & (F.col("actor_count") == 2) & (F.col("_strikes") >= 2)
    result = owned.select(
        *keys,
        "actor_count",
        F.col("_end.who").alias("terminal_actor"),
        F.when(to_first, F.col("initial_actor")).otherwise(F.col("_end.who")).alias("outcome_actor"),
    )
    return result, ends.where(changed & (F.col("actor_count") > 2)).select(*keys, "actor_count")


def source_only_rows(source: DataFrame, ledger: DataFrame, key: Sequence[str], amount: str) -> DataFrame:
    """Positive source rows whose key has no positive row in the ledger."""
    return source.where(F.col(amount) > 0).join(ledger.where(F.col(amount) > 0), list(key), "left_anti")


def confirmed_gaps(source: DataFrame, ledger: DataFrame, second: DataFrame, key: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(ledger with source-only rows an exact second source confirms, gaps it does not confirm).

    A gap is confirmed when the second source shows the very same values; a missing or different
    row leaves it open.
    """
    gaps = source_only_rows(source, ledger, key, fields[0]).select(*key, F.struct(*fields).alias("_s"))
    exact = second.select(*key, F.struct(*fields).alias("_x"))
    judged = gaps.join(exact, list(key), "left")
    same = F.coalesce(F.col("_s") == F.col("_x"), F.lit(False))
    added = judged.where(same).select(*key, *[F.col(f"_x.{f}").alias(f) for f in fields], F.lit("second_source").alias("authority"))
    open_gaps = judged.where(~same).select(*key, F.when(F.col("_x").isNull(), "no_second_source").otherwise("values_differ").alias("reason"))
    return ledger.select(*key, *fields, F.lit("ledger").alias("authority")).unionByName(added), open_gaps


def residual_quarantine(
    source: DataFrame, ledger: DataFrame, season_residual: DataFrame, entity: Sequence[str], game: Sequence[str], fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(source without proven extra rows, verdict per entity with source-only rows).

    A row goes only if it is its entity's single source-only row, equals the season residual exactly,
    and its removal makes the entity's totals equal the ledger's.
    ``season_residual``: entity columns and one ``residual_<field>`` per field.
    """
    key = [*entity, *game]
    extra = source_only_rows(source, ledger, key, fields[0])
    single = extra.groupBy(*entity).agg(
        F.count("*").alias("_n"), *[F.max(g).alias(g) for g in game], F.max(F.struct(*fields)).alias("_row")
    )
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f) for f in fields])

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(fields[0]) > 0).groupBy(*entity).agg(F.struct(*[F.sum(f).alias(f) for f in fields]).alias(name))

    residual = season_residual.select(*entity, F.struct(*[F.col(f"residual_{f}").cast("bigint").alias(f) for f in fields]).alias("_season"))
    judged = single.join(residual, list(entity), "left").join(totals(source, "_all"), list(entity)).join(totals(ledger, "_ledger"), list(entity), "left")
    after = F.struct(*[(F.col(f"_all.{f}") - F.col(f"_row.{f}")).alias(f) for f in fields])
    verdict = (
        F.when(F.col("_n") != 1, "several_source_only_rows")
        .when(~F.coalesce(F.col("_row") == F.col("_season"), F.lit(False)), "season_residual_differs")
        .when(after != F.coalesce(F.col("_ledger"), zero), "ledger_totals_differ")
        .otherwise("quarantined")
    )
    verdicts = judged.withColumn("verdict", verdict)
    proven = verdicts.where("verdict = 'quarantined'")
    kept = source.join(proven.select(*key), key, "left_anti")
    return kept, verdicts.select(*entity, "verdict")


def fully_explained(kept: DataFrame, ledger: DataFrame, verdicts: DataFrame, entity: Sequence[str], amount: str) -> DataFrame:
    """Entities whose proven quarantine leaves no positive row in either ledger."""
    proven = verdicts.where("verdict = 'quarantined'").select(*entity)
    left = kept.where(F.col(amount) > 0).select(*entity)
    listed = ledger.where(F.col(amount) > 0).select(*entity)
    return proven.join(left, list(entity), "left_anti").join(listed, list(entity), "left_anti")
