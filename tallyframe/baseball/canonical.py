"""Rules of the canonical tables, each checked by one pass that returns violation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.baseball import vocabulary as v
from tallyframe.operators import checks

KEYS = {
    "source_snapshot": ["source_snapshot_id"],
    "normalization_definition": ["normalization_id"],
    "play_sequence": ["normalization_id", "game_pk", "at_bat_index", "payload_hash"],
    "pitch": ["normalization_id", "game_pk", "at_bat_index", "pitch_number", "payload_hash"],
    "player_crosswalk": ["normalization_id", "mlbam_id"],
    "game": ["normalization_id", "game_pk", "payload_hash"],
    "quality_issue": ["quality_issue_id"],
    "event_semantics": ["event_semantics_snapshot_id", "event_type"],
}


def _id(name: str) -> Column:
    return F.col(name).rlike(v.SHA256_HEX)


def _not_later(early: str, late: str) -> Column:
    """Holds when either time is unknown."""
    return F.coalesce(F.col(early) <= F.col(late), F.lit(True))


def _sequence_flag() -> Column:
    flag, status = F.col("is_plate_appearance"), F.col("classification_status")
    agrees = {"official_true_pa": flag, "official_non_pa": ~flag, "unclassified_source_sequence": flag.isNull()}
    result = F.lit(False)
    for name, holds in agrees.items():
        result = result | ((status == name) & F.coalesce(holds, F.lit(False)))
    return result


def rules(table: str) -> dict[str, Column]:
    """Named row rules of a canonical table."""
    linked = {"normalization_id": _id("normalization_id"), "source_snapshot_id": _id("source_snapshot_id")}
    return {
        "source_snapshot": {
            "source_snapshot_id": _id("source_snapshot_id"),
            "content_sha256": _id("content_sha256"),
            "retrieved": F.col("retrieved_at_utc").isNotNull(),
            "published_before_retrieved": _not_later("source_published_at_utc", "retrieved_at_utc"),
            "known_before_retrieved": _not_later("knowledge_available_at_utc", "retrieved_at_utc"),
            "known_after_published": _not_later("source_published_at_utc", "knowledge_available_at_utc"),
        },
        "normalization_definition": linked,
        "play_sequence": {
            **linked,
            "payload_hash": _id("payload_hash"),
            "duplicate_row_count": F.col("duplicate_row_count") >= 1,
            "classification_status": F.col("classification_status").isin(v.SEQUENCE_STATUSES),
            "flag_agrees_with_status": _sequence_flag(),
        },
        "pitch": {
            **linked,
            "payload_hash": _id("payload_hash"),
            "duplicate_row_count": F.col("duplicate_row_count") >= 1,
            "pitch_number": F.col("pitch_number") >= 1,
        },
        "player_crosswalk": {**linked, "mlbam_id": F.col("mlbam_id").isNotNull()},
        "game": {
            **linked,
            "payload_hash": _id("payload_hash"),
            "evidence_row_count": F.col("evidence_row_count") >= 1,
            "official_date": F.col("official_date").isNotNull(),
            "season_agrees": F.coalesce(F.col("season") == F.year("official_date"), F.lit(True)),
        },
        "quality_issue": {
            "quality_issue_id": _id("quality_issue_id"),
            "severity": F.col("severity").isin(v.SEVERITIES),
            "entity_type": F.col("entity_type").isin(v.ENTITY_TYPES),
        },
        "event_semantics": {
            "event_type": F.length(F.trim("event_type")) > 0,
            "is_plate_appearance": F.col("is_plate_appearance").isNotNull(),
        },
    }[table]


def violations(df: DataFrame, table: str) -> DataFrame:
    """Broken rules of a canonical table with their counts, duplicate keys included."""
    broken = checks.rule_violations(df, rules(table)).where("violation_count > 0")
    repeated = checks.duplicate_keys(df, KEYS[table]).agg(F.count("*").alias("violation_count"))
    return broken.unionByName(repeated.select(F.lit("unique_key").alias("rule"), "violation_count").where("violation_count > 0"))
