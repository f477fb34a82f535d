"""Plate appearances and contacts: families, evidence status and the twelve profile bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.baseball import vocabulary as v

SEQUENCE = ["game_pk", "at_bat_index"]


def trajectory_family(bb_type: Column) -> Column:
    return F.coalesce(fn.map_value(bb_type, v.TRAJECTORY_FAMILY), F.lit("UNKNOWN"))


def contact_bin(family: Column, direction: Column) -> Column:
    """Profile bin of a trajectory family and direction; null when the evidence is incomplete."""
    directed = F.concat_ws("_", fn.map_value(direction, v.DIRECTION_PREFIX), family)
    return F.when(family == "IFFB", F.lit("IFFB")).when(family.isin(v.DIRECTED_FAMILIES) & direction.isNotNull(), directed)


def foul_screen(family: Column, narrative: Column) -> Column:
    """True, false, or null (an air ball without a narrative may have been foul)."""
    air = family.isin(v.AIR_FAMILIES)
    return F.when(~air, F.lit(False)).when(fn.present(narrative), narrative.rlike(v.FOUL_TERRITORY))


def foul_status(clean: Column, family: Column, narrative: Column) -> Column:
    """Why the foul screen of a batted ball came out as it did; ``clean``: expected and with exactly one ball."""
    screen = foul_screen(family, narrative)
    return fn.first_case(
        [
            (~clean, "not_evaluable_unclean_or_non_bip"),
            (~family.isin(v.AIR_FAMILIES), "not_foul_air_trajectory"),
            (screen.isNull(), "unknown_missing_official_description"),
            (screen, "foul_air_official_foul_territory"),
        ],
        "not_foul_air_official_description",
    )


def result_group(event_type: Column) -> Column:
    """One of nine structured contact results; anything else is null."""
    return fn.map_value(F.trim(event_type), v.CONTACT_RESULT_GROUP)


def with_narrative_group(df: DataFrame, text: str) -> DataFrame:
    """Add terminal_outcome_group, terminal_outcome_status and terminal_outcome_matches.

    Blank, bunt and special narratives are set aside first. Then every pattern is tried, and only a
    single distinct group is accepted.
    """
    narrative = F.col(text)
    aside = (
        F.when(~fn.present(narrative), "unsupported_blank_description")
        .when(narrative.rlike(v.BUNT_NARRATIVE), "unsupported_bunt")
        .when(narrative.rlike(v.SPECIAL_NARRATIVE), "unsupported_special_result")
    )
    matched = fn.with_text_groups(df.withColumn("_aside", aside), narrative, v.NARRATIVE_PATTERNS, "_groups", "_match")
    labels = {"supported": "supported_narrative_fallback", "ambiguous": "ambiguous_narrative_groups", "unsupported": "unsupported_narrative_result"}
    status = F.coalesce("_aside", fn.map_value(F.col("_match"), labels))
    return (
        matched.withColumn("terminal_outcome_status", status)
        .withColumn("terminal_outcome_group", F.when(F.col("terminal_outcome_status") == labels["supported"], F.get("_groups", F.lit(0))))
        .withColumn("terminal_outcome_matches", F.when(F.col("_aside").isNull(), F.array_join("_groups", ",")).otherwise(""))
        .drop("_aside", "_groups", "_match")
    )


def outcome_group(event_type: Column) -> Column:
    return fn.first_case(
        [
            (event_type.isin(v.STRIKEOUT_EVENTS), "strikeout"),
            (event_type == "walk", "walk"),
            (event_type == "intent_walk", "intentional_walk"),
            (event_type == "hit_by_pitch", "hit_by_pitch"),
            (event_type.isin(v.SPECIAL_EVENTS), "special_non_bip"),
        ],
        "batted_ball",
    )


def classify_contacts(contacts: DataFrame) -> DataFrame:
    """Profile bin and status of resolved contacts.

    Needs bb_type, hc_x, hc_y, batter_side and result_description; other columns pass through.
    """
    angle = fn.spray_angle(F.col("hc_x"), F.col("hc_y"))
    direction = fn.batted_direction(F.col("hc_x"), F.col("hc_y"), F.col("batter_side"))
    placed = (
        contacts.withColumn("trajectory_family", trajectory_family(F.col("bb_type")))
        .withColumn("spray_angle", angle)
        .withColumn("direction", direction)
        .withColumn("is_foul_air_out", foul_screen(F.col("trajectory_family"), F.col("result_description")))
    )
    family, foul = F.col("trajectory_family"), F.col("is_foul_air_out")
    candidate = contact_bin(family, F.col("direction"))
    binned = placed.withColumn("core_bin", F.when(foul == F.lit(False), candidate))
    status = fn.first_case(
        [
            (family == "BUNT", "special_bunt"),
            (family == "UNKNOWN", "unknown_missing_trajectory"),
            (family.isin(v.DIRECTED_FAMILIES) & F.col("direction").isNull(), "unknown_missing_direction"),
            (foul.isNull(), "unknown_missing_foul_narrative"),
            (foul, "foul_air_excluded"),
            (F.col("core_bin").isNotNull(), "core_contact"),
        ],
        "unknown_unclassified_contact",
    )
    return binned.withColumn("core_profile_eligible", F.col("core_bin").isNotNull()).withColumn("contact_profile_status", status)


def classify_plate_appearances(sequences: DataFrame, pitches: DataFrame) -> DataFrame:
    """One row per official plate appearance with its family, evidence status and profile bin.

    Outcome, narrative and batting side come from the official sequence; trajectory and coordinates
    from the in-play pitch, and only when there is exactly one. Pitches may bring conflict_field_count,
    the number of fields their sources disagree on; without it no pitch is in conflict.
    """
    official = sequences.where("classification_status = 'official_true_pa'").select(
        *SEQUENCE,
        "batter_mlbam_id",
        "pitcher_mlbam_id",
        "batter_side",
        F.col("result_event_type").alias("event_type"),
        F.col("result_description").alias("narrative"),
    )
    in_play = F.coalesce(F.col("is_in_play"), F.lit(False))
    conflicted = F.col("conflict_field_count") > 0 if "conflict_field_count" in pitches.columns else F.lit(False)
    evidence = pitches.groupBy(*SEQUENCE).agg(
        F.count_if(in_play).alias("in_play_count"),
        F.count_if(F.col("is_in_play").isNull()).alias("unknown_flag_count"),
        F.count_if(conflicted).alias("source_conflict_pitch_count"),
        F.max(F.when(in_play, F.struct("pitch_number", "bb_type", "hc_x", "hc_y"))).alias("_ball"),
    )
    joined = official.join(evidence, SEQUENCE, "left").fillna(0, subset=["in_play_count", "unknown_flag_count", "source_conflict_pitch_count"])
    ball = F.when(F.col("in_play_count") == 1, F.col("_ball"))
    placed = joined.select("*", ball["pitch_number"].alias("in_play_pitch_number"), ball["bb_type"].alias("bb_type"), ball["hc_x"].alias("hc_x"), ball["hc_y"].alias("hc_y")).drop("_ball")
    placed = placed.withColumn("spray_angle", fn.spray_angle(F.col("hc_x"), F.col("hc_y")))
    placed = placed.withColumn("trajectory_family", trajectory_family(F.col("bb_type"))).withColumn(
        "direction", fn.batted_direction(F.col("hc_x"), F.col("hc_y"), F.col("batter_side"))
    )
    event, family, direction = F.col("event_type"), F.col("trajectory_family"), F.col("direction")
    reached, struck, special = event.isin(v.WALK_OR_HIT_EVENTS), event.isin(v.STRIKEOUT_EVENTS), event.isin(v.SPECIAL_EVENTS)
    expected = event.isin(v.PLATE_APPEARANCE_EVENTS) & ~reached & ~struck & ~special
    balls, unknown = F.col("in_play_count"), F.col("unknown_flag_count")
    status = fn.first_case(
        [
            (~expected & (balls > 0), "unexpected_in_play_non_bip"),
            (expected & (balls == 0) & (unknown > 0), "conflicted_in_play_flag"),
            (expected & (balls == 0), "missing_in_play_pitch"),
            (expected & (balls > 1), "multiple_in_play_pitches"),
            (special, "special_non_bip"),
            (~expected, "complete_non_bip"),
            (family == "BUNT", "special_bunt"),
            (family == "UNKNOWN", "missing_trajectory"),
            (family.isin(v.DIRECTED_FAMILIES) & direction.isNull(), "missing_direction"),
        ],
        "complete_bip",
    )
    clean_outcome = (balls == 0) & (unknown == 0)
    before_screen = (
        F.when(clean_outcome & reached, F.lit("BB_HBP"))
        .when(clean_outcome & struck, F.lit("K"))
        .when(expected & (balls == 1), contact_bin(family, direction))
    )
    clean_ball = expected & (balls == 1)
    foul = F.when(clean_ball, foul_screen(family, F.col("narrative"))).otherwise(F.lit(False))
    return (
        placed.withColumn("performance_family", fn.first_case([(reached, "bb_hbp"), (struck, "strikeout"), (special, "special_non_bip")], "batted_ball"))
        .withColumn("is_bip_expected", expected)
        .withColumn("evidence_status", status)
        .withColumn("bin_before_foul_screen", before_screen)
        .withColumn("eligible_before_foul_screen", F.col("bin_before_foul_screen").isNotNull())
        .withColumn("foul_air_status", foul_status(clean_ball, family, F.col("narrative")))
        .withColumn("is_foul_air_out", foul)
        .withColumn("core_bin", F.when(F.col("is_foul_air_out") == F.lit(False), F.col("bin_before_foul_screen")))
        .withColumn("core_profile_eligible", F.col("core_bin").isNotNull())
    )


def attach_result_values(contacts: DataFrame, group: str = "terminal_outcome_group") -> tuple[DataFrame, DataFrame]:
    """(contacts with the value of their result group, groups outside the fixed nine)."""
    valued = contacts.withColumn("terminal_value", fn.map_value(F.col(group), v.CONTACT_RESULT_VALUE))
    return valued, valued.where(F.col("terminal_value").isNull()).groupBy(group).agg(F.count("*").alias("row_count"))
