"""Season tables: batting and pitching performance, certified bin values, game evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.baseball import vocabulary as v
from tallyframe.operators import lookup, season, statevalue

PLAYER_SEASON = ["season", "league_id", "player_id"]
PLAYER_GAME = ["season", "game_date", "game_pk", "league_id", "player_id"]


def level_of(league_column: str = "league_id"):
    return fn.map_value(F.col(league_column), v.LEAGUE_LEVEL)


def certified_bin_values(direct: DataFrame) -> DataFrame:
    """Direct bin means per season and league, pooled with the level's other leagues by its policy.

    ``direct``: season, league_id, core_bin, occurrence_count, mean_value.
    """
    placed = direct.withColumn("level_group", F.coalesce(level_of(), F.lit("UNKNOWN")))
    strength = fn.map_value(F.col("level_group"), v.LEVEL_POOLING_STRENGTH)
    return statevalue.pooled_values(placed, ["season", "league_id"], ["season", "level_group"], "core_bin", strength)


def batting_outcomes(team_rows: DataFrame) -> DataFrame:
    """Team rows added up to player, league and season, split into outcome families."""
    counts = ["plate_appearances", "base_on_balls", "hit_by_pitch", "strike_outs", "balls_in_play"]
    sums = team_rows.groupBy(*PLAYER_SEASON).agg(*[F.sum(f"batting_{c}").alias(f"batting_{c}") for c in counts])
    walks = F.col("batting_base_on_balls") + F.col("batting_hit_by_pitch")
    rest = F.col("batting_plate_appearances") - walks - F.col("batting_strike_outs") - F.col("batting_balls_in_play")
    return (
        sums.withColumn("bb_hbp_count", walks)
        .withColumn("strikeout_count", F.col("batting_strike_outs"))
        .withColumn("aggregate_contact_count", F.col("batting_balls_in_play"))
        .withColumn("aggregate_noncontact_noncore_pa_count", rest)
    )


def contact_summary(contacts: DataFrame) -> DataFrame:
    """Counts of classified contacts by status and by who identified the batter."""
    status, who = F.col("contact_profile_status"), F.col("participant_authority")
    return contacts.groupBy("season", "league_id", F.col("batter_mlbam_id").alias("player_id")).agg(
        F.count("*").alias("contact_event_count"),
        F.count_if("core_profile_eligible").alias("core_contact_count"),
        F.count_if(status == "special_bunt").alias("bunt_contact_count"),
        F.count_if(status == "foul_air_excluded").alias("foul_air_excluded_count"),
        F.count_if(~status.isin("core_contact", "special_bunt", "foul_air_excluded")).alias("unknown_contact_count"),
        F.count_if(who == "source_default").alias("source_default_contact_count"),
        F.count_if(who == "official_exception_overlay").alias("official_overlay_contact_count"),
        F.count_if(~who.isin("source_default", "official_exception_overlay")).alias("other_participant_authority_contact_count"),
        F.count_if(F.col("result_description_authority") == "source_certified_mirror").alias("source_mirror_narrative_contact_count"),
    )


def batting_performance(team_rows: DataFrame, contacts: DataFrame, bin_values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, long bin profile, contact keys without a season row)."""
    outcomes = batting_outcomes(team_rows)
    counted = lookup.with_counts(outcomes, contact_summary(contacts), PLAYER_SEASON)
    orphans = contacts.select("season", "league_id", F.col("batter_mlbam_id").alias("player_id")).distinct().join(outcomes, PLAYER_SEASON, "left_anti")

    fixed = F.array(
        F.struct(F.lit("BB_HBP").alias("core_bin"), F.col("bb_hbp_count").alias("occurrence_count")),
        F.struct(F.lit("K").alias("core_bin"), F.col("strikeout_count").alias("occurrence_count")),
    )
    outcome_rows = outcomes.select(*PLAYER_SEASON, F.inline(fixed))
    contact_rows = (
        contacts.where("core_bin is not null")
        .groupBy("season", "league_id", F.col("batter_mlbam_id").alias("player_id"), "core_bin")
        .agg(F.count("*").alias("occurrence_count"))
    )
    profile = outcome_rows.unionByName(contact_rows).where("occurrence_count > 0")
    values = bin_values.select("season", "league_id", "core_bin", "estimated_mean", "estimator_certified")
    summary, long = season.valued_summary(
        counted, profile, values, PLAYER_SEASON, ["season", "league_id"], "core_bin", "batting_plate_appearances"
    )
    contact_count = F.col("contact_event_count")
    summary = (
        summary.withColumn("contact_count_residual_vs_aggregate", contact_count - F.col("aggregate_contact_count"))
        .withColumn("contact_count_coverage_vs_aggregate", fn.ratio(contact_count, F.col("aggregate_contact_count")))
        .withColumn("core_contact_share", fn.ratio(F.col("core_contact_count"), contact_count))
        .withColumn("official_overlay_contact_rate", fn.ratio(F.col("official_overlay_contact_count"), contact_count))
    )
    return summary, long, orphans


def pitching_performance(team_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, five-way profile) of batters faced; intentional walks belong to the rest."""
    p = "pitching_"
    parts = {
        "K": F.col(f"{p}strike_outs"),
        "UBB": F.col(f"{p}base_on_balls") - F.col(f"{p}intentional_walks"),
        "HBP": F.col(f"{p}hit_batsmen"),
        "HR": F.col(f"{p}home_runs"),
    }
    summary, long = season.partition_profile(team_rows, PLAYER_SEASON, f"{p}batters_faced", parts, "OTHER")
    return summary.withColumn("observed_starter_share", fn.ratio(F.col(f"{p}games_started"), F.col(f"{p}games_played"))), long


def contact_counts(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Classified contacts counted by profile status and by who named the batter."""
    status = F.col("contact_profile_status")
    return contacts.groupBy(*keys).agg(
        F.count("*").alias("observed_contact_count"),
        F.count("core_bin").alias("core_contact_count"),
        F.count_if(status == "special_bunt").alias("bunt_contact_count"),
        F.count_if(status == "foul_air_excluded").alias("foul_air_excluded_count"),
        F.count_if(status.startswith("unknown")).alias("unknown_contact_count"),
        F.count_if(F.col("participant_authority") != "source_default").alias("official_overlay_contact_count"),
    )


CONTACT_COUNTS = [
    "observed_contact_count", "core_contact_count", "bunt_contact_count", "foul_air_excluded_count", "unknown_contact_count",
    "official_overlay_contact_count",
]
SUMMARY = [
    *PLAYER_GAME, "level_group", "batting_plate_appearances", "bb_hbp_count", "strikeout_count", "expected_contact_count",
    "observed_contact_count", "contact_count_residual", "core_profile_event_count", "bunt_contact_count", "foul_air_excluded_count",
    "unknown_contact_count", "special_noncontact_count", "pa_accounting_residual", "participant_authority_status",
    "source_capability_tier",
]


def authority_status() -> Column:
    """Who named the batter of a player-game's contacts: nobody needed to, the source, an official list, or both."""
    overlay, seen = F.col("official_overlay_contact_count"), F.col("observed_contact_count")
    return fn.first_case([(seen == 0, "no_contact_identity_needed"), (overlay == 0, "source_default"), (overlay == seen, "official_overlay")], "mixed_source_and_official")


def evidence_of(outcomes: DataFrame, contacts: DataFrame, status: Column, tier: str) -> tuple[DataFrame, DataFrame]:
    """(player-game summary, long profile without empty bins).

    ``outcomes``: PLAYER_GAME, batting_plate_appearances, bb_hbp_count, strikeout_count, special_noncontact_count and
    expected_contact_count. ``contacts``: the key without game_date, core_bin, contact_profile_status and
    participant_authority; contacts of player-games without an outcome are left out of both results.
    """
    keys = [k for k in PLAYER_GAME if k != "game_date"]
    counted = outcomes.withColumn("level_group", level_of()).join(contact_counts(contacts, keys), keys, "left").fillna(0, subset=CONTACT_COUNTS)
    noncontact = F.col("special_noncontact_count") + F.col("bb_hbp_count") + F.col("strikeout_count")
    summary = (
        counted.withColumn("contact_count_residual", F.col("observed_contact_count") - F.col("expected_contact_count"))
        .withColumn("core_profile_event_count", F.col("bb_hbp_count") + F.col("strikeout_count") + F.col("core_contact_count"))
        .withColumn("pa_accounting_residual", F.col("batting_plate_appearances") - F.col("expected_contact_count") - noncontact)
        .withColumn("participant_authority_status", status)
        .withColumn("source_capability_tier", F.lit(tier))
        .select(*SUMMARY)
    )
    bins = contacts.where("core_bin is not null").groupBy(*keys, "core_bin").agg(F.count("*").alias("occurrence_count"))
    of_contacts = bins.join(outcomes.select(*PLAYER_GAME).withColumn("level_group", level_of()), keys)
    long = summary.select(*PLAYER_GAME, "level_group", F.col("bb_hbp_count").alias("BB_HBP"), F.col("strikeout_count").alias("K"))
    of_outcomes = long.unpivot([*PLAYER_GAME, "level_group"], v.OUTCOME_BINS, "core_bin", "occurrence_count").where("occurrence_count > 0")
    return summary, of_outcomes.unionByName(of_contacts)


def line_evidence(lines: DataFrame, contacts: DataFrame, tier: str = "result_contact_profile") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, profile, faults) from resolved batting lines and classified contacts.

    ``lines``: game_date, game_type, game_pk, league_id, player_id, outcome_resolution and the batting_* vector. Only
    regular games with a plate appearance count; unresolved lines, incomplete vectors and leagues without a level are
    faults and take no part. Contacts expected: at bats without strikeouts, plus sacrifices.
    """
    b = {n: F.col(f"batting_{n}") for n in ("PA", "AB", "BB", "HBP", "SO", "SF", "SH", "CI")}
    played = lines.where((F.col("game_type") == "R") & (b["PA"] > 0)).withColumn("season", F.year("game_date").cast("bigint"))
    fault = fn.first_case(
        [
            (F.coalesce(F.col("outcome_resolution").startswith("unresolved"), F.lit(True)), "unresolved_outcome"),
            (fn.any_of([c.isNull() for c in b.values()]), "incomplete_vector"),
            (level_of().isNull(), "uncertified_league"),
        ]
    )
    checked = played.withColumn("fault", fault)
    outcomes = checked.where("fault is null").select(
        *PLAYER_GAME,
        b["PA"].alias("batting_plate_appearances"),
        (b["BB"] + b["HBP"]).alias("bb_hbp_count"),
        b["SO"].alias("strikeout_count"),
        b["CI"].alias("special_noncontact_count"),
        (b["AB"] - b["SO"] + b["SF"] + b["SH"]).alias("expected_contact_count"),
    )
    summary, profile = evidence_of(outcomes, contacts, authority_status(), tier)
    return summary, profile, checked.where("fault is not null").select(*PLAYER_GAME, "fault")


def game_evidence(appearances: DataFrame, status_of_batters: str = "official", tier: str = "event_contact_profile") -> tuple[DataFrame, DataFrame]:
    """(player-game summary, long profile without empty bins) from classified plate appearances.

    ``appearances``: PLAYER_GAME columns plus event_type, core_bin and is_contact; with contact_profile_status (null
    without a contact) the summary also counts bunts, foul and unknown contacts. One authority names every batter; what
    contacts are expected is what the other outcomes leave, so the accounting residual is zero here by definition.
    """
    event = F.col("event_type")
    special = event.isin(v.SPECIAL_EVENTS)
    status = F.col("contact_profile_status") if "contact_profile_status" in appearances.columns else F.lit(None).cast("string")
    summary = appearances.groupBy(*PLAYER_GAME).agg(
        F.count("*").alias("batting_plate_appearances"),
        F.count_if(event.isin(v.WALK_OR_HIT_EVENTS)).alias("bb_hbp_count"),
        F.count_if(event.isin(v.STRIKEOUT_EVENTS)).alias("strikeout_count"),
        F.count_if(special).alias("special_noncontact_count"),
        F.count_if(F.col("is_contact")).alias("observed_contact_count"),
        F.count("core_bin").alias("core_profile_event_count"),
        F.count_if(status == "special_bunt").alias("bunt_contact_count"),
        F.count_if(status == "foul_air_excluded").alias("foul_air_excluded_count"),
        F.count_if(status.startswith("unknown")).alias("unknown_contact_count"),
    )
    noncontact = F.col("bb_hbp_count") + F.col("strikeout_count") + F.col("special_noncontact_count")
    expected = F.col("batting_plate_appearances") - noncontact
    summary = (
        summary.withColumn("level_group", level_of())
        .withColumn("expected_contact_count", expected)
        .withColumn("contact_count_residual", F.col("observed_contact_count") - F.col("expected_contact_count"))
        .withColumn("pa_accounting_residual", F.col("batting_plate_appearances") - F.col("expected_contact_count") - noncontact)
        .withColumn("participant_authority_status", F.lit(status_of_batters))
        .withColumn("source_capability_tier", F.lit(tier))
        .select(*SUMMARY)
    )
    profile = appearances.where("core_bin is not null").groupBy(*PLAYER_GAME, "core_bin").agg(F.count("*").alias("occurrence_count"))
    return summary, profile
