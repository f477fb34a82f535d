"""Nested JSON documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shape of the play-by-play and season-split feed documents.
PLAY_FEED = """struct<
  gamePk: bigint,
  allPlays: array<struct<
    about: struct<atBatIndex: bigint, inning: bigint, halfInning: string>,
    result: struct<eventType: string, description: string>,
    matchup: struct<batter: struct<id: bigint>, pitcher: struct<id: bigint>, batSide: struct<code: string>>,
    playEvents: array<struct<
      pitchNumber: bigint, isPitch: boolean,
      details: struct<code: string, isInPlay: boolean>,
      hitData: struct<trajectory: string, coordinates: struct<coordX: double, coordY: double>>>>>>>"""
SPLIT_FEED = """struct<
  season: string,
  splits: array<struct<
    player: struct<id: bigint>, team: struct<id: bigint>, league: struct<id: bigint>,
    stat: map<string, string>>>>"""


def json_rows(df: DataFrame, text: Column, schema: str, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of the array at ``path`` of a JSON document, with its position."""
    parsed = df.withColumn("_doc", F.from_json(text, schema))
    return parsed.select(*keep, "_doc", F.posexplode(F.col(f"_doc.{path}")).alias("position", "item"))


def plays(documents: DataFrame, text: str = "document") -> DataFrame:
    """One row per play of a play-by-play document."""
    rows = json_rows(documents, F.col(text), PLAY_FEED, "allPlays")
    return rows.select(
        F.col("_doc.gamePk").alias("game_pk"),
        F.col("item.about.atBatIndex").alias("at_bat_index"),
        F.col("item.about.inning").alias("inning"),
        F.col("item.about.halfInning").alias("half_inning"),
        F.col("item.result.eventType").alias("result_event_type"),
        F.col("item.result.description").alias("result_description"),
        F.col("item.matchup.batter.id").alias("batter_mlbam_id"),
        F.col("item.matchup.pitcher.id").alias("pitcher_mlbam_id"),
        F.col("item.matchup.batSide.code").alias("batter_side"),
        F.col("item.playEvents").alias("play_events"),
    )


def pitches(play_rows: DataFrame) -> DataFrame:
    """One row per pitch event of each play; non-pitch events are left out."""
    events = play_rows.select("game_pk", "at_bat_index", F.explode("play_events").alias("e")).where("e.isPitch")
    return events.select(
        "game_pk",
        "at_bat_index",
        F.col("e.pitchNumber").alias("pitch_number"),
        F.col("e.details.code").alias("pitch_code"),
        F.col("e.details.isInPlay").alias("is_in_play"),
        F.col("e.hitData.trajectory").alias("bb_type"),
        F.col("e.hitData.coordinates.coordX").alias("hc_x"),
        F.col("e.hitData.coordinates.coordY").alias("hc_y"),
    )


def season_splits(documents: DataFrame, text: str, statistics: dict[str, str]) -> DataFrame:
    """One row per season split; ``statistics`` maps feed statistic -> column, missing stays null."""
    rows = json_rows(documents, F.col(text), SPLIT_FEED, "splits")
    return rows.select(
        F.col("_doc.season").try_cast("bigint").alias("season"),
        F.col("item.league.id").alias("league_id"),
        F.col("item.team.id").alias("team_id"),
        F.col("item.player.id").alias("player_id"),
        *[F.try_element_at("item.stat", F.lit(s)).try_cast("double").alias(c) for s, c in statistics.items()],
    )


# Shape of the roster document.
ROSTER_FEED = """struct<
  roster: array<struct<
    person: struct<id: bigint, fullName: string, link: string>,
    position: struct<code: string, abbreviation: string>,
    status: struct<code: string, description: string>,
    parentTeamId: bigint>>>"""


def roster_rows(documents: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per roster entry with identity and status."""
    rows = json_rows(documents, F.col(text), ROSTER_FEED, "roster", keep)
    return rows.select(
        *keep,
        F.col("item.person.id").alias("player_id"),
        F.col("item.person.fullName").alias("full_name"),
        F.col("item.person.link").alias("person_link"),
        F.col("item.position.abbreviation").alias("position_abbreviation"),
        F.col("item.status.code").alias("status_code"),
        F.col("item.parentTeamId").alias("parent_team_id"),
    )


def roster_membership(rows: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(one membership row per player, players whose identity differs between entries).

    Entries are made distinct first, so the collected status codes are bounded by the code list.
    """
    entries = rows.select(*keep, "player_id", "full_name", "person_link", "status_code").distinct()
    grouped = entries.groupBy(*keep, "player_id").agg(
        F.min(F.struct("full_name", "person_link")).alias("_lo"),
        F.max(F.struct("full_name", "person_link")).alias("_hi"),
        F.array_sort(F.collect_set("status_code")).alias("status_codes"),
    )
    same = F.col("_lo") == F.col("_hi")
    members = grouped.where(same).select(*keep, "player_id", F.col("_lo.full_name").alias("full_name"), "status_codes")
    return members, grouped.where(~same).select(*keep, "player_id")


# Feed statistic -> column of a baserunning season split.
STEAL_STATISTICS = {
    "plateAppearances": "plate_appearances",
    "hits": "hits",
    "doubles": "doubles",
    "triples": "triples",
    "homeRuns": "home_runs",
    "baseOnBalls": "walks",
    "intentionalWalks": "intentional_walks",
    "hitByPitch": "hit_by_pitch",
    "stolenBases": "stolen_bases",
    "caughtStealing": "caught_stealing",
}


def steal_stints(documents: DataFrame, text: str = "document") -> DataFrame:
    """Season splits with steal attempts and the times on first base as opportunity proxy.

    First base is reached by singles, unintentional walks and hit batters.
    """
    rows = season_splits(documents, text, STEAL_STATISTICS)
    singles = F.col("hits") - F.col("doubles") - F.col("triples") - F.col("home_runs")
    on_first = singles + F.col("walks") - F.col("intentional_walks") + F.col("hit_by_pitch")
    return rows.withColumn("attempts", F.col("stolen_bases") + F.col("caught_stealing")).withColumn("opportunity_proxy", on_first)


def pitch_recording(play_rows: DataFrame) -> DataFrame:
    """Per plate appearance: pitches recorded, the largest pitch number and the gap between them."""
    pitches_only = F.filter("play_events", lambda e: F.coalesce(e["isPitch"], F.lit(False)))
    numbers = F.transform(pitches_only, lambda e: e["pitchNumber"])
    recorded = F.size(pitches_only).cast("bigint")
    top = F.array_max(numbers)
    return play_rows.select(
        "game_pk",
        "at_bat_index",
        "result_event_type",
        recorded.alias("recorded_pitch_event_count"),
        top.alias("max_pitch_number"),
        F.greatest(top - recorded, F.lit(0)).alias("pitch_number_gap"),
    )
