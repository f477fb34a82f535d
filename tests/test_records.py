"""Feed documents written by hand: exact rows, and a fault for every malformed document or entry."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.baseball import seasons
from tallyframe.sources import records


def frame(spark, documents, keep, values):
    rows = [(*values, d if isinstance(d, (str, type(None))) else json.dumps(d)) for d in documents]
    return spark.createDataFrame(rows, f"{keep}, document string")


def fielder(player, code="10", abbreviation="DH", **stat):
    stat = {"games": 4, "gamesPlayed": "4", "gamesStarted": 3, "innings": "0.0", **stat}
    return {"person": {"id": player, "fullName": "A"}, "team": {"id": "30"}, "position": {"code": code, "abbreviation": abbreviation, "name": "x"}, "stat": stat}


def test_fielding_usage(spark):
    splits = [
        fielder(1),
        fielder(2, "6", "SS", innings="12.2"),
        fielder(3, "6", "2B"),
        fielder(4, "11", "EH"),
        fielder(5, innings="1.0"),
        fielder(6, "6", "SS", innings="1.3"),
        fielder(7, "6", "SS", innings=None),
        fielder(8, games=5),
        fielder(9, gamesStarted=5),
        fielder(10, gamesStarted="x"),
        fielder(-1),
        7,
        None,
        fielder(12),
        fielder(12),
    ]
    documents = frame(spark, [{"splits": splits}, "not json", None, {"splits": []}, {"splits": {"a": 1}}], "season bigint, league_id bigint, level_group string", (2024, 103, "MLB"))
    usage, faults = records.fielding_usage(documents, "document")
    got = sorted((r["player_id"], r["team_id"], r["position_abbreviation"], r["games_played"], r["games_started"], r["fielding_outs"]) for r in usage.collect())
    assert got == [(1, 30, "DH", 4, 3, 0), (2, 30, "SS", 4, 3, 38)]
    placed = {r["position"]: r["fault"] for r in faults.collect() if r["position"] is not None}
    assert placed == {
        2: "position_code_mismatch",
        3: "unknown_position_code",
        4: "designated_hitter_with_outs",
        5: "invalid_innings",
        6: "invalid_innings",
        7: "games_differ",
        8: "more_starts_than_games",
        9: "invalid_games",
        10: "invalid_player_id",
        11: "invalid_player_id",
        12: "invalid_player_id",
        13: "repeated_grain",
        14: "repeated_grain",
    }
    assert faults.where("position is null and fault = 'unreadable_document'").count() == 3


def test_boxscore(spark):
    def player(number, **batting):
        return {"person": {"id": number, "fullName": f"P{number}"}, "position": {"abbreviation": "C"}, "battingOrder": "100", "stats": {"batting": batting}}

    away = {"ID5": player(5, hits=2, plateAppearances=4), "ID6": player(7, hits=1), "ID8": player(8), "ID9": player(9, hits="many"), "ID10": 3}
    document = {"teams": {"away": {"players": away, "teamStats": {"batting": {"hits": 3, "plateAppearances": 4}}}, "home": {"players": {}}}}
    documents = frame(spark, [document, "[]"], "game_pk bigint", (1,))
    lines, faults = records.boxscore_players(documents, "document")
    row = lines.first()
    assert lines.count() == 1
    assert (row["batting_side"], row["player_id"], row["batting_order"], row["hits"], row["plate_appearances"], row["doubles"]) == ("away", 5, 100, 2, 4, None)
    assert sorted((r["player_key"] or "", r["fault"]) for r in faults.collect()) == [
        ("", "unreadable_document"),
        ("", "unreadable_document"),
        ("ID10", "invalid_player_id"),
        ("ID6", "player_key_mismatch"),
        ("ID9", "invalid_statistic"),
    ]
    gaps = records.boxscore_gaps(lines, records.boxscore_teams(documents, "document"))
    assert [(r["statistic"], r["stated"], r["summed"]) for r in gaps.collect()] == [("hits", 3, 2)]


def test_play_sequences_and_authority(spark):
    def play(index, batter, kind="single", pitches=2):
        return {"atBatIndex": index, "result": {"eventType": kind}, "matchup": {"batter": {"id": batter}}, "playEvents": [{"isPitch": True}] * pitches + [{"isPitch": False}, {}]}

    swapped = dict(reversed(play(0, 5).items()))
    plays = [play(0, 5), swapped, play(1, 5), play(1, 6), play(2, None), play(3, 5, "wild_pitch", 0), play(4, 5, "made_up"), play(5, 5, " "), play(None, 5), "text"]
    sequences, faults = records.play_sequences(frame(spark, [{"allPlays": plays}], "game_pk bigint", (9,)), "document", {"single": True, "wild_pitch": False})
    got = sorted((r["at_bat_index"], r["batter_mlbam_id"] or 0, r["classification_status"], r["official_physical_pitch_count"], r["duplicate_row_count"]) for r in sequences.collect())
    assert got == [
        (0, 5, "official_true_pa", 2, 2),
        (1, 5, "official_true_pa", 2, 1),
        (1, 6, "official_true_pa", 2, 1),
        (2, 0, "official_true_pa", 2, 1),
        (3, 5, "official_non_pa", 0, 1),
    ]
    assert sorted((r["position"], r["fault"]) for r in faults.collect()) == [
        (6, "unknown_event_type"),
        (7, "blank_event_type"),
        (8, "missing_at_bat_index"),
        (9, "missing_at_bat_index"),
    ]
    named, several = records.participant_authority(sequences)
    assert sorted((r["at_bat_index"], r["official_batter_id"]) for r in named.collect()) == [(0, 5), (3, 5)]
    assert [tuple(r) for r in several.collect()] == [(9, 1)]


def test_hitting_game_log(spark):
    def split(game, team, date="2024-05-01", sport=1, **missing):
        stat = {**dict.fromkeys(records.OUTCOME_STATISTICS, 1), **missing}
        return {"date": date, "gameType": "R", "game": game, "league": {"id": 103}, "team": {"id": team}, "sport": {"id": sport}, "stat": stat}

    splits = [
        split({"gamePk": 1}, 10),
        split({"pk": 2}, 10),
        split({"id": "2"}, 11),
        split({"gamePk": 3}, 10),
        split({"gamePk": 3}, 10),
        split({"gamePk": 4}, 10),
        split({"gamePk": 4}, 11, date="2024-05-02"),
        split({"gamePk": 5}, 10),
        split({"gamePk": 5}, 11, atBats=None),
        split({}, 10),
        split({"gamePk": 6}, 10, sport=11),
        split({"gamePk": 7}, 10, sport=None, atBats=None),
    ]
    documents = frame(spark, [{"stats": [{"splits": splits[:6]}, {}, {"splits": splits[6:]}]}, "{"], "player_id bigint, sport_id bigint", (5, 1))
    games, faults = records.hitting_game_log(documents, "document")
    got = sorted((r["game_id"], r["team_id"], r["batting_PA"], r["batting_AB"]) for r in games.collect())
    assert got == [(1, 10, 1, 1), (2, None, 2, 2), (7, 10, 1, None)]
    assert sorted((-1 if r["position"] is None else r["position"], r["fault"]) for r in faults.collect()) == [
        (-1, "unreadable_document"),
        (3, "ambiguous_team_splits"),
        (5, "ambiguous_team_splits"),
        (7, "ambiguous_team_splits"),
        (9, "missing_game"),
        (10, "other_sport"),
    ]


def test_game_leagues(spark):
    def game(kind="R", date="2024-05-01", away=(1, 103, 1), home=(2, 103, 1)):
        teams = {s: {"id": t[0], "league": {"id": t[1]}, "sport": {"id": t[2]}} for s, t in (("away", away), ("home", home))}
        return {"gameData": {"game": {"type": kind}, "datetime": {"officialDate": date}, "teams": teams}}

    documents = [game(), game("S"), game(date=None), game(home=(None, 103, 1)), game(home=(2, 104, 1)), game(away=(1, 103, None)), {}, None]
    games, faults = records.game_leagues(frame(spark, documents, "game_pk bigint", (1,)), "document")
    assert [(str(r["game_date"]), r["league_id"], r["sport_id"], r["away_team_id"], r["home_team_id"]) for r in games.collect()] == [("2024-05-01", 103, 1, 1, 2)]
    assert [r["fault"] for r in faults.collect()] == [
        "not_regular_season", "missing_official_date", "missing_team", "ambiguous_league", "ambiguous_sport", "unreadable_document", "unreadable_document",
    ]


def test_line_evidence(spark):
    vector = "batting_PA bigint, batting_AB bigint, batting_BB bigint, batting_HBP bigint, batting_SO bigint, batting_SF bigint, batting_SH bigint, batting_CI bigint"
    lines = [
        ("2024-05-01", "R", 1, 103, 7, "resolved", 6, 4, 1, 0, 1, 1, 0, 0),
        ("2024-05-01", "R", 2, 103, 7, "resolved", 1, 0, 1, 0, 0, 0, 0, 0),
        ("2024-05-01", "R", 3, 103, 7, "unresolved_x", 1, 1, 0, 0, 0, 0, 0, 0),
        ("2024-05-01", "R", 4, 103, 7, "resolved", 1, None, 0, 0, 0, 0, 0, 0),
        ("2024-05-01", "R", 5, 1, 7, "resolved", 1, 1, 0, 0, 0, 0, 0, 0),
        ("2024-05-01", "S", 6, 103, 7, "resolved", 1, 1, 0, 0, 0, 0, 0, 0),
    ]
    frame_ = spark.createDataFrame(lines, f"game_date string, game_type string, game_pk bigint, league_id bigint, player_id bigint, outcome_resolution string, {vector}")
    contacts = [("PULL_LD", "core_contact", "source_default"), (None, "special_bunt", "official_exception_overlay"), (None, "foul_air_excluded", "source_default"), (None, "unknown_missing_direction", "source_default")]
    contacts = spark.createDataFrame([(2024, 1, 103, 7, *c) for c in contacts], "season bigint, game_pk bigint, league_id bigint, player_id bigint, core_bin string, contact_profile_status string, participant_authority string")
    summary, profile, faults = seasons.line_evidence(frame_.withColumn("game_date", F.to_date("game_date")), contacts)
    rows = {r["game_pk"]: r for r in summary.collect()}
    assert set(rows) == {1, 2}
    first = rows[1]
    assert (first["expected_contact_count"], first["observed_contact_count"], first["contact_count_residual"], first["core_profile_event_count"]) == (4, 4, 0, 3)
    assert (first["bunt_contact_count"], first["foul_air_excluded_count"], first["unknown_contact_count"], first["pa_accounting_residual"]) == (1, 1, 1, 0)
    assert first["participant_authority_status"] == "mixed_source_and_official" and rows[2]["participant_authority_status"] == "no_contact_identity_needed"
    assert sorted((r["game_pk"], r["core_bin"], r["occurrence_count"]) for r in profile.collect()) == [(1, "BB_HBP", 1), (1, "K", 1), (1, "PULL_LD", 1), (2, "BB_HBP", 1)]
    assert sorted((r["game_pk"], r["fault"]) for r in faults.collect()) == [(3, "unresolved_outcome"), (4, "incomplete_vector"), (5, "uncertified_league")]


@pytest.mark.parametrize("adapter", ["fielding_usage", "boxscore_players", "play_sequences", "game_leagues", "hitting_game_log"])
def test_texts_are_parsed_once(spark, adapter):
    # A condition on a parsed field must not parse the text again for each of its rules.
    keys = {"fielding_usage": ["season", "league_id", "level_group"], "hitting_game_log": ["player_id", "sport_id"]}.get(adapter, ["game_pk"])
    documents = spark.createDataFrame([("{}",)], "document string").select(*[F.lit(1).cast("bigint").alias(k) for k in keys], "document")
    more = [{"single": True}] if adapter == "play_sequences" else []
    for frame in getattr(records, adapter)(documents, "document", *more):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        passes = plan.count("LogicalRDD")
        assert passes and plan.count("from_json") <= 2 * passes


def test_box_lines_and_game_rows_carry_faults_in_one_reading(spark):
    box = '{"teams": {"away": {"players": {"ID1": {"person": {"id": 1}, "stats": {"batting": {"hits": 2}}}, "ID2": {"person": {"id": 3}}}}}}'
    lines = records.boxscore_lines(spark.createDataFrame([(7, box)], "game_pk bigint, document string"), "document")
    got = {(r["batting_side"], r["player_key"], r["hits"], r["fault"]) for r in lines.collect()}
    assert got == {("away", "ID1", 2, None), ("away", "ID2", None, "player_key_mismatch"), ("home", None, None, "unreadable_document")}
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    # Two documents of one player with the same fault at the same place stay two faults.
    log = spark.createDataFrame([(1, 1, '{"stats": [{"splits": [{"game": {}}]}]}')] * 2, "player_id bigint, sport_id bigint, document string")
    assert [r["fault"] for r in records.game_log_rows(log, "document").collect()] == ["missing_game"] * 2
