"""The baseball configuration on small hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.baseball import canonical, events, innings, seasons
from tallyframe.baseball import vocabulary as v
from tallyframe.sources import feeds

TRANSITION = (
    "game_pk bigint, inning bigint, half_inning string, at_bat_index bigint, transition_index bigint, start_outs bigint, end_outs bigint, "
    "start_bases_code bigint, end_bases_code bigint, runs_scored bigint, start_bat_score bigint, end_bat_score bigint, "
    "re24_state_event_candidate boolean, quality_flags_json string"
)


def half(game, inning, steps):
    """steps: (outs made, bases after, runs)."""
    rows, outs, bases, score = [], 0, 0, 0
    for i, (made, after, runs) in enumerate(steps):
        end = outs + made
        after = 0 if end == 3 else after
        rows.append((game, inning, "top", i, 0, outs, end, bases, after, runs, score, score + runs, True, "[]"))
        outs, bases, score = end, after, score + runs
    return rows


@pytest.fixture(scope="module")
def transitions(spark):
    data = half(1, 1, [(0, 1, 0), (1, 1, 0), (0, 0, 2), (1, 0, 0), (1, 0, 0)]) + half(1, 2, [(1, 0, 0), (1, 0, 0), (1, 0, 0)]) + half(2, 9, [(0, 1, 0), (0, 0, 2)])
    return spark.createDataFrame(data, TRANSITION)


def test_only_three_out_halves_estimate(transitions):
    matrix = {(r["start_outs"], r["start_bases_code"]): r for r in innings.run_expectancy(transitions).collect()}
    assert matrix[(0, 0)]["run_expectancy"] == 1.0  # 2 and 0 runs; the walk-off half is left out
    assert matrix[(0, 0)]["state_sample_size"] == 2
    assert matrix[(0, 1)]["run_expectancy"] == 2.0
    assert matrix[(1, 0)]["run_expectancy"] == 0.0
    assert (2, 1) not in matrix


def test_values_telescope_and_the_last_one_has_nothing_after_it(transitions):
    matrix = innings.run_expectancy(transitions)
    valued = innings.contextual_runs(transitions, matrix)
    totals = valued.groupBy(*innings.HALF).agg(F.sum("re24").alias("v"), F.sum("runs_scored").alias("r"), F.count_if("is_half_terminal_transition").alias("n"))
    for r in totals.collect():
        assert r["n"] == 1
        assert r["v"] == pytest.approx(r["r"] - 1.0)
    walkoff = valued.where("game_pk = 2 and is_half_terminal_transition").first()
    assert walkoff["run_expectancy_after"] == 0.0 and walkoff["re24"] == pytest.approx(2 + 0 - 2)


def test_missing_state_is_null_not_dropped(transitions):
    matrix = innings.run_expectancy(transitions).where("not (start_outs = 0 and start_bases_code = 1)")
    valued = innings.contextual_runs(transitions, matrix)
    assert valued.count() == transitions.count()
    assert valued.where("not re24_available").count() == 4
    assert innings.missing_base_out_states(matrix).count() == 24 - matrix.count()


def test_environment_groups(transitions):
    grouped = innings.run_expectancy(transitions.withColumn("env", F.col("inning")), ["env"])
    assert {(r["env"], r["start_outs"]): r["run_expectancy"] for r in grouped.where("start_bases_code = 0").collect()}[(1, 0)] == 2.0


def test_state_faults(transitions):
    assert innings.state_faults(transitions).count() == 0
    bad = transitions.withColumn("end_bases_code", F.when(F.col("end_outs") == 3, 1).otherwise(F.col("end_bases_code")))
    assert [r["rule"] for r in innings.state_faults(bad).collect()] == ["bases_empty_after_three_outs"]


def test_replay_rebuilds_states(spark, transitions):
    deltas = transitions.select(
        *innings.HALF, *innings.ORDER, (F.col("end_outs") - F.col("start_outs")).alias("outs_made"), F.col("end_bases_code").alias("bases_after"), "runs_scored"
    )
    columns = [*innings.HALF, "at_bat_index", "start_outs", "end_outs", "start_bases_code", "end_bases_code", "start_bat_score", "end_bat_score", "quality_flags_json"]
    replayed = innings.replay(deltas)
    assert sorted(map(tuple, replayed.select(*columns).collect())) == sorted(map(tuple, transitions.select(*columns).collect()))
    extra = deltas.unionByName(deltas.where("game_pk = 1 and inning = 2 and at_bat_index = 0").withColumn("at_bat_index", F.lit(9).cast("bigint")))
    flagged = innings.replay(extra).where("not re24_state_event_candidate").collect()
    assert [json.loads(r["quality_flags_json"]) for r in flagged] == [["event_after_third_out", "more_than_three_outs"]]


CONTACT = "season bigint, league_id bigint, batter_mlbam_id bigint, participant_authority string, result_description_authority string, batter_side string, bb_type string, hc_x double, hc_y double, result_description string"


def contact(bb_type, x, text, side="R", batter=7, authority="source_default"):
    return (2024, 112, batter, authority, "source_certified_mirror", side, bb_type, x, 98.27, text)


def test_contact_status_ladder(spark):
    data = [
        contact("popup", None, "pops out"),
        contact("popup", None, "pops out in foul territory"),
        contact("popup", None, " "),
        contact("ground_ball", 125.42, None),
        contact("line_drive", None, "lines out"),
        contact("fly_ball", 0.0, "flies out"),
        contact("bunt_popup", 125.42, "bunt"),
        contact(None, 125.42, "x"),
    ]
    got = events.classify_contacts(spark.createDataFrame(data, CONTACT)).select("contact_profile_status", "core_bin", "is_foul_air_out").collect()
    assert [tuple(r) for r in got] == [
        ("core_contact", "IFFB", False),
        ("foul_air_excluded", None, True),
        ("unknown_missing_foul_narrative", None, None),
        ("core_contact", "CENTER_GB", False),
        ("unknown_missing_direction", None, False),
        ("core_contact", "PULL_OFFB", False),
        ("special_bunt", None, False),
        ("unknown_missing_trajectory", None, False),
    ]


def test_plate_appearance_statuses(spark):
    sequences = [
        (1, i, "official_true_pa", e, "text", "R", 5, 6)
        for i, e in enumerate(["walk", "strikeout", "single", "single", "single", "field_out", "catcher_interf", "walk"])
    ] + [(1, 99, "official_non_pa", "wild_pitch", None, "R", 5, 6)]
    pitches = [
        (1, 2, 1, True, "ground_ball", 125.42, 98.27),
        (1, 3, 1, True, "ground_ball", 125.42, 98.27),
        (1, 3, 2, True, "ground_ball", 125.42, 98.27),
        (1, 4, 1, None, None, None, None),
        (1, 7, 1, True, "fly_ball", 1.0, 1.0),
    ]
    s = spark.createDataFrame(
        sequences, "game_pk bigint, at_bat_index bigint, classification_status string, result_event_type string, result_description string, batter_side string, batter_mlbam_id bigint, pitcher_mlbam_id bigint"
    )
    p = spark.createDataFrame(pitches, "game_pk bigint, at_bat_index bigint, pitch_number bigint, is_in_play boolean, bb_type string, hc_x double, hc_y double")
    got = {r["at_bat_index"]: (r["evidence_status"], r["core_bin"]) for r in events.classify_plate_appearances(s, p).collect()}
    assert got == {
        0: ("complete_non_bip", "BB_HBP"),
        1: ("complete_non_bip", "K"),
        2: ("complete_bip", "CENTER_GB"),
        3: ("multiple_in_play_pitches", None),
        4: ("conflicted_in_play_flag", None),
        5: ("missing_in_play_pitch", None),
        6: ("special_non_bip", None),
        7: ("unexpected_in_play_non_bip", None),
    }


@pytest.mark.parametrize(
    ("text", "group", "status"),
    [
        ("Smith homers (3) on a fly ball", "HR", "supported_narrative_fallback"),
        ("Smith hits a sacrifice fly, flies out to left", None, "ambiguous_narrative_groups"),
        ("Smith reaches on a fielder's choice out, short to second", "OUT", "supported_narrative_fallback"),
        ("Smith reaches on a throwing error by short", "ROE", "supported_narrative_fallback"),
        ("Smith bunt singles", None, "unsupported_bunt"),
        ("fan interference, Smith doubles", None, "unsupported_special_result"),
        ("Smith walks", None, "unsupported_narrative_result"),
        ("", None, "unsupported_blank_description"),
    ],
)
def test_narratives(spark, text, group, status):
    row = events.with_narrative_group(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row["terminal_outcome_group"], row["terminal_outcome_status"]) == (group, status)


def direct(spark, rows):
    return spark.createDataFrame(rows, "season bigint, league_id bigint, core_bin string, occurrence_count bigint, mean_value double")


def test_certified_bin_values(spark):
    rows = [
        (2024, 112, "K", 10, -0.30),
        (2024, 117, "K", 40, -0.25),
        (2024, 109, "K", 5, -0.20),
        (2024, 116, "K", 5, -0.10),
        (2023, 117, "K", 90, 9.0),
        (2024, 999, "K", 5, -0.5),
    ]
    got = {(r["season"], r["league_id"]): r for r in seasons.certified_bin_values(direct(spark, rows)).collect()}
    pooled = got[(2024, 112)]
    assert pooled["estimated_mean"] == pytest.approx((-0.30 * 10 - 0.25 * 25) / 35)
    assert (pooled["estimator_method"], pooled["prior_environment_count"], pooled["prior_occurrence_count"]) == ("pooled_with_peers", 1, 40)
    assert (got[(2024, 109)]["estimator_method"], got[(2024, 109)]["estimator_certified"]) == ("direct_missing_peers", False)
    assert (got[(2024, 116)]["estimator_method"], got[(2024, 116)]["estimator_certified"]) == ("direct_by_policy", True)
    assert got[(2023, 117)]["estimated_mean"] == 9.0
    assert got[(2024, 999)]["estimator_certified"] is False


def test_batting_performance(spark):
    team = spark.createDataFrame(
        [(2024, 112, 1, 7, 6, 1, 0, 2, 3), (2024, 112, 2, 7, 4, 0, 1, 1, 2), (2024, 117, 3, 8, 2, 0, 0, 2, 0)],
        "season bigint, league_id bigint, team_id bigint, player_id bigint, batting_plate_appearances bigint, batting_base_on_balls bigint, batting_hit_by_pitch bigint, batting_strike_outs bigint, batting_balls_in_play bigint",
    )
    contacts = events.classify_contacts(
        spark.createDataFrame(
            [contact("ground_ball", 125.42, None)] * 3 + [contact("bunt_grounder", 1.0, None, authority="official_exception_overlay")] + [contact("popup", None, "x", batter=99)], CONTACT
        )
    )
    values = seasons.certified_bin_values(direct(spark, [(2024, 112, "BB_HBP", 10, 0.3), (2024, 117, "BB_HBP", 10, 0.3), (2024, 112, "K", 9, -0.25), (2024, 117, "K", 9, -0.25)]))
    summary, profile, orphans = seasons.batting_performance(team, contacts, values)
    row = {r["player_id"]: r for r in summary.collect()}[7]
    assert (row["batting_plate_appearances"], row["bb_hbp_count"], row["strikeout_count"], row["contact_event_count"]) == (10, 2, 3, 4)
    assert (row["core_contact_count"], row["bunt_contact_count"], row["official_overlay_contact_count"]) == (3, 1, 1)
    assert (row["profile_event_count"], row["valued_event_count"], row["unvalued_event_count"]) == (8, 5, 3)
    assert row["expected_value_total"] == pytest.approx(2 * 0.3 - 3 * 0.25)
    assert row["contact_count_residual_vs_aggregate"] == -1 and row["has_uncertified_value"]
    assert sorted((r["core_bin"], r["occurrence_count"]) for r in profile.where("player_id = 7").collect()) == [("BB_HBP", 2), ("CENTER_GB", 3), ("K", 3)]
    assert [r["player_id"] for r in orphans.collect()] == [99]


def test_pitching_performance(spark):
    names = ["batters_faced", "strike_outs", "base_on_balls", "intentional_walks", "hit_batsmen", "home_runs", "games_played", "games_started"]
    schema = "season bigint, league_id bigint, player_id bigint, " + ", ".join(f"pitching_{n} bigint" for n in names)
    team = spark.createDataFrame([(2024, 112, 1, 20, 5, 3, 1, 1, 1, 2, 1), (2024, 112, 1, 10, 2, 0, 0, 0, 0, 2, 1), (2024, 112, 2, 0, 0, 0, 0, 0, 0, 1, 0)], schema)
    summary, profile = seasons.pitching_performance(team)
    assert summary.count() == 1 and summary.first()["observed_starter_share"] == 0.5
    assert {r["category"]: r["occurrence_count"] for r in profile.collect()} == {"K": 7, "UBB": 2, "HBP": 1, "HR": 1, "OTHER": 19}
    assert profile.agg(F.sum("probability")).first()[0] == pytest.approx(1.0)


def test_game_evidence(spark):
    data = [("walk", "BB_HBP", False), ("single", "PULL_LD", True), ("strikeout", "K", False), ("catcher_interf", None, True), ("field_out", None, False)]
    df = spark.createDataFrame([(2024, "2024-05-01", 1, 103, 7, *r) for r in data], "season bigint, game_date string, game_pk bigint, league_id bigint, player_id bigint, event_type string, core_bin string, is_contact boolean")
    summary, profile = seasons.game_evidence(df)
    row = summary.first()
    assert (row["batting_plate_appearances"], row["expected_contact_count"], row["observed_contact_count"], row["core_profile_event_count"]) == (5, 2, 2, 3)
    assert row["level_group"] == "MLB" and profile.count() == 3


def test_feeds(spark):
    play = {
        "about": {"atBatIndex": 4, "inning": 2, "halfInning": "top"},
        "result": {"eventType": "single", "description": "Singles"},
        "matchup": {"batter": {"id": 9}, "pitcher": {"id": 8}, "batSide": {"code": "L"}},
        "playEvents": [
            {"pitchNumber": 1, "isPitch": True, "details": {"code": "B", "isInPlay": False}},
            {"isPitch": False},
            {"pitchNumber": 3, "isPitch": True, "details": {"code": "X", "isInPlay": True}, "hitData": {"trajectory": "line_drive", "coordinates": {"coordX": 1.5, "coordY": 2.5}}},
        ],
    }
    documents = spark.createDataFrame([(json.dumps({"gamePk": 77, "allPlays": [play]}),)], "document string")
    plays = feeds.plays(documents)
    assert tuple(plays.first())[:9] == (77, 4, 2, "top", "single", "Singles", 9, 8, "L")
    assert [tuple(r) for r in feeds.pitches(plays).collect()] == [(77, 4, 1, "B", False, None, None, None), (77, 4, 3, "X", True, "line_drive", 1.5, 2.5)]
    assert feeds.pitch_recording(plays).first()["pitch_number_gap"] == 1

    stat = {"plateAppearances": "100", "hits": "30", "doubles": "5", "triples": "1", "homeRuns": "4", "baseOnBalls": "10", "intentionalWalks": "2", "hitByPitch": "1", "stolenBases": "6", "caughtStealing": "2"}
    doc = {"season": "2024", "splits": [{"player": {"id": 5}, "league": {"id": 112}, "stat": stat}]}
    stint = feeds.steal_stints(spark.createDataFrame([(json.dumps(doc),)], "document string")).first()
    assert (stint["season"], stint["attempts"], stint["opportunity_proxy"]) == (2024, 8.0, 20 + 10 - 2 + 1)

    roster = {"roster": [{"person": {"id": 1, "fullName": "A"}, "status": {"code": "A"}}, {"person": {"id": 1, "fullName": "A"}, "status": {"code": "D"}}, {"person": {"id": 2, "fullName": "B"}}, {"person": {"id": 2, "fullName": "C"}}]}
    rows = feeds.roster_rows(spark.createDataFrame([(30, json.dumps(roster))], "team int, document string"), "document", ("team",))
    members, ambiguous = feeds.roster_membership(rows, ("team",))
    assert [tuple(r) for r in members.collect()] == [(30, 1, "A", ["A", "D"])]
    assert [tuple(r) for r in ambiguous.collect()] == [(30, 2)]


def test_canonical_rules(spark):
    digest = "a" * 64
    data = [(digest, digest, 1, 0, digest, 1, "official_true_pa", True), (digest, digest, 1, 1, digest, 0, "official_non_pa", None), ("x", digest, 1, 2, digest, 1, "unclassified_source_sequence", None)]
    df = spark.createDataFrame(
        data, "normalization_id string, source_snapshot_id string, game_pk bigint, at_bat_index bigint, payload_hash string, duplicate_row_count bigint, classification_status string, is_plate_appearance boolean"
    )
    found = {r["rule"]: r["violation_count"] for r in canonical.violations(df.unionByName(df.limit(1)), "play_sequence").collect()}
    assert found == {"normalization_id": 1, "duplicate_row_count": 1, "flag_agrees_with_status": 1, "unique_key": 1}


def test_vocabulary_is_closed():
    assert len(v.PROFILE_BINS) == 12 and set(v.CONTACT_RESULT_GROUP.values()) == set(v.CONTACT_RESULT_VALUE)
    assert set(v.LEAGUE_LEVEL.values()) == set(v.LEVEL_ORDER) == set(v.LEVEL_POOLING_STRENGTH)
    assert set(v.HIT_EVENTS + v.WALK_OR_HIT_EVENTS + v.STRIKEOUT_EVENTS + v.SPECIAL_EVENTS) <= set(v.PLATE_APPEARANCE_EVENTS)


def test_game_scores_carry_across_halves(spark):
    """Both reset levels against a plain loop: long games, many slices, two games, halves in play order."""
    draw = random.Random(21)
    rows, want = [], {}
    for game in (1, 2, None):
        score, bat = {"top": 0, "bottom": 0}, 0
        for inning in range(1, 8):
            for half in ("top", "bottom"):
                outs = own = bases = 0
                for _ in range(draw.randrange(1, 160)):
                    made, after, runs = draw.choice([0, 0, 0, 1]), draw.randrange(8), draw.choice([0, 0, 1, 2])
                    rows.append((game, inning, half, bat, 0, made, after, runs))
                    want[(game, bat)] = (outs, bases, own, score["top"], score["bottom"], score[half], score[half] + runs)
                    outs, bases, own, bat = outs + made, after, own + runs, bat + 1
                    score[half] += runs
    draw.shuffle(rows)
    deltas = spark.createDataFrame(rows, "game_pk bigint, inning bigint, half_inning string, at_bat_index bigint, transition_index bigint, outs_made bigint, bases_after bigint, runs_scored bigint")
    names = ["start_outs", "start_bases_code", "start_bat_score", "start_away_score", "start_home_score", "start_game_score", "end_game_score"]
    got = {(r["game_pk"], r["at_bat_index"]): tuple(r[n] for n in names) for r in innings.replay(deltas).collect()}
    assert got == want
