"""Run expectancy over base/out states of half-innings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import bit_code
from tallyframe.operators import checks, scan

HALF = ["game_pk", "inning", "half_inning"]
ORDER = ["at_bat_index", "transition_index"]
STATE = ["start_outs", "start_bases_code"]


def state_faults(transitions: DataFrame) -> DataFrame:
    """Counts of state rows outside the rules: bounds, bases left after three outs, replay flags."""
    candidates = transitions.where("re24_state_event_candidate")
    rules = {
        "start_state": F.col("start_outs").between(0, 2) & F.col("start_bases_code").between(0, 7),
        "end_state": F.col("end_outs").between(0, 3) & F.col("end_bases_code").between(0, 7),
        "bases_empty_after_three_outs": (F.col("end_outs") < 3) | (F.col("end_bases_code") == 0),
        "no_replay_flags": F.col("quality_flags_json") == "[]",
    }
    return checks.rule_violations(candidates, rules).where("violation_count > 0")


def half_boundaries(transitions: DataFrame) -> DataFrame:
    """Mark each half-inning's last transition, its final score and whether it reached three outs."""
    clean = transitions.where("re24_state_event_candidate")
    place = F.struct(*ORDER)
    ends = clean.groupBy(*HALF).agg(
        F.max_by(F.struct(place.alias("place"), "end_outs", "end_bat_score"), place).alias("_end"), F.count("*").alias("half_transition_count")
    )
    return (
        clean.join(ends, HALF)
        .withColumn("half_final_bat_score", F.col("_end.end_bat_score"))
        .withColumn("half_completed_three_outs", F.col("_end.end_outs") == 3)
        .withColumn("is_half_terminal_transition", place == F.col("_end.place"))
        .drop("_end")
    )


def run_expectancy(transitions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean runs still to come in each observed base/out state, over halves that reached three outs."""
    done = half_boundaries(transitions).where("half_completed_three_outs")
    rest = (F.col("half_final_bat_score") - F.col("start_bat_score")).alias("_rest")
    per_game = done.select(*groups, *STATE, "game_pk", rest).groupBy(*groups, *STATE, "game_pk").agg(F.sum("_rest").alias("_s"), F.count("*").alias("_n"))
    return per_game.groupBy(*groups, *STATE).agg(
        (F.sum("_s") / F.sum("_n")).alias("run_expectancy"), F.sum("_n").alias("state_sample_size"), F.count("*").alias("state_game_count")
    )


def contextual_runs(transitions: DataFrame, matrix: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``runs + E[after] - E[before]`` per transition; nothing follows the last one of a half.

    Halves that ended early are valued too. A state the matrix lacks leaves the value null.
    """
    before = matrix.select(*groups, *STATE, F.col("run_expectancy").alias("run_expectancy_before"))
    after = matrix.select(
        *groups, F.col("start_outs").alias("end_outs"), F.col("start_bases_code").alias("end_bases_code"), F.col("run_expectancy").alias("_after")
    )
    joined = half_boundaries(transitions).join(before, [*groups, *STATE], "left").join(after, [*groups, "end_outs", "end_bases_code"], "left")
    follows = F.when(F.col("is_half_terminal_transition"), F.lit(0.0)).otherwise(F.col("_after"))
    valued = joined.withColumn("run_expectancy_after", follows).drop("_after")
    return valued.withColumn("re24", F.col("runs_scored") + F.col("run_expectancy_after") - F.col("run_expectancy_before")).withColumn(
        "re24_available", F.col("re24").isNotNull()
    )


def missing_base_out_states(matrix: DataFrame) -> DataFrame:
    """Base/out states, out of the 24, that the matrix does not hold."""
    spark = matrix.sparkSession
    states = spark.range(24).select((F.col("id") % 3).alias("start_outs"), F.floor(F.col("id") / 3).alias("start_bases_code"))
    return states.join(matrix, STATE, "left_anti")


def bases_code(first: Column, second: Column, third: Column) -> Column:
    """1 for first, 2 for second and 4 for third base, added up over the occupied ones."""
    return bit_code(first.isNotNull(), second.isNotNull(), third.isNotNull())


def replay(deltas: DataFrame) -> DataFrame:
    """State before and after each event from per-event changes.

    Input: HALF, ORDER, outs_made, bases_after (code after the event) and runs_scored. One scan has two
    reset levels: outs, bases and the half's own score start again with each half, both teams' scores
    with each game. ``start_game_score`` and ``end_game_score`` are those of the side at bat, the
    visitors in the top of an inning.
    """
    visitors = F.lower("half_inning") == "top"
    placed = scan.ordered(
        deltas,
        HALF,
        ORDER,
        F.floor(F.col("at_bat_index") / 256),
        before={"start_outs": ("sum", F.col("outs_made")), "start_bat_score": ("sum", F.col("runs_scored"))},
        prior={"start_bases_code": F.col("bases_after")},
        outer=["game_pk"],
        outer_before={
            "start_away_score": ("sum", F.when(visitors, F.col("runs_scored")).otherwise(0)),
            "start_home_score": ("sum", F.when(visitors, 0).otherwise(F.col("runs_scored"))),
        },
    )
    own = F.when(visitors, F.col("start_away_score")).otherwise(F.col("start_home_score"))
    placed = placed.withColumn("start_game_score", own).withColumn("end_game_score", own + F.col("runs_scored"))
    rows = placed.fillna(0, subset=["start_bases_code"])
    end_outs = F.col("start_outs") + F.col("outs_made")
    flags = F.array_compact(
        F.array(F.when(F.col("start_outs") > 2, F.lit("event_after_third_out")), F.when(end_outs > 3, F.lit("more_than_three_outs")))
    )
    return (
        rows.withColumn("end_outs", end_outs)
        .withColumn("end_bases_code", F.when(end_outs >= 3, F.lit(0)).otherwise(F.col("bases_after")))
        .withColumn("end_bat_score", F.col("start_bat_score") + F.col("runs_scored"))
        .withColumn("quality_flags_json", F.to_json(flags))
        .withColumn("re24_state_event_candidate", F.size(flags) == 0)
    )
