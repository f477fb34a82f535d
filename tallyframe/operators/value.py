"""Additive entity value: references, run components, centering, replacement, ranks, spread."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import lookup, profile, scan

# Published positional schedules in runs per full season, and their season lengths.
POSITION_RUNS_PER_162 = {"C": 12.5, "1B": -12.5, "2B": 2.5, "3B": 2.5, "SS": 7.5, "LF": -7.5, "CF": 2.5, "RF": -7.5, "DH": -17.5}
POSITION_RUNS_PER_150 = {"C": 9.0, "1B": -9.5, "2B": 3.0, "3B": 2.0, "SS": 7.0, "LF": -7.0, "CF": 2.5, "RF": -7.0, "DH": -15.0}
FULL_SEASON_OUTS_162, FULL_SEASON_DH_162 = 1458.0 * 3.0, 162.0
FULL_SEASON_OUTS_150, FULL_SEASON_DH_150 = 1350.0 * 3.0, 150.0
# Replacement pool, season length, steal values and the win-exponent power.
WAR_POOL, WAR_POOL_SENSITIVITY, FULL_SEASON_GAMES = 570.0, 590.0, 2430.0
STOLEN_BASE_RUNS, CAUGHT_EXTRA_OUT = 0.2, 0.075
WIN_EXPONENT_POWER = 0.285
# Residual variance of the skill models by family.
RANGE_MSE = {"T1": 0.878640460280284, "U1": 0.8900360540992999, "B0": 0.9304792055721907}


# --- references --------------------------------------------------------------------------------


def mix_reference(counts: DataFrame, values: DataFrame, environment: str, category: str, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pooled share and value per category, one-row reference) over all environments.

    ``counts``: environment, category, occurrence_count; ``values``: environment, category,
    estimated_mean; ``declared``: a one-row frame with the declared total.
    """
    joined = counts.join(values, [environment, category])
    pooled = joined.groupBy(category).agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        profile.weighted_mean(F.col("estimated_mean"), F.col("occurrence_count")).alias("pooled_value"),
    )
    whole = lookup.attach_total(pooled, pooled.agg(F.sum("occurrence_count").alias("_events")))
    shares = whole.withColumn("reference_share", F.col("occurrence_count") / F.col("_events")).drop("_events")
    sums = shares.agg(
        F.sum("occurrence_count").alias("event_count"),
        F.sum(F.col("reference_share") * F.col("pooled_value")).alias("value_per_event"),
    )
    total = declared.columns[0]
    reference = lookup.attach_total(sums, declared).select(
        (F.col("event_count") / F.col(total)).alias("events_per_unit"),
        "value_per_event",
        (F.col("event_count") / F.col(total) * F.col("value_per_event")).alias("value_per_unit"),
    )
    return shares, reference


def mix_runs(profile_rows: DataFrame, shares: DataFrame, reference: DataFrame, entity: str, category: str, probability: str, exposure: DataFrame, units: str) -> DataFrame:
    """Runs above reference: units x events per unit x (projected value per event - reference)."""
    priced = profile_rows.join(shares.select(category, "pooled_value"), category)
    per_event = priced.groupBy(entity).agg(F.sum(F.col(probability) * F.col("pooled_value")).alias("projected_value_per_event"))
    wide = lookup.attach_total(per_event.join(exposure.select(entity, units), entity), reference)
    runs = F.col(units) * F.col("events_per_unit") * (F.col("projected_value_per_event") - F.col("value_per_event"))
    return wide.select(entity, units, "projected_value_per_event", runs.alias("runs_above_reference"))


def steal_reference(totals: DataFrame) -> DataFrame:
    """One-row baserunning reference from summed pa, runs, outs, opportunities, attempts, successes."""
    caught = -(2.0 * F.col("runs") / F.col("outs") + CAUGHT_EXTRA_OUT)
    return totals.select(
        caught.alias("caught_value"),
        (F.col("opportunities") / F.col("pa")).alias("opportunities_per_pa"),
        (F.col("attempts") / F.col("opportunities")).alias("attempt_rate"),
        (F.col("successes") / F.col("attempts")).alias("success_rate"),
        ((F.col("successes") * STOLEN_BASE_RUNS + (F.col("attempts") - F.col("successes")) * caught) / F.col("opportunities")).alias("runs_per_opportunity"),
        (F.col("advancement") / F.col("pa")).alias("advancement_per_pa"),
    )


def baserunning_runs(df: DataFrame, reference: DataFrame, pa: str, multiplier: str, residual: str, advancement_rate: str) -> DataFrame:
    """Steal runs centred on the reference plus advancement runs, with their volumes."""
    from tallyframe.functions.numeric import logistic, logit

    wide = lookup.attach_total(df, reference)
    chances = F.col(pa) * F.col("opportunities_per_pa")
    attempts = chances * F.col("attempt_rate") * F.col(multiplier)
    safe = attempts * logistic(logit(F.col("success_rate")) + F.col(residual))
    steal = safe * STOLEN_BASE_RUNS + (attempts - safe) * F.col("caught_value") - chances * F.col("runs_per_opportunity")
    advance = F.col(pa) * F.col("advancement_per_pa") * F.col(advancement_rate)
    return wide.select(
        *df.columns,
        attempts.alias("projected_attempts"),
        safe.alias("projected_successes"),
        steal.alias("steal_runs"),
        advance.alias("advancement_runs"),
        (steal + advance).alias("baserunning_runs"),
    )


def positional_runs(df: DataFrame, entity: str, position: str, outs: str, dh_events: str, schedule: Mapping[str, float], season_outs: float, season_dh: float) -> DataFrame:
    """Positional adjustment from outs by position and designated-hitter events (long input)."""
    rate = F.create_map(*[part for p, r in schedule.items() for part in (F.lit(p), F.lit(r))])
    runs = F.try_element_at(rate, F.col(position)) * F.when(F.col(position) == "DH", F.col(dh_events) / season_dh).otherwise(F.col(outs) / season_outs)
    return df.groupBy(entity).agg(F.sum(runs).alias("positional_runs"))


def component_runs(df: DataFrame, entity: str, component: str, skill: str, opportunity: str, run_rate: str, components: Sequence[str]) -> DataFrame:
    """Skill x opportunity x run rate per component, one column each, and their sum."""
    runs = F.col(skill) * F.coalesce(F.col(opportunity), F.lit(0.0)) * F.col(run_rate)
    wide = df.groupBy(entity).agg(
        *[F.coalesce(F.sum(F.when(F.col(component) == c, runs)), F.lit(0.0)).alias(f"{c}_runs") for c in components]
    )
    return wide.withColumn("total_runs", sum((F.col(f"{c}_runs") for c in components[1:]), F.col(f"{components[0]}_runs")))


# --- cohort, centering, replacement ------------------------------------------------------------


def fixed_cohort(official: DataFrame, exposure: DataFrame, entity: str, official_units: str, units: str) -> tuple[DataFrame, DataFrame]:
    """(members with positive official units and their projected units, members without a projection)."""
    positive = official.where(F.col(official_units) > 0).select(entity)
    joined = positive.join(exposure.select(entity, units), entity, "left")
    return joined.where(F.col(units).isNotNull()), joined.where(F.col(units).isNull()).select(entity)


def centering(df: DataFrame, units: str, components: Sequence[str]) -> DataFrame:
    """One row: aggregate components, the per-unit rate that cancels them, and what is left over."""
    sums = df.agg(
        F.count("*").alias("member_count"),
        F.sum(units).alias("aggregate_units"),
        *[F.sum(c).alias(f"aggregate_{c}") for c in components],
    )
    raw = sum((F.col(f"aggregate_{c}") for c in components[1:]), F.col(f"aggregate_{components[0]}"))
    rate = -F.col("aggregate_raw") / F.col("aggregate_units")
    return (
        sums.withColumn("aggregate_raw", raw)
        .withColumn("centering_per_unit", rate)
        .withColumn("residual", F.col("aggregate_raw") + F.col("centering_per_unit") * F.col("aggregate_units"))
    )


def runs_per_win(runs: Column, innings: Column) -> Column:
    return 1.5 * (9.0 * runs / innings) + 3.0


def replacement_per_unit(games: Column, units: Column, rpw: Column, pool: float = WAR_POOL) -> Column:
    return pool * (games / FULL_SEASON_GAMES) * rpw / units


def final_value(df: DataFrame, components: Sequence[str], rpw: Column) -> DataFrame:
    """Sum of the additive components and its worth in wins."""
    total = sum((F.col(c) for c in components[1:]), F.col(components[0]))
    return df.withColumn("runs_above_replacement", total).withColumn("wins", F.col("runs_above_replacement") / rpw)


def ranked(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Rank by unrounded value, ties by id, over the whole table without gathering it."""
    return scan.ordered_rank(df, [F.desc(value), F.asc(entity)], "value_rank")


def incomplete_members(cohort: DataFrame, components: Mapping[str, DataFrame], entity: str) -> DataFrame:
    """Members with the names of the components they lack; empty when the reference can be built."""
    joined = cohort.select(entity)
    for name, frame in components.items():
        joined = joined.join(frame.select(entity).distinct().withColumn(f"_has_{name}", F.lit(True)), entity, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in components]))
    return joined.select(entity, missing.alias("missing_components")).where(F.size("missing_components") > 0)


# --- sensitivity and spread --------------------------------------------------------------------


def win_share(scored: Column, allowed: Column) -> Column:
    """Share of wins from runs scored and allowed, with an exponent that follows the run level."""
    exponent = F.pow(scored + allowed, F.lit(WIN_EXPONENT_POWER))
    return F.pow(scored, exponent) / (F.pow(scored, exponent) + F.pow(allowed, exponent))


def ratio_form_wins(df: DataFrame, units: str, outs: str, offense: Column, fielding: Column, replacement_rate: Column, league_runs: Column) -> DataFrame:
    """Wins above average and replacement wins by the ratio formula; zero without units."""
    innings = F.greatest(2.1 * F.col(units), F.col(outs) / 3.0)
    games = innings / 9.0
    played = F.col(units) > 0
    own = win_share(league_runs + F.try_divide(offense, games), league_runs - F.try_divide(fielding, games))
    spare = win_share(league_runs - F.try_divide(replacement_rate * F.col(units), games), league_runs)
    above = F.when(played, games * (own - 0.5)).otherwise(F.lit(0.0))
    back = F.when(played, games * (0.5 - spare)).otherwise(F.lit(0.0))
    return df.withColumn("wins_above_average", above).withColumn("replacement_wins", back).withColumn("ratio_wins", above + back)


def mix_variance(df: DataFrame, entity: str, probability: str, value: str, units: Column, coverage: Column, concentration: Column) -> DataFrame:
    """Variance of mix runs: event noise plus uncertainty of the mix itself.

    ``units``, ``coverage`` and ``concentration`` are constant per entity.
    """
    moments = df.groupBy(entity).agg(
        F.sum(F.col(probability) * F.col(value)).alias("_m"),
        F.sum(F.col(probability) * F.col(value) * F.col(value)).alias("_q"),
        F.max(units).alias("_u"),
        F.max(coverage).alias("_c"),
        F.max(concentration).alias("_k"),
    )
    mean, second, n, c = F.col("_m"), F.col("_q"), F.col("_u"), F.col("_c")
    posterior = F.greatest(F.lit(0.0), (second - mean * mean) / (F.col("_k") + 1.0))
    event = F.greatest(F.lit(0.0), c * second - c * c * mean * mean)
    spread = n * event + F.greatest(F.lit(0.0), n * n - n) * c * c * posterior
    return moments.select(entity, F.greatest(spread, F.lit(0.0)).alias("mix_variance"))


def skill_variance(df: DataFrame, entity: str, mse: Column, opportunity: str, run_rate: str) -> DataFrame:
    """Sum over components of model variance times (opportunity x run rate) squared."""
    scale = F.coalesce(F.col(opportunity), F.lit(0.0)) * F.col(run_rate)
    return df.groupBy(entity).agg(F.sum(mse * scale * scale).alias("skill_variance"))


# Reported percentiles of a draws table.
INTERVAL_POINTS = (0.025, 0.10, 0.50, 0.90, 0.975)


def interval_summary(draws: DataFrame, entity: str, value: str, members: DataFrame | None = None) -> DataFrame:
    """Mean, exact percentiles and interval widths per entity of a table of draws.

    Members without any draw get zeros throughout.
    """
    points = profile.exact_quantiles(draws, [entity], value, INTERVAL_POINTS)
    wide = points.groupBy(entity).agg(
        *[F.max(F.when(F.col("point") == p, F.col("quantile"))).alias(f"p{int(p * 1000):03d}") for p in INTERVAL_POINTS]
    )
    means = draws.groupBy(entity).agg(F.avg(value).alias("mean_value"), F.count("*").alias("draw_count"))
    both = means.join(wide, entity)
    result = both.withColumn("width_80", F.col("p900") - F.col("p100")).withColumn("width_95", F.col("p975") - F.col("p025"))
    if members is None:
        return result
    filled = members.select(entity).join(result, entity, "left")
    return filled.fillna(0, subset=[c for c in result.columns if c != entity])


def variance_shares(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Each part's share of the summed variance; zero when there is none."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumn("total_variance", total).withColumns(
        {f"{p}_share": F.when(F.col("total_variance") > 0, F.col(p) / F.col("total_variance")).otherwise(F.lit(0.0)) for p in parts}
    )
