"""Projected rates, roles and opportunities from an entity's own history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip, logistic, logit, ratio
from tallyframe.operators import lookup, profile, scan

# Weight of evidence one, two and three periods back, and the probability margin.
HISTORY_WEIGHTS = {1: 1.0, 2: 0.5, 3: 0.25}
RATE_EPSILON = 1e-9


def weighted_history(
    df: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str], weights: Mapping[int, float] = HISTORY_WEIGHTS
) -> DataFrame:
    """Add ``history_<m>``: each measure's weighted sum over the entity's earlier periods.

    Every row is sent forward to the periods it counts for and added up there, so no row meets its
    whole history; periods without a row of their own are dropped by the join.
    """
    ahead = F.explode(F.array(*[F.struct(F.lit(b).alias("back"), F.lit(w).alias("weight")) for b, w in weights.items()]))
    sent = df.select(*entity, period, *measures, ahead.alias("_a"))
    sums = sent.groupBy(*entity, (F.col(period) + F.col("_a.back")).alias(period)).agg(
        *[F.sum(F.col(m) * F.col("_a.weight")).alias(f"history_{m}") for m in measures]
    )
    joined = df.join(sums, [*entity, period], "left")
    return joined.fillna(0.0, subset=[f"history_{m}" for m in measures])


def count_multiplier(observed: Column, expected: Column, strength: Column | float) -> Column:
    """Shrunk ratio of observed to expected events; 1 without history."""
    return F.when(expected > 0, (strength + observed) / (strength + expected)).otherwise(F.lit(1.0))


def log_odds_residual(successes: Column, attempts: Column, expected: Column, strength: Column | float) -> Column:
    """Log-odds of the shrunk success rate minus those of its baseline; 0 without attempts."""
    baseline = clip(F.try_divide(expected, attempts), RATE_EPSILON, 1 - RATE_EPSILON)
    posterior = clip((strength * baseline + successes) / (strength + attempts), RATE_EPSILON, 1 - RATE_EPSILON)
    return F.when(attempts > 0, logit(posterior, RATE_EPSILON) - logit(baseline, RATE_EPSILON)).otherwise(F.lit(0.0))


def shifted_probability(baseline: Column, residual: Column) -> Column:
    return clip(logistic(logit(baseline, RATE_EPSILON) + residual), RATE_EPSILON, 1 - RATE_EPSILON)


def shrunk_rate(amount: Column, opportunities: Column, strength: Column | float) -> Column:
    """Amount per opportunity pulled toward zero by ``strength`` opportunities."""
    return F.when(opportunities > 0, amount / (strength + opportunities)).otherwise(F.lit(0.0))


def leave_one_out_rates(
    stints: DataFrame, entity: str, period: str, environment: str, level: str, opportunity: str, success: str, minimum: float, exempt: Column
) -> DataFrame:
    """Expected successes per stint from everyone else's rate in its environment.

    Below ``minimum`` opportunities by others the whole level's rate (without the entity) is used,
    except where ``exempt`` holds.
    """
    own = stints.groupBy(entity, period, environment, level).agg(F.sum(opportunity).alias("n"), F.sum(success).alias("s"))
    here = own.groupBy(period, environment, level).agg(F.sum("n").alias("_en"), F.sum("s").alias("_es"))
    wide = own.groupBy(period, level).agg(F.sum("n").alias("_ln"), F.sum("s").alias("_ls"))
    mine = own.groupBy(entity, period, level).agg(F.sum("n").alias("_mn"), F.sum("s").alias("_ms"))
    joined = own.join(here, [period, environment, level]).join(wide, [period, level]).join(mine, [entity, period, level])
    others_n, others_s = F.col("_en") - F.col("n"), F.col("_es") - F.col("s")
    local = exempt | (others_n >= minimum)
    rate = F.when(local, F.try_divide(others_s, others_n)).otherwise(
        F.try_divide(F.col("_ls") - F.col("_ms"), F.col("_ln") - F.col("_mn"))
    )
    return (
        joined.withColumn("baseline_rate", F.when(F.col("n") > 0, rate).otherwise(F.lit(0.0)))
        .withColumn("baseline_source", F.when(local, "environment").otherwise("level"))
        .withColumn("expected", F.col("n") * F.col("baseline_rate"))
        .drop("_en", "_es", "_ln", "_ls", "_mn", "_ms")
    )


# --- roles -------------------------------------------------------------------------------------


def destination_means(current_primary: DataFrame, following: DataFrame, entity: str, primary: str, role: str, share: str) -> DataFrame:
    """Mean next-period role shares of the entities that shared a primary role.

    Entities must appear on both sides; absent roles count as zero through the entity count.
    """
    moved = following.join(current_primary.select(entity, primary), entity)
    movers = moved.select(entity, primary).distinct().groupBy(primary).agg(F.count("*").alias("_k"))
    sums = moved.groupBy(primary, role).agg(F.sum(share).alias("_s")).join(movers, primary)
    means = sums.withColumn("_m", F.col("_s") / F.col("_k"))
    whole = Window.partitionBy(primary)
    return means.select(primary, role, (F.col("_m") / F.sum("_m").over(whole)).alias("destination_share"), F.col("_k").alias("entity_count"))


def blended_roles(current: DataFrame, primary: DataFrame, means: DataFrame, entity: str, primary_name: str, role: str, share: str, threshold: float) -> DataFrame:
    """Next role shares: ``primary_share * current + (1 - primary_share) * destination``.

    The blend applies where the primary share reaches ``threshold``; other entities carry forward.
    """
    who = primary.select(entity, primary_name, "primary_share")
    known = current.join(who, entity).select(entity, role, F.col(share).alias("_cur"), F.lit(0.0).alias("_dest"), "primary_share")
    aimed = who.join(means, primary_name).select(
        entity, role, F.lit(0.0).alias("_cur"), F.col("destination_share").alias("_dest"), "primary_share"
    )
    cells = known.unionByName(aimed).groupBy(entity, role).agg(
        F.sum("_cur").alias("_cur"), F.sum("_dest").alias("_dest"), F.max("primary_share").alias("_w")
    )
    blend = F.when(F.col("_w") >= threshold, F.col("_w") * F.col("_cur") + (1 - F.col("_w")) * F.col("_dest")).otherwise(F.col("_cur"))
    whole = Window.partitionBy(entity)
    raw = cells.withColumn("_p", blend)
    return raw.withColumn("predicted_share", F.col("_p") / F.sum("_p").over(whole)).select(entity, role, "predicted_share")


def role_errors(predicted: DataFrame, observed: DataFrame, entity: str, role: str, share: str) -> DataFrame:
    """Total variation distance and summed squared error per entity present on both sides."""
    both_sides = predicted.select(entity).distinct().join(observed.select(entity).distinct(), entity)
    a = predicted.select(entity, role, "predicted_share")
    b = observed.select(entity, role, F.col(share).alias("_o"))
    cells = a.join(b, [entity, role], "full").fillna(0.0).join(both_sides, entity, "left_semi")
    gap = F.col("predicted_share") - F.col("_o")
    return cells.groupBy(entity).agg((F.sum(F.abs(gap)) / 2).alias("total_variation"), F.sum(gap * gap).alias("squared_error"))


# --- skills and opportunities ------------------------------------------------------------------


def fallback_moments(df: DataFrame, grains: Sequence[Sequence[str]], value: str, minimum: int) -> DataFrame:
    """Attach mean and deviation from the finest grain that has ``minimum`` rows and spread.

    ``grains`` runs from fine to coarse; an empty grain is the whole table. The grain used is named.
    """
    result = df
    picks = []
    for i, keys in enumerate(grains):
        stats = [F.count(value).alias(f"_n{i}"), F.avg(value).alias(f"_m{i}"), F.stddev_pop(value).alias(f"_s{i}")]
        if keys:
            result = result.join(df.groupBy(*keys).agg(*stats), list(keys), "left")
        else:
            result = lookup.attach_total(result, df.agg(*stats))
        picks.append((F.col(f"_n{i}") >= minimum) & (F.col(f"_s{i}") > 1e-12))

    def first(prefix: str) -> Column:
        column = F.when(picks[0], F.col(f"{prefix}0"))
        for i in range(1, len(grains)):
            column = column.when(picks[i], F.col(f"{prefix}{i}"))
        return column

    label = F.when(picks[0], F.lit("_".join(grains[0]) or "all"))
    for i in range(1, len(grains)):
        label = label.when(picks[i], F.lit("_".join(grains[i]) or "all"))
    return result.select(*df.columns, first("_m").alias("norm_mean"), first("_s").alias("norm_sd"), label.alias("norm_grain"))


def skill_ladder(df: DataFrame, steps: Sequence[tuple[str, Column, Column]], otherwise: str) -> DataFrame:
    """Skill from the first model whose condition holds, with the model's name; 0 when none does."""
    (name, condition, value), *rest = steps
    family, skill = F.when(condition, F.lit(name)), F.when(condition, value)
    for name, condition, value in rest:
        family, skill = family.when(condition, F.lit(name)), skill.when(condition, value)
    return df.withColumn("skill_family", family.otherwise(F.lit(otherwise))).withColumn("skill", skill.otherwise(F.lit(0.0)))


def blended_feature(current: Column, exposure: Column, prior: Column, prior_exposure: Column, weight: float) -> Column:
    """Exposure-weighted mean of the current and the down-weighted prior value, if there is one."""
    mixed = (exposure * current + weight * prior_exposure * prior) / (exposure + weight * prior_exposure)
    return F.when(prior.isNotNull() & (prior_exposure > 0), mixed).otherwise(current)


def opportunity_forecasts(df: DataFrame, prior: str, exposure_now: str, exposure_next: str) -> DataFrame:
    """Persistence, exposure-ratio and half-and-half forecasts of an opportunity count."""
    scaled = F.when(F.col(exposure_now) > 0, F.col(prior) * F.col(exposure_next) / F.col(exposure_now)).otherwise(F.col(prior))
    return df.withColumn("persistence", F.col(prior)).withColumn("exposure_ratio", scaled).withColumn("half_and_half", 0.5 * F.col(prior) + 0.5 * scaled)


def forecast_errors(df: DataFrame, groups: Sequence[str], forms: Sequence[str], observed: str) -> DataFrame:
    """MAE and RMSE of each forecast form per group, and the MAE where something was observed."""
    cells = F.array(*[F.struct(F.lit(f).alias("form"), (F.col(f) - F.col(observed)).alias("_e")) for f in forms])
    long = df.select(*groups, F.col(observed).alias("_o"), F.inline(cells))
    error = F.abs(F.col("_e"))
    return long.groupBy(*groups, "form").agg(
        F.count("*").alias("row_count"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.when(F.col("_o") > 0, error)).alias("continuing_mae"),
    )


def allocate(shares: DataFrame, totals: DataFrame, entity: str, role: str, prior_share: str, role_share: str, total: str) -> DataFrame:
    """Split each entity's total over its roles by the mean of two share estimates."""
    mixed = shares.withColumn("_b", 0.5 * F.coalesce(F.col(prior_share), F.lit(0.0)) + 0.5 * F.coalesce(F.col(role_share), F.lit(0.0)))
    whole = Window.partitionBy(entity)
    blended = mixed.withColumn("blended_share", ratio(F.col("_b"), F.sum("_b").over(whole))).drop("_b")
    return blended.join(totals.select(entity, total), entity).withColumn("allocated", F.col("blended_share") * F.col(total))


def native_run_rates(df: DataFrame, periods: str, score: str, opportunity: str, target: str) -> DataFrame:
    """Through-origin slope of the target on score x opportunity, with its errors, per period.

    The error is added up from the residuals of a second pass: a difference of sums of squares would be lost in rounding
    where the line fits well. A period without a slope has no error.
    """
    x, y = F.col(score) * F.col(opportunity), F.col(target)
    rows = df.where(x.isNotNull() & y.isNotNull()).select(periods, x.alias("_x"), y.alias("_y"))
    fitted = scan.group_totals(rows, [periods], slope=profile.origin_slope(F.col("_x"), F.col("_y")))
    left = F.col("_y") - F.col("slope") * F.col("_x")
    return fitted.groupBy(periods).agg(F.count("*").alias("row_count"), F.max("slope").alias("slope"), F.sqrt(F.avg(left * left)).alias("rmse"))


def slope_stability(slopes: DataFrame, slope: str = "slope") -> DataFrame:
    """Mean, spread, sign and range of one slope per period."""
    low, high, mean, sd = F.min(slope), F.max(slope), F.avg(slope), F.stddev_pop(slope)
    return slopes.agg(
        F.count("*").alias("period_count"),
        mean.alias("mean_slope"),
        sd.alias("sd_slope"),
        F.when(F.abs(mean) > 1e-12, sd / F.abs(mean)).alias("coefficient_of_variation"),
        (low > 0).alias("all_positive"),
        F.when(low > 0, high / low).alias("max_to_min_ratio"),
    )


def adjacent_reliability(
    df: DataFrame, entity: Sequence[str], period: str, groups: Sequence[str], rate: str, exposure: str, minimum: float
) -> DataFrame:
    """Agreement of a rate with its own value one period earlier, per group.

    Pairs where either side falls short of ``minimum`` exposure are left out. Groups are not null.
    """
    rows = df.where((F.col(exposure) >= minimum) & F.col(rate).isNotNull())
    pairs = lookup.with_prior(rows.select(*entity, *groups, period, rate), [*entity, *groups], period, [rate])
    usable = pairs.where(F.col(f"prior_{rate}").isNotNull())
    agreement = usable.groupBy(*groups).agg(
        F.count("*").alias("pair_count"),
        F.corr(F.col(f"prior_{rate}"), F.col(rate)).alias("pearson"),
        F.avg(F.abs(F.col(rate) - F.col(f"prior_{rate}"))).alias("mae"),
    )
    ranked = profile.rank_correlation(usable, f"prior_{rate}", rate, groups)
    return agreement.join(ranked.select(*groups, F.col("rank_correlation").alias("spearman")), list(groups))


# --- retention audit ---------------------------------------------------------------------------


def centered(df: DataFrame, numerator: str, exposure: str, scale: float = 600.0, name: str = "centered_rate") -> DataFrame:
    """Each row's rate minus the pooled rate, per ``scale`` units of exposure."""
    pooled = df.agg((F.sum(numerator) / F.sum(exposure)).alias("pooled_rate"))
    wide = lookup.attach_total(df, pooled)
    return wide.withColumn(name, scale * (F.col(numerator) / F.col(exposure) - F.col("pooled_rate"))).drop("pooled_rate")


def permutation_p_value(df: DataFrame, unit: str, x: str, y: str, weight: str, iterations: int, seed: str) -> DataFrame:
    """One-sided p-value of a weighted slope under shuffled ``y``, with the plus-one correction.

    ``df`` holds one row per unit, a short reduced table (the caller aggregates to it). Each
    iteration deals the y values out again in the order of a seeded hash; the iterations are spread
    over the cluster and a window only ever covers the units of one iteration.
    """
    base = profile.less_means(df.select(unit, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(weight).alias("_w")), ["_x", "_y"])
    observed = base.agg(profile.weighted_line(F.col("_x"), F.col("_y"), F.col("_w"))[0].alias("slope"))
    rounds = base.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col("_i").cast("string"), F.col(unit).cast("string")))
    seat = F.row_number().over(Window.partitionBy("_i").orderBy(unit))
    draw = F.row_number().over(Window.partitionBy("_i").orderBy(mixed, F.col(unit)))
    seats = rounds.select("_i", seat.alias("_seat"), "_x", "_w")
    draws = rounds.select("_i", draw.alias("_seat"), "_y")
    dealt = seats.join(draws, ["_i", "_seat"])
    slopes = dealt.groupBy("_i").agg(profile.weighted_line(F.col("_x"), F.col("_y"), F.col("_w"))[0].alias("_slope"))
    seen = observed.select("slope").scalar()
    return slopes.agg(
        F.round(F.max(seen), 12).alias("observed_slope"),
        F.count("*").alias("iterations"),
        F.count_if(F.col("_slope") >= seen).alias("exceedances"),
    ).withColumn("p_value", (F.col("exceedances") + 1.0) / (F.col("iterations") + 1.0))
