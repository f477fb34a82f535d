"""Category mixes, environment effects, priors and small fits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import asof, composition, fits, lookup, mixes, profile, rates, season, shrinkage, windows
from tallyframe.plans.evidence import KINDS
from tallyframe.plans.registry import Tables, big, query, r6

CUTOFF = "2024-01-16"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BANDS = ["night", "day", "evening"]
KIND_LIST = "['view', 'click', 'signup', 'purchase', 'error']"
BAND_SQL = "case when hour(ts) < 8 then 'night' when hour(ts) < 16 then 'day' else 'evening' end"

# --- composition -------------------------------------------------------------------------------

_MIX = f"""k as (select unnest({KIND_LIST}) event_type), c as (select user_id, event_type, count(*) n from events where ts < timestamp '2024-01-16' group by 1, 2),
  g as (select user_id, event_type, coalesce(n, 0) n from (select distinct user_id from c) cross join k left join c using (user_id, event_type)),
  s as (select *, (n + 0.5) / (sum(n) over (partition by user_id) + 2.5) p from g), l as (select *, ln(p) - avg(ln(p)) over (partition by user_id) clr from s)"""


def _mix(t: Tables):
    """Event-type counts of every user before the cutoff, all five types present."""
    before = t.events.where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))
    counts = before.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return season.complete(counts, ["user_id"], "event_type", KINDS, ["n"])


def _smoothed(t: Tables):
    clr = composition.centered_log_ratio(_mix(t), ["user_id"], "n", len(KINDS))
    return composition.softmax(clr, ["user_id"], "clr")


def _band():
    hour = F.hour("ts")
    return F.when(hour < 8, "night").when(hour < 16, "day").otherwise("evening")


@query(
    "k1_complete_composition",
    f"""with k as (select unnest({KIND_LIST}) event_type), c as (select user_id, event_type, count(*) n from events group by 1, 2)
        select user_id, event_type, coalesce(n, 0) n from (select distinct user_id from c) cross join k left join c using (user_id, event_type)""",
)
def _(t: Tables):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return season.complete(counts, ["user_id"], "event_type", KINDS, ["n"])


@query("k2_centered_log_ratio", f"with {_MIX} select user_id, event_type, n, round(clr, 6) + 0.0 clr from l")
def _(t: Tables):
    return composition.centered_log_ratio(_mix(t), ["user_id"], "n", len(KINDS)).withColumn("clr", r6("clr"))


@query("k3_softmax_back", f"with {_MIX} select user_id, event_type, round(p, 6) + 0.0 probability from l")
def _(t: Tables):
    return _smoothed(t).select("user_id", "event_type", r6("probability").alias("probability"))


_ILR = ", ".join(
    f"round(({' + '.join(f'v{i}' for i in range(1, j + 1))} - {j} * v{j + 1}) / sqrt({j * (j + 1)}), 6) + 0.0 ilr_{j}" for j in range(1, 5)
)
_WIDE = "w as (select user_id, " + ", ".join(f"max(ln(p)) filter (event_type = '{k}') v{i}" for i, k in enumerate(KINDS, 1)) + " from s group by 1)"


@query("k4_isometric_log_ratio", f"with {_MIX}, {_WIDE} select user_id, {_ILR} from w")
def _(t: Tables):
    ilr = composition.isometric_log_ratio(_smoothed(t), ["user_id"], "event_type", "probability", KINDS)
    return ilr.select("user_id", *[r6(f"ilr_{j}").alias(f"ilr_{j}") for j in range(1, 5)])


@query("k4_inverse_round_trip", f"with {_MIX} select user_id, event_type category, round(p, 6) + 0.0 probability from s")
def _(t: Tables):
    ilr = composition.isometric_log_ratio(_smoothed(t), ["user_id"], "event_type", "probability", KINDS)
    return composition.inverse_isometric(ilr, ["user_id"], KINDS).withColumn("probability", r6("probability"))


_PAIRS = f"""e as (select user_id, ts::date d, event_type, {BAND_SQL} env from events), q as (select user_id, d, min(env) lo, max(env) hi, count(*) n from e group by 1, 2),
  f as (select *, lo <> hi broken, lag(case when lo = hi then lo end) over (partition by user_id order by d) before from q),
  s as (select *, (sum(broken::int) over w)::bigint seg, (sum((not broken and (before is null or before <> lo))::int) over w)::bigint stint
    from f window w as (partition by user_id order by d rows unbounded preceding)),
  t as (select user_id, seg, stint, lo env, sum(n)::bigint n from s where not broken group by 1, 2, 3, 4),
  k as (select unnest({KIND_LIST}) event_type),
  c as (select s.user_id, s.seg, s.stint, e.event_type, count(*) n from s join e on e.user_id = s.user_id and e.d = s.d where not broken group by 1, 2, 3, 4),
  g as (select t.*, k.event_type, ln((coalesce(c.n, 0) + 0.5) / (t.n + 2.5)) lp from t cross join k left join c on c.user_id = t.user_id and c.seg = t.seg and c.stint = t.stint
    and c.event_type = k.event_type),
  r as (select *, lp - avg(lp) over (partition by user_id, seg, stint) clr from g),
  p as (select user_id, seg, event_type, lag(stint) over w fs, stint ts, lag(env) over w fe, env te, lag(n) over w fn, n tn, clr - lag(clr) over w dy
    from r window w as (partition by user_id, seg, event_type order by stint)),
  m as (select *, fn * tn / (fn + tn) wt from p where fs is not null)"""


def _deltas(t: Tables):
    band = _band()
    rows = t.events.select("user_id", F.to_date("ts").alias("event_date"), "event_type", band.alias("environment"))
    daily = windows.date_environments(rows, "user_id", "event_date", "environment", events=F.count("*"))
    indexed = windows.stint_index(daily, "user_id", "event_date", "environment")
    stints = windows.stint_summary(indexed, "user_id", "event_date", "environment", "events")
    ordinal = fn.map_value(F.col("environment"), {"night": 1, "day": 2, "evening": 3})
    pairs = windows.stint_pairs(stints, "user_id", "environment", "events", ordinal, minimum=1, max_gap=365)
    mapped = rows.drop("environment").join(indexed.select("user_id", "event_date", "continuity_segment", "stint_index"), ["user_id", "event_date"])
    keys = ["user_id", "continuity_segment", "stint_index"]
    counts = mapped.groupBy(*keys, "event_type").agg(F.count("*").alias("n"))
    full = season.complete(counts, keys, "event_type", KINDS, ["n"])
    profiles = composition.centered_log_ratio(full, keys, "n", len(KINDS))
    return composition.pair_deltas(pairs, profiles, ["user_id", "continuity_segment"], "event_type")


@query(
    "k5_matched_pair_deltas",
    f"""with {_PAIRS} select user_id, seg continuity_segment, fs from_stint_index, ts to_stint_index, fe from_environment, te to_environment, event_type,
          round(wt, 6) + 0.0 pair_weight, round(dy, 6) + 0.0 clr_delta from m""",
)
def _(t: Tables):
    return _deltas(t).select(
        "user_id",
        "continuity_segment",
        "from_stint_index",
        "to_stint_index",
        "from_environment",
        "to_environment",
        "event_type",
        r6("pair_weight").alias("pair_weight"),
        r6("clr_delta").alias("clr_delta"),
    )


@query(
    "k6_environment_effects",
    f"""with {_PAIRS}, u as (select *, (te = 'night')::int - (fe = 'night')::int x1, (te = 'evening')::int - (fe = 'evening')::int x2 from m where fe <> te),
        z as (select event_type, sum(wt * x1 * x1) a, sum(wt * x1 * x2) b, sum(wt * x2 * x2) c, sum(wt * x1 * dy) d, sum(wt * x2 * dy) e from u group by 1),
        v as (select event_type, (d * c - e * b) / (a * c - b * b) n, (a * e - b * d) / (a * c - b * b) v from z),
        y as (select u.event_type, sqrt(sum(wt * pow(dy - x1 * v.n - x2 * v.v, 2)) / sum(wt)) rmse from u join v using (event_type) group by 1),
        o as (select 'night' environment, event_type, n eff from v union all select 'evening', event_type, v from v union all select 'day', event_type, 0 from v),
        i as (select env environment, count(*) k, sum(wt) w from (select *, unnest([fe, te]) env from u where event_type = 'view') group by 1)
        select environment, event_type, round(eff - avg(eff) over (partition by environment), 5) + 0.0 effect, k matched_pair_count, round(w, 4) + 0.0 matched_pair_weight,
          round(rmse, 5) + 0.0 residual_rmse from o join y using (event_type) join i using (environment)""",
)
def _(t: Tables):
    effects = composition.environment_effects(_deltas(t), "event_type", "day", KINDS)
    return effects.select(
        "environment",
        "event_type",
        r6("effect", 5).alias("effect"),
        "matched_pair_count",
        r6("matched_pair_weight", 4).alias("matched_pair_weight"),
        r6("residual_rmse", 5).alias("residual_rmse"),
    )


# Declared effects of the hour bands on each type, as an earlier fit would have stored them.
EFFECTS = {"night": [0.1, -0.05, 0.2, -0.15, -0.1], "day": [0.0, 0.0, 0.0, 0.0, 0.0], "evening": [-0.2, 0.1, 0.05, 0.15, -0.1]}
_EFFECT_ROWS = ", ".join(f"('{b}', '{k}', {v}::double)" for b, vs in EFFECTS.items() for k, v in zip(KINDS, vs))
_LEVELS = f"""x(environment, event_type, effect) as (values {_EFFECT_ROWS}), k as (select unnest({KIND_LIST}) event_type),
  c as (select user_id, {BAND_SQL} environment, event_type, exp(-ln(2) / 10 * (date '2024-01-16' - ts::date)) w from events where ts < timestamp '2024-01-16'),
  n as (select user_id, environment, event_type, sum(w) n from c group by 1, 2, 3),
  g as (select user_id, environment, event_type, coalesce(n, 0) n from (select distinct user_id, environment from n) cross join k left join n using (user_id, environment, event_type)),
  l as (select *, sum(n) over p tot, ln((n + 0.5) / (sum(n) over p + 2.5)) lp from g window p as (partition by user_id, environment)),
  h as (select l.*, effect, exp(lp - effect) ex from l join x using (environment, event_type)),
  j as (select *, ex / sum(ex) over (partition by user_id, environment) * tot tc from h),
  u as (select user_id, event_type, sum(tc) tc from j group by 1, 2)"""


def _effects(t: Tables, zero: bool = False):
    rows = [(b, k, 0.0 if zero else v) for b, vs in EFFECTS.items() for k, v in zip(KINDS, vs)]
    return t.spark.createDataFrame(rows, "environment string, event_type string, effect double")


def _translated_mixes(t: Tables, zero: bool = False):
    """Recency-weighted mixes per user and hour band, moved to the daytime scale and added up: one vector per user."""
    day, cutoff, size = F.to_date("ts"), asof.as_date(CUTOFF), len(KINDS)
    window = asof.evidence_window(half_life_days=10)
    past = t.events.where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")).where(window.holds(day, cutoff))
    rows = past.select("user_id", _band().alias("environment"), "event_type", window.weight(day, cutoff).alias("weight"))
    mix = mixes.vectors(rows, ["user_id", "environment"], "event_type", KINDS, mix=F.col("weight"))
    effects = {band: [0.0] * size for band in EFFECTS} if zero else EFFECTS
    known = mix.withColumn("effect", mixes.effect_of("environment", effects)).where("effect is not null")
    moved = mixes.scaled(mixes.shifted(F.col("mix"), F.col("effect"), size, -1), mixes.total("mix"))
    return mixes.summed(known.select("user_id", moved.alias("n")), ["user_id"], size, "n")


def _translated(t: Tables, zero: bool = False):
    return mixes.unfolded(_translated_mixes(t, zero), ["user_id"], "event_type", KINDS, n="n")


@query(
    "k7_effect_removed",
    f"""with {_LEVELS} select user_id, event_type, round(tc, 6) + 0.0 translated_count, round(tc / sum(tc) over (partition by user_id), 6) + 0.0 translated_rate from u""",
)
def _(t: Tables):
    return mixes.unfolded(
        _translated_mixes(t).withColumn("rate", mixes.shares(F.col("n"))),
        ["user_id"],
        "event_type",
        KINDS,
        translated_count=F.transform("n", lambda x: r6(x)),
        translated_rate=F.transform("rate", lambda x: r6(x)),
    )


@query(
    "k8_effect_added",
    f"""with {_LEVELS}, r as (select user_id, event_type, tc / sum(tc) over (partition by user_id) p from u),
        f as (select distinct user_id, {BAND_SQL} environment from events where ts >= timestamp '2024-01-16' and ts < timestamp '2024-01-23'),
        y as (select f.*, r.event_type, exp(ln(p) + x.effect) ex from f join r using (user_id) join x on x.environment = f.environment and x.event_type = r.event_type)
        select user_id, environment, event_type, round(ex / sum(ex) over (partition by user_id, environment), 6) + 0.0 target_probability from y""",
)
def _(t: Tables):
    latent = _translated_mixes(t).select("user_id", mixes.shares(F.col("n")).alias("p"))
    targets = t.events.where(asof.membership(F.to_date("ts"), asof.as_date(CUTOFF), 7)[1]).select("user_id", _band().alias("environment")).distinct()
    known = targets.join(latent, "user_id").withColumn("effect", mixes.effect_of("environment", EFFECTS)).where("effect is not null")
    scores = mixes.added(mixes.centered_log(F.col("p"), len(KINDS)), F.col("effect"))
    projected = known.select("user_id", "environment", mixes.softmax(scores).alias("share"))
    return mixes.unfolded(projected, ["user_id", "environment"], "event_type", KINDS, target_probability=F.transform("share", lambda x: r6(x)))


_CUSTOMER_MIX = """k as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) o_orderpriority),
  c as (select o_custkey, o_orderpriority, count(*) n from orders group by 1, 2),
  g as (select o_custkey, o_orderpriority, coalesce(n, 0) n from (select distinct o_custkey from c) cross join k left join c using (o_custkey, o_orderpriority)),
  r as (select g.*, c_nationkey::bigint nation, c_mktsegment segment from g join customer on c_custkey = o_custkey where c_acctbal > 0),
  a as (select nation, segment, o_orderpriority, sum(n) n, count(*) k from r group by 1, 2, 3), b as (select nation, o_orderpriority, sum(n) n, count(*) k from r group by 1, 2),
  d as (select o_orderpriority, sum(n) n, count(*) k from r group by 1),
  q as (select r.*, case when a.k - 1 >= 12 then 'narrow' when b.k > 1 then 'wide' else 'all' end src, a.n an, a.k ak, b.n bn, b.k bk, d.n dn, d.k dk from r join a using (nation, segment, o_orderpriority)
    join b using (nation, o_orderpriority) join d using (o_orderpriority)),
  p as (select *, (case src when 'narrow' then an when 'wide' then bn else dn end - n) pool, (case src when 'narrow' then ak when 'wide' then bk else dk end - 1)::bigint peers from q),
  z as (select *, (pool + 0.5) / (sum(pool) over (partition by o_custkey) + 2.5) prior from p),
  y as (select *, (n + 20 * prior) / (sum(n) over (partition by o_custkey) + 20) post from z)"""


def _customer_mix(t: Tables):
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return season.complete(counts, ["o_custkey"], "o_orderpriority", PRIORITIES, ["n"])


def _customer_prior(t: Tables):
    context = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), big("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    return shrinkage.peer_prior(_customer_mix(t), context, "o_custkey", "o_orderpriority", "n", "segment", "nation", len(PRIORITIES))


@query(
    "k9_peer_prior",
    f"""with {_CUSTOMER_MIX} select o_custkey, o_orderpriority, src prior_source, peers prior_peer_count, (sum(pool) over (partition by o_custkey))::bigint prior_peer_events,
          round(prior, 6) + 0.0 prior_probability from z""",
)
def _(t: Tables):
    return _customer_prior(t).select(
        "o_custkey", "o_orderpriority", "prior_source", "prior_peer_count", "prior_peer_events", r6("prior_probability").alias("prior_probability")
    )


@query(
    "k10_empirical_bayes",
    f"""with {_CUSTOMER_MIX} select o_custkey, o_orderpriority, round(prior, 6) + 0.0 prior_probability, round(post, 6) + 0.0 posterior_probability from y""",
)
def _(t: Tables):
    shrunk = shrinkage.empirical_bayes(_customer_mix(t), _customer_prior(t), "o_custkey", "o_orderpriority", "n", 20.0)
    return shrunk.select(
        "o_custkey", "o_orderpriority", r6("prior_probability").alias("prior_probability"), r6("posterior_probability").alias("posterior_probability")
    )


@query(
    "k11_model_pairing",
    f"""with {_CUSTOMER_MIX} select 'paired' place, count(*) row_count, round(sum(abs(prior - post)), 4) + 0.0 total_gap from y where o_custkey % 10 <> 0
        union all select 'one_sided', count(*), null from y where o_custkey % 10 = 0""",
)
def _(t: Tables):
    size = len(PRIORITIES)
    context = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), big("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    orders = mixes.vectors(t.orders, ["o_custkey"], "o_orderpriority", PRIORITIES, n=F.lit(1))
    prior = mixes.peer_prior(orders.join(context, "o_custkey"), "n", "segment", "nation", size)
    # The challenger does not predict every tenth customer.
    challenger = F.when(F.col("o_custkey") % 10 != 0, mixes.posterior(F.col("n"), F.col("prior"), 20.0))
    both = mixes.paired(prior.select(F.col("prior").alias("baseline"), challenger.alias("challenger")), "baseline", "challenger")
    return both.groupBy("place").agg((F.count("*") * size).alias("row_count"), r6(F.sum("gap"), 4).alias("total_gap"))


@query(
    "k12_ablation",
    f"""with {_LEVELS}, z as (select user_id, event_type, sum(exp(lp) / el * tot) zc from (select *, sum(exp(lp)) over (partition by user_id, environment) el from l) group by 1, 2)
        select event_type, round(sum(tc), 4) + 0.0 with_effects, round(sum(zc), 4) + 0.0 zero_effects, round(max(abs(tc - zc)), 6) + 0.0 largest_change
        from u join z using (user_id, event_type) group by 1""",
)
def _(t: Tables):
    keys = ["user_id", "event_type"]
    both = _translated(t).join(_translated(t, zero=True).withColumnRenamed("n", "z"), keys)
    return both.groupBy("event_type").agg(
        r6(F.sum("n"), 4).alias("with_effects"), r6(F.sum("z"), 4).alias("zero_effects"), r6(F.max(F.abs(F.col("n") - F.col("z")))).alias("largest_change")
    )


_FEATURES = """ft as (select user_id, avg(value) mv, count(*) cnt from events where ts < timestamp '2024-01-16' and event_type in ('view', 'click') group by 1),
  mo as (select avg(mv) m, stddev_pop(mv) s, avg(cnt) m2, stddev_pop(cnt) s2, count(*) k from ft where cnt >= 8)"""


def _features(t: Tables):
    before = t.events.where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")).where("event_type in ('view', 'click')")
    return before.groupBy("user_id").agg(F.avg("value").alias("mean_value"), F.count("*").alias("tracked"))


def _z_features(t: Tables):
    features = _features(t)
    eligible = F.col("tracked") >= 8
    fitted = fits.moments(features, ["mean_value", "tracked"], eligible)
    return fits.standardize(features, fitted, ["mean_value", "tracked"], eligible)


@query(
    "k13_subset_reweight",
    f"""with {_MIX}, {_FEATURES}, zz as (select user_id, (mv - m) / s z from ft, mo where cnt >= 8),
        b as (select s.*, z, event_type in ('view', 'click', 'purchase') sub, case event_type when 'view' then 0.2 when 'click' then -0.1 when 'purchase' then 0.15 end beta
          from s left join zz using (user_id)),
        v as (select *, case when sub then p * exp(beta * z) end ex from b)
        select user_id, event_type, round(coalesce(ex / sum(ex) over (partition by user_id) * sum(p) filter (sub) over (partition by user_id), p), 6) + 0.0 adjusted_probability,
          z is not null and sub adjusted from v""",
)
def _(t: Tables):
    rows = _smoothed(t).join(_z_features(t).select("user_id", "z_mean_value"), "user_id", "left")
    beta = fn.map_value(F.col("event_type"), {"view": 0.2, "click": -0.1, "purchase": 0.15})
    subset = F.col("event_type").isin("view", "click", "purchase")
    moved = composition.reweight_within(rows, ["user_id"], subset, "probability", beta * F.col("z_mean_value"))
    return moved.select(
        "user_id", "event_type", r6("adjusted_probability").alias("adjusted_probability"), (F.col("z_mean_value").isNotNull() & subset).alias("adjusted")
    )


@query(
    "k14_frozen_snapshot",
    f"""with {_LEVELS}, cx as (select user_id, user_id % 3 nar, user_id % 2 wid from (select distinct user_id from u)), r2 as (select u.*, nar, wid from u join cx using (user_id)),
        a as (select wid, nar, event_type, sum(tc) n, count(*) k from r2 group by 1, 2, 3), b as (select wid, event_type, sum(tc) n, count(*) k from r2 group by 1, 2),
        d as (select event_type, sum(tc) n, count(*) k from r2 group by 1),
        q as (select r2.*, case when a.k - 1 >= 12 then a.n when b.k > 1 then b.n else d.n end - tc pool from r2 join a using (wid, nar, event_type) join b using (wid, event_type) join d using (event_type)),
        z as (select *, (pool + 0.5) / (sum(pool) over (partition by user_id) + 2.5) prior from q)
        select user_id, event_type, round((tc + 100 * prior) / (sum(tc) over (partition by user_id) + 100), 6) + 0.0 posterior_probability from z""",
)
def _(t: Tables):
    context = _translated_mixes(t).withColumns({"narrow": F.col("user_id") % 3, "wide": F.col("user_id") % 2})
    prior = mixes.peer_prior(context, "n", "narrow", "wide", len(KINDS))
    shrunk = prior.withColumn("posterior", mixes.posterior(F.col("n"), F.col("prior"), 100.0))
    return mixes.unfolded(shrunk, ["user_id"], "event_type", KINDS, posterior_probability=F.transform("posterior", lambda x: r6(x)))


# --- standardisation and least squares ---------------------------------------------------------


@query(
    "m1_train_only_standardisation",
    f"""with {_FEATURES} select user_id, cnt tracked, case when cnt >= 8 then round((mv - m) / s, 6) + 0.0 end z_mean_value, case when cnt >= 8 then round((cnt - m2) / s2, 6) + 0.0 end z_tracked
        from ft, mo""",
)
def _(t: Tables):
    scored = _z_features(t)
    return scored.select("user_id", "tracked", r6("z_mean_value").alias("z_mean_value"), r6("z_tracked").alias("z_tracked"))


_FIT = """a as (select l_returnflag, avg((l_linestatus = 'O')::int) sb, avg(l_extendedprice) yb from lineitem {where} group by 1),
  b as (select sum(((l_linestatus = 'O')::int - sb) * l_extendedprice) / sum(pow((l_linestatus = 'O')::int - sb, 2)) bs from lineitem join a using (l_returnflag) {where}),
  f as (select l_returnflag, yb - bs * sb base from a, b)"""


def _cells(df):
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cell_count"), F.sum("l_extendedprice").alias("value_sum"))


@query(
    "m2_additive_effects",
    f"""with {_FIT.format(where='')}, r as (select base from f where l_returnflag = 'A') select 'intercept' factor, '' "level", round(base, 4) + 0.0 effect from r
        union all select 'l_linestatus', 'O', round(bs, 4) + 0.0 from b union all select 'l_linestatus', 'F', 0.0::double
        union all select 'l_returnflag', l_returnflag, round(f.base - r.base, 4) + 0.0 from f, r""",
)
def _(t: Tables):
    effects = fits.additive_effects(_cells(t.lineitem), "l_returnflag", "l_linestatus", ("A", "F"))
    return effects.withColumn("effect", r6("effect", 4))


@query(
    "m2_additive_prediction",
    f"""with {_FIT.format(where='')} select l_orderkey % 10 fold, count(*) row_count, round(avg(base + bs * (l_linestatus = 'O')::int), 4) + 0.0 mean_fitted,
          round(avg(l_extendedprice - base - bs * (l_linestatus = 'O')::int), 4) + 0.0 mean_residual from lineitem join f using (l_returnflag), b group by 1""",
)
def _(t: Tables):
    effects = fits.additive_effects(_cells(t.lineitem), "l_returnflag", "l_linestatus", ("A", "F"))
    rows = fits.predict_additive(t.lineitem, effects, "l_returnflag", "l_linestatus")
    return rows.groupBy((F.col("l_orderkey") % 10).alias("fold")).agg(
        F.count("*").alias("row_count"),
        r6(F.avg("fitted"), 4).alias("mean_fitted"),
        r6(F.avg(F.col("l_extendedprice") - F.col("fitted")), 4).alias("mean_residual"),
    )


_TRAIN = f"""{_FEATURES}, fu as (select user_id, avg(value) y, count(*) w from events where ts >= timestamp '2024-01-16' group by 1),
  tr as (select user_id, (mv - m) / s x1, (cnt - m2) / s2 x2, y - 50 y, w from ft join fu using (user_id), mo where cnt >= 8)"""


def _training(t: Tables):
    after = t.events.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")).groupBy("user_id").agg((F.avg("value") - 50).alias("y"), F.count("*").alias("w"))
    return _z_features(t).where("z_mean_value is not null").join(after, "user_id")


@query(
    "m3_two_feature_slopes",
    f"""with {_TRAIN}, q as (select sum(w * x1 * x1) a, sum(w * x1 * x2) b, sum(w * x2 * x2) c, sum(w * x1 * y) d, sum(w * x2 * y) e, count(*) n, sum(w)::bigint sw from tr)
        select round((d * c - e * b) / (a * c - b * b), 6) + 0.0 beta_1, round((a * e - b * d) / (a * c - b * b), 6) + 0.0 beta_2, n fitted_row_count, sw fitted_weight from q""",
)
def _(t: Tables):
    fit = fits.two_feature_slopes(_training(t), "z_mean_value", "z_tracked", "y", "w")
    return fit.select(r6("beta_1").alias("beta_1"), r6("beta_2").alias("beta_2"), "fitted_row_count", "fitted_weight")


@query(
    "m4_leakage_safe_prediction",
    f"""with {_FIT.format(where="where l_shipdate < timestamp '1998-01-01'")}, p as (select l_suppkey, l_extendedprice - base - bs * (l_linestatus = 'O')::int r from lineitem join f using (l_returnflag), b
          where l_shipdate >= timestamp '1998-01-01'), h as (select l_suppkey, avg(l_extendedprice - base - bs * (l_linestatus = 'O')::int) pr, count(*) pn from lineitem join f using (l_returnflag), b
          where l_shipdate < timestamp '1998-01-01' group by 1)
        select l_suppkey, count(*) target_count, pn prior_count, round(pr, 3) + 0.0 prior_residual, round(avg(r), 3) + 0.0 target_residual from p join h using (l_suppkey) group by 1, 3, 4""",
)
def _(t: Tables):
    cutoff = F.lit("1998-01-01").cast("timestamp_ntz")
    lines = t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", (F.col("l_shipdate") < cutoff).alias("past"))
    effects = fits.additive_effects(_cells(lines.where("past")), "l_returnflag", "l_linestatus", ("A", "F"))
    scored = fits.predict_additive(lines, effects, "l_returnflag", "l_linestatus").withColumn("residual", F.col("l_extendedprice") - F.col("fitted"))
    per = scored.groupBy("l_suppkey").agg(
        F.count_if(~F.col("past")).alias("target_count"),
        F.count_if("past").alias("prior_count"),
        r6(F.avg(F.when(F.col("past"), F.col("residual"))), 3).alias("prior_residual"),
        r6(F.avg(F.when(~F.col("past"), F.col("residual"))), 3).alias("target_residual"),
    )
    return per.where("target_count > 0 and prior_count > 0")


@query(
    "m5_target_materialisation",
    """with u as (select l_orderkey, l_linenumber, any_value(l_partkey) l_partkey, any_value(l_extendedprice) price from lineitem group by 1, 2 having count(*) = 1)
       select p_brand, o_orderpriority, count(*) target_count, round(sum(price), 2) + 0.0 target_value from u join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by 1, 2""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    contacts = lookup.without_ambiguous(rows, ["l_orderkey", "l_linenumber"])
    terminal = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    kinds = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = contacts.join(terminal, "l_orderkey").join(kinds, "l_partkey")
    return joined.groupBy("p_brand", "o_orderpriority").agg(
        F.count("*").alias("target_count"), r6(F.sum("l_extendedprice"), 2).alias("target_value")
    )


def _bounded_steps(steps: int) -> str:
    """Chained steps of a two-feature multinomial fit over ``dt(user_id, event_type, o, y, n, x1, x2)``.

    Each step divides the gradient by a fixed upper bound of the curvature (half the weighted second
    moments of the features, plus the penalty), which never overshoots.
    """
    parts = ["""mm as (select 0.5 * sum(n * x1 * x1) / sum(n) + 0.01 a, 0.5 * sum(n * x1 * x2) / sum(n) c, 0.5 * sum(n * x2 * x2) / sum(n) + 0.01 d, sum(n) tot
      from dt where event_type = 'view')""", "i0 as (select distinct event_type, 0.0::double b1, 0.0::double b2 from dt)"]
    for k in range(steps):
        parts.append(
            f"""i{k + 1} as materialized (select event_type, b1 - (d * g1 - c * g2) / (a * d - c * c) b1, b2 - (a * g2 - c * g1) / (a * d - c * c) b2 from (
              select event_type, any_value(b1) b1, any_value(b2) b2, sum((n * p - y) * x1) / any_value(tot) + 0.01 * any_value(b1) g1,
                sum((n * p - y) * x2) / any_value(tot) + 0.01 * any_value(b2) g2 from (
                select *, e / sum(e) over (partition by user_id) p from (select *, exp(o + b1 * x1 + b2 * x2) e from dt join i{k} using (event_type))), mm group by 1), mm)"""
        )
    return ", ".join(parts)


@query(
    "m6_offset_multinomial",
    f"""with {_MIX}, {_FEATURES}, zz as (select user_id, (mv - m) / s x1, (cnt - m2) / s2 x2 from ft, mo where cnt >= 8),
        fu as (select user_id, event_type, count(*) y from events where ts >= timestamp '2024-01-16' group by 1, 2),
        dt as materialized (select s.user_id, s.event_type, ln(p) o, coalesce(y, 0)::double y, sum(coalesce(y, 0)) over (partition by s.user_id)::double n, x1, x2
          from s join zz using (user_id) left join fu using (user_id, event_type)), {_bounded_steps(40)}
        select event_type, unnest(['z_mean_value', 'z_tracked']) feature, round(unnest([b1, b2]), 4) + 0.0 coefficient, 'converged' fit_status from i40""",
)
def _(t: Tables):
    after = t.events.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    future = after.groupBy("user_id", "event_type").agg(F.count("*").alias("future"))
    rows = _smoothed(t).join(_z_features(t).where("z_mean_value is not null"), "user_id").join(future, ["user_id", "event_type"], "left").fillna(0, subset=["future"])
    table = fits.offset_multinomial(
        rows.withColumn("offset", F.log("probability")), ["user_id"], "event_type", KINDS, "offset", "future", ["z_mean_value", "z_tracked"]
    )
    return table.select("event_type", "feature", r6("coefficient", 4).alias("coefficient"), "fit_status")


@query(
    "m7_weighted_ridge",
    """with c as (select c_custkey, c_acctbal / 1000 x1, c_nationkey::double x2, n w, avg_p / 1000 y1, urgent / n y2 from customer join (select o_custkey, count(*) n, avg(o_totalprice) avg_p,
         sum((o_orderpriority = '1-URGENT')::int) urgent from orders group by 1) on o_custkey = c_custkey),
       m as (select sum(w * x1) / sum(w) m1, sum(w * x2) / sum(w) m2, sum(w * y1) / sum(w) ym1, sum(w * y2) / sum(w) ym2, sum(w) sw from c),
       s as (select sqrt(sum(w * pow(x1 - m1, 2)) / any_value(sw)) s1, sqrt(sum(w * pow(x2 - m2, 2)) / any_value(sw)) s2 from c, m),
       z as (select sum(w * (x1 - m1) / s1 * (x2 - m2) / s2) / any_value(sw) g, sum(w * (x1 - m1) / s1 * y1) / any_value(sw) a1, sum(w * (x2 - m2) / s2 * y1) / any_value(sw) b1,
         sum(w * (x1 - m1) / s1 * y2) / any_value(sw) a2, sum(w * (x2 - m2) / s2 * y2) / any_value(sw) b2 from c, m, s)
       select unnest(['y1', 'y1', 'y1', 'y2', 'y2', 'y2']) response, unnest(['intercept', 'balance', 'nation', 'intercept', 'balance', 'nation']) feature,
         round(unnest([ym1, (a1 * 1.01 - b1 * g) / (1.01 * 1.01 - g * g), (b1 * 1.01 - a1 * g) / (1.01 * 1.01 - g * g), ym2, (a2 * 1.01 - b2 * g) / (1.01 * 1.01 - g * g),
         (b2 * 1.01 - a2 * g) / (1.01 * 1.01 - g * g)]), 6) + 0.0 coefficient from m, s, z""",
)
def _(t: Tables):
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("w"), (F.avg("o_totalprice") / 1000).alias("y1"), (F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("y2")
    )
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), F.col("c_nationkey").cast("double").alias("nation")).join(orders, "c_custkey")
    fit = fits.weighted_ridge(rows, ["balance", "nation"], ["y1", "y2"], "w", 0.01)
    return fit.select("response", "feature", r6("coefficient").alias("coefficient"))


_AFTER = f"""k2 as (select unnest({KIND_LIST}) event_type), c2 as (select user_id, event_type, count(*) n from events where ts >= timestamp '2024-01-16' group by 1, 2),
  g2 as (select user_id, event_type, coalesce(n, 0) n from (select distinct user_id from c2) cross join k2 left join c2 using (user_id, event_type)),
  s2 as (select *, (n + 0.5) / (sum(n) over (partition by user_id) + 2.5) p from g2)"""


@query(
    "m8_mix_delta",
    f"""with {_MIX}, {_AFTER}, a as (select user_id, event_type, ln(p) - avg(ln(p)) over (partition by user_id) v from s),
        b as (select user_id, event_type, ln(p) - avg(ln(p)) over (partition by user_id) v from s2),
        d as (select event_type, avg(b.v - a.v) dl from a join b using (user_id, event_type) group by 1),
        e as (select a.user_id, event_type, exp(v + dl) ex from a join d using (event_type))
        select user_id, event_type category, round(ex / sum(ex) over (partition by user_id), 6) + 0.0 probability from e""",
)
def _(t: Tables):
    """Mean coordinate change from the snapshot to the future mix, added back to every snapshot."""
    after = t.events.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    full = season.complete(after, ["user_id"], "event_type", KINDS, ["n"])
    future = composition.softmax(composition.centered_log_ratio(full, ["user_id"], "n", len(KINDS)), ["user_id"], "clr")
    names = [f"ilr_{j}" for j in range(1, len(KINDS))]
    now = composition.isometric_log_ratio(_smoothed(t), ["user_id"], "event_type", "probability", KINDS)
    then = composition.isometric_log_ratio(future, ["user_id"], "event_type", "probability", KINDS)
    delta = now.join(then.withColumnsRenamed({n: f"next_{n}" for n in names}), "user_id")
    mean = delta.agg(*[F.avg(F.col(f"next_{n}") - F.col(n)).alias(f"delta_{n}") for n in names])
    moved = lookup.attach_total(now, mean).select("user_id", *[(F.col(n) + F.col(f"delta_{n}")).alias(n) for n in names])
    return composition.inverse_isometric(moved, ["user_id"], KINDS).withColumn("probability", r6("probability"))


# --- participation, counts, calibration --------------------------------------------------------

_DESIGN = """ds as (select c_custkey, case when c_nationkey < 5 then 'AAA' when c_nationkey < 10 then 'AA' when c_nationkey < 15 then 'A_OR_BELOW' else 'MLB' end tier,
    (c_acctbal / 1000 - 25) / 5 age_centered, ln(1 + coalesce(b, 0)) log_before, coalesce(a, 0) y from customer left join (select o_custkey,
    count(*) filter (o_orderdate < timestamp '2000-07-01') b, count(*) filter (o_orderdate >= timestamp '2000-07-01') a from orders group by 1) on o_custkey = c_custkey)"""


def _design(t: Tables):
    later = F.col("o_orderdate") >= F.lit("2000-07-01").cast("timestamp_ntz")
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(~later).alias("before"), F.count_if(later).alias("y"))
    rows = lookup.with_counts(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), counts, ["c_custkey"])
    tier = fn.bands(F.col("c_nationkey"), [5, 10, 15], ["AAA", "AA", "A_OR_BELOW", "MLB"])
    return rows.select(
        "c_custkey",
        tier.alias("tier"),
        ((F.col("c_acctbal") / 1000 - 25.0) / 5.0).alias("age_centered"),
        F.log1p("before").alias("log_before"),
        *[(tier == v).cast("double").alias(f"level_{v.lower()}") for v in ("AAA", "AA", "A_OR_BELOW")],
        "y",
    )


@query(
    "m9_participation_design",
    f"""with {_DESIGN} select tier, count(*) row_count, sum((y > 0)::int)::bigint participants, round(avg(age_centered), 6) + 0.0 mean_age_centered, round(avg(log_before), 6) + 0.0 mean_log_before
        from ds group by 1""",
)
def _(t: Tables):
    return _design(t).groupBy("tier").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("y") > 0).alias("participants"),
        r6(F.avg("age_centered")).alias("mean_age_centered"),
        r6(F.avg("log_before")).alias("mean_log_before"),
    )


def _newton(data: str, steps: int, slope_penalty: float) -> str:
    """Chained Newton steps of a one-feature logistic fit over ``data(x, y, n, grp)``."""
    parts = ["i0 as (select distinct grp, 0.0::double b0, %s::double b1 from %s)" % ("0.0" if slope_penalty else "1.0", data)]
    for k in range(steps):
        parts.append(
            f"""i{k + 1} as (select grp, b0 + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) b1 from (
              select grp, any_value(b0) b0, any_value(b1) b1, sum(y - n * p) g0, sum((y - n * p) * x) - {slope_penalty} * any_value(b1) g1, sum(n * p * (1 - p)) h00,
                sum(n * p * (1 - p) * x) h01, sum(n * p * (1 - p) * x * x) + {slope_penalty} h11 from (select *, 1 / (1 + exp(-(b0 + b1 * x))) p from {data} join i{k} using (grp)) group by 1))"""
        )
    return ", ".join(parts)


@query(
    "m10_participation_fit",
    f"""with {_DESIGN}, dt as materialized (select 1 grp, log_before x, (y > 0)::int::double y, 1.0::double n from ds), {_newton('dt', 8, 1.0)}
        select 'intercept' feature, round(b0, 4) + 0.0 coefficient, 'converged' fit_status from i8 union all select 'log_before', round(b1, 4) + 0.0, 'converged' from i8""",
)
def _(t: Tables):
    rows = _design(t).withColumn("participates", F.col("y") > 0)
    fitted = fits.participation_model(rows, ["log_before"], "participates")
    return fitted.select("feature", r6("coefficient", 4).alias("coefficient"), "fit_status")


PARTICIPATION = {"intercept": -0.4, "log_before": 0.5, "level_aaa": 0.1, "level_aa": -0.2}
POSITIVE = {"intercept": 0.3, "log_before": 0.2, "age_centered": 0.05}
DISPERSION = 0.7461189032566083
_HURDLE = f"""{_DESIGN}, e as (select *, -0.4 + 0.5 * log_before + 0.1 * (tier = 'AAA')::int - 0.2 * (tier = 'AA')::int eta, exp(0.3 + 0.2 * log_before + 0.05 * age_centered) mu,
    1 / {DISPERSION} sz from ds), p as (select *, 1 / (1 + exp(-eta)) q, sz / (sz + mu) pr from e), h as (select *, pow(pr, sz) p0, mu / (1 - pow(pr, sz)) pm from p),
  o as (select *, q * pm ec, case when y > 0 then -ln(q) else -ln(1 - q) end pn, case when y > 0 then -(lgamma(y + sz) - lgamma(sz) - lgamma(y + 1) + sz * ln(pr) + y * ln(1 - pr) - ln(1 - p0)) end cn from h)"""


def _hurdle(t: Tables):
    return fits.hurdle_scores(_design(t), fits.linear_columns(PARTICIPATION), F.exp(fits.linear_columns(POSITIVE)), DISPERSION, "y")


@query(
    "m11_hurdle_scores",
    f"""with {_HURDLE} select c_custkey, round(q, 6) + 0.0 participation_probability, round(pm, 6) + 0.0 positive_mean, round(ec, 6) + 0.0 expected_count, round(pn, 6) + 0.0 participation_nll,
          round(cn, 6) + 0.0 positive_nll, round(pn + coalesce(cn, 0), 6) + 0.0 full_nll from o""",
)
def _(t: Tables):
    names = ["participation_probability", "positive_mean", "expected_count", "participation_nll", "positive_nll", "full_nll"]
    return _hurdle(t).select("c_custkey", *[r6(n).alias(n) for n in names])


@query(
    "m11_hurdle_metrics",
    f"""with {_HURDLE} select count(*) scored, sum((y > 0)::int)::bigint positive, round(avg(pn + coalesce(cn, 0)), 6) + 0.0 mean_full_nll, round(avg(pn), 6) + 0.0 participation_log_loss,
          round(avg(pow(q - (y > 0)::int, 2)), 6) + 0.0 participation_brier, round(avg(cn), 6) + 0.0 positive_nll, round(avg(abs(ec - y)), 6) + 0.0 mae, round(sqrt(avg(pow(ec - y, 2))), 6) + 0.0 rmse from o""",
)
def _(t: Tables):
    hit = (F.col("y") > 0).cast("double")
    error = F.col("expected_count") - F.col("y")
    return _hurdle(t).agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("y") > 0).alias("positive"),
        r6(F.avg("full_nll")).alias("mean_full_nll"),
        r6(F.avg("participation_nll")).alias("participation_log_loss"),
        r6(F.avg((F.col("participation_probability") - hit) * (F.col("participation_probability") - hit))).alias("participation_brier"),
        r6(F.avg("positive_nll")).alias("positive_nll"),
        r6(F.avg(F.abs(error))).alias("mae"),
        r6(F.sqrt(F.avg(error * error))).alias("rmse"),
    )


@query(
    "m12_calibration_lines",
    f"""with {_MIX}, f as (select user_id, event_type, count(*) y from events where ts >= timestamp '2024-01-16' group by 1, 2), tt as (select user_id, sum(y) n from f group by 1),
        dt as materialized (select event_type grp, ln(p / (1 - p)) x, coalesce(y, 0)::double y, tt.n::double n from s join tt using (user_id) left join f using (user_id, event_type)),
        {_newton('dt', 10, 0.0)} select grp event_type, round(b0, 4) + 0.0 calibration_intercept, round(b1, 4) + 0.0 calibration_slope, 'converged' fit_status from i10""",
)
def _(t: Tables):
    after = t.events.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")).groupBy("user_id", "event_type").agg(F.count("*").alias("y"))
    totals = after.groupBy("user_id").agg(F.sum("y").alias("trials"))
    rows = _smoothed(t).join(totals, "user_id").join(after, ["user_id", "event_type"], "left").fillna(0, subset=["y"])
    lines = fits.calibration_lines(rows, ["event_type"], "probability", "y", "trials")
    return lines.select(
        "event_type", r6("calibration_intercept", 4).alias("calibration_intercept"), r6("calibration_slope", 4).alias("calibration_slope"), "fit_status"
    )


# --- roles and rates ---------------------------------------------------------------------------

_ROLE_MOVE = """h as (select user_id, ts::date < date '2024-01-16' early, event_type, count(*) n from events group by 1, 2, 3),
  s as (select *, n / sum(n) over (partition by user_id, early) sh, row_number() over (partition by user_id, early order by n desc, event_type) rn from h),
  pr as (select user_id, event_type prim, sh psh from s where early and rn = 1), nx as (select user_id, event_type, sh from s where not early),
  mv as (select distinct user_id, prim from nx join pr using (user_id)), mk as (select prim, count(*) k from mv group by 1),
  d0 as (select prim, event_type, sum(sh) / any_value(k) m from nx join pr using (user_id) join mk using (prim) group by 1, 2),
  dm as (select prim, event_type, m / sum(m) over (partition by prim) ds from d0)"""


def _role_parts(t: Tables):
    early = F.to_date("ts") < asof.as_date(CUTOFF)
    halves = t.events.select("user_id", early.alias("early"), "event_type")
    now = profile.shares(halves.where("early"), ["user_id"], "event_type", F.lit(1).cast("bigint"), "role_share")
    then = profile.shares(halves.where("not early"), ["user_id"], "event_type", F.lit(1).cast("bigint"), "role_share")
    _shares, primary = season.role_profile(
        now.withColumn("starts", F.col("amount")).withColumnRenamed("amount", "games"), ["user_id"], "event_type", "starts", "games", [F.asc("event_type")]
    )
    means = rates.destination_means(primary, then, "user_id", "primary_role", "event_type", "role_share")
    return now, then, primary, means


@query(
    "m13_destination_means",
    f"with {_ROLE_MOVE} select prim primary_role, event_type, round(ds, 6) + 0.0 destination_share, k entity_count from dm join mk using (prim)",
)
def _(t: Tables):
    _now, _then, _primary, means = _role_parts(t)
    return means.withColumn("destination_share", r6("destination_share"))


@query(
    "m13_blended_role_errors",
    f"""with {_ROLE_MOVE}, kk as (select unnest({KIND_LIST}) event_type), cu as (select user_id, event_type, sh from s where early),
        bl as (select pr.user_id, kk.event_type, case when psh >= 0.3 then psh * coalesce(cu.sh, 0) + (1 - psh) * coalesce(ds, 0) else coalesce(cu.sh, 0) end b from pr cross join kk
          left join cu on cu.user_id = pr.user_id and cu.event_type = kk.event_type left join dm on dm.prim = pr.prim and dm.event_type = kk.event_type),
        pd as (select user_id, event_type, b / sum(b) over (partition by user_id) p from bl),
        er as (select user_id, sum(abs(p - coalesce(nx.sh, 0))) / 2 tv, sum(pow(p - coalesce(nx.sh, 0), 2)) se from pd left join nx using (user_id, event_type)
          where user_id in (select user_id from nx) group by 1)
        select user_id, round(tv, 6) + 0.0 total_variation, round(se, 6) + 0.0 squared_error from er""",
)
def _(t: Tables):
    now, then, primary, means = _role_parts(t)
    predicted = rates.blended_roles(now, primary, means, "user_id", "primary_role", "event_type", "role_share", 0.3)
    errors = rates.role_errors(predicted, then, "user_id", "event_type", "role_share")
    return errors.select("user_id", r6("total_variation").alias("total_variation"), r6("squared_error").alias("squared_error"))


_WEEKS = f"""ev as (select user_id, (ts::date - date '2024-01-01') // 7 wk, {BAND_SQL} env, case when {BAND_SQL} = 'night' then 'off' else 'on' end lv, event_type = 'purchase' s from events),
  ow as (select user_id, wk, env, lv, count(*) n, sum(s::int) s from ev group by 1, 2, 3, 4),
  lo as (select *, sum(n) over e - n en, sum(s) over e - s es, sum(n) over l - sum(n) over m ln, sum(s) over l - sum(s) over m ls from ow
    window e as (partition by wk, env, lv), l as (partition by wk, lv), m as (partition by user_id, wk, lv)),
  ex as (select *, case when lv = 'on' or en >= 500 then es / en else ls / ln end br, case when lv = 'on' or en >= 500 then 'environment' else 'level' end src from lo),
  pw as (select user_id, wk, sum(n)::double n, sum(s)::double s, sum(n * br) e from ex group by 1, 2),
  hh as (select a.user_id, a.wk, a.n, a.s, a.e, coalesce(sum(b.s * w.w), 0) hs, coalesce(sum(b.e * w.w), 0) he, coalesce(sum(b.n * w.w), 0) hn from pw a
    left join (values (1, 1.0), (2, 0.5), (3, 0.25)) w(bk, w) on true left join pw b on b.user_id = a.user_id and b.wk = a.wk - w.bk group by 1, 2, 3, 4, 5)"""


def _weekly(t: Tables):
    week = F.floor(F.datediff(F.to_date("ts"), asof.as_date("2024-01-01")) / 7)
    band = _band()
    stints = t.events.select(
        "user_id",
        week.alias("week"),
        band.alias("environment"),
        F.when(band == "night", "off").otherwise("on").alias("level"),
        F.lit(1).cast("bigint").alias("chance"),
        (F.col("event_type") == "purchase").cast("bigint").alias("success"),
    )
    return rates.leave_one_out_rates(stints, "user_id", "week", "environment", "level", "chance", "success", 500, F.col("level") == "on")


def _weekly_history(t: Tables):
    weeks = _weekly(t).groupBy("user_id", "week").agg(
        F.sum("n").cast("double").alias("n"), F.sum("s").cast("double").alias("s"), F.sum("expected").alias("e")
    )
    return rates.weighted_history(weeks, ["user_id"], "week", ["n", "s", "e"])


@query(
    "m14_leave_one_out_rates",
    f"""with {_WEEKS} select user_id, wk "week", env environment, lv "level", n, s::bigint s, round(br, 6) + 0.0 baseline_rate, src baseline_source, round(n * br, 6) + 0.0 expected from ex""",
)
def _(t: Tables):
    return _weekly(t).select(
        "user_id", "week", "environment", "level", "n", "s", r6("baseline_rate").alias("baseline_rate"), "baseline_source", r6("expected").alias("expected")
    )


@query(
    "m14_history_projection",
    f"""with {_WEEKS}, c as (select *, least(1 - 1e-9, greatest(1e-9, he / nullif(hn, 0))) b from hh), d as (select *, least(1 - 1e-9, greatest(1e-9, (15 * b + hs) / (15 + hn))) q from c)
        select user_id, wk "week", round(case when he > 0 then (15 + hs) / (15 + he) else 1 end, 6) + 0.0 multiplier,
          round(case when hn > 0 then ln(q / (1 - q)) - ln(b / (1 - b)) else 0 end, 6) + 0.0 log_odds_residual from d""",
)
def _(t: Tables):
    rows = _weekly_history(t)
    multiplier = rates.count_multiplier(F.col("history_s"), F.col("history_e"), 15.0)
    residual = rates.log_odds_residual(F.col("history_s"), F.col("history_n"), F.col("history_e"), 15.0)
    return rows.select("user_id", "week", r6(multiplier).alias("multiplier"), r6(residual).alias("log_odds_residual"))


@query(
    "m15_advancement_rate",
    """with y as (select user_id, (ts::date - date '2024-01-01') // 7 wk, sum(value - 50) a, count(*)::double n from events group by 1, 2)
       select a.user_id, a.wk "week", round(case when coalesce(sum(b.n * w), 0) > 0 then sum(b.a * w) / (30 + sum(b.n * w)) else 0 end, 6) + 0.0 projected_rate from y a
       left join (values (1, 1.0), (2, 0.5), (3, 0.25)) w(bk, w) on true left join y b on b.user_id = a.user_id and b.wk = a.wk - bk group by 1, 2""",
)
def _(t: Tables):
    week = F.floor(F.datediff(F.to_date("ts"), asof.as_date("2024-01-01")) / 7)
    weeks = t.events.groupBy("user_id", week.alias("week")).agg(F.sum(F.col("value") - 50).alias("amount"), F.count("*").cast("double").alias("n"))
    rows = rates.weighted_history(weeks, ["user_id"], "week", ["amount", "n"])
    return rows.select("user_id", "week", r6(rates.shrunk_rate(F.col("history_amount"), F.col("history_n"), 30.0)).alias("projected_rate"))


@query(
    "m16_fallback_moments",
    """with g as (select *, count(*) over a n0, avg(p_retailprice) over a m0, stddev_pop(p_retailprice) over a s0, count(*) over b n1, avg(p_retailprice) over b m1, stddev_pop(p_retailprice) over b s1,
         avg(p_retailprice) over () m2, stddev_pop(p_retailprice) over () s2 from part window a as (partition by p_brand, p_type), b as (partition by p_brand)),
       n as (select *, case when n0 >= 18 and s0 > 1e-12 then 0 when n1 >= 18 and s1 > 1e-12 then 1 else 2 end k from g)
       select p_partkey, case k when 0 then 'p_brand_p_type' when 1 then 'p_brand' else 'all' end norm_grain,
         round((p_retailprice - case k when 0 then m0 when 1 then m1 else m2 end) / case k when 0 then s0 when 1 then s1 else s2 end, 6) + 0.0 z from n""",
)
def _(t: Tables):
    rows = rates.fallback_moments(t.part, [["p_brand", "p_type"], ["p_brand"], []], "p_retailprice", 18)
    return rows.select("p_partkey", "norm_grain", r6((F.col("p_retailprice") - F.col("norm_mean")) / F.col("norm_sd")).alias("z"))


@query(
    "m16_skill_ladder",
    """with l as (select l_suppkey, count(*) n, sum(l_quantity) q, count(*) filter (l_returnflag = 'R') r, sum(l_discount) d from lineitem group by 1),
       s as (select *, (q / n - 25) / 5 z, s_acctbal from l join supplier on s_suppkey = l_suppkey)
       select l_suppkey, case when n < 50 then 'B0' when s_acctbal > 5000 then 'T1' when r > 0 then 'U1' else 'B0' end skill_family,
         round(case when n < 50 then 0 when s_acctbal > 5000 then 0.1 + 0.4 * z + 0.2 * s_acctbal / 10000 when r > 0 then 0.05 + 0.3 * z else 0 end, 6) + 0.0 skill from s""",
)
def _(t: Tables):
    lines = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("z", (F.col("q") / F.col("n") - 25) / 5)
    enough = F.col("n") >= 50
    ladder = rates.skill_ladder(
        rows,
        [
            ("T1", enough & (F.col("s_acctbal") > 5000), 0.1 + 0.4 * F.col("z") + 0.2 * F.col("s_acctbal") / 10000),
            ("U1", enough & (F.col("r") > 0), 0.05 + 0.3 * F.col("z")),
        ],
        "B0",
    )
    return ladder.select("l_suppkey", "skill_family", r6("skill").alias("skill"))


@query(
    "m16_prior_season_blend",
    """with y as (select l_suppkey, year(l_shipdate) y, avg(l_discount) f, count(*) n from lineitem group by 1, 2)
       select a.l_suppkey, a.y ship_year, round(case when b.f is not null then (a.n * a.f + 0.5 * b.n * b.f) / (a.n + 0.5 * b.n) else a.f end, 6) + 0.0 feature from y a
       left join y b on b.l_suppkey = a.l_suppkey and b.y = a.y - 1""",
)
def _(t: Tables):
    years = t.lineitem.groupBy("l_suppkey", big(F.year("l_shipdate")).alias("ship_year")).agg(F.avg("l_discount").alias("f"), F.count("*").alias("n"))
    rows = lookup.with_prior(years, ["l_suppkey"], "ship_year", ["f", "n"])
    blend = rates.blended_feature(F.col("f"), F.col("n"), F.col("prior_f"), F.col("prior_n"), 0.5)
    return rows.select("l_suppkey", "ship_year", r6(blend).alias("feature"))


@query(
    "m17_rate_rollup",
    """select l_suppkey, year(l_shipdate) ship_year, count(*) line_count, sum(l_quantity)::bigint chances, round(27.0 * sum((l_returnflag = 'R')::int) / sum(l_quantity), 6) + 0.0 returns_per_27,
         case when sum((l_linestatus = 'F')::int) > 0 then round(sum((l_returnflag = 'A' and l_linestatus = 'F')::int) / sum((l_linestatus = 'F')::int), 6) + 0.0 end accepted_rate, max(l_linestatus) highest_status
       from lineitem group by 1, 2""",
)
def _(t: Tables):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    sums = t.lineitem.groupBy("l_suppkey", big(F.year("l_shipdate")).alias("ship_year")).agg(
        F.count("*").alias("line_count"),
        big(F.sum("l_quantity")).alias("chances"),
        F.count_if(flag == "R").alias("returns"),
        F.count_if(status == "F").alias("finished"),
        F.count_if((flag == "A") & (status == "F")).alias("accepted"),
        F.max(status).alias("highest_status"),
    )
    return sums.select(
        "l_suppkey",
        "ship_year",
        "line_count",
        "chances",
        r6(fn.ratio(27.0 * F.col("returns"), F.col("chances"))).alias("returns_per_27"),
        r6(fn.ratio(F.col("accepted"), F.col("finished"))).alias("accepted_rate"),
        "highest_status",
    )


_FORECAST = """y as (select o_custkey, year(o_orderdate) y, sum(o_totalprice) s, count(*) n from orders group by 1, 2),
  f as (select a.o_custkey, a.y, a.s prior, coalesce(b.s, 0) obs, a.n n0, coalesce(b.n, 0) n1 from y a left join y b on b.o_custkey = a.o_custkey and b.y = a.y + 1),
  g as (select *, prior persistence, prior * n1 / n0 exposure_ratio, 0.5 * prior + 0.5 * prior * n1 / n0 half_and_half from f),
  l as (select y, obs, unnest(['persistence', 'exposure_ratio', 'half_and_half']) form, unnest([persistence, exposure_ratio, half_and_half]) - obs e from g),
  er as (select y fold_year, form, count(*) row_count, avg(abs(e)) mae, sqrt(avg(e * e)) rmse, avg(abs(e)) filter (obs > 0) continuing_mae from l group by 1, 2)"""


def forecast_error_table(t: Tables):
    years = t.orders.groupBy("o_custkey", big(F.year("o_orderdate")).alias("fold_year")).agg(F.sum("o_totalprice").alias("prior"), F.count("*").alias("now"))
    following = years.select("o_custkey", (F.col("fold_year") - 1).alias("fold_year"), F.col("prior").alias("observed"), F.col("now").alias("next"))
    rows = years.join(following, ["o_custkey", "fold_year"], "left").fillna(0, subset=["observed", "next"])
    forecasts = rates.opportunity_forecasts(rows, "prior", "now", "next")
    return rates.forecast_errors(forecasts, ["fold_year"], ["persistence", "exposure_ratio", "half_and_half"], "observed")


FORECAST_SQL = _FORECAST


@query(
    "m18_forecast_errors",
    f"with {_FORECAST} select fold_year, form, row_count, round(mae, 2) + 0.0 mae, round(rmse, 2) + 0.0 rmse, round(continuing_mae, 2) + 0.0 continuing_mae from er",
)
def _(t: Tables):
    errors = forecast_error_table(t)
    return errors.select("fold_year", "form", "row_count", *[r6(c, 2).alias(c) for c in ("mae", "rmse", "continuing_mae")])


_SHARES = """h as (select user_id, event_type, count(*) filter (ts < timestamp '2024-01-16') a, count(*) filter (ts >= timestamp '2024-01-16') b from events group by 1, 2),
  s as (select *, a / nullif(sum(a) over (partition by user_id), 0) pa, b / nullif(sum(b) over (partition by user_id), 0) pb from h),
  m as (select *, 0.5 * coalesce(pa, 0) + 0.5 * coalesce(pb, 0) x from s), t as (select user_id, sum(value) v from events group by 1),
  q as (select user_id, event_type, x / sum(x) over (partition by user_id) sh, v from m join t using (user_id))"""


def _allocated(t: Tables):
    early = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    rows = t.events.select("user_id", "event_type", early.cast("bigint").alias("a"), (~early).cast("bigint").alias("b"))
    keys = ["user_id", "event_type"]
    first = profile.shares(rows, ["user_id"], "event_type", F.col("a"), "first_share").select(*keys, "first_share")
    second = profile.shares(rows, ["user_id"], "event_type", F.col("b"), "second_share").select(*keys, "second_share")
    totals = t.events.groupBy("user_id").agg(F.sum("value").alias("value_total"))
    return rates.allocate(first.join(second, keys), totals, "user_id", "event_type", "first_share", "second_share", "value_total")


@query("m19_blended_shares", f"with {_SHARES} select user_id, event_type, round(sh, 6) + 0.0 blended_share from q")
def _(t: Tables):
    return _allocated(t).select("user_id", "event_type", r6("blended_share").alias("blended_share"))


@query(
    "m19_share_allocation",
    f"with {_SHARES} select event_type, count(*) user_count, round(sum(sh * v), 2) + 0.0 allocated, round(max(sh * v), 2) + 0.0 largest from q group by 1",
)
def _(t: Tables):
    return _allocated(t).groupBy("event_type").agg(
        F.count("*").alias("user_count"), r6(F.sum("allocated"), 2).alias("allocated"), r6(F.max("allocated"), 2).alias("largest")
    )


_NATIVE = """z as (select year(l_shipdate) y, l_returnflag, l_quantity q, l_extendedprice t, (l_discount - avg(l_discount) over w) / stddev_pop(l_discount) over w z from lineitem
    window w as (partition by year(l_shipdate), l_returnflag)),
  s as (select y, count(*) n, sum(z * q * t) / sum(z * q * z * q) k, sum(t * t) tt, sum(z * q * t) xt from z group by 1)"""


def _native(t: Tables):
    rows = t.lineitem.select(big(F.year("l_shipdate")).alias("ship_year"), "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    scored = profile.z_scores(rows, ["ship_year", "l_returnflag"], "l_discount", 2)
    return rates.native_run_rates(scored, "ship_year", "z", "l_quantity", "l_extendedprice")


@query(
    "m20_native_run_rates",
    f"with {_NATIVE} select y ship_year, n row_count, round(k, 4) + 0.0 slope, round(sqrt(greatest((tt - k * xt) / n, 0)), 2) + 0.0 rmse from s",
)
def _(t: Tables):
    return _native(t).select("ship_year", "row_count", r6("slope", 4).alias("slope"), r6("rmse", 2).alias("rmse"))


@query(
    "m20_slope_stability",
    f"""with {_NATIVE} select count(*) period_count, round(avg(k), 4) + 0.0 mean_slope, round(stddev_pop(k), 4) + 0.0 sd_slope, round(stddev_pop(k) / abs(avg(k)), 4) + 0.0 coefficient_of_variation,
          min(k) > 0 all_positive, case when min(k) > 0 then round(max(k) / min(k), 4) + 0.0 end max_to_min_ratio from s""",
)
def _(t: Tables):
    report = rates.slope_stability(_native(t))
    return report.select(
        "period_count", *[r6(c, 4).alias(c) for c in ("mean_slope", "sd_slope", "coefficient_of_variation")], "all_positive", r6("max_to_min_ratio", 4).alias("max_to_min_ratio")
    )


_RELIABLE = """y as (select l_suppkey, s_nationkey::bigint % 3 grp, year(l_shipdate) y, avg(l_discount) r, count(*) n from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3 having count(*) >= 20),
  p as (select a.grp, a.r now, b.r was from y a join y b on b.l_suppkey = a.l_suppkey and b.y = a.y - 1)"""


@query(
    "m21_adjacent_reliability",
    f"""with {_RELIABLE}, q as (select grp, round(was, 9) was, round(now, 9) now from p), r as (select *, rank() over (partition by grp order by was) + (count(*) over (partition by grp, was) - 1) / 2 a,
          rank() over (partition by grp order by now) + (count(*) over (partition by grp, now) - 1) / 2 b from q)
        select grp, count(*) pair_count, round(corr(was, now), 6) + 0.0 pearson, round(corr(a, b), 6) + 0.0 spearman, round(avg(abs(now - was)), 6) + 0.0 mae from r group by 1""",
)
def _(t: Tables):
    group = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (big("s_nationkey") % 3).alias("grp"))
    years = t.lineitem.groupBy("l_suppkey", big(F.year("l_shipdate")).alias("ship_year")).agg(F.round(F.avg("l_discount"), 9).alias("rate"), F.count("*").alias("lines"))
    report = rates.adjacent_reliability(years.join(group, "l_suppkey"), ["l_suppkey"], "ship_year", ["grp"], "rate", "lines", 20)
    return report.select("grp", "pair_count", *[r6(c).alias(c) for c in ("pearson", "spearman", "mae")])


@query(
    "m21_rank_reliability",
    f"""with {_RELIABLE}, r as (select rank() over (order by was) + (count(*) over (partition by was) - 1) / 2 a, rank() over (order by now) + (count(*) over (partition by now) - 1) / 2 b
          from (select round(was, 9) was, round(now, 9) now from p))
        select count(*) row_count, round(corr(a, b), 6) + 0.0 rank_correlation from r""",
)
def _(t: Tables):
    years = t.lineitem.groupBy("l_suppkey", big(F.year("l_shipdate")).alias("ship_year")).agg(F.avg("l_discount").alias("rate"), F.count("*").alias("lines"))
    steady = years.where("lines >= 20").withColumn("rate", F.round("rate", 9))
    pairs = lookup.with_prior(steady.select("l_suppkey", "ship_year", "rate"), ["l_suppkey"], "ship_year", ["rate"]).where("prior_rate is not null")
    report = profile.rank_correlation(pairs, "prior_rate", "rate")
    return report.select("row_count", r6("rank_correlation").alias("rank_correlation"))


_AUDIT = """s as (select user_id, user_id % 12 team, sum(value) filter (early and home) / nullif(count(*) filter (early and home), 0) hv, sum(value) filter (early and not home) / nullif(count(*) filter (early and not home), 0) av,
    count(*) filter (early and home) hn, count(*) filter (early and not home) an, sum(50 - value) filter (not early and not home) rr, count(*) filter (not early and not home) rn
    from (select user_id, value, ts < timestamp '2024-01-16' early, hour(ts) < 12 home from events) group by 1, 2),
  e as (select *, 600 * (hv - av) signal, 2.0 * hn * an / (hn + an) sw, 600 * rr / rn res from s where hn >= 5 and an >= 5 and rn >= 5),
  g as (select sum(res * rn) / sum(rn) m from e),
  q as (select team, count(*) players, sum(rn)::bigint exposure, sum(signal * sw) / sum(sw) x, sum((res - m) * rn) / sum(rn) y from e, g group by 1 having count(*) >= 2)"""


def _audit(t: Tables):
    rows = t.events.select(
        "user_id", (F.col("user_id") % 12).alias("team"), "value", (F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")).alias("early"), (F.hour("ts") < 12).alias("home")
    )

    def part(early: bool, home: bool):
        return (F.col("early") == early) & (F.col("home") == home)

    players = rows.groupBy("user_id", "team").agg(
        F.count_if(part(True, True)).alias("home_n"),
        F.count_if(part(True, False)).alias("away_n"),
        F.count_if(part(False, False)).alias("later_n"),
        F.avg(F.when(part(True, True), F.col("value"))).alias("home_rate"),
        F.avg(F.when(part(True, False), F.col("value"))).alias("away_rate"),
        F.sum(F.when(part(False, False), 50 - F.col("value"))).alias("later_gap"),
    )
    eligible = players.where("home_n >= 5 and away_n >= 5 and later_n >= 5")
    signalled = eligible.withColumn("signal", 600 * (F.col("home_rate") - F.col("away_rate"))).withColumn("signal_weight", fn.harmonic(F.col("home_n"), F.col("away_n")))
    retained = rates.centered(signalled, "later_gap", "later_n", 600.0, "retention")
    teams = retained.groupBy("team").agg(
        F.count("*").alias("players"),
        F.sum("later_n").alias("exposure"),
        profile.weighted_mean(F.col("signal"), F.col("signal_weight")).alias("x"),
        profile.weighted_mean(F.col("retention"), F.col("later_n")).alias("y"),
    )
    return teams.where("players >= 2")


@query(
    "m22_retention_audit",
    f"with {_AUDIT} select team, players, exposure, round(x, 4) + 0.0 prior_signal, round(y, 4) + 0.0 retention from q",
)
def _(t: Tables):
    return _audit(t).select("team", "players", "exposure", r6("x", 4).alias("prior_signal"), r6("y", 4).alias("retention"))


@query(
    "m22_retention_gates",
    f"""with {_AUDIT}, l as (select count(*) n, (sum(exposure) * sum(exposure * x * y) - sum(exposure * x) * sum(exposure * y)) / (sum(exposure) * sum(exposure * x * x) - pow(sum(exposure * x), 2)) k from q)
        select n team_count, round(k, 6) + 0.0 slope, n >= 10 enough_teams, k >= 0.25 slope_reached, n >= 10 and k >= 0.25 all_gates_pass from l""",
)
def _(t: Tables):
    from tallyframe.operators import selection

    line = profile.less_means(_audit(t), ["x", "y"]).agg(F.count("*").alias("team_count"), profile.weighted_line(F.col("x"), F.col("y"), F.col("exposure"))[0].alias("slope"))
    gated = selection.all_gates(line, {"enough_teams": F.col("team_count") >= 10, "slope_reached": F.col("slope") >= 0.25})
    return gated.withColumn("slope", r6("slope"))


@query(
    "m23_permutation_p_value",
    """with n as (select c_nationkey::bigint u, avg(c_acctbal) x, avg(o_totalprice) y, count(*) w from customer join orders on o_custkey = c_custkey group by 1),
       o as (select (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) k from n),
       i as (select unnest(range(1, 501)) i), s as (select i, row_number() over (partition by i order by u) seat, x, w from n, i),
       d as (select i, row_number() over (partition by i order by md5('tally:' || i || ':' || u), u) seat, y from n, i),
       k as (select i, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) k from s join d using (i, seat) group by 1)
       select round(any_value(o.k), 4) + 0.0 observed_slope, count(*) iterations, sum((k.k >= o.k)::int)::bigint exceedances, round((sum((k.k >= o.k)::int) + 1) / (count(*) + 1), 6) + 0.0 p_value from k, o""",
)
def _(t: Tables):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    nations = rows.groupBy(big("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("x"), F.avg("o_totalprice").alias("y"), F.count("*").alias("w"))
    report = rates.permutation_p_value(nations, "nation", "x", "y", "w", 500, "tally")
    return report.withColumn("observed_slope", r6("observed_slope", 4)).withColumn("p_value", r6("p_value"))
