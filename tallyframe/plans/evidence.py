"""State values, season summaries and as-of evidence over the event, order and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import asof, checks, lookup, profile, scan, season, statevalue, windows
from tallyframe.plans.registry import Tables, big, query, r6

KINDS = ["view", "click", "signup", "purchase", "error"]

# --- state value -------------------------------------------------------------------------------

# A user-day is a partition, an event moves it from the previous event's type to its own, and a day
# that ends in an error counts as broken off.
_MOVES = """e as (select event_id, ts, user_id, ts::date d, event_type, value from events),
  m as (select *, coalesce(lag(event_type) over w, 'START') start_state, coalesce(sum(value) over (w rows between unbounded preceding and 1 preceding), 0) vb,
    sum(value) over p total, row_number() over (partition by user_id, d order by ts desc, event_id desc) = 1 terminal,
    last_value(event_type) over (w rows between unbounded preceding and unbounded following) final_state
    from e window w as (partition by user_id, d order by ts, event_id), p as (partition by user_id, d)),
  x as (select start_state, avg(total - vb) ev, count(*) n, count(distinct (user_id, d)) k from m where final_state <> 'error' group by 1),
  v as (select m.*, b.ev eb, case when terminal then 0 else a.ev end ea, value + case when terminal then 0 else a.ev end - b.ev cv
    from m left join x b using (start_state) left join x a on a.start_state = m.event_type),
  c as (select event_type, count(cv) n, avg(cv) mean, stddev_samp(cv) sd from v where cv is not null group by 1)"""


def _moves(t: Tables):
    rows = t.events.select("event_id", "ts", "user_id", F.to_date("ts").alias("event_date"), "event_type", "value")
    return statevalue.transitions(
        rows, ["user_id", "event_date"], ["ts", "event_id"], scan.time_slice("ts"), "event_type", "value", F.col("final_state") != "error"
    )


def _states(moves):
    return statevalue.expectancy(moves, [], ["user_id", "event_date"])


def _valued(t: Tables):
    moves = _moves(t)
    return statevalue.contextual_value(moves, _states(moves), [], "value")


@query(
    "v1_event_builder",
    """with f as (select l_orderkey, count(*) n, count(l_linenumber) filter (l_returnflag = 'R') r, case when count(*) filter (l_returnflag = 'R') = 1
         then max(l_linenumber) filter (l_returnflag = 'R') end one from lineitem group by 1)
       select o_orderkey, coalesce(n, 0) line_count, coalesce(r, 0) returned_count, one::bigint returned_line, case when o_orderstatus = 'P' and r > 0 then 'unexpected_return'
         when o_orderstatus = 'P' then 'pending' when coalesce(n, 0) = 0 then 'missing_lines' when r = 0 then 'complete' when r > 1 then 'multiple_returns'
         else 'single_return' end evidence_status from orders left join f on l_orderkey = o_orderkey""",
)
def _(t: Tables):
    returned = F.col("l_returnflag") == "R"
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("line_count"),
        F.count_if(returned).alias("returned_count"),
        F.when(F.count_if(returned) == 1, F.max(F.when(returned, big("l_linenumber")))).alias("returned_line"),
    )
    joined = t.orders.select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").fillna(0, subset=["line_count", "returned_count"])
    pending = F.col("o_orderstatus") == "P"
    status = fn.first_case(
        [
            (pending & (F.col("returned_count") > 0), "unexpected_return"),
            (pending, "pending"),
            (F.col("line_count") == 0, "missing_lines"),
            (F.col("returned_count") == 0, "complete"),
            (F.col("returned_count") > 1, "multiple_returns"),
        ],
        "single_return",
    )
    return joined.withColumn("evidence_status", status).drop("o_orderstatus")


@query(
    "v3_ordered_transitions",
    f"""with {_MOVES} select event_id, start_state, event_type end_state, round(vb, 4) + 0.0 value_before, round(total, 4) + 0.0 partition_value,
          terminal is_terminal, final_state <> 'error' partition_complete from m""",
)
def _(t: Tables):
    return _moves(t).select(
        "event_id",
        "start_state",
        "end_state",
        r6("value_before", 4).alias("value_before"),
        r6("partition_value", 4).alias("partition_value"),
        "is_terminal",
        "partition_complete",
    )


@query(
    "v3_state_breaks",
    f"""with {_MOVES} select start_state, count(*) row_count, sum((start_state <> 'START' and event_id % 50 = 0 and start_state <> 'view')::int)::bigint break_count
        from m group by 1""",
)
def _(t: Tables):
    moves = _moves(t)
    declared = F.when((F.col("event_id") % 50 == 0) & (F.col("start_state") != "START"), F.lit("view")).otherwise(F.col("start_state"))
    flagged = statevalue.quality_flags(
        moves.withColumn("declared_start", declared), ["user_id", "event_date"], ["ts", "event_id"], scan.time_slice("ts"), "declared_start", "end_state"
    )
    return flagged.groupBy("start_state").agg(F.count("*").alias("row_count"), F.count_if("state_break").alias("break_count"))


@query(
    "v4_state_expectancy",
    f"with {_MOVES} select start_state, round(ev, 6) + 0.0 expectancy, n state_sample_size, k state_partition_count from x",
)
def _(t: Tables):
    return _states(_moves(t)).withColumn("expectancy", r6("expectancy"))


@query(
    "v4_state_expectancy_by_environment",
    f"""with {_MOVES}, y as (select hour(ts) < 12 morning, * from m) select morning, start_state, round(avg(total - vb), 6) + 0.0 expectancy,
          count(*) state_sample_size, count(distinct (user_id, d)) state_partition_count from y where final_state <> 'error' group by 1, 2""",
)
def _(t: Tables):
    moves = _moves(t).withColumn("morning", F.hour("ts") < 12)
    return statevalue.expectancy(moves, ["morning"], ["user_id", "event_date"]).withColumn("expectancy", r6("expectancy"))


@query(
    "v5_contextual_value",
    f"""with {_MOVES} select event_id, round(eb, 6) + 0.0 expectancy_before, round(ea, 6) + 0.0 expectancy_after, round(cv, 6) + 0.0 context_value,
          cv is not null value_available from v""",
)
def _(t: Tables):
    valued = _valued(t)
    return valued.select(
        "event_id", *[r6(c).alias(c) for c in ("expectancy_before", "expectancy_after", "context_value")], "value_available"
    )


@query(
    "v5_telescoping",
    f"""with {_MOVES} select user_id, d event_date, round(sum(cv), 4) + 0.0 context_total, round(any_value(total) - max(eb) filter (start_state = 'START'), 4) + 0.0 expected_total
        from v group by 1, 2""",
)
def _(t: Tables):
    first = F.when(F.col("start_state") == "START", F.col("expectancy_before"))
    return _valued(t).groupBy("user_id", "event_date").agg(
        r6(F.sum("context_value"), 4).alias("context_total"), r6(F.max("partition_value") - F.max(first), 4).alias("expected_total")
    )


@query(
    "v6_transition_coverage",
    f"""with {_MOVES}, h as (select start_state, ev from x where start_state <> 'signup'), w as (select m.*, m.value + case when terminal then 0 else a.ev end - b.ev cv
          from m left join h b using (start_state) left join h a on a.start_state = m.event_type)
        select event_type, count(*) row_count, count(cv) present_count, count(*) - count(cv) missing_count, round(count(cv) / count(*), 6) + 0.0 coverage_rate from w group by 1""",
)
def _(t: Tables):
    moves = _moves(t)
    partial = _states(moves).where("start_state <> 'signup'")
    valued = statevalue.contextual_value(moves, partial, [], "value")
    report = profile.coverage(valued, ["event_type"], F.col("context_value"))
    return report.withColumn("coverage_rate", r6("coverage_rate"))


@query(
    "v6_missing_states",
    f"""with {_MOVES}, y as (select distinct hour(ts) h, start_state from m where final_state <> 'error' and not (hour(ts) % 7 = 3 and start_state = 'signup')),
          z as (select h, s from (select unnest(range(24)) h), (select unnest(['START', 'view', 'click', 'signup', 'purchase', 'error']) s)
            where exists (select 1 from e where hour(ts) = h))
        select h::bigint "hour", s start_state from z where (h, s) not in (select (h, start_state) from y)""",
)
def _(t: Tables):
    moves = _moves(t).withColumn("hour", F.hour("ts"))
    # Seeded: one state is taken out in some hours.
    states = statevalue.expectancy(moves, ["hour"], ["user_id", "event_date"]).where("not (hour % 7 = 3 and start_state = 'signup')")
    expected = moves.select("hour").distinct().withColumn("start_state", F.explode(F.array(*[F.lit(s) for s in ["START", *KINDS]])))
    return statevalue.missing_states(states, expected, ["hour"]).select(big("hour").alias("hour"), "start_state")


@query(
    "v7_category_value",
    f"""with {_MOVES} select event_type, n occurrence_count, round(mean, 6) + 0.0 mean_value, round(sd, 6) + 0.0 sd_value, round(sd / sqrt(n), 6) + 0.0 se_value from c""",
)
def _(t: Tables):
    cells = statevalue.category_value(_valued(t), ["event_type"])
    return cells.select("event_type", "occurrence_count", *[r6(c).alias(c) for c in ("mean_value", "sd_value", "se_value")])


_BANDED = f"""{_MOVES}, bc as (select case when hour(ts) < 8 then 'night' when hour(ts) < 16 then 'day' else 'evening' end environment, event_type, count(cv) n, avg(cv) m from v
    where cv is not null group by 1, 2), bp as (select *, sum(n) over g - n pn, sum(n * m) over g - n * m ps, count(*) over g - 1 pk from bc window g as (partition by event_type))"""


@query(
    "v8_state_value_pooled",
    f"""with {_BANDED} select environment, event_type, n occurrence_count, round(m, 6) + 0.0 mean_value, round(ps / pn, 6) + 0.0 prior_mean, pk prior_environment_count,
          round((m * n + 75 * ps / pn) / (n + 75), 6) + 0.0 estimated_mean from bp""",
)
def _(t: Tables):
    """Flagship: value of each event type by part of the day, shrunk to the same type at other times."""
    hour = F.hour("ts")
    valued = _valued(t).withColumn("environment", F.when(hour < 8, "night").when(hour < 16, "day").otherwise("evening"))
    direct = statevalue.category_value(valued, ["environment", "event_type"])
    pooled = statevalue.pooled_values(direct, ["environment"], [], "event_type", F.lit(75))
    return pooled.select(
        "environment", "event_type", "occurrence_count", *[r6(c).alias(c) for c in ("mean_value", "prior_mean", "estimated_mean")], "prior_environment_count"
    )


_NATION_CELLS = """n as (select n_nationkey::bigint nation_key, n_regionkey::bigint region_key, c_mktsegment, count(*) n, avg(c_acctbal) m from customer
    join nation on c_nationkey = n_nationkey group by 1, 2, 3)"""


@query(
    "v8_pooled_by_policy",
    f"""with {_NATION_CELLS}, p as (select *, case region_key when 0 then 25 when 1 then 75 when 2 then 0 when 3 then 5 end k,
          sum(n) over g - n pn, sum(n * m) over g - n * m ps, count(*) over g - 1 pk from n window g as (partition by region_key, c_mktsegment))
        select nation_key, region_key, c_mktsegment, n occurrence_count, round(m, 6) + 0.0 mean_value, case when k > 0 and pn > 0 then round(ps / pn, 6) + 0.0 end prior_mean,
          case when k > 0 and pn > 0 then pn else 0 end::bigint prior_occurrence_count, case when k > 0 and pn > 0 then pk else 0 end prior_environment_count,
          round(case when k > 0 and pn > 0 then (m * n + ps / pn * k) / (n + k) else m end, 6) + 0.0 estimated_mean,
          case when k > 0 and pn > 0 then 'pooled_with_peers' when k > 0 then 'direct_missing_peers' when k = 0 then 'direct_by_policy' else 'direct_without_policy' end
            estimator_method, coalesce((k > 0 and pn > 0) or k = 0, false) estimator_certified from p""",
)
def _(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        big("n_nationkey").alias("nation_key"), big("n_regionkey").alias("region_key"), "c_mktsegment", "c_acctbal"
    )
    direct = profile.cell_stats(rows, ["nation_key", "region_key", "c_mktsegment"], "c_acctbal")
    strength = fn.map_value(F.col("region_key"), {0: 25, 1: 75, 2: 0, 3: 5})
    pooled = statevalue.pooled_values(direct, ["nation_key"], ["region_key"], "c_mktsegment", strength)
    return pooled.select(*[r6(c).alias(c) if c in ("mean_value", "prior_mean", "estimated_mean") else F.col(c) for c in pooled.columns])


@query(
    "v9_pooling_strengths",
    """with h as (select c_nationkey::bigint e, n_regionkey::bigint pool_group, o_orderpriority b, o_orderkey % 2 = 1 odd, count(*) n, avg(o_totalprice) m from orders
         join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2, 3, 4),
       j as (select a.e, a.pool_group, a.b, a.n, a.m, r.m truth, sum(a.n) over g - a.n pn, sum(a.n * a.m) over g - a.n * a.m ps from h a join h r on a.e = r.e and a.b = r.b
         and a.odd and not r.odd window g as (partition by a.pool_group, a.b)),
       s as (select *, unnest([0, 25, 75, 150]) k from j), p as (select *, case when k > 0 and pn > 0 then (m * n + ps / pn * k) / (n + k) else m end - truth err from s),
       q as (select pool_group, k prior_strength, count(*) cell_count, avg(abs(err)) mae, sqrt(avg(err * err)) rmse, sum(abs(err) * n) / sum(n) wm, max(abs(err)) mx,
         count(*) filter (abs(err) <= 10000) within_tolerance_count from p group by 1, 2)
       select pool_group, prior_strength::bigint prior_strength, cell_count, round(mae, 2) + 0.0 mae, round(rmse, 2) + 0.0 rmse, round(wm, 2) + 0.0 weighted_mae,
         round(mx, 2) + 0.0 max_error, within_tolerance_count, row_number() over (partition by pool_group order by mae, prior_strength) = 1 is_best from q""",
)
def _(t: Tables):
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(big("c_nationkey").alias("environment"), big("n_regionkey").alias("pool_group"), "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 2 == 1).alias("odd"))
    )
    halves = rows.groupBy("environment", "pool_group", "o_orderpriority").agg(
        F.count_if("odd").alias("occurrence_count"),
        F.avg(F.when(F.col("odd"), F.col("o_totalprice"))).alias("mean_value"),
        F.avg(F.when(~F.col("odd"), F.col("o_totalprice"))).alias("reference_mean"),
    )
    report = statevalue.pooling_strengths(halves, ["environment"], ["pool_group"], "o_orderpriority", [0, 25, 75, 150], 10000.0)
    return report.select(*[r6(c, 2).alias(c) if c in ("mae", "rmse", "weighted_mae", "max_error") else F.col(c) for c in report.columns])


@query(
    "v10_outcome_scale",
    f"""with {_MOVES} select case when event_type in ('view', 'click') then 'browse' when event_type = 'error' then 'fail' else 'convert' end outcome_group,
          count(cv) contact_count, round(avg(cv), 6) + 0.0 mean_value from v where d < date '2024-01-16' group by 1""",
)
def _(t: Tables):
    group = fn.first_case([(F.col("event_type").isin("view", "click"), "browse"), (F.col("event_type") == "error", "fail")], "convert")
    before = _valued(t).where(F.col("event_date") < asof.as_date("2024-01-16"))
    return before.groupBy(group.alias("outcome_group")).agg(F.count("context_value").alias("contact_count"), r6(F.avg("context_value")).alias("mean_value"))


@query(
    "v11_calibration_events",
    f"""with {_MOVES} select event_type, (props->>'$.k')::bigint % 4 capability, count(*) event_count, count(cv) valued_count, round(sum(cv), 4) + 0.0 value_total
        from v join (select event_id, props from events where event_type <> 'error') p using (event_id) group by 1, 2""",
)
def _(t: Tables):
    official = t.events.where("event_type <> 'error'").select("event_id", (F.get_json_object("props", "$.k").try_cast("bigint") % 4).alias("capability"))
    joined = _valued(t).select("event_id", "event_type", "context_value").join(official, "event_id")
    return joined.groupBy("event_type", "capability").agg(
        F.count("*").alias("event_count"), F.count("context_value").alias("valued_count"), r6(F.sum("context_value"), 4).alias("value_total")
    )


# --- season summaries --------------------------------------------------------------------------

_S1 = """p as (select user_id, d < date '2024-01-16' early, event_type, count(*) n from (select user_id, ts::date d, event_type from events) group by 1, 2, 3),
  o as (select user_id, early, sum(n)::bigint pa from p group by 1, 2),
  w as (select early, event_type, avg(value) m, count(*) >= 900 ok from (select ts::date < date '2024-01-16' early, event_type, value from events) where event_type not in ('error', 'signup')
    group by 1, 2),
  l as (select p.*, m, ok, pa, n * m ev from p left join w using (early, event_type) join o using (user_id, early) where event_type <> 'signup')"""


def _season(t: Tables):
    rows = t.events.select("user_id", (F.to_date("ts") < asof.as_date("2024-01-16")).alias("early"), "event_type", "value")
    counts = rows.groupBy("user_id", "early", "event_type").agg(F.count("*").alias("occurrence_count"))
    totals = counts.groupBy("user_id", "early").agg(F.sum("occurrence_count").alias("appearances"))
    values = rows.where("event_type not in ('error', 'signup')").groupBy("early", "event_type").agg(
        F.avg("value").alias("estimated_mean"), (F.count("*") >= 900).alias("estimator_certified")
    )
    return season.valued_summary(
        totals, counts.where("event_type <> 'signup'"), values, ["user_id", "early"], ["early"], "event_type", "appearances"
    )


@query(
    "s1_season_summary",
    f"""with {_S1}, g as (select user_id, early, sum(n)::bigint c, coalesce(sum(n) filter (m is not null), 0)::bigint vc, sum(ev) v, bool_or(not coalesce(ok, false)) u from l group by 1, 2)
        select user_id, early, pa appearances, coalesce(c, 0) profile_event_count, coalesce(vc, 0) valued_event_count, pa - coalesce(c, 0) uncovered_count,
          round(coalesce(c, 0) / pa, 6) + 0.0 coverage_rate, coalesce(c, 0) - coalesce(vc, 0) unvalued_event_count, round(coalesce(v, 0), 4) + 0.0 expected_value_total,
          round(100 * coalesce(v, 0) / pa, 4) + 0.0 expected_value_per_100, case when vc > 0 then round(v / vc, 4) + 0.0 end mean_event_value,
          coalesce(u, coalesce(c, 0) > 0) has_uncertified_value, coalesce(c, 0) > pa profile_exceeds_total from o left join g using (user_id, early)""",
)
def _(t: Tables):
    summary, _profile = _season(t)
    fours = ("expected_value_total", "expected_value_per_100", "mean_event_value")
    return summary.select(*[r6(c, 4 if c in fours else 6).alias(c) if c in (*fours, "coverage_rate") else F.col(c) for c in summary.columns])


@query(
    "s1_season_profile",
    f"""with {_S1} select user_id, early, event_type, n occurrence_count, round(n / pa, 6) + 0.0 share, round(ev, 4) + 0.0 expected_value from l""",
)
def _(t: Tables):
    _summary, long = _season(t)
    return long.select("user_id", "early", "event_type", "occurrence_count", r6("share").alias("share"), r6("expected_value", 4).alias("expected_value"))


@query(
    "s2_five_way_profile",
    """with a as (select l_suppkey, count(*) faced, sum((l_returnflag = 'R')::int)::bigint returned, sum((l_returnflag = 'A' and l_linestatus = 'F')::int)::bigint accepted,
         sum((l_discount = 0)::int and (l_returnflag = 'N'))::bigint full_price, sum((l_returnflag = 'N' and l_tax = 0 and l_discount > 0)::int)::bigint untaxed from lineitem group by 1)
       select l_suppkey, category, n occurrence_count, round(n / faced, 6) + 0.0 probability from (select l_suppkey, faced,
         unnest(['returned', 'accepted', 'full_price', 'untaxed', 'other']) category, unnest([returned, accepted, full_price, untaxed,
         faced - returned - accepted - full_price - untaxed]) n from a)""".replace("sum((l_discount = 0)::int and (l_returnflag = 'N'))", "sum((l_discount = 0 and l_returnflag = 'N')::int)"),
)
def _(t: Tables):
    flag = F.col("l_returnflag")
    tests = {
        "returned": flag == "R",
        "accepted": (flag == "A") & (F.col("l_linestatus") == "F"),
        "full_price": (flag == "N") & (F.col("l_discount") == 0),
        "untaxed": (flag == "N") & (F.col("l_tax") == 0) & (F.col("l_discount") > 0),
    }
    # Orders are summed first, as several team rows of one season would be.
    rows = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("faced"), *[F.count_if(c).alias(f"n_{n}") for n, c in tests.items()])
    _summary, long = season.partition_profile(
        rows.drop("l_orderkey"), ["l_suppkey"], "faced", {n: F.col(f"n_{n}") for n in tests}, "other"
    )
    return long.select("l_suppkey", "category", "occurrence_count", r6("probability").alias("probability"))


@query(
    "s3_entity_day_evidence",
    """select user_id, ts::date event_date, count(*) appearances, count(*) filter (event_type in ('view', 'click')) expected_contacts,
         count(*) filter (event_type in ('view', 'click') and value >= 5) observed_contacts,
         count(*) filter (event_type in ('view', 'click') and value >= 5) - count(*) filter (event_type in ('view', 'click')) contact_residual,
         count(*) - count(*) filter (event_type in ('view', 'click')) - count(*) filter (event_type = 'purchase') - count(*) filter (event_type = 'signup') accounting_residual
       from events group by 1, 2""",
)
def _(t: Tables):
    kind = F.col("event_type")
    contact = kind.isin("view", "click")
    days = t.events.groupBy("user_id", F.to_date("ts").alias("event_date")).agg(
        F.count("*").alias("appearances"),
        F.count_if(contact).alias("expected_contacts"),
        F.count_if(contact & (F.col("value") >= 5)).alias("observed_contacts"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if(kind == "signup").alias("signups"),
    )
    residual = days.withColumn("contact_residual", F.col("observed_contacts") - F.col("expected_contacts"))
    checked = checks.identity_residual(residual, F.col("appearances"), [F.col("expected_contacts"), F.col("purchases"), F.col("signups")])
    return checked.drop("purchases", "signups")


@query(
    "s3_entity_day_profile",
    """select user_id, ts::date event_date, event_type, count(*) occurrence_count from events group by 1, 2, 3""",
)
def _(t: Tables):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("event_date"))
    wide = days.agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in KINDS])
    return wide.unpivot(["user_id", "event_date"], KINDS, "event_type", "occurrence_count").where("occurrence_count > 0")


@query(
    "s4_combined_levels",
    """select level_group, environment, count(*) entity_count, sum(n)::bigint events from (
         select 'customer' level_group, n_name environment, c_custkey k, count(o_orderkey) n from customer join nation on n_nationkey = c_nationkey
           left join orders on o_custkey = c_custkey group by 1, 2, 3
         union all select 'supplier', n_name, s_suppkey, count(l_suppkey) from supplier join nation on n_nationkey = s_nationkey
           left join lineitem on l_suppkey = s_suppkey group by 1, 2, 3) group by 1, 2""",
)
def _(t: Tables):
    place = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("environment"))
    orders = t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("events"))
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("events"))
    customers = t.customer.select(F.lit("customer").alias("level_group"), F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"))
    suppliers = t.supplier.select(F.lit("supplier").alias("level_group"), F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    levels = [lookup.with_counts(e, c, ["entity"]).join(place, "nation") for e, c in ((customers, orders), (suppliers, lines))]
    schema = {"level_group": "string", "environment": "string", "entity": "bigint", "events": "bigint"}
    return lookup.union_sources(levels, schema).groupBy("level_group", "environment").agg(
        F.count("*").alias("entity_count"), F.sum("events").alias("events")
    )


_ROLE = """c as (select user_id, event_type, sum((value >= 150)::int)::bigint starts, count(*) games, sum((props->>'$.k')::bigint)::bigint outs from events group by 1, 2),
  r as (select *, case when sum(starts) over u > 0 then starts else games end role_events, case when sum(starts) over u > 0 then 'starts' else 'games_fallback' end mode
    from c window u as (partition by user_id)), s as (select *, sum(role_events) over (partition by user_id)::bigint total from r)"""


def _roles(t: Tables):
    cells = t.events.groupBy("user_id", "event_type").agg(
        F.count_if(F.col("value") >= 150).alias("starts"),
        F.count("*").alias("games"),
        F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("outs"),
    )
    return season.role_profile(cells, ["user_id"], "event_type", "starts", "games", [F.desc("starts"), F.desc("outs"), F.desc("games"), F.asc("event_type")])


@query(
    "s5_role_shares",
    f"""with {_ROLE} select user_id, event_type, role_events, mode role_evidence_mode, round(role_events / total, 6) + 0.0 role_share from s where total > 0""",
)
def _(t: Tables):
    shares, _primary = _roles(t)
    return shares.select("user_id", "event_type", "role_events", "role_evidence_mode", r6("role_share").alias("role_share"))


@query(
    "s5_primary_role",
    f"""with {_ROLE} select user_id, event_type primary_role, round(role_events / total, 6) + 0.0 primary_share, mode role_evidence_mode, total total_role_events from (
          select *, row_number() over (partition by user_id order by role_events desc, starts desc, outs desc, games desc, event_type) rn from s where total > 0) where rn = 1""",
)
def _(t: Tables):
    _shares, primary = _roles(t)
    return primary.withColumn("primary_share", r6("primary_share"))


@query(
    "s6_assigned_environment",
    """select environment, o_orderpriority, count(*) order_count from (select o_orderpriority, case when o_orderpriority = '1-URGENT' and year(o_orderdate) <= 1997 then 'express'
         when o_orderpriority = '1-URGENT' then 'priority' when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'standard'
         when o_orderpriority = '5-LOW' and year(o_orderdate) >= 1998 then 'economy' end environment from orders) group by 1, 2""",
)
def _(t: Tables):
    aliases = t.spark.createDataFrame(
        [
            ("1-URGENT", 1990, 1997, "express"),
            ("1-URGENT", 1998, 2005, "priority"),
            ("2-HIGH", 1990, 2005, "standard"),
            ("3-MEDIUM", 1990, 2005, "standard"),
            ("5-LOW", 1998, 2005, "economy"),
        ],
        "label string, first_period int, last_period int, environment string",
    )
    rows = t.orders.withColumn("order_year", F.year("o_orderdate"))
    assigned, _unknown = season.assign_environment(rows, "o_orderpriority", "order_year", aliases)
    return assigned.groupBy("environment", "o_orderpriority").agg(F.count("*").alias("order_count"))


@query(
    "s7_recording_fidelity",
    """select o_orderpriority, count(*) sequence_count, round(avg(n), 6) + 0.0 mean_recorded, sum((gap > 0)::int)::bigint gap_count, round(avg(gap), 6) + 0.0 mean_gap,
         sum((n = 1)::int)::bigint minimum_count from (select o_orderpriority, n, greatest(m - n, 0) gap from (select l_orderkey, count(*) n, max(l_linenumber)::bigint m
         from lineitem group by 1) join orders on o_orderkey = l_orderkey) group by 1""",
)
def _(t: Tables):
    fidelity = season.recording_fidelity(t.lineitem, ["l_orderkey"], "l_linenumber")
    joined = fidelity.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(
        F.count("*").alias("sequence_count"),
        r6(F.avg("recorded_count")).alias("mean_recorded"),
        F.count_if(F.col("position_gap") > 0).alias("gap_count"),
        r6(F.avg("position_gap")).alias("mean_gap"),
        F.count_if(F.col("recorded_count") == 1).alias("minimum_count"),
    )


@query(
    "s7_recorded_quantiles",
    """select o_orderpriority, point, round(quantile, 6) + 0.0 quantile from (select o_orderpriority, unnest([0.25::double, 0.5, 0.75]) point, unnest(quantile_cont(n::double, [0.25, 0.5, 0.75])) quantile
         from (select l_orderkey, count(*) n from lineitem group by 1) join orders on o_orderkey = l_orderkey group by 1)""",
)
def _(t: Tables):
    fidelity = season.recording_fidelity(t.lineitem, ["l_orderkey"], "l_linenumber")
    joined = fidelity.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    points = profile.exact_quantiles(joined, ["o_orderpriority"], "recorded_count", [0.25, 0.5, 0.75])
    return points.withColumn("quantile", r6("quantile"))


@query(
    "s8_run_environment",
    """select year(o_orderdate) order_year, count(*) games, sum(floor(o_totalprice / 100000))::bigint runs, sum(n)::bigint outs,
         round(27.0 * sum(floor(o_totalprice / 100000)) / sum(n), 6) + 0.0 runs_per_9, round(1.5 * 27.0 * sum(floor(o_totalprice / 100000)) / sum(n) + 3, 6) + 0.0 runs_per_win
       from orders join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey group by 1""",
)
def _(t: Tables):
    outs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("outs"))
    games = t.orders.join(outs, "o_orderkey").withColumn("runs", F.floor(F.col("o_totalprice") / 100000))
    totals = games.groupBy(big(F.year("o_orderdate")).alias("order_year")).agg(
        F.count("*").alias("games"), F.sum("runs").alias("runs"), F.sum("outs").alias("outs")
    )
    per_9 = 27.0 * F.col("runs") / F.col("outs")
    return totals.withColumn("runs_per_9", r6(per_9)).withColumn("runs_per_win", r6(1.5 * per_9 + 3.0))


# --- as-of evidence ----------------------------------------------------------------------------

CUTOFF = "2024-01-16"


def _daily(t: Tables):
    """Events per user, day and type: the reduced table every as-of operator starts from."""
    return t.events.groupBy("user_id", F.to_date("ts").alias("event_date"), "event_type").agg(
        F.count("*").alias("events"), F.count_if(F.col("value") >= 50).alias("large_events")
    )


@query(
    "t1_cutoff_membership",
    """select event_type, count(*) filter (d < date '2024-01-16') predictor_count, count(*) filter (d >= date '2024-01-16' and d < date '2024-01-23') target_count,
         count(*) filter (d >= date '2024-01-23') outside_count from (select event_type, ts::date d from events) group by 1""",
)
def _(t: Tables):
    predictor, target, outside = asof.membership(F.to_date("ts"), asof.as_date(CUTOFF), 7)
    return t.events.groupBy("event_type").agg(
        F.count_if(predictor).alias("predictor_count"), F.count_if(target).alias("target_count"), F.count_if(outside).alias("outside_count")
    )


@query(
    "t2_event_cutoff",
    """select o_orderpriority, count(*) line_count from lineitem join orders on o_orderkey = l_orderkey where o_orderkey % 43 <> 0 and o_orderdate::date <= date '1998-06-30'
       group by 1 union all select 'undated', count(*) from lineitem where l_orderkey % 43 = 0""",
)
def _(t: Tables):
    games = t.orders.where("o_orderkey % 43 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("game_date"), "o_orderpriority")
    past, undated = asof.event_cutoff(t.lineitem.select("l_orderkey"), games, "l_orderkey", "game_date", asof.as_date("1998-06-30"))
    labelled = past.join(games.select("l_orderkey", "o_orderpriority"), "l_orderkey")
    return labelled.groupBy("o_orderpriority").agg(F.count("*").alias("line_count")).unionByName(
        undated.agg(F.count("*").alias("line_count")).select(F.lit("undated").alias("o_orderpriority"), "line_count")
    )


@query(
    "t3_vintage",
    """select l_returnflag, count(*) line_count from lineitem join orders on o_orderkey = l_orderkey where o_orderdate::date <= date '1998-06-30'
         and l_suppkey % 10 in (select s from (select l_suppkey % 10 s, min(l_shipdate) first_known from lineitem where l_suppkey % 10 <> 4 group by 1) where s % 2 = 0)
       group by 1""",
)
def _(t: Tables):
    # Snapshots are supplier families; odd ones only became known later and family 4 has no known time.
    family = F.col("l_suppkey") % 10
    rows = t.lineitem.select("l_orderkey", "l_returnflag", family.alias("snapshot"))
    known = F.when(F.col("snapshot") == 4, F.lit(None)).when(F.col("snapshot") % 2 == 0, F.lit("1998-01-01")).otherwise(F.lit("1999-01-01")).cast("date")
    snapshots = rows.select("snapshot").distinct().withColumn("known_at", known)
    games = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("game_date"))
    eligible = asof.vintage(rows, games, snapshots, "l_orderkey", "game_date", "snapshot", "known_at", asof.as_date("1998-06-30"))
    return eligible.groupBy("l_returnflag").agg(F.count("*").alias("line_count"))


_WEIGHTED = """d as (select user_id, ts::date d, event_type, count(*) n, count(*) filter (value >= 50) b, exp(-ln(2) / 7 * (date '2024-01-16' - ts::date)) w
    from events where ts::date < date '2024-01-16' and ts::date >= date '2024-01-02' group by 1, 2, 3)"""


@query(
    "t4_recency_snapshot",
    f"""with {_WEIGHTED} select user_id, sum(n)::bigint raw_events, sum(b)::bigint raw_large_events, round(sum(n * w), 6) + 0.0 effective_events,
          round(sum(b * w), 6) + 0.0 effective_large_events, count(distinct d) day_count, count(distinct event_type) environment_count, min(d) first_date, max(d) last_date
        from d group by 1""",
)
def _(t: Tables):
    window = asof.evidence_window(lookback_days=14, half_life_days=7)
    snapshot = asof.recency_snapshot(_daily(t), "user_id", "event_date", "event_type", ["events", "large_events"], asof.as_date(CUTOFF), window)
    return snapshot.withColumn("effective_events", r6("effective_events")).withColumn("effective_large_events", r6("effective_large_events"))


@query(
    "t4_recency_profile",
    f"""with {_WEIGHTED}, p as (select user_id, event_type, sum(n)::bigint n, sum(n * w) e from d group by 1, 2) select user_id, event_type, n raw_count, round(e, 6) + 0.0 effective_count,
          round(n / sum(n) over u, 6) + 0.0 raw_rate, round(e / sum(e) over u, 6) + 0.0 effective_rate from p window u as (partition by user_id)""",
)
def _(t: Tables):
    window = asof.evidence_window(lookback_days=14, half_life_days=7)
    rows = asof.recency_profile(_daily(t), ["user_id"], "event_date", "event_type", "events", asof.as_date(CUTOFF), window)
    return rows.select("user_id", "event_type", "raw_count", *[r6(c).alias(c) for c in ("effective_count", "raw_rate", "effective_rate")])


@query(
    "t5_weighted_level_profile",
    """with d as (select user_id, event_type, (props->>'$.k')::bigint % 3 lv, exp(-ln(2) / 10 * (date '2024-01-16' - ts::date)) w from events where ts::date < date '2024-01-16')
       select user_id, lv level_group, event_type, count(*) raw_count, round(sum(w), 6) + 0.0 effective_count, round(sum(w) / sum(sum(w)) over (partition by user_id, lv), 6) + 0.0 effective_rate
       from d group by 1, 2, 3""",
)
def _(t: Tables):
    level = F.get_json_object("props", "$.k").try_cast("bigint") % 3
    daily = t.events.groupBy("user_id", level.alias("level_group"), F.to_date("ts").alias("event_date"), "event_type").agg(F.count("*").alias("events"))
    rows = asof.recency_profile(
        daily, ["user_id", "level_group"], "event_date", "event_type", "events", asof.as_date(CUTOFF), asof.evidence_window(half_life_days=10)
    )
    return rows.select("user_id", "level_group", "event_type", "raw_count", r6("effective_count").alias("effective_count"), r6("effective_rate").alias("effective_rate"))


@query(
    "t6_future_target",
    """select user_id, event_type, count(*) future_events, count(*) filter (value >= 50) future_large_events, min(ts::date - date '2024-01-16') first_days_after,
         count(distinct ts::date) future_day_count from events where ts::date >= date '2024-01-16' and ts::date < date '2024-01-23' group by 1, 2""",
)
def _(t: Tables):
    return asof.future_target(_daily(t), ["user_id", "event_type"], "event_date", ["events", "large_events"], asof.as_date(CUTOFF), 7)


@query(
    "t7_snapshot_dataset",
    """with d as (select user_id, ts::date d, case when hour(ts) < 8 then 1 when hour(ts) < 16 then 2 else 3 end lv from events),
       p as (select user_id, count(*) n, max(d) last from d where d < date '2024-01-16' group by 1),
       c as (select d.user_id, min(lv) lo, max(lv) hi from d join p on p.user_id = d.user_id and d.d = last group by 1),
       f as (select user_id, lv, count(*) n from d where d >= date '2024-01-16' and d < date '2024-01-23' group by 1, 2)
       select f.user_id, f.lv::bigint target_level, f.n future_events, p.n past_events, last last_date, lo <> hi environment_ambiguous, case when lo = hi then lo end::bigint as_of_level,
         case when lo <> hi then 'AMBIGUOUS_AS_OF' when f.lv > lo then 'PROMOTION' when f.lv < lo then 'DEMOTION' else 'SAME_LEVEL' end transition
       from f join p using (user_id) join c using (user_id)""",
)
def _(t: Tables):
    hour = F.hour("ts")
    level = F.when(hour < 8, 1).when(hour < 16, 2).otherwise(3).cast("bigint")
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("event_date"), level.alias("level")).agg(F.count("*").alias("events"))
    cutoff = asof.as_date(CUTOFF)
    context = windows.latest_context(daily, "user_id", "event_date", "level", cutoff).withColumnRenamed("environment", "as_of_level")
    past = daily.where(F.col("event_date") < cutoff).groupBy("user_id").agg(F.sum("events").alias("past_events"))
    target = asof.future_target(daily, ["user_id", "level"], "event_date", ["events"], cutoff, 7)
    scored = target.join(past.join(context, "user_id"), "user_id")
    move = asof.transition_label(F.col("environment_ambiguous"), F.col("as_of_level"), F.col("level"))
    return scored.select(
        "user_id", F.col("level").alias("target_level"), "future_events", "past_events", "last_date", "environment_ambiguous", "as_of_level", move.alias("transition")
    )


@query(
    "t8_multi_cutoff_folds",
    """with c as (select unnest([date '2024-01-08', date '2024-01-15', date '2024-01-22']) cutoff) select cutoff, user_id, event_type, count(*) raw_count,
         round(sum(exp(-ln(2) / 7 * (cutoff - ts::date))), 6) + 0.0 effective_count from events join c on ts::date < cutoff group by 1, 2, 3""",
)
def _(t: Tables):
    folds = asof.fold_profiles(
        _daily(t), ["user_id"], "event_date", "event_type", "events", ["2024-01-08", "2024-01-15", "2024-01-22"], asof.evidence_window(half_life_days=7)
    )
    return folds.withColumn("effective_count", r6("effective_count"))


@query(
    "t8_month_cutoffs",
    """with c as (select unnest(range(date '1998-01-01', date '1998-12-31', interval 1 month))::date cutoff) select cutoff, count(*) past_orders from orders
         join c on o_orderdate::date < cutoff and o_orderdate::date >= cutoff - interval 365 day group by 1""",
)
def _(t: Tables):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count("*").alias("orders"))
    window = asof.evidence_window(lookback_days=365)
    cutoffs = asof.month_starts(asof.as_date("1998-01-15"), asof.as_date("1998-12-31"))
    rows = daily.withColumn("cutoff", F.explode(F.filter(cutoffs, lambda c: window.holds(F.col("order_date"), c))))
    return rows.groupBy("cutoff").agg(F.sum("orders").alias("past_orders"))


@query(
    "t9_capped_future_events",
    """select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) rn from events
         where ts >= timestamp '2024-01-16') where rn <= 20""",
)
def _(t: Tables):
    future = t.events.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")).select("user_id", "event_id", "ts")
    return windows.first_rows(future, ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query(
    "t10_tracked_features",
    """with d as (select user_id, ts::date d, value, exp(-ln(2) / 14 * (date '2024-01-16' - ts::date)) w from events where ts::date < date '2024-01-16' and event_type in ('view', 'click'))
       select user_id, count(*) raw_count, round(sum(w), 6) + 0.0 effective_count, round(sum(value * w) / sum(w), 6) + 0.0 mean_value,
         round(sum((value between 8 and 32)::int * w) / sum(w), 6) + 0.0 sweet_share, min(d) first_date, max(d) last_date, count(*) >= 12 eligible from d group by 1""",
)
def _(t: Tables):
    rows = t.events.where("event_type in ('view', 'click')").select("user_id", F.to_date("ts").alias("event_date"), "value")
    measures = {"mean_value": F.col("value"), "sweet_share": F.col("value").between(8, 32).cast("double")}
    features = asof.tracked_features(
        rows, "user_id", "event_date", measures, asof.as_date(CUTOFF), asof.evidence_window(half_life_days=14), 12
    )
    return features.select(*[r6(c).alias(c) if c in ("effective_count", "mean_value", "sweet_share") else F.col(c) for c in features.columns])


@query(
    "t11_complete_measures",
    """select l_orderkey, l_linenumber::bigint l_linenumber, any_value(l_quantity) l_quantity, any_value(l_extendedprice) l_extendedprice from lineitem
       where l_returnflag = 'R' and l_discount > 0 and l_tax > 0 group by 1, 2 having count(*) = 1""",
)
def _(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey",
        big("l_linenumber").alias("l_linenumber"),
        "l_returnflag",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
    )
    complete = asof.complete_measures(rows, ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R", ["discount", "tax"])
    return complete.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "t12_environment_attach",
    """with k as (select user_id, d, min(event_type) lo, max(event_type) hi from (select user_id, ts::date d, event_type from events where event_type in ('purchase', 'signup')) group by 1, 2)
       select lo environment, count(*) event_count, count(distinct user_id) user_count from events join k on k.user_id = events.user_id and d = ts::date where lo = hi group by 1""".replace(
        "count(distinct user_id)", "count(distinct events.user_id)"
    ),
)
def _(t: Tables):
    rows = t.events.select("user_id", F.to_date("ts").alias("event_date"), "event_type")
    certified = rows.where("event_type in ('purchase', 'signup')").withColumnRenamed("event_type", "environment")
    attached, _faults = asof.attach_environment(rows.drop("event_type"), certified, ["user_id", "event_date"], "environment")
    return attached.groupBy("environment").agg(F.count("*").alias("event_count"), F.count_distinct("user_id").alias("user_count"))
