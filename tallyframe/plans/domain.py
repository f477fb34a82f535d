"""The baseball configuration run over event, order and line rows given its column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.baseball import canonical, events, innings, seasons
from tallyframe.operators import authority, lookup
from tallyframe.plans.registry import Tables, big, query, r6
from tallyframe.sources import feeds, records

# --- classification ----------------------------------------------------------------------------

TRAJECTORIES = ["popup", "fly_ball", "line_drive", "ground_ball", "bunt_grounder", "unheard_of"]
_CONTACT = """b as (select l_orderkey, l_linenumber, (['popup', 'fly_ball', 'line_drive', 'ground_ball', 'bunt_grounder', 'unheard_of'])[1 + l_partkey % 6] bb,
    case when l_suppkey % 9 = 0 then null else l_extendedprice / 500 end x, l_quantity * 5 y, case l_returnflag when 'R' then 'R' when 'A' then 'L' else 'S' end side,
    case when l_suppkey % 7 = 0 then '  ' when l_suppkey % 7 = 1 then 'Batter flies out in Foul  Territory' else 'Batter flies out' end txt from lineitem),
  f as (select *, case bb when 'popup' then 'IFFB' when 'fly_ball' then 'OFFB' when 'line_drive' then 'LD' when 'ground_ball' then 'GB' when 'bunt_grounder' then 'BUNT' else 'UNKNOWN' end fam,
    atan2(x - 125.42, 198.27 - y) * 180 / pi() * 0.75 ang from b),
  d as (select *, case when x is null or side not in ('L', 'R') then null when abs(ang) <= 15 then 'CENTER' when (side = 'R') = (ang < 0) then 'PULL' else 'OPPO' end dir,
    case when fam not in ('IFFB', 'OFFB', 'LD') then false when trim(txt) = '' then null else regexp_matches(txt, '(?i)\\bfoul\\s+territory\\b') end foul from f),
  c as (select *, case when foul = false then case when fam = 'IFFB' then 'IFFB' when fam in ('OFFB', 'LD', 'GB') and dir is not null then dir || '_' || fam end end bin from d)"""


def _contacts(t: Tables):
    kind = F.element_at(F.array(*[F.lit(x) for x in TRAJECTORIES]), (1 + F.col("l_partkey") % 6).cast("int"))
    side = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_returnflag") == "A", "L").otherwise("S")
    text = F.when(F.col("l_suppkey") % 7 == 0, "  ").when(F.col("l_suppkey") % 7 == 1, "Batter flies out in Foul  Territory").otherwise("Batter flies out")
    return t.lineitem.select(
        F.col("l_orderkey").alias("game_pk"),
        big("l_linenumber").alias("at_bat_index"),
        kind.alias("bb_type"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_extendedprice") / 500).alias("hc_x"),
        (F.col("l_quantity") * 5).alias("hc_y"),
        side.alias("batter_side"),
        text.alias("result_description"),
        "l_tax",
    )


@query(
    "v2_contact_classifier",
    f"""with {_CONTACT} select fam trajectory_family, bin core_bin, case when fam = 'BUNT' then 'special_bunt' when fam = 'UNKNOWN' then 'unknown_missing_trajectory'
          when fam in ('OFFB', 'LD', 'GB') and dir is null then 'unknown_missing_direction' when foul is null then 'unknown_missing_foul_narrative' when foul then 'foul_air_excluded'
          when bin is not null then 'core_contact' else 'unknown_unclassified_contact' end contact_profile_status, count(*) contact_count from c group by 1, 2, 3""",
)
def _(t: Tables):
    classified = events.classify_contacts(_contacts(t))
    return classified.groupBy("trajectory_family", "core_bin", "contact_profile_status").agg(F.count("*").alias("contact_count"))


_PA = f"""{_CONTACT}, pa as (select o_orderkey, (['single', 'walk', 'strikeout', 'catcher_interf', 'field_out'])[1 + o_custkey % 5] ev, case when o_orderkey % 2 = 0 then 'R' else 'L' end side,
    case when o_orderkey % 11 = 0 then null when o_orderkey % 11 = 1 then 'pop out, foul territory' else 'plain out' end txt from orders),
  pc as (select l_orderkey, count(*) filter (l_quantity >= 40) n, count(*) filter (l_quantity < 3) u, max(struct_pack(a := l_linenumber, b := bb, c := x, d := y)) filter (l_quantity >= 40) ball
    from (select b.*, b.y / 5 l_quantity from b) group by 1),
  j as (select pa.*, coalesce(n, 0) n, coalesce(u, 0) u, case when n = 1 then ball.b end bb, case when n = 1 then ball.c end x, case when n = 1 then ball.d end y from pa left join pc on l_orderkey = o_orderkey),
  k as (select *, case bb when 'popup' then 'IFFB' when 'fly_ball' then 'OFFB' when 'line_drive' then 'LD' when 'ground_ball' then 'GB' when 'bunt_grounder' then 'BUNT' else 'UNKNOWN' end fam,
    atan2(x - 125.42, 198.27 - y) * 180 / pi() * 0.75 ang, ev in ('single', 'field_out') bip from j),
  m as (select *, case when x is null then null when abs(ang) <= 15 then 'CENTER' when (side = 'R') = (ang < 0) then 'PULL' else 'OPPO' end dir from k),
  q as (select *, case when n = 0 and u = 0 and ev = 'walk' then 'BB_HBP' when n = 0 and u = 0 and ev = 'strikeout' then 'K' when bip and n = 1 then case when fam = 'IFFB' then 'IFFB'
    when fam in ('OFFB', 'LD', 'GB') and dir is not null then dir || '_' || fam end end pre,
    case when not (bip and n = 1) or fam not in ('IFFB', 'OFFB', 'LD') then false when txt is null then null else txt like '%foul territory%' end foul from m)"""


def _sequences_and_pitches(t: Tables):
    kinds = F.array(*[F.lit(x) for x in ("single", "walk", "strikeout", "catcher_interf", "field_out")])
    key = F.col("o_orderkey")
    sequences = t.orders.select(
        key.alias("game_pk"),
        F.lit(0).cast("bigint").alias("at_bat_index"),
        F.lit("official_true_pa").alias("classification_status"),
        F.element_at(kinds, (1 + F.col("o_custkey") % 5).cast("int")).alias("result_event_type"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 11 == 1, "pop out, foul territory").otherwise("plain out").alias("result_description"),
        F.col("o_custkey").alias("batter_mlbam_id"),
        F.col("o_custkey").alias("pitcher_mlbam_id"),
        F.when(key % 2 == 0, "R").otherwise("L").alias("batter_side"),
    )
    quantity = F.col("hc_y") / 5
    pitches = _contacts(t).select(
        "game_pk",
        F.lit(0).cast("bigint").alias("at_bat_index"),
        F.col("at_bat_index").alias("pitch_number"),
        F.when(quantity >= 3, quantity >= 40).alias("is_in_play"),
        "bb_type",
        "hc_x",
        "hc_y",
        (F.col("l_tax") > 0.04).cast("int").alias("conflict_field_count"),
    )
    return sequences, pitches


@query(
    "v1_plate_appearances",
    f"""with {_PA} select ev event_type, case when not bip and n > 0 then 'unexpected_in_play_non_bip' when bip and n = 0 and u > 0 then 'conflicted_in_play_flag' when bip and n = 0 then 'missing_in_play_pitch'
          when bip and n > 1 then 'multiple_in_play_pitches' when ev = 'catcher_interf' then 'special_non_bip' when not bip then 'complete_non_bip' when fam = 'BUNT' then 'special_bunt'
          when fam = 'UNKNOWN' then 'missing_trajectory' when fam in ('OFFB', 'LD', 'GB') and dir is null then 'missing_direction' else 'complete_bip' end evidence_status,
          pre bin_before_foul_screen, case when foul = false then pre end core_bin, count(*) pa_count from q group by 1, 2, 3, 4""",
)
def _(t: Tables):
    classified = events.classify_plate_appearances(*_sequences_and_pitches(t))
    return classified.groupBy("event_type", "evidence_status", "bin_before_foul_screen", "core_bin").agg(F.count("*").alias("pa_count"))


@query(
    "v1_event_detail",
    f"""with {_PA}, co as (select l_orderkey ok, count(*) filter (l_tax > 0.04) conflicts, max(l_linenumber) filter (l_quantity >= 40) line from lineitem group by 1)
        select ev event_type, case when not (bip and n = 1) then 'not_evaluable_unclean_or_non_bip' when fam not in ('IFFB', 'OFFB', 'LD') then 'not_foul_air_trajectory'
          when txt is null then 'unknown_missing_official_description' when txt like '%foul territory%' then 'foul_air_official_foul_territory' else 'not_foul_air_official_description' end foul_air_status,
          pre is not null eligible_before_foul_screen, count(*) pa_count, coalesce(sum(conflicts), 0)::bigint conflict_count, sum(case when n = 1 then line end)::bigint in_play_numbers,
          round(sum(ang), 4) angle_sum from q left join co on ok = o_orderkey group by 1, 2, 3""",
)
def _(t: Tables):
    classified = events.classify_plate_appearances(*_sequences_and_pitches(t))
    return classified.groupBy("event_type", "foul_air_status", "eligible_before_foul_screen").agg(
        F.count("*").alias("pa_count"),
        F.sum("source_conflict_pitch_count").alias("conflict_count"),
        F.sum("in_play_pitch_number").alias("in_play_numbers"),
        r6(F.sum("spray_angle"), 4).alias("angle_sum"),
    )


NARRATIVES = [
    "Player singles on a line drive",
    "Player grounds into a double play, shortstop to second",
    "Player reaches on a throwing error by third baseman",
    "Player reaches on a fielder's choice out",
    "Player reaches on a fielder's choice, runner scores",
    "Player out on a sacrifice fly. Runner doubles back",
    "Player out on a bunt pop out",
    "   ",
]


@query(
    "b7_result_narratives",
    """with g as (select (['1B', 'MULTI_OUT', 'ROE', 'OUT', 'FC_REACH', null, null, null])[1 + l_partkey % 8] grp, (['supported_narrative_fallback', 'supported_narrative_fallback',
         'supported_narrative_fallback', 'supported_narrative_fallback', 'supported_narrative_fallback', 'ambiguous_narrative_groups', 'unsupported_bunt', 'unsupported_blank_description'])[1 + l_partkey % 8] st,
         case grp when '1B' then 0.4651970407443663 when 'MULTI_OUT' then -0.8151401718384932 when 'ROE' then 0.43273757678346964 when 'OUT' then -0.24975231369042597
           when 'FC_REACH' then 0.1558534038205505 end::double val from lineitem)
       select grp terminal_outcome_group, st terminal_outcome_status, count(*) contact_count, round(sum(val), 4) + 0.0 value_total from g group by 1, 2""",
)
def _(t: Tables):
    text = F.element_at(F.array(*[F.lit(n) for n in NARRATIVES]), (1 + F.col("l_partkey") % 8).cast("int"))
    grouped = events.with_narrative_group(t.lineitem.select(text.alias("pa_description")), "pa_description")
    valued, _unknown = events.attach_result_values(grouped)
    return valued.groupBy("terminal_outcome_group", "terminal_outcome_status").agg(
        F.count("*").alias("contact_count"), r6(F.sum("terminal_value"), 4).alias("value_total")
    )


# --- half-innings ------------------------------------------------------------------------------

# A user's day stands in for a half-inning: an error is an out, a large value is a run.
_REPLAY = """e as (select user_id g, ts::date d, event_id a, (event_type = 'error')::int o, (props->>'$.k')::bigint % 8 b, (value >= 60)::int r from events),
  m as (select *, coalesce(sum(o) over w, 0)::bigint so, coalesce(sum(r) over w, 0)::bigint ss, coalesce(lag(b) over (partition by g, d order by a), 0) sb from e
    window w as (partition by g, d order by a rows between unbounded preceding and 1 preceding)),
  c as (select *, so + o eo, case when so + o >= 3 then 0 else b end eb, ss + r es, row_number() over (partition by g, d order by a desc) = 1 term from m where so <= 2 and so + o <= 3),
  h as (select g, d, max(eo) filter (term) fo, max(es) filter (term) fs from c group by 1, 2),
  x as (select so, sb, avg(fs - ss) re, count(*) n, count(distinct g) k from c join h using (g, d) where fo = 3 group by 1, 2),
  z as (select c.*, b.re rb, case when term then 0 else a.re end ra from c left join x b on b.so = c.so and b.sb = c.sb left join x a on a.so = c.eo and a.sb = c.eb)"""


def _replayed(t: Tables):
    deltas = t.events.select(
        F.col("user_id").alias("game_pk"),
        F.to_date("ts").alias("inning"),
        F.when(F.day("ts") % 2 == 1, "top").otherwise("bottom").alias("half_inning"),
        F.col("event_id").alias("at_bat_index"),
        F.lit(0).cast("bigint").alias("transition_index"),
        (F.col("event_type") == "error").cast("bigint").alias("outs_made"),
        (F.get_json_object("props", "$.k").try_cast("bigint") % 8).alias("bases_after"),
        (F.col("value") >= 60).cast("bigint").alias("runs_scored"),
    )
    return innings.replay(deltas)


@query(
    "v3_half_inning_replay",
    f"""with {_REPLAY} select a at_bat_index, so start_outs, sb start_bases_code, ss start_bat_score, so + o end_outs, case when so + o >= 3 then 0 else b end end_bases_code, ss + r end_bat_score,
          so <= 2 and so + o <= 3 re24_state_event_candidate, coalesce(sum(case when day(d) % 2 = 1 then r else 0 end) over y, 0)::bigint start_away_score,
          coalesce(sum(case when day(d) % 2 = 0 then r else 0 end) over y, 0)::bigint start_home_score, coalesce(sum(r) over x, 0)::bigint start_game_score, sum(r) over z::bigint end_game_score
        from m window y as (partition by g order by a rows between unbounded preceding and 1 preceding),
          x as (partition by g, day(d) % 2 order by a rows between unbounded preceding and 1 preceding), z as (partition by g, day(d) % 2 order by a rows unbounded preceding)""",
)
def _(t: Tables):
    scores = ["start_away_score", "start_home_score", "start_game_score", "end_game_score"]
    return _replayed(t).select(
        "at_bat_index", "start_outs", "start_bases_code", "start_bat_score", "end_outs", "end_bases_code", "end_bat_score", "re24_state_event_candidate", *scores
    )


@query(
    "v4_base_out_expectancy",
    f"with {_REPLAY} select so start_outs, sb start_bases_code, round(re, 6) + 0.0 run_expectancy, n state_sample_size, k state_game_count from x",
)
def _(t: Tables):
    return innings.run_expectancy(_replayed(t)).withColumn("run_expectancy", r6("run_expectancy"))


@query(
    "v5_contextual_runs",
    f"with {_REPLAY} select a at_bat_index, term is_half_terminal_transition, round(rb, 6) + 0.0 run_expectancy_before, round(ra, 6) + 0.0 run_expectancy_after, round(r + ra - rb, 6) + 0.0 re24 from z",
)
def _(t: Tables):
    rows = _replayed(t)
    valued = innings.contextual_runs(rows, innings.run_expectancy(rows))
    return valued.select(
        "at_bat_index", "is_half_terminal_transition", *[r6(c).alias(c) for c in ("run_expectancy_before", "run_expectancy_after", "re24")]
    )


# --- canonical tables and feeds ----------------------------------------------------------------


@query(
    "z1_canonical_rules",
    """select 'normalization_id' rule, count(*) violation_count from orders where o_orderkey % 31 = 0 union all select 'season_agrees', count(*) from orders where o_orderkey % 29 = 0
       union all select 'evidence_row_count', count(*) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
)
def _(t: Tables):
    key = F.col("o_orderkey")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("evidence_row_count"))
    games = lookup.with_counts(t.orders, lines, ["o_orderkey"]).select(
        F.when(key % 31 == 0, "not a digest").otherwise(F.sha2(key.cast("string"), 256)).alias("normalization_id"),
        F.sha2(F.lit("snapshot"), 256).alias("source_snapshot_id"),
        key.alias("game_pk"),
        F.sha2(F.concat_ws("|", key.cast("string"), "o_orderstatus"), 256).alias("payload_hash"),
        "evidence_row_count",
        F.to_date("o_orderdate").alias("official_date"),
        (F.year("o_orderdate") + (key % 29 == 0).cast("int")).alias("season"),
    )
    return canonical.violations(games, "game")


@query(
    "z2_roster_membership",
    """select c_mktsegment segment, count(*) filter (c_custkey % 10 <> 0) member_count, count(*) filter (c_custkey % 10 = 0) ambiguous_count,
         sum(case when c_custkey % 10 <> 0 then 1 + (c_acctbal > 0)::int else 0 end)::bigint status_count from customer group by 1""",
)
def _(t: Tables):
    def entry(name, code):
        person = F.struct(F.col("c_custkey").alias("id"), name.alias("fullName"), F.lit("/people").alias("link"))
        return F.struct(person.alias("person"), F.struct(code.alias("code")).alias("status"))

    other = F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit(" Jr"))).otherwise(F.col("c_name"))
    second = F.when(F.col("c_acctbal") > 0, "D").otherwise("A")
    roster = F.array(entry(F.col("c_name"), F.lit("A")), entry(other, second))
    documents = t.customer.select(F.col("c_mktsegment").alias("segment"), F.to_json(F.struct(roster.alias("roster"))).alias("document"))
    rows = feeds.roster_rows(documents, "document", ("segment",))
    members, ambiguous = feeds.roster_membership(rows, ("segment",))
    counts = members.groupBy("segment").agg(F.count("*").alias("member_count"), F.sum(F.size("status_codes")).alias("status_count"))
    return counts.join(ambiguous.groupBy("segment").agg(F.count("*").alias("ambiguous_count")), "segment")


@query(
    "z2_steal_splits",
    """select (1990 + c_nationkey)::bigint season, count(*) player_count, sum(c_custkey % 40 + c_custkey % 6)::bigint attempts, sum(c_custkey % 90 + c_custkey % 30 - c_custkey % 3 + c_custkey % 4
         - c_custkey % 20 - c_custkey % 5 - c_custkey % 10)::bigint opportunity_proxy from customer group by 1""",
)
def _(t: Tables):
    sizes = {"plateAppearances": 500, "hits": 90, "doubles": 20, "triples": 5, "homeRuns": 10, "baseOnBalls": 30, "intentionalWalks": 3, "hitByPitch": 4, "stolenBases": 40, "caughtStealing": 6}
    pairs = [part for name, size in sizes.items() for part in (F.lit(name), (F.col("c_custkey") % size).cast("string"))]
    split = F.struct(F.struct(F.col("c_custkey").alias("id")).alias("player"), F.create_map(*pairs).alias("stat"))
    document = F.to_json(F.struct((1990 + F.col("c_nationkey")).cast("string").alias("season"), F.array(split).alias("splits")))
    stints = feeds.steal_stints(t.customer.select(document.alias("document")))
    return stints.groupBy("season").agg(
        F.count("*").alias("player_count"), big(F.sum("attempts")).alias("attempts"), big(F.sum("opportunity_proxy")).alias("opportunity_proxy")
    )


@query(
    "z3_outcome_vectors",
    """select o_custkey player_id, count(*) batting_pa, count(*) filter (k in (1, 2, 3)) walk_or_hit_count, count(*) filter (k = 4) strikeout_count, count(*) filter (k = 0) single_count
       from (select o_custkey, o_orderkey % 6 k from orders) group by 1""",
)
def _(t: Tables):
    names = F.array(*[F.lit(x) for x in ("single", "walk", "intent_walk", "hit_by_pitch", "strikeout", "field_out")])
    rows = t.orders.select(F.col("o_custkey").alias("player_id"), F.element_at(names, (1 + F.col("o_orderkey") % 6).cast("int")).alias("event_type"))
    group = events.outcome_group(F.col("event_type"))
    return rows.groupBy("player_id").agg(
        F.count("*").alias("batting_pa"),
        F.count_if(group.isin("walk", "intentional_walk", "hit_by_pitch")).alias("walk_or_hit_count"),
        F.count_if(group == "strikeout").alias("strikeout_count"),
        F.count_if(events.result_group(F.col("event_type")) == "1B").alias("single_count"),
    )


@query(
    "z12_pitch_recording",
    """select event_type result_event_type, count(*) pa_count, sum(n)::bigint recorded, sum(greatest(m - n, 0))::bigint gap_total, sum((m > n)::int)::bigint gap_count from (
         select event_type, (select count(*) from range(1, 2 + k) r(i) where i % 4 <> 0) n, (select coalesce(max(i), 0) from range(1, 2 + k) r(i) where i % 4 <> 0) m
         from (select event_type, (props->>'$.k')::bigint % 9 k from events)) group by 1""",
)
def _(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("bigint") % 9
    # Every fourth entry of a play is not a pitch, which leaves a gap in the pitch numbers.
    entries = F.transform(F.sequence(F.lit(1).cast("bigint"), k + 1), lambda i: F.struct(i.alias("pitchNumber"), (i % 4 != 0).alias("isPitch")))
    play = F.struct(
        F.struct(F.col("event_id").alias("atBatIndex")).alias("about"),
        F.struct(F.col("event_type").alias("eventType")).alias("result"),
        entries.alias("playEvents"),
    )
    documents = t.events.select(F.to_json(F.struct(F.col("user_id").alias("gamePk"), F.array(play).alias("allPlays"))).alias("document"))
    recorded = feeds.pitch_recording(feeds.plays(documents))
    return recorded.groupBy("result_event_type").agg(
        F.count("*").alias("pa_count"),
        F.sum("recorded_pitch_event_count").alias("recorded"),
        F.sum("pitch_number_gap").alias("gap_total"),
        F.count_if(F.col("pitch_number_gap") > 0).alias("gap_count"),
    )


@query(
    "z21_same_environment_pairs",
    """select a.n_regionkey::bigint region_key, count(*) line_count from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation a on a.n_nationkey = c_nationkey
       join supplier on s_suppkey = l_suppkey join nation b on b.n_nationkey = s_nationkey where a.n_regionkey = b.n_regionkey group by 1""",
)
def _(t: Tables):
    region = t.nation.select("n_nationkey", big("n_regionkey").alias("region_key"))
    buyers = t.customer.join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("region_key").alias("buyer_region"))
    sellers = t.supplier.join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "region_key")
    orders = t.orders.join(buyers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "buyer_region")
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(sellers, "l_suppkey").join(orders, "l_orderkey")
    return lines.where("buyer_region = region_key").groupBy("region_key").agg(F.count("*").alias("line_count"))


# --- second-source ledgers ---------------------------------------------------------------------

_SECOND = """s as (select user_id, ts::date d, count(*) n, sum((event_type = 'purchase')::int)::bigint p from events group by 1, 2), l as (select * from s where (user_id + day(d)) % 11 <> 0),
  x as (select user_id, d, n + (user_id % 4 = 0)::int n, p from s where user_id % 6 <> 0), g as (select s.*, x.n xn, x.p xp, x.user_id is not null hit from s left join x on x.user_id = s.user_id and x.d = s.d
    where (s.user_id + day(s.d)) % 11 = 0)"""


def _second_source(t: Tables):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("event_date")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    )
    ledger = days.where((F.col("user_id") + F.day("event_date")) % 11 != 0)
    second = days.where("user_id % 6 <> 0").withColumn("events", F.col("events") + (F.col("user_id") % 4 == 0).cast("bigint"))
    return authority.confirmed_gaps(days, ledger, second, ["user_id", "event_date"], ["events", "purchases"])


@query(
    "r14_confirmed_ledger_gaps",
    f"""with {_SECOND} select 'ledger' authority, count(*) row_count, sum(n)::bigint events from l union all select 'second_source', count(*), sum(n)::bigint from g where hit and n = xn and p = xp
        union all select 'no_second_source', count(*), null from g where not hit union all select 'values_differ', count(*), null from g where hit and (n, p) <> (xn, xp)""",
)
def _(t: Tables):
    filled, still_open = _second_source(t)
    known = filled.groupBy("authority").agg(F.count("*").alias("row_count"), F.sum("events").alias("events"))
    return known.unionByName(
        still_open.groupBy(F.col("reason").alias("authority")).agg(F.count("*").alias("row_count")).withColumn("events", F.lit(None).cast("bigint"))
    )


@query(
    "r14_residual_quarantine",
    """with s as (select user_id, ts::date d, count(*) n, sum((event_type = 'purchase')::int)::bigint p from events group by 1, 2), f as (select user_id, min(d) d, case when user_id % 3 = 0 then min(d) end d1 from s group by 1),
       m as (select user_id, max(d) lastd from s group by 1), o as (select s.*, s.d = f.d first_day, s.d = lastd last_day from s join f using (user_id) join m using (user_id)),
       u as (select user_id, count(*) filter (first_day and user_id % 3 = 0 or last_day and user_id % 6 = 0) extra from o group by 1)
       select case when extra > 1 then 'several_source_only_rows' when user_id % 9 = 0 then 'season_residual_differs' else 'quarantined' end verdict, count(*) entity_count from u where extra > 0 group by 1""",
)
def _(t: Tables):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("event_date")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    )
    spans = days.groupBy("user_id").agg(F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))
    placed = days.join(spans, "user_id")
    first = (F.col("event_date") == F.col("first_day")) & (F.col("user_id") % 3 == 0)
    last = (F.col("event_date") == F.col("last_day")) & (F.col("user_id") % 6 == 0)
    ledger = placed.where(~(first | last)).select(*days.columns)
    residual = placed.where(first).select(
        "user_id",
        (F.col("events") + (F.col("user_id") % 9 == 0).cast("bigint")).alias("residual_events"),
        F.col("purchases").alias("residual_purchases"),
    )
    _kept, verdicts = authority.residual_quarantine(days, ledger, residual, ["user_id"], ["event_date"], ["events", "purchases"])
    return verdicts.groupBy("verdict").agg(F.count("*").alias("entity_count"))


@query(
    "z6_explained_slices",
    """with s as (select user_id, ts::date d, count(*) n from events where event_type = 'purchase' and value > 150 group by 1, 2), c as (select user_id, count(*) k from s group by 1)
       select user_id from c where k = 1 and user_id % 2 = 0""",
)
def _(t: Tables):
    large = t.events.where("event_type = 'purchase' and value > 150")
    source = large.groupBy("user_id", F.to_date("ts").alias("event_date")).agg(F.count("*").alias("n"))
    # The ledger knows odd users only; every user's season residual equals one of their source days.
    ledger = source.where("user_id % 2 = 1")
    residual = source.groupBy("user_id").agg(F.max("n").alias("residual_n"))
    kept, verdicts = authority.residual_quarantine(source, ledger, residual, ["user_id"], ["event_date"], ["n"])
    return authority.fully_explained(kept, ledger, verdicts, ["user_id"], "n")


@query(
    "z8_dimension_self_check",
    """select p_brand, count(distinct p_type) type_count, count(*) part_count from part group by 1 having count(distinct p_type) > 1""",
)
def _(t: Tables):
    # One type per brand is the rule; each brand that breaks it is listed.
    pairs = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return pairs.groupBy("p_brand").agg(F.count("*").alias("type_count"), F.sum("n").alias("part_count")).where("type_count > 1")


@query(
    "z15_field_audit",
    """select l_linestatus, count(*) row_count, count(*) filter (l_discount is null) missing_count, count(*) filter (l_quantity not between 1 and 50) out_of_range_count,
         count(*) filter (l_extendedprice < l_quantity * 100) identity_break_count, min(l_quantity)::bigint lowest, max(l_quantity)::bigint highest from lineitem group by 1""",
)
def _(t: Tables):
    quantity = F.col("l_quantity")
    return t.lineitem.groupBy("l_linestatus").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("l_discount").isNull()).alias("missing_count"),
        F.count_if(~quantity.between(1, 50)).alias("out_of_range_count"),
        F.count_if(F.col("l_extendedprice") < quantity * 100).alias("identity_break_count"),
        big(F.min(quantity)).alias("lowest"),
        big(F.max(quantity)).alias("highest"),
    )


# --- feed documents ----------------------------------------------------------------------------

# Every document is one row made of its keys; broken entries are planted by remainders of the key.


def _statuses(rows, faults, group, **sums):
    """Rows and faults counted in one table, with ``sums`` over the rows."""
    kept = rows.groupBy(*group, F.lit("kept").alias("status")).agg(F.count("*").alias("entry_count"), *[big(F.sum(c)).alias(n) for n, c in sums.items()])
    empty = [F.lit(None).cast("bigint").alias(n) for n in sums]
    return kept.unionByName(faults.groupBy(*group, F.col("fault").alias("status")).agg(F.count("*").alias("entry_count"), *empty))


def _judged_statuses(rows, group, **sums):
    """The same of rows that carry their ``fault``, in one reading."""
    kept = F.col("fault").isNull()
    totals = [big(F.sum(F.when(kept, F.col(c) if isinstance(c, str) else c))).alias(n) for n, c in sums.items()]
    return rows.groupBy(*group, F.coalesce("fault", F.lit("kept")).alias("status")).agg(F.count("*").alias("entry_count"), *totals)


def _numbers(**values):
    """A JSON object of counts written as text."""
    return F.create_map(*[part for name, value in values.items() for part in (F.lit(name), value.cast("string"))])


def _spread(rows, key, *others):
    """The columns that documents are made of, dealt out by key: a small file is one task, but its documents are much to parse."""
    return rows.select(key, *others).repartition(key)


_POSITIONS = ["P", "C", "1B", "2B", "3B", "SS", "LF", "CF", "RF", "DH", "XX"]


@query(
    "a5_fielding_splits",
    """with e as (select c_custkey k, c_mktsegment level_group, i from customer, (values (1), (2)) v(i) where not (c_custkey % 101 = 0 and i = 2)),
         s as (select *, (k % 900) * 3 + k % 4 outs, case when k % 101 = 0 then 'unreadable_document' when i = 2 and k % 17 <> 0 then 'invalid_player_id'
           when k % 11 = 10 then 'unknown_position_code' when k % 13 = 0 then 'position_code_mismatch' when k % 160 > k % 150 then 'more_starts_than_games' when k % 4 = 3 then 'invalid_innings'
           when k % 11 = 9 and (k % 900) * 3 + k % 4 <> 0 then 'designated_hitter_with_outs' when k % 17 = 0 then 'repeated_grain' end fault from e)
       select level_group, coalesce(fault, 'kept') status, count(*) entry_count, sum(case when fault is null then outs end)::bigint fielding_outs,
         sum(case when fault is null then k % 160 end)::bigint starts from s group by 1, 2""",
)
def _(t: Tables):
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in _POSITIONS])
    place = F.struct(
        (1 + k % 11).cast("string").alias("code"),
        F.when(k % 13 == 0, "?").otherwise(F.element_at(names, (1 + k % 11).cast("int"))).alias("abbreviation"),
        F.lit("Fielder").alias("name"),
    )
    innings_text = F.concat((k % 900).cast("string"), F.lit("."), (k % 4).cast("string"))
    stat = F.create_map(
        *[F.lit("games"), (k % 150).cast("string"), F.lit("gamesPlayed"), (k % 150).cast("string")],
        *[F.lit("gamesStarted"), (k % 160).cast("string"), F.lit("innings"), innings_text],
    )
    who = F.struct(k.alias("id"), F.col("c_name").alias("fullName"))
    entry = F.to_json(F.struct(who.alias("player"), F.struct(F.col("c_nationkey").alias("id")).alias("team"), place.alias("position"), stat.alias("stat")))
    text = F.concat(F.lit('{"splits":['), entry, F.lit(","), F.when(k % 17 == 0, entry).otherwise("5"), F.lit("]}"))
    documents = _spread(t.customer, "c_custkey", "c_name", "c_nationkey", "c_mktsegment").select(
        big(F.lit(1990) + F.col("c_nationkey")).alias("season"),
        big("c_nationkey").alias("league_id"),
        F.col("c_mktsegment").alias("level_group"),
        F.when(k % 101 == 0, "no document").otherwise(text).alias("document"),
    )
    usage, faults = records.fielding_usage(documents, "document")
    return _statuses(usage, faults, ["level_group"], fielding_outs="fielding_outs", starts="games_started")


def _boxscores(t: Tables):
    k = F.col("o_orderkey")

    def player(key, person, batting):
        value = F.struct(F.struct(person.alias("id")).alias("person"), F.struct(batting.alias("batting")).alias("stats"))
        return F.struct(F.concat(F.lit("ID"), key.cast("string")), value)

    def side(players, batting):
        return F.struct(F.map_from_entries(F.array(*players)).alias("players"), F.struct(batting.alias("batting")).alias("teamStats"))

    first = player(k, k, _numbers(plateAppearances=k % 6, hits=k % 3))
    line = _numbers(plateAppearances=k % 4, hits=F.when(k % 9 == 0, -1).otherwise(1))
    second = player(k + 1000000000, k + 1000000000, F.when(k % 8 != 1, line))
    third = player(2 * k, F.when(k % 5 == 0, 3 * k).otherwise(2 * k), _numbers(plateAppearances=k % 6, hits=F.lit(0)))
    away = side([first, second], _numbers(plateAppearances=k % 6 + k % 4 + (k % 10 == 0).cast("int"), hits=k % 3 + 1))
    home = side([third], _numbers(plateAppearances=k % 6, hits=F.lit(0)))
    text = F.to_json(F.struct(F.struct(away.alias("away"), home.alias("home")).alias("teams")))
    return _spread(t.orders, "o_orderkey").select(k.alias("game_pk"), F.when(k % 97 == 0, '{"teams": 3}').otherwise(text).alias("document"))


_BOX = """o as (select o_orderkey k from orders), g as (select k from o where k % 97 <> 0),
  p as (select k, 'away' batting_side, 'kept' status, k % 6 pa, k % 3 hits from g
    union all select k, 'away', case when k % 9 = 0 then 'invalid_statistic' else 'kept' end, k % 4, 1 from g where k % 8 <> 1
    union all select k, 'home', case when k % 5 = 0 then 'player_key_mismatch' else 'kept' end, k % 6, 0 from g
    union all select k, s, 'unreadable_document', null, null from o, (values ('away'), ('home')) v(s) where k % 97 = 0)"""


@query(
    "a5_boxscore_lines",
    f"""with {_BOX} select batting_side, status, count(*) entry_count, sum(case when status = 'kept' then pa end)::bigint plate_appearances,
          sum(case when status = 'kept' then hits end)::bigint hits from p group by 1, 2""",
)
def _(t: Tables):
    lines = records.boxscore_lines(_boxscores(t), "document")
    return _judged_statuses(lines, ["batting_side"], plate_appearances="plate_appearances", hits="hits")


@query(
    "a5_boxscore_gaps",
    f"""with {_BOX}, t as (select k, 'away' batting_side, k % 6 + k % 4 + (k % 10 = 0)::int pa, k % 3 + 1 hits from g union all select k, 'home', k % 6, 0 from g),
          s as (select k, batting_side, sum(pa) pa, sum(hits) hits from p where status = 'kept' group by 1, 2),
          d as (select t.batting_side, 'plate_appearances' statistic, t.pa stated, coalesce(s.pa, 0) summed from t left join s using (k, batting_side)
            union all select t.batting_side, 'hits', t.hits, coalesce(s.hits, 0) from t left join s using (k, batting_side))
        select batting_side, statistic, count(*) gap_count, sum(stated - summed)::bigint gap_sum from d where stated <> summed group by 1, 2""",
)
def _(t: Tables):
    documents = _boxscores(t)
    lines, _faults = records.boxscore_players(documents, "document")
    gaps = records.boxscore_gaps(lines, records.boxscore_teams(documents, "document"))
    return gaps.groupBy("batting_side", "statistic").agg(F.count("*").alias("gap_count"), big(F.sum(F.col("stated") - F.col("summed"))).alias("gap_sum"))


def _play_documents(t: Tables):
    """Each event a game: a play, the same play with its names in another order, and at times an unknown or a contrary one."""
    k = F.col("event_id")

    def play(index, kind, batter, swapped=False):
        parts = [
            F.struct(kind.alias("eventType"), F.lit("text").alias("description")).alias("result"),
            F.struct(F.struct(batter.alias("id")).alias("batter"), F.struct(k.alias("id")).alias("pitcher")).alias("matchup"),
            F.lit(index).alias("atBatIndex"),
            F.array(F.struct(F.lit(True).alias("isPitch")), F.struct((k % 2 == 0).alias("isPitch"))).alias("playEvents"),
        ]
        return F.to_json(F.struct(*(parts[::-1] if swapped else parts)))

    kind = F.when(F.col("event_type") == "error", "wild_pitch").when(F.col("event_type") == "purchase", "home_run").otherwise("single")
    user = F.col("user_id")
    extra = F.when(k % 6 == 0, play(1, F.lit("unheard_of"), user)).when(k % 10 == 1, play(0, kind, user + 1)).otherwise("[]")
    text = F.concat(F.lit('{"allPlays":['), play(0, kind, user), F.lit(","), play(0, kind, user, True), F.lit(","), extra, F.lit("]}"))
    return _spread(t.events, "event_id", "user_id", "event_type").select(k.alias("game_pk"), text.alias("document"))


_EVENT_KINDS = {**dict.fromkeys(events.v.PLATE_APPEARANCE_EVENTS, True), "wild_pitch": False}


@query(
    "z2_play_sequences",
    """with e as (select event_id k, case event_type when 'error' then 'wild_pitch' when 'purchase' then 'home_run' else 'single' end kind from events)
       select kind result_event_type, 'kept' status, sum(1 + (k % 6 <> 0 and k % 10 = 1)::int)::bigint entry_count, sum(2 + (k % 6 <> 0 and k % 10 = 1)::int)::bigint copies,
         sum((1 + (k % 2 = 0)::int) * (1 + (k % 6 <> 0 and k % 10 = 1)::int))::bigint pitches, sum((1 + (k % 6 <> 0 and k % 10 = 1)::int) * (kind <> 'wild_pitch')::int)::bigint appearances from e group by 1
       union all select null, case when k % 6 = 0 then 'unknown_event_type' else 'missing_at_bat_index' end, count(*), null, null, null from e where k % 6 = 0 or k % 10 <> 1 group by 2""",
)
def _(t: Tables):
    plays, faults = records.play_sequences(_play_documents(t), "document", _EVENT_KINDS)
    unnamed = faults.withColumn("result_event_type", F.lit(None).cast("string"))
    return _statuses(
        plays, unnamed, ["result_event_type"], copies="duplicate_row_count", pitches="official_physical_pitch_count", appearances=F.col("is_plate_appearance").cast("int")
    )


@query(
    "z2_participant_authority",
    """select user_id official_batter_id, count(*) filter (event_id % 6 = 0 or event_id % 10 <> 1) sequence_count from events group by 1 having sequence_count > 0
       union all select null, count(*) from events where event_id % 6 <> 0 and event_id % 10 = 1""",
)
def _(t: Tables):
    plays, _faults = records.play_sequences(_play_documents(t), "document", _EVENT_KINDS)
    named, several = records.participant_authority(plays)
    conflicts = several.agg(F.count("*").alias("sequence_count")).select(F.lit(None).cast("bigint").alias("official_batter_id"), "sequence_count")
    return named.groupBy("official_batter_id").agg(F.count("*").alias("sequence_count")).unionByName(conflicts)


@query(
    "z2_game_leagues",
    """with s as (select o_custkey % 30 l, case when o_orderkey % 53 = 0 then 'unreadable_document' when o_orderkey % 8 = 0 then 'not_regular_season' when o_orderkey % 9 = 0 then 'missing_official_date'
         when o_orderkey % 10 = 0 then 'missing_team' when o_orderkey % 11 = 0 then 'ambiguous_league' when o_orderkey % 13 = 0 then 'ambiguous_sport' end fault, o_orderdate::date d from orders)
       select case when fault is null then l end league_id, coalesce(fault, 'kept') status, count(*) entry_count, sum(case when fault is null then year(d) end)::bigint year_sum from s group by 1, 2""",
)
def _(t: Tables):
    k, league = F.col("o_orderkey"), F.col("o_custkey") % 30

    def team(side):
        other = 1 if side == "home" else 0
        ids = F.when((k % 10 != 0) | F.lit(side == "away"), k + other)
        return F.struct(
            ids.alias("id"),
            F.struct((league + F.when(k % 11 == 0, other).otherwise(0)).alias("id")).alias("league"),
            F.struct(F.when((k % 13 != 0) | F.lit(side == "away"), 1).alias("id")).alias("sport"),
        ).alias(side)

    data = F.struct(
        F.struct(F.when(k % 8 == 0, "S").otherwise("R").alias("type")).alias("game"),
        F.struct(F.when(k % 9 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("officialDate")).alias("datetime"),
        F.struct(team("away"), team("home")).alias("teams"),
    )
    text = F.when(k % 53 == 0, "[").otherwise(F.to_json(F.struct(data.alias("gameData"))))
    games, faults = records.game_leagues(_spread(t.orders, "o_orderkey", "o_custkey", "o_orderdate").select(k.alias("game_pk"), text.alias("document")), "document")
    return _statuses(games, faults.withColumn("league_id", F.lit(None).cast("bigint")), ["league_id"], year_sum=F.year("game_date"))


@query(
    "z2_game_log",
    """with s as (select o_custkey p, o_orderkey % 4 c, o_orderkey % 5 n from orders),
         r as (select p, 'kept' status, (c <> 1)::int rows_, case when c = 0 then 2 * n else n end pa, (c = 0)::int added from s
           union all select p, case c when 1 then 'ambiguous_team_splits' when 2 then 'missing_game' else 'other_sport' end, 1, null, null from s where c > 0)
       select status, count(*) entry_count, sum(pa)::bigint batting_pa, sum(added)::bigint added_games from r where rows_ = 1 group by 1""",
)
def _(t: Tables):
    k = F.col("o_orderkey")
    case = k % 4

    def split(team, game, sport):
        stat = _numbers(**{n: (k % 5) for n in records.OUTCOME_STATISTICS})
        parts = [F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("R").alias("gameType"), game.alias("game"), F.struct(F.lit(103).alias("id")).alias("league")]
        return F.struct(*parts, F.struct(team.alias("id")).alias("team"), F.struct(sport.alias("id")).alias("sport"), stat.alias("stat"))

    def game(present):
        return F.struct(*[F.when(present & (k % 3 == i), k).alias(f) for i, f in enumerate(("gamePk", "pk", "id"))])

    whole = split(F.lit(1), game(F.lit(True)), F.lit(1))
    second = split(F.when(case == 0, 2).otherwise(1), game(case != 2), F.when(case == 3, 9).otherwise(1))
    groups = F.array(F.struct(F.array(whole).alias("splits")), F.struct(F.array(second).alias("splits")), F.struct(F.when(F.lit(False), F.array(second)).alias("splits")))
    rows = _spread(t.orders, "o_orderkey", "o_custkey", "o_orderdate")
    documents = rows.select(F.col("o_custkey").alias("player_id"), big(F.lit(1)).alias("sport_id"), F.to_json(F.struct(groups.alias("stats"))).alias("document"))
    games = records.game_log_rows(documents, "document")
    return _judged_statuses(games, [], batting_pa="batting_PA", added_games=F.col("team_id").isNull().cast("int"))


def _lines_and_contacts(t: Tables):
    """Orders as batting lines (some unresolved, some without a value), their lines as contacts."""
    k = F.col("o_orderkey")
    vector = {"AB": k % 6, "BB": k % 3, "HBP": F.lit(0), "SO": F.least(k % 2, k % 6), "SF": (k % 7 == 0).cast("int"), "SH": F.when(k % 19 != 0, 0), "CI": F.lit(0)}
    total = vector["AB"] + vector["BB"] + vector["SF"] + (k % 13 == 0).cast("int")
    lines = t.orders.select(
        F.to_date("o_orderdate").alias("game_date"),
        F.lit("R").alias("game_type"),
        k.alias("game_pk"),
        big(F.lit(103)).alias("league_id"),
        F.col("o_custkey").alias("player_id"),
        F.when(k % 17 == 0, "unresolved_conflict").otherwise("resolved").alias("outcome_resolution"),
        big(total).alias("batting_PA"),
        *[big(c).alias(f"batting_{n}") for n, c in vector.items()],
    )
    core, number = F.col("l_linestatus") == "F", F.col("l_linenumber")
    status = F.when(core, "core_contact").when(number == 1, "special_bunt").when(number == 2, "foul_air_excluded").otherwise("unknown_missing_direction")
    contacts = t.lineitem.join(lines.select(F.col("game_pk").alias("l_orderkey"), "player_id", F.year("game_date").cast("bigint").alias("season")), "l_orderkey").select(
        "season",
        F.col("l_orderkey").alias("game_pk"),
        big(F.lit(103)).alias("league_id"),
        "player_id",
        F.when(core, F.concat(F.lit("BIN_"), number.cast("string"))).alias("core_bin"),
        status.alias("contact_profile_status"),
        F.when(F.col("l_returnflag") == "R", "official_exception_overlay").otherwise("source_default").alias("participant_authority"),
    )
    return lines, contacts


@query(
    "s3_line_evidence",
    """with l as (select o_orderkey g, o_custkey p, year(o_orderdate)::bigint season, o_orderdate::date d, o_orderkey % 6 ab, o_orderkey % 3 bb, least(o_orderkey % 2, o_orderkey % 6) so, (o_orderkey % 7 = 0)::int sf,
           (o_orderkey % 13 = 0)::int res, o_orderkey % 17 = 0 bad, o_orderkey % 19 = 0 gap from orders),
         o as (select *, ab + bb + sf + res pa, ab - so + sf expected from l where ab + bb + sf + res > 0 and not bad and not gap),
         c as (select l_orderkey g, count(*) seen, count(*) filter (l_linestatus = 'F') bins, count(*) filter (l_linestatus <> 'F' and l_linenumber = 1) bunts, count(*) filter (l_linestatus <> 'F' and l_linenumber = 2) fouls,
           count(*) filter (l_linestatus <> 'F' and l_linenumber > 2) unknown, count(*) filter (l_returnflag = 'R') overlay from lineitem group by 1),
         e as (select o.*, coalesce(seen, 0) seen, coalesce(bins, 0) bins, coalesce(bunts, 0) bunts, coalesce(fouls, 0) fouls, coalesce(unknown, 0) unknown, coalesce(overlay, 0) overlay from o left join c using (g))
       select season, case when seen = 0 then 'no_contact_identity_needed' when overlay = 0 then 'source_default' when overlay = seen then 'official_overlay' else 'mixed_source_and_official' end participant_authority_status,
         count(*) game_count, sum(pa)::bigint pa, sum(seen - expected)::bigint contact_residual, sum(bb + so + bins)::bigint core, sum(bunts)::bigint bunts, sum(fouls)::bigint fouls, sum(unknown)::bigint unknown,
         sum(pa - expected - bb - so)::bigint pa_residual from e group by 1, 2""",
)
def _(t: Tables):
    summary, _profile, _faults = seasons.line_evidence(*_lines_and_contacts(t))
    return summary.groupBy("season", "participant_authority_status").agg(
        F.count("*").alias("game_count"),
        F.sum("batting_plate_appearances").alias("pa"),
        F.sum("contact_count_residual").alias("contact_residual"),
        F.sum("core_profile_event_count").alias("core"),
        F.sum("bunt_contact_count").alias("bunts"),
        F.sum("foul_air_excluded_count").alias("fouls"),
        F.sum("unknown_contact_count").alias("unknown"),
        F.sum("pa_accounting_residual").alias("pa_residual"),
    )


@query(
    "s3_line_profile",
    """with l as (select o_orderkey g, o_orderkey % 6 + o_orderkey % 3 + (o_orderkey % 7 = 0)::int + (o_orderkey % 13 = 0)::int pa, o_orderkey % 3 bb, least(o_orderkey % 2, o_orderkey % 6) so from orders),
         o as (select * from l where pa > 0 and g % 17 <> 0 and g % 19 <> 0)
       select 'BB_HBP' core_bin, sum(bb)::bigint occurrence_count, count(*) game_count from o where bb > 0 union all select 'K', sum(so)::bigint, count(*) from o where so > 0
       union all select 'BIN_' || l_linenumber, count(*), count(distinct g) from lineitem join o on l_orderkey = g where l_linestatus = 'F' group by 1
       union all select case when g % 17 = 0 then 'unresolved_outcome' else 'incomplete_vector' end, null, count(*) from l where pa > 0 and (g % 17 = 0 or g % 19 = 0) group by 1""",
)
def _(t: Tables):
    _summary, profile, faults = seasons.line_evidence(*_lines_and_contacts(t))
    bins = profile.groupBy("core_bin").agg(F.sum("occurrence_count").alias("occurrence_count"), F.count("*").alias("game_count"))
    left_out = faults.groupBy(F.col("fault").alias("core_bin")).agg(F.lit(None).cast("bigint").alias("occurrence_count"), F.count("*").alias("game_count"))
    return bins.unionByName(left_out)
