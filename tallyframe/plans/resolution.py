"""Overlapping-source resolution, authority overlays and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import authority, checks, consensus, lookup, profile
from tallyframe.plans.registry import Tables, big, query, r6

KEY = ["l_orderkey", "l_linenumber"]
FIELDS = ["l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


def _lines(t: Tables):
    return t.lineitem.withColumn("l_linenumber", big("l_linenumber"))


def _agree(field: str) -> str:
    return f"case when count(distinct {field}) <= 1 then min({field}) end {field}"


_CONFLICTS = "concat_ws('|', " + ", ".join(f"case when count(distinct {f}) > 1 then '{f}' end" for f in FIELDS) + ") conflict_fields"
_CONSENSUS = f"""select l_orderkey, l_linenumber::bigint l_linenumber, count(*) observation_variant_count, count(*) raw_source_row_count,
  {', '.join(_agree(f) for f in FIELDS)}, {_CONFLICTS}, {' + '.join(f'(count(distinct {f}) > 1)::bigint' for f in FIELDS)} conflict_field_count"""


@query("r1_field_consensus", f"{_CONSENSUS} from lineitem group by 1, 2")
def _(t: Tables):
    resolved = consensus.field_consensus(_lines(t), KEY, FIELDS)
    return resolved.withColumn("conflict_fields", F.array_join("conflict_fields", "|"))


@query(
    "r2_snapshot_consensus",
    f"""with s as (select *, 's' || l_partkey % 4 snap from lineitem) {_CONSENSUS.replace('count(*) raw_source_row_count', '''count(*) raw_source_row_count,
          count(distinct snap) source_snapshot_count, array_to_string(list_sort(list_distinct(list(snap))), '|') source_snapshot_ids''')}
        from s group by 1, 2""",
)
def _(t: Tables):
    rows = _lines(t).withColumn("snap", F.concat(F.lit("s"), (F.col("l_partkey") % 4).cast("string")))
    resolved = consensus.snapshot_consensus(rows, KEY, FIELDS, "snap")
    return resolved.withColumn("conflict_fields", F.array_join("conflict_fields", "|")).withColumn(
        "source_snapshot_ids", F.array_join("source_snapshot_ids", "|")
    )


@query(
    "r2_family_faults",
    """select 'n' || s normalization_id, 'missing_definition' fault from (select distinct l_partkey % 10 s from lineitem) where s = 9
       union all select '*', 'mixed_family' where (select count(distinct l_partkey % 10 = 3) from lineitem) > 1""",
)
def _(t: Tables):
    number = (F.col("l_partkey") % 10).cast("string")
    links = t.lineitem.select(
        F.concat(F.lit("n"), number).alias("normalization_id"), F.concat(F.lit("s"), number).alias("source_snapshot_id")
    ).distinct()
    # Definitions as the source declares them: one is missing and one was made by another version.
    definitions = links.where("normalization_id <> 'n9'").withColumn(
        "normalizer_version", F.when(F.col("normalization_id") == "n3", "2").otherwise("1")
    )
    return consensus.family_faults(links, definitions, ["normalizer_version"])


@query(
    "r3_positive_consensus",
    """select l_orderkey, l_linenumber::bigint l_linenumber, case when count(distinct l_suppkey) <= 1 then min(l_suppkey) end l_suppkey
       from lineitem group by 1, 2 having count(distinct l_returnflag) = 1 and min(l_returnflag) = 'R'""",
)
def _(t: Tables):
    resolved = consensus.field_consensus(_lines(t), KEY, ["l_suppkey", "l_returnflag"])
    return resolved.where("l_returnflag = 'R'").select(*KEY, "l_suppkey")


@query(
    "r4_vector_dominance",
    """with v as (select l_orderkey, l_linenumber::bigint l_linenumber, l_linestatus, l_quantity::bigint q, case when l_tax = 0 then null else
         round(l_tax * 100)::bigint end x, round(l_discount * 100)::bigint d from lineitem),
       g as (select l_orderkey, l_linenumber, count(*) n, max(q) q, max(x) x, max(d) d, count(distinct (q, x, d)) vectors,
         count(distinct l_linestatus) meta, min(l_linestatus) status from v group by 1, 2),
       h as (select g.*, exists (select 1 from v where v.l_orderkey = g.l_orderkey and v.l_linenumber = g.l_linenumber and v.q = g.q
         and v.x is not distinct from g.x and v.d = g.d) hit from g)
       select l_orderkey, l_linenumber, n observation_count, case when meta > 1 then 'unresolved_metadata_conflict' when vectors = 1 then 'consensus'
         when hit then 'componentwise_dominance' else 'unresolved_nonmonotonic_conflict' end resolution, case when meta = 1 then status end l_linestatus,
         case when meta = 1 and hit then q end quantity, case when meta = 1 and hit then x end tax, case when meta = 1 and hit then d end discount from h""",
)
def _(t: Tables):
    rows = _lines(t).select(
        *KEY,
        "l_linestatus",
        big("l_quantity").alias("quantity"),
        F.when(F.col("l_tax") != 0, big(F.round(F.col("l_tax") * 100))).alias("tax"),
        big(F.round(F.col("l_discount") * 100)).alias("discount"),
    )
    return consensus.dominance(rows, KEY, ["quantity", "tax", "discount"], ["l_linestatus"])


_EXACT = "(select distinct l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus from lineitem)"


@query(
    "r5_conflict_profile",
    f"""select (select count(*) from lineitem) raw_row_count, sum(v)::bigint exact_unique_row_count, count(*) key_count,
          sum((v > 1)::int)::bigint conflicting_key_count, sum(v - 1)::bigint conflicting_extra_row_count from (
            select count(*) v from {_EXACT} group by l_orderkey, l_linenumber)""",
)
def _(t: Tables):
    return consensus.conflict_profile(t.lineitem.select(*KEY, "l_suppkey", "l_returnflag", "l_linestatus"), KEY)[0]


@query(
    "r5_varying_columns",
    f"""select unnest(['l_suppkey', 'l_returnflag', 'l_linestatus']) column_name, unnest([sum((a > 1)::int)::bigint, sum((b > 1)::int)::bigint,
          sum((c > 1)::int)::bigint]) conflicting_group_count from (select count(distinct l_suppkey) a, count(distinct l_returnflag) b,
          count(distinct l_linestatus) c from {_EXACT} group by l_orderkey, l_linenumber having count(*) > 1)""",
)
def _(t: Tables):
    return consensus.conflict_profile(t.lineitem.select(*KEY, "l_suppkey", "l_returnflag", "l_linestatus"), KEY)[1]


_REUPLOAD = """(select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then null else o_orderstatus end o_orderstatus,
    case when o_orderkey % 15 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice, o_orderdate::date order_date from orders where o_orderkey % 17 <> 0)"""


def _reupload(t: Tables):
    """A second upload of the orders: some missing, some values revised, some blanked."""
    key = F.col("o_orderkey")
    return t.orders.where(key % 17 != 0).select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 10 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 15 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )


@query(
    "r6_partition_changes",
    f"""with j as (select a.o_orderkey k, b.o_orderkey k2, concat_ws('|', case when a.o_custkey is distinct from b.o_custkey then 'o_custkey' end,
          case when a.o_orderstatus is distinct from b.o_orderstatus then 'o_orderstatus' end,
          case when a.o_totalprice is distinct from b.o_totalprice then 'o_totalprice' end) c
          from (select * from orders where o_orderkey % 13 <> 0) a full join {_REUPLOAD} b on a.o_orderkey = b.o_orderkey)
        select case when k2 is null then 'left_only' when k is null then 'right_only' else 'both' end place,
          case when k is not null and k2 is not null then c else '' end changed_columns, count(*) key_count from j group by 1, 2""",
)
def _(t: Tables):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    left = t.orders.where("o_orderkey % 13 <> 0").select(*columns)
    compared = consensus.compare_partitions(left, _reupload(t), ["o_orderkey"])
    changed = F.coalesce(F.array_join("changed_columns", "|"), F.lit(""))
    return compared.groupBy("place", changed.alias("changed_columns")).agg(F.count("*").alias("key_count"))


@query(
    "r6_overlap_by_date",
    """select year(o_orderdate) order_year, count(*) overlap_count, sum((o_orderkey % 10 <> 0 and o_orderkey % 15 <> 0)::int)::bigint identical_count
       from orders where o_orderkey % 13 <> 0 and o_orderkey % 17 <> 0 group by 1""",
)
def _(t: Tables):
    left = t.orders.where("o_orderkey % 13 <> 0").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus", "o_totalprice")
    right = lookup.attach_one(_reupload(t), t.orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"])[0]
    compared = consensus.compare_partitions(left, right, ["o_orderkey", "o_orderdate"]).where("place = 'both'")
    return compared.groupBy(big(F.year("o_orderdate")).alias("order_year")).agg(
        F.count("*").alias("overlap_count"), F.count_if(F.size("changed_columns") == 0).alias("identical_count")
    )


_SNAP = """select l_orderkey, {}, count(distinct l_suppkey) > 1 xs, count(distinct l_returnflag) > 1 xr from lineitem where l_partkey % 2 = {}
    group by 1"""
_SNAP_FIELDS = "case when count(distinct l_suppkey) <= 1 then min(l_suppkey)::varchar end s, case when count(distinct l_returnflag) <= 1 then min(l_returnflag) end r"


@query(
    "r7_snapshot_field_outcomes",
    f"""with a as ({_SNAP.format(_SNAP_FIELDS, 0)}), b as ({_SNAP.format(_SNAP_FIELDS, 1)}),
        j as (select unnest(['l_suppkey', 'l_returnflag']) field, unnest([a.s, a.r]) l, unnest([b.s, b.r]) r, unnest([a.xs, a.xr]) lx, unnest([b.xs, b.xr]) rx
          from a join b using (l_orderkey))
        select field, count(*) filter (l is null and r is null) both_null_count, count(*) filter (l = r) equal_count,
          count(*) filter (l is not null and r is null) left_only_count, count(*) filter (l is null and r is not null) right_only_count,
          count(*) filter (l <> r) conflict_count, count(*) filter (lx) left_inner_conflict_count, count(*) filter (rx) right_inner_conflict_count
        from j group by 1""",
)
def _(t: Tables):
    fields = ["l_suppkey", "l_returnflag"]
    left = consensus.field_consensus(t.lineitem.where("l_partkey % 2 = 0"), ["l_orderkey"], fields)
    right = consensus.field_consensus(t.lineitem.where("l_partkey % 2 = 1"), ["l_orderkey"], fields)
    return consensus.compare_fields(left, right, ["l_orderkey"], fields)


@query(
    "r8_adjudicated_conflicts",
    """with l as (select l_orderkey, l_partkey % 3 snap, unnest(['status', 'flag']) field, unnest([l_linestatus, l_returnflag]) v from lineitem),
       c as (select l_orderkey, field from l group by 1, 2 having count(distinct v) > 1),
       s as (select l_orderkey, field, snap, count(distinct v) n, min(v) lo from l join c using (l_orderkey, field) group by 1, 2, 3),
       o as (select o_orderkey l_orderkey, unnest(['status', 'flag']) field, unnest([case when o_orderstatus <> 'P' then o_orderstatus end,
         case o_orderstatus when 'F' then 'R' when 'O' then 'N' end]) ov, true av from orders where o_orderkey % 19 <> 0),
       j as (select s.*, ov, coalesce(av, false) av from s left join o using (l_orderkey, field)),
       g as (select l_orderkey, field, any_value(ov) ov, any_value(av) av, count(*) k, sum((n > 1)::int)::bigint amb, coalesce(sum((n = 1 and lo = ov)::int), 0)::bigint hits,
         string_agg(snap, '|' order by snap) filter (n > 1) amb_ids, string_agg(snap, '|' order by snap) filter (n = 1 and lo = ov) hit_ids,
         string_agg(snap || '=' || lo, '|' order by snap) filter (n = 1) cands from j group by 1, 2),
       h as (select *, ov is not null and amb = 0 usable from g), m as (select *, case when usable then hits else 0 end m from h)
       select l_orderkey, field, ov official_value, av official_available, k candidate_snapshot_count, amb ambiguous_snapshot_count, m matching_snapshot_count,
         coalesce(amb_ids, '') ambiguous_snapshots, case when usable then coalesce(hit_ids, '') else '' end matching_snapshots, coalesce(cands, '') candidate_values,
         case when ov is null then 'official_unavailable' when amb > 0 then 'source_candidate_ambiguous' when m = 0 then 'official_matches_no_source_snapshot'
           when m = k then 'official_matches_all_source_snapshots' when m = 1 then 'official_matches_one_source_snapshot'
           else 'official_matches_multiple_source_snapshots' end status from m""",
)
def _(t: Tables):
    fields = ["status", "flag"]
    observations = t.lineitem.select(
        "l_orderkey", (F.col("l_partkey") % 3).alias("snap"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")
    )
    conflicts = consensus.field_consensus(observations, ["l_orderkey"], fields).where("conflict_field_count > 0")
    told = F.col("o_orderstatus")
    official = t.orders.where("o_orderkey % 19 <> 0").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(told != "P", told).alias("status"), F.when(told == "F", "R").when(told == "O", "N").alias("flag")
    )
    judged = authority.adjudicate(conflicts, observations, official, ["l_orderkey"], fields, "snap")
    shown = F.transform("candidate_values", lambda c: F.concat_ws("=", c["snapshot"].cast("string"), c["value"]))
    lists = {n: F.array_join(F.col(n).cast("array<string>"), "|") for n in ("ambiguous_snapshots", "matching_snapshots")}
    return judged.withColumns({**lists, "candidate_values": F.array_join(shown, "|")})


@query(
    "r9_authority_overlay",
    """select o_orderkey, coalesce(oc, sc) working_custkey, coalesce(os, ss) working_status, oc is not null or os is not null official_found,
         coalesce(oc <> sc, false) custkey_mismatch, coalesce(os <> ss, false) status_mismatch,
         case when oc is not null and os is not null then 'official' when sc is not null and ss is not null then 'source_only' else 'incomplete' end working_authority
       from (select o_orderkey, case when o_orderkey % 6 = 0 then null when o_orderkey % 8 = 0 then o_custkey + 1 else o_custkey end sc, o_orderstatus ss,
         case when o_orderkey % 4 <> 0 then o_custkey end oc, case when o_orderkey % 4 <> 0 then case o_orderstatus when 'P' then 'O' else o_orderstatus end end os from orders)""",
)
def _(t: Tables):
    key = F.col("o_orderkey")
    source = t.orders.select(
        "o_orderkey",
        F.when(key % 6 == 0, F.lit(None)).when(key % 8 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("custkey"),
        F.col("o_orderstatus").alias("status"),
    )
    official = t.orders.where("o_orderkey % 4 <> 0").select(
        "o_orderkey",
        F.col("o_custkey").alias("custkey"),
        F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    view = authority.overlay(source, official, ["o_orderkey"], ["custkey", "status"])
    return view.select(
        "o_orderkey", "working_custkey", "working_status", "official_found", "custkey_mismatch", "status_mismatch", "working_authority"
    )


_RESIDUAL = """select coalesce(a.k, b.k) order_key, coalesce(n, 0) observed_count, coalesce(m, 0) control_count, coalesce(n, 0) - coalesce(m, 0) difference
    from (select l_orderkey k, count(*) n from lineitem group by 1) a full join
      (select o_orderkey k, max(l_linenumber)::bigint m from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 23 <> 0 group by 1) b on a.k = b.k"""


def _residual(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("lines"), big(F.max("l_linenumber")).alias("last_line"))
    observed = lines.select("order_key", "lines")
    control = lines.where("order_key % 23 <> 0").select("order_key", F.col("last_line").alias("lines"))
    return authority.residuals(observed, control, ["order_key"], "lines")


@query("r10_control_residuals", f"select * from ({_RESIDUAL}) where difference <> 0")
def _(t: Tables):
    return _residual(t).where("difference <> 0")


@query(
    "r11_exception_overlay",
    f"""with e as (select order_key from ({_RESIDUAL}) where difference <> 0)
        select participant_authority, count(*) line_count, count(owner) owned_count, sum(owner)::bigint owner_sum from (
          select case when e.order_key is not null then 'official_exception_overlay' else 'source_default' end participant_authority,
            case when e.order_key is not null then o_custkey else l_suppkey end owner from lineitem left join e on e.order_key = l_orderkey
            left join orders on o_orderkey = l_orderkey) group by 1""",
)
def _(t: Tables):
    exceptions = authority.exception_groups(_residual(t), ["order_key"])
    rows = t.lineitem.select(F.col("l_orderkey").alias("order_key"), "l_suppkey")
    owners = t.orders.select(F.col("o_orderkey").alias("order_key"), "o_custkey")
    overlaid, _uncovered = authority.exception_overlay(
        rows, owners, exceptions, ["order_key"], ["order_key"], "l_suppkey", "o_custkey", "owner"
    )
    return overlaid.groupBy("participant_authority").agg(
        F.count("*").alias("line_count"), F.count("owner").alias("owned_count"), F.sum("owner").alias("owner_sum")
    )


_LABELS = """select user_id, ts::date d, event_type src, case when event_id % 29 = 0 then case event_type when 'view' then 'click' when 'click' then 'signup'
    when 'signup' then 'purchase' when 'purchase' then 'error' else 'view' end else event_type end ctl from events"""


@query(
    "r12_single_reassignments",
    f"""with e as ({_LABELS}), x as (select coalesce(a.user_id, b.user_id) user_id, coalesce(a.d, b.d) d, coalesce(a.t, b.t) t, coalesce(n, 0) n, coalesce(m, 0) m
          from (select user_id, d, src t, count(*) n from e group by all) a full join (select user_id, d, ctl t, count(*) m from e group by all) b
          on a.user_id = b.user_id and a.d = b.d and a.t = b.t)
        select user_id, d event_date, max(t) filter (n - m = 1) source_entity, max(t) filter (n - m = -1) reassigned_entity from x where n <> m group by 1, 2
        having count(*) = 2 and count(*) filter (n = 1 and m = 0) = 1 and count(*) filter (n - m = -1) = 1""",
)
def _(t: Tables):
    following = fn.map_value(F.col("event_type"), {"view": "click", "click": "signup", "signup": "purchase", "purchase": "error", "error": "view"})
    rows = t.events.select(
        "user_id",
        F.to_date("ts").alias("event_date"),
        F.col("event_type").alias("entity"),
        F.when(F.col("event_id") % 29 == 0, following).otherwise(F.col("event_type")).alias("control"),
    )
    observed = rows.groupBy("user_id", "event_date", "entity").agg(F.count("*").alias("units"))
    control = rows.groupBy("user_id", "event_date", F.col("control").alias("entity")).agg(F.count("*").alias("units"))
    residual = authority.residuals(observed, control, ["user_id", "event_date", "entity"], "units")
    return authority.single_reassignments(residual, ["user_id", "event_date"], "entity")


@query(
    "r13_quarantine",
    """select event_type, count(*) event_count from events where (user_id, ts::date) not in (
         select (user_id, ts::date) from events where value > 250) group by 1""",
)
def _(t: Tables):
    rows = t.events.withColumn("event_date", F.to_date("ts"))
    listed = rows.where("value > 250")
    return authority.quarantine(rows, listed, ["user_id", "event_date"]).groupBy("event_type").agg(F.count("*").alias("event_count"))


_DAYS = """(select ts::date d, user_id, count(*) n, sum((event_type = 'purchase')::int)::bigint p from events group by 1, 2)"""
_PINS = f"""(select d, user_id, user_id + 100000 target, n + (user_id % 2)::bigint pin_n, p pin_p from {_DAYS} where user_id % 10 in (0, 1))"""


def _corrections(t: Tables):
    days = t.events.groupBy(F.to_date("ts").alias("event_date"), "user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    )
    rows = days.withColumn("day", F.col("event_date"))
    listed = days.where("user_id % 10 in (0, 1)").select(
        "event_date",
        F.col("user_id").alias("source_entity"),
        (F.col("user_id") + 100000).alias("corrected_entity"),
        F.col("event_date").alias("pinned_day"),
        (F.col("events") + F.col("user_id") % 2).alias("pinned_events"),
        F.col("purchases").alias("pinned_purchases"),
    )
    # Targets of users ending in 20 hold an empty placeholder row, which a correction may absorb.
    empty = rows.where("user_id % 20 = 0").select(
        "event_date", (F.col("user_id") + 100000).alias("user_id"), F.lit(None).cast("bigint").alias("events"), F.lit(None).cast("bigint").alias("purchases"), "day"
    )
    return authority.apply_corrections(rows.unionByName(empty), listed, "event_date", "user_id", "day", ["events", "purchases"])


@query(
    "r13_identity_corrections",
    f"""select case when user_id % 10 = 0 then user_id + 100000 else user_id end user_id, sum(n)::bigint events, sum(p)::bigint purchases, count(*) day_count
        from {_DAYS} group by 1""",
)
def _(t: Tables):
    corrected, _status = _corrections(t)
    return corrected.groupBy("user_id").agg(
        F.sum("events").alias("events"), F.sum("purchases").alias("purchases"), F.count("*").alias("day_count")
    )


@query(
    "r13_correction_status",
    f"""select case when pin_n = n then 'applied' else 'vector_drifted' end status, count(*) correction_count from {_PINS} join {_DAYS} using (d, user_id) group by 1""",
)
def _(t: Tables):
    _corrected, status = _corrections(t)
    return status.groupBy("status").agg(F.count("*").alias("correction_count"))


_LEDGER = """l as (select user_id, ts::date d, count(*) n, sum((event_type = 'purchase')::int)::bigint p from events group by 1, 2),
  s as (select user_id, ts::date d, count(*) n, sum((event_type = 'purchase')::int)::bigint p from events
    where not (user_id % 3 = 0 and event_id % 13 = 0) group by 1, 2),
  x as (select user_id from (select user_id, sum(n) n, sum(p) p from s group by 1) a join (select user_id, sum(n) n, sum(p) p from l group by 1) b
    using (user_id) where (a.n, a.p) <> (b.n, b.p)),
  j as (select coalesce(s.user_id, l.user_id) user_id, coalesce(s.d, l.d) d, s.n sn, s.p sp, l.n ln, l.p lp from s full join l on s.user_id = l.user_id and s.d = l.d),
  k as (select j.*, x.user_id is not null res from j left join x using (user_id)),
  c as (select *, case when not res then 'source_kept' when sn is null then 'ledger_insert' when ln is null then 'source_only'
    when (sn, sp) <> (ln, lp) then 'ledger_overlay' else 'source_confirmed' end action from k where sn is not null or res)"""


def _ledger(t: Tables):
    rows = t.events.withColumn("event_date", F.to_date("ts"))

    def days(df):
        return df.groupBy("user_id", "event_date").agg(
            F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
        )

    source = days(rows.where("not (user_id % 3 = 0 and event_id % 13 = 0)"))
    return authority.ledger_authority(source, days(rows), ["user_id"], ["event_date"], ["events", "purchases"])


@query(
    "r14_ledger_rows",
    f"""with {_LEDGER} select user_id, d event_date, case when action in ('ledger_insert', 'ledger_overlay') then ln else sn end events,
          case when action in ('ledger_insert', 'ledger_overlay') then lp else sp end purchases, action from c""",
)
def _(t: Tables):
    return _ledger(t)[0]


@query(
    "r14_ledger_evidence",
    f"""with {_LEDGER} select * from (select user_id, d event_date, action, unnest(['events', 'purchases']) field, unnest([sn, sp]) source_value,
          unnest([ln, lp]) ledger_value from c where action in ('ledger_insert', 'ledger_overlay')) where ledger_value <> coalesce(source_value, 0)""",
)
def _(t: Tables):
    return _ledger(t)[1]


@query(
    "r15_sibling_enrichment",
    """select nation_authority, count(*) order_count, sum(nation)::bigint nation_sum from (select case when o_orderkey % 5 <> 0 then 'source'
         when c_custkey % 9 <> 0 then 'sibling' else 'missing' end nation_authority,
         case when o_orderkey % 5 <> 0 or c_custkey % 9 <> 0 then c_nationkey::bigint end nation from orders join customer on c_custkey = o_custkey) group by 1""",
)
def _(t: Tables):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), big("c_nationkey").alias("nation"))
    placed = t.orders.select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    rows = placed.withColumn("nation", F.when(F.col("o_orderkey") % 5 != 0, F.col("nation")))
    filled, _faults = authority.fill_from_sibling(rows, customers.where("o_custkey % 9 <> 0"), "o_custkey", "nation")
    return filled.groupBy("nation_authority").agg(F.count("*").alias("order_count"), F.sum("nation").alias("nation_sum"))


@query(
    "r16_authority_comparison",
    """with s as (select l_orderkey k, count(distinct l_linestatus) n, min(l_linestatus) v from lineitem group by 1),
       a as (select o_orderkey k, case when o_orderstatus <> 'P' then o_orderstatus end v from orders where o_orderkey % 11 <> 0)
       select 'l_linestatus' "role", case when a.k is null then 'source_only' when s.k is null then 'authority_only' when n > 1 then 'conflict'
         when a.v is null then 'missing' when a.v = s.v then 'matched' else 'mismatched' end status, count(*) key_count
       from s full join a on s.k = a.k group by 1, 2""",
)
def _(t: Tables):
    official = t.orders.where("o_orderkey % 11 <> 0").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    return authority.compare_to_authority(t.lineitem, official, ["l_orderkey"], {"l_linestatus": "status"})


_GAPS = """s as (select user_id, ts::date d, sum((event_type in ('view', 'click'))::int)::bigint n from events where event_type <> 'error' and event_id % 13 <> 0 group by 1, 2),
  a as (select user_id, ts::date d, sum((event_type in ('view', 'click'))::int)::bigint n from events where user_id % 9 <> 0 group by 1, 2),
  j as (select coalesce(s.user_id, a.user_id) user_id, coalesce(s.d, a.d) d, s.n sn, a.n an, case when a.d is null then 'source_only' when s.d is null and a.n = 0
    then 'zero_count_gap' when s.d is null then 'unexplained_gap' when s.n = a.n then 'count_matched' else 'count_mismatched' end status
    from s full join a on s.user_id = a.user_id and s.d = a.d)"""


def _gaps(t: Tables):
    """Days of a user as a feed without errors and with lost events has them, against the full record of most users."""
    rows = t.events.select("user_id", "event_id", "event_type", F.to_date("ts").alias("event_date"))

    def days(df):
        return df.groupBy("user_id", "event_date").agg(F.count_if(F.col("event_type").isin("view", "click")).alias("looks"))

    source = days(rows.where("event_type <> 'error' and event_id % 13 <> 0"))
    return authority.count_gaps(source, days(rows.where("user_id % 9 <> 0")), ["user_id"], "event_date", "looks")


@query("r16_unit_gaps", f"with {_GAPS} select user_id, d event_date, sn source_count, an official_count, status from j")
def _(t: Tables):
    return _gaps(t)[0]


@query(
    "r16_group_gaps",
    f"""with {_GAPS} select user_id, count(*) unit_count, {', '.join(f"count(*) filter (status = '{n}') {n}_count" for n in ('source_only', 'zero_count_gap', 'unexplained_gap', 'count_missing', 'count_matched', 'count_mismatched'))},
          coalesce(sum(abs(sn - an)) filter (status = 'count_mismatched'), 0)::bigint count_difference from j group by 1""",
)
def _(t: Tables):
    return _gaps(t)[1]


@query(
    "r17_label_collapse",
    """select label, conflict, count(*) key_count from (select case when count(distinct f) <= 1 then min(f) end label, count(distinct f) > 1 conflict from (
         select l_orderkey, l_linenumber, case when l_quantity < 17 then 'left' when l_quantity < 34 then 'center' when l_quantity < 48 then 'right' end f from lineitem)
         group by l_orderkey, l_linenumber) group by 1, 2""",
)
def _(t: Tables):
    q = F.col("l_quantity")
    coarse = F.when(q < 17, "left").when(q < 34, "center").when(q < 48, "right")
    resolved = consensus.field_consensus(_lines(t).select(*KEY, coarse.alias("label")), KEY, ["label"])
    return resolved.groupBy("label", (F.col("conflict_field_count") > 0).alias("conflict")).agg(F.count("*").alias("key_count"))


@query(
    "r18_terminal_text",
    r"""with c as (select conv_id, turn, text from conversations union all select conv_id, turn, replace(text, ' ', '  ') || chr(10) from conversations where conv_id % 2 = 0
          union all select conv_id, turn, text || ' revised' from conversations where conv_id % 7 = 0),
        l as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) v from c where turn = (select max(turn) from conversations x where x.conv_id = c.conv_id))
        select conv_id, turn terminal_position, count(*) terminal_row_count, count(distinct v) text_variant_count,
          case when count(distinct v) <= 1 then md5(min(v)) end text_md5 from l group by 1, 2""",
)
def _(t: Tables):
    said = t.conversations.select("conv_id", "turn", "text")
    padded = said.where("conv_id % 2 = 0").withColumn("text", F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n")))
    revised = said.where("conv_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" revised")))
    rows = said.unionByName(padded).unionByName(revised)
    last = consensus.terminal_text(rows, ["conv_id"], "turn", "text")
    spaced = F.trim(F.regexp_replace("terminal_text", r"\s+", " "))
    return last.select("conv_id", "terminal_position", "terminal_row_count", "text_variant_count", F.md5(spaced).alias("text_md5"))


@query(
    "r19_outcome_owner",
    """with e as (select user_id, ts::date d, event_id, ts, event_type, (props->>'$.k')::bigint % 2 actor from events),
       o as (select *, row_number() over (partition by user_id, d order by ts, event_id) rn, row_number() over (partition by user_id, d order by ts desc, event_id desc) rr from e),
       g as (select user_id, d, count(distinct actor) n, max(actor) filter (rn = 1) first_actor, max(actor) filter (rr = 1) last_actor,
         bool_or(rr = 1 and event_type in ('purchase', 'view')) fin from o group by 1, 2),
       s as (select o.user_id, o.d, min(rn) since from o join g on o.user_id = g.user_id and o.d = g.d and o.actor = g.last_actor group by 1, 2),
       b as (select o.user_id, o.d, sum((event_type in ('error', 'click') and rn < since)::int) strikes from o join s on o.user_id = s.user_id and o.d = s.d group by 1, 2)
       select g.user_id, g.d event_date, n actor_count, last_actor terminal_actor, case when n = 2 and first_actor <> last_actor and fin and strikes >= 2
         then first_actor else last_actor end outcome_actor from g join b on g.user_id = b.user_id and g.d = b.d""",
)
def _(t: Tables):
    rows = t.events.select(
        "user_id",
        F.to_date("ts").alias("event_date"),
        "ts",
        "event_id",
        "event_type",
        (F.get_json_object("props", "$.k").try_cast("bigint") % 2).alias("actor"),
    )
    kind = F.col("event_type")
    owner, _several = authority.outcome_owner(
        rows, ["user_id", "event_date"], ["ts", "event_id"], "actor", kind.isin("error", "click"), kind.isin("purchase", "view")
    )
    return owner


# --- checks ------------------------------------------------------------------------------------


@query(
    "q1_schema_conformance",
    """select 'o_custkey' column_name, 0::bigint lossy_cast_count, 0::bigint missing_count union all
       select 'o_orderdate', count(*) filter (o_orderstatus = 'F'), 0 from orders union all
       select 'o_orderkey', 0, count(*) filter (o_orderkey % 50 = 0) from orders""",
)
def _(t: Tables):
    raw = t.orders.select(
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey").cast("string")).alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.when(F.col("o_orderstatus") == "F", F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
    )
    _shaped, report = checks.conform(raw, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "date"}, ["o_orderkey"])
    return report


@query(
    "q2_duplicate_keys",
    "select l_orderkey, l_linenumber::bigint l_linenumber, count(*) row_count from lineitem group by 1, 2 having count(*) > 1",
)
def _(t: Tables):
    return checks.duplicate_keys(_lines(t), KEY)


@query(
    "q3_reference_chain",
    """select 'line_order' link, count(*) orphan_count from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 37 <> 0)
       union all select 'order_customer', count(*) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 41 <> 0)
       union all select 'customer_nation', count(*) from customer where c_nationkey not in (select n_nationkey from nation)""",
)
def _(t: Tables):
    return checks.broken_links(
        [
            ("line_order", t.lineitem, t.orders.where("o_orderkey % 37 <> 0"), {"l_orderkey": "o_orderkey"}),
            ("order_customer", t.orders, t.customer.where("c_custkey % 41 <> 0"), {"o_custkey": "c_custkey"}),
            ("customer_nation", t.customer, t.nation, {"c_nationkey": "n_nationkey"}),
        ]
    )


@query(
    "q4_value_domains",
    """select unnest(['flag_allowed', 'quantity_bounds', 'discount_bounds', 'name_pattern']) rule, unnest([count(*) filter (l_returnflag not in ('A', 'R')),
         count(*) filter (l_quantity not between 2 and 49), count(*) filter (not (l_discount >= 0 and l_discount <= 0.08)),
         count(*) filter (not regexp_matches(l_orderkey::varchar, '^[1-9][0-9]*$'))]) violation_count from lineitem""",
)
def _(t: Tables):
    return checks.rule_violations(
        t.lineitem,
        {
            "flag_allowed": F.col("l_returnflag").isin("A", "R"),
            "quantity_bounds": F.col("l_quantity").between(2, 49),
            "discount_bounds": F.col("l_discount").between(0, 0.08),
            "name_pattern": F.col("l_orderkey").cast("string").rlike("^[1-9][0-9]*$"),
        },
    )


@query(
    "q5_accounting_identity",
    """select user_id, n events, n - v - c - p accounting_residual from (select user_id, count(*) n, count(*) filter (event_type = 'view') v,
         count(*) filter (event_type = 'click') c, count(*) filter (event_type = 'purchase') p from events group by 1) where n - v - c - p <> 0""",
)
def _(t: Tables):
    kind = F.col("event_type")
    users = t.events.groupBy("user_id").agg(
        F.count("*").alias("events"), *[F.count_if(kind == k).alias(k) for k in ("view", "click", "purchase")]
    )
    residual = checks.identity_residual(users, F.col("events"), [F.col("view"), F.col("click"), F.col("purchase")])
    return residual.where("accounting_residual <> 0").select("user_id", "events", "accounting_residual")


@query(
    "q6_profile_faults",
    """select user_id, count(*) + (user_id % 7 = 0)::int declared_total, count(*) filter (not (user_id % 5 = 0 and event_type = 'error')) profile_total,
         count(distinct event_type) filter (not (user_id % 5 = 0 and event_type = 'error')) category_count from events group by user_id
       having count(*) + (user_id % 7 = 0)::int <> count(*) filter (not (user_id % 5 = 0 and event_type = 'error'))
         or count(distinct event_type) filter (not (user_id % 5 = 0 and event_type = 'error')) <> 5""",
)
def _(t: Tables):
    # Defects by key over whole tables: some summaries declare one event too many, some profiles lost a category.
    summary = t.events.groupBy("user_id").agg((F.count("*") + F.when(F.col("user_id") % 7 == 0, 1).otherwise(0)).alias("events"))
    profile_rows = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("occurrence_count"))
    profile_rows = profile_rows.where(~((F.col("user_id") % 5 == 0) & (F.col("event_type") == "error")))
    return checks.profile_faults(
        summary, profile_rows, ["user_id"], "events", "occurrence_count", "event_type", ["view", "click", "signup", "purchase", "error"]
    )


@query(
    "q6_simplex_faults",
    """select user_id, round(sum(s), 6) + 0.0 probability_sum from (select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) s
         from events group by 1, 2) where event_type <> 'error' or user_id % 2 = 0 group by 1 having abs(sum(s) - 1) > 1e-9""",
)
def _(t: Tables):
    shares = profile.shares(t.events, ["user_id"], "event_type", F.lit(1).cast("bigint"))
    kept = shares.where("event_type <> 'error' or user_id % 2 = 0")
    return checks.simplex_faults(kept, ["user_id"], "share").withColumn("probability_sum", r6("probability_sum"))


@query(
    "q7_grain_faults",
    """with f as (select user_id, event_type, count(*) n, sum((value >= 100)::int)::bigint b from events where event_id % 200 <> 0 group by 1, 2),
       c as (select user_id, event_type, count(*) n, sum((value >= 100)::int)::bigint b from events group by 1, 2)
       select c.user_id, c.event_type, f.n is not null in_fine, true in_coarse, coalesce(f.n, 0) fine_events, c.n coarse_events, coalesce(f.n, 0) - c.n events_difference,
         coalesce(f.b, 0) fine_big, c.b coarse_big, coalesce(f.b, 0) - c.b big_difference from c left join f on c.user_id = f.user_id and c.event_type = f.event_type
       where coalesce(f.n, 0) <> c.n or coalesce(f.b, 0) <> c.b""",
)
def _(t: Tables):
    measures = [F.count("*").alias("events"), F.count_if(F.col("value") >= 100).alias("big")]
    days = t.events.where("event_id % 200 <> 0").groupBy("user_id", "event_type", F.to_date("ts").alias("event_date")).agg(*measures)
    months = t.events.groupBy("user_id", "event_type").agg(*measures)
    return checks.grain_faults(days, months, ["user_id", "event_type"], ["events", "big"])


@query(
    "q8_conflict_issues",
    f"""select l_orderkey, l_linenumber, 'source_consensus_conflict' issue_code, 'warning' severity, 'line' entity_type, 'field_consensus' check_name, 'v1' check_version,
          conflict_fields from ({_CONSENSUS} from lineitem group by 1, 2) where conflict_field_count > 0""",
)
def _(t: Tables):
    resolved = consensus.field_consensus(_lines(t), KEY, FIELDS)
    issues = checks.conflict_issues(resolved, KEY, "line", "field_consensus", "v1")
    names = F.from_json("details_json", "conflict_fields array<string>")["conflict_fields"]
    # The oracle lists the fields in declaration order, so the sorted list is put back in it here.
    ordered = F.filter(F.array(*[F.lit(f) for f in FIELDS]), lambda f: F.array_contains(names, f))
    return issues.select(
        *KEY, "issue_code", "severity", "entity_type", "check_name", "check_version", F.array_join(ordered, "|").alias("conflict_fields")
    )


@query(
    "q9_coverage_faults",
    """with o as (select distinct case when s_nationkey % 6 = 0 then s_nationkey + 100 else s_nationkey end::bigint nation_key from supplier), e as (select n_nationkey::bigint nation_key from nation)
       select nation_key, 'absent' fault from e where nation_key not in (select nation_key from o)
       union all select nation_key, 'unexpected' from o where nation_key not in (select nation_key from e)""",
)
def _(t: Tables):
    # Every sixth nation's suppliers carry a key that no nation has.
    key = big("s_nationkey")
    observed = t.supplier.select(F.when(key % 6 == 0, key + 100).otherwise(key).alias("nation_key"))
    expected = t.nation.select(big("n_nationkey").alias("nation_key"))
    return checks.coverage_faults(observed, expected, ["nation_key"])


@query(
    "q10_capability_gate",
    """select capable, count(*) part_count from (select (p_brand, p_size) in (select (p_brand, p_size) from part where p_type = 'ECONOMY') capable from part) group by 1""",
)
def _(t: Tables):
    allowed = t.part.where("p_type = 'ECONOMY'")
    return checks.with_capability(t.part, allowed, ["p_brand", "p_size"]).groupBy("capable").agg(F.count("*").alias("part_count"))


@query(
    "q11_metadata_variants",
    """select *, count(*) over (partition by l_orderkey) variant_count from (select l_orderkey, l_returnflag, l_linestatus, count(*) evidence_row_count
         from lineitem group by 1, 2, 3)""",
)
def _(t: Tables):
    return checks.metadata_variants(t.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query(
    "q12_source_inventory",
    """with c as (select distinct user_id, event_type, ts::date d from events where event_type in ('view', 'purchase')),
       s as (select user_id, d, bool_or(event_type = 'view') a, bool_or(event_type = 'purchase') b from c group by 1, 2)
       select user_id, count(*) filter (a) left_period_count, count(*) filter (b) right_period_count, count(*) filter (a and b) shared_period_count,
         count(*) all_period_count, bool_and(a and b) parity from s group by 1""",
)
def _(t: Tables):
    rows = t.events.select("user_id", "event_type", F.to_date("ts").alias("event_date"))
    return checks.source_inventory(rows, ["user_id"], "event_type", "event_date", "view", "purchase")


_CERTIFIED = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "q13_certification",
    f"""with l as (select {", ".join(_CERTIFIED)} from lineitem),
         c as (select * replace (case when l_orderkey % 9 <> 0 then l_returnflag end as l_returnflag) from l
           union all select * from l where l_orderkey % 50 = 0 union all select * replace ('X' as l_linestatus) from l where l_orderkey % 50 = 1),
         k as (select count(*) n, count(distinct c) variants, min(l_shipdate) lo, max(l_shipdate) hi from c group by l_orderkey, l_linenumber)
       select (select count(*) from c) row_count, count(*) key_count, count(*) filter (n > 1) repeated_key_count,
         count(*) filter (n > 1 and variants = 1) exact_repeated_key_count, count(*) filter (variants > 1) conflicting_key_count,
         (select {" + ".join(f"count(*) filter ({c} is null)" for c in _CERTIFIED)} from c)::bigint null_cell_count, min(lo)::date first_date, max(hi)::date last_date,
         {", ".join(f"(select round(avg(({c} is null)::int), 6) + 0.0 from c) null_rate_{c}" for c in _CERTIFIED)} from k""",
)
def _(t: Tables):
    lines = t.lineitem.select(*_CERTIFIED)
    # Seeded: nulls in one column, exact repeats and conflicting ones.
    holes = lines.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_returnflag")))
    seeded = holes.unionByName(lines.where("l_orderkey % 50 = 0")).unionByName(lines.where("l_orderkey % 50 = 1").withColumn("l_linestatus", F.lit("X")))
    report = checks.certification(seeded, KEY, "l_shipdate")
    report = report.withColumns({f"null_rate_{c}": r6(f"null_rate_{c}") for c in _CERTIFIED})
    return report.withColumn("first_date", F.to_date("first_date")).withColumn("last_date", F.to_date("last_date"))
