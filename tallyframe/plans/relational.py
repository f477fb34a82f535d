"""Sources, scalar functions, joins, aggregates, windows, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import lookup, profile, scan, windows
from tallyframe.plans.registry import Tables, big, query, r6
from tallyframe.sources import feeds, files

# --- sources and sinks -------------------------------------------------------------------------


@query(
    "a1_text_scan",
    "select s_suppkey, s_name, s_nationkey::bigint s_nationkey, s_acctbal from supplier",
)
def _(t: Tables):
    folder = files.work_folder(t.spark, "text")
    t.supplier.write.option("header", True).csv(folder)
    text = files.read_text_table(t.spark, folder, t.supplier.columns)
    return files.typed(text, {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "bigint", "s_acctbal": "double"})


@query(
    "a2_csv_tree_manifest",
    "select p_brand, count(*) row_count, sum(p_size)::bigint total_size from part group by 1",
)
def _(t: Tables):
    folder = files.work_folder(t.spark, "tree")
    t.part.write.option("header", True).partitionBy("p_brand").csv(folder)
    rest = [c for c in t.part.columns if c != "p_brand"]
    chunks = files.read_text_table(t.spark, f"{folder}/*", rest)
    per_file = chunks.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("row_count"), F.sum(fn.whole_number(F.col("p_size"))).alias("total_size")
    )
    brand = F.url_decode(F.regexp_extract("path", "p_brand=([^/]+)", 1))
    return per_file.groupBy(F.regexp_replace(brand, "%23", "#").alias("p_brand")).agg(
        F.sum("row_count").alias("row_count"), F.sum("total_size").alias("total_size")
    )


@query(
    "a3_typed_csv_scan",
    "select p_partkey, p_size::bigint p_size, p_retailprice from part where p_type = 'ECONOMY'",
)
def _(t: Tables):
    folder = files.work_folder(t.spark, "typed")
    t.part.write.option("header", True).csv(folder)
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    rows = files.read_typed_table(t.spark, folder, schema, ["p_partkey", "p_type", "p_size", "p_retailprice"])
    return rows.where("p_type = 'ECONOMY'").select("p_partkey", big("p_size").alias("p_size"), "p_retailprice")


@query(
    "a4_sharded_dimension",
    "select c_custkey, c_name, c_nationkey::bigint c_nationkey from customer where c_name is not null",
)
def _(t: Tables):
    folder = files.work_folder(t.spark, "shards")
    t.customer.repartition(4).write.option("header", True).csv(folder)
    people = files.read_text_table(t.spark, f"{folder}/part-*.csv", t.customer.columns)
    rows = files.typed(people, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint"})
    return rows.where("c_custkey is not null and c_name is not null")


@query(
    "a5_json_props",
    """select event_type, count(*) event_count, sum((props->>'$.k')::bigint)::bigint k_total,
       min((props->>'$.k')::bigint) k_min, max((props->>'$.k')::bigint) k_max from events group by 1""",
)
def _(t: Tables):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("event_count"), F.sum(k).alias("k_total"), F.min(k).alias("k_min"), F.max(k).alias("k_max")
    )


@query(
    "a5_nested_feed_rows",
    """select role, line_position, count(*) line_count, sum(length(line))::bigint line_chars from (
         select role, unnest(string_split(text, chr(10))) line,
                unnest(range(len(string_split(text, chr(10))))) line_position from conversations)
       group by 1, 2""",
)
def _(t: Tables):
    turn = F.struct("role", F.split("text", "\n").alias("lines"))
    feed = t.conversations.select(F.to_json(F.struct("conv_id", F.array(turn).alias("turns"))).alias("document"))
    schema = "struct<conv_id: bigint, turns: array<struct<role: string, lines: array<string>>>>"
    turns = feeds.json_rows(feed, F.col("document"), schema, "turns")
    lines = turns.select("item.role", F.posexplode("item.lines").alias("line_position", "line"))
    return lines.groupBy("role", big("line_position").alias("line_position")).agg(
        F.count("*").alias("line_count"), F.sum(F.length("line")).alias("line_chars")
    )


@query(
    "a6_parquet_manifest",
    "select 'orders' table_name, count(*) row_count, 6::bigint column_count from orders",
)
def _(t: Tables):
    manifest = files.write_table(t.orders, files.work_folder(t.spark, "orders"), "orders")
    return manifest.drop("schema_fingerprint")


_MONTHS = """select year(o_orderdate) "year", month(o_orderdate) "month", count(*) row_count"""


@query(
    "a7_month_partitions",
    f"""{_MONTHS}, round(sum(l_extendedprice), 2) + 0.0 revenue
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
)
def _(t: Tables):
    dates = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    facts = files.with_event_month(t.lineitem, dates, "l_orderkey", "o_orderdate")
    folder = files.work_folder(t.spark, "months")
    # Rebalancing groups a month's rows into few files and splits a month that is too large.
    dated = facts.where("year is not null").hint("rebalance", "year", "month")
    dated.write.partitionBy("year", "month").option("compression", "zstd").parquet(folder)
    stored = t.spark.read.parquet(folder)
    return stored.groupBy(big("year").alias("year"), big("month").alias("month")).agg(
        F.count("*").alias("row_count"), r6(F.sum("l_extendedprice"), 2).alias("revenue")
    )


@query(
    "a8_partition_faults",
    """with x as (select l_orderkey k, case when l_orderkey % 17 = 0 then o_orderdate + interval 1 month else o_orderdate end d
         from lineitem join orders on l_orderkey = o_orderkey)
       select year(d)::bigint "year", month(d)::bigint "month", count(*) row_count, count(*) filter (k % 13 = 0) orphan_count,
         count(*) filter (k % 17 = 0 and k % 13 <> 0) misplaced_count from x group by 1, 2""",
)
def _(t: Tables):
    dates = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    # Seeded: some orders are filed a month late, and some have no date when the files are verified.
    filed = dates.withColumn("o_orderdate", F.when(F.col("l_orderkey") % 17 == 0, F.add_months("o_orderdate", 1)).otherwise(F.to_date("o_orderdate")))
    facts = files.with_event_month(t.lineitem.select("l_orderkey", "l_linenumber"), filed, "l_orderkey", "o_orderdate")
    folder = files.work_folder(t.spark, "verify")
    facts.where("year is not null").hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(folder)
    known = dates.withColumn("o_orderdate", F.when(F.col("l_orderkey") % 13 != 0, F.col("o_orderdate")))
    faults = files.partition_faults(t.spark.read.parquet(folder), known, "l_orderkey", "o_orderdate")
    return faults.select(
        big("year").alias("year"), big("month").alias("month"), "row_count", "orphan_count", "misplaced_count"
    )


@query(
    "a9_environment_scan",
    "select distinct user_id, event_type, ts::date as event_date from events where event_type in ('purchase', 'signup')",
)
def _(t: Tables):
    certified = t.events.where(F.col("event_type").isin("purchase", "signup"))
    return certified.select("user_id", "event_type", F.to_date("ts").alias("event_date")).distinct()


# --- scalar functions --------------------------------------------------------------------------


@query(
    "b1_filter_project",
    """select l_orderkey, l_linenumber::bigint l_linenumber, l_extendedprice from lineitem
       where l_returnflag = 'R' and l_quantity < 3 and l_shipdate >= timestamp '1998-01-01'""",
)
def _(t: Tables):
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 3) & late)
    return rows.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_extendedprice")


@query(
    "b2_whole_number",
    """select l_linenumber::bigint l_linenumber, count(*) row_count, count(q) parsed_count, sum(q)::bigint total from (
         select l_linenumber, case when x = floor(x) then x::bigint end q from (
           select l_linenumber, case when l_linenumber = 3 then l_quantity + 0.5 else l_quantity end x from lineitem))
       group by 1""",
)
def _(t: Tables):
    uneven = F.when(F.col("l_linenumber") == 3, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity"))
    parsed = t.lineitem.withColumn("q", fn.whole_number(uneven.cast("string")))
    return parsed.groupBy(big("l_linenumber").alias("l_linenumber")).agg(
        F.count("*").alias("row_count"), F.count("q").alias("parsed_count"), F.sum("q").alias("total")
    )


@query(
    "b3_first_date",
    """select o_orderpriority, count(*) row_count, count(d) parsed_count, min(d) first_date, max(d) last_date from (
         select o_orderpriority, case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then null
           else o_orderdate::date end d from orders) group by 1""",
)
def _(t: Tables):
    # Three text layouts by status, one of them unreadable for even keys.
    text = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyyMMdd"))
        .when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM d"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    )
    parsed = t.orders.withColumn("d", fn.first_date(text))
    return parsed.groupBy("o_orderpriority").agg(
        F.count("*").alias("row_count"), F.count("d").alias("parsed_count"), F.min("d").alias("first_date"), F.max("d").alias("last_date")
    )


@query(
    "b4_present_text",
    """select lang, count(*) row_count, sum(case when text is not null and trim(text) <> '' then 1 else 0 end)::bigint present_count
       from documents group by 1""",
)
def _(t: Tables):
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("row_count"), F.count_if(fn.present(F.col("text"))).alias("present_count")
    )


@query(
    "b5_membership",
    """select user_id, sum(case when event_type in ('view', 'click') then 1 else 0 end)::bigint browse_count,
         sum(case when event_type in ('purchase', 'signup') then 1 else 0 end)::bigint convert_count from events group by 1""",
)
def _(t: Tables):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.count_if(fn.member(kind, ["view", "click"])).alias("browse_count"),
        F.count_if(fn.member(kind, ["purchase", "signup"])).alias("convert_count"),
    )


@query(
    "b6_case_taxonomy",
    """select evidence_status, count(*) row_count from (select case
         when l_returnflag = 'R' and l_linestatus = 'O' then 'returned_open'
         when l_returnflag = 'R' and l_discount > 0.05 then 'returned_discounted'
         when l_returnflag = 'R' then 'returned'
         when l_discount = 0 then 'full_price'
         when l_tax = 0 then 'untaxed'
         when l_linestatus = 'F' then 'complete' else 'open' end evidence_status from lineitem) group by 1""",
)
def _(t: Tables):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    label = fn.first_case(
        [
            ((flag == "R") & (status == "O"), "returned_open"),
            ((flag == "R") & (F.col("l_discount") > 0.05), "returned_discounted"),
            (flag == "R", "returned"),
            (F.col("l_discount") == 0, "full_price"),
            (F.col("l_tax") == 0, "untaxed"),
            (status == "F", "complete"),
        ],
        "open",
    )
    return t.lineitem.groupBy(label.alias("evidence_status")).agg(F.count("*").alias("row_count"))


@query(
    "b7_narrative_groups",
    r"""select doc_id, groups, case when blank then 'blank' when len(g) = 1 then 'supported'
          when len(g) > 1 then 'ambiguous' else 'unsupported' end status from (
          select *, array_to_string(list_sort(g), '|') groups from (
            select doc_id, text is null or trim(text) = '' blank,
              list_filter([case when regexp_matches(text, '[\w.]+@[\w.]+') then 'contact' end,
                           case when regexp_matches(text, '(?i)\blicen[cs]e') then 'license' end,
                           case when regexp_matches(text, 'https?://') then 'link' end], lambda x: x is not null) g
            from documents))""",
)
def _(t: Tables):
    patterns = [(r"[\w.]+@[\w.]+", "contact"), (r"(?i)\blicen[cs]e", "license"), (r"https?://", "link")]
    labelled = fn.with_text_groups(t.documents, F.col("text"), patterns)
    return labelled.select("doc_id", F.array_join("groups", "|").alias("groups"), "status")


@query(
    "b8_category_value",
    """select user_id, round(sum((case event_type when 'view' then 0.1 when 'click' then 0.3 when 'signup' then 1.5
         when 'purchase' then 3.0 end)::double), 6) + 0.0 worth, sum(case when event_type = 'error' then 1 else 0 end)::bigint unknown_count
       from events group by 1""",
)
def _(t: Tables):
    worth = fn.map_value(F.col("event_type"), {"view": 0.1, "click": 0.3, "signup": 1.5, "purchase": 3.0})
    return t.events.groupBy("user_id").agg(r6(F.sum(worth)).alias("worth"), F.count_if(worth.isNull()).alias("unknown_count"))


_ANGLE = "atan2(l_extendedprice / 500 - 125.42, 198.27 - l_quantity * 5) * 180 / pi() * 0.75"


@query(
    "b9_spray_direction",
    f"""select l_returnflag, direction, count(*) row_count, round(avg(angle), 6) + 0.0 mean_angle from (
          select l_returnflag, angle, case when l_returnflag = 'N' then null when abs(angle) <= 15 then 'center'
            when (l_returnflag = 'R' and angle < -15) or (l_returnflag = 'A' and angle > 15) then 'pull' else 'opposite' end direction
          from (select l_returnflag, {_ANGLE} angle from lineitem)) group by 1, 2""",
)
def _(t: Tables):
    x, y = F.col("l_extendedprice") / 500, F.col("l_quantity") * 5
    side = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_returnflag") == "A", "L")
    rows = t.lineitem.select("l_returnflag", fn.spray_angle(x, y).alias("angle"), fn.batted_direction(x, y, side).alias("direction"))
    return rows.groupBy("l_returnflag", "direction").agg(F.count("*").alias("row_count"), r6(F.avg("angle")).alias("mean_angle"))


@query(
    "b10_location_direction",
    """select direction, count(*) row_count from (select case when loc not between 1 and 9 or side not in ('L', 'R') then null
         when loc in (1, 2, 8) then 'center' when (side = 'R' and loc in (5, 6, 7)) or (side = 'L' and loc in (3, 4, 9)) then 'pull'
         else 'opposite' end direction from (select l_quantity::bigint % 11 loc, case l_returnflag when 'A' then 'L' else l_returnflag end side
         from lineitem)) group by 1""",
)
def _(t: Tables):
    side = F.when(F.col("l_returnflag") == "A", "L").otherwise(F.col("l_returnflag"))
    direction = fn.location_direction(big("l_quantity") % 11, side)
    return t.lineitem.groupBy(direction.alias("direction")).agg(F.count("*").alias("row_count"))


@query(
    "b11_notation_outs",
    """select l_linenumber::bigint l_linenumber, count(*) row_count, count(outs) legal_count, sum(outs)::bigint total_outs from (
         select l_linenumber, case when l_linenumber % 4 <= 2 then l_quantity::bigint * 3 + l_linenumber % 4 end outs from lineitem)
       group by 1""",
)
def _(t: Tables):
    text = F.concat_ws(".", big("l_quantity").cast("string"), (F.col("l_linenumber") % 4).cast("string"))
    outs = t.lineitem.withColumn("outs", fn.innings_to_outs(text))
    return outs.groupBy(big("l_linenumber").alias("l_linenumber")).agg(
        F.count("*").alias("row_count"), F.count("outs").alias("legal_count"), F.sum("outs").alias("total_outs")
    )


@query(
    "b12_bands",
    """select c_mktsegment, case when c_acctbal < 0 then 'overdrawn' when c_acctbal < 1000 then 'low' when c_acctbal < 5000 then 'mid'
         else 'high' end band, count(*) row_count from customer group by 1, 2""",
)
def _(t: Tables):
    band = fn.bands(F.col("c_acctbal"), [0, 1000, 5000], ["overdrawn", "low", "mid", "high"])
    return t.customer.groupBy("c_mktsegment", band.alias("band")).agg(F.count("*").alias("row_count"))


@query(
    "b13_any_out_of_range",
    """select l_returnflag, count(*) row_count, sum(case when l_quantity > 49 or l_discount > 0.09 or l_tax > 0.07 then 1 else 0 end)::bigint
         flagged_count, sum((l_quantity > 49)::int + (l_discount > 0.09)::int + (l_tax > 0.07)::int)::bigint flag_total from lineitem group by 1""",
)
def _(t: Tables):
    tests = [F.col("l_quantity") > 49, F.col("l_discount") > 0.09, F.col("l_tax") > 0.07]
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("row_count"),
        F.count_if(fn.any_of(tests)).alias("flagged_count"),
        F.sum(sum((c.cast("bigint") for c in tests[1:]), tests[0].cast("bigint"))).alias("flag_total"),
    )


@query(
    "b14_payload_repeats",
    """select n repeat_count, count(*) payload_count from (select count(*) n from lineitem
         group by l_orderkey, l_linenumber, l_returnflag, l_linestatus) group by 1""",
)
def _(t: Tables):
    identity = fn.payload_hash("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    repeats = t.lineitem.groupBy(identity.alias("payload")).agg(F.count("*").alias("repeat_count"))
    return repeats.groupBy("repeat_count").agg(F.count("*").alias("payload_count"))


@query(
    "b15_exact_age",
    """select c_custkey, case when c_custkey % 7 = 0 then null when m = 2 and d > 28 or m in (4, 6, 9, 11) and d > 30 then null
         else round(datediff('day', make_date(y, m, case when m = 2 and d > 28 then 28 when m in (4, 6, 9, 11) and d > 30 then 30 else d end),
           date '2002-01-01') / 365.2425, 6) end age_years,
         case when c_custkey % 7 = 0 then 'partial_birth_date' when m = 2 and d > 28 or m in (4, 6, 9, 11) and d > 30 then 'invalid_birth_date'
           else 'exact_birth_date' end status
       from (select c_custkey, (1950 + c_custkey % 40)::int y, (1 + c_custkey % 12)::int m, (1 + c_custkey % 31)::int d,
         from customer)""",
)
def _(t: Tables):
    key = F.col("c_custkey")
    year, month = 1950 + key % 40, 1 + key % 12
    day = F.when(key % 7 != 0, 1 + key % 31)
    age, status = fn.exact_age(year, month, day, F.lit("2002-01-01").cast("date"))
    return t.customer.select("c_custkey", r6(age).alias("age_years"), status.alias("status"))


@query(
    "b16_bit_code",
    """select (l_returnflag = 'R')::bigint + 2 * (l_linestatus = 'O')::bigint + 4 * (l_discount > 0.05)::bigint code, count(*) row_count
       from lineitem group by 1""",
)
def _(t: Tables):
    code = fn.bit_code(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") > 0.05)
    return t.lineitem.groupBy(code.alias("code")).agg(F.count("*").alias("row_count"))


@query(
    "b17_link_scalars",
    """select user_id, round(ln(p / (1 - p)), 6) + 0.0 purchase_logit, round(1 / (1 + exp(-(n - b) / 10.0)), 6) + 0.0 balance,
         round(case when n > 0 and b > 0 then 2.0 * n * b / (n + b) else 0 end, 6) + 0.0 exposure from (
         select *, least(1 - 1e-12, greatest(1e-12, n / c)) p from (
           select user_id, count(*)::double c, sum((event_type = 'purchase')::int)::double n, sum((event_type = 'view')::int)::double b
           from events group by 1))""",
)
def _(t: Tables):
    kind = F.col("event_type")
    users = t.events.groupBy("user_id").agg(
        F.count("*").alias("c"), F.count_if(kind == "purchase").alias("n"), F.count_if(kind == "view").alias("b")
    )
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    return users.select(
        "user_id",
        r6(fn.logit(n / F.col("c"))).alias("purchase_logit"),
        r6(fn.logistic((n - b) / 10.0)).alias("balance"),
        r6(fn.harmonic(n, b)).alias("exposure"),
    )


@query(
    "b18_environment_labels",
    """select r_name level_group, n_name environment, count(*) customer_count from customer join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey group by 1, 2""",
)
def _(t: Tables):
    levels = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    labelled = t.customer.join(levels, F.col("c_nationkey") == F.col("n_nationkey"))
    return labelled.groupBy(F.col("r_name").alias("level_group"), F.col("n_name").alias("environment")).agg(
        F.count("*").alias("customer_count")
    )


@query(
    "b19_source_projection",
    """select event_id, user_id, ts::date as event_date, (props->>'$.k')::bigint k, case when event_type in ('view', 'click') then 'browse'
         when event_type in ('purchase', 'signup') then 'convert' else 'other' end family from events where value >= 100""",
)
def _(t: Tables):
    kind = F.col("event_type")
    family = fn.first_case([(kind.isin("view", "click"), "browse"), (kind.isin("purchase", "signup"), "convert")], "other")
    return t.events.where("value >= 100").select(
        "event_id",
        "user_id",
        F.to_date("ts").alias("event_date"),
        fn.whole_number(F.get_json_object("props", "$.k")).alias("k"),
        family.alias("family"),
    )


@query(
    "b20_event_semantics",
    """select semantics_version, is_conversion, count(*) event_count from events join (values ('view', false), ('click', false),
         ('signup', true), ('purchase', true), ('error', false)) s(event_type, is_conversion) using (event_type), (select 'v1' semantics_version)
       group by 1, 2""",
)
def _(t: Tables):
    semantics = t.spark.createDataFrame(
        [("v1", "view", False), ("v1", "click", False), ("v1", "signup", True), ("v1", "purchase", True), ("v1", "error", False)],
        "semantics_version string, event_type string, is_conversion boolean",
    )
    joined = t.events.join(F.broadcast(semantics), "event_type")
    return joined.groupBy("semantics_version", "is_conversion").agg(F.count("*").alias("event_count"))


# --- joins -------------------------------------------------------------------------------------


def _moved(key: str) -> Column:
    """A seeded defect: every tenth key is turned into one that the other table does not have; no row is left out."""
    return F.when(F.col(key) % 10 == 0, -F.col(key)).otherwise(F.col(key))


def _moved_sql(key: str) -> str:
    return f"case when {key} % 10 = 0 then -{key} else {key} end"


@query(
    "c1_inner_join",
    """select o_orderpriority, count(*) line_count, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 revenue
       from lineitem join orders on l_orderkey = o_orderkey group by 1""",
)
def _(t: Tables):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("o_orderpriority").agg(
        F.count("*").alias("line_count"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query(
    "c2_left_lookup_zero_fill",
    f"""select c_custkey, count(o_orderkey) order_count, round(coalesce(sum(o_totalprice), 0), 2) + 0.0 spend from customer
       left join (select *, {_moved_sql("o_custkey")} k from orders) on c_custkey = k group by 1""",
)
def _(t: Tables):
    orders = t.orders.groupBy(_moved("o_custkey").alias("c_custkey"))
    counts = orders.agg(F.count("*").alias("order_count"), r6(F.sum("o_totalprice"), 2).alias("spend"))
    return lookup.with_counts(t.customer.select("c_custkey"), counts, ["c_custkey"])


@query(
    "c3_full_reconciliation",
    f"""select coalesce(l_orderkey, k) order_key, l_orderkey is not null in_lines, k is not null in_header,
         coalesce(lines, 0) lines_units, coalesce(header, 0) header_units, coalesce(lines, 0) - coalesce(header, 0) units_difference
       from (select l_orderkey, sum(l_quantity)::bigint lines from lineitem group by 1) full join
         (select {_moved_sql("o_orderkey")} k, floor(o_totalprice / 3000)::bigint header from orders) on l_orderkey = k""",
)
def _(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("order_key")).agg(big(F.sum("l_quantity")).alias("units"))
    header = t.orders.select(_moved("o_orderkey").alias("order_key"), F.floor(F.col("o_totalprice") / 3000).alias("units"))
    return lookup.reconcile(lines, header, ["order_key"], ["units"], ("lines", "header"))


@query(
    "c4_orphans",
    """select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
)
def _(t: Tables):
    return lookup.orphans(t.orders, t.lineitem, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_custkey")


@query(
    "c5_semi_conflict_rows",
    """select l_returnflag, l_linestatus, count(*) row_count from lineitem where (l_orderkey, l_linenumber) in (
         select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having min(l_returnflag) <> max(l_returnflag))
       group by 1, 2""",
)
def _(t: Tables):
    key = ["l_orderkey", "l_linenumber"]
    conflicting = t.lineitem.groupBy(*key).agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b")).where("a <> b")
    rows = t.lineitem.join(conflicting, key, "left_semi")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("row_count"))


@query(
    "c6_declared_totals_kept",
    f"""select o_orderkey, o_totalprice declared, round(coalesce(sum(l_extendedprice), 0), 2) + 0.0 matched, count(k) line_count
       from (select *, {_moved_sql("l_orderkey")} k from lineitem) right join orders on k = o_orderkey group by 1, 2""",
)
def _(t: Tables):
    sums = t.lineitem.groupBy(_moved("l_orderkey").alias("o_orderkey"))
    sums = sums.agg(r6(F.sum("l_extendedprice"), 2).alias("matched"), F.count("*").alias("line_count"))
    declared = t.orders.select("o_orderkey", F.col("o_totalprice").alias("declared"))
    return sums.join(declared, "o_orderkey", "right").fillna(0, subset=["matched", "line_count"])


@query(
    "c7_null_safe_overlap",
    f"""select place, count(*) key_count, sum(case when k is null then 1 else 0 end)::bigint null_key_count from (
         select coalesce(a.k, b.k) k, case when a.s is null then 'right_only' when b.s is null then 'left_only' else 'both' end place
         from (select distinct case when event_type = 'error' then null else {_moved_sql("user_id")} end k, 1 s from events where ts < timestamp '2024-01-16') a
         full join (select distinct case when event_type = 'view' then null else user_id end k, 1 s from events where ts >= timestamp '2024-01-16') b
         on a.k is not distinct from b.k) group by 1""",
)
def _(t: Tables):
    at, middle = F.col("ts"), F.lit("2024-01-16").cast("timestamp_ntz")
    early = t.events.where(at < middle).select(F.when(F.col("event_type") != "error", _moved("user_id")).alias("k"))
    late = t.events.where(at >= middle).select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("k"))
    places = lookup.key_overlap(early, late, ["k"])
    return places.groupBy("place").agg(F.count("*").alias("key_count"), F.count_if(F.col("k").isNull()).alias("null_key_count"))


@query(
    "c8_checked_lookup",
    """with p as (select * from part union all select * from part where p_partkey % 50 = 0)
       select p_brand, count(*) line_count, round(sum(l_quantity * p_retailprice), 2) + 0.0 list_value,
         (select count(*) from (select 1 from p group by p_partkey having count(*) > 1)) duplicated_part_keys
       from lineitem join p on l_partkey = p_partkey group by 1""",
)
def _(t: Tables):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    part = part.unionByName(part.where("l_partkey % 50 = 0"))  # seeded: some keys twice
    lines, duplicated = lookup.attach_one(t.lineitem.select("l_partkey", "l_quantity"), part, ["l_partkey"])
    grouped = lines.where("p_brand is not null").groupBy("p_brand").agg(
        F.count("*").alias("line_count"), r6(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("list_value")
    )
    return lookup.attach_total(grouped, duplicated.agg(F.count("*").alias("duplicated_part_keys")))


@query(
    "c9_star_assembly",
    """select c_custkey, n_name, r_name, coalesce(n, 0) order_count, round(coalesce(spend, 0), 2) + 0.0 spend, coalesce(u, 0) urgent_count
       from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join (
         select o_custkey, count(*) n, sum(o_totalprice) spend, sum((o_orderpriority = '1-URGENT')::int)::bigint u from orders group by 1)
       on o_custkey = c_custkey""",
)
def _(t: Tables):
    facts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("order_count"),
        r6(F.sum("o_totalprice"), 2).alias("spend"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent_count"),
    )
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    star = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    return lookup.with_counts(star, facts, ["c_custkey"])


_YEARLY = "select o_custkey, year(o_orderdate) y, sum(o_totalprice) spend from orders group by 1, 2"


@query(
    "c10_prior_year",
    f"""with s as ({_YEARLY}) select a.o_custkey, a.y order_year, round(a.spend, 2) + 0.0 spend, round(b.spend, 2) + 0.0 prior_spend
        from s a left join s b on a.o_custkey = b.o_custkey and b.y = a.y - 1""",
)
def _(t: Tables):
    yearly = t.orders.groupBy("o_custkey", big(F.year("o_orderdate")).alias("order_year")).agg(r6(F.sum("o_totalprice"), 2).alias("spend"))
    return lookup.with_prior(yearly, ["o_custkey"], "order_year", ["spend"])


@query(
    "c11_weight_dimension",
    """select event_type, round(sum(value * w), 4) + 0.0 weighted_value from events join (values ('view', 0.5::double), ('click', 1.0::double),
         ('signup', 2.0::double), ('purchase', 4.0::double)) d(event_type, w) using (event_type) group by 1""",
)
def _(t: Tables):
    weights = t.spark.createDataFrame([("view", 0.5), ("click", 1.0), ("signup", 2.0), ("purchase", 4.0)], "event_type string, w double")
    joined = t.events.join(F.broadcast(weights), "event_type")
    return joined.groupBy("event_type").agg(r6(F.sum(F.col("value") * F.col("w")), 4).alias("weighted_value"))


# --- aggregates --------------------------------------------------------------------------------


@query(
    "d1_grouped_rollup",
    """select l_returnflag, l_linestatus, count(*) line_count, sum(l_quantity)::bigint total_quantity, round(sum(l_extendedprice), 2) + 0.0 total_price,
         round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 discounted, min(l_extendedprice) min_price, max(l_extendedprice) max_price,
         round(avg(l_discount), 6) + 0.0 avg_discount from lineitem group by 1, 2""",
)
def _(t: Tables):
    price = F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("line_count"),
        big(F.sum("l_quantity")).alias("total_quantity"),
        r6(F.sum(price), 2).alias("total_price"),
        r6(F.sum(price * (1 - F.col("l_discount"))), 2).alias("discounted"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        r6(F.avg("l_discount")).alias("avg_discount"),
    )


@query(
    "d2_conditional_counts",
    """select user_id, count(*) events, count(*) filter (event_type = 'view') views, count(*) filter (event_type = 'click') clicks,
         count(*) filter (event_type = 'purchase') purchases, count(*) filter (event_type = 'purchase' and value >= 50) large_purchases,
         count(*) filter (event_type = 'error' or value < 1) weak from events group by 1""",
)
def _(t: Tables):
    kind, value = F.col("event_type"), F.col("value")
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("events"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if((kind == "purchase") & (value >= 50)).alias("large_purchases"),
        F.count_if((kind == "error") | (value < 1)).alias("weak"),
    )


@query(
    "d3_distinct_users",
    "select event_type, count(distinct user_id) user_count from events group by 1",
)
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("user_count"))


@query(
    "d4_distinct_pairs",
    "select user_id, count(distinct (event_type, ts::date)) environment_count from events group by 1",
)
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.count_distinct(F.struct("event_type", F.to_date("ts"))).alias("environment_count"))


@query(
    "d5_sorted_sets",
    "select user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') event_types from events group by 1",
)
def _(t: Tables):
    # Duplicates are removed before collecting, so a set holds at most one element per type.
    pairs = t.events.select("user_id", "event_type").distinct()
    return pairs.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), "|").alias("event_types"))


@query(
    "d6_weighted_mean",
    """select l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) + 0.0 weighted_discount,
         round(sum(l_extendedprice), 2) + 0.0 total_weight from lineitem group by 1""",
)
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(
        r6(profile.weighted_mean(F.col("l_discount"), F.col("l_extendedprice"))).alias("weighted_discount"),
        r6(F.sum("l_extendedprice"), 2).alias("total_weight"),
    )


@query(
    "d7_cell_stats",
    """select l_returnflag, l_linestatus, count(*) occurrence_count, round(avg(l_quantity), 6) + 0.0 mean_value,
         round(stddev_samp(l_quantity), 6) + 0.0 sd_value, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) + 0.0 se_value
       from lineitem group by 1, 2""",
)
def _(t: Tables):
    cells = profile.cell_stats(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return cells.select(
        "l_returnflag", "l_linestatus", "occurrence_count", *[r6(c).alias(c) for c in ("mean_value", "sd_value", "se_value")]
    )


@query(
    "d8_coverage",
    """select event_type, count(*) row_count, count(k) present_count, count(*) - count(k) missing_count, round(count(k) / count(*), 6) + 0.0
         coverage_rate from (select event_type, case when (props->>'$.k')::bigint >= 20 then 1 end k from events) group by 1""",
)
def _(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    report = profile.coverage(t.events, ["event_type"], F.when(k >= 20, k))
    return report.withColumn("coverage_rate", r6("coverage_rate"))


@query(
    "d9_shares",
    """select user_id, event_type, count(*) amount, round(count(*) / sum(count(*)) over (partition by user_id), 6) + 0.0 share
       from events group by 1, 2""",
)
def _(t: Tables):
    cells = profile.shares(t.events, ["user_id"], "event_type", F.lit(1).cast("bigint"))
    return cells.withColumn("share", r6("share"))


@query(
    "d10_leave_one_out_rate",
    """with u as (select user_id, ts::date < date '2024-01-16' early, count(*) n, sum((event_type = 'purchase')::int)::bigint p
         from events group by 1, 2), e as (select early, sum(n) n, sum(p) p from u group by 1), a as (select sum(n) n, sum(p) p from u),
       x as (select user_id, sum(n) n, sum(p) p from u group by 1)
       select u.user_id, u.early, u.n events, u.p purchases, round(case when e.n - u.n >= 4900 then (e.p - u.p) / (e.n - u.n)
         else (a.p - x.p) / (a.n - x.n) end, 6) + 0.0 baseline_rate, case when e.n - u.n >= 4900 then 'environment' else 'level' end baseline_source
       from u join e using (early) join x using (user_id), a""",
)
def _(t: Tables):
    early = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    measures = {"events": F.lit(1).cast("bigint"), "purchases": (F.col("event_type") == "purchase").cast("bigint")}
    rows = t.events.withColumn("early", early)
    environment = profile.leave_one_out(rows, ["user_id"], ["early"], measures)
    user = rows.groupBy("user_id").agg(*[F.sum(e).alias(f"user_{m}") for m, e in measures.items()])
    whole = lookup.attach_total(user, user.agg(*[F.sum(f"user_{m}").alias(f"all_{m}") for m in measures]))
    enough = F.col("others_events") >= 4900
    wide = (F.col("all_purchases") - F.col("user_purchases")) / (F.col("all_events") - F.col("user_events"))
    rate = F.when(enough, F.col("others_purchases") / F.col("others_events")).otherwise(wide)
    return environment.join(whole, "user_id").select(
        "user_id",
        "early",
        "events",
        "purchases",
        r6(rate).alias("baseline_rate"),
        F.when(enough, "environment").otherwise("level").alias("baseline_source"),
    )


@query(
    "d11_leave_one_group_out_prior",
    """with n as (select n_nationkey::bigint nation_key, n_regionkey::bigint region_key, count(*) n, sum(c_acctbal) s from customer
         join nation on c_nationkey = n_nationkey group by 1, 2), r as (select region_key, sum(n) n, sum(s) s, count(*) k from n group by 1)
       select nation_key, region_key, n.n customers, round(n.s / n.n, 6) + 0.0 direct_mean, round((r.s - n.s) / (r.n - n.n), 6) + 0.0 prior_mean,
         k - 1 peer_count from n join r using (region_key)""",
)
def _(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(big("n_nationkey").alias("nation_key"), big("n_regionkey").alias("region_key"), "c_acctbal")
    cells = rows.groupBy("nation_key", "region_key").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("total"))
    others = profile.leave_one_out(
        cells, ["nation_key"], ["region_key"], {"n": F.col("customers"), "s": F.col("total"), "cell": F.lit(1).cast("bigint")}
    )
    return others.select(
        "nation_key",
        "region_key",
        F.col("n").alias("customers"),
        r6(F.col("s") / F.col("n")).alias("direct_mean"),
        r6(fn.ratio(F.col("others_s"), F.col("others_n"))).alias("prior_mean"),
        F.col("others_cell").alias("peer_count"),
    )


@query(
    "d12_sufficient_statistics",
    """select l_returnflag, l_linestatus, count(*) cell_count, round(sum(l_extendedprice), 2) + 0.0 value_sum from lineitem
       where l_shipdate < timestamp '1999-07-01' group by 1, 2""",
)
def _(t: Tables):
    before = t.lineitem.where(F.col("l_shipdate") < F.lit("1999-07-01").cast("timestamp_ntz"))
    return before.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("cell_count"), r6(F.sum("l_extendedprice"), 2).alias("value_sum")
    )


@query(
    "d13_exact_quantiles",
    """select l_returnflag, point, round(quantile, 4) + 0.0 quantile from (select l_returnflag, unnest([0.05::double, 0.25, 0.5, 0.75, 0.95]) point,
         unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95])) quantile from lineitem group by 1)""",
)
def _(t: Tables):
    points = profile.exact_quantiles(
        t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95]
    )
    return points.withColumn("quantile", r6("quantile", 4))


@query(
    "d14_correlation_and_line",
    """select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) + 0.0 pearson, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) /
         (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 6) + 0.0 weighted_slope, round(sum(x * y) / sum(x * x), 6) + 0.0 origin_slope from (
         select l_returnflag, l_quantity, l_extendedprice, l_quantity x, l_extendedprice / 1000 y, 1 - l_discount w from lineitem) group by 1""",
)
def _(t: Tables):
    x, y, w = F.col("l_quantity"), F.col("l_extendedprice") / 1000, 1 - F.col("l_discount")
    lines = t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice", x.alias("x"), y.alias("y"), w.alias("w"))
    return profile.less_means(lines, ["x", "y"]).groupBy("l_returnflag").agg(
        r6(F.corr("l_quantity", "l_extendedprice")).alias("pearson"),
        r6(profile.weighted_line(F.col("x"), F.col("y"), F.col("w"))[0]).alias("weighted_slope"),
        r6(profile.origin_slope(x, y)).alias("origin_slope"),
    )


@query(
    "d15_rank_correlation",
    """with f as (select c_custkey, c_acctbal, n from customer join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey),
       r as (select rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2 a,
         rank() over (order by n) + (count(*) over (partition by n) - 1) / 2 b from f)
       select count(*) row_count, round(corr(a, b), 6) + 0.0 rank_correlation from r""",
)
def _(t: Tables):
    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("order_count"))
    facts = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_acctbal", "order_count")
    result = profile.rank_correlation(facts, "c_acctbal", "order_count")
    return result.select("row_count", r6("rank_correlation").alias("rank_correlation"))


@query(
    "d16_histogram",
    """select n variant_count, count(*) key_count from (select count(*) n from lineitem group by l_orderkey, l_linenumber) group by 1""",
)
def _(t: Tables):
    variants = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("variant_count"))
    return variants.groupBy("variant_count").agg(F.count("*").alias("key_count"))


@query(
    "d17_primary_type",
    """select user_id, event_type primary_type, n type_count from (select *, row_number() over (partition by user_id order by n desc, v desc, event_type)
         rn from (select user_id, event_type, count(*) n, round(sum(value), 4) v from events group by 1, 2)) where rn = 1""",
)
def _(t: Tables):
    cells = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    # The last tie goes to the smaller name; names are compared through their negated code points.
    small_first = F.transform(F.split("event_type", ""), lambda c: -F.ascii(c))
    best = profile.argmax(cells, ["user_id"], [F.col("n"), F.col("v"), small_first], ["event_type", "n"])
    return best.select("user_id", F.col("event_type").alias("primary_type"), F.col("n").alias("type_count"))


# --- windows -----------------------------------------------------------------------------------


@query(
    "e1_first_rows",
    """select user_id, event_id, row_index from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) row_index
         from events) where row_index <= 10""",
)
def _(t: Tables):
    rows = windows.first_rows(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 10)
    return rows.select("user_id", "event_id", big("row_index").alias("row_index"))


_CAPPED = """(select o_custkey, o_orderkey, floor(o_totalprice)::bigint amount, sum(floor(o_totalprice)::bigint) over (partition by o_custkey
  order by o_orderdate, o_orderkey rows unbounded preceding)::bigint running_amount from orders)"""


@query(
    "e2_whole_row_cap",
    f"select o_custkey, o_orderkey, amount, running_amount from {_CAPPED} where running_amount <= 1000000",
)
def _(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("amount"))
    sliced = scan.balanced_slices(rows, "o_orderdate", "o_orderkey")
    kept = windows.whole_rows_within(sliced, ["o_custkey"], ["o_orderdate", "o_orderkey"], scan.SLICE, "amount", 1000000)
    return kept.select("o_custkey", "o_orderkey", "amount", "running_amount")


@query(
    "e2_cap_shortfall",
    f"""select count(*) window_count, sum((total > 1000000)::int)::bigint over_cap_count, sum(least(total, 1000000) - kept)::bigint shortfall from (
          select o_custkey, sum(amount)::bigint total, coalesce(sum(amount) filter (running_amount <= 1000000), 0)::bigint kept from {_CAPPED} group by 1)""",
)
def _(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("amount"))
    sliced = scan.balanced_slices(rows, "o_orderdate", "o_orderkey")
    upto = scan.running(sliced, ["o_custkey"], ["o_orderdate", "o_orderkey"], scan.SLICE, {"running_amount": ("sum", F.col("amount"))})
    per = upto.groupBy("o_custkey").agg(
        F.sum("amount").alias("total"),
        F.coalesce(F.sum(F.when(F.col("running_amount") <= 1000000, F.col("amount"))), F.lit(0)).alias("kept"),
    )
    return per.agg(
        F.count("*").alias("window_count"),
        F.count_if(F.col("total") > 1000000).alias("over_cap_count"),
        F.sum(F.least("total", F.lit(1000000)) - F.col("kept")).alias("shortfall"),
    )


@query(
    "e3_last_event_of_day",
    """select user_id, event_date, event_id, event_type from (select user_id, ts::date event_date, event_id, event_type, row_number() over (
         partition by user_id, ts::date order by ts desc, event_id desc) rn from events) where rn = 1""",
)
def _(t: Tables):
    rows = t.events.select("user_id", F.to_date("ts").alias("event_date"), "event_id", "event_type", "ts")
    marked = windows.last_flag(rows, ["user_id", "event_date"], ["ts", "event_id"], scan.time_slice("ts"))
    return marked.where("is_last").select("user_id", "event_date", "event_id", "event_type")


@query(
    "e4_key_totals",
    """select l_orderkey, l_linenumber::bigint l_linenumber, l_quantity::bigint quantity, (sum(l_quantity) over (partition by l_orderkey))::bigint
         order_quantity, (max(l_linenumber) over (partition by l_orderkey))::bigint last_line from lineitem""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", big("l_quantity").alias("quantity"))
    totals = scan.group_totals(rows, ["l_orderkey"], order_quantity=F.sum("quantity"), last_line=F.max(big("l_linenumber")))
    return totals.withColumn("l_linenumber", big("l_linenumber"))


_STINT_SQL = """with e as (select user_id, ts::date d, case when hour(ts) < 8 then 'night' when hour(ts) < 16 then 'day' else 'evening' end env
    from events), q as (select user_id, d, min(env) lo, max(env) hi, count(*) n from e group by 1, 2),
  f as (select *, lo <> hi broken, lag(case when lo = hi then lo end) over (partition by user_id order by d) before from q),
  s as (select *, (sum(broken::int) over w)::bigint seg, (sum((not broken and (before is null or before <> lo))::int) over w)::bigint stint
    from f window w as (partition by user_id order by d rows unbounded preceding)),
  t as (select user_id, seg, stint, lo env, min(d) first_date, max(d) last_date, count(*) date_count, sum(n)::bigint events
    from s where not broken group by 1, 2, 3, 4)"""


def _daily(t: Tables):
    hour = F.hour("ts")
    band = F.when(hour < 8, "night").when(hour < 16, "day").otherwise("evening")
    rows = t.events.select("user_id", F.to_date("ts").alias("event_date"), band.alias("environment"))
    return windows.date_environments(rows, "user_id", "event_date", "environment", events=F.count("*"))


def _stints(t: Tables):
    indexed = windows.stint_index(_daily(t), "user_id", "event_date", "environment")
    return windows.stint_summary(indexed, "user_id", "event_date", "environment", "events")


@query(
    "e5_stints",
    f"""{_STINT_SQL} select user_id, seg continuity_segment, stint stint_index, env environment, first_date, last_date, date_count, events from t""",
)
def _(t: Tables):
    return _stints(t)


@query(
    "e6_stint_pairs",
    f"""{_STINT_SQL}, o as (select *, case env when 'night' then 1 when 'day' then 2 else 3 end k from t),
        p as (select *, lag(stint) over w fs, lag(env) over w fe, lag(last_date) over w fl, lag(events) over w fn, lag(k) over w fk
          from o window w as (partition by user_id, seg order by stint))
        select user_id, seg continuity_segment, fs from_stint_index, stint to_stint_index, fe from_environment, env to_environment, fn from_events,
          events to_events, (first_date - fl)::bigint gap_days, case when k > fk then 'PROMOTION' when k < fk then 'DEMOTION' else 'SAME_LEVEL' end
          transition, round(fn * events / (fn + events), 6) + 0.0 pair_weight, fn >= 2 and events >= 2 and first_date - fl <= 3 eligible,
          concat_ws(';', case when fn < 2 then 'LOW_FROM_EVENTS' end, case when events < 2 then 'LOW_TO_EVENTS' end,
            case when first_date - fl > 3 then 'GAP_EXCEEDS_MAX' end) exclusion_reason from p where fs is not null""",
)
def _(t: Tables):
    ordinal = fn.map_value(F.col("environment"), {"night": 1, "day": 2, "evening": 3})
    pairs = windows.stint_pairs(_stints(t), "user_id", "environment", "events", ordinal, minimum=2, max_gap=3)
    return pairs.withColumn("pair_weight", r6("pair_weight"))


@query(
    "e7_ranks",
    """select s_nationkey::bigint nation_key, s_suppkey, rank() over (partition by s_nationkey order by floor(s_acctbal / 1000)) min_rank,
         row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) ordinal_rank from supplier""",
)
def _(t: Tables):
    rows = t.supplier.select(big("s_nationkey").alias("nation_key"), "s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / 1000).alias("level"))
    placed = scan.range_slices(rows, ["nation_key", F.desc("s_acctbal"), "s_suppkey"])
    ordinal = scan.row_index(placed, ["nation_key"], [F.desc("s_acctbal"), "s_suppkey"], scan.SLICE, "ordinal_rank")
    # The min-rank of a tied value is one more than the number of rows below it.
    per_level = rows.groupBy("nation_key", "level").agg(F.count("*").alias("n"))
    below = scan.range_slices(per_level, ["nation_key", "level"])
    ranks = scan.running(below, ["nation_key"], ["level"], scan.SLICE, {"below": ("sum", F.col("n"))}, include_current=False)
    joined = ordinal.join(ranks.select("nation_key", "level", (F.col("below") + 1).alias("min_rank")), ["nation_key", "level"])
    return joined.select("nation_key", "s_suppkey", "min_rank", "ordinal_rank")


@query(
    "e8_grouped_z_score",
    """select p_partkey, p_brand, round(case when count(*) over w >= 5 and stddev_pop(p_retailprice) over w > 1e-12 then
         (p_retailprice - avg(p_retailprice) over w) / stddev_pop(p_retailprice) over w end, 6) + 0.0 z from part window w as (partition by p_brand)""",
)
def _(t: Tables):
    scored = profile.z_scores(t.part.select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 5)
    return scored.select("p_partkey", "p_brand", r6("z").alias("z"))


@query(
    "e9_latest_context",
    """select user_id, d last_date, count(distinct event_type) > 1 environment_ambiguous, case when count(distinct event_type) = 1 then
         min(event_type) end environment from (select user_id, ts::date d, event_type, max(ts::date) over (partition by user_id) last
         from events where ts < timestamp '2024-01-20') where d = last group by 1, 2""",
)
def _(t: Tables):
    rows = t.events.select("user_id", F.to_date("ts").alias("event_date"), "event_type")
    return windows.latest_context(rows, "user_id", "event_date", "event_type", F.lit("2024-01-20").cast("date"))


# --- ranking, samples, folds -------------------------------------------------------------------


@query(
    "f1_total_ranking",
    """select o_custkey, spend, row_number() over (order by spend desc, o_custkey) spend_rank from (
         select o_custkey, round(sum(o_totalprice), 2) spend from orders group by 1)""",
)
def _(t: Tables):
    spend = t.orders.groupBy("o_custkey").agg(r6(F.sum("o_totalprice"), 2).alias("spend"))
    return scan.ordered_rank(spend, [F.desc("spend"), F.asc("o_custkey")], "spend_rank").select("o_custkey", "spend", "spend_rank")


@query(
    "f2_top_per_group",
    """select c_nationkey::bigint nation_key, c_custkey, volume, row_index from (select *, row_number() over (partition by c_nationkey
         order by volume desc, c_custkey) row_index from (select c_nationkey, c_custkey, count(*) volume from customer join orders on o_custkey = c_custkey
         group by 1, 2 having count(distinct o_orderpriority) >= 3)) where row_index <= 3""",
)
def _(t: Tables):
    # One aggregate per customer; distinct priorities come from a bit per level instead of a distinct.
    level = F.expr("shiftleft(1, cast(substring(o_orderpriority, 1, 1) as int))")
    volume = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("volume"), F.bit_count(F.bit_or(level)).alias("levels")
    )
    eligible = t.customer.join(volume.where("levels >= 3"), "c_custkey").select(
        big("c_nationkey").alias("nation_key"), "c_custkey", "volume"
    )
    top = windows.first_rows(eligible, ["nation_key"], [F.desc("volume"), "c_custkey"], 3)
    return top.withColumn("row_index", big("row_index"))


_SPREAD = """select o_orderpriority, o_orderkey, rn row_index from (select o_orderpriority, o_orderkey, row_number() over w rn,
    count(*) over (partition by o_orderpriority) n from orders window w as (partition by o_orderpriority order by o_orderdate, o_orderkey))"""


@query(
    "f3_spread_sample",
    _SPREAD + " where n <= 5 or rn - 1 in (select round_even(i * (n - 1) / 4, 0)::bigint from range(5) r(i))",
)
def _(t: Tables):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_orderdate")
    sliced = scan.balanced_slices(rows, "o_orderdate", "o_orderkey")
    sample = windows.spread_sample(sliced, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], scan.SLICE, 5)
    return sample.select("o_orderpriority", "o_orderkey", "row_index")


@query("f3_middle_row", _SPREAD + " where n <= 1 or rn - 1 = n // 2")
def _(t: Tables):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_orderdate")
    sliced = scan.balanced_slices(rows, "o_orderdate", "o_orderkey")
    sample = windows.spread_sample(sliced, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], scan.SLICE, 1, "middle")
    return sample.select("o_orderpriority", "o_orderkey", "row_index")


@query(
    "f4_violation_examples",
    """select l_orderkey, l_linenumber::bigint l_linenumber, count(*) row_count from lineitem group by 1, 2 having count(*) > 1
       order by 1, 2 limit 10""",
)
def _(t: Tables):
    repeated = t.lineitem.groupBy("l_orderkey", big("l_linenumber").alias("l_linenumber")).agg(F.count("*").alias("row_count"))
    return repeated.where("row_count > 1").orderBy("l_orderkey", "l_linenumber").limit(10)


@query(
    "f5_round_robin_folds",
    """select o_orderkey, fold from (select o_orderkey, (row_number() over (order by o_orderdate, o_orderkey) - 1) % 5 fold from orders)""",
)
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    sliced = scan.balanced_slices(rows, "o_orderdate", "o_orderkey")
    folds = windows.round_robin_fold(sliced, ["o_orderdate", "o_orderkey"], scan.SLICE, 5)
    return folds.select("o_orderkey", "fold")


@query(
    "f6_hash_folds",
    """select user_id, ('0x' || substr(sha256(user_id::varchar), 1, 8))::bigint % 5 fold, count(*) event_count from events group by 1, 2""",
)
def _(t: Tables):
    return t.events.groupBy("user_id", fn.hash_fold(F.col("user_id")).alias("fold")).agg(F.count("*").alias("event_count"))


# --- set operations ----------------------------------------------------------------------------


@query(
    "g1_union_sources",
    """select source, entity, count(*) row_count, round(sum(amount), 2) + 0.0 amount from (
         select 'order' source, o_custkey entity, o_totalprice amount from orders union all
         select 'event', user_id, value from events) group by 1, 2""",
)
def _(t: Tables):
    schema = {"source": "string", "entity": "bigint", "amount": "double"}
    orders = t.orders.select(F.lit("order").alias("source"), F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("amount"))
    events = t.events.select(F.lit("event").alias("source"), F.col("user_id").alias("entity"), F.col("value").alias("amount"))
    both = lookup.union_sources([orders, events], schema)
    return both.groupBy("source", "entity").agg(F.count("*").alias("row_count"), r6(F.sum("amount"), 2).alias("amount"))


@query(
    "g2_dedup_counts",
    """select (select count(*) from lineitem) row_count, (select count(*) from (select distinct l_orderkey, l_linenumber, l_returnflag, l_linestatus
         from lineitem)) distinct_row_count, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) key_count""",
)
def _(t: Tables):
    # Two nested aggregates give all three counts from one scan.
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    keys = rows.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))
    return keys.agg(F.sum("n").alias("row_count"), F.sum("variants").alias("distinct_row_count"), F.count("*").alias("key_count"))


@query(
    "g3_key_sets",
    """select place, count(*) key_count from (select case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end place
         from (select distinct o_custkey k from orders where year(o_orderdate) = 1995) a full join
           (select distinct o_custkey k from orders where year(o_orderdate) = 1996) b on a.k = b.k) group by 1""",
)
def _(t: Tables):
    year = F.year("o_orderdate")
    places = lookup.key_overlap(t.orders.where(year == 1995), t.orders.where(year == 1996), ["o_custkey"])
    return places.groupBy("place").agg(F.count("*").alias("key_count"))


@query(
    "g4_unambiguous_rows",
    """select l_orderkey, l_linenumber::bigint l_linenumber, any_value(l_suppkey) l_suppkey, any_value(l_extendedprice) l_extendedprice
       from lineitem group by 1, 2 having count(*) = 1""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_suppkey", "l_extendedprice")
    return lookup.without_ambiguous(rows, ["l_orderkey", "l_linenumber"])


@query(
    "g5_overlapping_sources",
    """select user_id, ts::date as event_date from events where event_type = 'view' intersect
       select user_id, ts::date from events where event_type = 'purchase'""",
)
def _(t: Tables):
    rows = t.events.select("user_id", F.to_date("ts").alias("event_date"), "event_type")
    return lookup.overlapping_keys(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'"), ["user_id", "event_date"])
