"""Physical plans: filters and columns reach the scan, limits and shuffles are used early and once."""

import re

from compare import TESTDATA

import __spark_entry__ as entry

FOLDER = str(TESTDATA / "sf0.001")
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(entry.queries()["b1_filter_project"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_shipdate" in text and "EqualTo(l_returnflag,R)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_tax" not in read and "l_suppkey" not in read


def test_top_per_group_is_pruned_before_the_shuffle(spark):
    text = plan(entry.queries()["e1_first_rows"](spark, FOLDER))
    assert text.count("WindowGroupLimit") == 2


def test_ordered_scan_reuses_its_shuffle(spark):
    frame = entry.queries()["v3_ordered_transitions"](spark, FOLDER)
    frame.collect()
    assert "ReusedExchange" in plan(frame)


def test_date_cutoff_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(entry.queries()["t4_recency_snapshot"](spark, FOLDER))
    assert "LessThan(ts,2024-01-16T00:00)" in text and "props" not in text
