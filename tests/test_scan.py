"""Two-level ordered scans against a plain Python loop, with one key holding a third of the rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profile, scan, windows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 25)
        data.append((key, rng.randrange(0, 400), i, rng.randrange(-5, 20), rng.choice(["a", "b", None])))
    return data


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, at bigint, id bigint, v bigint, s string").repartition(5)


def expected(rows):
    out, by_key = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    for items in by_key.values():
        total, low = 0, None
        for i, (k, at, ident, v, s) in enumerate(items):
            out[ident] = dict(
                before=total,
                upto=total + v,
                low=v if low is None else min(low, v),
                low_before=low,
                whole=sum(x[3] for x in items),
                prior=items[i - 1][4] if i else None,
                final=items[-1][4],
                last=i == len(items) - 1,
                index=i + 1,
            )
            total += v
            low = out[ident]["low"]
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_ordered_matches_a_loop(frame, rows, width):
    got = scan.ordered(
        frame,
        ["k"],
        ["at", "id"],
        F.floor(F.col("at") / width),
        upto={"upto": ("sum", F.col("v")), "low": ("min", F.col("v")), "index": ("sum", F.lit(1))},
        before={"before": ("sum", F.col("v")), "low_before": ("min", F.col("v"))},
        whole={"whole": ("sum", F.col("v"))},
        prior={"prior": F.col("s")},
        final={"final": F.col("s")},
        last="last",
    ).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        assert {n: r[n] for n in want[r["id"]]} == want[r["id"]]


def test_null_keys_form_a_group_and_null_order_comes_first(spark):
    df = spark.createDataFrame([(None, 5, 1), (None, None, 2), (0, 1, 4), (0, 9, 8), (None, 40, 16)], "k bigint, at bigint, v bigint")
    got = scan.ordered(df, ["k"], ["at"], F.floor(F.col("at") / 10), before={"b": ("sum", F.col("v"))}, prior={"p": F.col("v")}, last="end")
    rows = {r["v"]: (r["k"], r["b"], r["p"], r["end"]) for r in got.collect()}
    assert rows == {2: (None, 0, None, False), 1: (None, 2, 2, False), 16: (None, 3, 1, True), 4: (0, 0, None, False), 8: (0, 4, 4, True)}


def test_folds_alone_use_the_aggregate_summary(frame, rows):
    got = scan.running(frame, ["k"], ["at", "id"], F.floor(F.col("at") / 20), {"upto": ("sum", F.col("v"))})
    want = expected(rows)
    assert {r["id"]: r["upto"] for r in got.collect()} == {i: w["upto"] for i, w in want.items()}


def test_order_of_input_does_not_matter(frame):
    def run(df):
        return sorted(map(tuple, scan.row_index(df, ["k"], ["at", "id"], F.floor(F.col("at") / 9)).collect()), key=str)

    assert run(frame) == run(frame.orderBy(F.desc("id")).repartition(3))


def test_rank_splits_ties(spark):
    data = [(i, 0.0 if i % 3 else float(i)) for i in range(600)]
    df = spark.createDataFrame(data, "id bigint, value double")
    placed = scan.range_slices(df, [F.desc("value"), F.asc("id")], 6)
    sizes = [r["count"] for r in placed.groupBy(scan.SLICE).count().collect()]
    assert max(sizes) < 300  # two thirds of the rows tie, yet no slice holds them all
    ranked = scan.ordered_rank(df, [F.desc("value"), F.asc("id")])
    want = {row[0]: i + 1 for i, row in enumerate(sorted(data, key=lambda r: (-r[1], r[0])))}
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want


def test_exact_quantiles(spark):
    rng = random.Random(3)
    data = [("a", float(rng.randrange(5))) for _ in range(400)] + [("b", rng.gauss(0, 1)) for _ in range(77)] + [("c", 1.5)]
    df = spark.createDataFrame(data, "g string, v double")
    points = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r["g"], r["point"]): r["quantile"] for r in profile.exact_quantiles(df, ["g"], "v", points).collect()}
    for g in "abc":
        values = [v for k, v in data if k == g]
        for p in points:
            assert got[(g, p)] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_rank_correlation_with_ties(spark):
    data = [(1, 2.0, 1.0), (2, 2.0, 3.0), (3, 5.0, 2.0), (4, 9.0, 9.0)]
    df = spark.createDataFrame(data, "id int, x double, y double")
    # Ranks 1.5 1.5 3 4 against 1 3 2 4.
    assert profile.rank_correlation(df, "x", "y").first()["rank_correlation"] == pytest.approx(0.632455532, abs=1e-8)


def test_spread_sample_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(6)] + [(2, 0, 50), (2, 1, 51)], "g int, at bigint, id bigint")
    picked = windows.spread_sample(df, ["g"], ["at", "id"], F.col("at"), 3)
    ids = {(r["g"], r["id"]) for r in picked.collect()}
    # Positions 0, round(2.5) = 2 and 5; a small group is kept whole.
    assert ids == {(1, 0), (1, 2), (1, 5), (2, 50), (2, 51)}


def test_whole_rows_stop_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 60), (1, 3, 10), (2, 1, 100)], "k int, at bigint, amount bigint")
    kept = windows.whole_rows_within(df, ["k"], ["at"], F.col("at"), "amount", 100)
    assert sorted((r["k"], r["at"]) for r in kept.collect()) == [(1, 1), (2, 1)]


def test_ambiguous_date_breaks_the_stint_chain(spark):
    days = [("2024-01-01", "a", 3), ("2024-01-02", "a", 4), ("2024-01-03", "b", 1), ("2024-01-03", "a", 1), ("2024-01-05", "a", 5), ("2024-01-06", "b", 25)]
    df = spark.createDataFrame([(1, d, e, n) for d, e, n in days], "p int, d string, e string, n bigint").withColumn("d", F.to_date("d"))
    daily = windows.date_environments(df, "p", "d", "e", n=F.sum("n"))
    stints = windows.stint_summary(windows.stint_index(daily, "p", "d", "e"), "p", "d", "e", "n")
    found = sorted((r["continuity_segment"], r["stint_index"], r["e"], r["n"]) for r in stints.collect())
    assert found == [(0, 1, "a", 7), (1, 2, "a", 5), (1, 3, "b", 25)]
    pairs = windows.stint_pairs(stints, "p", "e", "n", F.when(F.col("e") == "a", 1).otherwise(2), minimum=20, max_gap=365).collect()
    assert len(pairs) == 1
    pair = pairs[0]
    assert (pair["transition"], pair["eligible"], pair["exclusion_reason"]) == ("PROMOTION", False, "LOW_FROM_EVENTS")
    assert pair["pair_weight"] == pytest.approx(5 * 25 / 30)


def test_rank_correlation_within_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", 3.0, 9.0), ("b", 1.0, 3.0), ("b", 2.0, 2.0), ("b", 3.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rank_correlation"] for r in profile.rank_correlation(df, "x", "y", ["g"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(-1.0)


def test_sample_of_one_takes_the_chosen_row(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 5), ("b", 4), ("c", 1)) for i in range(n)], "g string, i bigint")
    for single, wanted in (("first", {"a": 0, "b": 0, "c": 0}), ("middle", {"a": 2, "b": 2, "c": 0})):
        got = windows.spread_sample(df, ["g"], ["i"], F.col("i"), 1, single).collect()
        assert {r["g"]: r["i"] for r in got} == wanted and len(got) == 3


def test_quantiles_of_large_groups(spark):
    """Groups beyond the size that is its own bracket: continuous, with a value of a third of all rows, and constant."""
    rng = np.random.default_rng(5)
    groups = {"smooth": rng.normal(size=40_000), "hot": np.where(rng.random(30_000) < 0.33, 7.0, rng.normal(size=30_000) * 9), "same": np.full(20_000, 3.0), "few": rng.normal(size=7), None: rng.normal(size=12_000)}
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["g", "v"]), "g string, v double").unionByName(spark.createDataFrame([("few", None), ("none", None)], "g string, v double"))
    points = [0.0, 0.025, 0.3333, 0.5, 0.9, 1.0]
    frame = profile.exact_quantiles(df, ["g"], "v", points)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortAggregate" not in plan
    got = {(r["g"], r["point"]): r["quantile"] for r in frame.collect()}
    assert got == {(g, p): pytest.approx(np.quantile(values, p), abs=1e-12) for g, values in groups.items() for p in points}
    assert profile.exact_quantiles(df.where("g = 'smooth'"), [], "v", [0.5]).first()["quantile"] == pytest.approx(np.median(groups["smooth"]))


def test_a_hot_day_is_spread_over_the_tasks(spark):
    """With 90 % of the rows on one day and uneven ids, no task gets more than twice the rows of the median one."""
    rng = np.random.default_rng(9)
    days = np.where(rng.random(60_000) < 0.9, 5, rng.integers(0, 400, 60_000))
    ids = np.unique(np.concatenate([np.arange(30_000), rng.integers(10**6, 10**15, 40_000)]))
    ids = rng.permutation(ids)[:60_000]
    df = spark.createDataFrame(pd.DataFrame({"day": pd.to_datetime("2020-01-01") + pd.to_timedelta(days, "D"), "id": ids}))
    placed = scan.balanced_slices(df, "day", "id").cache()
    sizes = sorted(r["count"] for r in placed.repartition(8, scan.SLICE).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[3]
    folds = {r["id"]: r["fold"] for r in windows.round_robin_fold(placed, ["day", "id"], scan.SLICE, 5).collect()}
    want = sorted(zip(days.tolist(), ids.tolist(), strict=True))
    assert folds == {i: place % 5 for place, (_, i) in enumerate(want)}


def test_a_large_group_meets_its_bracket_in_parts(spark):
    """Rows of one large group come to many partitions of the join, not to one."""
    df = spark.range(60_000, numPartitions=4).select(F.lit("all").alias("g"), F.col("id").cast("double").alias("v"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = profile._with_brackets(df.withColumnRenamed("v", "_value"), ["g"], [0.5])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 30_000
        assert [r["quantile"] for r in profile.exact_quantiles(df, ["g"], "v", [0.5, 1.0]).orderBy("point").collect()] == [29_999.5, 59_999.0]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
