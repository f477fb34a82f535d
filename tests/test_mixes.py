"""Category vectors against the long operators and by hand."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyframe.operators import composition, lookup, mixes, shrinkage, statevalue

CATEGORIES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def counts(spark):
    draw = random.Random(4)
    rows = [(k, c, draw.choice([0, 1, 2, 7, 40])) for k in range(60) for c in CATEGORIES]
    return spark.createDataFrame(rows, "k int, c string, n bigint").cache()


def long_of(frame, name):
    return {(r["k"], r["c"]): r[name] for r in frame.collect()}


def test_vectors_and_back(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (1, "x", 9.0), (2, "x", 1.0), (None, "c", 4.0), (3, None, 1.0)], "k int, c string, n double")
    wide = mixes.vectors(df, ["k"], "c", CATEGORIES, n=F.col("n"), rows=F.lit(1))
    assert {r.k: (r.n, r.rows) for r in wide.collect()} == {1: ([5.0, 0.0, 0.0], [2, 0, 0]), 2: ([0.0] * 3, [0] * 3), None: ([0.0, 0.0, 4.0], [0, 0, 1]), 3: ([0.0] * 3, [0] * 3)}
    assert mixes.unfolded(wide.where("k = 1"), ["k"], "c", CATEGORIES, n="n").collect() == [(1, "a", 5.0), (1, "b", 0.0), (1, "c", 0.0)]
    assert mixes.summed(wide, [], 3, "n").first().n == [5.0, 0.0, 4.0]
    assert mixes.vectors(df.where("false"), ["k"], "c", CATEGORIES, n=F.col("n")).count() == 0


def test_shift_equals_the_long_form(spark, counts):
    effect = {"x": [0.3, -0.1, -0.2], "y": [0.0, 0.0, 0.0]}
    table = spark.createDataFrame([(e, c, v) for e, vs in effect.items() for c, v in zip(CATEGORIES, vs)], "environment string, c string, effect double")
    placed = counts.withColumn("environment", F.when(F.col("k") % 2 == 0, "x").otherwise("y"))
    clr = composition.centered_log_ratio(placed, ["k"], "n", 3)
    want = long_of(composition.shift_environment(clr, ["k"], "environment", "c", "clr", table, -1)[0], "shifted_probability")
    wide = mixes.vectors(placed, ["k", "environment"], "c", CATEGORIES, n=F.col("n"))
    share = mixes.shifted(F.col("n"), mixes.effect_of("environment", effect), 3, -1)
    assert long_of(mixes.unfolded(wide.withColumn("p", share), ["k"], "c", CATEGORIES, p="p"), "p") == pytest.approx(want, abs=1e-12)
    assert wide.where(mixes.effect_of("environment", {"x": [0, 0, 0]}).isNull()).count() == 30


def test_prior_and_posterior_equal_the_long_form(spark, counts):
    context = spark.createDataFrame([(k, f"n{k % 7}" if k != 3 else None, f"w{k // 59}") for k in range(60)], "k int, narrow string, wide string")
    long = shrinkage.peer_prior(counts, context, "k", "c", "n", "narrow", "wide", 3, minimum=8)
    wide = mixes.peer_prior(mixes.vectors(counts, ["k"], "c", CATEGORIES, n=F.col("n")).join(context, "k"), "n", "narrow", "wide", 3, minimum=8)
    keep = ["k", "prior_source", "prior_peer_count", "prior_peer_events"]
    got = {(r.k, r.c): tuple(r) for r in mixes.unfolded(wide, keep, "c", CATEGORIES, p="prior").select(*keep[:1], "c", *keep[1:], "p").collect()}
    rows = long.collect()
    assert len(rows) == len(got) == 59 * 3 and {r.prior_source for r in rows} == {"narrow", "wide", "all"}
    for r in rows:
        assert got[(r.k, r.c)][2:5] == (r.prior_source, r.prior_peer_count, r.prior_peer_events)
        assert got[(r.k, r.c)][5] == pytest.approx(r.prior_probability, abs=1e-12)
    want = long_of(shrinkage.empirical_bayes(counts, long, "k", "c", "n", 20.0), "posterior_probability")
    shrunk = wide.withColumn("p", mixes.posterior(F.col("n"), F.col("prior"), 20.0))
    assert long_of(mixes.unfolded(shrunk, ["k"], "c", CATEGORIES, p="p"), "p") == pytest.approx(want, abs=1e-12)


def test_strength_of_pooling_by_hand(spark):
    rows = [("e1", "P", "a", 10, 1.0, 2.0), ("e2", "P", "a", 30, 3.0, 2.0), ("e3", "P", "a", 5, 9.0, None), ("e4", "Q", "a", 5, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "e string, pool string, c string, occurrence_count bigint, mean_value double, reference_mean double")
    got = {(r.pool, r.prior_strength): r for r in statevalue.pooling_strengths(df, ["e"], ["pool"], "c", [0, 10], 0.2).collect()}
    assert got[("P", 0)].mae == 1.0 and got[("P", 0)].cell_count == 2
    assert got[("P", 10)].mae == pytest.approx((0.0 + 0.5) / 2) and got[("P", 10)].is_best and not got[("P", 0)].is_best
    assert got[("Q", 0)].is_best and got[("Q", 10)].mae == 1.0


def test_models_side_by_side(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], [0.25, 0.75]), (2, [1.0, 0.0], None), (3, None, [1.0, 0.0])], "k int, a array<double>, b array<double>")
    assert {r.k: (r.place, r.gap) for r in mixes.paired(df, "a", "b").collect()} == {1: ("paired", 0.5), 2: ("one_sided", None), 3: ("one_sided", None)}
    long = mixes.unfolded(df, ["k"], "c", ["x", "y"], a="a", b="b")
    both, gaps = shrinkage.paired_models(long.where("a is not null").select("k", "c", "a"), long.where("b is not null").select("k", "c", F.col("b").alias("a")), ["k", "c"], "a", ("one", "two"))
    assert both.count() == 2 and gaps.count() == 4


def test_rows_of_repeated_keys_go(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, None, 3), (2, None, 4), (3, None, 5), (None, "y", 6)], "k int, l string, v int")
    assert sorted(r.v for r in lookup.without_ambiguous(df, ["k", "l"]).collect()) == [5, 6]


# Scans and exchanges, broadcasts included, that a plan may have.
BUDGETS = {"k7_effect_removed": (4, 8), "k11_model_pairing": (4, 8), "k14_frozen_snapshot": (4, 8), "p4_component_scores": (4, 8), "v9_pooling_strengths": (4, 8)}


@pytest.mark.parametrize("name", list(BUDGETS))
def test_plans_read_and_shuffle_little(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = BUDGETS[name]
    assert plan.count("Scan parquet") <= scans and plan.count("Exchange") <= exchanges


@pytest.mark.parametrize("name", ["r1_field_consensus", "r2_snapshot_consensus", "r3_positive_consensus", "r4_vector_dominance", "r17_label_collapse", "g4_unambiguous_rows", "t11_complete_measures"])
def test_facts_are_combined_without_sorting(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
