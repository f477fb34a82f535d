"""Compositions, priors, fits and rates against NumPy or hand calculations."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import composition, fits, profile, rates, season, shrinkage, statevalue

PARTS = ["a", "b", "c"]


def long(spark, table):
    rows = [(k, c, float(n)) for k, counts in table.items() for c, n in zip(PARTS, counts)]
    return spark.createDataFrame(rows, "k int, c string, n double")


def test_log_ratio_softmax_and_ilr_round_trip(spark):
    df = long(spark, {1: (3, 0, 5), 2: (1, 1, 1)})
    clr = composition.centered_log_ratio(df, ["k"], "n", 3)
    assert clr.groupBy("k").agg(F.abs(F.sum("clr")).alias("s")).where("s > 1e-12").count() == 0
    back = composition.softmax(clr, ["k"], "clr")
    want = {(1, c): (n + 0.5) / 9.5 for c, n in zip(PARTS, (3, 0, 5))} | {(2, c): 1 / 3 for c in PARTS}
    assert {(r["k"], r["c"]): pytest.approx(r["probability"]) for r in back.collect()} == want
    ilr = composition.isometric_log_ratio(back, ["k"], "c", "probability", PARTS)
    assert [ilr.where("k = 2").first()[f"ilr_{j}"] for j in (1, 2)] == pytest.approx([0, 0])
    again = composition.inverse_isometric(ilr, ["k"], PARTS)
    assert {(r["k"], r["category"]): pytest.approx(r["probability"]) for r in again.collect()} == want


def test_helmert_basis_is_orthonormal():
    names = [str(i) for i in range(12)]
    matrix = np.zeros((12, 11))
    for name, j, weight in composition.helmert_basis(names):
        matrix[int(name), j - 1] = weight
    assert np.allclose(matrix.T @ matrix, np.eye(11)) and np.allclose(matrix.sum(axis=0), 0)


def test_zero_effect_changes_nothing_and_unknown_environment_is_reported(spark):
    df = long(spark, {1: (3, 2, 5)}).withColumn("environment", F.lit("x"))
    clr = composition.centered_log_ratio(df, ["k"], "n", 3)
    zero = spark.createDataFrame([("x", c, 0.0) for c in PARTS], "environment string, c string, effect double")
    shifted, unknown = composition.shift_environment(clr, ["k"], "environment", "c", "clr", zero, -1)
    assert {r["c"]: pytest.approx(r["shifted_probability"]) for r in shifted.collect()} == {c: (n + 0.5) / 11.5 for c, n in zip(PARTS, (3, 2, 5))}
    assert unknown.count() == 0
    _shifted, unknown = composition.shift_environment(clr.withColumn("environment", F.lit("y")), ["k"], "environment", "c", "clr", zero, -1)
    assert unknown.first()["environment"] == "y"


def test_known_environment_effects_are_recovered(spark):
    truth = {"low": [0.3, -0.1, -0.2], "mid": [0.1, 0.0, -0.1], "top": [0.0, 0.0, 0.0]}
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        a, b = rng.sample(list(truth), 2)
        weight = rng.uniform(1, 9)
        rows += [(a, b, c, weight, truth[b][i] - truth[a][i]) for i, c in enumerate(PARTS)]
    deltas = spark.createDataFrame(rows, "from_environment string, to_environment string, c string, pair_weight double, clr_delta double")
    fitted = {(r["environment"], r["c"]): r for r in composition.environment_effects(deltas, "c", "top").collect()}
    for level, values in truth.items():
        for c, value in zip(PARTS, values):
            assert fitted[(level, c)]["effect"] == pytest.approx(value, abs=1e-9)
    assert fitted[("low", "a")]["residual_rmse"] == pytest.approx(0, abs=1e-6)
    alone = deltas.unionByName(spark.createDataFrame([("isle", "rock", c, 1.0, 0.0) for c in PARTS], deltas.schema))
    with pytest.raises(ValueError, match="isle"):
        composition.environment_effects(alone, "c", "top")


def test_subset_reweight_keeps_the_mass(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1.0), (1, "b", 0.3, -1.0), (1, "c", 0.2, None), (2, "a", 0.5, None), (2, "b", 0.3, None), (2, "c", 0.2, None)], "k int, c string, p double, s double")
    got = {(r["k"], r["c"]): r["adjusted_probability"] for r in composition.reweight_within(df, ["k"], F.col("c") != "c", "p", F.col("s")).collect()}
    assert got[(1, "c")] == 0.2 and got[(1, "a")] + got[(1, "b")] == pytest.approx(0.8)
    assert got[(1, "a")] / got[(1, "b")] == pytest.approx(0.5 / 0.3 * math.e**2)
    assert (got[(2, "a")], got[(2, "b")]) == (0.5, 0.3)


def test_peer_prior_ladder_leaves_the_entity_out(spark):
    counts = long(spark, {1: (9, 0, 0), 2: (1, 2, 3), 3: (0, 4, 0), 4: (5, 5, 5), 5: (1, 0, 0)})
    context = spark.createDataFrame([(1, "y", "L"), (2, "y", "L"), (3, "y", "L"), (4, "z", "L"), (5, "y", "M")], "k int, band string, level string")
    prior = shrinkage.peer_prior(counts, context, "k", "c", "n", "band", "level", 3, minimum=2)
    got = {(r["k"], r["c"]): r for r in prior.collect()}
    assert got[(1, "a")]["prior_source"] == "narrow" and got[(1, "a")]["prior_probability"] == pytest.approx((1 + 0.5) / (10 + 1.5))
    assert got[(4, "a")]["prior_source"] == "wide" and got[(4, "a")]["prior_peer_count"] == 3
    assert got[(5, "b")]["prior_source"] == "all" and got[(5, "b")]["prior_probability"] == pytest.approx((11 + 0.5) / (34 + 1.5))
    changed = counts.withColumn("n", F.when(F.col("k") == 1, F.col("n") + 50).otherwise(F.col("n")))
    again = shrinkage.peer_prior(changed, context, "k", "c", "n", "band", "level", 3, minimum=2).where("k = 1")
    for r in again.collect():
        assert r["prior_probability"] == got[(1, r["c"])]["prior_probability"]
    shrunk = shrinkage.empirical_bayes(counts, prior, "k", "c", "n", 20.0)
    assert shrunk.groupBy("k").agg(F.abs(F.sum("posterior_probability") - 1).alias("e")).where("e > 1e-12").count() == 0


def test_pooling_without_peers_stays_direct(spark):
    df = spark.createDataFrame([("x", "P", "c", 4, 1.0), ("y", "P", "c", 6, 2.0), ("z", "Q", "c", 5, 3.0)], "e string, pool string, cat string, occurrence_count bigint, mean_value double")
    got = {r["e"]: r for r in statevalue.pooled_values(df, ["e"], ["pool"], "cat", F.lit(10)).collect()}
    assert got["x"]["estimated_mean"] == pytest.approx((4 * 1.0 + 10 * 2.0) / 14)
    assert (got["z"]["estimated_mean"], got["z"]["estimator_method"], got["z"]["estimator_certified"]) == (3.0, "direct_missing_peers", False)


def test_additive_fit_equals_least_squares(spark):
    rng = random.Random(1)
    data = [(rng.choice("xyz"), rng.choice("mno"), rng.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(data, "a string, b string, y double")
    cells = df.groupBy("a", "b").agg(F.count("*").alias("cell_count"), F.sum("y").alias("value_sum"))
    got = {(r["factor"], r["level"]): r["effect"] for r in fits.additive_effects(cells, "a", "b", ("x", "m")).collect()}
    design = np.array([[1, a == "y", a == "z", b == "n", b == "o"] for a, b, _ in data], float)
    want = np.linalg.lstsq(design, np.array([y for *_, y in data]), rcond=None)[0]
    keys = [("intercept", ""), ("a", "y"), ("a", "z"), ("b", "n"), ("b", "o")]
    assert [got[k] for k in keys] == pytest.approx(list(want))
    assert got[("a", "x")] == got[("b", "m")] == 0.0
    unseen = spark.createDataFrame([("q", "m", 0.0)], df.schema)
    effects = fits.additive_effects(cells, "a", "b", ("x", "m"))
    assert fits.predict_additive(unseen, effects, "a", "b").first()["fitted"] is None


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    x[:, 2] = 4.0
    y = np.column_stack([x[:, 0] * 2 - x[:, 1] + rng.normal(size=200), x[:, 1] + 1])
    w = rng.uniform(0.5, 3, 200)
    df = spark.createDataFrame([(*map(float, (*a, *b, c)),) for a, b, c in zip(x, y, w)], "x0 double, x1 double, x2 double, y0 double, y1 double, w double")
    fit = fits.weighted_ridge(df, ["x0", "x1", "x2"], ["y0", "y1"], "w", 0.1)
    got = {(r["response"], r["feature"]): r["coefficient"] for r in fit.collect()}
    share = w / w.sum()
    z = (x - share @ x) / np.where(np.sqrt(share @ (x - share @ x) ** 2) > 1e-12, np.sqrt(share @ (x - share @ x) ** 2), 1)
    full = np.column_stack([np.ones(200), z])
    penalty = 0.1 * np.eye(4)
    penalty[0, 0] = 0
    want = np.linalg.solve(full.T @ (full * share[:, None]) + penalty, full.T @ (y * share[:, None]))
    for k in range(2):
        assert [got[(f"y{k}", f)] for f in ("intercept", "x0", "x1", "x2")] == pytest.approx(list(want[:, k]), abs=1e-9)
    predicted = fits.predict_linear(df, fit, ["x0", "x1", "x2"], ["y0"]).select("predicted_y0").first()[0]
    assert predicted == pytest.approx(float(full[0] @ want[:, 0]))


def test_two_feature_slopes_need_full_rank(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (2.0, 4.0, 5.0, 2.0)], "a double, b double, y double, w double")
    assert fits.two_feature_slopes(df, "a", "b", "y", "w").first()["beta_1"] is None


def test_training_moments_ignore_ineligible_rows(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 3.0, True), (3, 100.0, False)], "k int, x double, ok boolean")
    fitted = fits.moments(df, ["x"], F.col("ok"))
    got = {r["k"]: r["z_x"] for r in fits.standardize(df, fitted, ["x"], F.col("ok")).collect()}
    assert got == {1: -1.0, 2: 1.0, 3: None}


def test_multinomial_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(4)
    people, parts = 40, ["a", "b", "c"]
    x = rng.normal(size=(people, 2))
    offset = np.log(rng.dirichlet([3, 2, 1], people))
    truth = np.array([[0.5, -0.2], [0.0, 0.3], [-0.4, 0.0]])
    score = offset + x @ truth.T
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    counts = np.array([rng.multinomial(60, q) for q in p])
    rows = [(i, parts[j], float(offset[i, j]), int(counts[i, j]), float(x[i, 0]), float(x[i, 1])) for i in range(people) for j in range(3)]
    df = spark.createDataFrame(rows, "k int, c string, o double, n bigint, x0 double, x1 double")
    table = fits.offset_multinomial(df, ["k"], "c", parts, "o", "n", ["x0", "x1"])
    beta = np.zeros((3, 2))
    for r in table.collect():
        beta[parts.index(r["c"]), int(r["feature"][1])] = r["coefficient"]
    score = offset + x @ beta.T
    q = np.exp(score - score.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    gradient = (counts.sum(1, keepdims=True) * q - counts).T @ x / counts.sum() + 0.01 * beta
    assert np.abs(gradient).max() < 1e-8
    assert {r["fit_status"] for r in table.collect()} == {"converged"}
    cut = fits.offset_multinomial(df, ["k"], "c", parts, "o", "n", ["x0", "x1"], iterations=1).collect()
    assert {(r["fit_status"], r["iterations"]) for r in cut} == {("max_iterations", 1)}
    empty = fits.offset_multinomial(df.where("k < 0"), ["k"], "c", parts, "o", "n", ["x0", "x1"]).collect()
    assert {(r["fit_status"], r["coefficient"]) for r in empty} == {("no_rows", None)}


def test_calibration_of_perfect_predictions_is_the_identity(spark):
    rows = [("m", p, round(1000 * p), 1000) for p in (0.1, 0.25, 0.5, 0.8)] + [("none", 0.2, 0, 50)]
    df = spark.createDataFrame(rows, "model string, p double, y bigint, n bigint")
    got = {r["model"]: r for r in fits.calibration_lines(df, ["model"], "p", "y", "n").collect()}
    assert (got["m"]["calibration_intercept"], got["m"]["calibration_slope"]) == pytest.approx((0, 1), abs=1e-8)
    assert (got["none"]["fit_status"], got["none"]["calibration_slope"]) == ("degenerate_outcome", None)


def test_hurdle_by_hand(spark):
    df = spark.createDataFrame([(0, 0.0), (3, 0.0)], "y bigint, z double")
    got = fits.hurdle_scores(df, F.col("z"), F.lit(2.0), 0.5, "y").orderBy("y").collect()
    size, mu = 2.0, 2.0
    p = size / (size + mu)
    p0 = p**size
    pmf = math.gamma(3 + size) / math.gamma(size) / math.factorial(3) * p**size * (1 - p) ** 3
    assert got[0]["positive_nll"] is None and got[0]["full_nll"] == pytest.approx(math.log(2))
    assert got[1]["positive_nll"] == pytest.approx(-math.log(pmf / (1 - p0)))
    assert got[1]["expected_count"] == pytest.approx(0.5 * mu / (1 - p0))


def test_age_basis(spark):
    basis = fits.age_basis(F.lit(30.0))
    row = spark.range(1).select(*[c.alias(n) for n, c in basis.items()]).first().asDict()
    assert len(row) == 7 and row["age_center_27_over_5"] == pytest.approx(0.6) and row["age_hinge_29_over_5"] == pytest.approx(0.2) and row["age_hinge_32_over_5"] == 0


def test_history_weights(spark):
    df = spark.createDataFrame([(1, y, float(10**i)) for i, y in enumerate((2019, 2020, 2021, 2022, 2023))], "p int, y bigint, n double")
    got = {r["y"]: r["history_n"] for r in rates.weighted_history(df, ["p"], "y", ["n"]).collect()}
    assert got == {2019: 0, 2020: 1, 2021: 10 + 0.5, 2022: 100 + 5 + 0.25, 2023: 1000 + 50 + 2.5}


def test_rates_without_history_are_neutral(spark):
    row = spark.range(1).select(
        rates.count_multiplier(F.lit(0.0), F.lit(0.0), 15.0).alias("m"),
        rates.log_odds_residual(F.lit(0.0), F.lit(0.0), F.lit(0.0), 15.0).alias("r"),
        rates.shrunk_rate(F.lit(0.0), F.lit(0.0), 15.0).alias("s"),
        rates.count_multiplier(F.lit(30.0), F.lit(20.0), 10.0).alias("n"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 0.0, pytest.approx(40 / 30))


def test_leave_one_out_rate_falls_back_below_support(spark):
    data = [(1, 2024, "MLB", "MLB", 10, 4), (2, 2024, "MLB", "MLB", 30, 3), (3, 2024, "X", "AAA", 5, 1), (4, 2024, "X", "AAA", 5, 2), (5, 2024, "Y", "AAA", 90, 9)]
    df = spark.createDataFrame(data, "p int, y int, env string, lv string, n bigint, s bigint")
    got = {r["p"]: r for r in rates.leave_one_out_rates(df, "p", "y", "env", "lv", "n", "s", 50, F.col("lv") == "MLB").collect()}
    assert got[1]["baseline_rate"] == pytest.approx(3 / 30)
    assert (got[3]["baseline_source"], got[3]["baseline_rate"]) == ("level", pytest.approx(11 / 95))
    assert got[2]["expected"] == pytest.approx(30 * 0.4)


def test_role_profile_fallback_and_ties(spark):
    data = [(1, "SS", 5, 9, 3), (1, "2B", 5, 8, 2), (2, "C", 0, 4, 1), (2, "1B", 0, 1, 2), (3, "LF", 0, 0, 5)]
    df = spark.createDataFrame(data, "p int, role string, starts bigint, games bigint, code int")
    shares, primary = season.role_profile(df, ["p"], "role", "starts", "games", [F.desc("games"), F.asc("code")])
    got = {r["p"]: tuple(r)[1:4] for r in primary.collect()}
    assert got == {1: ("SS", 0.5, "starts"), 2: ("C", 0.8, "games_fallback")}
    assert shares.count() == 4


def test_blended_roles_stay_a_distribution(spark):
    now = spark.createDataFrame([(1, "a", 0.75), (1, "b", 0.25), (2, "b", 1.0)], "p int, r string, s double")
    later = spark.createDataFrame([(1, "a", 0.5), (1, "c", 0.5), (2, "b", 1.0)], "p int, r string, s double")
    primary = spark.createDataFrame([(1, "a", 0.75), (2, "b", 1.0)], "p int, primary_role string, primary_share double")
    means = rates.destination_means(primary, later, "p", "primary_role", "r", "s")
    assert {(r["primary_role"], r["r"]): r["destination_share"] for r in means.collect()} == {("a", "a"): 0.5, ("a", "c"): 0.5, ("b", "b"): 1.0}
    predicted = rates.blended_roles(now, primary, means, "p", "primary_role", "r", "s", 0.6)
    got = {(r["p"], r["r"]): r["predicted_share"] for r in predicted.collect()}
    assert got[(1, "a")] == pytest.approx(0.75 * 0.75 + 0.25 * 0.5) and got[(1, "c")] == pytest.approx(0.125)
    errors = {r["p"]: r["total_variation"] for r in rates.role_errors(predicted, later, "p", "r", "s").collect()}
    assert errors[2] == pytest.approx(0) and errors[1] == pytest.approx((0.1875 + 0.1875 + 0.375) / 2)


def test_calibration_of_many_groups(spark):
    """Ten thousand groups in one batch, held against Newton's method group by group; null is a group of its own."""
    rng = np.random.default_rng(8)
    n, per = 10_000, 6
    p = rng.uniform(0.05, 0.95, size=(n, per)).round(3)
    slope = rng.uniform(0.5, 1.5, size=n)
    x = np.log(p / (1 - p))
    y = rng.binomial(40, 1 / (1 + np.exp(-(0.2 + slope[:, None] * x))))
    y[7], p[11] = 0, 0.5
    table = pd.DataFrame({"g": np.repeat(np.arange(n), per), "p": p.ravel(), "y": y.ravel(), "n": 40})
    df = spark.createDataFrame(table).withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    got = {r["g"]: r for r in fits.calibration_lines(df, ["g"], "p", "y", "n").collect()}
    assert len(got) == n and got[7]["fit_status"] == "degenerate_outcome" and got[7]["calibration_slope"] is None and got[11]["fit_status"] == "singular_information"
    x = np.log(p / (1 - p))
    for g in [*range(3), *range(4, 7), 100, 9999, 3]:
        b = np.array([0.0, 1.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-(b[0] + b[1] * x[g])))
            design = np.stack([np.ones(per), x[g]])
            b = b + np.linalg.solve((design * 40 * q * (1 - q)) @ design.T, design @ (y[g] - 40 * q))
        r = got[None if g == 3 else g]
        assert r["fit_status"] == "converged" and (r["calibration_intercept"], r["calibration_slope"]) == pytest.approx(tuple(b), abs=1e-8)


def test_effects_of_a_thousand_environments(spark):
    """Against dense least squares, on a chain with random chords, weights that differ by category and noise."""
    rng = np.random.default_rng(12)
    n = 1_000
    pairs = [(i, i + 1) for i in range(n - 1)] + [tuple(rng.choice(n, 2, replace=False)) for _ in range(3 * n)]
    truth = rng.normal(size=(n, 3))
    rows = [(f"e{a}", f"e{b}", c, float(rng.uniform(1, 5)), float(truth[b, k] - truth[a, k] + rng.normal() * 0.1)) for a, b in pairs for k, c in enumerate(PARTS)]
    deltas = spark.createDataFrame(rows, "from_environment string, to_environment string, c string, pair_weight double, clr_delta double")
    found = composition.environment_effects(deltas, "c", "e0").collect()
    assert len(found) == 3 * n and {r["fit_status"] for r in found} == {"converged"}
    got = np.zeros((n, 3))
    for r in found:
        got[int(r["environment"][1:]), PARTS.index(r["c"])] = r["effect"]
    want = np.zeros((n, 3))
    for k, c in enumerate(PARTS):
        mine = [r for r in rows if r[2] == c]
        design, y = np.zeros((len(mine), n)), np.array([r[4] for r in mine])
        for i, r in enumerate(mine):
            design[i, int(r[0][1:])], design[i, int(r[1][1:])] = -1, 1
        w = np.sqrt([r[3] for r in mine])
        want[1:, k] = np.linalg.lstsq(design[:, 1:] * w[:, None], y * w, rcond=None)[0]
        rest = (y - design @ want[:, k]) * w
        assert next(r for r in found if r["c"] == c)["residual_rmse"] == pytest.approx(math.sqrt((rest**2).sum() / (w**2).sum()))
    assert np.abs(got - (want - want.mean(axis=1, keepdims=True))).max() < 1e-7


def test_larger_additive_fits_equal_the_dense_one(spark, monkeypatch):
    """Alternating projections against the solve on the driver, and a design that falls apart."""
    rng = np.random.default_rng(2)
    data = [(f"a{rng.integers(12)}", f"b{rng.integers(9)}", float(rng.normal())) for _ in range(4000)]
    cells = spark.createDataFrame(data, "a string, b string, y double").groupBy("a", "b").agg(F.count("*").alias("cell_count"), F.sum("y").alias("value_sum")).cache()
    want = {(r["factor"], r["level"]): r["effect"] for r in fits.additive_effects(cells, "a", "b", ("a3", "b0")).collect()}
    monkeypatch.setattr(fits, "MOST_CELLS", 20)
    got = {(r["factor"], r["level"]): r["effect"] for r in fits.additive_effects(cells, "a", "b", ("a3", "b0")).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    apart = cells.where("(a < 'a3') = (b < 'b4')")
    with pytest.raises(ValueError, match="rank deficient"):
        fits.additive_effects(apart, "a", "b", ("a3", "b5"))


def test_lines_far_from_zero_keep_their_digits(spark):
    """Slopes and errors where raw sums of squares would have lost every digit that matters."""
    draw = random.Random(4)
    rows = [(i, 1e9 + draw.random(), draw.choice([1.0, 2.0])) for i in range(2_000)]
    table = spark.createDataFrame([(i, x, 2 * (x - 1e9) + 3e9, w) for i, x, w in rows], "unit bigint, x double, y double, w double")
    line = profile.less_means(table, ["x", "y"]).agg(profile.weighted_line(F.col("x"), F.col("y"), F.col("w"))[0].alias("slope")).first()
    assert line["slope"] == pytest.approx(2.0, abs=1e-5)
    assert rates.permutation_p_value(table.limit(200), "unit", "x", "y", "w", 9, "s").first()["observed_slope"] == pytest.approx(2.0, abs=1e-4)
    near = spark.createDataFrame([(1, 1e6 + i, 1.0, 3 * (1e6 + i) + (-1) ** i * 1e-3) for i in range(1_000)] + [(2, 0.0, 1.0, 1.0)], "period bigint, score double, chance double, target double")
    found = {r["period"]: r for r in rates.native_run_rates(near, "period", "score", "chance", "target").collect()}
    assert found[1]["rmse"] == pytest.approx(1e-3, rel=1e-3) and found[1]["row_count"] == 1_000
    assert found[2]["slope"] is None and found[2]["rmse"] is None
