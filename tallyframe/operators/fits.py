"""Small models fitted from distributed sufficient statistics.

The data-sized work is always one aggregate. What reaches the driver is a fixed number of sums,
at most a few hundred, set by the number of parameters and never by the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip, log_gamma, logistic, negative_binomial_logpmf
from tallyframe.operators import composition, lookup
from tallyframe.session import checkpointed

# Fixed value: predictions are kept this far from 0 and 1 before their log-odds are taken.
CALIBRATION_CLIP = 1e-8
PARTICIPATION_ITERATIONS = 500


# --- standardisation ---------------------------------------------------------------------------


def moments(df: DataFrame, features: Sequence[str], eligible: Column) -> DataFrame:
    """One row of population means and deviations over the eligible training rows."""
    rows = df.where(eligible)
    return rows.agg(
        *[c for f in features for c in (F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"scale_{f}"))],
        F.count("*").alias("fitted_row_count"),
    )


def standardize(df: DataFrame, fitted: DataFrame, features: Sequence[str], eligible: Column) -> DataFrame:
    """Apply training moments unchanged; ineligible rows and features without spread stay null."""
    wide = lookup.attach_total(df, fitted)
    scores = [
        F.when(eligible & (F.col(f"scale_{f}") > 1e-12), (F.col(f) - F.col(f"mean_{f}")) / F.col(f"scale_{f}")).alias(f"z_{f}") for f in features
    ]
    return wide.select(*df.columns, *scores)


# --- least squares -----------------------------------------------------------------------------


MOST_CELLS = 10_000  # level pairs that a fit on the driver takes
ALTERNATIONS, STILL = 1_000, 1e-13  # rounds of a larger fit at most, and the change, in parts of the largest effect, that ends them


def additive_effects(cells: DataFrame, first: str, second: str, references: tuple[str, str]) -> DataFrame:
    """Effects of ``y ~ first + second`` from cell counts and sums, each reference level at zero.

    ``cells``: first, second, cell_count, value_sum. Up to ``MOST_CELLS`` level pairs are solved on the
    driver at once; more are fitted by alternating projections that stay in the cluster.
    """
    rows = cells.select(first, second, "cell_count", "value_sum").limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        return alternating_effects(cells, first, second, references)
    levels = [(first, v) for v in sorted({r[first] for r in rows}) if v != references[0]]
    levels += [(second, v) for v in sorted({r[second] for r in rows}) if v != references[1]]
    place = {level: i + 1 for i, level in enumerate(levels)}
    normal, right = np.zeros((len(levels) + 1,) * 2), np.zeros(len(levels) + 1)
    for r in rows:
        x = np.zeros(len(levels) + 1)
        x[0] = 1.0
        for factor in (first, second):
            if (factor, r[factor]) in place:
                x[place[(factor, r[factor])]] = 1.0
        normal += r["cell_count"] * np.outer(x, x)
        right += x * r["value_sum"]
    if np.linalg.matrix_rank(normal) < len(normal):
        raise ValueError("additive fit is rank deficient")
    solution = np.linalg.solve(normal, right)
    table = [("intercept", "", float(solution[0]))] + [(f, v, float(solution[i])) for (f, v), i in place.items()]
    table += [(first, references[0], 0.0), (second, references[1], 0.0)]
    return cells.sparkSession.createDataFrame(table, "factor string, level string, effect double")


def alternating_effects(cells: DataFrame, first: str, second: str, references: tuple[str, str]) -> DataFrame:
    """``additive_effects`` for any number of level pairs, by alternating projections.

    In turn, each level of one factor takes the mean of what the other factor leaves: a join and an
    aggregate of the cells, checkpointed once a round. The design has full rank if and only if its
    levels hang together, which is tested by spreading a label over the level pairs.
    """
    held = checkpointed(cells.where("cell_count > 0").select(F.col(first).alias("_a"), F.col(second).alias("_b"), F.col("cell_count").cast("double").alias("_n"), F.col("value_sum").cast("double").alias("_s")))
    a, b = F.concat(F.lit("a"), F.col("_a").cast("string")).alias("node"), F.concat(F.lit("b"), F.col("_b").cast("string")).alias("other")
    links = checkpointed(held.select(a, b).unionByName(held.select(a.alias("other"), b.alias("node"))))
    reached = composition.anchor_distances(links, f"a{references[0]}").select("node")
    wanted = cells.sparkSession.createDataFrame([(f"b{references[1]}",)], "node string")
    if not wanted.unionByName(links.select("node")).join(reached, "node", "left_anti").isEmpty():
        raise ValueError("additive fit is rank deficient")

    def means(level: str, other: str, known: DataFrame) -> DataFrame:
        left = F.sum(F.col("_s") - F.col("_n") * F.col("_e")) / F.sum("_n")
        return held.join(known, other).groupBy(level).agg(left.alias("_e"))

    now = checkpointed(held.groupBy("_b").agg(F.lit(0.0).alias("_e")))
    for _ in range(ALTERNATIONS):
        after = checkpointed(means("_b", "_a", means("_a", "_b", now)))
        gap = after.join(now.select("_b", F.col("_e").alias("_o")), "_b").agg(F.max(F.abs(F.col("_e") - F.col("_o"))).alias("gap"), F.max(F.abs(F.col("_e"))).alias("size")).first()
        now = after
        if gap["gap"] <= STILL * max(gap["size"], 1.0):
            break
    else:
        raise ValueError("alternating projections did not settle")
    other = checkpointed(means("_a", "_b", now))
    base = [other.where(F.col("_a") == references[0]).first()["_e"], now.where(F.col("_b") == references[1]).first()["_e"]]
    spark = cells.sparkSession
    parts = [frame.select(F.lit(name).alias("factor"), F.col(key).cast("string").alias("level"), (F.col("_e") - zero).alias("effect")) for frame, key, name, zero in ((other, "_a", first, base[0]), (now, "_b", second, base[1]))]
    return spark.createDataFrame([("intercept", "", float(sum(base)))], "factor string, level string, effect double").unionByName(parts[0]).unionByName(parts[1])


def predict_additive(df: DataFrame, effects: DataFrame, first: str, second: str, name: str = "fitted") -> DataFrame:
    """Fitted value per row; a level the fit never saw gives null.

    Effects are handed to every task if there are few of them, as ``additive_effects`` sees to; a longer table is joined
    as Spark decides.
    """
    few = effects.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    intercept = effects.where("factor = 'intercept'").select("effect").scalar()
    result = df
    for i, factor in enumerate((first, second)):
        part = effects.where(F.col("factor") == factor).select(F.col("level").alias(factor), F.col("effect").alias(f"_e{i}"))
        result = result.join(F.broadcast(part) if few else part, factor, "left")
    return result.withColumn(name, intercept + F.col("_e0") + F.col("_e1")).drop("_e0", "_e1")


def two_feature_slopes(df: DataFrame, x1: str, x2: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares through the origin on two features, in closed form in one aggregate.

    The slopes are null when the weighted design is not of full rank.
    """
    w = F.col(weight)
    sums = df.agg(
        F.sum(w * F.col(x1) * F.col(x1)).alias("s11"),
        F.sum(w * F.col(x1) * F.col(x2)).alias("s12"),
        F.sum(w * F.col(x2) * F.col(x2)).alias("s22"),
        F.sum(w * F.col(x1) * F.col(y)).alias("t1"),
        F.sum(w * F.col(x2) * F.col(y)).alias("t2"),
        F.count("*").alias("fitted_row_count"),
        F.sum(w).alias("fitted_weight"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    full_rank = det > 1e-12 * F.greatest(F.abs(F.col("s11") * F.col("s22")), F.col("s12") * F.col("s12"), F.lit(1.0))
    return sums.select(
        F.when(full_rank, (F.col("t1") * F.col("s22") - F.col("t2") * F.col("s12")) / det).alias("beta_1"),
        F.when(full_rank, (F.col("s11") * F.col("t2") - F.col("s12") * F.col("t1")) / det).alias("beta_2"),
        det.alias("determinant"),
        "fitted_row_count",
        "fitted_weight",
    )


def weighted_ridge(
    df: DataFrame, features: Sequence[str], responses: Sequence[str], weight: str, penalty: float
) -> DataFrame:
    """Ridge coefficients for several responses on weighted-standardised features.

    Weights are scaled to sum to one before the penalty is added; the intercept is not penalised and
    a feature without spread gets no coefficient. Two aggregates: weighted means, then the centred
    cross products.
    """
    w = F.col(weight)
    first = df.agg(F.sum(w).alias("w"), *[F.sum(w * F.col(f)).alias(f"m_{f}") for f in features]).first()
    means = {f: first[f"m_{f}"] / first["w"] for f in features}
    x = [F.col(f) - F.lit(means[f]) for f in features]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = df.agg(
        *[F.sum(w * x[i] * x[j]).alias(f"g_{i}_{j}") for i, j in pairs],
        *[F.sum(w * x[i] * F.col(r)).alias(f"c_{i}_{k}") for i in range(len(x)) for k, r in enumerate(responses)],
        *[F.sum(w * F.col(r)).alias(f"y_{k}") for k, r in enumerate(responses)],
    ).first()
    scales = [math.sqrt(max(sums[f"g_{i}_{i}"], 0.0) / first["w"]) for i in range(len(x))]
    used = [i for i, s in enumerate(scales) if s > 1e-12]
    gram = np.zeros((len(used), len(used)))
    for a, i in enumerate(used):
        for b, j in enumerate(used):
            gram[a, b] = sums[f"g_{min(i, j)}_{max(i, j)}"] / first["w"] / (scales[i] * scales[j])
    rows = []
    for k, response in enumerate(responses):
        cross = np.array([sums[f"c_{i}_{k}"] / first["w"] / scales[i] for i in used])
        beta = np.linalg.solve(gram + penalty * np.eye(len(used)), cross) if used else np.zeros(0)
        rows.append((response, "intercept", sums[f"y_{k}"] / first["w"], 0.0, 1.0))
        for i, f in enumerate(features):
            value = float(beta[used.index(i)]) if i in used else 0.0
            rows.append((response, f, value, means[f], scales[i] if i in used else 1.0))
    return df.sparkSession.createDataFrame(rows, "response string, feature string, coefficient double, center double, scale double")


def predict_linear(df: DataFrame, coefficients: DataFrame, features: Sequence[str], responses: Sequence[str]) -> DataFrame:
    """Predictions as plain columns; the coefficient table holds one row per parameter."""
    table = {(r["response"], r["feature"]): r for r in coefficients.collect()}
    result = df
    for response in responses:
        value = F.lit(table[(response, "intercept")]["coefficient"])
        for f in features:
            row = table[(response, f)]
            value = value + row["coefficient"] * (F.col(f) - row["center"]) / row["scale"]
        result = result.withColumn(f"predicted_{response}", value)
    return result


def age_basis(age: Column) -> dict[str, Column]:
    """Centred age and its hinges, in units of five years."""
    # Center and knots of the age basis.
    knots = (20, 23, 26, 29, 32, 35)
    basis = {"age_center_27_over_5": (age - 27.0) / 5.0}
    basis.update({f"age_hinge_{k}_over_5": F.greatest(age - float(k), F.lit(0.0)) / 5.0 for k in knots})
    return basis


# --- iterative fits ----------------------------------------------------------------------------


def participation_model(df: DataFrame, features: Sequence[str], label: str, strength: float = 1.0):
    """L2 logistic regression with the penalty of inverse strength ``strength`` on unscaled features.

    ``fit_status`` is ``converged`` when the fit stopped before its last permitted iteration.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(
        featuresCol="_x",
        labelCol="_y",
        regParam=1.0 / (strength * df.count()),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=PARTICIPATION_ITERATIONS,
        tol=1e-10,
    ).fit(rows)
    steps = int(model.summary.totalIterations)
    status = "converged" if steps < PARTICIPATION_ITERATIONS else "max_iterations"
    table = [("intercept", float(model.intercept), status, steps)] + [(f, float(v), status, steps) for f, v in zip(features, model.coefficients)]
    return df.sparkSession.createDataFrame(table, "feature string, coefficient double, fit_status string, iterations bigint")


def calibration_lines(
    df: DataFrame, groups: Sequence[str], probability: str, successes: str, trials: str, iterations: int = 100, tolerance: float = 1e-10
) -> DataFrame:
    """Grouped-binomial calibration intercept and slope of every group, by Newton's method for all groups at once.

    Rows are reduced to one per group and distinct prediction and checkpointed. The parameters are a table
    of one row per group; a step joins those of the groups still moving to the rows, adds up five sums per
    group and solves the 2 x 2 systems in columns, so any number of groups may take part.
    """
    clipped = clip(F.col(probability), CALIBRATION_CLIP, 1.0 - CALIBRATION_CLIP)
    compact = checkpointed(
        df.where(F.col(trials) > 0)
        .groupBy(*groups, F.log(clipped / (1.0 - clipped)).alias("_x"))
        .agg(F.sum(successes).cast("double").alias("_y"), F.sum(trials).cast("double").alias("_n"))
    )
    degenerate = (F.col("_y") == 0) | (F.col("_y") == F.col("_n"))
    fitted = compact.groupBy(*groups).agg(F.sum("_y").alias("_y"), F.sum("_n").alias("_n")).select(
        *groups, F.lit(0.0).alias("_b0"), F.lit(1.0).alias("_b1"), F.lit(0).cast("bigint").alias("iterations"), F.when(degenerate, "degenerate_outcome").alias("fit_status")
    )
    fitted = checkpointed(fitted)
    keys = [f"_k_{g}" for g in groups]
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)]
    for _ in range(iterations):
        live = fitted.where("fit_status is null").select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], "_b0", "_b1")
        if live.isEmpty():
            break
        p = logistic(F.col("_b0") + F.col("_b1") * F.col("_x"))
        stepped = compact.join(live, same).withColumn("_p", p)
        rest, info = F.col("_y") - F.col("_n") * F.col("_p"), F.col("_n") * F.col("_p") * (1 - F.col("_p"))
        sums = stepped.groupBy(*keys).agg(
            F.sum(rest).alias("g0"),
            F.sum(rest * F.col("_x")).alias("g1"),
            F.sum(info).alias("h00"),
            F.sum(info * F.col("_x")).alias("h01"),
            F.sum(info * F.col("_x") * F.col("_x")).alias("h11"),
        )
        scale = F.col("h00") * F.col("h11")
        det = scale - F.col("h01") * F.col("h01")
        solvable = F.abs(det) > 1e-14 * F.greatest(F.lit(1.0), scale)
        moves = sums.select(
            *keys,
            F.when(solvable, F.try_divide(F.col("g0") * F.col("h11") - F.col("g1") * F.col("h01"), det)).alias("_m0"),
            F.when(solvable, F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)).alias("_m1"),
            F.lit(True).alias("_stepped"),
        )
        still = F.greatest(F.abs("_m0"), F.abs("_m1")) > tolerance
        status = F.when(F.col("_stepped"), F.when(F.col("_m0").isNull(), "singular_information").when(~still, "converged")).otherwise(F.col("fit_status"))
        fitted = checkpointed(
            fitted.join(moves, same, "left").select(
                *groups,
                (F.col("_b0") + F.coalesce("_m0", F.lit(0.0))).alias("_b0"),
                (F.col("_b1") + F.coalesce("_m1", F.lit(0.0))).alias("_b1"),
                (F.col("iterations") + F.when(F.col("_stepped"), 1).otherwise(0)).alias("iterations"),
                status.alias("fit_status"),
            )
        )
    found = F.coalesce(F.col("fit_status"), F.lit("max_iterations"))
    known = found != "degenerate_outcome"
    return fitted.select(
        *groups, F.when(known, F.col("_b0")).alias("calibration_intercept"), F.when(known, F.col("_b1")).alias("calibration_slope"), found.alias("fit_status"), "iterations"
    )


def offset_multinomial(
    df: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str], offset: str, count: str, features: Sequence[str], penalty: float = 0.01, iterations: int = 50, tolerance: float = 1e-9
) -> DataFrame:
    """Multinomial residual coefficients on top of a fixed log-probability offset.

    Loss: mean negative log likelihood plus ``penalty / 2`` times the squared coefficients. Long input
    with one row per key and category is laid out as one row per key and checkpointed; each Newton
    step is one aggregate of the gradient and the curvature, whose size is set by categories and
    features alone. ``fit_status`` is ``converged`` only when the gradient at the returned coefficients
    is within ``tolerance``, else ``max_iterations``; without any counted unit it is ``no_rows`` and the
    coefficients are null.
    """
    k, m = len(categories), len(features)
    wide = checkpointed(
        df.groupBy(*keys).agg(
            *[F.max(f).cast("double").alias(f"x{a}") for a, f in enumerate(features)],
            *[F.max(F.when(F.col(category) == c, F.col(offset))).cast("double").alias(f"o{i}") for i, c in enumerate(categories)],
            *[F.sum(F.when(F.col(category) == c, F.col(count)).otherwise(0)).cast("double").alias(f"n{i}") for i, c in enumerate(categories)],
        )
    )
    beta = np.zeros((k, m))
    status, steps = "max_iterations", 0
    for step in range(iterations + 1):
        scores = [sum((float(beta[i, a]) * F.col(f"x{a}") for a in range(m)), F.col(f"o{i}")) for i in range(k)]
        rows = wide.select("*", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
        rows = rows.withColumn("_top", F.greatest(*[F.col(f"s{i}") for i in range(k)]))
        rows = rows.select("*", *[F.exp(F.col(f"s{i}") - F.col("_top")).alias(f"e{i}") for i in range(k)])
        rows = rows.withColumn("_z", sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0")))
        rows = rows.withColumn("_n", sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0")))
        rows = rows.select("*", *[(F.col(f"e{i}") / F.col("_z")).alias(f"p{i}") for i in range(k)])
        sums = rows.agg(
            F.sum("_n").alias("total"),
            *[F.sum((F.col("_n") * F.col(f"p{i}") - F.col(f"n{i}")) * F.col(f"x{a}")).alias(f"g_{i}_{a}") for i in range(k) for a in range(m)],
            *[
                F.sum(F.col("_n") * (F.col(f"p{i}") * (1.0 if i == j else 0.0) - F.col(f"p{i}") * F.col(f"p{j}")) * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"h_{i}_{j}_{a}_{b}")
                for i in range(k)
                for j in range(i, k)
                for a in range(m)
                for b in range(m)
            ],
        ).first()
        total = sums["total"]
        if not total:
            status = "no_rows"
            break
        gradient = np.array([[sums[f"g_{i}_{a}"] / total for a in range(m)] for i in range(k)]) + penalty * beta
        if np.abs(gradient).max() <= tolerance:
            status = "converged"
            break
        if step == iterations:
            break
        curve = np.zeros((k * m, k * m))
        for i in range(k):
            for j in range(k):
                for a in range(m):
                    for b in range(m):
                        name = f"h_{i}_{j}_{a}_{b}" if i <= j else f"h_{j}_{i}_{b}_{a}"
                        curve[i * m + a, j * m + b] = sums[name] / total
        curve += penalty * np.eye(k * m)
        beta = beta - np.linalg.solve(curve, gradient.ravel()).reshape(k, m)
        steps += 1
    known = status != "no_rows"
    table = [(c, f, float(beta[i, a]) if known else None, status, steps) for i, c in enumerate(categories) for a, f in enumerate(features)]
    return df.sparkSession.createDataFrame(table, f"{category} string, feature string, coefficient double, fit_status string, iterations bigint")


# --- scoring with given coefficients -----------------------------------------------------------


def hurdle_scores(df: DataFrame, participation: Column, mean: Column, dispersion: float, observed: str) -> DataFrame:
    """Zero hurdle with a zero-truncated negative binomial: probability, means and likelihoods.

    ``participation`` is a log-odds and ``mean`` the untruncated mean, both given as columns.
    """
    size = 1.0 / dispersion
    p = clip(logistic(participation), 1e-12, 1.0 - 1e-12)
    y = F.col(observed)
    rows = df.withColumn("participation_probability", p).withColumn("_mu", mean)
    zero = F.pow(size / (size + F.col("_mu")), F.lit(size))
    rows = rows.withColumn("positive_mean", F.col("_mu") / (1.0 - zero))
    q = F.col("participation_probability")
    truncated = negative_binomial_logpmf(y.cast("double"), F.col("_mu"), dispersion) - F.log1p(-zero)
    part = F.when(y > 0, -F.log(q)).otherwise(-F.log(1.0 - q))
    positive = F.when(y > 0, -truncated)
    return (
        rows.withColumn("expected_count", q * F.col("positive_mean"))
        .withColumn("participation_nll", part)
        .withColumn("positive_nll", positive)
        .withColumn("full_nll", part + F.coalesce(positive, F.lit(0.0)))
        .drop("_mu")
    )


def linear_columns(parameters: Mapping[str, float]) -> Column:
    """Linear predictor from stored coefficients: intercept plus one product per feature column."""
    value = F.lit(float(parameters["intercept"]))
    for feature, coefficient in parameters.items():
        if feature != "intercept":
            value = value + float(coefficient) * F.col(feature)
    return value


def poisson_nll(observed: Column, mean: Column) -> Column:
    return mean - observed * F.log(mean) + log_gamma(observed + 1.0)


def binomial_nll(successes: Column, trials: Column, probability: Column) -> Column:
    return -(successes * F.log(probability) + (trials - successes) * F.log(1.0 - probability))
