"""Log-ratio geometry of category mixes in long form.

Inputs hold every category of every key (see ``season.complete``), so a window over a key covers a
fixed short list of categories.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import mixes
from tallyframe.session import checkpointed


def centered_log_ratio(
    df: DataFrame, keys: Sequence[str], count: str, size: int, pseudocount: float = 0.5, name: str = "clr"
) -> DataFrame:
    """Log of the smoothed share minus its mean over the key's categories."""
    whole = Window.partitionBy(*keys)
    smoothed = (F.col(count) + pseudocount) / (F.sum(count).over(whole) + pseudocount * size)
    logs = df.withColumn("_log", F.log(smoothed))
    return logs.withColumn(name, F.col("_log") - F.avg("_log").over(whole)).drop("_log")


def log_center(df: DataFrame, keys: Sequence[str], probability: str, name: str = "clr") -> DataFrame:
    """Centered log-ratio of strictly positive probabilities, without smoothing."""
    logs = df.withColumn("_log", F.log(probability))
    return logs.withColumn(name, F.col("_log") - F.avg("_log").over(Window.partitionBy(*keys))).drop("_log")


def softmax(df: DataFrame, keys: Sequence[str], score: str, name: str = "probability") -> DataFrame:
    """Shares from scores, shifted by the key's largest score so nothing overflows."""
    whole = Window.partitionBy(*keys)
    raised = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(whole)))
    return raised.withColumn(name, F.col("_e") / F.sum("_e").over(whole)).drop("_e")


def helmert_basis(categories: Sequence[str]) -> list[tuple[str, int, float]]:
    """(category, coordinate, weight) of the sequential basis.

    Coordinate j sets the mean of the first j categories against category j + 1; its weights sum to
    zero and have unit length.
    """
    basis = []
    for j in range(1, len(categories)):
        length = math.sqrt(j * (j + 1))
        basis += [(c, j, 1.0 / length) for c in categories[:j]]
        basis.append((categories[j], j, -j / length))
    return basis


def isometric_log_ratio(df: DataFrame, keys: Sequence[str], category: str, probability: str, categories: Sequence[str]) -> DataFrame:
    """One row per key with coordinates ``ilr_1 .. ilr_(D-1)``.

    The basis is a fixed table over the categories, so it is written into the aggregate.
    """
    weights: dict[int, list[Column]] = {}
    for name, j, weight in helmert_basis(categories):
        weights.setdefault(j, []).append(F.sum(F.when(F.col(category) == name, weight * F.log(probability))))
    coordinates = [sum(parts[1:], parts[0]).alias(f"ilr_{j}") for j, parts in weights.items()]
    return df.groupBy(*keys).agg(*coordinates)


def inverse_isometric(df: DataFrame, keys: Sequence[str], categories: Sequence[str], prefix: str = "ilr_") -> DataFrame:
    """Long probabilities of each key from its coordinates."""
    scores: dict[str, Column] = {c: F.lit(0.0) for c in categories}
    for name, j, weight in helmert_basis(categories):
        scores[name] = scores[name] + weight * F.col(f"{prefix}{j}")
    top = F.greatest(*scores.values())
    total = sum((F.exp(s - top) for s in list(scores.values())[1:]), F.exp(scores[categories[0]] - top))
    cells = [F.struct(F.lit(c).alias("category"), (F.exp(s - top) / total).alias("probability")) for c, s in scores.items()]
    return df.select(*keys, F.inline(F.array(*cells)))


def shift_environment(
    df: DataFrame, keys: Sequence[str], environment: str, category: str, clr: str, effects: DataFrame, sign: int
) -> tuple[DataFrame, DataFrame]:
    """(shares after adding (+1) or removing (-1) the environment effect, environments without one)."""
    known = effects.select(environment, category, "effect")
    joined = df.join(known, [environment, category], "left")
    unknown = joined.where("effect is null").groupBy(environment).agg(F.count("*").alias("row_count"))
    shifted = joined.where("effect is not null").withColumn("_score", F.col(clr) + sign * F.col("effect"))
    return softmax(shifted, keys, "_score", "shifted_probability").drop("_score", "effect"), unknown


def reweight_within(
    df: DataFrame, keys: Sequence[str], subset: Column, probability: str, shift: Column, name: str = "adjusted_probability"
) -> DataFrame:
    """Move the subset's shares by ``shift`` on the logit scale while its total mass stays the same.

    Categories outside the subset, and keys whose shift is null, keep their probability.
    """
    whole = Window.partitionBy(*keys)
    raised = F.when(subset, F.col(probability) * F.exp(shift))
    mass = F.sum(F.when(subset, F.col(probability))).over(whole)
    rows = df.withColumn("_raised", raised)
    moved = F.col("_raised") / F.sum("_raised").over(whole) * mass
    return rows.withColumn(name, F.coalesce(moved, F.col(probability))).drop("_raised")


def pair_deltas(pairs: DataFrame, profiles: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Per matched pair and category: the log-ratio of the later stint minus the earlier one.

    ``pairs`` holds from_stint_index / to_stint_index; ``profiles`` the clr of every stint.
    """
    first = profiles.select(*keys, F.col("stint_index").alias("from_stint_index"), category, F.col("clr").alias("_from"))
    second = profiles.select(*keys, F.col("stint_index").alias("to_stint_index"), category, F.col("clr").alias("_to"))
    joined = pairs.join(first, [*keys, "from_stint_index"]).join(second, [*keys, "to_stint_index", category])
    return joined.withColumn("clr_delta", F.col("_to") - F.col("_from")).drop("_from", "_to")


# Conjugate gradients: steps at most, and the part of the first residual at which a category has converged.
MOST_STEPS, RESIDUAL = 400, 1e-11


def environment_effects(deltas: DataFrame, category: str, anchor: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Weighted least-squares environment effects from matched pairs, zero at the anchor before centering.

    ``deltas``: from_environment, to_environment, category, pair_weight, clr_delta. Environments are the
    nodes of a graph and matched pairs its weighted edges, so the normal equations are the graph's
    Laplacian with the anchor held at zero. They are solved by conjugate gradients on one row per
    environment with a vector over the categories: a step joins the directions of the neighbours to the
    edges and adds them up. What reaches the driver is one number per category and sum. Every
    environment must be linked to the anchor. ``residual_rmse`` is taken pair by pair.
    """
    usable = deltas.where("from_environment <> to_environment and pair_weight > 0")
    categories = categories or sorted(r[0] for r in usable.select(category).distinct().collect())  # a fixed short list
    size = len(categories)
    pairs = mixes.vectors(usable, ["from_environment", "to_environment"], category, categories, w=F.col("pair_weight"), wy=F.col("pair_weight") * F.col("clr_delta"), n=F.lit(1))
    ends = F.array(
        F.struct(F.col("to_environment").alias("node"), F.col("from_environment").alias("other"), F.col("wy").alias("b")),
        F.struct(F.col("from_environment").alias("node"), F.col("to_environment").alias("other"), F.transform("wy", lambda x: -x).alias("b")),
    )
    edges = checkpointed(pairs.select(F.explode(ends).alias("e"), "w", "n").select("e.*", "w", "n"))
    distance = anchor_distances(edges, anchor)
    unlinked = edges.join(distance, "node", "left_anti").select("node").distinct().orderBy("node").limit(20).collect()
    if unlinked or not categories or edges.where(F.col("node") == anchor).isEmpty():
        raise ValueError(f"environments not linked to anchor {anchor}: {[r[0] for r in unlinked] or [anchor]}")
    nodes = mixes.summed(edges, ["node"], size, "w", "b", "n")
    solved, status = _anchored_solution(edges, nodes, size, anchor)
    effects = checkpointed(solved.unionByName(nodes.where(F.col("node") == anchor).select("node", F.array(*[F.lit(0.0)] * size).alias("x"))))

    known = {side: effects.select(F.col("node").alias(f"{side}_environment"), F.col("x").alias(f"_{side}")) for side in ("from", "to")}
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category)).cast("int")
    step = F.get("_to", place - 1) - F.get("_from", place - 1)
    left = F.col("clr_delta") - step
    rmse = usable.join(known["from"], "from_environment").join(known["to"], "to_environment").groupBy(category).agg(
        F.sqrt(F.sum(F.col("pair_weight") * left * left) / F.sum("pair_weight")).alias("residual_rmse")
    )
    mean = mixes.bound(mixes.total("x") / size, lambda m: F.transform("x", lambda x: x - m))
    whole = effects.join(nodes.select("node", F.get("n", F.lit(0)).alias("matched_pair_count"), F.get("w", F.lit(0)).alias("matched_pair_weight")), "node").join(distance, "node")
    keep = ["environment", "matched_pair_count", "matched_pair_weight", "anchor_distance"]
    long = mixes.unfolded(whole.withColumn("effect", mean).withColumnRenamed("node", "environment"), keep, category, categories, effect="effect")
    return long.join(rmse, category).select("environment", category, "effect", *keep[1:], "residual_rmse", F.lit(status).alias("fit_status"))


def anchor_distances(edges: DataFrame, anchor: str) -> DataFrame:
    """(node, anchor_distance) of every node that the anchor's label reaches over (node, other) edges, one ring a round."""
    links = edges.select("node", "other").distinct()
    reached = edges.sparkSession.createDataFrame([(anchor, 0)], "node string, anchor_distance bigint")
    ring, rounds = reached, 0
    while True:
        rounds += 1
        onward = links.join(ring.select(F.col("node").alias("other")), "other", "left_semi").select("node").distinct()
        ring = checkpointed(onward.join(reached, "node", "left_anti").select("node", F.lit(rounds).cast("bigint").alias("anchor_distance")))
        if ring.isEmpty():
            return reached
        reached = checkpointed(reached.unionByName(ring))


def _anchored_solution(edges: DataFrame, nodes: DataFrame, size: int, anchor: str) -> tuple[DataFrame, str]:
    """(node, x) of all nodes but the anchor, and whether all categories converged.

    The preconditioner is the diagonal, a node's sum of weights. Categories are solved side by side;
    one that has converged, or a node without pairs in it, no longer moves.
    """
    inner = edges.where((F.col("node") != anchor) & (F.col("other") != anchor)).select("node", "other", F.col("w").alias("_w"))
    zero = F.array(*[F.lit(0.0)] * size)

    def over(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: F.when(y > 0, x / y).otherwise(0.0))

    def dots(df: DataFrame, **products: tuple[str, str]) -> dict[str, list[float]]:
        named = df.select(*[F.zip_with(a, b, lambda x, y: x * y).alias(name) for name, (a, b) in products.items()])
        row = mixes.summed(named, [], size, *products).first()
        return {name: [v or 0.0 for v in row[name]] for name in products}

    def stepped(a: str, factors: Sequence[float], b: str) -> Column:
        return F.zip_with(a, F.zip_with(F.array(*[F.lit(f) for f in factors]), b, lambda f, y: f * y), lambda x, y: x + y)

    state = checkpointed(nodes.where(F.col("node") != anchor).select("node", "w", zero.alias("x"), F.col("b").alias("r"), over("b", "w").alias("p")))
    rest = dots(state, rz=("r", "p"))["rz"]
    goal = [RESIDUAL * RESIDUAL * first for first in rest]
    for _ in range(MOST_STEPS):
        if all(now <= end for now, end in zip(rest, goal, strict=True)):
            return state.select("node", "x"), "converged"
        around = inner.join(state.select(F.col("node").alias("other"), F.col("p").alias("_p")), "other")
        pulled = mixes.summed(around.select("node", F.zip_with("_w", "_p", lambda w, p: w * p).alias("_q")), ["node"], size, "_q")
        moved = F.zip_with(F.zip_with("w", "p", lambda w, p: w * p), F.coalesce("_q", zero), lambda own, others: own - others)
        state = checkpointed(state.join(pulled, "node", "left").select("node", "w", "x", "r", "p", moved.alias("q")))
        found = dots(state, pq=("p", "q"))["pq"]
        alpha = [now / pq if now > end and pq > 0 else 0.0 for now, end, pq in zip(rest, goal, found, strict=True)]
        state = state.withColumns({"x": stepped("x", alpha, "p"), "r": stepped("r", [-a for a in alpha], "q")}).withColumn("_z", over("r", "w"))
        # Taken from the residuals themselves: worked out from the step, a residual that falls to nothing would be lost in rounding.
        after = dots(state, rz=("r", "_z"))["rz"]
        beta = [new / now if a else 0.0 for new, now, a in zip(after, rest, alpha, strict=True)]
        state = state.withColumn("p", stepped("_z", beta, "p")).select("node", "w", "x", "r", "p")
        rest = after
    return state.select("node", "x"), "max_iterations"
