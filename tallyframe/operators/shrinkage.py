"""Peer priors that leave the entity itself out, and empirical-Bayes shrinkage toward them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peer_prior(
    counts: DataFrame, context: DataFrame, entity: str, category: str, count: str, narrow: str, wide: str, size: int, minimum: int = 12, pseudocount: float = 0.5
) -> DataFrame:
    """Prior category shares from an entity's peers, itself excluded.

    Peers share ``wide`` and ``narrow`` if at least ``minimum`` others do, else ``wide`` if any other
    does, else they are everyone. Each pool is a group total minus the entity's own counts, so no
    entity is compared with another. Entities without context are left out. ``counts`` has one row per
    entity and category. The wider totals are sums over the narrow cells, a table of one row per peer
    group and category, and rows meet their totals in one join on all three columns.
    """
    known = context.where(F.col(narrow).isNotNull() & F.col(wide).isNotNull()).select(entity, narrow, wide)
    rows = counts.join(known, entity)
    grains = {"narrow": [wide, narrow], "wide": [wide], "all": []}
    cells = rows.groupBy(wide, narrow, category).agg(F.sum(count).alias("_narrow_n"), F.count("*").alias("_narrow_k"))
    for name in ("wide", "all"):
        group = Window.partitionBy(*grains[name], category)
        cells = cells.withColumns({f"_{name}_{part}": F.sum(f"_narrow_{part}").over(group) for part in ("n", "k")})
    joined = rows.join(cells, [wide, narrow, category])
    others = {name: F.col(f"_{name}_k") - 1 for name in grains}
    source = F.when(others["narrow"] >= minimum, "narrow").when(others["wide"] > 0, "wide").otherwise("all")

    def chosen(part: Column, fallback: dict[str, Column]) -> Column:
        return F.when(part == "narrow", fallback["narrow"]).when(part == "wide", fallback["wide"]).otherwise(fallback["all"])

    picked = joined.withColumn("prior_source", source)
    pooled = chosen(F.col("prior_source"), {name: F.col(f"_{name}_n") - F.col(count) for name in grains})
    peers = chosen(F.col("prior_source"), others)
    pools = picked.select(entity, category, narrow, wide, "prior_source", pooled.alias("_pooled"), peers.alias("prior_peer_count"))
    # An entity has one row per category, so this window holds a handful of rows.
    pools = pools.withColumn("prior_peer_events", F.sum("_pooled").over(Window.partitionBy(entity)))
    share = (F.col("_pooled") + pseudocount) / (F.col("prior_peer_events") + pseudocount * size)
    return pools.withColumn("prior_probability", share).drop("_pooled")


def empirical_bayes(counts: DataFrame, prior: DataFrame, entity: str, category: str, count: str, strength: float) -> DataFrame:
    """Posterior share ``(n_k + s * prior_k) / (N + s)`` next to the prior share."""
    totals = counts.groupBy(entity).agg(F.sum(count).alias("entity_events"))
    joined = counts.join(prior, [entity, category]).join(totals, entity)
    posterior = (F.col(count) + strength * F.col("prior_probability")) / (F.col("entity_events") + strength)
    return joined.withColumn("posterior_probability", posterior)


def paired_models(first: DataFrame, second: DataFrame, keys: Sequence[str], probability: str, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(both models' probabilities side by side, keys only one of them predicts)."""
    a = first.select(*keys, F.col(probability).alias(names[0]))
    b = second.select(*keys, F.col(probability).alias(names[1]))
    both = a.join(b, list(keys), "full")
    gap = F.col(names[0]).isNull() | F.col(names[1]).isNull()
    return both.where(~gap), both.where(gap)
