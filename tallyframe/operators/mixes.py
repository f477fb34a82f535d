"""Category mixes as vectors: one row per entity, the fixed categories in one array in their declared order.

Arithmetic on a mix stays inside its row (``zip_with``, ``transform``, ``aggregate``), so only sums over entities are
shuffled, and those are element-wise sums that combine on the map side. ``unfolded`` gives the long form back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vectors(df: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str], **amounts: Column) -> DataFrame:
    """One row per key; each named amount summed by category into an array, absent categories zero.

    Rows of other categories count nowhere, but their keys are kept.
    """
    sums = [
        F.array(*[F.coalesce(F.sum(F.when(F.col(category) == c, amount)), F.lit(0)) for c in categories]).alias(name) for name, amount in amounts.items()
    ]
    return df.groupBy(*keys).agg(*sums)


def summed(df: DataFrame, keys: Sequence[str], size: int, *names: str, **more: Column) -> DataFrame:
    """Element-wise sums of vectors per key, with other aggregates beside them."""
    sums = [F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)]).alias(name) for name in names]
    return df.groupBy(*keys).agg(*sums, *[c.alias(name) for name, c in more.items()])


def unfolded(df: DataFrame, keep: Sequence[str], category: str, categories: Sequence[str], **vectors_: str | Column) -> DataFrame:
    """Long form: one row per key and category with one element of each named vector."""
    columns = {name: F.col(v) if isinstance(v, str) else v for name, v in vectors_.items()}
    bound = df.select(*keep, *[c.alias(f"_v_{name}") for name, c in columns.items()])
    rows = [F.struct(F.lit(c).alias(category), *[F.get(f"_v_{name}", F.lit(i)).alias(name) for name in columns]) for i, c in enumerate(categories)]
    return bound.select(*keep, F.inline(F.array(*rows)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda held, x: held + x)


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def added(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def shares(v: Column) -> Column:
    return bound(v, lambda w: bound(total(w), lambda whole: F.transform(w, lambda x: x / whole)))


def smoothed_shares(v: Column, size: int, pseudocount: float = 0.5) -> Column:
    return bound(total(v), lambda whole: F.transform(v, lambda x: (x + pseudocount) / (whole + pseudocount * size)))


def centered_log(p: Column, size: int) -> Column:
    """Logs of positive shares minus their mean."""
    return bound(F.transform(p, lambda x: F.log(x)), lambda logs: bound(total(logs) / size, lambda mean: F.transform(logs, lambda x: x - mean)))


def softmax(scores: Column) -> Column:
    """Shares from scores, shifted by the largest so that nothing overflows."""
    raised = bound(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return shares(raised)


def effect_of(environment: Column | str, effects: Mapping[str, Sequence[float]]) -> Column:
    """The declared effect vector of an environment, null for one without."""
    found = None
    for name, vector in effects.items():
        held = F.array(*[F.lit(float(x)) for x in vector])
        known = F.col(environment) == name if isinstance(environment, str) else environment == name
        found = F.when(known, held) if found is None else found.when(known, held)
    return F.lit(None).cast("array<double>") if found is None else found


def shifted(mix: Column, effect: Column, size: int, sign: int, pseudocount: float = 0.5) -> Column:
    """Shares of a mix of counts after adding (+1) or removing (-1) an effect on the log-ratio scale."""
    return softmax(added(centered_log(smoothed_shares(mix, size, pseudocount), size), effect, sign))


def peer_prior(df: DataFrame, mix: str, narrow: str, wide: str, size: int, minimum: int = 12, pseudocount: float = 0.5) -> DataFrame:
    """``df`` with the prior shares of each entity's peers, itself left out, and where they come from.

    ``df`` has one row per entity. Peers share ``wide`` and ``narrow`` if at least ``minimum`` others do, else ``wide`` if
    any other does, else they are everyone. The pool is chosen per peer group, since its size says which: the entity's own
    vector is then taken off the group's total. Rows without a group are left out. The wider totals are windows over one
    row per peer group.
    """
    known = df.where(F.col(narrow).isNotNull() & F.col(wide).isNotNull())
    cells = summed(known.select(wide, narrow, F.col(mix).alias("_narrow")), [wide, narrow], size, "_narrow", _narrow_k=F.count("*"))
    # The grand total gathers the peer groups, so the wider totals need no exchange of their own.
    for level, group in (("all", Window.partitionBy()), ("wide", Window.partitionBy(wide))):
        cells = cells.withColumn(f"_{level}", F.array(*[F.sum(F.get("_narrow", F.lit(i))).over(group) for i in range(size)]))
        cells = cells.withColumn(f"_{level}_k", F.sum("_narrow_k").over(group))
    source = F.when(F.col("_narrow_k") - 1 >= minimum, "narrow").when(F.col("_wide_k") > 1, "wide").otherwise("all")

    def chosen(part: str) -> Column:
        return F.when(source == "narrow", F.col(f"_narrow{part}")).when(source == "wide", F.col(f"_wide{part}")).otherwise(F.col(f"_all{part}"))

    pools = cells.select(wide, narrow, source.alias("prior_source"), chosen("").alias("_pool"), (chosen("_k") - 1).alias("prior_peer_count"))
    others = added(F.col("_pool"), F.col(mix), -1)
    joined = known.join(pools, [wide, narrow]).withColumn("_others", others)
    return joined.withColumn("prior_peer_events", total("_others")).withColumn("prior", smoothed_shares(F.col("_others"), size, pseudocount)).drop("_pool", "_others")


def posterior(mix: Column, prior: Column, strength: float) -> Column:
    """Shares ``(n_k + s * prior_k) / (N + s)``."""
    return bound(total(mix), lambda whole: F.zip_with(mix, prior, lambda n, p: (n + strength * p) / (whole + strength)))


def paired(df: DataFrame, first: str, second: str) -> DataFrame:
    """``df`` with ``place`` (paired, or one_sided where a model has no prediction) and ``gap``, the sum of absolute differences."""
    alone = F.col(first).isNull() | F.col(second).isNull()
    gap = total(F.zip_with(first, second, lambda x, y: F.abs(x - y)))
    return df.withColumns({"place": F.when(alone, "one_sided").otherwise("paired"), "gap": F.when(~alone, gap)})
