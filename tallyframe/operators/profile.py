"""Aggregations: coverage, shares, weighted means, leave-one-out rates, quantiles, correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import lookup, scan


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def cell_stats(df: DataFrame, cells: Sequence[str], value: str) -> DataFrame:
    """Occurrences, mean, sample deviation and standard error of a value in each cell."""
    stats = df.groupBy(*cells).agg(
        F.count(value).alias("occurrence_count"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("sd_value"),
    )
    return stats.withColumn("se_value", F.col("sd_value") / F.sqrt(F.col("occurrence_count")))


def coverage(df: DataFrame, cells: Sequence[str], evidence: Column) -> DataFrame:
    """Rows, rows with evidence, rows without, and the covered share of each cell."""
    found = F.count_if(evidence.isNotNull())
    return df.groupBy(*cells).agg(
        F.count("*").alias("row_count"),
        found.alias("present_count"),
        (F.count("*") - found).alias("missing_count"),
        (found / F.count("*")).alias("coverage_rate"),
    )


def shares(df: DataFrame, keys: Sequence[str], category: str, amount: Column, name: str = "share") -> DataFrame:
    """Amount per key and category with its share of the key's total.

    Rows are aggregated first, so the share is taken over at most one row per category.
    """
    cells = df.groupBy(*keys, category).agg(F.sum(amount).alias("amount"))
    whole = Window.partitionBy(*keys)
    return cells.withColumn(name, F.col("amount") / F.sum("amount").over(whole))


def leave_one_out(
    df: DataFrame, entity: Sequence[str], group: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Per entity within group: its own totals and the group's totals without it.

    Output: ``<m>`` (own) and ``others_<m>`` for each measure.
    """
    own = df.groupBy(*entity, *group).agg(*[F.sum(e).alias(m) for m, e in measures.items()])
    whole = own.groupBy(*group).agg(*[F.sum(m).alias(f"_all_{m}") for m in measures])
    joined = own.join(whole, list(group), "left") if group else own
    return joined.select(
        *entity, *group, *measures, *[(F.col(f"_all_{m}") - F.col(m)).alias(f"others_{m}") for m in measures]
    )


# Exact selection: accuracy of the sketch that gives the brackets, how far a bracket reaches beyond a point (both as
# parts of the rows), the number of rows up to which a group is its own bracket, and the parts that the rows of larger
# groups are dealt to.
SKETCH_ACCURACY, REACH, FEW_ROWS, DEALT = 20_000, 1 / 4_000, 10_000, 64


def _brackets(known: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Per key its rows and the values between which each point's rows must lie: an array of (point, position, from, to)."""
    ends = [min(max(float(p) + side * REACH, 0.0), 1.0) for p in points for side in (-1, 1)]
    sizes = known.groupBy(*keys).agg(
        F.count("*").alias("_size"), F.min(value).alias("_least"), F.max(value).alias("_most"), F.percentile_approx(value, ends, SKETCH_ACCURACY).alias("_ends")
    )
    few = F.col("_size") <= FEW_ROWS
    cells = []
    for i, p in enumerate(points):
        position = F.lit(float(p)) * (F.col("_size") - 1)
        cells.append(
            F.struct(
                F.lit(float(p)).alias("_point"),
                position.alias("_position"),
                F.when(few, F.col("_least")).otherwise(F.get("_ends", F.lit(2 * i))).alias("_from"),
                F.when(few, F.col("_most")).otherwise(F.get("_ends", F.lit(2 * i + 1))).alias("_to"),
            )
        )
    return sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_size", F.array(*cells).alias("_brackets"))


def _with_brackets(known: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Rows with the brackets of their group, null for a small group."""
    brackets = _brackets(known, keys, "_value", points)
    if not keys:
        return known.withColumn("_brackets", brackets.select("_brackets").scalar())
    large = brackets.where(F.col("_size") > FEW_ROWS).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = known.withColumn("_deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(DEALT)).cast("int"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return dealt.join(large, [*same, F.col("_deal") == F.col("_part")], "left")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles in long form: keys, point, quantile.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here a quantile
    sketch brackets each point; rows below a bracket are only counted, and those inside, a small part
    of a large group, are combined by value and accumulated. The counts prove the result: a position
    that no value inside its bracket covers raises an error instead of giving a neighbour.

    Rows meet the bracket of a large group in ``DEALT`` parts, so a group with most rows is not one task; large
    groups are few, so their copies are. A small group needs no bracket: its position follows from its counts.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    placed = _with_brackets(known, keys, points)
    kind = known.schema["_value"].dataType
    whole = [(F.lit(float(p)).alias("_point"), F.lit(None).cast("double").alias("_position"), F.lit(None).cast(kind).alias("_from"), F.lit(None).cast(kind).alias("_to")) for p in points]
    own = F.coalesce("_brackets", F.array(*[F.struct(*cell) for cell in whole]))
    reached = F.filter(own, lambda b: b["_to"].isNull() | (F.col("_value") <= b["_to"]))
    each = placed.select(*keys, "_value", F.inline(reached))
    inside = F.when(F.col("_from").isNull() | (F.col("_value") >= F.col("_from")), F.col("_value"))  # null stands for all values below
    counts = each.groupBy(*keys, "_point", "_position", inside.alias("_inside")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys, "_point", "_position")
    upto = F.sum("_n").over(group.orderBy(F.asc_nulls_first("_inside")))
    small = F.col("_point") * (F.sum("_n").over(group) - 1)
    ranked = counts.withColumns({"_upto": upto, "_small": small}).withColumn("_first", F.col("_upto") - F.col("_n"))
    ranked = ranked.withColumn("_position", F.coalesce("_position", "_small")).drop("_small")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_upto")), F.col("_inside")))

    low, high = F.floor("_position"), F.ceil("_position")
    found = ranked.groupBy(*keys, "_point", "_position").agg(at(low).alias("_a"), at(high).alias("_b"))
    proven = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    interpolated = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_position") - F.floor("_position"))
    return found.select(*keys, F.col("_point").alias("point"), proven.otherwise(interpolated).alias("quantile"))


def average_ranks(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average (mid) rank of a measure within ``keys`` (or the whole table): the rank before ties plus (ties+1)/2."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    placed = scan.range_slices(counts, [*keys, column])
    upto = scan.running(placed, keys, [column], scan.SLICE, {"_upto": ("sum", F.col("_n"))})
    ranks = upto.select(*keys, column, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, column], "left")


def rank_correlation(df: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman's correlation within ``keys`` (or over all rows): Pearson over average ranks."""
    ranked = average_ranks(average_ranks(df, left, "_left_rank", keys), right, "_right_rank", keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("row_count"), F.corr("_left_rank", "_right_rank").alias("rank_correlation"))


def less_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the overall mean of each column taken off it, by a scalar subquery.

    Slopes stay the same, and sums of squares and products of columns far from zero keep their digits.
    """
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    shifted = {c: F.col(c) - F.col(f"_mean_{c}") for c in columns}
    return lookup.attach_total(df, means).select(*[shifted[c].alias(c) if c in shifted else F.col(c) for c in df.columns])


def weighted_line(x: Column, y: Column, w: Column) -> tuple[Column, Column]:
    """(slope, intercept) of a weighted least-squares line, from one pass of moments.

    Give columns far from zero through ``less_means``; the intercept is then that of the shifted line.
    """
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxx, sxy = F.sum(w * x * x), F.sum(w * x * y)
    slope = F.try_divide(sw * sxy - sx * sy, sw * sxx - sx * sx)
    return slope, F.try_divide(sy - slope * sx, sw)


def origin_slope(x: Column, y: Column) -> Column:
    """Least-squares slope of a line through the origin."""
    return F.try_divide(F.sum(x * y), F.sum(x * x))


def argmax(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """The fields of each key's largest row under ``order``, combined on the map side."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{f}") for f in fields])


def z_scores(df: DataFrame, cells: Sequence[str], value: str, minimum: int, name: str = "z") -> DataFrame:
    """Population z-score inside each cell; null below ``minimum`` rows or without spread."""
    with_stats = scan.group_totals(
        df, cells, _n=F.count(value), _mean=F.avg(value), _sd=F.stddev_pop(value)
    )
    usable = (F.col("_n") >= minimum) & (F.col("_sd") > 1e-12)
    return with_stats.withColumn(name, F.when(usable, (F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_n", "_mean", "_sd")
