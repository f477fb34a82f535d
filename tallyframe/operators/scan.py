"""Ordered per-key calculations that never gather one key into one task.

A running total, row index, or previous-row lookup over a key needs its rows in order. Handing a
whole key to one window task breaks once a single key holds a large part of the data, so every
function here works in two levels. Rows are grouped by key *and slice*, where a slice is a value
that never decreases along the order (a quarter hour, a month, an id range). The first level runs
an ordinary window inside each slice. The second level runs over one summary row per slice and
hands each slice what came before it.

``time_slice`` and ``balanced_slices`` derive slices from the data and keep the plan lazy; the latter
also evens out days with very different numbers of rows.
``range_slices`` is for orders with no natural slice (ranking by a measure): it range-partitions
the rows, which splits ties too when the order ends in a unique column, and checkpoints the result
so that slice numbers stay the same when a lost executor's work is redone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import checkpointed

SLICE = "_slice"
SLICES_A_PARTITION, MOST_CUTS = 16, 4096  # balanced slices: enough that a partition's share of them evens out


def time_slice(moment: str | Column, minutes: int = 15) -> Column:
    """Number of the ``minutes``-long span a zone-less or zoned moment falls in."""
    at = F.col(moment) if isinstance(moment, str) else moment
    per_day = 1440 // minutes
    day = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("bigint")
    within = F.floor((F.hour(at) * 60 + F.minute(at)) / F.lit(minutes))
    return day * per_day + within


def balanced_slices(df: DataFrame, day: str, identifier: str, slices: int | None = None) -> DataFrame:
    """Add slices for the order (day, id) that hold about the same number of rows each, however the days differ.

    One aggregate per day counts its rows and sketches the distribution of their ids. A day is cut at
    its sketched quantiles into as many slices as its share of all rows asks for, so a day with nearly
    all rows is spread and a day with few is one slice. A row finds its slice by binary search.
    Everything is derived in the plan; nothing runs ahead of it.
    """
    wanted = slices or SLICES_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = max(1, min(MOST_CUTS, wanted) - 1).bit_length()
    parts = 1 << steps
    at = F.to_date(day)
    cuts = F.percentile_approx(identifier, [i / parts for i in range(1, parts)], 10 * parts)
    days = df.groupBy(at.alias("_day")).agg(F.count("*").alias("_rows"), cuts.alias("_cuts"))
    # One row per calendar day.
    share = F.col("_rows") / F.sum("_rows").over(Window.partitionBy())
    days = days.select("_day", "_cuts", F.ceil(parts / F.least(F.lit(parts), F.ceil(share * parts))).alias("_each"))
    placed = df.join(days, at.eqNullSafe(F.col("_day")), "left").withColumn("_cut", F.lit(0))
    for step in reversed(range(steps)):
        above = F.get("_cuts", F.col("_cut") + ((1 << step) - 1)) < F.col(identifier)
        placed = placed.withColumn("_cut", F.col("_cut") + F.when(above, 1 << step).otherwise(0))
    return placed.withColumn(SLICE, F.struct(F.col("_day").alias("day"), F.floor(F.col("_cut") / F.col("_each")).alias("part"))).drop("_day", "_cuts", "_each", "_cut")


def range_slices(df: DataFrame, order: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """Add a slice number that follows ``order``; slices are even even when one value is common."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(count, *order).withColumn(SLICE, F.spark_partition_id().cast("bigint"))
    return checkpointed(placed)


def _match(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on key columns.

    Plain equality keeps the hash partitioning of the window below it, so the rows are not shuffled
    a second time.
    """
    return left.join(right, list(names), "left")


# A value of each key type that stands in for null next to a flag saying so.
_STAND_IN = {"string": "", "boolean": "false", "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _null_free(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """(frame with null-free key columns, their names, columns that restore the original keys).

    Null keys form a group of their own, as they do in a plain window. Null-free keys also keep both
    levels of a scan identical below their first shuffle, since a join on them adds no null filter.
    """
    kinds = dict(df.dtypes)
    columns, names, restored = {}, [], []
    for k in keys:
        stand_in = F.lit(_STAND_IN.get(kinds[k], "0")).cast(kinds[k])
        columns[f"_k_{k}"] = F.coalesce(F.col(k), stand_in)
        columns[f"_null_{k}"] = F.col(k).isNull()
        names += [f"_k_{k}", f"_null_{k}"]
        restored.append(F.when(~F.col(f"_null_{k}"), F.col(f"_k_{k}")).alias(k))
    return df.withColumns(columns) if columns else df, names, restored


_REDUCE = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.least(carried, local) if kind == "min" else F.greatest(carried, local)


Folds = dict[str, tuple[str, Column]]


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    slice_by: Column | str,
    *,
    upto: Folds | None = None,
    before: Folds | None = None,
    whole: Folds | None = None,
    prior: dict[str, Column] | None = None,
    final: dict[str, Column] | None = None,
    last: str | None = None,
    outer: Sequence[str] = (),
    outer_before: Folds | None = None,
) -> DataFrame:
    """Add ordered columns over each key, sharing one shuffle of the rows.

    ``upto``, ``before`` and ``whole`` map a name to (sum | min | max, expression): the value over
    the rows up to and including the current one, strictly before it, or of the whole key. A sum
    over no rows is 0, a minimum or maximum null. ``prior`` and ``final`` map a name to the value an
    expression has on the preceding row and on the key's last row; ``last`` names a flag for that
    last row. The order must be total within a key.

    ``outer`` names some of the keys, those of a wider group that the order runs through one key after
    another: ``outer_before`` folds do not start again with each key but with each wider group. Their
    carry is a third level over the same slice summaries.

    Slices are summarised by an aggregate when only folds are asked for. Otherwise the summary is
    the last row of each slice, which reads the shuffle of the first level a second time instead of
    scanning the source again.
    """
    upto, before, whole, prior, final, nested = upto or {}, before or {}, whole or {}, prior or {}, final or {}, outer_before or {}
    folds = {**upto, **before, **whole, **nested}
    at = [F.struct(*order).alias("_at")] if nested else []
    tails = {**prior, **final}
    kept = [c for c in df.columns if c != SLICE]
    base = df.withColumn(SLICE, F.col(slice_by) if isinstance(slice_by, str) else slice_by)
    if dict(base.dtypes)[SLICE] in ("int", "bigint"):
        # Rows without an order value come first in the order, so they get the smallest slice.
        base = base.withColumn(SLICE, F.coalesce(F.col(SLICE).cast("bigint"), F.lit(-(2**63))))
    base, by, restored = _null_free(base, keys)

    inside = Window.partitionBy(*by, SLICE).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ends_slice = F.lead(F.lit(1)).over(inside).isNull()
    if tails or last:
        totals = [_REDUCE[k](e).over(so_far).alias(f"_tot_{n}") for n, (k, e) in folds.items()]
        ends = base.select("*", *totals, ends_slice.alias("_ends")).where("_ends")
        summary = ends.select(*by, SLICE, *[f"_tot_{n}" for n in folds], *[e.alias(f"_tail_{n}") for n, e in tails.items()], *at)
    else:
        summary = base.groupBy(*by, SLICE).agg(*[_REDUCE[k](e).alias(f"_tot_{n}") for n, (k, e) in folds.items()], *[F.max(a).alias("_at") for a in at])

    slices = Window.partitionBy(*by).orderBy(SLICE)
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    everything = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wider = [name for k in outer for name in (f"_k_{k}", f"_null_{k}")]
    earlier_keys = Window.partitionBy(*wider).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    across = summary.select(
        *by,
        SLICE,
        *[_REDUCE[k](f"_tot_{n}").over(earlier).alias(f"_pre_{n}") for n, (k, _) in {**upto, **before}.items()],
        *[_REDUCE[k](f"_tot_{n}").over(everything).alias(f"_all_{n}") for n, (k, _) in whole.items()],
        *[_REDUCE[k](f"_tot_{n}").over(earlier_keys).alias(f"_pre_{n}") for n, (k, _) in nested.items()],
        *[F.lag(f"_tail_{n}").over(slices).alias(f"_carried_{n}") for n in prior],
        *[F.last(f"_tail_{n}").over(everything).alias(f"_final_{n}") for n in final],
        *([F.lead(F.lit(1)).over(slices).isNull().alias("_last_slice")] if last else []),
    )
    local = base.select(
        *[c for c in kept if c not in keys],
        SLICE,
        *by,
        *[_REDUCE[k](e).over(so_far).alias(f"_loc_{n}") for n, (k, e) in upto.items()],
        *[_REDUCE[k](e).over(so_far_before).alias(f"_loc_{n}") for n, (k, e) in {**before, **nested}.items()],
        *[F.lag(e).over(inside).alias(f"_seen_{n}") for n, e in prior.items()],
        *([(F.row_number().over(inside) == 1).alias("_starts")] if prior else []),
        *([ends_slice.alias("_ends")] if last else []),
    )
    originals = dict(zip(keys, restored))
    return _match(local, across, [*by, SLICE]).select(
        *[originals.get(c, F.col(c)) for c in kept],
        *[_combine(k, F.col(f"_pre_{n}"), F.col(f"_loc_{n}")).alias(n) for n, (k, _) in {**upto, **before, **nested}.items()],
        *[F.col(f"_all_{n}").alias(n) for n in whole],
        *[F.when(F.col("_starts"), F.col(f"_carried_{n}")).otherwise(F.col(f"_seen_{n}")).alias(n) for n in prior],
        *[F.col(f"_final_{n}").alias(n) for n in final],
        *([(F.col("_ends") & F.col("_last_slice")).alias(last)] if last else []),
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    slice_by: Column | str,
    measures: Folds,
    *,
    include_current: bool = True,
) -> DataFrame:
    if include_current:
        return ordered(df, keys, order, slice_by, upto=measures)
    return ordered(df, keys, order, slice_by, before=measures)


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_by: Column | str, name: str = "row_index"
) -> DataFrame:
    """1-based position of each row of a key under ``order`` (which must be total)."""
    return ordered(df, keys, order, slice_by, upto={name: ("sum", F.lit(1).cast("bigint"))})


def group_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach whole-key aggregates to each row by aggregate-and-join.

    An unordered window would sort a whole key in one task; the aggregate combines on the map side
    and the join back can be split by adaptive skew handling.
    """
    summary = df.groupBy(*keys).agg(*[e.alias(n) for n, e in totals.items()])
    return _match(df, summary, list(keys))


def ordered_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based rank of every row under a total order of the whole table."""
    placed = range_slices(df, order)
    return row_index(placed, [], order, SLICE, name)
