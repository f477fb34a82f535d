"""Columns that place a row in a category: ladders, bands, memberships, text groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member(value: Column, family: Sequence[str]) -> Column:
    """Membership that treats an unknown value as not a member."""
    return F.coalesce(value.isin(*family), F.lit(False))


def first_case(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first condition that holds."""
    (condition, label), *rest = cases
    ladder = F.when(condition, F.lit(label))
    for condition, label in rest:
        ladder = ladder.when(condition, F.lit(label))
    return ladder.otherwise(F.lit(otherwise).cast("string"))


def bands(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open bands: ``labels[i]`` below ``edges[i]``, the last label from the last edge up."""
    if len(labels) != len(edges) + 1:
        raise ValueError("bands need one more label than edges")
    ladder = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        ladder = ladder.when(value < edge, F.lit(label))
    return ladder.otherwise(F.lit(labels[-1]))


def map_value(key: Column, values: Mapping[str, float | int | str]) -> Column:
    """Value of a fixed category table; a category outside it gives null for a check to find."""
    pairs = [part for name, value in values.items() for part in (F.lit(name), F.lit(value))]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def with_text_groups(
    df: DataFrame, text: Column, patterns: Sequence[tuple[str, str]], groups: str = "groups", status: str = "status"
) -> DataFrame:
    """Add the distinct matched groups of a narrative and their status; pattern order never decides.

    One distinct group is ``supported``, several are ``ambiguous``, none is ``unsupported`` and
    blank text is ``blank``. The groups are a column of their own so that every pattern runs over the
    text once, however often the result is used.
    """
    hits = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(group)) for pattern, group in patterns]))
    found = df.withColumn(groups, F.array_sort(F.array_distinct(hits)))
    label = (
        F.when(text.isNull() | (F.length(F.trim(text)) == 0), F.lit("blank"))
        .when(F.size(groups) == 1, F.lit("supported"))
        .when(F.size(groups) > 1, F.lit("ambiguous"))
        .otherwise(F.lit("unsupported"))
    )
    return found.withColumn(status, label)
