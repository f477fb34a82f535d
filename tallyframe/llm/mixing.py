"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Tokens are added up by (source, language, topic) cell first, so that what is fitted is one row per cell, however many
documents share it. A margin's values share the budget by their weights; a value that has fewer tokens than its share
keeps all of them and the others of its margin share the rest. These are the margin's allowed tokens.

What is raked is each cell's probability, the share of its documents that is drawn. A sweep takes the margins in turn:
cells at probability one are fixed and the open ones are scaled to what is left of the value's allowed tokens. The sums
of a margin come from a window over the cells, so sweeps follow each other in one plan without joins or broadcasts; some
sweeps are one written table. A document is drawn by a hash of its id with its cell's probability, the same in every run.

The number of sweeps is a parameter, and the fit tells how it ended: ``met`` says of a cell whether the expected tokens of
its source, language and topic are all within ``CLOSE`` of the allowed ones, ``margin_gaps`` lists them, and ``sampled``
logs a warning for each value that stays apart. Targets that cannot be met together keep a gap.

By default a margin's weights are its tokens raised to a power below one, so that small values gain; ``wanted`` gives
explicit ones. The topic is any column expression of the caller, such as the class of a learned assignment; the default
tells rough kinds of text by patterns. Null sources, languages and topics are values of their own. A null text counts as
empty; every document counts one token for its end. Documents with the same id share their draw; with a null id too. An
empty table gives an empty result. Input columns keep their names: the operator's own columns are added only where they
are asked for.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import written

POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET = 0.6  # part of all tokens that the sample shall have
SWEEPS, SWEEPS_A_TABLE = 12, 3
FULL = 1 - 1e-9  # a probability from here on is one, so that rounding does not decide which cells are fixed
CLOSE = 0.01  # a gap between expected and allowed tokens that counts as met
SEED = "mix"
WARNINGS = 20  # values that a warning names
CELLS_TO_BROADCAST = 200_000  # more cells than these are joined by a shuffle
# Topics by the first pattern that the text is like.
TOPICS = [("contact", "%@%.%"), ("licence", "%icens%"), ("table", "% | %"), ("loud", "%!!%"), ("lines", "%\n%\n%\n%")]
OTHER_TOPIC = "prose"


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    found = None
    for name, pattern in topics:
        found = F.when(text.like(pattern), name) if found is None else found.when(text.like(pattern), name)
    return F.lit(OTHER_TOPIC) if found is None else found.otherwise(OTHER_TOPIC)


def tokens_of(text: Column) -> Column:
    """Tokens by the usual four bytes a token, and one for the end."""
    return (F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4) + 1).cast("bigint")


def draw_of(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cells_of(docs: DataFrame, margins: Sequence[str]) -> DataFrame:
    return docs.groupBy(*margins).agg(F.sum("tokens").cast("double").alias("tokens"))


def weights_of(powers: Mapping[str, float], wanted: Mapping[str, Mapping[str | None, float]] | None = None) -> Column:
    """The weight of a row (margin, value, tokens); values that ``wanted`` leaves out of its margin get none."""
    weight = F.lit(0.0)
    for margin, power in powers.items():
        own = F.pow("tokens", F.lit(float(power)))
        if wanted and margin in wanted:
            own = F.lit(0.0)
            for value, share in wanted[margin].items():
                own = F.when(F.col("value").eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(own)
        weight = F.when(F.col("margin") == margin, own).otherwise(weight)
    return weight


def allowed_tokens(cells: DataFrame, powers: Mapping[str, float] = POWERS, budget: float = BUDGET, wanted: Mapping[str, Mapping[str | None, float]] | None = None) -> DataFrame:
    """(margin, value, tokens, target, allowed) for each value of each margin.

    The scale at which weights become tokens solves sum(least(tokens, scale * weight)) = budget. The sum is concave in
    the scale, so the solution is the largest of those of its linear pieces: values with the smallest ratio of tokens to
    weight full, the others open.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")) for m in powers]))
    own = cells.select(each.alias("m"), "tokens").groupBy("m.margin", "m.value").agg(F.sum("tokens").alias("tokens"))
    own = own.withColumn("weight", weights_of(powers, wanted))
    by_ratio = Window.partitionBy("margin").orderBy(F.asc_nulls_last(F.try_divide("tokens", "weight")), "value")
    margin = Window.partitionBy("margin")
    full = F.coalesce(F.sum("tokens").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = own.withColumn("total", F.lit(float(budget)) * F.sum("tokens").over(margin)).withColumn("whole", F.sum("weight").over(margin))
    own = own.withColumn("piece", F.try_divide(F.col("total") - full, open_weight))
    own = own.withColumn("scale", F.coalesce(F.max("piece").over(margin), F.lit(0.0)))
    target = F.coalesce(F.col("weight") * F.try_divide("total", "whole"), F.lit(0.0))
    return own.select("margin", "value", "tokens", target.alias("target"), F.least("tokens", F.col("scale") * F.col("weight")).alias("allowed"))


def rake(cells: DataFrame, allowed: DataFrame, margins: Sequence[str], budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with ``probability``, ``allowed_<margin>``, ``gap_<margin>`` (expected over allowed tokens, less one) and ``met``."""
    for margin in margins:
        own = allowed.where(F.col("margin") == margin).select(F.col("value").alias("k"), F.col("allowed").alias(f"allowed_{margin}"))
        cells = cells.join(own, F.col(margin).cast("string").eqNullSafe(F.col("k"))).drop("k")
    fitted = written(cells.withColumn("probability", F.lit(min(float(budget), 1.0))), "raked")
    expected = F.col("probability") * F.col("tokens")
    is_full = F.col("probability") >= FULL
    for sweep in range(sweeps):
        for margin in margins:
            same = Window.partitionBy(margin)
            fitted = fitted.withColumn("full", F.sum(F.when(is_full, expected).otherwise(0.0)).over(same)).withColumn("open", F.sum(F.when(is_full, 0.0).otherwise(expected)).over(same))
            left = F.col(f"allowed_{margin}") - F.col("full")
            opened = F.coalesce(F.col("probability") * F.try_divide(left, F.col("open")), F.lit(0.0))
            opened = F.when(opened >= FULL, F.lit(1.0)).otherwise(opened)
            shrunk = F.coalesce(F.col("probability") * F.try_divide(F.col(f"allowed_{margin}"), F.col("full") + F.col("open")), F.lit(0.0))
            fitted = fitted.withColumn("probability", F.when(left < 0, shrunk).when(is_full, F.lit(1.0)).otherwise(opened)).drop("full", "open")
        if (sweep + 1) % SWEEPS_A_TABLE == 0 and sweep + 1 < sweeps:
            fitted = written(fitted, "raked")
    met = F.lit(True)
    for margin in margins:
        fitted = fitted.withColumn(f"gap_{margin}", F.coalesce(F.try_divide(F.sum(expected).over(Window.partitionBy(margin)), F.col(f"allowed_{margin}")) - 1, F.lit(0.0)))
        met = met & (F.abs(F.col(f"gap_{margin}")) <= CLOSE)
    return written(fitted.withColumn("met", met), "raked")


def margin_gaps(fitted: DataFrame, margins: Sequence[str], close: float = 0.0) -> DataFrame:
    """(margin, value, allowed, gap) for each value of each margin of ``rake`` whose gap is ``close`` or more."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), F.col(f"allowed_{m}").alias("allowed"), F.col(f"gap_{m}").alias("gap")) for m in margins]))
    return fitted.select(each.alias("m")).select("m.*").groupBy("margin", "value").agg(F.first("allowed").alias("allowed"), F.first("gap").alias("gap")).where(F.abs(F.col("gap")) >= close)


def fitted_cells(
    docs: DataFrame, powers: Mapping[str, float] = POWERS, budget: float = BUDGET, sweeps: int = SWEEPS, wanted: Mapping[str, Mapping[str | None, float]] | None = None, topic: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """All columns of ``docs`` in a struct ``doc`` with margins and tokens, and the fitted cells."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), (topic_of(F.col("text")) if topic is None else topic).alias("topic"))
    row = row.select("doc", F.col("doc.source").alias("source"), F.col("doc.lang").alias("lang"), "topic", tokens_of(F.col("doc.text")).alias("tokens"))
    cells = written(cells_of(row, list(powers)), "cells")
    return row, rake(cells, written(allowed_tokens(cells, powers, budget, wanted), "allowed"), list(powers), budget, sweeps)


def drawn_by(row: DataFrame, fitted: DataFrame, margins: Sequence[str], budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """``row`` with probability, ratio (of the probability to the budget), met and drawn."""
    share = fitted.select(*[F.col(m).alias(f"k_{m}") for m in margins], "probability", (F.col("probability") / F.lit(float(budget))).alias("ratio"), "met")
    if share.count() <= CELLS_TO_BROADCAST:
        share = F.broadcast(share)
    on = None
    for m in margins:
        same = F.col(m).eqNullSafe(F.col(f"k_{m}"))
        on = same if on is None else on & same
    return row.join(share, on).withColumn("drawn", draw_of(F.col("doc.doc_id"), seed) < F.col("probability")).drop(*[f"k_{m}" for m in margins])


def mixed(
    docs: DataFrame,
    powers: Mapping[str, float] = POWERS,
    budget: float = BUDGET,
    sweeps: int = SWEEPS,
    seed: str = SEED,
    wanted: Mapping[str, Mapping[str | None, float]] | None = None,
    topic: Column | None = None,
) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc`` with source, lang, topic, tokens, probability, ratio, met and drawn.

    ``wanted`` maps a margin to the weights of its values, in place of its power; ``topic`` is an expression over the
    columns of ``docs``, by default the first of ``TOPICS`` whose pattern the text is like.
    """
    row, fitted = fitted_cells(docs, powers, budget, sweeps, wanted, topic)
    return drawn_by(row, fitted, list(powers), budget, seed)


def sampled(
    docs: DataFrame,
    powers: Mapping[str, float] = POWERS,
    budget: float = BUDGET,
    sweeps: int = SWEEPS,
    wanted: Mapping[str, Mapping[str | None, float]] | None = None,
    topic: Column | None = None,
) -> DataFrame:
    """The drawn rows, with the columns that ``docs`` has; values whose margin is not met are logged."""
    row, fitted = fitted_cells(docs, powers, budget, sweeps, wanted, topic)
    for gap in margin_gaps(fitted, list(powers), CLOSE).orderBy(F.desc(F.abs(F.col("gap")))).limit(WARNINGS).collect():
        logging.getLogger(__name__).warning("mixing: %s %r has %+.1f %% of its allowed %.0f tokens", gap["margin"], gap["value"], 100 * gap["gap"], gap["allowed"])
    return drawn_by(row, fitted, list(powers), budget).where("drawn").select("doc.*")


def mixing_sql(powers: Mapping[str, float] = POWERS, budget: float = BUDGET, sweeps: int = SWEEPS, seed: str = SEED) -> str:
    """The same rows in SQL, every step of the fit written out."""
    quoted = [(name, pattern.replace("'", "''")) for name, pattern in TOPICS]
    topic = "case " + " ".join(f"when text like '{p}' then '{n}'" for n, p in quoted) + f" else '{OTHER_TOPIC}' end"
    own = " union all ".join(f"select '{m}' as margin, {m} as value, sum(tokens) as tokens, pow(sum(tokens), {power}) as weight from cells group by {m}" for m, power in powers.items())
    parts = [
        f"d as (select doc_id, source, lang, {topic} as topic, (strlen(coalesce(text, '')) // 4 + 1)::bigint as tokens from documents)",
        "cells as materialized (select source, lang, topic, sum(tokens)::double as tokens from d group by all)",
        f"own as materialized ({own})",
        f"""piece as materialized (
  select *, ({budget} * sum(tokens) over (partition by margin) - coalesce(sum(tokens) over (o rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (o rows between current row and unbounded following) as piece
  from own window o as (partition by margin order by tokens / weight, value))""",
        "allowed as materialized (select margin, value, least(tokens, weight * max(piece) over (partition by margin)) as allowed from piece)",
    ]
    joins = " ".join(f"join allowed a_{m} on a_{m}.margin = '{m}' and a_{m}.value is not distinct from c.{m}" for m in powers)
    parts.append(f"w0 as materialized (select c.*, {', '.join(f'a_{m}.allowed as allowed_{m}' for m in powers)}, {min(budget, 1.0)}::double as p from cells c {joins})")
    step = 0
    for _ in range(sweeps):
        for margin in powers:
            sums = f"sum(case when p >= {FULL} then p * tokens else 0 end) over (partition by {margin}) as full_t, sum(case when p >= {FULL} then 0 else p * tokens end) over (partition by {margin}) as open_t"
            allowed = f"allowed_{margin}"
            opened = f"coalesce(p * (({allowed} - full_t) / nullif(open_t, 0)), 0)"
            new = f"case when {allowed} < full_t then coalesce(p * ({allowed} / nullif(full_t + open_t, 0)), 0) when p >= {FULL} or {opened} >= {FULL} then 1 else {opened} end"
            parts.append(f"w{step + 1} as materialized (select * exclude (full_t, open_t) replace ({new} as p) from (select *, {sums} from w{step}))")
            step += 1
    near = " and ".join(f"coalesce(abs(sum(p * tokens) over (partition by {m}) / nullif(allowed_{m}, 0) - 1), 0) <= {CLOSE}" for m in powers)
    parts.append(f"f as materialized (select source, lang, topic, p as probability, p / {budget} as ratio, {near} as met from w{step})")
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint::double / 4294967296.0"
    return (
        "with " + ",\n".join(parts) + f"\nselect d.doc_id, d.source, d.lang, d.topic, d.tokens, round(f.ratio, 6) as weight, round(f.probability, 6) as probability, f.met, {draw} < f.probability as drawn "
        "from d join f on d.source is not distinct from f.source and d.lang is not distinct from f.lang and d.topic = f.topic"
    )
