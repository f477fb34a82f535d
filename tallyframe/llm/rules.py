"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source in place of fixed cutoffs.

Counts of whole texts are worked out in tasks. A text that fails the base rule (too few words, or mostly repeated ones)
is out. The others form, in each group of language and source, one quantile sketch per feature: a value is a whole
number of thousandths, rounded down to its first eight binary digits, and the sketch is the count of each rounded value.
So a sketch errs by less than one part in 128, adding counts merges two sketches exactly, in any order and on the map
side, and its size is bounded by the digits, not by the rows. The source sketches of a language add up to that of the
language, and these to one of all documents; a group with few documents takes the first of these that has enough.

A group's limits are its quartiles, moved outwards by ``REACH`` times their distance (at least the feature's own least
distance, since a feature that is zero nearly everywhere has no spread). A join brings each document its group's limits.

Null and empty texts have no words and fail the base rule. Null languages and sources are values of their own. Repeated
rows each get their verdict and each count. Ids are passed through, null ones too. Other columns of the input are not
read and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import written

LEAST_WORDS, MOST_REPEATED = 50, 50  # the base rule: words, and repeated words in a hundred
SYMBOLS = "#*$%&|<>"
DIGITS = 8  # binary digits that a sketch keeps of a value
REACH = 5  # quartile distances beyond the quartiles at which a limit lies
ENOUGH = 200  # documents that a sketch needs to stand for itself
GROUPS_TO_BROADCAST = 100_000  # more groups than these are joined by a shuffle
# Feature: what is divided by what (in thousandths; a few lines without fault are added, or one in three would be much),
# the least quartile distance, whether low values are out as well.
FEATURES = {
    "word_length": ("word_chars", "n_words", 80, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "repeated_lines": ("n_dup_lines", "n_lines + 4", 60, False),
    "repeated_words": ("n_repeat_words", "n_words", 70, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], dtype=np.int64)
    # Pairs are numbered anew before the third word is added, so a key is never longer than two numbers.
    _, pairs = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)
    _, windows, times = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[windows] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for place in range(3):
        inside[place : place + len(again)] |= again
    return int(inside.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text; a word is a run without blanks, tabs and line ends of ASCII."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    characters = len(text) - sum(text.count(blank) for blank in " \t\n\v\f\r")
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), characters, sum(text.count(c) for c in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def counted(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` as a struct ``doc``, its lang and source, and ``COUNTS`` of its text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    row = row.select("doc", F.col("doc.lang").cast("string").alias("lang"), F.col("doc.source").cast("string").alias("source"))
    place, names = docs.columns.index("text"), [*row.columns, *COUNTS]
    schema = T.StructType([*row.schema.fields, *[T.StructField(name, T.LongType()) for name in COUNTS]])

    def run(batches):
        for batch in batches:
            found = [counts_of(text.as_py()) for text in batch.column(0).field(place)]
            added = [pa.array([one[i] for one in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    return row.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def thousandths(feature: str) -> Column:
    above, below, _, _ = FEATURES[feature]
    return F.expr(f"1000 * {above} div greatest({below}, 1)")


def rounded(value: str) -> Column:
    """A whole number with all but its first ``DIGITS`` binary digits set to zero."""
    shift = f"greatest(length(bin({value})) - {DIGITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, feature, value, n): the sketch of each group's documents that pass the base rule."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), thousandths(name).alias("exact")) for name in FEATURES]))
    long = rows.where(~base_failed()).select("lang", "source", each.alias("f")).select("lang", "source", "f.feature", "f.exact")
    return long.groupBy("lang", "source", "feature", rounded("exact").alias("value")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """The sketches of sources (level 0), their sums by language (1) and the sum of all (2); what is summed over is null."""
    none = F.lit(None).cast("string")
    by_lang = sketch.groupBy("lang", "feature", "value").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    out = sketch.select(F.lit(0).alias("level"), "lang", "source", "feature", "value", "n")
    out = out.unionByName(by_lang.select(F.lit(1).alias("level"), "lang", none.alias("source"), "feature", "value", "n"))
    return out.unionByName(by_all.select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "feature", "value", "n"))


def limits(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, documents, low_<feature>, high_<feature>) for each sketch of ``merged``."""
    group = ["level", "lang", "source", "feature"]
    so_far = F.sum("n").over(Window.partitionBy(*group).orderBy("value"))  # a bounded number of values
    whole = F.sum("n").over(Window.partitionBy(*group))
    ranked = merged(sketch).select(*group, "value", so_far.alias("so_far"), whole.alias("documents"))
    quartile = {q: F.min(F.when(4 * F.col("so_far") >= q * F.col("documents"), F.col("value"))) for q in (1, 3)}
    own = ranked.groupBy(*group).agg(F.max("documents").alias("documents"), quartile[1].alias("q1"), quartile[3].alias("q3"))
    columns = []
    for name, (_, _, least, both) in FEATURES.items():
        reach = F.lit(REACH) * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = F.col("feature") == name
        columns.append(F.max(F.when(mine, F.col("q1") - reach if both else F.lit(0))).alias(f"low_{name}"))
        columns.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"high_{name}"))
    return own.groupBy("level", "lang", "source").agg(F.max("documents").alias("documents"), *columns)


def group_limits(sketch: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(k_lang, k_source, level, low_*, high_*): for each group the limits of the first level with enough documents."""
    every = written(limits(sketch), "limits")
    groups = every.where("level = 0").select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), F.col("documents").alias("own"))
    langs = every.where("level = 1").select(F.col("lang").alias("l_lang"), F.col("documents").alias("in_lang"))
    groups = groups.join(langs, F.col("k_lang").eqNullSafe(F.col("l_lang"))).drop("l_lang")
    level = F.when(F.col("own") >= enough, 0).when(F.col("in_lang") >= enough, 1).otherwise(2)
    groups = groups.withColumn("k_level", level)
    lang, source = F.when(F.col("k_level") < 2, F.col("k_lang")), F.when(F.col("k_level") < 1, F.col("k_source"))
    same = (F.col("k_level") == F.col("level")) & lang.eqNullSafe(F.col("lang")) & source.eqNullSafe(F.col("source"))
    bounds = [f"{side}_{name}" for name in FEATURES for side in ("low", "high")]
    return groups.join(every, same).select("k_lang", "k_source", "level", *bounds)


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` of ``counted`` with base_failed, kept and ``faults``, the features outside their group's limits."""
    bounds = written(bounds, "group-limits")
    if bounds.count() <= GROUPS_TO_BROADCAST:
        bounds = F.broadcast(bounds)
    same = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    joined = rows.withColumn("base_failed", base_failed()).join(bounds, same, "left")
    outside = [F.when(~F.col("base_failed") & ~thousandths(name).between(F.col(f"low_{name}"), F.col(f"high_{name}")), name) for name in FEATURES]
    faults = F.array_compact(F.array(*outside))
    return joined.select(*rows.columns, "base_failed", faults.alias("faults"), (~F.col("base_failed") & (F.size(faults) == 0)).alias("kept"))


def verdicts(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, counts, base_failed, kept, faults) of each document; the texts are read once."""
    rows = written(counted(docs.select("doc_id", "text", "lang", "source")).select("doc.doc_id", "lang", "source", *COUNTS), "counts")
    return judged(rows, group_limits(written(sketches(rows), "sketches"), enough))


def accepted(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns that ``docs`` has."""
    rows = counted(docs)
    bounds = group_limits(written(sketches(rows.drop("doc")), "sketches"), enough)
    return judged(rows, bounds).where("kept").select("doc.*")


def rules_sql() -> str:
    """The verdicts in SQL."""
    word = r"[^\x20\x09-\x0D]+"
    value = {name: f"(1000 * {above} // greatest({below}, 1))" for name, (above, below, _, _) in FEATURES.items()}
    shift = f"greatest(length(bin(exact)) - {DIGITS}, 0)::int"
    long = " union all ".join(f"select lang, source, '{name}' as feature, {v} as exact from b where not base_failed" for name, v in value.items())
    bounds, inside = [], []
    for name, (_, _, least, both) in FEATURES.items():
        low = f"q1 - {REACH} * greatest(q3 - q1, {least})" if both else "0"
        bounds.append(f"max(case when feature = '{name}' then {low} end) as low_{name}, max(case when feature = '{name}' then q3 + {REACH} * greatest(q3 - q1, {least}) end) as high_{name}")
        inside.append(f"{value[name]} between low_{name} and high_{name}")
    return f"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select r, unnest(words) as word, generate_subscripts(words, 1) as p from (select r, regexp_extract_all(text, '{word}') as words from d)),
t as (select r, p, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram from w window o as (partition by r order by p)),
again as (select r, gram from t where gram is not null group by all having count(*) > 1),
inside as (select distinct r, p + i as p from t join again using (r, gram), unnest([0, 1, 2]) u(i)),
l as (select r, line, count(*) as n from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{word}') group by all),
c as (
  select d.*, coalesce(nw, 0) as n_words, coalesce(wc, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(nl, 0) as n_lines, coalesce(dl, 0) as n_dup_lines, coalesce(rw, 0) as n_repeat_words
  from d left join (select r, count(*) as nw, sum(length(word))::bigint as wc from w group by r) using (r)
  left join (select r, sum(n)::bigint as nl, sum(n - 1)::bigint as dl from l group by r) using (r)
  left join (select r, count(*) as rw from inside group by r) using (r)
), b as (select * exclude (text), n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from c),
s as (select lang, source, feature, (exact >> ({shift})) << ({shift}) as value, count(*) as n from ({long}) group by all),
m as (
  select 0 as level, * from s
  union all select 1, lang, null, feature, value, sum(n) from s group by all
  union all select 2, null, null, feature, value, sum(n) from s group by all
), k as (select level, lang, source, feature, value, sum(n) over (partition by level, lang, source, feature order by value) as so_far, sum(n) over (partition by level, lang, source, feature) as documents from m),
q as (
  select level, lang, source, feature, max(documents) as documents, min(case when 4 * so_far >= documents then value end) as q1, min(case when 4 * so_far >= 3 * documents then value end) as q3
  from k group by all
), f as (select level, lang, source, max(documents) as documents, {", ".join(bounds)} from q group by all),
g as (
  select x.lang as k_lang, x.source as k_source, case when x.documents >= {ENOUGH} then 0 when y.documents >= {ENOUGH} then 1 else 2 end as k_level
  from f x join f y on x.lang is not distinct from y.lang and x.level = 0 and y.level = 1
), h as (
  select k_lang, k_source, f.* exclude (lang, source) from g join f on k_level = level
    and (k_level = 2 or k_lang is not distinct from lang) and (k_level > 0 or k_source is not distinct from source)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({" and ".join(inside)}, false) as kept
from b left join h on b.lang is not distinct from k_lang and b.source is not distinct from k_source
"""
