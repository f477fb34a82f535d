"""The adaptive quality rules against a count by hand, their SQL, and odd tables."""

import re
from collections import Counter

import pytest

import compare
from tallyframe.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, n_words string, base_failed string, doc string, k_lang string, level int"
ODD = [None, "", " ", "\n\n", "a", "a b a b a b", "x y\n x y\nx y\n\n", "#" * 500, "Ünï ﬁx y z 中文 \x0b½\x1c", "word " * 40_000, "x" * 200_000, "one two three four\n" * 20]


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(grams)
    inside = {p + i for p, gram in enumerate(grams) if times[gram] > 1 for i in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "k", "n", "b", "d", "l", 7) for i, t, lang, source in rows], SCHEMA)


@pytest.mark.parametrize("text", ODD)
def test_counts_by_hand(text):
    assert rules.counts_of(text) == by_hand(text)


def test_counts_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert all(rules.counts_of(r.text) == by_hand(r.text) for r in rows)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    assert not compare.compare(compare.oracle_connection(path), "op11_adaptive_rules", queries.op11_adaptive_rules(spark, path), queries.ORACLES["op11_adaptive_rules"])


def test_values_are_rounded_to_their_first_digits(spark):
    rows = spark.range(0, 300_000, 7).select("id", rules.rounded("id").alias("r")).collect()
    for row in rows:
        shift = max(0, row.id.bit_length() - rules.DIGITS)
        assert row.r == row.id >> shift << shift and row.id - row.r <= row.id / 128


def test_sketches_of_parts_add_up(spark):
    rows = rules.counted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).drop("doc").cache()
    whole = rules.limits(rules.sketches(rows))
    parts = rules.sketches(rows.where("n_words % 2 = 0")).unionByName(rules.sketches(rows.where("n_words % 2 = 1")))
    added = rules.limits(parts.groupBy("lang", "source", "feature", "value").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, added.collect()))


def test_limits_follow_the_group(spark):
    """The same word length is usual in one source and out in another; a small group takes its language's limits."""
    short, long = "abc abd abe abf " * 2, "abcdefghi abcdefghj "

    def text(words, i):
        return " ".join(f"{w}{(i * 31 + k) % 97}" for k, w in enumerate(words.split() * 40))

    rows = [(i, text(short, i), "en", "a") for i in range(220)] + [(1000 + i, text(long, i), "en", "b") for i in range(220)]
    rows += [(5000, text(long, 1), "en", "a"), (5001, text(short, 1), "en", "b"), (5002, text(short, 2), "en", "c"), (5003, text(long, 2), None, None)]
    kept = {r.doc_id: r.kept for r in rules.verdicts(table(spark, rows)).collect()}
    assert not kept[5000] and not kept[5001]
    assert kept[5002] and kept[5003]
    assert all(kept[i] for i in [*range(220), *range(1000, 1220)])


def test_odd_tables(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(ODD)]
    docs = table(spark, [*rows, rows[9], (None, "no id", "en", None)])
    found = rules.verdicts(docs).collect()
    assert len(found) == len(ODD) + 2
    assert {r.doc_id: r.base_failed for r in found}[0] and all(r.kept is not None for r in found)
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert rules.verdicts(table(spark, [])).count() == 0 and rules.accepted(table(spark, [])).count() == 0
