"""Spelling variants against all pairs by hand, with small slices so that tries are joined over many boundaries."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyframe.llm import queries, tries

SCHEMA = "doc_id bigint, text string, word string, n string, id string, path string, form string"


def words_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    words = words_by_hand(rows)
    found, forms = {}, {}
    for w, n in words.items():
        around = [v for v in words if abs(len(v) - len(w)) < 2 and v != w and near(v, w)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        found[w] = len(around)
    out = set()
    for w, n in words.items():
        end = w
        while forms[end] is not None:
            end = forms[end]
        out.add((w, forms[w], end, n, found[w], words.get(forms[w])))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", "i", "p", "f") for i, t in rows], SCHEMA)


def results(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("slice_words", [7, 50_000])
def test_made_up_words(spark, monkeypatch, slice_words):
    monkeypatch.setattr(tries, "SLICE_WORDS", slice_words)
    draw = random.Random(slice_words)
    stems = ["aaaaa", "aaaaaa", "abababab", "niederlande", "straße", "÷×ÀÿÀ", "letter", "lettre", "zzzzz"]
    words = [s for s in stems for _ in range(draw.choice([3, 8, 40, 300]))]
    for _ in range(700):
        s = draw.choice(stems)
        for _ in range(draw.choice([1, 1, 2])):
            i = draw.randrange(len(s))
            s = draw.choice([s[:i] + s[i + 1 :], s[:i] + draw.choice("abzÿ") + s[i:], s[:i] + draw.choice("abzÿ") + s[i + 1 :], s])
        words += [s] * draw.choice([1, 3, 3, 6, 12])
    draw.shuffle(words)
    rows = [(i, draw.choice([" ", "-", "1", "\n"]).join(words[i * 40 : i * 40 + 40])) for i in range(-(-len(words) // 40))]
    expected = by_hand(rows)
    assert len(expected) > 60 and any(r[2] != r[1] and r[1] for r in expected)
    assert results(tries.variants(table(spark, rows))) == expected


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert results(queries.op13_trie_variants(spark, path)) == by_hand(rows)


def test_long_chains(spark):
    """Counts that double along a row of words: the root is the last."""
    chain = ["aaaaa" + "b" * i for i in range(8)]
    rows = [(i, " ".join([w] * (3 << i))) for i, w in enumerate(chain)]
    found = results(tries.variants(table(spark, rows)))
    assert found == by_hand(rows)
    assert {r[2] for r in found if r[0] in chain} == {chain[-1]}


def test_odd_tables(spark):
    long = "x" * 30_000
    rows = [(1, None), (2, ""), (3, "12 ,;"), (None, "hello Hello HELLO hallo hallo"), (4, f"{long} {long}y"), (4, f"{long} {long}y"), (4, f"{long} {long}y"), (5, "hallo Jello jello jello " * 9)]
    assert results(tries.variants(table(spark, rows))) == by_hand(rows)
    assert results(tries.variants(table(spark, []))) == set()
    assert results(tries.variants(table(spark, [(1, "few words here only")]))) == set()
