"""Hard negatives against all pairs by hand, the soundness of value ranges, and odd tables."""

import math
import random
import re

import numpy as np
import pytest

import compare
from tallyframe.llm import hardneg, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, length string, cell string"


def by_hand(rows):
    """Rows as (vec_id, vector, label)."""
    usable = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        usable.append((key, (label + 1) % 10 if key % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(v))) for v in vector)))
    anchors = {}
    for key, label, values in usable:
        if key % 100 == 0:
            anchors[key] = min(anchors.get(key, (values, label)), (values, label))
    out = []
    for anchor, (q, own) in anchors.items():
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), key, label) for key, label, v in usable if key != anchor and len(v) == len(q)))
        for s, positive, _ in [x for x in scored if x[2] == own][:5]:
            inside = [x for x in scored if x[2] != own and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(anchor, positive, i + 1, key, -s, -t) for i, (t, key, _) in enumerate(inside)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, v, label, "s", "l", "c") for k, v, label in rows], SCHEMA)


def results(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("bucket_rows, anchor_rows", [(16, 3), (1024, 512)])
def test_made_up_vectors(spark, monkeypatch, bucket_rows, anchor_rows):
    monkeypatch.setattr(hardneg, "ANCHOR_ROWS", anchor_rows)
    draw = random.Random(bucket_rows)
    middles = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        dim = 6 if i % 11 else 3
        scale = draw.choice([0.05, 0.3, 1.0, 4.0])
        middle = middles[i % 5]
        rows.append((i, [round(scale * (m + draw.gauss(0, 0.2)), 1) for m in middle[:dim]], draw.choice([0, 1, 1, 1, 9])))
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(60)] + [(200, rows[200][1], 4), (300, rows[3][1], 1), (101, rows[101][1], rows[101][2])]
    expected = by_hand(rows)
    assert len(expected) > 200
    assert results(hardneg.hard_negatives(table(spark, rows), bucket_rows=bucket_rows)) == expected


@pytest.mark.parametrize("seed", range(6))
def test_value_ranges_lose_no_row(seed):
    draw = np.random.default_rng(seed)
    x = (draw.normal(size=(300, 8)) * draw.choice([1, 50, 400], size=(300, 1))).astype(np.int64)
    lists = np.argsort(x, axis=0, kind="stable").astype("<u2").T
    zeros = np.zeros(300, np.int64)
    row = {"n": 300, "dim": 8, "longest": float(np.sqrt((x * x).sum(axis=1)).max()), "kind": "<i8", "short": "<u2", "keys": zeros.tobytes(), "labels": zeros.tobytes(), "x": x.tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}
    bucket, fewer = hardneg.Bucket(row), 0
    for query in [*x[:40], np.zeros(8, np.int64), np.eye(8, dtype=np.int64)[3] * 9]:
        scores = x @ query
        for low, high in [(None, None), *[(float(a), float(b)) for a, b in np.sort(draw.choice(scores, size=(12, 2)), axis=1)], (float(scores.max()), None), (None, float(scores.min()))]:
            rows = bucket.candidates(query, low, high)
            wanted = np.flatnonzero((scores >= (low if low is not None else -np.inf)) & (scores <= (high if high is not None else np.inf)))
            assert set(wanted.tolist()) <= set(rows.tolist()) and len(set(rows.tolist())) == len(rows)
            fewer += len(rows) < 300
    assert fewer > 100


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    assert not compare.compare(compare.oracle_connection(path), "op12_hard_negatives", queries.op12_hard_negatives(spark, path), queries.ORACLES["op12_hard_negatives"])


def test_odd_tables(spark):
    odd = [(0, [], 1), (1, [], 1), (2, [], 2), (100, None, 1), (200, [0.0, 0.0], 3), (201, [1.0, 1.0], 3), (202, [0.0, -3.0], 4), (None, [1.0, 1.0], 3), (300, [1.0, None], 3), (400, [1.0, float("nan")], 3)]
    odd += [(500, [1.0, 2.0], None), (600, [1.0, 2.0], 5), (601, [1.0, float("inf")], 5), (602, [1.0, 2.0], 5), (603, [0.5, 1.0], 6), (604, [0.5, 1.0], 6), (604, [0.5, 1.0], 6), (605, [-1.0, -1.0], 6)]
    assert results(hardneg.hard_negatives(table(spark, odd))) == by_hand(odd) != []
    assert hardneg.hard_negatives(table(spark, [])).count() == 0


def test_blocks_and_cells_meet_without_a_join(spark, monkeypatch):
    """A broadcast side grew with anchors x cells, and the index was copied for every block."""
    plans, copies = [], []
    for name in ("find_positives", "find_negatives"):

        def seen(pairs, *rest, find=getattr(hardneg, name)):
            plans.append(pairs._jdf.queryExecution().executedPlan().toString())
            copies.append(pairs.agg({"n": "sum"}).first()[0])
            return find(pairs, *rest)

        monkeypatch.setattr(hardneg, name, seen)
    monkeypatch.setattr(hardneg.anchor_blocks, "__defaults__", (3,))
    draw = random.Random(5)
    rows = [(10 * i, [round(draw.gauss(0, 1), 1) for _ in range(4)], i % 3) for i in range(400)]
    assert results(hardneg.hard_negatives(table(spark, rows), bucket_rows=8)) == by_hand(rows) != []
    assert "Join" not in plans[0] and "Broadcast" not in plans[0]
    assert len(re.findall("Join ", plans[1])) == 1  # the positives' scores beside their anchors
    assert copies == [400, 400]  # each row of the index once


@pytest.mark.parametrize("size", [100, 20_000, 1 << 26])
@pytest.mark.parametrize("same", [True, False])
def test_search_against_all_pairs(size, same):
    """Scores below 2^24, 2^53 and above, read from lists and from products."""
    draw = np.random.default_rng(size)
    x = (draw.normal(size=(200, 8)) * draw.choice([0.1, 0.5, 1], size=(200, 1)) * size).astype(np.int64)
    x[20:40] = x[:20]
    keys, labels = draw.integers(0, 150, 200), draw.integers(0, 3, 200)
    buckets = []
    order = np.argsort(-(x.astype(float) ** 2).sum(axis=1))
    for part in np.split(order, 4):
        lists = np.argsort(x[part], axis=0, kind="stable").astype("<u2").T
        buckets.append(hardneg.Bucket({"n": 50, "dim": 8, "longest": math.sqrt(float((x[part[0]].astype(float) ** 2).sum())), "kind": "<i8", "short": "<u2", "keys": keys[part].tobytes(), "labels": labels[part].tobytes(), "x": x[part].tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}))
    queries_of = np.concatenate([x[::7], np.zeros((1, 8), np.int64)])
    asked = hardneg.Asked(np.arange(len(queries_of)), np.arange(len(queries_of)) % 3, queries_of)
    scores = [[sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for v in x] for q in queries_of]
    low = np.array([[np.quantile(s, 0.2).astype(int), np.quantile(s, 0.97).astype(int), hardneg.NONE, 1] for s in scores], np.int64)
    high = np.array([[np.quantile(s, 0.7).astype(int), hardneg.ALL, hardneg.ALL, 0] for s in scores], np.int64)
    found = sorted(zip(*[c.tolist() for c in hardneg.search(buckets, asked, low, high, same, 4)], strict=True))
    expected = []
    for i, line in enumerate(scores):
        for p in range(4):
            fit = [(-s, k) for s, k, label in zip(line, keys.tolist(), labels.tolist(), strict=True) if low[i, p] <= s <= high[i, p] and (label == i % 3) == same and k != i]
            expected += [(i, p, k, -s) for s, k in sorted(fit)[:4]]
    assert found == sorted(expected)
