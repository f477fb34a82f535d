"""Weights of near-duplicate runs: every run weighs by its share, and near copies do not play down what they share."""

import random

import numpy as np
import pytest

from tallyframe.llm import neardup


def words(draw, many, kind):
    return [f"{kind}{draw.randrange(10**9)}" for _ in range(many)]


def runs_of(text):
    return neardup.shingles([text])[1]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_every_share_has_a_weight_of_its_own(spark):
    draw = random.Random(1)
    lines = {many: words(draw, 12, "c") for many in (200, 40, 8, 2)}
    texts = [" ".join([*words(draw, 30, "a"), *(w for many, line in lines.items() if i < many for w in line), *words(draw, 30, "b")]) for i in range(400)]
    weights = neardup.run_weights(table(spark, texts).repartition(3))
    for many, line in lines.items():
        assert np.median(weights.alone(runs_of(" ".join(line)))) == pytest.approx(np.log1p(400 / many), abs=0.1)
        assert np.median(weights.shared(runs_of(" ".join(line)))) == pytest.approx(np.log1p(400 / (many - 1)), abs=0.1)
    assert np.median(weights.alone(runs_of(texts[399]))) == pytest.approx(np.log1p(400), abs=0.1)
    again = neardup.run_weights(table(spark, texts[::-1]).repartition(5))
    assert np.array_equal(weights.held_by, again.held_by) and weights.documents == again.documents == 400


def test_a_crowd_of_near_copies_counts_about_once(spark):
    draw = random.Random(2)
    base = words(draw, 120, "w")
    texts = [" ".join(words(draw, 120, "u")) for _ in range(100)]
    for _ in range(200):
        changed = list(base)
        changed[draw.randrange(120)] = words(draw, 1, "x")[0]
        texts.append(" ".join(changed))
    docs = table(spark, [*texts, *[" ".join(base)] * 20])
    weights = neardup.run_weights(docs)
    alone, shared = (np.median(weights.alone(runs_of(t))) for t in (texts[0], " ".join(base)))
    assert np.log1p(100) < alone < np.log1p(125) and shared > np.log1p(20)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert {found[i] for i in range(100, 320)} == {100} and len({found[i] for i in range(100)}) == 100


def test_texts_that_share_only_what_a_fifth_of_all_hold_stay_apart(spark):
    draw = random.Random(3)
    common = words(draw, 100, "c")
    texts = [" ".join([*words(draw, 100, "u"), *common]) for _ in range(120)]
    texts += [" ".join(words(draw, 20, "t")) for _ in range(480)]
    texts += [" ".join([*common, *words(draw, 8, "v")]) for _ in range(2)]
    sets = [set(runs_of(t).tolist()) for t in texts[-2:]]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8  # all runs alike, they would be copies
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert found == {i: i for i in range(602)}


def test_shared_runs_have_their_own_weights():
    a = (np.array([1, 2, 3]), np.array([1.0, 2, 3]), np.array([1.0, 4, 9]))
    b = (np.array([2, 3, 5]), np.array([2.0, 6, 5]), np.array([4.0, 18, 5]))
    assert neardup.weighted_jaccard(a, b) == pytest.approx((4 + 9) / (1 + 5 + 4 + 18))
    assert neardup.weighted_jaccard(a[:2], b[:2]) == pytest.approx((2 + 3) / (1 + 5 + 2 + 6))


def test_keys_of_odd_texts():
    texts = ["", None, "one", "one two three four five six", " ".join(f"w{i}" for i in range(500))]
    owner, keys, _, _ = neardup.shingles(texts)
    whose, named = neardup.crowd_keys(owner, keys, len(texts))
    assert np.bincount(whose, minlength=5).tolist() == [0, 0, 1, 1, neardup.MOST_KEYS] and len(set(named.tolist())) == len(named)
    assert neardup.crowd_sizes(whose, np.arange(len(whose)), 5).tolist() == [1, 1, 1, 1, 2 + 3 * neardup.MOST_KEYS // 4]
    assert neardup.crowd_sizes(*neardup.crowd_keys(*neardup.shingles(["", None])[:2], 2), 2).tolist() == [1, 1]
