"""The statistics of the quality classifier against a count by hand, texts alone and in one batch."""

import itertools
import math

import numpy as np
import pytest

from tallyframe.llm import quality

TEXTS = [
    None, "", " ", "\n", "a", "Hello world. Hello world!", "ÜBER die Brücke\ngehen wir; 42 mal (oder: mehr)", "a b a b a b", "x\nx\n\ny.\n",
    "THE END!! ### $$ <|x|>", "\x07bell\x85 ½ 中文 \U0001f600", "word " * 50, "q" * 70, 'He said "no", twice.\tThen\x0bleft',
]


def kind(c):
    return int(quality._classes()[min(ord(c), 0x2FFF)])


def by_hand(text):
    text = text or ""
    if not text:
        return [0.0] * len(quality.STATISTICS)
    kinds = [kind(c) for c in text]
    n = len(text)

    def runs(outside):
        return ["".join(c for c, _ in group) for inside, group in itertools.groupby(zip(text, kinds, strict=True), key=lambda p: p[1] not in outside) if inside]

    words, lines = runs((quality.SPACE, quality.LINE)), runs((quality.LINE,))
    some, rows = max(len(words), 1), max(len(lines), 1)
    sizes = [len(w) for w in words]
    upper = [sum(kind(c) == quality.UPPER for c in w) for w in words]
    marked = [any(kind(c) in (quality.SYMBOL, quality.OTHER, quality.CONTROL) for c in w) for w in words]
    stops = kinds.count(quality.STOP)
    mean = sum(sizes) / some
    share = {name: kinds.count(value) / n for name, value in vars(quality).items() if name.isupper() and isinstance(value, int) and value < quality.CLASSES}
    return [
        math.log1p(n), *[share[k] for k in ("LOWER", "UPPER", "DIGIT", "SPACE", "STOP", "COMMA", "QUOTE", "BRACKET", "SYMBOL", "CONTROL", "OTHER")],
        math.log1p(len(words)), mean, math.sqrt(max(sum(s * s for s in sizes) / some - mean * mean, 0)), len(set(words)) / some,
        sum(a == b for a, b in itertools.pairwise(words)) / some, sum(s > 20 for s in sizes) / some, sum(0 < u < s for u, s in zip(upper, sizes, strict=True)) / some,
        sum(u >= max(s - 2, 2) for u, s in zip(upper, sizes, strict=True)) / some, sum(marked) / some, math.log1p(len(lines)), len(words) / rows, len(set(lines)) / rows,
        sum(a == b for a, b in itertools.pairwise(text)) / n, sum(kind(line[-1]) == quality.STOP for line in lines) / rows,
        sum(a != b for a, b in itertools.pairwise(kinds)) / n, len(words) / (stops + 1), sum(a == b for a, b in zip(words, words[2:], strict=False)) / some,
    ]


def test_statistics_by_hand(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [*TEXTS, *[r.text for r in rows]]
    got = quality.statistics(texts)
    for text, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx(by_hand(text), abs=1e-9), (text or "")[:80]
    assert np.array_equal(np.vstack([quality.statistics([t]) for t in TEXTS]), got[: len(TEXTS)])
    assert quality.statistics([]).shape == (0, len(quality.STATISTICS))
