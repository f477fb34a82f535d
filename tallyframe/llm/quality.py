"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in tasks with flat arrays. The trees are fitted on the statistics of a bounded
sample of labelled rows and flattened into arrays, so that scoring walks all trees and rows level by level.

Null and empty texts have statistics (all zero) and so a score. Texts with the same content have the same score.
Repeated rows stay; columns of the input other than the id and the text are not read. An empty table gives an empty
result. Without labels of both kinds the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import beside_results, code_points, labelled_sample, map_batches, pieces, with_results

SAMPLE = 12_000  # labelled rows of each kind that the trees are fitted on, at most (about)
BATCH_CHARACTERS = 150_000

# Classes of characters.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, QUOTE, BRACKET, SYMBOL, CONTROL, OTHER = range(12)
CLASSES = 12
STATISTICS = [
    "log_chars", "lower", "upper", "digit", "space", "stop", "comma", "quote", "bracket", "symbol", "control", "other",
    "log_words", "word_length", "word_deviation", "distinct_words", "repeated_next", "long_words", "capital_words",
    "upper_words", "symbol_words", "log_lines", "line_words", "distinct_lines", "repeated_characters", "ended_lines",
    "top_class_change", "words_per_stop", "repeated_second",
]


@cache
def _classes() -> np.ndarray:
    table = np.full(0x3000, OTHER, dtype=np.uint8)
    for point in range(len(table)):
        c = chr(point)
        if c == "\n":
            table[point] = LINE
        elif c.isspace():
            table[point] = SPACE
        elif c.islower():
            table[point] = LOWER
        elif c.isupper():
            table[point] = UPPER
        elif c.isalpha():
            table[point] = LOWER
        elif c.isdigit():
            table[point] = DIGIT
        elif c in ".!?":
            table[point] = STOP
        elif c in ",;:-":
            table[point] = COMMA
        elif c in "\"'`":
            table[point] = QUOTE
        elif c in "()[]{}":
            table[point] = BRACKET
        elif point < 32 or 127 <= point < 160:
            table[point] = CONTROL
        elif point < 256:
            table[point] = SYMBOL
    return table


@cache
def _powers() -> np.ndarray:
    """Odd multipliers for positions in a word or line."""
    return (np.random.default_rng(11).integers(1, 1 << 62, 4096, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


def _runs(inside: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that stay within one owner."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.empty(len(inside), bool)
    change[0] = True
    change[1:] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(inside))
    keep = inside[starts]
    return starts[keep], ends[keep]


def _hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    place = np.arange(len(flat)) - np.repeat(np.append(starts[:1] * 0, starts), np.diff(np.concatenate([[0], starts, [len(flat)]])))
    terms = (flat.astype(np.uint64) + np.uint64(1)) * _powers()[place & 4095]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    mixed = (total[ends] - total[starts]) ^ lengths.astype(np.uint64)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each owner."""
    if not len(keys):
        return np.zeros(n)
    packed = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16)))
    first = np.append(True, packed[1:] != packed[:-1])
    return np.bincount((packed[first] >> np.uint64(48)).astype(np.int64), minlength=n).astype(float)


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    n = len(texts)
    flat, ends = code_points(texts)
    lengths = np.diff(np.concatenate([[0], ends]))
    owner = np.repeat(np.arange(n), lengths)
    kind = _classes()[np.minimum(flat, 0x2FFF)]
    counts = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    chars = np.maximum(lengths, 1).astype(float)
    share = counts / chars[:, None]

    def by(owners, weights=None):
        return np.bincount(owners, weights, minlength=n).astype(float)

    starts, stops = _runs((kind != SPACE) & (kind != LINE), owner)
    word_owner, size = owner[starts], (stops - starts).astype(float)
    words = by(word_owner)
    some = np.maximum(words, 1)
    mean = by(word_owner, size) / some
    deviation = np.sqrt(np.maximum(by(word_owner, size * size) / some - mean * mean, 0))
    keys = _hashes(flat, starts, stops)
    same = np.append(False, (keys[1:] == keys[:-1]) & (word_owner[1:] == word_owner[:-1])) if len(keys) else np.empty(0, bool)
    second = np.zeros(len(keys), bool)
    second[2:] = (keys[2:] == keys[:-2]) & (word_owner[2:] == word_owner[:-2])

    def in_words(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[stops] - total[starts]).astype(float)

    upper, marks = in_words(kind == UPPER), in_words((kind == SYMBOL) | (kind == OTHER) | (kind == CONTROL))
    line_starts, line_stops = _runs(kind != LINE, owner)
    line_owner = owner[line_starts]
    lines = by(line_owner)
    line_keys = _hashes(flat, line_starts, line_stops)
    ended = kind[line_stops - 1] == STOP if len(line_stops) else np.empty(0, bool)
    repeated = np.zeros(len(flat), bool)
    repeated[1:] = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
    change = np.zeros(len(flat), bool)
    change[1:] = (kind[1:] != kind[:-1]) & (owner[1:] == owner[:-1])
    rows = np.column_stack([
        np.log1p(lengths), share[:, LOWER], share[:, UPPER], share[:, DIGIT], share[:, SPACE], share[:, STOP],
        share[:, COMMA], share[:, QUOTE], share[:, BRACKET], share[:, SYMBOL], share[:, CONTROL], share[:, OTHER],
        np.log1p(words), mean, deviation, _distinct(word_owner, keys, n) / some, by(word_owner, same) / some,
        by(word_owner, size > 20) / some, by(word_owner, (upper > 0) & (upper < size)) / some,
        by(word_owner, upper >= np.maximum(size - 2, 2)) / some, by(word_owner, marks > 0) / some, np.log1p(lines),
        words / np.maximum(lines, 1), _distinct(line_owner, line_keys, n) / np.maximum(lines, 1),
        by(owner, repeated) / chars, by(line_owner, ended) / np.maximum(lines, 1), by(owner, change) / chars,
        words / (counts[:, STOP] + 1), by(word_owner, second) / some,
    ])
    rows[lengths == 0] = 0
    return rows


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points at itself, so that every walk takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        if len(self.roots):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            out += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 90, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: float = 4.0) -> Trees:
    """Boost the log loss with trees grown level by level on binned features."""
    flat = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.mean() < 1:
        p = x.shape[1]
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(p)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
        places = binned + np.arange(p) * bins
        raw = np.full(len(y), base)
        for _ in range(rounds):
            chance = 1 / (1 + np.exp(-raw))
            gradient, curve = y - chance, chance * (1 - chance)
            roots.append(len(flat["value"]))
            at = np.zeros(len(y), dtype=np.int64)  # node of each row, within this tree's level
            level = [_node(flat)]
            gain_rows = np.zeros(len(y))
            for step in range(depth + 1):
                k = len(level)
                g_node, h_node = np.bincount(at[at >= 0], gradient[at >= 0], k), np.bincount(at[at >= 0], curve[at >= 0], k)
                split = {}
                if step < depth:
                    live = at >= 0
                    where = (at[live, None] * (p * bins) + places[live]).ravel()
                    g = np.bincount(where, np.repeat(gradient[live], p), k * p * bins).reshape(k, p, bins).cumsum(axis=2)
                    h = np.bincount(where, np.repeat(curve[live], p), k * p * bins).reshape(k, p, bins).cumsum(axis=2)
                    rest_g, rest_h = g_node[:, None, None] - g, h_node[:, None, None] - h
                    gain = g * g / (h + penalty) + rest_g * rest_g / (rest_h + penalty) - (g_node**2 / (h_node + penalty))[:, None, None]
                    gain[(h < least) | (rest_h < least)] = 0
                    best = gain.reshape(k, -1).argmax(axis=1)
                    for node in range(k):
                        feature, cut = divmod(int(best[node]), bins)
                        if gain[node, feature, cut] > 1e-6 and cut < len(cuts[feature]):
                            split[node] = (feature, cut)
                following, moved = [], np.full(len(y), -1, dtype=np.int64)
                for node, place in enumerate(level):
                    mine = at == node
                    if node in split:
                        feature, cut = split[node]
                        left, right = _node(flat), _node(flat)
                        flat["feature"][place], flat["threshold"][place] = feature, cuts[feature][cut]
                        flat["left"][place], flat["right"][place] = left, right
                        goes = binned[:, feature] <= cut
                        moved[mine & goes], moved[mine & ~goes] = len(following), len(following) + 1
                        following += [left, right]
                    else:
                        flat["value"][place] = rate * g_node[node] / (h_node[node] + penalty)
                        gain_rows[mine] = flat["value"][place]
                at, level = moved, following
                if not level:
                    break
            raw += gain_rows
    arrays = {k: np.array(v, dtype=float if k in ("threshold", "value") else np.int64) for k, v in flat.items()}
    return Trees(**arrays, roots=np.array(roots, dtype=np.int64), depth=depth, base=base)


def _node(flat: dict[str, list]) -> int:
    place = len(flat["value"])
    for key, value in (("feature", 0), ("threshold", np.inf), ("left", place), ("right", place), ("value", 0.0)):
        flat[key].append(value)
    return place


def with_statistics(df: DataFrame) -> DataFrame:
    """(doc_id, label) with the statistics of the text as an array, computed in tasks."""

    def make():
        def work(batch):
            texts = batch.column("text").to_pylist()
            found = [statistics(texts[a:b]) for a, b in pieces(texts, BATCH_CHARACTERS)]
            x = np.concatenate(found) if found else np.empty((0, len(STATISTICS)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

        return work

    return map_batches(df.select("doc_id", "label", "text"), make, "doc_id bigint, label int, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, limit: int = SAMPLE) -> Trees:
    """Trees fitted on at most about ``limit`` labelled rows of each kind among those that ``keep`` admits."""
    sample = labelled_sample(docs, labels, "quality", keep, limit, "quality")
    rows = with_statistics(sample).orderBy("doc_id").collect()  # bounded by 2 * limit rows of statistics
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.array([r.label for r in rows], dtype=float))


def _scorer(spark, trees: Trees):
    shared = spark.sparkContext.broadcast(trees)  # sized by rounds and depth

    def make():
        model = shared.value

        def work(texts):
            found = [model.score(statistics(texts[a:b])) for a, b in pieces(texts, BATCH_CHARACTERS)]
            return [pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())]

        return work

    return make


def score_quality(docs: DataFrame, trees: Trees, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return with_results(rows, _scorer(docs.sparkSession, trees), "score double").drop("text")


def accepted(docs: DataFrame, trees: Trees, least: float = 0.7) -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns."""
    return beside_results(docs, _scorer(docs.sparkSession, trees), "score double").where(F.col("score") >= least).select("doc.*")
