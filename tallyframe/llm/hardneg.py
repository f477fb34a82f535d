"""Hard negatives by coordinate pruning over buckets of vectors of similar length.

Index: integer vectors are dealt by descending length into buckets of a bounded number of rows. A bucket keeps its
greatest length and, for each coordinate, its rows in the order of that coordinate. Search: a row whose score with the
anchor shall lie between two bounds can have a coordinate value only in a certain range, since by Cauchy-Schwarz the other
coordinates add or take at most what is left of both lengths. For an anchor's focus coordinates, those where it is
largest, binary search in the sorted lists gives the rows inside the range; the rows that all of them allow are scored
exactly. A bucket too short to reach the bound is passed over. The worst of the best scores so far is the bound for the
next bucket, so ranges narrow from the long buckets to the short ones. The anchors of a block are looked up together; those
whose lists leave more than a small part of a bucket are scored by one matrix product, in floating point where it is exact.

Two searches share the index. The first finds each anchor's positives, its best rows of the same label. The second finds,
for each positive, the best rows of other labels whose scores are between two shares of the positive's; here both bounds
prune. Blocks of anchors meet all cells of the index: a stated query set against all rows. A task holds a bounded number of
neighbouring cells and streams all blocks past them: the index is moved once, a block once for each task. Both sides are
dealt by the task's number without a join, so that neither is broadcast or collected, whatever their estimated sizes.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors are compared with
those of the same length only. Rows with the same id are never each other's partner; the least (vector, label) of an
anchor's rows stands for it, while each of its rows can be a partner of other anchors. Ties go to the smaller id. Fewer
partners than asked for give them all; an anchor without positives gives no row, and an empty table none at all. Scores
must fit 64 bits. Other columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import map_batches, written

EVERY, MOVED, LABELS = 100, 7, 10  # ids of anchors; ids whose label is the next one, of so many labels
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
BUCKET_ROWS, CELL_BUCKETS = 1024, 4
TASK_CELLS, TASK_VALUES = 16, 1 << 22  # cells and components that a task holds at most (one cell at least)
FEW_TASKS = 32  # up to so many tasks each has one cell
ANCHOR_ROWS = 512  # anchors of a block
FOCUS = 4  # coordinates whose sorted lists are looked up
LISTED = 16  # part of a bucket up to which rows are taken from the lists
PRODUCTS = 1 << 20  # components multiplied at once for them
NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, values, length): the rows that take part, components as floor(256 * x), labels moved where the id says so."""
    x, key = F.col("embedding"), F.col("vec_id").cast("bigint")
    fine = key.isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    values = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("bigint"))
    label = F.col("label").cast("bigint")
    moved = F.when(key % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    found = rows.where(fine).select(key.alias("vec_id"), moved.alias("label"), values.alias("values"))
    return found.withColumn("length", F.sqrt(F.aggregate("values", F.lit(0.0), lambda total, v: total + v.cast("double") * v)))


def build_index(vectors: DataFrame, bucket_rows: int = BUCKET_ROWS, cell_buckets: int = CELL_BUCKETS) -> tuple[DataFrame, int]:
    """Buckets by descending length, one row each (task, dim, n, longest, ids, labels, vectors, sorted lists), and the number of tasks."""

    def close(cell: int, dim: int, held: list) -> pa.RecordBatch:
        x = np.array([h[2] for h in held], dtype=np.int64).reshape(len(held), dim)
        order = np.argsort(x, axis=0, kind="stable").astype(np.int32).T if dim else np.empty((0, len(held)), np.int32)
        kind = next((t for t in ("<i2", "<i4") if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)), "<i8")
        short = "<u2" if len(held) <= 1 << 16 else "<i4"
        parts = [np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), x.astype(kind), np.ascontiguousarray(order).astype(short)]
        head = [pa.array([cell], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([max(h[3] for h in held)], pa.float64()), pa.array([kind]), pa.array([short])]
        return pa.RecordBatch.from_arrays([*head, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["cell", "dim", "n", "longest", "kind", "short", "keys", "labels", "x", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == bucket_rows:
                    yield close(cell, len(row[2]), held.pop(len(row[2])))
        for dim, own in held.items():
            yield close(cell, dim, own)

    schema = "cell int, dim int, n int, longest double, kind string, short string, keys binary, labels binary, x binary, lists binary"
    size = vectors.agg(F.count("*").alias("rows"), F.sum(F.size("values")).alias("components")).first()
    cells = max(1, -(-size["rows"] // (bucket_rows * cell_buckets)))
    dealt = vectors.select("vec_id", "label", "values", "length").repartitionByRange(cells, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    index = written(dealt.mapInArrow(run, schema), "length-buckets")
    together = max(1, min(TASK_CELLS, cells // FEW_TASKS, TASK_VALUES * cells // max(size["components"] or 0, 1)))
    tasks = -(-cells // together)
    return index.withColumn("task", F.pmod(F.floor(F.col("cell") / together), F.lit(tasks)).cast("int")).drop("cell"), tasks


def reach(q: np.ndarray, whole, low, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """For each coordinate the least and greatest value of a vector of at most this length whose product with q is ``low`` or more."""
    rest = np.sqrt(np.maximum(whole * whole - q * q, 0.0))
    level = low / whole
    root = np.sqrt(np.maximum(longest * longest - level * level, 0.0))
    least = np.where(-q * longest >= low, -longest, (q * level - rest * root) / whole)
    most = np.where(q * longest >= low, longest, (q * level + rest * root) / whole)
    return least, most


class Asked:
    """Anchors of one number of coordinates: ids, labels, vectors, lengths and focus coordinates."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, focus: int = FOCUS):
        self.keys, self.labels, self.x = keys, labels, x
        q = x.astype(np.float64)
        self.whole = np.sqrt((q * q).sum(axis=1))
        self.chosen = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :focus]
        self.focus = np.take_along_axis(q, self.chosen, axis=1)
        self.forms = {np.float64: q, np.int64: x}

    def form(self, kind) -> np.ndarray:
        if kind not in self.forms:
            self.forms[kind] = self.x.astype(kind)
        return self.forms[kind]


class Bucket:
    """One bucket, read from its row."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.keys, self.labels = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(n, dim).astype(np.int64)
        self.lists = np.frombuffer(row["lists"], row["short"]).reshape(dim, n)
        self.longest = row["longest"] * (1 + 1e-9)
        self.slack = 1e-6 * (1 + self.longest)
        self.forms = {np.int64: self.x}
        # The sorted values of all coordinates in one list, those of the next one beyond all of this one.
        self.gap = 2 * self.longest + 4 * self.slack + 4
        self.sorted = (np.take_along_axis(self.x.T, self.lists.astype(np.int64), axis=1) + np.arange(dim)[:, None] * self.gap).ravel()

    def spans(self, asked: Asked, low: np.ndarray, high: np.ndarray):
        """Least and greatest value of each focus coordinate for scores from ``low`` to ``high`` (infinite: open), where its rows begin in the lists, and how many they are; none if no row can reach them."""
        n = len(self.x)
        nothing = asked.whole == 0
        whole = np.where(nothing, 1.0, asked.whole)
        most = whole * self.longest
        margin = 1e-6 * (1 + most)
        none = np.where(nothing, (low > 0) | (high < 0), (low > most + margin) | (high < -most - margin))
        q, a, b = asked.focus, np.maximum(low, -most)[:, None], np.maximum(-high, -most)[:, None]
        one, two = reach(q, whole[:, None], a, self.longest), reach(-q, whole[:, None], b, self.longest)
        least, greatest = np.maximum(one[0], two[0]) - self.slack, np.minimum(one[1], two[1]) + self.slack
        place = asked.chosen * self.gap
        start = np.searchsorted(self.sorted, np.ceil(least) + place)
        size = np.maximum(np.searchsorted(self.sorted, np.floor(greatest) + place, side="right") - start, 0)
        size[nothing] = n
        size[none] = 0
        return least, greatest, start, size, np.where(none, 0, size.min(axis=1, initial=n))

    def listed(self, asked: Asked, spans, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one of the given anchors and a row that all its spans allow, read from its shortest one."""
        least, greatest, start, size, fewest = spans
        many = fewest[which]
        a = np.repeat(which, many)
        within = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        if not asked.focus.shape[1]:
            return a, within
        shortest = size[which].argmin(axis=1)
        r = np.where(asked.whole[a] == 0, within, self.lists.ravel()[(np.repeat(start[which, shortest], many) + within) % max(self.lists.size, 1)].astype(np.int64))
        for j in range(asked.focus.shape[1]):
            value = self.x[r, asked.chosen[a, j]]
            keep = (asked.whole[a] == 0) | (size[a, j] == len(self.x)) | (value >= least[a, j]) & (value <= greatest[a, j])
            a, r = a[keep], r[keep]
        return a, r

    def candidates(self, query: np.ndarray, low: float | None, high: float | None, focus: int = FOCUS) -> np.ndarray:
        """The rows that can have a score from ``low`` to ``high`` with the query; None leaves a side open."""
        asked = Asked(np.zeros(1, np.int64), np.zeros(1, np.int64), np.asarray(query, np.int64)[None], focus)
        spans = self.spans(asked, np.array([-np.inf if low is None else low]), np.array([np.inf if high is None else high]))
        return self.listed(asked, spans, np.zeros(1, np.int64))[1]

    def products(self, asked: Asked, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Scores of pairs of an anchor and a row."""
        step = max(1, PRODUCTS // max(self.x.shape[1], 1))
        return np.concatenate([np.empty(0, np.int64), *[np.einsum("ij,ij->i", asked.x[a[i : i + step]], self.x[r[i : i + step]]) for i in range(0, len(a), step)]])

    def scores(self, asked: Asked, which: np.ndarray) -> np.ndarray:
        """Scores of the given anchors with all rows. No sum on the way exceeds the product of the lengths, so floating point is exact below that."""
        most = float(asked.whole[which].max(initial=0)) * self.longest
        kind = np.float32 if most < (1 << 24) - 1 else np.float64 if most < (1 << 53) - 1 else np.int64
        if kind not in self.forms:
            self.forms[kind] = self.x.astype(kind)
        return asked.form(kind)[which] @ self.forms[kind].T


def highest(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (line, row) that fit; where many do, only those that can be among the k highest of their line."""
    if np.count_nonzero(fit) > 4 * k * len(scores) and scores.shape[1] > k:
        low = NONE if scores.dtype == np.int64 else -np.inf
        bar = np.partition(np.where(fit, scores, low), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        fit = fit & (scores >= bar[:, None])
    return np.nonzero(fit)


def search(buckets: list[Bucket], asked: Asked, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place, vec_id, score): for each anchor and place the k best rows of its label, or of other ones, with a score between the bounds.

    The bounds have a line for each anchor and a column for each place; a place whose bounds cross is not asked for.
    """
    places = low.shape[1]
    slot, keys, scores = (np.empty(0, np.int64) for _ in range(3))
    floors = low.copy()
    for bucket in buckets:
        wanted = floors <= high
        least, most = np.where(wanted, floors, ALL).min(axis=1), np.where(wanted, high, NONE).max(axis=1)
        spans = bucket.spans(asked, np.where(least == NONE, -np.inf, least), np.where(most == ALL, np.inf, most))
        possible = wanted.any(axis=1) & (spans[4] > 0)
        short = spans[4] * LISTED <= len(bucket.x)
        new = []
        if len(few := np.flatnonzero(possible & short)):
            a, r = bucket.listed(asked, spans, few)
            fit = ((bucket.labels[r] == asked.labels[a]) == same) & (bucket.keys[r] != asked.keys[a])
            a, r = a[fit], r[fit]
            found = bucket.products(asked, a, r)
            for p in range(places):
                fit = (found >= floors[a, p]) & (found <= high[a, p])
                new.append((a[fit] * places + p, bucket.keys[r[fit]], found[fit]))
        if len(rest := np.flatnonzero(possible & ~short)):
            found = bucket.scores(asked, rest)
            others = ((bucket.labels == asked.labels[rest, None]) == same) & (bucket.keys != asked.keys[rest, None])
            for p in range(places):
                fit = others & (found >= floors[rest, p, None].astype(found.dtype)) & (found <= high[rest, p, None].astype(found.dtype))
                a, r = highest(found, fit, k)
                new.append((rest[a] * places + p, bucket.keys[r], found[a, r].astype(np.int64)))
        if sum(len(part[0]) for part in new):
            slot, keys, scores = (np.concatenate(parts) for parts in zip((slot, keys, scores), *new, strict=True))
            order = np.lexsort((keys, -scores, slot))
            order = order[np.arange(len(order)) - np.searchsorted(slot[order], slot[order]) < k]
            slot, keys, scores = slot[order], keys[order], scores[order]
            many = np.bincount(slot, minlength=low.size)
            full = np.flatnonzero(many == k)
            floors.ravel()[full] = np.maximum(low.ravel()[full], scores[np.cumsum(many)[full] - 1])
    return slot // places, slot % places, keys, scores


def anchor_blocks(anchors: DataFrame, rows_of_block: int = ANCHOR_ROWS) -> DataFrame:
    """(block, dim, anchors): the anchors in blocks of about so many."""
    blocks = max(1, -(-anchors.select("vec_id").count() // rows_of_block))
    placed = anchors.withColumn("dim", F.size("values")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct(*anchors.columns))).alias("anchors"))


def met(index: DataFrame, tasks: int, blocks_of: DataFrame) -> DataFrame:
    """In each task its buckets by descending length, then all blocks of anchors."""
    asked = blocks_of.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "dim", "anchors")
    return index.unionByName(asked, allowMissingColumns=True).repartitionById(tasks, "task").sortWithinPartitions(F.col("anchors").isNotNull(), F.desc("longest"))


def _blocks(make_bounds, same: bool, k: int):
    """For each batch of a task: what ``search`` finds for its blocks of anchors, once the buckets before them are read."""
    buckets: dict[int, list[Bucket]] = {}

    def work(batch: pa.RecordBatch):
        names = [name for name in batch.schema.names if name != "anchors"]
        for i in range(batch.num_rows):
            anchors = batch.column("anchors")[i]
            if not anchors.is_valid:
                row = {name: batch.column(name)[i].as_py() for name in names}
                buckets.setdefault(row["dim"], []).append(Bucket(row))
                continue
            own, dim = anchors.values, batch.column("dim")[i].as_py()
            key, label = (own.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("vec_id", "label"))
            x = own.field("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), dim)
            asked = Asked(key, label, x)
            low, high = make_bounds(own)
            yield asked, search(buckets.get(dim, []), asked, low, high, same, k)

    return work


def find_positives(pairs: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, vec_id, score): the best k rows of the anchor's label in each task."""

    def make():
        blocks = _blocks(lambda own: (np.full((len(own), 1), NONE), np.full((len(own), 1), ALL)), True, k)

        def work(batch):
            for asked, (a, _, keys, scores) in blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(asked.keys[a]), pa.array(keys), pa.array(scores)], ["anchor_id", "vec_id", "score"])

        return work

    return map_batches(pairs, make, "anchor_id bigint, vec_id bigint, score bigint")


def find_negatives(pairs: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, place, vec_id, score): for each positive (its place in the anchor's list) the best k of each task within the bounds."""

    def bounds(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whole scores within the shares of each positive's; negative positives have no room between them."""
        lists = own.field("scores").to_pylist()
        places = max(map(len, lists))
        floors, tops = np.ones((len(own), places), np.int64), np.zeros((len(own), places), np.int64)
        for i, scores in enumerate(lists):
            floors[i, : len(scores)], tops[i, : len(scores)] = [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]
        return floors, tops

    def make():
        blocks = _blocks(bounds, False, k)

        def work(batch):
            for asked, (a, place, keys, scores) in blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(asked.keys[a]), pa.array((place + 1).astype(np.int32)), pa.array(keys), pa.array(scores)], ["anchor_id", "place", "vec_id", "score"])

        return work

    return map_batches(pairs, make, "anchor_id bigint, place int, vec_id bigint, score bigint")


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive."""
    vectors = usable(rows)
    index, tasks = build_index(vectors, bucket_rows)
    one = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("values", "label")).alias("row")).select("vec_id", "row.label", "row.values")
    anchors = written(one, "anchors")
    found = find_positives(met(index, tasks, anchor_blocks(anchors)), positives)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    chosen = written(found.withColumn("place", place).where(F.col("place") <= positives), "positives")  # at most k rows a task and anchor
    lists = chosen.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("scores"))
    asked = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "values", "scores")
    near = find_negatives(met(index, tasks, anchor_blocks(asked)), negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= negatives)
    own = chosen.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(own, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
