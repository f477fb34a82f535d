"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Index: vectors become integers and go into blocks of a bounded number of rows. In each dimension of a block, the rows
are sorted by quantised level. A query adds for each dimension the impact of a level, the least contribution that a row
of this level can have above the dimension's lowest; for a negative query component the order is the reverse.

Search: the posting segments (dimension, level) are processed by descending impact. A row's sum so far is a lower
bound of its score; the impacts that the next segments of all dimensions can still add, and the width of a level in
each dimension, give an upper bound. The search of a block stops only when every row whose upper
bound reaches the k-th best lower bound is among a few possible members; these are scored exactly. The best scores of
the blocks of a task raise that bar for the next.

Blocks of queries meet blocks of the index by a join on the query block's number: every query is held against every
row, and neither side is broadcast or collected. A query's candidates from all blocks then meet in one ranking of at
most k rows per index block.

Vectors that are null or hold null or non-finite components take no part; nor do rows with a null id. Vectors are
compared with those of the same length only. Equal ids are one query (its first vector) and never each other's
candidate. Ties go to the smaller id. Fewer than k candidates give them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import map_batches, written

K = 5
EVERY = 50
BLOCK_ROWS = 1 << 14
QUERY_ROWS = 1 << 9
MOST_TASKS = 20_000
LEVELS = 12
POSSIBLE = 8  # a block's search may stop when so many rows in all, or one in as many, are left to be scored exactly
CELL_BLOCKS = 2  # index blocks that meet a block of queries in one cell of the join
CHECKS = 6  # how often the bounds are compared on the way


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, values): vectors that take part, as floor(256 * x) with x as double."""
    x = F.col(vector_column)
    fine = x.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    values = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("bigint"))
    return rows.where(fine).select(F.col(id_column).cast("bigint").alias("vec_id"), values.alias("values"))


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, levels: int = LEVELS) -> DataFrame:
    """One row per block: dim, ids, vectors, and for each dimension its level bounds and rows sorted by level."""

    def close(dim: int, ids: list[int], values: list) -> pa.RecordBatch:
        x = np.array(values, dtype=np.int64).reshape(len(ids), dim)
        order = np.argsort(np.array(ids), kind="stable")
        x, keys = x[order], np.array(ids, dtype=np.int64)[order]
        low, high = (x.min(axis=0), x.max(axis=0)) if dim else (np.empty(0, np.int64),) * 2
        step = np.maximum(1, -(-(high - low + 1) // levels))
        level = ((x - low) // step).astype(np.uint8)
        postings = np.argsort(level, axis=0, kind="stable").astype(np.int32).T if dim else np.empty((0, len(ids)), np.int32)
        starts = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(levels + 1)) for d in range(dim)]).astype(np.int32) if dim else np.empty((0, levels + 1), np.int32)
        kind = next((t for t in ("<i2", "<i4") if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)), "<i8")
        parts = [keys, x.astype(kind), low, step, level, np.ascontiguousarray(postings), starts]
        columns = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([kind]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]]
        return pa.RecordBatch.from_arrays(columns, ["dim", "n", "kind", "keys", "x", "low", "step", "level", "postings", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list]] = defaultdict(lambda: ([], []))
        for batch in batches:
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held[len(values)]
                ids.append(key)
                rows.append(values)
                if len(ids) >= block_rows:
                    yield close(len(values), *held.pop(len(values)))
        for dim, (ids, rows) in held.items():
            yield close(dim, ids, rows)

    schema = "dim int, n int, kind string, keys binary, x binary, low binary, step binary, level binary, postings binary, starts binary"
    count = vectors.select("vec_id").count()
    dealt = vectors.select("vec_id", "values").repartition(max(1, -(-count // block_rows)))  # full blocks, whatever the files
    return written(dealt.mapInArrow(run, schema), "impact-index")


class Block:
    """One index block, read from its row."""

    def __init__(self, row: dict, levels: int = LEVELS):
        dim, n = row["dim"], row["n"]
        self.levels = levels
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(n, dim).astype(np.int64)
        self.low, self.step = np.frombuffer(row["low"], np.int64), np.frombuffer(row["step"], np.int64)
        self.level = np.frombuffer(row["level"], np.uint8).reshape(n, dim)
        self.postings = np.frombuffer(row["postings"], np.int32).reshape(dim, n)
        self.starts = np.frombuffer(row["starts"], np.int32).reshape(dim, levels + 1)

    def search(self, query: np.ndarray, asker: int, k: int, bar: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the rows of this block that can be among the best k above ``bar``."""
        n, dim = self.x.shape
        weight = np.abs(query)
        rising = query > 0
        # A row at height h of a dimension (levels counted from the query's worst) contributes at least weight * step
        # * h above the base, and at most the slack more.
        slack = int((weight * (self.step - 1)).sum())
        worst = np.where(rising, self.low, self.low + self.step * self.levels - 1)
        base = int((query * worst).sum())
        unit = weight * self.step
        impact = unit[:, None] * np.arange(self.levels)
        order = np.argsort(-impact, axis=None, kind="stable")
        order = order[impact.ravel()[order] > 0]
        height = np.full(dim, self.levels)  # levels from this height on have been processed
        total = np.full(n, base, dtype=np.int64)
        checks = set((len(order) * np.arange(CHECKS, 2 * CHECKS) // (2 * CHECKS - 1) - 1).tolist())  # in the later half
        possible = np.arange(n)
        same = self.keys == asker
        for i, place in enumerate(order.tolist()):
            d, h = divmod(place, self.levels)
            level = h if rising[d] else self.levels - 1 - h
            rows = self.postings[d, self.starts[d, level] : self.starts[d, level + 1]]
            if len(rows):
                total[rows] += impact[d, h]
            height[d] = h
            if i in checks and n > k:
                rest = unit * np.maximum(height - 1, 0)  # what an open dimension can still add
                lower = np.where(same, np.iinfo(np.int64).min, total)
                mark = np.partition(lower, n - k)[n - k]
                if bar is not None:
                    mark = max(mark, bar)
                possible = np.flatnonzero(total >= mark - slack - rest.sum())
                if len(possible) <= max(POSSIBLE, n // POSSIBLE):
                    break
        possible = possible[~same[possible]]
        scores = self.x[possible] @ query
        if bar is not None:
            keep = scores >= bar
            possible, scores = possible[keep], scores[keep]
        best = np.lexsort((self.keys[possible], -scores))[:k]
        return self.keys[possible[best]], scores[best]


def query_blocks(vectors: DataFrame, every: int = EVERY, rows_of_block: int = QUERY_ROWS) -> tuple[DataFrame, int]:
    """Blocks of the rows whose id is divisible by ``every``, one vector per id, and how many blocks there are."""
    chosen = vectors.where(F.col("vec_id") % every == 0)
    first = chosen.groupBy("vec_id").agg(F.min("values").alias("values"))
    count = first.select("vec_id").count()
    blocks = max(1, -(-count // rows_of_block))
    first = first.withColumn("dim", F.size("values")).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return first.groupBy("q", "dim").agg(F.sort_array(F.collect_list(F.struct("vec_id", "values"))).alias("queries")), blocks


def search(index: DataFrame, queries: DataFrame, blocks: int, k: int = K) -> DataFrame:
    """(query_id, vec_id, score): for each query and task, the best k rows of the task's index blocks."""
    # A block of queries meets the index blocks in cells of a bounded number of them.
    count = index.select("n").count()
    cells = max(1, -(-count // CELL_BLOCKS))
    names = ["n", "dim", "kind", "keys", "x", "low", "step", "level", "postings", "starts"]
    spread = index.withColumn("cell", F.pmod(F.xxhash64("keys"), F.lit(cells)).cast("int"))
    spread = spread.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    # One task for each pair of a cell and a block of queries, dealt by number: hashes would put some together and leave tasks idle.
    tasks = min(blocks * cells, MOST_TASKS)
    task = ((F.col("cell").cast("bigint") * blocks + F.col("q")) % tasks).cast("int")
    pairs = spread.join(asked, ["q", "cell", "dim"]).withColumn("task", task).repartitionById(tasks, "task")

    def make():
        bars: dict[int, list[int]] = {}  # the best k scores that a query has met in this task

        def work(batch):
            for row in batch.to_pylist():
                block = Block(row)
                asked, found, scores = [], [], []
                for one in row["queries"]:
                    own = one["vec_id"]
                    known = bars.get(own, [])
                    ids, score = block.search(np.array(one["values"], dtype=np.int64), own, k, known[-1] if len(known) == k else None)
                    asked += [own] * len(ids)
                    found += ids.tolist()
                    scores += score.tolist()
                    bars[own] = sorted(known + score.tolist(), reverse=True)[:k]
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

        return work

    return map_batches(pairs.select("queries", *names), make, "query_id bigint, vec_id bigint, score bigint")


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact k best of every query."""
    vectors = usable(rows)
    index = build_index(vectors, block_rows)
    queries, blocks = query_blocks(vectors, every)
    found = search(index, queries, blocks, k)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
