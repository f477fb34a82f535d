"""Best-fit packing planned on the histogram of lengths instead of on documents.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. The plan sees only how many pieces there are
of each length: lengths descend, and each goes to the open sequences with the least room that still takes it, all
sequences with the same room at once. A plan entry says which ranks within a length go to which run of sequences, and
there are a few entries for each length, however many documents there are. Pieces then take their places by their
rank within their length.

A null text has the end id alone. Rows with the same id are separate documents; pieces of equal length are ranked by
id, then by piece and content, so equal rows share a rank order without effect on the result's shape. An empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import crc32, map_batches, runs_of_texts, written
from tallyframe.llm.tokens import TEXT_BYTES, word_encoder

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
RANK_SLICE = 20_000  # pieces of one length that one task ranks, about


@dataclass(frozen=True)
class Entry:
    """Ranks from ``rank`` on, ``count`` pieces: ``each`` to a sequence from ``sequence`` on, the first at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Entry], int]:
    """Best-fit decreasing over counts. Returns the entries and the number of sequences."""
    rooms: list[int] = []  # distinct amounts of room, ascending
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, number)
    entries: list[Entry] = []
    sequences = 0

    def give_back(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
            else:
                room, each = capacity, capacity // length
                first, number = sequences, -(-left // each)
                sequences += number
            each = room // length
            full, rest = divmod(min(left, number * each), each)
            offset = capacity - room
            if full:
                entries.append(Entry(length, rank, full * each, first, each, offset))
                give_back(room - each * length, first, full)
                rank += full * each
                left -= full * each
            if rest:
                entries.append(Entry(length, rank, rest, first + full, rest, offset))
                give_back(room - rest * length, first + full, 1)
                rank += rest
                left -= rest
            used = full + (rest > 0)
            give_back(room, first + used, number - used)
    return entries, sequences


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if wanted."""

    def make():
        encoder = word_encoder(vocabulary)

        def work(batch):
            keys = batch.column(0)
            for begin, end in runs_of_texts(batch.column(1), TEXT_BYTES):
                own, number, starts, lengths, sums, ids_out = [], [], [], [], [], []
                part = keys.slice(begin, end - begin)
                for i, found in enumerate(encoder.encode(batch.column(1).slice(begin, end - begin).to_pylist())):
                    ids = np.append(found, np.uint32(end_id))
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        some = ids[a : a + capacity]
                        own.append(i)
                        number.append(k)
                        starts.append(a)
                        lengths.append(len(some))
                        sums.append(crc32(some))
                        if with_ids:
                            ids_out.append(some.astype("<u4").tobytes())
                arrays = [part.take(pa.array(own, pa.int32())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids_out, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return map_batches(docs.select(F.col(id_column), F.col(text_column)), make, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``pieces`` is read twice and should be a written table."""
    # Ranks come in two steps, so that a length that a third of all pieces share is ranked by many tasks.
    total = pieces.count()
    slices = max(1, -(-total // RANK_SLICE))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in sliced.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    entries, _ = plan(histogram, capacity)
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = sliced.withColumn("in_slice", within - 1).join(before, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_slice")).drop("slice", "before", "in_slice")
    # A few entries for each length: the plan's size is set by the capacity.
    table = np.array([(e.length, e.rank, e.sequence, e.each, e.offset) for e in entries], dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])
    names = [f.name for f in ranked.schema]

    def make():
        entry = shared.value
        keys = (entry[:, 0] << 45) + entry[:, 1]

        def work(batch):
            if not batch.num_rows:
                return
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            own = entry[np.searchsorted(keys, (length << 45) + rank, side="right") - 1]
            step = rank - own[:, 1]
            columns = [batch.column(i) for i, n in enumerate(names) if n != "rank"]
            columns += [pa.array(own[:, 2] + step // own[:, 3]), pa.array(own[:, 4] + (step % own[:, 3]) * length)]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "rank"] + ["sequence_id", "offset"])

        return work

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_batches(ranked, make, f"{kept}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences as best fit finds; one row per piece."""
    pieces = written(token_pieces(docs, capacity, vocabulary, end_id, with_ids=with_ids), "token-pieces")
    return place(pieces, capacity)
