"""Token-id output in bit planes: fixed-size id blocks, transposed into planes that zstandard compresses one by one.

A file holds whole documents in ascending order:

    magic ``TFBP``, version, plane kind (1 bit planes, 8 byte planes), ids of a block, number of documents, of ids, of
    blocks; the documents' ids and token numbers; the chunk index: for each block and plane its place and size;
    then the compressed planes.

A plane of zeros has size 0 and no bytes. Any block can be read alone through the index. Files are the rows of a
written table (bucket, number in the bucket, content), so that executors write and read them through Spark's own
committed output, in whatever store the session names.

Documents are ordered by id; rows with a null id come first. Rows of one id are in an order that their texts alone decide,
so an id with very many rows is spread over several tasks. A null text has the end id alone. Extra columns are not read. An empty table gives empty files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import crc32, map_batches, runs_of_texts, written
from tallyframe.llm.tokens import TEXT_BYTES, word_encoder

MAGIC, VERSION = b"TFBP", 1
HEADER = struct.Struct("<4sBBHIQQI")
BIT_PLANES, BYTE_PLANES = 1, 8
BLOCK_IDS = 1 << 15
FILE_IDS = 1 << 20  # a file is closed after the document that reaches this
ROWS_OF_A_BUCKET = 4_000  # documents of an id range that one task writes, about, up to so many ranges:
MOST_BUCKETS = 20_000
NO_ID = -(1 << 63)  # stands for a null id in the order
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def _planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The block's ids as 32 bit planes or 4 byte planes, least significant first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE_PLANES:
        return [raw[:, j].tobytes() for j in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, j], bitorder="little").tobytes() if bits[:, j].any() else b"" for j in range(32)]


def _ids(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE_PLANES:
        raw = np.zeros((n, 4), np.uint8)
        for j, plane in enumerate(planes):
            if plane:
                raw[:, j] = np.frombuffer(plane, np.uint8)
        return raw.reshape(-1).view("<u4").astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for j, plane in enumerate(planes):
        if plane:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(j)
    return out


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, kind: int = BYTE_PLANES, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """One file of whole documents."""
    press = zstandard.ZstdCompressor(level=level)
    index, chunks, place = [], [], 0
    for start in range(0, len(ids), block):
        for plane in _planes(ids[start : start + block], kind):
            data = press.compress(plane) if plane.strip(b"\0") else b""
            index.append((place, len(data)))
            chunks.append(data)
            place += len(data)
    blocks = -(-len(ids) // block)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = HEADER.pack(MAGIC, VERSION, kind, 0, block, len(doc_ids), len(ids), blocks)
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), np.array(index, "<u8").tobytes(), *chunks])


class PlaneFile:
    """A packed file: its documents, and its ids by block or whole."""

    def __init__(self, content: bytes):
        magic, version, self.kind, _, self.block, documents, self.total, self.blocks = HEADER.unpack_from(content)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a bit-plane file")
        at = HEADER.size
        known = np.frombuffer(content, np.uint8, documents, at)
        at += documents
        raw = np.frombuffer(content, "<i8", documents, at)
        self.doc_ids = [int(d) if k else None for d, k in zip(raw, known, strict=True)]
        at += 8 * documents
        self.lengths = np.frombuffer(content, "<i8", documents, at)
        at += 8 * documents
        planes = 4 if self.kind == BYTE_PLANES else 32
        self.index = np.frombuffer(content, "<u8", 2 * planes * self.blocks, at).reshape(self.blocks, planes, 2)
        self.data, self.content = at + 16 * planes * self.blocks, content
        self.press = zstandard.ZstdDecompressor()

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.total - k * self.block)
        planes = []
        for place, size in self.index[k].tolist():
            start = self.data + place
            planes.append(self.press.decompress(self.content[start : start + size]) if size else b"")
        return _ids(planes, n, self.kind)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read_block(k) for k in range(self.blocks)]) if self.blocks else np.empty(0, np.uint32)


def _bounds(docs: DataFrame, id_column: str) -> list[int]:
    """Ascending ids that cut the table into ranges of about ``ROWS_OF_A_BUCKET`` rows, ``MOST_BUCKETS`` ranges at most.

    Beyond that the ranges grow, which a task streams through. An id that holds several ranges' rows occurs as often.
    """
    count = docs.select(id_column).count()
    parts = max(1, min(MOST_BUCKETS, -(-count // ROWS_OF_A_BUCKET)))
    if parts == 1:
        return []
    cuts = [i / parts for i in range(1, parts)]
    ids = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"))
    return ids.agg(F.percentile_approx("id", cuts, min(100 * parts, 200_000)).alias("b")).first()["b"]


def buckets_of(bounds: np.ndarray, keys: pa.Array, texts: list[str | None]) -> np.ndarray:
    """Range of each document: ranges ascend with the id, and an id that is a bound is dealt to all ranges it touches by its text."""
    own = pc.fill_null(keys.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
    out, high = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
    for i in np.flatnonzero(out != high).tolist():
        out[i] += zlib.crc32((texts[i] or "").encode("utf-8", "surrogatepass")) % int(high[i] - out[i] + 1)
    return out.astype(np.int32)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, bucket, ids as packed bytes): the ids of every whole text with the end id; buckets ascend with the id."""
    bounds = _bounds(docs, id_column)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, dtype=np.int64))  # MOST_BUCKETS ids at most

    def make():
        encoder = word_encoder(vocabulary)
        edges = shared.value

        def work(batch):
            keys = batch.column(0)
            for start, end in runs_of_texts(batch.column(1), TEXT_BYTES):
                part = keys.slice(start, end - start)
                texts = batch.column(1).slice(start, end - start).to_pylist()
                flat, ends = encoder.encode_flat(texts)
                ids = np.insert(flat, ends, end_id)
                places = np.append(0, ends + np.arange(1, len(part) + 1)) * ids.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part, pa.array(buckets_of(edges, part, texts)), packed], ["doc_id", "bucket", "ids"])

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(F.col(id_column), F.col(text_column)), make, f"doc_id {kind}, bucket int, ids binary")


def write_files(docs: DataFrame, kind: int = BYTE_PLANES, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", label: str = "token-planes") -> DataFrame:
    """Write all ids in ascending document order and return the written table (bucket, number, n_ids, content)."""
    encoded = encode_documents(docs, vocabulary, end_id, id_column, text_column)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Ids are shuffled, not texts; a task streams its buckets in order and holds one file at a time.
    ordered = encoded.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")

    def make():
        width = word_encoder(vocabulary).width

        def close(bucket, number, keys, sizes, chunks):
            ids = np.concatenate(chunks).astype(np.uint32) if chunks else np.empty(0, np.uint32)
            content = pack_file(keys, sizes, ids, kind)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary())], ["bucket", "number", "n_ids", "content"])

        return width, close

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, close = make()
        bucket, number, keys, sizes, chunks, held = None, 0, [], [], [], 0
        for batch in batches:
            for key, b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if keys and (b != bucket or held >= FILE_IDS):
                    yield close(bucket, number, keys, sizes, chunks)
                    number = number + 1 if b == bucket else 0
                    keys, sizes, chunks, held = [], [], [], 0
                bucket = b
                ids = np.frombuffer(packed, width)
                keys.append(key)
                sizes.append(len(ids))
                chunks.append(ids)
                held += len(ids)
        if keys:
            yield close(bucket, number, keys, sizes, chunks)

    return written(ordered.mapInArrow(run, "bucket int, number int, n_ids bigint, content binary"), label)


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    # One row for each file decides where its ids start; the window without a key runs over MOST_BUCKETS rows at most.
    sizes = files.select("bucket", "number", "n_ids")
    in_bucket = Window.partitionBy("bucket").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("bucket_ids"))
    before = totals.select("bucket", F.coalesce(F.sum("bucket_ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"))
    starts = sizes.withColumn("in_bucket", F.coalesce(F.sum("n_ids").over(in_bucket), F.lit(0))).join(before, "bucket")
    starts = starts.select("bucket", "number", (F.col("bucket_start") + F.col("in_bucket")).alias("file_start"))

    def make():
        def work(batch):
            for b, number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                file = PlaneFile(content.as_py())
                ids = file.ids()
                ends = np.cumsum(file.lengths)
                start = ends - file.lengths
                sums = [crc32(ids[a:e]) for a, e in zip(start.tolist(), ends.tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(file.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["bucket", "number", "doc_id", "in_file", "n_tokens", "ids_crc32"],
                )

        return work

    read = map_batches(files.select("bucket", "number", "content"), make, "bucket int, number int, doc_id bigint, in_file bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(starts, ["bucket", "number"]).select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
