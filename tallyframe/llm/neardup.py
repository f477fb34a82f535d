"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is the weighted set of its runs of five words (lower case, letters and digits; a shorter text is one run). A
run's weight is its count times log(1 + 1 / share), where share is the part of all documents that hold it, without a
bound. A crowd of near copies counts about once, however many they are: what its members share would otherwise be played
down because of the copies themselves, and a large group taken apart. So a first reading counts the keys of all documents
(hashes of four least runs each), a second one the runs of all documents, each document with one over the size of its
crowd: what a quarter of its keys are counted. Keys agree in a quarter at a similarity of about 0.7, so texts of which
less, say half of the runs, are common count one each, however many they are, and the common runs weigh little. Where two
texts are compared, they too count once: a run that both hold weighs as if one of them were not there.

Both readings count in a fixed number of hashed counters, whole numbers, so the weights do not depend on the order. What
other runs add to a counter on average is taken off, which leaves counts exact while runs are fewer than counters; with
more, the share of a rare run is known up to the spread of that average, a few documents in a hundred thousand.

Signatures: each of the samples is the run of least a = c / (y e^r), y = e^(r (t - b)), t = floor(ln w / r + b), with
r and c from Gamma(2, 1) and b uniform, drawn from tables by two independent hashes of the run. The least value itself
is the sample: two texts share it exactly if they chose the same run at the same t. Equal samples are as likely as the
weighted Jaccard similarity says, with the weights of single texts; what is verified lies a little above that. Bands of four
samples give candidate buckets.

Texts with the same words in the same order are one node, so copies never meet each other. In each bucket all nodes
are held against one pivot; what is still apart is held against two further pivots and the few nodes of the
bucket whose signatures agree best, which joins the parts of large groups. At last every pair of nodes of a bucket that
lie in different classes is compared in squares of a bounded number of nodes, by signatures and then by texts, and only
what joins two classes is emitted, so that no link between different texts is lost. Every link is verified by the exact weighted Jaccard similarity of the two texts. Classes
are the connected components; pairs within a class found so far are never looked at, let alone emitted.

Rows that share an id are one document: their texts are linked. Texts without words, null texts among them, are copies
of each other. A row with a null id cannot be named: its class is null, and ``deduplicated`` keeps it. Ties go to the
smallest id. Extra columns are not read; an empty table gives an empty result. Nodes are 64-bit hashes, so that two
different texts fall together with probability n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import code_points, map_batches, pieces, written

WORDS = 5
THRESHOLD = 0.8
COUNTERS = 1 << 21
COUNTER_CHUNKS = 16
COUNTED = 1 << 20  # keys gathered before they are counted
LEAST_RUNS, KEY_RUNS = 64, 4  # parts of a text's runs by key, each with a least run; how many of these name a crowd
MOST_KEYS = LEAST_RUNS // KEY_RUNS
ONE = 1 << 12  # what a document without near copies counts
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
TABLE = 1 << 15  # rows of each table of random numbers
ESTIMATE = 0.6  # share of equal samples under which a pair is not verified; four deviations below 0.8
PARTNERS = 3
BLOCK = 512  # nodes on a side of a square
BATCH_CHARACTERS = 100_000
LIMIT = 0x3000
MASK = np.uint64((1 << 48) - 1)
ODD = [np.uint64(int(v) | 1) for v in np.random.default_rng(21).integers(1 << 60, 1 << 63, 2 * WORDS + 4)]


@cache
def _word_characters() -> np.ndarray:
    """Lower-case code of letters and digits below the limit; 0 for the rest."""
    codes = np.zeros(LIMIT, dtype=np.uint32)
    for point in range(LIMIT):
        c = chr(point)
        if c.isalnum():
            low = c.lower()
            codes[point] = ord(low) if len(low) == 1 else point
    return codes


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(22).integers(1 << 60, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order, and the number of words of each text."""
    flat, ends = code_points([f"{t or ''} " for t in texts])
    low = _word_characters()[np.minimum(flat, LIMIT - 1)]
    beyond = flat >= LIMIT
    if beyond.any():
        points, place = np.unique(flat[beyond], return_inverse=True)
        low[beyond] = np.array([p if chr(p).isalnum() else 0 for p in points.tolist()], dtype=np.uint32)[place]
    inside = low > 0
    inside[ends - 1] = False
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, stops = change[0::2], change[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside)
    lengths = stops - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    terms = (low[at].astype(np.uint64) + np.uint64(0x10001)) * _multipliers()[place & 255]
    hashes = _mixed(np.add.reduceat(terms, first) ^ (lengths.astype(np.uint64) << np.uint64(50)))
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Owner, 48-bit key and count of each distinct run of each text, sorted by owner and key; the texts' nodes."""
    words, many = word_hashes(texts)
    n = len(texts)
    ends = np.cumsum(many)
    nodes = [int.from_bytes(hashlib.blake2b(words[e - m : e].tobytes(), digest_size=8).digest(), "little", signed=True) for e, m in zip(ends.tolist(), many.tolist(), strict=True)]
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), nodes
    runs = np.where(many > 0, np.maximum(many - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(n), runs)
    begin = np.repeat(ends - many, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    left = np.repeat(ends, runs) - begin  # words from here to the end of the text
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(begin), np.uint64)
    for k in range(WORDS):
        part = padded[begin + k] * ODD[k]
        if k:
            part[left <= k] = 0
        total += part
    keys = _mixed(total) & MASK
    packed = np.sort((owner.astype(np.uint64) << np.uint64(48)) | keys)
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    counts = np.diff(np.concatenate([first, [len(packed)]]))
    return (packed[first] >> np.uint64(48)).astype(np.int64), packed[first] & MASK, counts, nodes


def _counter(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(COUNTERS)).astype(np.int64)


def crowd_keys(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and key of up to ``MOST_KEYS`` groups of least runs of each text, fewer for short ones; near copies share most keys."""
    if not len(keys):
        return owner, keys
    part = (keys >> np.uint64(42)).astype(np.int64)  # runs of a text are sorted by key, so its parts follow each other
    first = np.flatnonzero(np.diff(owner * LEAST_RUNS + part, prepend=-1))
    owner, part, least = owner[first], part[first], keys[first]
    parts = 1 << np.clip(np.log2(np.maximum(np.bincount(owner, minlength=n), KEY_RUNS) / KEY_RUNS).astype(np.int64), 0, MOST_KEYS.bit_length() - 1)
    group = part * parts[owner] // LEAST_RUNS
    start = np.flatnonzero(np.diff(owner * MOST_KEYS + group, prepend=-1))
    named = _mixed(least)  # a sum of mixed keys, whatever their order
    return owner[start], _mixed(np.add.reduceat(named, start) + (parts[owner[start]] * MOST_KEYS + group[start]).astype(np.uint64))


def crowd_sizes(owner: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """The count that a quarter of each text's counts reach, 1 at least."""
    order = np.lexsort((many, owner))
    counts = np.bincount(owner, minlength=n)
    sizes = np.ones(n, np.int64)
    known = counts > 0
    sizes[known] = many[order][(np.cumsum(counts) - counts + 3 * counts // 4)[known]]
    return np.maximum(sizes, 1)


def _counted(docs: DataFrame, text_column: str, make) -> tuple[np.ndarray, int]:
    """Sums of ``COUNTERS`` hashed counters over all documents, and of one number more. Of constant size.

    ``make`` is called once a task for a function of the texts' (owner, keys, n) to counters, what to add, and the number.
    """
    part = COUNTERS // COUNTER_CHUNKS

    def rows(chunks: dict[int, np.ndarray]) -> pa.RecordBatch:
        kinds = [next(t for t in ("<u1", "<u2", "<u4", "<i8") if c.max() <= np.iinfo(t).max) for c in chunks.values()]
        packed = [pa.compress(c.astype(kind).tobytes(), "zstd", asbytes=True) for c, kind in zip(chunks.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array(kinds), pa.array(packed, pa.binary())], ["chunk", "kind", "counts"])

    def unpacked(chunk: int, kind: str, data: bytes) -> np.ndarray:
        size = np.dtype(kind).itemsize * (part if chunk < COUNTER_CHUNKS else 1)
        return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, counts, total, held, size = make(), np.zeros(COUNTERS, np.int64), 0, [], 0

        def settle() -> None:
            if held:
                places, added = (np.concatenate(parts) for parts in zip(*held, strict=True))
                counts[:] += np.bincount(places, added, minlength=COUNTERS).astype(np.int64)  # whole numbers below 2^53
                held.clear()

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in pieces(texts, BATCH_CHARACTERS):
                owner, keys, _, _ = shingles(texts[a:b])
                places, added, more = work(owner, keys, b - a)
                held.append((places, added))
                total, size = total + more, size + len(places)
                if size >= COUNTED:
                    settle()
                    size = 0
        settle()
        if total:
            yield rows(dict(enumerate([*np.split(counts, COUNTER_CHUNKS), np.array([total])])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, kind, data in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                values = unpacked(chunk, kind, data).astype(np.int64)
                total[chunk] = total[chunk] + values if chunk in total else values
        if total:
            yield rows(total)

    schema = "chunk int, kind string, counts binary"
    partial = docs.select(F.col(text_column)).mapInArrow(count, schema)
    summed = partial.repartition(COUNTER_CHUNKS + 1, "chunk").mapInArrow(add, schema).collect()  # COUNTERS numbers, packed
    found = {r["chunk"]: unpacked(*r) for r in summed}
    if not found:
        return np.zeros(COUNTERS, np.uint8), 0
    return np.concatenate([found[i] for i in range(COUNTER_CHUNKS)]), int(found[COUNTER_CHUNKS][0])


def weight_of(share):
    return np.log1p(1 / np.asarray(share))


class Weights:
    """Weights of runs that occur once, from the number of documents that hold the runs of each counter."""

    def __init__(self, held_by: np.ndarray, documents: float):
        self.held_by, self.documents = held_by, documents

    def alone(self, keys: np.ndarray) -> np.ndarray:
        """Weights of the runs of one text."""
        return weight_of(np.maximum(self.held_by[_counter(keys)], 1) / np.float32(self.documents))

    def shared(self, keys: np.ndarray) -> np.ndarray:
        """Weights of runs that two compared texts share, which count as one document."""
        return weight_of(np.maximum(self.held_by[_counter(keys)] - 1, 1) / np.float32(self.documents))


def run_weights(docs: DataFrame, text_column: str = "text") -> Weights:
    """Weights of runs, counted over all documents, near copies together about once."""

    def copies():
        def work(owner, keys, n):
            _, named = crowd_keys(owner, keys, n)
            return _counter(named), np.ones(len(named), np.int64), n

        return work

    counts, _ = _counted(docs, text_column, copies)
    # An upper quarter of keys is read below; nine in ten counters show what other keys add, so that a text alone counts as one.
    others = int(np.partition(counts, 9 * COUNTERS // 10)[9 * COUNTERS // 10])
    crowds = docs.sparkSession.sparkContext.broadcast(np.maximum(counts.astype(np.int64) - others, 1).astype(counts.dtype))  # COUNTERS numbers

    def runs():
        known = crowds.value

        def work(owner, keys, n):
            whose, named = crowd_keys(owner, keys, n)
            part = np.maximum(ONE // crowd_sizes(whose, known[_counter(named)].astype(np.int64), n), 1)
            return _counter(keys), part[owner], int(part.sum())

        return work

    counts, total = _counted(docs, text_column, runs)
    crowds.destroy()
    # What other runs add to a counter on average goes; a run that is met at all is held by one document at least.
    others = int(counts.sum(dtype=np.int64)) // COUNTERS
    return Weights((counts.astype(np.float32) - np.float32(others)) / np.float32(ONE), max(total / ONE, 1.0))


class Sampler:
    """Consistent weighted samples of runs, with the random numbers in two tables."""

    def __init__(self):
        random = np.random.default_rng(23)
        r = random.gamma(2, 1, (TABLE, SAMPLES)).astype(np.float32)
        b = random.random((TABLE, SAMPLES), dtype=np.float32)
        self.rb = np.stack([r, b, 1 / r], axis=1)
        self.c = np.log(random.gamma(2, 1, (TABLE, SAMPLES))).astype(np.float32)

    def signatures(self, owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """The least value of every sample for each of n texts; infinity for a text without runs."""
        out = np.full((n, SAMPLES), np.inf, np.float32)
        one, two = (keys % np.uint64(TABLE)).astype(np.int64), ((keys >> np.uint64(24)) % np.uint64(TABLE)).astype(np.int64)
        logs = np.log(weights)[:, None].astype(np.float32)
        for a in range(0, len(keys), 1024):
            own = owner[a : a + 1024]
            found = self.rb[one[a : a + 1024]]
            r, b, values = found[:, 0], found[:, 1], found[:, 2]
            # c - r (t - b) - r with t = floor(ln w / r + b)
            values *= logs[a : a + 1024]
            values += b
            np.floor(values, out=values)
            values -= b
            values += 1
            values *= r
            np.subtract(self.c[two[a : a + 1024]], values, out=values)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            least = np.minimum.reduceat(values, starts, axis=0)
            out[own[starts]] = np.minimum(out[own[starts]], least)
        return out


@cache
def _sampler() -> Sampler:
    return Sampler()


def _buckets(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band."""
    bits = signatures.view(np.uint32).reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    total = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[-1]
    for k in range(ROWS):
        total = _mixed(total + bits[:, :, k] * ODD[WORDS + k])
    return total.view(np.int64)


def sign(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """(doc_id, node, signature, buckets) of every document with an id. ``docs`` has doc_id and text."""

    def make():
        known, sampler = weights.value, _sampler()

        def work(batch):
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts, BATCH_CHARACTERS):
                owner, keys, counts, nodes = shingles(texts[a:b])
                found = sampler.signatures(owner, keys, known.alone(keys) * counts.astype(np.float32), b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(_buckets(found).tolist(), pa.list_(pa.int64()))],
                    ["doc_id", "node", "signature", "buckets"],
                )

        return work

    return map_batches(docs, make, "doc_id bigint, node bigint, signature binary, buckets array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Similarity of two weighted sets, each as sorted keys with weights, and the weights of shared keys if they differ; 1 for two empty ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    one, two = a[-1][i], b[-1][j]
    both = float(np.minimum(one, two).sum(dtype=np.float64))
    apart = sum(float(weights.sum(dtype=np.float64) - weights[k].sum(dtype=np.float64)) for weights, k in ((a[1], i), (b[1], j)))
    total = apart + float(np.maximum(one, two).sum(dtype=np.float64))
    return both / total if total > 0 else 1.0


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose signatures agree often enough to be verified."""
    one = signed.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = signed.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def make():
        def work(batch):
            if not batch.num_rows:
                return
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SAMPLES) for i in (2, 3))
            keep = pa.array((left == right).mean(axis=1) >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        return work

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), make, "a bigint, b bigint")


def _texts_of(nodes: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) for the given nodes: all their documents' ids are known, one document's text is read."""
    ids = signed.select("node", "doc_id").join(nodes, "node")
    found = docs.join(ids, "doc_id").select("node", "text")

    def make():
        def work(batch):
            texts, wanted = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in pieces(texts, 10 * BATCH_CHARACTERS):
                keep = pa.array([n == w for n, w in zip(shingles(texts[a:b])[3], wanted[a:b], strict=True)], pa.bool_())
                yield batch.slice(a, b - a).filter(keep)  # an id may stand for several texts

        return work

    return map_batches(found, make, "node bigint, text string")


def verified(pairs: DataFrame, texts: DataFrame, weights: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the pairs of nodes whose texts are alike."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def make():
        known = weights.value

        def sets(found: dict[int, str]) -> dict[int, tuple[np.ndarray, ...]]:
            out, names, texts = {}, list(found), list(found.values())
            for i, j in pieces(texts, BATCH_CHARACTERS):
                owner, keys, counts, _ = shingles(texts[i:j])
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                parts = (keys, *[w(keys) * counts.astype(np.float32) for w in (known.alone, known.shared)])
                for k in range(j - i):
                    out[names[i + k]] = tuple(part[cuts[k] : cuts[k + 1]] for part in parts)
            return out

        def work(batch):
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = dict(zip(a, part.column(2).to_pylist(), strict=True)) | dict(zip(b, part.column(3).to_pylist(), strict=True))
                known = sets(found)
                likeness = np.array([weighted_jaccard(known[x], known[y]) for x, y in zip(a, b, strict=True)])
                keep = likeness >= threshold
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep)), pa.array(likeness[keep])], ["a", "b", "similarity"])

        return work

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return map_batches(joined, make, "a bigint, b bigint, similarity double")


def components(links: DataFrame) -> DataFrame | None:
    """(node, label): the least node of each connected component of the links (a, b); None without links."""
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = written(links.select(F.explode(F.array(there, back)).alias("link")).select("link.a", "link.b").distinct(), "links")
    if both.isEmpty():
        return None
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        # The least label among the neighbours, then the label of that label: paths halve with each round.
        near = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        least = label.join(near, "node").select("node", F.least("label", "l").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        label = written(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        # Labels are nodes of their component, and none exceeds its node: without a link between two labels all are least.
        if _between(both.where("a < b"), [label]).isEmpty():
            return label


def _classed(members: DataFrame, labels: list[DataFrame]) -> DataFrame:
    """``members`` with the label of their node; each of ``labels`` names classes of those before it."""
    members = members.withColumn("label", F.col("node"))
    for found in labels:
        further = found.select(F.col("node").alias("label"), F.col("label").alias("further"))
        members = members.join(further, "label", "left").withColumn("label", F.coalesce("further", "label")).drop("further")
    return members


def _between(links: DataFrame, labels: list[DataFrame]) -> DataFrame:
    """The links (a, b) of nodes as links of their classes, without those inside a class."""
    for end, other in (("a", "b"), ("b", "a")):
        links = _classed(links.select(F.col(end).alias("node"), other), labels).select(F.col("label").alias(end), other)
    return links.where("a <> b").select("a", "b")


def _apart(members: DataFrame) -> DataFrame:
    """Members (bucket, node, label) of buckets with several classes, with the least label of the bucket."""
    ends = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return members.join(ends.select("bucket", "low"), "bucket")


def _further_pivots(apart: DataFrame) -> DataFrame:
    """What lies outside a bucket's first class, against the first outsider and the first class's last node."""
    outside = F.col("label") != F.col("low")
    pivots = apart.groupBy("bucket").agg(F.min(F.when(outside, F.col("node"))).alias("p"), F.max(F.when(~outside, F.col("node"))).alias("q"))
    rows = apart.where(outside).join(pivots, "bucket")
    return rows.select(F.col("node").alias("a"), F.explode(F.array("p", "q")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grid(apart: DataFrame, nodes: DataFrame):
    """The nodes outside a bucket's first class (they ask) against all its nodes, in squares of ``BLOCK`` by ``BLOCK``.

    ``nodes`` has the node and what the comparison needs. A task gets one square, however large the bucket is.
    """
    sizes = apart.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if(F.col("label") != F.col("low")).alias("l"))
    rows = apart.join(sizes, "bucket").join(nodes, "node")
    blocks, asking = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("m", "l"))
    own = [F.col(c) for c in ("node", "label", "low", *[c for c in nodes.columns if c != "node"])]

    def within(n):
        return F.pmod(F.xxhash64("node"), n).cast("int")

    members = rows.select("bucket", within(blocks).alias("block"), F.explode(F.sequence(F.lit(0), asking - 1)).alias("part"), *own, F.lit(False).alias("asks"))
    askers = rows.where("label <> low").select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), within(asking).alias("part"), *own, F.lit(True).alias("asks"))
    return members.unionByName(askers).groupBy("bucket", "block", "part")


def _square(table: pa.Table):
    """Columns of a square, and for each asking row the rows that it has to be compared with, best first.

    A pair that meets in several buckets is compared in the first of them, and a pair of two asking nodes once.
    """
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    node, label, low = (table.column(c).to_numpy() for c in ("node", "label", "low"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, SAMPLES)
    bucket = table.column("bucket")[0].as_py()
    band = int((_buckets(signature[:1].view(np.float32))[0] == bucket).argmax())
    these = np.flatnonzero(~asks)

    def partners(q: int) -> np.ndarray:
        equal = signature[these] == signature[q]
        first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        once = (label[these] == low[these]) | (node[these] < node[q])
        share = equal.mean(axis=1) * (first & once & (label[these] != label[q]))
        hit = np.flatnonzero(share >= ESTIMATE)
        return these[hit[np.argsort(-share[hit], kind="stable")]]

    return node, label, np.flatnonzero(asks).tolist(), partners


def _closest(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of each node outside a bucket's first class with the few nodes of a square whose signatures agree best."""

    def compare(key, table):
        node, _, asking, partners = _square(table)
        found = [(q, p) for q in asking for p in partners(q)[:PARTNERS].tolist()]
        a, b = (np.array([x[i] for x in found], dtype=np.int64) for i in (0, 1))
        return pa.table({"a": np.minimum(node[a], node[b]) if len(a) else a, "b": np.maximum(node[a], node[b]) if len(a) else b})

    return _grid(apart, nodes.select("node", "signature")).applyInArrow(compare, "a bigint, b bigint").distinct()


def _joining(apart: DataFrame, nodes: DataFrame, texts: DataFrame, weights: Broadcast, threshold: float) -> DataFrame:
    """Verified links that join different classes: every pair of a bucket that can be one is looked at.

    Texts are compared inside a square, and only links that join what is still apart in it are emitted.
    """

    def compare(key, table):
        node, label, asking, partners = _square(table)
        owner, keys, counts, _ = shingles(table.column("text").to_pylist())
        weight, shared = ((w(keys) * counts.astype(np.float32)).astype(float) for w in (weights.value.alone, weights.value.shared))
        cuts = np.searchsorted(owner, np.arange(len(node) + 1))
        kinds, place = np.unique(keys, return_inverse=True)
        total = np.bincount(owner, weight, minlength=len(node))
        dense, dense_shared = np.zeros(len(kinds)), np.zeros(len(kinds))
        group = {}

        def root(x):
            while group.get(x, x) != x:
                x = group[x]
            return x

        a, b = [], []
        for q in asking:
            mine = slice(cuts[q], cuts[q + 1])
            dense[place[mine]], dense_shared[place[mine]] = weight[mine], shared[mine]
            for p in partners(q).tolist():
                one, two = root(int(label[q])), root(int(label[p]))
                if one == two:
                    continue
                part = slice(cuts[p], cuts[p + 1])
                mutual = dense[place[part]] > 0
                at, own, other = place[part][mutual], shared[part][mutual], dense_shared[place[part][mutual]]
                both = float(np.minimum(own, other).sum())
                every = total[q] + total[p] - float(dense[at].sum() + weight[part][mutual].sum()) + float(np.maximum(own, other).sum())
                if (both / every if every > 0 else 1.0) >= threshold:
                    group[max(one, two)] = min(one, two)
                    a.append(int(node[q]))
                    b.append(int(node[p]))
            dense[place[mine]] = dense_shared[place[mine]] = 0
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _grid(apart, nodes.select("node", "signature").join(texts, "node")).applyInArrow(compare, "a bigint, b bigint")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every distinct id of ``docs`` (doc_id, text); class_id is the least id of the class."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    weights = docs.sparkSession.sparkContext.broadcast(run_weights(docs))  # COUNTERS numbers
    signed = written(sign(named, weights), "signatures")
    nodes = written(signed.select("node", "signature", "buckets").dropDuplicates(["node"]), "nodes")
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("bucket", "pivot")
    members = written(placed.join(shared, "bucket"), "members")
    # Texts of one id are one document.
    same = signed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("doc_id", "b")
    links = signed.select("doc_id", F.col("node").alias("a")).join(same, "doc_id").where("a <> b").select("a", "b")

    texts = written(_texts_of(members.select("node").distinct(), signed.groupBy("node").agg(F.min("doc_id").alias("doc_id")), named), "texts")
    pivots = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = links.unionByName(verified(_alike(pivots, nodes), texts, weights, threshold).select("a", "b"))
    labels = [found] if (found := components(links)) is not None else []
    steps = [
        lambda apart: verified(_alike(_further_pivots(apart), nodes).unionByName(_closest(apart, nodes)).distinct(), texts, weights, threshold).select("a", "b"),
        lambda apart: _joining(apart, nodes, texts, weights, threshold),
    ]
    for step in steps:
        apart = written(_apart(_classed(members.select("bucket", "node"), labels)), "apart")
        if apart.isEmpty():
            break
        # Only classes are joined from here on, so each step's graph is as small as what it found.
        if (found := components(_between(step(apart), labels))) is not None:
            labels.append(found)
    weights.destroy()  # all that follows reads written tables
    rows = _classed(signed.select("doc_id", "node").distinct(), labels)
    least = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    found = rows.select("doc_id", "label").distinct().join(least, "label").select("doc_id", "class_id")
    return found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, representative) for every document; null for rows without an id."""
    found = classes(docs, threshold).withColumn("representative", F.col("doc_id") == F.col("class_id"))
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("boolean").alias("representative"))
    return found.unionByName(unnamed)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, of its least id, with all columns; rows without an id stay.

    Of several rows with that id the one with the least hash of its columns is kept, so a retry keeps the same one.
    """
    keep = classes(docs, threshold).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = row.join(keep, F.col("doc.doc_id") == F.col("kept_id"), "left_semi")
    one = kept.groupBy(F.col("doc.doc_id").alias("id")).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return one.select("doc.*").unionByName(docs.where("doc_id is null"))
