"""What the corpus operators share: written intermediates, folds, batches of texts as code arrays."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import checkpoint_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder of the session and read it back.

    The files outlive any executor, and what follows reads them instead of computing them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, keep: Column, limit: int | tuple[int, int], salt: str) -> DataFrame:
    """About ``limit`` (doc_id, text, label) rows at most for each label value, or limits for labels 0 and 1, chosen by a hash of id and salt.

    The bound is on rows that a classifier is fitted on; the hash makes the choice the same in every run. Rows with
    a null id or label take no part. A document with several labels counts once per different label.
    """
    marks = marks.where(keep & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}  # two rows
    share = [most / max(counts.get(value, 1), 1) for value, most in enumerate((limit, limit) if isinstance(limit, int) else limit)]
    ids = marks.where(hashed_share(F.col("doc_id"), salt, F.when(F.col("label") == 1, share[1]).otherwise(share[0])))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # about as many ids as the limits say


def hashed_share(key: Column, salt: str, share: Column) -> Column:
    """True for about the given share of keys (all from 1 on), by a hash of key and salt."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function built once per task."""

    def run(batches):
        work = make()
        for batch in batches:
            out = work(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def pieces(texts: Sequence[str | None], characters: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with at most so many characters together, or one longer text alone."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and total + size > characters:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def runs_of_texts(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of a column of texts with at most so many bytes together, or one longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        reach = size + (int(ends[start - 1]) if start else 0)
        end = max(start + 1, int(np.searchsorted(ends, reach, "right")))
        yield start, end
        start = end


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the end of each text in it."""
    texts = [t or "" for t in texts]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, ends


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def with_results(df: DataFrame, make: Callable[[], Callable[[list[str | None]], Sequence[pa.Array]]], added: str, text_column: str = "text") -> DataFrame:
    """``df`` with columns worked out from each row's text in the same pass, so that no join has to find the row again.

    ``added`` names and types the new columns; ``df`` must not have columns of those names.
    """
    names = list(df.columns)
    place = names.index(text_column)
    new = [part.split()[0] for part in added.split(", ")]

    def built():
        work = make()

        def run(batch):
            arrays = work(batch.column(place).to_pylist())
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *new])

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, built, f"{kept}, {added}")


def beside_results(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], Sequence[pa.Array]]], added: str, text_column: str = "text") -> DataFrame:
    """The row of ``docs`` as a struct ``doc``, so that its columns may have any name, and columns worked out from its text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    place = docs.columns.index(text_column)
    new = T.StructType.fromDDL(added)
    names = ["doc", *new.names]

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(batch.column(0).field(place).to_pylist())], names)

    return row.mapInArrow(run, T.StructType([*row.schema.fields, *new.fields]))
