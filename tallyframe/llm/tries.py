"""Spelling variants by a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. Nodes are numbered in one
pass over the sorted words: a word shares the nodes of its common prefix with the word before it and gets new numbers for
the rest, so a task holds one path at a time. Slices of the sorted words are numbered apart; where a slice begins inside
the path that the one before ended with, its first nodes take that path's numbers, so a node has one number everywhere.

A word of length L has the pairs (prefix i - 1, suffix L - i) around each skipped letter i, and the pairs (prefix i,
suffix L - i) around each place where a letter could be put in. Two words with the same skipping pair differ by one
replaced letter; a skipping pair of one that is a pair of places of the other tells a deleted letter. Of equal letters in
a row only the first is skipped for a deletion, so every two neighbours meet in exactly one row, and a meeting proves the
distance: integers are compared, never texts, and nothing is left to verify. A pair is shared by no more words than there
are letters, so no key of the join can grow hot.

A word's form is its neighbour with the largest count if that is twice its own count, so along forms the counts at least
double. A chain therefore has at most log2(largest / least count) steps, and so many roots are found by doubling pointers
in the logarithm of that number of joins.

Null and empty texts have no words; a null id counts as an empty one where a run's letter is chosen. Repeated rows count
each time. Ties go to the smaller word in code-point order. Texts are taken whole, runs of any length. Other columns are
not read and may have any name. An empty table, or one without frequent words, gives an empty result.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SPOILT = 97  # a run loses a letter where this divides its hash
LEAST_LETTERS, LEAST_COUNT = 5, 3
SLICE_WORDS, MOST_SLICES = 50_000, 2_000  # words of a slice, as long as there are no more slices than this
SLICE_BITS = 40  # numbers of a slice


def spoilt(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the hash of id and run says so."""
    code = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (code % F.length(run)).cast("int")
    return F.when(code % SPOILT == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    lowered = F.translate(F.col("run"), string.ascii_uppercase, string.ascii_lowercase)
    words = runs.select(spoilt(F.col("doc_id"), lowered).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same


def numbered(words: DataFrame, key: str, slices: int) -> tuple[DataFrame, dict[int, int]]:
    """``words`` with slice, id (in the order of ``key``) and path, the node of each prefix; and the nodes to renumber.

    A node at the start of a slice that an earlier slice has as well is renumbered to the earlier number.
    """
    names = words.columns
    place = names.index(key)

    def run(batches):
        part = TaskContext.get().partitionId()
        nodes = seen = 0
        last, path = "", [0]
        for batch in batches:
            ids, paths = [], []
            for word in batch.column(place).to_pylist():
                same = shared(last, word)
                first = (part << SLICE_BITS) + nodes + 1
                path = [*path[: same + 1], *range(first, first + len(word) - same)]
                nodes, last = nodes + len(word) - same, word
                ids.append((part << SLICE_BITS) + seen)
                paths.append(path)
                seen += 1
            added = [pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "slice", "id", "path"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", slice int, id bigint, path array<bigint>"
    found = written(words.repartitionByRange(slices, key).sortWithinPartitions(key).mapInArrow(run, schema), f"trie-{key}")
    ends = found.groupBy("slice").agg(F.min(F.struct(key, "path")).alias("first"), F.max(F.struct(key, "path")).alias("last"))
    renumbered: dict[int, int] = {}
    before = None
    for row in sorted(ends.collect(), key=lambda r: r["slice"]):  # one row per slice
        word, path = row["first"]
        if before is not None:
            for depth in range(1, shared(before[0], word) + 1):
                renumbered[path[depth]] = renumbered.get(before[1][depth], before[1][depth])
        before = row["last"]
    return found, renumbered


def renumber(paths: pa.ListArray, nodes: dict[int, int]) -> pa.ListArray:
    values = paths.values.to_numpy(zero_copy_only=False)
    old = np.array(sorted(nodes), dtype=np.int64)
    new = np.array([nodes[node] for node in old.tolist()], dtype=np.int64)
    place = np.minimum(np.searchsorted(old, values), len(old) - 1)
    return pa.ListArray.from_arrays(paths.offsets, pa.array(np.where(old[place] == values, new[place], values)))


def node_paths(words: DataFrame) -> DataFrame:
    """(id, word, n, path, back): each word's nodes in the forward trie and, by suffix length, in the reversed one."""
    slices = min(MOST_SLICES, max(1, -(-words.count() // SLICE_WORDS)))
    ahead, ahead_nodes = numbered(words, "word", slices)
    behind, behind_nodes = numbered(words.select(F.reverse("word").alias("drow")), "drow", slices)
    both = ahead.select("id", "word", "n", "path").join(behind.select(F.reverse("drow").alias("word"), F.col("path").alias("back")), "word")
    both = both.select("id", "word", "n", "path", "back")

    def run(batches):
        for batch in batches:
            path, back = batch.column(3), batch.column(4)
            if ahead_nodes:
                path = renumber(path, ahead_nodes)
            if behind_nodes:
                back = renumber(back, behind_nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], path, back], ["id", "word", "n", "path", "back"])

    return written(both.mapInArrow(run, "id bigint, word string, n bigint, path array<bigint>, back array<bigint>"), "trie-words")


def node_pairs(words: DataFrame) -> DataFrame:
    """(ahead, behind, id, n, skips, first): the pairs around every letter and around every place between letters.

    ``first`` is true where the letter before the skipped one is another.
    """
    length = F.size("path") - 1
    letter = F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.struct(
            F.get("path", i - 1).alias("ahead"), F.get("back", length - i).alias("behind"), F.lit(True).alias("skips"),
            ((i == 1) | (F.substring("word", i, F.lit(1)) != F.substring("word", i - 1, F.lit(1)))).alias("first"),
        ),
    )
    between = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(F.get("path", i).alias("ahead"), F.get("back", length - i).alias("behind"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    return words.select("id", "n", F.explode(F.concat(letter, between)).alias("pair")).select("pair.*", "id", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, near_id, near_n): every two words of ``node_paths`` that differ by one letter, in both directions, once."""
    pairs = node_pairs(words)
    one = pairs.where("skips").select("ahead", "behind", F.struct("id", "n").alias("a"), "first")
    other = pairs.select("ahead", "behind", F.struct("id", "n").alias("b"), "skips")
    met = one.join(other, ["ahead", "behind"]).where(F.when(F.col("skips"), F.col("a.id") != F.col("b.id")).otherwise(F.col("first")))
    there, back = F.struct("a.id", F.col("b.id").alias("near_id"), F.col("b.n").alias("near_n")), F.struct("b.id", F.col("a.id").alias("near_id"), F.col("a.n").alias("near_n"))
    # A replacement is met from both sides, a deletion from the longer word only.
    return met.select(F.explode(F.when(F.col("skips"), F.array(there)).otherwise(F.array(there, back))).alias("m")).select("m.*")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(id, root): the end of each chain of (id, form), whose chains have at most ``longest`` steps."""
    found = forms.select("id", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = found.select(F.col("id").alias("root"), F.col("root").alias("further"))
        found = written(found.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "roots")
    return found


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = node_paths(written(vocabulary(docs), "vocabulary"))
    # Ids are in code-point order, so the least id breaks a tie.
    best = neighbours(words).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near_id")).alias("near"))).alias("best"))
    known = words.select("id", "word", "n").join(best, "id", "left")
    follows = F.col("best.near_n") >= 2 * F.col("n")
    known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(follows, -F.col("best.near")).alias("form_id"), F.when(follows, F.col("best.near_n")).alias("form_n"))
    known = written(known, "variants")
    most = known.agg(F.max("n")).first()[0] or LEAST_COUNT
    ends = roots(known.where("form_id is not null").select("id", F.col("form_id").alias("form")), int(math.log2(most / LEAST_COUNT)) + 1)
    names = known.select(F.col("id").alias("k"), F.col("word").alias("name"))
    out = known.join(ends, "id", "left")
    out = out.join(names.withColumnRenamed("name", "form"), F.col("form_id") == F.col("k"), "left").drop("k")
    out = out.join(names.withColumnRenamed("name", "end"), F.col("root") == F.col("k"), "left").drop("k")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
