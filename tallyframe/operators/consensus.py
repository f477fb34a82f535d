"""Agreement among overlapping observations of one natural key.

A field agrees when its smallest and largest non-null values are equal. Minimum and maximum combine
on the map side, so a key repeated very often costs one partial row per task, and no distinct
values are collected.

Text is compared by two 64-bit hashes: numbers fit a hash aggregate, while a minimum of text would
have the facts sorted before they are combined. The text of an agreed key then comes from the field's
dictionary, one row per distinct value. If two texts of a dictionary share both hashes, their keys
count as conflicting, so a collision never passes as agreement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """The fields to compare by hashes. A stream cannot be joined with its own dictionary and compares the text itself."""
    return [] if df.isStreaming else [f for f in fields if isinstance(df.schema[f].dataType, (T.StringType, T.BinaryType))]


def _codes(field: str) -> tuple[Column, Column]:
    known = F.col(field).isNotNull()
    return F.when(known, F.xxhash64(field)), F.when(known, F.xxhash64(F.lit(1), F.col(field)))


def _coded(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Both hashes in place of each text field, as ``_a_<field>`` and ``_b_<field>``."""
    codes = {f"_{part}_{f}": code for f in texts for part, code in zip("ab", _codes(f), strict=True)}
    return df.withColumns(codes) if codes else df


def _compared(fields: Sequence[str], texts: Sequence[str]) -> list[str]:
    return [c for f in fields for c in ((f"_a_{f}", f"_b_{f}") if f in texts else (f,))]


def _dictionary(df: DataFrame, field: str) -> DataFrame:
    """(_ka, _kb, _words): the texts of each pair of hashes, one unless they collide."""
    words = df.where(F.col(field).isNotNull()).groupBy(*[c.alias(n) for n, c in zip(("_ka", "_kb"), _codes(field), strict=True)], F.col(field).alias("_word")).agg(F.lit(1).alias("_one"))
    return words.groupBy("_ka", "_kb").agg(F.collect_list("_word").alias("_words"))


def _agreed(grouped: DataFrame, df: DataFrame, fields: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """``grouped`` with ``_lo_`` and ``_hi_`` of the compared columns, these replaced by each field and ``_x_<field>``."""
    for f in texts:
        lo, hi = ([F.col(f"_{side}__{part}_{f}") for part in "ab"] for side in ("lo", "hi"))
        same = (lo[0] == hi[0]) & (lo[1] == hi[1])
        words = _dictionary(df, f)
        grouped = grouped.join(words, same & (hi[0] == F.col("_ka")) & (hi[1] == F.col("_kb")), "left")
        known = F.size("_words") == 1
        # Unequal hashes have no entry and a colliding entry has several texts: a conflict either way.
        grouped = grouped.withColumn(f"_x_{f}", lo[0].isNotNull() & ~F.coalesce(known, F.lit(False))).withColumn(f, F.when(known, F.get("_words", F.lit(0)))).drop("_ka", "_kb", "_words")
    for f in fields:
        if f not in texts:
            same = F.col(f"_lo_{f}") == F.col(f"_hi_{f}")
            grouped = grouped.withColumn(f, F.when(same, F.col(f"_hi_{f}"))).withColumn(f"_x_{f}", F.coalesce(~same, F.lit(False)))
    compared = _compared(fields, texts)
    return grouped.drop(*[f"_{side}_{c}" for c in compared for side in ("lo", "hi")])


def _with_conflict_list(grouped: DataFrame, fields: Sequence[str]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.col(f"_x_{f}"), F.lit(f)) for f in fields]))
    listed = grouped.withColumn("conflict_fields", names).drop(*[f"_x_{f}" for f in fields])
    return listed.withColumn("conflict_field_count", F.size("conflict_fields").cast("bigint"))


def field_consensus(df: DataFrame, keys: Sequence[str], fields: Sequence[str], rows: Column | None = None) -> DataFrame:
    """One row per key: a field keeps its value when all non-null variants agree, else null and listed.

    ``rows`` is the number of raw rows an observation stands for (1 when absent).
    """
    texts = _texts(df, fields)
    compared = _compared(fields, texts)
    grouped = _coded(df, texts).groupBy(*keys).agg(
        F.count("*").alias("observation_variant_count"),
        F.sum(F.lit(1).cast("bigint") if rows is None else rows).alias("raw_source_row_count"),
        *[c for f in compared for c in (F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"))],
    )
    return _in_order(_agreed(grouped, df, fields, texts), [*keys, "observation_variant_count", "raw_source_row_count"], fields)


def _in_order(agreed: DataFrame, first: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return _with_conflict_list(agreed.select(*first, *fields, *[f"_x_{f}" for f in fields]), fields)


def snapshot_consensus(
    df: DataFrame, keys: Sequence[str], fields: Sequence[str], snapshot: str, rows: Column | None = None
) -> DataFrame:
    """Field consensus across snapshots, with the sorted list of snapshots behind each key.

    Observations are first reduced to one row per key and snapshot, which bounds the list by the
    number of snapshots and keeps a heavily repeated key small.
    """
    texts = _texts(df, fields)
    compared = _compared(fields, texts)
    low_high = [c for f in compared for c in (F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"))]
    per_snapshot = _coded(df, texts).groupBy(*keys, snapshot).agg(
        F.count("*").alias("_variants"), F.sum(F.lit(1).cast("bigint") if rows is None else rows).alias("_rows"), *low_high
    )
    grouped = per_snapshot.groupBy(*keys).agg(
        F.count("*").alias("source_snapshot_count"),
        F.sort_array(F.collect_list(snapshot)).alias("source_snapshot_ids"),
        F.sum("_variants").alias("observation_variant_count"),
        F.sum("_rows").alias("raw_source_row_count"),
        *[c for f in compared for c in (F.min(f"_lo_{f}").alias(f"_lo_{f}"), F.max(f"_hi_{f}").alias(f"_hi_{f}"))],
    )
    first = [*keys, "source_snapshot_count", "source_snapshot_ids", "observation_variant_count", "raw_source_row_count"]
    return _in_order(_agreed(grouped, df, fields, texts), first, fields)


def family_faults(links: DataFrame, definitions: DataFrame, family: Sequence[str]) -> DataFrame:
    """Faults that forbid mixing snapshots: an unlinked or mislinked normalisation, or mixed versions.

    ``links`` holds distinct (normalization_id, source_snapshot_id) pairs of the observations.
    """
    named = definitions.withColumnRenamed("source_snapshot_id", "defined_snapshot_id")
    joined = links.join(named, "normalization_id", "left")
    per_link = joined.select(
        "normalization_id",
        F.when(F.col("defined_snapshot_id").isNull(), "missing_definition")
        .when(F.col("defined_snapshot_id") != F.col("source_snapshot_id"), "snapshot_mismatch")
        .alias("fault"),
    ).where("fault is not null")
    per_snapshot = links.groupBy("source_snapshot_id").agg(F.count("*").alias("n")).where("n > 1")
    mixed = joined.agg(*[c for f in family for c in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))])
    differs = F.exists(F.array(*[F.col(f"lo_{f}") != F.col(f"hi_{f}") for f in family]), lambda x: x)
    return (
        per_link.unionByName(per_snapshot.select(F.col("source_snapshot_id").alias("normalization_id"), F.lit("several_normalizations").alias("fault")))
        .unionByName(mixed.where(differs).select(F.lit("*").alias("normalization_id"), F.lit("mixed_family").alias("fault")))
    )


def dominance(df: DataFrame, keys: Sequence[str], vector: Sequence[str], metadata: Sequence[str] = ()) -> DataFrame:
    """Resolve repeated cumulative vectors of whole numbers: keep the one that is >= all others in every component.

    Such a vector has the component maxima, so it is there if and only if the largest component sum is
    the sum of the maxima: no pairs are formed and no vector is carried through the aggregate. A null
    in another vector sets no bound, so rows are first combined by which components they have; the
    dominating row has every component that any row has. Disagreeing metadata blocks the key.
    """
    texts = _texts(df, metadata)
    compared = _compared(metadata, texts)
    whole = [F.col(v).cast("decimal(20,0)") for v in vector]
    held = sum((F.when(F.col(v).isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(vector)), F.lit(0))
    size = sum((F.coalesce(v, F.lit(0).cast("decimal(20,0)")) for v in whole[1:]), F.coalesce(whole[0], F.lit(0).cast("decimal(20,0)")))
    ends = [(side, f) for f in [*vector, *compared] for side in ("lo", "hi")]
    pick = {"lo": F.min, "hi": F.max}
    by_shape = _coded(df, texts).withColumn("_held", held).withColumn("_size", size).groupBy(*keys, "_held").agg(
        F.count("*").alias("_rows"), F.max("_size").alias("_size"), *[pick[side](f).alias(f"_{side}_{f}") for side, f in ends]
    )
    grouped = by_shape.groupBy(*keys).agg(
        F.sum("_rows").alias("observation_count"),
        F.count("*").alias("_shapes"),
        F.bit_or("_held").alias("_all"),
        F.max("_held").alias("_most"),
        F.max_by("_size", "_held").alias("_size"),
        *[pick[side](f"_{side}_{f}").alias(f"_{side}_{f}") for side, f in ends],
    )
    agreed = _agreed(grouped, df, metadata, texts)
    clash, equal, bound = F.lit(False), F.col("_shapes") == 1, F.lit(0).cast("decimal(20,0)")
    for m in metadata:
        clash = clash | F.col(f"_x_{m}")
    for v in vector:
        equal = equal & F.col(f"_lo_{v}").eqNullSafe(F.col(f"_hi_{v}"))
        bound = bound + F.coalesce(F.col(f"_hi_{v}").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    status = (
        F.when(clash, "unresolved_metadata_conflict")
        .when(equal, "consensus")
        .when((F.col("_most") == F.col("_all")) & (F.col("_size") == bound), "componentwise_dominance")
        .otherwise("unresolved_nonmonotonic_conflict")
    )
    kept = F.col("resolution").isin("consensus", "componentwise_dominance")
    return agreed.withColumn("resolution", status).select(
        *keys,
        "observation_count",
        "resolution",
        *metadata,
        *[F.when(kept, F.col(f"_hi_{v}")).alias(v) for v in vector],
    )


def conflict_profile(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one-row summary, conflicting groups per varying column) of a claimed natural key.

    Exact duplicates are removed first. A null next to a value counts as a variation.
    """
    payload = [c for c in df.columns if c not in keys]
    exact = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    varies = {
        c: (F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))).alias(f"_v_{c}")
        for c in payload
    }
    groups = exact.groupBy(*keys).agg(F.count("*").alias("_variants"), F.sum("_copies").alias("_rows"), *varies.values())
    clash = F.col("_variants") > 1
    summary = groups.agg(
        F.sum("_rows").alias("raw_row_count"),
        F.sum("_variants").alias("exact_unique_row_count"),
        F.count("*").alias("key_count"),
        F.count_if(clash).alias("conflicting_key_count"),
        F.sum(F.col("_variants") - 1).alias("conflicting_extra_row_count"),
    )
    counts = groups.where(clash).agg(*[F.count_if(f"_v_{c}").alias(c) for c in payload])
    columns = counts.unpivot([], payload, "column_name", "conflicting_group_count").where("conflicting_group_count > 0")
    return summary, columns


def compare_partitions(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of two partitions with where it was found and which shared columns changed.

    Nulls are equal to nulls, in keys and in values.
    """
    columns = [c for c in left.columns if c not in keys and c in right.columns]
    a = left.select(*keys, F.struct(*columns).alias("_left"))
    b = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*columns).alias("_right"))
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    both = a.join(b, match, "full")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")), F.lit(c)) for c in columns])
    )
    place = F.when(F.col("_right").isNull(), "left_only").when(F.col("_left").isNull(), "right_only").otherwise("both")
    return both.select(
        *[F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in keys],
        place.alias("place"),
        F.when(place == "both", changed).alias("changed_columns"),
    )


def compare_fields(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per field, over keys resolved in both snapshots: agreement, one-sided evidence, conflicts.

    Inputs are ``field_consensus`` results; a null left by an inner conflict is also counted apart.
    """
    one = left.select(*keys, *[F.col(f).alias(f"l_{f}") for f in fields], F.col("conflict_fields").alias("_lc"))
    two = right.select(*keys, *[F.col(f).alias(f"r_{f}") for f in fields], F.col("conflict_fields").alias("_rc"))
    joined = one.join(two, list(keys))

    def one_field(field: str) -> Column:
        l, r = F.col(f"l_{field}"), F.col(f"r_{field}")
        outcome = (
            F.when(l.isNull() & r.isNull(), "both_null")
            .when(l.isNull(), "right_only")
            .when(r.isNull(), "left_only")
            .when(l == r, "equal")
            .otherwise("conflict")
        )
        return F.struct(
            F.lit(field).alias("field"),
            outcome.alias("outcome"),
            F.array_contains("_lc", field).alias("left_inner"),
            F.array_contains("_rc", field).alias("right_inner"),
        )

    long = joined.select(F.inline(F.array(*[one_field(f) for f in fields])))
    outcomes = ["both_null", "equal", "left_only", "right_only", "conflict"]
    return long.groupBy("field").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in outcomes],
        F.count_if("left_inner").alias("left_inner_conflict_count"),
        F.count_if("right_inner").alias("right_inner_conflict_count"),
    )


def repaired_text(text: Column) -> Column:
    """Text with UTF-8 that was once read as Latin-1 put right, and white space collapsed."""
    bytes_ = F.encode(text, "ISO-8859-1")
    round_trip = F.decode(bytes_, "ISO-8859-1") == text
    repaired = F.when(round_trip & F.is_valid_utf8(bytes_.cast("string")), F.decode(bytes_, "UTF-8")).otherwise(text)
    return F.trim(F.regexp_replace(repaired, r"\s+", " "))


def terminal_text(df: DataFrame, keys: Sequence[str], position: str, text: str) -> DataFrame:
    """The one text at each key's last position; texts that differ only in formatting are one.

    More than one distinct text leaves a null and a variant count above one for a check to find.
    """
    blankless = F.when(F.length(F.trim(text)) > 0, F.col(text))
    variants = df.select(*keys, position, repaired_text(blankless).alias("_identity"), blankless.alias("_text"))
    per_text = variants.groupBy(*keys, position, "_identity").agg(F.min("_text").alias("_text"), F.count("*").alias("_rows"))
    per_position = per_text.groupBy(*keys, position).agg(
        F.count("_identity").alias("variant_count"), F.sum("_rows").alias("row_count"), F.min("_text").alias("_text")
    )
    last = per_position.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(position).alias("p"), "variant_count", "row_count", "_text"), F.col(position)).alias("_t")
    )
    return last.select(
        *keys,
        F.col("_t.p").alias("terminal_position"),
        F.when(F.col("_t.variant_count") <= 1, F.col("_t._text")).alias("terminal_text"),
        F.col("_t.row_count").alias("terminal_row_count"),
        F.col("_t.variant_count").alias("text_variant_count"),
    )
