"""The registered queries: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bitplanes, chat, hardneg, language, media, mixing, neardup, packing, quality, rules, topk, toxicity, tries
from tallyframe.llm.common import documents, fold, labels, written


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = quality.fit_quality(docs, labels(spark, sf_dir), fold("doc_id", 4) != 2)
    scored = quality.score_quality(docs, trees)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(written(media.store_texts(documents(spark, sf_dir)), "media"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.read_documents(bitplanes.write_files(documents(spark, sf_dir)))


def op4_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_language(docs, fold("doc_id", 4) != 2)
    found = language.identify_language(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_chat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.stored_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256.0 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), q as (select vec_id as query_id, min(e) as qe from v where vec_id % 50 = 0 group by vec_id),
s as (
  select query_id, vec_id, list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2]))::bigint as score
  from q join v on vec_id <> query_id and len(qe) = len(e)
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op10_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select("doc.doc_id", "source", "lang", "topic", "tokens", F.round("ratio", 6).alias("weight"), F.round("probability", 6).alias("probability"), "met", "drawn")


def op11_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256.0 * x::double)::bigint) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), a as (select vec_id as anchor_id, m.l as own, m.e as q from (select vec_id, min({'e': e, 'l': label}) as m from v where vec_id % 100 = 0 group by vec_id)),
s as (
  select anchor_id, vec_id, label = own as same, list_sum(list_transform(list_zip(q, e), lambda p: p[1] * p[2]))::bigint as score
  from a join v on vec_id <> anchor_id and len(q) = len(e)
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score, place
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same) where place <= 5
), n as (
  select p.*, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, place order by score desc, vec_id)::int as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


def op13_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.variants(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_trees, op2_media_tiff, op3_token_planes, op4_language_kernel, op5_toxicity_kernel, op6_chat_offsets, op7_impact_topk, op8_best_fit_packing, op9_weighted_minhash, op10_mixing_targets, op11_adaptive_rules, op12_hard_negatives, op13_trie_variants)
}
ORACLES: dict[str, str] = {"op7_impact_topk": OP7_SQL, "op10_mixing_targets": mixing.mixing_sql(), "op11_adaptive_rules": rules.rules_sql(), "op12_hard_negatives": OP12_SQL}
