"""Registered queries ``opN_<name>`` of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import chat, langid, lm, quality, topk
from tillage.llm.covering import simhash_components
from tillage.llm.decontam import benchmark_matches
from tillage.llm.html import extract_main_text
from tillage.llm.mixing import mix
from tillage.llm.multi_index import ORACLE_SQL as NEGATIVES_SQL
from tillage.llm.multi_index import hard_negatives
from tillage.llm.ngram_join import jaccard_components
from tillage.llm.prefix_trie import ORACLE_SQL as TRIE_SQL
from tillage.llm.prefix_trie import prefix_trie
from tillage.llm.substring import remove_repeated_passages
from tillage.llm.tables import text_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = text_mod(F.col("doc_id"), 7) == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = text_mod(F.col("doc_id"), 3) == 1
    # At most MAX_ROWS labelled rows teach, taken by hash; so many ids are broadcast.
    labels = (_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out & F.col("quality").isin(0, 1))
              .orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(quality.MAX_ROWS))
    model = quality.train(docs.join(F.broadcast(labels), "doc_id"))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = text_mod(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return benchmark_matches(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_maximal(_table(spark, sf_dir, "conversations"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("fp")


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting,
    op2_mixing,
    op3_substring_dedup,
    op4_topk_search,
    op5_html_extraction,
    op6_lm_scoring,
    op7_ngram_jaccard_join,
    op8_quality_classifier,
    op9_language_id,
    op10_benchmark_decontamination,
    op11_simhash_near_dedup,
    op12_hard_negative_mining,
    op13_prefix_trie,
)}
SQL = {"op1_chat_formatting": chat.ORACLE_SQL, "op4_topk_search": topk.ORACLE_SQL, "op12_hard_negative_mining": NEGATIVES_SQL,
       "op13_prefix_trie": TRIE_SQL}
