"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.llm import decontam, fixity, flatfile, html, jaccard, packing, pii, quality, repair, sharding, substrings, toxicity, trie
from weft.llm.oracles import ORACLE
from weft.llm.text import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_distribution_divergence(spark: SparkSession, sf: str) -> DataFrame:
    feats = quality.features(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    narrow = feats.withColumn("_row", F.struct(F.col("_row.doc_id").alias("doc_id"), F.col("_row.lang").alias("lang")))
    feats = materialize(narrow, "features")
    return quality.judge(feats, quality.references(feats)).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"))


@query
def op3_positional_index(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    base = sharding.tree(8)
    return sharding.assign(table(spark, sf, "documents"), base, sharding.grown(base, 8)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op8_merkle_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The second replica is the first with planted faults: one byte changed in every 97th record, every 101st lost."""
    pages = table(spark, sf, "pages")
    changed = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    copy = fixity.records(pages.withColumn("html", changed)).where(~F.coalesce(F.col("record_id") % 101 == 7, F.lit(False)))
    return fixity.audit(fixity.records(pages), copy)


@query
def op5_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))


@query
def op6_best_fit_plan(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.tokenised(table(spark, sf, "documents")))


@query
def op7_parity_sketch_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op10_block_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op9_block_labeller(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html.main_text(pages, html.train(pages))


@query
def op2_bilstm_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return pii.report(docs, pii.train(docs))


@query
def op11_flat_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return flatfile.digest(table(spark, sf, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.nodes(table(spark, sf, "conversations"))


@query
def op13_grammar_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return repair.report(table(spark, sf, "conversations"))
