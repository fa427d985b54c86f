"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import linededup, mixing, prefixtrie
from twinsift.llm.frames import table

HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.packing import pack
    return pack(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.tokencount import token_counts
    return token_counts(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf, "documents"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.quality import quality_scores
    scored = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"),
                            train=f"NOT ({HELD_OUT})")
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"),
                         "score", "predicted")


def op6_vp_trees(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.vptree import search
    return search(table(spark, sf, "embeddings"))


def op7_site_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.siteextract import extract
    return extract(table(spark, sf, "pages"))


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.jaccard import jaccard_components
    return jaccard_components(table(spark, sf, "documents"))


def op9_repetition(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.repetition import repetition_rules
    return repetition_rules(table(spark, sf, "documents"))


def op10_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.urlrules import judge_urls
    return judge_urls(table(spark, sf, "pages"))


def op11_norm_buckets(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.normbuckets import top_products
    return top_products(table(spark, sf, "embeddings"))


def op12_vp_clusters(spark: SparkSession, sf: str) -> DataFrame:
    from twinsift.llm.vpclusters import cluster
    return cluster(table(spark, sf, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf, "conversations"))


def queries() -> dict:
    found = (op1_packing, op2_mixing, op3_token_counts, op4_line_dedup, op5_quality, op6_vp_trees,
             op7_site_style_tree, op8_jaccard_join, op9_repetition, op10_url_rules, op11_norm_buckets,
             op12_vp_clusters, op13_prefix_trie)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from twinsift.llm import normbuckets, vpclusters
    return {"op2_mixing": mixing.SQL, "op4_line_dedup": linededup.SQL, "op11_norm_buckets": normbuckets.SQL,
            "op12_vp_clusters": vpclusters.SQL, "op13_prefix_trie": prefixtrie.SQL}
