"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import (
    bpe_codec, decontaminate, hard_negatives, kn_quality, license_scan, line_dedup, packing, prefix_trie, quality_rules, sharding, simhash,
    suffix_dedup, token_counts,
)
from kinweave.llm.oracles import ORACLES  # noqa: F401  registered with the queries

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def op1_token_counts(spark, sf_dir):
    return token_counts.with_token_counts(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op3_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return kn_quality.scored(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op7_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = sharding.write_shards(docs, 40)
    return out.select(
        "doc_id", sharding.row_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_best_fit_packing(spark, sf_dir):
    out = packing.packed_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_simhash_near_dedup(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark, sf_dir):
    out = quality_rules.with_verdict(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_bpe_codec(spark, sf_dir):
    out = bpe_codec.encode(table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def conversation_trie(turns: DataFrame, width: int = prefix_trie.WIDTH) -> DataFrame:
    """Prefixes of conversations that take their first turns from the conversation at the head of their hundred."""
    conv = F.col("conv_id")
    n = F.crc32(conv.cast("string").cast("binary")) % 6
    rebuilt = prefix_trie.stored(prefix_trie.with_heads(prefix_trie.sequences(turns), conv - conv % 100, n, 5))
    digests = prefix_trie.end_digests(prefix_trie.ends(rebuilt, width))
    out = prefix_trie.nodes(rebuilt, width).join(digests, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op13_conversation_prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sharding": op7_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}
