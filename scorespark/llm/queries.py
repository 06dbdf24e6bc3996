"""Registered corpus queries: thin digests over the operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorespark.llm import (bpe, collocations, embeddings, minhash, mixing, negatives, quality, repeats, sharding, token_files,
                            top_k, toxicity, warc)
from scorespark.llm.common import scratch_path, table
from scorespark.llm.pieces import HELD

HELD_ALONE = 2 * HELD  # a query's workers have an executor's memory to themselves; the pipeline's do not


def op3_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near-equal bytes."""
    out = sharding.contiguous_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op1_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: four words, similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_cover_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a 100-byte string covers which also starts earlier."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the bytes they decode to, as digests."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), digests=True, held=HELD_ALONE)


def op5_clause_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= model.threshold).cast("int").alias("predicted"))


def op6_patched_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to patched frame-of-reference files and read back."""
    docs = table(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs, scratch_path(spark, "op6"), held=HELD_ALONE))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read when no source is repeated more than twice as often as another."""
    out = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=2.0)
    return out.select("doc_id", "source", F.col("_tokens").alias("n_words"), F.col("_copies").alias("copies"))


def op8_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by byte ranges."""
    planned = warc.plan_records(table(spark, sf_dir, "pages"))
    records = warc.read_archives(warc.write_archives(planned, scratch_path(spark, "op8")))
    # a response's digest is made anew from the payload that was read
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of all documents and the verdicts on them and their hosts."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.MEASURES, "base_failed", "host_failed", "kept")


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of equal label: cosine 0.93."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_norm_bounded_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_burst_trie_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words occur together most beyond chance."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, top=2000, percent=100)


def op13_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth embedding with all others."""
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_tensored_minhash": op1_tensored_minhash,
    "op2_recursive_bpe": op2_recursive_bpe,
    "op5_clause_grammar_toxicity": op5_clause_grammar_toxicity,
    "op6_patched_token_files": op6_patched_token_files,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_splittable_warc": op8_splittable_warc,
    "op9_host_quality": op9_host_quality,
    "op10_collision_counting": op10_collision_counting,
    "op4_cover_suffix_dedup": op4_cover_suffix_dedup,
    "op3_prefix_sum_shards": op3_prefix_sum_shards,
    "op11_norm_bounded_negatives": op11_norm_bounded_negatives,
    "op12_burst_trie_phrases": op12_burst_trie_phrases,
    "op13_block_top_k": op13_block_top_k,
}
