"""A training corpus from raw documents in five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorespark.llm import bpe, minhash, mixing, repeats, toxicity
from scorespark.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not call toxic, with their columns; learned from the labels table.

    Whole texts are scored. Null and empty texts stay, as do null ids; repeated rows go or stay alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("_score") < model.threshold).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8).

    Null ids are in no group. Where an id stands on several rows, each goes or
    stays by its own text; rows that repeat an id and a text without words stay once.
    """
    groups = stage(minhash.near_duplicates(docs, k=5, percent=80, tell_sets=True), "near-duplicate-groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    several = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("_several")).count().where("count > 1").drop("count")
    if several.isEmpty():
        return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    # sets of such an id: of those that are kept, the smallest of each group stays
    ids = F.col("doc_id") == F.col("_several")
    pairs = groups.join(several, ids, "left_semi").where("kept and set_id is not null").select("doc_id", "set_id", "group_id").distinct()
    stays = pairs.groupBy("doc_id", "group_id").agg(F.min("set_id").alias("set_id")).select(F.col("doc_id").alias("_id"), "set_id")
    repeated = minhash.with_set_ids(docs.join(several, ids, "left_semi"), k=5)
    by_set = repeated.join(stays, (F.col("doc_id") == F.col("_id")) & (F.col("_set_id") == F.col("set_id")), "left_semi")
    single = docs.join(gone.union(several).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")
    return (single.union(by_set.dropDuplicates(["doc_id", "_set_id"]).drop("_set_id"))
            .union(repeated.where("_set_id is null").drop("_set_id").dropDuplicates(["doc_id", "text"])))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of 100-byte strings that start earlier too; characters cut in two go whole.

    A document that is left without text stays, empty; n_chars is counted anew.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    # smaller blocks and buckets than by itself: the workers' memory holds what earlier stages left too
    out = repeats.remove_repeats(docs, carry=others, whole_chars=True, block_bytes=1 << 20, bucket_bytes=16 << 20)
    clean = out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    clean = clean.withColumn("n_chars", F.char_length("text").cast("long"))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: sources are mixed at the flattest temperature that repeats none over 1.25 times.

    The budget lets each source be read whole, so no document is left out; rows of a second pass are repeated.
    A null source is one of its own; null, empty and repeated texts are mixed like others, a very long one counts by its words.
    """
    out = mixing.mix(docs, max_repeats=1.25)
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return out.where("_copies > 0").withColumn("_pass", copies).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of every row of the mixture, and digests of its ids and of the bytes they decode to.

    Null and empty texts have no token and the digests of nothing; texts of any length are read whole; a repeated row
    gives a repeated row.
    """
    # the executors still hold what earlier stages left, so each task works on little and returns its memory
    return bpe.encode_documents(docs, carry=("doc_id", "source", "lang"), digests=True, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs


# SQL cannot express the stages' models and permutations: each stage's operator is tested by itself against brute force,
# a library or SQL, and the whole against planted cases
ORACLE_SQL = None
