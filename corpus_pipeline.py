"""A corpus from raw documents to token ids: STAGES in order, each over all rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import bpe, langid, minhash, mix, suffix
from tamis.llm.common import stage
from tamis.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if at least this share of its words is in one language.
LANGUAGE_SHARE = 0.4
#: Words of a shingle and similarity of near copies; bytes of a repeat.
WORDS, SIMILARITY, REPEAT = 5, 0.8, 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in no one language; learns from the labels of documents themselves."""
    docs = docs.select(*COLUMNS)
    langs, logs = langid.learn(docs.where(langid.key_mod(F.col("doc_id"), 3) != 1), "text", "lang", F.col("doc_id"))
    got = langid.identify(docs, langs, logs, "text", COLUMNS)
    return got.where((F.col("lang_pred") != langid.NONE) & (F.col("score") >= LANGUAGE_SHARE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (null is the largest). Rows count as
    one document only if both doc_id and text are equal; unlike texts under one doc_id, or none, are documents of their own."""
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")))
    kept = minhash.near_duplicates(docs.select("_key", "text"), "text", "_key", WORDS, SIMILARITY)
    kept = kept.where("kept").select(F.col("_key").alias("_kept")).distinct()
    stay = docs.join(kept, F.col("_key").eqNullSafe(F.col("_kept")), "left_semi")
    return stay.groupBy("_key").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("d")).select(F.col("_key.id").alias("doc_id"), "d.*").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of REPEAT bytes that also start in a document with a smaller doc_id; characters that are cut through
    go whole. Documents of which nothing is left but white space go."""
    got = suffix.dedup(docs.select(*COLUMNS), "text", "doc_id", REPEAT, ["lang", "source"], as_text=True)
    got = got.where((F.size("spans") == 0) | F.col("kept").rlike(r"\S"))
    return got.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, up to twice each, so that sources come near their target weights."""
    return mix.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and a digest of the text that they decode to."""
    got = bpe.encode(docs.select("doc_id", "text", "lang", "source"), vocabulary())
    return got.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each of the others keeps is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
