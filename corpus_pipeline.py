"""From raw documents to packed training sequences: five stages, each written before the next reads it.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps, with the columns of ``documents``;
the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.base import Shelf
from sightline.llm.digests import byte_copies
from sightline.llm.fingerprints import near_copies
from sightline.llm.language import UNKNOWN, learn_languages, predict_languages
from sightline.llm.packing import packed_sequences
from sightline.llm.passages import repeated_passages
from sightline.session import ship_package, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
LEAST_FIT, FEW_GRAMS = 1.0, 6.0  # in standard deviations of a language; the second is divided by the root of the number of n-grams
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def row_name() -> Column:
    """What names a row: its identifier first, and two hashes of its text, so that rows that share or lack an identifier are told apart."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def contents(docs: DataFrame) -> DataFrame:
    """Documents as fetched content."""
    return docs.select(row_name().alias("uri"), F.col("text").alias("content"))


def one_each(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """The documents that ``answers(uri, kept)`` keeps, each name once: of rows that repeat a name, the one with the smallest other columns.

    Only rows with a repeated name are gathered, by an aggregation that begins before the exchange, so a name held by many rows is no hot key.
    """
    shelf = Shelf(docs.sparkSession, "one-each")
    answers = shelf.keep(answers.select("uri", "kept"), "answers")
    repeated = shelf.keep(answers.where("kept").groupBy("uri").count().where("count > 1").select("uri"), "repeated")
    lost = answers.where("NOT kept").select("uri").distinct()
    named = docs.select(*COLUMNS).withColumn("uri", row_name())
    if repeated.isEmpty():
        return named.join(lost, "uri", "left_anti").select(*COLUMNS)
    once = named.join(repeated, "uri", "left_semi").groupBy("uri").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return named.join(lost.unionByName(repeated), "uri", "left_anti").select(*COLUMNS).unionByName(once.select(*[f"row.{c}" for c in COLUMNS]))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go, and those that are unusual in the language that claims them best.

    The model learns from the stage's own labelled documents; a label is never an input of a decision. Unusual is a mean log-probability an n-gram
    more than one standard deviation of that language below its average, with an allowance for short texts. Where nothing could be
    learned, every document stays.
    """
    model = learn_languages(docs.select(F.col("text").alias("content"), F.col("lang").alias("language")))
    if not model.languages:
        return docs.select(*COLUMNS)
    # The whole row travels as its own name, so nothing has to be joined back.
    answers = predict_languages(docs.select(F.struct(*COLUMNS).alias("uri"), F.col("text").alias("content")), model)
    usual = F.col("fit") >= -(LEAST_FIT + FEW_GRAMS / F.sqrt("n_grams"))
    return answers.where((F.col("language") != UNKNOWN) & (F.col("score") >= LEAST_SCORE) & usual).select("uri.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the smallest identifier."""
    return one_each(docs, byte_copies(contents(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that names the group."""
    return one_each(docs, near_copies(contents(docs)).withColumn("kept", F.col("uri") == F.col("group")))


def recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that recur; a document without any keeps its text to the letter."""
    shelf = Shelf(spark, "recurring")
    answers = repeated_passages(contents(docs)).where("n_removed > 0").select("uri", F.col("content").alias("left_text"))
    answers = shelf.keep(answers.distinct(), "answers")
    changed = docs.select(*COLUMNS).withColumn("uri", row_name()).join(answers, "uri", "left")
    return changed.select("doc_id", F.coalesce("left_text", "text").alias("text"), "lang", "source",
                          F.when(F.col("left_text").isNotNull(), F.length("left_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document with their places in training sequences."""
    return packed_sequences(docs.select(F.col("doc_id").alias("uri"), F.col("text").alias("content")), WORD_VOCABULARY).withColumnRenamed("uri", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_duplicates),
    ("substring_dedup", recurring_passages), ("packing", packing)]
ORACLE_SQL = None  # language scores, fingerprints and token ids have no SQL form; tests check each stage by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(ship_package(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shelf.keep(stage(spark, docs, sf_dir), name)
    return docs
