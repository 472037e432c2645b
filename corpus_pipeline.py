"""The training-data pipeline: language, near-duplicates, decontamination and packing, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlens.llm import decontamination, jaccard, language, packing, simhash
from forumlens.llm.queries import RANKS, tokenizer_path
from forumlens.session import ship_package
from forumlens.sources.snapshots import materialize
from forumlens.sources.tables import read_parquet

# Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash finds candidates,
# and minimum hashes those that are similar enough but whose fingerprints differ in more bits than its blocks can stand.
WORDS, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: texts without a letter go, and texts that no profile is like. Without
    any profile, all texts with a letter stay. Labelled texts meet the profiles twice, since what is usual is learnt from all
    of them before any text is judged; only their scores are written for that.
    """
    ship_package(spark)
    profiles = language.train(docs)
    if not profiles.languages:
        return docs.where(language.has_letter(F.col("text")))
    least = language.least_score(docs, profiles)
    found = language.predict(docs, profiles, docs.columns)
    foreign = language.unlike_all(F.col("source.text"), F.col("score"), least)
    return found.where(~language.rejected(F.col("lang_pred")) & ~foreign).select("source.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: the one with the least id, and of rows with that id, or without any
    id, the first. Rows go by what they say and not by their id: rows that repeat an id with other texts, and rows without an
    id, are documents of their own. Texts without words are one group. No rows give no rows.
    """
    ship_package(spark)
    number = next(name for name in (f"row_{n}" for n in range(len(docs.columns) + 1)) if name not in docs.columns)
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()))
    close = simhash.near_duplicates(rows, number)
    groups = materialize(jaccard.near_duplicates(rows, number, words=WORDS, similarity=SIMILARITY, close=close))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", number)
    first = rows.select("doc_id", number).join(groups, number).groupBy("component_id").agg(F.min(order).alias("first"))
    stays = first.select(F.col(f"first.{number}").alias("stays"))
    # Only numbers of what goes are joined; texts move only if these are too many to broadcast.
    gone = materialize(groups.join(stays, groups[number] == stays["stays"], "left_anti").select(F.col(number).alias("gone")))
    return rows.join(gone, rows[number] == gone["gone"], "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark text occurs. NULL and empty texts have no window and stay, as
    do repeated rows; an empty table or an empty benchmark takes nothing away.
    """
    ship_package(spark)
    return decontamination.clean_documents(docs, read_parquet(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids. NULL texts are empty documents, repeated rows are
    documents of their own, no rows give no pieces.
    """
    ship_package(spark)
    return packing.pack(docs, tokenizer_path(), ranks=tokenizer_path(RANKS))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Fingerprints, profiles and the program of packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory, each written before the next one reads it."""
    docs = read_parquet(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
