"""Cleaning pipeline over the documents table: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import fieldtide
from fieldtide.llm import mixing
from fieldtide.llm.copies import copy_dedup
from fieldtide.llm.pieces import Vocabulary, encode
from fieldtide.llm.queries import PIECES, read
from fieldtide.llm.repeats import remove_repeats
from fieldtide.llm.toxicity import Toxicity
from fieldtide.llm.work import release, saved, unused, written

# Workers need not have this folder on their path.
cloudpickle.register_pickle_by_value(fieldtide)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    fitted = Toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return docs.withColumn(score, fitted.scores(F.col("text"))).filter(F.col(score) < fitted.limit(F.col("lang"))).drop(score)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of five-word shingles from 0.8 up), that of the smallest doc_id.

    Candidates are those of the SimHash index and, beyond its reach, of min-wise keys; every link is checked on the sets.
    """
    return copy_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur more than once; n_chars follows the text. A null text stays null."""
    # The text travels once: the other columns are one struct beside it.
    others = F.struct("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text")))
    cleaned = remove_repeats(docs.select(others.alias("_row"), F.col("doc_id"), F.col("text")), with_text=True)
    value = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cleaned.select(*(value[c].alias(c) if c in value else F.col("_row")[c].alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    row = F.struct(*docs.columns).alias("_row")
    mixed = mixing.mix(docs.select("doc_id", "source", "text", row))
    return mixing.emit(mixed).select("_row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids in place of the text."""
    return encode(docs, Vocabulary.load(PIECES)).drop("text").withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

# A trained model and byte-wise repeats are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs, older = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # Once a stage's output is written, its own tables and its input are read no more.
        release(spark, [folder for folder in written()[:-1] if folder not in older])
    return docs
