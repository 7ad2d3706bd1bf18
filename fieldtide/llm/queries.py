"""Queries of the operators of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtide.llm import licences, merkle, mixing, orderhash, topk, warc
from fieldtide.llm.pieces import Vocabulary, decode, encode
from fieldtide.llm.pii import KINDS, personal_data
from fieldtide.llm.quality import Quality
from fieldtide.llm.repeats import remove_repeats
from fieldtide.llm.simhash import as_hex, near_groups
from fieldtide.llm.toxicity import Toxicity, held_out
from fieldtide.llm.whitening import whitened_rows

PIECES = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_rows(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fitted = Toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", "lang", fitted.scores(F.col("text")).alias("score"))
    limit = fitted.limit(F.col("lang"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        limit.alias("lang_threshold"), (F.col("score") >= limit).alias("rejected"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(licences.background_sample(docs)))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    rows = orderhash.with_next(docs, ["text", "sig"], lambda df: orderhash.add_signature(df, "text", "sig"))
    rows = rows.withColumn("edited", orderhash.edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sig", "next_sig", "edited")
    rows = orderhash.add_signature(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), orderhash.as_text(F.col("sig")).alias("fingerprint"),
        orderhash.as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        orderhash.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        orderhash.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good. Selected are texts likelier than not of grade 1 or better."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    ratings = labels.filter("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))
    scored = docs.select("doc_id", Quality.fit(docs, ratings, 3).tails(F.col("text")).alias("tails"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), (F.col("tails")[0] + F.col("tails")[1]).alias("expected_grade"),
        F.col("tails")[0].alias("p_grade_1"), F.col("tails")[1].alias("p_grade_2"), (F.col("tails")[0] >= 0.5).alias("selected"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    vocabulary = Vocabulary.load(pieces)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "text")
    coded = decode(encode(docs, vocabulary).select("doc_id", "sha256", "ids"), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids",
                        (F.sha2("decoded", 256) == F.col("sha256")).alias("round_trip"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are those of the fixed patterns; spans are these and the tagger's."""
    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), added="pii").select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2("pii.base_text", 256).alias("base_sha256"),
                        F.col("pii.spans_text").alias("spans"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(read(spark, sf_dir, "embeddings"), components=16)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs, and whether the received documents, some in lower case, fold to the root."""
    rows = merkle.manifest(read(spark, sf_dir, "documents"), {"text": merkle.tampered()})
    folded = merkle.fold(F.col("received_leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                       folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_bit_sliced_top_k": op2_bit_sliced_top_k,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_licences": op5_licences,
    "op6_order_minhash": op6_order_minhash,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_source_mixing": op8_source_mixing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_pii": op11_pii,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {"op1_warc": warc.SQL, "op2_bit_sliced_top_k": topk.SQL, "op8_source_mixing": mixing.SQL,
                       "op13_merkle_manifest": merkle.SQL}
