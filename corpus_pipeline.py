"""The corpus pipeline: quality, lines, near copies, mixture, tokens, each stage over all that its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last returns the encoding of each
document. Rows that the mixture takes twice stand twice from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe_chunks, cotraining, line_dedup, mixing, near_dedup
from platewise.llm.queries import word_bpe_path
from platewise.session import table, work_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return _columns(cotraining.classify_quality(_columns(docs), table(spark, sf_dir, "labels")).where("ct_kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across three or more documents stay in the last of them only."""
    out = line_dedup.dedup_lines(_columns(docs))
    return out.select("doc_id", F.col("ld_text").alias("text"), "lang", "source", F.char_length("ld_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the class's id."""
    classes = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("s_id")).distinct()
    return _columns(_columns(docs).join(stay, F.col("doc_id").eqNullSafe(F.col("s_id")), "left_semi"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it; what isn't taken goes."""
    taken = mixing.mix_to_targets(docs.select("doc_id", "text", "source")).where("mx_copies > 0")
    copies = taken.groupBy("mx_id").agg(F.max("mx_copies").alias("copies"))
    joined = _columns(docs).join(copies, F.col("doc_id").eqNullSafe(F.col("mx_id")))
    return _columns(joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    out = bpe_chunks.encode_documents(docs.select("doc_id", "text", "lang", "source"), word_bpe_path())
    return out.select("doc_id", "lang", "source", F.col("bp_n_tokens").alias("n_tokens"), F.col("bp_ids_sha256").alias("ids_sha256"), F.col("bp_decoded_sha256").alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = work_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: Trained stages and seeded hashes are outside SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
