"""Documents through the corpus operators: each stage works on what its predecessor kept.

All stages read doc_id and text, keep whole rows with all their columns, whatever their names, and have an empty
result for an empty table. A null, empty or letterless text has no language and goes in the first stage; given to
the later ones alone, such texts are judged as empty (not toxic, no copies, no passages, no ids). Repeated rows
are copies of one document, of which near-duplicate removal keeps the one of least doc_id. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwright.llm import bpe, decontam, langid, neardup, toxicity
from driftwright.llm.common import Scratch, learnable, spare

#: SQL can't express the stages: they learn models and draw samples. Tests compare them with brute force.
ORACLE_SQL = None

#: A document without a main language, or whose main language has less than this share, is rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a main language."""
    model = langid.train(docs.where(learnable("doc_id")))
    own = spare(docs, "found")
    found = docs.withColumn(own, langid.identify_column(docs, model))
    return found.where((F.col(f"{own}.lang_pred") != langid.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_SHARE)).drop(own)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that aren't predicted to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(learnable("doc_id")).select("doc_id", "toxic"))
    own = spare(docs, "score")
    return docs.withColumn(own, toxicity.score_column(docs, model)).where(F.col(own) < toxicity.THRESHOLD).drop(own)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return neardup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no passage of the benchmark."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document as little-endian unsigned 32-bit integers, and the digest of what they decode to."""
    import public_tokenizers

    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
