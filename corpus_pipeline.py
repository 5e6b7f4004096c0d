"""The corpus pipeline: five stages over the documents, each written as Parquet and read again.

Stages but the last return the columns of documents; the last returns the chosen mixture with its texts.

Cases, for every stage: an empty table gives an empty result; columns with other names, also such as the operators
use inside, pass through; a null or empty text has the toxicity of the intercept, leaks nothing and has no secrets, all such texts are one
group of near copies, and they cost nothing in the mixture; rows with a null or a repeated id are judged by their own texts;
repeated rows are near copies of each other, so one stays; of a group the smallest id stays, of equal ids any one; very long texts are read whole.

A stage hands rows to Python in Arrow batches of about ``BATCH`` bytes (a row is never split), not of Spark's 10000 rows: whole texts make those tens of
megabytes, which executor and Python each hold for every running task. Its result is lazy, so the session's setting stays; ``run`` puts it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, mixing, secrets, simhash, toxicity
from keyloom.llm.common import discard, fresh, read, scratch, staged

BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def with_setting(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, f"{BATCH}b")
        return stage(spark, docs, sf_dir)

    return with_setting


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    model = toxicity.train(docs.select("doc_id", "text"), toxicity.training_labels(read(spark, sf_dir, "labels")))
    name = fresh(docs, "__toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_first(docs, width=5, threshold=0.8)


@in_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts masked; n_chars follows the text."""
    masked = secrets.redact(docs, secrets.train(docs.select("text")))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that each leaf of the source tree gives, with their texts, once for each epoch that takes them."""
    return mixing.mix(docs, carry=("text",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: Trained models and near-duplicate components have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    setting = spark.conf.get(BATCH_BYTES)
    try:
        for name, stage in STAGES:
            before = docs
            with scratch(spark) as keep:
                docs = keep(staged(stage(spark, before, sf_dir), f"stage-{name}"))
            discard(spark, before)
    finally:
        spark.conf.set(BATCH_BYTES, setting)
    return docs
