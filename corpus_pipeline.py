"""A training corpus from ``documents``: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage works on all that the stage before kept and returns the columns of ``documents``, but for
the last, which returns the packed bins. ``n_chars`` follows the text where a stage changes it.

Nulls in any column, empty texts and repeated rows go through every stage: a null text counts as
empty and has no toxic words, no passages and no secrets; of repeated rows one stays. An empty table
gives no bins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from tarnflow.llm.common import checkpoint_dir, load, ship
from tarnflow.llm.queries import held_out, tokenizer_path

#: A document goes if its toxicity is at least this, or if more of its words are benchmark passages.
TOXIC_FROM, MOST_COVERED = 0.7, 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it now is; null stays null."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, by a model of the labels of rows that aren't held out."""
    ship(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"), ~held_out())
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each near-duplicate class."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go."""
    return _counted(decontaminate.clean(docs, load(spark, sf_dir, "benchmark"), max_coverage=MOST_COVERED))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; all documents stay."""
    return _counted(secret_scan.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per bin: its pieces with their texts, tokens used and fill.

    A document's text is its pieces by ``piece``, with a space where ``first`` isn't the ``last`` before.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path(), with_text=True), as_bins=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Training, components and packing can't be put as one SQL query; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
