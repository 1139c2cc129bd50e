"""Corpus cleaning pipeline over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written
as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, packing, pii, simhash, toxicity
from quire.llm.queries import PII_KEY
from quire.session import materialize, table_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from ``labels``."""
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    return toxicity.drop_toxic(docs, labels)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    items = spark.read.parquet(table_path(sf_dir, "benchmark"))
    return decontam.drop_contaminated(docs, items)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced by pseudonyms; every document stays."""
    found = "_pii"
    while found in docs.columns:
        found = f"_{found}"
    return pii.pseudonymise(docs, PII_KEY, out=found).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# Model fitting and fingerprints have no SQL form; tests compare the stages
# with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
