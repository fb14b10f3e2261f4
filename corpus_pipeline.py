"""From raw documents to packed token sequences in five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from florabund.llm import decontam, neardup, packing, quality, secrets
from florabund.llm.common import shared_dir, table
from florabund.llm.idfilter import drop_ids
from florabund.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id."""
    return drop_ids(docs, neardup.near_duplicates(docs).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their documents, which stay."""
    return secrets.redact(docs, secrets.scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their place in the sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL can express neither similarity components nor the forest nor packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each returns is written as Parquet in the shared folder and read again.

    Null, empty and blank texts fail the base rule of the first stage, so none is packed; rows that repeat a doc_id are one
    document to the second and are kept or dropped together, each packed for itself; a null doc_id is judged, scanned and packed
    like others and linked with nothing. Texts of any length are read whole. An empty table gives no rows. Columns
    besides those of documents pass through all stages but the last, whatever their names.
    """
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
