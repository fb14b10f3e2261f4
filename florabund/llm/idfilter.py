"""Rows picked by a list of ids without a shuffle of the others: a blocked Bloom filter of the ids is probed first, and only rows that may be listed are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .urls import WORDS, _bits, _block, bloom


def split_by_ids(docs: DataFrame, ids: DataFrame, max_blocks: int = 1 << 16, ids_per_block: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that may have a doc_id of ids(doc_id), rows that have none for sure), both with the columns of docs.

    The filter has max_blocks blocks of 256 bits at most, whatever the list, so its broadcast has a
    bound; a longer list lets more rows pass as possible hits, which the caller joins exactly. A
    null doc_id is an id like others.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    listed = stored(ids.select(key(F.col("doc_id")).alias("__key")).distinct())
    blocks = max(1, min(max_blocks, listed.count() // ids_per_block + 1))
    rows = bloom(listed, "__key", blocks).select(F.col("block").alias("__block"), *[F.col(f"w{k}").alias(f"__w{k}") for k in range(1, WORDS + 1)])
    probe = docs.select(F.struct("*").alias("__row"), key(docs["doc_id"]).alias("__key")).withColumn("__block", _block("__key", blocks)).join(F.broadcast(rows), "__block", "left")
    maybe = F.lit(True)
    for k, b in enumerate(_bits("__key"), 1):
        maybe = maybe & (F.col(f"__w{k}").bitwiseAND(b) != 0)
    maybe = F.coalesce(maybe, F.lit(False))
    return probe.filter(maybe).select("__row.*"), probe.filter(~maybe).select("__row.*")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids(doc_id); a null id matches a null id. All columns and repeated rows stay as they are."""
    listed = stored(ids.select(F.col("doc_id").alias("__id")).distinct())
    maybe, rest = split_by_ids(docs, listed.withColumnRenamed("__id", "doc_id"))
    return rest.union(maybe.join(listed, maybe["doc_id"].eqNullSafe(listed["__id"]), "left_anti"))
