"""Counting on streaming DataFrames: reads or gene counts arrive in any order, sums are additive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.counts import counts_join_groups


def running_group_counts(counts: DataFrame, gene_group: DataFrame) -> DataFrame:
    """A stream of counts(genome_id, gene_id, sample_id, count) joined with a static gene_group -> running sums; write with outputMode('update') or 'complete'."""
    return counts_join_groups(counts, gene_group).groupBy("genome_id", "group_id", "sample_id").sum("count").withColumnRenamed("sum(count)", "count")
