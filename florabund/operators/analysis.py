"""Enrichment tables, reshaping and summaries around the code matrix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import hypergeometric_tails
from ..functions.text import split_categories


def group_category_join(da: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows with a category of their group each; categories(group_id, func) with func like 'AB' counts in both. Groups without one are left out."""
    letters = categories.select("group_id", F.explode(split_categories("func")).alias("category"))
    return da.join(letters, "group_id")


def category_counts(da: DataFrame, categories: DataFrame, codes: list[int], names: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome_id, category, n): groups with one of the codes, 0 for the categories of names(category) without any."""
    n = group_category_join(da.filter(F.col("code").isin(*codes)), categories).groupBy("genome_id", "category").agg(F.count("*").alias("n"))
    grid = genomes.select("genome_id").crossJoin(names.select("category"))
    return grid.join(n, ["genome_id", "category"], "left").select("genome_id", "category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def hypergeo_enrichment(selected: DataFrame, tested: DataFrame, tail: str = "lower") -> DataFrame:
    """selected, tested: (genome_id, category, n) -> genome_id, category, x, m, p.

    x selected of the m tested groups of the category, k selected and m + n tested in all of the
    genome: p = P(X <= x) for tail='lower', P(X >= x) for 'upper', X hypergeometric. A row's work is bounded, however many groups there are.
    """
    both = tested.select("genome_id", "category", F.col("n").alias("m")).join(selected.select("genome_id", "category", F.col("n").alias("x")), ["genome_id", "category"])
    w = Window.partitionBy("genome_id")
    both = both.withColumns({"n": F.sum("m").over(w) - F.col("m"), "k": F.sum("x").over(w)})

    @F.pandas_udf("double")
    def p(x: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_tails(*(c.to_numpy(dtype=float) for c in (x, m, n, k)), tail))

    return both.withColumn("p", p("x", "m", "n", "k")).select("genome_id", "category", "x", "m", "p")


def significance_binary(tests: DataFrame, level: float = 0.05) -> DataFrame:
    return tests.withColumn("sig", F.when(F.col("p") <= level, 1).otherwise(0))


def copy_number_join(da: DataFrame, copies: DataFrame) -> DataFrame:
    """da with copies(genome_id, group_id, copies), 0 where there is none."""
    return da.join(copies, ["genome_id", "group_id"], "left").na.fill(0, ["copies"])


def copy_number_by_code(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quartiles, extremes, mean and size of the copy numbers of each code."""
    q = F.percentile("copies", [0.25, 0.5, 0.75])
    return rows.groupBy(*(by or []), "code").agg(F.min("copies").alias("low"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max("copies").alias("high"), F.count("*").alias("n"), F.avg("copies").alias("mean"))


def category_level_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))


def collapse_rare_levels(rows: DataFrame, outer: str, inner: str, k: int = 20, only: list[str] | None = None) -> DataFrame:
    """rows with inner replaced by 'Other' outside the k - 1 most frequent levels of its outer level, where that has k levels or more."""
    n = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    w = Window.partitionBy(outer)
    ranked = n.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), inner)), "levels": F.count("*").over(w)})
    rare = (F.col("levels") >= k) & (F.col("rank") >= k)
    if only is not None:
        rare &= F.col(outer).isin(*only)
    named = ranked.select(outer, inner, F.when(rare, "Other").otherwise(F.col(inner)).alias("collapsed"))
    return rows.join(named, [outer, inner]).drop(inner).withColumnRenamed("collapsed", inner)


def order_within_category(groups: DataFrame) -> DataFrame:
    """groups(group_id, func) -> with the first letter as category and its place by category, then group."""
    one = groups.withColumn("category", F.substr("func", F.lit(1), F.lit(1)))
    return one.select("group_id", "category", F.row_number().over(Window.partitionBy("category").orderBy("group_id")).cast("long").alias("ord"))


def top_tags(tags: DataFrame, n: int | None = None) -> DataFrame:
    """By p-value, then group, then genome where there is one; the first n if given."""
    out = tags.orderBy("pvalue", "group_id", *[c for c in ("genome_id",) if c in tags.columns])
    return out.limit(n) if n is not None else out


def log_counts(rows: DataFrame, column: str = "count") -> DataFrame:
    return rows.withColumn("log_count", F.log10(F.col(column) + 1))


def scale_columns(rows: DataFrame, by: str, value: str) -> DataFrame:
    """z-scores of value within each level of `by`; null where all are equal."""
    s = rows.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return rows.join(s, by).withColumn("z", F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def pairwise_distance(rows: DataFrame, metric: str = "euclidean", block: int = 256) -> DataFrame:
    """Distances of all pairs of groups over genomes, rows(genome_id, group_id, value) without gaps; 'mismatch' is the share of genomes that differ. For filtered groups: the output is quadratic in them.

    A group's values are one array in the order of genomes, and every two blocks of about `block` groups meet under a key of their own.
    """
    vectors = rows.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("genome_id", "value"))), lambda x: x["value"]).alias("v"))  # one number per genome
    blocks = max(1, -(-rows.select("group_id").distinct().count() // block))
    own = vectors.withColumn("own", F.pmod(F.xxhash64("group_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = own.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "group_id", "v")
    a, b = keyed.select("i", "j", F.col("own").alias("oa"), F.col("group_id").alias("g1"), F.col("v").alias("v1")), keyed.select("i", "j", F.col("own").alias("ob"), F.col("group_id").alias("g2"), F.col("v").alias("v2"))
    pairs = a.join(b, ["i", "j"]).filter("g1 < g2 and (i = j or oa <> ob)")
    total = lambda f: F.aggregate(F.zip_with("v1", "v2", f), F.lit(0.0), lambda s, x: s + x)
    d = F.sqrt(total(lambda x, y: ((x - y) * (x - y)).cast("double"))) if metric == "euclidean" else total(lambda x, y: (x != y).cast("double")) / F.size("v1")
    return pairs.select("g1", "g2", d.alias("distance"))


def melt(wide: DataFrame, keys: list[str], values: list[str], name: str = "column", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, values, name, value)


def pivot_matrix(long: DataFrame, row: str, column: str, value: str, levels: list) -> DataFrame:
    """One column per level, in the order given; levels are passed so that no extra pass looks for them."""
    return long.groupBy(row).pivot(column, levels).agg(F.first(value))
