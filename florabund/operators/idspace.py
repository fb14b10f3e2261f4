"""Which ids are analysed and in which order: include lists, trees, metadata; reports of what disagrees.

A report is a DataFrame of violations, empty when all is well; require() raises on the first rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leaf labels of a Newick string: what follows an opening bracket or a comma.
LEAF = r"[(,]\s*([^(),:;\s][^(),:;]*)"


def tree_leaf_order(trees: DataFrame) -> DataFrame:
    """trees(tree_id, newick) -> tree_id, leaf_id, ord from 1 in the order of the text."""
    leaves = F.posexplode(F.regexp_extract_all("newick", F.lit(LEAF), 1))
    return trees.select("tree_id", leaves.alias("ord", "leaf_id")).select("tree_id", F.trim("leaf_id").alias("leaf_id"), (F.col("ord") + 1).cast("long").alias("ord"))


def rank_rows(rows: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """rows with their rank from 1 by columns whose values are no ties: a range partition, the rows of each part counted, and the earlier parts' sums added. No part is gathered.

    The sorted rows are stored, so that both passes see the same parts; only the table of parts (a row each) is in one task."""
    from ..sources.shared import stored

    place = F.monotonically_increasing_id()  # the part's number over the row's in it
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place)
    held = stored(parts.withColumns({"__part": F.shiftright("__place", 33), "__row": F.col("__place").bitwiseAND((1 << 33) - 1)}).drop("__place"))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = held.join(F.broadcast(before), "__part")  # a row a part
    return ranked.withColumn(name, (F.col("__before") + F.col("__row") + 1).cast("long")).drop("__part", "__row", "__before")


def tree_rank(leaves: DataFrame) -> DataFrame:
    """Ranks anew from 1 within each tree, order kept."""
    return leaves.withColumn("ord", F.row_number().over(Window.partitionBy("tree_id").orderBy("ord")).cast("long"))


def drop_leaves(leaves: DataFrame, remove: DataFrame) -> DataFrame:
    return tree_rank(leaves.join(remove, "leaf_id", "left_anti").select("tree_id", "leaf_id", "ord"))


def include_minus_exclude(include: DataFrame, exclude: DataFrame, key: str = "id") -> DataFrame:
    return include.join(exclude, key, "left_anti")


def id_intersection(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def missing_from(ids: DataFrame, known: DataFrame, key: str, problem: str) -> DataFrame:
    """(key, problem) of ids that are not known."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti").select(key, F.lit(problem).alias("problem"))


def both_ways(left: DataFrame, right: DataFrame, key: str, only_left: str, only_right: str) -> DataFrame:
    return missing_from(left, right, key, only_left).unionByName(missing_from(right, left, key, only_right))


def include_in_metadata(include: DataFrame, meta: DataFrame, key: str = "genome_id") -> DataFrame:
    return missing_from(include, meta, key, "not in metadata")


def exclude_in_include(exclude: DataFrame, include: DataFrame, key: str = "genome_id") -> DataFrame:
    return missing_from(exclude, include, key, "excluded but not included")


def tree_vs_include(leaves: DataFrame, include: DataFrame) -> DataFrame:
    return both_ways(leaves.select(F.col("leaf_id").alias("genome_id")), include, "genome_id", "in tree only", "in include only")


def counts_present(genomes: DataFrame, counts: DataFrame) -> DataFrame:
    return missing_from(genomes, counts, "genome_id", "no counts")


def annotation_present(include: DataFrame, exclude: DataFrame, annotation: DataFrame) -> DataFrame:
    return missing_from(include_minus_exclude(include, exclude, "genome_id"), annotation, "genome_id", "no annotation")


def sample_include_valid(include: DataFrame, exclude: DataFrame, meta: DataFrame) -> DataFrame:
    return missing_from(include, meta, "sample_id", "not in metadata").unionByName(missing_from(exclude, include, "sample_id", "excluded but not included"))


def test_levels_match(samples: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Levels in the data or the test alone; both sets must be equal."""
    wanted = samples.sparkSession.createDataFrame([(v,) for v in levels], "level string")
    return both_ways(samples.select(F.col(column).cast("string").alias("level")), wanted, "level", "not tested", "not in data")


test_levels_match.__test__ = False  # an operator, not a test


def pair_outputs_complete(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def justify_ids(include: DataFrame, exclude: DataFrame, leaves: DataFrame, meta: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata of the analysed genomes in tree order (ord), and all disagreements of include, exclude, tree, metadata and counts."""
    ids = include_minus_exclude(include, exclude, "genome_id")
    problems = tree_vs_include(leaves, ids)
    for more in (exclude_in_include(exclude, include), include_in_metadata(ids, meta), counts_present(ids, counts)):
        problems = problems.unionByName(more)
    ordered = meta.join(leaves.select(F.col("leaf_id").alias("genome_id"), "ord"), "genome_id").join(ids, "genome_id", "left_semi")
    return ordered, problems


def justify_intersect(leaves: DataFrame, meta: DataFrame, matrix: DataFrame) -> DataFrame:
    """Ids that tree, metadata and matrix share, in tree order, ranked from 1."""
    shared = leaves.withColumnRenamed("leaf_id", "genome_id").join(meta.select("genome_id"), "genome_id", "left_semi").join(matrix.select("genome_id"), "genome_id", "left_semi")
    return shared.select("tree_id", "genome_id", F.row_number().over(Window.partitionBy("tree_id").orderBy("ord")).cast("long").alias("ord"))


def in_order(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """rows with ord of order(key, ord), sorted by it."""
    return rows.join(order.select(key, "ord"), key).orderBy("ord")


def require(problems: DataFrame, what: str = "") -> None:
    """Raises ValueError with up to ten violations."""
    if found := problems.limit(10).collect():
        raise ValueError(f"{what or 'invalid input'}: {[r.asDict() for r in found]}")
