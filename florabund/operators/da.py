"""The sparse matrix of differential-abundance codes da(genome_id, group_id, code).

1 up, 0 tested and neither, -1 down, -2 present but not testable, -3 absent. -3 is implicit: no
row is stored for it until densify().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_items, percent_share

UP, NONE, DOWN, UNDETECTED, ABSENT = 1, 0, -1, -2, -3
CODES = [UP, NONE, DOWN, UNDETECTED, ABSENT]


def _name(code: int) -> str:
    return f"n_{code}" if code >= 0 else f"n_m{-code}"


def da_code(log_fc: str = "log_fc", fdr: str = "fdr", max_fdr: float = 0.05) -> Column:
    """1, -1 or 0; strictly below max_fdr; a fold change of 0 counts as down; a null FDR is -2."""
    return F.when(F.col(fdr).isNull(), UNDETECTED).when(~(F.col(fdr) < max_fdr), NONE).when(F.col(log_fc) > 0, UP).otherwise(DOWN).cast("int")


def present_groups(annotation: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (genome_id, group_id) that an annotation mentions, of the catalog; NA is none."""
    rows = annotation.filter("group_id is not null and group_id <> 'NA'")
    return rows.select("genome_id", "group_id").distinct().join(groups.select("group_id"), "group_id", "left_semi").select("genome_id", "group_id")


def unknown_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose group is not in the catalog."""
    return rows.join(groups.select("group_id"), "group_id", "left_anti")


def da_code_assembly(present: DataFrame, tags: DataFrame, groups: DataFrame, max_fdr: float = 0.05) -> DataFrame:
    """-2 for present groups, the test's code where there is one, also for groups that are not annotated; groups outside the catalog are left out."""
    tested = tags.join(groups.select("group_id"), "group_id", "left_semi").select("genome_id", "group_id", da_code(max_fdr=max_fdr).alias("tested"))
    both = present.select("genome_id", "group_id").join(tested, ["genome_id", "group_id"], "full")
    return both.select("genome_id", "group_id", F.coalesce("tested", F.lit(UNDETECTED)).alias("code"))


def densify(da: DataFrame, genomes: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for every genome and group, -3 where none was stored. Restrict groups first: this is their product."""
    grid = genomes.select("genome_id").crossJoin(groups.select("group_id"))
    return grid.join(da, ["genome_id", "group_id"], "left").select("genome_id", "group_id", F.coalesce("code", F.lit(ABSENT)).cast("int").alias("code"))


def decouple_undetected(da: DataFrame, annotation: DataFrame, match: str = "exact") -> DataFrame:
    """Code -2 becomes -3 where the genome's annotation(genome_id, group_raw) does not mention the group.

    match='substring': a group counts as mentioned where its id is part of any cell, whatever the case.
    """
    if match == "substring":
        # each distinct cell once per genome; the ids to look for are few per genome
        cells = annotation.select("genome_id", F.lower("group_raw").alias("cell")).distinct()
        low = da.filter(f"code = {UNDETECTED}")
        named = low.join(cells, (low.genome_id == cells.genome_id) & F.col("cell").contains(F.lower("group_id")), "left_semi").select("genome_id", "group_id")
    else:
        named = annotation.select("genome_id", F.explode(list_items("group_raw")).alias("group_id")).distinct()
    hit = da.join(named.withColumn("named", F.lit(True)), ["genome_id", "group_id"], "left")
    return hit.select("genome_id", "group_id", F.when((F.col("code") == UNDETECTED) & F.col("named").isNull(), ABSENT).otherwise(F.col("code")).cast("int").alias("code"))


def da_code_counts(da: DataFrame, n_genomes: int) -> DataFrame:
    """Per group the genomes of each code; those not stored count as -3."""
    own = [F.count_if(F.col("code") == c).alias(_name(c)) for c in CODES if c != ABSENT]
    out = da.groupBy("group_id").agg(*own, F.count_if(F.col("code") != ABSENT).alias("__stored"))
    return out.withColumn(_name(ABSENT), F.lit(n_genomes).cast("long") - F.col("__stored")).withColumn("total", F.lit(n_genomes).cast("long")).drop("__stored")


def check_filter(filters: dict[int, tuple[float, bool]]) -> None:
    for code, (percent, _) in filters.items():
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        if not 0 <= percent <= 100:
            raise ValueError(f"percentage {percent} is not from 0 to 100")


def da_percent_filter(da: DataFrame, filters: dict[int, tuple[float, bool]], n_genomes: int) -> DataFrame:
    """Groups that pass every filter: code -> (percent, keep_high), the share of genomes with the code at least, or at most, percent. No filter passes all."""
    check_filter(filters)
    counted = da_code_counts(da, n_genomes)
    for code, (percent, high) in filters.items():
        share = percent_share(_name(code), "total")
        counted = counted.filter(share >= percent if high else share <= percent)
    return counted.select("group_id")


def conserved_groups(passed: list[DataFrame]) -> DataFrame:
    """Groups in every one of the lists."""
    out = passed[0].select("group_id")
    for p in passed[1:]:
        out = out.intersect(p.select("group_id"))
    return out


def keep_da_clusters(da: DataFrame, n_genomes: int, min_percent: float = 2.0) -> DataFrame:
    """Groups differentially abundant in min_percent of the genomes at least, and in one at least."""
    n = da.groupBy("group_id").agg(F.count_if(F.abs("code") == 1).alias("n"))
    return n.filter((F.col("n") > 0) & (F.col("n") / n_genomes * 100.0 >= min_percent)).select("group_id")


def pa_cluster_count(cluster_map: DataFrame, genomes: DataFrame, label: str = "PA") -> DataFrame:
    """Per cluster the distinct genomes with the label."""
    wanted = genomes.filter(F.col("label") == label).select("genome_id")
    return cluster_map.join(wanted, "genome_id", "left_semi").groupBy("group_id").agg(F.count_distinct("genome_id").alias("pa_count"))


def cluster_summary(da: DataFrame, groups: DataFrame, pa: DataFrame) -> DataFrame:
    """Every group of the catalog: genomes with it, DA genomes, up, down, labelled; 0 by default."""
    n = da.groupBy("group_id").agg(
        F.count_if(F.col("code") != ABSENT).alias("n_genomes"), F.count_if(F.abs("code") == 1).alias("da_count"), F.count_if(F.col("code") == UP).alias("da_up"), F.count_if(F.col("code") == DOWN).alias("da_dn")
    )
    out = groups.select("group_id").join(n, "group_id", "left").join(pa, "group_id", "left")
    return out.na.fill(0, ["n_genomes", "da_count", "da_up", "da_dn", "pa_count"])


def direction_summary(da: DataFrame) -> DataFrame:
    """Per genome the tested groups that are down, neither and up."""
    return da.filter("code between -1 and 1").groupBy("genome_id").agg(F.count_if(F.col("code") == DOWN).alias("down"), F.count_if(F.col("code") == NONE).alias("none"), F.count_if(F.col("code") == UP).alias("up"))


def code_select(da: DataFrame, codes: list[int]) -> DataFrame:
    return da.filter(F.col("code").isin(*codes))


def subset_groups(da: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named groups' rows, and the names that no row has."""
    return da.join(names, "group_id", "left_semi"), names.join(da.select("group_id").distinct(), "group_id", "left_anti")


def get_genome(da: DataFrame, genomes: DataFrame, genome_id: object) -> DataFrame:
    """group_id, code of one genome; an unknown genome is an error."""
    if genomes.filter(F.col("genome_id") == genome_id).isEmpty():
        raise KeyError(genome_id)
    return da.filter(F.col("genome_id") == genome_id).select("group_id", "code")


def get_group(da: DataFrame, groups: DataFrame, group_id: str) -> DataFrame:
    """genome_id, code of one group; an unknown group is an error."""
    if groups.filter(F.col("group_id") == group_id).isEmpty():
        raise KeyError(group_id)
    return da.filter(F.col("group_id") == group_id).select("genome_id", "code")


def set_genome(da: DataFrame, new: DataFrame, genomes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix with the rows of new in place of its own, and the rows of new for unknown genomes or groups, which are ignored."""
    known = new.join(genomes.select("genome_id"), "genome_id", "left_semi").join(groups.select("group_id"), "group_id", "left_semi").select("genome_id", "group_id", "code")
    refused = new.select("genome_id", "group_id", "code").exceptAll(known)
    return da.join(known, ["genome_id", "group_id"], "left_anti").select("genome_id", "group_id", "code").unionByName(known), refused


def bad_codes(da: DataFrame) -> DataFrame:
    """Stored cells with a code outside the domain or none. A cell that is not stored is absent, which is a valid code."""
    return da.filter(~F.col("code").isin(*CODES) | F.col("code").isNull()).select("genome_id", "group_id", F.lit("bad code").alias("problem"))


def unset_cells(dense: DataFrame, genomes: DataFrame, groups: DataFrame) -> DataFrame:
    """genome_id, n_unset: how many groups of the catalog a matrix that should be dense leaves out; by counts, without the grid."""
    held = dense.join(groups.select("group_id"), "group_id", "left_semi").groupBy("genome_id").agg(F.count_distinct("group_id").alias("held"))
    n = groups.select("group_id").distinct().count()
    return genomes.select("genome_id").join(held, "genome_id", "left").select("genome_id", (F.lit(n) - F.coalesce("held", F.lit(0))).alias("n_unset")).filter("n_unset > 0")


def annotation_na_filter(annotation: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of annotation(group_id, ...) with a group of the catalog; NA is none. See unknown_groups for the report of the others."""
    return annotation.filter("group_id is not null and group_id <> 'NA'").join(groups.select("group_id"), "group_id", "left_semi")


def combine_up_down(up: DataFrame, down: DataFrame) -> DataFrame:
    """(category, genome_id, sig) of either direction -> code 0 none, 1 up, 2 down, 3 both."""
    both = up.select("category", "genome_id", F.col("sig").alias("u")).join(down.select("category", "genome_id", F.col("sig").alias("d")), ["category", "genome_id"], "full")
    return both.select("category", "genome_id", (F.coalesce("u", F.lit(0)) + 2 * F.coalesce("d", F.lit(0))).cast("int").alias("code"))
