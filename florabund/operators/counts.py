"""From alignments and gene counts to group counts.

Tables: counts(genome_id, gene_id, sample_id, count[, ord]), annotation(gene_id, group_raw[, genome_id][, ord]),
groups(group_id, ord), group counts (genome_id, group_id, sample_id, count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of_list, list_items

#: Rows that counting tools add to the genes.
SPECIAL = ["__no_feature", "__ambiguous", "__too_low_aQual", "__not_aligned", "__alignment_not_unique"]
NO_FEATURE, AMBIGUOUS = SPECIAL[:2]


def special(c: str = "gene_id") -> Column:
    return F.col(c).startswith("__")


def drop_special_features(counts: DataFrame) -> DataFrame:
    """Without the rows of counting tools; every id with two underscores in front is one."""
    return counts.filter(~special())


def identity_filter(alignments: DataFrame, thresholds: list[float]) -> DataFrame:
    """A copy per threshold of the alignments above it; the least threshold is the base and passes all."""
    base = min(thresholds)
    out = alignments.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return out.filter((F.col("threshold") == base) | (F.col("identity") > F.col("threshold")))


def sample_projection(counts: DataFrame, samples: DataFrame) -> DataFrame:
    return counts.join(samples.select("sample_id"), "sample_id", "left_semi")


def first_gene_wins(counts: DataFrame) -> DataFrame:
    """Of a gene's repeated rows of a genome and sample the one with the least ord."""
    cols = [c for c in counts.columns if c not in ("genome_id", "gene_id", "sample_id")]
    best = counts.groupBy("genome_id", "gene_id", "sample_id").agg(F.min_by(F.struct(*cols), "ord").alias("r"))
    return best.select("genome_id", "gene_id", "sample_id", "r.*")


def repeated_genes(counts: DataFrame) -> DataFrame:
    """The rows that first_gene_wins leaves out."""
    w = Window.partitionBy("genome_id", "gene_id", "sample_id").orderBy("ord")
    return counts.withColumn("rank", F.row_number().over(w)).filter("rank > 1").drop("rank")


def first_group_wins(annotation: DataFrame, multi: str = "first") -> DataFrame:
    """gene_id (and genome_id, if there) -> group_id of the gene's first row; of a list cell the first group, or with multi='all' each."""
    keys = [c for c in ("genome_id", "gene_id") if c in annotation.columns]
    one = annotation.groupBy(*keys).agg(F.min_by("group_raw", "ord").alias("group_raw")) if "ord" in annotation.columns else annotation
    group = F.explode(list_items("group_raw")) if multi == "all" else first_of_list("group_raw")
    return one.select(*keys, group.alias("group_id")).filter("group_id is not null")


def counts_join_groups(counts: DataFrame, gene_group: DataFrame) -> DataFrame:
    """Counts of genes that have a group, with it."""
    return counts.join(gene_group, [c for c in ("genome_id", "gene_id") if c in gene_group.columns])


def genes_without_group(counts: DataFrame, gene_group: DataFrame) -> DataFrame:
    """(genome_id, gene_id) counted but without a group."""
    keys = [c for c in ("genome_id", "gene_id") if c in gene_group.columns]
    return counts.select("genome_id", "gene_id").distinct().join(gene_group, keys, "left_anti").select("genome_id", "gene_id")


def densify_counts(summed: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for every (genome, sample) of pairs and every group of the catalog, 0 where nothing was counted."""
    grid = pairs.select("genome_id", "sample_id").distinct().crossJoin(groups.select("group_id"))  # the wanted output itself
    return grid.join(summed, ["genome_id", "group_id", "sample_id"], "left").select("genome_id", "group_id", "sample_id", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def group_sums(counts: DataFrame, gene_group: DataFrame) -> DataFrame:
    """Counts summed by genome, group and sample; only what occurs."""
    return counts_join_groups(counts, gene_group).groupBy("genome_id", "group_id", "sample_id").agg(F.sum("count").cast("long").alias("count"))


def aggregate_counts(counts: DataFrame, annotation: DataFrame, groups: DataFrame, multi: str = "first") -> DataFrame:
    """Gene counts rolled up to the groups of the catalog, zeros included. Repeated genes and annotations count once, the first row."""
    once = first_gene_wins(counts) if "ord" in counts.columns else counts
    return densify_counts(group_sums(once, first_group_wins(annotation, multi)), groups, counts)


def genome_sample_pairs(genomes: DataFrame, samples: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The given pairs, else every genome with every sample."""
    return pairs.select("genome_id", "sample_id") if pairs is not None else genomes.select("genome_id").crossJoin(samples.select("sample_id"))


def zero_fill_missing(counts: DataFrame, pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts plus, for each wanted pair without any, a 0 for every gene of its genome."""
    missing = pairs.join(counts.select("genome_id", "sample_id").distinct(), ["genome_id", "sample_id"], "left_anti")
    zeros = missing.join(genes.select("genome_id", "gene_id"), "genome_id").select("genome_id", "gene_id", "sample_id", F.lit(0).cast("long").alias("count"))
    return counts.select("genome_id", "gene_id", "sample_id", "count").unionByName(zeros)


def wide_counts(counts: DataFrame, samples: list[str], keys: list[str]) -> DataFrame:
    """One column per sample, 0 where nothing was counted."""
    return counts.groupBy(*keys).pivot("sample_id", samples).agg(F.sum("count").cast("long")).na.fill(0, samples)


def genome_abundance(counts: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Total count by genome and sample without special rows. With leaves(genome_id, ord) of a tree, those genomes alone, with their place in it as ord and in its order."""
    out = drop_special_features(counts).groupBy("genome_id", "sample_id").agg(F.sum("count").cast("long").alias("total"))
    return out if leaves is None else out.join(leaves.select("genome_id", "ord"), "genome_id").orderBy("ord", "sample_id")


def combine_tech_reps(counts: DataFrame, pattern: str = r"_r\d+$") -> DataFrame:
    """Counts of replicates summed under the sample's name without its replicate ending."""
    keys = [c for c in counts.columns if c not in ("sample_id", "count")]
    return counts.withColumn("sample_id", F.regexp_replace("sample_id", pattern, "")).groupBy(*keys, "sample_id").agg(F.sum("count").cast("long").alias("count"))


def library_sizes(*sources: DataFrame, where: str | None = None) -> DataFrame:
    """Reads per sample summed over sources(sample_id, reads), filtered first."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    out = out.filter(where) if where else out
    return out.groupBy("sample_id").agg(F.sum("reads").cast("long").alias("lib_size"))


#: Widths of nested bins: each eight times the one before.
LEVELS = 7


def _nested(rows: DataFrame, start: str, end: str, width: int, above: list[int]) -> DataFrame:
    """rows with own (the first level at which they touch two bins at most), and a row for each bin they touch at that level and at the levels of `above` that are higher."""
    wide = [width * 8**k for k in range(LEVELS)]
    own = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        own = F.when(F.expr(f"{end} div {wide[k]} - {start} div {wide[k]} <= 1"), k).otherwise(own)
    levels = F.filter(F.array(*[F.lit(k) for k in range(LEVELS)]), lambda k: (k == F.col("own")) | (F.array_contains(F.array(*map(F.lit, above)).cast("array<int>"), k) & (k > F.col("own"))))
    at = rows.withColumn("own", own).withColumn("level", F.explode(levels)).withColumn("wide", F.element_at(F.array(*[F.lit(w).cast("long") for w in wide]), F.col("level") + 1))
    return at.withColumn("bin", F.explode(F.sequence(F.expr(f"{start} div wide"), F.expr(f"{end} div wide"))))


def overlaps(reads: DataFrame, features: DataFrame, width: int = 1 << 14, most: int = 200_000) -> DataFrame:
    """Reads(contig, start, end, ...) with features(contig, start, end, gene_id) they overlap. Ends are inclusive.

    Bins are nested: an interval has a row or two at the level of its own length, whatever that is, and at the higher levels that the other side uses.
    A pair meets at the higher of both own levels, in the bin of its later start only. The reads of a bin with more than `most` are dealt to parts, to each of which
    the bin's features go. Only the features' levels, seven at most, reach the driver.
    """
    f = features.select(F.col("contig"), F.col("start").alias("f_start"), F.col("end").alias("f_end"), F.col("gene_id"))
    f = _nested(f, "f_start", "f_end", width, list(range(LEVELS))).withColumnRenamed("own", "f_own").drop("wide")
    used = sorted(r[0] for r in f.select("f_own").distinct().collect())
    r = _nested(reads, "start", "end", width, used)
    key = ["contig", "level", "bin"]
    load = r.groupBy(*key).agg(F.count("*").alias("load")).filter(F.col("load") > most).select(*key, F.ceil(F.col("load") / most).alias("parts"))
    r = r.join(load, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*[f"`{c}`" for c in reads.columns]), "parts"), F.lit(0)).cast("long")).drop("parts")
    f = f.join(load, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long")))).drop("parts")
    hit = r.join(f, [*key, "part"]).filter("start <= f_end and f_start <= end and level = greatest(own, f_own)")
    return hit.filter(F.col("bin") == F.expr("greatest(start, f_start) div wide")).drop("bin", "level", "part", "own", "f_own", "wide")


def feature_assign(reads: DataFrame, features: DataFrame, key: list[str], width: int = 1 << 14, most: int = 200_000) -> DataFrame:
    """Each read (named by key) with the one gene it overlaps, else __no_feature or __ambiguous."""
    hit = overlaps(reads, features, width, most).groupBy(*key).agg(F.min("gene_id").alias("lo"), F.max("gene_id").alias("hi"))
    gene = F.when(F.col("lo").isNull(), NO_FEATURE).when(F.col("lo") != F.col("hi"), AMBIGUOUS).otherwise(F.col("lo").cast("string"))
    return reads.join(hit, key, "left").withColumn("gene_id", gene).drop("lo", "hi")


def feature_counts(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Reads per gene, special rows included."""
    return assigned.groupBy(*by, "gene_id").agg(F.count("*").alias("count"))


def counts_above(assigned: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """feature_counts() of identity_filter() for all thresholds at once: (by..., threshold, gene_id, count), special rows included.

    A read is counted once, under the number of thresholds it passes; the count of a threshold is the sum of its own step and of all
    above, so no read is copied.
    """
    steps = sorted(set(map(float, thresholds)))
    passed = sum((F.coalesce((F.col("identity") > t).cast("int"), F.lit(0)) for t in steps[1:]), F.lit(1))
    each = assigned.withColumn("__step", passed).groupBy(*by, "gene_id", "__step").agg(F.count("*").alias("n"))
    at_least = [F.struct(F.lit(t).alias("threshold"), F.sum(F.when(F.col("__step") > k, F.col("n")).otherwise(0)).alias("count")) for k, t in enumerate(steps)]
    return each.groupBy(*by, "gene_id").agg(F.array(*at_least).alias("t")).select(*by, "gene_id", F.inline("t")).filter("count > 0")


def cpm(counts: DataFrame, libraries: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Counts per million of the library size, times the normalisation factor where factors(genome_id, sample_id, factor) are given."""
    out = counts.join(libraries, "sample_id")
    if factors is None:
        return out.withColumn("cpm", F.col("count") / F.col("lib_size") * 1e6)
    out = out.join(factors, ["genome_id", "sample_id"], "left")
    return out.withColumn("cpm", F.col("count") / (F.col("lib_size") * F.coalesce("factor", F.lit(1.0))) * 1e6)


def min_cpm_filter(with_cpm: DataFrame, min_cpm: float, min_samples: int) -> DataFrame:
    """(genome_id, group_id) with more than min_samples samples above min_cpm."""
    return with_cpm.groupBy("genome_id", "group_id").agg(F.count_if(F.col("cpm") > min_cpm).alias("n")).filter(F.col("n") > min_samples).select("genome_id", "group_id")
