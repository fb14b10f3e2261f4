"""Building annotations from GFF lines and gene-to-value files; cleaning and auditing them.

GFF lines are rows (genome_id, ord, line); fields are those of the format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
#: Annotation files of a genome, by type.
TYPES = ["cog", "ko", "pfam", "tigrfam", "clstr", "go", "kegg", "kog"]
#: Feature types that are masked.
MASKED = ["CRISPR", "direct", "tandem", "inverted"]


def _masked():
    return F.col("type").rlike("|".join(MASKED))


def gff_fields(lines: DataFrame, feature: str | None = "CDS", ignore_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with FIELDS of the lines that have nine of them and the feature type, and the lines that have not; comments are skipped."""
    parts = lines.filter(~F.col("line").rlike(r"^\s*#") & (F.trim("line") != "")).withColumn("f", F.split("line", "\t"))
    bad = parts.filter(F.size("f") != len(FIELDS)).drop("f")
    good = parts.filter(F.size("f") == len(FIELDS))
    good = good.select(*[c for c in lines.columns if c != "line"], *[F.col("f")[k].alias(n) for k, n in enumerate(FIELDS)])
    if feature:
        good = good.filter(F.col("type").rlike(("(?i)" if ignore_case else "") + feature))
    return good.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")}), bad


def distinct_gff_tags(features: DataFrame) -> DataFrame:
    """(genome_id, tag) used in attributes, without exonNumber."""
    return features.select("genome_id", F.explode(F.map_keys(T.parse_attributes("attributes"))).alias("tag")).filter("tag <> 'exonNumber'").distinct()


def require_tag(tags: DataFrame, genomes: DataFrame, tag: str) -> DataFrame:
    """Genomes whose features never use the gene id tag."""
    return genomes.select("genome_id").join(tags.filter(F.col("tag") == tag).select("genome_id"), "genome_id", "left_anti")


def tags_per_gene(features: DataFrame, gene_tag: str, tags: list[str] | None = None) -> DataFrame:
    """genome_id, gene_id, attrs (map); with tags given, a column each, NA where missing. The last row of a gene counts."""
    rows = features.withColumn("attrs", T.parse_attributes("attributes")).withColumn("gene_id", F.col("attrs")[gene_tag]).filter("gene_id is not null")
    last = rows.groupBy("genome_id", "gene_id").agg(F.max_by("attrs", "ord").alias("attrs"))
    if tags is None:
        return last
    return last.select("genome_id", "gene_id", *[T.null_to_na(F.col("attrs")[t]).alias(t) for t in tags if t != gene_tag])


def annotation_outer_join(genes: DataFrame, values: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """genes(genome_id, gene_id) and values(genome_id, gene_id, ann_type, value, ord) -> one row per gene of either, a column per type, NA where missing.

    One shuffle in place of a full join per type. The last value of a gene and type counts.
    """
    rows = values.select("genome_id", "gene_id", "ann_type", "value", "ord").unionByName(genes.select("genome_id", "gene_id").withColumns({"ann_type": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "ord": F.lit(None).cast("long")}))
    one = [F.max_by("value", F.when(F.col("ann_type") == t, F.col("ord"))).alias(t) for t in types]
    return rows.groupBy("genome_id", "gene_id").agg(*one).na.fill("NA", types)


def mask_feature_rows(features: DataFrame, mode: str = "comment") -> DataFrame:
    """Repeat features get '#' before their seqid, or with mode='drop' go."""
    if mode == "drop":
        return features.filter(~_masked())
    return features.withColumn("seqid", F.when(_masked(), F.concat(F.lit("#"), "seqid")).otherwise(F.col("seqid")))


def clean_gff(lines: DataFrame, id_tag: str = "ID") -> tuple[DataFrame, DataFrame]:
    """Lines with quotes, products, spaced tags and strands put right and repeat features commented out; and the feature lines without the id tag. Comments stay."""
    text = T.fix_product_semicolon(T.fix_quotes("line"))
    f = lines.withColumn("f", F.split(text, "\t"))
    is_row = (F.size("f") == len(FIELDS)) & ~F.col("line").rlike(r"^\s*#")
    fixed = [F.col("f")[k] for k in range(len(FIELDS))]
    fixed[6], fixed[8] = T.fix_strand(fixed[6]), T.fix_space_tags(fixed[8])
    fixed[0] = F.when(F.col("f")[2].rlike("|".join(MASKED)), F.concat(F.lit("#"), fixed[0])).otherwise(fixed[0])
    out = f.withColumn("line", F.when(is_row, F.concat_ws("\t", *fixed)).otherwise(F.when(F.col("line").rlike(r"^\s*#"), F.col("line")).otherwise(text))).drop("f")
    no_id = out.filter(~F.col("line").rlike(r"^\s*#") & ~F.col("line").rlike(rf"(?i)(^|[;\t]){id_tag}="))
    return out, no_id


def gff_audit(lines: DataFrame) -> DataFrame:
    """Per genome the lines of each fault."""
    row = ~F.col("line").rlike(r"^\s*#") & (F.trim("line") != "")
    f = lines.filter(row).withColumn("f", F.split("line", "\t")).withColumn("a", F.coalesce(F.get("f", F.lit(8)), F.lit("")))
    return f.groupBy("genome_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.size("f") != len(FIELDS)).alias("n_bad_fields"),
        F.count_if((F.size("f") == len(FIELDS)) & ~F.get("f", F.lit(6)).isin("+", "-", ".", "?")).alias("n_bad_strand"),
        F.count_if(F.col("a").rlike(r"(^|;\s*)name ")).alias("n_space_tags"),
        F.count_if(F.coalesce(F.get("f", F.lit(2)), F.lit("")).rlike("|".join(MASKED))).alias("n_masked_types"),
        F.count_if(F.contains("line", F.lit('"'))).alias("n_quotes"),
        F.count_if(F.col("a").rlike(r"product=[^=]*;(?=[^=]*$)")).alias("n_product_semicolons"),
    )


def fasta_audit(lines: DataFrame) -> DataFrame:
    """Per genome: whether the first line is a header, and the headers with a space."""
    head = F.col("line").startswith(">")
    return lines.groupBy("genome_id").agg(F.min_by(head, "ord").alias("starts_with_header"), F.count_if(head).alias("n_headers"), F.count_if(head & F.contains("line", F.lit(" "))).alias("n_headers_with_space"))


def fix_fasta(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", T.fasta_id("line"))


def _value_before(rows: DataFrame, levels: int) -> DataFrame:
    """rows(key, value) with before: the value of the next smaller key. It is found within a slice of 65,536 neighbouring keys, or as the
    last value of the slice before, which is found alike among the slices; the window without a partition has a row for 65,536^levels keys."""
    cut = rows.withColumn("slice", F.expr(f"key div {1 << 16}"))
    w = Window.partitionBy("slice").orderBy("key")
    cut = cut.withColumns({"before": F.lag("value").over(w), "rank": F.row_number().over(w)})
    ends = cut.groupBy(F.col("slice").alias("key")).agg(F.max_by("value", "key").alias("value"))
    if levels > 1:
        ends = _value_before(ends, levels - 1)
    else:
        ends = ends.withColumn("before", F.lag("value").over(Window.orderBy("key")))
    ends = ends.select(F.col("key").alias("slice"), F.col("before").alias("slice_before"))
    return cut.join(ends, "slice").select("key", "value", F.when(F.col("rank") == 1, F.col("slice_before")).otherwise(F.col("before")).alias("before"))


def contiguous_blocks(rows: DataFrame) -> DataFrame:
    """(genome_id, n_blocks) of rows(genome_id, ord) whose rows come in more than one run.

    A row begins a run where the row before it has another genome; no task sorts all rows, nor the ends of all slices.
    """
    runs = _value_before(rows.select(F.col("ord").alias("key"), F.col("genome_id").alias("value")), 2)
    return runs.groupBy(F.col("value").alias("genome_id")).agg(F.count_if(~F.col("before").eqNullSafe(F.col("value"))).alias("n_blocks")).filter("n_blocks > 1")


def file_inventory(files: DataFrame, genomes: DataFrame, extensions: list[str]) -> DataFrame:
    """files(genome_id, extension, length) -> status of every expected file: ok, empty or missing."""
    wanted = genomes.select("genome_id", F.explode(F.array(*map(F.lit, extensions))).alias("extension"))
    got = wanted.join(files.groupBy("genome_id", "extension").agg(F.max("length").alias("length")), ["genome_id", "extension"], "left")
    return got.select("genome_id", "extension", F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").otherwise("ok").alias("status"))


def db_audit(inventory: DataFrame, gff: DataFrame, fasta: DataFrame, order: DataFrame) -> DataFrame:
    """All faults of all genomes as (genome_id, ord, fault, n), in the order of order(genome_id, ord)."""
    files = inventory.filter("status <> 'ok'").select("genome_id", F.concat_ws(" ", "status", "extension").alias("fault"), F.lit(1).cast("long").alias("n"))
    names = [c for c in gff.columns if c.startswith("n_") and c != "n_lines"]
    lines = gff.select("genome_id", F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("fault"), F.col(c).alias("n")) for c in names])).alias("x")).select("genome_id", "x.*").filter("n > 0")
    heads = fasta.select("genome_id", F.explode(F.array(F.struct(F.lit("headers_with_space").alias("fault"), F.col("n_headers_with_space").alias("n")), F.struct(F.lit("no_first_header").alias("fault"), F.when(F.col("starts_with_header"), 0).otherwise(1).cast("long").alias("n")))).alias("x")).select("genome_id", "x.*").filter("n > 0")
    return files.unionByName(lines).unionByName(heads).join(order.select("genome_id", "ord"), "genome_id")
