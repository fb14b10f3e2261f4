"""Readers of tab-separated layouts <root>/<genome_id>/<file>. Each gives the canonical columns; ord is the line's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import na_to_null

PATH = "_metadata.file_path"


def _genome() -> Column:
    """The folder a file lies in, <genome> or genome_id=<genome>."""
    return F.regexp_replace(F.element_at(F.split(F.col(PATH), "/"), -2), "^genome_id=", "")


def read_by_genome(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What write_by_genome() wrote, in the columns of schema, genome_id among them; no rows where none were written, as no file then tells the columns."""
    return spark.read.schema(schema).parquet(path).select(*[f"`{c}`" for c in schema.names])


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """genome_id, file, ord, line of text files, read in splits. ord grows along a file, from 0 in one read alone and by 1 within a split.

    It is the split's first byte and the row's number in the task (27 bits, enough for the lines of 128 MB). A genome may have
    several files; what holds for one file, as its header, is keyed by file.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << 27) - 1)
    ord_ = F.shiftleft(F.col("_metadata.file_block_start"), 27) + row
    return spark.read.text(path, recursiveFileLookup=True).select(_genome().alias("genome_id"), F.col(PATH).alias("file"), ord_.alias("ord"), F.col("value").alias("line"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """genome_id, ord, line as file_lines(), for one file a genome."""
    return file_lines(spark, path).drop("file")


def _heads(rows: DataFrame) -> DataFrame:
    """file, head_ord, head: the first line of each file; only the first split of a file has it."""
    return rows.filter(f"ord < {1 << 27}").groupBy("file").agg(F.min("ord").alias("head_ord"), F.min_by("f", "ord").alias("head"))


def _cells(rows: DataFrame, sep: str = "\t") -> DataFrame:
    return rows.withColumn("f", F.split("line", sep))


def read_gene_counts(spark: SparkSession, path: str) -> DataFrame:
    """genome_id, gene_id, sample_id, count, ord; lines whose first cell has 'name' in it are headers, and reading a file stops at its first with 'feature' in it. Each file's own header names its samples."""
    rows = _cells(file_lines(spark, path)).withColumn("id", F.col("f")[0])
    head = _heads(rows)
    stop = rows.filter(F.col("id").rlike("(?i)feature")).groupBy("file").agg(F.min("ord").alias("stop"))
    body = rows.join(head, "file").join(stop, "file", "left").filter(~F.col("id").rlike("(?i)name") & (F.col("stop").isNull() | (F.col("ord") < F.col("stop"))))
    pairs = F.arrays_zip(F.slice("head", 2, F.size("head")).alias("s"), F.slice("f", 2, F.size("f")).alias("n"))
    out = body.select("genome_id", F.col("id").alias("gene_id"), "ord", F.explode(pairs).alias("p"))
    return out.select("genome_id", "gene_id", F.col("p.s").alias("sample_id"), F.col("p.n").cast("long").alias("count"), "ord")


def find_column(columns: list[str], name: str) -> str:
    """The column of that name whatever its case."""
    hit = [c for c in columns if c.strip().lower() == name.lower()]
    if not hit:
        raise ValueError(f"no column {name!r} among {columns}")
    return hit[0]


def _headed(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, quote="", nullValue="")


def read_annotation(spark: SparkSession, path: str, gene_column: str, group_column: str) -> DataFrame:
    """genome_id, gene_id, group_raw, ord; columns are found by each file's own header whatever its case."""
    rows = _cells(file_lines(spark, path))
    head = _heads(rows).withColumn("head", F.transform("head", lambda x: F.lower(F.trim(x))))
    at = lambda c: F.get("f", F.array_position("head", c.lower()).cast("int") - 1)
    body = rows.join(head, "file").filter("ord > head_ord")
    return body.select("genome_id", at(gene_column).alias("gene_id"), at(group_column).alias("group_raw"), "ord").filter("gene_id is not null")


def read_group_catalog(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """group_id, ord. With column: the first header cell that contains it names the cell, and rows equal to the header go; else the first cell of every line. An empty catalog is an error."""
    rows = _cells(lines(spark, path))
    if column is None:
        out = rows.select(F.col("f")[0].alias("group_id"), "ord")
    else:
        head = rows.orderBy("ord").select("ord", "f").first()
        cells = list(head["f"]) if head else []
        place = next((k for k, c in enumerate(cells) if column.lower() in c.lower()), None)
        if place is None:
            raise ValueError(f"no column like {column!r} in {path}")
        out = rows.filter(F.col("ord") > head["ord"]).select(F.get("f", F.lit(place)).alias("group_id"), "ord").filter(~F.lower("group_id").contains(column.lower()))
    out = out.filter("trim(group_id) <> ''")
    if out.isEmpty():
        raise ValueError(f"no groups in {path}")
    return out


def read_genome_meta(spark: SparkSession, path: str, id_column: str = "ID") -> DataFrame:
    """All columns, NA as null, genome_id from id_column, spaces in Name as underscores."""
    raw = _headed(spark, path)
    out = raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns]).withColumn("genome_id", F.col(find_column(raw.columns, id_column)))
    return out.withColumn("Name", F.replace("Name", F.lit(" "), F.lit("_"))) if "Name" in raw.columns else out


def read_sample_meta(spark: SparkSession, path: str, include: DataFrame | None = None, exclude: DataFrame | None = None, id_column: str = "sample_name") -> DataFrame:
    """All columns, NA and ? as null, sample_id from id_column; restricted to include(id) without exclude(id)."""
    raw = _headed(spark, path)
    out = raw.select(*[na_to_null(F.col(f"`{c}`"), "?").alias(c) for c in raw.columns]).withColumn("sample_id", F.col(find_column(raw.columns, id_column)))
    if "reads" in raw.columns:
        out = out.withColumn("reads", F.col("reads").cast("long"))
    for ids, how in ((include, "left_semi"), (exclude, "left_anti")):
        if ids is not None:
            out = out.join(ids.withColumnRenamed("id", "sample_id"), "sample_id", how)
    return out


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: the first cell of each line that is not blank; no ids where the file is missing."""
    try:
        raw = spark.read.text(path)
        raw.schema  # noqa: B018  a missing path shows here
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string")
    return raw.select(F.trim(F.split("value", "\t")[0]).alias("id")).filter("id <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="genome_id string, sample_id string")


def read_gff_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path)


def _annotation_type() -> Column:
    """The type in a file's name <genome>.<type>.tab.txt, or of its folder ann_type=<type>."""
    folder = F.regexp_extract(F.col(PATH), r"/ann_type=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(F.col(PATH), r"\.([A-Za-z_]+)\.tab\.txt$", 1))


def _genome_above() -> Column:
    """The genome's folder: that of the file, or the one above its folder ann_type=<type>."""
    parts = F.split(F.col(PATH), "/")
    folder = F.when(F.element_at(parts, -2).startswith("ann_type="), F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    return F.regexp_replace(folder, "^genome_id=", "")


def read_annotation_pairs(spark: SparkSession, root: str, gene_column: str = "proteinId", files: str = "*/*.tab.txt") -> DataFrame:
    """genome_id, gene_id, ann_type, value, ord of <root>/<genome>/<genome>.<type>.tab.txt, read in splits.

    value: all cells after the first, tabs between them. Of each file the first line that has the gene column's name in it, whatever
    its case, is a header, and the first line of a gff_annote file is one always. A gene's last row is the one that counts downstream.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << 27) - 1)
    ord_ = F.shiftleft(F.col("_metadata.file_block_start"), 27) + row
    rows = spark.read.text(f"{root}/{files}").select(_genome_above().alias("genome_id"), _annotation_type().alias("ann_type"), F.col(PATH).alias("file"), ord_.alias("ord"), F.regexp_replace("value", "\r$", "").alias("line"))
    named = F.when(F.col("ann_type") == "gff_annote", F.col("ord") < (1 << 27)).otherwise(F.contains(F.lower("line"), F.lit(gene_column.lower())))
    heads = rows.filter(named).groupBy("file").agg(F.min("ord").alias("head"))
    body = rows.filter("line <> ''").join(heads, "file", "left").filter(F.col("head").isNull() | (F.col("ord") != F.col("head")))
    value = F.when(F.contains("line", F.lit("\t")), F.regexp_replace("line", "^[^\t]*\t", ""))
    return body.select("genome_id", F.split("line", "\t")[0].alias("gene_id"), "ann_type", value.alias("value"), "ord")


def missing_annotation_files(spark: SparkSession, root: str, genomes: DataFrame, types: list[str], files: str = "*/*.tab.txt") -> DataFrame:
    """genome_id, ann_type of every expected file of read_annotation_pairs() that is not there or empty, whose annotation is NA throughout. Only the listing is read."""
    wanted = genomes.select(F.col("genome_id").cast("string").alias("genome_id"), F.explode(F.array(*map(F.lit, types))).alias("ann_type"))
    listed = spark.read.format("binaryFile").load(f"{root}/{files}").filter("length > 0").select(_genome_above().alias("genome_id"), _annotation_type().alias("ann_type")).distinct()
    return wanted.join(listed, ["genome_id", "ann_type"], "left_anti")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """genome_id, group_id, log_fc, fdr of space-separated tables with a header; fields 0, 1 and 4 count."""
    f = F.split(F.translate("line", '"', ""), r"\s+")
    rows = _cells(file_lines(spark, path))
    return rows.join(_heads(rows), "file").filter("ord > head_ord").select("genome_id", f[0].alias("group_id"), f[1].cast("double").alias("log_fc"), f[4].cast("double").alias("fdr"))


def read_da_table(spark: SparkSession, path: str) -> DataFrame:
    """Wide code table -> genome_id, group_id, code; the first header cell must be grp_id. Cells meet the header's by their place, so no column is made of a genome."""
    return read_wide(spark, path, "grp_id").select(F.col("column").alias("genome_id"), F.col("row").alias("group_id"), F.col("value").cast("int").alias("code"))


def read_wide(spark: SparkSession, path: str, corner: str) -> DataFrame:
    """row, column, value of the cells of a tab-separated table in one or more files; lines that begin with the corner cell are the header."""
    rows = _cells(file_lines(spark, path))
    heads = rows.filter(F.col("f")[0] == corner)
    if heads.isEmpty():
        first = rows.orderBy("file", "ord").select("f").first()
        raise ValueError(f"the first column is {first['f'][0] if first else None!r}, not {corner!r}")
    names = heads.select(F.posexplode("f").alias("place", "column")).filter("place > 0").distinct()
    cells = rows.filter(F.col("f")[0] != corner).select(F.col("f")[0].alias("row"), F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("at", "value"))
    return cells.withColumn("place", F.col("at") + 1).join(names, "place").select("row", "column", "value")


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="genome_id string, group_id string, gene_id string")


def read_categories(spark: SparkSession, path: str, group_column: str, func_column: str = "func") -> DataFrame:
    raw = _headed(spark, path)
    return raw.select(F.col(find_column(raw.columns, group_column)).alias("group_id"), F.col(find_column(raw.columns, func_column)).alias("func"))


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", row: str = "row") -> DataFrame:
    """A headed numeric matrix -> row, column, value; NA and empty cells are null."""
    wide = _headed(spark, path, sep)
    first = wide.columns[0]
    return wide.unpivot([f"`{first}`"], [f"`{c}`" for c in wide.columns[1:]], "column", "value").select(F.col(first).alias(row), "column", na_to_null(F.col("value")).cast("double").alias("value"))


def read_copy_number(spark: SparkSession, path: str) -> DataFrame:
    """group_id, genome_id, copies of a headed group by genome table."""
    return read_matrix(spark, path, row="group_id").select("group_id", F.col("column").alias("genome_id"), F.col("value").cast("long").alias("copies"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """genome_id, extension, length of the files in <root>/<genome>/; contents are not read.

    A scan leaves empty files out, so their names come from the listing that Spark holds for it on the driver, which is as long as there are files.
    """
    files = spark.read.format("binaryFile").load(f"{root}/*/*")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    named = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(plain(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("path"))
    out = named.join(files.select(plain(F.col("path")).alias("path"), "length"), "path", "left")
    parts = F.split("path", "/")
    return out.select(F.regexp_replace(F.element_at(parts, -2), "^genome_id=", "").alias("genome_id"), F.regexp_extract(F.element_at(parts, -1), r"^[^.]*(\..*)$", 1).alias("extension"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))
