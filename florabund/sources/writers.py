"""Writers of results: Parquet by genome, and wide tab-separated tables in catalog and tree order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.annotate import TYPES
from ..operators.da import densify, set_genome
from ..operators.idspace import rank_rows
from .shared import stored


def write_by_genome(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Group counts, tests, code vectors or annotations: Parquet, a folder per genome."""
    df.write.mode(mode).partitionBy("genome_id").parquet(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")


def write_tsv_by_genome(df: DataFrame, path: str) -> None:
    """A headed tab-separated file per genome in <path>/genome_id=<genome>/."""
    df.repartition("genome_id").write.partitionBy("genome_id").csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")


def write_gene_count_table(wide: DataFrame, path: str, samples: list[str]) -> None:
    """Gene by sample table per genome, its first column called name."""
    write_tsv_by_genome(wide.select("genome_id", F.col("gene_id").alias("name"), *[f"`{s}`" for s in samples]), path)


def write_da_columns(da: DataFrame, genomes: DataFrame, groups: DataFrame, passed: DataFrame, path: str) -> None:
    """Per genome the code of every group in <path>/full and of the groups that passed a filter in <path>/filtered, -3 where nothing is stored."""
    write_by_genome(densify(da, genomes, groups), f"{path}/full")
    write_by_genome(densify(da.join(passed, "group_id", "left_semi"), genomes, groups.join(passed, "group_id", "left_semi")), f"{path}/filtered")


def write_cluster_summary(summary: DataFrame, path: str) -> None:
    """Headed table of counts per cluster, first column grp_id."""
    write_tsv(summary.select(F.col("group_id").alias("grp_id"), "n_genomes", "da_count", "da_up", "da_dn", "pa_count"), path)


def write_annotation(wide: DataFrame, path: str) -> None:
    """Joined annotation: gene_id, then the types in their fixed order, Parquet by genome."""
    write_by_genome(wide.select("genome_id", "gene_id", *TYPES), path)


def wide_group_counts(counts: DataFrame, groups: DataFrame, samples: list[str], name: str = "group") -> DataFrame:
    """Group by sample table in catalog order, zeros included, first column <name>Id."""
    wide = counts.groupBy("genome_id", "group_id").pivot("sample_id", samples).agg(F.sum("count").cast("long")).na.fill(0, samples)
    return wide.join(groups.select("group_id", "ord"), "group_id").orderBy("genome_id", "ord").select("genome_id", F.col("group_id").alias(f"{name}Id"), *[f"`{s}`" for s in samples])


def wide_lines(cells: DataFrame, rows: DataFrame, n_columns: DataFrame | int, blank: str) -> DataFrame:
    """cells(row_id, place, value), rows(row_id, ...) -> rows with line: row_id and a cell for each place from 1 to n_columns, blank where there is none.

    A row holds its own cells only, in one array by place; the blanks between two are written by their number. So a row may have
    any number of columns, and costs the length of its line.
    """
    n = F.lit(n_columns)
    own = cells.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("value").cast("string").alias("value")))).alias("c"))
    joined = rows.join(own, "row_id", "left")
    gap = lambda k: F.repeat(F.lit("\t" + blank), k.cast("int"))
    c = F.coalesce("c", F.array().cast("array<struct<place: int, value: string>>"))
    cell = lambda x, i: F.concat(gap(x["place"] - F.coalesce(F.get("c", i - 1)["place"], F.lit(0)) - 1), F.lit("\t"), x["value"])
    rest = gap(n - F.coalesce(F.get("c", F.size("c") - 1)["place"], F.lit(0)))
    return joined.withColumn("line", F.concat(F.col("row_id").cast("string"), F.array_join(F.transform(c, cell), ""), rest)).drop("c")


def write_wide(cells: DataFrame, rows: DataFrame, columns: DataFrame, path: str, corner: str, blank: str) -> None:
    """cells(row_id, column_id, value), rows(row_id, ord), columns(column_id, ord from 1 without gaps) as tab-separated text: a header, then the rows in order, a blank where there is no cell.

    Files are in the order of the rows; the header is the first line of the first. Columns are places in a line, so there may be a million of them.
    """
    names = columns.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("column_id").cast("string").alias("c")))), lambda x: x["c"]), "\t").alias("names"), F.count("*").alias("n")).first()
    places = columns.select("column_id", F.col("ord").cast("int").alias("place"))
    body = wide_lines(cells.join(places, "column_id").select("row_id", "place", "value"), rows.select("row_id", "ord"), names["n"], blank).select("ord", "line")
    head = body.sparkSession.createDataFrame([(-1, corner + ("\t" + names["names"] if names["n"] else ""))], "ord long, line string")
    body.withColumn("ord", F.col("ord").cast("long")).unionByName(head).orderBy("ord").select("line").write.text(path)


def write_da_table(da: DataFrame, groups: DataFrame, order: DataFrame, path: str, absent: int = -3) -> None:
    """Code table of groups(group_id, ord) by genomes of order(genome_id, ord): grp_id and a column per genome in tree order, rows in catalog order."""
    cells = da.select(F.col("group_id").alias("row_id"), F.col("genome_id").alias("column_id"), F.col("code").alias("value"))
    write_wide(cells, groups.select(F.col("group_id").alias("row_id"), "ord"), order.select(F.col("genome_id").alias("column_id"), "ord"), path, "grp_id", str(absent))


def write_filtered_da_table(da: DataFrame, groups: DataFrame, passed: DataFrame, order: DataFrame, path: str) -> None:
    write_da_table(da.join(passed, "group_id", "left_semi"), groups.join(passed, "group_id", "left_semi"), order, path)


def write_cluster_matrix(da: DataFrame, kept: DataFrame, order: DataFrame, path: str, absent: int = -3) -> None:
    """Code table of genomes of order(genome_id, ord) by the kept groups alone, sorted: genome_id and a column per group."""
    columns = rank_rows(kept.select(F.col("group_id").alias("column_id")).distinct(), "column_id")
    cells = da.select(F.col("genome_id").alias("row_id"), F.col("group_id").alias("column_id"), F.col("code").alias("value"))
    write_wide(cells, order.select(F.col("genome_id").alias("row_id"), "ord"), columns, path, "genome_id", str(absent))


def upsert_codes(da: DataFrame, new: DataFrame, genomes: DataFrame, groups: DataFrame, path: str) -> DataFrame:
    """set_genome() in place on the folders by genome at `path`, which da reads: only the folders of genomes in `new` are written anew. Returns the refused rows.

    What the touched genomes keep is stored before their folders are replaced; all other files stay as they are."""
    touched = new.select("genome_id").distinct()
    out, refused = set_genome(da.join(touched, "genome_id", "left_semi"), new, genomes, groups)
    out, refused = stored(out), stored(refused)
    out.repartition("genome_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("genome_id").parquet(path)
    return refused


def wide_da_table(da: DataFrame, groups: DataFrame, genomes_in_order: list[str], absent: int = -3) -> DataFrame:
    """Code table: grp_id and a column per genome in tree order, rows in catalog order, absent where nothing is stored."""
    place = F.array_position(F.array(*[F.lit(g) for g in genomes_in_order]), F.col("genome_id")).cast("int")
    cells = da.select(F.col("group_id").alias("row_id"), place.alias("place"), F.col("code").alias("value")).filter("place > 0")
    out = wide_lines(cells, groups.select(F.col("group_id").alias("row_id"), "ord"), len(genomes_in_order), str(absent)).withColumn("f", F.split("line", "\t"))
    back = lambda k: F.element_at("f", k - len(genomes_in_order)).cast("int")  # noqa: E731  from the end: an id may hold a tab
    return out.orderBy("ord").select(F.col("row_id").alias("grp_id"), *[back(k).alias(str(g)) for k, g in enumerate(genomes_in_order)])


def wide_filtered_da_table(da: DataFrame, groups: DataFrame, passed: DataFrame, genomes_in_order: list[str]) -> DataFrame:
    return wide_da_table(da.join(passed, "group_id", "left_semi"), groups.join(passed, "group_id", "left_semi"), genomes_in_order)


def wide_cluster_matrix(dense: DataFrame, clusters: list[str]) -> DataFrame:
    """A row per genome, a column per kept cluster, clusters sorted."""
    return dense.groupBy("genome_id").pivot("group_id", sorted(clusters)).agg(F.first("code"))


def wide_enrichment(codes: DataFrame, genomes: list[str]) -> DataFrame:
    """Category by genome matrix of 0 to 3."""
    return codes.groupBy("category").pivot("genome_id", genomes).agg(F.first("code"))


def split_cluster_map(cluster_map: DataFrame, path: str) -> None:
    """gene_id, group_id, a folder per genome; genomes in several blocks keep all their rows (see contiguous_blocks for the report)."""
    cluster_map.select("gene_id", "group_id", "genome_id").write.partitionBy("genome_id").parquet(path)


def ordered(rows: DataFrame, order: DataFrame, key: str = "genome_id") -> DataFrame:
    """Metadata or ids in tree order."""
    return rows.join(order.select(key, "ord"), key).orderBy("ord").drop("ord")


def write_ordered(rows: DataFrame, order: DataFrame, path: str, key: str = "genome_id") -> None:
    """Metadata or ids in tree order, one headed file: a row per leaf of a tree."""
    write_tsv(ordered(rows, order, key).coalesce(1), path)
