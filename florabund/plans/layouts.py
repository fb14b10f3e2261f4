"""Queries of readers and writers: tables of the star are written in each layout to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotate, counts, da, idspace
from ..sources import readers, writers
from ..sources.shared import new_folder
from .queries import _KEPT, _SUMMARY, _leaves, _n, query
from .star import Star

_KINDS = "cog ko pfam tigrfam clstr go kegg kog".split()
_KINDS_SQL = f"{_KINDS}"
_RAW = "SELECT genome_id, gene_id, CAST(coalesce(sum(count) FILTER (sample_id = 'F'), 0) AS BIGINT) AS f, CAST(coalesce(sum(count) FILTER (sample_id = 'O'), 0) AS BIGINT) AS o FROM raw_counts GROUP BY 1, 2"


def _count_tables(s: Star) -> str:
    path = new_folder(s.spark, "gene-counts")
    writers.write_gene_count_table(counts.wide_counts(s.raw_counts(), ["F", "O"], ["genome_id", "gene_id"]), path, ["F", "O"])
    return path


@query(f"WITH w AS ({_RAW}) SELECT CAST(genome_id AS VARCHAR) AS genome_id, CAST(gene_id AS VARCHAR) AS gene_id, unnest(['F', 'O']) AS sample_id, unnest([f, o]) AS count FROM w")
def s1_read_gene_counts(s: Star) -> DataFrame:
    return readers.read_gene_counts(s.spark, f"{_count_tables(s)}/*/*.csv").select("genome_id", "gene_id", "sample_id", "count")


@query(f"WITH w AS ({_RAW}) SELECT genome_id, CAST(gene_id AS BIGINT) AS name, f AS \"F\", o AS \"O\" FROM w")
def k10_write_gene_count_table(s: Star) -> DataFrame:
    raw = s.spark.read.csv(_count_tables(s), sep="\t", header=True)
    return raw.select(F.col("genome_id").cast("int").alias("genome_id"), *[F.col(c).cast("long").alias(c) for c in ("name", "F", "O")])


@query("SELECT CAST(p_partkey % 25 AS VARCHAR) AS genome_id, CAST(p_partkey AS VARCHAR) AS gene_id, group_raw FROM annotation JOIN part ON gene_id = p_partkey")
def s2_read_annotation(s: Star) -> DataFrame:
    path = new_folder(s.spark, "annotation")
    rows = s.annotation().select((F.col("gene_id") % 25).alias("genome_id"), F.lit("x").alias("name"), F.col("gene_id").alias("ProteinId"), F.col("group_raw").alias("kogId"))
    writers.write_tsv_by_genome(rows, path)
    return readers.read_annotation(s.spark, f"{path}/*/*.csv", "proteinid", "kogid").select("genome_id", "gene_id", "group_raw")


@query("SELECT group_id, ord FROM groups")
def s3_read_group_catalog(s: Star) -> DataFrame:
    path = new_folder(s.spark, "catalog")
    writers.write_tsv(s.groups().orderBy("ord").select(F.col("group_id").alias("kogId"), F.lit("a name").alias("kogName")).coalesce(1), path)
    return readers.read_group_catalog(s.spark, path, "kogid")


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, replace(name, 'NATION_', 'nation_') AS name, CASE WHEN label = 'PA' THEN label END AS label FROM genomes")
def s4_read_genome_meta(s: Star) -> DataFrame:
    path = new_folder(s.spark, "genome-meta")
    rows = s.genomes().select(F.col("genome_id").alias("Id"), F.regexp_replace("name", "NATION_", "nation ").alias("Name"), F.when(F.col("label") == "PA", "PA").otherwise("NA").alias("Label"))
    writers.write_tsv(rows, path)
    return readers.read_genome_meta(s.spark, path, "ID").select("genome_id", F.col("Name").alias("name"), F.col("Label").alias("label"))


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, CASE WHEN fraction <> 'BUILDING' THEN fraction END AS fraction, reads FROM samples WHERE sample_id IN (SELECT o_custkey FROM orders) AND reads >= 1000")
def s5_read_sample_meta(s: Star) -> DataFrame:
    path = new_folder(s.spark, "sample-meta")
    rows = s.samples().select(F.col("sample_id").alias("Sample_Name"), F.when(F.col("fraction") == "BUILDING", "?").otherwise(F.col("fraction")).alias("fraction"), "reads")
    writers.write_tsv(rows, path)
    ids = lambda df, c: df.select(F.col(c).cast("string").alias("id")).distinct()
    out = readers.read_sample_meta(s.spark, path, ids(s.table("orders"), "o_custkey"), ids(s.samples().filter("reads < 1000"), "sample_id"), "sample_name")
    return out.select("sample_id", "fraction", "reads")


@query("SELECT CAST(sample_id AS VARCHAR) AS id FROM samples")
def s6_read_id_list(s: Star) -> DataFrame:
    path = new_folder(s.spark, "ids")
    line = F.concat_ws("\t", F.col("sample_id").cast("string"), "fraction")
    s.samples().select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return readers.read_id_list(s.spark, path)


@query("SELECT DISTINCT CAST(genome_id AS VARCHAR) AS genome_id, sample_id FROM counts")
def s7_read_pairs(s: Star) -> DataFrame:
    path = new_folder(s.spark, "pairs")
    s.counts().select("genome_id", "sample_id").distinct().write.csv(path, sep="\t")
    return readers.read_pairs(s.spark, path)


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, ord, line FROM gff")
def s8_read_gff_lines(s: Star) -> DataFrame:
    path = new_folder(s.spark, "gff")
    s.gff().select("genome_id", F.concat_ws("\x01", F.lpad(F.col("ord").cast("string"), 12, "0"), "line").alias("value")).repartition("genome_id").sortWithinPartitions("genome_id", "value").write.partitionBy("genome_id").text(path)
    cut = readers.read_gff_lines(s.spark, f"{path}/*/*.txt").select("genome_id", F.split("line", "\x01").alias("f"))
    return cut.select("genome_id", F.col("f")[0].cast("long").alias("ord"), F.col("f")[1].alias("line"))


def _pair_files(s: Star) -> str:
    """Brands and sizes of parts as annotation files, by nation and type; a header in every other type's, none for type ko of every third nation."""
    path = new_folder(s.spark, "pairs-by-type")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 8 + 1).cast("int"))
    rows = s.table("part").select((k % 25).alias("genome_id"), kind.alias("ann_type"), F.lit(1).alias("at"), k, F.concat_ws("\t", (k % 500).cast("string"), "p_brand", F.when(k % 3 == 0, F.col("p_size").cast("string"))).alias("value"))
    heads = s.genomes().select("genome_id", F.explode(F.array(*map(F.lit, _KINDS[::2]))).alias("ann_type"), F.lit(0).alias("at"), F.lit(0).alias("p_partkey"), F.lit("PROTEINID\tvalue").alias("value"))
    every = rows.unionByName(heads).filter("not (ann_type = 'ko' and genome_id % 3 = 0)")
    every.repartition("genome_id", "ann_type").sortWithinPartitions("genome_id", "ann_type", "at", "p_partkey").select("genome_id", "ann_type", "value").write.partitionBy("genome_id", "ann_type").text(path)
    return path


_PAIR_FILES = "*/*/*.txt"
_PAIRS = "SELECT p_partkey % 25 AS genome_id, p_partkey % 500 AS gene_id, p_partkey, p_brand || CASE WHEN p_partkey % 3 = 0 THEN chr(9) || p_size ELSE '' END AS value, ['cog', 'ko', 'pfam', 'tigrfam', 'clstr', 'go', 'kegg', 'kog'][p_partkey % 8 + 1] AS ann_type FROM part"


@query(f"SELECT CAST(genome_id AS VARCHAR) AS genome_id, CAST(gene_id AS VARCHAR) AS gene_id, ann_type, value FROM ({_PAIRS}) WHERE NOT (ann_type = 'ko' AND genome_id % 3 = 0)")
def s9_read_annotation_pair_files(s: Star) -> DataFrame:
    return readers.read_annotation_pairs(s.spark, _pair_files(s), files=_PAIR_FILES).select("genome_id", "gene_id", "ann_type", "value")


@query(f"SELECT CAST(genome_id AS VARCHAR) AS genome_id, ann_type FROM genomes CROSS JOIN (SELECT unnest({_KINDS_SQL}) AS ann_type) k WHERE (ann_type = 'ko' AND genome_id % 3 = 0) OR (ann_type IN ('ko', 'tigrfam', 'go', 'kog') AND NOT EXISTS (SELECT 1 FROM ({_PAIRS}) p WHERE p.genome_id = genomes.genome_id AND p.ann_type = k.ann_type))")
def s9_missing_annotation_files(s: Star) -> DataFrame:
    return readers.missing_annotation_files(s.spark, _pair_files(s), s.genomes(), _KINDS, files=_PAIR_FILES)


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, '.gff' AS extension, CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM gff WHERE genome_id % 4 <> 0 GROUP BY 1")
def s15_read_files(s: Star) -> DataFrame:
    return readers.read_files(s.spark, _gff_files(s)).groupBy("genome_id").agg(F.lit(".gff").alias("extension"), F.sum("length").alias("length"))


@query("SELECT CAST(g.genome_id AS VARCHAR) AS genome_id, e.extension, CASE WHEN e.extension = 'none' OR g.genome_id % 4 = 0 OR f.genome_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM genomes g CROSS JOIN (SELECT unnest(['gff', 'none']) AS extension) e LEFT JOIN (SELECT DISTINCT genome_id FROM gff) f USING (genome_id)")
def s15_inventory_of_files(s: Star) -> DataFrame:
    files = readers.read_files(s.spark, _gff_files(s)).withColumn("extension", F.lit("gff"))
    return annotate.file_inventory(files, s.genomes().select(F.col("genome_id").cast("string").alias("genome_id")), ["gff", "none"])


def _gff_files(s: Star) -> str:
    """A file of GFF lines in the folder of each nation but every fourth."""
    path = new_folder(s.spark, "genome-files")
    s.gff().filter("genome_id % 4 <> 0").select("genome_id", "line").repartition("genome_id").write.partitionBy("genome_id").text(path)
    return path


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, replace(group_id, ' ', '_') AS group_id, log_fc, fdr FROM tags")
def s10_read_tags(s: Star) -> DataFrame:
    path = new_folder(s.spark, "tags")
    row = F.concat(F.lit('"'), F.replace("group_id", F.lit(" "), F.lit("_")), F.lit('" '), F.col("log_fc").cast("string"), F.lit(" 0 0 "), F.col("fdr").cast("string"))
    head = s.genomes().select("genome_id", F.lit('"logFC" "logCPM" "PValue" "FDR"').alias("value"), F.lit(0).alias("ord"))
    rows = s.tags().select("genome_id", row.alias("value"), F.lit(1).alias("ord")).union(head)
    rows.repartition("genome_id").sortWithinPartitions("genome_id", "ord").drop("ord").write.partitionBy("genome_id").text(path)
    return readers.read_tags(s.spark, f"{path}/*/*.txt")


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, group_id, code FROM dense")
def s11_read_da_table(s: Star) -> DataFrame:
    path = new_folder(s.spark, "da-table")
    catalog = s.cluster_groups().withColumn("ord", F.lit(0))  # one part per task, so the order is not kept here
    writers.write_tsv(writers.wide_da_table(s.da(), catalog, list(range(25))), path)
    return readers.read_da_table(s.spark, path)


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, group_id, CAST(gene_id AS VARCHAR) AS gene_id FROM cluster_map")
def s12_read_cluster_map(s: Star) -> DataFrame:
    path = new_folder(s.spark, "cluster-map")
    s.cluster_map().select("genome_id", "group_id", "gene_id").write.csv(path, sep="\t")
    return readers.read_cluster_map(s.spark, path)


@query("SELECT group_id, func FROM categories")
def s13_read_categories(s: Star) -> DataFrame:
    path = new_folder(s.spark, "categories")
    writers.write_tsv(s.categories().select(F.col("group_id").alias("kogId"), F.lit("x").alias("name"), F.col("func").alias("FUNC")), path)
    return readers.read_categories(s.spark, path, "kogid", "func")


@query("SELECT group_id, 's' || sample_id AS sample_id, CAST(sum(count) AS DOUBLE) AS value FROM group_counts GROUP BY 1, 2")
def s16_read_matrix_csv(s: Star) -> DataFrame:
    path = new_folder(s.spark, "matrix")
    names = sorted(r[0] for r in s.libraries().select("sample_id").collect())
    wide = s.group_counts().groupBy("group_id").pivot("sample_id", names).agg(F.sum("count"))
    wide.select("group_id", *[F.col(f"`{n}`").alias(f"s{n}") for n in names]).write.csv(path, header=True)
    return readers.read_matrix(s.spark, path, ",", "group_id").withColumnRenamed("column", "sample_id").filter("value is not null")


@query("SELECT group_id, CAST(genome_id AS VARCHAR) AS genome_id, copies FROM copies")
def s17_read_copy_number(s: Star) -> DataFrame:
    path = new_folder(s.spark, "copies")
    wide = s.copies().groupBy("group_id").pivot("genome_id", list(range(25))).agg(F.first("copies"))
    writers.write_tsv(wide, path)
    return readers.read_copy_number(s.spark, path).filter("copies is not null")


@query("SELECT genome_id, group_id, log_fc, fdr FROM tags")
def k2_write_tags(s: Star) -> DataFrame:
    path = new_folder(s.spark, "tests")
    tags = s.tags()
    writers.write_by_genome(tags, path)
    return readers.read_by_genome(s.spark, path, tags.schema).select("genome_id", "group_id", "log_fc", "fdr")


@query("SELECT genome_id, group_id, code FROM da")
def k3_write_da_vec(s: Star) -> DataFrame:
    path = new_folder(s.spark, "codes")
    codes = s.da()
    writers.write_by_genome(codes, path)
    return readers.read_by_genome(s.spark, path, codes.schema).select("genome_id", "group_id", "code")


_KEEP = "SELECT group_id FROM da GROUP BY 1 HAVING count(*) FILTER (code = 1) * 100.0 / (SELECT count(*) FROM genomes) >= 20"


@query(f"WITH keep AS ({_KEEP}) SELECT genome_id, group_id, code, group_id IN (SELECT group_id FROM keep) AS filtered FROM dense")
def k6_write_da_columns(s: Star) -> DataFrame:
    path = new_folder(s.spark, "columns")
    codes = s.da()
    writers.write_da_columns(codes, s.genomes(), s.cluster_groups(), da.da_percent_filter(codes, {1: (20, True)}, _n(s)), path)
    both = [readers.read_by_genome(s.spark, f"{path}/{kind}", codes.schema).withColumn("kind", F.lit(kind)) for kind in ("full", "filtered")]
    return both[0].unionByName(both[1]).groupBy("genome_id", "group_id", "code").agg(F.bool_or(F.col("kind") == "filtered").alias("filtered"))


@query(f"SELECT group_id AS grp_id, n_genomes, da_count, da_up, da_dn, pa_count FROM ({_SUMMARY})")
def k7_write_cluster_summary(s: Star) -> DataFrame:
    path = new_folder(s.spark, "summary")
    writers.write_cluster_summary(da.cluster_summary(s.da(), s.cluster_groups(), da.pa_cluster_count(s.cluster_map(), s.genomes())), path)
    back = s.spark.read.csv(path, sep="\t", header=True)
    return back.select("grp_id", *[F.col(c).cast("long").alias(c) for c in back.columns[1:]])




@query(
    "SELECT p_partkey % 25 AS genome_id, p_partkey % 500 AS gene_id, "
    + ", ".join(f"coalesce(arg_max(p_brand, p_partkey) FILTER (p_partkey % 8 = {k}), 'NA') AS {t}" for k, t in enumerate(_KINDS))
    + " FROM part GROUP BY 1, 2"
)
def k11_write_annotation(s: Star) -> DataFrame:
    path = new_folder(s.spark, "all-annote")
    k = F.col("p_partkey")
    kind = F.array(*map(F.lit, _KINDS))[(k % 8).cast("int")]
    values = s.table("part").select((k % 25).alias("genome_id"), (k % 500).alias("gene_id"), kind.alias("ann_type"), F.col("p_brand").alias("value"), k.alias("ord"))
    writers.write_annotation(annotate.annotation_outer_join(values.select("genome_id", "gene_id").distinct(), values, _KINDS), path)
    back = s.spark.read.parquet(path)
    return back.select("genome_id", "gene_id", *back.columns[1:9])  # the fixed order


@query("SELECT genome_id, group_id, gene_id FROM cluster_map")
def k12_split_cluster_map(s: Star) -> DataFrame:
    path = new_folder(s.spark, "clusters")
    clusters = s.cluster_map()
    writers.split_cluster_map(clusters, path)
    return readers.read_by_genome(s.spark, path, clusters.schema).select("genome_id", "group_id", "gene_id")


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, name, label, row_number() OVER (ORDER BY ord) - 1 AS place FROM genomes JOIN leaves ON leaf_id = CAST(genome_id AS VARCHAR)")
def k13_write_ordered_meta(s: Star) -> DataFrame:
    path = new_folder(s.spark, "ordered")
    meta = s.genomes().select(F.col("genome_id").cast("string").alias("genome_id"), "name", "label")
    writers.write_ordered(meta, _leaves(s).select(F.col("leaf_id").alias("genome_id"), "ord"), path)
    rows = readers.lines(s.spark, path).filter("line not like 'genome_id%'").select(F.col("ord"), F.split("line", "\t").alias("f"))
    return rows.select(*[F.col("f")[k].alias(c) for k, c in enumerate(("genome_id", "name", "label"))], (F.col("ord") - 1).alias("place"))


def _order(s: Star) -> DataFrame:
    """Nations in tree order."""
    return _leaves(s).select(F.col("leaf_id").cast("int").alias("genome_id"), "ord")


@query("SELECT CAST(genome_id AS VARCHAR) AS genome_id, group_id, code FROM dense")
def k4_write_da_table(s: Star) -> DataFrame:
    path = new_folder(s.spark, "da-lines")
    writers.write_da_table(s.da(), idspace.rank_rows(s.cluster_groups(), "group_id"), _order(s), path)
    return readers.read_da_table(s.spark, path)


@query("WITH p AS (SELECT row_number() OVER (ORDER BY group_id) AS place, group_id FROM cluster_groups), h AS (SELECT string_agg(leaf_id, chr(9) ORDER BY ord) AS names FROM leaves) SELECT 0 AS place, 'grp_id' AS group_id, names AS cells FROM h UNION ALL SELECT place, group_id, string_agg(CAST(d.code AS VARCHAR), chr(9) ORDER BY l.ord) FROM p JOIN dense d USING (group_id) JOIN leaves l ON CAST(l.leaf_id AS INT) = d.genome_id GROUP BY 1, 2")
def k4_da_table_lines(s: Star) -> DataFrame:
    """The lines as they are written, with their place."""
    path = new_folder(s.spark, "da-lines")
    writers.write_da_table(s.da(), idspace.rank_rows(s.cluster_groups(), "group_id"), _order(s), path)
    rows = readers.file_lines(s.spark, path).select("file", "ord", "line")
    cut = idspace.rank_rows(rows, "file", "ord", name="place").withColumn("at", F.instr("line", "\t"))
    return cut.select((F.col("place") - 1).alias("place"), F.substring("line", F.lit(1), F.col("at") - 1).alias("group_id"), F.substring("line", F.col("at") + 1, F.length("line")).alias("cells"))


@query(f"SELECT CAST(genome_id AS VARCHAR) AS genome_id, group_id, code FROM dense WHERE group_id IN ({_KEEP})")
def k5_write_filtered_da_table(s: Star) -> DataFrame:
    path = new_folder(s.spark, "da-lines")
    writers.write_filtered_da_table(s.da(), idspace.rank_rows(s.cluster_groups(), "group_id"), da.da_percent_filter(s.da(), {1: (20, True)}, _n(s)), _order(s), path)
    return readers.read_da_table(s.spark, path)


@query(f"SELECT CAST(genome_id AS VARCHAR) AS genome_id, group_id, code FROM dense WHERE group_id IN ({_KEPT})")
def k8_write_cluster_matrix(s: Star) -> DataFrame:
    path = new_folder(s.spark, "matrix-lines")
    writers.write_cluster_matrix(s.da(), da.keep_da_clusters(s.da(), _n(s), 50.0), _order(s), path)
    return readers.read_wide(s.spark, path, "genome_id").select(F.col("row").alias("genome_id"), F.col("column").alias("group_id"), F.col("value").cast("int").alias("code"))


@query("SELECT genome_id, group_id, CASE WHEN genome_id % 5 = 0 AND code = 0 THEN 1 ELSE code END AS code FROM da")
def u11_upsert_in_place(s: Star) -> DataFrame:
    path = new_folder(s.spark, "codes")
    codes = s.da()
    writers.write_by_genome(codes, path)
    held = lambda: readers.read_by_genome(s.spark, path, codes.schema).select("genome_id", "group_id", "code")
    new = held().filter("genome_id % 5 = 0 and code = 0").withColumn("code", F.lit(1))
    writers.upsert_codes(held(), new, s.genomes(), s.cluster_groups(), path)
    return held()
