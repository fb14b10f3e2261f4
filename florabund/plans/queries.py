"""One query per operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, annotate, counts, da, idspace, stats
from ..sources import writers
from .star import CTES, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with(sql: str) -> str:
    """SQL with the CTES it names, directly or through others, in front."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(CTES[name])

    add(sql)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in need]
    own = re.match(r"\s*WITH\b", sql)
    if not parts:
        return sql
    return "WITH " + ", ".join(parts) + (", " + sql[own.end() :] if own else " " + sql)


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Star(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = _with(sql)
        return f

    return register


def r6(c: str):
    return (F.round(c, 6) + 0.0).alias(c)


# --- counts ---------------------------------------------------------------------------------

_ONCE = "SELECT genome_id, gene_id, sample_id, arg_min(count, ord) AS count FROM raw_counts GROUP BY 1, 2, 3"


@query(f"""WITH once AS ({_ONCE}),
  summed AS (SELECT genome_id, split_part(group_raw, ',', 1) AS group_id, sample_id, CAST(sum(count) AS BIGINT) AS count FROM once JOIN annotation USING (gene_id) GROUP BY 1, 2, 3)
  SELECT p.genome_id, g.group_id, p.sample_id, coalesce(s.count, 0) AS count
  FROM (SELECT DISTINCT genome_id, sample_id FROM raw_counts) p CROSS JOIN groups g LEFT JOIN summed s USING (genome_id, group_id, sample_id)""")
def a1_aggregate_counts(s: Star) -> DataFrame:
    return counts.aggregate_counts(s.raw_counts(), s.annotation(), s.groups())


@query("SELECT genome_id, sample_id, CAST(sum(count) AS BIGINT) AS total FROM counts GROUP BY 1, 2")
def a4_genome_abundance(s: Star) -> DataFrame:
    return counts.genome_abundance(s.counts())


@query("SELECT genome_id, sample_id, CAST(sum(count) AS BIGINT) AS total, l.ord FROM counts JOIN leaves l ON CAST(l.leaf_id AS INT) = genome_id GROUP BY genome_id, sample_id, l.ord")
def a4_abundance_in_tree_order(s: Star) -> DataFrame:
    return counts.genome_abundance(s.counts(), _leaves(s).select(F.col("leaf_id").cast("int").alias("genome_id"), "ord"))


@query("SELECT genome_id, group_id, regexp_replace(sample_id, '_[FO]$', '') AS sample_id, CAST(sum(count) AS BIGINT) AS count FROM group_counts GROUP BY 1, 2, 3")
def a6_combine_tech_reps(s: Star) -> DataFrame:
    return counts.combine_tech_reps(s.group_counts(), "_[FO]$")


@query("SELECT fraction AS sample_id, CAST(sum(reads) AS BIGINT) AS lib_size FROM (SELECT fraction, reads FROM samples UNION ALL SELECT l_linestatus, CAST(l_quantity AS BIGINT) FROM lineitem) WHERE reads > 10 GROUP BY 1")
def a7_library_sizes(s: Star) -> DataFrame:
    one = s.samples().select(F.col("fraction").alias("sample_id"), "reads")
    two = s.table("lineitem").select(F.col("l_linestatus").alias("sample_id"), F.col("l_quantity").cast("long").alias("reads"))
    return counts.library_sizes(one, two, where="reads > 10")


@query("WITH t AS (SELECT unnest([0.0, 20.0, 50.0]) AS threshold) SELECT sample_id, threshold, gene_id, count(*) AS count FROM assigned, t WHERE threshold = 0 OR identity > threshold GROUP BY 1, 2, 3")
def a13_feature_counts(s: Star) -> DataFrame:
    reads = counts.feature_assign(s.alignments(), s.features(), ["event_id"])
    return counts.counts_above(reads, ["sample_id"], [0.0, 20.0, 50.0])


@query("WITH l AS (SELECT contig, event_id // 500 AS k, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM alignments GROUP BY 1, 2), p AS (SELECT contig, start // 90000 AS \"start\", start // 90000 + 40 AS \"end\", event_id FROM alignments) SELECT p.event_id, count(l.k) AS n, min(l.k) AS first_k FROM p LEFT JOIN l ON l.contig = p.contig AND p.\"start\" * 90000 <= l.\"end\" AND l.\"start\" <= p.\"start\" * 90000 + 40 GROUP BY 1")
def j14_long_and_hot_intervals(s: Star) -> DataFrame:
    """Reads that pile up on few places against features of days to months: several levels of bins, and bins in parts."""
    a = s.alignments()
    long = a.groupBy("contig", F.expr("event_id div 500").alias("gene_id")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at = F.expr("start div 90000 * 90000")
    piled = a.select("event_id", "contig", at.alias("start"), (at + 40).alias("end"))
    hit = counts.overlaps(piled, long, most=50).groupBy("event_id").agg(F.count("*").alias("n"), F.min("gene_id").alias("first_k"))
    return piled.select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "first_k")


@query("SELECT event_id, gene_id FROM assigned")
def j14_feature_assign(s: Star) -> DataFrame:
    return counts.feature_assign(s.alignments(), s.features(), ["event_id"]).select("event_id", "gene_id")


@query("SELECT sample_id, gene_id, count(*) AS count FROM assigned WHERE left(gene_id, 2) <> '__' GROUP BY 1, 2")
def f1_drop_special_features(s: Star) -> DataFrame:
    return counts.feature_counts(counts.drop_special_features(counts.feature_assign(s.alignments(), s.features(), ["event_id"])), ["sample_id"])


@query("WITH t AS (SELECT unnest([10.0, 30.0, 60.0]) AS threshold) SELECT threshold, count(*) AS n, min(event_id) AS first_id FROM alignments, t WHERE threshold = 10 OR identity > threshold GROUP BY 1")
def f2_identity_filter(s: Star) -> DataFrame:
    return counts.identity_filter(s.alignments(), [10.0, 30.0, 60.0]).groupBy("threshold").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_CPM = "SELECT genome_id, group_id, sample_id, count * 1e6 / lib_size AS cpm FROM group_counts JOIN libraries USING (sample_id)"


@query(f"WITH c AS ({_CPM}) SELECT genome_id, group_id FROM c GROUP BY 1, 2 HAVING count(CASE WHEN round(cpm, 6) > 1500 THEN 1 END) > 3")
def f4_min_cpm_filter(s: Star) -> DataFrame:
    return counts.min_cpm_filter(counts.cpm(s.group_counts(), s.libraries()).withColumn("cpm", F.round("cpm", 6)), 1500.0, 3)


@query("SELECT genome_id, gene_id, sample_id, count FROM counts WHERE sample_id LIKE '%F'")
def f9_sample_projection(s: Star) -> DataFrame:
    return counts.sample_projection(s.counts(), s.conditions().filter("not is_other")).select("genome_id", "gene_id", "sample_id", "count")


@query("SELECT genome_id, gene_id, sample_id, count, split_part(group_raw, ',', 1) AS group_id FROM counts JOIN annotation USING (gene_id)")
def j1_counts_join_groups(s: Star) -> DataFrame:
    return counts.counts_join_groups(s.counts(), counts.first_group_wins(s.annotation())).select("genome_id", "gene_id", "sample_id", "count", "group_id")


@query("SELECT DISTINCT genome_id, gene_id FROM counts WHERE gene_id % 7 = 3")
def j1_genes_without_group(s: Star) -> DataFrame:
    """Every seventh gene's cell is NA, which is no group."""
    cells = s.annotation().withColumn("group_raw", T.na_to_null(F.when(F.col("gene_id") % 7 == 3, "NA").otherwise(F.col("group_raw"))))
    return counts.genes_without_group(s.counts(), counts.first_group_wins(cells))


@query("SELECT genome_id, sample_id FROM genomes CROSS JOIN libraries")
def j2_genome_sample_pairs(s: Star) -> DataFrame:
    return counts.genome_sample_pairs(s.genomes(), s.libraries())


@query("""WITH got AS (SELECT * FROM counts WHERE NOT (genome_id % 5 = 0 AND sample_id LIKE '1%')),
  missing AS (SELECT genome_id, sample_id FROM genomes CROSS JOIN libraries EXCEPT SELECT genome_id, sample_id FROM got)
  SELECT genome_id, gene_id, sample_id, count FROM got UNION ALL
  SELECT m.genome_id, g.gene_id, m.sample_id, 0 FROM missing m JOIN (SELECT DISTINCT genome_id, gene_id FROM counts) g USING (genome_id)""")
def j3_zero_fill_missing_counts(s: Star) -> DataFrame:
    every = s.counts()
    got = every.filter(~((F.col("genome_id") % 5 == 0) & F.col("sample_id").startswith("1")))
    return counts.zero_fill_missing(got, counts.genome_sample_pairs(s.genomes(), s.libraries()), every.select("genome_id", "gene_id").distinct())


@query("SELECT genome_id, gene_id, CAST(sum(CASE WHEN sample_id = 'F' THEN count ELSE 0 END) AS BIGINT) AS \"F\", CAST(sum(CASE WHEN sample_id = 'O' THEN count ELSE 0 END) AS BIGINT) AS \"O\" FROM raw_counts GROUP BY 1, 2")
def j4_gene_count_table(s: Star) -> DataFrame:
    return counts.wide_counts(s.raw_counts(), ["F", "O"], ["genome_id", "gene_id"])


@query("SELECT genome_id, gene_id, sample_id, arg_min(count, ord) AS count, min(ord) AS ord FROM raw_counts GROUP BY 1, 2, 3")
def w1_first_gene_wins(s: Star) -> DataFrame:
    return counts.first_gene_wins(s.raw_counts())


@query("SELECT genome_id, gene_id, sample_id, count, ord FROM (SELECT *, row_number() OVER (PARTITION BY genome_id, gene_id, sample_id ORDER BY ord) AS k FROM raw_counts) WHERE k > 1")
def w1_repeated_genes(s: Star) -> DataFrame:
    return counts.repeated_genes(s.raw_counts()).select("genome_id", "gene_id", "sample_id", "count", "ord")


@query("SELECT genome_id, arg_min(group_id, ord) AS group_id, gene_id FROM (SELECT r.genome_id, p_brand AS group_id, p_partkey % 100 AS gene_id, r.ord FROM raw_counts r JOIN part ON r.gene_id = p_partkey) GROUP BY genome_id, gene_id")
def w2_first_group_wins(s: Star) -> DataFrame:
    rows = s.raw_counts().join(s.table("part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("group_raw")), "gene_id")
    return counts.first_group_wins(rows.select("genome_id", (F.col("gene_id") % 100).alias("gene_id"), "group_raw", "ord")).select("genome_id", "group_id", "gene_id")


@query(f"SELECT genome_id, group_id, sample_id, round(cpm, 6) AS cpm FROM ({_CPM})")
def n1_cpm(s: Star) -> DataFrame:
    return counts.cpm(s.group_counts(), s.libraries()).select("genome_id", "group_id", "sample_id", r6("cpm"))


# --- code matrix ----------------------------------------------------------------------------

_N = "SELECT count(*) FROM genomes"
_CODE_COUNTS = "SELECT group_id, count(*) FILTER (code = 1) AS n_1, count(*) FILTER (code = 0) AS n_0, count(*) FILTER (code = -1) AS n_m1, count(*) FILTER (code = -2) AS n_m2, count(*) FILTER (code = -3) AS n_m3, count(*) AS total FROM dense GROUP BY 1"


def _n(s: Star) -> int:
    return s.genomes().count()


@query(_CODE_COUNTS)
def a2_da_code_counts(s: Star) -> DataFrame:
    return da.da_code_counts(s.da(), _n(s))


_SUMMARY = """SELECT g.group_id, coalesce(n_genomes, 0) AS n_genomes, coalesce(da_count, 0) AS da_count, coalesce(da_up, 0) AS da_up, coalesce(da_dn, 0) AS da_dn, coalesce(pa_count, 0) AS pa_count
  FROM cluster_groups g LEFT JOIN (SELECT group_id, count(*) AS n_genomes, count(*) FILTER (abs(code) = 1) AS da_count, count(*) FILTER (code = 1) AS da_up, count(*) FILTER (code = -1) AS da_dn FROM da GROUP BY 1) USING (group_id)
  LEFT JOIN (SELECT group_id, count(DISTINCT genome_id) AS pa_count FROM cluster_map JOIN genomes USING (genome_id) WHERE label = 'PA' GROUP BY 1) USING (group_id)"""


@query(_SUMMARY)
def a3_cluster_summary(s: Star) -> DataFrame:
    return da.cluster_summary(s.da(), s.cluster_groups(), da.pa_cluster_count(s.cluster_map(), s.genomes()))


@query("SELECT genome_id, count(*) FILTER (code = -1) AS down, count(*) FILTER (code = 0) AS none, count(*) FILTER (code = 1) AS up FROM da WHERE code >= -1 GROUP BY 1")
def a5_direction_summary(s: Star) -> DataFrame:
    return da.direction_summary(s.da())


@query(f"SELECT group_id FROM ({_CODE_COUNTS}) WHERE n_1 * 100.0 / total >= 10 AND n_m1 * 100.0 / total <= 40")
def f5_da_percent_filter(s: Star) -> DataFrame:
    return da.da_percent_filter(s.da(), {1: (10, True), -1: (40, False)}, _n(s))


@query(f"SELECT group_id FROM da GROUP BY 1 HAVING count(*) FILTER (abs(code) = 1) > 0 AND count(*) FILTER (abs(code) = 1) * 100.0 / ({_N}) >= 30")
def f6_keep_da_clusters(s: Star) -> DataFrame:
    return da.keep_da_clusters(s.da(), _n(s), 30.0)


@query("SELECT genome_id, group_id, code FROM da WHERE code IN (-1, 1)")
def f7_code_select(s: Star) -> DataFrame:
    return da.code_select(s.da(), [-1, 1])


_NAMES = "SELECT DISTINCT p_brand || ' ECONOMY' AS group_id FROM part UNION SELECT 'unknown'"


def _names(s: Star) -> DataFrame:
    return s.table("part").select(F.concat("p_brand", F.lit(" ECONOMY")).alias("group_id")).distinct().union(s.spark.createDataFrame([("unknown",)], "group_id string"))


@query(f"SELECT genome_id, group_id, code FROM da WHERE group_id IN ({_NAMES})")
def f8_subset_groups(s: Star) -> DataFrame:
    return da.subset_groups(s.da(), _names(s))[0].select("genome_id", "group_id", "code")


@query(f"SELECT group_id FROM ({_NAMES}) WHERE group_id NOT IN (SELECT group_id FROM da)")
def f8_missing_groups(s: Star) -> DataFrame:
    return da.subset_groups(s.da(), _names(s))[1]


_NAMED = "SELECT genome_id, gene_id, CASE WHEN contains(group_raw, ',') THEN 'NA' ELSE c.group_id END AS group_id FROM cluster_map c JOIN annotation USING (gene_id)"


def _named(s: Star) -> DataFrame:
    """Clusters of genes, NA for genes with a list of groups."""
    rows = s.cluster_map().join(s.annotation(), "gene_id")
    return rows.withColumn("group_id", F.when(F.contains("group_raw", F.lit(",")), "NA").otherwise(F.col("group_id")))


@query(f"SELECT genome_id, group_id, gene_id FROM ({_NAMED}) WHERE group_id <> 'NA' AND group_id NOT LIKE '%ECONOMY'")
def f11_annotation_na_filter(s: Star) -> DataFrame:
    catalog = s.cluster_groups().filter(~F.col("group_id").endswith("ECONOMY"))
    return da.annotation_na_filter(_named(s), catalog).select("genome_id", "group_id", "gene_id")


@query(f"SELECT genome_id, group_id, gene_id FROM ({_NAMED}) WHERE group_id <> 'NA' AND group_id LIKE '%ECONOMY'")
def f11_groups_outside_catalog(s: Star) -> DataFrame:
    catalog = s.cluster_groups().filter(~F.col("group_id").endswith("ECONOMY"))
    return da.unknown_groups(_named(s).filter("group_id <> 'NA'"), catalog).select("genome_id", "group_id", "gene_id")


@query("SELECT DISTINCT genome_id, group_id FROM cluster_map WHERE group_id IN (SELECT group_id FROM cluster_groups WHERE group_id NOT LIKE 'Brand#1%')")
def j6_present_groups(s: Star) -> DataFrame:
    return da.present_groups(s.cluster_map(), s.cluster_groups().filter("group_id not like 'Brand#1%'"))


@query("SELECT genome_id, group_id, code FROM da")
def j7_da_code_assembly(s: Star) -> DataFrame:
    return s.da()


@query("SELECT genome_id, group_id, code FROM dense")
def j7_densify(s: Star) -> DataFrame:
    return da.densify(s.da(), s.genomes(), s.cluster_groups())


@query("SELECT genome_id, group_id, CASE WHEN code = -2 AND (genome_id, group_id) NOT IN (SELECT genome_id, group_id FROM counts JOIN clusters USING (gene_id) WHERE sample_id = '1-URGENT_O') THEN -3 ELSE code END AS code FROM da")
def j8_decouple_undetected(s: Star) -> DataFrame:
    """The annotation of a nation names the groups of its urgent open orders, all in one cell."""
    named = s.counts().filter("sample_id = '1-URGENT_O'").join(s.clusters(), "gene_id").groupBy("genome_id").agg(F.array_join(F.array_sort(F.collect_set("group_id")), ",").alias("group_raw"))
    return da.decouple_undetected(s.da(), named)


@query("SELECT group_id, count(DISTINCT genome_id) AS pa_count FROM cluster_map JOIN genomes USING (genome_id) WHERE label = 'PA' GROUP BY 1")
def j9_pa_cluster_count(s: Star) -> DataFrame:
    return da.pa_cluster_count(s.cluster_map(), s.genomes())


@query("SELECT genome_id, group_id, log_fc, fdr FROM tags WHERE group_id LIKE '%PROMO'")
def j15_tags_catalog_check(s: Star) -> DataFrame:
    return da.unknown_groups(s.tags(), s.cluster_groups().filter("group_id not like '%PROMO'")).select("genome_id", "group_id", "log_fc", "fdr")


@query(f"SELECT group_id FROM ({_CODE_COUNTS}) WHERE n_1 * 100.0 / total >= 10 INTERSECT SELECT group_id FROM ({_CODE_COUNTS}) WHERE n_0 * 100.0 / total >= 5")
def u2_conserved_groups(s: Star) -> DataFrame:
    n, m = _n(s), s.da()
    return da.conserved_groups([da.da_percent_filter(m, {1: (10, True)}, n), da.da_percent_filter(m, {0: (5, True)}, n)])


_SIG = "SELECT genome_id, category, CASE WHEN count(*) FILTER (code = {c}) >= 5 THEN 1 ELSE 0 END AS sig FROM da JOIN letters USING (group_id) GROUP BY 1, 2"


@query(f"WITH u AS ({_SIG.format(c=1)}), d AS ({_SIG.format(c=-1)}) SELECT genome_id, category, u.sig + 2 * d.sig AS code FROM u JOIN d USING (genome_id, category)")
def u5_combine_up_down(s: Star) -> DataFrame:
    rows = analysis.group_category_join(s.da(), s.categories())
    sig = lambda c: rows.groupBy("genome_id", "category").agg(F.when(F.count_if(F.col("code") == c) >= 5, 1).otherwise(0).alias("sig"))
    return da.combine_up_down(sig(1), sig(-1))


@query("SELECT group_id, code FROM da WHERE genome_id = 3")
def u9_get_genome(s: Star) -> DataFrame:
    return da.get_genome(s.da(), s.genomes(), 3)


@query("SELECT genome_id, code FROM da WHERE group_id = (SELECT min(group_id) FROM cluster_groups)")
def u10_get_group(s: Star) -> DataFrame:
    return da.get_group(s.da(), s.cluster_groups(), s.cluster_groups().agg(F.min("group_id")).first()[0])


_NEW = "SELECT genome_id + 20 AS genome_id, group_id, 0 AS code FROM da WHERE genome_id IN (1, 2, 8) AND code <> 0"


def _new(s: Star) -> DataFrame:
    return s.da().filter("genome_id in (1, 2, 8) and code <> 0").select((F.col("genome_id") + 20).alias("genome_id"), "group_id", F.lit(0).alias("code"))


@query(f"WITH fresh AS ({_NEW}) SELECT genome_id, group_id, code FROM da WHERE (genome_id, group_id) NOT IN (SELECT genome_id, group_id FROM fresh) UNION ALL SELECT * FROM fresh WHERE genome_id IN (SELECT genome_id FROM genomes)")
def u11_set_genome(s: Star) -> DataFrame:
    return da.set_genome(s.da(), _new(s), s.genomes(), s.cluster_groups())[0]


@query(f"WITH fresh AS ({_NEW}) SELECT * FROM fresh WHERE genome_id NOT IN (SELECT genome_id FROM genomes)")
def u11_refused_rows(s: Star) -> DataFrame:
    return da.set_genome(s.da(), _new(s), s.genomes(), s.cluster_groups())[1]


@query("SELECT genome_id, group_id, 'bad code' AS problem FROM da WHERE code = 1")
def v9_unset_or_bad_codes(s: Star) -> DataFrame:
    return da.bad_codes(s.da().withColumn("code", F.when(F.col("code") == 1, 4).otherwise(F.col("code"))))


@query("SELECT genome_id, count(*) AS n_unset FROM dense WHERE code IN (-1, -3) GROUP BY 1")
def v9_unset_cells_of_dense(s: Star) -> DataFrame:
    return da.unset_cells(s.da().filter("code <> -1"), s.genomes(), s.cluster_groups())


@query("SELECT genome_id, group_id, CASE WHEN NOT fdr < 0.7 THEN 0 WHEN log_fc > 0 THEN 1 ELSE -1 END AS code FROM tags")
def n7_da_code(s: Star) -> DataFrame:
    return s.tags().select("genome_id", "group_id", da.da_code(max_fdr=0.7).alias("code"))


# --- ids ------------------------------------------------------------------------------------


def _leaves(s: Star) -> DataFrame:
    return idspace.tree_leaf_order(s.tree())


def _ids(s: Star, where: str) -> DataFrame:
    return s.genomes().filter(where).select(F.col("genome_id").cast("string").alias("genome_id"))


@query("SELECT tree_id, leaf_id, ord FROM leaves")
def s14_tree_leaf_order(s: Star) -> DataFrame:
    return _leaves(s)


@query("SELECT tree_id, leaf_id, row_number() OVER (PARTITION BY tree_id ORDER BY ord) AS ord FROM leaves WHERE CAST(leaf_id AS INT) % 4 <> 0")
def j16_drop_leaves(s: Star) -> DataFrame:
    return idspace.drop_leaves(_leaves(s), _ids(s, "genome_id % 4 = 0").withColumnRenamed("genome_id", "leaf_id"))


@query("SELECT genome_id, name, ord FROM (SELECT CAST(genome_id AS VARCHAR) AS genome_id, name FROM genomes WHERE genome_id % 6 <> 0) JOIN leaves ON leaf_id = genome_id")
def j10_justify_ids(s: Star) -> DataFrame:
    meta = s.genomes().select(F.col("genome_id").cast("string").alias("genome_id"), "name")
    return idspace.justify_ids(_ids(s, "true"), _ids(s, "genome_id % 6 = 0"), _leaves(s), meta, meta)[0].select("genome_id", "name", "ord")


@query("""SELECT CAST(genome_id AS VARCHAR) AS genome_id, 'in tree only' AS problem FROM genomes WHERE genome_id % 6 = 0
  UNION ALL SELECT CAST(genome_id AS VARCHAR), 'no counts' FROM genomes WHERE genome_id % 6 <> 0 AND genome_id % 5 = 0""")
def j10_justify_problems(s: Star) -> DataFrame:
    meta = s.genomes().select(F.col("genome_id").cast("string").alias("genome_id"), "name")
    return idspace.justify_ids(_ids(s, "true"), _ids(s, "genome_id % 6 = 0"), _leaves(s), meta, _ids(s, "genome_id % 5 <> 0"))[1]


@query("SELECT tree_id, leaf_id AS genome_id, row_number() OVER (PARTITION BY tree_id ORDER BY ord) AS ord FROM leaves WHERE CAST(leaf_id AS INT) % 3 <> 0 AND CAST(leaf_id AS INT) % 5 <> 0")
def j11_justify_intersect(s: Star) -> DataFrame:
    return idspace.justify_intersect(_leaves(s), _ids(s, "genome_id % 3 <> 0"), _ids(s, "genome_id % 5 <> 0"))


@query("SELECT sample_id FROM samples WHERE fraction = 'BUILDING' EXCEPT SELECT sample_id FROM samples WHERE reads < 1000")
def u1_include_minus_exclude(s: Star) -> DataFrame:
    return idspace.include_minus_exclude(s.samples().filter("fraction = 'BUILDING'").select("sample_id"), s.samples().filter("reads < 1000").select("sample_id"), "sample_id")


@query("SELECT DISTINCT o_custkey AS sample_id FROM orders INTERSECT SELECT sample_id FROM samples WHERE reads > 2000 INTERSECT SELECT sample_id FROM samples WHERE fraction <> 'MACHINERY'")
def u3_id_intersection(s: Star) -> DataFrame:
    return idspace.id_intersection(s.table("orders").select(F.col("o_custkey").alias("sample_id")).distinct(), s.samples().filter("reads > 2000").select("sample_id"), s.samples().filter("fraction <> 'MACHINERY'").select("sample_id"))


@query("SELECT tree_id, leaf_id, row_number() OVER (PARTITION BY tree_id ORDER BY ord) AS ord FROM leaves WHERE CAST(leaf_id AS INT) > 9")
def w6_tree_rank(s: Star) -> DataFrame:
    return idspace.tree_rank(_leaves(s).filter(F.col("leaf_id").cast("int") > 9))


@query("SELECT DISTINCT o_custkey AS sample_id, 'not in metadata' AS problem FROM orders WHERE o_custkey NOT IN (SELECT sample_id FROM samples WHERE reads > 500)")
def v1_include_in_metadata(s: Star) -> DataFrame:
    return idspace.include_in_metadata(s.table("orders").select(F.col("o_custkey").alias("sample_id")), s.samples().filter("reads > 500"), "sample_id")


@query("SELECT DISTINCT o_custkey AS sample_id, 'excluded but not included' AS problem FROM orders WHERE o_custkey NOT IN (SELECT sample_id FROM samples WHERE fraction = 'BUILDING')")
def v2_exclude_in_include(s: Star) -> DataFrame:
    return idspace.exclude_in_include(s.table("orders").select(F.col("o_custkey").alias("sample_id")), s.samples().filter("fraction = 'BUILDING'"), "sample_id")


@query("SELECT leaf_id AS genome_id, 'in tree only' AS problem FROM leaves WHERE CAST(leaf_id AS INT) % 2 = 0 UNION ALL SELECT CAST(CAST(leaf_id AS INT) + 100 AS VARCHAR), 'in include only' FROM leaves WHERE CAST(leaf_id AS INT) % 2 = 0")
def v3_tree_vs_include(s: Star) -> DataFrame:
    wrong = s.genomes().select(F.when(F.col("genome_id") % 2 == 0, F.col("genome_id") + 100).otherwise(F.col("genome_id")).cast("string").alias("genome_id"))
    return idspace.tree_vs_include(_leaves(s), wrong)


@query("SELECT DISTINCT sample_id AS genome_id, 'no counts' AS problem FROM samples WHERE sample_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def v4_counts_present(s: Star) -> DataFrame:
    return idspace.counts_present(s.samples().select(F.col("sample_id").alias("genome_id")), s.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("genome_id")))


@query("SELECT DISTINCT l_partkey AS genome_id, 'no annotation' AS problem FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def v5_annotation_present(s: Star) -> DataFrame:
    ids = s.table("lineitem").select(F.col("l_partkey").alias("genome_id"))
    return idspace.annotation_present(ids, ids.filter("genome_id % 5 = 0"), s.table("part").filter("p_size < 40").select(F.col("p_partkey").alias("genome_id")))


@query("""SELECT DISTINCT o_custkey AS sample_id, 'not in metadata' AS problem FROM orders WHERE o_custkey NOT IN (SELECT sample_id FROM samples WHERE reads > 500)
  UNION ALL SELECT sample_id, 'excluded but not included' FROM samples WHERE sample_id NOT IN (SELECT o_custkey FROM orders)""")
def v7_sample_include_valid(s: Star) -> DataFrame:
    return idspace.sample_include_valid(s.table("orders").select(F.col("o_custkey").alias("sample_id")), s.samples(), s.samples().filter("reads > 500"))


@query("SELECT DISTINCT fraction AS level, 'not tested' AS problem FROM samples WHERE fraction NOT IN ('BUILDING', 'MOON') UNION ALL SELECT 'MOON', 'not in data'")
def v8_test_levels_match(s: Star) -> DataFrame:
    return idspace.test_levels_match(s.samples(), "fraction", ["BUILDING", "MOON"])


@query("SELECT genome_id, sample_id FROM genomes CROSS JOIN (SELECT DISTINCT l_partkey AS sample_id FROM lineitem) EXCEPT SELECT genome_id, gene_id FROM raw_counts")
def v12_pair_outputs_complete(s: Star) -> DataFrame:
    parts = s.table("lineitem").select(F.col("l_partkey").alias("sample_id")).distinct()
    return idspace.pair_outputs_complete(counts.genome_sample_pairs(s.genomes(), parts), s.raw_counts().select("genome_id", F.col("gene_id").alias("sample_id")), ["genome_id", "sample_id"])


@query("SELECT group_id, n, ord FROM (SELECT p_brand AS group_id, count(*) AS n FROM part GROUP BY 1) JOIN groups USING (group_id)")
def o1_order_by_catalog(s: Star) -> DataFrame:
    return idspace.in_order(s.table("part").groupBy(F.col("p_brand").alias("group_id")).agg(F.count("*").alias("n")), s.groups(), "group_id").select("group_id", "n", "ord")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS genome_id, n, ord FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) JOIN leaves ON leaf_id = CAST(s_nationkey AS VARCHAR)")
def o2_order_by_tree(s: Star) -> DataFrame:
    n = s.table("supplier").groupBy(F.col("s_nationkey").cast("string").alias("genome_id")).agg(F.count("*").alias("n"))
    return idspace.in_order(n, _leaves(s).withColumnRenamed("leaf_id", "genome_id"), "genome_id").select("genome_id", "n", "ord")


# --- annotation -----------------------------------------------------------------------------

_TAG_LIST = "[y for y in [trim(regexp_extract(x, '^\\s*([^=\\s]+)=', 1)) for x in string_split(f[9], ';')] if y <> '']"
_CDS = "SELECT genome_id, ord, f FROM gff_rows WHERE len(f) = 9 AND regexp_matches(f[3], 'CDS')"


def _cds(s: Star) -> DataFrame:
    return annotate.gff_fields(s.gff())[0]


@query(f"SELECT genome_id, ord, f[1] AS seqid, f[3] AS type, CAST(f[4] AS BIGINT) AS \"start\", f[7] AS strand FROM ({_CDS})")
def s8_read_gff(s: Star) -> DataFrame:
    return _cds(s).select("genome_id", "ord", "seqid", "type", "start", "strand")


@query("SELECT genome_id, ord, array_to_string(f, chr(9)) AS line FROM gff_rows WHERE len(f) <> 9")
def s8_malformed_lines(s: Star) -> DataFrame:
    return annotate.gff_fields(s.gff())[1].select("genome_id", "ord", "line")


@query("SELECT genome_id, ord, f[3] AS type FROM gff_rows WHERE len(f) = 9 AND regexp_matches(f[3], '(?i)exon')")
def f3_feature_type_filter(s: Star) -> DataFrame:
    return annotate.gff_fields(s.gff(), "EXON", ignore_case=True)[0].select("genome_id", "ord", "type")


@query("SELECT genome_id, ord, CASE WHEN regexp_matches(f[3], 'CRISPR|direct|tandem|inverted') THEN '#' || f[1] ELSE f[1] END AS seqid FROM gff_rows WHERE len(f) = 9")
def f10_mask_feature_rows(s: Star) -> DataFrame:
    return annotate.mask_feature_rows(annotate.gff_fields(s.gff(), None)[0]).select("genome_id", "ord", "seqid")


@query(f"SELECT DISTINCT genome_id, tag FROM (SELECT genome_id, unnest({_TAG_LIST}) AS tag FROM ({_CDS})) WHERE tag <> 'exonNumber'")
def a11_distinct_gff_tags(s: Star) -> DataFrame:
    return annotate.distinct_gff_tags(_cds(s))


@query(f"SELECT s_suppkey AS genome_id FROM supplier WHERE s_suppkey NOT IN (SELECT genome_id FROM ({_CDS}) WHERE f[9] LIKE 'ID=%')")
def a11_genomes_without_tag(s: Star) -> DataFrame:
    """Suppliers as genomes, of which the lines of parts know the first ones only."""
    return annotate.require_tag(annotate.distinct_gff_tags(_cds(s)), s.table("supplier").select(F.col("s_suppkey").alias("genome_id")), "ID")


@query(f"SELECT genome_id, 'g' || ord AS gene_id, coalesce(nullif(regexp_extract(f[9], 'product=([^;]*)', 1), ''), 'NA') AS product, coalesce(nullif(regexp_extract(f[9], 'note=last([^;]*)', 0), ''), regexp_extract(f[9], 'note=([^;]*)', 0))[6:] AS note, CASE WHEN f[9] LIKE '%exonNumber%' THEN '2' ELSE 'NA' END AS \"exonNumber\" FROM ({_CDS}) WHERE f[9] LIKE 'ID=%'")
def a12_tags_per_gene_wide(s: Star) -> DataFrame:
    return annotate.tags_per_gene(_cds(s), "ID", ["product", "note", "exonNumber"])


@query("""WITH v AS (SELECT p_partkey % 25 AS genome_id, p_partkey % 500 AS gene_id, CASE WHEN p_partkey % 3 = 0 THEN 'cog' WHEN p_partkey % 3 = 1 THEN 'kog' ELSE 'go' END AS ann_type, p_brand AS value, p_partkey AS ord FROM part),
  g AS (SELECT DISTINCT l_partkey % 25 AS genome_id, l_partkey % 500 AS gene_id FROM lineitem),
  w AS (SELECT genome_id, gene_id, arg_max(value, ord) FILTER (ann_type = 'cog') AS cog, arg_max(value, ord) FILTER (ann_type = 'kog') AS kog, arg_max(value, ord) FILTER (ann_type = 'go') AS go FROM v GROUP BY 1, 2)
  SELECT genome_id, gene_id, coalesce(cog, 'NA') AS cog, coalesce(kog, 'NA') AS kog, coalesce(go, 'NA') AS go FROM w FULL JOIN g USING (genome_id, gene_id)""")
def j5_annotation_outer_join(s: Star) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "cog").when(k % 3 == 1, "kog").otherwise("go")
    values = s.table("part").select((k % 25).alias("genome_id"), (k % 500).alias("gene_id"), kind.alias("ann_type"), F.col("p_brand").alias("value"), k.alias("ord"))
    genes = s.table("lineitem").select((F.col("l_partkey") % 25).alias("genome_id"), (F.col("l_partkey") % 500).alias("gene_id")).distinct()
    return annotate.annotation_outer_join(genes, values, ["cog", "kog", "go"])


_AUDIT = "SELECT genome_id, count(*) AS n_lines, count(*) FILTER (len(f) <> 9) AS n_bad_fields, count(*) FILTER (len(f) = 9 AND f[7] NOT IN ('+', '-', '.', '?')) AS n_bad_strand, count(*) FILTER (regexp_matches(coalesce(f[9], ''), '(^|;\\s*)name ')) AS n_space_tags, count(*) FILTER (regexp_matches(coalesce(f[3], ''), 'CRISPR|direct|tandem|inverted')) AS n_masked_types, count(*) FILTER (contains(array_to_string(f, ' '), '\"')) AS n_quotes, count(*) FILTER (regexp_matches(coalesce(f[9], ''), 'product=[^=]*;[^=]*$')) AS n_product_semicolons FROM gff_rows GROUP BY 1"
_FASTA = "SELECT genome_id, arg_min(line LIKE '>%', ord) AS starts_with_header, count(*) FILTER (line LIKE '>%') AS n_headers, count(*) FILTER (line LIKE '>% %') AS n_headers_with_space FROM fasta GROUP BY 1"


@query(_AUDIT)
def v13_gff_audit(s: Star) -> DataFrame:
    return annotate.gff_audit(s.gff())


@query(_FASTA)
def v14_fasta_audit(s: Star) -> DataFrame:
    return annotate.fasta_audit(s.fasta())


_FILES = "SELECT genome_id, 'genome.gff' AS extension, CAST(sum(length(line)) AS BIGINT) AS length FROM gff GROUP BY 1 UNION ALL SELECT genome_id, 'genome.fasta', CASE WHEN genome_id % 6 = 0 THEN 0 ELSE 10 END FROM fasta WHERE genome_id % 4 <> 0 GROUP BY 1"
_INVENTORY = f"SELECT g.genome_id, e.extension, CASE WHEN f.length IS NULL THEN 'missing' WHEN f.length = 0 THEN 'empty' ELSE 'ok' END AS status FROM genomes g CROSS JOIN (SELECT unnest(['genome.gff', 'genome.fasta']) AS extension) e LEFT JOIN ({_FILES}) f USING (genome_id, extension)"


def _inventory(s: Star) -> DataFrame:
    gff = s.gff().groupBy("genome_id").agg(F.lit("genome.gff").alias("extension"), F.sum(F.length("line")).alias("length"))
    fasta = s.fasta().filter("genome_id % 4 <> 0").groupBy("genome_id").agg(F.lit("genome.fasta").alias("extension"), F.max(F.when(F.col("genome_id") % 6 == 0, 0).otherwise(10)).cast("long").alias("length"))
    return annotate.file_inventory(gff.unionByName(fasta), s.genomes(), ["genome.gff", "genome.fasta"])


@query(_INVENTORY)
def s15_file_inventory(s: Star) -> DataFrame:
    return _inventory(s)


_FAULTS = " UNION ALL ".join(f"SELECT genome_id, '{c[2:]}' AS fault, {c} AS n FROM audit WHERE {c} > 0" for c in ("n_bad_fields", "n_bad_strand", "n_space_tags", "n_masked_types", "n_quotes", "n_product_semicolons"))


@query(f"""WITH audit AS ({_AUDIT}), heads AS ({_FASTA}), files AS ({_INVENTORY}), every AS (
  SELECT genome_id, status || ' ' || extension AS fault, 1 AS n FROM files WHERE status <> 'ok' UNION ALL {_FAULTS}
  UNION ALL SELECT genome_id, 'headers_with_space', n_headers_with_space FROM heads WHERE n_headers_with_space > 0
  UNION ALL SELECT genome_id, 'no_first_header', 1 FROM heads WHERE NOT starts_with_header)
  SELECT e.genome_id, fault, n, l.ord FROM every e JOIN leaves l ON CAST(l.leaf_id AS INT) = e.genome_id""")
def v15_db_audit(s: Star) -> DataFrame:
    order = _leaves(s).select(F.col("leaf_id").cast("int").alias("genome_id"), "ord")
    return annotate.db_audit(_inventory(s), annotate.gff_audit(s.gff()), annotate.fasta_audit(s.fasta()), order).select("genome_id", "fault", "n", "ord")


@query("SELECT genome_id, count(*) FILTER (before IS DISTINCT FROM genome_id) AS n_blocks FROM (SELECT p_size % 7 AS genome_id, lag(p_size % 7) OVER (ORDER BY p_partkey) AS before FROM part) GROUP BY 1 HAVING n_blocks > 1")
def w5_contiguous_blocks(s: Star) -> DataFrame:
    return annotate.contiguous_blocks(s.table("part").select((F.col("p_size") % 7).alias("genome_id"), F.col("p_partkey").alias("ord")))


_BODY = "regexp_replace(translate(array_to_string(f, chr(9)), '\"', ''''), '(product=[^=]*);([^=]*)$', '\\1,\\2')"
_SPACED = "CASE WHEN regexp_matches(g[9], '(^|;\\s*)name ') THEN regexp_replace(regexp_replace(g[9], ';\\s+', ';', 'g'), '(^|;)(\\w+) ', '\\1\\2=', 'g') ELSE g[9] END"


@query(f"""WITH fixed AS (SELECT genome_id, ord, string_split({_BODY}, chr(9)) AS g FROM gff_rows)
  SELECT genome_id, ord, CASE WHEN len(g) = 9 THEN CASE WHEN regexp_matches(g[3], 'CRISPR|direct|tandem|inverted') THEN '#' ELSE '' END || array_to_string(list_concat(g[1:6], [CASE g[7] WHEN '1' THEN '+' WHEN '-1' THEN '-' ELSE g[7] END, g[8], {_SPACED}]), chr(9)) ELSE array_to_string(g, chr(9)) END AS line FROM fixed
  UNION ALL SELECT genome_id, ord, line FROM gff WHERE regexp_matches(line, '^\\s*#')""")
def h11_clean_gff(s: Star) -> DataFrame:
    return annotate.clean_gff(s.gff())[0].select("genome_id", "ord", "line")


@query("SELECT genome_id, ord, CASE WHEN line LIKE '>%' THEN split_part(line, ' ', 1) ELSE line END AS line FROM fasta")
def h12_fasta_id(s: Star) -> DataFrame:
    return annotate.fix_fasta(s.fasta())


@query("SELECT gene_id, unnest([x for x in string_split(group_raw, ',') if x <> '']) AS group_id FROM annotation")
def h2_explode_list(s: Star) -> DataFrame:
    return s.annotation().select("gene_id", F.explode(T.list_items("group_raw")).alias("group_id"))


@query("SELECT gene_id, split_part(group_raw, ',', 1) AS group_id FROM annotation")
def h1_first_of_list(s: Star) -> DataFrame:
    return s.annotation().select("gene_id", T.first_of_list("group_raw").alias("group_id"))


_ATTRS = "SELECT genome_id, ord, i, trim(regexp_extract(x, '^\\s*([^=\\s]+)=', 1)) AS k, regexp_extract(x, '^\\s*[^=\\s]+=(.*)$', 1) AS v FROM (SELECT genome_id, ord, unnest(string_split(f[9], ';')) AS x, unnest(range(len(string_split(f[9], ';')))) AS i FROM ({0}))"


@query(f"WITH a AS ({_ATTRS.format(_CDS)}), l AS (SELECT genome_id, ord, k, arg_max(v, i) AS v FROM a WHERE k <> '' GROUP BY 1, 2, 3) SELECT genome_id, ord, k AS tag, v AS value FROM l")
def h3_parse_attributes(s: Star) -> DataFrame:
    return _cds(s).select("genome_id", "ord", F.explode(T.parse_attributes("attributes")).alias("tag", "value"))


@query(f"SELECT genome_id, ord, nullif(regexp_extract(f[9], '(^|;)\\s*ID=([^;]*)', 2), '') AS gene_id FROM ({_CDS})")
def h4_extract_tag(s: Star) -> DataFrame:
    return _cds(s).select("genome_id", "ord", T.extract_tag("attributes", "id").alias("gene_id"))


@query("SELECT group_id, category FROM letters WHERE category <> ''")
def h5_split_categories(s: Star) -> DataFrame:
    return s.categories().select("group_id", F.explode(T.split_categories("func")).alias("category"))


@query("SELECT p_partkey AS gene_id, regexp_extract(p_name || '  ', '(\\S*)\\s*$', 1) AS last, rtrim(p_name || '  ') AS trimmed, replace(p_name, ' ', '_') AS name, nullif(CASE WHEN p_size % 9 = 0 THEN 'NA' ELSE p_brand END, 'NA') AS brand, CASE p_size % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '0' END AS strand FROM part")
def h6_to_h15_strings(s: Star) -> DataFrame:
    p = s.table("part")
    padded = F.concat("p_name", F.lit("  "))
    code = F.when(F.col("p_size") % 3 == 1, "1").when(F.col("p_size") % 3 == 2, "-1").otherwise("0")
    return p.select(
        F.col("p_partkey").alias("gene_id"), T.last_token_trim(padded, strict=True).alias("last"), T.last_token_trim(padded).alias("trimmed"), T.underscore_names("p_name").alias("name"),
        T.na_to_null(F.when(F.col("p_size") % 9 == 0, "NA").otherwise(F.col("p_brand"))).alias("brand"), T.fix_strand(code).alias("strand"),
    )


@query("SELECT p_brand AS group_id, round(count(*) FILTER (p_size > 25) * 100.0 / count(*), 6) AS share FROM part GROUP BY 1")
def h16_percent_share(s: Star) -> DataFrame:
    return s.table("part").groupBy(F.col("p_brand").alias("group_id")).agg(F.count_if(F.col("p_size") > 25).alias("n"), F.count("*").alias("t")).select("group_id", F.round(T.percent_share("n", "t"), 6).alias("share"))


@query("SELECT a.n_nationkey AS genome_id FROM nation a JOIN nation b ON lower(a.n_name) = lower(lower(b.n_name))")
def h19_match_ci(s: Star) -> DataFrame:
    other = s.table("nation").select(F.lower("n_name").alias("other"))
    return s.table("nation").join(other, T.match_ci("n_name", "other")).select(F.col("n_nationkey").alias("genome_id"))


# --- reshaping and summaries ----------------------------------------------------------------


@query("SELECT p_brand AS grp_id, p_size AS size, name, value FROM (SELECT p_brand, p_size, unnest(['cheap', 'dear']) AS name, unnest([min(p_retailprice), max(p_retailprice)]) AS value FROM part GROUP BY p_brand, p_size)")
def u6_melt(s: Star) -> DataFrame:
    wide = s.table("part").groupBy(F.col("p_brand").alias("grp_id"), F.col("p_size").alias("size")).agg(F.min("p_retailprice").alias("cheap"), F.max("p_retailprice").alias("dear"))
    return analysis.melt(wide, ["grp_id", "size"], ["cheap", "dear"], "name", "value")


_PIVOT = ", ".join(f"max(code) FILTER (genome_id = {g}) AS \"{g}\"" for g in range(25))


@query(f"SELECT group_id, {_PIVOT} FROM da GROUP BY 1")
def u7_pivot_matrix(s: Star) -> DataFrame:
    return analysis.pivot_matrix(s.da(), "group_id", "genome_id", "code", list(range(25)))


#: All clusters, the columns of a transposed matrix.
_BRANDS = sorted(f"Brand#{b} {t}" for b in range(1, 26) for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))


@query("SELECT genome_id, " + ", ".join(f"max(code) FILTER (group_id = '{b}') AS \"{b}\"" for b in _BRANDS) + " FROM da GROUP BY 1")
def u8_transpose(s: Star) -> DataFrame:
    return analysis.pivot_matrix(s.da(), "genome_id", "group_id", "code", _BRANDS)


@query("SELECT d.genome_id, d.group_id, d.code, l.category FROM da d JOIN letters l USING (group_id) WHERE category <> ''")
def j12_group_category_join(s: Star) -> DataFrame:
    return analysis.group_category_join(s.da(), s.categories()).select("genome_id", "group_id", "code", "category")


_LETTERS = "SELECT DISTINCT category FROM letters WHERE category <> ''"


def _category_n(codes: str) -> str:
    return f"SELECT g.genome_id, c.category, count(d.code) AS n FROM genomes g CROSS JOIN ({_LETTERS}) c LEFT JOIN (SELECT genome_id, category, code FROM da JOIN letters USING (group_id) WHERE code IN ({codes})) d USING (genome_id, category) GROUP BY 1, 2"


def _category_names(s: Star) -> DataFrame:
    return s.categories().select(F.explode(T.split_categories("func")).alias("category")).distinct()


def _category_counts(s: Star, codes: list[int]) -> DataFrame:
    return analysis.category_counts(s.da(), s.categories(), codes, _category_names(s), s.genomes())


@query(_category_n("1"))
def a8_category_counts(s: Star) -> DataFrame:
    return _category_counts(s, [1])


_LNC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"
_TERM = f"exp({_LNC.format('m', 'j')} + {_LNC.format('n', 'k - j')} - {_LNC.format('m + n', 'k')})"


def _hyper(low: str, high: str) -> str:
    return f"""WITH t AS ({_category_n("-1, 0, 1")}), u AS ({_category_n("1")}),
      x AS (SELECT genome_id, category, t.n AS m, u.n AS x, CAST(sum(t.n) OVER w AS BIGINT) - t.n AS n, CAST(sum(u.n) OVER w AS BIGINT) AS k FROM t JOIN u USING (genome_id, category) WINDOW w AS (PARTITION BY genome_id)),
      e AS (SELECT genome_id, category, x, m, n, k, unnest(list_concat(generate_series(greatest({low}, greatest(0, k - n)), least({high}, least(k, m))), [-1])) AS j FROM x)
      SELECT genome_id, category, x, m, round(least(1, sum(CASE WHEN j >= 0 THEN {_TERM} ELSE 0 END)), 6) AS p FROM e GROUP BY 1, 2, 3, 4"""


def _enrichment(s: Star, tail: str) -> DataFrame:
    return analysis.hypergeo_enrichment(_category_counts(s, [1]), _category_counts(s, [-1, 0, 1]), tail)


@query(_hyper("0", "x"))
def n9_hypergeo_enrichment_lower(s: Star) -> DataFrame:
    return _enrichment(s, "lower").select("genome_id", "category", "x", "m", r6("p"))


@query(_hyper("x", "m"))
def n9_hypergeo_enrichment_upper(s: Star) -> DataFrame:
    return _enrichment(s, "upper").select("genome_id", "category", "x", "m", r6("p"))


@query(f"SELECT genome_id, category, CASE WHEN p <= 0.05 THEN 1 ELSE 0 END AS sig FROM ({_hyper('0', 'x')})")
def n10_significance_binary(s: Star) -> DataFrame:
    return analysis.significance_binary(_enrichment(s, "lower").withColumn("p", F.round("p", 6))).select("genome_id", "category", "sig")


_COPIED = "SELECT d.genome_id, d.group_id, d.code, coalesce(c.copies, 0) AS copies FROM da d LEFT JOIN copies c USING (genome_id, group_id)"


@query(_COPIED)
def j13_copy_number_join(s: Star) -> DataFrame:
    return analysis.copy_number_join(s.da(), s.copies()).select("genome_id", "group_id", "code", "copies")


@query(f"SELECT code, min(copies) AS low, quantile_cont(copies, 0.25) AS q1, quantile_cont(copies, 0.5) AS median, quantile_cont(copies, 0.75) AS q3, max(copies) AS high, count(*) AS n, round(avg(copies), 6) AS mean FROM ({_COPIED}) GROUP BY 1")
def a9_copy_number_by_code(s: Star) -> DataFrame:
    return analysis.copy_number_by_code(analysis.copy_number_join(s.da(), s.copies())).withColumn("mean", F.round("mean", 6))


@query("SELECT fraction AS level, count(*) AS n FROM samples GROUP BY 1")
def a10_category_level_counts(s: Star) -> DataFrame:
    return analysis.category_level_counts(s.samples(), "fraction")


@query("""WITH n AS (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS k, count(*) OVER (PARTITION BY p_type) AS levels FROM part GROUP BY 1, 2)
  SELECT p_partkey AS gene_id, p_type, CASE WHEN levels >= 6 AND k >= 6 THEN 'Other' ELSE p_brand END AS p_brand FROM part JOIN n USING (p_type, p_brand)""")
def w4_collapse_rare_levels(s: Star) -> DataFrame:
    return analysis.collapse_rare_levels(s.table("part").select(F.col("p_partkey").alias("gene_id"), "p_type", "p_brand"), "p_type", "p_brand", 6).select("gene_id", "p_type", "p_brand")


@query("SELECT group_id, substr(func, 1, 1) AS category, row_number() OVER (PARTITION BY substr(func, 1, 1) ORDER BY group_id) AS ord FROM categories")
def o5_order_within_category(s: Star) -> DataFrame:
    return analysis.order_within_category(s.categories())


@query("SELECT group_id, fdr AS pvalue, genome_id FROM tags ORDER BY fdr, group_id, genome_id LIMIT 25")
def o4_top_tags(s: Star) -> DataFrame:
    return analysis.top_tags(s.tags().select("group_id", F.col("fdr").alias("pvalue"), "genome_id"), 25)


@query("SELECT gene_id FROM (SELECT DISTINCT gene_id FROM features)")
def o3_sorted_feature_names(s: Star) -> DataFrame:
    return s.features().select("gene_id").distinct().orderBy("gene_id")


@query("SELECT genome_id, gene_id, sample_id, round(log10(count + 1), 6) AS log_count FROM counts")
def n12_log_counts(s: Star) -> DataFrame:
    return analysis.log_counts(s.counts()).select("genome_id", "gene_id", "sample_id", F.round("log_count", 6).alias("log_count"))


@query("SELECT genome_id, group_id, sample_id, round((count - avg(count) OVER w) / stddev_samp(count) OVER w, 6) + 0.0 AS z FROM group_counts WINDOW w AS (PARTITION BY genome_id)")
def n13_scale_columns(s: Star) -> DataFrame:
    return analysis.scale_columns(s.group_counts(), "genome_id", "count").select("genome_id", "group_id", "sample_id", r6("z"))


_VALUES = "SELECT genome_id, group_id, code AS value FROM dense"


def _distance(s: Star, metric: str) -> DataFrame:
    dense = da.densify(s.da(), s.genomes(), s.cluster_groups())
    return analysis.pairwise_distance(dense.withColumnRenamed("code", "value"), metric).withColumn("distance", F.round("distance", 6))


@query(f"WITH v AS ({_VALUES}) SELECT a.group_id AS g1, b.group_id AS g2, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS distance FROM v a JOIN v b ON a.genome_id = b.genome_id AND a.group_id < b.group_id GROUP BY 1, 2")
def n14_distance_euclidean(s: Star) -> DataFrame:
    return _distance(s, "euclidean")


@query(f"WITH v AS ({_VALUES}) SELECT a.group_id AS g1, b.group_id AS g2, round(avg(CASE WHEN a.value <> b.value THEN 1.0 ELSE 0.0 END), 6) AS distance FROM v a JOIN v b ON a.genome_id = b.genome_id AND a.group_id < b.group_id GROUP BY 1, 2")
def n14_distance_mismatch(s: Star) -> DataFrame:
    return _distance(s, "mismatch")


# --- statistics -----------------------------------------------------------------------------

_TMM = """rows_ AS (SELECT genome_id, group_id, sample_id, CAST(count AS DOUBLE) AS y, CAST(lib_size AS DOUBLE) AS n FROM group_counts JOIN libraries USING (sample_id)),
  quart AS (SELECT genome_id, sample_id, quantile_cont(y / n, 0.75) AS q FROM rows_ GROUP BY 1, 2),
  refs AS (SELECT genome_id, arg_min(sample_id, (round(abs(q - m), 15), sample_id)) AS ref FROM quart JOIN (SELECT genome_id, avg(q) AS m FROM quart GROUP BY 1) USING (genome_id) GROUP BY 1),
  pairs_ AS (SELECT a.genome_id, a.sample_id, round(log2((a.y / a.n) / (b.y / b.n)), 10) AS m, round((log2(a.y / a.n) + log2(b.y / b.n)) / 2, 10) AS a, (a.n - a.y) / a.n / a.y + (b.n - b.y) / b.n / b.y AS v
    FROM rows_ a JOIN refs r ON a.genome_id = r.genome_id JOIN rows_ b ON b.genome_id = a.genome_id AND b.group_id = a.group_id AND b.sample_id = r.ref WHERE a.y > 0 AND b.y > 0),
  ranked AS (SELECT *, count(*) OVER w AS k, rank() OVER (PARTITION BY genome_id, sample_id ORDER BY m) + (count(*) OVER (PARTITION BY genome_id, sample_id, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY genome_id, sample_id ORDER BY a) + (count(*) OVER (PARTITION BY genome_id, sample_id, a) - 1) / 2.0 AS ra FROM pairs_ WINDOW w AS (PARTITION BY genome_id, sample_id)),
  raw_ AS (SELECT genome_id, sample_id, sum(m / v) / sum(1 / v) AS f FROM ranked WHERE rm >= floor(k * 0.3) + 1 AND rm <= k - floor(k * 0.3) AND ra >= floor(k * 0.05) + 1 AND ra <= k - floor(k * 0.05) GROUP BY 1, 2),
  factors AS (SELECT genome_id, sample_id, pow(2, coalesce(f, 0) - avg(coalesce(f, 0)) OVER (PARTITION BY genome_id)) AS factor FROM quart LEFT JOIN raw_ USING (genome_id, sample_id))"""
_EQUAL = """eff AS (SELECT g.genome_id, g.group_id, g.sample_id, g.count, l.lib_size * {factor} AS e, c.is_other FROM group_counts g JOIN libraries l USING (sample_id) JOIN conditions c USING (sample_id) {join}),
  common_ AS (SELECT genome_id, exp(avg(ln(e))) AS common FROM (SELECT DISTINCT genome_id, sample_id, e FROM eff) GROUP BY 1),
  eq AS (SELECT eff.genome_id, eff.group_id, is_other, count * common / e AS y, eff.sample_id FROM eff JOIN common_ USING (genome_id)),
  z AS (SELECT genome_id, group_id, CAST(round(coalesce(sum(y) FILTER (NOT is_other), 0)) AS BIGINT) AS z1, CAST(round(coalesce(sum(y) FILTER (is_other), 0)) AS BIGINT) AS z2, count(*) FILTER (NOT is_other) AS n1, count(*) FILTER (is_other) AS n2, coalesce(avg(y) FILTER (NOT is_other), 0) AS m1, coalesce(avg(y) FILTER (is_other), 0) AS m2 FROM eq GROUP BY 1, 2)"""
_PLAIN = _EQUAL.format(factor="1.0", join="")
_NORMAL = _EQUAL.format(factor="f.factor", join="JOIN factors f USING (genome_id, sample_id)")


def _exact(phi: float | str, source: str = "z", rule: str = "doubletail") -> str:
    """CTES terms, test: the exact test of the rows of a table."""
    tail = {"smallp": "sum(CASE WHEN p <= o * (1 + 1e-7) THEN p ELSE 0 END)", "doubletail": "2 * least(sum(p) FILTER (a <= z1), sum(p) FILTER (a >= z1))"}[rule]
    one = f"lgamma(a + n1 / {phi}) - lgamma(a + 1) - lgamma(n1 / {phi}) + lgamma(z1 + z2 - a + n2 / {phi}) - lgamma(z1 + z2 - a + 1) - lgamma(n2 / {phi})" if phi else "- lgamma(a + 1) - lgamma(z1 + z2 - a + 1) + a * ln(n1) + (z1 + z2 - a) * ln(n2)"
    return f"""terms AS (SELECT genome_id, group_id, z1, z2, a, {one} AS f FROM (SELECT *, unnest(generate_series(0, z1 + z2)) AS a FROM {source})),
      peak AS (SELECT *, exp(f - max(f) OVER (PARTITION BY genome_id, group_id)) AS p FROM terms),
      test AS (SELECT genome_id, group_id, z1, z2, least(1, {tail} / sum(p)) AS pvalue FROM (SELECT *, max(CASE WHEN a = z1 THEN p END) OVER (PARTITION BY genome_id, group_id) AS o FROM peak) GROUP BY 1, 2, 3, 4)"""


_BH = "SELECT *, least(1, min(pvalue * n / k) OVER (PARTITION BY genome_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY pvalue) AS k, count(*) OVER (PARTITION BY genome_id) AS n FROM {0})"


def _equal(s: Star) -> DataFrame:
    s = s.held()
    return stats.equalised(s.group_counts(), s.libraries(), s.conditions())


@query(f"WITH {_TMM} SELECT genome_id, sample_id, round(factor, 6) AS factor FROM factors")
def n2_tmm_factors(s: Star) -> DataFrame:
    s = s.held()
    return stats.tmm_factors(s.group_counts(), s.libraries()).withColumn("factor", F.round("factor", 6))


_GRID = """grid_ AS (SELECT unnest(generate_series(1, 20)) / 21.0 AS delta),
  side AS (SELECT genome_id, group_id, is_other, (1 - delta) / delta AS r, delta, sum(lgamma(y + (1 - delta) / delta)) AS a, count(*) AS n, sum(y) AS t FROM eq CROSS JOIN grid_ GROUP BY 1, 2, 3, 4, 5),
  ll AS (SELECT genome_id, group_id, delta, sum(CASE WHEN n > 1 THEN a + lgamma(n * r) - lgamma(t + n * r) - n * lgamma(r) ELSE 0 END) AS ll FROM side GROUP BY 1, 2, 3)"""


def _refined(level: int, step: float) -> str:
    """CTES best<level>: the best delta of the one before, looked for again on a finer grid around it."""
    fine = step * 2 / 21
    before, at = f"best{level - 1}", f"({{0}} + (k - 10.5) * {fine!r})"
    return f"""near{level} AS (SELECT genome_id, k, greatest(1e-6, least(1 - 1e-6, {at.format('delta')})) AS delta FROM {before} CROSS JOIN (SELECT unnest(generate_series(1, 20)) AS k)),
      side{level} AS (SELECT genome_id, group_id, is_other, k, delta, (1 - delta) / delta AS r, sum(lgamma(y + (1 - delta) / delta)) AS a, count(*) AS n, sum(y) AS t FROM eq JOIN near{level} USING (genome_id) GROUP BY 1, 2, 3, 4, 5, 6),
      best{level} AS (SELECT genome_id, arg_max(delta, (ll, -delta)) AS delta FROM (SELECT genome_id, delta, round(sum(CASE WHEN n > 1 THEN a + lgamma(n * r) - lgamma(t + n * r) - n * lgamma(r) ELSE 0 END), 8) AS ll FROM side{level} GROUP BY 1, 2) GROUP BY 1)"""


_COMMON = f"""best1 AS (SELECT genome_id, arg_max(delta, (ll, -delta)) AS delta FROM (SELECT genome_id, delta, round(sum(ll), 8) AS ll FROM ll GROUP BY 1, 2) GROUP BY 1),
  {_refined(2, 1 / 21)}, {_refined(3, 1 / 21 * 2 / 21)}"""
_TAGWISE = """ab AS (SELECT genome_id, group_id, round(sum(y), 6) AS abundance, 10.0 / greatest(1, count(*) - 2) AS prior_n FROM eq GROUP BY 1, 2),
  score AS (SELECT genome_id, group_id, delta, round(ll + prior_n * avg(ll) OVER (PARTITION BY genome_id, delta ORDER BY abundance, group_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 8) AS score FROM ll JOIN ab USING (genome_id, group_id)),
  tagwise AS (SELECT genome_id, group_id, arg_max(delta, (score, -delta)) AS delta FROM score GROUP BY 1, 2)"""



def _lower(a: str, x: str) -> str:
    """Lower tail of the gamma distribution by its series; terms: a list of numbered places for them."""
    step = f"t.t * {x} / ({a} + k.k)"
    return f"exp({a} * ln({x}) - {x} - lgamma({a} + 1)) * list_reduce(terms, lambda t, k: {{'t': {step}, 's': t.s + {step}, 'k': k.k}}, {{'t': 1.0::DOUBLE, 's': 1.0::DOUBLE, 'k': 0.0::DOUBLE}}).s"


def _upper(a: str, x: str) -> str:
    """Upper tail by the continued fraction of Legendre, from its end; far: numbers in falling order."""
    return f"exp({a} * ln({x}) - {x} - lgamma({a})) / list_reduce(far, lambda f, k: {x} + 2 * k + 1 - {a} - (k + 1) * (k + 1 - {a}) / f, {x} + 2 * len(far) + 1 - {a})"


def _moved(tag: str, phi: str, source: str = "scaled_", terms: int = 400) -> str:
    """CTES moved<tag>: the rows of a source(genome_id, group_id, sample_id, is_other, y, e, common) with z, the quantile-adjusted count. Newton's method from the normal place."""
    share = "list_reduce([k::DOUBLE FOR k IN range(40)], lambda b, k: list_sum([ys[i] / (1 + phi * es[i] * b) FOR i IN range(1, len(ys) + 1)]) / list_sum([es[i] / (1 + phi * es[i] * b) FOR i IN range(1, len(ys) + 1)]), list_sum(ys) / list_sum(es))"
    slope = "exp(a2 * ln(x) - x - lgamma(a2))"
    return f"""rates{tag} AS (SELECT genome_id, group_id, is_other, phi, {share} AS b FROM (SELECT genome_id, group_id, is_other, {phi} AS phi, list(y ORDER BY sample_id) AS ys, list(e ORDER BY sample_id) AS es FROM {source} GROUP BY 1, 2, 3, 4)),
      means{tag} AS (SELECT genome_id, group_id, sample_id, is_other, y, e, common, rates{tag}.phi AS phi, e * b + CASE WHEN e * b < 1e-14 OR common * b < 1e-14 THEN 0.25 ELSE 0 END AS before, common * b + CASE WHEN e * b < 1e-14 OR common * b < 1e-14 THEN 0.25 ELSE 0 END AS after FROM {source} s JOIN rates{tag} USING (genome_id, group_id, is_other)),
      normal{tag} AS (SELECT *, 1 + phi * after AS r2, after / (1 + phi * after) AS a2, before / (1 + phi * before) AS a1, y / (1 + phi * before) AS x1, after + (y - before) * sqrt(after * (1 + phi * after) / (before * (1 + phi * before))) AS normal FROM means{tag}),
      places{tag} AS (SELECT *, [{{'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'k': k::DOUBLE}} FOR k IN range(1, {terms})] AS terms, [k::DOUBLE FOR k IN range({terms}, -1, -1)] AS far FROM normal{tag}),
      tails{tag} AS (SELECT *, CASE WHEN y >= before THEN ln({_upper('a1', 'x1')}) WHEN y > 0 THEN ln({_lower('a1', 'x1')}) END AS p FROM places{tag}),
      moved{tag} AS (SELECT genome_id, group_id, sample_id, is_other, e, y AS raw, greatest(0, CASE WHEN before = after THEN y WHEN y = 0 THEN normal / 2 ELSE (normal + r2 *
        CASE WHEN y >= before THEN list_reduce([k::DOUBLE FOR k IN range(12)], lambda x, k: x * exp(greatest(-1, least(1, (ln({_upper('a2', 'x')}) - p) * ({_upper('a2', 'x')}) / {slope}))), normal / r2)
        ELSE list_reduce([k::DOUBLE FOR k IN range(12)], lambda x, k: x * exp(greatest(-1, least(1, (p - ln({_lower('a2', 'x')})) * ({_lower('a2', 'x')}) / {slope}))), CASE WHEN normal > 0 THEN normal ELSE after / 2 END / r2) END) / 2 END) AS y FROM tails{tag})"""


_SCALED = """scaled_ AS (SELECT eff.genome_id, eff.group_id, sample_id, is_other, CAST(count AS DOUBLE) AS y, e, common FROM eff JOIN common_ USING (genome_id))"""
_BEFORE = _PLAIN.split("\n  z AS")[0].rstrip(",").split(",\n  eq AS")[0]
_SUMS = "SELECT genome_id, group_id, round(coalesce(sum(y) FILTER (NOT is_other), 0), 4) AS base_sum, round(coalesce(sum(y) FILTER (is_other), 0), 4) AS other_sum FROM {0} GROUP BY 1, 2"


def _arrays(s: Star) -> DataFrame:
    s = s.held()
    return stats.sample_arrays(s.group_counts(), s.libraries(), s.conditions())


@query(f"WITH {_BEFORE}, {_SCALED}, {_moved('', '0.05::DOUBLE')} {_SUMS.format('moved')}")
def n3_quantile_adjusted(s: Star) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), 4)
    return stats.quantile_adjusted(_arrays(s), 0.05).select("genome_id", "group_id", total("base").alias("base_sum"), total("other").alias("other_sum"))


@query(f"WITH {_PLAIN}, {_GRID}, {_COMMON} SELECT genome_id, round(delta / (1 - delta), 6) AS phi FROM best3")
def n3_common_dispersion(s: Star) -> DataFrame:
    return stats.common_dispersion(_equal(s)).withColumn("phi", F.round("phi", 6))


def _best(tag: str, table: str) -> str:
    """CTES best<tag>(genome_id, phi): the common dispersion of the counts of a table, at the top of the parabola through the last grid's best point."""
    step = 1 / 21 * 2 / 21 * 2 / 21
    at = lambda k: f"(SELECT ll FROM last_ n WHERE n.genome_id = l.genome_id AND n.k = l.k + {k})"
    text = f"""{_GRID}, {_COMMON}, last_ AS (SELECT genome_id, k, delta, sum(CASE WHEN n > 1 THEN a + lgamma(n * r) - lgamma(t + n * r) - n * lgamma(r) ELSE 0 END) AS ll FROM side3 GROUP BY 1, 2, 3),
      three AS (SELECT l.genome_id, l.k, l.delta, l.ll, {at(-1)} AS below, {at(1)} AS above FROM last_ l JOIN best3 b ON b.genome_id = l.genome_id AND b.delta = l.delta),
      top_ AS (SELECT genome_id, CASE WHEN below IS NULL OR above IS NULL OR below - 2 * ll + above >= 0 THEN delta ELSE delta + (below - above) / (2 * (below - 2 * ll + above)) * {step!r} END AS delta FROM three),
      best AS (SELECT genome_id, delta / (1 - delta) AS phi FROM top_)"""
    names = "grid_ side ll best1 near2 side2 best2 near3 side3 best3 last_ three top_ best"
    for name in names.split():
        text = re.sub(rf"(?<=FROM ){name}\b|(?<=JOIN ){name}\b|\b{name}(?= AS \()", name + tag, text)
    return re.sub(r"(?<=FROM )eq\b|(?<=JOIN )eq\b", table, text)


_ENOUGH = "enough_ AS (SELECT * FROM scaled_ QUALIFY sum(y) OVER (PARTITION BY genome_id, group_id) > 5)"
_TWICE = f"{_ENOUGH}, {_moved('1', '0.01::DOUBLE', 'enough_')}, {_best('_a', 'moved1')}, again_ AS (SELECT * FROM enough_ JOIN best_a USING (genome_id)), {_moved('2', 'phi', 'again_')}, {_best('_b', 'moved2')}"


@query(f"WITH {_BEFORE}, {_SCALED}, {_TWICE} SELECT genome_id, round(phi, 5) AS phi FROM best_b")
def n3_common_dispersion_quantile(s: Star) -> DataFrame:
    return stats.estimated_dispersions(_arrays(s))[0].withColumn("phi", F.round("phi", 5))


@query()
def n4_refined_dispersion(s: Star) -> DataFrame:
    return stats.estimated_dispersions(_arrays(s))[1]


@query(f"WITH {_PLAIN}, {_GRID}, {_TAGWISE} SELECT genome_id, group_id, round(delta / (1 - delta), 6) AS phi FROM tagwise")
def n4_tagwise_dispersion(s: Star) -> DataFrame:
    return stats.tagwise_dispersion(_equal(s)).withColumn("phi", F.round("phi", 6))


@query(f"WITH {_PLAIN}, {_exact(0.05)} SELECT genome_id, group_id, z1, z2, round(pvalue, 6) AS pvalue FROM test")
def n5_nb_exact_test(s: Star) -> DataFrame:
    return stats.nb_exact_test(_equal(s), 0.05).withColumn("pvalue", F.round("pvalue", 6))


@query(f"WITH {_PLAIN}, {_exact(0.05, rule='smallp')} SELECT genome_id, group_id, z1, z2, round(pvalue, 6) AS pvalue FROM test")
def n5_nb_exact_test_smallp(s: Star) -> DataFrame:
    return stats.nb_exact_test(_equal(s), 0.05, "smallp").withColumn("pvalue", F.round("pvalue", 6))


@query(f"WITH {_PLAIN}, {_exact(0)} SELECT genome_id, group_id, z1, z2, round(pvalue, 6) AS pvalue FROM test")
def n5_binomial_test(s: Star) -> DataFrame:
    return stats.nb_exact_test(_equal(s), 0.0).withColumn("pvalue", F.round("pvalue", 6))


@query(f"WITH {_PLAIN} SELECT genome_id, group_id, round(log2((m2 + 0.125) / (m1 + 0.125)), 6) + 0.0 AS log_fc FROM z")
def n6_log_fc(s: Star) -> DataFrame:
    return stats.log_fc(_equal(s)).select("genome_id", "group_id", r6("log_fc"))


@query(f"WITH t AS (SELECT genome_id, group_id, fdr AS pvalue FROM tags) SELECT genome_id, group_id, pvalue, round(fdr, 6) AS fdr FROM ({_BH.format('t')})")
def w3_bh_adjust(s: Star) -> DataFrame:
    return stats.bh_adjust(s.tags().select("genome_id", "group_id", F.col("fdr").alias("pvalue"))).withColumn("fdr", F.round("fdr", 6)).select("genome_id", "group_id", "pvalue", "fdr")


@query(f"""WITH {_TMM}, {_NORMAL}, enough AS (SELECT genome_id, group_id FROM eff WHERE count / e * 1e6 > 50 GROUP BY 1, 2 HAVING count(*) > 3), tested AS (SELECT z.* FROM z JOIN enough USING (genome_id, group_id)),
  {_exact(0.02, "tested")}, adj AS ({_BH.format("test")})
  SELECT g.genome_id, g.group_id, round(log2((m2 + 0.125) / (m1 + 0.125)), 5) + 0.0 AS log_fc, round(pvalue, 5) AS pvalue, CASE WHEN fdr IS NULL THEN -2 WHEN NOT fdr < 0.05 THEN 0 WHEN m2 > m1 THEN 1 ELSE -1 END AS code
  FROM (SELECT DISTINCT genome_id, group_id FROM group_counts) g LEFT JOIN tested USING (genome_id, group_id) LEFT JOIN adj USING (genome_id, group_id)""")
def n8_da_pipeline(s: Star) -> DataFrame:
    s = s.held()
    out = stats.da_pipeline(s.group_counts(), s.libraries(), s.conditions(), min_cpm=50.0, min_samples=3, dispersion=0.02, adjust="linear")
    return out.select("genome_id", "group_id", (F.round("log_fc", 5) + 0.0).alias("log_fc"), F.round("pvalue", 5).alias("pvalue"), "code")


@query(f"""WITH {_TMM}, {_NORMAL.replace("eq AS (", "eq_all AS (").replace("FROM eq GROUP", "FROM eq_all GROUP")}, enough AS (SELECT genome_id, group_id FROM eff WHERE count / e * 1e6 > 0.03 GROUP BY 1, 2 HAVING count(*) > 3), eq AS (SELECT eq_all.* FROM eq_all JOIN enough USING (genome_id, group_id)),
  {_GRID}, {_TAGWISE}, tested AS (SELECT z.*, delta / (1 - delta) AS phi FROM z JOIN tagwise USING (genome_id, group_id)), {_exact("phi", "tested")}, adj AS ({_BH.format("test")})
  SELECT g.genome_id, g.group_id, round(log2((m2 + 0.125) / (m1 + 0.125)), 5) + 0.0 AS log_fc, round(pvalue, 5) AS pvalue, CASE WHEN fdr IS NULL THEN -2 WHEN NOT fdr < 0.05 THEN 0 WHEN m2 > m1 THEN 1 ELSE -1 END AS code
  FROM (SELECT DISTINCT genome_id, group_id FROM group_counts) g LEFT JOIN tested USING (genome_id, group_id) LEFT JOIN adj USING (genome_id, group_id)""")
def n8_da_pipeline_estimated(s: Star) -> DataFrame:
    s = s.held()
    out = stats.da_pipeline(s.group_counts(), s.libraries(), s.conditions(), adjust="linear")
    return out.select("genome_id", "group_id", (F.round("log_fc", 5) + 0.0).alias("log_fc"), F.round("pvalue", 5).alias("pvalue"), "code")


_QUANTILE = f"""{_NORMAL.split(",\n  eq AS")[0]}, {_SCALED}, enough AS (SELECT genome_id, group_id FROM eff WHERE count / e * 1e6 > 50 GROUP BY 1, 2 HAVING count(*) > 3), chosen AS (SELECT scaled_.* FROM scaled_ JOIN enough USING (genome_id, group_id)),
  {_moved('', '0.02::DOUBLE', 'chosen')}, tested AS (SELECT genome_id, group_id, CAST(round(coalesce(sum(y) FILTER (NOT is_other), 0)) AS BIGINT) AS z1, CAST(round(coalesce(sum(y) FILTER (is_other), 0)) AS BIGINT) AS z2, count(*) FILTER (NOT is_other) AS n1, count(*) FILTER (is_other) AS n2, coalesce(avg(y) FILTER (NOT is_other), 0) AS m1, coalesce(avg(y) FILTER (is_other), 0) AS m2 FROM moved GROUP BY 1, 2)"""


@query(f"""WITH {_TMM}, {_QUANTILE}, {_exact(0.02, "tested")}, adj AS ({_BH.format("test")})
  SELECT g.genome_id, g.group_id, round(log2((m2 + 0.125) / (m1 + 0.125)), 5) + 0.0 AS log_fc, round(pvalue, 5) AS pvalue, CASE WHEN fdr IS NULL THEN -2 WHEN NOT fdr < 0.05 THEN 0 WHEN m2 > m1 THEN 1 ELSE -1 END AS code
  FROM (SELECT DISTINCT genome_id, group_id FROM group_counts) g LEFT JOIN tested USING (genome_id, group_id) LEFT JOIN adj USING (genome_id, group_id)""")
def n8_da_pipeline_quantile(s: Star) -> DataFrame:
    s = s.held()
    out = stats.da_pipeline(s.group_counts(), s.libraries(), s.conditions(), min_cpm=50.0, min_samples=3, dispersion=0.02)
    return out.select("genome_id", "group_id", (F.round("log_fc", 5) + 0.0).alias("log_fc"), F.round("pvalue", 5).alias("pvalue"), "code")


@query()
def n8_da_pipeline_default(s: Star) -> DataFrame:
    s = s.held()
    return stats.da_pipeline(s.group_counts(), s.libraries(), s.conditions())


#: Integral of cos(u)^(df - 1) from 0 to atan(|t| / sqrt(df)) by Simpson's rule.
_INSIDE = "list_sum([CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(abs(t) / sqrt(df)) * k / 2000), df - 1) FOR k IN range(2001)]) * atan(abs(t) / sqrt(df)) / 6000"


@query(f"""WITH c AS ({_COPIED}), s AS (SELECT genome_id, count(*) FILTER (code = 1) AS n1, count(*) FILTER (code = 0) AS n0, avg(copies) FILTER (code = 1) AS m1, avg(copies) FILTER (code = 0) AS m0, var_samp(copies) FILTER (code = 1) / count(*) FILTER (code = 1) AS e1, var_samp(copies) FILTER (code = 0) / count(*) FILTER (code = 0) AS e0 FROM c WHERE code IN (0, 1) GROUP BY 1)
  , v AS (SELECT genome_id, n1, n0, (m1 - m0) / sqrt(e1 + e0) AS t, (e1 + e0) * (e1 + e0) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)) AS df FROM s WHERE n1 > 1 AND n0 > 1)
  SELECT genome_id, n1, n0, round(t, 6) + 0.0 AS t, round(df, 6) AS df, round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * {_INSIDE}, 6) + 0.0 AS pvalue FROM v""")
def n11_welch_t_test(s: Star) -> DataFrame:
    rows = analysis.copy_number_join(s.da(), s.copies()).filter("code in (0, 1)")
    out = stats.welch_t_test(rows, "copies", F.col("code") == 1, ["genome_id"]).filter("n1 > 1 and n0 > 1")
    return out.select("genome_id", "n1", "n0", r6("t"), F.round("df", 6).alias("df"), r6("pvalue"))


# --- written layouts ------------------------------------------------------------------------


@query("SELECT genome_id, group_id AS \"groupId\", CAST(sum(CASE WHEN right(sample_id, 1) = 'F' THEN count ELSE 0 END) AS BIGINT) AS \"F\", CAST(sum(CASE WHEN right(sample_id, 1) = 'O' THEN count ELSE 0 END) AS BIGINT) AS \"O\" FROM group_counts GROUP BY 1, 2")
def k1_wide_group_counts(s: Star) -> DataFrame:
    rows = s.group_counts().withColumn("sample_id", F.right("sample_id", F.lit(1)))
    return writers.wide_group_counts(rows, s.groups(), ["F", "O"])


_WIDE = ", ".join(f"coalesce(max(code) FILTER (genome_id = {g}), -3) AS \"{g}\"" for g in range(25))


def _catalog(s: Star) -> DataFrame:
    return idspace.rank_rows(s.cluster_groups(), "group_id")


@query(f"SELECT group_id AS grp_id, {_WIDE} FROM cluster_groups LEFT JOIN da USING (group_id) GROUP BY 1")
def k4_wide_da_table(s: Star) -> DataFrame:
    return writers.wide_da_table(s.da(), _catalog(s), list(range(25)))


@query(f"WITH keep AS (SELECT group_id FROM ({_CODE_COUNTS}) WHERE n_1 * 100.0 / total >= 20) SELECT group_id AS grp_id, {_WIDE} FROM keep LEFT JOIN da USING (group_id) GROUP BY 1")
def k5_wide_filtered_da_table(s: Star) -> DataFrame:
    return writers.wide_filtered_da_table(s.da(), _catalog(s), da.da_percent_filter(s.da(), {1: (20, True)}, _n(s)), list(range(25)))


_KEPT = f"SELECT group_id FROM da GROUP BY 1 HAVING count(*) FILTER (abs(code) = 1) > 0 AND count(*) FILTER (abs(code) = 1) * 100.0 / ({_N}) >= 50"


@query(f"WITH kept AS ({_KEPT}) SELECT genome_id, " + ", ".join(f"max(code) FILTER (group_id = '{b}') AS \"{b}\"" for b in _BRANDS) + " FROM dense WHERE group_id IN (SELECT group_id FROM kept) GROUP BY 1")
def k8_wide_cluster_matrix(s: Star) -> DataFrame:
    kept = da.keep_da_clusters(s.da(), _n(s), 50.0)
    return writers.wide_cluster_matrix(da.densify(s.da().join(kept, "group_id", "left_semi"), s.genomes(), kept), _BRANDS)


@query(f"WITH u AS ({_SIG.format(c=1)}), d AS ({_SIG.format(c=-1)}), b AS (SELECT genome_id, category, u.sig + 2 * d.sig AS code FROM u JOIN d USING (genome_id, category)) SELECT category, " + ", ".join(f"max(code) FILTER (genome_id = {g}) AS \"{g}\"" for g in range(25)) + " FROM b GROUP BY 1")
def k9_wide_enrichment(s: Star) -> DataFrame:
    rows = analysis.group_category_join(s.da(), s.categories())
    sig = lambda c: rows.groupBy("genome_id", "category").agg(F.when(F.count_if(F.col("code") == c) >= 5, 1).otherwise(0).alias("sig"))
    return writers.wide_enrichment(da.combine_up_down(sig(1), sig(-1)), list(range(25)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts rolled up to groups."""
    return QUERIES["a1_aggregate_counts"](spark, sf_dir)
