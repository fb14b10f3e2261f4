"""The pipeline's tables cast in the driver's star schema: nations are genomes, parts are genes, brands are groups.

Every builder has a SQL twin in CTES under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.idspace import rank_rows


class Star:
    """Builders of the canonical tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._counts: DataFrame | None = None

    def held(self) -> Star:
        """The same builders over counts() that are joined once and stored, for queries that read them several times."""
        from ..sources.shared import stored

        self._counts = stored(self.counts())
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def counts(self) -> DataFrame:
        """Gene counts: quantities by nation, part and sample."""
        if self._counts is not None:
            return self._counts
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
        rows = lines.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        sample = F.concat("o_orderpriority", F.lit("_"), "l_linestatus")
        return rows.groupBy(F.col("s_nationkey").alias("genome_id"), F.col("l_partkey").alias("gene_id"), sample.alias("sample_id")).agg(F.sum("l_quantity").cast("long").alias("count"))

    def raw_counts(self) -> DataFrame:
        """One row per line item, so genes repeat; ord is the line's place."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
        rows = lines.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select(F.col("s_nationkey").alias("genome_id"), F.col("l_partkey").alias("gene_id"), F.col("l_linestatus").alias("sample_id"), F.col("l_quantity").cast("long").alias("count"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("long").alias("ord"))

    def annotation(self) -> DataFrame:
        """gene_id, group_raw (a list for every fifth size)."""
        raw = F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", F.lit(","), "p_type")).otherwise(F.col("p_brand"))
        return self.table("part").select(F.col("p_partkey").alias("gene_id"), raw.alias("group_raw"))

    def groups(self) -> DataFrame:
        """Brands in order, and one group that no gene has."""
        ids = self.table("part").select(F.col("p_brand").alias("group_id")).distinct().union(self.spark.createDataFrame([("Brand#none",)], "group_id string"))
        return rank_rows(ids, "group_id")

    def group_counts(self) -> DataFrame:
        """Counts by nation, brand and sample; brands ending in 1 get three times as much where lines are open, so that they differ."""
        part = self.table("part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("group_id"))
        up = F.when(F.col("group_id").endswith("1") & F.col("sample_id").endswith("_O"), F.col("count") * 3).otherwise(F.col("count"))
        return self.counts().join(part, "gene_id").groupBy("genome_id", "group_id", "sample_id").agg(F.sum(up).cast("long").alias("count"))

    def libraries(self) -> DataFrame:
        return self.counts().groupBy("sample_id").agg(F.sum("count").cast("long").alias("lib_size"))

    def conditions(self) -> DataFrame:
        return self.libraries().select("sample_id", F.col("sample_id").endswith("_O").alias("is_other"))

    def clusters(self) -> DataFrame:
        """Brand and type together as group of a part."""
        return self.table("part").select(F.col("p_partkey").alias("gene_id"), F.concat("p_brand", F.lit(" "), "p_type").alias("group_id"))

    def cluster_groups(self) -> DataFrame:
        return self.clusters().select("group_id").distinct()

    def genomes(self) -> DataFrame:
        """Nations with their region as label: PA for regions 1 and 3, else NPA."""
        return self.table("nation").select(F.col("n_nationkey").alias("genome_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.when(F.col("n_regionkey").isin(1, 3), "PA").otherwise("NPA").alias("label"))

    def cluster_map(self) -> DataFrame:
        return self.counts().select("genome_id", "gene_id").distinct().join(self.clusters(), "gene_id").select("genome_id", "group_id", "gene_id")

    def tags(self) -> DataFrame:
        """A stand-in for tests: log ratio and a score of the open and filled quantities of a cluster, for those with 100 or more."""
        rows = self.counts().join(self.clusters(), "gene_id").groupBy("genome_id", "group_id").agg(F.sum(F.when(F.col("sample_id").endswith("_O"), F.col("count")).otherwise(0)).alias("o"), F.sum(F.when(F.col("sample_id").endswith("_F"), F.col("count")).otherwise(0)).alias("f"))
        o, f = F.col("o"), F.col("f")
        return rows.filter("o + f >= 100").select("genome_id", "group_id", F.round((o - f) / (o + f), 6).alias("log_fc"), F.round(1 - F.abs(o - f) / (o + f), 6).alias("fdr"))

    def da(self) -> DataFrame:
        """Sparse codes of the clusters."""
        from ..operators import da

        return da.da_code_assembly(da.present_groups(self.cluster_map(), self.cluster_groups()), self.tags(), self.cluster_groups(), 0.8)

    def categories(self) -> DataFrame:
        """Letters of a cluster: the first of its type, and the second where its brand ends in 3."""
        t = F.element_at(F.split("group_id", " "), 2)
        return self.cluster_groups().select("group_id", F.concat(F.substr(t, F.lit(1), F.lit(1)), F.when(F.substring_index("group_id", " ", 1).endswith("3"), F.substr(t, F.lit(2), F.lit(1))).otherwise("")).alias("func"))

    def tree(self) -> DataFrame:
        """A Newick tree of all nations, by region and key."""
        leaves = self.table("nation").orderBy("n_regionkey", "n_nationkey").agg(F.array_sort(F.collect_list(F.struct("n_regionkey", "n_nationkey"))).alias("l"))
        text = F.array_join(F.transform("l", lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(":1.0"))), ",")
        return leaves.select(F.lit("t1").alias("tree_id"), F.concat(F.lit("("), text, F.lit(");")).alias("newick"))

    def alignments(self) -> DataFrame:
        """Events as reads: type is the contig, seconds of time the position."""
        e = self.table("events")
        start = F.unix_timestamp(F.date_trunc("second", "ts")).cast("long")
        return e.select("event_id", F.col("event_type").alias("contig"), start.alias("start"), (start + F.ceil(F.abs("value")).cast("long")).alias("end"), (F.col("user_id") % 6).alias("sample_id"), F.pmod(F.col("value"), F.lit(100.0)).alias("identity"))

    def features(self) -> DataFrame:
        """Windows of 22,000 s every six hours of each contig's time, every third left out."""
        span = self.alignments().groupBy("contig").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
        at = span.select("contig", F.explode(F.expr("sequence(lo div 21600, hi div 21600)")).alias("k")).filter("k % 3 <> 0")
        return at.select("contig", (F.col("k") * 21600).alias("start"), (F.col("k") * 21600 + 22000).alias("end"), F.concat("contig", F.lit("_"), F.col("k").cast("string")).alias("gene_id"))

    def gff(self) -> DataFrame:
        """GFF lines made of parts; some have faults."""
        p = self.table("part")
        k = F.col("p_partkey")
        attrs = F.concat(F.lit("ID=g"), k.cast("string"), F.lit(";product="), "p_type", F.when(k % 7 == 0, "; more").otherwise(""), F.lit(";note="), F.when(k % 11 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise(F.col("p_brand")), F.when(k % 13 == 0, ";exonNumber=2").otherwise(""), F.when(k % 17 == 0, F.concat(F.lit(";note=last"), F.col("p_size").cast("string"))).otherwise(""))
        attrs = F.when(k % 19 == 0, F.concat(F.lit("name g"), k.cast("string"), F.lit("; transcriptId "), F.col("p_size").cast("string"))).otherwise(attrs)
        kind = F.when(k % 23 == 0, "CRISPR").when(k % 3 == 0, "exon").otherwise("CDS")
        strand = F.when(k % 29 == 0, "1").when(k % 31 == 0, "-1").when(k % 2 == 0, "+").otherwise("-")
        row = F.concat_ws("\t", F.concat(F.lit("c"), (k % 10).cast("string")), F.lit("src"), kind, k.cast("string"), (k + F.col("p_size")).cast("string"), F.lit("."), strand, F.lit("0"), attrs)
        line = F.when(k % 37 == 0, F.concat(F.lit("# part "), k.cast("string"))).when(k % 41 == 0, F.concat(F.lit("short line "), k.cast("string"))).otherwise(row)
        return p.select((k % 25).alias("genome_id"), k.alias("ord"), line.alias("line"))

    def fasta(self) -> DataFrame:
        p, k = self.table("part"), F.col("p_partkey")
        head = F.concat(F.lit(">s"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""))
        return p.select((k % 25).alias("genome_id"), k.alias("ord"), F.when(k % 2 == 0, head).otherwise("ACGT").alias("line"))

    def samples(self) -> DataFrame:
        """Customers as samples: market by nation, balance as reads."""
        return self.table("customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("genome_id"), F.col("c_mktsegment").alias("fraction"), F.floor(F.abs("c_acctbal")).cast("long").alias("reads"))

    def copies(self) -> DataFrame:
        """Copy numbers: parts of a cluster in a nation."""
        return self.cluster_map().groupBy("genome_id", "group_id").agg(F.count("*").alias("copies"))


#: SQL twins, each after those it needs.
CTES: dict[str, str] = {
    "counts": "SELECT s_nationkey AS genome_id, l_partkey AS gene_id, o_orderpriority || '_' || l_linestatus AS sample_id, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3",
    "raw_counts": "SELECT s_nationkey AS genome_id, l_partkey AS gene_id, l_linestatus AS sample_id, CAST(l_quantity AS BIGINT) AS count, CAST(l_orderkey * 10000 + l_linenumber * 100 + l_quantity AS BIGINT) AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "annotation": "SELECT p_partkey AS gene_id, CASE WHEN p_size % 5 = 0 THEN p_brand || ',' || p_type ELSE p_brand END AS group_raw FROM part",
    "groups": "SELECT group_id, row_number() OVER (ORDER BY group_id) AS ord FROM (SELECT DISTINCT p_brand AS group_id FROM part UNION ALL SELECT 'Brand#none')",
    "group_counts": "SELECT genome_id, p_brand AS group_id, sample_id, CAST(sum(CASE WHEN p_brand LIKE '%1' AND sample_id LIKE '%\\_O' ESCAPE '\\' THEN count * 3 ELSE count END) AS BIGINT) AS count FROM counts JOIN part ON gene_id = p_partkey GROUP BY 1, 2, 3",
    "libraries": "SELECT sample_id, CAST(sum(count) AS BIGINT) AS lib_size FROM counts GROUP BY 1",
    "conditions": "SELECT sample_id, right(sample_id, 2) = '_O' AS is_other FROM libraries",
    "clusters": "SELECT p_partkey AS gene_id, p_brand || ' ' || p_type AS group_id FROM part",
    "cluster_groups": "SELECT DISTINCT group_id FROM clusters",
    "genomes": "SELECT n_nationkey AS genome_id, n_name AS name, n_regionkey AS region, CASE WHEN n_regionkey IN (1, 3) THEN 'PA' ELSE 'NPA' END AS label FROM nation",
    "cluster_map": "SELECT genome_id, group_id, gene_id FROM (SELECT DISTINCT genome_id, gene_id FROM counts) JOIN clusters USING (gene_id)",
    "tags": "SELECT genome_id, group_id, round((o - f) / (o + f), 6) AS log_fc, round(1 - abs(o - f) / (o + f), 6) AS fdr FROM (SELECT genome_id, group_id, CAST(sum(CASE WHEN right(sample_id, 2) = '_O' THEN count ELSE 0 END) AS DOUBLE) AS o, CAST(sum(CASE WHEN right(sample_id, 2) = '_F' THEN count ELSE 0 END) AS DOUBLE) AS f FROM counts JOIN clusters USING (gene_id) GROUP BY 1, 2) WHERE o + f >= 100",
    "da": "SELECT p.genome_id, p.group_id, CASE WHEN t.fdr IS NULL THEN -2 WHEN NOT t.fdr < 0.8 THEN 0 WHEN t.log_fc > 0 THEN 1 ELSE -1 END AS code FROM (SELECT DISTINCT genome_id, group_id FROM cluster_map) p LEFT JOIN tags t USING (genome_id, group_id)",
    "dense": "SELECT g.genome_id, c.group_id, coalesce(d.code, -3) AS code FROM genomes g CROSS JOIN cluster_groups c LEFT JOIN da d USING (genome_id, group_id)",
    "categories": "SELECT group_id, substr(split_part(group_id, ' ', 2), 1, 1) || CASE WHEN split_part(group_id, ' ', 1) LIKE '%3' THEN substr(split_part(group_id, ' ', 2), 2, 1) ELSE '' END AS func FROM cluster_groups",
    "letters": "SELECT group_id, unnest(string_split(func, '')) AS category FROM categories",
    "leaves": "SELECT 't1' AS tree_id, CAST(n_nationkey AS VARCHAR) AS leaf_id, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS ord FROM nation",
    "alignments": "SELECT event_id, event_type AS contig, CAST(floor(epoch(ts)) AS BIGINT) AS \"start\", CAST(floor(epoch(ts)) AS BIGINT) + CAST(ceil(abs(value)) AS BIGINT) AS \"end\", user_id % 6 AS sample_id, fmod(value, 100.0) AS identity FROM events",
    "features": "SELECT contig, k * 21600 AS \"start\", k * 21600 + 22000 AS \"end\", contig || '_' || CAST(k AS VARCHAR) AS gene_id FROM (SELECT contig, unnest(generate_series(min(\"start\") // 21600, max(\"end\") // 21600)) AS k FROM alignments GROUP BY contig) WHERE k % 3 <> 0",
    "assigned": "SELECT a.event_id, a.sample_id, a.identity, CASE WHEN count(DISTINCT f.gene_id) = 0 THEN '__no_feature' WHEN count(DISTINCT f.gene_id) > 1 THEN '__ambiguous' ELSE min(f.gene_id) END AS gene_id FROM alignments a LEFT JOIN features f ON a.contig = f.contig AND a.\"start\" <= f.\"end\" AND f.\"start\" <= a.\"end\" GROUP BY 1, 2, 3",
    "gff": "SELECT p_partkey % 25 AS genome_id, p_partkey AS ord, CASE WHEN p_partkey % 37 = 0 THEN '# part ' || p_partkey WHEN p_partkey % 41 = 0 THEN 'short line ' || p_partkey ELSE 'c' || (p_partkey % 10) || chr(9) || 'src' || chr(9) || CASE WHEN p_partkey % 23 = 0 THEN 'CRISPR' WHEN p_partkey % 3 = 0 THEN 'exon' ELSE 'CDS' END || chr(9) || p_partkey || chr(9) || (p_partkey + p_size) || chr(9) || '.' || chr(9) || CASE WHEN p_partkey % 29 = 0 THEN '1' WHEN p_partkey % 31 = 0 THEN '-1' WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END || chr(9) || '0' || chr(9) || CASE WHEN p_partkey % 19 = 0 THEN 'name g' || p_partkey || '; transcriptId ' || p_size ELSE 'ID=g' || p_partkey || ';product=' || p_type || CASE WHEN p_partkey % 7 = 0 THEN '; more' ELSE '' END || ';note=' || CASE WHEN p_partkey % 11 = 0 THEN '\"' || p_brand || '\"' ELSE p_brand END || CASE WHEN p_partkey % 13 = 0 THEN ';exonNumber=2' ELSE '' END || CASE WHEN p_partkey % 17 = 0 THEN ';note=last' || p_size ELSE '' END END END AS line FROM part",
    "gff_rows": "SELECT genome_id, ord, string_split(line, chr(9)) AS f FROM gff WHERE NOT regexp_matches(line, '^\\s*#')",
    "fasta": "SELECT p_partkey % 25 AS genome_id, p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN '>s' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END ELSE 'ACGT' END AS line FROM part",
    "samples": "SELECT c_custkey AS sample_id, c_nationkey AS genome_id, c_mktsegment AS fraction, CAST(floor(abs(c_acctbal)) AS BIGINT) AS reads FROM customer",
    "copies": "SELECT genome_id, group_id, count(*) AS copies FROM cluster_map GROUP BY 1, 2",
}
