"""Files of several kinds: headers by file, wide tables by place, ranks, upserts, nested bins and counts at many thresholds."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from florabund.functions import distributions as d
from florabund.operators import counts, idspace
from florabund.sources import readers, writers


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_each_file_of_a_genome_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "g1"
    folder.mkdir()
    (folder / "a.txt").write_text("name\tA\tB\nx\t1\t2\n__no_feature\t9\t9\ny\t3\t4\n")
    (folder / "b.txt").write_text("name\tB\tA\nx\t20\t10\nz\t40\t30\n")
    got = rows_of(readers.read_gene_counts(spark, str(tmp_path / "*" / "*.txt")), "gene_id", "sample_id", "count")
    # a.txt stops at its first special row, b.txt has none
    assert got == [("x", "A", 1), ("x", "A", 10), ("x", "B", 2), ("x", "B", 20), ("z", "A", 30), ("z", "B", 40)]
    (folder / "c.tsv").write_text("proteinId\tkog\n1\tK1\n")
    (folder / "d.tsv").write_text("KOG\tother\tProteinID\nK2\t-\t2\n")
    assert rows_of(readers.read_annotation(spark, str(tmp_path / "*" / "*.tsv"), "proteinid", "kog"), "gene_id", "group_raw") == [("1", "K1"), ("2", "K2")]
    (folder / "e.tags").write_text("logFC a b FDR\nk1 1 0 0 0.5\n")
    (folder / "f.tags").write_text("logFC a b FDR\nk2 2 0 0 0.25\n")
    assert rows_of(readers.read_tags(spark, str(tmp_path / "*" / "*.tags")), "group_id", "log_fc", "fdr") == [("k1", 1.0, 0.5), ("k2", 2.0, 0.25)]


def test_annotation_pair_files(spark, tmp_path):
    for genome, kind, text in [
        ("g1", "kog", "proteinid<T>kogID\n1\tK1\tmore\tcells\n2\tK2\n2\tK3\n\n".replace("<T>", "\t")),
        ("g1", "ko", "7\tA\nPROTEINID\tx\n8\tB\r\n9\n"),  # a header is not always first
        ("g1", "gff_annote", "any\tfirst\tline\n5\tv\n"),
        ("g2", "kog", ""),
    ]:
        (tmp_path / genome).mkdir(exist_ok=True)
        (tmp_path / genome / f"{genome}.{kind}.tab.txt").write_text(text)
    got = rows_of(readers.read_annotation_pairs(spark, str(tmp_path)).fillna(""), "genome_id", "ann_type", "gene_id", "value")
    assert got == [("g1", "gff_annote", "5", "v"), ("g1", "ko", "7", "A"), ("g1", "ko", "8", "B"), ("g1", "ko", "9", ""), ("g1", "kog", "1", "K1\tmore\tcells"), ("g1", "kog", "2", "K2"), ("g1", "kog", "2", "K3")]
    later = readers.read_annotation_pairs(spark, str(tmp_path)).filter("ann_type = 'kog'").groupBy("gene_id").agg(F.max_by("value", "ord").alias("value"))
    assert rows_of(later, "gene_id", "value") == [("1", "K1\tmore\tcells"), ("2", "K3")]
    genomes = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "genome_id string")
    assert rows_of(readers.missing_annotation_files(spark, str(tmp_path), genomes, ["kog", "ko"]), "genome_id", "ann_type") == [("g2", "ko"), ("g2", "kog"), ("g3", "ko"), ("g3", "kog")]
    plan = readers.read_annotation_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "wholetext" not in plan.lower()


def test_files_are_read_in_splits(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.kog.tab.txt").write_text("proteinId\tx\n" + "".join(f"{k}\tv{k}\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_annotation_pairs(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert [r.gene_id for r in df.orderBy("ord").collect()] == [str(k) for k in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_inventory_of_real_files(spark, tmp_path):
    for folder, name, text in [("genome_id=1", "x.gff", "abc\n"), ("2", "y.gff", ""), ("2", "y.faa", ">a\n")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    assert rows_of(readers.read_files(spark, str(tmp_path)), "genome_id", "extension", "length") == [("1", ".gff", 4), ("2", ".faa", 3), ("2", ".gff", 0)]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_rank_rows(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("k"), F.lit("x").alias("v"))
        got = idspace.rank_rows(df, "k", name="place")
        assert [(r.k, r.place) for r in got.orderBy("place").collect()] == [(k, i) for i, k in enumerate(sorted(x * 7919 % 100_003 for x in range(n)), 1)]
        assert got.columns == ["k", "v", "place"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan or "__part" in plan  # no window over rows, only over parts
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_wide_tables_have_any_number_of_columns(spark, tmp_path):
    rng = random.Random(3)
    genomes, groups = [f"g{k}" for k in range(5000)], [f"k{k}" for k in range(12)]
    held = {(rng.choice(genomes), rng.choice(groups)): rng.choice([-2, -1, 0, 1]) for _ in range(2000)}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in held.items()], "genome_id string, group_id string, code int")
    order = spark.createDataFrame([(g, 5000 - k) for k, g in enumerate(genomes)], "genome_id string, ord long")
    catalog = spark.createDataFrame([(g, k) for k, g in enumerate(groups)] + [("empty", 99)], "group_id string, ord long")
    writers.write_da_table(df, catalog, order, str(tmp_path / "t"))
    lines = [ln for f in sorted(os.listdir(tmp_path / "t")) if f.startswith("part") for ln in (tmp_path / "t" / f).read_text().splitlines()]
    assert lines[0].split("\t") == ["grp_id", *reversed(genomes)]
    assert [ln.split("\t")[0] for ln in lines[1:]] == [*groups, "empty"]
    for line in lines[1:]:
        name, *cells = line.split("\t")
        assert cells == [str(held.get((g, name), -3)) for g in reversed(genomes)]
    back = readers.read_da_table(spark, str(tmp_path / "t"))
    assert back.count() == 13 * 5000
    assert {(r.genome_id, r.group_id): r.code for r in back.filter("code > -3").collect()} == held
    assert "pivot" not in back._jdf.queryExecution().optimizedPlan().toString().lower()


def test_cluster_matrix_has_kept_clusters_only(spark, tmp_path):
    df = spark.createDataFrame([("b", "k2", 1), ("a", "k10", -1), ("a", "k3", 0)], "genome_id string, group_id string, code int")
    kept = spark.createDataFrame([("k2",), ("k10",)], "group_id string")
    order = spark.createDataFrame([("b", 1), ("a", 2)], "genome_id string, ord long")
    writers.write_cluster_matrix(df, kept, order, str(tmp_path / "m"))
    lines = [ln for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part") for ln in (tmp_path / "m" / f).read_text().splitlines()]
    assert lines == ["genome_id\tk10\tk2", "b\t-3\t1", "a\t-1\t-3"]
    writers.write_cluster_matrix(df, kept.limit(0), order, str(tmp_path / "none"))
    assert readers.read_wide(spark, str(tmp_path / "none"), "genome_id").count() == 0


def test_filter_that_no_group_passes(spark, tmp_path):
    from florabund.plans.layouts import k6_write_da_columns  # noqa: F401  registers it
    from florabund.plans.queries import QUERIES

    tables = {
        "nation": ([(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(5, 0)], "s_suppkey int, s_nationkey int"),
        "part": ([(7, "b", "t"), (8, "b", "u")], "p_partkey int, p_brand string, p_type string"),
        "orders": ([(9, "1-URGENT")], "o_orderkey int, o_orderpriority string"),
        "lineitem": ([(9, 7, 5, 10, "O")], "l_orderkey int, l_partkey int, l_suppkey int, l_quantity int, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["k6_write_da_columns"](spark, str(tmp_path))
    assert rows_of(got, "genome_id", "group_id", "code", "filtered") == [(0, "b t", -2, False), (0, "b u", -3, False), (1, "b t", -3, False), (1, "b u", -3, False)]
    spark.createDataFrame([], tables["lineitem"][1]).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("k2_write_tags", "k3_write_da_vec", "k12_split_cluster_map", "u11_upsert_in_place"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_upsert_leaves_other_genomes_files_alone(spark, tmp_path):
    path = str(tmp_path / "codes")
    df = spark.createDataFrame([("a", "k1", 0), ("a", "k2", 1), ("b", "k1", -1), ("c", "k1", 0)], "genome_id string, group_id string, code int")
    writers.write_by_genome(df, path)
    files = lambda g: {f: os.stat(f"{path}/genome_id={g}/{f}").st_mtime_ns for f in os.listdir(f"{path}/genome_id={g}")}
    before = {g: files(g) for g in "abc"}
    new = spark.createDataFrame([("a", "k2", -2), ("a", "k3", 1), ("d", "k1", 1), ("a", "nix", 1), ("z", "k1", 1)], "genome_id string, group_id string, code int")
    genomes = spark.createDataFrame([(g,) for g in "abcd"], "genome_id string")
    groups = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "group_id string")
    refused = writers.upsert_codes(spark.read.parquet(path), new, genomes, groups, path)
    assert rows_of(refused, "genome_id", "group_id") == [("a", "nix"), ("z", "k1")]
    assert rows_of(spark.read.parquet(path), "genome_id", "group_id", "code") == [("a", "k1", 0), ("a", "k2", -2), ("a", "k3", 1), ("b", "k1", -1), ("c", "k1", 0), ("d", "k1", 1)]
    assert {g: files(g) for g in "bc"} == {g: before[g] for g in "bc"}
    assert not set(files("a")) & set(before["a"])


@pytest.mark.parametrize("most", [5, 10**6])
def test_nested_bins_against_every_pair(spark, most):
    rng = random.Random(9)

    def intervals(n, spans):
        return [(k, rng.choice("cd"), s := rng.randrange(0, 200_000), s + rng.choice(spans)) for k in range(n)]

    reads = intervals(400, [0, 1, 50, 700, 90_000]) + [(1000 + k, "c", 5000, 5040) for k in range(300)]
    features = intervals(60, [3, 400, 5000, 60_000, 190_000])
    r = spark.createDataFrame(reads, "read_id long, contig string, start long, end long")
    f = spark.createDataFrame(features, "gene_id long, contig string, start long, end long")
    got = rows_of(counts.overlaps(r, f, width=16, most=most), "read_id", "gene_id")
    assert got == sorted((a[0], b[0]) for a in reads for b in features if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    long = counts._nested(f.withColumnsRenamed({"start": "f_start", "end": "f_end"}), "f_start", "f_end", 16, list(range(counts.LEVELS)))
    assert long.groupBy("gene_id").count().agg(F.max("count")).first()[0] <= 2 * counts.LEVELS


def test_a_hot_bin_is_dealt_to_tasks(spark):
    reads = spark.range(1_000_000).select("id", F.lit("c").alias("contig"), F.lit(100).cast("long").alias("start"), F.lit(150).cast("long").alias("end"))
    features = spark.createDataFrame([("c", 90, 210, "g1"), ("c", 120, 130, "g2")], "contig string, start long, end long, gene_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hit = counts.overlaps(reads, features, most=50_000)
        per = [r["n"] for r in hit.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per) == 2_000_000
        assert len(per) >= 8 and max(per) < 500_000
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_counts_at_all_thresholds_do_not_copy_reads(spark):
    rng = random.Random(4)
    data = [(f"s{rng.randrange(3)}", rng.choice(["g1", "g2", "__no_feature"]), rng.choice([None, 0.0, 10.0, 10.5, 49.0, 50.0, 99.0])) for _ in range(500)]
    df = spark.createDataFrame(data, "sample_id string, gene_id string, identity double")
    want = counts.feature_counts(counts.identity_filter(df, [10.0, 0.0, 50.0]), ["sample_id", "threshold"])
    got = counts.counts_above(df, ["sample_id"], [10.0, 0.0, 50.0])
    assert rows_of(got, "sample_id", "threshold", "gene_id", "count") == rows_of(want, "sample_id", "threshold", "gene_id", "count")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # the thresholds are told apart after the last grouping only


@pytest.mark.parametrize("tail", ["lower", "upper"])
def test_hypergeometric_tails_against_all_outcomes(tail):
    rng = random.Random(6)
    cases = [(rng.randint(0, m), m, rng.randint(0, 400), 0) for m in (0, 1, 7, 60, 300) for _ in range(20)]
    cases = [(x, m, n, rng.randint(0, m + n)) for x, m, n, _ in cases]
    got = d.hypergeometric_tails(*(np.array(c, dtype=float) for c in zip(*cases, strict=True)), tail)
    for (x, m, n, k), p in zip(cases, got.tolist(), strict=True):
        terms = {i: math.comb(m, i) * math.comb(n, k - i) for i in range(max(0, k - n), min(m, k) + 1)}
        want = sum(v for i, v in terms.items() if (i <= x if tail == "lower" else i >= x)) / math.comb(m + n, k)
        assert p == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_hypergeometric_tails_of_millions():
    x, m, n, k = (np.array([v], dtype=float) for v in (300_300, 1_000_000, 2_000_000, 900_000))
    low, high = (d.hypergeometric_tails(x, m, n, k, t)[0] for t in ("lower", "upper"))
    i = np.arange(295_000, 305_000, dtype=float)
    p = np.exp(d.log_hypergeometric(i, m, n, k))
    assert p.sum() == pytest.approx(1, abs=1e-9)
    assert low == pytest.approx(p[i <= 300_300].sum(), rel=1e-7)
    assert high == pytest.approx(p[i >= 300_300].sum(), rel=1e-7)


def test_abundance_in_tree_order(spark):
    rows = spark.createDataFrame([("a", "x", "s", 2), ("b", "x", "s", 3), ("c", "x", "s", 4), ("b", "__no_feature", "s", 9)], "genome_id string, gene_id string, sample_id string, count long")
    leaves = idspace.tree_leaf_order(spark.createDataFrame([("t", "((b:1,d:1):2,a:1);")], "tree_id string, newick string")).withColumnRenamed("leaf_id", "genome_id")
    assert [(r.genome_id, r.total, r.ord) for r in counts.genome_abundance(rows, leaves).collect()] == [("b", 3, 1), ("a", 2, 3)]
