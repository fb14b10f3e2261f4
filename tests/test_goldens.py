"""Literal cases: the small tables of the fixtures, quirks and errors."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from florabund.functions import text as T
from florabund.operators import analysis, annotate, counts, da, idspace, stats
from florabund.sources import readers, writers

GROUPS = [f"KOG0{k}" for k in range(1, 8)]


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def gene_counts(spark):
    rows = []
    for k, gene in enumerate(["101", "102", "103", "104", "105", "106", "107", "101", "108"]):
        n = 100 if k == 7 else 1
        rows += [("10001", gene, s, n, k) for s in ("col_1", "col_2")]
    return table(spark, "genome_id string, gene_id string, sample_id string, count long, ord long", *rows)


@pytest.fixture(scope="module")
def annotation(spark):
    named = {"101": "KOG01", "102": "KOG04", "103": "KOG02", "104": "KOG03", "105": "KOG05,KOG06", "106": "KOG06", "107": "KOG01"}
    return table(spark, "genome_id string, gene_id string, group_raw string, ord long", *[("10001", g, v, k) for k, (g, v) in enumerate(named.items())])


@pytest.fixture(scope="module")
def catalog(spark):
    return table(spark, "group_id string, ord long", *[(g, k) for k, g in enumerate(GROUPS)])


def test_aggregate_counts(gene_counts, annotation, catalog):
    got = pairs(counts.aggregate_counts(gene_counts, annotation, catalog), "group_id", "sample_id", "count")
    want = {"KOG01": 2, "KOG07": 0}
    assert got == {(g, s, want.get(g, 1)) for g in GROUPS for s in ("col_1", "col_2")}


def test_reports_of_aggregation(gene_counts, annotation):
    assert pairs(counts.genes_without_group(gene_counts, counts.first_group_wins(annotation)), "gene_id") == {("108",)}
    assert pairs(counts.repeated_genes(gene_counts), "gene_id", "count") == {("101", 100)}
    assert ("105", "KOG06") in pairs(counts.first_group_wins(annotation, multi="all"), "gene_id", "group_id")


def test_group_sums_plus_unassigned_are_all(gene_counts, annotation):
    once = counts.first_gene_wins(gene_counts)
    known = counts.first_group_wins(annotation)
    lost = counts.genes_without_group(once, known)
    left = once.join(lost, ["genome_id", "gene_id"]).agg(F.sum("count")).first()[0]
    assert counts.group_sums(once, known).agg(F.sum("count")).first()[0] + left == once.agg(F.sum("count")).first()[0]


@pytest.fixture(scope="module")
def matrix(spark, catalog):
    codes = dict(zip(GROUPS, [0, 1, -1, -2, -3, 1, 0], strict=True))
    rows = [(g, k, c) for g in ("10001", "10002") for k, c in codes.items()]
    return table(spark, "genome_id string, group_id string, code int", *rows)


@pytest.mark.parametrize(
    ("filters", "passed"),
    [
        ({1: (90, True)}, {"KOG02", "KOG06"}),
        ({0: (90, True)}, {"KOG01", "KOG07"}),
        ({-1: (90, True)}, {"KOG03"}),
        ({-2: (90, True)}, {"KOG04"}),
        ({-3: (90, True)}, {"KOG05"}),
        ({1: (90, False), 0: (90, False), -1: (90, False)}, {"KOG04", "KOG05"}),
        ({1: (90, False), -1: (90, False)}, {"KOG01", "KOG04", "KOG05", "KOG07"}),
        ({}, set(GROUPS)),
    ],
)
def test_filters(matrix, filters, passed):
    assert {r[0] for r in da.da_percent_filter(matrix, filters, 2).collect()} == passed


@pytest.mark.parametrize("filters", [{5: (10, True)}, {1: (101, True)}, {1: (-1, True)}])
def test_bad_filters(matrix, filters):
    with pytest.raises(ValueError, match="unknown code|percentage"):
        da.da_percent_filter(matrix, filters, 2)


def test_matrix_upsert_and_bad_codes(spark, matrix, catalog):
    genomes = table(spark, "genome_id string", ("10001",), ("10002",))
    new = table(spark, "genome_id string, group_id string, code int", ("10001", "KOG01", 4), ("10003", "KOG01", 1), ("10001", "KOG09", 1))
    out, refused = da.set_genome(matrix, new, genomes, catalog)
    assert pairs(refused, "genome_id", "group_id") == {("10003", "KOG01"), ("10001", "KOG09")}
    assert pairs(da.bad_codes(out), "genome_id", "group_id", "problem") == {("10001", "KOG01", "bad code")}
    with pytest.raises(KeyError):
        da.get_genome(matrix, genomes, "10009")
    with pytest.raises(KeyError):
        da.get_group(matrix, catalog, "KOG99")


def test_decouple_exact_and_substring(spark):
    m = table(spark, "genome_id string, group_id string, code int", ("g", "KOG1", -2), ("g", "KOG2", -2), ("g", "KOG3", 1))
    cells = table(spark, "genome_id string, group_raw string", ("g", "kog10,KOG2"), ("h", "KOG1"))
    assert pairs(da.decouple_undetected(m, cells), "group_id", "code") == {("KOG1", -3), ("KOG2", -2), ("KOG3", 1)}
    assert pairs(da.decouple_undetected(m, cells, "substring"), "group_id", "code") == {("KOG1", -2), ("KOG2", -2), ("KOG3", 1)}


def test_keep_clusters_never_keeps_the_never_abundant(matrix):
    assert {r[0] for r in da.keep_da_clusters(matrix, 2, 0).collect()} == {"KOG02", "KOG03", "KOG06"}


# fixed values: a rooted tree of fifteen genomes and the order of its leaves
ROOTED = (
    "((((((((10003:0.04690938,10013:0.04690938):0.00136799,10011:0.04827737):0.02818207,10008:0.07645944):0.01327017,((10001:0.00000000,10006:0.00000000):0.05520489,"
    "(10002:0.02682636,10012:0.02682636):0.02837854):0.03452472):0.10405049,10010:0.19378010):0.01306381,(10007:0.05937581,(10004:0.01387226,10015:0.01387226):0.04550354):0.14746810):0.10060151,"
    "(10005:0.25790658,10009:0.25790658):0.04953884):1.71310719,10184:0.00000000);"
)
ROOTED_ORDER = [10003, 10013, 10011, 10008, 10001, 10006, 10002, 10012, 10010, 10007, 10004, 10015, 10005, 10009, 10184]


def test_golden_leaf_order(spark):
    leaves = idspace.tree_leaf_order(table(spark, "tree_id string, newick string", ("t", ROOTED)))
    assert [int(r.leaf_id) for r in leaves.orderBy("ord").collect()] == ROOTED_ORDER
    assert [r.ord for r in leaves.orderBy("ord").collect()] == list(range(1, 16))


def test_tree_order_and_justify(spark):
    newick = "((10003:0.1,10013:0.2)90:0.1,(10011:1e-3, 10008:0.5):0.2,10001);"
    leaves = idspace.tree_leaf_order(table(spark, "tree_id string, newick string", ("t", newick)))
    assert [r.leaf_id for r in leaves.orderBy("ord").collect()] == ["10003", "10013", "10011", "10008", "10001"]
    ids = lambda *x: table(spark, "genome_id string", *[(i,) for i in x])
    every = ids("10003", "10013", "10011", "10008", "10001")
    ordered, problems = idspace.justify_ids(every, ids(), leaves, every, every)
    assert problems.isEmpty()
    assert [r.genome_id for r in ordered.orderBy("ord").collect()][0] == "10003"
    _, problems = idspace.justify_ids(every, ids("1000"), leaves, every, ids("10003"))
    assert ("1000", "excluded but not included") in pairs(problems, "genome_id", "problem")
    assert problems.filter("problem = 'no counts'").count() == 4
    with pytest.raises(ValueError, match="10013"):
        idspace.require(problems)


def test_text_functions(spark):
    df = spark.createDataFrame([("ID=1;ID=2;k=v=w; x;;", "product=a;b;c", "name x; y z", "a b  ", ">s1 more")], "attrs string, product string, spaced string, token string, head string")
    r = df.select(
        T.parse_attributes("attrs").alias("m"), T.bad_attributes("attrs").alias("bad"), T.fix_product_semicolon("product").alias("p"), T.fix_space_tags("spaced").alias("s"),
        T.last_token_trim("token", strict=True).alias("t"), T.last_token_trim("token").alias("u"), T.fasta_id("head").alias("h"), T.extract_tag("attrs", "id").alias("id"), T.fix_quotes(F.lit('a"b')).alias("q"),
    ).first()
    assert (r.m, r.bad, r.p, r.s, r.t, r.u, r.h, r.id, r.q) == ({"ID": "2", "k": "v=w"}, [" x"], "product=a;b,c", "name=x;y=z", "b", "a b", ">s1", "1", "a'b")


def test_readers_round_trip(spark, tmp_path):
    folder = tmp_path / "10001"
    folder.mkdir()
    (folder / "counts.txt").write_text("name\tcol_1\tcol_2\n101\t1\t2\n102\t3\t4\n__no_feature\t9\t9\n103\t5\t6\n")
    got = pairs(readers.read_gene_counts(spark, str(tmp_path / "*" / "counts.txt")), "genome_id", "gene_id", "sample_id", "count")
    assert got == {("10001", "101", "col_1", 1), ("10001", "101", "col_2", 2), ("10001", "102", "col_1", 3), ("10001", "102", "col_2", 4)}
    (folder / "annote.txt").write_text("ProteinId\tname\tKOG\n101\tx\tKOG01\n105\ty\tKOG05,KOG06\n")
    assert ("105", "KOG05,KOG06") in pairs(readers.read_annotation(spark, str(tmp_path / "*" / "annote.txt"), "proteinid", "kog"), "gene_id", "group_raw")
    (tmp_path / "ids.txt").write_text("a\tx\n\nb\n")
    assert pairs(readers.read_id_list(spark, str(tmp_path / "ids.txt")), "id") == {("a",), ("b",)}
    assert readers.read_id_list(spark, str(tmp_path / "none.txt")).isEmpty()
    (tmp_path / "cat.txt").write_text("kogId \tkogName\nKOG01\tx\nKOG02\ty\n")
    assert pairs(readers.read_group_catalog(spark, str(tmp_path / "cat.txt"), "kogid"), "group_id", "ord") == {("KOG01", 1), ("KOG02", 2)}
    (tmp_path / "empty.txt").write_text("kogId\n")
    with pytest.raises(ValueError, match="no groups"):
        readers.read_group_catalog(spark, str(tmp_path / "empty.txt"), "kogId")
    (folder / "10001.kog.tab.txt").write_text("proteinId\tkogID\n1\tKOG1\n2\tKOG2\n")
    (folder / "10001.ko.tab.txt").write_text("1\tK1\n")
    assert pairs(readers.read_annotation_pairs(spark, str(tmp_path)), "gene_id", "ann_type", "value") == {("1", "kog", "KOG1"), ("2", "kog", "KOG2"), ("1", "ko", "K1")}
    assert ("10001", ".kog.tab.txt") in pairs(readers.read_files(spark, str(tmp_path)), "genome_id", "extension")
    (folder / "tags.txt").write_text('"logFC" "logCPM" "PValue" "FDR"\n"KOG01" 1.5 3 0.01 0.02\n')
    assert pairs(readers.read_tags(spark, str(folder / "tags.txt")), "group_id", "log_fc", "fdr") == {("KOG01", 1.5, 0.02)}


def test_da_table_round_trip(spark, matrix, catalog, tmp_path):
    wide = writers.wide_da_table(matrix, catalog, ["10002", "10001"])
    assert wide.columns == ["grp_id", "10002", "10001"]
    assert [r.grp_id for r in wide.collect()] == GROUPS
    writers.write_tsv(wide.coalesce(1), str(tmp_path / "da"))
    assert pairs(readers.read_da_table(spark, str(tmp_path / "da")), "genome_id", "group_id", "code") == pairs(matrix, "genome_id", "group_id", "code")
    with pytest.raises(ValueError, match="grp_id"):
        (tmp_path / "bad.tsv").write_text("x\t1\na\t0\n")
        readers.read_da_table(spark, str(tmp_path / "bad.tsv"))
    writers.write_by_genome(matrix, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).count() == matrix.count()


def test_cluster_map_blocks(spark):
    rows = table(spark, "genome_id string, ord long", *[(g, k) for k, g in enumerate("aabba")])
    assert pairs(annotate.contiguous_blocks(rows), "genome_id", "n_blocks") == {("a", 2)}
    far = table(spark, "genome_id string, ord long", ("a", 65535), ("a", 65536), ("b", 65537), ("a", 200000))
    assert pairs(annotate.contiguous_blocks(far), "genome_id", "n_blocks") == {("a", 2)}


def test_interval_join_counts_each_pair_once(spark):
    reads = table(spark, "read_id long, contig string, start long, end long", (1, "c", 0, 100), (2, "c", 205, 207), (3, "c", 300, 301), (4, "d", 0, 5))
    features = table(spark, "contig string, start long, end long, gene_id string", ("c", 90, 210, "g1"), ("c", 100, 110, "g2"), ("c", 207, 250, "g3"))
    got = dict(counts.feature_assign(reads, features, ["read_id"], width=16).select("read_id", "gene_id").collect())
    assert got == {1: counts.AMBIGUOUS, 2: counts.AMBIGUOUS, 3: counts.NO_FEATURE, 4: counts.NO_FEATURE}
    assert counts.overlaps(reads, features, 16).count() == 4


def test_lgamma():
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 10, 1e3, 1e6])
    assert np.allclose(stats.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-12)


@given(st.integers(0, 60), st.integers(0, 60), st.sampled_from([0.0, 0.1, 1.0]), st.integers(1, 5), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_exact_test_is_symmetric_and_a_probability(a, b, phi, n1, n2):
    p = stats._exact(a, b, n1, n2, phi, "smallp")
    assert 0 < p <= 1
    assert p == pytest.approx(stats._exact(b, a, n2, n1, phi, "smallp"), rel=1e-6)
    k1, k2, s = (n1 / phi, n2 / phi, a + b) if phi else (0, 0, a + b)
    f = [math.lgamma(i + k1) - math.lgamma(i + 1) + math.lgamma(s - i + k2) - math.lgamma(s - i + 1) if phi else math.log(math.comb(s, i)) + i * math.log(n1) + (s - i) * math.log(n2) for i in range(s + 1)]
    w = [math.exp(v - max(f)) for v in f]
    assert p == pytest.approx(sum(v for v in w if v <= w[a] * (1 + 1e-7)) / sum(w), rel=1e-6)


def test_tmm_factors_multiply_to_one_and_bh_is_monotone(spark):
    rng = np.random.default_rng(3)
    rows = [("g", f"k{i}", f"s{j}", int(rng.poisson(50 * (1 + i % 7)))) for i in range(60) for j in range(4)]
    rows = table(spark, "genome_id string, group_id string, sample_id string, count long", *rows)
    libs = rows.groupBy("sample_id").agg(F.sum("count").alias("lib_size"))
    f = [r.factor for r in stats.tmm_factors(rows, libs).collect()]
    assert np.prod(f) == pytest.approx(1)
    p = rng.random(40).round(2)
    tests = table(spark, "genome_id string, group_id string, pvalue double", *[("g", f"k{i}", float(v)) for i, v in enumerate(p)], ("g", "none", None))
    got = stats.bh_adjust(tests).orderBy("pvalue", "fdr").collect()
    assert got[0].fdr is None
    q = [r.fdr for r in got[1:]]
    assert q == sorted(q)
    assert all(r.fdr >= r.pvalue for r in got[1:])


def test_dispersion_follows_the_noise(spark):
    rng = np.random.default_rng(5)
    conditions = table(spark, "sample_id string, is_other boolean", *[(f"s{j}", j > 3) for j in range(8)])

    def phi_of(noise):
        draw = lambda: int(rng.poisson(rng.gamma(1 / noise, 200 * noise)))
        rows = table(spark, "genome_id string, group_id string, sample_id string, count long", *[("g", f"k{i}", f"s{j}", draw()) for i in range(80) for j in range(8)])
        libs = conditions.select("sample_id", F.lit(1_000_000).cast("long").alias("lib_size"))
        eq = stats.equalised(rows, libs, conditions)
        return stats.common_dispersion(eq).first().phi, stats.tagwise_dispersion(eq).agg(F.expr("percentile(phi, 0.5)")).first()[0]

    (low, low_tag), (high, high_tag) = phi_of(0.05), phi_of(0.8)
    assert 0.03 < low < 0.08
    assert 0.6 < high < 1.1
    assert low_tag < high_tag


def test_pipeline_finds_planted_changes(spark):
    rng = np.random.default_rng(8)
    mean = lambda i, j: 300 * (4 if i < 5 and j > 3 else 1) / (4 if 5 <= i < 10 and j > 3 else 1)
    rows = [("g", f"k{i:02}", f"s{j}", int(rng.poisson(mean(i, j)))) for i in range(60) for j in range(8)]
    rows = table(spark, "genome_id string, group_id string, sample_id string, count long", *rows, ("h", "k00", "s0", 0))
    libs = table(spark, "sample_id string, lib_size long", *[(f"s{j}", 1_000_000) for j in range(8)])
    conditions = table(spark, "sample_id string, is_other boolean", *[(f"s{j}", j > 3) for j in range(8)])
    code = {(r.genome_id, r.group_id): r.code for r in stats.da_pipeline(rows, libs, conditions).collect()}
    assert [code["g", f"k{i:02}"] for i in range(10)] == [1] * 5 + [-1] * 5
    assert sum(code["g", f"k{i:02}"] != 0 for i in range(10, 60)) <= 3
    assert code["h", "k00"] == da.UNDETECTED


def test_hypergeometric_tails(spark):
    tested = table(spark, "genome_id string, category string, n long", ("g", "A", 5), ("g", "B", 7), ("g", "C", 0))
    chosen = table(spark, "genome_id string, category string, n long", ("g", "A", 3), ("g", "B", 1), ("g", "C", 0))
    pmf = lambda i: math.comb(5, i) * math.comb(7, 4 - i) / math.comb(12, 4)
    low = {r.category: r.p for r in analysis.hypergeo_enrichment(chosen, tested).collect()}
    high = {r.category: r.p for r in analysis.hypergeo_enrichment(chosen, tested, "upper").collect()}
    assert low["A"] == pytest.approx(sum(pmf(i) for i in range(4)))
    assert high["A"] == pytest.approx(pmf(3) + pmf(4))
    assert low["C"] == high["C"] == pytest.approx(1)


def test_welch(spark):
    rows = table(spark, "x double, c boolean", (1.0, True), (2.0, True), (4.0, True), (2.5, False), (5.0, False), (7.0, False), (8.0, False))
    r = stats.welch_t_test(rows, "x", F.col("c")).first()
    e1, e0 = np.var([1, 2, 4], ddof=1) / 3, np.var([2.5, 5, 7, 8], ddof=1) / 4
    assert r.t == pytest.approx((7 / 3 - 5.625) / math.sqrt(e1 + e0))
    x = np.linspace(-abs(r.t), abs(r.t), 200_001)
    inside = np.trapezoid((1 + x * x / r.df) ** (-(r.df + 1) / 2), x) * math.gamma((r.df + 1) / 2) / math.gamma(r.df / 2) / math.sqrt(r.df * math.pi)
    assert r.pvalue == pytest.approx(1 - inside, abs=1e-6)


def test_streaming_sums(spark, gene_counts, annotation, tmp_path):
    from florabund.streaming.incremental import running_group_counts

    gene_counts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(gene_counts.schema).parquet(str(tmp_path / "in"))
    q = running_group_counts(stream, counts.first_group_wins(annotation)).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.table("sums"), "group_id", "sample_id", "count") == pairs(counts.group_sums(gene_counts, counts.first_group_wins(annotation)), "group_id", "sample_id", "count")
