"""Exact tails, quantile adjustment and dispersions against enumeration, bisection and dense grids."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from florabund.functions import distributions as d
from florabund.operators import stats


def enumerated(z1, z2, n1, n2, phi, rule):
    """The test over all outcomes, in extended precision."""
    s, one = z1 + z2, np.longdouble
    a = np.arange(s, dtype=one)
    step = np.log((a + n1 / one(phi)) / (a + 1)) + np.log((s - a) / (s - a - 1 + n2 / one(phi))) if phi else np.log((s - a) / (a + 1)) + np.log(one(n1) / n2)
    f = np.concatenate([[one(0)], np.cumsum(step)])
    p = np.exp(f - f.max())
    p /= p.sum()
    if rule == "doubletail":
        return float(min(1, 2 * min(p[: z1 + 1].sum(), p[z1:].sum())))
    return float(min(1, p[p <= p[z1] * (1 + one(1e-7))].sum()))


@pytest.mark.parametrize("rule", ["doubletail", "smallp"])
@pytest.mark.parametrize("s", [1, 2, 31, 32, 33, 64, 65, 900, 1800, 5000, 70_000, (1 << 20) - 1, 1 << 20, (1 << 20) + 1])
def test_exact_tails_against_all_outcomes(s, rule):
    rng = random.Random(s)
    rows = []
    for _ in range(3 if s > 100_000 else 25):
        n1, n2, phi = rng.randint(1, 8), rng.randint(1, 8), rng.choice([0.0, 1e-6, 1e-4, 1e-3, 0.01, 0.05, 0.3, 1.0, 2.0, 5.0, 40.0])
        mean = s * n1 / (n1 + n2)
        sd = math.sqrt(mean * n2 / (n1 + n2) * (1 + s * phi / (n1 + n2)))
        z1 = rng.choice([0, s, s // 2, *[min(s, max(0, int(rng.gauss(mean, k * sd)))) for k in (0.3, 1, 1, 3, 3)]])
        rows.append((z1, s - z1, n1, n2, phi))
    got = d.split_pvalues(*(np.array(c, dtype=float) for c in zip(*rows, strict=True)), rule)
    for row, p in zip(rows, got.tolist(), strict=True):
        assert p == pytest.approx(enumerated(*row, rule), rel=2e-9, abs=1e-280), row


def test_a_huge_sum_takes_a_few_hundred_terms():
    for phi, s in itertools.product((0.0, 1e-6, 0.05, 2.0), (10**7, 10**9)):
        split = d.Split(s, 4, 5, phi)
        for first, last in [(int(split.mean), 0), (int(split.mean), s), *split.no_likelier(int(0.4 * s))]:
            assert sum(min(w, d.NODES if w > d.PLAIN else w) for _, w in split.blocks(first, last)) < 6000
    assert math.isnan(d.split_pvalues(*(np.array([v]) for v in (3.0, 4.0, 1.0, 1.0, math.nan)))[0])
    assert d.split_pvalues(*(np.array([v]) for v in (0.0, 0.0, 2.0, 2.0, 0.1)))[0] == 1
    with pytest.raises(ValueError):
        d.split_pvalues(*(np.array([1.0]) for _ in range(5)), rule="other")


def test_lattice_rule_sums_polynomials():
    for width in (7, 32, 33, 64, 1024, 1 << 20):
        x, w = d.lattice_rule(width)
        u = x / width
        for degree in (0, 1, 5, 12):
            k = np.arange(min(width, 1 << 20)) / width
            assert (w * u**degree).sum() == pytest.approx((k**degree).sum(), rel=1e-10)


def test_gamma_tails_and_quantiles():
    for n in (1, 4, 30, 250):  # whole shapes: the upper tail is a Poisson sum
        x = n * np.array([0.01, 0.5, 1.0, 1.7, 4.0])
        want = [sum(math.exp(k * math.log(v) - v - math.lgamma(k + 1)) for k in range(n)) for v in x]
        low, high = d.log_gamma_tails(x, np.full(5, float(n)))
        assert np.exp(high) == pytest.approx(want, rel=1e-11)
        assert np.exp(low) + np.exp(high) == pytest.approx(1)
    rng = np.random.default_rng(2)
    a = np.exp(rng.uniform(-3, 11, 300))
    x = a * np.exp(rng.normal(0, 2 / np.sqrt(a)))
    low, high = d.log_gamma_tails(x, a)
    assert d.gamma_quantile(np.where(x > a, high, low), x > a, a, a) == pytest.approx(x, rel=1e-9)


def test_moved_counts_keep_their_quantile():
    """Both quantiles by bisection on numerically integrated densities."""

    def gamma_cdf(x, a):
        u = np.linspace(0, x ** min(1, a), 40_001)  # u = x^a removes the pole at 0
        f = np.exp(-(u ** (1 / a))) / a if a < 1 else u ** (a - 1) * np.exp(-u)
        return np.trapezoid(f, u) / math.gamma(a)

    for y, before, after, phi in [(3, 5, 8, 0.3), (12, 5, 4, 0.3), (40, 30, 60, 0.1), (1, 20, 10, 0.5), (9, 2, 3, 2.0)]:
        r1, r2 = 1 + phi * before, 1 + phi * after
        want, lo, hi = gamma_cdf(y / r1, before / r1), 0.0, 100.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if gamma_cdf(mid, after / r2) < want else (lo, mid)
        normal = after + (y - before) / math.sqrt(before * r1) * math.sqrt(after * r2)
        assert d.moved_counts(*(np.array([float(v)]) for v in (y, before, after, phi)))[0] == pytest.approx(max(0, (normal + lo * r2) / 2), rel=1e-4)
    same = d.moved_counts(np.array([0.0, 7.0]), np.array([3.0, 3.0]), np.array([3.0, 3.0]), np.array([0.1, 0.0]))
    assert same.tolist() == [0, 7]
    assert (d.moved_counts(np.array([0.0, 0.0]), np.array([0.0, 9.0]), np.array([5.0, 0.0]), np.array([0.1, 0.1])) >= 0).all()


def test_mean_rates_are_most_likely():
    y, size = np.array([[3.0, 9.0, 4.0, 0.0]]), np.array([[100.0, 220.0, 90.0, 0.0]])
    for phi in (0.0, 0.2, 3.0):
        b = d.mean_rates(y, size, np.array([phi]))[0]
        assert b > 0
        slope = sum((v - s * b) / (1 + phi * s * b) for v, s in zip(y[0][:3], size[0][:3], strict=True))
        assert slope == pytest.approx(0, abs=1e-9)
    assert d.mean_rates(np.zeros((1, 2)), np.ones((1, 2)), np.array([0.1])).tolist() == [0]


def test_spline_top():
    x = np.arange(25.0)
    tops = np.array([7.3, 12.0, 3.86])
    found = stats.spline_top(np.exp(-((x[None, :] - tops[:, None]) ** 2) / 20))
    assert found == pytest.approx(tops, abs=4e-3)
    assert stats.spline_top(np.stack([x, -x])).tolist() == [24, 0]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(21)
    libraries = {f"s{j}": 1_000_000 * (1 + j % 3) for j in range(7)}
    rows = []
    for i in range(30):
        noise = 0.1 + 0.4 * (i % 3)
        for j in range(7):
            rows.append(("g" if i % 2 else "h", f"k{i:02}", f"s{j}", int(rng.poisson(rng.gamma(1 / noise, 80 * (1 + j % 3) * noise)))))
    counts = spark.createDataFrame(rows, "genome_id string, group_id string, sample_id string, count long")
    libs = spark.createDataFrame(list(libraries.items()), "sample_id string, lib_size long")
    conditions = spark.createDataFrame([(s, s > "s3") for s in libraries], "sample_id string, is_other boolean")
    return counts, libs, conditions


def likelihood(classes, phi):
    out = 0.0
    for y in classes:
        n, r = len(y), 1 / phi
        if n > 1:
            out += sum(math.lgamma(v + r) for v in y) + math.lgamma(n * r) - math.lgamma(sum(y) + n * r) - n * math.lgamma(r)
    return out


def test_common_dispersion_against_a_dense_grid(spark, noisy):
    rows = stats.quantile_adjusted(stats.sample_arrays(*noisy), 0.3)
    got = {r.genome_id: r.phi for r in stats.common_dispersion(rows, vertex=True).collect()}
    for genome, phi in got.items():
        groups = [(r.base, r.other) for r in rows.filter(F.col("genome_id") == genome).collect()]
        dense = np.arange(phi * 0.98, phi * 1.02, phi * 1e-4)
        assert phi == pytest.approx(dense[np.argmax([sum(likelihood(c, x) for c in groups) for x in dense])], rel=3e-4)


def test_refined_dispersion_to_three_digits(spark, noisy):
    common, own = stats.estimated_dispersions(stats.sample_arrays(*noisy))
    first = {r.genome_id: r.phi for r in common.collect()}
    adjusted = stats.quantile_adjusted(stats.sample_arrays(*noisy).join(common, "genome_id")).collect()
    got = {(r.genome_id, r.group_id): r.phi for r in own.collect()}
    assert len(got) == 30
    for genome, phi in first.items():
        rows = sorted((r for r in adjusted if r.genome_id == genome), key=lambda r: (round(sum(r.base) + sum(r.other), 6), r.group_id))
        dense = phi * 2 ** np.arange(-6, 6.0001, 0.002)
        each = np.array([[likelihood((r.base, r.other), x) for x in dense] for r in rows])
        for k, r in enumerate(rows):
            score = each[k] + 10 / 5 * each[max(0, k - 10) : k + 11].mean(axis=0)
            assert got[genome, r.group_id] == pytest.approx(dense[score.argmax()], rel=2e-3)


def test_default_pipeline_adjusts_by_quantiles(spark, noisy):
    counts, libs, conditions = noisy
    got = {(r.genome_id, r.group_id): r for r in stats.da_pipeline(counts, libs, conditions, min_samples=2).collect()}
    assert len(got) == 30 and all(r.code in (-1, 0, 1) for r in got.values())
    assert sum(r.code != 0 for r in got.values()) <= 3  # nothing differs
    linear = {(r.genome_id, r.group_id): r.pvalue for r in stats.da_pipeline(counts, libs, conditions, min_samples=2, adjust="linear").collect()}
    assert max(abs(linear[k] - r.pvalue) for k, r in got.items()) > 1e-3
    with pytest.raises(ValueError):
        stats.da_pipeline(counts, libs, conditions, adjust="none")


def test_a_group_seen_in_one_class_only(spark):
    counts = spark.createDataFrame([("g", "k", "s0", 5), ("g", "k", "s1", 7), ("g", "m", "s0", 0), ("g", "m", "s1", 0)], "genome_id string, group_id string, sample_id string, count long")
    libs = spark.createDataFrame([("s0", 100), ("s1", 300)], "sample_id string, lib_size long")
    conditions = spark.createDataFrame([("s0", False), ("s1", False)], "sample_id string, is_other boolean")
    rows = {r.group_id: r for r in stats.quantile_adjusted(stats.sample_arrays(counts, libs, conditions), 0.1).collect()}
    assert rows["k"].other == [] and len(rows["k"].base) == 2 and rows["m"].base == [0, 0]
