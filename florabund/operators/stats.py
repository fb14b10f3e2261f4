"""Normalisation, dispersion, exact tests and false discovery rates.

Trimmed mean of M values: Robinson and Oshlack 2010. Conditional likelihood and exact test of the negative
binomial: Robinson and Smyth 2007, 2008. False discovery rate: Benjamini and Hochberg 1995.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import beta_cdf, lgamma, mean_rates, moved_counts, split_pvalues
from ..sources.shared import stored
from .counts import cpm, min_cpm_filter
from .da import UNDETECTED, da_code

TRIM_M, TRIM_A = 0.3, 0.05
#: Steps of delta = phi / (1 + phi) on which the likelihood is taken.
GRID = 20
#: Steps of log2(phi / common phi) on which a group's own dispersion is looked for, and how far they reach.
STEPS, REACH = 25, 6.0


def tmm_factors(counts: DataFrame, libraries: DataFrame) -> DataFrame:
    """counts(genome_id, group_id, sample_id, count), libraries(sample_id, lib_size) -> genome_id, sample_id, factor; the factors of a genome multiply to 1.

    The reference sample has its upper quartile closest to the mean of all. M and A values are
    rounded to ten digits before they are ranked, so equal values tie.
    """
    rows = counts.join(libraries, "sample_id")
    seen = rows.groupBy("genome_id", "group_id").agg(F.sum("count").alias("t")).filter("t > 0").select("genome_id", "group_id")
    quartile = rows.join(seen, ["genome_id", "group_id"], "left_semi").groupBy("genome_id", "sample_id").agg(F.percentile(F.col("count") / F.col("lib_size"), 0.75).alias("q"))
    mean = quartile.groupBy("genome_id").agg(F.avg("q").alias("m"))
    ref = quartile.join(mean, "genome_id").groupBy("genome_id").agg(F.min_by("sample_id", F.struct(F.round(F.abs(F.col("q") - F.col("m")), 15), "sample_id")).alias("ref"))
    positive = rows.filter("count > 0")
    base = positive.join(ref, (positive.genome_id == ref.genome_id) & (positive.sample_id == ref.ref)).select(positive.genome_id, "group_id", F.col("count").alias("rc"), F.col("lib_size").alias("rl"))
    pair = positive.join(base, ["genome_id", "group_id"])
    y, n, r, rn = F.col("count"), F.col("lib_size"), F.col("rc"), F.col("rl")
    pair = pair.select(
        "genome_id", "sample_id", F.round(F.log2((y / n) / (r / rn)), 10).alias("m"), F.round((F.log2(y / n) + F.log2(r / rn)) / 2, 10).alias("a"), ((n - y) / n / y + (rn - r) / rn / r).alias("v")
    )
    w = Window.partitionBy("genome_id", "sample_id")
    tied = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("genome_id", "sample_id", c)) - 1) / 2
    ranked = pair.withColumns({"n": F.count("*").over(w), "rm": tied("m"), "ra": tied("a")})
    lm, la = F.floor(F.col("n") * TRIM_M) + 1, F.floor(F.col("n") * TRIM_A) + 1
    kept = ranked.filter((F.col("rm") >= lm) & (F.col("rm") <= F.col("n") + 1 - lm) & (F.col("ra") >= la) & (F.col("ra") <= F.col("n") + 1 - la))
    raw = kept.groupBy("genome_id", "sample_id").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("f"))
    raw = quartile.select("genome_id", "sample_id").join(raw, ["genome_id", "sample_id"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return raw.select("genome_id", "sample_id", F.pow(F.lit(2.0), F.col("f") - F.avg("f").over(Window.partitionBy("genome_id"))).alias("factor"))


def sample_arrays(counts: DataFrame, libraries: DataFrame, conditions: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """A row per (genome, group): genome_id, group_id, common, and of both classes the counts and effective library sizes in the order of samples: base_y[], base_e[], other_y[], other_e[].

    conditions(sample_id, is_other). common: the geometric mean of the genome's effective libraries.
    """
    rows = counts.join(libraries, "sample_id").join(conditions, "sample_id")
    eff = F.col("lib_size").cast("double")
    if factors is not None:
        rows = rows.join(factors, ["genome_id", "sample_id"], "left")
        eff = eff * F.coalesce("factor", F.lit(1.0))
    rows = rows.withColumn("e", eff)
    common = rows.groupBy("genome_id", "sample_id").agg(F.max("e").alias("e")).groupBy("genome_id").agg(F.exp(F.avg(F.ln("e"))).alias("common"))
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("sample_id", F.col("count").cast("double").alias("y"), "e"))))  # noqa: E731  one number per sample
    grouped = rows.groupBy("genome_id", "group_id").agg(of(~F.col("is_other")).alias("b"), of(F.col("is_other")).alias("o")).join(common, "genome_id")
    return grouped.select("genome_id", "group_id", "common", F.col("b.y").alias("base_y"), F.col("b.e").alias("base_e"), F.col("o.y").alias("other_y"), F.col("o.e").alias("other_e"))


def equalised(counts: DataFrame, libraries: DataFrame, conditions: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Per (genome, group) the pseudo-counts of both classes by linear scaling to the geometric mean of the genome's effective libraries: genome_id, group_id, base[], other[]."""
    rows = sample_arrays(counts, libraries, conditions, factors)
    scaled = lambda side: F.zip_with(f"{side}_y", f"{side}_e", lambda y, e: y * F.col("common") / e)
    return rows.select("genome_id", "group_id", scaled("base").alias("base"), scaled("other").alias("other"))


def quantile_adjusted(arrays: DataFrame, phi: float | None = None) -> DataFrame:
    """sample_arrays(), with a phi column unless phi is given -> its other columns, base[] and other[]: what the counts would be in libraries of the common size.

    Within a class a group's share of a library is its most likely one for dispersion phi; a count of the mean that its own library has
    moves to the same quantile of that of the common library (Robinson and Smyth 2008). A null phi gives null arrays.
    """

    @F.pandas_udf("array<double>")
    def moved(y: pd.Series, e: pd.Series, common: pd.Series, phi: pd.Series) -> pd.Series:
        n = np.fromiter(map(len, y), dtype=np.int64, count=len(y))
        ok = ~phi.isna().to_numpy()
        out: list = [np.zeros(0) if good else None for good in ok]
        rows = np.flatnonzero(ok & (n > 0))
        if len(rows):
            width = int(n[rows].max())
            ys, es = np.zeros((len(rows), width)), np.zeros((len(rows), width))
            for k, r in enumerate(rows):
                ys[k, : n[r]], es[k, : n[r]] = y.iloc[r], e.iloc[r]
            f = phi.to_numpy(dtype=float)[rows]
            share = mean_rates(ys, es, f)
            held = es > 0
            of = np.nonzero(held)[0]
            pseudo = np.zeros_like(ys)
            pseudo[held] = moved_counts(ys[held], es[held] * share[of], common.to_numpy(dtype=float)[rows][of] * share[of], f[of])
            for k, r in enumerate(rows):
                out[r] = pseudo[k, : n[r]]
        return pd.Series(out)

    at = F.lit(float(phi)) if phi is not None else F.col("phi")
    return arrays.select("*", moved("base_y", "base_e", "common", at).alias("base"), moved("other_y", "other_e", "common", at).alias("other"))


def _likelihoods(classes: list[pd.Series], phi: np.ndarray) -> np.ndarray:
    """Conditional log-likelihood of each row at its phi (rows x points); rows of equally many samples are taken together, in blocks of bounded size."""
    out, r = np.zeros(phi.shape), 1 / phi
    for ys in classes:
        n = np.fromiter((0 if y is None else len(y) for y in ys), dtype=np.int64, count=len(ys))
        for size in np.unique(n[n > 1]).tolist():
            rows = np.flatnonzero(n == size)
            step = max(1, (1 << 20) // (size * phi.shape[1]))
            for at in (rows[k : k + step] for k in range(0, len(rows), step)):
                y, q = np.array([ys.iloc[k] for k in at], dtype=float), r[at]
                out[at] += lgamma(y[:, :, None] + q[:, None, :]).sum(axis=1) + lgamma(size * q) - lgamma(y.sum(axis=1)[:, None] + size * q) - size * lgamma(q)
    return out


def _with_likelihoods(rows: DataFrame, deltas: Column) -> DataFrame:
    """rows of equalised() with ll[]: the conditional log-likelihoods of a row at its deltas."""

    @F.pandas_udf("array<double>")
    def grid(base: pd.Series, other: pd.Series, at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype=object)
        d = np.array(at.tolist(), dtype=float)
        return pd.Series(list(_likelihoods([base, other], d / (1 - d))))

    return rows.withColumn("ll", grid("base", "other", deltas))


def common_dispersion(rows: DataFrame, levels: int = 3, vertex: bool = False) -> DataFrame:
    """genome_id, phi: the dispersion with the largest summed conditional likelihood, on a grid of delta that is refined levels - 1 times; ties take the smaller.

    Likelihoods are summed as arrays, so a genome is one row of partial sums. vertex: the top of the parabola through the best point and its neighbours in place of the best point.
    """
    step, best = 1 / (GRID + 1), None
    for level in range(levels):
        if best is None:
            points = rows.withColumn("deltas", F.array(*[F.lit(k * step) for k in range(1, GRID + 1)]))
        else:
            fine = step * 2 / (GRID + 1)
            near = [F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("delta") + (k - (GRID + 1) / 2) * fine)) for k in range(1, GRID + 1)]
            points, step = rows.join(best.select("genome_id", "delta"), "genome_id").withColumn("deltas", F.array(*near)), fine
        summed = _with_likelihoods(points, F.col("deltas")).groupBy("genome_id").agg(F.first("deltas").alias("deltas"), F.array(*[F.sum(F.col("ll")[k]) for k in range(GRID)]).alias("ll"))
        order = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: F.struct(F.round(F.get("ll", k), 8).alias("ll"), (-F.get("deltas", k)).alias("minus"), k.alias("k")))
        best = summed.withColumn("top", F.array_max(order)).select("genome_id", (-F.col("top.minus")).alias("delta"), "ll", "deltas", F.col("top.k").alias("k"))
        if level < levels - 1:
            best = stored(best)
    delta = F.col("delta")
    if vertex:
        y = [F.get("ll", F.col("k") + d) for d in (-1, 0, 1)]
        bend = y[0] - 2 * y[1] + y[2]
        inside = (F.col("k") > 0) & (F.col("k") < GRID - 1) & (bend < 0) & (F.get("deltas", F.col("k") + 1) > delta) & (F.get("deltas", F.col("k") - 1) < delta)
        delta = F.when(inside, delta + (y[0] - y[2]) / (2 * bend) * step).otherwise(delta)
    return best.select("genome_id", (delta / (1 - delta)).alias("phi"))


def _with_abundance(rows: DataFrame, prior_df: float) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rows.withColumns({"abundance": F.round(total("base") + total("other"), 6), "prior_n": prior_df / F.greatest(F.lit(1), F.size("base") + F.size("other") - 2)})


def _shared(points: DataFrame, n: int, reach: int) -> Column:
    """Element by element, ll[] plus the prior's weight times the mean one of the neighbours by abundance."""
    w = Window.partitionBy("genome_id").orderBy("abundance", "group_id").rowsBetween(-reach, reach)
    return F.array(*[F.col("ll")[k] + F.col("prior_n") * F.avg(F.col("ll")[k]).over(w) for k in range(n)])


def tagwise_dispersion(rows: DataFrame, prior_df: float = 10.0, reach: int = 10) -> DataFrame:
    """genome_id, group_id, phi: own likelihood plus the prior's weight times the mean one of the `reach` neighbours by abundance on either side, on a fixed grid of delta; ties take the smaller.

    The weight is prior_df over the degrees of freedom, samples less two classes.
    """
    deltas = [k / (GRID + 1) for k in range(1, GRID + 1)]
    points = _with_likelihoods(_with_abundance(rows, prior_df), F.array(*map(F.lit, deltas)))
    points = points.select("genome_id", "group_id", _shared(points, GRID, reach).alias("score"))
    order = F.transform(F.arrays_zip("score", F.array(*[F.lit(-d) for d in deltas]).alias("minus")), lambda x: F.struct(F.round(x["score"], 8).alias("score"), x["minus"].alias("minus")))
    delta = -F.array_max(order)["minus"]
    return points.select("genome_id", "group_id", (delta / (1 - delta)).alias("phi"))


def spline_top(values: np.ndarray) -> np.ndarray:
    """Per row the place, in steps from the first, of the greatest value of the natural cubic spline through equally spaced values."""
    rows, n = values.shape
    system = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    system[0], system[-1] = np.eye(n)[0], np.eye(n)[-1]
    right = np.zeros((rows, n))
    right[:, 1:-1] = 6 * (values[:, 2:] - 2 * values[:, 1:-1] + values[:, :-2])
    bend = np.linalg.solve(system, right.T).T  # second derivatives
    k = values.argmax(axis=1)
    best_at, best = k.astype(float), values[np.arange(rows), k]
    for left in (np.maximum(k - 1, 0), np.minimum(k, n - 2)):
        r = np.arange(rows)
        y0, y1, m0, m1 = values[r, left], values[r, left + 1], bend[r, left], bend[r, left + 1]
        c, b, a = (m1 - m0) / 6, m0 / 2, y1 - y0 - (2 * m0 + m1) / 6
        with np.errstate(all="ignore"):
            root = np.sqrt(b * b - 3 * a * c)
            # of the derivative's roots, that where it falls
            t = np.where(np.abs(c) > 1e-14 * (1 + np.abs(b)), (-b - root) / (3 * c), -a / (2 * b))
            top = y0 + t * (a + t * (b + t * c))
        better = (t > 0) & (t < 1) & (top > best)
        best_at, best = np.where(better, left + t, best_at), np.where(better, top, best)
    return best_at


def refined_dispersion(rows: DataFrame, common: DataFrame, prior_df: float = 10.0, reach: int = 10) -> DataFrame:
    """genome_id, group_id, phi as tagwise_dispersion(), but looked for around the genome's common(genome_id, phi) on STEPS equal steps of log2(phi), at the top of a spline through them.

    phi lies within a factor of 2^REACH of the common one; a genome without one gets none.
    """

    @F.pandas_udf("double")
    def top(score: pd.Series, common: pd.Series) -> pd.Series:
        at = spline_top(np.array(score.tolist(), dtype=float)) if len(score) else np.zeros(0)
        return pd.Series(common.to_numpy(dtype=float) * 2 ** (at * 2 * REACH / (STEPS - 1) - REACH))

    factors = [2 ** (k * 2 * REACH / (STEPS - 1) - REACH) for k in range(STEPS)]
    known = common.select("genome_id", F.col("phi").alias("common_phi"))
    rows = _with_abundance(rows.join(known, "genome_id"), prior_df).withColumn("deltas", F.array(*[F.col("common_phi") * f / (1 + F.col("common_phi") * f) for f in factors]))
    points = _with_likelihoods(rows, F.col("deltas"))
    return points.select("genome_id", "group_id", "common_phi", _shared(points, STEPS, reach).alias("score")).select("genome_id", "group_id", top("score", "common_phi").alias("phi"))


def estimated_dispersions(arrays: DataFrame, rounds: int = 2, start: float = 0.01, least_sum: float = 5, prior_df: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """sample_arrays() -> (genome_id, phi) and (genome_id, group_id, phi): common and tagwise dispersions of quantile-adjusted counts.

    The common one is found `rounds` times, each on counts adjusted with the one before, from groups of more than least_sum reads. Stored between rounds.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    enough = arrays.filter(total("base_y") + total("other_y") > least_sum)
    pseudo = quantile_adjusted(enough, start)
    for left in range(rounds, 0, -1):
        common = stored(common_dispersion(stored(pseudo), 3, vertex=True))
        if left > 1:
            pseudo = quantile_adjusted(enough.join(common, "genome_id"))
    adjusted = quantile_adjusted(arrays.join(common, "genome_id")).drop("phi")
    return common, refined_dispersion(adjusted, common, prior_df)


def _exact(z1: int, z2: int, n1: int, n2: int, phi: float, rule: str) -> float:
    """P-value of the split z1 + z2 of a sum among n1 and n2 samples."""
    return float(split_pvalues(*(np.array([v], dtype=float) for v in (z1, z2, n1, n2, phi)), rule)[0])


def nb_exact_test(rows: DataFrame, dispersion: float | None = None, rule: str = "doubletail") -> DataFrame:
    """rows of equalised(), with a phi column unless dispersion is given (0: binomial) -> genome_id, group_id, z1, z2, pvalue.

    z1, z2 are the classes' rounded sums. rule 'doubletail' doubles the smaller tail, 'smallp' sums all outcomes that are no likelier
    than the observed. A null phi gives a null p-value. The rule is the same for sums of any size; a row takes some hundred terms.
    """
    phi = F.lit(float(dispersion)) if dispersion is not None else F.col("phi")

    @F.pandas_udf("double")
    def test(z1: pd.Series, z2: pd.Series, n1: pd.Series, n2: pd.Series, phi: pd.Series) -> pd.Series:
        p = split_pvalues(*(x.to_numpy(dtype=float) for x in (z1, z2, n1, n2, phi)), rule)
        return pd.Series(p).where(~np.isnan(p), None).astype("Float64")

    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x)).cast("long")
    z = rows.withColumns({"z1": total("base"), "z2": total("other"), "n1": F.size("base"), "n2": F.size("other")})
    return z.withColumn("pvalue", test("z1", "z2", "n1", "n2", phi)).select("genome_id", "group_id", "z1", "z2", "pvalue")


def log_fc(rows: DataFrame, prior: float = 0.125) -> DataFrame:
    """rows of equalised() -> genome_id, group_id, log_fc: log2 of the classes' means, other over base, a prior count added to both."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return rows.select("genome_id", "group_id", F.log2((mean("other") + prior) / (mean("base") + prior)).alias("log_fc"))


def bh_adjust(tests: DataFrame, by: str = "genome_id") -> DataFrame:
    """tests plus fdr within each level of `by`; rows with a null p-value get none and do not count."""
    valid = F.col("pvalue").isNotNull()
    w = Window.partitionBy(by, "__valid")
    out = tests.withColumn("__valid", valid).withColumn("__rank", F.row_number().over(w.orderBy("pvalue"))).withColumn("__n", F.count("*").over(w))
    fdr = F.least(F.lit(1.0), F.min(F.col("pvalue") * F.col("__n") / F.col("__rank")).over(w.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("fdr", F.when(valid, fdr)).drop("__valid", "__rank", "__n")


def da_pipeline(
    counts: DataFrame, libraries: DataFrame, conditions: DataFrame, min_cpm: float = 0.03, min_samples: int = 3, dispersion: float | None = None, max_fdr: float = 0.05, normalise: bool = True, adjust: str = "quantile"
) -> DataFrame:
    """Group counts -> genome_id, group_id, log_fc, pvalue, fdr, code for every group; -2 for those that are not tested.

    Counts are brought to a common library by quantiles, dispersions are estimated on them in rounds, and the test takes counts adjusted with each
    group's own dispersion. adjust='linear' scales counts instead, and takes dispersions of the fixed grid.
    """
    used = stored(counts.join(conditions, "sample_id", "left_semi"))
    factors = stored(tmm_factors(used, libraries)) if normalise else None
    enough = min_cpm_filter(cpm(used, libraries, factors), min_cpm, min_samples)
    if adjust == "linear":
        rows = stored(equalised(used, libraries, conditions, factors).join(enough, ["genome_id", "group_id"], "left_semi"))
        if dispersion is None:
            rows = rows.join(common_dispersion(rows).withColumnRenamed("phi", "common"), "genome_id", "left").join(tagwise_dispersion(rows), ["genome_id", "group_id"], "left")
            rows = rows.withColumn("phi", F.coalesce("phi", "common"))
    elif adjust == "quantile":
        arrays = stored(sample_arrays(used, libraries, conditions, factors).join(enough, ["genome_id", "group_id"], "left_semi"))
        if dispersion is None:
            _, own = estimated_dispersions(arrays)
            rows = stored(quantile_adjusted(arrays.join(own, ["genome_id", "group_id"])))
        else:
            rows = stored(quantile_adjusted(arrays, dispersion))
    else:
        raise ValueError(f"no way {adjust!r} to adjust libraries")
    tests = bh_adjust(nb_exact_test(rows, dispersion)).join(log_fc(rows), ["genome_id", "group_id"])
    every = counts.select("genome_id", "group_id").distinct()
    out = every.join(tests, ["genome_id", "group_id"], "left")
    return out.select("genome_id", "group_id", "log_fc", "pvalue", "fdr", F.coalesce(da_code(max_fdr=max_fdr), F.lit(UNDETECTED)).alias("code"))


def _t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if t == t and df == df and df > 0 else float("nan")


def welch_t_test(rows: DataFrame, value: str, by: Column, keys: list[str] | None = None) -> DataFrame:
    """Welch's t of value where `by` is true against where it is false: t, df, pvalue (per keys)."""
    one = lambda c, n: [F.avg(F.when(c, F.col(value))).alias(f"m{n}"), F.var_samp(F.when(c, F.col(value))).alias(f"v{n}"), F.count_if(c).alias(f"n{n}")]
    s = rows.groupBy(*(keys or [])).agg(*one(by, 1), *one(~by, 0))
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_t_tail(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")

    s = s.withColumn("t", (F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0)).withColumn("df", (e1 + e0) ** 2 / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1)))
    return s.withColumn("pvalue", tail("t", "df")).select(*(keys or []), "n1", "n0", "m1", "m0", "t", "df", "pvalue")
