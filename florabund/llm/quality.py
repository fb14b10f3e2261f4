"""Quality rules with risk-controlled cutoffs: exact binomial bounds on labelled holdouts, per stratum.

Each rule is a number per document with a fixed ladder of cutoffs from lenient to strict. Labelled
good documents of a stratum are split by hash. One half proposes for each rule the strictest cutoff that
rejects at most its share, risk / rules, of them. The proposal and all more lenient ones, every
rule a step back at a time, are a sequence of joint verdicts; on the other half, the holdout, a verdict that
rejects k of n is certified when P(Binomial(n, risk) <= k) <= delta / strata, that is when the exact
upper confidence bound of its false rejection rate, of all rules together, is at most `risk`. Along the
sequence k only grows, so testing from the lenient end needs no further correction (fixed
sequence); strata are corrected by Bonferroni. The strictest certified verdict is applied; a
stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small_batches, stored, vectorized

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: rule -> (SQL over the base columns, ladder of cutoffs from lenient to strict; a document is rejected above it).
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "dup_lines_per_word": ("n_dup_lines / n_words", [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04]),
    "repeat_share": ("n_repeat_words / n_words", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4]),
    "long_words": ("word_chars / n_words", [60.0, 40.0, 30.0, 20.0, 15.0, 12.0, 10.0]),
    "short_words": ("- word_chars / n_words", [-1.2, -1.5, -1.8, -2.0, -2.5, -3.0]),
}
_IDS_LIMIT = 1 << 20


def _repeats(found: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(found)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), dtype=np.int64, count=n)
    if len(number) == n:
        return 0
    if len(number) < _IDS_LIMIT:
        code = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:  # three numbers no longer fit 63 bits together
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        code = pair[:-1] * len(number) + ids[2:]
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    hit = times[back] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= hit
    return int(inside.sum())


@vectorized(BASE, once=True)
def base_counts(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        if not t:
            rows.append((0, 0, 0, 0, 0))
            continue
        raw = t.encode("utf-8", "surrogatepass")
        found = raw.split()
        spaces = len(raw) - len(raw.translate(None, SPACE))
        symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        lines = Counter(x for x in raw.split(b"\n") if x and not x.isspace())
        rows.append((len(found), len(t) - spaces, symbols, sum(lines.values()) - len(lines), _repeats(found)))
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measure(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, stratum, the base counts and base_failed for every row of docs(doc_id, text, lang), besides what is carried; a null lang is a stratum of its own."""
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", F.coalesce(F.concat(F.lit("lang "), F.col("lang").cast("string")), F.lit("no lang")).alias("stratum"), base_counts(F.col("text").cast("string")).alias("c"), *carry).select("*", "c.*").drop("c")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_value(rule: str) -> Column:
    return F.when(F.col("n_words") > 0, F.expr(RULES[rule][0]).cast("double"))


def binomial_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(Binomial(n, p) <= k), summed in log space from the largest term down until the rest is beyond a double's last digit."""
    out = np.ones(len(k))
    for i, (a, b) in enumerate(zip(k, n, strict=True)):
        a, b = int(a), int(b)
        if a < b * p:  # else the tail is over about one half and never certifies
            total, top = 0.0, a
            while top >= 0:
                j = np.arange(max(0, top - 4095), top + 1)
                log = math.lgamma(b + 1) - np.array([math.lgamma(v + 1) + math.lgamma(b - v + 1) for v in j]) + j * math.log(p) + (b - j) * math.log1p(-p)
                terms = np.exp(log)
                total += float(terms.sum())
                if terms[0] * j[0] <= 1e-17 * total:  # terms fall below the mean, so what is left is less than this
                    break
                top -= 4096
            out[i] = min(1.0, total)
    return out


def _step(rule: str) -> Column:
    """The number of the first, most lenient, cutoff of a rule that rejects a document; the ladder's length where none does."""
    ladder = RULES[rule][1]
    out = F.lit(len(ladder))
    for k in range(len(ladder) - 1, -1, -1):
        out = F.when(rule_value(rule) > ladder[k], k).otherwise(out)
    return out


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified joint verdict; no row where a rule is off. Labels: doc_id, quality (1: good)."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("__id")).distinct()
    held = measured.filter("not base_failed").join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    held = held.select("stratum", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), *[_step(r).alias(r) for r in RULES])
    longest = max(len(ladder) for _, ladder in RULES.values())
    # how many documents of the first half a rule would reject at each step of its ladder, as numbers in one row per stratum
    steps = [F.count_if(F.col(r) <= k).alias(f"{r}_{k}") for r, (_, ladder) in RULES.items() for k in range(len(ladder))]
    first = held.filter("half = 0").groupBy("stratum").agg(F.count("*").alias("n"), *steps)
    # the last step within the rule's share; -1 for none
    chosen = [F.greatest(F.lit(-1), *[F.when(F.col(f"{r}_{k}") * len(RULES) <= risk * F.col("n"), k).otherwise(-1) for k in range(len(RULES[r][1]))]).alias(f"at_{r}") for r in RULES]
    proposed = stored(first.select("stratum", *chosen))
    # level t of the sequence: every rule longest - t steps back; a document is rejected from the level on at which its first rule does
    level = F.least(*[F.when(F.col(f"at_{r}") >= 0, longest - F.col(f"at_{r}") + F.col(r)).otherwise(2 * longest) for r in RULES])
    second = held.filter("half = 1").join(proposed, "stratum").select("stratum", level.alias("level"))
    counted = second.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("level") <= t).alias(f"k_{t}") for t in range(longest + 1)])
    tested = counted.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("level"), F.col(f"k_{t}").alias("k")) for t in range(longest + 1)])).alias("s")).select("stratum", "n", "s.*")

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(binomial_tail(k.to_numpy(), n.to_numpy(), risk))

    strata = stored(measured.select("stratum").distinct()).count()
    certified = tested.withColumn("tail", tail("k", "n")).filter(F.col("tail") <= delta / max(1, strata)).groupBy("stratum").agg(F.max("level").alias("level"))
    ladders = F.array(*[F.struct(F.lit(r).alias("rule"), (F.col(f"at_{r}") - (longest - F.col("level"))).alias("at"), F.array(*[F.lit(float(c)) for c in ladder]).alias("ladder")) for r, (_, ladder) in RULES.items()])
    of_rule = certified.join(proposed, "stratum").select("stratum", F.explode(ladders).alias("r")).filter("r.at >= 0")
    return of_rule.select("stratum", "r.rule", F.get("r.ladder", F.col("r.at")).alias("cutoff"))


def judge(measured: DataFrame, certified: DataFrame) -> DataFrame:
    """measured plus failed_rules (array) and kept."""
    per = certified.groupBy(F.col("stratum").alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    if per.count() <= 10_000:  # a map of at most len(RULES) numbers each
        per = F.broadcast(per)
    out = measured.join(per, F.col("stratum") == F.col("__s"), "left")
    failed = F.filter(F.array(*[F.when(rule_value(r) > F.col("__cut")[r], F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__s", "__cut")


def quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Every row of docs with its counts and verdict: doc_id, stratum, counts, base_failed, failed_rules, kept.

    Null, empty and blank texts have no words and fail the base rule. Labels for unknown
    documents and labels other than 1 are ignored; without labels only the base rule rejects. A
    document exactly at a cutoff stays. Rows that repeat a doc_id are judged each for itself. Texts of any length are
    read whole; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    measured = stored(measure(docs))
    return judge(measured, stored(cutoffs(measured, labels, risk, delta)))


def filter_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns.

    Rows are measured twice, once for the cutoffs without texts and once where they are judged; texts are never shuffled.
    """
    certified = stored(cutoffs(stored(measure(docs)), labels, risk, delta))
    return judge(measure(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row")), certified).filter("kept").select("row.*")
