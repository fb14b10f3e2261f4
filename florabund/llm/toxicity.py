"""Toxicity by non-negative positive-unlabelled learning (Kiryo, Niu, du Plessis and Sugiyama 2017).

Features are the hashed words of a text and their four-letter beginnings, present or not.
Confirmed toxic documents are the positives; any documents are the unlabelled rest. The risk is
prior * E_P[l(f, 1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)]); where the second part turns
negative, a step raises it instead. Several numpy classifiers are trained, each in a Spark task with all
sampled positives and its own part of the sampled rest, and their logits averaged. Training uses a bounded sample (documented
parameters); scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vectorized

BITS = 18
_DROP = bytes(c for c in range(128) if not (97 <= c <= 122 or c in b" \t\n\x0b\x0c\r"))


def word_features(word: bytes) -> tuple[int, ...]:
    size = (1 << BITS) - 1
    head = word.decode("utf-8", "ignore")[:4].encode()
    return (zlib.crc32(word) & size, zlib.crc32(b"^" + head) & size)


def vocabulary_of(text: str | None) -> set[bytes]:
    """Distinct words of a text without signs and digits, A-Z lower-cased."""
    return set(text.encode("utf-8", "surrogatepass").lower().translate(None, _DROP).split()) if text else set()


@vectorized("array<int>")
def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[bytes, tuple[int, ...]] = {}
    for texts in batches:
        out = []
        for t in texts:
            if len(known) > 300_000:
                known.clear()
            ids = set()
            for w in vocabulary_of(t):
                f = known.get(w)
                if f is None:
                    f = known[w] = word_features(w)
                ids.update(f)
            out.append(np.fromiter(ids, dtype=np.int32, count=len(ids)))
        yield pd.Series(out)


def select_features(lists: list[np.ndarray], positive: np.ndarray, most: int) -> np.ndarray:
    """Features whose share among the positives lies most standard errors above that among the rest, three at least."""
    size = 1 << BITS
    p, u = np.zeros(size), np.zeros(size)
    for ids, is_p in zip(lists, positive, strict=True):
        (p if is_p else u)[ids] += 1
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    mean = (p + u) / (n_p + n_u)
    z = (p / n_p - u / n_u) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n_p + 1 / n_u))
    top = np.argsort(-z, kind="stable")[:most]
    return np.sort(top[(z[top] > 3) & (p[top] >= 3)])


def risk_step(f: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """What to descend by each row's logit f under the non-negative risk (Kiryo and others 2017) with logistic loss l.

    The gradient of prior * E_P[l(f, 1)] + rest, where rest = E_U[l(f, -1)] - prior * E_P[l(f, -1)] estimates the risk of the
    negatives; where that is below zero, it overfits, and the step is up its gradient alone.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    s = 1 / (1 + np.exp(-f))
    loss = np.logaddexp(0, f)  # l(f, -1)
    up = np.where(positive, -prior * (1 - s) / n_p, 0.0)  # of prior * E_P[l(f, 1)]
    down = np.where(positive, -prior * s / n_p, s / n_u)  # of rest
    rest = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
    alone = positive.all() or not positive.any()
    return up + down if rest >= 0 or alone else -down


def fit(lists: list[np.ndarray], positive: np.ndarray, prior: float, features: int = 1024, steps: int = 600, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights, bias) of a linear classifier with logistic loss under the non-negative risk."""
    chosen = select_features(lists, positive, features)
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    # present features as (row, place) pairs; the last weight is the bias
    found = [place[ids] for ids in lists]
    found = [at[at >= 0] for at in found]
    row = np.repeat(np.arange(len(lists)), [len(at) for at in found])
    at = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    w = np.zeros(len(chosen) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(of_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at, weights=of_row[row], minlength=len(chosen)), of_row.sum())

    for t in range(1, steps + 1):
        f = np.clip(np.bincount(row, weights=w[at], minlength=len(lists)) + w[-1], -40, 40)
        g = gradient(risk_step(f, positive, prior)) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return chosen, w[:-1], float(w[-1])


def train(docs: DataFrame, positives: DataFrame, prior: float, bags: int = 4, max_positive: int = 6000, max_unlabelled: int = 16_000) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Classifiers from docs(doc_id, text): max_positive of positives(doc_id) and max_unlabelled of all of docs, the least hashes of either.

    The models that come back have at most 1024 weights each. Of rows with the same hash the smaller doc_id comes first;
    rows that repeat a doc_id come in together, so each has a weight. Without positives the models have no
    features and call nothing toxic; without documents there are no models.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    p = positives.select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive).withColumn("positive", F.lit(True))
    u = docs.select("doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(6)), "doc_id").limit(max_unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(p.union(u))  # at most max_positive + max_unlabelled ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("positive", "doc_id", hashed("text").alias("ids"))
    of = F.when(F.col("positive"), F.array(*map(F.lit, range(bags)))).otherwise(F.array(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(bags)).cast("int")))
    rows = rows.select("positive", F.explode(of).alias("bag"), "ids")

    def one(bag: pd.DataFrame) -> pd.DataFrame:
        ids, w, b = fit([np.asarray(x, dtype=np.int64) for x in bag.ids], bag.positive.to_numpy(bool), prior)
        return pd.DataFrame({"ids": [ids.astype("<i4").tobytes()], "w": [w.astype("<f8").tobytes()], "b": [b]})

    got = rows.groupBy("bag").applyInPandas(one, "ids binary, w binary, b double").collect()
    return [(np.frombuffer(r.ids, "<i4"), np.frombuffer(r.w, "<f8"), r.b) for r in sorted(got, key=lambda r: (bytes(r.ids), r.b))]


def toxicity(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, score from 0 to 1.

    Null and empty texts get the score of no features; without models all scores are 0. Repeated rows, and those without a doc_id,
    are scored each for itself, texts of any length whole; other columns are ignored, whatever their names, and an empty table gives no rows.
    """
    weights = np.zeros(1 << BITS, dtype=np.float32)
    bias = sum(b for _, _, b in models) / max(1, len(models))
    for ids, w, _ in models:
        weights[ids] += (w / len(models)).astype(np.float32)
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((dict(zip(used.tolist(), weights[used].tolist(), strict=True)), bias, bool(models)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias, trained = sent.value
        known: dict[bytes, tuple[int, ...]] = {}
        for texts in batches:
            out = []
            for t in texts:
                if len(known) > 300_000:
                    known.clear()
                hit = set()
                for w in vocabulary_of(t):
                    f = known.get(w)
                    if f is None:
                        f = known[w] = tuple(x for x in word_features(w) if x in weight)
                    if f:
                        hit.update(f)
                logit = bias + sum(weight[x] for x in sorted(hit))
                out.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))) if trained else 0.0)
            yield pd.Series(out, dtype="float64")

    return docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))


def prior_of(labels: DataFrame) -> float:
    """Share of toxic rows among labels(toxic); 0.1 without labels."""
    r = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return min(0.5, max(0.001, r)) if r is not None else 0.1
