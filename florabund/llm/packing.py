"""Packing of token sequences by cutting-stock column generation (Gilmore and Gomory 1961).

Documents become token ids; ids are cut at the sequence length, so at most one piece of a
document is shorter. Piece lengths are counted per class of `grain` tokens: a histogram of at
most seq_len / grain rows, whatever the corpus. On that histogram the driver solves the linear
program over cutting patterns: a knapsack dynamic program prices new columns, a simplex step
with an updated inverse of the basis brings them in. Rounded-down pattern counts are filled up by best-fit
decreasing over what is left. Pieces are ranked inside their class in a distributed way (rank
within a hash slice plus the counts of earlier slices) and a range join on that rank gives each
piece its sequence, so no document passes through the driver and no class through one task.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, tidy, vectorized
from .wordpiece import byte_table

#: Distinct words kept in a worker's memory with their ids; the memory is emptied when full.
CACHE_WORDS = 250_000
#: Slices of a class that are ranked apart; a fixed number, so that the places do not depend on the session.
SLICES = 64
#: Words for which lower-casing, composition and the split into letters, digits and signs are the same in Python and in the tokenizer.
PLAIN = re.compile("[\\x21-\\x7e\u00c0-\u012f\u0131-\u024f]+")


class MergeRanks:
    """The same byte pair merges by tiktoken, which is several times faster on single words.

    Merges become ranks of byte strings; the end of a word is a byte of its own that joins the last
    byte before any other merge. Only for vocabularies with an end-of-word suffix, lower case and a
    single split pattern; others, and words that are not PLAIN, are left to the tokenizer.
    """

    END, NEXT = "\x01", "\x02"

    def __init__(self, model: dict):
        import tiktoken

        table, suffix = byte_table(), model["model"]["end_of_word_suffix"]

        def raw(piece: str) -> bytes:
            ends = piece.endswith(suffix)
            return bytes(table[c] for c in (piece[: -len(suffix)] if ends else piece)) + self.END.encode() * ends

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks.setdefault(bytes([b]) + self.END.encode(), len(ranks))
        for merge in model["model"]["merges"]:
            one, two = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(one) + raw(two), len(ranks))
        ids = {raw(p): i for p, i in model["model"]["vocab"].items() if all(c in table for c in p)}
        self.ids = np.array([ids.get(k, 0) for k in ranks], dtype="<u4")  # in the order of ranks
        self.stop = ranks[self.NEXT.encode() + self.END.encode()]
        self.split = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.encoding = tiktoken.Encoding("merges", pat_str=rf"[^{self.END}]*{self.END}", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> MergeRanks | None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        try:
            steps = [n["type"] for n in model["normalizer"]["normalizers"]]
            pre = [p["type"] for p in model["pre_tokenizer"]["pretokenizers"]]
            fits = steps == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and model["model"]["end_of_word_suffix"]
        except (KeyError, TypeError):
            fits = False
        return cls(model) if fits else None

    def encode(self, found: list[str]) -> list[bytes]:
        pieces = self.split.findall(f" {self.NEXT} ".join(found).lower())
        ranks = np.array(self.encoding.encode_ordinary(self.END.join(pieces) + self.END))
        stops = np.flatnonzero(ranks == self.stop)
        raw = self.ids[ranks].tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(stops + 1).tolist()], [*stops.tolist(), len(ranks)], strict=True)]


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, asked of the tokenizer once.

    Holds for tokenizers that drop white space and never join across it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), MergeRanks.of(path)

    def learn(self, unseen: list[bytes]) -> None:
        if len(self) + len(unseen) > CACHE_WORDS:
            self.clear()
        for at in range(0, len(unseen), 5000):
            slow = []
            fast = []
            for w in unseen[at : at + 5000]:
                t = w.decode("utf-8", "surrogatepass")
                (fast if self.merges and "<|" not in t and PLAIN.fullmatch(t) else slow).append((w, t))
            if fast:
                self.update(zip([w for w, _ in fast], self.merges.encode([t for _, t in fast]), strict=True))
            for (w, _), e in zip(slow, self.tokenizer.encode_batch([t for _, t in slow], add_special_tokens=False), strict=True):
                self[w] = np.array(e.ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        found = text.encode("utf-8", "surrogatepass").split() if text else []
        out = list(map(self.get, found))
        if None in out:
            self.learn(list({w for w, v in zip(found, out, strict=True) if v is None}))
            out = list(map(self.get, found))
            if None in out:  # emptied meanwhile
                self.learn(list(set(found)))
                out = list(map(self.get, found))
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, kept from task to task."""
    return WordIds(path)


def tokenize(docs: DataFrame, tokenizer: str, seq_len: int = 4096, end_id: int = 2, narrow: bool = False) -> DataFrame:
    """docs(doc_id, text) -> a row per piece: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit).

    narrow: pieces whose ids are all below 65,536 have them in 16 bits; widened() undoes that. Null and
    empty texts give the end id alone. Repeated doc_ids give pieces each. Texts of any length are read
    whole and cut. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    width = 4 * seq_len
    end = np.array([end_id], dtype="<u4").tobytes()

    @tidy
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "start": [], "length": [], "doc_tokens": [], "ids": []}
            held = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.ids(text.as_py()) + end
                for at in range(0, len(ids), width):
                    part = np.frombuffer(ids[at : at + width], dtype="<u4")
                    small = part.astype("<u2") if narrow and part.max() < 1 << 16 else part
                    for k, v in zip(rows, (i, at // 4, len(part), len(ids) // 4, small.tobytes()), strict=True):
                        rows[k].append(v)
                    held += small.nbytes
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows, held = {k: [] for k in rows}, 0
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary")


@vectorized("binary")
def widened(ids: pd.Series, length: pd.Series) -> pd.Series:
    """ids of narrow pieces as 32-bit ones."""
    return pd.Series([x if len(x) == 4 * n else np.frombuffer(x, dtype="<u2").astype("<u4").tobytes() for x, n in zip(ids, length, strict=True)])


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best unbounded knapsack: the value and how many of each size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fit = np.flatnonzero(sizes <= r)
        best[r], took[r] = best[r - 1], -1
        if len(fit):
            v = best[r - sizes[fit]] + prices[fit]
            k = int(v.argmax())
            if v[k] > best[r] + 1e-12:
                best[r], took[r] = v[k], fit[k]
    counts, r = np.zeros(len(sizes), dtype=np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            counts[took[r]] += 1
            r -= sizes[took[r]]
    return float(best[room]), counts


def cutting_plan(histogram: dict[int, int], room: int, max_columns: int = 3000) -> list[tuple[int, dict[int, int]]]:
    """histogram: size -> count. Patterns (times, {size: count}) that hold every item exactly once, each within room."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([histogram[int(s)] for s in sizes], dtype=np.float64)
    columns = np.diag(room // sizes).astype(float)  # start: as many of one size as fit
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ need
    for _ in range(max_columns):
        value, column = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ok = d > 1e-10
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        k = int(ratio.argmin())
        step = max(0.0, ratio[k])
        x = x - step * d
        x[k] = step
        columns[:, k] = column
        row = inverse[k] / d[k]
        inverse = inverse - np.outer(d, row)
        inverse[k] = row
    plan, left = [], need.astype(np.int64)
    for k in np.argsort(-x):
        column = np.rint(columns[:, k]).astype(np.int64)
        used = column > 0
        times = int(min(np.floor(x[k] + 1e-6), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((times, {int(s): int(c) for s, c in zip(sizes[used], column[used], strict=True)}))
            left -= times * column
    open_bins: dict[int, list[dict[int, int]]] = {}
    for s, n in zip(sizes[::-1], left[::-1], strict=True):
        for _ in range(int(n)):
            r = next((r for r in range(int(s), room + 1) if open_bins.get(r)), None)
            held = open_bins[r].pop() if r is not None else {}
            held[int(s)] = held.get(int(s), 0) + 1
            open_bins.setdefault((room if r is None else r) - int(s), []).append(held)
    same: dict[tuple, int] = {}
    for held in itertools.chain.from_iterable(open_bins.values()):
        key = tuple(sorted(held.items()))
        same[key] = same.get(key, 0) + 1
    return plan + [(n, dict(key)) for key, n in same.items()]


def assign(pieces: DataFrame, seq_len: int = 4096, grain: int = 16) -> DataFrame:
    """pieces(doc_id, start, length, ...) -> the same columns with sequence_id and offset, sequences filled up to seq_len.

    `pieces` is read several times, so store it first. Only the histogram over classes
    (at most seq_len / grain rows) reaches the driver. Pieces of one class take places in the order of a hash slice, then
    doc_id and start; rows that repeat both take neighbouring places. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    room = seq_len // grain
    sized = pieces.withColumn("__class", F.ceil(F.col("length") / grain).cast("int")).withColumn("__slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SLICES)).cast("int"))
    counts = stored(sized.groupBy("__class", "__slice").agg(F.count("*").alias("__n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("__class").agg(F.sum("__n")).collect()}
    plan = cutting_plan(histogram, room)
    used, rows, first = dict.fromkeys(histogram, 0), [], 0
    for times, held in plan:
        for size in sorted(held, reverse=True):
            rows.append((size, used[size], used[size] + times * held[size], held[size], first))
            used[size] += times * held[size]
        first += times
    slots = spark.createDataFrame(pd.DataFrame(rows, columns=["__class", "__from", "__to", "__each", "__first"]) if rows else [], "__class int, __from long, __to long, __each long, __first long")
    before = counts.select("__class", "__slice", F.coalesce(F.sum("__n").over(Window.partitionBy("__class").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = sized.withColumn("__in", F.row_number().over(Window.partitionBy("__class", "__slice").orderBy("doc_id", "start")) - 1)
    # both small tables have a bound in the class count: classes x slices, and patterns x classes
    ranked = ranked.join(F.broadcast(before), ["__class", "__slice"]).withColumn("__rank", F.col("__in") + F.col("__before"))
    placed = ranked.join(F.broadcast(slots), (ranked["__class"] == slots["__class"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).drop(slots["__class"])
    placed = placed.withColumn("sequence_id", F.col("__first") + F.expr("(__rank - __from) div __each"))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    return placed.select(*pieces.columns, F.col("sequence_id").cast("long"), "offset")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 4096, end_id: int = 2, grain: int = 16) -> DataFrame:
    """Token pieces of all docs with their ids and their place: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Null and empty texts give the end id alone; rows that repeat a doc_id, or have none, are packed each for itself; texts of any length are read whole; other columns are
    ignored, whatever their names. An empty table gives no pieces. Every id of every document lies in exactly one piece.
    """
    pieces = stored(tokenize(docs, tokenizer, seq_len, end_id, narrow=True).withColumn("piece", F.monotonically_increasing_id()))
    placed = assign(pieces.drop("ids"), seq_len, grain)  # ids are shuffled once, not with every step of the plan
    return placed.join(pieces.select("piece", "ids"), "piece").select("doc_id", "start", "length", "doc_tokens", widened("ids", "length").alias("ids"), "sequence_id", "offset")
