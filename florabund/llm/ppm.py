"""Prediction by partial matching over bytes (Cleary and Witten 1984; escapes by method D, Howard and Vitter 1992).

Counts of byte contexts of up to ORDER bytes, from all training documents, form the trie as tables: one per order,
keyed by context. The probability of a symbol after a context comes from the longest context in
which it was seen; every longer one costs an escape, and symbols seen there are excluded below.
Because a symbol seen after a context was seen after its suffix, exclusion needs only two sums
per context, so it is a join of neighbouring orders.

Flow: documents are read once in blocks. A block gives its distinct ORDER+1 byte grams and words
with training counts, in packets by key range of a hash, and itself, compressed. The packets of
one range meet in a task, which sums them over all blocks; each distinct gram gets its code length;
each packet is answered with the values of its keys, and the block is scored with these answers
alone. So neither model nor vocabulary has to fit one machine, and no row is made per key and block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, stored, together

#: Bytes of the longest context; a gram of one more fits 64 bits up to 7.
ORDER = 5
BEGIN, END = 0xFE, 0xFF  # bytes that UTF-8 never has
GRAM, WORD, DISTINCT = 0, 1, 2
BLOCK_BYTES = 12 << 20
#: Bytes of all texts for each key range: its keys are about a twentieth as many.
RANGE_BYTES = 24 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER bytes before each byte and the end, and the byte, of all texts; where each text begins."""
    joined = b"".join(bytes([BEGIN]) * ORDER + t + bytes([END]) for t in texts)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    n = max(0, len(joined) - ORDER)
    # eight bytes from each place on as one number, of which the first ORDER + 1 stay
    eight = np.ndarray((n,), dtype=">u8", buffer=joined + bytes(8), strides=(1,))
    code = eight.astype(np.uint64) >> np.uint64(8 * (7 - ORDER))
    first = np.concatenate([[0], np.cumsum(size + ORDER)[:-1]])
    keep = np.ones(n, dtype=bool)
    for k in range(ORDER):  # windows that reach over the next text's beginning
        keep[first[1:] - ORDER + k] = False
    return code[keep].view(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]])


def word_keys(found: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64).view(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, dtype=np.int64)
    return k[new], np.add.reduceat(n, new) if len(new) else n


def _gram_counts(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts and how often they occur in training texts."""
    keys, counts = [], []
    for is_train in (True, False):
        part = [t for t, x in zip(texts, train, strict=True) if x == is_train]
        for some in together(part, 2 << 20):
            k, n = np.unique(grams(some)[0], return_counts=True)
            keys.append(k), counts.append(n.astype(np.int32) if is_train else np.zeros(len(n), dtype=np.int32))
    return _summed(keys, counts) if keys else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return np.mod(key ^ (key >> 23) ^ (key >> 41), ranges)


def in_ranges(key: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by range and key, and where each range begins in it."""
    of = range_of(key, ranges)
    order = np.lexsort((key, of))
    return order, np.searchsorted(of[order], np.arange(ranges + 1))


def _zip(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _unzip(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


class Numbers(dict):
    """word -> its number in order of appearance."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def _numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as numbers, and the keys by number."""
    numbers = Numbers()
    of = [np.fromiter(map(numbers.__getitem__, w), dtype=np.int32, count=len(w)) for w in map(bytes.split, texts)]
    return of, word_keys(list(numbers))


def _block_rows(ids: list, train: list[bool], texts: list[bytes], number: int, ranges: int) -> Iterator[pa.RecordBatch]:
    gram, n = _gram_counts(texts, train)
    of, key = _numbered(texts)
    learned = np.concatenate([o for o, x in zip(of, train, strict=True) if x] or [np.empty(0, dtype=np.int32)])
    times = np.bincount(learned, minlength=len(key))
    go, g = in_ranges(gram, ranges)
    wo, w = in_ranges(key, ranges)
    gram, n, key, times = gram[go], n[go].astype(np.uint32), key[wo], times[wo].astype(np.uint32)
    packets = [_zip((gram[g[k] : g[k + 1]], n[g[k] : g[k + 1]], key[w[k] : w[k + 1]], times[w[k] : w[k + 1]])) for k in range(ranges)]
    rows = [packets, [_zip((ids, train, texts))]]
    for first, blobs in zip((0, -1), rows, strict=True):
        m = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number, dtype=np.int64)), pa.array(np.arange(first, first + m, dtype=np.int32)), pa.array(blobs, type=pa.binary())], names=["block", "range", "blob"])


def read_blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(doc_id, text, train) -> block, range, blob: a packet per block and range, and the block itself as range -1."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0
        for b in batches:
            for i, t, is_train in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ids.append(i.as_py()), train.append(bool(is_train.as_py()))
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass").lower())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield from _block_rows(ids, train, texts, number, ranges)
                    ids, train, texts, size, number = [], [], [], 0, number + 1
                    give_back()
        if texts:
            yield from _block_rows(ids, train, texts, number, ranges)
        ids, train, texts = [], [], []
        give_back()

    return docs.select("doc_id", "text", "train").mapInArrow(blocks, "block long, range int, blob binary")


def _sum_range(packets: pa.Table) -> pa.Table:
    """Summed counts of the grams of a range; of its words the occurrences and the distinct ones in training."""
    parts = [_unzip(x.as_py()) for x in packets.column("blob")]
    gram, n = _summed([p[0] for p in parts], [p[1].astype(np.int64) for p in parts])
    _, times = _summed([p[2] for p in parts], [p[3].astype(np.int64) for p in parts])
    del parts
    give_back()
    kind = np.concatenate([np.full(len(gram), GRAM), [WORD, DISTINCT]]).astype(np.int32)
    return pa.table({"kind": pa.array(kind), "key": pa.array(np.concatenate([gram, [0, 0]])), "n": pa.array(np.concatenate([n, [times.sum(), (times > 0).sum()]]).astype(np.int64))})


def _answer_range(packets: pa.Table, values: pa.Table) -> pa.Table:
    """For each packet the values of its grams and the training counts of its words, in its order."""
    parts = [_unzip(x.as_py()) for x in packets.column("blob")]
    key, value = values.column("key").to_numpy(), values.column("value").to_numpy()
    order = np.argsort(key)
    key, value = key[order], value[order].astype(np.float32)
    word, times = _summed([p[2] for p in parts], [p[3].astype(np.int64) for p in parts]) if parts else (key, key)
    parts = [(p[0], p[2]) for p in parts]
    answers = [_zip((value[np.searchsorted(key, p[0])], times[np.searchsorted(word, p[1])])) for p in parts]
    del parts, key, value, order, word, times
    give_back()
    return pa.table({"block": packets.column("block"), "range": packets.column("range"), "answer": pa.array(answers, type=pa.binary())})


def code_lengths(counted: DataFrame) -> DataFrame:
    """counted(key, n) of distinct grams, n 0 for those not in training -> (key, value): log10 probability of the last byte after the others."""
    context = lambda k: F.expr(f"(key >> 8) & {(1 << 8 * k) - 1}L")
    seen = counted.filter("n > 0").select(F.expr(f"(key >> 8) & {(1 << 8 * ORDER) - 1}L").alias("c"), F.expr("cast(key & 255L as int)").alias("s"), "n")
    tables = {ORDER: stored(seen)}
    for k in range(ORDER - 1, -1, -1):
        tables[k] = stored(tables[k + 1].groupBy(F.expr(f"c & {(1 << 8 * k) - 1}L").alias("c"), "s").agg(F.sum("n").alias("n")))
    nodes = {}
    for k, t in tables.items():
        # total and distinct symbols of a context, and the count of those symbols one order below
        node = t.groupBy("c").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if k:
            low = t.select("c", "s", F.expr(f"c & {(1 << 8 * (k - 1)) - 1}L").alias("d")).join(tables[k - 1].select(F.col("c").alias("d"), "s", F.col("n").alias("m")), ["d", "s"])
            node = node.join(low.groupBy("c").agg(F.sum("m").alias("covered")), "c")
        else:
            node = node.withColumn("covered", F.col("total"))
        nodes[k] = stored(node)
    top = nodes[ORDER]
    known = counted.filter("n > 0").withColumn("c", context(ORDER)).join(top, "c").select("key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))
    # grams not in training go down the orders
    rows = counted.filter("n = 0").select("key", F.expr("cast(key & 255L as int)").alias("s"), F.lit(0.0).alias("value"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("out_kinds"), F.lit(0).cast("long").alias("out_total"))
    for k in range(ORDER, -1, -1):
        at = rows.withColumn("c", context(k)).join(nodes[k], "c", "left").join(tables[k], ["c", "s"], "left")
        total, kinds = F.col("total") - F.col("out_total"), F.col("kinds") - F.col("out_kinds")
        gain = F.when(F.col("done") | F.col("total").isNull() | (kinds <= 0), 0.0).when(F.col("n").isNotNull(), F.log10((F.col("n") - 0.5) / total)).otherwise(F.log10(kinds / (2 * total)))
        rows = at.select(
            "key", "s", (F.col("value") + gain).alias("value"), (F.col("done") | F.col("n").isNotNull()).alias("done"),
            F.coalesce("kinds", F.lit(0).cast("long")).alias("out_kinds"), F.coalesce("covered", F.lit(0).cast("long")).alias("out_total"),
        )
    last = F.when(F.col("done"), F.col("value")).otherwise(F.col("value") - F.log10(F.lit(256.0) - F.col("out_kinds")))
    return known.unionByName(rows.select("key", last.alias("value")))


class Lookup:
    """key -> value for many keys at once: a direct table by hash, the rest by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, int(len(keys) * 4).bit_length()))
        self.place = np.zeros(1 << int(64 - int(self.shift)), dtype=np.int32)
        self.place[self.slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place[self.slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at].astype(float)


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, train) -> a row each: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    A-Z lower-cased. score: log10 probability of the text's bytes and its end under the model of
    the rows with train true; base_score: that of its words and end under smoothed word counts.
    Null texts are empty: one end. Without training rows every symbol is uniform over 256.
    Repeated rows count and are scored each for itself; a null doc_id is scored like others. Texts of any length are read whole,
    other columns are ignored, whatever their names, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("train"), F.lit(False)).alias("train"))
    size, ends = docs.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    ranges = max(4, (size or 0) // RANGE_BYTES)
    blocks = stored(read_blocks(docs, ranges))
    packets = blocks.filter("range >= 0")
    counts = stored(packets.groupBy("range").applyInArrow(_sum_range, "kind int, key long, n long"))
    total, distinct = counts.agg(F.sum(F.when(F.col("kind") == WORD, F.col("n"))), F.sum(F.when(F.col("kind") == DISTINCT, F.col("n")))).first()
    total, distinct = (total or 0) + ends, (distinct or 0) + (ends > 0)
    below = math.log10(total + 0.1 * (distinct + 1))
    end_value = math.log10(ends + 0.1) - below
    values = code_lengths(counts.filter(f"kind = {GRAM}").select("key", "n"))
    values = values.select("key", "value", F.expr(f"cast(pmod(key ^ (key >> 23) ^ (key >> 41), {ranges}) as int)").alias("of"))
    answers = packets.groupBy("range").cogroup(values.groupBy("of")).applyInArrow(_answer_range, "block long, range int, answer binary")

    def one(answers: pa.Table, blob: pa.Table) -> pa.Table:
        ids, train, texts = _unzip(blob.column("blob")[0].as_py())
        by = [_unzip(a.as_py()) for _, a in sorted(zip(answers.column("range").to_pylist(), answers.column("answer"), strict=True), key=lambda x: x[0])]
        # grams and words in the order in which the packets held them
        gram = _gram_counts(texts, train)[0]
        look = Lookup(gram[in_ranges(gram, ranges)[0]], np.concatenate([a[0] for a in by]))
        of, key = _numbered(texts)
        count = np.empty(len(key), dtype=np.int64)
        count[in_ranges(key, ranges)[0]] = np.concatenate([a[1] for a in by])
        rows: dict[str, list] = {c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for part in together(texts, 1 << 20):
            codes, starts = grams(part)
            rows["score"] += np.add.reduceat(look(codes), starts).tolist()
        each = np.log10(count + 0.1) - below
        rows["n_tokens"] = [len(o) + 1 for o in of]
        rows["n_known"] = [int((count[o] > 0).sum()) + (ends > 0) for o in of]
        rows["base_score"] = [float(each[o].sum()) + end_value for o in of]
        rows["doc_id"], rows["train"], rows["train_tokens"] = ids, train, [total] * len(ids)
        del texts, by, gram, look, of, key, count, each, part, codes, starts
        give_back()
        return pa.table(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    texts = blocks.filter("range = -1").select(F.col("block").alias("of"), "blob")
    return answers.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(one, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
