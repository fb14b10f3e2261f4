"""Repeated passages: paragraphs that occur in several documents, exactly or nearly, by MinHash bands.

Paragraphs are the lines of a text and, since a passage may be pasted into the middle of a line or
run over several, its word windows: a window of WINDOW words begins wherever the hash of five
words is the least among SPACING neighbours (winnowing, Schleimer, Wilkerson and Aiken 2003), so
a passage has the same windows wherever it stands. A run of WINDOW + SPACING - 1 words that two texts
share holds a common window for certain.

Flow, the same for both kinds: (1) a paragraph gets few keys: a line as many of one MinHash row as
the recall wanted asks for, a window the hash of its first PREFIX words (of one changed word in so short a
window only those at the first two or the last two leave a similarity over 0.8: the last are met, the first are not). Keys that only one
document has are dropped by a partial aggregate, before any join and without a text. (2) Paragraphs that
share a key with other words meet in MinHash bands tuned to the recall, candidates are verified by
the exact Jaccard similarity of their word shingles, and links become components
(near_duplicates); equal paragraphs are one row there. (3) A component that two documents have is
a repeat; its paragraphs become spans, of which all but those in the first document go.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, stored, together
from .neardup import bands_for, mix, near_duplicates, short_signature

WINDOW, SPACING, SHINGLE, PREFIX = 24, 27, 5, 20
#: A span runs on over a gap of fewer words.
GAP = 5
#: Size of the MinHash sample for bands.
SAMPLE = 24
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_P), -1, 1 << 64)
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, 16, dtype=np.uint64)
_SALT = np.arange(1, 17, dtype=np.uint64) * _P
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.isin(np.arange(256), list(SPACE))
#: Bytes of a text hashed at once, or one longer word.
_BLOCK = 1 << 15
#: Bytes of texts that are cut to paragraphs together, or one longer text.
_TOGETHER = 1 << 16


def anchors(g: np.ndarray, spacing: int = SPACING, text: np.ndarray | None = None) -> np.ndarray:
    """Positions of the least value among any `spacing` neighbours; of equal values that follow each other within `spacing` the first.

    text: the number of the text of each word, of texts one after the other; values of SHINGLE words count inside one text only.
    """
    if len(g) < spacing:
        return np.empty(0, dtype=np.int64)

    def sliding(x: np.ndarray, f: np.ufunc) -> np.ndarray:
        wide, out = 1, x
        while 2 * wide <= spacing:
            out = f(out[:-wide], out[wide:])
            wide *= 2
        rest = spacing - wide
        return f(out[: len(out) - rest], out[rest:]) if rest else out

    low = sliding(g, np.minimum)
    if text is not None:
        low[text[: len(low)] != text[-len(low) :]] = 0  # reaches over the end of a text
    edge = np.zeros(spacing - 1, dtype=g.dtype)
    at = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), np.maximum) == g)  # the least of some window that holds it
    value = g[at]
    equal = value[1:] == value[:-1]
    if text is not None:
        equal &= text[at[1:]] == text[at[:-1]]
    if equal.any():
        keep, last = np.ones(len(at), dtype=bool), 0
        for k in (np.flatnonzero(equal) + 1).tolist():
            if keep[k - 1]:
                last = k - 1
            keep[k] = at[k] - at[last] >= spacing
        at = at[keep]
    return at


@functools.lru_cache(maxsize=64)
def _table(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, base, dtype=np.uint64)]))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; those of texts under 65,536 words are kept."""
    return _table(base, 1 << n.bit_length())[:n] if n < 1 << 16 else _table.__wrapped__(base, n)


def line_keys(threshold: float, recall: float) -> int:
    """Keys of one MinHash row with which a pair at the threshold shares one with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold) - 1e-9))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of the words of a text: sums of a value per byte times a power of its place in the word."""
    text = np.frombuffer(raw, dtype=np.uint8)
    solid = np.zeros(len(text) + 2, dtype=np.int8)
    solid[1:-1] = ~_IS_SPACE[text]
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _BLOCK, "right")))
        s, e = start[i:j] - base, end[i:j] - base
        size = int(e[-1])
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[text[base : base + size]] * powers(int(_P), size), out=total[1:])
        out[i:j] = (total[e] - total[s]) * powers(_INVERSE, size)[s]
        i = j
    return start, mix(out + (end - start).astype(np.uint64))


def named(h: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of word hashes a function that gives the codes of the words from x on and before y."""
    n = len(h)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h) * powers(int(_P), n + 1)[1:])])  # all unsigned: a signed zero would make them doubles
    inverse = powers(_INVERSE, n + 2)[1:]
    # prefix sums differ by the paragraph's sum times a power of its position; dividing by it (odd, so invertible) makes equal paragraphs equal
    return lambda x, y: mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64))


def paragraphs_of_all(texts: list[bytes], n_keys: int) -> tuple[np.ndarray, ...]:
    """(place of the text, key, first word in it, words, code), a row per key: the windows of all texts, then the lines of five words or more with n_keys each.

    code names the words of a paragraph. A text of fewer than five words has none. Short texts are
    looked at together, since numpy takes longer to be called than for their words.
    """
    raw = b"\n".join(texts).lower()
    at_byte, h = word_hashes(raw)
    n = len(h)
    if n < SHINGLE:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    line = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)])
    first = np.searchsorted(at_byte, line)  # no word begins at a line feed
    size = np.diff(first, append=n)
    begin = np.searchsorted(at_byte, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]))
    words = np.diff(begin, append=n)
    text = np.repeat(np.arange(len(texts)), words)
    g = h[: n - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        g = g * _P + h[k : n - SHINGLE + 1 + k]
    g = mix(g + np.uint64(SHINGLE))
    at = np.union1d(begin[words >= SHINGLE], anchors(g, text=text))
    last = (begin + words)[text[at]]
    end = np.minimum(at + WINDOW, last)
    long = size >= SHINGLE
    a, b = first[long], (first + size)[long]
    code_of_words = named(h)
    keys, line_codes = [code_of_words(at, np.minimum(at + PREFIX, last))], []
    if len(a):
        inside = np.column_stack([a, b - SHINGLE + 1]).ravel()  # the last one may be the end of g, which reduceat does not take
        padded = np.append(g, np.uint64(2**64 - 1))
        keys += [mix(np.minimum.reduceat((padded ^ _B[k]) * _A[k], inside)[::2] + _SALT[k]) for k in range(n_keys)]
        line_codes = [code_of_words(a, b)] * n_keys
    start = np.concatenate([at] + [a] * n_keys)
    stop = np.concatenate([end] + [b] * n_keys)
    code = np.concatenate([code_of_words(at, end), *line_codes])
    place = text[start]
    return place, np.concatenate(keys).view(np.int64), start - begin[place], stop - start, code.view(np.int64)


def paragraphs_of(text: str, n_keys: int) -> tuple[np.ndarray, ...]:
    """(key, first word, words, code) of paragraphs_of_all() for one text."""
    return paragraphs_of_all([text.encode("utf-8", "surrogatepass")], n_keys)[1:]


def paragraphs(docs: DataFrame, n_keys: int) -> DataFrame:
    """docs(doc_id, text) -> paragraphs_of() each text: key, doc_id, start, n_words, code."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held, seen = 0, 0
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in together((t.as_py() or b"" for t in batch.column(1).cast(pa.binary())), _TOGETHER):
                place, key, start, n, code = paragraphs_of_all(part, n_keys)
                out.append((key, ids[seen + place], start.astype(np.int32), n.astype(np.int32), code))
                held, seen = held + len(key), seen + len(part)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)
                    out, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("code", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(cut, "key long, doc_id long, start int, n_words int, code long")


def codes_of(paragraphs: list[bytes]) -> np.ndarray:
    """The codes that paragraphs_of() gives paragraphs of these words, A-Z lower-cased."""
    at_byte, h = word_hashes(b"\n".join(paragraphs))
    begin = np.searchsorted(at_byte, np.cumsum([0, *(len(p) + 1 for p in paragraphs)]))
    return named(h)(begin[:-1], begin[1:]).view(np.int64)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted) -> the paragraphs of a text at the wanted places, under their code; a place that holds other words (a repeated doc_id) gives none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    for batch in batches:
        wanted = batch.column(1)
        code, start, n = (wanted.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("code", "start", "n_words"))
        edge = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        ends = (start + n).tolist()
        starts = start.tolist()
        ids, cuts, held = [], [], 0
        for k, text in enumerate(batch.column(0).cast(pa.binary())):
            found = (text.as_py() or b"").lower().split()
            cut = [b" ".join(found[i:j]) for i, j in zip(starts[edge[k] : edge[k + 1]], ends[edge[k] : edge[k + 1]], strict=True)]
            right = np.flatnonzero((codes_of(cut) == code[edge[k] : edge[k + 1]]) & np.array([len(x) > 0 for x in cut]))
            ids.append(code[edge[k] + right])
            cuts += [cut[i].decode("utf-8", "replace") for i in right.tolist()]
            held += len(right)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(cuts, pa.string())], schema=schema)
                ids, cuts, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(cuts, pa.string())], schema=schema)


def spans_of(doc: int, start: np.ndarray, n_words: np.ndarray, cluster: np.ndarray, lo: np.ndarray, min_words: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, cluster, first document) of the spans of one document; its repeated paragraphs come in order of start.

    Neighbouring paragraphs are a run, and a run of min_words or more is reported in parts of one
    verdict each. Words of any paragraph that has its first copy here stay, so a component never
    loses that copy to another one; the other words go. A part is named after its longest paragraph.
    """
    end = start + n_words
    reach = np.maximum.accumulate(end)
    begin = np.concatenate([[0], np.flatnonzero(start[1:] >= reach[:-1] + GAP) + 1, [len(start)]])
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        base, size = int(start[a]), int(reach[b - 1] - start[a])
        if size < min_words:
            continue
        runs = list(zip((start[a:b] - base).tolist(), (end[a:b] - base).tolist(), cluster[a:b].tolist(), lo[a:b].tolist(), strict=True))
        stays = np.zeros(size, dtype=np.int8)
        for s, e, _, first in runs:
            if first != doc:
                stays[s:e] = 1
        for s, e, _, first in runs:
            if first == doc:
                stays[s:e] = 2
        edge = np.concatenate([[0], np.flatnonzero(stays[1:] != stays[:-1]) + 1, [size]]).tolist()
        parts: list[list[int]] = []  # first word, end, verdict
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            verdict = int(stays[s])
            if verdict and parts and parts[-1][2] == verdict:
                parts[-1][1] = e  # over a gap
            elif verdict:
                parts.append([s, e, verdict])
        firsts = [p[0] for p in parts]
        best: dict[int, tuple] = {}
        for s, e, name, first in runs:
            at = max(0, bisect.bisect_right(firsts, s) - 1)
            while at < len(parts) and parts[at][0] < e:
                if parts[at][1] > s and (parts[at][2] == 2) == (first == doc):
                    best[at] = max(best.get(at, (0,)), (e - s, -first, -s, name))
                at += 1
        out += [(base + s, e - s, best[at][3], -best[at][1]) for at, (s, e, _) in enumerate(parts)]
    return out


def _spans(min_words: int):
    @F.pandas_udf("array<struct<start_word: long, n_words: long, cluster: long, first_doc_id: long>>")
    def spans(doc: pd.Series, start: pd.Series, n_words: pd.Series, cluster: pd.Series, lo: pd.Series) -> pd.Series:
        names = ("start_word", "n_words", "cluster", "first_doc_id")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in spans_of(*row, min_words)] for row in zip(doc, start, n_words, cluster, lo, strict=True)])

    return spans


def linked_paragraphs(docs: DataFrame, percent: int = 80, recall: float = 0.99) -> DataFrame:
    """doc_id, start, n_words, code, cluster of the paragraphs of docs(doc_id, text) that share a key with another document.

    cluster is the component of a paragraph: the least code it is linked to, over chains of links.
    Two lines at the similarity `percent` share a key, and then a band, with probability `recall` each, more alike ones more surely;
    equal paragraphs are always linked (64-bit codes stand for their words).
    """
    keyed = stored(paragraphs(docs, line_keys(percent / 100, recall)))
    of_key = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("code").alias("one"), F.max("code").alias("other"))
    shared = stored(of_key.filter("lo < hi").select("key", (F.col("one") < F.col("other")).alias("mixed")))
    found = stored(keyed.join(shared.hint("shuffle_hash"), "key"))  # distinct keys, so its parts are even; rows need no sort
    discard(keyed)
    discard(shared)
    # paragraphs of different words under one key, each once, cut out of the first text that has it
    once = found.filter("mixed").groupBy("code").agg(F.min(F.struct("doc_id", "start", "n_words")).alias("at")).select("code", "at.*")
    wanted = stored(once.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("code", "start", "n_words")).alias("wanted")))
    texts = stored(docs.join(wanted, docs["doc_id"] == wanted["id"]).select("text", "wanted").mapInArrow(_cut_out, "doc_id long, text string"))
    _, width = bands_for(percent / 100, recall, SAMPLE)
    alike = near_duplicates(texts, percent, SAMPLE, width, short_signature, short=True).filter("not kept").select(F.col("doc_id").alias("code"), F.col("component_id").alias("to")).distinct()
    places = found.select("doc_id", "start", "n_words", "code").distinct()
    return places.join(stored(alike), "code", "left").withColumn("cluster", F.coalesce("to", "code")).drop("to")


def repeated_passages(docs: DataFrame, min_words: int = 16, percent: int = 80, recall: float = 0.99) -> DataFrame:
    """A row per repeated span of docs(doc_id, text): doc_id, start_word, n_words, cluster, first_doc_id, removed.

    Counted in words [^\\x20\\x09-\\x0D]+, A-Z lower-cased. A span has one verdict (see spans_of).
    cluster names the component of its longest paragraph; first_doc_id is the smallest document with
    that paragraph; removed is true in all others. Every component keeps the copy in its first document.
    Runs of fewer than min_words words have no row, nor have documents without a repeat, null, empty or blank texts and
    those under five words. Rows that repeat a doc_id are one document, and repeats inside one document alone do
    not count. Rows with a null doc_id have no row, since no copy could be named by it. An empty
    table gives no rows; other columns are ignored, whatever their names; texts of any length are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    named = stored(linked_paragraphs(docs, percent, recall))
    first = named.groupBy("cluster").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi")
    hit = named.join(first, "cluster").select("doc_id", "start", "n_words", "cluster", "lo")
    near = F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "cluster", "lo"))).alias("ps")
    of_doc = stored(hit.groupBy("doc_id").agg(near)).select("doc_id", F.explode(_spans(min_words)("doc_id", "ps.start", "ps.n_words", "ps.cluster", "ps.lo")).alias("s"))
    return of_doc.select("doc_id", "s.*").withColumn("removed", F.col("doc_id") != F.col("first_doc_id"))
