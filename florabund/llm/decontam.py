"""Benchmark decontamination by seeds on diagonals and exact edit distance.

Keys of whole windows, as of a CGK embedding, meet at few edits only (figures are in the README): at
a fifth of the length a key that still meets is so short that it meets everything. So an item is
sought by its grams: the runs of characters that edits leave whole lie, in a passage taken from it, on
neighbouring diagonals (place in the text less place in the item). Diagonals are counted in bins of BIN; where
two neighbouring bins hold enough grams of an item, and enough of them follow each other in text and item alike, the exact edit
distance of the whole item to the text there decides. How many are enough follows from the share of edits that is accepted, so
that recall is the same promise at every share up to it, for edits at random places and for even ones: at every seventh
character a gram of six is left between any two. Everything is counted in characters.

Documents are only mapped, so nothing is shuffled. Items are a stated list, taken in blocks that
are broadcast.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, together

#: Edits that are accepted, as a share of an item's length: less than one at every sixth character, which would leave no gram of six whole.
SHARE = 0.16
#: Items that are broadcast at once; a longer list is taken in blocks of this many by hash.
ITEMS_AT_ONCE = 20_000
#: (least length of an item, characters of its grams); a shorter one takes the longest gram that some accepted edit leaves whole for sure.
GRAMS = ((64, 6), (24, 4))
#: Diagonals counted together.
BIN_BITS = 5
BIN = 1 << BIN_BITS
#: An item is checked where this share of the grams expected at the most edits is found.
ENOUGH = 0.3
#: Bytes of text taken together, so that numpy works on long arrays that fit the processor's cache.
TOGETHER = 1 << 18
TABLE_BITS = 20
#: Counts of bins that are held at once.
COUNT_BITS = 19
_MULT = np.uint64(0x9E3779B97F4A7C15)


def clean(text: str | None) -> bytes:
    """Lower case, one space between words."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) if text else b""


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_of(length: int, share: float) -> tuple[int, int]:
    """(characters of a gram, grams to be found) for an item of that length."""
    for least, q in GRAMS:
        if length >= least:
            return q, max(2, int(ENOUGH * (1 - share) ** q * (length - q + 1)))
    return max(1, length // (int(share * length) + 1)), 1  # one of edits + 1 parts is whole


def slots(text: np.ndarray, q: int) -> np.ndarray:
    """Place in a table of 2**TABLE_BITS of every gram of q characters."""
    n = max(0, len(text) - q + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        h += text[k : k + n]
        h *= _MULT
        h ^= h >> np.uint64(32)
    return ((h * _MULT) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any part of text, and where the first best part ends (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def chain(places: np.ndarray, offsets: np.ndarray) -> int:
    """Grams in the longest chain of hits that go on in the text and in the item alike; those of a passage taken from the item all lie on one."""
    ends: list[int] = []
    for k in offsets[np.lexsort((-offsets, places))].tolist():
        at = bisect_left(ends, k)
        if at == len(ends):
            ends.append(k)
        else:
            ends[at] = k
    return len(ends)


class Items:
    """Grams of a block of items, ready to look up."""

    def __init__(self, items: list[tuple[int, bytes]], share: float):
        self.ids, self.share = [i for i, _ in items], share
        self.texts = [decoded(raw) for _, raw in items]
        self.sizes = [len(raw) for _, raw in items]
        self.longest = max(map(len, self.texts), default=0)
        self.off_bits = self.longest.bit_length()
        by_q: dict[int, list[int]] = {}
        self.enough = np.zeros(len(items), dtype=np.int64)
        for n, t in enumerate(self.texts):
            q, self.enough[n] = gram_of(len(t), share)
            by_q.setdefault(q, []).append(n)
        self.tables = []
        for q, members in sorted(by_q.items()):
            grams = [slots(codes(self.texts[n]), q) for n in members]
            slot = np.concatenate(grams)
            owner = np.repeat(members, [len(g) for g in grams])
            off = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(slot, kind="stable")
            count = np.bincount(slot, minlength=1 << TABLE_BITS).astype(np.int32)
            self.tables.append((q, count, (np.cumsum(count) - count).astype(np.int32), owner[order], off[order]))

    def places(self, text: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item number, least and greatest diagonal) where an item may be; documents begin at `first`."""
        diagonal_bits = (len(text) + self.longest).bit_length()
        found = []
        for q, count, start, owner, off in self.tables:
            slot = slots(text, q)
            n = count.take(slot)
            at = np.flatnonzero(n)
            at = at[np.argsort(-n[at].astype(np.int16), kind="stable")]  # places of many grams first
            n, first_of, shifted = n[at], start.take(slot[at]), at << self.off_bits
            # item, diagonal, place in the item, less the place in the text
            base = (owner << (diagonal_bits + self.off_bits)) + ((self.longest - off) << self.off_bits) + off
            for k in range(int(n.max(initial=0))):
                m = int(np.searchsorted(-n, -k, side="left"))  # places with more than k
                hits = base.take(first_of[:m] + k)
                hits += shifted[:m]
                found.append(hits)
        hits = np.sort(self._crowded(np.concatenate(found), diagonal_bits)) if found else np.empty(0, dtype=np.int64)
        if not len(hits):
            return []
        cell = hits >> (self.off_bits + BIN_BITS)
        edge = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        n, cell = np.diff(edge), cell[edge[:-1]]
        pair = (cell[1:] == cell[:-1] + 1) & (n[1:] + n[:-1] >= self._enough(cell[1:], diagonal_bits))
        high = n >= self._enough(cell, diagonal_bits)
        high[1:] |= pair
        high[:-1] |= pair
        hits = hits[np.repeat(high, n)]
        owner = hits >> (self.off_bits + diagonal_bits)
        diagonal = ((hits >> self.off_bits) & ((1 << diagonal_bits) - 1)) - self.longest
        offset = hits & ((1 << self.off_bits) - 1)
        doc = np.searchsorted(first, diagonal + offset, "right") - 1
        order = np.lexsort((diagonal, owner, doc))
        owner, diagonal, doc, offset = owner[order], diagonal[order], doc[order], offset[order]
        if not len(owner):
            return []
        new = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (diagonal[1:] > diagonal[:-1] + BIN)
        edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(owner)]])
        a, b = edge[:-1], edge[1:]
        run = np.repeat(np.arange(len(a)), b - a)
        # grams of the item, and places of the text, that are hit: a syllable that comes again and again is one
        grams = np.bincount(np.unique(run << self.off_bits | offset) >> self.off_bits, minlength=len(a))
        full = (b - a >= self.enough[owner[a]]) & (grams >= self.enough[owner[a]])
        out = []
        for x, y in zip(a[full].tolist(), b[full].tolist(), strict=True):
            if chain(diagonal[x:y] + offset[x:y], offset[x:y]) >= self.enough[owner[x]]:
                out.append((int(doc[x]), int(owner[x]), int(diagonal[x]), int(diagonal[y - 1])))
        return out

    def _crowded(self, hits: np.ndarray, diagonal_bits: int) -> np.ndarray:
        """The hits of bins that may hold enough with a neighbour: by a table of counts in which bins share places, so that none is lost and few others stay to be sorted."""
        cell = hits >> (self.off_bits + BIN_BITS)
        place = cell & ((1 << COUNT_BITS) - 1)
        n = np.bincount(place, minlength=1 << COUNT_BITS)
        n = n + np.maximum(np.roll(n, 1), np.roll(n, -1))
        maybe = np.flatnonzero(n.take(place) >= self.enough.min(initial=1 << 30))
        return hits[maybe[n.take(place[maybe]) >= self._enough(cell[maybe], diagonal_bits)]]

    def _enough(self, cell: np.ndarray, diagonal_bits: int) -> np.ndarray:
        return self.enough[cell >> (diagonal_bits - BIN_BITS)]


def verify(text: str, found: list[tuple[int, int, int]], items: Items) -> list[tuple[int, int, int, int]]:
    """(item id, edit distance, first byte, last byte) of every item that is at one of the found (item number, least and greatest diagonal), the best place of each."""
    best: dict[int, tuple[int, int]] = {}
    for n, low, high in found:
        if n in best and best[n][0] == 0:
            continue
        item = items.texts[n]
        # a gram left whole is off its item's start by the edits before it at most
        edits = int(items.share * len(item))
        lo = max(0, low - edits)
        distance, end = edit_search(item, text[lo : max(0, high + len(item) + 2 * edits)])
        if distance <= items.share * len(item) and (n not in best or distance < best[n][0]):
            best[n] = (distance, lo + end)
    out = []
    for n, (distance, end) in sorted(best.items()):
        stop = len(text[:end].encode("utf-8", "surrogatepass"))
        out.append((items.ids[n], distance, max(0, stop - items.sizes[n]), stop))
    return out


def matches(texts: list[bytes], items: Items) -> list[list[tuple[int, int, int, int]]]:
    """verify() of each cleaned text; texts are joined by line feeds, which no item has, and looked up together."""
    read = [decoded(t) for t in texts]
    first = np.cumsum([0, *(len(t) + 1 for t in read)])
    per: dict[int, list[tuple[int, int, int]]] = {}
    for d, n, low, high in items.places(codes("\n".join(read)), first):
        per.setdefault(d, []).append((n, low - int(first[d]), high - int(first[d])))
    return [verify(t, per[d], items) if d in per else [] for d, t in enumerate(read)]


FOUND = "array<struct<item_id: long, edit_distance: long, first_byte: long, last_byte: long>>"


def _finders(benchmark: DataFrame, share: float) -> list:
    """A function of texts for each block of at most about ITEMS_AT_ONCE items: the matches in a text."""
    small_batches(benchmark.sparkSession)
    sc = benchmark.sparkSession.sparkContext
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    blocks = max(1, math.ceil(bench.count() / ITEMS_AT_ONCE))

    def finder(items: list[tuple[int, bytes]]):
        held = sc.broadcast(items)

        @F.pandas_udf(FOUND)
        @tidy
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ready = Items(held.value, share)
            names = ("item_id", "edit_distance", "first_byte", "last_byte")
            for texts in batches:
                found = [m for part in together((clean(t) for t in texts), TOGETHER) for m in matches(part, ready)]
                yield pd.Series([[dict(zip(names, m, strict=True)) for m in of] for of in found])

        return find.asNondeterministic()  # else a filter would run it a second time

    parts = (bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() for b in range(blocks))
    return [finder(sorted((r[0], t) for r in part if (t := clean(r[1])))) for part in parts]


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs(doc_id, text) x benchmark(item_id, text) -> doc_id, item_id, edit_distance, first_byte, last_byte of each item found.

    An item is found where its edit distance to a part of the document is at most `share` of its
    length, both lower-cased with single spaces. Null, empty and blank texts and items match
    nothing, nor do items with a null item_id; documents with a null doc_id are searched like others, repeated rows each for itself. Of equally good places
    the first is given. An item under five characters must occur as it is, one of any length is sought whole, and texts of
    any length are read whole; other columns are ignored, whatever their names. An empty table on either side gives no
    rows. Recall at every share of edits is in the README.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [docs.select("doc_id", F.explode(find("text")).alias("m")).select("doc_id", "m.*") for find in _finders(benchmark, share)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs without any benchmark item, with all their columns; texts are not shuffled.

    Null texts, and all rows where the benchmark is empty, stay; repeated rows stay or go each for itself.
    """
    for find in _finders(benchmark, share):
        docs = docs.select(F.struct("*").alias("row"), find(F.col("text").cast("string")).alias("found")).filter(F.size("found") == 0).select("row.*")
    return docs
