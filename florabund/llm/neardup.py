"""MinHash near-duplicates with odd sketches (Mitzenmacher, Pagh and Pham 2014).

Per document: the set of distinct word shingles as 64-bit hashes, a MinHash sample of it, keys of
its bands, and an odd sketch, the parity bitmap of the sample. Documents with equal sets are one
class first, so groups of copies count once. Classes that share a band key are candidates; the
XOR population count of two odd sketches estimates their similarity and drops the unlike ones;
the rest are confirmed on full sets. Candidates are taken in two steps, so that a large group of
near copies never gives all its pairs: first each document against the most central member of its largest
bucket and the smallest member of all its buckets, then only pairs of members that are still in different components, which a larger sketch
estimates more precisely before sets are fetched.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, tidy, together, vectorized
from .components import components

#: 21 bands of 6: a pair at 0.85 shares none with probability 5e-5, a pair at 0.5 shares one with 0.28.
SAMPLE, ROWS, SKETCH_BITS = 128, 6, 512
#: The larger sample and sketch of documents in unsettled buckets.
FINE_SAMPLE, FINE_BITS = 1024, 4096
#: Up to this many ids are broadcast to pick texts; more of them are joined with a shuffle.
FEW_IDS = 200_000
#: Members of an unsettled bucket that one task compares with each other or with another block.
BLOCK = 512
#: Members of small unsettled buckets that one task takes.
TASK_ROWS = 4096
#: Pairs that a task looks at together, and those whose sketches it holds at once.
PAIRS, STEP = 1 << 20, 1 << 13
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**32, FINE_SAMPLE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, FINE_SAMPLE, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(1, 2**63, FINE_SAMPLE, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word -> 64-bit hash."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, known: WordHash, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; a shorter text is one shingle, no words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() touches A-Z only
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(size, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * _P + h[k : len(h) - width + 1 + k]
    return np.unique(mix(out + np.uint64(width)))


def bands_for(threshold: float, recall: float, most: int = SAMPLE) -> tuple[int, int]:
    """(bands, rows): the most rows, at the sample size `most`, with which a pair at the threshold shares a band with probability `recall`."""
    rows = max(r for r in range(1, 9) if r == 1 or 1 - (1 - threshold**r) ** (most // r) >= recall)
    return most // rows, rows


def sample(hashes: np.ndarray, size: int = SAMPLE) -> np.ndarray:
    """MinHash sample of `size` 32-bit values."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, (1 << 18) // size)
    for at in range(0, len(low), step):
        part = low[at : at + step, None] ^ _B[:size]
        part *= _A[:size]
        np.minimum(best, part.min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray, width: int = ROWS) -> np.ndarray:
    rows = best[: len(best) // width * width].reshape(-1, width).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _P
    for k in range(width):
        key = mix(key + rows[:, k]) * _P
    return key.view(np.int64)


def odd_sketch(best: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap: each (position, value) of the sample flips one of the bits."""
    at = mix(best.astype(np.uint64) * _P + _PLACE[: len(best)]) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def estimate(different: np.ndarray, size: int = SAMPLE, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    share = np.minimum(1 - 2 * np.asarray(different, dtype=float) / bits, 1)
    return 1 + bits / 2 * np.log(np.maximum(share, 1e-9)) / (2 * size)


def most_different(threshold: float, size: int = SAMPLE, bits: int = SKETCH_BITS) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most: five standard deviations, of sample and sketch, below it."""
    toggles = 2 * size * (1 - threshold)
    of_sketch = bits / 4 * (math.exp(4 * toggles / bits) - 1) - toggles  # variance of the number of toggles estimated from parities
    slack = 5 * math.sqrt(threshold * (1 - threshold) / size + max(0.0, of_sketch) / (2 * size) ** 2)
    return int(np.flatnonzero(estimate(np.arange(bits // 2), size, bits) >= threshold - slack)[-1])


def signature(text: str, size: int = SAMPLE, width: int = ROWS) -> Column:
    """struct(n_shingles, set_hash, bands, sketch) of a text column; nulls and 0 for texts without words."""

    @F.pandas_udf("n_shingles long, set_hash binary, bands array<long>, sketch array<long>")
    @tidy
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(t, known)
                if len(s):
                    best = sample(s, size)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(best, width), odd_sketch(best)))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_hash", "bands", "sketch"])

    return sign(text)


def short_signatures(texts: list[bytes], known: WordHash, size: int, width: int, shingle: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles, band keys, odd sketches), a row per text, of many short texts at once; every text needs a shingle's words.

    The same values as of shingles(), sample() and so on; repeated shingles count in the number.
    """
    hashes, n = short_hashes(texts, known, shingle)
    return n, *short_samples(hashes, n, size, width)


def short_hashes(texts: list[bytes], known: WordHash, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in order, their number in each text)."""
    found = [t.split() for t in texts]
    sizes = np.array([len(w) for w in found])
    h = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(found)), dtype=np.uint64, count=int(sizes.sum()))
    out = h[: len(h) - shingle + 1].copy()
    for k in range(1, shingle):
        out = out * _P + h[k : len(h) - shingle + 1 + k]
    ends = np.cumsum(sizes)
    inside = np.ones(len(out), dtype=bool)
    for k in range(1, shingle):  # windows that reach over the end of a text
        at = ends[:-1] - k
        inside[at[at < len(inside)]] = False
    return mix(out[inside] + np.uint64(shingle)), sizes - shingle + 1


def short_samples(hashes: np.ndarray, n: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of short_hashes()."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    best = np.empty((len(n), size), dtype=np.uint32)
    for k in range(size):
        best[:, k] = np.minimum.reduceat((low ^ _B[k]) * _A[k], first)
    rows = best[:, : size // width * width].reshape(len(n), -1, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * _P, rows.shape[:2])
    for k in range(width):
        key = mix(key + rows[:, :, k]) * _P
    at = (mix(best.astype(np.uint64) * _P + _PLACE[:size]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((at + np.arange(len(n))[:, None] * SKETCH_BITS).ravel(), minlength=len(n) * SKETCH_BITS) & 1
    sketch = np.packbits(flat.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(n), -1)
    return key.view(np.int64), sketch


def short_sets(hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The sets of short_hashes(), each as the bytes of shingles()."""
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, text))
    hashes = hashes[order]  # text is sorted as it is
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    raw = hashes[new].tobytes()
    edge = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(n)))]) * 8
    return [raw[a:b] for a, b in itertools.pairwise(edge.tolist())]


def parities(sets: list[bytes], bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of whole sets, a row each: two of them differ in no more bits than the sets have elements of their own."""
    out = np.empty((len(sets), bits // 64), dtype=np.uint64)
    for k in range(0, len(sets), 1024):
        part = sets[k : k + 1024]
        at = (np.frombuffer(b"".join(part), dtype=np.uint64) % np.uint64(bits)).astype(np.int64)
        at += np.repeat(np.arange(len(part)), [len(x) // 8 for x in part]) * bits
        odd = (np.bincount(at, minlength=len(part) * bits) & 1).astype(np.uint8)
        out[k : k + 1024] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(len(part), -1)
    return out


def short_signature(text: str, size: int = SAMPLE, width: int = ROWS) -> Column:
    """signature() for columns of short texts, cleaned to single spaces and lower case, with five words or more; equal texts are the class. The sets are carried along as shingles."""

    @F.pandas_udf("n_shingles long, set_hash binary, bands array<long>, sketch array<long>, shingles binary")
    @tidy
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for texts in batches:
            parts = []
            for part in together([t.encode("utf-8", "surrogatepass") for t in texts], 1 << 18):
                hashes, n = short_hashes(part, known)
                bands, sketch = short_samples(hashes, n, size, width)
                parts.append(pd.DataFrame({"n_shingles": n, "set_hash": [xxhash.xxh3_128_digest(t) for t in part], "bands": list(bands), "sketch": list(sketch), "shingles": short_sets(hashes, n)}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_shingles": [], "set_hash": [], "bands": [], "sketch": [], "shingles": []})

    return sign(text)


@vectorized("binary")
@tidy
def shingle_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = WordHash()
    for texts in batches:
        yield pd.Series([shingles(t, known).tobytes() for t in texts])


@vectorized("array<long>")
@tidy
def fine_sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = WordHash()
    for texts in batches:
        yield pd.Series([odd_sketch(sample(shingles(t, known), FINE_SAMPLE), FINE_BITS) for t in texts])


@vectorized("long")
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> int:
        both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def bits_apart(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _alike(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) whose sketches differ in at most `most` bits."""
    s = sketches.select("id", "sketch")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    return both.filter(bits_apart("sa", "sb") <= most).select("a", "b")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids(id)."""
    ids = stored(ids.select("id").distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of pairs(a, b) with 100 * intersection >= percent * union on full shingle sets.

    sets(id, s) has them ready; else they are made from docs. A document with many partners gets copies of its set by hash slice, one for each 500 of its pairs.
    """
    if sets is None:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        sets = stored(_texts_of(docs, ids).select("id", shingle_set("text").alias("s")).dropDuplicates(["id"]))
    out = pairs
    for end in ("a", "b"):
        slices = pairs.groupBy(end).agg(F.ceil(F.count("*") / 500).cast("int").alias("slices"))
        wide = sets.join(slices.withColumnRenamed(end, "id"), "id").select(F.col("id").alias(end), F.col("s").alias(f"s{end}"), "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        dealt = out.join(slices, end).withColumn("slice", F.pmod(F.xxhash64("a", "b"), F.col("slices")).cast("int")).drop("slices")
        out = dealt.join(wide.drop("slices"), [end, "slice"]).drop("slice")
    size = lambda c: F.octet_length(c) / 8
    out = out.withColumn("n", overlap("sa", "sb"))
    return out.filter(100 * F.col("n") >= percent * (size("sa") + size("sb") - F.col("n"))).select("a", "b")


def _bits(sketches: pd.Series) -> np.ndarray:
    """Sketches as rows of unsigned words; bitwise_count takes the absolute value of signed ones."""
    return np.stack(sketches.to_numpy()).view(np.uint64)


def linking(pairs: np.ndarray) -> np.ndarray:
    """Those rows of pairs that link what the rows before them have not linked yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            keep.append(k)
    return pairs[keep]


def _across(members: DataFrame, most: int, most_fine: int, percent: int | None = None) -> DataFrame:
    """Pairs inside the buckets of members(key, id, component, bands, sketch, fine) with different components and alike sketches of both kinds.

    percent: members have a column shingles in place of fine, sets short enough to be carried; pairs are then tested on them,
    after a bound from their parity bitmaps that loses none, and of the links of a task only those are given that join what others do not.

    A pair that shares several buckets is taken in that of its first common band.

    Large buckets are cut into blocks of about BLOCK members by hash and every two blocks meet in
    a task of their own; sketches are compared as matrices, and only pairs that pass become rows.
    """
    size = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(size, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = ["id", "component", "bands", "sketch", "shingles" if percent else "fine"]
    own = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *more)

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        # the buckets of a task one after the other, in each the left block first
        group = group.sort_values(["key", "i", "j", "own"], kind="stable")
        key, i, j, own, ids, component = (group[c].to_numpy() for c in ("key", "i", "j", "own", "id", "component"))
        sketch, bands = _bits(group.sketch), np.stack(group.bands.to_numpy())
        fine = parities(group.shingles.tolist()) if percent else _bits(group.fine)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.shingles] if percent else []
        held = np.array([len(x) for x in sets])

        def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.bitwise_count(fine[p] ^ fine[q]).sum(axis=1, dtype=np.int64)

        def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            both = ((sets[x], sets[y]) for x, y in zip(p.tolist(), q.tolist(), strict=True))
            same = ((len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)) for a, b in both)
            return np.fromiter((100 * n >= percent * (size - n) for n, size in same), dtype=bool, count=len(p))

        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        place, end = np.arange(len(key)), np.repeat(begin + size, size)
        # a row meets those after it in its bucket, or the right block if it is in the left one
        right = np.repeat(begin + np.add.reduceat((own == i).astype(np.int64), begin), size)
        low = np.where(i == j, place + 1, np.where(own == i, right, end))
        n = end - low
        found_a, found_b = [ids[:0]], [ids[:0]]
        edge = [0, *np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()), PAIRS)).tolist(), len(n)]
        for x, y in itertools.pairwise(edge):
            part = n[x:y]
            p = np.repeat(place[x:y], part)
            q = np.repeat(low[x:y] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))
            for ok in (
                lambda p, q: component[p] != component[q],
                lambda p, q: np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64) <= most,
                lambda p, q: bands[p, (bands[p] == bands[q]).argmax(axis=1)] == key[p],  # the first common band is this one
                # elements of one set alone are no more than (100 - percent) of (100 + percent) in both
                *([lambda p, q: (100 + percent) * apart(p, q) <= (100 - percent) * (held[p] + held[q]), alike] if percent else [lambda p, q: apart(p, q) <= most_fine]),
            ):
                keep = np.concatenate([ok(p[k : k + STEP], q[k : k + STEP]) for k in range(0, len(p), STEP)]) if len(p) else np.empty(0, dtype=bool)
                p, q = p[keep], q[keep]
            found_a.append(np.minimum(ids[p], ids[q])), found_b.append(np.maximum(ids[p], ids[q]))
        out = np.column_stack([np.concatenate(found_a), np.concatenate(found_b)])
        return pd.DataFrame(linking(out) if percent else out, columns=["a", "b"], dtype="int64")

    # small buckets share tasks, of about TASK_ROWS members each; a pair of blocks of a large one is a task by itself
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(members.count() / TASK_ROWS))
    small = F.pmod(F.xxhash64("key"), F.lit(tasks))
    own = own.select(F.when((F.col("i") == 0) & (F.col("j") == 0), small).otherwise(F.xxhash64("key", "i", "j")).alias("task"), "key", "i", "j", "own", *more)
    return own.groupBy("task").applyInPandas(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SAMPLE, width: int = ROWS, sign: Callable[[str, int, int], Column] = signature, short: bool = False) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Linked documents share component_id, the smallest doc_id reachable; kept marks that one.
    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id are one document. Rows with a null doc_id are never linked and are kept. A pair exactly
    at `percent` is linked; with short, texts are paragraphs of so few words that their sets can be carried (sign gives them as shingles); of equal sets the smallest doc_id stays. Texts of any length are read
    whole, other columns are ignored, whatever their names, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.select("doc_id", sign("text", size, width).alias("s")).select("doc_id", "s.*"))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    of_head = ["bands", "sketch"] + (["shingles"] if short else [])  # sets of short texts are carried along, so that pairs are tested where they are found
    heads = full.join(classes.select("set_hash", F.col("id").alias("doc_id")), ["set_hash", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), *of_head)
    heads = stored(heads.groupBy("id").agg(*(F.first(c).alias(c) for c in of_head)))
    rows = heads.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1")
    members = stored(rows.join(shared, "key"))
    sketches = stored(heads.join(members.select("id").distinct(), "id", "left_semi").select("id", "sketch", "bands"))
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    # one hub, that of the largest bucket, and the smallest member met, so that pairs grow with the members and not with their bands
    centres = members.join(hubs, "key").groupBy("id").agg(F.max_by("hub", F.struct("n", "key")).alias("hub"), F.min("low").alias("low"))
    star = centres.select("id", F.explode(F.array_distinct(F.array("hub", "low"))).alias("hub")).filter("id != hub")
    most = most_different(percent / 100, size)
    first = stored(_alike(star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), sketches, most))
    links = stored(confirm(first, docs, percent, heads.select("id", F.col("shingles").alias("s")) if short else None))
    names = components(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    placed = members.select("key", "id").join(names.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    unsettled = stored(placed.join(open_keys, "key", "left_semi"))
    if short:
        more = stored(_across(stored(unsettled.join(heads, "id")), most, 0, percent))
    else:
        fine = stored(_texts_of(docs, unsettled).select("id", fine_sketch("text").alias("fine")).dropDuplicates(["id"]))
        both = stored(unsettled.join(sketches.join(fine, "id"), "id"))
        second = stored(_across(both, most, most_different(percent / 100, FINE_SAMPLE, FINE_BITS)).join(first, ["a", "b"], "left_anti"))
        more = stored(confirm(second, docs, percent))
    if not more.isEmpty():
        names = components(links.union(more))
    # members of one class, then the class's component
    of_class = classes.join(names.withColumnRenamed("node", "id"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id")).filter("component_id is not null")
    multi = classes.filter("n > 1").select("set_hash").union(classes.join(names.select(F.col("node").alias("id")), "id", "left_semi").select("set_hash")).distinct()
    of_class = stored(of_class.join(multi, "set_hash", "left_semi"))
    of_class = F.broadcast(of_class) if of_class.count() <= FEW_IDS else of_class  # a hot class then stays where its rows are
    # texts without words are in no class: they would all meet under one null key
    out = signed.filter("set_hash is not null").join(of_class, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.union(signed.filter("set_hash is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
