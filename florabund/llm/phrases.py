"""Phrase collocations by Rabin-Karp fingerprints (Karp and Rabin 1987).

Texts are read as bytes in numpy. A prefix polynomial modulo 2^64 over the bytes gives each word's
fingerprint, one over the words those of all n-grams: the difference of two prefix sums times the inverse
of a power. The language and the length are part of a fingerprint. A shuffle sums fingerprints: first of words,
then of pairs of words that are frequent, then of longer phrases whose pairs all are, since no phrase
is more frequent than a part of it. Between these, a bitmap of bounded size tells frequent fingerprints;
what it lets pass by chance is counted as well and falls out by its count. At last every occurrence of a
frequent fingerprint is compared, byte by byte, with the first one of its block that the fingerprint points to, and texts are
materialised for these alone; phrases are then counted by their texts, so that a collision of fingerprints
changes no number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LONGEST = 5
#: Bytes of text that are hashed together.
BLOCK = 2 << 20
#: Distinct fingerprints that a task holds before it hands them on.
HELD = 4 << 20
#: The bitmap has 2^k bits, k as its keys need it, within these.
LEAST_BITS, MOST_BITS = 16, 27
#: Odd bases of the polynomials of bytes and of words, and the increment of lengths.
BASE_BYTES, BASE_WORDS, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x632BE59BD9B4E019

WORD, SPACE, BREAK = 0, 1, 2
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Powers:
    """Powers of an odd base and of its inverse, made once and made longer when needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, powers(base, 1), powers(base, 1)

    def to(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Words and fingerprints of some texts in one buffer; piece numbers tell which neighbours belong together."""

    bytes_, words_ = Powers(BASE_BYTES), Powers(BASE_WORDS)

    def __init__(self, raw: np.ndarray, ends: np.ndarray, seeds: np.ndarray):
        """raw: bytes of all texts; ends: where each text ends; seeds: a number for each text's language."""
        self.raw = raw = LOWER[raw]
        kind = KIND[raw]
        word = np.zeros(len(raw) + 2, dtype=bool)
        word[1:-1] = kind == WORD
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[ends] = True
        cut[0] = True
        self.start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        self.stop = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
        n = len(self.start)
        self.text = np.searchsorted(ends, self.start, side="right")
        self.piece = np.cumsum(kind == BREAK, dtype=np.int64)[self.start] + self.text if n else np.zeros(0, dtype=np.int64)
        self.bytes_.to(len(raw) + 1)
        self.words_.to(n + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.bytes_.up[: len(raw)], out=sums[1:])
        self.value = mixed(mixed((sums[self.stop] - sums[self.start]) * self.bytes_.down[self.start]) ^ seeds.astype(np.int64).view(np.uint64)[self.text])
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value * self.words_.up[:n], out=self.sums[1:])

    def grams(self, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams within pieces, and the leading bits of their fingerprints."""
        at = np.flatnonzero(self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :])
        prints = (self.sums[at + n] - self.sums[at]) * self.words_.down[at]
        prints = mixed(prints + np.uint64(n * STEP % (1 << 64)))
        return at, (prints >> np.uint64(64 - bits) << np.uint64(64 - bits)).view(np.int64)

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.raw[self.start[k] : self.stop[k]].tobytes() for k in range(at, at + n))

    def same(self, at: np.ndarray, as_: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each of `at` are, byte by byte, those from `as_`."""
        ok = np.ones(len(at), dtype=bool)
        for k in range(n):
            a, b = at + k, as_ + k
            size = self.stop[a] - self.start[a]
            ok &= size == self.stop[b] - self.start[b]
            rows = np.flatnonzero(ok & (a != b))
            if len(rows):
                lengths = size[rows]
                first = np.cumsum(lengths) - lengths
                inner = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
                equal = self.raw[np.repeat(self.start[a[rows]], lengths) + inner] == self.raw[np.repeat(self.start[b[rows]], lengths) + inner]
                ok[rows] &= np.logical_and.reduceat(equal, first)
        return ok


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of a batch of (text, seed, ...) and the batch row of each of a block's texts.

    Texts are cut only at a break, so a phrase is never cut; a block is larger than BLOCK only where no break comes."""
    texts = batch.column(0).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    if offsets[-1] == offsets[0]:
        return
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    seeds = batch.column(1).to_numpy(zero_copy_only=False)
    at, row = int(offsets[0]), 0
    while at < offsets[-1]:
        to = min(at + BLOCK, int(offsets[-1]))
        if to < offsets[-1]:
            last = int(np.searchsorted(offsets, to, side="right")) - 1  # the text that holds `to`
            if offsets[last] > at:
                to = int(offsets[last])
            else:
                after = int(offsets[last + 1])
                step = to
                while step < after:
                    found = np.flatnonzero(KIND[raw[step : step + BLOCK]] == BREAK)
                    if len(found):
                        step += int(found[0]) + 1
                        break
                    step += BLOCK
                to = min(step, after)
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        stop = int(np.searchsorted(offsets, to, side="left"))
        ends = np.minimum(offsets[row + 1 : stop + 1], to) - at
        yield Block(raw[at:to], ends, seeds[row:stop]), np.arange(row, stop)
        at = to


def bits_of(keys: DataFrame) -> np.ndarray:
    """keys(print long) as a bitmap: the bit of a fingerprint's leading bits is set. It has at most 2^MOST_BITS bits, whatever the number of keys."""
    size = min(MOST_BITS, max(LEAST_BITS, (64 * keys.count()).bit_length()))
    part = 15 if size > 15 else 0

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << part, dtype=bool)
        bits[(frame["at"].to_numpy() & ((1 << part) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"part": frame["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    at = F.shiftrightunsigned("print", 64 - size)
    parts = keys.select(at.alias("at")).distinct().withColumn("part", F.shiftright("at", part)).groupBy("part").applyInPandas(gather, "part long, bits binary")
    out = np.zeros((1 << (size - part), (1 << part) // 8), dtype=np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def held(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints.view(np.uint64) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def frequent_prints(texts: DataFrame, prints: Callable[[Block], list[np.ndarray]], least: int) -> DataFrame:
    """print, n of the fingerprints that prints() gives `least` times or more over all texts."""
    schema = pa.schema([("print", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, number = np.concatenate(keys), np.concatenate(numbers)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
            return key[first], np.add.reduceat(number[order], first) if len(first) else number

        for batch in batches:
            for block, _ in blocks(batch):
                for found in prints(block):
                    key, number = np.unique(found, return_counts=True)
                    keys.append(key)
                    numbers.append(number.astype(np.int64))
                    size += len(key)
                if size > HELD:
                    key, number = merged()
                    keys, numbers, size = [key], [number], len(key)
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(number)], schema=schema)
                        keys, numbers, size = [], [], 0
        if size:
            key, number = merged()
            for k in range(0, len(key), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 17)]), pa.array(number[k : k + (1 << 17)])], schema=schema)

    counted = texts.mapInArrow(count, "print long, n long")
    # tasks have summed their own already
    return stored(counted.repartition("print").groupBy("print").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def frequent_phrases(docs: DataFrame, least: int = 100, bits: int = 64) -> DataFrame:
    """docs(text, lang) -> lang, phrase, size, f, for all phrases of one to five words that occur `least` times or more in a language, and n, all words of it.

    bits: of a fingerprint that are used; with fewer, collisions are common and cost time, but change no number.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    seeded = texts.select("text", F.xxhash64("lang").alias("seed"))
    words = frequent_prints(seeded, lambda block: [block.grams(1, bits)[1]], least)
    common = spark.sparkContext.broadcast(bits_of(words.select("print")))

    def pairs(block: Block) -> list[np.ndarray]:
        ok = held(common.value, block.grams(1, bits)[1])
        at, prints = block.grams(2, bits)
        return [prints[ok[at] & ok[at + 1]]]

    twos = frequent_prints(seeded, pairs, least)
    joined = spark.sparkContext.broadcast(bits_of(twos.select("print")))

    def chains(block: Block) -> list[np.ndarray]:
        at, prints = block.grams(2, bits)
        run = np.zeros(len(block.start) + LONGEST, dtype=np.int64)
        run[at[held(joined.value, prints)]] = 1  # a frequent pair begins here
        out = []
        for n in range(3, LONGEST + 1):
            at, prints = block.grams(n, bits)
            ok = np.ones(len(at), dtype=bool)
            for k in range(n - 1):
                ok &= run[at + k] == 1
            out.append(prints[ok])
        return out

    longer = frequent_prints(seeded, chains, least)
    wanted = spark.sparkContext.broadcast(bits_of(words.select("print").unionByName(twos.select("print")).unionByName(longer.select("print"))))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("size", pa.int32()), ("f", pa.int64())])

    def materialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2)
            for block, rows in blocks(batch):
                out: list[list] = [[], [], [], []]
                names = langs.take(pa.array(rows)).to_pylist()
                spoken = np.unique(np.array(names, dtype=object), return_inverse=True)[1][block.text]  # of each word, its language's number
                for n in range(1, LONGEST + 1):
                    at, prints = block.grams(n, bits)
                    if n == 1:  # all words count for n, those that are rare under no name
                        texts_of, numbers = np.unique(block.text, return_counts=True)
                        for t, k in zip(texts_of.tolist(), numbers.tolist(), strict=True):
                            for column, v in zip(out, (names[t], None, 0, k), strict=True):
                                column.append(v)
                    ok = held(wanted.value, prints)
                    at, prints = at[ok], prints[ok]
                    while len(at):  # one round, but for collisions
                        _, first, group, numbers = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
                        equal = block.same(at, at[first][group], n) & (spoken[at] == spoken[at[first][group]])
                        numbers = np.bincount(group, weights=equal, minlength=len(first)).astype(np.int64)
                        for a, k in zip(at[first].tolist(), numbers.tolist(), strict=True):
                            for column, v in zip(out, (names[block.text[a]], block.phrase(a, n), n, k), strict=True):
                                column.append(v)
                        at, prints = at[~equal], prints[~equal]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    named = texts.select("text", F.xxhash64("lang").alias("seed"), "lang").mapInArrow(materialised, "lang string, phrase binary, size int, f long")
    exact = named.withColumn("phrase", F.col("phrase").cast("string")).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull())
    exact = stored(exact)
    totals = exact.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return exact.filter("phrase is not null").join(totals, "lang")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, bits: int = 64) -> DataFrame:
    """The `top` phrases of two to five words of each language by score: lang, rank, phrase, a, l, r, n, score.

    docs(text, lang); A-Z is lower-cased, pieces end at `.,;:!?` and line ends, words at spaces and tabs; a null text has none, a null
    lang is `und`. a, l and r count the phrase and the two parts of its lowest-scoring cut (ties: the shortest first part), n all
    words. score = floor(1000 a n / (l r)), in decimals of 38 digits. A phrase that lies in a longer frequent one with the same count is left out.
    Ranks are by score and a descending, then phrase in byte order, so there are no ties. Repeated rows count each, texts of any length
    are read whole, other columns are ignored, and an empty table gives no rows.
    """
    found = stored(frequent_phrases(docs, least, bits))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    words = F.split("phrase", " ")
    phrases = found.filter("size > 1").withColumn("words", words)
    # what one word more contains: if a phrase has an equal longer one, it has an equal one that is one word longer
    inner = phrases.filter("size > 2").select("lang", F.explode(F.array(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1))).alias("w"), "f")
    inner = inner.select("lang", F.array_join("w", " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer_f"))
    alone = phrases.join(inner, ["lang", "phrase"], "left").filter(F.col("outer_f").isNull() | (F.col("outer_f") < F.col("f")))
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), "n", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    scored = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r")), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return lowest.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
