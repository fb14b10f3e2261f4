"""Bin completion against exhaustive search, the ids against the tokenizer, and the whole packing as a round trip."""

import collections
import functools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from florabund.llm import binpack
from florabund.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"


def count(histogram, room):
    c = np.zeros(room + 1, dtype=np.int64)
    for s, n in histogram.items():
        c[s] = n
    return c


def fewest(items, room):
    """Least bins by trying every subset."""
    items = tuple(sorted(items, reverse=True))

    @functools.lru_cache(maxsize=None)
    def solve(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = 99
        for mask in range(1 << len(rest)):
            inside = [x for k, x in enumerate(rest) if mask >> k & 1]
            if first + sum(inside) <= room:
                best = min(best, 1 + solve(tuple(x for k, x in enumerate(rest) if not mask >> k & 1)))
        return best

    return solve(items)


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_against_every_packing(seed):
    rng = random.Random(seed)
    room = rng.choice([10, 20, 37])
    items = [rng.randint(1, room - 1) for _ in range(rng.randrange(1, 9))]
    need = collections.Counter(items)
    plan = binpack.bin_completion(dict(need), room)
    held = collections.Counter()
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern.items()) <= room
        for s, n in pattern.items():
            held[s] += times * n
    assert held == need
    best = fewest(items, room)
    assert sum(t for t, _ in plan) == best
    assert binpack.least_bins(count(need, room), room) <= best <= sum(t for t, _ in binpack.best_fit(count(need, room), room))


@pytest.mark.parametrize("n", [0, 400, 20_000])
def test_bin_completion_on_many(n):
    rng = random.Random(n)
    need = collections.Counter(min(255, 1 + int(rng.expovariate(1 / 70))) for _ in range(n))
    plan = binpack.bin_completion(dict(need), 256)
    held = collections.Counter()
    for times, pattern in plan:
        for s, k in pattern.items():
            held[s] += times * k
    assert held == need
    c = count(need, 256)
    used, simple = sum(t for t, _ in plan), sum(t for t, _ in binpack.best_fit(c, 256))
    assert binpack.least_bins(c, 256) <= used <= simple
    assert used <= binpack.least_bins(c, 256) * 1.002 + 1


def test_fillings_are_undominated():
    c = count({7: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 12)
    assert list(binpack.fillings(c, 7, 9)) == [{7: 1}]  # the exact one dominates all
    assert list(binpack.fillings(c, 6, 9)) == [{4: 1, 2: 1}, {3: 2}, {5: 1}]
    assert list(binpack.fillings(c, 1, 9)) == [{}]
    got = list(binpack.fillings(c, 9, 9))
    assert {7: 1, 2: 1} in got and {5: 1, 4: 1} in got
    assert {5: 1, 2: 2} not in got  # 2 + 2 gives way to 4


def test_ids_are_the_tokenizers():
    own, other = binpack.ByteIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    assert own.fast is not None
    odd = "abc12.,'!?-éß#  ᠎ ​﻿\x1c\x85日\n \t\r"
    texts = ["".join(rng.choice(odd if k % 3 else "ab é'st.\n 0") for _ in range(rng.randrange(60))) for k in range(1500)]
    texts += ["we'll 'S it's", "<|endoftext|> a<|endoftext|>", "a  b\n\n c \n", "x" * 5000, "\n", " ", "İstanbul ﬁ \U0001f600"]
    for t in texts:
        assert own.ids(t) == np.array(other.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def check_packing(rows, texts, room):
    other = Tokenizer.from_file(VOCABULARY)
    by = collections.defaultdict(list)
    for i, t, times in texts:
        want = [*other.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert len(parts) == times * -(-len(want) // room)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], dtype="<u4").tobytes())
        assert sum(r.length for r in parts) == times * len(want)
        assert all(r.length == room for r in parts if r.piece > 0)
        assert all(r.start == (0 if r.piece == 0 else len(want) - room * (-(-len(want) // room) - r.piece)) for r in parts)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_packing_round_trip(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 9, 30, 100, 400]))), 1) for i in range(150)]
    texts += [(200, None, 1), (201, "", 1), (202, " \n", 1), (203, "same text here", 2), (None, "no id", 1), (204, "long " * 9000, 1)]
    df = spark.createDataFrame([(i, t, 1, "a", 2, 3) for i, t, n in texts for _ in range(n)], "doc_id long, text string, row int, length string, piece int, sequence_id int")
    rows = binpack.pack_few(df, VOCABULARY, room=128).collect()
    used = check_packing(rows, texts, 128)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert used <= binpack.least_bins(count(collections.Counter(r.length for r in rows), 128), 128) + 2
    assert binpack.pack_few(df.limit(0), VOCABULARY).count() == 0


def test_query(spark):
    rows = QUERIES["op11_bin_completion"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    used = check_packing(rows, [(d.doc_id, d.text, 1) for d in docs], 1024)
    lengths = collections.Counter(r.length for r in rows)
    assert used <= binpack.least_bins(count(lengths, 1024), 1024) + 1
