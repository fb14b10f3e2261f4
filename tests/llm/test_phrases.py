"""Collocations against a count of every phrase, with collisions of fingerprints forced, odd rows and whole tables."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from florabund.llm import phrases
from florabund.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def every_phrase(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[k : k + size])] += 1
    return f, n


def brute(rows, least, top):
    f, n = every_phrase(rows)
    out = []
    for lang, count in f.items():
        held = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and b >= a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in held.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["a", "b", "A", "é", "日本", "\x00x", "c d", "e-f", "longer"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "; "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(60)]
    return rows + [(None, "en"), ("", None), (" \t\n", "fr"), ("...", "fr"), ("x y z x y z", "it"), ("x y z x y z", "it"), ("one", None), ("a b " * 3000, "en"), ("É é", "de")]


@pytest.mark.parametrize("bits", [64, 9])
def test_collocations_against_every_phrase(spark, bits):
    rows = corpus()
    df = spark.createDataFrame([(t, g, "x", 1, 2) for t, g in rows], "text string, lang string, phrase string, n int, f int")
    got = phrases.collocations(df, least=3, top=12, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 12)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string"), least=1).count() == 0


def test_exact_score_beyond_64_bits(spark):
    a, n, l, r = 9_000_000_000_000, 90_000_000_000_000_000, 9_000_000_000_001, 9_100_000_000_000
    sql = "(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{sql} s").collect()[0].s
    assert got == 1000 * a * n // (l * r)


def test_blocks_cut_at_breaks_only(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 40)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ,") for _ in range(rng.randrange(0, 150))) for _ in range(50)] + ["a b " * 100, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([7] * len(texts), pa.int64())], names=["text", "seed"])
    got = collections.Counter()
    for part in (batch, batch.slice(5, 20), batch.slice(0, 0)):
        got.clear()
        for block, rows in phrases.blocks(part):
            assert block.text.max(initial=0) < len(rows)
            for n in range(1, 6):
                got.update(block.phrase(int(k), n) for k in block.grams(n)[0])
        f, _ = every_phrase([(t, "x") for t in part.column(0).to_pylist()])
        assert got == collections.Counter({" ".join(p).encode(): a for p, a in f["x"].items()})


def test_fingerprints_tell_order_length_and_language():
    raw = np.frombuffer(b"a b a c b a", dtype=np.uint8)
    one = phrases.Block(raw, np.array([11]), np.array([1]))
    two = phrases.Block(raw, np.array([11]), np.array([2]))
    prints = np.concatenate([b.grams(n)[1] for b in (one, two) for n in (1, 2, 3)])
    # a, b, c; ab, ba, ac, cb; aba, bac, acb, cba
    assert len(set(prints.tolist())) == 2 * (3 + 4 + 4)
    assert one.same(np.array([0, 1, 0]), np.array([2, 4, 1]), 1).tolist() == [True, True, False]


def test_query_on_a_whole_table(spark):
    got = QUERIES["op13_collocations"](spark, SF).collect()
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert sorted(map(tuple, got)) == brute(rows, 100, 2000)
