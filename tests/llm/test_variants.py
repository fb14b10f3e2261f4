"""Spelling variants against a comparison of every two words, with large parts cut, odd rows and whole tables."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from florabund.llm import variants
from florabund.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_words(rows, least_length=7, least=2):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least_length and n >= least}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, ratio=10):
    out, form = {}, {}
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return sorted(out.values())


def corpus():
    rng = random.Random(12)
    rows = []
    for k in range(40):
        words = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(5, 11))) for _ in range(60)]
        rows.append((k, rng.choice([" ", "-", "1", "\n"]).join(words * rng.choice([1, 2, 2]))))
    rows += [(100, "Chained chained1" * 300), (101, "chaines " * 25), (102, "chainee " * 2), (103, None), (104, ""), (None, "NoNumber nonumber nonumbet nonumbet"), (105, "×÷×÷×÷× ×÷×÷×÷×")]
    rows += [(106, "x" * 400 + " " + "x" * 400), (107, "x" * 400 + "y " + "x" * 400 + "y")] + [(108, "repeated repeated")] * 3
    return rows


@pytest.mark.parametrize("most", [1 << 14, 20])
def test_variants_against_every_pair(spark, most):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "a", 1, 2, 3) for i, t in rows], "doc_id long, text string, word string, n int, m int, root int")
    got = variants.spelling_variants(df, most=most).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(brute_words(rows))


def test_chunks_cut_between_parts_only(spark):
    words = brute_words(corpus())
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    whole = {r.word: (r.n_near, tuple(r.best)) for r in variants.near_words(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:  # many batches, parts go on from one to the next
        assert {r.word: (r.n_near, tuple(r.best)) for r in variants.near_words(df, chunk=30).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted(["aax", "abx", "bax", "bbx", "bby", "cax", "cbx"])
    codes = np.array([[ord(c) for c in w] for w in words])
    a = variants.Acceptor(codes, np.zeros(len(words), dtype=np.int64), 1)
    # after a and c the same two words go on; before the end x, and x or y
    assert [len(layer[0]) - 1 for layer in a.arcs] == [1, 2, 2]
    state, word, text = a.initial, a.base, [""]
    for d in range(3):
        of, arc = a.expand(d, state)
        text = [text[k] + chr(label) for k, label in zip(of.tolist(), a.arcs[d][1][arc].tolist(), strict=True)]
        state, word = a.arcs[d][2][arc], word[of] + a.arcs[d][3][arc]
    assert dict(zip(word.tolist(), text, strict=True)) == dict(enumerate(words))


@pytest.mark.parametrize("seed", range(6))
def test_parts_hold_each_pair_once(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab" if seed % 2 else "abc") for _ in range(rng.randrange(7, 10))): rng.randrange(1, 9) for _ in range(80)}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best.n, r.best.word) for r in variants.near_words(df, most=rng.choice([4, 1000])).collect()}
    for w in words:
        near = [x for x in words if is_near(w, x)]
        best = min(((-words[x], x) for x in near), default=None)
        assert got.get(w) == ((len(near), -best[0], best[1]) if best else None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(df).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0


def test_long_chains_of_forms(spark):
    df = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)], "word string, form string")
    assert {r.word: r.root for r in variants.roots(df).collect()} == {f"w{k}": "w13" for k in range(13)}


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_collocations"])
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    answer = db.execute(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(d[0] for d in answer.description) == sorted(df.columns)
    want = sorted(map(repr, ({d[0]: v for d, v in zip(answer.description, r, strict=True)} for r in answer.fetchall())))
    assert len(want) > (0 if name == "op13_collocations" else 100)
    order = [d[0] for d in answer.description]
    assert sorted(repr({c: r[c] for c in order}) for r in df.collect()) == want
