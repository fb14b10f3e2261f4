"""Spelling variants by finite-state composition (Mohri 2009; Schulz and Mihov 2002).

The vocabulary is an acceptor; composed with a transducer of exactly one inserted, deleted or replaced
code point and with the acceptor again it accepts the pairs of near words. A pair takes the path both
words share up to their first difference, then one edit, then the path they share to the end. So the composition falls
apart by that path: of a pair whose shorter word has m code points, either the first m / 2 or the
last m - m / 2 lie outside the edit. Words that agree there, and in m, are a part with an initial state of its own, which Spark deals
out. Each task minimises the acceptors of its parts together, layer by layer from the end (equal right languages are one state), and composes them with the edit, a
layer at a time in numpy. A state knows how many words it accepts, so that a path is the number of
its word. Parts of more than `most` rows are cut further, by each place of the edit alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows whose acceptors are built and composed together; a part is never cut.
CHUNK = 1 << 17
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 20
#: Labels are code points below this.
LABELS = 256


def counted_words(docs: DataFrame, least_length: int = 7, least: int = 2) -> DataFrame:
    """docs(doc_id, text) -> word, n.

    Words are maximal runs `[A-Za-z\\u00C0-\\u00FF]+` with A-Z lower-cased, of `least_length` code points and `least` occurrences at least. Where
    31 divides h, the crc32 of `<doc_id>:<run>`, the run's code point h mod length is deleted first. A null doc_id reads as an
    empty one; a null text has no words.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                head = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for run, k in found.items():
                    h = zlib.crc32(run.encode(), head)
                    if h % 31 == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    n[run] += k
                if len(n) > HELD:
                    yield handed()
                    n.clear()
        if n:
            yield handed()

    each = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return each.repartition("word").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def parts(words: DataFrame, least_length: int, most: int) -> DataFrame:
    """words(word, n) -> a row for every part that a word belongs to: m, lo, hi, context, word, n.

    The words of a part have m code points, or one more, and differ between lo and hi of the m at most; the context is what lies outside.
    """
    m, lo, hi, n = F.col("m"), F.col("lo"), F.col("hi"), F.length("word")
    half = lambda m: (m / 2).cast("int")
    windows = lambda m: F.array(F.struct(m.alias("m"), F.lit(0).alias("lo"), half(m).alias("hi")), F.struct(m.alias("m"), half(m).alias("lo"), m.alias("hi")))
    own, shorter = windows(n), windows(n - 1)
    rows = words.select("word", "n", F.explode(F.when(n > least_length, F.concat(own, shorter)).otherwise(own)).alias("w")).select("word", "n", "w.*")
    context = F.concat(F.substring("word", F.lit(1), lo), F.lit("|"), F.substring("word", n - m + hi + 1, m - hi))
    rows = rows.withColumn("context", context)
    large = rows.groupBy("m", "lo", "hi", "context").agg(F.count("*").alias("size")).filter(F.col("size") > most).drop("size").withColumn("large", F.lit(True))
    rows = rows.join(large, ["m", "lo", "hi", "context"], "left")
    # a row for itself, or one for each place of a large part's window
    places = F.when(F.col("large"), F.transform(F.sequence(lo, hi - 1), lambda k: F.struct(k.alias("lo"), (k + 1).alias("hi")))).otherwise(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))
    cut = rows.select("m", "word", "n", F.explode(places).alias("p")).select("m", "p.*", "word", "n")
    return cut.select("m", "lo", "hi", context.alias("context"), "word", "n")


class Acceptor:
    """The minimal acceptor of sorted rows of equal length, with an initial state for each part: layer d holds the states after d labels."""

    def __init__(self, codes: np.ndarray, part: np.ndarray, n_parts: int):
        """codes: rows of labels, sorted within their parts; part: the part of each row, ascending."""
        rows, length = codes.shape
        new = np.ones(rows, dtype=bool)
        new[1:] = part[1:] != part[:-1]
        starts = [np.flatnonzero(new)]  # first row of each node of the trie, by depth
        for d in range(length):
            new = new.copy()
            new[1:] |= codes[1:, d] != codes[:-1, d]
            starts.append(np.flatnonzero(new))
        state = np.zeros(len(starts[length]), dtype=np.int64)  # of the trie's nodes; the last layer has one final state
        accepted = np.ones(1, dtype=np.int64)
        #: By layer: first arc of each state and after the last; label, target and words before of each arc; state * LABELS + label.
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [()] * length
        for d in range(length - 1, -1, -1):
            label, target = codes[starts[d + 1], d], state
            first = np.searchsorted(starts[d + 1], starts[d])
            degree = np.diff(np.append(first, len(label)))
            state, chosen = self._merged(label, target, first, degree)
            of = np.repeat(np.arange(len(chosen)), degree[chosen])
            begin = np.cumsum(degree[chosen]) - degree[chosen]
            inner = np.arange(len(of)) - begin[of]
            arc = first[chosen][of] + inner
            label, target = label[arc], target[arc]
            sums = np.cumsum(accepted[target])
            skipped = sums - accepted[target]
            skipped = skipped - (skipped[begin][of] if len(of) else 0)
            accepted = np.add.reduceat(accepted[target], begin) if len(begin) else np.zeros(0, dtype=np.int64)
            self.arcs[d] = (np.append(begin, len(of)), label, target, skipped, of * LABELS + label)
        #: Initial state and first row of each part; -1: it has no row.
        self.initial = np.full(n_parts, -1, dtype=np.int64)
        self.initial[part[starts[0]]] = state
        self.base = np.zeros(n_parts, dtype=np.int64)
        self.base[part[starts[0]]] = starts[0]

    @staticmethod
    def _merged(label: np.ndarray, target: np.ndarray, first: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state of each node, equal for nodes of equal arcs, and a node for each state."""
        seed = 1
        while True:
            h = (target * LABELS + label + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            key = np.add.reduceat(h ^ (h >> np.uint64(29)), first) if len(first) else h
            _, chosen, state = np.unique(key, return_index=True, return_inverse=True)
            as_ = chosen[state]
            if (degree == degree[as_]).all():
                of = np.repeat(np.arange(len(first)), degree)
                other = first[as_][of] + np.arange(len(of)) - first[of]
                if (label == label[other]).all() and (target == target[other]).all():
                    return state, chosen
            seed += 1  # different arcs had one hash

    def expand(self, d: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the states of layer d: which of the given it leaves, and the arc."""
        begin = self.arcs[d][0]
        degree = begin[state + 1] - begin[state]
        of = np.repeat(np.arange(len(state)), degree)
        return of, begin[state][of] + np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree, degree)

    def find(self, d: int, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The arc of each state with that label; -1: none."""
        keys, want = self.arcs[d][4], state * LABELS + label
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        return np.where(keys[at] == want, at, -1) if len(keys) else np.full(len(want), -1)


Paths = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _both(left: Acceptor, a: int, right: Acceptor, b: int, paths: Paths) -> Paths:
    """One more label, the same on both sides: left states of layer a, right states of layer b, words before on either side."""
    p, q, i, j = paths
    of, arc = left.expand(a, p)
    _, label, target, skipped, _ = left.arcs[a]
    other = right.find(b, q[of], label[arc])
    ok = other >= 0
    of, arc, other = of[ok], arc[ok], other[ok]
    return target[arc], right.arcs[b][2][other], i[of] + skipped[arc], j[of] + right.arcs[b][3][other]


def _joined(many: list[Paths]) -> Paths:
    return tuple(np.concatenate(x) for x in zip(*many, strict=True))


def replaced(words: Acceptor, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words that differ in one code point; each pair once."""
    begun = words.initial >= 0
    p, i = words.initial[begun], words.base[begun]
    edited: Paths = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    for d in range(length):
        of, arc = words.expand(d, p)
        begin, _, target, skipped, _ = words.arcs[d]
        following = begin[p + 1][of] - arc - 1  # later arcs of the same state: the other label
        pair = np.repeat(np.arange(len(of)), following)
        two = arc[pair] + 1 + np.arange(len(pair)) - np.repeat(np.cumsum(following) - following, following)
        one = arc[pair]
        begun_here = (target[one], target[two], i[of][pair] + skipped[one], i[of][pair] + skipped[two])
        edited = _joined([_both(words, d, words, d, edited), begun_here])
        p, i = target[arc], i[of] + skipped[arc]
    return edited[2], edited[3]


def inserted(words: Acceptor, longer: Acceptor, length: int, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words, and of those that have one code point more, which at_end lets come after the last.

    The code point is inserted where the two first differ, so each pair has one path."""
    begun = (words.initial >= 0) & (longer.initial >= 0)
    same: Paths = (words.initial[begun], longer.initial[begun], words.base[begun], longer.base[begun])
    edited: Paths = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    for d in range(length):
        _, label, target, skipped, _ = longer.arcs[d]
        p, q, i, j = same
        of, arc = longer.expand(d, q)  # the inserted label
        left, own = words.expand(d, p[of])  # the label that follows on the left, which differs
        ok = words.arcs[d][1][own] != label[arc][left]
        left, own = left[ok], own[ok]
        mid = target[arc][left]
        then = longer.find(d + 1, mid, words.arcs[d][1][own])
        ok = then >= 0
        left, own, then = left[ok], own[ok], then[ok]
        begun_here = (words.arcs[d][2][own], longer.arcs[d + 1][2][then], i[of][left] + words.arcs[d][3][own], j[of][left] + skipped[arc][left] + longer.arcs[d + 1][3][then])
        edited = _joined([_both(words, d, longer, d + 1, edited), begun_here])
        same = _both(words, d, longer, d, same)
    if at_end:
        _, q, i, j = same
        of, arc = longer.expand(length, q)
        edited = _joined([edited, (of, of, i[of], j[of] + longer.arcs[length][3][arc])])
    return edited[2], edited[3]


def compose(part: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its near words in its part and the row of the best (largest n, then the smallest word; -1: none).

    Rows are sorted by part, then by length, then by word."""
    rows = len(words)
    near, best = np.zeros(rows, dtype=np.int64), np.full(rows, rows, dtype=np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=rows)
    alphabetic = np.argsort(np.array([w.encode("latin-1") for w in words], dtype=object), kind="stable")
    order = alphabetic[np.argsort(-n[alphabetic], kind="stable")]
    rank = np.empty(rows, dtype=np.int64)
    rank[order] = np.arange(rows)

    def link(one: np.ndarray, two: np.ndarray) -> None:
        for a, b in ((one, two), (two, one)):
            near[:] += np.bincount(a, minlength=rows)
            np.minimum.at(best, a, rank[b])

    size, last = hi - lo, hi == m
    for width in np.unique(size).tolist():
        for end in (False, True):
            chosen = (size == width) & (last == end)
            acceptors, found = [], []
            n_parts = int(part[-1]) + 1
            for more in (0, 1):
                at = np.flatnonzero(chosen & (lengths - m == more))
                text = "".join([words[k][a : a + width + more] for k, a in zip(at.tolist(), lo[at].tolist(), strict=True)])
                codes = np.frombuffer(text.encode("latin-1"), dtype=np.uint8).astype(np.int64).reshape(len(at), width + more)
                found.append(at)
                acceptors.append(Acceptor(codes, part[at], n_parts))
            short, long = found
            one, two = replaced(acceptors[0], width)
            link(short[one], short[two])
            one, two = inserted(acceptors[0], acceptors[1], width, end)
            link(short[one], long[two])
    return near, np.where(best < rows, order[np.minimum(best, rows - 1)], -1)


def near_words(words: DataFrame, least_length: int = 7, most: int = 1 << 14, chunk: int = CHUNK) -> DataFrame:
    """words(word, n), each once, of code points below 256 and least_length of them at least -> word, n_near, best(n, word); no row for words that have none."""
    columns = ["m", "lo", "hi", "context", "word", "n"]
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            changed = np.zeros(len(table), dtype=bool)
            for c in columns[:4]:
                x = table[c].combine_chunks() if len(table) else table[c]
                changed[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            part = np.cumsum(changed)
            common = np.bincount(part)[part] > 1
            table, part = table.filter(pa.array(common)), part[common]
            if not len(table):
                return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
            part = np.unique(part, return_inverse=True)[1]
            m, lo, hi, n = (table[c].to_numpy().astype(np.int64) for c in ("m", "lo", "hi", "n"))
            near, best = compose(part, m, lo, hi, table["word"].to_pylist(), n)
            ok = np.flatnonzero(near)
            words, to = table["word"].combine_chunks(), pa.array(best[ok])
            return pa.RecordBatch.from_arrays([words.take(pa.array(ok)), pa.array(near[ok]), pa.array(n[best[ok]]), words.take(to)], schema=schema)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < chunk:
                continue
            table = pa.Table.from_batches(held)
            # the last part may go on in the next batch
            ends = [pc.not_equal(table[c], table[c][-1]).to_numpy() for c in columns[:4]]
            other = np.flatnonzero(np.logical_or.reduce(ends))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield solved(table.slice(0, cut))
                table = table.slice(cut)
                held, size = table.to_batches(), len(table)
        if size:
            yield solved(pa.Table.from_batches(held))

    rows = parts(words, least_length, most).repartition("m", "lo", "hi", "context").sortWithinPartitions("m", "lo", "hi", "context", F.length("word"), "word")
    pairs = rows.mapInArrow(composed, "word string, n_near long, best_n long, best string")
    # the smallest of (-n, word) has the largest n, then the smallest word
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), form more frequent than word -> word, root: what following forms from a word ends at.

    Each round doubles the steps taken, so a chain of k forms takes log2 k rounds; every table is stored."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("then"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_length: int = 7, least: int = 2, ratio: int = 10, most: int = 1 << 14) -> DataFrame:
    """docs(doc_id, text) -> a row per word of counted_words(): word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form: the near word of largest n (ties: the
    smallest in code-point order) if that is `ratio` times the word's n or more, else null; root: the end of the chain of forms, the word
    itself if it has none. Repeated rows count each, texts of any length are read whole, other columns are ignored; an empty table gives no rows.
    most: rows of a part that are composed in one task; larger parts are cut by the place of the edit, with the same result.
    """
    words = stored(counted_words(docs, least_length, least))
    near = near_words(words, least_length, most)
    judged = words.join(near, "word", "left")
    has = F.col("best.n") >= ratio * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, F.col("best.n")).alias("form_n")))
    found = roots(judged.filter("form is not null"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
