"""Packing into few sequences by bin completion (Korf 2002; Martello and Toth 1990).

Documents become token ids; only longer ones are cut, from their end, so that all pieces but the
first are full. Lengths are exact, so the histogram of piece lengths has at most `room` rows
whatever the corpus, and only it reaches the driver. There a branch-and-bound takes the largest
length left, enumerates the undominated fillings of the room beside it and repeats the chosen one
as often as the stock allows. A branch ends where its waste, or the bound of Martello and Toth on
what is left, cannot beat the incumbent; best-fit decreasing gives the incumbents. Pieces are ranked
inside their length in a distributed way (rank in a hash slice plus the counts of earlier slices);
the rank tells a piece's sequence and its place there, so no sequence is gathered anywhere.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .wordpiece import byte_table

#: Rows of a length that are ranked together.
SLICE_ROWS = 512
#: Texts on whose classes of characters all libraries agree.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\u00c0-\u024f]*")
#: Fixed value: the split of byte-level vocabularies that have `use_regex`.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Plan = list[tuple[int, dict[int, int]]]


class ByteIds:
    """Ids of texts by a byte-level tokenizer, as little-endian unsigned 32-bit bytes.

    PLAIN texts without a special token are encoded by `tiktoken` with the same merges, which is several times faster, where the
    vocabulary is in the order of its merges; all others by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens") or []]
        pre = model.get("pre_tokenizer") or {}
        if model.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model.get("post_processor"):
            return
        table = byte_table()
        ids = {bytes(table[c] for c in p): i for p, i in model["model"]["vocab"].items() if all(c in table for c in p)}
        order = [ids.get(bytes(table[c] for c in "".join(m if isinstance(m, list) else m.split(" "))), -1) for m in model["model"]["merges"]]
        if order == sorted(order) and sorted(v for k, v in ids.items() if len(k) == 1) == list(range(256)) and len(ids) == 256 + len(set(order)) and min(order) > 255:
            import tiktoken

            self.fast = tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=1)
def byte_ids(path: str) -> ByteIds:
    """One per Python worker, kept from task to task."""
    return ByteIds(path)


def tokenize(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> a row per piece: doc_id, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit) unless with_ids is false.

    A document of more than `room` ids is cut into pieces of `room`, of which the first may be shorter. Null and empty texts give
    the end id alone. Repeated doc_ids give pieces each. Texts of any length are read whole. Other columns are ignored.
    """
    end = array("I", [end_id]).tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_ids(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            held = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.ids(text.as_py()) + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % room + 1
                for k in range((n + room - 1) // room):
                    part = ids[4 * start : 4 * stop]
                    for column, v in zip(rows, (i, k, start, stop - start, zlib.crc32(part), part), strict=False):
                        column.append(v)
                    start, stop = stop, stop + room
                held += len(ids)
                if with_ids and held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, held = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, kinds)


def least_bins(counts: np.ndarray, room: int) -> int:
    """Bound of Martello and Toth on the bins of counts[size]: for every cut k, sizes over room - k stand alone, those over half share no bin with each other."""
    sizes = np.arange(room + 1)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])  # below a size
    half = room // 2 + 1
    best = -(-int(s[-1]) // room)
    k = np.arange(room // 2 + 1)
    alone, over = n[-1] - n[room - k + 1], n[room - k + 1] - n[half]
    free = over * room - (s[room - k + 1] - s[half])
    small = s[half] - s[k]
    return max(best, int((alone + over + np.maximum(0, -(-(small - free) // room))).max()))


def best_fit(counts: np.ndarray, room: int) -> Plan:
    """Best-fit decreasing on counts[size]; equal bins are kept together with their number."""
    left: dict[int, list[list]] = {}  # room left -> [bins, held]
    full: Plan = []
    for s in range(room, 0, -1):
        n = int(counts[s])
        while n:
            r = next((r for r in range(s, room) if left.get(r)), None)
            bins, held = left[r].pop() if r is not None else [n, {}]
            r = room if r is None else r
            each = min(r // s, n)
            times = min(bins, n // each)
            if times < bins and held:
                left.setdefault(r, []).append([bins - times, held])
            n -= times * each
            now = held | {s: each}
            if r - s * each:
                left.setdefault(r - s * each, []).append([times, now])
            else:
                full.append((times, now))
    return full + [(b, h) for same in left.values() for b, h in same if b]


def fillings(counts: np.ndarray, free: int, width: int) -> Iterator[dict[int, int]]:
    """Undominated fillings {size: number} of `free`, fullest first and then with the largest sizes first; `width` at most.

    One is dominated where a size that is left fits in place of a smaller one or beside all, or where a size that is left is the sum
    of two held: the other filling is as full and leaves the smaller sizes for later.
    """
    if free > 0 and counts[free] > 0:
        yield {free: 1}
        return
    sizes = [int(a) for a in np.flatnonzero(counts[: free + 1]) if a]
    if not sizes:
        yield {}
        return
    mask = (1 << (free + 1)) - 1
    reach = [1]  # bit t of entry j: t is a sum of the first j sizes
    for a in sizes:
        bits, n, k = reach[-1], min(int(counts[a]), free // a), 1
        while n:
            take = min(k, n)
            bits |= (bits << (a * take)) & mask
            n, k = n - take, 2 * k
        reach.append(bits)

    def exact(t: int, j: int, held: dict[int, int]) -> Iterator[dict[int, int]]:
        if not t:
            yield dict(held)
            return
        for i in range(min(j, bisect_right(sizes, t)), 0, -1):
            if not reach[i] >> t & 1:
                return
            a = sizes[i - 1]
            for x in range(min(int(counts[a]), t // a), 0, -1):
                if reach[i - 1] >> (t - x * a) & 1:
                    held[a] = x
                    yield from exact(t - x * a, i - 1, held)
                    del held[a]

    given = tried = 0
    for t in range(free, -1, -1):
        if not reach[-1] >> t & 1:
            continue
        gap = free - t
        for f in exact(t, len(sizes), {}):
            tried += 1
            rest = lambda a: counts[a] > f.get(a, 0)  # noqa: B023, E731
            items = sorted(f)
            swap = any(rest(b) for a in [0, *items] for b in range(a + 1, min(free, a + gap) + 1))
            pair = any(a + b <= free and rest(a + b) for k, a in enumerate(items) for b in items[k:] if a != b or f[a] > 1)
            if not swap and not pair:
                given += 1
                yield f
            if given >= width or tried >= 20 * width:
                return


def bin_completion(histogram: dict[int, int], room: int, width: int = 6, max_nodes: int = 3000) -> Plan:
    """histogram: size -> count. Patterns (times, {size: count}) that hold every item exactly once, in as few bins as the search finds.

    width and max_nodes bound the search, never the items: where they end it, the best incumbent is the plan. A plan of
    least_bins() bins is known to be optimal and ends the search at once.
    """
    counts = np.zeros(room + 1, dtype=np.int64)
    for s, n in histogram.items():
        counts[s] = n
    total, least = int((counts * np.arange(room + 1)).sum()), least_bins(counts, room)
    best = best_fit(counts, room)
    bins = sum(t for t, _ in best)

    def node(counts: np.ndarray, plan: Plan, used: int, waste: int) -> tuple:
        largest = int(np.flatnonzero(counts)[-1])
        one = counts.copy()
        one[largest] -= 1
        return counts, plan, used, waste, largest, fillings(one, room - largest, width)

    stack = [node(counts, [], 0, 0)] if total else []
    nodes = 0
    while stack and bins > least and nodes < max_nodes:
        counts, plan, used, waste, largest, more = stack[-1]
        f = next(more, None)
        if f is None:
            stack.pop()
            continue
        nodes += 1
        held = dict(f)
        held[largest] = held.get(largest, 0) + 1
        times = min(int(counts[s]) // n for s, n in held.items())
        rest = counts.copy()
        for s, n in held.items():
            rest[s] -= times * n
        used += times
        waste += times * (room - sum(s * n for s, n in held.items()))
        if waste > (bins - 1) * room - total or used + least_bins(rest, room) >= bins:
            continue
        plan = [*plan, (times, held)]
        if not rest.any():
            best, bins = plan, used
            continue
        if len(plan) % 32 == 1:
            tail = best_fit(rest, room)
            if used + sum(t for t, _ in tail) < bins:
                best, bins = plan + tail, used + sum(t for t, _ in tail)
        stack.append(node(rest, plan, used, waste))
    return best


def assign(pieces: DataFrame, room: int = 1024, width: int = 6, max_nodes: int = 3000) -> DataFrame:
    """pieces(row, length, ...), row unique -> the same columns with sequence_id and offset; gapless in every sequence of at most `room`.

    `pieces` is read several times, so store it first. Only the histogram of lengths (at most `room` rows) reaches the driver.
    Full pieces are a sequence each. Of equal lengths the order of slices and rows decides. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    plan = bin_completion({s: n for s, n in histogram.items() if s < room}, room, width, max_nodes)
    used, slots, first = dict.fromkeys(histogram, 0), [], 0
    for times, held in plan:
        at = 0
        for size in sorted(held, reverse=True):
            slots.append((size, used[size], used[size] + times * held[size], held[size], first, at))
            used[size] += times * held[size]
            at += size * held[size]
        first += times
    whole = pieces.filter(F.col("length") == room).withColumns({"sequence_id": first + F.col("row"), "offset": F.lit(0).cast("long")})
    slices = spark.createDataFrame([(s, max(1, n // SLICE_ROWS)) for s, n in histogram.items() if s < room], "length long, __slices long")
    places = spark.createDataFrame(slots, "length long, __from long, __to long, __each long, __first long, __at long")
    # both have a bound in the room: a row for each length; for each pattern and length in it
    sliced = pieces.join(F.broadcast(slices), "length").withColumn("__slice", F.pmod(F.xxhash64("row"), "__slices"))
    counted = sliced.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    before = counted.select("length", "__slice", F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = sliced.withColumn("__in", F.row_number().over(Window.partitionBy("length", "__slice").orderBy("row")) - 1).join(before, ["length", "__slice"]).withColumn("__rank", F.col("__in") + F.col("__before"))
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).drop(places["length"])
    at = F.col("__rank") - F.col("__from")
    placed = placed.withColumns({"sequence_id": F.col("__first") + F.expr("(__rank - __from) div __each"), "offset": F.col("__at") + at % F.col("__each") * F.col("length")})
    columns = [*pieces.columns, "sequence_id", "offset"]
    return placed.select(columns).unionByName(whole.select(columns))


def pack_few(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, with_ids: bool = True, width: int = 6, max_nodes: int = 3000) -> DataFrame:
    """Token pieces of all docs(doc_id, text) and their places: doc_id, piece, start, length, ids_crc32, ids (unless with_ids is false), sequence_id, offset.

    Nulls, repeats, long texts and other columns as in tokenize(); an empty table gives no pieces.
    """
    pieces = stored(tokenize(docs, tokenizer, room, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()))
    placed = assign(pieces.drop("ids"), room, width, max_nodes)
    if with_ids:  # ids are shuffled once, not with every step
        placed = placed.join(pieces.select("row", "ids"), "row")
    return placed.drop("row")
