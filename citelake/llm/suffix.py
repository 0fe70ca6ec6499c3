"""Suffix-array dedup: byte strings of a minimum length that occur twice, by threshold-bounded interval expansion.

Stretches that may hold repeated strings are brought together by key (see runs). Each shard of them gets a
Burrows-Wheeler transform, and breadth-first backward extension of intervals settles the common prefixes of
neighbouring suffixes by increasing value; it stops at the minimum length, so neighbours left unsettled share at
least that much. The suffixes need to be in order up to that length only. Equal stretches are read at two of their
places, compared byte by byte, and are one text of the transform with the number of places as its weight: an interval of
weight two or more holds a repeated string, and nothing else decides.

Defined cases: null and empty texts lose nothing; a text shorter than the length loses nothing; repeated rows are
texts of their own, so they lose all that the length allows; ids may be null; very long texts are worked on in
overlapping pieces, so that each window is in one of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, cut, mix, releasing, runs_by_minimum, sliding_min
from .runs import by_key, byte_items, covered, keyed, runs, shared_runs, spans_from, with_documents, with_parts

#: Bytes of each gram whose hash keys a window.
GRAM = 180
#: Bytes of one shard's transform.
SHARD = 1 << 17
#: Tasks for the transforms, for each shuffle partition.
TASKS = 4
#: Bytes under one key beyond which it is dealt out by further minima.
HOT = 1 << 19


# ---------------------------------------------------------------- the transform


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` symbols at least, by prefix doubling.

    Each round sorts only the positions that still tie with others; equal ones may come in any order.
    """
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n + 1, dtype=bool)
    fresh[1:n] = key[1:] != key[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    place, reach = np.arange(n), 8
    rank[order] = np.maximum.accumulate(np.where(fresh[:n], place, 0))
    while reach < depth:
        tied = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(tied):
            break
        if 2 * len(tied) > n:  # as good as all: keys are made in the order of the text
            key = rank[:n] * (n + 2)
            key[: n - reach] += rank[reach:n] + 1
            order = np.argsort(key)
            key = key[order]
            fresh[1:n] = key[1:] != key[:-1]
            rank[order] = np.maximum.accumulate(place * fresh[:n])
        else:
            own = order[tied]
            key = rank[own] * (n + 2) + rank[np.minimum(own + reach, n)] + 1
            by = np.argsort(key)
            order[tied], key = own[by], key[by]
            fresh[tied[1:]] |= key[1:] != key[:-1]
            rank[order[tied]] = np.maximum.accumulate(tied * fresh[tied])
        reach *= 2
    return order


class _Transform:
    """A Burrows-Wheeler transform, with the steps from its places to those of the suffixes one symbol longer.

    Place b is a boundary once the common prefix of the suffixes at b - 1 and b is known.
    """

    def __init__(self, codes: np.ndarray, order: np.ndarray):
        n = self.n = len(codes)
        self.last = codes[order - 1]
        self.front = np.argsort(self.last, kind="stable")
        self.longer = np.empty(n, dtype=np.int64)
        self.longer[self.front] = np.arange(n)
        self.symbol = self.last[self.front]
        begins = np.ones(n + 1, dtype=bool)  # of the blocks of suffixes with one first symbol
        begins[1:n] = self.symbol[1:] != self.symbol[:-1]
        self.boundary = begins
        self.before = np.where(begins[self.longer], -1, self.front[self.longer - 1])  # the place before with the same symbol
        self.after = np.where(begins[self.longer + 1], n, self.front[(self.longer + 1) % n])
        self.before[self.last == 0], self.after[self.last == 0] = n, -1  # the separator extends nothing

    def settle_all(self, most: int, few: int) -> tuple[int, np.ndarray]:
        """Settles boundaries by increasing common prefix, all at once, up to `most` or until fewer than `few` are new.

        The last of a symbol before a boundary and the first after it are neighbours one symbol longer.
        """
        open_ = np.flatnonzero(~self.boundary[:-1] & (self.symbol != 0))
        level, new = 0, np.flatnonzero(self.boundary[1:-1]) + 1
        while level < most and len(new) and (level < 4 or len(new) >= few):
            met = np.cumsum(self.boundary[:-1])
            hit = met[self.front[open_]] > met[self.front[open_ - 1]]
            new, open_ = open_[hit], open_[~hit]
            self.boundary[new] = True
            level += 1
        return level, new

    def extended(self, low: np.ndarray, high: np.ndarray, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """The intervals one symbol longer than those given, but for the separator's."""
        sigma = int(self.symbol[-1])
        wide = high - low > 4 * sigma
        lows, highs = [], []
        if wide.any():  # asks for every symbol
            at = np.arange(1, sigma + 1) * self.n
            places = self.symbol.astype(np.int64) * self.n + self.front
            a, b = (np.searchsorted(places, (x[wide][:, None] + at).ravel()) for x in (low, high))
            lows.append(a[b > a])
            highs.append(b[b > a])
            low, high = low[~wide], high[~wide]
        total = np.concatenate([[0], np.cumsum(high - low)])
        start = 0
        while start < len(low):  # looks at every place
            end = max(start + 1, int(np.searchsorted(total, total[start] + chunk, side="right")) - 1)
            many = high[start:end] - low[start:end]
            row = np.repeat(np.arange(start, end), many)
            place = (low - total[:-1])[row] + np.arange(total[start], total[end])
            lows.append(np.sort(self.longer[place[self.before[place] < low[row]]]))
            highs.append(np.sort(self.longer[place[self.after[place] >= high[row]]]) + 1)
            start = end
        return (np.concatenate(lows), np.concatenate(highs)) if lows else (low, high)


def long_neighbours(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in order, whether the suffix there shares `depth` symbols or more with the next place's.

    codes: 0 separates texts and ends the whole. While common prefixes are short, most boundaries are new and all are looked
    at; then only the intervals that end at a new one are extended, breadth first.
    """
    t = _Transform(codes, order)
    level, high = t.settle_all(depth - 1, max(1, t.n >> 7))
    if level < depth - 1 and len(high):
        edge = np.maximum.accumulate(np.where(t.boundary, np.arange(t.n + 1), 0))
        low = edge[high - 1]
        for _ in range(level, depth - 1):
            if not len(high):
                break
            low, high = t.extended(low, high)
            new = ~t.boundary[high]
            low, high = low[new], high[new]
            t.boundary[high] = True
    return ~t.boundary[1:]


def repeated_windows(texts: list[bytes], length: int, weights: list[int] | None = None) -> list[np.ndarray]:
    """For each text, which of its windows of `length` bytes start at another place of any text as well.

    weights: in how many places each text stands; windows count as often.
    """
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    symbols = np.unique(raw)
    code = np.zeros(256, dtype=np.uint8)
    code[symbols] = np.arange(1, len(symbols) + 1)
    sizes = np.array([len(t) + 1 for t in texts])
    codes = np.zeros(len(raw) + len(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    inner = np.ones(len(codes), dtype=bool)
    inner[ends - 1] = False
    codes[inner] = code[raw]
    order = suffix_order(codes, length + 1)
    next_ = long_neighbours(codes, order, length)
    interval = np.concatenate([[0], np.cumsum(~next_[:-1])])
    weight = np.repeat(np.ones(len(texts), np.int64) if weights is None else np.array(weights, dtype=np.int64), sizes)
    twice = np.empty(len(codes), dtype=bool)
    twice[order] = (np.bincount(interval, weight[order]) >= 2)[interval]
    return [twice[e - 1 - len(t) : e - length] if len(t) >= length else np.zeros(0, bool) for e, t in zip(ends, texts, strict=True)]


# ---------------------------------------------------------------- dealing


def _minima(data: bytes, length: int, seed: int) -> np.ndarray:
    """For each window, the least hash of its grams under another hash function."""
    items = mix(BYTE[np.frombuffer(data, np.uint8)] + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    gram = 24
    h, reach = items, 1
    while reach * 2 <= gram:
        h = mix(h[: len(h) - reach] * np.uint64(31) + h[reach:])
        reach *= 2
    return sliding_min(h, length - reach + 1)


def divide(data: bytes, length: int, rounds: int, first_seed: int = 1) -> list[tuple[int, int, int]]:
    """Splits a stretch's windows into runs (first window, number, key) by several minima together."""
    if len(data) < length:
        return []
    key = np.zeros(len(data) - length + 1, dtype=np.uint64)
    for r in range(rounds):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + _minima(data, length, first_seed + r))
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    return [(int(a), int(b - a), int(key[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _decide(texts: list[bytes], weights: list[int], length: int, seed: int = 9) -> list[np.ndarray]:
    """repeated_windows() of distinct texts; a large lot is divided by further minima, where equal pieces count together."""
    if sum(map(len, texts)) <= 2 * SHARD or seed >= 17 or len(texts) < 2:
        return repeated_windows(texts, length, weights)
    parts: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for i, text in enumerate(texts):
        for a, n, key in divide(text, length, 2, seed):
            parts.setdefault(key, {}).setdefault(text[a : a + n + length - 1], []).append((i, a))
    flags = [np.zeros(max(0, len(t) - length + 1), dtype=bool) for t in texts]
    held: dict[bytes, list[tuple[int, int]]] = {}
    groups = list(parts.values())
    for k, group in enumerate(groups):
        held |= group  # equal pieces have equal keys, so groups share none
        if k == len(groups) - 1 or sum(map(len, held)) >= SHARD:
            many = [sum(weights[i] for i, _ in places) for places in held.values()]
            for (piece, places), f in zip(held.items(), _decide(list(held), many, length, seed + 2), strict=True):
                for i, a in places:
                    flags[i][a : a + len(piece) - length + 1] = f
            held = {}
    return flags


def decide_rows(rows: list[dict], length: int):
    """(row, flags of its windows) for the rows of some keys; all rows with a window of theirs are among them.

    Rows of the same bytes are one text of the transform; weight (else 1) says how many places a row stands for.
    """
    places: dict[bytes, list[int]] = {}
    for i, r in enumerate(rows):
        places.setdefault(r["data"], []).append(i)
    weights = [sum(rows[i].get("weight", 1) for i in own) for own in places.values()]
    for own, f in zip(places.values(), _decide(list(places), weights, length), strict=True):
        for i in own:
            yield rows[i], f


SPANS = "array<struct<a:int,b:int>>"


def repeat_spans(docs: DataFrame, length: int) -> DataFrame:
    """id, th and spans (first and past-the-last window starts) of keyed documents' windows that occur elsewhere too."""
    found = cut(runs(docs, byte_items, length, GRAM))
    found = cut(shared_runs(found, F.col("n_rows") > 1))
    place = F.struct("id", "th", "start")
    distinct = cut(found.groupBy("key", "dig", "n").agg(F.count("*").alias("copies"), F.min(place).alias("at"), F.max(place).alias("last")))
    distinct = with_parts(distinct, F.col("n") + length, HOT)
    run = ["key", "dig", "n", "parts"]
    one = distinct.select("at.*", *run, F.greatest(F.col("copies") - 1, F.lit(1)).alias("weight"), F.lit(True).alias("tells"))
    other = distinct.filter("copies > 1").select("last.*", *run, F.lit(1).cast("long").alias("weight"), F.lit(False).alias("tells"))
    asked = one.unionByName(other).groupBy("id", "th").agg(F.collect_list(F.struct("start", *run, "weight", "tells")).alias("asked"))
    dealt = pa.schema([("deal", pa.int64()), ("key", pa.int64()), ("dig", pa.int64()), ("n", pa.int32()), ("weight", pa.int64()), ("tells", pa.bool_()), ("off", pa.int32()), ("data", pa.binary())])
    verdicts = pa.schema([("key", pa.int64()), ("dig", pa.int64()), ("n", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def fetch(batches):
        for batch in batches:
            out = []
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8")
                for x in asked.as_py():
                    part = data[x["start"] : x["start"] + x["n"] + length - 1]
                    own = {k: x[k] for k in ("key", "dig", "n", "weight", "tells")}
                    if x["parts"] == 1:
                        out.append({"deal": x["key"], "off": 0, "data": part, **own})
                    else:
                        for a, n, k in divide(part, length, 1 + (x["parts"] - 1).bit_length()):
                            out.append({"deal": (x["key"] ^ k) % (1 << 62), "off": a, "data": part[a : a + n + length - 1], **own})
                    if len(out) >= 5_000:
                        yield pa.RecordBatch.from_pylist(out, schema=dealt)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=dealt)

    def settle(batches):
        for rows in by_key(batches, lambda r: len(r["data"]), SHARD):
            out = []
            for r, flags in decide_rows(rows, length):
                if r["tells"] and flags.any():
                    out.append({"key": r["key"], "dig": r["dig"], "n": r["n"], "spans": [{"a": s["a"] + r["off"], "b": s["b"] + r["off"]} for s in spans_from(flags)]})
            yield pa.RecordBatch.from_pylist(out, schema=verdicts)

    stretches = with_documents(docs, asked, "inner").select("text", "asked").mapInArrow(releasing(fetch), "deal long, key long, dig long, n int, weight long, tells boolean, off int, data binary")
    # a number of its own: sorting and extending take far longer than the bytes, by which partitions are merged, tell
    tasks = TASKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = cut(stretches.repartition(tasks, "deal").sortWithinPartitions("deal").mapInArrow(releasing(settle), f"key long, dig long, n int, spans {SPANS}"))
    gone = found.join(settled, ["key", "dig", "n"]).select("id", "th", "start", F.explode("spans").alias("s"))
    return gone.groupBy("id", "th").agg(F.collect_list(F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay) and removed (start and end of each maximal run that goes)."""
    texts = keyed(docs)
    spans = repeat_spans(texts, length)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("th", F.xxhash64("text"))
    joined = with_documents(joined, spans, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def run(batches):
        for batch in batches:
            cols = [[], [], []]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py().encode("utf-8")
                gone = []
                cols[0].append(len(data))
                if spans:
                    mask = covered(spans, length, len(data))
                    gone = spans_from(mask)
                    data = np.frombuffer(data, np.uint8)[~mask].tobytes()
                cols[1].append(data)
                cols[2].append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return joined.mapInArrow(releasing(run), f"doc_id long, n_bytes long, kept binary, removed {SPANS}")
