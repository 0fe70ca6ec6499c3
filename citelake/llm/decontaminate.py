"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Texts are compared lower-cased (A to Z) with runs of white space as one space. A text that holds an item of n
characters with at most e edits shares at least n - q + 1 - q e character q-grams with it, and their diagonals (place in
the text less place in the item) differ by at most e. So shared q-grams are counted in diagonal bands that overlap
by half, regions that reach the bound are kept, and a banded alignment decides. Lengths are in UTF-8 bytes.

The benchmark is read in blocks of bounded size; each is broadcast and meets all rows. An item of fewer than MIN_ITEM
bytes has too few q-grams for edits: it is found where its words stand consecutively, letter for letter.

A q-gram that an item and a text both repeat often is not laid out pair by pair: its places are counted by steps of the
diagonals, which may only raise a band's count, and regions that lie side by side are aligned together. So a long text of one
repeated character takes time in proportion to its length.

Defined cases: null and empty texts hold nothing; null and empty items are never found; equal items are all reported;
repeated rows give their own matches each; very long texts are searched in overlapping pieces; empty tables give no rows;
other columns, whatever their names, are ignored by find_leaks and kept by drop_leaks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, groups_of, prefix_sums, releasing, stretch_hash, word_hashes, words_in

Q = 12
#: Edits allowed for each byte of an item.
RATE = 0.06
#: Shared q-grams that a region must have at least; lowers the edits of short items.
LEAST_SHARED = 4
MIN_ITEM = 24
#: Bytes of benchmark text in one broadcast block.
BLOCK = 4 << 20
#: Bytes of text worked on at once.
PIECE = 1 << 20
_BITS = 22
#: Pairs of places of one q-gram beyond which they are counted by steps, and pairs laid out at once.
HEAVY = 1 << 14
PAIRS = 1 << 21
#: Diagonals aligned together at most.
WIDE = 1 << 13
#: Diagonals are kept above zero, in steps of an item.
_ORIGIN = 1 << 24


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8").lower().split())


def edit_budget(n: int, q: int = Q, rate: float = RATE) -> int:
    return max(0, min(int(rate * n), (n - q + 1 - LEAST_SHARED) // q))


@dataclass
class Index:
    """q-grams of the items: sorted hashes with their items and places, and a bit table for a first look."""

    ids: list
    items: list[bytes]
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    short: list[tuple]  # identifiers and bytes of the items below MIN_ITEM
    short_hashes: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted hashes, and the short items' places


def _sequence_hashes(data: bytes, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each so many consecutive words, and the byte where each begins."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = words_in(raw, np.array([0, len(raw)]))
    at = np.arange(max(0, len(starts) - many + 1))
    return stretch_hash(prefix_sums(word_hashes(raw, starts, ends)), at, at + many), starts[at]


def build_index(rows: list[tuple], q: int = Q, rate: float = RATE) -> Index:
    rows = [(i, t) for i, t in ((i, normalise(t)) for i, t in rows) if t]
    short, rows = [r for r in rows if len(r[1]) < max(MIN_ITEM, q)], [r for r in rows if len(r[1]) >= max(MIN_ITEM, q)]
    by_words: dict[int, list[tuple[int, int]]] = {}
    for k, (_, t) in enumerate(short):
        many = t.count(b" ") + 1
        by_words.setdefault(many, []).append((int(_sequence_hashes(t, many)[0][0]), k))
    short_hashes = {many: (np.array([h for h, _ in sorted(own)], np.uint64), np.array([k for _, k in sorted(own)])) for many, own in by_words.items()}
    items = [t for _, t in rows]
    grams, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, t in enumerate(items):
        at = np.arange(len(t) - q + 1)
        grams.append(stretch_hash(prefix_sums(BYTE[np.frombuffer(t, np.uint8)]), at, at + q))
        item.append(np.full(len(at), k))
        place.append(at)
    gram = np.concatenate(grams)
    order = np.argsort(gram, kind="stable")
    hashes, first = np.unique(gram[order], return_index=True)
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    size = np.array([len(t) for t in items], dtype=np.int64)
    budget = np.array([edit_budget(n, q, rate) for n in size], dtype=np.int64)
    return Index([i for i, _ in rows], items, hashes, np.append(first, len(gram)), np.concatenate(item)[order], np.concatenate(place)[order], seen, budget, size - q + 1 - q * budget, short, short_hashes)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    one, back = np.unique(np.concatenate(keys), return_inverse=True)
    return one, np.bincount(back, np.concatenate(counts), len(one)).astype(np.int64)


def shared_steps(index: Index, hit: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many q-grams are shared on each step of each item's diagonals; (item << 40) + step, ascending, and counts.

    hit, slot: places in the text and the index's q-grams there. A step holds budget + 1 diagonals. q-grams with many pairs
    of places count on both steps that they may fall on.
    """
    many = index.first[slot + 1] - index.first[slot]
    each = np.bincount(slot, minlength=len(index.hashes)) if len(slot) else np.zeros(0, np.int64)
    heavy = each[slot] * many > HEAVY
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(slot[heavy]).tolist():
        here, at = hit[slot == s], slice(index.first[s], index.first[s + 1])
        for k in np.unique(index.item[at]).tolist():
            step = int(index.budget[k]) + 1
            t, n = np.unique(here // step, return_counts=True)
            p, m = np.unique(index.place[at][index.item[at] == k] // step, return_counts=True)
            band = (k << 40) + (t[:, None] - p[None, :] + _ORIGIN).ravel()
            times = (n[:, None] * m[None, :]).ravel()
            keys += [band, band - 1]
            counts += [times, times]
            if sum(map(len, keys)) > PAIRS:
                keys, counts = ([x] for x in _counted(keys, counts))
    hit, slot, many = hit[~heavy], slot[~heavy], many[~heavy]
    total = np.concatenate([[0], np.cumsum(many)])
    start = 0
    while start < len(hit):
        end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 1)
        own = many[start:end]
        flat = np.repeat(index.first[slot[start:end]] - total[start:end], own) + np.arange(total[start], total[end])
        item = index.item[flat]
        diagonal = np.repeat(hit[start:end], own) - index.place[flat]
        one, count = np.unique((item << 40) + diagonal // (index.budget[item] + 1) + _ORIGIN, return_counts=True)
        keys.append(one)
        counts.append(count)
        if sum(map(len, keys)) > PAIRS:
            keys, counts = ([x] for x in _counted(keys, counts))
        start = end
    return _counted(keys, counts)


def regions(index: Index, raw: np.ndarray, q: int = Q) -> list[tuple[int, int, int]]:
    """(item, first diagonal, past the last diagonal) of the bands that reach their item's bound; those side by side are one."""
    if len(raw) < q or not index.items:
        return []
    at = np.arange(len(raw) - q + 1)
    gram = stretch_hash(prefix_sums(BYTE[raw]), at, at + q)
    hit = np.flatnonzero(index.seen[(gram >> np.uint64(64 - _BITS)).astype(np.int64)])
    slot = np.searchsorted(index.hashes, gram[hit])
    slot[slot == len(index.hashes)] = 0
    real = index.hashes[slot] == gram[hit]
    one, count = shared_steps(index, hit[real], slot[real])
    if not len(one):
        return []
    # each step is the first half of one band and the second half of another; a band's count is the sum of both
    one = np.concatenate([one, one - 1])
    one, both = _counted([one], [np.concatenate([count, count])])
    out: list[tuple[int, int, int]] = []
    for key in one[both >= index.bound[(one + 1) >> 40]].tolist():
        k = (key + 1) >> 40
        width = int(index.budget[k]) + 1
        first = (key - (k << 40) - _ORIGIN) * width
        if out and out[-1][0] == k and out[-1][2] >= first and first + 2 * width - out[-1][1] <= WIDE:
            out[-1] = (k, out[-1][1], first + 2 * width)
        else:
            out.append((k, first, first + 2 * width))
    return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits of the item against a stretch of the text, and the stretch's end; None over the budget.

    The stretch starts on a diagonal in [low, high] and the alignment stays on these diagonals.
    """
    width = high - low + 1
    cost = np.zeros(width, dtype=np.int64)
    over = most + 1
    padded = np.full(len(item) + width, -1, dtype=np.int64)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    slope = np.arange(width)
    start = np.arange(width) + low
    cost[(start < 0) | (start > len(text))] = over
    for i, symbol in enumerate(item.tolist()):
        here = padded[i : i + width]
        step = cost + (here != symbol)
        step[here < 0] = over
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - slope) + slope
        if cost.min() > most:
            return None
    end = low + slope + len(item)
    cost[end > len(text)] = over
    best = int(cost.argmin())
    return (int(cost[best]), int(end[best])) if cost[best] <= most else None


def matches(index: Index, data: bytes) -> dict[int, tuple[int, int, int]]:
    """item -> (edits, start, end) of its best match in a normalised text; ties go to the first."""
    best: dict[int, tuple[int, int, int]] = {}
    longest = max(map(len, index.items), default=0)
    for at in range(0, max(1, len(data)), PIECE):
        part = data[max(0, at - 2 * longest) : at + PIECE]
        base = max(0, at - 2 * longest)
        raw = np.frombuffer(part, np.uint8)
        for k, low, high in regions(index, raw):
            if k in best and best[k][0] == 0:
                continue  # found letter for letter further on the left
            got = _verify(index, k, part, raw, low, high)
            if got:
                got = (got[0], got[1] + base, got[2] + base)
                best[k] = min(best.get(k, got), got)
    return best


def _verify(index: Index, k: int, part: bytes, raw: np.ndarray, low: int, high: int):
    item, most = index.items[k], int(index.budget[k])
    exact = part.find(item, max(0, low), max(0, high) + len(item))
    if exact >= 0:
        return 0, exact, exact + len(item)
    pattern = np.frombuffer(item, np.uint8)
    got = align(pattern, raw, low - most, high - 1 + most, most)
    if got is None:
        return None
    edits, end = got
    back = align(pattern[::-1], raw[:end][::-1], 0, 0, most) if edits == 0 else align(pattern[::-1], raw[:end][::-1], -most, most, most)
    return edits, end - (back[1] if back else len(item)), end


def _short_matches(index: Index, texts: list[bytes]):
    """(row, identifier, 0, start, end) of the first place of each short item in each text."""
    for many, (hashes, items) in index.short_hashes.items():
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        gram, at = _sequence_hashes(b" ".join(texts), many)
        low, high = np.searchsorted(hashes, gram), np.searchsorted(hashes, gram, side="right")
        seen = set()
        for j in np.flatnonzero(high > low).tolist():
            r = int(np.searchsorted(starts, at[j], side="right")) - 1
            place = int(at[j] - starts[r])
            for k in items[low[j] : high[j]].tolist():
                name, item = index.short[k]
                if (r, k) not in seen and texts[r][place : place + len(item)] == item and texts[r][place + len(item) : place + len(item) + 1] in (b"", b" "):
                    seen.add((r, k))
                    yield r, name, 0, place, place + len(item)


def _search(index: Index, texts: list[bytes]):
    """(row, item's identifier, edits, start, end) over many texts: bands are looked for in all of them together."""
    for r, k, *match in _long_matches(index, texts):
        yield r, index.ids[k], *match
    for i, j in groups_of(np.array([len(t) for t in texts]), PIECE) if index.short else ():
        for r, *match in _short_matches(index, texts[i:j]):
            yield i + r, *match


def _long_matches(index: Index, texts: list[bytes]):
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < PIECE):
            total += len(texts[j]) + 1
            j += 1
        if j - i == 1:
            yield from ((i, k, *m) for k, m in sorted(matches(index, texts[i]).items()))
        else:
            whole = b"\x00".join(texts[i:j])
            starts = np.cumsum([0, *[len(t) + 1 for t in texts[i : j - 1]]])
            rows = set()
            for _, low, high in regions(index, np.frombuffer(whole, np.uint8)):
                rows.update(range(max(0, int(np.searchsorted(starts, low, side="right")) - 1), int(np.searchsorted(starts, high, side="right"))))
            for r in sorted(rows):
                yield from ((i + r, k, *m) for k, m in sorted(matches(index, texts[i + r]).items()))
        i = j


def _blocks(benchmark: DataFrame, key: str):
    """Indexes over blocks of the benchmark; only one is on the driver at a time."""
    rows = benchmark.select(F.col(key).cast("long").alias("item_id"), "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK)
    for b in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield build_index(sorted((tuple(r) for r in part.collect()), key=repr))


MATCHES = "doc_id long, item_id long, edits int, start long, end long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """doc_id, item_id, edits, start and end (bytes of the normalised text) of each item's best match in each document."""
    lean = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").filter("text is not null")
    out = None
    for index in _blocks(benchmark, key):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = list(_search(index, [normalise(t) for t in batch.column(1).to_pylist()]))
                cols = [[ids[f[0]] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found]]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

        part = lean.mapInArrow(releasing(run), MATCHES)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """docs without those that hold a benchmark item."""
    out = docs
    for index in _blocks(benchmark, key):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        place = docs.columns.index("text")

        def run(batches, shared=shared):
            for batch in batches:
                bad = {f[0] for f in _search(shared.value, [normalise(t) for t in batch.column(place).to_pylist()])}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(releasing(run), docs.schema)
    return out
