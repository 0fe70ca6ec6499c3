"""SimHash near-dedup by a binary trie self-join.

A document's fingerprint has a bit set where over half of its features' 64-bit hashes have it. Distinct
fingerprints are dealt out under every choice of exact bit blocks (at most `budget` differing bits leave that many
blocks alone at least), and within one choice a binary trie over the remaining bits is joined with itself: pairs
of nodes descend together, differing bits add up, and a pair over the budget is dropped with everything below it.
Pairs whose leaves already hang together are dropped too, so a task gives a spanning forest of links, never all pairs
of a dense group; components are the same.

Defined cases: null and empty texts have fingerprint zero and link like any other; a text with fewer words than a
shingle is one feature; a null doc_id takes part but never names a component; repeated rows get equal results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, groups_of, prefix_sums, releasing, stretch_hash, text_bytes, word_hashes, words_in
from .graph import components
from .runs import FEW, keyed

SEED = 42
#: Distinct fingerprints a group of one exact choice should hold on average, at most. Below that, comparing within
#: groups costs less than the rows of one more choice of blocks.
GROUP = 1024
#: Bytes of text whose shingles are worked on at once.
PIECE = 1 << 20
#: Slots of the hash space (by its top bits) in which shingles are counted for the order of prefixes.
SLOTS = 1 << 20
SLOT_SHIFT = np.uint64(44)
#: Words (of 64 bits) of a text's parity marks, and neighbours by size that a text is first compared with.
MARKS = 4
NEIGHBOURS = 16


# ---------------------------------------------------------------- fingerprints


def features(text: bytes, shingle: int) -> list[bytes]:
    """Shingles of that many lower-cased words, repeats included; with shingle 0 the distinct words."""
    words = text.lower().split()
    if shingle == 0:
        return list(set(words))
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [whole[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def _hash_bytes(feats: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh64_digest, feats, repeat(SEED)))


def majority(hashes: bytes) -> int:
    """The fingerprint of 8-byte big-endian hashes, as an unsigned number."""
    n = len(hashes) // 8
    if not n:
        return 0
    count = np.zeros(64, dtype=np.int64)
    table = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    for i in range(0, n, 255):  # sums of 255 bits fit a byte
        count += np.add.reduce(np.unpackbits(table[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(_hash_bytes(features((text or "").encode("utf-8"), shingle)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed number."""

    def run(batches):
        for batch in batches:
            out = [_signed(fingerprint(v.as_py(), shingle)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(releasing(run), "doc_id long, fp long")


# ---------------------------------------------------------------- the trie


def block_choices(budget: int, blocks: int) -> list[tuple[list[int], int]]:
    """For each choice of blocks that must agree: the order of the 64 bits with those first, and their number."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for exact in combinations(range(blocks), blocks - budget):
        rest = [b for b in range(blocks) if b not in exact]
        bits = [i for b in (*exact, *rest) for i in range(edges[b], edges[b + 1])]
        out.append((bits, sum(edges[b + 1] - edges[b] for b in exact)))
    return out


def choose_blocks(distinct: int, budget: int) -> int:
    """The fewest blocks whose exact part leaves groups of GROUP fingerprints on average."""
    blocks = budget + 1
    while blocks < budget + 4 and distinct / 2 ** (64 * (blocks - budget) // blocks) > GROUP:
        blocks += 1
    return blocks


def permute(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out, i = np.zeros_like(values), 0
    while i < 64:  # whole runs of neighbouring bits move together
        j = i
        while j + 1 < 64 and bits[j + 1] == bits[j] + 1:
            j += 1
        width = j - i + 1
        part = values >> np.uint64(64 - bits[i] - width)
        if width < 64:
            part &= np.uint64((1 << width) - 1)
        out |= part << np.uint64(64 - i - width)
        i = j + 1
    return out


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []
        self._mark()

    def _mark(self) -> None:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        self.change = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def add(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        """Links the ends of pairs that are not yet together, nearest pairs first."""
        a, b = self.root[i], self.root[j]
        m = a != b
        if not m.any():
            return
        i, j, apart, a, b = i[m], j[m], apart[m], a[m], b[m]
        order = np.lexsort((j, i, apart))
        low, high = np.minimum(a, b)[order], np.maximum(a, b)[order]
        _, first = np.unique(low * len(self.root) + high, return_index=True)
        for k in order[np.sort(first)].tolist():
            x, y = self._find(int(i[k])), self._find(int(j[k]))
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((int(i[k]), int(j[k])))
        self._mark()

    def joined(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether all leaves of both ranges hang together already."""
        whole = (self.change[a1 - 1] == self.change[a0]) & (self.change[b1 - 1] == self.change[b0])
        return whole & (self.root[a0] == self.root[b0])


def trie_links(values: np.ndarray, exact: int, budget: int, chunk: int = 1 << 16, leaf: int = 64) -> list[tuple[int, int]]:
    """Spanning links (positions) of the graph of sorted distinct values that differ in at most `budget` bits.

    Only values whose first `exact` bits agree are compared.
    """
    n = len(values)
    if n < 2:
        return []
    forest = _Forest(n)
    prefix = values >> np.uint64(64 - exact) if exact else np.zeros(n, np.uint64)
    near = np.arange(n - 1)
    d = np.bitwise_count(values[1:] ^ values[:-1])
    m = (prefix[1:] == prefix[:-1]) & (d <= budget)
    forest.add(near[m], near[m] + 1, d[m])
    cuts = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [n]])
    lo, hi = cuts[:-1], cuts[1:]
    m = hi - lo > 1
    lo, hi = lo[m], hi[m]
    stack = [(exact, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > chunk:
            stack.append((depth, a0[chunk:], a1[chunk:], b0[chunk:], b1[chunk:], diff[chunk:]))
            a0, a1, b0, b1, diff = a0[:chunk], a1[:chunk], b0[:chunk], b1[:chunk], diff[:chunk]
        m = ~forest.joined(a0, a1, b0, b1)
        a0, a1, b0, b1, diff = a0[m], a1[m], b0[m], b1[m], diff[m]
        if not len(a0):
            continue
        many = (a1 - a0) * (b1 - b0)
        small = many <= leaf if depth < 64 else np.ones(len(a0), bool)
        if small.any():  # few leaves: compare them outright
            k = np.repeat(np.flatnonzero(small), many[small])
            at = np.arange(len(k)) - np.repeat(np.cumsum(many[small]) - many[small], many[small])
            wide = (b1 - b0)[k]
            i, j = a0[k] + at // wide, b0[k] + at % wide
            d = np.bitwise_count(values[i] ^ values[j])
            m = (i < j) & (d <= budget)
            forest.add(i[m], j[m], d[m])
        big = ~small
        if not big.any():
            continue
        a0, a1, b0, b1, diff = a0[big], a1[big], b0[big], b1[big], diff[big]
        bit = np.uint64(1) << np.uint64(63 - depth)
        high = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        split = lambda lo: np.searchsorted(values, (values[lo] & high) | bit)
        am, bm = np.clip(split(a0), a0, a1), np.clip(split(b0), b0, b1)
        same = a0 == b0
        parts = [(a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None), (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, ~same)]
        kept = [[] for _ in range(5)]
        for p0, p1, q0, q1, apart, only in parts:
            m = (p1 > p0) & (q1 > q0) & (apart <= budget)
            m &= ~((p0 == q0) & (p1 - p0 == 1))
            if only is not None:
                m &= only
            for out, x in zip(kept, (p0, p1, q0, q1, apart), strict=True):
                out.append(x[m])
        stack.append((depth + 1, *[np.concatenate(x) for x in kept]))
    return forest.links


def similar_links(distinct: DataFrame, budget: int, count: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs within the budget."""
    choices = block_choices(budget, choose_blocks(count, budget))

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (bits, exact) in enumerate(choices):
                key = permute(fp, bits) >> np.uint64(64 - exact)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key.astype(np.int64)), pa.array(fp.view(np.int64))], names=["t", "key", "fp"])

    def join(batches):
        parts = [[], []]
        for batch in batches:
            parts[0].append(batch.column(0).to_numpy(zero_copy_only=False))
            parts[1].append(batch.column(2).to_numpy(zero_copy_only=False))
        if not parts[0]:
            return
        t, fp = np.concatenate(parts[0]), np.concatenate(parts[1]).view(np.uint64)
        for k in np.unique(t):
            own = fp[t == k]
            bits, exact = choices[int(k)]
            moved = permute(own, bits)
            order = np.argsort(moved)
            links = trie_links(moved[order], exact, budget)
            if links:
                pairs = own[order][np.array(links)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(releasing(deal), "t int, key long, fp long").repartition("t", "key")
    return dealt.mapInArrow(releasing(join), "a long, b long")


# ---------------------------------------------------------------- operators


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hexadecimal digits) and component_id (smallest doc_id that links reach)."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = similar_links(classes, budget, classes.count())
    roots = components(links)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of neighbouring texts, the text of each, and each text's number of them.

    A text with fewer words than a shingle is one shingle, also one without words.
    """
    starts, ends, at = words_in(raw, offsets)
    sums = prefix_sums(word_hashes(raw, starts, ends, folded=True))
    n = np.maximum(np.diff(at) - shingle + 1, 1)
    row = np.repeat(np.arange(len(n)), n)
    first = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = stretch_hash(sums, first, np.minimum(first + shingle, at[row + 1]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new], np.bincount(row[new], minlength=len(n))


def _pieces(batches, column: int, shingle: int):
    """batch, first and last row, and the shingle sets, of some rows at a time."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(column))
        for i, j in groups_of(np.diff(offsets), PIECE):
            a, b = int(offsets[i]), int(offsets[j])
            yield batch, i, j, shingle_sets(raw[a:b], offsets[i : j + 1] - a, shingle)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def shingle_counts(lean: DataFrame, shingle: int) -> np.ndarray:
    """How many texts' shingles fall on each slot of the hash space, up to 255 in each task.

    A small table that sets frequent shingles apart; any values give the same near copies.
    """
    parts, width = 64, SLOTS // 64

    def count(batches):
        table = np.zeros(SLOTS, dtype=np.int64)
        for _, _, _, (h, _, _) in _pieces(batches, 0, shingle):
            table += np.bincount((h >> SLOT_SHIFT).astype(np.int64), minlength=SLOTS)
        rows = np.minimum(table, 255).astype(np.uint8).reshape(parts, width)  # a byte for each, to send little
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_py(), np.uint8).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((parts, width), dtype=np.uint32)
    ddl = "part int, counts binary"
    for r in lean.select("text").mapInArrow(releasing(count), ddl).repartition("part").mapInArrow(releasing(add), ddl).collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def parity_marks(h: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """MARKS words for each text: bits that its shingles flip. Two texts' marks differ in no more bits than their sets do in shingles."""
    flips = np.bincount(row * (64 * MARKS) + (h % np.uint64(64 * MARKS)).astype(np.int64), minlength=texts * 64 * MARKS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(texts, -1), axis=1).view(np.uint64)


def _laid_out(rows: np.ndarray, first: np.ndarray, count: np.ndarray, most: int):
    """Pairs (row, place) for the places first to first + count - 1 of each row, some at a time."""
    total = np.concatenate([[0], np.cumsum(count)])
    start = 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        own = count[start:end]
        place = np.repeat(first[start:end] - total[start:end], own) + np.arange(total[start], total[end])
        yield np.repeat(rows[start:end], own), place
        start = end


def candidates(token, root, th, n, at, marks, least: float, width: int | None, most: int = 1 << 20):
    """Pairs (arrays a < b of th) of texts under one token whose sizes, places and marks allow the similarity.

    Texts under one root are never paired. width: only so many neighbours by size (None: all). With all, texts of the
    root that is commonest under a token are met by the others only, so a joined group costs nothing, however large.
    """
    order = np.lexsort((th, n, token))
    token, root, th, n, at = token[order], root[order], th[order], n[order].astype(np.int64), at[order]
    marks = None if marks is None else marks[order]
    if not len(token):
        return
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(token))))
    key, high = (group << 32) + n, (group << 32) + np.floor(n / least + 1e-9).astype(np.int64)
    place = np.arange(len(key))
    if width is not None:
        count = np.minimum(np.searchsorted(key, high, side="right") - place - 1, width)
        found = _laid_out(place, place + 1, count, most)
    else:
        by_root = np.lexsort((root, group))
        new = np.concatenate([[True], (group[by_root][1:] != group[by_root][:-1]) | (root[by_root][1:] != root[by_root][:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        of = np.empty(len(key), dtype=np.int64)
        of[by_root] = np.cumsum(new) - 1
        largest = np.zeros(len(head), dtype=np.int64)
        np.maximum.at(largest, group, size[of])
        first_of = np.full(len(head), len(size))
        np.minimum.at(first_of, group, np.where(size[of] == largest[group], of, len(size)))
        common = of == first_of[group]
        other, usual = place[~common], place[common]
        low = (group << 32) + np.ceil(n * least - 1e-9).astype(np.int64)
        after = np.searchsorted(key[other], high[other], side="right") - np.arange(len(other)) - 1
        begin = np.searchsorted(key[usual], low[other])
        across = np.searchsorted(key[usual], high[other], side="right") - begin
        found = chain(((i, other[k]) for i, k in _laid_out(other, np.arange(len(other)) + 1, after, most)), ((i, usual[k]) for i, k in _laid_out(other, begin, across, most)))
    for i, j in found:
        need = np.ceil(least / (1 + least) * (n[i] + n[j]) - 1e-9)
        m = (root[i] != root[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)
        i, j, need = i[m], j[m], need[m]
        if marks is not None:
            m = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1) <= n[i] + n[j] - 2 * need
            i, j = i[m], j[m]
        a, b = np.minimum(th[i], th[j]), np.maximum(th[i], th[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if len(a):
            yield a[new], b[new]


def _whole(batches) -> list[np.ndarray]:
    """The columns of all batches."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _marked(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), np.uint64).reshape(-1, MARKS)


def print_links(lean: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """a and b: links (th, a < b) between keyed texts whose fingerprints of that many words differ in at most `budget` bits.

    Distinct fingerprints are linked by the trie self-join; a fingerprint stands for its text of least th, which the
    others of the same fingerprint are linked to.
    """
    prints = cut(fingerprints(lean.select(F.col("th").alias("doc_id"), "text"), words).distinct())
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("head")))
    ends = [classes.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "ab"]
    links = similar_links(classes, budget, classes.count()).join(ends[0], "a").join(ends[1], "b").select("ha", "hb")
    links = links.union(prints.join(classes, "fp").filter("doc_id <> head").select("head", "doc_id"))
    return links.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, words: int = 3, budget: int = 3) -> DataFrame:
    """docs without near copies: of each group of similar texts the document of smallest doc_id stays.

    Two texts are similar if their sets of shingles have at least that Jaccard similarity; similar texts form groups.
    SimHash comes first: texts are linked by the trie self-join of their fingerprints (of `words` words, at `budget` bits),
    and links that hold on the whole sets make the first groups. The exact search for the rest follows, for similar
    texts often differ in more bits, and a link that does not hold may stand for one that does.

    Every similar pair shares one of the first n - ceil(least n) + 1 shingles of either text's n in any order common to
    all; rare ones come first here. All pairs under such a shingle whose sizes, places and marks allow the similarity are
    compared on their whole sets, but for pairs that compared ones have already joined: a first round takes
    NEIGHBOURS by size only, so that a dense group of true copies hangs together before all pairs are laid out. The
    second drops what the marks rule out: parities of the shingles' hashes, which differ in at most as many bits as
    the sets in shingles, so they never part a similar pair.

    Defined cases: texts without words are near copies of each other; a text with fewer words than a shingle is one
    shingle; a null doc_id is larger than all others; repeated rows of one document become one; very long texts are
    compared whole; an empty table gives no rows; all columns are kept, also those named like the ones used inside.
    """
    lean = keyed(docs)
    often = lean.sparkSession.sparkContext.broadcast(shingle_counts(lean, shingle))

    def prefixes(batches):
        for batch, i, j, (h, row, n) in _pieces(batches, 2, shingle):
            order = np.lexsort((h, often.value[(h >> SLOT_SHIFT).astype(np.int64)], row))
            begin = np.cumsum(n) - n
            size = (n - np.ceil(least * n - 1e-9) + 1).astype(np.int64)
            inner = np.arange(len(h)) - begin[row] < size[row]
            marks = [m.tobytes() for m in parity_marks(h, row, j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int32()), pa.array(marks, pa.binary()), _lists(h[order][inner], size)], names=["id", "th", "n", "marks", "prefix"])

    def repeated(batches):
        columns = _whole(batches)
        if columns:
            _, back, times = np.unique(columns[0], return_inverse=True, return_counts=True)
            m = np.flatnonzero(times[back] > 1)
            for x in range(0, len(m), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[m[x : x + (1 << 16)]]) for c in columns], names=["token", "root", "th", "n", "at"])

    def paired(width):
        def run(batches):
            columns = _whole(batches)
            if columns:
                token, root, th, n, at, *marks = columns
                for a, b in candidates(token, root, th, n, at, _marked(marks[0]) if marks else None, least, width):
                    for x in range(0, len(a), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(a[x : x + (1 << 16)]), pa.array(b[x : x + (1 << 16)])], names=["a", "b"])

        return run

    def sets(batches):
        for batch, i, j, (h, _, n) in _pieces(batches, 2, shingle):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), _lists(h, n)], names=["th", "held"])

    def searched(rows: DataFrame, width: int | None) -> DataFrame:
        """The similar pairs of one round of the search."""
        return similar(rows.repartition("token").mapInArrow(releasing(paired(width)), "a long, b long").distinct())

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar on their whole sets."""
        pairs = cut(pairs)
        ends = pairs.select(F.col("a").alias("th")).union(pairs.select("b")).distinct()
        wanted = cut(ends.join(first.select("th", "id"), "th"))
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
        held = lean.join(wanted, ["id", "th"], "left_semi").select("id", "th", "text").mapInArrow(releasing(sets), "th long, held array<long>").dropDuplicates(["th"])
        sides = pairs.join(held.select(F.col("th").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("th").alias("b"), F.col("held").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return cut(sides.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum")).filter(F.col("both") / (F.col("sum") - F.col("both")) >= least).select("a", "b"))

    first = cut(lean.groupBy("th").agg(F.min("id").alias("id")))
    printed = similar(print_links(lean, words, budget))
    begun = cut(first.join(components(printed).withColumnRenamed("node", "th"), "th", "left").select("th", "id", F.coalesce("root", "th").alias("root")))
    texts = cut(lean.mapInArrow(releasing(prefixes), "id long, th long, n int, marks binary, prefix array<long>").join(begun, ["th", "id"]).dropDuplicates(["th", "id"]))
    spread = texts.select("root", "th", "n", F.posexplode("prefix").alias("at", "token")).select("token", "root", "th", "n", "at")
    shared = cut(spread.repartition("token").mapInArrow(releasing(repeated), "token long, root long, th long, n int, at int"))
    near = printed.unionByName(searched(shared, NEIGHBOURS))
    named = texts.select("th", "marks").join(components(near).withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    roots = components(near.unionByName(searched(shared.drop("root").join(named, "th").select("token", "root", "th", "n", "at", "marks"), None)))
    rooted = first.join(roots, F.col("th") == F.col("node"), "left").select("th", "id", F.coalesce("root", "th").alias("root"))
    stays = rooted.groupBy("root").agg(F.min(F.struct("id", "th")).alias("s")).select(F.col("s.id").alias("__near_id"), F.col("s.th").alias("__near_th"))
    id_, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    keys = ["__near_id", "__near_th"]
    return docs.withColumn(keys[0], id_).withColumn(keys[1], th).join(stays, keys).dropDuplicates(keys).select(*docs.columns)
