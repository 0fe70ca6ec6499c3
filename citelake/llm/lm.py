"""Language-model scoring from a log-frequency Bloom filter.

Words of the training texts and pairs of neighbouring words are counted over the whole corpus: each task sorts its
hashes and sends sorted blocks to buckets of the hash space, where they are summed. Counts are quantised by their
logarithm, and an n-gram of level l is written into the filter as the l pairs (n-gram, 1) to (n-gram, l). A count is
read back by asking for level 1, 2, ... until one is missing, so a false positive can only raise it. Every
bucket owns a stretch of the filter and builds it alone; the stretches together are broadcast.

The filter is sized by what it holds, pairs seen once included. Up to MAX_BITS it is broadcast; beyond that its stretches
stay where they were built, the texts' n-grams are sent to them by hash, and the levels come back to the texts: the scores
are the same. The number of buckets follows the bytes of training text, so one bucket's counts take bounded memory
however large the corpus. Exact word counts, which the base score needs, are broadcast while there are at most
DICTIONARY of them and asked for by hash, in the same way, otherwise. What is sent goes to ranges of neighbouring
buckets, as there would be far more rows than the text calls for with one for each bucket and piece of text.

Defined cases: null and empty texts are the end token alone; a null doc_id is not held out; repeated rows all count
and get equal scores; with no training texts every count is 0; very long texts are scored whole, one at a time; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_of, mix, releasing, text_bytes, word_hashes, words_in
from .quality import held_out

#: Hash of the end token, which no word's hash equals but by chance.
END = np.uint64(0xE4D0_5EED_0000_0001)
#: Base of the count levels and probes for each level.
LOG = 2.0
PROBES = 4
BITS_EACH = 8
#: Size of a filter that may be broadcast (256 MB).
MAX_BITS = 1 << 31
#: Bytes of training text whose n-grams fall into one bucket, about.
BUCKET = 2 << 20
#: Least count of a word pair that the model keeps.
LEAST_PAIR = 1
#: Word counts that may be broadcast (12 bytes each).
DICTIONARY = 8_000_000
#: Words that the pair counts of a context are weighed against.
MASS = 30.0
#: Bytes of text read or scored at once, and tokens counted before they are sent.
PIECE = 1 << 20
TOKENS = 1 << 20
#: Neighbouring buckets that counts are sent to together, at most, and the ranges that are left at least.
TOGETHER = 32
RANGES = 256
#: Bytes of text that asks at once, and bytes of the filter and of word counts that answer in one range, about.
ASKING = 8 << 20
ANSWERING = 8 << 20


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of neighbouring texts, each closed by END, and the n+1 bounds of the texts among them."""
    starts, ends, at = words_in(raw, offsets)
    n = len(offsets) - 1
    bounds = at + np.arange(n + 1)
    out = np.full(len(starts) + n, END, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[bounds[1:] - 1] = False
    out[inner] = word_hashes(raw, starts, ends, folded=True)
    return out, bounds


def pairs(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; END stands before the first."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[bounds[:-1]] = END
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + the whole part of log(count); 0 for none."""
    out = np.zeros(len(count), dtype=np.int64)
    some = count > 0
    out[some] = 1 + np.floor(np.log(count[some]) / math.log(LOG) + 1e-9).astype(np.int64)
    return out


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts."""
    low = LOG ** (level - 1.0)
    return np.where(level > 0, np.maximum(1.0, (low + low * LOG - 1) / 2), 0.0)


def _halves(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (n-gram, level), from which its probes are made."""
    h = mix(grams * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _spot(h: np.ndarray, step: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The place of a probe among so many, by multiplication, so that any number under 2^32 will do."""
    return (((h + np.uint64(i) * step & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def fill(grams: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The stretch of one bucket, a byte for eight places."""
    out = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        h, step = _halves(grams[levels >= level], level)
        for i in range(PROBES):
            out[_spot(h, step, i, bits)] = True
    return np.packbits(out, bitorder="little")


@dataclass
class Filter:
    """stretches: one row of bytes for each bucket from the first on; a bucket is the n-gram hash's top bits."""

    stretches: np.ndarray
    shift: int
    first: int = 0

    def levels(self, grams: np.ndarray, most: int = 40) -> np.ndarray:
        """Levels by repeated membership probes."""
        flat, size = self.stretches.ravel(), self.stretches.shape[1]
        out = np.zeros(len(grams), dtype=np.int64)
        left = np.arange(len(grams))
        base = ((grams >> np.uint64(self.shift)).astype(np.int64) - self.first) * size if self.shift < 64 else np.zeros(len(grams), np.int64)
        for level in range(1, most + 1):
            h, step = _halves(grams[left], level)
            for i in range(PROBES):  # each probe looks only at n-grams that passed those before
                at = _spot(h, step, i, size * 8)
                hit = (flat[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
                left, h, step = left[hit], h[hit], step[hit]
            if not len(left):
                break
            out[left] = level
        return out


# ---------------------------------------------------------------- counting

_BLOCK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("once", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary())])
_BLOCK_DDL = "part int, kind int, once binary, grams binary, counts binary"


def _edges(parts: int, first: int = 0, number: int | None = None) -> np.ndarray:
    """The least hashes of some neighbouring parts of the hash space (of a power of two), but for the first one's."""
    return np.arange(first + 1, first + (number or parts), dtype=np.uint64) << np.uint64(65 - parts.bit_length())


def _blocks(kind: int, grams: np.ndarray, parts: int) -> list[dict]:
    values, counts = np.unique(grams, return_counts=True)
    edge = np.searchsorted(values, _edges(parts))
    out = []
    for b, (v, c) in enumerate(zip(np.split(values, edge), np.split(counts, edge), strict=True)):
        if len(v):
            m = c == 1
            out.append({"part": b, "kind": kind, "once": v[m].tobytes(), "grams": v[~m].tobytes(), "counts": c[~m].astype(np.int64).tobytes()})
    return out


def _summed(rows: list[dict], first: int, number: int, buckets: int):
    """(bucket, grams, counts) of the buckets that blocks of one range hold, one at a time."""
    edges = _edges(buckets, first, number)
    once, grams, counts = ([np.frombuffer(r[k], kind) for r in rows] for k, kind in (("once", np.uint64), ("grams", np.uint64), ("counts", np.int64)))
    cut_once, cut_grams = ([[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in xs] for xs in (once, grams))
    for b in range(number):
        own = [x[e[b] : e[b + 1]] for x, e in zip(once, cut_once, strict=True)]
        own += [x[e[b] : e[b + 1]] for x, e in zip(grams, cut_grams, strict=True)]
        times = [x[e[b] : e[b + 1]] for x, e in zip(counts, cut_grams, strict=True)]
        total = sum(map(len, own[: len(once)]))
        found = _added(np.concatenate(own), np.concatenate([np.ones(total, np.int64), *times]))
        if len(found[0]):
            yield first + b, *found


def _added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(grams):
        return grams, counts
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[head], np.add.reduceat(counts, head)


def count_grams(train: DataFrame, buckets: int, least_pair: int) -> DataFrame:
    """bucket, kind (1 words, 2 pairs), grams and counts (sorted blocks; of pairs only the counts' levels, a byte each), total, most (the highest count), and levels (how many grams have each count level)."""
    together = max(1, min(TOGETHER, buckets // RANGES))

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            for kind in (1, 2):
                yield pa.RecordBatch.from_pylist(_blocks(kind, np.concatenate([h[kind - 1] for h in held]), buckets // together), schema=_BLOCK)
            held.clear()

        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for i, j in groups_of(np.diff(offsets), PIECE):
                a, b = int(offsets[i]), int(offsets[j])
                token, bounds = tokens(raw[a:b], offsets[i : j + 1] - a)
                held.append((token, pairs(token, bounds)))
                if sum(len(h[0]) for h in held) >= TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    out = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("most", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("levels", pa.list_(pa.int64()))])

    def merge(batches):
        def done(rows):
            kind = rows[0]["kind"]
            for bucket, grams, counts in _summed(rows, rows[0]["part"] * together, together, buckets):
                if kind == 2:
                    grams, counts = grams[counts >= least_pair], counts[counts >= least_pair]
                levels = np.bincount(level_of(counts), minlength=64)
                held = level_of(counts).astype(np.uint8) if kind == 2 else counts
                yield pa.RecordBatch.from_pylist([{"bucket": bucket, "kind": kind, "n": len(grams), "total": int(counts.sum()), "most": int(counts.max(initial=0)), "grams": grams.tobytes(), "counts": held.tobytes(), "levels": levels.tolist()}], schema=out)

        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["part"], row["kind"]) != (held[0]["part"], held[0]["kind"]):
                    yield from done(held)
                    held = []
                held.append(row)
        if held:
            yield from done(held)

    dealt = train.mapInArrow(releasing(count), _BLOCK_DDL).repartition("part", "kind").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(releasing(merge), "bucket int, kind int, n long, total long, most long, grams binary, counts binary, levels array<long>")


@dataclass
class Model:
    filter: Filter
    total: int  # training tokens
    distinct: int
    words: np.ndarray | None  # sorted hashes of the training words with their counts, if few enough
    counts: np.ndarray | None
    bits: int  # places of each bucket's stretch
    joined: bool  # the filter is too large to broadcast, and empty here


def held_levels(counted: DataFrame) -> int:
    """Entries of the filter: the levels of all counted grams."""
    sums = counted.agg(*[F.coalesce(F.sum(F.get("levels", F.lit(i))), F.lit(0)).alias(f"l{i}") for i in range(64)]).first()
    return sum(i * int(x) for i, x in enumerate(sums))


def build_stretches(counted: DataFrame, bits: int) -> DataFrame:
    """bucket and bits: the filter's stretch of each bucket of counted grams."""
    built = pa.schema([("bucket", pa.int32()), ("bits", pa.binary())])

    def build(batches):
        def done(bucket, parts):
            grams, levels = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "bits": fill(grams, levels, bits).tobytes()}], schema=built)

        now, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and r["bucket"] != now:
                    yield done(now, parts)
                    parts = []
                now = r["bucket"]
                levels = np.frombuffer(r["counts"], np.uint8).astype(np.int64) if r["kind"] == 2 else level_of(np.frombuffer(r["counts"], np.int64))
                parts.append((np.frombuffer(r["grams"], np.uint64), levels))
        if parts:
            yield done(now, parts)

    ordered = counted.select("bucket", "kind", "grams", "counts").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(releasing(build), "bucket int, bits binary")


def build_filter(counted: DataFrame, buckets: int, bits: int) -> Filter:
    """The whole filter over counted grams."""
    stretches = np.zeros((buckets, bits // 8), dtype=np.uint8)
    for r in cut(build_stretches(counted, bits)).toLocalIterator():  # built at once, and only read one after the other
        stretches[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(stretches, 65 - buckets.bit_length())


def train_model(train: DataFrame, least_pair: int = LEAST_PAIR, max_bits: int = MAX_BITS, dictionary: int = DICTIONARY) -> tuple[Model, DataFrame]:
    """The model, and the exact counts (as count_grams gives them)."""
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(6, math.ceil(math.log2(max(1, size / BUCKET))))
    counted = cut(count_grams(train, buckets, least_pair))
    words = counted.filter("kind = 1")
    n, total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    known, counts = None, None
    if n <= dictionary:
        most = words.agg(F.max("most")).first()[0] or 0
        known, counts = np.zeros(n, np.uint64), np.zeros(n, np.uint32 if most < 1 << 32 else np.uint64)
        sizes = np.zeros(buckets + 1, np.int64)
        for r in words.select("bucket", "n").collect():
            sizes[r["bucket"] + 1] = r["n"]
        begin = np.cumsum(sizes)
        for r in words.select("bucket", "grams", "counts").toLocalIterator():
            own = slice(begin[r["bucket"]], begin[r["bucket"] + 1])
            known[own], counts[own] = np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["counts"], np.int64)
    bits = 8 * max(128, math.ceil(held_levels(counted) * BITS_EACH / 8 / buckets))
    joined = bits * buckets > max_bits
    kept = Filter(np.zeros((buckets, 0), np.uint8), 65 - buckets.bit_length()) if joined else build_filter(counted, buckets, bits)
    return Model(kept, int(total), int(n), known, counts, bits, joined), counted


# ---------------------------------------------------------------- scoring


def _lookup(model: Model, grams: np.ndarray) -> np.ndarray:
    if model.words is None or not len(model.words):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(model.words, grams), len(model.words) - 1)
    return np.where(model.words[at] == grams, model.counts[at].astype(np.int64), 0)


@dataclass
class Answers:
    """Levels and exact counts that were looked up elsewhere, for sorted grams and words; None: they stand in the model."""

    model: Model
    grams: np.ndarray
    found: np.ndarray | None
    words: np.ndarray
    times: np.ndarray | None

    def levels(self, grams: np.ndarray) -> np.ndarray:
        return self.model.filter.levels(grams) if self.found is None else self.found[np.searchsorted(self.grams, grams)]

    def counts(self, words: np.ndarray) -> np.ndarray:
        return _lookup(self.model, words) if self.times is None else self.times[np.searchsorted(self.words, words)]


def asked(texts: list[tuple[np.ndarray, np.ndarray]], grams: bool, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams whose levels, and words whose counts, the texts' scores need; sorted, none of what is not asked."""
    token, pair = [], []
    for raw, offsets in texts:
        t, bounds = tokens(raw, offsets)
        token.append(np.unique(t))
        if grams:
            pair.append(np.unique(pairs(t, bounds)))
    own = np.unique(np.concatenate(token)) if token else np.zeros(0, np.uint64)
    return np.unique(np.concatenate([own, *pair])) if grams else own[:0], own if words else own[:0]


def scores(model: Model, raw: np.ndarray, offsets: np.ndarray, filter: Answers | None = None) -> np.ndarray:
    """Rows of n_tokens, n_known, base score and model score."""
    token, bounds = tokens(raw, offsets)
    value, back = np.unique(token, return_inverse=True)
    exact = _lookup(model, value) if filter is None else filter.counts(value)
    filter = filter or model.filter
    room = model.total + model.distinct + 1
    word = count_of(filter.levels(value))
    own = (word + 1) / (model.total + model.distinct + 1)
    before = np.empty(len(token), dtype=np.int64)
    before[1:] = back[:-1]
    end = int(np.searchsorted(value, END))
    before[bounds[:-1]] = end
    pair, again = np.unique(pairs(token, bounds), return_inverse=True)
    seen = np.minimum(count_of(filter.levels(pair))[again], np.minimum(word[back], word[before]))
    p = (seen + MASS * own[back]) / (word[before] + MASS)
    base = np.log10((exact + 1) / room)[back]

    def summed(x):
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    return np.stack([np.diff(bounds), summed((exact > 0)[back]), np.add.reduceat(base, bounds[:-1]) if len(token) else base, np.add.reduceat(np.log10(np.minimum(p, 1.0)), bounds[:-1]) if len(token) else base], axis=1)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, model: Model, counted: DataFrame) -> DataFrame:
    """SCORED for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lean = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"], 7, 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches, answers=None):
        model = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in groups_of(np.diff(offsets), PIECE):
                a, b = int(offsets[i]), int(offsets[j])
                x = scores(model, raw[a:b], offsets[i : j + 1] - a, answers and Answers(model, *answers))
                new = [pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64)), pa.array(np.full(j - i, model.total)), pa.array(x[:, 2]), pa.array(x[:, 3])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *new], schema=schema)

    if model.joined or model.words is None:
        return _scored_by_hash(lean, run, counted, model)
    return lean.mapInArrow(releasing(run), SCORED)


def together_in(model: Model) -> int:
    """How many neighbouring buckets answer in one range: about ANSWERING bytes, in 64 ranges at least."""
    buckets = len(model.filter.stretches)
    each = (model.bits // 8 if model.joined else 0) + (16 * model.distinct // buckets if model.words is None else 0)
    return 1 << min((buckets // 64).bit_length() - 1, max(0, (ANSWERING // max(1, each)).bit_length() - 1))


_ASK_DDL = "part int, piece long, kind int, bucket int, grams binary, words binary"
_ASK = pa.schema([("part", pa.int32()), ("piece", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("words", pa.binary())])


def _scored_by_hash(rows: DataFrame, run, counted: DataFrame, model: Model) -> DataFrame:
    """What run makes of rows with the levels and word counts that were asked for where they were built.

    A piece is some neighbouring rows of a partition, named by the partition and its place there. Its grams and words
    go to the ranges of buckets that hold them, a row for each range; its rows meet the answers, in the ranges' order.
    """
    buckets, together = len(model.filter.stretches), together_in(model)
    parts, shift, grams, words = buckets // together, model.filter.shift, model.joined, model.words is None

    def pieces(batches):
        held, total = [], 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for i, j in groups_of(np.diff(offsets), PIECE):
                n = int(offsets[j] - offsets[i])
                if held and total + n > ASKING:
                    yield held
                    held, total = [], 0
                held.append(batch.slice(i, j - i))
                total += n
        if held:
            yield held

    def texts(held):
        for batch in held:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in groups_of(np.diff(offsets), PIECE):
                a, b = int(offsets[i]), int(offsets[j])
                yield raw[a:b], offsets[i : j + 1] - a

    def named(batches):
        from pyspark import TaskContext

        return enumerate(pieces(batches), TaskContext.get().partitionId() << 32)

    def ask(batches):
        for name, held in named(batches):
            split = [[x.tobytes() for x in np.split(v, np.searchsorted(v, _edges(parts)))] for v in asked(texts(held), grams, words)]
            own = [k for k in range(parts) if split[0][k] or split[1][k]]
            constant = lambda v, kind, n=len(own): pa.array(np.full(n, v), kind)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), constant(name, pa.int64()), constant(2, pa.int32()), constant(0, pa.int32()), *[pa.array([x[k] for k in own], pa.binary()) for x in split]], schema=_ASK)

    def lay(batches):
        for name, held in named(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as to:
                for batch in held:
                    to.write_batch(batch)
            yield pa.RecordBatch.from_pylist([{"part": -1, "piece": name, "kind": 3, "bucket": 0, "grams": sink.getvalue().to_pybytes(), "words": b""}], schema=_ASK)

    def answer(batches):
        now, stretches, known, counts, table = None, None, [], [], None
        for batch in batches:
            out = []
            for part, piece, kind, bucket, g, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:  # of a range the stretches come first, then its words, both by bucket, and then the asking pieces
                    now, known, counts, table = part, [], [], None
                    stretches = np.zeros((together, model_bits // 8), np.uint8)
                if kind == 0:
                    stretches[bucket - part * together] = np.frombuffer(g, np.uint8)
                elif kind == 1:
                    known.append(np.frombuffer(g, np.uint64))
                    counts.append(np.frombuffer(w, np.int64))
                else:
                    if table is None:
                        none = np.zeros(0, np.uint64)
                        table = Model(Filter(stretches, shift, part * together), 0, 0, np.concatenate([none, *known]), np.concatenate([none.view(np.int64), *counts]), 0, False)
                    levels = table.filter.levels(np.frombuffer(g, np.uint64)) if grams else np.zeros(0)
                    out.append({"part": part, "piece": piece, "kind": 2, "bucket": 0, "grams": levels.astype(np.uint8).tobytes(), "words": _lookup(table, np.frombuffer(w, np.uint64)).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ASK)

    def meet(batches):
        def done(data, levels, times):
            with pa.ipc.open_stream(data) as stream:
                held = list(stream)
            wanted = asked(texts(held), grams, words)
            found = [np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in xs]]) for kind, xs in ((np.uint8, levels), (np.int64, times))]
            if [len(x) for x in found] != [len(x) for x in wanted]:
                raise ValueError("the rows came in another order when they were read again")
            yield from run(held, (wanted[0], found[0].astype(np.int64) if grams else None, wanted[1], found[1] if words else None))

        now, data, levels, times = None, None, [], []
        for batch in batches:
            for part, piece, _, _, g, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece != now:
                    if now is not None:
                        yield from done(data, levels, times)
                    now, levels, times = piece, [], []
                if part < 0:
                    data = g
                else:
                    levels.append(g)
                    times.append(w)
        if now is not None:
            yield from done(data, levels, times)

    model_bits = model.bits if grams else 0
    asks = rows.mapInArrow(releasing(ask), _ASK_DDL)
    part = F.floor(F.col("bucket") / together).cast("int").alias("part")
    if grams:
        asks = asks.unionByName(build_stretches(counted, model.bits).select(part, F.lit(-1).cast("long").alias("piece"), F.lit(0).alias("kind"), "bucket", F.col("bits").alias("grams"), F.lit(b"").alias("words")))
    if words:
        asks = asks.unionByName(counted.filter("kind = 1").select(part, F.lit(-1).cast("long").alias("piece"), "kind", "bucket", "grams", F.col("counts").alias("words")))
    answers = asks.repartition("part").sortWithinPartitions("part", "kind", "bucket", "piece").mapInArrow(releasing(answer), _ASK_DDL)
    return rows.mapInArrow(releasing(lay), _ASK_DDL).unionByName(answers).repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(releasing(meet), SCORED)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """SCORED for every document by a model of those that are not held out."""
    train = docs.filter(~held_out(docs["doc_id"], 7, 2)).select(F.coalesce("text", F.lit("")).alias("text"))
    model, counted = train_model(train, **options)
    return score_texts(docs, model, counted)
