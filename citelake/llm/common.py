"""Shared helpers: reliable checkpoints, the word rule, Arrow text access, rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space (space and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside joins; it sorts after every other id.
NO_ID = (1 << 63) - 1

#: Rows of one Arrow batch: ten thousand texts, the default, take too much of an executor's memory beside its heap.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_MASK = (1 << 64) - 1


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, whose Python need not have it, once for each context.

    Where the session has the default size of Arrow batches, it gets BATCH_ROWS.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if not getattr(sc, "_citelake_shipped", False):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="citelake-")) / "citelake.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._citelake_shipped = True
    return spark


def releasing(run):
    """run, a function over Arrow batches, and afterwards what it no longer needs is given back to the system.

    Python workers live on between tasks; without this they hold the largest batch they ever saw.
    """

    def held(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return held


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where none is set and all runs in this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def use_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fields(df: DataFrame, **wanted: Column) -> DataFrame:
    """Only the named columns, so that further columns with clashing names do no harm."""
    return df.select(*[c.alias(k) for k, c in wanted.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and leaves every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- Arrow text


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, and its n+1 offsets."""
    wide = "large" in str(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def groups_of(lengths: np.ndarray, most: int):
    """Ranges of neighbouring rows of at most `most` bytes together; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


# ---------------------------------------------------------------- hashing


def _splitmix(seed: int):
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


_draw = _splitmix(20240229)
#: A random value for each byte, and the base of the rolling polynomial (3 modulo 8, so powers do not collapse).
BYTE = np.array([next(_draw) for _ in range(256)], dtype=np.uint64)
BASE = (next(_draw) & ~7 & _MASK) | 3
INVERSE = pow(BASE, -1, 1 << 64)
_low = np.arange(256)
_low[65:91] += 32
#: The same with A to Z folded onto a to z.
BYTE_FOLDED = BYTE[_low]

_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2^64."""
    if _powers["n"] < n + 1:
        size = 1 << max(16, int(n + 1).bit_length())
        out = []
        for b in (BASE, INVERSE):
            p = np.ones(1, dtype=np.uint64)
            step = b
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step & _MASK
            out.append(p)
        _powers.update(n=size, up=out[0], down=out[1])
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(items: np.ndarray) -> np.ndarray:
    """Sums of item j times base^j before each position; a difference is the hash of a stretch."""
    up, _ = powers(len(items))
    out = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * up[: len(items)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_in(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of neighbouring texts, and the number of words before each bound.

    bounds: n+1 positions in raw; a word never crosses one.
    """
    inner = ~SPACE[raw]
    n = len(raw)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inner
    here = np.zeros(n + 1, dtype=bool)
    here[:n] = inner
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, bounds)


#: Words longer than this get a hash of another kind: polynomials modulo 2^64 take some long words for equal.
LONG_WORD = 255


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False, piece: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = _short_word_hashes(raw, starts, ends, BYTE_FOLDED if folded else BYTE, piece)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = raw[starts[i] : ends[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if folded else word)
    return out


def _short_word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, piece: int) -> np.ndarray:
    if len(raw) <= piece:
        return stretch_hash(prefix_sums(table[raw]), starts, ends)
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = stretch_hash(prefix_sums(table[raw[a:b]]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring values."""
    if w == 1 or len(x) < w:
        return x[: max(0, len(x) - w + 1)]
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, _MASK, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxh3 of each stretch of data: unlike a polynomial's, its collisions follow no pattern of the items."""
    view, wide = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((start * wide).tolist(), (end * wide).tolist(), strict=True)], dtype=np.uint64)


def runs_by_minimum(items: np.ndarray, bounds: np.ndarray, window: int, gram: int, data: np.ndarray):
    """Splits the windows of neighbouring sequences into runs that share their least gram hash.

    Equal windows have equal minima, so they fall under the same key wherever they stand. A run also ends where
    its leftmost least gram drops out, so equal windows are never in one run twice. data: what the items stand for.
    Returns the position of each run's first window, its number of windows, its key, and a digest of all its data.
    """
    n = len(items)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = prefix_sums(items)
    at = np.arange(n - gram + 1)
    grams = stretch_hash(sums, at, at + gram)
    least = sliding_min(grams, window - gram + 1)
    step = np.zeros(n + 2, dtype=np.int32)
    last = np.maximum(bounds[1:] - window + 1, bounds[:-1])
    np.add.at(step, bounds[:-1], 1)
    np.add.at(step, last, -1)
    valid = np.cumsum(step)[: len(least)] > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    stop = np.zeros(len(least) + 1, dtype=bool)
    stop[:-1] = fresh | ~valid
    stop[-1] = True
    start = np.flatnonzero(fresh)
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, side="right")]
    return start, end - start, least[start], digests(data, start, end + window - 1)
