"""Runs of windows under shared keys: what both removers of repeated stretches start from.

A sequence's windows fall into runs that share their least gram hash (common.runs_by_minimum). Equal windows always
fall under one key, so a key seen once holds nothing repeated, and everything about a window is decided among the
runs of its key. Equal runs are counted once, by digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE, NO_ID, cut, groups_of, releasing, runs_by_minimum, text_bytes, word_hashes, words_in

RUNS = "id long, th long, start int, n int, key long, dig long"
#: Items worked on at once.
PIECE = 1 << 18
#: Documents whose keys (eight bytes each) may be broadcast.
FEW = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """id, th and text: the document's id (nulls last), a hash of its text, and the text (null: empty)."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def byte_items(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each item, the sequences' bounds, and what digests are made of."""
    return BYTE[raw], offsets, raw


def word_items(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = words_in(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    return hashes, at, hashes


def _pieces(items: np.ndarray, bounds: np.ndarray, data: np.ndarray, window: int, gram: int):
    """Runs of neighbouring sequences; a long stretch is cut into overlapping pieces, each window in one of them."""
    for at in range(0, max(1, len(items) - window + 1), PIECE):
        end = min(len(items), at + PIECE + window - 1)
        inner = np.unique(np.clip(bounds, at, end)) - at
        if len(inner) > 1:
            start, n, key, dig = runs_by_minimum(items[at:end], inner, window, gram, data[at:end])
            yield start + at, n, key, dig


def runs(docs: DataFrame, items_of, window: int, gram: int) -> DataFrame:
    """RUNS of keyed documents: the first window (counted in items from the text's start) and number of windows of each run."""

    def run(batches):
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = text_bytes(batch.column(2))
            for i, j in groups_of(np.diff(offsets), PIECE):
                a, b = int(offsets[i]), int(offsets[j])
                items, bounds, data = items_of(raw[a:b], offsets[i : j + 1] - a)
                for start, n, key, dig in _pieces(items, bounds, data, window, gram):
                    if len(start):
                        row = np.searchsorted(bounds, start, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[i + row]), pa.array(ths[i + row]), pa.array((start - bounds[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(dig.view(np.int64))],
                            names=["id", "th", "start", "n", "key", "dig"],
                        )

    return docs.mapInArrow(releasing(run), RUNS)


def shared_runs(found: DataFrame, repeated: Column) -> DataFrame:
    """The runs whose key may hold repeated windows, with `many`: whether the key has different runs.

    repeated: a condition over n_rows, low_id and high_id of a key.
    """
    keys = found.groupBy("key").agg(
        F.count("*").alias("n_rows"), F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.min("dig").alias("d0"), F.max("dig").alias("d1"), F.min("n").alias("n0"), F.max("n").alias("n1")
    )
    keys = cut(keys.filter(repeated).select("key", ((F.col("d0") != F.col("d1")) | (F.col("n0") != F.col("n1"))).alias("many")))
    return found.join(keys, "key")  # both sides stand in files, so a key with very many runs can be split in the join


def with_parts(distinct: DataFrame, items_each: Column, most: int) -> DataFrame:
    """distinct runs with `parts`: into how many parts their key's runs are to be dealt, so that one holds about `most` items."""
    hot = distinct.groupBy("key").agg(F.sum(items_each).alias("items")).filter(F.col("items") > most).select("key", F.ceil(F.col("items") / most).cast("int").alias("parts"))
    hot = cut(hot)  # few keys, or a file, so that a key with very many runs never needs one task
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    return distinct.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def with_documents(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined with rows, one for each document (id, th), inner or left.

    While few documents have a row, their keys are broadcast, so that no other text is shuffled.
    """
    rows = cut(rows)
    if rows.count() > FEW:
        return docs.join(rows, ["id", "th"], how)
    key = F.xxhash64("id", "th")
    keys = F.broadcast(rows.select(key.alias("_key")).distinct())
    own = docs.withColumn("_key", key)
    joined = own.join(keys, "_key", "left_semi").join(rows, ["id", "th"], how).drop("_key")
    if how == "inner":
        return joined
    others = own.join(keys, "_key", "left_anti").drop("_key")
    return joined.unionByName(others, allowMissingColumns=True)


def spans_from(flags: np.ndarray) -> list[dict]:
    """Stretches of set flags as {a, b}."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def covered(spans, window: int, size: int) -> np.ndarray:
    """Which items are covered by the windows that start in any of the spans."""
    step = np.zeros(size + 1, dtype=np.int64)
    for s in spans or ():
        step[s["a"]] += 1
        step[s["b"] + window - 1] -= 1
    return np.cumsum(step[:size]) > 0


def by_key(batches, size_of, most: int):
    """Rows (as dicts) of batches sorted by their column `deal`, in lists that never part one value of it."""
    held, total, last = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["deal"] != last and total >= most:
                yield held
                held, total = [], 0
            last = row["deal"]
            held.append(row)
            total += size_of(row)
    if held:
        yield held
