"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown by numpy on the driver from a bounded sample of labelled rows, flattened into arrays (feature,
limit and value of each node, level by level) and broadcast; scoring walks all rows of a batch through one tree at a
time without a Python loop over rows.

Defined cases: null and empty texts have zero statistics and a score like any other text; null labels are not learned
from; without labels of both kinds every score is the share of good labels (0.5 with none); repeated rows get equal
scores; an empty table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, releasing, text_bytes, word_hashes, words_in

#: Labelled rows learned from, at most: those whose id hashes lowest.
SAMPLE = 20_000

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "sign": b"*$%&#@^~=+<>{}[]\\/_`",
    "newline": b"\n",
    "wide": range(128, 256),
}
_TABLES = np.zeros((len(_CLASSES), 256), dtype=np.int64)
for _i, _of in enumerate(_CLASSES.values()):
    _TABLES[_i, list(_of)] = 1

FEATURES = ("bytes", "words", "word_mean", "word_spread", "word_max", "repeat", "distinct", "commonest", *[f"{c}_share" for c in _CLASSES])


def _statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(np.float64)
    starts, ends, at = words_in(raw, bounds)
    words = np.diff(at).astype(np.float64)
    hashes, length = word_hashes(raw, starts, ends, folded=True), (ends - starts).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(at))
    some = np.maximum(words, 1)
    mean = np.bincount(row, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(row, length * length, n) / some - mean * mean))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    twin = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(fresh)
    most = np.zeros(n)
    np.maximum.at(most, r[first], np.diff(np.append(first, len(h))).astype(np.float64))
    out = [np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), np.bincount(row[1:][twin], minlength=n) / some, np.bincount(r[first], minlength=n) / some, most / some]
    for table in _TABLES:
        sums = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(table[raw], out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(size, 1))
    return np.stack(out, axis=1)


def document_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of texts in one buffer, some megabytes at a time."""
    parts = [np.zeros((0, len(FEATURES)))]
    for i, j in groups_of(np.diff(offsets), 1 << 19):
        a, b = int(offsets[i]), int(offsets[j])
        parts.append(_statistics(raw[a:b], offsets[i : j + 1] - a))
    return np.concatenate(parts)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Perfect binary trees of one depth: node k has children 2k+1 and 2k+2; value holds the leaves."""

    start: float
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw_scores(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees on log loss; each split is the best over the bins of every feature's histogram."""
    n, width = x.shape
    share = float(y.mean()) if n else 0.5
    none = np.zeros((0, 2**depth - 1))
    if n == 0 or share in (0.0, 1.0):
        return Trees(float(np.log((share + 1e-6) / (1 - share + 1e-6))) if n else 0.0, depth, none.astype(int), none, np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, limit, cutoff = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf), np.full(2**depth - 1, bins)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (many, width, bins)
            g = np.bincount(key, np.repeat(grad, width), many * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess, width), many * width * bins).reshape(shape).cumsum(axis=2)
            c = np.bincount(key, minlength=many * width * bins).reshape(shape).cumsum(axis=2)
            gain = g**2 / (h + ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
            gain[(c < least) | (c[..., -1:] - c < least)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], limit[first + k], cutoff[first + k] = f, edges[f][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cutoff[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
        score += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(start, depth, np.array(features), np.array(limits), np.array(values))


# ---------------------------------------------------------------- Spark


def held_out(doc_id: Column, parts: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the given remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `sample` rows that are not held out, chosen by a hash of the id."""
    rank = F.xxhash64("doc_id")
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_label").limit(sample)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    width = len(FEATURES)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = document_features(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), type=pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = text.select("doc_id", "text", "_label").mapInArrow(releasing(run), "doc_id long, label double, x array<double>").orderBy(rank, "label").limit(sample).collect()
    return np.array([r["x"] for r in rows]).reshape(len(rows), width), np.array([r["label"] for r in rows])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **options) -> Trees:
    return grow(*labelled_features(docs, labels, label, sample), **options)


def score_quality(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        data = [t.encode("utf-8") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)]).astype(np.int64)
        x = document_features(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
        return pd.Series(shared.value.scores(x), dtype="float64")

    return docs.withColumn(column, score(F.coalesce(docs["text"], F.lit(""))))
