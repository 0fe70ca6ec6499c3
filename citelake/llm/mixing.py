"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed 64-bit hash of its id and text. Its source takes whole passes over all
documents as long as the target allows, then those documents whose hash lies under a threshold. The
threshold is found from sums of sizes by source and hash bucket: only the bucket in which the budget
ends is refined, a few bits at a time, so nothing is ever sorted.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source, last in order;
an empty table gives no rows; identical repeated rows share one hash and so one fate; further columns
are kept as they are, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, cut

#: Bits of the hash that each refinement looks at, from the top; together 64.
LEVELS = (12, 12, 12, 12, 16)
#: Threshold rows (one for each source) up to which they are broadcast.
BROADCAST_SOURCES = 100_000


def measured(docs: DataFrame) -> DataFrame:
    """docs with _size (words in the text) and _h (the document's hash)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_h", F.xxhash64("doc_id", "text"))


def targets(sizes: dict, weights: tuple, most: float) -> dict:
    """Words wanted of each source: all words, shared by weight, no source above `most` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and unit * weight[s] >= most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * float(sizes[s])
            left -= out[s]
            open_.discard(s)
        left = max(0.0, left)
    return out


def _bits(shift: int, n: int):
    return F.shiftrightunsigned(F.col("_h"), shift).bitwiseAND(F.lit((1 << n) - 1))


def thresholds(sized: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row for each source: source, source_size, target, whole passes, and the hash prefix below which one more is taken.

    sized: source, _size, _h. What reaches the driver is one row for each source.
    """
    spark = sized.sparkSession
    sizes = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("_size").alias("n")).collect()}
    wanted = targets(sizes, weights, most)
    state = {}
    for s, target in wanted.items():
        passes = min(most, int(target // sizes[s])) if sizes[s] else 0
        rest = target - passes * sizes[s] if passes < most else 0.0
        state[s] = {"passes": passes, "rest": rest, "prefix": 0, "bits": 0, "open": rest > 0 and sizes[s] > 0, "take": False}
    subset, used = sized, 0
    for n in LEVELS:
        at = {s: x for s, x in state.items() if x["open"]}
        if not at:
            break
        edge = spark.createDataFrame([(s, x["prefix"], float(x["rest"])) for s, x in at.items()], "source string, prefix long, rest double")
        edge = F.broadcast(edge) if len(at) <= BROADCAST_SOURCES else edge
        same = F.col("s.source").eqNullSafe(F.col("e.source"))
        if used:
            same &= F.shiftrightunsigned(F.col("_h"), 64 - used) == F.col("prefix")
        subset = subset.alias("s").join(edge.alias("e"), same).select("s.source", "_size", "_h", "rest")
        hist = subset.groupBy("source", "rest", _bits(64 - used - n, n).alias("b")).agg(F.sum("_size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hit = hist.withColumn("upto", upto).filter("upto >= rest and upto - n < rest").select("source", "b", "n", "upto")
        found = {r["source"]: r for r in hit.collect()}
        for s, x in at.items():
            r = found.get(s)
            if r is None:  # rounding left the budget a hair above all that is there: take everything in this bucket
                x.update(open=False, take=True)
                continue
            x["prefix"], x["rest"] = (x["prefix"] << n) | int(r["b"]), x["rest"] - (r["upto"] - r["n"])
            x["last"] = r["n"]
        used += n
        subset = subset.select("source", "_size", "_h")
    rows = []
    for s, x in state.items():
        if x["open"]:  # one hash is left: the nearer side wins
            x["take"] = 2 * x["rest"] >= x["last"]
        # a document is taken once more if its hash is under the prefix, or equal to it and take is set
        signed = x["prefix"] - (1 << 64) if x["prefix"] >= 1 << 63 else x["prefix"]
        rows.append((s, sizes[s], wanted[s], x["passes"], signed, x["take"], x["rest"] > 0 or x["open"]))
    return spark.createDataFrame(rows, T.StructType.fromDDL("source string, source_size long, target double, passes int, prefix long, take boolean, part boolean"))


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, sized: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target (its source's), copies and taken (words, repeats counted).

    sized: docs with _size and _h, if they are at hand already.
    """
    if sized is None:
        sized = measured(docs)
        lean = cut(sized.select("source", "_size", "_h"))
    else:
        lean = sized.select("source", "_size", "_h")
    limits = thresholds(lean, weights, most)
    few = limits.count() <= BROADCAST_SOURCES
    limits = limits.select(*[F.col(c).alias(f"_{c}") for c in limits.columns])
    limits = F.broadcast(limits) if few else limits
    flip = F.lit(-(1 << 63))
    under = (F.col("_h").bitwiseXOR(flip) < F.col("_prefix").bitwiseXOR(flip)) | (F.col("_take") & (F.col("_h") == F.col("_prefix")))
    copies = F.col("_passes") + (F.col("_part") & under).cast("int")
    keep = [c for c in sized.columns if c not in ("_size", "_h", "size", "source_size", "target", "copies", "taken")]
    return sized.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        *[sized[c] for c in keep], F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (F.col("_size") * copies).alias("taken")
    )
