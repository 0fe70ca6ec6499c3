"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is a text's piece between newlines, compared without outer spaces; blank lines never count. Each
line's sites are sketched by HyperLogLog, the sketches merge by aggregation, and lines whose estimate lies
near the threshold are counted exactly. A line on at least `min_sites` sites is boilerplate: it stays in the
document of smallest doc_id that has it, at its first place, and goes everywhere else.

Defined cases: a null text keeps no lines and stays null; an empty text has one blank line; a null site is a
site of its own; a null doc_id sorts last; repeated rows of one document get the same result; an empty table
gives no rows; a document all of whose lines go keeps its row with an empty text; a text of very many lines takes time
in proportion; columns named like n_lines or n_removed are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut

#: lgK of the sketches: 4096 registers, a relative error of about 1.6 %.
LG_K = 12
#: Line hashes (16 bytes each, with their first places) that may be broadcast.
FEW = 200_000
#: Estimates within this share of the threshold, plus one, are counted exactly (over five standard errors).
NEAR = 0.1


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """_id, _th (the document), _pos, _h1, _h2 (the line), _site."""
    cols = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64("text").alias("_th"),
        F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("_site"),
    ]
    exploded = docs.select(*cols, F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    key = F.trim("_line")
    return exploded.filter(key != "").select("_id", "_th", "_pos", "_site", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """_h1, _h2, _first (struct of the smallest _id and its _pos) of each line on at least min_sites sites."""
    key = ["_h1", "_h2"]
    met = lines.groupBy(*key).agg(F.hll_sketch_agg("_site", LG_K).alias("sketch"), F.min(F.struct("_id", "_pos")).alias("_first"))
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    met = cut(met.withColumn("spread", F.hll_sketch_estimate("sketch")).filter(F.col("spread") >= low).select(*key, "_first", "spread"))
    sure = met.filter(F.col("spread") > high).select(*key, "_first")
    near = met.filter(F.col("spread") <= high)
    exact = lines.join(_small(near.select(*key)), key, "left_semi").groupBy(*key, "_site").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("n"))
    return sure.unionByName(near.join(exact.filter(F.col("n") >= min_sites), key).select(*key, "_first"))


def _small(hashes: DataFrame) -> DataFrame:
    """Marked for broadcast while they are few, so that a line on a third of all rows is never dealt to one task."""
    return F.broadcast(hashes) if hashes.count() <= FEW else hashes


def dedup_lines(docs: DataFrame, min_sites: int = 5, site: str = "source") -> DataFrame:
    """docs with text cut to the lines that stay, and n_lines, n_removed (lines of the text, and those that went)."""
    lines = cut(_lines(docs, site))
    bad = boilerplate_lines(lines, min_sites)
    gone = lines.join(_small(cut(bad)), ["_h1", "_h2"]).filter(F.struct("_id", "_pos") != F.col("_first"))
    gone = gone.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_gone"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*[docs[c] for c in keep], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    # the text is split once, outside the function over the places that stay: time grows with its lines
    joined = F.get(F.transform(F.array(split), lambda whole: F.array_join(F.transform(left, lambda i: F.get(whole, i)), "\n")), F.lit(0))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(joined)
    return keyed.join(gone, ["_id", "_th"], "left").select(
        *[(text if c == "text" else F.col(c)).alias(c) for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
