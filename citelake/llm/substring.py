"""Substring dedup by a compacted De Bruijn graph of word k-mers.

Edges are k-mers of words. They are never laid out one by one where paths do not branch: a run of neighbouring
edges under one key is one compacted edge, and equal runs of all documents meet in a Spark aggregation by key and
digest. A run that is always followed by one other run, which it alone precedes, is glued to it by a join: glued runs are
the repeated nonbranching paths. A path is decided as a whole: its words are read again at every place where it
stands, a 128-bit digest of them proves that the places are equal, and all but those in the document of smallest id go.
Only where a key has different runs can edges repeat without their runs; there each distinct run is read again at the
source coordinates of one occurrence, its edges are laid out, and the first document of every edge is found among them.

Defined cases: null and empty texts and those with fewer than k words lose nothing; a null doc_id counts as larger
than all others, and null ids take nothing from each other; repeated rows of one id take nothing from each other; very
long texts are worked on in overlapping pieces, so that each k-mer is in one of them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, prefix_sums, releasing, stretch_hash, text_bytes, words_in
from .runs import PIECE, by_key, covered, keyed, runs, shared_runs, spans_from, with_documents, with_parts, word_items
from .suffix import SPANS

#: Words of each gram whose hash keys an edge.
GRAM = 20
#: Edges laid out together, and edges under one key beyond which they are dealt out by their own hash.
SHARD = 1 << 18
HOT = 1 << 20


def edge_hashes(words: np.ndarray, start: int, n: int, k: int) -> np.ndarray:
    """Hashes of n neighbouring k-mers from the given word on."""
    out = []
    for at in range(start, start + n, PIECE):
        many = min(PIECE, start + n - at)
        first = np.arange(many)
        out.append(stretch_hash(prefix_sums(words[at : at + many + k - 1]), first, first + k))
    return np.concatenate(out)


def first_documents(rows: list[dict]) -> list[np.ndarray]:
    """For each row of edges, which of them occur in a document before the row's own first one."""
    edges = [np.frombuffer(r["edges"], np.uint64) for r in rows]
    sizes = [len(e) for e in edges]
    flat = np.concatenate(edges)
    first = np.repeat(np.array([r["first"] for r in rows], dtype=np.int64), sizes)
    order = np.argsort(flat)
    head = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    least = np.minimum.reduceat(first[order], head)
    earlier = np.empty(len(flat), dtype=bool)
    earlier[order] = np.repeat(least, np.diff(np.append(head, len(flat)))) < first[order]
    return np.split(earlier, np.cumsum(sizes)[:-1])


def _in_text():
    return Window.partitionBy("id", "th").orderBy("start")


def _run() -> Column:
    """One number for a run, from its key, digest and length."""
    return F.xxhash64("key", "dig", "n")


def with_neighbours(found: DataFrame) -> DataFrame:
    """Occurrences of runs with before and after: the run that ends where this one starts, and the one that starts where it ends."""
    here = found.withColumn("run", _run())
    after = F.when(F.lead("start").over(_in_text()) == F.col("start") + F.col("n"), F.lead("run").over(_in_text()))
    before = F.when(F.lag(F.col("start") + F.col("n")).over(_in_text()) == F.col("start"), F.lag("run").over(_in_text()))
    return here.withColumn("after", after).withColumn("before", before).drop("run")


def compacted(found: DataFrame) -> DataFrame:
    """The distinct runs of occurrences with neighbours: key, dig, n, many, at (the first occurrence) and glued.

    glued: every occurrence goes on into one and the same run, all of whose occurrences come from this one.
    """
    count = F.count("*").alias("copies")
    out = [F.count("after").alias("outs"), F.min("after").alias("out0"), F.max("after").alias("out1")]
    into = [F.count("before").alias("ins"), F.min("before").alias("in0"), F.max("before").alias("in1")]
    distinct = cut(found.groupBy("key", "dig", "n", "many").agg(F.min(F.struct("id", "th", "start")).alias("at"), count, *out, *into))
    # a link has both its runs for a key, so a run that many others go on into is no hot key
    only = distinct.filter("outs = copies and out0 = out1").select("key", "dig", "n", _run().alias("run"), F.col("out0").alias("next"))
    entered = distinct.filter("ins = copies and in0 = in1").select(F.col("in0").alias("run"), _run().alias("next"))
    glued = only.join(entered, ["run", "next"], "left_semi").select("key", "dig", "n", F.lit(True).alias("glued"))
    return distinct.select("key", "dig", "n", "many", "at").join(glued, ["key", "dig", "n"], "left").withColumn("glued", F.coalesce("glued", F.lit(False)))


def paths(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """Occurrences of nonbranching paths: id, th, start, n (first k-mer and number of them) and head, the first run.

    found: occurrences of runs; distinct: the compacted runs. A path is named by its head and n, as runs that are glued
    always stand together.
    """
    here = found.select("id", "th", "start", "n", "key", "dig").join(distinct.select("key", "dig", "n", "glued"), ["key", "dig", "n"])
    goes_on = F.lag("glued").over(_in_text()) & (F.lag(F.col("start") + F.col("n")).over(_in_text()) == F.col("start"))
    numbered = here.withColumn("path", F.sum(F.when(goes_on, 0).otherwise(1)).over(_in_text().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "th", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min_by(_run(), "start").alias("head")).drop("path")


def words_between(raw: np.ndarray):
    """A function of the first and the past-the-last word that gives those words joined by one space."""
    starts, ends, _ = words_in(raw, np.array([0, len(raw)]))
    keep = ~SPACE[raw]
    keep[ends[ends < len(raw)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    plain = np.where(SPACE[raw], np.uint8(0x20), raw)[keep].tobytes()
    return lambda i, j: plain[at[starts[i]] : at[ends[j - 1]]]


def proven(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """places (as paths() gives them) with proof, a digest of the words that stand at each."""
    asked = places.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n", "head")).alias("asked"))
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("head", pa.int64()), ("proof", pa.binary())])

    def read(batches):
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = text_bytes(batch.column(2))
            for i, asked in enumerate(batch.column(3)):
                words = words_between(raw[int(offsets[i]) : int(offsets[i + 1])])
                out = [{"id": int(ids[i]), "th": int(ths[i]), **x, "proof": xxhash.xxh3_128_digest(words(x["start"], x["start"] + x["n"] + k - 1))} for x in asked.as_py()]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return with_documents(docs, asked, "inner").select("id", "th", "text", "asked").mapInArrow(releasing(read), "id long, th long, start int, n int, head long, proof binary")


def later_places(places: DataFrame) -> DataFrame:
    """id, th, a, b (first and past-the-last k-mer) of the proven places whose path stands in a document of smaller id too."""
    path = ["head", "n", "proof"]
    # both sides of the join stand in files, so a path that stands in very many places can be split in it
    first = cut(places.groupBy(*path).agg(F.min("id").alias("first"), F.max("id").alias("_last")).filter("first < _last").drop("_last"))
    return places.join(first, path).filter(F.col("id") > F.col("first")).select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))


def repeat_spans(docs: DataFrame, k: int) -> DataFrame:
    """id, th and spans (first and past-the-last k-mer) of keyed documents' k-mers that a smaller id has too."""
    found = cut(runs(docs, word_items, k, GRAM))
    found = cut(with_neighbours(shared_runs(found, F.col("low_id") < F.col("high_id"))))
    distinct = cut(compacted(found))
    asked = with_parts(distinct.filter("many"), F.col("n"), HOT)
    asked = asked.groupBy("at.id", "at.th").agg(F.collect_list(F.struct("at.start", "key", "dig", "n", "parts")).alias("asked"))
    dealt = pa.schema([("deal", pa.int64()), ("key", pa.int64()), ("dig", pa.int64()), ("n", pa.int32()), ("first", pa.int64()), ("at", pa.binary()), ("edges", pa.binary())])
    verdicts = pa.schema([("key", pa.int64()), ("dig", pa.int64()), ("n", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def lay_out(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = text_bytes(batch.column(1))
            for i, asked in enumerate(batch.column(2)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                words = word_items(raw[a:b], np.array([0, b - a]))[0]
                out = []
                for x in asked.as_py():
                    edges = edge_hashes(words, x["start"], x["n"], k)
                    own = {"key": x["key"], "dig": x["dig"], "n": x["n"], "first": int(ids[i])}
                    if x["parts"] == 1:
                        out.append({"deal": x["key"], "at": b"", "edges": edges.tobytes(), **own})
                        continue
                    part = edges % np.uint64(x["parts"])
                    for p in np.unique(part):
                        at = np.flatnonzero(part == p)
                        out.append({"deal": x["key"] ^ int(p), "at": at.astype(np.int32).tobytes(), "edges": edges[at].tobytes(), **own})
                yield pa.RecordBatch.from_pylist(out, schema=dealt)

    def settle(batches):
        for rows in by_key(batches, lambda r: len(r["edges"]) // 8, SHARD):
            out = []
            for r, earlier in zip(rows, first_documents(rows), strict=True):
                if earlier.any():
                    flags = np.zeros(r["n"], dtype=bool)
                    flags[np.frombuffer(r["at"], np.int32) if r["at"] else np.arange(r["n"])] = earlier
                    out.append({"key": r["key"], "dig": r["dig"], "n": r["n"], "spans": spans_from(flags)})
            yield pa.RecordBatch.from_pylist(out, schema=verdicts)

    edges = with_documents(docs, asked, "inner").select("id", "text", "asked").mapInArrow(releasing(lay_out), "deal long, key long, dig long, n int, first long, at binary, edges binary")
    partly = edges.repartition("deal").sortWithinPartitions("deal").mapInArrow(releasing(settle), f"key long, dig long, n int, spans {SPANS}")
    partly = cut(partly.select("key", "dig", "n", F.explode("spans").alias("s")).join(distinct.select("key", "dig", "n", F.col("at.id").alias("id")), ["key", "dig", "n"]))
    whole = later_places(cut(proven(docs, paths(found, distinct), k)))
    some = found.join(partly, ["key", "dig", "n", "id"]).select("id", "th", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
    return whole.unionByName(some).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeated_words(docs: DataFrame, k: int = 50) -> DataFrame:
    """doc_id, n_words, kept (the words that stay, joined by one space) and removed (first and past-the-last word of each run that goes)."""
    spans = repeat_spans(keyed(docs), k)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("th", F.xxhash64("text"))
    joined = with_documents(joined, spans, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def run(batches):
        for batch in batches:
            cols = [[], [], []]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode("utf-8").split()
                cols[0].append(len(words))
                mask = covered(spans, k, len(words)) if spans else None
                if mask is not None:
                    words = [words[i] for i in np.flatnonzero(~mask).tolist()]
                cols[1].append(b" ".join(words).decode("utf-8"))
                cols[2].append([] if mask is None else spans_from(mask))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return joined.mapInArrow(releasing(run), f"doc_id long, n_words long, kept string, removed {SPANS}")
