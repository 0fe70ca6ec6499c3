"""Corpus tables and joins: resolution targets, coverage, deduplication, page order and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs

#: Where a ref may resolve, in the order in which it is looked up.
LEVELS = ("chunk", "page", "provision", "unit")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each key the row that is last in order; the order should be total."""
    fields = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in rows.columns])


def targets(**tables: DataFrame) -> DataFrame:
    """ref, level, text, content_hash over chunk, page, provision and unit tables (any of them), one row for each ref.

    Each table has columns ref, text and content_hash; a ref in several tables keeps the first level of LEVELS. Every
    column is an aggregate of its own, so that texts are neither read nor shuffled for a plan that does not use them.
    """
    parts = [tables[name].select("ref", F.lit(name).alias("level"), F.lit(i).alias("_rank"), "text", "content_hash") for i, name in enumerate(LEVELS) if name in tables]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    order = F.struct("_rank", "content_hash")
    return both.groupBy("ref").agg(*[F.min_by(c, order).alias(c) for c in ("level", "text", "content_hash")])


def resolve(rows: DataFrame, found: DataFrame, column: str = "ref") -> DataFrame:
    """rows with level, target_text and target_hash of the target that their ref names.

    Case refs get the level `case` and no text; a manual ref reaches chunks and pages only, a legislation ref
    provisions and units only; what resolves to nothing has a null level.
    """
    kind = refs.ref_kind(F.col(column))
    t = found.select(F.col("ref").alias("_t"), F.col("level").alias("_level"), F.col("text").alias("_text"), F.col("content_hash").alias("_hash"))
    side = F.when(kind.isin("manual", "manual_page", "manual_chunk"), F.col("_level").isin("chunk", "page")).when(kind.isin("legislation", "provision", "unit"), F.col("_level").isin("provision", "unit")).otherwise(False)
    joined = rows.join(t, F.col(column) == F.col("_t"), "left")
    return joined.select(
        *rows.columns,
        F.when(kind == "case", F.lit("case")).when(side, F.col("_level")).alias("level"),
        F.when(side, F.col("_text")).alias("target_text"),
        F.when(side, F.col("_hash")).alias("target_hash"),
    )


def join_coverage(edges: DataFrame, known: DataFrame) -> DataFrame:
    """total, in_scope, resolved, unresolved and coverage of edges (column id) against known refs (column ref)."""
    counted = edges.groupBy("id").agg(F.count("*").alias("n"))
    marked = counted.join(known.select("ref").distinct().withColumn("_known", F.lit(True)), F.col("id") == F.col("ref"), "left")
    held = refs.held(F.col("id"))
    out = marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("in_scope"),
        F.coalesce(F.sum(F.when(held & F.col("_known").isNotNull(), F.col("n"))), F.lit(0)).alias("resolved"),
    )
    return out.select("*", (F.col("in_scope") - F.col("resolved")).alias("unresolved"), F.coalesce(F.try_divide("resolved", "in_scope"), F.lit(0.0)).alias("coverage"))


def unresolved(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct ids of held instruments that no known ref (column ref) equals."""
    return edges.filter(refs.held(F.col("id"))).select("id").distinct().join(known.select(F.col("ref").alias("id")), "id", "left_anti")


def ambiguous(edges: DataFrame) -> DataFrame:
    """Edges whose certainty asks for a human."""
    return edges.filter(F.col("certainty").eqNullSafe("ambiguous"))


def own_links(edges: DataFrame) -> DataFrame:
    """Edges that the authors linked themselves."""
    return edges.filter(F.col("extraction") == "href")


def misprinted(pages: DataFrame) -> DataFrame:
    """Pages whose own heading names another page."""
    return pages.filter(F.col("printed_page_ref").isNotNull())


def unit_refs(provisions: DataFrame) -> DataFrame:
    """ref and unit_refs: the refs of a provision's units, as the document lists them (column units: JSON texts)."""
    return provisions.select("ref", F.transform(F.from_json("units", "array<struct<ref:string>>"), lambda u: u["ref"]).alias("unit_refs"))


def ordered_pages(chunks: DataFrame) -> DataFrame:
    """page_ref and its chunk refs in ordinal order."""
    return chunks.groupBy("page_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_ref"))), lambda x: x["chunk_ref"]).alias("chunk_refs"))


def page_breaks(chunks: DataFrame) -> DataFrame:
    """chunks with `opens_page`: whether the chunk is the first of its page in page and ordinal order."""
    w = Window.partitionBy("page_ref").orderBy("ordinal", "chunk_ref")
    return chunks.withColumn("opens_page", F.row_number().over(w) == 1)


def digest_of(files: DataFrame, group: str | None = None) -> DataFrame:
    """The digest of files (path, sha256): each path, a zero byte, its hash and a newline, in path order, hashed.

    Paths are ordered by their components; rank (optional column) orders the listed roots before that. With a
    group, one digest for each value of it. A digest is over all its lines in order, so they meet in one row (some
    hundred bytes a file): a group may hold some million files, no more.
    """
    rank = F.col("rank") if "rank" in files.columns else F.lit(0)
    line = F.concat(F.col("path"), F.lit("\x00"), F.col("sha256"), F.lit("\n"))
    gathered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.split("path", "/").alias("p"), line.alias("line"))))
    digest = F.sha2(F.array_join(F.transform(gathered, lambda x: x["line"]), "").cast("binary"), 256).alias("digest")
    return (files.groupBy(group) if group else files.groupBy()).agg(digest)
