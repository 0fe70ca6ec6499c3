"""The counts of a scope report: where citing chunks sit, how their edges were found, what they cite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs, text
from ..sources.documents import Corpus
from . import corpus as tables
from . import scope


@dataclass
class Recon:
    provision: str
    selected: DataFrame  # the chunks selected, with `citing`
    by_part: DataFrame  # part, n
    by_kind: DataFrame  # kind, n
    by_extraction: DataFrame  # extraction, n
    by_certainty: DataFrame  # certainty, n
    unresolved: DataFrame  # id
    ambiguous: DataFrame  # chunk_ref, id
    cases: DataFrame  # id, citation, n
    volume: DataFrame  # one row: total, citing, pages, selected, words_citing, words_selected


def counts(rows: DataFrame, **keys: Column) -> DataFrame:
    """The keys and n, the rows that have them."""
    return rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"))


def trust_counts(edges: DataFrame, *columns: str) -> DataFrame:
    """How many edges were found in each way: extraction, certainty or both; a dash where there is none."""
    return counts(edges, **{c: text.or_dash(F.col(c)) for c in columns})


def mentions(cases: DataFrame, order: Column) -> DataFrame:
    """id, citation (the last in order) and n of every case, every mention counted; the commonest first."""
    return cases.groupBy("id").agg(F.max_by("citation", order).alias("citation"), F.count("*").alias("n")).orderBy(F.desc("n"), "id")


def words(chunks: DataFrame, *by: str) -> DataFrame:
    """chunks (their number) and words of each group."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.coalesce(F.sum(text.word_count(F.col("text"))), F.lit(0)).alias("words"))


def shares(counted: DataFrame) -> DataFrame:
    """counted with share, each row's part of all chunks in percent."""
    total = counted.agg(F.sum("chunks").alias("_all"))
    return counted.crossJoin(F.broadcast(total)).withColumn("share", text.percent(F.col("chunks"), F.col("_all"))).drop("_all")


def with_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with the other columns of their page, and mark: a star on those that cite."""
    return chunks.join(pages, "page_ref").withColumn("mark", F.when(F.col("citing"), "★").otherwise(""))


def reconnoitre(c: Corpus, provision: str) -> Recon:
    edges = c.edges
    selected = scope.select_chunks(c.chunks, edges, provision).cache()
    citing = selected.filter("citing")
    own = edges.join(selected.select("chunk_ref", "citing"), "chunk_ref")
    matching = own.filter(F.col("citing") & refs.in_scope(F.col("id"), F.lit(provision)))
    cases = c.cases.join(selected.select("chunk_ref"), "chunk_ref", "left_semi")
    counted = text.word_count(F.col("text"))
    total = c.chunks.agg(F.count("*").alias("total"))
    volume = selected.agg(
        F.count_if("citing").alias("citing"), F.countDistinct(F.when(F.col("citing"), F.col("page_ref"))).alias("pages"), F.count("*").alias("selected"),
        F.coalesce(F.sum(F.when(F.col("citing"), counted)), F.lit(0)).alias("words_citing"), F.coalesce(F.sum(counted), F.lit(0)).alias("words_selected"),
    )
    return Recon(
        provision,
        selected,
        counts(citing, part=refs.part_id(F.col("chunk_ref"))).orderBy(F.desc("n"), "part"),
        counts(citing, kind=F.col("kind")).orderBy("kind"),
        trust_counts(matching, "extraction").orderBy("extraction"),
        trust_counts(matching, "certainty").orderBy("certainty"),
        tables.unresolved(own, c.known).orderBy("id"),
        tables.ambiguous(matching).select("chunk_ref", "id").orderBy("chunk_ref", "id"),
        mentions(cases, F.struct("page_ref", "ordinal", "pos")),
        total.crossJoin(volume),
    )


def edge_text(edge: Column, provision: str) -> Column:
    """One edge as a sheet prints it; an arrow marks those in the scope."""
    mark = F.when(refs.in_scope(edge["id"], F.lit(provision)), " ←").otherwise("")
    return F.concat(F.lit("`"), edge["id"], F.lit("` ("), edge["extraction"], F.coalesce(F.concat(F.lit(", "), edge["certainty"]), F.lit("")), F.lit(")"), mark)


def worksheet_rows(c: Corpus, provision: str, mates: bool = True) -> DataFrame:
    """The selected chunks in page order with what a reviewer's sheet prints about each."""
    chosen = scope.select_chunks(c.chunks, c.edges, provision, mates)
    page = c.pages.select("page_ref", "part_id", "url", "nav_title", "last_amended", "amendment_note")

    rows = with_pages(tables.page_breaks(chosen), page)
    return rows.select(
        "page_ref", "ordinal", "chunk_ref", "citing", "opens_page", "part_id", "url", "nav_title", "last_amended", "amendment_note", "kind", "content_hash",
        F.array_join("heading_path", " › ").alias("headings"),
        text.or_dash(F.array_join(F.transform("provisions", lambda e: edge_text(e, provision)), "; ")).alias("edges"),
        text.or_dash(F.array_join(F.transform("cases", lambda x: x["citation"]), "; ")).alias("cases"),
        text.blockquote(F.col("text")).alias("quote"),
    ).orderBy("page_ref", "ordinal")
