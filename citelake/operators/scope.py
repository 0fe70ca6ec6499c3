"""Which chunks a scope selects: citing chunks, their page-mates, and many scopes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs


def cites(edges: Column, scope: str) -> Column:
    """Whether any of a chunk's edges (array of structs with id) lies in the scope."""
    return F.exists(edges, lambda e: refs.in_scope(e["id"], F.lit(scope)))


def citing_chunks(edges: DataFrame, scope: str) -> DataFrame:
    """chunk_ref and page_ref of the chunks with an edge (chunk_ref, page_ref, id) in the scope."""
    return edges.filter(refs.in_scope(F.col("id"), F.lit(scope))).select("chunk_ref", "page_ref").distinct()


def page_mates(chunks: DataFrame, citing: DataFrame) -> DataFrame:
    """All chunks on a page that has a citing chunk."""
    return chunks.join(citing.select("page_ref").distinct(), "page_ref", "left_semi").select(*chunks.columns)


def select_chunks(chunks: DataFrame, edges: DataFrame, scope: str, mates: bool = True) -> DataFrame:
    """The chunks a scope selects, with `citing`: whether the chunk itself has an edge in the scope."""
    citing = citing_chunks(edges, scope)
    out = page_mates(chunks, citing) if mates else chunks.join(citing.select("chunk_ref"), "chunk_ref", "left_semi").select(*chunks.columns)
    marks = citing.select(F.col("chunk_ref").alias("_ref"))
    return out.join(marks, F.col("chunk_ref") == F.col("_ref"), "left").select(*chunks.columns, F.col("_ref").isNotNull().alias("citing"))


def scopes_of_edges(edges: DataFrame, scopes: DataFrame) -> DataFrame:
    """edges with the `scope` of each of many scopes (column scope) that covers them.

    A ref's ancestors meet the scopes by equality, so no number of scopes needs a nested loop.
    """
    return edges.withColumn("scope", F.explode(refs.ancestors(F.col("id")))).join(scopes.select("scope").distinct(), "scope").select(*edges.columns, "scope")
