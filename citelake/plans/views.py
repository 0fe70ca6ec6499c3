"""The driver's tables re-labelled as a citation corpus; each view has the same definition in SQL (see oracle.VIEWS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(x: Column) -> Column:
    return x.cast("string")


def _hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _page_ref(conv: Column) -> Column:
    return F.concat(F.lit("TMM/Part"), _text(conv % 60 + 1), F.lit("/"), _text(conv))


class Views:
    """DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self) -> DataFrame:
        page = _page_ref(F.col("conv_id"))
        return self.table("conversations").select(
            page.alias("page_ref"), F.concat(page, F.lit("#"), _text(F.col("turn"))).alias("chunk_ref"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("kind"), "text", _hash(F.col("text")).alias("content_hash")
        )

    def pages(self) -> DataFrame:
        """One page for each conversation's chunks, with the address of the page of its part's number."""
        page = _page_ref(F.col("conv_id"))
        chunk_pages = self.table("conversations").select(page.alias("page_ref"), (F.col("conv_id") % 60 + 1).alias("_part")).distinct()
        return chunk_pages.join(self.table("pages").select(F.col("page_id").alias("_part"), "url"), "_part").select("page_ref", "url")

    def printed_pages(self) -> DataFrame:
        """Pages of which some print a ref of their own."""
        i = F.col("page_id")
        return self.table("pages").select(_text(i).alias("page_ref"), F.when(i % 7 == 0, F.concat(F.lit("TMM/Part"), _text(i))).alias("printed_page_ref"))

    def whole_provisions(self) -> DataFrame:
        """Provisions with their units as JSON text, as a document carries them."""
        ref = F.concat(F.lit("TMA1995/s"), _text(F.col("p_partkey")))
        numbers = F.when(F.col("p_size") > 10, F.sequence(F.lit(1), F.col("p_size").cast("int") % 4 + 1)).otherwise(F.array().cast("array<int>"))
        units = F.transform(numbers, lambda k: F.struct(F.concat(ref, F.lit("("), _text(k), F.lit(")")).alias("ref"), k.alias("ordinal")))
        return self.table("part").select(ref.alias("ref"), F.to_json(units).alias("units"))

    def edges(self) -> DataFrame:
        """Every lineitem cites one ref from the first or second chunk of a page."""
        many = self.table("conversations").agg((F.max("conv_id") + 1).alias("_n"))
        page = _page_ref(F.col("l_orderkey") % F.col("_n"))
        line, part = _text(F.col("l_linenumber")), F.col("l_partkey")
        act = F.concat(F.lit("TMA1995/s"), _text(part), F.when(F.col("l_linenumber") > 3, F.concat(F.lit("("), line, F.lit(")"))).otherwise(""))
        rule = F.concat(F.lit("TMR1995/r"), _text(F.col("l_suppkey")), F.lit("."), line)
        cert = F.when(F.col("l_linenumber") % 3 == 0, "default").when(F.col("l_linenumber") % 3 == 1, "ambiguous").otherwise("explicit")
        return self.table("lineitem").crossJoin(F.broadcast(many)).select(
            page.alias("page_ref"),
            F.concat(page, F.lit("#"), _text(F.col("l_linenumber") % 2)).alias("chunk_ref"),
            F.when(part % 97 == 0, F.lit("AIA1901/s7")).when(F.col("l_returnflag") == "R", rule).otherwise(act).alias("id"),
            F.when(F.col("l_linestatus") == "F", "href").otherwise("regex").alias("extraction"),
            F.when(F.col("l_linestatus") != "F", cert).alias("certainty"),
        )

    def provisions(self) -> DataFrame:
        ref = F.concat(F.lit("TMA1995/s"), _text(F.col("p_partkey")))
        return self.table("part").filter("p_partkey % 11 <> 0").select(ref.alias("ref"), F.col("p_name").alias("text"), _hash(F.col("p_name")).alias("content_hash"))

    def units(self) -> DataFrame:
        """Units (4) and (5) of larger parts, and some under the provision's own ref."""
        ref = F.concat(F.lit("TMA1995/s"), _text(F.col("p_partkey")))
        tails = F.filter(F.array(F.when(F.col("p_size") > 10, F.lit("(4)")), F.when(F.col("p_size") > 10, F.lit("(5)")), F.when(F.col("p_partkey") % 7 == 0, F.lit(""))), lambda t: t.isNotNull())
        return self.table("part").select(ref.alias("_r"), "p_type", F.explode(tails).alias("t")).select(F.concat("_r", "t").alias("ref"), F.col("p_type").alias("text"), _hash(F.col("p_type")).alias("content_hash"))

    def known(self) -> DataFrame:
        return self.provisions().select("ref").union(self.units().select("ref")).distinct()

    def gold(self) -> DataFrame:
        """Labelled documents as entity records, with faults planted by the id."""
        d = F.col("doc_id")
        return self.table("labels").join(self.table("documents"), "doc_id").select(
            d,
            F.concat(F.lit("GE-"), F.lpad(_text(d), 9, "0")).alias("id"),
            F.concat(F.lit("TMM/Part1/"), _text(d), F.lit("#0")).alias("source_ref"),
            F.concat(F.when(d % 13 == 0, "~").otherwise(""), F.substring("text", 1, 10)).alias("surface"),
            F.when(d % 23 == 0, 0).otherwise(10).alias("end"),
            F.when(d % 10 == 0, F.concat(F.lit("sha256:"), F.sha2(F.lit("old").cast("binary"), 256))).otherwise(_hash(F.col("text"))).alias("recorded"),
            F.col("lang").alias("type"),
            F.when(F.col("toxic") != 1, F.lit("reviewer")).alias("approved_by"),
            F.when(F.col("quality") != 0, F.lit("2024-01-01")).alias("approved_date"),
            "quality",
            "toxic",
        )

    def passages(self) -> dict[str, DataFrame]:
        """Documents as targets: chunks, some of them pages without text, some missing."""
        rows = self.table("documents").filter("doc_id % 17 <> 0").select("doc_id", F.concat(F.lit("TMM/Part1/"), _text(F.col("doc_id")), F.lit("#0")).alias("ref"), "text", _hash(F.col("text")).alias("content_hash"))
        return {
            "chunk": rows.filter("doc_id % 19 <> 0").drop("doc_id"),
            "page": rows.filter("doc_id % 19 = 0").select("ref", F.lit(None).cast("string").alias("text"), "content_hash"),
        }

    def retired(self) -> DataFrame:
        return self.table("labels").filter("quality = 0").select(F.concat(F.lit("GE-"), F.lpad(_text(F.col("doc_id")), 9, "0")).alias("id"), F.lit("2023-05-01").alias("retired_on"))

    def records(self) -> DataFrame:
        """The gold rows as JSON records (record_type, file, pos, raw) with declared-schema faults."""
        g = self.gold()
        body = F.struct(
            "id",
            "surface",
            F.when(F.col("doc_id") % 5 == 0, "LAW").otherwise("Other").alias("type"),
            "source_ref",
            F.array(F.lit(0), "end").alias("span"),
            F.col("recorded").alias("source_content_hash"),
            "approved_by",
            "approved_date",
        )
        raw = F.to_json(body, {"ignoreNullFields": "false"})
        return g.select(F.lit("gold_entity").alias("record_type"), F.lit("entities.yaml").alias("file"), F.col("doc_id").cast("int").alias("pos"), raw.alias("raw"))


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)
