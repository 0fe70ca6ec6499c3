"""Readers of page and provision documents, typed projection, drift checks, re-emission and Parquet landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..functions import refs
from ..operators import corpus

#: What an absent key means, by record and field; arrays default to empty ones.
DEFAULTS = {"chunk": {"kind": "body"}}
#: Arrays carried as JSON text, which default to [].
JSON_ARRAYS = {
    "chunk": ("headings", "blocks", "links", "emphasis", "tables"),
    "page": ("images", "amendments"),
    "unit": ("emphasis",),
    "provision": ("containers", "units"),
}
#: Records whose empty optional fields are left out when written again.
LEAN = ("unit", "edge", "case_edge", "internal_ref")
NESTED = {"chunk": {"provisions": "edge", "cases": "case_edge", "internal_refs": "internal_ref"}, "unit": {"provisions": "edge"}}
#: Fields that hold refs, with the kind that their place states.
REF_FIELDS = {"chunk": {"chunk_ref": M.MANUAL_CHUNK, "page_ref": M.MANUAL_PAGE}, "page": {"page_ref": M.MANUAL_PAGE}, "provision": {"ref": M.PROVISION}, "unit": {"ref": M.UNIT}}


def unknown_keys(raw: Column, known: tuple[str, ...]) -> Column:
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in known]))


def missing_keys(raw: Column, needed: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in needed]), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))


def _inner_raw(raw: Column, field: str) -> Column:
    """The JSON texts of an array field's elements."""
    return F.coalesce(F.from_json(raw, f"{field} array<string>")[field], F.array().cast("array<string>"))


def drift(raw: Column, record: str) -> Column:
    """array<string>: unknown and missing keys of a record and of the records nested in it."""
    known = tuple(M.SCHEMAS[record].fieldNames())
    said = F.concat(
        F.transform(unknown_keys(raw, known), lambda k: F.concat(F.lit(f"{record}: unknown field "), k)),
        F.transform(missing_keys(raw, M.REQUIRED_KEYS[record]), lambda k: F.concat(F.lit(f"{record}: missing field "), k)),
    )
    for field, inner in NESTED.get(record, {}).items():
        said = F.concat(said, F.flatten(F.transform(_inner_raw(raw, field), _drift_of(inner))))
    return F.coalesce(said, F.array().cast("array<string>"))


def _drift_of(record: str):
    return lambda raw: drift(raw, record)


def typed(raws: DataFrame, record: str, strict: bool = True) -> DataFrame:
    """Columns of the record from JSON texts (column raw), with defaults for absent optional fields.

    Further columns stay. strict refuses unknown and missing fields; otherwise `drift` tells of them.
    """
    schema = M.SCHEMAS[record]
    out = raws.withColumn("_r", F.from_json("raw", schema)).withColumn("drift", drift(F.col("raw"), record))
    if strict:
        fine = F.when(F.size("drift") > 0, F.raise_error(F.concat(F.lit("schema drift: "), F.col("drift")[0])).cast(schema)).otherwise(F.col("_r"))
        out = out.withColumn("_r", fine).drop("drift")
    cols = []
    for f in schema.fields:
        value = F.col("_r")[f.name]
        if isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast(f.dataType))
        elif f.name in JSON_ARRAYS.get(record, ()):
            value = F.coalesce(value, F.lit("[]"))
        elif f.name in DEFAULTS.get(record, {}):
            value = F.coalesce(value, F.lit(DEFAULTS[record][f.name]))
        cols.append(value.alias(f.name))
    others = [c for c in out.columns if c not in ("raw", "_r", *schema.fieldNames())]
    return out.select(*others, *cols)


def to_json(record: str, columns: list[str] | None = None) -> Column:
    """The record as JSON text. Payloads are VARIANT again; lean records leave empty optional fields out."""
    raw_json = {"chunk": ("fragment", *JSON_ARRAYS["chunk"]), "page": JSON_ARRAYS["page"], "unit": ("number_collision", "table", *JSON_ARRAYS["unit"]), "provision": JSON_ARRAYS["provision"]}.get(record, ())
    needed, fields = M.REQUIRED_KEYS[record], []
    for f in M.SCHEMAS[record].fields:
        value = F.parse_json(f.name) if f.name in raw_json else F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and f.name in NESTED.get(record, {}):
            value = F.parse_json(F.to_json(F.col(f.name)))  # nested edges never write nulls
        if record in LEAN and f.name not in needed:
            empty = F.coalesce(F.col(f.name).cast("string") == "[]", F.lit(False)) if not isinstance(f.dataType, T.ArrayType) else F.size(f.name) == 0
            value = F.when(~empty, value)
        fields.append(value.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true" if record in LEAN else "false"})


def impossible_refs(rows: DataFrame, record: str) -> DataFrame:
    """field and ref of every ref field that does not hold a ref of its kind."""
    out = None
    for field, kind in REF_FIELDS[record].items():
        bad = rows.filter(refs.ref_kind(F.col(field), kind).isNull()).select(F.lit(field).alias("field"), F.col(field).alias("ref"))
        out = bad if out is None else out.unionByName(bad)
    for field in NESTED.get(record, {}):
        key = "ref" if field == "internal_refs" else "id"
        each = rows.select(F.explode(field).alias("e")).select(F.col(f"e.{key}").alias("ref"))
        out = out.unionByName(each.filter(~F.coalesce(refs.is_ref(F.col("ref")), F.lit(False))).select(F.lit(f"{field}.{key}").alias("field"), "ref"))
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """file and raw of the JSON documents beneath a path."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True)
    return reader.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))


def read_pages(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages and chunks of the page documents {page, chunks[]} beneath a path; of equal refs the last wins."""
    raw = read_raw(spark, path).withColumn("d", F.from_json("raw", "page string, chunks array<string>"))
    pages = typed(raw.select(F.col("file").alias("_file"), F.col("d.page").alias("raw")), "page", strict)
    chunks = typed(raw.select(F.col("file").alias("_file"), F.posexplode("d.chunks").alias("_pos", "raw")), "chunk", strict)
    return (
        corpus.last_wins(pages, ["page_ref"], ["_file"]).drop("_file"),
        corpus.last_wins(chunks, ["chunk_ref"], ["_file", "_pos"]).drop("_file", "_pos"),
    )


def read_provisions(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Provisions and their units; of equal refs the last wins."""
    ours = F.col("file").rlike("/provisions/[^/]+/[^/]+\\.json$")  # other files are blanked first: filters may run after the drift check
    raw = read_raw(spark, path).select(F.col("file").alias("_file"), F.when(ours, F.col("raw")).alias("raw"))
    provisions = typed(raw, "provision", strict).filter("ref is not null")
    units = typed(provisions.select("_file", F.col("ref").alias("provision_ref"), F.posexplode(F.from_json("units", "array<string>")).alias("_pos", "raw")), "unit", strict)
    return (
        corpus.last_wins(provisions, ["ref"], ["_file"]).drop("_file"),
        corpus.last_wins(units, ["ref"], ["_file", "_pos"]).drop("_file", "_pos"),
    )


def edges_of(chunks: DataFrame) -> DataFrame:
    """chunk_ref, page_ref, pos and the fields of every provision edge."""
    return chunks.select("chunk_ref", "page_ref", F.posexplode("provisions").alias("pos", "e")).select("chunk_ref", "page_ref", "pos", "e.*")


def cases_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_ref", "page_ref", "ordinal", F.posexplode("cases").alias("pos", "e")).select("chunk_ref", "page_ref", "ordinal", "pos", "e.*")


def land(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables as Parquet, one folder each, sorted within files by their first column."""
    for name, df in tables.items():
        df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(f"{folder}/{name}")


class Corpus:
    """The corpus tables: pages, chunks, provisions, units, and what is derived from them."""

    def __init__(self, pages: DataFrame, chunks: DataFrame, provisions: DataFrame, units: DataFrame):
        self.pages, self.chunks, self.provisions, self.units = pages, chunks, provisions, units

    @classmethod
    def read(cls, spark: SparkSession, root: str, strict: bool = True) -> Corpus:
        pages, chunks = read_pages(spark, f"{root}/snapshot/pages", strict)
        provisions, units = read_provisions(spark, f"{root}/snapshot/legislation", strict)
        return cls(pages, chunks, provisions, units)

    @classmethod
    def landed(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(*[spark.read.parquet(f"{folder}/{n}") for n in ("pages", "chunks", "provisions", "units")])

    def land(self, folder: str) -> None:
        land({"pages": self.pages, "chunks": self.chunks, "provisions": self.provisions, "units": self.units}, folder)

    @property
    def edges(self) -> DataFrame:
        return edges_of(self.chunks)

    @property
    def cases(self) -> DataFrame:
        return cases_of(self.chunks)

    @property
    def known(self) -> DataFrame:
        return self.provisions.select("ref").union(self.units.select("ref")).distinct()

    @property
    def targets(self) -> DataFrame:
        page = self.pages.select(F.col("page_ref").alias("ref"), F.lit(None).cast("string").alias("text"), "content_hash")
        return corpus.targets(chunk=self.chunks.withColumnRenamed("chunk_ref", "ref"), page=page, provision=self.provisions, unit=self.units)


def count_mismatches(pinned: DataFrame, measured: DataFrame) -> DataFrame:
    """name, expected and measured where a pinned count (name, expected) is not the measured one; none counts as another."""
    m = measured.select(F.col("name").alias("_n"), "measured")
    joined = pinned.join(m, F.col("name") == F.col("_n"), "left")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("measured"))).select("name", "expected", "measured")
