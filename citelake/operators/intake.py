"""The intake side: a sheet layout derived from the declared schemas, cells to nested records, and back.

Sheets are read as cells (sheet, row, header, value). A layout is driver metadata; rows are DataFrames.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..model import SheetMismatch
from . import gold_schema as S

#: The sheet of each record type carries its file's name.
SHEETS = {t: f.removesuffix(".yaml") for t, f in S.FILES.items()}


@dataclass(frozen=True)
class Field:
    header: str
    path: tuple[str, ...]
    kind: str  # text, number, boolean, enum or list
    allowed: tuple = ()
    required: bool = False
    nullable: bool = True


@dataclass(frozen=True)
class Sheet:
    name: str
    record_type: str
    fields: tuple[Field, ...]
    parent_field: str | None = None


def _field(path: tuple[str, ...], node: dict, required: bool) -> Field:
    header, types = ".".join(path), node.get("type", [])
    if "enum" in node:
        return Field(header, path, "enum", tuple(v for v in node["enum"] if v is not None), required, None in node["enum"] or "null" in types)
    kind = "boolean" if "boolean" in types else "number" if {"integer", "number"} & set(types) else "text"
    return Field(header, path, kind, (), required, "null" in types or not types)


def _fields(path: tuple[str, ...], node: dict, required: bool) -> tuple[list[Field], list[tuple[str, dict]]]:
    """A node's columns, and the arrays of objects in it that need sheets of their own."""
    choices = [b for b in node.get("oneOf", ()) if b.get("type") != ["null"]]
    if len(choices) == 1:
        found, children = _fields(path, choices[0], required)
        return [replace(f, nullable=True) for f in found], children
    if "properties" in node:
        found, children = [], []
        for name, child in node["properties"].items():
            more, below = _fields((*path, name), child, name in node["required"])
            found += more
            children += below
        return found, children
    if "array" in node.get("type", ()):
        items = node["items"]
        if node.get("maxItems") == 2 and "integer" in items["type"]:
            return [Field(".".join((*path, end)), (*path, end), "number", (), required) for end in ("start", "end")], []
        if "properties" in items:
            return [], [(".".join(path), items)]
        return [Field(".".join(path), path, "list", (), required)], []
    return [_field(path, node, required)], []


@cache
def layout() -> tuple[Sheet, ...]:
    """Parents in the order of the record types, each followed by its child sheets."""
    out = []
    for t in S.RECORD_TYPES:
        found, children = _fields((), S.schema_of(t), True)
        out.append(Sheet(SHEETS[t], t, tuple(found)))
        for name, items in children:
            inner = [f for k, child in items["properties"].items() for f in _fields((k,), child, k in items["required"])[0]]
            parent = Field("parent_id", ("parent_id",), "text", (), True, False)
            out.append(Sheet(f"{S.ID_PREFIXES[t]}--{name}"[:31], t, (parent, *inner), name))
    return tuple(out)


def sheet_named(name: str) -> Sheet | None:
    return next((s for s in layout() if s.name == name), None)


# ---------------------------------------------------------------- DataFrame operators


def header_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """header and state (missing or unknown) for headers that only one side has."""
    e, f = expected.select(F.col("header").alias("e")).distinct(), found.select(F.col("header").alias("f")).distinct()
    joined = e.join(f, F.col("e") == F.col("f"), "full_outer").filter("e is null or f is null")
    return joined.select(F.coalesce("e", "f").alias("header"), F.when(F.col("f").isNull(), "missing").otherwise("unknown").alias("state"))


def blank_columns(fields: list[T.StructField], inside: Column | None = None, prefix: str = "") -> Column:
    """The names of the fields that are null, an empty string or an empty array; fields of a present struct are named with dots."""
    parts = []
    for f in fields:
        value, name = F.col(f.name) if inside is None else inside[f.name], F.array(F.lit(prefix + f.name))
        if isinstance(f.dataType, T.StructType):
            parts.append(F.when(value.isNull(), name).otherwise(blank_columns(f.dataType.fields, value, f"{prefix}{f.name}.")))
            continue
        empty = value == "" if isinstance(f.dataType, T.StringType) else F.size(value) == 0 if isinstance(f.dataType, T.ArrayType) else F.lit(False)
        parts.append(F.when(value.isNull() | empty, name).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def attach_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parents (id) with their children's entries in row order; none gives an empty array."""
    gathered = children.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "entry"))), lambda x: x["entry"]).alias("children"))
    joined = parents.join(gathered, parents["id"] == gathered["parent_id"], "left").drop("parent_id")
    return joined.withColumn("children", F.coalesce("children", F.array().cast(gathered.schema["children"].dataType)))


def orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """children whose parent_id names no parent (id)."""
    return children.join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_anti")


def first_wins(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and all later ones."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    marked = rows.join(first.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")))
    return marked.filter(F.col(order) == F.col("_first")).select(*rows.columns), marked.filter(F.col(order) > F.col("_first")).select(*rows.columns)


def parse_rows(cells: DataFrame, sheet: Sheet) -> DataFrame:
    """row, values (map of header to JSON text, absent if blank) and faults of each non-blank row of a sheet.

    cells: sheet, row, header, value. Blank rows are skipped; a list cell is a JSON array.
    """
    own = cells.filter(F.col("sheet") == sheet.name)
    wide = own.groupBy("row").pivot("header", [f.header for f in sheet.fields]).agg(F.first("value"))
    pairs, faults, filled = [], [], F.lit(False)
    for f in sheet.fields:
        raw = F.col(f"`{f.header}`")
        filled |= text.trim_to_null(raw).isNotNull()
        if f.kind == "list":
            items = F.coalesce(text.list_items(raw), F.array().cast("array<string>"))
            pairs.append((f.header, F.to_json(items)))
            continue
        value, bad = text.cell(raw, f.kind, f.allowed)
        number = f.kind in ("number", "boolean") or (f.allowed and not isinstance(f.allowed[0], str))
        pairs.append((f.header, value if number else F.when(value.isNotNull(), _quoted(value))))
        said = f" is not one of {', '.join(map(str, f.allowed))}" if f.allowed else f" is not a {f.kind}"
        faults.append(F.when(bad, F.concat(F.lit(f"{f.header} is '"), text.trim_to_null(raw), F.lit(f"', which{said}"))))
        if f.required and not f.nullable:
            faults.append(F.when(value.isNull() & ~bad, F.lit(f"{f.header} is blank: the row makes no record")))
    if any(f.path[:1] == ("span",) for f in sheet.fields):
        start, end = (text.trim_to_null(F.col(f"`span.{x}`")) for x in ("start", "end"))
        faults.append(F.when(start.isNull() != end.isNull(), F.lit("span.start and span.end must be given together, or neither")))
    values = F.map_filter(F.map_from_arrays(F.array(*[F.lit(h) for h, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())
    return wide.filter(filled).select("row", values.alias("values"), F.array_compact(F.array(*faults)).cast("array<string>").alias("faults"))


def _quoted(value: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


# ---------------------------------------------------------------- records


@dataclass
class Transcription:
    """Records by type, rejected rows as (sheet, row, message), blank judgement fields and sheets without rows."""

    records: dict[str, list[dict]] = field(default_factory=dict)
    problems: list[tuple[str, int | None, str]] = field(default_factory=list)
    blanks: list[tuple[str, str, str]] = field(default_factory=list)
    empty: list[str] = field(default_factory=list)

    def summary(self) -> str:
        total = sum(map(len, self.records.values()))
        return f"{total} record(s) from {len(self.records)} sheet(s); {len(self.problems)} rejected row(s); {len(self.blanks)} blank judgement field(s)"


def _record(sheet: Sheet, values: dict[str, str]) -> dict:
    """One row's values as a nested record; optional blanks of parents are left out."""
    out: dict = {}
    for f in sheet.fields:
        node = out
        for key in f.path[:-1]:
            node = node.setdefault(key, {})
        node[f.path[-1]] = json.loads(values[f.header]) if f.header in values else None
    span = out.get("span")
    if isinstance(span, dict):
        out["span"] = None if span["start"] is None else [span["start"], span["end"]]
    if sheet.parent_field is None:
        needed = S.required_fields(sheet.record_type)
        out = {k: v for k, v in out.items() if k in needed or v not in (None, "", [])}
    return out


def blanks_of(record: dict, prefix: str = "") -> list[str]:
    out = []
    for k, v in record.items():
        if v in (None, "", []) and not isinstance(v, bool):
            out.append(prefix + k)
        elif isinstance(v, dict):
            out += blanks_of(v, f"{prefix}{k}.")
    return out


def check_headers(cells: DataFrame) -> None:
    """Refuses sheets whose headers are not exactly the layout's (headers stand in row 1)."""
    top = cells.filter((F.col("row") == 1) & text.trim_to_null(F.col("value")).isNotNull()).select("sheet", text.strip(F.col("value")).alias("header"))
    seen: dict[str, list[str]] = {}
    for r in top.collect():  # a few dozen headers
        seen.setdefault(r["sheet"], []).append(r["header"])
    for sheet in layout():
        have, want = seen.get(sheet.name), {f.header for f in sheet.fields}
        if have is None:
            continue
        if twice := sorted({h for h in have if have.count(h) > 1}):
            raise SheetMismatch(f"{sheet.name}: the column {twice[0]!r} appears twice")
        if want != set(have):
            raise SheetMismatch(f"{sheet.name}: missing {sorted(want - set(have))}, unknown {sorted(set(have) - want)}")


def transcribe(cells: DataFrame, sheets: list[str]) -> Transcription:
    """Cells (sheet, row, header, value; headers in row 1) to validated records.

    sheets: the sheets that are there at all. Parsing, joins and validation run in Spark; records of one workbook are
    few, so they are nested on the driver.
    """
    check_headers(cells)
    spark, out = cells.sparkSession, Transcription()
    body = cells.filter("row > 1")
    parents: dict[str, dict] = {}
    present = [s for s in layout() if s.name in sheets]
    for sheet in sorted(present, key=lambda s: s.parent_field is not None):
        rows = parse_rows(body, sheet).orderBy("row").collect()
        good = []
        for r in rows:
            out.problems += [(sheet.name, r["row"], m) for m in r["faults"]]
            if not r["faults"]:
                good.append((r["row"], _record(sheet, r["values"])))
        if sheet.parent_field is None:
            if not good:
                out.empty.append(sheet.record_type)
                continue
            own = parents.setdefault(sheet.record_type, {})
            for number, record in good:
                if record["id"] in own:
                    out.problems.append((sheet.name, number, f"id {record['id']} is used twice"))
                else:
                    own[record["id"]] = record
        else:
            own = parents.get(sheet.record_type, {})
            for record in own.values():
                record.setdefault(sheet.parent_field, [])
            for number, entry in good:
                parent = own.get(entry.pop("parent_id"))
                if parent is None:
                    out.problems.append((sheet.name, number, f"parent_id names no record on the sheet {SHEETS[sheet.record_type]}"))
                else:
                    parent[sheet.parent_field].append(entry)
    ordered = {t: [{k: r[k] for k in S.property_order(t) if k in r} for r in own.values()] for t, own in parents.items()}
    flat = [(t, i, json.dumps(r, ensure_ascii=False)) for t, rs in ordered.items() for i, r in enumerate(rs)]
    wrong: dict[tuple[str, int], list[str]] = {}
    if flat:
        for e in S.validate(spark.createDataFrame(flat, "record_type string, pos int, raw string"), tuple(ordered)).orderBy("record_type", "pos", "sub").collect():
            wrong.setdefault((e["record_type"], e["pos"]), []).append(f"at {e['path'] or '<root>'}: {e['message']}")
    for t, rs in ordered.items():
        for i, r in enumerate(rs):
            if (t, i) in wrong:
                out.problems += [(SHEETS[t], None, f"{r['id']}: {m}") for m in wrong[t, i]]
            else:
                out.records.setdefault(t, []).append(r)
                out.blanks += [(t, r["id"], name) for name in blanks_of(r)]
    return out


def to_cells(records: dict[str, list[dict]]) -> list[tuple[str, int, str, str | None]]:
    """Records as cells (sheet, row, header, value), headers in row 1: the inverse of transcribe()."""
    out = []
    for sheet in layout():
        out += [(sheet.name, 1, f.header, f.header) for f in sheet.fields]
        row = 2
        for record in records.get(sheet.record_type, ()):
            entries = [record] if sheet.parent_field is None else [{"parent_id": record.get("id"), **e} for e in record.get(sheet.parent_field) or ()]
            for entry in entries:
                out += [(sheet.name, row, f.header, _shown(entry, f)) for f in sheet.fields]
                row += 1
    return out


def _shown(record: dict, f: Field) -> str | None:
    if f.path[0] == "span" and len(f.path) == 2:
        span = record.get("span")
        return str(span[f.path[1] == "end"]) if span else None
    node = record
    for key in f.path:
        node = node.get(key) if isinstance(node, dict) else None
    if node is None:
        return None
    if f.kind == "list":
        return "\n".join(map(str, node)) or None
    return str(node)
