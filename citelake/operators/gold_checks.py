"""The checks over evaluation records: one DataFrame of findings for each, one union, one status.

records: record_type, file, pos (place in the file), raw (JSON text). Findings: check_seq, type_seq, pos, sub (their
order), severity, check, subject, message. Structural checks run on records that break their schema, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text
from . import corpus
from . import gold_schema as S

FINDING = "check_seq int, type_seq int, pos int, sub long, severity string, check string, subject string, message string"
ORDER = ("check_seq", "type_seq", "pos", "sub")


@dataclass(frozen=True)
class Deliverable:
    key: str
    label: str
    record_type: str | None = None
    path: str | None = None
    low: int | None = None
    high: int | None = None


# What must be delivered, which fields need a judgement, and what names what.
DELIVERABLES = (
    Deliverable("pilot_scope", "Pilot scope, with exclusions", path="eval/pilot-scope.md"),
    Deliverable("competency_questions", "Competency questions, covering all six categories", "competency_question", low=6),
    Deliverable("prohibited_uses", "Prohibited uses, covering all six kinds", "prohibited_use", low=6),
    Deliverable("concepts", "Gold concepts", "gold_concept", low=50, high=100),
    Deliverable("entities", "Gold entities, over an exhaustively annotated chunk set", "gold_entity", low=100, high=300),
    Deliverable("relationships", "Gold relationships", "gold_relationship", low=50, high=100),
    Deliverable("search_questions", "Search questions", "gold_search_question", low=20, high=50),
    Deliverable("retrieval_questions", "AI retrieval questions", "gold_retrieval_question", low=20, high=50),
    Deliverable("reasoning", "Reasoning expectations", "reasoning_expectation", low=1),
    Deliverable("measures", "A threshold against every metric", path="eval/measures.md"),
)
JUDGEMENT_FIELDS = {"gold_entity": ("span", "source_content_hash"), "gold_relationship": ("span", "source_content_hash", "tier", "modality"), "reasoning_expectation": ("tier",)}
CROSS_REFERENCES = (
    ("gold_concept", "broader", ("GC",)),
    ("gold_concept", "narrower", ("GC",)),
    ("gold_concept", "related", ("GC",)),
    ("gold_retrieval_question", "prohibited_conclusions", ("PU",)),
    ("reasoning_expectation", "must_not_infer", ("PU",)),
    ("prohibited_use", "related_questions", ("CQ", "GA")),
)
SURFACES = {"gold_entity": "surface", "gold_relationship": "supporting_text"}
ENUM_COVERAGE = (("competency_question", "category", "competency-question category"), ("prohibited_use", "kind", "prohibited-use kind"))


# ---------------------------------------------------------------- shared columns


def prepared(records: DataFrame) -> DataFrame:
    """records with v (the VARIANT), id (a string id or null), subject, type_seq (alphabetical order of types)."""
    v = F.parse_json("raw")
    given = S.get(F.col("v"), "id")
    shown = F.when(S.missing(given), F.lit("")).otherwise(F.coalesce(S.text_of(given), F.to_json(given)))
    order = {t: i for i, t in enumerate(sorted(S.RECORD_TYPES))}
    seq = reduce(lambda c, t: c.when(F.col("record_type") == t, order[t]), order, F.when(F.lit(False), -1))
    return records.withColumn("v", v).withColumn("id", S.text_of(given)).withColumn("type_seq", seq.cast("int")).withColumn(
        "subject", F.when(shown.isin("", "0", "false"), F.concat(F.lit("<"), F.col("record_type"), F.lit(" with no id>"))).otherwise(shown)
    )


def _seq(name: str) -> int:
    return ("gold-file", "schema", "ids", "cross-reference", "approval", "judgement", "coverage", "completeness", "resolution", "span", "staleness").index(name)


def _finding(rows: DataFrame, check_seq: int, severity: str, check: str, subject: Column, message: Column, sub: Column | None = None, type_seq: Column | None = None, pos: Column | None = None) -> DataFrame:
    cols = [
        F.lit(check_seq).alias("check_seq"),
        (F.col("type_seq") if type_seq is None else type_seq).cast("int").alias("type_seq"),
        (F.col("pos") if pos is None else pos).cast("int").alias("pos"),
        (F.lit(0) if sub is None else sub).cast("long").alias("sub"),
        F.lit(severity).alias("severity"),
        F.lit(check).alias("check"),
        subject.alias("subject"),
        message.alias("message"),
    ]
    return rows.select(*cols)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _is(record_type: str) -> Column:
    return F.col("record_type") == record_type


# ---------------------------------------------------------------- structural checks


def unreadable(files: DataFrame) -> DataFrame:
    """files: pos, file, reason."""
    return _finding(files, _seq("gold-file"), M.DEFECT, "gold-file", F.col("file"), F.col("reason"), type_seq=F.lit(0))


def schema(gold: DataFrame, types: tuple[str, ...] = S.RECORD_TYPES) -> DataFrame:
    found = S.validate(gold.select("record_type", "pos", "raw"), types)
    rows = found.join(gold.select("record_type", "pos", "type_seq", "subject"), ["record_type", "pos"])
    where = F.when(F.col("path") == "", "<root>").otherwise(F.col("path"))
    return _finding(rows, _seq("schema"), M.DEFECT, "schema", F.col("subject"), F.concat(F.lit("at "), where, F.lit(": "), F.col("message")), F.col("sub"))


def repeats(rows: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """Rows whose key an earlier row has, with nth, before (the kind of the row just before) and said."""
    w = Window.partitionBy(*key).orderBy(*order)
    again = rows.withColumn("nth", F.row_number().over(w)).withColumn("before", F.lag(kind).over(w)).filter("nth > 1")
    both = F.concat(F.lit("one id for a "), F.col("before"), F.lit(" and a "), F.col(kind))
    return again.withColumn("said", F.when(F.col("before") != F.col(kind), both).otherwise("an earlier record has this id"))


def identifiers(gold: DataFrame, retired: DataFrame) -> DataFrame:
    """retired: id, retired_on."""
    named = gold.filter(F.col("id").isNotNull())
    prefix = F.create_map(*[F.lit(x) for kv in S.ID_PREFIXES.items() for x in kv])[F.col("record_type")]
    file = F.create_map(*[F.lit(x) for kv in S.FILES.items() for x in kv])[F.col("record_type")]
    wrong = named.filter(~F.startswith(F.col("id"), F.concat(prefix, F.lit("-"))))
    again = repeats(named, ["id"], ["type_seq", "pos"], "record_type")
    back = named.join(retired.select(F.col("id").alias("_r"), "retired_on"), F.col("id") == F.col("_r"))
    when = F.coalesce(F.concat(F.lit(" (withdrawn "), F.nullif(F.col("retired_on"), F.lit("")), F.lit(")")), F.lit(""))
    k = _seq("ids")
    return _union(
        [
            _finding(wrong, k, M.DEFECT, "ids", F.col("id"), F.concat(F.lit("a "), F.col("record_type"), F.lit(" must carry a "), prefix, F.lit("- id; it is in "), file)),
            _finding(again, k, M.DEFECT, "ids", F.col("id"), F.col("said"), F.lit(1)),
            _finding(back, k, M.DEFECT, "ids", F.col("id"), F.concat(F.lit("reuses a retired id"), when), F.lit(2)),
        ]
    )


def cross_references(gold: DataFrame) -> DataFrame:
    """A value must be the id of a record whose type has one of the allowed prefixes."""
    v, named = F.col("v"), F.lit(None).cast("array<struct<sub:bigint,pointer:string,value:string,allowed:array<string>>>")
    for t in dict.fromkeys(t for t, _, _ in CROSS_REFERENCES):
        own = [(k, f, p) for k, (u, f, p) in enumerate(CROSS_REFERENCES) if u == t]
        named = F.when(_is(t), F.concat(*[_pointed(S.read_path(v, (f, "*")), k, F.array(*map(F.lit, p))) for k, f, p in own])).otherwise(named)
    each = gold.select("type_seq", "pos", "subject", F.explode(named).alias("x")).select("type_seq", "pos", "subject", "x.*").filter("value is not null")
    prefix = F.create_map(*[F.lit(x) for kv in S.ID_PREFIXES.items() for x in kv])[F.col("record_type")]
    known = gold.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("_id")).agg(F.collect_set(prefix).alias("_in"))
    gone = each.join(known, F.col("value") == F.col("_id"), "left").filter(~F.coalesce(F.arrays_overlap("allowed", "_in"), F.lit(False)))
    files = F.create_map(*[F.lit(x) for t, p in S.ID_PREFIXES.items() for x in (p, S.FILES[t])])
    where = F.array_join(F.transform("allowed", lambda p: files[p]), " or ")
    message = F.concat(F.col("pointer"), F.lit(" names "), F.col("value"), F.lit(", and no such record exists in "), where)
    return _finding(gone, _seq("cross-reference"), M.DEFECT, "cross-reference", F.col("subject"), message, F.col("sub"))


def _pointed(found: Column, k: int, allowed: Column | None = None) -> Column:
    """read_path()'s elements as structs of sub (their order), pointer and value (a string or null)."""
    more = [] if allowed is None else [allowed.alias("allowed")]
    return F.transform(found, lambda x, i: F.struct((F.lit(k << 32) + i).alias("sub"), x["pointer"].alias("pointer"), S.text_of(x["value"]).alias("value"), *more))


def approval(gold: DataFrame) -> DataFrame:
    fields = ("approved_by", "approved_date")
    lacking = F.array(*[F.when(S.missing(S.get(F.col("v"), f)), F.lit(f)) for f in fields])
    rows = gold.select("type_seq", "pos", "subject", F.posexplode(lacking).alias("_i", "field")).filter("field is not null")
    return _finding(rows, _seq("approval"), M.GAP, "approval", F.col("subject"), F.concat(F.col("field"), F.lit(" is null: the record is not approved")), F.col("_i"))


def judgement(gold: DataFrame) -> DataFrame:
    k, parts = _seq("judgement"), []
    for t, fields in JUDGEMENT_FIELDS.items():
        lacking = F.array(*[F.when(S.missing(S.get(F.col("v"), f)), F.lit(f)) for f in fields])
        rows = gold.filter(_is(t)).select("type_seq", "pos", "subject", F.posexplode(lacking).alias("_i", "field")).filter("field is not null")
        parts.append(_finding(rows, k, M.GAP, "judgement", F.col("subject"), F.concat(F.col("field"), F.lit(" is null: it needs the expert")), F.col("_i"), F.lit(S.RECORD_TYPES.index(t))))
    bare = gold.filter(_is("gold_concept") & S.blank(S.get(F.col("v"), "not_labels")))
    parts.append(_finding(bare, k, M.NOTE, "not_labels", F.col("subject"), F.lit("no not_labels"), type_seq=F.lit(100)))
    tested = S.text_of(S.get(F.col("v"), "detectable_by")) == "test"
    loose = gold.filter(_is("prohibited_use") & F.coalesce(tested, F.lit(False)) & S.blank(S.get(F.col("v"), "test_ref")))
    parts.append(_finding(loose, k, M.NOTE, "test_ref", F.col("subject"), F.lit("a test is to detect it; test_ref names none"), type_seq=F.lit(101)))
    return _union(parts)


def enum_counts(gold: DataFrame, record_type: str, field: str) -> DataFrame:
    """value_seq, value and n for every declared value of the field, 0 included."""
    spark = gold.sparkSession
    values = spark.createDataFrame(list(enumerate(map(str, S.enum_values(record_type, field)))), "value_seq int, value string")
    return value_counts(values, gold.filter(_is(record_type)), S.text_of(S.get(F.col("v"), field)))


def value_counts(values: DataFrame, rows: DataFrame, value: Column) -> DataFrame:
    """values (value_seq, value: a few, fixed) with n, how many rows have each, 0 included."""
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("_n"))
    return F.broadcast(values).join(counts, "value", "left").select("value_seq", "value", F.coalesce("_n", F.lit(0)).alias("n"))


def majority_gap(rows: DataFrame, flag: Column, *by: str) -> DataFrame:
    """plain, n and gap of each group: whether rows whose flag is false fail to be more than half (no rows, no gap)."""
    plain = F.count_if(F.coalesce(flag == F.lit(False), F.lit(False)))
    return rows.groupBy(*by).agg(plain.alias("plain"), F.count("*").alias("n")).withColumn("gap", (F.col("n") > 0) & (2 * F.col("plain") <= F.col("n")))


def coverage(gold: DataFrame) -> DataFrame:
    k, parts = _seq("coverage"), []
    for i, (t, field, label) in enumerate(ENUM_COVERAGE):
        unused = enum_counts(gold, t, field).filter("n = 0")
        total = len(S.enum_values(t, field))
        subject = F.concat(F.lit(f"{label} '"), F.col("value"), F.lit("'"))
        parts.append(_finding(unused, k, M.GAP, "coverage", subject, F.lit(f"no record carries it; the set must span all {total}"), type_seq=F.lit(i), pos=F.col("value_seq")))
    flag = F.try_variant_get("v", "$.uses_manual_terminology", "boolean")
    few = majority_gap(gold.filter(_is("gold_search_question")), flag).filter("gap")
    message = F.concat(F.col("plain").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" avoid manual terminology; a majority must"))
    parts.append(_finding(few, k, M.GAP, "coverage", F.lit("search questions"), message, type_seq=F.lit(2), pos=F.lit(0)))
    sources = S.get(F.col("v"), "expected_sources")
    open_ = S.missing(sources) | (F.coalesce(S.kind_of(sources) == "object", F.lit(False)) & S.blank(S.get(sources, "required")))
    bare = gold.filter(_is("competency_question") & open_)
    parts.append(_finding(bare, k, M.GAP, "coverage", F.col("subject"), F.lit("expected_sources.required is empty"), type_seq=F.lit(3)))
    return _union(parts)


def deliverable_counts(gold: DataFrame) -> DataFrame:
    """seq, key, label, record_type, path, low, high, target and n (records of the type, 0 if none) of each deliverable."""
    spark = gold.sparkSession
    rows = [(i, d.key, d.label, d.record_type, d.path, d.low, d.high) for i, d in enumerate(DELIVERABLES)]
    fixed = spark.createDataFrame(rows, "seq int, key string, label string, record_type string, path string, low int, high int")
    counts = gold.groupBy("record_type").agg(F.count("*").alias("_n"))
    joined = F.broadcast(fixed).join(counts, "record_type", "left")
    return joined.select("seq", "key", "label", "record_type", "path", "low", "high", text.band_text(F.col("low"), F.col("high")).alias("target"), F.coalesce("_n", F.lit(0)).alias("n"))


def band_status(n: Column, low: Column, high: Column) -> Column:
    short, over = F.concat((low - n).cast("string"), F.lit(" short")), F.concat((n - high).cast("string"), F.lit(" above the band"))
    return F.when(n < low, short).when(n > high, over).otherwise("in band")


def completeness(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """documents: path, state (absent, empty or written)."""
    rows = deliverable_counts(gold).join(documents.select(F.col("path").alias("_p"), "state"), F.col("path") == F.col("_p"), "left")
    file = F.create_map(*[F.lit(x) for kv in S.FILES.items() for x in kv])[F.col("record_type")]
    state = F.coalesce("state", F.lit("absent"))
    message = (
        F.when(F.col("path").isNotNull() & (state == "absent"), F.concat(F.col("label"), F.lit(": not written")))
        .when(F.col("path").isNotNull() & (state == "empty"), F.concat(F.col("label"), F.lit(": the file exists and is empty")))
        .when(F.col("path").isNull() & (F.col("n") < F.col("low")), F.concat(F.col("label"), F.lit(": "), F.col("n").cast("string"), F.lit(" of "), F.col("target")))
        .when(F.col("path").isNull() & (F.col("n") > F.col("high")), F.concat(F.col("label"), F.lit(": "), F.col("n").cast("string"), F.lit(", above the band of "), F.col("target")))
    )
    bad = rows.withColumn("message", message).filter("message is not null")
    return _finding(bad, _seq("completeness"), M.GAP, "completeness", F.coalesce("path", file), F.col("message"), type_seq=F.lit(0), pos=F.col("seq"))


# ---------------------------------------------------------------- corpus checks


def resolution(gold: DataFrame, found: DataFrame, snapshot: str = "", types: tuple[str, ...] = S.RECORD_TYPES) -> DataFrame:
    """found: corpus.targets(); types: the record types that may occur."""
    named = F.lit(None).cast("array<struct<sub:bigint,pointer:string,value:string>>")
    for t in types:
        if paths := S.ref_paths(t):
            named = F.when(_is(t), F.concat(*[_pointed(S.read_path(F.col("v"), path), k) for k, path in enumerate(paths)])).otherwise(named)
    each = gold.select("type_seq", "pos", "subject", F.explode(named).alias("x")).select("type_seq", "pos", "subject", "x.sub", "x.pointer", F.col("x.value").alias("ref")).filter("ref is not null")
    rows = corpus.resolve(each, found.select("ref", "level", F.lit(None).cast("string").alias("text"), "content_hash"))
    at = F.concat(F.col("pointer"), F.lit(" = "), F.col("ref"))
    lost, cases = rows.filter("level is null"), rows.filter("level = 'case'")
    k = _seq("resolution")
    return _finding(lost, k, M.DEFECT, "resolution", F.col("subject"), F.concat(at, F.lit(f" resolves to nothing in the snapshot ({snapshot[:12]})")), F.col("sub")).unionByName(
        _finding(cases, k, M.NOTE, "resolution", F.col("subject"), F.concat(at, F.lit(" is a case citation, checked for grammar only")), F.col("sub"))
    )


def span_fault(level: Column, target: Column, start: Column, end: Column, surface: Column) -> Column:
    """The first thing wrong with a span, or null: no text, out of bounds, or a surface that does not land."""
    found = text.text_slice(target, start, end)
    return (
        F.when(level.isNull(), F.lit(None).cast("string"))
        .when(target.isNull(), "no text")
        .when(start.isNull() | end.isNull(), "malformed")
        .when((end > F.length(target)) | (start > end), "out of bounds")
        .when(surface.isNotNull() & (surface != found), "mismatch")
    )


def spans(gold: DataFrame, found: DataFrame) -> DataFrame:
    parts = []
    for t, field in SURFACES.items():
        v = F.col("v")
        span = S.get(v, "span")
        own = gold.filter(_is(t) & ~S.missing(span)).select(
            F.lit(list(SURFACES).index(t)).alias("type_seq"), "pos", "subject", F.lit(field).alias("field"), S.text_of(S.get(v, "source_ref")).alias("ref"),
            F.when(F.size(S.items_of(span)) == 2, F.try_variant_get(span, "$[0]", "int")).alias("start"), F.when(F.size(S.items_of(span)) == 2, F.try_variant_get(span, "$[1]", "int")).alias("end"),
            S.text_of(S.get(v, field)).alias("surface"),
        )
        parts.append(own.filter("ref is not null"))
    rows = corpus.resolve(_union(parts), found)
    start, end = F.col("start"), F.col("end")
    fault = span_fault(F.col("level"), F.col("target_text"), start, end, F.col("surface"))
    where = F.concat(F.lit("span ["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit("]"))
    message = (
        F.when(F.col("fault") == "no text", F.concat(F.lit("source_ref "), F.col("ref"), F.lit(" is a "), F.col("level"), F.lit(", which holds no text for a span to land in")))
        .when(F.col("fault") == "malformed", F.lit("span is not two whole numbers"))
        .when(F.col("fault") == "out of bounds", F.concat(where, F.lit(" falls outside "), F.col("ref"), F.lit(", which is "), F.length("target_text").cast("string"), F.lit(" characters")))
        .otherwise(F.concat(F.col("field"), F.lit(" does not land: it is '"), F.col("surface"), F.lit("' but the passage has '"), text.text_slice(F.col("target_text"), start, end), F.lit("'")))
    )
    bad = rows.withColumn("fault", fault).filter("fault is not null")
    return _finding(bad, _seq("span"), M.DEFECT, "span", F.col("subject"), message)


def staleness(gold: DataFrame, found: DataFrame) -> DataFrame:
    v = F.col("v")
    own = gold.select("type_seq", "pos", "subject", S.text_of(S.get(v, "source_content_hash")).alias("recorded"), S.text_of(S.get(v, "source_ref")).alias("ref")).filter("recorded is not null and ref is not null")
    rows = corpus.resolve(own, found.select("ref", "level", F.lit(None).cast("string").alias("text"), "content_hash")).filter("target_hash <> recorded")
    message = F.concat(F.lit("the hash was taken at "), F.substring("recorded", 1, 19), F.lit("… and "), F.col("ref"), F.lit(" now hashes to "), F.substring("target_hash", 1, 19), F.lit("…: the record returns to the expert"))
    return _finding(rows, _seq("staleness"), M.DEFECT, "staleness", F.col("subject"), message)


# ---------------------------------------------------------------- together


def not_resolved(spark: SparkSession, reason: str) -> DataFrame:
    return spark.createDataFrame([(_seq("resolution"), 0, 0, 0, M.GAP, "resolution", "corpus", f"the resolution checks did not run: {reason}")], FINDING)


def present_types(records: DataFrame) -> tuple[str, ...]:
    """The record types that occur, eight at most."""
    return tuple(r[0] for r in records.filter(F.col("record_type").isin(*S.RECORD_TYPES)).select("record_type").distinct().sort("record_type").collect())


def findings(records: DataFrame, files: DataFrame, retired: DataFrame, documents: DataFrame, found: DataFrame | None, snapshot: str = "", reason: str = "not requested", types: tuple[str, ...] = S.RECORD_TYPES) -> DataFrame:
    """All checks' findings; without corpus targets the corpus checks are reported as a gap.

    types: the record types that may occur.
    """
    gold = prepared(records)
    parts = [unreadable(files), *([schema(gold, types)] if types else []), identifiers(gold, retired), cross_references(gold), approval(gold), judgement(gold), coverage(gold), completeness(gold, documents)]
    if found is None:
        parts.append(not_resolved(records.sparkSession, reason))
    else:
        parts += [resolution(gold, found, snapshot, types), spans(gold, found), staleness(gold, found)]
    return _union(parts)


def status(found: DataFrame, resolution_ran: bool) -> DataFrame:
    """One row: defects, gaps, notes, complete (no gaps and resolution ran) and exit_code (1, 0 or 3)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = found.agg(n(M.DEFECT).alias("defects"), n(M.GAP).alias("gaps"), n(M.NOTE).alias("notes"))
    complete = (F.col("gaps") == 0) & F.lit(resolution_ran)
    return counts.withColumn("complete", complete).withColumn("exit_code", F.when(F.col("defects") > 0, 1).when(F.col("complete"), 0).otherwise(3))
