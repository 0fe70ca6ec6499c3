"""One query for each operator of the inventory over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs, text
from ..operators import corpus, gold_checks, gold_schema, intake, provenance, recon, register, scope
from ..sources import documents
from .views import Views

SCOPE = "TMA1995/s43"


# ---------------------------------------------------------------- scans and projections


def scan_typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Views(spark, sf_dir).chunks().select(F.to_json(F.struct("chunk_ref", "page_ref", "text", F.array(F.lit("h")).alias("heading_path"), "ordinal", "content_hash")).alias("raw"))
    typed = documents.typed(raw, "chunk")
    return typed.select("chunk_ref", "page_ref", "ordinal", "kind", F.array_join("heading_path", "/").alias("headings"), F.size("provisions").alias("n_edges"), "content_hash")


def nested_json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Views(spark, sf_dir).table("events").withColumn("v", F.parse_json("props"))
    each = rows.select("event_id", F.explode(gold_schema.read_path(F.col("v"), ("k",))).alias("x"))
    return each.select("event_id", F.col("x.pointer").alias("pointer"), F.to_json("x.value").alias("value"))


def _with_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.replace("props", F.lit("}"), F.lit(', "extra": 1}'))).otherwise(F.col("props"))
    return Views(spark, sf_dir).table("events").select("event_id", raw.alias("raw"))


def unknown_field_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = documents.unknown_keys(F.col("raw"), ("k",))
    return _with_extra(spark, sf_dir).select("event_id", F.array_join(unknown, ",").alias("unknown")).filter("unknown <> ''")


def part_id_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).chunks().select("chunk_ref", refs.part_id(F.col("chunk_ref")).alias("part_id"), refs.first_segment(F.col("chunk_ref")).alias("root"), refs.address(F.col("chunk_ref")).alias("address"))


def text_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return Views(spark, sf_dir).table("documents").select("doc_id", text.text_slice(t, 0, 10).alias("head"), text.text_slice(t, 5, 25).alias("middle"), F.length(t).alias("n"))


def needs_human_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ambiguous(Views(spark, sf_dir).edges()).select("chunk_ref", "id")


def authors_own_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.own_links(Views(spark, sf_dir).edges()).select("chunk_ref", "id")


def misprinted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.misprinted(Views(spark, sf_dir).printed_pages()).select("page_ref", "printed_page_ref")


def provision_unit_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.unit_refs(Views(spark, sf_dir).whole_provisions())
    return rows.select("ref", F.array_join("unit_refs", ",").alias("unit_refs"), F.size("unit_refs").alias("n"))


# ---------------------------------------------------------------- scope and joins


def scope_match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = Views(spark, sf_dir).edges().filter(F.startswith("id", F.lit(SCOPE)))
    return edges.groupBy("id").agg(F.count("*").alias("n"), F.bool_and(refs.in_scope(F.col("id"), F.lit(SCOPE))).alias("matches"))


def chunks_citing_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = scope.citing_chunks(Views(spark, sf_dir).edges(), SCOPE)
    return cited.select("chunk_ref", "page_ref")


def multi_scope_ancestor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    scopes = v.table("part").select(F.concat(F.lit("TMA1995/s"), F.col("p_partkey").cast("string")).alias("scope"))
    return scope.scopes_of_edges(v.edges().select("id"), scopes).groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def page_mates_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return scope.select_chunks(v.chunks(), v.edges(), SCOPE).select("page_ref", "chunk_ref", "ordinal", "citing").orderBy("page_ref", "ordinal")


def resolve_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    found = corpus.targets(provision=v.provisions(), unit=v.units())
    return corpus.resolve(v.edges().select("id").distinct(), found, "id").select("id", "level", "target_hash")


def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return corpus.join_coverage(v.edges(), v.known()).select("total", "in_scope", "resolved", "unresolved", F.round("coverage", 6).alias("coverage"))


def unresolved_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return corpus.unresolved(v.edges(), v.known()).orderBy("id")


def cross_reference_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts name concepts; every fifth names one that is filed as an entity."""
    rows = Views(spark, sf_dir).table("labels")
    d = F.col("doc_id")
    name = lambda x: F.concat(F.lit("GC-"), F.lpad(x.cast("string"), 9, "0"))
    kind = F.when(d % 5 == 0, "gold_entity").otherwise("gold_concept")
    raw = F.to_json(F.struct(name(d).alias("id"), F.array(name(d - 1), name(d + 1)).alias("broader")))
    records = rows.select(kind.alias("record_type"), F.lit("f").alias("file"), d.cast("int").alias("pos"), raw.alias("raw"))
    return gold_checks.cross_references(gold_checks.prepared(records)).select("subject", F.regexp_extract("message", "names (GC-[0-9]+)", 1).alias("names"))


def retired_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    found = gold_checks.identifiers(gold_checks.prepared(v.records()), v.retired())
    return found.select("subject", "message")


def span_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = corpus.resolve(v.gold().select("id", "source_ref", "surface", "end"), corpus.targets(**v.passages()), "source_ref")
    fault = gold_checks.span_fault(F.col("level"), F.col("target_text"), F.lit(0), F.col("end"), F.col("surface"))
    return rows.select("id", F.coalesce("level", F.lit("none")).alias("level"), F.coalesce(fault, F.lit("lands")).alias("outcome"))


def stale_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return gold_checks.staleness(gold_checks.prepared(v.records()), corpus.targets(**v.passages())).select("severity", "subject")


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return recon.with_pages(scope.select_chunks(v.chunks(), v.edges(), SCOPE), v.pages()).select("chunk_ref", "url", "mark")


def parent_child_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("parent_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("row"), F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("entry"))
    joined = intake.attach_children(v.table("orders").select(F.col("o_orderkey").alias("id")), lines)
    return joined.select("id", F.array_join("children", ";").alias("children"), F.size("children").alias("n"))


def orphan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    parents = v.table("orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"))
    return intake.orphans(parents, v.table("lineitem").select(F.col("l_orderkey").alias("parent_id"), "l_linenumber")).groupBy("parent_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- aggregates, windows, sets


def trust_metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matching = Views(spark, sf_dir).edges().filter(F.startswith("id", F.lit("TMA1995/")))
    return recon.trust_counts(matching, "extraction", "certainty")


def counts_by_part_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.counts(Views(spark, sf_dir).chunks(), part=refs.part_id(F.col("chunk_ref")), kind=F.col("kind")).orderBy(F.desc("n"), "part", "kind")


def case_mentions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    case = F.concat(F.lit("CASE/"), year, F.lit("/FCA/"), (F.col("o_custkey") % 50).cast("string"))
    rows = Views(spark, sf_dir).table("orders").select(case.alias("id"), F.concat(F.lit("["), year, F.lit("] "), "o_orderpriority").alias("citation"), "o_orderkey")
    return recon.mentions(rows, F.col("o_orderkey")).withColumnRenamed("id", "case_id").limit(20)


def distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.citing_chunks(Views(spark, sf_dir).edges(), SCOPE).select("page_ref").distinct()


def word_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.shares(recon.words(Views(spark, sf_dir).chunks(), "kind"))


def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Views(spark, sf_dir).table("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "doc_id", "lang", "source")
    return corpus.last_wins(rows, ["key"], ["doc_id"])


_LINE = ("l_returnflag", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")


def duplicate_ids_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold_checks.repeats(Views(spark, sf_dir).table("lineitem"), ["l_orderkey", "l_linenumber"], list(_LINE), "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", F.col("nth").alias("n"), "before", "said")


def page_break_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_breaks(Views(spark, sf_dir).chunks()).select("chunk_ref", "opens_page")


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = Views(spark, sf_dir).table("customer")
    had = customers.filter("c_custkey % 2 = 0").select(register.sequential_id("CU", F.col("c_custkey"), 4).alias("id"))
    return register.allocate(had, customers.filter("c_custkey % 2 = 1").select("c_custkey"), ["c_custkey"], "CU", 4)


def ordered_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ordered_pages(Views(spark, sf_dir).chunks()).select("page_ref", F.array_join("chunk_refs", ",").alias("chunk_refs"))


def page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Views(spark, sf_dir).chunks().select("page_ref", F.col("chunk_ref").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return corpus.digest_of(files, "page_ref")


def majority_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Views(spark, sf_dir).table("labels").join(Views(spark, sf_dir).table("documents").select("doc_id", "lang"), "doc_id")
    return gold_checks.majority_gap(rows, F.col("quality") != 0, "lang")


def enum_coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.createDataFrame(list(enumerate(["click", "error", "purchase", "signup", "view", "withdrawn"])), "value_seq int, value string")
    counted = gold_checks.value_counts(values, Views(spark, sf_dir).table("events"), F.col("event_type"))
    return counted.select("value", "n", (F.col("n") == 0).alias("unused"))


def pinned_count_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    names = ("region", "nation", "part", "supplier")
    measured = None
    for name in names:
        one = v.table(name).agg(F.count("*").alias("measured")).select(F.lit(name).alias("name"), "measured")
        measured = one if measured is None else measured.union(one)
    pinned = spark.createDataFrame([("region", 5), ("nation", 25), ("part", -1), ("ghost", 3)], "name string, expected long")
    return documents.count_mismatches(pinned, measured)


def header_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(c,) for c in ("doc_id", "text", "lang", "tier", "notes")], "header string")
    found = spark.createDataFrame([(c,) for c in Views(spark, sf_dir).table("documents").columns], "header string")
    return intake.header_differences(expected, found)


# ---------------------------------------------------------------- gold checks


def approval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gold_checks.approval(gold_checks.prepared(Views(spark, sf_dir).records()))
    return found.select("subject", F.split_part("message", F.lit(" "), F.lit(1)).alias("field"))


def judgement_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prohibited uses that a test should detect; a third of them name none, some leave it empty."""
    d = F.col("doc_id")
    raw = F.to_json(F.struct(F.concat(F.lit("PU-"), d.cast("string")).alias("id"), F.when(d % 2 == 0, "test").otherwise("human").alias("detectable_by"), F.when(d % 3 == 0, F.lit("t.py")).when(d % 3 == 1, F.lit("")).alias("test_ref")))
    records = Views(spark, sf_dir).table("labels").select(F.lit("prohibited_use").alias("record_type"), F.lit("f").alias("file"), d.cast("int").alias("pos"), raw.alias("raw"))
    return gold_checks.judgement(gold_checks.prepared(records)).select("severity", "check", "subject")


def blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Views(spark, sf_dir).gold().withColumn("surface", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("surface")))
    approved = F.when(F.col("doc_id") % 3 != 0, F.struct(F.col("approved_by").alias("by"), F.col("approved_date").alias("date")))
    rows = g.select("id", "surface", approved.alias("approved"), F.when(F.col("doc_id") % 4 != 0, F.array("type")).alias("types"))
    return rows.select("id", F.explode(intake.blank_columns(rows.schema.fields)).alias("field"))


def band_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = gold_checks.deliverable_counts(Views(spark, sf_dir).records()).filter("record_type is not null")
    return counts.select("key", "target", "n", gold_checks.band_status(F.col("n"), F.col("low"), F.col("high")).alias("status"))


def status_exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents_ = spark.createDataFrame([("eval/measures.md", "written")], "path string, state string")
    gold = gold_checks.prepared(Views(spark, sf_dir).records())
    gaps = gold_checks.completeness(gold, documents_).select(F.col("subject").alias("_s")).distinct()
    rows = gold_checks.deliverable_counts(gold).filter("path is not null")
    return rows.join(gaps, F.col("path") == F.col("_s"), "left").select("key", F.when(F.col("_s").isNull(), "written").otherwise("not written").alias("status"))


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    files = spark.createDataFrame([(0, "odd.yaml", "it holds no list")], "pos int, file string, reason string")
    written = spark.createDataFrame([("eval/measures.md", "written"), ("eval/pilot-scope.md", "empty")], "path string, state string")
    records = v.records().cache()  # every check reads them
    return gold_checks.findings(records, files, v.retired(), written, corpus.targets(**v.passages()), "0123456789abcdef", types=gold_checks.present_types(records))


def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_findings(spark, sf_dir).groupBy("check", "severity").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_checks.status(_all_findings(spark, sf_dir), True)


def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gold_schema.validate(Views(spark, sf_dir).records(), ("gold_entity",))
    return found.select("pos", "path")


# ---------------------------------------------------------------- functions


def _built_refs(v: Views) -> DataFrame:
    """Refs of every shape, possible and impossible, one for each part and shape."""
    k = F.col("p_partkey").cast("string")
    shapes = [
        F.concat(F.lit("TMM/Part"), k, F.lit("/1/2")), F.concat(F.lit("TMM/Part26/"), k, F.lit("#3~2")), F.concat(F.lit("TMA1995/s"), k), F.concat(F.lit("TMR1995/r"), k, F.lit(".3")),
        F.concat(F.lit("TMR1995/sch"), k), F.concat(F.lit("TMR1995/sch3/item"), k), F.concat(F.lit("TMA1995/s"), k, F.lit("(3)(a)")), F.concat(F.lit("TMA1995/front~"), k),
        F.concat(F.lit("CASE/2018/FCAFC/"), k), F.concat(F.lit("CASE/18/FCAFC/"), k), F.concat(F.lit("TMR1995/s"), k), F.concat(F.lit("TMA1995/s"), k, F.lit(".7")), F.concat(F.lit("CCA1995/s6."), k),
        F.concat(F.lit("tma1995/s"), k), F.concat(F.lit(" TMA1995/s"), k), F.concat(F.lit("TMA1995/s"), k, F.lit("\n")), F.concat(F.lit("TMR1995/r"), k), F.concat(F.lit("Part22/"), k),
    ]
    return v.table("part").select("p_partkey", F.posexplode(F.array(*shapes)).alias("shape", "ref"))


def ref_parse_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = refs.parse_ref(F.col("ref"))
    return _built_refs(Views(spark, sf_dir)).select("ref", p["kind"].alias("kind"), p["instrument"].alias("instrument"), p["root"].alias("root"))


def instrument_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built_refs(Views(spark, sf_dir)).filter("shape not in (13, 14, 15, 17)")
    return rows.select("ref", refs.instrument_holds(F.col("ref")).alias("holds"))


def iri_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.col("ref")
    iri = refs.to_iri(ref)
    return _built_refs(Views(spark, sf_dir)).select("ref", iri.alias("iri"), refs.from_iri(iri).alias("back"), refs.iri_for("concept", F.col("p_partkey").cast("string")).alias("minted"))


def normalise_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = Views(spark, sf_dir).table("customer")
    messy = F.concat(F.lit("  "), F.upper("c_name"), F.lit(" \t\n "), "c_mktsegment", F.lit(" "))
    return customers.select("c_custkey", text.normalise_value(messy).alias("value"))


def cell_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    number = F.concat(F.lit(" "), F.when(c % 5 == 0, F.lit("about 3")).otherwise(F.round("c_acctbal", 2).cast("string")), F.lit(" "))
    flag = F.when(c % 4 == 0, "Yes").when(c % 4 == 1, "n").when(c % 4 == 2, "perhaps").otherwise("  ")
    n, bad_n = text.cell(number, "number")
    b, bad_b = text.cell(flag, "boolean")
    e, bad_e = text.cell(F.col("c_mktsegment"), "enum", ("BUILDING", "MACHINERY"))
    return Views(spark, sf_dir).table("customer").select("c_custkey", n.alias("number"), b.alias("flag"), e.alias("segment"), F.concat_ws("", bad_n.cast("int").cast("string"), bad_b.cast("int").cast("string"), bad_e.cast("int").cast("string")).alias("bad"))


def list_cell_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("documents").select("doc_id", F.size(text.list_items(F.col("text"))).alias("n"), F.array_join(text.list_items(F.col("text")), "¦").alias("items"))


def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pseudo-methods vote on one span of each event's user; their ids agree, so their evidence merges."""
    rows = Views(spark, sf_dir).table("events")
    ref = F.concat(F.lit("TMA1995/s"), F.col("user_id").cast("string"))
    cid = text.candidate_id(ref, F.lit(0), F.length("event_type"), F.lower("event_type"))
    method = F.element_at(F.array(F.lit("regex"), F.lit("yake"), F.lit("human")), (F.col("event_id") % 3 + 1).cast("int"))
    evidence = rows.select(cid.alias("candidate_id"), F.col("event_id").alias("seq"), method.alias("method"), F.col("value").alias("score"), F.lit(None).cast("string").alias("model"))
    merged = provenance.merge_evidence(evidence)
    return merged.select("candidate_id", "agreement", F.array_join("methods", ",").alias("methods"), F.array_join("repeated", ",").alias("repeated"))


def provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id").cast("string")
    method = F.element_at(F.array(F.lit("regex"), F.lit("llm"), F.lit("guess")), (e % 3 + 1).cast("int"))
    model = F.when(e % 2 == 0, "m1")
    ref = F.when(e % 7 == 0, F.concat(F.lit("CASE/2018/FCA/"), k)).when(e % 7 == 1, "nonsense").otherwise(F.concat(F.lit("TMA1995/s"), k))
    start, end = (e % 5).cast("int"), (e % 11).cast("int")
    extraction = F.when(e % 13 == 0, "ocr").when(e % 2 == 0, "href").otherwise("regex")
    certainty = F.when(e % 3 == 0, "default").when(e % 17 == 0, "sure")
    status = F.when(e % 4 == 0, "approved").otherwise("candidate")
    faults = F.concat(
        provenance.evidence_faults(method, model),
        provenance.span_faults(ref, start, end, F.concat(F.when(e % 19 == 0, "md5:").otherwise("sha256:"), k)),
        provenance.signal_faults(extraction, certainty),
        provenance.record_faults(F.when(e % 23 == 0, F.array().cast("array<string>")).otherwise(F.array(method)), F.col("value") / 50, status, F.when(e % 8 == 0, "me"), F.when(e % 8 == 0, F.lit("2024-01-01").cast("date"))),
        provenance.value_faults(F.when(e % 29 == 0, " \t").otherwise(F.col("event_type"))),
    )
    return Views(spark, sf_dir).table("events").select("event_id", F.array_join(faults, "; ").alias("faults"))


def blockquote_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "extraction", "certainty"))), lambda e: recon.edge_text(e, SCOPE)), "; ")
    v = Views(spark, sf_dir)
    by_chunk = v.edges().groupBy("chunk_ref").agg(edges.alias("edges"))
    rows = v.chunks().join(by_chunk, "chunk_ref", "left")
    return rows.select("chunk_ref", text.blockquote(F.col("text")).alias("quote"), text.or_dash(F.col("edges")).alias("edges"))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: events in five-minute windows."""
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    rows = Views(spark, sf_dir).table("events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        page_mates_semi, scan_typed_projection, nested_json_projection, unknown_field_drift, part_id_projection, text_slice, needs_human_edges, authors_own_links, misprinted_pages, provision_unit_refs, scope_match_prefix, chunks_citing_any,
        multi_scope_ancestor_join, resolve_priority_join, join_coverage, unresolved_anti, trust_metadata_counts, counts_by_part_kind, case_mentions_topk, distinct_pages, word_volume,
        dedup_last_wins, duplicate_ids_lag, page_break_flag, sequential_ids, ordered_page_lists, page_digest, approval_gaps, judgement_notes, blank_fields, cross_reference_anti,
        retired_reuse, span_landing, stale_hash, page_lookup, parent_child_attach, orphan_children, enum_coverage_anti, band_gate, pinned_count_compare, header_full_outer,
        status_exists_flag, majority_check, findings_union, exit_code, method_agreement, ref_parse_kinds, instrument_invariants, iri_round_trip, normalise_ascii, cell_parse,
        list_cell_split, provenance_checks, blockquote_render, schema_validate, events_tumbling,
    )
}
