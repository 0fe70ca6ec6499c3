"""Schema compiler, checks, status, provenance, registers and the streaming extension."""

import copy
import datetime
import hashlib
import json

import pytest
import yaml
from pyspark.sql import functions as F

from citelake import cli
from citelake import model as M
from citelake.functions import text
from citelake.operators import corpus, gold_checks, intake, provenance, register, schema_files
from citelake.operators import gold_schema as S
from citelake.plans import reports
from citelake.sources import gold_files
from citelake.streaming import staleness

PASSAGE = "A passage that every span of these tests points into, in plain words."
CHUNK, PAGE = "TMM/Part20/5/5/1", "TMM/Part20/5"
HASH = "sha256:" + hashlib.sha256(PASSAGE.encode()).hexdigest()
SIGNED = {"approved_by": "someone", "approved_date": "2024-02-03"}
VALID = {
    "competency_question": {"id": "CQ-001", "question": "q", "asked_by": "examiner", "category": "search", "pilot_in_scope": True, "expected_sources": {"required": [CHUNK], "supporting": []}, "answer_shape": "a", "measured_by": ["m"], **SIGNED},
    "gold_entity": {"id": "GE-001", "surface": PASSAGE[2:9], "type": "Other", "source_ref": CHUNK, "span": [2, 9], "source_content_hash": HASH, "resolves_to": None, **SIGNED},
    "gold_concept": {"id": "GC-001", "pref_label": "p", "alt_labels": [], "not_labels": ["n"], "broader": ["GC-001"], "definition_sources": [CHUNK], **SIGNED},
    "gold_relationship": {"id": "GR-001", "subject": "s", "predicate": "p", "object": "o", "source_ref": CHUNK, "supporting_text": PASSAGE[:5], "span": [0, 5], "source_content_hash": HASH, "tier": 2, "modality": "may", **SIGNED},
    "gold_search_question": {"id": "GS-001", "query": "q", "uses_manual_terminology": False, "relevant": [{"ref": CHUNK, "grade": 3}], **SIGNED},
    "gold_retrieval_question": {"id": "GA-001", "question": "q", "required_evidence": [CHUNK], "required_cases": ["CASE/2018/FCAFC/109"], "qualifications_expected": "x", "authority_distinction_required": False, "prohibited_conclusions": ["PU-001"], **SIGNED},
    "reasoning_expectation": {"id": "GX-001", "given": ["g"], "expected_inferences": [{"conclusion": "c", "basis": [CHUNK], "kind": "impact"}], "must_not_infer": ["PU-001"], "tier": 1, "explanation_required": True, **SIGNED},
    "prohibited_use": {"id": "PU-001", "prohibited": "p", "kind": "overreach", "why": "w", "detectable_by": "test", "test_ref": "t", "related_questions": ["CQ-001", "GA-001"], **SIGNED},
}


def without(record, key):
    return {k: v for k, v in record.items() if k != key}


FAULTS = [
    ("gold_entity", {"type": "LAW"}, "type", "LAW"),
    ("gold_entity", {"source_ref": "TMR1995/s224"}, "source_ref", "TMR1995/s224"),
    ("gold_entity", {"source_ref": "https://example.org/ref/x"}, "source_ref", "https://"),
    ("gold_entity", {"approved_by": KeyError}, "", "approved_by"),
    ("gold_relationship", {"modality": "probably"}, "modality", "probably"),
    ("gold_relationship", {"tier": 4}, "tier", "4"),
    ("gold_concept", {"broader": ["a label"]}, "broader/0", "does not match"),
    ("gold_search_question", {"relevant": [{"ref": CHUNK, "grade": 5}]}, "relevant/0/grade", "5"),
    ("prohibited_use", {"kind": "bad_vibes"}, "kind", "bad_vibes"),
    ("prohibited_use", {"id": "CQ-002"}, "id", "CQ-002"),
    ("competency_question", {"difficulty_rating": 3}, "", "difficulty_rating"),
    ("competency_question", {"category": "interpretation"}, "category", "interpretation"),
    ("reasoning_expectation", {"expected_inferences": [{"conclusion": "c", "basis": [], "kind": "evaluation"}]}, "expected_inferences/0/kind", "evaluation"),
    ("gold_entity", {"approved_date": datetime.date(2024, 1, 2)}, "approved_date", "not of type"),
    ("gold_entity", {"approved_date": "2024-02-30"}, "approved_date", "not a date"),
    ("gold_entity", {"span": [1]}, "span", "too few"),
    ("gold_entity", {"span": [1, 2, 3]}, "span", "too many"),
    ("gold_entity", {"span": [-1, 2]}, "span/0", "minimum"),
    ("gold_entity", {"span": [1.5, 2]}, "span/0", "integer"),
    ("gold_entity", {"span": [True, 2]}, "span/0", "integer"),
    ("gold_relationship", {"tier": True}, "tier", "not one of"),
    ("gold_entity", {"resolves_to": 5}, "resolves_to", "exactly one"),
    ("gold_entity", {"surface": ""}, "surface", "too short"),
    ("competency_question", {"expected_sources": {"required": []}}, "expected_sources", "supporting"),
    ("competency_question", {"measured_by": []}, "measured_by", "too few"),
    ("competency_question", {"pilot_in_scope": "yes"}, "pilot_in_scope", "boolean"),
]


def frame(spark, rows):
    return spark.createDataFrame([(t, S.FILES[t], i, json.dumps(gold_files._plain(r))) for i, (t, r) in enumerate(rows)], "record_type string, file string, pos int, raw string")


def test_valid_records_pass_and_faults_are_named(spark):
    rows = list(VALID.items()) + [("gold_relationship", VALID["gold_relationship"] | {"tier": 1.0}), ("gold_entity", VALID["gold_entity"] | {"resolves_to": CHUNK})]
    assert S.validate(frame(spark, rows)).collect() == []
    faulty = []
    for t, change, _, _ in FAULTS:
        record = VALID[t] | change
        faulty.append((t, {k: v for k, v in record.items() if v is not KeyError}))
    found = {}
    for r in S.validate(frame(spark, faulty)).collect():
        found.setdefault(r.pos, []).append((r.path, r.message))
    for i, (_, change, path, fragment) in enumerate(FAULTS):
        assert any(p == path and fragment in m for p, m in found.get(i, [])), (change, found.get(i))


def test_all_errors_in_path_order(spark):
    record = without(VALID["gold_entity"], "notes") | {"type": "LAW", "surface": "", "span": [1], "extra": 1}
    got = [(r.path, r.sub) for r in S.validate(frame(spark, [("gold_entity", record)])).orderBy("sub").collect()]
    assert [p for p, _ in got] == ["", "span", "surface", "type"] and [s for _, s in got] == [0, 1, 2, 3]


def test_fourteen_ref_paths():
    assert sum(len(S.ref_paths(t)) for t in S.RECORD_TYPES) == 14
    assert ("expected_inferences", "*", "basis", "*") in S.ref_paths("reasoning_expectation") and ("resolves_to",) in S.ref_paths("gold_entity")
    with pytest.raises(KeyError, match="unknown record type"):
        S.schema_of("gold_thing")


def test_read_path(spark):
    raw = '{"a": [{"b": 1}, {"b": null}, {"c": 2}, {"b": "x"}], "n": null, "s": "t"}'
    v = F.parse_json(F.lit(raw))
    read = lambda *p: [(x.pointer, x.v) for x in spark.range(1).select(F.explode(S.read_path(v, p)).alias("x")).select("x.pointer", F.to_json("x.value").alias("v")).collect()]
    assert read("a", "*", "b") == [(".a[0].b", "1"), (".a[3].b", '"x"')]
    assert read("n") == read("zz") == read("s", "*") == read("s", "x") == [] and read("s") == [(".s", '"t"')]


# ---------------------------------------------------------------- checks


def found_targets(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "ref string, text string, content_hash string")
    return corpus.targets(chunk=table((CHUNK, PASSAGE, HASH)), page=table((PAGE, None, "sha256:page")), provision=table(("TMA1995/s43", "provision text", "sha256:p")))


def check(spark, folder, root, targets=None):
    gold = gold_files.load(spark, folder)
    found = gold_checks.findings(gold.records, gold.files, gold.retired, gold_files.document_states(spark, root), targets, COMMIT, "not requested", gold.present).cache()
    return gold, found, gold_checks.status(found, targets is not None).first()


COMMIT = "c" * 40


def write_gold(folder, sets):
    folder.mkdir(parents=True, exist_ok=True)
    for t, rows in sets.items():
        (folder / S.FILES[t]).write_text(yaml.safe_dump(rows, sort_keys=False, allow_unicode=True), "utf-8")


def test_sound_directory(spark, tmp_path):
    write_gold(tmp_path / "g", {t: [r] for t, r in VALID.items()})
    _, found, status = check(spark, tmp_path / "g", tmp_path, found_targets(spark))
    rows = found.collect()
    assert status.defects == 0 and status.exit_code == 3, [r for r in rows if r.severity == M.DEFECT]
    assert [(r.check, r.subject) for r in rows if r.severity == M.NOTE] == [("resolution", "GA-001")]


def test_defective_directory(spark, tmp_path):
    e = VALID["gold_entity"]
    sets = {t: [copy.deepcopy(r)] for t, r in VALID.items() if t != "gold_search_question"}
    sets["gold_entity"] = [
        e | {"type": "LAW"},
        e | {"id": "GE-002", "source_ref": "TMA1995/s99"},
        e | {"id": "GE-003", "span": [2, 900]},
        e | {"id": "GE-004", "surface": "tidied"},
        e | {"id": "GE-005", "source_ref": PAGE, "source_content_hash": "sha256:" + "0" * 64} | {"source_content_hash": None},
        e | {"id": "GE-006", "source_content_hash": "sha256:" + "0" * 64},
        e | {"id": "GE-777"},
        e,
    ]
    sets["gold_concept"] += [VALID["gold_concept"] | {"id": "GE-900", "broader": ["a label"]}]
    sets["gold_retrieval_question"] = [VALID["gold_retrieval_question"] | {"prohibited_conclusions": ["PU-404"]}]
    folder = tmp_path / "g"
    write_gold(folder, sets)
    (folder / "entites.yaml").write_text("[]")
    (folder / "search-questions.yaml").write_text("a: b")
    (folder / "retired-ids.yaml").write_text("- {id: GE-777, retired_on: 2024-01-01, reason: r}")
    (folder / "README.md").write_text("x")
    gold, found, status = check(spark, folder, tmp_path, found_targets(spark))
    got = sorted((r.check, r.subject) for r in found.filter("severity = 'defect'").collect())
    assert got == sorted(
        [
            ("gold-file", "entites.yaml"), ("gold-file", "search-questions.yaml"), ("schema", "GE-001"), ("schema", "GE-900"), ("schema", "GE-900"), ("ids", "GE-001"), ("ids", "GE-900"), ("ids", "GE-777"),
            ("cross-reference", "GE-900"), ("cross-reference", "GA-001"), ("resolution", "GE-002"), ("span", "GE-003"), ("span", "GE-004"), ("span", "GE-005"), ("staleness", "GE-006"),
        ]
    )
    by = {(r.check, r.subject): r.message for r in found.collect()}
    assert "not a gold file name" in by["gold-file", "entites.yaml"] and "expected a YAML list" in by["gold-file", "search-questions.yaml"]
    assert by["ids", "GE-001"] == "an earlier record has this id" and "must carry a GC- id" in by["ids", "GE-900"] and "reuses a retired id (withdrawn 2024-01-01)" in by["ids", "GE-777"]
    assert "falls outside" in by["span", "GE-003"] and "does not land" in by["span", "GE-004"] and "holds no text" in by["span", "GE-005"] and "returns to the expert" in by["staleness", "GE-006"]
    assert status.exit_code == 1 and not status.complete
    order = [r.check_seq for r in found.orderBy(*gold_checks.ORDER).collect()]
    assert order == sorted(order)
    assert gold.of("gold_concept").count() == 2


def test_empty_and_complete(spark, tmp_path):
    gold, found, status = check(spark, tmp_path / "none", tmp_path)
    rows = found.collect()
    assert status.exit_code == 3 and sum(r.check == "completeness" for r in rows) == 10 and sum(r.check == "coverage" for r in rows) == 12
    assert status.defects == status.notes == 0 and gold.records.count() == 0
    sets, root = {}, tmp_path / "full"
    for d in gold_checks.DELIVERABLES:
        if d.path:
            (root / d.path).parent.mkdir(parents=True, exist_ok=True)
            (root / d.path).write_text("written")
            continue
        p = S.ID_PREFIXES[d.record_type]
        sets[d.record_type] = [VALID[d.record_type] | {"id": f"{p}-{i:03d}"} for i in range(1, d.low + 1)]
    for t, f, _ in gold_checks.ENUM_COVERAGE:
        for r, v in zip(sets[t], S.enum_values(t, f), strict=True):
            r[f] = v
    write_gold(root / "eval/gold", sets)
    _, found, status = check(spark, root / "eval/gold", root, found_targets(spark))
    assert (status.defects, status.gaps, status.complete, status.exit_code) == (0, 0, True, 0), found.filter("severity <> 'note'").collect()
    gold, found, status = check(spark, root / "eval/gold", root)
    assert (status.gaps, status.complete, status.exit_code) == (1, False, 3)
    (root / "eval/measures.md").write_text(" \n")
    _, found, status = check(spark, root / "eval/gold", root, found_targets(spark))
    assert [r.message for r in found.filter("severity = 'gap'").collect()] == ["A threshold against every metric: the file exists and is empty"]
    report = reports.coverage_report(gold, found, True, COMMIT, generated="2024-01-01")
    assert report == reports.coverage_report(gold, found, True, COMMIT, generated="2024-01-01")
    assert "| Gold concepts | 50–100 | 50 | in band |" in report and "| A threshold against every metric | eval/measures.md | — | not written |" in report and "| overreach | 1 |" in report


def test_gaps_and_notes(spark):
    missing = [
        ("gold_relationship", without(VALID["gold_relationship"], "approved_by") | {"tier": None, "span": None}),
        ("gold_concept", VALID["gold_concept"] | {"not_labels": []}),
        ("prohibited_use", VALID["prohibited_use"] | {"test_ref": ""}),
        ("gold_search_question", VALID["gold_search_question"] | {"uses_manual_terminology": True}),
        ("gold_search_question", VALID["gold_search_question"] | {"id": "GS-002"}),
        ("competency_question", VALID["competency_question"] | {"expected_sources": {"required": [], "supporting": []}}),
        ("gold_entity", without(VALID["gold_entity"], "id")),
    ]
    gold = gold_checks.prepared(frame(spark, missing))
    assert [(r.subject, r.message.split(" ")[0]) for r in gold_checks.approval(gold).collect()] == [("GR-001", "approved_by")]
    assert sorted((r.severity, r.subject, r.message.split(" ")[0]) for r in gold_checks.judgement(gold).collect()) == [("gap", "GR-001", "span"), ("gap", "GR-001", "tier"), ("note", "GC-001", "no"), ("note", "PU-001", "a")]
    found = {r.subject for r in gold_checks.coverage(gold).collect()}
    assert {"search questions", "CQ-001"} <= found
    assert "<gold_entity with no id>" in {r.subject for r in gold_checks.schema(gold).collect()}


def test_harness_command(spark, tmp_path, capsys, monkeypatch):
    real, memo = cli.run_checks, {}

    def once(spark, root, gold_dir=None, resolution=True):  # equal runs are made once
        key = (str(root), gold_dir, resolution, (tmp_path / "eval/gold/entites.yaml").exists())
        return memo.setdefault(key, None) or memo.update({key: real(spark, root, gold_dir, resolution)}) or memo[key]

    monkeypatch.setattr(cli, "run_checks", once)
    write_gold(tmp_path / "eval/gold", {t: [r] for t, r in VALID.items()})
    run = lambda *a: cli.main(["--root", str(tmp_path), *a])
    assert run("harness", "--no-resolution") == 3 and run("harness", "--no-resolution", "--allow-incomplete") == 0
    assert run("coverage", "--no-resolution") == 0 and (tmp_path / "data/derived/reports/coverage.md").exists()
    (tmp_path / "eval/gold/entites.yaml").write_text("[]")
    assert run("harness", "--no-resolution", "--allow-incomplete") == 1 and run("coverage", "--no-resolution") == 1
    assert "not a gold file name" in capsys.readouterr().out


# ---------------------------------------------------------------- provenance and registers


def faults(spark, column):
    return spark.range(1).select(column.alias("f")).first().f


def test_constraints(spark):
    lit, null = F.lit, F.lit(None).cast("string")
    assert faults(spark, provenance.evidence_faults(lit("llm"), null)) == ["a model-backed method must name its model"] and faults(spark, provenance.evidence_faults(lit("yake"), null)) == []
    span = lambda r, a, b, h="sha256:x": faults(spark, provenance.span_faults(lit(r), lit(a), lit(b), lit(h)))
    assert span(CHUNK, 0, 0) == [] and len(span("CASE/2018/FCAFC/109", 3, 1, "md5:")) == 3 and len(span("TMR1995/s224", 0, 1)) == 1
    signal = lambda e, c: faults(spark, provenance.signal_faults(lit(e), null if c is None else lit(c)))
    assert signal("href", None) == signal("regex", "default") == [] and len(signal("href", "default")) == 1 and len(signal("ocr", "sure")) == 2
    record = lambda m, c, s, who=None: faults(spark, provenance.record_faults(F.array(*map(lit, m)).cast("array<string>"), lit(c).cast("double"), lit(s), null if who is None else lit(who), F.to_date(lit("2024-01-01"))))
    assert record(["yake"], 0.5, "candidate") == record(["yake", "llm"], None, "approved", "me") == []
    assert len(record([], 1.4, "approved")) == 3 and record(["yake", "yake"], 0.0, "stale") == ["one method, one entry"]
    assert faults(spark, provenance.value_faults(lit(" \t"))) == ["a candidate needs a value"]
    with pytest.raises(Exception, match="refused: a candidate needs a value"):
        spark.range(1).select(provenance.strict(provenance.value_faults(lit("")), lit("x"))).collect()
    assert faults(spark, provenance.is_stale(lit("a"), lit("b"))) is True


def test_merging(spark):
    rows = [("c1", 1, "yake", 0.5, None), ("c1", 2, "llm", None, "m"), ("c1", 3, "regex", None, None), ("c2", 1, "yake", 0.1, None), ("c2", 2, "yake", 0.2, None)]
    got = {r.candidate_id: r for r in provenance.merge_evidence(spark.createDataFrame(rows, "candidate_id string, seq int, method string, score double, model string")).collect()}
    assert got["c1"].agreement == 3 and got["c1"].methods == ["yake", "llm", "regex"] and got["c1"].repeated == []
    assert got["c2"].agreement == 1 and got["c2"].repeated == ["yake"] and len(got["c2"].evidence) == 2


def test_registers(spark, tmp_path):
    r = register.Register(tmp_path / "r.json", "TC")
    assert [r.allocate(label="a"), r.allocate()] == ["TC-0001", "TC-0002"]
    (tmp_path / "r.json").write_text(json.dumps(r.entries()[1:]))
    assert r.allocate() == "TC-0003"
    with pytest.raises(ValueError, match="not a XX id"):
        register.Register(tmp_path / "r.json", "XX").allocate()
    (tmp_path / "r.json").write_text("{}")
    with pytest.raises(ValueError, match="not a list"):
        r.entries()
    had = spark.createDataFrame([("TC-0007",), ("TC-12345",)], "id string")
    wanted = spark.createDataFrame([("b",), ("a",)], "name string")
    assert sorted(tuple(x) for x in register.allocate(had, wanted, ["name"], "TC").collect()) == [("TC-12346", "a"), ("TC-12347", "b")]
    assert register.allocate(had.limit(0), wanted, ["name"], "TC").orderBy("id").first().id == "TC-0001"


def test_last_wins_and_enums(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, n int, v string")
    assert sorted(tuple(r) for r in corpus.last_wins(rows, ["key"], ["n"]).collect()) == [("j", 1, "c"), ("k", 2, "b")]
    counts = gold_checks.enum_counts(gold_checks.prepared(frame(spark, [("prohibited_use", VALID["prohibited_use"])])), "prohibited_use", "kind")
    assert {r.value: r.n for r in counts.collect()}["overreach"] == 1 and counts.filter("n = 0").count() == 5


# ---------------------------------------------------------------- intake and streaming


def test_layout():
    names = {s.name: [f"{f.header}{ {'list': '(L)', 'boolean': '(B)', 'enum': '(E)', 'number': '(N)'}.get(f.kind, '')}" for f in s.fields] for s in intake.layout()}
    assert len(names) == 10
    assert names["GS--relevant"] == ["parent_id", "ref", "grade(E)"] and names["GX--expected_inferences"] == ["parent_id", "conclusion", "basis(L)", "kind(E)"]
    assert names["entities"] == ["id", "surface", "type(E)", "source_ref", "span.start(N)", "span.end(N)", "source_content_hash", "resolves_to", "notes", "approved_by", "approved_date"]
    assert names["competency-questions"][5:7] == ["expected_sources.required(L)", "expected_sources.supporting(L)"]


def test_first_wins(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 3), ("b", 4)], "id string, row int")
    kept, later = intake.first_wins(rows, "id", "row")
    assert sorted(map(tuple, kept.collect())) == [("a", 2), ("b", 4)] and list(map(tuple, later.collect())) == [("a", 3)]


def test_streaming(spark, tmp_path):
    schema, got = "ref string, content_hash string", []
    recorded = spark.createDataFrame([("GE-1", "r1", "h1"), ("GE-2", "r2", "h2")], "id string, ref string, content_hash string")
    for i, rows in enumerate(([("r1", "h9"), ("r2", "h2")], [("r1", "h9")])):
        spark.createDataFrame(rows, schema).write.json(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    q = staleness.watch(stream, recorded, lambda df, n: got.extend(r.id for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert set(got) == {"GE-1"}
    (tmp_path / "ev").mkdir()
    events = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path / "ev"))
    (tmp_path / "ev/a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{m}:00", "k": "a"}) for m in (1, 2, 7)))
    q = staleness.windowed_counts(events, "ts", "k").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("wins").collect()) == [1, 2]


def test_normalise_is_the_python_function():
    assert text.normalise(" ＡＢ  ß ") == "ab ss"


# ---------------------------------------------------------------- schema files


def test_schema_files_resolve_references(spark, tmp_path):
    shared = {"$id": "https://example.org/shared/1", "$defs": {"one": {"type": "string", "format": "upstream-ref", "pattern": S.REF_PATTERN}, "many": {"type": "array", "items": {"$ref": "#/$defs/one"}}, "mood": {"enum": ["must", "may"]}, "loop": {"items": {"$ref": "#/$defs/loop"}}}}
    record = {
        "$id": "https://example.org/record/1", "type": "object", "required": ["id", "refs"], "additionalProperties": False,
        "properties": {"id": {"type": "string", "pattern": "^X-[0-9]+$"}, "refs": {"$ref": "https://example.org/shared/1#/$defs/many"}, "mood": {"$ref": "shared.schema.json#/$defs/mood"}, "other": {"anyOf": [{"type": "null"}, {"$ref": "shared.schema.json#/$defs/one"}]}},
    }
    for name, content in (("shared", shared), ("record", record), ("odd", {"properties": {"a": {"$ref": "#/$defs/none"}}}), ("loop", {"$ref": "shared.schema.json#/$defs/loop"})):
        (tmp_path / f"{name}.schema.json").write_text(json.dumps(content))
    files = schema_files.SchemaFiles(tmp_path)
    assert files.node("record.schema.json") == files.node("https://example.org/record/1")
    assert files.enum_values("record.schema.json", "mood") == ["must", "may"]
    for wrong in (lambda: files.node("odd.schema.json"), lambda: files.node("absent"), lambda: files.enum_values("record.schema.json", "id")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        files.node("loop.schema.json")
    rows = [{"id": "X-1", "refs": ["TMA1995/s43"], "mood": "may", "other": None}, {"id": "Y", "refs": ["nonsense", "TMA1995/s1"], "mood": "can", "other": "TMA1995/s2", "more": 1}, {"id": "X-2"}]
    df = spark.createDataFrame([("x", i, json.dumps(r)) for i, r in enumerate(rows)], "record_type string, pos int, raw string")
    found = S.validate(df, ("x",), {"x": files.node("record.schema.json")}).collect()
    paths = sorted((r["pos"], r["path"]) for r in found)
    assert [p for p in paths if p[0] != 1] == [(2, "")] and {p for q, p in paths if q == 1} == {"", "id", "mood", "refs/0"}


def test_ids_are_numbered_in_order_over_ranges(spark):
    rows = [(f"n{i * 37 % 500:03d}", i % 3) for i in range(500)] + [("n100", 7)] * 0 + [("same", k) for k in range(300)]
    wanted = spark.createDataFrame(rows, "name string, k int").repartition(7)
    got = register.numbered(wanted, ["name", "k"], 9).orderBy("_n").collect()
    assert [(r["name"], r["k"]) for r in got] == sorted(rows) and [r["_n"] for r in got] == list(range(1, len(rows) + 1))
    assert register.numbered(wanted.limit(0), ["name"]).count() == 0
    odd = spark.createDataFrame([(None,), ("b",), ("a",)], "name string")
    assert [r["name"] for r in register.numbered(odd, ["name"], 2).orderBy("_n").collect()] == [None, "a", "b"]


def test_order_of_very_many_refs(spark):
    refs = [f"nonsense {i}" for i in range(10_050)]
    raw = {**VALID["gold_concept"], "definition_sources": refs, "legislative_basis": ["odd"]}
    records = spark.createDataFrame([("gold_concept", "f", 0, json.dumps(raw))], "record_type string, file string, pos int, raw string")
    found = spark.createDataFrame([], "ref string, level string, text string, content_hash string")
    rows = gold_checks.resolution(gold_checks.prepared(records), found, types=("gold_concept",)).orderBy("sub").collect()
    assert len({r["sub"] for r in rows}) == len(rows) == 10_051 and ".legislative_basis" in rows[-1]["message"]
