"""Sheets to records and back, by CSV and xlsx."""

import csv

import pytest

from citelake import cli
from citelake.model import SheetMismatch
from citelake.operators import intake
from citelake.sources import gold_files, sheets
from tests.unit.test_gold import CHUNK, VALID

RECORDS = {t: [dict(r)] for t, r in VALID.items()}
RECORDS["gold_concept"] = [VALID["gold_concept"] | {"alt_labels": ["a, b; c", "d|e"], "not_labels": []}]
RECORDS["gold_entity"] = [VALID["gold_entity"], VALID["gold_entity"] | {"id": "GE-002", "span": None, "source_content_hash": None}]
RECORDS["gold_search_question"] = [VALID["gold_search_question"] | {"relevant": [{"ref": CHUNK, "grade": 3}, {"ref": "TMA1995/s43", "grade": 1}]}, VALID["gold_search_question"] | {"id": "GS-002", "relevant": []}]


def lean(records):
    """What a round trip keeps: optional blanks go."""
    from citelake.operators import gold_schema as S

    return {t: [{k: r[k] for k in S.property_order(t) if k in r and (k in S.required_fields(t) or r[k] not in (None, "", []))} for r in rs] for t, rs in records.items()}


def rows_of(folder, sheet):
    with (folder / f"{sheet}.csv").open(encoding="utf-8", newline="") as f:
        return list(csv.reader(f))


def edit(folder, sheet, row, header, value):
    rows = rows_of(folder, sheet)
    rows[row - 1][rows[0].index(header)] = value
    with (folder / f"{sheet}.csv").open("w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows(rows)


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_round_trip_is_a_fixed_point(spark, tmp_path, kind):
    def trip(records, name):
        if kind == "csv":
            sheets.write_csv(tmp_path / name, records)
            return intake.transcribe(*sheets.read_csv(spark, tmp_path / name))
        return intake.transcribe(*sheets.read_xlsx(spark, sheets.write_xlsx(tmp_path / f"{name}.xlsx", records)))

    one = trip(RECORDS, "one")
    assert one.problems == [] and one.records == lean(RECORDS)
    assert ("gold_entity", "GE-002", "span") in one.blanks and ("gold_concept", "GC-001", "not_labels") in one.blanks
    assert trip(one.records, "two").records == one.records


def test_new_workbooks_hold_no_rows(spark, tmp_path):
    cells, names = sheets.read_xlsx(spark, sheets.write_xlsx(tmp_path / "w.xlsx"))
    assert len(names) == 10 and cells.filter("row > 1 and value is not null").count() == 0
    got = intake.transcribe(cells, names)
    assert got.records == {} and len(got.empty) == 8
    assert sheets.write_xlsx(tmp_path / "v.xlsx").read_bytes() == (tmp_path / "w.xlsx").read_bytes()
    assert all(sheets.width(f) >= 14 for s in intake.layout() for f in s.fields)


def test_refusals(spark, tmp_path):
    sheets.write_csv(tmp_path, RECORDS)
    edit(tmp_path, "entities", 2, "type", "Othe")
    edit(tmp_path, "entities", 3, "span.start", "4")
    edit(tmp_path, "concepts", 2, "pref_label", " ")
    edit(tmp_path, "relationships", 2, "tier", "two")
    edit(tmp_path, "competency-questions", 2, "pilot_in_scope", "perhaps")
    edit(tmp_path, "GS--relevant", 2, "parent_id", "GS-999")
    edit(tmp_path, "prohibited-uses", 2, "related_questions", "CQ-1")
    got = intake.transcribe(*sheets.read_csv(spark, tmp_path))
    said = {(s, r): m for s, r, m in got.problems}
    assert "Othe" in said["entities", 2] and "together" in said["entities", 3] and "blank" in said["concepts", 2] and "two" in said["relationships", 2] and "perhaps" in said["competency-questions", 2]
    assert "names no record" in said["GS--relevant", 2] and "does not match" in said["prohibited-uses", None]
    assert set(got.records) == {"gold_search_question", "gold_retrieval_question", "reasoning_expectation"}
    assert "rejected row(s)" in got.summary()


def test_duplicate_ids_keep_the_first(spark, tmp_path):
    sheets.write_csv(tmp_path, {"gold_entity": [VALID["gold_entity"], VALID["gold_entity"] | {"surface": "later"}]})
    got = intake.transcribe(*sheets.read_csv(spark, tmp_path))
    assert [r["surface"] for r in got.records["gold_entity"]] == [VALID["gold_entity"]["surface"]] and got.problems == [("entities", 3, "id GE-001 is used twice")]


@pytest.mark.parametrize(("change", "said"), [(lambda h: [*h, "mine"], "unknown"), (lambda h: h[:-1], "missing"), (lambda h: [*h, h[0]], "twice")])
def test_headers_must_match(spark, tmp_path, change, said):
    sheets.write_csv(tmp_path)
    (tmp_path / "entities.csv").write_text(",".join(change(rows_of(tmp_path, "entities")[0])) + "\n")
    with pytest.raises(SheetMismatch, match=said):
        intake.transcribe(*sheets.read_csv(spark, tmp_path))


def test_missing_sheets_and_absent_children(spark, tmp_path):
    sheets.write_csv(tmp_path, RECORDS)
    for name in ("GS--relevant", "concepts"):
        (tmp_path / f"{name}.csv").unlink()
    got = intake.transcribe(*sheets.read_csv(spark, tmp_path))
    assert "gold_concept" not in got.records and "gold_concept" not in got.empty
    assert any(s == "search-questions" and "relevant" in m for s, _, m in got.problems)


def test_writing_compares_first(tmp_path):
    records = lean(RECORDS)
    run = lambda **k: {p.name: o for p, o in gold_files.write_records(records, tmp_path, **k)}
    assert set(run().values()) == {"would write"} and list(tmp_path.iterdir()) == []
    assert set(run(write=True).values()) == {"written"} and set(run(write=True).values()) == {"unchanged"}
    assert gold_files.read_records(tmp_path / "entities.yaml") == records["gold_entity"]


def test_command(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--root", str(tmp_path), *a])
    assert run("workbook", "--out", str(tmp_path / "w.xlsx")) == 0 and "8 record sheets and 2 continuation sheets" in capsys.readouterr().out
    sheets.write_xlsx(tmp_path / "w.xlsx", RECORDS)
    assert run("transcribe", str(tmp_path / "w.xlsx")) == 0 and not (tmp_path / "eval/gold/entities.yaml").exists()
    assert run("transcribe", str(tmp_path / "w.xlsx"), "--write") == 0 and (tmp_path / "eval/gold/entities.yaml").exists()
    sheets.write_csv(tmp_path / "c", RECORDS)
    edit(tmp_path / "c", "entities", 2, "type", "x")
    assert run("transcribe", str(tmp_path / "c")) == 1
    (tmp_path / "c/entities.csv").write_text("id\n")
    assert run("transcribe", str(tmp_path / "c")) == 2
