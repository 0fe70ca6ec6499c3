"""Documents on disk to corpus tables, scope, reports, pins and digests."""

import hashlib
import json
import shutil
import subprocess
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citelake import cli
from citelake import model as M
from citelake.operators import corpus, recon, scope
from citelake.plans import reports
from citelake.sources import documents, snapshot

COMMIT = "a" * 40


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def chunk(page, tail, ordinal, text, edges=(), **more):
    return {"chunk_ref": f"{page}{tail}", "page_ref": page, "text": text, "heading_path": ["Top", tail], "ordinal": ordinal, "content_hash": sha(text), "provisions": list(edges), **more}


def edge(ref, extraction="href", certainty=None, mention=None):
    return {k: v for k, v in {"id": ref, "extraction": extraction, "certainty": certainty, "mention": mention}.items() if v is not None}


def page(ref, **more):
    return {"page_ref": ref, "part_id": ref.split("/")[1], "url": f"https://example.org/{ref}", "nav_title": f"About {ref}", "content_hash": sha(ref), "crawled_at": "2024-01-01", "extractor_version": "1", "archived": False, **more}


PAGES = [
    (
        page("TMM/Part1/a", last_amended="2024-02-02", amendment_note="Reworded", images=[{"src": "x"}]),
        [
            chunk("TMM/Part1/a", "#1", 0, "one two\nthree", [edge("TMA1995/s43(1)", "regex", "default", "section 43(1)")], kind="annex", cases=[{"id": "CASE/2018/FCAFC/109", "citation": "[2018] FCAFC 109"}]),
            chunk("TMM/Part1/a", "#2~1", 1, "four é five", [edge("TMA1995/s430"), edge("TMA1995/s99")], cases=[{"id": "CASE/2018/FCAFC/109", "citation": "[2018] again"}]),
            chunk("TMM/Part1/a", "/c", 2, "six"),
        ],
    ),
    (page("TMM/Part2/b"), [chunk("TMM/Part2/b", "#1", 0, "seven", [edge("TMA1995/s43"), edge("TMA1995/s43", "regex", "ambiguous")], fragment={"k": [1, None]}), chunk("TMM/Part2/b", "#2", 1, "eight nine")]),
    (page("TMM/Part10/c", h1="H"), [chunk("TMM/Part10/c", "#1", 0, "ten", [edge("CCA1995/s6.1", "regex", "explicit"), edge("TMR1995/r4.3")], internal_refs=[{"ref": "TMM/Part1/a", "extraction": "href"}])]),
]
UNIT = {"ref": "TMA1995/s43(1)", "ordinal": 0, "depth": 1, "kind": "sub", "text": "unit text", "content_hash": sha("unit text"), "parent_ref": "TMA1995/s43", "number_collision": [1]}
PROVISIONS = [
    {"ref": "TMA1995/s43", "instrument": "TMA1995", "kind": "section", "containers": [{"a": 1}], "heading_path": ["P"], "text": "deceptive", "content_hash": sha("deceptive"), "captured_at": "2024", "extractor_version": "2", "units": [UNIT]},
    {"ref": "TMR1995/r4.3", "instrument": "TMR1995", "kind": "regulation", "containers": [], "heading_path": [], "text": "rule", "content_hash": sha("rule"), "captured_at": "2024", "extractor_version": "2"},
]


@pytest.fixture
def root(tmp_path):
    """A project folder with a pinned snapshot."""
    base = tmp_path / "data/upstream"
    for p, chunks in PAGES:
        at = base / "snapshot/pages" / p["part_id"] / f"{p['page_ref'].split('/')[-1]}.json"
        at.parent.mkdir(parents=True)
        at.write_text(json.dumps({"page": p, "chunks": chunks}, ensure_ascii=False), "utf-8")
    for p in PROVISIONS:
        at = base / "snapshot/legislation" / p["instrument"] / "provisions/x" / f"{p['ref'].split('/')[1]}.json"
        at.parent.mkdir(parents=True)
        at.write_text(json.dumps(p), "utf-8")
    (base / "snapshot/manifest.json").write_text(json.dumps({"corpus": {"pages": 3, "parts": 3, "chunks": 6, "links": 0}}))
    (base / "snapshot/legislation/manifest.json").write_text(json.dumps({"corpus": {"instruments": 2, "provisions": 2, "units": 1}}))
    pin = {"repo": "r", "clone_url": "u", "commit": COMMIT, "manual_extractor_version": "1", "legislation_extractor_version": "2", "paths": ["snapshot"], "corpus": {"pages": 3, "page_files": 3, "provision_files": 2}}
    (tmp_path / "data/pin.json").write_text(json.dumps(pin))
    snapshot.write_receipt(base, snapshot.Pin.load(tmp_path / "data/pin.json"), "", {}, "2024-01-01T00:00:00Z")
    return tmp_path


@pytest.fixture
def loaded(spark, root):
    return documents.Corpus.read(spark, str(root / "data/upstream"))


def test_tables(loaded):
    chunks = {r.chunk_ref: r for r in loaded.chunks.collect()}
    assert len(chunks) == 6 and loaded.pages.count() == 3 and loaded.provisions.count() == 2 and loaded.units.count() == 1
    assert chunks["TMM/Part1/a#1"].kind == "annex" and chunks["TMM/Part1/a/c"].kind == "body" and chunks["TMM/Part1/a/c"].provisions == []
    assert chunks["TMM/Part1/a#1"].provisions[0].mention == "section 43(1)" and chunks["TMM/Part1/a#2~1"].provisions[0].certainty is None
    assert json.loads(chunks["TMM/Part2/b#1"].fragment) == {"k": [1, None]} and chunks["TMM/Part1/a/c"].blocks == "[]"


def test_round_trip(loaded):
    got = {r.chunk_ref: json.loads(r.j) for r in loaded.chunks.select("chunk_ref", documents.to_json("chunk").alias("j")).collect()}
    empty = {"kind": "body", "heading_source": None, "fragment": None, "provisions": [], "cases": [], "internal_refs": [], "headings": [], "blocks": [], "links": [], "emphasis": [], "tables": []}
    for _, chunks in PAGES:
        for c in chunks:
            assert got[c["chunk_ref"]] == empty | c
    (unit,) = [json.loads(r.j) for r in loaded.units.select(documents.to_json("unit").alias("j")).collect()]
    assert unit == UNIT
    pages = {r.page_ref: json.loads(r.j) for r in loaded.pages.select("page_ref", documents.to_json("page").alias("j")).collect()}
    assert pages["TMM/Part2/b"]["h1"] is None and pages["TMM/Part1/a"]["images"] == [{"src": "x"}]


def test_last_document_wins(spark, root):
    p, chunks = PAGES[1]
    (root / "data/upstream/snapshot/pages/Part2/z.json").write_text(json.dumps({"page": p | {"nav_title": "later"}, "chunks": [chunks[0] | {"text": "new"}]}))
    c = documents.Corpus.read(spark, str(root / "data/upstream"))
    assert c.pages.filter("nav_title = 'later'").count() == 1 and c.chunks.filter("text = 'new'").count() == 1 and c.chunks.count() == 6


@pytest.mark.parametrize(("change", "said"), [({"novel": 1}, "unknown field novel"), ({"text": None}, "missing field text"), ({"provisions": [{"id": "x", "extraction": "href", "odd": 1}]}, "edge: unknown field odd")])
def test_drift_is_refused(spark, change, said):
    record = {k: v for k, v in (PAGES[0][1][0] | change).items() if v is not None}
    raws = spark.createDataFrame([(json.dumps(record),)], "raw string")
    with pytest.raises(Exception, match=said):
        documents.typed(raws, "chunk").collect()
    assert said in documents.typed(raws, "chunk", strict=False).first()["drift"][0]


def test_impossible_refs_are_listed(spark, loaded):
    assert documents.impossible_refs(loaded.chunks, "chunk").count() == 0
    bad = loaded.chunks.withColumn("page_ref", F.lit("TMM/Chapter1")).withColumn("provisions", F.expr("transform(provisions, e -> struct('TMR1995/s224' as id, e.extraction, e.certainty, e.mention))"))
    fields = {r.field for r in documents.impossible_refs(bad, "chunk").collect()}
    assert fields == {"page_ref", "provisions.id"}


def test_scope(loaded):
    got = [(r.chunk_ref, r.citing) for r in scope.select_chunks(loaded.chunks, loaded.edges, "TMA1995/s43").orderBy("page_ref", "ordinal").collect()]
    assert got == [("TMM/Part1/a#1", True), ("TMM/Part1/a#2~1", False), ("TMM/Part1/a/c", False), ("TMM/Part2/b#1", True), ("TMM/Part2/b#2", False)]
    assert scope.select_chunks(loaded.chunks, loaded.edges, "TMA1995/s43", mates=False).count() == 2
    many = loaded.chunks.sparkSession.createDataFrame([("TMA1995/s43",), ("TMA1995",), ("TMA1995/s9",)], "scope string")
    naive = loaded.edges.join(many, F.expr("id = scope or startswith(id, scope || '(') or startswith(id, scope || '~') or startswith(id, scope || '/')"))
    key = ["chunk_ref", "pos", "scope"]
    assert scope.scopes_of_edges(loaded.edges, many).select(key).exceptAll(naive.select(key)).count() == 0 and naive.count() == scope.scopes_of_edges(loaded.edges, many).count()


def test_coverage_and_resolution(spark, loaded):
    r = corpus.join_coverage(loaded.edges, loaded.known).first()
    assert (r.total, r.in_scope, r.resolved, r.unresolved, r.coverage) == (7, 6, 4, 2, 4 / 6)
    assert corpus.join_coverage(loaded.edges.limit(0), loaded.known).first().coverage == 0.0
    assert [x.id for x in corpus.unresolved(loaded.edges, loaded.known).orderBy("id").collect()] == ["TMA1995/s430", "TMA1995/s99"]
    rows = spark.createDataFrame([(x,) for x in ("TMM/Part1/a#1", "TMM/Part1/a", "TMA1995/s43", "TMA1995/s43(1)", "CASE/2018/FCAFC/109", "TMA1995/s9", "junk")], "ref string")
    got = {x.ref: (x.level, x.target_text) for x in corpus.resolve(rows, loaded.targets).collect()}
    assert got["TMM/Part1/a#1"] == ("chunk", "one two\nthree") and got["TMM/Part1/a"] == ("page", None) and got["TMA1995/s43(1)"] == ("unit", "unit text")
    assert got["CASE/2018/FCAFC/109"] == ("case", None) and got["TMA1995/s9"] == got["junk"] == (None, None)


def test_recon(loaded):
    found = recon.reconnoitre(loaded, "TMA1995/s43")
    rows = lambda df: [tuple(r) for r in df.collect()]
    v = found.volume.first()
    assert (v.total, v.citing, v.pages, v.selected, v.words_citing, v.words_selected) == (6, 2, 2, 5, 4, 10)
    assert rows(found.by_part) == [("Part1", 1), ("Part2", 1)] and rows(found.by_kind) == [("annex", 1), ("body", 1)]
    assert rows(found.by_extraction) == [("href", 1), ("regex", 2)] and rows(found.by_certainty) == [("ambiguous", 1), ("default", 1), ("—", 1)]
    assert rows(found.unresolved) == [("TMA1995/s430",), ("TMA1995/s99",)] and rows(found.ambiguous) == [("TMM/Part2/b#1", "TMA1995/s43")]
    assert rows(found.cases) == [("CASE/2018/FCAFC/109", "[2018] again", 2)]


def test_reports_are_stable(spark, loaded, root):
    pin = snapshot.Pin.load(root / "data/pin.json")
    one = reports.worksheet(loaded, pin, "TMA1995/s43", generated="2024-01-01")
    assert one == reports.worksheet(loaded, pin, "TMA1995/s43", generated="2024-01-01")
    assert "### `TMM/Part1/a#1` ★" in one and "> one two\n> three" in one and "`TMA1995/s43(1)` (regex, default) ←" in one and one.count("\n---\n") == 2 and "Last amended 2024-02-02. Reworded" in one
    text = reports.scope_report(recon.reconnoitre(loaded, "TMA1995/s43"), pin, "2024-01-01")
    assert "| Chunks once page-mates are included | 5 | 83.3% | 10 |" in text and "- `TMM/Part2/b#1` → `TMA1995/s43`" in text


def test_landing(spark, loaded, tmp_path):
    loaded.land(str(tmp_path / "tables"))
    again = documents.Corpus.landed(spark, str(tmp_path / "tables"))
    assert again.chunks.exceptAll(loaded.chunks).count() == 0 and again.units.count() == 1


# ---------------------------------------------------------------- snapshots


def plain_digest(root, paths):
    outer = hashlib.sha256()
    for p in paths:
        for f in sorted(x for x in (root / p).rglob("*") if x.is_file()):
            outer.update(f"{f.relative_to(root).as_posix()}\0{hashlib.sha256(f.read_bytes()).hexdigest()}\n".encode())
    return outer.hexdigest()


def test_digest(spark, tmp_path):
    for name in ("b/a-b/x.txt", "b/a/b.txt", "b/a.txt", "a/z.bin", "a/Z.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 3)
    for paths in (("b", "a"), ("a", "b")):
        assert snapshot.tree_digest(spark, tmp_path, paths) == plain_digest(tmp_path, paths)
    before = snapshot.tree_digest(spark, tmp_path, ("a",))
    (tmp_path / "a/z.bin").write_bytes(b"edited")
    assert snapshot.tree_digest(spark, tmp_path, ("a",)) != before
    with pytest.raises(M.SnapshotMismatch, match="does not hold"):
        snapshot.tree_digest(spark, tmp_path, ("c",))


def test_verification(spark, root):
    base, pin = root / "data/upstream", snapshot.Pin.load(root / "data/pin.json")
    assert snapshot.verify(spark, base, pin)["commit"] == COMMIT
    assert snapshot.Pin.load(reports.write(pin.to_json(), root / "p.json")) == pin
    for change, said in (({"commit": "b" * 40}, "the pin names"), ({"corpus": {"pages": 4}}, "corpus count pages is 3"), ({"corpus": {"ghosts": 1}}, "ghosts is None"), ({"tree_sha256": "0"}, "tree digest")):
        data = json.loads((root / "data/pin.json").read_text()) | change
        (root / "q.json").write_text(json.dumps(data))
        with pytest.raises(M.SnapshotMismatch, match=said):
            snapshot.verify(spark, base, snapshot.Pin.load(root / "q.json"))
    (base / snapshot.RECEIPT).unlink()
    for where, said in ((base, "receipt"), (root / "none", "no snapshot")):
        with pytest.raises(M.SnapshotMismatch, match=said):
            snapshot.verify(spark, where, pin)
    for text in ("", "{}", '{"commit": "abc"}'):
        (root / "q.json").write_text(text or "{}")
        with pytest.raises(M.UnpinnedSnapshot):
            snapshot.Pin.load(root / "q.json")
    with pytest.raises(M.UnpinnedSnapshot):
        snapshot.Pin.load(root / "absent.json")


def test_fetch_publishes_all_or_nothing(spark, root):
    pin, dest = snapshot.Pin.load(root / "data/pin.json"), root / "copy"
    receipt = snapshot.fetch(spark, pin, root / "data/upstream", dest)
    assert receipt["tree_sha256"] == plain_digest(dest, ["snapshot"]) and not Path(str(dest) + ".incoming").exists()
    (root / "data/upstream/snapshot/pages/Part2/b.json").unlink()
    with pytest.raises(M.SnapshotMismatch):
        snapshot.fetch(spark, pin, root / "data/upstream", dest, force=True)
    assert (dest / "snapshot/pages/Part2/b.json").exists()


def test_fetch_takes_one_commit_of_a_repository(spark, root):
    repo = root / "origin"
    shutil.copytree(root / "data/upstream", repo)
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "--quiet")
    git("add", "snapshot")
    git("commit", "--quiet", "-m", "one")
    commit = git("rev-parse", "HEAD")
    (repo / "snapshot/manifest.json").write_text("{}")
    git("commit", "--quiet", "-a", "-m", "two")
    (repo / "snapshot/pages/Part2/b.json").unlink()  # neither what came later nor what is not committed counts
    pin = replace(snapshot.Pin.load(root / "data/pin.json"), commit=commit, clone_url=f"file://{repo}")
    for source in (None, repo, f"file://{repo}"):
        receipt = snapshot.fetch(spark, pin, source, root / "copy", force=True)
        assert receipt["commit"] == commit and receipt["tree_sha256"] == plain_digest(root / "copy", ["snapshot"])
        assert (root / "copy/snapshot/pages/Part2/b.json").exists()
    with pytest.raises(M.SnapshotMismatch):
        snapshot.fetch(spark, replace(pin, commit="c" * 40), repo, root / "other")
    with pytest.raises(M.SnapshotMismatch):
        snapshot.fetch(spark, replace(pin, paths=("snapshot", "absent")), repo, root / "other")
    assert not (root / "other").exists() and not (root / "other.incoming").exists()


def test_predicates_of_records(loaded):
    edges = loaded.edges
    assert {r.extraction for r in corpus.own_links(edges).collect()} <= {"href"}
    assert corpus.own_links(edges).count() == edges.filter("extraction = 'href'").count() > 0
    pages = loaded.pages.withColumn("printed_page_ref", F.when(F.col("page_ref") == loaded.pages.first()["page_ref"], "TMM/Part9/x"))
    assert corpus.misprinted(pages).count() == 1
    want = {p["ref"]: [u["ref"] for u in p.get("units", [])] for p in PROVISIONS}
    units = spark_units(loaded)
    assert {r.ref: r.unit_refs for r in units.collect()} == want


def spark_units(loaded):
    rows = loaded.provisions.sparkSession.createDataFrame([(p["ref"], json.dumps(p.get("units", []))) for p in PROVISIONS], "ref string, units string")
    return corpus.unit_refs(rows)


def test_commands(root, capsys):
    run = lambda *a: cli.main(["--root", str(root), *a])
    assert run("fetch", "--verify") == 0 and run("recon", "--generated", "d") == 0 and run("worksheet", "--no-page-mates") == 0
    assert "Scope report: TMA1995/s43" in (root / "data/derived/reports/recon.md").read_text()
    assert (root / "data/derived/worksheet.md").read_text().count("### `") == 2
    (root / "data/upstream/snapshot/pages/Part2/b.json").unlink()
    assert run("fetch", "--verify") == 1 and run("recon") == 2
    (root / "data/pin.json").unlink()
    assert run("fetch", "--verify") == 2 and run("worksheet") == 2
    assert "refusing to run" in capsys.readouterr().err
