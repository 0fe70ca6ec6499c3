"""Markdown reports from small ordered aggregates; the date can be given, so equal inputs give equal bytes."""

from __future__ import annotations

import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..operators import gold_checks, recon
from ..operators import gold_schema as S
from ..sources.documents import Corpus
from ..sources.gold_files import GoldSet
from ..sources.snapshot import Pin

GAP_SECTIONS = (
    ("completeness", "Deliverables still to come"),
    ("coverage", "Coverage still wanting"),
    ("judgement", "Judgements still to be made"),
    ("approval", "Records waiting for approval"),
    ("resolution", "Checks not run"),
)


def _today(generated: str | None) -> str:
    return generated or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d")


def _table(heads: list[str], rows: list[tuple]) -> list[str]:
    return [f"| {' | '.join(heads)} |", f"|{'---|' * len(heads)}", *[f"| {' | '.join(map(str, r))} |" for r in rows]]


def write(text: str, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, "utf-8")
    return path


def scope_report(found: recon.Recon, pin: Pin, generated: str | None = None) -> str:
    v = found.volume.first()
    share = lambda n: f"{n / v['total']:.1%}" if v["total"] else "—"
    words = lambda n: f"{n:,}" if n else "—"
    pairs = lambda df: [tuple(r) for r in df.collect()]
    lost, unsure, cases = pairs(found.unresolved), pairs(found.ambiguous), pairs(found.cases)
    out = [
        f"# Scope report: {found.provision}", "", "Derived counts; not a proposal of a scope.", "",
        *_table(["", ""], [("Snapshot", f"`{pin.repo}` @ `{pin.commit}`"), ("Extractors", f"`{pin.manual_extractor_version}`, `{pin.legislation_extractor_version}`"), ("Generated", _today(generated))]),
        "", "## 1. Volume", "",
        *_table(["Candidate rule", "Chunks", "Share of corpus", "Words"], [("Chunks citing the provision or a unit beneath it", f"{v['citing']:,}", share(v["citing"]), words(v["words_citing"])), ("Pages holding at least one of those", f"{v['pages']:,}", "—", "—"), ("Chunks once page-mates are included", f"{v['selected']:,}", share(v["selected"]), words(v["words_selected"]))]),
        "", "## 2. Where the citing chunks sit", "", *_table(["Part", "Chunks"], pairs(found.by_part)), "", *_table(["Chunk kind", "Chunks"], [(f"`{k}`", n) for k, n in pairs(found.by_kind)]),
        "", "## 3. How the edges were found", "", *_table(["`extraction`", "Edges"], [(f"`{k}`", n) for k, n in pairs(found.by_extraction)]), "", *_table(["`certainty`", "Edges"], [(f"`{k}`", n) for k, n in pairs(found.by_certainty)]),
        "", "## 4. In-scope refs that resolve to nothing", "", *([f"{len(lost)} distinct refs.", "", *[f"- `{r}`" for r, in lost]] if lost else ["None."]),
        "", "## 5. Ambiguous edges in scope", "", *([f"{len(unsure)} edges.", "", *[f"- `{c}` → `{r}`" for c, r in unsure]] if unsure else ["None."]),
        "", "## 6. Cases cited from the selected chunks", "", f"{len(cases)} distinct decisions.", "", *_table(["Case", "Citation", "Mentions"], [(f"`{i}`", c, n) for i, c, n in cases]), "",
    ]
    return "\n".join(out)


def scope_rule(provision: str, mates: bool) -> str:
    rule = f"every chunk with an edge to `{provision}` or a unit beneath it, matched on the ref grammar"
    return rule + (", plus every chunk on a page with one of those" if mates else "")


def worksheet(c: Corpus, pin: Pin, provision: str, mates: bool = True, generated: str | None = None) -> str:
    rows = recon.worksheet_rows(c, provision, mates).collect()
    citing = sum(r["citing"] for r in rows)
    facts = [("Scope rule", scope_rule(provision, mates)), ("Chunks printed", f"{len(rows)} of {c.chunks.count()}"), ("Citing the provision", citing), ("Page-mates", len(rows) - citing), ("Pages", len({r["page_ref"] for r in rows})), ("Snapshot", f"`{pin.repo}` @ `{pin.commit}`"), ("Generated", _today(generated))]
    out = [f"# Annotation worksheet: {provision}", "", *_table(["", ""], facts)]
    for r in rows:
        if r["opens_page"]:
            out += ["", "---", "", f"## {r['nav_title']}", "", f"`{r['page_ref']}` · {r['part_id']} · <{r['url']}>"]
            if r["last_amended"]:
                out += ["", f"Last amended {r['last_amended']}. {r['amendment_note'] or ''}".rstrip()]
        out += ["", f"### `{r['chunk_ref']}`{' ★' if r['citing'] else ''}", "", f"**Heading path** {r['headings']}", ""]
        out += _table(["", ""], [("kind", f"`{r['kind']}`"), ("ordinal", r["ordinal"]), ("content_hash", f"`{r['content_hash']}`"), ("provision edges", r["edges"]), ("case citations", r["cases"])])
        out += ["", r["quote"]]
    return "\n".join(out) + "\n"


def summary(status) -> str:
    return f"{status['defects']} defect(s), {status['gaps']} gap(s), {status['notes']} note(s); {'complete' if status['complete'] else 'incomplete'}"


def coverage_report(gold: GoldSet, found: DataFrame, resolution_ran: bool, snapshot: str = "", skipped: str = "", generated: str | None = None) -> str:
    """found: gold_checks.findings()."""
    found = found.cache()
    status = gold_checks.status(found, resolution_ran).first()
    rows = found.orderBy(*gold_checks.ORDER).collect()
    prepared = gold_checks.prepared(gold.records)
    unwritten = {r["subject"] for r in rows if r["check"] == "completeness"}
    board = []
    counts = gold_checks.deliverable_counts(prepared).withColumn("status", gold_checks.band_status(F.col("n"), F.col("low"), F.col("high"))).orderBy("seq").collect()
    for d in counts:
        board.append((d["label"], d["path"], "—", "not written" if d["path"] in unwritten else "written") if d["path"] else (d["label"], d["target"], d["n"], d["status"]))
    of = lambda severity: [r for r in rows if r["severity"] == severity]
    out = ["# Coverage and gaps", "", f"**Generated** {_today(generated)} · against {f'snapshot `{snapshot[:12]}`' if snapshot else '**no snapshot**'}", "", f"**Status:** {summary(status)}."]
    if not resolution_ran:
        out += ["", f"> The resolution checks did not run: {skipped}. Every ref, span and hash below is unverified."]
    out += ["", "## 1. The board", "", *_table(["Deliverable", "Target", "Have", "Status"], board), "", "## 2. Defects", ""]
    out += [f"- **{r['subject']}** ({r['check']}): {r['message']}" for r in of(M.DEFECT)] or ["None."]
    out += ["", "## 3. Gaps", ""]
    gaps = of(M.GAP)
    for check, heading in GAP_SECTIONS:
        if own := [r for r in gaps if r["check"] == check]:
            out += [f"### {heading}", "", *[f"- **{r['subject']}**: {r['message']}" for r in own], ""]
    if not gaps:
        out += ["None.", ""]
    out += ["## 4. Coverage by category", ""]
    for t, f, _ in gold_checks.ENUM_COVERAGE:
        out += [*_table([f"`{f}`", "records"], [(r["value"], r["n"]) for r in gold_checks.enum_counts(prepared, t, f).orderBy("value_seq").collect()]), ""]
    out += ["## 5. Notes", "", *([f"- **{r['subject']}** ({r['check']}): {r['message']}" for r in of(M.NOTE)] or ["None."]), "", "## 6. Where the records are", ""]
    by_type = {r["record_type"]: r["n"] for r in gold.records.groupBy("record_type").agg(F.count("*").alias("n")).collect()}
    out += _table(["Record type", "File", "Records"], [(t, f"{S.FILES[t]} ({'present' if t in gold.present else 'absent'})", by_type.get(t, 0)) for t in sorted(S.RECORD_TYPES)])
    return "\n".join(out) + "\n"
