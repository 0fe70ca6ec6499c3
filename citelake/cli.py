"""Seven commands: fetch, recon, worksheet, harness, coverage, workbook, transcribe. Exit codes are part of the contract."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from . import model as M
from .operators import gold_checks, intake
from .operators import recon as recon_operators
from .plans import reports
from .sources import gold_files, sheets, snapshot
from .sources.documents import Corpus

PILOT = "TMA1995/s43"
REFUSALS = (M.UnpinnedSnapshot, M.SnapshotMismatch, FileNotFoundError)


def _spark() -> SparkSession:
    return SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="citelake")
    top.add_argument("--root", type=Path, default=Path("."), help="the project folder: data/pin.json, data/upstream, eval/gold")
    subs = top.add_subparsers(dest="command", required=True)

    def sub(name, *flags, **options):
        p = subs.add_parser(name)
        for f in flags:
            p.add_argument(f, action="store_true")
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), **v)
        return p

    path = {"type": Path, "default": None}
    sub("fetch", "--verify", "--shallow-verify", "--force", "--write-digest", pin=path, dest=path, source={"default": None})
    sub("recon", provision={"default": PILOT}, out=path, generated={"default": None})
    sub("worksheet", "--no-page-mates", provision={"default": PILOT}, out=path, generated={"default": None})
    sub("harness", "--no-resolution", "--allow-incomplete", gold_dir=path)
    sub("coverage", "--no-resolution", gold_dir=path, out=path, generated={"default": None})
    sub("workbook", out=path)
    sub("transcribe", "--write", gold_dir=path).add_argument("workbook", type=Path)
    return top


def open_corpus(spark: SparkSession, root: Path) -> tuple[Corpus, snapshot.Pin]:
    pin = snapshot.Pin.load(root / "data/pin.json")
    folder = root / "data/upstream"
    snapshot.verify(spark, folder, pin, deep=False)
    return Corpus.read(spark, str(folder)), pin


def run_checks(spark: SparkSession, root: Path, gold_dir: Path | None = None, resolution: bool = True, corpus: Corpus | None = None, commit: str = ""):
    """The gold set, its findings, whether resolution ran, the snapshot's commit, and why it did not run."""
    gold = gold_files.load(spark, gold_dir or root / "eval/gold")
    reason = ""
    if not resolution:
        corpus, reason = None, "not requested"
    elif corpus is None:
        try:
            corpus, pin = open_corpus(spark, root)
            commit = pin.commit
        except REFUSALS as e:
            reason = str(e)
    found = gold_checks.findings(gold.records, gold.files, gold.retired, gold_files.document_states(spark, root), None if corpus is None else corpus.targets.cache(), commit, reason, gold.present)
    return gold, found.cache(), corpus is not None, commit if corpus is not None else "", reason


def _fetch(a) -> int:
    try:
        pin_path = a.pin or a.root / "data/pin.json"
        pin, dest, spark = snapshot.Pin.load(pin_path), a.dest or a.root / "data/upstream", _spark()
        if a.verify or a.shallow_verify:
            print(f"verified {snapshot.verify(spark, dest, pin, deep=not a.shallow_verify)['commit']}")
        else:
            receipt = snapshot.fetch(spark, replace(pin, tree_sha256=None) if a.write_digest else pin, a.source or (dest if a.write_digest and dest.exists() else None), dest, a.force)
            if a.write_digest:
                Path(pin_path).write_text(replace(pin, tree_sha256=receipt["tree_sha256"]).to_json(), "utf-8")
            print(f"fetched {receipt['commit']}")
    except M.UnpinnedSnapshot as e:
        print(f"no pin: {e}", file=sys.stderr)
        return 2
    except M.SnapshotMismatch as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    return 0


def _scope(a) -> int:
    spark = _spark()
    try:
        corpus, pin = open_corpus(spark, a.root)
    except REFUSALS as e:
        print(f"refusing to run: {e}", file=sys.stderr)
        return 2
    if a.command == "recon":
        text = reports.scope_report(recon_operators.reconnoitre(corpus, a.provision), pin, a.generated)
        path = a.out or a.root / "data/derived/reports/recon.md"
    else:
        text = reports.worksheet(corpus, pin, a.provision, not a.no_page_mates, a.generated)
        path = a.out or a.root / "data/derived/worksheet.md"
    print(f"wrote {reports.write(text, path)}")
    return 0


def _harness(a) -> int:
    _, found, ran, _, _ = run_checks(_spark(), a.root, a.gold_dir, not a.no_resolution)
    rows = found.orderBy(*gold_checks.ORDER).collect()
    for severity in (M.DEFECT, M.GAP, M.NOTE):
        if own := [r for r in rows if r["severity"] == severity]:
            print(f"\n{severity.upper()}S ({len(own)})")
            for r in own:
                print(f"  {r['check']}: {r['subject']}: {r['message']}")
    status = gold_checks.status(found, ran).first()
    print(f"\n{reports.summary(status)}")
    return 0 if status["exit_code"] == 3 and a.allow_incomplete else status["exit_code"]


def _coverage(a) -> int:
    gold, found, ran, commit, reason = run_checks(_spark(), a.root, a.gold_dir, not a.no_resolution)
    path = reports.write(reports.coverage_report(gold, found, ran, commit, reason, a.generated), a.out or a.root / "data/derived/reports/coverage.md")
    print(f"wrote {path}")
    return 1 if gold_checks.status(found, ran).first()["defects"] else 0


def _workbook(a) -> int:
    path = a.out or a.root / "data/derived/intake.xlsx"
    if path.suffix == ".xlsx":
        sheets.write_xlsx(path)
    else:
        sheets.write_csv(path)
    children = sum(s.parent_field is not None for s in intake.layout())
    print(f"{len(intake.layout()) - children} record sheets and {children} continuation sheets\nwrote {path}")
    return 0


def _transcribe(a) -> int:
    read = sheets.read_csv if a.workbook.is_dir() else sheets.read_xlsx
    try:
        result = intake.transcribe(*read(_spark(), a.workbook))
    except M.SheetMismatch as e:
        print(f"refusing to read: {e}", file=sys.stderr)
        return 2
    for sheet, row, message in result.problems:
        print(f"  rejected: {sheet}{f' row {row}' if row else ''}: {message}")
    for record_type, identifier, name in result.blanks:
        print(f"  blank: {identifier} ({record_type}): {name}")
    print(result.summary())
    for path, outcome in gold_files.write_records(result.records, a.gold_dir or a.root / "eval/gold", a.write):
        print(f"  {outcome}: {path}")
    return 1 if result.problems else 0


COMMANDS = {"fetch": _fetch, "recon": _scope, "worksheet": _scope, "harness": _harness, "coverage": _coverage, "workbook": _workbook, "transcribe": _transcribe}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return COMMANDS[args.command](args)


if __name__ == "__main__":
    raise SystemExit(main())
