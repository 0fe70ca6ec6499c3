"""Evaluation records from YAML files, the ledger of retired ids, and the documents that must exist.

Reading YAML is driver work over small files; what comes out are DataFrames.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..model import MalformedGoldFile
from ..operators import gold_checks
from ..operators import gold_schema as S

RETIRED = "retired-ids.yaml"
IGNORED = ("README.md", RETIRED)
TYPE_OF = {f: t for t, f in S.FILES.items()}


def _plain(value):
    """YAML values that JSON lacks become tagged objects, so they never pass for strings."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return {"$yaml": "date", "v": value.isoformat()}
    if isinstance(value, (bytes, set)):
        return {"$yaml": type(value).__name__, "v": repr(value)}
    return value


def read_records(path: Path) -> list[dict]:
    """The file's list of mappings; an empty document has none."""
    try:
        found = yaml.safe_load(path.read_text("utf-8"))
    except yaml.YAMLError as e:
        raise MalformedGoldFile(f"not valid YAML: {e}") from e
    if found is None:
        return []
    if not isinstance(found, list):
        raise MalformedGoldFile(f"expected a YAML list of records, got {type(found).__name__}")
    for i, record in enumerate(found):
        if not isinstance(record, dict):
            raise MalformedGoldFile(f"record {i} is a {type(record).__name__}, not a mapping")
    return found


def read_retired(path: Path) -> dict[str, dict]:
    out = {}
    for entry in read_records(path):
        if not isinstance(entry.get("id"), str):
            raise MalformedGoldFile("every retired id needs a string id")
        out[entry["id"]] = entry  # a later entry wins
    return out


@dataclass
class GoldSet:
    records: DataFrame  # record_type, file, pos, raw
    files: DataFrame  # pos, file, reason: what could not be read
    retired: DataFrame  # id, retired_on
    present: tuple[str, ...]  # record types whose file was read

    def of(self, record_type: str) -> DataFrame:
        S.schema_of(record_type)
        return self.records.filter(self.records["record_type"] == record_type)


def load(spark: SparkSession, folder: str | Path) -> GoldSet:
    """All gold files of a folder; a file of another name, hidden ones included, is reported, not skipped."""
    rows, bad, retired, present = [], [], {}, []
    root = Path(folder)
    for path in sorted(root.iterdir()) if root.exists() else []:
        if path.is_dir() or path.name == "README.md":
            continue
        try:
            if path.name == RETIRED:
                retired = read_retired(path)
            elif path.name not in TYPE_OF:
                raise MalformedGoldFile(f"not a gold file name; expected one of {', '.join(sorted(TYPE_OF))}")
            else:
                t = TYPE_OF[path.name]
                rows += [(t, path.name, i, json.dumps(_plain(r), ensure_ascii=False)) for i, r in enumerate(read_records(path))]
                present.append(t)
        except MalformedGoldFile as e:
            bad.append((len(bad), path.name, str(e)))
    return GoldSet(
        spark.createDataFrame(rows, "record_type string, file string, pos int, raw string"),
        spark.createDataFrame(bad, "pos int, file string, reason string"),
        spark.createDataFrame([(k, None if (w := e.get("retired_on")) is None else str(w)) for k, e in retired.items()], "id string, retired_on string"),
        tuple(present),
    )


def document_states(spark: SparkSession, root: str | Path) -> DataFrame:
    """path and state (absent, empty or written) of the documents that must be delivered."""
    rows = []
    for d in gold_checks.DELIVERABLES:
        if d.path:
            path = Path(root) / d.path
            rows.append((d.path, "absent" if not path.exists() else "written" if path.read_text("utf-8").strip() else "empty"))
    return spark.createDataFrame(rows, "path string, state string")


def render(records: list[dict]) -> str:
    return yaml.safe_dump(records, sort_keys=False, allow_unicode=True, default_flow_style=False, width=100)


def write_records(records: dict[str, list[dict]], folder: str | Path, write: bool = False) -> list[tuple[Path, str]]:
    """Each file with what became of it: written, unchanged, or would write. Types without records keep their file."""
    out = []
    for t, rows in sorted(records.items()):
        path, text = Path(folder) / S.FILES[t], render(rows)
        if path.exists() and path.read_text("utf-8") == text:
            out.append((path, "unchanged"))
        elif write:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, "utf-8")
            out.append((path, "written"))
        else:
            out.append((path, "would write"))
    return out
