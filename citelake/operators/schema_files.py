"""Schemas read from JSON Schema files: a registry, references between files, and the nodes that gold_schema compiles.

A folder of *.schema.json is metadata of some kilobytes, read on the driver. A file is found by its $id and by its name; a
$ref names a definition by file and fragment, or by the fragment alone within its own file.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

#: Keywords that are carried as they are, and formats by the names that gold_schema gives them.
PLAIN = ("enum", "pattern", "minLength", "minimum", "minItems", "maxItems")
FORMATS = {"upstream-ref": "ref"}


class SchemaFiles:
    def __init__(self, folder: str | Path):
        self.by_name: dict[str, dict] = {}
        for path in sorted(Path(folder).glob("*.schema.json")):
            schema = json.loads(path.read_text("utf-8"))
            self.by_name[path.name] = schema
            if "$id" in schema:
                self.by_name[schema["$id"]] = schema
        if not self.by_name:
            raise FileNotFoundError(f"{folder} holds no *.schema.json")

    def file(self, name: str) -> dict:
        if name not in self.by_name:
            raise KeyError(f"no schema file or $id {name!r}; known: {', '.join(sorted(self.by_name))}")
        return self.by_name[name]

    def target(self, reference: str, home: dict) -> tuple[dict, dict]:
        """What a $ref names, and the file that it stands in."""
        name, _, fragment = reference.partition("#")
        root = self.file(name) if name else home
        try:
            return reduce(lambda node, key: node[key], [k for k in fragment.split("/") if k], root), root
        except (KeyError, TypeError):
            raise KeyError(f"{reference!r} names nothing in its file") from None

    def node(self, name: str) -> dict:
        """A file's schema as gold_schema compiles it, with every reference replaced by what it names."""
        root = self.file(name)
        return self._node(root, root, ())

    def _node(self, schema: dict, home: dict, within: tuple[str, ...]) -> dict:
        if "$ref" in schema:
            if schema["$ref"] in within:
                raise ValueError(f"{schema['$ref']!r} holds itself")
            found, where = self.target(schema["$ref"], home)
            return self._node(found, where, (*within, schema["$ref"])) | self._node({k: v for k, v in schema.items() if k != "$ref"}, home, within)
        inner = lambda x: self._node(x, home, within)
        out = {k: schema[k] for k in PLAIN if k in schema}
        if "type" in schema:
            out["type"] = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        if "const" in schema:
            out["enum"] = [schema["const"]]
        if "format" in schema:
            out["format"] = FORMATS.get(schema["format"], schema["format"])
        if branches := schema.get("oneOf", schema.get("anyOf")):
            out["oneOf"] = [inner(b) for b in branches]
        if "items" in schema:
            out["items"] = inner(schema["items"])
        if "properties" in schema:
            out |= {"properties": {k: inner(v) for k, v in schema["properties"].items()}, "required": list(schema.get("required", ())), "closed": schema.get("additionalProperties") is False}
        return out

    def enum_values(self, name: str, field: str) -> list:
        """The values that a field of a file's schema may have, wherever they are defined."""
        node = self.node(name)["properties"][field]
        if "enum" not in node:
            raise KeyError(f"{field} of {name} has no enum")
        return list(node["enum"])
