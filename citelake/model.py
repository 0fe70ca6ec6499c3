"""Names, record types and fixed values shared by sources, operators and reports."""

from __future__ import annotations

from pyspark.sql import types as T

# The ref grammar's patterns and the facts about instruments.
PAGE_PATTERN = r"^TMM/Part[0-9]{1,3}[A-Z]?/[A-Za-z0-9/#.-]+$"
CHUNK_PATTERN = r"^TMM/Part[0-9]{1,3}[A-Z]?/[A-Za-z0-9/#~.-]+$"
CITED_PATTERN = r"^[A-Z]{2,8}[0-9]{4}/(sch[0-9]+[A-Z]*|[sr][0-9]+[A-Z]*(\.[0-9]+[A-Z]*)*(\([0-9a-zA-Z]{1,3}\))*)$"
RECORD_PATTERN = r"^[A-Z]{2,8}[0-9]{4}/[A-Za-z0-9/~.()-]+$"
CASE_PATTERN = r"^CASE/[0-9]{4}/[A-Za-z]{2,10}/[0-9]+(/[0-9]+)?$"
WHOLE_ADDRESS_PATTERN = r"^(sch[0-9]+[A-Z]*|[sr][0-9]+[A-Z]*(\.[0-9]+[A-Z]*)*)$"
INSTRUMENT_LETTER = {"TMA1995": "s", "TMA1955": "s", "TMA1905": "s", "AIA1901": "s", "TMR1995": "r"}
INSTRUMENT_DOTTED = {"TMA1995": False, "TMR1995": True}
HELD_INSTRUMENTS = ("TMA1995", "TMR1995")

#: Characters that end a ref where a finer address begins beneath it.
BELOW = ("(", "~", "/")

MANUAL, MANUAL_PAGE, MANUAL_CHUNK = "manual", "manual_page", "manual_chunk"
LEGISLATION, PROVISION, UNIT, CASE = "legislation", "provision", "unit", "case"
REF_KINDS = (MANUAL, MANUAL_PAGE, MANUAL_CHUNK, LEGISLATION, PROVISION, UNIT, CASE)

#: Python's white space, as str.split() and str.strip() see it.
WHITE = r"[\t-\r\x1c-\x20\x85\p{Z}]"

#: Paths under the base IRI by what they name.
IRI_PATHS = {"ns": "ns/", "ref": "ref/", "concept": "concept/", "prop": "prop/", "assertion": "assertion/", "graph": "graph/"}
BASE_IRI_CONF = "spark.citelake.baseIri"
DEFAULT_BASE_IRI = "https://example.org/citelake/"

EXTRACTIONS = ("href", "regex")
CERTAINTIES = ("explicit", "default", "ambiguous")
METHODS = ("textrank", "yake", "keybert", "entity_ruler", "phrase_matcher", "regex", "dependency_matcher", "spacy_ner", "llm", "human")
MODEL_BACKED = ("keybert", "spacy_ner", "llm")
REVIEW_STATUSES = ("candidate", "in_review", "approved", "rejected", "stale")
DECIDED = ("approved", "rejected")

DEFECT, GAP, NOTE = "defect", "gap", "note"


def _struct(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    simple = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, simple.get(t, t) if isinstance(t, str) else t) for n, t in fields])


def _texts(*names: str) -> list[tuple[str, str]]:
    return [(n, "string") for n in names]


STRINGS = T.ArrayType(T.StringType())
EDGE = _struct(*_texts("id", "extraction", "certainty", "mention"))
CASE_EDGE = _struct(*_texts("id", "citation"))
INTERNAL_REF = _struct(*_texts("ref", "extraction", "certainty", "mention"))

#: Payloads that are carried as they came: JSON text in a string column.
CHUNK = _struct(
    *_texts("chunk_ref", "page_ref", "text"), ("heading_path", STRINGS), ("ordinal", "int"), *_texts("content_hash", "kind", "heading_source", "fragment"),
    ("provisions", T.ArrayType(EDGE)), ("cases", T.ArrayType(CASE_EDGE)), ("internal_refs", T.ArrayType(INTERNAL_REF)), *_texts("headings", "blocks", "links", "emphasis", "tables"),
)
PAGE = _struct(
    *_texts("page_ref", "part_id", "url", "nav_title", "content_hash", "crawled_at", "extractor_version"), ("archived", "boolean"),
    *_texts("h1", "printed_page_ref", "images", "date_published", "last_amended", "amendment_note", "amendments"),
)
UNIT_RECORD = _struct(
    *_texts("ref"), ("ordinal", "int"), ("depth", "int"), *_texts("kind", "text", "content_hash", "parent_ref", "style", "number", "number_collision", "emphasis"), ("provisions", T.ArrayType(EDGE)), *_texts("table"),
)
PROVISION_RECORD = _struct(
    *_texts("ref", "instrument", "kind", "containers"), ("heading_path", STRINGS), *_texts("text", "content_hash", "captured_at", "extractor_version", "number", "title", "units"),
)

#: Keys a record must have; all others have defaults.
REQUIRED_KEYS = {
    "edge": ("id", "extraction"),
    "case_edge": ("id", "citation"),
    "internal_ref": ("ref", "extraction"),
    "chunk": ("chunk_ref", "page_ref", "text", "heading_path", "ordinal", "content_hash"),
    "page": ("page_ref", "part_id", "url", "nav_title", "content_hash", "crawled_at", "extractor_version", "archived"),
    "unit": ("ref", "ordinal", "depth", "kind", "text", "content_hash"),
    "provision": ("ref", "instrument", "kind", "containers", "heading_path", "text", "content_hash", "captured_at", "extractor_version"),
}
SCHEMAS = {"edge": EDGE, "case_edge": CASE_EDGE, "internal_ref": INTERNAL_REF, "chunk": CHUNK, "page": PAGE, "unit": UNIT_RECORD, "provision": PROVISION_RECORD}


class CorpusError(Exception):
    """What the engine refuses, by kind."""


class InvalidRef(CorpusError):
    pass


class SchemaDrift(CorpusError):
    pass


class UnpinnedSnapshot(CorpusError):
    pass


class SnapshotMismatch(CorpusError):
    pass


class MalformedGoldFile(CorpusError):
    pass


class SheetMismatch(CorpusError):
    pass
