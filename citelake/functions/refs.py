"""The ref grammar as Column functions, so Catalyst can push, fold and prune them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M


def _or(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_segment(ref: Column) -> Column:
    return F.split_part(ref, F.lit("/"), F.lit(1))


def address(ref: Column) -> Column:
    """What follows the first slash; empty if there is none."""
    at = F.instr(ref, "/")
    return F.when(at > 0, F.substr(ref, at + 1)).otherwise(F.lit(""))


def part_id(chunk_ref: Column) -> Column:
    return F.split_part(chunk_ref, F.lit("/"), F.lit(2))


def held(ref: Column) -> Column:
    """Whether the ref's instrument is one whose provisions the corpus holds."""
    return first_segment(ref).isin(*M.HELD_INSTRUMENTS)


def clean(ref: Column) -> Column:
    """Not null, not empty, and no white space at either end."""
    return ref.isNotNull() & (ref != "") & ~ref.rlike(f"^{M.WHITE}") & ~ref.rlike(rf"{M.WHITE}\z")


def instrument_holds(ref: Column) -> Column:
    """Whether the instrument can have such an address: its letter, and dots in its numbers, must fit."""
    where, letter = address(ref), F.substr(address(ref), F.lit(1), F.lit(1))
    body = where.rlike("^[sr](?![A-Za-z])")
    kind = first_segment(ref)
    wrong_letter = _or((kind == i) & (letter != s) for i, s in M.INSTRUMENT_LETTER.items())
    dotted = F.contains(F.split_part(where, F.lit("("), F.lit(1)), F.lit("."))
    wrong_number = _or((kind == i) & (dotted != F.lit(d)) for i, d in M.INSTRUMENT_DOTTED.items())
    return ~body | ~(wrong_letter | wrong_number)


def _legislation(ref: Column) -> Column:
    return (ref.rlike(M.CITED_PATTERN) | ref.rlike(M.RECORD_PATTERN)) & instrument_holds(ref)


def _legislation_kind(ref: Column) -> Column:
    where = address(ref)
    return F.when(where.rlike("[(~]"), M.UNIT).when(where.rlike(M.WHOLE_ADDRESS_PATTERN), M.PROVISION).otherwise(M.LEGISLATION)


def _manual_kind(ref: Column) -> Column:
    return F.when(ref.rlike("[#~]"), M.MANUAL_CHUNK).otherwise(M.MANUAL)


def ref_kind(ref: Column, stated: str | None = None) -> Column:
    """The ref's kind, or null if it is not a ref (or not one of the stated kind).

    A stated kind decides only where the grammar alone cannot.
    """
    legislation = F.when(_legislation(ref), _legislation_kind(ref))
    if stated is None:
        kind = F.when(F.startswith(ref, F.lit("TMM/")), F.when(ref.rlike(M.CHUNK_PATTERN), _manual_kind(ref)))
        kind = kind.when(F.startswith(ref, F.lit("CASE/")), F.when(ref.rlike(M.CASE_PATTERN), M.CASE)).otherwise(legislation)
    elif stated in (M.MANUAL_PAGE, M.MANUAL_CHUNK, M.CASE):
        kind = F.when(ref.rlike({M.MANUAL_PAGE: M.PAGE_PATTERN, M.MANUAL_CHUNK: M.CHUNK_PATTERN, M.CASE: M.CASE_PATTERN}[stated]), stated)
    elif stated == M.MANUAL:
        kind = F.when(ref.rlike(M.CHUNK_PATTERN), _manual_kind(ref))
    elif stated in (M.PROVISION, M.UNIT, M.LEGISLATION):
        own = F.lit(True) if stated == M.LEGISLATION else legislation.isin(stated, M.LEGISLATION)
        kind = F.when(legislation.isNotNull() & own, stated)
    else:
        raise ValueError(f"unknown ref kind {stated!r}")
    return F.when(clean(ref), kind)


def parse_ref(ref: Column, stated: str | None = None) -> Column:
    """struct<value,kind,instrument,root,reason>; an impossible ref has no kind but a reason."""
    kind = ref_kind(ref, stated)
    legal = kind.isin(M.PROVISION, M.UNIT, M.LEGISLATION)
    unit = legal & address(ref).rlike("[(~]")
    reason = F.when(ref.isNull(), "not a string").when(~clean(ref), "empty, or white space at an end")
    reason = reason.when((ref.rlike(M.CITED_PATTERN) | ref.rlike(M.RECORD_PATTERN)) & ~instrument_holds(ref), "the instrument cannot hold this address").otherwise("not a ref")
    return F.struct(
        ref.alias("value"),
        kind.alias("kind"),
        F.when(legal, first_segment(ref)).alias("instrument"),
        F.when(unit, F.regexp_extract(ref, "^[^(~]*", 0)).alias("root"),
        F.when(kind.isNull(), reason).alias("reason"),
    )


def is_ref(ref: Column) -> Column:
    return ref_kind(ref).isNotNull()


def to_iri(ref: Column, base: str = M.DEFAULT_BASE_IRI) -> Column:
    """The ref's IRI, null for an impossible ref; only # is escaped."""
    return F.when(is_ref(ref), F.concat(F.lit(_base(base) + M.IRI_PATHS["ref"]), F.replace(ref, F.lit("#"), F.lit("%23"))))


def from_iri(iri: Column, base: str = M.DEFAULT_BASE_IRI) -> Column:
    """The ref again, null for a foreign IRI or an impossible ref."""
    prefix = _base(base) + M.IRI_PATHS["ref"]
    ref = F.replace(F.substr(iri, F.lit(len(prefix) + 1)), F.lit("%23"), F.lit("#"))
    return F.when(F.startswith(iri, F.lit(prefix)) & is_ref(ref), ref)


def iri_for(kind: str, name: Column, base: str = M.DEFAULT_BASE_IRI) -> Column:
    if kind not in M.IRI_PATHS:
        raise ValueError(f"unknown IRI kind {kind!r}; known: {', '.join(M.IRI_PATHS)}")
    return F.concat(F.lit(_base(base) + M.IRI_PATHS[kind]), name)


def base_iri(spark) -> str:
    """The session's base IRI."""
    return _base(spark.conf.get(M.BASE_IRI_CONF, M.DEFAULT_BASE_IRI))


def _base(base: str) -> str:
    return base if base.endswith("/") else base + "/"


def in_scope(ref: Column, scope: Column) -> Column:
    """The ref is the scope's or lies beneath it: s43 covers s43(1) but not s430."""
    after = F.substr(ref, F.length(scope) + 1, F.lit(1))
    return (ref == scope) | (F.startswith(ref, scope) & after.isin(*M.BELOW))


def ancestors(ref: Column) -> Column:
    """The ref and every proper beginning that a separator follows: all scopes that cover it."""
    one = M.BELOW[0]
    plain = F.translate(ref, "".join(M.BELOW), one * len(M.BELOW))
    many = F.length(plain) - F.length(F.replace(plain, F.lit(one), F.lit("")))
    # the k-th separator ends the k-th beginning, as long as what stands before it
    heads = F.transform(F.sequence(F.lit(1), many), lambda k: F.left(ref, F.length(F.call_function("substring_index", plain, F.lit(one), k))))
    return F.when(many > 0, F.array_distinct(F.concat(F.array(ref), F.filter(heads, lambda h: h != "")))).otherwise(F.array(ref))
