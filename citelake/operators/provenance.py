"""Candidates with evidence from several methods: constraints as reasons, ids, merging and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import refs


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def evidence_faults(method: Column, model: Column) -> Column:
    return _reasons(
        (~F.coalesce(method.isin(*M.METHODS), F.lit(False)), "unknown method"),
        (method.isin(*M.MODEL_BACKED) & (F.coalesce(model, F.lit("")) == ""), "a model-backed method must name its model"),
    )


def span_faults(ref: Column, start: Column, end: Column, content_hash: Column) -> Column:
    kind = refs.ref_kind(ref)
    return _reasons(
        (kind.isNull(), "the span's ref is not a ref"),
        (F.coalesce(kind == M.CASE, F.lit(False)), "a case holds no text to span"),
        (F.coalesce((start < 0) | (end < start), F.lit(True)), "the span is nonsensical"),
        (~F.coalesce(F.startswith(content_hash, F.lit("sha256:")), F.lit(False)), "the content hash must begin with sha256:"),
    )


def signal_faults(extraction: Column, certainty: Column) -> Column:
    return _reasons(
        (~F.coalesce(extraction.isin(*M.EXTRACTIONS), F.lit(False)), "unknown extraction"),
        (certainty.isNotNull() & ~certainty.isin(*M.CERTAINTIES), "unknown certainty"),
        ((extraction == "href") & certainty.isNotNull(), "certainty belongs to regex edges only"),
    )


def record_faults(methods: Column, confidence: Column, status: Column, reviewer: Column, review_date: Column) -> Column:
    """methods: array of method names."""
    signed = (F.coalesce(reviewer, F.lit("")) != "") & review_date.isNotNull()
    return _reasons(
        (F.coalesce(F.size(methods), F.lit(0)) <= 0, "no extraction method"),
        (F.size(methods) != F.size(F.array_distinct(methods)), "one method, one entry"),
        (confidence.isNotNull() & ~confidence.between(0.0, 1.0), "confidence outside 0 to 1"),
        (~F.coalesce(status.isin(*M.REVIEW_STATUSES), F.lit(False)), "unknown review status"),
        (status.isin(*M.DECIDED) & ~signed, "a decision needs a reviewer and a date"),
    )


def value_faults(value: Column) -> Column:
    blank = F.coalesce(F.regexp_replace(value, f"{M.WHITE}+", ""), F.lit("")) == ""
    return _reasons((blank, "a candidate needs a value"))


def strict(faults: Column, value: Column) -> Column:
    """The value, or an error that names the first fault."""
    return F.when(F.size(faults) > 0, F.raise_error(F.concat(F.lit("refused: "), faults[0])).cast("string")).otherwise(value)


def is_stale(content_hash: Column, current: Column) -> Column:
    return content_hash != current


def merge_evidence(evidence: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row for each candidate: its methods in order of seq, how many distinct ones agree, and those given twice.

    evidence: key, seq, method, score, model.
    """
    entries = F.array_sort(F.collect_list(F.struct("seq", "method", "score", "model")))
    merged = evidence.groupBy(key).agg(entries.alias("evidence"))
    names = F.transform("evidence", lambda x: x["method"])
    merged = merged.withColumn("methods", F.array_distinct(names)).withColumn("agreement", F.size("methods"))
    twice = F.filter("methods", lambda m: F.size(F.filter(names, lambda x: x == m)) > 1)
    return merged.withColumn("repeated", twice)
