"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license as licenses
from . import decontaminate, lines, lm, media, mixing, quality, simhash, substring, suffix
from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeated_words(_table(spark, sf_dir, "documents"), 50)
    gone = F.aggregate("removed", F.lit(0), lambda acc, s: acc + s["b"] - s["a"])
    return kept.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(_table(spark, sf_dir, "documents"), 400)
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_digests(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", "text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substrings, op3_suffixes, op4_media, op5_quality, op6_lm, op7_licenses, op8_simhash, op9_lines, op10_mixing)}

SQL = {
    "op9_lines": """
WITH doc AS (SELECT doc_id, text, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM doc),
keyed AS (SELECT doc_id, site, pos, trim(line, ' ') AS key FROM line WHERE trim(line, ' ') <> ''),
spread AS (SELECT key, min(doc_id) AS first_doc FROM keyed GROUP BY key HAVING count(DISTINCT site) >= 5),
first_place AS (SELECT k.key, s.first_doc, min(k.pos) AS first_pos FROM keyed k JOIN spread s ON k.key = s.key AND k.doc_id = s.first_doc GROUP BY k.key, s.first_doc),
gone AS (SELECT k.doc_id, k.pos FROM keyed k JOIN first_place f ON k.key = f.key WHERE NOT (k.doc_id = f.first_doc AND k.pos = f.first_pos)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id),
dropped AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.parts) END::BIGINT AS n_lines, coalesce(x.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN dropped x ON d.doc_id = x.doc_id
""",
}
