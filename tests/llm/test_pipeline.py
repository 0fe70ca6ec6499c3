"""The pipeline's stages against what they must keep and reject."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from citelake.llm import decontaminate, quality
from tests.llm.conftest import SCHEMA
from tests.llm.test_simhash import slow_survivors
from tests.llm.test_simple_operators import dedup, mixed_by_hand

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's input and output."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, BASE).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(steps):
    for before, after in steps:
        assert after.columns[: len(pipeline.COLUMNS)] == list(pipeline.COLUMNS) or set(pipeline.COLUMNS) <= set(after.columns)
    for _, after in steps[:-1]:
        assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in after.dtypes) == SCHEMA


def test_quality_stage(spark, steps):
    before, after = steps[0]
    model = quality.train(before, spark.read.parquet(f"{BASE}/labels.parquet"))
    scored = {r.doc_id: r.score for r in quality.score_quality(before, model).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in scored.items() if s >= 0.5}


def test_lines_stage(steps):
    before, after = steps[1]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    want = {d: t for d, _, _, t in dedup(rows, 5)}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {d: (t, len(t)) for d, t in want.items()}


def test_copies_stage(steps):
    before, after = steps[2]
    assert after.exceptAll(before).count() == 0 and 0 < after.count() < before.count()
    assert {r.doc_id for r in after.collect()} == slow_survivors([(r.doc_id, r.text) for r in before.collect()])


def test_leaks_stage(spark, steps):
    before, after = steps[3]
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before.collect() if any(i in decontaminate.normalise(r.text) for i in items)}
    kept = {r.doc_id for r in after.collect()}
    assert held and not held & kept and kept == {r.doc_id for r in before.collect()} - held


def test_mix_stage(steps):
    before, after = steps[4]
    rows = after.collect()
    assert rows and all(1 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((d, c) for d, t, _, c in mixed_by_hand(before) if c)


def test_run_applies_all_stages(spark, steps):
    assert sorted(map(repr, pipeline.run(spark, BASE).collect())) == sorted(map(repr, steps[-1][1].collect()))


def test_stages_take_odd_rows(spark, odd_rows, tmp_path):
    r = random.Random(1)
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in odd_rows] + [(100 + i, " ".join(r.choices("abcdefgh", k=40)), "en", "s1", 79) for i in range(10)]
    for name, data in (("odd", rows), ("none", [])):
        where = str(tmp_path / name)
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (100, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        got = pipeline.run(spark, where)
        assert (got.count() > 0) == bool(data) and F.col("text") is not None
