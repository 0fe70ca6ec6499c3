"""Columns of documents that are named like an operator's inner or result columns do no harm."""

import pytest
from pyspark.sql import functions as F

from citelake.llm import decontaminate, lines, lm, media, mixing, quality, simhash, substring, suffix
from citelake.llm import license as licenses
from tests.llm.conftest import table

NAMES = "id th key dig n start many parts asked spans removed kept n_words n_bytes score labels label fp fingerprint root component_id sketch size taken copies target site n_lines n_removed media tiles dhash feature item_id edits end held_out bucket kind grams counts a b x y e t p".split()

OPERATORS = {
    "leaks": lambda d, b, _: decontaminate.find_leaks(d, b),
    "no leaks": lambda d, b, _: decontaminate.drop_leaks(d, b),
    "words": lambda d, *_: substring.remove_repeated_words(d),
    "bytes": lambda d, *_: suffix.remove_repeats(d),
    "media": lambda d, *_: media.media_digests(media.store_texts(d)),
    "quality": lambda d, _, la: quality.score_quality(d, quality.train(d, la)),
    "lm": lambda d, *_: lm.score_documents(d),
    "licenses": lambda d, *_: licenses.scan_licenses(d),
    "simhash": lambda d, *_: simhash.simhash_components(d),
    "near copies": lambda d, *_: simhash.drop_near_copies(d),
    "lines": lambda d, *_: lines.dedup_lines(d),
    "mixing": lambda d, *_: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, odd_rows, name):
    bench = spark.createDataFrame([(1, "a benchmark item of some length, for sure", "c")], "item_id long, text string, doc_id string")
    labels = spark.createDataFrame([(5, 1, 0, "c"), (8, 0, 0, "c")], "doc_id long, quality int, toxic int, text string")
    plain = table(spark, odd_rows)
    odd = plain.select("*", *[F.lit("clash").alias(n) for n in NAMES])
    run = lambda d: OPERATORS[name](d, bench, labels)
    want, got = run(plain), run(odd)
    new = [c for c in want.columns if c not in plain.columns or c in ("doc_id", "text")]
    assert set(want.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert sorted(repr(r) for r in got.select(*new).collect()) == sorted(repr(r) for r in want.select(*new).collect())
