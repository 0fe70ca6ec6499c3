"""The ref grammar, IRIs, normalisation, slices, cells and ids."""

import hashlib

import pytest
from pyspark.sql import functions as F

from citelake import model as M
from citelake.functions import refs, text

VECTORS = {
    "TMM/Part22/1/1/2": M.MANUAL, "TMM/Part9/x-relevant-legislation23": M.MANUAL, "TMM/Part32A/2/3": M.MANUAL, "TMM/Part26/6#3~2": M.MANUAL_CHUNK, "TMM/Part9/5#1": M.MANUAL_CHUNK,
    "TMA1995/s41": M.PROVISION, "TMA1995/s43": M.PROVISION, "TMR1995/r3A.3": M.PROVISION, "TMR1995/sch2": M.PROVISION, "TMR1995/sch3/item1": M.LEGISLATION, "TMA1995/front": M.LEGISLATION,
    "TMA1995/s128/prescribed-period": M.LEGISLATION, "TMA1995/front~1": M.UNIT, "TMA1995/s41(3)(a)": M.UNIT, "TMA1995/s44(3)": M.UNIT, "CASE/2018/FCAFC/109": M.CASE, "CASE/1894/RPC/11/518": M.CASE,
    "": None, "  ": None, " TMA1995/s41": None, "TMA1995/s41 ": None, "TMA1995/s41\n": None, "\x85TMA1995/s41": None, "tma1995/s41": None, "TMM/Chapter4/3": None, "Part22/1/1/2": None, "TMA1995": None,
    "TMA1995/": None, "https://example.org/citelake/ref/TMA1995/s41": None, "CASE/18/FCAFC/109": None, None: None, "TMR1995/s224": None, "TMA1995/s4.7": None, "TMR1995/r2016": None,
    "CCA1995/s6.1": M.PROVISION, "TMA1995/sch1": M.PROVISION, "AIA1901/s7": M.PROVISION, "AIA1901/r7": None, "TMA1955/r1": None,
}
STATED = [
    ("TMA1995/front", M.PROVISION, M.PROVISION), ("TMA1995/s128/prescribed-period", M.UNIT, M.UNIT), ("TMA1995/s41", M.UNIT, None), ("TMA1995/s41", M.MANUAL_PAGE, None), ("TMM/Part9/5", M.MANUAL_PAGE, M.MANUAL_PAGE),
    ("TMM/Part9/5~1", M.MANUAL_PAGE, None), ("TMM/Part9/5", M.MANUAL_CHUNK, M.MANUAL_CHUNK), ("TMM/Part9/5#1", M.MANUAL, M.MANUAL_CHUNK), ("TMA1995/s41(1)", M.LEGISLATION, M.LEGISLATION), ("CASE/2018/FCAFC/109", M.CASE, M.CASE), ("TMA1995/s41", M.CASE, None),
]


def column(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).orderBy("i").collect()]


def test_kinds(spark):
    got = column(spark, list(VECTORS), refs.ref_kind(F.col("v")), refs.is_ref(F.col("v")), refs.parse_ref(F.col("v")))
    for (ref, kind), (k, is_ref, parsed) in zip(VECTORS.items(), got, strict=True):
        assert (k, bool(is_ref)) == (kind, kind is not None), ref
        assert (parsed.reason is None) == (kind is not None)


def test_stated_kind_decides_only_what_is_undecided(spark):
    for ref, stated, kind in STATED:
        assert column(spark, [ref], refs.ref_kind(F.col("v"), stated)) == [(kind,)], (ref, stated)
    with pytest.raises(ValueError, match="unknown ref kind"):
        refs.ref_kind(F.col("v"), "chapter")


def test_instrument_and_root(spark):
    (p,), (q,) = column(spark, ["TMA1995/s41(3)(a)", "TMA1995/s41"], refs.parse_ref(F.col("v")))
    assert (p.instrument, p.root, q.instrument, q.root) == ("TMA1995", "TMA1995/s41", "TMA1995", None)


def test_scope_and_ancestors(spark):
    inside = ["TMA1995/s43", "TMA1995/s43(1)", "TMA1995/s43(1)(a)", "TMA1995/s43~1", "TMA1995/s43/x"]
    outside = ["TMA1995/s430", "TMA1995/s4", "TMA1995/s44", "TMR1995/r4.3"]
    got = column(spark, inside + outside, refs.in_scope(F.col("v"), F.lit("TMA1995/s43")), F.array_contains(refs.ancestors(F.col("v")), "TMA1995/s43"))
    assert got == [(True, True)] * len(inside) + [(False, False)] * len(outside)
    assert column(spark, ["TMA1995/s43(1)(a)"], refs.ancestors(F.col("v"))) == [(["TMA1995/s43(1)(a)", "TMA1995", "TMA1995/s43", "TMA1995/s43(1)"],)]


def test_iris(spark):
    good = [r for r, k in VECTORS.items() if k]
    base = "https://a.example/x"
    iri = refs.to_iri(F.col("v"), base)
    got = column(spark, good, iri, refs.from_iri(iri, base))
    assert [g[1] for g in got] == good
    assert column(spark, ["TMM/Part26/6#3~2"], iri) == [("https://a.example/x/ref/TMM/Part26/6%233~2",)]
    assert column(spark, ["nonsense"], iri, refs.from_iri(F.lit("https://b.example/ref/TMA1995/s41"), base)) == [(None, None)]
    assert column(spark, ["n"], refs.iri_for("concept", F.col("v"), base)) == [("https://a.example/x/concept/n",)]
    with pytest.raises(ValueError, match="unknown IRI kind"):
        refs.iri_for("other", F.col("v"))


def test_normalise_and_candidate_ids(spark):
    values = ["  Deceptively  Similar ", "deceptively similar", "ﬁnal STRASSE", "straße final", None]
    got = [r[0] for r in column(spark, values, text.normalise_value(F.col("v")))]
    assert got == ["deceptively similar", "deceptively similar", "final strasse", "strasse final", None]
    cid = text.candidate_id(F.lit("TMA1995/s41"), F.lit(3), F.lit(9), F.col("v"))
    want = "cand-" + hashlib.sha256(b"TMA1995/s41|3|9|term").hexdigest()[:16]
    assert column(spark, ["term", "terms"], cid)[0] == (want,) and column(spark, ["terms"], cid) != [(want,)]


@pytest.mark.parametrize("value", ["", " a b ", "a b c", "x\x1cy\x85z", "a​b", "\tone\n\ntwo\r\n three", "é 😀 z"])
def test_white_space_follows_python(spark, value):
    got = column(spark, [value], text.words(F.col("v")), text.word_count(F.col("v")), text.strip(F.col("v")), text.list_items(F.col("v")))[0]
    assert got == (value.split(), len(value.split()), value.strip(), [x.strip() for x in value.strip().splitlines() if x.strip()])


def test_slices_count_code_points(spark):
    value = "aé😀bcd"
    for a, b in ((0, 2), (2, 3), (3, 99), (4, 4), (5, 2)):
        assert column(spark, [value], text.text_slice(F.col("v"), a, b)) == [(value[a:b],)]


def test_cells(spark):
    for kind, allowed, cases in (
        ("boolean", (), {"TRUE": "true", " y ": "true", "0": "false", "No": "false", "maybe": 1, "  ": None, None: None}),
        ("number", (), {"3.9": "3", "-3.9": "-3", " 12 ": "12", "1e3": "1000", "three": 1, "nan": 1, "": None}),
        ("enum", (1, 2, 3), {"1": "1", "4": 1, " 2 ": "2", "1.0": 1}),
        ("text", (), {" x ": "x", " ": None}),
    ):
        value, bad = text.cell(F.col("v"), kind, allowed)
        for (given, want), (v, b) in zip(cases.items(), column(spark, list(cases), value, bad), strict=True):
            assert (v, b) == ((None, True) if want == 1 else (want, False)), (kind, given)


def test_renderings(spark):
    assert column(spark, ["a\nb"], text.blockquote(F.col("v")), text.or_dash(F.lit("")), text.percent(F.lit(1), F.lit(8))) == [("> a\n> b", "—", "12.5%")]
    assert column(spark, ["x"], text.band_text(F.lit(50), F.lit(100)), text.band_text(F.lit(6), F.lit(None).cast("int")), text.band_text(F.lit(None).cast("int"), F.lit(None).cast("int"))) == [("50–100", "at least 6", "no target")]
