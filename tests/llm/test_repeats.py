"""Brute-force versions of the two removers of repeated stretches."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import runs, substring, suffix
from tests.llm.conftest import table


def without_repeated_bytes(rows, length):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((doc, len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def without_repeated_words(rows, k):
    words = [(t or "").encode().split() for _, t, _ in rows]
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            first[x] = min(first.get(x, i), i)
    out = []
    for r, i, w in zip(rows, ids, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def bytes_result(df, length):
    got = suffix.remove_repeats(df, length).select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def words_result(df, k):
    rows = substring.remove_repeated_words(df, k).collect()
    assert all(sum(s.b - s.a for s in r.removed) == r.n_words - len(r.kept.split()) for r in rows if " " in r.kept)
    return sorted(((r.doc_id, r.n_words, sum(s.b - s.a for s in r.removed), r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("hot", [None, 2000])
def test_bytes_against_brute_force(spark, prose, monkeypatch, hot):
    if hot:  # deals keys out and cuts shards small
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SHARD", 3000)
        monkeypatch.setattr(runs, "PIECE", 1500)
    docs = table(spark, prose).withColumn("spans", F.lit(1)).withColumn("id", F.lit(2))
    got = bytes_result(docs, 400)
    assert sum(r[2] for r in got) > 10_000
    assert got == without_repeated_bytes(prose, 400)


@pytest.mark.parametrize("hot", [None, 50])
def test_words_against_brute_force(spark, prose, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring, "HOT", hot)
        monkeypatch.setattr(substring, "SHARD", 200)
        monkeypatch.setattr(runs, "PIECE", 700)
    docs = table(spark, prose).withColumn("spans", F.lit(1)).withColumn("key", F.lit(2))
    got = words_result(docs, 50)
    assert sum(r[2] for r in got) > 2000
    assert got == without_repeated_words(prose, 50)


def test_odd_rows(spark, odd_rows):
    for rows in (odd_rows, [], [(1, "ab " * 400), (2, "x" + "ab " * 300), (2, "x" + "ab " * 300), (None, "ab " * 200), (None, "ab " * 200)]):
        rows = [(r + ("s0",))[:3] for r in rows]
        docs = table(spark, rows)
        assert bytes_result(docs, 400) == without_repeated_bytes(rows, 400)
        assert words_result(docs, 50) == without_repeated_words(rows, 50)


@pytest.mark.parametrize("size", [399, 400])
def test_passages_of_over_50_words_repeat_in_bytes_from_400_on(spark, size):
    shared = " " + "".join(f"w{j:05d} " for j in range(57))[400 - size :]
    assert len(shared) == size
    rows = [(i, chr(97 + i) * 9 + shared + chr(110 + i) * 9, "s0") for i in range(3)]
    docs = table(spark, rows)
    assert [r[2] for r in words_result(docs, 50)] == [0, 57, 57]
    got = bytes_result(docs, 400)
    assert [r[2] for r in got] == [400 * (size == 400)] * 3
    assert got == without_repeated_bytes(rows, 400)


def test_large_lots_are_divided(monkeypatch):
    r = random.Random(8)
    word = lambda n: bytes(r.choices(b"abcdefgh ", k=n))
    common = word(700)
    texts = list({word(r.randint(0, 300)) + common[r.randint(0, 200) : r.randint(500, 700)] + word(r.randint(0, 300)) for _ in range(60)}) + [b"ab" * 700, b"short"]
    rows = [{"data": t} for t in texts + texts[:5]]
    seen = Counter(t["data"][i : i + 400] for t in rows for i in range(len(t["data"]) - 399))
    for shard in (1 << 17, 4000, 900):
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = list(suffix.decide_rows(rows, 400))
        assert len(got) == len(rows)
        for row, flags in got:
            assert flags.tolist() == [seen[row["data"][i : i + 400]] > 1 for i in range(len(row["data"]) - 399)]


def test_the_transform_alone_decides(monkeypatch):
    r = random.Random(2)
    one, two = (bytes(r.choices(b"abcd", k=500)) for _ in range(2))
    flags = lambda rows: [f.any() for _, f in suffix.decide_rows(rows, 400)]
    assert flags([{"data": one, "weight": 2}, {"data": two, "weight": 1}]) == [True, False]
    assert flags([{"data": one}, {"data": one}, {"data": two}]) == [True, True, False]
    monkeypatch.setattr(suffix, "repeated_windows", lambda texts, length, weights: [np.zeros(len(t) - length + 1, bool) for t in texts])
    assert flags([{"data": one, "weight": 5}, {"data": one}]) == [False, False]


@pytest.mark.parametrize("text", [b"a" * 30_000, b"ab" * 12_000 + b"c", bytes(random.Random(1).choices(b"ab", k=20_000))])
def test_uniform_texts_take_no_square_time(text):
    began = time.perf_counter()
    (flags,) = suffix.repeated_windows([text], 400)
    assert time.perf_counter() - began < 20
    seen = Counter(text[i : i + 400] for i in range(len(text) - 399))
    assert flags.tolist() == [seen[text[i : i + 400]] > 1 for i in range(len(text) - 399)]


def test_runs_are_glued_where_paths_do_not_branch(spark):
    rows = [(1, "h", 0, 3, 10, "A"), (1, "h", 3, 2, 11, "B"), (1, "h", 5, 4, 12, "C"), (2, "i", 7, 3, 10, "A"), (2, "i", 10, 2, 11, "B"), (2, "i", 12, 4, 13, "D"), (3, "j", 0, 3, 10, "A"), (3, "j", 3, 2, 11, "B"), (3, "j", 9, 4, 12, "C")]
    df = spark.createDataFrame([(i, hash(t) % 1000, s, n, k, ord(d), True) for i, t, s, n, k, d in rows], "id long, th long, start int, n int, key long, dig long, many boolean")
    got = {chr(r["dig"]): r["glued"] for r in substring.compacted(substring.with_neighbours(df)).collect()}
    assert got == {"A": True, "B": False, "C": False, "D": False}
    found = substring.paths(df, substring.compacted(substring.with_neighbours(df)).withColumn("at", F.lit(None)))
    places = {(r["id"], r["start"], r["n"]) for r in found.collect()}
    assert places == {(1, 0, 5), (1, 5, 4), (2, 7, 5), (2, 12, 4), (3, 0, 5), (3, 9, 4)}  # A and B are one path
    assert len({r["head"] for r in found.collect() if r["n"] == 5}) == 1


def test_paths_are_taken_for_equal_by_proof_only(spark):
    rows = [(3, 0, 5, 4, 77, b"x"), (2, 0, 9, 4, 77, b"x"), (5, 0, 1, 4, 77, b"y"), (9, 0, 1, 4, 77, b"y"), (9, 0, 8, 6, 77, b"y")]
    places = spark.createDataFrame(rows, "id long, th long, start int, n int, head long, proof binary")
    assert sorted(tuple(r) for r in substring.later_places(places).collect()) == [(3, 0, 5, 9), (9, 0, 1, 5)]


def test_proofs_are_of_the_words_at_their_places(spark):
    texts = [(1, "a  b\tc d"), (2, "x a\nb c"), (3, "a b d"), (4, "ab c")]
    docs = runs.keyed(table(spark, texts))
    places = docs.select("id", "th", F.when(F.col("id") == 2, 1).otherwise(0).alias("start"), F.when(F.col("id") == 4, 1).otherwise(2).alias("n"), F.lit(5).cast("long").alias("head"))
    proof = {r["id"]: bytes(r["proof"]) for r in substring.proven(docs, places, 2).collect()}
    assert proof[1] == proof[2] and len({proof[1], proof[3], proof[4]}) == 3


def test_long_patterned_words_are_different_words(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(["w", word] * 30), "s"), (2, " ".join(["w", other] * 30), "s"), (3, " ".join(["w", word] * 30), "s")]
    assert words_result(table(spark, rows), 50) == without_repeated_words(rows, 50)
    rows = [(1, "x" + word + other, "s"), (2, "x" + other + other, "s"), (3, other + word, "s")]
    assert bytes_result(table(spark, rows), 400) == without_repeated_bytes(rows, 400)


def test_interval_expansion_against_brute_force():
    r = random.Random(5)
    for alphabet, length in (("ab", 12), ("abcdé", 5), ("a", 3), ("abcdefghij", 40)):
        base = "".join(r.choice(alphabet) for _ in range(60))
        texts = []
        for _ in range(25):
            i = r.randrange(40)
            texts.append(("".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) + base[i : i + r.randint(5, 60)]).encode())
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, flags in zip(texts, suffix.repeated_windows(texts, length), strict=True):
            assert flags.tolist() == [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]


def test_dividing_keeps_equal_windows_together():
    r = random.Random(6)
    a, b = (bytes(r.choices(b"abcdef", k=3000)) for _ in range(2))
    text = a + b + a[500:2500]
    keys = {}
    for start, n, key in suffix.divide(text, 400, 3):
        for i in range(start, start + n):
            assert keys.setdefault(text[i : i + 400], key) == key
    assert len(set(keys.values())) > 20
