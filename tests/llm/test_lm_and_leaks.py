"""Brute-force versions of language-model scoring and decontamination."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import decontaminate, lm
from tests.llm.conftest import table


def base_scores(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for r in rows if not held(r[0]) for w in tok(r[1]))
    n, v = sum(count.values()), len(count)
    out = []
    for r in rows:
        w = tok(r[1])
        out.append((r[0], held(r[0]), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dictionary", [lm.DICTIONARY, 0])
def test_base_scores_against_brute_force(spark, prose, odd_rows, dictionary):
    for rows in (prose, odd_rows, []):
        docs = table(spark, rows).withColumn("score", F.lit("clash")).withColumn("th", F.lit(1))
        got = lm.score_documents(docs, dictionary=dictionary).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == base_scores(rows)
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_filter_never_lowers_a_level_and_rarely_raises_one():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)
    counts = np.ceil(rng.pareto(1.0, 20_000) + 1e-9).astype(np.int64)
    bits = 1 << 19
    levels = lm.level_of(counts)
    f = lm.Filter(lm.fill(grams, levels, bits)[None, :], 64)
    got = f.levels(grams)
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    assert (f.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)) == 0).mean() > 0.9
    assert lm.level_of(np.array([0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 1, 2, 2, 3, 3, 4]
    assert np.allclose(lm.count_of(np.array([0, 1, 2, 3])), [0, 1, 2.5, 5.5])


def test_filter_is_sized_by_what_it_holds(spark, prose):
    train = table(spark, prose).select("text")
    model, counted = lm.train_model(train)
    assert model.filter.stretches.size * 8 >= lm.held_levels(counted) * lm.BITS_EACH and not model.joined
    parted, _ = lm.train_model(train, max_bits=1 << 10)
    assert parted.joined and parted.filter.stretches.size == 0 and parted.bits == model.bits


def smoothed_scores(rows, model):
    """The documented formula over whole counts, each quantised to the middle of its level."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tok = lambda t: [None, *(t or "").encode().lower().split(), None]
    lower = [(r[0], tok(r[1])) for r in rows]
    words = Counter(w for d, t in lower if not held(d) for w in t[1:])
    pairs = Counter(p for d, t in lower if not held(d) for p in zip(t, t[1:]))
    middle = lambda c: max(1.0, (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2) if c else 0.0
    room = sum(words.values()) + len(words) + 1
    out = {}
    for d, t in lower:
        total = 0.0
        for a, b in zip(t, t[1:]):
            wa, wb = middle(words[a]), middle(words[b])
            seen = min(middle(pairs[a, b]), wa, wb)
            total += math.log10(min(1.0, (seen + lm.MASS * (wb + 1) / room) / (wa + lm.MASS)))
        out.setdefault(d, []).append(total)
    return out


def test_scores_against_the_formula(spark, prose, monkeypatch):
    monkeypatch.setattr(lm, "BITS_EACH", 64)  # so that hardly a level is raised
    want = smoothed_scores(prose, lm)
    got = lm.score_documents(table(spark, prose)).collect()
    assert len(got) == len(prose)
    for r in got:
        assert abs(r.score - want[r.doc_id][0]) < 0.02 * abs(want[r.doc_id][0]) + 1e-6
    assert sum(abs(r.score - want[r.doc_id][0]) < 1e-6 for r in got) > 0.8 * len(got)


def test_counts_beyond_32_bits():
    words = np.array([3, 9], dtype=np.uint64)
    model = lm.Model(lm.Filter(np.zeros((1, 0), np.uint8), 64), 0, 2, words, np.array([7, 1 << 33], dtype=np.uint64), 0, True)
    assert lm._lookup(model, np.array([3, 4, 9], dtype=np.uint64)).tolist() == [7, 0, 1 << 33]


def test_long_words_of_one_pattern_are_two(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(d, other if zlib.crc32(str(d).encode()) % 7 == 2 else word) for d in range(30)]
    assert {r.n_known for r in lm.score_documents(table(spark, rows)).collect()} == {1, 2}


def test_pairs_make_seen_text_likelier(spark):
    r = random.Random(3)
    seen = ["the cat sat on the mat and the dog ran off"] * 50
    other = [" ".join(r.sample(seen[0].split(), 11)) for _ in range(20)]
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 != 2][:50]
    late = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:21]
    rows = list(zip(ids, seen, strict=True)) + list(zip(late, [seen[0], *other], strict=True))
    got = {x.doc_id: x for x in lm.score_documents(table(spark, rows)).collect()}
    assert got[late[0]].score > max(got[i].score for i in late[1:]) and got[late[0]].score > got[late[0]].base_score


@pytest.mark.parametrize("dictionary", [lm.DICTIONARY, 0])
def test_scores_do_not_depend_on_the_filters_place(spark, prose, odd_rows, dictionary):
    docs = table(spark, prose + odd_rows)
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.collect()), key=repr)
    assert plain(lm.score_documents(docs, dictionary=dictionary, max_bits=1 << 10)) == plain(lm.score_documents(docs, dictionary=dictionary))


def test_pairs_seen_once_are_kept(spark):
    raw = np.frombuffer(b"one two three", np.uint8)
    token, bounds = lm.tokens(raw, np.array([0, len(raw)]))
    model, _ = lm.train_model(table(spark, [(1, "one two three")]).select("text"))
    assert (model.filter.levels(lm.pairs(token, bounds)) >= 1).all()


def test_rows_sent_do_not_grow_with_the_buckets(spark, prose, monkeypatch):
    docs = table(spark, prose).repartition(4)
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.collect()), key=repr)
    want = plain(lm.score_documents(docs))
    size = sum(len(r[1].encode()) for r in prose)
    monkeypatch.setattr(lm, "BUCKET", size // 3000)
    monkeypatch.setattr(lm, "BITS_EACH", 64)
    kind, sent = type(docs), {}
    monkeypatch.setattr(kind, "repartition", lambda self, *by, f=kind.repartition: sent.update({by: self.count()}) or f(self, *by))
    got = plain(lm.score_documents(docs, dictionary=0, max_bits=1 << 10))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert len(sent) >= 3 and max(sent.values()) <= 4 * 64 + 2 * 4096  # asking pieces, and two rows of each bucket


# ---------------------------------------------------------------- leaks


def distance(item: bytes, text: bytes) -> int:
    """Least edits of the item against any stretch of the text, by the whole table."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    t, slope = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for c in item:
        step = np.empty_like(row)
        step[0] = row[0] + 1
        step[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(step - slope) + slope
    return int(row.min())


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        r.choice([lambda: s.pop(i), lambda: s.insert(i, r.choice("abz ")), lambda: s.__setitem__(i, r.choice("abz"))])()
    return "".join(s)


def test_leaks_against_brute_force(spark, prose, odd_rows, monkeypatch):
    r = random.Random(9)
    items = [(i, t[:n]) for i, ((_, t, _), n) in enumerate(zip(prose, [30, 80, 95, 150, 260, 400, 55], strict=False))]
    items += [(50, None), (51, ""), (52, "short"), (53, items[3][1]), (54, "É" * 60), (55, "a b c"), (56, "A"), (57, items[0][1].split()[0])]
    docs = [(d, t, s) for d, t, s in prose[20:80]]
    for k in range(90):
        d, t, s = docs[k % len(docs)]
        item = items[k % 7][1]
        at = r.randrange(len(t))
        docs.append((1000 + k, t[:at] + " " + edited(r, item, r.choice([0, 0, 1, 3, 6, 12, 25])).upper().replace(" ", " \n", 1) + " " + t[at:], s))
    docs += odd_rows
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want, bad = {}, set()
    for d, t, _ in docs:
        for i, x in items:
            x = decontaminate.normalise(x)
            if 0 < len(x) < decontaminate.MIN_ITEM:
                if b" " + x + b" " in b" " + decontaminate.normalise(t) + b" ":
                    want.setdefault((d, i), []).append(0)
                    bad.add((d, t))
            elif x:
                e = distance(x, decontaminate.normalise(t))
                if e <= decontaminate.edit_budget(len(x)):
                    want.setdefault((d, i), []).append(e)
                    bad.add((d, t))
    docs_df = table(spark, docs).withColumn("item_id", F.lit("clash"))
    for block, piece in ((decontaminate.BLOCK, decontaminate.PIECE), (300, 900)):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        got = {}
        for m in decontaminate.find_leaks(docs_df, bench).collect():
            got.setdefault((m.doc_id, m.item_id), []).append(m.edits)
            if m.doc_id is not None and m.doc_id >= 1000:
                text = decontaminate.normalise(next(t for d, t, _ in docs if d == m.doc_id))
                item = decontaminate.normalise(dict(items)[m.item_id])
                assert distance(item, text[m.start : m.end]) == m.edits
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(want) > 60
    kept = decontaminate.drop_leaks(docs_df, bench)
    assert kept.columns == docs_df.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted(((d, t) for d, t, _ in docs if (d, t) not in bad), key=repr)
    assert decontaminate.find_leaks(docs_df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs_df.limit(0), bench).count() == 0


def test_repetitive_texts_take_little(spark):
    items = [(1, "=" * 1500), (2, "ab" * 400), (3, "the quick brown fox jumps over the lazy dog " * 9), (4, "=" * 700 + "x" * 300)]
    index = decontaminate.build_index(items)
    for text, want in (("=" * 1_000_000, {1: 0}), ("ab" * 300_000, {2: 0}), ("=" * 50_000 + "x" * 320, {1: 0, 4: 0}), (("=" * 700 + "y") * 200, {1: 2})):
        began = time.perf_counter()
        got = {m[1]: m[2] for m in decontaminate._search(index, [decontaminate.normalise(text)])}
        assert time.perf_counter() - began < 40
        assert {k: got.get(k) for k in want} == want


def test_heavy_q_grams_only_raise_counts(monkeypatch):
    r = random.Random(2)
    items = [(k, "".join(r.choices("ab ", k=r.randint(60, 200)))) for k in range(6)]
    texts = [decontaminate.normalise("".join(r.choices("ab ", k=900)) + items[k % 6][1] + "c") for k in range(12)]
    exact = [dict(decontaminate.matches(decontaminate.build_index(items), t)) for t in texts]
    monkeypatch.setattr(decontaminate, "HEAVY", 2)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    heavy = [dict(decontaminate.matches(decontaminate.build_index(items), t)) for t in texts]
    assert [{k: v[0] for k, v in x.items()} for x in exact] == [{k: v[0] for k, v in x.items()} for x in heavy]
