"""Brute-force versions of fingerprints, the trie self-join, components and near-copy removal."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citelake.llm import graph, simhash
from citelake.llm.runs import keyed
from tests.llm.conftest import table


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    feats = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(f, 42) for f in feats]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_components(fps, budget):
    fps = sorted(set(fps))
    return closure(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= budget])


def test_components_against_brute_force(spark, prose, odd_rows):
    rows = prose + odd_rows
    docs = table(spark, rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    root = slow_components(fps, 3)
    least = defaultdict(lambda: float("inf"))
    for (d, _, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root[f]] = min(least[root[f]], d)
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for (d, _, _), f in zip(rows, fps, strict=True)), key=repr)
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("budget", "blocks"), [(3, 4), (3, 5), (3, 6), (7, 8), (7, 9), (0, 1), (1, 2)])
def test_trie_links_find_every_component(budget, blocks):
    rng = np.random.default_rng(budget + blocks)
    centres = rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
    values = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(int(rng.integers(0, 40))):
            v = c
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    links = []
    for bits, exact in simhash.block_choices(budget, blocks):
        moved = simhash.permute(np.array(values, dtype=np.uint64), bits)
        assert [sum((v >> (63 - b) & 1) << (63 - i) for i, b in enumerate(bits)) for v in values[:5]] == moved[:5].tolist()
        order = np.argsort(moved)
        got = simhash.trie_links(moved[order], exact, budget, chunk=50, leaf=4)
        pairs = [(values[order[i]], values[order[j]]) for i, j in got]
        assert len(pairs) < len(values) and all((a ^ b).bit_count() <= budget for a, b in pairs)
        links += pairs
    assert closure(values, links) == slow_components(values, budget)


def test_graph_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == closure(nodes, edges[:-1])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_candidates_against_brute_force():
    rng = np.random.default_rng(4)
    texts = 40
    sets = [np.unique(rng.integers(0, 1 << 62, 400 if k % 3 else 30).astype(np.uint64)) for k in range(texts)]
    for k in range(1, texts):
        if k % 4:
            own = sets[k - 1].copy()
            own[: rng.integers(0, len(own) // 3)] += np.uint64(1)
            sets[k] = np.unique(own)
    n = np.array([len(x) for x in sets])
    marks = simhash.parity_marks(np.concatenate(sets), np.repeat(np.arange(texts), n), texts)
    apart = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2)
    assert all(apart[i, j] <= len(np.setxor1d(sets[i], sets[j])) for i in range(texts) for j in range(texts))
    token, th = np.repeat(np.arange(5), texts), np.tile(np.arange(texts), 5)
    at, root = rng.integers(0, 4, len(th)), np.where(th % 3 == 0, th, th % 2)
    need = lambda a, b: math.ceil(0.8 / 1.8 * (n[a] + n[b]) - 1e-9)
    for most in (1 << 20, 7):
        got = {p for a, b in simhash.candidates(token, root, th, n[th], at, marks[th], 0.8, None, most) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want = set()
        for t in range(5):
            for a in range(texts):
                for b in range(a + 1, texts):
                    x, y = at[t * texts + a], at[t * texts + b]
                    small, large = sorted((n[a], n[b]))
                    if root[a] != root[b] and large <= math.floor(small / 0.8 + 1e-9) and min(n[a] - x, n[b] - y) >= need(a, b) and apart[a, b] <= n[a] + n[b] - 2 * need(a, b):
                        want.add((a, b))
        assert got == want and len(want) > 10


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).select("doc_id").collect()}
    rows = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    holders = defaultdict(list)
    for d, s in rows:
        for x in s:
            holders[x].append(d)
    sets, near, close = dict(rows), [], set()
    for d, s in rows:
        for o in {o for x in s for o in holders[x] if o > d}:
            j = len(s & sets[o]) / len(s | sets[o])
            if j >= 0.8:
                near.append((d, o))
            if j >= 0.65:
                close |= {d, o}
    root = closure([d for d, _ in rows], near)
    groups = defaultdict(set)
    for d, c in root.items():
        groups[c].add(d)
    assert all(d in kept for d, s in rows if d not in close and s)
    many = [g for g in groups.values() if len(g) > 1]
    assert sum(len(g & kept) == 1 for g in many) >= 0.95 * len(many) > 10


def test_near_copies_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows).withColumn("fp", F.lit("clash"))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    texts = [" ".join((r["text"] or "").split()) for r in got]
    assert texts.count("") == 1 and texts.count("a b c") == 1
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def slow_survivors(rows):
    """Least ids of the groups of similar texts, over all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    like = lambda a, b: not (a or b) or len(a & b) / len(a | b) >= 0.8
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if like(sets[a], sets[b])]
    return set(closure(ids, near).values())


def survivors(spark, rows):
    return {r.doc_id for r in simhash.drop_near_copies(table(spark, rows)).select("doc_id").collect()}


def test_near_copies_under_one_fingerprint(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    swapped = [*words[:90], words[91], words[90], *words[92:]]
    rows = [(0, " ".join(r.sample(words, 200))), (1, " ".join(words)), (2, " ".join(swapped))]
    assert survivors(spark, rows) == slow_survivors(rows) == {0, 1}


def test_near_copies_of_dense_groups(spark):
    """Templates with many fillings and long texts of one vocabulary, some close to the bound."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    form = r.choices(words, k=150)
    rows = []
    for i in range(120):
        text = list(form) if i % 2 else r.choices(words, k=150)
        if i % 6 == 0 and i:
            text = rows[r.randrange(len(rows))][1].split()
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8, 30])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, " ".join(text)))
    assert survivors(spark, rows) == slow_survivors(rows)


def test_near_copies_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, d.text) for d in docs]
    assert survivors(spark, rows) == slow_survivors(rows)


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    """The trie's links make the first groups, and one that does not hold on the whole sets joins nothing."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    rows, texts = [], []
    for i in range(6):
        texts.append(r.sample(words, 400))
        edited = list(texts[-1])
        edited[r.randrange(400)] = "edited"
        texts.append(edited)
    passage = r.sample(words, 60)
    texts += [passage * 40 + r.sample(words, 30) for _ in range(2)]  # the repeats decide the fingerprint, not the set
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    fps = {i: slow_fingerprint(t) for i, t in rows}
    close = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    assert (12, 13) in close and len(close) > 3
    of = {x.th: x.id for x in keyed(table(spark, rows)).collect()}
    asked = []
    monkeypatch.setattr(simhash, "print_links", lambda *a, f=simhash.print_links: asked.append(f(*a)) or asked[-1])
    kept = survivors(spark, rows)
    links = {tuple(sorted((of[x.a], of[x.b]))) for x in asked[0].collect()}
    assert links <= close and closure(range(len(rows)), links) == closure(range(len(rows)), close)
    assert kept == slow_survivors(rows) and {12, 13} <= kept
