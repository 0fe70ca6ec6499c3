"""Brute-force versions, exact round trips and odd cases for media, quality, licenses, lines and mixing."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import license as licenses
from citelake.llm import lines, media, mixing, quality
from tests.llm.conftest import SCHEMA, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("shape", [(24, 24), (8, 24, 3), (1, 1), (7, 5, 3), (300, 513)])
def test_images_survive_formats_and_tiles(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode_image(media.encode_netpbm(image)) == image).all()
    again = media.decode_image(media.encode_bmp(image))
    assert ((again if image.ndim == 3 else again[:, :, 0]) == image).all()
    assert (media.from_tiles(media.to_tiles(image, 100), shape[1]) == image).all()


def test_plain_and_packed_netpbm():
    assert media.decode_image(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_image(b"P2 2 1 15 15 0").tolist() == [[255, 0]]
    assert media.decode_image(b"P4\n9 1\n\x80\x00").tolist() == [[0] + [255] * 8]


def test_area_means_are_exact():
    image = np.random.default_rng(2).integers(0, 256, (37, 50)).astype(np.uint8)
    big = np.repeat(np.repeat(image.astype(float), 8, axis=0), 9, axis=1)
    want = big.reshape(8, 37, 9, 50).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)


def test_media_digests(spark, odd_rows):
    docs = table(spark, odd_rows).withColumn("media", F.lit(1)).withColumn("tiles", F.lit(2))
    got = media.media_digests(media.store_texts(docs)).collect()
    assert len(got) == len(odd_rows)
    values = defaultdict(set)
    by = defaultdict(list)
    for d, t, _ in odd_rows:
        by[d].append(t)
    for r in got:
        texts = by[r.doc_id]
        payloads = [media.text_payload(t) for t in texts]
        k = [hashlib.sha256(p).hexdigest() for p in payloads].index(r.payload_sha256)
        assert r.n_bytes == len((texts[k] or "").encode()) and r.payload_bytes == len(payloads[k])
        assert r.tail_crc32 == zlib.crc32(payloads[k][-32:])
        values[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in values.values())


def test_text_digests_are_those_of_stored_media(spark, odd_rows):
    docs = table(spark, odd_rows).withColumn("_text", F.lit("clash"))
    stored = media.media_digests(media.store_texts(docs))
    got = media.text_digests(docs)
    assert sorted(got.select(*stored.columns).collect(), key=repr) == sorted(stored.collect(), key=repr)


def test_stored_media_against_brute_force(spark, odd_rows):
    """The stored form and its feature, made again by plain loops."""
    rows = [(i, t) for i, (_, t, _) in enumerate(odd_rows)]
    for r in media.text_digests(table(spark, rows)).collect():
        payload = media.text_payload(rows[r.doc_id][1])
        units, kind = len(payload) // 576, len(payload) // 576 % 3
        deep = 1 if kind == 0 else 3
        height = len(payload) // 24 // deep
        pixels = [[payload[(y * 24 + x) * deep : (y * 24 + x + 1) * deep] for x in range(24)] for y in range(height)]
        if units < 12:
            tall = [[sum(pixels[y][x]) / deep for x in range(24)] for y in range(height)]
            big = [[tall[y // 8][x // 9] for x in range(24 * 9)] for y in range(height * 8)]
            mean = [[round(sum(big[y][x] for y in range(i * height, (i + 1) * height) for x in range(j * 24, (j + 1) * 24)) / (24 * height), 6) for j in range(9)] for i in range(8)]
            bits = "".join(str(int(mean[i][j + 1] > mean[i][j])) for i in range(8) for j in range(8))
            assert r.feature == f"{int(bits, 2):016x}"
        whole = b""
        for y in range(0, height, 256):
            rows_ = pixels[y : y + 256]
            shape = f"({len(rows_)}, 24)" if deep == 1 else f"({len(rows_)}, 24, 3)"
            head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {shape}, }}".encode()
            pad = -(10 + len(head) + 1) % 64
            whole += b"\x93NUMPY\x01\x00" + (len(head) + pad + 1).to_bytes(2, "little") + head + b" " * pad + b"\n" + b"".join(b"".join(row) for row in rows_)
        assert (r.media_bytes, r.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())


def test_broken_images_give_reasons(spark):
    hostile = [b"P5\n99999999999 99999999999\n255\n", b"P4\n99999999999 9999999\n", b"P3 999999999 999999999 255 1", b"P5 0 5 255\n", b"P5 1 1 0\n1", b"P6 -1 4 255\n", b"P5 " + b"9" * 5000, b"BM" + b"\xff" * 60, b"BM" + b"\x00" * 12 + b"\x28\x00\x00\x00" + b"\xff\xff\xff\x7f" * 2 + b"\x01\x00\x18\x00" + b"\x00" * 24]
    df = spark.createDataFrame([(1, b"P5 2 2 255\nabcd"), (2, b"junk"), (3, None), (4, b"BM"), (5, b"P6 9 9 255\nx"), *[(10 + i, x) for i, x in enumerate(hostile)]], "id int, media binary")
    got = {r.id: r for r in media.decode_media(df).collect()}
    assert all(got[10 + i].error and got[10 + i].tiles is None for i in range(len(hostile)))
    assert got[1].error is None and got[1].width == 2 and len(got[1].tiles) == 1
    assert got[3].error is None and got[3].tiles is None
    assert all(got[i].error and got[i].tiles is None for i in (2, 4, 5))


# ---------------------------------------------------------------- quality


def test_trees_match_node_by_node_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.grow(x, y, depth=3)
    slow = []
    for row in x[:50]:
        s = model.start
        for f, lim, v in zip(model.feature, model.limit, model.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > lim[k])
            s += v[k - len(f)]
        slow.append(s)
    assert np.allclose(model.raw_scores(x)[:50], slow)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95


def slow_grow(x, y, trees, depth, rate, bins, ridge, least):
    """Boosted trees by plain loops over nodes, features and limits."""
    share = y.mean()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    raw = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in nodes:
                g, h = grad[rows].sum(), hess[rows].sum()
                best, split = 1e-9, None
                for f in range(x.shape[1]):
                    for limit in edges[f]:
                        left = rows[x[rows, f] <= limit]
                        right = rows[x[rows, f] > limit]
                        if min(len(left), len(right)) < least:
                            continue
                        gl, hl = grad[left].sum(), hess[left].sum()
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        if gain > best + 1e-12:
                            best, split = gain, (left, right)
                after += split or (rows, np.zeros(0, int))
            nodes = after
        for rows in nodes:
            raw[rows] += -rate * grad[rows].sum() / (hess[rows].sum() + ridge)
    return raw


def test_growing_against_plain_loops():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[:, 2] = rng.integers(0, 3, 300)
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.4 * rng.normal(size=300)) > 0.1).astype(float)
    options = {"trees": 4, "depth": 3, "rate": 0.2, "bins": 9, "ridge": 1.0, "least": 7}
    assert np.allclose(quality.grow(x, y, **options).raw_scores(x), slow_grow(x, y, **options))


def test_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(base + "documents.parquet"), spark.read.parquet(base + "labels.parquet")
    scored = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).toPandas()
    assert ((scored.score >= 0.5) == (scored.quality == 1)).mean() > 0.9
    good, bad = scored.score[scored.quality == 1].values, scored.score[scored.quality == 0].values
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_quality_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 1), (5, None, 0), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs.limit(0), labels)
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- licenses


def scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(spark, odd_rows):
    texts = [t for _, t, _ in odd_rows] + [
        "CC BY NC CC-BY-NC cc by nc",
        "Under the MIT License.",
        "x under the mit license under the mit license, Apache License, Version 2.0",
        "é under the mit licenses; cc by NCx; apache license version 20",
        "Licensed under the Apache License, Version 2.0\n" * 50,
    ]
    docs = table(spark, list(enumerate(texts))).withColumn("score", F.lit("x"))
    for r in licenses.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def plain_words(text):
    return " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) + " "


def slow_detections(text):
    """Every rule over the whole text, without keywords or gate, and containment by its definition."""
    norm = plain_words(text)
    found = sorted((m.start(), -m.end(), p, label, sure) for _, label, p, sure, pattern in licenses.rules() for m in re.finditer(pattern, norm))
    kept = []
    for x in found:
        if not any(k[1] <= x[1] and k[2] <= x[2] for k in kept):
            kept.append(x)
    return [(a, -z, label, sure) for a, z, _, label, sure in kept]


BODIES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def said_by(pattern, r):
    """A text that an expression matches."""
    from re import _parser as parser

    def say(parts):
        out = ""
        for op, x in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(x)
            elif name == "SUBPATTERN":
                out += say(x[3])
            elif name == "BRANCH":
                out += say(r.choice(x[1]))
            elif name == "MAX_REPEAT":
                low, high, inner = x
                out += "some words " if high > 1 else say(inner) * r.randint(low, high)
            elif name == "IN":
                out += chr(r.choice([c for kind, v in x for c in (range(v[0], v[1] + 1) if str(kind) == "RANGE" else [v])]))
            else:
                assert name in ("ASSERT", "ASSERT_NOT"), name
        return out

    return say(parser.parse(pattern))


def test_detections_against_brute_force(spark, odd_rows):
    r = random.Random(4)
    texts = [t for _, t, _ in odd_rows] + [b.upper() if k % 2 else b for k, b in enumerate(BODIES.values())]
    texts += ["This program is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later", "nothing of the kind under the tree"]
    texts += ["CC BY-SA 4.0 license and, elsewhere, the BSD license", "Available under the MIT license" + " x" * 3000 + " license: MPL 2.0", "the \u212a MIT license İ mit License"]
    said = [said_by(pattern, r) for *_, pattern in licenses.rules()]
    texts += [" ".join(r.choices(said, k=r.randint(1, 12))) for _ in range(150)]
    got = {x.doc_id: x for x in licenses.scan_licenses(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = slow_detections(t)
        assert [(d.start, d.end, d.label, d.confidence) for d in got[i].detections] == want, t
        assert got[i].labels == ",".join(sorted({w[2] for w in want} | set(filter(None, got[i].base_labels.split(",")))))
        assert got[i].score == (1.0 if got[i].n_base else max([w[3] for w in want], default=0.0))


def test_license_bodies_are_known(spark):
    got = {x.doc_id: x.labels.split(",") for x in licenses.scan_licenses(table(spark, list(enumerate(BODIES.values())))).collect()}
    for i, label in enumerate(BODIES):
        assert label in got[i], (label, got[i])


def test_keywords_and_gate_are_necessary():
    r = random.Random(6)
    assert len(licenses.rules()) >= 300 and len(set(licenses.rules())) == len(licenses.rules())
    for keyword, label, priority, sure, pattern in licenses.rules():
        assert any(g in keyword for g in licenses.GATE) and 1 <= priority <= 4 and 0 < sure <= 1
        for _ in range(20):
            said = f" {said_by(pattern, r)} "
            assert re.search(pattern, said) and keyword in said, (label, pattern, said)


def test_very_many_detections(spark):
    text = "licensed under the mit license and " * 20_000
    began = time.perf_counter()
    (got,) = licenses.scan_licenses(table(spark, [(1, text)])).select(F.size("detections").alias("n"), "n_base").collect()
    assert (got.n, got.n_base) == (20_000, 20_000) and time.perf_counter() - began < 60


# ---------------------------------------------------------------- lines


def dedup(rows, least):
    split = [(d, None if t is None else t.split("\n"), s) for d, t, s in rows]
    sites, first = defaultdict(set), {}
    for d, ls, s in split:
        for p, x in enumerate(ls or []):
            if k := x.strip(" "):
                sites[k].add(s)
                at = (float("inf") if d is None else d, p)
                first[k] = min(first.get(k, at), at)
    out = []
    for d, ls, _ in split:
        gone = {p for p, x in enumerate(ls or []) if (k := x.strip(" ")) and len(sites[k]) >= least and (float("inf") if d is None else d, p) != first[k]}
        out.append((d, len(ls or []), len(gone), None if ls is None else "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_lines_against_brute_force(spark, prose, odd_rows, least):
    for rows in (prose, odd_rows, [(i, f"same\n{i}", f"s{i % 7}") for i in range(300)], []):
        docs = table(spark, rows).withColumn("n_removed", F.lit("clash"))
        got = lines.dedup_lines(docs, min_sites=least).select("doc_id", "n_lines", "n_removed", "text").collect()
        assert sorted((tuple(r) for r in got), key=repr) == dedup(rows, least)


def test_a_text_of_very_many_lines(spark):
    rows = [(0, "\n".join(["same", *map(str, range(100_000)), *["same"] * 100_000]), "s0"), *[(i, "same", f"s{i}") for i in range(1, 9)]]
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert time.perf_counter() - began < 60
    assert (got[0].n_lines, got[0].n_removed, got[0].text) == (200_001, 100_000, "\n".join(["same", *map(str, range(100_000))])) and got[3].text == ""


# ---------------------------------------------------------------- mixing


def test_targets_share_by_weight_and_stop_at_three_times():
    got = mixing.targets({"b": 10, "a": 1000, None: 5, "c": 1}, (5, 2, 1), 3)
    assert got["b"] == 30 and got["c"] == 3 and got[None] == 15 and abs(got["a"] - (1016 - 48)) < 1e-9
    assert mixing.targets({}, (5, 2, 1), 3) == {} and set(mixing.targets({"a": 0, None: 0}, (5, 2, 1), 3).values()) == {0.0}


def test_mixing_comes_near_targets(spark, prose, odd_rows):
    for rows in (prose, odd_rows):
        docs = table(spark, rows).withColumn("size", F.lit("clash"))
        for name in ("source_size", "target", "copies", "taken", "passes", "prefix", "take", "part", "b", "n", "upto", "rest"):
            docs = docs.withColumn(name, F.lit("clash"))
        got = mixing.mix_sources(docs).collect()
        assert len(got) == len(rows)
        per = defaultdict(list)
        for r in got:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict_text(rows, r)))
            assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
            per[r.source].append(r)
        want = mixing.targets({s: sum(r["size"] for r in rs) for s, rs in per.items()}, (5, 2, 1), 3)
        for s, rs in per.items():
            assert {r.target for r in rs} == {want[s]} and {r.source_size for r in rs} == {sum(r["size"] for r in rs)}
            assert abs(sum(r.taken for r in rs) - want[s]) <= max([r["size"] for r in rs], default=0) * 2
        again = mixing.mix_sources(docs.repartition(3)).collect()
        assert sorted((repr(r) for r in got)) == sorted((repr(r) for r in again))
    assert mixing.mix_sources(table(spark, [])).count() == 0


def slow_mix(rows):
    """copies of each (doc_id, text, source, hash): whole passes, then by ascending hash until the target is met; the nearer side of the last hash wins."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    want = mixing.targets({s: sum(size(r[1]) for r in rs) for s, rs in by.items()}, (5, 2, 1), 3)
    out = []
    for s, rs in by.items():
        whole = sum(size(r[1]) for r in rs)
        passes = min(3, int(want[s] // whole)) if whole else 0
        rest = want[s] - passes * whole if passes < 3 else 0.0
        more, upto = set(), 0
        for h in sorted({r[3] for r in rs}) if rest > 0 and whole else ():
            n = sum(size(r[1]) for r in rs if r[3] == h)
            if upto + n < rest or 2 * (rest - upto) >= n:
                more.add(h)
            upto += n
            if upto >= rest:
                break
        out += [(r[0], r[1], s, passes + (r[3] in more)) for r in rs]
    return out


def mixed_by_hand(docs):
    return slow_mix([(r.doc_id, r.text, r.source, r.h % (1 << 64)) for r in docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h")).collect()])


def test_mixing_against_brute_force(spark, prose, odd_rows):
    same = [(i, "one two three four", "a") for i in range(30)] + [(1, "one two three four", "a")] * 5 + [(100, "long " * 500, "b"), (101, "x", "b"), (102, "", "c"), (103, None, None), (104, "y z", None)]
    for rows in (prose, odd_rows, same, [(1, "a b c", "s")], []):
        docs = table(spark, rows)
        got = [(r.doc_id, r.text, r.source, r.copies) for r in mixing.mix_sources(docs).collect()]
        taken = lambda xs: sorted(repr((d, t, s, c if (t or "").split() else 0)) for d, t, s, c in xs)
        assert taken(got) == taken(mixed_by_hand(docs))


def dict_text(rows, r):
    return r["text"] or ""


def test_schema_is_documents():
    assert SCHEMA.startswith("doc_id long")
