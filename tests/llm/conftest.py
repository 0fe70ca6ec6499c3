import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, source), with lang and n_chars."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [None, "", " ", "\n\n", "a", "A", "é", "\x00\x1f", "word", "tab\tsep\x0bvt", "İK ſ", "a b c", "a b c", "😀 x", "x" * 5000, "w " * 3000]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD)]
    return rows + [(5, "A", "s1"), (5, "A", "s1"), (None, "a b c", "s2"), (None, None, None), (3, "other text", "s0")]


@pytest.fixture(scope="session")
def prose():
    """Some hundred texts with copies, near copies, shared passages and repeated lines."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [make(90) for _ in range(4)]
    lines = [make(9) for _ in range(3)]
    rows = []
    for i in range(160):
        parts = [make(r.randint(1, 160)) for _ in range(r.randint(1, 4))]
        if i % 5 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        if i % 4 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(lines))
        rows.append((i, "\n".join(parts), f"s{i % 9}"))
    for i in range(160, 200):
        base = rows[r.randint(0, 20)][1].split(" ")
        if i % 2:
            base[r.randrange(len(base))] = "edited"
        rows.append((i, " ".join(base), f"s{i % 9}"))
    r.shuffle(rows)
    return rows
