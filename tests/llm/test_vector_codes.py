import hashlib
import math
import random

import numpy as np

from panelmill.llm import vector_codes


def brute(rows, parts, entries, rounds, scale=4096):
    """Lloyd rounds that compare every part with every entry, in plain Python."""
    good = [(k, lab, [math.floor(scale * x) for x in v]) for k, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in good]
    firsts = sorted(range(len(good)), key=lambda i: good[i][0])[:entries]
    books = [[cut[i][p] for i in firsts] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
        for p in range(parts if turn < rounds else 0):
            for e in range(len(books[p])):
                own = [row[p] for row, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, lab, _), e in zip(good, errors):
        by[lab] = by.get(lab, 0) + e
    return sorted(((k, "".join(f"{i:02x}" for _, i in f), e, by[lab], digest) for (k, lab, _), f, e in zip(good, found, errors)), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_codes_equal_those_of_full_rescans(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i * 3 - 40, rng.choice([None, 1, 1, 2]), [float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(901, 1, [rng.choice([0.0, 0.25, -0.25]) for _ in range(12)]) for _ in range(1)]
    rows += [(902 + i, 2, rows[i][2]) for i in range(20)]  # copies, and many ties
    rng.shuffle(rows)
    options = {"parts": 4, "entries": 7, "rounds": 5}
    found = vector_codes.coded(frame(spark, rows).repartition(3), **options)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 4, 7, 5)


def test_only_moved_entries_are_compared(monkeypatch):
    """A part whose entry stayed meets the moved entries only, and takes the lower index among equals."""
    new = np.array([[[0], [4], [10], [4]]])
    old = np.array([[[0], [9], [10], [5]]])
    books = vector_codes._Books(new, old)
    seen = []
    scan = vector_codes._Books._scan
    monkeypatch.setattr(vector_codes._Books, "_scan", lambda self, x, p, e: seen.append((x.ravel().tolist(), list(e))) or scan(self, x, p, e))
    x = np.array([[2], [1], [9], [7]])
    code, error = books.assign(x, 0, np.array([0, 0, 2, 1]), np.array([4, 1, 1, 4]))
    assert seen == [([7], [0, 1, 2, 3]), ([2, 1, 9], [1, 3])]
    assert code.tolist() == [0, 0, 2, 1] and error.tolist() == [4, 1, 1, 9]
    full, exact = scan(books, x, 0, np.arange(4))
    assert full.tolist() == code.tolist() and exact.tolist() == error.tolist()


def test_odd_rows(spark):
    good = [0.5, -0.5, 0.25, 1.0]
    rows = [(5, 1, good), (5, 1, good), (7, None, [float("nan"), 0.0, 0.0, 0.0]), (8, 1, [float("inf"), 0.0, 0.0, 0.0]), (9, 1, None)]
    rows += [(10, 1, [None, 0.0, 0.0, 0.0]), (11, 1, []), (12, 1, [1.0, 2.0]), (None, None, [3e38, -3e38, 0.0, 0.0]), (13, None, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<float>, code string, k string")
    found = sorted((tuple(r) for r in vector_codes.coded(df, parts=2, entries=3, rounds=2).collect()), key=str)
    assert [r[0] for r in found] == [13, 5, 5, None] and found[1] == found[2]
    assert found[0][3] == found[3][3] == found[0][2] + found[3][2]
    assert vector_codes.coded(df.limit(0)).collect() == []
    assert vector_codes.coded(df.where("vec_id in (7, 9, 12)"), parts=3).collect() == []
    only = vector_codes.coded(df.where("vec_id is null"), parts=2).first()
    assert only.code == "0000" and only.error == 0
