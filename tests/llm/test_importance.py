import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelmill.llm import importance

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, percent, least, seed="2024"):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in parts(t, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows, fit = [], []
    for i, text in docs:
        w, f = parts(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None])
        if len(w) >= least:
            fit.append(rows[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = place + 1
    return sorted(map(tuple, rows), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "a1", "Été", "naïve", "x" * 60, "x" * 49, "日本", "7", "Zeta"] + [f"w{i}" for i in range(60)]
    return [" -.,\n"[rng.randrange(5)].join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest, buckets", [(1, 97), (3, 10_000)])
def test_rows_equal_those_of_plain_sums(spark, longest, buckets):
    docs = list(enumerate(texts(1, 150))) + [(200, None), (201, ""), (202, "the " * 5000), (None, "the a1 " * 30), (None, "the a1 " * 30)]
    target = texts(2, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resampled(df, aim, percent=30, least_words=20, longest=longest, buckets=buckets)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, target, longest, buckets, 30, 20)


def test_equal_scores_go_by_id_and_repeated_rows_are_numbered(spark):
    rows = [(7, "a b")] * 5 + [(i, "a b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([("a",)], "text string")
    found = [tuple(r) for r in importance.resampled(df, aim, percent=50, least_words=1).collect()]
    assert sorted(found, key=str) == brute(rows, ["a"], 1, 10_000, 50, 1)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 23))


def test_planes_give_the_sum():
    rng = np.random.default_rng(3)
    gain = rng.integers(-9000, 9000, 1000)
    row, bucket = np.sort(rng.integers(0, 700, 50_000)), rng.integers(0, 1000, 50_000) ** 2 // 1000
    found = importance.Features(row, bucket, np.bincount(row, minlength=700))
    sliced, factors = importance.gain_planes(gain)
    assert importance.weights(found, sliced, factors, 1000).tolist() == np.bincount(row, gain[bucket], 700).astype(int).tolist()


def test_crc_is_that_of_the_bytes():
    raw = np.frombuffer(" ".join(texts(3, 30)).encode(), np.uint8)
    cut = np.unique(np.random.default_rng(0).integers(0, len(raw), 200))
    got = importance.crc_on(np.zeros(len(cut) - 1, np.uint32), raw, cut[:-1], cut[1:])
    assert got.tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]


def test_odd_rows(spark, rich):
    aim = spark.createDataFrame([("one two",), (None,)], "text string")
    found = importance.resampled(rich, aim, percent=100, least_words=5).collect()
    assert len(found) == 8 and sum(r.rank is not None for r in found) == 5
    assert sorted(r.rank for r in found if r.rank) == [1, 2, 3, 4, 5]
    assert importance.resampled(rich.limit(0), aim).collect() == []
    assert len(importance.resampled(rich, aim.limit(0)).collect()) == 8
    assert importance.features.__doc__ and list(importance.features(pa.array([], pa.string()), 1, 10)) == []
