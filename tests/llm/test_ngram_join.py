import random
import re

from panelmill.llm import ngram_join
from panelmill.llm.ngram_join import similar_groups


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (len(sets[i]), group[i]) for i in sets}


def test_groups_equal_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 90]))]
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    hot = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # a large group of near copies of each other
        copy = list(hot)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a  B"), (505, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df).collect()}
    assert found == brute(rows)


def test_odd_rows(spark, rich):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(rich).collect()), key=str)
    assert found.count((3, 2, 3)) == 2 and (7, 2, 3) in found
    assert (1, 0, 1) in found and (2, 0, 2) in found and (5, 0, 5) in found
    assert (None, 2, None) in found and (-4, 1, -4) in found and len(found) == 8
    assert similar_groups(rich.limit(0)).collect() == []


def families(seed, count, copies):
    """Texts with exact copies, each with two near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(count):
        base = [rng.choice(words) for _ in range(60)]
        for place in (10, 50):
            near = list(base)
            near[place] = "changed"
            rows.append((len(rows), " ".join(near)))
        rows += [(len(rows) + i, " ".join(base)) for i in range(copies)]
    return rows


def test_salted_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_HOT", 2)
    rows = families(7, 12, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df).collect()}
    assert found == brute(rows)


def test_last_round_alone_finds_pivots_with_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_PIVOT_TRIES", (0,))
    rows = families(8, 12, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df).collect()}
    assert found == brute(rows)


def near_copies(seed, count, changes):
    """A base text's copies with up to so many words changed; the base itself is not among them."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(count):
        copy = list(base)
        for place in rng.sample(range(150), rng.randrange(1, changes)):
            copy[place] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_group_of_near_copies_of_which_a_third_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_HOT", 2)
    rows = near_copies(3, 400, 9) + [(400 + i, t) for i, (_, t) in enumerate(near_copies(3, 30, 9))]
    expected = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df).collect()} == expected
    assert 100 < len({c for _, c in expected.values()}) < 350
    monkeypatch.setattr(ngram_join, "_PIVOT_TRIES", (1,))
    monkeypatch.setattr(ngram_join, "_MANY_PAIRS", 0)  # rounds between the groups
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df).collect()} == expected
