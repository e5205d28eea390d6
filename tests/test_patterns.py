import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from panelmill.operators import itemsets, rules
from panelmill.sources.rules import RULE_SCHEMA, read_rules, write_rules


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2)], "a int, b int")


def as_dict(sets):
    return {tuple(r["items"]): r["count"] for r in sets.collect()}


def test_itemsets_and_candidates(small):
    sets = itemsets.frequent_itemsets(small, ["a", "b"], 0.5)
    assert as_dict(sets) == {("a=1",): 3, ("b=1",): 2, ("b=2",): 2, ("a=1", "b=1"): 2}
    counts = {r["size"]: r.candidates for r in itemsets.candidate_counts(small, ["a", "b"], sets).collect()}
    assert counts == {1: 4, 2: 3, 3: 0}


def test_no_candidates_without_a_frequent_level(small):
    sets = itemsets.frequent_itemsets(small, ["a", "b"], 0.9)
    assert [r["size"] for r in itemsets.candidate_counts(small, ["a", "b"], sets).collect()] == [1]


def test_rules(small):
    sets = itemsets.frequent_itemsets(small, ["a", "b"], 0.5)
    found = {tuple(r.antecedent): (r.confidence, r.lift) for r in rules.association_rules(sets, 0.6).collect()}
    assert found[("a=1",)] == (pytest.approx(2 / 3), pytest.approx(4 / 3))
    assert found[("b=1",)] == (1.0, pytest.approx(4 / 3))


def test_two_item_consequents(spark):
    df = spark.createDataFrame([(1, 1, 1)] * 4 + [(2, 2, 2)], "a int, b int, c int")
    found = rules.association_rules(itemsets.frequent_itemsets(df, ["a", "b", "c"], 0.5), 0.6)
    row = found.filter(F.size("consequent") == 2).filter(F.col("antecedent")[0] == "a=1").first()
    assert (row.consequent, row.confidence, row.lift) == (["b=1", "c=1"], 1.0, 1.25)
    kept = rules.target_rules(found, "c", 1.0).collect()
    assert kept and all(any(i.startswith("c=") for i in r.consequent) for r in kept)


def test_missing_category_is_an_item(spark):
    df = spark.createDataFrame([("x",), (None,)], "k string")
    assert as_dict(itemsets.frequent_itemsets(df, ["k"], 0.5)) == {("k=x",): 1, ("k=nan",): 1}


def test_baskets_against_brute_force(spark):
    pairs = [(b, f"i{(b * j) % 7}") for b in range(60) for j in range(1, 5)] + [(0, "i0")] * 50
    df = spark.createDataFrame(pairs, "b int, i string")
    found = as_dict(itemsets.frequent_itemsets_baskets(df, "b", "i", 0.2))
    baskets = {b: sorted({i for c, i in pairs if c == b}) for b, _ in pairs}
    expected = {}
    for members in baskets.values():
        for size in (1, 2, 3):
            for chosen in combinations(members, size):
                expected[chosen] = expected.get(chosen, 0) + 1
    assert found == {k: v for k, v in expected.items() if v / len(baskets) >= 0.2}


def test_wide_tables_agree_with_counting(spark):
    rows = [(i % 2, i % 3, i % 4, i % 7) for i in range(84)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    for size in (3, 4):
        expected = {}
        for row in rows:
            items = sorted(f"{c}={v}" for c, v in zip("abcd", row))
            for k in range(1, size + 1):
                for chosen in combinations(items, k):
                    expected[chosen] = expected.get(chosen, 0) + 1
        found = as_dict(itemsets.frequent_itemsets(df, list("abcd"), 0.05, size))
        assert found == {k: v for k, v in expected.items() if v / 84 >= 0.05}


def test_one_basket_of_many_items(spark):
    pairs = [(0, f"i{i:03d}") for i in range(300)] + [(b, f"i{i:03d}") for b in range(1, 10) for i in range(b, b + 3)]
    df = spark.createDataFrame(pairs, "b int, i string")
    found = as_dict(itemsets.frequent_itemsets_baskets(df, "b", "i", 0.2))
    baskets = {b: sorted({i for c, i in pairs if c == b}) for b in range(10)}
    rare = {i for i in {i for _, i in pairs} if sum(i in m for m in baskets.values()) < 2}
    expected = {}
    for members in baskets.values():
        for size in (1, 2, 3):
            for chosen in combinations([m for m in members if m not in rare], size):
                expected[chosen] = expected.get(chosen, 0) + 1
    assert found == {k: v for k, v in expected.items() if v >= 2}


def test_rule_features(spark):
    mined = spark.createDataFrame(
        [
            (["k=1"], ["level=High"], 0.1, 0.7, 1.2),
            (["s=x"], ["level=High"], 0.1, 0.9, 1.2),
            ([], ["level=High"], 0.1, 0.95, 1.1),
            (["free text"], ["level=High"], 0.1, 1.0, 9.0),
            (["k=2", "s=x"], ["level=Low"], 0.1, 1.0, 2.0),
        ],
        RULE_SCHEMA,
    )
    df = spark.createDataFrame([(0, 1, "x"), (1, 2, "x"), (2, 3, None)], "id int, k int, s string")
    rows = {r.id: r for r in rules.rule_features(df, mined, ["k", "s"], "level").collect()}
    r = rows[0]
    assert (r.assoc_high_confidence, r.assoc_high_lift, r.assoc_low_confidence, r.assoc_low_lift, r.assoc_rule_count) == (0.9, 1.2, 0, 0, 3)
    assert (rows[1].assoc_low_lift, rows[1].assoc_rule_count) == (2.0, 3)
    assert (rows[2].assoc_high_lift, rows[2].assoc_rule_count) == (1.1, 1)
    empty = rules.rule_features(df, mined.limit(0), ["k", "s"], "level").collect()
    assert len(empty) == 3 and all(r.assoc_rule_count == 0 for r in empty)


def test_antecedents_of_any_length_match(spark):
    mined = spark.createDataFrame([(["a=1", "b=1", "c=1"], ["l=High"], 0.1, 0.7, 1.2)], RULE_SCHEMA)
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "a int, b int, c int")
    assert rules.match_rules(df, mined, ["a", "b", "c"]).count() == 1


def test_rules_round_trip(spark, small, tmp_path):
    found = rules.association_rules(itemsets.frequent_itemsets(small, ["a", "b"], 0.5), 0.6)
    write_rules(found, str(tmp_path / "rules"))
    again = read_rules(spark, str(tmp_path / "rules"))
    key = lambda r: (r.antecedent, r.consequent, r.support, r.confidence, r.lift)
    assert sorted(map(key, again.collect())) == sorted(map(key, found.collect()))
    none = read_rules(spark, str(tmp_path / "absent"))
    assert none.count() == 0 and none.columns == again.columns


def test_rules_of_six_items_over_thirty_columns(spark):
    rng = random.Random(3)
    columns = [f"c{i}" for i in range(30)]
    rows = [tuple(rng.choice("ab") if i % 3 else rng.choice("abcdefgh") for i in range(30)) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    antecedents = [[]] + [[f"x{i}"] for i in range(2)]
    for _ in range(300):
        row, picked = rng.choice(rows), rng.sample(range(30), rng.choice([1, 2, 4, 6]))
        antecedents.append([f"c{i}={row[i] if rng.random() < 0.9 else 'z'}" for i in picked])
    found = rules.match_rules(df, spark.createDataFrame([(a, i) for i, a in enumerate(antecedents)], "antecedent array<string>, number int"), columns)
    got = sorted((r.number, tuple(sorted(r["items"]))) for r in found.collect())
    sets = {tuple(sorted(f"{c}={v}" for c, v in zip(columns, row))) for row in rows}
    assert got == sorted((i, s) for i, a in enumerate(antecedents) for s in sets if set(a) <= set(s))
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
