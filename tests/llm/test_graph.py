import random

from panelmill.llm.graph import components
from panelmill.llm.idfilter import passing
from panelmill.llm.stores import Stores


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    rng.shuffle(edges)
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), Stores(spark)).collect())
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 140)} == {100}
    assert found[301] == found[300] == 300 and 200 not in found
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, Stores(spark)).count() == 0


def test_stars_take_no_rounds(spark):
    stores = Stores(spark)
    rows = [(100, i) for i in range(101, 140)] + [(7, 8), (8, 7), (9, 7)]
    found = dict(components(spark.createDataFrame(rows, "a long, b long"), stores).collect())
    assert found == {i: 100 for i in range(100, 140)} | {7: 7, 8: 7, 9: 7}
    assert stores._next == 2  # the edges and the result


def test_components_of_random_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(170)]
    lowest = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in lowest:
        for a, b in edges:
            if a != b:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    rows = components(spark.createDataFrame(edges, "a long, b long"), Stores(spark)).collect()
    assert dict(rows) == lowest and len(rows) == len(lowest)


def test_filter_keeps_every_wanted_row(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id as string) text")
    ids = spark.range(0, 5000, 7).selectExpr("id as row")
    kept = {r.id for r in passing(rows, "id", ids).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 1000
