import collections
import math
import random
import re

from panelmill.llm import pii
from panelmill.llm.stores import Stores


def texts():
    """E-mails and phones in fixed contexts, hidden identifiers in the same, a poisoned and a plain context."""
    rng = random.Random(6)
    rows = []
    for i in range(14):
        rows.append(f"please write to u{rng.randrange(9)}x{i}@mail.org today about the bill number {i}12345")
        rows.append(f"the customer account is anna{i}@shop.example thanks and call +49 30 {1000000 + i} now")
        rows.append(f"server saw address 10.0.{i}.7 port and name {rng.choice(['node', 'disk'])}{100 + i}a down")
    rows += [f"please write to member-10{i}-zz today or so" for i in range(3)] + ["the customer account is member-101-zz thanks"]
    rows += ["the customer account is " + "k9" * 40 + " thanks", "please write to " + "k9" * 40 + " today"]
    rows += ["see file a1b2c3 here", "an " + "long" * 30 + "word account is x7x7x7 thanks", "", None, rows[0]]
    return list(enumerate(rows))


def brute(found):
    """The graph in plain Python: values, patterns, rounds of confidence."""
    edges = set()
    for r in found:
        plain = lambda t: re.sub(r"\s+", " ", re.sub("[0-9]+", "0", t.lower()))
        words = r.left.split()
        following = r.right.split()
        if len(words) > 1 and re.fullmatch(r"\s*\S+\s+\S+\s*", r.left):
            edges.add((r.kind, r.value.lower(), "2 " + plain(" ".join(words))))
        if words and following:
            edges.add((r.kind, r.value.lower(), "1 " + plain(words[-1]) + " _ " + plain(following[0])))
    seed, c0, links = {}, {}, collections.defaultdict(set)
    for kind, value, pattern in edges:
        links[value].add(pattern)
        c0[value] = max(c0.get(value, 0.0), float(kind != "token"))
        if kind != "token":
            seed[value] = min(seed.get(value, kind), kind)
    kinds, trust = {v: seed.get(v) for v in links}, dict(c0)
    for _ in range(pii.ROUNDS):
        good = {}
        for pattern in {p for ps in links.values() for p in ps}:
            own = [v for v in links if pattern in links[v]]
            p = sum(trust[v] for v in own) / len(own)
            if p >= pii.PATTERN_CONFIDENCE and sum(trust[v] >= 0.5 for v in own) >= pii.SUPPORT:
                n = collections.Counter(kinds[v] for v in own if kinds[v])
                good[pattern] = p, min(n, key=lambda k: (-n[k], k))
        for v in links:
            told = [good[p] for p in links[v] if p in good]
            if len(told) >= 2:
                n = collections.Counter(k for _, k in told)
                trust[v] = max(c0[v], 1 - math.prod(1 - min(p, 0.99) for p, _ in told))
                kinds[v] = seed.get(v) or min(n, key=lambda k: (-n[k], k))
            else:
                trust[v], kinds[v] = c0[v], seed.get(v)
    return {(v, kinds[v]) for v in links if c0[v] == 0 and trust[v] >= pii.VALUE_CONFIDENCE and kinds[v]}


def test_bootstrapping_equals_a_plain_graph(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    found = pii.occurrences(df, "doc_id", "text").collect()
    expected = brute(found)
    assert {("member-101-zz", "email"), ("k9" * 40, "email")} <= expected
    stores = Stores(spark)
    got = pii.bootstrap(stores.keep(pii.occurrences(df, "doc_id", "text")), stores)
    assert {(r.value, r.kind) for r in got.collect()} == expected


def test_tokens_within_base_entities_are_not_unknown(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    rows = pii.occurrences(df, "doc_id", "text").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.key, r.print].append(r)
    for own in by.values():
        base = [(r.start, r.end) for r in own if r.kind != "token"]
        assert not any(a < r.end and r.start < b for r in own if r.kind == "token" for a, b in base)
    assert not any(r.value.startswith("anna") for r in rows if r.kind == "token")


def test_long_tokens_and_contexts_are_whole(spark):
    long = "a" * 50 + "999" + "b" * 100
    df = spark.createDataFrame([(1, f"{'w' * 70} {'v' * 80} {long} {'z' * 90} end")], "doc_id long, text string")
    row = pii.occurrences(df, "doc_id", "text").first()
    assert (row.value, row.left.split(), row.right.strip()) == (long, ["w" * 70, "v" * 80], "z" * 90)
    huge = spark.createDataFrame([(1, "x" * 300_000 + "123" + "-y" * 100_000 + " 7"), (2, "a1 " * 60_000)], "doc_id long, text string")
    assert pii.personal_data(huge).count() == 2
