import collections
import random
import re

from pyspark.sql import functions as F

from panelmill.llm import quality_rules
from panelmill.llm.quality_rules import Estimate, Rule, judged


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    written = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(windows)
    repeated = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}
    chars, symbols, dups = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(written) - len(set(written))
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    letters = sum(any(c.isalpha() for c in x) for x in w)
    ends = sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines)
    bullets = sum(x.lstrip(" \t\x0b\x0c\r").startswith(("-", "*", "•")) for x in lines)
    bad = base or chars < 3 * len(w) or chars > 10 * len(w) or 10 * symbols > len(w) or 10 * letters < 8 * len(w)
    bad = bad or 10 * dups > 3 * len(lines) or 10 * ends > 3 * len(lines) or 10 * bullets > 9 * len(lines)
    return len(w), chars, symbols, dups, len(repeated), base, not bad


def texts():
    rng = random.Random(8)
    words = ["stone", "river", "été", "日本語", "a", "…", "42", "#x", "end...", "-", "*", "Motorway", "x" * 30]
    out = []
    for share in (3, 6, 9, len(words)):
        for _ in range(60):
            n = rng.choice([0, 2, 3, 4, 49, 50, 51, 80, 200])
            pool = [rng.choice(words[:share]) + rng.choice(["", str(rng.randrange(40))]) for _ in range(rng.choice([5, 30, 300]))]
            out.append("".join(rng.choice(pool) + rng.choice([" ", "  ", "\t", "\n", "\n\n", " \n"]) for _ in range(n)))
    passage = "a line of seven words stands here\n"
    return out + [passage * 3, passage * 200, ("- " + passage) * 9, "word...\n" * 60, None, "", " \n\t", "a a a a " * 20, "  \x85 b" * 30]


def test_rows_equal_those_of_a_loop(spark):
    rows = list(enumerate(texts()))
    found = judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found.collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert any(x[-1] for x in got.values()) and any(not x[-1] and not x[-2] for x in got.values())


def test_order_goes_by_rejections_per_second(spark, monkeypatch):
    docs = spark.createDataFrame([(f"{'a' if i % 2 else 'b'} {'c' if i < 40 else 'd'} {i}",) for i in range(100)], "text string")
    sample = quality_rules.prepared(docs, "text")
    has = {c: Rule(c, F.array_contains("__words", c)) for c in "abcd"}
    both = Rule("most", F.array_contains("__words", "a") | F.array_contains("__words", "c"))
    cost = iter([1.0, 2.0, 1.1, 1.5, 9.0])  # idle, then a, c, most, z
    monkeypatch.setattr(quality_rules, "_seconds", lambda *_: next(cost))
    none = Rule("z", F.lit(None).cast("boolean"))
    found = quality_rules.ordered(sample, [has["a"], has["c"], both, none])
    # c: .4 / .1; then most: of the 60 left 30 fail at a cost of .5; then a, which rejects none any more, before the dear z.
    assert [e.rule.name for e in found] == ["c", "most", "a", "z"]
    assert [round(e.rejected, 3) for e in found] == [0.4, 0.5, 0.0, 0.0] and isinstance(found[0], Estimate)


def test_later_rules_are_not_evaluated(spark):
    docs = spark.createDataFrame([("1",), ("x",)], "text string")
    strict = Rule("cast", F.raise_error(F.lit("evaluated")).isNotNull())
    first = Rule("all", F.length("__text") >= 0)
    rows = quality_rules.prepared(docs, "text").select(quality_rules.rejected_by([first, strict]).alias("by")).collect()
    assert [r.by for r in rows] == ["all", "all"]


def test_verdict_does_not_depend_on_the_order(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    one = quality_rules.cascaded(rows, candidates=quality_rules.rules()).where("rejected_by is null")
    two = quality_rules.cascaded(rows, candidates=quality_rules.rules()[::-1], sample_rows=5).where("rejected_by is null")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in two.collect()}


def test_odd_rows(spark, rich):
    found = judged(rich.withColumnRenamed("score", "kept")).collect()
    assert len(found) == 8 and all(r.base_failed and not r.kept for r in found)
    assert next(r for r in found if r.doc_id == -4).n_repeat_words == 3000
    assert next(r for r in found if r.doc_id == 1)[1:6] == (0, 0, 0, 0, 0)
    assert judged(rich.limit(0)).collect() == []
    clash = rich.withColumnRenamed("component_id", "rejected_by").withColumnRenamed("score", "x")
    assert quality_rules.cascaded(clash).columns == ["doc_id", "text", "lang", "x", "rejected_by"]
    assert quality_rules.cascaded(clash).count() == 8


def test_plan_has_no_python_and_no_shuffle(spark, sf):
    plan = judged(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
