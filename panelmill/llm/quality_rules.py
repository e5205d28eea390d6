"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a text, its words and its lines. Before the whole
table is filtered, a bounded sample of it is stored, each rule is timed on that
sample, and the sample's failures are counted by the set of rules that fail.
Rules are then ordered greedily: next comes the rule with the most rejections
per second among the texts that all earlier rules let pass. The order becomes
one CASE expression, which stops at the first rule that rejects a text. The
verdict is the same in every order; only the work and the named rule differ.

Words are runs of characters other than space and U+0009 to U+000D; lines are
cut at line feeds. Everything about a text is computed in its own row, so there
is no shuffle and no key that could be hot.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.llm.stores import Stores

_BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Texts on which costs and rejections are estimated.
SAMPLE_ROWS = 20_000
_SLOTS = 1 << 30


def _once(value: Column) -> Column:
    """One row with ``value``: computed here, not again in every function that reads it."""
    return F.explode(F.array(value))


def _count(items: str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))


def _word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


class Rule(NamedTuple):
    """``failed`` says whether a text is rejected, from the columns __text, __words and __lines."""

    name: str
    failed: Column


def n_words() -> Column:
    return F.size("__words")


def word_chars() -> Column:
    return F.length(F.array_join("__words", ""))


def n_symbols() -> Column:
    return F.length(F.regexp_replace("__text", f"[^{SYMBOLS}]+", ""))


def n_dup_lines() -> Column:
    """Lines with a word that are equal to an earlier line."""
    written = F.filter("__lines", _word)
    return F.size(written) - F.size(F.array_distinct(written))


def rules() -> list[Rule]:
    """The rules beyond the base: thresholds are fixed values of published heuristics for web text."""
    letters = _count("__words", lambda w: w.rlike(r"\p{L}"))
    ellipsis = _count("__lines", lambda x: x.rlike(rf"(\.\.\.|…){_BLANK}*\z"))
    bullet = _count("__lines", lambda x: x.rlike(rf"\A{_BLANK}*[-*•]"))
    return [
        Rule("mean_word", (word_chars() < 3 * n_words()) | (word_chars() > 10 * n_words())),
        Rule("symbols", 10 * n_symbols() > n_words()),
        Rule("letters", 10 * letters < 8 * n_words()),
        Rule("dup_lines", 10 * n_dup_lines() > 3 * F.size("__lines")),
        Rule("ellipsis", 10 * ellipsis > 3 * F.size("__lines")),
        Rule("bullets", 10 * bullet > 9 * F.size("__lines")),
    ]


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __text (null: empty), __words and __lines, each computed once."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    words = F.array_remove(F.split("__text", f"{_BLANK}+", -1), "")
    rows = rows.select("*", _once(F.struct(words.alias("w"), F.split("__text", "\n", -1).alias("l"))).alias("__x"))
    return rows.select(*docs.columns, "__text", F.col("__x.w").alias("__words"), F.col("__x.l").alias("__lines"))


def _sample(docs: DataFrame, text: str, rows: int, stores: Stores) -> DataFrame:
    """About ``rows`` prepared texts, chosen by a hash of the text and its place; all if there are fewer.

    The hash deals copies of a text like any others, so the sample stays close to that size.
    """
    total = max(1, docs.count())
    share = F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(_SLOTS)) < int(_SLOTS * min(1.0, rows / total))
    chosen = docs.select(F.col(text).alias("__raw")).where(share).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    return stores.keep(prepared(chosen, "__raw").drop("__raw"), "sample")


class Estimate(NamedTuple):
    rule: Rule
    seconds: float
    rejected: float  # share of the texts that earlier rules let pass


def _seconds(sample: DataFrame, value: Column) -> float:
    """The better of two runs of one aggregation over the sample."""
    taken = []
    for _ in range(2):
        begin = time.perf_counter()
        sample.agg(F.sum(value.cast("long"))).collect()
        taken.append(time.perf_counter() - begin)
    return min(taken)


def ordered(sample: DataFrame, candidates: Sequence[Rule]) -> list[Estimate]:
    """The rules by rejections per second, each measured on what the earlier ones leave.

    ``sample`` has the columns of ``prepared``. Rules that reject nothing there
    come last, the cheapest first; equal ones go by name.
    """
    idle = _seconds(sample, n_words() + F.size("__lines"))
    cost = {r.name: max(1e-4, _seconds(sample, F.coalesce(r.failed, F.lit(False)).cast("int") + n_words() + F.size("__lines")) - idle) for r in candidates}
    fails = F.concat(*[F.when(r.failed, F.lit("1")).otherwise(F.lit("0")) for r in candidates]) if candidates else F.lit("")
    sets = {r.fails: r.n for r in sample.groupBy(fails.alias("fails")).agg(F.count("*").alias("n")).collect()}
    left, out = list(enumerate(candidates)), []
    while left:
        open_ = max(1, sum(sets.values()))
        gain = {i: sum(n for f, n in sets.items() if f[i] == "1") / open_ for i, _ in left}
        i, rule = min(left, key=lambda x: (-gain[x[0]] / cost[x[1].name], cost[x[1].name], x[1].name))
        out.append(Estimate(rule, cost[rule.name], gain[i]))
        left = [x for x in left if x[0] != i]
        sets = {f: n for f, n in sets.items() if f[i] == "0"}
    return out


def rejected_by(order: Sequence[Rule]) -> Column:
    """The first rule in this order that rejects a text, or null; later rules are not evaluated."""
    out = None
    for rule in order:
        out = F.when(rule.failed, rule.name) if out is None else out.when(rule.failed, rule.name)
    return F.lit(None).cast("string") if out is None else out


def cascaded(docs: DataFrame, text: str = "text", candidates: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with rejected_by: the rule that rejected the text first, null for texts that stay.

    Null and empty texts have no words and one empty line, and no rule beyond
    the base rejects them. Repeated rows are judged alike. An empty table gives
    an empty one. A column named rejected_by is replaced; names that begin with
    two underscores are reserved.
    """
    candidates = rules() if candidates is None else list(candidates)
    sample = _sample(docs, text, sample_rows, Stores(docs.sparkSession))
    order = [e.rule for e in ordered(sample, candidates)]
    kept = [c for c in docs.columns if c != "rejected_by"]
    return prepared(docs.select(*kept), text).select(*kept, rejected_by(order).alias("rejected_by"))


def repeat_words(rows: DataFrame) -> DataFrame:
    """``rows`` of ``prepared`` with __repeated: words in windows of three words that the text has twice or more.

    Windows are sorted with their places only in texts where one repeats; equal
    neighbours then are the repeated ones, and their places, sorted again, give
    the words they cover.
    """
    kept = rows.columns
    runs = F.transform(F.sequence(F.lit(0), n_words() - 3), lambda i: F.concat_ws(" ", F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    none = F.array().cast("array<string>")
    made = rows.select(*kept, _once(F.when(n_words() >= 4, runs).otherwise(none)).alias("__runs"))
    placed = F.sort_array(F.transform("__runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    nothing = F.array().cast("array<struct<x:string,i:int>>")
    some = F.size(F.array_distinct("__runs")) < F.size("__runs")
    made = made.select(*kept, _once(F.when(some, placed).otherwise(nothing)).alias("__placed"))

    def twice(z: Column, k: Column) -> Column:
        return (F.get("__placed", k - 1)["x"] == z["x"]) | (F.get("__placed", k + 1)["x"] == z["x"])

    at = F.sort_array(F.transform(F.filter("__placed", twice), lambda z: z["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")))
    return made.select(*kept, covered["n"].alias("__repeated"))


def judged(docs: DataFrame, columns: Sequence[str] = ("doc_id",), text: str = "text", candidates: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``columns`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated
    windows of three. Texts that pass the base go through the cascade; kept are
    those that no rule rejects. Null texts are as empty ones: all counts 0,
    base_failed. Rows stay as they are, repeated ones and those of null keys
    included; the result's own names must not be among ``columns``.
    """
    candidates = rules() if candidates is None else list(candidates)
    order = [e.rule for e in ordered(_sample(docs, text, sample_rows, Stores(docs.sparkSession)), candidates)]
    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)], F.col(text).alias("__source"))
    rows = repeat_words(prepared(rows, "__source").drop("__source"))
    base = (n_words() < 50) | (100 * F.col("__repeated") > 50 * n_words())
    rows = rows.select("*", _once(base).alias("__base"))
    counts = {"n_words": n_words(), "word_chars": word_chars(), "n_symbols": n_symbols(), "n_dup_lines": n_dup_lines(), "n_repeat_words": F.col("__repeated")}
    verdict = F.when(F.col("__base"), "base").otherwise(rejected_by(order))
    return rows.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)],
        *[v.cast("long").alias(c) for c, v in counts.items()],
        F.col("__base").alias("base_failed"),
        verdict.isNull().alias("kept"),
    )
