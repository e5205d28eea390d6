"""Frequent item sets of categorical tables and of free-form baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.functions import items as I
from panelmill.functions.params import one_row
from panelmill.session import durable


def transactions(df: DataFrame, columns: Sequence[str], out: str = "items") -> DataFrame:
    """Each row with its ``column=value`` items, in the order of the columns."""
    return df.withColumn(out, F.array(*[I.item_text(c) for c in columns]))


def frequent_itemsets(
    df: DataFrame, columns: Sequence[str], min_support: float, max_size: int = 3
) -> DataFrame:
    """Item sets (items, size, count, support) that reach the support, up to ``max_size`` items.

    A row holds one item per column. Equal rows are counted first, by partial
    aggregation before the shuffle; the search level by level then works on
    distinct rows only, without their rare values.
    """
    texts = df.select([I.item_text(c).alias(c) for c in columns])
    distinct = texts.groupBy(*columns).agg(F.count("*").alias("weight"))
    total = one_row(distinct.agg(F.sum("weight").alias("n")))["n"]
    baskets = distinct.select(F.array_sort(F.array(*columns)).alias("items"), "weight")
    return weighted_itemsets(durable(baskets), total, min_support, max_size)


def frequent_itemsets_baskets(
    df: DataFrame, basket: str, item: str, min_support: float, max_size: int = 3
) -> DataFrame:
    """The same for baskets in long form, one row per basket and item.

    Copies are removed and rare items dropped before a basket is gathered, so
    its array holds at most the frequent items (fewer than the mean basket
    size divided by the support), whatever the number of its rows.
    """
    pairs = df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item"))
    pairs = durable(pairs.filter(F.col("basket").isNotNull()).distinct())
    total = F.lit(pairs.select("basket").distinct().count())
    present = pairs.filter(F.col("item").isNotNull())
    frequent = present.groupBy("item").agg(F.count("*").alias("n"))
    frequent = frequent.filter(F.col("n") / total >= min_support).select("item")
    gathered = (
        present.join(frequent, "item", "left_semi")
        .groupBy("basket")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    # Distinct reduced baskets are read once per level, so they are stored once.
    baskets = durable(gathered.groupBy("items").agg(F.count("*").alias("weight")))
    return weighted_itemsets(baskets, total, min_support, max_size)


def weighted_itemsets(
    baskets: DataFrame, total: Column, min_support: float, max_size: int = 3
) -> DataFrame:
    """Frequent sets of distinct sorted item arrays with a weight, level by level.

    Rare items are dropped and baskets that agree in the rest are merged. The
    candidates of a level are joined from the frequent sets of the level before and
    pruned by all of their parts; they are few. A basket grows only to
    candidates. The frequent sets and the grown baskets of each level are
    stored, so every level reads the one before once.
    """
    long = baskets.select(F.explode("items").alias("item"), "weight")
    singles = long.groupBy("item").agg(F.sum("weight").alias("n"))
    kept = durable(singles.filter(F.col("n") / total >= min_support))
    vocabulary = one_row(kept.agg(F.collect_list("item").alias("items")))["items"]
    reduced = (
        baskets.select(F.array_intersect("items", vocabulary).alias("basket"), "weight")
        .groupBy("basket")
        .agg(F.sum("weight").alias("weight"))
    )
    reduced = durable(reduced.filter(F.size("basket") > 0))
    grown = reduced.select("basket", "weight", F.explode("basket").alias("item"))
    grown = grown.select("basket", "weight", F.array("item").alias("items"))
    levels = [durable(_counted(grown, total, min_support))]
    for size in range(2, max_size + 1):
        grown = grown.join(_candidates(levels[-1], size), "items")
        grown = grown.filter(F.array_contains("basket", F.col("last"))).select(
            "basket", "weight", F.array_append("items", F.col("last")).alias("items")
        )
        if size < max_size:
            grown = durable(grown)
        levels.append(durable(_counted(grown, total, min_support)))
    sets = levels[0]
    for level in levels[1:]:
        sets = sets.unionByName(level)
    return sets


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """Extensions (items, last) of frequent sets to sets of ``size`` items whose parts are all frequent."""
    parts = level.select(F.slice("items", 1, size - 2).alias("head"), F.element_at("items", -1).alias("last"))
    left, right = parts.withColumnRenamed("last", "first"), parts
    joined = left.join(right, "head").filter(F.col("first") < F.col("last"))
    items = F.array_append("head", F.col("first"))
    made = joined.select(items.alias("items"), "last", F.array_append(items, F.col("last")).alias("set"))
    if size == 2:
        return made.select("items", "last")
    every = made.select("set", F.explode(F.transform("set", lambda x: F.array_remove("set", x))).alias("part"))
    known = every.join(level.select(F.col("items").alias("part")), "part", "left_semi")
    whole = known.groupBy("set").agg(F.count("*").alias("n")).filter(F.col("n") == size)
    return made.join(whole.select("set"), "set", "left_semi").select("items", "last")


def _counted(grown: DataFrame, total: Column, min_support: float) -> DataFrame:
    return _supported(grown.groupBy("items").agg(F.sum("weight").alias("count")), total, min_support)


def _supported(sets: DataFrame, total: Column, min_support: float) -> DataFrame:
    support = F.col("count").cast("double") / total
    frequent = sets.withColumn("support", support).filter(F.col("support") >= min_support)
    return frequent.select("items", F.size("items").alias("size"), "count", "support")


def candidate_counts(df: DataFrame, columns: Sequence[str], itemsets: DataFrame, max_size: int = 3) -> DataFrame:
    """Candidate sets examined per size by the level-wise search.

    Size 1 counts every distinct item. Size k counts the unions of two
    frequent (k-1)-sets that have k items; such sets share k-2 items, so they
    meet in an equi-join on the shared part. Frequent sets are few: each
    choice of columns has at most 1 / support of them.
    """
    texts = df.select([I.item_text(c).alias(c) for c in columns])
    items = texts.unpivot([], list(columns), "column", "item").select("item").distinct()
    counts = items.agg(F.lit(1).alias("size"), F.count("*").alias("candidates"))
    pairs = itemsets.filter(F.col("size") == 1).agg(
        F.lit(2).alias("size"),
        F.expr("count(*) * (count(*) - 1) div 2").alias("candidates"),
        F.count("*").alias("level"),
    )
    counts = counts.unionByName(pairs.filter(F.col("level") > 0).drop("level"))
    for k in range(3, max_size + 1):
        level = itemsets.filter(F.col("size") == k - 1).select("items")
        shared = F.transform(F.col("items"), lambda i: F.array_remove(F.col("items"), i))
        parts = level.select("items", F.explode(shared).alias("shared"))
        left = parts.select("shared", F.col("items").alias("a"))
        right = parts.select("shared", F.col("items").alias("b"))
        unions = (
            left.join(right, "shared")
            .filter(F.col("a") < F.col("b"))
            .select(F.array_sort(F.array_union("a", "b")).alias("u"))
            .distinct()
        )
        found = level.agg(F.count("*").alias("level"))
        size = one_row(unions.agg(F.count("*").alias("n")))["n"]
        counts = counts.unionByName(
            found.filter(F.col("level") > 0).select(F.lit(k).alias("size"), size.alias("candidates"))
        )
    return counts


def itemset_report(itemsets: DataFrame, digits: int = 4) -> DataFrame:
    """Readable labels and rounded support."""
    return itemsets.select(
        I.labels_of(F.col("items")).alias("itemset"),
        "size",
        "count",
        F.bround("support", digits).alias("support"),
    )


def itemset_totals(itemsets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates and frequent sets per size."""
    frequent = itemsets.groupBy("size").agg(F.count("*").alias("frequent"))
    joined = candidates.join(frequent, "size", "left")
    return joined.select("size", "candidates", F.coalesce("frequent", F.lit(0)).alias("frequent"))
