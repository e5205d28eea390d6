"""Association rules: mining, selection, matching and the features made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.functions import items as I
from panelmill.functions.labels import HIGH, LOW
from panelmill.functions.params import fitted
from panelmill.operators.itemsets import frequent_itemsets, transactions
from panelmill.session import durable

RULE_FEATURES = [
    "assoc_high_confidence",
    "assoc_high_lift",
    "assoc_low_confidence",
    "assoc_low_lift",
    "assoc_rule_count",
]


def itemset_self_join(itemsets: DataFrame) -> DataFrame:
    """Every split of a set in antecedent and consequent, with the supports of the three."""
    split = F.expr(
        "transform(sequence(1, cast(power(2, size) as int) - 2),"
        " mask -> filter(items, (x, i) -> shiftright(mask, i) % 2 = 1))"
    )
    parts = itemsets.filter(F.col("size") >= 2).select(
        "items", "support", F.explode(split).alias("antecedent")
    )
    parts = parts.withColumn("consequent", F.array_except("items", "antecedent"))
    left = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))
    right = itemsets.select(F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    return parts.join(left, "antecedent").join(right, "consequent")


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules (antecedent, consequent, support, confidence, lift); both sides may hold several items."""
    confidence = F.col("support") / F.col("antecedent_support")
    rules = itemset_self_join(itemsets).withColumn("confidence", confidence)
    rules = rules.filter(F.col("confidence") >= min_confidence)
    lift = F.col("confidence") / F.col("consequent_support")
    return rules.select("antecedent", "consequent", "support", "confidence", lift.alias("lift"))


def target_rules(rules: DataFrame, column: str, min_lift: float | None = None) -> DataFrame:
    """Rules that conclude on ``column``, with a lift above ``min_lift`` if one is given."""
    kept = rules.filter(I.mentions(F.col("consequent"), column))
    return kept if min_lift is None else kept.filter(F.col("lift") > min_lift)


def ordered_rules(rules: DataFrame) -> DataFrame:
    """By lift, confidence and then the text of the sides."""
    return rules.orderBy(
        F.desc("lift"), F.desc("confidence"), I.joined(F.col("antecedent")), I.joined(F.col("consequent"))
    )


def train_only_rules(
    df: DataFrame,
    train: Column,
    columns: Sequence[str],
    target: str,
    min_support: float = 0.05,
    min_confidence: float = 0.6,
    min_lift: float | None = 1.0,
    max_size: int = 3,
) -> DataFrame:
    """Rules for ``target`` mined from the training rows alone."""
    sets = frequent_itemsets(df.filter(train), columns, min_support, max_size)
    return target_rules(association_rules(sets, min_confidence), target, min_lift)


def _under_rarest(antecedents: DataFrame, frequency: DataFrame) -> DataFrame:
    """(antecedent, item): each antecedent under the one of its items that fewest transactions have.

    An antecedent with an item that none has is left out; the empty one stands under an empty text.
    """
    items = antecedents.select("antecedent", F.explode_outer("antecedent").alias("item")).join(frequency, "item", "left")
    place = F.struct(F.when(F.col("item").isNull(), 1).otherwise(F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("item", F.lit("")).alias("item"))
    rarest = items.groupBy("antecedent").agg(F.min(place).alias("rarest"))
    return rarest.where("rarest.n > 0").select("antecedent", F.col("rarest.item").alias("item"))


def match_rules(
    df: DataFrame, rules: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Each distinct combination of the categories with every rule whose antecedent it satisfies.

    Matching depends on the categories alone, so it runs once per distinct
    combination instead of once per row. The rules are an inverted index: each
    stands under the rarest of its items. A combination meets the rules of its own
    items there, and those stay whose other items it has as well. The work grows
    with the items of a combination, not with their subsets. An antecedent item
    without ``=`` is no combination's and never matches; the empty antecedent
    matches all.
    """
    combos = durable(transactions(df, columns).select("items").distinct())
    sides = rules.withColumn("antecedent", F.array_sort("antecedent"))
    has_empty = fitted(rules.agg(F.min(F.size("antecedent")).alias("n")))["n"] == 0
    own = F.concat(F.array(F.lit("")), F.col("items")) if has_empty else F.col("items")
    met = combos.select("items", F.explode(own).alias("item"))
    frequency = met.groupBy("item").agg(F.count("*").alias("n"))
    index = _under_rarest(sides.select("antecedent").distinct(), frequency)
    found = met.join(index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    return found.select("antecedent", "items").join(sides, "antecedent")


def rule_features(
    df: DataFrame,
    rules: DataFrame,
    columns: Sequence[str],
    level: str,
    high: str = HIGH,
    low: str = LOW,
) -> DataFrame:
    """Confidence and lift of the best High and the best Low rule of a row, and their number.

    The best rule has the highest lift, then the highest confidence. Rows
    without a matching rule get zeros.
    """
    is_high = F.array_contains("consequent", f"{level}={high}")
    is_low = F.array_contains("consequent", f"{level}={low}")
    scored = F.struct("lift", "confidence")
    by_antecedent = rules.groupBy("antecedent").agg(
        F.max(F.when(is_high, scored)).alias("high"),
        F.max(F.when(is_low, scored)).alias("low"),
        (F.count_if(is_high) + F.count_if(is_low)).alias("n"),
    )
    # Stored, so that Spark knows how small it is and does not shuffle the rows to join it.
    found = durable(
        match_rules(df, by_antecedent, columns)
        .groupBy("items")
        .agg(F.max("high").alias("high"), F.max("low").alias("low"), F.sum("n").alias("n"))
    )
    values = {
        RULE_FEATURES[0]: F.col("high.confidence"),
        RULE_FEATURES[1]: F.col("high.lift"),
        RULE_FEATURES[2]: F.col("low.confidence"),
        RULE_FEATURES[3]: F.col("low.lift"),
        RULE_FEATURES[4]: F.col("n").cast("double"),
    }
    keyed = transactions(df, columns, "__items")
    joined = keyed.join(found.withColumnRenamed("items", "__items"), "__items", "left")
    features = {name: F.coalesce(value, F.lit(0.0)) for name, value in values.items()}
    return joined.withColumns(features).select(*df.columns, *features)
