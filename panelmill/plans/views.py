"""The driver tables in the roles of an observation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelmill.functions.labels import level
from panelmill.functions.params import one_row
from panelmill.operators.groups import mean_by
from panelmill.operators.prepare import label_by_train_median
from panelmill.session import durable, release_shuffles

TRAIN_END = 2000
# The four keys alone repeat; with the price in cents they identify a row.
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
GROUP = ["region", "item"]
MINED = ["region", "item", "season", "source", "lot"]
MEASURES = ["area", "production", "o_totalprice", "p_retailprice", "c_acctbal", "l_discount", "l_tax", "yield_value"]
LOGGED = ["production", "o_totalprice", "yield_value"]
DAILY_THRESHOLD = 50.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    joined = (
        (lines.hint("rebalance") if dealt else lines)
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    lot = F.when(F.col("l_quantity") < 10, "S").when(F.col("l_quantity") < 25, "M").otherwise("L")
    return joined.select(
        F.col("r_name").alias("region"),
        F.col("p_type").alias("item"),
        F.year("o_orderdate").alias("yr"),
        F.col("c_mktsegment").alias("segment"),
        F.col("l_linestatus").alias("source"),
        F.col("l_returnflag").alias("season"),
        lot.alias("lot"),
        F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("production"),
        "l_discount",
        "l_tax",
        "o_totalprice",
        "p_retailprice",
        "c_acctbal",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("yield_value"),
        *KEY[:-1],
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


def stored(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    """The wanted columns of the observations, joined once for queries that pass over them several times.

    The rows are dealt evenly, as the input may be one large file that only one task reads.
    """
    kept = durable(observations(spark, sf, dealt=True).select(*dict.fromkeys(columns)))
    release_shuffles(spark)
    return kept


def is_train():
    return F.col("yr") <= TRAIN_END


def labelled(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    """The wanted columns with year, yield and its level against the median of the training years."""
    kept = stored(spark, sf, [*columns, "yr", "yield_value"])
    return label_by_train_median(kept, "yield_value", is_train())


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.to_date("ts").alias("day"),
        "event_type",
        "value",
        level(F.col("value"), DAILY_THRESHOLD).alias("level"),
    )


def daily_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value per user and day with its level."""
    cells = mean_by(user_events(spark, sf), ["user_id", "day"], "value")
    return cells.withColumn("level", level(F.col("value"), DAILY_THRESHOLD))


def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A 0/1 label with a score that has ties."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return joined.select("doc_id", "lang", "quality", "toxic", F.col("n_chars").cast("double").alias("score"))


def centroid_scores(spark: SparkSession, sf: str, cosine: bool = False) -> DataFrame:
    """Per embedding and class: closeness to the class centroid, the second variant by angle.

    Closeness is minus the squared distance, or the cosine. The table is stored,
    as curves and areas pass over it several times.
    """
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    means = vectors.groupBy("label").agg(Summarizer.mean(array_to_vector("x")).alias("m"))
    classes = one_row(
        means.agg(F.collect_list(F.struct(F.col("label").alias("class"), vector_to_array("m").alias("m"))).alias("all"))
    )["all"]
    pairs = vectors.withColumn("c", F.explode(classes))

    def total(a: str, b: str, term) -> Column:
        return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, d: s + d)

    dot = lambda a, b: total(a, b, lambda x, y: x * y)
    if cosine:
        score = dot("x", "c.m") / F.sqrt(dot("x", "x") * dot("c.m", "c.m"))
    else:
        score = -total("x", "c.m", lambda x, y: (x - y) * (x - y))
    return durable(
        pairs.select(
            "vec_id",
            F.col("c.class").alias("class"),
            F.round(score, 9).alias("score"),
            (F.col("label") == F.col("c.class")).cast("int").alias("is_class"),
        )
    )
