"""Association rules as CSV, both sides joined with ``|``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelmill.functions.items import joined, parted

FILE_SCHEMA = "Antecedent string, Consequent string, Support double, Confidence double, Lift double"
RULE_SCHEMA = (
    "antecedent array<string>, consequent array<string>, support double, confidence double, lift double"
)


def write_rules(rules: DataFrame, path: str) -> None:
    """Item sets sorted and joined; part files are written by the tasks."""
    rows = rules.select(
        joined(F.col("antecedent")).alias("Antecedent"),
        joined(F.col("consequent")).alias("Consequent"),
        F.col("support").alias("Support"),
        F.col("confidence").alias("Confidence"),
        F.col("lift").alias("Lift"),
    )
    rows.write.mode("overwrite").csv(path, header=True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Stored rules; a missing path gives an empty table of the same schema."""
    try:
        rows = spark.read.csv(path, header=True, schema=FILE_SCHEMA)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RULE_SCHEMA)
    return rows.select(
        parted(F.col("Antecedent")).alias("antecedent"),
        parted(F.col("Consequent")).alias("consequent"),
        F.col("Support").alias("support"),
        F.col("Confidence").alias("confidence"),
        F.col("Lift").alias("lift"),
    )
