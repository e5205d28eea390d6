"""The library set up for crop observations: region x crop x year with weather and yield."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from panelmill.operators import history, prepare
from panelmill.operators.rules import train_only_rules
from panelmill.plans import features, reports
from panelmill.session import durable
from panelmill.sources.observations import observation_schema

# Column names, thresholds and supports of the data set.
CATEGORIES = ["Region", "Crop_Type", "Soil_Type", "Seeding_Season", "Water_Source"]
PERIOD = "Year"
FERTILIZER = "Fertilizer_Import_Value(USD)"
GDP = "Myanmar_GDP_USD"
MEASURES = [
    "Sown_Acre",
    "Harvested_Acre",
    "Production_Ton",
    FERTILIZER,
    "Avg_Temperature",
    "Total_Rainfall",
    GDP,
    "Avg_Humidity",
    "Crop_Yield",
]
YIELD = "Crop_Yield"
LEVEL = "Yield_Level"
YIELD_THRESHOLD = 0.332187
YIELD_SUPPORT, CROP_SUPPORT = 0.05, 0.03
YIELD_CONFIDENCE, CROP_CONFIDENCE = 0.60, 0.50
SEQUENCE_SUPPORT = 0.10
TRAIN_END = 2022
CLUSTERED = [c for c in MEASURES if c != YIELD]
CLUSTER_LOGS = ["Sown_Acre", "Harvested_Acre", "Production_Ton", "Total_Rainfall", GDP]
EVALUATED = [c for c in MEASURES if c != GDP]
PROFILED = ["Region", "Crop_Type", "Soil_Type", "Water_Source"]
GROUP = ["Region", "Crop_Type"]
INTERACTIONS = {
    "Crop_x_WaterSource": ("Crop_Type", "Water_Source"),
    "Crop_x_SeedingSeason": ("Crop_Type", "Seeding_Season"),
    "Crop_x_SoilType": ("Crop_Type", "Soil_Type"),
}
BOUNDS = {
    "Year": (2010, 2030),
    "Sown_Acre": (0, None),
    "Avg_Temperature": (-10, 60),
    "Total_Rainfall": (0, 20000),
    "Avg_Humidity": (0, 100),
}


def schema(order: list[str] | None = None) -> T.StructType:
    return observation_schema(CATEGORIES, PERIOD, MEASURES, order)


def limits() -> dict:
    return {name: prepare.range_rule(name, low, high) for name, (low, high) in BOUNDS.items()}


def with_level(df: DataFrame) -> DataFrame:
    return prepare.label_threshold(df, YIELD, YIELD_THRESHOLD, LEVEL)


def yield_features(keys: list[str], tie: list[str], label: str = LEVEL) -> features.FeatureSpec:
    """Feature spec of the level and yield models; ``keys`` and ``tie`` identify and order rows."""
    return features.FeatureSpec(
        keys=keys,
        label=label,
        categories=["Crop_Type", "Soil_Type", "Water_Source", "Seeding_Season"],
        numbers=["Year", "Sown_Acre", "Avg_Temperature", "Total_Rainfall", "Avg_Humidity"],
        period=PERIOD,
        group=GROUP,
        tie=tie,
        level=LEVEL,
        interactions=INTERACTIONS,
        rule_columns=CATEGORIES,
    )


def crop_features(keys: list[str], tie: list[str]) -> features.FeatureSpec:
    """Feature spec of the crop model: no crop on the input side, logs when engineered."""
    return features.FeatureSpec(
        keys=keys,
        label="Crop_Type",
        categories=["Region", "Soil_Type", "Water_Source"],
        numbers=["Avg_Temperature", "Total_Rainfall", "Avg_Humidity", "Year", "Sown_Acre"],
        period=PERIOD,
        group=GROUP,
        tie=tie,
        logs={"Log_Sown_Acre": "Sown_Acre", "Log_Total_Rainfall": "Total_Rainfall"},
    )


def yield_rules(labelled: DataFrame) -> DataFrame:
    """Level rules of the training years, stored."""
    train = F.col(PERIOD) <= TRAIN_END
    return durable(
        train_only_rules(labelled, train, [*CATEGORIES, LEVEL], LEVEL, YIELD_SUPPORT, YIELD_CONFIDENCE)
    )


def with_macro(df: DataFrame, observations: DataFrame) -> DataFrame:
    """Requests with the macro values of their year where they bring none of their own."""
    macro = history.macro_by_period(observations, PERIOD, [FERTILIZER, GDP])
    return prepare.override_else_lookup(df, macro, PERIOD, [FERTILIZER, GDP])


def trends(df: DataFrame) -> DataFrame:
    """Yield, rainfall, temperature and area per region, crop and year."""
    measures = {
        "yields": YIELD,
        "rainfall": "Total_Rainfall",
        "temperatures": "Avg_Temperature",
        "areas": "Sown_Acre",
    }
    found = history.history(df, GROUP, PERIOD, measures)
    digits = {"yields": 4, "rainfall": 2, "temperatures": 2, "areas": 2}
    return found.withColumns({c: F.bround(c, d) for c, d in digits.items()})


def statistics(df: DataFrame) -> dict[str, DataFrame]:
    return reports.data_statistics(df, PERIOD, CATEGORIES)


def mining(df: DataFrame) -> dict[str, DataFrame]:
    """Correlations, patterns of yield level and crop, sequences of levels."""
    targets = {
        "yield_level": dict(
            columns=[*CATEGORIES, LEVEL],
            target=LEVEL,
            min_support=YIELD_SUPPORT,
            min_confidence=YIELD_CONFIDENCE,
            min_lift=1.0,
        ),
        "crop_type": dict(
            columns=CATEGORIES,
            target="Crop_Type",
            min_support=CROP_SUPPORT,
            min_confidence=CROP_CONFIDENCE,
            min_lift=None,
        ),
    }
    return reports.descriptive_mining(
        with_level(df), targets, GROUP, PERIOD, YIELD, YIELD_THRESHOLD, SEQUENCE_SUPPORT
    )


def clustering(df: DataFrame, key: list[str], k: int = 8, n_init: int = 10, ks=tuple(range(2, 11))):
    return reports.clustering(
        df, key, CLUSTERED, CLUSTER_LOGS, EVALUATED, EVALUATED, PROFILED, k, n_init, ks
    )
