"""Feature tables of the three model variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from panelmill.operators.history import FLAGS, persistence_features, persistence_features_asof
from panelmill.operators.prepare import add_interactions, log1p_clipped
from panelmill.operators.rules import RULE_FEATURES, rule_features

BASELINE = "baseline"
ENGINEERED = "engineered"
ADVANCED = "advanced"


@dataclass(frozen=True)
class FeatureSpec:
    """Columns a variant is made of; names of the data stay with the caller."""

    keys: Sequence[str]
    label: str
    categories: Sequence[str]
    numbers: Sequence[str]
    period: str
    group: Sequence[str]
    tie: Sequence[str]
    level: str = "level"
    interactions: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    logs: Mapping[str, str] = field(default_factory=dict)
    rule_columns: Sequence[str] = ()

    def categories_of(self, variant: str) -> list[str]:
        made = [] if variant == BASELINE else list(self.interactions)
        return [*self.categories, *made]

    def numbers_of(self, variant: str) -> list[str]:
        if variant == BASELINE:
            return list(self.numbers)
        plain = [c for c in self.numbers if c not in self.logs.values()]
        made = [*plain, *self.logs]
        return made if variant == ENGINEERED else [*made, *RULE_FEATURES, *FLAGS]

    def features_of(self, variant: str) -> list[str]:
        return [*self.categories_of(variant), *self.numbers_of(variant)]


def build_features(
    df: DataFrame,
    spec: FeatureSpec,
    variant: str,
    rules: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Keys, label, period and the features of a variant.

    The advanced variant adds rule features from ``rules`` and persistence
    flags: from the rows themselves when ``history`` is None (training), else
    from one level per earlier period of ``history`` (serving).
    """
    rows = df
    if variant == ADVANCED:
        if rules is None:
            raise ValueError("the advanced variant needs rules")
        # First, as its shuffle then carries the columns of the table alone.
        if history is None:
            rows = persistence_features(rows, spec.group, spec.period, spec.level, spec.tie)
        else:
            rows = persistence_features_asof(
                rows, history, spec.group, spec.period, spec.level, spec.tie
            )
    if variant != BASELINE:
        rows = log1p_clipped(add_interactions(rows, spec.interactions), spec.logs)
    if variant == ADVANCED:
        rows = rule_features(rows, rules, spec.rule_columns, spec.level)
    kept = dict.fromkeys([*spec.keys, spec.label, spec.period, *spec.features_of(variant)])
    return rows.select(*kept)
