"""Seeded pseudo-random order that is the same in every engine and Spark version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def seeded_hash(keys: Sequence[str | Column], seed: int) -> Column:
    """md5 of ``seed|key|key...``: sorting by it is a reproducible shuffle of the rows."""
    parts = [F.coalesce(_column(k).cast("string"), F.lit("nan")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _column(key: str | Column) -> Column:
    return F.col(key) if isinstance(key, str) else key
