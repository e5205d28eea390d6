"""Stored evaluation results and exports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RUNS = "versions"
CLASS_AUC_SCHEMA = "Crop_Type string, AUC double, `Test Support` int"
SUMMARY_SCHEMA = (
    "Model string, Accuracy double, `Weighted Precision` double, `Weighted Recall` double,"
    " `Weighted F1-score` double, `Macro ROC-AUC` double, `Weighted ROC-AUC` double"
)


def plain_name(header: str) -> str:
    """``Weighted F1-score`` -> ``weighted_f1_score``."""
    return re.sub(r"[^0-9a-z]+", "_", header.lower()).strip("_")


def read_metric_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A small typed CSV of stored results, its headers made plain names."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumnsRenamed({c: plain_name(c) for c in df.columns})


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """One JSON directory per section of a report."""
    for name, frame in sections.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def commit_report(sections: Mapping[str, DataFrame], path: str) -> str:
    """Write all sections of a report as one change; gives the folder of this version.

    The sections go to a folder of their own. A manifest that names it becomes
    visible by one rename after the last section is complete; until then, and
    if a section fails, readers see the version before. Of two writers at once
    the second one to commit fails.
    """
    spark = next(iter(sections.values())).sparkSession
    run = f"{path}/{RUNS}/{uuid.uuid4().hex}"
    for name, frame in sections.items():
        frame.write.json(f"{run}/{name}")
    files, manifests = _files(spark, path)
    newest = _newest(files, manifests)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/manifest")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"folder": run, "sections": list(sections)}).encode()))
    out.close()
    files.mkdirs(manifests)
    place = spark._jvm.org.apache.hadoop.fs.Path(manifests, f"{newest + 1:012d}.json")
    if files.exists(place) or not files.rename(draft, place):
        raise FileExistsError(f"another report was committed to {path}")
    return run


def read_section(spark: SparkSession, path: str, name: str, schema: str | T.StructType) -> DataFrame:
    """A section of the newest committed report; ``LookupError`` if there is none."""
    files, manifests = _files(spark, path)
    newest = _newest(files, manifests)
    if newest < 0:
        raise LookupError(f"no report at {path}")
    place = f"{manifests.toString()}/{newest:012d}.json"
    told = json.loads("".join(r.value for r in spark.read.text(place).collect()))
    if name not in told["sections"]:
        raise LookupError(f"no section {name} in the report at {path}")
    return spark.read.schema(schema).json(f"{told['folder']}/{name}")


def _files(spark: SparkSession, path: str):
    """The file system of a report and the folder of its manifests."""
    manifests = spark._jvm.org.apache.hadoop.fs.Path(path, "manifests")
    return manifests.getFileSystem(spark._jsc.hadoopConfiguration()), manifests


def _newest(files, manifests) -> int:
    """The number of the newest manifest, -1 without one."""
    if not files.exists(manifests):
        return -1
    return max((int(f.getPath().getName()[:12]) for f in files.listStatus(manifests)), default=-1)


def write_auc_comparison(comparison: DataFrame, path: str) -> None:
    """CSV with 6 decimals and blanks for missing areas."""
    areas = [c for c in comparison.columns if c.endswith("_auc")]
    blanks = {c: F.when(comparison[c].isNotNull(), F.format_string("%.6f", F.col(c))) for c in areas}
    rows = comparison.withColumns(blanks)
    rows.write.mode("overwrite").csv(path, header=True)
