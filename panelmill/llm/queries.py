"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelmill.llm import decontaminate, importance, language_id, line_dedup, ngram_join, order_minhash, packing, pii, quality, quality_rules, sql, toxicity, vector_codes, warc

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = sql.SQL


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_ngram_join(spark, sf):
    return ngram_join.similar_groups(table(spark, sf, "documents"))


def fold(key: str, folds: int) -> Column:
    """crc32 of a key as text, modulo ``folds``; null keys are in none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def vocabulary(name: str = TOKENIZER) -> str:
    """The text of a public tokenizer file; executors get it by broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query
def op5_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"), vocabulary())


@query
def op10_order_minhash(spark, sf):
    return order_minhash.fingerprints(table(spark, sf, "documents"))


@query
def op8_language_id(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    models = language_id.fit(docs, "text", "lang", fold("doc_id", 5) != 0)
    return language_id.identify(docs, models, ["doc_id", "held_out"])


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels, "doc_id", "text", "quality", fold("doc_id", 3) != 1)


@query
def op3_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    model = quality_model(docs, table(spark, sf, "labels"))
    return quality.scored(docs, model, ["doc_id", "held_out"])


@query
def op1_toxicity(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    model = toxicity.fit(docs, table(spark, sf, "labels"), "doc_id", "text", "toxic", fold("doc_id", 5) != 0)
    return toxicity.scored(docs, model, ["doc_id", "held_out"])


@query
def op9_decontamination(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op6_warc(spark, sf):
    return warc.archived(table(spark, sf, "pages"))


@query
def op2_line_dedup(spark, sf):
    rows = line_dedup.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "lines", "removed_lines", "text")


@query
def op7_pii(spark, sf):
    return pii.personal_data(table(spark, sf, "documents"))


@query
def op11_vector_codes(spark, sf):
    return vector_codes.coded(table(spark, sf, "embeddings"))


@query
def op12_importance(spark, sf):
    return importance.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_quality_rules(spark, sf):
    return quality_rules.judged(table(spark, sf, "documents"))
