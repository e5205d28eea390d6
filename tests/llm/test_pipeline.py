import corpus_pipeline
from panelmill.llm import queries
import __spark_entry__ as contract


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if place < 4:
            assert out.columns == columns, name
            docs = queries_store(spark, out)
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert kept <= ids, name
            ids = kept
            sizes.append(len(kept))
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids


def queries_store(spark, df):
    from panelmill.llm.stores import Stores

    return Stores(spark).keep(df)


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_all_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()
