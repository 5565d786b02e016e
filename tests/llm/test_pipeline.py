import corpus_pipeline
from tests.conftest import SF001
from tests.llm.helpers import docs_of


def test_stages_keep_the_columns_and_only_take_away(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before, name
        before = after


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(out.columns)
    assert out.where("length < 1 or length > 2048").count() == 0


def test_stages_take_awkward_rows(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (None, "a line"), (3, "a line"), (3, "a line"), (4, " \n ")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
    got = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert got == [("1", None), ("2", ""), ("4", " \n "), ("None", "a line")]
    empty = docs_of(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF001).count() == 0, name
