"""The stages one after another, each against its own input."""

import pytest

pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline as cp
    from driftwright.llm import decontam

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] >= sizes[4] > 100
    assert decontam.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    last = cp.run(spark, SF)
    assert sorted(r["doc_id"] for r in last.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert last.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.selectExpr("doc_id", "text", "lang", "'a' AS found", "1 AS score").union(spark.sql("select * from values (-1L, null, null, 'x', 2), (-2L, '', 'en', 'x', 2), (-2L, '', 'en', 'x', 2), (null, '12 !', null, null, null)")).coalesce(2)
    for stage in (cp.language, cp.clean):
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns and kept.exceptAll(odd).isEmpty() and kept.count() > 20
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert cp.language(spark, odd, SF).where("doc_id < 0 or doc_id is null").isEmpty()
    assert cp.clean(spark, odd, SF).where("doc_id < 0 or doc_id is null").count() == 4


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
