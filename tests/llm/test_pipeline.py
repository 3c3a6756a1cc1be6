import corpus_pipeline
from tessera.llm import secrets
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
        if name == "near duplicates":
            again = QUERIES["op8_lsh_forest"][0]
            from tessera.llm.lsh_forest import near_duplicates
            groups = near_duplicates(docs).collect()
            kept = {r.doc_id for r in after.collect()}
            assert kept == {r.component_id for r in groups} and after.count() == len(kept) and again
        if name == "secret scan":
            assert after.count() == docs.count()
            left = secrets.find_secrets(after).selectExpr("explode(filter(spans, s -> s.standing = 'live')) as s")
            assert left.count() == 0
        if k < 3:
            assert 0 < after.count() <= docs.count()
        before, docs = docs, after
    assert docs.count() == before.count() and docs.where("not exact").count() == 0


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 11)}
