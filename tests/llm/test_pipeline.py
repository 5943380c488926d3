"""Pipeline stages on their own inputs."""
import corpus_pipeline as cp
from chronorank.llm import jaccard, mixing, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "near copies":
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in jaccard.join(docs).where("doc_id = component_id").collect())
        if name == "secrets":
            left = {r.doc_id: r.n_live for r in secrets.scan(docs).collect()}
            text = {r.doc_id: r.text for r in docs.collect()}
            assert out.count() == docs.count() and all((r.text == text[r.doc_id]) == (left[r.doc_id] == 0) for r in out.collect())
            assert secrets.scan(out).agg({"n_live": "sum"}).first()[0] == 0
        if name == "mixing":
            assert out.count() == mixing.mix(docs).agg({"reps": "sum"}).first()[0]
        if name == "bpe":
            assert out.count() == docs.count()
        docs = out


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 7), (None, "token=abcdefgh12", "en", "s", 16, 7), (2, "", None, "s", 0, 7), (2, "", None, "s", 0, 7)], "doc_id long, text string, lang string, source string, n_chars long, size int")
    for df in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:4]:
            assert stage(spark, df, SF).columns == docs.columns
    assert [r.text for r in cp.cut_secrets(spark, docs, SF).where("doc_id is null").collect()] == ["[SECRET]"]
    assert [r["size"] for r in cp.cut_secrets(spark, docs, SF).collect()] == [7] * 4 and {r["size"] for r in cp.repeat_to_targets(spark, docs, SF).collect()} <= {7}
    assert cp.drop_toxic(spark, docs, SF).count() == 4 and cp.drop_copies(spark, docs, SF).count() == 3
