"""Held-out accuracy and edge cases."""
from chronorank.llm import langid

SF = "/root/testdata/sf0.001"


def test_langid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.predict(docs).collect() if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (None, "12 !", None), (4, "the and of", "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(odd).collect()} >= {(1, "und"), (2, "und"), (None, "und")}
    assert langid.predict(odd.limit(0)).count() == 0
