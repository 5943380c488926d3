"""What Python workers hold at once: short batches of text in the pipeline, frames of bounded size."""
import pandas as pd

import corpus_pipeline as cp
from chronorank.llm import shared

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def test_stages_send_short_batches(spark, monkeypatch):
    was = {k: spark.conf.get(k, None) for k in KEYS}
    monkeypatch.setattr(cp.bpe, "encode", lambda docs, path: docs.selectExpr("doc_id", "0 as n_tokens", "'' as ids_sha256", "'' as decoded_sha256"))
    try:
        spark.conf.set(KEYS[0], "10000")
        cp.tokenise(spark, spark.range(1).withColumnRenamed("id", "doc_id"), "")
        assert int(spark.conf.get(KEYS[0])) == 1000
        spark.conf.set(KEYS[0], "50")  # a shorter one stays
        shared.short_batches(spark)
        assert int(spark.conf.get(KEYS[0])) == 50
        sizes = spark.range(0, 500, 1, 1).mapInPandas(shared.trimmed(lambda b: (pd.DataFrame({"n": [len(x)]}) for x in b)), "n long").collect()
        assert max(r.n for r in sizes) <= 50 and sum(r.n for r in sizes) == 500
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_frames_keep_all_rows():
    rows = [(i, str(i)) for i in range(1001)]
    cut = list(shared.pieces(iter(rows), ["a", "b"], 250))
    assert [len(x) for x in cut] == [250] * 4 + [1] and pd.concat(cut)["a"].tolist() == list(range(1001))
    assert [len(x) for x in shared.merged(iter(cut), 400)] == [500, 500, 1]
    assert list(shared.pieces([], ["a"])) == list(shared.merged([])) == []
