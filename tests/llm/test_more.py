"""Toxicity, nearest neighbours and archives against brute force and held-out labels."""
import hashlib
import io

import numpy as np

from chronorank.llm import ann, registry, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_toxicity(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = registry.op4_toxicity(spark, SF).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and sum(p and t for p, t in held) >= 0.8 * sum(t for _, t in held)
    odd = spark.createDataFrame([(1, None), (None, "you idiot, shut up moron"), (2, ""), (2, "")], "doc_id long, text string")
    got = toxicity.score(odd, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == 4 and [r.predicted for r in got if r.doc_id is None] == [1] and not any(r.predicted for r in got if r.doc_id)
    assert toxicity.score(odd.limit(0), spark.read.parquet(f"{SF}/labels.parquet")).count() == 0


def test_ann(spark):
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = set()
    for i, v in rows:
        if i % 50 == 0:
            near = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in rows if j != i)[:5]
            want |= {(i, j) for _, j in near}
    got = {(r.query_id, r.vec_id) for r in registry.op6_ann(spark, SF).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)
    odd = spark.createDataFrame([(0, None), (50, [0.0, 0.0]), (100, [float("nan"), 1.0]), (150, [1.0, None]), (200, [1.0, 2.0]), (201, [2.0, 4.0]), (201, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(odd).collect()] == [(200, 1, 201), (200, 2, 201)]
    assert ann.search(odd.limit(2)).count() == 0


def test_warc(spark):
    big, other = "<p>" + "é" * 600, "x" * 1000
    rows = [(1, "u", big), (5, None, big), (3, "a b\n", big), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", "short"), (9, "u", "short"), (None, "u", other), (5, "u", big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.roundtrip(df).collect()), key=str)
    last = {big: 5, other: 7}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        back = h in last and i != last[h]
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if back else "response", last[h] if back else None))
    assert got == sorted(want, key=str) and warc.roundtrip(df.limit(0)).count() == 0
    assert registry.op9_warc(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_zip64():
    for zip64 in (False, True):
        f = io.BytesIO()
        z = warc.Writer(f, zip64)
        z.member("a", [b"one", b"two"])
        z.member("b/c", [])
        z.close()
        data = f.getvalue()
        there = warc.directory(lambda at, n: data[at : at + n], len(data))
        assert {k: data[a : a + n] for k, (a, n) in there.items()} == {"a": b"onetwo", "b/c": b""}
