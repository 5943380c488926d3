"""Rows dealt as packed arrays: what is written on the way, and results on odd tables."""
import numpy as np

from chronorank.operators import embeddings, history
from chronorank.plans import catalogue, dealt, wide
from chronorank.sources import blobs, files

SF = "/root/testdata/sf0.001"


def near(rows):
    return sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_recency(spark, monkeypatch):
    """no row for an ask is shuffled; repeated and negative ids, times at and below 0, unseen sources, rows without a key."""
    assert not any(x in plan(wide.queries()["wide_recency"](spark, SF)) for x in ("Window", "Generate"))
    monkeypatch.setattr(blobs, "EACH", 40)
    day = 86400
    rows = [(i % 5, i * 7 % 11 - 2, (i * i % 50) * day // 2 - day) for i in range(300)] + [(1, 3, 5 * day)] * 3 + [(None, 3, day), (2, None, day), (2, 3, None)]
    e = spark.createDataFrame(rows, "src long, dst long, t long")
    q = spark.createDataFrame([(10 + i, i % 7, (i * 3 - 2) * day // 2 + i % 2, [j * i % 13 - 3 for j in range(i % 9)]) for i in range(40)] + [(10, 0, 20 * day, [1, 1])], "qid long, src long, t long, cands array<long>")
    want, got = history.recency(e, files.unpivot(q, "qid", "src", "t")), dealt.recency(e, q)
    assert got.dtypes == want.dtypes and near(got.collect()) == near(want.collect())
    assert dealt.recency(e.limit(0), q).count() == sum(i % 9 for i in range(40)) + 2


def test_svd_of_groups(spark, monkeypatch):
    """no row for an entry and component; a matrix of several groups of sources, negative ids and entries without a key."""
    kept, settled = [], embeddings.settled
    monkeypatch.setattr(embeddings, "settled", lambda df: kept.append(df) or settled(df))
    monkeypatch.setattr(embeddings, "EACH", 30)
    r = np.random.default_rng(3)
    a = r.random((60, 4)) * [9, 5, 3, 1] @ r.random((4, 25)) * (r.random((60, 25)) < 0.5)
    rows = [(i - 20, 1000 * j - 5000, float(a[i, j])) for i in range(60) for j in range(25) if a[i, j]]
    d = spark.createDataFrame([*rows, (None, 3, 1.0), (3, None, 1.0)], "src long, dst long, v double")
    s, u, v = embeddings.svd(d, 3, 15)
    assert not any("Generate" in plan(x) for x in kept)
    assert np.allclose(s, np.linalg.svd(a)[1][:3], rtol=1e-6)
    u, v = ({x.id: np.array(x.vec) for x in y.collect()} for y in (u, v))
    b = np.linalg.svd(a)
    low = b[0][:, :3] * b[1][:3] @ b[2][:3]
    assert all(abs((u[i - 20] * s) @ v[1000 * j - 5000] - low[i, j]) < 1e-3 for i in range(60) for j in range(25) if a[i].any())


def test_recency_block(spark, monkeypatch):
    """no row for a candidate is settled or shuffled; repeated edges, times at and below 0, made candidates that are pairs."""
    assert not any(x in plan(catalogue.queries()["recency_block"](spark, SF)) for x in ("Join", "Window", "Generate"))
    monkeypatch.setattr(blobs, "EACH", 100)
    day = 86400
    rows = [(i % 5, i * i % 12, (i * i % 70 - 3) * day // 2, 10 + i, 1 + i % 3, i % 4) for i in range(300)]
    rows += [(1, 3, 9 * day, 1, 1, 5)] * 2 + [(1, 3, 9 * day, 1, 2, 5), (9, 11, 8 * day, 2, 1, 2)]
    e = spark.createDataFrame(rows, "src long, dst long, t long, k1 long, k2 int, k3 long")
    _, body = catalogue.parts("recency_block", True)
    want, got = spark.sql(f"with edges as (select * from {{edges}}){body}", edges=e), dealt.recency_block(e)
    assert got.dtypes == want.dtypes and near(got.collect()) == near(want.collect())
    assert dealt.recency_block(spark.createDataFrame([(1, 3, 9, 1, 1, 5), (2, 3, 9, 1, 2, 5)], e.schema)) is None  # left to the SQL
