"""Candidates held against histories by tasks of items: what is planned, and results on odd tables."""
from chronorank.operators import graph, history
from chronorank.plans import catalogue, probed, wide
from chronorank.sources import blobs, files

SF = "/root/testdata/sf0.001"


def near(rows):
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd(spark):
    """Repeated edges, times below 0, sources of one item, made candidates that are items of the source, a shared key."""
    rows = [(i % 5, i * i % 12, i * i % 70 - 3, 10 + i, 1 + i % 3, i % 4) for i in range(300)]
    rows += [(1, 3, 9, 1, 1, 5)] * 2 + [(1, 3, 9, 1, 2, 5), (9, 11, 8, 2, 1, 2), (8, 11, 8, 2, 1, 2)]
    rows += [(20 + i % 40, 13 + i * 7 % 29, i, 400 + i, 1, i % 9) for i in range(300)]
    return spark.createDataFrame(rows, "src long, dst long, t long, k1 long, k2 int, k3 long")


def same(spark, monkeypatch, name):
    monkeypatch.setattr(blobs, "EACH", 100)
    monkeypatch.setattr(probed, "EACH", 60)
    monkeypatch.setattr(probed, "FLAT", 100)
    e = odd(spark)
    _, body = catalogue.parts(name, True)
    want, got = spark.sql(f"with edges as (select * from {{edges}}){body}", edges=e), probed.QUERIES[name](e)
    assert got.dtypes == want.dtypes and near(got.collect()) == near(want.collect())
    assert probed.QUERIES[name](e.union(spark.createDataFrame([(1, -3, 9, 1, 1, 5)], e.schema))) is None  # left to the SQL


def test_cf_pair_block(spark, monkeypatch):
    """no row for a pair of items."""
    assert not any(x in plan(catalogue.queries()["cf_pair_block"](spark, SF)) for x in ("Join", "Aggregate", "Window"))
    same(spark, monkeypatch, "cf_pair_block")


def test_transition_scores(spark, monkeypatch):
    """no row for a step or a successor; a cap on successors that binds."""
    assert not any(x in plan(catalogue.queries()["transition_scores"](spark, SF)) for x in ("Join", "Window", "Generate"))
    monkeypatch.setattr(probed, "TOP", 4)
    monkeypatch.setitem(catalogue.PLANS, "transition_scores", tuple(x.replace("rk <= 256", "rk <= 4") for x in catalogue.PLANS["transition_scores"]))
    same(spark, monkeypatch, "transition_scores")


def test_rule_scores(spark, monkeypatch):
    """no row for a step, a successor or a candidate."""
    assert not any(x in plan(catalogue.queries()["rule_scores"](spark, SF)) for x in ("Join", "Window", "Generate"))
    monkeypatch.setattr(probed, "TOP", 4)
    monkeypatch.setitem(catalogue.PLANS, "rule_scores", tuple(x.replace("rk <= 256", "rk <= 4") for x in catalogue.PLANS["rule_scores"]))
    same(spark, monkeypatch, "rule_scores")


def test_neighbour_block(spark, monkeypatch):
    """no row for a pair of items or an ask; unseen sources, negative and unknown candidates, caps that bind."""
    assert not any(x in plan(wide.queries()["neighbour_block"](spark, SF)) for x in ("Join", "Window", "Generate"))
    monkeypatch.setattr(probed, "PART", 100)
    monkeypatch.setattr(probed, "EACH", 20)
    monkeypatch.setattr(probed, "FLAT", 100)
    e = odd(spark)
    q = spark.createDataFrame([(100 + i, i % 70, [(j * i + j) % 60 - 5 for j in range(i % 9 * 3)]) for i in range(90)], "qid long, src long, cands array<long>")
    o = history.ordered(e, "k1", "k2", "k3")
    want = graph.neighbour_block(history.last(o, 7), files.unpivot(q, "qid", "src"), graph.capped(o, 9, 5))
    got = probed.neighbour_block(e, q, 7, 9, 5)
    assert got.dtypes == want.dtypes and near(got.collect()) == near(want.collect())
    assert probed.neighbour_block(e, q.union(spark.createDataFrame([(1, 2, None)], q.schema))) is None
    assert probed.neighbour_block(e, q.limit(0)).count() == 0
