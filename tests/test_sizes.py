"""Shapes of plans that decide whether large tables fit, and results that may not depend on them."""
import re

import pytest
from pyspark.sql import functions as F

from chronorank.functions.hashing import uniform
from chronorank.operators import sampling
from chronorank.plans import catalogue, lean, wide

SF = "/root/testdata/sf0.001"


def broadcast_explosions(df):
    """Lines of exploded rows that stand below a broadcast."""
    out, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if below is not None and depth <= below:
            below = None
        if below is not None and "Generate " in line:
            out.append(line)
        if "BroadcastExchange" in line and below is None:
            below = depth
    return out


@pytest.mark.parametrize("name", ["injected_positives", "weighted_draws", "honest_lists"])
def test_exploded_rows_are_not_broadcast(spark, name):
    """the size of exploded rows is guessed from the rows before, so that they went through the driver."""
    df = wide.queries()[name](spark, SF)
    assert not broadcast_explosions(df)
    df.collect()
    assert not broadcast_explosions(df)


@pytest.mark.parametrize("name", ["probability_rows", "probability_text"])
def test_no_row_for_a_candidate_is_written(spark, name, monkeypatch):
    """the settled tables of a query hold a row for each edge at most, not one for each of its ten candidates."""
    kept, settled = [], catalogue.store.settled
    monkeypatch.setattr(catalogue.store, "settled", lambda df: kept.append(out := settled(df)) or out)
    catalogue.queries()[name](spark, SF)
    edges = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert max(d.count() for d in kept) <= edges


def test_probabilities_of_odd_edges(spark):
    """Repeated edges, and an order that two sources share, give what the SQL of the plan gives."""
    rows = [(1, 3, 100, 1, 1, 5), (1, 3, 100, 1, 1, 5), (2, 3, 200, 1, 1, 5), (2, 0, 50, 2, 1, 4), (3, 7, 60, 3, 2, 2), (3, 3, 60, 3, 3, 2)]
    e = spark.createDataFrame(rows, "src long, dst long, t long, k1 long, k2 int, k3 long")
    _, body = catalogue.parts("probability_rows", True)
    want = spark.sql(f"with edges as (select * from {{edges}}){body}", edges=e)
    assert sorted(map(tuple, lean.probability_rows(e).collect())) == sorted(map(tuple, want.collect()))
    assert lean.probability_rows(e.withColumn("k1", -F.col("k1") * 100)) is None  # left to the SQL


@pytest.mark.parametrize("name", ["top1_summary", "row_pearson", "weight_grid_step"])
def test_sums_write_no_row_for_a_candidate(spark, name, monkeypatch):
    """Sums over ten candidates a query settle a row for each edge at most, and give what the SQL gives on repeated and shared keys."""
    kept, settled = [], catalogue.store.settled
    monkeypatch.setattr(catalogue.store, "settled", lambda df: kept.append(out := settled(df)) or out)
    catalogue.queries()[name](spark, SF)
    assert max(d.count() for d in kept) <= spark.read.parquet(f"{SF}/lineitem.parquet").count()
    rows = [(1, 3, 100, 1, 1, 5), (1, 3, 100, 1, 1, 5), (2, 3, 200, 1, 1, 5), (2, 0, 50, 2, 1, 4), (3, 7, 60, 3, 2, 2), (3, 3, 60, 3, 3, 2), (4, 5, 300, 4, 1, 2)]
    e = spark.createDataFrame(rows, "src long, dst long, t long, k1 long, k2 int, k3 long")
    _, body = catalogue.parts(name, True)
    want, got = spark.sql(f"with edges as (select * from {{edges}}){body}", edges=e), lean.QUERIES[name](e)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert lean.QUERIES[name](e.withColumn("t", F.when(F.col("t") > 60, F.col("t")))) is None  # left to the SQL


def test_draws_are_dealt_once(spark):
    """each draw goes to its cell and keeps its columns; no join brings the items back, whatever the draws' columns are called."""
    items = spark.createDataFrame([(i, 1 + i % 4 * 50) for i in range(50)], "id long, n long")
    draws = spark.range(300).withColumn("other", F.lit("x")).select("other", "id")
    got = sampling.by_weight(items, "n", draws, ["id"], seed=2, cells=7)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert "Join" not in plan and got.columns == ["other", "id", "item"]
    bounds, total = [], 0
    for r in items.orderBy("id").collect():
        total += r.n
        bounds.append((total, r.id))
    x = {r.id: int(r.x) for r in draws.select("id", F.floor(uniform("id", seed=2) * total).alias("x")).collect()}
    assert {r.id: r.item for r in got.collect()} == {i: next(item for hi, item in bounds if v < hi) for i, v in x.items()}


def test_unseen_draws_meet_the_pool_once_chosen(spark):
    """of a list's four hundred draws of unseen ids only those that it takes are rows; nothing is missing or doubled."""
    items = spark.createDataFrame([(i, i) for i in range(1, 120)], "id long, n long")
    pos = spark.createDataFrame([(1, 5, 3), (2, 6, None), (3, 500, 0), (4, 119, 99)], "qid long, dst long, n_unseen int")
    d = sampling.mixture(pos, items, "n", 400, width=40, seed=3)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode\(.*\[j#", plan)) == 1
    got = d.collect()
    assert len({(r.qid, r.c) for r in got}) == len(got)
    kinds = {q: [r.c for r in got if (r.qid, r.kind) == q] for q in {(r.qid, r.kind) for r in got}}
    assert all(len(kinds.get((q, "unseen"), [])) == n and len(kinds.get((q, "seen"), [])) == max(0, 39 - n) for q, n in ((1, 3), (2, 0), (3, 0), (4, 40)))
    assert all(c > 119 for (q, k), v in kinds.items() if k == "unseen" for c in v)
