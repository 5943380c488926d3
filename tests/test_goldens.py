"""Hand-computed cases, through Spark."""
from math import log1p, sqrt

import pytest
from pyspark.sql import functions as F

from chronorank.functions import hashing
from chronorank.functions import rows as R
from chronorank.operators import blend, graph, history, sampling, vectors
from chronorank.sources import files
from chronorank.streaming import state


def near(a, b):
    return a == b or abs(a - b) < 1e-9


def test_recency(spark):
    """Strict counts and gaps; edges without a time count for nothing; a query without a time never."""
    edges = spark.createDataFrame([(1, 10, 1000), (1, 10, 2000), (1, 20, 3000), (3, 10, 4000), (1, 10, 0)], "src long, dst long, t long")
    t = 1000 + 8 * 86400
    asks = spark.createDataFrame([(1, 0, 1, 10, t), (1, 1, 1, 20, t), (1, 2, 1, 99, t), (2, 0, 1, 10, 0), (3, 0, 1, 10, 4000)], "qid long, pos int, src long, c long, t long")
    got = {(r.qid, r.pos): tuple(r)[2:] for r in history.recency(edges, asks).collect()}
    never = log1p(1e10)
    want = {
        (1, 0): (log1p(3), 0, log1p(0.5) - log1p(3.5), log1p(t - 4000 + 1), log1p(t - 2000 + 1), log1p(t - 3000 + 1)),
        (1, 1): (log1p(1), 0, log1p(0.5) - log1p(1.5), log1p(t - 3000 + 1), log1p(t - 3000 + 1), log1p(t - 3000 + 1)),
        (1, 2): (0, 0, 0, never, never, log1p(t - 3000 + 1)),
        (2, 0): (never,) * 6,
        (3, 0): (log1p(2), log1p(2), 0, log1p(4000 - 2000 + 1), log1p(4000 - 2000 + 1), log1p(4000 - 3000 + 1)),  # the edge at its own time does not count
    }
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert all(map(near, got[k], row)), (k, got[k], row)


def test_ranks(spark):
    d = spark.createDataFrame([([1.0, 1.0, 0.5, 2.0], [30, 10, 40, 20])], "s array<double>, c array<long>")
    s, c = F.col("s"), F.col("c")
    r = d.select(R.percentile(s, c).alias("by_id"), R.percentile(s).alias("by_slot"), R.competition(s).alias("comp"), R.ordinal(s).alias("ord"), R.first_best(s).alias("best"), R.margin(s).alias("margin"), R.zscore(s).alias("z"), R.minmax(s).alias("m")).first()
    assert r.by_id == [0.75, 0.5, 0.25, 1.0] and r.by_slot == [0.5, 0.75, 0.25, 1.0] and r.comp == [0.5, 0.5, 0.25, 1.0] and r.ord == [0.5, 1 / 3, 0.25, 1.0]
    assert (r.best, r.margin) == (3, 1.0) and abs(sum(r.z)) < 1e-12 and near(r.m[3], 1.0) and near(r.m[2], 0.01)


def test_constant_and_odd_rows(spark):
    d = spark.createDataFrame([([2.0, 2.0],), ([0.0, 0.0],), ([-1.0, 3.0],)], "s array<double>")
    got = [tuple(r) for r in d.select(R.zscore(F.col("s")), R.minmax(F.col("s")), R.probabilities(F.col("s"))).collect()]
    assert got[0] == ([0.0, 0.0], [0.5, 0.5], [0.5, 0.5]) and got[1][2] == [0.5, 0.5] and got[2][2] == [0.0, 1.0]
    third = spark.createDataFrame([([1.0, 1.0, 1.0],)], "s array<double>").select(R.probabilities(F.col("s")).alias("p")).first().p
    assert third == [0.33333334, 0.33333333, 0.33333333]  # what is missing goes to the first largest


def test_gate(spark):
    d = spark.createDataFrame([(1, 9, 100, [11, 12, 13, 14], [5.0, 1.0, 0.0, -1.0]), (2, 9, 100, [21, 22, 23, 24], [1.0, 0.9, 0.8, 0.7]), (3, 9, 0, [31, 32], [9.0, 1.0])], "qid long, src long, t long, cands array<long>, scores array<double>")
    assert [(r.qid, r.dst) for r in state.gated(d, 0.5).collect()] == [(1, 11)]
    assert sorted(r.dst for r in state.gated(d, 0.0, 3, unknown=23).where("qid = 2").collect()) == [21, 22]
    assert state.gated(d).count() == 0


def test_history_store():
    hist, late = state.appended([], 0, [(100, 0, 55), (200, 1, 56), (300, 2, 57)], 4)
    assert hist == [(55, 100), (56, 200), (57, 300)] and late == 0
    hist, late = state.appended(hist, late, [(350, 3, 58), (360, 4, 59), (0, 5, 99)], 4)
    assert [d for d, _ in hist] == [56, 57, 58, 59] and late == 0
    assert state.appended(hist, 0, [(10, 6, 60)], 4)[1] == 1


def test_running_history(spark):
    e = history.ordered(spark.createDataFrame([(1, 55, 100), (1, 56, 200), (1, 57, 300), (1, 58, 400)], "src long, dst long, t long"))
    r = {x.t: x for x in history.running(e, 4).collect()}
    assert r[100].hist == [0, 0, 0, 0] and r[400].hist == [0, 55, 56, 57] and all(map(near, r[400].gaps, [0, log1p(300) / 10, log1p(200) / 10, log1p(100) / 10]))


def test_as_of(spark):
    e = history.ordered(spark.createDataFrame([(1, 5, 10), (1, 6, 20), (1, 7, 20), (2, 8, 1)], "src long, dst long, t long"))
    q = spark.createDataFrame([(1, 1, 20), (2, 1, 21), (3, 1, 10), (4, 3, 50), (5, 1, 99)], "qid long, src long, t long")
    got = sorted((r.qid, r.rk, r.dst) for r in history.as_of(e, q, 2).collect())
    assert got == [(1, 1, 5), (2, 1, 7), (2, 2, 6), (5, 1, 7), (5, 2, 6)]


def test_negatives_and_draws(spark):
    d = spark.createDataFrame([(i, 1 + i % 3) for i in range(200)], "ord long, dst long")
    got = sampling.uniform_negatives(d, 3, 4, ["ord"]).collect()
    assert len(got) == 800 and all(r.neg != r.dst and 1 <= r.neg <= 3 for r in got)
    items = spark.createDataFrame([(1, 0), (2, 1), (70000, 3)], "id long, n long")
    got = [r.item for r in sampling.by_weight(items, "n", spark.range(4000).withColumnRenamed("id", "k"), ["k"]).collect()]
    assert len(got) == 4000 and set(got) == {2, 70000} and 0.7 < got.count(70000) / 4000 < 0.8
    u = [r.u for r in spark.range(2000).select(hashing.uniform("id", seed=1).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03


def test_blend_weights():
    with pytest.raises(ValueError):
        blend.rank_blend([("a", 0.5), ("b", 0.4)])


def test_descend(spark):
    rows = [(0, [1.0, 0.0, -1.0], [0.0, 1.0, -1.0]) if i % 4 else (1, [1.0, 0.0, -1.0], [0.0, 2.0, -2.0]) for i in range(40)]
    d = spark.createDataFrame(rows, "label long, f1 array<double>, f2 array<double>")
    weights, mrr = blend.descend(d, ["f1", "f2"], "label", {"f1": 1.0})
    assert mrr >= 0.85 and weights["f1"] > 0


def test_csv(spark, tmp_path):
    (tmp_path / "train.csv").write_text("src,dst,time,split\n1,2,3,0\n4,5,6,1\n")
    assert sorted(map(tuple, files.edges_csv(spark, str(tmp_path / "train.csv")).collect())) == [(1, 2, 3, 0), (4, 5, 6, 1)]
    with pytest.raises(FileNotFoundError):
        files.dataset(spark, str(tmp_path))
    (tmp_path / "test.csv").write_text("src,time,c1,c2\n1,2,3,4\n")
    assert len(files.dataset(spark, str(tmp_path))) == 2 and files.queries_csv(spark, str(tmp_path / "test.csv"), 2).first().cands == [3, 4]
    with pytest.raises(ValueError):
        files.queries_csv(spark, str(tmp_path / "test.csv"), 3)
    (tmp_path / "bad.csv").write_text("src,dst,time\n1,x,3\n")
    with pytest.raises(Exception):
        files.edges_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_nearest_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, [0.0, 1.0])], "id long, vec array<double>")
    for tile in (2, 100):
        got = {(r.a, r.rk): r.b for r in vectors.nearest(v, 2, tile).collect()}
        assert [got[0, 1], got[0, 2], got[3, 1], got[3, 2]] == [1, 2, 0, 1]


def test_time_order(spark):
    d = spark.createDataFrame([(0, 5), (1, 6), (2, 4), (65536, 3), (65537, 9)], "o long, t long")
    assert tuple(history.sorted_by_time(d, "o").first()) == (2, 2)


def test_capped_cooccurrence(spark):
    """Sources 1: [1, 2, 3], 2: [1, 2], 3: [1, 4], 4: [1, 2, 1]: only (1, 2) and (2, 1) stand in two sources, with three."""
    rows = [(s, d, t) for s, ds in {1: [1, 2, 3], 2: [1, 2], 3: [1, 4], 4: [1, 2, 1]}.items() for t, d in enumerate(ds, 1)]
    e = history.ordered(spark.createDataFrame(rows, "src long, dst long, t long"))
    table = graph.capped(e)
    assert sorted((r.a, r.b, r.n, r.w) for r in table.collect()) == [(1, 2, 3, 1.0), (2, 1, 3, 1.0)]
    asks = spark.createDataFrame([(1, 0, 4, 1), (1, 1, 4, 9), (2, 0, 7, 1)], "qid long, pos int, src long, c long")
    got = {(r.qid, r.pos): (r.hit_frac, r.max_w, r.mean_w) for r in graph.neighbour_block(history.last(e, 40), asks, table).collect()}
    assert got == {(1, 0): (1 / 3, 1.0, 1 / 3), (1, 1): (0.0, 0.0, 0.0), (2, 0): (0.0, 0.0, 0.0)}  # one of three past items is 2


def test_history_cosines(spark):
    e = history.ordered(spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 10, 3), (2, 20, 4), (3, 10, 5), (1, 30, 6)], "src long, dst long, t long"))
    v = spark.createDataFrame([(10, [1.0, 0.0, 0.0, 0.0]), (20, [1.0, 1.0, 0.0, 0.0]), (30, [0.0, 1.0, 0.0, 0.0]), (99, [0.0, 0.0, 1.0, 0.0])], "id long, vec array<double>")
    asks = spark.createDataFrame([(1, 0, 1, 20), (1, 1, 1, 30), (1, 2, 1, 99), (2, 0, 2, 10), (7, 0, 7, 10)], "qid long, pos int, src long, c long")
    got = {(r.qid, r.pos): (r.seq_max, r.seq_top) for r in vectors.history_cosines(history.last(e, 20), asks, v).collect()}
    want = {(1, 0): (1, (1 + 2 / sqrt(2)) / 3), (1, 1): (1, (1 + 1 / sqrt(2)) / 3), (1, 2): (0, 0), (2, 0): (1, (1 + 1 / sqrt(2)) / 2), (7, 0): (0, 0)}
    assert got.keys() == want.keys() and all(near(x, y) for k in want for x, y in zip(got[k], want[k]))


def test_edge_counts(spark):
    """Pairs (1, 5) four times, (2, 6) five, (3, 7) six: scaled by the logs of the largest; an absent pair is zero."""
    rows = [(s, d, i) for (s, d), n in {(1, 5): 4, (2, 6): 5, (3, 7): 6}.items() for i in range(1, n + 1)]
    e = history.ordered(spark.createDataFrame(rows, "src long, dst long, t long"))
    asks = spark.createDataFrame([(1, 0, 1, 5, 9), (2, 0, 2, 6, 9), (3, 0, 3, 7, 9), (3, 1, 3, 5, 9)], "qid long, pos int, src long, c long, t long")
    got = {(r.qid, r.pos): r for r in graph.TemporalGraph.fit(e).features(asks).collect()}
    assert [near(got[k].pair_log, v) for k, v in {(1, 0): log1p(4) / log1p(6), (2, 0): log1p(5) / log1p(6), (3, 0): 1.0, (3, 1): 0.0}.items()] == [True] * 4
    assert got[3, 1].dst_known == 1 and got[3, 1].src_recent_exact == 0 and got[3, 0].src_recent_exact == 1 and got[1, 0].candidate_seen_in_test == 0
