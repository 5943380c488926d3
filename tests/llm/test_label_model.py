"""The label model on made voters with known rates, and against planted wrong labels."""
from collections import Counter

import numpy as np

from chronorank.llm import toxicity as T


def made(n=20000, seed=3):
    """Two ways of being toxic, each with its own voters, a pair of voters that always agree, and texts that are clean."""
    r = np.random.default_rng(seed)
    kind = r.choice(3, n, p=[0.85, 0.1, 0.05])
    rates = np.full((3, 11), 0.01)
    rates[1, :5], rates[2, 5:10] = [0.7, 0.6, 0.5, 0.4, 0.6], [0.6, 0.7, 0.5, 0.6, 0.4]
    v = r.random((n, 11)) < rates[kind]
    v[:, 10] = v[:, 0]  # a copy of the first voter
    return kind, rates, [tuple(np.flatnonzero(x).tolist()) for x in v]


def fitted(votes, m=11, prior=0.15):
    kinds = Counter(votes)
    gather = lambda base, delta, pairs: T.added(T.sums(list(kinds), list(kinds.values()), base, delta, pairs), m, len(base))
    return T.label_model(gather, m, prior)


def test_rates_and_correlations():
    kind, rates, votes = made()
    share, got, weight = fitted(votes)
    known = T.posterior(votes, *T.evidence(share, got, weight))
    own = [int(np.bincount(known.argmax(1)[kind == k]).argmax()) for k in range(3)]
    assert len(set(own)) == 3 and own[0] == 0
    for k in (1, 2):
        assert abs(share[own[k]] - [0.1, 0.05][k - 1]) < 0.02 and np.abs(got[own[k], :10] - rates[k, :10]).max() < 0.08
    assert weight[0] < 0.8 and weight[10] < 0.8 and weight[1:10].min() > 0.9  # the copy and its model share one vote


def test_wrong_labels_are_overruled():
    kind, _, votes = made(6000)
    y = (kind > 0).astype(int)
    wrong = np.random.default_rng(1).random(len(y)) < 0.08
    model = T.evidence(*fitted(votes))
    known = T.posterior(votes, *model)
    p = known @ T.naming(known, np.ones(len(y)), np.where(wrong, 1 - y, y))
    flipped = ((p > 0.5) == y)[wrong & (np.array(list(map(len, votes))) != 1)]  # a single vote may be chance
    assert flipped.mean() > 0.9 and ((p > 0.5) == y).mean() > 0.95
    w, b = T.train(votes, np.ones(len(votes)), p, 11)
    assert ((T.linear(votes, w, b) >= 0.7) == y).mean() > 0.95


def test_telling_words():
    counts = {("bad", 1): (30, 1), ("^badd", 1): (30, 1), ("^badd", 2): (12, 0), ("odd", 1): (5, 4), ("rare", 1): (3, 0), ("idiot", 1): (20, 0), ("^idio", 1): (20, 0), ("die", 1): (2, 90)}
    got = T.choose(counts, 100, 900, 50)
    assert set(got) & {("bad", 1), ("^badd", 1)} and ("^badd", 2) in got and not set(got) & {("rare", 1), ("^idio", 1), ("die", 1)}
    words = [w for w, _ in T.lexicon(counts, 100, 900)]
    assert "idiot" in words and "die" not in words


def test_votes():
    v = T.Voters([("bad", 1), ("^badd", 2)])
    assert v.votes("Bad baddest! baddy") == [0, 1] and v.votes("baddest") == [] and v.votes(None) == [] and v.votes("so bad!!! you idiot, f*ck") == [0, 2, 4, 5]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"you are an idiot, moron {i}" if i % 5 == 0 else f"a plain text {i}", 7, "x") for i in range(60)] + [(None, None, 7, "x"), (3, "", 7, "x"), (3, "", 7, "x"), (70, "fine words " * 50000 + "you are an idiot, moron", 7, "x")], "doc_id long, text string, toxic int, votes string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)] + [(999, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = T.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 64 and {r.doc_id for r in rows if r.predicted} == {i for i in range(60) if i % 5 == 0} | {70}
    assert [r.held_out for r in rows if r.doc_id is None] == [False] and all(r.predicted == (r.score >= 0.7) for r in rows)
    assert sorted(map(tuple, T.score(docs, labels).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert T.score(docs.limit(0), labels).count() == 0 and T.score(docs, labels.limit(0)).count() == 64
