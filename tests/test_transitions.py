"""Transition plans against a direct count over each source's history: window 16, at most 256 successors an item."""
import math
from collections import defaultdict

import duckdb
import pytest

from chronorank.plans import blocks, catalogue


@pytest.fixture
def case():
    """Source 0 walks 20 items; source i >= 1 goes from item 1000 to its own item, so that 1000 has 300 successors."""
    seq = {0: list(range(1, 21))} | {i: [1000, 2000 + i] for i in range(1, 301)}
    con = duckdb.connect()
    con.sql("create table ord (src bigint, dst bigint, o bigint)")
    con.executemany("insert into ord values (?, ?, ?)", [(s, d, o) for s, ds in seq.items() for o, d in enumerate(ds, 1)])
    w = defaultdict(float)
    for ds in seq.values():
        for i, b in enumerate(ds):
            for n in range(1, min(16, i) + 1):
                w[ds[i - n], b] += 1 / math.sqrt(n)
    return con, w


def test_topk(case):
    con, w = case
    got = {(a, b): x for a, b, x, _ in con.sql(catalogue.PLANS["transition_topk"][1]).fetchall()}
    kept = {k: x for k, x in w.items() if k[0] != 1000 or k[1] <= 2256}  # equal weights: the 256 smallest ids
    assert got.keys() == kept.keys() and all(abs(got[k] - kept[k]) < 1e-6 for k in kept)
    assert (1, 17) in got and (1, 18) not in got


def test_scores(case):
    con, w = case
    con.sql("create table cand as select * from (values (1, 2299), (1, 2200), (0, 1)) x(src, c)")
    got = {(s, c): (f, t) for s, c, f, t in con.sql(f"with {blocks.STEP} {blocks.plans('x', 'x')['transition_scores'][1]}").fetchall()}
    # source 1 ended with 2001, 1000: only 1000 leads on, to the 256 first; source 0 goes back to 1 from its last 16 items
    back = sum(w[1, h] / math.sqrt(rk) for rk, h in enumerate(range(20, 4, -1), 1) if (1, h) in w)
    assert got[1, 2200] == (round(1 / math.sqrt(2), 6),) * 2 and got[1, 2299] == (0, 0)
    assert got[0, 1][0] == 0 and abs(got[0, 1][1] - back) < 1e-5
