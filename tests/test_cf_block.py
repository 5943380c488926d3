"""Golden 2.2 of FIXTURES.md: every (source, candidate), seen or not; misses are zeros and the length of the history."""
from math import log1p, sqrt

import duckdb

from chronorank.plans import blocks


def test_golden():
    con = duckdb.connect()
    con.sql("create table edges as select * from (values (1, 10), (1, 20), (2, 10), (2, 20), (3, 10), (1, 30), (1, 10), (4, 50)) x(src, dst)")
    con.sql("create table cand as select src::varchar as qid, pos, src, c from (values (1, 0, 20), (1, 1, 30), (1, 2, 99), (2, 0, 10), (2, 1, 30), (4, 0, 50), (4, 1, 10), (7, 0, 10)) x(src, pos, c)")
    got = {(q, p): r for q, p, *r in con.sql(f"with {blocks.plans('cand_', 'x')['cf_pair_block'][0].removeprefix('cand_, ')} {blocks.plans('cand_', 'x')['cf_pair_block'][1]}").fetchall()}
    want = {
        ("1", 0): (log1p(3), log1p(2 / sqrt(6) + 1 / sqrt(2)), 2 / 3, log1p(2), log1p(3)),
        ("1", 1): (log1p(2), log1p(1 / sqrt(3) + 1 / sqrt(2)), 2 / 3, log1p(1), log1p(3)),
        ("1", 2): (0, 0, 0, 0, log1p(3)),
        ("2", 0): (log1p(2), log1p(2 / sqrt(6)), 0.5, log1p(2), log1p(2)),
        ("2", 1): (log1p(2), log1p(1 / sqrt(3) + 1 / sqrt(2)), 1, log1p(1), log1p(2)),  # never seen by source 2
        ("4", 0): (0, 0, 0, 0, log1p(1)),  # a source with one destination
        ("4", 1): (0, 0, 0, 0, log1p(1)),
        ("7", 0): (0, 0, 0, 0, 0),  # a source without history
    }
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert all(abs(a - b) < 1e-5 for a, b in zip(got[k], row)), (k, got[k], row)
