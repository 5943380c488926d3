"""Every catalogue plan against DuckDB on the same tables."""
import math

import duckdb
import pytest

from chronorank.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(rows):
    return sorted([tuple("~" if v is None or isinstance(v, float) and math.isnan(v) else v if isinstance(v, str) else f"{float(v):.5f}" for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.PLANS))
def test_plan(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({catalogue.oracle_sql()[name]}) x").fetchall()
    assert norm(map(tuple, df.select(*cols).collect())) == norm(want)


def test_recency_block_golden():
    """Hand-computed: strict counts and gaps before the query's time."""
    con = duckdb.connect()
    con.sql("create table edges as select * from (values (1, 10, 1000), (1, 10, 2000), (1, 20, 3000), (3, 10, 4000), (1, 10, 0)) x(src, dst, t)")
    con.sql("create table qq as select 'q' as qid, 1 as src, 692200 as t")
    con.sql("create table cand as select 'q' as qid, 1 as src, 692200 as t, pos, c from (values (0, 10), (1, 20), (2, 99)) x(pos, c)")
    from chronorank.plans import blocks

    sql = f"with {blocks.PROBE} {blocks.plans('x', 'x')['recency_block'][1]} order by ask.pos"
    got = con.sql(sql).df()
    assert got["cnt30"].round(5).tolist() == [round(math.log1p(x), 5) for x in (3, 1, 0)]
    assert got["cnt7"].tolist() == [0, 0, 0]
    assert got["gap_dst"].round(5).tolist() == [round(math.log1p(x), 5) for x in (692200 - 4000 + 1, 692200 - 3000 + 1, 1e10)]
    assert got["gap_pair"].round(5).tolist() == [round(math.log1p(x), 5) for x in (692200 - 2000 + 1, 692200 - 3000 + 1, 1e10)]
    assert got["gap_src"].round(5).tolist() == [round(math.log1p(692200 - 3000 + 1), 5)] * 3
