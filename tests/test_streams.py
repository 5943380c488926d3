"""Histories as streaming state."""
import numpy as np

from chronorank.streaming import state


def test_merged_equals_appended():
    """A bucket of sources at once gives what each source gives by itself: late edges, times of 0, equal times, new and old sources."""
    rng = np.random.default_rng(3)
    now, by = tuple(np.zeros(0, np.int64) for _ in range(5)), {}
    for _ in range(6):
        n = int(rng.integers(1, 60))
        src, t, o, dst = rng.integers(0, 9, n), rng.integers(0, 40, n), rng.permutation(n), rng.integers(0, 5, n)
        now, touched = state.merged(now, (src, t, o, dst), 4)
        for s in set(src.tolist()):
            by[s] = state.appended(*by.get(s, ([], 0)), [(int(a), int(b), int(c)) for a, b, c, d in zip(t, o, dst, src) if d == s], 4)
        ends = np.cumsum(now[2])
        got = {int(s): ([(int(d), int(u)) for d, u in zip(now[3][e - k : e], now[4][e - k : e])], int(late)) for s, late, k, e in zip(now[0], now[1], now[2], ends)}
        assert got == {s: (h, int(late)) for s, (h, late) in by.items()} and set(now[0][touched].tolist()) == set(src.tolist())


def test_sources_share_states(spark, tmp_path):
    """a stream of more sources than buckets keeps a state for each bucket, not one for each source; a null source is one source."""
    at = str(tmp_path)
    for i in range(2):
        e = spark.range(6000).selectExpr("if(id = 7, null, id) as src", f"id % 5 + {i} as dst", f"if(id = 9, 0, 100 - {i} * id % 2) as t", "1L as ord")
        e.coalesce(1).write.mode("append").parquet(f"{at}/in")
    got = state.latest(state.replayed(spark, f"{at}/in", e.schema, f"{at}/out", f"{at}/state", 2)).collect()
    assert spark.read.format("statestore").load(f"{at}/state").count() <= state.BUCKETS + 1
    want = {None if i == 7 else i: (0, []) if i == 9 else (i % 2, [(i % 5, 100), (i % 5 + 1, 100 - i % 2)]) for i in range(6000)}
    assert len(got) == 6000 and {r.src: (r.late, [(h.dst, h.t) for h in r.hist]) for r in got} == want
