"""Targets against an independent water-filling by bisection; repetitions against their rules."""
from collections import defaultdict

from chronorank.llm import mixing


def water(sizes):
    """Targets by bisection on the level: min(cap * size, level * weight) sums to all sizes."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    lo, hi = 0.0, 4.0 * total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * n, mid * weight[s]) for s, n in sizes.items()) < total else (lo, mid)
    return {s: min(3 * n, hi * weight[s]) for s, n in sizes.items()}


CASES = [{"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 7, None: 3, "Z": 100}, {"é": 50, "z": 1, "A": 1, "b": 1, "c": 1}, {"x": 1}, {"x": 0}, {f"s{i}": i * i for i in range(40)}]


def test_targets():
    for sizes in CASES:
        want = water(sizes)
        for s, n, t in mixing.fill(list(sizes.items())):
            assert n == sizes[s] and abs(t - want[s]) < 1e-6 * max(1, want[s]) and t <= 3 * n


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), ["a", "b", None, "c"][i % 4 if i % 3 else 0], i, "t") for i in range(400)]
    rows += [(5, "same words here", "b", 1, "t")] * 60 + [(None, "no id at all", "c", 1, "t")] * 50 + [(900, None, "only empty", 1, "t"), (901, "long " * 60000, "a", 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, before long, target string")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "before", "size", "source_size", "target", "reps", "taken"]  # target of the input gives way
    out, by = got.collect(), defaultdict(list)
    assert len(out) == len(rows) and sorted(r.before for r in out) == sorted(r[3] for r in rows)
    for r in out:
        assert r["size"] == len((r.text or "").split()) and r.taken == r.reps * r["size"] <= 3 * r["size"]
        by[r.source].append(r)
    want = water({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        biggest = max(r["size"] for r in x)
        assert abs(x[0].target - want[s]) < 1e-6 * max(1, want[s]) and abs(sum(r.taken for r in x) - want[s]) <= biggest / 2 + 1
        full = [r.reps for r in x if r["size"]] or [0]
        assert max(full) - min(full) <= 1
    again = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r.text or "", r.taken) for r in again) == sorted((str(r.doc_id), r.text or "", r.taken) for r in out)
    assert mixing.mix(df.limit(0)).count() == 0
