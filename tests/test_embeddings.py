"""Embeddings against numpy, and a run over files."""
import numpy as np

from chronorank.__main__ import main
from chronorank.operators import embeddings, history


def test_svd(spark):
    r = np.random.default_rng(2)
    a = (r.random((30, 3)) * [9, 5, 3]) @ r.random((3, 20)) * (r.random((30, 20)) < 0.7)
    d = spark.createDataFrame([(i, 100 + j, float(a[i, j])) for i in range(30) for j in range(20) if a[i, j]], "src long, dst long, v double")
    s, u, v = embeddings.svd(d, 4, 12)
    assert np.allclose(s, np.linalg.svd(a)[1][:4], rtol=1e-6)
    u, v = ({x.id: np.array(x.vec) for x in y.collect()} for y in (u, v))
    best = np.linalg.svd(a)
    low = best[0][:, :4] * best[1][:4] @ best[2][:4]
    assert all(abs((u[i] * s) @ v[100 + j] - low[i, j]) < 1e-3 for i in range(30) for j in range(20))


def test_skip_grams_and_anchor(spark):
    e = history.ordered(spark.createDataFrame([(i % 20, i % 7, i) for i in range(400)], "src long, dst long, t long"))
    assert {len(r.vec) for r in embeddings.skip_grams(e, 8).collect()} == {8}
    rows = spark.createDataFrame([(float(i % 2), float(i % 2) + 0.1 * (i % 5), 0.3 * (i % 3)) for i in range(90)], "y double, a double, b double")
    w, _ = embeddings.linear_anchor(rows, ["a", "b"])
    assert w["a"] > 10 * abs(w["b"])


def test_run_over_files(spark, tmp_path):
    (tmp_path / "train.csv").write_text("src,dst,time\n" + "\n".join(f"{i % 9},{i * 7 % 13},{1000 + i}" for i in range(200)))
    (tmp_path / "test.csv").write_text("src,time," + ",".join(f"c{i}" for i in range(5)) + "\n" + "\n".join(f"{i % 11},{2000 + i}," + ",".join(str((i + k) % 15) for k in range(5)) for i in range(20)))
    at = lambda n: str(tmp_path / n)
    main(["fit", at("train.csv"), at("bundle")], spark)
    main(["score", at("bundle"), at("test.csv"), at("out"), "--width", "5"], spark)
    got = main(["validate", at("out"), "--width", "5"], spark)
    assert (got["n"], got["bad"]) == (20, 0) and abs(got["sum_min"] - 1) < 1e-7
