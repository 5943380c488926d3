"""N-gram Jaccard join against brute force."""
import random
import re

from chronorank.llm import jaccard, registry

SF = "/root/testdata/sf0.001"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def made(seed=5):
    """Small and near copies around the threshold, with shared passages."""
    r, rows = random.Random(seed), [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "a b c d e"), (6, "a b c d e f")]
    passage = [f"p{i}" for i in range(40)]
    for k in range(60):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([8, 9, 10, 13, 30, 60, 200, 900]))]
        base[3:3] = passage if k % 2 else []
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 40))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [rows[-1]]


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, rep int")
    want, got = brute(rows), jaccard.join(df).collect()
    assert len(got) == len(rows) and all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got)
    assert jaccard.join(df.limit(0)).count() == 0
    assert jaccard.join(df.limit(3).selectExpr("cast(null as long) as doc_id", "text")).count() == 3


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op7_jaccard(spark, SF).collect()} == want
