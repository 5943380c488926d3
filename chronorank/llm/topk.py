"""Exact top-k search by columnar branch and bound.

A bounded hash sample of the candidates gives every query a score that its k-th best reaches at least. Cells then pair a
block of queries with a block of candidates. Inside a cell the candidates lie in vertical layout (one row per dimension);
a run of queries adds its inner products one block of dimensions at a time, and candidates whose partial score plus
remaining mass (Cauchy-Schwarz on the dimensions to come) stays below the query's score so far are dropped; once few are
left they are compacted. Only rows that reach that score leave a cell.

Null, empty or non-finite vectors and rows without an id take no part; ties go to the smaller id; shorter vectors count as
padded by zeros; a query never meets rows of its own id; repeated rows count as often as they occur; of rows that share a
query's id, the smallest vector asks; an empty table gives no rows; other columns, whatever their names, are ignored.
Integers are exact while |q| * |c| stays below 2**53 (single precision is used while it stays below 2**23)."""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronorank.llm.shared import settled

SCHEMA, RUN, SAMPLE = "query_id long, vec_id long, score long", 64, 4096


def matrix(vectors, d):
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def cell(q, c, d, k=20, block=16, low=None):
    """The k best of c for each row of q; low: scores that are known to be reached, by query."""
    import pandas as pd

    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    a, b = (np.floor(64 * matrix(x["v"].tolist(), d)) for x in (q, c))
    low = np.full(len(a), -np.inf) if low is None else low.astype(float)
    cuts = [*range(0, d, block), d]
    mass = [[np.sqrt((x[:, s:] ** 2).sum(1)) for s in cuts] for x in (a, b)]
    kind = np.float32 if mass[0][0].max() * mass[1][0].max() < 1 << 23 else np.float64
    ids, a, cols, out = c["id"].to_numpy(), a.astype(kind), np.ascontiguousarray(b.T, kind), []
    for at in range(0, len(a), RUN):
        run, own, least = a[at : at + RUN], q["id"].to_numpy()[at : at + RUN], low[at : at + RUN]
        s, left = np.zeros((len(run), len(ids)), kind), [None] * len(run)
        s[own[:, None] == ids] = -np.inf
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            dense = np.array([z is None for z in left])
            if dense.all():
                s += run[:, x:y] @ cols[x:y]
            elif dense.any():
                s[dense] += run[dense, x:y] @ cols[x:y]
            for j in np.flatnonzero(~dense):
                s[j, left[j]] += run[j, x:y] @ cols[x:y, left[j]]
            if y == d or not np.isfinite(least).any():
                continue
            rest = mass[0][i + 1][at : at + RUN] * (1 + 1e-6) + 1e-3
            if dense.any():
                fits = s[dense] + np.outer(rest[dense], mass[1][i + 1]) >= least[dense, None]
                for j, f in zip(np.flatnonzero(dense), fits):
                    if 4 * f.sum() < len(ids):
                        left[j] = np.flatnonzero(f)
            for j in np.flatnonzero(~dense):
                left[j] = left[j][s[j, left[j]] + rest[j] * mass[1][i + 1][left[j]] >= least[j]]
        for j in range(len(run)):
            live = left[j] if left[j] is not None else np.arange(len(ids))
            live = live[(s[j, live] >= least[j]) & np.isfinite(s[j, live])]
            if len(live) > k:
                live = live[s[j, live] >= np.partition(s[j, live], len(live) - k)[len(live) - k]]
            top = live[np.lexsort((ids[live], -s[j, live]))[:k]]
            out.append((np.full(len(top), own[j]), ids[top], s[j, top]))
    return pd.DataFrame({n: np.concatenate([o[i] for o in out]).astype("int64") for i, n in enumerate(("query_id", "vec_id", "score"))})


def valid(df):
    """id and v of the rows whose vectors take part."""
    ok = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    return df.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def paired(base, candidates, every, k, n, d, low, queries_per_block, rows_per_block):
    """Groups of queries (id, v, low) and of candidates, by (qb, cb): every query meets every candidate once.

    low(pandas queries, pandas sample) gives the score that each query's k-th best reaches at least, from a sample of about
    SAMPLE candidates. Query blocks are large, so that candidates are copied seldom: once as long as one block holds all queries."""
    share = int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    sample = base.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share).toPandas()
    seen = base.sparkSession.sparkContext.broadcast(sample)

    def seeded(batches):
        for q in batches:
            if len(q):
                yield q.assign(low=low(q, seen.value))

    nc, nq = max(1, -(-n // rows_per_block)), max(1, -(-n // (every * queries_per_block)))
    asks = base.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).mapInPandas(seeded, "id long, v array<double>, low double")
    asks = settled(asks.withColumn("qb", F.expr(f"cast(pmod(xxhash64(id), {nq}) as int)")))
    asks = asks.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    rows = candidates.withColumn("cb", F.expr(f"cast(pmod(xxhash64(id, 1), {nc}) as int)")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return asks.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb"))


def ranked(hits, k):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def search(df, every=20, k=20, queries_per_block=32768, rows_per_block=16384):
    """query_id, rank, vec_id, score for the rows of df(vec_id, embedding) whose id is divisible by every."""
    base = valid(df)
    n, d = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()

    def low(q, sample):
        got = cell(q, sample, d, k).groupby("query_id")["score"].agg(["size", "min"])
        own = got["min"].where(got["size"] >= k).reindex(q["id"]).to_numpy(float)
        return np.where(np.isnan(own), -np.inf, own)

    cells = paired(base, base, every, k, n, d, low, queries_per_block, rows_per_block)
    return ranked(cells.applyInPandas(lambda q, c: cell(q, c, d, k, low=q["low"].to_numpy()), SCHEMA), k)
