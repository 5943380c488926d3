"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and kept as the signs of its components, packed in 64-bit words, with one correction
scalar, its inner product with its own code. A query is rotated likewise and rounded to LEVELS bit planes, so that its inner
product with a code is a weighted sum of bit counts of (plane and code); divided by the correction it estimates the cosine,
with an error of at most EPS * sqrt((1 - c^2) / c^2 / (d - 1)) and EPS times the rounding's deviation, but for a vanishing
chance. A bounded hash sample gives every query a cosine that its k-th nearest reaches at least; in a cell of a query block
and a candidate block, candidates whose upper bound reaches it are reranked by the exact cosine in double precision. Every
row is coded and compared.

A score depends on the two vectors alone, so equal vectors tie exactly; ties go to the smaller id. Null, empty, zero or
non-finite vectors and rows without an id take no part; shorter vectors count as padded by zeros; a query never meets rows
of its own id; repeated rows count as often as they occur; of rows that share a query's id, the smallest vector asks; an
empty table gives no rows; other columns, whatever their names, are ignored."""
import numpy as np
from pyspark.sql import functions as F

from chronorank.llm.topk import matrix, paired, ranked, valid

EPS, SEED, LEVELS = 4.0, 29, 6
SCHEMA = "query_id long, vec_id long, score double"


def rotation(d):
    """A random rotation of d dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def norms(x):
    """Lengths, row by row: large and small components are scaled first."""
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def packed(bits):
    """Rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(d):
    """Adds the packed code and the correction scalar of each vector."""

    def run(batches):
        turn = rotation(d)
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["v"].tolist(), d)
                x = (x / norms(x)[:, None]) @ turn
                yield pdf.assign(code=[c.tobytes() for c in packed(x > 0)], fix=np.abs(x).sum(1) / np.sqrt(d))

    return run


def estimates(turned, codes, fix, d):
    """Estimated cosine of one rotated query with every code, and the size of its rounding steps."""
    lo = turned.min()
    step = max((turned.max() - lo) / ((1 << LEVELS) - 1), 1e-12)
    u = np.rint((turned - lo) / step).astype(np.int64)
    planes = packed(np.array([u >> j & 1 for j in range(LEVELS)], np.uint8))
    both = sum((1 << j) * np.bitwise_count(codes & p).sum(1, dtype=np.int64) for j, p in enumerate(planes))
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    return (2 * (lo * ones + step * both) - (lo * d + step * u.sum())) / np.sqrt(d) / fix, step


def exact(v, size, x, sizes):
    """Cosines of one vector with each row of x: sums run along a row, so that equal rows give equal cosines."""
    return (x / sizes[:, None] * (v / size)).sum(1)


def cell(q, c, d, k):
    import pandas as pd

    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    a, x, ids, fix = matrix(q["v"].tolist(), d), matrix(c["v"].tolist(), d), c["id"].to_numpy(), c["fix"].to_numpy()
    size, sizes = norms(a), norms(x)
    codes = np.frombuffer(b"".join(c["code"]), np.uint64).reshape(len(c), -1)
    error = EPS * np.sqrt(np.clip(1 - fix**2, 0, None) / fix**2 / max(d - 1, 1)) + 1e-5
    turned, out = (a / size[:, None]) @ rotation(d), []
    for i, (qid, low) in enumerate(zip(q["id"].to_numpy(), q["low"].to_numpy())):
        guess, step = estimates(turned[i], codes, fix, d)
        live = np.flatnonzero((ids != qid) & (guess + error + EPS * step / np.sqrt(12) / fix >= low))
        s = exact(a[i], size[i], x[live], sizes[live])
        live, s = live[s >= low], s[s >= low]
        top = np.lexsort((ids[live], -s))[:k]
        out.append((np.full(len(top), qid), ids[live][top], s[top]))
    return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})


def search(df, every=50, k=5, queries_per_block=32768, rows_per_block=8192):
    """query_id, rank, vec_id, score for the rows of df(vec_id, embedding) whose id is divisible by every."""
    base = valid(df).where("exists(v, x -> x <> 0)")
    n, d = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()

    def low(q, sample):
        a, x, ids = matrix(q["v"].tolist(), d), matrix(sample["v"].tolist(), d), sample["id"].to_numpy()
        size, sizes, out = norms(a), norms(x) if len(x) else np.zeros(0), np.full(len(a), -np.inf)
        for i, qid in enumerate(q["id"].to_numpy()):
            s = exact(a[i], size[i], x[ids != qid], sizes[ids != qid])
            out[i] = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else -np.inf
        return out

    index = base.mapInPandas(encode(d), "id long, v array<double>, code binary, fix double")
    cells = paired(base, index, every, k, n, d, low, queries_per_block, rows_per_block)
    return ranked(cells.applyInPandas(lambda q, c: cell(q, c, d, k), SCHEMA), k)
