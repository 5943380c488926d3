"""Rows dealt to partitions as packed arrays: a blob for each partition and each chunk of rows, taken apart by whole arrays there.

A row of a few numbers costs some eighty bytes in a shuffle of rows, and in a blob what its numbers need. A partition's blobs are
held in one task's memory: a hot key is one task. Ids may be any longs; rows that miss a key stay away."""
import pickle

from pyspark.sql import functions as F

EACH = 1_500_000
KIND = "at long, kind int, data binary"


def parts(rows, each=None):
    """How many partitions so many rows are dealt to."""
    return max(2, -(-rows // (each or EACH)))


def salts(spark, n):
    """For each of n partitions a number that repartition(n, column) sends there."""
    got = {}
    for r in spark.range(60 * n + 100).select("id", F.expr(f"pmod(hash(id), {n})").alias("p")).collect():
        got.setdefault(r.p, r.id)
    return [got[i] for i in range(n)]


def narrow(x):
    """(least, x - least in as few bytes as hold it); of floats (their few values, places in them)."""
    import numpy as np

    if not len(x):
        return 0, x
    if x.dtype.kind == "f":
        few, at = np.unique(x, return_inverse=True) if x.ndim == 1 else ((), None)
        return (few, at.astype(np.uint16)) if 0 < len(few) < 1 << 16 and len(few) * 8 < len(x) else (0, x)
    low, high = int(x.min()), int(x.max())
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if high - low <= np.iinfo(k).max), None)
    return (low, (x - low).astype(kind)) if kind else (0, x)


def pack(**cols):
    return pickle.dumps({k: narrow(v) for k, v in cols.items()}, 5)


def unpack(data):
    import numpy as np

    return {k: low[x] if np.ndim(low) else x if x.dtype.kind == "f" else x.astype(np.int64) + low for k, (low, x) in pickle.loads(data).items()}


def chunks(batches, rows=1_000_000):
    """Arrow batches put together to tables of some rows."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def split(bucket, n):
    """(order, bounds): rows of bucket i are order[bounds[i]:bounds[i + 1]], in their order."""
    import numpy as np

    order = np.argsort(bucket.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(bucket, minlength=n)))


def blobs(rows, kind, at):
    """A batch of (partition, packed data) pairs."""
    import pyarrow as pa

    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([at[i] for i, _ in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["at", "kind", "data"])


def cut(cols, bucket, n, kind, at):
    """Blobs of the rows of cols, an array by name, by their bucket."""
    order, bounds = split(bucket, n)
    return blobs(((i, pack(**{k: v[order[bounds[i] : bounds[i + 1]]] for k, v in cols.items()})) for i in range(n) if bounds[i] < bounds[i + 1]), kind, at)


def dealt(df, by, kind, at, bucket=None):
    """Blobs of df's rows, numbers without nulls, by the column by (or what bucket gives of it)."""
    n, names = len(at), df.columns

    def run(batches):
        for t in chunks(batches):
            cols = {c: t.column(c).to_numpy() for c in names}
            yield cut(cols, bucket(cols[by]) if bucket else cols[by] % n, n, kind, at)

    return df.mapInArrow(run, KIND)


def gathered(batches, *kinds):
    """For each kind its blobs as one array by name; the last kind as a list of packed data."""
    import numpy as np

    held = {k: [] for k in kinds}
    for b in batches:
        for k, d in zip(b.column(1).to_pylist(), b.column(2)):
            held[k].append(d.as_py())
    out = []
    for k in kinds[:-1]:
        all_ = [unpack(d) for d in held.pop(k)]
        out.append({c: np.concatenate([x.pop(c) for x in all_]) for c in list(all_[0])} if all_ else {})
    return [*out, held[kinds[-1]]]


def place(known, x):
    """Place of x in known, sorted and distinct; -1 where it is not there."""
    import numpy as np

    if not len(known):
        return np.full(len(x), -1)
    j = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[j] == x, j, -1)
