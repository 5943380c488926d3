"""What several operators need: settled tables, checked broadcasts, connected components, workers that give memory back."""
import functools
import uuid

from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def folder(spark):
    """A new place below the shared folder that the session names; without one, below a temporary folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df):
    """The same rows written to the shared folder and read again: lineage ends here."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def guarded(docs, uses, change):
    """change(docs) with the columns that it does not use (uses may name columns that docs lacks) under names that cannot clash; the same columns come back."""
    away = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in uses}
    out = change(docs.withColumnsRenamed(away))
    return out.select(*[out[away.get(c, c)].alias(c) for c in docs.columns])


def small(df, rows=BROADCAST_ROWS):
    """df, marked for broadcast if it has at most so many rows (of a few ids, by default)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trimmed(run):
    """run, a function of batches: its worker, which lives on beside those of later stages, gives free memory back as the task ends."""

    @functools.wraps(run)
    def whole(batches):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return whole


def merged(batches, size=4096):
    """The frames of batches put together to about so many rows."""
    import pandas as pd

    held = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= size:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def short_batches(spark, rows=1000, size=4 << 20):
    """Sends texts to Python in batches of at most so many rows and bytes: both sides, and the JVM's pool of buffers, hold whole batches."""
    for key, n in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= n:
            spark.conf.set(key, str(n))


def pieces(rows, columns, size=1 << 15):
    """Frames of at most so many rows of an iterable of tuples: none holds all of them."""
    import itertools

    import pandas as pd

    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield pd.DataFrame(some, columns=columns)


def components(links):
    """node, component (its smallest node) for links (a, b), by alternating large and small stars."""
    edges = settled(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct())
    while True:
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(low, "u").selectExpr("case when v = m then u else v end as u", "m as v").where("u <> v").distinct()
        after = settled(after)
        same = after.count() == edges.count() and not after.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if same:
            break
    return edges.selectExpr("u as node", "v as component").union(edges.selectExpr("v as node", "v as component").distinct())
