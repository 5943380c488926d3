"""Keyed, bounded history as streaming state, and a feedback loop over micro-batches.

The history of a source is a sequence of at most length (dst, t), oldest first. A stream appends its edges batch by batch;
the order of edges within a batch is their order by (t, ord). The batch boundary is part of the meaning: what a batch adds is
seen by the next one. Late edges (older than the last of the source) are appended as they come, and counted."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE, BUCKETS = "data binary", 4096
OUT = T.StructType([T.StructField("src", T.LongType()), T.StructField("late", T.LongType()), T.StructField("hist", T.ArrayType(T.StructType([T.StructField("dst", T.LongType()), T.StructField("t", T.LongType())])))])


def appended(hist, late, rows, length):
    """(history, late edges) after rows of (t, ord, dst); edges without a time (0) count for neither."""
    hist = list(hist)
    for t, _, dst in sorted(rows):
        if t <= 0:
            continue
        late += bool(hist) and t < hist[-1][1]
        hist.append((dst, t))
    return hist[-length:], late


def merged(state, rows, length):
    """appended() for all sources of a bucket at once: (state, touched). state: src, late, n, dst, t, where n items of each source
    stand one after the other; rows: src, t, ord, dst of a batch; touched: which sources of the new state the batch has."""
    import numpy as np

    src, late, n, dst, t = state
    new_src, new_t, new_ord, new_dst = rows
    ids, at = np.unique(np.concatenate([src, new_src]), return_inverse=True)
    old, new = at[: len(src)], at[len(src) :]
    touched, counts, ends = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    touched[new], counts[old] = True, late
    ends[old] = np.where(n > 0, np.append(t, 0)[np.cumsum(n) - 1], 0)
    ok = new_t > 0
    new, new_t, new_ord, new_dst = new[ok], new_t[ok], new_ord[ok], new_dst[ok]
    order = np.lexsort((new_dst, new_ord, new_t, new))
    new, new_t, new_dst = new[order], new_t[order], new_dst[order]
    lead = np.append(True, new[1:] != new[:-1])[: len(new)]
    counts[new[lead]] += new_t[lead] < ends[new[lead]]  # the rows after a source's first are in order
    who = np.concatenate([np.repeat(old, n), new])
    order = np.argsort(who, kind="stable")
    who, dst, t = who[order], np.concatenate([dst, new_dst])[order], np.concatenate([t, new_t])[order]
    size = np.bincount(who, minlength=len(ids))
    keep = np.cumsum(size)[who] - np.arange(len(who)) <= length
    return (ids, counts, np.minimum(size, length), dst[keep], t[keep]), touched


def histories(stream, length):
    """src, late, hist after each micro-batch, for the sources that it touched (update mode).

    Sources share the state of a bucket: a call serves some hundred of them, and a batch writes the buckets that it touches anew."""
    import numpy as np
    import pandas as pd

    def step(key, frames, state):
        data = np.frombuffer(state.get[0], np.int64) if state.exists else np.zeros(1, np.int64)
        k = int(data[0])
        head, rest = data[1 : 1 + 3 * k].reshape(3, k), data[1 + 3 * k :].reshape(2, -1)
        rows = [np.concatenate(c) for c in zip(*[[f[c].to_numpy(np.int64) for c in ("src", "t", "ord", "dst")] for f in frames])]
        now, touched = merged((*head, *rest), rows, length)
        state.update((np.concatenate([[len(now[0])], *now]).astype(np.int64).tobytes(),))
        items = [{"dst": d, "t": t} for d, t in zip(now[3].tolist(), now[4].tolist())]
        ends = np.cumsum(now[2])
        hist = [items[e - n : e] for e, n in zip(ends[touched].tolist(), now[2][touched].tolist())]
        src = pd.array([None] * len(hist) if key[0] < 0 else now[0][touched], dtype="Int64")
        yield pd.DataFrame({"src": src, "late": now[1][touched], "hist": hist})

    d = stream.select(F.coalesce("src", F.lit(0)).cast("long").alias("src"), F.coalesce("t", F.lit(0)).cast("long").alias("t"), F.col("ord").cast("long").alias("ord"), F.col("dst").cast("long").alias("dst"), F.when(F.col("src").isNull(), -1).otherwise(F.pmod(F.xxhash64("src"), F.lit(BUCKETS))).cast("int").alias("_b"))
    return d.groupBy("_b").applyInPandasWithState(step, OUT, T.StructType.fromDDL(STATE), "update", "NoTimeout")


def replayed(spark, path, schema, out, checkpoint, length, files=1):
    """Runs the stream of edge files below path to its end, so many files a micro-batch; the state's updates go to out with their batch.

    A run that was cut off goes on where its checkpoint ends; a batch that is done again overwrites its own folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

    def sink(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{batch:06d}")

    query = histories(stream, length).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/*")


def latest(updates):
    """src, late, hist: the last state of each source."""
    return updates.groupBy("src").agg(F.max_by(F.struct("late", "hist"), "batch").alias("x")).select("src", "x.late", "x.hist")


def gated(scored, margin=1.0, k=1, top1=0.0, unknown=None):
    """src, dst, t of what a scored batch feeds back: rows whose best softmax share leads the second by margin and reaches top1 give
    their k best candidates at the row's time; rows without a time give nothing, the unknown id is skipped.

    scored: qid, src, t, cands, scores."""
    from chronorank.functions import rows as R

    d = scored.withColumn("p", R.softmax(F.col("scores"))).where((F.col("t") > 0) & (R.margin(F.col("p")) >= margin) & (F.array_max("p") >= top1))
    order = F.slice(F.array_sort(F.transform(F.arrays_zip(F.col("scores").alias("s"), F.col("cands").alias("c")), lambda x, i: F.struct((-x["s"]).alias("s"), i.alias("i"), x["c"].alias("c")))), 1, k)
    out = d.select("qid", "src", "t", F.posexplode(order).alias("rk", "x")).select("qid", "src", (F.col("rk") + 1).alias("rk"), F.col("x.c").alias("dst"), "t")
    return out if unknown is None else out.where(F.col("dst") != unknown)
