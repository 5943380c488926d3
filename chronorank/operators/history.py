"""Histories of sources and counts of destinations, strictly before a time.

edges: src, dst, t (whole seconds, 0 for none) and ord (a tie-break; see ordered). queries: qid, src, t and cands, an array."""
from pyspark.sql import Window
from pyspark.sql import functions as F

NEVER = 1e10


def ordered(edges, *ties):
    """edges with ord: the place within the source by t, dst and ties."""
    return edges.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("t", "dst", *ties)))


def running(edges, length, gap_scale=10.0):
    """edges with hist and gaps: the last destinations before each row, oldest first, padded with zeros on the left, and log gaps."""
    w = Window.partitionBy("src").orderBy("ord").rowsBetween(-length, -1)
    past = F.collect_list(F.struct("dst", "t")).over(w)
    gap = lambda x: F.log1p(F.greatest(F.col("t") - x["t"], F.lit(0))) / gap_scale
    pad = lambda zero, a: F.concat(F.array_repeat(zero, F.lit(length) - F.size("_past")), a)
    out = edges.withColumn("_past", past)
    return out.withColumn("hist", pad(F.lit(0).cast("long"), F.transform("_past", lambda x: x["dst"].cast("long")))).withColumn("gaps", pad(F.lit(0.0), F.transform("_past", gap))).drop("_past")


def last(edges, n):
    """src, dst, t, rk: the n most recent edges of each source, rk 1 being the last."""
    w = Window.partitionBy("src").orderBy(F.desc("ord"))
    return edges.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n).select("src", "dst", "t", "rk")


def as_of(edges, queries, n):
    """qid, rk, dst, t: the n most recent edges of the query's source strictly before its time.

    Edges and queries of a source lie in one order (a query before edges of its own time): one shuffle, running frames."""
    e = edges.select("src", "t", F.lit(1).alias("_kind"), "ord", "dst", F.lit(None).cast("long").alias("qid"))
    q = queries.select("src", "t", F.lit(0).alias("_kind"), F.lit(0).alias("ord"), F.lit(None).cast("long").alias("dst"), F.col("qid").cast("long").alias("qid"))
    w = Window.partitionBy("src").orderBy("t", "_kind", "ord")
    d = e.unionByName(q).withColumn("_n", F.sum("_kind").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    asks = d.where("_kind = 0").select("src", "qid", F.explode(F.sequence(F.greatest(F.col("_n") - n + 1, F.lit(1)), F.col("_n"))).alias("_at"), "_n").where("_n > 0")
    at = d.where("_kind = 1").select("src", (F.coalesce("_n", F.lit(0)) + 1).alias("_at"), "dst", "t")
    return asks.join(at, ["src", "_at"]).select("qid", (F.col("_n") - F.col("_at") + 1).alias("rk"), "dst", "t")


def gap(last_t, t="t"):
    """log(1 + seconds since + 1), and of NEVER without a last time."""
    return F.log1p(F.coalesce((F.col(t) - F.col(last_t) + 1).cast("double"), F.lit(NEVER)))


def recency(edges, asks):
    """qid, pos and six features of asks (qid, pos, src, c, t): log counts of the candidate's edges in 30 and 7 days, their burst,
    log gaps since the candidate, the pair and the source were last seen. Only edges with a time count; strictly before t.

    Edges are summed by key and second, with prefix sums; an ask finds its three borders in that short table by running frames
    over its key: only distinct (key, time) borders are sorted, not one row for each ask."""
    day = 86400
    e = edges.where("t > 0")
    known = asks.where("t > 0")
    sums = e.groupBy("dst", "t").agg(F.count(F.lit(1)).alias("_e")).select(F.col("dst").alias("k"), F.col("t").alias("x"), "_e")
    borders = known.select("c", "t").distinct().select(F.col("c").alias("k"), "t", F.explode(F.array(F.lit(0), F.lit(7), F.lit(30))).alias("d"))
    borders = borders.select("k", F.greatest(F.col("t") - F.col("d") * day, F.lit(0)).alias("x")).distinct()
    w = Window.partitionBy("k").orderBy("x", "_ask").rowsBetween(Window.unboundedPreceding, -1)
    both = sums.withColumn("_ask", F.lit(1)).unionByName(borders.select("k", "x", F.lit(None).cast("long").alias("_e"), F.lit(0).alias("_ask")))
    at = both.withColumn("n", F.coalesce(F.sum("_e").over(w), F.lit(0))).withColumn("last", F.max(F.when(F.col("_e").isNotNull(), F.col("x"))).over(w)).where("_ask = 0").select("k", "x", "n", "last")
    # the three borders of a (candidate, time) meet again by candidate: the same partitioning
    times = known.select(F.col("c").alias("k"), "t").distinct()
    spot = lambda days, n: at.select("k", F.col("x").alias(f"x{days}"), F.col("n").alias(f"n{days}"), *([F.col("last").alias("last_d")] if not days else []))  # noqa: E731, ARG005
    c = times
    for days in (0, 7, 30):
        c = c.withColumn(f"x{days}", F.greatest(F.col("t") - days * day, F.lit(0))).join(spot(days, "n"), ["k", f"x{days}"])
    c = c.select(F.col("k").alias("c"), "t", (F.col("n0") - F.col("n7")).alias("n7"), (F.col("n0") - F.col("n30")).alias("n30"), "last_d")

    def last_of(keys, name):
        """Last edge time of keys (columns of asks, edges) before each distinct (keys, t)."""
        mine, theirs = zip(*keys)
        own = known.select(*mine, "t").distinct().withColumn("_ask", F.lit(0))
        seen = e.select(*[F.col(b).alias(a) for a, b in keys], "t").distinct().withColumn("_ask", F.lit(1))
        v = Window.partitionBy(*mine).orderBy("t", "_ask").rowsBetween(Window.unboundedPreceding, -1)
        return own.unionByName(seen).withColumn(name, F.max(F.when(F.col("_ask") == 1, F.col("t"))).over(v)).where("_ask = 0").select(*mine, "t", name)

    out = asks.join(c, ["c", "t"], "left").join(last_of([("src", "src"), ("c", "dst")], "last_p"), ["src", "c", "t"], "left").join(last_of([("src", "src")], "last_s"), ["src", "t"], "left")
    never = F.log1p(F.lit(NEVER))
    ok = lambda x: F.when(F.col("t") <= 0, never).otherwise(x)
    n7, n30 = F.coalesce("n7", F.lit(0)), F.coalesce("n30", F.lit(0))
    return out.select(
        "qid", "pos", ok(F.log1p(n30)).alias("cnt30"), ok(F.log1p(n7)).alias("cnt7"), ok(F.log1p(n7 + 0.5) - F.log1p(n30 + 0.5)).alias("burst"),
        ok(gap("last_d")).alias("gap_dst"), ok(gap("last_p")).alias("gap_pair"), ok(gap("last_s")).alias("gap_src"),
    )


def transitions(edges, window=16, top=256):
    """a, b, w, rk: successors of a within so many steps, weighted 1 / sqrt(steps); top of each (None: all). Lags, no self-join."""
    w = Window.partitionBy("src").orderBy("ord")
    back = F.array(*[F.struct(F.lag("dst", i).over(w).alias("a"), F.lit(1 / i**0.5).alias("w")) for i in range(1, window + 1)])
    steps = edges.select(F.col("dst").alias("b"), back.alias("_back")).select("b", F.explode("_back").alias("x")).where("x.a is not null and x.a <> b")
    sums = steps.groupBy("x.a", "b").agg(F.sum("x.w").alias("w"))
    ranked = sums.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("w", 6)), "b")))
    return ranked if top is None else ranked.where(F.col("rk") <= top)


def sorted_by_time(edges, order):
    """One row: how many neighbours in the given order step back in time, and the first place where that happens.

    The order is cut into ranges, so that no single task sees all rows; ranges are compared by their borders."""
    d = edges.select(F.col(order).alias("o"), "t").withColumn("_r", F.floor(F.col("o") / 65536))
    w = Window.partitionBy("_r").orderBy("o")
    inside = d.withColumn("_p", F.lag("t").over(w)).where("_p > t").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("at"))
    ends = d.groupBy("_r").agg(F.min(F.struct("o", "t")).alias("a"), F.max(F.struct("o", "t")).alias("b"))
    border = ends.withColumn("_p", F.lag("b.t").over(Window.orderBy("_r"))).where("_p > a.t").agg(F.count(F.lit(1)).alias("n"), F.min("a.o").alias("at"))
    return inside.unionByName(border).agg(F.sum("n").alias("violations"), F.min("at").alias("first"))
