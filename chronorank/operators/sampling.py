"""Samples, negatives and candidate lists. Randomness comes from hashes of keys: reruns and other engines agree."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronorank.functions.hashing import draw, uniform


def numbered(rows, t, *ties, name="place", unit=86400):
    """rows with their place from 0 in the order of t and ties: places inside a unit of t, shifted by the rows of the units before."""
    d = rows.withColumn("_unit", F.floor(F.col(t) / unit))
    before = d.groupBy("_unit").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("_unit").orderBy(t, *ties)) - 1
    return d.withColumn("_in", place).join(before, "_unit").withColumn(name, F.col("_before") + F.col("_in")).drop("_unit", "_in", "_before")


def evenly(rows, k, t, *ties):
    """k rows spread evenly over the order of t and ties (place floor(i * (n - 1) / (k - 1))); all of them, if there are no more."""
    n = rows.count()
    if n <= k:
        return rows
    places = rows.sparkSession.range(k).select(F.expr(f"id * {n - 1}L div {max(k - 1, 1)}L").alias("place")).distinct()
    return numbered(rows, t, *ties).join(F.broadcast(places), "place").drop("place")  # k is a parameter


def permuted(rows, key, k, seed=0):
    """k rows, the first in the order of hashed keys."""
    return rows.withColumn("_u", uniform(*key, seed=seed)).orderBy("_u", *key).limit(k).drop("_u")


def per_group(rows, by, key, k, seed=0, weight=None):
    """k rows of each group without replacement: by hashed keys, or by log(u) / weight where rows weigh differently."""
    u = uniform(*by, *key, seed=seed)
    rank = F.desc(F.log((u * (1 << 20) + 1) / (1 << 21)) / F.col(weight)) if weight else u
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(rank, *key))).where(F.col("rk") <= k)


def by_weight(items, weight, draws, key, seed=0, cells=1024):
    """draws with item: one of items (id, whole weight) for each row of draws, with replacement, by search in the running weights.

    The weights' range is cut into cells; an item stands in every cell that it reaches into, so that a draw finds the last item
    that began before it within its own cell."""
    d = items.select("id", F.col(weight).cast("long").alias("_w")).where("_w > 0").withColumn("_unit", F.floor(F.col("id") / 65536))
    w = Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("_unit").agg(F.sum("_w").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    inside = F.sum("_w").over(Window.partitionBy("_unit").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    steps = d.withColumn("_to", inside).join(before, "_unit").select("id", (F.col("_before") + F.col("_to") - F.col("_w")).alias("_from"), (F.col("_before") + F.col("_to")).alias("_to"))
    total = d.agg(F.sum("_w")).first()[0] or 0
    width = max(1, -(-total // cells))
    held = steps.select("id", "_from", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))).alias("_cell"))
    held = held.select("_cell", F.greatest(F.col("_from"), F.col("_cell") * width).alias("_x"), F.lit(0).alias("_k"), F.col("id").cast("long").alias("_id"))
    asked = draws.withColumn("_x", F.floor(uniform(*key, seed=seed) * total).cast("long"))
    asked = asked.withColumns({"_cell": F.floor(F.col("_x") / width), "_k": F.lit(1), "_id": F.lit(None).cast("long")})
    # each draw goes to its cell and keeps its columns: dealt once, nothing is joined back
    last = F.last("_id", ignorenulls=True).over(Window.partitionBy("_cell").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0))
    return asked.unionByName(held, allowMissingColumns=True).withColumn("item", last).where("_k = 1").select(*draws.columns, "item")


def uniform_negatives(positives, top, n, key, seed=0, tries=4):
    """positives (dst) with pos and neg: n distinct-slot draws from 1 .. top that miss the positive; a draw that hits it is made again."""
    slots = positives.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = [draw(top, *key, F.col("pos"), F.lit(i), seed=seed) + 1 for i in range(tries)]
    neg = draws[-1]
    for d in reversed(draws[:-1]):
        neg = F.when(d == F.col("dst"), neg).otherwise(d)
    return slots.withColumn("neg", F.when(neg == F.col("dst"), F.pmod(neg, F.lit(top)) + 1).otherwise(neg))


def unseen(spark, items, top):
    """Ids of 1 .. top that items (id) do not hold."""
    return spark.range(1, top + 1).join(items.select("id"), "id", "left_anti")


def pooled(sources, limit, by="qid"):
    """by, c, prio, rk: candidates of several sources (by, c, rk), each cut to its own limit; of one seen twice the first source counts;
    limit in all. sources: [(rows, own limit)] in the order of priority."""
    rows = None
    for prio, (source, own) in enumerate(sources):
        part = source.where(F.col("rk") <= own).select(by, "c", F.lit(prio).alias("prio"), "rk")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(by, "c").agg(F.min(F.struct("prio", "rk")).alias("x")).select(by, "c", "x.prio", "x.rk")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("prio", "rk", "c"))).where(F.col("place") <= limit)


def templates(edges, queries):
    """edges with tmpl: a query row of the edge's source, in turn by the edge's place; any query, by hash, where the source has none."""
    own = queries.select("src", F.col("qid").alias("tmpl"), (F.row_number().over(Window.partitionBy("src").orderBy("qid")) - 1).alias("_i"))
    sizes = own.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    d = edges.join(sizes, "src", "left").withColumn("_i", F.pmod(F.col("ord") - 1, F.col("_n")))
    d = d.join(own, ["src", "_i"], "left").drop("_i", "_n")
    every = queries.select(F.col("qid").alias("_any"), (F.row_number().over(Window.orderBy("qid")) - 1).alias("_at"))  # one number for each query
    n = queries.count()
    return d.withColumn("_at", draw(max(n, 1), F.col("src"), F.col("ord"))).join(every, "_at", "left").withColumn("tmpl", F.coalesce("tmpl", "_any")).drop("_at", "_any")


def distinct_draws(draws, by, item, order, n):
    """by, item, place: the first n distinct items of each group in the order of its draws. Drawn by weight, this is weighted sampling
    without replacement; a group whose draws hold fewer distinct items has fewer."""
    first = draws.groupBy(*by, item).agg(F.min(order).alias("_o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_o"))).where(F.col("place") <= n).drop("_o")


def mixture(positives, items, weight, top, width=100, surplus=4, seed=0):
    """qid, c, kind: lists of the positive, n_unseen ids of 1 .. top that items lack, and seen items by weight, all distinct.

    positives: qid, dst, n_unseen (null: none). Seen and unseen ids are drawn with surplus and the first distinct ones are kept;
    the positive is left out of the draws."""
    spark = positives.sparkSession
    asks = positives.select("qid", "dst", F.coalesce("n_unseen", F.lit(0)).alias("k"))
    slots = lambda n: asks.select("qid", F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("j"))
    seen = by_weight(items, weight, slots(surplus * width), ["qid", "j"], seed=seed)
    # by list from here on: draws are dealt once more, and the positives and sizes meet them there
    own = asks.groupBy("qid").agg(F.collect_set("dst").alias("_own"))
    seen = seen.repartition("qid").hint("merge").join(own, "qid").where(F.col("item").isNull() | ~F.coalesce(F.array_contains("_own", F.col("item")), F.lit(False))).drop("_own")
    seen = distinct_draws(seen, ["qid"], "item", "j", width - 1).hint("merge").join(asks, "qid").where(F.col("place") <= width - 1 - F.col("k")).select("qid", F.col("item").alias("c"), F.lit("seen").alias("kind"))
    pool = numbered(unseen(spark, items, top), "id", name="_at", unit=65536)
    size = pool.count()
    # the first distinct draws of a list within its row, and only those meet the pool: places and ids are one to one
    places = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(surplus * width - 1).cast("long")), lambda j: draw(max(size, 1), F.col("qid"), j, seed=seed + 1)))
    cold = asks.where("k > 0").select("qid", F.explode(F.slice(places, 1, F.least(F.col("k"), F.lit(width)).cast("int"))).alias("_at"))
    cold = cold.hint("merge").join(pool, "_at").select("qid", F.col("id").alias("c"), F.lit("unseen").alias("kind"))
    return asks.select("qid", F.col("dst").alias("c"), F.lit("positive").alias("kind")).unionByName(seen).unionByName(cold)


def neighbour_negatives(positives, table, history, n, key, seed=0):
    """positives (src, dst) with neg: n hashed ones of the neighbours (a, b) of the positive that its source has never met."""
    d = positives.join(table.select(F.col("a").alias("dst"), F.col("b").alias("neg")), "dst")
    d = d.join(history.select("src", F.col("dst").alias("neg")).distinct(), ["src", "neg"], "left_anti")
    return d.withColumn("rk", F.row_number().over(Window.partitionBy(*key).orderBy(uniform(*key, "neg", seed=seed), "neg"))).where(F.col("rk") <= n)


def heaviest(queries, items, n, k, seed=0, parts=16):
    """qid, id, rk: for each query the k items of its residue r with the largest log(draw) / weight, a draw above 2^-21 and at most about
    a half from the MD5 of seed, qid and id; ties to the smaller id.

    queries: qid, r; items: id, n, r. No draw can lift an item above log(1/2) / weight: items are drawn by falling weight, and a query
    ends once its k-th place lies above that of the next weight. Only a query whose weights are all alike draws them all."""
    import numpy as np
    import pandas as pd

    def cell(q, x):
        from hashlib import md5

        from chronorank.plans.slots import rounded

        x = x.sort_values([n, "id"], ascending=[False, True])
        ids, w = x["id"].to_numpy(), x[n].to_numpy(np.float64)
        names = [str(i).encode() for i in ids.tolist()]
        most = np.append(np.log(((1 << 20) + 1) / (1 << 21)) / w, -np.inf) if len(w) else np.zeros(0)
        out = []
        for qid, copies in zip(*np.unique(q["qid"].to_numpy(), return_counts=True)):
            head, at, size = f"{seed}:{qid}:".encode(), 0, 512
            best, key = np.zeros(0, np.int64), np.zeros(0)
            while at < len(ids) and (len(best) < k or key[-1] <= most[at] + 1e-11):
                to = min(at + size, len(ids))
                raw = np.frombuffer(b"".join([md5(head + i).digest() for i in names[at:to]]), np.uint8).reshape(-1, 16)[:, :6]
                u = (raw.astype(np.int64) << np.arange(40, -1, -8)).sum(1) / float(1 << 48)
                key = np.append(key, rounded(np.log((u * (1 << 20) + 1) / (1 << 21)) / w[at:to], 12))
                best = np.append(best, ids[at:to])
                order = np.lexsort((best, -key))[:k]
                best, key, at, size = best[order], key[order], to, min(2 * size, 1 << 16) if at else 128
            best = np.repeat(best, copies)[:k]
            out.append((np.full(len(best), qid), best, np.arange(1, len(best) + 1)))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j, c in enumerate(("qid", "id", "rk"))})

    q = queries.where("qid is not null").select("qid", F.col("r").cast("long").alias("r"), F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("part"))
    x = items.where("id is not null").select("id", n, F.col("r").cast("long").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return q.groupBy("r", "part").cogroup(x.groupBy("r", "part")).applyInPandas(cell, "qid long, id long, rk long")
