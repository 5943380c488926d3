"""Vectors as arrays of doubles: built-in functions only."""
from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))


def unit(a, eps=1e-12):
    """a / |a|; a vector shorter than eps stays as it is."""
    return F.transform(a, lambda x: x / F.when(norm(a) > eps, norm(a)).otherwise(1.0))


def cosine(a, b, eps=1e-12):
    return F.when((norm(a) > eps) & (norm(b) > eps), dot(a, b) / norm(a) / norm(b)).otherwise(0.0)


def top_mean(a, k=5):
    """Mean of the k largest (of all, if fewer)."""
    s = F.slice(F.sort_array(a, asc=False), 1, k)
    return F.aggregate(s, F.lit(0.0), lambda t, x: t + x) / F.greatest(F.size(s), F.lit(1))


def mean(rows, by, vec="vec", weight=None):
    """by, vec: the (weighted) mean of the vectors of each group. One row for each component: no group is gathered in one place."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = rows.select(*by, w.alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    means = parts.groupBy(*by, "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias(vec))
