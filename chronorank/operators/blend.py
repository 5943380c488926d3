"""Fusion of rows of scores, and their evaluation. Rows are arrays, a slot for each candidate; label is the positive's slot."""
from functools import reduce

from pyspark.sql import functions as F

from chronorank.functions import rows as R


def weighted(members):
    """Sum of weight * row over [(column, weight)]."""


    def times(column, weight):
        return F.transform(column, lambda x: x * weight)

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [times(c, w) for c, w in members])


def rank_blend(members):
    """Sum of weight * percentile rank; the weights have to add up to 1."""
    if abs(sum(w for _, w in members) - 1) > 1e-6:
        raise ValueError("the weights of a blend add up to 1")
    return weighted([(R.percentile(c), w) for c, w in members])


def residual(anchor, score, w):
    """anchor + w * (score - anchor)."""
    return F.zip_with(anchor, score, lambda a, s: a + w * (s - a))


def calibrated(score, profile, w):
    """z(score) + w * z(profile)."""
    return weighted([(R.zscore(score), 1.0), (R.zscore(profile), w)])


def placed(s, label, use):
    """use(above, equal): how many candidates score above the positive, and how many others as high (within 1e-12)."""
    above = lambda v, own: F.size(F.filter(v, lambda x: x > own + 1e-12)).cast("double")
    equal = lambda v, own: (F.size(F.filter(v, lambda x: F.abs(x - own) <= 1e-12)) - 1).cast("double")
    return R.bound(s, lambda v: R.bound(F.element_at(v, label.cast("int") + 1), lambda own: use(above(v, own), equal(v, own))))


def reciprocal(s, label, ties="half"):
    """Reciprocal rank of the positive: ties count half, all (pessimistic) or not (strict)."""
    return placed(s, label, lambda above, equal: 1.0 / (1.0 + above + {"half": 0.5, "pessimistic": 1.0, "strict": 0.0}[ties] * equal))


def strict(rows, s, label):
    """One row: strict MRR, Hit@1, Hit@10 and the median rank."""
    rows, above = rows.select(placed(F.col(s), F.col(label), lambda above, _: above).alias("_above")), F.col("_above")
    hit = lambda k: F.avg(F.when(above < k, 1.0).otherwise(0.0)).alias(f"hit{k}")
    return rows.agg(F.avg(1.0 / (1.0 + above)).alias("mrr"), hit(1), hit(10), F.median(above + 1.0).alias("median_rank"))


def over_sets(rows, s, label, name="set_name", weight="set_weight"):
    """One row: the mean of the sets' MRR, weighted by set."""
    each = rows.groupBy(name, weight).agg(F.avg(reciprocal(F.col(s), F.col(label))).alias("m"))
    return each.agg((F.sum(F.col(weight) * F.col("m")) / F.sum(weight)).alias("mrr"))


def grid(rows, features, label, weights, names=None):
    """name, value and MRR of each single change of the linear score sum(weights[name] * z(name)): all changes in one pass.

    features: columns of z-scored rows. weights: {name: weight}; GRID is tried for each of names (all features, by default)."""
    base = [(F.col(f), float(weights.get(f, 0.0))) for f in features]
    tried = [F.struct(F.lit(f).alias("name"), F.lit(float(v)).alias("value"), reciprocal(weighted([(c, float(v) if g == f else w) for (c, w), g in zip(base, features)]), F.col(label)).alias("r")) for f in names or features for v in GRID]
    return rows.select(F.explode(F.array(*tried)).alias("x")).groupBy("x.name", "x.value").agg(F.avg("x.r").alias("mrr"))


# The weights that a search tries.
GRID = (-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0, 2.0)


def descend(rows, features, label, start, rounds=3):
    """(weights, MRR): from start, the best value of one feature after the other, as long as the MRR grows by more than 1e-8."""
    weights, best, rows = dict(start), -1.0, rows.select(label, *features).persist()
    try:
        for _ in range(rounds):
            changed = False
            for f in features:
                tried = {r["value"]: r["mrr"] for r in grid(rows, features, label, weights, [f]).collect()}
                value = max(sorted(tried), key=lambda v: tried[v])
                if tried[value] > best + 1e-8:
                    best, changed = tried[value], changed or weights.get(f, 0.0) != value
                    weights[f] = value
            if not changed:
                break
        return weights, best
    finally:
        rows.unpersist()


def compared(rows, a, b):
    """One row: top-1 agreement, mean top-3 Jaccard, mean row correlation, mean absolute difference, and whether both pass."""
    top = lambda s: F.transform(F.slice(F.array_sort(F.transform(s, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 3), lambda y: y["i"])
    rows = rows.withColumns({"_ta": top(F.col(a)), "_tb": top(F.col(b))})
    ta, tb = F.col("_ta"), F.col("_tb")
    jac = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    mad = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    out = rows.agg(F.avg(F.when(R.first_best(F.col(a)) == R.first_best(F.col(b)), 1.0).otherwise(0.0)).alias("top1"), F.avg(jac).alias("jaccard"), F.avg(R.pearson(F.col(a), F.col(b))).alias("pearson"), F.avg(mad).alias("mad"))
    return out.withColumn("pass", (F.col("top1") > 0.99) & (F.col("pearson") > 0.99))
