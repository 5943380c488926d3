"""Row operators over the candidates of one query, held as an array: no shuffle, whatever their number.

Every function takes columns of arrays (same length, position = slot) and returns such a column, or a scalar where it says so."""
from pyspark.sql import functions as F


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(a))


def _std(a, mean):
    """Population standard deviation."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean), lambda s: s / F.size(a)))


def bound(value, use):
    """use(x) with x bound to value, which is so computed once, not once for each element."""
    return F.transform(F.array(value), use)[0]


def zscore(a, floor=1e-6, replace=True):
    """(x - mean) / std; a std below floor counts as 1 (replace) or as floor."""
    scaled = lambda m, s: F.transform(a, lambda x: (x - m) / (F.when(s >= floor, s).otherwise(1.0) if replace else F.greatest(s, F.lit(floor))))
    return bound(_mean(a), lambda m: bound(_std(a, m), lambda s: scaled(m, s)))


def softmax(a, temperature=1.0):
    """Shares of exp(x / temperature), shifted by the largest; the temperature is 1e-6 at least, sums 1e-12."""
    t = max(temperature, 1e-6)
    e = bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / t)))
    return bound(e, lambda v: bound(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(v, lambda x: x / F.greatest(s, F.lit(1e-12)))))


def minmax(a, low=0.01, span=0.99, flat=0.5):
    """low .. low + span by the row's smallest and largest; flat where they are equal."""
    lo, hi = F.array_min(a), F.array_max(a)
    return bound(lo, lambda x0: bound(hi, lambda x1: F.transform(a, lambda x: F.when(x1 == x0, flat).otherwise(low + span * (x - x0) / (x1 - x0)))))


def _ranked(keys, rank):
    """Gives every slot rank(place from 0 in the order of keys, entry): keys are structs that end with the slot i."""
    placed = F.transform(F.array_sort(keys), lambda x, r: F.struct(x["i"].alias("i"), rank(r, x).alias("r")))
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def percentile(a, ids=None):
    """Ordinal rank ascending over the number of candidates; ties by slot, or by ids and then slot."""
    keys = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))) if ids is None else F.transform(F.arrays_zip(a.alias("x"), ids.alias("c")), lambda x, i: F.struct(x["x"].alias("x"), x["c"].alias("c"), i.alias("i")))
    return _ranked(keys, lambda r, _: (r + 1) / F.size(a).cast("double"))


def ordinal(a):
    """1 / ordinal rank descending, ties by slot."""
    return _ranked(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))), lambda r, _: 1.0 / (r + 1))


def competition(a):
    """1 / (1 + number of greater ones): ties share a rank."""
    keys = F.array_sort(F.transform(a, lambda x: -x))
    return F.transform(a, lambda x: 1.0 / F.array_position(keys, -x))


def first_best(a):
    """Slot of the first largest (scalar)."""
    return F.array_position(a, F.array_max(a)) - 1


def margin(p):
    """Largest less second largest (scalar)."""
    s = F.sort_array(p, asc=False)
    return s[0] - s[1]


def probabilities(p, places=8):
    """Clipped to 0..1, divided by their sum (all alike if that is not positive), rounded; what is missing to 1 goes to the first largest."""
    clipped = F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    share = bound(clipped, lambda v: bound(total(v), lambda s: F.transform(v, lambda x: F.round(F.when(s > 0, x / s).otherwise(1.0 / F.size(p)), places))))
    fixed = lambda v: F.transform(v, lambda x, i: F.when(i == first_best(v), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + (1.0 - total(v)))), places)).otherwise(x))
    return bound(share, fixed)


def line(a, fmt="%.8f"):
    """The numbers as one line of text, joined by commas (scalar)."""
    return F.array_join(F.transform(a, lambda x: F.format_string(fmt, x)), ",")


def pearson(a, b):
    """Correlation of two rows; null where one of them does not vary (scalar)."""
    def of(ma, mb):
        both = F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))
        cov = F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        return F.when((_std(a, ma) > 1e-9) & (_std(b, mb) > 1e-9), cov / _std(a, ma) / _std(b, mb))

    return bound(_mean(a), lambda ma: bound(_mean(b), lambda mb: of(ma, mb)))
