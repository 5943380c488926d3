"""Mixing sources to target weights by capped water-filling.

Sources (by code point, null last) weigh 1, 2, 3, repeating, and share the words of all; a target above cap times its
source's size is clamped there and the excess is shared again by weight until none is above. A document is repeated
floor(target / size) times; the rest is one more repetition of the documents first in a seeded order of hashes, up to the
words still missing. Where a source's order is cut is found by prefix sums: over ranges of hashes first, then inside the
range that holds the cut; the documents themselves are not shuffled.

Null or empty texts have size 0 and take 0; a source of such texts only has target 0; an empty table gives no rows;
repeated rows are separate documents with one hash: if the cut falls among them, as many of them as needed are taken,
whichever; very long texts are counted whole. Other columns, whatever their names, pass through mix(), but for those named
like one of its results."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronorank.llm.shared import settled

CAP, RANGE_BITS = 3, 12
RESULTS = ("size", "source_size", "target", "reps", "taken")


def sizes(docs):
    """docs with size: the pieces between white space, less the empty ones at a text's ends."""
    t = F.coalesce("text", F.lit(""))
    ends = F.substring(t, 1, 1).rlike(r"[\x20\x09-\x0D]").cast("int") + F.substring(t, -1, 1).rlike(r"[\x20\x09-\x0D]").cast("int")
    return docs.withColumn("size", F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+")) - ends).cast("long"))


def targets(sized):
    """source, source_size, target. One row per source reaches the driver: sources are named data sets, not rows."""
    return fill([(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()])


def fill(rows):
    """(source, size, target) of (source, size): weights 1, 2, 3, repeating, in the order of the sources."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    left, open_, out = float(sum(n for _, n in rows)), {i: i % 3 + 1 for i in range(len(rows))}, {}
    while open_:
        share = left / sum(open_.values())
        over = [i for i, w in open_.items() if share * w > CAP * rows[i][1]]
        if not over:
            out |= {i: share * w for i, w in open_.items()}
            break
        for i in over:
            out[i] = float(CAP * rows[i][1])
            left -= out[i]
            del open_[i]
    return [(s, int(n), out[i]) for i, (s, n) in enumerate(rows)]


def cuts(slim, plan):
    """Rows (source, hash, rows): in hash order, documents below the hash have one more repetition, and so many rows that have it."""
    spark = slim.sparkSession
    need = spark.createDataFrame([(s, t - t // n * n if n else 0.0) for s, n, t in plan], "_s string, missing double")
    d = slim.join(F.broadcast(need), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("range", F.shiftright("_h", 64 - RANGE_BITS))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "missing", "range").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    # the first range that is not taken whole: its own documents decide
    first = Window.partitionBy("source").orderBy("range")
    edge = settled(sums.where("before + n > missing").withColumn("i", F.row_number().over(first)).where("i = 1").select(F.col("source").alias("_s"), F.col("range").alias("_r"), "before"))
    inside = d.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    alike = inside.groupBy("source", "missing", "before", "_h").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
    v = Window.partitionBy("source").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("rows") * F.col("size")).over(v), F.lit(0))
    take = F.when(F.col("size") > 0, F.least("rows", F.greatest(F.lit(0), F.floor((F.col("missing") - start) / F.col("size") + 0.5)))).otherwise(F.col("rows"))
    short = alike.withColumn("take", take).where("take < rows").withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("_h"))).where("i = 1")
    at = {r[0]: (r[1], r[2]) for r in short.select("source", "_h", "take").collect()}
    # where the whole range is taken after all, the next one begins the rest
    ends = {r[0]: r[1] + 1 << 64 - RANGE_BITS for r in edge.select("_s", "_r").collect()}
    return [(s, *at.get(s, (h, 0))) for s, h in ends.items() if s in at or h < 1 << 63]


def mix(docs, seed=17):
    """docs with size, source_size, target, reps (whole and fractional repetitions) and taken."""
    spark, kept = docs.sparkSession, [c for c in docs.columns if c not in RESULTS]
    away = {c: f"_kept_{i}" for i, c in enumerate(kept) if c not in ("doc_id", "text", "source")}
    d = sizes(docs.select(*kept).withColumnsRenamed(away)).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size", "text"))
    slim = settled(d.select("source", "size", "_h"))
    plan = targets(slim)
    cut = {s: (h, n) for s, h, n in cuts(slim, plan)}
    rows = [(s, n, t, int(t // n) if n else 0, *cut.get(s, (None, None))) for s, n, t in plan]
    d = d.join(F.broadcast(spark.createDataFrame(rows, "_s string, source_size long, target double, _whole long, _cut long, _take long")), F.col("source").eqNullSafe(F.col("_s")))
    if any(n for _, n in cut.values()):  # rows with the hash of the cut are numbered, others are not
        at = d.where("_h = _cut").withColumn("_i", F.row_number().over(Window.partitionBy("_s").orderBy("_h")))
        d = d.where("_cut is null or _h <> _cut").withColumn("_i", F.lit(0)).unionByName(at)
    else:
        d = d.withColumn("_i", F.when(F.col("_h") == F.col("_cut"), 1).otherwise(0))
    more = F.when(F.col("_cut").isNull() | (F.col("_h") < F.col("_cut")) | ((F.col("_i") > 0) & (F.col("_i") <= F.col("_take"))), 1).otherwise(0)
    d = d.withColumn("reps", F.when(F.col("source_size") > 0, F.col("_whole") + F.when(F.col("target") > F.col("_whole") * F.col("source_size"), more).otherwise(0)).otherwise(0))
    d = d.withColumn("taken", (F.col("reps") * F.col("size")).cast("long"))
    return d.select(*[F.col(away.get(c, c)).alias(c) for c in kept], *RESULTS)
