"""python -m chronorank fit EDGES.csv BUNDLE | score BUNDLE QUERIES.csv LINES | validate LINES: the steps of a run over files."""
import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronorank.functions import rows as R
from chronorank.operators import graph, history
from chronorank.sources import files

# Linear rule weights (pair, exact, pop, recent, trend, recency, transition, unknown).
RULE = {"pair_log": 1.45, "src_recent_exact": 1.15, "pop": 0.85, "recent_pop": 1.00, "trend": 0.45, "recency": 0.45, "transition": 0.25}
UNKNOWN = -0.20


def fit(spark, edges, bundle):
    d = history.ordered(files.edges_csv(spark, edges).withColumnRenamed("time", "t"))
    graph.TemporalGraph.fit(d).save(bundle)


def score(spark, bundle, queries, out, width=100):
    """Lines of probabilities by the linear rule, in the order of the queries (source, time, hash of the candidates)."""
    q = files.queries_csv(spark, queries, width).withColumnRenamed("time", "t").withColumn("qid", F.xxhash64("src", "t", "cands")).dropDuplicates(["qid"])
    f = graph.TemporalGraph.load(spark, bundle).features(files.unpivot(q, "qid", "src", "t"))
    s = sum(F.col(c) * w for c, w in RULE.items()) + UNKNOWN * (1 - F.col("dst_known"))
    rows = f.select("qid", "pos", s.alias("s")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("s"))
    lines = q.join(rows, "qid").select("src", "t", "qid", R.line(R.probabilities(R.softmax(R.zscore(F.col("s"))))).alias("line"))
    files.write_lines(lines, ["src", "t", "qid"], "line", out)


def validate(spark, lines, width=100):
    d = spark.read.text(lines).select(F.xxhash64("value").alias("qid"), F.transform(F.split("value", ","), lambda x: x.cast("double")).alias("p"))
    return files.validated(d, width=width).first().asDict()


def main(args=None, spark=None):
    p = argparse.ArgumentParser(prog="chronorank", description=__doc__)
    sub = p.add_subparsers(dest="step", required=True)
    for name, names in (("fit", ("edges", "bundle")), ("score", ("bundle", "queries", "out")), ("validate", ("lines",))):
        s = sub.add_parser(name)
        for n in names:
            s.add_argument(n)
        if name != "fit":
            s.add_argument("--width", type=int, default=100)
    a = vars(p.parse_args(args))
    got = {"fit": fit, "score": score, "validate": validate}[a.pop("step")](spark or SparkSession.builder.getOrCreate(), **a)
    if got:
        print(got)
    return got


if __name__ == "__main__":
    main()
