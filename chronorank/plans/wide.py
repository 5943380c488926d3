"""Queries over rows of a hundred candidates: the operators called on the tables, and their oracles, written apart from them.

Query rows are the customers; their candidates are made by arithmetic. s1 is the log popularity of a candidate, s2 a made
score, the positive stands in slot qid % 100. Embeddings are the vectors of the parts of the same number."""
from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronorank.functions import hashing, vectors as V
from chronorank.functions import rows as R
from chronorank.operators import blend, embeddings, graph, history, sampling, vectors
from chronorank.plans import dealt, probed
from chronorank.sources import files, store

WIDTH, DAY = 100, 86400


class Tables:
    """The frames that the queries share."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def read(self, name):
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def edges(self):
        o = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("src"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("t"))
        e = self.read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return e.select("src", F.col("l_partkey").alias("dst"), "t", F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_suppkey").alias("k3"))

    def ordered(self):
        return history.ordered(self.edges(), "k1", "k2", "k3")

    def popularity(self):
        return self.edges().groupBy("dst").agg(F.count(F.lit(1)).alias("n"))

    def queries(self, edges=None):
        """qid, src, t, cands, label: a row for each customer. edges: those of the tables, if they are at hand."""
        span = (self.edges() if edges is None else edges).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
        top = self.read("part").agg(F.max("p_partkey").alias("_m"))
        q = self.read("customer").select(F.col("c_custkey").alias("qid"), F.col("c_custkey").alias("src")).crossJoin(F.broadcast(span)).crossJoin(F.broadcast(top))
        cands = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda p: (F.col("qid") * 7919 + p * 104729 + p * p * 31) % F.col("_m") + 1)
        return q.select("qid", "src", (F.col("_a") + F.col("qid") * 7919 * 3600 % (F.col("_b") - F.col("_a"))).alias("t"), cands.alias("cands"), (F.col("qid") % WIDTH).alias("label"))

    def asks(self):
        return files.unpivot(self.queries(), "qid", "src", "t")

    def scored(self):
        """queries with s1 and s2: the candidates' popularities are looked up once and gathered by row."""
        n = self.asks().join(self.popularity(), F.col("c") == F.col("dst"), "left")
        s = n.select("qid", "pos", F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("s1"), ((F.col("c") * 31 + F.col("pos") * 17 + F.col("qid") * 7) % 1000 / 1000.0).alias("s2"))
        own = s.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "s1", "s2"))).alias("x"))
        return self.queries().join(own, "qid").select("qid", "src", "t", "cands", "label", *[F.col(f"x.{c}").alias(c) for c in ("s1", "s2")])

    def vectors(self):
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


EDGES = "edges as (select o_custkey as src, l_partkey as dst, cast(epoch_us(o_orderdate) // 1000000 as bigint) as t, l_orderkey as k1, l_linenumber as k2, l_suppkey as k3 from lineitem join orders on l_orderkey = o_orderkey)"
ORD = f"{EDGES}, ord as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from edges)"
LQ = f"""{EDGES}, span as (select min(t) as a, max(t) as b from edges), top as (select max(p_partkey) as m from part),
 lq as (select c_custkey as qid, c_custkey as src, a + c_custkey * 7919 * 3600 % (b - a) as t, cast(pos as integer) as pos, (c_custkey * 7919 + pos * 104729 + pos * pos * 31) % m + 1 as c, c_custkey % 100 as label from customer cross join range(100) r(pos) cross join span cross join top),
 sc as (select lq.*, ln(1 + coalesce(n, 0)) as s1, (c * 31 + pos * 17 + qid * 7) % 1000 / 1000e0 as s2 from lq left join (select dst, count(*) as n from edges group by dst) d on lq.c = d.dst)"""
EMB = "vecs as (select vec_id as id, cast(embedding as double[]) as v from embeddings)"
COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0})) / sqrt(list_dot_product({1}, {1}))"

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    """Registers a function of Tables under its name, with its oracle."""

    def take(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Tables(spark, sf))
        if oracle:
            ORACLES[f.__name__] = oracle if oracle.lstrip().startswith("select") else f"with {oracle}"
        return f

    return take


def slots(df, **named):
    """qid, pos and the named arrays, a row for each slot."""
    names = list(named)
    return df.select("qid", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in named.items()])).alias("pos", "x")).select("qid", "pos", *[F.col(f"x.{n}").alias(n) for n in names])


# Scans and sinks

@query(f"{EDGES} select src, dst, t, case when k2 = 7 then 1 else 0 end as split from edges")
def edge_csv_scan(x):
    at = store.folder(x.spark)
    x.edges().select("src", "dst", F.col("t").alias("time"), F.expr("int(k2 = 7)").alias("split")).write.option("header", True).option("compression", "gzip").csv(at)
    return files.edges_csv(x.spark, at).select("src", "dst", F.col("time").alias("t"), "split")


@query(f"{LQ} select src, t, pos, c from lq")
def query_csv_scan(x):
    at = store.folder(x.spark)
    x.queries().select("src", F.col("t").alias("time"), *[F.col("cands")[i].alias(f"c{i + 1}") for i in range(WIDTH)]).write.option("header", True).csv(at)
    return files.unpivot(files.queries_csv(x.spark, at, WIDTH), "src", F.col("time").alias("t"))


@query(f"{EDGES} select src, dst, t from edges where k2 <> 7 and t > 0")
def filtered_scan(x):
    return x.edges().where("k2 <> 7 and t > 0").select("src", "dst", "t")


@query(f"{EDGES} select src, dst, t, k1, k2, k3 from edges order by t, src, dst, k1, k2, k3 limit 1000")
def head_scan(x):
    return x.edges().orderBy("t", "src", "dst", "k1", "k2", "k3").limit(1000)


@query(f"{EDGES} select count(*) as n, count(distinct src) as n_src, cast(sum(t) as bigint) as t_sum, 4 as batches from edges")
def chunked_scan(x):
    """The edges as a stream of four files, one a micro-batch."""
    at, out = store.folder(x.spark), store.folder(x.spark)
    x.edges().withColumn("part", F.col("src") % 4).repartition(4, "part").write.partitionBy("part").parquet(f"{at}/all")
    for i in range(4):
        x.spark.read.parquet(f"{at}/all").where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    schema = x.spark.read.parquet(f"{at}/in").schema
    stream = x.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    write = lambda df, b: df.withColumn("batch", F.lit(b)).write.mode("overwrite").parquet(f"{out}/{b}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return x.spark.read.parquet(f"{out}/*").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.sum("t").alias("t_sum"), F.countDistinct("batch").cast("int").alias("batches"))


@query(f"{ORD}, p as (select dst, count(*) as n from edges group by dst), g as (select *, row_number() over (order by t, src, dst, k1, k2, k3) - 1 as place from edges) select place, src, g.dst, n from g join p on g.dst = p.dst where place >= 1000 and place < 3000")
def row_range_popularity(x):
    """Rows 1000 to 2999 in time order, with popularities over all rows."""
    d = sampling.numbered(x.edges(), "t", "src", "dst", "k1", "k2", "k3").where("place >= 1000 and place < 3000")
    return d.join(x.popularity(), "dst").select("place", "src", "dst", "n")


@query(f"{LQ} select qid, string_agg(cast(c as varchar), ',' order by pos) as line from lq group by qid")
def zip_member_scan(x):
    """Lines of candidates out of the member of ZIP files, a file for each eighth of the rows."""
    import pandas as pd

    at = store.folder(x.spark)

    def pack(key, pdf):
        import io
        import zipfile

        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("rows.csv", "\n".join(f"{q};{t}" for q, t in zip(pdf["qid"], pdf["line"])))
        return pd.DataFrame({"content": [data.getvalue()]})

    lines = x.queries().select("qid", (F.col("qid") % 8).alias("part"), F.array_join(F.col("cands").cast("array<string>"), ",").alias("line"))
    lines.groupBy("part").applyInPandas(pack, "content binary").write.parquet(at)
    spark = x.spark
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, r in enumerate(spark.read.parquet(at).toLocalIterator()):  # eight files
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}-zip/{i}.zip"))
        out.write(bytearray(r.content))
        out.close()
    got = files.zip_lines(spark, f"{at}-zip/*.zip", "rows.csv")
    return got.select(F.split("line", ";")[0].cast("long").alias("qid"), F.split("line", ";")[1].alias("line"))


PROBS = f"""{LQ}, z as (select qid, pos, (s2 - avg(s2) over w) / stddev_pop(s2) over w as z from sc window w as (partition by qid)),
 e as (select qid, pos, exp(z - max(z) over (partition by qid)) as e from z), p as (select qid, pos, round(e / sum(e) over (partition by qid), 8) as p from e),
 b as (select *, row_number() over (partition by qid order by p desc, pos) as k, sum(p) over (partition by qid order by pos rows between unbounded preceding and unbounded following) as total from p),
 f as (select qid, pos, case when k = 1 then round(p + (1 - total), 8) else p end as p from b)"""


def _probs(x):
    return x.scored().select("qid", R.probabilities(R.softmax(R.zscore(F.col("s2")))).alias("p"))


@query(f"{PROBS} select qid, pos, cast(round(p * 100000000) as bigint) as units from f")
def softmax_probabilities(x):
    return slots(_probs(x), p=F.col("p")).select("qid", "pos", F.round(F.col("p") * 100000000).cast("long").alias("units"))


@query(f"{PROBS} select qid, md5(string_agg(printf('%.8f', p), ',' order by pos)) as digest from f group by qid")
def score_lines(x):
    """Lines of probabilities, written in order and read again."""
    at = store.folder(x.spark)
    files.write_lines(_probs(x).select("qid", F.concat_ws(";", "qid", R.line(F.col("p"))).alias("line")), ["qid"], "line", at)
    back = x.spark.read.text(at)
    return back.select(F.split("value", ";")[0].cast("long").alias("qid"), F.md5(F.split("value", ";")[1]).alias("digest"))


@query(f"{PROBS}, per as (select qid, count(*) as k, sum(p) as total, min(p) as lo, max(p) as hi from f group by qid) select count(*) as n, count(*) filter (k <> 100 or lo < -1e-12 or hi > 1 + 1e-12 or abs(total - 1) > 1e-5) as bad, min(case when k <> 100 then qid end) as first_bad, min(total) as sum_min, max(total) as sum_max, min(lo) as p_min, max(hi) as p_max from per")
def probability_validator(x):
    return files.validated(_probs(x))


@query(f"{LQ}, r as (select qid, pos, row_number() over (partition by qid order by s1, pos) as k from sc) select qid, md5(string_agg(printf('%.8f', k / 100e0), ',' order by pos)) as digest from r group by qid")
def percentile_lines(x):
    return x.scored().select("qid", F.md5(R.line(R.percentile(F.col("s1")))).alias("digest"))


@query(f"{LQ}, b as (select qid, pos, s2, min(s2) over (partition by qid) as lo, max(s2) over (partition by qid) as hi from sc) select qid, md5(string_agg(printf('%.4f0000', floor((0.01e0 + 0.99e0 * (s2 - lo) / (hi - lo)) * 10000 + 0.5) / 10000), ',' order by pos)) as digest from b group by qid")
def fixed_grid_lines(x):
    grid = F.transform(R.minmax(F.col("s2")), lambda v: F.floor(v * 10000 + 0.5) / 10000)
    return x.scored().select("qid", F.md5(R.line(grid, "%.4f0000")).alias("digest"))


@query(f"{LQ} select qid, md5(string_agg(printf('%.4f', s2), ',' order by pos)) as digest from sc group by qid")
def score_lines_4dp(x):
    return x.scored().select("qid", F.md5(R.line(F.col("s2"), "%.4f")).alias("digest"))


@query(f"{LQ}, r as (select qid, pos, row_number() over (partition by qid order by s1, pos) / 100e0 as p1, row_number() over (partition by qid order by s2, pos) / 100e0 as p2 from sc), w as (select unnest([0.0e0, 0.25e0, 0.5e0, 0.75e0, 1.0e0]) as w) select w, qid, avg((1 - w) * p1 + w * p2) as mean, max((1 - w) * p1 + w * p2) as best from r cross join w group by w, qid")
def package_sweep(x):
    """One blend for each weight, in one plan."""
    both = x.scored().select("qid", R.percentile(F.col("s1")).alias("a"), R.percentile(F.col("s2")).alias("b")).withColumn("w", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    mix = both.withColumn("m", F.zip_with("a", "b", lambda p, q: (1 - F.col("w")) * p + F.col("w") * q))
    return mix.select("w", "qid", (F.aggregate("m", F.lit(0.0), lambda s, v: s + v) / F.size("m")).alias("mean"), F.array_max("m").alias("best"))


@query(f"{PROBS}, l as (select qid, md5(string_agg(printf('%.8f', p), ',' order by pos)) as d from f group by qid) select count(*) as n, cast(sum(cast('0x' || substr(d, 1, 8) as bigint)) as bigint) as digest from l")
def output_digest(x):
    """A digest of all lines that does not depend on their order."""
    d = _probs(x).select(F.conv(F.substring(F.md5(R.line(F.col("p"))), 1, 8), 16, 10).cast("long").alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("digest"))


# Row operators

def _row(name, oracle, make, **more):
    def f(x):
        return slots(x.scored(), v=make())

    f.__name__ = name
    query(oracle)(f)


W_S1, W_S2 = "(partition by qid order by s1 desc, pos)", "(partition by qid)"
_row("softmax_temperature", f"{LQ}, e as (select qid, pos, exp((s1 - max(s1) over {W_S2}) / 0.5e0) as e from sc) select qid, pos, e / sum(e) over {W_S2} as v from e", lambda: R.softmax(F.col("s1"), 0.5))
_row("ordinal_rank", f"{LQ} select qid, pos, 1e0 / row_number() over {W_S1} as v from sc", lambda: R.ordinal(F.col("s1")))
_row("competition_rank", f"{LQ} select qid, pos, 1e0 / rank() over (partition by qid order by s1 desc) as v from sc", lambda: R.competition(F.col("s1")))
_row("percentile_by_id", f"{LQ} select qid, pos, row_number() over (partition by qid order by s1, c, pos) / 100e0 as v from sc", lambda: R.percentile(F.col("s1"), F.col("cands")))
_row("percentile_by_slot", f"{LQ} select qid, pos, row_number() over (partition by qid order by s1, pos) / 100e0 as v from sc", lambda: R.percentile(F.col("s1")))
_row("wide_zscore", f"{LQ} select qid, pos, (s1 - avg(s1) over {W_S2}) / stddev_pop(s1) over {W_S2} as v from sc", lambda: R.zscore(F.col("s1")))
_row("wide_minmax", f"{LQ} select qid, pos, 0.01e0 + 0.99e0 * (s1 - min(s1) over {W_S2}) / (max(s1) over {W_S2} - min(s1) over {W_S2}) as v from sc", lambda: R.minmax(F.col("s1")))
_row("residual_rows", f"{LQ} select qid, pos, s1 + 0.25e0 * (s2 - s1) as v from sc", lambda: blend.residual(F.col("s1"), F.col("s2"), 0.25))
_row("calibrated_rows", f"{LQ} select qid, pos, (s1 - avg(s1) over {W_S2}) / stddev_pop(s1) over {W_S2} + 0.3e0 * (s2 - avg(s2) over {W_S2}) / stddev_pop(s2) over {W_S2} as v from sc", lambda: blend.calibrated(F.col("s1"), F.col("s2"), 0.3))
_row("baseline_logits", f"{LQ} select qid, pos, (s1 - avg(s1) over {W_S2}) / stddev_pop(s1) over {W_S2} + 5.5e0 * (s2 - avg(s2) over {W_S2}) / stddev_pop(s2) over {W_S2} as v from sc", lambda: blend.calibrated(F.col("s1"), F.col("s2"), 5.5))
_row("context_blend", f"{LQ} select qid, pos, 0.4e0 * (s1 - avg(s1) over {W_S2}) / stddev_pop(s1) over {W_S2} + 0.6e0 * (s2 - avg(s2) over {W_S2}) / stddev_pop(s2) over {W_S2} as v from sc", lambda: blend.weighted([(R.zscore(F.col("s1")), 0.4), (R.zscore(F.col("s2")), 0.6)]))
_row("rank_blend_three", f"{LQ} select qid, pos, 0.5e0 * row_number() over (partition by qid order by s1, pos) / 100 + 0.3e0 * row_number() over (partition by qid order by s2, pos) / 100 + 0.2e0 * row_number() over (partition by qid order by s1 * s2, pos) / 100 as v from sc", lambda: blend.rank_blend([(F.col("s1"), 0.5), (F.col("s2"), 0.3), (F.zip_with("s1", "s2", lambda a, b: a * b), 0.2)]))


@query(f"{LQ}, a as (select src, ln(1 + count(*)) as n from edges group by src), m as (select max(n) as m from a) select qid, pos, s2 * coalesce(n, 0) / m as v from sc left join a on sc.src = a.src cross join m")
def interaction_terms(x):
    """s2 times the activity of the source: log edges over the largest."""
    a = x.edges().groupBy("src").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("n"))
    d = x.scored().join(a, "src", "left").crossJoin(F.broadcast(a.agg(F.max("n").alias("m"))))
    return slots(d, v=F.transform("s2", lambda s: s * F.coalesce(F.col("n"), F.lit(0.0)) / F.col("m")))


@query(f"{LQ}, e as (select qid, exp(s2 - max(s2) over {W_S2}) as e from sc), p as (select qid, e / sum(e) over {W_S2} as p from e), r as (select *, row_number() over (partition by qid order by p desc) as k from p) select qid, max(p) filter (k = 1) - max(p) filter (k = 2) as margin from r group by qid")
def softmax_margin(x):
    return x.scored().select("qid", R.margin(R.softmax(F.col("s2"))).alias("margin"))


FIVE = ", ".join(f"sin(pos / power(10000e0, {2 * i} / 8e0)) as s{i}, cos(pos / power(10000e0, {2 * i} / 8e0)) as c{i}" for i in range(4))


@query(f"select cast(pos as integer) as pos, {FIVE} from range(64) r(pos)")
def position_encoding(x):
    """Sines and cosines of 64 places in eight dimensions."""
    div = [10000.0 ** (2 * i / 8) for i in range(4)]
    return x.spark.range(64).select(F.col("id").cast("int").alias("pos"), *[f((F.col("id") / d)).alias(f"{n}{i}") for i, d in enumerate(div) for f, n in ((F.sin, "s"), (F.cos, "c"))])


# Histories, joins and windows


@query(f"{LQ}, ord as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from edges), j as (select q.qid, e.dst, e.t, row_number() over (partition by q.qid order by e.o desc) as rk from (select distinct qid, src, t from lq) q join ord e on q.src = e.src and e.t < q.t) select qid, cast(rk as bigint) as rk, dst, t from j where rk <= 60")
def asof_recent(x):
    return history.as_of(x.ordered(), x.queries(), 60).withColumn("rk", F.col("rk").cast("long"))


PAST = "list(dst) over (partition by src order by o rows between 8 preceding and 1 preceding)"


@query(f"{ORD}, h as (select src, o, t, k1, k2, k3, {PAST} as p, list(t) over (partition by src order by o rows between 8 preceding and 1 preceding) as pt from ord) select src, cast(o as bigint) as ord, cast(coalesce(len(list_filter(p, lambda y: y > 0)), 0) as bigint) as held, coalesce(list_sum(p), 0) as ids, coalesce(p[len(p)], 0) as last, coalesce(ln(1 + greatest(t - pt[len(pt)], 0)) / 10, 0) as gap from h")
def running_history(x):
    """The last eight destinations strictly before each edge, padded: checked by what they hold."""
    d = history.running(x.ordered(), 8)
    total = F.aggregate("hist", F.lit(0).cast("long"), lambda s, v: s + v)
    return d.select("src", F.col("ord").cast("long").alias("ord"), F.size(F.filter("hist", lambda v: v > 0)).cast("long").alias("held"), total.alias("ids"), F.element_at("hist", -1).alias("last"), F.element_at("gaps", -1).alias("gap"))


@query(f"{EDGES}, g as (select t - lag(t) over (order by t, src, dst, k1, k2, k3) as gap from edges where t > 0) select quantile_cont(gap, 0.9) as p90, quantile_cont(gap, 0.5) as p50, count(*) as n from g where gap > 0")
def global_gap(x):
    """Gaps of the stream of all edges: inside days, and over the borders of days."""
    d = x.edges().where("t > 0").withColumn("day", F.floor(F.col("t") / DAY))
    inside = d.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("day").orderBy("t"))).where("gap > 0").select("gap")
    ends = d.groupBy("day").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    over = ends.withColumn("gap", F.col("a") - F.lag("b").over(Window.orderBy("day"))).where("gap > 0").select("gap")
    return inside.unionByName(over).agg(F.expr("percentile(gap, 0.9)").alias("p90"), F.expr("percentile(gap, 0.5)").alias("p50"), F.count(F.lit(1)).alias("n"))


@query(f"{EDGES}, m as (select max(t) as tm from edges) select dst, cast(count(*) filter (t >= tm - 10800) as bigint) as n3h, cast(count(*) filter (t >= tm - 43200) as bigint) as n12h, cast(count(*) filter (t >= tm - 86400 * 90) as bigint) as n90d from edges cross join m group by dst")
def trailing_hours(x):
    e = x.edges()
    top = F.broadcast(e.agg(F.max("t").alias("tm")))
    near = lambda s, n: F.count_if(F.col("t") >= F.col("tm") - s).alias(n)
    return e.crossJoin(top).groupBy("dst").agg(near(10800, "n3h"), near(43200, "n12h"), near(90 * DAY, "n90d"))


@query(f"{LQ}, ev as (select lq.qid, lq.pos, lq.t, lq.src, lq.c, e.t as et from lq left join edges e on e.dst = lq.c and e.t > 0 and e.t < lq.t), d as (select qid, pos, any_value(t) as t, any_value(src) as src, any_value(c) as c, count(et) filter (et >= greatest(t - 2592000, 0)) as n30, count(et) filter (et >= greatest(t - 604800, 0)) as n7, max(et) as ld from ev group by qid, pos), pp as (select lq.qid, lq.pos, max(e.t) as lp from lq join edges e on e.src = lq.src and e.dst = lq.c and e.t > 0 and e.t < lq.t group by lq.qid, lq.pos), ss as (select q.qid, max(e.t) as ls from (select distinct qid, src, t from lq) q join edges e on e.src = q.src and e.t > 0 and e.t < q.t group by q.qid) select d.qid, d.pos, ln(1 + n30) as cnt30, ln(1 + n7) as cnt7, ln(1.5 + n7) - ln(1.5 + n30) as burst, ln(1 + coalesce(t - ld + 1, 1e10)) as gap_dst, ln(1 + coalesce(t - lp + 1, 1e10)) as gap_pair, ln(1 + coalesce(t - ls + 1, 1e10)) as gap_src from d left join pp on d.qid = pp.qid and d.pos = pp.pos left join ss on d.qid = ss.qid")
def wide_recency(x):
    """Queries that miss a source, a time or a candidate are left to the frames."""
    e = store.settled(x.edges().select("src", "dst", "t"))
    q = x.queries(e)
    if q.where("src is null or t is null or exists(cands, c -> c is null)").limit(1).count():
        return history.recency(e, files.unpivot(q, "qid", "src", "t"))
    return dealt.recency(e, q)


@query(f"{ORD}, s as (select a.dst as a, b.dst as b, sum(1 / sqrt(b.o - a.o)) as w from ord a join ord b on a.src = b.src and b.o > a.o and b.o <= a.o + 16 and a.dst <> b.dst group by a.dst, b.dst) select count(*) as pairs, sum(w) as weight, max(w) as heaviest, count(distinct a) as n_a from s")
def transition_table(x):
    """All transitions (no cap): their number and weights."""
    return history.transitions(x.ordered(), 16, None).agg(F.count(F.lit(1)).alias("pairs"), F.sum("w").alias("weight"), F.max("w").alias("heaviest"), F.countDistinct("a").alias("n_a"))


@query(f"{LQ}, r as (select qid, pos, row_number() over (partition by qid order by s1, pos) / 100e0 as a, row_number() over (partition by qid order by s2, pos) / 100e0 as b, row_number() over (partition by qid order by c, pos) / 100e0 as d from sc) select qid, pos, 0.5e0 * a + 0.25e0 * b + 0.25e0 * d as score from r")
def matrix_zip(x):
    """Matrices of ranks as long tables, added up by one shuffle."""
    d = x.scored()
    parts = [(R.percentile(F.col("s1")), 0.5), (R.percentile(F.col("s2")), 0.25), (R.percentile(F.transform("cands", lambda c: c.cast("double"))), 0.25)]
    rows = [slots(d, v=p).withColumn("v", F.col("v") * w) for p, w in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("qid", "pos").agg(F.sum("v").alias("score"))


@query(f"{LQ}, seen as (select dst, row_number() over (order by dst) as dense from (select distinct dst from edges) d), u as (select count(*) + 1 as unk from seen) select qid, pos, coalesce(dense, unk) as id from lq left join seen on lq.c = seen.dst cross join u")
def dense_ids(x):
    """Candidates by the dense number of seen destinations; unseen ones get the number behind the last."""
    seen = sampling.numbered(x.edges().select("dst").distinct(), "dst", name="dense", unit=65536)
    unk = seen.agg((F.max("dense") + 2).alias("unk"))
    d = x.asks().join(seen, F.col("c") == F.col("dst"), "left").crossJoin(F.broadcast(unk))
    return d.select("qid", "pos", F.coalesce(F.col("dense") + 1, F.col("unk")).alias("id"))


@query(f"{LQ} select count(*) as n, count(*) filter (c < 1) as low, count(*) filter (not isfinite(s1) or not isfinite(s2)) as odd, (select count(*) from (select distinct c from lq except select dst from edges) y) as unseen from sc")
def guard_counts(x):
    """Ids out of bounds, scores that are no numbers, candidates that no edge holds."""
    d = slots(x.scored(), c=F.col("cands"), s1=F.col("s1"), s2=F.col("s2"))
    odd = F.isnan("s1") | F.isnan("s2") | (F.abs("s1") == float("inf")) | (F.abs("s2") == float("inf"))
    unseen = d.select(F.col("c").alias("dst")).distinct().join(x.edges().select("dst").distinct(), "dst", "left_anti").agg(F.count(F.lit(1)).alias("unseen"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") < 1).alias("low"), F.count_if(odd).alias("odd")).crossJoin(unseen)


@query(f"{ORD}, n as (select count(*) as n from customer), q as (select c_custkey as qid, row_number() over (order by c_custkey) - 1 as i from customer) select ord.src, cast(ord.o as bigint) as ord, coalesce(c.c_custkey, q.qid) as tmpl from ord left join customer c on c.c_custkey = ord.src cross join n left join q on q.i = cast(floor(cast('0x' || substr(md5('0:' || ord.src || ':' || ord.o), 1, 12) as bigint) / 281474976710656e0 * n.n) as bigint)")
def template_rows(x):
    return sampling.templates(x.ordered(), x.queries()).select("src", F.col("ord").cast("long").alias("ord"), "tmpl")


@query("select (select count(*) from (select distinct l_partkey from lineitem except select p_partkey from part) a) as unknown_parts, (select count(*) from (select distinct o_custkey from orders except select c_custkey from customer) b) as unknown_customers")
def dictionary_check(x):
    missing = lambda a, b, k, n: a.select(F.col(k).alias("k")).distinct().join(b.toDF("k"), "k", "left_anti").agg(F.count(F.lit(1)).alias(n))
    return missing(x.read("lineitem"), x.read("part").select("p_partkey"), "l_partkey", "unknown_parts").crossJoin(missing(x.read("orders"), x.read("customer").select("c_custkey"), "o_custkey", "unknown_customers"))


# Vectors

@query(f"{EMB} select a.id, list_sum(list_transform(a.v, lambda y: y)) as total, sqrt(list_dot_product(a.v, a.v)) as norm, list_dot_product(a.v, b.v) as dot, {COS.format('a.v', 'b.v')} as cosine, list_avg(list_slice(list_reverse_sort(a.v), 1, 5)) as top5 from vecs a join vecs b on b.id = 0")
def vector_math(x):
    v = x.vectors()
    d = v.crossJoin(F.broadcast(v.where("id = 0").select(F.col("vec").alias("o"))))
    return d.select("id", F.aggregate("vec", F.lit(0.0), lambda s, y: s + y).alias("total"), V.norm(F.col("vec")).alias("norm"), V.dot(F.col("vec"), F.col("o")).alias("dot"), V.cosine(F.col("vec"), F.col("o")).alias("cosine"), V.top_mean(F.col("vec")).alias("top5"))


@query(f"{EMB} select id, sqrt(list_dot_product(list_transform(v, lambda y: y / n), list_transform(v, lambda y: y / n))) as norm, v[1] / n as first from (select id, v, sqrt(list_dot_product(v, v)) as n from vecs) u")
def unit_vectors(x):
    u = V.unit(F.col("vec"))
    return x.vectors().withColumn("u", u).select("id", V.norm(F.col("u")).alias("norm"), F.col("u")[0].alias("first"))


RECENT = f"{ORD}, rec as (select src, dst, row_number() over (partition by src order by o desc) as rk from ord), {EMB}"
COMP = "(select src, i, sum(w * x) / sum(w) as m from (select src, i, 1 / sqrt(rk) as w, v[i] as x from rec join vecs on id = dst cross join range(1, 65) r(i) where rk <= {n}) y group by src, i)"


@query(f"{RECENT}, p as {COMP.format(n=64)}, n as (select src, sqrt(sum(m * m)) as n from p group by src) select p.src, i, m / n as x from p join n on p.src = n.src")
def profile_vectors(x):
    """Unit mean of the vectors of the last 64 items, weighted by their recency."""
    recent = history.last(x.ordered(), 64).withColumn("w", 1 / F.sqrt("rk"))
    return vectors.profile(recent, x.vectors(), weight="w").select("src", F.posexplode("vec").alias("i", "x")).select("src", (F.col("i") + 1).cast("long").alias("i"), "x")


@query(f"{RECENT} select src, i, avg(v[i]) as x from rec join vecs on id = dst cross join range(1, 65) r(i) where rk <= 16 group by src, i")
def mean_vectors(x):
    rows = history.last(x.ordered(), 16).join(x.vectors().withColumnRenamed("id", "dst"), "dst")
    return V.mean(rows, ["src"]).select("src", F.posexplode("vec").alias("i", "x")).select("src", (F.col("i") + 1).cast("long").alias("i"), "x")


@query(f"{LQ}, ord as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from edges), rec as (select src, dst, row_number() over (partition by src order by o desc) as rk from ord), {EMB}, h as (select src, rk, v from rec join vecs on id = dst where rk <= 20), x as (select distinct lq.src, c, v from lq join vecs on id = c), e as (select x.src, c, rk, {COS.format('h.v', 'x.v')} as s from x join h on x.src = h.src), o as (select *, row_number() over (partition by src, c order by s desc, rk) as ix from e), g as (select src, c, max(s) as a, max(s) filter (rk = 1) as b, avg(s) filter (ix <= 5) as d from o group by src, c) select qid, pos, coalesce(a, 0) as seq_max, coalesce(b, 0) as seq_last, coalesce(d, 0) as seq_top from lq left join g on lq.src = g.src and lq.c = g.c")
def history_cosines(x):
    return vectors.history_cosines(history.last(x.ordered(), 20), x.asks(), x.vectors())


@query(f"{EMB}, p as (select a.id as a, b.id as b, {COS.format('a.v', 'b.v')} as s from vecs a join vecs b on a.id <> b.id), r as (select a, b, s, row_number() over (partition by a order by round(s, 12) desc, b) as rk from p) select a, b, s as score, cast(rk as bigint) as rk from r where rk <= 10")
def nearest_vectors(x):
    return vectors.nearest(x.vectors(), 10, 1024).withColumn("rk", F.col("rk").cast("long"))


@query(f"{EMB}, c as (select i, avg(v[i]) as m, stddev_pop(v[i]) as s from vecs cross join range(1, 65) r(i) where id % 5 <> 0 group by i) select id, i, (v[i] - m) / case when s < 1e-6 then 1 else s end as z from vecs join c on true")
def train_standardised(x):
    """All rows by the means and deviations of the training rows."""
    d = x.vectors().select("id", F.posexplode("vec").alias("p", "x")).select("id", (F.col("p") + 1).cast("long").alias("i"), "x")
    fit = d.where("id % 5 <> 0").groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return d.join(F.broadcast(fit), "i").select("id", "i", ((F.col("x") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))).alias("z"))


# Samples and candidate lists


def u(*keys, seed=0):
    """The oracle's hashing.uniform."""
    return f"(cast('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(keys)}), 1, 12) as bigint) / 281474976710656e0)"


@query(f"{EDGES} select t, src, dst, k1, k2, k3, cast(row_number() over (order by t, src, dst, k1, k2, k3) - 1 as bigint) as place from edges")
def global_order(x):
    return sampling.numbered(x.edges(), "t", "src", "dst", "k1", "k2", "k3")


@query(f"{EDGES}, g as (select *, row_number() over (order by t, src, dst, k1, k2, k3) - 1 as place, count(*) over () as n from edges) select t, src, dst, k1, k2, k3 from g where place in (select (i * (n - 1)) // 499 from range(500) r(i), (select count(*) as n from edges) y)")
def even_sample(x):
    return sampling.evenly(x.edges(), 500, "t", "src", "dst", "k1", "k2", "k3")


@query(f"select c_custkey as qid from customer order by {u('c_custkey', seed=5)}, c_custkey limit 100")
def permutation_sample(x):
    return sampling.permuted(x.queries().select("qid"), ["qid"], 100, seed=5)


@query(f"{EDGES}, p as (select src, dst from edges group by src, dst), r as (select src, dst, row_number() over (partition by src order by {u('src', 'dst', seed=2)}, dst) as rk from p) select src, dst, cast(rk as bigint) as rk from r where rk <= 5")
def uniform_sample(x):
    return sampling.per_group(x.edges().select("src", "dst").distinct(), ["src"], ["dst"], 5, seed=2).withColumn("rk", F.col("rk").cast("long"))


@query(f"{EDGES}, n as (select dst as id, count(*) as w from edges group by dst), c as (select id, sum(w) over (order by id) as hi, w from n), m as (select sum(w) as total from n), d as (select c_custkey as qid, j, cast(floor({u('c_custkey', 'j', seed=7)} * total) as bigint) as x from customer cross join range(20) r(j) cross join m) select qid, j, c.id as item from d join c on d.x < c.hi and d.x >= c.hi - c.w")
def weighted_draws(x):
    """Twenty draws for each query, with replacement, by the popularity of the destinations."""
    draws = x.read("customer").select(F.col("c_custkey").alias("qid"), F.explode(F.expr("sequence(0L, 19L)")).alias("j"))
    return sampling.by_weight(x.popularity().withColumnRenamed("dst", "id"), "n", draws, ["qid", "j"], seed=7).select("qid", "j", "item")


NEG = "(cast(floor({u} * m) as bigint) + 1)"
TRY = [NEG.format(u=u("src", "ord", "pos", str(i), seed=3)) for i in range(4)]


@query(f"{ORD}, mm as (select max(p_partkey) as m from part), s as (select src, dst, cast(o as bigint) as ord, pos, m, {', '.join(f'{t} as d{i}' for i, t in enumerate(TRY))} from (select src, dst, o, o as ord, pos, m from ord cross join range(1, 6) r(pos) cross join mm) y), f as (select src, ord, cast(pos as integer) as pos, dst, m, case when d0 <> dst then d0 when d1 <> dst then d1 when d2 <> dst then d2 else d3 end as neg from s) select src, ord, pos, case when neg = dst then neg % m + 1 else neg end as neg from f")
def uniform_negatives(x):
    top = x.read("part").agg(F.max("p_partkey")).first()[0]
    d = sampling.uniform_negatives(x.ordered().select("src", "dst", F.col("ord").cast("long").alias("ord")), top, 5, ["src", "ord"], seed=3)
    return d.select("src", "ord", "pos", "neg")


@query(f"{EDGES}, m as (select max(p_partkey) as m from part) select i as id from m, range(1, 1000000) r(i) where i <= m and i not in (select dst from edges)")
def unseen_ids(x):
    top = x.read("part").agg(F.max("p_partkey")).first()[0]
    return sampling.unseen(x.spark, x.popularity().withColumnRenamed("dst", "id"), top)


POOL = f"""{ORD}, hist as (select src as qid, dst as c, row_number() over (partition by src order by max(o) desc) as rk from ord group by src, dst),
 hot as (select dst as c, row_number() over (order by count(*) desc, dst) as rk from edges group by dst),
 tr as (select a.dst as a, b.dst as b, sum(1 / sqrt(b.o - a.o)) as w from ord a join ord b on a.src = b.src and b.o > a.o and b.o <= a.o + 4 and a.dst <> b.dst group by a.dst, b.dst), tk as (select a, b, row_number() over (partition by a order by round(w, 6) desc, b) as rk from tr),
 nx as (select src as qid, b as c, min((rk - 1) * 24 + h) as rk from (select src, dst, row_number() over (partition by src order by o desc) as h from ord) y join tk on y.dst = tk.a where h <= 24 and rk <= 10 group by src, b),
 al as (select c_custkey as qid, o_custkey, 0 as prio, -1 as c, 0 as rk from customer join (select distinct o_custkey from orders) y on c_custkey = o_custkey where false),
 un as (select qid, c, 0 as prio, rk from hist where rk <= 120 union all select qid, c, 1, rk from nx where rk <= 240 union all select s.src, hot.c, 2, hot.rk from (select distinct src from edges) s cross join hot where hot.rk <= 160),
 fi as (select *, row_number() over (partition by qid, c order by prio, rk) as f from un), pl as (select qid, c, prio, rk, row_number() over (partition by qid order by prio, rk, c) as place from fi where f = 1)"""


@query(f"{POOL} select qid, c, cast(prio as integer) as prio, cast(rk as bigint) as rk, cast(place as bigint) as place from pl where place <= 300")
def pooled_candidates(x):
    return _pool(x).select("qid", "c", "prio", F.col("rk").cast("long").alias("rk"), F.col("place").cast("long").alias("place"))


def _pool(x):
    """Candidates of each source: its recent items, their commonest successors, and hot items."""
    e = x.ordered()
    own = e.groupBy(F.col("src").alias("qid"), F.col("dst").alias("c")).agg(F.max("ord").alias("o"))
    own = own.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("o")))).drop("o")
    step = history.transitions(e, 4, 10).select(F.col("a").alias("dst"), F.col("b").alias("c"), F.col("rk").alias("_r"))
    after = history.last(e, 24).join(step, "dst").groupBy(F.col("src").alias("qid"), "c").agg(F.min((F.col("_r") - 1) * 24 + F.col("rk")).alias("rk"))
    top = x.popularity().orderBy(F.desc("n"), "dst").limit(160)  # a hot list of fixed length
    hot = e.select(F.col("src").alias("qid")).distinct().crossJoin(F.broadcast(top.select(F.col("dst").alias("c"), F.row_number().over(Window.orderBy(F.desc("n"), "dst")).alias("rk"))))
    return sampling.pooled([(own, 120), (after, 240), (hot, 160)], 300)


@query(f"{POOL}, sc as (select qid, pl.c, ln(1 + n) + 0.1e0 * (3 - prio) as s from pl join (select dst, count(*) as n from edges group by dst) d on pl.c = d.dst where place <= 300), k as (select qid, c, s, row_number() over (partition by qid order by s desc, c) as k, count(*) over (partition by qid) as n from sc) select qid, c, s, cast(k as bigint) as k from k where k <= 99 and n >= 99")
def hard_lists(x):
    """The 99 best of each pool by a linear score; sources with smaller pools have no list."""
    d = _pool(x).join(x.popularity(), F.col("c") == F.col("dst")).withColumn("s", F.log1p(F.col("n").cast("double")) + 0.1 * (3 - F.col("prio")))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "c")).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    return d.where("k <= 99 and _n >= 99").select("qid", "c", "s", "k")


@query(f"{LQ}, pos as (select src, max(dst) as dst from edges group by src), k as (select lq.qid, lq.pos, lq.c, p.dst, row_number() over (partition by lq.qid order by {u('lq.qid', 'lq.pos', seed=11)}, lq.pos) as r from lq join pos p on lq.src = p.src where lq.c in (select dst from edges) and lq.c <> p.dst) select qid, pos, c as replaced, dst from k where r = 1")
def injected_positives(x):
    """A hashed known slot of each query row gives way to a destination of its source."""
    own = x.edges().groupBy("src").agg(F.max("dst").alias("dst"))
    d = x.asks().hint("merge").join(x.popularity().select(F.col("dst").alias("c")), "c").hint("merge").join(own, "src").where("c <> dst")  # exploded: sizes are guessed from the rows before
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(hashing.uniform("qid", "pos", seed=11), "pos")))
    return first.where("r = 1").select("qid", "pos", F.col("c").alias("replaced"), "dst")


@query(f"{LQ}, e as (select qid, pos, s2, exp(s2 * 5 - max(s2 * 5) over {W_S2}) as e from sc), p as (select qid, pos, e / sum(e) over {W_S2} as p from e), h as (select qid, -sum(p * ln(p)) as h, min(pos) filter (p >= m - 1e-15) as label from (select *, max(p) over {W_S2} as m from p) y group by qid) select qid, h, label, 0.15e0 as weight from h order by h, qid limit 100")
def teacher_labels(x):
    """The hundred rows of lowest entropy, with the best slot as label."""
    p = R.softmax(F.transform("s2", lambda s: s * 5))
    d = x.scored().select("qid", p.alias("p")).select("qid", F.aggregate("p", F.lit(0.0), lambda s, v: s - v * F.log(v)).alias("h"), R.first_best(F.col("p")).cast("int").alias("label"), F.lit(0.15).alias("weight"))
    return d.orderBy("h", "qid").limit(100)


@query(f"{LQ}, n as (select dst, count(*) as w from edges group by dst), seen as (select q.c_custkey as qid, dst as c, row_number() over (partition by q.c_custkey order by round(ln(({u('q.c_custkey', 'dst', seed=4)} * 1048576 + 1) / 2097152) / w, 12) desc, dst) as rk from customer q cross join n where (q.c_custkey + dst) % 40 = 0) select qid, c, cast(rk as bigint) as rk from seen where rk <= 20")
def honest_seen(x):
    """Twenty seen destinations for each query, weighted by popularity without replacement, out of a fortieth of all pairs each."""
    q = x.read("customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 40).alias("r"))
    n = x.popularity().select(F.col("dst").alias("id"), "n", F.pmod(40 - F.col("dst") % 40, F.lit(40)).alias("r"))
    return sampling.heaviest(q, n, "n", 20, seed=4).withColumnRenamed("id", "c")


@query(f"{EDGES}, n as (select count(*) as n from edges), g as (select t, row_number() over (order by t, src, dst, k1, k2, k3) as place from edges) select case when place <= least(greatest(cast(floor(n * 0.85e0) as bigint), 1), n - 1) then 0 else 1 end as split, count(*) as n, min(t) as t_min, max(t) as t_max from g cross join n group by 1")
def split_rows(x):
    """The last 15 of 100 rows in time order are held out: a cut by rows, not by time."""
    n = x.edges().count()
    cut = min(max(int(n * 0.85), 1), n - 1)
    d = sampling.numbered(x.edges(), "t", "src", "dst", "k1", "k2", "k3").withColumn("split", F.when(F.col("place") < cut, 0).otherwise(1))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


@query(f"{EDGES}, g as (select t, src, dst, k1, k2, k3, row_number() over (order by t, src, dst, k1, k2, k3) as place, count(*) over () as n from edges), s as (select *, place > floor(n * 0.85e0) as held from g) select count(*) as n, count(*) filter (held) as n_held, case when max(t) filter (not held) < min(t) filter (held) then 1 else 0 end as disjoint, (select count(*) from (select src, dst from s where held intersect select src, dst from s where not held) y) as shared_pairs from s")
def split_audit(x):
    """Whether the time ranges of the two sides are disjoint, and how many pairs stand on both."""
    n = x.edges().count()
    d = sampling.numbered(x.edges(), "t", "src", "dst", "k1", "k2", "k3").withColumn("held", F.col("place") >= int(n * 0.85))
    both = d.groupBy("src", "dst").agg(F.count_if("held").alias("a"), F.count_if(~F.col("held")).alias("b")).agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared_pairs"))
    ends = d.agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("n_held"), F.max(F.when(~F.col("held"), F.col("t"))).alias("a"), F.min(F.when(F.col("held"), F.col("t"))).alias("b"))
    return ends.select("n", "n_held", F.expr("int(a < b)").alias("disjoint")).crossJoin(both)


@query("select c_custkey as qid from customer where c_custkey not in (select c_custkey from customer where c_custkey % 7 = 0)")
def reserved_rows(x):
    return x.queries().select("qid").join(x.queries().where("qid % 7 = 0").select("qid"), "qid", "left_anti")


# Evaluation

GE = f"{LQ}, p as (select *, max(case when pos = label then s1 end) over {W_S2} as p from sc), h as (select qid, count(*) filter (s1 > p + 1e-12) as g, count(*) filter (abs(s1 - p) <= 1e-12) - 1 as e, any_value(t) as t, any_value(src) as src, max(case when pos = label then c end) as c from p group by qid)"


@query(f"{GE} select avg(1e0 / (1 + g)) as mrr, avg(case when g < 1 then 1e0 else 0e0 end) as hit1, avg(case when g < 10 then 1e0 else 0e0 end) as hit10, median(g + 1e0) as median_rank from h")
def strict_metrics(x):
    return blend.strict(x.scored(), "s1", "label")


@query(f"{GE}, k as (select h.*, exists (select 1 from edges e where e.src = h.src and e.dst = h.c) as seen, coalesce((select count(*) from edges e where e.dst = h.c), 0) as n from h), c as (select quantile_cont(n, 0.2) as q1, quantile_cont(n, 0.4) as q2, quantile_cont(n, 0.6) as q3, quantile_cont(n, 0.8) as q4, median(t) as tm from k), b as (select k.*, 1 + (n >= q1)::int + (n >= q2)::int + (n >= q3)::int + (n >= q4)::int as bin, t > tm as late from k cross join c), r as (select 1e0 / (1 + g + 0.5e0 * e) as r, * from b) select 'pair seen' as grouping, case when seen then '1' else '0' end as grp, count(*) as n, avg(r) as mrr from r group by 2 union all select 'known', case when n > 0 then '1' else '0' end, count(*), avg(r) from r group by 2 union all select 'late', case when late then '1' else '0' end, count(*), avg(r) from r group by 2 union all select 'bin', cast(bin as varchar), count(*), avg(r) from r group by 2")
def grouped_metrics(x):
    """MRR by four groupings in one pass: pair seen, candidate known, half of the time, fifth of popularity."""
    d = x.scored().select("qid", "src", "t", F.element_at("cands", F.col("label").cast("int") + 1).alias("c"), blend.reciprocal(F.col("s1"), F.col("label")).alias("r"))
    pairs = x.edges().select("src", F.col("dst").alias("c")).distinct().withColumn("seen", F.lit(1))
    d = store.settled(d.join(pairs, ["src", "c"], "left").join(x.popularity().withColumnRenamed("dst", "c"), "c", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    cuts = d.agg(F.expr("percentile(n, array(0.2, 0.4, 0.6, 0.8))").alias("q"), F.median("t").alias("tm"))
    one = lambda name, g: F.struct(F.lit(name).alias("grouping"), g.cast("string").alias("grp"))
    bin_ = 1 + sum(F.expr(f"int(n >= q[{i}])") for i in range(4))
    groups = F.array(one("pair seen", F.coalesce("seen", F.lit(0))), one("known", F.expr("int(n > 0)")), one("late", F.expr("int(t > tm)")), one("bin", bin_))
    return d.crossJoin(F.broadcast(cuts)).select("r", F.explode(groups).alias("x")).groupBy("x.grouping", "x.grp").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mrr"))


@query(f"{GE}, s as (select case when qid % 3 = 0 then 0.35e0 when qid % 3 = 1 then 1e0 else 0.85e0 end as w, avg(1e0 / (1 + g + 0.5e0 * e)) as m from h group by qid % 3) select sum(w * m) / sum(w) as mrr from s")
def weighted_sets(x):
    w = F.expr("case qid % 3 when 0 then 0.35D when 1 then 1D else 0.85D end")
    return blend.over_sets(x.scored().withColumns({"set_name": F.col("qid") % 3, "set_weight": w}), "s1", "label")


Z = f"{LQ}, z as (select qid, pos, label, (s1 - avg(s1) over {W_S2}) / stddev_pop(s1) over {W_S2} as f1, (s2 - avg(s2) over {W_S2}) / stddev_pop(s2) over {W_S2} as f2 from sc)"


def _features(x):
    return x.scored().select("qid", "label", R.zscore(F.col("s1")).alias("f1"), R.zscore(F.col("s2")).alias("f2"))


@query(f"{Z}, w as (select unnest([{', '.join(f'{v}e0' for v in blend.GRID)}]) as v), a as (select 'f1' as name, v as value, qid, pos, label, v * f1 + 0e0 * f2 as s from z cross join w union all select 'f2', v, qid, pos, label, 1e0 * f1 + v * f2 from z cross join w), p as (select *, max(case when pos = label then s end) over (partition by name, value, qid) as p from a), h as (select name, value, qid, count(*) filter (s > p + 1e-12) as g, count(*) filter (abs(s - p) <= 1e-12) - 1 as e from p group by name, value, qid) select name, value, avg(1e0 / (1 + g + 0.5e0 * e)) as mrr from h group by name, value")
def weight_grid(x):
    """Every single change of two weights from (1, 0), in one pass."""
    return blend.grid(_features(x), ["f1", "f2"], "label", {"f1": 1.0})


@query()
def coordinate_descent(x):
    """Weights that the search ends with, and their MRR."""
    weights, mrr = blend.descend(_features(x), ["f1", "f2"], "label", {"f1": 1.0})
    return x.spark.createDataFrame([(k, float(v), mrr) for k, v in sorted(weights.items())], "name string, value double, mrr double")


@query(f"{Z}, tm as (select median(t) as tm from (select distinct qid, t from lq) y), w as (select unnest([0.0e0, 0.5e0, 1.0e0]) as w1), v as (select unnest([0.0e0, 0.25e0, 0.5e0]) as w2), a as (select w1, w2, qid, pos, label, w1 * f1 + w2 * f2 as s from z cross join w cross join v), p as (select *, max(case when pos = label then s end) over (partition by w1, w2, qid) as p from a), h as (select w1, w2, qid, count(*) filter (s > p + 1e-12) as g, count(*) filter (abs(s - p) <= 1e-12) - 1 as e from p group by w1, w2, qid) select w1, w2, avg(1e0 / (1 + g + 0.5e0 * e)) filter (t <= tm) as early, avg(1e0 / (1 + g + 0.5e0 * e)) filter (t > tm) as late from h join (select distinct qid, t from lq) q using (qid) cross join tm group by w1, w2")
def joint_grid(x):
    """A grid of two weights: the early half selects, the late half reports."""
    d = x.scored().select("qid", "t", "label", R.zscore(F.col("s1")).alias("f1"), R.zscore(F.col("s2")).alias("f2"))
    tm = d.agg(F.median("t").alias("tm"))
    tried = F.array(*[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2"), blend.reciprocal(blend.weighted([(F.col("f1"), a), (F.col("f2"), b)]), F.col("label")).alias("r")) for a in (0.0, 0.5, 1.0) for b in (0.0, 0.25, 0.5)])
    d = d.crossJoin(F.broadcast(tm)).select("t", "tm", F.explode(tried).alias("x"))
    half = lambda c, n: F.avg(F.when(c, F.col("x.r"))).alias(n)
    return d.groupBy("x.w1", "x.w2").agg(half(F.col("t") <= F.col("tm"), "early"), half(F.col("t") > F.col("tm"), "late"))


@query(f"{LQ}, k as (select qid, pos, s1, s2, row_number() over (partition by qid order by s1 desc, pos) as a, row_number() over (partition by qid order by s2 desc, pos) as b from sc), r as (select qid, max(case when a = 1 and b = 1 then 1e0 else 0e0 end) as top1, count(*) filter (a <= 3 and b <= 3) / (6e0 - count(*) filter (a <= 3 and b <= 3)) as j, case when stddev_pop(s1) > 1e-9 and stddev_pop(s2) > 1e-9 then corr(s1, s2) end as r, avg(abs(s1 - s2)) as d from k group by qid) select avg(top1) as top1, avg(j) as jaccard, avg(r) as pearson, avg(d) as mad, avg(top1) > 0.99 and avg(r) > 0.99 as pass from r")
def output_comparison(x):
    return blend.compared(x.scored(), "s1", "s2")


# Streams and order

@query(f"{ORD}, g as (select *, row_number() over (order by t, src, dst, k1, k2, k3) as place, count(*) over () as n from edges), b as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from g), r as (select src, dst, t, row_number() over (partition by src order by o desc) as rk from b where t > 0) select src, 0 as late, count(*) as held, cast(sum(dst) as bigint) as ids, max(t) as last_t from r where rk <= 12 group by src")
def streamed_histories(x):
    """The last twelve items of each source as the state of a stream, fed by time in five files: equal to the batch."""
    from chronorank.streaming import state

    at = store.folder(x.spark)
    e = x.ordered().withColumn("ord", F.col("ord").cast("long"))
    cuts = [r for r in e.agg(F.expr("percentile(t, array(0.2, 0.4, 0.6, 0.8))")).first()[0]]
    part = sum(F.when(F.col("t") > c, 1).otherwise(0) for c in cuts)
    e.withColumn("part", part).write.partitionBy("part").parquet(f"{at}/parts")
    parts = x.spark.read.schema(f"{e.schema.toDDL()}, part int").parquet(f"{at}/parts")
    for i in range(len(cuts) + 1):  # files in the order of time
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    schema = e.schema
    got = state.latest(state.replayed(x.spark, f"{at}/in", schema, f"{at}/out", f"{at}/state", 12))
    total = lambda c: F.aggregate("hist", F.lit(0).cast("long"), lambda s, v: s + v[c])
    return got.select("src", F.col("late").cast("int").alias("late"), F.size("hist").cast("long").alias("held"), total("dst").alias("ids"), F.array_max(F.transform("hist", lambda v: v["t"])).alias("last_t"))


@query(f"{LQ}, e as (select qid, src, t, pos, c, s2, exp(s2 * 8 - max(s2 * 8) over {W_S2}) as e from sc), p as (select *, e / sum(e) over {W_S2} as p from e), r as (select *, row_number() over (partition by qid order by s2 desc, pos) as rk from p), g as (select qid from r group by qid having max(p) filter (rk = 1) - max(p) filter (rk = 2) >= 0.001) select r.qid, src, cast(rk as integer) as rk, c as dst, t from r join g on r.qid = g.qid where rk <= 2 and t > 0 and c <> 7")
def gated_feedback(x):
    """What one batch feeds back: the two best of rows with a clear leader; the unknown id is skipped."""
    from chronorank.streaming import state

    d = x.scored().withColumn("scores", F.transform("s2", lambda s: s * 8))
    return state.gated(d, margin=0.001, k=2, unknown=7)


@query(f"{EDGES}, g as (select k1 * 100000000 + k2 * 10000000 + dst * 1000 + k3 as o, t from edges), l as (select o, t, lag(t) over (order by o) as p from g) select count(*) filter (p > t) as violations, min(o) filter (p > t) as first from l")
def time_order_check(x):
    """How often time steps back in the order of the line items, and where first."""
    e = x.edges().select((F.col("k1") * 100000000 + F.col("k2") * 10000000 + F.col("dst") * 1000 + F.col("k3")).alias("o"), "t")
    return history.sorted_by_time(e, "o")


# Co-occurrence, walks, mixtures and the fitted graph

COOC = "l as (select src, dst, row_number() over (partition by src order by max(o) desc) as rk from ord group by src, dst), p as (select x.dst as a, y.dst as b, count(*) as n from l x join l y on x.src = y.src and x.dst <> y.dst where x.rk <= 64 and y.rk <= 64 group by x.dst, y.dst having count(*) >= 2), tb as (select a, b, n, row_number() over (partition by a order by n desc, b) as rk from p qualify rk <= 128), tw as (select a, b, n, ln(1 + n) / max(ln(1 + n)) over (partition by a) as w from tb)"


@query(f"{LQ}, ord as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from edges), {COOC}, h as (select src, dst, row_number() over (partition by src order by o desc) as rk from ord qualify rk <= 40), s as (select src, count(*) as n from h group by src), g as (select q.src, q.c, count(*) as k, max(w) as m, sum(w) as t from (select distinct src, c from lq) q join h on h.src = q.src join tw on tw.a = q.c and tw.b = h.dst group by q.src, q.c) select qid, pos, coalesce(k / cast(n as double), 0) as hit_frac, coalesce(m, 0) as max_w, coalesce(g.t / n, 0) as mean_w from lq left join g on lq.src = g.src and lq.c = g.c left join s on lq.src = s.src")
def neighbour_block(x):
    """Tables whose keys can't be packed are left to the frames."""
    e = store.settled(x.edges())
    if (rows := probed.neighbour_block(e, x.queries(e))) is not None:
        return rows
    e = x.ordered()
    return graph.neighbour_block(history.last(e, 40), x.asks(), graph.capped(e))


def _step(k):
    i = u("node", "walk", str(k), seed=6)
    return f"d{k} as (select node, walk, cast(floor({i} * n) as bigint) as i, w{k - 1}.spot as q from w{k - 1} join deg on deg.a = w{k - 1}.spot), w{k} as (select node, walk, adj.b as spot from d{k} join adj on adj.a = d{k}.q and adj.i = d{k}.i)"


@query(f"{EDGES}, li as (select distinct -1 - src as a, dst as b from edges), bo as (select a, b from li union select b, a from li), adj as (select a, b, row_number() over (partition by a order by b) - 1 as i from bo), deg as (select a, count(*) as n from bo group by a), w0 as (select distinct -1 - src as node, walk, -1 - src as spot from edges cross join range(2) r(walk)), {', '.join(map(_step, range(1, 5)))} select node, cast(walk as integer) as walk, step, spot from ({' union all '.join(f'select node, walk, {k} as step, spot from w{k}' for k in range(5))}) z")
def random_walks(x):
    """Two walks of four steps from each source, over sources (negative) and destinations."""
    links = x.edges().select((-1 - F.col("src")).alias("a"), F.col("dst").alias("b")).distinct()
    return graph.walks(links, links.select(F.col("a").alias("node")).distinct(), 4, 2, seed=6).withColumnRenamed("at", "spot")


MIX = f"""{EDGES}, n as (select dst as id, count(*) as w from edges group by dst), cu as (select id, w, sum(w) over (order by id) as hi from n), tt as (select sum(w) as total from n), mm as (select max(p_partkey) + 100 as m from part),
 po as (select src as qid, max(dst) as dst, src % 5 as k from edges group by src),
 dr as (select qid, j, cast(floor({u('qid', 'j', seed=9)} * total) as bigint) as x from po cross join range(400) r(j) cross join tt), hi as (select d.qid, cu.id as item, min(d.j) as o from dr d join cu on d.x < cu.hi and d.x >= cu.hi - cu.w group by d.qid, cu.id),
 se as (select hi.qid, item, row_number() over (partition by hi.qid order by o) as place from hi join po on po.qid = hi.qid where item <> po.dst),
 un as (select i as id, row_number() over (order by i) - 1 as ix from mm, range(1, 1000000) r(i) where i <= m and i not in (select dst from edges)), us as (select count(*) as c from un),
 dc as (select qid, j, cast(floor({u('qid', 'j', seed=10)} * c) as bigint) as x from po cross join range(400) r(j) cross join us), co as (select qid, id, row_number() over (partition by qid order by min(j)) as place from dc join un on un.ix = dc.x group by qid, id)"""


@query(f"{MIX} select qid, dst as c, 'positive' as kind from po union all select se.qid, item, 'seen' from se join po on po.qid = se.qid where place <= 99 - k union all select co.qid, id, 'unseen' from co join po on po.qid = co.qid where place <= k")
def honest_lists(x):
    """Lists of a hundred: the positive, some unseen ids, and seen ones by popularity without replacement."""
    top = x.read("part").agg(F.max("p_partkey")).first()[0] + 100
    pos = x.edges().groupBy(F.col("src").alias("qid")).agg(F.max("dst").alias("dst")).withColumn("n_unseen", F.col("qid") % 5)
    return sampling.mixture(pos, x.popularity().withColumnRenamed("dst", "id"), "n", top, seed=9)


@query(f"{EDGES}, {EMB}, p as (select a.id as a, b.id as b, {COS.format('a.v', 'b.v')} as s from vecs a join vecs b on a.id <> b.id), nb as (select a, b, row_number() over (partition by a order by round(s, 12) desc, b) as rk from p qualify rk <= 16), po as (select src, max(dst) as dst from edges group by src), c as (select po.src, po.dst, nb.b as neg from po join nb on nb.a = po.dst where not exists (select 1 from edges e where e.src = po.src and e.dst = nb.b)) select src, dst, neg, cast(row_number() over (partition by src order by {u('src', 'neg', seed=12)}, neg) as bigint) as rk from c qualify rk <= 8")
def neighbour_negatives(x):
    """Hard negatives: nearest vectors of the positive that the source has never met."""
    pos = x.edges().groupBy("src").agg(F.max("dst").alias("dst"))
    d = sampling.neighbour_negatives(pos, vectors.nearest(x.vectors(), 16, 1024), x.edges(), 8, ["src"], seed=12)
    return d.select("src", "dst", "neg", F.col("rk").cast("long").alias("rk"))


FITTED = f"""{LQ}, ord as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from edges), mx as (select min(t) as tmin, max(t) as tmax, quantile_cont(t, 0.6) as c60, quantile_cont(t, 0.82) as c82 from edges),
 ds as (select dst, count(*) as n, count(*) filter (t >= c82) as late, count(*) filter (t >= c60 and t < c82) as mid, count(*) filter (t < c60) as old, count(*) filter (t >= tmax - 10800) as n3, count(*) filter (t >= tmax - 43200) as n12, max(t) as last from edges cross join mx group by dst),
 pr as (select src, dst, count(*) as pn from edges group by src, dst), so as (select src, count(*) as sn from edges group by src), te as (select c, count(*) as tn from lq group by c),
 rc as (select src, dst, row_number() over (partition by src order by o desc) as rk from ord), ex as (select src, dst, min(rk) as er from rc where rk <= 160 group by src, dst),
 sm as (select a.dst as a, b.dst as b, sum(1 / sqrt(b.o - a.o)) as w from ord a join ord b on a.src = b.src and b.o > a.o and b.o <= a.o + 16 and a.dst <> b.dst group by a.dst, b.dst), st as (select a, b, w, row_number() over (partition by a order by round(w, 6) desc, b) as k from sm qualify k <= 256),
 fw as (select src, b as c, sum(w / sqrt(rk)) as f from rc join st on st.a = rc.dst where rk <= 16 group by src, b), bw as (select src, a as c, sum(w / sqrt(rk)) as f from rc join st on st.b = rc.dst where rk <= 16 group by src, a),
 tp as (select greatest(ln(1 + max(n)), 1) as tn_, greatest(ln(1 + max(late)), 1) as tl, greatest(ln(1 + max(n3)), 1) as t3, greatest(ln(1 + max(n12)), 1) as t12 from ds), tq as (select greatest(ln(1 + max(pn)), 1) as tpn from pr), tr as (select greatest(ln(1 + max(sn)), 1) as tsn from so), tu as (select greatest(ln(1 + max(tn)), 1) as ttn from te)"""


@query(f"""{FITTED} select qid, pos, ln(1 + coalesce(n, 0)) / tn_ as pop, ln(1 + coalesce(late, 0)) / tl as recent_pop, greatest(-5, least(5, ln(1 + coalesce(late, 0)) - ln(1 + coalesce(mid, 0) + 0.25e0 * coalesce(old, 0)))) / 5 as trend, case when last is null then 0 else 1 / (1 + greatest(t - last, 0) / cast(greatest(tmax - tmin, 1) as double)) end as recency,
 coalesce(1 / sqrt(er), 0) as src_recent_exact, ln(1 + coalesce(pn, 0)) / tpn as pair_log, case when n is null then 0 else 1 end as dst_known, least(ln(1 + coalesce(n, 0)) / tn_, 0.72e0) as degree_cap, ln(1 + coalesce(tn, 0)) / ttn as candidate_seen_in_test, ln(1 + coalesce(n3, 0)) / t3 as pop_3h, ln(1 + coalesce(n12, 0)) / t12 as pop_12h,
 greatest(-5, least(5, ln(1 + coalesce(n3, 0)) - ln(1 + coalesce(n12, 0) / 4e0))) / 5 as trend_3h_12h, coalesce(fw.f, 0) as transition, coalesce(fw.f, 0) + coalesce(bw.f, 0) as symmetric_cooc, ln(1 + coalesce(sn, 0)) / tsn as source_activity
 from lq left join ds on lq.c = ds.dst left join pr on pr.src = lq.src and pr.dst = lq.c left join so on so.src = lq.src left join te on te.c = lq.c left join ex on ex.src = lq.src and ex.dst = lq.c left join fw on fw.src = lq.src and fw.c = lq.c left join bw on bw.src = lq.src and bw.c = lq.c cross join mx cross join tp cross join tq cross join tr cross join tu""")
def fitted_features(x):
    """Base features of the wide candidates from a fitted graph that was saved and loaded."""
    at = store.folder(x.spark)
    graph.TemporalGraph.fit(x.ordered(), x.asks()).save(at)
    return graph.TemporalGraph.load(x.spark, at).features(x.asks())



@query()
def svd_values(x):
    """The eight largest singular values of the time-weighted matrix of sources and destinations."""
    s, _, _ = embeddings.svd(embeddings.weights(store.settled(x.edges().select("src", "dst", "t"))), 8)
    return x.spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(s)], "i long, value double")


@query()
def skip_gram_vectors(x):
    return embeddings.skip_grams(x.ordered(), 16)


@query(f"{EDGES}, sp as (select min(t) as a, greatest(max(t) - min(t), 1) as s from edges) select src, dst, ln(1 + sum(1 + 2.8e0 * (t - a) / s)) as v from edges cross join sp group by src, dst")
def time_weights(x):
    return embeddings.weights(x.edges())


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
