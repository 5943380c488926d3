"""Files as the survey's pipeline has them: edge and query CSV (plain or gz), matrices, ZIP members, lines of scores."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(n, T.LongType(), n == "split") for n in ("src", "dst", "time", "split")])


def edges_csv(spark, path):
    """src, dst, time, split of a CSV with header (gz is read by its ending); broken lines raise, a missing column too."""
    have = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in ("src", "dst", "time") if c not in have]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    kinds = ", ".join(f"{c} {'long' if c in EDGE.fieldNames() else 'string'}" for c in have)
    df = spark.read.schema(kinds).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select("src", "dst", "time", *([F.col("split").cast("int").alias("split")] if "split" in have else []))


def queries_csv(spark, path, width=100):
    """src, time and cands, an array of width ids: a CSV of exactly width + 2 columns."""
    have = spark.read.option("header", True).csv(path).columns
    if len(have) != width + 2:
        raise ValueError(f"{path} has {len(have)} columns, not {width + 2}")
    df = spark.read.schema(", ".join(f"`{c}` long" for c in have)).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(F.col(have[0]).alias("src"), F.col(have[1]).alias("time"), F.array(*have[2:]).alias("cands"))


def dataset(spark, folder, names=("train.csv", "test.csv")):
    """Paths of the files of a data set, each plain or gz; one that is missing raises."""
    sc, out = spark.sparkContext, []
    for name in names:
        paths = [sc._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}{end}") for end in ("", ".gz")]
        found = [str(p.toString()) for p in paths if p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)]
        if not found:
            raise FileNotFoundError(f"{folder} has no {name}")
        out.append(found[0])
    return out


def unpivot(queries, *keep):
    """qid and other columns, pos, c: a row for each slot; one candidate may stand in several slots."""
    return queries.select(*keep, F.posexplode("cands").alias("pos", "c"))


def zip_lines(spark, path, member):
    """path, place, line of a member of ZIP files, read as binary files (a file is read by one task)."""
    import pandas as pd

    def run(batches):
        import io
        import zipfile

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    lines = z.read(member).decode().splitlines()
                yield pd.DataFrame({"path": p, "place": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, place long, line string")


def write_lines(rows, order, line, path, compression=None):
    """Lines in the given order, as text files; a range of the order in each file."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(line).alias("value"))
    out.write.option("compression", compression or "none").text(path)


def validated(rows, key="qid", probs="p", width=100):
    """One row: rows, bad rows (wrong width, out of 0..1, sum off 1 by over 1e-5), the first bad one, and ranges."""
    total = F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)
    bad = (F.size(probs) != width) | (F.array_min(probs) < -1e-12) | (F.array_max(probs) > 1 + 1e-12) | (F.abs(total - 1) > 1e-5)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col(key))).alias("first_bad"), F.min(total).alias("sum_min"), F.max(total).alias("sum_max"), F.min(F.array_min(probs)).alias("p_min"), F.max(F.array_max(probs)).alias("p_max"))
