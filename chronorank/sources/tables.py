"""Parquet sources and the edge view that the operators share."""
import re

TABLES = ("lineitem", "orders", "events", "embeddings")
SPARK_TIME, DUCK_TIME = "unix_micros(cast(o_orderdate as timestamp)) div 1000000", "epoch_us(o_orderdate) // 1000000"
EDGES = """edges as (select o_custkey as src, l_partkey as dst, cast({time} as bigint) as t, l_orderkey as k1, l_linenumber as k2, l_suppkey as k3
  from lineitem join orders on l_orderkey = o_orderkey)"""


def run(spark, sf_dir: str, sql: str):
    """Run one query over the tables below sf_dir, which are handed to it: no view of the session is touched."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql), **named)
