"""Queries of the subpackage and their SQL."""
from chronorank.llm import ann, bpe, html_extract, jaccard, langid, mixing, secrets, topk, toxicity, warc


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def op1_topk(spark, d):
    return topk.search(_read(spark, d, "embeddings"))


def op2_html(spark, d):
    return html_extract.extract(_read(spark, d, "pages"))


def op3_mixing(spark, d):
    return mixing.mix(_read(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark, d):
    return toxicity.score(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op5_langid(spark, d):
    return langid.predict(_read(spark, d, "documents"))


def op6_ann(spark, d):
    return ann.search(_read(spark, d, "embeddings"))


def op7_jaccard(spark, d):
    return jaccard.join(_read(spark, d, "documents"))


def op8_bpe(spark, d):
    import public_tokenizers

    return bpe.encode(_read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_warc(spark, d):
    return warc.roundtrip(_read(spark, d, "pages"))


def op10_secrets(spark, d):
    return secrets.scan(_read(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (op1_topk, op2_html, op3_mixing, op4_toxicity, op5_langid, op6_ann, op7_jaccard, op8_bpe, op9_warc, op10_secrets)}


def oracle_sql():
    return {"op1_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
 select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) x where rank <= 20"""}
