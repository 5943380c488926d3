"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learns from every document with text, a language and crc32(doc_id) mod 3 other than 1. The matrix of log probabilities
(buckets x languages) is broadcast; its size is fixed by BUCKETS and the number of languages. Texts are scored in batches:
the n-grams of a batch are counted into a sparse matrix (texts x buckets, compressed rows), which is multiplied by the
matrix of log probabilities.

Null texts and texts without a letter get `und` with score 0; ties go to the first language by code point; without
learnable rows all are `und`. Whole texts are read, whatever their length; repeated rows are learnt from and scored each;
an empty table gives no rows; other columns, whatever their names, are ignored."""
import numpy as np
import regex
from pyspark.sql import functions as F

BUCKETS, ORDERS, BATCH = 1 << 15, (1, 2, 3), 16
BREAK = regex.compile(r"\P{L}+")


def grams(text):
    """Bucket of each n-gram of the lower-cased words; None without a letter."""
    words = BREAK.sub(" ", text.lower()).strip()
    if not words:
        return None
    a = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(a), np.uint64)
    for n in ORDERS:
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * np.uint64(1000003) + a[n - 1 :] + np.uint64(n)
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


def sparse(found):
    """Compressed rows (starts, buckets, counts) of the n-grams of some texts."""
    dense = np.array([np.bincount(g, minlength=BUCKETS) for g in found])
    row, bucket = np.nonzero(dense)
    return np.searchsorted(row, np.arange(len(found))), bucket, dense[row, bucket]


def scores(found, logp):
    """Log probability of each text (with one n-gram at least) under each language."""
    start, bucket, n = sparse(found)
    return np.add.reduceat(logp[bucket] * n[:, None], start, axis=0, dtype=np.float64)


def _count(batches):
    import pandas as pd

    total = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            if (g := grams(text)) is not None:
                c = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                c += np.bincount(g, minlength=BUCKETS)
    for lang, c in total.items():
        b = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "bucket": b, "n": c[b]})


def fit(docs):
    """(languages, log probabilities) from the learnable documents."""
    learn = docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1 and lang is not null and text is not null")
    counts = learn.select("lang", "text").mapInPandas(_count, "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(rows["lang"].unique())
    m = np.full((BUCKETS, len(langs)), 0.5)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        m[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return langs, np.log(m / m.sum(0)).astype(np.float32)


def predict(docs):
    """doc_id, held_out, lang_pred, score."""
    langs, logp = fit(docs)
    model = docs.sparkSession.sparkContext.broadcast(logp)

    def score(batches):
        for pdf in batches:
            out, texts = [("und", 0.0)] * len(pdf), pdf["text"].tolist()
            for at in range(0, len(texts) if langs else 0, BATCH):
                found = [(at + i, g) for i, t in enumerate(texts[at : at + BATCH]) if isinstance(t, str) and (g := grams(t)) is not None]
                for (i, _), s in zip(found, scores([g for _, g in found], model.value) if found else ()):
                    k = int(s.argmax())
                    out[i] = langs[k], float(1 / np.exp(s - s[k]).sum())
            yield pdf[["doc_id", "held_out"]].assign(lang_pred=[x[0] for x in out], score=[x[1] for x in out])

    held = F.coalesce(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"), F.lit(False))
    out = docs.select(F.col("doc_id").cast("string"), held.alias("held_out"), "text").mapInPandas(score, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))  # as text: pandas would round long ids beside nulls
