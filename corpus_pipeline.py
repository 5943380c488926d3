"""Training-data pipeline over documents: toxicity, near copies, secrets, mixing, BPE. Counted as part of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. Extra columns pass through, an empty table gives an empty one, rows with a null id or text are kept by the filters.
The stages run in the same executors: the session's Arrow batches are made short for those that send texts to Python."""
from pyspark.sql import functions as F

from chronorank.llm import bpe, jaccard, mixing, secrets, toxicity
from chronorank.llm.shared import folder, guarded, short_batches, small

TOKENIZER = "word_bpe_49k.json"
USES = ("doc_id", "text", "source", "n_chars")
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier does not reject."""
    short_batches(spark)
    judged = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = judged.where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(small(out), "doc_id", "left_anti").select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    """The document with the smallest id of each group of near copies; documents without words all stay."""
    short_batches(spark)
    out = jaccard.join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(small(out), "doc_id", "left_anti").select(*docs.columns)
    twice = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null")) if twice else kept


def cut_secrets(spark, docs, sf_dir):
    """Live-looking credentials are cut out of the texts; copied examples stay."""
    return guarded(docs, USES, secrets.redact)


def repeat_to_targets(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return guarded(docs, USES, lambda d: mixing.mix(d).where("reps > 0").withColumn("_n", F.explode(F.expr("sequence(1, cast(reps as int))"))))


def tokenise(spark, docs, sf_dir):
    """doc_id, n_tokens and the digests of every document of the mix."""
    import public_tokenizers

    short_batches(spark)
    done = bpe.encode(docs, public_tokenizers.path(TOKENIZER))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near copies", drop_copies), ("secrets", cut_secrets), ("mixing", repeat_to_targets), ("bpe", tokenise)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            at = folder(spark)
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
