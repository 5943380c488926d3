"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Matches per kind are leftmost and do not overlap; positions are running sums over the lengths of the pieces between matches,
a row for each match, so that a text costs in proportion to its length and its matches. A candidate's hash is counted over
the corpus by distinct repositories and owners. The documents name neither, so a distinct text stands for a repository and
its source for the owner; both are parameters. Its spread is the number of repositories that hold it, divided by how many of
them share the commonest surroundings on the left or on the right (up to the next match): copies of a document or passage
add nothing to it. A value spread widely over several owners, or very widely over one, is an example; any other looks live.

Null texts count as empty; repeated rows give repeated results; whole texts are scanned, whatever their length; null owners
count as one owner; an empty table gives no rows; other columns, whatever their names, are ignored by scan() and kept by
redact()."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronorank.llm.shared import guarded, settled

# Characters on each side that are a value's surroundings, and the least spread of an example over several owners and over one.
AROUND, SPREAD, ALONE = 40, 8, 64
EXAMPLES = 100_000  # hashes that may be broadcast

ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Kind, pattern with the value as its group, and the least length of a value.
KINDS = (("assign", ASSIGN, 8), ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]{32,})", 32))


def _pieces(pattern, text="_t"):
    """Every match m with its value v, the piece g before it and the piece after it; each array is made once."""
    p, g = F.lit(pattern), F.split(text, pattern, -1)
    return F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(1)).alias("v"), F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))).alias("g"), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))).alias("after"))


def _matches(hit, pattern, least, *more):
    """A row for each match: _row, pos, h (null if the value is too short) and more columns of its piece x."""
    rows = hit.where(F.col("_t").rlike(pattern)).select("_row", F.posexplode(_pieces(pattern)).alias("pos", "x"))
    return rows.select("_row", "pos", F.when(F.length("x.v") >= least, F.sha2(F.col("x.v").cast("binary"), 256)).alias("h"), *more)


def _values(hit):
    """A row for each candidate of hit(_row, _t): _row, rank, kind, start, end, h, left, right."""
    plain = lambda x: F.xxhash64(F.lower(F.regexp_replace(F.expr(x), r"\s+", " ")))
    more = [F.length("x.g").alias("gap"), F.length("x.m").alias("n"), plain(f"right(x.g, {AROUND})").alias("left"), plain(f"left(x.after, {AROUND})").alias("right")]
    w = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for rank, (kind, pattern, least) in enumerate(KINDS):
        rows = _matches(hit, pattern, least, *more).withColumn("end", F.sum(F.col("gap") + F.col("n")).over(w)).where("h is not null")
        out.append(rows.select("_row", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end", "h", "left", "right"))
    return out[0].unionAll(out[1]).unionAll(out[2])


def _examples(values, owner_of, examples_from):
    """Hashes h of the values that are examples; owner_of has _row, _owner and _repository."""
    each = values.select("_row", "h", "left", "right").join(owner_of, "_row")
    texts = each.groupBy("h", "_repository").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    top = lambda side: texts.groupBy("h", side).agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max("n").alias(f"top_{side}"), F.sum("n").alias(f"n_{side}"))
    owners = each.select("h", "_owner").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    spread = F.col("n_left") / F.greatest("top_left", "top_right")
    wide = top("left").where(F.col("n_left") >= SPREAD).join(top("right"), "h").join(owners, "h")
    return wide.where((spread >= SPREAD) & (F.col("owners") >= examples_from) | (spread >= ALONE)).select("h", F.lit(True).alias("example"))


def _marked(docs, owner, repository):
    """docs with _t (the text if something matches), _owner, _repository and _row."""
    t, match = F.coalesce("text", F.lit("")), F.lit(False)
    for _, pattern, _ in KINDS:
        match = match | t.rlike(pattern)
    own = F.xxhash64(F.col(repository)) if repository else F.xxhash64(t)
    return docs.withColumns({"_t": F.when(match, t), "_owner": F.col(owner), "_repository": F.when(match, own)}).withColumn("_row", F.monotonically_increasing_id())


def scan(docs, examples_from=2, owner="source", repository=None):
    """doc_id, counts, base_sha256, spans, n_live and n_example (candidates by ownership and spread)."""
    rows = settled(_marked(docs.select(*dict.fromkeys(["doc_id", "text", owner, *([repository] if repository else [])])), owner, repository).select("doc_id", "_t", "_owner", "_repository", "_row"))
    hit = rows.where("_t is not null")
    values = settled(_values(hit))
    examples = _examples(values, hit.select("_row", "_owner", "_repository"), examples_from)
    judged = values.select("_row", "h").distinct().join(examples, "h", "left").groupBy("_row").agg(F.count_if(F.col("example").isNull()).alias("n_live"), F.count("example").alias("n_example"))
    spans = values.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("s"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, _, _ in KINDS])
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    out = rows.select("doc_id", "_row").join(spans.withColumn("spans", text).drop("s").join(judged, "_row"), "_row", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text = F.coalesce("spans", F.lit(""))
    return out.select("doc_id", *[n(f"n_{k}") for k, _, _ in KINDS], F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"), n("n_live"), n("n_example"))


def redact(docs, examples_from=2, mark="[SECRET]", owner="source", repository=None):
    """docs with every candidate that is not clearly an example cut out of the text; n_chars follows.

    Kind by kind, the pieces between matches are joined again, with the mark in place of the live ones. All rows and columns
    stay; texts without a live candidate (null ones too) are returned as they are."""

    def change(d):
        names = d.columns
        hit = settled(_marked(d, owner, repository).where("_t is not null"))
        examples = settled(_examples(_values(hit), hit.select("_row", "_owner", "_repository"), examples_from))
        now = hit.select("_row", "_t")
        for _, pattern, least in KINDS:
            each = _matches(now, pattern, least).join(F.broadcast(examples) if examples.limit(EXAMPLES + 1).count() <= EXAMPLES else examples, "h", "left")
            flags = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("h").isNotNull() & F.col("example").isNull()).alias("live")))).alias("flags"))
            joined = F.array_join(F.transform(F.arrays_zip(_pieces(pattern).alias("x"), "flags"), lambda y: F.concat(y["x"]["g"], F.when(y["flags"]["live"], F.lit(mark)).otherwise(y["x"]["m"]))), "")
            last = F.element_at(F.split("_t", pattern, -1), -1)
            now = settled(now.join(flags, "_row", "left").select("_row", F.when(F.col("flags").isNotNull(), F.concat(joined, last)).otherwise(F.col("_t")).alias("_t")))
        new = hit.withColumnRenamed("_t", "_old").join(now, "_row").withColumn("_cut", F.col("_t") != F.col("_old"))
        new = new.withColumn("text", F.when(F.col("_cut"), F.col("_t")).otherwise(F.col("text")))
        if "n_chars" in names:
            new = new.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return new.select(*names).unionByName(_marked(d, owner, repository).where("_t is null").select(*names))

    return guarded(docs, ("text", "n_chars", owner, repository), change)
