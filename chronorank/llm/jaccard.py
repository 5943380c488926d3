"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Sets of a and b shingles link only if they differ
in at most (a + b) / 9 of them. For the band of sizes that holds the larger set, the hash range is cut into more parts than
that; a part's sketch is the exclusive or of its shingles, so a difference can spoil one part only (pigeonhole): a set
whose parts that are not empty outnumber the differences by k shares at least k sketches with every set it links with. It
may so leave out its k - 1 commonest sketches, and needs k that some other set holds too. A set with too many empty parts
goes on to the next seed, and in the last seed its empty parts count too: no link is lost. Of buckets with the same members
one is kept. Sets that share a bucket with its first member are compared in full; then those members of a bucket that are
still in different components, if sizes and 1024-bit sketches (Hamming distance at most the symmetric difference) allow it.
Equal sets are joined before, by a 128-bit hash, and only one of them is searched.

Null or empty texts have no set and stay alone; ties go to the smallest id; repeated rows give repeated results; rows
that share an id but not a text count with their own sets, and the shortest text (then the first by code point) stands for
the id in links; rows without an id have their own set size and a null component; an empty table gives no rows; very long
texts are read whole; other columns are ignored."""
import numpy as np
from pyspark.sql import functions as F

from chronorank.llm.shared import components, settled, small, trimmed

WORDS, SEEDS, RATIO, SLACK, BITS, SALTS, BLOCK = 5, 4, 1.5, 0.25, 1024, 64, 2048
WIDE, WIDE_FROM = 16384, 1200  # longer sketches of larger sets
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _scramble(x, seed):
    x = (x ^ (x >> np.uint64(32))) * MIX[seed]
    x = (x ^ (x >> np.uint64(29))) * MIX[4]
    return x ^ (x >> np.uint64(32))


def shingles(text):
    """Sorted distinct hashes of the text's shingles of WORDS words (of all words if there are fewer)."""
    b = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    word = ~SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    at, end = edge[::2], edge[1::2]
    if not len(at):
        return np.zeros(0, np.uint64)
    b, word, at, end = b[at[0] :], word[at[0] :], at - at[0], end - at[0]
    place = np.arange(len(b)) - np.repeat(at, np.diff(np.append(at, len(b))))
    each = _scramble((place.astype(np.uint64) << np.uint64(8)) + b + np.uint64(1), 0)
    each[~word] = 0
    w = _scramble(np.add.reduceat(each, at) + (end - at).astype(np.uint64), 1)
    n = min(WORDS, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = _scramble(h + w[i : len(w) - n + 1 + i], 2) + np.uint64(n)
    return np.unique(h)


def bands(top):
    """Upper ends of the size bands up to one that holds top."""
    ends = [4]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RATIO)))
    return ends


def _band(hi, seed):
    return np.uint64((hi * (SEEDS + 1) + seed) * int(MIX[2]) & (1 << 64) - 1)


def signatures(s):
    """[(band, need, hashes)]: a set shares at least need of a band's hashes (one, if need is 0) with every set it links with there."""
    n = len(s)
    if n < 4:  # different sets need at least 4 and 5 shingles to link
        return []
    ends, out = bands(n * 5 // 4), []
    for i, hi in enumerate(ends):
        if hi < n or (i and ends[i - 1] >= n * 5 // 4):
            continue
        most = 2 * hi // 9
        parts = most + max(2, int(np.ceil(most * SLACK)))
        for seed in range(SEEDS):
            h = _scramble(s, seed)
            part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(h)  # the part grows with the hash
            part, first = np.unique(part[order], return_index=True)
            sketch = np.bitwise_xor.reduceat(_scramble(s[order], 3), first)
            need = max(0, len(part) - (n + hi) // 9)
            out.append((i * (SEEDS + 1) + seed, need, _scramble(sketch + part * MIX[1], 0) + _band(hi, seed)))
            if need:
                break
        else:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part)
            out.append((i * (SEEDS + 1) + SEEDS, 0, _scramble(empty * MIX[1], 0) + _band(hi, SEEDS)))
    return out


def _sets(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            s = shingles(t)
            sketch = [np.packbits(np.bincount((_scramble(s, 3) % np.uint64(m)).astype(np.int64), minlength=m) & 1).view(np.int64) if m == BITS or len(s) >= WIDE_FROM else None for m in (BITS, WIDE)]
            rows.append((len(s), int(_scramble(s, 0).sum().view(np.int64)), int(_scramble(s, 3).sum().view(np.int64)), *sketch))
        n, a, b, k, w = zip(*rows) if rows else ((), (), (), (), ())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": np.array(n, np.int64), "a": np.array(a, np.int64), "b": np.array(b, np.int64), "sketch": list(k), "wide": list(w)})


def _parts(batches):
    import pandas as pd

    for pdf in batches:
        got, size = [], 0
        for i, t in zip(pdf["doc_id"], pdf["text"]):
            for band, need, x in signatures(shingles(t)):
                got.append((x.view(np.int64), np.full(len(x), i, np.int64), np.full(len(x), band << 40 | need, np.int64)))
                size += len(x)
            if size > 1 << 18:
                yield pd.DataFrame(dict(zip(("s", "rep", "code"), map(np.concatenate, zip(*got)))))
                got, size = [], 0
        if size:
            yield pd.DataFrame(dict(zip(("s", "rep", "code"), map(np.concatenate, zip(*got)))))


def buckets(parts):
    """s, rep, k (members): of the signatures those that a set can link by, and of equal buckets one."""
    shared = settled(parts.withColumn("f", F.expr("count(*) over (partition by s)")).where("f > 1"))
    rare = shared.withColumn("need", F.expr("code & ((1L << 40) - 1)"))
    rare = rare.withColumn("rk", F.expr("row_number() over (partition by rep, code order by f desc, s)")).withColumn("own", F.expr("count(*) over (partition by rep, code)"))
    rare = rare.where("own >= need and (need = 0 or rk >= need)").select("s", "rep")
    held = settled(rare.selectExpr("s", "rep", "count(*) over (partition by s) as k", "min(rep) over (partition by s) as pivot", "bit_xor(xxhash64(rep)) over (partition by s) as members").where("k > 1"))
    one = held.groupBy("k", "pivot", "members").agg(F.min("s").alias("s")).select("s")
    return settled(held.join(one, "s", "left_semi").drop("members"))


def _linked(batches):
    """Rows come sorted by (a, salt), the pivot's own text first."""
    import pandas as pd

    key, mine = None, None
    for pdf in batches:
        out = []
        for a, salt, b, t in zip(pdf["a"], pdf["salt"], pdf["b"], pdf["text"]):
            if (a, salt) != key:
                key, mine = (a, salt), shingles(t)
                continue
            s = shingles(t)
            both = len(np.intersect1d(mine, s, assume_unique=True))
            if 100 * both >= 80 * (len(mine) + len(s) - both):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _verify(pairs, texts, sets):
    """The pairs (a, b) that link: the sizes and the Hamming distance of whole sketches sort out, the texts decide."""
    of = {c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"k_{c}"), F.col("wide").alias(f"w_{c}")) for c in "ab"}
    near = lambda k: 9 * F.aggregate(F.zip_with(f"{k}_a", f"{k}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y) <= F.col("n_a") + F.col("n_b")
    pairs = pairs.distinct().join(of["a"], "a").join(of["b"], "b").where(F.expr("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)") & near("k") & F.coalesce(near("w"), F.lit(True)))
    pairs = settled(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")))
    own = pairs.select("a", "salt", F.col("a").alias("b"), F.lit(0).alias("turn")).distinct()
    rows = small(own.union(pairs.select("a", "salt", "b", F.lit(1)))).join(texts, F.col("b") == F.col("doc_id")).select("a", "salt", "turn", "b", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "turn").select("a", "salt", "b", "text").mapInPandas(trimmed(_linked), "a long, b long")


def _apart(held, comp, sketches):
    """Pairs (a, b) of a bucket in different components whose sizes and sketches let them link. Large buckets are met block by block."""
    inside = held.join(small(comp).withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = settled(inside.selectExpr("s", "rep", "k", "c", "max(c) over (partition by s) <> min(c) over (partition by s) as mixed").where("mixed").drop("mixed"))
    words = [f"w{i}" for i in range(BITS // 64)]
    full = mixed.join(sketches.select(F.col("doc_id").alias("rep"), "n", *[F.col("sketch")[i].alias(w) for i, w in enumerate(words)]), "rep")
    left = full.withColumn("block", F.expr(f"pmod(xxhash64(rep), cast(ceil(k / {BLOCK}) as long))")).drop("k").withColumnsRenamed({"rep": "a", "c": "ca", "n": "na"} | {w: f"a{w}" for w in words})
    right = full.withColumn("block", F.explode(F.expr(f"sequence(0L, cast(ceil(k / {BLOCK}) as long) - 1)"))).drop("k").withColumnsRenamed({"rep": "b", "c": "cb", "n": "nb"} | {w: f"b{w}" for w in words})
    far = " + ".join(f"bit_count(a{w} ^ b{w})" for w in words)
    fits = F.expr(f"a < b and ca <> cb and 5 * least(na, nb) >= 4 * greatest(na, nb) and 9 * ({far}) <= na + nb")
    return left.join(right, (left["s"] == right["s"]) & (left["block"] == right["block"]) & fits).select("a", "b").distinct()


def join(docs):
    """doc_id, n_shingles, component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = texts.select(F.col("doc_id").cast("string"), "text").mapInPandas(trimmed(_sets), "doc_id string, n long, a long, b long, sketch array<long>, wide array<long>")
    sets = settled(sets.withColumn("doc_id", F.col("doc_id").cast("long")))
    sizes, texts = sets.select("doc_id", "n"), texts.where("doc_id is not null")
    none = sizes.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    own = sets.where("doc_id is not null")
    twice = own.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if twice:
        texts = settled(texts.groupBy("doc_id").agg(F.min(F.struct(F.length("text"), "text")).alias("x")).select("doc_id", "x.text"))
        own = settled(texts.mapInPandas(trimmed(_sets), "doc_id long, n long, a long, b long, sketch array<long>, wide array<long>"))
    classes = own.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    # classes are salted for the copies' way to them: a class may hold a third of all rows
    salts = 16
    member = own.drop("sketch", "wide").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).join(classes.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))), ["n", "a", "b", "salt"], "left")
    member = settled(member.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    one = texts.join(small(member.where("doc_id <> rep or n < 4").select("doc_id")), "doc_id", "left_anti")
    held = buckets(one.mapInPandas(trimmed(_parts), "s long, rep long, code long"))
    sketches = own.join(small(held.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sketches = settled(sketches.select("doc_id", "n", "sketch", "wide"))
    near = settled(_verify(held.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")), one, sketches))
    far = _verify(_apart(held, settled(components(near)), sketches), one, sketches)
    comp = settled(components(near.union(far)))
    out = member.join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sizes.where("doc_id is not null").join(out.drop("n"), "doc_id") if twice else out
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)
