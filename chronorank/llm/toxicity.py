"""Toxicity by weak supervision.

Voters are a lexicon of insults, patterns of abuse, and telling words or word beginnings that occur so often at least;
every voter says "toxic" or abstains. Their votes on all texts are taken in tasks, once. A generative label model (one clean
component, and one for each family of voters that vote together, such as those of a language) estimates the voters' rates
in each component by expectation maximisation over the votes of every learnable text, labelled or not, and their
correlations from the votes that two voters share beyond what the components explain: correlated voters share their weight.
The sums are made in tasks; rows for voters and pairs of voters reach the driver. Labels find the telling words, set the
prior and name the components; no label is a vote, so a posterior may overrule it. A linear classifier is trained on the
posterior labels of a hash sample of the learnable texts and scores every whole text.

Learns from documents with crc32(doc_id) mod 3 other than 1; telling words come from about SAMPLE labelled ones by hash.
Copies of a text count once. Null and empty texts are scored like a text without votes; texts of any length are read whole; repeated rows give repeated
results; conflicting labels of a document count as toxic; labels of unknown documents are ignored; without learnable
labels of both classes the lexicon and patterns alone vote, with PRIOR; an empty table gives no rows; other columns,
whatever their names, are ignored."""
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronorank.llm.shared import merged, pieces, settled, trimmed

# Bounds: labelled rows for telling words, texts for the classifier, telling words, kept pieces of a worker and their length, texts in a matrix of votes.
SAMPLE, FIT, TELLING, CACHE, LONG, ROWS = 20_000, 50_000, 512, 1 << 17, 64, 4096
# A telling part stands in LEAST toxic texts (divided by how many share the commonest word before or after it: words of copied
# texts and passages tell nothing), in LIFT times as large a share of them as of the clean ones, with a likelihood ratio that chance reaches about once among all such parts, and with
# MORE of that ratio beside others on its words.
LEAST, LIFT, MORE, PRIOR = 5, 4, 0.05, 0.05
STEMS, TIMES = (4, 5, 6, 7), (1, 2, 3, 4)
ROUNDS, SHARED, TOGETHER, FAMILIES, HOLD = 12, 0.2, 0.15, 12, 2
# Common insults.
INSULTS = """idiot idiots idiotic moron morons moronic stupid dumb dumbass fool imbecile cretin loser losers clown clowns trash garbage
scum filth filthy vermin worthless pathetic disgusting disgrace repulsive vile pig swine rat ugly freak creep jerk bastard bitch
asshole ass crap damn shit shitty fuck fucking fucker hate kill die retard retarded whore slut coward liar parasite""".split()
PHRASES = ("shut up", "go to hell", "drop dead", "kill yourself", "nobody likes you")
# Pattern, and pieces of which every match holds one.
PATTERNS = (
    (r"\byou(?:'re| are)? (?:an? |such an? |all |just |so )?(?:%s)\b" % "|".join(INSULTS), ("you",)),
    (r"\b(?:%s)\b" % "|".join(PHRASES), PHRASES),
    (r"\b[a-z]+[*@$#][a-z*@$#]+\b", tuple("*@$#")),
    (r"!{3,}", ("!!!",)),
)
WORD = re.compile(r"\w+")
HELD = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, false)"


def parts(word):
    """What a word counts for: itself and its beginnings."""
    return {word} | {"^" + word[:n] for n in STEMS if len(word) >= n}


def places(text, wanted):
    """(part, word before, word after) of the first place of each wanted part."""
    words, seen = ["", *WORD.findall((text or "").lower()), ""], {}
    for i in range(1, len(words) - 1):
        for p in parts(words[i]):
            if p in wanted and p not in seen:
                seen[p] = (p, words[i - 1], words[i + 1])
    return list(seen.values())


class Reader:
    """How often the wanted parts (all, without only) stand in a text. What a piece between white space holds is kept."""

    def __init__(self, only=None):
        self.only, self.kept = only, {}

    def _piece(self, piece):
        got = Counter(p for w in WORD.findall(piece) for p in parts(w) if len(p) > 1 and (self.only is None or p in self.only))
        if len(piece) <= LONG:  # and at most CACHE of them
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[piece] = tuple(got.items())
        return tuple(got.items())

    def __call__(self, low):
        seen, kept = {}, self.kept
        for piece, n in Counter(low.split()).items():
            known = kept.get(piece)
            if known is None:
                known = self._piece(piece)
            for p, k in known:
                seen[p] = seen.get(p, 0) + n * k
        return seen


def reached(text, read):
    """(part, least count) pairs that a text reaches."""
    return [(p, least) for p, n in read((text or "").lower()).items() for least in TIMES if n >= least]


def ratio(toxic, clean, n1, n0):
    """Likelihood ratio (twice its log) of a part in toxic of n1 and clean of n0 texts; 0 where it tells nothing or the opposite."""
    a, b = np.asarray(toxic, float), np.asarray(clean, float)
    p = (a + b) / (n1 + n0)
    g = sum(o * np.log(np.maximum(o, 1e-9) / np.maximum(n * q, 1e-9)) for o, n, q in ((a, n1, p), (n1 - a, n1, 1 - p), (b, n0, p), (n0 - b, n0, 1 - p)))
    return np.where(a * n0 > b * n1, 2 * g, 0)


def choose(counts, n1, n0, tried):
    """Telling (part, least) of counts {(part, least): (toxic, clean)}, of so many that were tried. A part of a word that a chosen beginning or insult covers
    has to be telling among the texts that hold that, too."""
    keys = sorted(counts)
    g = ratio(*zip(*(counts[k] for k in keys)), n1, n0) if keys else []
    bar = 2 * np.log(max(2, tried))
    out = [(w, 1) for w in INSULTS if (w, 1) in counts]
    for r, (part, least) in sorted(zip(g, keys), key=lambda x: (-x[0], x[1])):
        a, b = counts[part, least]
        over = [k for k in out if k[1] <= least and (k[0] == part or k[0][0] == "^" and part.lstrip("^").startswith(k[0][1:]) or part[0] == "^" and k[0].startswith(part[1:]))]
        if r >= bar and a >= LEAST and a * n0 >= LIFT * b * n1 and all(_adds(a, b, *counts[k]) >= MORE * bar for k in over):
            out.append((part, least))
    return [k for k in out if k[1] > 1 or k[0] not in INSULTS][:TELLING]


def _adds(a, b, n1, n0):
    """Likelihood ratio of a part in a toxic and b clean texts beside another one in n1 and n0: within its texts, or outside of them."""
    return float(ratio(a, b, n1, n0)) if a <= n1 and b <= n0 else float(ratio(a - n1, max(0, b - n0), a, max(b, 1))) if a > n1 else 0.0


def lexicon(counts, n1, n0):
    """The insults, but for those that as many clean texts hold: they are other words in the languages at hand."""
    odd = {w for w in INSULTS if counts.get((w, 1), (0, 0))[1] >= LEAST and ratio(*counts[w, 1], n1, n0) < 2 * LEAST}
    return [(w, 1) for w in INSULTS if w not in odd]


class Voters:
    """One voter for each (word or beginning, least count) of words, and for each pattern."""

    def __init__(self, words):
        self.at = {}
        for i, (w, least) in enumerate(words):
            self.at.setdefault(w, []).append((least, i))
        self.read, self.patterns, self.first = Reader(self.at), [(re.compile(p), s) for p, s in PATTERNS], len(words)
        self.n = self.first + len(self.patterns)

    def votes(self, text):
        """Places of the voters that speak for toxic, ascending."""
        low = (text or "").lower()
        got = [i for p, n in self.read(low).items() for least, i in self.at[p] if n >= least]
        got += [self.first + i for i, (p, some) in enumerate(self.patterns) if any(x in low for x in some) and p.search(low)]
        return sorted(got)


def table(votes, m):
    """Votes as a matrix of zeros and ones."""
    out = np.zeros((len(votes), m))
    for i, v in enumerate(votes):
        out[i, np.asarray(v, np.int64)] = 1
    return out


def evidence(share, rates, weight):
    """For each component, its log share and what no vote and each vote add to it."""
    none = np.log1p(-rates) * weight
    return np.log(share) + none.sum(1), np.log(rates) * weight - none


def posterior(votes, base, delta):
    """Posterior of every component for each text."""
    s = base + table(votes, delta.shape[1]) @ delta.T
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def families(total, alone, both, m):
    """Voters that vote together, around the busiest voter not yet in a family: the seeds of the toxic components."""
    p = np.maximum(alone / max(total, 1), 1e-9)
    near = {}
    for i, j, n in both:
        if n >= LEAST and (n / total - p[i] * p[j]) / np.sqrt(p[i] * (1 - p[i]) * p[j] * (1 - p[j])) > TOGETHER:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    out, held = [], set()
    for i in sorted(range(m), key=lambda i: (-alone[i], i)):
        own = {i} | near.get(i, set()) - held
        if i not in held and len(own) > 1 and len(out) < FAMILIES:
            out.append(sorted(own))
            held |= own
    return out


def label_model(gather, m, prior, rounds=ROUNDS):
    """Shares of the components (the first one is clean, the others are ways of being toxic), each voter's rate in them, and its weight.

    gather(base, delta, pairs) gives, over all learnable texts, the sum of the posteriors, for each voter that of the texts it
    votes on, and with pairs that of the texts for (i, j, .) both of which vote."""
    n, own, both = gather(np.zeros(1), np.zeros((1, m)), True)
    seeds = families(n[0], own[:, 0], [(i, j, s[0]) for i, j, s in both], m)
    if not seeds:  # too few votes to learn from: two votes say toxic
        return np.array([1 - prior, prior]), np.array([np.full(m, 0.001), np.full(m, 0.02)]), np.ones(m)
    k, weight = len(seeds) + 1, np.ones(m)
    rates = np.tile(np.clip(own[:, 0] / max(n[0], 1), 1e-5, 0.5), (k, 1))
    for i, seed in enumerate(seeds):
        rates[1:, seed], rates[0, seed] = 1e-3, np.minimum(rates[0, seed] / 10, 0.01)
    for i, seed in enumerate(seeds):
        rates[i + 1, seed] = 0.3
    held, start = np.array([own[seed, 0].max() for seed in seeds]), rates.copy()
    share = np.append(1 - prior, prior * held / held.sum())
    for turn in range(rounds):
        pairs = turn == rounds // 2
        n, own, both = gather(*evidence(share, rates, weight), pairs)
        share = (n + 0.01) / (n + 0.01).sum()
        rates = np.clip((own.T + HOLD * start) / (n[:, None] + HOLD), 1e-6, 0.99)
        if pairs:  # what two voters share beyond the components is one vote, not two
            load = np.zeros(m)
            for i, j, s in both:
                c = int(np.argmax(s[1:])) + 1
                if s[c] >= LEAST:
                    x, y = rates[c, i], rates[c, j]
                    r = (s[c] / n[c] - x * y) / np.sqrt(x * (1 - x) * y * (1 - y))
                    if r > SHARED:
                        load[[i, j]] += min(r, 1)
            weight = 1 / (1 + load)
    return share, rates, weight


def naming(known, counts, y):
    """How toxic each component is, as labelled texts (posteriors known, counts, labels y) name them; without any, the first is clean."""
    c = np.asarray(counts, float)[:, None] * known
    first = np.arange(known.shape[1]) > 0
    return (c.T @ np.asarray(y, float) + 0.1 * first) / (c.sum(0) + 0.1)


def sums(votes, counts, base, delta, pairs):
    """(i, j, component, posteriors) summed over these texts: j is -1 for a voter alone; i is -1 for all texts."""
    v, q = table(votes, delta.shape[1]), posterior(votes, base, delta) * np.asarray(counts, float)[:, None]
    out = [(-1, -1, c, x) for c, x in enumerate(q.sum(0).tolist())]
    own = v.T @ q
    out += [(i, -1, c, own[i, c]) for i, c in zip(*np.nonzero(own))]
    for c in range(q.shape[1] if pairs else 0):
        both = np.triu((v * q[:, c : c + 1]).T @ v, 1)
        out += [(i, j, c, both[i, j]) for i, j in zip(*np.nonzero(both))]
    return [(int(i), int(j), int(c), float(x)) for i, j, c, x in out]


def added(rows, m, k):
    """What gather() gives, from rows (i, j, component, posteriors)."""
    n, own, both = np.zeros(k), np.zeros((m, k)), {}
    for i, j, c, s in rows:
        if i < 0:
            n[c] = s
        elif j < 0:
            own[i, c] = s
        else:
            both.setdefault((i, j), np.zeros(k))[c] = s
    return n, own, sorted(((*x, s) for x, s in both.items()), key=lambda x: x[:2])


def train(votes, counts, p, m, rounds=1500, l2=3e-5, step=1.0, balance=16.0, cut=0.35):
    """Weights and bias of a logistic regression on posterior labels (full batches, momentum).

    balance, cut, LEAST, LIFT, MORE and HOLD were chosen by cross-validation over learnable rows alone."""
    v = table(votes, m)
    y = (p > cut).astype(float)
    c = np.asarray(counts, float) * np.where(y > 0, balance, 1.0)
    c /= c.sum()
    w, b, mw, mb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(v @ w + b, -30, 30))) - y) * c
        mw, mb = 0.9 * mw + g @ v + l2 * w, 0.9 * mb + g.sum()
        w, b = np.maximum(w - step * mw, 0), b - step * mb  # a vote never speaks for clean
    return w, float(b)


def linear(votes, w, b):
    return 1 / (1 + np.exp(-np.clip(table(votes, len(w)) @ w + b, -30, 30)))


def _telling(docs, labels):
    """(words that vote, share of toxic rows, labelled sample)."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(f"doc_id is not null and y is not null and not {HELD}")
    ids = ids.groupBy("doc_id").agg(F.max(F.expr("int(y > 0)")).alias("y"))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(ids.count(), 1))))
    ids = settled(ids)  # about SAMPLE rows of two numbers
    rows = settled(docs.join(F.broadcast(ids), "doc_id").where("text is not null").select("text", "y").distinct())
    size = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return lexicon({}, 1, 1), PRIOR, ids

    def count(df, only):
        def run(batches):
            seen, read = Counter(), Reader(only and {p for p, _ in only})
            for pdf in batches:
                for t in pdf["text"]:
                    seen.update(x for x in reached(t, read) if only is None or x in only)
            yield from pieces(((p, k, n) for (p, k), n in seen.items()), ["p", "least", "n"])

        return df.select("text").mapInPandas(trimmed(run), "p string, least int, n long").groupBy("p", "least").agg(F.sum("n").alias("n"))

    own = [(w, 1) for w in INSULTS]
    local = lambda df: dict(zip(zip(*(x[c].to_pylist() for c in ("p", "least"))), x["n"].to_pylist())) if (x := df.toArrow()).num_rows else {}
    toxic = local(count(rows.where("y = 1"), None).where(F.col("n") >= LEAST))  # bounded by the sample
    keys = sorted(toxic)  # of these, only what would be telling if no clean text held it
    most = ratio([toxic[k] for k in keys], np.zeros(len(keys)), n1, n0) if keys else []
    only = frozenset([k for k, g in zip(keys, most) if g >= 2 * np.log(max(2, len(keys)))] + own)
    clean = local(count(rows.where("y = 0"), only))
    seen = len(keys)
    counts = {k: (toxic.get(k, 0), clean.get(k, 0)) for k in only}
    wanted = frozenset(p for p, _ in only)

    def stand(batches):
        for pdf in batches:
            yield from pieces((x for t in pdf["text"] for x in places(t, wanted)), ["p", "before", "after"])

    at = settled(rows.where("y = 1").select("text").mapInPandas(trimmed(stand), "p string, before string, after string"))
    top = [at.groupBy("p", c).agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.sum("n").alias("n"), F.max("n").alias(c)) for c in ("before", "after")]
    spread = top[0].join(top[1].drop("n"), "p").select("p", (F.col("n") / F.greatest("before", "after")).alias("x")).toArrow()
    spread = dict(zip(spread["p"].to_pylist(), spread["x"].to_pylist()))
    counts = {k: v for k, v in counts.items() if k in own or spread.get(k[0], 0) >= LEAST}
    return lexicon(counts, n1, n0) + choose(counts, n1, n0, seen), n1 / (n1 + n0), ids


def score(docs, labels):
    """doc_id, held_out, score, predicted."""
    import pandas as pd

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words, prior, ids = _telling(docs, labels)
    m = Voters(words).n

    def vote(batches):
        voters = Voters(words)
        for pdf in batches:
            yield pdf[["doc_id", "held_out", "copy"]].assign(votes=[voters.votes(t if isinstance(t, str) else "") for t in pdf["text"]])

    # ids go to Python as text: beside nulls they would become floats
    votes = docs.select(F.col("doc_id").cast("string"), F.expr(HELD).alias("held_out"), F.xxhash64("text").alias("copy"), "text").mapInPandas(trimmed(vote), "doc_id string, held_out boolean, copy long, votes array<int>")
    votes = settled(votes.withColumn("doc_id", F.col("doc_id").cast("long")))
    learn = settled(votes.where("not held_out").dropDuplicates(["copy"]).drop("held_out", "copy"))  # copies of a text count once
    kinds = settled(learn.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))

    def gather(base, delta, pairs):
        def run(batches):
            for pdf in merged(batches, ROWS):
                for at in range(0, len(pdf), ROWS):
                    yield pd.DataFrame(sums(pdf["votes"][at : at + ROWS], pdf["n"][at : at + ROWS], base, delta, pairs), columns=["i", "j", "c", "s"])

        rows = kinds.mapInPandas(trimmed(run), "i int, j int, c int, s double").groupBy("i", "j", "c").agg(F.round(F.sum("s"), 6).alias("s"))
        rows = rows.where(F.expr(f"j < 0 or s >= {LEAST}")).toArrow()  # bounded by voters (twice: their pairs) and components
        return added(zip(*(rows[c].to_pylist() for c in ("i", "j", "c", "s"))), m, len(base))

    def local(df, *by):
        """Kinds of votes on the driver, in a fixed order."""
        got = df.groupBy("votes", *by).agg(F.count(F.lit(1)).alias("n")).toPandas()
        order = sorted(range(len(got)), key=lambda i: (tuple(got["votes"][i]), *(got[c][i] for c in by)))
        return [[got[c][i] for i in order] for c in ("votes", "n", *by)]

    model = evidence(*label_model(gather, m, prior))
    seen, times, y = local(learn.join(F.broadcast(ids), "doc_id"), "y")  # about SAMPLE texts
    names = naming(posterior(seen, *model), times, y)
    rate = int((1 << 30) * min(1.0, FIT / max(learn.count(), 1)))
    seen, times = local(learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate))  # about FIT texts
    w, b = train(seen, times, posterior(seen, *model) @ names, m) if seen else (np.zeros(m), -3.0)

    def run(batches):
        for pdf in batches:
            s = np.concatenate([linear(pdf["votes"][at : at + ROWS], w, b) for at in range(0, len(pdf), ROWS)] or [np.zeros(0)])
            yield pdf[["doc_id", "held_out"]].assign(score=s, predicted=(s >= 0.7).astype("int32"))

    out = votes.select(F.col("doc_id").cast("string"), "held_out", "votes").mapInPandas(trimmed(run), "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
