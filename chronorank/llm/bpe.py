"""BPE encoding and decoding over a minimal acyclic transducer.

The corpus's most frequent words (counted over all documents) are compiled into a shared-suffix automaton over their
UTF-8 bytes: every state holds the number of words below it, so that a path adds up to the word's place in the table of
outputs (its ids). The arrays are broadcast (at most LEXICON words) and memory-mapped by the workers.
The distinct words of a group of texts that are not yet known go through the automaton together, a byte of all of them at a
time, and words outside it are merged exactly; texts then gather their words' ids. Null texts count as
empty; an empty text gives no ids; texts and words of any length are encoded whole (long words are merged with a heap);
repeated rows and ids are left as they are; an empty table gives no rows; other columns, whatever their names, are ignored."""
import functools
import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronorank.llm.shared import pieces, settled, trimmed

LEXICON, CACHE, GROUP, LONG, SHORT = 1 << 18, 3 << 17, 1 << 20, 64, 24
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
# The same pieces by the plain expressions, for texts without the characters that the two see differently.
PLAIN, ODD = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+"), re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0530-\U0010ffff]")


def byte_signs():
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in plain}
    return sign | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in sign)}


class Model:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path):
        import regex

        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        self.vocab, self.tail = t["model"]["vocab"], t["model"]["end_of_word_suffix"] or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(t["model"]["merges"])}
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.name = {i: s for s, i in (self.vocab | self.special).items()}
        self.pieces, self.sign = regex.compile(PIECES), byte_signs()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text):
        """The text's words; special tokens stand as their ids."""
        if self.split and self.split.search(text):
            parts = self.split.split(text)
            return [w for p in parts for w in ([self.special[p]] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text):
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.pieces.findall(low) if ODD.search(low) else PLAIN.findall(low)

    def merge(self, word):
        """Ids of one word: the pair of the lowest rank, the leftmost first, is merged until none is left."""
        s = [self.sign[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.tail
        if len(s) <= SHORT:
            rank, most = self.rank, len(self.rank)
            known = [rank.get(p, most) for p in zip(s, s[1:])]
            while known and (r := min(known)) < most:
                i = known.index(r)
                s[i : i + 2] = [s[i] + s[i + 1]]
                del known[i]
                if i:
                    known[i - 1] = rank.get((s[i - 1], s[i]), most)
                if i < len(known):
                    known[i] = rank.get((s[i], s[i + 1]), most)
            return [self.vocab[x] for x in s if x in self.vocab]
        n = len(s)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(s, s[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if s[i] is None or j < 0 or (s[i], s[j]) != pair:
                continue
            s[i], s[j], right[i] = s[i] + s[j], None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (p := (s[a], s[b])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], a, p))
        return [self.vocab[x] for x in s if x is not None and x in self.vocab]


def compile_lexicon(words, outputs):
    """Arrays of the minimal acyclic automaton of words (bytes) with their outputs (lists of ids)."""
    order = sorted(range(len(words)), key=lambda i: words[i])
    known, states = {}, []  # a state: (final, ((byte, state), ...))

    def close(node):
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path, before = [[False, []]], b""
    for i in [*order, None]:
        w = words[i] if i is not None else b""
        same = len(os.path.commonprefix([before, w]))
        while len(path) > same + 1:
            child = close(path.pop())
            path[-1][1].append((before[len(path) - 1], child))
        for _ in w[same:]:
            path.append([False, []])
        path[-1][0] = path[-1][0] or i is not None
        before = w
    root = close(path[0])
    below = np.zeros(len(states), np.int64)
    for k, (final, arcs) in enumerate(states):  # children come before their parents
        below[k] = final + sum(below[c] for _, c in arcs)
    first = np.cumsum([0] + [len(a) for _, a in states])
    skip = [sum(below[c] for _, c in arcs[:j]) + final for final, arcs in states for j in range(len(arcs))]
    ids = [outputs[i] for i in order]
    return {
        "first": first.astype(np.int32), "byte": np.array([b for _, a in states for b, _ in a], np.uint8), "to": np.array([c for _, a in states for _, c in a], np.int32), "skip": np.array(skip, np.int32),
        "final": np.array([f for f, _ in states], bool), "root": np.array([root], np.int32), "out_at": np.cumsum([0] + [len(x) for x in ids]).astype(np.int32), "out": np.array([y for x in ids for y in x], np.int32),
    }


class Lexicon:
    """The automaton, memory-mapped from files that are gone from the worker's folder once they are mapped."""

    def __init__(self, arrays):
        for k, a in arrays.items():
            if a.size:
                with tempfile.NamedTemporaryFile(suffix=".npy") as f:
                    np.save(f, a)
                    f.flush()
                    a = np.load(f.name, mmap_mode="r")
            setattr(self, k, a)
        arcs = np.diff(self.first)
        self.key = np.repeat(np.arange(len(arcs), dtype=np.int64) << 8, arcs) | self.byte  # ascending: by state, then byte

    def places(self, words):
        """Place of each word (bytes) in the table of outputs, -1 for words that the automaton does not hold."""
        n = np.array([len(w) for w in words], np.int64)
        out, live = np.full(len(words), -1, np.int64), np.flatnonzero((n > 0) & (n <= LONG))
        if not len(live) or not len(self.key):
            return out
        grid = np.frombuffer(b"".join([words[i].ljust(LONG, b"\0") for i in live.tolist()]), np.uint8).reshape(len(live), LONG)
        left, state, place, row = n[live], np.full(len(live), self.root[0], np.int64), np.zeros(len(live), np.int64), np.arange(len(live))
        for i in range(LONG):
            if not len(row):
                break
            want = state << 8 | grid[row, i]
            j = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[j] == want
            row, j, place, live, left = row[ok], j[ok], place[ok], live[ok], left[ok] - 1
            state, place = self.to[j].astype(np.int64), place + self.skip[j]
            done = left == 0
            held = done & self.final[state]
            out[live[held]] = place[held]
            row, state, place, live, left = row[~done], state[~done], place[~done], live[~done], left[~done]
        return out

    def find(self, words):
        """The ids of each word, None for words that the automaton does not hold."""
        at, out = self.out_at, self.out
        return [out[at[p] : at[p + 1]].tolist() if p >= 0 else None for p in self.places([w.encode("utf-8", "surrogatepass") for w in words]).tolist()]


class Coder:
    """Ids and decoded text of words, as text: through the automaton, or merged; words met before are kept."""

    def __init__(self, model, lexicon):
        self.model, self.lexicon, self.ids, self.back, self.long, self.gaps = model, lexicon, {}, {}, [], False

    def known(self, texts):
        """The words of each text, all of them learnt."""
        words = [self.model.words(t) for t in texts]
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.back.clear()
        for w in self.long:  # long words are kept for their group only
            self.ids.pop(w, None)
            self.back.pop(w, None)
        new = list(set().union(*words).difference(self.ids))
        for w, x in zip(new, self.lexicon.find([w if isinstance(w, str) else "" for w in new])):
            got = [w] if isinstance(w, int) else self.model.merge(w) if x is None else x
            self.ids[w], self.back[w] = " ".join(map(str, got)), " ".join([self.model.name[i] for i in got])
            self.gaps |= not got  # a word has no ids, if the vocabulary lacks its bytes
        self.long = [w for w in new if isinstance(w, str) and len(w) > LONG]
        return words

    def _joined(self, table, words):
        got = map(table.__getitem__, words)
        return " ".join(filter(None, got) if self.gaps else got)

    def digests(self, words):
        ids = self._joined(self.ids, words)
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(self._joined(self.back, words).encode()).hexdigest()

    def texts(self, words):
        return [int(i) for i in self._joined(self.ids, words).split()], self._joined(self.back, words)


@functools.lru_cache(maxsize=1)
def model_of(path):
    return Model(path)


def groups(texts, size=GROUP):
    """Runs of texts (null as empty) of about size characters together."""
    run, n = [], 0
    for t in texts:
        run.append(t if isinstance(t, str) else "")
        n += len(run[-1])
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def frequent(docs, path, n=LEXICON):
    """The most frequent words of all documents, n at most: those of a count (in steps of an eighth of a power of two, and of two
    at least) that no more than n words reach, so that no more than n words reach the driver."""

    def count(batches):
        m = model_of(path)

        def rows(total):
            return pieces(((b, k) for b, k in ((w.encode("utf-8", "surrogatepass"), k) for w, k in total.items() if isinstance(w, str)) if len(b) <= LONG), ["w", "n"])

        total = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                total.update(m.words(t))
                if len(total) > CACHE:
                    yield from rows(total)
                    total = Counter()
        if total:
            yield from rows(total)

    step = F.floor(F.log2("n") * 8).cast("int")
    words = docs.where("text is not null").select("text").mapInPandas(trimmed(count), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    words = settled(words.withColumn("step", step))
    held, least = 0, 1 << 30
    for s, k in sorted(((r[0], r[1]) for r in words.groupBy("step").count().collect()), reverse=True):
        held += k
        if held > n:
            break
        least = s
    return sorted(bytes(r.w).decode("utf-8", "surrogatepass") for r in words.where(F.col("step") >= least).select("w").collect())


def encode(docs, path, texts=False):
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with texts also ids and decoded."""
    m = Model(path)
    words = frequent(docs, path)
    model = docs.sparkSession.sparkContext.broadcast(compile_lexicon([w.encode("utf-8", "surrogatepass") for w in words], [m.merge(w) for w in words]))

    def run(batches):
        coder = Coder(model_of(path), Lexicon(model.value))  # goes with the task: a worker that lives on holds no words
        for pdf in batches:
            rows = [coder.digests(ws) + (coder.texts(ws) if texts else ()) for run_ in groups(pdf["text"]) for ws in coder.known(run_)]
            cols = list(zip(*rows)) if rows else [[]] * (5 if texts else 3)
            out = pdf[["doc_id"]].assign(n_tokens=list(cols[0]), ids_sha256=list(cols[1]), decoded_sha256=list(cols[2]))
            yield out.assign(ids=list(cols[3]), decoded=list(cols[4])) if texts else out

    more = ", ids array<int>, decoded string" if texts else ""
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(trimmed(run), f"doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
