"""BPE against the tokenizers library."""
import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from chronorank.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(1, None), (2, ""), (3, "<|endoftext|>Σας ΟΔΟΣ İstanbul it's '’ 123\x1c\x85a b " + "ab" * 5000), (4, "  \n "), (5, "日本語 ﬁ é é 😀😀"), (5, "日本語 ﬁ é é 😀😀")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_like_the_library(spark):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 5").union(spark.createDataFrame(ROWS, "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in df.collect()}
    got = bpe.encode(df, PATH).collect()
    assert len(got) == df.count()
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_lexicon():
    words = [b"a", b"ab", b"cab", b"tab", "é".encode()]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, [[i, i + 7] for i in range(5)]))
    assert lexicon.find([w.decode() for w in words]) == [[i, i + 7] for i in range(5)]
    assert lexicon.find(["ta", "abx", "", "tab", "x" * 100]) == [None, None, None, [3, 10], None]
    assert bpe.Lexicon(bpe.compile_lexicon([], [])).find(["a", ""]) == [None, None]


def test_commonest(spark):
    """Words are counted over all documents; no more than n of them are kept, the commonest ones."""
    df = spark.createDataFrame([(i, "Ab ab, ab cd" + " ef" * (i % 2) + " only%s" % chr(97 + i)) for i in range(8)], "doc_id long, text string")
    assert bpe.frequent(df, PATH) == [",", "ab", "cd", "ef"]
    assert bpe.frequent(df, PATH, 1) == ["ab"]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, "x")], "doc_id long, text string, n_tokens long, ids int, w string")
    assert bpe.encode(df, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and bpe.encode(df, PATH).first().n_tokens == 2


def test_plain_pieces_agree():
    """The plain expressions cut like the vocabulary's, wherever ODD finds nothing."""
    m = bpe.Model(PATH)
    chars = [chr(c) for c in range(1, 0x530) if not bpe.ODD.search(chr(c))]
    text = "".join(f"{c}a{c}{c}1 {c}'s'{c}_" for c in chars)
    assert len(chars) > 1200 and bpe.PLAIN.findall(text) == m.pieces.findall(text)


def test_short_and_long_merges():
    m = bpe.Model(PATH)
    t = Tokenizer.from_file(PATH)
    for w in ("a", "unbelievable", "ab" * 12, "ab" * 13, "thethe" * 40, "éèê" * 9, "1", "…!?", "zzzzzzzzzzzzzzzzzzzzzzzz"):
        assert m.merge(w) == t.encode(w, add_special_tokens=False).ids
