"""Copies do not make a credential harmless; wide spread over different texts does."""
import hashlib

from chronorank.llm import secrets


def words(*seed):
    return " ".join(hashlib.sha256(f"{seed}{i}".encode()).hexdigest()[:7] for i in range(20))


def test_spread(spark):
    passage = f"{words('p')} token = \"livesecret01\" {words('q')}"
    whole = [(i, passage, f"s{i}") for i in range(20)]  # a document copied into 20 sources
    part = [(100 + i, f"{words('a', i)} {words('p')} password: partsecret2 {words('q')} {words('b', i)}", f"s{i}") for i in range(20)]  # a passage in 20 texts
    near = [(200 + i, f"{words('n') if i % 4 else words('n', i)} token=nearsecret3 {words('m') if i % 4 != 1 else words('m', i)}", f"s{i}") for i in range(20)]  # every fourth one changed on a side
    known = [(300 + i, f"{words('c', i)} password=changeme123 {words('d', i)}", f"s{i % 3}") for i in range(12)]  # a placeholder of three sources
    alone = [(400 + i, f"{words('e', i)} api_key=yourkeyhere {words('f', i)}", "one") for i in range(70)]  # a placeholder of one
    df = spark.createDataFrame(whole + part + near + known + alone, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan(df).collect()}
    assert len(got) == df.count() and all(v == ((1, 0) if i < 300 else (0, 1)) for i, v in got.items())
    text = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert len(text) == df.count() and not any(x in t for t in text.values() for x in ("livesecret01", "partsecret2", "nearsecret3"))
    assert all(text[i] == t for i, t, _ in known + alone)
