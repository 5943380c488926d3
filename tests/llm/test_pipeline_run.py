"""The whole pipeline on made documents, against plain Python for every stage."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from test_jaccard import brute as components
from test_mixing import water
from tokenizers import Tokenizer

import corpus_pipeline as cp

PATTERN = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|(?<![0-9a-f])[0-9a-f]{32,}"


def made():
    r, rows = random.Random(8), []
    words = [f"{a}{b}" for a in ("mo", "ta", "ri", "lu", "ke", "so") for b in ("ba", "ne", "di", "go", "pu", "vy")]
    for i in range(90):
        text = " ".join(r.choice(words) for _ in range(r.randrange(20, 120)))
        if i % 10 == 0:
            text += " you are an idiot, such a pathetic loser and moron"
        if i % 9 == 4:
            text += f' token = "live{i:02d}secretvalue" and more'
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    for i in range(90, 110):  # near and exact copies
        base = rows[(i - 90) * 3 + 1][1].split()
        if i % 2:
            base[-1] = "changed"
        rows.append((i, " ".join(base), "en", f"s{i % 4}", len(" ".join(base))))
    return rows + [(200, None, None, None, None), (201, "", "en", "s1", 0)]


def test_run(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(90)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    kept = [x for x in rows if not (x[0] < 90 and x[0] % 10 == 0) and "idiot" not in (x[1] or "")]
    comp = components([(x[0], x[1]) for x in kept])
    kept = [x for x in kept if comp[x[0]][1] == x[0]]
    kept = [(i, t and re.sub(PATTERN, "[SECRET]", t), s) for i, t, _, s, _ in kept]
    library = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    want = {}
    for i, t, _ in kept:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert all(want[r.doc_id] == (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    size = {i: len((t or "").split()) for i, t, _ in kept}
    by, reps = defaultdict(list), Counter(r.doc_id for r in got)
    for i, _, s in kept:
        by[s].append(i)
    target = water({s: sum(size[i] for i in x) for s, x in by.items()})
    for s, x in by.items():
        assert abs(sum(reps[i] * size[i] for i in x) - target[s]) <= max(size[i] for i in x) / 2 + 1 and all(reps[i] <= 3 for i in x if size[i])
