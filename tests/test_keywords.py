import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnweave.operators import keywords as K


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 40)


def texts(n):
    rnd = random.Random(1)
    common, odd = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(120)], "abcdefghij"
    out = []
    for i in range(n):
        words = [rnd.choice(common) if rnd.random() < 0.8 else "".join(rnd.choices(odd, k=6)) for _ in range(60)]
        out.append(" ".join(words) + (" tail-end größe x1ab the_abc https://www.a.com" if i % 3 == 0 else " the and"))
    return out + ["short", "", None, "same " * 60]


def phrases(text):
    toks = re.findall(r"\b[a-z][a-z\-]{2,}\b", text.lower())
    ok = lambda w: w not in K.STOPWORDS
    return {w for w in toks if ok(w)} | {" ".join(sorted(p)) for p in zip(toks, toks[1:]) if ok(p[0]) and ok(p[1])}


def test_document_frequency_over_slices(spark, small_slices):
    every = texts(400)
    df = Counter(p for t in every[:400] for p in phrases(t))
    least, most = int(400 * 0.05), int(400 * 0.6)
    want = {p: n for p, n in df.items() if least <= n <= most}
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(every)], "shadow_id string, text string").repartition(2)
    assert {r["phrase"]: r["df"] for r in K.document_frequency(rows, 0.05, 0.6).collect()} == want and len(want) > 100
    assert K._local_counts(rows.select("text"), 0.9 * 0.05).count() < len(df)  # rare phrases stay where they are


def test_top_keywords_match_brute_force(spark, small_slices):
    every, rng = texts(90), np.random.default_rng(2)
    named = sorted({p for t in every[:90] for p in phrases(t)})[::7]
    pv, cv = rng.normal(size=(len(named), 8)), rng.normal(size=(len(every), 8))
    rows = spark.createDataFrame([(str(i), t, i % 50) for i, t in enumerate(every)], "shadow_id string, text string, vec_id long")
    vecs = spark.createDataFrame([(i, cv[i].tolist()) for i in range(50)], "vec_id long, vec array<double>")
    got = K.top_keywords(rows, vecs, spark.createDataFrame([(p, v.tolist()) for p, v in zip(named, pv)], "phrase string, vec array<double>"), 4)
    want = set()
    for i in range(90):
        x = cv[i % 50]
        best = sorted((-round(float(x @ pv[j] / (np.linalg.norm(x) * np.linalg.norm(pv[j]) + 1e-9)), 4), p) for j, p in enumerate(named) if p in phrases(every[i]))[:4]
        want |= {(str(i), p, -s) for s, p in best}
    assert {tuple(r) for r in got.collect()} == want


def test_words_are_found_once_for_all_windows(spark):
    from tarnweave.operators import chunking

    rows = spark.createDataFrame([("D", " ".join(map(str, range(7)))), ("E", None), ("F", " a\x0bb\xa0c ")], "doc_id string, text string")
    got = chunking.token_windows(rows, "text", (4, 4, "i"), (2, 2, "j"))
    assert sorted(map(tuple, got.collect())) == [("D", 0, 0, "0 1", 2), ("D", 0, 1, "2 3", 2), ("D", 1, 0, "4 5", 2), ("D", 1, 1, "6", 1), ("F", 0, 0, "a b\xa0c", 2)]
