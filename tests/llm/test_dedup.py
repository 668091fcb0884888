import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import near_dedup as N
from tarnweave.llm.binary_fuse import BinaryFuse
from tarnweave.llm.components import components
from tarnweave.llm.exact_dedup import drop_copies, exact_dedup
from tarnweave.llm.near_dedup import near_dedup
from tarnweave.llm.screen import build_filters, screen, without
from tarnweave.llm.vector_dedup import vector_dedup

SCHEMA = "doc_id long, text string, id string, digest string, size string, n string, key string, bucket string"


def table(spark, pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in pairs], SCHEMA)


LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(60_000))
CASES = [(5, "a  b"), (3, "a\tb"), (3, "a\tb"), (9, None), (8, ""), (7, " "), (1, " a b"), (None, "a b"), (None, "zz"), (4, LONG), (2, LONG + "\n"), (6, LONG.replace(" ", "\r\n"))]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("keys", [0, 1, 2, 50, 3000])
def test_binary_fuse(keys):
    k = np.random.default_rng(keys).integers(-(2**63), 2**63 - 1, keys)
    f = BinaryFuse.build(np.concatenate([k, k]))
    assert f.contains(k).all()
    assert f.contains(np.random.default_rng(77).integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.02


def test_exact_dedup_matches_brute_force(spark):
    groups = defaultdict(list)
    for i, t in CASES:
        groups[norm(t)].append(i)
    got = exact_dedup(table(spark, CASES)).collect()
    assert len(got) == len(CASES)
    for r in got:
        (text,) = [t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r.digest)]
        known = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text]) and r.keep_id == (min(known) if known else None)
    kept = [r.id for r in got if r.kept]
    assert len(kept) == len(groups) and kept.count(3) == 1  # of a repeated row one stays
    assert exact_dedup(table(spark, [])).count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "x\ty"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    assert sorted((r.id or "", r.keep_id, r.group_size, r.kept) for r in exact_dedup(named).collect()) == [("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False), ("c", "c", 1, True)]


def test_drop_copies_keeps_columns(spark):
    docs = table(spark, CASES)
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, norm(r.text)[:5]) for r in out.collect()) == sorted([(False, 3, "a b"), (False, 1, " a b"), (False, 8, ""), (False, 7, " "), (True, 0, "zz"), (False, 2, LONG[:5]), (False, 4, LONG[:5])])


def test_routed_screen_agrees(spark, monkeypatch):
    import tarnweave.llm.screen as S

    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    filters, n = build_filters(keys, "k", 1000)
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("k")).unionByName(spark.sql("select -1L as id, cast(null as bigint) as k"))
    near = {r.id: r.maybe for r in screen(rows, "k", filters, n).collect()}
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    far = {r.id: r.maybe for r in screen(rows, "k", filters, n).collect()}
    assert near == far and all(near[i] for i in range(1000)) and not near[-1] and sum(near.values()) < 1100


def test_without(spark):
    docs = table(spark, [(1, "a"), (2, "b"), (None, "c"), (2, "d")])
    left = without(docs, spark.createDataFrame([(2,), (None,)], "id long"), "doc_id")
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["a", "c"]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4900, 4999)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(pairs, percent=70):
    sets = {}
    for k, (i, t) in enumerate(pairs):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k in sets:
        least[find(k)].append(pairs[k][0])
    return [(pairs[k][0], len(sets[k]), min(least[find(k)])) for k in sets]


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup_matches_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    pairs, i = [], 100
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(6, 200)))]
        for _ in range(int(rng.integers(1, 12))):
            now = list(base)
            for _ in range(int(rng.integers(0, max(1, len(now) // 12) + 1))):
                now[int(rng.integers(len(now)))] = word()
            pairs.append((i, " ".join(now)))
            i += 1
    pairs += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "É x y z w"), (8, "é x y z w"), (9, LONG), (10, LONG + " tail")]
    order = rng.permutation(len(pairs))
    pairs = [pairs[k] for k in order]
    # families below the threshold but within the sketches' slack, beside links: what only the second round finds
    for _ in range(4):
        base = [word() for _ in range(60)]
        for k in range(14):
            now = list(base)
            for at in range(k % 7, 60, 11 - k % 3 * 3):
                now[at] = word()
            pairs.append((i, " ".join(now)))
            i += 1
    if small:
        monkeypatch.setattr(N, "BLOCK", 3)  # second rounds in several blocks, pivots in several tasks
        monkeypatch.setattr(N, "TOGETHER", 4)
        monkeypatch.setattr(N, "TASK_BYTES", 2000)
        monkeypatch.setattr(N, "SENT_ROWS", -1)
    pairs = [pairs[k] for k in rng.permutation(len(pairs))]
    got = sorted((r.id, r.n_shingles, r.component_id) for r in near_dedup(table(spark, pairs)).collect())
    assert got == sorted(brute_near(pairs))


def test_near_dedup_edges(spark):
    pairs = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q q q q q q"), (7, "A B C D E F g")]
    got = sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup(table(spark, pairs)).collect())
    assert got == [(False, 2, 2, 2), (False, 2, 2, 2), (False, 7, 3, 7), (True, 0, 1, 0), (True, 0, 2, 2)]
    assert near_dedup(table(spark, [])).count() == 0


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = a.copy()
    b[:100] = rng.integers(0, 2**63, 100).astype(np.uint64)
    s = N.odd_sketches(np.stack([N.minhash(np.unique(a)), N.minhash(np.unique(b))]))
    flips = int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum())
    estimate = 1 + N.BITS / (4 * N.SAMPLES) * np.log(1 - 2 * flips / N.BITS)
    assert abs(estimate - 900 / 1100) < 0.08 and flips <= N.most_flips(0.7)


def test_vector_dedup_matches_brute_force(spark, monkeypatch):
    import tarnweave.llm.vector_dedup as D

    monkeypatch.setattr(D, "CELL", 20)
    monkeypatch.setattr(D, "OWN_BLOCK", 7)
    monkeypatch.setattr(D, "ALL_BLOCK", 11)
    monkeypatch.setattr(D, "ASSIGNED", 30)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 6))
    rows = [(k, (base[k % 25] + rng.normal(size=6) * 0.15 * (k % 3)).tolist(), k % 2) for k in range(150)]
    rows += [(200, [0.0] * 6, 0), (201, None, 0), (202, [float("nan")] * 6, 0), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (204, rows[0][1], None), (205, [x * 1e200 for x in rows[0][1]], 0), (206, [], 1), (207, [float("inf")] * 6, 1), (208, [1.0], 1), (209, rows[1][1], 1)]
    df = spark.createDataFrame([(i, v, g, "x", "x") for i, v, g in rows], "vec_id long, embedding array<double>, label int, id string, size string")
    good = {i: (np.array(v) / np.abs(v).max() if i == 205 else np.array(v), g) for i, v, g in rows if i < 200 or i in (205, 208, 209)}
    near = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] / np.linalg.norm(a[0]) / np.linalg.norm(b[0]) >= 0.93 - 1e-12
    links = {i: {j for j in good if j != i and near(good[i], good[j])} for i in good}
    want = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want[i] = (len(links.get(i, ())), min(seen))
    got = {r.id: (r.n_links, r.component_id) for r in vector_dedup(df).collect()}
    assert got == want
    assert vector_dedup(df.limit(0)).count() == 0
    # rows that repeat an id count their own links and share the component of any
    twice = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (1, [0.0, 0.0, 1.0], 5), (4, [0.0, 1.0, 0.01], 0), (0, [0.0, 1.0, 0.02], 0)]
    got = sorted((r.id, r.n_links, r.component_id) for r in vector_dedup(spark.createDataFrame(twice, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(0, 2, 0), (1, 0, 0), (1, 2, 0), (1, 2, 0), (2, 2, 0), (3, 2, 0), (4, 2, 0)]


def test_cells_shrink_on_clustered_vectors():
    """Away from the borders a vector visits its own cell alone."""
    from tarnweave.llm.vector_dedup import _assign

    rng = np.random.default_rng(6)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = centres[np.arange(4000) % 16] + rng.normal(size=(4000, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = pd.DataFrame({"node": np.arange(4000), "vec": [v.tobytes() for v in x]})
    out = _assign(np.sqrt(2 - 2 * 0.93))(rows, rows.iloc[:16])
    assert sum(map(len, out["cells"])) < 1.5 * len(x)
