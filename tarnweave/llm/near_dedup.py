"""MinHash near-dedup with odd sketches.

A document's set is its distinct shingles of ``SHINGLE`` words. MinHash samples are cut into bands; documents that share
a band's bucket are candidates. The same samples are folded into an odd sketch, a bitmap of parities whose XOR
population count estimates high similarities well; only pairs that it doesn't rule out are compared on full sets.

No bucket emits its pairs. Each member is a candidate of the pivots of its buckets and is compared with the nearest of
them, by sketches. A second round finds, within blocks and by sketches, which members of buckets that still hold several
components belong to one class of candidates; each class then compares its full sets in place and passes over what its
links have joined already. What travels grows with the sets, not with the pairs. Equal sets are one node throughout.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; with fewer words than a
shingle the whole sequence is the one shingle; rows that repeat an id count as one document, linked as any of its texts;
rows with a null id take their class's component and never link classes; ids are compared as numbers; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.bpe import sliced
from tarnweave.llm.components import components
from tarnweave.llm.screen import build_filters, screen
from tarnweave.llm.skew import join_groups
from tarnweave.llm.worker import held, release
from tarnweave.storage import arrow_rows, discard, materialise

SHINGLE = 5
#: Bands and samples in each: a pair at similarity 0.7 shares no bucket with probability (1 - 0.7^5)^64, under 1e-5.
BANDS, ROWS = 64, 5
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch, and how far (in similarity) under the threshold its estimate may be: over four deviations.
BITS, SLACK = 1024, 0.16
#: Members of a block of a bucket in the second round, and of small buckets that are dealt with together.
BLOCK, TOGETHER = 2048, 8192
#: Bytes of sets that one task compares with pivots, bytes of a class that is compared in one, and most places of sets
#: that are broadcast (under 20 MB; more are shuffled).
TASK_BYTES, CLASS_BYTES, SENT_ROWS = 4 << 20, 12 << 20, 100_000
#: Bytes of a slice of texts, and words whose hashes a worker remembers.
SLICE_CHARS, REMEMBERED = 1 << 20, 100_000
#: Rows of whole texts that go to Python at a time.
TEXT_ROWS = 1000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 31, SAMPLES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.int64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 62, SHINGLE, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SALT = _rng.integers(0, 1 << 62, SAMPLES, dtype=np.int64).astype(_U)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; ASCII letters in lower case, words between white space."""
    words = held("near_dedup words", _Words)
    if len(words) > REMEMBERED:
        words.clear()
    # bytes.lower() touches A-Z alone, bytes.split() splits at 0x20 and 0x09-0x0D
    rows = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    get = words.__getitem__
    flat = np.fromiter((h for r in rows for h in map(get, r)), _U, int(sizes.sum()))
    ends = np.cumsum(sizes)
    joint = np.zeros(0, _U)
    if len(flat) >= SHINGLE:
        n = len(flat) - SHINGLE + 1
        joint = flat[:n] * _ODD[0]
        for k in range(1, SHINGLE):
            joint = _mix(joint) + flat[k : n + k] * _ODD[k]
        joint = _mix(joint)
    out = []
    for size, end in zip(sizes.tolist(), ends.tolist()):
        if size >= SHINGLE:
            out.append(np.unique(joint[end - size : end - SHINGLE + 1]))
        elif size:
            h = np.array([size], _U)
            for k in range(end - size, end):
                h = _mix(h) + flat[k : k + 1] * _ODD[0]
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, _U))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    h = (shingles >> _U(32)).astype(np.uint32)
    for a in range(0, len(h), 1024):
        part = np.multiply.outer(_MUL, h[a : a + 1024])
        part += _ADD[:, None]
        # the high bits alone are well mixed; they are compared first
        np.minimum(low, part.min(axis=1), out=low)
    return low


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of each row of samples."""
    s = samples.reshape(-1, BANDS, ROWS).astype(_U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), s.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + s[:, :, k])
    return h.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each (position, sample) flips one of BITS bits; rows of BITS / 64 words."""
    s = samples.reshape(-1, SAMPLES).astype(_U)
    at = (_mix(s + _SALT) >> _U(40)).astype(np.int64) % BITS
    bits = np.zeros((len(s), BITS), np.int64)
    np.add.at(bits, (np.repeat(np.arange(len(s)), SAMPLES), at.ravel()), 1)
    return np.packbits((bits & 1).astype(np.uint8), axis=1).view(np.int64).reshape(len(s), BITS // 64)


def most_flips(threshold: float) -> int:
    """The largest XOR population count at which a pair isn't ruled out."""
    j = max(0.0, threshold - SLACK)
    return int(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - j) / BITS)))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, texts in sliced(batch.column(1), SLICE_CHARS):
                sets = shingle_sets(texts)
                samples = np.stack([minhash(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary()),
                        pa.array(list(bands(samples)), pa.list_(pa.int64())),
                        pa.array(list(odd_sketches(samples)), pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "digest", "bands", "sketch"],
                )
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>, sketch array<long>")


def _flips(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(BITS // 64):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _merge(label: np.ndarray, members: np.ndarray) -> None:
    """Give all of ``members``' groups the least of their labels."""
    groups = np.unique(label[members])
    if len(groups) > 1:
        label[np.isin(label, groups[1:])] = groups[0]


def _cuts(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with equal keys, which stand together."""
    change = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    at = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys[0])]
    return list(zip(at, at[1:]))


def _words(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.int64).view(_U)  # NumPy counts the bits of absolute values


def _sides(own: np.ndarray, a: int, b: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(a, b)
    return (at[own[a:b] == i], at[own[a:b] == j]) if i != j else (at, at)


def _grouped(pdf: pd.DataFrame, percent: int, flips: int) -> pd.DataFrame:
    """Which members of two blocks of a bucket belong to one class of candidates: links (a, b) that span the classes.

    A candidate pair is of different components and neither sizes nor sketches rule it out. Small buckets come many to a call.
    """
    release()
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values(["bucket", "node"], kind="stable")
    bucket, node, comp, own, n = (pdf[c].to_numpy(np.int64) for c in ("bucket", "node", "comp", "own", "n"))
    sketch = _words(pdf["sketch"])
    root = np.arange(len(node))
    for a, b in _cuts(bucket):
        left, right = _sides(own, a, b, i, j)
        part = root[a:b]
        for x in left.tolist():
            ok = right[(comp[right] != comp[x]) & (root[right] != root[x]) & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)]
            if len(ok):
                ok = ok[np.bitwise_count(sketch[ok] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= flips]
                if len(ok):
                    _merge(part, np.append(ok, x) - a)
    moved = root != np.arange(len(node))
    return pd.DataFrame({"a": node[moved], "b": node[root[moved]]}).drop_duplicates()


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _U)


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``others`` has in common with ``x``; all are sorted and none is empty."""
    flat = np.concatenate(others)
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((x[at] == flat).astype(np.int64), starts)


def _linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` meet the threshold with ``x``, on full sets."""
    shared = _shared(x, others)
    return 100 * shared >= percent * (len(x) + np.array([len(y) for y in others]) - shared)


def _with_pivot(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (pivot, member) among the sets that stand with their pivots."""
    release()
    pdf = pdf.drop_duplicates(["pivot", "node"]).sort_values("pivot", kind="stable")
    pivot, node = pdf["pivot"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    sets, out = pdf["members"].tolist(), []
    for a, b in _cuts(pivot):
        first = [k for k in range(a, b) if node[k] == pivot[k]]
        rest = [k for k in range(a, b) if node[k] != pivot[k]]
        for c in range(0, len(rest) if first else 0, 64):
            part = rest[c : c + 64]
            ok = _linked(_set(sets[first[0]]), [_set(sets[k]) for k in part], percent)
            out += [(pivot[k], node[k]) for k, y in zip(part, ok.tolist()) if y]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _within(pdf: pd.DataFrame, percent: int, flips: int) -> pd.DataFrame:
    """Links that join components within classes of candidates (or two blocks of one), on full sets.

    Pairs that a link found before has put into one component already aren't compared.
    """
    release()
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.drop_duplicates(["class", "node"]).sort_values(["class", "node"], kind="stable")
    kind, node, comp, own, n = (pdf[c].to_numpy(np.int64) for c in ("class", "node", "comp", "own", "n"))
    sketch, sets, out = _words(pdf["sketch"]), pdf["members"].tolist(), []
    for a, b in _cuts(kind):
        left, right = _sides(own, a, b, i, j)
        part = comp[a:b].copy()
        for x in left.tolist():
            ok = right[(part[right - a] != part[x - a]) & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)]
            if i == j:
                ok = ok[node[ok] > node[x]]
            if not len(ok):
                continue
            apart = np.bitwise_count(sketch[ok] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            ok, apart = ok[apart <= flips], apart[apart <= flips]
            ok = ok[np.argsort(apart, kind="stable")]
            while len(ok):
                now, ok = ok[:64], ok[64:]
                hit = now[_linked(_set(sets[x]), [_set(sets[k]) for k in now.tolist()], percent)]
                if len(hit):
                    out += [(node[x], node[k]) for k in hit.tolist()]
                    _merge(part, np.append(hit, x) - a)
                    ok = ok[part[ok - a] != part[x - a]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, members) of ``nodes`` (node, rep). Texts aren't shuffled: a filter picks the rows; repeated rows repeat."""
    wanted = materialise(nodes.select("node", F.xxhash64("rep").alias("key")), "wanted")
    filters, n_seg = build_filters(wanted, "key", wanted.count())
    rows = screen(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("key")), "key", filters, n_seg).where("maybe").select("id", "text")

    def sets(batches):
        for batch in batches:
            for _, _, texts in sliced(batch.column(1), SLICE_CHARS):
                found = [s.tobytes() for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(s).digest() for s in found], pa.binary()), pa.array(found, pa.binary())], names=["digest", "members"])
        release()

    return rows.mapInArrow(sets, "digest binary, members binary").select(F.xxhash64("digest").alias("node"), "members")


def _placed_with(sets: DataFrame, places: DataFrame) -> DataFrame:
    """Sets at their places; the places are broadcast where they are few enough to be, by their number."""
    return sets.join(F.broadcast(places) if places.count() <= SENT_ROWS else places, "node")


def _confirm_pivots(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The links among ``pairs`` (a: pivot, b: member, na, nb: sizes): each set travels once for each pivot it stands with."""
    load = pairs.groupBy("a").agg((8 * (F.sum("nb") + F.first("na"))).alias("bytes"), F.count(F.lit(1)).alias("held"))
    load = materialise(load.withColumn("salts", F.ceil(F.col("bytes") / TASK_BYTES).cast("int")), "loads")
    tasks = max(1, -(-(load.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    # a pivot with very many words of members is split over salts
    hot, rest = join_groups(pairs.select("a", "b"), load, ["a"], "held", pairs.count())
    members = hot.unionByName(rest).withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    members = members.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "salt")
    pivots = load.select(F.col("a").alias("node"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    places = materialise(members.unionByName(pivots).withColumn("task", F.pmod(F.xxhash64("pivot", "salt"), F.lit(tasks))).drop("salt"), "places")
    wanted = places.select("node").distinct().join(nodes.select("node", "rep"), "node")
    both = _placed_with(_sets(docs, wanted, id_col, text_col), places)
    return both.groupBy("task").applyInPandas(lambda pdf: _with_pivot(pdf, percent), "a long, b long")


def _confirm_classes(docs: DataFrame, members: DataFrame, nodes: DataFrame, id_col: str, text_col: str, percent: int, flips: int) -> DataFrame:
    """Links that join components within classes; ``members`` (node, class, comp, n, sketch), in blocks of bounded bytes."""
    shape = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"), (8 * F.sum("n")).alias("bytes"))
    shape = materialise(shape.withColumn("k", F.ceil(F.greatest(F.col("size") / BLOCK, 2 * F.col("bytes") / CLASS_BYTES)).cast("int")), "shapes")
    tasks = max(1, -(-(shape.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    hot, rest = join_groups(members, shape, ["class"], "size", members.count())
    placed = _tiled(hot.unionByName(rest), "class", F.lit(tasks))
    places = materialise(placed.select("task", "class", "node", "comp", "n", "sketch", "own", "i", "j"), "places")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    both = _placed_with(_sets(docs, wanted, id_col, text_col), places)
    return both.groupBy("task", "i", "j").applyInPandas(lambda pdf: _within(pdf, percent, flips), "a long, b long")


def _tiled(rows: DataFrame, group: str, tasks: Column) -> DataFrame:
    """Deal the ``k`` blocks of each group to pairs of blocks (i, j); groups of one block share tasks."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("task", F.when(F.col("k") == 1, F.pmod(F.xxhash64(group), tasks)).otherwise(F.col(group)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 70) -> DataFrame:
    """Every row's (id, n_shingles, component_id); links are 100 * intersection >= percent * union of full sets."""
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        signed = materialise(_signed(docs, id_col, text_col), "signed")
    rows = materialise(signed.select("id", "n", "digest"), "rows")
    n_rows = rows.count()
    classes = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"))
    classes = materialise(classes.withColumn("node", F.xxhash64("digest")), "classes")
    nodes = classes.where("n > 0 and rep is not null").select("node", "rep", "n")
    flips = most_flips(percent / 100)

    # one row for each set; a filter of the repeated sets spares all other rows a shuffle
    repeated = classes.where("size > 1").select("digest", "node", "rep", "size")
    filters, n_seg = build_filters(repeated, "node", repeated.count())
    whole = screen(signed.where("n > 0 and id is not null").withColumn("node", F.xxhash64("digest")), "node", filters, n_seg)
    hot, rest = join_groups(whole.where("maybe"), repeated, ["digest", "node"], "size", n_rows)
    doubtful = hot.unionByName(rest).where("rep is null or id = rep")
    one = whole.where("not maybe").select("node", "n", "bands", "sketch").unionByName(doubtful.select("node", "n", "bands", "sketch"))
    one = materialise(one, "one")
    discard(signed)
    # candidates: every member of a bucket with the bucket's pivot
    members = one.select("node", F.explode("bands").alias("bucket"))
    # only the counts of all buckets are shuffled: a filter of those that several hold picks their members
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    full = materialise(full, "full")
    filters, n_seg = build_filters(full, "bucket", full.count())
    members = materialise(screen(members, "bucket", filters, n_seg).where("maybe").select("bucket", "node"), "members")
    buckets = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("far"), F.count(F.lit(1)).alias("size"))
    buckets = materialise(buckets.where("pivot <> far"), "buckets")
    many = buckets.where("size > 2")
    hot, rest = join_groups(members, many, ["bucket"], "size", n_rows)
    held = materialise(hot.unionByName(rest.where("pivot is not null")).select("bucket", "node", "pivot"), "held")
    stars = held.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    twos = buckets.where("size = 2")
    pairs = stars.unionByName(twos.select(F.col("pivot").alias("a"), F.col("far").alias("b"))).distinct()
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sketches = materialise(one.select("node", "n", "sketch").join(ends, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    discard(one)
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    pairs = pairs.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    pairs = pairs.withColumn("flips", _flips("sa", "sb")).where(_near_sizes("na", "nb", percent) & (F.col("flips") <= flips))
    # first each member with its nearest pivot alone: what that links needs no other comparison
    best = pairs.groupBy("b").agg(F.min_by(F.struct("a", "na", "nb"), F.struct("flips", "a")).alias("p")).select("p.a", "b", "p.na", "p.nb")
    best = materialise(best, "best")
    confirmed = _confirm_pivots(docs, best, nodes, id_col, text_col, percent)
    with arrow_rows(spark, TEXT_ROWS):
        links = materialise(confirmed, "confirmed")

    # buckets that still hold several components: classes of candidates across components, in blocks, then their sets
    comp = materialise(components(links), "first")
    held = held.select("bucket", "node").unionByName(twos.select("bucket", F.explode(F.array("pivot", "far")).alias("node")))
    placed = held.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("bucket", "size")
    mixed = materialise(mixed, "mixed")
    if mixed.limit(1).count():
        hot, rest = join_groups(placed, mixed, ["bucket"], "size", n_rows)
        open_ = hot.unionByName(rest.where("size is not null")).join(sketches, "node")
        few = F.lit(max(1, mixed.agg(F.sum("size")).first()[0] // TOGETHER))
        open_ = _tiled(open_.withColumn("k", F.ceil(F.col("size") / BLOCK).cast("int")), "bucket", few)
        open_ = open_.select("task", "bucket", "node", "comp", "n", "sketch", "own", "i", "j")
        spans = materialise(open_.groupBy("task", "i", "j").applyInPandas(lambda pdf: _grouped(pdf, percent, flips), "a long, b long").distinct(), "spans")
        if spans.limit(1).count():
            classed = components(spans).withColumnRenamed("component", "class").join(comp, "node", "left")
            classed = classed.select("node", "class", F.coalesce("component", "node").alias("comp")).join(sketches, "node")
            late = _confirm_classes(docs, materialise(classed, "classed"), nodes, id_col, text_col, percent, flips)
            with arrow_rows(spark, TEXT_ROWS):
                links = links.unionByName(materialise(late, "late"))

    # links between nodes become links between ids, whose components carry the smallest id
    named = links.join(nodes.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b")
    comp = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    settled = classes.where("n > 0").join(comp.withColumnRenamed("node", "rep"), "rep", "left").where("size > 1 or component is not null")
    settled = settled.select("digest", "size", F.coalesce("component", "rep").alias("component"))
    hot, rest = join_groups(rows.select("id", "n", "digest"), materialise(settled, "settled"), ["digest"], "size", n_rows)
    return hot.unionByName(rest).select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
