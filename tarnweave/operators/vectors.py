"""Vector operators: cosine, blocked all-pairs join, top-k for a batch of questions, nearest neighbour."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tarnweave.storage import materialise

EPS = 1e-9
#: Vectors of a block of the all-pairs join.
BLOCK = 2000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V1, in double precision."""
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)) + EPS)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.to_list(), np.float64)


def arrow_matrix(col: pa.Array) -> np.ndarray:
    """Vectors of a column without nulls, in double precision."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def similar_to(wanted: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The links of ``similarity_edges`` that some vectors have: (id, other, score), ``other`` being any but itself.

    ``wanted``: (id, vec), a batch the caller bounds, collected once and met with all ``vectors``.
    """
    batch = wanted.where("vec is not null").select("id", "vec").collect()
    kind = vectors.schema["id"].dataType.simpleString()
    ids = np.array([r["id"] for r in batch])
    m = _unit(np.array([r["vec"] for r in batch], np.float64)) if batch else None

    def join(batches):
        for rb in batches:
            rb = rb.filter(rb.column("vec").is_valid())
            if m is None or not rb.num_rows:
                continue
            own = rb.column("id").to_numpy(zero_copy_only=False)
            s = m @ _unit(arrow_matrix(rb.column("vec"))).T
            a, b = np.nonzero(s >= threshold)
            x, y, score = ids[a], own[b], np.round(s[a, b], 4)
            kept = x != y
            yield pa.RecordBatch.from_arrays([pa.array(c[kept], f.type) for c, f in zip((x, y, score), schema)], schema=schema)

    schema = to_arrow_schema(StructType([StructField("id", vectors.schema["id"].dataType), StructField("other", vectors.schema["id"].dataType), StructField("score", DoubleType())]))
    return vectors.select("id", "vec").mapInArrow(join, f"id {kind}, other {kind}, score double")


def similarity_edges(vectors: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """G1 over (id, vec): all pairs id_a < id_b with cosine >= threshold (tested before rounding), scores at 4 places.

    Blocks meet in pairs, each an independent task of bounded size; no table is broadcast.
    """
    n = vectors.count() if n is None else n
    blocks = max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = vectors.where("vec is not null").select("id", "vec", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "vec", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = vectors.schema["id"].dataType.simpleString()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        names = ["id_a", "id_b", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        s = _unit(_matrix(left["vec"])) @ _unit(_matrix(right["vec"])).T
        a, b = np.nonzero(s >= threshold)
        x, y, score = left["id"].to_numpy()[a], right["id"].to_numpy()[b], s[a, b]
        keep = x < y if i == j else x != y
        x, y, score = x[keep], y[keep], score[keep]
        return pd.DataFrame({"id_a": np.where(x < y, x, y), "id_b": np.where(x < y, y, x), "score": np.round(score, 4)})

    return rows.groupBy("i", "j").applyInPandas(join, f"id_a {kind}, id_b {kind}, score double")


def vector_top_k(questions: DataFrame, chunks: DataFrame, k: int, prefilter: bool = True, routes: list[tuple] | None = None) -> DataFrame:
    """V2/V3 for a batch: (qid, shadow_id, score) of each question's ``k`` best chunks by (1 + cosine) / 2.

    ``questions``: (qid, qvec, tickers, years, form_type), a batch the caller bounds, collected once. ``chunks``:
    (shadow_id, vec, ticker, form_type, period). Filters apply before ranking; ``prefilter=False`` ranks all chunks.
    Scores are rounded to 6 places before ranking, ties go by id. Each Arrow batch keeps its own best only. With
    ``routes``, pairs (qid, cluster), a question's ``k`` best chunks of each of its clusters are found; chunks have a
    ``cluster_id`` then.
    """
    batch = questions.select("qid", "qvec", "tickers", "years", "form_type").collect()
    qm = _unit(np.array([r["qvec"] for r in batch], np.float64)) if batch else np.zeros((0, 1))
    kind = questions.schema["qid"].dataType.simpleString()
    filters = [(set(r["tickers"] or ()), list(r["years"] or ()), r["form_type"]) for r in batch]
    qids = [r["qid"] for r in batch]
    groups: dict = {}
    for qid, cluster in routes or ():
        groups.setdefault(qid, []).append(cluster)

    def best(batches):
        for rb in batches:
            rb = rb.filter(rb.column("vec").is_valid())
            if not rb.num_rows or not qids:
                continue
            score = np.round((1 + qm @ _unit(arrow_matrix(rb.column("vec"))).T) / 2, 6)
            label = rb.column("cluster_id").to_pandas().to_numpy() if routes is not None else None
            held = {c: rb.column(c).to_pandas() for c in ("ticker", "form_type", "period")} if prefilter else {}
            out = []
            for q, (tickers, years, form) in enumerate(filters):
                ok = np.ones(rb.num_rows, bool)
                if prefilter:
                    if tickers:
                        ok &= held["ticker"].isin(tickers).to_numpy()
                    if years:
                        ok &= np.any([held["period"].fillna("").str.contains(y, regex=False).to_numpy() for y in years], axis=0)
                    if form:
                        ok &= (held["form_type"] == form).to_numpy()
                for g in [None] if routes is None else groups.get(qids[q], []):
                    at = np.flatnonzero(ok if g is None else ok & (label == g))
                    if len(at) > k:  # with all that tie with the last
                        at = at[score[q][at] >= np.partition(score[q][at], len(at) - k)[len(at) - k]]
                    ids = rb.column("shadow_id").take(pa.array(at)).to_pylist()
                    at = sorted(zip((-score[q][at]).tolist(), ids))[:k]
                    out += [(qids[q], g, i, -x) for x, i in at]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("qid", kinds[kind]), ("grp", pa.int64()), ("shadow_id", pa.string()), ("score", pa.float64())])
    columns = ["shadow_id", "vec", "ticker", "form_type", "period", *(["cluster_id"] if routes is not None else [])]
    found = chunks.select(*columns).mapInArrow(best, f"qid {kind}, grp bigint, shadow_id string, score double")
    rank = F.row_number().over(Window.partitionBy("qid", "grp").orderBy(F.desc("score"), "shadow_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank", "grp")


#: Old vectors that are sent to all tasks at a time, and how much of their products with new ones is held at a time.
OLD_BLOCK, TILE_ROWS, TILE = 100_000, 512, 8192
#: Single precision may be off by this much; what comes as close to a row's best is computed in double precision.
_CLOSE = 1e-5


def _closest(new: np.ndarray, old: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each new unit vector's best place in ``old``, whose ``ids`` rise, and its score at 6 places; -inf without any.

    ``own``: the new ones' ids, which they don't match themselves.
    """
    at, score = np.zeros(len(new), np.int64), np.full(len(new), -np.inf)
    n32, best = new.astype(np.float32), np.full(len(new), -np.inf, np.float32)
    blank = ~new.any(axis=1)  # as near to all: the first two will do, as one may be itself
    for lo in range(0, len(old), TILE):
        tile = old[lo : lo + TILE]
        s = n32 @ tile.astype(np.float32).T
        if own is not None:
            i = np.minimum(np.searchsorted(ids[lo : lo + TILE], own), len(tile) - 1)
            same = ids[lo : lo + TILE][i] == own
            s[np.flatnonzero(same), i[same]] = -np.inf
        s[blank, 2:] = -np.inf
        best = np.maximum(best, s.max(axis=1))
        row, col = np.nonzero(s >= np.maximum(best - np.float32(_CLOSE), np.float32(-2))[:, None])
        exact = np.round(np.einsum("ij,ij->i", new[row], tile[col]), 6)
        order = np.lexsort((col, -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), row[1:] != row[:-1]]))
        row, col, exact = row[first], col[first], exact[first]
        more = exact > score[row]
        at[row[more]], score[row[more]] = col[more] + lo, exact[more]
    return at, score


def nearest_cluster(new: DataFrame, old: DataFrame, apart: bool = False) -> DataFrame:
    """(id, cluster_id, score) of the nearest old vector for each new (id, vec); first id on ties, null without any.

    With ``apart`` a vector isn't its own neighbour where ids are shared.

    All pairs are met, in tiles of bounded size: old vectors, (id, vec, cluster_id), go to all tasks a block of
    ``OLD_BLOCK`` at a time, new ones are read in Arrow batches and stay where they are.
    """
    spark = new.sparkSession
    new = materialise(new.select("id", "vec"), "new")
    old = materialise(old.where("vec is not null").select("id", "vec", "cluster_id"), "old")
    blocks = max(1, -(-old.count() // OLD_BLOCK))
    kinds = StructType([new.schema["id"], StructField("old", old.schema["id"].dataType), old.schema["cluster_id"], StructField("score", DoubleType())])
    schema = to_arrow_schema(kinds)

    def against(block: DataFrame) -> DataFrame:
        held = block.orderBy("id").toArrow().combine_chunks()
        if not held.num_rows:
            return spark.createDataFrame([], kinds)
        names, labels = held.column("id").combine_chunks(), held.column("cluster_id").combine_chunks()
        sent = spark.sparkContext.broadcast((names, labels, held.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)))

        def best(batches):
            names, labels, m = sent.value
            m, ids = _unit(m.astype(np.float64)), names.to_numpy(zero_copy_only=False)
            for rb in batches:
                rb = rb.filter(rb.column("vec").is_valid())
                for i in range(0, rb.num_rows, TILE_ROWS):
                    part = rb.slice(i, TILE_ROWS)
                    at, score = _closest(_unit(arrow_matrix(part.column("vec"))), m, ids, part.column("id").to_numpy(zero_copy_only=False) if apart else None)
                    found = pa.array(score > -np.inf)
                    cols = [part.column("id"), names.take(pa.array(at)), labels.take(pa.array(at)), pa.array(score)]
                    yield pa.RecordBatch.from_arrays([c.filter(found).cast(f.type) for c, f in zip(cols, schema)], schema=schema)

        # enough tasks for the products, which cost far more than the rows
        spread = new.repartition(max(new.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism))
        found = materialise(spread.mapInArrow(best, kinds), "nearest")
        sent.destroy()
        return found

    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = functools.reduce(DataFrame.unionByName, [against(old.where(part == b)) for b in range(blocks)])
    top = found.groupBy("id").agg(F.min_by(F.struct("cluster_id", "score"), F.struct(-F.col("score"), "old")).alias("t"))
    return new.select("id").join(top, "id", "left").select("id", "t.cluster_id", "t.score")
