"""Embedding near-dedup as an exact metric range join.

Vectors of one label and dimension are made unit; cosine >= t is distance <= r = sqrt(2 - 2t). Pivots, some of the
vectors, partition each label into cells by the nearest pivot. A vector visits every other cell whose border it is
within r of: by the triangle inequality d(x, q) - d(x, p) <= 2r is needed, and among unit vectors the stricter
d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q). Each cell then joins its own vectors with its own and its visitors, independently
and in blocks, so that every vector meets all its links in its own cell. Vectors that are equal are one node.

Defined results: rows without an id or label and vectors that are null, empty, zero or hold null or non-finite
components are linked with nothing; rows that repeat an id are separate vectors of one document, whose component is
shared; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.components import components
from tarnweave.llm.skew import join_groups
from tarnweave.storage import materialise

#: Vectors for each pivot (pivots stay under the root of a label's number of vectors, so that dealing them out takes
#: n^1.5 distances at most), and rows of a block of a cell's own vectors and of all it holds.
CELL = 4000
OWN_BLOCK, ALL_BLOCK = 2048, 8192
#: Vectors that one task assigns to cells, and distances it holds at a time.
ASSIGNED, DISTANCES = 20_000, 2_000_000


def _stack(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(len(col), -1)


def _unit(batches):
    """(id, label, dim, vec): vectors of length one as bytes; null where a vector can't be made one."""
    for batch in batches:
        col = batch.column(2)
        dims = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        starts = np.cumsum(dims) - dims
        packed: list[bytes | None] = [None] * len(dims)
        for d in np.unique(dims[dims > 0]).tolist():
            rows = np.flatnonzero(dims == d)
            for k in range(0, len(rows), max(1, DISTANCES // d)):
                part = rows[k : k + max(1, DISTANCES // d)]
                m = flat[starts[part][:, None] + np.arange(d)]
                ok = np.isfinite(m).all(axis=1)
                ok &= np.abs(np.where(ok[:, None], m, 0.0)).max(axis=1) > 0
                # scaled by the largest component first, so that neither squares nor their sum leave the range
                m = m[ok] / np.abs(m[ok]).max(axis=1, keepdims=True)
                m = m / np.sqrt((m * m).sum(axis=1, keepdims=True)) + 0.0
                for at, v in zip(part[ok].tolist(), m):
                    packed[at] = v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int64()), pa.array(packed, pa.binary())], names=["id", "label", "dim", "vec"])


def _assign(radius: float):
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["node", "cells", "home"])
        pivots = pivots.sort_values("node")
        x, p = _stack(rows["vec"]), _stack(pivots["vec"])
        cells, home = [], []
        step = max(1, DISTANCES // len(p))
        for k in range(0, len(x), step):
            d2 = np.maximum(0.0, 2 - 2 * (x[k : k + step] @ p.T))
            near = d2.argmin(axis=1)
            between = np.sqrt(np.maximum(0.0, 2 - 2 * (p[near] @ p.T)))
            least = d2[np.arange(len(d2)), near][:, None]
            # 1e-6 covers rounding: a visit too many costs time, never a link
            visits = d2 - least <= 2 * radius * between + 1e-6
            visits &= np.sqrt(d2) - np.sqrt(least) <= 2 * radius + 1e-6
            visits[np.arange(len(d2)), near] = True
            cells += [np.flatnonzero(v) for v in visits]
            home += near.tolist()
        return pd.DataFrame({"node": rows["node"].to_numpy(), "cells": cells, "home": home})

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each one's component, for links a - b among n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join_block(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, rest = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        empty = pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
        if not len(own) or not len(rest):
            return empty
        y, yid, weight = _stack(rest["vec"]), rest["node"].to_numpy(np.int64), rest["size"].to_numpy(np.int64)
        found = []
        x, xid = _stack(own["vec"]), own["node"].to_numpy(np.int64)
        for k in range(0, len(x), 512):
            a, b = np.nonzero(x[k : k + 512] @ y.T >= threshold)
            keep = xid[a + k] != yid[b]
            found.append((a[keep] + k, b[keep]))
        a, b = (np.concatenate(z) for z in zip(*found))
        if not len(a):
            return empty
        ids, at = np.unique(np.concatenate([xid[a], yid[b]]), return_inverse=True)
        root = ids[_forest(at[: len(a)], at[len(a) :], len(ids))]
        links = np.bincount(at[: len(a)], weights=weight[b], minlength=len(ids)).astype(np.int64)
        return pd.DataFrame({"node": ids, "links": links, "root": root})

    return run


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Every row's (id, n_links, component_id); a link is a cosine of at least ``threshold`` within one label."""
    kind = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_unit, f"id {kind[0]}, label {kind[1]}, dim long, vec binary")
    rows = rows.withColumn("vec", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.col("vec")))
    rows = rows.withColumn("h", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), "vec"))
    # a node is a class of equal vectors of one label, whatever ids its rows have
    rows = materialise(rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "h", "h2"))), "unit")
    n_rows = rows.count()
    key = ["label", "h", "h2"]
    classes = rows.where("vec is not null").groupBy(*key, "node", "vec", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes, "classes")

    groups = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("node", F.lit(1))).alias("first"))
    pivots_of = F.least(F.ceil(F.col("n") / CELL), F.ceil(F.sqrt("n")))
    groups = materialise(groups.withColumn("pivots", pivots_of).withColumn("salts", F.ceil(F.col("n") / ASSIGNED)), "labels")
    hot, rest = join_groups(classes, groups, ["label", "dim"], "n", classes.count())
    nodes = hot.unionByName(rest).select("label", "dim", "node", "size", "vec", "n", "first", "pivots", "salts")
    nodes = materialise(nodes, "nodes")
    mark = F.xxhash64("node", F.lit(1))
    chosen = (F.pmod(mark, F.lit(1 << 40)) * F.col("n") < F.col("pivots") * float(1 << 40)) | (mark == F.col("first"))
    pivots = nodes.where(chosen).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    dealt = nodes.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(2)), "salts"))
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    by = ["label", "dim", "salt"]
    cells = dealt.select(*by, "node", "vec").groupBy(*by).cogroup(pivots.select(*by, "node", "vec").groupBy(*by))
    cells = materialise(cells.applyInPandas(_assign(radius), "node long, cells array<int>, home int"), "visits")
    cells = nodes.select("label", "dim", "node", "size", "vec").join(cells, "node").withColumn("cell", F.explode("cells"))
    cells = materialise(cells.select("label", "dim", "cell", (F.col("cell") == F.col("home")).alias("own"), "node", "size", "vec"), "cells")

    cell = ["label", "dim", "cell"]
    shape = cells.groupBy(*cell).agg(F.ceil(F.sum(F.col("own").cast("int")) / OWN_BLOCK).alias("i_n"), F.ceil(F.count(F.lit(1)) / ALL_BLOCK).alias("j_n"), F.count(F.lit(1)).alias("held"))
    hot, rest = join_groups(cells, materialise(shape, "shapes"), cell, "held", cells.count())
    placed = hot.unionByName(rest)
    zero = F.lit(0).cast("long")
    own = placed.where("own").withColumn("i", F.pmod(F.xxhash64("node"), "i_n")).withColumn("j", F.explode(F.sequence(zero, F.col("j_n") - 1))).withColumn("side", F.lit(0))
    every = placed.where("i_n > 0").withColumn("j", F.pmod(F.xxhash64("node"), "j_n")).withColumn("i", F.explode(F.sequence(zero, F.col("i_n") - 1))).withColumn("side", F.lit(1))
    cols = [*cell, "i", "j", "side", "node", "size", "vec"]
    blocks = own.select(*cols).unionByName(every.select(*cols)).groupBy(*cell, "i", "j")
    found = materialise(blocks.applyInPandas(_join_block(threshold), "node long, links long, root long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("outer"))
    # what is reached is a matter of ids: a class stands for its smallest, and an id of several classes joins them
    arcs = found.where("node <> root").select("node", "root").join(classes.select("node", F.col("rep").alias("a")), "node")
    arcs = arcs.join(classes.select(F.col("node").alias("root"), F.col("rep").alias("b")), "root").select("a", "b")
    owned = rows.where("vec is not null").select("id", "node").distinct()
    several = materialise(owned.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id"), "several")
    bound = owned.join(several, "id", "left_semi").join(classes.select("node", "rep"), "node").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(arcs.unionByName(bound)).withColumnRenamed("node", "rep")
    settled = classes.join(links, "node", "left").join(comp, "rep", "left").where("size > 1 or outer is not null or component is not null")
    settled = materialise(settled.select(*key, "rep", "size", "outer", "component"), "settled")
    hot, rest = join_groups(rows.select("id", *key), settled, key, "size", n_rows)
    out = hot.unionByName(rest)
    return out.select("id", (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("outer", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"))
