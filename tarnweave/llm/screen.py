"""Snapshot filters: static binary-fuse segments that screen keys before any join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.binary_fuse import BinaryFuse
from tarnweave.storage import materialise

#: Keys of one segment; a segment is built in one task from 8-byte keys.
SEGMENT_KEYS = 200_000
#: Filters of at most this many bytes are sent to every executor; larger ones are routed by segment.
BROADCAST_BYTES = 64 << 20

_SCHEMA = "seg long, seed decimal(20,0), seg_len long, seg_count long, cells binary"


def segment(key: Column, n_seg: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_seg))


def build_filters(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """One immutable filter per segment of the 64-bit column ``key``; returns them, written, and their number."""
    n_seg = max(1, -(-n_keys // SEGMENT_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from decimal import Decimal

        f = BinaryFuse.build(pdf["key"].to_numpy(np.int64))
        return pd.DataFrame([(int(pdf["seg"].iloc[0]), Decimal(f.seed), f.seg_len, f.seg_count, f.cells)], columns=["seg", "seed", "seg_len", "seg_count", "cells"])

    parts = keys.where(F.col(key).isNotNull()).select(segment(F.col(key), n_seg).alias("seg"), F.col(key).alias("key"))
    return materialise(parts.groupBy("seg").applyInPandas(build, _SCHEMA), "fuse"), n_seg


def _probe(row) -> BinaryFuse:
    return BinaryFuse(int(row["seed"]), int(row["seg_len"]), int(row["seg_count"]), bytes(row["cells"]))


def screen(rows: DataFrame, key: str, filters: DataFrame, n_seg: int, out: str = "maybe") -> DataFrame:
    """Add boolean ``out``: false where ``key`` is certainly not among the filters' keys.

    Only the key goes to Python. Beyond BROADCAST_BYTES of filters, keys are routed to their segment instead.
    """
    spark = rows.sparkSession
    total = filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast({r["seg"]: _probe(r) for r in filters.collect()})

        @F.pandas_udf("boolean")
        def probe(keys: pd.Series, segs: pd.Series) -> pd.Series:
            k, s, hit = keys.to_numpy(np.int64), segs.to_numpy(np.int64), np.zeros(len(keys), bool)
            for seg in np.unique(s):
                if (f := sent.value.get(int(seg))) is not None:
                    own = s == seg
                    hit[own] = f.contains(k[own])
            return pd.Series(hit)

        return rows.withColumn(out, probe(F.coalesce(F.col(key), F.lit(0)), segment(F.coalesce(F.col(key), F.lit(0)), n_seg)) & F.col(key).isNotNull())

    def probe_segment(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(left), bool)
        if len(right):
            hit = _probe(right.iloc[0]).contains(left["key"].to_numpy(np.int64))
        return pd.DataFrame({"key": left["key"][hit]}).drop_duplicates()

    # each distinct key once; a segment's keys are split over salts so that no task holds an unbounded part
    keys = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
    salts = max(1, keys.count() // (n_seg * 1_000_000))
    left = keys.select("key", segment(F.col("key"), n_seg).alias("seg"), F.pmod(F.xxhash64("key", F.lit(7)), F.lit(salts)).alias("salt"))
    right = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    hits = left.groupBy("seg", "salt").cogroup(right.groupBy("seg", "salt")).applyInPandas(probe_segment, "key long")
    hits = hits.select(F.col("key").alias(key), F.lit(True).alias(out))
    return rows.join(hits, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose ``id_col`` is among ``ids`` (one column, ``id``); null ids stay.

    A filter of the ids lets all other rows pass unshuffled; what it holds back is settled by an exact join.
    """
    gone = materialise(ids.where("id is not null").distinct().withColumn("_key", F.xxhash64("id")), "gone")
    filters, n_seg = build_filters(gone, "_key", gone.count())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = screen(row.withColumn("_id", F.col("_row").getField(id_col)).withColumn("_key", F.xxhash64("_id")), "_key", filters, n_seg, "_maybe")
    doubtful = row.where("_maybe").join(gone.select(F.col("id").alias("_id")), "_id", "left_anti")
    return row.where("not _maybe").select("_row.*").unionByName(doubtful.select("_row.*"))
