"""Exact dedup: binary-fuse filters of an immutable snapshot screen incoming digests.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one blank; null counts as
empty. Only rows that a filter lets through reach a join, and only those rows' texts are compared byte by byte.

Defined results: of equal texts the smallest id stays, null ids last; of rows that repeat an id and a text exactly one
stays; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnweave.llm.screen import build_filters, screen
from tarnweave.llm.skew import join_groups
from tarnweave.llm.text import collapsed
from tarnweave.storage import materialise


def _digested(docs: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    norm = collapsed(F.col(text_col))
    cols = [F.col(id_col).alias("id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.xxhash64(norm).alias("key")]
    return docs.select(*cols, *([norm.alias("norm")] if with_text else []))


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))


def dedup_batch(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Digests that occur more than once over an immutable snapshot and a new batch: (digest, key).

    The snapshot's filters screen the batch; what passes joins the snapshot's exact buckets, and what doesn't is
    grouped within the batch alone.
    """
    old = materialise(_buckets(snapshot), "buckets")
    new = materialise(_buckets(incoming), "batch")
    filters, n_seg = build_filters(old, "key", old.count())
    seen = materialise(screen(new, "key", filters, n_seg), "screened")
    known = seen.where("maybe").join(old.select("digest", "key"), ["digest", "key"], "left_semi").select("digest", "key")
    repeated = old.unionByName(seen.select("digest", "key", "n")).where("n > 1").select("digest", "key")
    return known.unionByName(repeated).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshot: Column | None = None) -> DataFrame:
    """Every row's (id, digest, keep_id, group_size, kept).

    ``snapshot``: which rows (by ``id``) an earlier, immutable snapshot holds; by default half of them, by the id's hash.
    """
    rows = materialise(_digested(docs, id_col, text_col), "digests")
    n_rows = rows.count()
    if snapshot is None:
        snapshot = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    doubled = materialise(dedup_batch(rows.where(snapshot), rows.where(~snapshot)), "doubled")
    filters, n_seg = build_filters(doubled, "key", doubled.count())
    # byte checks: whole texts, of the rows that the filter lets through only; copies combine before the shuffle
    texts = screen(_digested(docs, id_col, text_col, with_text=True), "key", filters, n_seg).where("maybe")
    exact = texts.groupBy("digest", "key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    exact = materialise(exact.where("group_size > 1").select("digest", "key", "keep_id", "group_size"), "groups")
    # the order doesn't matter: rows that share both columns are alike
    first = F.row_number().over(Window.partitionBy("digest", "id").orderBy("key")) == 1
    parts = [
        part.select("id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), ((F.col("group_size").isNull()) | (F.col("id").eqNullSafe(F.col("keep_id")) & first)).alias("kept"))
        for part in join_groups(rows, exact, ["digest", "key"], "group_size", n_rows)
    ]
    return parts[0].unionByName(parts[1])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns kept: rows that no filter holds pass without a shuffle."""
    found = materialise(exact_dedup(docs, id_col, text_col), "decisions")
    # a row is settled by its id and text; of exact repeats of the row that stays, one stays
    fate = found.where("group_size > 1").groupBy("id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    fate = materialise(fate.where("not stays or n > 1").withColumn("fate_key", F.xxhash64("id", "digest")), "fates")
    filters, n_seg = build_filters(fate, "fate_key", fate.count())
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("digest", digest_of("row", text_col))
    keyed = keyed.withColumn("fate_key", F.xxhash64(F.col("row").getField(id_col), F.col("digest")))
    keyed = screen(keyed, "fate_key", filters, n_seg)
    clear = keyed.where("not maybe").select("row.*")
    doubtful = keyed.where("maybe").join(fate.drop("id", "digest"), "fate_key", "left").where("stays is null or stays")
    rn = F.row_number().over(Window.partitionBy("fate_key").orderBy(F.xxhash64("row")))
    doubtful = doubtful.withColumn("rn", rn).where("stays is null or rn = 1").select("row.*")
    return clear.unionByName(doubtful)


def digest_of(row: str, text_col: str) -> Column:
    return F.unhex(F.sha2(collapsed(F.col(row).getField(text_col)).cast("binary"), 256))
