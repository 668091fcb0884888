"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are in proportion to its measure, at most ``cap``, and such that its source's expected
words meet the target. The whole part are certain copies; for the rest the source's documents are ranked by random odds
over inclusion odds (Rosen, 1997), and the rank order fills the words that are left, so that the sample's size in words
is fixed. A document that would pass the budget is skipped for later, smaller ones, until none that is open fits.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Targets: sources by code point, null last, weigh ``weights`` in turn and
share all words; a target stops at ``cap`` times its source's size and the excess is shared by weight.

Defined results: null and empty texts have size 0; a null source is a source of its own; randomness is a hash of the id,
the key and the seed, so reruns agree; rows that repeat an id and a key are interchangeable; an empty table gives an empty result; a document is taken at most ``cap`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnweave.llm.skew import join_groups
from tarnweave.llm.text import SPACE
from tarnweave.storage import materialise



def n_words(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    edge = lambda c: F.when(c.rlike(SPACE), 1).otherwise(0)
    n = F.size(F.split(t, SPACE)) - edge(F.substring(t, 1, 1)) - edge(F.substring(t, -1, 1))
    return F.when(t == "", 0).otherwise(n).cast("long")


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """A gapless rank over the whole table without gathering it in one task."""
    parts = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "_part").withColumn(out, inner + F.col("_before")).drop("_part", "_before")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def plan_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(s, source_size, n, target) for each source of ``sized`` (s, source, size)."""
    per = sized.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = ranked(per, [F.col("source").isNull().asc(), F.col("source").asc()], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = materialise(per.withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    most = F.col("source_size") * F.lit(float(cap))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, fixed = None, None
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("w") >= most
        spent, free, count = per.agg(F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.sum(F.when(over, 1).otherwise(0))).first()
        if count == fixed or not free:
            break
        fixed, level = count, (total - spent) / free
    return per.select("s", "source_size", "n", F.least(most, F.lit(level or 0.0) * F.col("w")).alias("target") if free else most.alias("target"))


def _shares(rows: DataFrame, per: DataFrame, n_rows: int, cap: float, measure: bool) -> DataFrame:
    """Add each document's expected copies ``e`` and its source's mean ``share``."""
    hot, rest = join_groups(rows, per, ["s"], "n", n_rows)
    joined = hot.unionByName(rest)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("share", F.least(share, F.lit(float(cap))))
    if not measure:
        return joined.withColumn("e", F.col("share"))
    # e = min(cap, c * m), and c such that a source's expected words meet its target
    joined = materialise(joined, "joined")
    level = joined.groupBy("s").agg(F.try_divide(F.first("target"), F.sum(F.col("m") * F.col("size"))).alias("c"), F.count(F.lit(1)).alias("k"))
    for _ in range(20):
        level = materialise(level, "level")
        hot, rest = join_groups(joined, level, ["s"], "k", n_rows)
        both = hot.unionByName(rest)
        over = F.coalesce(F.col("c") * F.col("m") >= cap, F.lit(False))
        again = both.groupBy("s").agg(F.first("c").alias("old"), F.first("target").alias("t"), F.sum(F.when(over, F.col("size") * cap).otherwise(0.0)).alias("spent"), F.sum(F.when(over, 0.0).otherwise(F.col("m") * F.col("size"))).alias("free"), F.count(F.lit(1)).alias("k"))
        again = again.select("s", "k", "old", F.when(F.col("free") > 0, F.greatest("old", (F.col("t") - F.col("spent")) / F.col("free"))).otherwise(F.col("old")).alias("c"))
        again = materialise(again, "again")
        if not again.where("c > old * (1 + 1e-9)").limit(1).count():
            break
        level = again.select("s", "c", "k")
    return both.withColumn("e", F.least(F.lit(float(cap)), F.coalesce(F.col("c") * F.col("m"), F.lit(0.0)))).drop("c", "k")


def _fill(open_: DataFrame, label: str) -> DataFrame:
    """Take rows of each source in rank order while their words fit its ``need``; adds boolean ``take``.

    Prefix sums go through ranges of the order: neither a source's rows nor equal ones meet in one task.
    """
    order = ["s", "v", "id", "key", "tie"]
    parts = materialise(open_.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    sums = parts.groupBy("s", "_part").agg(F.sum("size").alias("words"))
    before = sums.select("s", "_part", (F.sum("words").over(Window.partitionBy("s").orderBy("_part")) - F.col("words")).alias("before"))
    inner = F.sum("size").over(Window.partitionBy("s", "_part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(before, ["s", "_part"]).withColumn("take", F.col("before") + inner <= F.col("need")).drop("before", "_part")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20, measure: Column | str | None = "length", key: Column | None = None) -> DataFrame:
    """Every row's (id, source, size, source_size, target, copies, key).

    ``measure``: relative inclusion of documents within their source; a column of ``docs``, "length" for log2(2 + words),
    by which documents of more words are likelier, or None for all alike. ``key`` tells rows of one id apart; by default
    the text's hash.
    """
    key = F.xxhash64(text_col) if key is None else key
    # the place is written once with the rows, so that a lost executor can't change it
    tie = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(0)
    cols = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), tie.alias("tie"), _key(F.col(source_col)).alias("s")]
    own = isinstance(measure, Column)
    rows = docs.select(*cols, *([F.greatest(F.coalesce(measure.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("m")] if own else []))
    rows = materialise(rows, "sized")
    if measure is not None and not own:
        rows = rows.withColumn("m", F.log2(F.col("size") + F.lit(2.0)))
    n_rows = rows.count()
    per = materialise(plan_targets(rows, weights, cap), "targets")
    rows = _shares(rows, per, n_rows, cap, measure is not None)
    rows = rows.withColumn("whole", F.floor("e")).withColumn("part", F.col("e") - F.col("whole"))
    # random odds over inclusion odds
    u = (F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = lambda p: F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12))
    rows = rows.withColumn("v", u / (1 - u) / odds(F.col("part")))
    rows = materialise(rows.select("id", "source", "size", "key", "tie", "s", "source_size", "target", "whole", "part", "v"), "ranks")
    whole = rows.groupBy("s").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"), F.count(F.lit(1)).alias("k"))
    hot, rest = join_groups(rows, materialise(whole, "needs"), ["s"], "k", n_rows)
    open_ = hot.unionByName(rest).drop("k").where("part > 0")
    taken, round_ = [rows.where("part <= 0").withColumn("take", F.lit(False))], 0
    # every pass settles a source's prefix and all that are longer than what is left: passes grow as its logarithm
    while True:
        found = materialise(_fill(open_, f"open{round_}"), f"fill{round_}")
        taken.append(found.where("take").drop("need"))
        left = found.groupBy("s").agg((F.first("need") - F.sum(F.when(F.col("take"), F.col("size")).otherwise(0))).alias("left"), F.count(F.lit(1)).alias("k"))
        hot, rest = join_groups(found.where("not take"), materialise(left, "left"), ["s"], "k", found.count())
        # written, so that neither later passes nor the result join again
        both = materialise(hot.unionByName(rest).drop("k", "need"), f"rest{round_}")
        taken.append(both.where("size > left").drop("left"))
        open_ = both.where("size <= left").drop("take").withColumnRenamed("left", "need")
        round_ += 1
        if not open_.limit(1).count():
            break
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("take").cast("long")).alias("copies"), "key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, all columns kept.

    Only rows that agree in every column are interchangeable.
    """
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    decided = mix_sources(docs, id_col, text_col, source_col, key=F.xxhash64(*plain), **options)
    same = decided.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_n")).where("_copies > 0")
    same = materialise(same, "copies")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(*plain).alias("_key"))
    row = row.alias("l").join(same.alias("r"), F.expr("l._id <=> r._id and l._key = r._key")).select("_row", "l._id", "l._key", "_copies", "_n")
    repeat = lambda rows, n: rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), n))).select("_row.*")
    each = F.expr("_copies div _n")
    out = repeat(row.where(each > 0), each)
    # what equal rows can't share evenly goes to one of them
    if same.where("_copies % _n > 0").limit(1).count():
        odd = row.where("_copies % _n > 0").dropDuplicates(["_id", "_key"])
        out = out.unionByName(repeat(odd, F.expr("_copies % _n")))
    return out
