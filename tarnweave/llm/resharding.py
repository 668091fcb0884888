"""Minimum-cost-flow resharding.

From the old shards' bytes and the new shards' capacities a minimum-cost flow gives the block transfers that move the
fewest bytes. Each old shard's rows lie on a line of bytes, large groups first; the flow cuts the line, what stays comes
first, and each group of equal texts goes where its middle lies. A second flow over the outcome moves what groups at the
cuts left over, from the ends of the lines, where the smallest groups lie. Only shards whose rows changed are written again.

Defined results: size is the text's UTF-8 bytes (null: none) plus OVERHEAD; equal texts share a shard unless their bytes
exceed ``whole`` of a shard's capacity (an eighth by default), in which case they are dealt by id, as near-equal sizes
come first; rows that repeat an id and a text share a shard; an empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnweave.llm.skew import join_groups
from tarnweave.storage import materialise

OVERHEAD = 16
#: Rows of a block, which one task numbers.
BLOCK = 10_000
#: The share of a shard's capacity up to which equal texts stay together.
WHOLE = 0.125
LINE, ORDER = ["old_shard", "grade", "block"], ["unit", "key", "id", "size"]


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Bytes from each old to each new shard at the least ``cost(i, j)`` a byte, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def edge(a: int, b: int, c: int, p: int) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((c, 0))
        price.extend((p, -p))

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    at = {}
    for i in range(n):
        for j in range(m):
            at[i, j] = len(to)
            edge(i, n + j, 1 << 62, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    while True:
        best, via, queue, queued = [None] * len(graph), [-1] * len(graph), deque([source]), [False] * len(graph)
        best[source] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in graph[x]:
                if room[e] and (best[to[e]] is None or best[x] + price[e] < best[to[e]]):
                    best[to[e]], via[to[e]] = best[x] + price[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if best[sink] is None:
            break
        push, x = 1 << 62, sink
        while x != source:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return [[room[at[i, j] ^ 1] for j in range(m)] for i in range(n)]


def plan_transfers(old: dict[int, int], n_new: int) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard): where each stretch of an old shard's line goes."""
    total = sum(old.values())
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    shards = sorted(old)
    flow = min_cost_flow([old[i] for i in shards], capacity, lambda i, j: int(shards[i] != j))
    out = []
    for i, row in zip(shards, flow):
        at = 0
        for j in sorted(range(n_new), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _place(rows: DataFrame, n_new: int, whole: float, n_rows: int) -> DataFrame:
    """One flow: rows (id, key, size, crc, came, old_shard) with their place on the line of their old shard, and new ``shard``."""
    old = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    moves = plan_transfers(old, n_new)
    limit = max(1, int(sum(old.values()) // n_new * whole))
    groups = rows.groupBy("old_shard", "key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot, rest = join_groups(rows, materialise(groups, "groups"), ["old_shard", "key"], "n", n_rows)
    rows = hot.unionByName(rest).drop("n").withColumn("bytes", F.coalesce("bytes", "size"))
    rows = rows.withColumn("unit", F.when(F.col("bytes") > limit, F.xxhash64("id", "key")).otherwise(F.col("key")))
    rows = materialise(rows.withColumn("grade", -F.floor(F.log2(F.col("bytes").cast("double"))).cast("int")), "graded")
    parts = rows.groupBy("old_shard", "grade").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # under 64 grades a shard
    rows = rows.join(F.broadcast(parts), ["old_shard", "grade"]).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("parts"))).drop("parts")

    sums = rows.groupBy(*LINE).agg(F.sum("size").alias("total"))
    starts = sums.select(*LINE, (F.sum("total").over(Window.partitionBy("old_shard").orderBy("grade", "block")) - F.col("total")).alias("start"))
    upto = F.sum("size").over(Window.partitionBy(*LINE).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(starts, LINE).withColumn("end", F.col("start") + upto)
    unit = Window.partitionBy(*LINE, "unit", "key")
    rows = rows.withColumn("middle", (F.min(F.col("end") - F.col("size")).over(unit) + F.max("end").over(unit)) / 2)
    cuts = rows.sparkSession.createDataFrame(moves or [(0, 0, 0, 0)], "old_shard int, lo long, hi long, shard int")
    # a few stretches for each old shard: at most old + new in all
    cuts = cuts.groupBy("old_shard").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("cuts"))
    inside = F.filter("cuts", lambda c: c["hi"] > F.col("middle"))
    shard = F.coalesce(F.get(inside, 0)["shard"], F.element_at("cuts", -1)["shard"])
    return materialise(rows.join(F.broadcast(cuts), "old_shard").withColumn("shard", shard).select("id", "key", "size", "crc", "came", *LINE, "unit", "shard"), "placed")


def reshard(docs: DataFrame, old_shard: Column, n_new: int, id_col: str = "doc_id", text_col: str = "text", whole: float = WHOLE) -> DataFrame:
    """Every row's (id, key, size, crc, old_shard, shard, slot); slots run from 0 without gaps in each shard.

    ``old_shard`` must be a function of the text where equal texts are to stay together. Shard counts are parameters of
    the layout: only they, not rows, reach the driver.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), old_shard.cast("int").alias("came"))
    rows = materialise(rows.withColumn("old_shard", F.col("came")), "rows")
    n_rows = rows.count()
    first = _place(rows, n_new, whole, n_rows)
    rows = _place(first.select("id", "key", "size", "crc", "came", F.col("shard").alias("old_shard")), n_new, whole, n_rows)

    piece = ["shard", *LINE]
    counts = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select(*piece, (F.sum("n").over(Window.partitionBy("shard").orderBy(*LINE)) - F.col("n")).alias("base"))
    number = F.row_number().over(Window.partitionBy(*piece).orderBy(*ORDER)) - 1
    rows = rows.join(bases, piece).withColumn("slot", (F.col("base") + number).cast("long"))
    return rows.select("id", "key", "size", "crc", F.col("came").alias("old_shard"), "shard", "slot")


def affected_shards(placed: DataFrame) -> list[int]:
    """New shards that lost or gained rows; the others' files stay as they are."""
    moved = placed.where("shard <> old_shard")
    gained = {r[0] for r in moved.select("shard").distinct().collect()}
    return sorted(gained | {r[0] for r in moved.select("old_shard").distinct().collect()})


def rewrite_shards(docs: DataFrame, placed: DataFrame, path: str, n_new: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 256 << 20) -> list[int]:
    """Write the affected shards' rows as ``path``/shard=N (``_shard`` where a column has that name), overwriting just those folders; returns their numbers.

    Folders of shards that the new layout lacks or that lost all rows are deleted once the rows are written.
    """
    home = "shard" if "shard" not in docs.columns else "_shard"
    affected = affected_shards(placed)
    changed = [s for s in affected if s < n_new]
    keep = placed.where(F.col("shard").isin(changed)).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("shard").alias(home)).dropDuplicates(["_id", "_key"])
    rows = docs.join(keep, F.col(id_col).eqNullSafe(F.col("_id")) & (text_key(F.col(text_col)) == F.col("_key"))).drop("_id", "_key")
    sizes = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.sum("size")).collect()}
    files = max(1, -(-max(sizes.values(), default=1) // row_bytes))
    spread = F.pmod(F.xxhash64(id_col), F.lit(files))
    rows.repartition(len(changed) * files or 1, home, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(home).parquet(path)
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files_of = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in affected:
        if s not in sizes or s >= n_new:
            files_of.delete(folder(f"{path}/{home}={s}"), True)
    return changed
