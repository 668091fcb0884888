"""Property-graph tables: edges, upserts, communities and one-hop traversals."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tarnweave.storage import materialise


def edge(src: Column, dst: Column, kind: str) -> list[Column]:
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")]


def tree_edges(documents: DataFrame, sections: DataFrame, shadows: DataFrame) -> DataFrame:
    """HAS_DOCUMENT, HAS_SECTION, HAS_SHADOW from the foreign keys."""
    return (
        documents.where("ticker is not null").select(*edge(F.col("ticker"), F.col("doc_id"), "HAS_DOCUMENT"))
        .unionByName(sections.select(*edge(F.col("doc_id"), F.col("section_id"), "HAS_SECTION")))
        .unionByName(shadows.select(*edge(F.col("section_id"), F.col("shadow_id"), "HAS_SHADOW")))
    )


def next_chunk_edges(shadows: DataFrame) -> DataFrame:
    """The chain of chunks within each section."""
    follow = F.lead("shadow_id").over(Window.partitionBy("section_id").orderBy("chunk_index"))
    return shadows.withColumn("dst", follow).where("dst is not null").select(*edge(F.col("shadow_id"), F.col("dst"), "NEXT_CHUNK"))


def upsert_nodes(old: DataFrame, new: DataFrame, listed: list[str], key: str = "id", order: str | None = None) -> DataFrame:
    """Listed columns are overwritten, even by null; others are kept; new ids have null there.

    Of rows that repeat an id in ``new`` the last by ``order`` wins.
    """
    if order is not None:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        new = new.withColumn("_r", rank).where("_r = 1").drop("_r")
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in listed], F.lit(True).alias("_new"))
    both = old.join(n, old[key] == n["_key"], "full_outer")
    cols = [F.coalesce(F.col(key), F.col("_key")).alias(key)]
    for c in old.columns:
        if c != key:
            cols.append((F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in listed else F.col(c)).alias(c))
    return both.select(*cols)


def upsert_edges(edges: DataFrame, node_ids: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, type) whose ends both exist, once each."""
    ids = node_ids.select("id").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")
    return (ok if existing is None else ok.unionByName(existing)).dropDuplicates(["src", "dst", "type"])


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows whose id is new go, then the new ones are added."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_keywords(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (shadow_id, phrase, score); a repeated edge takes the new score."""
    key = ["shadow_id", "phrase"]
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))


def duplicate_ids(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Ids that break uniqueness."""
    return nodes.groupBy(key).count().where("count > 1")


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other) both ways."""
    return edges.select(F.col("id_a").alias("node"), F.col("id_b").alias("other")).unionByName(edges.select(F.col("id_b").alias("node"), F.col("id_a").alias("other")))


def keyword_cooccurrence(section_keywords: DataFrame, similar: DataFrame, least: int = 8) -> DataFrame:
    """Sections a < b sharing at least ``least`` phrases and not linked yet; score round(min(n / 10, 1), 4).

    ``section_keywords``: (section_id, phrase), a bounded number for each section. Sections meet by three phrases at
    once, not by each one: of two sections' common phrases the three rarest stand before the last ``least - 3`` of
    either's, from the rarest on. What they share is then counted exactly.
    """
    some = min(3, least)
    one = section_keywords.select("section_id", "phrase").distinct()
    df = one.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    held = one.join(df, "phrase").groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("df", "phrase"))).alias("p"))
    held = held.where(F.size("p") >= least).select("section_id", F.transform("p", lambda x: x["phrase"]).alias("p"))
    held = materialise(held, "phrases")
    kind = held.schema["section_id"]
    schema = to_arrow_schema(StructType([kind, StructField("key", LongType())]))

    def meet(batches):
        for batch in batches:
            lists = batch.column("h")
            size, start, flat = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1], lists.values.to_numpy().view(np.uint64)
            for k in np.unique(size).tolist():
                rows = np.flatnonzero(size == k)
                places = np.array(list(itertools.combinations(range(k - least + some), some)), np.int64)
                step = max(1, 500_000 // len(places))
                for i in range(0, len(rows), step):
                    own = rows[i : i + step]
                    key = np.zeros((len(own), len(places)), np.uint64)
                    for j in range(some):  # wraps; equal keys of other phrases only give a pair more to count
                        key = (key ^ flat[start[own][:, None] + places[None, :, j]]) * np.uint64(0x9E3779B97F4A7C15)
                    at = pa.array(np.repeat(own, len(places)))
                    yield pa.RecordBatch.from_arrays([batch.column("section_id").take(at), pa.array(key.ravel().view(np.int64))], schema=schema)

    keys = held.select("section_id", F.transform("p", lambda x: F.xxhash64(x)).alias("h")).mapInArrow(meet, StructType([kind, StructField("key", LongType())]))
    keys = materialise(keys, "keys")
    pairs = keys.select("key", F.col("section_id").alias("id_a")).join(keys.select("key", F.col("section_id").alias("id_b")), "key").where("id_a < id_b").select("id_a", "id_b").distinct()
    pairs = pairs.join(held.select(F.col("section_id").alias("id_a"), F.col("p").alias("pa")), "id_a").join(held.select(F.col("section_id").alias("id_b"), F.col("p").alias("pb")), "id_b")
    shared = pairs.select("id_a", "id_b", F.size(F.array_intersect("pa", "pb")).cast("long").alias("shared")).where(F.col("shared") >= least)
    linked = similar.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return shared.join(linked, ["id_a", "id_b"], "left_anti").select("id_a", "id_b", "shared", F.round(F.least(F.col("shared") / 10.0, F.lit(1.0)), 4).alias("score"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of a partition (id, cluster_id) over undirected unweighted edges (id_a, id_b)."""
    m = edges.count()
    if not m:
        return 0.0
    a = edges.join(labels.select(F.col("id").alias("id_a"), F.col("cluster_id").alias("ca")), "id_a").join(labels.select(F.col("id").alias("id_b"), F.col("cluster_id").alias("cb")), "id_b")
    inside = a.where("ca = cb").count() / m
    ends = a.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").count()
    return inside - (ends.agg(F.sum((F.col("count") / (2.0 * m)) ** 2)).first()[0] or 0.0)


def min_label(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's connected component, with pointer jumping; a table a round."""
    links = materialise(undirected(edges), "links")
    now = materialise(nodes.select("id", F.col("id").alias("root")), "roots")
    while True:
        near = links.join(now.select(F.col("id").alias("other"), "root"), "other").groupBy(F.col("node").alias("id")).agg(F.min("root").alias("near"))
        hooked = now.join(near, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        hooked = materialise(hooked, "hooked")
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("far"))
        now = materialise(hooked.join(jump, "root").select("id", F.least("far", "root").alias("root"), "was"), "roots")
        if not now.where("root <> was").limit(1).count():
            return now.select("id", "root")
        now = now.drop("was")


_PRIME = 2**31 - 1


def _role(level: int, turn: int) -> tuple[int, int]:
    return tuple(np.random.default_rng([level, turn]).integers(1, _PRIME, 2).tolist())


def _receives(name, level: int, turn: int):
    """Whether communities, by their ids, take nodes in this round or give them; an array or a Column."""
    a, b = _role(level, turn)
    if isinstance(name, Column):
        return F.pmod(F.pmod(name, F.lit(_PRIME)) * F.lit(a) + F.lit(b), F.lit(_PRIME)).bitwiseAND(1 << 15) > 0
    return ((name % _PRIME * a + b) % _PRIME & 1 << 15) > 0


def _communities(x: np.ndarray, y: np.ndarray, name: np.ndarray, m: int) -> np.ndarray:
    """Louvain over one component in memory: each node's community, by its smallest member's name.

    ``x`` and ``y`` are the edges' ends as places in ``name``, which is sorted; ``m`` counts the whole graph's edges.
    The rule is that of ``_communities_by_rounds``, with the same result.
    """
    member = np.arange(len(name))
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    w = np.ones(len(x), np.int64)
    degree = np.bincount(x, minlength=len(name))
    sums = lambda at, v, n: np.bincount(at, weights=v, minlength=n).astype(np.int64)
    level = 0
    while True:
        size = len(name)
        score = lambda c: 2 * m * int(w[c[x] == c[y]].sum()) - int((sums(c, degree, size) ** 2).sum())  # noqa: B023, E731
        community, turn = np.arange(size), 0
        while True:
            total = sums(community, degree, size)
            key, at = np.unique(x * size + community[y], return_inverse=True)
            links, node, target = sums(at, w, len(key)), key // size, key % size
            same, own = target == community[node], np.zeros(size, np.int64)
            own[node[same]] = links[same]
            gain = 2 * m * (links - own[node]) - degree[node] * (total[target] - total[community[node]] + degree[node])
            gains = ~same & (gain > 0)
            if not gains.any():
                break
            node, target, gain = node[gains], target[gains], gain[gains]
            order = np.lexsort((target, -gain, node))
            order = order[np.unique(node[order], return_index=True)[1]]
            node, target, gain = node[order], target[order], gain[order]
            source, takes = community[node], _receives(name, level, turn)
            chosen = ~takes[source] & takes[target]
            moved = community.copy()
            moved[node[chosen]] = target[chosen]
            if score(moved) <= score(community):
                rank = np.empty(len(node), np.int64)
                rank[np.lexsort((node, -gain))] = np.arange(len(node))
                first = np.full(size, len(node))
                np.minimum.at(first, source, rank)
                np.minimum.at(first, target, rank)
                chosen = (first[source] == rank) & (first[target] == rank)
                moved = community.copy()
                moved[node[chosen]] = target[chosen]
            community, turn = moved, turn + 1
        if not turn:
            return name[member]
        least = np.full(size, size)
        np.minimum.at(least, community, np.arange(size))
        kept, dense = np.unique(least[community], return_inverse=True)
        name, member, degree = name[kept], dense[member], sums(dense, degree, len(kept))
        x, y = dense[x], dense[y]
        key, at = np.unique((x * len(kept) + y)[x != y], return_inverse=True)
        x, y, w = key // len(kept), key % len(kept), sums(at, w[x != y], len(key))
        level += 1


def _round(links: DataFrame, now: DataFrame, m: int, level: int, turn: int) -> DataFrame | None:
    """One round of moves over ``now`` (root, node, degree, community); None where no node gains by a move."""
    exact = lambda c: c.cast("decimal(19,0)")
    twice = exact(F.lit(2 * m))
    total = now.groupBy("community").agg(F.sum("degree").alias("total"))
    held = now.join(total, "community")
    near = links.join(now.select(F.col("node").alias("other"), F.col("community").alias("target")), "other").groupBy("node", "target").agg(F.sum("weight").alias("links"))
    near = near.join(held, "node").join(total.select(F.col("community").alias("target"), F.col("total").alias("there")), "target")
    same, d = F.col("target") == F.col("community"), F.col("degree")
    value = twice * exact(F.col("links")) - exact(d) * exact(F.when(same, F.col("there") - d).otherwise(F.col("there")))
    best = near.withColumn("value", value).groupBy("root", "node", F.col("community").alias("source")).agg(
        F.max(F.when(same, F.col("value"))).alias("own"),
        F.min(F.when(~same, F.struct((-F.col("value")).alias("loss"), "target"))).alias("best"),
        F.max(-exact(d) * exact(F.col("total") - d)).alias("alone"),
    )
    gain = -F.col("best.loss") - F.coalesce("own", "alone")
    moves = materialise(best.where("best is not null").select("root", "node", "source", "best.target", gain.alias("gain")).where("gain > 0"), "moves")
    if moves.isEmpty():
        return None
    chosen = moves.where(~_receives(F.col("source"), level, turn) & _receives(F.col("target"), level, turn))
    tried = materialise(now.join(chosen.select("node", "target"), "node", "left").select("root", "node", "degree", "community", F.coalesce("target", "community").alias("moved")), "tried")
    ends = links.join(tried.select("node", "community", "moved"), "node").join(tried.select(F.col("node").alias("other"), F.col("community").alias("c"), F.col("moved").alias("d")), "other")
    inside = ends.groupBy("root").agg(F.sum(F.col("weight") * ((F.col("moved") == F.col("d")).cast("long") - (F.col("community") == F.col("c")).cast("long"))).alias("inside"))
    squares = lambda c, out: tried.groupBy("root", c).agg(F.sum("degree").alias("t")).groupBy("root").agg(F.sum(exact(F.col("t")) * exact(F.col("t"))).alias(out))
    change = inside.join(squares("community", "before"), "root").join(squares("moved", "after"), "root")
    better = materialise(change.where(twice * exact(F.col("inside")) - (F.col("after") - F.col("before")) > 0).select("root"), "better")
    rest = moves.join(better, "root", "left_anti")
    if rest.isEmpty():
        return tried.select("root", "node", "degree", F.col("moved").alias("community"))
    rest = rest.withColumn("rank", F.struct((-F.col("gain")).alias("loss"), "node"))
    first = rest.select(F.explode(F.array("source", "target")).alias("c"), "rank").groupBy("c").agg(F.min("rank").alias("first"))
    alone = rest.join(first.select(F.col("c").alias("source"), F.col("first").alias("f")), "source").join(first.select(F.col("c").alias("target"), F.col("first").alias("g")), "target").where("rank = f and rank = g")
    both = tried.join(better.withColumn("better", F.lit(True)), "root", "left").join(alone.select("node", "target"), "node", "left")
    return materialise(both.select("root", "node", "degree", F.when(F.col("better"), F.col("moved")).otherwise(F.coalesce("target", "community")).alias("community")), "communities")


def _communities_by_rounds(edges: DataFrame, m: int) -> DataFrame:
    """Louvain's local moves and folding as tables: (id, cluster_id) for edges (root, id_a, id_b) of components of any size.

    In a round each community gives nodes or takes them, by a hash, and every node whose best move goes from a giver to
    a taker makes it. Where that doesn't raise a component's modularity, only moves go that share no community with a
    better one; their gains add up. So each round raises it (sums are whole numbers), and rounds end when no move gains.
    """
    flip = edges.select("root", F.col("id_b").alias("node"), F.col("id_a").alias("other"))
    links = materialise(edges.select("root", F.col("id_a").alias("node"), F.col("id_b").alias("other")).unionByName(flip).withColumn("weight", F.lit(1).cast("long")), "links")
    nodes = materialise(links.groupBy("root", "node").agg(F.sum("weight").alias("degree")), "nodes")
    member, level = nodes.select(F.col("node").alias("id"), "node"), 0
    while True:
        now, turn = nodes.withColumn("community", F.col("node")), 0
        while (moved := _round(links, now, m, level, turn)) is not None:
            now, turn = moved, turn + 1
        if not turn:
            return member.select("id", F.col("node").alias("cluster_id"))
        least = now.groupBy("community").agg(F.min("node").alias("least"))
        to = materialise(now.join(least, "community").select("root", "node", "degree", "least"), "folded")
        member = materialise(member.join(to.select("node", "least"), "node").select("id", F.col("least").alias("node")), "members")
        nodes = materialise(to.groupBy("root", F.col("least").alias("node")).agg(F.sum("degree").alias("degree")), "nodes")
        ends = links.join(to.select("node", F.col("least").alias("a")), "node").join(to.select(F.col("node").alias("other"), F.col("least").alias("b")), "other")
        links = materialise(ends.where("a <> b").groupBy("root", F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("weight").alias("weight")), "links")
        level += 1


#: Edges of a component that one task may take; larger ones go through rounds over tables, with the same result.
LOUVAIN_EDGES = 2_000_000


def louvain(nodes: DataFrame, edges: DataFrame, limit: int = LOUVAIN_EDGES) -> DataFrame:
    """(id, cluster_id) for every node (D9), over unweighted undirected edges (D10); ids are numbers.

    A cluster's id is its smallest member. Components are independent tasks; those over ``limit`` edges aren't gathered
    but take the same moves as distributed rounds.
    """
    edges = materialise(edges.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct(), "edges")
    m = edges.count()
    roots = materialise(min_label(edges, nodes), "components")
    held = edges.join(roots.select(F.col("id").alias("id_a"), "root"), "id_a")
    sizes = held.groupBy("root").count()
    large = materialise(sizes.where(F.col("count") > limit).select("root"), "large")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["id_a"], pdf["id_b"]]), return_inverse=True)
        return pd.DataFrame({"id": ids, "cluster_id": _communities(at[: len(pdf)], at[len(pdf) :], ids, m)})

    found = held.join(large, "root", "left_anti").groupBy("root").applyInPandas(one, "id long, cluster_id long")
    if large.limit(1).count():
        found = found.unionByName(_communities_by_rounds(held.join(large, "root", "left_semi").select("root", "id_a", "id_b"), m))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def traverse_up(anchors: DataFrame, tree: DataFrame, companies: DataFrame, linked: DataFrame) -> DataFrame:
    """A row for each (anchor, company, linked parent); anchors without a section or document vanish.

    ``tree``: (shadow_id, section_id, section_title, section_summary, doc_id, ticker, form_type, period, ...). Anchors are
    those of a batch of questions, a bounded number.
    """
    rows = tree.join(F.broadcast(anchors), "shadow_id").join(companies.select(F.col("id").alias("company_id")), F.col("ticker") == F.col("company_id"), "left")
    parents = linked.select(F.col("src").alias("parent_id"), F.col("dst").alias("doc_id"))
    return rows.join(parents, "doc_id", "left")


def traverse_similar(anchors: DataFrame, tree: DataFrame, similar: DataFrame | Callable[[DataFrame], DataFrame], top: int = 3, by_score: bool = False) -> DataFrame:
    """For each (qid, section) of the anchors its first ``top`` unseen neighbours, in id order (D2) or by score.

    A neighbour stands for itself by its smallest shadow id; rows repeat across anchors (D3). ``similar``: links (id_a,
    id_b, score) between sections, or what gives all links (section_id, other, score) of some sections.
    """
    seen = tree.select("shadow_id", "section_id").join(F.broadcast(anchors.select("qid", "shadow_id")), "shadow_id").select("qid", "section_id").distinct()
    if callable(similar):
        seen = materialise(seen, "seen")
    both = similar(seen.select("section_id").distinct()) if callable(similar) else similar.select(F.col("id_a").alias("section_id"), F.col("id_b").alias("other"), "score").unionByName(similar.select(F.col("id_b").alias("section_id"), F.col("id_a").alias("other"), "score"))
    first = tree.groupBy(F.col("section_id").alias("other")).agg(F.min("shadow_id").alias("shadow_id"))
    rows = seen.join(both, "section_id").join(first, "other").join(seen.select("qid", F.col("section_id").alias("other")), ["qid", "other"], "left_anti")
    order = [F.desc("score"), "other"] if by_score else ["other"]
    rank = F.row_number().over(Window.partitionBy("qid", "section_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("qid", F.col("section_id").alias("from_section"), "shadow_id")


def traverse_keyword(anchors: DataFrame, seen: DataFrame, keywords: DataFrame, phrases: int = 3, top: int = 3, per_phrase: bool = False) -> DataFrame:
    """For each anchor the ``top`` unseen chunks that share its best phrases, ranked by the anchor's own score.

    The cap is per anchor (D1) unless ``per_phrase``. ``keywords``: (shadow_id, phrase, score).
    """
    rank = F.row_number().over(Window.partitionBy("qid", "shadow_id").orderBy(F.desc("score"), "phrase"))
    best = keywords.join(F.broadcast(anchors.select("qid", "shadow_id")), "shadow_id").withColumn("rank", rank).where(F.col("rank") <= phrases)
    near = keywords.select("phrase", "shadow_id").join(F.broadcast(best.select("qid", F.col("shadow_id").alias("anchor"), "phrase", "score")), "phrase")
    near = near.join(F.broadcast(seen.select("qid", "shadow_id")), ["qid", "shadow_id"], "left_anti")
    by = ["qid", "anchor", *(["phrase"] if per_phrase else [])]
    near = near.groupBy(*by, "shadow_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "shadow_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("qid", "shadow_id").distinct()
