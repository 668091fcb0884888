"""Toxicity by lexicon induction over a word graph.

Seed terms come from a bounded sample of labelled documents: words whose document frequency differs most between toxic
and other documents, by the G-squared statistic. The graph's words are the seeds and all words that share passages with
toxic seeds more than SHIFT times as often as chance; its edges weigh positive pointwise mutual information beyond
ln(SHIFT), counted over all passages of PASSAGE words of the corpus. Random walks with restart from the toxic and from
the other seeds give each word a polarity; a document's features are the polarity it gathers, in all and by length, and a
logistic fit on the sample's documents turns them into a score.

Counts cover the whole corpus, so that scores don't depend on how the table is cut into files; thresholds are relative
to it. The word list that is broadcast holds fewer than PASSAGE / LEAST_SHARE words whatever the corpus: each must occur
in that share of all passages with a toxic seed. Workers hand partial counts on once they hold HELD_COUNTS of them.

Defined results: null, empty and wordless texts get the score of no evidence; rows are neither merged nor dropped;
unlabelled, null-labelled and held-out rows are never learned from; an id with several labels is left out; without both
classes or any seed the score is the share of toxic rows among those learned from, or 0. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.bpe import sliced
from tarnweave.llm.worker import release
from tarnweave.storage import materialise

#: Labelled documents that are learned from, at most, and the most seed terms of each kind.
SAMPLE_ROWS, SEEDS = 20_000, 400
#: Least toxic documents with a seed, and its least G-squared.
SEED_DOCS, SEED_G2 = 3, 12.0
PASSAGE, SHIFT = 128, 5.0
#: Least number of passages of an edge or an induced word, and least share of the passages with toxic seeds.
LEAST_COUNT, LEAST_SHARE = 3, 2e-4
RESTART, STEPS = 0.3, 6
THRESHOLD = 0.3
REMEMBERED = 100_000
#: Entries of a worker's partial counts before it hands them on, and words whose pairs are counted at a time.
HELD_COUNTS, RUN_WORDS = 250_000, 8192

_letters = re.compile(r"[^\W\d_]+")


class Tokens:
    """Words (letter runs in lower case) as numbers; with a vocabulary, words outside it are -1."""

    def __init__(self, vocabulary: dict[str, int] | None = None) -> None:
        self.fixed = vocabulary is not None
        self.index: dict[str, int] = vocabulary if vocabulary is not None else {}
        self.codes: dict[str, int] = {}
        self.several: list[list[int]] = []

    def reset(self) -> None:
        if len(self.codes) > REMEMBERED:
            self.codes, self.several = {}, []
            if not self.fixed:
                self.index = {}

    def _code(self, token: str) -> int:
        runs = _letters.findall(token)
        ids = [self.index.get(r, -1) if self.fixed else self.index.setdefault(r, len(self.index)) for r in runs]
        if len(ids) == 1:
            return ids[0]
        self.several.append(ids)
        return -1 - len(self.several)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words in a row, and how many each text has."""
        codes, flat, sizes = self.codes, [], []
        for t in texts:
            row = []
            for w in t.lower().split() if t else ():
                c = codes.get(w)
                if c is None:
                    c = codes[w] = self._code(w)
                row.append(c)
            if row and min(row) < -1:
                row = [x for c in row for x in (self.several[-2 - c] if c < -1 else (c,))]
            flat.append(np.array(row, np.int64))
            sizes.append(len(row))
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), np.array(sizes, np.int64)


def passages(sizes: np.ndarray) -> np.ndarray:
    """The passage of every word; passages don't cross documents."""
    each = -(-sizes // PASSAGE)
    start = np.cumsum(each) - each
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(start, sizes) + within // PASSAGE


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, y) of at most ``rows`` labelled ids, those whose id's hash is smallest."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = one.agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("z")).where("y = z").drop("z")
    return one.orderBy(F.xxhash64("id"), "id").limit(rows)


def seed_terms(sampled: DataFrame) -> tuple[list[str], list[str], tuple[int, int]]:
    """Toxic and other seed terms from (text, y), and how many documents each class has."""

    def count(batches):
        release()
        tokens, n = Tokens(), {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in {r for t in set(text.lower().split()) for r in _letters.findall(t)} if text else ():
                    n.setdefault(w, [0, 0])[y] += 1
                n.setdefault("", [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([v[y] for v in n.values()], pa.int64()) for y in (0, 1))], names=["word", "n0", "n1"])

    words = sampled.select("text", "y").mapInArrow(count, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = materialise(words, "sample-words")
    total = words.where("word = ''").first()
    if total is None or not total["n0"] or not total["n1"]:
        return [], [], (total["n0"] if total else 0, total["n1"] if total else 0)
    d0, d1 = float(total["n0"]), float(total["n1"])
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    share = (a + b) / (d0 + d1)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (part(a, share * d1) + part(b, share * d0) + part(d1 - a, (1 - share) * d1) + part(d0 - b, (1 - share) * d0))
    words = words.where("word <> ''").withColumn("g2", g2)
    toxic = words.where((a >= SEED_DOCS) & (F.col("g2") >= SEED_G2) & (a / d1 >= SHIFT * b / d0)).orderBy(F.desc("g2"), "word").limit(SEEDS)
    # other seeds: frequent in other documents, but not so frequent that they tell nothing
    other = words.where((b / d0 >= a / d1) & (b / d0 <= 0.05)).orderBy(F.desc("n0"), "word").limit(SEEDS)
    return [r["word"] for r in toxic.collect()], [r["word"] for r in other.collect()], (int(d0), int(d1))


def induced_words(docs: DataFrame, text_col: str, toxic: list[str]) -> list[str]:
    """Words over-represented in passages with toxic seeds.

    A first pass counts the passages that each word shares with toxic seeds; a second one counts all passages of the
    words that do so often enough, which are fewer than PASSAGE / LEAST_SHARE.
    """
    sent = docs.sparkSession.sparkContext.broadcast(toxic)

    def shared(batches):
        release()
        total: dict[str, int] = {}
        marked = passage_count = 0
        tokens = Tokens()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array([*total, ""], pa.string()), pa.array([*total.values(), marked], pa.int64()), pa.array([0] * len(total) + [passage_count], pa.int64())], names=["word", "near", "n"])

        for batch in batches:
            for _, _, texts in sliced(batch.column(0), 2 << 20):
                tokens.reset()
                flat, sizes = tokens.of(texts)
                if not len(flat):
                    continue
                place = passages(sizes)
                seeds = np.array([i for w in sent.value if (i := tokens.index.get(w)) is not None], np.int64)
                is_seed = np.zeros(len(tokens.index), bool)
                is_seed[seeds] = True
                n = int(place[-1]) + 1
                hit = np.zeros(n, bool)
                hit[place[is_seed[flat]]] = True
                passage_count += n
                marked += int(hit.sum())
                width = len(tokens.index)
                with_seed = np.bincount(np.unique((place * width + flat)[hit[place]]) % width, minlength=width)
                found = set(np.flatnonzero(with_seed).tolist())
                for i, w in enumerate(tokens.index):
                    if i in found:
                        total[w] = total.get(w, 0) + int(with_seed[i])
                if len(total) > HELD_COUNTS:
                    yield handed()
                    total, marked, passage_count = {}, 0, 0
        yield handed()

    met = _texts(docs, text_col).mapInArrow(shared, "word string, near long, n long").groupBy("word").agg(F.sum("near").alias("near"), F.sum("n").alias("n"))
    met = materialise(met, "met")
    total = met.where("word = ''").first()
    if total is None or not total["near"]:
        return []
    least = max(LEAST_COUNT, LEAST_SHARE * total["near"])
    near = {r["word"]: r["near"] for r in met.where((F.col("word") != "") & (F.col("near") >= least)).select("word", "near").collect()}
    words = sorted(near)
    index = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    width = max(1, len(words))

    def everywhere(batches):
        release()
        tokens, n = Tokens(index.value), np.zeros(width, np.int64)
        for batch in batches:
            for _, _, texts in sliced(batch.column(0), 2 << 20):
                tokens.reset()
                flat, sizes = tokens.of(texts)
                known = flat >= 0
                n += np.bincount(np.unique(passages(sizes)[known] * width + flat[known]) % width, minlength=width)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], names=["word", "n"])

    counts = _texts(docs, text_col).mapInArrow(everywhere, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return sorted(w for w, n in ((words[r["word"]], r["n"]) for r in counts) if near[w] * float(total["n"]) >= SHIFT * float(total["near"]) * n)


def word_graph(docs: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """Edges (a, b, weight), both ways, of positive mutual information beyond ln(SHIFT); words are numbers."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    width = max(1, len(words))

    def count(batches):
        release()
        tokens, kept, held, n = Tokens(sent.value), [], 0, 0

        def handed():
            k, c = _merged(kept) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(c, n))], names=["pair", "n"])

        for batch in batches:
            for _, _, texts in sliced(batch.column(0), 2 << 20):
                tokens.reset()
                flat, sizes = tokens.of(texts)
                if not len(flat):
                    continue
                place = passages(sizes)
                n += int(place[-1]) + 1
                own = np.unique((place * width + flat)[flat >= 0])
                for k, c in _pairs_in_runs(own // width, own % width, width):
                    kept.append((k, c))
                    held += len(k)
                    if held > HELD_COUNTS:
                        # the aggregate combines and spills what is handed on: a worker never holds more than this
                        yield handed()
                        kept, held, n = [], 0, 0
        yield handed()

    pairs = materialise(_texts(docs, text_col).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    total = float(pairs.where("pair = -1").first()["n"])
    both = pairs.where("pair >= 0").select(F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n")
    alone = both.where("a = b")
    joint = both.where(f"a <> b and n >= {LEAST_COUNT}").join(alone.select("a", F.col("n").alias("na")), "a").join(alone.select("b", F.col("n").alias("nb")), "b")
    joint = joint.withColumn("weight", F.log(F.col("n") * total / (F.col("na").cast("double") * F.col("nb") * SHIFT))).where("weight > 0")
    return materialise(joint.select("a", "b", "weight").unionByName(joint.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "graph")


def _pairs_in_runs(place: np.ndarray, word: np.ndarray, width: int):
    """Counts of the pairs that share a passage, and of the words alone (a pair with itself), for runs of whole passages."""
    start = 0
    while start < len(place):
        end = min(len(place), start + RUN_WORDS)
        if end < len(place):
            end = int(np.searchsorted(place, place[end - 1], side="right"))  # a passage has at most PASSAGE words
        p, w = place[start:end], word[start:end]
        keys = [w * width + w]
        for d in range(1, PASSAGE):
            same = p[:-d] == p[d:]
            if not same.any():
                break
            keys.append(w[:-d][same] * width + w[d:][same])
        yield np.unique(np.concatenate(keys), return_counts=True)
        start = end


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def polarities(graph: DataFrame, words: list[str], toxic: list[str], other: list[str]) -> dict[str, float]:
    """Polarity in [-1, 1] of every word that the walks reach: the two walks' difference over their sum."""
    spark = graph.sparkSession
    number = {w: i for i, w in enumerate(words)}
    bad, good = {number[w] for w in toxic}, {number[w] for w in other}
    seeds = [(i, 1.0 / len(bad) if i in bad else 0.0, 1.0 / len(good) if i in good else 0.0) for i in sorted(bad | good)]
    start = materialise(spark.createDataFrame(seeds, "node long, p double, q double"), "seeds")
    degree = graph.groupBy("a").agg(F.sum("weight").alias("degree"))
    steps = materialise(graph.join(degree, "a").select("a", "b", (F.col("weight") / F.col("degree")).alias("w")), "steps")
    now = start
    for _ in range(STEPS):
        moved = now.withColumnRenamed("node", "a").join(steps, "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("w") * (1 - RESTART)).alias("p"), F.sum(F.col("q") * F.col("w") * (1 - RESTART)).alias("q"))
        again = start.select("node", (F.col("p") * RESTART).alias("p"), (F.col("q") * RESTART).alias("q"))
        now = materialise(moved.unionByName(again).groupBy("node").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "walk")
    reached = now.where("p + q > 0").select("node", ((F.col("p") - F.col("q")) / (F.col("p") + F.col("q"))).alias("polarity"))
    return {words[r["node"]]: r["polarity"] for r in reached.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by Newton's method, with an intercept in front."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(len(w))
    penalty[0, 0] = 1e-6 * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    seeds: frozenset[str]
    fit: list[float]  # intercept; of the seeds' and of the induced words' evidence, in all and by length

    def lexicon(self) -> tuple[dict[str, int], np.ndarray]:
        """Word numbers, and each one's weight as a seed and as an induced word; a last row for all other words."""
        words = sorted(self.weights)
        w = np.zeros((len(words) + 1, 2))
        for i, x in enumerate(words):
            w[i, 0 if x in self.seeds else 1] = self.weights[x]
        return {x: i for i, x in enumerate(words)}, w


def features(texts: list[str | None], tokens: Tokens, lexicon: np.ndarray) -> np.ndarray:
    flat, sizes = tokens.of(texts)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for k in range(2):
        total = np.bincount(of, weights=lexicon[flat, k], minlength=len(sizes))
        out += [np.log1p(total), np.log1p(100 * total / np.maximum(sizes, 1))]
    return np.stack(out, axis=1)


def _score(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(fit[0] + x @ fit[1:], -500, 500)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """``labels`` holds only what may be learned from."""
    sample = materialise(sample_labels(labels, id_col, label_col), "sample")
    sampled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    toxic, other, (n0, n1) = seed_terms(sampled)
    if not toxic:
        p = min(max(n1 / (n0 + n1) if n0 + n1 else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel({}, frozenset(), [math.log(p / (1 - p)), 0.0, 0.0, 0.0, 0.0])
    words = sorted({*toxic, *other, *induced_words(docs, text_col, toxic)})
    found = polarities(word_graph(docs, text_col, words), words, toxic, other)
    # what leans to the toxic side counts; a seed that no walk left keeps its label
    weights = {w: x for w, x in ({w: 1.0 for w in toxic} | found).items() if x > 0}
    model = ToxicityModel(weights, frozenset(toxic), [0.0] * 5)
    index, lexicon = model.lexicon()

    def featured(batches):
        release()
        tokens = Tokens(index)
        for batch in batches:
            x = features(batch.column(0).to_pylist(), tokens, lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), *(pa.array(x[:, k]) for k in range(4))], names=["y", "a", "b", "c", "d"])

    rows = np.array(sampled.select("text", "y").mapInArrow(featured, "y double, a double, b double, c double, d double").collect(), float)
    model.fit = logistic(rows[:, 1:], rows[:, 0]).tolist()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, score). A map over partitions."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon())
    fit = np.array(model.fit)

    def run(batches):
        release()
        tokens = Tokens(sent.value[0])
        for batch in batches:
            for a, b, texts in sliced(batch.column(1), 2 << 20):
                tokens.reset()
                score = _score(features(texts, tokens, sent.value[1]), fit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns kept, nothing shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon())
    fit = np.array(model.fit)
    at = docs.columns.index(text_col)

    def run(batches):
        release()
        tokens = Tokens(sent.value[0])
        for batch in batches:
            for a, b, texts in sliced(batch.column(at).cast(pa.string()), 2 << 20):
                tokens.reset()
                score = _score(features(texts, tokens, sent.value[1]), fit)
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
