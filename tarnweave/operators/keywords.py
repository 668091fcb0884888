"""Key phrases of chunks: boilerplate filter, candidates, document frequencies, scores."""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tarnweave.functions.stopwords import STOPWORDS
from tarnweave.operators.vectors import EPS
from tarnweave.storage import materialise

_STOP = sorted(STOPWORDS)
_STOP_BYTES = frozenset(w.encode() for w in STOPWORDS)
_WORD = re.compile(r"\b[a-zA-Z]{3,}\b")
_TOKEN = re.compile(r"\b[a-zA-Z][a-zA-Z\-]{2,}\b")
_URL = re.compile(r"https?://|www\.|\.com|\.gov|\.org", re.IGNORECASE | re.ASCII)
#: Latin-1: ASCII letters in lower case, other letters, digits and ``_`` as a digit (part of a word, no letter), the rest blank.
_FLAT = bytes(ord(c.lower()) if c.isascii() and c.isalpha() else 48 if c.isalnum() or c == "_" else 32 for c in map(chr, range(256)))
#: Chunks whose words are counted together in memory.
SLICE = 5000
#: Hits of phrases that are scored at a time.
HITS = 50_000


def _words(text: str) -> list[bytes]:
    """Runs of three ASCII letters or more that no other letter, digit or ``_`` touches, in lower case."""
    try:
        flat = text.encode("latin-1")
    except UnicodeEncodeError:
        return [w.lower().encode() for w in _WORD.findall(text)]
    return [w for w in flat.translate(_FLAT).split() if len(w) > 2 and w.isalpha()]


def _tokens(text: str, words: list[bytes]) -> list[bytes]:
    """As ``_words``, with hyphens after the first letter."""
    return [w.lower().encode() for w in _TOKEN.findall(text)] if "-" in text else words


def _candidates(toks: list[bytes]) -> list[bytes]:
    pairs = [a + b" " + b if a < b else b + b" " + a for a, b in zip(toks, toks[1:]) if a not in _STOP_BYTES and b not in _STOP_BYTES]
    return list(dict.fromkeys([w for w in toks if w not in _STOP_BYTES] + pairs))


def _many_urls(text: str) -> bool:
    low = text.lower()
    if "://" in low or "www." in low or ".com" in low or ".gov" in low or ".org" in low:
        return len(_URL.findall(text)) > 3
    return False


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their numbers, by one sort (``np.unique`` hashes, which is far slower on many values)."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.diff(np.append(first, len(key)))


class _Scan:
    """Words of some chunks as numbers, and which chunks aren't boilerplate."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = texts = [t or "" for t in texts]
        self.words = [_words(t) for t in texts]
        ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        size = np.array([len(w) for w in self.words], np.int64)
        code = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(self.words)), np.int64, int(size.sum()))
        chunk, n = np.repeat(np.arange(len(texts)), size), max(1, len(ids))
        stop = np.array([w in _STOP_BYTES for w in ids], bool)
        kept = ~stop[code] if len(code) else np.zeros(0, bool)
        key, count = _distinct(chunk[kept] * n + code[kept])
        top = np.zeros(len(texts), np.int64)
        np.maximum.at(top, key // n, count)
        held = lambda at: np.bincount(at, minlength=len(texts))
        self.good = (size > 0) & (10 * held(chunk[kept]) >= 3 * size) & (held(key // n) >= 20) & (10 * top <= size)
        for i in np.flatnonzero(self.good):
            self.good[i] = not _many_urls(texts[i])
        # phrases know hyphens: those chunks' words are found once more
        again = [i for i in np.flatnonzero(self.good).tolist() if "-" in texts[i]]
        plain = self.good.copy()
        plain[again] = False
        more = [_tokens(texts[i], self.words[i]) for i in again]
        plain = plain[chunk] if len(chunk) else np.zeros(0, bool)
        self.code = np.concatenate([code[plain], np.array([ids[w] for t in more for w in t], np.int64)])
        self.chunk = np.concatenate([chunk[plain], np.repeat(np.array(again, np.int64), [len(t) for t in more])])
        self.names = list(ids)

    def phrases(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(chunk, key, n) of unigrams and bigrams, not yet distinct, whose words have a ``number``, which follows their order.

        A key is ``first * n + second``, numbers counted from 1 and 0 standing for no second word.
        """
        code, chunk, n = number[self.code] if len(self.code) else self.code, self.chunk, int(number.max(initial=-1)) + 2
        one = code >= 0
        two = one[:-1] & one[1:] & (chunk[:-1] == chunk[1:])
        a, b = code[:-1][two] + 1, code[1:][two] + 1
        return np.concatenate([chunk[one], chunk[:-1][two]]), np.concatenate([(code[one] + 1) * n, np.minimum(a, b) * n + np.maximum(a, b)]), n


def is_boilerplate(text: Column) -> Column:
    """T15; null counts as empty."""

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        return pd.Series(np.concatenate([~_Scan(texts[i : i + SLICE]).good for i in range(0, len(texts), SLICE)] or [np.zeros(0, bool)]))

    return test(text)


def candidates(text: Column) -> Column:
    """Distinct unigrams and bigrams without stopwords; a bigram's words are sorted."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[p.decode() for p in _candidates(_tokens(t or "", _words(t or "")))] for t in texts.tolist()], dtype=object)

    return found(text)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Scan, pa.Table]]:
    """``SLICE`` to twice as many chunks at a time, while there are that many, with all their columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * SLICE:
            table = pa.Table.from_batches(held)
            yield _Scan(table.column("text").slice(0, SLICE).to_pylist()), table.slice(0, SLICE)
            held = table.slice(SLICE).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield _Scan(table.column("text").to_pylist()), table


class _Known:
    """A fixed list of phrases and where chunks hold them."""

    def __init__(self, phrases: list[str]) -> None:
        split = [p.encode().split(b" ") for p in phrases]
        words = sorted({w for s in split for w in s})
        self.ids = {w: i for i, w in enumerate(words)}
        self.n = len(words) + 1
        keys = np.array([(self.ids[s[0]] + 1) * self.n + (self.ids[s[1]] + 1 if len(s) > 1 else 0) for s in split], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def hits(self, scan: _Scan) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (chunk, phrase), by chunk; phrases as places in the list."""
        number = np.array([self.ids.get(w, -1) for w in scan.names], np.int64)
        chunk, key, n = scan.phrases(number)
        if not len(self.keys) or not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = key // n * self.n + key % n
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        own = self.keys[at] == key
        both, _ = _distinct(chunk[own] * len(self.keys) + self.order[at[own]])
        return both // len(self.keys), both % len(self.keys)


def phrase_digests(chunks: DataFrame) -> DataFrame:
    """(shadow_id, n_phrases, digest) of the chunks that have phrases; the digest is of the sorted phrases."""
    import hashlib

    schema = pa.schema([("shadow_id", pa.string()), ("n_phrases", pa.int64()), ("digest", pa.string())])

    def run(batches):
        for scan, rows in _slices(batches):
            at = np.flatnonzero(scan.good).tolist()
            found = {i: sorted(p) for i in at if (p := _candidates(_tokens(scan.texts[i], scan.words[i])))}
            digests = [hashlib.md5(b",".join(p)).hexdigest() for p in found.values()]
            yield pa.RecordBatch.from_arrays([rows.column("shadow_id").take(pa.array(list(found), pa.int64())).combine_chunks().cast(pa.string()), pa.array([len(p) for p in found.values()], pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return chunks.select("shadow_id", "text").mapInArrow(run, "shadow_id string, n_phrases long, digest string")


def _local_counts(texts: DataFrame, share: float) -> DataFrame:
    """(phrase, n, floor): each slice's phrases in more than ``floor``, the whole part of ``share``, of its chunks; phrase null: n chunks."""
    schema = pa.schema([("phrase", pa.string()), ("n", pa.int64()), ("floor", pa.int64())])

    def run(batches):
        for scan, _ in _slices(batches):
            n_good, n_words = int(scan.good.sum()), max(1, len(scan.names))
            floor = int(share * n_good)
            # a word in few chunks has no frequent pair
            key, _ = _distinct(scan.chunk * n_words + scan.code)
            df = np.bincount(key % n_words, minlength=n_words)
            names = sorted(w for w, n in zip(scan.names, df.tolist()) if n > floor and w not in _STOP_BYTES)
            rank = {w: i for i, w in enumerate(names)}
            chunk, key, n = scan.phrases(np.array([rank.get(w, -1) for w in scan.names], np.int64))
            key, _ = _distinct(key * len(scan.texts) + chunk)
            key, count = _distinct(key // len(scan.texts))
            key, count = key[count > floor], count[count > floor]
            phrases = [(names[x // n - 1] + (b" " + names[x % n - 1] if x % n else b"")).decode() for x in key.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([None, *phrases], pa.string()), pa.array([n_good, *count.tolist()], pa.int64()), pa.array([floor] * (len(key) + 1), pa.int64())], schema=schema)

    return texts.mapInArrow(run, "phrase string, n long, floor long")


def _known_counts(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, n) of each task's chunks, for a fixed list of phrases."""
    sent = texts.sparkSession.sparkContext.broadcast(phrases)
    schema = pa.schema([("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        known = _Known(sent.value)
        count = np.zeros(len(sent.value), np.int64)
        for scan, _ in _slices(batches):
            count += np.bincount(known.hits(scan)[1], minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([sent.value[i] for i in at], pa.string()), pa.array(count[at])], schema=schema)

    return texts.mapInArrow(run, "phrase string, n long")


#: Phrases that may be frequent, beyond which they are counted by a shuffle of all and not by a broadcast list.
FEW = 1_000_000


def document_frequency(chunks: DataFrame, low: float = 0.001, high: float = 0.30) -> DataFrame:
    """A1 with P11: (phrase, df) within [max(1, int(n * low)), max(1, int(n * high))]; n counts kept chunks.

    Rare phrases aren't shuffled. A phrase in ``low`` of all chunks is in more than nine tenths of that share of one
    slice at least, so that slices name the phrases that may be frequent and a second pass counts these over all
    chunks. Where rounding may hide one (few chunks), or there are too many, all phrases are counted by a shuffle.
    """
    texts = chunks.select("text")
    local = materialise(_local_counts(texts, 0.9 * low), "local")
    n, hidden = local.where("phrase is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("floor"), F.lit(0))).first()
    least, most = max(1, math.floor(n * low)), max(1, math.floor(n * high))
    if not hidden:  # slices gave all their phrases
        counts = local.where("phrase is not null").select("phrase", "n")
    else:
        names = local.where("phrase is not null").select("phrase").distinct()
        few = [r["phrase"] for r in names.limit(FEW + 1).collect()] if hidden < least else None
        if few is not None and len(few) <= FEW:
            counts = _known_counts(texts, few)
        else:
            counts = _local_counts(texts, 0.0).where("phrase is not null").select("phrase", "n")
    df = counts.groupBy("phrase").agg(F.sum("n").alias("df"))
    return df.where(F.col("df").between(least, most)).select("phrase", "df")


def top_keywords(chunks: DataFrame, chunk_vectors: DataFrame, phrase_vectors: DataFrame, k: int = 5) -> DataFrame:
    """Each chunk's ``k`` best phrases by cosine rounded to 4 places, ties by phrase.

    ``chunks``: (shadow_id, text); vectors: (shadow_id, vec), or (vec_id, vec) where chunks have a ``vec_id``, and
    (phrase, vec). The phrases, which ``document_frequency`` bounds, are sent to all tasks; of a chunk only their
    numbers are joined with its vector.
    """
    by = "vec_id" if "vec_id" in chunks.columns and "vec_id" in chunk_vectors.columns else "shadow_id"
    others = ["shadow_id"] + ([by] if by != "shadow_id" else [])
    held = phrase_vectors.where("vec is not null").select("phrase", F.col("vec").cast("array<double>").alias("vec")).orderBy("phrase").toArrow()
    phrases = held.column("phrase").to_pylist()
    matrix = held.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(phrases), -1) if phrases else np.zeros((0, 1))
    sent = chunks.sparkSession.sparkContext.broadcast((phrases, matrix))
    kinds = StructType([*(chunks.schema[c] for c in others), StructField("held", ArrayType(IntegerType()))])
    numbers = to_arrow_schema(kinds)

    def find(batches):
        known = _Known(sent.value[0])
        for scan, rows in _slices(batches):
            chunk, phrase = known.hits(scan)
            ends = np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=rows.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(phrase.astype(np.int32)))
            table = pa.Table.from_arrays([*(rows.column(c) for c in others), pa.chunked_array([lists])], names=[*others, "held"])
            yield from table.cast(numbers).to_batches()

    def best(batches):
        names, vectors = sent.value
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        for batch in batches:
            mine, first = batch.column("held"), 0
            ends = mine.offsets.to_numpy()
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + HITS, "right")) - 1)
                part = batch.slice(first, last - first)
                first = last
                phrase = part.column("held").flatten().to_numpy()
                chunk = np.repeat(np.arange(part.num_rows), np.diff(part.column("held").offsets.to_numpy()))
                if not len(phrase):
                    continue
                vec = part.column("vec").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, -1)
                score = np.einsum("ij,ij->i", vec[chunk], vectors[phrase]) / (np.sqrt((vec * vec).sum(axis=1))[chunk] * norm[phrase] + EPS)
                score = np.round(score, 4)
                order = np.lexsort((phrase, -score, chunk))  # the list is in the phrases' order
                start = np.searchsorted(chunk[order], np.arange(part.num_rows))
                order = order[np.arange(len(order)) - start[chunk[order]] < k]
                yield pa.RecordBatch.from_arrays([part.column("shadow_id").take(pa.array(chunk[order])), pa.array([names[i] for i in phrase[order]], pa.string()), pa.array(score[order])], schema=out)

    out = pa.schema([("shadow_id", to_arrow_schema(kinds).field("shadow_id").type), ("phrase", pa.string()), ("score", pa.float64())])
    found = chunks.select(*others, "text").mapInArrow(find, kinds).join(chunk_vectors.where("vec is not null").select(by, "vec"), by).select("shadow_id", "held", "vec")
    return found.mapInArrow(best, f"shadow_id {chunks.schema['shadow_id'].dataType.simpleString()}, phrase string, score double")
