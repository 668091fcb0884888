"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a slice of a partition form one array of symbols. An index maps every mergeable pair to all its
positions; ranks are taken in ascending order, each merges all its occurrences at once, and only the lists of the pairs
beside them are updated. Pieces between white space that a worker knows already are not encoded again.

It gives what the ``tokenizers`` library gives for a vocabulary file of kind "BPE with word ends" (NFC, lower case,
white space dropped, byte level): ids without special tokens added, and the tokens joined by blanks as decoded text.

Defined results: null and empty texts have no ids and decode to the empty text; rows are neither merged nor dropped, so
repeated rows give repeated results; very long texts and words are encoded whole; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnweave.llm.worker import held

#: Text of one slice whose words are indexed together, and words that a worker remembers.
SLICE_CHARS = 2 << 20
REMEMBERED = 100_000

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_blank = re.compile(f"[{_SPACE}]+")
#: Control characters that str.split() takes for white space and the pre-tokenizer doesn't.
_control = re.compile("[\\x1c-\\x1f]")
_wide = re.compile("[^\\x00-\\xff]")
#: The pre-tokenizer's pattern for lower-case Latin-1.
_narrow = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff]+|[0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]|[^\\t-\\r 0-9a-z\\xaa\\xb2\\xb3\\xb5\\xb9\\xba\\xbc-\\xbe\\xdf-\\xf6\\xf8-\\xff\\x85\\xa0]+")


@lru_cache(maxsize=1)
def _splitter() -> re.Pattern:
    """The pre-tokenizer's pattern with its Unicode classes spelled out, which ``re`` matches by table."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = ranges.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            if kind and kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class PairIndexBPE:
    """Encodes distinct words in bulk; one object a worker and vocabulary."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        self.width = max(self.tokens) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        self.pair = key
        # where a rank can't activate a lower one, all occurrences of a rank may merge at once
        born: dict[int, int] = {}
        for r, c in enumerate(made.tolist()):
            born[c] = max(r, born.get(c, -1))
        self.monotone = all(born.get(vocab[x], -1) < r for r, p in enumerate(pairs) for x in p)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.index: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.text: list[str] = []

    def words(self, token: str) -> list[str]:
        """Pre-tokenized words of a piece of lower-case text without white space."""
        return (_splitter() if _wide.search(token) else _narrow).findall(token)

    def tokens_of(self, text: str) -> list[str]:
        """Pieces between white space, in lower case; an added token stands as itself behind a blank."""
        if self.split_added is not None and "<|" in text and self.split_added.search(text):
            out: list[str] = []
            for k, part in enumerate(self.split_added.split(text)):
                out += [" " + part] if k % 2 else self.tokens_of(part)
            return out
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma: letter by letter
        return _blank.sub(" ", text).split(" ") if _control.search(text) else text.split()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        n = len(sym)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - size] = -1
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            key = sym[at] * self.width + sym[nxt[at]]
            i = np.searchsorted(self.key, key)
            i[i == len(self.key)] = 0
            ok = np.flatnonzero(self.key[i] == key)
            if not len(ok):
                return
            at, rank = at[ok], self.rank[i[ok]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for a, b in zip(cuts, cuts[1:]):
                r = int(rank[a])
                if r in lists:
                    lists[r].append(at[a:b])
                else:
                    lists[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            left, right = divmod(int(self.pair[r]), self.width)
            follow = nxt[at]
            ok = (sym[at] == left) & (follow >= 0)
            ok &= sym[follow] == right
            at = at[ok]
            if not len(at):
                continue
            if left == right or not self.monotone or len(found) > 1:
                at = np.unique(at)
            if not self.monotone:  # one merge a word, then look again
                _, first = np.unique(owner[at], return_index=True)
                rest = np.delete(at, first)
                at = at[first]
                if len(rest):
                    lists[r] = [rest]
                    heapq.heappush(heap, r)
            elif left == right and len(at) > 1:
                # in a run of overlapping pairs every second one merges, from the left
                fresh = np.ones(len(at), bool)
                fresh[1:] = nxt[at[:-1]] != at[1:]
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            sym[gone] = -1
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            beside = np.concatenate([at[has], before[before >= 0]])
            if len(beside):
                if len(at) > 1:
                    beside = np.unique(beside)
                note(beside)
        keep = sym >= 0
        return sym[keep], np.bincount(owner[keep], minlength=len(words))

    def learn(self, tokens: list[str]) -> None:
        made = [[t] if t[:1] == " " else self.words(t) for t in tokens]
        plain = list({w for t, ws in zip(tokens, made) if t[:1] != " " for w in ws})
        ids, sizes = self.encode_words(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        raw, at = ids.astype("<u4").tobytes(), 0
        names = [self.tokens[i] for i in ids.tolist()]
        coded = {" " + name: (np.array([i], "<u4").tobytes(), name) for name, i in self.added.items()}
        for w, k in zip(plain, sizes.tolist()):
            coded[w] = (raw[4 * at : 4 * (at + k)], " ".join(names[at : at + k]))
            at += k
        for ws in made:
            both = [coded[w] for w in ws]
            self.ids.append(b"".join([x[0] for x in both]))
            self.text.append(" ".join([x[1] for x in both]) if both else None)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        if len(self.index) > REMEMBERED:
            self.index, self.ids, self.text = {}, [], []
        index, fresh, docs = self.index, [], []
        for text in texts:
            row = []
            for w in self.tokens_of(text) if text else ():
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                    fresh.append(w)
                row.append(i)
            docs.append(np.array(row, np.int32))
        if fresh:
            self.learn(fresh)
        ids, names = self.ids, self.text
        out_ids, out_text = [], []
        for row in docs:
            row = row.tolist()
            out_ids.append(b"".join([ids[i] for i in row]))
            out_text.append(" ".join([t for i in row if (t := names[i]) is not None]))
        return out_ids, out_text

    def decode(self, ids: bytes) -> str:
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.tokens])


def coder(path: str) -> PairIndexBPE:
    return held(f"bpe {path}", lambda: PairIndexBPE(path))


def sliced(column: pa.Array, size: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of about ``size`` bytes with their texts, of which only one range's are Python strings at a time."""
    start, held, ends = 0, 0, pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for k, n in enumerate(ends):
        if held and held + n > size:
            yield start, k, column.slice(start, k - start).to_pylist()
            start, held = k, 0
        held += n
    if start < len(column):
        yield start, len(column), column.slice(start).to_pylist()


def gathered(batches: Iterable[pa.RecordBatch], at: int, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to about ``size`` bytes of column ``at``, so that slices fill whatever the batches' rows."""
    parts, held = [], 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(at))).as_py() or 0
        if parts and held + n > size:
            yield pa.concat_batches(parts)
            parts, held = [], 0
        parts.append(batch)
        held += n
    if parts:
        yield pa.concat_batches(parts)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``chars`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > chars:
            yield start, k
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, n_tokens, ids, decoded): ``ids`` are little-endian unsigned 32-bit integers in one binary.

    A map over partitions: no shuffle, nothing but the two columns is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = coder(path)
        for batch in gathered(batches, 1):
            for a, b, texts in sliced(batch.column(1)):
                ids, text = bpe.encode(texts)
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")


def bpe_decode(coded: DataFrame, path: str) -> DataFrame:
    """(id, decoded) from (id, ids); ids that the vocabulary lacks are passed over, null ids decode to the empty text."""
    kind = coded.schema["id"].dataType.simpleString()

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            text = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "decoded"])

    return coded.select("id", "ids").mapInArrow(run, f"id {kind}, decoded string")
