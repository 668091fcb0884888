"""A linear-chain conditional random field in NumPy: hashed word features, learned transitions, forward-backward."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Buckets of the hashed features, and positions of a chunk of the scan.
BUCKETS, CHUNK = 1 << 17, 64
REMEMBERED = 300_000

_letters = re.compile(r"[^\W\d_]+")
_U = np.uint64


def core(token: str) -> str:
    """The token's letter runs, each between ``^`` and ``$``; empty where it has no letter."""
    runs = [r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in _letters.findall(token)]
    return "".join([f"^{r}$" for r in runs if r])


def features(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature: n-grams of 2 to 4 letters, with the ends affixes, and the whole word."""
    sizes = np.array([len(c) for c in cores], np.int64)
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    word = np.repeat(np.arange(len(cores)), sizes)
    rows, buckets = [], []

    def add(at: np.ndarray, h: np.ndarray) -> None:
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        rows.append(at)
        buckets.append(((h >> _U(32)) % _U(BUCKETS)).astype(np.int64))

    gram = codes.copy()
    for n in range(2, 5):
        if len(codes) < n:
            break
        gram = gram[:-1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :]
        same = word[: len(gram)] == word[n - 1 :]
        add(word[: len(gram)][same], gram[same] + _U(n))
    if len(codes):
        some = np.flatnonzero(sizes)
        position = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mixed = codes * (_U(0x9E3779B97F4A7C15) ** (position.astype(_U) % _U(64) + _U(1))) ^ (codes << (position % 31).astype(_U))
        add(some, np.add.reduceat(mixed, (np.cumsum(sizes) - sizes)[some]) + _U(99))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # languages x languages, logarithms
    index: dict[str, int] = field(default_factory=dict, repr=False)
    known: np.ndarray | None = field(default=None, repr=False)
    lettered: np.ndarray | None = field(default=None, repr=False)

    def emissions(self, cores: list[str]) -> np.ndarray:
        word, bucket = features(cores)
        w = self.weights[bucket]
        return np.stack([np.bincount(word, weights=w[:, k], minlength=len(cores)) for k in range(len(self.langs))], axis=1)

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all tokens in a row, and how many each text has."""
        if self.known is None or len(self.index) > REMEMBERED:
            self.index = {}
            self.known, self.lettered = np.zeros((0, len(self.langs))), np.zeros(0, bool)
        index, fresh, rows = self.index, [], []
        for t in texts:
            row = []
            for w in t.lower().split() if t else ():
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                    fresh.append(w)
                row.append(i)
            rows.append(row)
        if fresh:
            cores = [core(w) for w in fresh]
            self.known = np.concatenate([self.known, self.emissions(cores)])
            self.lettered = np.concatenate([self.lettered, np.array([bool(c) for c in cores])])
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.array([i for r in rows for i in r], np.int64), sizes


def scan(logits: np.ndarray, sizes: np.ndarray, moves: np.ndarray, tokens: bool = False) -> np.ndarray:
    """Forward-backward over many sequences at once; each one's summed marginals, or every token's.

    Sequences are cut into chunks; the chunks' transfer matrices are multiplied up first, so that very long sequences
    cost no more steps of Python than the number of their chunks.
    """
    k = moves.shape[0]
    step = np.exp(moves - moves.max())
    pot = np.exp(logits - logits.max(axis=1, keepdims=True))
    chunks = -(-sizes // CHUNK)
    doc = np.repeat(np.arange(len(sizes)), chunks)
    first_chunk = np.cumsum(chunks) - chunks
    number = np.arange(len(doc)) - first_chunk[doc]
    start = (np.cumsum(sizes) - sizes)[doc] + number * CHUNK
    length = np.minimum(CHUNK, sizes[doc] - number * CHUNK)
    out = np.zeros((len(logits) if tokens else len(sizes), k))
    if not len(doc):
        return out
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(CHUNK)]
    c = len(order)

    transfer = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for t in range(CHUNK):
        n = active[t]
        if not n:
            break
        now = (transfer[:n].reshape(-1, k) @ step).reshape(n, k, k) * pot[start[:n] + t][:, None, :]
        if t % 4 == 3:
            now /= np.maximum(now.sum(axis=(1, 2), keepdims=True), 1e-300)
        transfer[:n] = now
    where = np.empty(c, np.int64)
    where[order] = np.arange(c)
    before, after = np.full((c, k), 1 / k), np.full((c, k), 1 / k)
    long_first = np.argsort(-chunks, kind="stable")
    counts = chunks[long_first]
    for j in range(1, int(chunks.max())):
        at = first_chunk[long_first[: int(np.searchsorted(-counts, -j, side="left"))]] + j
        v = np.einsum("ci,cij->cj", before[where[at - 1]], transfer[where[at - 1]])
        before[where[at]] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
    for j in range(int(chunks.max()) - 1, 0, -1):
        at = first_chunk[long_first[: int(np.searchsorted(-counts, -j, side="left"))]] + j
        v = np.einsum("cij,cj->ci", transfer[where[at]], after[where[at]])
        after[where[at - 1]] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)

    alphas, v = [], before
    for t in range(CHUNK):
        n = active[t]
        if not n:
            break
        v = (v[:n] @ step) * pot[start[:n] + t]
        v /= np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        alphas.append(v)
    sums = np.zeros((c, k))
    for t in range(len(alphas) - 1, -1, -1):
        n = active[t]
        m = alphas[t] * after[:n]
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        if tokens:
            out[start[:n] + t] = m
        else:
            sums[:n] += m
        w = (pot[start[:n] + t] * after[:n]) @ step.T
        after[:n] = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    if not tokens:
        of = doc[order]
        out = np.stack([np.bincount(of, weights=sums[:, i], minlength=len(sizes)) for i in range(k)], axis=1)
    return out


def train(labelled: list[tuple[str, str]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-6, seed: int = 5) -> Crf | None:
    """Maximum conditional likelihood by Adam, over sequences spliced from texts of different languages.

    Splicing segments of 4 to 60 words makes the code-switched text that the transitions are learned from.
    """
    langs = sorted({lang for _, lang in labelled})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(w, len(index)) for w in t.lower().split()], np.int64) for t, _ in labelled]
    own = np.array([langs.index(lang) for _, lang in labelled])
    cores = [core(w) for w in index]
    word, bucket = features(cores)
    pieces = []
    for row, lang in zip(rows, own):
        at = 0
        while at < len(row):
            n = int(rng.integers(4, 61))
            pieces.append((row[at : at + n], lang))
            at += n
    order = rng.permutation(len(pieces))
    x = np.concatenate([pieces[i][0] for i in order]) if pieces else np.zeros(0, np.int64)
    y = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order]) if pieces else np.zeros(0, np.int64)
    k = len(langs)
    model = Crf(langs, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    if k == 1 or not len(x):
        return model
    sizes = np.full(-(-len(x) // CHUNK), CHUNK)
    sizes[-1] = len(x) - CHUNK * (len(sizes) - 1)
    head = np.arange(len(x)) % CHUNK == 0
    pairs = np.flatnonzero(~head)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (y[pairs - 1], y[pairs]), 1)
    gold = np.stack([np.bincount(x[y == i], minlength=len(index)) for i in range(k)], axis=1).astype(float)
    used, slot = np.unique(bucket, return_inverse=True)
    w = np.zeros((len(used), k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((k, k)), np.zeros((k, k))]
    for r in range(1, rounds + 1):
        emit = np.stack([np.bincount(word, weights=w[slot, i], minlength=len(index)) for i in range(k)], axis=1)
        logits = emit[x]
        marginal = scan(logits, sizes, model.moves, tokens=True)
        expected = np.stack([np.bincount(x, weights=marginal[:, i], minlength=len(index)) for i in range(k)], axis=1)
        # pair marginals, from the token marginals' own messages: forward and backward once more
        grad_moves = gold_moves - _pair_marginals(logits, sizes, model.moves)
        slope = (gold - expected)[word]
        grad = np.stack([np.bincount(slot, weights=slope[:, i], minlength=len(used)) for i in range(k)], axis=1) / len(x)
        for value, g, m, s in ((w, grad - decay * w, state[0], state[1]), (model.moves, grad_moves / len(x) - decay * model.moves, state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            value += rate * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)
    model.weights[used] = w
    return model


def _pair_marginals(logits: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions over sequences of at most CHUNK tokens."""
    k, step = moves.shape[0], np.exp(moves - moves.max())
    pot = np.exp(logits - logits.max(axis=1, keepdims=True))
    n, total = len(sizes), np.zeros((k, k))
    padded = np.ones((n, CHUNK, k))
    padded.reshape(-1, k)[: len(pot)] = pot
    alpha = np.empty((CHUNK, n, k))
    v = np.full((n, k), 1 / k)
    for t in range(CHUNK):
        v = (v @ step) * padded[:, t]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[t] = v
    beta = np.full((n, k), 1 / k)
    for t in range(CHUNK - 1, 0, -1):
        end = padded[:, t] * beta
        joint = alpha[t - 1][:, :, None] * step[None] * end[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        total += joint[t < sizes].sum(axis=0)
        # a sequence that ends before t keeps its flat message
        beta = np.where((t < sizes)[:, None], end @ step.T, beta)
        beta /= beta.sum(axis=1, keepdims=True)
    return total
