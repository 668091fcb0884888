"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; the dynamic programme carries each position's best score
and number of pieces, no path. Ties follow the ``tokenizers`` library's unigram model: a later start must score strictly
better, so the longest piece wins; a character without a piece of its own is unknown at 10 under the lowest score, and
neighbouring unknown characters count as one piece.

White space: runs of blanks and the like become one blank, as that model's Metaspace step with splitting sees it; each
word carries the mark of its blank and is cut alone, which is what lets a worker remember words.

The public vocabularies hold no unigram model. From a BPE vocabulary the pieces are taken and scored by Zipf's law over
their ranks: the natural logarithm of 1 / (rank + 1).

Defined results: null, empty and blank texts have 0 tokens; rows are neither merged nor dropped; words of any length
are counted whole; only the id and text columns are read.
"""

from __future__ import annotations

import math
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.llm.bpe import slices
from tarnweave.llm.worker import held

MARK = "▁"
PENALTY = 10.0
REMEMBERED = 400_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file; a BPE model's ranks are scored by Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    names, scores = [sp.id_to_piece(i) for i in kept], [sp.get_score(i) for i in kept]
    if all(s == int(s) for s in scores):  # ranks of a BPE model, not logarithms
        order = sorted(range(len(kept)), key=lambda k: (-scores[k], k))
        for rank, k in enumerate(order):
            scores[k] = math.log(1 / (rank + 1))
    return list(zip(names, scores))


class CountViterbi:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.known: dict[str, int] = {}

    def cut(self, words: list[str]) -> list[int]:
        """Pieces in the best cut of each word; words hold no mark, and each is led by one here.

        One pass of the automaton over all words: no match of a vocabulary whose marks lead its pieces spans two words.
        """
        if len(words) > 1 and (not self.apart or not all(words)):
            return [n for w in words for n in self.cut([w])]
        text = MARK + MARK.join(words)
        n = len(text)
        last, at = bytearray(n), -1
        for w in words:
            at += len(w) + 1
            last[at] = 1
        best, pieces, fused = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        out: list[int] = []
        unknown = self.unknown
        here, score, count, single = 0, -math.inf, 0, False
        # matches come by their ends, the longest (which starts first) before the shorter
        for end, (size, own) in chain(self.automaton.iter(text) if len(self.automaton) else (), ((n, (0, 0.0)),)):
            while here < end:  # the character at ``here`` is done with
                tail = 0
                if not single and best[here] + unknown > score:
                    score, tail = best[here] + unknown, 1
                    count = pieces[here] + (0 if fused[here] else 1)
                if last[here]:
                    out.append(count)
                    score, count, tail = 0.0, 0, 0
                here += 1
                best[here], pieces[here], fused[here] = score, count, tail
                score, count, single = -math.inf, 0, False
            if end == n:
                break
            if size == 1:
                single = True
            now = best[end + 1 - size] + own
            if now > score:
                score, count = now, pieces[end + 1 - size] + 1
        return out

    def words(self, text: str) -> list[str]:
        """Words without their marks; a mark in the text itself starts a word, too."""
        words = text.split()
        if words and MARK in text:
            joined = MARK.join(words)
            words = (joined[1:] if joined[0] == MARK else joined).split(MARK)
        return words

    def totals(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        rows = [self.words(t) if t else [] for t in texts]
        fresh = list({w for r in rows for w in r if w not in known})
        known.update(zip(fresh, self.cut(fresh) if fresh else []))
        return [sum([known[w] for w in r]) for r in rows]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, n_tokens). A map over partitions: no shuffle, two columns read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = held(f"unigram {path}", lambda: CountViterbi(load_pieces(path)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 4 << 20):
                part = texts[a:b]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.totals(part), pa.int64())], names=["id", "n_tokens"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long")
