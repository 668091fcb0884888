"""Language ID by a linear-chain conditional random field over words.

Affix, n-gram and whole-word features score each word in each language, learned transitions join neighbours, and
forward-backward gives every word's language, also in code-switched text. A document's language has the most expected
words; its score is that share.

The model is fitted on SAMPLE_ROWS distinct labelled texts a language, those whose hash is smallest; texts of over
SAMPLE_CHARS characters, of which it takes so many, come after all others. Everything else covers all rows and whole texts.

Defined results: ``und`` with score 0 where a text is null or has no letter, or nothing could be learned; rows are
neither merged nor dropped; only the id, text and label columns are read, and the label only to learn.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnweave.llm.bpe import slices
from tarnweave.llm.crf import Crf, scan, train
from tarnweave.llm.worker import release

SAMPLE_ROWS, SAMPLE_CHARS = 150, 20_000


def fit(docs: DataFrame, learns: Column, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Crf | None:
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    known = docs.where(learns & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(text.alias("text"), lang.alias("lang"))
    known = known.select("lang", (F.length("text") > chars).alias("long"), F.xxhash64("text").alias("h"), F.substring("text", 1, chars).alias("text"))
    # distinct texts are ranked by hashes alone; a limit for each group: partial limits run before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    chosen = known.select("lang", "long", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= rows).drop("rank")
    sample = known.join(F.broadcast(chosen), ["lang", "long", "h"]).groupBy("lang", "long", "h").agg(F.min("text").alias("text")).collect()
    return train(sorted((r["text"], r["lang"]) for r in sample))


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, lang_pred, score). A map over partitions; the model, of fixed size a language, is broadcast."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()  # the broadcast model carries the words it remembers
        crf = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 4 << 20):
                langs, scores = ["und"] * (b - a), [0.0] * (b - a)
                if crf is not None:
                    at, sizes = crf.look_up(texts[a:b])
                    share = scan(crf.known[at], sizes, crf.moves)
                    ends = sizes.cumsum()
                    for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                        if n and crf.lettered[at[end - n : end]].any():
                            best = int(share[k].argmax())
                            langs[k], scores[k] = crf.langs[best], min(1.0, float(share[k][best] / n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def label_words(model: Crf, text: str | None) -> list[tuple[str, str]]:
    """Every word of one text with its most probable language; ``und`` for words without a letter."""
    at, sizes = model.look_up([text])
    if not len(at):
        return []
    best = scan(model.known[at], sizes, model.moves, tokens=True).argmax(axis=1)
    return [(w, model.langs[b] if model.lettered[i] else "und") for w, b, i in zip(text.split(), best, at)]
