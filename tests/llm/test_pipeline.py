import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from tarnweave.llm.bpe import PairIndexBPE, gathered
from tarnweave.llm.exact_dedup import exact_dedup
from tarnweave.llm.mixing import n_words
from tarnweave.llm.near_dedup import near_dedup
from tarnweave.llm.text import learns
from tarnweave.llm.toxicity import fit_toxicity, score_toxicity
from tarnweave.llm.vocabularies import public_vocabulary


def tables(spark, path):
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(300):
        words = rng.choices(plain, k=rng.randint(20, 60))
        if k % 10 == 0:
            words[3], words[7] = "badone", "badtwo"
        rows.append([k, " ".join(words), "en", f"src{k % 4}"])
        labels.append((k, int(k % 10 == 0)))
    rows += [[1000 + k, rows[k][1].replace(" ", "\n"), "en", "src1"] for k in range(1, 60, 3)]  # copies
    rows += [[2000 + k, rows[k][1] + " extra", None, None] for k in range(2, 60, 3)]  # near copies
    rows += [[3000, None, "en", "src0"], [3001, "", "en", "src0"], [3002, "plain " * 20_000, "en", "src2"], [1, rows[1][1], "en", "src1"]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "bpe"]
    held = [docs]
    for name, stage in P.STAGES:
        stage(spark, held[-1], path).write.parquet(f"{path}/out-{name}")
        held.append(spark.read.parquet(f"{path}/out-{name}"))
    assert all(h.columns == docs.columns for h in held[1:-1])
    ids = [sorted(r.doc_id for r in h.select("doc_id").collect()) for h in held]
    model = fit_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet").where(learns(F.col("doc_id"), 4, 2)))
    assert ids[1] == sorted(r.id for r in score_toxicity(docs, model).collect() if r.score < 0.3)
    assert not {k for k in range(0, 300, 10)} & set(ids[1]) and len(ids[1]) >= len(ids[0]) - 60
    assert ids[2] == sorted(r.id for r in exact_dedup(held[1]).collect() if r.kept) and len(set(ids[2])) == len(ids[2])
    assert ids[3] == sorted(r.id for r in near_dedup(held[2]).collect() if r.id == r.component_id)
    assert not [i for i in ids[3] if 1000 <= i < 3000] and {3000, 3001} & set(ids[3])
    # copies repeat whole rows, at most thrice, and the words of all sources stay about the same
    assert max(Counter(ids[4]).values()) <= 3 and set(ids[4]) <= set(ids[3])
    words = [h.agg(F.sum(n_words(F.col("text")))).first()[0] for h in (held[3], held[4])]
    assert words[1] <= words[0] * 1.02
    texts = {r.doc_id: r.text for r in held[4].collect()}
    bpe = PairIndexBPE(public_vocabulary("word_bpe_49k.json"))
    for r in held[5].collect():
        assert bytes(r.ids) == bpe.encode([texts[r.doc_id]])[0][0] and r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4"))
    assert ids[5] == ids[4]


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_encode_sends_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    def counted(batches):
        for batch in batches:
            n = pa.array([batch.num_rows] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([b""] * len(n)), pa.array([""] * len(n))], names=["id", "n_tokens", "ids", "decoded"])

    monkeypatch.setattr(P, "bpe_encode", lambda docs, path: docs.select("id", "text").mapInArrow(counted, "id long, n_tokens long, ids binary, decoded string"))
    docs = spark.range(0, 3000, 1, 1).withColumn("text", F.lit("a b"))
    for set_ in (None, "7"):  # a session that asks for fewer gets fewer, and keeps its setting
        spark.conf.unset(ROWS) if set_ is None else spark.conf.set(ROWS, set_)
        found = [r.n_tokens for r in P.encode(spark, docs, "").collect()]
        assert len(found) == 3000 and max(found) <= (int(set_) if set_ else P.BPE_ROWS) and spark.conf.get(ROWS, None) == set_
    spark.conf.unset(ROWS)


def test_small_batches_fill_slices():
    texts = [None, "", "a", "bb" * 40, "c"] * 20
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 5)), pa.array(texts[k : k + 5], pa.string())], names=["id", "text"]) for k in range(0, 100, 5)]
    put = list(gathered([batches[0].slice(0, 0), *batches], 1, 250))
    assert len(put) == 7 and [x for b in put for x in b.column(0).to_pylist()] == list(range(100))
    assert [x for b in put for x in b.column(1).to_pylist()] == texts
    assert len(list(gathered(batches, 1, 10))) == 20 and not list(gathered([], 1))


def test_release_returns_arrow_memory():
    """In a process of its own: what Arrow's pool no longer uses goes back to the system."""
    code = """
import re
import pyarrow as pa
from tarnweave.llm.worker import release
anon = lambda: sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))
release()
before = anon()
held = [pa.array([b"x" * 100_000] * 40) for _ in range(25)]
assert anon() > before + 60_000
del held
release()
print(anon() - before)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(P.__file__).parent)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) < 60_000
