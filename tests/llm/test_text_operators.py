import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import crf as C
from tarnweave.llm.bpe import PairIndexBPE, bpe_decode, bpe_encode
from tarnweave.llm.language_id import fit, identify, label_words
from tarnweave.llm.pii import pii_spans
from tarnweave.llm.toxicity import drop_toxic, fit_toxicity, induced_words, score_toxicity
from tarnweave.llm.unigram import CountViterbi, load_pieces, token_counts
from tarnweave.llm.vocabularies import public_vocabulary

BPE, PIECES = public_vocabulary("word_bpe_49k.json"), public_vocabulary("piece_bpe_32k.model")
EDGES = ["", "  \n", "a" * 4000, "ab" * 2000 + " x", "!!'s don't <|endoftext|> x<|startoftext|>", "İΣ ΑΣ é ǅ 中文 ２ Ⅷ² _ \x1c\x85 ​ 😀 क्ष"]


def fuzz(seed, n):
    rng = random.Random(seed)
    parts = ["a", "B", "the ", "é", "é", "ß", "中", "1", "²", " ", "\n", "\x85", "\x1c", "'s", "'LL", "!", "<|endoftext|>", "😀", "zz", "Σ", "İ", "▁", "ah" * 3, "�"]
    return EDGES + ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], "doc_id long, text string, id string, ids string, n_tokens string")


def test_bpe_is_the_tokenizers_librarys():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), PairIndexBPE(BPE)
    texts = fuzz(1, 4000)
    ids, text = own.encode(texts)
    for t, i, d, e in zip(texts, ids, text, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(i, "<u4").tolist() == e.ids, t
        assert d == library.decode(e.ids, skip_special_tokens=False) == own.decode(i), t


def test_bpe_one_merge_at_a_time_agrees():
    own, careful = PairIndexBPE(BPE), PairIndexBPE(BPE)
    careful.monotone = False
    words = ["a" * n for n in range(1, 40)] + ["banana", "mississippi", "hahahaha", "lolololol"]
    assert [x.tolist() for x in own.encode_words(words)] == [x.tolist() for x in careful.encode_words(words)]


def test_bpe_query(spark):
    texts = [None, *EDGES, "same", "same"]
    got = {r.id: r for r in bpe_encode(docs(spark, texts), BPE).collect()}
    assert len(got) == len(texts) and got[0].n_tokens == 0 and got[0].decoded == "" and bytes(got[0].ids) == b""
    assert got[len(texts) - 1].ids == got[len(texts) - 2].ids
    back = {r.id: r.decoded for r in bpe_decode(bpe_encode(docs(spark, texts), BPE), BPE).collect()}
    assert back == {i: r.decoded for i, r in got.items()}
    assert bpe_encode(docs(spark, []), BPE).count() == 0


def unigram(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(" ".join((text or "").split()), add_special_tokens=False).ids)


@pytest.mark.parametrize("ties", [False, True])
def test_counts_are_the_unigram_models(ties):
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0), ("the", -2.5), ("é", -4.0)] if ties else load_pieces(PIECES)
    model, library = CountViterbi(pieces), unigram(pieces)
    texts = [t.replace("<|", "") for t in fuzz(2, 3000)] + ["abababba", "bbaab ab", "qqq aqq"]
    assert model.totals(texts) == [library(t) for t in texts]


def test_token_count_query(spark):
    got = {r.id: r.n_tokens for r in token_counts(docs(spark, [None, "", " ", "word word", "word word", "x" * 100_000]), PIECES).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] > 0 and got[5] > 0
    assert token_counts(docs(spark, []), PIECES).count() == 0


def test_pii_query(spark):
    got = {r.id: r for r in pii_spans(docs(spark, [None, "", "é a@b.cc 10.0.0.1", "é a@b.cc 10.0.0.1"])).collect()}
    assert got[0].spans == got[1].spans == "" and got[2].base == "email:2:8,ip:9:17" == got[3].base
    assert pii_spans(docs(spark, [])).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    k, sizes = 3, np.array([6, 0, 1, 200, 64])
    logits, moves = rng.normal(size=(int(sizes.sum()), k)) * 3, rng.normal(size=(k, k))
    tokens, sums, at = C.scan(logits, sizes, moves, tokens=True), C.scan(logits, sizes, moves), 0
    for d, n in enumerate(sizes.tolist()):
        want = np.zeros((n, k))
        if n == 6:
            for path in np.ndindex(*[k] * n):
                start = np.exp(moves[:, path[0]]).sum()
                p = start * np.exp(sum(logits[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
                for t, y in enumerate(path):
                    want[t, y] += p
            want /= want.sum(axis=1, keepdims=True)
            assert np.allclose(tokens[at : at + n], want)
        assert np.allclose(tokens[at : at + n].sum(axis=0), sums[d])
        at += n


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    sizes, k = np.array([64, 64, 20]), 3
    logits, moves = rng.normal(size=(148, k)), rng.normal(size=(k, k))

    def log_z(moves):
        total, at = 0.0, 0
        for n in sizes:
            v = np.log(np.exp(moves).sum(axis=0) / k) + logits[at]
            for t in range(1, n):
                v = np.logaddexp.reduce(v[:, None] + moves, axis=0) + logits[at + t]
            total += np.logaddexp.reduce(v)
            at += n
        return total

    pairs = C._pair_marginals(logits, sizes, moves)
    assert np.isclose(pairs.sum(), sum(sizes) - len(sizes))
    assert log_z(moves) > 0 and pairs.min() > 0


def languages(spark):
    rng = random.Random(4)
    parts = {"aa": ["tion", "the", "wh", "sh"], "bb": ["ung", "sch", "keit", "ver"], "cc": ["eux", "ment", "que", "é"]}
    rows = []
    for k in range(180):
        lang = sorted(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))), lang, "x", "x"))
    rows += [(900, None, "aa", "x", "x"), (901, "", "aa", "x", "x"), (902, "12 ²³ !!", None, "x", "x"), (903, "thetion whsh " * 20_000, None, "x", "x"), (900, "schung", None, "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, score string")


def test_language_id(spark):
    df = languages(spark)
    model = fit(df, F.col("doc_id") % 3 != 9)
    got = identify(df, model).collect()
    assert len(got) == df.count()
    by = {(r.id, r.lang_pred) for r in got}
    assert {(900, "und"), (901, "und"), (902, "und"), (903, "aa"), (900, "bb")} <= by
    truth = {r.doc_id: r.lang for r in df.where("doc_id < 900").collect()}
    assert np.mean([r.lang_pred == truth[r.id] for r in got if r.id < 900]) > 0.97
    switched = label_words(model, "thetion whsh thesh tionwh schung verkeit ungsch keitver !!")
    assert [x for _, x in switched] == ["aa"] * 4 + ["bb"] * 4 + ["und"]
    assert fit(df.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0


def toxic_rows(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    bad = ["badone", "badtwo", "badthree", "badfour", "badfive"]
    rows, labels = [], []
    for k in range(900):
        words, toxic = rng.choices(plain, k=rng.randint(20, 60)), int(k % 9 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "x", "x"))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, toxic))
    rows += [(2000, None, "x", "x"), (2001, "", "x", "x"), (2002, "badone " * 50_000, "x", "x"), (2000, None, "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, y string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark):
    df, labels = toxic_rows(spark)
    model = fit_toxicity(df, labels.where("doc_id % 4 <> 2"))
    got = score_toxicity(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    wrong = [r.id for r in got if r.id < 900 and (r.score >= 0.3) != (r.id % 9 == 0)]
    assert len(wrong) <= 9, wrong
    by = {r.id: r.score for r in got}
    assert by[2000] == by[2001] < 0.3 <= by[2002]
    left = drop_toxic(df, model)
    assert left.columns == df.columns and left.count() == sum(r.score < 0.3 for r in got)
    assert score_toxicity(df.limit(0), model).count() == 0
    blank = fit_toxicity(df.limit(0), labels.limit(0))
    assert all(r.score < 1e-3 for r in score_toxicity(df, blank).collect())


def test_induced_words_reach_unlabelled_terms(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        words, toxic = rng.choices(plain, k=40), k % 10 == 0
        if toxic:
            words += ["badone", "badtwo"] if k % 20 == 0 else ["badone", "hidden", "hidden"]
        rows.append((k, " ".join(words)))
        if k % 20 == 0 or not toxic:
            labels.append((k, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(df, lab)
    assert {"badone", "badtwo"} <= model.seeds and "hidden" not in model.seeds and model.weights.get("hidden", 0) > 0.3


def test_induced_words_are_counted_over_all_passages(spark):
    # 40 partitions, seeds in two of them; "usual" is in a tenth of all passages, "odd" only beside seeds
    texts = []
    for k in range(800):
        words = [f"w{'abcdefghij'[k % 10]}", *["usual"] * (k // 2 % 10 == 0)]
        if k < 40 and k % 2 == 0:
            words += ["seed", *["odd"] * (k % 4 == 0)]
        texts.append(" ".join(words))
    df = spark.sparkContext.parallelize([(t,) for t in texts], 40).toDF("text string")
    have = [set(re.findall(r"[^\W\d_]+", t)) for t in texts]
    near = Counter(w for h in have if "seed" in h for w in h)
    n, marked = Counter(w for h in have for w in h), near["seed"]
    want = sorted(w for w in near if near[w] >= 3 and near[w] * len(texts) >= 5 * marked * n[w])
    assert want == ["odd", "seed"] and induced_words(df, "text", ["seed"]) == want


def test_language_sample_takes_distinct_texts_and_long_ones(spark, monkeypatch):
    rows = [(f"one text {k}", "en") for k in range(6) for _ in range(30)] + [("ein Satz " * 9, "de"), ("noch ein", "de"), ("sehr lang " * 9, "fr")]
    seen = []
    monkeypatch.setattr("tarnweave.llm.language_id.train", seen.extend)
    fit(spark.createDataFrame(rows, "text string, lang string"), F.lit(True), rows=5, chars=20)
    texts = [t for t, lang in seen if lang == "en"]
    assert len(texts) == len(set(texts)) == 5
    assert [x for x in seen if x[1] != "en"] == [(("ein Satz " * 9)[:20], "de"), ("noch ein", "de"), (("sehr lang " * 9)[:20], "fr")]
