"""Language and quality classifiers and the language model on small made tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scorelake.llm import language_id, language_model, quality

LETTERS = {"aa": "abcde", "xx": "vwxyz", "öö": "äöüßé"}


def _text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 7))) for _ in range(n))


def _docs(spark):
    rows = [(i, _text(lang, 5 + i % 60, i), lang, "clash") for i, lang in enumerate(list(LETTERS)[i // 3 % 3] for i in range(180))]
    rows += [(900, None, "aa", ""), (901, "", "xx", ""), (902, "12 -- 7", "xx", ""), (903, _text("aa", 3, 1), None, ""), (None, _text("aa", 9, 2), "aa", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string").repartition(3)


def test_language(spark):
    docs = _docs(spark)
    model = language_id.fit(docs.where("doc_id % 3 <> 1"))
    twice = docs.unionByName(docs.where("doc_id = 5"))
    out = language_id.identify(twice, model)
    assert [c.lower() for c in out.columns].count("score") == 1
    rows = out.collect()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {900, 901, 902} == {r.doc_id for r in rows if r.rejected}
    same = [r for r in rows if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_language_rejects_what_is_far(spark):
    docs = _docs(spark)
    model = language_id.fit(docs.where("lang <> 'xx'"))
    far = language_id.identify(spark.createDataFrame([(1, _text("xx", 40, 1))], "doc_id long, text string"), model)
    assert far.first().rejected


_OTHERS = (
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
)


def test_language_rejects_noise_and_unlearned_languages_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language_id.fit(docs.where(fold != 1))
    held = language_id.identify(docs.where(fold == 1).where("lang IS NOT NULL AND text IS NOT NULL"), model)
    clean, wrong, n = held.agg(F.sum(F.col("rejected").cast("int")), F.sum((F.col("lang") != F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert clean <= 0.01 * n and wrong <= 0.02 * n
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.choice((5, 20, 100, 300)))) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate([*noise, *_OTHERS])]
    assert all(r.rejected for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())


def test_language_needs_letters(spark):
    docs = _docs(spark)
    model = language_id.fit(docs)
    rows = [(1, "²½ Ⅷ ¾"), (2, "12_3"), (3, "ª"), (4, "ab " * 200000 + "é")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred == "und" for i in (1, 2, 3, 4)] == [True, True, False, False]


def test_nothing_to_learn(spark):
    docs = _docs(spark)
    model = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scores = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert {r.score for r in scores} == {0.0, 0.5}
    assert language_id.identify(docs.where("false"), model).collect() == []


def test_quality(spark):
    good = lambda i: " ".join(w.capitalize() + "." if k % 6 == 0 else w for k, w in enumerate(_text("aa", 30 + i % 50, i).split()))
    bad = [lambda i: " | ".join(_text("xx", 40, i).split()), lambda i: _text("aa", 20, i).upper().replace(" ", "!! "), lambda i: "spam " * 60]
    rows = [(i, good(i) if i % 2 else bad[i // 6 % 3](i), "x") for i in range(400)] + [(900, None, "x"), (901, " ", "x"), (None, good(1), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (None, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs.where("doc_id % 3 <> 1"), labels)
    out = quality.classify(docs, model).collect()
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 1]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.score for r in out if r.doc_id in (900, 901)} == {900: 0.0, 901: 0.0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    half = quality.fit(docs.where("doc_id % 3 <> 1"), labels, sample_rows=60)
    assert 20 <= len(half.labels) <= 130


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    sims, labels = rng.uniform(-1, 1, (20, 50)), rng.integers(0, 2, 50).astype(float)
    for row, got in zip(sims, quality.votes(sims, labels, 7, 3.0), strict=True):
        near = sorted(range(50), key=lambda i: -row[i])[:7]
        weights = [math.exp((row[i] - 1) * 3.0) for i in near]
        assert math.isclose(got, sum(w * labels[i] for w, i in zip(weights, near, strict=True)) / sum(weights))


def test_language_model(spark):
    rows = [(i, _text(lang, 5 + i % 60, i), "x") for i, lang in enumerate(list(LETTERS) * 40)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "Abc abc", "x"), (5, rows[5][1], "x"), (902, "never seen Words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    training = docs.where("doc_id IS NOT NULL AND doc_id <> 902")
    model = language_model.fit(training)
    got = language_model.score(docs, model).collect()
    tokens = lambda t: [*(t or "").lower().split(), None]
    counts = Counter(x for i, t, _ in rows if i not in (None, 902) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
    want = sorted((i or -1, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(base(t), 6)) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_scores_equal_a_plain_computation(spark):
    texts = [_text(lang, 1 + i % 50, i) for i, lang in enumerate(list(LETTERS) * 30)] + ["", None, "never seen words", "word " * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = language_model.fit(docs.where("doc_id % 7 <> 0 AND text <> 'never seen words'"))
    p, counts = model.parameters, Counter({bytes(r.token): r.c for r in spark.read.parquet(model.counts).collect()})
    own = {t: int(k) for t, k in zip(model.heavy.tokens, model.heavy.classes, strict=True) if t in model.heavy.own}

    def plain(text):
        words, total = [*language_model.tokens_of(text), language_model.END], 0.0
        ids = [language_model.END_CLASS if w == language_model.END else own.get(w, language_model.tail_class(w)) for w in words]
        for at, (word, k) in enumerate(zip(words, ids, strict=True)):
            before = [ids[at - 1 - j] if at > j else language_model.END_CLASS for j in range(language_model.CONTEXT)]
            scores = sum(p.context[b] * p.position[j] for j, b in enumerate(before)).astype(np.float64) @ p.output.T + p.bias
            total += (scores[k] - np.log(np.exp(scores).sum())) / math.log(10)
            if k >= language_model.CLASSES - language_model.TAIL_CLASSES:
                mass, kinds = model.class_tokens[k], model.class_distinct[k]
                total += math.log10((counts[word] + 0.1) / (mass + 0.1 * (kinds + 1)))
        return total

    got = {r.doc_id: r.score for r in language_model.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        if i % 5 == 0 or i >= len(texts) - 4:
            assert math.isclose(got[i], plain(text), rel_tol=1e-4, abs_tol=1e-3), (i, got[i], plain(text))


def test_language_model_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert language_model.score(none, language_model.fit(some)).collect() == []
    got = language_model.score(some, language_model.fit(none)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_sums_by_class():
    rng = np.random.default_rng(4)
    rows, classes = rng.standard_normal((700, 5)).astype(np.float32), rng.integers(0, 90, (700, 2)).astype(np.int16)
    want = np.zeros((2, language_model.CLASSES, 5))
    for j in range(2):
        np.add.at(want[j], classes[:, j], rows)
    assert np.allclose(language_model._by_class(rows, classes), want, atol=1e-4)


def test_every_position_is_trained_on(spark, monkeypatch):
    weights, summed = [], language_model.summed
    monkeypatch.setattr(language_model, "summed", lambda *a: weights.append(summed(*a)) or weights[-1])
    docs = spark.createDataFrame([(i, _text("aa", 3 + i, i)) for i in range(40)], "doc_id long, text string").repartition(3)
    model = language_model.fit(docs)
    assert [w["p"] for _, w in weights] == [model.tokens] * language_model.ROUNDS


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, _text("aa", 30, i)) for i in range(30)], "doc_id long, text string")
    model = language_model.fit(docs)
    contexts = np.random.default_rng(0).integers(0, language_model.CLASSES, (9, language_model.CONTEXT))
    every = np.exp(np.stack([model.parameters.log_probabilities(contexts, np.full(9, k)) for k in range(language_model.CLASSES)]))
    assert np.allclose(every.sum(axis=0), 1, atol=1e-4)
    for k in range(language_model.CLASSES - language_model.TAIL_CLASSES, language_model.CLASSES):
        mass, kinds = model.class_tokens[k], model.class_distinct[k]
        assert math.isclose((mass + 0.1 * kinds + 0.1) / (mass + 0.1 * (kinds + 1)), 1)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    shares = np.full(language_model.CLASSES, 1 / language_model.CLASSES)
    sequence = np.tile(np.array([1, 2, 3, 4, 5], np.int16), 2000)
    contexts, targets = language_model._windows(sequence)
    p = language_model.Parameters.first(shares)
    before, state = p.log_probabilities(contexts, targets).mean(), None
    for _ in range(300):
        rows = rng.integers(0, len(targets), 256)
        state = language_model.train(p, contexts[rows], targets[rows], shares, state)
    assert p.log_probabilities(contexts, targets).mean() > before + 2


def test_tail_class_is_the_same_in_spark(spark):
    words = [b"a", b"ab", b"abcdef", "naïve".encode()]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "token binary")
    got = [r[0] for r in df.select(language_model._tail_class(df["token"])).collect()]
    first = language_model.CLASSES - language_model.TAIL_CLASSES
    assert got == [language_model.tail_class(w) for w in words] == [first + zlib.crc32(w[-3:]) % language_model.TAIL_CLASSES for w in words]


def test_words_of_many_texts_and_their_classes():
    texts = ["", None, " a  B\tc\x0b\x0cd\r\n", "É\x1cx y", "oneword", "ab bc", "  "]
    split = [language_model.tokens_of(t) for t in texts]
    words, starts = language_model.split(pa.array(["before", *texts]).slice(1))
    assert [words.to_pylist()[i:j] for i, j in zip(starts, starts[1:])] == split  # noqa: B905
    heavy = language_model.Heavy([b"c", language_model.END, b"ab"], np.array([3, 2, 1]))
    places, classes = heavy.class_ids(words)
    flat = [w for one in split for w in one]
    assert places.tolist() == [heavy.tokens.index(w) if w in heavy.tokens else -1 for w in flat]
    assert classes.tolist() == [heavy.classes[p] if p >= 0 else language_model.tail_class(w) for p, w in zip(places, flat)]  # noqa: B905


def test_words_of_a_block_inside_a_batch():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("Été", "aB", "ß", "xyz", "日本")) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    column, found = pa.array(texts), []
    blocks = list(language_model._blocks(column, 2000))
    for at, taken in blocks:
        words, starts = language_model.split(column.slice(at, taken))
        found += [words.to_pylist()[i:j] for i, j in zip(starts, starts[1:])]  # noqa: B905
    assert len(blocks) > 2 and found == [language_model.tokens_of(t) for t in texts]
