"""Classifiers: held-out accuracy on made data, edge cases, and the queries' shape."""

import random
import zlib

import numpy as np
import pytest

from paramscan.llm import langid_gru, quality_gam, toxicity_subword
from paramscan.llm.common import key_mod, stratified

SYLLABLES = {"aa": "ka lo mi tu".split(), "bb": "sch ei nt ung".split(), "cc": "ción os ía que".split()}
ODD = [None, "", " ", "123 456 !!", "é", "ab " * 20000]


def made(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_toxicity_sees_misspellings():
    rng = random.Random(0)
    texts, labels = [], []
    for i in range(600):
        words = made(rng, SYLLABLES["aa"], rng.randrange(20, 80)).split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["horrible", "horribly", "orrible"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity_subword.train(texts, labels)
    assert model.score(made(rng, SYLLABLES["aa"], 30) + " horriblle thing") > 0.5  # never seen
    clean = [model.score(made(rng, SYLLABLES["aa"], 40)) for _ in range(50)]
    assert np.mean(np.array(clean) < 0.5) > 0.9
    assert all(0 <= model.score(t) <= 1 for t in ODD)
    assert toxicity_subword.train([], []).score("x") == 0.5 and toxicity_subword.train(["a"], [1]).score("b") > 0.5


def test_toxicity_in_long_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(SYLLABLES["aa"]) for _ in range(3))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 200) if i % 8 > 1 else 5000)]
        for _ in range(3 if i % 2 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["horrible", "disgusting"]))
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert min(len(t) for i, t, _ in rows if i % 8 < 2) > toxicity_subword.SAMPLE_CHARS
    model = toxicity_subword.fit(df, df, df.doc_id < 300)
    right = [(model.score(t) >= 0.5) == bool(v) for i, t, v in rows if i >= 300 and i % 8 < 2]
    assert len(right) >= 24 and np.mean(right) > 0.9
    only = toxicity_subword.fit(df, df, (df.doc_id < 300) & (df.doc_id % 8 < 2))  # long texts are learned from
    assert only.margin.any()


def test_blocks_cover_every_ngram(monkeypatch):
    text = "Ab cde! fghij—k " * 40
    whole = sorted(np.concatenate(list(toxicity_subword.blocks(text))).tolist())
    monkeypatch.setattr(toxicity_subword, "BLOCK", 37)
    assert sorted(np.concatenate(list(toxicity_subword.blocks(text))).tolist()) == whole


def test_language_network(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, SYLLABLES[k], 40), k, "n") for i, k in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000 + i, t, None, None) for i, t in enumerate([*ODD, "½ ²", "Ⅷ ٣ ①", "日本語"])]
    rows += rows[:40] + [(None, "x", "aa", "null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    net = langid_gru.fit(df, key_mod(df.doc_id, 5) != 0)
    out = langid_gru.with_language(df.drop("lang"), net)
    assert out.columns == ["doc_id", "text", "language"] and out.count() == len(rows)
    found = {r.doc_id: r.language for r in out.collect()}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[2]]
    assert held and all(found[r[0]].lang_pred == r[2] for r in held)
    no_letter = [found[1000 + i] for i in (0, 1, 2, 3, 6, 7)]
    assert [tuple(x) for x in no_letter] == [("und", 0.0)] * 6 and "und" not in (found[1005].lang_pred, found[1008].lang_pred)
    assert all(0 <= x.score <= 1 for x in found.values())
    assert langid_gru.fit(df.filter("lang is null"), key_mod(df.doc_id, 5) != 0) is None
    assert langid_gru.with_language(df, None).filter("language.lang_pred != 'und'").isEmpty()
    assert langid_gru.with_language(df.limit(0), net).count() == 0 and langid_gru.fit(df.limit(0), df.doc_id > 0) is None


def test_backpropagation_equals_differences():
    net = langid_gru.Network.fresh(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = np.frombuffer(b"\0abcde\0\0fg hi\0", np.uint8).reshape(2, 7).T
    wanted = np.array([0, 1])
    weight = (x > 0) * 0.5

    def loss():
        return -(np.log(net.positions(x)[1][:, np.arange(2), wanted]) * weight).sum()

    grads = net.gradients(x, wanted, weight)
    for name, at in (("fx", (ord("b"), 3)), ("fu", (2, 17)), ("bu", (1, 30)), ("bx", (ord("d"), 5)), ("fx", (ord("a"), 29)), ("bx", (0, 2)), ("v", (3, 1)), ("c", (0,))):
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-4
        up = loss()
        net.weights[name][at] = old - 1e-4
        down = loss()
        net.weights[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-4, abs=1e-8)


def slow_language(net, text):
    """Plain form: both recurrences over the whole text with its zero bytes, each position labelled, then the mean."""
    data = (text or "").lower().encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    zeros = b"\0" * langid_gru.LEAD
    x = np.frombuffer(zeros + data + zeros, np.uint8)[:, None]
    p = net.positions(x)[1][langid_gru.LEAD : -langid_gru.LEAD, 0].mean(axis=0)
    return net.languages[int(p.argmax())], float(p.max())


def test_windows_label_every_position(monkeypatch):
    rng = random.Random(2)
    trained = [(made(rng, SYLLABLES[k], 30), k) for k in list(SYLLABLES) * 30]
    net = langid_gru.train([t for t, _ in trained], [k for _, k in trained], steps=60)
    texts = [made(rng, SYLLABLES[k], n) for k in SYLLABLES for n in (1, 5, 40)] + ["x" * 100, None, "", "½", "é, 12! Ü\n" * 60, "日本" * 300, "a" + " " * 700 + "ción"]
    want = [slow_language(net, t) for t in texts]
    for span, cells in ((512, 1 << 21), (64, 1 << 21), (64, 1)):
        monkeypatch.setattr(langid_gru, "CELLS", cells)
        monkeypatch.setattr(langid_gru, "SPAN", span)
        got = net.read(texts)
        # recurrences that begin 24 bytes before a window are as good as those from the text's end
        assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([b for _, b in got], [b for _, b in want], atol=0.02)
    monkeypatch.undo()
    short = [t for t in texts if t and len(t.encode()) <= 64]
    exact = [slow_language(net, t) for t in short]
    assert short and np.allclose([b for _, b in net.read(short)], [b for _, b in exact], atol=1e-5)
    assert sum(n for n, _ in langid_gru.windows(b"x" * 1300)) == 1300 and all((len(d) - 2 * langid_gru.LEAD) % langid_gru.STEP == 0 for _, d in langid_gru.windows(b"x" * 1300))


def test_quality_model(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        text = made(rng, SYLLABLES["aa"], rng.randrange(20, 120))
        good = i % 3 > 0
        rows.append((i, text if good else " ".join(w + "%%" for w in text.split())))
        labels.append((i, int(good), "x"))
    rows += [(2000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(None, 1, "x"), (5000, None, "x")], "doc_id long, quality int, text string")
    model = quality_gam.fit(docs, marked, key_mod(marked.doc_id, 3) != 1)
    found = {r.doc_id: r.quality_score for r in quality_gam.with_score(docs, model).collect()}
    held = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(found[i] >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert all(0 <= v <= 1 for v in found.values()) and len(found) == len(rows)
    assert quality_gam.with_score(docs.limit(0), model).count() == 0


def test_quality_pairs_catch_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(quality_gam.FEATURES)))
    x[:, 0], x[:, 1] = rng.random(3000), rng.random(3000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)  # nothing in either feature alone
    model = quality_gam.train(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and np.mean((model.score(x[2000:]) >= 0.5) == y[2000:]) > 0.9


def test_stratified_is_bounded_and_stable(spark):
    df = spark.range(20000).selectExpr("id", "case when id % 10 = 0 then 'rare' else 'common' end as k")
    one = stratified(df, "id", "k", 500)
    counts = {r.k: r["count"] for r in one.groupBy("k").count().collect()}
    assert all(350 < n < 650 for n in counts.values()) and sorted(map(tuple, one.collect())) == sorted(map(tuple, stratified(df.repartition(5), "id", "k", 500).collect()))
