import math
import random
import re
import zlib

import numpy as np
import pytest

from rowmesh.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_sentences_cover_the_text():
    text = "One. Two two!\n\n Three? ... four"
    assert [text[a:b] for a, b in T.sentences(text)] == ["One", " Two two", " Three", " four"]
    assert T.sentences(None) == T.sentences("") == T.sentences(" .\n") == []


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta trust stupor idea clone".split()) for _ in range(8)) + "."
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        text = " ".join(clean() for _ in range(rng.randint(1, 12)))
        rows.append((i, f"{text} You {rng.choice(['stupid', 'worthless'])}, gamma! {clean()}" if bad else text, int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1), (None, 1)], "doc_id bigint, toxic int")
    return rows, docs, T.train(docs, labels)


def test_learns_words_and_locates_sentences(spark, model):
    rows, docs, fitted = model
    got = {r.id: r for r in T.score(docs, fitted).collect()}
    for i, text, y in rows:
        assert (got[i].score >= T.THRESHOLD) == bool(y)
        if y:
            assert [text[s["start"] : s["end"]].strip().split()[0] for s in got[i].offending] == ["You"]
        else:
            assert got[i].offending == []


def test_scores_in_memory(spark, model):
    """The noisy-or of the sentences, each the logistic of its distinct words' features, over all documents."""
    rows, docs, fitted = model
    got = {r.id: r for r in T.score(docs, fitted).collect()}
    for i, text, _ in rows:
        clean, offending = 1.0, []
        for sentence in filter(str.strip, re.split(r"[.!?\n]+", text)):
            words = {re.sub(r"^\W+|\W+$", "", w) for w in sentence.lower().split()} - {""}
            evidence = sum(fitted.weights.get(f, 0.0) for w in words for f in {w[:n] for n in (4, 5, 6, 7, 8) if n < len(w)} | {w + "$"})
            p = 1 / (1 + math.exp(-fitted.bias - evidence))
            clean *= 1 - p
            offending += [sentence] if p >= 0.3 else []
        odds = (1 - clean) / clean * (0.7 / 0.3) ** 2
        assert got[i].score == pytest.approx(odds / (1 + odds), abs=1e-9) and [text[s["start"] : s["end"]] for s in got[i].offending] == offending


def test_the_fit_lowers_the_loss_of_the_noisy_or(model):
    """Against the gradient by differences: no small step of bias or of a weight lowers the penalised loss by a twentieth."""
    rng = random.Random(4)
    docs = [([sorted({rng.choice(["bad", "good", "plain"]) for _ in range(2)}) for _ in range(rng.randint(1, 3))], rng.randint(0, 3)) for _ in range(200)]
    labels = [int(any("bad" in s for s in x)) for x, _ in docs]

    def loss(bias, weights):
        total = T.PULL * sum(weights.values())
        for (found, plain), y in zip(docs, labels, strict=True):
            clean = (1 - 1 / (1 + math.exp(-bias))) ** plain
            for s in found:
                clean *= 1 - min(1 / (1 + math.exp(-bias - sum(weights.get(f, 0) for w in s for f in T.features(w)))), 1 - 1e-12)
            total -= math.log(max(1e-9, 1 - clean if y else clean))
        return total

    kept = ["bad$", "good$", "plain$"]
    fitted = T.fit(docs, np.array(labels), kept)
    base = loss(fitted.bias, fitted.weights)
    assert base < 0.5 * loss(-6.0, {}) and fitted.weights["bad$"] > 5 * max(fitted.weights.get("good$", 0), fitted.weights.get("plain$", 0))
    for f in kept:
        for step in (-0.05, 0.05):
            assert loss(fitted.bias, fitted.weights | {f: max(0.0, fitted.weights.get(f, 0) + step)}) > 0.95 * base
    assert min(loss(fitted.bias + step, fitted.weights) for step in (-0.05, 0.05)) > 0.95 * base


def test_odd_texts(spark, model):
    fitted = model[2]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "idea " * 60_000), (None, "You stupid!"), (4, "STUPID, stupid stupid"), (4, "alpha")], "doc_id bigint, text string")
    got = [(r.id, r.score) for r in T.score(df, fitted).collect()]
    assert all(0 <= s <= 1 for _, s in got) and [s for i, s in got if i in (1, 2)] == [0.0, 0.0]
    assert [s >= 0.5 for i, s in got if i is None] == [True] and sorted(s >= 0.5 for i, s in got if i == 4) == [False, True]
    assert T.score(df.where("false"), fitted).count() == 0


def test_without_labels_or_with_one_label(spark, model):
    docs = model[1]
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score < 0.1 for r in T.score(docs.limit(5), T.train(docs, none)).collect())
    assert T.train(docs.where("false"), none).weights == {}


def test_held_out_accuracy(spark):
    """Over the third of the labelled documents that the fit never saw."""
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = T.query(spark, SF).drop("offending").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    test = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hits, wrong = sum(p and y for _, p, y in test), sum(p and not y for _, p, y in test)
    assert wrong <= 0.01 * len(test) and hits >= 0.9 * sum(y for *_, y in test)
    order = sorted(test)
    ranks = [k for k, (_, _, y) in enumerate(order) if y]
    n1, n0 = len(ranks), len(test) - len(ranks)
    assert (sum(ranks) - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.95
