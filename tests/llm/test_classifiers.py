import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import language_id, queries, quality, toxicity
from panelmill.llm.linear import platt, sigmoid


def accuracy(spark, sf, name, label):
    found = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    held = [i for i in truth if found[i].held_out]
    return found, np.mean([found[i].predicted == truth[i] for i in held])


def test_quality_on_held_out_rows(spark, sf):
    found, right = accuracy(spark, sf, "op3_quality_classifier", "quality")
    assert right > 0.85
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())


def test_toxicity_on_held_out_rows(spark, sf):
    found, right = accuracy(spark, sf, "op1_toxicity", "toxic")
    assert right > 0.85
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())


def test_language_on_held_out_rows(spark, sf):
    found = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i in truth if found[i].held_out]
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.95


def test_classifiers_take_odd_rows(spark, rich):
    labels = spark.createDataFrame([(3, 1, 0), (-4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for fit, score, label in ((quality.fit, quality.scored, "quality"), (toxicity.fit, toxicity.scored, "toxic")):
        model = fit(rich, labels, "doc_id", "text", label, F.lit(True))
        rows = score(rich, model, ["doc_id"]).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert score(rich.limit(0), model, ["doc_id"]).count() == 0
        empty = fit(rich, labels.limit(0), "doc_id", "text", label, F.lit(True))
        assert score(rich, empty, ["doc_id"]).count() == 8
    kept = quality.accepted(rich, quality.fit(rich, labels, "doc_id", "text", "quality", F.lit(True)))
    assert kept.columns == rich.columns


def test_language_takes_odd_rows(spark, rich):
    models = language_id.fit(rich, "text", "lang", F.lit(True))
    rows = {r.doc_id: r for r in language_id.identify(rich, models, ["doc_id"]).collect()}
    assert rows[1].lang_pred == "und" and rows[1].score == 0 and rows[5].lang_pred == "und" and rows[3].lang_pred == "en"
    none = language_id.fit(rich.limit(0), "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language_id.identify(rich, none, ["doc_id"]).collect()} == {"und"}


def test_models_keep_every_gram_of_a_rare_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CAPACITY", 40, raising=False)  # the former bound, from which rare n-grams went
    common = ["the house stands near the old river and the road"] * 60
    rare = ["kuća stoji blizu stare rijeke"]
    rows = [(t, "en") for t in common] + [(t, "hr") for t in rare]
    models = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", F.lit(True))
    assert models.langs == ["en", "hr"]
    grams = np.unique(np.concatenate([language_id._grams(common[:1])[0], language_id._grams(rare)[0]]))
    assert len(models.orders[0].grams) == len(grams)
    found = language_id.identify(spark.createDataFrame(rows[-1:], "text string, lang string"), models, ["lang"])
    assert found.first().lang_pred == "hr"


def test_language_limits_come_from_all_training_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CALIBRATION_ROWS", 1, raising=False)  # the former sample
    words = {"en": "the house stands near old river road and green hill", "de": "das haus steht nahe am alten fluss und der strasse"}
    rows = [(" ".join(np.random.default_rng(i).permutation(text.split())[: 3 + i % 5]), lang) for lang, text in words.items() for i in range(30)]
    rows += [("12 34", "en"), (None, "de"), ("", "fr")]
    models = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5), "text", "lang", F.lit(True))
    assert models.langs == ["de", "en"]
    seen = [(lang, text) for text, lang in rows[:60]]
    entropies = language_id._entropies(models, [text for _, text in seen])
    truth = np.array([models.langs.index(lang) for lang, _ in seen])
    for i in range(2):
        own = entropies[truth == i, i]
        assert models.limits[i] == pytest.approx(own.mean() + 6 * own.std(), rel=1e-9)
    loss = {}
    for t in (0.5, 1, 2, 4, 8, 16, 32, 64):
        logits = -t * (entropies - entropies.min(axis=1, keepdims=True))
        loss[t] = np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(60), truth])
    assert models.temperature == min(loss, key=loss.get)


def test_kneser_ney_is_a_distribution():
    texts = ["abcab abd", "bcd bca", "abc"]
    keys, n = np.unique(language_id._grams(texts)[0], return_counts=True)
    orders = language_id.kneser_ney(["x"], np.zeros(len(keys), int), keys, n)
    codes = [1, 32, *range(ord("a"), ord("e"))]
    known = np.unique(keys & np.uint64(0xFFFF))
    for context in ((1, 1, 1), (ord("a"), ord("b"), ord("c")), (ord("d"), ord("d"), ord("d"))):
        head = sum(np.uint64(c) << np.uint64(16 * (3 - i)) for i, c in enumerate(context))
        total = np.exp(language_id.scores(orders, np.array([head | np.uint64(c) for c in codes if c in known], np.uint64))).sum()
        unseen = np.exp(language_id.scores(orders, np.array([head | np.uint64(9999)], np.uint64)))[0, 0]
        assert total + unseen == pytest.approx(1, abs=1e-4)


def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(200_000) < 0.2
    chance = [(0.6, 0.02), (0.5, 0.05), (0.4, 0.01), (0.7, 0.1), (0.3, 0.02)]
    votes = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in chance], axis=1)
    votes = np.hstack([votes, votes[:, :1] ^ (rng.random((len(y), 1)) < 0.01)])  # a copy of the first voter
    wide = np.hstack([votes, np.ones((len(y), 1), bool)]).astype(float)
    model = toxicity.label_model(wide.T @ wide, len(y), 0.2)
    assert np.allclose(model.toxic[1:5], [a for a, _ in chance[1:]], atol=0.1)
    assert model.weight[0] < 0.75 and model.weight[5] < 0.75 and model.weight[1:5].min() > 0.9
    assert np.mean((model.posterior(votes.astype(float)) > 0.5) == y) > 0.93


@pytest.mark.parametrize("flips", [0.0, 0.01, 0.05, 0.1, 0.2])
@pytest.mark.parametrize("copies", [1, 2])
def test_label_model_finds_copied_voters(flips, copies):
    rng = np.random.default_rng(int(100 * flips) + copies)
    y = rng.random(200_000) < 0.2
    chance = [(0.6, 0.02), (0.5, 0.05), (0.4, 0.01), (0.7, 0.1), (0.3, 0.02)]
    own = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in chance], axis=1)
    votes = np.hstack([own, *(own[:, :1] ^ (rng.random((len(y), 1)) < flips) for _ in range(copies))])
    wide = np.hstack([votes, np.ones((len(y), 1), bool)]).astype(float)
    model = toxicity.label_model(wide.T @ wide, len(y), 0.2)
    assert np.allclose(model.toxic[:5], [a for a, _ in chance], atol=0.1)
    alike = [0, *range(5, 5 + copies)]
    assert model.weight[alike].max() < 0.85 and model.weight[1:5].min() > 0.9
    if flips < 0.1:
        assert model.weight[alike].sum() < 1.5
    assert np.mean((model.posterior(votes.astype(float)) > 0.5) == y) > 0.93


def test_platt_keeps_order_and_centre():
    margins = np.array([-2.0, -1.5, -1.0, 1.0, 1.5, 2.0])
    slope, offset = platt(margins, np.array([0, 0, 0, 1, 1, 1]))
    p = sigmoid(slope * margins + offset)
    assert (np.diff(p) > 0).all() and p[2] < 0.5 < p[3]


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([0, 1]), np.array([0, 2])]
    w, bias = quality.dual_coordinate_descent(rows, np.ones(3), np.array([1, 0, 1, 0]), 1.0, 50)
    assert w[1] > 0 > w[2] and w[0] + w[1] + bias > 0 > w[0] + w[2] + bias
