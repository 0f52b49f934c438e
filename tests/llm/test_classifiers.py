import random

import numpy as np

from pyspark.sql import functions as F

from quillframe.llm import _fit, language_id, toxicity


def test_language_id(spark):
    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "ung", "der", "ö"], "fr": ["eau", "que", "é", "les"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, rng.randint(3, 60)), lang, "x") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en", "x"), (901, "12 34 !", "de", "x"), (902, "", None, "x"), (903, "the whing", None, "x"), (None, "schung", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fitted_on(df)
    assert model.languages == ["de", "en", "fr"] and 0 <= model.threshold <= 0.5
    out = {r["doc_id"]: r for r in language_id.predict_language(df, model).collect()}
    assert len(out) == len(rows)
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang, _ in rows[:180]]) > 0.97
    for i in (900, 901, 902):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) == ("und", 0.0, True)
    assert out[903]["lang_pred"] == "en" and out[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = language_id.predict_language(df, model, added=("a", "b", "c"))
    assert kept.columns == [*df.columns, "a", "b", "c"]
    assert language_id.predict_language(df.limit(0), model).count() == 0
    nothing = language_id.fitted_on(df.filter("lang is null"))
    assert {r["lang_pred"] for r in language_id.predict_language(df, nothing).collect()} == {"und"}


def sentences(n, seed):
    rng = random.Random(seed)
    filler = [f"n{i}" for i in range(300)]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(filler) for _ in range(rng.randint(5, 40))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "scum", "rotten"]))
        # a group is named far more often in toxic text, which a plain classifier would learn
        if rng.random() < (0.7 if toxic else 0.1):
            words.insert(rng.randrange(len(words)), "muslim")
        out.append((" ".join(words), int(toxic)))
    return out


def test_identity_terms_carry_no_weight():
    buckets = toxicity.Buckets()

    def rows(data):
        return [(*[None if f is None else np.asarray(f, np.int32) for f in toxicity.text_features(t, buckets)], y, 1.0) for t, y in data]

    data = rows(sentences(1500, 1))
    plain, fair = toxicity.train(data, swap_penalty=0.0), toxicity.train(data, swap_penalty=20.0)
    neutral = "the muslim n1 n2 n3 n4 went n5"
    swapped = neutral.replace("muslim", "christian")
    gap = lambda m: abs(m.score(neutral, buckets) - m.score(swapped, buckets))
    assert gap(fair) < 0.5 * gap(plain) and fair.score(neutral, buckets) < 0.3
    held = sentences(400, 2)
    right = [(fair.score(t, buckets) >= 0.3) == y for t, y in held]
    assert np.mean(right) > 0.95


def test_toxicity_query_shape(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(sentences(600, 3))] + [(700, None, None), (701, "", 0), (702, "vile " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity_model(df)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    assert out[700]["score"] == out[701]["score"] < 0.3 and out[702]["predicted"] == 1
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    one = toxicity.fit_toxicity_model(df.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score_toxicity(df, one).collect()} == {0}


def test_sample_rates_far_below_a_millionth(spark):
    rows = spark.range(20_000_000)
    rate = 1500 / 1e10  # the rate of a label with 10^10 rows
    n = rows.filter(_fit.drawn(F.col("id"), 3, F.lit(rate * 10))).count()
    assert 5 <= n <= 80
    assert rows.limit(1000).filter(_fit.drawn(F.col("id"), 3, F.lit(1.0))).count() == 1000


def test_labels_are_sampled_before_texts(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(sentences(1500, 4))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (8000, 0), (9000, 0), (3, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity_model(docs, labels)
    right = [(model.score(t) >= 0.3) == y for t, y in sentences(300, 5)]
    assert np.mean(right) > 0.95


def test_live_buckets_score_like_all(spark):
    data = [(*[None if f is None else np.asarray(f, np.int32) for f in toxicity.text_features(t, toxicity.Buckets())], y, 1.0) for t, y in sentences(800, 6)]
    model = toxicity.train(data)
    for t, _ in sentences(100, 7):
        assert abs(model.score(t) - model.score(t, toxicity.Buckets())) < 1e-6


def test_neutral_mentions_in_four_languages():
    """Each language's families swap within themselves."""
    for family in toxicity.IDENTITY_FAMILIES:
        assert len(set(family)) == len(family) > 1 and all(t == t.lower() for t in family)
    assert toxicity.SWAP["frauen".encode()] == "männer".encode() and toxicity.SWAP["musulmans".encode()] == "chrétiens".encode()
