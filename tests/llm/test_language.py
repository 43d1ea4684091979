import random

import numpy as np
from pyspark.sql import functions as F

from pacelane.llm.language import LanguageModel, fit_language, gram_counts, identify, keep_identified, spherical_means, vectors

SYLLABLES = {"xx": ["the", "ing", "and", "er", "on", "th"], "yy": ["der", "ung", "sch", "ich", "ü"], "zz": ["ção", "nh", "os", "a", "que"]}


def text(language, rng, words=60):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def corpus(spark, rows=60):
    rng = random.Random(2)
    return spark.createDataFrame([(k, text(lang, rng), lang, 1.0) for k, lang in enumerate(sorted(SYLLABLES) * rows)], "doc_id long, text string, lang string, score double")


def test_held_out_accuracy(spark):
    frame = corpus(spark)
    model = fit_language(frame, F.col("doc_id") % 4 != 2)
    found = identify(frame, model).join(frame.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert found.where("score < 0 OR score > 1 OR rejected").count() == 0


def test_odd_texts(spark, docs):
    model = fit_language(corpus(spark))
    frame = docs([(1, None), (2, ""), (3, "12 34 !?"), (4, "the"), (4, "the"), (None, "der ung"), (5, "the and " * 30000), (6, "жзик лмноп рстуф хцч " * 30)])
    found = {(r.doc_id, r.lang_pred): r for r in identify(frame, model).collect()}
    assert all(found[(k, "und")].score == 0 and found[(k, "und")].rejected for k in (1, 2, 3))
    assert not found[(4, "xx")].rejected and (None, "yy") in found and not found[(5, "xx")].rejected
    assert [r for k, r in found.items() if k[0] == 6][0].rejected
    kept = keep_identified(frame, model)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "None"]


def test_no_training_rows(spark, docs):
    model = fit_language(docs([(1, "abc")]))
    assert [(r.lang_pred, r.score) for r in identify(docs([(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert identify(docs([]), model).count() == 0


def test_brute_force_cosine(spark):
    frame = corpus(spark, 20)
    model = fit_language(frame, sample=10_000)
    rows = frame.collect()
    counts = np.stack([gram_counts(r.text) for r in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    assert np.allclose(model.idf, idf, atol=1e-5)
    cosine = vectors(counts, model.idf) @ model.centroids.T
    names, score, _ = model.predict([r.text for r in rows])
    assert names == [model.languages[k] for k in cosine.argmax(axis=1)] and np.allclose(score, np.clip(cosine.max(axis=1), 0, 1))


def test_equal_rows_give_one_centroid():
    rows = np.tile(np.array([[0.6, 0.8]], np.float32), (5, 1))
    assert len(spherical_means(rows, 4, 5)) == 1
    assert LanguageModel([], np.zeros((0, 2)), np.zeros(0), np.ones(2)).predict(["a"])[0] == ["und"]
