import random

import corpus_pipeline
from pacelane.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def tables(spark, folder):
    rng = random.Random(12)
    kinds = {"en": ["the", "ing", "er", "on", "ha", "st"], "de": ["sch", "ung", "der", "ein", "keit", "ü"]}
    rows = [(k, prose(rng, kinds[lang], rng.choice([30, 120])), lang) for k, lang in enumerate(["en", "de"] * 40)]
    item = prose(rng, kinds["en"], 30)
    base = prose(rng, kinds["de"], 200)
    rows += [
        (100, base, "de"),
        (101, base + " ende", "de"),
        (102, base, "de"),
        (103, prose(rng, kinds["en"], 40) + " " + item + " " + prose(rng, kinds["en"], 40), "en"),
        (104, prose(rng, kinds["en"], 40) + " token=abcdefgh12345 " + prose(rng, kinds["en"], 5), "en"),
        (105, None, "en"),
        (106, "12 345", None),
        (107, "", "de"),
    ]
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item + "?\n" + prose(rng, kinds["en"], 2)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, _ in rows}


def test_stages_by_hand(spark, tmp_path):
    texts = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{place}")
        docs = spark.read.parquet(f"{tmp_path}/{place}")
        if place < 4:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - set(kept["language"]) == {105, 106, 107}
    assert set(kept["language"]) - set(kept["near_copies"]) == {101, 102}
    assert set(kept["near_copies"]) - set(kept["benchmark"]) == {103}
    assert set(kept["secrets"]) == set(kept["benchmark"])
    for i, r in kept["secrets"].items():
        expected = texts[i].replace("token=abcdefgh12345", "[SECRET]")
        assert r.text == expected and r.n_chars == len(expected)
        assert kept["pieces"][i].decoded == expected and kept["pieces"][i].n_tokens == len(kept["pieces"][i].ids)
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.ids for i, r in kept["pieces"].items()}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
