import hashlib
import random
import re

from pyspark.sql import functions as F

from pacelane.llm import spots
from pacelane.llm.queries import op7
from pacelane.llm.spots import ANCHORS, CHAIN, SKIP, alike_groups, beside_next, likeness, signatures, with_edits

STOP = set(" ".join(ANCHORS).split()) | {"^"}


def chains(text):
    """Chains by a walk over the words."""
    words = ["^", *re.sub(r"[\W_]+", " ", text.lower()).split(), *["$"] * CHAIN]
    if len(words) == 1 + CHAIN:
        return {text} if text else set()
    out = set()
    for k, word in enumerate(words):
        if word not in STOP:
            continue
        chain, skipped = [word], 0
        for later in words[k + 1 :]:
            if later in STOP and later != "^":
                skipped += 1
                if skipped > SKIP:
                    break
            else:
                chain.append(later)
                skipped = 0
                if len(chain) == 1 + CHAIN:
                    out.add(" ".join(chain) + " ")
                    break
    return out


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "in", *[f"word{k}" for k in range(30)]]) for _ in range(n))


def test_signatures_match_a_walk(spark, docs):
    rng = random.Random(5)
    texts = ["", "one", "...", "the", "the the the", "the " * 12 + "end stop", "Ärger über den Häusern, été à la plage", "the cat sat on the mat.\nThe end", *[words(rng, n) for n in (3, 30, 300)]]
    found = docs(list(enumerate(texts))).select("doc_id", signatures(F.col("text")).alias("s")).collect()
    rows = [(k, c) for k, t in enumerate(texts) for c in chains(t)] or [(0, "")]
    hashed = spark.createDataFrame(rows, "doc_id long, chain string").select("doc_id", F.xxhash64("chain").alias("h")).collect()
    for r in found:
        assert set(r.s) == {h.h for h in hashed if h.doc_id == r.doc_id}, texts[r.doc_id][:60]


def test_likeness_is_jaccard(spark):
    frame = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "a array<long>, b array<long>")
    assert [r[0] for r in frame.select(likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]


def test_next_document_and_edits(spark, docs, monkeypatch):
    monkeypatch.setattr(spots, "CHUNK", 3)
    rng = random.Random(6)
    ids = rng.sample(range(-50, 10_000), 40)
    rows = [(i, words(rng, rng.randrange(0, 40)) or None) for i in ids]
    found = {r.doc_id: r for r in with_edits(docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(found) == 40
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % 40][1] or ""
        third = len(text) // 3
        assert found[i].edited == text[: len(text) - third] + following[:third]


def test_next_of_ties_nulls_and_few(spark, docs):
    one = with_edits(docs([(5, "abcdef")])).collect()
    assert [r.edited for r in one] == ["abcdab"]
    found = with_edits(docs([(1, "aaa"), (1, "bbb"), (None, "cccccc"), (None, "cccccc")])).collect()
    assert sorted(r.edited for r in found) == ["aab", "bba", "cccc", "cccc"]
    assert with_edits(docs([])).count() == 0
    assert beside_next(docs([(None, "x")]).select("doc_id", "text"), {}, {"text": "later"}).collect()[0].later is None


def test_query_columns(spark, tmp_path, docs):
    class Fixture:
        documents = docs([(1, "The cat and the dog"), (2, "The cat and the dog"), (3, None), (4, "of mice and of men " * 400)])

    rows = {r.doc_id: r for r in op7(Fixture).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[3].n_chars == 0 and rows[3].fingerprint == ""
    assert rows[2].near_next == 1.0 and rows[3].near_next == 0.0
    assert rows[4].edited_sha256 == hashlib.sha256(("of mice and of men " * 400)[: 7600 - 2533].encode()).hexdigest()


def test_groups_match_all_pairs(spark, docs):
    rng = random.Random(8)
    rows, number = [], 0
    for _ in range(8):
        base = words(rng, 150).split()
        for _ in range(8):
            base[rng.randrange(150)] = f"x{rng.randrange(1000)}"
            rows.append((number, " ".join(base)))
            number += 1
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "...")]
    sets = {i: frozenset(chains(t or "")) for i, t in rows}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] > group[b]:
                    group[a], changed = group[b], True
    assert {r.doc_id: r.component for r in alike_groups(docs(rows)).collect()} == group


def test_far_ids_do_not_fill_a_range(spark, docs, monkeypatch):
    monkeypatch.setattr(spots, "CHUNK", 64)
    ids = [*range(0, 3000, 3), 10**9, *range(10**15, 10**15 + 500), -(1 << 63), (1 << 63) - 1, 7, 7, 7]
    rows = docs([(i, f"text {i}") for i in ids])
    cut, found = spots.id_ranges(rows.select("doc_id", "text"), len(ids), min(ids), max(ids), 64)
    assert max(n for *_, n in found) <= 128 and sum(n for *_, n in found) == len(ids)
    assert all(a[2] < b[1] for a, b in zip(found, found[1:]))
    order = sorted(set(ids), reverse=True)
    later = dict(zip(order, order[1:] + order[:1]))
    got = {(r.doc_id, r.later) for r in beside_next(rows.select("doc_id", "text"), {}, {"doc_id": "later"}).collect()}
    assert got == {(i, later[i]) for i in order} | {(7, 7)}
