import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelane.llm import runs
from pacelane.llm.queries import op11


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_runs(words):
    """Every stretch of matches at every distance; of equal stretches the smallest distance."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def random_text(rng, most):
    """Words with repeated stretches of many periods, also nested and next to each other."""
    words = []
    while len(words) < most:
        block = [rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 14, 20, 33, 70, 150]))]
        words += (block * rng.randint(1, 40))[: rng.randint(1, 400)]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "x"
        if rng.random() < 0.2:
            words += words[-rng.randint(1, len(words)) :] * rng.randint(1, 4)
    return " ".join(words[:most])


@pytest.mark.parametrize("small", [8, 32, 256])
def test_tiles_find_what_a_walk_finds(small):
    """Stitched stretches of tiles equal the runs of a plain walk over the whole text."""
    rng = random.Random(small)
    for _ in range(25):
        words = random_text(rng, rng.randint(1, 1500)).split()
        numbers = {w: k for k, w in enumerate(sorted(set(words)))}
        code = np.random.default_rng(5).integers(1, 1 << 62, len(numbers)).astype(np.uint64)[[numbers[w] for w in words]]
        parts = list(runs.tiles(code, small))
        stretches = sorted({r[1:] for r in zip(*(v.tolist() for v in runs.solve(parts)), strict=True)}) if parts else []
        joined = []
        for q, low, high in stretches:
            if joined and joined[-1][0] == q and joined[-1][2] >= low:
                joined[-1][2] = max(joined[-1][2], high)
            else:
                joined.append([q, low, high])
        found = sorted((low, q, high - low + q) for q, low, high in joined if high - low + q >= max(24, 3 * q))
        assert found == plain_runs(words)


def test_long_texts_and_small_tiles_change_nothing(spark, docs):
    rng = random.Random(3)
    frame = docs([(k, random_text(rng, rng.randint(10, 6000))) for k in range(12)])
    rows = {tuple(r) for r in runs.periodic_runs(frame).collect()}
    assert rows == {tuple(r) for r in runs.periodic_runs(frame, long=3000, small=32).collect()}
    for r in frame.collect():
        assert sorted((s, q, n) for i, _, s, n, q in rows if i == r.doc_id) == plain_runs(words_of(r.text))


def test_query_equals_brute_force(spark, docs):
    rng = random.Random(4)
    texts = [random_text(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "w " * 30_000), (7, texts[7]), (7, texts[7]), (None, texts[9]), (None, None), (105, "a b É é " * 12)]
    frame = docs(rows).withColumn("runs", F.lit("old")).withColumn("period", F.lit(1))

    class Fixture:
        documents = frame

    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    expected = []
    for doc_id, text in rows:
        words = planted(doc_id, words_of(text))
        found = plain_runs(words) if len(words) < 20_000 else [(0, 1, len(words))]
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, q, n in found)]
        best = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        expected.append((doc_id, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4), sha(listed), sha(" ".join(kept))))
    got = [tuple(r) for r in op11(Fixture).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert op11(type("Empty", (), {"documents": docs([])})).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_collapsed_text_keeps_one_period(spark, docs):
    frame = docs([(1, "start " + "one two three " * 20 + "end"), (2, None), (3, "no\trun here")])
    found = {r.doc_id: r.text for r in runs.collapse(runs.with_runs(frame)).collect()}
    assert found == {1: "start one two three end", 2: None, 3: "no run here"}


def test_multiples_of_a_period_leave_no_fragments(spark, docs):
    """A text of one word has one run, and its tiles report one stretch each, however many periods would match."""
    found = runs.fragments(docs([(1, "w " * 100_000)]), "doc_id", "text", 4 << 20, 256)
    assert found.where("period > 1").count() == 0 and found.count() <= 100_000 // 3072 + 2
