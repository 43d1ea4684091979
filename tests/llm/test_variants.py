import random
import re
import zlib
from collections import Counter

import numpy as np

from pacelane.llm import variants
from pacelane.llm.queries import op13


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        form[w] = best and best[1]
        out[w] = [form[w], None, n, len(others), -best[0] if best else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def random_words(rng, many):
    words = {}
    for _ in range(many):
        base = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 6, 30, 31, 150, 800])
        for _ in range(3):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            base = base[:at] + rng.choice(["", "b", "é"])[: kind != 0] + base[at + (kind != 2) :]
            if len(base) >= 6:
                words[base] = rng.choice([5, 6, 30, 31, 150, 800])
    return words


def test_forms_equal_brute_force(spark):
    words = random_words(random.Random(1), 150) | {"z" * 5000: 5, "z" * 5001: 40, "z" * 4999 + "y": 5, "aaaaaa": 5, "aaaaab": 5, "aaaaac": 5, "unlike": 9}
    found = variants.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in found.collect()} == brute(words)


def test_neighbourhoods_are_full():
    """Numbers of the neighbourhood are those of all words over the symbols that are at most one edit away."""
    rng = random.Random(2)
    pool = [ord(c) for c in "abcdefghijklmnopqrstuvwxyzéÿ"]
    for symbols in (2, 4, 7):
        signs = {int(s): chr(c) for c, s in zip(pool, variants.reduced(np.array(pool), symbols), strict=True)}
        assert set(signs) <= set(range(1, symbols + 1))
        for _ in range(10):
            word = "".join(rng.choice(list(signs.values())) for _ in range(rng.randint(1, 8)))
            around = {word} | {word[:k] + word[k + 1 :] for k in range(len(word))}
            around |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in signs.values()} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in signs.values()}
            codes = set(variants.neighbours(np.array([[ord(c) for c in word]]), symbols)[0].tolist())
            own = {int(variants._own(np.array([[ord(c) for c in w]]), symbols)[0]) for w in around if w}
            assert own <= codes
            if len(signs) == symbols and len(word) > 1:
                assert own == codes


def test_many_symbols_and_small_parts_change_nothing(spark, monkeypatch):
    words = random_words(random.Random(3), 60)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    first = {tuple(r) for r in variants.spelling_forms(frame).collect()}
    monkeypatch.setattr(variants, "LEAST_SYMBOLS", 11)
    monkeypatch.setattr(variants, "CODES", 50)
    assert first == {tuple(r) for r in variants.spelling_forms(frame).collect()} == brute(words)


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def test_query_equals_brute_force(spark, docs):
    rng = random.Random(4)
    pool = list(random_words(rng, 25)) + ["Straße", "ÉCOLES", "écoles", "short", "letters×÷", "mixedCase"]
    rows = [(k, rng.choice([" ", "-", "\n", "1"]).join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for k in range(120)]
    rows += [(None, None), (None, "letters letters"), (900, ""), (901, "12 !"), (7, rows[7][1]), (902, "q" * 30_000), (903, "łódź kolejny " * 6)]

    class Fixture:
        documents = docs(rows)

    assert {tuple(r) for r in op13(Fixture).collect()} == brute(counted(rows))
    Fixture.documents = docs([])
    assert op13(Fixture).count() == 0


def test_counts_are_handed_on_in_parts(spark, docs, monkeypatch):
    rows = [(k, f"common wordnumber{'abcdefghij'[k % 10]} common") for k in range(100)]
    monkeypatch.setattr(variants, "HELD", 3)
    found = dict(map(tuple, variants.count_words(docs(rows)).collect()))
    assert found == counted(rows)
