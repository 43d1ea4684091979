import random
import re

import numpy as np
import pyarrow as pa

from pacelane.llm.words import PUNCTUATION, WHITE, find_words, shingle_codes, shingle_set, slices, text_bytes

TEXTS = ["", "One two\tTWO  three", "  lead and trail ", "é É ñandú x", "a", "\n\x0b", "übermäßig lang " * 50, "no-break\xa0space"]


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def test_words_match_a_regular_expression():
    data, offsets = text_bytes(pa.array(TEXTS))
    found = find_words(data, offsets, WHITE)
    seen = [data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    assert seen == [w for t in TEXTS for w in words_of(t)]
    assert [int(n) for n in np.diff(found.first)] == [len(words_of(t)) for t in TEXTS]


def test_equal_words_have_equal_numbers_wherever_they_stand():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    data, offsets = text_bytes(pa.array([" ".join(words[:1500]), " ".join(words[1500:]).upper().replace("É", "é")]))
    found = find_words(data, offsets)
    by_word = {}
    for word, code in zip(words, found.code.tolist()):
        assert by_word.setdefault(word, code) == code
    assert len(set(by_word.values())) == len(by_word)


def test_adjacent_texts_do_not_melt():
    data, offsets = text_bytes(pa.array(["ab", "cd", None, "", "ef"]))
    assert len(find_words(data, offsets).code) == 3


def test_slices_cover_every_text_once():
    texts = pa.array(["x" * n for n in (0, 5, 3000, 1, 0, 2000, 9)] + [None]).slice(1)
    got = []
    for first, to, data, offsets in slices(texts, 1500):
        got += [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(to - first)]
    assert got == [t or "" for t in texts.to_pylist()]


def test_shingles():
    data, offsets = text_bytes(pa.array(["a b c a b c a", "a b", ""]))
    found = find_words(data, offsets)
    sets = [shingle_set(found.code[found.first[k] : found.first[k + 1]], 3) for k in range(3)]
    assert [len(s) for s in sets] == [3, 1, 0]
    assert len(shingle_codes(found.code[:2], 3)) == 0


def test_punctuation_separates():
    data, offsets = text_bytes(pa.array(["a,b.c-d é!f"]))
    assert len(find_words(data, offsets, PUNCTUATION).code) == 6
