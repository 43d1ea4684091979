import random
import time

import numpy as np
import pyarrow as pa

from pacelane.llm import toxicity
from pacelane.llm.toxicity import Network, Vocabulary, fit_toxicity, score_texts, train, window_words, windows
from pacelane.llm.words import PUNCTUATION, find_words, text_bytes

RUDE = ["grumblor", "snarkle", "vexling"]


def words(rng, n):
    return ["".join(rng.choice(["ba", "do", "ki", "lu", "ne", "ro"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(rng, n):
    rows = []
    for k in range(n):
        text, toxic = words(rng, rng.choice([12, 60, 200])), k % 4 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(RUDE) + rng.choice(["", "s", "ish"]))
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_gradients_match_differences():
    data, offsets = text_bytes(pa.array(["you idiot and moron said hello worthless trash of the day again the end of it", "short one"]))
    found = find_words(data, offsets, PUNCTUATION)
    known = np.unique(found.code)[:6]
    network = Network(known, np.array([True, False] * 3))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    vocabulary = Vocabulary(found, known)
    _, begin, size = windows(found.first)
    index, mask = window_words(vocabulary.of, begin, size)
    numbers = np.random.default_rng(0).standard_normal((len(vocabulary.code), toxicity.TELLING))
    label, worth, every = np.array([1.0, 0.0]), np.array([1.0, 2.0]), np.arange(len(vocabulary.code))

    def loss():
        learned = network.p["word"][vocabulary.row] + np.add.reduceat(network.p["gram"][vocabulary.gram >> toxicity.FOLD], vocabulary.begin, axis=0) / vocabulary.grams[:, None]
        logit = network.logits(np.concatenate([learned, numbers], axis=1), index, mask)
        return float(((np.log1p(np.exp(logit)) - label * logit) * worth / worth.sum()).sum())

    found_gradients = network.gradients(vocabulary, every, numbers, index, mask, label, worth)
    for name, value in network.p.items():
        flat, gradient = value.reshape(-1), found_gradients[name].reshape(-1)
        k = int(np.abs(gradient).argmax())
        kept, step = flat[k], 1e-4
        flat[k] = kept + step
        up = loss()
        flat[k] = kept - step
        down = loss()
        flat[k] = kept
        assert abs((up - down) / (2 * step) - gradient[k]) <= 1e-4 + 1e-2 * abs(gradient[k]), name


def test_held_out_texts(spark):
    rows = corpus(random.Random(1), 400)
    frame = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (0, None), (99_999, 1)], "doc_id long, toxic int")
    network = fit_toxicity(frame, labels, toxicity.F.col("doc_id") % 3 != 1)
    found = {r.doc_id: r.score for r in score_texts(frame, network).collect()}
    held = [(found[i] >= toxicity.CUT, bool(y)) for i, _, y in rows if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in found.values())

    clean = " ".join(words(random.Random(2), 30_000))
    odd = [(1, None, None), (2, "", None), (3, "!!", None), (4, clean + " grumblor snarkle vexlings grumblors " + clean, None), (4, "ba", None), (None, "ba do", None)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, score double")
    scores = [(r.doc_id, r.score) for r in score_texts(frame, network).collect()]
    assert len(scores) == 6 and all(s == 0 for i, s in scores if i in (1, 2, 3))
    assert max(s for i, s in scores if i == 4) >= toxicity.CUT
    assert score_texts(frame.limit(0), network).count() == 0


def test_no_labels(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert fit_toxicity(frame, labels) is None and train([], []) is None
    assert score_texts(frame, None).collect()[0].score == 0.0


def test_windows_overlap_and_cover():
    text, begin, size = windows(np.array([0, 0, 5, 5 + toxicity.WINDOW, 1000]))
    assert [int(t) for t in text[:3]] == [1, 2, 3]
    covered = set()
    for b, n in zip(begin, size):
        covered |= set(range(b, b + n))
    assert covered == set(range(1000))


def test_every_window_is_scored_as_one_by_one():
    rng = random.Random(4)
    texts = [" ".join(words(rng, n)) for n in (0, 1, 23, 24, 25, 60, 0, 5000, 30)]
    data, offsets = text_bytes(pa.array(texts))
    found = find_words(data, offsets, PUNCTUATION)
    network = Network(np.unique(found.code)[:50], np.ones(50, bool))
    network.shift = 0.25
    vocabulary = Vocabulary(found, network.known)
    vectors = network.inputs(vocabulary, network.tables)
    best = []
    for k, n in enumerate(np.diff(found.first)):
        begin = found.first[k] + np.arange(max(1, n - toxicity.WINDOW + 1) if n else 0)
        index, mask = window_words(vocabulary.of, begin, np.full(len(begin), min(n, toxicity.WINDOW)))
        best.append(float(network.logits(vectors, index, mask).max()) + 0.25 if n else -np.inf)
    assert np.allclose(network.text_logits(data, offsets), best, atol=1e-4)


def test_a_block_of_windows_costs_the_same_with_many_distinct_words():
    """A block reads the gates of its own words; it once copied those of all words, each time."""
    network = Network(np.zeros(0, np.uint64), np.zeros(0, bool))
    rng = np.random.default_rng(8)
    line, vectors = rng.integers(0, 1000, 3 * toxicity.BLOCK), rng.standard_normal((400_000, toxicity.SIZE + toxicity.TELLING)).astype(np.float32)

    def seconds(rows, line):
        took = []
        for _ in range(3):
            begin = time.perf_counter()
            network.full_windows(vectors[:rows], line)
            took.append(time.perf_counter() - begin)
        return min(took)

    # what the gates themselves take is in both
    few = seconds(1000, line) - seconds(1000, line[: toxicity.BLOCK])
    many = seconds(len(vectors), line) - seconds(len(vectors), line[: toxicity.BLOCK])
    assert many < 3 * few


def test_words_before_a_text_never_lower_its_score():
    rows = corpus(random.Random(6), 120)
    network = train([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = [t for _, t, _ in rows if len(t.split()) >= toxicity.WINDOW]
    plain_scores = network.text_logits(*text_bytes(pa.array(texts)))
    for n in (1, 8, 15):
        moved = network.text_logits(*text_bytes(pa.array([" ".join(words(random.Random(n), n)) + " " + t for t in texts])))
        assert (moved >= plain_scores - 1e-4).all()
