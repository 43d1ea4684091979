"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text is lower-cased and cut into words; a window of ``WINDOW`` words begins at every word that has as many after it (a shorter
text is one window).  A word's input is the sum of a learned vector of the word, if it is frequent in the training sample, and the mean of learned vectors of its
hashed 3- and 4-character runs, beside three numbers that tell how much more often the word, and the most and the mean of its
character runs, occur in toxic texts of the sample than in clean ones (in training without the text itself).  Two gated recurrent layers read a window forwards and backwards; attention weighs their
states, and a logistic unit scores the weighted mean.  A text's score is that of its highest window.  All windows are read, so what
stands before a stretch of ``WINDOW`` words cannot hide it: words put before or after a text never lower its score, unless it was one short window.

The network is trained in NumPy on a bounded sample: at most about ``SAMPLE`` labelled texts of each label, those with the smallest
hashes of their ids, of up to ``SAMPLE_BYTES`` bytes.  Labels belong to texts, not windows, so each pass takes the highest of
the windows ``STEP`` apart of every text, and random windows of clean texts beside it.  At last scores, again of all windows, are
shifted so that the cut that separates the sample best lies at ``CUT``.

Null and empty texts and texts without a word score 0.  Without training rows of both labels every text scores 0.  Equal
texts get equal scores.  Several labels of one document are all learned from; null labels are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, ship_package
from pacelane.llm.words import PUNCTUATION, U64, Words, find_words, slices

WINDOW, STEP = 24, 16
HIDDEN, SIZE, LOOK = 8, 16, 8
GRAM_BITS = 15
LEARNED_BITS = 12
FOLD = GRAM_BITS - LEARNED_BITS
SAMPLE = 1500
SAMPLE_BYTES = 1 << 16
FREQUENT = 5
CUT = 0.7
BLOCK = 4096
"""Windows read side by side; their states fit in a core's cache."""
EPOCHS = 6
TELLING = 3
"""Numbers beside a word's learned vector."""


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of the training windows, ``STEP`` apart; ``first`` are the texts' first words."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + within * STEP
    return text, begin, np.minimum(WINDOW, first[text + 1] - begin)


def gram_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-byte runs of marked words, word by word, and where each word's begin."""
    size = end - start + 2
    offset = np.concatenate([[0], np.cumsum(size)])
    line = np.empty(offset[-1], np.uint8)
    line[offset[:-1]] = 94
    line[offset[1:] - 1] = 36
    inner = np.ones(len(line), bool)
    inner[offset[:-1]] = inner[offset[1:] - 1] = False
    line[inner] = data[_within(start, end)]
    wide = line.astype(U64)
    codes, owners = [], []
    owner = np.repeat(np.arange(len(start)), size)
    for width in (3, 4):
        n = len(line) - width + 1
        if n <= 0:
            continue
        code = np.zeros(n, U64)
        for k in range(width):
            code = code * U64(0x100000001B3) + wide[k : k + n] + U64(width)
        same = owner[:n] == owner[width - 1 :]
        codes.append(((code[same] * U64(0x9E3779B97F4A7C15)) >> U64(64 - GRAM_BITS)).astype(np.int64))
        owners.append(owner[:n][same])
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return code[order], np.searchsorted(owner[order], np.arange(len(start)))


def _within(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of the spans, one span after another."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Distinct words of some texts, with their row among the known words (0: none) and their character runs."""

    def __init__(self, words, known: np.ndarray | None = None):
        self.code, first, self.of = np.unique(words.code, return_index=True, return_inverse=True)
        self.gram, self.begin = gram_rows(words.data, words.start[first], words.end[first])
        self.grams = np.diff(np.concatenate([self.begin, [len(self.gram)]]))
        self.row = np.zeros(len(self.code), np.int64)
        if known is not None and len(known):
            row = np.searchsorted(known, self.code)
            row[row == len(known)] = 0
            self.row = np.where(known[row] == self.code, row + 1, 0)


def telling(toxic: np.ndarray, clean: np.ndarray, toxic_texts: float, clean_texts: float) -> np.ndarray:
    """Log odds of occurring in toxic texts, in standard deviations; 0 for what occurs in hardly any text."""
    toxic, clean = np.maximum(toxic, 0), np.maximum(clean, 0)
    prior = 1.0
    share = toxic_texts / max(1.0, toxic_texts + clean_texts)
    a, b = prior * share, prior * (1 - share)
    odds = np.log((toxic + a) / (toxic_texts + 2 * a)) - np.log((clean + b) / (clean_texts + 2 * b))
    score = odds / np.sqrt(1 / (toxic + a) + 1 / (clean + b))
    return np.clip(np.where(toxic + clean > 0, score, 0) / 2, -2, 4).astype(np.float32)


class Telling:
    """How telling the sample's words and character runs are; ``left_out`` is the label of the text they are asked for."""

    def __init__(self, vocabulary: Vocabulary, words, label: np.ndarray, rows: int):
        self.texts = float((label == 1).sum()), float((label == 0).sum())
        pairs = np.unique(vocabulary.of * len(label) + words.text)
        word, text = pairs // len(label), pairs % len(label)
        self.word = [np.bincount(vocabulary.row[word], label[text] == k, minlength=rows) for k in (1, 0)]
        self.gram = [np.zeros(1 << GRAM_BITS) for _ in range(2)]
        order = np.argsort(text, kind="stable")
        for mine in np.split(word[order], np.searchsorted(text[order], np.arange(1, len(label)))):
            if len(mine):
                gram = vocabulary.gram[_within(vocabulary.begin[mine], vocabulary.begin[mine] + vocabulary.grams[mine])]
                self.gram[0 if label[text[order[0]]] == 1 else 1][np.unique(gram)] += 1
            order = order[len(mine) :]

    def tables(self, left_out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        less = [left_out == 1, left_out == 0]
        out = []
        for counts in (self.word, self.gram):
            out.append(telling(counts[0] - less[0], counts[1] - less[1], self.texts[0] - less[0], self.texts[1] - less[1]))
        out[0][0] = 0
        return tuple(out)


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, known: np.ndarray, frequent: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.known, self.learned = known, np.concatenate([[False], frequent])[:, None]
        self.shift = 0.0
        self.tables = np.zeros(len(known) + 1, np.float32), np.zeros(1 << GRAM_BITS, np.float32)
        self.p = {
            "word": draw(len(known) + 1, SIZE, scale=0.02) * self.learned,
            "gram": draw(1 << LEARNED_BITS, SIZE, scale=0.02),
            "in_f": draw(SIZE + TELLING, 3 * HIDDEN, scale=0.3),
            "in_b": draw(SIZE + TELLING, 3 * HIDDEN, scale=0.3),
            "base_f": np.zeros(3 * HIDDEN, np.float32),
            "base_b": np.zeros(3 * HIDDEN, np.float32),
            "back_f": draw(HIDDEN, 3 * HIDDEN, scale=0.3),
            "back_b": draw(HIDDEN, 3 * HIDDEN, scale=0.3),
            "look": draw(2 * HIDDEN, LOOK, scale=0.3),
            "gaze": draw(LOOK, scale=0.3),
            "out": draw(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }

    def inputs(self, vocabulary: Vocabulary, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vector of every distinct word."""
        rows = np.empty((len(vocabulary.row), SIZE + TELLING), np.float32)
        rows[:, :SIZE] = self.p["word"][vocabulary.row]
        rows[:, SIZE] = tables[0][vocabulary.row]
        for at in range(0, len(rows), 1 << 15):
            to = min(at + (1 << 15), len(rows))
            low, high = vocabulary.begin[at], vocabulary.begin[to] if to < len(rows) else len(vocabulary.gram)
            gram, begin = vocabulary.gram[low:high], vocabulary.begin[at:to] - low
            rows[at:to, :SIZE] += np.add.reduceat(self.p["gram"][gram >> FOLD], begin, axis=0) / vocabulary.grams[at:to, None]
            rows[at:to, SIZE + 1] = np.maximum.reduceat(tables[1][gram], begin)
            rows[at:to, SIZE + 2] = np.add.reduceat(tables[1][gram], begin) / vocabulary.grams[at:to]
        return rows

    def _read(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, side: str, trace: list | None) -> np.ndarray:
        """States (steps, windows, hidden) of one direction."""
        back = self.p[f"back_{side}"]
        state = np.zeros((len(index), HIDDEN), np.float32)
        states = np.empty((WINDOW, len(index), HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            given, kept = gates[index[:, t]], state @ back
            open_ = _sigmoid(given[:, : 2 * HIDDEN] + kept[:, : 2 * HIDDEN])
            z, r, q = open_[:, :HIDDEN], open_[:, HIDDEN:], kept[:, 2 * HIDDEN :]
            new = np.tanh(given[:, 2 * HIDDEN :] + r * q)
            m = mask[:, t, None]
            if trace is not None:
                trace.append((t, state, z, r, q, new, m))
            state = state + m * (1 - z) * (new - state)
            states[t] = state
        return states

    def logits(self, words: np.ndarray, index: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Score of windows before the logistic unit; ``words`` are input vectors, ``index`` the windows' words."""
        p = self.p
        traces = {s: [] if trace is not None else None for s in "fb"}
        states = np.concatenate([self._read(words @ p[f"in_{s}"] + p[f"base_{s}"], index, mask, s, traces[s]) for s in "fb"], axis=2)
        seen = np.tanh(states @ p["look"])
        gaze = np.where(mask.T > 0, seen @ p["gaze"], np.float32(-1e9))
        weight = np.exp(gaze - gaze.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if trace is not None:
            trace.update(traces=traces, states=states, seen=seen, weight=weight, pooled=pooled)
        return pooled @ p["out"] + p["bias"][0]

    def gradients(self, vocabulary: Vocabulary, distinct: np.ndarray, numbers: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray, worth: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss over some windows whose words are ``distinct[index]``, with their telling ``numbers``."""
        p = self.p
        low = vocabulary.begin[distinct]
        grams = vocabulary.grams[distinct]
        gram = vocabulary.gram[_within(low, low + grams)] >> FOLD
        own = np.repeat(np.arange(len(distinct)), grams)
        start = np.cumsum(grams) - grams
        learned = p["word"][vocabulary.row[distinct]] + np.add.reduceat(p["gram"][gram], start, axis=0) / grams[:, None]
        words = np.concatenate([learned, numbers], axis=1)
        trace: dict = {}
        logit = self.logits(words, index, mask, trace)
        d = ((_sigmoid(logit) - label) * worth / worth.sum()).astype(np.float32)
        states, seen, weight, pooled = (trace[k] for k in ("states", "seen", "weight", "pooled"))
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_gaze = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["gaze"] = np.einsum("tn,tnl->l", d_gaze, seen)
        d_seen = d_gaze[:, :, None] * p["gaze"] * (1 - seen * seen)
        g["look"] = np.einsum("tnh,tnl->hl", states, d_seen)
        d_states += d_seen @ p["look"].T
        d_words = np.zeros_like(words)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            back = p[f"back_{side}"]
            d_back = np.zeros_like(back)
            d_gates = np.zeros((len(words), 3 * HIDDEN), np.float32)
            d_state = np.zeros((len(index), HIDDEN), np.float32)
            for t, state, z, r, q, new, m in reversed(trace["traces"][side]):
                d_state = d_state + d_states[t][:, part]
                inner = m * d_state
                d_new = inner * (1 - z) * (1 - new * new)
                d_z = inner * (state - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_kept = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_back += state.T @ d_kept
                np.add.at(d_gates, index[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                d_state = d_state - inner * (1 - z) + d_kept @ back.T
            g[f"back_{side}"] = d_back
            g[f"in_{side}"] = words.T @ d_gates
            g[f"base_{side}"] = d_gates.sum(axis=0)
            d_words += d_gates @ p[f"in_{side}"].T
        d_words = d_words[:, :SIZE]
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], vocabulary.row[distinct], d_words)
        g["word"] *= self.learned
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], gram, (d_words / grams[:, None])[own])
        return g

    def text_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest window of every text; minus infinity for a text without words."""
        words = find_words(data, offsets, PUNCTUATION)
        best = np.full(len(offsets) - 1, -np.inf)
        if not len(words.code):
            return best
        vocabulary = Vocabulary(words, self.known)
        return self.best_windows(self.inputs(vocabulary, self.tables), vocabulary.of, words.first) + self.shift

    def best_windows(self, vectors: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Highest window of every text, without the shift; ``of`` are the words of all texts as rows of ``vectors``."""
        size = np.diff(first)
        best = np.full(len(size), -np.inf)
        long = np.flatnonzero(size >= WINDOW)
        if len(long):
            score = self.full_windows(vectors, of)
            # from a long text's first window to its last, then to the next long text's first
            edges = np.stack([first[long], first[long] + size[long] - WINDOW + 1], axis=1).ravel()
            best[long] = np.maximum.reduceat(np.append(score, -np.inf), edges)[::2]
        short = np.flatnonzero((size > 0) & (size < WINDOW))
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            best[part] = self.logits(vectors, *window_words(of, first[part], size[part]))
        return best

    def full_windows(self, vectors: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Scores, as ``logits`` gives them, of the windows that begin at each place of one line of words.

        Windows lie side by side in memory, so a step of all of them reads one slice of the line's gates.  A logistic gate is
        written as a hyperbolic tangent of half its input, of the update gate with its sign turned.
        """
        p, n_all = self.p, len(of) - WINDOW + 1
        turn = np.repeat(np.array([-0.5, 0.5, 1], np.float32), HIDDEN)
        # row by row in memory: taking a block's words from a transposed view would copy the gates of all words for each block
        gates = {s: np.ascontiguousarray(((vectors @ p[f"in_{s}"] + p[f"base_{s}"]) * turn).T) for s in "fb"}
        back = {s: np.ascontiguousarray((p[f"back_{s}"] * np.repeat(np.array([-0.5, 0.5, 0.5], np.float32), HIDDEN)).T) for s in "fb"}
        look = np.ascontiguousarray(np.concatenate([p["look"].T, p["out"][None]]))
        score = np.empty(n_all, np.float32)
        for at in range(0, n_all, BLOCK):
            n = min(BLOCK, n_all - at)
            if not at or n < BLOCK:  # the same memory for block after block
                states = np.empty((WINDOW, 2 * HIDDEN, n), np.float32)
                kept, open_ = np.empty((3 * HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32)
                seen, weight = np.empty((LOOK + 1, n), np.float32), np.empty(n, np.float32)
            line = of[at : at + n + WINDOW - 1]
            above, below = np.zeros(n, np.float32), np.zeros(n, np.float32)
            step, new = open_[:HIDDEN], open_[HIDDEN:]
            for side, rows in (("b", slice(HIDDEN, None)), ("f", slice(0, HIDDEN))):
                given = np.take(gates[side], line, axis=1)
                state = None
                for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                    now, after = given[:, t : t + n], states[t, rows]
                    if state is None:  # from a state of zeros
                        np.tanh(now[:HIDDEN], out=step)
                        np.tanh(now[2 * HIDDEN :], out=new)
                        step += 1
                    else:
                        np.matmul(back[side], state, out=kept)
                        np.add(now[: 2 * HIDDEN], kept[: 2 * HIDDEN], out=open_)
                        np.tanh(open_, out=open_)
                        open_ += 1
                        new *= kept[2 * HIDDEN :]
                        new += now[2 * HIDDEN :]
                        np.tanh(new, out=new)
                        new -= state
                    step *= np.float32(0.5)
                    if state is None:
                        np.multiply(new, step, out=after)
                    else:
                        new *= step
                        np.add(state, new, out=after)
                    state = after
                    if side == "f":  # both states of the step are there
                        np.matmul(look, states[t], out=seen)
                        np.tanh(seen[:LOOK], out=seen[:LOOK])
                        np.exp(np.matmul(p["gaze"], seen[:LOOK], out=weight), out=weight)  # bounded, as the tangents are
                        below += weight
                        weight *= seen[LOOK]
                        above += weight
            score[at : at + n] = above / below + p["bias"][0]
        return score


def window_words(of: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-word numbers of windows, and a mask for the places past a short text's end."""
    place = np.arange(WINDOW)
    mask = place < size[:, None]
    return of[np.where(mask, begin[:, None] + place, 0)], mask.astype(np.float32)


def _all_words(column: pa.Array) -> Words:
    """Words of all texts, found slice by slice, which bounds the memory."""
    parts, byte, text, word = [], 0, 0, 0
    firsts = [np.zeros(1, np.int64)]
    for _, _, data, offsets in slices(column):
        found = find_words(data, offsets, PUNCTUATION)
        parts.append((found.code, found.text + text, found.start + byte, found.end + byte, data))
        firsts.append(found.first[1:] + word)
        byte, text, word = byte + len(data), text + len(offsets) - 1, word + len(found.code)
    return Words(*[np.concatenate(p) for p in zip(*parts)], np.concatenate(firsts))


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network | None:
    """A network fitted to whole labelled texts; None unless both labels occur."""
    label = np.array(labels, np.float32)
    if not len(label) or label.min() == label.max():
        return None
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    words = _all_words(column)
    text, begin, size = windows(words.first)
    if not len(text):
        return None
    code, of = np.unique(words.code, return_inverse=True)
    count = np.bincount(np.unique(of * len(label) + words.text) // len(label), minlength=len(code))
    network = Network(code[count > 1], count[count > 1] >= FREQUENT)
    vocabulary = Vocabulary(words, network.known)
    known = Telling(vocabulary, words, label, len(network.known) + 1)
    network.tables = known.tables()
    tables = known.tables(0), known.tables(1)
    vectors = [network.inputs(vocabulary, t) for t in tables]
    numbers = [v[:, SIZE:].copy() for v in vectors]
    rng = np.random.default_rng(seed)
    moment = {k: np.zeros_like(v) for k, v in network.p.items()}
    spread = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch % 2:
            score = _window_scores(network, vocabulary, tables, label[text], begin, size)
        elif not epoch:  # the sum of what is telling in a window
            sums = [np.concatenate([[0.0], np.cumsum(np.maximum(n, 0).sum(axis=1)[vocabulary.of])]) for n in numbers]
            score = np.where(label[text] == 1, sums[1][begin + size] - sums[1][begin], sums[0][begin + size] - sums[0][begin])
        order = np.lexsort((score, text))
        top = order[np.r_[text[order][1:] != text[order][:-1], True]]
        others = rng.permutation(np.flatnonzero(label[text] == 0))[: 2 * len(label)]
        chosen = rng.permutation(np.concatenate([top, others]))
        share = label[text[chosen]].mean()
        for at in range(0, len(chosen), 128):
            batch = chosen[at : at + 128]
            target = label[text[batch]]
            index, mask = window_words(vocabulary.of, begin[batch], size[batch])
            # a word counts apart in toxic and in clean texts, as its telling numbers differ
            distinct, index = np.unique(index * 2 + (target[:, None] == 1), return_inverse=True)
            side = np.where(distinct % 2 == 1, 1, 0)[:, None]
            given = np.where(side == 1, numbers[1][distinct // 2], numbers[0][distinct // 2])
            worth = np.where(target > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
            step += 1
            for k, g in network.gradients(vocabulary, distinct // 2, given, index.reshape(mask.shape), mask, target, worth).items():
                moment[k] += 0.1 * (g - moment[k])
                spread[k] += 0.01 * (g * g - spread[k])
                rate = (0.001 if k in ("word", "gram") else 0.01) / (1 - 0.9**step)
                network.p[k] -= (rate * moment[k] / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-7) + 1e-4 * network.p[k]).astype(np.float32)
    best = np.full(len(label), -np.inf)
    for k in (0, 1):
        mine = label == k
        first = np.concatenate([[0], np.cumsum(np.diff(words.first)[mine])])
        best[mine] = network.best_windows(network.inputs(vocabulary, tables[k]), vocabulary.of[mine[words.text]], first)
    network.shift = float(np.log(CUT / (1 - CUT)) - _cut(best, label))
    return network


def _window_scores(network: Network, vocabulary: Vocabulary, tables, label: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores of training windows, each with the telling numbers for its label."""
    score = np.empty(len(label))
    for k in (0, 1):
        vectors, mine = network.inputs(vocabulary, tables[k]), np.flatnonzero(label == k)
        for at in range(0, len(mine), 4096):
            part = mine[at : at + 4096]
            index, mask = window_words(vocabulary.of, begin[part], size[part])
            score[part] = network.logits(vectors, index, mask)
    return score


def _cut(score: np.ndarray, label: np.ndarray) -> float:
    """The cut with fewest errors, in the middle of the widest such gap."""
    order = np.argsort(score, kind="stable")
    score, label = np.maximum(score[order], -50), label[order]
    errors = np.concatenate([[0], np.cumsum(label)]) + (label == 0).sum() - np.concatenate([[0], np.cumsum(label == 0)])
    edges = np.concatenate([[score[0] - 1], score, [score[-1] + 1]])
    gap = np.where(errors == errors.min(), edges[1:] - edges[:-1], -1)
    k = int(gap.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def fit_toxicity(documents: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> Network | None:
    """Train on the labelled rows where ``training`` (over ``doc_id``) holds."""
    ship_package(documents.sparkSession)
    known = plain(labels, "doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(training) if training is not None else known
    counts = dict(map(tuple, known.groupBy("toxic").count().collect()))  # two rows
    ticket = (F.xxhash64("doc_id") / F.lit(float(1 << 63)) + 1) / 2
    share = F.when(F.col("toxic") == 1, sample / max(1, counts.get(1, 0))).otherwise(sample / max(1, counts.get(0, 0)))
    chosen = known.where(ticket <= share)
    texts = plain(documents, "doc_id", "text").where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(chosen), "doc_id")
    rows = sorted(map(tuple, texts.select("doc_id", "toxic", "text").collect()))
    return train([r[2] for r in rows], [r[1] for r in rows])


def score_texts(df: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ``score`` (0 to 1) of every whole text."""
    ship_package(df.sparkSession)
    source = plain(df, id_column, text_column)
    kind = source.schema[id_column].dataType.simpleString()

    def score(batches):
        for batch in batches:
            found = np.zeros(len(batch))
            if network is not None:
                for at, to, data, offsets in slices(pc.utf8_lower(batch.column(1)), 1 << 19):
                    logit = network.text_logits(data, offsets)
                    found[at:to] = np.where(np.isfinite(logit), _sigmoid(logit), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_column, "score"])

    return source.mapInArrow(score, f"`{id_column}` {kind}, score double")
