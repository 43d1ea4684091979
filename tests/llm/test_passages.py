import random

import numpy as np

from pacelane.llm.passages import LEAST, RUN, WORDS, compact_windows, repeated_passages, verified
from pacelane.llm.words import U64


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(5)
    for length, least, top in ((200, 10, 10**6), (120, 7, 9), (60, 60, 100), (5, 8, 50)):
        hashes = rng.integers(1, top, length).astype(U64)
        hashes[rng.integers(0, length, 3)] = 0
        found = set(zip(*[x.tolist() for x in compact_windows(hashes, least)]))
        expected = set()
        for c in range(length):
            low = high = c
            while low > 0 and hashes[low - 1] > hashes[c]:
                low -= 1
            while high + 1 < length and hashes[high + 1] >= hashes[c]:
                high += 1
            if hashes[c] and high - low + 1 >= least:
                expected.add((c, low, high))
        assert found == expected


def test_every_long_enough_run_lies_in_one_window():
    hashes = np.random.default_rng(1).integers(1, 10**9, 90).astype(U64)
    windows = list(zip(*[x.tolist() for x in compact_windows(hashes, 20)]))
    for i in range(90):
        for j in range(i + 19, 90):
            assert sum(low <= i <= c <= j <= high for c, low, high in windows) == 1


def test_planted_passages(spark, docs):
    rng = random.Random(7)
    shared, near = words(rng, 51), words(rng, 120)
    line = words(rng, 12)
    rows = [(k, " ".join(line + words(rng, rng.choice([20, 90, 300])))) for k in range(100)]  # one short line in all of them
    for k in range(40):
        body = words(rng, rng.choice([0, 60, 200]))
        body[len(body) // 2 : len(body) // 2] = shared
        rows.append((1000 + k, " ".join(line + body)))
    for k in range(10):
        passage = list(near)
        passage[60] = f"changed{k}"
        rows.append((2000 + k, " ".join(words(rng, 30) + passage + words(rng, 30))))
    rows += [(3000, None), (3001, ""), (3002, " ".join(shared[:49])), (None, " ".join(shared)), (3003, "THE " * 100), (3004, "the " * 90), (3005, " ".join(words(rng, 20_000)).upper()), (3006, " ".join(near))]
    rows += [(3006, " ".join(near))]
    found = [r.asDict() for r in repeated_passages(docs(rows)).collect()]
    expected = {*range(1000, 1040), *range(2000, 2010), 3003, 3004, 3006}
    assert {r["doc_id"] for r in found} == expected
    texts = {i: (t or "").lower().split() for i, t in rows}
    for r in found:
        one = texts[r["doc_id"]][r["start_word"] : r["end_word"]]
        other = texts[r["partner"]][r["partner_start"] : r["partner_end"]]
        sets = [{tuple(p[k : k + RUN]) for k in range(len(p) - RUN + 1)} for p in (one, other)]
        assert min(len(one), len(other)) >= WORDS and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        assert r["doc_id"] != r["partner"] and r["n_words"] == len(one)
    for k in range(1000, 1040):
        assert any(r["doc_id"] == k and " ".join(shared) in " ".join(texts[k][r["start_word"] : r["end_word"]]) for r in found)


def test_nothing_to_find(spark, docs):
    assert repeated_passages(docs([])).count() == 0
    assert repeated_passages(docs([(1, " ".join(words(random.Random(1), 300)))])).count() == 0
    twice = " ".join(words(random.Random(2), 80))
    assert repeated_passages(docs([(1, f"{twice} x {twice}")])).count() == 0


def test_verification_needs_length_and_likeness():
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 1 << 60, LEAST).astype(U64)
    other = rng.integers(1, 1 << 60, 30).astype(U64)
    assert verified(passage, np.concatenate([other, passage]), [(3, 33)]) == [(0, LEAST - 1, 30, 30 + LEAST - 1, 1.0)]
    assert verified(passage[:-1], passage[:-1], [(3, 3)]) == []
    mixed = passage.copy()
    mixed[::3] = rng.integers(1, 1 << 60, len(mixed[::3]))
    assert verified(passage, mixed, [(1, 1)]) == []


def test_neighbouring_changes_stay_in_one_passage():
    rng = random.Random(21)
    number = {}

    def tokens(text):
        runs = [tuple(text[k : k + RUN]) for k in range(len(text) - RUN + 1)]
        return np.array([number.setdefault(r, len(number) + 1) for r in runs]).astype(U64)

    for length in (52, 58, 64, 70, 80, 90, 100):
        for changes in (1, 2, 3):
            for _ in range(30):
                passage = words(rng, length)
                at = rng.randrange(1, length - changes)
                mixed = passage[:at] + words(rng, changes) + passage[at + changes :]
                sides = [tokens(words(rng, 40) + p + words(rng, 40)) for p in (passage, mixed)]
                one, other = (s[40 : 40 + length - RUN + 1] for s in sides)
                places = 40 + np.flatnonzero(one == other)
                both = len(places)
                # brute force: the best of all pairs of begin and end that have the hit inside
                for hit in (int(places[0]), int(places[-1]), int(rng.choice(places.tolist()))):
                    wanted = 0
                    for i in places[places <= hit]:
                        for j in places[places >= hit]:
                            n, s = j - i + 1, int(((places >= i) & (places <= j)).sum())
                            if n >= LEAST and s >= 0.8 * (2 * n - s):
                                wanted = max(wanted, n)
                    found = verified(*sides, [(hit, hit)])
                    assert both and (max((f[1] - f[0] + 1 for f in found), default=0) >= wanted), (length, changes, at, hit)
                    assert all(f[4] >= 0.8 and f[0] <= hit <= f[1] for f in found)


def test_documents_whose_lead_fails_meet(spark, docs, monkeypatch):
    from pacelane.llm import passages

    rng = random.Random(33)
    rows, expected, passages_of = [], set(), {}
    for k in range(60):
        passage = passages_of[k] = words(rng, rng.choice([52, 60]))
        piece = passage[:44] if k % 3 else passage[-48:]
        if k % 3 == 0:
            expected.add(k)  # 44 shared tokens and two more: 0.92
        rows.append((k, " ".join(words(rng, 30) + piece + words(rng, 40))))
        rows += [(1000 + k + 100 * side, " ".join(words(rng, 50) + passage + words(rng, 20))) for side in (0, 1)]
        expected |= {1000 + k, 1100 + k}
    line = words(rng, 30)  # in many documents, and two of them share more
    rows += [(3000 + k, " ".join(words(rng, 60) + line + words(rng, 60))) for k in range(40)]
    more = words(rng, 30)
    rows += [(4000 + k, " ".join(words(rng, 20) + line + more + words(rng, 9))) for k in range(2)]
    # the lead has the run twice, first without the passage
    twice = words(rng, 60)
    rows += [(5000, " ".join(twice[10:40] + words(rng, 60) + twice)), (5001, " ".join(words(rng, 30) + twice))]
    expected |= {4000, 4001, 5000, 5001}
    frame = docs(rows)
    for block in (256, 8):
        monkeypatch.setattr(passages, "BLOCK", block)
        monkeypatch.setattr(passages, "TASK", 4 * block)
        found = repeated_passages(frame).collect()
        assert {r.doc_id for r in found} == expected
        texts = {i: t.split() for i, t in rows}
        for k, passage in passages_of.items():
            for i in (1000 + k, 1100 + k):
                assert any(" ".join(passage) in " ".join(texts[i][r.start_word : r.end_word]) for r in found if r.doc_id == i), i


def test_near_passages_at_the_threshold_are_found(spark, docs):
    rng = random.Random(34)
    rows = []
    for k in range(400):
        length, changes = rng.choice([(52, 1), (60, 1), (70, 2), (90, 2), (100, 3), (100, 2)])
        passage = words(rng, length)
        other = list(passage)
        at = rng.randrange(1, length - changes)
        other[at : at + changes] = words(rng, changes)
        rows += [(2 * k + side, " ".join(words(rng, 40) + p + words(rng, 40))) for side, p in enumerate((passage, other))]
        sets = [{tuple(p[i : i + RUN]) for i in range(len(p) - RUN + 1)} for p in (passage, other)]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    assert {r.doc_id for r in repeated_passages(docs(rows)).collect()} == set(range(800))


def test_signatures_group_stretches_that_share_all_minima():
    from pacelane.llm.passages import signatures, token_hashes

    rng = np.random.default_rng(9)
    for length, least, functions, top in ((150, 10, 2, 10**9), (90, 14, 3, 8), (40, 40, 2, 10**6), (9, 12, 2, 50)):
        tokens = rng.integers(1, top, length).astype(U64)
        tokens[rng.integers(0, length, 2)] = 0
        expected = set()
        for i in range(length - least + 1):
            if tokens[i : i + least].all():
                expected.add(tuple(i + int(np.argmin(token_hashes(tokens, f)[i : i + least])) for f in range(functions)))
        value, first, last = signatures(tokens, least, functions)
        assert {(min(c), max(c)) for c in expected} == set(zip(first.tolist(), last.tolist()))
        assert len(value) >= len(expected)


def test_equal_stretches_agree_on_a_signature():
    from pacelane.llm.passages import signatures

    rng = np.random.default_rng(10)
    for _ in range(50):
        shared = rng.integers(1, 10**12, 14).astype(U64)
        sides = [np.concatenate([rng.integers(1, 10**12, n).astype(U64), shared, rng.integers(1, 10**12, 30).astype(U64)]) for n in (5, 40)]
        one, other = (set(signatures(s, 14)[0].tolist()) for s in sides)
        assert one & other


def test_repeated_lines_in_long_texts_take_time_in_proportion():
    import time

    rng = random.Random(40)
    number = {}

    def tokens(text):
        return np.array([number.setdefault(tuple(text[k : k + RUN]), len(number) + 1) for k in range(len(text) - RUN + 1)]).astype(U64)

    line, seconds = words(rng, 30), []
    for total in (2_500, 20_000):
        one, other = ([w for _ in range(total // 40) for w in line + words(rng, 10)] for _ in range(2))
        passage = words(rng, 60)
        one[990:990], other[1510:1510] = passage, passage
        sides = tokens(one), tokens(other)
        begin = time.perf_counter()
        found = verified(*sides)
        seconds.append(time.perf_counter() - begin)
        assert [f for f in found if f[1] - f[0] >= 55 and f[0] <= 990 and f[1] >= 1045]
    assert seconds[1] < 16 * max(seconds[0], 0.2) and seconds[1] < 30
    # the line alone, over and over: one passage, not one for each pair of places
    again = tokens(line * 600)
    assert verified(again, again[: 30 * 400])[0][2:4] == (0, 30 * 400 - 1)


def test_a_repeated_line_leads_to_the_place_its_surroundings_name():
    rng = random.Random(41)
    number = {}

    def tokens(text):
        return np.array([number.setdefault(tuple(text[k : k + RUN]), len(number) + 1) for k in range(len(text) - RUN + 1)]).astype(U64)

    line = words(rng, 30)
    tails = [words(rng, 30) for _ in range(40)]
    one = [w for t in tails for w in line + t]
    other = words(rng, 70) + line + tails[23][:12] + words(rng, 1) + tails[23][13:] + words(rng, 70)
    found = verified(tokens(one), tokens(other))
    assert len(found) == 1 and found[0][0] <= 23 * 60 and found[0][1] >= 23 * 60 + 50


def test_a_line_said_over_and_over_with_one_other_word_costs_no_verification(monkeypatch):
    from pacelane.llm import passages
    from pacelane.llm.passages import Surroundings, _tokens, firm, partners

    rng = random.Random(43)
    line = words(rng, 31)
    texts = [" ".join((line[:9] + [f"x{k}"] + line[10:]) * 6) for k in range(30)]
    # a line of 46 words alone makes passages that do not end with shared tokens: one verification for each member will do
    long = words(rng, 46)
    beside = [" ".join(words(rng, 60) + long + words(rng, 60)) for _ in range(30)]
    calls, plain = [0], passages.verified

    def counted(*given):
        calls[0] += 1
        return plain(*given)

    monkeypatch.setattr(passages, "verified", counted)
    for group, at, bound in ((texts, 40, 0), (beside, 70, 31)):
        parts = [Surroundings(_tokens(t)) for t in group]
        calls[0], n = 0, len(parts)
        seeks = np.arange(2 * n) >= n
        found = partners(list(range(n)) * 2, seeks, [at] * (2 * n), parts * 2)
        assert calls[0] <= bound
        expected = []
        for k, own in enumerate(parts):
            met = [(o, plain(one.tokens, own.tokens)) for o, one in enumerate(parts) if o != k]
            best = [o for o, m in met if any(firm(parts[o].tokens, own.tokens, *f[:4]) for f in m)] or [o for o, m in met if m]
            expected += [(best[0], n + k)] if best else []
        assert sorted(found) == sorted(expected)
        assert bool(found) == (group is beside)


def test_bounds_on_a_passage_hold():
    from pacelane.llm.passages import Surroundings, _firmest

    rng = np.random.default_rng(12)
    for top in (60, 10**9):
        for _ in range(20):
            tokens = rng.integers(1, top, 70).astype(U64)
            shared = np.isin(tokens, rng.choice(np.unique(tokens), 30, replace=False))
            stretches = [slice(k, k + LEAST) for k in range(70 - LEAST + 1)]
            assert Surroundings(tokens).lost(shared[None])[0] == min(len(np.unique(tokens[s][~shared[s]])) for s in stretches)
            sums = [0.1 * shared[i:j].sum() - 0.8 * (~shared[i:j]).sum() for i in range(70) for j in range(i + LEAST, 71) if shared[i] and shared[j - 1]]
            assert abs(_firmest(shared[None], np.array([70]))[0] - max(sums, default=-np.inf)) < 1e-9 or not sums


def test_pointers_to_smaller_hashes_are_those_of_a_stack():
    from pacelane.llm.passages import _by_stack, _nearest_smaller

    import time

    rng = np.random.default_rng(14)
    for top in (3, 50, 10**9):
        value = rng.integers(1, top, 400).astype(U64)
        value[rng.integers(0, 400, 5)] = 0
        real = value > 0
        for step in (-1, 1):
            assert np.array_equal(_nearest_smaller(value, step)[real], _by_stack(value, step)[real])
    up = np.arange(1, 300_001).astype(U64)
    zigzag = np.where(np.arange(len(up)) % 2 == 0, up, up[::-1]).astype(U64)
    begin = time.perf_counter()
    for hashes in (up, up[::-1].copy(), zigzag):
        compact_windows(hashes, 1)
    assert time.perf_counter() - begin < 30
    # random hashes take no step of Python for each token
    hashes, calls = rng.integers(1, 1 << 60, 200_000).astype(U64), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += 1

    import sys

    sys.setprofile(count)
    try:
        compact_windows(hashes, 15)
    finally:
        sys.setprofile(None)
    assert calls < 5_000
