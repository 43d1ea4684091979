import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pacelane.llm import stars
from pacelane.llm.components import components
from pacelane.llm.neardup import band_rows, drop_near_copies, near_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(rows, width, threshold):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted((str(i), len(s), str(min(least[find(k)]) if least[find(k)] else i) if s else str(i)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def families(rng):
    rows, number = [], 100
    for family in range(6):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120, 300]))]
        for _ in range(25):
            rows.append((number, " ".join(edited(base, rng, rng.randrange(0, max(2, len(base) // 12))))))
            number += 1
    line = " ".join(f"common{k}" for k in range(20))  # texts that share half of their words and are not alike
    for _ in range(60):
        rows.append((number, f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(14))))
        number += 1
    chain = [f"c{k}" for k in range(200)]
    for _ in range(30):  # each a little farther from the first
        chain = edited(chain, rng, 2)
        rows.append((number, " ".join(chain)))
        number += 1
    return rows


@pytest.mark.parametrize(("width", "threshold"), [(3, 85), (5, 80)])
def test_groups_match_all_pairs(spark, docs, width, threshold):
    rows = families(random.Random(width))
    rng = random.Random(9)
    rows += [(1, "Exact COPY of a\tlittle text here"), (2, "exact copy  of a little text here"), (3, "two words"), (4, "TWO words"), (5, None), (6, ""), (7, " \n"), (7, "two words"), (None, "two words"), (None, None)]
    rng.shuffle(rows)
    found = near_groups(docs(rows), width, threshold)
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in found.collect()) == brute(rows, width, threshold)


def test_large_buckets_take_the_rounds_of_many_leads(spark, docs, monkeypatch):
    monkeypatch.setattr(stars, "SMALL", 3)
    rows = families(random.Random(1))
    found = near_groups(docs(rows), 3, 85)
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in found.collect()) == brute(rows, 3, 85)


def test_a_link_at_the_threshold_counts(spark, docs):
    # 17 of 20 shingles shared: 100 * 17 = 85 * 20
    rows = [(1, " ".join(f"a{k}" for k in range(20))), (2, " ".join(f"a{k}" for k in range(19)))]
    assert {r.component for r in near_groups(docs(rows), 3, 94).collect()} == {1}
    assert {r.component for r in near_groups(docs(rows), 3, 95).collect()} == {1, 2}


def test_one_of_each_group_stays(spark, docs):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(4, text), (2, text), (9, text + " end"), (7, "something else altogether, really new"), (7, "something else altogether, really new"), (8, None), (None, text)]
    frame = docs(rows)
    kept = drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "8", "None"]


def test_empty_table(spark, docs):
    assert near_groups(docs([])).count() == 0 and drop_near_copies(docs([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (129, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in [*range(100, 130), 300]} == {100} and 200 not in found


def test_bands_keep_links_at_the_threshold():
    for threshold in (80, 85, 95):
        assert (1 - (threshold / 100) ** band_rows(threshold)) ** 32 <= 1e-7


def test_nothing_is_expanded_into_pairs(spark, docs):
    base = [f"w{k}" for k in range(60)]
    rng = random.Random(3)
    rows = [(k, " ".join(edited(base, rng, 1))) for k in range(400)]
    assert near_groups(docs(rows), 3, 85).select(F.countDistinct("component")).first()[0] <= 3
