"""Repeated passages by compact windows.

A text is a sequence of tokens, the numbers of its runs of five words (words are runs without white space, ``A-Z``
in lower case).  A verified passage has at least ``WORDS`` words in both documents, and the sets of its tokens have a Jaccard
similarity of 0.8 or more.

Candidates come from the runs of ``MATCH`` words (equal neighbours are numbered).  Under a hash function, a compact window
``(l, c, r)`` stands for all subsequences that contain run ``c`` and lie in ``l..r``: ``c`` has the least hash in all of them.  The
windows are the nodes of the Cartesian tree over the hashes; those of at least ``REACH`` runs are kept.  Every stretch of ``REACH``
runs lies in one window of each of ``FUNCTIONS`` functions, so the windows of a function cut the starts of the stretches into
intervals.  Joining the intervals of all functions gives the groups of stretches that share a whole signature, one minimum for each
function.  Documents that share ``MATCH + REACH - 1`` words in a row agree on a signature, whatever the functions; documents that
share a shorter line agree only if every function has its minimum inside the line.
Passages of similarity 0.8 share as many: two sets of ``LEAST`` tokens share 41 at least, and between two shared stretches at
least 8 tokens are lost (4 on either side at a moved part, 9 at a word put in, 10 at a changed one), so with ``k`` breaks at least
``max(41, 32 k)`` tokens are shared in ``k + 1`` stretches, and one of them has ``STRETCH`` = 21 tokens or more.  (Passages in
which tokens repeat may share less.)

Documents that share a signature are first verified with the smallest one, so a passage that many documents share costs one
pair for each.  Where the minima of a document then lie in no verified passage that begins and ends with shared tokens, it meets every other
document of that signature, in blocks of which two meet in one task; each names one partner, verified again on the whole texts.
Verification takes time in proportion to the texts, also where a line repeats: every maximal stretch of ``STRETCH`` shared tokens
is tried once, with the other text's places that tokens around it single out.
A passage's row names one document it repeats; that document has a row of its own.

Null and empty texts and texts with fewer than ``WORDS`` words have no passage.  Rows that share an id count as one document;
rows with a null id cannot be named and are left out.  A passage that repeats only inside one document is not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle, ship_package
from pacelane.llm.words import U64, Words, find_words, mix, shingle_codes, slices

RUN = 5
WORDS = 50
LEAST = WORDS - RUN + 1
"""Tokens of the shortest passage."""
STRETCH = 21
"""Tokens that passages of similarity 0.8 share in a row."""
MATCH = 12
"""Words of the runs that make candidates."""
REACH = STRETCH + RUN - MATCH
"""Runs of a shared stretch, and of the shortest window."""
SIMILAR = 0.8
GAP = RUN + 1
"""Tokens between two shared ones of a passage whose parts may lie in any order: one changed word spoils five."""
AROUND = 2 * WORDS
FUNCTIONS = 2
"""Hash functions whose minima make a signature."""
ROUNDS = 512
"""Rounds after which pointers to smaller hashes are found one by one; a round costs little once few pointers are left."""
BLOCK = 256
"""Members of a block that meets others in one task."""
TASK = 2048
"""Members in one task."""


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every run of ``width`` values."""
    part, have = values, 1
    while 2 * have <= width:
        part = pick(part[:-have], part[have:])
        have *= 2
    n = len(values) - width + 1
    return pick(part[:n], part[width - have : width - have + n])


def compact_windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, first and last token of every compact window of at least ``least`` tokens; zeros separate texts.

    Of equal hashes the first counts as the smaller one.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < least:
        return none, none, none
    low = _sliding(hashes, least, np.minimum)
    padded = np.concatenate([np.zeros(least - 1, U64), low, np.zeros(least - 1, U64)])
    centre = np.flatnonzero((_sliding(padded, least, np.maximum) == hashes) & (hashes > 0))
    if not len(centre):
        return none, none, none
    # the Cartesian tree over the centres and the separators
    places = np.concatenate([centre, np.flatnonzero(hashes == 0)])
    places.sort()
    value = hashes[places]
    kept = np.concatenate([places, [len(hashes), -1]])
    before = kept[_nearest_smaller(value, -1)]
    after = kept[_nearest_smaller(value, 1)]
    real = (value > 0) & (after - before - 1 >= least)
    return places[real], before[real] + 1, after[real] - 1


def _nearest_smaller(value: np.ndarray, step: int) -> np.ndarray:
    """For each value but zeros the nearest before it (``step`` -1; -1 if none) that is not greater, or after it (1; the count if none) that is less.

    What lies between a place and its pointer is not smaller, so a pointer to a greater value may take that value's own pointer:
    pointers double their reach.  Values in an order that needs many rounds go through a stack instead."""
    pointer, seeking = np.arange(len(value)) + step, np.flatnonzero(value)
    greater = np.greater if step < 0 else np.greater_equal
    rounds = 0
    while len(seeking):
        if (rounds := rounds + 1) > ROUNDS:
            return _by_stack(value, step)
        at = pointer[seeking]
        inside = (at >= 0) & (at < len(value))
        seeking, at = seeking[inside], at[inside]
        far = greater(value[at], value[seeking])
        seeking = seeking[far]
        pointer[seeking] = pointer[at[far]]
    return pointer


def _by_stack(value: np.ndarray, step: int) -> np.ndarray:
    """``_nearest_smaller`` one value after another."""
    values, pointer, stack = value.tolist(), [], []
    for k in range(len(values)) if step < 0 else range(len(values) - 1, -1, -1):
        v = values[k]
        while stack and (values[stack[-1]] > v or step > 0 and values[stack[-1]] == v):
            stack.pop()
        pointer.append(stack[-1] if stack else -1 if step < 0 else len(values))
        stack.append(k)
    return np.array(pointer[::-step], np.int64)


def token_hashes(codes: np.ndarray, function: int = 0) -> np.ndarray:
    """Hash of every token under a function, never zero; 0 stays 0."""
    return np.where(codes == 0, U64(0), mix((codes + U64(function)) * U64(0x9E3779B97F4A7C15)) | U64(1))


def signatures(tokens: np.ndarray, least: int, functions: int = FUNCTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, first and last of its minima's places, of every group of stretches of ``least`` tokens that share all minima.

    A window ``(l, c, r)`` holds the stretches that start in ``max(l, c - least + 1)..min(c, r - least + 1)``; the windows of a function hold
    every stretch once, so the interval join over all functions is one pass over the sorted begins.
    """
    begins, minima = [], []
    for function in range(functions):
        hashes = token_hashes(tokens, function)
        centre, left, right = compact_windows(hashes, least)
        begins.append(np.maximum(left, centre - least + 1))
        minima.append((centre, np.minimum(centre, right - least + 1), hashes))
    starts = np.unique(np.concatenate(begins))
    value = np.zeros(len(starts), U64)
    first, last = np.full(len(starts), len(tokens)), np.zeros(len(starts), np.int64)
    for begin, (centre, _, hashes) in zip(begins, minima, strict=True):
        order = np.argsort(begin, kind="stable")
        at = centre[order[np.searchsorted(begin[order], starts, side="right") - 1]] if len(starts) else starts
        value = mix(value * U64(0xD6E8FEB86659FD93) + hashes[at])
        first, last = np.minimum(first, at), np.maximum(last, at)
    return value, first, last


def told_apart(tokens: np.ndarray) -> np.ndarray:
    """Tokens with equal neighbours numbered along the run, so a word said over and over has more than one token."""
    again = np.zeros(len(tokens), bool)
    again[1:] = (tokens[1:] == tokens[:-1]) & (tokens[1:] != 0)
    if not again.any():
        return tokens
    place = np.arange(len(tokens))
    along = place - np.maximum.accumulate(np.where(again, 0, place))
    return np.where(along > 0, mix(tokens + along.astype(U64) * U64(0xD6E8FEB86659FD93)) | U64(1), tokens)


def window_rows(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``value`` (signature), ``doc``, ``place`` and ``stop`` (first word of the first minimum, end of the last) of every group of stretches."""
    ship_package(df.sparkSession)
    source = plain(df, id_column, text_column).where(F.col(f"`{id_column}`").isNotNull() & (F.octet_length(F.col(f"`{text_column}`")) >= 2 * WORDS - 1))
    kind = source.schema[id_column].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for first, to, data, offsets in slices(batch.column(1)):
                words = find_words(data, offsets)
                if len(words.code) < WORDS:
                    continue
                # a token for every word, 0 where the run would leave the text
                tokens = np.zeros(len(words.code) + 1, U64)
                tokens[: max(0, len(words.code) - MATCH + 1)] = shingle_codes(words.code, MATCH) | U64(1)
                last = words.first[1:]
                for k in range(1, MATCH):
                    tokens[np.maximum(last - k, 0)] = 0
                value, low, high = signatures(told_apart(tokens), REACH)
                text = words.text[low]
                docs = batch.column(0).take(pa.array(text + first))
                place, stop = (pa.array((x - words.first[text]).astype(np.int32)) for x in (low, high + MATCH))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), docs, place, stop], ["value", "doc", "place", "stop"])

    return source.mapInArrow(cut, f"value long, doc {kind}, place int, stop int")


def shared_windows(rows: DataFrame) -> DataFrame:
    """The rows whose signature several documents have, with ``lead``, the smallest of these."""
    leads = rows.groupBy("value").agg(F.min("doc").alias("lead"), F.max("doc").alias("other")).where("lead <> other").select("value", "lead")
    return settle(rows.join(leads, "value"))


def lead_pairs(shared: DataFrame) -> DataFrame:
    """``lead`` and ``doc`` of every document and the leads of its signatures, and the words between which these lie in either."""
    heads = shared.where("doc = lead").groupBy("value").agg(F.min("place").alias("lead_low"), F.max("stop").alias("lead_high"))
    met = shared.where("doc <> lead").join(heads, "value")
    return met.groupBy("lead", "doc").agg(F.min("lead_low").alias("lead_low"), F.max("lead_high").alias("lead_high"), F.min("place").alias("low"), F.max("stop").alias("high"))


def _cut_members(pairs: DataFrame) -> DataFrame:
    """Of each member's ``text`` only the words around its signatures, from word ``base`` on."""

    def cut(batches):
        for batch in batches:
            low, high = (batch.column(k).to_numpy() for k in (4, 5))
            bases, texts, at = [], [], 0
            for _, _, data, offsets in slices(batch.column(6)):
                words = find_words(data, offsets)
                for k in range(len(offsets) - 1):
                    base, text = _around(words, k, int(low[at]), int(high[at]) - MATCH)
                    bases.append(base)
                    texts.append(text)
                    at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bases, pa.int32()), pa.array(texts, pa.string())], names)

    names = ["lead", "doc", "lead_low", "lead_high", "base", "part"]
    kind = pairs.schema["doc"].dataType.simpleString()
    return pairs.select("lead", "doc", "lead_low", "lead_high", "low", "high", "text").mapInArrow(cut, f"lead {kind}, doc {kind}, lead_low int, lead_high int, base int, part string")


def _around(words: Words, k: int, least: int, most: int) -> tuple[int, str]:
    """First word and text of the words of text ``k`` around the places from ``least`` to ``most``."""
    first, last = words.first[k], words.first[k + 1]
    if last <= first:
        return 0, ""
    low = min(max(first, first + least - AROUND), last - 1)
    high = max(low + 1, min(last, first + most + AROUND + MATCH))
    return int(low - first), words.data[words.start[low] : words.end[high - 1]].tobytes().decode("utf-8", "replace")


def _tokens(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_codes(find_words(data, np.array([0, len(data)])).code, RUN)


def _tokens_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Tokens of every text, found slice by slice."""
    for _, _, data, offsets in slices(texts):
        words = find_words(data, offsets)
        codes = shingle_codes(words.code, RUN)
        ends = np.maximum(words.first[1:] - RUN + 1, words.first[:-1])
        for low, high in zip(words.first[:-1].tolist(), ends.tolist(), strict=True):
            yield codes[low:high]


def _region(shared: np.ndarray, place: int) -> tuple[int, int]:
    """First and last shared token around the shared token ``place`` without a longer gap than ``GAP``."""
    places = np.flatnonzero(shared)
    cuts = np.flatnonzero(places[1:] - places[:-1] > GAP)
    k = int(np.searchsorted(places[cuts], place))
    return int(places[cuts[k - 1] + 1]) if k else int(places[0]), int(places[cuts[k]]) if k < len(cuts) else int(places[-1])


def _likeness(one: np.ndarray, other: np.ndarray) -> float:
    one, other = _distinct(one), _distinct(other)
    both = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return both / (len(one) + len(other) - both)


def _distinct(tokens: np.ndarray) -> np.ndarray:
    ranked = np.sort(tokens)
    kept = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=kept[1:])
    return ranked[kept]


def _nearest(one: np.ndarray, other: np.ndarray) -> tuple[int, int] | None:
    """Places of equal tokens with the least sum, of several such the smallest token's; None if no token is equal."""
    if len(one) * len(other) <= 1 << 15:
        at, there = np.nonzero(one[:, None] == other[None, :])
        if not len(at):
            return None
        total = at + there
        least = np.flatnonzero(total == total.min())
        k = least[int(np.argmin(one[at[least]]))]
    else:
        _, at, there = np.intersect1d(one, other, return_indices=True)
        if not len(at):
            return None
        k = int(np.argmin(at + there))
    return int(at[k]), int(there[k])


def _chain(lead: np.ndarray, part: np.ndarray, a: int, b: int, shared: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in ``lead``, in ``part``) where the passage around equal tokens ``a`` and ``b`` may end, in the direction of ``step``, the
    score up to there and where the equal run begins that ends there: 0.2 for a shared token, -0.8 for a token of either side between; a passage of score 0 has a similarity of 0.8.

    ``shared``: running count of the tokens of ``lead`` that ``part`` has.  The chain goes on while the shared tokens still to come could pay.
    """
    rise, fall = 1 - SIMILAR, SIMILAR
    beside = int(shared[a] if step > 0 else shared[-1] - shared[a + 1])
    ends, scores, begins, score = [], [], [], 0.0
    while True:
        length = min(len(lead) - a, len(part) - b) if step > 0 else min(a, b) + 1
        equal = lead[a : a + length] == part[b : b + length] if step > 0 else lead[a - length + 1 : a + 1][::-1] == part[b - length + 1 : b + 1][::-1]
        run = length if equal.all() else int(np.argmin(equal))
        begins.append((a, b))
        a, b, score = a + step * (run - 1), b + step * (run - 1), score + rise * run
        ends.append((a, b))
        scores.append(score)
        # the nearest equal tokens beyond, by the tokens passed over on both sides
        left = int(shared[-1] - shared[a + 1] if step > 0 else shared[a])
        most = int((score + rise * (left + beside)) / fall + 1e-6)
        one = lead[a + 1 : a + 2 + most] if step > 0 else lead[max(0, a - 1 - most) : a][::-1]
        other = part[b + 1 : b + 2 + most] if step > 0 else part[max(0, b - 1 - most) : b][::-1]
        near, nearest = most + 1, None
        for reach in (4 * RUN, 32 * RUN, most + 1):
            nearest = _nearest(one[:reach], other[:reach])
            if nearest is not None:
                near = sum(nearest)
                if near <= reach:
                    break
        if nearest is None or near > most:
            return np.array(ends), np.array(scores), np.array(begins)
        a, b, score = a + step * (nearest[0] + 1), b + step * (nearest[1] + 1), score - fall * near


def _grown(lead: np.ndarray, part: np.ndarray, a: int, b: int, shared: np.ndarray) -> tuple[tuple[int, int, int, int], np.ndarray, np.ndarray]:
    """The longest passage in one order around equal tokens whose similarity, if no token repeats, is 0.8 or more.

    It begins and ends with shared tokens, unless it would be too short.  Also: begin and end of the equal runs it was chosen from."""
    back, before, back_from = _chain(lead, part, a, b, shared, -1)
    ahead, after, ahead_from = _chain(lead, part, a, b, shared, 1)
    starts, stops = np.concatenate([back[::-1], ahead_from[1:]]), np.concatenate([back_from[:0:-1], ahead])
    # for each begin the farthest end that leaves a score of 0; the tokens at the hit count twice
    twice = (1 - SIMILAR) - 1e-9
    most = np.maximum.accumulate(after[::-1])[::-1]
    farthest = len(most) - 1 - np.searchsorted(most[::-1], twice - before)
    length = np.where(farthest >= 0, (ahead[farthest] - back).min(axis=1), -1)
    k = int(np.argmax(length))
    if length[k] + 1 >= LEAST:
        return (int(back[k, 0]), int(ahead[farthest[k], 0]), int(back[k, 1]), int(ahead[farthest[k], 1])), starts, stops
    # too short: with lost tokens at the ends
    back, before = back[back[:, 0] > a - LEAST], before[back[:, 0] > a - LEAST]
    ahead, after = ahead[ahead[:, 0] < a + LEAST], after[ahead[:, 0] < a + LEAST]
    lacking = np.maximum(0, LEAST - 1 - (ahead[None, :, :] - back[:, None, :]))
    score = before[:, None] + after[None, :] - SIMILAR * lacking.sum(axis=2)
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    if score[i, j] < twice:
        return (a, a, b, b), starts, stops
    ends = []
    for side, size in enumerate((len(lead), len(part))):
        low = max(0, int(back[i, side] - lacking[i, j, side]))
        high = min(size - 1, max(int(ahead[j, side]), low + LEAST - 1))
        ends += [low, high]
    return tuple(ends), starts, stops


def _within(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which values of ``one`` are in ``other``."""
    ranked = np.sort(other)
    return ranked[np.minimum(np.searchsorted(ranked, one), len(ranked) - 1)] == one


def _once(tokens: np.ndarray) -> bool:
    ranked = np.sort(tokens)
    return not (ranked[1:] == ranked[:-1]).any()


def _bound(shared: np.ndarray, a: int, run: int) -> float:
    """The most that one side adds to the score of a passage that holds ``run`` shared tokens from ``a`` on: 0.1 for a shared token, -0.8
    for a lost one; a similarity of 0.8 without repeated tokens needs a sum of 0 over both sides."""
    sums = np.zeros(len(shared) + 1)
    np.cumsum(np.where(shared, (1 - SIMILAR) / 2, -SIMILAR), out=sums[1:])
    begins = np.arange(a + 1)
    stop = np.maximum(a + run, begins + LEAST)
    begins, stop = begins[stop < len(sums)], stop[stop < len(sums)]
    if not len(begins):
        return -np.inf
    after = np.maximum.accumulate(sums[::-1])[::-1]
    return float((after[stop] - sums[begins]).max())


def _passage(lead: np.ndarray, part: np.ndarray, a: int, b: int, run: int) -> tuple[int, int, int, int, float] | None:
    """The passage around ``run`` equal tokens from places ``a`` and ``b`` on that reaches ``AROUND`` tokens farther at most on either end."""
    lead_from, part_from = max(0, a - AROUND), max(0, b - AROUND)
    one, other = lead[lead_from : a + run + AROUND], part[part_from : b + run + AROUND]
    a, b = a - lead_from, b - part_from
    if len(one) == run == len(other):
        return (lead_from, lead_from + run - 1, part_from, part_from + run - 1, 1.0) if run >= LEAST else None
    in_other, in_one = _within(one, other), _within(other, one)
    if run < LEAST and in_other[a] and _bound(in_other, a, run) + _bound(in_one, b, run) < -1e-6 and _once(one) and _once(other):
        return None
    grown, _, _ = _grown(one, other, a, b, np.concatenate([[0], np.cumsum(in_other)]))
    (a0, a1), (b0, b1) = _region(in_other, a), _region(in_one, b)
    # neither side reaches farther from the place than the other, but for a few edits
    a0, a1 = max(a0, a - (b - b0) - 4 * RUN), min(a1, a + (b1 - b) + 4 * RUN)
    b0, b1 = max(b0, b - (a - a0) - 4 * RUN), min(b1, b + (a1 - a) + 4 * RUN)
    options = {(a0, a1, b0, b1), grown, (a, a + run - 1, b, b + run - 1)}
    for a0, a1, b0, b1 in sorted(options, key=lambda o: (-min(o[1] - o[0], o[3] - o[2]), o)):
        if min(a1 - a0, b1 - b0) + 1 < LEAST:
            return None
        like = _likeness(one[a0 : a1 + 1], other[b0 : b1 + 1])
        if like >= SIMILAR:
            return a0 + lead_from, a1 + lead_from, b0 + part_from, b1 + part_from, like
    return None


def _equal_run(one: np.ndarray, other: np.ndarray) -> int:
    """How many tokens are equal from the first on; time in proportion to the answer."""
    at, step, size = 0, 64, min(len(one), len(other))
    while at < size:
        differ = one[at : min(size, at + step)] != other[at : min(size, at + step)]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = at + step, 2 * step
    return size


def _search(lead: np.ndarray, part: np.ndarray, codes: np.ndarray, own: np.ndarray, known_lead: np.ndarray, known: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages of ``part`` in ``lead`` around its stretches of shared tokens (their numbers: ``codes`` and ``own``) that are not ``known`` yet."""
    if not len(codes) or not len(own):
        return []
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    low, high = np.searchsorted(ranked, own), np.searchsorted(ranked, own, side="right")
    # of one word over and over the first and the last stretch stand for those between
    same = own[1:] == own[:-1]
    between = np.zeros(len(own), bool)
    between[1:-1] = same[1:] & same[:-1]
    places = np.flatnonzero((high > low) & ~between)
    if not len(places):
        return []
    found, k, single = [], 0, None
    while k < len(places):
        b = int(places[k])
        options = order[low[b] : high[b]]
        tries = [int(options[0])]
        if len(options) > 1:
            if single is None:
                # place of every token of ``part`` that ``lead`` has once, else -1
                tokens, first, often = np.unique(lead, return_index=True, return_counts=True)
                where = np.minimum(np.searchsorted(tokens, part), len(tokens) - 1)
                single = np.where((tokens[where] == part) & (often[where] == 1), first[where], -1)
            # the places nearest to where the single tokens around point
            around = np.arange(max(0, b - LEAST), min(len(part), b + STRETCH + LEAST))
            around = around[single[around] >= 0]
            wanted = np.unique(single[around] - around + b)
            after = np.searchsorted(options, wanted)
            tries += options[np.unique(np.concatenate([np.minimum(after, len(options) - 1), np.maximum(after - 1, 0)]))].tolist() if len(wanted) else []
        longest = 0
        for a in dict.fromkeys(tries):
            run = _equal_run(lead[a:], part[b:])
            longest = max(longest, run)
            if known[b : b + run].all() and known_lead[a : a + run].all():
                break
            back = _equal_run(lead[max(0, a - AROUND) : a][::-1], part[max(0, b - AROUND) : b][::-1])
            passage = _passage(lead, part, a - back, b - back, run + back)
            if passage is not None:
                found.append(passage)
                known_lead[passage[0] : passage[1] + 1] = known[passage[2] : passage[3] + 1] = True
                break
        # stretches that begin inside the run and end in it are done
        k = int(np.searchsorted(places, b + longest - STRETCH + 1))
    return found


def _joined(lead: np.ndarray, part: np.ndarray, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Passages that overlap in both texts as one, where the whole is similar enough."""
    out: list[tuple[int, int, int, int, float]] = []
    group: list[tuple[int, int, int, int, float]] = []

    def close():
        if len(group) > 1:
            a0, a1, b0, b1 = min(g[0] for g in group), max(g[1] for g in group), min(g[2] for g in group), max(g[3] for g in group)
            like = _likeness(lead[a0 : a1 + 1], part[b0 : b1 + 1])
            out.extend([(a0, a1, b0, b1, like)] if like >= SIMILAR else group)
        else:
            out.extend(group)

    for passage in sorted(found, key=lambda f: (f[2], f[0])):
        if group and passage[2] <= group[-1][3] + 1 and group[-1][0] <= passage[0] <= group[-1][1] + 1:
            group.append(passage)
        else:
            close()
            group = [passage]
    close()
    return out


def verified(lead: np.ndarray, part: np.ndarray, hits: list[tuple] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages of two token sequences: from and to (tokens) in either, and their likeness.

    ``hits`` (a place in ``lead``, a place in ``part``): only passages that hold one of them, in both, are returned.
    """
    if LEAST <= len(lead) == len(part) and (lead == part).all():
        found = [(0, len(lead) - 1, 0, len(part) - 1, 1.0)]
    else:
        known_lead, known_part = np.zeros(len(lead), bool), np.zeros(len(part), bool)
        codes, own = shingle_codes(lead, STRETCH), shingle_codes(part, STRETCH)
        found = _search(lead, part, codes, own, known_lead, known_part)
        found += [(a0, a1, b0, b1, like) for b0, b1, a0, a1, like in _search(part, lead, own, codes, known_part, known_lead)]
        found = _joined(lead, part, found)
    if hits is not None:
        found = [f for f in found if any(f[0] <= a <= f[1] and f[2] <= b <= f[3] for a, b in hits)]
    return found


def firm(lead: np.ndarray, part: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> bool:
    """Whether a passage begins and ends with shared tokens."""
    one, other = lead[a0 : a1 + 1], part[b0 : b1 + 1]
    return bool((other == one[0]).any() and (other == one[-1]).any() and (one == other[0]).any() and (one == other[-1]).any())


def _verify(pairs: DataFrame, texts: DataFrame, id_column: str) -> DataFrame:
    """Passages of the pairs (``lead``, ``doc`` and the words between which they may lie), a row for either document."""
    kind = texts.schema[id_column].dataType.simpleString()
    members = _cut_members(pairs.join(texts.toDF("doc", "text"), "doc"))
    joined = members.join(texts.toDF("lead", "text"), "lead").select("lead", "doc", "lead_low", "lead_high", "base", "part", "text")

    def verify(batches):
        last, tokens = None, np.zeros(0, U64)
        for batch in batches:
            rows = []
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)]
            for lead, doc, low, high, base, text, own in zip(*columns, _tokens_of(batch.column(5)), strict=True):
                if (lead, text) != last:
                    last, tokens = (lead, text), _tokens(text)
                low = max(0, low - AROUND)
                some = tokens[low : max(0, high) + AROUND]
                for a0, a1, b0, b1, like in verified(some, own):
                    whole = firm(some, own, a0, a1, b0, b1)
                    one, other = (a0 + low, a1 + low + RUN), (b0 + base, b1 + base + RUN)
                    rows.append((doc, *other, lead, *one, like, whole))
                    rows.append((lead, *one, doc, *other, like, whole))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    names = [id_column, "start_word", "end_word", "partner", "partner_start", "partner_end", "similarity", "firm"]
    schema = f"`{id_column}` {kind}, start_word long, end_word long, partner {kind}, partner_start long, partner_end long, similarity double, firm boolean"
    return joined.mapInArrow(verify, schema)


def open_members(shared: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """Members (``value``, ``doc``, ``place``, ``stop``, ``open``, ``size``, ``sought``) of the signatures at which some member, ``open``, is in no firm passage ``found`` for it.

    A signature has ``size`` members, of which partners are ``sought`` for so many.

    The lead has met all others and is left out.
    """
    spans = found.where("firm").groupBy(F.col(f"`{id_column}`").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start_word"] <= F.col("place")) & (F.col("stop") <= s["end_word"]))
    members = shared.where("doc <> lead").join(spans, "doc", "left").select("value", "doc", "place", "stop", (~F.coalesce(inside, F.lit(False))).alias("open"))
    sizes = members.groupBy("value").agg(F.count("*").alias("size"), F.sum(F.col("open").cast("int")).alias("sought"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    return settle(members.join(sizes.where("sought > 0 AND low <> high").select("value", "size", "sought"), "value"))


def _contexts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The members with ``part``, the words around, in which ``at`` is the place."""
    kind = texts.schema.fields[0].dataType.simpleString()
    listed = members.groupBy("doc").agg(F.collect_list(F.struct("value", "place", "open", "size", "sought")).alias("windows"))

    def cut(batches):
        for batch in batches:
            windows, at = batch.column(1).to_pylist(), 0
            for _, _, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets)
                for k in range(len(offsets) - 1):
                    rows = []
                    for w in windows[at]:
                        base, text = _around(words, k, w["place"], w["place"])
                        rows.append((w["value"], w["place"], w["open"], w["size"], w["sought"], w["place"] - base, text))
                    docs = batch.column(0).take(pa.array(np.full(len(rows), at)))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs, *columns], ["doc", "value", "place", "open", "size", "sought", "at", "part"])
                    at += 1

    return listed.join(texts.toDF("doc", "text"), "doc").select("doc", "windows", "text").mapInArrow(cut, f"doc {kind}, value long, place long, open boolean, size long, sought long, at long, part string")


def _fewest(tokens: np.ndarray) -> int:
    """Distinct tokens of the stretch of ``LEAST`` tokens that has fewest; more than any if there is none."""
    if len(tokens) < LEAST:
        return 2 * AROUND + LEAST
    order = np.argsort(tokens, kind="stable")
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    previous = np.full(len(tokens), -1)
    previous[order[again + 1]] = order[again]
    windows = np.lib.stride_tricks.sliding_window_view(previous, LEAST)
    return int((windows < np.arange(len(windows))[:, None]).sum(axis=1).min())


def _promising(shared: np.ndarray, centre: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The most that one side adds to the score of a passage around ``centre``: 0.1 for a shared token and -0.8 for a lost one; a
    similarity of 0.8 without repeated tokens needs a sum of 0 over both sides.  Rows are pairs."""
    place = np.arange(shared.shape[1] + 1)
    sums = np.zeros((len(shared), shared.shape[1] + 1))
    np.cumsum(np.where(shared, (1 - SIMILAR) / 2, -SIMILAR), axis=1, out=sums[:, 1:])
    after = np.where(place[None, :] <= size[:, None], sums, -np.inf)
    after = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
    stop = np.maximum(centre[:, None] + 1, place[None, :] + LEAST)
    best = np.where(stop <= size[:, None], np.take_along_axis(after, np.minimum(stop, shared.shape[1]), axis=1), -np.inf) - sums
    return np.where(place[None, :] <= centre[:, None], best, -np.inf).max(axis=1)


def _firmest(shared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The most that one side adds to the score of a passage that begins and ends with shared tokens, wherever it lies; as ``_promising``."""
    place = np.arange(shared.shape[1] + 1)
    sums = np.zeros((len(shared), shared.shape[1] + 1))
    np.cumsum(np.where(shared, (1 - SIMILAR) / 2, -SIMILAR), axis=1, out=sums[:, 1:])
    after = np.full(sums.shape, -np.inf)
    after[:, 1:] = np.where(shared & (place[None, 1:] <= size[:, None]), sums[:, 1:], -np.inf)
    after = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
    if shared.shape[1] < LEAST:
        return np.full(len(shared), -np.inf)
    begins = shared.shape[1] - LEAST + 1
    return np.where(shared[:, :begins], after[:, LEAST:] - sums[:, :begins], -np.inf).max(axis=1)


class Surroundings:
    """Tokens of a text part, the distinct ones, and the fewest of these that a passage in it may have."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.distinct = np.unique(self.tokens)
        self.once = len(self.distinct) == len(self.tokens)
        # a passage has as many distinct tokens as some stretch of its least length, and shares four of five
        self.fewest = LEAST if self.once and len(self.tokens) >= LEAST else _fewest(self.tokens)
        self.least = int(np.ceil(SIMILAR * self.fewest - 1e-9))
        self._counts: np.ndarray | None = None

    def lost(self, shared: np.ndarray) -> np.ndarray:
        """Distinct tokens without a like that any passage holds at least; rows of ``shared`` tell which tokens have one."""
        if self._counts is None:
            # which tokens are the first of their kind in which stretch of the least length
            order = np.argsort(self.tokens, kind="stable")
            again = np.flatnonzero(self.tokens[order[1:]] == self.tokens[order[:-1]])
            previous = np.full(len(self.tokens), -1)
            previous[order[again + 1]] = order[again]
            begin, place = np.arange(len(self.tokens) - LEAST + 1), np.arange(len(self.tokens))[:, None]
            self._counts = ((begin > previous[:, None]) & (begin <= place) & (place < begin + LEAST)).astype(np.float32)
        return ((~shared).astype(np.float32) @ self._counts).min(axis=1)


def partners(docs: list, seeks: np.ndarray, at: list[int], parts: list[Surroundings]) -> list[tuple[int, int]]:
    """For every member of a cell that ``seeks`` the smallest other document's member (this, then the seeking one) that it has a
    passage with, if there is one a passage that begins and ends with shared tokens.

    Those that seek are compared with those that do not.  Equal surroundings are judged once.
    """
    known: dict = {}
    look = [known.setdefault((id(p), place), len(known)) for p, place in zip(parts, at, strict=True)]
    firsts = {k: m for m, k in reversed(list(enumerate(look)))}
    kinds = [parts[firsts[k]] for k in range(len(known))]
    centres = np.array([at[firsts[k]] for k in range(len(known))])
    look = np.array(look)
    seeking = np.unique(look[seeks])
    row = {int(k): r for r, k in enumerate(seeking)}
    # shared distinct tokens of the open kinds and all others
    owner = np.repeat(np.arange(len(kinds)), [len(k.distinct) for k in kinds])
    sorted_tokens, token, often = np.unique(np.concatenate([k.distinct for k in kinds]), return_inverse=True, return_counts=True)
    held = np.zeros((len(kinds), len(sorted_tokens) + 1), bool)
    held[owner, token] = True
    use = np.flatnonzero(held[seeking, :-1].any(axis=0) & (often > 1))
    both = np.zeros((len(seeking), len(kinds)), np.float32)
    for first in range(0, len(use), 4096):
        matrix = held[:, use[first : first + 4096]].astype(np.float32)
        both += matrix[seeking] @ matrix.T
    np.put_along_axis(both, seeking[:, None], np.array([len(kinds[k].distinct) for k in seeking], np.float32)[:, None], axis=1)
    least, fewest = np.array([k.least for k in kinds]), np.array([k.fewest for k in kinds])
    hopeful = (both >= least[None, :]) & (both >= least[seeking][:, None])
    given = np.zeros(len(kinds), bool)
    given[look[~seeks]] = True
    hopeful &= given
    # of one document alone
    holders: list[set] = [set() for _ in kinds]
    for doc, k in zip(docs, look.tolist(), strict=True):
        holders[k].add(doc)
    alone = np.array([len(h) == 1 for h in holders])[seeking]
    hopeful[np.flatnonzero(alone), seeking[alone]] = False
    # no passage has more shared tokens than the parts, or fewer distinct ones
    hopeful &= both * (1 + SIMILAR) >= SIMILAR * (fewest[None, :] + fewest[seeking][:, None]) - 1e-3
    if not hopeful.any():
        return []
    hoping = hopeful.any(axis=1)
    needed = hopeful.any(axis=0)
    needed[seeking[hoping]] = True
    places = np.full((len(kinds), max(len(k.tokens) for k in kinds) + 1), len(sorted_tokens))
    for k in np.flatnonzero(needed):
        places[k, : len(kinds[k].tokens)] = np.searchsorted(sorted_tokens, kinds[k].tokens)
    size, once = np.array([len(k.tokens) for k in kinds]), np.array([k.once for k in kinds])
    may_be_firm = np.ones(hopeful.shape, bool)
    for r, k in zip(np.flatnonzero(hoping).tolist(), seeking[hoping].tolist(), strict=True):
        some = np.flatnonzero(hopeful[r] & once) if once[k] else np.zeros(0, np.int64)
        if len(some):
            mine = _promising(held[some][:, places[k]], np.full(len(some), centres[k]), np.full(len(some), size[k]))
            theirs = _promising(held[k][places[some]], centres[some], size[some])
            hopeful[r, some] = mine + theirs >= -1e-6
            some = some[hopeful[r, some]]
        if len(some):
            mine = _firmest(held[some][:, places[k, : size[k]]], np.full(len(some), size[k]))
            theirs = _firmest(held[k][places[some]], size[some])
            may_be_firm[r, some] = mine + theirs >= -1e-6
        # where tokens repeat: what any stretch of the least length lacks
        some = np.flatnonzero(hopeful[r] & ~once) if once[k] else np.flatnonzero(hopeful[r])
        some = some[some != k]
        if len(some):
            missed = kinds[k].lost(held[some][:, places[k, : size[k]]])
            missed += [kinds[o].lost(held[k][places[o, : size[o]]][None])[0] for o in some]
            hopeful[r, some] = both[r, some] * (1 - SIMILAR) >= SIMILAR * missed - 1e-3
    by_id = np.array(sorted(np.flatnonzero(~seeks).tolist(), key=lambda k: docs[k]), np.int64)
    judged: dict[tuple[int, int], tuple[bool, bool]] = {}
    out = []
    for k in np.flatnonzero(seeks).tolist():
        best, r = None, row[look[k]]
        for other in by_id[hopeful[r][look[by_id]]].tolist():
            # a partner is known: only one with a passage that begins and ends with shared tokens would do better
            if docs[other] != docs[k] and (best is None or may_be_firm[r, look[other]]):
                pair = (look[other], look[k])
                if pair not in judged:
                    one, own = parts[other].tokens, parts[k].tokens
                    met = verified(one, own)
                    judged[pair] = bool(met), any(firm(one, own, *m[:4]) for m in met)
                if judged[pair][1]:
                    best = other
                    break
                best = other if judged[pair][0] and best is None else best
        if best is not None:
            out.append((best, k))
    return out


def open_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``lead``, ``doc`` and the words between which they may meet of open members and one partner each from every block they have one in.

    In a cell a block of a signature's open members seeks in a block of all its members.
    """
    kind = texts.schema.fields[0].dataType.simpleString()
    blocks, seekers = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("size", "sought"))
    total = members.agg(F.sum(seekers + F.when(F.col("open"), blocks).otherwise(0))).first()[0]
    number = F.xxhash64("doc", "place")
    given = F.transform(F.sequence(F.lit(0), seekers - 1), lambda k: F.struct(k.alias("seeker"), F.pmod(number, blocks).cast("int").alias("block"), F.lit(False).alias("seeks")))
    sought = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.pmod(number, seekers).cast("int").alias("seeker"), k.alias("block"), F.lit(True).alias("seeks")))
    rows = _contexts(members, texts).withColumn("copy", F.explode(F.when(F.col("open"), F.concat(given, sought)).otherwise(given)))
    rows = rows.select(F.xxhash64("value", "copy.seeker", "copy.block").alias("cell"), "copy.seeks", "doc", "place", "at", "part")
    rows = rows.withColumn("task", F.pmod("cell", F.lit(-(-total // TASK))))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cells, seeks = table.column("cell").to_numpy(), table.column("seeks").to_numpy()
        docs, places, at = (table.column(c).to_pylist() for c in ("doc", "place", "at"))
        parts = table.column("part").combine_chunks().dictionary_encode()
        tokens, text = list(_tokens_of(parts.dictionary)), parts.indices.to_pylist()
        cuts = np.flatnonzero(np.diff(cells)) + 1
        one, other = [], []
        known: dict[int, Surroundings] = {}
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
            if seeks[low:high].any() and not seeks[low:high].all():
                if len(known) > 4 * BLOCK:
                    known = {}
                here = [known[t] if t in known else known.setdefault(t, Surroundings(tokens[t])) for t in text[low:high]]
                for a, b in partners(docs[low:high], seeks[low:high], at[low:high], here):
                    one.append(low + a)
                    other.append(low + b)
        column = table.column("doc")
        one, other = np.array(one, np.int64), np.array(other, np.int64)
        places = np.array(places, np.int32)
        return pa.table({"lead": column.take(pa.array(one)), "doc": column.take(pa.array(other)), "lead_place": places[one], "place": places[other]})

    met = rows.groupBy("task").applyInArrow(meet, f"lead {kind}, doc {kind}, lead_place int, place int")
    ends = (F.min("lead_place").alias("lead_low"), (F.max("lead_place") + MATCH).alias("lead_high"), F.min("place").alias("low"), (F.max("place") + MATCH).alias("high"))
    return met.groupBy("lead", "doc").agg(*ends)


def repeated_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each passage of a document that repeats in another: id, ``start_word``, ``end_word`` (exclusive), ``n_words``,
    ``partner`` (the smallest document it was verified with), ``partner_start``, ``partner_end`` and ``similarity``."""
    texts = plain(df, id_column, text_column).where(F.col(f"`{id_column}`").isNotNull() & (F.octet_length(F.col(f"`{text_column}`")) >= 2 * WORDS - 1))
    shared = shared_windows(window_rows(df, id_column, text_column))
    found = settle(_verify(settle(lead_pairs(shared)), texts, id_column))
    members = open_members(shared, found, id_column)
    if not members.isEmpty():
        found = found.unionByName(_verify(settle(open_pairs(members, texts)), texts, id_column))
    best = found.groupBy(id_column, "start_word", "end_word").agg(F.min(F.struct("partner", "partner_start", "partner_end", "similarity")).alias("best"))
    return best.select(id_column, "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "best.*")
