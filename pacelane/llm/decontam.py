"""Benchmark decontamination by BM25 retrieval with block-max bounds.

The test items are the indexed side: an inverted index with BM25 impacts, postings in blocks of
``BLOCK`` items of similar self score, and the largest impact of every term in every block.  Each document is
cut into overlapping passages, each long enough that any item lies whole in at least one, and every passage
is a query.  Blocks whose bound cannot reach the threshold are skipped; in the others every item is
bounded, then scored, and everything above the threshold, a share of the item's own score, is
retrieved.  Items fall into tiers of similar length, because short items need short passages.  A retrieved item is a leak if its question and
answer, or the item as a whole, overlap with the passage: shares of runs of five words, 0.8 or more.

An item's answer is what follows its last line break or, on a single line, its last sentence; an item of
one sentence is all question.  Words are runs of ASCII letters, digits and any other non-ASCII characters,
in lower case.  Null and empty texts and items match nothing.  Repeated rows give repeated answers;
items with equal texts are reported each.  The index travels with the tasks in parts of about ``PART`` distinct items,
one pass over the documents for each part.  Term weights come from all items, repeated ones counted as often as they are, so
the parts do not change a score.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle, ship_package
from pacelane.llm.words import PUNCTUATION, U64, find_words, shingle_codes, slices, text_bytes

PART = 2048
PART_BYTES = 16 << 20
BLOCK = 16
K1, B = 1.2, 0.75
SHARE = 0.7
"""Retrieve items whose score is at least this share of their score for themselves."""
OVERLAP = 0.8
RUN = 5
COMMON = 0.1
"""Terms in more than this share of the items are looked up once for a passage, so they count once in its bounds."""


def _codes(text: str) -> np.ndarray:
    data, offsets = text_bytes(pc.utf8_lower(pa.array([text], pa.large_string())))
    return find_words(data, offsets, PUNCTUATION).code


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    text = text.strip()
    head, line, tail = text.rpartition("\n")
    if line and head.strip():
        return head, tail
    sentences = re.split(r"(?<=[.!?])\s+", text)
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def _runs(codes: np.ndarray) -> np.ndarray:
    return np.unique(shingle_codes(codes, min(RUN, len(codes)))) if len(codes) else np.zeros(0, U64)


class Item(NamedTuple):
    id: object
    copies: int
    length: int
    question: np.ndarray
    answer: np.ndarray
    answer_run: int
    whole: np.ndarray
    question_run: int


class Tier:
    """Postings of items of similar length: impacts, blocks and thresholds."""

    def __init__(self, items: list[Item], pairs: np.ndarray, impact: np.ndarray, vocabulary: np.ndarray, often: np.ndarray, longest: int):
        score = np.bincount(pairs[0], impact, minlength=len(items))
        order = np.argsort(score, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.items = [items[k] for k in order]
        self.threshold = SHARE * score[order]
        used, term = np.unique(pairs[1], return_inverse=True)
        self.vocabulary, common = vocabulary[used], often[used]
        item = place[pairs[0]]
        self.blocks = -(-len(self.items) // BLOCK)
        most = np.zeros((len(used), self.blocks), np.float32)
        np.maximum.at(most, (term, item // BLOCK), impact.astype(np.float32))
        self.common, self.rare = np.flatnonzero(common), ~common
        self.most_common = most[common].astype(np.float64)
        most[common] = 0
        self.most = most
        # postings of each block: a row of impacts for every rare term in it (row 0: none), and the common terms' impacts
        self.row, self.rows, self.common_rows = [], [], []
        for k in range(self.blocks):
            mine = item // BLOCK == k
            dense = np.zeros((len(used), BLOCK))
            dense[term[mine], item[mine] % BLOCK] = impact[mine]
            held = np.flatnonzero((dense > 0).any(axis=1) & self.rare)
            row = np.zeros(len(used), np.int32)
            row[held] = np.arange(1, len(held) + 1)
            self.row.append(row)
            self.rows.append(np.concatenate([np.zeros((1, BLOCK)), dense[held]]))
            self.common_rows.append(dense[common])
        by_item = np.argsort(item, kind="stable")
        cut = np.searchsorted(item[by_item], np.arange(1, len(self.items)))
        self.item_terms, self.item_impacts = np.split(term[by_item], cut), np.split(impact[by_item], cut)
        self.least = np.minimum.reduceat(self.threshold, np.arange(0, len(self.items), BLOCK))
        self.longest = longest
        self.hit = np.zeros(1 << 20, bool)
        self.hit[(self.vocabulary >> U64(44)).astype(np.int64)] = True

    def terms(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that occur in an item, and their terms."""
        at = np.flatnonzero(self.hit[(codes >> U64(44)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, codes[at])
        term[term == len(self.vocabulary)] = 0
        right = self.vocabulary[term] == codes[at]
        return at[right], term[right]

    def candidates(self, begin: np.ndarray, end: np.ndarray, at: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """Passage, item and score of every pair above the item's threshold."""
        rare = self.rare[term]
        place, kind = at[rare], term[rare]
        low, high = np.searchsorted(place, begin), np.searchsorted(place, end)
        present = np.zeros((len(begin), len(self.common)))
        for k, t in enumerate(self.common):
            there = at[term == t]
            present[:, k] = np.searchsorted(there, end) > np.searchsorted(there, begin)
        found = []
        for first in range(0, self.most.shape[1], 16):
            group = slice(first, first + 16)
            sums = np.zeros((len(kind) + 1, len(self.least[group])))
            np.cumsum(self.most[kind, group], axis=0, out=sums[1:])
            bound = sums[high] - sums[low] + present @ self.most_common[:, group]
            hopeful = bound >= self.least[group] - 1e-3
            for b in np.flatnonzero(hopeful.any(axis=0)):
                asked = np.flatnonzero(hopeful[:, b])
                for p, i in self._block(first + b, asked, begin, end, place, kind, present):
                    inside = np.isin(self.item_terms[i], term[np.searchsorted(at, begin[p]) : np.searchsorted(at, end[p])])
                    score = float(self.item_impacts[i][inside].sum())
                    if score >= self.threshold[i] - 1e-9:
                        found.append((int(p), int(i), score))
        return found

    def _block(self, b, asked, begin, end, place, kind, present):
        """Passages and items of a block whose bound, with repeated terms counted repeatedly, reaches the threshold."""
        row = self.row[b][kind]
        held = row > 0
        where = place[held]
        sums = np.zeros((len(where) + 1, BLOCK))
        np.cumsum(self.rows[b][row[held]], axis=0, out=sums[1:])
        bound = sums[np.searchsorted(where, end[asked])] - sums[np.searchsorted(where, begin[asked])]
        bound += present[asked] @ self.common_rows[b]
        least = np.full(BLOCK, np.inf)
        mine = self.threshold[b * BLOCK : (b + 1) * BLOCK]
        least[: len(mine)] = mine
        p, i = np.nonzero(bound >= least - 1e-3)
        return zip(asked[p], i + b * BLOCK, strict=True)

    def passages(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last word of passages twice as long as the longest item, half of it apart."""
        width, step = 2 * self.longest, self.longest
        size = np.diff(first)
        count = np.where(size > 0, np.maximum(1, -(-(size - width) // step) + 1), 0)
        text = np.repeat(np.arange(len(size)), count)
        within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[text] + within * step
        return text, begin, np.minimum(begin + width, first[text + 1])


def _tier(size: np.ndarray) -> np.ndarray:
    return np.maximum(4, np.ceil(np.log2(size))).astype(np.int64)


class Statistics(NamedTuple):
    """Counts over all items that have words."""

    items: int
    words: int
    df: dict[int, int]
    """Items that hold a word, by its number."""
    longest: dict[int, int]
    """Words of the longest item of every tier."""


class Index:
    """A part of the items, a tier for each doubling of the item length; BM25 statistics over all items.  ``rows``: id, text, copies."""

    def __init__(self, rows: list[tuple], statistics: Statistics):
        self.tiers: list[Tier] = []
        parsed = []
        for item_id, text, copies in rows:
            codes = _codes(text or "")
            if len(codes):
                question, answer = (_codes(part) for part in split_item(text))
                parsed.append((codes, Item(item_id, copies, len(codes), _runs(question), _runs(answer), min(RUN, len(answer)), _runs(codes), min(RUN, len(question)))))
        if not parsed:
            return
        size = np.array([len(c) for c, _ in parsed])
        vocabulary, inverse = np.unique(np.concatenate([c for c, _ in parsed]), return_inverse=True)
        pairs, tf = np.unique(np.stack([np.repeat(np.arange(len(parsed)), size), inverse.ravel()]), axis=1, return_counts=True)
        count, mean = statistics.items, statistics.words / statistics.items
        df = np.array([statistics.df[c] for c in vocabulary.view(np.int64).tolist()])
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        impact = idf[pairs[1]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[pairs[0]] / mean))
        often = df > max(2, COMMON * count)
        tier = _tier(size)
        for k in np.unique(tier):
            members = np.flatnonzero(tier == k)
            mine = tier[pairs[0]] == k
            self.tiers.append(Tier([parsed[m][1] for m in members], np.stack([np.searchsorted(members, pairs[0][mine]), pairs[1][mine]]), impact[mine], vocabulary, often, statistics.longest[int(k)]))

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """Text index, item, score, question, answer and whole overlap, word span, of every leak; best passage each."""
        words = find_words(data, offsets, PUNCTUATION)
        best: dict[tuple[int, object], tuple] = {}
        for tier in self.tiers if len(words.code) else ():
            text, begin, end = tier.passages(words.first)
            at, term = tier.terms(words.code)
            for p, i, score in tier.candidates(begin, end, at, term):
                item, codes = tier.items[i], words.code[begin[p] : end[p]]
                shares = []
                for runs, length in ((item.question, item.question_run), (item.answer, item.answer_run), (item.whole, min(RUN, item.length))):
                    shares.append(float(np.isin(runs, shingle_codes(codes, length)).mean()) if len(runs) else 1.0)
                if min(shares[:2]) >= OVERLAP or shares[2] >= OVERLAP:
                    key = (int(text[p]), id(item))
                    start = int(begin[p] - words.first[text[p]])
                    rank = (shares[2], score, -start)
                    if key not in best or best[key][0] < rank:
                        best[key] = (rank, (item.copies, int(text[p]), item.id, score, *shares, start, start + len(codes)))
        return [row[1:] for _, row in sorted(best.values(), key=lambda x: (x[1][1], str(x[1][2]))) for _ in range(row[0])]


def _counted(rows: list[tuple]) -> Statistics:
    """Statistics of items (id, text, copies) that are all of them."""
    items = words = 0
    df: dict[int, int] = {}
    longest: dict[int, int] = {}
    for _, text, copies in rows:
        codes = _codes(text or "").view(np.int64)
        items, words = items + copies * (len(codes) > 0), words + copies * len(codes)
        for c in np.unique(codes).tolist():
            df[c] = df.get(c, 0) + copies
        if len(codes):
            tier = int(_tier(np.array(len(codes))))
            longest[tier] = max(longest.get(tier, 0), len(codes))
    return Statistics(items, words, df, longest)


def _word_counts(counted: DataFrame) -> DataFrame:
    """``code`` and ``df`` of every word of the counted items (``text``, ``copies``)."""

    def count(batches):
        for batch in batches:
            for first, _, data, offsets in slices(pc.utf8_lower(batch.column(0).cast(pa.large_string()))):
                words = find_words(data, offsets, PUNCTUATION)
                copies = batch.column(1).to_numpy()[first : first + len(offsets) - 1]
                pairs = np.unique(np.stack([words.text.astype(U64), words.code]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(copies[pairs[0].astype(np.int64)])], ["code", "df"])

    return counted.select("text", "copies").mapInArrow(count, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))


def _tier_sums(counted: DataFrame) -> DataFrame:
    """``longest``, ``items`` and ``words`` of every tier of the counted items."""

    def count(batches):
        for batch in batches:
            for first, _, data, offsets in slices(pc.utf8_lower(batch.column(0).cast(pa.large_string()))):
                size = np.diff(find_words(data, offsets, PUNCTUATION).first)
                copies = batch.column(1).to_numpy()[first : first + len(size)][size > 0]
                size = size[size > 0]
                yield pa.RecordBatch.from_arrays([pa.array(_tier(size)), pa.array(size), pa.array(copies), pa.array(copies * size)], ["tier", "longest", "items", "words"])

    sums = counted.select("text", "copies").mapInArrow(count, "tier long, longest long, items long, words long")
    return sums.groupBy("tier").agg(F.max("longest"), F.sum("items"), F.sum("words"))


def _indexes(items: DataFrame):
    """Indexes over parts of bounded count and bytes of the distinct items, all with the statistics of all items.

    Repeated items are counted, so they take up no room; their answers are the same.
    """
    ship_package(items.sparkSession)
    counted = settle(items.groupBy("item_id", "text").agg(F.count("*").alias("copies")))
    count, size = counted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // PART), -(-size // PART_BYTES))
    order = lambda r: (r[0] is None, r[0], r[1] or "")
    if parts == 1:
        rows = sorted(((i, t, n) for i, t, n in counted.collect()), key=order)
        yield Index(rows, _counted(rows))
        return
    worded = counted.where("text IS NOT NULL")
    words = settle(_word_counts(worded))
    tiers = _tier_sums(worded).collect()  # one row per tier
    total, longest = [sum(t[k] for t in tiers) for k in (2, 3)], {t[0]: t[1] for t in tiers}
    for k in range(parts):
        part = settle(counted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k))
        rows = sorted(((i, t, n) for i, t, n in part.collect()), key=order)
        known = _word_counts(part.where("text IS NOT NULL")).select("code")
        df = dict(map(tuple, words.join(known, "code").select("code", "df").collect()))
        yield Index(rows, Statistics(*total, df, longest))


def find_leaks(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document and item it holds: id, ``item_id``, ``bm25``, overlaps, word span of the passage."""
    ship_package(df.sparkSession)
    source = plain(df, id_column, text_column)
    items = plain(items, "item_id", "text")
    kind, item_kind = source.schema[id_column].dataType, items.schema["item_id"].dataType.simpleString()
    schema = f"`{id_column}` {kind.simpleString()}, item_id {item_kind}, bm25 double, question_overlap double, answer_overlap double, overlap double, start_word long, end_word long"

    def search(index: Index):
        def run(batches):
            for batch in batches:
                taken, rows = [], []
                for first, _, data, offsets in slices(pc.utf8_lower(batch.column(1))):
                    for row in index.leaks(data, offsets):
                        taken.append(first + row[0])
                        rows.append(row[1:])
                if rows:
                    columns = [pa.array(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken)), *columns], [id_column, "item_id", "bm25", "question_overlap", "answer_overlap", "overlap", "start_word", "end_word"])

        return run

    found = None
    for index in _indexes(items):
        part = source.mapInArrow(search(index), schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(df: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``df`` (``doc_id``, ``text``, more) that hold no item; all columns stay."""
    place = df.columns.index("text")
    ship_package(df.sparkSession)

    def clean(index: Index):
        def run(batches):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for first, _, data, offsets in slices(pc.utf8_lower(batch.column(place))):
                    for row in index.leaks(data, offsets):
                        keep[first + row[0]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in _indexes(plain(items, "item_id", "text")):
        df = df.mapInArrow(clean(index), df.schema)
    return df
