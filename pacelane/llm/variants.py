"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Letters are hashed to a few symbols, so a word becomes a reduced word.  Words one edit apart have reduced words at most one
edit apart.  Every word's reduced word and its full one-edit neighbourhood (each code point deleted, each symbol put in
each place or between any two) are generated and joined with the reduced words of the vocabulary; the pairs so found are
verified on the words themselves.  Reduced words are 64-bit sums over places, so a neighbour costs one addition and a long
word no text; equal sums of different reduced words only cost a verification.

The number of symbols follows the vocabulary: its ``LENGTH``-th root, so that a reduced word of usual length stands for few
words however large the vocabulary is, while a neighbourhood grows by that root only.  Before words are fetched, pairs are
dropped whose letter sets differ in more than two letters, which no edit does.

Words are counted per task before the shuffle.  Null and empty texts have no words.  A null id deletes nothing.  Ties of
frequency go to the first word by code point.  A word without near words is its own root.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle, ship_package
from pacelane.llm.words import U64, mix

LEAST_SYMBOLS = 4
LENGTH = 9
SHORTEST = 6
OFTEN = 5
RATIO = 5
TYPO = 199
HELD = 200_000
"""Distinct words that a task counts before it hands them on."""
CODES = 1 << 18
"""Neighbours made at once."""

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def count_words(df: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, typo: int = TYPO, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n`` of words with at least ``shortest`` code points and ``often`` occurrences.

    Words are runs of Latin letters, ``A-Z`` in lower case.  With ``typo`` set, the crc32 of id, colon and run deletes, where it is a
    multiple of ``typo``, the run's code point at the crc32 modulo the length; 0 leaves all runs as they are.
    """
    ship_package(df.sparkSession)
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def count(batches):
        held: Counter = Counter()

        def hand_on():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                # bytes fold A-Z only
                words = Counter(run.findall(text.encode().lower().decode()))
                if typo and name is not None:
                    seed = zlib.crc32(f"{name}:".encode())
                    for word in [w for w in words if zlib.crc32(w.encode(), seed) % typo == 0]:
                        at = zlib.crc32(word.encode(), seed) % len(word)
                        changed = word[:at] + word[at + 1 :]
                        times = words.pop(word)
                        if len(changed) >= shortest:
                            held[changed] += times
                held.update(words)
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    found = plain(df, id_column, text_column).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def symbols_for(vocabulary: int) -> int:
    return max(LEAST_SYMBOLS, math.ceil(vocabulary ** (1 / LENGTH)))


def reduced(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of code points."""
    return (mix(letters.astype(U64)) >> U64(33)) % U64(symbols) + U64(1)


def neighbours(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of the reduced words and of their one-edit neighbourhoods, for equally long words (a row of code points each)."""
    many, n = letters.shape
    sign = reduced(letters, symbols)
    power = np.ones(n + 1, U64)
    power[1:] = np.cumprod(np.full(n, _BASE, U64))
    sums = np.zeros((many, n + 1), U64)
    np.cumsum(sign * power[:n], axis=1, out=sums[:, 1:])
    whole = sums[:, -1:]
    deleted = sums[:, :-1] + (whole - sums[:, 1:]) * _INVERSE
    shifted = sums + (whole - sums) * _BASE
    parts = [whole, deleted]
    for symbol in range(1, symbols + 1):
        parts.append(whole + (U64(symbol) - sign) * power[:n])
        parts.append(shifted + U64(symbol) * power)
    return np.concatenate(parts, axis=1)


def _own(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of the reduced words alone."""
    power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(letters.shape[1] - 1, _BASE, U64)]))
    return (reduced(letters, symbols) * power).sum(axis=1, dtype=U64)


def _bits(letters: np.ndarray) -> np.ndarray:
    """A bit for each letter of a word."""
    return np.bitwise_or.reduce(U64(1) << (letters.astype(U64) % U64(64)), axis=1)


def near_words(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``a``, ``b``: ids of the words of ``vocabulary`` (``id``, ``word``) that are one edit apart, both ways round."""

    def own(batches):
        for batch in batches:
            for rows, letters in _by_length(batch):
                yield _batch(batch, rows, _own(letters, symbols)[:, None], _bits(letters))

    def all_around(batches):
        for batch in batches:
            for rows, letters in _by_length(batch, 2 * symbols + 1):
                yield _batch(batch, rows, neighbours(letters, symbols), _bits(letters))

    shape = "code long, id long, bits long"
    places = vocabulary.select("id", "word")
    left = places.mapInArrow(all_around, shape).toDF("code", "a", "a_bits")
    right = places.mapInArrow(own, shape).toDF("code", "b", "b_bits")
    alike = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2
    pairs = left.join(right, (left["code"] == right["code"]) & (F.col("a") != F.col("b")) & alike).select("a", "b")
    sides = [places.select(F.col("id").alias(s), F.col("word").alias(f"{s}_word")) for s in "ab"]
    full = pairs.join(sides[0], "a").join(sides[1], "b")
    return full.where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def _by_length(batch: pa.RecordBatch, wide: int = 1):
    """Rows of equally long words and their code points, so many that ``wide`` numbers for each letter stay small."""
    words = batch.column(1).to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        step = max(1, CODES // (wide * (n + 1)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, np.frombuffer("".join(words[k] for k in some).encode("utf-32-le"), np.uint32).reshape(len(some), n)


def _batch(batch: pa.RecordBatch, rows: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """A row for each distinct number of a word."""
    codes = np.sort(codes, axis=1)
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    count = fresh.sum(axis=1)
    ids = np.asarray(batch.column(0))[rows]
    columns = [codes[fresh].view(np.int64), np.repeat(ids, count), np.repeat(bits.view(np.int64), count)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "id", "bits"])


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of ``forms`` (``word``, ``form``): forms followed to the last one, twice as far in each round."""
    links = settle(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = settle(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of counted ``words`` (``word``, ``n``; words distinct): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    ship_package(words.sparkSession)
    counted = settle(words.select("word", "n"))
    vocabulary = settle(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = near_words(vocabulary, symbols_for(vocabulary.count()))
    other = vocabulary.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("word").alias("b_word"))
    best = F.min(F.struct((-F.col("b_n")).alias("rank"), "b_word")).alias("best")
    near = pairs.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(near, F.col("id") == F.col("a"), "left")
    far = -F.col("best.rank") >= ratio * F.col("n")
    formed = settle(
        joined.select(
            "word",
            F.when(far, F.col("best.b_word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(far, -F.col("best.rank")).alias("form_n"),
        )
    )
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def sql() -> str:
    """The query's rows: words counted in SQL, near words by shared patterns with one place left open or out."""
    return f"""
    WITH RECURSIVE crc(entries) AS (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i))
    ), runs AS (
        SELECT doc_id, run, count(*) AS times
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
        GROUP BY doc_id, run
    ), hashed AS (
        SELECT *, xor(list_reduce(
            list_transform(range(CAST(octet_length(encode(name)) AS BIGINT)), lambda k: CAST('0x' || hex(encode(name))[2 * k + 1 : 2 * k + 2] AS BIGINT)),
            lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
        FROM (SELECT *, doc_id || ':' || run AS name FROM runs WHERE length(run) >= {SHORTEST}), crc
    ), words AS (
        SELECT word, CAST(sum(times) AS BIGINT) AS n
        FROM (SELECT times, CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
        WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {OFTEN}
    ), patterns AS (
        SELECT word, n, left(word, k - 1) || '?' || substr(word, k + 1) AS open, left(word, k - 1) || substr(word, k + 1) AS short
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
    ), pairs AS (
        SELECT a.word AS a, b.word AS b, b.n FROM patterns a JOIN patterns b ON a.open = b.open AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM patterns a JOIN words b ON a.short = b.word
        UNION SELECT b.word, a.word, a.n FROM patterns a JOIN words b ON a.short = b.word
    ), best AS (
        SELECT a, count(*) AS n_near, arg_min(struct_pack(b := b, n := n), struct_pack(rank := -n, b := b)) AS top FROM pairs GROUP BY a
    ), formed AS (
        SELECT word, CASE WHEN top.n >= {RATIO} * n THEN top.b END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= {RATIO} * n THEN top.n END AS form_n
        FROM words LEFT JOIN best ON word = a
    ), walk AS (
        SELECT word, word AS root, form AS onward FROM formed
        UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.onward = f.word
    )
    SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.onward IS NULL
    """
