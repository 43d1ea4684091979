"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is folded to lower-case letters with one space between words and counted as
hashed 1- to 3-grams.  Counts become ``(1 + ln tf) * idf``, normalised to length one.  Each language
owns several centroids, found by spherical k-means, because its texts come in
kinds.  A text gets the language of the centroid with the largest cosine.  A text that is
farther from it than the language's radius allows is marked as rejected; short texts hold few
n-grams and so have small cosines, which the radius allows for.

Document frequencies count every training row.  The centroids come from a bounded
sample, ``SAMPLE`` rows of each language with the smallest hashes of their ids.

Null texts and texts without a letter are ``und`` with score 0 and are rejected.  Rows
with a null language are never learned from.  With no training row at all, every
text is ``und``.  Equal texts get equal answers; the whole text counts, however long.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, ship_package
from pacelane.llm.words import U64

UNKNOWN = "und"
BITS = 12
WIDTH = 1 << BITS
SAMPLE = 1000
"""Training rows of one language that its centroids are fitted on."""
CENTROIDS = 4
ROUNDS = 12
SLACK = 0.55
"""A language rejects texts whose nearness is below this share of the smallest one among its training rows."""
SHORT = 60
"""A cosine is held against what a text with this many distinct n-grams more would reach: nearness is cosine * (n + SHORT) / n."""

_fold: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Lower-case code of every letter of the basic plane, a space for the rest."""
    if not _fold:
        table = np.full(1 << 16, 32, np.uint32)
        for code in range(1 << 16):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _fold.append(table)
    return _fold[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    beyond = codes >= 1 << 16
    folded = _fold_table()[np.where(beyond, 0, codes)]
    if beyond.any():
        letters = [chr(c).isalpha() for c in codes[beyond]]
        folded[beyond] = np.where(letters, codes[beyond], 32)
    blank = folded == 32
    if blank.all():
        return None
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    line = np.concatenate([[32], folded[keep], [32]]).astype(U64)
    one = line * U64(0x9E3779B97F4A7C15)
    two = one[:-1] + line[1:] * U64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + line[2:] * U64(0x165667B19E3779F9)
    parts = []
    for salt, grams in enumerate((one, two, three)):
        grams = (grams ^ (grams >> U64(29))) * U64(0xBF58476D1CE4E5B9 + 2 * salt)
        parts.append((grams >> U64(64 - BITS)).astype(np.int64))
    return np.bincount(np.concatenate(parts), minlength=WIDTH)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of a matrix of counts."""
    rows = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1), dtype=np.float32), 0).astype(np.float32) * idf
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, 1e-12)


def spherical_means(rows: np.ndarray, count: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Centroids of length one."""
    rng = np.random.default_rng(seed)
    count = min(count, len(rows))
    centre = rows[[int(rng.integers(len(rows)))]]
    while len(centre) < count:  # the next seed is drawn far from those before
        gap = np.maximum(0, 1 - (rows @ centre.T).max(axis=1)) ** 2
        if gap.sum() <= 1e-9:
            break
        centre = np.concatenate([centre, rows[[int(rng.choice(len(rows), p=gap / gap.sum()))]]])
    for _ in range(rounds):
        near = (rows @ centre.T).argmax(axis=1)
        moved = np.stack([rows[near == k].sum(axis=0) if (near == k).any() else centre[k] for k in range(len(centre))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centre, atol=1e-5):
            break
        centre = moved
    return centre


def nearness(cosine: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Cosine with the number of distinct n-grams allowed for."""
    return cosine * (grams + SHORT) / np.maximum(grams, 1)


class LanguageModel:
    """Centroids, their languages and radii; a few hundred kilobytes whatever the corpus."""

    def __init__(self, languages: list[str], centroids: np.ndarray, least: np.ndarray, idf: np.ndarray):
        self.languages, self.centroids, self.least, self.idf = languages, centroids.astype(np.float32), least, idf.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        names, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return names, score, rejected
        for at in range(0, len(texts), 256):
            kept, counts = [], []
            for k, text in enumerate(texts[at : at + 256], at):
                count = gram_counts(text)
                if count is not None:
                    kept.append(k)
                    counts.append(count)
            if not kept:
                continue
            counts = np.stack(counts)
            cosine = vectors(counts, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            near = nearness(cosine.max(axis=1), (counts > 0).sum(axis=1))
            for k, row, b, n in zip(kept, cosine, best, near, strict=True):
                names[k], score[k], rejected[k] = self.languages[b], min(1.0, max(0.0, float(row[b]))), n < self.least[b]
        return names, score, rejected




def document_frequencies(training: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with a letter and, of each n-gram, the rows that hold it; every row counts."""

    def count(batches):
        total, seen = 0, np.zeros(WIDTH, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                grams = gram_counts(text)
                if grams is not None:
                    total += 1
                    seen += grams > 0
        yield pa.RecordBatch.from_pydict({"gram": pa.array(range(-1, WIDTH), pa.int32()), "rows": pa.array([total, *seen], pa.int64())})

    sums = training.select("text").mapInArrow(count, "gram int, rows long").groupBy("gram").agg(F.sum("rows").alias("rows"))
    found = {row.gram: row.rows for row in sums.collect()}  # WIDTH + 1 rows
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(WIDTH)], np.float64)


def fit_language(df: DataFrame, training: Column | None = None, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from the rows of ``df`` (``doc_id``, ``text``, ``lang``) where ``training`` holds."""
    ship_package(df.sparkSession)
    rows = plain(df.where(training) if training is not None else df, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    total, seen = document_frequencies(rows)
    if not total:
        return LanguageModel([], np.zeros((0, WIDTH)), np.zeros(0), np.ones(WIDTH))
    idf = np.log((1 + total) / (1 + seen)) + 1
    per_language = rows.groupBy("lang").agg(F.count("*").alias("n"))
    ticket = (F.xxhash64("doc_id", "text") / F.lit(float(1 << 63)) + 1) / 2
    chosen = rows.join(F.broadcast(per_language), "lang").where(ticket <= F.lit(float(sample)) / F.col("n")).select("lang", "text")

    def fit(table: pa.Table) -> pa.Table:
        language = table.column("lang")[0].as_py()
        counts = [c for c in map(gram_counts, sorted(table.column("text").to_pylist())) if c is not None]
        if not counts:
            return pa.table({"lang": pa.array([], pa.string()), "least": pa.array([], pa.float64()), "centroid": pa.array([], pa.binary())})
        rows = vectors(np.stack(counts), idf.astype(np.float32))
        centre = spherical_means(rows, centroids, ROUNDS)
        least = float(nearness((rows @ centre.T).max(axis=1), np.array([(c > 0).sum() for c in counts])).min())
        return pa.table({"lang": [language] * len(centre), "least": [least] * len(centre), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centre], pa.binary())})

    found = sorted(map(tuple, chosen.groupBy("lang").applyInArrow(fit, "lang string, least double, centroid binary").collect()))
    return LanguageModel(
        [language for language, _, _ in found],
        np.array([np.frombuffer(c, np.float32) for _, _, c in found]).reshape(-1, WIDTH),
        np.array([SLACK * least for _, least, _ in found]),
        idf,
    )


def identify(df: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` of every whole text."""
    ship_package(df.sparkSession)
    source = plain(df, id_column, text_column)
    kind = source.schema[id_column].dataType.simpleString()

    def predict(batches):
        for batch in batches:
            names, score, rejected = model.predict(batch.column(1).to_pylist())
            arrays = [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, [id_column, "lang_pred", "score", "rejected"])

    return source.mapInArrow(predict, f"`{id_column}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``df`` whose text is not rejected; all columns stay."""
    ship_package(df.sparkSession)
    place = df.columns.index("text")

    def keep(batches):
        for batch in batches:
            _, _, rejected = model.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array(~rejected))

    return df.mapInArrow(keep, df.schema)
