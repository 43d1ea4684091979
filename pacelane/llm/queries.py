"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelane.llm import decontam, extract, language, mixing, neardup, passages, pieces, runs, secrets, secrets_sql, shards, spots, toxicity, variants
from pacelane.llm.frames import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""

    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return wrap


def remainder(divisor: int):
    """crc32 of the id in decimal, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """Bytes of a model file, read by the driver and sent along with the tasks."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query("op1_language")
def op1(t: Tables) -> DataFrame:
    model = language.fit_language(t.documents, F.coalesce(remainder(4) != 2, F.lit(True)))
    found = language.identify(t.documents, model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_passages")
def op2(t: Tables) -> DataFrame:
    return passages.repeated_passages(t.documents)


@query("op3_extract")
def op3(t: Tables) -> DataFrame:
    return extract.main_texts(t.pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_toxicity")
def op4(t: Tables) -> DataFrame:
    network = toxicity.fit_toxicity(t.documents, t.labels, remainder(3) != 1)
    found = toxicity.score_texts(t.documents, network)
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


@query("op5_shards")
def op5(t: Tables) -> DataFrame:
    rows = shards.shuffled(t.documents.select("doc_id", "text"), 24, seed=5)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    none = F.lit(None).cast("int")
    return rows.select("doc_id", shards.row_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"))


@query("op6_neardup")
def op6(t: Tables) -> DataFrame:
    found = neardup.near_groups(t.documents, width=3, threshold=85)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


@query("op7_spots")
def op7(t: Tables) -> DataFrame:
    rows = spots.with_edits(t.documents)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spots.shown(F.col("spots")).alias("fingerprint"),
        spots.shown(F.col("edited_spots")).alias("edited_fingerprint"),
        spots.likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        F.coalesce(spots.likeness(F.col("spots"), F.col("next_spots")), F.lit(0.0)).alias("near_next"),
    )


@query("op8_pieces")
def op8(t: Tables) -> DataFrame:
    return pieces.piece_codes(t.documents, piece_model(), digest=True)


@query("op9_secrets", secrets_sql.sql())
def op9(t: Tables) -> DataFrame:
    return secrets.digest(secrets.with_spans(t.documents))


@query("op10_decontam")
def op10(t: Tables) -> DataFrame:
    return decontam.find_leaks(t.documents, t.benchmark)


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``; in one of ten documents the words from some place on repeat the first few of them."""
    crc = remainder(1 << 32)
    g = F.floor(crc / 10)

    def repeat(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    edited = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise("")), 1)
    return docs.select("doc_id", F.when(crc % 10 == 0, edited).otherwise(F.col("text")).alias("text"))


@query("op11_runs")
def op11(t: Tables) -> DataFrame:
    return runs.digest(runs.with_runs(with_periods(t.documents)))


@query("op12_mixing", mixing.sql())
def op12(t: Tables) -> DataFrame:
    mixed = mixing.mix(t.documents)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op13_variants", variants.sql())
def op13(t: Tables) -> DataFrame:
    return variants.spelling_forms(variants.count_words(t.documents))
