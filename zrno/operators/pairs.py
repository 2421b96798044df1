"""Passages of whole sentences, response checks, and the folds over append-only logs."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zrno.functions.text import nfc, strip, words
from zrno.session import cut

# What ends and opens a sentence, and tokens whose point ends none.
ABBREVIATIONS = ("dr", "g", "ga", "sv", "št", "str", "prim", "tj", "npr", "itd", "oz", "sl", "op")
BOUNDARY = r"(?<![.!?…])(?<!(?<![\p{L}\p{N}_])(?:" + "|".join(ABBREVIATIONS) + r"|\p{Nd}{1,18})\s{0,3})([.!?…]+[»«”“\"']*)\s+(?=[\p{Lu}»„“\"'\-–—(])"
HEADING = r"^(?:[IVXL]{1,6}\.?|[A-ZČŠŽ][A-ZČŠŽ \-]{3,})$"
LEADING_HEADING = r"^(?:[IVXL]{1,6}\.|[IVXL]{2,6})\s+(?=[A-ZČŠŽ»„“])"
# Genres that passages are taken from, openings of comments, limits, and sounds before which a preposition changes.
PROSE = ("Proza", "Pripovedni spisi", "Esejistika", "Mladinska dela")
PREAMBLES = ("#", "```", "Here is", "Rewritten", "Translation:", "The passage")
MIN_RATIO, MAX_RATIO, MIN_SIMILARITY, CARONS_LEAST, CARONS_KEPT = 0.5, 1.8, 0.40, 8, 0.1
VOICELESS, VOICED = "ptkfshcčšx", "bdgzžvmnljraeiouáéíóú"


@dataclass(frozen=True)
class PassageParams:
    min_sentences: int = 2
    max_sentences: int = 6
    min_chars: int = 120
    max_chars: int = 800


def sentences(paragraph: Column) -> Column:
    """Sentences of a flattened paragraph: a boundary needs a capital or an opener after it, and no abbreviation or number before it."""
    marked = F.regexp_replace(paragraph, BOUNDARY, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, flattened, without a leading section numeral."""
    flat = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(F.array_join(words(p), " "), LEADING_HEADING, ""))
    return F.filter(flat, lambda p: p != "")


def windows(docs: DataFrame, key: str, text: str, p: PassageParams = PassageParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, para, win, text, n_sentences, n_chars, mid_paragraph, reason, passage_id) of every candidate window.

    reason is null for a passage; of equal passages all but the first, in the order of (key, para, win), are duplicates.
    """
    d = docs.where(F.col(text).isNotNull()).select(key, *keep, F.posexplode(paragraphs(F.col(text))).alias("para", "_p"))
    d = d.withColumn("_s", F.when(F.rlike("_p", F.lit(HEADING)), F.array(F.col("_p"))).otherwise(sentences(F.col("_p")))).withColumn("_heading", F.rlike("_p", F.lit(HEADING)))
    d = cut(d.drop("_p"), "sentences")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1)), F.lit(p.max_sentences))
    d = d.select(key, *keep, "para", "_heading", F.posexplode(F.transform(starts, lambda i: F.slice("_s", i, p.max_sentences))).alias("win", "_g"))
    d = d.withColumns({"text": F.array_join("_g", " "), "n_sentences": F.size("_g"), "mid_paragraph": F.col("win") > 0}).withColumn("n_chars", F.length("text"))
    reason = F.when(F.col("_heading"), "heading").when(F.col("n_sentences") < p.min_sentences, "too_few_sentences").when(F.col("n_chars") < p.min_chars, "too_short").when(F.col("n_chars") > p.max_chars, "too_long")
    d = d.withColumn("reason", reason).withColumn("passage_id", F.when(reason.isNull(), F.left(F.sha2(nfc(F.col("text")), 256), F.lit(16))))
    d = cut(d.drop("_g", "_heading"), "windows")
    order = F.struct(key, "para", "win")
    first = d.where("passage_id is not null").groupBy("passage_id").agg(F.min(order).alias("_first"))
    d = d.join(first, "passage_id", "left")
    return d.withColumn("reason", F.when(F.col("_first").isNotNull() & (order != F.col("_first")), "duplicate").otherwise(F.col("reason"))).select(key, *keep, "para", "win", "text", "n_sentences", "n_chars", "mid_paragraph", "reason", "passage_id")


def foreign_letters(text: Column) -> Column:
    """Distinct letters outside the Latin script."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]"), F.lit(0)))


def misassimilated(text: Column) -> Column:
    """How often a preposition s or z disagrees with the sound that follows."""
    wrong = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:s\s+[{VOICED}]|z\s+[{VOICELESS}])"
    return F.regexp_count(text, F.lit(wrong))


def caron_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^čšžČŠŽ]", ""))


def anomaly(source: Column, output: Column) -> Column:
    """Why a response is no usable rewriting; the first reason that holds, null for none. Similarity is apart, in similarity()."""
    src, out = F.coalesce(source, F.lit("")), strip(F.coalesce(output, F.lit("")))
    ratio = F.length(out) / F.nullif(F.length(src), F.lit(0))
    starts = F.lit(False)
    for m in PREAMBLES:
        starts = starts | F.startswith(out, F.lit(m))
    return (
        F.when(out == "", "empty_output").when(starts, "not_a_rewrite").when(F.size(F.array_except(foreign_letters(out), foreign_letters(src))) > 0, "foreign_script")
        .when(out == src, "identity").when((ratio < MIN_RATIO) | (ratio > MAX_RATIO), "length_outlier").when((misassimilated(out) > 0) & (misassimilated(src) == 0), "misassimilated")
        .when((caron_count(src) >= CARONS_LEAST) & (caron_count(out) / caron_count(src) < CARONS_KEPT), "lost_diacritics")
    )


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters by longest common blocks, over whole texts; Arrow batches."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", False).ratio() for x, y in zip(a, b)])


def response_text(blocks: Column) -> Column:
    """The text blocks of a response joined by line; others are skipped."""
    return F.btrim(F.array_join(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: b.text), "\n"))


def fold_log(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row for each key: the values of its last row in the order given, and `first_seen`, the order of its first. Partial aggregates only."""
    o = F.struct(*order)
    g = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), o).alias("_v"), F.min(o).alias("first_seen"))
    return g.select(key, *[F.col(f"_v.{v}").alias(v) for v in values], "first_seen")


def skip_reason(source: Column, author: Column, held_out: Column, genre: Column, home: str) -> Column:
    """Why a record gives no passages: another source or no author, held out, or no genre of prose; null for an eligible one."""
    return F.when(~source.eqNullSafe(F.lit(home)) | author.isNull(), "other_source").when(held_out, "held_out").when(genre.isNull() | ~genre.isin(*PROSE), "not_prose")


def quarantined(responses: DataFrame, passages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(responses to passages that were sent, the others, null keys among them)."""
    sent = passages.select(key).distinct()
    return responses.join(sent, key, "left_semi"), responses.join(sent, key, "left_anti")


def resolve(responses: DataFrame, passage: str, order: str, reason: str) -> DataFrame:
    """(passage, chosen, reason): the last sound response of each passage, else its first unsound one."""
    ok = F.col(reason).isNull()
    g = responses.groupBy(passage).agg(F.max(F.when(ok, F.col(order))).alias("_ok"), F.min(F.when(~ok, F.col(order))).alias("_bad"), F.min_by(reason, F.when(~ok, F.col(order))).alias("_why"))
    return g.select(passage, F.coalesce("_ok", "_bad").alias("chosen"), F.when(F.col("_ok").isNull(), F.col("_why")).alias("reason"))


def next_passages(passages: DataFrame, done: DataFrame, key: str, limit: int) -> DataFrame:
    """The next `limit` passages by key that are not done; a longer limit extends a shorter one's result."""
    return passages.join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit)


def best_samples(pairs: DataFrame, key: str, old: str, new: str, archaisms: list[str], n: int = 12) -> DataFrame:
    """The n pairs that lost most archaic words, ties by key."""
    score = sum((F.array_contains(words(F.lower(old)), w) & ~F.array_contains(words(F.lower(new)), w)).cast("int") for w in archaisms)
    return pairs.withColumn("score", score).orderBy(F.desc("score"), key).limit(n)




def first_paragraphs(docs: DataFrame, key: str, text: str, least: int = 120, most: int = 800) -> DataFrame:
    """(key, paragraph): the first flattened paragraph of a fitting length of each text; texts without one give none."""
    fit = F.filter(paragraphs(F.col(text)), lambda p: (F.length(p) >= least) & (F.length(p) <= most))
    return docs.where(F.col(text).isNotNull()).select(key, F.try_element_at(fit, F.lit(1)).alias("paragraph")).where("paragraph is not null")
