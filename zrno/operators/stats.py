"""Quality metrics of shards: lengths, lexical diversity, duplicate lines, unknown characters, duplicates and markup that survived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zrno.functions.text import casefold, lines, share, words

# The characters a clean text is made of, in their published order.
ALLOWED = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "čšžćđČŠŽĆĐ"
    "áàâäéèêëíìîïóòôöúùûüýőűÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ"
    "0123456789"
    " \t\n\r"
    ".,;:!?-–—…\"'»«„“”()[]/*"
)
# What should not survive cleaning.
PROBES = {"wikitable": r"\{\|", "wikilink": r"\[\[", "template": r"\{\{", "image_frag": r"\b(thumb|sličica)\|", "ref_tag": "<ref", "heading": r"(?m)^==+.+==+[ \t]*$"}
WINDOW = 500


def unknown_chars(text: Column) -> Column:
    """Characters that are neither blank nor allowed."""
    return F.length(F.regexp_replace(F.translate(text, ALLOWED, ""), r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]", ""))


def duplicate_line_share(text: Column) -> Column:
    x = lines(text)
    return F.when(F.size(x) < 2, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(x)) / F.size(x))


def mattr(folded: Column, window: int = WINDOW) -> Column:
    """Moving-average type-token ratio over an array of case-folded words; strides of a fifth of the window. The array should be a stored column."""
    n = F.size(folded)
    starts = F.sequence(F.lit(1), n - window + 1, F.lit(max(1, window // 5)))
    total = F.aggregate(starts, F.lit(0.0), lambda acc, i: acc + F.size(F.array_distinct(F.slice(folded, i, window))) / F.lit(float(window)))
    return F.when(n == 0, F.lit(0.0)).when(n <= window, F.size(F.array_distinct(folded)) / n).otherwise(total / F.size(starts))


def document_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each text that isn't null: n_words, n_chars, unknown, mattr, dup_lines, hash and a flag for each probe."""
    t = F.col(text)
    d = docs.where(t.isNotNull()).withColumn("_w", F.transform(words(t), casefold))
    probes = [F.rlike(t, F.lit(p)).alias(k) for k, p in PROBES.items()]
    return d.select(*keep, F.size("_w").cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"), unknown_chars(t).cast("long").alias("unknown"), mattr(F.col("_w")).alias("mattr"), duplicate_line_share(t).alias("dup_lines"), F.sha2(t, 256).alias("hash"), *probes)


def nearest_rank_by(m: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """(by, name): the value at floor(q * (n - 1)) in order, from counts of the distinct values; no group's values are gathered."""
    hist = m.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(by).orderBy(value)
    run = hist.withColumns({"_to": F.sum("_n").over(order), "_all": F.sum("_n").over(Window.partitionBy(by))})
    return run.where(F.col("_to") > F.floor(F.lit(q) * (F.col("_all") - 1))).groupBy(by).agg(F.min(value).alias(name))


def shard_metrics(m: DataFrame, by: str) -> DataFrame:
    """One row for each shard from document_metrics()."""
    n = F.count(F.lit(1))
    weigh = lambda c: share(F.sum(F.col(c) * F.col("n_words")), F.sum("n_words"))
    g = m.groupBy(by).agg(
        n.alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"),
        F.min("n_words").alias("words_min"), F.median("n_words").alias("words_median"), F.max("n_words").alias("words_max"),
        weigh("mattr").alias("mattr"), weigh("dup_lines").alias("dup_line_frac"), share(F.sum("unknown"), F.sum("n_chars")).alias("unknown_char_rate"),
        *[(F.sum(F.col(k).cast("int")) / n).alias(k) for k in PROBES],
    )
    distinct = m.groupBy(by, "hash").agg(n.alias("_k")).groupBy(by).agg((1 - n / F.sum("_k")).alias("exact_dup_rate"))
    return g.join(distinct, by).join(nearest_rank_by(m, by, "n_words", 0.95, "words_p95"), by)
