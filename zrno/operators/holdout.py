"""Held-out works, closed against contamination both ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.operators import dedup
from zrno.operators.components import numbered
from zrno.session import cut


@dataclass(frozen=True)
class HoldoutParams:
    fraction: float = 0.05
    least_works: int = 8
    min_chars: int = 3000
    max_chars: int = 45000
    reject: float = 0.5


def select(docs: DataFrame, candidate: Column, p: HoldoutParams = HoldoutParams(), size: str = "size") -> DataFrame:
    """docs: key, url, text, size of one author's records. (key, url, role, max_containment) with role held_out, rejected, clean or contained.

    A candidate is clean if no other record holds `reject` of it. Clean ones are taken in the order of their url's SHA-256 until
    they make up `fraction` of all sizes and are `least_works`. Other records that stand to `reject` in a held-out one are
    contained. Candidates are ordered and summed up range by range.
    """
    sets = dedup.shingle_sets(docs.where("text is not null"), "key", "text")
    within = cut(dedup.containment_pairs(sets, "key", p.reject), "within")
    best = within.groupBy(F.col("a").alias("key")).agg(F.max("containment").alias("most"))
    d = docs.select("key", "url", F.col(size).alias("size"), candidate.alias("candidate")).join(best, "key", "left")
    budget = F.floor(F.lit(p.fraction) * F.sum("size")).alias("budget")
    total = d.agg(budget, F.lit(1).alias("_1"))
    clean = d.where("candidate and most is null and url is not null").withColumn("order", F.sha2("url", 256))
    clean = numbered(clean.select("key", "size", "order"), ["order", "key"], "size", "rank", "before").withColumn("_1", F.lit(1))
    held = cut(clean.join(F.broadcast(total), "_1").where(f"before < budget or rank <= {p.least_works}").select("key"), "held")
    other = within.join(held.select(F.col("key").alias("b")), "b", "left_semi").select(F.col("a").alias("key")).distinct().join(held, "key", "left_anti")
    roles = d.join(held.withColumn("_h", F.lit(True)), "key", "left").join(other.withColumn("_c", F.lit(True)), "key", "left")
    role = F.when(F.col("_h"), "held_out").when(F.col("_c"), "contained").when(F.col("candidate") & F.col("most").isNotNull(), "rejected").when(F.col("candidate"), "clean")
    return roles.select("key", "url", role.alias("role"), F.coalesce("most", F.lit(0.0)).alias("max_containment")).where("role is not null")


def misattributed(docs: DataFrame, wrong: DataFrame) -> DataFrame:
    """(author, url) of records under an author that are known not to be theirs; wrong: (author, url)."""
    return docs.where("url is not null").join(wrong.where("url is not null").select("author", "url").distinct(), ["author", "url"], "left_semi").select("author", "url").distinct()


def require_no_misattributed(docs: DataFrame, wrong: DataFrame) -> None:
    """Fails loud where a misattributed text is back in the merged corpus; names at most ten."""
    found = [r.url for r in misattributed(docs, wrong).orderBy("url").limit(10).collect()]
    if found:
        raise ValueError(f"misattributed texts in the corpus: {found}; merge again")


def require_enough(selected: DataFrame, p: HoldoutParams = HoldoutParams()) -> int:
    """The number of works held out; fewer than least_works are an error."""
    n = selected.where("role = 'held_out'").count()
    if n < p.least_works:
        raise ValueError(f"{n} clean works, {p.least_works} are needed")
    return n


def require_same_corpus(built_on: str, frozen_on: str) -> None:
    """Fails where a table was made of another corpus than the one the held-out works were frozen on: their pages may then miss excerpts."""
    if built_on != frozen_on:
        raise ValueError(f"corpus {built_on[:12]} is not {frozen_on[:12]}, on which the held-out works were frozen; make the table again")


def without(docs: DataFrame, url: str, *excluded: DataFrame) -> DataFrame:
    """docs without those whose url stands in any of the excluded sets (each with a column url)."""
    every = excluded[0].select("url")
    for e in excluded[1:]:
        every = every.union(e.select("url"))
    return docs.join(every.where("url is not null").distinct().withColumnRenamed("url", url), url, "left_anti")


def contained(docs: DataFrame, works: DataFrame, least: float = HoldoutParams.reject) -> DataFrame:
    """docs: key, url, text, author. Keys of records of no held-out page that stand to `least` in a held-out record of their author: the exclusion of pages is closed over them.

    Only records of authors with held-out pages are cut into runs.
    """
    urls = works.select("url").where("url is not null").distinct()
    d = docs.where("text is not null and author is not null")
    authors = cut(d.select("url", "author").join(urls, "url", "left_semi").select("author").distinct(), "authors")
    d = d.join(authors, "author", "left_semi")
    sets = dedup.shingle_sets(d, "key", "text", keep=("url", "author"))
    runs = F.explode(F.transform("sh", lambda s: F.xxhash64("author", s))).alias("s")  # an author's run as one number: nothing else is shuffled
    held = sets.join(urls, "url", "left_semi").select(F.col("key").alias("h"), runs)
    both = sets.join(urls, "url", "left_anti").select("key", runs).join(held, "s").groupBy("key", "h").agg(F.count(F.lit(1)).alias("both"))
    most = both.groupBy("key").agg(F.max("both").alias("both"))
    return most.join(sets.select("key", "n"), "key").where(F.col("both") >= F.lit(least) * F.col("n")).select("key").distinct()


def verify(works: DataFrame, docs: DataFrame) -> DataFrame:
    """(url, state) of each held-out work: ok, drifted where no record of the page has the recorded hash, or missing."""
    d = docs.where("url is not null").select("url", F.sha2("text", 256).alias("h"))
    j = works.select("url", "content_sha256").distinct().join(d, "url", "left")
    hit = F.max((F.col("h") == F.col("content_sha256")).cast("int"))
    state = F.when(F.max("h").isNull(), "missing").when(hit == 1, "ok").otherwise("drifted")
    return j.groupBy("url", "content_sha256").agg(state.alias("state")).groupBy("url").agg(F.max("state").alias("state"))
