"""Metrics: rank AUC, control margins, bits per byte, style passages and a grouped, cross-validated style classifier."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zrno.functions.text import words
from zrno.operators import linear
from zrno.operators.components import numbered, ranked
from zrno.session import cut, drop

# The spelling pair, function words of the ablation in their published order, control margin and fitness floor.
SPELLING = (r"([sS])oln([cčCČ])", "$1on$2")
FUNCTION_WORDS = (
    "in pa ter ali a ampak toda ker da ki ko če kakor kot saj sicer "
    "je so sem si smo ste bil bila bilo bili bom boš bo bomo boste bodo bi biti "
    "ne ni nič se me te ga jo jih nas vas jim mu ji mi ti on ona ono oni vi "
    "moj tvoj njegov njen naš vaš svoj ta to tega tem taka tisti tale "
    "v na z s k h o po za do od pri pred med nad pod ob čez skozi brez proti iz "
    "zaradi kljub kdo kaj kje kam kdaj kako zakaj kateri kdor "
    "tudi še že le samo celo prav zelo bolj najbolj tako potem zdaj takrat tam "
    "tukaj tja vsak ves vsi nekaj nekdo nihče noben"
)
MARGIN, AUC_FLOOR = 1.0, 0.75
# The families of the ablation.
FAMILIES = ("characters", "words", "function_words", "one_spelling")


def spelling(text: Column) -> Column:
    return F.regexp_replace(text, *SPELLING)


def auc(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auc): the chance that a positive outscores a negative, ties half; null where there are none of one side.

    Scores are counted by value first; the running sum over distinct values is range-partitioned, so no task sees them all.
    """
    s = scores.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    s = cut(s.repartitionByRange(score).withColumn("part", F.spark_partition_id()), "scores")
    whole = s.groupBy("part").agg(F.sum("q").alias("q"), F.min(score).alias("lo"))
    before = whole.withColumn("before", F.coalesce(F.sum("q").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row for each partition
    within = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = s.withColumn("below", within).join(F.broadcast(before), "part")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("before") + F.col("q") / 2.0))
    return r.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), (wins / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def deploy_check(scores: DataFrame, own: str, peer: str, plain: str) -> DataFrame:
    """One row from scores of aligned texts (a work's own, a peer's and a plain rewriting): means, how much of the difference is style and how much topic, both AUCs and the verdict. Rows without all three are left out of the pair and the means alike."""
    d = cut(scores.where(F.col(own).isNotNull() & F.col(peer).isNotNull() & F.col(plain).isNotNull()).select(F.col(own).alias("o"), F.col(peer).alias("p"), F.col(plain).alias("q")), "deploy")
    m = d.agg(F.count(F.lit(1)).alias("n"), F.avg("o").alias("mean_own"), F.avg("p").alias("mean_peer"), F.avg("q").alias("mean_plain"), F.avg(F.when(F.col("o") > F.col("q"), 1.0).when(F.col("o") == F.col("q"), 0.5).otherwise(0.0)).alias("paired_auc"))
    un = auc(d.select(F.col("o").alias("x"), F.lit(True).alias("y")).union(d.select("q", F.lit(False))), "x", "y").select(F.col("auc").alias("unpaired_auc"))
    r = m.join(F.broadcast(un)).withColumns({"style_effect": F.col("mean_own") - F.col("mean_plain"), "topic_effect": F.col("mean_own") - F.col("mean_peer")})
    return r.withColumn("verdict", deploy_verdict(F.col("unpaired_auc"), F.col("style_effect"), F.col("topic_effect")))


def deploy_status(artifacts: DataFrame, records: DataFrame) -> DataFrame:
    """(artifact, sha256, status): the recorded verdict only where it was measured on exactly this artifact, else pending."""
    r = records.select(F.col("artifact_sha256").alias("sha256"), "verdict", "created_at").groupBy("sha256").agg(F.max_by("verdict", "created_at").alias("verdict"))
    return artifacts.join(r, "sha256", "left").select("artifact", "sha256", F.coalesce("verdict", F.lit("pending")).alias("status"))


def weighted_loss(batches: DataFrame, loss: str, n_scored: str) -> DataFrame:
    """(loss, n_scored): the mean of batches' losses by their scored tokens; batches that score none are left out, and no tokens at all give 0."""
    n = F.sum(F.when((F.col(n_scored) > 0) & F.col(loss).isNotNull(), F.col(n_scored)))
    total = F.sum(F.when(F.col(n_scored) > 0, F.col(loss) * F.col(n_scored)))
    return batches.agg((F.coalesce(total, F.lit(0.0)) / F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))).alias("loss"), F.coalesce(n, F.lit(0)).cast("long").alias("n_scored"))


def paired_auc(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, paired_auc, effect): the share of pairs in which a outscores b, ties half, and the mean difference."""
    x = F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("paired_auc"), (F.avg(a) - F.avg(b)).alias("effect"))


def deploy_verdict(a: Column, style: Column, topic: Column) -> Column:
    return F.when((a >= AUC_FLOOR) & (style > topic), "validated").otherwise("measured_inadequate")


def mismatched(pairs: DataFrame, key: str, source: str, candidate: str) -> DataFrame:
    """(key, source, candidate, control): each pair as it is (real), its source repeated (echo), and with the candidate half the table further on (mismatch).

    Keys are numbered range by range, the texts are joined.
    """
    at = cut(numbered(pairs.select(key), [key]).select(key, (F.col("rn") - 1).alias("i")), "positions")
    n = at.count()
    p = pairs.join(at, key)
    real, echo = p.select(key, F.col(source).alias("source"), F.col(candidate).alias("candidate"), F.lit("real").alias("control")), p.select(key, F.col(source).alias("source"), F.col(source).alias("candidate"), F.lit("echo").alias("control"))
    other = p.select(((F.col("i") + n - n // 2) % max(n, 1)).alias("i"), F.col(candidate).alias("candidate"))
    return real.union(echo).union(p.select(key, "i", F.col(source).alias("source")).join(other, "i").select(key, "source", "candidate", F.lit("mismatch").alias("control")))


def without_verdict(items: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Control items that no verdict came for; a run with any can't be judged."""
    return items.where("control <> 'none'").join(verdicts.select(key).distinct(), key, "left_anti")


def control_margins(verdicts: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row from (control, meaning, voice, fluency): means by control, margins, and the list of failures."""
    mean = lambda c, k: F.avg(F.when(F.col("control") == k, F.col(c)))
    m = verdicts.agg(*[mean(c, k).alias(f"{k}_{c}") for k in ("real", "echo", "mismatch") for c in ("meaning", "voice", "fluency")])
    c = F.col
    fails = F.array_compact(F.array(
        F.when(c("real_voice") - c("echo_voice") < margin, "styling"), F.when(c("real_meaning") - c("mismatch_meaning") < margin, "content"),
        F.when(F.abs(c("mismatch_voice") - c("real_voice")) >= margin, "halo"), F.when(c("echo_meaning") < c("real_meaning") - margin, "echo_meaning"),
    ))
    return m.withColumns({"voice_margin": c("real_voice") - c("echo_voice"), "meaning_margin": c("real_meaning") - c("mismatch_meaning"), "failures": fails}).withColumn("usable", F.size("failures") == 0)


def series(verdicts: DataFrame, prefix: Column, axes: tuple[str, ...] = ("meaning", "voice", "fluency")) -> DataFrame:
    """(series, n, *axes): means by series and over all ('all')."""
    d = verdicts.withColumn("series", prefix)
    return d.select(F.explode(F.array("series", F.lit("all"))).alias("series"), *axes).groupBy("series").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in axes])


def verdicts_of(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, meaning, voice, fluency, notes) of the valid verdicts in JSON answers, with or without a code fence; axes are whole numbers from 1 to 5."""
    body = F.regexp_extract(F.col(raw), r"(?s)(\{.*\})", 1)
    v = answers.select(key, F.from_json(body, "meaning int, voice int, fluency int, notes string").alias("v")).select(key, "v.*")
    return v.where("meaning between 1 and 5 and voice between 1 and 5 and fluency between 1 and 5")


def bits_per_byte(scored: DataFrame, nats: str, n_bytes: str, *by: str) -> DataFrame:
    """Bits per byte of tokens with nats and bytes; tokens without bytes drop out of both sums, and no bytes at all make it infinite."""
    some = F.col(n_bytes) > 0
    b = F.sum(F.when(some, F.col(n_bytes)))
    return scored.groupBy(*by).agg(F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(float("inf"))).otherwise(F.sum(F.when(some, F.col(nats))) / (F.log(F.lit(2.0)) * b)).alias("bpb"), F.coalesce(b, F.lit(0)).alias("n_bytes"))


def unigram_nats(train: DataFrame, test: DataFrame, word: str) -> DataFrame:
    """test with nats: minus the log of a word's share in train, with one added to every count, also of the unknown word."""
    n = train.groupBy(word).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_kinds")).withColumn("_1", F.lit(1))
    t = test.join(n, word, "left").withColumn("_1", F.lit(1)).join(F.broadcast(total), "_1")
    return t.withColumn("nats", -F.log((F.coalesce("_n", F.lit(0)) + 1) / (F.col("_total") + F.col("_kinds") + 1))).drop("_n", "_1", "_total", "_kinds")


def style_passages(docs: DataFrame, key: str, text: str, target: int = 90, least: int = 30, most: int = 200) -> DataFrame:
    """(key, n, passage, n_words): whole sentences gathered to `target` words; shorter rests than `least` are dropped, longer passages than `most` are cut into pieces of `target`."""
    sents = F.filter(F.transform(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), r"(?<=[.!?…])\s+(?=[A-ZČŠŽ])"), words), lambda w: F.size(w) > 0)
    d = cut(docs.where(F.col(text).isNotNull()).select(key, sents.alias("_s")), "words")
    row = "array<array<string>>"
    zero = F.struct(F.array().cast(row).alias("out"), F.array().cast("array<string>").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        b = F.concat(acc.buf, s)
        full = F.size(b) >= target
        return F.struct(F.when(full, F.concat(acc.out, F.array(b))).otherwise(acc.out).alias("out"), F.when(full, F.array().cast("array<string>")).otherwise(b).alias("buf"))

    got = F.aggregate("_s", zero, step, lambda a: F.when(F.size(a.buf) >= least, F.concat(a.out, F.array(a.buf))).otherwise(a.out))
    p = cut(d.select(key, F.posexplode(got).alias("i", "w")), "passages")
    cuts = F.when(F.size("w") <= most, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(target)), lambda k: F.slice("w", k, target)))
    return p.select(key, F.struct("i", F.lit(0)).alias("o"), F.explode(cuts).alias("w")).select(key, F.col("o.i").alias("n"), F.array_join("w", " ").alias("passage"), F.size("w").alias("n_words"))


_SOLN = re.compile(r"([sS])oln([cčCČ])")
_FUNCTION = frozenset(FUNCTION_WORDS.split())


def pieces(text: str, family: str) -> list[str]:
    """What a passage's features are counted in: words (single and pairs), function words, or words of which characters are taken, after spelling is made one or as they are."""
    w = (_SOLN.sub(r"\1on\2", text) if family == "one_spelling" else text).casefold().split()
    if family == "words":
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    if family == "function_words":
        return [x for t in w if (x := t.strip(".,;:!?…\"'()[]«»„“”–—-")) in _FUNCTION]
    return w


def parts(piece: str, family: str) -> list[str]:
    """Features of a piece: itself, or its characters (3 to 5 within words)."""
    if family in ("words", "function_words"):
        return [piece]
    t = f" {piece} "
    return [t[i : i + k] for k in (3, 4, 5) for i in range(max(1, len(t) - k + 1))]


def terms(text: str, family: str) -> list[str]:
    """Features of a passage."""
    return [t for p in pieces(text, family) for t in parts(p, family)]


def folds_of(passages: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, fold): groups are kept whole; those of one majority label and size, by powers of two, are dealt in the order of a hash, so folds are alike in both. No list of groups comes to the driver."""
    g = passages.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    g = g.select(group, F.floor(F.log2("n")).cast("int").alias("size"), (2 * F.col("p") >= F.col("n")).alias("major"))
    dealt = ranked(g, ["major", "size"], F.xxhash64(group), "rn")
    return dealt.select(group, F.pmod(F.col("rn") - 1 + F.col("size"), F.lit(k)).cast("int").alias("fold"))


def _fitted(d: DataFrame, family: str, left: list[int], min_df: int) -> linear.Fitted:
    return linear.Fitted(d, partial(pieces, family=family), partial(parts, family=family), left, min_df)


def style_models(passages: DataFrame, text: str, label: str, fold: str, family: str, k: int = 5, min_df: int = 5) -> DataFrame:
    """(fold, term, idf, coef): a model for each fold left out, and one, fold -1, of all, each fitted on all its passages; the row without a term has the bias.

    Passages stay where they are; the driver and each task hold the models, which grow as the terms of `min_df` passages or more.
    """
    d = passages.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"))
    return _fitted(cut(d, "passages"), family, [*range(-1, k)], min_df).table()


def average_precision(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """(average_precision): the mean of the precision over the steps of the recall; equal scores are one step. Counted by distinct score, range by range."""
    s = scores.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    s = cut(s.repartitionByRange(F.desc(score)).withColumn("part", F.spark_partition_id()), "steps")
    whole = s.groupBy("part").agg(F.sum("p").alias("wp"), F.sum("n").alias("wn"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = whole.select("part", F.coalesce(F.sum("wp").over(earlier), F.lit(0)).alias("bp"), F.coalesce(F.sum("wn").over(earlier), F.lit(0)).alias("bn"))
    upto = Window.partitionBy("part").orderBy(F.desc(score))
    r = s.withColumns({"sp": F.sum("p").over(upto), "sn": F.sum("n").over(upto)}).join(F.broadcast(before), "part")
    return r.agg((F.sum(F.col("p") * (F.col("sp") + F.col("bp")) / (F.col("sn") + F.col("bn"))) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def cross_validate(passages: DataFrame, text: str, label: str, group: str, family: str = "characters", k: int = 5, min_df: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """passages (text, label, group, *keep) with fold and score, the score by a model of all passages that saw nothing of the passage's group."""
    d = cut(passages.select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(group).cast("string").alias("group"), *keep), "passages")
    d = cut(d.join(folds_of(d, "group", "label", k), "group").withColumn("row", F.monotonically_increasing_id()), "folds")
    m = _fitted(d.withColumn("label", F.col("label").cast("int")), family, [*range(k)], min_df)
    scores = cut(m.scores(), "scores")
    drop(m.blocks)
    return d.join(scores, "row").drop("row")


def fold_metrics(scored: DataFrame, k: int = 5) -> DataFrame:
    """(fold, n, n_pos, pos_rate, auc, average_precision) of each fold of cross_validate(), as auc() and average_precision() have them, all folds at once: by distinct score, range by range."""
    y = F.col("label").cast("boolean").cast("long")
    s = scored.groupBy("fold", "score").agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n"))
    s = cut(s.repartitionByRange("fold", F.desc("score")).withColumn("part", F.spark_partition_id()), "steps")
    whole = s.groupBy("fold", "part").agg(F.sum("p").alias("wp"), F.sum("n").alias("wn"))
    earlier = Window.partitionBy("fold").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = whole.select("fold", "part", F.coalesce(F.sum("wp").over(earlier), F.lit(0)).alias("bp"), F.coalesce(F.sum("wn").over(earlier), F.lit(0)).alias("bn"))
    upto = Window.partitionBy("fold", "part").orderBy(F.desc("score"))
    r = s.withColumns({"sp": F.sum("p").over(upto), "sn": F.sum("n").over(upto)}).join(F.broadcast(before), ["fold", "part"])
    r = r.withColumns({"sp": F.col("sp") + F.col("bp"), "sn": F.col("sn") + F.col("bn")})
    wins = F.sum((F.col("n") - F.col("p")) * (F.col("sp") - F.col("p") / 2))  # a negative's wins are the positives above it and half of those beside it
    m = r.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("p").alias("n_pos"), wins.alias("wins"), F.sum(F.col("p") * F.col("sp") / F.col("sn")).alias("steps"))
    all_ = scored.sparkSession.range(k).select(F.col("id").cast("int").alias("fold")).join(m, "fold", "left").fillna(0, ["n", "n_pos"])
    sides = F.nullif(F.col("n_pos") * (F.col("n") - F.col("n_pos")), F.lit(0))
    return all_.select("fold", "n", "n_pos", (F.col("n_pos") / F.nullif(F.col("n"), F.lit(0))).alias("pos_rate"), (F.col("wins") / sides).alias("auc"), (F.col("steps") / F.nullif(F.col("n_pos"), F.lit(0))).alias("average_precision"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row: mean and deviation of the folds' AUC, mean of their average precision."""
    return metrics.agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("average_precision").alias("average_precision_mean"))


def author_means(scored: DataFrame, author: str) -> DataFrame:
    """(author, n, mean_probability): out-of-fold probabilities by author."""
    return scored.groupBy(author).agg(F.count(F.lit(1)).alias("n"), F.avg(1 / (1 + F.exp(-F.col("score")))).alias("mean_probability"))


def top_features(models: DataFrame, n: int = 25) -> DataFrame:
    """(side, place, term, coef): the n terms that speak most for and most against, of the model of all passages."""
    t = models.where("fold = -1 and term is not null").select("term", "coef")
    take = lambda side, o: t.orderBy(o, "term").limit(n).withColumns({"side": F.lit(side), "place": F.row_number().over(Window.orderBy(o, "term"))})
    return take("for", F.desc("coef")).union(take("against", F.asc("coef"))).select("side", "place", "term", "coef")
