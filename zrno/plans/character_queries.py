"""The token operators run on characters as tokens, which SQL can count and cut too: streams, tiles, chat examples, batches, replay, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zrno.functions import text as tx
from zrno.operators import chunking, evaluation, training
from zrno.plans.corpus_queries import docs_of
from zrno.plans.model_queries import SPECIAL, training_records
from zrno.plans.registry import query
from zrno.session import cut, spread, table

IDS = "list_transform(string_split({x}, ''), lambda c: unicode(c))"


def ids(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE {IDS.replace('{x}', x)} END"


def characters(text: Column | str) -> Column:
    """Code points of a text; characters beyond the basic plane, which are two units to the JVM, are told by their first."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c))


# What is trained on, as one stream in the order of a hash; the first 31 bits of MD5 serve in both languages.
STREAM = f"""tr AS (SELECT d.rec_id, {ids('text')} AS t FROM corpus_docs d WHERE text IS NOT NULL AND (url IS NULL OR url NOT IN (SELECT url FROM holdout_works WHERE url IS NOT NULL))),
st AS (SELECT rec_id, list_prepend(1, t) AS t, ('0x' || md5(rec_id::VARCHAR)[1:15])::BIGINT AS h FROM tr),
sp AS (SELECT t, len(t) AS n, coalesce(sum(len(t)) OVER (ORDER BY h, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM st),
al AS (SELECT sum(n)::BIGINT AS n FROM sp)"""


def _hash(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, tokens) of all records but the held-out pages."""
    works = table(spark, sf_dir, "holdout_works")
    d = training_records(docs_of(spark, sf_dir, "rec_id", "url", "text").where("text is not null"), works, None)
    t = d.select("rec_id", F.concat(F.array(F.lit(1)), characters("text")).alias("tokens"))
    return cut(training.placed(t.withColumn("n", F.size("tokens")), "rec_id", "n", order=_hash("rec_id")).select("pos", "tokens"), "stream")


@query(f"""WITH {STREAM}, ws AS (SELECT unnest(range(0, ((n - 1) // 256 // 8) * 8)) AS w FROM al), pc AS (SELECT w, pos, t[greatest(w * 256 - pos, 0) + 1:least(w * 256 + 257 - pos, n)] AS x FROM sp JOIN ws ON w * 256 + 257 > pos AND w * 256 < pos + n)
SELECT w // 8 AS batch, w % 8 AS row, md5(array_to_string(x[1:256], ',')) AS x, md5(array_to_string(x[2:257], ',')) AS y FROM (SELECT w, flatten(list(x ORDER BY pos)) AS x FROM pc GROUP BY 1)""")
def character_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 rows of 256 targets over the characters of the training stream, rows by their hash."""
    b = training.batch_rows(_stream(spark, sf_dir), "tokens", 256, 8)
    h = lambda c: F.md5(F.array_join(F.transform(c, lambda v: v.cast("string")), ",").cast("binary")).alias(c)
    return b.select("batch", F.col("row").cast("long").alias("row"), h("x"), h("y"))


@query(f"WITH {STREAM} SELECT n AS n_tokens, (n - 1) // 256 // 8 AS steps FROM al")
def character_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _stream(spark, sf_dir).agg(F.sum(F.size("tokens").cast("long")).alias("n_tokens"))
    return n.select("n_tokens", training.steps_per_epoch(F.col("n_tokens"), 256, 8).cast("long").alias("steps"))


@query(f"""WITH h AS (SELECT rec_id, list_prepend(1, {ids('text')}) AS t FROM corpus_docs WHERE text IS NOT NULL AND url IN (SELECT url FROM holdout_works)), w AS (SELECT rec_id, t, unnest(range(0, len(t) - 1, 256)) AS i FROM h)
SELECT rec_id, i // 256 AS "window", least(256, len(t) - 1 - i) AS n_targets, list_sum(t[i + 1:least(i + 256, len(t))])::BIGINT AS sum_x, list_sum(t[i + 2:i + 257])::BIGINT AS sum_y FROM w""")
def character_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pages tiled into windows of 256 characters: targets and sums of each window."""
    held = table(spark, sf_dir, "holdout_works").select("url").distinct()
    d = docs_of(spark, sf_dir, "rec_id", "url", "text").where("text is not null").join(held, "url", "left_semi")
    t = chunking.tiles(d.select("rec_id", F.concat(F.array(F.lit(1)), characters("text")).alias("tokens")), "rec_id", "tokens", 256)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc + v)
    real = F.filter("y", lambda v: v != -1)
    return t.select("rec_id", F.col("window").cast("long").alias("window"), F.size(real).cast("long").alias("n_targets"), total(F.col("x")).alias("sum_x"), total(real).alias("sum_y"))


CHAT = f"""p AS (SELECT pair_id, len({ids('plain')}) AS a, len({ids('cankar')}) AS b, plain, cankar FROM train_pairs WHERE plain IS NOT NULL AND cankar IS NOT NULL), e AS (SELECT pair_id, plain, cankar, a + 4 AS n_prompt, b + 1 AS n_target, a + b + 5 AS n, a + b + 5 <= 513 AS fits FROM p)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "plain", "cankar").where("plain is not null and cankar is not null"))
    return training.chat_examples(t.select("pair_id", characters("plain").alias("p"), characters("cankar").alias("t")), "pair_id", "p", "t", SPECIAL, 512)


@query(f"WITH {CHAT} SELECT pair_id, n AS n_tokens, n_prompt, n_target, fits, md5(array_to_string(list_concat([50256, 50257], {ids('plain')}, [50258, 50259], {ids('cankar')}, [50260]), ',')) AS tokens, n_prompt - 1 AS ignored FROM e")
def character_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples of characters: tokens by their hash, and how many targets are ignored."""
    e = _examples(spark, sf_dir)
    joined = F.array_join(F.transform("tokens", lambda v: v.cast("string")), ",")
    long = lambda c, name: c.cast("long").alias(name)
    return e.select("pair_id", long(F.size("tokens"), "n_tokens"), long(F.col("n_prompt"), "n_prompt"), long(F.col("n_target"), "n_target"), "fits", F.md5(joined.cast("binary")).alias("tokens"), long(F.size(F.filter("y", lambda v: v == training.IGNORE)), "ignored"))


ORDERED = f"{CHAT}, o AS (SELECT *, (row_number() OVER (ORDER BY n, ('0x' || md5(pair_id::VARCHAR)[1:15])::BIGINT, pair_id) - 1) // 16 AS batch FROM e WHERE fits), wd AS (SELECT batch, max(n) - 1 AS width FROM o GROUP BY 1)"


@query(f"WITH {ORDERED} SELECT batch, pair_id, width, width - (n - 1) AS n_padding, n_target FROM o JOIN wd USING (batch)")
def character_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples in batches of 16 by length, padded to their batch's longest."""
    e = cut(_examples(spark, sf_dir).where("fits"), "examples")
    b = training.length_batches(e.withColumn("n", F.size("tokens")), "pair_id", "n", 16, order=_hash("pair_id"))
    c = training.collate(e.withColumn("n", F.size("tokens")).join(b, "pair_id"), "batch")
    scored = F.size(F.filter("y", lambda v: v != training.IGNORE)).cast("long")
    return c.select("batch", "pair_id", F.size("x").cast("long").alias("width"), (F.size("x") - (F.col("n") - 1)).cast("long").alias("n_padding"), scored.alias("n_target"))


@query(f"WITH {ORDERED}, l AS (SELECT batch, sum(n_target)::BIGINT AS s, 1 + (batch % 7) / 10.0::DOUBLE AS loss FROM o GROUP BY 1) SELECT round(sum(loss * s) / sum(s), 9) AS loss, sum(s)::BIGINT AS n_scored FROM l")
def heldout_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean loss over scored tokens, of batches whose losses are made up from their numbers."""
    c = character_collated(spark, sf_dir).groupBy("batch").agg(F.sum("n_target").alias("s")).withColumn("loss", 1 + (F.col("batch") % 7) / F.lit(10.0))
    return evaluation.weighted_loss(c, "loss", "s").withColumn("loss", F.round("loss", 9))


@query(f"""WITH {CHAT}, f AS (SELECT sum(n_target)::BIGINT AS n, count(*) AS k FROM e WHERE fits), w AS (SELECT greatest(1, round_even(n * (0.2::DOUBLE / 0.8) / 256, 0))::BIGINT AS w FROM f)
SELECT k + w AS n_examples, w AS n_replay, n + 256 * w AS n_target, round(256 * w / (n + 256 * w)::DOUBLE, 9) AS token_share FROM f, w""")
def replay_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples with so many windows of the training stream that a fifth of what is scored is replay."""
    e = cut(_examples(spark, sf_dir).where("fits").select("pair_id", "tokens", "y", "n_prompt", "n_target"), "examples")
    n = e.agg(F.coalesce(F.sum("n_target"), F.lit(0)).alias("n")).select(training.replay_windows(F.col("n"), 256, 0.2).alias("w")).first()[0]
    m = training.with_replay(e, "pair_id", training.draw_windows(training.batch_rows(_stream(spark, sf_dir), "tokens", 256, 8), int(n)))
    g = m.agg(F.count(F.lit(1)).alias("n_examples"), F.sum(F.col("replay").cast("long")).alias("n_replay"), F.sum(F.col("n_target").cast("long")).alias("n_target"), F.sum(F.when(F.col("replay"), F.col("n_target")).otherwise(0)).alias("r"))
    return g.select("n_examples", "n_replay", "n_target", F.round(F.col("r") / F.col("n_target"), 9).alias("token_share"))
