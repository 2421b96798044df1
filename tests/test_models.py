import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from zrno.functions import encoding
from zrno.operators import chunking, evaluation, training

TEXT = "Mlinar je šel po cesti. Kje je hiša? Ob vodi!\n\nVrsta ena\nvrsta dve\n\n" * 12 + "dolgabesedabrezpresledkov" * 60 + " ½ ² 𝄞   konec"


def test_fast_split_equals_the_published_pattern():
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=encoding.PATTERN, mergeable_ranks=encoding.ranks(), special_tokens={})
    sizes = encoding.Sizes(encoding.ranks())
    r = random.Random(1)
    for t in [TEXT, "it's we'll  a\n\n b_c 12³ Ⅷ \x1c x\x85y", "".join(r.choice("aé ž\n\t_1²½'’-. 漢́\xa0") for _ in range(3000))]:
        assert sum(sizes[p] for p in encoding.split(t)) == len(enc.encode_ordinary(t))


def test_chunks_keep_everything(spark):
    rows = [(1, TEXT), (2, "kratko"), (3, ""), (4, None), (5, "ena\ndve\n" * 200)]
    d = spark.createDataFrame(rows, "id long, t string")
    c = chunking.chunks(d, "id", "t", 32)
    assert chunking.chunk_faults(d, c, "id", "t", 32).count() == 0
    got = {}
    for r in sorted(c.collect(), key=lambda r: (r.id, r.chunk_index)):
        got.setdefault(r.id, []).append(r)
    assert {i: "".join(r.text for r in x) for i, x in got.items()} == {i: t for i, t in rows if t is not None}
    assert got[2][0].level == -1 and got[1][0].level == 3 and got[5][0].level == 1 and max(r.n_tokens for x in got.values() for r in x) <= 32
    bad = c.withColumn("text", F.when(F.col("id") == 5, "x").otherwise(F.col("text")))
    assert [tuple(r) for r in chunking.chunk_faults(d, bad, "id", "t", 32).collect()] == [(5, "reconstruction")]


def test_crop_by_hand(spark):
    assert chunking.cropped([9], 10) == (0, 10) and chunking.cropped([5, 5], 10) == (1, 12) and chunking.cropped([], 10) == (0, 0)
    d = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (2, 0, 9)], "id long, i int, n_tokens int")
    got = {r.stream: (r.n_tokens, r.n_cropped) for r in chunking.crop_loss(d, ["id", "i"], F.col("id"), 10).collect()}
    assert got == {1: (12, 1), 2: (10, 0)}


def test_tiles_score_every_token_once(spark):
    d = spark.createDataFrame([(1, list(range(10))), (2, [7]), (3, list(range(9)))], "id long, tokens array<int>")
    rows = chunking.tiles(d, "id", "tokens", 4).collect()
    for i, n in ((1, 10), (3, 9)):
        y = [t for r in sorted((r for r in rows if r.id == i), key=lambda r: r.window) for t in r.y]
        assert [t for t in y if t >= 0] == list(range(1, n))
        assert all(len(r.x) == len(r.y) == 4 for r in rows)
    assert not [r for r in rows if r.id == 2]


def test_totals(spark):
    d = spark.createDataFrame([("a", "x", 3), ("a", None, 4), (None, "x", 5)], "s string, a string, n_tokens long")
    got = {(r.s, r.a): r.n_tokens for r in chunking.token_totals(d, "s", "a").collect()}
    assert got[None, None] == 12 and got["a", None] == 7 and got["a", "-"] == 4 and got["-", "x"] == 5


def test_auc_matches_pairs(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 9) / 10, r.random() < 0.4) for _ in range(200)] + [(None, True), (0.5, None)]
    pos, neg = [s for s, p in rows if p and s is not None], [s for s, p in rows if p is False]
    want = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    got = evaluation.auc(spark.createDataFrame(rows, "s double, p boolean"), "s", "p").first()
    assert got.auc == pytest.approx(want) and (got.n_pos, got.n_neg) == (len(pos), len(neg))


def test_controls(spark):
    d = spark.createDataFrame([(i, f"s{i}", f"c{i}") for i in range(5)], "k long, s string, c string").repartition(3)
    got = {(r.k, r.control): (r.source, r.candidate) for r in evaluation.mismatched(d, "k", "s", "c").collect()}
    assert len(got) == 15 and got[1, "echo"] == ("s1", "s1") and all(got[i, "mismatch"] == (f"s{i}", f"c{(i + 2) % 5}") for i in range(5))
    v = "control string, meaning int, voice int, fluency int"
    good = spark.createDataFrame([("real", 5, 4, 4), ("echo", 5, 2, 4), ("mismatch", 1, 4, 4)], v)
    assert evaluation.control_margins(good).first().usable
    bad = spark.createDataFrame([("real", 5, 4, 4), ("echo", 3, 4, 4), ("mismatch", 5, 1, 4)], v)
    assert evaluation.control_margins(bad).first().failures == ["styling", "content", "halo", "echo_meaning"]
    raw = spark.createDataFrame([(1, '```json\n{"meaning": 5, "voice": 4, "fluency": 3, "notes": "x"}\n```'), (2, '{"meaning": 6, "voice": 4, "fluency": 3}'), (3, "ne vem"), (4, None)], "k long, raw string")
    assert [tuple(r) for r in evaluation.verdicts_of(raw, "k", "raw").collect()] == [(1, 5, 4, 3, "x")]


def test_bits_per_byte_by_hand(spark):
    d = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 0), ("a", 2.0, 1), ("b", 1.0, 0)], "g string, n double, b int")
    got = {r.g: r.bpb for r in evaluation.bits_per_byte(d, "n", "b", "g").collect()}
    assert got["a"] == pytest.approx(3 / (math.log(2) * 3)) and got["b"] == float("inf")


def test_style_passages(spark):
    s = "Beseda " + " ".join(f"b{i}" for i in range(39)) + ". "
    d = spark.createDataFrame([(1, s * 5), (5, s.lower() * 5), (2, "kratko. "), (3, " ".join(f"b{i}" for i in range(250))), (4, None)], "id long, t string")
    got = {}
    for r in evaluation.style_passages(d, "id", "t").collect():
        got.setdefault(r.id, []).append(r.n_words)
    assert sorted(got[1]) == [80, 120] and got[5] == [200] and got[3] == [90, 90, 70] and 2 not in got


def test_folds_keep_groups_and_balance(spark):
    r = random.Random(1)
    rows = [(f"g{i}", k < p) for i in range(300) for p, n in [(r.randint(0, 9), r.randint(1, 30))] for k in range(p + n)]
    d = spark.createDataFrame(rows, "g string, y boolean")
    f = {x.g: x.fold for x in evaluation.folds_of(d, "g", "y", 5).collect()}
    assert set(f) == {g for g, _ in rows}
    by = [(sum(f[g] == k for g, _ in rows), sum(f[g] == k and y for g, y in rows)) for k in range(5)]
    assert max(n for n, _ in by) < 1.25 * min(n for n, _ in by) and max(p for _, p in by) < 1.4 * min(p for _, p in by)


def test_style_classifier_learns(spark):
    r = random.Random(1)
    a, b = ["ter", "doklej", "zmerom", "vkup"], ["in", "dokler", "vedno", "skupaj"]
    word = lambda: "".join(r.choice("abeiok") for _ in range(5))
    rows = [(" ".join(r.choice(a if i % 2 else b) if k % 4 == 0 else word() for k in range(40)), i % 2, f"g{i // 4}", "XY"[i % 2]) for i in range(120)]
    d = spark.createDataFrame(rows, "t string, y int, g string, who string")
    scored = evaluation.cross_validate(d, "t", "y", "g", "words", k=2, min_df=2, keep=("who",))
    got = evaluation.fold_metrics(scored, 2).collect()
    assert len(got) == 2 and all(x.auc > 0.9 and x.average_precision > 0.9 and 0 < x.pos_rate < 1 for x in got) and sum(x.n for x in got) == 120
    means = {x.who: x.mean_probability for x in evaluation.author_means(scored, "who").collect()}
    assert means["Y"] > 0.5 > means["X"]
    models = evaluation.style_models(d.withColumn("fold", F.lit(0)), "t", "y", "fold", "words", k=1, min_df=2)
    top = {(x.side, x.term) for x in evaluation.top_features(models, 4).collect()}
    assert {t for s, t in top if s == "for"} <= {*a} | {f"{x} {y}" for x in a for y in a} and len(top) == 8


@pytest.mark.parametrize("family", ["function_words", "characters", "words"])
def test_style_models_are_fitted_on_all_passages(spark, family):
    from collections import Counter

    import numpy as np

    r = random.Random(5)
    kinds = [(" ".join(r.choice(["in", "pa", "ter", "ker", "da", "inpa", "terda"]) for _ in range(r.randint(2, 9))), r.random() < 0.3) for _ in range(60)]
    kinds.append(("nikoli", True))
    times = 700  # 42,700 passages
    d = spark.range(times).crossJoin(spark.createDataFrame([(t, int(y), i % 3) for i, (t, y) in enumerate(kinds)], "t string, y int, fold int"))
    got = {}
    for x in evaluation.style_models(d, "t", "y", "fold", family, k=3).collect():
        got.setdefault(x.fold, {})[x.term] = (x.idf, x.coef)
    assert set(got) == {-1, 0, 1, 2}
    for left in got:
        rows = [(Counter(evaluation.terms(t, family)), y) for i, (t, y) in enumerate(kinds) if i % 3 != left]
        names = sorted({t for c, _ in rows for t in c})
        assert names == sorted(t for t in got[left] if t)
        n, y = times * len(rows), np.array([float(y) for _, y in rows])
        idf = np.array([math.log((1 + n) / (1 + times * sum(t in c for c, _ in rows))) + 1 for t in names])
        assert [got[left][t][0] for t in names] == pytest.approx(idf)
        x = np.array([[(1 + math.log(c[t])) if t in c else 0.0 for t in names] for c, _ in rows]) * idf
        x = np.c_[x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9), np.ones(len(rows))]
        w, v, ridge = times * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), np.zeros(x.shape[1]), np.append(np.ones(len(names)), 0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ v))
            v = v - np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * v) * 0.5
        mine = np.array([got[left][t][1] for t in [*names, None]])
        assert np.abs(x @ mine - x @ v).max() < 0.02 * np.abs(x @ v).max()


def test_families_of_features():
    assert evaluation.terms("Solnce je", "one_spelling") == evaluation.terms("sonce je", "characters")
    assert evaluation.terms("Ko je prišel, je šel.", "function_words") == ["ko", "je", "je"]
    assert evaluation.terms("a b a", "words") == ["a", "b", "a", "a b", "b a"] and evaluation.terms("", "words") == []


def test_average_precision_by_steps(spark):
    rows = [(0.9, True), (0.8, False), (0.7, True), (0.7, False), (0.1, True), (0.0, False)]
    got = evaluation.average_precision(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()[0]
    assert abs(got - (1 + 2 / 4 + 3 / 5) / 3) < 1e-12


def test_fold_metrics_are_those_of_each_fold(spark):
    r = random.Random(3)
    rows = [(f, float(r.randint(0, 40)), r.random() < 0.3 and f != 2) for f in (0, 1, 2) for _ in range(300)]
    d = spark.createDataFrame(rows, "fold int, score double, label boolean")
    got = {x.fold: x for x in evaluation.fold_metrics(d, 4).collect()}
    assert set(got) == {0, 1, 2, 3} and (got[3].n, got[3].auc, got[2].n_pos, got[2].auc) == (0, None, 0, None)
    for f in (0, 1):
        own = d.where(F.col("fold") == f)
        assert got[f].auc == pytest.approx(evaluation.auc(own, "score", "label").first().auc, abs=1e-12) and got[f].n == 300
        assert got[f].average_precision == pytest.approx(evaluation.average_precision(own, "score", "label").first()[0], abs=1e-12)


def test_weighted_loss_and_deploy_status(spark):
    d = spark.createDataFrame([(1.0, 10), (3.0, 30), (9.0, 0), (None, 5)], "l double, n int")
    assert tuple(evaluation.weighted_loss(d, "l", "n").first()) == (2.5, 40)
    assert tuple(evaluation.weighted_loss(d.where("n > 100"), "l", "n").first()) == (0.0, 0)
    a = spark.createDataFrame([("m1", "x"), ("m2", "y")], "artifact string, sha256 string")
    r = spark.createDataFrame([("x", "measured_inadequate", "1"), ("x", "validated", "2"), ("z", "validated", "1")], "artifact_sha256 string, verdict string, created_at string")
    assert {x.artifact: x.status for x in evaluation.deploy_status(a, r).collect()} == {"m1": "validated", "m2": "pending"}


def test_replay_windows_are_drawn(spark):
    rows = spark.createDataFrame([(b, r, [b, r, 1], [r, 1, 9]) for b in range(5) for r in range(4)], "batch long, row int, x array<int>, y array<int>")
    w = training.draw_windows(rows, 7).collect()
    assert len(w) == 7 and all(x.tokens == [*x.tokens[:3], 9] and x.n_prompt == 1 and x.n_target == 3 and x.replay for x in w)
    assert {x.key for x in w} == {x.key for x in training.draw_windows(rows, 7).collect()} != {x.key for x in training.draw_windows(rows, 7, seed=2).collect()}
    with pytest.raises(ValueError):
        training.draw_windows(rows, 21)


def test_style_folds_keep_clusters_and_leave_out_held_and_verse(spark, tmp_path, monkeypatch):
    from zrno.plans import model_queries as q

    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b = word("mlin", 120), word("reka", 120)
    rows = [(1, "u1", "A", a), (2, "u2", "A", a + " " + word("konec", 40)), (3, None, "A", b), (4, "u4", "B", b), (5, "u5", "A", word("drzan", 100)), (6, "u6", "A", word("drzan", 60)), (7, "u7", "A", "\n".join(word(f"v{i}k", 4) for i in range(40)))]
    spark.createDataFrame([(*r, "wikivir") for r in rows], "rec_id long, url string, author string, text string, source string").write.parquet(f"{tmp_path}/corpus_docs.parquet")
    spark.createDataFrame([("u5",)], "url string").write.parquet(f"{tmp_path}/holdout_works.parquet")
    spark.createDataFrame([(1, "A")], "author_id long, name string").write.parquet(f"{tmp_path}/authors.parquet")
    seen = []

    def fake(p, text, label, group, family, k=5):
        seen.append((family, k, {r.rec_id: r[group] for r in p.collect()}))
        return spark.range(1)

    monkeypatch.setattr(evaluation, "cross_validate", fake)
    monkeypatch.setattr(evaluation, "fold_metrics", lambda scored, k=5: scored)
    q.style_folds(spark, str(tmp_path))
    assert [(f, k) for f, k, _ in seen] == [(f, 5) for f in ("characters", "words", "function_words", "one_spelling")]
    assert all(g == {1: 1, 2: 1, 3: 3, 4: 4} for _, _, g in seen)


def test_stream_and_batches(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(100) for _ in range(r.randint(1, 30))]) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, tokens array<int>").withColumn("n", F.size("tokens"))
    p = training.placed(d, "id", "n")
    stream = [t for x in sorted(p.collect(), key=lambda x: x.pos) for t in x.tokens]
    assert len(stream) == sum(len(t) for _, t in rows)
    b = sorted(training.batch_rows(p, "tokens", 16, 3).collect(), key=lambda x: (x.batch, x.row))
    assert len(b) == (len(stream) - 1) // 16 // 3 * 3
    for k, x in enumerate(b):
        assert x.x == stream[k * 16 : k * 16 + 16] and x.y == stream[k * 16 + 1 : k * 16 + 17]
    again = training.placed(d.repartition(7), "id", "n")
    assert {x.id: x.pos for x in again.collect()} == {x.id: x.pos for x in p.collect()}


def test_training_leaves_out_what_is_held_out(spark, tmp_path):
    import tiktoken

    from zrno.plans import all_queries

    enc = tiktoken.Encoding("t", pat_str=encoding.PATTERN, mergeable_ranks=encoding.ranks(), special_tokens={})
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, "u1", "A", word("drzan", 300)), (2, None, "A", word("brez", 900)), (3, "u3", "B", word("mlin", 900)), (4, "u4", "A", None), (5, "u5", "A", ""), (6, "u6", "A", word("drzan", 40)), (7, "u1", None, word("tisk", 20))]
    spark.createDataFrame([(*r, "s") for r in rows], "rec_id long, url string, author string, text string, source string").write.parquet(f"{tmp_path}/corpus_docs.parquet")
    spark.createDataFrame([("u1",), (None,)], "url string").write.parquet(f"{tmp_path}/holdout_works.parquet")
    kept = {i: [50256] + enc.encode_ordinary(t) for i, _, _, t in rows if i in (2, 3, 5)}
    n = sum(map(len, kept.values()))
    assert all_queries()[0]["steps_per_epoch"](spark, str(tmp_path)).first().n_tokens == n
    b = sorted(all_queries()[0]["train_batches"](spark, str(tmp_path)).collect(), key=lambda x: (x.batch, x.row))
    assert len(b) == (n - 1) // 256 // 8 * 8 > 0
    stream = [t for x in b for t in x.x] + b[-1].y[-1:]
    at = [i for i, t in enumerate(stream) if t == 50256] + [None]
    docs = [stream[i:j] for i, j in zip(at, at[1:])]
    assert docs[:-1] == [d for d in docs[:-1] if d in kept.values()] and any(d[: len(docs[-1])] == docs[-1] for d in kept.values())


def test_chat_examples(spark):
    sp = {"bos": 1, "user_start": 2, "user_end": 3, "assistant_start": 4, "assistant_end": 5}
    d = spark.createDataFrame([(1, [10, 11], [20]), (2, [10] * 9, [20] * 9), (3, [9], [8])], "k long, p array<int>, t array<int>")
    e = training.chat_examples(d, "k", "p", "t", sp, 10)
    r = {x.k: x for x in e.collect()}
    assert r[1].tokens == [1, 2, 10, 11, 3, 4, 20, 5] and r[1].y == [-1] * 5 + [20, 5] and r[1].fits and not r[2].fits
    b = training.length_batches(e.where("fits").withColumn("n", F.size("tokens")), "k", "n", 2)
    c = {x.k: x for x in training.collate(e.where("fits").join(b, "k"), "batch").collect()}
    assert len(c[3].x) == len(c[3].y) == 7 and c[3].x[-1] == 0 and c[3].y[-1] == -1 and c[1].x == r[1].tokens[:-1]
    s = spark.createDataFrame([(0, 10, False), (0, 30, True), (1, 60, False)], "b int, n int, r boolean")
    assert tuple(training.replay_shares(s, "b", "n", "r").first()) == (0.3, 0.5)
    n = spark.createDataFrame([(1000,), (1,)], "n long").select(training.replay_windows(F.col("n"), 100, 0.2)).collect()
    assert [x[0] for x in n] == [2, 1]


def test_vocabulary(spark):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=encoding.PATTERN, mergeable_ranks=encoding.ranks(), special_tokens={})
    assert chunking.segmented("mlinarjeva", enc).replace("|", "") == "mlinarjeva"
    v = chunking.vocabulary_table(spark)
    assert v.count() == 50256 and v.where("has_digit and not text rlike '[0-9]'").count() == 0
