"""Every operator with nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from zrno.llm import defects, levels, mixing, mojibake, near, packing, scans, spans, splits

CLASH = ["id", "k", "s", "r", "text", "n", "vec", "a", "b", "key", "source", "level", "class_id", "band", "fp", "token", "word", "label", "page", "component", "shard", "block", "_n", "_1"]
BASE = "Stara hiša stoji ob vodi in stari mož počasi hodi po cesti. Mlada žena čaka pred vrati, otrok pa spi v topli sobi. "


def texts():
    long = " ".join(f"beseda{i % 97} hiša{i % 31} reka{i % 13}" for i in range(30_000))
    return [BASE * 3, BASE * 3, None, "", "   ", "ena", long, "x" * 5000, BASE * 2 + "Dodatek na koncu.", "\n\n\n", "- 12 -\n", "�"]


def frame(spark, rows, schema, name="doc"):
    """rows with extra columns of clashing names."""
    d = spark.createDataFrame(rows, schema)
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in d.columns])


def docs(spark, empty=False):
    rows = [] if empty else [(i, t, f"s{i % 3}" if i % 4 else None, "Naslov" if i % 2 else None, "Ana Novak" if i % 3 else None, f"https://x.example/wiki/P{i % 5}" if i % 6 else None) for i, t in enumerate(texts())]
    return frame(spark, rows, "doc long, body string, origin string, title string, author string, url string")


@pytest.mark.parametrize("empty", [False, True])
def test_pairs(spark, empty):
    rows = [] if empty else [(1, None, None), (2, BASE, None), (3, None, BASE), (4, BASE, BASE), (5, BASE * 9, "Stara hiša stoji ob"), (6, "", ""), (None, BASE, BASE), (7, "x" * 9000, "y" * 9000)]
    got = {r[0]: r[1] for r in defects.flag_pairs(frame(spark, rows, "pid long, ask string, answer string"), "pid", "ask", "answer").collect()}
    if empty:
        assert got == {}
    else:
        assert got[1] == got[2] == got[6] == ["empty"] and got[4] == ["copy"] and got[5] == ["truncated"] and got[3] == [] and len(got) == 8


@pytest.mark.parametrize("empty", [False, True])
def test_splits(spark, empty):
    roster = frame(spark, [(1, "Ana Novak", ["Pika Nogavička"]), (2, "Bor Žagar", None), (3, None, [])], "author_id long, name string, aliases array<string>")
    rows = [] if empty else [(1, "w", "Novak, Ana", None), (2, "w", "A. Novak", "http://x.example/wiki/P"), (3, "w", None, "https://www.x.example/wiki/P/"), (4, None, "Bor Zagar", None), (5, "w", "neznan", " "), (6, "w", None, None), (6, "w", None, None), (7, "w", "PIKA NOGAVIČKA (1880–1950)", None)]
    d = frame(spark, rows, "rec_id long, source string, author string, url string")
    tied = splits.entities(d, roster)
    got = sorted((r.rec_id, r.group_id) for r in tied.where("group_id is not null").collect())
    assert got == ([] if empty else [(1, 1), (2, 1), (3, 1), (4, 2), (7, 1)])
    out = splits.assign_splits(tied, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(out) == len(rows)
    assert all(len({r.split for r in out if r.component == c}) == 1 for c in {r.component for r in out})


@pytest.mark.parametrize("empty", [False, True])
def test_near(spark, empty):
    classes, pairs = near.near_pairs(docs(spark, empty), "doc", "body", least=0.5)
    got = sorted((r.a, r.b) for r in near.expand(classes, pairs).collect())
    assert got == ([] if empty else [(0, 1), (0, 8), (1, 8)])
    g = {r.id: r for r in near.groups(classes, pairs).collect()}
    assert empty and not g or g[1].class_id == 0 and g[8].group_id == 0 and g[6].links == 0


@pytest.mark.parametrize("empty", [False, True])
def test_spans(spark, empty):
    classes, pairs = spans.shared_pairs(docs(spark, empty), "doc", "body", span=150)
    got = sorted((r.a, r.b) for r in near.expand(classes, pairs).collect())
    assert got == ([] if empty else [(0, 1), (0, 8), (1, 8)])
    share = {r.id: r.share for r in spans.shared_share(docs(spark, empty), "doc", "body", span=150).collect()}
    assert empty and not share or share[0] == 1.0 and share[6] == 0.0 and 0.8 < share[8] < 1.0


@pytest.mark.parametrize("empty", [False, True])
def test_mojibake(spark, empty):
    got = {r.doc: r for r in mojibake.restore(docs(spark, empty), "doc", "body").collect()}
    assert set(got) == (set() if empty else {11})


@pytest.mark.parametrize("empty", [False, True])
def test_scans(spark, empty):
    assert scans.noise(docs(spark, empty), "doc", "body", "title", "author").count() == 0
    assert scans.repair(docs(spark, empty), "doc", "body", "title", "author", docs(spark, empty).select("doc")).count() == (0 if empty else 9)


@pytest.mark.parametrize("empty", [False, True])
def test_packing(spark, empty):
    d = docs(spark, empty)
    out = packing.pack(d.union(d) if not empty else d, "doc", "body", capacity=64).collect()
    assert empty == (not out)
    fill = {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert all(v <= 64 for v in fill.values()) and {r.doc for r in out} == (set() if empty else set(range(12)))


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, empty):
    targets = frame(spark, [] if empty else [("s0", 0.5, 2), ("s1", 0.5, None), ("s9", 0.1, 3), (None, 0.2, 1), ("s2", None, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs(spark, empty), targets, "doc", "body", "origin")
    rows = m.collect()
    assert all(r.copies <= {"s0": 2, "s1": 1}[r.origin if "origin" in r else r.source] for r in rows)
    assert mixing.shares(m, targets).count() == (0 if empty else 5)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("rated", [False, True])
def test_levels(spark, empty, rated):
    rows = [(0, 2, "a"), (0, 2, "a"), (1, None, "b"), (8, 9, "b"), (6, 5, None), (None, 3, "c")] if rated else []
    labels = frame(spark, rows, "doc long, level int, rater string")
    got = {r.doc: r.level for r in levels.grade(docs(spark, empty), labels, "doc", "body", "origin", least=200).collect()}
    assert set(got) == (set() if empty else {0, 1, 6, 7, 8}) and all(1 <= v <= 5 for v in got.values())
