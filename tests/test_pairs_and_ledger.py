import datetime

import pytest
from pyspark.sql import functions as F

from zrno.operators import holdout, ledger, pairs


def one(spark, expr, *vals):
    return spark.createDataFrame([vals], ", ".join(f"c{i} string" for i in range(len(vals)))).select(expr.alias("x")).first()[0]


def test_sentences(spark):
    t = "Prišel je dr. Kos ob 5. uri. »Kje si?« je vprašal … in molčal. „Tu sem.“ Odšla sta. Leta 1875. Nato 3. maja – konec"
    assert one(spark, pairs.sentences(F.col("c0")), t) == ["Prišel je dr. Kos ob 5. uri.", "»Kje si?« je vprašal … in molčal.", "„Tu sem.“", "Odšla sta.", "Leta 1875. Nato 3. maja – konec"]
    assert one(spark, pairs.paragraphs(F.col("c0")), "II. Ena\nvrsta.\n \nIV Dva.\n\n  \n\nTri") == ["Ena vrsta.", "Dva.", "Tri"]


S = "Mlinar je počasi šel po dolgi beli cesti proti domu."


def test_windows_account_for_every_candidate(spark):
    para = " ".join([S] * 8)
    rows = [(1, f"POGLAVJE\n\n{para}\n\nKratko. Res."), (2, para), (3, "Ena sama poved, ki stoji tu brez druge."), (4, None), (5, " ".join([S[:-1] + " " + "dolgo " * 40 + "."] * 3))]
    w = pairs.windows(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    by = {(r.id, r.para, r.win): r.reason for r in w}
    assert by == {(1, 0, 0): "heading", (1, 1, 0): None, (1, 1, 1): "too_short", (1, 2, 0): "too_short", (2, 0, 0): "duplicate", (2, 0, 1): "too_short", (3, 0, 0): "too_few_sentences", (5, 0, 0): "too_long"}
    ok = next(r for r in w if r.reason is None)
    assert ok.n_sentences == 6 and len(ok.passage_id) == 16 and not ok.mid_paragraph


def test_anomalies(spark):
    src = "Čez cesto je šla črna mačka, žena pa je šepetaje čakala pri vratih češnjevega vrta."
    cases = {
        "": "empty_output", " ": "empty_output", "# Naslov": "not_a_rewrite", src: "identity", src[:-5].replace("a", "а") + "xx": "foreign_script", "Kratko.": "length_outlier", src + src: "length_outlier",
        src.replace("žena pa", "z prijateljem pa"): "misassimilated", src.translate(str.maketrans("čšžČŠŽ", "cszCSZ")): "lost_diacritics", src.replace("šla", "hodila"): None,
    }
    for out, want in cases.items():
        assert one(spark, pairs.anomaly(F.col("c0"), F.col("c1")), src, out) == want, (out, want)
    assert one(spark, pairs.similarity("c0", "c1"), "abcd", "bcde") == 0.75
    d = spark.createDataFrame([([("thinking", "x"), ("text", " a"), ("text", "b ")],)], "c array<struct<type:string,text:string>>")
    assert d.select(pairs.response_text(F.col("c"))).first()[0] == "a\nb"


def test_logs(spark):
    t = lambda k: datetime.datetime(2025, 1, k)
    rows = [("a", t(1), False, None), ("b", t(2), False, "x"), ("a", t(3), True, None), ("a", t(3), True, None), (None, t(4), True, None)]
    d = spark.createDataFrame(rows, "batch string, at timestamp, done boolean, s string").repartition(3)
    got = {r.batch: (r.done, r.s) for r in pairs.fold_log(d, "batch", ["at"], ["done", "s"]).collect()}
    assert got == {"a": (True, None), "b": (False, "x")}
    r = spark.createDataFrame([(1, "p", "bad"), (2, "p", None), (3, "p", None), (4, "q", "late"), (5, "q", "later"), (6, None, None)], "id long, p string, why string")
    assert {x.p: (x.chosen, x.reason) for x in pairs.resolve(r, "p", "id", "why").collect()} == {"p": (3, None), "q": (4, "late"), None: (6, None)}
    p = spark.createDataFrame([(c,) for c in "dbca"], "k string")
    assert [x.k for x in pairs.next_passages(p, p.where("k = 'b'"), "k", 2).collect()] == ["a", "c"]


def test_ledger(spark):
    have = spark.createDataFrame([("ada", "Ana Kos", "Ada", None, "Proza", ["x"])], "work_id string, author string, title string, year int, genre string, flags array<string>")
    new = spark.createDataFrame([("Ana Kos", "Ada (Kos)", 1899, "Pesem", ["y"]), ("Ana Kos", "Črna žena", 1901, None, None), ("Ana Kos", "črna ŽENA!", None, "Proza", None)], "author string, title string, year int, genre string, flags array<string>")
    got = {r.work_id: (r.title, r.year, r.genre, r.flags) for r in ledger.upsert(have, new).collect()}
    assert got == {"ada": ("Ada", 1899, "Proza", ["x", "y"]), "crna-zena": ("Črna žena", 1901, "Proza", [])}
    s = "author string, work_id string, source string, id string, status string, year int, note string"
    old = spark.createDataFrame([("A", "w", "dlib", "1", "ingested", None, ""), ("A", "w", "dlib", "2", "candidate", 1900, "n")], s)
    refs = spark.createDataFrame([("A", "w", "dlib", "1", "candidate", 1888, "", 1), ("A", "w", "dlib", "2", "skipped_x", None, "", 2), ("A", "w", "archive", "3", "candidate", None, "", 3)], s + ", seq long")
    got = {r.id: (r.status, r.year, r.note) for r in ledger.add_sources(old, refs).collect()}
    assert got == {"1": ("ingested", 1888, None), "2": ("skipped_x", 1900, "n"), "3": ("candidate", None, None)}
    ref = "array<struct<source:string,id:string,status:string>>"
    d = spark.createDataFrame([([("b", "1", "ingested"), ("a", "2", "ingested")], []), ([("a", "1", "candidate")], []), ([("a", "1", "skipped_z")], []), ([], []), ([("a", "1", "ingested")], ["not_by_author"])], f"r {ref}, f array<string>")
    assert [x[0] for x in d.select(ledger.status(F.col("r"), F.col("f"))).collect()] == ["ingested (a+b)", "candidate", "skipped_z", "missing", "excluded"]
    v = spark.createDataFrame([("ada", "Ana Kos", "Ada", 1700), ("x", "Ana Kos", "Zima", 1900), ("ada2", "Ana Kos", "ADA", 1900)], "work_id string, author string, title string, year int")
    assert {tuple(r) for r in ledger.violations(v, 1800, 1950).collect()} == {("Ana Kos", "ada", "title"), ("Ana Kos", "ada", "year"), ("Ana Kos", "x", "id"), ("Ana Kos", "ada2", "id"), ("Ana Kos", "ada2", "title")}


def test_authorship_and_matching(spark):
    q = F.lit("Kos, Ivan")
    rows = [(["Kos, Ivan (1876-1918)"], [], "x"), (["Kos, Izidor"], ["Kos, Ivan"], "x"), ([], ["Kos, Ivan"], "x"), ([], ["Kos, Ivan"], "Pesmi; Napisal A. Žagar"), ([], ["Kos, Ivan"], "Črtice; Spisal Ivan Kos"), ([], ["Kos, Ivan"], "Spominu Ivana Kosa"), (None, None, None)]
    d = spark.createDataFrame(rows, "c array<string>, p array<string>, t string")
    assert [r[0] for r in d.select(ledger.by_author(F.col("c"), F.col("p"), F.col("t"), q)).collect()] == [True, False, True, False, True, False, False]
    works = spark.createDataFrame([("na-klancu", "Ivan Kos", "Na klancu"), ("drama", "Ivan Kos", "Drama")], "work_id string, author string, title string")
    rec = spark.createDataFrame([(1, "Na klancu; Spisal Ivan Kos", "Ivan Kos"), (2, "Hlapci| drama", "Ivan Kos"), (3, "Nič", "Ivan Kos"), (4, None, "Ivan Kos")], "k int, t string, a string")
    assert {r.k: r.work_id for r in ledger.match_titles(rec, "k", "t", "a", works).collect()} == {1: "na-klancu", 2: "drama"}


def test_catalogue(spark):
    page = "== Proza ==\n* [[Ada]], 1899\n* [[Noč]] (prevod) 1901\n== Viri ==\n* [[Nekaj]]\n== Drama ==\n* [[Zima]] gl. [[Ada]]"
    d = ledger.catalog(spark.createDataFrame([(1, page), (2, None)], "k int, w string"), "k", "w", ("viri",))
    got = [(r.title, r.year, r.genre, r.alias_of, r.translated) for r in d.orderBy("line").collect()]
    assert got == [("Ada", 1899, "Proza", None, False), ("Noč", 1901, "Proza", None, True), ("Nekaj", None, None, None, False), ("Zima", None, "Drama", "Ada", False)]


def test_holdout_is_closed_both_ways(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(12)]
    rows = [(k, f"u{k}", t, len(t), "w") for k, t in enumerate(base)] + [(20, "u20", base[0][:600], 600, "o"), (21, "u21", base[5] + " konec", 2000, "w")]
    d = spark.createDataFrame(rows, "key long, url string, text string, size long, source string")
    r = {x.key: x.role for x in holdout.select(d, F.col("source") == "w", holdout.HoldoutParams(fraction=0.9)).collect()}
    assert r[5] == r[21] == "rejected" and r[20] == "contained" and sum(v == "held_out" for v in r.values()) >= 8
    again = {x.key: x.role for x in holdout.select(d.repartition(5), F.col("source") == "w", holdout.HoldoutParams(fraction=0.9)).collect()}
    assert r == again
    w = spark.createDataFrame([("u1", "x"), ("u99", "y")], "url string, content_sha256 string")
    assert {x.url: x.state for x in holdout.verify(w, d).collect()} == {"u1": "drifted", "u99": "missing"}
    assert holdout.without(d, "url", w).count() == len(rows) - 1


def test_aliases_keep_their_first_owner(spark):
    have = spark.createDataFrame([("A", "w1", "Na klancu", ["Klanec"]), ("A", "w2", "Hiša", [])], "author string, work_id string, title string, aliases array<string>")
    new = spark.createDataFrame([("A", "w2", "Klanec", 1), ("A", "w2", "Na klancu", 2), ("A", "w2", "Stara hiša", 3), ("B", "w9", "Nič", 4)], "author string, work_id string, alias string, seq int")
    aliases, index = ledger.add_aliases(have, new)
    assert {(r.work_id, r.alias) for r in aliases.collect()} == {("w1", "Klanec"), ("w2", "Klanec"), ("w2", "Na klancu"), ("w2", "Stara hiša")}
    assert {r.title_key: r.work_id for r in index.collect()} == {"na klancu": "w1", "klanec": "w1", "hiša": "w2", "stara hiša": "w2"}


def test_guards_fail_loud(spark):
    docs = spark.createDataFrame([("A", "u1"), ("A", None), ("B", "u2")], "author string, url string")
    holdout.require_no_misattributed(docs, spark.createDataFrame([("A", "u2"), ("B", "u1")], "author string, url string"))
    with pytest.raises(ValueError, match="u1"):
        holdout.require_no_misattributed(docs, spark.createDataFrame([("A", "u1")], "author string, url string"))
    roles = spark.createDataFrame([("held_out",)] * 3, "role string")
    assert holdout.require_enough(roles, holdout.HoldoutParams(least_works=3)) == 3
    with pytest.raises(ValueError):
        holdout.require_enough(roles)
    holdout.require_same_corpus("abc", "abc")
    with pytest.raises(ValueError):
        holdout.require_same_corpus("abc", "abd")


def test_uploads_and_addresses(spark, tmp_path):
    from zrno.functions.text import page_url
    from zrno.sources import writers

    for n in ("card.md", "pairs.jsonl", "m.json"):
        (tmp_path / n).write_text("x")
    files = writers.uploads(tmp_path / "card.md", tmp_path / "pairs.jsonl", tmp_path / "m.json", tmp_path / "raw.jsonl")
    assert [n for _, n in writers.require_uploads(files)] == ["README.md", "pairs.jsonl", "provenance/pairs.manifest.json"]
    (tmp_path / "m.json").unlink()
    with pytest.raises(FileNotFoundError):
        writers.require_uploads(files)
    assert spark.range(1).select(page_url("https://x/wiki/", F.lit("Na klancu"))).first()[0] == "https://x/wiki/Na_klancu"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from zrno.session import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077")))
