import pytest
from pyspark.sql import functions as F

from zrno.functions import text as tx
from zrno.operators import cleaning, gate, stats


def one(spark, expr, **cols):
    d = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return d.select(expr.alias("x")).first()[0]


def test_words_and_tokens_are_unicode(spark):
    assert one(spark, tx.words("t"), t="a b\xa0č　 d\n") == ["a", "b", "č", "d"]
    assert one(spark, tx.tokens("t"), t="Straße, ČRNA_hiša 3½ ſo") == ["strasse", "črna_hiša", "3½", "so"]
    assert one(spark, tx.lines("t"), t=" a \r\n\n b c\x0b ") == ["a", "b", "c"]


def test_titles(spark):
    assert one(spark, tx.normal_title(tx.nfc(F.col("t"))), t="  Črni – Prag: (odlomek)! ") == "črni prag odlomek"
    assert one(spark, tx.normal_title(tx.without_author(F.col("t"), F.col("a"))), t="Ada (Ivan Kos)", a="Ivan Kos") == "ada"
    assert one(spark, tx.normal_title(tx.without_author(F.col("t"), F.col("a"))), t="Ada (1914)", a="Ivan Kos") == "ada 1914"
    assert one(spark, tx.normal_title(tx.without_author(F.col("t"), F.col("a"))), t="Ada (Kos)", a=" ") == "ada kos"
    assert one(spark, tx.slug(F.col("t")), t="Črna žena!") == "crna-zena"


PROSE = "Mlinar je šel po cesti in se je ustavil pri hiši, ker ni vedel, ali je doma kdo. " * 8
VERSE = "\n".join(["Lepo jutro nad goro,", "ptica poje sred polja", "in pastir je vesel, glej!", "veter tiho gre."] * 5)
CASES = {
    "kept": PROSE, "empty": " \n ", "not_slovene": "Die alten Glocken schweigen heute über dem stillen Dorfe und niemand kommt. " * 8,
    "bibliography": "Delo je, 1871, 1872, 1873, in 1874, se 1875, je 1876 in 1877. " * 5, "index_list": "\n".join(f"Naslov je in dela {i}" for i in range(20)),
}


@pytest.mark.parametrize("verdict", CASES)
def test_gate(spark, verdict):
    d = spark.createDataFrame([(CASES[verdict],)], "text string")
    assert gate.signals(d).first()["verdict"] == verdict


def test_gate_keeps_verse_and_takes_null_as_empty(spark):
    d = spark.createDataFrame([(1, VERSE), (2, None)], "id int, text string")
    got = {r.id: r for r in gate.signals(d).select("*", gate.is_verse(F.coalesce("text", F.lit(""))).alias("verse")).collect()}
    assert got[1].verdict == "kept" and got[1].verse and got[2].verdict == "empty"


def test_titles_by_others(spark):
    roster = F.array(F.lit("Ana Kos"), F.lit("Bor Žagar"))
    d = spark.createDataFrame([("Spomin (Bor Žagar)", "Ana Kos"), ("Spomin (Ana Kos)", "Ana Kos"), ("Spomin", "Ana Kos")], "t string, a string")
    assert [r[0] for r in d.select(gate.by_other_author(F.col("t"), F.col("a"), roster)).collect()] == ["Bor Žagar", None, None]


def test_metrics(spark):
    w = " ".join(f"b{i % 300}" for i in range(900))
    rows = [("a", w), ("a", "ena dve ena"), ("a", "ena dve ena"), ("b", "vrsta\nvrsta\ndruga {| [[x]]"), ("b", None), ("b", "☃☃ab")]
    m = stats.document_metrics(spark.createDataFrame(rows, "s string, text string"), keep=("s",))
    by = {(r.s, r.n_words): r for r in m.collect()}
    total = [len(set(w.split()[i : i + 500])) / 500 for i in range(0, 401, 100)]
    assert abs(by["a", 900].mattr - sum(total) / len(total)) < 1e-12 and by["a", 3].mattr == pytest.approx(2 / 3)
    assert by["b", 5].dup_lines == pytest.approx(1 / 3) and by["b", 5].wikitable and by["b", 1].unknown == 2
    q = {r.s: r for r in stats.shard_metrics(m, "s").collect()}
    assert q["a"].words_p95 == 3 and q["a"].words_median == 3 and q["a"].exact_dup_rate == pytest.approx(1 / 3) and q["b"].n_docs == 2


def test_scan_cleaning(spark):
    text = "Štev. 3\nSpisal Ivan Kos.\n- 12 -\nJ*\nIV.\nStara hi-\nša stoji ob vodi.\n\\\n^^~~||°°§§\n\n\n\nKonec  zgodbe\\  je tu."
    r = cleaning.clean_scan(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert r[0].clean == "IV.\nStara hiša stoji ob vodi.\n\nKonec zgodbe je tu." and r[0].dropped_lines == 5 and not r[0].passed
    assert r[1].clean is None and r[1].passed is False


def test_bytes(spark):
    d = spark.createDataFrame([(bytearray("čšž".encode()),), (bytearray("čaša".encode("cp1250")),), (None,)], "b binary")
    assert [r[0] for r in d.select(cleaning.decode_bytes(F.col("b"))).collect()] == ["čšž", "čaša", None]


def test_wiki_markup():
    t = "{{Infobox|a={{b}}}}'''Ada''' je [[Slika:x.jpg|thumb|[[mesto]] ob morju]] [[mesto|velikem mestu]] in [[reka]].<ref>vir</ref>\n{| class=x\n| celica {| y |}\n|}\n== Življenje ==\nRojena __TOC__ doma.\n[[Kategorija:Ljudje]]\n^opomba\n== Viri ==\n* knjiga"
    assert cleaning.clean_wiki(cleaning.pre_clean_dump(t)) == "Ada je  velikem mestu in reka.\n\nŽivljenje\nRojena  doma."
    assert cleaning.nested("a [[b", "[[", "]]", lambda s: "") == "a [[b" and cleaning.nested("[[a [[b]] c]]", "[[", "]]", lambda s: f"<{s}>") == "<a <b> c>"


def test_ingest_chain(spark):
    rows = [(1, "T", "x" * 500), (0, "T", "#PREUSMERITEV [[x]]"), (0, "Seznam del", "x" * 500), (0, "T", "{{Razločitev}}" + "x" * 500), (0, "T", ""), (0, "T", "kratko"), (0, "T", "x" * 500)]
    d = spark.createDataFrame(rows, "ns int, t string, x string").withColumn("c", cleaning.wiki_text(F.col("x")))
    got = [r[0] for r in d.select(cleaning.ingest_reason(F.col("ns"), F.col("t"), F.col("x"), F.col("c"))).collect()]
    assert got == ["non_ns0", "redirect", "list", "disambig", "empty", "stub", None]


def test_crawl_guards(spark):
    ok = PROSE
    rows = [("Seznam del", ok, False, None), ("T", ok, True, None), ("T", "#redirect [[x]]", False, None), ("T", ok, False, "Bor"), ("T", "kratko", False, None), ("T", "\n".join(f"Dolg naslov dela {i} v zbirki del" for i in range(20)), False, None), ("T", ok, None, None)]
    d = spark.createDataFrame(rows, "t string, x string, e boolean, o string")
    got = [r[0] for r in d.select(cleaning.crawl_reason(F.col("t"), F.col("x"), F.col("x"), F.col("e"), F.col("o"))).collect()]
    assert got == ["excluded", "excluded", "redirect", "misattributed", "short", "index", None]
