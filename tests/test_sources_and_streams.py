import bz2
import datetime
import json

import pytest
from pyspark.sql import functions as F

from zrno.operators.pairs import fold_log
from zrno.sources import readers, writers
from zrno.streaming import incremental


def test_json_lines(spark, tmp_path):
    p = tmp_path / "ana.jsonl"
    p.write_text('{"title": "A", "text": "č", "n_chars": 1, "other": 2}\n\n{"title": "B"}\n', encoding="utf-8")
    d = readers.json_lines(spark, str(p), readers.DOC)
    assert [(r.title, r.text) for r in d.collect()] == [("A", "č"), ("B", None)]
    with pytest.raises(readers.MissingInput, match="make it"):
        readers.json_lines(spark, str(tmp_path / "none.jsonl"), readers.DOC, "make it")
    assert readers.json_lines_or_empty(spark, str(tmp_path / "none.jsonl"), readers.RECEIPT).count() == 0
    (tmp_path / "dlib-ana.jsonl").write_text('{"title": "C"}\n')
    (tmp_path / "wiki.jsonl").write_text('{"title": "D"}\n')
    got = readers.shards(spark, str(tmp_path), "wiki").orderBy("tier", "shard", "line").collect()
    assert [(r.title, r.tier, r.shard) for r in got] == [("A", 0, "ana"), ("B", 0, "ana"), ("C", 1, "dlib-ana"), ("D", 3, "wiki")]


def test_dump(spark, tmp_path):
    pages = "".join(f"<page><title>T{i}</title><ns>{i % 2}</ns>{'<redirect title=\"x\"/>' if i == 3 else ''}<revision><text bytes=\"3\" xml:space=\"preserve\">besedilo č {i}</text></revision></page>" for i in range(5))
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(f'<mediawiki xmlns="http://example.org/export">{pages}</mediawiki>'.encode()))
    got = readers.dump_pages(spark, str(tmp_path / "d.xml.bz2")).orderBy("title").collect()
    assert [(r.title, r.ns, r.redirect) for r in got] == [(f"T{i}", i % 2, i == 3) for i in range(5)] and got[2].text == "besedilo č 2"


def test_loose_metadata(spark):
    cho = {"dc:title": ["Ada|", "x"], "dcterms:issued": "ok. 1899", "dc:type": {"#text": "Knjiga"}, "dc:language": ["slv", {"#text": "GER", "@xml:lang": "x"}], "dc:contributor": "Kos, Ivan", "dc:creator": [{"#text": "Žagar, Bor"}]}
    rec = {"edm:RDF": {"edm:ProvidedCHO": cho, "ore:Aggregation": {"edm:rights": {"@rdf:resource": "http://x/pd/"}}, "edm:WebResource": [{"@rdf:about": "http://x/PDF"}, {"@rdf:about": "http://x/TEXT"}]}}
    r = readers.edm_records(spark.createDataFrame([(1, json.dumps(rec)), (2, "{}"), (3, None)], "k int, j string"), "k", "j").orderBy("k").collect()
    assert (r[0].title, r[0].year, r[0].types, r[0].langs) == ("Ada", 1899, ["knjiga"], ["slv", "ger"])
    assert (r[0].people, r[0].creators, r[0].rights, r[0].text_url) == (["Kos, Ivan", "Žagar, Bor"], ["Žagar, Bor"], "http://x/pd/", "http://x/TEXT")
    assert (r[1].title, r[1].year, r[1].types, r[2].text_url) == ("", None, [], None)


def test_configs_and_genres(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[[collision]]\ntitle = "Zima"\nresolution = "distinct"\n')
    assert readers.config(tmp_path / "c.toml", "collision")[0]["title"] == "Zima"
    with pytest.raises(readers.MissingInput):
        readers.frozen(tmp_path / "m.json")
    w = spark.createDataFrame([("Ana", "Zima", "Proza", ["Poletje"]), ("Ana", "Poletje", "Drama", None)], "author string, title string, genre string, aliases array<string>")
    assert {r.title_key: r.genre for r in readers.genres(w).collect()} == {"zima": "Proza", "poletje": "Drama"}


def test_shard_and_manifest(spark, tmp_path):
    d = spark.createDataFrame([("A", "ena dve"), ("B", None), ("C", "tri")], "title string, text string")
    m = writers.write_shard(d, str(tmp_path / "s"), tmp_path / "s.manifest.json", "w", "test", {"a": 1}, (1, 10), {"stub": 3})
    assert (m["n_docs"], m["n_words"], m["n_chars"], m["in_band"]) == (3, 3, 10, True) and readers.frozen(tmp_path / "s.manifest.json")["skip_counts"] == {"stub": 3}
    assert writers.fingerprint(d) == writers.fingerprint(d.repartition(3)) != writers.fingerprint(d.limit(2))
    bad = d.withColumn("text", F.raise_error(F.lit("x")).cast("string"))
    with pytest.raises(Exception, match="x"):
        writers.write_shard(bad, str(tmp_path / "b"), tmp_path / "b.json", "w", "test")
    assert not (tmp_path / "b.json").exists()
    writers.append_log(d.limit(1), str(tmp_path / "log"))
    writers.append_log(d.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_reports():
    assert writers.freshness("x", "a") == "unstamped" and writers.freshness("git_sha: abc", "abc") == "fresh" and writers.freshness("git_sha: abc-dirty", "abc") == "stale"
    m = [{"source": "w", "n_docs": 3, "n_words": 1234}]
    assert "| w | 3 | 1,234 |" in writers.dataset_card("x", "CC0-1.0", m)
    with pytest.raises(ValueError, match="licence"):
        writers.dataset_card("x", "proprietary", m)


def test_markdown(spark):
    d = spark.createDataFrame([("a|b", 1234, 0.5), (None, 1, 2.0)], "s string, n long, x double")
    t = writers.markdown("T", d, "test", ["n"])
    assert "| a\\|b | 1,234 | 0.5000 |" in t and t.startswith("<!-- GENERATED")
    with pytest.raises(ValueError):
        writers.markdown("T", d, "test", most=1)


def test_streamed_fold_equals_batch(spark, tmp_path):
    t = lambda k: datetime.datetime(2025, 1, 1, 0, k)
    rows = [(f"b{i % 7}", t(i % 50), i) for i in range(120)]
    d = spark.createDataFrame(rows, "b string, at timestamp, n long")
    for k in range(3):  # three micro-batches, late rows among them
        d.where(F.col("n") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        s = incremental.events(spark, str(tmp_path / "log"), "b string, at timestamp, n long", 1)
        incremental.fold(s, "b", ["at", "n"], [], str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.b, r.at, r.n) for r in incremental.newest(spark, str(tmp_path / "state")).collect()}
    assert got == {(r.b, r.at, r.n) for r in fold_log(d, "b", ["at", "n"], ["at", "n"]).collect()}


def test_streamed_first_copies(spark, tmp_path):
    t = lambda k: datetime.datetime(2025, 1, 1, 0, k)
    d = spark.createDataFrame([("x", t(0)), ("y", t(1)), ("x", t(2)), ("y", t(3)), ("z", t(4))], "c string, at timestamp")
    d.write.parquet(str(tmp_path / "log"))
    incremental.drain(incremental.first_copies(incremental.events(spark, str(tmp_path / "log"), "c string, at timestamp"), "c", "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.c for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]
