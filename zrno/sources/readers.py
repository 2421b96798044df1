"""Sources: JSON lines, shards, XML dumps, loose metadata, configuration files, streams of bytes."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC = "title string, url string, text string, n_chars long, source string, author string"
CHUNK = DOC + ", n_tokens long, chunk_index int, n_chunks int, char_start int, char_end int"
RECEIPT = "batch_id string, created_at string, model string, n_requests long, downloaded boolean, pair_set string"
RESPONSE = "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>,stop_reason:string,usage:struct<input_tokens:long,output_tokens:long>>>"
WORK = "work_id string, title string, author string, year int, genre string, flags array<string>, aliases array<string>, sources array<struct<source:string,id:string,status:string,year:int,note:string>>, notes string"


class MissingInput(FileNotFoundError):
    """An input that has to be made first; the message says how."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def json_lines(spark: SparkSession, path: str, schema: str, hint: str = "") -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. A missing file fails at once, not when the plan runs."""
    if not exists(spark, path):
        raise MissingInput(f"{path} is missing" + (f"; run: {hint}" if hint else ""))
    return spark.read.schema(schema).json(path)


def json_lines_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines(), but a log that doesn't exist yet is empty."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def shards(spark: SparkSession, folder: str, general: str, schema: str = DOC) -> DataFrame:
    """All shards of a folder with shard (the file's name), tier and line, a number that grows with the place in the file; the order of preference is (tier, shard, line)."""
    from zrno.plans.merge import shard_tier

    d = json_lines(spark, f"{folder}/*.jsonl", schema).select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_s"))
    d = d.withColumn("shard", F.regexp_replace("_f", r"\.jsonl$", ""))
    return d.withColumns({"tier": shard_tier(F.col("shard"), general), "line": F.struct("_s", F.monotonically_increasing_id())}).drop("_f", "_s")


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, text) of the pages of a MediaWiki XML dump, bz2 or plain; files split by page."""
    text = "struct<_VALUE:string,_bytes:long>"
    schema = f"title string, ns int, redirect struct<_title:string>, revision struct<text:{text}>"
    d = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return d.select("title", "ns", F.col("redirect").isNotNull().alias("redirect"), F.col("revision.text._VALUE").alias("text"))


def loose(json_column: Column, path: str) -> Column:
    """A loose JSON value as an array of strings: a scalar, a list, or objects that carry their value under '#text'."""
    v = F.get_json_object(json_column, path)
    one = F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.array(v))
    got = F.transform(one, lambda x: F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.#text")).otherwise(x))
    return F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.filter(got, lambda x: x.isNotNull()))


def edm_records(raw: DataFrame, key: str, column: str) -> DataFrame:
    """(key, title, year, types, langs, people, creators, rights, text_url, is_part_of) of loose JSON metadata."""
    j = F.col(column)
    cho = "$['edm:RDF']['edm:ProvidedCHO']"
    get = lambda name: loose(j, f"{cho}['{name}']")
    fold = lambda a: F.array_distinct(F.transform(a, F.lower))
    first = lambda a: F.try_element_at(a, F.lit(1))
    year = F.regexp_extract(F.coalesce(first(get("dcterms:issued")), F.lit("")), r"\d{4}", 0)
    stream = F.regexp_extract(F.get_json_object(j, "$['edm:RDF']['edm:WebResource']"), r'"@rdf:about"\s*:\s*"([^"]*/TEXT)"', 1)
    rights = F.regexp_extract(F.get_json_object(j, "$['edm:RDF']['ore:Aggregation']"), r'"@rdf:resource"\s*:\s*"([^"]*)"', 1)
    return raw.select(
        key, F.btrim(F.rtrim(F.coalesce(first(get("dc:title")), F.lit("")), F.lit("|"))).alias("title"), F.when(year != "", year.cast("int")).alias("year"), fold(get("dc:type")).alias("types"), fold(get("dc:language")).alias("langs"),
        F.array_distinct(F.concat(get("dc:contributor"), get("dc:creator"))).alias("people"), F.array_distinct(get("dc:creator")).alias("creators"),
        rights.alias("rights"), F.when(stream != "", stream).alias("text_url"), first(get("dcterms:isPartOf")).alias("is_part_of"),
    )


def byte_streams(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files of bytes, UTF-8 or windows-1250."""
    from zrno.operators.cleaning import decode_bytes

    return spark.read.format("binaryFile").load(path).select("path", decode_bytes(F.col("content")).alias("text"))


def config(path: str | Path, entries: str | None = None) -> list[dict] | dict:
    """A TOML file, or one of its arrays of tables."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    return data if entries is None else data.get(entries, [])


def works(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, WORK, "seed the ledger")


def genres(ledger: DataFrame) -> DataFrame:
    """(author, title_key, genre): by title, else by alias; a work's own title wins over another's alias."""
    from zrno.functions.text import nfc, normal_title

    none = F.array().cast("array<string>")
    names = ledger.select("author", "genre", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", none))).alias("pos", "name"))
    k = names.select("author", "genre", (F.col("pos") > 0).alias("alias"), "name", normal_title(nfc(F.col("name"))).alias("title_key"))
    return k.where("title_key <> ''").groupBy("author", "title_key").agg(F.min_by("genre", F.struct("alias", "name")).alias("genre"))


def frozen(path: str | Path, hint: str = "") -> dict:
    """A manifest; fails loud where it is missing."""
    p = Path(path)
    if not p.exists():
        raise MissingInput(f"{p} is missing" + (f"; run: {hint}" if hint else ""))
    return json.loads(p.read_text(encoding="utf-8"))
