"""Cleaning of scanned lines and of wiki markup."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zrno.functions.text import nfc, strip

# Patterns and limits of line cleaning.
DIVIDED = r"([\p{L}\p{N}_])[-¬]\n([\p{L}\p{N}_])"
PAGE_LINE = r"^\s*-?\s*\d{1,4}\s*-?\s*$"
BYLINE = r"^\s*(Spisal|Napisal|Spisala|Napisala)\b.{0,60}$"
HEADER = r"^\s*(Štev\.|V Ljubljani,? dne|Leposloven)|(\bLeto [IVX]+\.?\s*$)"
ROMAN = r"^[IVXLC]{1,6}\.?$"
BACKSLASHES = r"^\\+\s*$"
NOISE = r"[^<>^=~|%&$#]"
HEADER_ZONE, ORPHAN_ZONE, LINE_FLOOR = 10, 30, 0.85
EARLY, EARLY_MOST, ALPHA_LEAST, CHARS_LEAST = 1000, 10, 0.84, 400


def line_quality(line: Column) -> Column:
    """Share of letters, blanks and ordinary marks; 1 for a blank line."""
    s = strip(line)
    return F.when(F.length(s) == 0, F.lit(1.0)).otherwise(1 - F.length(F.regexp_replace(s, r"[\p{L}\s.,;:!?\-\"'()„“”«»*…]", "")) / F.length(s))


def scanned_lines(text: Column, floor: float = LINE_FLOOR) -> Column:
    """Array of structs (line, dropped) of a scanned text's lines, in order. The text should be NFC already."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("�"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, DIVIDED, "$1$2"), r"\\\s+", " ")
    tidy = F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(strip(s), r"[ \t]+", " "))

    def judge(s: Column, i: Column) -> Column:
        is_ = lambda p: F.rlike(s, F.lit(p))
        bad = is_(PAGE_LINE) | is_(BYLINE) | is_(BACKSLASHES) | ((i < HEADER_ZONE) & is_(HEADER)) | ((i < ORPHAN_ZONE) & (F.length(s) <= 2) & ~is_(ROMAN)) | (line_quality(s) < floor)
        return F.struct(s.alias("line"), ((F.length(s) > 0) & bad).alias("dropped"))

    return F.transform(tidy, judge)


def clean_scan(df, text: str, out: str = "clean"):
    """Adds out, dropped_lines, kept_lines, n_chars, alpha (letters and blanks), early_noise and passed, the gate over them. A null text stays null and does not pass."""
    d = df.withColumn("_l", scanned_lines(nfc(F.col(text))))
    kept = F.filter("_l", lambda x: ~x.dropped)
    d = d.withColumn(out, strip(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x.line), "\n"), r"\n{3,}", "\n\n")))
    early = F.substring(F.col(out), 1, EARLY)
    d = d.withColumns({
        "dropped_lines": F.size(F.filter("_l", lambda x: x.dropped)), "kept_lines": F.size(F.filter("_l", lambda x: ~x.dropped & (F.length(x.line) > 0))),
        "n_chars": F.length(out), "alpha": F.length(F.regexp_replace(F.col(out), r"[^\p{L}\s]", "")), "early_noise": F.length(F.regexp_replace(early, NOISE, "")),
    }).drop("_l")
    ok = (F.col("early_noise") <= EARLY_MOST) & (F.col("alpha") / F.greatest(F.col("n_chars"), F.lit(1)) >= ALPHA_LEAST) & (F.col("n_chars") >= CHARS_LEAST)
    return d.withColumn("passed", F.coalesce(ok, F.lit(False)))


def decode_bytes(raw: Column) -> Column:
    """UTF-8, else windows-1250 with replacement of what it leaves open; by Arrow batches, as the JVM's decode refuses that charset."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else _decode(b))

    return run(raw)


def _decode(b: bytes) -> str:
    try:
        return bytes(b).decode("utf-8")
    except UnicodeDecodeError:
        return bytes(b).decode("cp1250", "replace")


# Names and headings of wiki markup.
MEDIA = ("slika", "datoteka", "file", "image", "berilo")
BACK_MATTER = ("viri", "sklici", "opombe", "reference", "zunanje povezave", "glej tudi", "literatura", "nadaljnje branje", "sorodne strani", "opombe in sklici")
TAG_BLOCK = r"<(score|hiero|chem|mapframe|maplink|syntaxhighlight|source|imagemap|gallery|timeline|math|templatestyles)\b[^>]*>.*?</\1>"
_BACK = re.compile(r"^=+\s*(?:" + "|".join(BACK_MATTER) + r")\s*=+\s*$", re.I | re.M)
_BLOCK = re.compile(TAG_BLOCK, re.S | re.I)
_CLOSED = re.compile(r"<(?:templatestyles|mapframe|maplink)\b[^>]*/>", re.I)
_OTHER_WIKI = re.compile(r"\[\[[a-z]{2,3}(?:-[a-z]+)?:[^\]]+\]\]")
_REF = re.compile(r"<ref[^>/]*(?:/>|>.*?</ref>)", re.S | re.I)
_BRACKET = re.compile(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}")


def nested(text: str, opening: str, closing: str, turn: Callable[[str], str]) -> str:
    """Replaces bracketed spans, innermost first, by what `turn` makes of their inside; unclosed brackets stay."""
    stack: list[list[str]] = [[]]
    at = 0
    for m in _BRACKET.finditer(text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if m[0] == opening:
            stack.append([])
        elif m[0] == closing and len(stack) > 1:
            inside = "".join(stack.pop())
            stack[-1].append(turn(inside))
        else:
            stack[-1].append(m[0])
    stack[-1].append(text[at:])
    while len(stack) > 1:
        inside = "".join(stack.pop())
        stack[-1].append(opening + inside)
    return "".join(stack[0])


def _link(inside: str) -> str:
    if inside.split(":", 1)[0].strip().casefold() in MEDIA and ":" in inside:
        return ""
    target, bar, label = inside.partition("|")
    return label.rsplit("|", 1)[-1] if bar else target.lstrip(":")


def pre_clean_dump(wikitext: str) -> str:
    """Without back matter, render-only tags, tables, media links and links to other wikis."""
    m = _BACK.search(wikitext)
    t = _CLOSED.sub("", _BLOCK.sub("", wikitext[: m.start()] if m else wikitext))
    t = nested(t, "{|", "|}", lambda _: "")
    t = nested(t, "[[", "]]", lambda s: "" if ":" in s and s.split(":", 1)[0].strip().casefold() in MEDIA else f"[[{s}]]")
    return _OTHER_WIKI.sub("", t)


def clean_wiki(wikitext: str) -> str:
    """Wiki markup as plain text: notes, templates and tags dropped, links by their labels, headings as lines, NFC, tidy blanks."""
    import unicodedata

    t = re.sub(r"<!--.*?-->", "", _REF.sub("", wikitext), flags=re.S)
    t = nested(t, "{{", "}}", lambda _: "")
    t = nested(t, "{|", "|}", lambda _: "")
    t = nested(t, "[[", "]]", _link)
    t = re.sub(r"\[(?:https?:|//)\S+\s*([^\]]*)\]", r"\1", t)
    t = re.sub(r"</?[A-Za-z][^<>]*>", "", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"^=+\s*(.*?)\s*=+\s*$", r"\1", t, flags=re.M)
    t = re.sub(r"__[A-Z]+__", "", t)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = t.replace(name, char)
    t = unicodedata.normalize("NFC", t)
    t = re.sub(r"^(?:Kategorija|Category):\S.*$", "", t, flags=re.M)
    t = re.sub(r"^\^.*$", "", t, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip()


@F.pandas_udf(T.StringType())
def wiki_text(x: pd.Series) -> pd.Series:
    """clean_wiki() by Arrow batches; nesting is beyond regular expressions."""
    return x.map(lambda s: None if s is None else clean_wiki(s))


@F.pandas_udf(T.StringType())
def dump_text(x: pd.Series) -> pd.Series:
    """clean_wiki() after pre_clean_dump()."""
    return x.map(lambda s: None if s is None else clean_wiki(pre_clean_dump(s)))


def ingest_reason(ns: Column, title: Column, text: Column, clean: Column, least: int = CHARS_LEAST) -> Column:
    """Why a dump page does not become a document, the first reason that holds; null for a document."""
    from zrno.operators import gate

    redirect, disambiguation = F.rlike(F.coalesce(text, F.lit("")), F.lit(gate.REDIRECT)), F.rlike(F.coalesce(text, F.lit("")), F.lit(gate.DISAMBIGUATION))
    return (
        F.when(ns != 0, "non_ns0").when(redirect, "redirect").when(F.rlike(title, F.lit(gate.INDEX_TITLE)), "list").when(disambiguation, "disambig")
        .when(F.coalesce(F.length(clean), F.lit(0)) == 0, "empty").when(F.length(clean) < least, "stub")
    )


def crawl_reason(title: Column, text: Column, clean: Column, excluded: Column, other: Column, least: int = CHARS_LEAST) -> Column:
    """Why a crawled page does not become a document: excluded by the catalogue, a redirect, by another author, short, or an index by its lines; null for a document."""
    from zrno.operators import gate

    redirect = F.rlike(F.coalesce(text, F.lit("")), F.lit(gate.REDIRECT))
    return (
        F.when(F.coalesce(excluded, F.lit(False)) | F.rlike(F.coalesce(title, F.lit("")), F.lit(gate.INDEX_TITLE)), "excluded").when(redirect, "redirect").when(other.isNotNull(), "misattributed")
        .when(F.coalesce(F.length(clean), F.lit(0)) < least, "short").when(gate.index_like(F.coalesce(clean, F.lit(""))), "index")
    )
