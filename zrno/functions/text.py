"""Column functions over text. Everything here stays in the JVM unless its docstring says otherwise.

Patterns are written so that Java's and RE2's engines read them alike: blanks and word characters are spelled out, since `\\s` and
`\\w` are ASCII in both.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def casefold(x: Column | str) -> Column:
    """Lower case, with the letters that only case folding maps."""
    return F.translate(F.replace(F.lower(c(x)), F.lit("ß"), F.lit("ss")), "ſς", "sσ")


def words(x: Column | str) -> Column:
    """Tokens between blanks of any kind."""
    return F.filter(F.split(c(x), WS + "+"), lambda w: w != "")


def tokens(x: Column | str) -> Column:
    """Runs of word characters of the case-folded text."""
    return F.regexp_extract_all(casefold(x), F.lit(WORD + "+"), F.lit(0))


def strip(x: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(x, "^" + WS + "+", ""), WS + "+$", "")


def lines(x: Column | str) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c(x), LINE_BREAK), strip), lambda s: s != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where there is nothing to share."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def normal_title(x: Column) -> Column:
    """Matching key of a title: case-folded, punctuation as blanks, blanks collapsed, letter marks kept. NFC is up to nfc()."""
    s = F.regexp_replace(casefold(x), r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(s, WS + "+", " "))


def without_author(title: Column, author: Column) -> Column:
    """The title without a bracketed ending that names the author's surname."""
    inner = F.regexp_extract(title, r"\(([^)]*)\)\s*$", 1)
    surname = casefold(F.try_element_at(words(author), F.lit(-1)))
    named = (inner != "") & F.contains(casefold(inner), surname)
    return F.when(F.coalesce(named, F.lit(False)), F.regexp_replace(title, r"\s*\([^)]*\)\s*$", "")).otherwise(title)


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    """NFC, which the JVM has no function for; Arrow batches."""
    return x.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def without_marks(x: pd.Series) -> pd.Series:
    """NFKD without combining marks; Arrow batches."""
    return x.map(lambda s: None if s is None else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)))


def page_url(base: str, title: Column) -> Column:
    """A page's address from its title, blanks as underscores."""
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(without_marks(normal_title(title)), WS + "+", "-"), "^-+|-+$", "")


