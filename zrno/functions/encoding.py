"""Tokens of a public byte-level tokenizer. Counting does not encode the same word twice; encoding uses the native library by Arrow batches."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary is unless a caller says otherwise; the driver reads it, and its ranks (50,256) are broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The vocabulary's published split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EXACT = regex.compile(PATTERN)
#: The same pattern for texts whose numerals are digits and whose blanks are beyond dispute; twice as fast.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(1)
def _slow() -> re.Pattern:
    odd = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Nl", "No") or c in "\x1c\x1d\x1e\x1f\x85᠎"]
    return re.compile("[" + "".join(map(re.escape, odd)) + "\U00010000-\U0010ffff]")


def split(text: str) -> list[str]:
    return (_EXACT if _slow().search(text) else _FAST).findall(text)


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Sizes(dict):
    """piece -> its number of tokens; a piece's tokens don't depend on its neighbours."""

    def __init__(self, r: dict[bytes, int]) -> None:
        super().__init__()
        self.encoding = tiktoken.Encoding("zrno", pat_str=PATTERN, mergeable_ranks=r, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[piece] = len(self.encoding._encode_single_piece(piece.encode("utf-8", "replace")))
        return n


def shared_ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(ranks(path))


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = (), digits: bool = False) -> DataFrame:
    """(key, *keep, n_tokens): the size of every text; 0 for a null or empty one. digits: and n_digit_tokens, tokens of digits only."""
    bc = shared_ranks(df.sparkSession, vocabulary)
    d = df.select(F.col(key), *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in d.dtypes if c != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(bc.value)
        get, only = sizes.__getitem__, digit_ids(bc.value) if digits else frozenset()
        for b in batches:
            parts = [split(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            more = [pa.array([sum(map(get, p)) for p in parts], pa.int64())]
            if digits:
                more.append(pa.array([sum(sum(t in only for t in sizes.encoding.encode_ordinary(w)) for w in p if any("0" <= c <= "9" for c in w)) for p in parts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "n_tokens", "n_digit_tokens"][: b.num_columns + digits])

    return d.mapInArrow(run, fields + ", n_tokens long" + ", n_digit_tokens long" * digits)


def digit_ids(r: dict[bytes, int]) -> frozenset[int]:
    """Ids of tokens that are digits only."""
    return frozenset(i for raw, i in r.items() if raw.isdigit())


def with_ids(df: DataFrame, text: str, vocabulary: str = VOCABULARY, first: int | None = None) -> DataFrame:
    """Adds tokens array<int>: the ids of the text, after `first` if given; empty for a null text."""
    bc = shared_ranks(df.sparkSession, vocabulary)
    d = df.withColumn("_text", F.col(text))
    fields = ", ".join(f"`{c}` {t}" for c, t in d.dtypes if c != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tiktoken.Encoding("zrno", pat_str=PATTERN, mergeable_ranks=bc.value, special_tokens={})
        lead = [] if first is None else [first]
        for b in batches:
            ids = [lead + enc.encode_ordinary(t) if t is not None else list(lead) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "tokens"])

    return d.mapInArrow(run, fields + ", tokens array<int>")
