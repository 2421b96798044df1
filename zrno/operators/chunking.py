"""Token budgets: chunks that never exceed one, packing simulation, token statistics."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.functions import encoding
from zrno.session import cut

LEVELS = ("paragraph", "line", "sentence", "hard")
# Each finds pieces that end with the separator they are split at; joined they give the text again.
_CUT = (re.compile(r".*?\n\n|.+", re.S), re.compile(r"[^\n]*\n|[^\n]+"), re.compile(r".*?[.!?…]\s+|.+", re.S))


def head(text: str, enc: tiktoken.Encoding, budget: int) -> str:
    """The longest start of a text that ends between characters and encodes to `budget` tokens or fewer."""
    ids = enc.encode_ordinary(text)
    for n in range(min(budget, len(ids)), 0, -1):
        raw = b"".join(map(enc.decode_single_token_bytes, ids[:n]))
        part = raw.decode("utf-8", "ignore")
        if part and len(part.encode("utf-8")) == len(raw) and text.startswith(part) and len(enc.encode_ordinary(part)) <= budget:
            return part
    raise ValueError("the budget is smaller than a character")


def ladder(text: str, size: Callable[[str], int], enc: tiktoken.Encoding, budget: int) -> tuple[list[tuple[str, int]], int]:
    """([(chunk, tokens)], deepest level used, -1 for a text that fits): pieces are cut level by level only where they exceed the budget, and neighbours are joined again while they fit. Every chunk's size is that of its own encoding."""
    n = size(text)
    if n <= budget:
        return [(text, n)], -1
    deepest, pieces, todo = 0, [], [(text, 0)]
    while todo:
        t, level = todo.pop()
        n = size(t)
        if n <= budget:
            pieces.append((t, n))
        elif level == 3:
            deepest = 3
            first = head(t, enc, budget)
            pieces.append((first, size(first)))
            if len(first) < len(t):
                todo.append((t[len(first) :], 3))
        else:
            parts = _CUT[level].findall(t)
            if len(parts) > 1:
                deepest = max(deepest, level)
            todo.extend((p, level + 1) for p in reversed(parts))
    out: list[tuple[str, int]] = []
    held, total = [], 0
    for t, n in [*pieces, ("", budget + 1)]:
        if held and total + n > budget:
            rest = "".join(held)
            while (k := size(rest)) > budget:  # a seam may add tokens
                first = head(rest, enc, budget)
                out.append((first, size(first)))
                rest = rest[len(first) :]
            out.append((rest, k))
            held, total = [], 0
        held.append(t)
        total += n
    return out, deepest


def chunks(docs: DataFrame, key: str, text: str, budget: int = 2048, keep: tuple[str, ...] = (), vocabulary: str = encoding.VOCABULARY) -> DataFrame:
    """(key, *keep, level, chunk_index, n_chunks, text, n_tokens, char_start, char_end) of every text that isn't null."""
    bc = encoding.shared_ranks(docs.sparkSession, vocabulary)
    d = docs.where(F.col(text).isNotNull()).select(key, *keep, F.col(text).alias("_text"))
    part = "array<struct<text:string,n_tokens:int,char_start:int,char_end:int>>"
    fields = ", ".join(f"`{c}` {t}" for c, t in d.dtypes if c != "_text")
    kind = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = encoding.Sizes(bc.value)
        enc, get = sizes.encoding, sizes.__getitem__
        size = lambda t: sum(map(get, encoding.split(t)))
        for b in batches:
            levels, rows = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                got, level = ladder(t, size, enc, budget)
                at, row = 0, []
                for s, n in got:
                    row.append((s, n, at, at + len(s)))
                    at += len(s)
                levels.append(level)
                rows.append([dict(zip(("text", "n_tokens", "char_start", "char_end"), r)) for r in row])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(levels, pa.int32()), pa.array(rows, kind)], names=[*b.schema.names[:-1], "level", "parts"])

    c = d.mapInArrow(run, f"{fields}, level int, parts {part}")
    return c.select(key, *keep, "level", F.size("parts").alias("n_chunks"), F.posexplode("parts").alias("chunk_index", "p")).select(key, *keep, "level", "chunk_index", "n_chunks", "p.*")


def chunk_faults(docs: DataFrame, made: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, fault): texts that their chunks don't give back, chunks over budget, spans that leave gaps."""
    again = made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x.text), "").alias("again"), F.max("n_tokens").alias("most"), F.sum(F.col("char_end") - F.col("char_start")).alias("covered"))
    j = docs.where(F.col(text).isNotNull()).join(again, key, "left")
    fault = F.when(~F.col("again").eqNullSafe(F.col(text)), "reconstruction").when(F.col("most") > budget, "budget").when(F.col("covered") != F.length(text), "span")
    return j.select(key, fault.alias("fault")).where("fault is not null")


def cropped(lengths: list[int], budget: int, buffer: int = 1000) -> tuple[int, int]:
    """(tokens cropped, tokens in all) of best-fit packing of a stream: into each row the largest waiting chunk that fits, else the shortest, cropped. A chunk takes one token more, its start."""
    capacity, waiting, at, lost, total = budget + 1, [], 0, 0, 0
    while at < len(lengths) or waiting:
        room = capacity
        while room > 0:
            while len(waiting) < buffer and at < len(lengths):
                insort(waiting, lengths[at] + 1)
                total += lengths[at] + 1
                at += 1
            if not waiting:
                break
            k = bisect_right(waiting, room)
            if k:
                room -= waiting.pop(k - 1)
            else:
                lost += waiting.pop(0) - room
                room = 0
    return lost, total


def crop_loss(made: DataFrame, order: list[str], stream: Column, budget: int = 2048) -> DataFrame:
    """(stream, n_tokens, n_cropped, loss) of each stream of chunks. Packing a stream is sequential, so a stream should be a share of bounded size; only lengths travel."""
    d = made.select(stream.alias("stream"), F.struct(*order).alias("o"), F.col("n_tokens").cast("int").alias("n"))

    def run(t: pa.Table) -> pa.Table:
        lost, total = cropped(t.sort_by([(f"o{i}", "ascending") for i in range(len(order))]).column("n").to_pylist(), budget)
        return pa.table({"stream": t.column("stream").slice(0, 1), "n_tokens": [total], "n_cropped": [lost], "loss": [lost / total if total else 0.0]})

    d = d.select("stream", "n", *[F.col(f"o.{c}").alias(f"o{i}") for i, c in enumerate(order)])
    return d.groupBy("stream").applyInArrow(run, f"stream {dict(d.dtypes)['stream']}, n_tokens long, n_cropped long, loss double")


def token_totals(sizes: DataFrame, *by: str) -> DataFrame:
    """Documents and tokens by the columns and in all (ROLLUP); a missing value is '-', a total null."""
    d = sizes.withColumns({c: F.coalesce(c, F.lit("-")) for c in by})
    return d.rollup(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def slice_of(source: Column, author: Column, first: str, general: str) -> Column:
    """The slice of a document: the first author's, the general source's, or literary."""
    return F.when(F.coalesce(author == first, F.lit(False)), "first_author").when(F.coalesce(source == general, F.lit(False)), "general").otherwise("literary")


def fertility(sizes: DataFrame, by: str, text: str) -> DataFrame:
    """(by, n_docs, n_words, n_bytes, n_tokens, n_digit_tokens, tokens_per_word, bytes_per_token, digit_token_share, fertility_p95, soft_hyphens, tabs) of texts with n_tokens and n_digit_tokens.

    fertility_p95 is the nearest-rank 95th percentile of tokens a word by document, rounded to six places, from counts of distinct values.
    """
    from zrno.functions.text import words
    from zrno.operators.stats import nearest_rank_by

    n = F.count(F.lit(1))
    has = lambda c: F.sum(F.col(c).cast("int"))
    d = cut(sizes.where(F.col(text).isNotNull()).withColumns({"_w": F.size(words(text)), "_b": F.octet_length(text), "soft": F.contains(F.col(text), F.lit("\xad")), "tab": F.contains(F.col(text), F.lit("\t"))}).drop(text), "sizes")
    g = d.groupBy(by).agg(n.alias("n_docs"), F.sum("_w").alias("n_words"), F.sum("_b").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_digit_tokens").alias("n_digit_tokens"), has("soft").alias("soft_hyphens"), has("tab").alias("tabs"))
    p95 = nearest_rank_by(d.where("_w > 0").select(by, F.round(F.col("n_tokens") / F.col("_w"), 6).alias("_f")), by, "_f", 0.95, "fertility_p95")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return g.join(p95, by, "left").withColumns({"tokens_per_word": over("n_tokens", "n_words"), "bytes_per_token": over("n_bytes", "n_tokens"), "digit_token_share": over("n_digit_tokens", "n_tokens"), "fertility_p95": F.coalesce("fertility_p95", F.lit(0.0))})


def length_report(made: DataFrame, by: str, budget: int, short: int = 64) -> DataFrame:
    """(by, n_chunks, n_tokens, p50, p95, longest, at_budget, under_short) of chunks' lengths; percentiles are nearest ranks from counts of distinct lengths."""
    from zrno.operators.stats import nearest_rank_by

    n = F.col("n_tokens")
    d = made.select(by, "n_tokens")
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(n.cast("long")).alias("n_tokens"), F.max(n).alias("longest"), F.sum((n == budget).cast("long")).alias("at_budget"), F.sum((n < short).cast("long")).alias("under_short"))
    return g.join(nearest_rank_by(d, by, "n_tokens", 0.5, "p50"), by).join(nearest_rank_by(d, by, "n_tokens", 0.95, "p95"), by)


def tiles(docs: DataFrame, key: str, tokens: str, seq_len: int, pad: int = 0, ignore: int = -1) -> DataFrame:
    """(key, window, x, y): a document's tokens tiled into windows of seq_len, every target once, the last padded."""
    t, n = F.col(tokens), F.size(tokens)
    starts = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(seq_len))).otherwise(F.array().cast("array<int>"))
    d = cut(docs.select(key, t.alias("t"), F.posexplode(starts).alias("window", "i")), "tiles")
    x, y = F.slice("t", F.col("i") + 1, seq_len), F.slice("t", F.col("i") + 2, seq_len)
    x = F.slice(x, F.lit(1), F.least(F.size("t") - F.col("i"), F.lit(seq_len)))
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.lit(seq_len) - F.size(a)))
    return d.select(key, "window", fill(x, pad).alias("x"), fill(y, ignore).alias("y"))


def parameters(vocabularies: list[int], shapes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(vocabulary, width, layers, body, tables): parameters of a transformer's blocks and of its token tables."""
    return [(v, d, n, 12 * d * d * n, (2 + -(-n // 2)) * v * d) for v in vocabularies for d, n in shapes]




def segmented(word: str, enc: tiktoken.Encoding) -> str:
    """A word's tokens parted by bars; a token that ends within a character shows as a replacement."""
    return "|".join(enc.decode_single_token_bytes(t).decode("utf-8", "replace") for t in enc.encode_ordinary(word))


def vocabulary_table(spark, path: str = encoding.VOCABULARY) -> DataFrame:
    """(id, n_bytes, has_digit, text) of a vocabulary; text is null for tokens that aren't whole characters."""
    rows = []
    for raw, i in encoding.ranks(path).items():
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = None
        rows.append((i, len(raw), any(48 <= b <= 57 for b in raw), text))
    return spark.createDataFrame(rows, "id int, n_bytes int, has_digit boolean, text string")


def vocabulary_fingerprint(path: str = encoding.VOCABULARY) -> str:
    """SHA-256 of a vocabulary's tokens in the order of their ids, each with its length before it."""
    import hashlib

    h = hashlib.sha256()
    for raw, _ in sorted(encoding.ranks(path).items(), key=lambda x: x[1]):
        h.update(len(raw).to_bytes(4, "big") + raw)
    return h.hexdigest()
