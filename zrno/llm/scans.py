"""Noise in text from scanned pages.

Words are counted over all texts, those divided over a line end apart. A pass over the texts finds page numbers, lines that
name the record's own work or author, lines that break into a sentence, and words divided by a sure mark. What one text can't tell
goes to SQL, where it meets the counts of all texts:

- short lines that may be headers are joined with the lines that stand beside page numbers in five records or more, at least one in
  twenty of the records that have them. Both are compared with what scanning confuses made one, so misread headers meet too;
- words divided by a plain hyphen are joined with the counts of both ways of writing, so compounds keep their hyphen;
- words that aren't frequent are joined with corrections.

Misread words: a word's anagram hash is the sum of the fifth powers of its code points, so that mistaking `m` for `rn` changes it by the same
amount in every word. Confusions are learnt: rare words and words 20 times as frequent that differ in one place give differences; the difference
that explains most rare words is taken, its words set aside, and so on; a difference is a confusion if it explains a tenth
as many words as the first, mostly before the word's end, and what is read stands mostly for one thing. Those and a list of known
ones shift the hashes of rare words, which are joined with frequent words on the hash; the join is checked by carrying out the
replacement, and the most frequent variant wins.

The repaired text has edge lines removed, divided words joined, corrections applied, and wrapped lines joined into paragraphs.

Broadcast are words that make up 2**-19 or more of all, at most 2**19, only to keep them out of the shuffle; and 2**20 bits
that tell most lines that are no header's, likewise. Neither changes a result.

Nulls: null and blank texts have no noise; null titles and authors name no header. Empty tables give empty results. Extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.session import cut

#: Known confusions: what scanning makes of it, and what is printed. Marks and digits within a word need less evidence than letters.
CONFUSIONS = (
    ("ri", "n"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("li", "h"), ("lc", "k"), ("ii", "u"), ("fi", "t"), ("f", "t"), ("f", "s"),
    ("c", "e"), ("c", "č"), ("ć", "č"), ("s", "š"), ("z", "ž"), ("ſ", "s"), ("1", "l"), ("1", "i"), ("0", "o"), ("6", "b"),
    ("8", "b"), ("9", "g"), ("5", "s"), ("@", "a"), ("|", "i"), ("|", "l"), ("~", "r"), ("^", "v"), ("$", "s"), ("vv", "v"), ("tl", "d"), ("iii", "m"), ("nn", "m"),
)
_EDGE = ".,;:!?\"'„“”»«…()[]–—-‚’‘<>/\\¬\xad* "
_DIGITS = r"[0-9lIOo]{1,4}"
_PAGE = re.compile(rf"(?:\[\s?{_DIGITS}\s?\]|\(\s?{_DIGITS}\s?\)|\*\s?{_DIGITS}\s?\*|[-–—]\s?{_DIGITS}\s?[-–—]|(?:[Ss]tran|[Ss]tr\.|[Ss]\.|[Pp]ag\.|[Pp]\.)\s?{_DIGITS}\.?|{_DIGITS}\.?)")
_BARE = re.compile(rf"{_DIGITS}\.?")
_GAP = re.compile(r"\s{3,}|\t+")
_HYPHEN = re.compile(r"([^\W\d_][^\s]*)([-¬\xad])[ \t]*$")
_DIVIDED = re.compile(r"[^\W\d_]\S*[-¬\xad][ \t]*\n\s*[^\W\d_A-ZČŠŽĆĐ]\S*")
_SENTENCE_END = re.compile(r"[.!?…:;,][\"'“”«»)]*$")
#: Bits of the filter of lines that may be headers.
BITS = 1 << 20
KINDS = ("hyphen", "misread", "header", "page_number")


def page_number(s: str) -> int | None:
    """The number a line consists of, in whatever dress, misread digits included; None for another line."""
    if not _PAGE.fullmatch(s):
        return None
    d = re.search(_DIGITS + r"(?=\D*$)", s)
    raw = d[0] if d else ""
    if not any(c.isdigit() for c in raw) and (s == raw or len(raw) > 3):
        return None
    return int(raw.replace("l", "1").replace("I", "1").replace("O", "0").replace("o", "0"))


def parts_of(line: str) -> list[str]:
    return [p for p in _GAP.split(line.strip()) if p]


def could_head(s: str) -> bool:
    return 4 <= len(s) <= 80 and len(s.split()) <= 10 and not s[0].islower() and not _SENTENCE_END.search(s)


def alike(a: str, b: str) -> bool:
    """Whether two short lines are the same but for a few misread characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 3 or len(set(a) ^ set(b)) > 8:
        return False
    if len(a) == len(b):
        off = sum(x != y for x, y in zip(a, b))
        if off <= max(1, len(a) // 6):
            return True
    return SequenceMatcher(None, a, b, False).ratio() >= 0.84


def head_key(s: str) -> str:
    return " ".join(s.casefold().split())


_SEVERAL = [(a, b) for a, b in (("iii", "m"), ("ri", "n"), ("rn", "m"), ("nn", "m"), ("cl", "d"), ("tl", "d"), ("li", "h"), ("lc", "k"), ("ii", "u"), ("fi", "t"), ("vv", "v"))]
_ONE = str.maketrans("1l|jfsš5$ſcčćez0o68b9g@a~r^vž", "iiiittttttcccczoobbbggaarrvvz")


def same_key(s: str) -> str:
    """A line with what scanning confuses made one, so that a line and its misread form have the same key."""
    s = head_key(s)
    for a, b in _SEVERAL:
        s = s.replace(a, b)
    return s.translate(_ONE)


class Layout:
    """The lines of a text, told apart."""

    def __init__(self, text: str, names: list[str], heads: set[str] | None = None) -> None:
        """heads: keys of lines that are known to be headers; without them `maybe` lists the lines to be looked up."""
        self.lines = [x.rstrip() for x in text.splitlines()]
        n = len(self.lines)
        sizes = sorted(len(x) for x in self.lines if x)
        self.width = sizes[len(sizes) * 3 // 4] if sizes and sizes[-1] <= 120 else 0
        self.page = [False] * n
        self.head = [False] * n
        numbers: dict[int, int] = {}
        loose: dict[int, int] = {}
        split = {}
        for i, raw in enumerate(self.lines):
            s = raw.strip()
            if not s or len(s) > 110:
                continue
            ps = parts_of(s)
            if len(ps) > 2:
                continue
            if len(ps) == 1 and not any(c.isdigit() for c in s) and "l" not in s:
                continue
            got = [(k, v) for k, p in enumerate(ps) if (v := page_number(p)) is not None]
            if len(got) != 1:
                continue
            k, v = got[0]
            if len(ps) == 2:
                split[i] = ps[1 - k]
                numbers[i] = v
            elif _BARE.fullmatch(s) and (not any(c.isdigit() for c in s) or i == 0 or not self.lines[i - 1].strip()):
                loose[i] = v  # a year or a chapter, unless the other pages count up to it
            elif i:
                numbers[i] = v
        known = set(numbers.values())
        for i, v in loose.items():
            if i and any(v + d in known for d in (-2, -1, 1, 2)):
                numbers[i] = v
        for i in numbers:
            self.page[i] = True
        self.beside: list[tuple[int, str]] = []
        self.maybe: dict[int, str] = {}
        low = [head_key(x) for x in names if x]
        for i in range(n):
            s = split.get(i) or ("" if self.page[i] else self.lines[i].strip())
            if i in split:
                self.beside.append((i, s))
                self.head[i] = True
                continue
            if not s or not could_head(s):
                continue
            near = (i > 0 and self.page[i - 1] and i - 1 not in split) or (i + 1 < n and self.page[i + 1] and i + 1 not in split)
            if near:
                self.beside.append((i, s))
            if i:
                k = head_key(s)
                if any(alike(k, x) for x in low) or self._breaks_in(i):
                    self.head[i] = True
                elif heads is None:
                    self.maybe[i] = same_key(s)
                else:
                    self.head[i] = bool(heads) and same_key(s) in heads

    def _breaks_in(self, i: int) -> bool:
        """A short line that begins anew while the sentence before it goes on after it."""
        s = self.lines[i].strip()
        if self.width < 25 or not s[0].isupper():
            return False
        before = next((self.lines[k].rstrip() for k in range(i - 1, max(-1, i - 4), -1) if self.lines[k].strip() and not self.page[k]), "")
        after = next((x.lstrip() for k, x in enumerate(self.lines[i + 1 : i + 4], i + 1) if x.strip() and not self.page[k]), "")
        if _HYPHEN.search(before) and after[:1].islower():
            return True  # a divided word never goes on with a capital line
        return len(s) <= 0.7 * self.width and bool(before) and len(before) > 0.6 * self.width and not _SENTENCE_END.search(before) and after[:1].islower()

    def edges(self) -> list[bool]:
        return [a or b for a, b in zip(self.page, self.head)]


def _count(names: list[str]):
    """(kind, key, n): words ("w") of a partition, and short lines beside page numbers ("h") once for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        heads: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for w, n in raw.items():
                if w := w.strip(_EDGE):
                    words[w] += n
            keys = [*words, *heads]
            b = pa.RecordBatch.from_arrays([pa.array(["w"] * len(words) + ["h"] * len(heads), pa.string()), pa.array(keys, pa.string()), pa.array([*words.values(), *heads.values()], pa.int64())], names=names)
            raw.clear()
            heads.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if "\n" in t:
                    heads.update({same_key(s) for _, s in Layout(t, [], set()).beside})
                    t = _DIVIDED.sub(" ", t)
                raw.update(t.lower().split())
            if len(raw) > 500_000:
                yield flush()
        yield flush()

    return run


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of a word's code points, each modulo 2**31 - 1."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda h, c: h + F.when(F.length(c) > 0, _fifth(F.ascii(c).cast("long"))).otherwise(F.lit(0).cast("long")))


def _fifth(x: Column) -> Column:
    p = F.lit((1 << 31) - 1)
    x2 = x * x % p
    return x2 * x2 % p * x % p


def _replaced(word: str, a: Column, b: Column, right: Column) -> Column:
    """Whether carrying out a -> b at some place of the word gives `right`."""
    at = F.sequence(F.lit(1), F.length(word) - F.length(a) + 1)
    return F.exists(at, lambda i: (F.substring(word, i, F.length(a)) == a) & (F.concat(F.substring(word, F.lit(1), i - 1), b, F.substring(word, i + F.length(a), F.length(word))) == right))


def differences(words: DataFrame, ratio: int = 20) -> DataFrame:
    """(word, a, b, m, inner) of rare words (word, n) that differ from one `ratio` times as frequent (m) in one place only: a, of up to three letters, stands for b, of up to two. a is of ASCII characters: others are what a wrong encoding makes of letters.

    A word less a part, by what stands before and after it, is what both words share; inner: whether the word goes on for two letters or more.
    """
    parts = lambda most: F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length("word") - i + 1)), lambda k: F.struct(F.substring("word", F.lit(1), i - 1).alias("pre"), F.substring("word", i, k).alias("part"), F.substring("word", i + k, F.length("word")).alias("post"))))))
    ok = words.where("length(word) between 4 and 40")
    often = ok.where(f"n >= {ratio}").select("n", parts(2).alias("x")).select(F.col("n").alias("m"), "x.pre", "x.post", F.col("x.part").alias("b"))
    rare = ok.select("word", "n", parts(3).alias("x")).select("word", "n", "x.pre", "x.post", F.col("x.part").alias("a"))
    j = rare.join(often, ["pre", "post"]).where(f"a <> b and m >= {ratio} * n and (length(a) = 1 or length(b) = 1) and a rlike '^[ -~]+$'")
    return j.groupBy("word", "a", "b").agg(F.max("m").alias("m"), F.max((F.length("post") >= 2).cast("int")).alias("inner"))


def confusions(words: DataFrame, known: tuple[tuple[str, str], ...] = CONFUSIONS, rounds: int = 12, share: float = 0.1) -> list[tuple[str, str]]:
    """The known confusions and those that the words show. Only counts by difference, a row for each pair of parts, are looked at on the driver: the largest, one a round."""
    d = cut(differences(words), "differences")
    old = d.sparkSession.createDataFrame(list(known), "a string, b string")
    by = d.join(F.broadcast(old), ["a", "b"]).groupBy("a", "b").agg(F.countDistinct("word").alias("k"))
    first = by.agg(F.max("k")).first()[0] or 0
    d = cut(d.join(d.join(F.broadcast(old), ["a", "b"]).select("word").distinct(), "word", "left_anti"), "unexplained")
    out = list(known)
    for _ in range(rounds):
        of = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.sum("inner").alias("inner"))
        every = d.groupBy("a").agg(F.countDistinct("word").alias("every"))
        good = of.where(f"k >= {max(3, share * first)} and inner >= 0.5 * k").join(every, "a").where("k >= 0.5 * every")
        best = good.orderBy(F.desc("k"), "a", "b").first()
        if best is None:
            break
        first = max(first, best.k)
        out.append((best.a, best.b))
        d = cut(d.join(d.where((F.col("a") == best.a) & (F.col("b") == best.b)).select("word").distinct(), "word", "left_anti"), "unexplained")
    return out


def corrections(words: DataFrame, least: int = 5, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(word, right): rare words (word, n) that a confusion ties to a much more frequent one.

    The frequent word must stand 20 times as often where letters are mistaken for letters, twice where marks or digits are.
    """
    fifth = lambda s: sum(pow(ord(c), 5, (1 << 31) - 1) for c in s)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(2 if not a.isalpha() or a == "ſ" else 20).alias("ratio"), F.lit(fifth(b) - fifth(a)).cast("long").alias("shift")) for a, b in (pairs or CONFUSIONS)]
    hashed = cut(words.where(F.length("word") >= 3).withColumn("h", anagram_hash(F.col("word"))), "hashed")
    shown = F.filter(F.array(*rows), lambda c: F.contains(F.col("word"), c.a))
    rare = hashed.select("word", "n", "h", F.explode(shown).alias("c")).select("word", "n", "c.a", "c.b", "c.ratio", (F.col("h") + F.col("c.shift")).alias("h"))
    often = hashed.where(f"n >= {least}").select(F.col("word").alias("right"), F.col("n").alias("m"), "h")
    j = rare.join(often, "h").where("m >= ratio * n and right <> word")
    first = cut(j.where(_replaced("word", F.col("a"), F.col("b"), F.col("right"))).groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right")), "corrections")
    again = first.select(F.col("word").alias("right"), F.col("right").alias("further"))  # two confusions in one word
    return first.join(again, "right", "left").select("word", F.coalesce("further", "right").alias("right"))


def parts_of_word(a: str, b: str) -> tuple[str, str]:
    """The two parts of a divided word as they are counted."""
    return a.lower().lstrip(_EDGE), b.lower().rstrip(_EDGE)


def divided(pairs: DataFrame, words: DataFrame, least: int = 5) -> DataFrame:
    """(a, b, joined) of distinct pairs (a, b) of parts about a hyphen at a line end: one word if that is written no less often than the compound; where neither is, unless both parts are words of four letters or more that are seen `least` times."""
    forms = F.array(F.struct(F.lit("whole").alias("form"), F.concat("a", "b").alias("word")), F.struct(F.lit("compound").alias("form"), F.concat_ws("-", "a", "b").alias("word")), F.struct(F.lit("a").alias("form"), F.col("a").alias("word")), F.struct(F.lit("b").alias("form"), F.col("b").alias("word")))
    e = pairs.select("a", "b", F.explode(forms).alias("f")).select("a", "b", "f.form", "f.word").join(words, "word", "left")
    n = lambda f: F.coalesce(F.max(F.when(F.col("form") == f, F.col("n"))), F.lit(0)).alias(f"n_{f}")
    g = e.groupBy("a", "b").agg(*[n(f) for f in ("whole", "compound", "a", "b")])
    two = (F.length("a") > 3) & (F.length("b") > 3) & (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return g.select("a", "b", F.when(F.col("n_whole") + F.col("n_compound") > 0, F.col("n_whole") >= F.col("n_compound")).otherwise(~two).alias("joined"))


_LATER = "\x01"  # stands within a word whose division SQL decides


def _scan(known_bc, bits_bc):
    part = pa.list_(pa.string())
    pair = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
    line = pa.list_(pa.struct([("key", pa.string()), ("odd", part)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = known_bc.value, bits_bc.value
        sound: set[str] = set()

        def odd_words(t: str) -> set[str]:
            out = set()
            for raw in set(t.lower().split()) - sound:
                w = raw.strip(_EDGE)
                if len(w) < 3 or w in known:
                    if len(sound) < 500_000:
                        sound.add(raw)
                elif _LATER not in w:
                    out.add(w)
            return out

        for b in batches:
            ids, kinds, odd, joins, heads = [], [], [], [], []
            for i, t, title, author in zip(*(b.column(k).to_pylist() for k in range(4))):
                got: set[str] = set()
                pairs: set[tuple[str, str]] = set()
                lines: dict[str, set[str]] = {}
                if "\n" in t:
                    x = Layout(t, [title, author, f"{author}: {title}" if title and author else None])
                    edge = x.edges()
                    if any(x.page):
                        got.add("page_number")
                    if any(x.head):
                        got.add("header")
                    for k, key in x.maybe.items():
                        z = zlib.crc32(key.encode()) & (BITS - 1)
                        if bits[z >> 3] >> (z & 7) & 1:
                            edge[k] = True
                            lines.setdefault(key, set()).update(odd_words(x.lines[k]))

                    def decide(p: str, mark: str, q: str, got=got, pairs=pairs) -> str:
                        if mark != "-":
                            got.add("hyphen")
                            return ""
                        pairs.add(parts_of_word(p, q))
                        return _LATER

                    t = "\n".join(join_divided([s for s, e in zip(x.lines, edge) if not e], decide))
                words = odd_words(t)
                if got or words or pairs or lines:
                    ids.append(i)
                    kinds.append(sorted(got))
                    odd.append(sorted(words))
                    joins.append([{"a": p, "b": q} for p, q in sorted(pairs)])
                    heads.append([{"key": k, "odd": sorted(v)} for k, v in sorted(lines.items())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(kinds, part), pa.array(odd, part), pa.array(joins, pair), pa.array(heads, line)], names=["id", "kinds", "odd", "joins", "lines"])

    return run


def join_divided(body: list[str], decide: Callable[[str, str, str], str]) -> list[str]:
    """Lines with divided words joined at the line end by what `decide` makes of their parts and mark: nothing, or the hyphen of a compound."""
    out: list[str] = []
    i = 0
    body = list(body)
    while i < len(body):
        line = body[i]
        m = _HYPHEN.search(line)
        j = i + 1
        while m and j < len(body) and not body[j].strip():
            j += 1
        if m and j < len(body):
            nxt = body[j].lstrip()
            w = re.match(r"[^\s]+", nxt)
            if w and (w[0][0].islower() or not w[0][0].isalpha()) and w[0][0] not in "0123456789–—-[(*":
                a = re.search(r"[^\s]+$", line[: m.end(1)])[0]
                line = line[: m.end(1)] + decide(a, m[2], w[0]) + w[0]
                body[j] = nxt[w.end() :].lstrip()
                body[i] = line
                if not body[j] and not _HYPHEN.search(line):
                    del body[j]
                elif _HYPHEN.search(line) and not body[j]:
                    del body[j]
                    continue
        out.append(body[i])
        i += 1
    return out


def paragraphs(lines: list[str]) -> str:
    """Lines as running paragraphs: blank lines part them; within, lines are joined if most of them do not end a sentence."""
    out, para = [], []

    def flush() -> None:
        if para:
            broken = sum(not _SENTENCE_END.search(s) for s in para[:-1])
            out.append((" " if 2 * broken >= len(para) - 1 else "\n").join(para))
            para.clear()

    for s in lines:
        if s.strip():
            para.append(s.strip())
        else:
            flush()
    flush()
    return "\n\n".join(out)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edge = re.escape(_EDGE.replace(" ", ""))
    word = re.compile(r"[^\s" + edge + r"]+(?:[^\s]*[^\s" + edge + r"])?")
    for b in batches:
        ids, texts = [], []
        for i, t, title, author, fixes, heads, pairs in zip(*(b.column(k).to_pylist() for k in range(7))):
            x = Layout(t, [title, author, f"{author}: {title}" if title and author else None], set(heads or ()))
            own = {(p["a"], p["b"]) for p in pairs or () if not p["joined"]}
            body = join_divided([s for s, e in zip(x.lines, x.edges()) if not e], lambda p, mark, q, own=own: "-" if mark == "-" and parts_of_word(p, q) in own else "")
            right = {f["word"]: f["right"] for f in fixes or ()}

            def fix(m: re.Match, right=right) -> str:
                w = m[0]
                r = right.get(w.lower())
                if r is None:
                    return w
                return r.upper() if w.isupper() and len(w) > 1 else r[0].upper() + r[1:] if w[0].isupper() else r

            text = paragraphs(body)
            ids.append(i)
            texts.append(word.sub(fix, text) if right else text)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(texts, pa.string())], names=["id", "repaired"])


@dataclass
class Found:
    """What the passes and joins found: seen (id, kinds), heads (id, key), joins (id, a, b, joined), fixes (id, word, right)."""

    seen: DataFrame
    heads: DataFrame
    joins: DataFrame
    fixes: DataFrame

    def kinds(self) -> DataFrame:
        """(id, noise)"""
        of = lambda d, k: d.select("id", F.lit(k).alias("noise"))
        return self.seen.select("id", F.explode("kinds").alias("noise")).union(of(self.heads, "header")).union(of(self.joins.where("joined"), "hyphen")).union(of(self.fixes, "misread")).distinct()


def _prepare(df: DataFrame, key: str, text: str, title: str, author: str) -> DataFrame:
    d = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(title).alias("title"), F.col(author).alias("author"))
    return d.where("text is not null and trim(text) <> ''")


def _found(d: DataFrame, least: int = 5, share: float = 0.05) -> Found:
    """least, share: a header stands beside page numbers in so many records, and in such a share of those that have the line."""
    sc = d.sparkSession.sparkContext
    counts = cut(d.select("text").mapInArrow(_count(["kind", "key", "n"]), "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind = 'w'").select(F.col("key").alias("word"), "n")
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    right = cut(corrections(words, pairs=confusions(words)), "right")
    often = words.where(F.col("n") >= max(5, total >> 19)).join(right, "word", "left_anti").select("word")
    known = sc.broadcast({r[0] for r in often.toLocalIterator()})
    headers = counts.where("kind = 'h'").where(F.col("n") >= least).select("key", "n")
    bits = bytearray(BITS >> 3)
    for r in headers.select((F.crc32(F.encode("key", "utf-8")) % BITS).cast("int").alias("z")).distinct().toLocalIterator():  # BITS at most
        bits[r[0] >> 3] |= 1 << (r[0] & 7)
    kind = dict(d.dtypes)["id"]
    out = f"id {kind}, kinds array<string>, odd array<string>, joins array<struct<a:string,b:string>>, lines array<struct<key:string,odd:array<string>>>"
    seen = cut(d.mapInArrow(_scan(known, sc.broadcast(bytes(bits))), out), "scanned")
    lines = seen.where(F.size("lines") > 0).select("id", F.explode("lines").alias("x")).select("id", "x.key", "x.odd")
    have = lines.groupBy("key").agg(F.count(F.lit(1)).alias("have"))
    sure = headers.join(have, "key").where(F.col("n") >= share * (F.col("n") + F.col("have"))).select("key")
    lines = cut(lines.join(sure.withColumn("sure", F.lit(True)), "key", "left"), "lines")
    joins = seen.where(F.size("joins") > 0).select("id", F.explode("joins").alias("x")).select("id", "x.a", "x.b")
    joins = cut(joins.join(divided(joins.select("a", "b").distinct(), words), ["a", "b"]), "joins")
    odd = seen.select("id", F.explode("odd").alias("word")).union(lines.where("sure is null").select("id", F.explode("odd")))
    odd = odd.union(joins.select("id", F.when(F.col("joined"), F.concat("a", "b")).otherwise(F.concat_ws("-", "a", "b"))))
    return Found(seen.select("id", "kinds"), lines.where("sure").select("id", "key"), joins, cut(odd.join(right, "word").distinct(), "fixes"))


def noise(df: DataFrame, key: str, text: str, title: str, author: str) -> DataFrame:
    """(key, noise): one row per record and kind of noise: hyphen, misread, header or page_number."""
    return _found(_prepare(df, key, text, title, author)).kinds().withColumnRenamed("id", key)


def repair(df: DataFrame, key: str, text: str, title: str, author: str, also: DataFrame | None = None) -> DataFrame:
    """(key, repaired): readable text of the records that have noise, and of those whose keys are in `also`."""
    d = _prepare(df, key, text, title, author)
    f = _found(d)
    ids = f.kinds().select("id")
    if also is not None:
        ids = ids.union(also.select(F.col(key).alias("id")))
    lists = lambda t, x, name: t.groupBy("id").agg(F.collect_list(x).alias(name))
    j = d.join(ids.distinct(), "id").join(lists(f.fixes, F.struct("word", "right"), "fixes"), "id", "left").join(lists(f.heads, F.col("key"), "heads"), "id", "left").join(lists(f.joins, F.struct("a", "b", "joined"), "pairs"), "id", "left")
    return j.select("id", "text", "title", "author", "fixes", "heads", "pairs").mapInArrow(_repair, f"id {dict(d.dtypes)['id']}, repaired string").withColumnRenamed("id", key)
