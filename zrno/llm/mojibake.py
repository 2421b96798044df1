"""Garbled text from wrong character encoding.

A chain is a way text gets garbled: written in one encoding and read in another, once or twice, with bytes that the reader has
no character for kept or lost. Garbling every letter and mark of the collection's alphabet by every chain gives the sequences to
look for. Records without any such sequence are clean; an interpolated character n-gram model is counted on the tokens of all of
them. A token with such a sequence is undone by every chain, and the likeliest result is accepted if it beats the token as it
stands by more than a margin, and is itself no less likely by character than clean tokens are. Margins are validated, apart for
chains that make several characters of one and those that only swap one, on all held-out clean tokens, each garbled by some of the
chains, by the hash of the token, and weighted by how often it stands.

Two things need no model. A token whose bytes are UTF-8 by a Western or Central European reading is garbled, as sound text hardly
ever looks so; it is accepted where the model, which knows no foreign words, is not sure. In a record found so or by the model,
other tokens whose bytes are UTF-8 are decoded too.

The model is broadcast. An n-gram is kept if it makes up 2**-21 or more of its order, so each order has at most 2**21 entries,
whatever the collection's size.

Nulls: null and empty texts are unaffected. Replacement characters are garbling beyond doubt; they stay in the restored text
where no letter of the alphabet makes the token likely. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zrno.session import cut

#: The letters and marks beyond ASCII that the collection's own texts are written with.
ALPHABET = "čšžČŠŽćđĆĐ„“”»«–—…’‚‘"
#: Encodings a text is written in and read in by mistake.
WRITTEN = ("utf-8", "cp1250", "iso8859-2", "cp852")
READ = ("latin-1", "cp1252", "cp1250", "iso8859-2", "cp852", "cp437", "cp1251", "mac-roman", "utf-8")
LOST = "�"
SPACE = re.compile(r"([ \n\t\r]+)")  # other blanks may be part of a garbled sequence
#: Marks of a word divided over a line end, which single bytes of other encodings are read as too.
DIVISION = re.compile(r"[¬\xad]+(?=[ \t]*\r?\n)")
ORDER = 5
#: Swapped characters are never undone into words less likely by character than this, however little the held-out tokens say.
WEAK_LEAST = -5.0


def _read(raw: bytes, enc: str, lost: bool) -> str:
    out = []
    if enc == "utf-8":
        return raw.decode("utf-8", "replace")
    for b in raw:
        try:
            c = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            c = chr(b)
        if lost and 0x80 <= ord(c) < 0xA0:
            c = ""
        out.append(c)
    return "".join(out)


def _byte(c: str, enc: str) -> bytes:
    """The byte a character was read from; characters the encoding leaves open stand for their own number."""
    try:
        return c.encode(enc)
    except UnicodeEncodeError:
        if 0x80 <= ord(c) < 0xA0:
            return bytes([ord(c)])
        raise


def _chains(alphabet: str) -> dict[str, dict[str, str]]:
    """{chain: {garbled sequence: character}}."""
    chains: dict[str, dict[str, str]] = {}

    def add(name: str, garble) -> None:
        m: dict[str, str] = {}
        for c in alphabet:
            try:
                g = garble(c)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if g and g != c and LOST not in g and g not in m and not g.isascii() and g not in alphabet:
                m[g] = c
        if m and m not in chains.values():
            chains[name] = m

    for w in WRITTEN:
        for r in READ:
            if w == r or (w != "utf-8" and r == "utf-8"):
                continue
            for lost in (False, True):
                if w == "utf-8" or not lost:
                    add(f"{w}>{r}" + "-lost" * lost, lambda c, w=w, r=r, lost=lost: _read(c.encode(w), r, lost))
                    if w == "utf-8":
                        for r2 in ("latin-1", "cp1252", "cp1250"):
                            add(f"{w}>{r}>{r2}" + "-lost" * lost, lambda c, w=w, r=r, r2=r2, lost=lost: _read(_read(c.encode(w), r, False).encode("utf-8"), r2, lost))
    return chains


class Garble:
    """Sequences to look for, and the ways to undo them."""

    def __init__(self, alphabet: str = ALPHABET) -> None:
        self.alphabet = alphabet
        self.maps = _chains(alphabet)
        self.back = {k: {c: q for q, c in m.items()} for k, m in self.maps.items()}
        self.subs = {k: re.compile("|".join(map(re.escape, sorted(m, key=len, reverse=True)))) for k, m in self.maps.items()}
        every = sorted({g for m in self.maps.values() for g in m} | {LOST}, key=len, reverse=True)
        # what the first bytes of two-byte UTF-8 letters are read as begins a sequence too
        first = {bytes([b]).decode(r, "ignore") for r in READ[:4] for b in (*range(0xC2, 0xC6), *range(0xCE, 0xD2))} - {""}
        self.lead = re.compile("[" + "".join(re.escape(c) for c in sorted({g[0] for g in every} | first)) + "]")
        self.sequence = re.compile("|".join(map(re.escape, every)))
        self.codecs = [r for r in READ if r != "utf-8"]

    def garbled(self, token: str, chain: str) -> str:
        m = self.back[chain]
        return "".join(m.get(c, c) for c in token)

    def suspect(self, token: str) -> bool:
        """Whether the token holds a garbled sequence of any chain, or is UTF-8 by its bytes."""
        return not token.isascii() and self.lead.search(token) is not None and (self.sequence.search(token) is not None or self.strict(token) is not None)

    def clean(self, text: str) -> bool:
        return self.lead.search(text) is None or not any(map(self.suspect, SPACE.split(DIVISION.sub("", text))))

    @staticmethod
    def _decodings(token: str, read: str) -> Iterator[str]:
        """The token with its bytes taken as UTF-8, once and twice, where that is possible."""
        t = token
        for _ in range(2):
            try:
                t = b"".join(_byte(c, read) for c in t).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return
            if t == token:
                return
            yield t

    def decoded(self, token: str) -> str | None:
        """The last decoding of the first encoding by which the token's bytes are UTF-8."""
        for r in self.codecs:
            if found := list(self._decodings(token, r)):
                return found[-1]
        return None

    def strict(self, token: str) -> tuple[str, str] | None:
        """(text, chain) of a token whose bytes are UTF-8 by a Western or Central European reading and give letters or marks of European scripts: sound text hardly ever does, so this needs no model and holds for foreign words too."""
        for r in READ[:4]:
            if found := list(self._decodings(token, r)):
                t = found[-1]
                if all(c.isascii() or 0xA0 <= ord(c) < 0x180 or 0x370 <= ord(c) < 0x500 or 0x2010 <= ord(c) < 0x2123 for c in t):
                    return t, f"utf-8>{r}" + f">{r}" * (len(found) - 1)
        return None

    def undone(self, token: str, model: Model | None = None) -> dict[str, str]:
        """{result: chain} of every chain that changes the token."""
        out: dict[str, str] = {}
        for k, rx in self.subs.items():
            m = self.maps[k]
            t = rx.sub(lambda x, m=m: m[x[0]], token)
            if t != token:
                out.setdefault(t, k)
        for r in self.codecs:
            for again, t in enumerate(self._decodings(token, r)):
                out.setdefault(t, f"utf-8>{r}" + f">{r}" * again)
        if LOST in token:
            parts = token.split(LOST)
            t = parts[0]
            for p in parts[1:]:  # from left to right, the letter that makes the text so far likeliest
                t = max((t + c + p for c in self.alphabet), key=lambda x: model.score(x) if model else 0.0)
            out.setdefault(t, "lost")
        return out


class Model:
    """Interpolated n-gram model of characters (Witten and Bell's weights) over tokens with their borders."""

    def __init__(self, grams: dict[str, int]) -> None:
        self.n = grams
        self.total: dict[str, int] = defaultdict(int)
        self.kinds: dict[str, int] = defaultdict(int)
        for g, k in grams.items():
            self.total[g[:-1]] += k
            self.kinds[g[:-1]] += 1
        self.total, self.kinds = dict(self.total), dict(self.kinds)

    def score(self, token: str) -> float:
        s = "\x02" + token + "\x03"
        out = 0.0
        n, total, kinds = self.n, self.total, self.kinds
        for i in range(1, len(s)):
            p = 1e-5
            for k in range(min(ORDER - 1, i) + 1):
                ctx = s[i - k : i]
                t = total.get(ctx)
                if t is None:
                    break
                d = kinds[ctx]
                p = (n.get(ctx + s[i], 0) + d * p) / (t + d)
            out += math.log(p)
        return out

    def per_char(self, token: str) -> float:
        return self.score(token) / (len(token) + 1)


def _count_tokens(g: Garble):
    """Tokens of clean records of a partition, counted; whole partitions of text become one count for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["token", "n"])
            c.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if g.clean(t):
                    c.update(t.split())
            if len(c) > 500_000:
                yield flush()
        yield flush()

    return run


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, seen): occurrences, and those in tokens that aren't held out."""
    every, seen = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([seen[x] for x in every], pa.int64())], names=["gram", "n", "seen"])
        every.clear()
        seen.clear()
        return b

    for b in batches:
        for t, n, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            s = "\x02" + t + "\x03"
            for k in range(1, ORDER + 1):
                for i in range(max(0, 2 - k), len(s) - k + 1):
                    every[s[i : i + k]] += n
                    if not held:
                        seen[s[i : i + k]] += n
        if len(every) > 1_000_000:
            yield flush()
    yield flush()


def train(df: DataFrame, text: str, g: Garble, held_out: int = 10, chains: int = 4) -> tuple[Model, dict[str, float]]:
    """The model of all clean tokens, and limits validated with a model of nine in ten of them on the rest.

    chains: by so many chains, chosen by its hash, each held-out token is garbled for validation.
    """
    d = df.select(F.col(text).alias("t")).where("t is not null and t <> ''")
    tokens = d.mapInArrow(_count_tokens(g), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = cut(tokens.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(held_out)) == 0), "tokens")
    grams = tokens.mapInArrow(_count_grams, "gram string, n long, seen long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    total = tokens.agg(F.coalesce(F.sum(F.col("n") * (F.length("token") + 2)), F.lit(0))).first()[0]
    rows = [(r[0], r[1], r[2]) for r in grams.where(F.col("n") >= int(total) >> 21).toLocalIterator()]
    sc = df.sparkSession.sparkContext
    seen = sc.broadcast(Model({x: k for x, _, k in rows if k}))
    tried = tokens.where("held").select("token", "n").mapInArrow(_probe(g, seen, chains), "what string, at int, n long").groupBy("what", "at").agg(F.sum("n").alias("n"))
    limits = limits_of({(r[0], r[1]): r[2] for r in tried.collect()})  # a row for each kind and step of the scale
    return Model({x: n for x, n, _ in rows}), limits


#: Steps of the scales on which validation counts: tenths of a nat for gains, hundredths for likelihood by character.
GAIN_STEP, QUALITY_STEP, SCALE = 0.1, 0.01, 3000


def _probe(g: Garble, model_bc, chains: int):
    """(what, at, n): held-out tokens by their likelihood by character ("quality", each once), and, as often as they stand, garbled, by what undoing them gains ("strong", "weak")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = model_bc.value, Counter()
        at = lambda x, step: int(max(-SCALE, min(SCALE, x // step)))
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out["quality", at(model.per_char(t), QUALITY_STEP)] += 1
                if t.isascii():
                    continue
                can = [k for k, m in g.back.items() if any(c in m for c in t)]
                z = zlib.crc32(t.encode())
                for i in range(min(chains, len(can))):
                    k = can[(z + i * max(1, len(can) // chains)) % len(can)]
                    out["strong" if is_strong(k) else "weak", at(_gain(model, g, g.garbled(t, k))[0], GAIN_STEP)] += n
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([x for _, x in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["what", "at", "n"])

    return run


def quantile(counts: dict[tuple[str, int], int], what: str, q: float) -> float | None:
    """The step that a share q of all lies below or on; None for none."""
    rows = sorted((at, n) for (w, at), n in counts.items() if w == what)
    want, sofar = q * sum(n for _, n in rows), 0
    for at, n in rows:
        sofar += n
        if sofar > want:
            return float(at)
    return None


def limits_of(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """Limits from the counts of _probe().

    strong_margin, weak_margin: a third of what undoing garbled tokens gains but for one in a thousand, for chains whose sequences have
    several characters and for those that only swap one; a sound token gains nothing by being undone into a worse one. floor: the
    thousandth quantile of sound tokens' likelihood by character, for the first kind; weak_floor: the tenth, for the second, which genuine
    foreign letters resemble. strong_recall, weak_recall: the share of garbled tokens beyond the margins.
    """
    low = {k: quantile(counts, k, 0.001) for k in ("strong", "weak")}
    out = {f"{k}_margin": max(2.0, (6.0 if v is None else v * GAIN_STEP) / 3) for k, v in low.items()}
    floor, weak = quantile(counts, "quality", 0.001), quantile(counts, "quality", 0.1)
    out["floor"] = -8.0 if floor is None else floor * QUALITY_STEP
    out["weak_floor"] = max(WEAK_LEAST if weak is None else weak * QUALITY_STEP, WEAK_LEAST)
    for k in low:
        every = sum(n for (w, _), n in counts.items() if w == k)
        out[f"{k}_recall"] = sum(n for (w, at), n in counts.items() if w == k and at * GAIN_STEP > out[f"{k}_margin"]) / every if every else 1.0
    return out


def is_strong(chain: str) -> bool:
    return chain.startswith("utf-8>") and not chain.endswith("-lost")


def _gain(model: Model, g: Garble, token: str) -> tuple[float, str, str]:
    """(gain of the likeliest undoing, its text, its chain)."""
    best = (-math.inf, token, "")
    for t, chain in g.undone(token, model).items():
        s = model.score(t)
        if s > best[0]:
            best = (s, t, chain)
    return best[0] - model.score(token), best[1], best[2]


def _restore(g: Garble, model_bc, limits: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_bc.value
        seen: dict[str, tuple[str, str] | None] = {}

        def judge(token: str) -> tuple[str, str] | None:
            if len(seen) > 300_000:
                seen.clear()
            if token not in seen:
                gain, t, chain = _gain(model, g, token)
                strong = is_strong(chain)
                ok = gain > limits["strong_margin" if strong else "weak_margin"] and model.per_char(t) >= limits["floor" if strong else "weak_floor"]
                seen[token] = (t, chain) if ok else g.strict(token) or ((token, "lost") if LOST in token else None)
            return seen[token]

        for b in batches:
            ids, texts, kinds, n, chains = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not g.lead.search(t):
                    continue
                hits: Counter = Counter()
                parts = SPACE.split(t)
                ends = [""] * len(parts)
                if DIVISION.search(t):
                    for k in range(0, len(parts) - 1, 2):
                        if "\n" in parts[k + 1] and (core := parts[k].rstrip("¬\xad")) != parts[k]:
                            parts[k], ends[k] = core, parts[k][len(core) :]
                for k, token in enumerate(parts):
                    if g.suspect(token) and (v := judge(token)):
                        parts[k] = v[0]
                        hits[v[1]] += 1
                if hits:
                    for k, token in enumerate(parts):  # foreign words of an affected record, where their bytes say what they are
                        if not token.isascii() and g.suspect(token) and (t := g.decoded(token)):
                            parts[k] = t
                    fixed = "".join(map(str.__add__, parts, ends))
                    ids.append(i)
                    texts.append(fixed)
                    kinds.append(LOST not in fixed)
                    n.append(sum(hits.values()))
                    chains.append(hits.most_common(1)[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(texts, pa.string()), pa.array(chains, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.bool_())], names=["id", "restored", "chain", "n_tokens", "whole"])

    return run


def restore(df: DataFrame, key: str, text: str, alphabet: str = ALPHABET) -> DataFrame:
    """(key, restored, chain, n_tokens, whole) of the records that hold a garbled stretch: their text with it undone, the commonest chain, the number of tokens undone, and whether no replacement character is left."""
    g = Garble(alphabet)
    model, limits = train(df, text, g)
    bc = df.sparkSession.sparkContext.broadcast(model)
    d = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t is not null and t <> ''")
    out = d.mapInArrow(_restore(g, bc, limits), f"id {dict(d.dtypes)['id']}, restored string, chain string, n_tokens long, whole boolean")
    return out.withColumnRenamed("id", key)
