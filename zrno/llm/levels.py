"""Reading level of each document.

Texts are cut into passages at sentence ends. Each passage is described by distributions of word length, vocabulary (how common
its words are in the collection, and in documents of which level they stand), sentence length and clauses, and cohesion between
neighbouring sentences. Gradient-boosted regression trees learn passage levels from the readers' ratings; cut points between levels are fitted
to out-of-fold predictions, with the folds by source; accuracy is judged fold by fold with the cut points of the others. A document's level is the one that most of its letters are written at.

The trees are fitted on the driver on at most `most` rated documents, chosen by the hash of their ids (a documented bound); word counts and
predictions cover all documents. The vocabulary that is broadcast holds words that make up 2**-18 or more of all.

Nulls: documents without text have no level; null ratings and ratings outside 1 to 5 are ignored; repeated ratings count once.
Without any rating all documents get level 3. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zrno.llm.boost import Trees
from zrno.llm.grams import chunks
from zrno.session import cut

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'“”«»)]*\s+|\n\s*\n")
_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèâêîôûőű]+")


def passages(text: str, size: int = 350) -> list[list[str]]:
    """Sentences in groups of `size` letters or more; the rest joins the last group."""
    out, now, n = [], [], 0
    for s in SENTENCE.split(text):
        if s and not s.isspace():
            now.append(s)
            n += len(s)
            if n >= size:
                out.append(now)
                now, n = [], 0
    if now:
        if out and n < size // 2:
            out[-1].extend(now)
        else:
            out.append(now)
    return out


class Words(dict):
    """word -> row number of its properties, which grow as words come."""

    LENGTHS = np.array([0, 0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7])
    N_SHARE = 8

    def __init__(self, share: dict[str, float], levels: dict[str, float] | None = None) -> None:
        super().__init__()
        self.share_of, self.level_of = share, levels or {}
        self.low, self.width = -18 * np.log(2.0), 16 * np.log(2.0) / self.N_SHARE
        self.rows: list[tuple] = []
        self.level: list[float] = []

        self._base = np.empty((0, 9 + 8 + self.N_SHARE + 1), np.float32)
        self._long = np.empty(0, bool)
        self._level = np.empty(0)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(properties with classes as indicators, whether longer than three letters, level) by row number; only new rows are converted."""
        at = len(self._base)
        if at < len(self.rows):
            rows = np.array(self.rows[at:], np.float32)
            hot = [(rows[:, c : c + 1] == np.arange(k)).astype(np.float32) for c, k in ((4, 8), (5, self.N_SHARE + 1))]
            self._base = np.vstack([self._base, np.hstack([rows[:, :4], *hot, rows[:, 6:11]])])
            self._long = np.append(self._long, rows[:, 11] > 0)
            self._level = np.append(self._level, np.array(self.level[at:]))
        return self._base, self._long, self._level

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self.rows)
        sh = self.share_of.get(w, self.low - 1)
        cls = int(np.clip((sh - self.low) // self.width + 1, 0, self.N_SHARE))
        n = len(w)
        self.rows.append((n, n * n, len(_VOWELS.findall(w)) or 1, sh, int(self.LENGTHS[min(n, 20)]), cls, any(c in "čšž" for c in w), any(c in "äöüß" for c in w), any(c in "wyq" for c in w), any(c in "ćđ" for c in w), w.isdigit(), n > 3))
        self.level.append(self.level_of.get(w, np.nan))
        return k


class Passages:
    """The passages of texts as arrays: word numbers, the sentence and passage of each word."""

    def __init__(self, texts: list[str], words: Words) -> None:
        get = words.__getitem__
        parts, per, commas, of_sentence, doc, letters = [], [], [], [], [], []
        for d, t in enumerate(texts):
            for p in passages(t):
                at = len(doc)
                n = 0
                for s in p:
                    ws = WORD.findall(s.lower())
                    parts.append(np.fromiter(map(get, ws), np.int64, len(ws)))
                    per.append(len(ws))
                    commas.append(s.count(","))
                    of_sentence.append(at)
                    n += len(s)
                doc.append(d)
                letters.append(n)
        self.word = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.per, self.commas = np.array(per, np.int64), np.array(commas, float)
        self.of_sentence, self.doc, self.letters = np.array(of_sentence, np.int64), np.array(doc, np.int64), np.array(letters, float)
        self.sentence = np.repeat(np.arange(len(per)), self.per)
        self.passage = self.of_sentence[self.sentence] if len(per) else np.empty(0, np.int64)
        self.n = len(doc)

    def _sums(self, table: np.ndarray) -> np.ndarray:
        """Sums over each passage's words of the rows of a table by word; passages are contiguous."""
        out = np.zeros((self.n, table.shape[1]))
        count = np.bincount(self.passage, minlength=self.n)
        has = np.flatnonzero(count)
        step = 400_000
        starts = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(has):  # some passages at a time, so that the gathered rows stay in the cache
            end = max(at + 1, int(np.searchsorted(starts, starts[has[at]] + step, side="right")) - 1)
            end = int(np.searchsorted(has, end)) if end > has[at] else at + 1
            end = max(end, at + 1)
            lo, hi = starts[has[at]], starts[has[end - 1] + 1]
            out[has[at:end]] = np.add.reduceat(table[self.word[lo:hi]], starts[has[at:end]] - lo, axis=0)
            at = end
        return out

    def base(self, words: Words) -> np.ndarray:
        """Everything but the level of words: lengths, vocabulary, syntax, cohesion, script."""
        n = self.n
        table, long_word, _ = words.tables()
        count = np.bincount(self.passage, minlength=n).astype(float)
        some = np.maximum(count, 1)
        m = self._sums(table) / some[:, None]
        out = [*m.T]
        out[1] = np.sqrt(np.maximum(out[1] - out[0] ** 2, 0))
        s = self.of_sentence
        full = self.per > 0
        sentences = np.maximum(np.bincount(s[full], minlength=n), 1).astype(float)
        longest = np.zeros(n)
        np.maximum.at(longest, s, self.per)
        spread = np.sqrt(np.maximum(np.bincount(s, self.per.astype(float) ** 2, n) / sentences - (count / sentences) ** 2, 0))
        out += [count / sentences, longest, spread, np.bincount(s, self.commas, n) / sentences, np.bincount(s, self.commas, n) / some]
        # cohesion: words of more than three letters that the sentence before has too
        long = long_word[self.word]
        m = len(words.rows) + 1
        code = np.sort(self.sentence[long] * m + self.word[long])  # np.unique without indices is slower here
        code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
        at = np.searchsorted(code, code - m)
        again = (at < len(code)) & (code[np.minimum(at, len(code) - 1)] == code - m) if len(code) else np.empty(0, bool)
        sent = code // m
        same = np.zeros(len(sent), bool)
        ok = sent > 0
        same[ok] = s[sent[ok]] == s[sent[ok] - 1]
        own = s[sent] if len(sent) else np.empty(0, np.int64)
        kinds = np.maximum(np.bincount(own, minlength=n), 1)
        out += [np.bincount(own, again & same, n) / kinds, kinds / some]
        return np.stack(out, axis=1)

    def levels(self, level: np.ndarray, mean: float) -> np.ndarray:
        """Distribution of the words' levels in each passage."""
        known = ~np.isnan(level)
        v = np.where(known, level, 0.0)
        k = 8
        bins = np.where(known, np.clip(((v - 1) * 2).astype(np.int64), 0, k - 1), -1)
        m = self._sums(np.column_stack([known, v, v * v, bins[:, None] == np.arange(k)]).astype(np.float32))
        count = m[:, 0]
        some = np.maximum(count, 1)
        avg = np.where(count > 0, m[:, 1] / some, mean)
        var = np.maximum(m[:, 2] / some - avg**2, 0)
        return np.column_stack([avg, np.sqrt(var), m[:, 3:] / some[:, None], 1 - count / np.maximum(np.bincount(self.passage, minlength=self.n), 1)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        c.clear()
        return b

    for b in batches:
        for t in b.column(0).to_pylist():
            c.update(WORD.findall(t.lower()))
        if len(c) > 500_000:
            yield flush()
    yield flush()


def ratings(labels: DataFrame, key: str) -> DataFrame:
    """(id, level, n): the mean of the raters' levels for each document; a rater who rated twice counts with the mean of both."""
    ok = labels.select(F.col(key).alias("id"), F.col("level").cast("double").alias("level"), "rater").where("id is not null and level between 1 and 5")
    one = ok.groupBy("id", "rater").agg(F.avg("level").alias("level"))
    return one.groupBy("id").agg(F.avg("level").alias("level"), F.count(F.lit(1)).alias("n"))


@dataclass
class Grader:
    trees: Trees
    cuts: np.ndarray
    share: dict[str, float]
    level: dict[str, float]
    mean: float
    accuracy: float


def _smooth(total: np.ndarray, count: np.ndarray, mean: float) -> np.ndarray:
    return np.where(count > 0, (total + 3 * mean) / (count + 3), np.nan)


def _cuts(pred: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cut points between levels with the least weight on the wrong side."""
    out = []
    for lv in range(1, 5):
        grid = np.linspace(lv + 0.1, lv + 0.9, 33)
        wrong = [w[(pred > c) != (y > lv + 0.5)].sum() for c in grid]
        best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-9)
        out.append(grid[best[len(best) // 2]])
    return np.maximum.accumulate(np.array(out))


def fit(rated: pd.DataFrame, share: dict[str, float], folds: int = 5) -> Grader:
    """rated: text, source, level, n. Cross-validates by source for the cut points, then fits on all.

    The level of a word is the mean rating of the documents that hold it; for a document that trees are fitted on, of the other
    documents only.
    """
    level, trust = rated.level.to_numpy(float), np.sqrt(rated.n.to_numpy(float))
    mean = float(level.mean())
    words = Words(share)
    ps = Passages(list(rated.text), words)
    base, docs, m = ps.base(words), len(rated), len(words.rows)
    pair = np.unique(ps.doc[ps.passage] * m + ps.word)
    pd_, pw = pair // m, pair % m
    sources = sorted(set(rated.source.fillna("")))
    fold = rated.source.fillna("").map({s: i % folds for i, s in enumerate(sources)}).to_numpy()
    inner = np.arange(docs) % folds
    size = np.maximum(np.bincount(ps.doc, minlength=docs), 1)

    def word_levels(which: np.ndarray) -> np.ndarray:
        use = which[pd_]
        return _smooth(np.bincount(pw[use], level[pd_[use]], m), np.bincount(pw[use], minlength=m), mean)

    def train(which: np.ndarray) -> Trees:
        x = np.zeros((ps.n, 11))
        for k in range(folds):
            rows = inner[ps.doc] == k
            x[rows] = ps.levels(word_levels(which & (inner != k)), mean)[rows]
        rows = which[ps.doc]
        return Trees().fit(np.hstack([base, x])[rows], level[ps.doc][rows], (trust / np.sqrt(size))[ps.doc][rows])

    out = np.full(docs, np.nan)
    for k in np.unique(fold):
        rest = fold != k
        if rest.sum() >= 20:
            held = ~rest[ps.doc]
            pred = train(rest).predict(np.hstack([base, ps.levels(word_levels(rest), mean)])[held])
            p = pd.Series(pred).groupby(ps.doc[held]).median()
            out[p.index] = p.to_numpy()
    ok = ~np.isnan(out)
    cuts = _cuts(out[ok], level[ok], trust[ok]) if ok.sum() > 30 else np.array([1.5, 2.5, 3.5, 4.5])
    # each fold is judged by the cut points of the others
    hit = np.zeros(docs, bool)
    for k in np.unique(fold[ok]):
        rest, held = ok & (fold != k), ok & (fold == k)
        own = _cuts(out[rest], level[rest], trust[rest]) if rest.sum() > 30 else cuts
        hit[held] = 1 + np.searchsorted(own, out[held]) == np.round(level[held])
    accuracy = float(hit[ok].mean()) if ok.any() else float("nan")
    lv = word_levels(np.ones(docs, bool))
    return Grader(train(np.ones(docs, bool)), cuts, share, {w: lv[k] for w, k in words.items() if not np.isnan(lv[k])}, mean, accuracy)


def grades(g: Grader, texts: list[str], words: Words) -> np.ndarray:
    """The level that most of each text's letters are written at."""
    ps = Passages(texts, words)
    if not ps.n:
        return np.full(len(texts), 3)
    x = np.hstack([ps.base(words), ps.levels(words.tables()[2], g.mean)])
    votes = np.zeros((len(texts), 6))
    np.add.at(votes, (ps.doc, 1 + np.searchsorted(g.cuts, g.trees.predict(x))), ps.letters)
    return np.where(votes.sum(1) > 0, votes.argmax(1), 3)


def _grade(grader_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grader_bc.value
        words = Words(g.share, g.level)
        for b in chunks(batches, 1, 2_000_000):
            if len(words) > 300_000:
                words = Words(g.share, g.level)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grades(g, b.column(1).to_pylist(), words).astype(np.int64))], names=["id", "level"])

    return run


def train_grader(docs: DataFrame, labels: DataFrame, key: str, text: str, source: str, most: int = 2500) -> Grader:
    """The grader from the rated documents; most: at most so many of them, by hash."""
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(source).alias("source")).where("text is not null and trim(text) <> ''")
    words = cut(d.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    share = {r[0]: float(np.log(r[1] / total)) for r in words.where(F.col("n") >= max(2, total >> 18)).toLocalIterator()}
    r = ratings(labels, key)
    chosen = r.orderBy(F.xxhash64("id"), "id").limit(most)  # ids first: only the chosen texts travel
    rated = d.join(cut(chosen, "rated"), "id").where(F.length("text") >= 200).toPandas().sort_values(["id", "text"]).reset_index(drop=True)
    if rated.empty:
        width = Passages(["a"], w := Words(share)).base(w).shape[1] + 11
        return Grader(Trees(rounds=0).fit(np.zeros((1, width)), np.array([3.0])), np.array([1.5, 2.5, 3.5, 4.5]), share, {}, 3.0, float("nan"))
    return fit(rated, share)


def grade(docs: DataFrame, labels: DataFrame, key: str, text: str, source: str, least: int = 1) -> DataFrame:
    """(key, level) of every document of `least` or more code points."""
    g = train_grader(docs, labels, key, text, source)
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(f"length(text) >= {least} and trim(text) <> ''")
    bc = docs.sparkSession.sparkContext.broadcast(g)
    return d.mapInArrow(_grade(bc), f"id {dict(d.dtypes)['id']}, level long").withColumnRenamed("id", key)
