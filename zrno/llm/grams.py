"""Whole-batch numpy kernels over texts: word and character hashes, window minima, bag signatures."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def word_hashes(texts: Iterable[str], cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one text after another, number of words of each text); words are runs of letters and digits in lower case."""
    out, n = [], []
    get = cache.__getitem__
    for t in texts:
        w = WORD.findall(t.lower())
        n.append(len(w))
        out.append(np.fromiter(map(get, w), np.uint64, len(w)))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(n, np.int64)


def shingles(words: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of k words."""
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    m = len(words) - k + 1
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = (h + words[i : i + m]) * np.uint64(0x9DDFEA08EB382D69)
        h ^= h >> np.uint64(29)
    doc = np.repeat(np.arange(len(n)), n)
    ok = doc[:m] == doc[k - 1 :]
    return doc[:m][ok], h[ok]


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, multiplicity) without repetition, by text."""
    o = np.lexsort((h, doc))
    doc, h = doc[o], h[o]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_G) & 0xFFFFFFFFFFFFFFFF)


def bag_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) signatures of bags; two agree in a component with the probability of their weighted Jaccard similarity.

    Weights are whole numbers, cut into the dyadic blocks [0, 1), [1, 2), [2, 4), ... Each block of an element is a Poisson
    process over time and level: the next point's time follows from an exponential step at the block's rate, its level within
    the block from another draw; points above the element's weight are passed over. Every point falls to one of m components,
    which keeps its earliest time. An element stops once its time is later than all components of its text, so that most
    elements draw once or twice. An empty bag's components are infinite.
    """
    sig = np.full(n_docs * m, np.inf)
    if not len(h):
        return sig.reshape(n_docs, m)
    lo = np.zeros(len(h), np.int64)
    parts = [(doc, h, weight, lo, np.ones(len(h)))]
    low, size = 1, 1
    while (has := weight > low).any():
        d, e, w = doc[has], h[has], weight[has]
        parts.append((d, mix(e + _times(low)), w, np.full(len(d), low), np.full(len(d), float(size))))
        low, size = low + size, size * 2
    doc, h, weight, lo, rate = (np.concatenate(x) for x in zip(*parts))
    t = np.zeros(len(h))
    at = 1
    many = np.uint64(m)
    while len(h):
        r = mix(h + _times(at))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        r2 = mix(r ^ np.uint64(0xD6E8FEB86659FD93))
        k = doc * m + (r2 % many).astype(np.int64)
        level = lo + ((r2 >> np.uint64(32)).astype(np.float64) * 2.0**-32) * rate
        good = np.flatnonzero((t < sig[k]) & (level < weight))
        np.minimum.at(sig, k[good], t[good])
        most = sig.reshape(n_docs, m).max(1)
        go = t < most[doc]
        doc, h, weight, lo, rate, t = doc[go], h[go], weight[go], lo[go], rate[go], t[go]
        at += 1
    return sig.reshape(n_docs, m)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all code points one text after another, length of each text)."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return (np.concatenate(raw) if raw else np.empty(0, np.uint32)), np.array([len(x) for x in raw], np.int64)


_B = 0xF1357AEA2E62A9C5  # odd


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo 2**64."""
    p = np.full(n, _B, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k code points, runs over the borders of texts included: sums of c * B**-i are differences of one running sum."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    step = 1 << 18
    p = _powers(step + k - 1)
    for a in range(0, n - k + 1, step):
        part = codes[a : a + step + k - 1]
        s = np.zeros(len(part) + 1, np.uint64)
        value = _SPREAD[part & np.uint32(0xFFFF)] + (part >> np.uint32(16)).astype(np.uint64) * _G
        np.cumsum(value * p[: len(part)], dtype=np.uint64, out=s[1:])
        m = len(part) - k + 1
        out[a : a + m] = (s[k:] - s[:-k]) * p[::-1][:m]  # to one common power
    return out


_SPREAD = mix(np.arange(1, 0x10001, dtype=np.uint64))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by running minima within blocks from both ends."""
    n = len(h)
    if n < w:
        return np.empty(0, h.dtype)
    pad = -n % w
    x = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    right = np.minimum.accumulate(x, axis=1).reshape(-1)
    left = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a part holds about `most` bytes of one string column, or a single row."""
    for b in batches:
        c = b.column(column)
        size = max(1, c.nbytes)
        if size <= most or b.num_rows <= 1:
            yield b
            continue
        step = max(1, b.num_rows * most // size)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
