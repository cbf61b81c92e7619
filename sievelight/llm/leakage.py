"""Evaluation passages inside training documents, by suffix arrays over shards of the corpus.

Each Arrow batch of documents is a shard. Its words (case, punctuation, accents, cue numbers and times aside) are hashed,
and the suffixes that begin with K words which also begin a suffix of a test item are sorted by their words in a suffix
array. Every test suffix is binary-searched in it; each of the places found is extended to the longest verbatim match,
by binary search over prefix hashes of item and document. Matches that follow one another in item and document with
small gaps are chained, each diagonal in a chain of its own. A chain that spans half of the item's words, nearly all of
them matched, is a leak; one that may still become one is aligned word by word, so that replaced or damaged words
inside a passage do not end it.

Tags, and sound descriptions or speakers of at most LABEL words, do not interrupt a passage; longer text in brackets is
text like any other. Items of fewer than K words are found as a whole run of words, in brackets too. Nothing is
shuffled, and the corpus is read once for any number of items: items (a fixed table) are broadcast in blocks of at most
BLOCK. NULL and empty texts leak nothing; items without words leak nowhere."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.vector import grams, tokens
from sievelight.llm.mojibake import _reader

K = 4
BLOCK = 4000
#: Words of item or document that a chain may skip between two verbatim matches.
GAP = 14
#: Part of the item's words that the chained matches must span to be aligned, and the aligned part to count.
CHAIN = 0.3
PART = 0.5
#: Share of the aligned words that must agree; about one word in eight may be damaged.
COMMON = 0.8
#: Share of the words of a chain's part of the item in verbatim matches from which no alignment is needed.
SURE = 0.9

#: Words of a stretch in brackets, of a starred one or of a speaker's name up to which it is a label, not text.
LABEL = 3

_NUMBERS = re.compile(r"^[\d\s:.,;<>\-–—]*\d[\d\s:.,;<>\-–—]*$|^\ufeff?WEBVTT\b", re.M)
_TAGS = re.compile(r"</?(?:[A-Za-zí]|f[o0]nt|lang|ruby|rt)\b[^<>\n]*>|\{\\[^{}\n]*\}", re.I)
_SPANS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|\[[^\[\]\n]*\]|\([^()\n]*\)|\*[^*\n]*\*|^[A-Z][A-Z .'-]+:", re.M)
#: Cue times with their number and settings (arrows may be broken), and any other clock time; words around them stay.
_CLOCK = r"\d+:\d\d(?::\d\d)?(?:[.,:]\d+)?"
_TIMES = re.compile(rf"(?:(?<!\S)\d+[ \t]+)?{_CLOCK}[ \t]*[-–—>]+[-–—> \t]*{_CLOCK}(?:[ \t]+(?:(?:align|position|line|size|vertical|region):\S+|[XY][12]:\d+))*|{_CLOCK}")
_LOST = re.compile(r"(?<=[^\W\d_])[?\ufffd]+(?=[^\W\d_])|\ufffd")
_SOFT = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def _label(m: re.Match) -> str:
    return " " if len(m.group().split()) <= LABEL else m.group().replace("<", " ").replace(">", " ")


def normal(t: str | None, labels: bool = False) -> bytes:
    """Lower-case words of a text without accents, cue marks, tags and, unless wanted, labels.

    Text in a wrong encoding is restored first; a letter that is lost stays as one wrong character of its word."""
    if not t:
        return b""
    t = _TAGS.sub(" ", _NUMBERS.sub(" ", _TIMES.sub(" ", t.replace("\r", "\n"))))
    if not labels:
        t = _SPANS.sub(_label, t)
    if "?" in t or not t.isascii():
        t = _LOST.sub("_", t)
    if not t.isascii():
        t = _reader().text(t)[1]
        t = _SOFT.sub("", t)
        t = "".join([c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"])
    return t.lower().encode("utf-8", "replace")


_WORDS = np.zeros(256, bool)
_WORDS[48:58] = _WORDS[97:123] = _WORDS[95] = _WORDS[128:] = True


def _close(a: bytes, b: bytes) -> bool:
    """Whether two different words are one with a wrong character or two."""
    n, m = len(a), len(b)
    if abs(n - m) > 1 or max(n, m) < 3:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    return max(n, m) - i - j <= max(1, max(n, m) // 4)


def align(item: list[bytes], doc: list[bytes]) -> tuple[int, int, int]:
    """(first word, end, words in common) of the part of the item in the best local alignment.

    Words that agree count 1, damaged ones 0.5, others -0.9; a word of the item without partner costs 0.9, one of the
    document 0.6. A row of the table at a time: what a row passes on to its right is a running maximum."""
    n, m = len(item), len(doc)
    if not n or not m:
        return 0, 0, 0
    number = {w: i for i, w in enumerate(dict.fromkeys(item + doc))}
    a, b = np.array([number[w] for w in item]), np.array([number[w] for w in doc])
    same = a[:, None] == b[None, :]
    size_a, size_b = np.array([len(w) for w in item]), np.array([len(w) for w in doc])
    first_a, first_b = np.array([w[0] for w in item]), np.array([w[0] for w in doc])
    like = ~same & (first_a[:, None] == first_b[None, :]) & (np.abs(size_a[:, None] - size_b[None, :]) <= 1) & (np.maximum(size_a[:, None], size_b[None, :]) >= 3)
    gain = np.where(same, 1.0, -0.9)
    for i, j in zip(*np.nonzero(like)):
        if _close(item[i], doc[j]):
            gain[i, j] = 0.5
    best, where = 0.0, (0, 0, 0)
    score, begin, hits = np.zeros(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    slope = 0.6 * np.arange(m + 1)
    for i in range(n):
        from_diag = np.maximum(score[:-1], 0) + gain[i]
        x = np.concatenate(([0.0], from_diag))
        xb = np.concatenate(([i], np.where(score[:-1] > 0, begin[:-1], i)))
        xh = np.concatenate(([0], np.where(score[:-1] > 0, hits[:-1], 0) + (gain[i] > 0)))
        up = score - 0.9
        over = up > x
        x, xb, xh = np.where(over, up, x), np.where(over, begin, xb), np.where(over, hits, xh)
        run = x + slope
        top = np.maximum.accumulate(run)
        at = np.maximum.accumulate(np.where(run >= top, np.arange(m + 1), 0))
        score, begin, hits = np.maximum(top - slope, 0), xb[at], xh[at]
        j = int(score.argmax())
        if score[j] > best:
            best, where = float(score[j]), (int(begin[j]), i + 1, int(hits[j]))
    return where


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words:
    """The words of texts one after another: hashes, text numbers, bounds, and prefix hashes to compare stretches by."""

    def __init__(self, norm: list[bytes]):
        self.h, self.doc, self.start, self.end = tokens(norm, _WORDS)
        self.buf = b"\n".join(norm) + b"\n"
        self.bounds = np.searchsorted(self.doc, np.arange(len(norm) + 1))
        n = len(self.h)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _B)
            power[0] = 1
            self.undo = np.full(n + 1, _B_INV)
            self.undo[0] = 1
            power, self.undo = np.cumprod(power), np.cumprod(self.undo)
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.h | np.uint64(1)) * power[:n])))

    def stretch(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[at + n] - self.prefix[at]) * self.undo[at]

    def list(self, lo: int, hi: int) -> list[bytes]:
        return [self.buf[self.start[k] : self.end[k]] for k in range(lo, hi)]


class Items:
    """The test items: words, and all their suffixes of K words and more sorted by their first K words; short items by
    the hash of all their words."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.text = Words([normal(t) for t in texts])
        w = self.text
        self.size = np.diff(w.bounds)
        g, _, at = grams(w.h, w.doc, K)
        o = np.argsort(g, kind="stable")
        self.gram, self.at = g[o], at[o]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.gram >> np.uint64(44)).astype(np.int64)] = True
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < K)):
            n = int(self.size[i])
            lo = int(w.bounds[i])
            x, _, _ = grams(w.h[lo : lo + n], w.doc[lo : lo + n], n)
            self.short.setdefault(n, {}).setdefault(int(x[0]), []).append(int(i))


def suffix_array(w: Words, at: np.ndarray, g: np.ndarray, depth: int = 4) -> np.ndarray:
    """The suffixes that begin at ``at`` (with first K words g), sorted by their words K at a time to depth * K words."""
    keys = [g]
    for d in range(1, depth):
        n = np.minimum(K, np.maximum(w.bounds[w.doc[at] + 1] - at - d * K, 0))
        keys.append(w.stretch(np.minimum(at + d * K, len(w.h)), n))
    return np.lexsort(keys[::-1])


def longest_matches(w: Words, items: Items) -> tuple[np.ndarray, ...]:
    """(text number, item number, item word, text word, length) of all verbatim matches of K words and more that can be
    extended to neither side, sorted by text, item and place."""
    g, _, at = grams(w.h, w.doc, K)
    hit = items.seen[(g >> np.uint64(44)).astype(np.int64)]
    g, at = g[hit], at[hit]
    order = suffix_array(w, at, g)
    suffix, place = g[order], at[order]
    lo = np.searchsorted(suffix, items.gram, side="left")
    n = np.searchsorted(suffix, items.gram, side="right") - lo
    which = np.repeat(np.arange(len(n)), n)
    p = place[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
    i = items.at[which]
    it, d = items.text.doc[i], w.doc[p]
    # a match that goes on to the left is part of a longer one
    first = (i == items.text.bounds[it]) | (p == w.bounds[d])
    first |= items.text.h[np.maximum(i - 1, 0)] != w.h[np.maximum(p - 1, 0)]
    i, p, it, d = i[first], p[first], it[first], d[first]
    known = np.full(len(i), K)
    most = np.minimum(items.text.bounds[it + 1] - i, w.bounds[d + 1] - p) + 1  # length that is too much
    while (open_ := most - known > 1).any():
        half = np.where(open_, (known + most) // 2, known)
        same = items.text.stretch(i, half) == w.stretch(p, half)
        known, most = np.where(same, half, known), np.where(open_ & ~same, half, most)
    o = np.lexsort((i, p, it, d))
    return d[o], it[o], (i - items.text.bounds[it])[o], p[o], known[o]


def find(texts: list[str | None], items: Items, norm: list[bytes] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, first word, end, words in common) of each leaked part in a shard; norm: normal() of
    the texts where it is known."""
    w = Words(norm if norm is not None else [normal(t) for t in texts])
    out = []
    if items.short:
        whole = Words([normal(t, labels=True) for t in texts])
        for n, of in items.short.items():
            x, d, _ = grams(whole.h, whole.doc, n)
            hit = np.isin(x, np.array(list(of), np.uint64))
            out += [(t, i, 0, n, n) for t, i in sorted({(int(t), i) for v, t in zip(x[hit], d[hit]) for i in of[int(v)]})]
    if not len(items.gram) or not len(w.h):
        return out
    d, it, ip, dp, n = longest_matches(w, items)
    if not len(d):
        return out
    cut = np.flatnonzero((d[1:] != d[:-1]) | (it[1:] != it[:-1])) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(d)]))
    need = np.maximum(K + 1, (CHAIN * items.size).astype(np.int64))
    # a pair must have matches spread over enough of the item before it is looked at at all
    wide = np.maximum.reduceat(ip + n, starts) - np.minimum.reduceat(ip, starts) >= np.minimum(need, items.size)[it[starts]]
    for a, b in zip(starts[wide], ends[wide]):
        i, t = int(it[a]), int(d[a])
        size = int(items.size[i])
        found = [_judge(w, items, t, i, size, c) for c in _chains(ip[a:b], dp[a:b], n[a:b], min(int(need[i]), size))]
        best = max((f for f in found if f), key=lambda f: f[1] - f[0], default=None)
        if best:
            out.append((t, i, *best))
    return out


def _judge(w: Words, items: Items, t: int, i: int, size: int, chain: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The leaked part of the item that a chain shows, by itself or after alignment."""
    ok = lambda f, l, c: l - f >= PART * size - 1 and c >= COMMON * (l - f)
    covered = np.zeros(size, bool)
    for k, _, n in chain:
        covered[k : k + n] = True
    at = np.flatnonzero(covered)
    f, l, c = int(at[0]), int(at[-1]) + 1, len(at)
    if ok(f, l, c) and c >= SURE * (l - f):
        return f, l, c
    around = size // 2 + 4
    lo = max(int(w.bounds[t]), chain[0][1] - around)
    hi = min(int(w.bounds[t + 1]), max(p + n for _, p, n in chain) + around)
    begin = int(items.text.bounds[i])
    f, l, c = align(items.text.list(begin, begin + size), w.list(lo, hi))
    return (f, l, c) if ok(f, l, c) else None


def _chains(ip: np.ndarray, dp: np.ndarray, n: np.ndarray, need: int) -> list[list[tuple[int, int, int]]]:
    """Chains of matches (item word, document word, length) that span ``need`` item words.

    Chains on different diagonals stay open side by side; a match joins the nearest within GAP or begins its own."""
    o = np.lexsort((ip, dp))
    out, chains = [], []
    for i, p, k in zip(ip[o].tolist(), dp[o].tolist(), n[o].tolist()):
        ended = [c for c in chains if p - c[-1][1] - c[-1][2] > GAP]
        if ended:
            out += ended
            chains = [c for c in chains if p - c[-1][1] - c[-1][2] <= GAP]
        near = min(chains, key=lambda c: abs((p - i) - (c[-1][1] - c[-1][0])), default=None)
        if near and abs((p - i) - (near[-1][1] - near[-1][0])) <= GAP:
            near.append((i, p, k))
        else:
            chains.append([(i, p, k)])
    out += chains
    return [c for c in out if max(i + k for i, _, k in c) - min(i for i, _, _ in c) >= need]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, first_word, end_word, common_words, item_words) of each leaked item of each document."""
    rows = [(r.item_id, r.text) for r in items.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator()]
    schema = docs.select(key).schema
    for n in ("item_id", "first_word", "end_word", "common_words", "item_words"):
        schema = schema.add(n, "long")
    blocks = [docs.sparkSession.sparkContext.broadcast(Items([i for i, _ in rows[k : k + BLOCK]], [t for _, t in rows[k : k + BLOCK]])) for k in range(0, len(rows), BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            norm = [normal(t) for t in texts]
            for block in blocks:
                its = block.value
                found = find(texts, its, norm)
                at = pa.array([f[0] for f in found], pa.int64())
                cols = [[int(its.ids[f[1]]) for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found], [int(its.size[f[1]]) for f in found]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *[pa.array(c, pa.int64()) for c in cols]], names=schema.names)

    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
