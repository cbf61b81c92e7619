"""Per-document text statistics and the nearest structural profile.

Each line of a page's own text has a distribution over ten classes (function words, other words by form, numbers,
sentence marks, commas, symbols, separators, links). Its Jensen-Shannon divergence from the prose profile of each
language (fitted on the sentence lines of all pages) and from fixed profiles of other structures assigns the line
to the nearest; the page gets the profile that holds most of its words, and counts as prose while more than INSIDE of
them stand in lines nearest to prose."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import wholefit
from sievelight.llm.pagestats import FUNCTION, LINK, ODD, SEPARATOR, SYMBOL, Pages, function_hashes

# Profiles of text that is not prose, over the classes in the order of pagestats.CLASSES.
PROFILES = {
    "list": (0.01, 0.45, 0.32, 0.02, 0.10, 0.01, 0.02, 0.03, 0.03, 0.01),
    "table": (0.01, 0.10, 0.30, 0.02, 0.25, 0.08, 0.10, 0.02, 0.12, 0.00),
    "code": (0.01, 0.22, 0.04, 0.08, 0.15, 0.04, 0.18, 0.26, 0.02, 0.00),
    "symbols": (0.00, 0.03, 0.01, 0.02, 0.01, 0.10, 0.10, 0.60, 0.13, 0.00),
    "random": (0.03, 0.30, 0.10, 0.38, 0.04, 0.03, 0.05, 0.05, 0.02, 0.00),
    "keywords": (0.02, 0.62, 0.16, 0.02, 0.00, 0.01, 0.15, 0.01, 0.01, 0.00),
    "tags": (0.01, 0.25, 0.05, 0.45, 0.02, 0.00, 0.02, 0.10, 0.10, 0.00),
    "links": (0.01, 0.05, 0.15, 0.01, 0.03, 0.02, 0.02, 0.15, 0.03, 0.53),
    "names": (0.01, 0.05, 0.75, 0.02, 0.07, 0.02, 0.06, 0.01, 0.01, 0.00),
}
#: Words from which a line is matched by itself; shorter ones follow the page's other lines.
LEAST_WORDS = 4
#: A line this far (bits) from every prose profile is never prose.
FARTHEST = 0.30
#: Share of words in lines matched to prose up to which a page is structure; sentences of stuffed keywords, which match prose only in part, stay above it.
INSIDE = 0.4


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(-1)

    return (kl(p) + kl(q)) / 2


@dataclass
class Lines:
    """What the measures need of a batch of n pages: words and their sizes by page, and the pages' own lines."""

    n: int
    words: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    stops: np.ndarray
    chars: np.ndarray
    line_words: np.ndarray
    table: np.ndarray

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.n)


def lines_of(p: Pages) -> dict:
    """The fields of Lines."""
    own, at = p.word_own, np.flatnonzero(p.line_own & ~p.line_blank)
    words = np.bincount(p.word_doc[own], minlength=p.n)
    size = p.by_doc(p.word_size[own], p.word_doc[own])
    return {"n": p.n, "words": words, "size": size, "doc": p.line_doc[at], "stops": p.line_stops[at], "chars": p.line_chars[at], "line_words": p.line_words[at], "table": p.table[at].astype(np.int32)}


def sentence_counts(p: Pages, functions: list[np.ndarray]) -> np.ndarray:
    """By language, the classes of sentence lines of 8 words and more, and (last) the number of these lines."""
    sentence = p.line_own & p.line_stops & (p.line_words >= 8) & (p.table[:, FUNCTION] >= 0.15 * p.line_words) & (p.table[:, ODD] + p.table[:, LINK] <= 0.1 * p.line_words)
    share = [np.bincount(p.word_line, weights=np.isin(p.word_hash, h), minlength=len(p.line_doc)) for h in functions]
    best = np.argmax(np.array(share), 0) if share else np.zeros(0, int)
    out = np.zeros((len(functions), 11), np.int64)
    for i in range(len(functions)):
        at = sentence & (best == i)
        out[i, :10], out[i, 10] = p.table[at].sum(0), at.sum()
    return out


def prose_profiles(counted: np.ndarray, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Prose profile of each language with five sentence lines or more: their mean class distribution."""
    at = np.flatnonzero(counted[:, 10] >= 5)
    if not len(at):  # nothing to learn from: the usual shares of running text
        return ["prose"], np.array([[0.28, 0.40, 0.12, 0.01, 0.02, 0.09, 0.05, 0.01, 0.01, 0.01]])
    d = counted[at, :10].astype(float)
    return [f"prose_{languages[i]}" for i in at], d / d.sum(1, keepdims=True)


def judge_lines(p: Lines, profiles: np.ndarray, prose: int) -> np.ndarray:
    """Number of the nearest profile of each line (the first ``prose`` are prose); -1 for lines without words."""
    total = p.table.sum(1)
    at = np.flatnonzero(total > 0)
    near = np.full(len(total), -1)
    if not len(at):
        return near
    d = np.empty((len(at), len(profiles)))
    dist = p.table[at] / total[at, None]
    for lo in range(0, len(at), 20000):
        d[lo : lo + 20000] = divergence(dist[lo : lo + 20000], profiles)
    nearest_other = prose + np.argmin(d[:, prose:], 1)
    nearest_prose = np.argmin(d[:, :prose], 1)
    dp, do = d[np.arange(len(at)), nearest_prose], d[np.arange(len(at)), nearest_other]
    words = p.line_words[at]
    function = p.table[at, FUNCTION] / np.maximum(words, 1)
    is_prose = (dp < do) & (dp < FARTHEST) & (function >= 0.08)
    near[at] = np.where(is_prose, nearest_prose, nearest_other)
    return near


def languages(common: DataFrame) -> dict[str, np.ndarray]:
    """Function words of each language from the fixed common_words table (95 rows)."""
    by: dict[str, list[str]] = {}
    for r in common.select("lang", "word").where(F.col("word").isNotNull() & F.col("lang").isNotNull()).collect():
        by.setdefault(r.lang, []).append(r.word)
    return {k: function_hashes(v) for k, v in by.items()}


SIGNALS = "words long, mean_word_length double, symbol_share double, sentence_end_share double, common_share double, lines long, prose_share double, divergence double, profile string, residue boolean, structure boolean"


def page_statistics(pages: DataFrame, common: DataFrame) -> DataFrame:
    """One row per url, on its latest row: the counts and shares of SIGNALS, the nearest profile, and ``structure``:
    at least half of the page's own words stand outside running sentences (never for residue or pages without words).

    NULL and blank contents give zero words, null shares and structure false; rows with a null url are dropped."""
    functions = languages(common)
    langs = sorted(functions)
    hashes = [functions[k] for k in langs]
    everything = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)

    def look(p: Pages) -> tuple[dict, np.ndarray, np.ndarray]:
        n = sentence_counts(p, hashes).ravel()
        return lines_of(p), np.flatnonzero(n), n[n > 0]

    rows = wholefit.read(pages, everything, look)
    prose_names, prose = prose_profiles(wholefit.counts(rows, 11 * len(langs)).reshape(-1, 11), langs)
    names = prose_names + list(PROFILES)
    table = np.vstack([prose, np.array(list(PROFILES.values()))])
    profiles, k = table / table.sum(1, keepdims=True), len(prose)

    def judge(kept: dict, flag: np.ndarray) -> list[pa.Array]:
        p = Lines(**{x: v for x, v in kept.items() if x != "url"})
        return _signals(p, judge_lines(p, profiles, k), names, profiles, k, flag)

    return wholefit.judged(*wholefit.fit(rows), judge, SIGNALS)


def _signals(p: Lines, near: np.ndarray, names: list[str], profiles: np.ndarray, k: int, flag: np.ndarray) -> list[pa.Array]:
    words, size = p.words, p.size
    lines = np.bincount(p.doc, minlength=p.n)
    ends = p.by_doc(p.stops)
    table = np.zeros((p.n, 10))
    np.add.at(table, p.doc, p.table)
    total = table.sum(1)
    letters = p.by_doc(p.chars)
    # a line of symbols has hardly any words; every eight of its other marks count as one
    weight = np.maximum(p.line_words, p.table[:, SYMBOL] // 8)
    prose = (near >= 0) & (near < k)
    inside = p.by_doc(weight * prose)
    allw = p.by_doc(weight)
    by = np.zeros((p.n, len(names)))
    ok = near >= 0
    np.add.at(by, (p.doc[ok], near[ok]), weight[ok])
    best = by.argmax(1)
    dist = np.divide(table, total[:, None], out=np.zeros_like(table), where=total[:, None] > 0)
    js = divergence(dist, profiles[:k]).min(1) if p.n else np.zeros(0)
    none = words == 0
    ratio = lambda a, b: pa.array(np.divide(a, b, out=np.zeros(p.n), where=b > 0), mask=b == 0)
    structure = (allw > 0) & (inside <= INSIDE * allw) & ~flag
    return [
        pa.array(words.astype(np.int64)), ratio(size, words), ratio(table[:, SYMBOL] + table[:, SEPARATOR], letters), ratio(ends, lines), ratio(table[:, FUNCTION], words),
        pa.array(lines.astype(np.int64)), ratio(inside, allw), pa.array(js, mask=total == 0), pa.array([names[i] if t else None for i, t in zip(best, ~none | (allw > 0))], pa.string()),
        pa.array(flag), pa.array(structure),
    ]
