"""Keyword-stuffed pages, bare link lists and tag pages.

A trigram model of word classes is trained on the sentence lines of all pages. The classes are each function
word, other words by form and by how often the page has used them before, words of a phrase that the page keeps
repeating, tags, and links with and without words that describe them. Prose knows hardly any of the last ones, so a
page made of them has an abnormally high perplexity, and a page of one endless pattern an abnormally low one; normal is
what the prose pages of the same language reach. Tables, plain lists and data dumps are abnormal too: a page
is spam where repeated phrases, tags or bare links bear most of its surprise. A phrase is taken for one only outside
lines of code or figures. Where there are fewer than LEAST_PAGES prose pages to learn from, every page counts as
abnormal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelight.llm import wholefit
from sievelight.llm.vector import U, mix
from sievelight.llm.pagestats import CAPITAL, FUNCTION, LINK, LOWER, NUMBER, ODD, SYMBOL, Pages
from sievelight.llm.quality import languages
from sievelight.session import materialize

#: Earlier uses of a word on the page from which it has the next class.
USES = (1, 3, 8)
#: Earlier uses of a pair of words from which both belong to a repeated phrase.
PHRASE = 3
#: Share of the page's content words from which one word is a repeated phrase by itself.
HEAVY = 0.12
#: Function words beyond this number share one class, which bounds the model at (MOST + 14) ** 3 floats.
MOST = 160
#: Quantiles of the prose pages of a language, and how far beyond them (bits a word) perplexity is still normal.
NORMAL = (0.01, 0.99)
BESIDE = 0.15
#: Steps of a bit in which the perplexity of prose pages is counted for the quantiles.
STEP = 4096
LEAST_PAGES = 20
LEAST_WORDS = 12
#: Part of the surprise, and of the words, that repeated phrases, tags and bare links must bear together.
BORNE = 0.36
HELD = 0.33
LEAST_LINKS = 6

# Classes after the function words.
NEW, NAME, MIXED, FIGURE, USED, REPEATED, TAG, BARE, TARGET, START = 0, 1, 2, 3, 4, 7, 8, 9, 10, 11
KINDS = 12


def _earlier(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the same hash came before on the same page, and how often it stands there in all."""
    o = np.lexsort((h, doc))
    d, x = doc[o], h[o]
    new = np.ones(len(o), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    before, total = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
    before[o] = np.arange(len(o)) - start
    total[o] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(o) else 0
    return before, total


@dataclass
class Symbols:
    """The classes of the words of own lines, with page and line, in reading order."""

    sym: np.ndarray
    doc: np.ndarray
    line: np.ndarray


def symbols(p: Pages, functions: int) -> Symbols:
    """functions is the number of known function words; the first MOST have a class each."""
    base = min(functions, MOST + 1)
    at = np.flatnonzero(p.word_own)
    doc, cls, line, h = p.word_doc[at], p.word_class[at], p.word_line[at], p.word_hash[at]
    word = (cls == LOWER) | (cls == CAPITAL) | (cls == ODD)
    content = word & (p.word_size[at] >= 2)
    sym = np.where(cls == CAPITAL, NAME, np.where(cls == ODD, MIXED, np.where(cls == NUMBER, FIGURE, NEW))) + base
    before, total = _earlier(doc, h)
    for i, n in enumerate(USES):
        sym[word & (before >= n)] = base + USED + i
    sym[word & p.tag[at]] = base + TAG
    # lines of code and figures repeat their keys; a mark at the beginning and the marks of tags are none of theirs
    n = len(p.line_doc)
    per_line = lambda w: np.bincount(p.word_line, weights=w, minlength=n)
    marks = p.table[:, SYMBOL] - per_line(p.hashed) - 1
    plain = (marks < 0.25 * p.line_words) & (per_line(p.word_class == NUMBER) < 0.25 * p.line_words)
    free = content & plain[line] & (sym != base + TAG)
    ci = np.flatnonzero(free)
    if len(ci) > 1:
        near = np.flatnonzero((ci[1:] - ci[:-1] == 1) & (line[ci[1:]] == line[ci[:-1]]))
        with np.errstate(over="ignore"):
            pair = mix(h[ci[near]] * U(0x9E3779B97F4A7C15) ^ mix(h[ci[near + 1]]))
        again = near[_earlier(doc[ci[near]], pair)[0] >= PHRASE]
        sym[ci[again]] = sym[ci[again + 1]] = base + REPEATED
    contents = np.bincount(doc[content], minlength=p.n)
    sym[free & (total >= HEAVY * contents[doc]) & (before >= USES[-1])] = base + REPEATED
    # a line is bare links if few words beside the addresses describe them
    links = per_line(p.word_class == LINK)
    bare = ((links >= 2) | p.line_link) & (p.line_words - links <= 4 + 3 * (links // 4)) & (p.table[:, FUNCTION] <= 1 + links // 4)
    sym[bare[line]] = base + BARE
    target = (cls == LINK) & ~bare[line]
    sym[target] = base + TARGET
    known = p.function_no[at]
    function = (known >= 0) & (cls == FUNCTION) & ~bare[line]
    sym[function] = np.minimum(known[function], MOST)
    # an address among other words is one word
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(target[1:] & target[:-1] & (line[1:] == line[:-1]))
    return Symbols(sym[keep], doc[keep], line[keep])


@dataclass
class ClassModel:
    """Log2 probabilities of the third class after two others, smoothed, and the normal range of a page's mean surprise
    (bits a word) in each language and, for pages of none, over all of them."""

    base: int
    table: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.full(1, np.inf))
    high: np.ndarray = field(default_factory=lambda: np.full(1, np.inf))

    def surprise(self, s: Symbols) -> np.ndarray:
        """Bits of each word after the two before it in its line."""
        one, two = _previous(s, self.base + START)
        return -self.table[two, one, s.sym]


def language(p: Pages, languages: list[np.ndarray]) -> np.ndarray:
    """Number of the language whose function words a page uses most; the last number for pages with hardly any."""
    of = p.word_own & (p.word_class == FUNCTION)
    hits = np.array([np.bincount(p.word_doc[of], weights=np.isin(p.word_hash[of], x), minlength=p.n) for x in languages] or [np.zeros(p.n)])
    few = hits.max(0) < np.maximum(3, 0.05 * np.bincount(p.word_doc[p.word_own], minlength=p.n))
    return np.where(few, len(languages), hits.argmax(0)) if languages else np.zeros(p.n, np.int64)


def _previous(s: Symbols, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two words before each word in its line."""
    one, two = np.full(len(s.sym), start), np.full(len(s.sym), start)
    same = s.line[1:] == s.line[:-1]
    one[1:][same] = s.sym[:-1][same]
    same = s.line[2:] == s.line[:-2]
    two[2:][same] = s.sym[:-2][same]
    return one, two


def look(p: Pages, languages: list[np.ndarray], functions: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """What measures need of a batch, and the trigrams of its sentence lines, as numbers with their counts."""
    base = min(functions, MOST + 1)
    size = base + KINDS
    s = symbols(p, functions)
    share = p.table[:, FUNCTION] / np.maximum(p.line_words, 1)
    prose = p.line_own & p.line_stops & (p.line_words >= 8) & (share >= 0.15) & (p.table[:, ODD] <= 0.1 * p.line_words) & (p.table[:, LINK] == 0)
    # pages that repeat their words are no examples of prose
    many = np.bincount(s.doc, minlength=p.n)
    used = np.bincount(s.doc, weights=s.sym >= base + USED + 2, minlength=p.n) > 0.12 * many
    one, two = _previous(s, base + START)
    ok = prose[s.line] & ~used[s.doc]
    index, count = np.unique((two[ok] * size + one[ok]) * size + s.sym[ok], return_counts=True)
    words = np.bincount(p.line_doc, weights=p.line_words * p.line_own, minlength=p.n)
    clean = (np.bincount(p.line_doc, weights=p.line_words * prose, minlength=p.n) > 0.8 * words) & ~used & (many >= LEAST_WORDS)
    lw = np.bincount(p.word_line, weights=p.word_class == LINK, minlength=len(p.line_doc))
    links = np.bincount(p.line_doc[p.line_own], weights=np.maximum(p.line_link, np.ceil(lw / 4))[p.line_own], minlength=p.n)
    first = np.ones(len(s.line), bool)
    first[1:] = s.line[1:] != s.line[:-1]
    kept = {"sym": s.sym.astype(np.uint8), "many": many.astype(np.int32), "first": first, "lang": language(p, languages).astype(np.int16), "clean": clean, "n_links": links}
    return kept, index, count


def kept_symbols(kept: dict) -> Symbols:
    return Symbols(kept["sym"].astype(np.int64), np.repeat(np.arange(len(kept["many"])), kept["many"]), np.cumsum(kept["first"]))


def train(tri: np.ndarray, base: int, languages: int) -> ClassModel:
    """The model of these trigram counts; its normal range is for normal to set."""
    size = base + KINDS
    model = ClassModel(base, np.full((size, size, size), -np.log2(size), np.float32), np.full(languages + 1, np.inf), np.full(languages + 1, np.inf))
    if tri.any():
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * size)
        p2 = (bi + 5 * p1[None, :]) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None, :, :]) / (tri.sum(2, keepdims=True) + 5)
        model.table = np.log2(p3).astype(np.float32)
    return model


def quantile(at: np.ndarray, n: np.ndarray, q: float) -> float:
    """np.quantile of values at (sorted) that occur n times."""
    last, place = np.cumsum(n) - 1, q * (n.sum() - 1)
    low, high = at[np.searchsorted(last, [np.floor(place), np.ceil(place)])]
    return low + (high - low) * (place - np.floor(place))


def normal(model: ClassModel, counted: list[tuple[int, int, int]]) -> None:
    """Sets the normal range from how many prose pages of each language have a perplexity of so many steps."""
    lang, step, n = (np.array(x, np.int64) for x in zip(*counted)) if counted else [np.zeros(0, np.int64)] * 3
    if n.sum() < LEAST_PAGES:
        return

    def bounds(of: np.ndarray) -> np.ndarray:
        at, back = np.unique(step[of], return_inverse=True)
        times = np.bincount(back, weights=n[of]).astype(np.int64)
        return np.array([quantile(at / STEP, times, q) for q in NORMAL]) + np.array([-BESIDE, BESIDE])

    for i in range(len(model.high) - 1):
        if n[lang == i].sum() >= LEAST_PAGES:
            model.low[i], model.high[i] = bounds(lang == i)
    low, high = bounds(lang >= 0)
    known = np.isfinite(model.high[:-1])
    model.low[-1], model.high[-1] = min([low, *model.low[:-1][known]]), max([high, *model.high[:-1][known]])
    model.low[:-1][~known], model.high[:-1][~known] = model.low[-1], model.high[-1]


def measures(kept: dict, model: ClassModel) -> dict[str, np.ndarray]:
    """Per page: words, bits a word, the parts of surprise borne by and of words held by each of the three kinds."""
    s, pages = kept_symbols(kept), len(kept["many"])
    bits = model.surprise(s)
    words = kept["many"].astype(np.int64)
    total = np.bincount(s.doc, weights=bits, minlength=pages)
    div = lambda a, b: np.divide(a, b, out=np.zeros(pages), where=b > 0)
    out = {"words": words, "bits": div(total, words), "lang": kept["lang"].astype(np.int32), "n_links": kept["n_links"]}
    for name, c in (("phrases", REPEATED), ("tags", TAG), ("links", BARE)):
        of = s.sym == model.base + c
        out[name] = div(np.bincount(s.doc[of], weights=bits[of], minlength=pages), total)
        out[name + "_held"] = div(np.bincount(s.doc[of], minlength=pages), words)
    return out


def decide(m: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(abnormal, spam, kind) per page; low and high are the model's normal range."""
    abnormal = (m["words"] >= LEAST_WORDS) & ((m["bits"] < low[m["lang"]]) | (m["bits"] > high[m["lang"]]))
    borne = np.array([m["phrases"], m["tags"], np.where(m["n_links"] >= LEAST_LINKS, m["links"], 0)])
    held = np.array([m["phrases_held"], m["tags_held"], m["links_held"]])
    spam = abnormal & (borne.sum(0) >= BORNE) & (held.sum(0) >= HELD)
    return abnormal, spam, np.where(spam, np.array(["keywords", "tags", "links"])[borne.argmax(0)], "")


#: What measures gives of a page.
MEASURED = ["words", "lang", "bits", "n_links", "phrases", "phrases_held", "tags", "tags_held", "links", "links_held"]
MEASURES = "words long, perplexity double, phrases double, tags double, links double, abnormal boolean, spam boolean, kind string"


def stuffed_pages(pages: DataFrame, common: DataFrame) -> DataFrame:
    """One row per url, on its latest row: the measures, whether its perplexity is abnormal, and spam with its kind.

    NULL, blank and very short contents (fewer than LEAST_WORDS own words) are never spam; null urls are dropped."""
    functions = languages(common)
    everything = np.unique(np.concatenate(list(functions.values()))) if functions else np.zeros(0, np.uint64)
    langs = [functions[k] for k in sorted(functions)]
    known = len(everything)
    base = min(known, MOST + 1)
    rows = wholefit.read(pages, everything, lambda p: look(p, langs, known))
    model = train(wholefit.counts(rows, (base + KINDS) ** 3).reshape((base + KINDS,) * 3), base, len(langs))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def measured(kept: dict, flag: np.ndarray) -> list[pa.Array]:
        m = measures(kept, shared.value)
        return [*[pa.array(m[c]) for c in MEASURED], pa.array(kept["clean"]), pa.array(np.rint(m["bits"] * STEP).astype(np.int64)), pa.array(flag)]

    once = materialize(wholefit.judged(*wholefit.fit(rows), measured, "words long, lang int, " + ", ".join(f"{c} double" for c in MEASURED[2:]) + ", clean boolean, step long, residue boolean"))
    normal(model, [tuple(r) for r in once.where("clean").groupBy("lang", "step").count().collect()])  # at most languages * STEP * 20 rows
    ranged = pages.sparkSession.sparkContext.broadcast((model.low, model.high))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = {c: b.column(c).to_numpy() for c in MEASURED}
            abnormal, spam, kind = decide(m, *ranged.value)
            spam &= ~b.column("residue").to_numpy(zero_copy_only=False)  # stand-in text repeats itself too
            cols = [*[pa.array(c) for c in (m["words"], 2 ** m["bits"], m["phrases"], m["tags"], m["links"], abnormal, spam)], pa.array([k or None for k in kind], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("url"), *cols], names=["url", *[c.split()[0] for c in MEASURES.split(", ")]])

    return once.mapInArrow(judge, "url string, " + MEASURES)
