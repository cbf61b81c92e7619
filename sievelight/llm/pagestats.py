"""Word and character classes of the pages of a whole batch, line by line, on numpy.

Words are runs of letters, digits and bytes of letters beyond ASCII; each has a class, a line, a page and a hash of its
lower-case form. Lines that are host furniture (pagelines) are marked and left aside by the measures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from sievelight.llm.vector import U, tokens
from sievelight.llm.pagelines import read

FUNCTION, LOWER, CAPITAL, ODD, NUMBER, STOP, COMMA, SYMBOL, SEPARATOR, LINK = range(10)
CLASSES = ("function word", "lower-case word", "capitalised word", "odd word", "number", "sentence mark", "comma", "symbol", "separator", "link")

_WORDS = np.zeros(256, bool)
_WORDS[48:58] = _WORDS[65:91] = _WORDS[97:123] = _WORDS[128:] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_VOWEL = np.zeros(256, np.int32)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = 1
_VOWEL[128:] = 1
_PACKED = _DIGIT.astype(np.int64) + (_UPPER.astype(np.int64) << 21) + (_VOWEL.astype(np.int64) << 42)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_OTHER = np.full(256, -1, np.int8)
for _c in ".!?":
    _OTHER[ord(_c)] = STOP
for _c in ",;:":
    _OTHER[ord(_c)] = COMMA
for _c in "{}[]<>=+*&^%$@~\\_\"#()":
    _OTHER[ord(_c)] = SYMBOL
for _c in "|\t/":
    _OTHER[ord(_c)] = SEPARATOR


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones: a page's bytes take some forty bytes of working memory each."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class Pages:
    """The words of a batch of pages.

    line_doc, line_own: page of each line, and whether the line is the page's own. word_*: by word."""

    def __init__(self, contents: list[str | None], urls: list[str | None], functions: np.ndarray):
        texts = [(c or "").encode("utf-8", "replace") for c in contents]
        self.n = len(texts)
        own: list[bool] = []
        bodies: list[int] = []
        lead = []
        self.own_text: list[list[str]] = []
        for c, u in zip(contents, urls):
            k = (c or "").count("\n") + 1
            mark = [False] * k
            self.own_text.append([])
            for no, t, v, form, _ in read(c or "", u):
                if not v:
                    mark[no] = True
                    self.own_text[-1].append(t)
                    if form in ("x", "l"):
                        lead.append(len(own) + no)
            own += mark
            bodies.append(k)
        self.line_own = np.array(own, bool)
        self.line_doc = np.repeat(np.arange(self.n), bodies)
        self.line_link = np.zeros(len(own), bool)
        self.line_link[lead] = True
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        line_of = np.cumsum(buf == 10) - (buf == 10)
        fold = _FOLD[buf].tobytes()
        h, _, s, e = tokens([fold[:-1]], _WORDS)
        size = e - s
        packed = np.concatenate(([0], np.cumsum(_PACKED[buf])))  # three counts at once, 21 bits each
        packed = packed[e] - packed[s]
        digits, upper, vowels = packed & 0x1FFFFF, (packed >> 21) & 0x1FFFFF, packed >> 42
        first_upper = _UPPER[buf[s]] == 1
        inner = upper - first_upper
        cls = np.full(len(s), LOWER, np.int8)
        cls[first_upper & ((upper < size) | (size == 1))] = CAPITAL  # words all in capitals count as lower-case ones
        # tags: #word, wordName and word12; a first capital needs a longer word, as names like McLeod have two
        self.hashed = (buf[np.maximum(s - 1, 0)] == 35) & (s > 0)
        glued = (inner == 1) & (digits == 0) & (size >= np.where(first_upper, 7, 5)) & (_UPPER[buf[np.minimum(s + 2, e - 1)]] == 0)
        self.tag = self.hashed | glued | ((digits > 0) & (digits <= 3) & (inner == 0) & (size - digits >= 3) & (_DIGIT[buf[e - 1]] == 1))
        odd = ((inner > 0) & (upper < size)) | ((digits > 0) & (digits < size)) | ((vowels == 0) & (size >= 4)) | (size > 24)
        cls[odd] = ODD
        cls[digits == size] = NUMBER
        known = np.searchsorted(functions, h)
        known[known == len(functions)] = 0
        self.is_function = (functions[known] == h) if len(functions) else np.zeros(len(h), bool)
        cls[self.is_function] = FUNCTION
        self.function_no = np.where(self.is_function, known, -1)
        self.word_hash, self.word_class, self.word_line, self.word_size = h, cls, line_of[s], size
        self.word_doc, self.word_own = self.line_doc[self.word_line], self.line_own[self.word_line]
        # addresses: the words of http..., www.... and link targets count as links
        link = np.zeros(len(s), bool)
        for mark in (b"http", b"www."):
            p = -1
            raw = buf.tobytes()
            while (p := raw.find(mark, p + 1)) >= 0:
                q = p
                while q < len(raw) and raw[q] > 32 and raw[q] != 41:
                    q += 1
                link[np.searchsorted(s, p) : np.searchsorted(s, q)] = True
                p = q
        self.word_class = np.where(link, LINK, cls).astype(np.int8)
        other = _OTHER[buf]
        marks = np.flatnonzero(other >= 0)
        n = len(self.line_doc)
        self.table = (
            np.bincount(self.word_line * 10 + self.word_class, minlength=10 * n) + np.bincount(line_of[marks] * 10 + other[marks], minlength=10 * n)
        ).reshape(n, 10)
        self.line_words = np.bincount(self.word_line, minlength=n)
        self.line_chars = np.bincount(line_of, weights=(buf & 0xC0) != 0x80, minlength=n) - 1
        ends = np.flatnonzero(buf == 10)
        last = np.maximum.reduceat(np.where(buf > 32, np.arange(len(buf)), -1), np.concatenate(([0], ends[:-1] + 1)))
        self.line_stops = np.where(last >= 0, other[last] == STOP, False)
        self.line_blank = last < 0

    def by_doc(self, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=self.n)


def function_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of the function words, as Pages finds them."""
    w = sorted({x.strip() for x in words if x and x.strip()})
    h = [tokens([_FOLD[np.frombuffer(x.encode(), np.uint8)].tobytes()], _WORDS)[0] for x in w]
    one = [x[0] for x in h if len(x) == 1]
    return np.unique(np.array(one, U))
