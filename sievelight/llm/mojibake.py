"""Text decoded with a wrong encoding: found and restored by a hidden Markov model over characters.

States: one clean state, one for each (true encoding, wrong encoding) pair, twice-decoded text included, and one for
letters lost to replacement characters. In the clean state a character is as likely as its kind is in its context
(letters of the languages in the right case, letters of others, signs next to a space or to a letter, controls). In a
pair's state units are the strings that the pair makes of a character, as likely as the character they stand for.
Changing the state costs. The Viterbi path labels the characters of each suspicious word, and each labelled span gets
the inverse of its state's transform. Words that need no look (plain letters in proper case, signs where they belong)
are passed by a pattern; verdicts of words are kept, as words repeat.

NULL and empty texts are clean; texts of any length take time in proportion to it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Letters beyond ASCII of the languages of the collection, signs in proper use, and encoding pairs.
LATIN = "àáâãäçèéêëìíîïñòóôõöùúûüßœąćęłńśźż"
RARE = "åæøýÿđðþčďěňřšťůžăâîșțşţğıőűŕľĺšųūīāēōėįøŷŵ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
SIGNS = "“”‘’„‚«»‹›–—…¿¡£€½¼¾°§©®™•·№♪♫×÷ºª²³¹± "
UPPER_ONLY_LOWER = "ß"
KANA = "".join(chr(c) for c in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB), 0x30FC)) + "。、「」・!?〜"
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp1254"), ("utf-8", "cp1257"),
    ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp852"), ("utf-8", "cp866"), ("utf-8", "iso8859-2"),
    ("utf-8", "iso8859-15"), ("utf-8", "koi8-r"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp1251"),
    ("cp1252", "koi8-r"), ("cp1252", "cp852"), ("cp1252", "cp1253"), ("cp1252", "cp866"),
    ("cp1250", "cp1252"), ("cp1250", "cp437"), ("cp1250", "cp850"), ("cp1250", "mac_roman"), ("cp1250", "cp1251"), ("cp1250", "cp852"),
    ("iso8859-2", "cp1252"), ("iso8859-2", "cp1250"), ("cp852", "cp1252"), ("cp852", "cp1250"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("cp1251", "mac_roman"), ("cp1251", "cp437"),
    ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("iso8859-5", "cp1252"), ("mac_cyrillic", "cp1251"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("shift_jis", "cp1252"), ("shift_jis", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"),
)
TWICE = ("cp1252", "latin-1", "cp1250", "mac_roman")
LOST = "�"

ENTER, LEAVE = -6.0, -2.0
#: Log2 odds of the best path over the clean one from which a word is affected.
LEAST = 1.0
CACHE = 1 << 17
#: Characters of a run without spaces that are read at once, and of these the last that are read again with the next.
WINDOW, EDGE = 1024, 64


def _decode(raw: bytes, name: str) -> str:
    """Decoding that keeps undefined bytes as controls, as browsers and editors do."""
    if name in ("utf-8", "shift_jis", "euc_jp"):
        return raw.decode(name)
    return "".join([_byte(b, name) for b in raw])


@lru_cache(maxsize=None)
def _byte(b: int, name: str) -> str:
    try:
        return bytes([b]).decode(name)
    except UnicodeDecodeError:
        return chr(b)


def _kind_cost(c: str) -> float:
    """Log2 probability of a character beyond ASCII whatever its context."""
    low = c.lower()
    if low in LATIN or low in CYRILLIC:
        return -5.0
    if c in "“”‘’–—…¿¡♪":
        return -6.5
    if c in KANA or "！" <= c <= "～":
        return -6.5
    if "一" <= c <= "鿿":
        return -8.5
    if low in RARE or c in SIGNS:
        return -9.5
    o = ord(c)
    if 0x80 <= o < 0xA0:
        return -22.0
    if 0x1F000 <= o < 0x1FB00 or o in (0x200D, 0x200B, 0xFE0F, 0xAD, 0xFEFF) or 0x300 <= o < 0x370:
        return -9.0
    return -16.0


def clean_cost(c: str, before: str, after: str) -> float:
    """Log2 probability in the clean state between its neighbours ('' at the ends of a word)."""
    s = _kind_cost(c)
    if c == "\u00a0":
        return -4.0
    if c == "°" and before.isdigit():
        return -5.0
    if c in SIGNS and c not in "’‘–—…“”♪":
        if (before.isalpha() and not (c in "»”…!™®" and not after.isalpha())) or (after.isalpha() and c not in "¿¡«„“‘©№"):
            s -= 7
        return s
    if c.isalpha():
        near = before + after
        if c.isupper() and (before.islower() or (after.islower() and before.isupper())):
            s -= 8
        elif c.islower() and before.isupper() and after.isupper() and c != "ß":
            s -= 6
        latin = c.lower() in LATIN or c.lower() in RARE
        if (latin and any("Ѐ" <= x < "Ԁ" for x in near)) or ("Ѐ" <= c < "Ԁ" and any(x.isalpha() and x < "ɐ" for x in near)):
            s -= 9
    return s


@lru_cache(maxsize=1)
def states() -> tuple[list[str], list[dict[str, tuple[str, float]]], dict[str, list[int]], list[int]]:
    """Names, units (observed string -> character, log2 probability), states by first character, longest unit."""
    letters = LATIN + LATIN.upper().replace("SS", "") + SIGNS + CYRILLIC + CYRILLIC.upper()
    japan = KANA + "".join(chr(c) for c in range(0x4E00, 0x9FA6))
    names, units = [], []

    def add(name, chars, forward):
        table = {}
        for c in dict.fromkeys(chars):
            try:
                x = forward(c)
            except (UnicodeError, LookupError):
                continue
            if x != c and x and not x.isascii() and LOST not in x:
                cost = _kind_cost(c)
                if x not in table or table[x][1] < cost:
                    table[x] = (c, cost)
        if table:
            names.append(name)
            units.append(table)

    for true, wrong in PAIRS:
        chars = letters + (japan if true in ("shift_jis", "euc_jp") or (true == "utf-8" and wrong in ("cp1252", "latin-1", "mac_roman")) else "")
        add(f"{true}>{wrong}", chars, lambda c, t=true, w=wrong: _decode(c.encode(t), w))
    for w in TWICE:
        add(f"utf-8>{w} twice", letters, lambda c, w=w: _decode(_decode(c.encode("utf-8"), w).encode("utf-8"), w))
        add(f"utf-8>{w} thrice", letters, lambda c, w=w: _decode(_decode(_decode(c.encode("utf-8"), w).encode("utf-8"), w).encode("utf-8"), w))
    names.append("lost")
    units.append({LOST: (LOST, -5.0)})
    first: dict[str, list[int]] = {}
    for i, t in enumerate(units):
        for x in t:
            at = first.setdefault(x[0], [])
            if not at or at[-1] != i:
                at.append(i)
    return names, units, first, [max(map(len, t)) for t in units]


def viterbi(word: str, only: str = "", begin: int | None = None) -> tuple[float, list[tuple[int, int, int]]]:
    """(log2 odds over all clean, spans (start, end, state)) of the best path over all states, or over clean and ``only``.

    begin: the state that a text was in before the word, which costs nothing to stay in."""
    names, units, first, longest = states()
    n = len(word)
    clean = [0.0] * n
    use: set[int] = set()
    for i, c in enumerate(word):
        if not c.isascii():
            clean[i] = clean_cost(c, word[i - 1] if i else "", word[i + 1] if i + 1 < n else "")
            use.update(first.get(c, ()))
    # states: 0 clean, then the pairs that have a unit beginning with a character of the word
    own = sorted(u for u in use | ({begin} if begin is not None else set()) if not only or names[u] == only)
    inf = -1e9
    best = [[inf] * (len(own) + 1) for _ in range(n + 1)]
    back: list[list[tuple[int, int] | None]] = [[None] * (len(own) + 1) for _ in range(n + 1)]
    best[0] = [0.0] + [0.0 if u == begin else ENTER for u in own]
    for i in range(n):
        row = best[i]
        # change of state between characters
        for k in range(len(own) + 1):
            if k == 0:
                j = max(range(len(own) + 1), key=lambda x: row[x] + (0 if x == 0 else LEAVE))
                if row[j] + (LEAVE if j else 0) > row[0]:
                    row[0], back[i][0] = row[j] + LEAVE, (i, j)
            elif row[0] + ENTER > row[k]:
                row[k], back[i][k] = row[0] + ENTER, (i, 0)
        c = word[i]
        if row[0] + clean[i] > best[i + 1][0]:
            best[i + 1][0], back[i + 1][0] = row[0] + clean[i], (i, 0)
        for k, u in enumerate(own, 1):
            v = row[k]
            if v <= inf:
                continue
            if c.isascii():
                if v > best[i + 1][k]:
                    best[i + 1][k], back[i + 1][k] = v, (i, k)
                continue
            table = units[u]
            for m in range(1, min(longest[u], n - i) + 1):
                x = table.get(word[i : i + m])
                if x is not None:
                    cost = x[1]
                    d = x[0]
                    if d.isalpha():
                        p, q = (word[i - 1] if i else ""), (word[i + m] if i + m < n else "")
                        if d.isupper() and p.isascii() and p.islower():
                            cost -= 6
                        elif d.islower() and p.isupper() and q.isupper() and p.isascii() and q.isascii():
                            cost -= 5
                        if d >= "\u3000" and ((p.isascii() and p.isalpha()) or (q.isascii() and q.isalpha())):
                            cost -= 10
                        if "Ѐ" <= d < "Ԁ" and ((p.isascii() and p.isalpha()) or (q.isascii() and q.isalpha())):
                            cost -= 8
                    if v + cost > best[i + m][k]:
                        best[i + m][k], back[i + m][k] = v + cost, (i, k)
    end = max(range(len(own) + 1), key=lambda k: best[n][k])
    odds = best[n][end] - sum(clean)
    spans, i, k = [], n, end
    while i > 0 or back[i][k]:
        b = back[i][k]
        if b is None:
            break
        j, kk = b
        if j < i and k > 0:
            spans.append((j, i, own[k - 1]))
        i, k = j, kk
        if i == 0 and back[i][k] is None:
            break
    return odds, spans[::-1]


_A = "a-zàáâãäçèéêëìíîïñòóôõöùúûüßœąćęłńśźż"
_B = "A-ZÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜŒĄĆĘŁŃŚŹŻ"
_PART = rf"(?:[{_B}]?[{_A}]+|[{_B}]+|[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+)"
_OPEN = r"[\"'(\[{<>/\-–—*♪♫#¿¡„“‘«…﻿​ ]*"
_SAFE = re.compile(
    rf"{_OPEN}(?:[£€$]?\d[\d.,:%½¼¾°-]*|[½¼¾]|(?:{_PART}(?:['’\-–—/.&]{_PART})*))?[\"')\]}}>/.,;:!?»”’…\-–—*♪♫#™® ]*(?:</?\w+>?)*"
)
_JAPAN = re.compile(r"[\x21-\x7e　-ヿ一-鿿！-～♪♫…–—“”‘’﻿]+")
_TAGS = re.compile(r"<[^>\s]*>|\{[^}\s]*\}|<\w+|\w+=\"[^\"\s]*\">?")
_WIDE = re.compile(r"[^\s\x00-\x1f]*[^\x00-\x7f][^\s]*")


def asked(t: str) -> bool:
    """Whether letters were lost to question marks: inside a word, before a comma, for a word's first letter, or as
    runs that stand for whole words. A question mark that ends a sentence, with or without a space, is none."""
    i = t.find("?")
    n = len(t)
    while i >= 0:
        p = t[i - 1] if i else "\n"
        q = t[i + 1] if i + 1 < n else "\n"
        if p.isalpha():
            if ("a" <= q <= "z") or (q in ",;:" and i + 2 < n and t[i + 2].isspace()):
                return True
        elif p in " \n-('\"" and "a" <= q <= "z" and i + 2 < n and t[i + 2].isalpha() and p != "'":
            return True
        elif p == " " and q == " " and i >= 2 and i + 2 < n and t[i - 2].isalpha() and "a" <= t[i + 2] <= "z":
            return True
        if q == "?" and (p.isspace() or p == "?"):
            j = i
            while j < n and t[j] == "?":
                j += 1
            rest = t[j : j + 3].lstrip(" ,.!")
            if j - i >= 4 or rest[:1] == "?":
                return True
            i = j - 1
        i = t.find("?", i + 1)
    return False


def safe(word: str) -> bool:
    w = _TAGS.sub("", word)
    if w.isascii() or w.strip(".,;:!?") in ("°", "°C", "°F") or _JAPAN.fullmatch(w):
        return True
    if _SAFE.fullmatch(w):
        # many accented letters and no plain vowel: another alphabet read as Latin
        odd = sum(not c.isascii() and c.isalpha() and c < "ɐ" for c in w)
        return odd < 4 or odd < 0.6 * sum(c.isalpha() for c in w)
    return False


def _spans(w: str, only: str) -> list[tuple[int, int, int]]:
    """The labelled spans of a run without spaces. A long one is read in windows: what the model says of the last EDGE
    characters of a window is left to the next, which goes on in the state of the place where it begins."""
    out: list[tuple[int, int, int]] = []
    at, begin = 0, None
    while at < len(w):
        part = w[at : at + WINDOW]
        last = at + WINDOW >= len(w)
        odds, spans = viterbi(part, only, begin)
        if odds < LEAST:
            spans = []
        cut = len(part) if last else next((s for s, e, _ in spans if s < WINDOW - EDGE < e), WINDOW - EDGE)
        kept = [x for x in spans if x[1] <= cut]
        out += [(at + s, at + e, k) for s, e, k in kept]
        begin = kept[-1][2] if kept and kept[-1][1] == cut else None
        at += cut
    return out


class Reader:
    """Verdicts of words, kept while there are at most CACHE of them."""

    def __init__(self):
        self.known: dict[str, tuple[str, str]] = {}

    def word(self, w: str, only: str = "") -> tuple[str, str]:
        """(state or '', restored word), over the clean state and ``only`` if given; 'lost' for replacement characters."""
        key = only + "\0" + w if only else w
        v = self.known.get(key)
        if v is None:
            v = self._judge(w, only)
            if len(w) > 128:  # long runs seldom repeat
                return v
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[key] = v
        return v

    def _judge(self, w: str, only: str) -> tuple[str, str]:
        if safe(w):
            return "", w
        names, units, _, _ = states()
        out, state, at = [], "", 0
        for s, e, k in _spans(w, only):
            x = units[k].get(w[s:e])
            out.append(w[at:s] + (x[0] if x else w[s:e]))
            if x and (not state or state == "lost"):
                state = names[k]
            at = e
        return state, "".join(out) + w[at:]

    def text(self, t: str) -> tuple[list[str], str]:
        """(states found, restored text). Where a text has words of several pairs, the pair that most of them are of
        is tried on the others first: one text was seldom decoded in two wrong ways."""
        found: list[str] = []
        fixed = t
        if not t.isascii():
            states_of = {w: self.word(w)[0] for w in set(_WIDE.findall(t))}
            kinds = Counter(s for s in states_of.values() if s and s != "lost")
            if kinds:
                affected = [w for w, s in states_of.items() if s and s != "lost"]
                left = lambda k: sum(not c.isascii() and clean_cost(c, "", "") < -7 for w in affected for c in self.word(w, k)[1])
                main = min(kinds, key=lambda k: (left(k) if len(kinds) > 1 else 0, -kinds[k], k))

                def sub(m):
                    w = m.group()
                    if not states_of.get(w):
                        return w
                    s, r = self.word(w, main) if states_of[w] not in (main, "lost") else self.word(w)
                    if not s:
                        s, r = self.word(w)
                    found.append(s)
                    return r

                fixed = _WIDE.sub(sub, t)
            else:
                found += [s for s in states_of.values() if s]
        if not found and asked(t):
            found.append("lost")
        return found, fixed


@lru_cache(maxsize=1)
def _reader() -> Reader:
    """One for each worker process: words repeat from task to task."""
    return Reader()


def repairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, states, words, restored) of the affected documents only: the encoding pairs met, the number of affected
    words, and the text as far as it can be restored (lost letters stay as they are)."""
    schema = docs.select(key).schema.add("states", ArrayType(StringType())).add("words", "long").add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _reader()
        for b in batches:
            at, st, n, fixed = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                found, x = r.text(t)
                if found:
                    at.append(i)
                    st.append(sorted(set(found)))
                    n.append(len(found))
                    fixed.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(st, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(fixed, pa.string())], names=schema.names)

    return docs.select(key, text).where(F.col(text).isNotNull() & (F.col(text) != "")).mapInArrow(run, schema)
