"""Template residue and error pages: a positive-unlabelled naive Bayes model of lines, learned by EM.

Trusted positives are the lines of records that show unmistakable marks (placeholders, status codes, demands for
scripts, stand-in text) and no running text; every other line is unlabelled and starts as probably negative. EM then
spreads to the wording that goes along with the marks. Records are judged by the share of their own words (host
furniture left aside) that stand in positive lines.

Bounds: the model is fitted on at most SAMPLE_ROWS rows of the whole table and SAMPLE_ROWS of its short rows, each of
at most SAMPLE_CHARS characters, and holds at most VOCABULARY words; all rows are scored with it. Null and blank contents are never
positive. Rows that repeat, and ties in created_at (which are copies), give one row a url."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.bounded import in_bitmap
from sievelight.llm.pagelines import read

SAMPLE_ROWS = 2500
#: Longest content that is drawn; 2 * SAMPLE_ROWS * SAMPLE_CHARS bounds what reaches the driver.
SAMPLE_CHARS = 40_000
SHORT = 700
VOCABULARY = 60_000
ROUNDS = 6
#: Own words up to which a record counts as short.
FEW = 40
#: Features from which a line without a mark is running text.
RUNNING = 25
#: Lines or records in which a feature must occur.
LEAST = 3

# Marks of records that can be trusted to be errors, placeholders or demands for scripts.
MARKS = re.compile(
    r"""\{\{.*?\}\}|\$\{[^}]*\}|\{[\w.]+\}|\[\[[^\]]*\]\]|%[A-Z_]{3,}%|<%.*?%>|__[A-Z_]{3,}__|\[(?:ADD|INSERT|YOUR|COMPANY|CITY|NAME|TITLE)[A-Z ]*\]
    |\[object\ Object\]|\b(?:undefined|NaN|null|TODO|XXX)\b|\b(?:lorem|ipsum|asdf|qwer|blah)\b|^(?:test\ test|abc\ abc|xxx\ xxxx?)\b
    |^(?:(?:error|fehler|erreur|http)\ )?[45]\d\d(?:\ [A-Z][a-z]+){0,4}$|\b(?:not\ found|access\ denied|too\ many\ requests|internal\ server\ error|bad\ gateway|gateway\ timed|timed\ out|unavailable|under\ construction|coming\ soon|is\ parked|maintenance)\b
    |(?:enable|activate|disabled|turn\ on|support|require|need)\D{0,20}\b(?:javascript|scripts?)\b|\bjavascript\ is\ disabled|\bverify\ that\ you\ are\ human|\bchecking\ your\ browser
    |\b(?:nicht\ gefunden|zugriff\ verweigert|serverfehler|zu\ viele\ anfragen|wartungsarbeiten|im\ aufbau|aktivieren\ sie\ javascript|ohne\ skripte|kein\ inhalt\ vorhanden|beispieltext|platzhalter)\b
    |\b(?:no\ encontrad[ao]|acceso\ denegado|error\ interno|demasiadas\ (?:peticiones|solicitudes)|en\ construcción|en\ mantenimiento|active\ javascript|sin\ scripts|su\ texto\ aquí|de\ ejemplo\ para)\b
    |\b(?:introuvable|accès\ refusé|erreur\ interne|trop\ de\ requêtes|en\ construction|en\ maintenance|activez?\ javascript|sans\ scripts|votre\ texte\ ici|texte\ d'exemple)\b
    |\b(?:dummy\ (?:text|paragraph)|sample\ text|your\ headline\ here|text\ text\ text|placeholder)\b""",
    re.I | re.X,
)
#: A line has one of MARKS only if it has an opening character of slots, or a run without white space that is a status code or has one of these: of each mark the rarest word.
CUES = tuple(
    """undefined nan null todo xxx lorem ipsum asdf qwer blah test abc found denied requests server gateway timed unavailable construction coming parked maintenance
    script verify browser gefunden verweigert anfragen wartungsarbeiten aufbau skripte vorhanden platzhalter encontrad denegado interno demasiadas construcción mantenimiento aquí ejemplo
    introuvable refusé interne requêtes dummy text headline placeholder""".split()
) + ("ſ", "ı", "i\u0307")  # the last match s and i where case is ignored
_SLOT = re.compile(r"\{\{\s*[\w.]+\s*\}\}|\$\{[\w.]+\}|\{[\w.]+\}|\[\[[\w. ]+\]\]|%[A-Za-z_.]{3,}%|<%=?\s*[\w.]+\s*%>|__[A-Za-z_.]{3,}__|<[A-Z_.]{3,}>|\[[A-Z][A-Z _]{2,}\]|\[object Object\]")
_TOKEN = re.compile(r"\x00|/[\w./-]+|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{8}\b|\d[\d.,]*|[^\W\d_]+")
_MESS = re.compile(r"[a-z][A-Z]|\d[A-Za-z]|[A-Za-z]\d")
_LETTERS = re.compile(r"[^\W\d_]+")
_STATUS = re.compile(r"[45]\d\d")


def token(x: str) -> tuple[tuple[str, ...], int, int]:
    """(features, changes between letters and digits or of case, letters) of a run without white space."""
    word = x.strip(".,;:!?\"'()")
    if word.isascii() and word.isalpha() and (word.islower() or word.istitle()):  # what the patterns below find in it
        return (word.lower(),), 0, len(word)
    out = []
    for p in _TOKEN.findall(x):
        c = p[0]
        if c == "\x00":
            out.append("#S")
        elif c == "/":
            out.append("/P")
        elif c.isdigit():
            out.append("#H" if len(p) == 8 and p.isalnum() and not p.isdigit() else "#4" if _STATUS.fullmatch(p) else "#")
        else:
            out.append(p if p.islower() or p in ("NaN", "XXX", "TODO") else p.lower())
    return tuple(out), len(_MESS.findall(x)), sum(map(len, _LETTERS.findall(x)))


_token = lru_cache(maxsize=1 << 17)(token)


def slotted(t: str) -> tuple[str, int]:
    """The line with each template slot as a run of its own, and their number."""
    return _SLOT.subn(" \x00 ", t) if opening(t) else (t, 0)


def cues(runs: list[str]) -> list[bool]:
    """Which of the runs may belong to one of MARKS."""
    low = [x.lower() for x in runs]
    text, ends = "\n".join(low), np.cumsum([len(x) + 1 for x in low])
    out = np.array([len(x) == 3 and x[0] in "45" and x.isdecimal() for x in runs], bool)
    for c in CUES:
        at, p = [], -1
        while (p := text.find(c, p + 1)) >= 0:
            at.append(p)
        out[np.searchsorted(ends, at, side="right")] = True
    return out.tolist()


def opening(t: str) -> bool:
    """Whether the line has a character with which a slot may begin."""
    return "{" in t or "[" in t or "<" in t or "%" in t or "_" in t


def features(t: str) -> list[str]:
    """Words in lower case; numbers, paths, identifiers and template slots each under one name.

    A line that is mostly symbols or random characters has the one feature '~'. Lines of any length are read alike."""
    t, slots = slotted(t)
    runs = t.split()
    if not runs:
        return []
    seen = list(map(_token if max(map(len, runs)) <= 64 else token, runs))  # words repeat, long runs don't
    out = list(chain.from_iterable([x[0] for x in seen]))
    mess, letters = sum([x[1] for x in seen]), sum([x[2] for x in seen])
    if not slots:
        if not out:
            return ["~"]
        if (mess > 0.3 * len(out) + 1 and "/P" not in out and "#H" not in out) or letters < 0.35 * len(t) - 4:
            return ["~"] * len(out)
    return out


def keys(f: list[str], short: bool, marked: bool = False) -> set[str]:
    """What the model weighs: distinct words and neighbours, whether the record has few words of its own, and whether
    the line has a mark."""
    k = set(f)
    k.update([a + " " + b for a, b in pairwise(f)])
    if len(f) <= 3:
        k.add("=" + " ".join(f))
    if short:
        k.add("=short")
    if marked:
        k.add("=mark")
    return k


def marked(t: str, total: int) -> bool:
    """Whether a line of a record of ``total`` words counts as marked: longer records mention such things in passing."""
    return total <= FEW and bool(MARKS.search(t))


def trusted(lines: list[list[str]], marks: list[bool], total: int) -> bool:
    """Whether a record of these lines (features) is surely positive: enough of them have marks and none is running text."""
    long = any(len(f) >= RUNNING and not m for f, m in zip(lines, marks))
    return not long and sum(marks) / len(lines) >= (0.34 if total <= 3 * FEW else 0.75)


@dataclass
class LineModel:
    """Log odds of a line: prior plus the weights of its distinct features; broadcast, at most VOCABULARY entries."""

    weight: dict[str, float] = field(default_factory=dict)
    prior: float = -6.0
    unseen: float = 0.0

    def odds(self, f: list[str], short: bool, marked: bool = False) -> float:
        w = self.weight
        if "~" in f:
            return -9.0
        return self.prior + math.fsum(map(w.get, keys(f, short, marked), repeat(0.0)))


def fit(pages: Iterable[tuple[str, str]]) -> LineModel:
    """Fits the model on (url, content) rows; any order of the rows gives the same model.

    A feature counts where it occurs in LEAST distinct lines or records at least, and an unlabelled line may become
    positive only together with the greater part of its record."""
    index: dict[tuple[str, ...], int] = {}
    records: list[tuple[bool, list[int], list[int]]] = []
    for url, content in sorted(pages):
        own = [(t, features(t)) for _, t, v, _, _ in read(content, url) if not v]
        if not own:
            continue
        total = sum(words(t) for t, _ in own)
        marks = [f[:1] != ["~"] and bool(MARKS.search(t)) for t, f in own]
        at = []
        for (_, f), m in zip(own, marks):
            k = ("~",) if "~" in f else tuple(sorted(keys(f, total <= FEW, m and total <= FEW)))
            at.append(index.setdefault(k, len(index)))
        records.append((trusted([f for _, f in own], marks, total), at, [words(t) for t, _ in own]))
    lines = list(index)
    in_lines = Counter(x for k in lines for x in k)
    in_records: Counter = Counter()
    for _, at, _ in records:
        in_records.update({x for i in at for x in lines[i]})
    kept = sorted((x for x, n in in_records.items() if n >= LEAST or in_lines[x] >= LEAST), key=lambda x: (-in_records[x], x))[:VOCABULARY]
    vocab = {x: i for i, x in enumerate(kept)}
    model = LineModel()
    if not vocab or not any(t for t, _, _ in records) or all(t for t, _, _ in records):
        return model
    cols = [[vocab[x] for x in k if x in vocab] for k in lines]
    row = np.repeat(np.arange(len(lines)), [len(c) for c in cols])
    col = np.array([i for c in cols for i in c], np.int64)
    rec = np.repeat(np.arange(len(records)), [len(at) for _, at, _ in records])
    line = np.array([i for _, at, _ in records for i in at], np.int64)
    size = np.array([n for _, _, w in records for n in w], float)
    sure = np.array([t for t, _, _ in records])
    messy = np.array([k == ("~",) for k in lines])
    s = np.where(sure[rec], 1.0, -1.0)
    for turn in range(ROUNDS):
        # a record is positive if trusted or if most of its words stand in positive lines
        pos = np.bincount(rec, weights=size * (s > 0), minlength=len(records)) >= 0.6 * np.bincount(rec, weights=size, minlength=len(records))
        q = np.where(sure[rec], 1.0, np.where(pos[rec] & (turn > 0), 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0))
        # a line on a thousand records is one piece of evidence, more often seen
        wp = np.log1p(np.bincount(line, weights=q, minlength=len(lines)))
        wn = np.log1p(np.bincount(line, weights=1 - q, minlength=len(lines)))
        cp = np.bincount(col, weights=wp[row], minlength=len(vocab))
        cn = np.bincount(col, weights=wn[row], minlength=len(vocab))
        w = np.clip(np.log((cp + 0.1) / (wp.sum() + 1)) - np.log((cn + 0.1) / (wn.sum() + 1)), -2.5, 5)
        prior = math.log(wp.sum() + 1) - math.log(wn.sum() + 1)
        of_line = prior + np.bincount(row, weights=w[col], minlength=len(lines))
        s = np.where(messy, -9.0, of_line)[line]
    model.weight = {x: float(w[i]) for x, i in vocab.items()}
    model.prior = float(prior)
    return model


@dataclass
class Sample:
    """Rows (url, content) drawn from the whole table and from its short rows, one a url, at most the bound of each."""

    general: list[tuple[str, str]]
    short: list[tuple[str, str]]

    def both(self) -> list[tuple[str, str]]:
        return sorted({**dict(self.short), **dict(self.general)}.items())


def sample(pages: DataFrame, bound: int = SAMPLE_ROWS) -> Sample:
    """At most ``bound`` rows of all and as many of the short ones, of SAMPLE_CHARS characters at most, by a hash of url
    and created_at; everything where there are fewer.

    Repeated rows count once before the draw is cut, and the cut is by the hash, so that neither the order of the rows
    nor a url with many of them changes what is drawn; of the versions of a url drawn the newest is kept."""
    some = pages.select("url", "content", F.coalesce("created_at", F.lit(-1)).alias("at")).where(F.col("content").isNotNull() & F.col("url").isNotNull())
    small = F.length("content") < SHORT
    n, s = pages.select(F.count("content"), F.count(F.when(small, 1))).first()
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "url", "at"), F.lit(1_000_003)) / 1_000_003.0
    wide = 1.15 * bound  # of which the lowest are kept
    drawn = some.where(F.length("content") <= SAMPLE_CHARS).select("*", part(0).alias("g"), F.when(small, part(1)).alias("s")).where((F.col("g") < wide / max(n, 1)) | (F.col("s") < wide / max(s, 1)))
    rows = drawn.dropDuplicates(["url", "at"]).orderBy(F.least("g", "s"), "url", "at").limit(3 * bound).collect()

    def newest(lowest: list) -> list[tuple[str, str]]:
        return list({r.url: r.content for r in sorted(lowest[:bound], key=lambda r: r["at"])}.items())

    general = sorted((r for r in rows if r.g < wide / max(n, 1)), key=lambda r: (r.g, r.url))
    short = sorted((r for r in rows if r.s is not None and r.s < wide / max(s, 1)), key=lambda r: (r.s, r.url))
    return Sample(newest(general), newest(short))


def train(pages: DataFrame) -> LineModel:
    return fit(sample(pages).both())


def words(t: str) -> int:
    """What a line weighs in its record: its words between white space."""
    return t.count(" ") + 1


def judge(lines: list[str], model: LineModel) -> tuple[bool, int, int, float]:
    """(residue?, words in positive lines, all words, highest log odds) of a record's own lines (stripped, not blank).

    A record is residue if half of its words stand in positive lines, or if it is short, has a clearly positive line
    and no line that clearly isn't."""
    total = sum(map(words, lines))
    pos, best, worst = 0, -99.0, 99.0
    for t in lines:
        o = model.odds(features(t), total <= FEW, marked(t, total))
        best, worst = max(best, o), min(worst, o)
        if o > 0:
            pos += words(t)
    return pos > 0 and (pos >= 0.5 * total or (total <= FEW and best > 4 and worst > -6)), pos, total, best


def flagged(lines: list[str], model: LineModel) -> bool:
    """The verdict of judge alone; it stops where the lines that are not positive hold more than half of the words."""
    total = left = sum(map(words, lines))
    if total <= FEW:
        return judge(lines, model)[0]
    pos = 0
    for t in sorted(lines, key=len, reverse=True):
        left -= words(t)
        if model.odds(features(t), False) > 0:
            pos += words(t)
        if pos + left < 0.5 * total:
            return False
    return pos > 0 and pos >= 0.5 * total


def own_lines(content: str, url: str | None) -> list[str]:
    return [t for _, t, v, _, _ in read(content, url) if not v]


def score_pages(pages: DataFrame, model: LineModel | None = None, among: Broadcast | None = None) -> DataFrame:
    """One row per url, judged on its latest row: url, residue, positive_words, own_words, best_odds.

    among: a bitmap of xxhash64(url) (bounded.member_bitmap); only urls in it are judged and returned.

    NULL and blank contents have residue false and no words; a null url is dropped."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if among is not None:
                b = b.filter(pa.array(in_bitmap(among.value, b.column(3).to_numpy(zero_copy_only=False).view(np.uint64))))
            out = []
            for u, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append(judge(own_lines(c, u) if c else [], m))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], names=["url", "created_at", "residue", "positive_words", "own_words", "best_odds"])

    rows = pages.select("url", "content", "created_at", *([F.xxhash64("url").alias("h")] if among is not None else [])).where(F.col("url").isNotNull()).mapInArrow(run, "url string, created_at long, residue boolean, positive_words int, own_words int, best_odds double")
    return latest(rows)


def latest(rows: DataFrame) -> DataFrame:
    """The row of greatest created_at of each url (null counts as oldest), pre-aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in ("url", "created_at")]
    best = F.max(F.struct(F.coalesce("created_at", F.lit(-1)).alias("created_at"), *rest)).alias("r")
    return rows.groupBy("url").agg(best).select("url", *[F.col(f"r.{c}").alias(c) for c in rest])
