"""Splitting oversized texts at natural boundaries.

Word offsets are prefix sums of word lengths; paragraph, line, sentence and word ends form sorted arrays. A piece ends
at the last paragraph end under the limit, else line, else sentence end that leaves the piece at least half full, else at
the last of these ends that goes beyond the overlap, else between words, else hard at the limit; the next piece steps back by the overlap to a word border. Each
step is a binary search, so a text costs its length plus a logarithm for each piece. Offsets are code points; the
pieces cover the text without gaps, and piece_no counts from 0. Null and empty texts have no pieces; texts within the
limit are one piece."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.residue import latest

LIMIT = 1200
OVERLAP = 120

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”)\]]*\s+|[。!?]+\s*")
_SPACE = re.compile(r"\s+")
_NATURAL = re.compile(r"\n|[.!?](?=\s)")


def boundaries(t: str) -> list[tuple[str, list[int]]]:
    """Sorted offsets after each paragraph, line, sentence and word (with the white space that follows)."""
    return [(n, [m.end() for m in p.finditer(t)]) for n, p in (("paragraph", _PARAGRAPH), ("line", _LINE), ("sentence", _SENTENCE), ("word", _SPACE))]


def strict_ends(t: str) -> list[tuple[str, list[int]]]:
    """As boundaries, for the natural ends alone that a stretch must not have (line feeds, and . ! ? before white space),
    each right after its mark."""
    return [("natural", [m.end() for m in _NATURAL.finditer(t)]), ("word", [m.end() for m in _SPACE.finditer(t)])]


def longest_stretch(t: str, ends: list[int] | None = None) -> int:
    """Most characters between two natural ends (the marks not counted); ends: the sorted offsets after the marks."""
    ends = [m.end() for m in _NATURAL.finditer(t)] if ends is None else ends
    return max(b - a - 1 for a, b in zip([0, *ends], [*ends, len(t) + 1]))


def pieces(t: str, limit: int = LIMIT, overlap: int = OVERLAP, ends: list[tuple[str, list[int]]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of each piece; the last has kind 'end', a cut inside a word 'hard'. ends: the sorted
    boundaries, in order of preference, words last (boundaries(t) by default)."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    if not t:
        return []
    if len(t) <= limit:
        return [(0, len(t), "end")]
    ends = boundaries(t) if ends is None else ends
    words = ends[-1][1]
    out, start = [], 0
    while len(t) - start > limit:
        cut, kind = start + limit, "hard"
        under = [(at[i], name) for name, at in ends if (i := bisect_right(at, start + limit) - 1) >= 0 and at[i] > start + overlap]
        natural = [x for x in under if x[1] != "word"]
        if natural:
            cut, kind = next((x for x in natural if x[0] > start + limit // 2), max(natural, key=lambda x: x[0]))
        elif under:
            cut, kind = under[0]
        if kind == "hard" and t[cut - 1] == "\r" and t[cut : cut + 1] == "\n":
            cut -= 1
        out.append((start, cut, kind))
        back = cut - overlap
        i = bisect_left(words, back)
        start = words[i] if i < len(words) and words[i] < cut else back
    out.append((start, len(t), "end"))
    return out


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, piece_no, start_pos, end_pos, cut, piece of every text; other columns are left out."""
    names = [*keys, "piece_no", "start_pos", "end_pos", "cut", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, t in enumerate(b.column(0).to_pylist()):
                for n, (s, e, k) in enumerate(pieces(t, limit, overlap) if t else []):
                    rows.append(i)
                    for c, v in zip(cols, (n, s, e, k, t[s:e])):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[1:]], *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    schema = df.select(*keys).schema
    for n, t in (("piece_no", "long"), ("start_pos", "long"), ("end_pos", "long"), ("cut", "string"), ("piece", "string")):
        schema = schema.add(n, t)
    return df.select(F.col(text).alias("_text"), *keys).where(F.col("_text").isNotNull()).mapInArrow(run, schema)


def stretches(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per url (latest) whose content has pieces cut at no natural end: longest_stretch without a natural end,
    pieces and hard_cuts of its content, cut at strict ends.

    A stretch beyond the limit always makes such a piece: the piece that begins within the overlap before the stretch
    meets no natural end under the limit. Null and empty contents and those within the limit have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ends = strict_ends(t) if t and len(t) > limit else []
                p = pieces(t, limit, limit // 10, ends) if ends else []
                candidate = any(k in ("word", "hard") for _, _, k in p)
                rows.append((longest_stretch(t, ends[0][1]) if candidate else None, len(p), sum(k == "hard" for _, _, k in p)))
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols]], names=["url", "created_at", "longest_stretch", "pieces", "hard_cuts"])

    rows = pages.select("url", "content", "created_at").where(F.col("url").isNotNull()).mapInArrow(run, "url string, created_at long, longest_stretch long, pieces long, hard_cuts long")
    return latest(rows).where("longest_stretch IS NOT NULL")
