"""Encoding of texts with a public byte-level BPE vocabulary, of long ones by tree concatenation.

A text of more than LEAF characters is cut in leaves that are encoded by themselves; neighbours are then joined level
by level. A join re-encodes a window around the cut and grows it until both sides agree: at each end the window must
begin (or end) with the very tokens that the half has there, up to a place where the pre-tokenizer breaks whatever lies
beyond (white space after other text, or a change between letters and digits). In long unsplit text - a run of
characters of one class, which is one piece - there is no such place; there the window's tokens must meet the half's
at both ends in pairs that are each the encoding of their own bytes, for a row of tokens whose neighbours all are is
the encoding of the whole piece. So the result equals encoding the whole, and a join costs its window. Where neither
holds, the window grows to both halves. Texts of more than LONG characters have their leaves encoded in parallel
tasks. Special-token strings are ordinary text; null and empty texts give an empty list."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a leaf, and of a text from which its leaves are spread over tasks.
LEAF = 2_048
LONG = 65_536
WINDOW = 64

# Fixed value: the pre-tokenizer of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(t: str | None, path: str = VOCABULARY) -> np.ndarray:
    return encoding(path).encode_to_numpy(t, disallowed_special=()).astype(np.int32) if t else np.zeros(0, np.int32)


def _breaks(x: str, y: str) -> bool:
    """Whether the pre-tokenizer breaks between these neighbours whatever stands around them."""
    if _space(y):
        return not _space(x)
    a, b = category(x)[0], category(y)[0]
    return (a == "L" and b == "N") or (a == "N" and b == "L")


_SPACE = re.compile(r"[\s\x85]")


def _space(c: str) -> bool:
    return bool(_SPACE.match(c)) and c not in "\x1c\x1d\x1e\x1f"


def _tail(ids: np.ndarray, sizes: np.ndarray, n: int) -> int | None:
    """Where the last n bytes begin among the tokens; None inside a token."""
    at = int(np.searchsorted(np.cumsum(sizes[::-1]), n))
    if n == 0:
        return len(ids)
    return len(ids) - at - 1 if at < len(ids) and int(sizes[::-1][: at + 1].sum()) == n else None


def _head(sizes: np.ndarray, n: int) -> int | None:
    """How many tokens the first n bytes are; None inside a token."""
    if n == 0:
        return 0
    at = int(np.searchsorted(np.cumsum(sizes), n))
    return at + 1 if at < len(sizes) and int(sizes[: at + 1].sum()) == n else None


@lru_cache(maxsize=4)
def _sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    enc = encoding(path)
    out = np.zeros(enc.max_token_value + 1, np.int64)
    for i in range(len(out)):
        try:
            out[i] = len(enc.decode_single_token_bytes(i))
        except KeyError:
            pass
    return out


def _kind(c: str) -> str:
    """Class whose runs the pre-tokenizer keeps in one piece; '' for white space and for what a contraction may hold."""
    if _space(c) or c == "'":
        return ""
    k = category(c)[0]
    return k if k in "LN" else "O"


def _unsplit(a: str, ids_a: np.ndarray, b: str, ids_b: np.ndarray, w: int, path: str) -> np.ndarray | None:
    """The join inside one piece, from w characters on each side that are of one class; None if it can't be told."""
    left, right = a[-w:], b[:w]
    kinds = {_kind(c) for c in left + right}
    if len(kinds) != 1 or "" in kinds or len(left) < w or len(right) < w or "'" in a[-w - 3 : -w] + b[w : w + 3]:
        return None
    enc, sizes = encoding(path), _sizes(path)
    room_a, room_b = len(left.encode()), len(right.encode())
    # whole tokens inside the window, but for the two at its edges, whose pieces may begin or end outside
    i = len(ids_a) - int((np.cumsum(sizes[ids_a[::-1][: room_a + 1]]) <= room_a).sum()) + 1
    j = int((np.cumsum(sizes[ids_b[: room_b + 1]]) <= room_b).sum()) - 1
    if i >= len(ids_a) or j <= 0:
        return None
    piece = lambda ids: b"".join(enc.decode_single_token_bytes(int(x)) for x in ids)
    middle = enc._encode_single_piece(piece(ids_a[i:]) + piece(ids_b[:j]))
    agree = lambda x, y: enc._encode_single_piece(piece([x, y])) == [int(x), int(y)]
    if agree(ids_a[i - 1], middle[0]) and (j == len(ids_b) or agree(middle[-1], ids_b[j])):
        return np.concatenate((ids_a[:i], np.array(middle, np.int32), ids_b[j:]))
    return None


def join(a: str, ids_a: np.ndarray, b: str, ids_b: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """The ids of a + b from those of both."""
    if not a or not b:
        return ids_b if not a else ids_a
    sizes = _sizes(path)
    w = WINDOW
    while True:
        lo, hi = max(0, len(a) - w), min(len(b), w)
        # two breaks on each side: the tokens between them must be the half's own
        left = [i for i in range(len(a) - 1, lo, -1) if _breaks(a[i - 1], a[i])]
        right = [i for i in range(1, hi) if _breaks(b[i - 1], b[i])]
        p = left[-1] if len(left) > 1 else 0 if lo == 0 else None
        q = right[-1] if len(right) > 1 else len(b) if hi == len(b) else None
        if p is not None and q is not None:
            middle = encode(a[p:] + b[:q], path)
            i, j = _tail(ids_a, sizes[ids_a], len(a[p:].encode())), _head(sizes[ids_b], len(b[:q].encode()))
            if i is not None and j is not None:
                p2, q2 = (left[-2] if len(left) > 1 else p), (right[-2] if len(right) > 1 else q)
                x = _tail(ids_a, sizes[ids_a], len(a[p2:].encode()))
                y = _head(sizes[ids_b], len(b[:q2].encode()))
                whole = lo == 0 and hi == len(b) and p == 0 and q == len(b)
                same = x is not None and y is not None and np.array_equal(middle[: x - i], ids_a[i:x]) and np.array_equal(middle[len(middle) - (j - y) :], ids_b[y:j])
                if whole or same:
                    return np.concatenate((ids_a[:i], middle, ids_b[j:]))
            if lo == 0 and hi == len(b):
                return encode(a + b, path)
        elif (ids := _unsplit(a, ids_a, b, ids_b, w, path)) is not None:
            return ids
        w *= 4


def concatenate(leaves: list[tuple[str, np.ndarray]], path: str = VOCABULARY) -> np.ndarray:
    """Joins neighbours level by level."""
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [p[0] if len(p) == 1 else (p[0][0] + p[1][0], join(*p[0], *p[1], path)) for p in pairs]
    return leaves[0][1] if leaves else np.zeros(0, np.int32)


def encode_text(t: str | None, path: str = VOCABULARY, leaf: int = LEAF) -> np.ndarray:
    """The ids of a text, by its leaves where it is longer than one."""
    if not t or len(t) <= leaf:
        return encode(t, path)
    parts = [t[i : i + leaf] for i in range(0, len(t), leaf)]
    return concatenate([(p, encode(p, path)) for p in parts], path)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row; key must be unique. Other columns are left out."""
    ints = docs.select(key).schema.add("ids", ArrayType(IntegerType()))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([encode_text(t, path) for t in b.column(1).to_pylist()])], names=[key, "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _lists([encode(t, path) for t in b.column(2).to_pylist()])], names=[key, "no", "part", "ids"])

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("no")
        parts = [(p, np.array(i, np.int32)) for p, i in zip(t.column("part").to_pylist(), t.column("ids").to_pylist())]
        return pa.table({key: t.column(key).slice(0, 1), "ids": _lists([concatenate(parts, path)])})

    rows = docs.select(key, F.col(text).alias("_text"))
    size = F.coalesce(F.length("_text"), F.lit(0))
    direct = rows.where(size <= long).mapInArrow(short, ints)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(size / leaf).cast("int") - 1), lambda i: F.substring(F.col("_text"), i * leaf + 1, F.lit(leaf)))
    parts = rows.where(size > long).select(key, F.posexplode(cut).alias("no", "part")).repartition(F.col(key), F.col("no"))
    schema = docs.select(key).schema.add("no", "integer").add("part", "string").add("ids", ArrayType(IntegerType()))
    return direct.unionByName(parts.mapInArrow(leaves, schema).groupBy(key).applyInArrow(whole, ints))
