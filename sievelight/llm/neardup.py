"""Near-duplicate texts: exact Jaccard over word shingles by pigeonring filtering.

Two shingle sets with a Jaccard similarity of t or more differ in at most (1 - t) / (1 + t) * (|A| + |B|) elements.

1. Copies collapse: a set's hash is its class, and everything below works on classes, those of the newest versions only.
2. All shingles are put in one global order, rare before frequent (levels of a counting sketch over the whole
   collection, then the hash). Of the segments of that ring - one for each shingle - a pair within the budget must
   agree in one of the first of both: |A| less what the two sizes make them share, and once more for every MARGIN
   shingles if these are read a little further. Only shingles seen in two places are
   sent, and of each set no more than its first |A| - ceil(t|A|) + 1.
3. Every class has a parity signature (bit i is the parity of the shingles that hash to i; each element by which two
   sets differ flips one bit, so the Hamming distance never exceeds the true difference). The signatures of a pair that
   agrees are cut into segments on a ring: the pair stays only if from some segment on every chain of consecutive
   segments keeps its cumulative difference within its proportional share of the budget. No set moves before that.
4. The full sets of the pairs that are left are compared.

Steps 1 to 3 lose no pair; ties and repeats change nothing. Sketch and bitmaps have a cell for each item up to a bound;
beyond it the order and the filters get worse, never the result. Shingles frequent enough to make a hot group are split
in blocks, and each pair of blocks is a task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from sievelight.llm.vector import KEPT, U, distinct, grams, lowered, mix, tokens
from sievelight.llm.bounded import LEVELS, Parts, bits_for, in_bitmap, levels, member_bitmap, merged_sketch
from sievelight.session import materialize

#: Bounds of the bits of sketch (four bits a cell: 128 MB at most) and bitmaps (32 MB at most).
SKETCH_BITS = (20, 28)
BITMAP_BITS = (20, 28)
SEGMENTS = 16
#: From this count on a shingle's postings are split in blocks of about this many, in at most BLOCKS.
HOT = 1024
BLOCKS = 512
#: A pair must agree in one more place for every MARGIN shingles of its smaller set.
MARGIN = 64
#: Bytes of a hash in the sets that are compared in full (an accidental agreement once in three thousand million pairs).
FULL = 6
#: Texts taken together.
DOCS = 4096


def shingle_sets(texts: list[str | None], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-token shingles of each text with at least ``least`` tokens, sorted by text and hash."""
    if len(texts) > DOCS:
        parts = [shingle_sets(texts[i : i + DOCS], k, least) for i in range(0, len(texts), DOCS)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([d + i * DOCS for i, (_, d) in enumerate(parts)])
    h, doc, _, _ = tokens(lowered(texts))
    many = np.bincount(doc, minlength=len(texts)) >= least
    keep = many[doc]
    x, d, _ = grams(h[keep], doc[keep], k)
    return distinct(x, d)


def _classes(x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: class (hash of its set; 0 without shingles), number of shingles, start in x."""
    size = np.bincount(doc, minlength=n)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(x + U(0x51ED270B)))))
        cls = mix((total[start + size] - total[start]) * U(0x9E3779B97F4A7C15) + size.astype(U))
    return np.where(size > 0, cls, U(0)), size, start


def _cells(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U(KEPT - bits)).astype(np.int64)


def suffix_size(n: np.ndarray, t: float) -> np.ndarray:
    """How many shingles at the end of the order need not be sent."""
    return np.ceil(t * n - 1e-9).astype(np.int64) - 1


def overlap_needed(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """How many shingles a pair of these sizes with similarity t or more has in common at least."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


def margin(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How far beyond the first place that a pair must agree in the order is read: so many agreements more it needs."""
    return np.minimum(na, nb) // MARGIN


def agreements(na: Column, nb: Column, t: float) -> Column:
    """Agreements that a pair has at least in the ranks that are read: one, and the margin as far as both sets were sent
    that far."""
    o = F.ceil(t / (1 + t) * (na + nb) - 1e-9)
    sent = F.greatest(F.ceil(t * na - 1e-9), F.ceil(t * nb - 1e-9)) - 1
    return F.greatest(F.lit(1), F.least(1 + F.floor(F.least(na, nb) / MARGIN), o - sent))


def signatures(x: np.ndarray, doc: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity signature of each text's set, packed: at least 3 n bits, a power of two, at least 256, at most 2**16; null
    for texts without shingles."""
    bits = np.minimum(1 << 16, np.maximum(256, 1 << np.ceil(np.log2(np.maximum(3 * size, 1))).astype(np.int64)))
    bits = np.where(size > 0, bits, 0)
    start = np.concatenate(([0], np.cumsum(bits)))
    at = start[doc] + (x & (bits[doc] - 1).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(start[-1])) & 1).astype(np.uint8))
    whole = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((start // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
    return pa.compute.if_else(pa.array(size > 0), whole, pa.scalar(None, pa.binary()))


def unpacked(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))


def ring_pass(a: np.ndarray, b: np.ndarray, budget: float, m: int = SEGMENTS) -> bool:
    """Whether from some segment on every chain keeps within its share: the strong form of the pigeonring principle.

    Signatures of different lengths are folded to the shorter one, which keeps parity."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    d = (a ^ b).reshape(m, -1).sum(1, dtype=np.int64) - budget / m
    low = np.minimum.accumulate  # a start is good if no prefix of its chain sums to more than nothing
    twice = np.cumsum(np.concatenate((d, d)))
    before = np.concatenate(([0.0], twice[: m - 1]))
    highest = -low(-twice[::-1])[::-1]  # over all later chains, more than m long too
    if twice[m - 1] > 1e-9:
        return False
    return bool((highest[:m] - before <= 1e-9).any())


def _pack(x: np.ndarray) -> bytes:
    """The FULL low bytes of each hash, sorted."""
    return np.sort(x & U((1 << 8 * FULL) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FULL].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // FULL, 8), np.uint8)
    out[:, :FULL] = np.frombuffer(raw, np.uint8).reshape(-1, FULL)
    return out.view("<u8").ravel()


def near_pairs(docs: DataFrame, text: str = "content", t: float = 0.8, k: int = 5, least: int = 1, sketch_bits: int | None = None, version: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, sets) of the texts of ``docs``.

    pairs(class_a, class_b, overlap, n_a, n_b): each pair of different shingle sets with Jaccard >= t, class_a < class_b.
    sets: docs without the text, with class_id and n_shingles; null, empty and short texts (fewer than ``least`` or k
    tokens) have class_id null. version names a key and an order where the rows of a key replace one another: only the
    sets of the newest row of each key are compared (and those of others by chance, where a bitmap is full); the caller
    still picks the newest row. Extra columns of docs are kept; a column called class_id or n_shingles is replaced."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text, "class_id", "n_shingles")]
    only = docs.select(text).where(F.col(text).isNotNull())
    if sketch_bits is None:  # about a cell for each word, as every word begins a shingle
        sketch_bits = bits_for((only.agg(F.sum(F.length(text))).first()[0] or 0) // 6, *SKETCH_BITS)

    kinds = docs.select(*rest).schema.add("class_id", LongType()).add("n_shingles", IntegerType())
    schema = StructType([*kinds.fields, StructField("sig", BinaryType()), StructField("chunk", LongType()), StructField("part", BinaryType())])

    def read_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of the rows with their signatures, and at the end of the task (or when they are many) its part of
        the sketch."""
        held = Parts()
        blank = None
        for b in batches:
            texts = b.column(0).to_pylist()
            x, d = shingle_sets(texts, k, least)
            cls, size, _ = _classes(x, d, len(texts))
            columns = b.columns[1:]
            blank = [c.type for c in columns]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cls.view(np.int64), mask=size == 0), pa.array(size.astype(np.int32)), signatures(x, d, size), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=schema.names)
            if parts := held.add(_cells(x, sketch_bits)):
                yield _part_rows(parts, blank, schema.names)
        if parts := held.flush():
            yield _part_rows(parts, blank, schema.names)

    seen = materialize(docs.select(F.col(text), *rest).mapInArrow(read_once, schema))
    sketch = merged_sketch(seen.where("chunk IS NOT NULL").select("chunk", "part"), sketch_bits)
    rows = seen.where("chunk IS NULL")
    n_rows, occurrences = rows.agg(F.count("class_id"), F.sum("n_shingles")).first()
    noise = 4 * (occurrences or 0) / (1 << sketch_bits)  # what a cell may hold of others
    bits = bits_for(8 * n_rows, *BITMAP_BITS)
    current = rows
    if version:
        key, order = version
        newest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(order), F.col("class_id"))).alias("v"))
        current = newest.select("v.class_id").union(rows.where(F.col(key).isNull()).select("class_id"))
    current = member_bitmap(current.select("class_id").where("class_id IS NOT NULL"), "class_id", bits)

    def one_each(b: pa.RecordBatch, among: np.ndarray) -> tuple[np.ndarray, ...]:
        texts = b.column(0).to_pylist()
        x, d = shingle_sets(texts, k, least)
        cls, size, start = _classes(x, d, len(texts))
        first = np.zeros(len(texts), bool)
        first[np.unique(cls, return_index=True)[1]] = True
        return x, d, cls, size, start, first & (size > 0) & in_bitmap(among, cls)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        for b in batches:
            x, d, cls, size, start, first = one_each(b, current.value)
            level = levels(table, _cells(x, sketch_bits))
            rank = np.empty(len(x), np.int64)
            for lo in range(0, len(size), DOCS):  # sorted by document, level and hash, packed in one number
                i, j = start[lo], (start[lo + DOCS] if lo + DOCS < len(size) else len(x))
                o = np.argsort(((d[i:j] - lo).astype(U) << U(52)) | (level[i:j].astype(U) << U(48)) | (x[i:j] >> U(2)))
                rank[i + o] = np.arange(i, j)
            rank -= start[d]
            send = (rank < (size - suffix_size(size, t))[d]) & (level > 1) & first[d]
            x, level, d, rank = x[send], level[send].astype(np.int64), d[send], rank[send]
            blocks = np.clip((LEVELS[level] - noise).astype(np.int64) * 2 // HOT, 1, BLOCKS)
            block = (cls[d] >> U(8)) % blocks.astype(U)
            copies = blocks.copy()
            at = np.repeat(np.arange(len(x)), copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            mine = block[at].astype(np.int64)
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            with np.errstate(over="ignore"):
                key = np.where(blocks[at] > 1, mix(x[at] + U(0x9E3779B97F4A7C15) * (lo * 65536 + hi + 1).astype(U)), x[at])
            side = np.where(blocks[at] > 1, np.where(lo == hi, 2, mine == lo), 2).astype(np.int8)
            yield pa.RecordBatch.from_pydict({"s": pa.array(key.view(np.int64)), "c": pa.array(cls[d][at].view(np.int64)), "n": pa.array(size[d][at].astype(np.int32)), "r": pa.array((rank[at] * 4 + side).astype(np.int32))})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for b in batches:
            rows = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if keep is not None:
                rows = tuple(np.concatenate(p) for p in zip(keep, rows))
            if len(rows[0]) < 1 << 18:  # runs and repeats are better seen in many rows
                keep = rows
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on in the next batch
            keep = tuple(x[last:] for x in rows)
            yield from _pair_runs(*(x[:last] for x in rows), t)
        if keep is not None:
            yield from _pair_runs(*keep, t)

    posted = only.mapInArrow(postings, "s long, c long, n int, r int")
    sorted_ = posted.repartition("s").sortWithinPartitions("s", "c", "r")
    counted = sorted_.mapInArrow(pairs, "class_a long, class_b long, n_a int, n_b int, shared int").groupBy("class_a", "class_b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    candidates = materialize(counted.where(F.col("shared") >= agreements(F.col("n_a"), F.col("n_b"), t)).drop("shared"))
    both = lambda df: df.select(F.col("class_a").alias("c")).union(df.select("class_b"))
    asked = member_bitmap(both(candidates), "c", bits)

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(asked.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    signed = rows.where("class_id IS NOT NULL").select(F.col("class_id").alias("c"), "sig").mapInArrow(asked_for, "c long, sig binary").dropDuplicates(["c"])

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(3).to_numpy(zero_copy_only=False)
            ok = [ring_pass(unpacked(x), unpacked(y), (1 - t) / (1 + t) * int(m)) for x, y, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["class_a", "class_b", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))

    with_signs = candidates.join(signed.select(F.col("c").alias("class_a"), F.col("sig").alias("x_a")), "class_a").join(signed.select(F.col("c").alias("class_b"), F.col("sig").alias("x_b")), "class_b")
    left = materialize(with_signs.select("class_a", "class_b", "n_a", "n_b", "x_a", "x_b").mapInArrow(ring, "class_a long, class_b long, n_a int, n_b int"))
    wanted = member_bitmap(both(left), "c", bits)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, cls, size, start, first = one_each(b, wanted.value)
            at = np.flatnonzero(first)
            yield pa.RecordBatch.from_pydict({"c": pa.array(cls[at].view(np.int64)), "x": pa.array([_pack(x[start[i] : start[i] + size[i]]) for i in at], pa.binary())})

    whole = only.mapInArrow(full, "c long, x binary").dropDuplicates(["c"])
    sets = left.join(whole.select(F.col("c").alias("class_a"), F.col("x").alias("x_a")), "class_a").join(whole.select(F.col("c").alias("class_b"), F.col("x").alias("x_b")), "class_b").select("class_a", "class_b", "n_a", "n_b", "x_a", "x_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = []
            for i in range(b.num_rows):
                xa, xb = _unpack(b.column(4)[i].as_py()), _unpack(b.column(5)[i].as_py())
                z = np.concatenate((xa, xb))
                z.sort()
                o = int((z[1:] == z[:-1]).sum())
                if o >= t * (len(z) - o) - 1e-9:
                    out.append((i, o))
            at = np.array([i for i, _ in out], np.int64)
            yield pa.RecordBatch.from_pydict({"class_a": pa.array(a[at]), "class_b": pa.array(c[at]), "overlap": pa.array(np.array([o for _, o in out], np.int32)), "n_a": b.column(2).take(pa.array(at)), "n_b": b.column(3).take(pa.array(at))})

    found = sets.mapInArrow(verify, "class_a long, class_b long, overlap int, n_a int, n_b int")
    return found, rows.select(*kinds.names)


def _part_rows(parts: list[tuple[int, bytes]], blank: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([*[pa.nulls(n, t) for t in blank], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([c for c, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary())], names=names)


def _pair_runs(s: np.ndarray, c: np.ndarray, n: np.ndarray, r: np.ndarray, t: float) -> Iterator[pa.RecordBatch]:
    """The pairs of different classes within each run of one key (sorted by key and class) whose sizes and ranks allow t,
    counted.

    A pair of sizes na and nb with overlap o has all but o - 1 of either set in its first n - o + 1 ranks, so it agrees
    there once; read ``margin`` ranks further it agrees that much more often. r is four times the rank plus the side: 2 pairs with every other, 0 and 1 only with the other side.
    Repeats of a class in a run count once."""
    if not len(s):
        return
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    s, c, n, r = s[keep], c[keep], n[keep].astype(np.int64), r[keep]
    side, rank = r & 3, r >> 2
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    run = np.diff(np.concatenate((start, [len(s)])))
    left = np.repeat(start + run, run) - np.arange(len(s)) - 1  # members of the run after this one
    held, size = [], 0
    lo = 0
    total = np.cumsum(left)
    while lo < len(s):  # about four million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 22))))
        reps = left[lo:hi]
        i = np.repeat(np.arange(lo, hi), reps)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        reach = margin(small, large) - overlap_needed(small, large, t) + 1
        ok = (small >= t * large - 1e-9) & (rank[i] < n[i] + reach) & (rank[j] < n[j] + reach) & (c[i] != c[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        if len(i):
            held.append((c[i], c[j], n[i], n[j]))
            size += len(i)
        lo = hi
        if size > 1 << 21 or lo >= len(s):
            if held:
                a, b, na, nb = (np.concatenate(p) for p in zip(*held))
                o = np.lexsort((b, a))
                a, b, na, nb = a[o], b[o], na[o], nb[o]
                f = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                yield pa.RecordBatch.from_pydict({"class_a": pa.array(a[f]), "class_b": pa.array(b[f]), "n_a": pa.array(na[f].astype(np.int32)), "n_b": pa.array(nb[f].astype(np.int32)), "shared": pa.array(np.diff(np.concatenate((f, [len(a)]))).astype(np.int32))})
            held, size = [], 0
