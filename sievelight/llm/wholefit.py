"""Fits over every page: the line model of residue, and counts of an operator's own, from one reading of the texts.

A page is read once. Its line features, and what the operator needs to judge it later, are kept as one compressed row
for each thousand pages; the model is fitted and the pages are judged from these rows. Counts are added up on the
executors, by shard; what reaches the driver is the vocabulary and vectors over it (at most residue.VOCABULARY entries)
and the operator's counts, whose number the operator bounds. Sums are of integers, so that any order of the rows and any
number of tasks give the same model."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import residue
from sievelight.llm.bounded import bits_for, in_bitmap, member_bitmap
from sievelight.llm.pagestats import Pages, slices
from sievelight.llm.vector import U, mix
from sievelight.session import materialize

SHARDS = 256
#: Counts of features that a task holds before it adds them up and, if half as many differ, gives them out. As many
#: runs without white space, and 32 characters for each, are held at most, but for those of one batch.
HELD = 400_000
#: Entries of the operator's counts in one shard.
WIDTH = 1 << 19
#: Parts that reach the driver of a sum of vectors.
TASKS = 16
#: Bits of the bitmap of lines that occur more than once, at least and at most.
BITMAP_BITS = (16, 28)
#: Units of fixed-point logarithms and of fixed-point probabilities.
LOG, PART = 1 << 24, 1 << 30

KIND = "kind int, shard int, blob binary, own binary"


def _pack(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 3)


def _unpack(b: bytes):
    return pickle.loads(zstandard.decompress(b))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["kind", "shard", "blob", "own"])


def _hash(x: str) -> int:
    return int.from_bytes(blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbours from those of the two."""
    with np.errstate(over="ignore"):
        return mix(a * U(0x9E3779B97F4A7C15) ^ mix(b))


class _Numbers(dict):
    """Numbers from 0 in the order in which keys are first asked for."""

    def __missing__(self, x) -> int:
        n = self[x] = len(self)
        return n


class Words:
    """The runs without white space that a task has met, each read once, and their features, under numbers."""

    def __init__(self):
        self.runs, self.features = _Numbers(), _Numbers()
        self.seen = self.chars = 0
        self.names: list[str] = []
        self.hashes = np.zeros(0, U)
        #: Of each run its place in flat, its features, changes, letters, whether it is a path or an identifier, whether it is a cue of a mark.
        self.table, self.flat = np.zeros((0, 6), np.int64), np.zeros(0, np.int64)

    def read(self, runs: Iterable[str]) -> np.ndarray:
        """The numbers of the runs."""
        out = np.fromiter(map(self.runs.__getitem__, runs), np.int64)
        rows, flat, place = [], [], len(self.flat)
        new = list(islice(self.runs, self.seen, None))
        for x, cue in zip(new, residue.cues(new)):
            f, mess, letters = residue.token(x)
            self.chars += len(x)
            rows.append((place + len(flat), len(f), mess, letters, "/P" in f or "#H" in f, cue))
            flat += [self.features[y] for y in f]
        self.seen = len(self.runs)
        self.table = np.vstack([self.table, np.array(rows, np.int64).reshape(-1, 6)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int64)])
        return out

    def named(self) -> None:
        """Brings names and hashes up to the features met."""
        more = list(islice(self.features, len(self.names), None))
        self.names += more
        self.hashes = np.concatenate([self.hashes, np.array([_hash(x) for x in more], U)])


def _records(own_text: list[list[str]], w: Words) -> dict:
    """The lines of each page: their sizes and marks, their features (tok) and the other keys of each (more) as numbers of
    the batch, and the hash of each number."""
    lines, many = list(chain.from_iterable(own_text)), np.array([len(x) for x in own_text], np.int64)
    n, rec = len(lines), np.repeat(np.arange(len(many)), many)
    cut = [residue.slotted(t) for t in lines]
    runs = [t.split() for t, _ in cut]
    each = np.array([len(x) for x in runs], np.int64)
    at = w.read(chain.from_iterable(runs))
    line = np.repeat(np.arange(n), each)
    start, count = w.table[at, 0], w.table[at, 1]
    by_line = lambda k: np.bincount(line, weights=w.table[at, k], minlength=n)
    long = by_line(1).astype(np.int64)
    chars, slots = np.array([len(t) for t in lines], np.int64), np.array([k for _, k in cut], np.int64) > 0
    messy = ~slots & ((long == 0) | ((by_line(2) > 0.3 * long + 1) & (by_line(4) == 0)) | (by_line(3) < 0.35 * chars - 4))
    size = np.array([residue.words(t) for t in lines], np.int64)
    by_rec = lambda x: np.bincount(rec, weights=x, minlength=len(many))
    total = by_rec(size)
    short = total <= residue.FEW
    may = (by_line(5) > 0) & ~messy
    may[[i for i, t in enumerate(lines) if not messy[i] and residue.opening(t)]] = True
    marked = lambda i: bool(may[i] and residue.MARKS.search(lines[i]))
    # one unmarked line of running text settles a record that isn't short: its other marks count for nothing
    running = np.flatnonzero((np.maximum(long, 1) >= residue.RUNNING) & ~short[rec])
    running = running[np.lexsort((running, chars[running], rec[running]))]
    settled = many == 0
    for i in running[np.diff(rec[running], prepend=-1) != 0].tolist():
        settled[rec[i]] = not marked(i)
    mark = np.zeros(n, bool)
    for i in np.flatnonzero(may & ~settled[rec]).tolist():
        mark[i] = marked(i)
    trusted = ~settled & (by_rec((long >= residue.RUNNING) & ~mark) == 0) & (by_rec(mark) >= np.where(total <= 3 * residue.FEW, 0.34, 0.75) * many)
    # features of the lines that have them, and what else is weighed
    of = np.repeat(~messy[line], count)
    tok = w.flat[(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))[of]]
    w.named()
    first = np.cumsum(np.where(messy, 0, long)) - long
    few = np.flatnonzero(~messy & (long <= 3))
    alone = [w.features["=" + " ".join([w.names[k] for k in tok[a : a + k]])] for a, k in zip(first[few].tolist(), long[few].tolist())]
    less = short[rec] & ~messy
    more = [(few, np.array(alone, np.int64)), *[(i, np.full(len(i), w.features[x])) for x, i in (("=short", np.flatnonzero(less)), ("=mark", np.flatnonzero(less & mark)), ("~", np.flatnonzero(messy)))]]
    w.named()
    more_line, extra = np.concatenate([x for x, _ in more]), np.concatenate([x for _, x in more])
    used, back = np.unique(np.concatenate([tok, extra]), return_inverse=True)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    return {
        "tok": back[: len(tok)].astype(kind), "each": np.where(messy, 0, long).astype(np.int32), "more": back[len(tok) :].astype(kind), "more_line": more_line.astype(np.int32), "hash": w.hashes[used], "used": used,
        "messy": messy, "size": size.astype(np.int32), "many": many.astype(np.int32), "trusted": trusted,
    }


def _keys(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each line: lines in order, keys as code a * (numbers + 1) + b + 1 of neighbours a and b or, with
    b = -1, of a alone, and their hashes."""
    n, v = len(r["each"]), len(r["hash"]) + 1
    tok, line = r["tok"].astype(np.int64), np.repeat(np.arange(n), r["each"])
    near = np.flatnonzero(line[1:] == line[:-1])
    code = np.concatenate([tok * v, r["more"].astype(np.int64) * v, tok[near] * v + tok[near + 1] + 1])
    line = np.concatenate([line, r["more_line"], line[near]])
    line, code = _distinct(line, code, v * v)[:2]
    a, b = np.divmod(code, v)
    h = r["hash"][a]
    two = b > 0
    h[two] = _paired(h[two], r["hash"][b[two] - 1])
    return line, code, h


def _distinct(group: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, code), in order, and how often each occurs; codes are lower than most."""
    if not len(code):
        return group, code, np.zeros(0, np.int64)
    back = None
    if (int(group.max()) + 1) * most >= 1 << 63:
        back, code = np.unique(code, return_inverse=True)
        most = len(back)
    packed = group * most + code
    packed.sort()
    at = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    group, code = np.divmod(packed[at], most)
    return group, code if back is None else back[code], np.diff(at, append=len(packed))


def _set_hashes(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of the keys of each line; every line has one at least."""
    if not len(line):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(h ^ U(0x2545F4914F6CDD1D)), np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))))


def _counted(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a batch as codes of the task's numbers, a << 31 | b + 1, in how many records each occurs and in how many
    lines that differ within their record."""
    line, code, h = _keys(r)
    rec, same = np.repeat(np.arange(len(r["many"])), r["many"]), _set_hashes(line, h)
    o = np.lexsort((same, rec))
    fresh = np.zeros(len(o), bool)
    fresh[o] = np.concatenate(([True], (rec[o][1:] != rec[o][:-1]) | (same[o][1:] != same[o][:-1])))[: len(o)]
    at, v = fresh[line], len(r["hash"]) + 1
    _, code, lines = _distinct(rec[line[at]], code[at], v * v)
    code, records, lines = _added(code, np.ones(len(code), np.int64), lines)
    a, b = np.divmod(code, v)
    return r["used"][a] << 31 | np.where(b > 0, r["used"][b - 1] + 1, 0), records, lines


def _added(code: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct codes and the sums of their counts."""
    if not len(code):
        return [code, *counts]
    o = np.argsort(code)
    code = code[o]
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return [code[at], *[np.add.reduceat(c[o], at) for c in counts]]


def _shards(code: np.ndarray, records: np.ndarray, lines: np.ndarray, w: Words) -> list[tuple]:
    """(0, shard, part, None) rows of counts of keys, by name: records, and lines that differ within their record."""
    a, b = code >> 31, (code & 0x7FFFFFFF) - 1
    two = b >= 0
    h = w.hashes[a]
    h[two] = _paired(h[two], w.hashes[b[two]])
    shard = (h >> U(56)).astype(np.int64)
    o = np.argsort(shard, kind="stable")
    names = [w.names[x] + " " + w.names[y] if y >= 0 else w.names[x] for x, y in zip(a[o].tolist(), b[o].tolist())]
    end = np.cumsum(np.bincount(shard, minlength=SHARDS)).tolist()
    return [(0, k, _pack(("\n".join(names[lo:hi]), records[o[lo:hi]].astype(np.int32), lines[o[lo:hi]].astype(np.int32))), None) for k, (lo, hi) in enumerate(pairwise([0, *end])) if hi > lo]


def read(pages: DataFrame, functions: np.ndarray, look: Callable[[Pages], tuple[dict, np.ndarray, np.ndarray]]) -> DataFrame:
    """Reads the latest row of each url once. look(pages) gives what the operator keeps of a batch, and indices and
    counts that are added up over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        w, held = Words(), []
        for b in slices(batches):
            urls, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            p = Pages(contents, urls, functions)
            own, index, count = look(p)
            total.update(dict(zip(index.tolist(), count.tolist())))
            records = _records(p.own_text, w)
            held.append(_counted(records))
            del records["used"]
            yield _rows([(2, 0, _pack(records), _pack({"url": urls, **own}))])
            full = w.seen > HELD or w.chars > 32 * HELD
            if full or sum(len(x[0]) for x in held) > HELD:
                held = [_added(*map(np.concatenate, zip(*held)))]
                if full or len(held[0][0]) > HELD // 2:
                    yield _rows(_shards(*held[0], w))
                    w, held = Words(), []
        out = _shards(*_added(*map(np.concatenate, zip(*held))), w) if held else []
        index = np.array(sorted(total), np.int64)
        count = np.array([total[i] for i in index.tolist()], np.int64)
        for k in np.unique(index // WIDTH).tolist():
            of = index // WIDTH == k
            out.append((1, k, _pack((index[of], count[of])), None))
        if out:
            yield _rows(out)

    latest = residue.latest(pages.select("url", "created_at", "content").where(F.col("url").isNotNull()))
    return materialize(latest.select("url", "content").mapInArrow(run, KIND))


def counts(rows: DataFrame, size: int) -> np.ndarray:
    """The operator's counts, size of them."""

    def merged(t: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for b in t.column("blob").to_pylist():
            i, n = _unpack(b)
            total.update(dict(zip(i.tolist(), n.tolist())))
        return pa.table({"blob": pa.array([_pack((np.array(list(total), np.int64), np.array(list(total.values()), np.int64)))], pa.binary())})

    out = np.zeros(size, np.int64)
    for r in rows.where("kind = 1").select("shard", "blob").groupBy("shard").applyInArrow(merged, "blob binary").toLocalIterator():
        i, n = _unpack(r.blob)
        out[i] = n
    return out


def _vocabulary(rows: DataFrame) -> list[str]:
    """The most frequent features, by records: those of LEAST records, or of as many lines within their records."""

    def merged(t: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in t.column("blob").to_pylist()]
        held = pa.table({"x": list(chain.from_iterable([x.split("\n") for x, _, _ in parts])), "r": np.concatenate([r.astype(np.int64) for _, r, _ in parts]), "n": np.concatenate([n.astype(np.int64) for _, _, n in parts])})
        held = held.group_by("x", use_threads=False).aggregate([("r", "sum"), ("n", "sum")])
        x, r, n = held.column("x").to_numpy(), held.column("r_sum").to_numpy(), held.column("n_sum").to_numpy()
        at = (r >= residue.LEAST) | (n >= residue.LEAST)
        kept = sorted(zip((-r[at]).tolist(), x[at]))[: residue.VOCABULARY]
        return pa.table({"x": pa.array([x for _, x in kept], pa.string()), "n": pa.array([-r for r, _ in kept], pa.int64())})

    kept = rows.where("kind = 0").select("shard", "blob").groupBy("shard").applyInArrow(merged, "x string, n long")
    return [r.x for r in kept.orderBy(F.desc("n"), "x").limit(residue.VOCABULARY).collect()]


def _known(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the names, and the number of each."""
    parts = [[x] if x[0] == "=" else x.split(" ") for x in names]
    h = np.array([_hash(x[0]) for x in parts], U)
    two = np.array([len(x) == 2 for x in parts], bool)
    h[two] = _paired(h[two], np.array([_hash(x[1]) for x in parts if len(x) == 2], U))
    o = np.argsort(h)
    return h[o], o


def _numbered(rows: DataFrame, vocab) -> DataFrame:
    """The batches with their lines as a hash of all keys and the numbers, in order, of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = vocab.value
        for b in batches:
            for blob, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = _unpack(blob)
                line, _, h = _keys(r)
                same = _set_hashes(line, h)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                of = known[at] == h if len(known) else np.zeros(len(h), bool)
                packed = line[of] << 16 | number[at[of]]
                packed.sort()
                x = {"line": same.view(np.int64), "n": np.bincount(packed >> 16, minlength=len(r["each"])), "col": (packed & 0xFFFF).astype(np.uint16), **{k: r[k] for k in ("messy", "size", "many", "trusted")}}
                yield pa.RecordBatch.from_arrays([pa.array([int((x["many"] > 0).sum())], pa.int64()), pa.array([int(x["trusted"].sum())], pa.int64()), pa.array([_pack(x)], pa.binary()), pa.array([own], pa.binary())], names=["records", "trusted", "blob", "own"])

    return materialize(rows.where("kind = 2").select("blob", "own").mapInArrow(run, "records long, trusted long, blob binary, own binary"))


def _odds(x: dict, weight: np.ndarray, prior: float) -> np.ndarray:
    of = np.repeat(np.arange(len(x["n"])), x["n"])
    return np.where(x["messy"], -9.0, prior + np.bincount(of, weights=weight[x["col"]], minlength=len(x["n"])))


def _probable(x: dict, weight: np.ndarray | None, prior: float) -> np.ndarray:
    """How surely each line is positive: one in trusted records, none where it isn't most of its record."""
    rec = np.repeat(np.arange(len(x["many"])), x["many"])
    sure = x["trusted"][rec]
    if weight is None:
        return sure.astype(float)
    s = _odds(x, weight, prior)
    total = lambda w: np.bincount(rec, weights=w, minlength=len(x["many"]))
    pos = total(x["size"] * (s > 0)) >= 0.6 * total(x["size"])
    return np.where(sure, 1.0, np.where(pos[rec], 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0))


def _lines(x: dict, at: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct line among those at the places: its numbers, sum of part and occurrences."""
    line, first, back = np.unique(x["line"][at], return_index=True, return_inverse=True)
    end = np.cumsum(x["n"])
    cols = [x["col"][end[i] - x["n"][i] : end[i]].tobytes() for i in at[first].tolist()]
    q = np.zeros(len(line), np.int64)
    np.add.at(q, back, part[at])
    return pa.RecordBatch.from_arrays([pa.array(line), pa.array(cols, pa.binary()), pa.array(q), pa.array(np.bincount(back, minlength=len(line)).astype(np.int64))], names=["line", "cols", "q", "n"])


LINE = "line long, cols binary, q long, n long"


def _summed(lines: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Sums of the fixed-point values of(q, n) over distinct lines, in all (last) and by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            cols = [np.frombuffer(c, np.uint16) for c in b.column(0).to_pylist()]
            v = [np.rint(x * LOG).astype(np.int64) for x in of(b.column(1).to_numpy() / PART, b.column(2).to_numpy())]
            out = np.zeros((len(v), size + 1), np.int64) if out is None else out
            col, row = np.concatenate([np.zeros(0, np.uint16), *cols]), np.repeat(np.arange(len(cols)), [len(c) for c in cols])
            for o, x in zip(out, v):
                np.add.at(o, col, x[row])
                o[size] += x.sum()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(out)], pa.binary())], names=["blob"])

    total = 0
    for r in lines.select("cols", "q", "n").coalesce(TASKS).mapInArrow(run, "blob binary").collect():
        total = total + _unpack(r.blob)
    return total / LOG


def _occurring(blobs: DataFrame, often: Broadcast, size: int, distinct: Callable[[DataFrame], DataFrame]) -> np.ndarray:
    """Sums of log1p of the occurrences of every distinct line. A line that isn't in the bitmap of repeated ones occurs
    once and is counted where it stands; the others, and the few that are in it by chance, are sent."""

    def once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size + 1, np.int64)
        for b in it:
            for blob in b.column(0).to_pylist():
                x = _unpack(blob)
                of = ~in_bitmap(often.value, x["line"].view(np.uint64))
                out[:size] += np.bincount(x["col"][np.repeat(of, x["n"])], minlength=size)
                out[size] += of.sum()
        yield pa.RecordBatch.from_arrays([pa.array([_pack(out)], pa.binary())], names=["blob"])

    def sent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for blob in b.column(0).to_pylist():
                x = _unpack(blob)
                yield _lines(x, np.flatnonzero(in_bitmap(often.value, x["line"].view(np.uint64))), np.zeros(len(x["n"]), np.int64))

    total = sum(_unpack(r.blob) for r in blobs.coalesce(TASKS).mapInArrow(once, "blob binary").collect()) * np.rint(np.log(2) * LOG) / LOG
    many = _summed(distinct(blobs.mapInArrow(sent, LINE)), size, lambda q, n: [np.log1p(n)])
    return total + (many[0] if np.ndim(many) else 0)


def fit(rows: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """(numbered batches, weight of each number, prior): residue.fit's model, fitted on all pages of read's rows.

    Only lines that may be positive are sent in a round; all other lines are counted once, before."""
    spark = rows.sparkSession
    names = _vocabulary(rows)
    size = len(names)
    batches = _numbered(rows, spark.sparkContext.broadcast(_known(names)))
    n = batches.agg(F.sum("records").alias("records"), F.sum("trusted").alias("trusted")).first()
    if not size or not n.trusted or n.trusted == n.records:
        return batches, np.zeros(size), residue.LineModel().prior
    blobs = batches.select("blob")

    def occurrences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for blob in b.column(0).to_pylist():
                line, n = np.unique(_unpack(blob)["line"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(n.astype(np.int64))], names=["line", "n"])

    distinct = lambda df: df.groupBy("line").agg(F.first("cols").alias("cols"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    often = materialize(blobs.mapInArrow(occurrences, "line long, n long").groupBy("line").agg(F.sum("n").alias("times")).where("times > 1"))
    base = _occurring(blobs, member_bitmap(often, "line", bits_for(8 * often.count(), *BITMAP_BITS)), size, distinct)
    weight, prior = None, 0.0
    for _ in range(residue.ROUNDS):
        shared = spark.sparkContext.broadcast((weight, prior))

        def probable(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in it:
                for blob in b.column(0).to_pylist():
                    x = _unpack(blob)
                    q = np.rint(_probable(x, *shared.value) * PART).astype(np.int64)
                    yield _lines(x, np.flatnonzero(q), q)

        some = distinct(blobs.mapInArrow(probable, LINE)).join(often, "line", "left").select("cols", "q", F.coalesce("times", F.lit(1)).alias("n"))
        pos, less = _summed(some, size, lambda q, n: [np.log1p(q), np.log1p(n - q) - np.log1p(n)])
        neg = base + less
        weight = np.clip(np.log((pos[:size] + 0.1) / (pos[size] + 1)) - np.log((neg[:size] + 0.1) / (neg[size] + 1)), -2.5, 5)
        prior = float(np.log(pos[size] + 1) - np.log(neg[size] + 1))
    return batches, weight, prior


def flagged(x: dict, weight: np.ndarray, prior: float) -> np.ndarray:
    """residue.judge's verdict of each page of a numbered batch."""
    many = x["many"]
    rec = np.repeat(np.arange(len(many)), many)
    s = _odds(x, weight, prior)
    total = np.bincount(rec, weights=x["size"], minlength=len(many))
    pos = np.bincount(rec, weights=x["size"] * (s > 0), minlength=len(many))
    best, worst = np.full(len(many), -99.0), np.full(len(many), 99.0)
    np.maximum.at(best, rec, s)
    np.minimum.at(worst, rec, s)
    return (pos > 0) & ((pos >= 0.5 * total) | ((total <= residue.FEW) & (best > 4) & (worst > -6)))


def judged(batches: DataFrame, weight: np.ndarray, prior: float, judge: Callable[[dict, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """url and the columns of judge(what look kept, residue verdicts) of each page."""
    shared = batches.sparkSession.sparkContext.broadcast((weight, prior))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for blob, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kept = _unpack(own)
                yield pa.RecordBatch.from_arrays([pa.array(kept["url"], pa.string()), *judge(kept, flagged(_unpack(blob), *shared.value))], names=["url", *[c.split()[0] for c in schema.split(", ")]])

    return batches.select("blob", "own").mapInArrow(run, "url string, " + schema)
