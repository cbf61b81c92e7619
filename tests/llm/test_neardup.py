"""Near-duplicate pairs against brute force, with copies, hot shingles, nulls and short texts."""

import random
import re

import numpy as np
import pytest

from sievelight.llm import bounded, neardup


def sets_of(t, k=5):
    w = re.findall("[a-z0-9]+", t.lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)), len(w)


def brute(texts, t, least):
    every = {i: sets_of(x) for i, x in texts if x}
    good = {i: s for i, (s, n) in every.items() if n >= least and s}
    ids = sorted(good)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(good[a] & good[b]) >= t * len(good[a] | good[b]) - 1e-9}


def texts(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.randrange(20, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 12)):
            i = r.randrange(len(w))
            what = r.randrange(3)
            if what == 0:
                w[i] = r.choice(vocab)
            elif what == 1:
                w.insert(i, r.choice(vocab))
            elif len(w) > 6:
                del w[i]
        if r.random() < 0.2:
            cut = len(w) // 2
            w = w[cut:] + w[:cut]
        out.append(" ".join(w) + ".")
    out += [out[0]] * 5 + ["", "   ", "one two three", None, None]
    return list(enumerate(out))


def found(spark, data, t, least, **kw):
    df = spark.createDataFrame(data, "id long, content string")
    pairs, sets = neardup.near_pairs(df, "content", t, 5, least, sketch_bits=20, **kw)
    by = {}
    for r in sets.collect():
        if r.class_id is not None:
            by.setdefault(r.class_id, []).append(r.id)
    out = set()
    for r in pairs.collect():
        out |= {tuple(sorted((a, b))) for a in by[r.class_a] for b in by[r.class_b]}
    for members in by.values():
        out |= {(a, b) for a in members for b in members if a < b}
    return out


@pytest.mark.parametrize("seed,t,least", [(1, 0.4, 20), (2, 0.8, 5), (3, 0.6, 1)])
def test_brute_force(spark, seed, t, least):
    data = texts(seed)
    assert found(spark, data, t, least) == brute(data, t, least)


def test_hot_shingles(spark, monkeypatch):
    """Blocks of a hot shingle give the same pairs as one group."""
    monkeypatch.setattr(neardup, "HOT", 8)
    data = texts(4)
    assert found(spark, data, 0.4, 20) == brute(data, 0.4, 20)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, content string, class_id string")
    pairs, sets = neardup.near_pairs(df)
    assert pairs.count() == 0 and sets.count() == 0 and sets.columns == ["id", "class_id", "n_shingles"]


def test_versions(spark):
    """Only the newest version of a key is compared; a null key replaces nothing."""
    w = [f"w{i}" for i in range(40)]
    old, new, other, loose = (" ".join(x) for x in (w, [f"v{i}" for i in range(30)], w[:39] + ["x"], w[1:] + ["y"]))
    df = spark.createDataFrame([("a", 1, old), ("a", 2, new), ("b", 1, other), (None, 1, loose), ("c", 1, new), ("c", 2, None)], "url string, at long, content string")
    pairs, sets = neardup.near_pairs(df.repartition(3), "content", 0.4, 5, 20, version=("url", "at"))
    by = {r.class_id: (r.url, r.at) for r in sets.collect() if r.class_id is not None and (r.url, r.at) != ("c", 1)}
    assert {frozenset((by[r.class_a], by[r.class_b])) for r in pairs.collect()} == {frozenset((("b", 1), (None, 1)))}
    assert sets.where("url = 'a' AND at = 1 AND class_id IS NOT NULL").count() == 1


def test_ring_keeps_what_is_within_budget():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(5, 400))
        a = rng.integers(0, 1 << 40, n).astype(np.uint64)
        k = int(rng.integers(0, n))
        b = np.concatenate((a[k:], rng.integers(0, 1 << 40, int(rng.integers(0, n))).astype(np.uint64)))
        d = len(set(a.tolist()) ^ set(b.tolist()))
        both = neardup.signatures(np.concatenate((a, b)), np.repeat([0, 2], [len(a), len(b)]), np.array([len(a), 0, len(b)])).to_pylist()
        assert both[1] is None or len(a) == 0
        x, y = (neardup.unpacked(v) if v else np.zeros(256, np.uint8) for v in (both[0], both[2]))
        assert neardup.ring_pass(x, y, d)


def test_ring_drops_what_is_far(spark):
    """Pairs that agree in a rare shingle alone don't get as far as their sets."""
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 40, 200).astype(np.uint64) for _ in range(2))
    b[0] = a[0]
    x, y = (neardup.unpacked(v) for v in neardup.signatures(np.concatenate((a, b)), np.repeat([0, 1], 200), np.array([200, 200])).to_pylist())
    assert not neardup.ring_pass(x, y, (1 - 0.8) / (1 + 0.8) * 400)


def test_sketch_never_counts_too_little(spark):
    cells = np.array([1, 1, 1, 5, 7, 7] + list(range(100, 200)) * 3, np.int64)
    p = bounded.Parts()
    parts = p.add(cells[:50]) + p.flush() + p.add(cells[50:]) + p.flush()
    df = spark.createDataFrame([(c, bytearray(x)) for c, x in parts], "chunk long, part binary")
    table = bounded.merged_sketch(df, 10).value
    assert bounded.levels(table, np.array([0, 1, 5, 7, 150])).tolist() == [0, 3, 1, 2, 3]
