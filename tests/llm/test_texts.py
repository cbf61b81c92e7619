"""Splitting, tokenizing, leakage and encodings on small texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelight.llm import leakage, mojibake, splitting, tokenize

TEXT = st.text(alphabet=st.sampled_from(list("ab1 '\n\t.,é日😀\r -")), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_pieces(t):
    p = splitting.pieces(t, 50, 6)
    assert (not p) == (not t)
    if not p:
        return
    assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < e - s <= 50 for s, e, _ in p)
    for (a, b, kind), (c, _, _) in zip(p, p[1:]):
        assert a < c <= b and b - c <= 6
        if kind == "hard":
            assert not any(x.isspace() for x in t[a + 6 : b - 1])


def brute_stretch(t):
    marks = [i for i, c in enumerate(t) if c == "\n" or (c in ".!?" and i + 1 < len(t) and t[i + 1].isspace() and t[i + 1] not in "\x1c\x1d\x1e\x1f")]
    cuts = [-1, *marks, len(t)]
    return max(b - a - 1 for a, b in zip(cuts, cuts[1:]))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_stretch(t):
    assert splitting.longest_stretch(t) == brute_stretch(t)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_stretch_makes_a_piece(t):
    """Pieces at strict ends find every text with a stretch beyond the limit."""
    ends = splitting.strict_ends(t)
    kinds = {k for _, _, k in splitting.pieces(t, 30, 3, ends)}
    if brute_stretch(t) > 30:
        assert kinds & {"word", "hard"}


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_natural_end_first(t):
    """A piece is cut between words or hard only if it has no natural end beyond the overlap."""
    ends = splitting.boundaries(t)
    for s, e, kind in splitting.pieces(t, 50, 6):
        if kind in ("word", "hard"):
            assert not any(s + 6 < x <= s + 50 for _, at in ends[:3] for x in at)


def test_split(spark):
    df = spark.createDataFrame([("a", "x" * 3000, 1), ("b", "word " * 400, 2), ("c", "short", 3), ("d", "", 4), ("e", None, 5)], "url string, text string, piece int")
    got = splitting.split_texts(df, ["url"], "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.url, []).append(r)
    assert set(by) == {"a", "b", "c"} and {r.cut for r in by["a"]} == {"hard", "end"} and "hard" not in {r.cut for r in by["b"]}
    text = {r.url: r.text for r in df.collect()}
    assert all(text[r.url][r.start_pos : r.end_pos] == r.piece for r in got)
    with pytest.raises(ValueError):
        splitting.pieces("x" * 100, 10, 9)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 60))
def test_tree(t, n):
    leaves = [(t[i : i + n], tokenize.encode(t[i : i + n])) for i in range(0, len(t), n)]
    assert np.array_equal(tokenize.concatenate(leaves), tokenize.encode(t))


def test_tree_without_borders():
    t = "abcdefgh" * 700 + "é" * 300
    leaves = [(t[i : i + 97], tokenize.encode(t[i : i + 97])) for i in range(0, len(t), 97)]
    assert np.array_equal(tokenize.concatenate(leaves), tokenize.encode(t))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["abcdefgh", "etaoinshrdlu", "0123456789", "!?.,-+=/", "日本語文字列", "éàüßñ", "😀🎉👍", "abc'"]), st.integers(40, 400))
def test_tree_in_unsplit_text(seed, alphabet, leaf):
    """Long runs of one class of characters, where the pre-tokenizer never breaks."""
    rng = np.random.default_rng(seed)
    t = "so " + "".join(rng.choice(list(alphabet), 3000)) + " end"
    assert np.array_equal(tokenize.encode_text(t, leaf=leaf), tokenize.encode(t))


def test_windows_of_unsplit_text_stay_small(monkeypatch):
    """A join inside a long run re-encodes its window, not the halves."""
    rng = np.random.default_rng(3)
    a, b = ("".join(rng.choice(list("etaoinshrdlu"), 20000)) for _ in range(2))
    ids_a, ids_b, whole = tokenize.encode(a), tokenize.encode(b), tokenize.encode(a + b)
    seen = []
    real = tokenize.encode
    monkeypatch.setattr(tokenize, "encode", lambda t, path=tokenize.VOCABULARY: seen.append(len(t)) or real(t, path))
    assert np.array_equal(tokenize.join(a, ids_a, b, ids_b), whole) and sum(seen) < 2000


def test_ids(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    texts = ["", None, "﻿1\r\n<|endoftext|> é 😀", "word " * 500, "x" * 700, "  \n\n  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenize.token_ids(df, long=300, leaf=70).collect()}
    assert got == {i: ref.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert tokenize.token_ids(df.limit(0)).count() == 0


ITEM = "For many years the old miller has counted the carts that cross the narrow bridge, and nobody in the valley remembers a spring when fewer of them came back."


def cues(t, n=7):
    w = t.split()
    return "\n".join(f"{i + 1}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n<i>{' '.join(w[k : k + n])}</i>\n" for i, k in enumerate(range(0, len(w), n)))


def test_leaks(spark):
    w = ITEM.split()
    damaged = " ".join(x if i % 8 != 4 else "zzz" for i, x in enumerate(w))
    docs = {1: cues(ITEM), 2: cues("Hello there. " + damaged + " Goodbye."), 3: cues(" ".join(w[: len(w) // 2 + 2])), 4: cues(" ".join(w[:8])), 5: "nothing at all", 6: "", 7: None, 8: cues(ITEM.upper().replace("MANY", "MÄNY")), 9: cues("the old miller has the carts and the bridge in a spring")}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "An entirely different passage about a harbour, its lighthouse and the keeper who painted every one of its doors blue."), (12, None), (13, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, items).collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (8, 10)}
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_chains_beside_each_other():
    """The leaked half begins with words that also open the item; a stray phrase before it costs no words either."""
    w = [f"w{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(50)]
    w[25:29] = w[:4]
    items = leakage.Items([1], [" ".join(w)])
    half = " ".join(w[25:])
    got = leakage.find([half, "so " + " ".join(w[3:8]) + " then " + half, " ".join(w[25:33])], items)
    assert [(g[0], g[1], g[3]) for g in got] == [(0, 0, 50), (1, 0, 50)]


def test_clock_times():
    """Only times go, not the words on their line."""
    assert leakage.normal("at 10:30 he left").split() == b"at he left".split()
    for line in ("00:00:01,000 --> 00:00:02,500", "00:01.000 - -> 00:02.500 align:start position:10%", "00:00:01.000-->00:00:02.500 X1:40 X2:600"):
        assert leakage.normal(f"1\n{line}\nwell then\n").split() == leakage.normal(f"1 {line} well then").split() == b"well then".split()
    item = ITEM.replace("For many years", "At 10:30")
    items = leakage.Items([1], [item])
    assert [g[:2] for g in leakage.find([item, "1 00:00:01,000 --> 00:00:02,500 " + item, cues(item)], items)] == [(0, 0), (1, 0), (2, 0)]


def test_nothing_is_taken_out():
    """Items in a line with a time, in brackets or stars are found, as are items of a word or two; labels don't interrupt."""
    item = "the old miller counted every cart that crossed his narrow bridge in the spring of that long year"
    items = leakage.Items([1, 2, 3, 4], [item, "velvet harbour", "Quince", "three odd words"])
    docs = [f"so At 10:30 {item}", f"then ({item}) he said", f"[{item}]", "{" + item + "}", f"* {item} *", f"<{item}>", f"KEEPER OF THE OLD MILL: {item}", item.replace("cart", "cart [door slams]").replace("spring", "<i>spring</i>")]
    assert [g[:2] for g in leakage.find(docs, items)] == [(i, 0) for i in range(len(docs))]
    docs = ["a (velvet harbour) b", "velvet and harbour", "[Quince]", "*three odd words*", "three odd", "quinces", None, ""]
    assert sorted(g[:2] for g in leakage.find(docs, items)) == [(0, 1), (2, 2), (3, 3)]


def test_longest_matches():
    """Every match is as long as it can be, whatever follows its first four words, and the array is in full order."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(20)]
    items = leakage.Items([0, 1], [" ".join(rng.choice(words, 30)) for _ in range(2)])
    w = leakage.Words([leakage.normal(t) for t in texts])
    want = set()
    split = [t.split() for t in texts]
    for i in range(2):
        a = [x.decode() for x in items.text.list(int(items.text.bounds[i]), int(items.text.bounds[i + 1]))]
        for d, b in enumerate(split):
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and not (p and q and a[p - 1] == b[q - 1]):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                            n += 1
                        if n >= leakage.K:
                            want.add((d, i, p, int(w.bounds[d]) + q, n))
    assert set(zip(*(x.tolist() for x in leakage.longest_matches(w, items)))) == want and len({n for *_, n in want}) > 1
    from sievelight.llm.vector import grams

    g, _, at = grams(w.h, w.doc, leakage.K)
    order = at[leakage.suffix_array(w, at, g)]
    by = [tuple(int(x) for x in w.h[p : min(p + 16, w.bounds[w.doc[p] + 1])]) for p in order]
    runs = [b for b, a in zip(by[1:], [None, *by][1:]) if b == a]
    assert len(runs) == len(by) - len(set(by))  # equal stretches of sixteen words stand together: not so by the first four alone


def test_align_against_plain_table():
    def plain(item, doc):
        best, where = 0.0, (0, 0, 0)
        rows = [[(0.0, 0, 0)] * (len(doc) + 1)]
        for i, a in enumerate(item):
            row = [(0.0, i + 1, 0)]
            for j, b in enumerate(doc):
                s = 1.0 if a == b else 0.5 if a[0] == b[0] and leakage._close(a, b) else -0.9
                p = rows[-1][j]
                x = (p[0] + s, p[1], p[2] + (s > 0)) if p[0] > 0 else (s, i, int(s > 0))
                u, l = rows[-1][j + 1], row[-1]
                for c in ((u[0] - 0.9, u[1], u[2]), (l[0] - 0.6, l[1], l[2])):
                    if c[0] > x[0] + 1e-9:
                        x = c
                row.append(x if x[0] > 0 else (0.0, i + 1, 0))
                if row[-1][0] > best + 1e-9:
                    best, where = row[-1][0], (row[-1][1], i + 1, row[-1][2])
            rows.append(row)
        return best, where

    rng = np.random.default_rng(1)
    for _ in range(60):
        a = [bytes(f"{x}word", "ascii") for x in rng.integers(0, 9, 12)]
        b = [bytes(f"{x}word", "ascii") for x in rng.integers(0, 9, 25)]
        b[5:13] = a[2:10]
        best, where = plain(a, b)
        got = leakage.align(a, b)
        assert best > 0 and got[1] - got[0] > 0 and abs((got[1] - got[0]) - (where[1] - where[0])) <= 2
    assert leakage.align([], [b"x"]) == (0, 0, 0) and leakage.align([b"x"], []) == (0, 0, 0)


GOOD = ["Não sei, talvez amanhã. A canção é difícil.", "Où est l'élève ? Ça va être étrange.", "Wir müssen zurück, die Straße ist größer.", "¿Dónde está el año? Mañana, señor.", "Słyszysz książkę? Już idę, cześć.", "Послушай меня. Это был тёмный город."]


@pytest.mark.parametrize("true,wrong", [("utf-8", "cp1252"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "latin-1"), ("utf-8", "cp850")])
def test_restores(true, wrong):
    r = mojibake.Reader()
    for t in GOOD:
        bad = mojibake._decode(t.encode(true), wrong)
        found, fixed = r.text(bad)
        assert found and fixed == t, (t, bad, fixed)


def test_single_bytes():
    r = mojibake.Reader()
    for t, true, wrong in [(GOOD[1], "cp1252", "cp437"), (GOOD[3], "cp1252", "mac_roman"), (GOOD[4], "cp1250", "cp1252"), (GOOD[5], "koi8-r", "cp1251"), (GOOD[5], "cp1251", "cp1252")]:
        assert r.text(t.encode(true).decode(wrong, "replace"))[0]
    assert r.text("°Cuidado, señor!")[0]
    twice = "ÃƒÂ©tÃƒÂ©"
    assert r.text(twice) == (["utf-8>cp1252 twice"], "été")


def test_clean_texts():
    r = mojibake.Reader()
    for t in GOOD + ["It’s a naïve idea — à la carte… £15, ½ of 25°C", "♪ la la ♪ 😀", "x y", "What?! Why? Nein?Doch", "古い森を閉めた。", "Éc0ute-moi, Iittle page", "Où est-il ? Là.", "It is 25 °C, or 77 °F.", "ＤＡＳ ÖLLAGER", ""]:
        assert r.text(t) == ([], t), t


def test_lost_letters(spark):
    docs = [(1, "N?o sei, amanh? talvez"), (2, "�� �����"), (3, "? ?? ??????? ????"), (4, "Is it so? Yes"), (5, None), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = mojibake.repairs(df)
    assert {r.doc_id for r in got.collect()} == {1, 2, 3} and got.columns == ["doc_id", "states", "words", "restored"]
    assert mojibake.repairs(df.limit(0)).count() == 0


def test_every_place_of_a_long_run():
    """A wrong letter is found and restored wherever it stands in a run without spaces, at the borders of windows too."""
    r = mojibake.Reader()
    for n in [*range(50, 70), *range(mojibake.WINDOW - mojibake.EDGE - 4, mojibake.WINDOW - mojibake.EDGE + 5), *range(mojibake.WINDOW - 4, mojibake.WINDOW + 5)]:
        bad = "a" * n + "Ã©t" + "Ã©" * 2 + "b" * 70
        assert r.text(bad)[1] == "a" * n + "été" + "é" + "b" * 70, n
    long = "".join("éèü"[i % 3] + "bcd" for i in range(900))
    wrong = long.encode().decode("latin-1")
    assert r.text(wrong)[1] == long
