"""Line reader, residue, statistics, stuffing and boilerplate on small pages."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import boilerplate, pagelines, quality, residue, stuffing, wholefit

PROSE = "The harvest in the valley was late this year, and most of the farmers had sold their carts before the storm. "
URL = "https://www.site.example/a"


def page(*parts):
    return "\n".join(parts)


ARTICLE = page("* Home", "* Contact", "* River & Clock", "You are here: Home > River > Clock", "", "# A late harvest", "By A Writer, 3 May 2022", "", PROSE * 3, "", "Related articles", "The mill that nobody wanted", "[A bridge](https://site.example/9)", "", PROSE, "", "© 2020 Site. All rights reserved.")
LIST = page("Recipe", "", *[f"* {n} g flour{'' if n % 2 else ' cake'}" for n in range(30, 60)])
TABLE = page("Year 2001", "", "River;Bridge;Road", *[f"{n};n/a;{n * 7}.5" for n in range(900, 930)])
ERRORS = ["404 Not Found", "Page not found\nThe address /a/b could not be found on this server.", "Please enable JavaScript to run this app.", "Dear {{ name }}, your order of {{ product }} is ready.\nBuy {{ product }} in {{ city }}.", "Access denied\nYou do not have permission to open /x.", "This site is under construction.", "Welcome to undefined, the home of null.\nSee NaN near null."]
STUFFED = page("Cheap carts", "", "Cheap carts, quality carts, fast carts: ask us about cheap carts. " * 8, "Buy cheap carts from the cheap carts experts, because cheap carts means cheap carts. " * 8)
LINKS = page(*[f"- [Word {n}](https://other{n}.example/{n})" for n in range(20)])
TAGS = " | ".join(f"word{n} | nameRiver | thing{n % 9}" for n in range(10, 40))


def corpus():
    rows = []
    for i in range(60):
        rows.append((f"https://h{i % 7}.example/p{i}", ARTICLE.replace("A late", "A late" + chr(97 + i % 26) * (1 + i // 26)).replace("A Writer", "A " + chr(65 + i % 26) * (2 + i // 26)), 1000 + i))
    for i, e in enumerate(ERRORS * 4):
        rows.append((f"https://h{i % 7}.example/e{i}", e, 1000 + i))
    named = {"list": LIST, "table": TABLE, "stuffed": STUFFED, "links": LINKS, "tags": TAGS, "blank": "  \n", "empty": "", "null": None}
    rows += [(f"https://x.example/{k}", v, 1) for k, v in named.items()]
    rows += [("https://x.example/stuffed", "old text", 0), ("https://x.example/list", LIST, 1), (None, ARTICLE, 1), ("not a url", ARTICLE, 1)]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(corpus(), "url string, content string, created_at long").withColumn("residue", F.lit(1)).cache()


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([("en", w, i) for i, w in enumerate("the a and of to in is was had this most their before because from we us".split())] + [(None, "x", 1), ("en", None, 2)], "lang string, word string, rank_no long")


def test_reader():
    got = {no: v for no, _, v, _, _ in pagelines.read(ARTICLE, URL)}
    assert [got[i] for i in (0, 1, 2)] == ["M"] * 3 and got[3] == "N" and got[5] == got[6] == got[8] == ""
    assert (got[10], got[11], got[12]) == ("H", "I", "I") and got[14] == "" and got[16] == "N"
    assert pagelines.read("", None) == [] and pagelines.read("\r\n\r\n", "bad url") == []
    assert not any(v for _, _, v, _, _ in pagelines.read(LIST, URL) + pagelines.read(LINKS, URL) + pagelines.read(TABLE, URL))


def found(df, column):
    return {r.url.rsplit("/", 1)[-1] for r in df.where(column).collect()}


def test_residue(spark, pages):
    got = residue.score_pages(pages)
    assert {f"e{i}" for i in range(28)} == found(got, "residue")
    assert got.count() == got.select("url").distinct().count() and got.where("url IS NULL").count() == 0
    assert residue.score_pages(pages.limit(0)).count() == 0


def test_statistics(spark, pages, common):
    got = quality.page_statistics(pages, common)
    assert {"list", "table", "links", "tags"} <= found(got, "structure") <= {"list", "table", "links", "tags", "stuffed"}
    r = {x.url: x for x in got.collect()}
    assert r["https://x.example/null"].words == 0 and r["https://x.example/blank"].profile is None
    assert r["https://h0.example/p0"].common_share > 0.2 and r["https://h0.example/p0"].profile.startswith("prose")
    assert quality.page_statistics(pages.limit(0), common.limit(0)).count() == 0


def test_statistics_of_all_pages(spark, pages, common):
    """Profiles and the line model come from every page, long ones too, and the model is that of all pages at once."""
    long = page(*[PROSE] * 400)
    rows = [(f"https://long.example/{i}", long, 1) for i in range(5)] + [("https://short.example/", "1999", 1)]
    got = quality.page_statistics(spark.createDataFrame(rows, "url string, content string, created_at long").repartition(3), common).collect()
    assert {r.profile for r in got if "long" in r.url} == {"prose_en"} and not any(r.structure for r in got if "long" in r.url)
    every = sorted({u: c for u, c, at in sorted(corpus(), key=lambda r: r[2]) if u and c}.items())
    model = residue.fit(every)
    want = {u: residue.judge(residue.own_lines(c, u), model)[0] for u, c in every}
    for parts in (1, 5):
        assert {r.url: r.residue for r in quality.page_statistics(pages.repartition(parts), common).collect() if r.url in want} == want


MARKED = [
    "{{ x y }}", "${a b}", "{a.b}", "[[a b]]", "%ABC%", "<% a %>", "__ABC__", "[INSERT NAME]", "[object Object]", "undefined", "NaN", "null", "TODO", "xxx", "lorem", "ipsum", "asdf", "qwer", "blah", "test test", "abc abc", "xxx xxxx",
    "404", "Error 503 Service Unavailable", "http 404 Not", "page not found", "access denied", "too many requests", "internal server error", "bad gateway", "gateway timed", "timed out", "unavailable", "under construction",
    "coming soon", "is parked", "maintenance", "please enable the javascript", "turn on scripts", "disabled script", "javascript is disabled", "verify that you are human", "checking your browser", "nicht gefunden", "zugriff verweigert",
    "serverfehler", "zu viele anfragen", "wartungsarbeiten", "im aufbau", "aktivieren sie javascript", "ohne skripte", "kein inhalt vorhanden", "beispieltext", "platzhalter", "no encontrada", "acceso denegado", "error interno",
    "demasiadas peticiones", "demasiadas solicitudes", "en construcción", "en mantenimiento", "active javascript", "sin scripts", "su texto aquí", "de ejemplo para", "introuvable", "accès refusé", "erreur interne", "trop de requêtes",
    "en maintenance", "activez javascript", "sans scripts", "votre texte ici", "texte d'exemple", "dummy paragraph", "sample text", "your headline here", "text text text", "placeholder",
]


def test_keys_of_lines(monkeypatch):
    """Lines of a batch have the keys, marks and counts of residue; each run without white space is read once, and marks
    are looked for only in lines that may have one."""
    odd = ["\x00 a b", "a_b {{ x }} c", "x9y8z7 A1b2C3 q7q8", "deadbee1 /p/q aBc9", "$$$ ### %%%", "²³ ½ x²", "Étä L'été-là", "(Hello), 'World'! 12,3.4 5xx", "McLeod NaN nAn XXX ToDo USA", "a\xa0b c\x1cd", "UNDER CONſTRUCTION", "SıN SCRıPTS", "٤04 x"]
    pages = [[PROSE] * 4, [PROSE.strip(), *odd], odd, [], *[[x] for x in odd], [odd[0], odd[0], "b a b"], *[[y, "Other words"] for x in MARKED for y in (x, x.upper())], ["A b c", "The a b"] * 20]
    n_token, n_search, real = Counter(), Counter(), (residue.token, residue.MARKS)
    monkeypatch.setattr(residue, "token", lambda x: n_token.update([x]) or real[0](x))
    monkeypatch.setattr(residue, "MARKS", type("", (), {"search": staticmethod(lambda t: n_search.update([t]) or real[1].search(t))}))
    w, got = wholefit.Words(), []
    for i in range(0, len(pages), 50):
        r = wholefit._records(pages[i : i + 50], w)
        got.append(wholefit._counted(r))
        line, code, _ = wholefit._keys(r)
        keys = [set() for _ in r["each"]]
        for at, a, b in zip(line.tolist(), *[x.tolist() for x in np.divmod(code, len(r["hash"]) + 1)]):
            keys[at].add(" ".join(w.names[r["used"][k]] for k in ([a, b - 1] if b else [a])))
        for page_, sure in zip(pages[i : i + 50], r["trusted"]):
            f, total = [residue.features(t) for t in page_], sum(map(residue.words, page_))
            long = [t for t, x in zip(page_, f) if len(x) >= residue.RUNNING]
            m = [x[:1] != ["~"] and bool(real[1].search(t)) for t, x in zip(page_, f)]
            settled = not page_ or total > residue.FEW and bool(long) and not real[1].search(min(long, key=len))
            m = [not settled and x for x in m]
            want = [{"~"} if "~" in x else residue.keys(x, total <= residue.FEW, y and total <= residue.FEW) for x, y in zip(f, m)]
            assert [keys.pop(0) for _ in page_] == want and bool(sure) == (not settled and residue.trusted(f, m, total)), page_
    assert max(n_token.values()) == 1 and PROSE not in n_search and all(real[1].search(x) for x in MARKED)
    code, records, lines = wholefit._added(*map(np.concatenate, zip(*got)))
    counted = {}
    for _, _, part, _ in wholefit._shards(code, records, lines, w):
        x, r, n = wholefit._unpack(part)
        counted |= dict(zip(x.split("\n"), zip(r.tolist(), n.tolist()), strict=True))
    assert counted["the harvest"] == (2, 2) and len(counted) == len(code)
    x = np.array([1 << 40, 5, 5, 1 << 40]), np.array([7, 1 << 39, 1 << 39, 7])
    assert [v.tolist() for v in wholefit._distinct(*x, 1 << 40)] == [[5, 1 << 40], [1 << 39, 7], [2, 2]]


def test_features_of_many_runs(monkeypatch, spark, pages, common):
    """A task that gives its counts out again and again gives the same pages."""
    want = sorted(quality.page_statistics(pages, common).collect())
    monkeypatch.setattr(wholefit, "HELD", 50)
    assert sorted(quality.page_statistics(pages, common).collect()) == want


def test_divergence():
    import numpy as np

    p = np.array([[0.5, 0.5, 0], [0, 0, 1.0]])
    d = quality.divergence(p, p)
    assert abs(d[0, 0]) < 1e-12 and abs(d[0, 1] - 1) < 1e-12


def test_stuffing(spark, pages, common):
    got = stuffing.stuffed_pages(pages, common)
    assert found(got, "spam") == {"stuffed", "links", "tags"}
    assert stuffing.stuffed_pages(pages.limit(0), common).count() == 0


def test_stuffing_of_all_pages(spark, common):
    """The model and its normal range come from every page, long ones too."""
    import numpy as np

    part = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda n: "".join(part[n // 60**k % 60] for k in range(3))
    lines = [f"The {word(9 * n)} of the {word(9 * n + 1)} was in {word(9 * n + 2)} and most of their {word(9 * n + 3)} had {word(9 * n + 4)} before this {word(9 * n + 5)}." for n in range(900)]
    long = [page(*lines[i:], *lines[:i]) for i in range(25)]
    assert min(map(len, long)) > residue.SAMPLE_CHARS
    rows = [(f"https://long.example/{i}", x, 1) for i, x in enumerate(long)] + [("https://x.example/stuffed", STUFFED, 1)]
    got = {r.url: r for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "url string, content string, created_at long").repartition(3), common).collect()}
    assert [u for u, r in got.items() if r.spam] == ["https://x.example/stuffed"] and [u for u, r in got.items() if r.abnormal] == ["https://x.example/stuffed"]
    x = np.array([3, 1, 1, 7, 9, 4])
    assert all(abs(stuffing.quantile(*np.unique(x, return_counts=True), q) - np.quantile(x, q)) < 1e-12 for q in (0.01, 0.3, 0.99))


def test_stuffing_measures_once(monkeypatch, spark, pages, common):
    """Each page is measured once, for the normal range and for its verdict."""
    measured, real = spark.sparkContext.accumulator(0), stuffing.measures
    monkeypatch.setattr(stuffing, "measures", lambda kept, model: measured.add(len(kept["many"])) or real(kept, model))
    got = stuffing.stuffed_pages(pages, common)
    assert found(got, "spam") == {"stuffed", "links", "tags"} and measured.value == got.count()


def test_stuffing_kinds(spark, common):
    """Each form of stuffing, beside honest pages that repeat themselves."""
    towns = ["Arle", "Bonsk", "Corva", "Dunst", "Elmar", "Fenby", "Gorst", "Hilda", "Ivorn", "Jaska", "Kolm", "Lunde"]
    spam = {
        "hashtags": " ".join(f"#river{n} #mill #bridgeArle" for n in range(20)),
        "capital_tags": " · ".join(f"Brücke{n} · LagerArle · Mühle" for n in range(20)),
        "one_word": page(*[f"> Removals {t} {u}" for t in towns for u in towns[:5]]),
        "phrase": page(*[f"- discount clock {t}" for t in towns * 4]),
        "list": "; ".join(["best old clock", "cheap clock", "cheap clock near mill", "best old clock"] * 20),
        "bare": page(*[f"http://www.{t.lower()}.example/{n}" for n, t in enumerate(towns)]),
    }
    honest = {
        "described": page(*[f"[The mill of {t}](https://{t.lower()}.example/) was the oldest of their mills, and most of the carts had to pass it in the storm of that year." for t in towns]),
        "styles": page(*[f".{t.lower()}-{n}{{margin:{n}px;color:#a{n}b{n}c;width:{n}%}}" for n, t in enumerate(towns * 3)]),
        "timetable": page(*[f"- {n}:15 {t} {u}" for n, t in enumerate(towns) for u in towns[:3]]),
        "table": page(*[f"{t};n/a;{n};{n}.5" for n, t in enumerate(towns * 3)]),
    }
    rows = [(u, c, at) for u, c, at in corpus() if u and "/p" in u] + [(f"https://{k}.example/{k}", v, 1) for k, v in (spam | honest).items()]
    got = stuffing.stuffed_pages(spark.createDataFrame(rows, "url string, content string, created_at long"), common)
    assert found(got, "spam") == set(spam)


def test_sample(spark):
    """A url with most of the rows, and a row repeated many times, leave room for the others, in any order."""
    rows = [(f"https://a.example/{i}", f"text {i}", i) for i in range(300)] + [("https://hot.example/", f"text {i}", i) for i in range(400)] + [("https://again.example/", "same", 5)] * 400
    df = spark.createDataFrame(rows, "url string, content string, created_at long")
    got = residue.sample(df, 50)
    assert got.both() == residue.sample(df.orderBy(F.rand(3)).repartition(7), 50).both()
    assert 5 <= len(got.general) <= 50 and len({u for u, _ in got.general}) == len(got.general) and 5 <= len(got.short) <= 50
    assert sum(u.startswith("https://a.") for u, _ in got.both()) >= 10
    assert residue.sample(df.limit(0), 50).both() == []


def test_words_of_notices_in_bodies(spark):
    """Body sentences with the words of notices stay; notices of any length fall, locally and by votes."""
    mine = ["The bakery sells fresh cookies every morning to the farmers.", "Her weekly newsletter reached two thousand farmers in 1990.", "The letter said that all rights reserved for the mill were void."]
    notice = "We use cookies " + "to remember your settings, to count visits and to show fitting adverts, " * 8 + "as you may like."
    text = page(notice, "", "# A title", PROSE, "", *[x for m in mine for x in (m, "")], PROSE, "", "Newsletter bestellen", "", "© 2020 Site. All rights reserved.")
    got = {no: v for no, _, v, _, _ in pagelines.read(text, URL)}
    assert [no for no, v in got.items() if v] == [0, 13, 15]
    alone = [(f"https://a{i}.example/{i}", x, 1) for i, x in enumerate(mine)]
    many = [(f"https://b.example/{i}", text.replace("A title", f"Title {chr(97 + i)}"), 1) for i in range(12)]
    found_ = {(r.url, r.line_no) for r in boilerplate.furniture_lines(spark.createDataFrame(alone + many, "url string, content string, created_at long")).collect()}
    assert not any(u.startswith("https://a") for u, _ in found_) and {n for _, n in found_} >= {0, 13, 15}


def test_general_paths(spark):
    """A notice that only one page has falls where notices of its kind and place win elsewhere, and items follow their heading."""
    rows = []
    for h in range(12):
        for i in range(10):
            rows.append((f"https://h{h}.example/{i}", page(f"You are here: Weirs {h} / Locks {h} / {PROSE[i * 4: i * 4 + 9].strip()}", "", f"Title {h} {chr(97 + i)}", PROSE.replace("valley", f"valley of {chr(97 + h)}{chr(97 + i)}"), "", "Related articles", f"The weir that {chr(97 + h)}{chr(97 + i)} built", "", "Leave a reply"), 1))
    rows.append(("https://other.example/1", page("Title", PROSE, "", "Be the first to comment"), 1))
    got = {}
    for r in boilerplate.furniture_lines(spark.createDataFrame(rows, "url string, content string, created_at long")).collect():
        got.setdefault(r.url, []).append(r.line_no)
    assert sorted(got.pop("https://other.example/1")) == [3]
    assert {tuple(sorted(v)) for v in got.values()} == {(0, 5, 6, 8)} and len(got) == 120


def test_boilerplate(spark, pages):
    got = {(r.url, r.line_no) for r in boilerplate.furniture_lines(pages).collect()}
    lines = sorted(n for u, n in got if u == "https://h0.example/p0")
    assert lines == [0, 1, 2, 3, 10, 11, 12, 16]
    assert not any("x.example" in u or "/e" in u.rsplit("example", 1)[-1] for u, _ in got)
    b = boilerplate.bodies(pages).where("url = 'https://h0.example/p0'").orderBy("line_no").collect()
    assert [r.line_no for r in b] == [5, 6, 8, 14]
    assert boilerplate.furniture_lines(pages.limit(0)).count() == 0


def test_votes(spark):
    """A line that only this host has, on most of its pages, falls to the vote; a line of few pages does not."""
    rows = [(f"https://a.example/{i}", page("House rules of the place", f"Title {chr(97 + i)}", "", PROSE * 2), i) for i in range(8)]
    got = boilerplate.furniture_lines(spark.createDataFrame(rows, "url string, content string, created_at long")).collect()
    assert {(r.url, r.line_no) for r in got} == {(u, 0) for u, _, _ in rows}


def test_votes_of_sentences(spark):
    """Notices in sentence form, long lines and rows of unknown labels or links fall to the vote, sentences of few pages do not."""
    notice = "Our partners may look at how you read this place."
    long = "Readers of this place are asked to keep the peace of the valley and to write to the keeper about whatever they miss, " * 2 + "at any hour"
    rows_ = ["Weirs | Sluices | Locks", "[Weirs and locks](https://elsewhere.example/weirs)"]
    rows = []
    for i in range(20):
        own = PROSE.replace("valley", "valley of " + chr(97 + i) * 4)
        rows.append((f"https://b.example/{i}", page(notice, f"Title {chr(97 + i)}", "", own, "The refrain of four pages is sung here." if i < 4 else own * 2, "", long, "", *rows_), i))
    got = {}
    for r in boilerplate.furniture_lines(spark.createDataFrame(rows, "url string, content string, created_at long")).collect():
        got.setdefault(r.url, []).append(r.line_no)
    assert {u: sorted(n) for u, n in got.items()} == {u: [0, 6, 8, 9] for u, _, _ in rows}
