"""Main body of pages: consensus over hosts on the paths of their containers.

Each page's lines are read into containers and scored locally (pagelines): wording and form give a hint, never a
verdict. Containers have paths at three levels of generality, and the pages vote on each:

* the path on the host: a label, or the line with its digits masked. It wins if it stands on too large a part of the
  host's pages to belong to any one body, or if its places are mostly hinted at;
* the path on the web: the line with the site's own name masked too. It wins if it is mostly hinted at and stands on
  several hosts;
* the general path: kind of hint, form and place on the page. It wins if most of the paths it holds win on hosts that
  have pages enough to vote.

A line is furniture if one of its paths wins, of several labels all, or half where the line is hinted at (the last step
of a breadcrumb is the page's own); items of a list of other articles fall with the heading of the list. Only
where a general path cannot be voted on, since too few pages hold it, does the hint decide by itself. Lines of any
length and ending vote. Sentences, long lines, links and rows with separators vote as whole lines and need a larger
part of the host's pages, for a body may repeat a sentence; they stay where most of their pages would keep hardly any
text of their own: these pages are copies of one body. Votes are counted with partial aggregation over
the host and path, which one hash of 64 bits stands for.
Hosts with a thousandth of all pages or more (at most a thousand of them) are split by salt in proportion to their
pages. Null and blank contents have no lines; a url is judged on its latest row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import residue
from sievelight.llm.pagelines import crumbs, generalised, host_of, masked, read, running
from sievelight.session import materialize

#: Urls of a host that must hold a path before it can win.
LEAST_PAGES = 4
#: Part of a path's places with a hint, or part of all pages of the host, from which it wins.
AGREED = 0.5
SPREAD = 0.1
#: The same part for whole lines: sentences, links, rows with separators and lines of more than SHORT characters.
WHOLE_SPREAD = 0.25
SHORT = 120
#: Hosts that must hold a path before it wins on the web.
LEAST_HOSTS = 5
#: Pages of hosts with ENOUGH pages that must hold a general path before it is voted on.
ENOUGH = 2 * LEAST_PAGES
LEAST_PLACES = 20
#: A page is a copy if its open text that stays is less than this part of the whole lines that would fall.
OWN = 0.5
#: Hosts with this part of all pages are hot; a hot host has SALTS salts for each such part.
HOT = 0.001
SALTS = 4
WEB_SALTS = 32

HINTS = "NCHIM"
PLACES = ("before", "within", "after", "without")
FORMS = ("", "whole", "b", "l", "x", "s", "p")
#: Kind of votes that are hinted at but say nothing on a general path.
HINTED = len(HINTS) * len(PLACES) * len(FORMS)


def _key(path: str, whole: bool = False, label: bool = False, seed: int = 0) -> int:
    """Hash of a path, for one host by its seed; its last bits tell a whole line and a label."""
    return (xxhash.xxh64_intdigest(path, seed) & ~3 | whole | label << 1) - (1 << 63)


def _whole(t: str, form: str) -> bool:
    return len(t) > SHORT or t[-1] in ".!?" or form in ("l", "x") or (form != "" and any(x in t for x in "|;\t"))


def _is_whole(path: str) -> Column:
    return F.col(path).bitwiseAND(F.lit(1)) == 1


_LINES = "array<struct<line:int,size:int,kind:int,head:int,paths:array<bigint>>>"
_VOTES = "array<struct<path:bigint,web:bigint,kind:int>>"


class _Rows:
    """Lines and votes of pages as flat columns."""

    def __init__(self):
        self.hosts: list[str] = []
        self.lines: tuple[list[int], ...] = ([], [], [], [])
        self.paths: list[int] = []
        self.n_paths, self.n_lines, self.n_votes = [0], [0], [0]
        self.votes: tuple[list[int], ...] = ([], [], [])

    def add(self, url: str | None, content: str | None, model: residue.LineModel) -> None:
        """kind numbers the general path of a hinted line, -1 others; head is the line of the heading of an item, -1
        elsewhere. Lines of residue without a hint are the body and are left out."""
        host = host_of(url)
        seed = xxhash.xxh64_intdigest(host)
        lines = read(content, url) if content else []
        flag = residue.flagged([t for _, t, v, _, _ in lines if not v], model) if lines else False
        prose = [i for i, (_, t, v, _, _) in enumerate(lines) if not v and running(t)]
        numbers, sizes, kinds, heads = self.lines
        votes: dict[int, tuple[int, int]] = {}
        head = -1
        for i, (no, t, v, form, parts) in enumerate(lines):
            head = no if v == "H" else head if v == "I" else -1
            whole = _whole(t, form)
            kind = -1
            if v:
                if v == "N" and (trail := crumbs(t)):
                    form, parts = "s", trail
                place = 3 if not prose else 0 if i < prose[0] else 2 if i > prose[-1] else 1
                kind = (HINTS.index(v) * len(PLACES) + place) * len(FORMS) + (1 if whole and not form else FORMS.index(form))
            elif flag or not (t[0].isalpha() or any(map(str.isalpha, t))):
                continue
            labels = form != "" and not whole
            line = "" if labels else masked(t)
            paths = [_key(p, False, True, seed) for p in parts] if labels else [_key(line, whole, False, seed)]
            numbers.append(no)
            sizes.append(len(t))
            kinds.append(kind)
            heads.append(head if v == "I" else -1)
            self.paths += paths
            self.n_paths.append(len(self.paths))
            if v == "I":
                continue
            if not v:
                for p in paths:
                    votes.setdefault(p, (0, -1))
                continue
            for p in paths:
                votes[p] = (0 if labels else _key(generalised(line, host), whole), kind)
            if v == "M":
                # menus vote both by label and by line: the same one may be a menu on one page and open on another
                for p in [_key(masked(t), whole, False, seed)] if labels else [_key(p, False, True, seed) for p in parts]:
                    if votes.get(p, (0, -1))[1] < 0:
                        votes[p] = (0, HINTED)
        self.hosts.append(host)
        self.n_lines.append(len(numbers))
        for p, (w, k) in votes.items():
            self.votes[0].append(p)
            self.votes[1].append(w)
            self.votes[2].append(k)
        self.n_votes.append(len(self.votes[0]))

    def arrays(self) -> list[pa.Array]:
        at = lambda x: pa.array(x, pa.int32())
        paths = pa.ListArray.from_arrays(at(self.n_paths), pa.array(self.paths, pa.int64()))
        lines = pa.StructArray.from_arrays([*map(at, self.lines), paths], ["line", "size", "kind", "head", "paths"])
        votes = pa.StructArray.from_arrays([pa.array(self.votes[0], pa.int64()), pa.array(self.votes[1], pa.int64()), at(self.votes[2])], ["path", "web", "kind"])
        return [pa.array(self.hosts, pa.string()), pa.ListArray.from_arrays(at(self.n_lines), lines), pa.ListArray.from_arrays(at(self.n_votes), votes)]


def containers(pages: DataFrame, model: residue.LineModel | None = None) -> DataFrame:
    """One row per url (latest): host, its lines with their hints and paths, and its votes (one for each path;
    web is 0 for labels and lines without a hint)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or residue.train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = _Rows()
            for u, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.add(u, c, m)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *rows.arrays()], names=["url", "created_at", "host", "lines", "votes"])

    schema = f"url string, created_at long, host string, lines {_LINES}, votes {_VOTES}"
    rows = pages.select("url", "content", "created_at").where(F.col("url").isNotNull() & F.col("content").isNotNull()).mapInArrow(run, schema)
    return residue.latest(rows)


def hot_hosts(hosts: DataFrame) -> DataFrame:
    """(host, host_pages, salts) of the hosts with HOT of all pages or more: fewer than 1 / HOT rows."""
    total = hosts.agg(F.sum("host_pages").alias("n"))
    return hosts.crossJoin(F.broadcast(total)).where(F.col("host_pages") >= HOT * F.col("n")).select("host", "host_pages", F.ceil(SALTS * F.col("host_pages") / (HOT * F.col("n"))).cast("int").alias("salts"))


def winners(read_pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(winners, general, hot): the paths (with their host's hash) that won on their host or on the web; of each general path its
    places on hosts with pages enough and the part of them that won; the hot hosts."""
    votes = read_pages.select(F.explode("votes").alias("v"), F.xxhash64("host").alias("host"))
    counted = votes.groupBy(F.col("v.path").alias("path")).agg(F.count("*").alias("pages"), F.avg((F.col("v.kind") >= 0).cast("int")).alias("agreed"), F.min(F.when(F.col("v.kind") >= 0, F.col("v.kind"))).alias("kind"), F.max(F.when(F.col("v.kind") >= 0, F.col("v.web"))).alias("web"), F.min("host").alias("host"))
    # the others can't win, whatever their host
    counted = materialize(counted.where((F.col("pages") >= LEAST_PAGES) | F.col("kind").isNotNull()))
    hosts = read_pages.groupBy(F.xxhash64("host").alias("host")).agg(F.count("*").alias("host_pages"))
    hot = materialize(hot_hosts(hosts))
    joined = counted.join(F.broadcast(hot.select("host", F.col("host_pages").alias("many"))), "host", "left")
    sized = joined.where("many IS NOT NULL").withColumn("host_pages", F.col("many")).unionByName(joined.where("many IS NULL").join(hosts, "host"))
    web = counted.where("web != 0 AND kind IS NOT NULL").groupBy("web").agg(F.count("*").alias("n"), (F.sum(F.col("agreed") * F.col("pages")) / F.sum("pages")).alias("agreed")).where((F.col("n") >= LEAST_HOSTS) & (F.col("agreed") >= AGREED))
    web = web.select("web", F.lit(True).alias("on_web"), F.explode(F.sequence(F.lit(0), F.lit(WEB_SALTS - 1))).alias("salt"))
    spread = F.when(_is_whole("path"), WHOLE_SPREAD).otherwise(SPREAD)
    on_host = (F.col("pages") >= LEAST_PAGES) & ((F.col("agreed") >= AGREED) | (F.col("pages") >= spread * F.col("host_pages")))
    voted = sized.withColumn("salt", F.pmod("host", F.lit(WEB_SALTS)).cast("int")).join(web, ["web", "salt"], "left").select("host", "path", "pages", F.coalesce("kind", F.lit(-1)).alias("kind"), "host_pages", (on_host | F.coalesce("on_web", F.lit(False))).alias("won"))
    voted = materialize(voted.where("won OR kind >= 0"))
    general = voted.where(F.col("kind").between(0, HINTED - 1) & (F.col("host_pages") >= ENOUGH)).groupBy("kind").agg(F.sum("pages").alias("places"), (F.sum(F.col("pages") * F.col("won").cast("int")) / F.sum("pages")).alias("part"))
    return voted.where("won").select("host", "path"), general, hot


def furniture_lines(pages: DataFrame, model: residue.LineModel | None = None) -> DataFrame:
    """(url, line_no) of every line that is no part of its page's own body."""
    seen = materialize(containers(pages, model))
    won, general, hot = winners(seen)
    # at most len(HINTS) * len(PLACES) * len(FORMS) general paths: those that were voted on and lost
    lost = [r.kind for r in general.where((F.col("places") >= LEAST_PLACES) & (F.col("part") < AGREED)).collect()]
    total = F.aggregate(F.filter("lines", lambda o: o["kind"] < 0), F.lit(0), lambda n, o: n + o["size"])
    falls = F.col("o.kind").isin(lost) == F.lit(False) if lost else F.lit(True)
    lines = seen.select("url", F.xxhash64("host").alias("host"), total.alias("total"), F.explode("lines").alias("o")).select("url", "host", "total", F.col("o.line").alias("line_no"), "o.size", "o.kind", "o.head", "o.paths", (F.col("o.kind") >= 0) & falls)
    lines = lines.toDF("url", "host", "total", "line_no", "size", "kind", "head", "paths", "general")
    fell = lines.where("head < 0 AND general").select("url", "line_no")
    items = seen.where(F.exists("lines", lambda o: o["head"] >= 0)).select("url", F.explode("lines").alias("o")).where("o.head >= 0").select("url", F.col("o.line").alias("line_no"), F.col("o.head").alias("head"))

    undecided = lines.where("head < 0 AND NOT general").join(F.broadcast(hot.select("host", "salts")), "host", "left")
    salts = F.coalesce("salts", F.lit(1))
    salted = undecided.select("url", "total", "line_no", "size", F.when((F.col("kind") >= 0) & (F.size("paths") > 2), F.size("paths") / 2).otherwise(F.size("paths")).alias("n"), F.pmod(F.xxhash64("url"), salts).cast("int").alias("salt"), F.explode("paths").alias("path"))
    spread = won.join(F.broadcast(hot.select("host", "salts")), "host", "left").select("path", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    voted = salted.join(spread, ["path", "salt"]).groupBy("url", "line_no", "n", "total", "size").agg(F.count("*").alias("k"), F.min("path").alias("path")).where(F.col("k") >= F.col("n"))
    voted = materialize(voted.select("url", "line_no", "path", "total", "size"))
    copies = voted.groupBy("url").agg((F.max("total") - F.sum("size") < OWN * F.sum(F.when(_is_whole("path"), F.col("size")).otherwise(0))).alias("copy"))
    copied = voted.where(_is_whole("path")).join(copies, "url").groupBy("path").agg(F.avg(F.col("copy").cast("int")).alias("part")).where("part > 0.5")
    fell = fell.union(voted.join(copied, "path", "left_anti").select("url", "line_no"))
    if lost:
        heads = fell.withColumnRenamed("line_no", "head")
        items = items.join(heads, ["url", "head"], "left_semi")
    return fell.union(items.select("url", "line_no")).select("url", F.col("line_no").cast("long").alias("line_no"))


def bodies(pages: DataFrame, model: residue.LineModel | None = None) -> DataFrame:
    """(url, line_no, line): the lines of each page's own body that are not blank, latest row of each url."""
    current = residue.latest(pages.select("url", "created_at", "content").where(F.col("url").isNotNull() & F.col("content").isNotNull()))
    removed = furniture_lines(pages, model).groupBy("url").agg(F.collect_set("line_no").alias("gone"))
    kept = current.join(removed, "url", "left").select("url", F.posexplode(F.split("content", "\n")).alias("line_no", "line"), F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"))
    line = F.regexp_replace("line", "\r$", "")
    return kept.where(~F.array_contains("gone", F.col("line_no").cast("long")) & (F.trim(F.regexp_replace("line", r"\s", " ")) != "")).select("url", F.col("line_no").cast("long").alias("line_no"), line.alias("line"))
