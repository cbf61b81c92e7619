"""Passages of pages and their ranking by BM25 with statistics of the page, not of the collection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from sievelight.functions import text as T

TARGET, CEILING = 500, 1_200
K1, B = 1.5, 0.75
EXPANSION = 1.5


def paragraphs(t: str) -> list[tuple[int, int]]:
    """Offsets of the paragraphs: a line goes on with the one before unless either is empty or it is white space that
    other lines follow; paragraphs of white space alone are left out."""
    lines = t.split("\n")
    out: list[list[int]] = []
    at, open_ = 0, False
    for i, x in enumerate(lines):
        end = at + len(x)
        if x and open_ and (x.strip() or i == len(lines) - 1):
            out[-1][1] = end
        elif x:
            out.append([at, end])
        open_ = bool(x)
        at = end + 1
    return [(a, b) for a, b in out if t[a:b].strip()]


def _trimmed(t: str, s: int, e: int) -> tuple[int, int]:
    x = t[s:e]
    s += len(x) - len(x.lstrip())
    return s, s + len(x.strip())


def passages_of(t: str | None) -> list[tuple[int, int]]:
    """Offsets of the passages: paragraphs packed up to TARGET characters; what is longer than CEILING is windowed at
    the last sentence end in its second half, else the last space, else hard."""
    blocks: list[tuple[int, int]] = []
    s = e = None
    for a, b in paragraphs(t or ""):
        if s is not None and (e - s) + (b - a) > TARGET:
            blocks.append((s, e))
            s = None
        s, e = (a if s is None else s), b
        if e - s >= TARGET:
            blocks.append((s, e))
            s = None
    if s is not None:
        blocks.append((s, e))
    out = []
    for a, b in blocks:
        while b - a > CEILING:
            part = t[a : a + CEILING]
            sentence = part.rfind(". ")
            cut = sentence + 1 if sentence > CEILING / 2 else part.rfind(" ")
            cut = cut if cut > 0 else CEILING
            out.append(_trimmed(t, a, a + cut))
            a += cut
        out.append(_trimmed(t, a, b))
    return [(a, b) for a, b in out if b > a]


def split(pages: DataFrame, text: str = "content") -> DataFrame:
    """keys (all columns but the text), passage_no from 0, passage, start_pos and end_pos of each passage.

    Null and blank texts have none. An Arrow map: a fold over the lines of a text copies its state with every line
    when written as a native aggregate."""
    keys = [c for c in pages.columns if c not in (text, "passage_no", "passage", "start_pos", "end_pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, texts, starts, ends = [], [], [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                for n, (s, e) in enumerate(passages_of(t)):
                    rows.append(i)
                    no.append(n)
                    texts.append(t[s:e])
                    starts.append(s)
                    ends.append(e)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[1:]], pa.array(no, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*keys, "passage_no", "passage", "start_pos", "end_pos"])

    schema = pages.select(*keys).schema
    for n, kind in (("passage_no", LongType()), ("passage", StringType()), ("start_pos", LongType()), ("end_pos", LongType())):
        schema = schema.add(n, kind)
    return pages.select(text, *keys).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def rank(passages: DataFrame, asked: DataFrame) -> DataFrame:
    """question_id, url, passage_no, score, expands, prank of the passages with a positive score.

    passages(url, passage_no, passage), unique by url and passage_no; asked(question_id, url, question), unique by both.
    Questions without a token rank nothing. Terms are joined on (url, term), so no page's passages meet in one row."""
    base = passages.select("url", "passage_no", "passage", T.passage_tokens(F.col("passage")).alias("tokens"))
    size = F.size("tokens")
    stats = base.groupBy("url").agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"))
    tf = base.select("url", "passage_no", size.alias("dl"), F.explode("tokens").alias("term")).groupBy("url", "passage_no", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("url", "term").agg(F.count("*").alias("df"))
    terms = asked.select("question_id", "url", F.explode(F.array_distinct(T.passage_tokens(F.col("question")))).alias("term"))
    weighed = terms.join(stats, "url").join(df, ["url", "term"], "left").select("question_id", "url", "term", "avgdl", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
    mean = weighed.groupBy("question_id", "url").agg(F.avg("idf").alias("mean_idf"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weighed.join(tf, ["url", "term"]).groupBy("question_id", "url", "passage_no").agg(F.sum(gain).alias("bm25"))

    # acronyms of the question that are query tokens and stand in some passage of the page
    named = asked.select("question_id", "url", "question", F.explode(F.filter(T.find_acronyms(F.col("question")), lambda a: F.array_contains(T.passage_tokens(F.col("question")), F.lower(a)))).alias("acronym"))
    in_play = named.join(tf.select("url", F.col("term")).distinct(), (named.url == tf.url) & (F.lower("acronym") == F.col("term")), "left_semi")
    spelled = in_play.join(base.where(size > 0).select("url", "passage_no", "passage"), "url").where(T.expands_acronym(F.col("passage"), F.col("acronym"))).select("question_id", "url", "passage_no", F.lit(True).alias("expands")).distinct()

    rows = scored.join(spelled, ["question_id", "url", "passage_no"], "full").join(mean, ["question_id", "url"]).join(asked.select("question_id", "url", "question"), ["question_id", "url"])
    expands = F.coalesce("expands", F.lit(False))
    score = F.coalesce("bm25", F.lit(0.0)) + F.when(expands, F.col("mean_idf") * EXPANSION).otherwise(0.0)
    rows = rows.select("question_id", "url", "passage_no", score.alias("score"), expands.alias("expands"), T.is_definition_query(F.col("question")).alias("definition")).where("score > 0")
    w = Window.partitionBy("question_id", "url").orderBy(F.desc(F.col("definition") & F.col("expands")), F.desc("score"), "passage_no")
    return rows.select("question_id", "url", "passage_no", "score", "expands", F.row_number().over(w).alias("prank"))


def select(passages: DataFrame, asked: DataFrame, limit: int = 2) -> DataFrame:
    """The first ``limit`` ranked passages of each question and page."""
    return rank(passages, asked).where(F.col("prank") <= limit)
