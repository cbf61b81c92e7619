"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import boilerplate, leakage, mojibake, neardup, quality, residue, splitting, stuffing, tokenize
from sievelight.llm.bounded import bits_for, member_bitmap
from sievelight.operators.graph import connected_components
from sievelight.session import materialize, table

#: Similarity from which two pages count as duplicates in p3_found; p3_groups takes 0.8.
PAGE_SIMILARITY = 0.4
LEAST_TOKENS = 20
#: Parts of a hot class in p3_found at most.
MOST_SALTS = 256


def p1_signals(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_statistics(table(spark, d, "page_cache"), table(spark, d, "common_words"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_signals(spark, d).where("structure").select("url")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, d, "page_cache"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.bodies(table(spark, d, "page_cache"))


def _host(url: str):
    """The host as SQL: lower case, no user, port or leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of urls; copies are paired through their classes (pairs of classes are found once). Error and placeholder
    pages are looked for only among the urls that would be in a pair."""
    pages = table(spark, d, "page_cache").select("url", "created_at", "content").where(F.col("url").isNotNull())
    pairs, sets = neardup.near_pairs(pages, "content", PAGE_SIMILARITY, 5, LEAST_TOKENS, version=("url", "created_at"))
    pairs = materialize(pairs.select("class_a", "class_b"))
    every = materialize(residue.latest(sets).where(F.col("class_id").isNotNull()).select("url", "class_id", _host("url").alias("host")))
    copies = every.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    wanted = pairs.select(F.col("class_a").alias("class_id")).union(pairs.select("class_b")).union(copies).distinct()
    members = materialize(every.join(wanted, "class_id"))
    among = member_bitmap(members.select(F.xxhash64("url").alias("h")), "h", bits_for(8 * members.count(), *neardup.BITMAP_BITS))
    flagged = residue.score_pages(table(spark, d, "page_cache"), among=among).where("residue").select("url")
    kept = materialize(members.join(flagged, "url", "left_anti"))
    # a class with a thousandth of the urls or more is split: its rows by salt, its partners once for each salt
    sizes = kept.groupBy("class_id").agg(F.count("*").alias("n"))
    hot = materialize(sizes.crossJoin(F.broadcast(kept.agg(F.count("*").alias("of")))).where("n >= 0.001 * of AND n > 100").select("class_id", F.ceil(F.col("n") / 100).cast("int").alias("salts")))
    salts = F.least(F.coalesce("salts", F.lit(1)), F.lit(MOST_SALTS))
    split = kept.join(F.broadcast(hot), "class_id", "left")
    a = split.select(F.col("url").alias("ua"), F.col("class_id").alias("class_a"), F.col("host").alias("ha"), F.pmod(F.xxhash64("url"), salts).cast("int").alias("salt"))
    b = kept.select(F.col("url").alias("ub"), F.col("class_id").alias("class_b"), F.col("host").alias("hb"))
    again = split.select(F.col("url").alias("ub"), F.col("class_id").alias("class_a"), F.col("host").alias("hb"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    spread = pairs.join(F.broadcast(hot.withColumnRenamed("class_id", "class_a")), "class_a", "left").select("class_a", "class_b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    between = spread.join(a, ["class_a", "salt"]).join(b, "class_b").where("ha != hb")
    within = a.join(again, ["class_a", "salt"]).where("ua < ub AND ha != hb")
    return between.select("ua", "ub").union(within.select("ua", "ub")).select(F.least("ua", "ub").alias("url_a"), F.greatest("ua", "ub").alias("url_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per url: its class (same shingles), its group at similarity 0.8 (the least class in it) and its class's
    number of links to other classes; null for contents without five tokens."""
    pages = table(spark, d, "page_cache").select("url", "created_at", "content").where(F.col("url").isNotNull())
    pairs, every = neardup.near_pairs(pages, "content", 0.8, 5, 5, version=("url", "created_at"))
    sets = materialize(residue.latest(every))
    current = sets.select("class_id").where("class_id IS NOT NULL").distinct()
    links = materialize(pairs.join(current.withColumnRenamed("class_id", "class_a"), "class_a", "left_semi").join(current.withColumnRenamed("class_id", "class_b"), "class_b", "left_semi").select(F.col("class_a").alias("src"), F.col("class_b").alias("dst")))
    degree = links.select("src").union(links.select("dst")).groupBy("src").agg(F.count("*").alias("n_links"))
    group = connected_components(links)
    return (
        sets.join(group.select(F.col("node").alias("class_id"), F.col("component").alias("grp")), "class_id", "left")
        .join(degree.withColumnRenamed("src", "class_id"), "class_id", "left")
        .select("url", "class_id", F.coalesce("grp", "class_id").alias("group_id"), F.when(F.col("class_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.stretches(table(spark, d, "page_cache")).where(F.col("longest_stretch") > splitting.LIMIT).select("url")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every page (latest row) and passage longer than the ceiling; source tells which."""
    pages = residue.latest(table(spark, d, "page_cache").select("url", "created_at", "content").where(F.col("url").isNotNull()))
    long = pages.where(F.length("content") > splitting.LIMIT).select("url", F.lit(-1).cast("long").alias("passage_no"), F.col("content").alias("text"))
    passages = table(spark, d, "passages").select("url", "passage_no", "text").where(F.length("text") > splitting.LIMIT).dropDuplicates()
    return splitting.split_texts(long.union(passages), ["url", "passage_no"], "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.score_pages(table(spark, d, "page_cache")).where("residue").select("url")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "page_cache"), table(spark, d, "common_words")).where("spam").select("url")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that leak no item."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(p8_found(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repairs(table(spark, d, "documents")).select("doc_id")


def p9_repairs(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repairs(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_signals, p2_found, p2_bodies, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p6_found, p7_ids, p8_found, p8_clean, p9_found, p9_repairs)}

