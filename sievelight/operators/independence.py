"""Independent sources among the pages of a call: same host or near-identical text joins two pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import urls as U
from sievelight.operators.graph import connected_components
from sievelight.session import materialize

SIMILARITY_NUMERATOR, SIMILARITY_DENOMINATOR = 4, 10
LEAST_TOKENS = 20
SHINGLE = 5


def text_pairs(docs: DataFrame, by: str = "call_id") -> DataFrame:
    """(by, a, b, common, size_a, size_b) of the pages a < b (by ord) of one call whose texts are alike.

    An equi-join on call and shingle; the bound on similarity is tested on integers. Texts of fewer than LEAST_TOKENS
    tokens are alike to none. docs(by, ord, content) is unique by (by, ord) and calls are small; for a whole
    collection at once use a similarity join with a prefix filter."""
    tokens = T.plain_tokens(F.coalesce("content", F.lit("")))
    sets = docs.select(by, "ord", tokens.alias("t")).where(F.size("t") >= LEAST_TOKENS).select(by, "ord", T.shingles(F.col("t"), SHINGLE).alias("s"))
    rows = sets.select(by, "ord", F.size("s").alias("n"), F.explode("s").alias("shingle")).select(by, "ord", "n", F.xxhash64("shingle").alias("h"))
    a = rows.select(by, F.col("ord").alias("a"), F.col("n").alias("size_a"), "h")
    b = rows.select(by, F.col("ord").alias("b"), F.col("n").alias("size_b"), "h")
    common = a.join(b, [by, "h"]).where("a < b").groupBy(by, "a", "b", "size_a", "size_b").agg(F.count("*").alias("common"))
    return common.where(F.col("common") * SIMILARITY_DENOMINATOR >= SIMILARITY_NUMERATOR * (F.col("size_a") + F.col("size_b") - F.col("common")))


def analyze(docs: DataFrame, by: str = "call_id") -> DataFrame:
    """(by, ord, url, cluster, is_primary, duplicates, content_duplicate) of docs(by, ord, url, content).

    Clusters are connected components, numbered in the order of their first page; the first page is primary, and a
    page other than it whose text matched another's is a content duplicate. Malformed urls share no host."""
    h = docs.select(by, "ord", U.host(F.col("url")).alias("host")).where("host <> ''")
    ha, hb = (h.select(by, F.col("ord").alias(x), F.col("host").alias("h" + x)) for x in ("a", "b"))
    alike = materialize(text_pairs(docs, by).select(by, "a", "b").join(ha, [by, "a"], "left").join(hb, [by, "b"], "left").where("ha IS NULL OR hb IS NULL OR ha <> hb").select(by, "a", "b"))
    # pages of one host are chained to the host's first page: as many links as pages
    first = h.withColumn("a", F.min("ord").over(Window.partitionBy(by, "host"))).where("ord > a").select(by, "a", F.col("ord").alias("b"))
    node = lambda c: F.struct(F.col(by).alias("call"), F.col(c).alias("ord"))
    parts = connected_components(first.union(alike).select(node("a").alias("src"), node("b").alias("dst")))
    root = parts.select(F.col("node.call").alias(by), F.col("node.ord").alias("ord"), F.col("component.ord").alias("root"))
    matched = alike.select(by, F.col("a").alias("ord")).union(alike.select(by, "b")).distinct().withColumn("matched", F.lit(True))
    rows = docs.select(by, "ord", "url").join(root, [by, "ord"], "left").join(matched, [by, "ord"], "left").withColumn("root", F.coalesce("root", "ord"))
    call, cluster = Window.partitionBy(by).orderBy("root"), Window.partitionBy(by, "root")
    return rows.select(
        by, "ord", "url", (F.dense_rank().over(call) - 1).cast("long").alias("cluster"), (F.col("ord") == F.col("root")).alias("is_primary"),
        (F.count("*").over(cluster) - 1).cast("long").alias("duplicates"),
        (F.coalesce("matched", F.lit(False)) & (F.col("ord") != F.col("root"))).alias("content_duplicate"),
    )


def count_independent(analyzed: DataFrame, by: str = "call_id") -> DataFrame:
    return analyzed.groupBy(by).agg(F.countDistinct("cluster").alias("independent"))
