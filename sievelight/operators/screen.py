"""Screening of page content for instructions addressed to the reading agent, and of addresses before fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions import urls as U

CAP = 5
_W = r"(?<![A-Za-z0-9_])"
_E = r"(?![A-Za-z0-9_])"
# The pattern families, each narrow on purpose.
PATTERNS = (
    ("override-instructions", _W + r"(?:ignore|disregard|forget)\s+(?:(?:all|any|the)\s+)*(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?|directions?)"),
    ("role-reassignment", _W + r"you\s+are\s+now\s+(?:a|an|the)" + _E + "|" + _W + r"from\s+now\s+on\s+you\s+(?:are|will|must)" + _E),
    ("system-prompt-probe", _W + r"(?:reveal|print|repeat|show|output|disclose)\s+(?:your\s+|the\s+)?(?:system\s+prompt|initial\s+instructions|hidden\s+instructions)"),
    ("new-instructions", _W + r"(?:new|updated|revised)\s+instructions?\s*[:;]|" + _W + r"important\s+instructions?\s+for\s+(?:the\s+)?(?:ai|assistant|agent|model|llm)" + _E),
    ("exfiltration", _W + r"(?:send|post|upload|transmit|forward|leak)\s+(?:the\s+|your\s+|all\s+)?(?:api\s+keys?|secrets?|credentials?|passwords?|tokens?|env(?:ironment)?\s+variables?)" + _E),
    ("tool-injection", r"</?(?:system|assistant)>|\[\[?\s*(?:system|assistant)\s*\]\]?\s*:"),
    ("agent-directive", _W + r"(?:ai|assistant|agent|model|chatbot|claude|gpt)\s*[,:]?\s*(?:please\s+)?(?:ignore|stop|instead|do\s+not|execute|run)" + _E),
)


def findings(content: Column) -> Column:
    """Array of (pattern, excerpt, index): the first match of each family in document order, at most CAP."""
    found = []
    for i, (name, pattern) in enumerate(PATTERNS):
        at = F.regexp_instr(content, F.lit("(?i)" + pattern)) - 1
        found.append(F.when(at >= 0, F.struct(at.cast("long").alias("index"), F.lit(i).alias("no"), F.lit(name).alias("pattern"), T.excerpt_at(content, at).alias("excerpt"))))
    ordered = F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, CAP)
    return F.transform(ordered, lambda x: F.struct(x.pattern.alias("pattern"), x.excerpt.alias("excerpt"), x.index.alias("index")))


def screen(pages: DataFrame, content: str = "content") -> DataFrame:
    """Adds findings and injection_suspected; null and empty contents have none."""
    return pages.withColumn("findings", F.coalesce(findings(F.col(content)), F.array().cast("array<struct<pattern:string,excerpt:string,index:bigint>>"))).withColumn("injection_suspected", F.size("findings") > 0)


def annotate(pages: DataFrame, banner: str, content: str = "content") -> DataFrame:
    """Prefixes suspected content with a banner and moves the offsets of its findings along."""
    shift = len(banner)
    moved = F.transform("findings", lambda x: F.struct(x.pattern.alias("pattern"), x.excerpt.alias("excerpt"), (x.index + shift).alias("index")))
    on = F.col("injection_suspected")
    return pages.withColumn(content, F.when(on, F.concat(F.lit(banner), F.col(content))).otherwise(F.col(content))).withColumn("findings", F.when(on, moved).otherwise(F.col("findings")))


def refuse(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """Adds reason (null if the url may be fetched) to urls(url); dns(host, address) holds every address of a host,
    and one address that isn't public is enough to refuse it."""
    resolved = dns.groupBy("host").agg(F.bool_or(U.blocked_address(F.col("address"))).alias("blocked"))
    h = F.lower(U.part(F.col("url"), U.HOST))
    rows = urls.withColumn("_host", h).join(resolved.withColumnRenamed("host", "_host"), "_host", "left")
    return rows.withColumn("reason", U.refusal(F.col("url"), F.col("blocked"))).drop("_host", "blocked")
