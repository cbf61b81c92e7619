"""Pacing of provider calls, cool-downs and retries as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

INTERVAL, COOLDOWN, RETRIES = 1_000, 60_000, 2
RETRY_STATUS = (429, 503)


def schedule(requests: DataFrame, interval: int = INTERVAL, provider: str = "provider", block_ms: int = 3_600_000) -> DataFrame:
    """Adds start_ms and end_ms to requests(provider, ord, arrive_ms, duration_ms): first come first served, one at a
    time, the next ``interval`` after the one before ended. Ties are served by ord.

    start_i = max(arrive_i, end_(i-1) + interval) is a running maximum: with s_i the sum of durations and intervals
    before i, start_i - s_i = max over j <= i of (arrive_j - s_j). Sums and maxima are taken within blocks of time,
    then over the blocks (one row each), and put together, so a provider with most of the calls is many tasks."""
    rows = requests.withColumn("_b", F.floor(F.col("arrive_ms") / block_ms))
    own = Window.partitionBy(provider, "_b").orderBy("arrive_ms", "ord")
    work = F.col("duration_ms") + interval
    rows = rows.withColumn("_s", F.coalesce(F.sum(work).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_m", F.max(F.col("arrive_ms") - F.col("_s")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy(provider, "_b").agg(F.sum(work).alias("_work"), F.max("_m").alias("_most"))
    earlier = Window.partitionBy(provider).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_sum", F.coalesce(F.sum("_work").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_max", F.max(F.col("_most") - F.col("_sum")).over(earlier)).select(provider, "_b", "_sum", "_max")
    out = rows.join(blocks, [provider, "_b"])
    start = F.greatest("_max", F.col("_m") - F.col("_sum")) + F.col("_s") + F.col("_sum")  # greatest skips the null of the first block
    return out.withColumn("start_ms", start.cast("long")).withColumn("end_ms", (F.col("start_ms") + F.col("duration_ms")).cast("long")).select(*requests.columns, "start_ms", "end_ms")


def cooled(requests: DataFrame, cooldown: int = COOLDOWN, provider: str = "provider") -> DataFrame:
    """Adds refused and cool_until to requests(provider, ord, arrive_ms, blocked): a blocked call that was let through
    starts a cool-down (the longer of the two holds), during which calls are refused; a call that succeeds ends it.

    Whether a call goes through depends on those before it, so each provider's calls are read in order (a sorted
    stream of rows, constant memory)."""
    names = list(requests.columns)
    out = StructType([*requests.schema.fields, StructField("refused", BooleanType()), StructField("cool_until", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, until = None, 0
        for b in batches:
            refused, untils = [], []
            for p, t, blocked in zip(b[provider], b["arrive_ms"], b["blocked"]):
                if p != who:
                    who, until = p, 0
                no = t < until
                if not no:
                    until = max(until, t + cooldown) if blocked else 0
                refused.append(no)
                untils.append(until)
            yield b[names].assign(refused=refused, cool_until=untils)

    return requests.repartition(provider).sortWithinPartitions(provider, "arrive_ms", "ord").mapInPandas(run, out)


def retry_after_ms(value: Column, as_of: Column) -> Column:
    """Delay that a Retry-After header asks for: whole seconds or an HTTP date (0 if past); null if it can't be read."""
    v = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(v.rlike(r"^[0-9]{1,15}$"), v.cast("long") * 1000).when(date.isNotNull(), F.greatest(F.lit(0), F.unix_millis(date) - F.unix_millis(as_of)))


def retries(calls: DataFrame, as_of: Column, base_ms: int = 500) -> DataFrame:
    """One row per attempt that follows a failed one of calls(call_id, attempt, status, retry_after): retry, delay_ms.

    429 and 503 are tried again at most RETRIES times, after the header's delay or base * 2 ** attempt; the random
    part of the delay is left out."""
    again = F.col("status").isin(*RETRY_STATUS) & (F.col("attempt") < RETRIES)
    delay = F.coalesce(retry_after_ms(F.col("retry_after"), as_of), (F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt"))).cast("long"))
    return calls.withColumn("retry", F.coalesce(again, F.lit(False))).withColumn("delay_ms", F.when(F.col("retry"), delay))


def budget_ms(browser_possible: Column) -> Column:
    return F.when(browser_possible, F.lit(35_000)).otherwise(F.lit(8_000))
