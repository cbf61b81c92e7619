"""Streaming forms of the keyed state: cache with time to live, pattern log, paced providers, domain profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievelight.operators import cache, pacing


class _Latest(StatefulProcessor):
    """Keeps the newest content of a url for the time to live; emits each change."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "content string, created_at long", *([self.ttl_ms] if self.ttl_ms else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        changed = False
        for b in rows:
            r = b.loc[b["created_at"].idxmax()]
            if best is None or r["created_at"] > best[1]:
                best, changed = (r["content"], int(r["created_at"])), True
        if changed:
            self.state.update(best)
            yield pd.DataFrame({"url": [key[0]], "content": [best[0]], "created_at": [best[1]]})

    def close(self) -> None:
        pass


def latest_pages(stream: DataFrame, ttl_ms: int | None = cache.PAGE_TTL) -> DataFrame:
    """Changes of the cache: a row for each capture (url, content, created_at) newer than what is kept.

    A time to live is kept by the clock, so such a stream goes on making batches: run it with a processing-time
    trigger. Without one (None) it ends with its input under availableNow."""
    return stream.groupBy("url").transformWithStateInPandas(_Latest(ttl_ms), "url string, content string, created_at long", "Update", "ProcessingTime" if ttl_ms else "None")


class _Queue(StatefulProcessor):
    """When the provider is free again, and until when it cools down."""

    def __init__(self, interval: int, cooldown: int):
        self.interval, self.cooldown = interval, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", "free_at long, cool_until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        free, cool = self.state.get() if self.state.exists() else (0, 0)
        every = pd.concat(list(rows)).sort_values(["arrive_ms", "ord"])
        out = []
        for o, t, d, blocked in zip(every["ord"], every["arrive_ms"], every["duration_ms"], every["blocked"]):
            start = max(int(t), free)
            refused = start < cool
            if not refused:
                free = start + int(d) + self.interval
                cool = max(cool, start + int(d) + self.cooldown) if blocked else 0
            out.append((key[0], o, None if refused else start, refused))
        self.state.update((free, cool))
        yield pd.DataFrame(out, columns=["provider", "ord", "start_ms", "refused"]).astype({"start_ms": "Int64"})

    def close(self) -> None:
        pass


def paced(stream: DataFrame, interval: int = pacing.INTERVAL, cooldown: int = pacing.COOLDOWN) -> DataFrame:
    """provider, ord, start_ms (null if refused) and refused of requests(provider, ord, arrive_ms, duration_ms, blocked)."""
    return stream.groupBy("provider").transformWithStateInPandas(_Queue(interval, cooldown), "provider string, ord long, start_ms long, refused boolean", "Append", "None")


def new_patterns(stream: DataFrame) -> DataFrame:
    """Captured JSON interfaces, each method and pattern of a domain once (captures need an event_time; a pattern may
    come again after a day)."""
    from sievelight.functions import urls as U

    rows = stream.where(F.lower("content_type").contains("application/json") & F.try_parse_json("data").isNotNull() & U.is_url(F.col("url")))
    rows = rows.select("event_time", U.host(F.col("url")).alias("domain"), "method", U.api_pattern(F.col("url")).alias("endpoint_pattern"), U.media_type(F.col("content_type")).alias("content_type"))
    return rows.withWatermark("event_time", "1 day").dropDuplicatesWithinWatermark(["domain", "method", "endpoint_pattern"])


def write_upserts(stream: DataFrame, path: str, checkpoint: str, key: str = "url", time: str = "created_at"):
    """Appends each batch's newest row per key to a parquet log; readers take cache.upsert of it. A batch is written to
    a folder of its own number, so one that is tried again replaces itself."""

    def save(batch: DataFrame, n: int) -> None:
        cache.upsert(batch, key, time).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
