"""The event log and the fetch manifest as streams; batch functions of operators.tables give the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriloom.sources.readers import SCHEMAS

_STATE = "status string, sha256 string, attempts long, seq long"
_OUT = "url string, status string, sha256 string, attempts long, seq long"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMAS["events"], files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out. An addition to what batch offers."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def usage_meter(events: DataFrame, run: str, cols: list[str]) -> DataFrame:
    """Running totals of a run: update mode keeps one row a run as state."""
    return events.groupBy(run).agg(*[F.sum(c).alias(c) for c in cols])


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, sha, attempts, seq = state.get if state.exists else ("pending", None, 0, -1)
    rows = pd.concat(list(frames)).sort_values("seq")
    for kind, digest, at in zip(rows["kind"], rows["sha256"], rows["seq"]):
        if at <= seq and kind != "add":
            continue
        if kind in ("fetched", "failed"):
            attempts += 1
            status = kind
            sha = digest if kind == "fetched" else sha
        elif kind == "reset":
            status = "pending"
        seq = max(seq, int(at))
    state.update((status, sha, int(attempts), int(seq)))
    yield pd.DataFrame({"url": [key[0]], "status": [status], "sha256": [sha], "attempts": [int(attempts)], "seq": [int(seq)]})


def manifest_states(events: DataFrame, url: str = "url") -> DataFrame:
    """Fetch events (url, seq, kind, sha256) to a row of the url's state at each change; keyed state, no time-out."""
    return events.groupBy(url).applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def follow(events: DataFrame, handle, checkpoint: str, mode: str = "update", once: bool = True):
    """Starts a query that hands each batch to handle(df, id)."""
    writer = events.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()
