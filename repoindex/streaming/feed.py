"""Continuous reindex from a feed of path changes."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repoindex.functions.columns import sanitise
from repoindex.plans.indexing import IndexOptions, reindex
from repoindex.sources.store import stage

_ORDERED_SCHEMA = "namespace string, file_path string, op string, at long, event_id long"


def latest_change(feed: DataFrame) -> DataFrame:
    """The last operation per path of a feed (namespace, file_path, op, ts, event_id)."""
    return feed.groupBy("namespace", "file_path").agg(
        F.max_by("op", F.struct("ts", "event_id")).alias("op"))


def _ordered(feed: DataFrame) -> DataFrame:
    """(namespace, file_path, op, at, event_id) with times as whole microseconds; events without a path are none."""
    kind = feed.schema["ts"].dataType
    if isinstance(kind, T.TimestampType):
        at = F.unix_micros("ts")
    elif isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(F.to_date("ts")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
        at = ((seconds + F.extract(F.lit("SECOND"), "ts")) * 1000000).cast("long")
    else:
        at = F.col("ts").cast("long")
    first = F.lit(-(1 << 63)).cast("long")
    return feed.where("namespace IS NOT NULL AND file_path IS NOT NULL").select(
        sanitise(F.col("namespace")).alias("namespace"), "file_path", "op", F.coalesce(at, first).alias("at"),
        F.coalesce(F.col("event_id").cast("long"), first).alias("event_id"))


def _last_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last event per path of each Arrow batch, so that a path of very many events sends few."""
    for rows in batches:
        yield rows.sort_values(["at", "event_id", "op"]).drop_duplicates(["namespace", "file_path"], keep="last")


def _newer(path: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last event of a path, unless one as late was given out before; its time and number are the state."""
    known = state.get if state.exists else None
    last = None
    for rows in batches:
        for op, at, event in zip(rows["op"], rows["at"], rows["event_id"]):
            event = int(at), int(event), op
            if last is None or event > last:
                last = event
    if last is not None and (known is None or last[:2] > tuple(known)):
        state.update(last[:2])
        yield pd.DataFrame({"namespace": [path[0]], "file_path": [path[1]], "op": [last[2]]})


def newer_changes(feed: DataFrame) -> DataFrame:
    """(namespace, file_path, op) of a streamed feed (namespace, file_path, op, ts, event_id): per batch the last event of
    each path, unless an earlier batch had a later one or the same.

    The state of a path is two numbers, kept with the checkpoint of the stream, so a batch costs what its own events cost,
    however many came before. ``event_id`` is a whole number; missing times and numbers are the earliest.
    """
    combined = _ordered(feed).mapInPandas(_last_events, _ORDERED_SCHEMA)
    return combined.groupBy("namespace", "file_path").applyInPandasWithState(
        _newer, "namespace string, file_path string, op string", "at long, event_id long", "update",
        GroupStateTimeout.NoTimeout)


def stream_reindex(feed: DataFrame, files: DataFrame, store: str, checkpoint: str,
                   manifests: DataFrame | None = None, options: IndexOptions = IndexOptions(),
                   trigger: dict | None = None) -> StreamingQuery:
    """Start applying a streamed feed to a store batch by batch: everything that is there now, or as ``trigger`` says.
    The feed's own options (``maxFilesPerTrigger`` and the like) bound a batch.

    The last event of each path decides, in whatever batch it comes: older operations are passed over. A batch that is
    replayed after a failure starts from the state before it and gives the same rows again, since every listed path is
    deleted and, if it still exists, rebuilt from ``files``. A batch without news makes no version.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        # Written first: every further job on the batch itself would run its state again.
        due = stage(batch, store)
        if not due.isEmpty():
            reindex(batch.sparkSession, store, files, due, manifests, options)

    return (
        newer_changes(feed).writeStream.foreachBatch(apply)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
