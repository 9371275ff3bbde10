"""An idempotent outbox and threshold alarms, as streams and as batch folds with the same result.

Log rows are (event_id, node_id, action, ts, kind): ``enqueue`` puts a decision in the outbox unless the same one is pending,
``flush`` of a node sends everything pending there.  A decision that was sent may be enqueued again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outbox_id(*cols: str) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def pending_fold(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Keys whose latest record is pending (replay of an append-only log); combined on the map side."""
    last = log.filter(F.coalesce(F.trim(F.col(key)), F.lit("")) != "").groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))
    return last.filter("status = 'pending'").select(key)


def accepted_enqueues(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Pending records that start a new pending phase: the first ever of their key or the first after a sent one."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("_b", before).filter((F.col(status) == "pending") & (F.coalesce("_b", F.lit("sent")) == "sent")).drop("_b")


def outbox_stream(stream: DataFrame, key: str, status: str) -> DataFrame:
    """Streaming accepted_enqueues: (key, offset) of each record that enters the outbox, with the key's state kept between batches.

    ``stream`` has key, status, offset (arrival order).
    """

    def step(k, frames, state):
        pending = state.get[0] if state.exists else False
        out = []
        # all chunks of the key in this batch, as one chunk is not in the order of the next
        whole = pd.concat(list(frames)).sort_values("offset")
        for s, o in whole[[status, "offset"]].itertuples(index=False):
            if s == "pending" and not pending:
                out.append((k[0], int(o)))
            pending = s == "pending"
        state.update((pending,))
        yield pd.DataFrame(out, columns=[key, "offset"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, offset long", "pending boolean", "append", "NoTimeout")


def breach_stream(stream: DataFrame, source: str, bad: str, least: int) -> DataFrame:
    """Streaming alarms: (source, offset) whenever the run of bad samples of a source reaches ``least``."""

    def step(k, frames, state):
        run = state.get[0] if state.exists else 0
        out = []
        whole = pd.concat(list(frames)).sort_values("offset")
        for b, o in whole[[bad, "offset"]].itertuples(index=False):
            run = run + 1 if b else 0
            if run == least:
                out.append((k[0], int(o)))
        state.update((run,))
        yield pd.DataFrame(out, columns=[source, "offset"])

    return stream.groupBy(source).applyInPandasWithState(step, f"{source} string, offset long", "run int", "append", "NoTimeout")


def flush_fold(log: DataFrame, node: str, key: str, kind: str, order: str) -> DataFrame:
    """(node, key, sent_at) of a log of enqueue, recover and failed rows: a pending key is sent at the first recovery of its node
    behind it; one whose sending failed stays pending and is sent at the next.  sent_at is null while pending.

    ``failed`` rows name the key and stand behind the recovery that tried it and before the next.  Recoveries are few against
    the keys: they are gathered per node as a sorted list.
    """
    heals = log.filter(F.col(kind) == "recover").groupBy(node).agg(F.array_sort(F.collect_set(order)).alias("_heals"))
    fails = log.filter(F.col(kind) == "failed").groupBy(node, key).agg(F.array_sort(F.collect_set(order)).alias("_fails"))
    first = log.filter(F.col(kind) == "enqueue").groupBy(node, key).agg(F.min(order).alias("_at"))
    both = first.join(heals, node, "left").join(fails, [node, key], "left")
    empty = F.expr("array()").cast(both.schema["_heals"].dataType)
    h, f = F.coalesce("_heals", empty), F.coalesce("_fails", empty)
    after = F.filter(h, lambda x: x > F.col("_at"))
    # a recovery failed for the key if a failure of it stands between this recovery and the next one
    failed = lambda x: F.exists(f, lambda y: (y > x) & ~F.exists(h, lambda z: (z > x) & (z < y)))
    return both.select(node, key, F.get(F.filter(after, lambda x: ~failed(x)), F.lit(0)).alias("sent_at"))


def flush_stream(stream: DataFrame, node: str, key: str, kind: str) -> DataFrame:
    """Streaming flush on recovery: (node, key, offset, kind) of each key handed to the sender, in the order of enqueueing.

    A node's pending keys are its state.  ``recover`` sends them all; a ``failed`` row puts its key back.
    """

    def step(k, frames, state):
        pending = list(state.get[0]) if state.exists else []
        out = []
        whole = pd.concat(list(frames)).sort_values("offset")
        for x, what, o in whole[[key, kind, "offset"]].itertuples(index=False):
            if what == "recover":
                out += [(k[0], p, int(o)) for p in pending]
                pending = []
            elif what in ("enqueue", "failed") and x not in pending:
                pending.append(x)
        state.update((pending,))
        yield pd.DataFrame(out, columns=[node, key, "offset"])

    return stream.groupBy(node).applyInPandasWithState(step, f"{node} string, {key} string, offset long", "pending array<string>", "append", "NoTimeout")


def least_stream(stream: DataFrame, groups: list[str], by: Column, value: str) -> DataFrame:
    """Per group the value of least ``by`` so far: the same aggregation as the batch operator, in update mode on a stream."""
    return stream.groupBy(*groups).agg(F.min_by(F.col(value), by).alias(value))


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per time window and group; rows later than ``late`` are dropped on streams."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def sessions(stream: DataFrame, time: str, group: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def send_pending(sink, key: str):
    """A foreachBatch function that hands each accepted record of a batch to ``sink(DataFrame)`` once per batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(batch.dropDuplicates([key]).withColumn("batch_id", F.lit(batch_id)))

    return run
