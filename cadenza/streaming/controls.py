"""Messages of a live client as frames: binary messages are audio, text messages are controls.

A stream ends at its first CloseStream or close message, and later messages are passed over. Pings and
pongs carry nothing. ``lenient`` front ends pass over texts that are no known control; a strict one
takes them for an error. One window by stream, so a stream's messages meet in one task, as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control types of a text message and the frames they become.
CONTROLS = {"KeepAlive": "keepalive", "Finalize": "finalize", "CloseStream": "end"}


def frames(messages: DataFrame, lenient: bool = True) -> DataFrame:
    """(stream_id, seq, kind, payload) of messages (stream_id, seq, type, payload): kinds body, keepalive, finalize and end."""
    control = F.get_json_object("payload", "$.type")
    known = F.create_map(*(F.lit(x) for pair in CONTROLS.items() for x in pair))
    kind = F.try_element_at(known, control)
    if not lenient:
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown control message: "), F.coalesce("payload", F.lit("null")))).cast("string"))
    kind = F.when(F.col("type") == "binary", "body").when(F.col("type") == "close", "end").when(F.col("type") == "text", kind)
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("kind", kind).filter("kind is not null")
    rows = rows.withColumn("_ended", F.coalesce(F.max(F.col("kind") == "end").over(before), F.lit(False))).filter(~F.col("_ended"))
    return rows.select("stream_id", "seq", "kind", F.when(F.col("kind") == "body", F.col("payload")).alias("payload"))


def within_time(messages: DataFrame, limit_ms: int) -> DataFrame:
    """``messages`` (stream_id, seq, at, kind) with ``in_time`` and ``timed_out``.

    The limit covers a whole session, from its first message. A session that has not ended by then is
    answered with a timeout, and what comes later is not heard. ``at`` is in ms.
    """
    whole = Window.partitionBy("stream_id")
    in_time = F.col("at") - F.min("at").over(whole) <= limit_ms
    rows = messages.withColumn("in_time", in_time)
    return rows.withColumn("timed_out", ~F.max(F.col("in_time") & (F.col("kind") == "end")).over(whole))


def live_workers(heartbeats: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """(worker, last, live): workers whose last heartbeat (worker, at) is at most ``ttl_ms`` old."""
    return heartbeats.groupBy("worker").agg(F.max("at").alias("last")).withColumn("live", F.col("last") >= now_ms - ttl_ms)


def admitted(operations: DataFrame, slots: int) -> DataFrame:
    """``operations`` (stream_id, seq, op: "write" or "read") with ``held`` before each, and ``waits`` for writes to a full ring.

    A ring has ``slots`` places; a write that waits is tried again after the next read, so nothing is
    lost: ``held`` counts waiting writes too. A read of an empty ring reads nothing. In closed form held is the walk
    of writes less reads above its lowest point so far, so one window pass does it.
    """
    order = Window.partitionBy("stream_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = operations.withColumn("_walk", F.sum(F.when(F.col("op") == "write", 1).otherwise(-1)).over(upto))
    rows = rows.withColumn("_after", F.col("_walk") - F.least(F.min("_walk").over(upto), F.lit(0)))
    rows = rows.withColumn("held", F.coalesce(F.lag("_after").over(order), F.lit(0)).cast("long"))
    return rows.withColumn("waits", (F.col("op") == "write") & (F.col("held") >= slots)).drop("_walk", "_after")
