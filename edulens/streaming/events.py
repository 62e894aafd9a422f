"""Structured Streaming twins of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP_DAYS = 180
SERVER_ONLY = ("session_started", "session_expired", "final_choice_confirmed")


def with_expiry(stream: DataFrame, days: int = 180) -> DataFrame:
    return stream.withColumn("expires_at", F.col("occurred_at") + F.make_dt_interval(days=F.lit(days)))


def dedupe_events(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of each (owner, event); rows that expired before they
    occurred never enter. State is dropped behind the watermark."""
    live = stream.where("expires_at is null or expires_at > occurred_at")
    return live.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["owner_key", "event_id"])


def streaming_funnel(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Owners (approximate: streams have no exact distinct) and events per type
    and window."""
    return (
        stream.withWatermark("occurred_at", delay)
        .groupBy(F.window("occurred_at", window), "event_type")
        .agg(F.approx_count_distinct("owner_key").alias("owners"), F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("start"), "event_type", "owners", "events")
    )


def split_client_events(stream: DataFrame, server_only: tuple = SERVER_ONLY) -> tuple[DataFrame, DataFrame]:
    """Events that clients may send, and the refused ones."""
    bad = F.col("event_type").isin(*server_only)
    return stream.where(~bad), stream.where(bad)


def _cap_step(limit: int, seconds: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the last kept time is past the window
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["occurred_at", "event_id"])
        accepted = []
        for t in pdf["occurred_at"]:
            at = t.timestamp()
            kept = [x for x in kept if x > at - seconds]
            ok = sum(x <= at for x in kept) < limit  # what lies after a late row does not count
            if ok:
                kept.append(at)
            accepted.append(ok)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((max(kept) + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"owner_key": pdf["owner_key"], "event_id": pdf["event_id"], "accepted": accepted})

    return step


def sliding_cap(stream: DataFrame, limit: int, seconds: int, delay: str = "1 day") -> DataFrame:
    """An event passes if fewer than ``limit`` accepted ones lie in the
    ``seconds`` before it, judged at once in the order of arrival; ``timed.cap_in_order``
    waits for the watermark and gives the verdicts of the table. At most ``limit`` times are kept per key, and a key's
    state goes once the watermark is past the window of its last event."""
    return stream.withWatermark("occurred_at", delay).groupBy("owner_key").applyInPandasWithState(
        _cap_step(limit, seconds),
        "owner_key long, event_id long, accepted boolean",
        "times array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def sliding_cap_batch(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """The same over a table: a fold over each stretch of an owner's events in
    which no two neighbours are ``seconds`` apart. What lies before such a gap
    cannot count after it, so a long history is many short folds. The fold's
    state holds ``limit`` times at most."""
    span = seconds * 1_000_000
    timed = events.select("owner_key", "event_id", F.unix_micros("occurred_at").alias("at"))
    order = Window.partitionBy("owner_key").orderBy("at", "event_id")
    opens = F.coalesce(F.col("at") - F.lag("at").over(order) >= span, F.lit(True)).cast("int")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = timed.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(upto))
    rows = F.array_sort(F.collect_list(F.struct("at", "event_id")))
    zero = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<bigint>").alias("ok"))

    def fold(s, e):
        kept = F.filter(s["kept"], lambda x: x > e["at"] - span)
        fits = F.size(kept) < limit
        return F.struct(
            F.when(fits, F.array_append(kept, e["at"])).otherwise(kept).alias("kept"),
            F.when(fits, F.array_append(s["ok"], e["event_id"])).otherwise(s["ok"]).alias("ok"),
        )

    per = stretches.groupBy("owner_key", "stretch").agg(F.aggregate(rows, zero, fold, lambda s: s["ok"]).alias("ok"))
    return per.select("owner_key", F.explode("ok").alias("event_id"))


def _decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    short, gone, choice, revision = state.get if state.exists else ([], [], None, 0)
    short, gone = list(short), list(gone)
    pdf = pd.concat(list(batches)).sort_values("seq")
    rows = []
    for seq, action, p in zip(pdf["seq"], pdf["action"], pdf["program_id"]):
        p = int(p)
        ok = {
            "add": p not in short and p not in gone, "remove": p in short, "exclude": p not in gone,
            "restore": p in gone, "choose": p in short,
        }.get(action, False)
        was = len(short)
        if ok:
            revision += 1
            if action == "add":
                short.append(p)
            elif action in ("remove", "exclude") and p in short:
                short.remove(p)
            if action == "exclude":
                gone.append(p)
            elif action == "restore":
                gone.remove(p)
            elif action == "choose":
                choice = p
            if choice is not None and choice not in short:
                choice = None
        rows.append((int(key[0]), int(seq), ok, revision, len(short), len(short) != was))
    state.update((short, gone, choice, revision))
    if "occurred_at" in pdf:
        last = int(pdf["occurred_at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + KEEP_DAYS * 86_400_000, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame(rows, columns=["owner_key", "seq", "legal", "revision", "shortlist_size", "size_changed"])


def decision_stream(stream: DataFrame) -> DataFrame:
    """Decision state per owner as actions arrive, with derived facts. With a
    column ``occurred_at`` an owner's state goes KEEP_DAYS after the last action."""
    timed = "occurred_at" in stream.columns
    if timed:
        stream = stream.withWatermark("occurred_at", "1 day")
    return stream.groupBy("owner_key").applyInPandasWithState(
        _decide,
        "owner_key long, seq long, legal boolean, revision int, shortlist_size int, size_changed boolean",
        "shortlist array<bigint>, excluded array<bigint>, choice bigint, revision int",
        "append",
        GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout,
    )


def session_windows(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions per owner that end after ``gap`` without events."""
    return (
        stream.withWatermark("occurred_at", delay)
        .groupBy(F.session_window("occurred_at", gap).alias("s"), "owner_key")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("owner_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
    )


def reject_stale_revisions(turns: DataFrame) -> DataFrame:
    """Turns written against a revision older than the newest seen before them."""
    w = Window.partitionBy("owner_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("base_revision").over(w)
    return turns.withColumn("stale", F.coalesce(F.col("base_revision") < newest, F.lit(False)))
