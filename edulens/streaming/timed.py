"""Keyed streams in event-time order, with state that timers drop.

Rows of a key wait until the watermark has passed them and are then handed on in
order, so the verdicts do not depend on how rows fall into micro-batches: they
are those of the table forms beside them. The waiting rows of a key span the
watermark's delay at most. Timers need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Paths whose changes are capped, by class.
AUTH_PATHS = ("/auth/login", "/auth/register", "/auth/decision/import-guest")
SENSITIVE_PATHS = (
    "/proftest/results", "/proftest/profile", "/proftest/sessions", "/proftest/sessions/current",
    "/proftest/sessions/current/next", "/proftest/sessions/current/complete",
)
MUTATING = ("POST", "PUT", "PATCH", "DELETE")


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Holds rows ``(at in microseconds, event_id, ...)`` of a key until the
    watermark is past them. Subclasses judge them in order in ``step`` and say in
    ``ends`` when, in milliseconds, the state of a key without rows may go."""

    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.armed = handle.getValueState("armed", "at long")

    def _arm(self, at: int | None) -> None:
        old = self.armed.get()[0] if self.armed.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.armed.clear()
        else:
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in self.fields.split(", ")]
        new = []
        for pdf in rows:
            columns = [pdf[n].astype(object).where(pdf[n].notna(), None) for n in names]
            new += [tuple(None if v is None else v if isinstance(v, str) else int(v) for v in r) for r in zip(*columns)]
        if new:
            self.waiting.appendList(new)
            first = min(-(-r[0] // 1000) for r in new)
            old = self.armed.get()[0] if self.armed.exists() else None
            self._arm(first if old is None else min(first, old))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(map(tuple, self.waiting.get()) if self.waiting.exists() else [], key=lambda r: r[:2])
        due = [r for r in rows if r[0] <= now * 1000]
        rest = rows[len(due):]
        self.armed.clear()  # the timer that fired is gone
        out = self.step(key, due) if due else []
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        ends = self.ends()
        if not rest and (ends is None or ends <= now):
            out += self.drop(key)
            self._arm(None)
        else:
            self._arm(min(x for x in (-(-rest[0][0] // 1000) if rest else None, ends) if x is not None and x > now))
        yield pd.DataFrame(out, columns=self.columns)

    def drop(self, key) -> list:
        """Clear the key's own state; rows to emit for it."""
        self.state.clear()
        return []

    def close(self) -> None:
        pass


class Cap(InOrder):
    """At most ``cap`` accepted rows within ``seconds``; null caps nothing."""

    fields = "at long, event_id long, cap int"
    columns = ["event_id", "accepted"]

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("kept", "times array<long>")

    def step(self, key, due: list) -> list:
        kept = list(self.state.get()[0]) if self.state.exists() else []
        out = []
        for at, event_id, cap in due:
            kept = [x for x in kept if x > at - self.span]
            ok = cap is None or len(kept) < cap
            if ok and cap is not None:
                kept.append(at)
            out.append((event_id, ok))
        self.state.update((kept,))
        return out

    def ends(self) -> int | None:
        kept = self.state.get()[0] if self.state.exists() else []
        return -(-(max(kept) + self.span) // 1000) if kept else None


class Turns(InOrder):
    """A session's revision; the session ends ``seconds`` after it was opened."""

    fields = "at long, event_id long, expected int"
    columns = ["event_id", "verdict", "revision"]

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("session", "revision int, until long")

    def step(self, key, due: list) -> list:
        revision, until = self.state.get() if self.state.exists() else (0, None)
        out = []
        for at, event_id, expected in due:
            if until is None or at >= until:
                revision, until = 0, None
            if until is None and expected is not None:
                out.append((event_id, "no_session", 0))
                continue
            if until is None:
                verdict, revision, until = "opened", 1, at + self.span
            elif expected is not None and expected != revision:
                verdict = "stale"
            else:
                verdict, revision = "applied", revision + 1
            out.append((event_id, verdict, revision))
        if until is None:
            self.state.clear()
        else:
            self.state.update((revision, until))
        return out

    def ends(self) -> int | None:
        return -(-self.state.get()[1] // 1000) if self.state.exists() else None


class Retained(InOrder):
    """The first of each event is kept until ``seconds`` after it; then a row
    tells that it has gone."""

    fields = "at long, event_id long"
    columns = ["event_id", "change", "at"]

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getMapState("kept", "event_id long", "until long")

    def step(self, key, due: list) -> list:
        out = self._purge(due[0][0])
        for at, event_id in due:
            out += self._purge(at)
            if not self.state.containsKey((event_id,)):
                self.state.updateValue((event_id,), (at + self.span,))
                out.append((event_id, "kept", at))
        return out

    def _purge(self, at: int) -> list:
        gone = sorted((until, event_id) for (event_id,), (until,) in self.state.iterator() if until <= at)
        for _, event_id in gone:
            self.state.removeKey((event_id,))
        return [(event_id, "purged", until) for until, event_id in gone]

    def ends(self) -> int | None:
        left = [until for _, (until,) in self.state.iterator()] if self.state.exists() else []
        return -(-min(left) // 1000) if left else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        gone = self._purge(timerValues.getCurrentWatermarkInMs() * 1000)
        if gone:
            yield pd.DataFrame(gone, columns=self.columns)
            ends = self.ends()
            if not self.waiting.exists():
                self._arm(ends)

    def drop(self, key) -> list:
        return []


def _judged(stream: DataFrame, by: list[str], processor: InOrder, columns: list[Column], schema: str, delay: str) -> DataFrame:
    timed = stream.withWatermark("occurred_at", delay)
    rows = timed.select(*by, "occurred_at", F.unix_micros("occurred_at").alias("at"), "event_id", *columns)
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in by)
    out = rows.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=_keyed(processor, by), outputStructType=f"{kinds}, {schema}", outputMode="append", timeMode="eventTime"
    )
    return out


def _keyed(processor: InOrder, by: list[str]) -> InOrder:
    """The processor with the key's columns before its own."""

    class Keyed(type(processor)):
        def handleInputRows(self, key, rows, timerValues):
            for out in super().handleInputRows(key, rows, timerValues):
                yield with_key(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            for out in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
                yield with_key(key, out)

    def with_key(key, out: pd.DataFrame) -> pd.DataFrame:
        for k, (name, value) in enumerate(zip(by, key)):
            out.insert(k, name, [value] * len(out))
        return out

    own = Keyed.__new__(Keyed)
    own.__dict__.update(processor.__dict__)
    return own


def path_class(method: Column, path: Column) -> Column:
    """The class whose cap holds for a request; null where none does."""
    named = (
        F.when(path.isin(*AUTH_PATHS), "auth").when(path.startswith("/ops/"), "ops")
        .when(path.isin(*SENSITIVE_PATHS) | path.startswith("/decision/"), "sensitive")
    )
    return F.when(F.upper(method).isin(*MUTATING), named)


def class_caps(events: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``events(method, path, ...)`` with ``cap_class`` and ``cap``."""
    limits = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return events.withColumn("cap_class", path_class(F.col("method"), F.col("path"))).withColumn("cap", limits[F.col("cap_class")].cast("int"))


def cap_in_order(stream: DataFrame, by: list[str], seconds: int, delay: str = "1 day") -> DataFrame:
    """``(*by, event_id, accepted)``: a row passes if fewer than its ``cap``
    accepted ones of its key lie in the ``seconds`` before it, in the order of
    ``occurred_at`` and ``event_id``; each verdict comes once the watermark is
    past its row, and equals that of ``cap_table``."""
    return _judged(stream, by, Cap(seconds), [F.col("cap")], "event_id long, accepted boolean", delay)


def turns_in_order(stream: DataFrame, seconds: int, delay: str = "1 day") -> DataFrame:
    """``(owner_key, event_id, verdict, revision)`` of turns ``(owner_key,
    event_id, occurred_at, expected)``. A turn that expects no revision opens a
    session where none is live; one that expects another than the session's is
    stale; each applied one raises it. A session ends ``seconds`` after it was
    opened, when a timer drops its state. Equals ``turns_table``."""
    return _judged(stream, ["owner_key"], Turns(seconds), [F.col("expected")], "event_id long, verdict string, revision int", delay)


def retained(stream: DataFrame, seconds: int, delay: str = "1 day") -> DataFrame:
    """``(owner_key, event_id, change, at)``: the first row of each event as
    ``kept``, and ``purged`` when it is ``seconds`` old, by a timer on its state.
    The changes can drive a sink that deletes (``apply_changes``)."""
    return _judged(stream, ["owner_key"], Retained(seconds), [], "event_id long, change string, at long", delay)


def _stretches(events: DataFrame, by: list[str], span: int, *columns: str) -> DataFrame:
    """Rows of each key cut where no row lies within ``span`` of the one before,
    as an ordered array: nothing before such a gap counts after it."""
    timed = events.select(*by, F.unix_micros("occurred_at").alias("at"), "event_id", *columns)
    order = Window.partitionBy(*by).orderBy("at", "event_id")
    opens = F.coalesce(F.col("at") - F.lag("at").over(order) >= span, F.lit(True)).cast("int")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = timed.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(upto))
    rows = F.array_sort(F.collect_list(F.struct("at", "event_id", *columns))).alias("rows")
    return cut.groupBy(*by, "stretch").agg(rows)


def cap_table(events: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """The verdicts of ``cap_in_order`` over a table."""
    span = seconds * 1_000_000
    none = F.array().cast("array<bigint>")
    zero = F.struct(none.alias("kept"), none.alias("ok"))

    def fold(s, e):
        kept = F.filter(s["kept"], lambda x: x > e["at"] - span)
        fits = e["cap"].isNull() | (F.size(kept) < e["cap"])
        return F.struct(
            F.when(fits & e["cap"].isNotNull(), F.array_append(kept, e["at"])).otherwise(kept).alias("kept"),
            F.when(fits, F.array_append(s["ok"], e["event_id"])).otherwise(s["ok"]).alias("ok"),
        )

    per = _stretches(events, by, span, "cap").withColumn("ok", F.aggregate("rows", zero, fold, lambda s: s["ok"]))
    each = per.select(*by, F.explode("rows").alias("r"), "ok")
    return each.select(*by, "r.event_id", F.array_contains("ok", F.col("r.event_id")).alias("accepted"))


def turns_table(turns: DataFrame, seconds: int) -> DataFrame:
    """The verdicts of ``turns_in_order`` over a table."""
    span = seconds * 1_000_000
    told = "array<struct<event_id:bigint,verdict:string,revision:int>>"
    zero = F.struct(F.lit(0).alias("revision"), F.lit(None).cast("bigint").alias("until"), F.array().cast(told).alias("out"))

    def fold(s, e):
        live = F.coalesce(e["at"] < s["until"], F.lit(False))
        verdict = (
            F.when(~live & e["expected"].isNotNull(), "no_session").when(~live, "opened")
            .when(e["expected"] != s["revision"], "stale").otherwise("applied")
        )
        revision = F.when(verdict == "opened", 1).when(~live, 0).when(verdict == "applied", s["revision"] + 1).otherwise(s["revision"])
        until = F.when(verdict == "opened", e["at"] + span).when(live, s["until"])
        one = F.struct(e["event_id"].alias("event_id"), verdict.alias("verdict"), revision.cast("int").alias("revision"))
        return F.struct(revision.cast("int").alias("revision"), until.alias("until"), F.array_append(s["out"], one).alias("out"))

    per = _stretches(turns, ["owner_key"], span, "expected")
    per = per.select("owner_key", F.explode(F.aggregate("rows", zero, fold, lambda s: s["out"])).alias("o"))
    return per.select("owner_key", "o.*")


def apply_changes(path: str):
    """For ``foreachBatch`` of ``retained``: the kept events as a table of one
    folder a batch, without those that were purged since. Batches that come
    again overwrite their own folder; a purge names its event, so the table is
    read through ``kept_events``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def kept_events(spark: SparkSession, path: str) -> DataFrame:
    """``(owner_key, event_id)`` that were kept and not purged."""
    changes = spark.read.parquet(path)
    last = F.max_by("change", F.struct("at", F.when(F.col("change") == "kept", 1).otherwise(0)))
    return changes.groupBy("owner_key", "event_id").agg(last.alias("last")).where("last = 'kept'").drop("last")
