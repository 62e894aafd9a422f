"""Streams in event-time order against their table forms, however rows arrive."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from edulens.streaming import timed

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    timed.use_rocksdb(spark)
    yield
    spark.conf.set(key, old)


def run(spark, tmp_path, batches, schema, build, sink=None):
    """Feed the batches one by one; the last watermark passes every row."""
    path = tmp_path / "in"
    path.mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
    out = build(src).writeStream.option("checkpointLocation", str(tmp_path / "c"))
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(path))
        q = (out.foreachBatch(sink) if sink else out.format("parquet").option("path", str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return None if sink else spark.read.parquet(str(tmp_path / "out"))


def split(rows, late, parts, seed):
    """Rows in ``parts`` batches, out of order by up to ``late`` seconds."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[-1].timestamp() + rng.uniform(0, late))
    cuts = sorted(rng.sample(range(1, len(order)), parts - 1))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])]


@pytest.mark.parametrize("parts", [1, 4])
def test_cap_does_not_depend_on_batches(spark, tmp_path, rocksdb, parts):
    rng = random.Random(1)
    schema = "owner_key long, cap int, event_id long, occurred_at timestamp"
    rows = [(o, [2, 2, None][o], 100 * o + k, T0 + dt.timedelta(seconds=rng.randint(0, 300))) for o in range(3) for k in range(30)]
    batches = split(rows, 50, parts, parts) + [[(9, 1, 999, T0 + dt.timedelta(hours=5))], [(9, 1, 1000, T0 + dt.timedelta(hours=9))]]
    got = run(spark, tmp_path, batches, schema, lambda s: timed.cap_in_order(s, ["owner_key"], 60, "1 minute"))
    want = timed.cap_table(spark.createDataFrame(rows, schema), ["owner_key"], 60)
    assert {tuple(r) for r in got.where("owner_key < 9").collect()} == {tuple(r) for r in want.collect()}
    assert 0 < want.where("accepted").count() < len(rows)


def test_a_late_row_is_judged_in_its_place(spark, tmp_path, rocksdb):
    schema = "owner_key long, cap int, event_id long, occurred_at timestamp"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(1, 1, 3, at(40))], [(1, 1, 2, at(20))], [(1, 1, 1, at(0))], [(2, 1, 9, at(9000))]]
    got = run(spark, tmp_path, batches, schema, lambda s: timed.cap_in_order(s, ["owner_key"], 10, "1 hour"))
    assert {(r.event_id, r.accepted) for r in got.where("owner_key = 1").collect()} == {(1, True), (2, True), (3, True)}


@pytest.mark.parametrize("parts", [1, 5])
def test_sessions_expire_by_timer(spark, tmp_path, rocksdb, parts):
    rng = random.Random(2)
    schema = "owner_key long, expected int, event_id long, occurred_at timestamp"
    rows = [
        (o, rng.choice([None, None, 1, 2, 3]), 100 * o + k, T0 + dt.timedelta(seconds=rng.randint(0, 600)))
        for o in range(3) for k in range(40)
    ]
    batches = split(rows, 50, parts, parts) + [[(9, None, 999, T0 + dt.timedelta(hours=5))], [(9, None, 1000, T0 + dt.timedelta(hours=9))]]
    got = run(spark, tmp_path, batches, schema, lambda s: timed.turns_in_order(s, 100, "1 minute"))
    want = timed.turns_table(spark.createDataFrame(rows, schema), 100)
    assert {tuple(r) for r in got.where("owner_key < 9").collect()} == {tuple(r) for r in want.collect()}
    assert {r.verdict for r in want.collect()} == {"opened", "applied", "stale", "no_session"}
    left = spark.read.format("statestore").option("stateVarName", "session").load(str(tmp_path / "c"))
    assert {r.key.owner_key for r in left.select("key").collect()} <= {9}  # the others' sessions are gone


def test_retention_purges_by_timer(spark, tmp_path, rocksdb):
    schema = "owner_key long, event_id long, occurred_at timestamp"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(1, 1, at(0)), (1, 1, at(5)), (1, 2, at(50))], [(1, 3, at(400)), (2, 4, at(410))], [(1, 1, at(450))], [(9, 9, at(520))]]
    path = str(tmp_path / "kept")
    run(spark, tmp_path, batches, schema, lambda s: timed.retained(s, 120, "10 seconds"), timed.apply_changes(path))
    changes = {(r.event_id, r.change, (r["at"] - int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) // 10**6) for r in spark.read.parquet(path).collect()}
    assert changes == {(1, "kept", 0), (2, "kept", 50), (1, "purged", 120), (2, "purged", 170), (3, "kept", 400), (4, "kept", 410), (1, "kept", 450)}
    assert {(r.owner_key, r.event_id) for r in timed.kept_events(spark, path).collect()} == {(1, 3), (1, 1), (2, 4)}
    left = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "c"))
    assert left.count() == 3  # events 3, 4 and the second 1


def test_classes_of_paths(spark):
    rows = [("POST", "/auth/login"), ("get", "/auth/login"), ("put", "/ops/x"), ("DELETE", "/decision/a"), ("PATCH", "/proftest/profile"), ("POST", "/x"), (None, "/ops/x")]
    got = timed.class_caps(spark.createDataFrame(rows, "method string, path string"), {"auth": 2, "ops": 5, "sensitive": 3}).collect()
    assert [(r.cap_class, r.cap) for r in got] == [("auth", 2), (None, None), ("ops", 5), ("sensitive", 3), ("sensitive", 3), (None, None), (None, None)]
