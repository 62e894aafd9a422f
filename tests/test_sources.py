"""Documents that cannot be read, and tables replaced bucket by bucket."""

import json
import os

import pytest
from pyspark.sql import functions as F

from edulens.sources import readers, sinks

OK = {"external_key": "e1", "title": "T", "kind": "lecture", "starts_at": "2024-05-01T10:00:00Z"}


def test_every_document_is_counted_once(spark, tmp_path):
    files = {
        "good": json.dumps({"events": [OK, dict(OK, kind="party")]}), "cut": json.dumps({"events": [OK]})[:-3],
        "none": "", "other": "[1, 2]", "field": json.dumps({"points": []}), "zero": json.dumps({"events": []}),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, refused = readers.read_events_json(spark, str(tmp_path))
    assert [os.path.basename(r.document) for r in good.collect()] == ["good.json"]
    got = {(os.path.basename(r.document), r.reason) for r in refused.collect()}
    assert got == {
        ("good.json", "unknown_kind"), ("cut.json", "malformed_document"), ("other.json", "malformed_document"), ("field.json", "no_records")
    } | ({("none.json", "malformed_document")} if any(k[0] == "none.json" for k in got) else set())
    docs = spark.createDataFrame([("a", None), ("b", " "), ("c", "{"), ("d", "{}")], "document string, body string")
    for parse in (readers.parse_events, readers.parse_points):
        good, refused = parse(docs)
        assert good.count() == 0
        assert {(r.document, r.reason) for r in refused.collect()} == {(k, "malformed_document") for k in "abc"} | {("d", "no_records")}
        assert parse(docs.limit(0))[1].count() == 0


def test_points_out_of_bounds(spark):
    pts = [{"external_key": "a", "latitude": "91", "longitude": "1"}, {"external_key": "b", "latitude": "x", "longitude": "1"}, {"external_key": "c", "latitude": "-90", "longitude": "180"}]
    good, refused = readers.parse_points(spark.createDataFrame([("d", json.dumps({"points": pts}))], "document string, body string"))
    assert [(r.external_key, str(r.latitude)) for r in good.collect()] == [("c", "-90.000000")]
    assert {(r.external_key, r.reason) for r in refused.collect()} == {("a", "bad_coordinate"), ("b", "bad_coordinate")}


def files(path):
    return {d: sorted((f, os.path.getmtime(os.path.join(d, f))) for f in names if f.endswith("parquet")) for d, _, names in os.walk(path) if "bucket=" in d}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, v) for k in range(50) for v in range(3)] + [(None, 7)]
    schema = "program_id long, v long"
    sinks.write_buckets(spark.createDataFrame(rows, schema), path, "program_id", 16)
    before = files(path)
    fresh = spark.createDataFrame([(3, 30), (4, 40), (99, 1)], schema)
    affected = spark.createDataFrame([(3,), (4,), (99,), (5,), (None,)], "program_id long")
    with pytest.raises(ValueError):
        sinks.replace_in_buckets(path, fresh, "program_id", 16, affected.where("program_id < 9"))
    n = sinks.replace_in_buckets(path, fresh, "program_id", 16, affected)
    got = sorted((tuple(r) for r in spark.read.parquet(path).select("program_id", "v").collect()), key=str)
    want = [r for r in rows if r[0] not in (3, 4, 5, 99, None)] + [(3, 30), (4, 40), (99, 1)]
    assert got == sorted(want, key=str)
    after = files(path)
    same = [d for d in before if before[d] == after.get(d)]
    assert len(before) - len(same) <= n <= 5 and len(same) >= 8
    assert sinks.replace_in_buckets(path, fresh.limit(0), "program_id", 16) == 0


def test_a_bucket_without_rows_left_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "program_id long, v long")
    sinks.write_buckets(df, path, "program_id", 64)
    sinks.replace_in_buckets(path, df.limit(0), "program_id", 64, df.where("v = 2").select("program_id"))
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("program_id", "v").collect()) == [(1, 1), (3, 3)]
