"""Hand rows: the cases that matter, and edges that the tables do not have."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from edulens.functions import scalars as fn
from edulens.operators import admission, benefits, cleansing, decision, knowledge, metrics, policy, projections, quality, recommend, text
from edulens.sources import readers, sinks
from edulens.streaming import events as stream


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_metric_status_and_missing(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 1.0, 0.9, 10.0), (1, 0.3, 1.0, 0.7, 30.0), (2, None, 0.0, 0.0, 5.0), (3, 0.4, 0.5, 0.8, 1.0), (3, None, 0.0, 0.0, 1.0)],
        "university_id int, value double, coverage double, confidence double, weight double",
    )
    got = metrics.metric_query(df, "weighted_mean", ["university_id"])
    assert rows(got, "university_id", "value", "status", "missing") == [
        (1, 0.35, "available", 0), (2, None, "insufficient_data", 1), (3, 0.4, "partial", 1),
    ]
    assert [r.university_id for r in got.collect()] == [3, 1, 2]  # missing sorts as -1
    with pytest.raises(ValueError):
        metrics.metric_query(df, "mode", ["university_id"])


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("p", "c", 1.0), ("p", "d", 0.0), ("q", "a", 2.0)], "k string, item string, v double")
    got = rows(fn.shares_with_residual(df, ["k"], "v", "item"), "k", "item", "share")
    assert got == [("p", "a", 0.3333), ("p", "b", 0.3333), ("p", "c", 0.3334), ("q", "a", 1.0)]


def test_basis_falls_back(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0), (2, 0.5, 1.0), (3, 0.1, 0.2)], "program_id int, hours double, credits double")
    assert rows(projections.select_basis(df, ["hours", "credits"]), "program_id", "basis", "status") == [
        (1, "hours", "partial"), (2, "credits", "available"), (3, None, "insufficient_data"),
    ]


def test_admission_fit_ladder(spark):
    exams = spark.createDataFrame([(1, "m", 50.0), (1, "r", 40.0), (2, "m", None)], "offering_id int, subject string, minimum_score double")
    scores = spark.createDataFrame([(7, "m", 80.0), (7, "r", 70.0), (8, "m", 45.0), (8, "r", 90.0), (9, "m", 90.0)], "applicant_id int, subject string, score double")
    offers = spark.createDataFrame([(1, 150.0), (2, None)], "offering_id int, cutoff double")
    pairs = spark.createDataFrame([(a, o) for a in (7, 8, 9) for o in (1, 2)], "applicant_id int, offering_id int")
    got = admission.admission_fit(admission.match_exam_scores(exams, scores, pairs), offers)
    assert rows(got, "applicant_id", "offering_id", "status", "fit_score") == [
        (7, 1, "realistic", 100), (7, 2, "insufficient_data", 100), (8, 1, "unlikely", 94),
        (8, 2, "insufficient_data", 100), (9, 1, "insufficient_data", 79), (9, 2, "insufficient_data", 100),
    ]


def test_ambiguous_subject(spark):
    exams = spark.createDataFrame([(1, "m", 50.0)], "offering_id int, subject string, minimum_score double")
    scores = spark.createDataFrame([(7, "m", 80.0), (7, "m", 60.0)], "applicant_id int, subject string, score double")
    pairs = spark.createDataFrame([(7, 1)], "applicant_id int, offering_id int")
    assert rows(admission.match_exam_scores(exams, scores, pairs), "resolution", "score") == [("ambiguous", None)]


def test_content_fit_neutral_and_bounds(spark):
    prof = spark.createDataFrame([(1, "subject", "a", 1.0), (2, "negative", "a", 1.0)], "profile_id int, kind string, key string, weight double")
    area = spark.createDataFrame([("p", "a", 1.0)], "program_id string, area string, share double")
    act = spark.createDataFrame([("p", "research", 1.0)], "program_id string, activity string, share double")
    subj = spark.createDataFrame([], "program_id string, area string, distinctiveness double")
    got = recommend.content_fit(prof, area, act, subj)
    assert rows(got, "profile_id", "content_fit") == [(1, 78), (2, 0)]  # .55*100+.25*50+.2*50, and 50-60


def test_upsert_accounts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, None, 1)], "k int, v string, fixed int")
    new = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (3, "c", 2), (5, "n", 1)], "k int, v string, fixed int")
    assert rows(sinks.upsert(old, new, ["k"], ["fixed"]), "k", "v", "fixed", "change") == [
        (1, "a", 1, "unchanged"), (2, "x", 1, "updated"), (3, "c", 1, "conflict"), (4, None, 1, "kept"), (5, "n", 1, "inserted"),
    ]


def test_scoped_sync_without_source_keeps(spark):
    old = spark.createDataFrame([(1, "a")], "k int, source_kind string")
    assert sinks.scoped_sync(old, None, ["k"], "a").count() == 1


def test_write_version(spark, tmp_path):
    path = sinks.write_version(spark.range(5), str(tmp_path), "1")
    assert spark.read.parquet(path).count() == 5


def test_collapse_takes_first_known(spark):
    df = spark.createDataFrame(
        [("p", "d", 1, 10, None, "exam", 2, 0), ("p", "d", 1, 30, 5, "credit", 1, 1), ("p", "d", 1, 20, 7, "exam", 3, 2), ("p", "d", None, 5, 1, "exam", 4, 3)],
        "program_id string, discipline_id string, semester int, hours int, credits int, assessment string, position int, o int",
    )
    got = cleansing.collapse_rows(df, F.col("o"))
    assert rows(got, "semester", "hours", "credits", "position", "assessments", "merged") == [(1, 30, 5, 1, "exam,credit", 3), (None, 5, 1, 4, "exam", 1)]


def test_quality_gate(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.1, 1.0), ("c", 1.0, 0.2), ("d", None, 1.0)], "u string, x double, y double")
    assert rows(quality.quality_gate(df, {"x": 0.5}, {"y": 0.5}), "u", "decision") == [("a", "passed"), ("b", "rejected"), ("c", "degraded"), ("d", "rejected")]


def test_caps_use_up_in_order(spark):
    df = spark.createDataFrame([(1, "c", 3, 5.0, 6.0), (1, "c", 1, 4.0, 6.0), (1, "d", 2, 5.0, 9.0)], "applicant_id int, category string, place int, points double, category_cap double").withColumns({"code": F.lit(0), "year": F.lit(0)})
    assert rows(benefits.apply_caps(df, 10.0), "place", "in_category", "award") == [(1, 4.0, 4.0), (2, 5.0, 5.0), (3, 2.0, 1.0)]


def test_approval_and_conflicts(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    ev = spark.createDataFrame([(1, 1, 1, "submitted", t[0]), (1, 1, 2, "approved", t[1]), (2, 1, 1, "approved", t[0]), (3, 1, 1, "submitted", t[1]), (3, 1, 2, "approved", t[0])], "rule_id int, revision int, sequence int, kind string, recorded_at timestamp")
    assert rows(policy.approval_state(ev), "rule_id", "state") == [(1, "approved"), (2, "invalid"), (3, "invalid")]
    cf = spark.createDataFrame([(1, 1, "opened", t[0]), (1, 2, "resolved", t[1]), (1, 3, "reopened", t[2]), (2, 1, "resolved", t[0])], "conflict_id int, sequence int, kind string, recorded_at timestamp")
    assert rows(knowledge.conflict_state(cf), "conflict_id", "state") == [(1, "open"), (2, "invalid")]


def test_selector_kleene(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "any", None, []), (1, 2, 1, "equals", "a", ["x"]), (1, 3, 1, "equals", "b", ["y"]), (2, 1, None, "exists", "zz", [])],
        "rule_id int, node_id int, parent_id int, kind string, field string, values array<string>",
    )
    ctx = spark.createDataFrame([(1, "a", "n", "known"), (1, "b", None, "unknown"), (2, "a", "x", "known"), (2, "b", "n", "known")], "request_id int, field string, value string, availability string")
    assert rows(policy.eval_selectors(nodes, ctx), "request_id", "rule_id", "v") == [(1, 1, 0.5), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 0.0)]


def test_what_if_reports_only_changes(spark):
    cols = "request_id int, rule_id int, family_id int, authority int, scope_level string, content_hash string, state string"
    base = spark.createDataFrame([(1, 1, 1, 1, "federal", "h1", "candidate"), (1, 2, 2, 1, "federal", "h2", "candidate")], cols)
    new = spark.createDataFrame([(1, 3, 1, 2, "federal", "h3", "candidate")], cols)
    none = spark.createDataFrame([], "source_rule int, kind string, target_rule int")
    got = policy.what_if(base, new, lambda r: policy.effective_rules(r, none))
    assert rows(got, "family_id", "was", "is", "change") == [(1, 1, 3, "changed")]


def test_allow_list(spark):
    urls = ["https://a.org/x/y", "https://a.org/xy", "http://a.org/x", "https://u@a.org/x", "https://a.org:8/x", "https://a.org/x?q=1", "https://a.org/x/%2e%2e/z", "https://b.org/x", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    routes = spark.createDataFrame([("a.org", "/x")], "host string, prefix string")
    assert rows(knowledge.allowlisted(df, routes), "i") == [(0,)]


def actions():
    kinds = ["add", "add", "choose", "remove", "exclude", "restore"]
    return [(o, s, kinds[(o * 7 + s * 5) % 6], (s * 3 + o) % 4) for o in range(4) for s in range(30)]


def brute(acts):
    short, gone, choice, rev, bad = [], [], None, 0, 0
    for _, _, a, p in acts:
        ok = {"add": p not in short and p not in gone, "remove": p in short, "exclude": p not in gone, "restore": p in gone, "choose": p in short}[a]
        rev, bad = rev + ok, bad + (not ok)
        if ok:
            if a == "add":
                short.append(p)
            if a in ("remove", "exclude") and p in short:
                short.remove(p)
            if a == "exclude":
                gone.append(p)
            if a == "restore":
                gone.remove(p)
            if a == "choose":
                choice = p
            if choice is not None and choice not in short:
                choice = None
    return short, gone, choice, rev, bad


def test_decision_state_fold(spark):
    df = spark.createDataFrame(actions(), "owner_key long, seq long, action string, program_id long").repartition(7)
    got = {r.owner_key: (list(r.shortlist), list(r.excluded), r.choice, r.revision, r.rejected) for r in decision.decision_state(df).collect()}
    assert got == {o: brute([a for a in actions() if a[0] == o]) for o in range(4)}


def test_sliding_cap_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = [(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 10, 11, 12, 13])]
    df = spark.createDataFrame(ev, "owner_key long, event_id long, occurred_at timestamp")
    assert rows(stream.sliding_cap_batch(df, 2, 10), "event_id") == [(0,), (1,), (4,), (5,)]


def run_stream(spark, out, mode="append"):
    q = out.writeStream.format("memory").queryName("t" + str(id(out))).outputMode(mode).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("t" + str(id(out)))


def as_stream(spark, tmp_path, data, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "owner_key long, event_id long, event_type string, occurred_at timestamp, expires_at timestamp"
    data = [(1, i // 2, "a", t0 + dt.timedelta(seconds=i), None) for i in range(8)] + [(2, 99, "b", t0, t0 - dt.timedelta(days=1))]
    src = as_stream(spark, tmp_path, data, schema)
    assert rows(run_stream(spark, stream.dedupe_events(src)), "event_id") == [(0,), (1,), (2,), (3,)]
    got = run_stream(spark, stream.sliding_cap(src, 3, 100))
    assert sum(r.accepted for r in got.collect()) == 4  # three of owner 1, one of owner 2
    assert run_stream(spark, stream.streaming_funnel(src), "complete").count() == 2


def test_decision_stream_matches_fold(spark, tmp_path):
    src = as_stream(spark, tmp_path, actions(), "owner_key long, seq long, action string, program_id long")
    got = run_stream(spark, stream.decision_stream(src))
    last = {r.owner_key: r.rev for r in got.groupBy("owner_key").agg(F.max("revision").alias("rev")).collect()}
    assert last == {o: brute([a for a in actions() if a[0] == o])[3] for o in range(4)}


def test_decision_stream_with_times_and_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(*a, t0 + dt.timedelta(minutes=a[1])) for a in actions()]
    src = as_stream(spark, tmp_path, data, "owner_key long, seq long, action string, program_id long, occurred_at timestamp")
    got = run_stream(spark, stream.decision_stream(src))
    last = {r.owner_key: r.rev for r in got.groupBy("owner_key").agg(F.max("revision").alias("rev")).collect()}
    assert last == {o: brute([a for a in actions() if a[0] == o])[3] for o in range(4)}
    assert run_stream(spark, stream.session_windows(src), "complete").agg(F.sum("events")).first()[0] == len(data)


def test_selector_trees_of_any_height(spark):
    """all over any over all … nine levels deep, and a circle."""
    kinds = ["all", "any"] * 4 + ["all"]
    nodes = [(1, k, k - 1 if k else None, kind, None, None) for k, kind in enumerate(kinds)]
    nodes += [(1, 9, 8, "equals", "f", ["x"]), (1, 10, 4, "in", "g", ["a", "b"]), (2, 0, None, "exists", "f", None)]
    schema = "rule_id long, node_id int, parent_id int, kind string, field string, values array<string>"
    ctx = [(1, "f", "x", "known"), (1, "g", "c", "known"), (2, "f", "y", "known"), (2, "g", "a", "unknown"), (3, "h", "z", "known")]
    context = spark.createDataFrame(ctx, "request_id long, field string, value string, availability string")
    got = {(r.request_id, r.rule_id): r.v for r in policy.eval_selectors(spark.createDataFrame(nodes, schema), context).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 1.0, (3, 1): 0.5, (3, 2): 0.0}
    circle = spark.createDataFrame([(1, 1, 2, "all", None, None), (1, 2, 1, "any", None, None)], schema)
    with pytest.raises(ValueError):
        policy.eval_selectors(circle, context)


def test_traverse_caps_nodes(spark):
    edges = spark.createDataFrame([(k, 2 * k + i) for k in range(1, 200) for i in (0, 1)], "source long, target long")
    roots = spark.createDataFrame([(1,), (150,)], "root long")
    got = policy.traverse(edges, roots, 10, max_nodes=20)
    assert {r.root: r["count"] for r in got.groupBy("root").count().collect()} == {1: 20, 150: 3}
    assert {r.root for r in got.where("truncated").collect()} == {1}
    assert policy.traverse(edges, roots, 10).where("root = 1").count() == 399


def test_json_readers(spark, tmp_path):
    ok = {"external_key": "e1", "title": "T", "kind": "lecture", "starts_at": "2024-05-01T10:00:00+03:00", "ends_at": "2024-05-01T11:00:00+03:00", "venue": {"external_key": "v", "name": "V"}}
    bad = [dict(ok, ends_at="2024-05-01T09:00:00+03:00"), dict(ok, starts_at="2024-05-01T10:00:00"), dict(ok, kind="party"), dict(ok, title=None)]
    (tmp_path / "e.json").write_text(json.dumps({"events": [ok, *bad]}))
    good, refused = readers.read_events_json(spark, str(tmp_path / "e.json"))
    assert good.count() == 1 and rows(refused, "reason") == [("bad_start",), ("ends_before_start",), ("missing_identity",), ("unknown_kind",)]
    pts = [{"external_key": "a", "latitude": "1.5", "longitude": "2.5"}, {"external_key": "b", "latitude": "1.5"}, {"external_key": "c"}]
    (tmp_path / "p.json").write_text(json.dumps({"points": pts}))
    good, refused = readers.read_points_json(spark, str(tmp_path / "p.json"))
    assert rows(good, "external_key") == [("a",), ("c",)] and rows(refused, "reason") == [("one_coordinate",)]


def test_html_text(spark):
    html = "<html><style>p{}</style><nav>x</nav><p>One <b>two</b></p><script>if(a<b)</script>\n<p>th&eacute;</p></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert rows(readers.extract_text(df), "page_id", "text") == [(1, "One\ntwo\nthé"), (2, None), (3, "")]


def test_scalars(spark):
    df = spark.createDataFrame([("  Straße   X ", "экзамен, зачет", "3,5", "Очно-заочная", "Математика (профиль)")], "a string, b string, c string, d string, e string")
    r = df.select(
        fn.normalize_name(F.col("a"), True).alias("a"), fn.assessment_types(F.col("b")).alias("b"), fn.decimal_comma(F.col("c")).cast("double").alias("c"),
        fn.normalize_form(F.col("d")).alias("d"), fn.subject_key(F.col("e")).alias("e"), fn.quantize(F.lit(0.00005), 4, True).cast("double").alias("f"), fn.quantize(F.lit(0.00005), 4).cast("double").alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("strasse x", ["exam", "credit"], 3.5, "part_time", "математика", 0.0, 0.0001)


def test_predicate_failure_is_unavailable(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")

    def judge(pdf: pd.DataFrame):
        raise RuntimeError

    assert rows(metrics.predicate_filter(df, ["t"], judge), "i", "kept", "reason") == [(1, False, "unavailable"), (2, False, "unavailable")]


def test_resolution_is_repeatable(spark):
    ent = spark.createDataFrame([(1, 1, "c1", "data science"), (2, 2, "c2", "data analysis"), (3, 1, "c3", "science of data")], "entity_id int, university_id int, code string, name string")
    al = spark.createDataFrame([(2, "DA")], "entity_id int, alias string")
    q = spark.createDataFrame([(1, "C1", None), (2, "da", None), (3, "science data", None), (4, "science data", 2), (5, "", None)], "query_id int, query string, university_id int")
    a = rows(text.resolve_entities(q, ent, al), "query_id", "entity_id", "score", "status")
    assert a == rows(text.resolve_entities(q.repartition(7), ent.repartition(5), al), "query_id", "entity_id", "score", "status")
    assert a == [(1, 1, 1.0, "exact"), (2, 2, 0.9, "resolved"), (3, 1, 0.7, "ambiguous"), (3, 3, 0.7, "ambiguous"), (4, None, None, "not_found"), (5, None, None, "not_found")]


def test_holders_join_on_the_rarest_token(spark):
    import random

    rng = random.Random(3)
    names = [["common", *rng.sample("abcdefgh", rng.randint(0, 3))] for _ in range(60)]
    asked = [rng.sample(["common", *"abcdefgh", "unknown"], rng.randint(0, 3)) for _ in range(40)]
    ent = spark.createDataFrame([(i, i % 3, n) for i, n in enumerate(names)], "entity_id int, university_id int, own array<string>")
    q = spark.createDataFrame([(i, None, t) for i, t in enumerate(asked)], "query_id int, _u int, tokens array<string>")
    want = sorted(((i, j) for i, t in enumerate(asked) if t for j, n in enumerate(names) if set(t) <= set(n)), key=str)
    assert rows(text.holders(q, ent), "query_id", "entity_id") == want


def test_selector_trace_agrees_with_values_and_gives_reasons(spark):
    kinds = ["all", "any"] * 4 + ["all"]
    nodes = [(1, k, k - 1 if k else None, kind, None, None) for k, kind in enumerate(kinds)]
    nodes += [(1, 9, 8, "equals", "f", ["x"]), (1, 10, 4, "in", "g", ["a", "b"]), (2, 0, None, "exists", "f", None)]
    schema = "rule_id long, node_id int, parent_id int, kind string, field string, values array<string>"
    ctx = [(1, "f", "x", "known"), (1, "g", "c", "known"), (2, "f", "y", "known"), (2, "g", "a", "unavailable"), (3, "h", "z", "known"), (3, "g", None, "unknown")]
    context = spark.createDataFrame(ctx, "request_id long, field string, value string, availability string")
    df = spark.createDataFrame(nodes, schema)
    got = {(r.request_id, r.rule_id, r.node_id): (r.state, r.reason) for r in policy.selector_trace(df, context).collect()}
    name = {1.0: "match", 0.0: "no_match", 0.5: "indeterminate"}
    for r in policy.eval_selectors(df, context).collect():
        assert got[r.request_id, r.rule_id, 0][0] == name[r.v]
    assert len(got) == 3 * len(nodes)
    assert got[1, 1, 9] == ("match", "value_matched") and got[1, 1, 10] == ("no_match", "value_mismatched")
    assert got[1, 1, 4] == ("no_match", "child_mismatched") and got[1, 1, 8] == ("match", "all_matched")
    assert got[2, 1, 10] == ("indeterminate", "field_unavailable") and got[3, 1, 10] == ("indeterminate", "field_unknown")
    assert got[3, 1, 9] == ("indeterminate", "field_missing") and got[3, 2, 0] == ("no_match", "field_missing")
    assert got[1, 2, 0] == ("match", "value_exists") and got[2, 1, 7] == ("no_match", "none_matched")
    for judge in (policy.selector_trace, policy.eval_selectors):
        with pytest.raises(ValueError):
            judge(spark.createDataFrame([(1, 0, None, "not", None, None), (1, 1, 0, "exists", "f", None)], schema), context)
        with pytest.raises(ValueError):
            judge(spark.createDataFrame([(1, 1, 2, "all", None, None), (1, 2, 1, "any", None, None)], schema), context)
