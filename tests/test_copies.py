"""Queries over tables repeated with shifted keys, against their SQL in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import SF, TABLES, plain

import __spark_entry__
from edulens.operators import benefits, knowledge, policy, recommend

KEYS = {
    "customer": {"c_custkey": "c"}, "supplier": {"s_suppkey": "s"}, "part": {"p_partkey": "p"}, "orders": {"o_orderkey": "o", "o_custkey": "c"},
    "lineitem": {"l_orderkey": "o", "l_partkey": "p", "l_suppkey": "s"}, "events": {"event_id": "e", "user_id": "u"},
}
COPIES = 3


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """A folder with COPIES of each table, and DuckDB over it."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    out, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    top = {}
    for t, keys in KEYS.items():
        for k, n in keys.items():
            top[n] = max(top.get(n, 0), con.execute(f"SELECT max({k}) + 1 FROM '{SF}/{t}.parquet'").fetchone()[0])
    for t in TABLES.split():
        new = ", ".join(f"{k} + i * {top[n]} AS {k}" for k, n in KEYS.get(t, {}).items())
        rows = f"SELECT * EXCLUDE (i) REPLACE ({new}) FROM '{SF}/{t}.parquet', range({COPIES}) r(i)" if new else f"FROM '{SF}/{t}.parquet'"
        con.execute(f"COPY ({rows}) TO '{out}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS FROM '{out}/{t}.parquet'")
    return str(out), con


def same(spark, copies, name):
    df = __spark_entry__.queries()[name](spark, copies[0])
    order = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    cur = copies[1].execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    assert got == sorted(str([plain(r[names.index(c)]) for c in order]) for r in cur.fetchall())


def test_conflicts_where_times_start_again(spark, copies):
    same(spark, copies, "wn11_conflict_state")


def test_conflict_steps_of_one_moment_are_in_order(spark):
    rows = [(1, 1, "opened", "2024-01-02"), (1, 2, "resolved", "2024-01-02"), (2, 1, "opened", "2024-01-02"), (2, 2, "resolved", "2024-01-01")]
    e = spark.createDataFrame(rows, "conflict_id int, sequence int, kind string, at string").selectExpr("*", "cast(at as timestamp) as recorded_at")
    assert sorted(map(tuple, knowledge.conflict_state(e).collect())) == [(1, "resolved"), (2, "invalid")]


def test_blocked_revisions_where_times_start_again(spark, copies):
    same(spark, copies, "kn7_blocked_revisions")


def benefit_tables(spark):
    """40 programs of which rules name a few, 30 rules, 60 applicants."""
    p = spark.range(40).selectExpr("id as program_id", "id % 2 as university_id", "id % 7 as direction_id")
    r = spark.range(30).selectExpr(
        "id as rule_id", "id % 2 as university_id", "element_at(array('all', 'only', 'except'), int(id % 3 + 1)) as mode", "id div 5 as olympiad_id",
        "if(id % 4 = 0, 'bvi', 'hundred_points') as route", "'active' as status", "3 as max_level", "2020 as min_year",
    )
    named = spark.range(30).where("id % 3 <> 0")
    t = named.selectExpr("id as rule_id", "'program' as kind", "string(id % 4) as value").unionByName(
        named.where("id % 5 = 0").selectExpr("id as rule_id", "'direction' as kind", "if(id % 2 = 0, string(id % 7), null) as value")
    )
    f = spark.range(60).selectExpr("id as applicant_id", "id as fact_id", "id % 6 as olympiad_id", "int(id % 5) as level", "int(2018 + id % 7) as result_year")
    c = f.join(r, "olympiad_id").selectExpr("applicant_id", "fact_id", "rule_id", "element_at(array('confirmed', 'missing_score', 'not_required'), int((fact_id + rule_id) % 3 + 1)) as confirmation")
    return f, r, t, p, c


def test_best_rules_by_groups_of_programs(spark):
    f, r, t, p, c = benefit_tables(spark)
    groups = benefits.alike(p, t)
    assert groups.count() < 20 and groups.agg({"stands_for": "sum"}).first()[0] == 40
    want = benefits.benefit_eligibility(f, r, benefits.rule_scope(r, t, p), c).select("applicant_id", "status", "route", "rule_id").distinct()
    got = benefits.best_rules(f, r, t, p, c)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rules_for_olympiad_by_groups_of_programs(spark):
    f, r, t, p, c = benefit_tables(spark)
    scoped = benefits.rule_scope(r, t, p).where("scope = 'applies'")
    want = r.join(scoped, "rule_id", "left").groupBy("olympiad_id").agg(F.count_distinct("rule_id"), F.count_distinct("program_id"))
    got = benefits.rules_for_olympiad(r, t, p).select("olympiad_id", "rules", "programs")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["ab4_hundred_points", "ab5_competitive_score", "ab7_admission_decision", "wn12_best_choice_exams"])
def test_benefits_over_copies(spark, copies, name):
    same(spark, copies, name)


def test_selectors_of_rules_that_are_alike(spark):
    """40 rules with two trees and 30 requests with two contexts: the counts are those of the whole
    trace, and only four pairs are folded."""
    tree = "inline(array(struct(1, cast(null as int), 'all', cast(null as string), cast(array() as array<string>)), struct(2, 1, 'equals', 'a', array(string(id % 2))), struct(3, 1, 'exists', 'b', cast(array() as array<string>))))"
    nodes = spark.range(40).selectExpr("id as rule_id", tree + " as (node_id, parent_id, kind, field, values)")
    ctx = spark.range(30).selectExpr("id as request_id", "inline(array(struct('a', string(id % 2), 'known'), struct('b', 'x', 'known'))) as (field, value, availability)")
    assert policy.alike(nodes, "rule_id").select("like").distinct().count() == policy.alike(ctx, "request_id").select("like").distinct().count() == 2
    whole = policy.trace(nodes, ctx)
    got = policy.selector_trace(nodes, ctx)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(got.columns).collect()))
    keys = ["request_id", "node_id", "state", "reason"]
    want = whole.groupBy(*keys).agg(F.count(F.lit(1)))
    assert sorted(map(tuple, policy.selector_counts(nodes, ctx).collect())) == sorted(map(tuple, want.collect()))
    values = policy.eval_selectors(nodes, ctx)
    assert sorted(map(tuple, values.collect())) == sorted(map(tuple, policy.selector_values(nodes, ctx).select(values.columns).collect()))


def test_profiles_that_are_alike_are_fitted_once(spark):
    p = spark.range(12).selectExpr("id as profile_id", "inline(array(struct('subject', concat('a', id % 2), 0.75D), struct('negative', 'a2', 0.5D))) as (kind, key, weight)")
    area = spark.range(9).selectExpr("id as program_id", "inline(array(struct('a0', (id % 3) / 4), struct('a1', (id % 4) / 5), struct('a2', 0.2D))) as (area, share)")
    act = spark.createDataFrame([(0, "analytical", 0.5)], "program_id long, activity string, share double")
    subjects = area.withColumnRenamed("share", "distinctiveness")
    codes = spark.range(9).selectExpr("id as program_id", "string(id) as code")
    each = recommend.pair_fit(p, area, act, subjects)
    got = recommend.content_fit(p, area, act, subjects)
    assert sorted(map(tuple, got.select(each.columns).collect())) == sorted(map(tuple, each.collect()))
    keys = ["profile_id", "program_id", "place", "content_fit"]
    want = recommend.rank_fit(each.join(codes, "program_id"), 3).select(keys)
    top = recommend.best_fit(p, area, act, subjects, codes, 3).select(keys)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect()))
