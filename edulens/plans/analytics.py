"""Queries over projections, metrics, comparisons and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reference_data import activity_rows
from ..operators import compare, metrics, projections, recommend
from . import proxy as P
from .proxy import sql

MARKS = {"A": "exam_count", "N": "credit_count", "R": "graded_count"}
_MATRIX = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{s}', {w}::DOUBLE)" for a, s, w in activity_rows()
) + ") AS t(area, activity, activity_weight)"
P.CTES["matrix"] = _MATRIX
P.CTES["totals"] = """SELECT program_id, sum(hours) AS total_hours, sum(credits) AS total_credits, count(*) AS course_count,
  CASE WHEN sum(hours) > 0 THEN 'hours' WHEN sum(credits) > 0 THEN 'credits' ELSE 'normalized_workload' END AS basis,
  CAST(CASE WHEN sum(hours) > 0 THEN sum(hours) ELSE sum(credits) END AS DOUBLE) AS total_workload
  FROM items GROUP BY program_id"""
P.CTES["loads"] = """SELECT i.*, t.total_workload,
  CAST(CASE WHEN basis = 'hours' THEN hours ELSE coalesce(credits, 0) END AS DOUBLE) AS load
  FROM items i JOIN totals t USING (program_id)"""
P.CTES["area_load"] = """SELECT program_id, area, sum(load * weight) AS area_load
  FROM loads JOIN area_weights USING (discipline_id) GROUP BY program_id, area"""


def shares_sql(source: str, value: str, item: str, alias: str = "share") -> str:
    return f"""SELECT program_id, {item}, {value}, round(raw + CASE WHEN row_number() OVER
  (PARTITION BY program_id ORDER BY CAST({item} AS VARCHAR) DESC) = 1
  THEN 1 - sum(raw) OVER (PARTITION BY program_id) ELSE 0 END, 4) AS {alias}
  FROM (SELECT *, round({value} / sum({value}) OVER (PARTITION BY program_id), 4) AS raw
  FROM {source} WHERE {value} > 0)"""


P.CTES["area_share"] = shares_sql("area_load", "area_load", "area")
P.CTES["activity_load"] = """SELECT program_id, activity, sum(area_load * activity_weight) AS activity_load
  FROM area_load JOIN matrix USING (area) GROUP BY program_id, activity"""
P.CTES["activity_share"] = shares_sql("activity_load", "activity_load", "activity")
P.CTES["features"] = """SELECT discipline_id, feature, value, confidence, rule FROM (
  SELECT d.discipline_id, r.feature, r.value, r.confidence, r.rule, row_number() OVER
  (PARTITION BY d.discipline_id, r.feature ORDER BY r.value DESC, r.confidence DESC, r.rule) AS n
  FROM disciplines d JOIN rules r ON contains(d.name, r.keyword)) WHERE n = 1"""
P.CTES["semantic"] = """SELECT program_id, feature, round(sum(load * value) / any_value(total_workload), 6) AS value,
  round(sum(load) / any_value(total_workload), 6) AS coverage,
  round(sum(load * confidence) / nullif(sum(load), 0), 6) AS confidence, count(*) AS evidence_count
  FROM loads JOIN features USING (discipline_id) GROUP BY program_id, feature"""
P.CTES["math"] = """SELECT p.*, s.value, coalesce(s.coverage, 0) AS coverage, coalesce(s.confidence, 0) AS confidence,
  coalesce(t.total_workload, 0) AS weight FROM programs p
  LEFT JOIN (SELECT * FROM semantic WHERE feature = 'math') s USING (program_id)
  LEFT JOIN totals t USING (program_id)"""
BASE = ("items", "totals", "loads")
SHARE = (*BASE, "area_weights", "area_load")
FEAT = ("disciplines", "rules", "features")
SEM = (*BASE, *FEAT, "semantic")
MATH = ("programs", *SEM, "math")


def loads(spark, d):
    items = P.items(spark, d)
    return projections.item_workload(items, projections.workload(items))


def features(spark, d):
    return projections.classify_features(P.disciplines(spark, d), P.keyword_rules(spark))


def semantic(spark, d):
    return projections.semantic_metrics(loads(spark, d), features(spark, d))


def math_rows(spark, d):
    s = semantic(spark, d).where("feature = 'math'").drop("feature")
    t = projections.workload(P.items(spark, d)).select("program_id", F.col("total_workload").alias("weight"))
    j = P.programs(spark, d).join(s, "program_id", "left").join(t, "program_id", "left")
    return j.select(
        "program_id", "direction_id", "university_id", "code", "value",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("coverage", "confidence", "weight")],
    )


def shares(spark, d):
    return projections.area_share(loads(spark, d), P.area_weights(spark, d)).select("program_id", "area", "share")


def activities(spark, d):
    return projections.activity_share(
        loads(spark, d), P.area_weights(spark, d)
    ).select("program_id", "activity", "share")


def rows_by_name(spark, d):
    """One row per (program, name, semester) for comparisons."""
    j = P.items(spark, d).join(P.disciplines(spark, d).select("discipline_id", "name"), "discipline_id")
    return j.groupBy("program_id", "name", "semester").agg(
        F.sum("hours").alias("hours"), F.sum("credits").alias("credits")
    )


def selection(spark, d):
    """Three neighbouring programs per selection."""
    k = F.col("program_id")
    return P.programs(spark, d).select(
        (k / 3).cast("bigint").alias("selection_id"), "program_id", (k % 3).alias("place")
    )


def pairs(spark, d):
    return compare.program_pairs(selection(spark, d)).select("a", "b")


P.CTES["by_name"] = """SELECT program_id, name, semester, sum(hours) AS hours, sum(credits) AS credits
  FROM items JOIN disciplines USING (discipline_id) GROUP BY ALL"""
P.CTES["pairs"] = """SELECT a.program_id AS a, b.program_id AS b FROM programs a JOIN programs b
  ON a.program_id // 3 = b.program_id // 3 AND a.program_id < b.program_id"""
P.CTES["aligned"] = """SELECT a, b, name, semester, max(CASE WHEN side = 0 THEN hours END) AS hours_a,
  max(CASE WHEN side = 1 THEN hours END) AS hours_b, max(CASE WHEN side = 0 THEN credits END) AS credits_a,
  max(CASE WHEN side = 1 THEN credits END) AS credits_b, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb
  FROM (SELECT p.a, p.b, 0 AS side, r.* FROM pairs p JOIN by_name r ON r.program_id = p.a
  UNION ALL SELECT p.a, p.b, 1, r.* FROM pairs p JOIN by_name r ON r.program_id = p.b) GROUP BY a, b, name, semester"""
P.CTES["aligned2"] = """SELECT a, b, name, semester, hours_a, hours_b, credits_a, credits_b,
  CASE WHEN nb = 0 THEN 'only_a' WHEN na = 0 THEN 'only_b' WHEN hours_a IS NOT DISTINCT FROM hours_b
  AND credits_a IS NOT DISTINCT FROM credits_b THEN 'both' ELSE 'different' END AS status,
  coalesce(hours_b, 0) - coalesce(hours_a, 0) AS hours_delta, coalesce(credits_b, 0) - coalesce(credits_a, 0) AS credits_delta
  FROM aligned"""
P.CTES["differences"] = """SELECT *, CASE WHEN delta > 0 THEN 'more_in_b' WHEN delta < 0 THEN 'more_in_a' ELSE 'equal' END AS direction
  FROM (SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY abs(delta) DESC, key) AS place FROM (
  SELECT a, b, 'hours' AS kind, 'total' AS key, CAST(y.total_hours - x.total_hours AS DOUBLE) AS delta FROM pairs
    JOIN totals x ON x.program_id = a JOIN totals y ON y.program_id = b
  UNION ALL SELECT a, b, 'credits', 'total', CAST(coalesce(y.total_credits, 0) - coalesce(x.total_credits, 0) AS DOUBLE) FROM pairs
    JOIN totals x ON x.program_id = a JOIN totals y ON y.program_id = b
  UNION ALL SELECT a, b, 'area', area, delta FROM (SELECT a, b, area,
    round(coalesce(max(CASE WHEN program_id = b THEN share END), 0) - coalesce(max(CASE WHEN program_id = a THEN share END), 0), 4) AS delta
    FROM pairs JOIN area_share ON program_id IN (a, b) GROUP BY a, b, area) WHERE delta <> 0
  UNION ALL SELECT a, b, 'discipline', name || '@' || coalesce(CAST(semester AS VARCHAR), '-'),
    CAST(CASE WHEN abs(hours_delta) >= abs(credits_delta) THEN hours_delta ELSE credits_delta END AS DOUBLE)
    FROM aligned2 WHERE greatest(abs(hours_delta), abs(credits_delta)) > 0)) WHERE place <= 8"""
DIFF = ("programs", *SHARE, "area_share", "disciplines", "by_name", "pairs", "aligned", "aligned2", "differences")


def differences(spark, d):
    rows, pp = rows_by_name(spark, d), pairs(spark, d)
    return compare.key_differences(pp, compare.totals(rows), shares(spark, d), compare.align_curricula(rows, pp))


P.CTES["subjects"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program_id
  ORDER BY distinctiveness DESC, share DESC, name) AS place FROM (
  SELECT program_id, name, discipline_id, round(load / total, 6) AS share,
  round(load / total * (1 - CAST(df AS DOUBLE) / n), 6) AS distinctiveness FROM (
  SELECT *, count(*) OVER (PARTITION BY name) AS df, (SELECT count(DISTINCT program_id) FROM loads) AS n FROM (
  SELECT program_id, name, sum(load) AS load, any_value(total_workload) AS total, min(discipline_id) AS discipline_id
  FROM loads JOIN disciplines USING (discipline_id) GROUP BY program_id, name)))) WHERE place <= 8"""


def subjects(spark, d):
    return recommend.distinctive_subjects(loads(spark, d), P.disciplines(spark, d))


def profiles(spark, d):
    """The query set: tall profiles of the customers whose id is divisible by 100,
    each ranked against all programs."""
    c = P.table(spark, d, "customer").where("c_custkey % 100 = 0")
    k = (F.col("c_custkey") / 100).cast("bigint")
    seg = F.col("c_mktsegment")
    first = F.when(
        seg == "BUILDING", "engineering_technology"
    ).when(
        seg == "MACHINERY", "computer_science_data"
    ).when(seg == "HOUSEHOLD", "medicine_health").otherwise("economics_finance")
    weight = lambda kind, key, w: F.struct(
        kind.alias("kind"), (F.lit(key) if isinstance(key, str) else key).alias("key"), F.lit(w).alias("weight")
    )
    rows = F.array(
        weight(F.lit("subject"), first, 0.75),
        weight(F.lit("subject"), "mathematics_statistics", 0.25),
        weight(F.when(k % 2 == 0, "activity"), "analytical", 1.0),
        weight(F.when(k % 5 != 1, "negative"), "business_management", 0.5),
    )
    return c.select(F.col("c_custkey").alias("profile_id"), F.inline(rows)).where("kind is not null")


P.CTES["profiles"] = """SELECT c_custkey AS profile_id, 'subject' AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 'engineering_technology'
  WHEN 'MACHINERY' THEN 'computer_science_data' WHEN 'HOUSEHOLD' THEN 'medicine_health' ELSE 'economics_finance' END AS key,
  0.75::DOUBLE AS weight FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey, 'subject', 'mathematics_statistics', 0.25 FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey, 'activity', 'analytical', 1.0 FROM customer WHERE c_custkey % 200 = 0
  UNION ALL SELECT c_custkey, 'negative', 'business_management', 0.5 FROM customer WHERE c_custkey % 100 = 0 AND c_custkey // 100 % 5 <> 1"""


def subject_areas(spark, d):
    main = P.area_weights(spark, d).where("weight > 0.5").select("discipline_id", "area")
    return subjects(spark, d).join(main, "discipline_id").select("program_id", "area", "distinctiveness")


def fits(spark, d):
    return recommend.content_fit(profiles(spark, d), shares(spark, d), activities(spark, d), subject_areas(spark, d))


P.CTES["subject_areas"] = """SELECT program_id, area, distinctiveness FROM subjects JOIN area_weights USING (discipline_id) WHERE weight > 0.5"""
P.CTES["fits"] = """WITH k AS (SELECT profile_id, bool_or(kind = 'subject') AS hs, bool_or(kind = 'activity') AS ha FROM profiles GROUP BY 1),
  dt AS (SELECT program_id, sum(distinctiveness) AS total FROM subject_areas GROUP BY 1),
  s AS (SELECT profile_id, program_id, sum(weight * share) * 100 AS v FROM profiles JOIN area_share ON area = key WHERE kind = 'subject' GROUP BY 1, 2),
  a AS (SELECT profile_id, program_id, sum(weight * share) * 100 AS v FROM profiles JOIN activity_share ON activity = key WHERE kind = 'activity' GROUP BY 1, 2),
  n AS (SELECT profile_id, program_id, sum(weight * share) * 100 AS v FROM profiles JOIN area_share ON area = key WHERE kind = 'negative' GROUP BY 1, 2),
  f AS (SELECT profile_id, area, sum(w) AS w FROM (SELECT profile_id, key AS area, 0.7 * weight AS w FROM profiles WHERE kind = 'subject'
    UNION ALL SELECT profile_id, area, 0.3 * weight * activity_weight FROM profiles JOIN matrix ON activity = key WHERE kind = 'activity') GROUP BY 1, 2),
  u AS (SELECT profile_id, program_id, sum(w * distinctiveness) * 100 AS v FROM f JOIN subject_areas USING (area) GROUP BY 1, 2),
  x AS (SELECT k.profile_id, p.program_id, CASE WHEN hs THEN coalesce(s.v, 0) ELSE 50 END AS sf, CASE WHEN ha THEN coalesce(a.v, 0) ELSE 50 END AS af,
    CASE WHEN (hs OR ha) AND total > 0 THEN coalesce(u.v, 0) / total ELSE 50 END AS df, coalesce(n.v, 0) AS ap
    FROM k CROSS JOIN (SELECT DISTINCT program_id FROM area_share) p LEFT JOIN dt USING (program_id)
    LEFT JOIN s ON s.profile_id = k.profile_id AND s.program_id = p.program_id LEFT JOIN a ON a.profile_id = k.profile_id AND a.program_id = p.program_id
    LEFT JOIN n ON n.profile_id = k.profile_id AND n.program_id = p.program_id LEFT JOIN u ON u.profile_id = k.profile_id AND u.program_id = p.program_id)
  SELECT profile_id, program_id, round(sf, 4) AS subject_fit, round(af, 4) AS activity_fit, round(df, 4) AS distinctive_fit, round(ap, 4) AS anti_penalty,
  greatest(0, least(100, CAST(round(round(0.55 * sf + 0.25 * af + 0.2 * df - 0.6 * ap, 6)) AS INT))) AS content_fit FROM x"""
FIT = (
    *SHARE, "area_share", "matrix", "activity_load", "activity_share", "disciplines", "subjects", "subject_areas",
    "profiles", "fits"
)


def ranked(spark, d, k=10):
    codes = P.programs(spark, d).select("program_id", "code")
    return recommend.best_fit(profiles(spark, d), shares(spark, d), activities(spark, d), subject_areas(spark, d), codes, k)


def _query(aggregation, group_by, **more):
    return lambda spark, d: metrics.metric_query(math_rows(spark, d), aggregation, group_by, **more)


def _query_sql(expr, group_by, limit=100):
    g = ", ".join(group_by)
    return sql(
        f"""SELECT * FROM (SELECT {g}, round({expr}, 6) AS value, round(avg(CASE WHEN value IS NOT NULL THEN coverage END), 6) AS coverage,
  round(avg(CASE WHEN value IS NOT NULL THEN confidence END), 6) AS confidence, count(*) AS population, count(value) AS included,
  count(*) - count(value) AS missing, CASE WHEN count(value) = 0 THEN 'insufficient_data' WHEN count(value) = count(*) AND
  round(avg(coverage), 6) = 1 THEN 'available' ELSE 'partial' END AS status FROM math GROUP BY {g})
  ORDER BY coalesce(value, -1) DESC, {g} LIMIT {limit}""",
        *MATH,
    )


Q: dict = {}
S: dict = {}


def add(name, fn, oracle=None):
    Q[name] = fn
    if oracle:
        S[name] = oracle


add("ag1_mean_math_by_university", _query("mean", ["university_id"]), _query_sql("avg(value)", ["university_id"]))
for _a, _e in {
    "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "count": "CASE WHEN count(value) > 0 THEN CAST(count(value) AS DOUBLE) END",
    "weighted_mean": "coalesce(sum(value * weight) / nullif(sum(CASE WHEN value IS NOT NULL THEN weight END), 0), avg(value))",
}.items():
    add(f"ag1_{_a}_math_by_direction", _query(_a, ["direction_id"]), _query_sql(_e, ["direction_id"]))
add(
    "ag2_mean_by_two_keys", _query("mean", ["university_id", "direction_id"]),
    _query_sql("avg(value)", ["university_id", "direction_id"])
)
add("ag1_value_by_program", _query("value", ["program_id"]), _query_sql("avg(value)", ["program_id"]))
add(
    "ag1_distribution_by_university",
    _query("distribution", ["university_id"]),
    _query_sql("avg(value)", ["university_id"]).replace("GROUP BY university_id)", "GROUP BY university_id)").replace(
        "'partial' END AS status", "'partial' END AS status, min(value) AS low, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS high"
    ),
)
add(
    "ag3_result_summary",
    lambda s, d: metrics.result_summary(metrics.metric_query(math_rows(s, d), "mean", ["university_id"])),
    sql(
        """SELECT sum(population) AS population, sum(included) AS included, sum(missing) AS missing, round(avg(coverage), 6) AS coverage,
  round(avg(confidence), 6) AS confidence, CASE WHEN bool_and(status = 'available') THEN 'available'
  WHEN bool_or(status <> 'insufficient_data') THEN 'partial' ELSE 'insufficient_data' END AS status FROM (SELECT university_id,
  round(avg(CASE WHEN value IS NOT NULL THEN coverage END), 6) AS coverage, round(avg(CASE WHEN value IS NOT NULL THEN confidence END), 6) AS confidence,
  count(*) AS population, count(value) AS included, count(*) - count(value) AS missing, CASE WHEN count(value) = 0 THEN 'insufficient_data'
  WHEN count(value) = count(*) AND round(avg(coverage), 6) = 1 THEN 'available' ELSE 'partial' END AS status FROM math GROUP BY 1)""",
        *MATH,
    ),
)
add(
    "ag4_explain_metrics",
    lambda s, d: metrics.explain_metrics(semantic(s, d), P.programs(s, d)),
    sql(
        """SELECT feature, count(value) AS included, CAST(sum(evidence_count) AS BIGINT) AS evidence_count, (SELECT count(*) FROM programs) AS population,
  (SELECT count(*) FROM programs) - count(value) AS missing FROM semantic GROUP BY feature""",
        "programs", *SEM,
    ),
)
add("ag5_workload", lambda s, d: projections.workload(P.items(s, d)), sql("SELECT * FROM totals", "items", "totals"))
add("ag7_area_share", shares, sql("SELECT program_id, area, share FROM area_share", *SHARE, "area_share"))
add(
    "ag8_activity_share", activities,
    sql("SELECT program_id, activity, share FROM activity_share", *SHARE, "matrix", "activity_load", "activity_share")
)
add(
    "ag9_semester_share",
    lambda s, d: projections.semester_share(loads(s, d)).select("program_id", "semester", "share"),
    sql(
        f"""WITH sl AS (SELECT program_id, coalesce(CAST(semester AS VARCHAR), 'unassigned') AS semester, sum(load) AS semester_load FROM loads GROUP BY ALL)
  SELECT program_id, semester, share FROM ({shares_sql('sl', 'semester_load', 'semester')})""",
        *BASE,
    ),
)
add("ag10_semantic_metrics", semantic, sql("SELECT * FROM semantic", *SEM))
_TL = """timeline AS (SELECT program_id, feature, coalesce(CAST(semester AS VARCHAR), 'unassigned') AS semester, min(semester) AS first_semester,
  round(sum(load * value) / any_value(total_workload), 6) AS share FROM loads JOIN features USING (discipline_id) WHERE value > 0 GROUP BY ALL)"""


def timeline(s, d):
    return projections.feature_timeline(loads(s, d), features(s, d))


add(
    "ag11_feature_timeline",
    lambda s, d: timeline(s, d).select("program_id", "feature", "semester", "first_semester", "share"),
    sql(f"WITH {_TL} SELECT * FROM timeline", *BASE, *FEAT)
)
add(
    "ag12_period_share",
    lambda s, d: projections.period_share(timeline(s, d)),
    sql(
        f"""WITH {_TL} SELECT program_id, feature, round(sum(CASE WHEN try_cast(semester AS INT) <= 2 THEN share ELSE 0 END), 6) AS first_year,
  round(sum(CASE WHEN try_cast(semester AS INT) >= 5 THEN share ELSE 0 END), 6) AS late_years, min(first_semester) AS first_semester FROM timeline GROUP BY 1, 2""",
        *BASE, *FEAT,
    ),
)
add(
    "ag13_assessments",
    lambda s, d: projections.assessments(P.items(s, d), MARKS),
    sql(
        "SELECT program_id, " + ", ".join(
            f"count(*) FILTER (assessment = '{m}') AS {n}" for m, n in MARKS.items()
        ) + " FROM items GROUP BY 1",
        "items"
    ),
)


def basis_coverage(s, d):
    n = F.count(F.lit(1))
    return P.items(s, d).where("position > 3").groupBy("program_id").agg(
        (F.count("credits") / n).alias("credits"), (
            F.count(F.when(F.col("hours") > 10, 1)) / n
        ).alias("hours"), (n / n).alias("course_count")
    )


add(
    "ag6_select_basis",
    lambda s, d: projections.select_basis(
        basis_coverage(s, d), ["hours", "credits", "course_count"]
    ).withColumn("coverage", F.round("coverage", 6)),
    sql(
        """WITH c AS (SELECT program_id, count(credits) / count(*)::DOUBLE AS cr, count(*) FILTER (hours > 10) / count(*)::DOUBLE AS h FROM items WHERE position > 3 GROUP BY 1)
  SELECT program_id, CASE WHEN h >= 0.8 THEN 'hours' WHEN cr >= 0.8 THEN 'credits' ELSE 'course_count' END AS basis,
  round(CASE WHEN h >= 0.8 THEN h WHEN cr >= 0.8 THEN cr ELSE 1 END, 6) AS coverage,
  CASE WHEN h >= 0.8 THEN CASE WHEN h = 1 THEN 'available' ELSE 'partial' END WHEN cr >= 0.8 THEN CASE WHEN cr = 1 THEN 'available' ELSE 'partial' END ELSE 'available' END AS status FROM c""",
        "items",
    ),
)
add(
    "ag15_offering_metrics",
    lambda s, d: projections.offering_metrics(
        P.offerings(s, d), ["cutoff", "tuition"],
        (F.col("admission_year") == 1998) & (F.col("funding_type") == "F") & (F.col("study_form") == "1-URGENT")
    ),
    sql(
        """SELECT program_id, CASE WHEN count(cutoff) = 1 THEN max(cutoff) END AS cutoff, CASE WHEN count(tuition) = 1 THEN max(tuition) END AS tuition
  FROM offerings WHERE admission_year = 1998 AND funding_type = 'F' AND study_form = '1-URGENT' GROUP BY 1""",
        "offerings",
    ),
)
add(
    "ag16_projection_quality",
    lambda s, d: projections.projection_quality(semantic(s, d), 3),
    sql(
        """SELECT program_id, round(sum(coverage) / 3, 6) AS coverage, round(avg(confidence), 6) AS confidence, CASE WHEN sum(coverage) / 3 >= 1 THEN 'available'
  WHEN sum(coverage) > 0 THEN 'partial' ELSE 'insufficient_data' END AS status FROM semantic GROUP BY 1""",
        *SEM,
    ),
)
add(
    "ag17_totals", lambda s, d: compare.totals(P.items(s, d)),
    sql("SELECT program_id, sum(hours) AS hours, sum(coalesce(credits, 0)) AS credits FROM items GROUP BY 1", "items"),
)
add(
    "ag18_area_distribution",
    lambda s, d: compare.area_distribution(projections.area_load(loads(s, d), P.area_weights(s, d))),
    sql(
        """SELECT program_id, area, round(raw + CASE WHEN place = 1 THEN 1 - sum(raw) OVER (PARTITION BY program_id) ELSE 0 END, 4) AS share, place FROM (
  SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY raw DESC, area) AS place FROM (
  SELECT *, round(area_load / sum(area_load) OVER (PARTITION BY program_id), 4) AS raw FROM area_load))""",
        *SHARE,
    ),
)
add(
    "flt1_scope",
    lambda s, d: metrics.scope(P.programs(s, d), "university", [1, 3]),
    sql("SELECT * FROM programs WHERE university_id IN (1, 3)", "programs")
)
add(
    "flt2_id_filter", lambda s, d: metrics.id_filter(
        P.programs(s, d), university_id=[0, 1, 2], direction_id=list(range(0, 20, 2))
    ),
    sql(
        "SELECT * FROM programs WHERE university_id IN (0, 1, 2) AND direction_id IN (0, 2, 4, 6, 8, 10, 12, 14, 16, 18)",
        "programs"
    ),
)
add(
    "flt3_metric_filter",
    lambda s, d: metrics.metric_filter(math_rows(s, d), "value", "gte", 0.1).select("program_id", "value"),
    sql("SELECT program_id, value FROM math WHERE value >= 0.1", *MATH)
)
add(
    "flt4_feature_filter", lambda s, d: metrics.feature_filter(
        P.programs(s, d), semantic(s, d), "software", "gt", 0.1
    ).select("program_id", "code"),
    sql(
        "SELECT program_id, code FROM programs WHERE program_id IN (SELECT program_id FROM semantic WHERE feature = 'software' AND value > 0.1)",
        "programs", *SEM
    ),
)
add(
    "flt5_offering_filter", lambda s, d: metrics.offering_filter(
        P.programs(s, d), P.offerings(s, d), admission_year=1999, funding_type="P"
    ).select("program_id"),
    sql(
        "SELECT program_id FROM programs WHERE program_id IN (SELECT program_id FROM offerings WHERE admission_year = 1999) AND program_id IN (SELECT program_id FROM offerings WHERE funding_type = 'P')",
        "programs", "offerings"
    ),
)
add(
    "flt7_predicate_filter",
    lambda s, d: metrics.predicate_filter(
        P.programs(s, d).select("program_id", "code"), ["code"],
        lambda p: [None if c.endswith("7") else c.endswith(("1", "2")) for c in p["code"]]
    ).select("program_id", "verdict", "reason", "kept"),
    sql(
        """SELECT program_id, CASE WHEN code LIKE '%7' THEN NULL ELSE code LIKE '%1' OR code LIKE '%2' END AS verdict, CASE WHEN code LIKE '%7' THEN 'indeterminate'
  WHEN code LIKE '%1' OR code LIKE '%2' THEN 'matched' ELSE 'not_matched' END AS reason, code LIKE '%1' OR code LIKE '%2' AS kept FROM programs""",
        "programs",
    ),
)
add(
    "jn1_attach_disciplines", lambda s, d: projections.attach_disciplines(
        P.items(s, d), P.disciplines(s, d)
    )[0].groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hours").alias("hours")
    ),
    sql(
        "SELECT name, count(*) AS n, sum(hours) AS hours FROM items JOIN disciplines USING (discipline_id) GROUP BY 1",
        "items", "disciplines"
    ),
)
add(
    "jn2_align_curricula",
    lambda s, d: compare.align_curricula(rows_by_name(s, d), pairs(s, d)),
    sql("SELECT * FROM aligned2", "programs", "items", "disciplines", "by_name", "pairs", "aligned", "aligned2")
)
add(
    "cp1_compare_semester",
    lambda s, d: compare.align_curricula(rows_by_name(s, d), pairs(s, d), semester=3),
    sql(
        "SELECT * FROM aligned2 WHERE semester = 3", "programs", "items", "disciplines", "by_name", "pairs", "aligned",
        "aligned2"
    )
)
add("jn3_program_pairs", pairs, sql("SELECT * FROM pairs", "programs", "pairs"))
add("wn5_key_differences", differences, sql("SELECT * FROM differences", *DIFF))
add(
    "wn6_tradeoffs", lambda s, d: compare.tradeoffs(differences(s, d)),
    sql(
        """WITH t AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE kind WHEN 'area' THEN 0 ELSE 1 END, place) AS n FROM differences
  WHERE kind IN ('area', 'discipline') AND direction <> 'equal')
  SELECT a, b, n, kind, key, a AS program_id, direction = 'more_in_a' AS gains FROM t WHERE n <= 3
  UNION ALL SELECT a, b, n, kind, key, b, direction = 'more_in_b' FROM t WHERE n <= 3""",
        *DIFF,
    ),
)
add(
    "cp2_summary_gaps", lambda s, d: compare.summary_gaps(
        selection(s, d), P.items(s, d).where("program_id % 7 <> 0")
    ).select("selection_id", "program_id"),
    sql(
        "SELECT program_id // 3 AS selection_id, program_id FROM programs WHERE program_id NOT IN (SELECT program_id FROM items WHERE program_id % 7 <> 0)",
        "programs", "items"
    ),
)
add(
    "st1_vector_delta", lambda s, d: compare.vector_delta(
        shares(s, d).where("program_id = 1"),
        shares(s, d).where("program_id = 2 and area <> 'medicine_health'"), "area", "share"
    ),
    sql(
        """SELECT area, round(coalesce(b.share, 0) - coalesce(a.share, 0), 6) AS delta FROM (SELECT * FROM area_share WHERE program_id = 1) a
  FULL JOIN (SELECT * FROM area_share WHERE program_id = 2 AND area <> 'medicine_health') b USING (area)""",
        *SHARE, "area_share",
    ),
)
add("wn4_distinctive_subjects", subjects, sql("SELECT * FROM subjects", *BASE, "disciplines", "subjects"))
add("rc2_content_fit", fits, sql("SELECT * FROM fits", *FIT))
add(
    "wn2_rank_fit", lambda s, d: ranked(s, d).select("profile_id", "program_id", "content_fit", "place"),
    sql(
        """SELECT profile_id, program_id, content_fit, place FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY content_fit DESC, subject_fit DESC, code, program_id) AS place
  FROM fits JOIN programs USING (program_id)) WHERE place <= 10""",
        "programs", *FIT,
    ),
)
REASONS = """WITH f AS (SELECT profile_id, program_id, kind, key, weight, share FROM profiles JOIN area_share ON area = key WHERE kind IN ('subject', 'negative')
  UNION ALL SELECT profile_id, program_id, kind, key, weight, share FROM profiles JOIN activity_share ON activity = key WHERE kind = 'activity'
  UNION ALL SELECT profile_id, program_id, 'distinctive', key, weight, share FROM profiles JOIN (SELECT program_id, area, max(distinctiveness) AS share FROM subject_areas GROUP BY 1, 2) ON area = key WHERE kind = 'subject'),
  g AS (SELECT *, round(weight * share, 6) AS strength FROM f WHERE share > 0),
  h AS (SELECT *, row_number() OVER (PARTITION BY profile_id, program_id, kind ORDER BY strength DESC, key) AS n FROM g),
  i AS (SELECT *, row_number() OVER (PARTITION BY profile_id, program_id ORDER BY kind, n) AS place FROM h
    WHERE n <= CASE kind WHEN 'subject' THEN 3 WHEN 'negative' THEN 3 ELSE 2 END)
  SELECT profile_id, program_id, kind, n, key, strength FROM i WHERE place <= 8"""
add(
    "wn19_fit_reasons", lambda s, d: recommend.fit_reasons(
        profiles(s, d), shares(s, d), activities(s, d), subject_areas(s, d)
    ),
    sql(
        REASONS,
        *FIT,
    ),
)


def evidence_rows(s, d):
    k = F.col("c_custkey")
    return P.table(s, d, "customer").select(
        k.alias("profile_id"),
        F.when(k % 4 != 0, F.round((k % 10) / 10.0, 4)).alias("profile_confidence"),
        F.element_at(
            F.array(F.lit("blocking"), F.lit("degradable"), F.lit("informational"), F.lit("none")),
            (k % 4 + 1).cast("int")
        ).alias("worst_gap"),
        (k % 3).alias("n_runs"), (k % 2).alias("rows_without_run"), (k % 5).alias("n_sources"),
    )


EVIDENCE = """WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN round((c_custkey % 10) / 10.0::DOUBLE, 4) END AS p,
  CASE c_custkey % 4 WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 1.0::DOUBLE END AS c,
  CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 3 > 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END END AS f FROM customer),
  v AS (SELECT *, (p IS NOT NULL)::INT + (c IS NOT NULL)::INT + (f IS NOT NULL)::INT AS n FROM e)
  SELECT k AS profile_id, CASE WHEN p IS NOT NULL AND n >= 2 THEN round(round((coalesce(p * 0.5, 0) + coalesce(c * 0.3, 0) + coalesce(f * 0.2, 0)) /
    (0.5 + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END + CASE WHEN f IS NULL THEN 0 ELSE 0.2 END), 8), 4) END AS reliability,
  CASE WHEN p IS NULL OR n < 2 THEN 'not_available' WHEN n = 3 THEN 'available' ELSE 'partial' END AS reliability_status FROM v"""
add(
    "rc3_recommendation_evidence", lambda s, d: recommend.recommendation_evidence(evidence_rows(s, d)).select(
        "profile_id", "reliability", "reliability_status"
    ),
    sql(
        EVIDENCE
    ),
)


def tall_top(s, d):
    r = ranked(s, d, 10).select("profile_id", "program_id", "place", "content_fit")
    return r.join(shares(s, d).withColumnRenamed("area", "dimension").withColumnRenamed("share", "value"), "program_id")


_TOP = """top AS (SELECT profile_id, program_id, content_fit, place FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY content_fit DESC, subject_fit DESC, code, program_id) AS place
  FROM fits JOIN programs USING (program_id)) WHERE place <= 10)"""
add(
    "wn15_adaptive_dimensions",
    lambda s, d: recommend.adaptive_dimensions(
        tall_top(s, d),
        profiles(s, d).select("profile_id").distinct().withColumn(
            "confidence", F.round((F.col("profile_id") % 10) / 20.0, 4)
        )
    ).select("profile_id", "dimension", "significance", "place"),
    sql(
        f"""WITH {_TOP}, d AS (SELECT profile_id, area AS dimension, max(share) - min(share) AS spread, avg(share) AS mean FROM top JOIN area_share USING (program_id) GROUP BY 1, 2),
  e AS (SELECT *, round(least(1.0, spread * (0.5 + mean) * (1 - round((profile_id % 10) / 20.0::DOUBLE, 4))), 6) AS significance FROM d WHERE round(spread, 9) >= 0.08)
  SELECT profile_id, dimension, significance, place FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY significance DESC, dimension) AS place FROM e) WHERE place <= 2""",
        "programs", *FIT,
    ),
)
add(
    "wn17_discriminating_dimensions", lambda s, d: recommend.discriminating_dimensions(
        tall_top(s, d).where("place <= 2"), least=0.01
    ).select("profile_id", "dimension", "delta", "n"),
    sql(
        f"""WITH {_TOP}, c AS (SELECT profile_id FROM top GROUP BY 1 HAVING max(CASE WHEN place = 1 THEN content_fit END) - max(CASE WHEN place = 2 THEN content_fit END) <= 5),
  d AS (SELECT profile_id, area AS dimension, round(coalesce(max(CASE WHEN place = 1 THEN share END), 0) - coalesce(max(CASE WHEN place = 2 THEN share END), 0), 6) AS delta
    FROM top JOIN c USING (profile_id) JOIN area_share USING (program_id) WHERE place <= 2 GROUP BY 1, 2)
  SELECT profile_id, dimension, delta, n FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY abs(delta) DESC, dimension) AS n FROM d WHERE abs(delta) >= 0.01) WHERE n <= 4""",
        "programs", *FIT,
    ),
)


def build_all(s, d):
    p = projections.build_projections(P.items(s, d), P.area_weights(s, d), features(s, d))
    return p.select(
        "program_id", "total_hours", F.size("area_share").alias("areas"), F.size("activity_share").alias("activities"),
        F.coalesce(F.col("semantic")["math"], F.lit(0.0)).alias("math")
    )


add(
    "rc1_build_projections", build_all,
    sql(
        """SELECT program_id, total_hours, CAST(a.n AS INT) AS areas, CAST(c.n AS INT) AS activities, coalesce(s.value, 0) AS math FROM totals
  JOIN (SELECT program_id, count(*) AS n FROM area_share GROUP BY 1) a USING (program_id) JOIN (SELECT program_id, count(*) AS n FROM activity_share GROUP BY 1) c USING (program_id)
  LEFT JOIN (SELECT * FROM semantic WHERE feature = 'math') s USING (program_id)""",
        *SHARE, "area_share", "matrix", "activity_load", "activity_share", *FEAT, "semantic",
    ),
)
add(
    "tx2_classify_features", lambda s, d: projections.unknown_features(
        P.disciplines(s, d), features(s, d), ["math", "mechanics", "software"]
    ).select("discipline_id", "feature", "value", "confidence", "rule", "status"),
    sql(
        """SELECT d.discipline_id, f.feature, x.value, x.confidence, x.rule, CASE WHEN x.value IS NULL THEN 'unknown' ELSE 'available' END AS status
  FROM disciplines d CROSS JOIN (VALUES ('math'), ('mechanics'), ('software')) f(feature) LEFT JOIN features x ON x.discipline_id = d.discipline_id AND x.feature = f.feature""",
        *FEAT,
    ),
)
add(
    "ag2_rollup", lambda s, d: metrics.rollup_query(math_rows(s, d)),
    sql(
        "SELECT university_id, direction_id, round(avg(value), 6) AS value, count(value) AS included FROM math GROUP BY ROLLUP (university_id, direction_id)",
        *MATH
    ),
)
add(
    "jn8_metric_evidence", lambda s, d: metrics.metric_evidence(
        semantic(s, d),
        P.programs(s, d).where("university_id = 2").select("program_id"), ["math", "software"]
    ),
    sql(
        "SELECT * FROM semantic WHERE feature IN ('math', 'software') AND program_id IN (SELECT program_id FROM programs WHERE university_id = 2)",
        "programs", *SEM
    ),
)
