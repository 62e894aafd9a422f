"""Queries over cleansing, quality, sources, sinks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import cleansing, quality
from ..sources import readers, sinks
from . import analytics as A
from . import proxy as P
from .proxy import sql

Q: dict = {}
S: dict = {}
NOW = "2001-06-01 00:00:00"


def add(name, func, oracle=None):
    Q[name] = func
    if oracle:
        S[name] = oracle


def source_order():
    return F.struct("source_row", "position", "hours", "captured_at", "assessment")


_O = "(source_row, position, hours, captured_at, assessment)"
add(
    "cln1_dedupe_first",
    lambda s, d: cleansing.dedupe_first(
        P.items(s, d), ["source_row", "position"], ["captured_at", "program_id", "discipline_id", "hours"]
    ).select("source_row", "position", "program_id", "discipline_id"),
    sql(
        """SELECT source_row, position, program_id, discipline_id FROM (SELECT *, row_number() OVER (PARTITION BY source_row, position
  ORDER BY captured_at, program_id, discipline_id, hours) AS n FROM items) WHERE n = 1""", "items"),
)
add(
    "cln2_collapse_rows", lambda s, d: cleansing.collapse_rows(P.items(s, d), source_order()).drop("assessments"),
    sql(
        f"""SELECT program_id, discipline_id, semester, max(hours) AS hours, arg_min(credits, {_O}) FILTER (credits IS NOT NULL) AS credits,
  min(position) AS position, count(*) AS merged FROM items GROUP BY 1, 2, 3""", "items"),
)
add(
    "cln3_merge_offerings",
    lambda s, d: cleansing.merge_offerings(
        P.offerings(s, d),
        ["program_id", "admission_year", "study_form", "funding_type"], ["cutoff", "tuition"], F.col("offering_id")
    ),
    sql(
        """SELECT program_id, admission_year, study_form, funding_type, arg_min(cutoff, offering_id) FILTER (cutoff IS NOT NULL) AS cutoff,
  arg_min(tuition, offering_id) AS tuition, count(*) AS merged FROM offerings GROUP BY 1, 2, 3, 4""", "offerings"),
)


def order_scores(s, d):
    k = F.col("offering_id")
    return P.offerings(s, d).select(
        "program_id", "admission_year", (k % 4 == 0).alias("is_order"), F.col("cutoff").alias("score"),
        F.sha2(k.cast("string"), 256).alias("content_hash"), k.alias("locator")
    )


add(
    "cln4_merge_passing_scores", lambda s, d: cleansing.merge_passing_scores(
        order_scores(s, d), ["program_id", "admission_year"]
    ).select(
        "program_id", "admission_year", "is_order", "score", "locator"
    ),
    sql(
        """SELECT program_id, admission_year, is_order, score, locator FROM (SELECT program_id, admission_year, offering_id % 4 = 0 AS is_order, cutoff AS score, offering_id AS locator,
  row_number() OVER (PARTITION BY program_id, admission_year ORDER BY (offering_id % 4 = 0) DESC, cutoff NULLS LAST, sha256(CAST(offering_id AS VARCHAR)), offering_id) AS n FROM offerings) WHERE n = 1""", "offerings"),
)
add(
    "cln5_derive_cutoffs",
    lambda s, d: cleansing.derive_cutoffs(
        P.offerings(s, d).select(
            (F.col("program_id") % 25).alias("direction_id"), "funding_type",
            F.col("study_form").alias("competition_type"), (F.col("offering_id") / 2).cast("bigint").alias("row_key"),
            F.col("cutoff").alias("score")
        )
    ),
    sql(
        """SELECT direction_id, funding_type, competition_type, min(score) AS cutoff, count(score) AS admitted_by_score, count(*) - count(score) AS admitted_without_exams, CAST(sum(disputed) AS BIGINT) AS disputed FROM (
  SELECT program_id % 25 AS direction_id, funding_type, study_form AS competition_type, offering_id // 2 AS row_key, min(cutoff) AS score, (count(DISTINCT cutoff) > 1)::INT AS disputed FROM offerings GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", "offerings"),
)


def raw_records(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(
        k.alias("record_id"), F.when(k % 2 == 0, "program").otherwise("direction").alias("scope"),
        F.when(
            k % 2 == 0,
            F.concat(
                F.lit(" supplier#"),
                F.lpad(((k / 2).cast("bigint") % 120).cast("bigint").cast("string"), 9, "0"), F.lit(" ")
            )
        ).otherwise(((k / 10).cast("bigint") % 25).cast("string")).alias("target"),
    )


add(
    "cln6_resolve_targets", lambda s, d: cleansing.resolve_targets(
        raw_records(s, d), P.programs(s, d)
    ).select("record_id", "program_id"),
    sql(
        """SELECT o_orderkey AS record_id, program_id FROM orders JOIN programs ON CASE WHEN o_orderkey % 2 = 0 THEN lower(code) = 'supplier#' || lpad(CAST(o_orderkey // 2 % 120 AS VARCHAR), 9, '0')
  ELSE direction_id = (o_orderkey // 10) % 25 END""", "programs"),
)
add(
    "cln7_conflicts", lambda s, d: cleansing.conflicts(P.items(s, d), ["source_row", "position"], "hours"),
    sql(
        """SELECT source_row, position, count(DISTINCT hours) AS n_values, count(*) AS n_records, min(hours) AS low, max(hours) AS high FROM items GROUP BY 1, 2 HAVING count(DISTINCT hours) >= 2""",
        "items"
    ),
)


def documents_at(s, d, later):
    k = F.col("o_custkey")
    t = P.table(s, d, "orders").groupBy(k.alias("source_id")).agg(
        F.max("o_orderkey").alias("last"), F.min("o_orderkey").alias("first")
    )
    keep = F.col("source_id") % 7 != (1 if later else 2)
    value = F.when((F.col("source_id") % 5 == 0) & F.lit(later), F.col("first")).otherwise(F.col("last"))
    return t.where(keep).select("source_id", F.sha2(value.cast("string"), 256).alias("content_hash"))


_DOCS = """docs0 AS (SELECT o_custkey AS source_id, max(o_orderkey) AS last, min(o_orderkey) AS first FROM orders GROUP BY 1),
  prev AS (SELECT source_id, sha256(CAST(last AS VARCHAR)) AS content_hash FROM docs0 WHERE source_id % 7 <> 2),
  cur AS (SELECT source_id, sha256(CAST(CASE WHEN source_id % 5 = 0 THEN first ELSE last END AS VARCHAR)) AS content_hash FROM docs0 WHERE source_id % 7 <> 1),
  changes AS (SELECT source_id, prev.content_hash AS before, cur.content_hash AS after, CASE WHEN prev.content_hash IS NULL THEN 'added' WHEN cur.content_hash IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM prev FULL JOIN cur USING (source_id) WHERE prev.content_hash IS DISTINCT FROM cur.content_hash)"""


def changes(s, d):
    return cleansing.diff_sources(documents_at(s, d, False), documents_at(s, d, True))


def rules_of(s, d, later):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").where(k % 11 != (3 if later else 4)).select(
        k.alias("rule_id"), F.col("o_custkey").alias("source_id")
    )


add("cln8_diff_sources", changes, f"WITH {_DOCS} SELECT * FROM changes")
add(
    "cln8_stale_rules", lambda s, d: cleansing.stale_rules(rules_of(s, d, False), rules_of(s, d, True), changes(s, d)),
    f"""WITH {_DOCS} SELECT o_orderkey AS rule_id, 'removed' AS state FROM orders WHERE o_orderkey % 11 = 3 UNION ALL SELECT o_orderkey, 'added' FROM orders WHERE o_orderkey % 11 = 4
  UNION ALL SELECT o_orderkey, 'stale' FROM orders WHERE o_orderkey % 11 NOT IN (3, 4) AND o_custkey IN (SELECT source_id FROM changes WHERE change <> 'added')""",
)
add(
    "cln9_coverage_status",
    lambda s, d: P.items(s, d).groupBy("program_id").agg(
        F.count(F.lit(1)).alias("e"), F.count("credits").alias("f"), F.count_if(F.col("hours") > 49).alias("r")
    ).select(
        "program_id", cleansing.coverage_status(F.col("e") * 0.86, F.col("f"), F.col("r")).alias("status")
    ),
    sql(
        "SELECT program_id, CASE WHEN count(credits) >= count(*) * 0.86 AND count(*) FILTER (hours > 49) = 0 THEN 'complete' WHEN count(credits) >= count(*) * 0.86 THEN 'review_required' ELSE 'partial' END AS status FROM items GROUP BY 1",
        "items"
    ),
)


def curricula(s, d):
    return P.items(s, d).groupBy(
        "program_id", F.year("captured_at").alias("education_year")
    ).agg(F.min("source_row").alias("x")).select(
        "program_id", "education_year", (F.col("program_id") * 10000 + F.col("education_year")).alias("curriculum_id")
    )


add(
    "src2_latest_curriculum",
    lambda s, d: cleansing.latest_curriculum(
        P.items(s, d).withColumn("curriculum_id", F.col("program_id") * 10000 + F.year("captured_at")), curricula(s, d)
    ).select("curriculum_id", "place", "discipline_id", "semester", "position"),
    sql("""WITH l AS (SELECT program_id, max(year(captured_at)) AS y FROM items GROUP BY 1)
  SELECT i.program_id * 10000 + y AS curriculum_id, row_number() OVER (PARTITION BY i.program_id ORDER BY semester NULLS LAST, position NULLS LAST, discipline_id, source_row) AS place, discipline_id, semester, position
  FROM items i JOIN l ON l.program_id = i.program_id AND year(captured_at) = y""", "items"),
)
add(
    "src1_catalog", lambda s, d: cleansing.catalog(P.programs(s, d), 2, 15),
    sql("SELECT * FROM programs WHERE university_id = 2 ORDER BY code, program_id LIMIT 15", "programs")
)
add(
    "st4_added_removed", lambda s, d: cleansing.added_removed(
        documents_at(s, d, False), documents_at(s, d, True), "source_id"
    ),
    f"WITH {_DOCS} (SELECT source_id, 'added' AS change FROM cur WHERE source_id NOT IN (SELECT source_id FROM prev)) UNION ALL (SELECT source_id, 'removed' FROM prev WHERE source_id NOT IN (SELECT source_id FROM cur))",
)
add(
    "st6_union_runs", lambda s, d: cleansing.union_runs(
        P.programs(s, d).where("university_id = 1"), P.programs(s, d).where("university_id = 4")
    ).select("program_id", "university_id"),
    sql("SELECT program_id, university_id FROM programs WHERE university_id IN (1, 4)", "programs"),
)
add(
    "st2_identity_continuity", lambda s, d: quality.identity_continuity(
        documents_at(s, d, True), documents_at(s, d, False), "source_id"
    ),
    f"WITH {_DOCS} SELECT round(count(c.source_id)::DOUBLE / count(*), 6) AS continuity, count(*) AS previous FROM prev LEFT JOIN cur c USING (source_id)",
)
add(
    "st5_bounded_union",
    lambda s, d: P.items(s, d).groupBy("program_id").agg(
        F.array_sort(F.collect_set("semester")).alias("a"), F.array_sort(F.collect_set("position")).alias("b")
    ).select("program_id", F.array_join(fn.bounded_union(9, F.col("a"), F.col("b")), ",").alias("joined")),
    sql(
        """WITH g AS (SELECT program_id, list(DISTINCT semester ORDER BY semester) FILTER (semester IS NOT NULL) AS a, list(DISTINCT position ORDER BY position) AS b FROM items GROUP BY 1)
  SELECT program_id, array_to_string(list_concat(coalesce(a, []), list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x)))[1:9], ',') AS joined FROM g""", "items"),
)

# --- quality --------------------------------------------------------------
add(
    "v1_validate",
    lambda s, d: quality.validate(
        P.programs(s, d).unionByName(P.programs(s, d).where("program_id % 10 = 0")),
        P.area_weights(s, d).withColumn(
            "weight",
            F.when(F.col("discipline_id") % 100 == 0, 0.6).otherwise(F.col("weight"))
        ),
        P.offerings(s, d).select(
            F.col("offering_id").alias("score_id"),
            F.when(F.col("offering_id") % 17 == 0, "bvi").otherwise("numeric").alias("status"),
            F.col("cutoff").alias("score")
        ),
    ),
    sql(
        """SELECT 'repeated_program' AS check_name, CAST(program_id AS VARCHAR) AS key FROM programs WHERE program_id % 10 = 0
  UNION ALL SELECT 'weights_not_one', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 100 = 0
  UNION ALL SELECT 'score_status', CAST(offering_id AS VARCHAR) FROM offerings WHERE (offering_id % 17 <> 0) <> (cutoff IS NOT NULL)""", "programs", "offerings"),
)


def measures(s, d):
    return quality.snapshot_measures(
        P.programs(s, d), P.items(s, d).where("program_id % 9 <> 0"), P.offerings(s, d), A.features(s, d),
        "university_id"
    )


P.CTES["measures"] = """SELECT university_id, count(*) AS programs, round(count(c.program_id)::DOUBLE / count(*), 6) AS curriculum_coverage,
  round(count(o.program_id)::DOUBLE / count(*), 6) AS admission_coverage, round(CASE WHEN coalesce(sum(n), 0) = 0 THEN 1.0 ELSE coalesce(sum(k), 0)::DOUBLE / sum(n) END, 6) AS taxonomy_coverage FROM programs p
  LEFT JOIN (SELECT program_id, count(DISTINCT discipline_id) AS n, count(DISTINCT CASE WHEN discipline_id IN (SELECT discipline_id FROM features) THEN discipline_id END) AS k FROM items WHERE program_id % 9 <> 0 GROUP BY 1) c USING (program_id)
  LEFT JOIN (SELECT DISTINCT program_id FROM offerings) o USING (program_id) GROUP BY 1"""
MEAS = ("programs", "items", "offerings", *A.FEAT, "measures")
add("v2_snapshot_measures", measures, sql("SELECT * FROM measures", *MEAS))
add(
    "v2_quality_gate", lambda s, d: quality.quality_gate(
        measures(s, d), {"curriculum_coverage": 0.8}, {"admission_coverage": 0.5, "taxonomy_coverage": 0.9}
    ).select("university_id", "blocking", "degrading", "decision"),
    sql(
        """WITH x AS (SELECT *, CASE WHEN curriculum_coverage < 0.8 THEN 'curriculum_coverage' ELSE '' END AS blocking, concat_ws(',', CASE WHEN admission_coverage < 0.5 THEN 'admission_coverage' END,
  CASE WHEN taxonomy_coverage < 0.9 THEN 'taxonomy_coverage' END) AS degrading FROM measures)
  SELECT university_id, blocking, degrading, CASE WHEN blocking <> '' THEN 'rejected' WHEN degrading <> '' THEN 'degraded' ELSE 'passed' END AS decision FROM x""", *MEAS),
)


def outcomes(s, d):
    f = A.features(s, d).groupBy("discipline_id").agg(F.max_by("feature", F.struct("value", "feature")).alias("area"))
    j = P.disciplines(s, d).select("discipline_id", "name").join(f, "discipline_id", "left")
    return j.withColumn(
        "method",
        F.when(F.col("area").isNull(), "unresolved").otherwise("keyword")
    ).withColumn("area", F.coalesce("area", F.lit("other")))


P.CTES["tax"] = """SELECT d.discipline_id, d.name, coalesce(f.area, 'other') AS area, CASE WHEN f.area IS NULL THEN 'unresolved' ELSE 'keyword' END AS method
  FROM disciplines d LEFT JOIN (SELECT discipline_id, arg_max(feature, (value, feature)) AS area FROM features GROUP BY 1) f USING (discipline_id)"""
TAX = (*A.FEAT, "tax")
add(
    "v3_taxonomy_metrics", lambda s, d: quality.taxonomy_metrics(outcomes(s, d), P.items(s, d)),
    sql(
        """SELECT count(*) AS disciplines, count(*) FILTER (method = 'keyword') AS by_keyword, count(*) FILTER (method = 'unresolved') AS unresolved, round(avg((method <> 'unresolved')::INT), 6) AS coverage,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM tax GROUP BY name)) AS duplicate_keys, (SELECT count(*) FROM (SELECT 1 FROM tax GROUP BY name HAVING count(DISTINCT area) > 1)) AS conflicting_names,
  (SELECT count(DISTINCT program_id) FROM items WHERE discipline_id IN (SELECT discipline_id FROM tax WHERE method = 'unresolved')) AS unresolved_programs FROM tax""", "items", *TAX),
)
add(
    "v3_disciplines_per_area", lambda s, d: quality.disciplines_per_area(outcomes(s, d)),
    sql("SELECT area, count(DISTINCT discipline_id) AS disciplines FROM tax GROUP BY 1", *TAX)
)
add(
    "v7_unknown_queue", lambda s, d: quality.unknown_queue(outcomes(s, d), P.items(s, d)),
    sql(
        """SELECT name, count(*) AS occurrences, array_to_string(list(DISTINCT program_id ORDER BY program_id), ',') AS programs, min(captured_at) AS first_seen, max(captured_at) AS last_seen
  FROM items JOIN tax USING (discipline_id) WHERE method = 'unresolved' GROUP BY 1""", "items", *TAX),
)
add(
    "v4_provenance_report",
    lambda s, d: quality.provenance_report(
        P.items(s, d).select(
            F.col("source_row").alias("snapshot_id"),
            F.when(F.col("position") != 5, F.col("program_id")).alias("run_id"),
            F.when(F.col("hours") > 3, "row").otherwise(" ").alias("locator")
        ),
        P.table(s, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("snapshot_id")), "items"
    ),
    sql(
        """SELECT 'items' AS table_name, count(*) AS n_rows, count(*) FILTER (source_row NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)) AS missing_snapshot,
  count(*) FILTER (position = 5) AS missing_run, count(*) FILTER (hours <= 3) AS missing_locator FROM items""", "items"),
)


def reviewed(s, d):
    from ..operators import projections

    f = projections.unknown_features(P.disciplines(s, d), A.features(s, d), ["math", "mechanics", "software"])
    return f.withColumn("review", F.when(F.col("discipline_id") % 13 == 0, "rejected"))


add(
    "v5_semantic_quality", lambda s, d: quality.semantic_quality(reviewed(s, d)),
    sql(
        """WITH v AS (SELECT d.discipline_id, x.value, x.confidence, d.discipline_id % 13 = 0 AS rejected FROM disciplines d CROSS JOIN (VALUES ('math'), ('mechanics'), ('software')) f(feature)
  LEFT JOIN features x ON x.discipline_id = d.discipline_id AND x.feature = f.feature)
  SELECT count(*) AS n_values, count(*) FILTER (value IS NOT NULL AND NOT rejected) AS available, count(*) FILTER (value IS NULL) AS unresolved, count(*) FILTER (confidence < 0.8) AS low_confidence,
  count(*) FILTER (rejected) AS rejected, round(count(*) FILTER (value IS NOT NULL AND NOT rejected)::DOUBLE / count(*), 6) AS available_rate FROM v""", *A.FEAT),
)


def aliases(s, d):
    k = F.col("c_custkey")
    return P.table(s, d, "customer").select(
        k.alias("alias"),
        F.when(k % 9 == 0, k + 4).when(k % 9 == 4, k - 4).otherwise(k + 1).alias("target")
    ).where(k % 9 != 8)


add(
    "v8_resolve_aliases", lambda s, d: quality.resolve_aliases(aliases(s, d)).select(
        "alias", "target", "steps", "cyclic"
    ),
    sql(
        """SELECT c_custkey AS alias, CASE WHEN c_custkey % 9 IN (5, 6, 7) THEN least(c_custkey - c_custkey % 9 + 8, (SELECT max(c_custkey) + 1 FROM customer)) END AS target, CASE WHEN c_custkey % 9 IN (5, 6, 7) THEN CAST(least(8 - c_custkey % 9, (SELECT max(c_custkey) + 1 FROM customer) - c_custkey) AS INT) END AS steps,
  c_custkey % 9 < 5 AS cyclic FROM customer WHERE c_custkey % 9 <> 8"""),
)
add(
    "v9_release_report",
    lambda s, d: quality.release_report(
        P.table(s, d, "part").select(
            F.when(F.col("p_partkey") % 4 == 0, "bvi").otherwise("points").alias("route"),
            F.when(F.col("p_partkey") % 3 == 0, "hundred_points").otherwise("other").alias("benefit_type"),
            F.when(
                F.col("p_partkey") % 5 == 0, "review"
            ).when(F.col("p_partkey") % 7 == 0, "stale").otherwise("active").alias("status"),
            F.when(F.col("p_partkey") % 6 != 0, 1).alias("target_subject"),
            F.when(F.col("p_partkey") % 8 != 0, 1).alias("confirmation")
        )
    ),
    """WITH r AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'bvi' ELSE 'points' END || ':' || CASE WHEN p_partkey % 3 = 0 THEN 'hundred_points' ELSE 'other' END AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN 'review' WHEN p_partkey % 7 = 0 THEN 'stale' ELSE 'active' END AS status, p_partkey AS k FROM part)
  SELECT kind, count(*) AS rules, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'stale') AS stale,
  count(*) FILTER (k % 6 = 0 AND k % 3 = 0) AS missing_subject, count(*) FILTER (k % 8 = 0) AS missing_confirmation FROM r GROUP BY 1""",
)

# --- sources and sinks ----------------------------------------------------
add(
    "src6_snapshot_outcome",
    lambda s, d: readers.snapshot_outcome(
        P.table(s, d, "pages").where("page_id % 3 <> 0").select(
            F.col("page_id").alias("source_id"),
            F.sha2(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.col("html")), 256).alias("content_hash")
        ),
        P.table(s, d, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("body"))
    ),
    "SELECT page_id AS source_id, sha256(html) AS content_hash, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM pages",
)


def attempts(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(
        (F.col("o_custkey") % 200).alias("source_id"), k.alias("sequence"), F.when(
            F.col("o_orderstatus") == "F", "failed"
        ).otherwise("ok").alias("outcome"),
        F.sha2((k % 3).cast("string"), 256).alias("content_hash"), F.lit(600).alias("interval_seconds"), (k % 2).alias("revision"),
        F.col("o_orderdate").cast("timestamp").alias("completed_at"), F.when(
            F.col("o_orderstatus") == "F",
            F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 3 DAYS")
        ).alias("next_retry_at"),
    )


_ATT = """att AS (SELECT o_custkey % 200 AS source_id, o_orderkey AS sequence, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS outcome, sha256(CAST(o_orderkey % 3 AS VARCHAR)) AS content_hash, o_orderdate AS completed_at FROM orders)"""
add(
    "src8_poll_backoff", lambda s, d: readers.poll_backoff(attempts(s, d)).select(
        "sequence", "retry_count", "delay_seconds", "last_good_hash"
    ),
    f"""WITH {_ATT}, a AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY source_id ORDER BY sequence) AS st FROM att),
  b AS (SELECT *, CAST(least(10, sum((outcome <> 'ok')::INT) OVER (PARTITION BY source_id, st ORDER BY sequence)) AS INT) AS retry_count FROM a)
  SELECT sequence, retry_count, CAST(CASE WHEN outcome = 'ok' THEN 600 ELSE least(600 * pow(2, least(retry_count - 1, 10)), 86400) END AS BIGINT) AS delay_seconds,
  last_value(CASE WHEN outcome = 'ok' THEN content_hash END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS last_good_hash FROM b""",
)
add(
    "src7_due_sources",
    lambda s, d: readers.due_sources(
        P.table(s, d, "customer").select(
            F.col("c_custkey").alias("source_id"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c_custkey") % 2)).alias("revision"),
            (F.col("c_custkey") % 6 != 0).alias("enabled"), F.lit(86400).alias("interval_seconds")
        ),
        attempts(s, d).groupBy("source_id", "completed_at").agg(
            F.max("revision").alias("revision"), F.min("next_retry_at").alias("next_retry_at")
        ), F.lit("2001-11-01").cast("timestamp"), 40,
    ).select("source_id", "revision", "due_at"),
    f"""WITH {_ATT}, last AS (SELECT source_id, arg_max(r, completed_at) AS rev, max(completed_at) AS done, arg_max(retry, completed_at) AS retry FROM (SELECT source_id, completed_at, max(sequence % 2) AS r,
    min(CASE WHEN outcome = 'failed' THEN completed_at + INTERVAL 3 DAY END) AS retry FROM att GROUP BY 1, 2) GROUP BY 1),
  reg AS (SELECT c_custkey AS source_id, c_custkey % 2 AS revision FROM customer WHERE c_custkey % 6 <> 0),
  j AS (SELECT reg.source_id, reg.revision, last.rev, done, CASE WHEN (SELECT max(CASE WHEN a.outcome = 'failed' THEN 1 ELSE 0 END) FROM att a WHERE a.source_id = last.source_id AND a.completed_at = last.done) = 1
    THEN done + INTERVAL 3 DAY ELSE done + INTERVAL 1 DAY END AS due_at FROM reg LEFT JOIN last USING (source_id))
  SELECT source_id, revision, CASE WHEN done IS NULL THEN NULL ELSE due_at END AS due_at FROM j WHERE done IS NULL OR rev <> revision OR due_at <= TIMESTAMP '2001-11-01' ORDER BY CASE WHEN done IS NULL THEN NULL ELSE due_at END NULLS FIRST, source_id LIMIT 40""",
)
add(
    "src9_observation_key", lambda s, d: readers.observation_key(
        P.programs(s, d).select(F.col("code").alias("a_code"), F.col("program_id").alias("b_id")), ["b_id", "a_code"]
    ).select("b_id", "observation_key"),
    sql(
        """SELECT program_id AS b_id, 'observation:' || sha256('{"a_code":"' || code || '","b_id":' || program_id || '}') AS observation_key FROM programs""",
        "programs"
    ),
)
add(
    "src5_extract_text", lambda s, d: readers.extract_text(P.table(s, d, "pages")).select(
        "page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
        F.col("text").contains("<").alias("markup")
    ),
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style|nav|footer|noscript|svg)\b.*?</(script|style|nav|footer|noscript|svg)>', '<x>', 'g') AS h FROM pages),
  b AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(h, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM a)
  SELECT page_id, CAST(length(array_to_string(t, chr(10))) AS INT) AS n_chars, sha256(array_to_string(t, chr(10))) AS text_sha256, contains(array_to_string(t, chr(10)), '<') AS markup FROM b""",
)


def incoming(s, d):
    return P.programs(s, d).where("program_id % 6 <> 1").withColumn(
        "code",
        F.when(F.col("program_id") % 4 == 0, F.concat("code", F.lit("*"))).otherwise(F.col("code"))
    ).withColumn(
        "university_id", F.when(F.col("program_id") % 8 == 0, -1).otherwise(F.col("university_id")))


def existing(s, d):
    return P.programs(s, d).where("program_id % 5 <> 2")


_UP = """up AS (SELECT program_id, p5 AS was, p6 AS now_, program_id % 4 = 0 AS recoded, program_id % 8 = 0 AS moved FROM (SELECT *, program_id % 5 <> 2 AS p5, program_id % 6 <> 1 AS p6 FROM programs) WHERE p5 OR p6),
  ch AS (SELECT *, CASE WHEN NOT was THEN 'inserted' WHEN NOT now_ THEN 'kept' WHEN NOT recoded THEN 'unchanged' WHEN moved THEN 'conflict' ELSE 'updated' END AS change FROM up)"""


def upserted(s, d):
    return sinks.upsert(existing(s, d), incoming(s, d), ["program_id"], ["university_id"])


add(
    "snk1_upsert", lambda s, d: upserted(s, d).select("program_id", "code", "university_id", "change"),
    sql(
        f"""WITH {_UP} SELECT program_id, CASE WHEN change IN ('inserted', 'updated') AND recoded THEN code || '*' ELSE code END AS code,
  CASE WHEN change IN ('inserted', 'updated') AND moved THEN -1 ELSE university_id END AS university_id, change FROM ch JOIN programs USING (program_id)""", "programs"),
)
add(
    "snk1_upsert_stats", lambda s, d: sinks.upsert_stats(upserted(s, d)),
    sql(f"WITH {_UP} SELECT change, count(*) AS n FROM ch GROUP BY 1", "programs")
)
add(
    "snk2_remove_stale", lambda s, d: sinks.remove_stale(
        existing(s, d), incoming(s, d).where("direction_id < 10"), ["program_id"], ["direction_id"]
    ).select("program_id"),
    sql(
        """WITH i AS (SELECT * FROM programs WHERE program_id % 6 <> 1 AND direction_id < 10) SELECT program_id FROM programs WHERE program_id % 5 <> 2 AND (direction_id NOT IN (SELECT direction_id FROM i) OR program_id IN (SELECT program_id FROM i))""",
        "programs"
    ),
)


def child_sync(s, d):
    old = P.area_weights(s, d).where("discipline_id % 5 <> 0").select("discipline_id", "area")
    new = P.area_weights(s, d).where("discipline_id % 7 <> 0").select("discipline_id", "area")
    gone, more = sinks.sync_children(old, new, ["discipline_id", "area"])
    return gone.withColumn("op", F.lit("delete")).unionByName(more.withColumn("op", F.lit("add")))


add(
    "snk3_sync_children", child_sync,
    sql(
        "SELECT discipline_id, area, CASE WHEN discipline_id % 5 <> 0 THEN 'delete' ELSE 'add' END AS op FROM area_weights WHERE (discipline_id % 5 <> 0) <> (discipline_id % 7 <> 0)",
        "area_weights"
    )
)


def kinds(s, d, later):
    e = P.table(s, d, "events").select("event_id", F.col("event_type").alias("source_kind"), F.col("value"))
    return e.where("event_id % 3 <> 0").withColumn("value", F.col("value") + 1) if later else e.where("event_id % 4 <> 0")


add(
    "snk4_scoped_sync", lambda s, d: sinks.scoped_sync(kinds(s, d, False), kinds(s, d, True), ["event_id"], "click"),
    "SELECT event_id, event_type AS source_kind, value FROM events WHERE event_id % 4 <> 0 AND event_type <> 'click' UNION ALL SELECT event_id, event_type, value + 1 FROM events WHERE event_id % 3 <> 0 AND event_type = 'click'",
)


def history(s, d):
    k = F.col("p_partkey")
    return P.table(s, d, "part").select(
        k.alias("rule_id"),
        F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("revision")
    ).withColumn("content_hash", F.sha2(F.concat_ws(":", "rule_id", "revision"), 256))


def current(s, d):
    k = F.col("p_partkey")
    return P.table(s, d, "part").select(
        k.alias("rule_id"),
        F.sha2(
            F.concat_ws(":", k, F.when(k % 4 == 0, F.lit(9)).otherwise((k % 3 + 1).cast("int"))), 256
        ).alias("content_hash")
    )


add(
    "snk5_append_revision", lambda s, d: sinks.append_revision(history(s, d), current(s, d), "rule_id"),
    """SELECT p_partkey AS rule_id, CAST(r AS INT) AS revision, sha256(p_partkey || ':' || r) AS content_hash FROM part, range(1, 4) t(r) WHERE r <= p_partkey % 3 + 1
  UNION ALL SELECT p_partkey, CAST(p_partkey % 3 + 2 AS INT), sha256(p_partkey || ':9') FROM part WHERE p_partkey % 4 = 0""",
)
add(
    "snk6_replace_for", lambda s, d: sinks.replace_for(
        A.shares(s, d),
        A.shares(s, d).where("program_id % 10 = 3 and share > 0.1"), "program_id"
    ),
    sql(
        "SELECT program_id, area, share FROM area_share WHERE program_id % 10 <> 3 OR share > 0.1 OR program_id NOT IN (SELECT program_id FROM area_share WHERE program_id % 10 = 3 AND share > 0.1)",
        *A.SHARE, "area_share"
    ),
)
add(
    "snk7_mark_stale", lambda s, d: sinks.active_only(
        sinks.mark_stale(
            P.programs(s, d).withColumn("status", F.lit("active")), P.items(s, d).where("hours = 50 and position = 1")
        )
    ).select("program_id"),
    sql(
        "SELECT program_id FROM programs WHERE program_id NOT IN (SELECT program_id FROM items WHERE hours = 50 AND position = 1)",
        "programs", "items"
    ),
)


def hashed_items(s, d):
    return P.items(s, d).groupBy(
        (F.col("source_row") * 10 + F.col("position")).alias("item_id"), "program_id"
    ).agg(F.sha2(F.max("hours").cast("string"), 256).alias("source_hash"))


add(
    "snk8_changed_items",
    lambda s, d: sinks.changed_items(
        P.items(s, d).groupBy("program_id").agg(
            F.sha2((F.max("hours") - F.col("program_id") % 2).cast("string"), 256).alias("source_hash")
        ),
        P.items(s, d).where("program_id % 3 <> 0").groupBy("program_id").agg(
            F.sha2(F.max("hours").cast("string"), 256).alias("source_hash")
        ),
        "program_id"
    ).select("program_id"),
    sql("SELECT DISTINCT program_id FROM items WHERE program_id % 2 = 1 OR program_id % 3 = 0", "items"),
)
add(
    "snk9_input_hash", lambda s, d: sinks.input_hash(P.items(s, d), "program_id", ["source_row", "hours"]),
    sql(
        "SELECT program_id, sha256(string_agg(x, chr(10) ORDER BY x)) AS input_sha256 FROM (SELECT DISTINCT program_id, source_row || '|' || hours AS x FROM items) GROUP BY 1",
        "items"
    ),
)


def run_table(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(
        k.alias("run_id"), (F.col("o_custkey") % 5).alias("university_id"), F.when(
            F.col("o_orderstatus") == "F", "completed"
        ).when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(
            k % 2 == 0,
            F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")
        ).alias("heartbeat_at"), F.when(k % 3 == 0, "running").otherwise("done").alias("projection_status"),
    )


_RUN = """r AS (SELECT o_orderkey AS run_id, o_custkey % 5 AS university_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS heartbeat_at, CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'done' END AS projection_status FROM orders)"""
add(
    "snk10_runs", lambda s, d: sinks.runs(run_table(s, d), "failed", 30).select("run_id", "started_at", "total"),
    f"WITH {_RUN} SELECT run_id, started_at, (SELECT count(*) FROM r WHERE status = 'failed') AS total FROM r WHERE status = 'failed' ORDER BY started_at DESC, run_id LIMIT 30",
)
add(
    "snk10_previous_good", lambda s, d: sinks.previous_good(run_table(s, d)),
    f"WITH {_RUN} SELECT university_id, arg_max(run_id, (started_at, run_id)) AS run_id FROM r WHERE status = 'completed' GROUP BY 1"
)
add(
    "snk11_recover_stale", lambda s, d: sinks.recover_stale(
        run_table(s, d), NOW, 86400 * 30
    ).select("run_id", "status", "reason"),
    f"""WITH {_RUN}, x AS (SELECT *, status = 'running' AND epoch(coalesce(heartbeat_at, started_at)) < epoch(TIMESTAMP '{NOW}') - 86400 * 30 AS dead FROM r)
  SELECT run_id, CASE WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead THEN CASE WHEN projection_status = 'running' THEN 'abandoned_in_projection' ELSE 'abandoned' END END AS reason FROM x""",
)
add(
    "snk13_mark_document_stale",
    lambda s, d: sinks.mark_document_stale(
        P.offerings(s, d).select(
            "offering_id", "admission_year", F.col("study_form").alias("kind"),
            F.col("funding_type").alias("source_url"),
            (F.col("offering_id") % 2).cast("string").alias("content_hash"), F.lit("active").alias("status")
        ),
        P.offerings(s, d).select(
            "admission_year", F.col("study_form").alias("kind"), F.lit("F").alias("source_url"),
            F.lit("1").alias("content_hash")
        ).distinct(),
    ).groupBy("admission_year", "status").agg(F.count(F.lit(1)).alias("n")),
    sql(
        "SELECT admission_year, CASE WHEN funding_type = 'F' AND offering_id % 2 = 0 THEN 'stale' ELSE 'active' END AS status, count(*) AS n FROM offerings GROUP BY 1, 2",
        "offerings"
    ),
)


def captured(s, d, records, field):
    """JSON documents of five events each; some are cut off, some hold another list."""
    doc = F.floor(F.col("event_id") / 5)
    rows = P.table(s, d, "events").select(doc.alias("doc"), "event_id", records.alias("r"))
    lists = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]).alias(field))
    body = F.to_json(F.struct(field))
    body = F.when(F.col("doc") % 17 == 0, F.expr(f"left(to_json(struct({field})), length(to_json(struct({field}))) - 1)")).when(
        F.col("doc") % 19 == 0, "{}"
    ).otherwise(body)
    return lists.select(F.col("doc").cast("string").alias("document"), body.alias("body"))


def told(good, refused, *extra):
    columns = ["document", "external_key", *extra]
    nothing = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in extra]
    return good.select(*columns, F.lit("accepted").alias("outcome")).unionByName(
        refused.select("document", "external_key", *nothing, F.col("reason").alias("outcome"))
    )


def event_records():
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(k % 13 == 0, "").otherwise("Z")
    kind = F.element_at(F.array(*map(F.lit, [*readers.EVENT_KINDS, "party"])), (k % 7 + 1).cast("int"))
    ends = F.when(k % 5 < 4, F.concat(text(at + F.make_interval(hours=(k % 5 - 1).cast("int"))), F.lit("Z")))
    return F.struct(
        F.when(k % 11 > 0, k.cast("string")).alias("external_key"), F.lit("T").alias("title"), kind.alias("kind"),
        F.concat(text(at), zone).alias("starts_at"), ends.alias("ends_at"),
    )


def src3(s, d):
    good, refused = readers.parse_events(captured(s, d, event_records(), "events"))
    return told(good.withColumn("starts", F.unix_seconds("starts")), refused, "starts")


_DOCS = """rec AS (SELECT event_id AS k, event_id // 5 AS doc, ts FROM events),
  broken AS (SELECT DISTINCT CAST(doc AS VARCHAR) AS document, CASE WHEN doc % 17 = 0 THEN 'malformed_document' ELSE 'no_records' END AS outcome FROM rec WHERE doc % 17 = 0 OR doc % 19 = 0),
  fine AS (SELECT *, CAST(doc AS VARCHAR) AS document, CASE WHEN k % 11 > 0 THEN CAST(k AS VARCHAR) END AS external_key FROM rec WHERE doc % 17 > 0 AND doc % 19 > 0)"""
add(
    "src3_parse_events", src3,
    f"""WITH {_DOCS}, o AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'missing_identity' WHEN k % 7 = 6 THEN 'unknown_kind' WHEN k % 13 = 0 THEN 'bad_start'
    WHEN k % 5 < 2 THEN 'ends_before_start' ELSE 'accepted' END AS outcome FROM fine)
  SELECT document, external_key, CASE WHEN outcome = 'accepted' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS starts, outcome FROM o
  UNION ALL SELECT document, NULL, NULL, outcome FROM broken""",
)


def src4(s, d):
    k = F.col("event_id")
    point = F.struct(
        F.when(k % 11 > 0, k.cast("string")).alias("external_key"), (k % 200 - 100).cast("string").alias("latitude"),
        F.when(k % 3 > 0, (k % 180).cast("string")).alias("longitude"),
    )
    good, refused = readers.parse_points(captured(s, d, point, "points"))
    return told(good.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude")}), refused, "latitude", "longitude")


add(
    "src4_parse_points", src4,
    f"""WITH {_DOCS}, o AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'missing_identity' WHEN k % 3 = 0 THEN 'one_coordinate'
    WHEN k % 200 - 100 NOT BETWEEN -90 AND 90 THEN 'bad_coordinate' ELSE 'accepted' END AS outcome FROM fine)
  SELECT document, external_key, CASE WHEN outcome = 'accepted' THEN CAST(k % 200 - 100 AS DOUBLE) END AS latitude,
    CASE WHEN outcome = 'accepted' THEN CAST(k % 180 AS DOUBLE) END AS longitude, outcome FROM o
  UNION ALL SELECT document, NULL, NULL, NULL, outcome FROM broken""",
)
