"""Queries over admission fit, benefits, decisions, events and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import settle_table
from ..operators import admission, benefits, campus, decision, evaluate
from ..streaming import events as stream
from ..streaming import timed
from . import proxy as P
from .proxy import sql

Q: dict = {}
S: dict = {}
NOW = "2024-01-25 00:00:00"


def add(name, fn, oracle=None):
    Q[name] = fn
    if oracle:
        S[name] = oracle


def pairs(s, d):
    """Every customer with the offerings of their own orders."""
    return P.table(s, d, "orders").select(
        F.col("o_custkey").alias("applicant_id"), F.col("o_orderkey").alias("offering_id")
    )


P.CTES["ap_pairs"] = "SELECT o_custkey AS applicant_id, o_orderkey AS offering_id FROM orders"
P.CTES["matched"] = """SELECT p.applicant_id, p.offering_id, e.subject, e.minimum_score, s.score,
  CASE WHEN s.score IS NULL THEN 'missing' ELSE 'matched' END AS resolution
  FROM ap_pairs p JOIN exams e USING (offering_id) LEFT JOIN applicants s ON s.applicant_id = p.applicant_id AND s.subject = e.subject"""
P.CTES["fit"] = """WITH x AS (SELECT *, CASE WHEN score IS NOT NULL AND minimum_score IS NOT NULL THEN
    CASE WHEN minimum_score = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, score / minimum_score) END END AS ratio FROM matched),
  p AS (SELECT applicant_id, offering_id, count(*) AS n, count(score) AS nk, avg(ratio) AS ratio, sum(score) AS total,
    coalesce(bool_or(score < minimum_score), false) AS failed FROM x GROUP BY 1, 2),
  q AS (SELECT p.*, o.cutoff, round(round(ratio * 100, 8), 2) AS a,
    CASE WHEN cutoff IS NOT NULL AND nk > 0 THEN round(round(least(1.0::DOUBLE, CASE WHEN cutoff = 0 THEN 0 ELSE total / cutoff END) * 100, 8), 2) END AS b,
    round(round(nk::DOUBLE / n * 100, 8), 2) AS c FROM p JOIN offerings o USING (offering_id)),
  r AS (SELECT *, CAST(round(round((coalesce(a * 0.5, 0) + coalesce(b * 0.35, 0) + c * 0.15) /
    (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.35 END + 0.15::DOUBLE), 8)) AS INT) AS fit_score FROM q)
  SELECT applicant_id, offering_id, fit_score, CASE WHEN failed THEN 'unlikely' WHEN a IS NULL AND b IS NULL THEN 'insufficient_data'
    WHEN nk < n THEN 'insufficient_data' WHEN b < 85 THEN 'unlikely' WHEN b < 100 THEN 'borderline' WHEN fit_score >= 80 THEN 'realistic'
    WHEN fit_score >= 55 THEN 'borderline' ELSE 'unlikely' END AS status,
    CASE WHEN nk = n AND (a IS NOT NULL OR b IS NOT NULL) THEN 'complete' ELSE 'partial' END AS data_quality,
    a AS minimum_readiness, b AS passing_readiness, c AS data_completeness, total AS applicant_total FROM r"""
FIT = ("offerings", "exams", "applicants", "ap_pairs", "matched")


def matched(s, d):
    return admission.match_exam_scores(P.exams(s, d), P.applicants(s, d), pairs(s, d))


def fit(s, d):
    return admission.admission_fit(matched(s, d), P.offerings(s, d))


add("jn5_match_exam_scores", matched, sql("SELECT * FROM matched", *FIT))
add("af1_admission_fit", fit, sql("SELECT * FROM fit", *FIT, "fit"))
add(
    "af3_exam_reasons", lambda s, d: admission.exam_reasons(matched(s, d)).groupBy("offering_id", "reason").agg(F.count(F.lit(1)).alias("n")),
    sql(
        """SELECT offering_id, CASE WHEN resolution <> 'matched' THEN 'gap_' || resolution WHEN minimum_score IS NULL THEN 'no_minimum'
  WHEN score >= minimum_score THEN 'meets_minimum' ELSE 'below_minimum' END AS reason, count(*) AS n FROM matched GROUP BY 1, 2""", *FIT),
)
add(
    "ag27_fit_summary", lambda s, d: admission.fit_summary(fit(s, d), ["status"]),
    sql(
        "SELECT status, count(*) AS results, count(*) FILTER (status = 'insufficient_data') AS insufficient FROM fit GROUP BY 1",
        *FIT, "fit"
    ),
)
_PICK = dict(year=1998, form="1-URGENT", funding="F")
P.CTES["picked"] = """SELECT program_id, coalesce(n, 0) AS n_offerings, CASE WHEN n = 1 THEN only_id END AS offering_id,
  CASE WHEN n IS NULL THEN 'offering_missing' WHEN n > 1 THEN 'offering_ambiguous' END AS gap FROM programs LEFT JOIN
  (SELECT program_id, count(*) AS n, min(offering_id) AS only_id FROM offerings WHERE admission_year = 1998 AND study_form = '1-URGENT'
  AND funding_type = 'F' GROUP BY 1) USING (program_id)"""
add(
    "jn4_pick_offering",
    lambda s, d: admission.pick_offering(P.programs(s, d), P.offerings(s, d), **_PICK),
    sql("SELECT * FROM picked", "programs", "offerings", "picked")
)
add(
    "af4_admission_fit_batch", lambda s, d: admission.admission_fit_batch(
        P.applicants(s, d), P.programs(s, d), P.offerings(s, d), P.exams(s, d), **_PICK
    )[0],
    sql(
        "SELECT * FROM fit", "programs", "offerings", "exams", "applicants", "picked", "ap_pairs", "matched", "fit"
    ).replace(
        P.settle(P.CTES["ap_pairs"]), "SELECT a.applicant_id, k.offering_id FROM (SELECT DISTINCT applicant_id FROM applicants) a CROSS JOIN picked k WHERE k.offering_id IS NOT NULL"
    ),
)


def passing(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(
        k.alias("offering_id"), F.inline(F.array(*[
            F.struct(
                F.lit(t).alias("score_type"),
                F.when(k % m != 0, "numeric").otherwise("bvi").alias("status"),
                F.when(k % 9 == c, "quota").otherwise("general").alias("competition_type"),
                F.when(k % m != 0, (k * c) % 101 + 100.0).alias("score")
            )
            for t, m, c in (("F", 3, 1), ("average", 4, 2), ("P", 5, 3))
        ])),
    )


_PASS = """passing AS (SELECT o_orderkey AS offering_id, t AS score_type, CASE WHEN o_orderkey % m <> 0 THEN 'numeric' ELSE 'bvi' END AS status,
  CASE WHEN o_orderkey % 9 = c THEN 'quota' ELSE 'general' END AS competition_type, CASE WHEN o_orderkey % m <> 0 THEN (o_orderkey * c) % 101 + 100.0::DOUBLE END AS score
  FROM orders CROSS JOIN (VALUES ('F', 3, 1), ('average', 4, 2), ('P', 5, 3)) v(t, m, c))"""
add(
    "af2_select_cutoff", lambda s, d: admission.select_cutoff(passing(s, d), P.offerings(s, d)),
    sql(
        f"""WITH {_PASS} SELECT offering_id, score AS cutoff, score_type FROM (SELECT *, row_number() OVER (PARTITION BY offering_id ORDER BY
  CASE WHEN score_type = funding_type THEN 0 ELSE 1 END, score) AS n FROM passing JOIN offerings USING (offering_id) WHERE status = 'numeric'
  AND competition_type = 'general' AND (score_type = funding_type OR score_type = 'average')) WHERE n = 1""", "offerings"),
)
add(
    "ag19_latest_year", lambda s, d: admission.latest_year(P.offerings(s, d), "1-URGENT", "P"),
    sql(
        "SELECT program_id, max(admission_year) AS latest_year FROM offerings WHERE study_form = '1-URGENT' AND funding_type = 'P' GROUP BY 1",
        "offerings"
    ),
)


# --- benefits -------------------------------------------------------------
def rules(s, d):
    k = F.col("p_partkey")
    return P.table(s, d, "part").select(
        k.alias("rule_id"), F.floor(k / 8 % 5).alias("university_id"), F.element_at(
            F.array(F.lit("all"), F.lit("only"), F.lit("except")), (k % 3 + 1).cast("int")
        ).alias("mode"),
        F.floor(k / 2).alias("olympiad_id"), F.when(k % 4 == 0, "bvi").when(k % 7 == 0, "special").otherwise("hundred_points").alias("route"),
        F.when(k % 11 == 0, "review").otherwise("active").alias("status"), (k % 3 + 1).alias("max_level"), (2020 + k % 4).alias("min_year"),
    )


P.CTES["brules"] = """SELECT p_partkey AS rule_id, p_partkey // 8 % 5 AS university_id, ['all', 'only', 'except'][p_partkey % 3 + 1] AS mode, p_partkey // 2 AS olympiad_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'bvi' WHEN p_partkey % 7 = 0 THEN 'special' ELSE 'hundred_points' END AS route,
  CASE WHEN p_partkey % 11 = 0 THEN 'review' ELSE 'active' END AS status, p_partkey % 3 + 1 AS max_level, 2020 + p_partkey % 4 AS min_year FROM part"""


def targets(s, d):
    k = F.col("rule_id")
    t = rules(s, d).where("mode <> 'all'")
    return t.select("rule_id", F.lit("program").alias("kind"), (k % 60).cast("string").alias("value")).unionByName(
        t.where(k % 6 == 0).select(
            "rule_id", F.lit("direction").alias("kind"), F.when(k % 12 != 0, (k % 25).cast("string")).alias("value")
        )
    )


P.CTES["btargets"] = """SELECT rule_id, 'program' AS kind, CAST(rule_id % 60 AS VARCHAR) AS value FROM brules WHERE mode <> 'all'
  UNION ALL SELECT rule_id, 'direction', CASE WHEN rule_id % 12 <> 0 THEN CAST(rule_id % 25 AS VARCHAR) END FROM brules WHERE mode <> 'all' AND rule_id % 6 = 0"""
P.CTES["bscope"] = """SELECT rule_id, program_id, CASE WHEN mode = 'all' THEN 'applies' WHEN open_ AND NOT hit THEN 'review_required'
  WHEN mode = 'only' THEN CASE WHEN hit THEN 'applies' ELSE 'outside' END ELSE CASE WHEN hit THEN 'outside' ELSE 'applies' END END AS scope FROM (
  SELECT r.rule_id, p.program_id, r.mode, coalesce(bool_or((kind = 'program' AND value = CAST(p.program_id AS VARCHAR)) OR
  (kind = 'direction' AND value = CAST(p.direction_id AS VARCHAR))), false) AS hit, coalesce(bool_or(kind IS NOT NULL AND value IS NULL), false) AS open_
  FROM brules r JOIN programs p ON p.university_id = r.university_id LEFT JOIN btargets t ON t.rule_id = r.rule_id GROUP BY 1, 2, 3)"""
BEN = ("programs", "brules", "btargets", "bscope")


def scoped(s, d):
    return benefits.rule_scope(rules(s, d), targets(s, d), P.programs(s, d))


def facts(s, d):
    k = F.col("c_custkey")
    return P.table(s, d, "customer").select(
        k.alias("applicant_id"), (k * 3).alias("fact_id"), F.floor(k * 2 / 3).alias("olympiad_id"), (k % 3 + 1).alias("level"), (2019 + k % 6).alias("result_year")
    )


P.CTES["bfacts"] = """SELECT c_custkey AS applicant_id, c_custkey * 3 AS fact_id, c_custkey * 2 // 3 AS olympiad_id, c_custkey % 3 + 1 AS level,
  2019 + c_custkey % 6 AS result_year FROM customer"""


def needed(s, d):
    return rules(s, d).where("rule_id % 2 = 0").select(
        "rule_id", (F.col("rule_id") % 11).alias("subject"), F.lit(75.0).alias("threshold")
    )


def confirmed(s, d):
    f = facts(s, d).join(
        rules(s, d).select("rule_id", "olympiad_id"), "olympiad_id"
    ).select("applicant_id", "fact_id", "rule_id")
    return benefits.confirm(f, needed(s, d), P.applicants(s, d))


P.CTES["bconfirm"] = """SELECT applicant_id, fact_id, rule_id, CASE WHEN count(threshold) = 0 THEN 'not_required' WHEN coalesce(bool_or(score >= threshold), false) THEN 'confirmed'
  WHEN count(score) > 0 THEN 'not_confirmed' ELSE 'missing_score' END AS confirmation FROM (
  SELECT f.applicant_id, f.fact_id, r.rule_id, CASE WHEN r.rule_id % 2 = 0 THEN 75.0::DOUBLE END AS threshold, a.score FROM bfacts f JOIN brules r USING (olympiad_id)
  LEFT JOIN applicants a ON r.rule_id % 2 = 0 AND a.applicant_id = f.applicant_id AND a.subject = r.rule_id % 11) GROUP BY 1, 2, 3"""
P.CTES["beligible"] = """WITH x AS (SELECT f.applicant_id, c.program_id, r.rule_id, r.route, CASE WHEN r.status <> 'active' THEN 'review_required'
    WHEN c.scope = 'outside' OR f.level > r.max_level OR f.result_year < r.min_year THEN 'not_eligible' WHEN c.scope = 'review_required' THEN 'review_required'
    WHEN confirmation = 'missing_score' THEN 'insufficient_data' WHEN confirmation = 'not_confirmed' THEN 'not_eligible' WHEN route = 'special' THEN 'review_required'
    ELSE 'eligible' END AS outcome FROM bfacts f JOIN brules r USING (olympiad_id) JOIN bscope c ON c.rule_id = r.rule_id
    LEFT JOIN bconfirm k ON k.applicant_id = f.applicant_id AND k.fact_id = f.fact_id AND k.rule_id = r.rule_id),
  y AS (SELECT *, row_number() OVER (PARTITION BY applicant_id, program_id ORDER BY list_position(['insufficient_data', 'not_eligible', 'review_required', 'eligible'], outcome) DESC,
    (route = 'bvi') DESC, rule_id) AS n, count(*) OVER (PARTITION BY applicant_id, program_id) AS rules_seen FROM x)
  SELECT applicant_id, program_id, outcome AS status, route, rule_id, rules_seen FROM y WHERE n = 1"""
ELIG = (*BEN, "bfacts", "applicants", "bconfirm", "beligible")


def eligible(s, d):
    return benefits.benefit_eligibility(facts(s, d), rules(s, d), scoped(s, d), confirmed(s, d))


add("ab2_rule_scope", scoped, sql("SELECT * FROM bscope", *BEN))
add("ab3_confirm", confirmed, sql("SELECT * FROM bconfirm", "brules", "bfacts", "applicants", "bconfirm"))
add("ab1_benefit_eligibility", eligible, sql("SELECT * FROM beligible", *ELIG))
add(
    "ab9_rules_for_programs", lambda s, d: benefits.rules_for_programs(rules(s, d), scoped(s, d)).select(
        "rule_id", "program_id", "olympiad_id"
    ),
    sql(
        "SELECT rule_id, program_id, olympiad_id FROM brules JOIN bscope USING (rule_id) WHERE scope = 'applies'", *BEN
    ),
)
add(
    "ab9_rules_for_olympiad", lambda s, d: benefits.rules_for_olympiad(rules(s, d), targets(s, d), P.programs(s, d)),
    sql(
        "SELECT olympiad_id, count(DISTINCT rule_id) AS rules, count(DISTINCT program_id) AS programs FROM brules LEFT JOIN (SELECT * FROM bscope WHERE scope = 'applies') USING (rule_id) GROUP BY 1",
        *BEN
    ),
)


def best(s, d):
    found = benefits.best_rules(facts(s, d), rules(s, d), targets(s, d), P.programs(s, d), confirmed(s, d))
    return settle_table(found.where("status = 'eligible'"))


def rights(best):
    e = best.where("route = 'hundred_points'")
    return e.select("applicant_id", (F.col("rule_id") % 11).alias("subject")).distinct()


P.CTES["brights"] = "SELECT DISTINCT applicant_id, rule_id % 11 AS subject FROM beligible WHERE status = 'eligible' AND route = 'hundred_points'"
P.CTES["hundred"] = "SELECT m.*, CASE WHEN r.subject IS NOT NULL THEN 100.0::DOUBLE ELSE score END AS effective FROM matched m LEFT JOIN brights r USING (applicant_id, subject)"
HUND = (*ELIG, "brights", "offerings", "exams", "ap_pairs", "matched", "hundred")


def hundred(s, d, found=None):
    return benefits.hundred_points(matched(s, d), rights(best(s, d) if found is None else found))


add(
    "ab4_hundred_points",
    lambda s, d: hundred(s, d).select("applicant_id", "offering_id", "subject", "effective"),
    sql("SELECT applicant_id, offering_id, subject, effective FROM hundred", *HUND)
)


def with_groups(s, d):
    return hundred(s, d).withColumn(
        "group_id", F.col("subject") % 3
    ).withColumn("group_max", F.lit(1)).withColumn("group_min", F.lit(1))


add(
    "wn12_best_choice_exams", lambda s, d: benefits.best_choice_exams(with_groups(s, d)).select(
        "applicant_id", "offering_id", "group_id", "subject", "effective"
    ),
    sql(
        """SELECT applicant_id, offering_id, group_id, subject, effective FROM (SELECT *, subject % 3 AS group_id, row_number() OVER
  (PARTITION BY applicant_id, offering_id, subject % 3 ORDER BY effective DESC, subject) AS n FROM hundred WHERE effective IS NOT NULL
  AND (minimum_score IS NULL OR effective >= minimum_score)) WHERE n = 1""", *HUND),
)


def achievement_facts(s, d):
    k = F.col("l_orderkey")
    return P.table(s, d, "lineitem").where("l_linenumber <= 4").groupBy(
        (k % 1000).alias("applicant_id"), (F.col("l_partkey") % 9).alias("code"), (F.year("l_shipdate")).alias("year")
    ).agg(
        F.min(k * 10 + F.col("l_linenumber")).alias("place")
    ).withColumn("evidence", F.col("place") % 4 != 0)


def achievement_rules(s, d):
    return s.range(9).select(
        F.col("id").alias("code"), (F.col("id") % 3).alias("category"), (F.col("id") % 3 * 2 + 4.0).alias("category_cap"), (F.col("id") % 4 + 1.0).alias("points"),
        F.when(F.col("id") < 4, (F.col("id") % 2).cast("string")).alias("combination"),
    )


P.CTES["afacts"] = """SELECT l_orderkey % 1000 AS applicant_id, l_partkey % 9 AS code, CAST(year(l_shipdate) AS INT) AS year,
  min(l_orderkey * 10 + l_linenumber) AS place, min(l_orderkey * 10 + l_linenumber) % 4 <> 0 AS evidence FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3"""
P.CTES["adedup"] = """SELECT * FROM (SELECT *, CASE WHEN combination IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY applicant_id, combination ORDER BY points DESC, place, code, year) END AS n FROM (
  SELECT f.*, r.* EXCLUDE (code), row_number() OVER (PARTITION BY applicant_id, f.code, year ORDER BY place) AS m FROM afacts f JOIN
  (SELECT i AS code, i % 3 AS category, i % 3 * 2 + 4.0::DOUBLE AS category_cap, i % 4 + 1.0::DOUBLE AS points, CASE WHEN i < 4 THEN CAST(i % 2 AS VARCHAR) END AS combination FROM range(9) t(i)) r
  ON r.code = f.code WHERE evidence) WHERE m = 1) WHERE n = 1"""
P.CTES["awards"] = """SELECT *, least(in_category, greatest(0, 10 - coalesce(sum(in_category) OVER (PARTITION BY applicant_id ORDER BY place, code, year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS award FROM (
  SELECT *, least(points, greatest(0, category_cap - least(category_cap, coalesce(sum(points) OVER (PARTITION BY applicant_id, category ORDER BY place, code, year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS in_category FROM adedup)"""


def awards(s, d):
    return benefits.achievements(achievement_facts(s, d), achievement_rules(s, d))


add(
    "wn13_dedupe_achievements",
    lambda s, d: benefits.dedupe_achievements(
        achievement_facts(s, d).where("evidence").join(achievement_rules(s, d), "code")
    ).select("applicant_id", "code", "year", "points", "place"),
    sql("SELECT applicant_id, code, year, points, place FROM adedup", "afacts", "adedup"),
)
add(
    "wn14_apply_caps",
    lambda s, d: awards(s, d).select("applicant_id", "place", "in_category", "award"),
    sql("SELECT applicant_id, place, in_category, award FROM awards", "afacts", "adedup", "awards")
)
add(
    "ab6_achievements",
    lambda s, d: awards(s, d).groupBy("applicant_id").agg(F.sum("award").alias("bonus")),
    sql("SELECT applicant_id, sum(award) AS bonus FROM awards GROUP BY 1", "afacts", "adedup", "awards")
)
P.CTES["competitive"] = """SELECT applicant_id, offering_id, CASE WHEN NOT bvi THEN coalesce(points, 0) + coalesce(bonus, 0) END AS total,
  CASE WHEN bvi THEN 'not_applicable' WHEN failed THEN 'failed' WHEN missing > 0 THEN 'partial' ELSE 'complete' END AS status, missing FROM (
  SELECT applicant_id, offering_id, sum(effective) AS points, coalesce(bool_or(effective < minimum_score), false) AS failed, count(*) - count(effective) AS missing,
  applicant_id IN (SELECT applicant_id FROM beligible WHERE status = 'eligible' AND route = 'bvi') AS bvi FROM hundred GROUP BY 1, 2)
  LEFT JOIN (SELECT applicant_id, sum(award) AS bonus FROM awards GROUP BY 1) USING (applicant_id)"""
COMP = (*HUND, "afacts", "adedup", "awards", "competitive")


def competitive(s, d, found=None):
    found = best(s, d) if found is None else found
    return benefits.competitive_score(hundred(s, d, found), awards(s, d), found)


def decisions(s, d):
    found = best(s, d)
    used = rights(found).withColumnRenamed("subject", "code")
    return benefits.admission_decision(competitive(s, d, found), achievement_facts(s, d), used)


add("ab5_competitive_score", competitive, sql("SELECT * FROM competitive", *COMP))
add(
    "ab7_admission_decision",
    lambda s, d: decisions(s, d).select("applicant_id", "offering_id", "total", "status", "free_achievements"),
    sql(
        """SELECT c.applicant_id, offering_id, total, status, free_achievements FROM competitive c LEFT JOIN (SELECT f.applicant_id, count(*) AS free_achievements FROM afacts f
  WHERE NOT EXISTS (SELECT 1 FROM brights r WHERE r.applicant_id = f.applicant_id AND r.subject = f.code) GROUP BY 1) x ON x.applicant_id = c.applicant_id""", *COMP),
)
add(
    "ab8_verify_selection",
    lambda s, d: benefits.verify_selection(
        rules(s, d).where("rule_id % 5 <> 0").select(
            "rule_id",
            F.sha2(F.concat_ws("|", "route", "status"), 256).alias("content_hash")
        ),
        rules(s, d).where("rule_id % 7 <> 0").select(
            "rule_id",
            F.sha2(
                F.concat_ws("|", "route", F.when(F.col("rule_id") % 4 == 0, "x").otherwise(F.col("status"))), 256
            ).alias("content_hash")
        ),
    ),
    sql(
        """SELECT * FROM (SELECT rule_id, sha256(route || '|' || status) AS selected FROM brules WHERE rule_id % 5 <> 0) FULL JOIN
  (SELECT rule_id, sha256(route || '|' || CASE WHEN rule_id % 4 = 0 THEN 'x' ELSE status END) AS active FROM brules WHERE rule_id % 7 <> 0) USING (rule_id)
  WHERE selected IS DISTINCT FROM active""", "brules"),
)


# --- decisions ------------------------------------------------------------
def requests(s, d):
    """The query set: customers whose id is divisible by 100, against all offerings."""
    k = F.col("c_custkey")
    return P.table(s, d, "customer").where("c_custkey % 100 = 0").select(
        k.alias("request_id"), F.inline(F.array(
            F.struct(F.lit("year").alias("field"), (1996 + k / 100 % 5).cast("int").cast("string").alias("value")),
            F.struct(F.lit("funding").alias("field"), F.when(k % 200 == 0, "F").otherwise("O").alias("value")),
        )),
    )


def rough(s, d):
    """All offerings, some without a funding type."""
    return P.offerings(s, d).withColumn("funding_type", F.when(F.col("offering_id") % 100 != 0, F.col("funding_type")))


P.CTES["requests"] = """SELECT c_custkey AS request_id, 'year' AS field, CAST(1996 + c_custkey // 100 % 5 AS VARCHAR) AS value FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey, 'funding', CASE WHEN c_custkey % 200 = 0 THEN 'F' ELSE 'O' END FROM customer WHERE c_custkey % 100 = 0"""
P.CTES["rough"] = "SELECT * EXCLUDE (funding_type), CASE WHEN offering_id % 100 <> 0 THEN funding_type END AS funding_type FROM offerings"
P.CTES["outcomes"] = """SELECT request_id, program_id, field, CASE WHEN coalesce(bool_or(coalesce(actual = value, false))) THEN 'satisfied' WHEN bool_or(actual IS NULL) THEN 'insufficient_data' ELSE 'violated' END AS outcome
  FROM requests JOIN (SELECT program_id, 'year' AS field, CAST(admission_year AS VARCHAR) AS actual FROM rough UNION ALL SELECT program_id, 'funding', funding_type FROM rough) USING (field) GROUP BY 1, 2, 3"""
OUT = ("requests", "offerings", "rough", "outcomes")


def outcomes(s, d):
    return decision.constraint_outcomes(rough(s, d), requests(s, d))


add("flt10_constraint_outcomes", outcomes, sql("SELECT * FROM outcomes", *OUT))


def priced(s, d):
    o = P.offerings(s, d)
    return o.withColumn(
        "funding_type",
        F.when(F.col("funding_type") == "F", "budget").otherwise(F.col("funding_type"))
    ).withColumn("currency", F.when(F.col("offering_id") % 3 == 0, "USD").otherwise("RUB"))


add(
    "flt11_tuition_outcome", lambda s, d: decision.tuition_outcome(
        priced(s, d),
        requests(s, d).select("request_id").distinct().withColumn("max_tuition", 20000.0 + F.col("request_id") * 100)
    ),
    sql(
        """WITH o AS (SELECT program_id, count(*) FILTER (funding_type <> 'F') AS n, min(CASE WHEN funding_type <> 'F' AND offering_id % 3 <> 0 THEN tuition END) AS cheapest FROM offerings GROUP BY 1)
  SELECT request_id, program_id, cheapest, CASE WHEN n = 0 THEN 'not_applicable' WHEN cheapest IS NULL THEN 'insufficient_data' WHEN cheapest <= 20000 + request_id * 100 THEN 'satisfied' ELSE 'violated' END AS outcome
  FROM o CROSS JOIN (SELECT DISTINCT request_id FROM requests)""", "offerings", "requests"),
)


def scored(s, d):
    per = outcomes(s, d).groupBy("request_id", "program_id").agg(
        F.bool_or(F.col("outcome") == "violated").alias("violated"),
        F.bool_or(F.col("outcome") == "insufficient_data").alias("insufficient")
    )
    k = F.col("request_id") * 3 + F.col("program_id") * 7
    return per.withColumn("content_fit", (k % 101).cast("int")).withColumn(
        "fit_status",
        F.when(k % 5 == 0, "unlikely").when(k % 7 == 0, "insufficient_data").otherwise("realistic")
    )


P.CTES["scored"] = """SELECT request_id, program_id, bool_or(outcome = 'violated') AS violated, bool_or(outcome = 'insufficient_data') AS insufficient,
  CAST((request_id * 3 + program_id * 7) % 101 AS INT) AS content_fit, CASE WHEN (request_id * 3 + program_id * 7) % 5 = 0 THEN 'unlikely'
  WHEN (request_id * 3 + program_id * 7) % 7 = 0 THEN 'insufficient_data' ELSE 'realistic' END AS fit_status FROM outcomes GROUP BY 1, 2"""
P.CTES["parts"] = """WITH k AS (SELECT *, CASE WHEN fit_status = 'unlikely' OR violated THEN 'ineligible' WHEN fit_status = 'insufficient_data' OR insufficient THEN 'insufficient' ELSE 'usable' END AS kind FROM scored),
  r AS (SELECT *, row_number() OVER (PARTITION BY request_id, kind ORDER BY content_fit DESC NULLS LAST, program_id) AS n FROM k)
  SELECT request_id, program_id, content_fit, n, CASE WHEN kind <> 'usable' THEN kind WHEN n <= 3 THEN 'primary' ELSE 'alternative' END AS part FROM r WHERE n <= CASE kind WHEN 'usable' THEN 5 ELSE 20 END"""


def partitioned(s, d):
    return decision.partition_candidates(scored(s, d))


add(
    "wn3_partition_candidates",
    lambda s, d: partitioned(s, d).select("request_id", "program_id", "content_fit", "n", "part"),
    sql("SELECT * FROM parts", *OUT, "scored", "parts")
)
add(
    "jn13_drop_chosen", lambda s, d: decision.drop_chosen(
        scored(s, d).select("request_id", "program_id"),
        partitioned(s, d).where("part = 'primary'").select("request_id", "program_id")
    ),
    sql(
        "SELECT request_id, program_id FROM scored EXCEPT SELECT request_id, program_id FROM parts WHERE part = 'primary'",
        *OUT, "scored", "parts"
    ),
)


def suggestions(s, d):
    r = requests(s, d).select("request_id").distinct().select(
        "request_id", F.col("request_id").alias("profile_id"), F.col("request_id").alias("applicant_id")
    )
    f = scored(s, d).select(F.col("request_id").alias("profile_id"), "program_id", "content_fit")
    a = scored(s, d).where("program_id % 3 <> 0").select(
        F.col("request_id").alias("applicant_id"), "program_id", F.col("fit_status").alias("status")
    )
    return decision.suggest(r, f, outcomes(s, d), a).select("request_id", "program_id", "part", "n", "completeness")


add(
    "rc6_suggest", suggestions,
    sql(
        """WITH j AS (SELECT request_id, program_id, content_fit, violated, insufficient, CASE WHEN program_id % 3 <> 0 THEN fit_status END AS fit_status FROM scored),
  k AS (SELECT *, CASE WHEN fit_status = 'unlikely' OR violated THEN 'ineligible' WHEN fit_status = 'insufficient_data' OR insufficient THEN 'insufficient' ELSE 'usable' END AS kind FROM j),
  r AS (SELECT *, row_number() OVER (PARTITION BY request_id, kind ORDER BY content_fit DESC NULLS LAST, program_id) AS n FROM k)
  SELECT request_id, program_id, CASE WHEN kind <> 'usable' THEN kind WHEN n <= 3 THEN 'primary' ELSE 'alternative' END AS part, n,
  round(CASE WHEN fit_status IS NULL THEN 2 ELSE 3 END / 3::DOUBLE, 4) AS completeness FROM r WHERE n <= CASE kind WHEN 'usable' THEN 5 ELSE 20 END""", *OUT, "scored"),
)


# --- events, places -------------------------------------------------------
def calendar(s, d):
    return P.table(s, d, "events").select(
        "event_id", F.col("ts").alias("starts_at"), F.col("event_type").alias("kind"), F.when(
            F.col("event_id") % 3 != 0, F.col("event_id") % 50
        ).alias("point_id")
    )


def event_links(s, d):
    k = F.col("event_id")
    return calendar(s, d).select(
        "event_id",
        F.explode(F.array(k % 97, (k / 10).cast("bigint") % 89)).alias("program_id")
    ).distinct()


P.CTES["calendar"] = "SELECT event_id, ts AS starts_at, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END AS point_id FROM events"
P.CTES["elinks"] = "SELECT event_id, event_id % 97 AS program_id FROM calendar UNION SELECT event_id, event_id // 10 % 89 FROM calendar"


def wanted(s, d):
    return P.programs(s, d).where("university_id = 3").select("program_id")


add(
    "flt8_find_events", lambda s, d: campus.find_events(
        calendar(s, d), event_links(s, d), "2024-01-05", "2024-01-20", "signup", wanted(s, d), limit=50
    ).select("event_id", "starts_at", "total"),
    sql(
        """WITH e AS (SELECT * FROM calendar WHERE CAST(starts_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND kind = 'signup' AND event_id IN
  (SELECT event_id FROM elinks WHERE program_id IN (SELECT program_id FROM programs WHERE university_id = 3)))
  SELECT event_id, starts_at, (SELECT count(*) FROM e) AS total FROM e ORDER BY starts_at, event_id LIMIT 50""", "programs", "calendar", "elinks"),
)
add(
    "flt9_find_points",
    lambda s, d: campus.find_points(
        s.range(50).withColumnRenamed("id", "point_id").join(calendar(s, d).select("point_id").distinct(), "point_id"),
        P.programs(s, d).select((F.col("program_id") % 50).alias("point_id"), "program_id"), calendar(s, d),
        event_links(s, d), wanted(s, d)
    ),
    sql(
        """WITH w AS (SELECT program_id FROM programs WHERE university_id = 3) SELECT DISTINCT point_id FROM calendar c WHERE point_id IS NOT NULL AND (point_id IN (SELECT program_id % 50 FROM w)
  OR point_id IN (SELECT point_id FROM calendar JOIN elinks USING (event_id) WHERE program_id IN (SELECT program_id FROM w)))""", "programs", "calendar", "elinks"),
)
add(
    "jn6_collect_links", lambda s, d: campus.collect_links(
        calendar(s, d), event_links(s, d), "event_id", "program_id"
    ).select("event_id", "links", "n_links"),
    sql(
        "SELECT event_id, array_to_string(list(program_id ORDER BY program_id), ',') AS links, count(*) AS n_links FROM calendar JOIN elinks USING (event_id) GROUP BY 1",
        "calendar", "elinks"
    ),
)
add(
    "jn7_recommended_places", lambda s, d: campus.recommended_places(
        calendar(s, d), event_links(s, d), wanted(s, d)
    ).select("event_id", "has_point"),
    sql(
        "SELECT event_id, point_id IS NOT NULL AS has_point FROM calendar WHERE event_id IN (SELECT event_id FROM elinks WHERE program_id IN (SELECT program_id FROM programs WHERE university_id = 3))",
        "programs", "calendar", "elinks"
    ),
)


def overlay(s, d):
    k = F.col("program_id")
    return P.programs(s, d).where(k % 4 == 0).select(
        "program_id", (k % 8 == 0).alias("hidden"),
        F.when(k % 12 == 0, F.concat(F.lit("Title "), k.cast("string"))).alias("title_override")
    )


add(
    "flt14_public_catalog",
    lambda s, d: campus.public_catalog(
        P.programs(s, d).withColumn("unit_id", F.col("direction_id")).withColumnRenamed("code", "name"), overlay(s, d),
        P.table(s, d, "nation").select(
            F.col("n_nationkey").alias("unit_id"), (F.col("n_nationkey") % 3 != 0).alias("published")
        )
    ).select("program_id", "title"),
    sql(
        "SELECT program_id, CASE WHEN program_id % 12 = 0 THEN 'Title ' || program_id ELSE code END AS title FROM programs WHERE direction_id % 3 <> 0 AND program_id % 8 <> 0",
        "programs"
    ),
)
add(
    "flt15_public_editorial_events",
    lambda s, d: campus.public_editorial_events(
        calendar(s, d).withColumn(
            "status",
            F.when(F.col("event_id") % 4 != 0, "published").otherwise("draft")
        ).withColumn("audience", F.when(F.col("event_id") % 30 == 0, "all").otherwise("selected")),
        event_links(s, d).select(
            "event_id", (F.col("program_id") % 25).alias("unit_id")
        ), P.table(s, d, "nation").select(
            F.col("n_nationkey").alias("unit_id"), (F.col("n_nationkey") % 3 != 0).alias("published")
        ),
    ).select("event_id", "audience", "n_targets"),
    sql(
        """SELECT event_id, CASE WHEN event_id % 30 = 0 THEN 'all' ELSE 'selected' END AS audience, coalesce(n, 0) AS n_targets FROM calendar LEFT JOIN
  (SELECT event_id, count(DISTINCT program_id % 25) AS n FROM elinks WHERE program_id % 25 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) GROUP BY 1) USING (event_id)
  WHERE event_id % 4 <> 0 AND (event_id % 30 = 0 OR n > 0)""", "calendar", "elinks"),
)


def recs(s, d):
    return partitioned(s, d).where("part in ('primary', 'alternative')").select(
        F.col("request_id").alias("profile_id"), "program_id", F.col("n").alias("place")
    )


PLAN = f"""WITH r AS (SELECT request_id AS profile_id, program_id, n AS place FROM parts WHERE part IN ('primary', 'alternative')), x AS (
  SELECT profile_id, 1 AS o, 'explore' AS step, CAST(program_id AS VARCHAR) AS what, CAST(NULL AS TIMESTAMP) AS first_at FROM r WHERE place = 1
  UNION ALL SELECT profile_id, 2, 'compare', string_agg(CAST(program_id AS VARCHAR), ',' ORDER BY place), NULL FROM r WHERE place <= 2 GROUP BY 1 HAVING count(*) = 2
  UNION ALL SELECT profile_id, 3, 'attend', CAST(event_id AS VARCHAR), min(starts_at) FROM r JOIN elinks USING (program_id) JOIN calendar USING (event_id) WHERE starts_at > TIMESTAMP '{NOW}' GROUP BY profile_id, event_id)
  SELECT profile_id, step, what, first_at AS starts_at, row_number() OVER (PARTITION BY profile_id ORDER BY o, first_at NULLS FIRST, what) AS step_number FROM x"""
add(
    "wn18_plan_steps",
    lambda s, d: decision.plan_steps(
        recs(s, d), calendar(s, d).join(event_links(s, d), "event_id"), F.lit(NOW).cast("timestamp")
    ),
    sql(PLAN, *OUT, "scored", "parts", "calendar", "elinks"),
)
add(
    "jn17_candidate_snapshot",
    lambda s, d: decision.candidate_snapshot(
        P.programs(s, d),
        P.items(s, d).where("hours = 50").select("program_id", F.col("discipline_id").alias("fingerprint")),
        P.offerings(s, d),
        P.table(s, d, "region").select(F.col("r_regionkey").alias("university_id"), F.col("r_name").alias("university"))
    ).select("program_id", "n_fingerprints", "fingerprint", "n_offerings", "university", "repeated"),
    sql(
        """SELECT p.program_id, f.n AS n_fingerprints, f.fp AS fingerprint, o.n AS n_offerings, r_name AS university, coalesce(f.n > 1, false) AS repeated FROM programs p
  LEFT JOIN (SELECT program_id, count(*) AS n, min(discipline_id) AS fp FROM items WHERE hours = 50 GROUP BY 1) f USING (program_id)
  LEFT JOIN (SELECT program_id, count(*) AS n FROM offerings GROUP BY 1) o USING (program_id) LEFT JOIN region ON r_regionkey = university_id""", "programs", "items", "offerings"),
)

# --- funnels and streams over the event table -----------------------------
add(
    "ag20_funnel", lambda s, d: evaluate.funnel(P.decision_events(s, d), F.lit(NOW).cast("timestamp")),
    sql(
        f"""SELECT event_type, count(DISTINCT owner_key) AS owners, count(*) AS events, round(avg(CASE WHEN CAST(payload->>'$.k' AS INT) BETWEEN 0 AND 20 THEN CAST(payload->>'$.k' AS INT) END), 2) AS average_size
  FROM decisions WHERE expires_at > TIMESTAMP '{NOW}' GROUP BY 1""", "decisions"),
)
add(
    "ag20_conversions", lambda s, d: evaluate.conversions(
        P.decision_events(s, d), "session_started", ["final_choice", "program_added"]
    ),
    sql("""SELECT count(DISTINCT CASE WHEN event_type = 'session_started' THEN owner_key END) AS base_owners,
  round(count(DISTINCT CASE WHEN event_type = 'final_choice' THEN owner_key END) * 100.0::DOUBLE / count(DISTINCT CASE WHEN event_type = 'session_started' THEN owner_key END), 2) AS final_choice_percent,
  round(count(DISTINCT CASE WHEN event_type = 'program_added' THEN owner_key END) * 100.0::DOUBLE / count(DISTINCT CASE WHEN event_type = 'session_started' THEN owner_key END), 2) AS program_added_percent
  FROM decisions""", "decisions"),
)
add(
    "ag21_questionnaire_stats", lambda s, d: evaluate.questionnaire_stats(P.decision_events(s, d)),
    sql(
        """WITH g AS (SELECT *, epoch_ms(occurred_at) - epoch_ms(lag(occurred_at) OVER (PARTITION BY owner_key ORDER BY occurred_at, event_id)) AS gap FROM decisions)
  SELECT count(*) AS events, count(*) FILTER (event_type = 'session_started') AS started, count(*) FILTER (event_type = 'final_choice') AS completed,
  round(count(*) FILTER (event_type = 'final_choice')::DOUBLE / count(*) FILTER (event_type = 'session_started'), 4) AS completion_rate, median(gap) AS median_response_ms FROM g""", "decisions"),
)
add(
    "flt13_live",
    lambda s, d: evaluate.live(P.decision_events(s, d), F.lit(NOW).cast("timestamp")).select("event_id", "owner_key"),
    sql(f"SELECT event_id, owner_key FROM decisions WHERE expires_at > TIMESTAMP '{NOW}'", "decisions")
)
add(
    "flt13_purge", lambda s, d: evaluate.purge(
        P.decision_events(s, d), F.lit(NOW).cast("timestamp"), 100
    ).select("event_id"),
    sql(
        f"SELECT event_id FROM decisions WHERE event_id NOT IN (SELECT event_id FROM decisions WHERE expires_at <= TIMESTAMP '{NOW}' ORDER BY expires_at, event_id LIMIT 100)",
        "decisions"
    ),
)
add(
    "ss7_sliding_rate", lambda s, d: evaluate.sliding_rate(
        P.decision_events(s, d), "owner_key", 86400
    ).select("event_id", "recent"),
    sql(
        "SELECT event_id, count(*) OVER (PARTITION BY owner_key ORDER BY epoch(date_trunc('second', occurred_at))::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM decisions",
        "decisions"
    ),
)


def actions(s, d):
    e = P.decision_events(s, d)
    k = F.col("event_id")
    act = F.when(
        F.col("event_type") == "session_started", "add"
    ).when(F.col("event_type") == "program_added", "add").when(
        F.col("event_type") == "comparison_started", "choose"
    ).when(
        F.col("event_type") == "comparison_completed", "remove"
    ).otherwise(F.when(k % 2 == 0, "exclude").otherwise("restore"))
    return e.select("owner_key", k.alias("seq"), act.alias("action"), (k % 6).alias("program_id"))


_ACTIONS = """acts AS (SELECT owner_key, event_id % 6 AS p, CASE event_type WHEN 'session_started' THEN 'add' WHEN 'program_added' THEN 'add'
    WHEN 'comparison_started' THEN 'choose' WHEN 'comparison_completed' THEN 'remove'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'exclude' ELSE 'restore' END END AS act,
    row_number() OVER (PARTITION BY owner_key ORDER BY event_id) AS n FROM decisions)"""
add(
    "ss4_decision_state",
    lambda s, d: decision.decision_state(actions(s, d)).select(
        "owner_key", "revision", "rejected", F.size("shortlist").alias("shortlisted"), "choice"
    ),
    P.recursive(
        f"""{_ACTIONS}, fold(owner_key, n, short, gone, choice, revision, rejected) AS (
    SELECT DISTINCT owner_key, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, 0, 0 FROM acts
    UNION ALL SELECT owner_key, n, CASE WHEN ok AND act = 'add' THEN list_append(short, p)
      WHEN ok AND act IN ('remove', 'exclude') THEN list_filter(short, lambda x: x <> p) ELSE short END,
      CASE WHEN ok AND act = 'exclude' THEN list_append(gone, p) WHEN ok AND act = 'restore' THEN list_filter(gone, lambda x: x <> p) ELSE gone END,
      CASE WHEN ok AND act = 'choose' THEN p WHEN ok AND act IN ('remove', 'exclude') AND choice = p THEN NULL ELSE choice END,
      revision + ok::INT, rejected + (NOT ok)::INT
    FROM (SELECT f.*, CASE act WHEN 'add' THEN NOT on_ AND NOT out_ WHEN 'exclude' THEN NOT out_ WHEN 'restore' THEN out_ ELSE on_ END AS ok
      FROM (SELECT a.owner_key, a.n, a.act, a.p, short, gone, choice, revision, rejected,
        list_contains(short, a.p) AS on_, list_contains(gone, a.p) AS out_ FROM fold JOIN acts a ON a.owner_key = fold.owner_key AND a.n = fold.n + 1) f))
  SELECT owner_key, revision, rejected, CAST(len(short) AS INT) AS shortlisted, choice FROM fold QUALIFY row_number() OVER (PARTITION BY owner_key ORDER BY n DESC) = 1""",
        "decisions",
    ),
)
add(
    "ss7_sliding_cap",
    lambda s, d: stream.sliding_cap_batch(P.decision_events(s, d), 3, 86400),
    P.recursive(
        """e AS (SELECT owner_key, event_id, epoch_us(occurred_at) AS us, row_number() OVER (PARTITION BY owner_key ORDER BY epoch_us(occurred_at), event_id) AS n FROM decisions),
  fold(owner_key, n, event_id, kept, ok) AS (SELECT DISTINCT owner_key, 0::BIGINT, NULL::BIGINT, []::BIGINT[], false FROM e
    UNION ALL SELECT owner_key, n, event_id, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END, len(live) < 3
    FROM (SELECT e.*, list_filter(kept, lambda x: x > e.us - 86400000000) AS live FROM fold JOIN e ON e.owner_key = fold.owner_key AND e.n = fold.n + 1))
  SELECT owner_key, event_id FROM fold WHERE ok""",
        "decisions",
    ),
)
add(
    "ss6_split_client_events", lambda s, d: stream.split_client_events(P.decision_events(s, d))[1].groupBy("event_type").agg(
        F.count(F.lit(1)).alias("refused")
    ),
    sql(
        "SELECT event_type, count(*) AS refused FROM decisions WHERE event_type IN ('session_started', 'session_expired', 'final_choice_confirmed') GROUP BY 1",
        "decisions"
    ),
)
add(
    "ss5_reject_stale_revisions", lambda s, d: stream.reject_stale_revisions(
        P.decision_events(s, d).select(
            "owner_key", F.col("event_id").alias("seq"),
            (F.col("event_id") / 100 + F.col("event_id") % 3).cast("int").alias("base_revision")
        )
    ).select("seq", "stale"),
    sql(
        """WITH t AS (SELECT owner_key, event_id AS seq, CAST(floor(event_id / 100.0 + event_id % 3) AS INT) AS base_revision FROM decisions)
  SELECT seq, coalesce(base_revision < max(base_revision) OVER (PARTITION BY owner_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM t""", "decisions"),
)
add(
    "ss3_with_expiry", lambda s, d: stream.with_expiry(P.decision_events(s, d)).select("event_id", "expires_at"),
    sql("SELECT event_id, occurred_at + INTERVAL 180 DAY AS expires_at FROM decisions", "decisions"),
)

CAPS = {"auth": 2, "ops": 5, "sensitive": 3}
PATHS = ["/auth/login", "/ops/jobs", "/decision/items", "/proftest/profile", "/programs"]


def calls(s, d):
    """Events as requests: most of them change something on one of five paths."""
    e = P.decision_events(s, d)
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.withColumns({"path": path, "method": F.when(F.col("event_id") % 7 == 0, "GET").otherwise("post")})


_CALLS = f"""calls AS (SELECT owner_key, event_id, epoch_us(occurred_at) AS us, path,
    CASE WHEN event_id % 7 = 0 OR path = '/programs' THEN NULL WHEN path = '/auth/login' THEN 'auth' WHEN path = '/ops/jobs' THEN 'ops' ELSE 'sensitive' END AS class
    FROM (SELECT *, {PATHS}[event_id % 5 + 1] AS path FROM decisions)),
  e AS (SELECT *, CASE class WHEN 'auth' THEN 2 WHEN 'ops' THEN 5 ELSE 3 END AS cap,
    row_number() OVER (PARTITION BY owner_key, class, path ORDER BY us, event_id) AS n FROM calls WHERE class IS NOT NULL)"""
add(
    "ss7_capped_by_class",
    lambda s, d: timed.cap_table(
        timed.class_caps(calls(s, d), CAPS), ["owner_key", "cap_class", "path"], 864000
    ).select("owner_key", "cap_class", "event_id", "accepted"),
    P.recursive(
        f"""{_CALLS}, fold(owner_key, class, path, n, event_id, kept, ok) AS (
    SELECT DISTINCT owner_key, class, path, 0::BIGINT, NULL::BIGINT, []::BIGINT[], false FROM e
    UNION ALL SELECT owner_key, class, path, n, event_id, CASE WHEN len(live) < cap THEN list_append(live, us) ELSE live END, len(live) < cap
    FROM (SELECT e.*, list_filter(kept, lambda x: x > e.us - 864000000000) AS live FROM fold
      JOIN e ON e.owner_key = fold.owner_key AND e.class = fold.class AND e.path = fold.path AND e.n = fold.n + 1))
  SELECT owner_key, class AS cap_class, event_id, ok AS accepted FROM fold WHERE n > 0
  UNION ALL SELECT owner_key, NULL, event_id, true FROM calls WHERE class IS NULL""",
        "decisions",
    ),
)
add(
    "ss5_session_turns",
    lambda s, d: timed.turns_table(
        P.decision_events(s, d).withColumn(
            "expected", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 4 + 1).cast("int")
        ), 432000
    ),
    P.recursive(
        """t AS (SELECT owner_key, event_id, epoch_us(occurred_at) AS us, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 4 + 1 AS INT) END AS expected,
    row_number() OVER (PARTITION BY owner_key ORDER BY epoch_us(occurred_at), event_id) AS n FROM decisions),
  fold(owner_key, n, event_id, verdict, revision, until) AS (
    SELECT DISTINCT owner_key, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0, NULL::BIGINT FROM t
    UNION ALL SELECT owner_key, n, event_id, verdict,
      CAST(CASE verdict WHEN 'opened' THEN 1 WHEN 'no_session' THEN 0 WHEN 'applied' THEN revision + 1 ELSE revision END AS INT),
      CASE WHEN verdict = 'opened' THEN us + 432000000000 WHEN live THEN until END
    FROM (SELECT *, CASE WHEN NOT live AND expected IS NOT NULL THEN 'no_session' WHEN NOT live THEN 'opened'
        WHEN expected <> revision THEN 'stale' ELSE 'applied' END AS verdict
      FROM (SELECT t.*, fold.revision, fold.until, coalesce(t.us < fold.until, false) AS live
        FROM fold JOIN t ON t.owner_key = fold.owner_key AND t.n = fold.n + 1)))
  SELECT owner_key, event_id, verdict, revision FROM fold WHERE n > 0""",
        "decisions",
    ),
)
