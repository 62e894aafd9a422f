"""Queries over profiles, recommendations, reviews and what-if questions, with their column functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import campus, decision, knowledge, metrics, policy, quality, recommend, text
from . import analytics as A
from . import proxy as P
from . import records as R
from . import rules as U
from . import scoring as C
from .proxy import sql

Q: dict = {}
S: dict = {}
N_QUESTIONS = 20


def add(name, fn, oracle):
    Q[name] = fn
    S[name] = oracle


def pick(number, *values):
    """The value that a number picks from a list, by its remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


# --- answers and profiles -------------------------------------------------
def answers(s, d):
    """Events as answers of a questionnaire."""
    k = F.col("event_id")
    return P.table(s, d, "events").select(
        F.col("user_id").alias("profile_id"),
        (k % 7).alias("question_id"),
        (F.floor(k / 7) % 4).alias("option_id"),
        (k % 3 * 0.5 + 0.5).cast("double").alias("intensity"),
        pick(k, "answered", "uncertain", "skipped", "answered").alias("state"),
        (k % 5 == 0).alias("adaptive"),
    )


def options(s):
    """What each option of the seven questions stands for."""
    q, o = F.col("question_id"), F.col("option_id")
    grid = s.range(28).select(F.floor(F.col("id") / 4).alias("question_id"), (F.col("id") % 4).alias("option_id"))
    return grid.select(
        "question_id",
        "option_id",
        pick(q + o, "subject", "activity", "negative").alias("kind"),
        F.concat(F.lit("key"), (q % 5).cast("string")).alias("key"),
        ((o + 1) * 0.25).cast("double").alias("weight"),
    )


P.CTES["answers"] = """SELECT user_id AS profile_id, event_id % 7 AS question_id, event_id // 7 % 4 AS option_id,
  event_id % 3 * 0.5::DOUBLE + 0.5::DOUBLE AS intensity,
  ['answered', 'uncertain', 'skipped', 'answered'][event_id % 4 + 1] AS state, event_id % 5 = 0 AS adaptive FROM events"""
P.CTES["options"] = """SELECT q AS question_id, o AS option_id, ['subject', 'activity', 'negative'][(q + o) % 3 + 1] AS kind,
  'key' || q % 5 AS key, (o + 1) * 0.25::DOUBLE AS weight FROM range(7) a(q), range(4) b(o)"""
add(
    "ag22_build_profiles",
    lambda s, d: recommend.build_profiles(answers(s, d), options(s)),
    sql(
        """WITH w AS (SELECT profile_id, kind, key, sum(weight * intensity) AS w FROM answers
    JOIN options USING (question_id, option_id) GROUP BY ALL)
  SELECT profile_id, kind, key, round(CASE WHEN kind = 'negative' THEN least(1.0, w)
    ELSE w / sum(w) OVER (PARTITION BY profile_id, kind) END, 6) AS weight FROM w WHERE w > 0""",
        "answers",
        "options",
    ),
)
add(
    "ag23_profile_confidence",
    lambda s, d: recommend.profile_confidence(answers(s, d), N_QUESTIONS),
    sql(
        f"""SELECT profile_id, round(least(1.0, count(*) FILTER (state = 'answered' AND NOT adaptive) / {N_QUESTIONS}.0::DOUBLE
    + least(2, count(*) FILTER (state = 'answered' AND adaptive)) * 0.1::DOUBLE), 4) AS confidence,
  round(avg(CASE state WHEN 'answered' THEN 1.0::DOUBLE WHEN 'uncertain' THEN 0.25 ELSE 0 END), 4) AS dimension_confidence,
  count(*) FILTER (state = 'skipped') AS skipped FROM answers GROUP BY 1""",
        "answers",
    ),
)


# --- recommendations ------------------------------------------------------
def recommended(s, d):
    evidence = A.evidence_rows(s, d)
    codes = P.programs(s, d).select("program_id", "code")
    return recommend.recommend(
        A.profiles(s, d), A.shares(s, d), A.activities(s, d), A.subject_areas(s, d), codes, evidence, k=10
    )


add(
    "rc5_recommend",
    lambda s, d: recommended(s, d).select(
        "profile_id", "program_id", "place", "content_fit", F.size("reasons").alias("n_reasons"),
        F.get("reasons", F.lit(0))["key"].alias("first_reason"), "reliability", "reliability_status",
    ),
    sql(
        f"""WITH {A._TOP}, why AS ({A.REASONS}),
  ev AS ({A.EVIDENCE})
  SELECT t.profile_id, t.program_id, t.place, t.content_fit, CAST(coalesce(n, 0) AS INT) AS n_reasons, first_reason,
    reliability, coalesce(reliability_status, 'not_available') AS reliability_status FROM top t
  LEFT JOIN (SELECT profile_id, program_id, count(*) AS n, arg_min(key, place) AS first_reason FROM why GROUP BY 1, 2) w
    ON w.profile_id = t.profile_id AND w.program_id = t.program_id
  LEFT JOIN ev ON ev.profile_id = t.profile_id""",
        "programs",
        *A.FIT,
    ),
)


def signals(s, d):
    """Which signals stand behind each profile's recommendations."""
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    per = A.profiles(s, d).groupBy("profile_id").agg(
        has("subject").alias("subject"), has("activity").alias("activity"), has("negative").alias("negative")
    )
    number = F.col("profile_id") / 100
    names = recommend.signals_used(
        F.col("subject"), F.col("activity"), F.col("negative"), number % 2 == 0, number % 3 == 0
    )
    return per.select("profile_id", F.array_join(names, ",").alias("signals"))


add(
    "rc4_signals_used",
    signals,
    sql(
        """WITH p AS (SELECT profile_id, bool_or(kind = 'subject') AS s, bool_or(kind = 'activity') AS a,
    bool_or(kind = 'negative') AS n FROM profiles GROUP BY 1)
  SELECT profile_id, array_to_string(list_sort(list_filter([CASE WHEN s THEN 'profile_subject_preference' END,
    CASE WHEN s OR n THEN 'curriculum_area_share' END, CASE WHEN a THEN 'profile_activity_preference' END,
    CASE WHEN a THEN 'curriculum_activity_mapping' END, CASE WHEN n THEN 'profile_anti_interest' END,
    CASE WHEN (s OR a) AND profile_id // 100 % 2 = 0 THEN 'distinctive_subject' END,
    CASE WHEN profile_id // 100 % 3 = 0 THEN 'semester_distribution' END], lambda x: x IS NOT NULL)), ',') AS signals FROM p""",
        "profiles",
    ),
)


def rankings(s, d):
    """Orders as snapshots of a customer's ranking."""
    k = F.col("o_orderkey")
    revision = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    ids = F.array(k % 2, k % 3 + 10, F.lit(20).cast("long"), k % 5 + 30)
    return P.table(s, d, "orders").select(
        F.col("o_custkey").alias("profile_id"), revision.alias("revision"), ids.alias("ids"),
        F.array(90 - k % 3, F.lit(80).cast("long"), 70 - k % 7, F.lit(60).cast("long")).alias("scores"),
    )


add(
    "wn16_ranking_stability",
    lambda s, d: recommend.ranking_stability(rankings(s, d)).select("profile_id", "revision", "delta", "stability"),
    """WITH r AS (SELECT o_custkey AS p, row_number() OVER w AS revision, o_orderkey AS k, lag(o_orderkey) OVER w AS was
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  x AS (SELECT *, greatest(abs(k % 3 - was % 3), abs(k % 7 - was % 7)) AS delta,
    k % 2 = was % 2 AND k % 3 = was % 3 AS same FROM r)
  SELECT p AS profile_id, CAST(revision AS INT) AS revision, CASE WHEN was IS NOT NULL THEN delta END AS delta,
    CASE WHEN was IS NULL THEN 'first' WHEN same AND delta = 0 THEN 'stable' WHEN same AND delta <= 3 THEN 'low_impact'
    ELSE 'changed' END AS stability FROM x""",
)
add(
    "wn1_sort_limit",
    lambda s, d: metrics.sort_limit(
        P.programs(s, d).select("program_id", "balance"), "balance", ["program_id"], True, 50
    ),
    sql(
        "SELECT program_id, balance FROM programs ORDER BY coalesce(balance, -1) DESC, program_id LIMIT 50", "programs"
    ),
)


def plan(s, d):
    return decision.personal_plan(C.recs(s, d), C.calendar(s, d), C.event_links(s, d), F.lit(C.NOW).cast("timestamp"))


add(
    "pr1_personal_plan",
    lambda s, d: plan(s, d).select("profile_id", "step", "what", "step_number", "point_id", "has_point"),
    sql(
        f"""WITH steps AS ({C.PLAN}) SELECT profile_id, step, what, step_number, point_id,
    CASE WHEN step = 'attend' THEN point_id IS NOT NULL END AS has_point
  FROM steps LEFT JOIN calendar ON step = 'attend' AND CAST(event_id AS VARCHAR) = what""",
        *C.OUT, "scored", "parts", "calendar", "elinks",
    ),
)


def agenda(s, d):
    k = F.col("event_id")
    rows = P.table(s, d, "events").select(
        F.floor(k / 4).alias("event_id"), F.col("ts").alias("starts_at"), F.col("event_type").alias("title"), k.alias("row_id")
    )
    return campus.ordered_agenda(rows.withColumn("title", F.concat_ws(" ", "title", "row_id")))


add(
    "jn7_ordered_agenda",
    lambda s, d: agenda(s, d).select("event_id", "row_id", "place"),
    """SELECT event_id // 4 AS event_id, event_id AS row_id, CAST(row_number() OVER (PARTITION BY event_id // 4
    ORDER BY ts, event_type || ' ' || event_id) AS INT) AS place FROM events""",
)


# --- feature values and their reviews -------------------------------------
def item_values(s, d):
    """A feature value on every other item, with the source it was read from."""
    known = F.col("l_linenumber") % 2 == 0
    return P.table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_partkey").alias("discipline_id"),
        F.lit("math").alias("feature"),
        F.when(known, F.col("l_discount").cast("double")).alias("value"),
        F.when(known, F.lit(0.8)).alias("confidence"),
        F.sha2(F.col("l_returnflag"), 256).alias("source_hash"),
    )


def defaults(s, d):
    k = F.col("p_partkey")
    return P.table(s, d, "part").where(k % 3 != 0).select(
        k.alias("discipline_id"), F.lit("math").alias("feature"), (k % 10 / 10.0).alias("value"), F.lit(0.5).alias("confidence")
    )


P.CTES["ivalues"] = """SELECT l_orderkey * 10 + l_linenumber AS item_id, l_partkey AS discipline_id,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_discount AS DOUBLE) END AS value, l_returnflag AS flag FROM lineitem"""
add(
    "tx3_inherit_defaults",
    lambda s, d: text.inherit_defaults(item_values(s, d), defaults(s, d)).select(
        "item_id", "value", "confidence", "origin"
    ),
    sql(
        """SELECT item_id, CASE WHEN value IS NOT NULL THEN value WHEN discipline_id % 3 <> 0 THEN discipline_id % 10 / 10.0::DOUBLE END AS value,
  CASE WHEN value IS NOT NULL THEN 0.8::DOUBLE WHEN discipline_id % 3 <> 0 THEN 0.5 END AS confidence,
  CASE WHEN value IS NOT NULL THEN 'item' WHEN discipline_id % 3 <> 0 THEN 'discipline' END AS origin FROM ivalues""",
        "ivalues",
    ),
)


def mappings(s, d):
    """Reviews of values, some of them of a source that has changed since."""
    k = F.col("item_id")
    old = F.when(k % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("source_hash"))
    return item_values(s, d).where(k % 4 == 1).select(
        "item_id", "feature", old.alias("source_hash"), (k % 7 / 7.0).alias("value"), pick(
            k, "accepted", "accepted", "rejected"
        ).alias("state")
    ).distinct()


add(
    "tx4_apply_reviewed",
    lambda s, d: text.apply_reviewed(item_values(s, d), mappings(s, d)).select("item_id", "value", "reviewed"),
    sql(
        """WITH x AS (SELECT *, item_id % 4 = 1 AND item_id % 5 <> 0 AND item_id % 3 <> 2 AS reviewed FROM ivalues)
  SELECT item_id, CASE WHEN reviewed THEN item_id % 7 / 7.0::DOUBLE ELSE value END AS value, reviewed FROM x""",
        "ivalues",
    ),
)


def proposals(s, d):
    return P.table(s, d, "orders").select(
        F.col("o_orderkey").alias("proposal_id"), F.sha2(F.col("o_orderstatus"), 256).alias("source_hash")
    )


def reviews(s, d):
    k = F.col("proposal_id")
    old = F.when(k % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("source_hash"))
    return proposals(s, d).where(k % 3 != 0).select(
        "proposal_id", pick(k, "accepted", "rejected").alias("verdict"), old.alias("source_hash")
    )


add(
    "tx5_publish_reviewed",
    lambda s, d: text.publish_reviewed(proposals(s, d), reviews(s, d)).select("proposal_id", "fate"),
    """SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'stale'
    WHEN o_orderkey % 2 = 0 THEN 'published' ELSE 'rejected' END AS fate FROM orders""",
)


def by_type(disciplines):
    """A classifier of one's own: the area that a part's type stands for."""
    area = F.create_map(*[F.lit(x) for kv in P.TYPE_AREA.items() for x in kv])[F.col("p_type")]
    return disciplines.select("discipline_id", F.coalesce(area, F.lit("unknown")).alias("area"))


add(
    "ud2_classify_with",
    lambda s, d: text.classify_with(P.disciplines(s, d), by_type),
    sql(f"SELECT discipline_id, coalesce({P._CASE_AREA}, 'unknown') AS area FROM disciplines", "disciplines"),
)


# --- rules: claims, cycles, what-if, owners -------------------------------
def rule_claims(s, d):
    k = F.col("c_custkey")
    return P.table(s, d, "customer").select(k.alias("rule_id"), F.floor(k / 2).alias("claim_id"))


add(
    "pl5_resolve_for_claims",
    lambda s, d: policy.resolve_for_claims(
        U.effective(s, d), rule_claims(s, d), P.table(s, d, "customer").where("c_acctbal > 0").select(
            F.col("c_custkey").alias("claim_id")
        )
    ).select("request_id", "family_id", "rule_id"),
    sql(
        """SELECT request_id, family_id, rule_id FROM eff JOIN customer ON c_custkey = rule_id
  WHERE rule_id // 2 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
        *U.EFF,
    ),
)


def resolve(s, d, asked, rules):
    states = policy.candidate_states(asked, rules, U.in_scope(s, d))
    return policy.effective_rules(states, U.relations(s, d))


def earlier(s, d):
    """The same requests, asked for a day 400 days before."""
    return U.asked(s, d).withColumn("valid_at", F.col("valid_at") - F.expr("INTERVAL 400 DAYS"))


_CHANGE = """SELECT request_id, family_id, a.rule_id AS was, b.rule_id AS is_now, CASE
    WHEN coalesce(a.state, 'effective') <> 'effective' OR coalesce(b.state, 'effective') <> 'effective' THEN 'ambiguous'
    WHEN a.rule_id IS NULL THEN 'added' WHEN b.rule_id IS NULL THEN 'removed'
    WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS change
  FROM eff a FULL JOIN {after} b USING (request_id, family_id)"""
P.CTES["cand_earlier"] = P.CTES["cand"].replace("INTERVAL 1000 DAY", "INTERVAL 600 DAY")
P.CTES["eff_earlier"] = P.CTES["eff"].replace("FROM cand WHERE", "FROM cand_earlier WHERE")
add(
    "pl6_compare_cycles",
    lambda s, d: policy.compare_cycles(U.asked(s, d), earlier(s, d), lambda asked: resolve(s, d, asked, U.newest(s, d)))
    .groupBy("change").agg(F.count(F.lit(1)).alias("n")),
    sql(
        f"SELECT change, count(*) AS n FROM ({_CHANGE.format(after='eff_earlier')}) GROUP BY 1",
        *U.EFF, "cand_earlier", "eff_earlier",
    ),
)


def raised(s, d):
    """A pending revision of every tenth rule that gives it more authority."""
    rules = U.newest(s, d)
    return rules.where("rule_id % 10 = 4").select(
        *[F.lit(9).cast(
            rules.schema["authority"].dataType
        ).alias(c) if c == "authority" else F.col(c) for c in rules.columns]
    )


P.CTES["cand_raised"] = "SELECT * REPLACE (CASE WHEN rule_id % 10 = 4 THEN 9 ELSE authority END AS authority) FROM cand"
P.CTES["eff_raised"] = P.CTES["eff"].replace("FROM cand WHERE", "FROM cand_raised WHERE")
add(
    "pl11_what_if",
    lambda s, d: policy.what_if(U.newest(s, d), raised(s, d), lambda rules: resolve(s, d, U.asked(s, d), rules))
    .withColumnRenamed("is", "is_now"),
    sql(
        f"SELECT * FROM ({_CHANGE.format(after='eff_raised')}) WHERE change <> 'unchanged'",
        *U.EFF, "cand_raised", "eff_raised",
    ),
)


def owner_rules(s, d, later):
    """Benefit rules at one of two exact revisions, with context and evidence."""
    k = F.col("rule_id")
    r = C.rules(s, d).where(k % 6 != (1 if later else 5))
    level = F.when(F.lit(later) & (k % 4 == 0), F.col("max_level") + 1).otherwise(F.col("max_level"))
    context = F.when(F.lit(later) & (k % 7 == 3), F.lit("other")).otherwise(F.lit("main"))
    return r.select(
        "rule_id", context.alias("context"), F.when(k % 8 != 2, F.concat(F.lit("e"), k)).alias("evidence"),
        level.alias("max_level"), F.when(F.lit(not later) | (k % 3 != 0), F.col("route")).alias("route"), "min_year",
    )


add(
    "pl13_diff_owner_rules",
    lambda s, d: policy.diff_owner_rules(
        owner_rules(s, d, False), owner_rules(s, d, True), ["rule_id"], "context", "evidence"
    )
    .select("rule_id", "status", "path", "before", "after", "change", "truncated"),
    sql(
        """WITH r AS (SELECT * EXCLUDE (status), rule_id % 6 <> 5 AS was, rule_id % 6 <> 1 AS is_now FROM brules WHERE rule_id % 6 <> 5 OR rule_id % 6 <> 1),
  x AS (SELECT *, CASE WHEN NOT was THEN 'missing_before' WHEN NOT is_now THEN 'missing_after' WHEN rule_id % 7 = 3 THEN 'other_context'
    WHEN rule_id % 8 = 2 THEN 'no_evidence' ELSE 'compared' END AS status FROM r),
  d AS (SELECT rule_id, 'max_level' AS path, CAST(max_level AS VARCHAR) AS before, CAST(max_level + 1 AS VARCHAR) AS after, 'changed' AS change
    FROM x WHERE status = 'compared' AND rule_id % 4 = 0
    UNION ALL SELECT rule_id, 'route', route, NULL, 'removed' FROM x WHERE status = 'compared' AND rule_id % 3 = 0)
  SELECT rule_id, status, path, before, after, change, false AS truncated FROM x LEFT JOIN d USING (rule_id)""",
        "brules",
    ),
)


def owned_changes(s, d):
    return P.table(s, d, "orders").select(
        F.col("o_orderstatus").alias("owner"), F.col("o_custkey").alias("object_id"), F.col("o_totalprice").alias("price")
    )


OWNERS = {
    "F": lambda changes: changes.groupBy("object_id").agg(F.count(F.lit(1)).alias("effect")),
    "O": lambda changes: changes.groupBy("object_id").agg(F.count_if(F.col("price") > 100000).alias("effect")),
    "P": lambda changes: changes.select("object_id").distinct().withColumn("effect", F.lit(1).cast("long")),
}
add(
    "ud4_owner_impact",
    lambda s, d: policy.owner_impact(owned_changes(s, d), OWNERS).select("owner", "object_id", "effect"),
    """SELECT o_orderstatus AS owner, o_custkey AS object_id, CASE o_orderstatus WHEN 'F' THEN count(*)
    WHEN 'O' THEN count(*) FILTER (o_totalprice > 100000) ELSE 1 END AS effect
  FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2""",
)


def page_routes(s, d):
    host = F.parse_url("url", F.lit("HOST"))
    return P.table(s, d, "pages").select(host.alias("host"), F.lit("/fr").alias("prefix")).distinct()


add(
    "jn16_resolve_evidence",
    lambda s, d: knowledge.resolve_evidence(
        P.table(s, d, "pages").select(
            F.col("page_id").alias("ref_id"), F.floor(F.col("page_id") / 2).alias("observation_id")
        ),
        P.table(s, d, "pages").select(
            F.col("page_id").alias("observation_id"), F.regexp_replace("url", "^http:", "https:").alias("url")
        ),
        page_routes(s, d),
    ).select("ref_id", "observation_id"),
    r"""SELECT r.page_id AS ref_id, o.page_id AS observation_id FROM pages r JOIN (SELECT page_id, regexp_replace(url, '^http:', 'https:') AS u FROM pages) o
    ON o.page_id = r.page_id // 2 WHERE regexp_full_match(u, 'https://[^/?#@:]+/fr(/[^?#]*)?') AND u NOT LIKE '%/..%'""",
)
add(
    "v6_probe",
    lambda s, d: quality.probe(
        R.measures(s, d), {"curriculum_coverage": 0.8}, {"admission_coverage": 0.5, "taxonomy_coverage": 0.9}
    ),
    sql(
        """SELECT university_id, curriculum_coverage >= 0.8 AS healthy, curriculum_coverage < 0.8 OR admission_coverage < 0.5 OR taxonomy_coverage < 0.9 AS needs_attention,
  list_aggregate(list_filter([CASE WHEN curriculum_coverage < 0.8 THEN 'curriculum_coverage' END, CASE WHEN admission_coverage < 0.5 THEN 'admission_coverage' END,
    CASE WHEN taxonomy_coverage < 0.9 THEN 'taxonomy_coverage' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS problems FROM measures""",
        *R.MEAS,
    ),
)


# --- column functions -----------------------------------------------------
SUBJECTS = (" Математика (профиль) ", "ПРОФИЛЬНАЯ математика", "Информатика и ИКТ", "Физика, ё", "Русский язык")
KEYS = ("математика", "математика", "информатика", "физика е", "русский язык")
CURRENCIES, CURRENCY = ("rur ", " ₽", "usd", "Руб."), ("RUB", "RUB", "USD", "RUB")
FORMS, FORM = ("Очно-заочная", "заочная", "Full-time", "other"), ("part_time", "extramural", "full_time", None)
FUNDS, FUND = ("Бюджет", "по договору", "paid", "?"), ("budget", "paid", "paid", None)
PLACES, PLACE = ("г. Орёл", "город Тверь", " МОСКВА"), ("орел", "тверь", "москва")
MARKS = ("Экзамен", "Зачёт", "Дифф. зачет", "exam + credit", "none")
TYPES = ("exam", "credit", "graded_credit", "exam,credit", "")


def listed(*values) -> str:
    """A list in SQL."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


add(
    "fn4_subject_key",
    lambda s, d: P.table(s, d, "part").select(
        F.col("p_partkey").alias("part_id"),
        fn.subject_key(
            F.concat_ws(
                " ", pick(F.col("p_partkey"), *SUBJECTS), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey"))
            ),
            True
        ).alias("subject"),
        fn.subject_key(pick(F.col("p_partkey"), *SUBJECTS)).alias("plain"),
    ),
    f"""SELECT p_partkey AS part_id, CASE WHEN p_partkey % 2 = 1 THEN {listed(*KEYS)}[p_partkey % 5 + 1]
    ELSE {listed("математика профиль", "профильная математика", "информатика и икт", "физика е", "русский язык")}[p_partkey % 5 + 1] || ' ' || p_partkey END AS subject,
  {listed(*KEYS)}[p_partkey % 5 + 1] AS plain FROM part""",
)
add(
    "fn10_normal_values",
    lambda s, d: P.table(s, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        fn.normalize_currency(pick(F.col("o_orderkey"), *CURRENCIES)).alias("currency"),
        fn.normalize_form(pick(F.col("o_orderkey"), *FORMS)).alias("form"),
        fn.normalize_funding(pick(F.col("o_orderkey"), *FUNDS)).alias("funding"),
        fn.normalize_location(pick(F.col("o_orderkey"), *PLACES)).alias("location"),
    ),
    f"""SELECT o_orderkey AS order_id, {listed(*CURRENCY)}[o_orderkey % 4 + 1] AS currency, {listed(*FORM)}[o_orderkey % 4 + 1] AS form,
  {listed(*FUND)}[o_orderkey % 4 + 1] AS funding, {listed(*PLACE)}[o_orderkey % 3 + 1] AS location FROM orders""",
)
add(
    "fn11_assessment_types",
    lambda s, d: P.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.array_join(
            fn.assessment_types(pick(F.col("l_orderkey") + F.col("l_linenumber"), *MARKS)), ","
        ).alias("types"),
    ),
    f"SELECT l_orderkey AS order_id, l_linenumber AS line, {listed(*TYPES)}[(l_orderkey + l_linenumber) % 5 + 1] AS types FROM lineitem",
)
add(
    "fn12_policy_stage",
    lambda s, d: P.table(s, d, "documents").select("doc_id", fn.policy_stage(F.col("text")).alias("stage")),
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'предполага|возможно|hypothes|might|may be') THEN 'hypothesis'
    WHEN regexp_matches(lower(text), 'проект|предлага|propos|draft') THEN 'proposal'
    WHEN regexp_matches(lower(text), 'утвержд|принят|adopted|approved') THEN 'adopted'
    WHEN regexp_matches(lower(text), 'опубликован|published') THEN 'published' ELSE 'unknown' END AS stage FROM documents""",
)


def valid(s, d):
    k = F.col("o_orderkey")
    year = F.year("o_orderdate")
    result = F.when(k % 9 != 0, year - k % 5)
    low, high = F.when(k % 4 != 0, year - 3), F.when(k % 3 == 0, year - 1)
    age = F.when(k % 2 == 0, F.lit(2))
    return P.table(s, d, "orders").select(k.alias("order_id"), fn.validity(result, year, low, high, age).alias("valid"))


add(
    "fn16_validity",
    valid,
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 > 3 THEN false
    WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 < 1 THEN false WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 > 2 THEN false ELSE true END AS valid FROM orders""",
)
add(
    "fn17_json_field",
    lambda s, d: P.table(s, d, "events").select(
        "event_id", fn.json_field(F.col("props"), "$.k", "int").alias("number"),
        fn.json_field(F.concat(F.lit('{"k": "x'), F.col("event_id"), F.lit('"}')), "$.k", "int").alias("no_number"),
        fn.json_field(F.col("props"), "$.absent", "string").alias("absent"),
    ),
    """SELECT event_id, TRY_CAST(props->>'$.k' AS INT) AS number, CAST(NULL AS INT) AS no_number, CAST(NULL AS VARCHAR) AS absent FROM events""",
)
add(
    "fn19_holdout",
    lambda s, d: P.table(s, d, "documents").groupBy(fn.holdout(F.col("doc_id"), 10).alias("held_out")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")
    ),
    """SELECT CAST('0x' || substr(sha256('17:' || doc_id), 1, 8) AS BIGINT) % 10 = 0 AS held_out, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids
  FROM documents GROUP BY 1""",
)
add(
    "fn1_unicode_names",
    lambda s, d: P.disciplines(s, d).select(
        "discipline_id",
        fn.normalize_name(F.concat(F.lit(" ＡＢＣ Å ﬁ ß  "), F.upper("name")), True).alias("name"),
        fn.classification_name(F.concat(F.lit("Ёлка – "), "name"), True).alias("classified"),
    ),
    sql(
        "SELECT discipline_id, 'abc å fi ss ' || lower(name) AS name, 'елка - ' || lower(name) AS classified FROM disciplines",
        "disciplines"
    ),
)
