"""Our schemas over the driver's tables, in Spark and, as CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which area a part's type stands for, and how its brand splits the rest.
TYPE_AREA = {
    "ECONOMY": "economics_finance",
    "LARGE": "engineering_technology",
    "MEDIUM": "medicine_health",
    "PROMO": "business_management",
    "SMALL": "biology_biotechnology",
    "STANDARD": "mathematics_statistics",
}
#: (keyword in a discipline's name, feature, value, confidence).
KEYWORD_RULES = (
    ("widget", "math", 0.9, 0.95),
    ("gear", "mechanics", 0.8, 0.9),
    ("ring", "math", 0.4, 0.7),
    ("gizmo", "software", 0.7, 0.85),
    ("red", "software", 0.2, 0.6),
)
EVENT_NAMES = {
    "view": "session_started",
    "signup": "program_added",
    "click": "comparison_started",
    "error": "comparison_completed",
    "purchase": "final_choice",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def programs(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("program_id"),
        F.col("s_nationkey").alias("direction_id"),
        F.col("n_regionkey").alias("university_id"),
        F.col("s_name").alias("code"),
        F.col("s_acctbal").alias("balance"),
    )


def items(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("program_id"),
        F.col("l_partkey").alias("discipline_id"),
        F.expr("CASE WHEN l_linenumber <> 6 THEN 1 + (month(l_shipdate) - 1) % 8 END").alias("semester"),
        F.col("l_quantity").cast("int").alias("hours"),
        F.expr("CASE WHEN l_linenumber <> 7 THEN CAST(round(l_tax * 100) AS INT) END").alias("credits"),
        F.col("l_returnflag").alias("assessment"),
        F.col("l_linenumber").alias("position"),
        F.col("l_orderkey").alias("source_row"),
        F.col("l_shipdate").alias("captured_at"),
    )


def disciplines(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("discipline_id"), F.col("p_name").alias("name"), "p_type", "p_brand"
    )


def area_weights(spark, d) -> DataFrame:
    main = F.create_map(*[F.lit(x) for kv in TYPE_AREA.items() for x in kv])[F.col("p_type")]
    even = F.substring_index("p_brand", "#", -1).cast("int") % 2 == 0
    second = F.when(even, "computer_science_data").otherwise("physics_astronomy")
    both = F.array(
        F.struct(main.alias("area"), F.lit(0.7).alias("weight")),
        F.struct(second.alias("area"), F.lit(0.3).alias("weight")),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("discipline_id"), F.inline(both))


def keyword_rules(spark) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(KEYWORD_RULES)]
    return spark.createDataFrame(rows, "rule int, keyword string, feature string, value double, confidence double")


def offerings(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("offering_id"),
        (F.col("o_custkey") % 50).alias("program_id"),
        F.year("o_orderdate").alias("admission_year"),
        F.col("o_orderpriority").alias("study_form"),
        F.col("o_orderstatus").alias("funding_type"),
        F.col("o_totalprice").alias("tuition"),
        F.when(F.col("o_orderkey") % 3 != 0, F.round(F.col("o_totalprice") / 2000)).alias("cutoff"),
    )


def exams(spark, d) -> DataFrame:
    """One mandatory exam per offering and subject."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("offering_id"), (F.col("l_partkey") % 11).alias("subject"))
        .agg(F.max(F.col("l_quantity") + 20).alias("minimum_score"))
        .withColumn("minimum_score", F.when(F.col("subject") != 10, F.col("minimum_score")))
    )


def applicants(spark, d) -> DataFrame:
    """Scores of every customer: subjects 0..8, those divisible by c+s lack."""
    return (
        table(spark, d, "customer")
        .select(F.col("c_custkey").alias("applicant_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("s"))
        .where("(applicant_id + s) % 13 <> 0")
        .select(
            "applicant_id",
            F.col("s").cast("long").alias("subject"),
            (F.lit(30) + (F.col("applicant_id") * 7 + F.col("s") * 11) % 71).cast("double").alias("score"),
        )
    )


def decision_events(spark, d) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])
    return table(spark, d, "events").select(
        F.col("user_id").alias("owner_key"),
        "event_id",
        names[F.col("event_type")].alias("event_type"),
        F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"),
    )


_CASE_AREA = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_AREA.items()) + " END"
_CASE_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"

CTES = {
    "programs": """SELECT s_suppkey AS program_id, s_nationkey AS direction_id, n_regionkey AS university_id,
  s_name AS code, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "items": """SELECT l_suppkey AS program_id, l_partkey AS discipline_id,
  CASE WHEN l_linenumber <> 6 THEN CAST(1 + (month(l_shipdate) - 1) % 8 AS INT) END AS semester,
  CAST(l_quantity AS INT) AS hours, CASE WHEN l_linenumber <> 7 THEN CAST(round(l_tax * 100) AS INT) END AS credits,
  l_returnflag AS assessment, l_linenumber AS position, l_orderkey AS source_row, l_shipdate AS captured_at
  FROM lineitem""",
    "disciplines": "SELECT p_partkey AS discipline_id, p_name AS name, p_type, p_brand FROM part",
    "area_weights": f"""SELECT p_partkey AS discipline_id, {_CASE_AREA} AS area, 0.7::DOUBLE AS weight FROM part
  UNION ALL SELECT p_partkey, CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 2 = 0
  THEN 'computer_science_data' ELSE 'physics_astronomy' END, 0.3::DOUBLE FROM part""",
    "rules": "SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{a}', '{b}', {c}::DOUBLE, {e}::DOUBLE)" for k, (a, b, c, e) in enumerate(KEYWORD_RULES))
    + ") AS t(rule, keyword, feature, value, confidence)",
    "offerings": """SELECT o_orderkey AS offering_id, o_custkey % 50 AS program_id,
  CAST(year(o_orderdate) AS INT) AS admission_year, o_orderpriority AS study_form, o_orderstatus AS funding_type,
  o_totalprice AS tuition, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / 2000) END AS cutoff FROM orders""",
    "exams": """SELECT l_orderkey AS offering_id, l_partkey % 11 AS subject,
  CASE WHEN l_partkey % 11 <> 10 THEN max(l_quantity + 20) END AS minimum_score FROM lineitem
  GROUP BY l_orderkey, l_partkey % 11""",
    "applicants": """SELECT c_custkey AS applicant_id, CAST(s AS BIGINT) AS subject,
  CAST(30 + (c_custkey * 7 + s * 11) % 71 AS DOUBLE) AS score FROM customer, range(0, 9) AS r(s)
  WHERE (c_custkey + s) % 13 <> 0""",
    "decisions": f"""SELECT user_id AS owner_key, event_id, {_CASE_EVENT} AS event_type, props AS payload,
  ts AS occurred_at, ts + INTERVAL 20 DAY AS expires_at FROM events""",
}


def settle(text: str) -> str:
    """Round to 9 places before rounding to 4 or 6, as ``settled`` does."""
    out, at = "", 0
    while (k := text.find("round(", at)) >= 0:
        depth, j = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        inner = settle(text[k + 6 : j - 1])
        head, _, places = inner.rpartition(",")
        if places.strip() in ("4", "6") and not head.startswith("round("):
            inner = f"round({head}, 9) + 1e-11,{places}"
        out += text[at:k] + f"round({inner})"
        at = j
    return out + text[at:]


def sql(body: str, *names: str) -> str:
    """``body`` after the named CTEs; a body that starts with WITH goes on."""
    return settle(_with(body, *names))


def _with(body: str, *names: str) -> str:
    with_ = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {with_},\n{body[5:]}" if with_ else body
    return f"WITH {with_}\n{body}" if with_ else body


def recursive(body: str, *names: str) -> str:
    """``body``, further CTEs of which some refer to themselves, after the named CTEs."""
    return sql("WITH " + body, *names).replace("WITH", "WITH RECURSIVE", 1)
