"""Classification, extraction, resolution and parsing of texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_name, query_tokens

BAND = 0.05
CLAIM_MIN, CLAIM_MAX, CLAIMS_PER_DOCUMENT = 32, 4000, 100


def classify_areas(
    disciplines: DataFrame, overrides: DataFrame, aliases: DataFrame, rules: DataFrame,
    default: str = "universal_interdisciplinary"
) -> DataFrame:
    """Area per name: exact override, override of an alias, else the first
    keyword rule, else the default as unresolved. Names are classified once;
    rules are a fixed list of a few dozen rows."""
    names = disciplines.select(normalize_name(F.col("name")).alias("key")).distinct()
    exact = overrides.select(F.col("name").alias("key"), F.col("area").alias("exact_area"))
    via = aliases.join(overrides, aliases["target"] == overrides["name"]).select(
        F.col("alias").alias("key"), F.col("area").alias("alias_area")
    )
    hit = names.join(F.broadcast(rules), F.expr("contains(key, keyword)")).groupBy("key").agg(
        F.min_by("area", "rule").alias("rule_area"), F.min("rule").alias("rule")
    )
    j = names.join(exact, "key", "left").join(via, "key", "left").join(hit, "key", "left")
    method = F.when(
        F.col("exact_area").isNotNull(), "override"
    ).when(F.col("alias_area").isNotNull(), "alias").when(
        F.col("rule_area").isNotNull(), "keyword"
    ).otherwise("unresolved")
    area = F.coalesce("exact_area", "alias_area", "rule_area", F.lit(default))
    found = j.select(
        "key", area.alias("area"), method.alias("method"), F.when(method == "keyword", F.col("rule")).alias("rule")
    )
    return disciplines.withColumn("key", normalize_name(F.col("name"))).join(found, "key").drop("key")


def classify_with(
    df: DataFrame, classifier: DataFrame | Callable[[DataFrame], DataFrame], **tables: DataFrame
) -> DataFrame:
    """A replaceable classifier: a rules table, or a function of the frame."""
    return classifier(df) if callable(classifier) else classify_areas(df, rules=classifier, **tables)


def inherit_defaults(items: DataFrame, defaults: DataFrame) -> DataFrame:
    """Item feature values, with the discipline's where the item's is unknown."""
    d = defaults.select("discipline_id", "feature", F.col("value").alias("_v"), F.col("confidence").alias("_c"))
    j = items.join(d, ["discipline_id", "feature"], "left")
    own = F.col("value").isNotNull()
    return j.select(
        *[c for c in items.columns if c not in ("value", "confidence")],
        F.when(own, F.col("value")).otherwise(F.col("_v")).alias("value"),
        F.when(own, F.col("confidence")).otherwise(F.col("_c")).alias("confidence"),
        F.when(own, "item").when(F.col("_v").isNotNull(), "discipline").alias("origin"),
    )


def apply_reviewed(values: DataFrame, mappings: DataFrame) -> DataFrame:
    """Accepted review values for the same item, feature and source hash."""
    m = mappings.where("state = 'accepted'").select("item_id", "feature", "source_hash", F.col("value").alias("_r"))
    j = values.join(m, ["item_id", "feature", "source_hash"], "left")
    return j.withColumn("value", F.coalesce("_r", "value")).withColumn("reviewed", F.col("_r").isNotNull()).drop("_r")


def publish_reviewed(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposals with their fate: published, rejected, stale (the source has
    changed since), or pending."""
    j = proposals.join(
        reviews.select("proposal_id", "verdict", F.col("source_hash").alias("_hash")), "proposal_id", "left"
    )
    fate = F.when(F.col("verdict").isNull(), "pending").when(
        F.col("_hash") != F.col("source_hash"), "stale"
    ).when(F.col("verdict") == "accepted", "published").otherwise("rejected")
    return j.withColumn("fate", fate).drop("_hash")


def extract_claims(documents: DataFrame, pattern: str, limit: int = CLAIMS_PER_DOCUMENT) -> DataFrame:
    """Lines that match ``pattern``, with offset and page, once per document.

    Length is held to [CLAIM_MIN, CLAIM_MAX]; the first ``limit`` of a document
    are its claims. Pages are counted by form feeds. Of a line that does not
    match only the lengths go on; offsets are running sums of them, so the work
    is linear in a document's length.
    """
    def facts(x):
        claim = F.trim(x)
        fits = F.length(claim).between(CLAIM_MIN, CLAIM_MAX) & claim.rlike(pattern)
        feeds = F.size(F.split(x, "\f", -1)) - 1
        return F.struct((F.length(x) + 1).alias("size"), feeds.alias("feeds"), F.when(fits, claim).alias("claim"))

    lines = F.transform(F.split("text", "\n", -1), facts)
    df = documents.where(F.col("text").isNotNull()).select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), lines.alias("lines")
    )
    df = df.select("doc_id", "_row", F.posexplode("lines").alias("line", "l"))
    before = Window.partitionBy("_row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select("doc_id", "_row", "line", "l.*").withColumns(
        {
            "start": F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int"),
            "page": (F.coalesce(F.sum("feeds").over(before), F.lit(0)) + 1).cast("int"),
        }
    )
    kept = placed.where("claim is not null").select("doc_id", "line", "claim", "start", "page")
    digest = F.sha2(F.lower("claim"), 256)
    w = Window.partitionBy("doc_id", "digest").orderBy("line")
    n = Window.partitionBy("doc_id").orderBy("line")
    first = kept.withColumn("digest", digest).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(n)).where(F.col("place") <= limit)


def match_disciplines(names: DataFrame, disciplines: DataFrame) -> DataFrame:
    """Exact identity by normalised name: matched, ambiguous or new."""
    known = disciplines.groupBy(normalize_name(F.col("name")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("discipline_id").alias("only")
    )
    j = names.withColumn("key", normalize_name(F.col("name"))).join(known, "key", "left")
    state = F.when(F.col("n").isNull(), "new").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return j.withColumn("state", state).withColumn(
        "discipline_id", F.when(F.col("n") == 1, F.col("only"))
    ).drop("key", "n", "only")


def resolve_entities(queries: DataFrame, entities: DataFrame, aliases: DataFrame, limit: int = 5) -> DataFrame:
    """Candidates of every query: id or code 1.0, name .95, alias .90, all
    query tokens in the name .70; ranked, with the query's status.

    Equi-joins per kind; token subsets go through an inverted index. A context
    ``university_id`` on the query narrows where it is set.
    """
    q = queries.select(
        "query_id", F.col("university_id").alias("_u"), normalize_name(F.col("query")).alias("key"),
        query_tokens(F.col("query")).alias("tokens")
    )
    e = entities.select(
        "entity_id", "university_id", F.lower("code").alias("code"), normalize_name(F.col("name")).alias("name")
    )
    ids = e.select(
        "entity_id", "university_id", F.col("entity_id").cast("string").alias("key"), F.lit(1.0).alias("score")
    )
    exact = (
        ids.unionByName(e.select("entity_id", "university_id", F.col("code").alias("key"), F.lit(1.0).alias("score")))
        .unionByName(e.select("entity_id", "university_id", F.col("name").alias("key"), F.lit(0.95).alias("score")))
        .unionByName(
            aliases.join(e, "entity_id").select(
                "entity_id", "university_id", normalize_name(F.col("alias")).alias("key"), F.lit(0.9).alias("score")
            )
        )
    )
    a = q.join(exact, "key").select("query_id", "_u", "entity_id", "university_id", "score")
    b = holders(q, e.select("entity_id", "university_id", query_tokens(F.col("name")).alias("own")))
    found = a.unionByName(b.select("query_id", "_u", "entity_id", "university_id", F.lit(0.7).alias("score")))
    found = found.where(
        "_u is null or _u = university_id"
    ).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    return rank_matches(queries.select("query_id"), found, limit)


def holders(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``(query_id, _u, entity_id, university_id)`` of entities ``(entity_id,
    university_id, own)`` that hold all ``tokens`` of a query.

    Tokens are ordered by how many entities hold them. A query is joined on its
    rarest token only and the others are looked up in the entity's own list, so
    a token that every name has makes no rows beside a rarer one. A query
    without tokens, or with one that no entity has, is held by none.
    """
    index = entities.select("entity_id", "university_id", "own", F.explode("own").alias("token"))
    held = index.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    asked = queries.select("query_id", "_u", "tokens", F.explode("tokens").alias("token")).join(held, "token", "left")
    rarest = asked.groupBy("query_id", "_u", "tokens").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")).alias("r")
    ).where("r.held > 0")
    found = rarest.select("query_id", "_u", "tokens", "r.token").join(index, "token")
    found = found.where(F.size(F.array_except("tokens", "own")) == 0)
    return found.select("query_id", "_u", "entity_id", "university_id").distinct()


def rank_matches(queries: DataFrame, found: DataFrame, limit: int = 5, band: float = BAND) -> DataFrame:
    """Best candidates of each query; ambiguous if another is within ``band``."""
    own = Window.partitionBy("query_id")
    w = own.orderBy(F.col("score").desc(), "entity_id")
    best = F.max("score").over(own)
    near = F.count_if(F.round(F.col("score"), 6) >= F.round(F.col("best") - band, 6)).over(own)
    r = found.withColumn("best", best).withColumn("near", near).withColumn(
        "place", F.row_number().over(w)
    ).where(F.col("place") <= limit)
    j = queries.join(r, "query_id", "left")
    state = F.when(
        F.col("best").isNull(), "not_found"
    ).when(F.col("near") > 1, "ambiguous").when(F.col("best") == 1.0, "exact").otherwise("resolved")
    return j.select("query_id", "entity_id", "score", "place", state.alias("status"))


def narrow_by_tokens(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the most query tokens in their name; score .70 + best/terms/10."""
    qt = queries.select(
        "query_id", F.size(query_tokens(F.col("query"))).alias("terms"),
        F.explode(query_tokens(F.col("query"))).alias("token")
    )
    ct = candidates.select("entity_id", F.explode(query_tokens(F.col("name"))).alias("token"))
    hits = qt.join(ct, "token").groupBy("query_id", "terms", "entity_id").agg(F.count(F.lit(1)).alias("overlap"))
    best = hits.withColumn("best", F.max("overlap").over(Window.partitionBy("query_id"))).where("overlap = best")
    return best.select(
        "query_id", "entity_id", "overlap",
        F.round(0.7 + F.col("best") / F.col("terms") / 10, 6).alias("score")
    )


def candidate_hash(candidates: DataFrame) -> DataFrame:
    line = F.concat_ws("|", F.col("entity_id").cast("string"), "name", "code")
    return candidates.groupBy("query_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("candidates_sha256"),
        F.count(F.lit(1)).alias("n")
    )


def resolve_large(candidates: DataFrame, chooser: Callable[[pd.DataFrame], int | None], above: int = 50) -> DataFrame:
    """A user function picks one entity of each large candidate set. The set is
    bounded by the ranking before it. A failure or a pick outside the set is
    ambiguous."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = set(pdf["entity_id"])
        if len(pdf) <= above:
            pick, state = None, "small"
        else:
            try:
                pick = chooser(pdf.sort_values("entity_id"))
            except Exception:
                pick = None
            state = "resolved" if pick in ids else "ambiguous"
        chosen = pick if state == "resolved" else None
        return pd.DataFrame(
            {"query_id": [pdf["query_id"].iloc[0]], "entity_id": pd.array([chosen], dtype="Int64"), "status": [state]}
        )

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, entity_id long, status string")


def parse_questions(messages: DataFrame) -> DataFrame:
    """Slots of each message: intent, year, total score, semester, form, funding."""
    t = F.lower("text")
    intent = (
        F.when(t.rlike(r"сравн|compare|versus"), "compare")
        .when(t.rlike(r"поступ|балл|admission|score"), "admission_fit")
        .when(t.rlike(r"посовет|рекоменд|recommend|suggest"), "recommend")
        .when(t.rlike(r"сколько|доля|share|how many|average"), "metric")
        .otherwise("unknown")
    )
    pick = lambda rx: F.regexp_extract(t, rx, 1).try_cast("int")
    return messages.select(
        "conv_id", "turn", intent.alias("intent"),
        pick(r"\b(20[0-9]{2})\b").alias("year"),
        pick(r"([0-9]{2,3})\s*(?:балл|points)").alias("total_score"),
        pick(r"([0-9]{1,2})\s*(?:семестр|semester)").alias("semester"),
        F.when(t.rlike("заочн|distance"), "extramural").when(t.rlike("очн|full.?time"), "full_time").alias("form"),
        F.when(t.rlike("бюджет|budget"), "budget").when(t.rlike("платн|paid"), "paid").alias("funding"),
        F.size(F.split(t, r"\s+")).alias("n_words"),
    )


def session_state(turns: DataFrame, key: str, order: str, slots: list[str], entities: str | None = None) -> DataFrame:
    """State after each turn: newest non-null slots, entities in order of first
    mention, and a revision that grows only when a slot changes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(key).orderBy(order)
    out = turns.withColumns({f"s_{c}": F.last(c, ignorenulls=True).over(w) for c in slots})
    if entities:
        out = out.withColumn("entities", F.array_distinct(F.flatten(F.collect_list(entities).over(w))))
    state = F.struct(*[f"s_{c}" for c in slots])
    changed = F.when(F.lag(state).over(step).isNull(), 1).otherwise(
        (~state.eqNullSafe(F.lag(state).over(step))).cast("int")
    )
    out = out.withColumn("_c", changed).withColumn("revision", F.sum("_c").over(w)).drop("_c")
    missing = F.array_compact(F.array(*[F.when(F.col(f"s_{c}").isNull(), c) for c in slots]))
    return out.withColumn("missing", F.array_join(missing, ","))
