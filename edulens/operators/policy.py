"""Bitemporal rules: who applies, which wins, what changed and what it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle, settle_table
from ..functions.scalars import in_interval

RELATIONS = ("overrides", "supersedes", "amends", "exception")
LEAVES, INNER = ("equals", "in", "exists"), ("all", "any")
SCOPE_RANK = {"federal": 0, "university": 1, "direction": 2, "program": 3}


def latest_revision(
    df: DataFrame, key: str, revision: str = "revision", recorded: str | None = None, as_of=None
) -> DataFrame:
    """Newest revision of each key, as known at ``as_of`` if given."""
    if as_of is not None:
        df = df.where(F.col(recorded) <= as_of)
    w = Window.partitionBy(key).orderBy(F.col(revision).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def approval_state(events: DataFrame) -> DataFrame:
    """State of each (rule, revision) from its approval events.

    Sequences must be 1, 2, …, times must grow, the first event must submit,
    and a decision must follow a pending state; anything else is ``invalid``.
    """
    w = Window.partitionBy("rule_id", "revision").orderBy("sequence")
    prev, before = F.lag("kind").over(w), F.lag("recorded_at").over(w)
    e = events.withColumn("_k", prev).withColumn("_t", before).withColumn("_n", F.row_number().over(w))
    legal = (
        (F.col("sequence") == F.col("_n"))
        & (F.col("_t").isNull() | (F.col("_t") < F.col("recorded_at")))
        & F.when(F.col("_n") == 1, F.col("kind") == "submitted")
        .when(F.col("kind").isin("approved", "rejected"), F.col("_k") == "submitted")
        .otherwise(F.col("_k") != "submitted")
    )
    s = e.groupBy("rule_id", "revision").agg(
        F.bool_and(legal).alias("_ok"), F.max_by("kind", "sequence").alias("_last")
    )
    state = (
        F.when(~F.col("_ok"), "invalid").when(F.col("_last") == "submitted", "pending").otherwise(F.col("_last"))
    )
    return s.select("rule_id", "revision", state.alias("state"))


def approved(revisions: DataFrame, events: DataFrame, known_at) -> DataFrame:
    state = approval_state(events.where(F.col("recorded_at") <= known_at)).where("state = 'approved'")
    return latest_revision(
        revisions.where(F.col("recorded_at") <= known_at).join(state, ["rule_id", "revision"]), "rule_id"
    )


def pending_revisions(revisions: DataFrame, events: DataFrame, limit: int = 100) -> DataFrame:
    open_ = approval_state(events).where("state = 'pending'").drop("state")
    return revisions.join(open_, ["rule_id", "revision"]).orderBy("recorded_at", "rule_id", "revision").limit(limit)


def rules_in_force(rules: DataFrame, requests: DataFrame, bucket: str | None = None) -> DataFrame:
    """Rules known and valid for each request: recorded by ``known_at`` and
    valid at ``valid_at``. With ``bucket``, rows of both sides first meet on
    that column (a year, a family), which keeps the range join narrow."""
    on = (F.col("recorded_at") <= F.col("known_at")) & in_interval(
        F.col("valid_at"), F.col("valid_start"), F.col("valid_end")
    )
    if bucket is None:
        return requests.join(rules, on)
    r = rules.withColumnRenamed(bucket, "_b")
    return requests.join(r, (F.col(bucket) == F.col("_b")) & on).drop("_b")


def as_of(
    revisions: DataFrame, requests: DataFrame, keys: list[str], known: str = "known_at", recorded: str = "recorded_at"
) -> DataFrame:
    """The last revision each request could know, by one union and a running
    last value: no row meets more than its own key's history in order."""
    cols = [c for c in revisions.columns if c not in keys]
    left = revisions.select(
        *keys, F.col(recorded).alias("_t"), F.lit(0).alias("_k"), F.struct(*cols).alias("_r"),
        F.lit(None).cast("bigint").alias("request_id")
    )
    right = requests.select(
        *keys, F.col(known).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(left.schema["_r"].dataType).alias("_r"),
        F.col("request_id").cast("bigint")
    )
    order = Window.partitionBy(*keys).orderBy("_t", "_k", F.col("_r.revision"))
    last = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = left.unionByName(right).withColumn("_r", last).where("_k = 1")
    return out.select("request_id", *keys, F.col("_t").alias(known), "_r.*")


def match_scope(rules: DataFrame, context: DataFrame) -> DataFrame:
    """Scope of each rule against each request's context: federal rules match,
    others compare ids; an unknown value is indeterminate (null)."""
    federal = rules.where("scope_level = 'federal'").select("rule_id").join(context.select("request_id").distinct())
    own = rules.where("scope_level <> 'federal'").join(context, rules["scope_level"] == context["field"])
    verdict = F.when(F.col("availability") != "known", F.lit(None)).otherwise(F.col("scope_id") == F.col("value"))
    return federal.select("request_id", "rule_id", F.lit(True).alias("in_scope")).unionByName(
        own.select("request_id", "rule_id", verdict.alias("in_scope"))
    )


def check_kinds(nodes: DataFrame) -> None:
    other = nodes.where(~F.coalesce(F.col("kind").isin(*LEAVES, *INNER), F.lit(False))).select("rule_id", "node_id", "kind").first()
    if other is not None:
        raise ValueError(f"selector node {other.node_id} of rule {other.rule_id} is of unknown kind {other.kind}")


def alike(rows: DataFrame, key: str) -> DataFrame:
    """``(key, like)``: ``like`` is the smallest key with the very same rows."""
    fields = F.array_sort(F.collect_list(F.struct(*sorted(c for c in rows.columns if c != key))))
    own = settle_table(rows.groupBy(key).agg(fields.alias("rows")))
    first = settle_table(own.groupBy("rows").agg(F.min(key).alias("like")))
    return settle_table(own.join(first, "rows").select(key, "like"))


def first_of(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    return rows.join(groups.where(F.col(key) == F.col("like")).select(key), key, "left_semi")


def for_all(verdicts: DataFrame, rules: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdicts on the first rules and requests of their groups, given to all of them.
    A large group of rules is cut into parts, so that no key has all the rows."""
    parts = max(1, 256 // max(1, rules.where("rule_id = like").count()))
    asked = verdicts.withColumnRenamed("request_id", "_q").join(
        requests.select("request_id", F.col("like").alias("_q")), "_q"
    ).withColumnRenamed("rule_id", "_r").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = rules.select("rule_id", F.col("like").alias("_r"), F.pmod(F.xxhash64("rule_id"), F.lit(parts)).cast("int").alias("_part"))
    return asked.join(own, ["_r", "_part"]).select("request_id", "rule_id", *[c for c in verdicts.columns if c not in ("request_id", "rule_id")])


def selector_trace(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """``trace`` of every request and rule, found once for those that are alike."""
    rules, requests = alike(nodes, "rule_id"), alike(context, "request_id")
    traced = trace(first_of(nodes, "rule_id", rules), first_of(context, "request_id", requests))
    return for_all(traced, rules, requests)


def selector_counts(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """``(request_id, node_id, state, reason, rules)``: how many rules of
    ``selector_trace`` say so, without a row for each."""
    rules, requests = alike(nodes, "rule_id"), alike(context, "request_id")
    traced = trace(first_of(nodes, "rule_id", rules), first_of(context, "request_id", requests))
    many = rules.groupBy(F.col("like").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    said = traced.join(many, "rule_id").groupBy("request_id", "node_id", "state", "reason").agg(F.sum("n").alias("rules"))
    asked = requests.select(F.col("request_id").alias("_q"), F.col("like").alias("request_id"))
    return said.join(asked, "request_id").select(F.col("_q").alias("request_id"), "node_id", "state", "reason", "rules")


def trace(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """``(request_id, rule_id, node_id, state, reason)`` of every node: state
    ``match``, ``no_match`` or ``indeterminate``, and why.

    Reasons of leaves: field_unknown, field_unavailable, field_missing (no row
    of the context; an ``exists`` then does not match), value_exists,
    value_matched, value_mismatched; of inner nodes: the state of the children
    that decided, as all_matched, child_mismatched, child_indeterminate,
    any_matched, none_matched. A request's context is one map, a rule's tree one
    array in order of height, so a request and a rule make one row and the tree
    is folded in place. Raises as ``eval_selectors`` does.
    """
    check_kinds(nodes)
    leaf = F.col("kind").isin(*LEAVES)
    height = settle(nodes.select("rule_id", "node_id", "parent_id", F.when(leaf, 0).alias("height")))
    left = height.where("height is null").count()
    level = 0
    while left:
        level += 1
        below = height.where("parent_id is not null").groupBy("rule_id", F.col("parent_id").alias("node_id")).agg(
            F.max("height").alias("top"), F.count_if(F.col("height").isNull()).alias("open")
        ).where("open = 0").drop("open")
        height = settle(height.join(below, ["rule_id", "node_id"], "left").select(
            "rule_id", "node_id", "parent_id", F.coalesce("height", F.when(F.col("top") == level - 1, level)).alias("height")
        ))
        was, left = left, height.where("height is null").count()
        if was == left:
            raise ValueError("selector nodes form a circle or an inner node has no children")
    fields = ["height", "node_id", "parent_id", "kind", "field", "values"]
    own = nodes.join(height.select("rule_id", "node_id", "height"), ["rule_id", "node_id"])
    trees = own.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tree"))
    known = F.map_from_entries(F.collect_list(F.struct("field", F.struct("availability", "value").alias("v"))))
    asked = context.groupBy("request_id").agg(known.alias("context"))

    told = "array<struct<node_id:int,parent_id:int,v:double,reason:string>>"

    def judge(n):
        c = F.col("context")[n["field"]]
        present = c["availability"] == "known"
        value = (
            F.when(c.isNull() & (n["kind"] == "exists"), 0.0).when(~F.coalesce(present, F.lit(False)), 0.5)
            .when((n["kind"] == "exists") | F.array_contains(n["values"], c["value"]), 1.0).otherwise(0.0)
        )
        reason = (
            F.when(c.isNull(), "field_missing").when(c["availability"] == "unavailable", "field_unavailable")
            .when(~F.coalesce(present, F.lit(False)), "field_unknown").when(n["kind"] == "exists", "value_exists")
            .when(value == 1, "value_matched").otherwise("value_mismatched")
        )
        return value, reason

    def fold(done, n):
        value, reason = judge(n)
        children = F.filter(done, lambda d: d["parent_id"] == n["node_id"])
        low, high = (f(F.transform(children, lambda d: d["v"])) for f in (F.array_min, F.array_max))
        every = n["kind"] == "all"
        v = F.when(n["height"] == 0, value).when(every, low).otherwise(high)
        why = (
            F.when(n["height"] == 0, reason)
            .when(v == 0.5, "child_indeterminate")
            .when(every, F.when(v == 1, "all_matched").otherwise("child_mismatched"))
            .otherwise(F.when(v == 1, "any_matched").otherwise("none_matched"))
        )
        one = F.struct(
            n["node_id"].cast("int").alias("node_id"), n["parent_id"].cast("int").alias("parent_id"), v.alias("v"), why.alias("reason")
        )
        return F.array_append(done, one)

    traced = asked.join(trees).select("request_id", "rule_id", F.explode(F.aggregate("tree", F.array().cast(told), fold)).alias("n"))
    state = F.when(F.col("n.v") == 1, "match").when(F.col("n.v") == 0, "no_match").otherwise("indeterminate")
    return traced.select("request_id", "rule_id", "n.node_id", state.alias("state"), "n.reason")


def eval_selectors(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """``selector_values`` of every request and rule, found once for those that are
    alike."""
    rules, requests = alike(nodes, "rule_id"), alike(context, "request_id")
    found = selector_values(first_of(nodes, "rule_id", rules), first_of(context, "request_id", requests))
    return for_all(settle_table(found), rules, requests)


def selector_values(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """Kleene value of each rule's selector tree per request.

    ``nodes(rule_id, node_id, parent_id, kind, field, values)``: leaves equals,
    in, exists; inner all, any. Values are 0, 0.5 (unknown) and 1, so all is a
    minimum and any a maximum. Nodes are folded bottom up, those whose children
    are all folded at once; rounds grow with the height of the highest tree.
    Raises if a rule's nodes run in a circle, or a node is of another kind.
    """
    check_kinds(nodes)
    is_leaf = F.col("kind").isin(*LEAVES)
    leaves = nodes.where(is_leaf)
    requests = context.select("request_id").distinct()
    asked = leaves.join(requests)  # every request asks every leaf
    j = asked.join(context, ["request_id", "field"], "left")
    known = F.col("availability") == "known"
    value = (
        F.when(F.col("kind") == "exists", F.when(F.col("availability").isNull(), 0.0).when(known, 1.0).otherwise(0.5))
        .when(~F.coalesce(known, F.lit(False)), 0.5)
        .when(F.array_contains("values", F.col("value")), 1.0)
        .otherwise(0.0)
    )
    cur = j.select("request_id", "rule_id", "node_id", "parent_id", value.alias("v"))
    # The round in which each inner node can be folded: one after its highest child.
    level = settle(nodes.select("rule_id", "node_id", "parent_id", "kind", F.when(is_leaf, 0).alias("level")))
    inner = level.where("level is null").select("rule_id", "node_id").count()
    height = 0
    while inner:
        height += 1
        child = level.select("rule_id", F.col("parent_id").alias("node_id"), F.col("level").alias("below"))
        ready = child.groupBy("rule_id", "node_id").agg(
            F.max("below").alias("top"), F.count_if(F.col("below").isNull()).alias("open")
        )
        ready = ready.where("open = 0 and node_id is not null").drop("open")
        level = settle(
            level.join(ready, ["rule_id", "node_id"], "left")
            .withColumn("level", F.coalesce("level", F.when(F.col("top") == height - 1, height)))
            .drop("top")
        )
        was, inner = inner, level.where("level is null and kind in ('all', 'any')").count()
        if inner == was:
            raise ValueError("selector nodes form a circle or an inner node has no children")
    up = level.where("level > 0").select(
        "rule_id", F.col("node_id").alias("_id"), F.col("parent_id").alias("_up"), "kind", "level"
    )
    done = cur.where("parent_id is null").select("request_id", "rule_id", "v")
    for h in range(1, height + 1):
        at = up.where(F.col("level") == h)
        on = (cur["rule_id"] == at["rule_id"]) & (cur["parent_id"] == at["_id"])
        folded = (
            cur.join(at, on)
            .groupBy("request_id", cur["rule_id"], "_id", "_up")
            .agg(F.when(F.first("kind") == "all", F.min("v")).otherwise(F.max("v")).alias("v"))
            .select("request_id", "rule_id", F.col("_id").alias("node_id"), F.col("_up").alias("parent_id"), "v")
        )
        used = at.select("rule_id", F.col("_id").alias("parent_id"))
        cur = settle(cur.join(used, ["rule_id", "parent_id"], "left_anti").select(folded.columns).unionByName(folded))
    done = cur.where("parent_id is null") if height else done
    return done.groupBy("request_id", "rule_id").agg(F.min("v").alias("v"))


def candidate_states(
    requests: DataFrame, rules: DataFrame, scopes: DataFrame, selectors: DataFrame | None = None
) -> DataFrame:
    """State of each rule in scope for each request: future, expired,
    not_applicable, indeterminate or candidate."""
    j = scopes.join(requests, "request_id").join(rules, "rule_id")
    if selectors is not None:
        j = j.join(selectors, ["request_id", "rule_id"], "left")
    v = F.col("v") if selectors is not None else F.lit(1.0)
    state = (
        F.when(F.col("in_scope") == F.lit(False), "not_applicable")
        .when(F.col("in_scope").isNull() | F.col("valid_at").isNull(), "indeterminate")
        .when(F.col("valid_start").isNotNull() & (F.col("valid_start") > F.col("valid_at")), "future")
        .when(F.col("valid_end").isNotNull() & (F.col("valid_end") <= F.col("valid_at")), "expired")
        .when(v == 0, "not_applicable")
        .when(v == 0.5, "indeterminate")
        .otherwise("candidate")
    )
    return j.select(
        "request_id", "rule_id", "family_id", "authority", "scope_level", "revision", "content_hash",
        state.alias("state")
    )


def effective_rules(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """The one winner of each (request, family), or why there is none.

    A rule loses to a candidate that relates to it, else to higher authority,
    else to a narrower scope. Losers are found against the best of the family,
    one aggregate, not by comparing all pairs.
    """
    c = candidates.where("state = 'candidate'")
    rank = F.create_map(*[F.lit(x) for kv in SCOPE_RANK.items() for x in kv])[F.col("scope_level")]
    c = c.withColumn("scope_rank", rank)
    beaten = relations.join(
        c.select("request_id", F.col("rule_id").alias("source_rule")), "source_rule"
    ).select("request_id", F.col("target_rule").alias("rule_id")).distinct()
    left = c.join(beaten, ["request_id", "rule_id"], "left_anti")
    own = ["request_id", "family_id"]
    best = left.groupBy(*own).agg(F.max(F.struct("authority", "scope_rank")).alias("b"))
    top = left.join(best, own).where(F.struct("authority", "scope_rank") == F.col("b"))
    won = top.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("rule_id"), F.min("content_hash").alias("content_hash")
    )
    all_ = c.groupBy(*own).agg(F.count(F.lit(1)).alias("candidates"))
    out = all_.join(won, own, "left")
    state = F.when(F.col("n").isNull(), "cycle").when(F.col("n") > 1, "ambiguous").otherwise("effective")
    return out.select(
        *own, "candidates", state.alias("state"), F.when(F.col("n") == 1, F.col("rule_id")).alias("rule_id"),
        F.when(F.col("n") == 1, F.col("content_hash")).alias("content_hash")
    )


def family_pairs(candidates: DataFrame) -> DataFrame:
    """Competing pairs inside the (small) families of each request."""
    a = candidates.select("request_id", "family_id", F.col("rule_id").alias("a"))
    b = candidates.select("request_id", "family_id", F.col("rule_id").alias("b"))
    return a.join(b, ["request_id", "family_id"]).where("a < b")


def resolve_for_claims(effective: DataFrame, rule_claims: DataFrame, claims: DataFrame) -> DataFrame:
    return effective.join(rule_claims.join(claims, "claim_id", "left_semi"), "rule_id", "left_semi")


def changed_selections(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    gone = before.select(*keys).exceptAll(after.select(*keys)).withColumn("side", F.lit("before"))
    return gone.unionByName(after.select(*keys).exceptAll(before.select(*keys)).withColumn("side", F.lit("after")))


def unpivot(df: DataFrame, ids: list[str]) -> DataFrame:
    values = [F.struct(
        F.lit(c).alias("path"), F.col(c).cast("string").alias("value")
    ) for c in sorted(df.columns) if c not in ids]
    return df.select(*ids, F.inline(F.array(*values))).where("value is not null")


def diff_revisions(before: DataFrame, after: DataFrame, ids: list[str]) -> DataFrame:
    """Fields that differ: path with its value before and after."""
    a = unpivot(before, ids).withColumnRenamed("value", "before")
    b = unpivot(after, ids).withColumnRenamed("value", "after")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, [*ids, "path"], "full").where(
        ~F.col("before").eqNullSafe(F.col("after"))
    ).withColumn("change", change)


def diff_owner_rules(
    before: DataFrame, after: DataFrame, ids: list[str], context: str, evidence: str, max_paths: int = 128
) -> DataFrame:
    """Fields of an owner's rule that differ between two exact revisions.

    Only rules that both revisions hold in the same ``context``, with evidence
    in both, are compared; ``status`` says so of every rule, with one row and no
    path where nothing differs or is compared. The first ``max_paths`` paths of
    a rule are given and ``truncated`` marks rules with more.
    """
    side = lambda df, name: df.select(
        *ids,
        F.struct(F.lit(True).alias("there"), context, evidence).alias(name)
    )
    status = (
        F.when(F.col("b").isNull(), "missing_before").when(F.col("a").isNull(), "missing_after")
        .when(~F.col(f"b.{context}").eqNullSafe(F.col(f"a.{context}")), "other_context")
        .when(F.col(f"b.{evidence}").isNull() | F.col(f"a.{evidence}").isNull(), "no_evidence").otherwise("compared")
    )
    seen = side(before, "b").join(side(after, "a"), ids, "full").select(*ids, status.alias("status"))
    fields = [c for c in before.columns if c not in (*ids, context, evidence)]
    same = seen.where("status = 'compared'").select(*ids)
    left, right = (df.select(*ids, *fields).join(same, ids, "left_semi") for df in (before, after))
    own = Window.partitionBy(*ids)
    found = diff_revisions(left, right, ids).withColumn("n", F.row_number().over(own.orderBy("path")))
    found = found.withColumn(
        "truncated", F.count(F.lit(1)).over(own) > max_paths
    ).where(F.col("n") <= max_paths).drop("n")
    return seen.join(found, ids, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def diff_effective(before: DataFrame, after: DataFrame) -> DataFrame:
    """Effective rules of two sets side by side per (request, family)."""
    keys = ["request_id", "family_id"]
    a = before.select(
        *keys, F.col("rule_id").alias("was"), F.col("content_hash").alias("was_hash"), F.col("state").alias("was_state")
    )
    b = after.select(
        *keys, F.col("rule_id").alias("is"), F.col("content_hash").alias("is_hash"), F.col("state").alias("is_state")
    )
    sure = (
        F.coalesce("was_state", F.lit("effective")) == "effective"
    ) & (F.coalesce("is_state", F.lit("effective")) == "effective")
    change = (
        F.when(~sure, "ambiguous").when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when(F.col("was_hash") != F.col("is_hash"), "changed").otherwise("unchanged")
    )
    return a.join(b, keys, "full").select(*keys, "was", "is", change.alias("change"))


def traverse(edges: DataFrame, roots: DataFrame, depth: int = 8, max_nodes: int | None = None) -> DataFrame:
    """Nodes reachable from each root within ``depth`` steps, at their least
    depth; ``truncated`` marks nodes at the limit that lead on.

    Frontiers are joined with the edges and visited nodes leave by an anti-join;
    each frontier is written, so the plan does not grow with the depth. With
    ``max_nodes`` a root keeps that many nodes, nearest and smallest first, and
    is marked truncated as a whole if it has more.
    """
    front = settle(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    levels = [front]
    step = edges.select(F.col("source").alias("node"), F.col("target"))
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("root", "node")
        nxt = front.join(step, "node").select("root", F.col("target").alias("node")).distinct()
        front = settle(nxt.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        levels.append(front)
    leads = step.select("node").distinct().withColumn("_more", F.lit(True))
    out = reduce(DataFrame.unionByName, levels).join(leads, "node", "left")
    out = out.withColumn("truncated", (F.col("depth") == depth) & F.coalesce("_more", F.lit(False))).drop("_more")
    if max_nodes is None:
        return out
    order = Window.partitionBy("root").orderBy("depth", "node")
    more = F.count(F.lit(1)).over(Window.partitionBy("root")) > max_nodes
    out = out.withColumn("_n", F.row_number().over(order)).withColumn("truncated", F.col("truncated") | more)
    return out.where(F.col("_n") <= max_nodes).drop("_n")


def follow_chains(step: DataFrame, node: str, target: str, max_rounds: int = 60) -> DataFrame:
    """The end of each node's chain in ``step``, which has one target a node, and
    the steps to it; ``cyclic`` where the chain never ends.

    Pointers double until the number of open chains no longer falls. An open
    chain that does end has nodes at every distance from its end, so some close
    in each round; what stays open has no end.
    """
    cur = settle(step.select(F.col(node).alias("node"), F.col(target).alias("target"), F.lit(1).alias("steps")))
    heads, before = cur.select(F.col("node").alias("_h")), None
    for _ in range(max_rounds):
        ended = cur.join(
            heads, cur["target"] == heads["_h"], "left"
        ).withColumn("cyclic", F.col("_h").isNotNull()).drop("_h")
        left = ended.where("cyclic").count()
        if left in (0, before):
            return ended
        before = left
        nxt = cur.select(F.col("node").alias("_n"), F.col("target").alias("_t"), F.col("steps").alias("_s"))
        cur = settle(cur.join(nxt, cur["target"] == nxt["_n"], "left").select(
            "node", F.coalesce("_t", "target").alias("target"), (
                F.col("steps") + F.coalesce("_s", F.lit(0))
            ).alias("steps")
        ))
    raise RuntimeError("chains did not settle")


def cyclic_nodes(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes on or behind a cycle: what is left when no node without an outgoing
    edge to a node that is left can be taken away any more.

    Each round first lets edges skip chains of nodes with a single target, so
    rounds grow with the number of branchings on a path, not with its length.
    """
    cur = settle(edges.select("source", "target").where("target is not null").distinct())
    before = None
    for _ in range(max_rounds):
        single = cur.groupBy("source").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1")
        ends = follow_chains(single, "source", "target").where("not cyclic").select(
            F.col("node").alias("_n"), F.col("target").alias("_e")
        )
        cut = cur.join(ends, cur["target"] == ends["_n"], "left").select(
            "source", F.coalesce("_e", "target").alias("target")
        ).distinct()
        alive = cut.select(F.col("source").alias("_s")).distinct()
        cur = settle(cut.join(alive, cut["target"] == alive["_s"], "left_semi"))
        now = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("source", "target"))).first()
        if now == before or not now[0]:
            return cur.select(F.col("source").alias("node")).distinct()
        before = now
    raise RuntimeError("cycles did not settle")


def impact(changed: DataFrame, edges: DataFrame, objects: DataFrame, depth: int = 8) -> DataFrame:
    """Objects that a change reaches, with the least distance and the highest
    actionability of the changes that reach them."""
    reach = traverse(edges, changed.select(F.col("rule_id").alias("root")).distinct(), depth)
    j = reach.join(changed.select(F.col("rule_id").alias("root"), "rank"), "root").join(objects, "node")
    return j.groupBy("node", "kind").agg(
        F.min("depth").alias("distance"), F.max("rank").alias("rank"), F.count_distinct("root").alias("changes")
    )


def dirty_targets(affected: DataFrame, kinds: DataFrame) -> DataFrame:
    """Projection kinds to rebuild for each affected node."""
    return affected.join(kinds, "kind").select("node", "projection").distinct()


def what_if(rules: DataFrame, candidate: DataFrame, resolve) -> DataFrame:
    """Effect of one more revision: ``resolve`` gives the effective rules of a
    rule table; nothing is written."""
    over = rules.join(candidate.select("rule_id"), "rule_id", "left_anti").unionByName(candidate)
    return diff_effective(resolve(rules), resolve(over)).where("change <> 'unchanged'")


def compare_cycles(requests_a: DataFrame, requests_b: DataFrame, resolve) -> DataFrame:
    return diff_effective(resolve(requests_a), resolve(requests_b))


def owner_impact(changes: DataFrame, owners: dict) -> DataFrame:
    """Each owner's own function on its changes, in one table."""
    parts = [
        f(changes.where(F.col("owner") == name)).withColumn("owner", F.lit(name)) for name, f in sorted(owners.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_relations(relations: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations that break a rule: another family, less authority than what
    they override, an exception that is not narrower."""
    r = rules.select("rule_id", "family_id", "authority", "scope_level")
    a = r.select(*[F.col(c).alias(f"a_{c}") for c in r.columns])
    b = r.select(*[F.col(c).alias(f"b_{c}") for c in r.columns])
    rank = lambda c: F.create_map(*[F.lit(x) for kv in SCOPE_RANK.items() for x in kv])[F.col(c)]
    j = relations.join(
        a, F.col("source_rule") == F.col("a_rule_id")
    ).join(b, F.col("target_rule") == F.col("b_rule_id"))
    problem = (
        F.when(F.col("a_family_id") != F.col("b_family_id"), "other_family")
        .when(F.col("a_authority") < F.col("b_authority"), "less_authority")
        .when((F.col("kind") == "exception") & (rank("a_scope_level") <= rank("b_scope_level")), "not_narrower")
    )
    return j.withColumn("problem", problem).where("problem is not null").select(
        "source_rule", "kind", "target_rule", "problem"
    )


def overlap(participants: DataFrame) -> DataFrame:
    """Common interval of the participants of each conflict, and whether it is
    real; open bounds are null."""
    low, high = F.lit("0001-01-01").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")
    return participants.groupBy("conflict_id").agg(
        F.max(
            F.coalesce("valid_start", low)
        ).alias("start"), F.min(F.coalesce("valid_end", high)).alias("end"), F.count(F.lit(1)).alias("participants")
    ).withColumn("overlaps", F.col("start") < F.col("end"))


def scope_column(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SCOPE_RANK.items() for x in kv])[level]
