"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans; a candidate value is then looked up across the
corpus by the distinct owners and repositories that hold it. A value that many
owners share, or that one owner has in many repositories, is a copied example;
one that stays with few of both and looks like a key is live-looking and adds a
span of its own.

Scale: texts are scanned once in place. What is shuffled are the matches, once
per distinct text, with values as hashes. Places come from running sums of the
lengths between matches, per text and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import replace_text, shared_checkpoint, table

VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE}+)"""
VENDOR = (
    r"gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
#: (kind, pattern, group of the value, least length of the value), in order.
#: Runs of one class that are long enough are found as such: a match starts at
#: the first place of its run, so shorter ones hide none. A short assignment
#: does hide what it covers, so it is matched and then dropped.
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("vendor", VENDOR, 0, 1),
)
#: The same texts, found with less work: runs long enough to pass.
SOME = "|".join((r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", VENDOR, ASSIGN))
PLACEHOLDER = r"(?i)example|changeme|your|dummy|sample|placeholder|x{4,}|\*{3,}"
MAX_OWNERS = 2
#: Distinct repositories of one owner; a key in use is seen in a handful.
MAX_REPOSITORIES = 4
LIVE_LENGTH, LIVE_CHARS = 16, 8
LIVE = len(KINDS)


def has_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(SOME), F.lit(False))


def looks_live(value: Column) -> Column:
    """Long enough, varied enough and no placeholder."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS
    return (F.length(value) >= LIVE_LENGTH) & varied & ~value.rlike(PLACEHOLDER)


def _matched(k: int):
    return lambda z: z[f"m{k}"].isNotNull()


def _facts(k: int, least: int):
    """What is kept of match i: ``gap`` is the length of the text before it."""

    def facts(z: Column, i: Column) -> Column:
        value = z[f"v{k}"]
        return F.struct(
            F.lit(k).alias("kind"),
            i.alias("idx"),
            F.length(z[f"p{k}"]).alias("gap"),
            F.length(z[f"m{k}"]).alias("size"),
            F.length(value).alias("value_size"),
            (F.length(value) >= least).alias("passes"),
            F.sha2(value, 256).alias("value"),
            looks_live(value).alias("live_look"),
        )

    return facts


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row per match, distinct text, owner and repository."""
    df = docs.where(has_candidate(F.col("text"))).select(
        F.sha2("text", 256).alias("digest"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        "text",
    )
    found = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        df = df.withColumns(
            {
                f"m{k}": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
                f"v{k}": F.regexp_extract_all("text", F.lit(pattern), F.lit(group)),
                f"p{k}": F.split("text", pattern, -1),
            }
        )
        found.append(F.transform(F.filter(F.arrays_zip(f"m{k}", f"v{k}", f"p{k}"), _matched(k)), _facts(k, least)))
    return df.select("digest", "owner", "repository", F.explode(F.concat(*found)).alias("c")).select(
        "digest", "owner", "repository", "c.*"
    )


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``(digest, kind, start, end, copied, live)`` of every passing span of
    every distinct text; ``kind`` indexes KINDS, start and end are code points.

    A value is ``copied`` when more than MAX_OWNERS owners hold it, or one owner
    in more than MAX_REPOSITORIES distinct repositories. ``live`` spans, kind
    LIVE, cover the value alone. A null owner counts as one owner.
    """
    hits = shared_checkpoint(candidates(docs, owner, repository).distinct())
    owned = hits.where("passes").select("value", F.coalesce("owner", F.lit("")).alias("owner"), "repository")
    freq = (
        owned.groupBy("value", "owner")
        .agg(F.count_distinct("repository").alias("n"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("owners"), F.max("n").alias("repositories"))
    )
    once = hits.groupBy("digest", "kind", "idx").agg(
        *[F.first(c).alias(c) for c in ("gap", "size", "value_size", "passes", "value", "live_look")]
    )
    run = Window.partitionBy("digest", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).where("passes")
    # Written first, so that AQE can split the places of a value that is everywhere.
    placed = placed.withColumn("start", F.col("end") - F.col("size")).join(shared_checkpoint(freq), "value")
    copied = (F.col("owners") > MAX_OWNERS) | (F.col("repositories") > MAX_REPOSITORIES)
    live = ~copied & F.col("live_look")
    base = placed.select("digest", "kind", "start", "end", copied.alias("copied"), live.alias("live"))
    added = placed.where(live).select(
        "digest",
        F.lit(LIVE).alias("kind"),
        (F.col("end") - F.col("value_size")).alias("start"),
        "end",
        F.lit(False).alias("copied"),
        F.lit(True).alias("live"),
    )
    return base.unionByName(added.distinct())


def _joined(base_only: bool) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("live"))
    spans = F.array_sort(F.collect_list(F.when(F.lit(not base_only) | (F.col("kind") < 3), F.struct("start", "kind", "end"))))
    text = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs(doc_id, text, owner, repository)``.

    Null and empty texts have no spans; repeated rows get the same result;
    other columns are not looked at.
    """
    spans = secret_spans(docs, owner, repository)
    # Written before the join, so that AQE can split the copies of one text.
    by_text = spans.groupBy("digest").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        F.sha2(_joined(True), 256).alias("base_sha256"),
        _joined(False).alias("spans"),
        F.count_if((F.col("kind") == LIVE)).alias("n_live"),
        F.count_if(F.col("copied")).alias("n_copied"),
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    )
    counts = ["n_assign", "n_access", "n_hex"]
    return rows.join(shared_checkpoint(by_text), "digest", "left").select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_vendor", "n_live", "n_copied")],
    )


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans go, overlapping ones together. ``[EXAMPLE]`` takes
    their place where only copied values are covered, else ``[SECRET]``. Other
    rows and columns are unchanged, but ``n_chars`` follows the text. Null and
    empty texts stay as they are, repeated rows are cut alike, an empty table
    gives an empty result, and columns may have any name.
    """
    spans = secret_spans(docs)
    before = Window.partitionBy("digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn(
        "new", F.when(F.col("start") < F.coalesce(F.max("end").over(before), F.lit(-1)), 0).otherwise(1)
    )
    upto = Window.partitionBy("digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = (
        marked.withColumn("island", F.sum("new").over(upto))
        .groupBy("digest", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("copied").alias("copied"))
        .groupBy("digest")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "copied"))).alias("cut"))
    )
    # Each piece is the text since the span before, then the mark; the rest follows the last span.
    since = F.concat(F.array(F.lit(0).cast("long")), F.transform("cut", lambda s: s["end"]))
    pieces = F.transform(
        F.arrays_zip(F.col("cut").alias("s"), since.alias("at")),
        lambda z: F.when(
            z["s"].isNotNull(),
            F.concat(
                F.substring("doc.text", z["at"].cast("int") + 1, (z["s"]["start"] - z["at"]).cast("int")),
                F.when(z["s"]["copied"], "[EXAMPLE]").otherwise("[SECRET]"),
            ),
        ).otherwise(F.substring("doc.text", z["at"].cast("int") + 1, F.length("doc.text"))),
    )
    whole = docs.select(F.struct("*").alias("doc"))  # own names beside any column's
    maybe = has_candidate(F.col("doc.text"))
    cut = whole.where(maybe).withColumn("digest", F.sha2("doc.text", 256))
    cut = cut.join(shared_checkpoint(islands), "digest", "left")
    cut = replace_text(cut, F.col("cut").isNotNull(), F.array_join(pieces, ""))
    return cut.select("doc.*").unionByName(whole.where(~maybe).select("doc.*"))


QUERIES = {"op9_secret_ownership": op9_secret_ownership}
ORACLES: dict[str, str] = {}
