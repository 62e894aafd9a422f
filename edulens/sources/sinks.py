"""Upserts, syncs and revisions over Parquet tables, as pure functions of the
target and the source; write_version publishes the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle


def upsert(target: DataFrame, source: DataFrame, keys: list[str], immutable: list[str] = ()) -> DataFrame:
    """Target after the source's rows, each with its ``change``: inserted,
    updated, unchanged, kept (not in the source), or conflict where an
    immutable field differs (the old row stays)."""
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*cols).alias("_t"))
    s = source.select(*keys, F.struct(*cols).alias("_s"))
    j = t.join(s, keys, "full")
    moved = F.lit(False)
    for c in immutable:
        moved = moved | ~F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}"))
    change = (
        F.when(F.col("_t").isNull(), "inserted").when(F.col("_s").isNull(), "kept")
        .when(F.col("_t").eqNullSafe(F.col("_s")), "unchanged").when(moved, "conflict").otherwise("updated")
    )
    j = j.withColumn("change", change)
    row = F.when(F.col("change").isin("inserted", "updated"), F.col("_s")).otherwise(F.col("_t"))
    return j.select(*keys, *[row[c].alias(c) for c in cols], "change")


def upsert_stats(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def remove_stale(target: DataFrame, source: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Target rows that the source still has, or that are of a scope that the
    source does not speak of. One outer join and one semi-join."""
    seen = source.select(*scope).distinct().withColumn("_in", F.lit(True))
    have = source.select(*keys).distinct().withColumn("_have", F.lit(True))
    j = target.join(seen, scope, "left").join(have, keys, "left")
    return j.where("_in is null or _have is not null").drop("_in", "_have")


def sync_children(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Child rows to delete and to add."""
    return target.join(source, keys, "left_anti"), source.join(target, keys, "left_anti")


def scoped_sync(target: DataFrame, source: DataFrame | None, keys: list[str], kind: str) -> DataFrame:
    """Replace the rows of one source kind; without a source nothing goes."""
    if source is None:
        return target
    own = F.col("source_kind") == kind
    return target.where(~own).unionByName(source.where(own).dropDuplicates(keys))


def append_revision(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """History with a new revision where the content hash is not the latest."""
    w = Window.partitionBy(key).orderBy(F.col("revision").desc())
    last = history.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(
        key, F.col("revision").alias("_r"), F.col("content_hash").alias("_h")
    )
    new = current.join(last, key, "left").where(~F.col("content_hash").eqNullSafe(F.col("_h")))
    new = new.withColumn("revision", F.coalesce(F.col("_r"), F.lit(0)) + 1)
    return history.unionByName(new.select(*history.columns))


def replace_for(target: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Target with all rows of the keys in ``fresh`` replaced by its rows."""
    return target.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def mark_stale(projections: DataFrame, stale: DataFrame, key: str = "program_id") -> DataFrame:
    s = stale.select(key).distinct().withColumn("_s", F.lit(True))
    j = projections.join(s, key, "left")
    return j.withColumn("status", F.when(F.col("_s"), "stale").otherwise(F.col("status"))).drop("_s")


def active_only(projections: DataFrame) -> DataFrame:
    return projections.where("status = 'active'")


def changed_items(items: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Items whose hash is unknown or is not the only one known before."""
    p = previous.groupBy(key).agg(F.collect_set("source_hash").alias("_h"))
    j = items.join(p, key, "left")
    same = F.col("source_hash").isNotNull() & F.col("_h").isNotNull() & (F.size("_h") == 1) & (
        F.col("_h")[0] == F.col("source_hash")
    )
    return j.where(~F.coalesce(same, F.lit(False))).drop("_h")


def input_hash(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    line = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    return df.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("input_sha256"))


def runs(df: DataFrame, status: str, limit: int = 50) -> DataFrame:
    kept = df.where(F.col("status") == status)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    # The total is a single row.
    return kept.orderBy(F.col("started_at").desc(), "run_id").limit(limit).join(F.broadcast(total), F.lit(True))


def previous_good(df: DataFrame) -> DataFrame:
    return df.where("status = 'completed'").groupBy("university_id").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id")
    )


def recover_stale(df: DataFrame, now, timeout_seconds: int) -> DataFrame:
    """Running rows without a sign of life become failed, with the reason."""
    beat = F.coalesce("heartbeat_at", "started_at")
    dead = (F.col("status") == "running") & (
        F.unix_seconds(beat) < F.unix_seconds(F.lit(now).cast("timestamp")) - timeout_seconds
    )
    why = F.when(F.col("projection_status") == "running", "abandoned_in_projection").otherwise("abandoned")
    return df.withColumn("reason", F.when(dead, why)).withColumn(
        "status", F.when(dead, "failed").otherwise(F.col("status"))
    )


def mark_document_stale(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts of a replaced document (same year, kind and url, other hash)."""
    d = documents.select("admission_year", "kind", "source_url", F.col("content_hash").alias("_h"))
    j = facts.join(d, ["admission_year", "kind", "source_url"], "left")
    old = F.col("_h").isNotNull() & (F.col("_h") != F.col("content_hash"))
    return j.withColumn("status", F.when(old, "stale").otherwise(F.col("status"))).drop("_h")


def write_version(df: DataFrame, root: str, version: str, partition_by: list[str] = ()) -> str:
    """Write a new version folder; readers follow the path that is returned, so
    a failed write leaves the old version whole."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new table in folders by the hash of ``key``, for ``replace_in_buckets``."""
    laid = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
    laid.write.mode("errorifexists").partitionBy("bucket").parquet(path)


def replace_in_buckets(path: str, fresh: DataFrame, key: str, buckets: int, affected: DataFrame | None = None) -> int:
    """Replace all rows of the keys in ``affected`` (those of ``fresh``, if not
    given) by the rows of ``fresh``; returns how many buckets were written.

    Only buckets with such a key are read and written, by a dynamic partition
    overwrite; the files of others stay as they are. What is written is settled
    before, so the table is never read while it is overwritten. A null key is a
    key. Rows of ``fresh`` for keys that are not affected are an error.
    """
    spark = fresh.sparkSession
    names = spark.read.parquet(path).drop("bucket").columns
    keys = settle((fresh if affected is None else affected).select(key).distinct())
    if affected is not None:
        stray = fresh.join(keys.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        if not stray.isEmpty():
            raise ValueError("fresh rows of keys that are not affected")
    touched = sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets``
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    kept = old.join(keys.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    rows = settle(kept.select(*names).unionByName(fresh.select(*names)).withColumn("bucket", bucket_of(key, buckets)))
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in set(touched) - left:  # no row is left, so nothing overwrote it
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(touched)
