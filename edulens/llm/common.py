"""Helpers shared by the corpus operators: checkpoints, table reads, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, only a local
    master may take a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read again. Beside its
    lineage this cuts the estimated size, which a checkpoint hands on: joined over
    and over it becomes a number of millions of digits."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SLICE_ROWS = 1000


def text_slices(batches, rows: int = SLICE_ROWS):
    """``(doc_id, text)`` lists of at most ``rows`` rows from Arrow batches, so
    that few rows at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def map_texts(rows: DataFrame, run, columns: str) -> DataFrame:
    """``doc_id`` of ``rows`` and beside it the ``columns`` that ``run`` makes of
    each pandas batch. Ids stay in Arrow, so a null leaves the others exact."""
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def each(batches):
        for b in batches:
            out = pa.RecordBatch.from_pandas(run(b.to_pandas()), schema, preserve_index=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.columns], ["doc_id", *schema.names])

    return rows.mapInArrow(each, f"doc_id long, {columns}")


def replace_text(rows: DataFrame, changed: Column, text: Column) -> DataFrame:
    """``rows`` with ``text`` in the struct ``doc`` where ``changed``; ``n_chars``,
    where there is one, follows."""
    rows = rows.withColumn("new_text", F.when(changed, text))
    new = F.when(changed, F.col("new_text")).otherwise(F.col("doc.text"))
    doc = F.col("doc").withField("text", new)
    if "n_chars" in rows.schema["doc"].dataType.names:
        chars = F.when(changed, F.length("new_text").cast("long")).otherwise(F.col("doc.n_chars"))
        doc = doc.withField("n_chars", chars)
    return rows.withColumn("doc", doc)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a[i], b[i]) into ``label``, which maps each index to the
    smallest index of its set."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (i[k], j[k]) of a forest of least total ``d`` over n
    nodes. Ties go by i, then j, so equal pieces of a graph give equal forests."""
    order = np.lexsort((j, i, d))
    i, j = i[order], j[order]
    label, open_, chosen = np.arange(n), np.arange(len(i)), [order[:0]]
    while len(open_):
        ends = np.stack([label[i[open_]], label[j[open_]]], axis=1)
        apart = ends[:, 0] != ends[:, 1]
        open_, ends = open_[apart], ends[apart]
        first = np.unique(ends.ravel(), return_index=True)[1]  # the best edge of each tree
        pick = np.unique(open_[first // 2])
        chosen.append(order[pick])
        label = merge_labels(label, i[pick], j[pick])
    return np.concatenate(chosen)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges(a, b)`` of one orderable type; returns ``(node, component)``. Each
    round is one large-star and one small-star step. The minima are partial
    aggregates and are written before they are joined, so both sides of a join
    are plain shuffles and AQE splits the neighbours of a hub over many tasks.
    Rounds needed grow with the logarithm of the longest path. Loops, repeats
    and null ends are ignored; an empty input gives an empty result.
    """
    cur = shared_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        # Large star: each node hands its larger neighbours the smallest one around it.
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(shared_checkpoint(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = shared_checkpoint(large.where("a <> b").distinct())
        # Small star: every edge points down; link the smaller neighbours to the least.
        low = shared_checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        cur = shared_table(nxt)
        now = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
