"""Every pipeline stage with nulls, empty, long and repeated texts, and columns of any name."""

import random

import pytest
from pyspark.sql import functions as F

from edulens.llm import packing, rules, secrets, substrings

OWN = ["_key", "_digest", "_text", "_cut", "digest", "kept", "doc", "cut", "new_text", "id", "h", "row", "bin", "size"]
BIG = 2**60 + 1  # no double holds it


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    passage = words(1, 80)
    texts = [None, "", " \n ", words(2, 300), f"{words(3, 100)} {passage}", f"{words(4, 100)} {passage} {words(5, 10)}", words(6, 60_000)]
    texts.append(words(7, 90) + " token = 0123456789abcdef0123456789abcdef " + words(8, 90))
    rows = [(BIG + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, words(9, 70), None, None, None)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(n).alias(n) for n in OWN])


@pytest.mark.parametrize("stage", [rules.drop_rejected, substrings.cut_repeats, secrets.redact])
def test_stage_leaves_columns_and_ids_alone(spark, docs, stage):
    got = stage(spark, docs, "")
    assert got.schema.names == docs.schema.names
    rows = got.collect()
    assert all(r[n] == n for r in rows for n in OWN)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    if stage is not rules.drop_rejected:
        assert len(rows) == docs.count()
        assert {r.doc_id: r.text for r in rows}[BIG] is None and {r.doc_id: r.text for r in rows}[BIG + 1] == ""
        assert all(r.n_chars == len(r.text or "") for r in rows if r.n_chars is not None)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_do_their_work(spark, docs):
    kept = [r.doc_id for r in rules.drop_rejected(spark, docs, "").collect()]
    assert BIG not in kept and BIG + 1 not in kept and kept.count(BIG + 3) == 2 and None in kept
    cut = {r.doc_id: r.text for r in substrings.cut_repeats(spark, docs, "").collect()}
    assert cut[BIG + 3] == ""  # the row that comes twice
    assert words(1, 80) not in cut[BIG + 4] and cut[BIG + 4].startswith(words(3, 100)[:500])
    assert cut[BIG + 6] == words(6, 60_000)
    red = {r.doc_id: r.text for r in secrets.redact(spark, docs, "").collect()}
    assert red[BIG + 7] == words(7, 90) + " [SECRET] " + words(8, 90)
    packed = packing.pack_stage(spark, docs, "")
    assert packed.count() == packed.select("sequence_id", "offset").distinct().count()
    assert packed.where("doc_id is null").agg(F.sum("length")).first()[0] > 70
