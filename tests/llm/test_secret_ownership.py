"""Ownership of values by owners and by the repositories of one owner."""

from edulens.llm import secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def verdict(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 9) for i, t, s in rows], DOCS)
    return df, {r.doc_id: (r.n_live, r.n_copied) for r in secrets.scan_secrets(df).collect()}


def test_value_copied_inside_one_source(spark):
    df, got = verdict(spark, [(i, f"doc {i} token={KEY}", "hot") for i in range(secrets.MAX_REPOSITORIES + 1)])
    assert set(got.values()) == {(0, 2)}
    assert {r.text for r in secrets.redact(spark, df, "").collect()} == {f"doc {i} [EXAMPLE]" for i in range(len(got))}


def test_null_source_and_few_repositories(spark):
    wide = [(i, f"doc {i} token={KEY}", None) for i in range(secrets.MAX_REPOSITORIES + 1)]
    few = [(100 + i, f"doc {i} token={KEY[::-1]}", s) for s in ("a", "b") for i in range(0 if s == "a" else 10, secrets.MAX_REPOSITORIES if s == "a" else 10 + secrets.MAX_REPOSITORIES)]
    _, got = verdict(spark, wide + few + few[:1] * 9)  # repeated rows are one repository
    assert {got[i] for i, *_ in wide} == {(0, 2)}
    # the 40 digits pass as two kinds; the one live span covers both
    assert {got[i][1] for i, *_ in few} == {0} and all(got[i][0] > 0 for i, *_ in few)
