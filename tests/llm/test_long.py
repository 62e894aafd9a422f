"""Texts far longer than usual, whole and without a space, through the operators that read texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from edulens.llm import language, packing, pieces, quality_model, rules, secrets, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    syllables = ["ta", "ken", "lo", "ri", "mas", "é", "un", "der"]
    long = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60_000))
    return [long, "".join(rng.choice("abcdefghijklmnop") for _ in range(100_000)), None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)


def test_fingerprints(docs, texts):
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    words = texts[0].lower().split(" ")
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert got[0] == f"{want:016x}" and got[2] == "0" * 16
    assert got[1] == f"{xxhash.xxh64_intdigest(texts[1].encode(), 42):016x}"


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(packing.pieces(docs)).orderBy("doc_id", "piece").collect()
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = [r for r in got if r.doc_id == k]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])


def test_pieces(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    got = {r.doc_id: r for r in pieces.encode_digests(docs).collect()}
    for k, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_substrings_and_secrets(docs, texts):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert all(got[k].n_removed == 0 and got[k].n_bytes == len((t or "").encode()) for k, t in enumerate(texts))
    doubled = docs.unionByName(docs)
    assert all(r.n_removed == r.n_bytes and r.n_spans == (r.n_bytes > 0) for r in substrings.remove_repeats(doubled).collect())
    assert all(r.spans == "" for r in secrets.scan_secrets(docs).collect())


def test_rules_and_models(spark, docs, texts):
    labelled = [(10 + k, f"{'fine prose of words' if k % 2 else 'x $$ ## x'} {k} " * 30, "en" if k % 2 else "de", "s", 0) for k in range(40)]
    every = docs.unionByName(spark.createDataFrame(labelled, DOCS))
    doubled = spark.createDataFrame([(7, f"{texts[0]}\n{texts[0]}", None, None, None)], DOCS)
    got = {r.doc_id: r for r in rules.quality_rules(docs.unionByName(doubled)).collect()}
    n = len(texts[0].split(" "))
    assert (got[0].n_words, got[1].n_words, got[2].n_words) == (n, 1, 0)
    assert got[7].n_words == got[7].n_repeat_words == 2 * n and got[7].n_dup_lines == 1 and got[7].base_failed
    assert [r.doc_id for r in rules.drop_rejected(spark, docs, "").select("doc_id").collect()] == [0]
    labels = spark.createDataFrame([(10 + k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in quality_model.classify(every, quality_model.train(every, labels)).collect()}
    assert len(scored) == every.count() and all(0 <= x <= 1 for x in scored.values())
    told = {r.doc_id: r.lang_pred for r in language.identify(every, language.train(every)).collect()}
    assert told[2] == "und" and {told[0], told[1]} <= {"en", "de"}


def test_stages_of_the_pipeline(spark, docs, texts):
    near = spark.createDataFrame([(5, texts[0] + " and one more word", None, None, None)], DOCS)
    kept = simhash.drop_near_duplicates(spark, docs.unionByName(near), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1, 2]
    packed = packing.pack_stage(spark, docs.withColumnRenamed("n_chars", "piece"), "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {0, 1, 2}
