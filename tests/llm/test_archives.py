"""Archives written to files, read back and audited."""

import glob
import os

from pyspark.sql import functions as F

from edulens.llm import warc


def laid_out(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = pages.select("page_id", warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return records, warc.manifest(records, 16).cache()


def test_files_are_the_records_and_audits_find_damage(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>é {i}</p>\r\n\r\nWARC/1.1 in a page\r\n" * (i % 4)) for i in range(60)] + [(3, "http://a/3", rows_3), (99, None, None)]
    records, laid = laid_out(spark, rows)
    path = str(tmp_path / "w")
    warc.write_archives(records, laid, path)
    files = {f: open(f, "rb").read() for f in glob.glob(f"{path}/archive=*/*.txt")}
    assert sum(map(len, files.values())) == laid.agg(F.sum("length")).first()[0]
    for data in files.values():
        assert all(b"WARC-Date: " in data[a : a + n] for a, n in warc.records_of(data))
    assert warc.audit(laid, warc.read_archives(spark, path), 16).count() == 0
    name, data = next((f, d) for f, d in files.items() if len(list(warc.records_of(d))) > 3)
    archive = int(name.split("archive=")[1].split("/")[0])
    spans = list(warc.records_of(data))
    broken = bytearray(data)
    broken[spans[1][0] + spans[1][1] - 6] ^= 1
    os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))  # or the file system refuses to read on
    with open(name, "wb") as f:
        f.write(broken)
    got = {tuple(r) for r in warc.audit(laid, warc.read_archives(spark, path), 16).collect()}
    assert got == {(archive, *spans[1], "corrupt")}
    with open(name, "wb") as f:
        f.write(data[: spans[-1][0]])
    got = {tuple(r) for r in warc.audit(laid, warc.read_archives(spark, path), 16).collect()}
    assert got == {(archive, *spans[-1], "missing")}


rows_3 = "<p>é 3</p>\r\n\r\nWARC/1.1 in a page\r\n" * 3


def test_cut_off_and_foreign_bytes_are_pieces():
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.records_of(one + one)) == [(0, len(one)), (len(one), len(one))]
    assert list(warc.records_of(b"junk\r\n\r\n" + one)) == [(0, 8), (8, len(one))]
    assert list(warc.records_of(one + one[:-5])) == [(0, len(one)), (len(one), len(one) - 5)]
    assert list(warc.records_of(b"")) == []


def test_very_long_record_nulls_and_empty(spark, tmp_path):
    records, laid = laid_out(spark, [(1, "http://a", "x" * 3_000_000), (None, None, None)])
    path = str(tmp_path / "w")
    warc.write_archives(records, laid, path)
    assert warc.audit(laid, warc.read_archives(spark, path), 16).count() == 0
    nothing = laid.limit(0)
    assert warc.audit(nothing, nothing, 16).count() == 0
    assert warc.audit(laid, nothing, 16).where("status = 'missing'").count() == 2
    unread = laid.withColumn("digest", F.lit(None).cast("string"))
    assert warc.audit(laid, unread, 16).where("status = 'missing'").count() == 2
