"""Fixity audits against plain comparison, and a round trip through WARC bytes."""

import hashlib

from pyspark.sql import functions as F

from cairn.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, n=300):
    rows = [(k, f"https://h{k % 7}.example/{k}", f"<p>page {k}</p>" * (k % 9)) for k in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (None, None, None), (400, "u\r\nX: y", ""), (401, "é", "é" * 9000), (402, "one", "first"), (402, "two", "second")], SCHEMA)


def test_finds_what_differs(spark):
    records = warc.archive(pages(spark), records_a_file=50)
    hit = {3, 57, 120, 299, 401}
    worn = records.withColumn("payload", F.when(F.col("page_id").isin(list(hit)), F.concat(F.expr("substring(payload, 1, 20)"), F.lit(b"?"), F.expr("substring(payload, 22)"))).otherwise(F.col("payload")))
    for fanout in (2, 16):
        found = warc.audit(warc.leaves(records), warc.leaves(worn), fanout).collect()
        assert {r["page_id"] for r in found} == hit and {r["state"] for r in found} == {"damaged"}
    assert warc.audit(warc.leaves(records), warc.leaves(records)).collect() == []


def test_offsets_point_into_the_files(spark):
    records = warc.archive(pages(spark), records_a_file=50)
    files = {r["file"]: bytes(r["bytes"]) for r in warc.files_of(records).collect()}
    payloads = {}
    for r in records.collect():
        payloads.setdefault(r["page_id"], []).append(bytes(r["payload"]))
    for r in warc.leaves(records).collect():
        part = files[r["file"]][r["start"] : r["start"] + r["length"]]
        assert part in payloads[r["page_id"]]
        copies = payloads[r["page_id"]].count(part)
        assert copies == (2 if r["page_id"] is None else 1)
        assert r["digest"] == hashlib.sha256(f"{r['start']}:{r['length']}:{copies}:{hashlib.sha256(part).hexdigest()}".encode()).hexdigest()


def test_round_trip(spark):
    records = warc.archive(pages(spark), records_a_file=50)
    back = warc.read_files(warc.files_of(records))
    key = lambda r: (r["file"], r["page_id"] or -1, bytes(r["payload"]))
    assert sorted(map(key, records.collect())) == sorted(map(key, back.collect()))


def test_records_missing_or_added_at_the_end(spark):
    records = warc.leaves(warc.archive(pages(spark, 100), records_a_file=1000)).where("page_id is not null")
    short = records.where("place < 90")
    assert {(r["place"], r["state"]) for r in warc.audit(records, short).collect()} == {(r["place"], "missing") for r in records.where("place >= 90").collect()}
    assert {r["state"] for r in warc.audit(short, records).collect()} == {"added"}


def test_empty(spark):
    none = warc.leaves(warc.archive(spark.createDataFrame([], SCHEMA)))
    some = warc.leaves(warc.archive(pages(spark, 5)))
    assert warc.audit(none, none).collect() == []
    assert {r["state"] for r in warc.audit(some, none).collect()} == {"missing"}
