"""Imports, exports and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trackwell.sources import records
from trackwell.streaming import statuses


def test_json_import(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"company": " Acme ", "title": "Dev"}, {"company": " "}, {"title": "x", "status": "Applied", "notes": None}]))
    got = [(r["company"], r["title"], r["status"]) for r in records.read_json(spark, str(tmp_path / "in.json")).collect()]
    assert got == [("Acme", "Dev", "Interesting"), ("Unknown", None, "Interesting"), ("Unknown", "x", "Applied")]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'Quote "Co"', "a,b", "Applied", None), (2, "", "no company", "Applied", None), (3, "Line\nCo", None, "Saved", "2026-01-01")]
    items = spark.createDataFrame(rows, "id long, company string, title string, status string, deadline string")
    for c in records.EXPORT_FIELDS:
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    records.write_csv(items, str(tmp_path / "out"))
    got = sorted((r["company"], r["title"], r["deadline"]) for r in records.read_csv(spark, str(tmp_path / "out")).collect())
    assert got == [("Line\nCo", None, "2026-01-01"), ('Quote "Co"', "a,b", None)]


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "old.csv").write_text('"id","company","title","status"\r\n"1","A ""x""","T","S"\r\n2,,B,C\n"3","","T","S"\n')
    got = sorted((r["company"], r["title"], r["status"]) for r in records.read_legacy_csv(spark, str(tmp_path / "old.csv")).collect())
    assert got == [('A "x"', "T", "S"), ("B", "C", "Interesting")]  # the empty cell of line 2 is passed over
    (tmp_path / "none.csv").write_text("")
    assert records.read_legacy_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_provider_payloads(spark):
    long = "d" * 500
    payloads = [(1, "indeed", "x", json.dumps({"organic_results": [{"link": "u", "title": "Dev - Acme", "snippet": long}, {}]})), (2, "indeed", "x", "{}")]
    df = spark.createDataFrame(payloads, "payload_id int, platform string, location string, payload string")
    got = records.provider_results(df, "serp").orderBy("place").collect()
    assert [(r["payload_id"], r["title"], r["company"], len(r["description"])) for r in got] == [(1, "Dev", "Acme", 400), (1, "Untitled", "", 0)]
    with pytest.raises(Exception):
        records.provider_results(spark.createDataFrame([(1, "p", "x", "not json")], df.schema), "serp").collect()


def test_streamed_statuses(spark, tmp_path):
    log = spark.createDataFrame([(1, "Saved", "2026-01-01 00:00:00"), (1, "Applied", "2026-01-02 00:00:00"), (2, "Saved", "2026-01-03 00:00:00")], "job_id long, to_status string, changed_at string")
    log.withColumn("changed_at", F.to_timestamp("changed_at")).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("job_id long, to_status string, changed_at timestamp").parquet(str(tmp_path / "log"))
    query = statuses.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["job_id"], r["to_status"]) for r in spark.table("latest").collect()) == [(1, "Applied"), (2, "Saved")]
    batch = statuses.changes(log.withColumn("changed_at", F.to_timestamp("changed_at")))
    assert sorted((r["to_status"], r["changes"]) for r in batch.collect()) == [("Applied", 1), ("Saved", 1), ("Saved", 1)]
