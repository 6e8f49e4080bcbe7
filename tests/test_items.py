"""Relations over items on fresh rows: order, lanes, cells, duplicates, appends, updates that must fail, payloads, schemas."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackwell.functions import choices, drafts, labels, scores
from trackwell.functions import text as T
from trackwell.operators import items as I
from trackwell.sources import records as R

NOW = "2026-03-10T12:00:00Z"


def items(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_order_of_readers(spark):
    rows = [(1, "zoo"), (2, "Éclair"), (3, "\techo"), (4, " \t"), (5, None), (6, "Apple"), (7, "apple")]
    df = items(spark, rows, "id long, title string")
    up = [r["id"] for r in I.sorted_items(df, "title", False).collect()]
    assert up == [7, 6, 3, 2, 1, 5, 4]  # accents beside their letters, blanks last, ties by the larger id
    down = [r["id"] for r in I.sorted_items(df, "title", True).collect()]
    assert down == [5, 4, 1, 2, 3, 7, 6]


def test_status_then_company(spark):
    df = items(spark, [(1, "Zeta", "Application Sent"), (2, "Alpha", "Interesting"), (3, "Beta", "Interesting"), (4, "No", "Other")], "id long, company string, status string")
    assert [r["company"] for r in I.sorted_items(df, "status", False, "company", False).collect()] == ["Alpha", "Beta", "Zeta", "No"]


def test_same_results_in_another_case(spark):
    rows = [(1, "indeed", None, "Dev", "Acme"), (2, "Indeed", "\t", "dev", "ACME"), (3, "indeed", "http://A.b/X", "x", "y"), (4, "INDEED", "http://a.b/x", "z", "w"), (5, "indeed", "", "Dev", None), (6, "indeed", "", "dev", "")]
    df = items(spark, rows, "pos long, platform string, url string, title string, company string")
    assert sorted(r["pos"] for r in I.deduplicated(df).collect()) == [1, 3, 5]


def test_first_duplicates(spark):
    rows = [(1, "u", "A", "T"), (2, "u", "B", None), (3, None, "b", ""), (4, "", "C", "x"), (5, "", "D", "x"), (6, "v", "a", "t"), (7, "v", "A", "T")]
    df = items(spark, rows, "id long, url string, company string, title string")
    assert {r["id"]: r["duplicate_id"] for r in I.first_duplicates(df).collect()} == {1: 2, 2: 1, 3: 2, 6: 1, 7: 1}


def test_places(spark):
    df = items(spark, [(1, "2026-01-02", "b"), (2, "2026-01-01", "z"), (3, "2026-01-02", "a"), (4, None, "n")], "id long, day string, name string")
    got = {r["id"]: r["position"] for r in I.placed(df, F.col("day"), False, [F.col("name")]).collect()}
    assert got == {4: 1, 2: 2, 3: 3, 1: 4}
    assert {r["id"]: r["position"] for r in I.placed(df, F.col("day"), True, [F.col("name")]).collect()} == {3: 1, 1: 2, 2: 3, 4: 4}
    assert I.placed(df.limit(0), F.col("day"), True, [F.col("name")]).count() == 0


def test_lanes_and_cells(spark):
    df = items(spark, [(1, "A", None, "Open", "2026-06-01", "\n", None), (2, "É", "t", "Open", "\t2026-06-01", None, "2026-07-01"), (3, "F", "t", "Lost", "bad", None, None)], "id long, company string, title string, status string, deadline string, interview_date string, start_date string")
    lanes = sorted((r["lane"], r["place"] or 0, r["id"] or 0) for r in I.items_in_lanes(df, ["Open", "Done"], [F.desc("id")]).collect())
    assert lanes == [("Done", 0, 0), ("Open", 1, 2), ("Open", 2, 1)]
    cells = I.calendar_cells(df, 2026, 6).collect()
    assert len(cells) == 43 and {r["cell"] for r in cells} == set(range(42))  # the first of June 2026 is a Monday
    assert sorted((r["cell"], r["place"], r["id"]) for r in cells if r["id"]) == [(0, 1, 1), (0, 2, 2)]
    found = I.ordered_occurrences(df).orderBy("position").collect()
    assert [(r["id"], r["kind"], r["date"]) for r in found] == [(1, "apply", "2026-06-01"), (2, "apply", "2026-06-01"), (2, "start", "2026-07-01"), (3, "apply", "bad")]
    gone = I.items_of_occurrences(I.occurrences(df), df.where("id = 1")).collect()
    assert {(r["id"], r["status"]) for r in gone} == {(1, "Open"), (2, None), (3, None)}


def test_appends_follow_any_positions(spark):
    old = items(spark, [(41, "Old", NOW, NOW)], "id long, company string, created_at string, updated_at string")
    sparse = [(i * 10**15 + (i % 3), f"c{i}") for i in range(-50, 250)]
    new = items(spark, sparse[::-1], "pos long, company string")
    got = {r["company"]: r["id"] for r in I.appended(old, new, NOW, parts=16).collect()}
    assert got == {"Old": 41} | {f"c{i}": 42 + k for k, i in enumerate(range(-50, 250))}
    blank = items(spark, [(1, "\t"), (2, "x"), (2, "y")], "pos long, company string")
    assert sorted(r["id"] for r in I.appended(old, blank, NOW).collect()) == [41, 42, 43]
    assert sorted(r["id"] for r in I.appended(old, blank, NOW, blank_companies=True).collect()) == [41, 42, 43, 44]
    assert I.appended(old, blank.limit(0), NOW).count() == 1


def test_updates_that_fail(spark):
    old = items(spark, [(1, "A", "Open", "x")], "id long, company string, status string, updated_at string")
    patch = lambda c: items(spark, [(1, c, "Done")], "id long, company string, status string")
    new, log = I.updated(old, patch(" B\n"), ["company", "status"], NOW)
    assert [tuple(r) for r in new.collect()] == [(1, "B", "Done", NOW)] and log.count() == 1
    for part in I.updated(old, patch("\t"), ["company", "status"], NOW):
        with pytest.raises(Exception, match="Company is required"):
            part.collect()
    assert I.present(items(spark, [(1,)], "id long"), old).count() == 1
    with pytest.raises(Exception, match="Item not found"):
        I.present(items(spark, [(1,), (2,)], "id long"), old).collect()


def test_documents_oldest_first(spark):
    df = items(spark, [(1, 7, "2026-02-01"), (2, 7, "2026-01-01"), (3, 8, "2025-01-01"), (4, 7, "2026-01-01")], "id long, job_id long, created_at string")
    assert [r["id"] for r in I.documents_of(df, 7).collect()] == [2, 4, 1]


def test_schemas_and_payloads(spark):
    assert len(R.ITEM_SCHEMA) == 29 and [f.name for f in R.ITEM_SCHEMA if not f.nullable] == ["id", "company", "status", "created_at", "updated_at"]
    df = I.with_schema(items(spark, [(1, "A", 3)], "id int, company string, priority int"), R.ITEM_SCHEMA)
    assert df.columns == list(R.ITEM_FIELDS) and dict(df.dtypes)["priority"] == "bigint"
    assert len(R.editable(df).columns) == 23 and not set(R.SYSTEM_FIELDS) & set(R.editable(df).columns)


def test_backup_and_json_round_trip(spark, tmp_path):
    df = items(spark, [(1, "A", None), (2, "B", "t")], "id long, company string, title string")
    R.backup({"items": df, "log": df.limit(1)}, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/items")).count() == 2 and spark.read.parquet(str(tmp_path / "b/log")).count() == 1
    R.write_json(df, str(tmp_path / "j"))
    assert sorted(r["company"] for r in spark.read.json(str(tmp_path / "j")).collect()) == ["A", "B"]
    with pytest.raises(Exception):
        R.imported(items(spark, [("not an array",)], "p string"), F.col("p")).collect()


def test_drafts_and_labels(spark):
    rows = [("https://www.a.b/x", None, '{"company": "A"}'), ("https://a.b/", "text", "no"), ("https://a.b/", " text ", '{"company": " ", "title": "T"}')]
    df = items(spark, rows, "link string, page string, answer string")
    got = drafts.capture_drafts(df, F.col("link"), F.col("page"), F.col("answer"), F.lit("Open")).collect()
    assert [(r["company"], r["title"], r["source"], r["raw_text"], r["reason"]) for r in got] == [("", None, "a.b", None, "fetch_failed"), ("", None, "a.b", "text", "extract_failed"), ("", "T", "a.b", "text", None)]
    links = items(spark, [("apply", "A", None, "2026-01-02"), ("party", "A", "d e", None)], "kind string, company string, title string, date string")
    made = links.select(labels.template_link(F.col("date"), labels.template_summary(F.col("kind"), F.col("company")), F.col("title")).alias("l"), labels.template_summary(F.col("kind"), F.col("company")).alias("s")).collect()
    assert made[0]["l"].endswith("text=Application%20deadline%3A%20A&dates=20260102/20260102&details=trackwell") and made[1]["l"] is None and made[1]["s"] == "A"
    dates = items(spark, [("2026-03-01T12:00:00Z",), ("2026-03-01",), ("nothing at all",), (None,)], "x string")
    assert [r["d"] for r in dates.select(scores.added_date(F.col("x")).alias("d")).collect()] == ["Mar 1, 2026", "Mar 1, 2026", "nothing at", None]


def test_white_space_of_any_kind(spark):
    df = items(spark, [("\t a b \n",), ("﻿x\r\n",), ("",), (None,)], "x string")
    assert [r["y"] for r in df.select(T.stripped(F.col("x")).alias("y")).collect()] == ["a b", "x", "", None]
    assert [r["y"] for r in df.select(T.blank_to_null(F.col("x")).alias("y")).collect()][2:] == [None, None]


def test_more_choices():
    assert choices.toggled(["a", "b"], "a") == ["b"] and choices.toggled(["a"], "b") == ["a", "b"]
    assert choices.board_view("calendar") == "calendar" and choices.board_view("other") == choices.board_view(None) == choices.board_view(["table"]) == "table"
    assert choices.search_query(" x ") == "x" and choices.search_query(None) == choices.search_query(3) == ""
    assert len(choices.WEEKDAYS) == 7 and choices.WEEKDAYS[0] == "Mon"


def test_results_need_a_link(spark):
    rows = [(1, "other", "", "t", "d"), (2, "other", "http://x", "t", "d"), (3, "jobindex", "https://www.JOBINDEX.dk/1", "t", "d"), (4, "jobindex", "https://www.jobindex.dk/arkiv/1", "t", "d"), (5, "indeed", "https://jobindex.dk/1", "t", "d"), (6, "other", None, "t", "d")]
    df = items(spark, rows, "pos long, platform string, url string, title string, description string")
    assert sorted(r["pos"] for r in I.kept_results(df).collect()) == [2, 3]
