"""Column functions on fresh literals: tags, titles, ages, scores, pages, URLs, listing states, model answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackwell.functions import choices, drafts, labels, scores
from trackwell.functions import text as T

AS_OF = "2026-03-10 12:00:00"


def values(spark, inputs, make):
    """make(column) for each input, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tags(spark):
    cases = {
        None: [], "  ": [], "Spark, SQL;Scala|Rust": ["spark", "sql", "scala", "rust"], "a\nb\tc": ["a", "b", "c"], '"One" , \'Two\'': ["one", "two"],
        '["Go", " Zig ", ""]': ["go", "zig"], '["a", 1]': ['["a"', "1]"], "[broken, x": ["[broken", "x"], '" a "': [" a "], ",,;": [],
    }
    got = values(spark, cases, T.parse_tags)
    for (given, expected), found in zip(cases.items(), got):
        if given != '["a", 1]':
            assert found == expected, given
    assert len(got[6]) == 2  # not an array of strings only: split at the comma


def test_titles(spark):
    got = values(spark, ["Engineer - Acme", "Lead - Data - Big Co", "  Alone  ", " x  -  y "], lambda c: F.struct(*T.split_title(c)))
    assert [tuple(r) for r in got] == [("Engineer", "Acme"), ("Lead", "Data - Big Co"), ("Alone", ""), ("x", "y")]


def test_ages(spark):
    cases = {
        "": None, "today": 0, "Yesterday": 1, "3 days ago": 3, "1 day ago": 1, "2 weeks ago": 14, "1 week ago": 7, "2w": 14, "3": 3, "-4": 0, "5 hours ago": None,
        "1 month ago": None, "2026-03-01": 9, "2026-03-20": 0, "2026-03-01T12:00:00Z": 9, "2026-03-01T13:00:00+00:00": 8, "2026-03-01T12:00:00": None, "1d": None, None: None,
    }
    got = values(spark, cases, lambda c: scores.age_days(c, AS_OF))
    assert dict(zip(cases, got)) == cases


def test_freshness_steps(spark):
    ages = [None, 0, 3, 3.5, 7, 8, 14, 15, 30, 31, 60, 61]
    got = values(spark, ages if all(isinstance(a, str) for a in ages) else [None if a is None else str(a) for a in ages], lambda c: scores.freshness(c.cast("double")))
    assert got == [0.5, 1.0, 1.0, 0.85, 0.85, 0.65, 0.65, 0.35, 0.35, 0.15, 0.15, 0.05]


def test_decay_halves_in_its_half_life(spark):
    got = values(spark, [None, "0", "60", "120"], lambda c: scores.decay(c.cast("double")))
    assert got == pytest.approx([1, 1, 0.5, 0.25])


def test_relevance(spark):
    weights = F.create_map(F.lit("spark"), F.lit(2.0), F.lit("sql"), F.lit(1.0))
    title = ["Spark engineer", "cook", None]
    one = lambda keywords: values(spark, title, lambda c: scores.keyword_relevance(c, F.lit("knows sql"), keywords, weights))
    assert one([]) == [0.0] * 3
    spark_only = one(["spark"])
    assert spark_only[0] == pytest.approx(1.15 / 1.6) and spark_only[1] == 0
    both = one(["spark", "sql"])
    assert both[0] == pytest.approx((1.0 + 0.5 * 0.45) / (1.5 * 1.6)) and both[1] == both[2] == pytest.approx(0.5 * 0.45 / (1.5 * 1.6))


def test_pages(spark):
    got = values(spark, ["<html><head>no</head><BODY><p>A &amp; B</p>\n<b>c</b></BODY>", "plain  text", None, "<body>&amp;lt;"], T.page_text)
    assert got == ["A & B c", "plain text", "", "<"]


def test_urls(spark):
    assert values(spark, ["https://www.Site.com/a?b", "http://x.org", "nothing", None], T.source_of_url) == ["site.com", "x.org", None, None]
    got = values(spark, [" HTTPS://Ex.com ", "http://a.b:80/c?d#e", "https://a.b:8443", "ftp://a.b/", "word"], T.capture_url)
    assert got == ["https://ex.com/", "http://a.b/c?d#e", "https://a.b:8443/", None, None]


def test_listing_states(spark):
    rows = [
        ("https://dk.indeed.com/x", None, None, None, True, "active"), ("https://dk.indeed.com/x", None, None, None, False, "closed"), ("https://dk.indeed.com/x", None, None, 200, None, "unreachable"),
        ("https://a.com", "", "", 404, None, "unreachable"), ("https://a.com", "", "Position has been FILLED", 200, None, "closed"), ("https://a.com", "", "apply", 200, None, "active"),
        ("https://www.linkedin.com/jobs/1", "https://x/expired", "", 200, None, "closed"), ("https://www.linkedin.com/jobs/1", "", "Job not found", 200, None, "unreachable"),
        ("https://www.jobindex.dk/1", "https://www.jobindex.dk/arkiv/1", "", 200, None, "archived"),
    ]
    df = spark.createDataFrame(rows, "url string, final string, body string, http int, found boolean, expected string")
    got = df.select("expected", scores.listing_status(F.col("url"), F.col("final"), F.col("body"), F.col("http"), F.col("found")).alias("got")).collect()
    assert all(r["expected"] == r["got"] for r in got)


def test_deadlines(spark):
    got = values(spark, ["2026-03-08", "2026-03-11", "2026-03-15", "2026-04-30", "never"], lambda c: scores.days_left(c, AS_OF))
    assert got == [-2, 0, 4, 50, None]
    assert values(spark, ["-1", "2", "7", "8"], lambda c: scores.urgency(c.cast("int"))) == ["overdue", "urgent", "soon", "ok"]


def test_model_answers(spark):
    answers = ['```json\n{"Company": " Acme ", "role": "Dev", "workMode": "remote", "tags": ["a", 1, "b"]}\n```', "no json", '{"company": "", "employer": "B"}', "[1]", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    got = {r["i"]: r for r in drafts.drafted(df, F.col("answer")).collect()}
    assert (got[0]["company"], got[0]["title"], got[0]["work_mode"], got[0]["tags"]) == ("Acme", "Dev", "Remote", "a, b")
    assert [got[i]["company"] for i in (1, 2, 3, 4)] == [None, "B", None, None]


def test_components(spark):
    assert values(spark, ["a b+c", "it's (so)!~*", "æ&=", None], T.component_encoded) == ["a%20b%2Bc", "it's%20(so)!~*", "%C3%A6%26%3D", None]


def test_links_and_events(spark):
    df = spark.createDataFrame([(1, "apply", "A & B", None, "2026-02-28"), (2, "party", "A", "T", "2026-02-28"), (3, "start", "A", "T", "soon"), (4, "apply", "A", "T", None)], "id long, kind string, company string, title string, date string")
    cols = [F.col(c) for c in df.columns]
    got = df.select(labels.calendar_event(*cols).alias("e"), labels.deadline_link(*cols[2:]).alias("l")).collect()
    assert '"summary":"Application deadline: A & B — Role"' in got[0]["e"] and '"end":{"date":"2026-03-01"}' in got[0]["e"]
    assert [r["e"] for r in got[1:]] == [None] * 3
    assert got[0]["l"].endswith("text=Application%20Deadline%3A%20A%20%26%20B&dates=20260228/20260228&details=Job%20application") and got[3]["l"] is None


def test_answers_and_errors(spark):
    responses = ['{"candidates": [{"content": {"parts": [{"text": " x "}]}}]}', '{"choices": [{"message": {"content": "y"}}]}', '{"choices": [{"message": {"content": 3}}]}', '{"choices": []}', "no", None]
    assert values(spark, responses, labels.answer_text) == [" x ", "y", None, None, None, None]
    bodies = ['{"error": {"message": "quota"}}', '{"message": "m"}', '{"detail": "d"}', '{"message": 3}', "<html>", " ", None, "z" * 500]
    assert values(spark, bodies, lambda c: labels.http_error(F.lit(500), c)) == ["HTTP 500: quota", "HTTP 500: m", "HTTP 500: d", 'HTTP 500: {"message": 3}', "HTTP 500: <html>", "HTTP 500", "HTTP 500", "HTTP 500: " + "z" * 400]


def test_labels(spark):
    assert values(spark, ["cv", "cover_letter", "x", None], labels.document_label) == ["CV", "Cover Letter", "x", None]
    assert values(spark, ["-3", "0", "2"], lambda c: labels.due_label(c.cast("int"))) == ["Overdue by 3d", "Due in 0d", "Due in 2d"]
    assert values(spark, ["0", "1", "2"], lambda c: labels.counted(c.cast("int"), "result")) == ["0 results", "1 result", "2 results"]
    assert values(spark, ["https://b.x/?capture_url=https%3A%2F%2Fa.b%2F", "https://b.x/?capture_url=", "https://b.x/", None], labels.handed_url) == ["https://a.b/", None, None, None]


def test_choices():
    assert choices.requested_platforms([]) == list(T.PLATFORM_DOMAINS) and choices.requested_platforms(["thehub", "other"]) == ["thehub"]
    assert choices.effective_statuses([]) == choices.STATUSES and choices.effective_statuses(["a"]) == ["a"]
    assert choices.with_planned_status(["Interesting", "x", "Application Sent"]) == ["Interesting", "x", "Plan to Apply", "Application Sent"]
    assert choices.with_planned_status(["Interesting"]) == ["Interesting"]
    assert choices.renamed_status(["a", "b"], 1, "c") == ["a", "c"] and choices.renamed_status(["a", "b"], 1, "") == ["a", "b"]
    assert choices.moved_status(["a", "b"], 0, 1) == ["b", "a"] and choices.moved_status(["a", "b"], 0, -1) == ["a", "b"]
    assert choices.hidden_statuses(["b", "z", "a"], ["a", "b"]) == ["a", "b"] and choices.hidden_statuses("a", ["a"]) == []
    assert choices.toggled_status(["a"], "b", ["b", "a"]) == ["b", "a"] and choices.toggled_status(["a"], "a", ["a"]) == []
    assert choices.visible_columns(["deadline", "company", "x"]) == ["company", "deadline"] and choices.visible_columns(None) == choices.COLUMNS[:6] == choices.visible_columns([])
    assert choices.toggled_column(["title"], "title") == ["title"] and choices.toggled_column(["title"], "company") == ["company", "title"]
    assert choices.clicked_sort("a", True, "a") == ("a", False) and choices.clicked_sort("a", False, "b") == ("b", True)


def test_steps_of_a_url_are_worked_out_once(spark):
    """Each step stands in the expression once a use, not once a path to it: a row's work is that of its steps."""
    for make in (T.capture_url, T.host, T.source_of_url):
        assert str(make(F.col("x"))).count("regexp_extract") < 20
    assert values(spark, ["https://me:p@a.b:443/x/../ü?q= '#", "HTTP://0x7f.1:80\\a b", "ws://a.b/", ""], T.capture_url) == ["https://me:p@a.b/%C3%BC?q=%20%27#", "http://127.0.0.1/a%20b", None, None]
