"""Places over ranges, versions of tables, readers of older files and generations, the bundle of a search."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trackwell.functions import scores
from trackwell.functions import text as T
from trackwell.operators import items as I
from trackwell.operators.ranks import ranged, ranked, ranked_in
from trackwell.sources import records as R, versions


def test_a_lane_of_all_rows_is_dealt_over_ranges(spark):
    """One status for all rows, many equal heads: no range holds more than a few times its share."""
    rows = spark.range(20_000).select("id", F.lit("Open").alias("status"), (F.col("id") % 3).alias("head"), F.concat(F.lit("n"), F.col("id") * 7919 % 20_000).alias("name"))
    order = [F.col("head").desc(), F.collate("name", "UNICODE"), F.col("id").desc()]
    sizes = [r["count"] for r in ranged(rows, [F.col("status"), *order], parts=16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    names = sorted(((-(i % 3), f"n{i * 7919 % 20_000}", -i) for i in range(20_000)))
    want = {-i: n + 1 for n, (_, _, i) in enumerate(names)}
    for got in (ranked(rows, order, parts=16), ranked_in(rows, "status", order, parts=16)):
        assert {r["id"]: r["position"] for r in got.select("id", "position").collect()} == want


def test_lanes_with_nulls_and_none(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "id long, lane string")
    got = {r["id"]: r["position"] for r in ranked_in(rows, "lane", [F.col("id").desc()], parts=3).collect()}
    assert got == {3: 1, 1: 2, 4: 1, 2: 2, 5: 1}
    assert ranked(rows.limit(0), [F.col("id")]).count() == 0


def test_locales(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(("Øst", "zoo", "Åse", "Æble", "apple", "Oase"))], "id long, title string")
    names = lambda **kw: [r["title"] for r in I.sorted_items(rows, "title", False, **kw).collect()]
    assert names() == ["Æble", "apple", "Åse", "Oase", "Øst", "zoo"]
    assert names(locale="da") == ["apple", "Oase", "zoo", "Æble", "Øst", "Åse"]


# versions


def store(spark, tmp_path, rows=1000, files=8):
    path = f"file://{tmp_path}/store"
    log = spark.range(rows).select("id", (F.col("id") * 37 % 100).alias("job_id"), F.lit("Saved").alias("to_status"))
    items = spark.range(100).select("id", F.lit("Saved").alias("status"))
    assert versions.committed(spark, path, {"items": items, "history": log}, {"history": ["job_id", "id"]}, files=files) == 1
    return path


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = store(spark, tmp_path)
    items, log = versions.table(spark, path, "items"), versions.table(spark, path, "history")
    moved = {"items": items.withColumn("status", F.lit("Done")), "history": log.where("id < 5")}

    def stop(*_):
        raise RuntimeError("stopped between write and swap")

    with monkeypatch.context() as m:
        m.setattr(versions, "_put", stop)
        with pytest.raises(RuntimeError):
            versions.committed(spark, path, moved)
    assert versions.numbers(spark, path) == [1]
    assert versions.table(spark, path, "items").where("status = 'Done'").count() == 0 and versions.table(spark, path, "history").count() == 1000
    assert versions.committed(spark, path, moved) == 2
    assert versions.table(spark, path, "items").where("status = 'Done'").count() == 100 and versions.table(spark, path, "history").count() == 5
    assert versions.table(spark, path, "history", version=1).count() == 1000


def test_of_two_writers_one_fails(spark, tmp_path):
    path = store(spark, tmp_path)
    first = versions._manifest(spark, path, 1)
    versions._put(spark, path, 2, first)
    with pytest.raises(Exception, match="(?i)exist"):
        versions._put(spark, path, 2, {})
    assert versions._manifest(spark, path, 2) == first


def test_a_table_that_did_not_change_stays(spark, tmp_path):
    path = store(spark, tmp_path)
    versions.committed(spark, path, {"items": versions.table(spark, path, "items").where("id < 3")})
    assert versions.table(spark, path, "history").count() == 1000 and versions.table(spark, path, "items").count() == 3
    gone = versions.swept(spark, path)
    assert len(gone) == 1 and versions.numbers(spark, path) == [2] and versions.table(spark, path, "history").count() == 1000


def test_a_look_up_reads_one_file_of_many(spark, tmp_path):
    path = store(spark, tmp_path)
    assert len(versions.table(spark, path, "history").inputFiles()) == 8
    for key in (0, 50, 99):
        found = versions.table(spark, path, "history", key=key)
        assert len(found.inputFiles()) == 1
        assert sorted(r["id"] for r in found.collect()) == [i for i in range(1000) if i * 37 % 100 == key]
    assert versions.table(spark, path, "history", key=1000).count() == 0
    with pytest.raises(ValueError):
        versions.table(spark, path, "items", key=1)


# readers


def test_older_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"company","title","status"\r\n"A","T","S"\n\n"B","U",""\n')
    (tmp_path / "b.csv").write_text('\n"status", "unknown" ,"company"\nApplied,x,C\n"status", "unknown" ,"company"\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("title\nno company\n")
    got = sorted((r["company"], r["title"], r["status"]) for r in R.read_legacy_csv(spark, str(tmp_path)).collect())
    assert got == [("A", "T", "S"), ("B", "U", "Interesting"), ("C", None, "Applied")]


def test_generations(spark, tmp_path):
    spark.createDataFrame([(1, "5"), (2, None)], "id long, priority string").write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([(3, 7, "n", "x")], "id int, priority long, notes string, gone string").write.parquet(f"{tmp_path}/new")
    schema = spark.createDataFrame([], "id long, priority long, notes string").schema
    rows, changes = R.read_generations(spark, [f"{tmp_path}/old", f"{tmp_path}/new"], schema)
    assert sorted(map(tuple, rows.collect())) == [(1, 5, None), (2, None, None), (3, 7, "n")]
    assert [c[1:] for c in changes] == [("priority", "string to bigint"), ("notes", "added"), ("id", "int to bigint"), ("gone", "left out")]
    spark.createDataFrame([(9, "high")], "id long, priority string").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="can't be bigint: high"):
        R.read_generations(spark, [f"{tmp_path}/bad"], schema)[0].collect()
    assert R.read_generations(spark, [], schema)[0].count() == 0


PAYLOADS = (
    ('{"organic_results": {}}', []), ('{"organic_results": [5, null, {"link": 5, "title": "t"}, {"link": "u", "title": "T - C", "date": ["d"]}]}', [("", "Untitled"), ("", "Untitled"), ("", "t"), ("u", "T")]),
    ("[1]", []), ("5", []), ('"s"', []), ("null", []), ("{}", []), (' {"organic_results": []} ', []),
)


def test_odd_payloads(spark):
    df = spark.createDataFrame([(i, "p", "x", p) for i, (p, _) in enumerate(PAYLOADS)], "payload_id int, platform string, location string, payload string")
    got = [(r["payload_id"], r["url"], r["title"]) for r in R.provider_results(df, "serp").orderBy("payload_id", "place").collect()]
    assert got == [(i, *x) for i, (_, found) in enumerate(PAYLOADS) for x in found]
    for bad in ("not json", "", '{"a": 1} x', '{"a": 1}, {"a": 2}', "{'a': 1}"):
        with pytest.raises(Exception, match="not JSON"):
            R.provider_results(spark.createDataFrame([(1, "p", "x", bad)], df.schema), "serp").collect()


def test_providers_one_after_another(spark):
    serp = lambda *urls: json.dumps({"organic_results": [{"link": u, "title": "T"} for u in urls]})
    brave = lambda *urls: json.dumps({"web": {"results": [{"url": u, "title": "B"} for u in urls]}})
    rows = [
        (1, "indeed", "serp", serp("https://dk.indeed.com/1", "https://other.example/")), (1, "indeed", "brave", brave("https://dk.indeed.com/2")), (1, "thehub", "serp", serp("https://other.example/")),
        (1, "thehub", "brave", brave("https://thehub.io/1")), (1, "jobindex", "serp", serp("https://jobindex.dk/arkiv/1")), (2, "indeed", "serp", serp("https://dk.indeed.com/3")), (2, "indeed", "brave", "broken"),
    ]
    df = spark.createDataFrame([(s, p, v, "Aarhus", x) for s, p, v, x in rows], "search_id long, platform string, provider string, location string, payload string")
    found = lambda providers: sorted((r["search_id"], r["platform"], r["url"]) for r in R.platform_results(df, providers).collect())
    assert found(["serp", "brave"]) == [(1, "indeed", "https://dk.indeed.com/1"), (1, "thehub", "https://thehub.io/1"), (2, "indeed", "https://dk.indeed.com/3")]
    assert found(["serp"]) == [(1, "indeed", "https://dk.indeed.com/1"), (2, "indeed", "https://dk.indeed.com/3")]
    with pytest.raises(Exception, match="not JSON"):
        found(["brave", "serp"])
    with pytest.raises(ValueError):
        found([])


# the bundle


def test_bundle_of_ties_and_empty_platforms(spark):
    """All scores tie: the platform asked first comes first, whatever the positions say; platforms without results get a hint."""
    rows = [("s", i, p, f"T{i}", "C", "Aarhus", f"https://{p}/{i}", "d", "today") for i, p in enumerate(["indeed"] * 7 + ["thehub"] * 3)] + [("s", 50, "thehub", "T", "C", "Aarhus", "https://THEHUB/9", "d", "today")]
    results = spark.createDataFrame(rows, "search_id string, pos long, platform string, title string, company string, location string, url string, description string, published_date string")
    searches = spark.createDataFrame([("s", "Aarhus"), ("none", "")], "search_id string, location string")
    weights = spark.createDataFrame([("t", 2.0)], "keyword string, weight double")
    bundle = {r["search_id"]: r for r in I.search_bundle(results, searches, weights, ["T"], "2026-03-10 12:00:00", ["thehub", "other", "indeed", "thehub", "linkedin"]).collect()}
    one = bundle["s"]
    assert [r["pos"] for r in one["global_top5"]] == [7, 8, 9, 0, 1]
    assert {p: [r["pos"] for r in top] for p, top in one["top5_per_platform"].items()} == {"thehub": [7, 8, 9], "indeed": [0, 1, 2, 3, 4], "linkedin": []}
    assert list(one["fallback_hints"]) == ["linkedin"] and one["fallback_hints"]["linkedin"]["browser_url"] == "https://www.linkedin.com/jobs/search?keywords=T&location=Aarhus"
    assert bundle["none"]["global_top5"] == [] and len(bundle["none"]["fallback_hints"]) == 3
    empty = I.search_bundle(results, searches, weights, [], "2026-03-10 12:00:00", []).collect()
    assert all(r["global_top5"] == [] and r["top5_per_platform"] == {} and r["fallback_hints"] == {} for r in empty)


def test_weights_of_any_day(spark):
    rows = [("a;b", "2026-03-01"), ("a", "2026-03-01T13:00:00Z"), ("a", "2026-03-01T11:00:00+00:00"), ("b", "3 days ago"), ("b", "never"), ("a", None), ("c", "2030-01-01"), ('["A", "c"]', "2026-02-28")]
    items = spark.createDataFrame(rows, "tags string, created_at string")
    half = lambda *keep: items.where(F.col("created_at").isin(*keep) if keep else "true")
    partials = I.merged_partials(I.weight_partials(items.where("created_at > '2026-03-01'"), "12:00:00"), I.weight_partials(items.where("not coalesce(created_at > '2026-03-01', false)"), "12:00:00"))
    for day in ("2026-02-01", "2026-03-02", "2026-03-10", "2031-01-01"):
        want = {r["keyword"]: r["weight"] for r in I.keyword_weights(half(), f"{day} 12:00:00").collect()}
        assert {r["keyword"]: r["weight"] for r in I.weights_on(partials, day).collect()} == pytest.approx(want)


# texts


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


HOSTS = {
    "https://münchen.de/": "xn--mnchen-3ya.de", "https://BÜCHER.example/": "xn--bcher-kva.example", "https://例え.テスト/": "xn--r8jz45g.xn--zckzah", "https://a。b/": "a.b", "https://ex%2ecom/": "ex.com", "https://%C3%BC.de/": "xn--tda.de",
    "https://1.2.3/": "1.2.0.3", "https://0x7f.1/": "127.0.0.1", "https://0177.0.0.1/": "127.0.0.1", "https://2130706433/": "127.0.0.1", "https://0x7f000001/": "127.0.0.1", "https://1.2.3.4./": "1.2.3.4",
    "https://255.255.255.255/": "255.255.255.255", "https://256.1.1.1/": None, "https://1.2.3.256/": None, "https://1.2.3.4.5/": None, "https://4294967296/": None, "https://1.16777216/": None, "https://09/": None,
    "https://a.1/": None, "https://1.a/": "1.a", "https://0x/": "0.0.0.0", "https://a%20b/": None, "https://a%zz/": None, "https://[::1]/": "[::1]", "https://plain.example./": "plain.example.", "https://me@ex.com:1/": "ex.com",
}


def test_hosts_as_browsers_write_them(spark):
    got = dict(zip(HOSTS, values(spark, HOSTS, T.host)))
    assert got == HOSTS
    links = values(spark, ["https://münchen.de:443/ü", "http://0x7f.1", "https://1.2.3.999/"], T.capture_url)
    assert links == ["https://xn--mnchen-3ya.de/%C3%BC", "http://127.0.0.1/", None]


def test_white_space_by_either_rule(spark):
    odd = ["﻿a﻿", "\x85a\x85", "\xa0 a　", "\t\x0b\x0c\r\n a"]
    assert values(spark, odd, T.stripped) == ["a", "\x85a\x85", "a", "a"]
    assert values(spark, odd, T.trimmed) == ["﻿a﻿", "a", "a", "a"]
    assert values(spark, ["﻿today", "\x85today"], lambda c: scores.age_days(c, "2026-03-10 12:00:00")) == [None, 0.0]


TAGS = {
    '["a\nb","c"]': ['["a', "b", 'c"]'], '["a\\q","c"]': ['["a\\q', 'c"]'], '["a"] x': ['["a"] x'], '["a"],["b"]': ['["a"]', '["b"]'], "[null]": ["[null]"], '["a",null]': ['["a', "null]"], "[]": [], "[ ]": [],
    '["a\\u0041\\n"]': ["aa"], "['a']": ["['a']"], '[["a"]]': ['[["a"]]'], "[1]": ["[1]"], '["A, B"]': ["a, b"], '{"a": "b"}': ['{"a": "b"}'], '["x",]': ['["x', "]"],
}


def test_tags_by_their_types(spark):
    assert dict(zip(TAGS, values(spark, TAGS, T.parse_tags))) == TAGS


def test_dates_by_elapsed_days(spark):
    cases = {"2026-03-09T23:00:00Z": "Today", "2026-03-09T00:29:00Z": "Yesterday", "2026-03-10": "Today", "2026-03-09": "Yesterday", "2026-03-04": "6d ago", "2026-03-03": "1w ago", "2026-02-07": "Feb 7", "soon": "soon", "": "", None: None}
    assert dict(zip(cases, values(spark, cases, lambda c: scores.relative_date(c, "2026-03-10 00:30:00")))) == cases


def test_answers_are_parsed_once(spark):
    """The usual answer costs one parse; the other one in the plan is only for what no fence holds."""
    from trackwell.functions import drafts

    df = spark.createDataFrame([("x",)], "answer string")
    plan = drafts.drafted(df, F.col("answer"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2
    answers = ['{"company": "a", "Company": "b"}', '{"Company": "b"}', '{"company": "a"}, {"company": "b"}', '{"company": NaN}', '```json\n{"title": "t"}\n```', '{"notes": "```"}', '{"company": "a", "notes": {"x": 1, "x": 2}}']
    rows = drafts.drafted(spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string"), F.col("answer")).orderBy("i").collect()
    assert [(r["company"], r["title"], r["notes"]) for r in rows] == [("a", None, None), ("b", None, None), (None, None, None), (None, None, None), (None, "t", None), (None, None, "```"), ("a", None, None)]


# Links as they are given, and as a browser writes them (null: no link).
LINKS = (
    ("https://example.com/job", "https://example.com/job"), ("http://example.com", "http://example.com/"), ("", None), ("example.com/job", None), ("ftp://example.com/job", None),
    ("https://me:pw@Ex.com/a", "https://me:pw@ex.com/a"), ("https://ex.com/ü b?q=ü 'x#fr ag", "https://ex.com/%C3%BC%20b?q=%C3%BC%20%27x#fr%20ag"), ("\n\thttps://ex.com", "https://ex.com/"),
    ("https://ex.com/a/../b/./c", "https://ex.com/b/c"), ("https://ex.com:443/", "https://ex.com/"), ("http:\\\\ex.com\\a", "http://ex.com/a"), ("https://exa mple.com/", None), ("https://a:99999/", None),
    ("HTTPS://Ex.COM:8443?x#", "https://ex.com:8443/?x#"), ("https://ex.com/a{b}^`", "https://ex.com/a%7Bb%7D%5E%60"), ("https://[::1]:8080/x", "https://[::1]:8080/x"), (None, None),
)


def test_links(spark):
    assert values(spark, [a for a, _ in LINKS], T.capture_url) == [b for _, b in LINKS]


# Model answers, with the company and the tags that they hold.
ANSWERS = (
    ('\n{"company": "\\tAcme\xa0"}', "Acme", None), ('{"company": "raw\ttab"}', None, None), ('\n ```json\n{"Company": "X", "tags": ["a", 1, "b"]}\n```\n', "X", "a, b"), ('{"company": "a", "company": "b"}', "b", None),
    ('{"company": "a", "company": 5, "employer": "e"}', "e", None), ('{"company": 5, "employer": "E", "tags": " t, u "}', "E", "t, u"), ("[1]", None, None), ("not json", None, None),
    ('{"company": "a"} and more', None, None), ('{"deep": {"company": "no"}, "organization": "Org"}', "Org", None), (None, None, None), ('{"tags": [1, 2], "keywords": " "}', None, None),
)


def test_answers(spark):
    from trackwell.functions import drafts

    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, answer string")
    got = drafts.drafted(df, F.col("answer")).orderBy("i").collect()
    assert [(r["company"], r["tags"]) for r in got] == [a[1:] for a in ANSWERS]


def test_odd_answers_take_every_shape(spark, small):
    """The query's items give all twelve shapes of ANSWERS, around their own values."""
    import __spark_entry__

    known, tagged = set(), set()
    for r in __spark_entry__.queries()["odd_answers"](spark, small).collect():
        known |= {r["id"] % 12} if r["company"] else set()
        tagged |= {r["id"] % 12} if r["tags"] else set()
    assert known == {i for i, a in enumerate(ANSWERS) if a[1]} and tagged == {i for i, a in enumerate(ANSWERS) if a[2]}


def test_lines_of_a_file_stay_where_they_are_read(spark, tmp_path):
    """The lines of a file aren't dealt to one task, and their cells are worked out once."""
    (tmp_path / "a.csv").write_text('"company","title"\n' + '"A, ""x""","T"\n' * 3)
    read = R.read_legacy_csv(spark, str(tmp_path))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "strategy=broadcast" in plan
    assert [(r["company"], r["title"]) for r in read.collect()] == [('A, "x"', "T")] * 3


def test_each_older_file_has_its_head(spark, tmp_path):
    from trackwell.plans.searches import _headed

    lines = spark.range(0, 90, 1, 9).where("id < 60").selectExpr("cast(id as string) line")
    _headed(lines, "head").write.text(f"{tmp_path}/files")
    files = [p.read_text().split() for p in (tmp_path / "files").glob("part-*")]
    assert all(f[0] == "head" and f.count("head") == 1 for f in files if f) and sorted(int(x) for f in files for x in f[1:]) == list(range(60))
    assert sum(map(bool, files)) == 6


def test_files_of_a_store_follow_its_size(spark, small):
    """A store's tables go to as many files as Spark deals ranges, not to a fixed number of tasks."""
    from trackwell.plans.stores import _store

    held = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        noted = versions._manifest(spark, _store(spark, small), 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(noted["items"]["files"]) == len(noted["history"]["files"]) == 12
    lows = sorted(f[1] for f in noted["items"]["files"])
    assert all(high < low for high, low in zip(sorted(f[2] for f in noted["items"]["files"]), lows[1:]))
