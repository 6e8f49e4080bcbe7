"""Queries over hostile values: tabs, line ends and no-break spaces at the ends of fields, blank fields, accents, mixed
case, user info and spaces in URLs, model answers with repeated keys. Their SQL states the expected values itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions import drafts, labels as L, scores, text as T
from trackwell.operators import items as I
from trackwell.plans import views as V
from trackwell.plans.queries import query
from trackwell.plans.views import AS_OF, ITEMS, RESULTS
from trackwell.sources import records as R

TAB, LINE, HARD = "\t", "\n", "\xa0"


def _cases(key: str, by: int, values: dict[int, Column], other: Column) -> Column:
    out = None
    for i, v in values.items():
        out = F.when(F.col(key) % by == i, v) if out is None else out.when(F.col(key) % by == i, v)
    return out.otherwise(other)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with hostile titles, companies, deadlines and links."""
    i = V.items(spark, sf)
    title, company, deadline = F.col("title"), F.col("company"), F.col("deadline")
    return i.withColumns({
        "title": _cases("id", 8, {1: F.concat(F.lit("Éclair "), (F.col("id") % 5).cast("string")), 2: F.concat(F.lit(TAB), title), 3: F.lit(TAB), 4: F.concat(F.lit("zoo"), (F.col("id") % 5).cast("string"))}, title),
        "company": _cases("id", 6, {1: F.concat(F.lit(HARD), company, F.lit(LINE)), 2: F.lit(TAB)}, company),
        "deadline": _cases("id", 10, {3: F.lit(LINE), 4: F.concat(F.lit(TAB), deadline)}, deadline),
    })


ODD = f"""{ITEMS}, odd as (select * replace (
  case id % 8 when 1 then 'Éclair ' || (id % 5) when 2 then chr(9) || title when 3 then chr(9) when 4 then 'zoo' || (id % 5) else title end as title,
  case id % 6 when 1 then chr(160) || company || chr(10) when 2 then chr(9) else company end as company,
  case id % 10 when 3 then chr(10) when 4 then chr(9) || deadline else deadline end as deadline) from items)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Results with platforms, titles and companies in mixed case, blank links, and dates with white space around them."""
    r, k = V.results(spark, sf), F.col("pos")
    return r.withColumns({
        "platform": F.when(k % 3 == 0, F.initcap("platform")).otherwise(F.col("platform")), "url": F.when(k % 2 == 0, F.when(k % 4 == 0, TAB)).otherwise(F.col("url")),
        "title": F.concat(F.when(k % 5 == 0, "dev ").otherwise("DEV "), (k % 7).cast("string")), "company": F.when(k % 11 == 0, None).otherwise(F.when(k % 3 == 1, F.upper("company")).otherwise(F.col("company"))),
        "published_date": F.concat(F.lit(TAB), "published_date", F.lit(HARD)),
    })


ODD_RESULTS = f"""{RESULTS}, odd as (select * replace (
  case when pos % 3 = 0 then upper(platform[1]) || platform[2:] else platform end as platform,
  case when pos % 2 = 0 then case when pos % 4 = 0 then chr(9) end else url end as url,
  case when pos % 5 = 0 then 'dev ' else 'DEV ' end || (pos % 7) as title,
  case when pos % 11 = 0 then null when pos % 3 = 1 then upper(company) else company end as company) from results)"""


@query(f"with {ODD_RESULTS} select pos, platform from odd qualify row_number() over (partition by lower(platform) || '|' || case when url is null or url = chr(9) or url = '' then lower(title) || '|' || lower(coalesce(company, '')) else lower(url) end order by pos) = 1")
def odd_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return I.deduplicated(results(spark, sf)).select("pos", "platform")


@query(f"with {RESULTS} select pos, case published_date when 'today' then 0 when 'Yesterday' then 1 when '3 days ago' then 3 when '2w' then 14 when '3 weeks ago' then 21 when '2001-08-01' then 14 when '2001-07-20T08:00:00Z' then 26 when '17' then 17 end::double as age_days from results")
def odd_ages(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("pos", scores.age_days(F.col("published_date"), AS_OF).alias("age_days"))


def _sorted(name: str, order: str, *args) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.ranked_in_lanes(items(spark, sf), "workplace_city", I.sort_order(*args)).select("id", "workplace_city", "position")

    run.__name__ = name
    query(f"with {ODD}, keyed as (select *, case when id % 8 = 3 then null when id % 8 = 2 then lower(substr(title, 2)) else lower(title) end as t, case id % 6 when 2 then null when 1 then lower(substr(company, 2, length(company) - 2)) else lower(company) end as c from odd) select id, workplace_city, row_number() over (partition by workplace_city order by {order}, id desc) as position from keyed")(run)


_sorted("odd_sorted_titles", 't collate "en" asc nulls last, c collate "en" desc nulls first', "title", False, "company", True)
_sorted("odd_sorted_titles_down", 't collate "en" desc nulls first, deadline asc nulls last', "title", True, "deadline", False)


@query(f"""with {ITEMS} select id, 'apply' as kind, deadline as date from items where deadline is not null and id % 10 != 3
union all select id, 'interview', interview_date from items where interview_date is not null union all select id, 'start', start_date from items where start_date is not null""")
def odd_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return I.occurrences(items(spark, sf)).select("id", "kind", "date")


@query(f"with {ITEMS} select id, company from items where id % 6 != 2")
def odd_importable(spark: SparkSession, sf: str) -> DataFrame:
    return R.importable(R.coerced(items(spark, sf)), from_csv=True).select("id", "company")


@query(f"with {ITEMS} select id, case when id % 6 = 2 then 'Unknown' else company end as company from items")
def odd_coerced(spark: SparkSession, sf: str) -> DataFrame:
    return R.coerced(items(spark, sf)).select("id", "company")


@query(f"with {ITEMS} select id, case when id % 4 = 0 then 'Dev - Ops' else 'Dev' end as name, case when id % 4 = 0 then '' else company end as company from items")
def odd_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("id") % 4 == 0, F.lit(f"{TAB}Dev -{HARD}Ops{LINE}")).otherwise(F.concat(F.lit(f"{LINE}Dev{TAB} - {HARD}"), "company", F.lit(TAB)))
    name, company = T.split_title(title)
    return V.items(spark, sf).select("id", F.replace(name, F.lit(HARD), F.lit(" ")).alias("name"), company.alias("company"))


@query(f"""with {ITEMS} select id, case id % 6 when 0 then 'https://me:pw@site' || id || '.com/b/' || id when 1 then 'http://ex' || id || '.com/a?q=' || replace(workplace_city, ' ', '%20')
  when 4 then 'https://' || (id % 256) || '.16.0.1/' when 5 then case when id % 100000 <= 65535 then 'https://ex.com' || case when id % 100000 = 443 then '' else ':' || (id % 100000) end || '/x' end end as url from items""")
def odd_links(spark: SparkSession, sf: str) -> DataFrame:
    """User info, dots, backslashes, spaces, other schemes, no scheme, numbers as hosts, ports, around the items' own values."""
    k, city = F.col("id").cast("string"), F.col("workplace_city")
    link = _cases("id", 6, {
        0: F.concat(F.lit("\n https://me:pw@Site"), k, F.lit(".COM/a/../b/"), k), 1: F.concat(F.lit("http:\\\\ex"), k, F.lit(".com\\a?q="), city), 2: F.concat(F.lit("ftp://ex.com/"), k),
        3: F.concat(city, F.lit(".com/")), 4: F.concat(F.lit("https://"), (F.col("id") % 256).cast("string"), F.lit(".0x10.1")),
    }, F.concat(F.lit("https://ex.com:"), (F.col("id") % 100_000).cast("string"), F.lit("/x")))
    return V.items(spark, sf).select("id", T.capture_url(link).alias("url"))


@query(f"with {ITEMS} select id, case when id % 12 in (0, 2, 3, 4, 5, 9) then company end as company, case id % 12 when 2 then workplace_city || ', b' when 5 then workplace_city || ', u' end as tags from items")
def odd_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with white space around values, raw tabs in strings, fences, repeated keys, numbers for strings, lists for
    objects, no JSON, text after the object, objects inside, none at all, and nothing but numbers and blanks."""
    company, city = F.col("company"), F.col("workplace_city")
    said = _cases("id", 12, {
        0: F.concat(F.lit('\n{"company": "\\t'), company, F.lit(HARD + '"}')), 1: F.concat(F.lit('{"company": "raw' + TAB), company, F.lit('"}')),
        2: F.concat(F.lit('\n ```json\n{"Company": "'), company, F.lit('", "tags": ["'), city, F.lit('", 1, "b"]}\n```\n')), 3: F.concat(F.lit('{"company": "x", "company": "'), company, F.lit('"}')),
        4: F.concat(F.lit('{"company": "x", "company": 5, "employer": "'), company, F.lit('"}')), 5: F.concat(F.lit('{"company": 5, "employer": "'), company, F.lit('", "tags": " '), city, F.lit(', u "}')),
        6: F.concat(F.lit('["'), company, F.lit('"]')), 7: company, 8: F.concat(F.lit('{"company": "'), company, F.lit('"} and more')),
        9: F.concat(F.lit('{"deep": {"company": "no"}, "organization": "'), company, F.lit('"}')), 10: F.lit(None),
    }, F.concat(F.lit('{"tags": [1, '), F.col("id").cast("string"), F.lit('], "keywords": " "}')))
    return drafts.drafted(V.items(spark, sf).withColumn("answer", said).select("id", "answer"), F.col("answer")).select("id", "company", "tags")


@query(f"with {ITEMS} select id, case when id % 3 = 0 then title else 'old' end as title from items")
def odd_merge(spark: SparkSession, sf: str) -> DataFrame:
    new = F.when(F.col("id") % 3 == 0, F.coalesce("title", F.lit("old"))).when(F.col("id") % 3 == 1, F.lit(TAB + HARD))
    kept = F.when((F.col("id") % 3 == 0) & F.col("title").isNull(), None).otherwise(drafts.merged(new, F.lit("old")))
    return V.items(spark, sf).select("id", kept.alias("title"))


@query(f"with {ITEMS} select id, case id % 3 when 0 then 'company' when 1 then 'url' end as missing, case when id % 3 = 0 then 'company' when id % 2 = 0 then 'status' end as form from items")
def capture_problems(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 3
    i = V.items(spark, sf).select("id", F.when(k == 0, TAB).otherwise(F.col("company")).alias("company"), F.when(k == 2, "https://a.b/").when(k == 1, f" {LINE}").alias("url"))
    i = i.withColumn("status", F.when(F.col("id") % 2 == 0, "").otherwise(" "))
    return i.select("id", R.save_problem("company", "url").alias("missing"), R.save_problem("company", "status").alias("form"))


@query(f"with {ITEMS} select id, case when id % 2 = 0 then company end as answer from items")
def odd_answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("id") % 2 == 0, F.col("company")).otherwise(f"{TAB}{HARD}")
    response = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))
    return V.items(spark, sf).select("id", L.answer_text(response).alias("answer"))
