"""Named queries over the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions import drafts, labels, scores, text as T
from trackwell.operators import items as I
from trackwell.plans import views as V
from trackwell.plans.views import AS_OF, DOCUMENTS, ITEMS, LOG, RESULTS
from trackwell.sources import records as R

NOW = "2001-08-15T12:00:00+00:00"
WORDS = ["The", "of"]
LANES = ["O", "P", "F", "Done"]
_all: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _all[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


TAGS = "list_filter(list_transform(regexp_split_to_array(tags, '[,;|\\n\\t]'), lambda x: lower(trim(trim(trim(x), '\"'), ''''))), lambda x: x != '')"
WHITE = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


AGE = f"""case when s = '' then null when s = 'today' then 0.0::double when s = 'yesterday' then 1.0::double
  when regexp_full_match(trim(replace(replace(s, 'days ago', ''), 'day ago', '')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') then greatest(0.0::double, trim(replace(replace(s, 'days ago', ''), 'day ago', ''))::double)
  when regexp_full_match(trim(replace(replace(replace(s, 'weeks ago', ''), 'week ago', ''), 'w', '')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') then greatest(0.0::double, trim(replace(replace(replace(s, 'weeks ago', ''), 'week ago', ''), 'w', ''))::double * 7)
  when regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}t\\d{{2}}:\\d{{2}}:\\d{{2}}z') then greatest(0.0::double, floor((epoch(timestamp '{AS_OF}') - epoch(replace(replace(s, 't', ' '), 'z', '')::timestamp)) / 86400))
  when regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then greatest(0.0::double, (date '{AS_OF[:10]}' - s::date)::double) end"""
WEIGHTS = f"weights as (select keyword, sum(exp(age * (-ln(2::double) / 60))) as weight from (select unnest({TAGS}) as keyword, greatest(0, date '{AS_OF[:10]}' - created_at::date)::double as age from items) group by keyword)"
DEDUPED = "deduped as (select * from results qualify row_number() over (partition by case when trim(url) = '' then lower(platform) || '|' || lower(title) || '|' || lower(company) else lower(platform) || '|' || lower(url) end order by pos) = 1)"
SCORED = f"""aged as (select *, {AGE} as age from (select *, lower(trim(published_date)) as s from deduped)),
fresh as (select *, case when age is null then 0.5 when age <= 3 then 1.0 when age <= 7 then 0.85 when age <= 14 then 0.65 when age <= 30 then 0.35 when age <= 60 then 0.15 else 0.05 end::double as freshness_score,
  (case when contains(lower(title), 'the of') or contains(lower(description), 'the of') then 0.15 else 0.0 end)::double as joint from aged),
scored as (select *, least(1.0::double, greatest(0.0::double, (
  (case when contains(lower(title), 'the') then 1.0 else 0.0 end::double + case when contains(lower(description), 'the') then 0.45 else 0.0 end::double + joint) +
  (case when contains(lower(title), 'of') then 1.0 else 0.0 end::double + case when contains(lower(description), 'of') then 0.45 else 0.0 end::double + joint)) / 3.2::double)) as keyword_score from fresh),
ranked as (select *, least(1.0::double, greatest(0.0::double, 0.6::double * freshness_score + 0.4::double * keyword_score)) as total_score from scored)"""


@query(f"with {ITEMS} select keyword, count(*) as count from (select unnest({TAGS}) as keyword from items) group by keyword")
def keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.keyword_stats(V.items(spark, sf)).orderBy(F.desc("count"), "keyword")


@query(f"with {ITEMS}, {WEIGHTS} select keyword, round(weight, 6) as weight from weights")
def keyword_weights(spark: SparkSession, sf: str) -> DataFrame:
    return I.keyword_weights(V.items(spark, sf), AS_OF).select("keyword", F.round("weight", 6).alias("weight"))


@query(f"with {ITEMS}, n as (select keyword, count(*) as count from (select unnest({TAGS}) as keyword from items) group by keyword) select keyword, count, round(count / max(count) over (), 6) as weight, round(0.78 + 0.37 * count / max(count) over (), 6)::double as font from n")
def keyword_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return I.keyword_frequency(I.keyword_stats(V.items(spark, sf))).select("keyword", "count", F.round("weight", 6).alias("weight"), F.round("font", 6).alias("font"))


@query(f"with {ITEMS} select workplace_city, count(*) as count from items where workplace_city != '' group by 1")
def location_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return I.locations(V.items(spark, sf)).orderBy(F.desc("count"), "workplace_city")


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    weights = I.keyword_weights(V.items(spark, sf), AS_OF, I.wanted_keywords(WORDS))
    return I.scored(I.deduplicated(V.results(spark, sf)), weights, WORDS, AS_OF)


@query(f"with {RESULTS}, {DEDUPED}, {SCORED} select platform, row_number() over (partition by platform order by total_score desc, pos) as platform_rank, pos, url, round(freshness_score, 6) as freshness_score, round(keyword_score, 6) as keyword_score, round(total_score, 6) as total_score from ranked qualify platform_rank <= 5")
def ranked_top5_per_platform(spark: SparkSession, sf: str) -> DataFrame:
    top = I.top_per_platform(_ranked(spark, sf))
    return top.select("platform", "platform_rank", "pos", "url", *[F.round(c, 6).alias(c) for c in ("freshness_score", "keyword_score", "total_score")])


@query(f"with {RESULTS}, {DEDUPED}, {SCORED} select pos, platform, round(total_score, 6) as total_score from ranked order by ranked.total_score desc, list_position(['jobindex', 'indeed', 'linkedin', 'thehub'], platform), pos limit 5")
def ranked_global_top5(spark: SparkSession, sf: str) -> DataFrame:
    return I.top_overall(_ranked(spark, sf)).select("pos", "platform", F.round("total_score", 6).alias("total_score"))


@query(f"with {RESULTS}, aged as (select *, {AGE} as age from (select *, lower(trim(published_date)) as s from results)) select pos, published_date, age as age_days from aged")
def result_ages(spark: SparkSession, sf: str) -> DataFrame:
    return V.results(spark, sf).select("pos", "published_date", scores.age_days(F.col("published_date"), AS_OF).alias("age_days"))


@query(f"with {RESULTS}, {DEDUPED} select pos, platform, url from deduped")
def dedupe_results(spark: SparkSession, sf: str) -> DataFrame:
    return I.deduplicated(V.results(spark, sf)).select("pos", "platform", "url")


@query(f"with {RESULTS} select pos, platform from results where contains(lower(url), case platform when 'jobindex' then 'jobindex.dk' when 'indeed' then 'indeed.' when 'linkedin' then 'linkedin.com/jobs' else 'thehub.io' end) and not (platform = 'jobindex' and regexp_matches(lower(url || ' ' || title || ' ' || description), 'archive|arkiv|expired|udløbet|not active'))")
def kept_results(spark: SparkSession, sf: str) -> DataFrame:
    return I.kept_results(V.results(spark, sf)).select("pos", "platform")


@query(f"with {ITEMS} select id, company, title from items where (contains(lower(company), '11') or contains(lower(coalesce(title, '')), '11')) and status not in ('F')")
def search_filter(spark: SparkSession, sf: str) -> DataFrame:
    return I.search(V.items(spark, sf), " 11 ", ["F"]).select("id", "company", "title")


def _sorted(name: str, order: str, *args, **kw) -> None:
    sql = f"with {ITEMS} select id, workplace_city, row_number() over (partition by workplace_city order by {order}, id desc) as position from items"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.ranked_in_lanes(V.items(spark, sf), "workplace_city", I.sort_order(*args, **kw)).select("id", "workplace_city", "position")

    run.__name__ = name
    query(sql)(run)


_sorted("sorted_board_text", "nullif(lower(trim(title)), '') desc nulls first, nullif(lower(trim(company)), '') asc nulls last", "title", True, "company", False)
_sorted("sorted_board_date", "deadline desc nulls first, interview_date asc nulls last", "deadline", True, "interview_date", False)
_sorted("sorted_board_priority", "coalesce(priority, -1) desc", "priority", True)
_sorted("sorted_board_status", "coalesce(nullif(list_position(['O', 'P'], status), 0), 3) asc, created_at desc nulls first", "status", False, "created_at", True, statuses=["O", "P"])


@query(f"with {ITEMS}, l as (select unnest(['O', 'P', 'F', 'Done']) as status, unnest([0, 1, 2, 3]) as position) select l.status, position::bigint as position, count(id) as items from l left join items i on i.status = l.status group by 1, 2")
def status_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return I.lanes(V.items(spark, sf), LANES)


@query(f"with {ITEMS} select distinct status, case status when 'O' then 'P' when 'P' then 'F' when 'F' then 'Done' end as next_status from items")
def next_status(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).select("status").distinct().withColumn("next_status", I.next_status(F.col("status"), LANES))


OCCURRENCES = "occurrences as (select id, company, title, 'apply' as kind, deadline as date from items where deadline is not null union all select id, company, title, 'interview', interview_date from items where interview_date is not null union all select id, company, title, 'start', start_date from items where start_date is not null)"


@query(f"with {ITEMS}, {OCCURRENCES} select id, company, title, kind, date from occurrences")
def date_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return I.occurrences(V.items(spark, sf))


GRID = """grid as (select month::date as month, c as cell, c // 7 as week, c % 7 as weekday, case when c - first >= 0 and c - first < n then c - first + 1 end as day
  from (select month, isodow(month) - 1 as first, extract(day from last_day(month)) as n from (select distinct date_trunc('month', deadline::date) as month from items where deadline is not null)), range(42) t(c))"""


@query(f"with {ITEMS}, {GRID} select month, cell, week, weekday, day, case when day is not null then strftime(month, '%Y-%m-') || lpad(day::varchar, 2, '0') end as date_key from grid")
def month_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of every month in which an item has its deadline."""
    return I.month_grids(V.items(spark, sf).select(F.col("deadline").try_cast("date").alias("month")))


@query(f"with {ITEMS}, {OCCURRENCES}, cells as (select c as cell, '1997-03-' || lpad((c - 4)::varchar, 2, '0') as date_key from range(42) t(c) where c - 4 between 1 and 31) select date_key, cell // 7 as week, cell % 7 as weekday, count(id) as occurrences, min(company) as first_company from cells left join occurrences on date = date_key group by 1, 2, 3")
def calendar_month(spark: SparkSession, sf: str) -> DataFrame:
    return I.calendar_month(V.items(spark, sf), 1997, 3)


DAYS = f"trunc((epoch(deadline::timestamp) - epoch(timestamp '{AS_OF}')) / 86400)::bigint"


@query(f"with {ITEMS}, d as (select id, company, {DAYS} as days from items where deadline is not null and status != 'Done') select id, company, days, case when days < 0 then 'overdue' when days <= 2 then 'urgent' when days <= 7 then 'soon' else 'ok' end as urgency, case when days <= 7 then '7' when days <= 14 then '14' end as follow_up from d where days <= 14")
def reminders(spark: SparkSession, sf: str) -> DataFrame:
    return I.reminders(V.items(spark, sf), AS_OF).select("id", "company", "days", "urgency", "follow_up")


@query(f"with {ITEMS}, keyed as (select id, 'u' || url as key from items where url != '' union all select id, 'n' || chr(1) || lower(company) || chr(1) || lower(coalesce(title, '')) from items), two as (select key, min(id) as a, (list(id order by id))[2] as b from keyed group by key having count(*) > 1) select id, min(case when id = a then b else a end) as duplicate_id from keyed join two using (key) group by id")
def first_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    return I.first_duplicates(V.items(spark, sf))


@query(f"with {ITEMS} select lower(company) as company, lower(coalesce(title, '')) as title, min(id) as first_id, count(*) as items from items group by 1, 2 having count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return I.duplicate_groups(V.items(spark, sf))


@query(f"with {LOG} select id, job_id, lag(to_status) over (partition by job_id order by changed_at, id) as from_status, to_status, changed_at from log")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_from_status(V.log(spark, sf)).select("id", "job_id", "from_status", "to_status", "changed_at")


@query(f"with {LOG} select job_id, to_status, changed_at from log qualify row_number() over (partition by job_id order by changed_at desc, id desc) = 1")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return I.latest_status(I.with_from_status(V.log(spark, sf))).select("job_id", "to_status", "changed_at")


@query(f"with {ITEMS} select id, case when id % 4 = 0 then 'Done' else status end as status, case when id % 4 = 0 then '{NOW}' else updated_at end as updated_at from items")
def status_move(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    return I.moved(every, every.where("id % 4 = 0").select("id", F.lit("Done").alias("status")), NOW)[0].select("id", "status", "updated_at")


@query(f"with {ITEMS} select id as job_id, status as from_status, 'P' as to_status, '{NOW}' as changed_at from items where id % 4 = 0 and status != 'P'")
def update_history(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    patch = every.where("id % 4 = 0").select("id", "company", F.lit("P").alias("status"), "title")
    return I.updated(every, patch, ["company", "status", "title"], NOW)[1]


@query(f"with {ITEMS}, {DOCUMENTS}, {LOG} select 'items' as kind, count(*) as rows from items where id % 3 != 0 union all select 'log', count(*) from log where job_id % 3 != 0 union all select 'documents', count(*) from documents_of_items where job_id % 3 != 0")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    gone = every.where("id % 3 = 0").select("id").union(V.log(spark, sf).where("job_id % 3 = 0").select("job_id")).union(V.documents(spark, sf).where("job_id % 3 = 0").select("job_id"))
    left = I.deleted(gone, {"items:id": every.select("id"), "log:job_id": V.log(spark, sf).select("job_id"), "documents:job_id": V.documents(spark, sf).select("job_id")})
    parts = [df.agg(F.lit(name.split(":")[0]).alias("kind"), F.count("*").alias("rows")) for name, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"with {ITEMS}, {DOCUMENTS} select i.id as job_id, 'application' as doc_type, 'cv ' || i.id || '.pdf' as original_name, pdf_path as file_path from items i where pdf_path != '' and not exists (select 1 from documents_of_items d where d.job_id = i.id and d.file_path = i.pdf_path)")
def backfill_documents(spark: SparkSession, sf: str) -> DataFrame:
    return I.backfilled(V.documents(spark, sf), V.items(spark, sf), NOW).drop("created_at")


@query(f"with {ITEMS}, top as (select max(id) as top from items), new as (select *, row_number() over (order by id) as n from items where id % 50 = 0) select top + n as id, company, '{NOW}' as created_at from new, top")
def import_append(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    new = every.where("id % 50 = 0").withColumn("pos", F.col("id")).drop("id", "created_at", "updated_at")
    return I.appended(every, new, NOW).where(F.col("created_at") == NOW).select("id", "company", "created_at")


@query(f"with {ITEMS} select id, case when trim(company) = '' then 'Unknown' else trim(company) end as company, nullif(title, '') as title, coalesce(nullif(status, ''), 'Interesting') as status, deadline from items where trim(company) not in ('', 'Unknown')")
def import_clean(spark: SparkSession, sf: str) -> DataFrame:
    return R.importable(R.coerced(V.items(spark, sf)), from_csv=True).select("id", "company", "title", "status", "deadline")


CELLS = " || ',' || ".join(f"'\"' || replace(coalesce({c}::varchar, ''), '\"', '\"\"') || '\"'" for c in ("id", "company", "title", "status", "deadline", "interview_date", "start_date", "url", "tags"))


@query(f"with {ITEMS} select id, {CELLS} || ',\"\"' as line from items")
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).withColumn("detected_language", F.lit(None).cast("string")).select("id", R.csv_line().alias("line"))


SPACE = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
STRIPPED = f"trim(regexp_replace(replace(regexp_replace(body, '<[^>]*(>|$)', '', 'g'), '>', ''), '{SPACE}', ' ', 'g'))"


@query(f"""with p as (select page_id, substr(html, greatest(instr(lower(html), '<body'), 1)) as body from pages),
s as (select page_id, {STRIPPED} as t from p)
select page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '{SPACE}', ' ', 'g')), 1, 12000) as text from s""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.page_text(F.col("html")).alias("text"))


@query("select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') as source from pages")
def url_source(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.host(F.col("url")).alias("host"), T.source_of_url(F.col("url")).alias("source"))


@query(f"with {ITEMS} select id, case when url is not null then replace(url, 'www.Site', 'www.site') end as url, case when url is not null then 'a ' || (id % 11) end as job_key from items")
def captured_urls(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).select("id", T.capture_url(F.col("url")).alias("url"), T.job_key(F.col("url")).alias("job_key"))


LISTING = "(['https://www.linkedin.com/jobs/1', 'https://jobindex.dk/job/2', 'https://dk.indeed.com/viewjob?jk=3', 'https://other.example/4'])[page_id % 4 + 1]"
FINAL = "case page_id % 3 when 0 then 'https://x.example/expired' when 1 then 'https://jobindex.dk/arkiv/1' else url end"


@query(f"""with p as (select page_id, {LISTING} as u, {FINAL} as f, lower(substr(html, 1, 4096)) as body, case when page_id % 10 = 0 then 404 else 200 end as code from pages)
select page_id, case when page_id % 4 = 2 then 'unreachable' when code >= 400 then 'unreachable'
  when page_id % 4 = 0 then case when contains(f, '/expired') or contains(body, 'no longer accepting applications') then 'closed' when contains(body, 'job not found') or contains(body, 'page not found') then 'unreachable' else 'active' end
  when page_id % 4 = 1 then case when contains(f, '/arkiv') then 'archived' else 'active' end
  when regexp_matches(body, 'job no longer available|no longer accepting|position has been filled|job not found|page not found|404|ikke tilgængelig|stillingen er besat') then 'closed' else 'active' end as listing_status from p""")
def listing_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    urls = F.array(*[F.lit(u) for u in ("https://www.linkedin.com/jobs/1", "https://jobindex.dk/job/2", "https://dk.indeed.com/viewjob?jk=3", "https://other.example/4")])
    final = F.when(k % 3 == 0, "https://x.example/expired").when(k % 3 == 1, "https://jobindex.dk/arkiv/1").otherwise(F.col("url"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    state = scores.listing_status(F.get(urls, (k % 4).cast("int")), final, F.col("html"), F.when(k % 10 == 0, 404).otherwise(200), F.lit(None).cast("boolean"))
    return pages.select("page_id", state.alias("listing_status"))


@query(f"with {ITEMS} select id, company, title, 'Remote' as work_mode, tags, nullif(workplace_city, '') as workplace_city from items")
def llm_partial(spark: SparkSession, sf: str) -> DataFrame:
    i = V.items(spark, sf)
    obj = F.to_json(F.struct(F.lit(" ").alias("company"), F.col("company").alias("employer"), F.col("title").alias("Role"), F.lit(" REMOTE ").alias("workMode"), F.array("tags", F.lit(None)).alias("tags"), F.col("workplace_city").alias("city")))
    got = drafts.drafted(i.select("id", obj.alias("obj")), F.concat(F.lit("```json\n"), F.col("obj"), F.lit("\n```")))
    return got.select("id", "company", "title", "work_mode", "tags", "workplace_city")


@query(f"with {RESULTS} select pos, coalesce(nullif(company, ''), 'Unknown company') as company, nullif(title, '') as title, nullif(url, '') as url, 'Interesting' as status, platform || ', ' || location as tags, platform as source, location as workplace_city from results")
def saved_payload(spark: SparkSession, sf: str) -> DataFrame:
    r = V.results(spark, sf)
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    tags = F.nullif(F.array_join(drafts.place_tags(F.col("platform"), F.col("location")), ", "), F.lit(""))
    return r.select("pos", F.coalesce(some("company"), F.lit("Unknown company")).alias("company"), some("title").alias("title"), some("url").alias("url"), F.lit("Interesting").alias("status"), tags.alias("tags"), some("platform").alias("source"), some("location").alias("workplace_city"))


@query(f"with {RESULTS} select pos as payload_id, 0::bigint as place, url, case when instr(title, ' - ') > 0 then {strip_sql("substr(title, 1, instr(title, ' - ') - 1)")} else {strip_sql('title')} end as title, case when instr(title, ' - ') > 0 then {strip_sql("substr(title, instr(title, ' - ') + 3)")} else '' end as company, description, published_date from results")
def provider_results(spark: SparkSession, sf: str) -> DataFrame:
    r = V.results(spark, sf)
    one = F.struct(F.col("url").alias("link"), "title", F.col("description").alias("snippet"), F.col("published_date").alias("date"))
    payload = r.select(F.col("pos").alias("payload_id"), "platform", "location", F.to_json(F.struct(F.array(one).alias("organic_results"))).alias("payload"))
    got = R.provider_results(payload, "serp")
    return got.select("payload_id", F.col("place").cast("long").alias("place"), "url", "title", "company", "description", "published_date")


@query(f"with {RESULTS} select pos, case platform when 'jobindex' then 'https://www.jobindex.dk/jobsoeg?q=data+%26+ai&where=' when 'indeed' then 'https://www.indeed.com/jobs?q=data+%26+ai&l=' when 'linkedin' then 'https://www.linkedin.com/jobs/search?keywords=data+%26+ai&location=' else 'https://thehub.io/jobs?q=data+%26+ai&city=' end || location as search_url, 'data & ai ' || location || ' site:' || case platform when 'jobindex' then 'jobindex.dk' when 'indeed' then 'indeed.' when 'linkedin' then 'linkedin.com/jobs' else 'thehub.io' end as provider_query from results")
def search_urls(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(F.lit("data &"), F.lit("ai"))
    p, loc = F.col("platform"), F.col("location")
    return V.results(spark, sf).select("pos", T.search_url(p, words, loc, F.lit("com")).alias("search_url"), T.provider_query(p, words, loc).alias("provider_query"))


@query(f"with {RESULTS}, p as (select *, case when pos % 3 = 0 then 1 else 2 end as priority from results) select pos, platform from p qualify priority = min(priority) over (partition by platform)")
def provider_fallback(spark: SparkSession, sf: str) -> DataFrame:
    r = V.results(spark, sf).withColumn("priority", F.when(F.col("pos") % 3 == 0, 1).otherwise(2))
    return I.preferred_provider(r).select("pos", "platform")


@query(f"with {ITEMS} select id, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=Application%20Deadline%3A%20' || replace(company, '#', '%23') || '&dates=' || replace(deadline, '-', '') || '/' || replace(deadline, '-', '') || '&details=' || replace(coalesce(title, 'Job application'), ' ', '%20') as link, strftime(deadline::date + interval 1 day, '%Y-%m-%d') as end_exclusive from items where deadline is not null")
def calendar_links(spark: SparkSession, sf: str) -> DataFrame:
    end = F.date_format(F.date_add(F.col("deadline").try_cast("date"), 1), "yyyy-MM-dd")
    link = labels.deadline_link(F.col("company"), F.col("title"), F.col("deadline"))
    return V.items(spark, sf).where("deadline is not null").select("id", link.alias("link"), end.alias("end_exclusive"))


@query(f"with {ITEMS} select id, regexp_replace(pdf_path, '[^A-Za-z0-9._-]', '_', 'g') as safe_name, 'cv ' || id || '.pdf' as base_name, company || ', ' || id || ' ' || workplace_city as address from items where pdf_path is not null")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pdf_path")
    return V.items(spark, sf).where("pdf_path is not null").select("id", T.safe_file_name(p).alias("safe_name"), T.base_name(p).alias("base_name"), T.address(F.col("company"), F.col("id").cast("string"), F.col("workplace_city")).alias("address"))


@query(f"with {ITEMS}, d as (select id, created_at, date '{AS_OF[:10]}' - created_at::date as n from items) select id, case when n = 0 then 'Today' when n = 1 then 'Yesterday' when n < 7 then n || 'd ago' when n < 31 then (n // 7) || 'w ago' else strftime(created_at::date, '%b %-d') end as label, case when id % 3 = 0 then 'low' when id % 3 = 1 then 'medium' else 'high' end as tone from d")
def labels_of_dates(spark: SparkSession, sf: str) -> DataFrame:
    tone = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 0.45).otherwise(1.2).cast("double")
    return V.items(spark, sf).select("id", scores.relative_date(F.col("created_at"), AS_OF).alias("label"), scores.score_tone(tone).alias("tone"))


@query(f"with {ITEMS}, queue as (select id, url, case when id % 2 = 0 then 'dismissed' else 'pending' end as status from items where id % 8 < 2 and url is not null), new as (select min(id) as id, url from items where url is not null group by url) select id, url, status from queue union all select id, url, 'pending' from new where url not in (select url from queue where status != 'dismissed')")
def capture_queue(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf).where("url is not null")
    queue = every.where("id % 8 < 2").select("id", "url", F.when(F.col("id") % 2 == 0, "dismissed").otherwise("pending").alias("status"))
    return I.enqueued(queue, every.select("id", "url", F.lit("pending").alias("status"))).select("id", "url", "status")
