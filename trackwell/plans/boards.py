"""More named queries: scans and lookups, labels, patches, the capture queue, calendar events, answers and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions import drafts, labels as L
from trackwell.operators import items as I
from trackwell.plans import views as V
from trackwell.plans.queries import DAYS, NOW, OCCURRENCES, TAGS, query, strip_sql
from trackwell.plans.views import DOCUMENTS, ITEMS, LOG, RESULTS
from trackwell.sources import records as R

ITEM = 7  # the item that lookups ask for


@query(f"with {ITEMS} select * from items")
def list_items(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).orderBy(F.desc("updated_at"), F.desc("id"))


@query(f"with {ITEMS} select id, company, title, status, deadline, pdf_path from items where id = {ITEM}")
def item_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).where(F.col("id") == ITEM).select("id", "company", "title", "status", "deadline", "pdf_path")


@query(f"with {LOG} select id, to_status, changed_at, row_number() over (order by changed_at desc, id desc) as position from log where job_id = {ITEM}")
def history_of_item(spark: SparkSession, sf: str) -> DataFrame:
    own = V.log(spark, sf).where(F.col("job_id") == ITEM).select("id", "to_status", "changed_at")
    return I.ranked(own, [F.desc("changed_at"), F.desc("id")])


@query(f"with {DOCUMENTS} select job_id, id, case doc_type when 'cv' then 'CV' else doc_type end as label from documents_of_items")
def document_labels(spark: SparkSession, sf: str) -> DataFrame:
    return V.documents(spark, sf).select("job_id", "id", L.document_label(F.col("doc_type")).alias("label"))


@query(f"with {RESULTS} select platform, count(*) as results, count(*) || case when count(*) = 1 then ' result' else ' results' end as label from results group by platform")
def platform_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = V.results(spark, sf).groupBy("platform").agg(F.count("*").alias("results"))
    return n.withColumn("label", L.counted(F.col("results"), "result"))


@query(f"with {RESULTS} select pos, case when url != '' then platform || '|' || url else platform || '|' || coalesce(title, '') || '|' || coalesce(company, '') || '|' || coalesce(location, '') || '|' || published_date end as key from results")
def result_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = L.result_key(*[F.col(c) for c in ("platform", "url", "title", "company", "location", "published_date")])
    return V.results(spark, sf).select("pos", key.alias("key"))


@query(f"with {ITEMS} select id, case when id % 6 = 0 then 'company,status' when id % 2 = 0 then 'company' when id % 3 = 0 then 'status' else '' end as missing from items")
def export_problems(spark: SparkSession, sf: str) -> DataFrame:
    i = V.items(spark, sf).withColumn("company", F.when(F.col("id") % 2 != 0, F.col("company"))).withColumn("status", F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("status")))
    return i.select("id", F.array_join(R.missing_fields(), ",").alias("missing"))


@query(f"with {ITEMS} select id, company, coalesce(title, '-') as title, coalesce(priority::varchar, '-') as priority, coalesce(deadline, '-') as deadline, coalesce(start_date, '-') as start_date from items")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).select("id", "company", *[L.cell(F.col(c)).alias(c) for c in ("title", "priority", "deadline", "start_date")])


@query(f"with {ITEMS} select bool_or(coalesce(deadline, interview_date, start_date) is not null) as any_date from items")
def any_date(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).agg(F.bool_or(F.coalesce(*I.DATES.values()).isNotNull()).alias("any_date"))


@query(f"with {ITEMS} select id, case when id % 3 = 1 then ' New ' || id else title end as title, coalesce(case when id % 2 = 0 then 'n' end, workplace_city) as workplace_city from items")
def patch_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    new = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" New "), k.cast("string")))
    return V.items(spark, sf).select("id", drafts.merged(new, F.col("title")).alias("title"), drafts.merged(F.when(k % 2 == 0, "n"), F.col("workplace_city")).alias("workplace_city"))


@query(f"with {ITEMS} select id, updated_at, case when id % 5 = 0 then 'closed' end as listing_status, case when id % 5 = 0 then '{NOW}' end as listing_checked_at from items")
def listing_write(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    found = every.where("id % 5 = 0").select("id", F.lit("closed").alias("listing_status"))
    return I.checked(every, found, NOW).select("id", "updated_at", "listing_status", "listing_checked_at")


QUEUE = "queue as (select id, url, case id % 5 when 0 then 'pending' when 1 then 'ready' when 2 then 'failed' when 3 then 'accepted' else 'dismissed' end as status, created_at from items where url is not null)"


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(s) for s in ("pending", "ready", "failed", "accepted", "dismissed")]), (F.col("id") % 5).cast("int"))
    return V.items(spark, sf).where("url is not null").select("id", "url", status.alias("status"), "created_at")


@query(f"with {ITEMS}, {QUEUE} select case when status in ('accepted', 'dismissed') then 'history' else 'active' end as part, status, count(*) as entries, max(created_at) as newest from queue group by all")
def capture_parts(spark: SparkSession, sf: str) -> DataFrame:
    return I.queue_parts(_queue(spark, sf)).groupBy("part", "status").agg(F.count("*").alias("entries"), F.max("created_at").alias("newest"))


@query(f"with {ITEMS}, {QUEUE} select id, case when id % 10 = 0 then 'ready' else status end as status, case when id % 10 = 0 then '{NOW}' else created_at end as updated_at from queue")
def capture_patch(spark: SparkSession, sf: str) -> DataFrame:
    queue = _queue(spark, sf).withColumn("updated_at", F.col("created_at"))
    patch = queue.where("id % 10 = 0").select("id", F.lit("ready").alias("status"))
    return I.patched(queue, patch, NOW).select("id", "status", "updated_at")


@query(f"""with {ITEMS}, {OCCURRENCES} select id, kind, '{{"summary":"' || case kind when 'apply' then 'Application deadline' when 'interview' then 'Interview' else 'Role start' end || ': ' || company || ' — ' || coalesce(title, 'Role')
  || '","description":"Synced from trackwell (item id ' || id || ', ' || kind || ').","start":{{"date":"' || date || '"}},"end":{{"date":"' || strftime(date::date + interval 1 day, '%Y-%m-%d') || '"}}}}' as event from occurrences""")
def calendar_events(spark: SparkSession, sf: str) -> DataFrame:
    event = L.calendar_event(*[F.col(c) for c in ("id", "kind", "company", "title", "date")])
    return I.occurrences(V.items(spark, sf)).select("id", "kind", event.alias("event"))


@query(f"with {ITEMS} select id, case when id % 3 = 0 or id % 3 = 1 then ' ' || company end as answer from items")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    told, k = F.concat(F.lit(" "), F.col("company")), F.col("id")
    one = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(told.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    two = F.to_json(F.struct(F.array(F.struct(F.struct(told.alias("content")).alias("message"))).alias("choices")))
    response = F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise('{"choices": [{"message": {"content": " "}}]}')
    return V.items(spark, sf).select("id", L.answer_text(response).alias("answer"))


@query(f"with {ITEMS} select id, 'HTTP 429' || case id % 5 when 4 then '' when 3 then ': plain ' || company else ': ' || company end as error from items")
def http_errors(spark: SparkSession, sf: str) -> DataFrame:
    c, k = F.col("company"), F.col("id")
    body = F.when(k % 5 == 0, F.to_json(F.struct(F.struct(c.alias("message")).alias("error")))).when(k % 5 == 1, F.to_json(F.struct(c.alias("message")))).when(k % 5 == 2, F.to_json(F.struct(c.alias("detail"))))
    body = body.when(k % 5 == 3, F.concat(F.lit("plain "), c)).otherwise("  ")
    return V.items(spark, sf).select("id", L.http_error(F.lit(429), body).alias("error"))


@query(f"with {ITEMS} select id, url as handed from items")
def handed_urls(spark: SparkSession, sf: str) -> DataFrame:
    link = F.concat(F.lit("https://board.example/?a=1&capture_url="), F.coalesce(F.url_encode("url"), F.lit("")), F.lit("#top"))
    return V.items(spark, sf).select("id", L.handed_url(link).alias("handed"))


@query(f"with {ITEMS} select id, id || '|' || company || ' \"x\"|' || status as cells from items")
def csv_quirks(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("id").cast("string"), F.lit(',,"'), F.col("company"), F.lit(' ""x""", '), F.col("status"))
    return V.items(spark, sf).select("id", F.array_join(R.csv_cells(line), "|").alias("cells"))


@query(f"with {ITEMS}, d as (select id, {DAYS} as days from items where deadline is not null and status != 'Done') select id, case when days < 0 then 'Overdue by ' || abs(days) || 'd' else 'Due in ' || days || 'd' end as label, case when days <= 7 then 'Suggested follow-up: ~7 days' else 'Suggested follow-up: ~14 days' end as hint from d where days <= 14")
def reminder_labels(spark: SparkSession, sf: str) -> DataFrame:
    r = I.reminders(V.items(spark, sf), V.AS_OF)
    return r.select("id", L.due_label(F.col("days")).alias("label"), L.follow_up_label(F.col("follow_up")).alias("hint"))


@query(f"with {ITEMS} select id, printf('Fresh %.2f · Keyword %.2f · Total %.2f', (id % 101) / 101, (id % 103) / 103, (id % 107) / 107) as label from items")
def score_labels(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).select("id", L.score_breakdown(*[(F.col("id") % n) / n for n in (101, 103, 107)]).alias("label"))


@query(f"with {ITEMS} select id, case when id % 12 != 0 then coalesce(contains(url, 'jk=a%203'), false) end as found from items")
def listing_by_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("id") % 12 != 0, "jk=a%203")
    return V.items(spark, sf).select("id", L.found_by_key(F.array(F.lit("https://dk.example/viewjob?jk=z"), "url"), key).alias("found"))


@query(f"with {ITEMS}, s as (select keyword, count(*) as count from (select unnest({TAGS}) as keyword from items) group by keyword), t as (select 'keyword' as kind, keyword as value from s order by count desc, keyword limit 5), c as (select 'city' as kind, workplace_city as value from items where workplace_city != '' group by 2 order by count(*) desc, 2 limit 1) select * from t union all select * from c")
def preselected(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    words = I.keyword_stats(every).orderBy(F.desc("count"), "keyword").limit(5)
    city = I.locations(every).orderBy(F.desc("count"), "workplace_city").limit(1)
    return words.select(F.lit("keyword").alias("kind"), F.col("keyword").alias("value")).union(city.select(F.lit("city"), "workplace_city"))


@query(f"with {ITEMS}, s as (select keyword, count(*) as count from (select unnest({TAGS}) as keyword from items) group by keyword) select * from s union all select 'own word', 0")
def custom_keywords(spark: SparkSession, sf: str) -> DataFrame:
    stats = I.with_custom_keyword(I.with_custom_keyword(I.keyword_stats(V.items(spark, sf)), " Own Word "), "Building")
    return I.without_custom_keyword(I.without_custom_keyword(I.with_custom_keyword(stats, "gone"), "gone"), "machinery")


@query(f"with {RESULTS} select pos as payload_id, url, case when instr(title, ' - ') > 0 then {strip_sql("substr(title, 1, instr(title, ' - ') - 1)")} else {strip_sql('title')} end as title, description, published_date from results where pos % 2 = 0")
def provider_results_second(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct("url", "title", "description", F.col("published_date").alias("page_age"))
    full = F.to_json(F.struct(F.struct(F.array(one).alias("results")).alias("web")))
    payload = V.results(spark, sf).select(F.col("pos").alias("payload_id"), "platform", "location", F.when(F.col("pos") % 2 == 0, full).otherwise("{}").alias("payload"))
    return R.provider_results(payload, "brave").select("payload_id", "url", "title", "description", "published_date")


@query(f"with {ITEMS} select id, company, null::varchar as listing_status, priority from items")
def schema_evolution(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.createDataFrame([], "id long, company string, listing_status string, priority long").schema
    return I.with_schema(V.items(spark, sf), schema)


@query(f"with {ITEMS} select count(*) as imported from items where id % 3 != 0")
def import_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.items(spark, sf).withColumn("company", F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("company")))
    return R.importable(rows).agg(F.count("*").alias("imported"))
