"""Ordered relations with their positions, lanes and cells with their items, drafts, payloads, schemas, choices.

Rows have no order of their own in a result: a query whose order matters has a column for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions import choices, drafts, labels as L, scores, text as T
from trackwell.operators import items as I
from trackwell.plans import views as V
from trackwell.plans.boards import QUEUE, _queue
from trackwell.plans.queries import DAYS, LANES, NOW, OCCURRENCES, query
from trackwell.plans.views import AS_OF, DOCUMENTS, ITEMS, RESULTS
from trackwell.sources import records as R


@query(f"with {ITEMS}, d as (select id, updated_at, {DAYS} as days from items where deadline is not null and status != 'Done') select id, days, row_number() over (order by days, updated_at desc, id desc) as position from d where days <= 14")
def ordered_reminders(spark: SparkSession, sf: str) -> DataFrame:
    return I.ordered_reminders(V.items(spark, sf), AS_OF).select("id", "days", "position")


@query(f'with {ITEMS}, {OCCURRENCES} select id, kind, date, row_number() over (order by date, company collate "en", updated_at desc, id desc, kind) as position from occurrences join (select id, updated_at from items) using (id)')
def ordered_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return I.ordered_occurrences(V.items(spark, sf)).select("id", "kind", "date", "position")


@query(f"with {ITEMS}, {QUEUE} select id, created_at, row_number() over (order by created_at desc, id) as position from queue")
def ordered_queue(spark: SparkSession, sf: str) -> DataFrame:
    return I.ordered_queue(_queue(spark, sf)).select("id", "created_at", "position")


@query(f"with {ITEMS} select id, created_at, row_number() over (order by created_at desc, priority is null, priority desc, id desc) as position from items")
def ordered_board(spark: SparkSession, sf: str) -> DataFrame:
    order = [*I.sort_keys("priority", True, LANES), F.desc("id")]
    return I.placed(V.items(spark, sf), F.col("created_at"), True, order).select("id", "created_at", "position")


@query(f"with {ITEMS}, l as (select unnest(['Done', 'O', 'P']) as lane, unnest([0, 1, 2]) as lane_position) select lane, lane_position::bigint as lane_position, id, case when id is not null then row_number() over (partition by lane order by updated_at desc, id desc) end as place from l left join items on status = lane")
def lane_items(spark: SparkSession, sf: str) -> DataFrame:
    return I.items_in_lanes(V.items(spark, sf), ["Done", "O", "P"], [F.desc("updated_at"), F.desc("id")]).select("lane", "lane_position", "id", "place")


@query(f"""with {ITEMS}, {OCCURRENCES}, cells as (select c as cell, case when c - 4 between 1 and 31 then c - 4 end as day, case when c - 4 between 1 and 31 then '1997-03-' || lpad((c - 4)::varchar, 2, '0') end as date_key from range(42) t(c))
select cell, day, date_key, id, kind, case when id is not null then row_number() over (partition by date_key order by company collate "en", updated_at desc, id desc, kind) end as place from cells left join (select * from occurrences join (select id, updated_at from items) using (id)) on date = date_key""")
def calendar_cells(spark: SparkSession, sf: str) -> DataFrame:
    return I.calendar_cells(V.items(spark, sf), 1997, 3).select("cell", "day", "date_key", "id", "kind", "place")


@query(f"with {ITEMS}, {OCCURRENCES} select o.id, o.kind, o.date, i.status, i.url from occurrences o left join items i on i.id = o.id and i.id % 4 != 0")
def occurrence_items(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    return I.items_of_occurrences(I.occurrences(every), every.where("id % 4 != 0")).select("id", "kind", "date", "status", "url")


@query(f"with {DOCUMENTS}, d as (select *, id % 10 * 20 as job, strftime(date '2001-01-01' + (id * 7919 % 1000)::int, '%Y-%m-%d') as created_at from documents_of_items) select id, doc_type, file_path, created_at, row_number() over (order by created_at, id) as position from d where job = 80")
def documents_of_item(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    created = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (k * 7919 % 1000).cast("int")), "yyyy-MM-dd")
    d = V.documents(spark, sf).withColumns({"job_id": k % 10 * 20, "created_at": created})
    return I.ranked(I.documents_of(d, 80), list(I.OLDEST_FIRST)).select("id", "doc_type", "file_path", "created_at", "position")


@query(f"with {ITEMS} select id, updated_at, row_number() over (order by updated_at desc, id desc) as position from items")
def listed_items(spark: SparkSession, sf: str) -> DataFrame:
    return I.ranked(V.items(spark, sf), [F.desc("updated_at"), F.desc("id")]).select("id", "updated_at", "position")


@query(f"""with {ITEMS} select id, url, coalesce(case when id % 4 > 1 and url is not null then company end, '') as company, case when id % 4 > 1 and url is not null then title end as title, case when url is not null then lower(regexp_extract(url, '//www\\.([^/]+)', 1)) end as source,
  'Interesting' as status, case when id % 4 != 0 then 'text of ' || id end as raw_text, case when id % 4 = 0 then 'fetch_failed' when id % 4 = 1 then 'extract_failed' end as reason from items where url is not null""")
def capture_drafts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 4
    i = V.items(spark, sf).where("url is not null")
    page = F.when(k == 0, F.lit("\t")).otherwise(F.concat(F.lit("\n text of "), F.col("id").cast("string")))
    answer = F.when(k == 1, "no fields").otherwise(F.to_json(F.struct(F.col("company").alias("employer"), "title", F.lit(" ").alias("url"))))
    given = i.select("id", F.col("url").alias("link"), page.alias("page"), answer.alias("answer"))
    got = drafts.capture_drafts(given, F.col("link"), F.col("page"), F.col("answer"), F.lit("Interesting"))
    return got.select("id", "url", "company", "title", "source", "status", "raw_text", "reason")


@query(f"with {RESULTS} select pos, case when pos % 3 = 0 and url != '' then 'page ' || pos else nullif(trim(description, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') end as raw_text from results")
def saved_texts(spark: SparkSession, sf: str) -> DataFrame:
    page = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("\tpage "), F.col("pos").cast("string"))).when(F.col("pos") % 3 == 1, F.lit("\n"))
    return V.results(spark, sf).select("pos", drafts.listing_text(F.col("url"), page, F.col("description")).alias("raw_text"))


@query(f"with {ITEMS} select company, title, url, status, deadline, interview_date, start_date, tags, priority, workplace_city from items")
def editable_items(spark: SparkSession, sf: str) -> DataFrame:
    return R.editable(V.items(spark, sf)).select("company", "title", "url", "status", "deadline", "interview_date", "start_date", "tags", "priority", "workplace_city")


_NULLS = ", ".join(f"null::varchar as {c}" for c in ("raw_text", "detected_language", "notes", "contact_name", "contact_email", "contact_phone", "workplace_street", "workplace_postal_code", "work_mode", "salary_range", "contract_type", "reference_number", "source", "listing_status", "listing_checked_at"))


@query(f"with {ITEMS} select id, company, title, url, status, deadline, interview_date, start_date, tags, workplace_city, priority, pdf_path, created_at, updated_at, {_NULLS} from items")
def whole_items(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_schema(V.items(spark, sf), R.ITEM_SCHEMA)


@query(f"with {ITEMS}, top as (select max(id) as top from items) select top + row_number() over (order by hash_pos) as id, company, '{NOW}' as created_at, '{NOW}' as updated_at from (select *, (id * 2654435761) % 1000003 * 1000000 + id as hash_pos from items where id % 40 = 0), top")
def created_items(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    new = every.where("id % 40 = 0").withColumn("pos", F.expr("id * 2654435761 % 1000003 * 1000000 + id")).drop("id", "created_at", "updated_at")
    return I.appended(every, new, NOW, blank_companies=True).where(F.col("created_at") == NOW).select("id", "company", "created_at", "updated_at")


@query(f"with {ITEMS} select id, case when id % 4 = 0 then company || '!' else company end as company, case when id % 4 = 0 then 'P' else status end as status, case when id % 4 = 0 then '{NOW}' else updated_at end as updated_at from items")
def update_items(spark: SparkSession, sf: str) -> DataFrame:
    every = V.items(spark, sf)
    patch = I.present(every.where("id % 4 = 0").select("id", F.concat(F.lit("\t"), "company", F.lit("! ")).alias("company"), F.lit("P").alias("status")), every)
    return I.updated(every, patch, ["company", "status"], NOW)[0].select("id", "company", "status", "updated_at")


@query(f"""with {ITEMS}, {OCCURRENCES} select id, kind, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=' || case kind when 'apply' then 'Application%20deadline' when 'interview' then 'Interview' else 'Role%20start' end || '%3A%20' || replace(company, '#', '%23')
  || '&dates=' || replace(date, '-', '') || '/' || replace(date, '-', '') || '&details=' || replace(coalesce(title, 'trackwell'), ' ', '%20') as link from occurrences""")
def template_links(spark: SparkSession, sf: str) -> DataFrame:
    link = L.template_link(F.col("date"), L.template_summary(F.col("kind"), F.col("company")), F.col("title"))
    return I.occurrences(V.items(spark, sf)).select("id", "kind", link.alias("link"))


@query(f"with {ITEMS} select id, case when id % 5 = 0 then 'not a date'[:10] else strftime(created_at::date, '%b %-d, %Y') end as added from items")
def added_dates(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("id") % 5 == 0, "not a date at all").when(F.col("id") % 5 == 1, F.concat("created_at", F.lit("T08:00:00Z"))).otherwise(F.col("created_at"))
    return V.items(spark, sf).select("id", scores.added_date(given).alias("added"))


@query(f"with {ITEMS}, {OCCURRENCES} select (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow(date::date)] as label, count(*) as occurrences from occurrences group by 1")
def weekday_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in choices.WEEKDAYS])
    day = F.weekday(F.col("date").try_cast("date"))
    return I.occurrences(V.items(spark, sf)).groupBy(F.get(names, day).alias("label")).agg(F.count("*").alias("occurrences"))


@query(f"with {ITEMS} select id, company as listing, 20 as keys, 3 as work_modes, true as dates from items")
def model_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What a prompt ends with, and how many of the output's keys and work modes it names before."""
    p = V.items(spark, sf).select("id", drafts.prompt(F.col("company")).alias("p"))
    asked = F.substring_index("p", "Listing:\n", 1)
    named = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: asked.contains(w)))
    return p.select("id", F.substring_index("p", "Listing:\n", -1).alias("listing"), named(drafts.ALIASES).alias("keys"), named(set(drafts.WORK_MODES.values())).alias("work_modes"), asked.contains("YYYY-MM-DD").alias("dates"))


@query(f"with {ITEMS} select id, company, title, deadline from items where status not in ('P', 'F')")
def visible_board(spark: SparkSession, sf: str) -> DataFrame:
    hidden = choices.toggled_status(choices.hidden_statuses(["F", "other"], LANES), "P", LANES)
    columns = choices.toggled_column(choices.visible_columns(["deadline", "company", "other"]), "title")
    return I.search(V.items(spark, sf), choices.search_query("  "), hidden).select("id", *columns)


@query(f"with {ITEMS} select id, workplace_city, row_number() over (partition by workplace_city order by deadline asc nulls last, id desc) as position from items")
def clicked_board(spark: SparkSession, sf: str) -> DataFrame:
    key, down = choices.clicked_sort("deadline", True, "deadline")
    return I.ranked_in_lanes(V.items(spark, sf), "workplace_city", I.sort_order(key, down)).select("id", "workplace_city", "position")


@query(f"with {ITEMS}, l as (select unnest(['P', 'O', 'Done']) as status, unnest([0, 1, 2]) as position) select l.status, position::bigint as position, count(id) as items from l left join items i on i.status = l.status group by 1, 2")
def chosen_lanes(spark: SparkSession, sf: str) -> DataFrame:
    lanes = choices.moved_status(choices.renamed_status(choices.effective_statuses(["O", "P", "F"]), 2, "Done"), 0, 1)
    return I.lanes(V.items(spark, sf), choices.with_planned_status(lanes))


@query(f"with {RESULTS} select pos, platform from results where platform in ('indeed', 'thehub')")
def requested_platforms(spark: SparkSession, sf: str) -> DataFrame:
    wanted = choices.requested_platforms(choices.toggled(["indeed", "other"], "thehub"))
    return V.results(spark, sf).where(F.col("platform").isin(wanted)).select("pos", "platform")


@query(f"with {ITEMS} select id as item, 'Acme ' || id as company, case when id % 2 = 0 then 'Applied' else 'Interesting' end as status, null::varchar as notes from items union all select id, 'Unknown', 'Interesting', 'n' from items")
def imported_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    payload = F.concat(F.lit('[{"company": " Acme '), k.cast("string"), F.lit('\\t", "status": "'), F.when(k % 2 == 0, "Applied").otherwise(""), F.lit('"}, {"company": null, "notes": "n"}]'))
    got = R.imported(V.items(spark, sf).select(k.alias("item"), payload.alias("payload")), F.col("payload"))
    return got.select("item", "company", "status", "notes")


@query(f"with {ITEMS} select id, to_json(struct_pack(id := id, company := company, title := title, status := status, deadline := deadline, interview_date := interview_date, start_date := start_date, url := url, tags := tags, detected_language := null)) as line from items")
def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return V.items(spark, sf).withColumn("detected_language", F.lit(None).cast("string")).select("id", R.json_line().alias("line"))




@query(f"with {ITEMS}, {QUEUE} select id, case when url is null then '' else lower(regexp_extract(url, '//([^/]+)', 1)) end as host from queue")
def queue_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).select("id", T.host(F.col("url")).alias("host"))
