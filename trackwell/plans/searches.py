"""Queries over searches and what comes in from outside: the bundle of a search, payloads and tags of hostile shape,
older files, tables of several generations, weights of any day, names in a locale's order.

The SQL states what the rules of each kind of value give, not how the library reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions import text as T
from trackwell.operators import items as I
from trackwell.plans import views as V
from trackwell.plans.queries import AGE, SCORED, TAGS, WORDS, query
from trackwell.plans.views import AS_OF, ITEMS, RESULTS
from trackwell.sources import records as R
from trackwell.sources.shared import shared_dir

ASKED = ["thehub", "indeed", "other", "jobindex", "linkedin"]
BY_SEARCH = "deduped as (select * from searched qualify row_number() over (partition by search_id, platform || '|' || case when trim(url) = '' then '|' || lower(title) || '|' || lower(company) else lower(url) end order by pos) = 1)"


@query(f"""with {RESULTS}, every as (select coalesce(location, 'none') as search_id, * from results), searched as (select * from every where not (search_id = 'de' and platform = 'thehub') and not (search_id = 'fr' and platform = 'indeed')), {BY_SEARCH}, {SCORED},
placed as (select *, row_number() over (partition by search_id, platform order by total_score desc, pos) as platform_rank, list_position(['thehub', 'indeed', 'jobindex', 'linkedin'], platform) as place from ranked),
best as (select *, row_number() over (partition by search_id order by total_score desc, place, platform_rank) as global_rank from placed),
asked as (select search_id, unnest(['thehub', 'indeed', 'jobindex', 'linkedin']) as platform, location from (select distinct search_id, location from every)),
bare as (select a.* from asked a where not exists (select 1 from searched s where s.search_id = a.search_id and s.platform = a.platform))
select search_id, 'global' as part, platform, global_rank as rank, pos, round(total_score, 6) as total_score, null::varchar as told from best where global_rank <= 5
union all select search_id, 'platform', platform, platform_rank, pos, round(total_score, 6), null from placed where platform_rank <= 5
union all select search_id, 'platform', platform, 0, null, null, null from bare
union all select search_id, 'hint', platform, 0, null, null, 'No API results found for this platform. ' || case platform when 'jobindex' then 'https://www.jobindex.dk/jobsoeg?q=The+of&where=' when 'indeed' then 'https://www.indeed.com/jobs?q=The+of&l=' when 'linkedin' then 'https://www.linkedin.com/jobs/search?keywords=The+of&location=' else 'https://thehub.io/jobs?q=The+of&city=' end || location from bare""")
def search_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """A search for each language: its five best, those of each platform, and hints for platforms without results."""
    every = V.results(spark, sf).withColumn("search_id", F.coalesce("location", F.lit("none")))
    r = every.where("not (search_id = 'de' and platform = 'thehub') and not (search_id = 'fr' and platform = 'indeed')")
    weights = I.keyword_weights(V.items(spark, sf), AS_OF, I.wanted_keywords(WORDS))
    bundle = I.search_bundle(r, every.select("search_id", "location").distinct(), weights, WORDS, AS_OF, ASKED, "com")
    nothing = F.lit(None).cast("string").alias("told")

    def listed(part: str, rows: DataFrame, platform: Column) -> DataFrame:
        return rows.select("search_id", F.lit(part).alias("part"), platform.alias("platform"), F.coalesce(F.col("at") + 1, F.lit(0)).cast("long").alias("rank"), "r.pos", F.round("r.total_score", 6).alias("total_score"), nothing)

    best = listed("global", bundle.select("search_id", F.posexplode("global_top5").alias("at", "r")), F.col("r.platform"))
    each = bundle.select("search_id", F.explode("top5_per_platform").alias("platform", "top"))
    own = listed("platform", each.select("search_id", "platform", F.posexplode_outer("top").alias("at", "r")), F.col("platform"))
    hints = bundle.select("search_id", F.explode("fallback_hints").alias("platform", "hint"))
    told = hints.select("search_id", F.lit("hint").alias("part"), "platform", F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("total_score"), F.concat_ws(" ", "hint.reason", "hint.browser_url").alias("told"))
    return best.union(own).union(told)


@query(f"""with {RESULTS}, searched as (select location as search_id, * from results), {BY_SEARCH}, {SCORED}
select pos, search_id, row_number() over (partition by search_id order by total_score desc, list_position(['jobindex', 'indeed', 'linkedin', 'thehub'], platform), pos) as position from ranked""")
def all_ranked(spark: SparkSession, sf: str) -> DataFrame:
    r = V.results(spark, sf).withColumn("search_id", F.col("location"))
    weights = I.keyword_weights(V.items(spark, sf), AS_OF, I.wanted_keywords(WORDS))
    ranked = I.scored(I.deduplicated(r, "search_id"), weights, WORDS, AS_OF)
    return I.all_ranked(ranked, lane="search_id").select("pos", "search_id", "position")


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A payload for each result, its fields inside payloads of every shape that JSON allows."""
    r, k = V.results(spark, sf), F.col("pos")
    item = F.to_json(F.struct(F.col("url").alias("link"), F.col("company").alias("title"), F.lit(5).alias("snippet"), F.array("published_date").alias("date")))
    number = F.concat(F.lit('{"link": '), k.cast("string"), F.lit(', "title": "no link"}'))
    wrapped = lambda *parts: F.concat(F.lit('{"organic_results": ['), *parts, F.lit("]}"))
    shapes = {0: wrapped(item), 1: F.concat(F.lit('{"organic_results": '), item, F.lit("}")), 2: wrapped(F.lit("7, null, "), item, F.lit(', ["x"], "y"')), 3: F.concat(F.lit("["), item, F.lit("]")),
              4: wrapped(number, F.lit(", "), item), 5: F.lit('{"organic_results": null}'), 6: F.concat(F.lit(' "'), k.cast("string"), F.lit('"\n'))}
    payload = F.lit("{}")
    for i, shape in shapes.items():
        payload = F.when(k % 8 == i, shape).otherwise(payload)
    return r.select(k.alias("payload_id"), "platform", "location", payload.alias("payload"))


@query(f"""with {RESULTS}, p as (select pos as payload_id, unnest(case pos % 8 when 0 then [0] when 2 then [2] when 4 then [1] else [] end) as place, url, company from results)
select payload_id, place::int as place, url, coalesce(company, 'Untitled') as title, '' as description, '' as published_date from p where url != ''""")
def odd_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Lists that are objects, items that are numbers, nulls or lists, links that are numbers, lists on top, bare strings."""
    return R.provider_results(_payloads(spark, sf), "serp").where("url != ''").select("payload_id", "place", "url", "title", "description", "published_date")


@query(f"""with {RESULTS}, kept as (select * from results where url != '' and platform = 'jobindex'),
found as (select pos // 8 as search_id, platform, case when pos % 3 = 0 then 'brave' else 'serp' end as provider, pos, url from kept where not regexp_matches(lower(url || ' ' || coalesce(title, '') || ' ' || coalesce(description, '')), 'archive|arkiv|expired|udløbet|not active'))
select search_id, platform, pos, url from found qualify provider = max(provider) over (partition by search_id, platform)""")
def platform_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two providers' payloads for each search and platform: the first one counts if it has a result that is kept."""
    r = V.results(spark, sf).withColumn("search_id", F.floor(F.col("pos") / 8)).withColumn("provider", F.when(F.col("pos") % 3 == 0, "brave").otherwise("serp"))
    serp = F.struct(F.col("url").alias("link"), "title", F.col("description").alias("snippet"), F.col("pos").cast("string").alias("date"))
    brave = F.struct("url", "title", "description", F.col("pos").cast("string").alias("page_age"))
    lists = r.groupBy("search_id", "platform", "provider").agg(F.max("location").alias("location"), F.collect_list(serp).alias("s"), F.collect_list(brave).alias("b"))
    payload = F.when(F.col("provider") == "serp", F.to_json(F.struct(F.col("s").alias("organic_results")))).otherwise(F.to_json(F.struct(F.struct(F.col("b").alias("results")).alias("web"))))
    got = R.platform_results(lists.select("search_id", "platform", "provider", "location", payload.alias("payload")), ["serp", "brave"])
    return got.select("search_id", "platform", F.col("published_date").cast("long").alias("pos"), "url")


_OPEN = "'[\"' || lower(city)"


@query(f"""with {ITEMS}, i as (select id, workplace_city as city from items), t as (select id, unnest(case id % 8
  when 0 then [lower(city), 'x'] when 1 then [{_OPEN}, 'b', 'c"]'] when 2 then [{_OPEN} || '\\q', 'c"]'] when 3 then ['[' || {_OPEN}, 'd"]]'] when 4 then ['[1', lower(city) || '"]']
  when 5 then [{_OPEN} || '"] x'] when 6 then [{_OPEN}, 'null]'] else []::varchar[] end) as tag from i) select id, tag from t""")
def odd_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Lists with raw line ends, unknown escapes, lists inside, numbers, what follows the list, nulls, and none at all."""
    c, k = F.col("workplace_city"), F.col("id") % 8
    shapes = {0: F.concat(F.lit(' ["'), c, F.lit('", " X\\t", ""]\n')), 1: F.concat(F.lit('["'), c, F.lit('\nb","c"]')), 2: F.concat(F.lit('["'), c, F.lit('\\q","c"]')), 3: F.concat(F.lit('[["'), c, F.lit('","d"]]')),
              4: F.concat(F.lit('[1,"'), c, F.lit('"]')), 5: F.concat(F.lit('["'), c, F.lit('"] x')), 6: F.concat(F.lit('["'), c, F.lit('",null]'))}
    tags = F.lit("[ ]")
    for i, shape in shapes.items():
        tags = F.when(k == i, shape).otherwise(tags)
    return V.items(spark, sf).select("id", F.explode(T.parse_tags(tags)).alias("tag"))


def _weights_sql(day: str) -> str:
    return f"select '{day}' as day, keyword, round(sum(exp(greatest(0, date '{day}' - created_at::date)::double * (-ln(2::double) / 60))), 6) as weight from (select unnest({TAGS}) as keyword, created_at from items) group by keyword"


_DAYS = ("1995-06-30", "1998-08-02", "2001-08-15")


@query(f"with {ITEMS} " + " union all ".join(_weights_sql(d) for d in _DAYS))
def weights_of_days(spark: SparkSession, sf: str) -> DataFrame:
    """The keywords' weights on three days, from partials of two parts of the items that were merged."""
    every = V.items(spark, sf)
    partials = I.merged_partials(I.weight_partials(every.where("id % 3 = 0")), I.weight_partials(every.where("id % 3 != 0")))
    parts = [I.weights_on(partials, d).select(F.lit(d).alias("day"), "keyword", F.round("weight", 6).alias("weight")) for d in _DAYS]
    return parts[0].union(parts[1]).union(parts[2])


_DANISH = "case id % 7 when 0 then 'Ørsted' when 1 then 'Åse' when 2 then 'Æble' when 3 then 'zoo' when 4 then 'ægir' when 5 then 'Oase' else 'øre' end || ' ' || (id % 3)"


@query(f"with {ITEMS}, named as (select id, workplace_city, {_DANISH} as name from items) select id, name, row_number() over (partition by workplace_city order by lower(name) collate \"da\", id desc) as position from named")
def danish_board(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Ørsted", "Åse", "Æble", "zoo", "ægir", "Oase", "øre")])
    company = F.concat(F.get(names, (F.col("id") % 7).cast("int")), F.lit(" "), (F.col("id") % 3).cast("string"))
    named = V.items(spark, sf).withColumn("company", company)
    return I.ranked_in_lanes(named, "workplace_city", I.sort_order("company", False, locale="da")).select("id", F.col("company").alias("name"), "position")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"with {ITEMS} select company, case when id % 2 = 0 then title end as title, status, deadline, case when id % 2 = 1 then tags end as tags from items where deadline is not null and title is not null")
def older_files(spark: SparkSession, sf: str) -> DataFrame:
    """Items in older CSV files of a folder: half of the files have other columns in another order."""
    path, i = _fresh(spark, "older"), V.items(spark, sf).where("deadline is not null and title is not null")
    for n, (rest, columns) in enumerate(((0, ("status", "company", "deadline", "title")), (1, ("company", "tags", "status", "deadline", "unknown")))):
        cells = i.where(F.col("id") % 2 == rest).withColumn("unknown", F.lit("u"))
        _headed(cells.select(R.csv_line(columns).alias("line")), ",".join(f'"{c}"' for c in columns)).write.text(f"{path}/{n}")
    return R.read_legacy_csv(spark, f"{path}/*").select("company", "title", "status", "deadline", "tags")


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """lines (line) with the head before the first one of each partition, so of each file that is written."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    return lines.select("line", first.alias("first")).select(F.explode(F.when(F.col("first"), F.array(F.lit(head), F.col("line"))).otherwise(F.array("line"))).alias("line"))
