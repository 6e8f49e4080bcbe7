"""Relations over items: filters, order, duplicates, statistics, boards, calendars, reminders, history, changes.

Every function maps DataFrames to DataFrames. All stay lazy but those that number rows (ranked_in_lanes, placed,
items_in_lanes, ordered_*, calendar_cells, appended, all_ranked): ranges of the order are written to the shared folder
first. Where the first of several counts, `pos` or `id` says which one is first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwell.functions import scores, text as T
from trackwell.functions.choices import STATUSES
from trackwell.operators.ranks import ranked, ranked_in

DATES = {"apply": "deadline", "interview": "interview_date", "start": "start_date"}


def search(items: DataFrame, query: str = "", hidden: list[str] | None = None) -> DataFrame:
    """Items whose company or title contains the trimmed query in any case, without the hidden statuses."""
    q = query.strip().lower()
    if q:
        items = items.where(F.lower(F.col("company")).contains(q) | F.lower(T.text("title")).contains(q))
    return items.where(~F.col("status").isin(hidden)) if hidden else items


def sort_keys(key: str, descending: bool, statuses: list[str], locale: str = "UNICODE") -> list[Column]:
    """The order of one key: blanks last upwards and first downwards; no priority counts as -1; unknown statuses last.

    Texts are ordered as a reader would: trimmed, whatever their case, accents beside their base letters or, with the
    reader's locale (`da`, `sv`, `de`), where that language has them."""
    if key == "priority":
        c = F.coalesce("priority", F.lit(-1))
        return [c.desc() if descending else c.asc()]
    if key == "status":
        at = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
        c = F.when(at > 0, at).otherwise(len(statuses) + 1)
        return [c.desc() if descending else c.asc()]
    dates = key in ("created_at", "deadline", "interview_date", "start_date")
    c = F.nullif(F.col(key), F.lit("")) if dates else T.lower_order(F.col(key), locale)
    return [c.desc_nulls_first() if descending else c.asc_nulls_last()]


def sort_order(primary: str, descending: bool, secondary: str | None = None, secondary_descending: bool = False, statuses: list[str] | None = None, locale: str = "UNICODE") -> list[Column]:
    second = sort_keys(secondary, secondary_descending, statuses or STATUSES, locale) if secondary else []
    return [*sort_keys(primary, descending, statuses or STATUSES, locale), *second, F.col("id").desc()]


def sorted_items(items: DataFrame, *args, **kw) -> DataFrame:
    return items.orderBy(*sort_order(*args, **kw))


def ranked_in_lanes(items: DataFrame, lane: str, order: list[Column]) -> DataFrame:
    return ranked_in(items, lane, order)


def placed(rows: DataFrame, head: Column, descending: bool, rest: list[Column], name: str = "position") -> DataFrame:
    """rows with their place in a global order, from 1: by head, then by rest."""
    return ranked(rows, [head.desc() if descending else head.asc(), *rest], name)


def first_duplicates(items: DataFrame) -> DataFrame:
    """(id, duplicate_id): for each item with a duplicate the smallest other id with the same URL, or with the same
    company and title in lower case (no title counts as an empty one).

    Both keys of an item come from one pass. A key gives its two smallest ids, ranks that are cut to two before the
    shuffle, never its pairs."""
    url = F.when(F.col("url") != "", F.concat(F.lit("u"), F.col("url")))
    name = F.concat_ws("\x01", F.lit("n"), F.lower("company"), F.lower(T.text("title")))
    keyed = items.select("id", F.explode(F.array_compact(F.array(url, name))).alias("key"))
    least = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where("n <= 2")
    two = least.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    pairs = keyed.join(two, "key")
    return pairs.groupBy("id").agg(F.min(F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("duplicate_id"))


def duplicate_groups(items: DataFrame) -> DataFrame:
    """(company, title, first_id, items) of each company and title that several items share."""
    keys = [F.lower("company").alias("company"), F.lower(T.text("title")).alias("title")]
    return items.groupBy(*keys).agg(F.min("id").alias("first_id"), F.count("*").alias("items")).where("items > 1")


def deduplicated(results: DataFrame, *by: str) -> DataFrame:
    """The first result by pos of each platform and URL in lower case (without URL: platform, title and company, in
    lower case too). A null field counts as an empty one. One aggregation, combined before its shuffle. by: columns
    whose values keep results apart."""
    blank = T.trimmed(T.text("url")) == ""
    fields = [F.lower(T.text(c)) for c in ("platform", "url", "title", "company")]
    key = F.when(blank, F.concat_ws("|", fields[0], *fields[2:])).otherwise(F.concat_ws("|", *fields[:2]))
    best = results.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], key.alias("_key")).agg(F.min_by(F.struct(*results.columns), "pos").alias("_best"))
    return best.select("_best.*")


def keyword_stats(items: DataFrame) -> DataFrame:
    return items.where("tags != ''").select(F.explode(T.parse_tags(F.col("tags"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("count"))


def keyword_weights(items: DataFrame, as_of: str, keywords: list[str] | None = None) -> DataFrame:
    """(keyword, weight): the decayed counts of all keywords, or of some. Tags are counted by keyword and date first, so
    that an age is worked out once a date."""
    own = items.where("tags != ''").select("created_at", F.explode(T.parse_tags(F.col("tags"))).alias("keyword"))
    own = own.where(F.col("keyword").isin(keywords)) if keywords is not None else own
    dated = own.groupBy("keyword", "created_at").agg(F.count("*").alias("n"))
    return dated.groupBy("keyword").agg(F.sum(F.col("n") * scores.decay(scores.age_days(F.col("created_at"), as_of))).alias("weight"))


def weight_partials(items: DataFrame, time_of_day: str = "00:00:00") -> DataFrame:
    """(keyword, day, age, n): what keyword_weights needs of items for every day at a time of day (UTC).

    day: the day on which a row is new at that time; null where the age doesn't depend on the day asked for (age, in
    days; null counts as new). As many rows as keywords and days, however many items."""
    anchor = f"1970-01-01 {time_of_day}"
    own = items.where("tags != ''").select("created_at", F.explode(T.parse_tags(F.col("tags"))).alias("keyword"))
    dated = own.groupBy("keyword", "created_at").agg(F.count("*").alias("n"))
    day, age = scores.birthday(F.col("created_at"), anchor)
    return dated.select("keyword", day.alias("day"), age.alias("age"), "n").groupBy("keyword", "day", "age").agg(F.sum("n").alias("n"))


def merged_partials(*partials: DataFrame) -> DataFrame:
    """Partials of several parts of the items (a day's new rows and what was there) as one."""
    every = partials[0]
    for p in partials[1:]:
        every = every.unionByName(p)
    return every.groupBy("keyword", "day", "age").agg(F.sum("n").alias("n"))


def weights_on(partials: DataFrame, day: str) -> DataFrame:
    """keyword_weights of a day (YYYY-MM-DD) at the partials' time of day, without the items."""
    since = F.greatest(F.lit(0), F.datediff(F.lit(day).cast("date"), F.col("day"))).cast("double")
    age = F.when(F.col("day").isNotNull(), since).otherwise(F.col("age"))
    return partials.groupBy("keyword").agg(F.sum(F.col("n") * scores.decay(age)).alias("weight"))


def keyword_frequency(stats: DataFrame) -> DataFrame:
    """keyword_stats with weight (share of the largest count) and font size."""
    top = stats.agg(F.max("count").alias("top"))
    share = F.col("count") / F.greatest(F.col("top"), F.lit(1))
    return stats.crossJoin(F.broadcast(top)).select("keyword", "count", share.alias("weight"), (share * 0.37 + 0.78).alias("font"))  # one row


def locations(items: DataFrame) -> DataFrame:
    return items.where("workplace_city != ''").groupBy("workplace_city").agg(F.count("*").alias("count"))


def wanted_keywords(keywords: list[str]) -> list[str]:
    """The keywords whose weights scores look up."""
    return sorted({x for k in keywords for x in (k, k.lower())})


def scored(results: DataFrame, weights: DataFrame, keywords: list[str], as_of: str) -> DataFrame:
    """results with age_days, freshness_score, keyword_score and total_score. weights: (keyword, weight)."""
    wanted = wanted_keywords(keywords)
    mine = weights.where(F.col("keyword").isin(wanted)).agg(F.map_from_entries(F.collect_list(F.struct("keyword", "weight"))).alias("_w"))  # as many as keywords
    out = results.crossJoin(F.broadcast(mine)).withColumn("age_days", scores.age_days(T.text("published_date"), as_of))
    out = out.withColumn("freshness_score", scores.freshness(F.col("age_days")))
    out = out.withColumn("keyword_score", scores.keyword_relevance(F.col("title"), F.col("description"), keywords, F.col("_w")))
    return out.withColumn("total_score", scores.total_score(F.col("freshness_score"), F.col("keyword_score"))).drop("_w")


def kept_results(results: DataFrame) -> DataFrame:
    """Results with a link on their platform's domain (unknown platforms keep any) that aren't archived."""
    return results.where(T.kept(F.col("platform"), F.col("url"), F.col("title"), F.col("description")))


def _platform_place(platforms: list[str] | None) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in (platforms or T.PLATFORM_DOMAINS)]), F.col("platform"))


def top_per_platform(ranked: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best of each platform with platform_rank: the highest total_score first, ties as they were listed (pos)."""
    w = Window.partitionBy(*by, "platform").orderBy(F.desc("total_score"), "pos")
    return ranked.withColumn("platform_rank", F.row_number().over(w).cast("long")).where(F.col("platform_rank") <= k)


def top_overall(ranked: DataFrame, k: int = 5, platforms: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best of all platforms with global_rank. The platforms' rankings come one after another, in the order in which
    the platforms were asked for, before they are ranked together: so ties go to the platform asked first, then to the
    better place in its ranking. Only a platform's k best can be among them."""
    best = top_per_platform(ranked, k, by)
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("total_score"), _platform_place(platforms), "platform_rank")
    return best.withColumn("global_rank", F.row_number().over(order).cast("long")).where(F.col("global_rank") <= k)


def all_ranked(ranked_results: DataFrame, platforms: list[str] | None = None, lane: str | None = None) -> DataFrame:
    """All results with their position in the order of top_overall, dealt over ranges; lane: a column with a ranking each."""
    order = [F.desc("total_score"), _platform_place(platforms), F.col("platform"), F.col("pos")]
    return ranked_in(ranked_results, lane, order) if lane else ranked(ranked_results, order)


RESULT_FIELDS = ("pos", "platform", "title", "company", "location", "url", "description", "published_date", "freshness_score", "keyword_score", "total_score")
# Fixed value: why a platform has no results.
NO_RESULTS = "No API results found for this platform."


def search_bundle(results: DataFrame, searches: DataFrame, weights: DataFrame, keywords: list[str], as_of: str, platforms: list[str], region: str = "dk", k: int = 5) -> DataFrame:
    """A row for each search (search_id, location): global_top5, an array of results; top5_per_platform, a map from each
    platform asked for to its own; fallback_hints, a map from each platform without results to the reason and the URL of its
    own search page. results: search_id and a result's fields, pos in the order of its platform.

    Platforms that aren't known are left out. Without keywords arrays and maps are empty, whatever there is."""
    asked = list(dict.fromkeys(p for p in platforms if p in T.PLATFORM_DOMAINS)) if platforms else list(T.PLATFORM_DOMAINS)
    asked = asked if keywords else []
    one = F.struct(*RESULT_FIELDS)
    known = results.where(F.col("platform").isin(asked)) if asked else results.limit(0)
    ranked = scored(deduplicated(known, "search_id"), weights, keywords, as_of)
    mine = top_per_platform(ranked, k, ("search_id",)).groupBy("search_id", "platform").agg(F.array_sort(F.collect_list(F.struct("platform_rank", one.alias("r")))).alias("_top"))
    best = top_overall(ranked, k, asked, ("search_id",)).groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("global_rank", one.alias("r")))).alias("_best"))
    each = searches.select("search_id", "location", F.explode(F.array(*[F.lit(p) for p in asked]).cast("array<string>")).alias("platform"))
    each = each.join(mine, ["search_id", "platform"], "left")
    url = T.search_url(F.col("platform"), F.array(*[F.lit(x) for x in keywords]).cast("array<string>"), F.col("location"), F.lit(region))
    kind = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in ranked.select(*RESULT_FIELDS).schema)}>>"
    top = F.coalesce(F.col("_top.r"), F.array().cast(kind))
    hint = F.when(F.col("_top").isNull(), F.struct(F.lit(NO_RESULTS).alias("reason"), url.alias("browser_url")))
    maps = each.groupBy("search_id").agg(F.collect_list(F.struct(F.col("platform"), top.alias("top"), hint.alias("hint"))).alias("_all"))
    hints = F.filter(F.col("_all"), lambda x: x["hint"].isNotNull())
    told = searches.select("search_id", "location").join(best, "search_id", "left").join(maps, "search_id", "left").withColumn("_all", F.coalesce("_all", F.array().cast(maps.schema["_all"].dataType)))
    return told.select(
        "search_id", "location", F.coalesce(F.col("_best.r"), F.array().cast(kind)).alias("global_top5"),
        F.map_from_entries(F.transform("_all", lambda x: F.struct(x["platform"], x["top"]))).alias("top5_per_platform"),
        F.map_from_entries(F.transform(hints, lambda x: F.struct(x["platform"], x["hint"]))).alias("fallback_hints"),
    )


def preferred_provider(results: DataFrame) -> DataFrame:
    """Per platform the rows of the provider with the smallest priority that has any."""
    best = results.groupBy("platform").agg(F.min("priority").alias("_best"))
    return results.join(best, "platform").where("priority = _best").drop("_best")


def lanes(items: DataFrame, statuses: list[str]) -> DataFrame:
    """(status, position, items) of every lane, empty ones too; items of other statuses are in none."""
    spark = items.sparkSession
    order = spark.createDataFrame(list(enumerate(statuses)), "position long, status string")
    counts = items.groupBy("status").agg(F.count("*").alias("n"))
    return order.join(counts, "status", "left").select("status", "position", F.coalesce("n", F.lit(0)).alias("items"))


def items_in_lanes(items: DataFrame, statuses: list[str], order: list[Column]) -> DataFrame:
    """Every lane with its items: (lane, lane_position, place, and the items' columns); an empty lane has one row
    without an item. Items of other statuses are in none. Within a lane the given order holds."""
    spark = items.sparkSession
    lanes = spark.createDataFrame(list(enumerate(statuses)), "lane_position long, lane string")
    ordered = ranked_in(items.where(F.col("status").isin(statuses)), "status", order, "place")
    return lanes.join(ordered, lanes["lane"] == ordered["status"], "left")


def next_status(status: Column, statuses: list[str]) -> Column:
    order = F.array(*[F.lit(s) for s in statuses])
    return F.when(F.array_contains(order, status), F.try_element_at(order, F.array_position(order, status).cast("int") + 1))


def occurrences(items: DataFrame) -> DataFrame:
    """A row for each date of an item that isn't blank: id, company, title, kind, date."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), T.stripped(F.col(c)).alias("date")) for k, c in DATES.items()])
    return items.select("id", "company", "title", F.explode(kinds).alias("o")).where("o.date != ''").select("id", "company", "title", "o.kind", "o.date")


def _as_listed(items: DataFrame) -> list[Column]:
    """The order of a list of items, and within an item that of its dates: the latest change first."""
    return [*([F.desc("updated_at")] if "updated_at" in items.columns else []), F.desc("id"), F.array_position(F.array(*[F.lit(k) for k in DATES]), F.col("kind"))]


def _listed_occurrences(items: DataFrame) -> DataFrame:
    kept = items.select("id", *[c for c in ("updated_at",) if c in items.columns])
    return items_of_occurrences(occurrences(items), kept)


def ordered_occurrences(items: DataFrame, locale: str = "UNICODE") -> DataFrame:
    """occurrences with their position by date, then company as a reader orders it, then as the items are listed."""
    found = _listed_occurrences(items)
    return placed(found, F.col("date"), False, [F.collate("company", locale), *_as_listed(items)])


def items_of_occurrences(found: DataFrame, items: DataFrame) -> DataFrame:
    """Each occurrence with its item's other columns, null where the item is gone."""
    own = [F.col(c) for c in items.columns if c not in found.columns]
    return found.join(items.select(F.col("id").alias("_id"), *own), F.col("id") == F.col("_id"), "left").drop("_id")


def month_grids(months: DataFrame) -> DataFrame:
    """42 cells, Monday first, of each month (a date column of any of its days): month, cell, week, weekday, day (null
    outside the month), date_key."""
    first = F.trunc("month", "month")
    cells = months.select(first.alias("month")).where("month is not null").distinct().select("month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(41).cast("long"))).alias("cell"))
    day = F.col("cell") - F.weekday("month") + 1
    inside = (day >= 1) & (day <= F.day(F.last_day("month")))
    key = F.when(inside, F.concat(F.date_format("month", "yyyy-MM-"), F.lpad(day.cast("string"), 2, "0")))
    return cells.select("month", "cell", F.floor(F.col("cell") / 7).alias("week"), (F.col("cell") % 7).alias("weekday"), F.when(inside, day.cast("long")).alias("day"), key.alias("date_key"))


def month_grid(spark, year: int, month: int) -> DataFrame:
    """month_grids of one month."""
    return month_grids(spark.range(1).select(F.make_date(F.lit(year), F.lit(month), F.lit(1)).alias("month"))).drop("month")


def _in_month(found: DataFrame, year: int, month: int) -> DataFrame:
    return found.where(F.col("date").startswith(f"{year:04d}-{month:02d}-") & F.col("date").try_cast("date").isNotNull())


def calendar_month(items: DataFrame, year: int, month: int) -> DataFrame:
    """The month's days with how many occurrences each has, and the first by company."""
    o = _in_month(occurrences(items), year, month)
    days = o.groupBy("date").agg(F.count("*").alias("n"), F.min("company").alias("first_company"))
    grid = month_grid(items.sparkSession, year, month).where("day is not null")
    return grid.join(days, grid["date_key"] == days["date"], "left").select("date_key", "week", "weekday", F.coalesce("n", F.lit(0)).alias("occurrences"), "first_company")


def calendar_cells(items: DataFrame, year: int, month: int, locale: str = "UNICODE") -> DataFrame:
    """All 42 cells of a month with their occurrences: (cell, day, date_key, place, id, company, title, kind), a row
    for each occurrence, in each day by company as a reader orders it, then as the items are listed; a cell without any
    has one row."""
    o = _in_month(_listed_occurrences(items), year, month)
    o = ranked_in(o, "date", [F.collate("company", locale), *_as_listed(items)], "place").drop("updated_at")
    grid = month_grid(items.sparkSession, year, month).select("cell", "day", "date_key")
    return grid.join(o, grid["date_key"] == o["date"], "left").drop("date")


def reminders(items: DataFrame, as_of: str, within: int = 14) -> DataFrame:
    """Items that aren't done with a deadline at most `within` days away; overdue ones stay, however old."""
    days = scores.days_left(F.col("deadline"), as_of)
    out = items.where("deadline is not null and status != 'Done'").withColumn("days", days).where(F.col("days") <= within)
    return out.withColumn("urgency", scores.urgency(F.col("days"))).withColumn("follow_up", scores.follow_up(F.col("days")))


def ordered_reminders(items: DataFrame, as_of: str, within: int = 14) -> DataFrame:
    """reminders with their position: the most urgent first, items as they are listed (latest change first) within a day."""
    return placed(reminders(items, as_of, within), F.col("days"), False, [F.desc("updated_at"), F.desc("id")])


OLDEST_FIRST = ("created_at", "id")


def documents_of(documents: DataFrame, item: int) -> DataFrame:
    """The documents of one item, oldest first."""
    return documents.where(F.col("job_id") == item).orderBy(*OLDEST_FIRST)


def latest_status(history: DataFrame) -> DataFrame:
    last = F.max(F.struct("changed_at", "id", "to_status", "from_status")).alias("x")
    return history.groupBy("job_id").agg(last).select("job_id", "x.to_status", "x.from_status", "x.changed_at")


def with_from_status(log: DataFrame) -> DataFrame:
    """A log of statuses with each one's predecessor."""
    w = Window.partitionBy("job_id").orderBy("changed_at", "id")
    return log.withColumn("from_status", F.lag("to_status").over(w))


def moved(items: DataFrame, moves: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(items, history rows) after moves (id, status): status and updated_at are set, and a row is written for each
    move, to the same status too."""
    m = moves.select(F.col("id").alias("_id"), F.col("status").alias("_to"))
    both = items.join(m, items["id"] == m["_id"], "left")
    hit = F.col("_id").isNotNull()
    new = both.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    log = both.where(hit).select(F.col("id").alias("job_id"), F.col("status").alias("from_status"), F.col("_to").alias("to_status"), F.lit(now).alias("changed_at"))
    return new.withColumn("status", F.when(hit, F.col("_to")).otherwise(F.col("status"))).select(*items.columns), log


def logged(history: DataFrame, new: DataFrame) -> DataFrame:
    """history and new rows (job_id, from_status, to_status, changed_at), with ids after the largest one."""
    top = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = ranked(new, [F.col("changed_at"), F.col("job_id"), F.col("to_status")], "_n").crossJoin(F.broadcast(top))  # one row
    return history.unionByName(numbered.withColumn("id", F.col("_top") + F.col("_n")).select(*history.columns))


def _checked(rows: DataFrame, sound: Column, message: str) -> DataFrame:
    """rows as they are; the query fails with the message if any of them isn't sound."""
    return rows.where(F.when(sound, True).otherwise(F.raise_error(F.lit(message))))


def present(ids: DataFrame, items: DataFrame) -> DataFrame:
    """ids (id) as they are; the query fails if items lack one of them."""
    have = items.select(F.col("id").alias("_have")).distinct()
    both = ids.join(have, ids["id"] == have["_have"], "left")
    return _checked(both, F.col("_have").isNotNull(), "Item not found.").drop("_have")


def updated(items: DataFrame, patch: DataFrame, fields: list[str], now: str) -> tuple[DataFrame, DataFrame]:
    """(items, history rows) after overwriting `fields` from patch (id and fields); a row only where status changed.
    A patch with a blank company fails the query. company is trimmed."""
    company = T.trimmed(T.text("company"))
    p = _checked(patch, company != "", "Company is required.").select(F.col("id").alias("_id"), *[(company if c == "company" else F.col(c)).alias(f"_{c}") for c in fields])
    both = items.join(p, items["id"] == p["_id"], "left")
    hit = F.col("_id").isNotNull()
    log = both.where(hit & ~F.col("status").eqNullSafe(F.col("_status"))).select(F.col("id").alias("job_id"), F.col("status").alias("from_status"), F.col("_status").alias("to_status"), F.lit(now).alias("changed_at"))
    new = both.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return new.select(*items.columns), log


def appended(items: DataFrame, new: DataFrame, now: str, blank_companies: bool = False, parts: int | None = None) -> DataFrame:
    """items and the new rows, with ids after the largest one, in order of pos (a number, not null), and both times set.
    An import leaves out rows with a blank company; what a caller creates (blank_companies) isn't checked."""
    rows = new if blank_companies else new.where(T.trimmed(T.text("company")) != "")
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = ranked(rows.drop("id"), [F.col("pos")], "_n", parts).crossJoin(F.broadcast(top))  # one row
    made = numbered.withColumn("id", F.col("_top") + F.col("_n")).withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
    return items.unionByName(made.select(*[c for c in items.columns if c in made.columns]), allowMissingColumns=True)


def deleted(ids: DataFrame, key: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each frame without the rows whose column (the dict's key after the colon) is among ids (id)."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return {name: df.join(gone, df[name.split(":")[1]] == gone["_gone"], "left_anti") for name, df in key.items()}


def backfilled(documents: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """Document rows for items' files that documents lacks: job_id, doc_type, original_name, file_path, created_at."""
    have = documents.select(F.col("job_id").alias("_j"), F.col("file_path").alias("_p")).distinct()
    wanted = items.where("pdf_path != ''").select(F.col("id").alias("job_id"), F.lit("application").alias("doc_type"), T.base_name(F.col("pdf_path")).alias("original_name"), F.col("pdf_path").alias("file_path"), F.lit(now).alias("created_at"))
    return wanted.join(have, (wanted["job_id"] == have["_j"]) & (wanted["file_path"] == have["_p"]), "left_anti")


def with_schema(df: DataFrame, schema) -> DataFrame:
    """df with the columns of schema, missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def enqueued(queue: DataFrame, new: DataFrame) -> DataFrame:
    """queue and the new URLs that no entry but a dismissed one has."""
    live = queue.where("status != 'dismissed'").select(F.col("url").alias("_u")).distinct()
    once = new.groupBy("url").agg(F.min_by(F.struct(*[c for c in new.columns if c != "url"]), "id").alias("x")).select("url", "x.*")
    return queue.unionByName(once.join(live, F.col("url") == F.col("_u"), "left_anti"), allowMissingColumns=True)


def ordered_queue(queue: DataFrame) -> DataFrame:
    """queue with the position of each entry, newest first; entries of one time by id."""
    return placed(queue, F.substring("created_at", 1, 10), True, [F.desc("created_at"), F.col("id")])


def queue_parts(queue: DataFrame) -> DataFrame:
    """queue with part: `history` for accepted and dismissed entries, else `active`."""
    return queue.withColumn("part", F.when(F.col("status").isin("accepted", "dismissed"), "history").otherwise("active"))


def patched(rows: DataFrame, patch: DataFrame, now: str) -> DataFrame:
    """rows with the fields of patch (id and fields, one row an id) taken over, nulls too, and updated_at set."""
    fields = [c for c in patch.columns if c != "id"]
    p = patch.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = rows.join(p, rows["id"] == p["_id"], "left")
    hit = F.col("_id").isNotNull()
    new = both.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return new.select(*rows.columns)


def checked(items: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """items with the listing_status that was found (id, listing_status) and when; updated_at stays as it is."""
    old = {c: (F.col(c) if c in items.columns else F.lit(None).cast("string")) for c in ("listing_status", "listing_checked_at")}
    f = found.select(F.col("id").alias("_id"), F.col("listing_status").alias("_state"))
    both, hit = items.join(f, items["id"] == f["_id"], "left"), F.col("_id").isNotNull()
    new = {"listing_status": F.when(hit, F.col("_state")).otherwise(old["listing_status"]), "listing_checked_at": F.when(hit, now).otherwise(old["listing_checked_at"])}
    return both.withColumns(new).drop("_id", "_state")


def with_custom_keyword(stats: DataFrame, word: str) -> DataFrame:
    """stats and the trimmed word in lower case with a count of 0, unless it is blank or there already."""
    word = word.strip().lower()
    if not word:
        return stats
    own = stats.sparkSession.createDataFrame([(word, 0)], "keyword string, count long")
    return stats.unionByName(own).groupBy("keyword").agg(F.max("count").alias("count"))


def without_custom_keyword(stats: DataFrame, word: str) -> DataFrame:
    """stats without the word if nothing counts for it; counted words stay."""
    return stats.where((F.col("keyword") != word) | (F.col("count") > 0))
