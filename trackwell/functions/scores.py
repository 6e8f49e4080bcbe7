"""Column functions for ages, freshness, keyword relevance, listing state and deadlines. The clock is a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackwell.functions.text import host, text, trimmed

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(\.\d+)?(z|[+-]\d{2}:\d{2})$"
# Half-life of a row's weight; steps of freshness by age; weights of title, description, phrase; shares
# of freshness and keywords in the total; the least weight of a keyword.
HALF_LIFE_DAYS = 60
FRESHNESS = ((3, 1.0), (7, 0.85), (14, 0.65), (30, 0.35), (60, 0.15))
FRESHNESS_UNKNOWN, FRESHNESS_OLDER = 0.5, 0.05
IN_TITLE, IN_DESCRIPTION, IN_PHRASE, LEAST_WEIGHT = 1.0, 0.45, 0.15, 0.2
OF_FRESHNESS, OF_KEYWORDS = 0.6, 0.4
# Phrases of closed or missing listings.
GONE = ("job no longer available", "no longer accepting", "position has been filled", "job not found", "page not found", "404", "ikke tilgængelig", "stillingen er besat")


def _gone(c: Column, *words: str) -> Column:
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(""))
    return trimmed(c)


def age_days(c: Column, as_of: str) -> Column:
    """Days before as_of of "today", "3 days ago", "2w", RFC 3339 times and dates; null for anything else."""
    s = F.lower(trimmed(c))
    days, weeks = _gone(s, "days ago", "day ago"), _gone(s, "weeks ago", "week ago", "w")
    now = F.lit(as_of).cast("timestamp")
    at = F.try_to_timestamp(F.when(s.rlike(RFC3339), F.upper(s)))
    whole = F.timestamp_diff("DAY", at, now) if hasattr(F, "timestamp_diff") else F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)
    date = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s).try_cast("date")
    zero = F.lit(0.0)
    return (
        F.when(s == "", None).when(s == "today", 0.0).when(s == "yesterday", 1.0)
        .when(days.rlike(NUMBER), F.greatest(zero, days.try_cast("double")))
        .when(weeks.rlike(NUMBER), F.greatest(zero, weeks.try_cast("double") * 7))
        .when(at.isNotNull(), F.greatest(zero, whole.cast("double")))
        .when(date.isNotNull(), F.greatest(zero, F.datediff(now.cast("date"), date).cast("double")))
    )


def birthday(c: Column, anchor: str) -> tuple[Column, Column]:
    """(day, age) of what age_days reads: on a day d at the anchor's time of day the age is the days from day to d, at
    least 0. Where the age is the same on every day, day is null and age has it (null: it can't be read)."""
    s = F.lower(trimmed(c))
    at = F.try_to_timestamp(F.when(s.rlike(RFC3339), F.upper(s)))
    date = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s).try_cast("date")
    moved = F.ceil((F.unix_micros(at) - F.unix_micros(F.lit(anchor).cast("timestamp"))) / 86_400_000_000)
    fixed = age_days(F.when(at.isNull() & date.isNull(), c), anchor)
    return F.when(at.isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), moved.cast("int"))).otherwise(date), fixed


def freshness(age: Column) -> Column:
    out = F.when(age.isNull(), FRESHNESS_UNKNOWN)
    for days, value in FRESHNESS:
        out = out.when(age <= days, value)
    return out.otherwise(FRESHNESS_OLDER)


def decay(age: Column) -> Column:
    """The weight of a row of that age; rows whose date can't be read count as new."""
    return F.exp(F.coalesce(age, F.lit(0.0)) * (-math.log(2) / HALF_LIFE_DAYS))


def keyword_relevance(title: Column, description: Column, keywords: list[str], weights: Column) -> Column:
    """Weighted share of keywords found in title, description and as the whole phrase.

    weights: a map from keyword to weight; the scale looks keywords up as given, the rest in lower case."""
    if not keywords:
        return F.lit(0.0)
    t, d, phrase = F.lower(text(title)), F.lower(text(description)), " ".join(keywords).lower()
    least, most = F.lit(LEAST_WEIGHT), IN_TITLE + IN_DESCRIPTION + IN_PHRASE
    top = F.greatest(least, least, *[F.coalesce(weights[k], least) for k in keywords])
    joint = (F.when(t.contains(phrase) | d.contains(phrase), IN_PHRASE).otherwise(0.0)) if phrase else F.lit(0.0)
    total, cap = F.lit(0.0), F.lit(0.0)
    for k in (k.lower() for k in keywords):
        base = F.coalesce(weights[k], least) / top
        found = F.when(t.contains(k), IN_TITLE).otherwise(0.0) + F.when(d.contains(k), IN_DESCRIPTION).otherwise(0.0) + joint
        total, cap = total + base * found, cap + base * most
    return F.when(cap <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / cap)))


def total_score(fresh: Column, keyword: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fresh * OF_FRESHNESS + keyword * OF_KEYWORDS))


def score_tone(c: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))))
    return F.when(s >= 0.75, "high").when(s >= 0.45, "medium").otherwise("low")


def listing_status(url: Column, final_url: Column, body: Column, http_status: Column, found_by_key: Column) -> Column:
    """active, closed, archived or unreachable, from what a fetch gave. found_by_key: the key search's answer, null
    where there is none."""
    h, end, low = F.coalesce(host(url), F.lit("")), text(final_url), F.lower(F.substring(text(body), 1, 4096))
    linkedin = F.when(end.contains("/expired") | low.contains("no longer accepting applications"), "closed").when(low.contains("job not found") | low.contains("page not found"), "unreachable").otherwise("active")
    return (
        F.when(h.contains("indeed.com"), F.when(found_by_key.isNull(), "unreachable").when(found_by_key, "active").otherwise("closed"))
        .when(http_status.isNull() | (http_status >= 400), "unreachable")
        .when(h.contains("linkedin.com"), linkedin)
        .when(h.contains("jobindex.dk"), F.when(end.contains("/arkiv"), "archived").otherwise("active"))
        .otherwise(F.when(low.rlike("|".join(GONE)), "closed").otherwise("active"))
    )


def days_left(deadline: Column, as_of: str) -> Column:
    """Whole days from as_of to the deadline's midnight, cut toward zero."""
    seconds = F.unix_timestamp(deadline.try_cast("date").cast("timestamp")) - F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return F.when(seconds < 0, F.ceil(seconds / 86400)).otherwise(F.floor(seconds / 86400)).cast("long")


def urgency(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days <= 2, "urgent").when(days <= 7, "soon").otherwise("ok")


def follow_up(days: Column) -> Column:
    return F.when(days <= 7, "7").when(days <= 14, "14")


def relative_date(c: Column, as_of: str) -> Column:
    """How long ago a date or time was, in whole days that have passed (an hour before midnight is still today after
    it); what can't be read as one stays as it is. Dates begin at midnight UTC, times without zone are UTC."""
    at = c.try_cast("timestamp")
    n = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at)) / 86_400_000_000)
    told = F.when(n == 0, "Today").when(n == 1, "Yesterday").when(n < 7, F.concat(n.cast("string"), F.lit("d ago"))).when(n < 31, F.concat(F.floor(n / 7).cast("string"), F.lit("w ago")))
    return F.when(at.isNull(), c).otherwise(F.coalesce(told, F.date_format(at, "MMM d")))


def added_date(c: Column) -> Column:
    """A time as `Mar 1, 2026`; what can't be read as one: its first ten characters."""
    return F.coalesce(F.date_format(c.try_cast("timestamp"), "MMM d, yyyy"), F.substring(c, 1, 10))
