"""Column functions for what a reader sees: cells, labels, keys, calendar links and events, answers and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackwell.functions.text import component_encoded, stripped, text

# Kinds of documents and of events, with their names; what an empty cell shows.
DOCUMENT_LABELS = {"cv": "CV", "cover_letter": "Cover Letter", "other": "Other"}
EVENT_NAMES = {"apply": "Application deadline", "interview": "Interview", "start": "Role start"}
DASH = "-"


def _looked_up(names: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]


def cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(DASH))


def document_label(c: Column) -> Column:
    """The label of a kind of document; an unknown kind is its own label."""
    return F.coalesce(_looked_up(DOCUMENT_LABELS, c), c)


def result_key(platform: Column, url: Column, *other: Column) -> Column:
    """Platform and URL; without URL platform and the other fields."""
    rest = F.concat_ws("|", text(platform), *[text(c) for c in other])
    return F.when(text(url) != "", F.concat_ws("|", text(platform), url)).otherwise(rest)


# Fixed values from here on to template_link: the wording of labels, and the calendar's address and parameters.
def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def score_breakdown(fresh: Column, keyword: Column, total: Column) -> Column:
    return F.format_string("Fresh %.2f · Keyword %.2f · Total %.2f", fresh, keyword, total)


def due_label(days: Column) -> Column:
    left = F.abs(days).cast("string")
    return F.when(days < 0, F.concat(F.lit("Overdue by "), left, F.lit("d"))).otherwise(F.concat(F.lit("Due in "), left, F.lit("d")))


def follow_up_label(follow_up: Column) -> Column:
    return F.concat(F.lit("Suggested follow-up: ~"), follow_up, F.lit(" days"))


def template_link(date: Column, summary: Column, details: Column, origin: str = "trackwell") -> Column:
    """The link that makes an all-day calendar entry; null without a date. Without details the entry names its origin."""
    day = F.replace(F.nullif(date, F.lit("")), F.lit("-"), F.lit(""))
    return F.concat(
        F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), component_encoded(summary),
        F.lit("&dates="), day, F.lit("/"), day, F.lit("&details="), component_encoded(F.coalesce(details, F.lit(origin))),
    )


def template_summary(kind: Column, company: Column) -> Column:
    """The first line of a calendar entry of a kind; an unknown kind gives the company alone."""
    return F.concat(F.coalesce(F.concat(_looked_up(EVENT_NAMES, kind), F.lit(": ")), F.lit("")), company)


def deadline_link(company: Column, title: Column, deadline: Column) -> Column:
    """The calendar entry of a deadline; null without one."""
    return template_link(deadline, F.concat(F.lit("Application Deadline: "), company), F.coalesce(title, F.lit("Job application")))


def calendar_event(item_id: Column, kind: Column, company: Column, title: Column, date: Column, origin: str = "trackwell") -> Column:
    """The JSON of an all-day event that ends the day after (exclusive); null for unknown kinds and unreadable dates."""
    day = date.try_cast("date")
    summary = F.concat(_looked_up(EVENT_NAMES, kind), F.lit(": "), company, F.lit(" — "), F.coalesce(title, F.lit("Role")))
    note = F.concat(F.lit(f"Synced from {origin} (item id "), item_id.cast("string"), F.lit(", "), kind, F.lit(")."))
    on = lambda d: F.struct(F.date_format(d, "yyyy-MM-dd").alias("date"))
    body = F.to_json(F.struct(summary.alias("summary"), note.alias("description"), on(day).alias("start"), on(F.date_add(day, 1)).alias("end")))
    return F.when(summary.isNotNull() & day.isNotNull(), body)


def _string_at(obj: Column, path: str) -> Column:
    """A string of a variant as it is; null where there is something else."""
    v = F.try_variant_get(obj, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(obj, path, "string"))


def answer_text(response: Column) -> Column:
    """The text of a model's response, in either of two shapes; null if it is blank or missing."""
    obj = F.try_parse_json(response)
    found = F.coalesce(_string_at(obj, "$.candidates[0].content.parts[0].text"), _string_at(obj, "$.choices[0].message.content"))
    return F.when(stripped(found) != "", found)


def http_error(status: Column, body: Column) -> Column:
    """HTTP and the status, with the body's error message, message, detail or first 400 characters."""
    head, obj = F.concat(F.lit("HTTP "), status.cast("string")), F.try_parse_json(body)
    told = F.coalesce(F.try_variant_get(obj, "$.error.message", "string"), _string_at(obj, "$.message"), _string_at(obj, "$.detail"), F.substring(body, 1, 400))
    return F.when(stripped(text(body)) == "", head).otherwise(F.concat(head, F.lit(": "), told))


def handed_url(c: Column) -> Column:
    """The URL that a link hands over for capture, decoded, otherwise as it is; null if there is none."""
    return F.nullif(F.try_url_decode(F.try_parse_url(c, F.lit("QUERY"), F.lit("capture_url"))), F.lit(""))


def found_by_key(links: Column, key: Column) -> Column:
    """Whether any of the links contains the key; null without a key."""
    return F.when(key.isNotNull(), F.exists(links, lambda x: F.contains(text(x), key)))
