"""Column functions that turn model answers and payloads into item fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.functions.text import source_of_url, stripped, text

# Output fields and the keys that are tried for each, in order.
ALIASES = {
    "company": ("company", "Company", "employer", "Employer", "organization"),
    "title": ("title", "Title", "role", "Role", "job_title", "position"),
    "url": ("url", "URL", "link", "job_url", "apply_url"),
    "deadline": ("deadline", "Deadline", "closing_date", "apply_by"),
    "interview_date": ("interview_date", "interviewDate", "InterviewDate", "interviews", "interview", "assessment_date"),
    "start_date": ("start_date", "startDate", "StartDate", "position_start", "role_start", "contract_start"),
    "tags": ("tags", "Tags", "keywords"),
    "detected_language": ("detected_language", "DetectedLanguage", "language", "Language"),
    "notes": ("notes", "Notes", "summary"),
    "contact_name": ("contact_name", "contactName", "contact"),
    "contact_email": ("contact_email", "contactEmail", "email"),
    "contact_phone": ("contact_phone", "contactPhone", "phone"),
    "workplace_street": ("workplace_street", "street", "address"),
    "workplace_city": ("workplace_city", "city"),
    "workplace_postal_code": ("workplace_postal_code", "postalCode", "postal_code", "zip"),
    "work_mode": ("work_mode", "workMode", "location_type"),
    "salary_range": ("salary_range", "salaryRange", "salary", "compensation"),
    "contract_type": ("contract_type", "contractType", "employment_type", "contract"),
    "reference_number": ("reference_number", "referenceNumber", "ref", "job_ref", "job_id"),
    "source": ("source", "Source", "job_source", "platform"),
}
# Work modes.
WORK_MODES = {"remote": "Remote", "hybrid": "Hybrid", "on-site": "On-site", "onsite": "On-site", "on site": "On-site", "office": "On-site"}


# Why a draft is short of fields.
FETCH_FAILED, EXTRACT_FAILED = "fetch_failed", "extract_failed"


def prompt(listing: Column) -> Column:
    """What a model is asked about the text of a listing: one JSON object with the output fields."""
    asked = f"Read the job listing below. Answer with one JSON object and nothing else; leave out what the listing doesn't say.\nKeys: {', '.join(ALIASES)}.\nDates: YYYY-MM-DD. work_mode: {', '.join(dict.fromkeys(WORK_MODES.values()))}.\n\nListing:\n"
    return F.concat(F.lit(asked), text(listing))


# All keys that are tried, each once: the fields of the object that an answer is parsed into.
KEYS = tuple(dict.fromkeys(k for keys in ALIASES.values() for k in keys))


def _parsed(c: Column) -> Column:
    """A list with the values of an object's known keys, fields k0, k1 and so on, as its one element; null or of another
    length where the text isn't one JSON object. Of a repeated key the last value counts."""
    asked = "array<struct<" + ",".join(f"{k}:variant" for k in KEYS) + ">>"
    plain = "array<struct<" + ",".join(f"k{i}:variant" for i in range(len(KEYS))) + ">>"  # two keys may differ in case only
    whole = F.from_json(F.concat(F.lit("["), c, F.lit("]")), asked, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return F.when(c.startswith("{") & c.endswith("}"), whole).cast(plain)  # in a list, so that nothing may follow the object


def work_mode(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WORK_MODES.items() for x in kv])[F.lower(stripped(c))]


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def drafted(df: DataFrame, answer: Column) -> DataFrame:
    """df with the output fields of a model's answer: for each the first of its keys whose value is a string that isn't
    blank, trimmed. The answer is an object, in a code fence or not; it is parsed once, and once more as it is only where
    what the fence holds is no object."""
    kept = [F.col(c) for c in df.columns if c not in ALIASES]
    rows = df.withColumn("_raw", stripped(text(answer)))
    bare = F.regexp_replace(F.regexp_replace("_raw", r"(?iU)^```(?:json)?\s*", ""), r"(?iU)\s*```\s*\z", "")
    rows = rows.withColumn("_bare", F.when(F.col("_raw").startswith("```") | F.col("_raw").endswith("```"), bare).otherwise(F.col("_raw")))
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    rows = rows.withColumn("_first", _parsed(F.col("_bare")))
    rows = rows.withColumn("_second", F.when((F.col("_bare") != F.col("_raw")) & one(F.col("_first")).isNull(), _parsed(F.col("_raw"))))
    rows = rows.withColumn("_got", F.coalesce(one(F.col("_first")), one(F.col("_second"))))
    value = lambda key: F.col(f"_got.k{KEYS.index(key)}")
    rows = rows.withColumn("_strings", F.array(*[F.nullif(stripped(_string(value(k))), F.lit("")) for k in KEYS]))
    fields = {name: F.coalesce(*[F.get("_strings", F.lit(KEYS.index(k))) for k in keys]) for name, keys in ALIASES.items()}
    listed = F.filter(F.try_variant_get(value("tags"), "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    joined = F.array_join(F.transform(listed, _string), ", ")
    fields |= {"tags": F.coalesce(fields["tags"], F.nullif(stripped(joined), F.lit(""))), "work_mode": work_mode(fields["work_mode"])}
    return rows.select(*kept, *[c.alias(n) for n, c in fields.items()])


def capture_drafts(df: DataFrame, url: Column, page: Column, answer: Column, status: Column) -> DataFrame:
    """df with the draft of a captured URL: url, source, status, raw_text, the fields of the model's answer, and
    reason: `fetch_failed` without page text, `extract_failed` without any field in the answer, null otherwise.

    page: the page's text, null where the fetch failed; answer: null where there was none. Without page text the answer
    doesn't count. Fields of the answer that aren't blank stand in for the draft's own; company is empty without one."""
    listing = blank_to_absent(page)
    base = df.drop("url", "source", "status", "raw_text", "reason").withColumns({"_url": url, "_status": status, "_page": listing, "_said": F.when(listing.isNotNull(), answer)})
    got = drafted(base, F.col("_said"))
    some = F.coalesce(*[F.col(n) for n in ALIASES]).isNotNull()
    reason = F.when(F.col("_page").isNull(), FETCH_FAILED).when(~some, EXTRACT_FAILED)
    out = {"reason": reason, "raw_text": F.col("_page"), "status": F.col("_status"), "company": F.coalesce("company", F.lit("")), "url": F.coalesce("url", "_url"), "source": F.coalesce("source", source_of_url(F.col("_url")))}
    return got.withColumns(out).drop("_url", "_status", "_page", "_said")


def blank_to_absent(c: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def listing_text(url: Column, page: Column, snippet: Column) -> Column:
    """The text of a saved result: the page's if it has a URL and a text, else the trimmed snippet; null if both are blank."""
    return F.coalesce(F.when(stripped(text(url)) != "", blank_to_absent(page)), blank_to_absent(snippet))


def merged(new: Column, old: Column) -> Column:
    """A new value that isn't blank, as it is, or else the old one."""
    return F.coalesce(F.when(stripped(new) != "", new), old)


def place_tags(platform: Column, location: Column) -> Column:
    """Platform and location parts, lower case, each once, in order."""
    parts = F.transform(F.split(text(location), r"[,\-/|]"), lambda x: F.lower(stripped(x)))
    every = F.concat(F.array(F.lower(stripped(text(platform)))), parts)
    return F.array_distinct(F.filter(every, lambda x: x != ""))
