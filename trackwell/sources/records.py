"""Reading and writing items: provider payloads, JSON and CSV imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trackwell.functions import text as T

# The fields that an import takes, those that an export writes, and the 29 columns of an item in order.
IMPORT_FIELDS = ("company", "title", "url", "raw_text", "status", "deadline", "interview_date", "start_date", "tags", "detected_language", "notes")
EXPORT_FIELDS = ("id", "company", "title", "status", "deadline", "interview_date", "start_date", "url", "tags", "detected_language")
ITEM_FIELDS = (
    "id", "company", "title", "url", "raw_text", "status", "deadline", "interview_date", "start_date", "tags", "detected_language", "notes",
    "contact_name", "contact_email", "contact_phone", "workplace_street", "workplace_city", "workplace_postal_code", "work_mode", "salary_range",
    "contract_type", "priority", "reference_number", "source", "pdf_path", "listing_status", "listing_checked_at", "created_at", "updated_at",
)
SYSTEM_FIELDS = ("id", "pdf_path", "listing_status", "listing_checked_at", "created_at", "updated_at")
_REQUIRED = ("id", "company", "status", "created_at", "updated_at")
ITEM_SCHEMA = StructType([StructField(c, LongType() if c in ("id", "priority") else StringType(), c not in _REQUIRED) for c in ITEM_FIELDS])
HISTORY_SCHEMA = StructType([StructField("id", LongType(), False), StructField("job_id", LongType(), False), StructField("from_status", StringType()), StructField("to_status", StringType(), False), StructField("changed_at", StringType(), False)])
DOCUMENT_SCHEMA = StructType([StructField("id", LongType(), False), StructField("job_id", LongType(), False), *[StructField(c, StringType(), False) for c in ("doc_type", "original_name", "file_path", "created_at")]])
# Where each provider's payload has its rows, and the keys of link, title, description and date.
PROVIDERS = {
    "serp": ("organic_results", ("link", "title", "snippet", "date")),
    "brave": ("web.results", ("url", "title", "description", "page_age")),
}


def result_list(payload: Column, provider: str, limit: int = 400) -> Column:
    """The results in a provider's payload, array<struct<place, url, title, company, description, published_date>>; null if
    the payload isn't JSON. Where the list should be and isn't one, there are no results; of an item that isn't an
    object, and of a field that isn't a string, nothing is known. A result without title is "Untitled"."""
    path, keys = PROVIDERS[provider]
    value = T.json_value(payload)
    items = F.coalesce(F.try_variant_get(value, f"$[0].{path}", "array<variant>"), F.array().cast("array<variant>"))

    def one(item: Column, place: Column) -> Column:
        url, title, description, date = (T.string_at(item, f"$.{k}") for k in keys)
        name, company = T.split_title(F.coalesce(title, F.lit("Untitled")))
        return F.struct(place.alias("place"), T.text(url).alias("url"), name.alias("title"), company.alias("company"), F.substring(T.text(description), 1, limit).alias("description"), T.text(date).alias("published_date"))

    return F.when(value.isNotNull(), F.transform(items, one))


def provider_results(payloads: DataFrame, provider: str, limit: int = 400) -> DataFrame:
    """payloads (payload_id, platform, location, payload) to a row a result: url, title, company, description,
    published_date, and its place in the payload. A payload that isn't JSON fails the query."""
    found = F.coalesce(result_list(F.col("payload"), provider, limit), F.raise_error(F.lit("payload is not JSON")))
    each = payloads.select("payload_id", "platform", "location", F.explode(found).alias("r"))
    return each.select("payload_id", "platform", "location", "r.*")


def platform_results(payloads: DataFrame, providers: list[str], limit: int = 400) -> DataFrame:
    """payloads (search_id, platform, provider, location, payload) to the results of each search and platform, of the
    first of the providers that has any left: (search_id, platform, location, pos and the fields of a result).

    Results count if they have a link on the platform's domain and aren't archived. A payload that isn't JSON fails the query,
    unless a provider before it has results. No providers (no keys for them) are an error."""
    if not providers:
        raise ValueError("No search provider: a key for one of them is needed.")
    order = F.array(*[F.lit(p) for p in providers])
    asked = payloads.where(F.col("provider").isin(providers)).withColumn("_nth", F.array_position(order, F.col("provider")))
    lists = F.lit(None)
    for p in providers:
        lists = F.when(F.col("provider") == p, result_list(F.col("payload"), p, limit)).otherwise(lists)
    kept = F.filter(lists, lambda r: T.kept(F.col("platform"), r["url"], r["title"], r["description"]))
    tried = asked.select("search_id", "platform", "location", "_nth", kept.alias("_list")).where("_list is null or size(_list) > 0")
    first = tried.groupBy("search_id", "platform").agg(F.min_by(F.struct("location", "_list"), "_nth").alias("f"))
    found = F.when(F.col("f._list").isNotNull(), F.col("f._list")).otherwise(F.raise_error(F.lit("payload is not JSON")))
    each = first.select("search_id", "platform", "f.location", F.explode(found).alias("r"))
    return each.select("search_id", "platform", "location", F.col("r.place").cast("long").alias("pos"), "r.url", "r.title", "r.company", "r.description", "r.published_date")


def import_columns(field) -> dict[str, Column]:
    """The import fields from field(name): blanks are absent, company trimmed or "Unknown", status "Interesting" by default."""
    out = {c: F.nullif(field(c).cast("string"), F.lit("")) for c in IMPORT_FIELDS}
    out["company"] = F.coalesce(F.nullif(T.stripped(out["company"]), F.lit("")), F.lit("Unknown"))
    out["status"] = F.coalesce(out["status"], F.lit("Interesting"))
    return out


def coerced(rows: DataFrame) -> DataFrame:
    """The import fields of any rows, with id and pos if there are any."""
    out = import_columns(lambda c: F.col(c) if c in rows.columns else F.lit(None))
    return rows.select(*[c for c in ("id", "pos") if c in rows.columns], *[c.alias(n) for n, c in out.items()])


def importable(rows: DataFrame, from_csv: bool = False) -> DataFrame:
    """Rows with a company; a CSV import also leaves out the literal Unknown."""
    out = rows.where(T.trimmed(F.col("company")) != "")
    return out.where("company != 'Unknown'") if from_csv else out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects; every field is read as text."""
    schema = ", ".join(f"{c} string" for c in IMPORT_FIELDS)
    return coerced(spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST"))


def imported(rows: DataFrame, payload: Column) -> DataFrame:
    """rows with a row for each object of a JSON array of objects, with the import fields. A payload that isn't an array fails."""
    schema = "array<struct<" + ",".join(f"{c}:string" for c in IMPORT_FIELDS) + ">>"
    each = rows.drop(*IMPORT_FIELDS).withColumn("_row", F.explode(F.from_json(payload, schema, {"mode": "FAILFAST"})))
    return each.select(*[c for c in each.columns if c != "_row"], *[c.alias(n) for n, c in import_columns(lambda n: F.col(f"_row.{n}")).items()]).drop("_row")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return importable(coerced(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)), from_csv=True)


def csv_cells(line: Column) -> Column:
    """The cells of a line as older exports were read: empty cells without quotes are passed over, so that later ones
    move to the left; quotes off, doubled quotes single, trimmed."""
    found = F.regexp_extract_all(line, F.lit('"[^"]*(?:""[^"]*)*"|[^,]+'), F.lit(0))
    # The pattern is unrolled: Java's regular expressions would recurse over each character of a quoted cell.
    return F.transform(found, lambda c: T.stripped(F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))))


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV import line by line (csv_cells). The first line with anything in it names the columns of its own file, so a
    folder may hold files with other columns in other orders; lines like it are passed over. Columns of other names are
    ignored, absent ones null, and a file without lines gives no rows."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.where("value != ''")
    heads = lines.groupBy("_file").agg(F.min_by("value", F.struct("_block", "_line")).alias("_head"))  # a row a file
    names = F.transform(F.split("_head", ","), lambda n: T.stripped(F.regexp_replace(T.stripped(n), '^"|"$', "")))
    # The heads go to the lines, so that the lines of a file aren't one task's. A row's cells are exploded as one element:
    # columns that are read by filters above would be worked out again in each of them.
    rows = lines.join(F.broadcast(heads.withColumn("_names", names)), "_file").where("value != _head").select("_names", F.explode(F.array(csv_cells(F.col("value")))).alias("_cells"))

    def cell(name: str) -> Column:
        at = F.array_position("_names", F.lit(name)).cast("int")
        return F.when(at > 0, F.get("_cells", at - 1)).alias(name)

    return importable(coerced(rows.select(*[cell(n) for n in EXPORT_FIELDS if n != "id"])), from_csv=True)


def read_generations(spark: SparkSession, paths: list[str], schema: StructType) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(rows, changes): Parquet folders that were written with fewer columns, others, or other types, as rows of schema.

    Missing columns are null. A value that the wanted type can't hold fails the query; it never turns into null. changes
    has (folder, column, what): "added" for a missing column, "<old> to <new>" for another type, "left out" for one
    that schema lacks. Only the folders' footers are read for it."""
    parts, changes = [], []
    for path in paths:
        own = spark.read.option("mergeSchema", True).parquet(path)
        have = {f.name: f.dataType for f in own.schema}
        columns = []
        for f in schema:
            if f.name not in have:
                changes.append((path, f.name, "added"))
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif have[f.name] == f.dataType:
                columns.append(F.col(f.name))
            else:
                changes.append((path, f.name, f"{have[f.name].simpleString()} to {f.dataType.simpleString()}"))
                cast = F.col(f.name).try_cast(f.dataType)
                lost = F.raise_error(F.concat(F.lit(f"{f.name} of {path} can't be {f.dataType.simpleString()}: "), F.col(f.name).cast("string")))
                columns.append(F.when(cast.isNotNull() | F.col(f.name).isNull(), cast).otherwise(lost.cast(f.dataType)).alias(f.name))
        changes += [(path, c, "left out") for c in have if c not in schema.names]
        parts.append(own.select(*columns))
    rows = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows, changes


def csv_line(columns: tuple[str, ...] = EXPORT_FIELDS) -> Column:
    """One line of the CSV export: every cell in quotes, quotes doubled, nulls empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[cell(c) for c in columns])


def write_csv(items: DataFrame, path: str) -> None:
    items.select(*EXPORT_FIELDS).fillna("").write.csv(path, header=True, quoteAll=True, escape='"', nullValue="")


def json_line(columns: tuple[str, ...] = EXPORT_FIELDS) -> Column:
    """One object of the JSON export; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(items: DataFrame, path: str) -> None:
    items.write.json(path, ignoreNullFields=False)


def backup(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def missing_fields() -> Column:
    """The mandatory fields that are blank."""
    return F.array_compact(F.array(*[F.when(T.stripped(T.text(c)) == "", F.lit(c)) for c in ("company", "status")]))


def save_problem(*names: str) -> Column:
    """The first of the fields that keeps a row from being saved; null if none does. A status may be blank, not empty."""
    absent = lambda c: (T.text(c) == "") if c == "status" else (T.stripped(T.text(c)) == "")
    return F.coalesce(*[F.when(absent(c), F.lit(c)) for c in names])


def editable(items: DataFrame) -> DataFrame:
    """The fields of items that a caller may send back: all but id, file, listing state and times."""
    return items.select(*[c for c in ITEM_FIELDS if c not in SYSTEM_FIELDS and c in items.columns])
