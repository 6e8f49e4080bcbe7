"""The sample tables in the shape of items, results, history and documents; the same views as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-15 12:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items."""
    o, c, n = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    k, day = F.col("o_orderkey"), lambda d: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), d), "yyyy-MM-dd")
    return j.select(
        k.alias("id"), F.col("c_name").alias("company"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("title"),
        F.when(k % 9 != 0, F.concat(F.lit("https://www.Site"), (k % 5000).cast("string"), F.lit(".example.com/jobs?jk=a%20"), (k % 11).cast("string"))).alias("url"),
        F.col("o_orderstatus").alias("status"), F.when(k % 5 != 0, day(0)).alias("deadline"), F.when(k % 3 == 0, day(14)).alias("interview_date"),
        F.when(k % 4 == 0, day(60)).alias("start_date"), F.when(k % 6 != 0, k % 10 + 1).alias("priority"), F.col("n_name").alias("workplace_city"),
        F.concat("c_mktsegment", F.lit(";"), "o_orderpriority", F.lit(","), "n_name").alias("tags"), day(0).alias("created_at"), day(1).alias("updated_at"),
        F.when(k % 10 == 0, F.concat(F.lit("/files/"), k.cast("string"), F.lit("/cv "), k.cast("string"), F.lit(".pdf"))).alias("pdf_path"),
    )


ITEMS = """items as (
  select o_orderkey as id, c_name as company, case when o_orderkey % 7 != 0 then o_orderpriority end as title,
    case when o_orderkey % 9 != 0 then 'https://www.Site' || (o_orderkey % 5000) || '.example.com/jobs?jk=a%20' || (o_orderkey % 11) end as url,
    o_orderstatus as status, case when o_orderkey % 5 != 0 then strftime(o_orderdate, '%Y-%m-%d') end as deadline,
    case when o_orderkey % 3 = 0 then strftime(o_orderdate + interval 14 day, '%Y-%m-%d') end as interview_date,
    case when o_orderkey % 4 = 0 then strftime(o_orderdate + interval 60 day, '%Y-%m-%d') end as start_date,
    case when o_orderkey % 6 != 0 then o_orderkey % 10 + 1 end as priority, n_name as workplace_city,
    c_mktsegment || ';' || o_orderpriority || ',' || n_name as tags,
    strftime(o_orderdate, '%Y-%m-%d') as created_at, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as updated_at,
    case when o_orderkey % 10 = 0 then '/files/' || o_orderkey || '/cv ' || o_orderkey || '.pdf' end as pdf_path
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

_DATES = ("today", "Yesterday", "3 days ago", "2w", "3 weeks ago", "5 hours ago", "2001-08-01", "2001-07-20T08:00:00Z", "2001-08-10T08:00:00", "", "17", "1 month ago")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search results; URLs repeat, dates take every form."""
    d = _read(spark, sf_dir, "documents")
    platforms = F.array(*[F.lit(x) for x in ("jobindex", "indeed", "linkedin", "thehub")])
    k = F.col("doc_id")
    return d.select(
        k.alias("pos"), F.get(platforms, (k % 4).cast("int")).alias("platform"), F.substring("text", 1, 80).alias("title"), F.col("source").alias("company"),
        F.substring("text", 1, 400).alias("description"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("https://jobindex.dk/View/"), (k % 700).cast("string"))).alias("url"),
        F.col("lang").alias("location"), F.get(F.array(*[F.lit(x) for x in _DATES]), (k % 12).cast("int")).alias("published_date"),
    )


RESULTS = f"""results as (
  select doc_id as pos, (['jobindex', 'indeed', 'linkedin', 'thehub'])[doc_id % 4 + 1] as platform, substr(text, 1, 80) as title, source as company,
    substr(text, 1, 400) as description, case when doc_id % 13 = 0 then '' else 'https://jobindex.dk/View/' || (doc_id % 700) end as url, lang as location,
    ({list(_DATES)})[doc_id % 12 + 1] as published_date
  from documents)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("to_status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("changed_at"))


LOG = "log as (select event_id as id, user_id as job_id, event_type as to_status, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as changed_at from events)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as items' files: every other item's file is there already."""
    k = F.col("doc_id")
    return _read(spark, sf_dir, "labels").select(k.alias("id"), (k * 20).alias("job_id"), F.when(F.col("toxic") == 1, "cv").otherwise("application").alias("doc_type"), F.concat(F.lit("/files/"), (k * 20).cast("string"), F.lit("/cv "), (k * 20).cast("string"), F.lit(".pdf")).alias("file_path"))


DOCUMENTS = "documents_of_items as (select doc_id as id, doc_id * 20 as job_id, case when toxic = 1 then 'cv' else 'application' end as doc_type, '/files/' || (doc_id * 20) || '/cv ' || (doc_id * 20) || '.pdf' as file_path from labels)"
