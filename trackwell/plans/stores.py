"""Queries over tables that change together, are kept in an order, and come from several generations of writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.operators import items as I
from trackwell.plans import views as V
from trackwell.plans.boards import ITEM
from trackwell.plans.queries import NOW, query
from trackwell.plans.searches import _fresh
from trackwell.plans.views import DOCUMENTS, ITEMS, LOG
from trackwell.sources import records as R, versions


def _store(spark: SparkSession, sf: str) -> str:
    """Items, their history and their documents as the first version of a store."""
    path = _fresh(spark, "store")
    history = I.with_from_status(V.log(spark, sf)).select("id", "job_id", "from_status", "to_status", "changed_at")
    tables = {"items": V.items(spark, sf), "history": history, "documents": V.documents(spark, sf)}
    versions.committed(spark, path, tables, {"items": ["id"], "history": ["job_id", "changed_at"]})
    return path


@query(f"""with {ITEMS}, {LOG}, {DOCUMENTS}, top as (select max(id) as top from items),
grown as (select id, company, status, updated_at from items union all select top + row_number() over (order by id), company, status, '{NOW}' from items, top where id % 50 = 0),
shifted as (select id, company, case when id % 4 = 0 then 'Done' else status end as status, case when id % 4 = 0 then '{NOW}' else updated_at end as updated_at from grown),
told as (select job_id, to_status, changed_at from log union all select id, 'Done', '{NOW}' from grown where id % 4 = 0)
select 'item' as kind, id, status, updated_at as at, company as name from shifted where id % 3 != 0
union all select 'history', job_id, to_status, changed_at, null from told where job_id % 3 != 0
union all select 'document', job_id, doc_type, null, file_path from documents_of_items where job_id % 3 != 0""")
def committed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """An import, a move and a delete, each one version of the three tables, read back at the end."""
    path = _store(spark, sf)
    at = lambda name: versions.table(spark, path, name)
    order = {"items": ["id"], "history": ["job_id", "changed_at"]}
    every = at("items")
    new = every.where("id % 50 = 0").withColumn("pos", F.col("id")).drop("id", "created_at", "updated_at")
    versions.committed(spark, path, {"items": I.appended(every, new, NOW)}, order)
    every = at("items")
    after, log = I.moved(every, every.where("id % 4 = 0").select("id", F.lit("Done").alias("status")), NOW)
    versions.committed(spark, path, {"items": after, "history": I.logged(at("history"), log)}, order)
    gone = at("items").where("id % 3 = 0").select("id").union(at("history").where("job_id % 3 = 0").select("job_id")).union(at("documents").where("job_id % 3 = 0").select("job_id"))
    left = I.deleted(gone, {"items:id": at("items"), "history:job_id": at("history"), "documents:job_id": at("documents")})
    versions.committed(spark, path, {name.split(":")[0]: df for name, df in left.items()}, order)
    none = F.lit(None).cast("string")
    items = at("items").select(F.lit("item").alias("kind"), "id", "status", F.col("updated_at").alias("at"), F.col("company").alias("name"))
    history = at("history").select(F.lit("history"), "job_id", "to_status", "changed_at", none)
    return items.union(history).union(at("documents").select(F.lit("document"), "job_id", "doc_type", none, "file_path"))


@query(f"with {LOG} select id, job_id, to_status, changed_at from log where job_id = {ITEM}")
def history_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The history of one item, from the files of a store that can have it."""
    return versions.table(spark, _store(spark, sf), "history", key=ITEM).select("id", "job_id", "to_status", "changed_at")


@query(f"with {ITEMS} select id, company, case when id % 2 = 1 then title end as title, priority, null::varchar as notes from items")
def mixed_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Items of two generations of writers: the older one has no titles and wrote priorities as texts."""
    path, i = _fresh(spark, "generations"), V.items(spark, sf)
    i.where("id % 2 = 0").select("id", "company", F.col("priority").cast("string").alias("priority")).write.parquet(f"{path}/1")
    i.where("id % 2 = 1").select("company", "title", "priority", "id", F.lit("x").alias("extra")).write.parquet(f"{path}/2")
    schema = spark.createDataFrame([], "id long, company string, title string, priority long, notes string").schema
    return R.read_generations(spark, [f"{path}/1", f"{path}/2"], schema)[0]


@query(f"with {ITEMS}, {DOCUMENTS} select 'item' as kind, id, company as name from items union all select 'document', job_id, file_path from documents_of_items where job_id % 40 = 0")
def backup_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Items and documents read back from a backup that was made twice; the second copy overwrote the first."""
    path, every = _fresh(spark, "backup"), V.documents(spark, sf)
    R.backup({"items": V.items(spark, sf), "documents": every}, path)
    R.backup({"documents": every.where("job_id % 40 = 0")}, path)
    items = spark.read.parquet(f"{path}/items").select(F.lit("item").alias("kind"), "id", F.col("company").alias("name"))
    return items.union(spark.read.parquet(f"{path}/documents").select(F.lit("document"), "job_id", "file_path"))
