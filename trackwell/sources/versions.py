"""Tables that change together: each change is a version, which a reader sees whole or not at all.

A version is a small file of names and folders. Changed tables are written into folders of their own first; one rename to
the next version's number, which fails if that number is there, then makes them the current ones. A writer that stops
before it leaves the old version; of two writers of one number the second fails, and none overwrites what another reads.
The file system's rename must be atomic and not overwrite (HDFS, local disks; on object stores take a catalog's tables).

A table is written in the order of its cluster columns, a file a range, and the version notes each file's least and
greatest value of the first of them: a look-up by it reads the files that can have it, which is what an index was for."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackwell.sources.shared import place

VERSIONS = "_versions"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions, in order."""
    where, files = place(spark, f"{path}/{VERSIONS}")
    if not files.exists(where):
        return []
    names = [x.getPath().getName() for x in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    text = "" if not number else spark.read.text(f"{path}/{VERSIONS}/{number:010d}.json", wholetext=True).first()[0]
    return json.loads(text) if text else {}


def _put(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """The one step that makes a version current."""
    target, files = place(spark, f"{path}/{VERSIONS}/{number:010d}.json")
    draft, _ = place(spark, f"{path}/{VERSIONS}/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(draft, target, none)  # fails if the target is there


def _written(df: DataFrame, folder: str, cluster: list[str], files: int | None) -> dict:
    """Writes a table; what a version notes of it."""
    order = [F.col(c) for c in cluster]
    if cluster:
        df = (df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    df.write.parquet(folder)
    noted = {"folder": folder, "schema": df.schema.json(), "by": cluster[0] if cluster else None, "files": None}
    if cluster:
        own = df.sparkSession.read.schema(df.schema).parquet(folder)
        bounds = own.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(cluster[0]).alias("low"), F.max(cluster[0]).alias("high"), F.count_if(F.col(cluster[0]).isNull()).alias("nulls"))
        noted["files"] = [[r["file"], r["low"], r["high"], r["nulls"]] for r in bounds.collect()]  # a row a file
    return noted


def committed(spark: SparkSession, path: str, tables: dict[str, DataFrame], cluster: dict[str, list[str]] | None = None, files: int | None = None) -> int:
    """Makes the tables current, all at once, beside those of the current version that aren't given; the new number.

    cluster: the columns in whose order a table is kept (the first a number or a string); files: into how many files, by
    default as many as shuffles have partitions. Frames may read the current version."""
    number = max(numbers(spark, path), default=0)
    manifest = _manifest(spark, path, number)
    for name, df in tables.items():
        by = (cluster or {}).get(name, [])
        manifest[name] = _written(df, f"{path}/{name}/{uuid.uuid4().hex}", by, files)
    _put(spark, path, number + 1, manifest)
    return number + 1


def table(spark: SparkSession, path: str, name: str, key: int | str | None = None, version: int | None = None) -> DataFrame:
    """A table of the current version, or of an earlier one. key: only rows with this value of the first cluster column,
    from the files that can have them."""
    number = version or max(numbers(spark, path), default=0)
    noted = _manifest(spark, path, number)[name]
    schema = StructType.fromJson(json.loads(noted["schema"]))
    if key is None:
        return spark.read.schema(schema).parquet(noted["folder"])
    if noted["files"] is None:
        raise ValueError(f"{name} isn't kept in the order of a column")
    some = [f for f, low, high, _ in noted["files"] if low is not None and low <= key <= high]
    rows = spark.read.schema(schema).parquet(*some) if some else spark.createDataFrame([], schema)
    return rows.where(F.col(noted["by"]) == key)


def swept(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes versions but the last `keep`, and the folders that only they name; the folders deleted. Nothing may read
    them any more."""
    every = numbers(spark, path)
    used = {t["folder"] for n in every[-keep:] for t in _manifest(spark, path, n).values()}
    gone = sorted({t["folder"] for n in every[:-keep] for t in _manifest(spark, path, n).values()} - used)
    for n in every[:-keep]:
        where, files = place(spark, f"{path}/{VERSIONS}/{n:010d}.json")
        files.delete(where, False)
    for folder in gone:
        where, files = place(spark, folder)
        files.delete(where, True)
    return gone
