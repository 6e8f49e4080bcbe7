"""Helpers that the training-data operators share: table reading, lineage cuts, functions over texts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackwell.sources.shared import discard, scratch  # noqa: F401  (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(rows: DataFrame, text: str, keep: list[str], added: str, function: Callable, group: int = 512) -> DataFrame:
    """The columns `keep` of rows with the columns `added` (DDL), which function makes of the texts.

    function takes a list of texts and gives a list for each added column; if it makes several rows of a text, or
    none, it gives one list more, first: each row's place among the texts. What is kept goes by in Arrow as it is, so
    no id, null or large number changes on its way through Python. Texts come `group` at a time."""
    more = StructType.fromDDL(added)
    schema = StructType([rows.schema[c] for c in keep] + more.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(more)
        for b in batches:
            for i in range(0, b.num_rows, group):
                part = b.slice(i, group)
                made = list(function(part.column(text).to_pylist()))
                own = [part.column(c) for c in keep]
                if len(made) > len(kinds):
                    at = pa.array(made.pop(0), pa.int64())
                    own = [c.take(at) for c in own]
                yield pa.RecordBatch.from_arrays(own + [pa.array(v, f.type) for v, f in zip(made, kinds)], names=[*keep, *kinds.names])

    return rows.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): a row (node, component) for each node, component its smallest node.

    Alternating large-star and small-star rounds: every round is two aggregations with map-side combine and two
    joins that AQE can split, so a hub with very many edges never meets in one task. Rounds grow with the logarithm
    of a component's size. No edges give no rows."""
    edges = scratch(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("m").alias("u")), F.struct(F.col("b").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.u", "e.v")
        old, edges = edges, scratch(small.where("u != v").distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
