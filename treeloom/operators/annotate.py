"""Call context of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions import schemas

SNAP = ["repo", "commit"]


def call_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``caller_count`` and ``direct_callers`` on what can be called.

    Every ``calls`` edge counts; callers that are no nodes are counted, not listed.
    Callers are sorted by id.
    """
    known = nodes.select(*SNAP, F.col("id").alias("source"), F.struct("id", "label", "type").alias("caller"))
    calls = edges.filter("relation = 'calls'").select(*SNAP, "source", "target")
    context = (
        calls.join(known, [*SNAP, "source"], "left")
        .groupBy(*SNAP, F.col("target").alias("id"))
        .agg(F.count(F.lit(1)).cast("int").alias("caller_count"), F.array_sort(F.collect_list("caller")).alias("direct_callers"))
    )
    joined = nodes.drop("caller_count", "direct_callers").join(context, [*SNAP, "id"], "left")
    target = F.col("type").isin(*schemas.CALLABLE)
    none = F.array().cast("array<struct<id:string,label:string,type:string>>")
    return joined.withColumn("caller_count", F.when(target, F.coalesce("caller_count", F.lit(0)))).withColumn(
        "direct_callers", F.when(target, F.coalesce("direct_callers", none))
    )
