"""Graphs of files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from treeloom.build import build_graph
from treeloom.functions import pysource
from treeloom.operators.parse import parse_lazily
from treeloom.sources.store import save_graph


def parse_stream(files: DataFrame) -> DataFrame:
    """Parsing has no state: the same rows as in batch, for a stream of files."""
    return parse_lazily(files, pysource.MAX_LINES)


def graph_stream(files: DataFrame, files_folder: str, graph_folder: str) -> DataStreamWriter:
    """Rebuilds the snapshots that a batch touches, from all their files so far.

    Names resolve within a whole snapshot, so every batch is first added to
    ``files_folder`` (a batch that is run again replaces its own part) and the
    touched snapshots are then resolved afresh and overwritten.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(files_folder)
        everything = spark.read.parquet(files_folder)
        touched = everything.filter(F.col("batch") == number).select("repo", "commit").distinct()
        newest = everything.join(touched, ["repo", "commit"], "left_semi").groupBy("repo", "commit", "path").agg(F.max_by("content", "batch").alias("content"))
        if not newest.isEmpty():
            save_graph(build_graph(newest), graph_folder)

    return files.writeStream.foreachBatch(step)
