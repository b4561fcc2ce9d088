"""A graph as two tables, with lookups that return lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import schemas
from treeloom.plans.staging import few


@dataclass
class CodeGraph:
    """``nodes`` needs ``id, type, label``; ``edges`` needs ``source, target, relation``.

    Ids are unique within a snapshot; a graph of several snapshots is narrowed with
    :meth:`snapshot` before lookups by id.
    """

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame | None = None

    def snapshot(self, repo: str, commit: str) -> CodeGraph:
        one = lambda df, commit_column: df.filter((F.col("repo") == repo) & (F.col(commit_column) == commit))
        return CodeGraph(one(self.nodes, "commit"), one(self.edges, "commit"), one(self.meta, "base_commit") if self.meta is not None else None)

    # --- filters

    def files(self) -> DataFrame:
        return self.nodes.filter(F.col("type").isin(*schemas.FILE_TYPES))

    def functions(self) -> DataFrame:
        return self.nodes.filter(F.col("type").isin(*schemas.CALLABLE))

    def find_file_by_path(self, path, exact=False) -> DataFrame:
        """Files whose path is, or contains, ``path``; case matters."""
        return self.files().filter((F.col("path") == path) if exact else F.coalesce("path", F.lit("")).contains(path))

    def find_function_by_name(self, name: str) -> DataFrame:
        return self.functions().filter(F.col("label") == name)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    # --- one hop

    def _across(self, relation: str, given: str, wanted: str, node_id: str | None) -> DataFrame:
        """Nodes at the other end of a relation; all pairs (column ``of``) if no id is given."""
        hop = self.edges.filter(F.col("relation") == relation).select(F.col(given).alias("of"), F.col(wanted).alias("id"))
        if node_id is not None:
            hop = hop.filter(F.col("of") == node_id)
        found = hop.join(self.nodes, "id")
        return found.drop("of") if node_id is not None else found

    def find_callers(self, function_id: str | None = None) -> DataFrame:
        return self._across("calls", "target", "source", function_id)

    def find_callees(self, function_id: str | None = None) -> DataFrame:
        return self._across("calls", "source", "target", function_id)

    def find_test_functions_for(self, function_id: str | None = None) -> DataFrame:
        """Test functions that call it."""
        return self.find_callers(function_id).filter("type = 'test_function'")

    def get_class_methods(self, class_id: str | None = None) -> DataFrame:
        return self._across("contains", "source", "target", class_id)

    def get_file_contents(self, file_id: str | None = None) -> DataFrame:
        """``(of, file, classes, functions)``: a node, and the classes, functions and tests that it contains itself.

        All are whole nodes, lists are sorted by id; methods belong to their class and
        are not listed.  No row for an unknown id.
        """
        held = self._across("contains", "source", "target", None).filter(F.col("type").isin("class", "function", "test_function"))
        if file_id is not None:
            held = held.filter(F.col("of") == file_id)
        item = F.struct(*self.nodes.columns)
        by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
        pick = lambda which: F.array_sort(F.collect_list(F.when(which, item)), by_id)
        is_class: Column = F.col("type") == "class"
        split = held.groupBy("of").agg(pick(is_class).alias("classes"), pick(~is_class).alias("functions"))
        asked = self.nodes if file_id is None else self.node(file_id)
        kind = dict(split.dtypes)["classes"]
        empty = F.array().cast(kind)
        return asked.select(F.col("id").alias("of"), item.alias("file")).join(split, "of", "left").select(
            "of", "file", F.coalesce("classes", empty).alias("classes"), F.coalesce("functions", empty).alias("functions")
        )

    def export_subgraph(self, ids: DataFrame | list[str]) -> CodeGraph:
        """The known seeds, all edges out of them (as they are), and the targets that exist."""
        seeds = ids if isinstance(ids, DataFrame) else self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        # few seeds and few targets go to the edges and nodes, which then stay where they are
        known = few(self.nodes.join(few(seeds.select("id").distinct(), "seeds"), "id", "left_semi").select("id"), "seeds")
        out = self.edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi")
        wanted = known.union(out.select(F.col("target").alias("id")))
        return CodeGraph(self.nodes.join(wanted, "id", "left_semi"), out, self.meta)

    def edge_histogram(self) -> DataFrame:
        return self.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation")
