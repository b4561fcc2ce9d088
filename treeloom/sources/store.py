"""Stored graphs and contexts: Parquet by snapshot, and JSON for exchange."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from treeloom.functions import schemas
from treeloom.operators.context import Contexts
from treeloom.operators.graph import CodeGraph

#: Columns that are not part of a node's metadata.
_NODE_KEYS = ("id", "type", "label")
#: Metadata that graphs of other makers may have; a node without it has null.
_OPTIONAL = ("branch_count int", "type_hints map<string,string>", "exceptions array<string>")
_EDGE_META = ("confidence", "import_resolved", "via", "source_tool", "derived_from")


# --- Parquet, the engine's own form


def save_graph(graph: CodeGraph, folder: str) -> None:
    """Writes the graph's snapshots; others in the folder stay as they are.

    ``meta`` is written last: a graph whose write broke off is not found by
    :func:`load_graph`.
    """
    tables = (("nodes", graph.nodes), ("edges", graph.edges), ("meta", graph.meta.withColumn("commit", F.col("base_commit"))))
    for name, table in tables:
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "commit").parquet(f"{folder}/{name}")


def load_graph(spark: SparkSession, folder: str, repo: str, commit: str) -> CodeGraph | None:
    """The stored snapshot; None if it is missing or of another schema version."""
    try:
        meta = _read(spark, f"{folder}/meta", f"{schemas.GRAPH_META}, commit string")
        mine = meta.filter((F.col("repo") == repo) & (F.col("commit") == commit) & (F.col("base_commit") == commit) & (F.col("schema_version") == schemas.SCHEMA_VERSION)).drop("commit")
        if mine.isEmpty():
            return None
        pick = lambda df: df.filter((F.col("repo") == repo) & (F.col("commit") == commit))
        return CodeGraph(pick(_read(spark, f"{folder}/nodes", schemas.NODES)), pick(_read(spark, f"{folder}/edges", schemas.EDGES)), mine)
    except AnalysisException:
        return None


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(path)


# --- JSON, one document for each graph or context


def json_name(repo: str, commit: str) -> str:
    return f"graph_{re.sub(r'[/.-]', '_', repo)}_{commit[:8]}.json"


def _node_json(nodes: DataFrame):
    rest = [c for c in nodes.columns if c not in (*_NODE_KEYS, "commit", "src_path", "emit_ord", "instance_id", "role")]
    return F.struct(*_NODE_KEYS, F.struct(*rest).alias("metadata"))


def _edge_json(edges: DataFrame):
    """The tool's name goes by its key in the file format, ``source``."""
    meta = F.struct(*[F.col(c).alias("source" if c == "source_tool" else c) for c in _EDGE_META if c in edges.columns])
    return F.struct("source", "target", "relation", meta.alias("metadata"))


def graph_documents(graph: CodeGraph) -> DataFrame:
    """``(repo, commit, json)``: ``{"nodes", "edges", "metadata"}`` of each snapshot; null metadata is left out."""
    by = ["repo", "commit"]
    nodes = graph.nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.to_json(_node_json(graph.nodes)))).alias("n"))
    edges = graph.edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.to_json(_edge_json(graph.edges)))).alias("e"))
    meta = graph.meta.select("repo", F.col("base_commit").alias("commit"), F.to_json(F.struct(*[c for c in graph.meta.columns])).alias("m"))
    join = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    whole = meta.join(nodes, by, "left").join(edges, by, "left")
    return whole.select(*by, F.concat(F.lit('{"nodes":'), join("n"), F.lit(',"edges":'), join("e"), F.lit(',"metadata":'), "m", F.lit("}")).alias("json"))


def export_graph_json(graph: CodeGraph, folder: str) -> list[str]:
    """One file for each snapshot, for programs that read JSON; the documents pass the driver one by one."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in graph_documents(graph).toLocalIterator():
        path = Path(folder) / json_name(row["repo"], row["commit"])
        path.write_text(row["json"])
        out.append(str(path))
    return out


def _node_schema() -> str:
    fields = [f for f in [*_split(schemas.NODES), *_OPTIONAL] if f.split()[0] not in (*_NODE_KEYS, "commit", "src_path", "emit_ord")]
    inner = ",".join(":".join(f.split(None, 1)) for f in fields)
    return f"struct<id:string,type:string,label:string,metadata:struct<{inner}>>"


def _split(ddl: str) -> list[str]:
    parts, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


_EDGE_SCHEMA = "struct<source:string,target:string,relation:string,metadata:struct<confidence:string,import_resolved:string,via:string,source:string,derived_from:string>>"


def _nodes_of(docs: DataFrame, column: str, *keep) -> DataFrame:
    flat = docs.select(*keep, F.explode(column).alias("x"))
    rest = [f.split()[0] for f in [*_split(schemas.NODES), *_OPTIONAL] if f.split()[0] not in (*_NODE_KEYS, "repo", "commit", "src_path", "emit_ord")]
    return flat.select(*[k for k in keep], "x.id", "x.type", "x.label", *[F.col(f"x.metadata.{c}").alias(c) for c in rest])


def _edges_of(docs: DataFrame, *keep) -> DataFrame:
    flat = docs.select(*keep, F.explode("edges").alias("x"))
    meta = [F.col(f"x.metadata.{'source' if c == 'source_tool' else c}").alias(c) for c in _EDGE_META]
    return flat.select(*keep, "x.source", "x.target", "x.relation", *meta)


def import_graph_json(spark: SparkSession, path: str, repo: str | None = None, commit: str | None = None) -> CodeGraph | None:
    """Reads graph documents; None if nothing is there, or not of this commit and schema version."""
    ddl = f"nodes array<{_node_schema()}>, edges array<{_EDGE_SCHEMA}>, metadata struct<repo:string,base_commit:string,file_count:bigint,parsed_count:bigint,parse_mode:string,schema_version:int>"
    try:
        docs = spark.read.schema(ddl).json(path, multiLine=True)
        docs = docs.filter(F.col("metadata.schema_version") == schemas.SCHEMA_VERSION)
        if repo is not None:
            docs = docs.filter(F.col("metadata.repo") == repo)
        if commit is not None:
            docs = docs.filter(F.col("metadata.base_commit") == commit)
        if docs.isEmpty():
            return None
    except AnalysisException:
        return None
    keys = [F.col("metadata.repo").alias("repo"), F.col("metadata.base_commit").alias("commit")]
    nodes = _nodes_of(docs.select(*keys, "nodes"), "nodes", "repo", "commit").withColumns({"src_path": F.coalesce("path", "filepath"), "emit_ord": F.lit(0)})
    return CodeGraph(nodes, _edges_of(docs.select(*keys, "edges"), "repo", "commit"), docs.select("metadata.*"))


def context_documents(contexts: Contexts) -> DataFrame:
    """``(instance_id, json)`` with seeds, context nodes, edges, tests and their numbers."""
    node = _node_json(contexts.nodes)
    pick = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.to_json(node))))
    nodes = contexts.nodes.groupBy("instance_id").agg(pick("seed").alias("seeds"), pick("context").alias("context_nodes"), pick("test").alias("test_nodes"))
    edges = contexts.edges.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.to_json(_edge_json(contexts.edges)))).alias("edges"))
    whole = contexts.counts().join(nodes, "instance_id", "left").join(edges, "instance_id", "left")
    lists = [F.concat(F.lit(f'"{c}":['), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]")) for c in ("seeds", "context_nodes", "edges", "test_nodes")]
    stats = F.to_json(F.struct("num_seeds", "num_context_nodes", "num_edges", "num_test_nodes"))
    head = F.concat(F.lit('"repo":'), F.to_json(F.array("repo")), F.lit(',"base_commit":'), F.to_json(F.array("base_commit")))
    head = F.regexp_replace(head, r':\["', ':"')
    head = F.regexp_replace(head, r'"\]', '"')
    return whole.select("instance_id", F.concat(F.lit("{"), F.concat_ws(",", head, *lists, F.concat(F.lit('"stats":'), stats)), F.lit("}")).alias("json"))


def save_context(contexts: Contexts, instance_id: str, path: str) -> None:
    row = context_documents(contexts).filter(F.col("instance_id") == instance_id).first()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(row["json"])


def load_context(spark: SparkSession, path: str, instance_id: str = "loaded") -> Contexts:
    """Reads what :func:`save_context` wrote; the statistics are not needed."""
    node = _node_schema()
    ddl = f"repo string, base_commit string, seeds array<{node}>, context_nodes array<{node}>, edges array<{_EDGE_SCHEMA}>, test_nodes array<{node}>"
    docs = spark.read.schema(ddl).json(path, multiLine=True).withColumn("instance_id", F.lit(instance_id)).withColumn("commit", F.col("base_commit"))
    parts = [_nodes_of(docs, column, "instance_id", "repo", "commit").withColumn("role", F.lit(role)) for column, role in (("seeds", "seed"), ("context_nodes", "context"), ("test_nodes", "test"))]
    nodes = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return Contexts(docs.select("instance_id", "repo", "base_commit"), nodes, _edges_of(docs, "instance_id", "repo", "commit"))
