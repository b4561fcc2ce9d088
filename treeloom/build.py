"""From source files to a graph, and from a graph and diffs to documents."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import naming, pysource, schemas
from treeloom.operators import annotate, document, validate
from treeloom.operators.context import Contexts, extract_contexts
from treeloom.operators.graph import CodeGraph
from treeloom.operators.parse import parse_files, sites
from treeloom.operators.resolve import resolve
from treeloom.plans.staging import materialize
from treeloom.sources import store, trees, type_server


def build_graph(files: DataFrame, infer_types: bool = False, resolved_types: DataFrame | None = None, parse_mode: str = "ast", max_lines: int | None = pysource.MAX_LINES) -> CodeGraph:
    """The graph of all snapshots in ``files(repo, commit, path, content)``.

    ``max_lines`` None parses files of any length.

    ``resolved_types(repo, commit, path, line, col, type)`` adds inferred uses; with
    ``infer_types`` a language server supplies it, if there is one.
    """
    spark = files.sparkSession
    parsed = parse_files(files, max_lines)
    if resolved_types is None and infer_types and type_server.available():
        resolved_types = type_server.resolve_types(files.filter(naming.is_source_path(F.col("path"))), sites(parsed))
    bare, edges = resolve(parsed, resolved_types)
    edges = materialize(edges, "edges")
    columns = [c.split()[0] for c in store._split(schemas.NODES)]
    nodes = materialize(annotate.call_context(bare, edges).select(*columns), "graph-nodes")
    by = ["repo", "commit"]
    collected = files.filter(naming.is_source_path(F.col("path"))).groupBy(*by).agg(F.countDistinct("path").alias("file_count"))
    read = nodes.filter(F.col("type").isin(*schemas.FILE_TYPES)).groupBy(*by).agg(F.count(F.lit(1)).alias("parsed_count"))
    meta = collected.join(read, by, "left").select(
        "repo",
        F.col("commit").alias("base_commit"),
        "file_count",
        F.coalesce("parsed_count", F.lit(0)).cast("long").alias("parsed_count"),
        F.lit(parse_mode).alias("parse_mode"),
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
    )
    return CodeGraph(nodes, edges.select("repo", "commit", *[c.split()[0] for c in store._split(schemas.EDGES)[2:]]), materialize(meta, "meta"))


def build_from_folder(spark: SparkSession, folder: str | Path, repo: str, commit: str = "", **options) -> CodeGraph:
    """The graph of one source tree."""
    return build_graph(trees.read_tree(spark, folder, repo, commit), **options)


class Builder:
    """Graphs of commits, kept as Parquet in ``folder`` and built when they are missing."""

    def __init__(self, spark: SparkSession, folder: str = "graphs", mirrors: trees.Mirrors | None = None, infer_types: bool = False) -> None:
        self.spark, self.folder, self.mirrors, self.infer_types = spark, folder, mirrors, infer_types

    def build(self, repo: str, commit: str) -> CodeGraph:
        with tempfile.TemporaryDirectory() as scratch:  # the driver's; files are parsed before it goes
            tree = (self.mirrors or trees.Mirrors()).extract(repo, commit, scratch)
            rows = [(repo, commit, str(p.relative_to(tree)), p.read_bytes()) for p in sorted(tree.rglob("*.py"))]
        files = self.spark.createDataFrame(rows, schemas.FILES.replace("content string", "content binary"))
        return build_graph(files, self.infer_types)

    def save(self, graph: CodeGraph) -> None:
        store.save_graph(graph, self.folder)

    def load(self, repo, commit) -> CodeGraph | None:
        return store.load_graph(self.spark, self.folder, repo, commit)

    def load_or_build(self, repo: str, commit: str) -> CodeGraph:
        graph = self.load(repo, commit)
        if graph is None:
            self.save(self.build(repo, commit))
            graph = self.load(repo, commit)
        return graph


def surface(valid: bool, text: str, name: str, verbose: bool, strict: bool) -> None:
    """An invalid context is always seen: printed unless it was, and raised if ``strict``."""
    if valid:
        return
    if not verbose:
        print(text)
    if strict:
        raise ValueError(f"context of {name} is invalid:\n{text}")


def extract_and_validate(builder: Builder, instance: dict, depth: int = 2, verbose: bool = True, strict: bool = False) -> tuple[Contexts, str]:
    """The context of one instance and its report; the graph's own report never stops it."""
    repo, commit = instance["repo"], instance["base_commit"]
    say = print if verbose else lambda *_: None
    graph = builder.load_or_build(repo, commit)
    valid, text = validate.validate_graph(graph.nodes, graph.edges, f"Graph of {repo} at {commit[:8]}")
    say("graph: all checks passed" if valid else text)
    row = {"instance_id": "1", "test_file": None} | {k: instance.get(k) for k in ("repo", "base_commit", "patch", "code_file", "test_file")}
    instances = builder.spark.createDataFrame([tuple(row[c.split()[0]] for c in store._split(schemas.INSTANCES))], schemas.INSTANCES)
    contexts = extract_contexts(graph.nodes, graph.edges, instances, depth)
    valid, text = validate_context(contexts, "1", f"{repo} at {commit[:8]}")
    say(text)
    surface(valid, text, f"{repo} at {commit[:8]}", verbose, strict)
    return contexts, text


def validate_context(contexts: Contexts, instance_id: str, name: str) -> tuple[bool, str]:
    found = materialize(validate.context_findings(contexts.instances, contexts.nodes, contexts.edges), "findings")
    c = contexts.counts().filter(F.col("instance_id") == instance_id).first()
    stats = f"Seeds: {c['num_seeds']} | Context: {c['num_context_nodes']} | Edges: {c['num_edges']} | Tests: {c['num_test_nodes']}"
    return validate.report(found, f"Context of {name}", stats, instance_id)


def serialize(contexts: Contexts) -> DataFrame:
    """``(instance_id, json)`` documents of all contexts."""
    return document.as_json(document.documents(contexts))
