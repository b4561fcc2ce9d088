"""Graphs of small source trees."""

from textwrap import dedent

from treeloom.build import build_graph
from treeloom.functions import schemas


def files(spark, sources, repo="acme/demo", commit="c1"):
    return spark.createDataFrame([(repo, commit, p, dedent(s)) for p, s in sources.items()], schemas.FILES)


class Names:
    """A graph by names: nodes as ``path::Class.label``."""

    def __init__(self, graph):
        self.graph = graph
        self.nodes = {r["id"]: r for r in graph.nodes.collect()}
        self.edges = graph.edges.collect()

    def name(self, key):
        r = self.nodes.get(key)
        if r is None:
            return key
        if r["type"] in ("file", "test_file"):
            return r["path"]
        if r["type"] == "import":
            return f"import {r['label']}"
        return f"{r['filepath']}::{r['class'] + '.' if r['class'] else ''}{r['label']}"

    def of(self, relation):
        return {(self.name(e["source"]), self.name(e["target"])) for e in self.edges if e["relation"] == relation}

    def meta(self, relation, source, target):
        return next(e for e in self.edges if e["relation"] == relation and (self.name(e["source"]), self.name(e["target"])) == (source, target))

    def node(self, name):
        return next(r for k, r in self.nodes.items() if self.name(k) == name)


def build(spark, sources, **options):
    return Names(build_graph(files(spark, sources), **options))
