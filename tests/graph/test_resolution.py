"""Which edges must exist, and which must not, in small trees.

All trees are snapshots of one table and are built together.
"""

import pytest
from graph.helpers import Names, build, dedent, files

from treeloom.build import build_graph
from treeloom.functions import schemas
from treeloom.plans import projections
from treeloom.plans.queries import QUERIES
from treeloom.plans.staging import staged

TREES = {
    "bare/same-file": {
        "api.py": "def request(m):\n    return m\n\ndef post():\n    return request('p')\n",
        "sessions.py": "class Session:\n    def request(self):\n        return 1\n",
    },
    "bare/ambiguous": {
        "a.py": "class Alpha:\n    def get(self):\n        return 1\n",
        "b.py": "class Beta:\n    def get(self):\n        return 2\n",
        "c.py": "def do_work(obj):\n    return obj.get()\n",
    },
    "bare/unique": {"m.py": "def helper():\n    pass\n\ndef run():\n    helper()\n    somewhere_else()\n"},
    "hints/annotation": {
        "m.py": """
            class Request:
                def prepare(self): pass
            class Response:
                def prepare(self): pass
            class MockRequest:
                def prepare(self): pass
            class Session:
                def send(self, request: Request):
                    request.prepare()
                def fake(self, request: Request):
                    request = MockRequest()
                    request.prepare()
        """
    },
    "super/direct": {
        "m.py": """
            class Base:
                def greet(self): return 1
            class Child(Base):
                def greet(self): return super().greet()
        """
    },
    "super/builtin": {
        "m.py": """
            class ErrorList(list):
                def copy(self): return super().copy()
            class Widget:
                def copy(self): return 1
        """
    },
    "super/chain": {
        "m.py": """
            class A:
                def go(self): return 1
            class B(A):
                def other(self): return 2
            class C(B):
                def go(self): return super().go()
        """
    },
    "overrides/chain": {
        "m.py": """
            class A:
                def foo(self): pass
                def bar(self): pass
            class B(A):
                def foo(self): pass
            class C(B):
                def foo(self): pass
                def bar(self): pass
                def own(self): pass
                def __init__(self): pass
        """
    },
    "overrides/cycle": {
        "a.py": "class X(Y):\n    def f(self): pass\n",
        "b.py": "class Y(X):\n    def g(self): pass\n",
    },
    "uses/collision": {
        "a.py": "class Config:\n    pass\n\nclass Widget:\n    pass\n",
        "b.py": "def Config():\n    pass\n",
        "c.py": "class App:\n    def setup(self):\n        self.w = Widget()\n        return Config()\n",
    },
    "modules/two": {
        f"{p}/{f}.py": t.format(p=p)
        for p in ("pkg_a", "pkg_b")
        for f, t in (("__init__", ""), ("utils", "def tool_{p}():\n    pass\n"), ("main", "from {p}.utils import tool_{p}\n\ndef go_{p}():\n    tool_{p}()\n"))
    },
    "tests/derived": {
        "mod.py": "def target_function():\n    return 1\n",
        "test_mod.py": "from mod import target_function\n\ndef test_descriptive_name():\n    assert target_function()\n\ndef test_target_function():\n    assert target_function()\n",
    },
    "props/reads": {
        "m.py": """
            class Widget:
                @property
                def label(self): return 'x'
                def size(self): return 1
                def describe(self): return self.label
                def measure(self): return self.size
                def call(self): return self.label()
                def write(self): self.label = 2
            def show(w: Widget): return w.label
            def unknown(x): return x.label
        """
    },
    "factory/types": {
        "m.py": """
            class Session:
                pass
            class Config:
                pass
            class Parser:
                pass
            def session(): return Session()
            class Client:
                def __init__(self):
                    self.session = session()
            def configure(config: Config):
                config.parser = build_parser()
        """
    },
    "skip/some": {"docs/conf.py": "def no(): pass\n", "bad.py": "def broken(:\n", "long.py": "x = 1\n" * 5002, "crlf.py": "def ok():\r\n    return 1\r\n", "ok.txt": "no"},
}


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(repo, "c1", p, dedent(s)) for repo, tree in TREES.items() for p, s in tree.items()]
    types = [("factory/types", "c1", "m.py", 10, 13, "Session"), ("factory/types", "c1", "m.py", 12, 11, "Parser")]
    resolved = spark.createDataFrame(types, "repo string, commit string, path string, line int, col int, type string")
    graph = build_graph(spark.createDataFrame(rows, schemas.FILES), resolved_types=resolved)
    from treeloom.operators.graph import CodeGraph

    return {repo: Names(CodeGraph(graph.nodes.filter(graph.nodes.repo == repo), graph.edges.filter(graph.edges.repo == repo), graph.meta.filter(graph.meta.repo == repo))) for repo in TREES}


def test_bare_call_prefers_the_same_file(trees):
    assert trees["bare/same-file"].of("calls") == {("api.py::post", "api.py::request")}


def test_ambiguous_attribute_call_is_dropped(trees):
    assert trees["bare/ambiguous"].of("calls") == set()


def test_unique_name_is_exact_and_unknown_is_dropped(trees):
    g = trees["bare/unique"]
    assert g.of("calls") == {("m.py::run", "m.py::helper")}
    assert g.meta("calls", "m.py::run", "m.py::helper")["confidence"] == "exact"


def test_annotation_and_reassignment(trees):
    g = trees["hints/annotation"]
    assert g.of("calls") == {("m.py::Session.send", "m.py::Request.prepare"), ("m.py::Session.fake", "m.py::MockRequest.prepare")}
    assert g.meta("calls", "m.py::Session.send", "m.py::Request.prepare")["confidence"] == "qualified"


def test_super_calls(trees):
    g = trees["super/direct"]
    assert g.of("calls") == {("m.py::Child.greet", "m.py::Base.greet")}
    assert g.meta("calls", "m.py::Child.greet", "m.py::Base.greet")["via"] == "super"
    assert trees["super/builtin"].of("calls") == set()
    assert trees["super/chain"].of("calls") == {("m.py::C.go", "m.py::A.go")}
    assert not any(r["label"] == "super" for g in trees.values() for r in g.nodes.values())


def test_overrides_reach_the_nearest_definition_only(trees):
    g = trees["overrides/chain"]
    assert g.of("overrides") == {("m.py::B.foo", "m.py::A.foo"), ("m.py::C.foo", "m.py::B.foo"), ("m.py::C.bar", "m.py::A.bar")}


def test_cyclic_hierarchies_end(trees):
    assert trees["overrides/cycle"].of("overrides") == {("a.py::X.f", "a.py::X.f"), ("b.py::Y.g", "b.py::Y.g")}


def test_uses_are_unsure_when_a_function_has_the_name(trees):
    g = trees["uses/collision"]
    assert g.meta("uses", "c.py::App", "a.py::Config")["confidence"] == "ambiguous"
    assert g.meta("uses", "c.py::App", "a.py::Widget")["confidence"] == "exact"


def test_module_dependencies_stay_in_their_package(trees):
    assert trees["modules/two"].of("module_depends_on") == {(f"{p}/main.py", f"{p}/utils.py") for p in ("pkg_a", "pkg_b")}


def test_tests_by_name_and_by_call_once_each(trees):
    g = trees["tests/derived"]
    assert g.of("tests") == {("test_mod.py::test_descriptive_name", "mod.py::target_function"), ("test_mod.py::test_target_function", "mod.py::target_function")}
    assert g.meta("tests", "test_mod.py::test_descriptive_name", "mod.py::target_function")["derived_from"] == "calls"
    assert g.meta("tests", "test_mod.py::test_target_function", "mod.py::target_function")["derived_from"] is None
    assert sum(e["relation"] == "tests" for e in g.edges) == 2


def test_property_reads(trees):
    assert trees["props/reads"].of("accesses") == {("m.py::Widget.describe", "m.py::Widget.label"), ("m.py::show", "m.py::Widget.label")}


def test_inferred_uses_carry_their_origin(trees):
    g = trees["factory/types"]
    assert g.of("uses") == {("m.py::Client", "m.py::Session"), ("m.py::Config", "m.py::Parser")}
    assert all(e["source_tool"] == "pyright" for e in g.edges if e["relation"] == "uses")


def test_skipped_files_count_as_collected_only(trees):
    g = trees["skip/some"]
    assert {r["label"] for r in g.nodes.values()} == {"crlf.py", "ok"}
    meta = g.graph.meta.first()
    assert (meta["file_count"], meta["parsed_count"], meta["schema_version"]) == (3, 1, schemas.SCHEMA_VERSION)


def test_ids_and_call_context(trees):
    g = trees["bare/same-file"]
    import hashlib

    node = g.node("api.py::request")
    assert node["id"] == hashlib.md5(b"func_bare/same-file_api.py_request").hexdigest()[:8]
    assert node["caller_count"] == 1 and [c["label"] for c in node["direct_callers"]] == ["post"]
    assert g.node("api.py::post")["caller_count"] == 0 and g.node("api.py::post")["direct_callers"] == []
    assert g.node("sessions.py::Session")["caller_count"] is None


def test_no_relation_but_the_known_ones(trees):
    known = {"contains", "imports", "depends_on", "calls", "accesses", "inherits", "tests", "uses", "overrides", "module_depends_on"}
    assert {e["relation"] for g in trees.values() for e in g.edges} <= known


def test_entities_whose_ids_begin_alike_stay_apart(spark):
    """The MD5s of these two files have the same first eight digits."""
    from treeloom.functions.pysource import entity_id

    first = {}
    for path in (f"customers/customer_{n}.py" for n in range(400_000)):
        other = first.setdefault(entity_id(f"file_acme/demo_{path}")[:8], path)
        if other != path:
            break
    pair = (other, path)
    g = build(spark, {p: "import json\n\n\ndef own():\n    return json\n" for p in pair} | {"third.py": "x = 1\n"})
    assert {k for k in map(g.name, g.nodes)} == {*pair, "third.py", "import json", *(f"{p}::own" for p in pair)}
    assert g.of("contains") == {(p, f"{p}::own") for p in pair} and g.of("imports") == {(p, "import json") for p in pair}
    assert {len(g.node(p)["id"]) for p in pair} == {32} and len(g.node("third.py")["id"]) == 8


def test_files_of_any_length_are_parsed_if_asked(spark):
    g = build(spark, {"long.py": "\n" * 6000 + "def far():\n    return 1\n"}, max_lines=None)
    assert g.node("long.py::far")["lineno"] == 6001 and g.graph.meta.first()["parsed_count"] == 1


def test_parsing_leaves_out_no_file_unless_asked(spark):
    from treeloom.operators import parse

    long = files(spark, {"long.py": "\n" * 6000 + "def far():\n    return 1\n"})
    labels = lambda **o: {r["label"] for r in parse.parse_lazily(long, **o).filter("kind = 'entity'").select("entity.label").collect()}
    assert labels() == {"long.py", "far"} and labels(max_lines=5000) == set()


def test_constants_of_files_need_no_resolved_graph(spark, sf, monkeypatch):
    monkeypatch.setattr(projections, "_GRAPHS", {})
    with staged() as tables:
        found = QUERIES["file_constants"](spark, sf)
    assert tables == [] and {r["constants"] for r in found.collect()} == {f"REGION={i}" for i in range(5)}
