import ast

import pytest

from treeloom.functions import pysource as P


def fn(text):
    return next(n for n in ast.walk(ast.parse(text)) if isinstance(n, P.FUNCTIONS))


def flows(text):
    return P.data_flows(fn(text))


def test_returns_and_writes():
    f = flows("def f(self, a, b=1, *c, d, **e):\n    self.x = a\n    self.y[a] = b\n    other.z = 1\n    if d:\n        return c\n    return e\n")
    assert f["returns"] == ["c", "e"] and f["mutates_attributes"] == {"x": ["a"], "y": ["b"]}
    assert f["parameter_usage"] == {"self": [2, 3], "a": [2, 3], "b": [3], "d": [5], "c": [6], "e": [7]}


def test_duplicates_and_async():
    f = flows("async def f(a):\n    self.x = a\n    self.x = a\n    self.x = 2\n    return a\n    return a\n")
    assert f["returns"] == ["a"] and f["mutates_attributes"] == {"x": ["2", "a"]}


def test_nested_functions_hide_their_first_level_only():
    f = flows("def f(a):\n    def g():\n        self.x = a\n        return a\n    return 1\n")
    assert f["returns"] == ["1"] and f["mutates_attributes"] == {} and f["parameter_usage"] == {"a": [3, 4]}
    deep = flows("def f(a):\n    def g():\n        if a:\n            self.x = 2\n            return 3\n    return 1\n")
    assert deep["returns"] == ["1", "3"] and deep["mutates_attributes"] == {"x": ["2"]}


@pytest.mark.parametrize(
    "body, sites",
    [
        ("x = make()", [(1, 4, None)]),
        ("self.x = make()", [(1, 9, None)]),
        ("other.x = make()", [(1, 10, "other")]),
        ("x = mod.make()", [(1, 4, None)]),
        ("x = Make()", []),
        ("x = mod.Make()", []),
        ("a, b = make()", []),
        ("a.b.c = make()", []),
        ("x = 1", []),
        ("a = b = make()", [(1, 4, None), (1, 8, None)]),
        ("x: int = make()", []),
    ],
)
def test_factory_sites(body, sites):
    assert P.factory_sites(fn(f"def f(self):\n    {body}\n")) == sites


def test_factory_sites_in_nested_functions_are_not_the_outer_ones():
    assert P.factory_sites(fn("def f():\n    def g():\n        x = make()\n")) == []


def test_local_types_by_line():
    f = fn("def f(x: A, y: pkg.B, z: Optional[C], *w: D):\n    x = E()\n    q = mod.G()\n    x = H()\n    n: K = L()\n    def g():\n        x = M()\n")
    assert P.annotated_types(f) == {"x": "A", "y": "B"}
    assert P.local_types(f) == {"x": "H", "y": "B", "q": "G"}
    assert P.local_types(f, 4)["x"] == "E" and P.local_types(f, 2)["x"] == "A"


def test_signature_and_source():
    text = "@deco\ndef f(a,\n      b=1):\n    '''Doc.'''\n    return a\n"
    f = fn(text)
    signature, source = P.texts(f, text.splitlines(keepends=True))
    assert signature == "def f(a,\n      b=1):" and source == text.split("\n", 1)[1]
    assert P.texts(f, None) == ("", "") and P.docstring(f) == "Doc." and P.decorators(f) == ["deco"]
    one = "def g(): return 1\n"
    assert P.texts(fn(one), [one]) == ("def g(): return 1", one)


def test_parameters():
    got = P.parameters(fn("def f(p, /, a, b: int=1, *args: str, c, d=2, **kw): pass"))
    assert [x["name"] for x in got] == ["p", "a", "b", "c", "d", "*args", "**kw"]
    assert got[2] == {"name": "b", "annotation": "int", "default": "1"} and got[3]["default"] is None and got[5]["annotation"] == "str"


def test_conditions_branches_exceptions_and_asserts():
    f = fn("def f(x):\n    if x:\n        raise A('b')\n    while x > 1:\n        pass\n    assert x\n    for i in x: pass\n    try: pass\n    except (B, C): raise\n    def g():\n        if 1: raise D\n")
    assert [(c["type"], c["condition"], c["lineno"]) for c in P.conditions(f)] == [("if", "x", 2), ("while", "x > 1", 4), ("assert", "x", 6)]
    assert P.branches(f) == 3 and P.exceptions(f) == (["A('b')", "D"], ["(B, C)"])
    assert P.assertions(fn("def t(self):\n    assert a == b\n    self.assertEqual(a, 1)\n    check(a)\n")) == ["a == b", "self.assertEqual(a, 1)"]


def test_return_types():
    f = fn("def f() -> X:\n    return\n    return None\n    return [i for i in x]\n    return [1]\n    return 'a'\n    return a > 1\n    return not a\n    return lambda: 1\n    return (i for i in x)\n    return a + 1\n    return y\n    return y\n")
    assert P.return_types(f) == ["X", "None", "list", "[1]", "str", "bool", "function", "generator", "a + 1", "y"]


def test_imports_exports_constants():
    tree = ast.parse("import a.b, c as d\nfrom e import f as g\nfrom . import h\n__all__ = ['x', 1, 'y']\nMAX = 3\nlow = 1\nMIN: int = 2\nNONE: int\n")
    imports, exports, constants = P.module_info(tree)
    assert imports == {"a": "a.b", "d": "c", "g": "e.f", "h": "h"} and exports == ["x", "y"] and constants == {"MAX": "3", "MIN": "2"}


def test_attribute_reads_and_writes():
    f = fn("def f(self, o):\n    o.read\n    o.call()\n    o.write = 1\n    self.a.b\n    o.read\n    def g():\n        o.inner\n")
    assert P.attribute_reads(f) == [("read", "o"), ("b", "self.a"), ("a", "self")]
    assert P.self_accesses(fn("def f(self):\n    self.x = self.y\n    self.z[1] = 2\n    self.w: int = 3\n    return self.x\n")) == (["y"], ["x", "z", "w"])


def test_classes():
    cls = next(n for n in ast.parse("class A(B, p.C, metaclass=M):\n    def __init__(self):\n        self.x = D()\n        self.y: int = 1\n        self.x = 2\n    def f(self):\n        self.z = e.F()\n        return D()\n").body)
    assert P.bases(cls) == ["B", "p.C"] and P.class_attributes(cls) == ["x", "y"] and P.class_instantiates(cls) == ["D", "F"]


def test_names_in_annotations_and_targets():
    assert P.annotation_names(fn("def f(a: Optional[p.X], *, b: Y) -> Z: pass")) == ["Optional", "X", "p", "Y", "Z"]
    assert P.guess_target(fn("def test_send_with_timeout(): pass"), {"send"}) == "send"
    assert P.guess_target(fn("def test_other():\n    assert_it()\n    obj.run()\n"), {"assert_it", "run"}) == "run"
    assert P.guess_target(fn("def test_other(): pass"), {"x"}) is None


def test_only_unresolvable_names_become_name_edges():
    rows = P.facts("r", "m.py", "import os\ndef f(self):\n    self.x = os.sep\n    return self.y\n")
    refs = {(r["relation"], r["target"]) for k, r in rows if k == "reference" and not r["resolved"]}
    assert refs == {("accesses", "sep"), ("accesses", "y")}
    assert not any(k == "reference" and r["relation"] in ("reads", "writes", "returns") for k, r in rows)


def test_odd_files_give_nothing():
    assert P.facts("r", "m.py", "def x(:") == [] and P.facts("r", "m.py", "x\0") == [] and P.facts("r", "m.py", "\n" * 5001) == []
    assert P.facts("r", "m.py", "(" * 5000 + ")" * 5000) == []
    kinds = [k for k, _ in P.facts("r", "m.py", b"# \xff\r\ndef f():\r\n  pass\r\n")]
    assert kinds == ["entity", "entity", "reference"]


def test_test_paths():
    assert P.in_tests("a/test_x.py") and P.in_tests("a/x_test.py") and P.in_tests("tests/x.py") and P.in_tests("a/test/x.py")
    assert not P.in_tests("a/contest.py")
