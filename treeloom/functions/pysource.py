"""What one Python file says about itself, as plain rows.

Only the standard library's ``ast`` is used.  Functions take syntax trees and
return strings, lists and dicts; :func:`facts` puts them together for a file.
Where a rule looks odd (nested functions counted here and not there), the rule
is deliberate: the graph that comes out must equal what users of such graphs
are used to.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from pathlib import PurePosixPath

Function = ast.FunctionDef | ast.AsyncFunctionDef
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Files with more line breaks than this (mostly generated code) are left out unless a caller asks for all.
MAX_LINES = 5000


def entity_id(text: str) -> str:
    """The whole MD5; a graph's ids are cut where that leaves them apart (``parse.short_ids``)."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def in_tests(path: str) -> bool:
    pure = PurePosixPath(path)
    return pure.name.startswith("test_") or pure.name.endswith("_test.py") or not {"test", "tests"}.isdisjoint(pure.parts)


def decode(content: bytes | str) -> str:
    """Text with line breaks as ``\\n``; bytes that aren't UTF-8 are replaced."""
    text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content
    return text.replace("\r\n", "\n").replace("\r", "\n")


def source_of(node: ast.AST | None) -> str | None:
    """The node as source text; None if it can't be written out."""
    try:
        return ast.unparse(node) if node is not None else None
    except Exception:
        return None


def unique(items) -> list:
    return list(dict.fromkeys(items))


def scope(top: ast.AST) -> Iterator[ast.AST]:
    """Everything below ``top`` in reading order, without what nested functions hold."""
    for child in ast.iter_child_nodes(top):
        if not isinstance(child, FUNCTIONS):
            yield child
            yield from scope(child)


def flat_scope(top: ast.AST) -> Iterator[ast.AST]:
    """``ast.walk`` without the nested function nodes themselves; what they hold is visited."""
    return (n for n in ast.walk(top) if n is top or not isinstance(n, FUNCTIONS))


def on_self(node: ast.AST) -> str | None:
    """``x`` of ``self.x``."""
    plain = isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self"
    return node.attr if plain else None


def self_target(target: ast.AST) -> str | None:
    """``x`` where ``self.x`` or ``self.x[...]`` is assigned."""
    return on_self(target) or (on_self(target.value) if isinstance(target, ast.Subscript) else None)


# --- calls and reads


def called(call: ast.Call) -> str | None:
    match call.func:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return name
    return None


def receiver(call: ast.Call) -> str | None:
    return source_of(call.func.value) if isinstance(call.func, ast.Attribute) else None


def arguments(fn: Function) -> list[ast.arg]:
    return [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]


def annotated_types(fn: Function) -> dict[str, str]:
    """Class names of parameters whose annotation is one plain or dotted name."""
    out = {}
    for arg in arguments(fn):
        if isinstance(arg.annotation, ast.Name):
            out[arg.arg] = arg.annotation.id
        elif isinstance(arg.annotation, ast.Attribute):
            out[arg.arg] = arg.annotation.attr
    return out


def local_types(fn: Function, before_line: int | None = None) -> dict[str, str]:
    """Annotated parameters, overwritten in reading order by ``name = Upper(...)``."""
    out = annotated_types(fn)
    for node in scope(fn):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and (before_line is None or node.lineno < before_line):
            name = called(node.value)
            if name and name[0].isupper():
                out |= {t.id: name for t in node.targets if isinstance(t, ast.Name)}
    return out


def attribute_reads(fn: Function) -> list[tuple[str, str | None]]:
    """Distinct ``(attribute, receiver)`` that are read without being called."""
    callees = {id(n.func) for n in ast.walk(fn) if isinstance(n, ast.Call)}
    reads = (n for n in scope(fn) if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Load) and id(n) not in callees)
    return unique((n.attr, source_of(n.value)) for n in reads)


def instantiated(fn: Function) -> list[str]:
    names = (called(n) for n in flat_scope(fn) if isinstance(n, ast.Call))
    return unique(n for n in names if n and n[0].isupper())


def used_imports(fn: Function, imports: dict[str, str]) -> list[str]:
    return unique(imports[n.id] for n in flat_scope(fn) if isinstance(n, ast.Name) and n.id in imports)


def factory_sites(fn: Function) -> list[tuple[int, int, str | None]]:
    """``(line, column, receiver)``, counted from 0, of names assigned from lower-case calls.

    For ``r.x = f()`` the column is that of ``x``; the receiver of ``self`` is None.
    """
    out = []
    for node in scope(fn):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
            name = called(node.value)
            for target in node.targets if name and not name[0].isupper() else ():
                match target:
                    case ast.Name(lineno=line, col_offset=col):
                        out.append((line - 1, col, None))
                    case ast.Attribute(value=ast.Name(id=owner), attr=attr, lineno=line, end_col_offset=end):
                        out.append((line - 1, end - len(attr), None if owner == "self" else owner))
    return out


def self_accesses(fn: Function) -> tuple[list[str], list[str]]:
    """Attributes of ``self`` that are read (and not written before) and written."""
    reads, writes = [], []
    for node in (fn, *scope(fn)):
        if isinstance(node, ast.Assign):
            writes += [name for t in node.targets if (name := self_target(t))]
        elif isinstance(node, ast.AnnAssign):
            writes += [name] if (name := on_self(node.target)) else []
        elif (name := on_self(node)) and name not in writes:
            reads.append(name)
    return unique(reads), unique(writes)


def guess_target(fn: Function, known: set[str]) -> str | None:
    """The function that a test is for: by its name, else by the first known call."""
    if fn.name.startswith("test_"):
        parts = fn.name[5:].split("_")
        for n in range(len(parts), 0, -1):
            if "_".join(parts[:n]) in known:
                return "_".join(parts[:n])
    calls = (called(n) for n in ast.walk(fn) if isinstance(n, ast.Call))
    return next((c for c in calls if c and c in known and not c.startswith("assert")), None)


# --- what describes a function


def docstring(node: ast.AST) -> str | None:
    first = node.body[0] if getattr(node, "body", None) else None
    text = first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) else None
    return text.strip() if isinstance(text, str) else None


def decorators(node: ast.AST) -> list[str]:
    return [text for d in getattr(node, "decorator_list", []) if (text := source_of(d))]


def parameters(fn: Function) -> list[dict]:
    def one(arg: ast.arg, stars: str = "", default: ast.AST | None = None) -> dict:
        return {"name": stars + arg.arg, "annotation": source_of(arg.annotation), "default": source_of(default)}

    a = fn.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults
    out = [one(arg, "", d) for arg, d in zip(plain, defaults)]
    out += [one(arg, "", d) for arg, d in zip(a.kwonlyargs, a.kw_defaults)]
    return out + ([one(a.vararg, "*")] if a.vararg else []) + ([one(a.kwarg, "**")] if a.kwarg else [])


def texts(fn: Function, lines: list[str] | None) -> tuple[str, str]:
    """The lines of the signature, and all lines of the function, without decorators."""
    if not lines or not fn.body:
        return "", ""
    head = max(fn.body[0].lineno - 1, fn.lineno)
    return "".join(lines[fn.lineno - 1 : head]).rstrip(), "".join(lines[fn.lineno - 1 : fn.end_lineno])


def exceptions(fn: Function) -> tuple[list[str], list[str]]:
    """What is raised and caught anywhere inside, sorted."""
    raised = {source_of(n.exc) for n in ast.walk(fn) if isinstance(n, ast.Raise) and n.exc is not None}
    caught = {source_of(n.type) for n in ast.walk(fn) if isinstance(n, ast.ExceptHandler) and n.type is not None}
    return sorted(x for x in raised if x), sorted(x for x in caught if x)


_CONDITIONS = {ast.If: "if", ast.While: "while", ast.Assert: "assert"}


def conditions(fn: Function) -> list[dict]:
    out = {}
    for node in scope(fn):
        if (kind := _CONDITIONS.get(type(node))) and (text := source_of(node.test)):
            out.setdefault((kind, node.lineno), {"type": kind, "condition": text, "lineno": node.lineno})
    return list(out.values())


def data_flows(fn: Function) -> dict:
    """Returned expressions, values written to ``self``, and lines that read a parameter.

    Directly in a nested function's body returns and writes don't count; below its
    first level they do.
    """
    names = {a.arg for a in [*arguments(fn), fn.args.vararg, fn.args.kwarg] if a}
    returned, written, used = set(), {}, {}

    def visit(top: ast.AST, inner: bool) -> None:
        for node in ast.iter_child_nodes(top):
            if isinstance(node, FUNCTIONS):
                visit(node, True)
                continue
            if isinstance(node, ast.Return) and node.value and not inner:
                returned.add(source_of(node.value))
            elif isinstance(node, ast.Assign) and not inner:
                for name in filter(None, map(self_target, node.targets)):
                    written.setdefault(name, set()).add(source_of(node.value))
            elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and node.id in names:
                used.setdefault(node.id, set()).add(node.lineno)
            visit(node, False)

    visit(fn, False)
    return {
        "returns": sorted(x for x in returned if x),
        "mutates_attributes": {k: sorted(x for x in v if x) for k, v in written.items()},
        "parameter_usage": {k: sorted(v) for k, v in used.items()},
    }


def branches(fn: Function) -> int:
    return sum(isinstance(n, (ast.If, ast.For, ast.While)) for n in scope(fn))


def assertions(fn: Function) -> list[str]:
    out = []
    for node in ast.walk(fn):
        if isinstance(node, ast.Assert):
            out.append(source_of(node.test))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr.startswith("assert"):
            out.append(source_of(node))
    return [x for x in out if x]


_SHAPES = {ast.ListComp: "list", ast.DictComp: "dict", ast.SetComp: "set", ast.Compare: "bool", ast.BoolOp: "bool", ast.GeneratorExp: "generator", ast.Lambda: "function"}


def return_types(fn: Function) -> list[str]:
    """The annotation, then a type or the expression for each ``return``."""
    out = [source_of(fn.returns)]
    for node in flat_scope(fn):
        if isinstance(node, ast.Return):
            value = node.value
            if value is None:
                out.append("None")
            elif isinstance(value, ast.Constant):
                out.append("None" if value.value is None else type(value.value).__name__)
            elif isinstance(value, ast.UnaryOp) and isinstance(value.op, ast.Not):
                out.append("bool")
            else:
                out.append(_SHAPES.get(type(value)) or source_of(value))
    return unique(x for x in out if x)


def annotation_names(fn: Function) -> list[str]:
    noted = [*(a.annotation for a in arguments(fn)), fn.returns]

    def inside(node: ast.AST) -> Iterator[str]:
        if isinstance(node, (ast.Name, ast.Attribute)):
            yield node.id if isinstance(node, ast.Name) else node.attr
        for child in ast.iter_child_nodes(node):
            yield from inside(child)

    return unique(name for node in noted if node for name in inside(node))


def describe(fn: Function, path: str, owner: str | None = None, imports: dict[str, str] | None = None, lines: list[str] | None = None) -> dict:
    """All columns of a function, method or test."""
    imports = imports or {}
    signature, source = texts(fn, lines)
    raised, caught = exceptions(fn)
    types = unique([*annotation_names(fn), *instantiated(fn)])
    return {
        "filepath": path,
        "class": owner,
        "lineno": fn.lineno,
        "docstring": docstring(fn),
        "decorators": decorators(fn),
        "params": parameters(fn),
        "returns": source_of(fn.returns),
        "signature": signature,
        "source_code": source,
        "raises": raised,
        "catches": caught,
        "is_async": isinstance(fn, ast.AsyncFunctionDef),
        "branches": branches(fn),
        "conditions": conditions(fn),
        "data_flows": data_flows(fn),
        "assert_patterns": assertions(fn) if in_tests(path) else [],
        "external_deps": [imports[t] for t in types if t in imports],
        "side_effects": self_accesses(fn)[1],
        "return_types": return_types(fn),
    }


# --- classes and modules


def bases(cls: ast.ClassDef) -> list[str]:
    return [text for b in cls.bases if (text := source_of(b))]


def methods(cls: ast.AST) -> list[Function]:
    return [n for n in ast.iter_child_nodes(cls) if isinstance(n, FUNCTIONS)]


def class_attributes(cls: ast.ClassDef) -> list[str]:
    """Names that ``__init__`` assigns on ``self``."""
    out = []
    for node in (n for m in methods(cls) if m.name == "__init__" for n in ast.walk(m)):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        out += [name for t in targets if (name := on_self(t))]
    return unique(out)


def class_instantiates(cls: ast.ClassDef) -> list[str]:
    return unique(name for m in methods(cls) for name in instantiated(m))


def imported(node: ast.Import | ast.ImportFrom) -> Iterator[tuple[str, str, str | None, str | None]]:
    """``(local name, full name, module, name)``; module and name are None for plain imports."""
    for alias in node.names:
        if isinstance(node, ast.Import):
            yield alias.asname or alias.name.split(".")[0], alias.name, None, None
        else:
            module = node.module or ""
            yield alias.asname or alias.name, f"{module}.{alias.name}" if module else alias.name, module, alias.name


def module_info(tree: ast.Module) -> tuple[dict[str, str], list[str], dict[str, str]]:
    """Imports by local name, ``__all__``, and upper-case constants."""
    imports, exports, constants = {}, [], {}
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            imports |= {local: full for local, full, _, _ in imported(node)}
            continue
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        for name in (t.id for t in targets if isinstance(t, ast.Name)):
            listed = getattr(node.value, "elts", None) if isinstance(node.value, ast.List | ast.Tuple) else None
            if name == "__all__" and isinstance(node, ast.Assign) and listed is not None:
                exports = [e.value for e in listed if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            elif name.isupper() and (text := source_of(node.value)):
                constants[name] = text
    return imports, exports, constants


def parse(text: str, max_lines: int | None = MAX_LINES) -> ast.Module | None:
    """The tree, or None for files that are longer than asked for or no Python."""
    if max_lines is not None and text.count("\n") > max_lines:
        return None
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


class _File:
    """Collects the rows of one file in the order in which they are found."""

    def __init__(self, repo: str, path: str, text: str, tree: ast.Module) -> None:
        self.repo, self.path, self.lines = repo, path, text.splitlines(keepends=True)
        self.rows: list[tuple[str, dict]] = []
        self.called: set[tuple[str, str]] = set()
        self.imports, exports, constants = module_info(tree)
        self.id = entity_id(f"file_{repo}_{path}")
        name = PurePosixPath(path).name
        self.entity(self.id, "test_file" if in_tests(path) else "file", name, path=path, constants=constants, exports=exports)
        for node in tree.body:
            if isinstance(node, ast.Import | ast.ImportFrom):
                for _, full, module, short in imported(node):
                    key = entity_id(f"import_{repo}_{full}")
                    self.entity(key, "import", full, module=module, name=short)
                    self.edge(self.id, key, "imports")
        for node in tree.body:
            if isinstance(node, ast.ClassDef):
                self.add_class(node)
            elif isinstance(node, FUNCTIONS):
                self.add_function(node, self.id, None)

    def entity(self, key: str, kind: str, label: str, **columns) -> None:
        self.rows.append(("entity", {"id": key, "type": kind, "label": label, **columns}))

    def edge(self, source: str, target: str, relation: str) -> None:
        self.rows.append(("reference", {"source": source, "target": target, "relation": relation, "resolved": True}))

    def name_edge(self, source: str, target: str, relation: str, **hints) -> None:
        self.rows.append(("reference", {"source": source, "target": target, "relation": relation, "resolved": False, **hints}))

    def add_class(self, node: ast.ClassDef) -> None:
        key, parents = entity_id(f"class_{self.repo}_{self.path}_{node.name}"), bases(node)
        self.entity(
            key, "class", node.name, filepath=self.path, lineno=node.lineno, bases=parents, decorators=decorators(node), docstring=docstring(node), attributes=class_attributes(node)
        )
        self.edge(self.id, key, "contains")
        for parent in parents:
            self.name_edge(key, parent, "inherits")
        for name in class_instantiates(node):
            self.name_edge(key, name, "uses")
        for method in methods(node):
            self.add_function(method, key, node, parents)

    def add_function(self, fn: Function, holder: str, cls: ast.ClassDef | None, parents: list[str] = []) -> None:  # noqa: B006
        owner = cls.name if cls else None
        key = entity_id(f"func_{self.repo}_{self.path}_{owner}_{fn.name}" if cls else f"func_{self.repo}_{self.path}_{fn.name}")
        kind = "test_function" if fn.name.startswith("test_") else "method" if cls else "function"
        self.entity(key, kind, fn.name, **describe(fn, self.path, owner, self.imports, self.lines))
        self.edge(holder, key, "contains")
        if fn.name != "__init__":
            for parent in parents:
                self.name_edge(key, f"{parent}.{fn.name}", "overrides")
        types = local_types(fn)
        self.add_calls(key, fn, types, owner)
        for name, source in unique_by_first(attribute_reads(fn)):
            self.name_edge(key, name, "accesses", receiver=source, **self.hints(source, name, types, owner))
        for full in used_imports(fn, self.imports):
            self.edge(key, entity_id(f"import_{self.repo}_{full}"), "depends_on")
        if fn.name.startswith("test_"):
            self.name_edge(key, fn.name, "tests")
        for line, col, source in factory_sites(fn):
            held = local_types(fn, line + 1).get(source) if source else None
            if held or (source is None and cls):
                self.rows.append(("site", {"line": line, "col": col, "source_id": None if source else holder, "source_name": held}))

    def add_calls(self, key: str, fn: Function, types: dict[str, str], owner: str | None) -> None:
        for call in (n for n in ast.walk(fn) if isinstance(n, ast.Call)):
            name, source = called(call), receiver(call)
            if not name or (key, name) in self.called or (name == "super" and source is None):
                continue
            self.called.add((key, name))
            above = source == "super()"
            hints = {} if above else self.hints(source, name, types, owner)
            if not above and not hints:
                hints = {"import_resolved": self.imports.get(name)}
            self.name_edge(key, name, "calls", receiver=source, is_super_call=above, **hints)

    def hints(self, source: str | None, name: str, types: dict[str, str], owner: str | None) -> dict:
        """What is known of the object that ``name`` is looked up on."""
        if source == "self" and owner is not None:
            return {"class_hint": owner}
        if source and source in types:
            return {"local_type_hint": types[source]}
        if source and source in self.imports:
            return {"import_resolved": f"{self.imports[source]}.{name}"}
        return {}


def unique_by_first(pairs: list[tuple]) -> list[tuple]:
    return list({p[0]: p for p in reversed(pairs)}.values())[::-1]


def facts(repo: str, path: str, content: bytes | str, max_lines: int | None = MAX_LINES) -> list[tuple[str, dict]]:
    """``(kind, columns)`` of a file's entities, references and sites; none if it is skipped.

    ``max_lines`` None takes files of any length.
    """
    text = decode(content)
    tree = parse(text, max_lines)
    if tree is None:
        return []
    try:
        return _File(repo, path, text, tree).rows
    except RecursionError:  # deeper than the interpreter can follow
        return []
