"""Fixed schemas of all tables as DDL; nothing is inferred from data."""

from __future__ import annotations

#: Stamped into ``graph_meta`` and compared when a stored graph is read.
SCHEMA_VERSION = 1

FILES = "repo string, commit string, path string, content string"

_FUNCTION = """lineno int, docstring string, decorators array<string>,
 params array<struct<name:string,annotation:string,default:string>>, returns string,
 signature string, source_code string, raises array<string>, catches array<string>,
 is_async boolean, branches int,
 conditions array<struct<type:string,condition:string,lineno:int>>,
 data_flows struct<returns:array<string>,mutates_attributes:map<string,array<string>>,parameter_usage:map<string,array<int>>>,
 assert_patterns array<string>, external_deps array<string>, side_effects array<string>, return_types array<string>""".replace("\n", "")

#: Columns of an entity; those that its type lacks are null.
ENTITY = (
    "id string, type string, label string, path string, filepath string, class string, module string, name string,"
    " constants map<string,string>, exports array<string>, bases array<string>, attributes array<string>, " + _FUNCTION
)
#: A relation as the parser sees it: ``target`` is an id if ``resolved``, else a name.
REFERENCE = (
    "source string, target string, relation string, resolved boolean, receiver string, class_hint string, local_type_hint string,"
    " import_resolved string, is_super_call boolean"
)
#: An assignment from a call whose result type only a type checker can tell.
SITE = "line int, col int, source_id string, source_name string"


def _fields(ddl: str) -> str:
    """Top-level ``name type`` fields of a table as ``name:type`` fields of a struct."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return ",".join(":".join(p.split(None, 1)) for p in parts)


PARSED = (
    "repo string, commit string, src_path string, emit_ord int, kind string,"
    f" entity struct<{_fields(ENTITY)}>, reference struct<{_fields(REFERENCE)}>, site struct<{_fields(SITE)}>"
)
CALLERS = "caller_count int, direct_callers array<struct<id:string,label:string,type:string>>"
NODES = f"repo string, commit string, {ENTITY}, {CALLERS}, src_path string, emit_ord int"
EDGES = (
    "repo string, commit string, source string, target string, relation string, confidence string, import_resolved string,"
    " via string, source_tool string, derived_from string"
)
GRAPH_META = "repo string, base_commit string, file_count long, parsed_count long, parse_mode string, schema_version int"
INSTANCES = "instance_id string, repo string, base_commit string, patch string, code_file string, test_file string"

CALLABLE = ("function", "method", "test_function")
FILE_TYPES = ("file", "test_file")
