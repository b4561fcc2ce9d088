"""treeloom: source-code graphs and corpus preparation as Spark plans.

Public names are imported when they are first used, so that a Python worker that
needs one module doesn't load them all.
"""

from importlib import import_module

_PUBLIC = {
    "Builder": "treeloom.build",
    "build_from_folder": "treeloom.build",
    "build_graph": "treeloom.build",
    "extract_and_validate": "treeloom.build",
    "serialize": "treeloom.build",
    "validate_context": "treeloom.build",
    "CodeGraph": "treeloom.operators.graph",
    "Contexts": "treeloom.operators.context",
    "extract_contexts": "treeloom.operators.context",
    "changed_definitions": "treeloom.operators.diffs",
    "bfs": "treeloom.operators.traverse",
    "validate_graph": "treeloom.operators.validate",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(_PUBLIC[name]), name)
    raise AttributeError(name)
