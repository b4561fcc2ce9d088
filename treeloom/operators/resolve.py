"""Names to ids: raw references become edges by joins that carry a confidence.

All joins are equi-joins on ``(repo, commit, ...)``.  A reference may match in
several tiers; the first tier with a hit wins (``min`` over the reference), and
what the reference does by list order is a total order here: ``(src_path,
emit_ord)``, smallest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import naming, schemas
from treeloom.operators.parse import entities, first_by, references, sites
from treeloom.plans.staging import materialize

SNAP = ["repo", "commit"]
REF = [*SNAP, "src_path", "emit_ord"]


def _edge(rows: DataFrame, relation: Column | str, order: int, **columns: Column | str | None) -> DataFrame:
    """Rows with ``source, target`` as edges; ``order`` is the phase that emits them."""
    given = {k: (F.lit(v) if v is None or isinstance(v, str) else v) for k, v in columns.items()}
    meta = [given.get(c, F.lit(None)).cast("string").alias(c) for c in ("confidence", "import_resolved", "via", "source_tool", "derived_from")]
    return rows.select(*SNAP, "source", "target", (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"), *meta, F.lit(order).alias("__phase"), "src_path", "emit_ord")


def _first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation), with the metadata of the first."""
    kept = first_by(edges, [*SNAP, "source", "target", "relation"], ["__phase", "src_path", "emit_ord"])
    return kept.drop("__phase")


def callables(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin(*schemas.CALLABLE))


def classes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'class'")


def methods_index(nodes: DataFrame, properties_only: bool = False) -> DataFrame:
    """``(repo, commit, hit_class, hit_label, hit)``."""
    own = callables(nodes).filter("class is not null and class <> ''")
    if properties_only:
        own = own.filter(F.array_contains("decorators", "property"))
    return own.select(*SNAP, F.col("class").alias("hit_class"), F.col("label").alias("hit_label"), F.col("id").alias("hit"))


def qualified_index(nodes: DataFrame) -> DataFrame:
    """``(repo, commit, full, hit)``: ``module.label`` and ``module.Class.label``."""
    own = nodes.filter(F.col("type").isin(*schemas.CALLABLE, "class") & (F.coalesce("filepath", F.lit("")) != ""))
    module = naming.module_name(F.col("filepath"))
    plain = own.select(*SNAP, F.concat(module, F.lit("."), "label").alias("full"), F.col("id").alias("hit"))
    inner = own.filter("class is not null and class <> ''").select(
        *SNAP, F.concat(module, F.lit("."), "class", F.lit("."), "label").alias("full"), F.col("id").alias("hit")
    )
    return plain.unionByName(inner)


def _tier(raw: DataFrame, index: DataFrame, on: dict[str, Column], tier: int) -> DataFrame:
    keyed = raw.select(*REF, *[c.alias(k) for k, c in on.items()])
    for k in on:
        keyed = keyed.filter((F.col(k).isNotNull()) & (F.col(k) != ""))
    return keyed.join(index, [*SNAP, *on]).select(*REF, F.lit(tier).alias("tier"), "hit", F.lit("qualified").alias("confidence"))


def _by_hints(raw: DataFrame, index: DataFrame, name: str) -> list[DataFrame]:
    """Tiers 1, 2 and 4: the enclosing class, the receiver's type, the last two parts of an import."""
    parts = F.split("import_resolved", r"\.")
    long = F.size(parts) >= 3
    return [
        _tier(raw, index, {"hit_class": F.col("class_hint"), "hit_label": F.col(name)}, 1),
        _tier(raw, index, {"hit_class": F.col("local_type_hint"), "hit_label": F.col(name)}, 2),
        _tier(raw, index, {"hit_class": F.when(long, F.get(parts, F.size(parts) - 2)), "hit_label": F.when(long, F.get(parts, F.size(parts) - 1))}, 4),
    ]


def _first_tier(hits: list[DataFrame]) -> DataFrame:
    whole = hits[0]
    for more in hits[1:]:
        whole = whole.unionByName(more)
    best = F.min("tier").over(Window.partitionBy(*REF))
    return whole.withColumn("__best", best).filter("tier = __best").drop("__best")


def resolve_calls(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """``calls`` other than ``super()``: qualified by a hint, else exact by a bare name.

    A bare name counts if one callable has it, or, for calls without receiver, if
    exactly one in the caller's own file has it; otherwise it is dropped.  Names
    are counted before the join, so a common name never multiplies rows.
    """
    raw = raw.filter("relation = 'calls' and not resolved and not coalesce(is_super_call, false)")
    own = callables(nodes)
    hinted = _by_hints(raw, methods_index(nodes), "target")
    full = _tier(raw, qualified_index(nodes), {"full": F.col("import_resolved")}, 3)
    by_name = own.groupBy(*SNAP, F.col("label").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    by_file = own.groupBy(*SNAP, F.col("label").alias("target"), F.col("filepath").alias("src_path")).agg(F.count(F.lit(1)).alias("n_file"), F.min("id").alias("only_file"))
    bare = raw.select(*REF, "target", "receiver").join(by_name, [*SNAP, "target"]).join(by_file, [*SNAP, "target", "src_path"], "left")
    same_file = (F.col("n") > 1) & F.col("receiver").isNull() & (F.col("n_file") == 1)
    hit = F.when(F.col("n") == 1, F.col("only")).when(same_file, F.col("only_file"))
    named = bare.select(*REF, F.lit(5).alias("tier"), hit.alias("hit"), F.lit("exact").alias("confidence")).filter("hit is not null")
    found = _first_tier([*hinted, full, named])
    rows = raw.select(*REF, "source", F.col("import_resolved").alias("__import")).join(found, REF).withColumnRenamed("hit", "target")
    return _edge(rows, "calls", 0, confidence=F.col("confidence"), import_resolved=F.col("__import"))


def resolve_accesses(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attribute reads of properties; only with a hint, never by the bare name."""
    raw = raw.filter("relation = 'accesses' and not resolved")
    found = _first_tier(_by_hints(raw, methods_index(nodes, properties_only=True), "target"))
    rows = raw.select(*REF, "source").join(found, REF).withColumnRenamed("hit", "target")
    return _edge(rows, "accesses", 0, confidence=F.col("confidence"))


def named_index(index: DataFrame) -> DataFrame:
    """``(repo, commit, name, hit, n)`` with the number of hits of the name."""
    counted = index.groupBy(*SNAP, "label").agg(F.count(F.lit(1)).alias("n"))
    return index.select(*SNAP, F.col("label").alias("name"), F.col("id").alias("hit"), F.struct("src_path", "emit_ord").alias("hit_order")).join(
        counted.withColumnRenamed("label", "name"), [*SNAP, "name"]
    )


def sure(n: Column) -> Column:
    return F.when(n == 1, "exact").otherwise("ambiguous")


def resolve_inherits(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = raw.filter("relation = 'inherits' and not resolved").withColumn("name", naming.last_part(F.col("target"))).drop("target")
    rows = rows.join(named_index(classes(nodes)), [*SNAP, "name"]).withColumnRenamed("hit", "target")
    return _edge(rows, "inherits", 0, confidence=sure(F.col("n")))


def resolve_named_tests(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """``test_x`` tests every callable ``x``."""
    bare = F.when(F.col("target").startswith("test_"), F.expr("substring(target, 6)")).otherwise(F.col("target"))
    rows = raw.filter("relation = 'tests' and not resolved").withColumn("name", bare).drop("target")
    rows = rows.join(named_index(callables(nodes)), [*SNAP, "name"]).withColumnRenamed("hit", "target")
    return _edge(rows, "tests", 0, confidence=sure(F.col("n")))


def resolve_uses(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Classes that a class instantiates.

    Exact if one class has the name and no callable has it.  An inferred use may
    also name its source; then every class of that name is a source.
    """
    raw = raw.filter("relation = 'uses' and not resolved")
    named = named_index(classes(nodes)).select(*SNAP, "name", "hit", "n")
    taken = callables(nodes).select(*SNAP, F.col("label").alias("name")).distinct().withColumn("taken", F.lit(True))
    known = named.join(taken, [*SNAP, "name"], "left").withColumn("unsure", (F.col("n") > 1) | F.coalesce("taken", F.lit(False))).select(*SNAP, "name", "hit", "unsure")
    rows = raw.withColumnRenamed("target", "name").join(known, [*SNAP, "name"]).withColumnRenamed("hit", "target").drop("name")
    direct = rows.filter("unresolved_source is null")
    origin = known.select(*SNAP, F.col("name").alias("unresolved_source"), F.col("hit").alias("__source"), F.col("unsure").alias("__unsure"))
    inferred = rows.join(origin, [*SNAP, "unresolved_source"]).withColumn("source", F.col("__source")).withColumn("unsure", F.col("unsure") | F.col("__unsure"))
    both = direct.select(*REF, "source", "target", "unsure", "source_tool").unionByName(inferred.select(*REF, "source", "target", "unsure", "source_tool"))
    return _edge(both, "uses", 0, confidence=F.when(F.col("unsure"), "ambiguous").otherwise("exact"), source_tool=F.col("source_tool"))


def inferred_uses(site_rows: DataFrame, resolved_types: DataFrame, tool: str = "pyright") -> DataFrame:
    """Raw ``uses`` from sites whose type a checker found: ``resolved_types(repo, commit, path, line, col, type)``."""
    rows = site_rows.join(resolved_types, [*SNAP, "path", "line", "col"])
    return rows.select(
        *SNAP,
        F.col("path").alias("src_path"),
        "emit_ord",
        F.col("source_id").alias("source"),
        F.col("type").alias("target"),
        F.lit("uses").alias("relation"),
        F.lit(False).alias("resolved"),
        F.lit(tool).alias("source_tool"),
        F.when(F.col("source_id").isNull(), F.col("source_name")).alias("unresolved_source"),
    )


def module_depends_on(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """File to file: an import ``a.b.c`` means the first of ``a/b/c.py``, ``b/c.py``, ``c.py`` that exists."""
    own = nodes.filter("type = 'import'").select(*SNAP, F.col("id").alias("target"), F.coalesce(F.when(F.col("module") != "", F.col("module")), F.col("label")).alias("dotted"))
    parts = F.split("dotted", r"\.")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, i, F.size(parts)), "/"), F.lit(".py")))
    tried = own.select(*SNAP, "target", F.posexplode(paths).alias("pos", "path"))
    files = nodes.filter(F.col("type").isin(*schemas.FILE_TYPES)).select(*SNAP, "path", F.col("id").alias("file"))
    found = tried.join(files, [*SNAP, "path"]).groupBy(*SNAP, "target").agg(F.min_by("file", "pos").alias("file"))
    pairs = imports.filter("relation = 'imports'").select(*SNAP, "source", "target").join(found, [*SNAP, "target"])
    distinct = pairs.filter("source <> file").select(*SNAP, "source", F.col("file").alias("target")).distinct()
    return _edge(distinct.withColumn("src_path", F.lit("")).withColumn("emit_ord", F.lit(0)), "module_depends_on", 0)


def nearest_methods(requests: DataFrame, nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """``(repo, commit, start, method, hit)``: the method found first going up from class ``start``.

    ``requests`` has ``repo, commit, start, method``.  Levels are searched one after
    another; within a level classes come in the order in which breadth-first
    search would reach them, which ``trail`` (positions of the bases taken)
    reproduces.  A class is visited once for each request, so cycles end.  One
    round for each level of the deepest hierarchy; the frontier is written to
    the shared folder, so the plan doesn't grow.
    """
    labels = classes(nodes).select(*SNAP, F.col("id").alias("at"), F.col("label").alias("hit_class"))
    first = first_by(callables(nodes).filter("class is not null").select(*SNAP, "class", "label", "id", "src_path", "emit_ord"), [*SNAP, "class", "label"], ["src_path", "emit_ord"])
    known = first.select(*SNAP, F.col("class").alias("hit_class"), F.col("label").alias("method"), F.col("id").alias("hit"))
    order = F.row_number().over(Window.partitionBy(*SNAP, "source").orderBy("src_path", "emit_ord", "target")).cast("int")
    up = materialize(inherits.select(*SNAP, F.col("source").alias("at"), F.col("target").alias("base"), order.alias("pos")), "bases")
    keys = [*SNAP, "start", "method"]
    frontier = materialize(requests.select(*keys).distinct().withColumn("at", F.col("start")).withColumn("trail", F.array().cast("array<int>")), "frontier")
    visited, found = frontier.select(*keys, "at"), None
    while not frontier.isEmpty():
        hits = frontier.join(labels, [*SNAP, "at"]).join(known, [*SNAP, "hit_class", "method"])
        level = materialize(hits.groupBy(*keys).agg(F.min_by("hit", "trail").alias("hit")), "hits")
        found = level if found is None else found.unionByName(level)
        above = frontier.join(level, keys, "left_anti").join(up, [*SNAP, "at"])
        step = above.select(*keys, F.col("base").alias("at"), F.concat("trail", F.array("pos")).alias("trail"))
        fresh = step.groupBy(*keys, "at").agg(F.min("trail").alias("trail")).join(visited, [*keys, "at"], "left_anti")
        after = materialize(fresh, "frontier")
        visited = visited.unionByName(after.select(*keys, "at"))
        frontier = after
    if found is None:
        return requests.select(*keys).withColumn("hit", F.lit(None).cast("string")).limit(0)
    return found


def override_requests(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each method may override: a search from every class with its base's name."""
    rows = raw.filter("relation = 'overrides' and not resolved and instr(target, '.') > 0")
    base = F.expr("substring_index(substring(target, 1, length(target) - length(substring_index(target, '.', -1)) - 1), '.', -1)")
    rows = rows.select(*REF, "source", base.alias("name"), naming.last_part(F.col("target")).alias("method"))
    starts = classes(nodes).select(*SNAP, F.col("label").alias("name"), F.col("id").alias("start"))
    return rows.join(starts, [*SNAP, "name"])


def super_requests(raw: DataFrame, nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """``super().m()`` seeks the nearest ancestor's ``m``, from each base of the caller's class.

    Of several classes with the caller's class name, those in its file count if there are any.
    """
    rows = raw.filter("relation = 'calls' and not resolved and coalesce(is_super_call, false)").select(*REF, "source", F.col("target").alias("method"))
    callers = nodes.filter("class is not null and class <> ''").select(*SNAP, F.col("id").alias("source"), F.col("class").alias("label"), F.col("filepath").alias("caller_file"))
    own = classes(nodes).select(*SNAP, "label", F.col("id").alias("cls"), F.col("filepath").alias("class_file"))
    pairs = rows.join(callers, [*SNAP, "source"]).join(own, [*SNAP, "label"])
    here = F.col("class_file").eqNullSafe(F.col("caller_file")).cast("int")
    pairs = pairs.withColumn("here", here).withColumn("any_here", F.max("here").over(Window.partitionBy(*REF))).filter("here = any_here")
    bases = inherits.select(*SNAP, F.col("source").alias("cls"), F.col("target").alias("start"))
    return pairs.join(bases, [*SNAP, "cls"])


def _found(asked: DataFrame, found: DataFrame) -> DataFrame:
    return asked.join(found, [*SNAP, "start", "method"]).withColumnRenamed("hit", "target")


def resolve_hierarchy(raw: DataFrame, nodes: DataFrame, inherits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``overrides`` edges and ``calls`` through ``super()``, from one search up the hierarchies."""
    over, above = override_requests(raw, nodes), super_requests(raw, nodes, inherits)
    keys = [*SNAP, "start", "method"]
    found = nearest_methods(over.select(*keys).unionByName(above.select(*keys)), nodes, inherits)
    return _edge(_found(over, found), "overrides", 0), _edge(_found(above, found), "calls", 1, confidence="qualified", via="super")


def guessed_targets(tests: DataFrame, known: DataFrame) -> DataFrame:
    """``(repo, commit, id, target_label)``: for each test the longest known name that its own begins with.

    ``test_send_with_timeout`` aims at ``send_with_timeout``, else ``send_with``, else ``send``.
    ``known`` has ``repo, commit, label``.
    """
    tried = tests.select(*SNAP, "id", F.posexplode(naming.test_target_candidates(F.col("label"))).alias("pos", "target_label"))
    names = known.select(*SNAP, F.col("label").alias("target_label")).distinct()
    return tried.join(names, [*SNAP, "target_label"], "left_semi").groupBy(*SNAP, "id").agg(F.min_by("target_label", "pos").alias("target_label"))


def derived_tests(calls: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """A test function tests what it calls, unless its name says so already."""
    tests = nodes.filter("type = 'test_function'").select(*SNAP, F.col("id").alias("source"))
    rows = calls.join(tests, [*SNAP, "source"], "left_semi").join(named.select(*SNAP, "source", "target"), [*SNAP, "source", "target"], "left_anti")
    return _edge(rows, "tests", 1, confidence=F.coalesce("confidence", F.lit("unknown")), derived_from="calls")


def resolve(parsed: DataFrame, resolved_types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (without call context) and edges of all snapshots in ``parsed``."""
    nodes = materialize(entities(parsed), "nodes")
    raw = references(parsed).withColumn("source_tool", F.lit(None).cast("string")).withColumn("unresolved_source", F.lit(None).cast("string"))
    if resolved_types is not None:
        raw = raw.unionByName(inferred_uses(sites(parsed), resolved_types), allowMissingColumns=True)
    direct = _first_edges(_edge(raw.filter("resolved"), F.col("relation"), 0))
    # What later steps read again is stored once.
    inherits = materialize(_first_edges(resolve_inherits(raw, nodes)), "inherits")
    overrides, super_calls = resolve_hierarchy(raw, nodes, inherits)
    calls = materialize(_first_edges(resolve_calls(raw, nodes).unionByName(super_calls)), "calls")
    named = materialize(_first_edges(resolve_named_tests(raw, nodes)), "tests")
    rest = [
        inherits,
        calls,
        named,
        _first_edges(resolve_accesses(raw, nodes)),
        _first_edges(resolve_uses(raw, nodes)),
        _first_edges(overrides),
        derived_tests(calls, named, nodes).drop("__phase"),
        module_depends_on(nodes, direct).drop("__phase"),
    ]
    edges = direct
    for more in rest:
        edges = edges.unionByName(more)
    return nodes, edges.drop("src_path", "emit_ord")
