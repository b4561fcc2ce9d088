"""Traversal: bounded breadth-first search and cycles, as rounds of joins.

Frontiers carry ids only; wide columns are joined at the end.  Every round is
written to the shared folder, so neither plan nor lineage grows with depth and a
lost executor costs one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.staging import FEW, materialize, release

BOTH = ("outgoing", "incoming")
#: Relations that a context is cut out along, unless others are asked for.
CONTEXT_RELATIONS = ("accesses", "calls", "contains", "inherits", "tests", "uses")
#: Relations in which a cycle is worth a warning.
DEPENDENCIES = ("accesses", "calls", "inherits", "module_depends_on", "overrides", "uses")


def allowed(edges: DataFrame, relations) -> DataFrame:
    """Edges of some relations: None means all, an empty collection none."""
    if relations is None:
        return edges
    return edges.filter(F.col("relation").isin(*relations)) if relations else edges.limit(0)


def distances(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, directions=BOTH, by: list[str] | None = None, scope: list[str] | None = None, stored: bool = True) -> DataFrame:
    """``(by..., id, dist)`` of everything within ``depth`` hops of the starts.

    ``starts`` has ``by..., id``; many searches run at once, one for each value of
    ``by``.  ``scope`` names columns of ``starts`` that nodes and edges share with it
    (the snapshot).  Start ids stay even if no node has them; what is reached must be
    a node.  The last hop, the largest, is made when it is read if it is not ``stored``.
    """
    by, scope = by or [], scope or []
    key = list(dict.fromkeys([*by, *scope, "id"]))
    known = nodes.select(*scope, "id")
    hops = []
    if "outgoing" in directions:
        hops.append(edges.select(*scope, F.col("source").alias("id"), F.col("target").alias("next")))
    if "incoming" in directions:
        hops.append(edges.select(*scope, F.col("target").alias("id"), F.col("source").alias("next")))
    seen = frontier = materialize(starts.select(*key).distinct().withColumn("dist", F.lit(0)), "reach")
    for hop in range(1, depth + 1):
        if not hops:
            break
        # edges are not made distinct: what they reach is, with what was reached before
        near = frontier.select(*key)
        ways = hops
        if near.count() <= FEW:
            # few ids go down to where the edges come from, before anything is moved
            near = near.hint("broadcast")
            ways = [h.join(near.select(*scope, "id").hint("broadcast"), [*scope, "id"], "left_semi") for h in hops]
        steps = [h.join(near, [*scope, "id"]).select(*[c for c in key if c != "id"], F.col("next").alias("id"), F.lit(hop).alias("dist")) for h in ways]
        met = reduce(DataFrame.unionByName, [seen.select(*key, "dist"), *steps]).groupBy(*key).agg(F.min("dist").alias("dist"))
        frontier = met.filter(F.col("dist") == hop).join(known, [*scope, "id"], "left_semi").select(*key, F.lit(hop).alias("dist"))
        if stored or hop < depth:
            frontier = materialize(frontier, "reach")
        seen = seen.unionByName(frontier)
    return seen


def traversed(reach: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, directions=BOTH, by: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Edges that the search went along: they leave a node nearer than ``depth`` for a node.

    Not the induced subgraph: an edge between two nodes at the limit is left out.
    Each (source, target, relation) comes once for each search.
    """
    by, scope = by or [], scope or []
    groups = list(dict.fromkeys([*by, *scope]))
    if len(set(by) - set(scope)) == 1 and set(directions) & set(BOTH):
        (search,) = (c for c in by if c not in scope)
        inner = reach.filter(F.col("dist") < depth)
        at = materialize(inner.groupBy(*scope, "id").agg(F.collect_set(search).alias("at")), "searches")
        if at.filter(F.size("at") > _LISTED).isEmpty():
            return _listed(at, nodes, edges, directions, groups, scope, search)
        return lines_of(reach, nodes, edges, depth, directions, by, scope).rows()
    inner = reach.filter(F.col("dist") < depth).select(*groups, "id")
    known = nodes.select(*scope, "id").distinct()
    parts = []
    for direction, near, far in (("outgoing", "source", "target"), ("incoming", "target", "source")):
        if direction in directions:
            hit = edges.join(inner.withColumnRenamed("id", near), [*scope, near]).join(known.withColumnRenamed("id", far), [*scope, far], "left_semi")
            parts.append(hit.select(*groups, *[c for c in edges.columns if c not in groups]))
    if not parts:
        return edges.limit(0)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.dropDuplicates([*groups, "source", "target", "relation"])


#: Searches are listed with an edge, or with one of its ends, up to this number.
_LISTED = 64


def _listed(at: DataFrame, nodes: DataFrame, edges: DataFrame, directions, groups: list[str], scope: list[str], search: str) -> DataFrame:
    """What :func:`traversed` returns where no node has many searches (``at``): an edge takes those of both ends along.

    Edges are moved twice, to their targets and to their sources, and repeats go where they are then.
    """
    known = nodes.select(*scope, "id").distinct()
    marked = edges.drop(search)
    for end, flag in (("target", "__known_target"), ("source", "__known_source")):
        marked = marked.join(known.select(*scope, F.col("id").alias(end), F.lit(True).alias(flag)), [*scope, end], "left")
        marked = marked.join(at.select(*scope, F.col("id").alias(end), F.col("at").alias(f"__at_{end}")), [*scope, end], "left")
    none = F.array().cast(dict(at.dtypes)["at"])
    ways = [("outgoing", "__known_target", "__at_source"), ("incoming", "__known_source", "__at_target")]
    ends = [F.coalesce(F.when(F.col(known_end), F.col(near)), none) for direction, known_end, near in ways if direction in directions]
    found = marked.withColumn(search, reduce(F.array_union, ends)).filter(F.size(search) > 0).dropDuplicates([*scope, "source", "target", "relation"])
    return found.withColumn(search, F.explode(search)).select(*groups, *[c for c in edges.columns if c not in groups])


@dataclass
class Lines:
    """The edges that many searches went along, kept as what they follow from.

    A search goes along an edge if it is at either end, so edges and the ends of the
    searches (``inner``) are stored; a row for each search and edge is made by joining them
    and is never moved.  ``twice`` has what both ends would make.
    """

    inner: DataFrame
    edges: DataFrame
    twice: DataFrame
    search: str
    scope: list[str]

    def _groups(self) -> list[str]:
        return [c for c in self.inner.columns if c != "id"]

    def rows(self) -> DataFrame:
        """``(by..., edge's columns)``, one row for each search and edge."""
        edge = [*self.scope, "source", "target", "relation"]
        columns = [*self._groups(), *[c for c in self.edges.columns if c not in ("__ahead", "__back", *self._groups())]]
        at = lambda end: self.inner.withColumnRenamed("id", end)
        ahead = self.edges.filter("__ahead").join(at("source"), [*self.scope, "source"]).select(*columns)
        counted = self.twice.groupBy(*edge).agg(F.count(F.lit(1)).alias("n"))
        many = materialize(counted.filter(F.col("n") > _LISTED).select(*edge), "often")
        few, crowded = self.twice, None
        back = self.edges.filter("__back")
        if not many.isEmpty():
            few = self.twice.join(many, edge, "left_anti")
            crowded = back.join(many, edge, "left_semi").join(at("target"), [*self.scope, "target"]).join(self.twice, [*self._groups(), "source", "target", "relation"], "left_anti")
            back = back.join(many, edge, "left_anti")
        listed = few.groupBy(*edge).agg(F.collect_list(self.search).alias("__listed"))
        again = F.coalesce(F.array_contains("__listed", F.col(self.search)), F.lit(False))
        found = ahead.unionByName(back.join(listed, edge, "left").join(at("target"), [*self.scope, "target"]).filter(~again).select(*columns))
        return found if crowded is None else found.unionByName(crowded.select(*columns))

    def tally(self) -> DataFrame:
        """``(by..., relation, n)``: edges of each search by relation, from the degrees of the ends."""
        ends = [self.edges.filter(flag).select(*self.scope, F.col(end).alias("id"), "relation") for flag, end in (("__ahead", "source"), ("__back", "target"))]
        degrees = ends[0].unionByName(ends[1]).groupBy(*self.scope, "id", "relation").agg(F.count(F.lit(1)).alias("n"))
        made = self.inner.join(degrees, [*self.scope, "id"]).select(*self._groups(), "relation", "n")
        more = self.twice.select(*self._groups(), "relation", F.lit(-1).cast("long").alias("n"))
        return made.unionByName(more).groupBy(*self._groups(), "relation").agg(F.sum("n").alias("n"))

    def at(self, pairs: DataFrame, end: str) -> DataFrame:
        """The rows whose ``end`` is one of ``pairs (search, scope..., id)``."""
        far = "target" if end == "source" else "source"
        near = self.edges.join(pairs.select(*self._groups(), F.col("id").alias(end)).distinct(), [*self.scope, end])
        at = lambda e: self.inner.select(*self._groups(), F.col("id").alias(e), F.lit(True).alias(f"__at_{e}"))
        both = near.join(at(end), [*self._groups(), end], "left").join(at(far), [*self._groups(), far], "left")
        taken = (F.col("__ahead") & F.col("__at_source")) | (F.col("__back") & F.col("__at_target"))
        return both.filter(taken).select(*self._groups(), *[c for c in self.edges.columns if c not in ("__ahead", "__back", *self._groups())])

    def reached(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs (search, scope..., id)`` that the search reached, found from the pairs' own edges."""
        key = [*self._groups(), "id"]
        near = pairs.select(*key).distinct().join(self.inner.withColumn("__near", F.lit(True)), key, "left")
        rest = near.filter("__near is null").select(*key)
        ends = [self.at(rest, end).select(*self._groups(), F.col(end).alias("id")) for end in ("source", "target")]
        return near.filter("__near").select(*key).union(ends[0].union(ends[1]).distinct())


def lines_of(reach: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, directions=BOTH, by: list[str] | None = None, scope: list[str] | None = None) -> Lines:
    """What :func:`traversed` returns, for searches that one column of ``by`` tells apart."""
    by, scope = by or [], scope or []
    (search,) = (c for c in by if c not in scope)
    groups = list(dict.fromkeys([*by, *scope]))
    inner = reach.filter(F.col("dist") < depth).select(*groups, "id")
    known = nodes.select(*scope, "id").distinct()
    chosen = edges.drop(search).dropDuplicates([*scope, "source", "target", "relation"])
    for end, flag, direction in (("target", "__ahead", "outgoing"), ("source", "__back", "incoming")):
        if direction in directions:
            chosen = chosen.join(known.select(*scope, F.col("id").alias(end), F.lit(True).alias(flag)), [*scope, end], "left").fillna(False, [flag])
        else:
            chosen = chosen.withColumn(flag, F.lit(False))
    stored = materialize(chosen.filter("__ahead or __back"), "lines")
    return Lines(inner, stored, materialize(_twice(inner, stored, groups, scope), "twice"), search, scope)


def _twice(inner: DataFrame, edges: DataFrame, groups: list[str], scope: list[str]) -> DataFrame:
    """``(by..., source, target, relation)``: edges that a search is at both ends of.

    They are sought from the end with fewer edges: so a hub's edges are not gone
    through for each search at the hub.
    """
    ids = inner.select(*scope, "id").distinct()
    both = edges.filter("__ahead and __back").select(*scope, "source", "target", "relation")
    for end in ("source", "target"):
        both = both.join(ids.withColumnRenamed("id", end), [*scope, end], "left_semi")
    both = materialize(both, "inside")
    degrees = both.select(*scope, F.explode(F.array("source", "target")).alias("id")).groupBy(*scope, "id").agg(F.count(F.lit(1)).alias("n"))
    for end in ("source", "target"):
        both = both.join(degrees.select(*scope, F.col("id").alias(end), F.col("n").alias(f"n_{end}")), [*scope, end])
    small = F.col("n_source") <= F.col("n_target")
    turned = both.select(*scope, "source", "target", "relation", F.when(small, F.col("source")).otherwise(F.col("target")).alias("id"), F.when(small, F.col("target")).otherwise(F.col("source")).alias("far"))
    met = inner.join(turned, [*scope, "id"])
    return met.join(inner.withColumnRenamed("id", "far"), [*groups, "far"], "left_semi").select(*groups, "source", "target", "relation")


def bfs(start_ids: list[str], nodes: DataFrame, edges: DataFrame, depth: int = 2, edge_filter=None, directions=BOTH) -> tuple[DataFrame, DataFrame]:
    """``(visited ids with dist, edges)`` from given ids."""
    starts = nodes.sparkSession.createDataFrame([(i,) for i in start_ids], "id string")
    chosen = allowed(edges, edge_filter)
    reach = distances(starts, nodes, chosen, depth, directions)
    return reach, traversed(reach, nodes, chosen, depth, directions)


#: Rounds after which thinned edges are given up, and all edges are searched.
_ROUNDS = 24


def cycle_members(edges: DataFrame, relations=DEPENDENCIES, source: str = "source", target: str = "target") -> DataFrame:
    """``(id)`` of every node that lies on a cycle (self-loops too).

    Strongly connected components by colouring (Orzan, 2004): after nodes without a
    way in or out are trimmed, each node takes the largest id that reaches it; those
    that reach the node of their colour backwards, within the colour, are its
    component.  Components are taken out and the rest is coloured again.  Memory is
    linear in the edges, whatever the size of a component; rounds follow the
    graph's diameter.

    Rounds first run on at most four edges of each node: what is strongly connected by
    some edges is so by all.  If that leaves nodes that might be on a cycle, all edges
    are searched, between the components found so far.  Ids may be of any ordered type.
    """
    chosen = allowed(edges, relations) if relations is not None else edges
    whole = materialize(chosen.select(F.col(source).alias("u"), F.col(target).alias("v")), "pairs")
    found = whole.filter("u = v").select(F.col("u").alias("id"))
    whole = whole.filter("u <> v")
    ways = [whole.groupBy(a).agg(F.min(b).alias("least"), F.max(b).alias("most")) for a, b in (("u", "v"), ("v", "u"))]
    out, into = (materialize(w, "ends") for w in ways)
    ends = F.explode(F.array("least", "most"))
    thin = materialize(out.select("u", ends.alias("v")).union(into.select(ends.alias("u"), "v")).distinct(), "thin")
    if thin.count() == whole.count():  # these are all edges
        live = _trim(thin)
    else:
        live = _trim(thin, _ROUNDS)
        joined = materialize(_several(_taken(live, _ROUNDS)), "joined")
        found = found.union(joined.select("id"))
        loose = out.select(F.col("u").alias("id")).join(into.select(F.col("v").alias("id")), "id", "left_semi").join(joined.select("id"), "id", "left_anti")
        if loose.isEmpty():
            return found.distinct()
        rest = whole
        for end in ("u", "v"):
            rest = rest.join(joined.select(F.col("id").alias(end), F.col("color").alias(f"{end}_color")), end, "left")
        rest = rest.select(*[F.coalesce(f"{end}_color", end).alias(end) for end in ("u", "v")])
        live = _trim(materialize(rest.filter("u <> v").distinct(), "live"))
    while not live.isEmpty():
        taken = _taken(live)
        found = found.union(_several(taken).select("id"))
        gone = taken.select("id")
        rest = live.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti")
        live = _trim(materialize(rest.select("u", "v"), "live"))
    return found.distinct()


def _taken(live: DataFrame, most: int | None = None) -> DataFrame:
    """``(id, color)``: for each colour of the edges the component of its own node; none if colouring takes over ``most`` rounds."""
    colors = _colors(live, most)
    if colors is None:
        return live.select(F.col("u").alias("id"), F.col("u").alias("color")).limit(0)
    inside = live.join(colors.select(F.col("id").alias("u"), "color"), "u").join(colors.select(F.col("id").alias("v"), F.col("color").alias("c")), "v").filter("color = c")
    inside = materialize(inside.select("u", "v"), "colored")
    frontier = taken = materialize(colors.filter("id = color"), "taken")
    while not frontier.isEmpty():
        step = inside.join(frontier.select(F.col("id").alias("v"), "color"), "v").select(F.col("u").alias("id"), "color").distinct()
        frontier = materialize(step.join(taken.select("id"), "id", "left_anti"), "taken")
        taken = taken.unionByName(frontier)
    return taken


def _several(taken: DataFrame) -> DataFrame:
    """The components of more than one node."""
    sizes = taken.groupBy("color").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return taken.join(sizes, "color", "left_semi").select("id", "color")


def _trim(live: DataFrame, most: int | None = None) -> DataFrame:
    """Edges left when nodes without a way in or without a way out are removed, again and again (``most`` times)."""
    n, rounds = live.count(), 0
    while n and rounds != most:
        rounds += 1
        both = live.select(F.col("u").alias("x")).distinct().join(live.select(F.col("v").alias("x")), "x", "left_semi")
        kept = live.join(both.withColumnRenamed("x", "u"), "u", "left_semi").join(both.withColumnRenamed("x", "v"), "v", "left_semi")
        before, live = live, materialize(kept.select("u", "v"), "live")
        release(before)
        m = live.count()
        if m == n:
            break
        n = m
    return live


def _colors(live: DataFrame, most: int | None = None) -> DataFrame | None:
    """``(id, color)``: the largest id from which each node can be reached, itself included; None if ``most`` rounds don't do."""
    colors = frontier = materialize(live.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("color", F.col("id")), "colors")
    last, rounds = colors, 0
    while not frontier.isEmpty():
        if rounds == most:
            return None
        rounds += 1
        offered = live.join(frontier.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.max("color").alias("offered"))
        marked = materialize(colors.join(offered, "id", "left").select("id", F.greatest("color", "offered").alias("color"), (F.col("offered") > F.col("color")).alias("moved")), "colors")
        release(last)
        last = marked
        frontier = marked.filter("moved").select("id", "color")
        colors = marked.select("id", "color")
    return colors
