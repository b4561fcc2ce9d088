"""Queries over the driver's tables for every operator of the graph engine, with DuckDB oracles.

Results have scalar columns only: lists are sorted and joined, counts are longs.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.build import serialize
from treeloom.functions import naming
from treeloom.operators import annotate, diffs, document, parse, resolve, traverse, validate
from treeloom.operators.context import extract_contexts, seeds_of
from treeloom.operators.graph import CodeGraph
from treeloom.operators.resolve import guessed_targets as resolve_guesses
from treeloom.operators.resolve import nearest_methods
from treeloom.plans import projections as P
from treeloom.plans.staging import materialize, new_path
from treeloom.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STAR = P.relational_ctes()
PARTS = P.relational_ctes(P.PART_NODES_SQL, P.PART_EDGES_SQL)


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql.strip()
        return function

    return add


def star(spark, sf_dir) -> CodeGraph:
    return P.relational_graph(spark, sf_dir)


# --- identity, predicates, lookups


@query("select p_partkey, substr(md5('part_tpch_' || p_name || '_' || p_partkey), 1, 8) as id from part")
def node_ids(spark, sf_dir):
    return P.table(spark, sf_dir, "part").select("p_partkey", naming.short_id("part_tpch_", F.col("p_name"), "_", F.col("p_partkey").cast("string")).alias("id"))


@query(f"with {STAR} select id, label, path from nodes where type in ('file', 'test_file')")
def files(spark, sf_dir):
    return star(spark, sf_dir).files().select("id", "label", "path")


@query(f"with {STAR} select id, type, label from nodes where type in ('function', 'method', 'test_function')")
def functions(spark, sf_dir):
    return star(spark, sf_dir).functions().select("id", "type", "label")


def _pages(spark, sf_dir) -> CodeGraph:
    pages = P.table(spark, sf_dir, "pages")
    kind = F.when(naming.is_test_path(F.col("url")), "test_file").otherwise("file")
    nodes = pages.select(F.col("page_id").alias("id"), kind.alias("type"), naming.last_part(F.col("url")).alias("label"), F.col("url").alias("path"))
    return CodeGraph(nodes, nodes.limit(0))


@query("select page_id as id, url as path from pages where contains(url, '/en/')")
def file_by_path_substr(spark, sf_dir):
    return _pages(spark, sf_dir).find_file_by_path("/en/").select("id", "path")


@query(f"with {STAR} select id, label from nodes where type = 'file' and path = 'src/region_2.py'")
def file_by_path_exact(spark, sf_dir):
    return star(spark, sf_dir).find_file_by_path("src/region_2.py", exact=True).select("id", "label")


@query(f"with {STAR} select id, type from nodes where type in ('function', 'method', 'test_function') and label = 'Customer#000000007'")
def function_by_name(spark, sf_dir):
    return star(spark, sf_dir).find_function_by_name("Customer#000000007").select("id", "type")


@query(f"with {STAR} select id, type, label from nodes where id = 'nation_3'")
def node_by_id(spark, sf_dir):
    return star(spark, sf_dir).node("nation_3").select("id", "type", "label")


@query("select page_id, replace(regexp_replace(url, '\\.py$', ''), '/', '.') as module from pages")
def module_name(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", naming.module_name(F.col("url")).alias("module"))


@query(
    """select page_id, (starts_with(list_last(string_split(url, '/')), 'test_') or ends_with(list_last(string_split(url, '/')), '_test.py')
       or list_contains(string_split(url, '/'), 'tests') or list_contains(string_split(url, '/'), 'test')) as is_test from pages"""
)
def is_test_file(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", naming.is_test_path(F.col("url")).alias("is_test"))


@query(
    """select event_id, case when regexp_matches(split_part(props, ':', -1), '^\\s*\\p{Lu}') then 1 else 0 end as capital from events""",
    name="starts_upper",
)
def starts_upper_query(spark, sf_dir):
    tail = F.regexp_replace(F.substring_index("props", ":", -1), r"^\s+", "")
    return P.table(spark, sf_dir, "events").select("event_id", naming.starts_upper(tail).cast("int").alias("capital"))


@query("select n_nationkey, n_name as type_name from nation")
def hover_types(spark, sf_dir):
    text = F.concat(F.lit("(variable) x: `"), "n_name", F.lit("`"))
    wrong = F.concat(F.lit("(variable) y: str | "), "n_name")
    both = P.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(text, wrong)).alias("hover"))
    return both.select("n_nationkey", naming.hover_type(F.col("hover")).alias("type_name")).filter("type_name is not null")


@query(
    """with words as (select p_partkey, string_split(p_name, ' ') as w from part)
       select p_partkey, array_to_string(list_transform(range(len(w), 0, -1), lambda i: array_to_string(w[1:i], '_')), ',') as candidates from words"""
)
def test_target_candidates(spark, sf_dir):
    name = F.concat(F.lit("test_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return P.table(spark, sf_dir, "part").select("p_partkey", F.array_join(naming.test_target_candidates(name), ",").alias("candidates"))


@query(
    """select o_orderkey, arg_max(target, n) as target_label from (
       select o_orderkey, unnest(['1_urgent', '2_high', '3_medium', '4_not_specified', '4_not', '5_low', '5']) as target,
              lower(replace(o_orderpriority, '-', '_')) || '_' || o_orderkey as name, length(target) as n from orders)
       where starts_with(replace(name, ' ', '_'), target || '_') group by o_orderkey"""
)
def guessed_targets(spark, sf_dir):
    """Tests named after an order's priority; several priorities share a beginning."""
    orders = P.table(spark, sf_dir, "orders")
    name = F.replace(F.replace(F.lower("o_orderpriority"), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    snap = {"repo": F.lit(""), "commit": F.lit("")}
    tests = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("test_"), name, F.lit("_"), "o_orderkey").alias("label")).withColumns(snap)
    known = spark.createDataFrame([(x,) for x in ("1_urgent", "2_high", "3_medium", "4_not_specified", "4_not", "5_low", "5")], "label string").withColumns(snap)
    return resolve_guesses(tests, known).select(F.col("id").alias("o_orderkey"), "target_label")


# --- one-hop joins


def _ids(column: str):
    return F.array_join(F.transform(column, lambda x: x["id"]), ",")


@query(
    f"""with {STAR}, held as (select e.source as of_id, n.id, n.type, n.label, n.signature from edges e join nodes n on n.id = e.target where relation = 'contains')
    select n.id as of_id, coalesce(string_agg(h.id, ',' order by h.id) filter (h.type = 'class'), '') as classes,
           coalesce(string_agg(h.id, ',' order by h.id) filter (h.type in ('function', 'test_function')), '') as functions,
           coalesce(string_agg(h.label || h.signature, ',' order by h.id) filter (h.type in ('function', 'test_function')), '') as signatures, any_value(n.type || ' ' || n.label) as file
    from nodes n left join held h on h.of_id = n.id group by n.id"""
)
def file_contents(spark, sf_dir):
    found = star(spark, sf_dir).get_file_contents()
    signatures = F.array_join(F.transform("functions", lambda x: F.concat(x["label"], x["signature"])), ",")
    file = F.concat("file.type", F.lit(" "), "file.label")
    return found.select(F.col("of").alias("of_id"), _ids("classes").alias("classes"), _ids("functions").alias("functions"), signatures.alias("signatures"), file.alias("file"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.col("of").alias("of_id"), "id", "type")


def _hop_sql(relation: str, given: str, wanted: str, more: str = "") -> str:
    return f"with {STAR} select e.{given} as of_id, n.id, n.type from edges e join nodes n on n.id = e.{wanted} where e.relation = '{relation}'{more}"


@query(_hop_sql("contains", "source", "target"))
def class_methods(spark, sf_dir):
    return _pairs(star(spark, sf_dir).get_class_methods())


@query(_hop_sql("calls", "target", "source"))
def callers(spark, sf_dir):
    return _pairs(star(spark, sf_dir).find_callers())


@query(_hop_sql("calls", "source", "target"))
def callees(spark, sf_dir):
    return _pairs(star(spark, sf_dir).find_callees())


@query(_hop_sql("calls", "target", "source", " and n.type = 'test_function'"))
def tests_for(spark, sf_dir):
    return _pairs(star(spark, sf_dir).find_test_functions_for())


@query(f"with {STAR} select source, target, relation from edges where source in (select id from nodes where type = 'class')")
def export_one_hop(spark, sf_dir):
    graph = star(spark, sf_dir)
    return graph.export_subgraph(graph.nodes.filter("type = 'class'").select("id")).edges


@query(
    f"""with {STAR}, seeds as (select id from nodes where type = 'class')
    select id, type from nodes where id in (select id from seeds) or id in (select target from edges where source in (select id from seeds))"""
)
def export_one_hop_nodes(spark, sf_dir):
    graph = star(spark, sf_dir)
    return graph.export_subgraph(graph.nodes.filter("type = 'class'").select("id")).nodes.select("id", "type")


# --- traversal: one search from every nation


def _bfs_sql(depth: int, out: bool = True, back: bool = True, relations: str | None = None, tail: str | None = None) -> str:
    chosen = f"chosen as (select * from edges{f' where relation in ({relations})' if relations else ''})"
    ways = " union all ".join(w for w, on in (("select source as a, target as b from chosen", out), ("select target, source from chosen", back)) if on)
    return f"""with recursive {STAR}, {chosen}, hops as (select distinct * from ({ways}) t(a, b) where b in (select id from nodes)),
    reach(start, id, dist) as (
      select id, id, 0 from nodes where type = 'class'
      union
      select r.start, h.b, r.dist + 1 from reach r join hops h on h.a = r.id where r.dist < {depth}),
    near as (select start, id, min(dist) as dist from reach group by start, id)
    {tail or 'select start, id, dist from near'}"""


def _reach(spark, sf_dir, depth, relations=None, directions=traverse.BOTH, lines=False) -> DataFrame:
    graph = star(spark, sf_dir)
    starts = graph.nodes.filter("type = 'class'").select("id", F.col("id").alias("start"))
    edges = traverse.allowed(graph.edges, relations)
    reach = traverse.distances(starts, graph.nodes, edges, depth, directions, by=["start"], stored=False)
    if lines:
        return traverse.traversed(reach, graph.nodes, edges, depth, directions, by=["start"]).select("start", "source", "target", "relation")
    return reach.select("start", "id", "dist")


@query(_bfs_sql(0))
def bfs_d0(spark, sf_dir):
    return _reach(spark, sf_dir, 0)


@query(_bfs_sql(1))
def bfs_d1(spark, sf_dir):
    return _reach(spark, sf_dir, 1)


@query(_bfs_sql(2))
def bfs_d2(spark, sf_dir):
    return _reach(spark, sf_dir, 2)


@query(_bfs_sql(2, relations="'contains'"))
def bfs_filtered(spark, sf_dir):
    return _reach(spark, sf_dir, 2, ("contains",))


@query(f"with {STAR} select id as start, id, 0 as dist from nodes where type = 'class'")
def bfs_no_relations(spark, sf_dir):
    return _reach(spark, sf_dir, 2, ())


@query(_bfs_sql(2, back=False))
def bfs_outgoing(spark, sf_dir):
    return _reach(spark, sf_dir, 2, directions=("outgoing",))


@query(_bfs_sql(2, out=False))
def bfs_incoming(spark, sf_dir):
    return _reach(spark, sf_dir, 2, directions=("incoming",))


@query(
    _bfs_sql(
        2,
        tail="""select distinct start, source, target, relation from (
      select start, source, target, relation from near join chosen on source = id where dist < 2 and target in (select id from nodes)
      union all
      select start, source, target, relation from near join chosen on target = id where dist < 2 and source in (select id from nodes))""",
    )
)
def bfs_edges(spark, sf_dir):
    return _reach(spark, sf_dir, 2, lines=True)


@query(
    f"""with recursive {PARTS}, reach(a, b) as (select source, target from edges union select r.a, e.target from reach r join edges e on e.source = r.b)
    select distinct a as id from reach where a = b"""
)
def cycle_members(spark, sf_dir):
    return traverse.cycle_members(P.part_numbers(spark, sf_dir).edges).select(P.part_name(F.col("id")).alias("id"))


@query("select cast(null as varchar) as id where false")
def cycle_members_of_a_tree(spark, sf_dir):
    graph = star(spark, sf_dir)
    return traverse.cycle_members(graph.edges, ("contains",))


# --- aggregation


@query(
    f"""with {STAR} select n.id, count(e.source) as caller_count, coalesce(string_agg(c.id, ',' order by c.id), '') as direct_callers
    from nodes n left join edges e on e.target = n.id and e.relation = 'calls' left join nodes c on c.id = e.source
    where n.type in ('function', 'method', 'test_function') group by n.id"""
)
def call_context(spark, sf_dir):
    graph = star(spark, sf_dir)
    snap = lambda df: df.withColumns({"repo": F.lit(""), "commit": F.lit("")})
    found = annotate.call_context(snap(graph.nodes), snap(graph.edges)).filter("caller_count is not null")
    return found.select("id", F.col("caller_count").cast("long").alias("caller_count"), _ids("direct_callers").alias("direct_callers"))


@query(f"with {STAR} select relation, count(*) as n from edges group by relation")
def edge_histogram(spark, sf_dir):
    return star(spark, sf_dir).edge_histogram()


@query(f"with {STAR} select type, count(*) as n from nodes group by type")
def node_counts(spark, sf_dir):
    return star(spark, sf_dir).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select p_partkey, case when n = 1 then 'exact' else 'ambiguous' end as confidence, n as candidates from (
       select l.p_partkey, count(*) over (partition by l.p_partkey) as n, row_number() over (partition by l.p_partkey order by r.p_partkey) as k
       from part l join part r on l.p_name = r.p_name) where k = 1"""
)
def resolve_exact_ambiguous(spark, sf_dir):
    """How sure a part's name is, by the engine's index of names."""
    columns = {"repo": F.lit(""), "commit": F.lit(""), "src_path": F.lit(""), "emit_ord": F.lit(0), "label": F.col("p_name"), "id": F.col("p_partkey")}
    found = resolve.named_index(P.table(spark, sf_dir, "part").withColumns(columns))
    return found.select(F.col("hit").alias("p_partkey"), resolve.sure(F.col("n")).alias("confidence"), F.col("n").alias("candidates"))


@query("select p_partkey, p_name from (select *, row_number() over (partition by p_name order by p_retailprice, p_partkey) as k from part) where k = 1")
def first_wins(spark, sf_dir):
    return parse.first_by(P.table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_retailprice"), ["p_name"], ["p_retailprice", "p_partkey"]).select("p_partkey", "p_name")


# --- checks on the part graph


@query(f"with {PARTS} select id, label from nodes where id not in (select source from edges) and id not in (select target from edges)")
def val_orphans(spark, sf_dir):
    graph = P.part_graph(spark, sf_dir)
    return validate.orphans(graph.nodes, graph.edges).select("id", "label")


@query(f"with {PARTS} select source, relation from edges where source = target and relation <> 'calls'")
def val_self_loops(spark, sf_dir):
    return validate.self_loops(P.part_graph(spark, sf_dir).edges).select("source", "relation")


@query(
    f"""with {STAR}, lacking as (
      select type, id, concat_ws(',', case when type in ('function', 'method', 'test_function') and coalesce(signature, '') = '' then 'signature' end,
                                 case when type not in ('file', 'test_file', 'import') and coalesce(filepath, '') = '' then 'filepath' end,
                                 case when type in ('file', 'test_file') and coalesce(path, '') = '' then 'path' end) as missing from nodes)
    select l.type, l.id, l.missing, t.total from lacking l join (select type, count(*) as total from nodes group by type) t on t.type = l.type where l.missing <> ''"""
)
def val_metadata(spark, sf_dir):
    return validate.missing_metadata(star(spark, sf_dir).nodes).select("type", "id", F.array_join("missing", ",").alias("missing"), "total")


def _order_contexts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each order as a context: the parts of its lines as seed, test and context nodes; later lines use their supplier, successive ones call each other."""
    lines = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("instance_id"), "l_linenumber", "l_partkey", "l_suppkey")
    part = lambda c: F.concat(F.lit("part_"), c)
    supplier = F.concat(F.lit("supplier_"), "l_suppkey")
    role = F.when(F.col("l_linenumber") == 1, "seed").when(F.col("l_linenumber") == 5, "test").otherwise("context")
    kind = F.when(F.col("l_partkey") % 10 == 0, "file").otherwise("function")
    nodes = lines.select("instance_id", role.alias("role"), part("l_partkey").alias("id"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("label"), kind.alias("type")).distinct()
    edges = lines.filter("l_linenumber > 1").select("instance_id", part("l_partkey").alias("source"), supplier.alias("target"), F.lit("uses").alias("relation"))
    more = lines.join(lines.select("instance_id", F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("q")), "instance_id").filter("k = l_linenumber + 1")
    return nodes, edges.unionByName(more.select("instance_id", part("l_partkey").alias("source"), part("q").alias("target"), F.lit("calls").alias("relation")))


ORDERS = """
cnodes as (select distinct l_orderkey::varchar as instance_id, case l_linenumber when 1 then 'seed' when 5 then 'test' else 'context' end as role,
             'part_' || l_partkey as id, 'p' || (l_partkey % 50) as label, case when l_partkey % 10 = 0 then 'file' else 'function' end as type from lineitem),
inside as (select distinct instance_id, id, label, type from cnodes where role <> 'test'),
cedges as (select l_orderkey::varchar as instance_id, 'part_' || l_partkey as source, 'supplier_' || l_suppkey as target, 'uses' as relation from lineitem where l_linenumber > 1
           union all
           select a.l_orderkey::varchar, 'part_' || a.l_partkey, 'part_' || b.l_partkey, 'calls' from lineitem a join lineitem b
           on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"""


@query(
    f"""with {ORDERS} select instance_id, source, target, relation, count(*) as n from cedges e
    where not exists (from inside n where n.instance_id = e.instance_id and n.id = e.source)
       or not exists (from inside n where n.instance_id = e.instance_id and n.id = e.target) group by all"""
)
def val_broken_edges(spark, sf_dir):
    nodes, edges = _order_contexts(spark, sf_dir)
    return validate.broken_edges(nodes, edges).groupBy("instance_id", "source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {ORDERS} select instance_id, source, target, relation, count(*) - 1 as extra from cedges group by all having count(*) > 1")
def val_dup_edges(spark, sf_dir):
    return validate.duplicate_edges(_order_contexts(spark, sf_dir)[1])


@query(f"with {ORDERS} select instance_id, label, count(distinct id) as n_ids from cnodes where role = 'seed' group by all having count(distinct id) > 1")
def val_ambiguous_seeds(spark, sf_dir):
    return validate.ambiguous_seeds(_order_contexts(spark, sf_dir)[0])


@query(
    f"""with {ORDERS} select distinct instance_id, id from cnodes n where role = 'seed'
    and not exists (from cedges e where e.relation = 'calls' and e.instance_id = n.instance_id and e.source = n.id)"""
)
def val_seed_connectivity(spark, sf_dir):
    nodes, edges = _order_contexts(spark, sf_dir)
    return validate.disconnected_seeds(nodes, edges.filter("relation = 'calls'")).select("instance_id", "id")


@query(
    f"""with recursive {PARTS}, reach(a, b) as (select source, target from edges union select r.a, e.target from reach r join edges e on e.source = r.b),
    bad(check_name, severity, t, k) as (
      select 'orphans', 'error', label || ' (function)', 5 from nodes where id not in (select source from edges) and id not in (select target from edges)
      union all select 'cycles', 'warning', label, 3 from nodes where id in (select a from reach where a = b)
      union all select 'self_loops', 'warning', label, 3 from edges join nodes on id = source where source = target
      union all select 'metadata:function', 'warning', label || ': signature', 3 from nodes where coalesce(signature, '') = '')
    select check_name, severity, count(*) as n, array_to_string(list_sort(list(t))[1:any_value(k)], ',') as sample from bad group by check_name, severity"""
)
def val_findings(spark, sf_dir):
    """All graph checks as one table."""
    graph = P.part_numbers(spark, sf_dir)
    found = validate.graph_findings(graph.nodes, graph.edges, P.part_name)
    return found.select(F.col("check").alias("check_name"), "severity", F.col("count").alias("n"), F.array_join("sample", ",").alias("sample"))


@query(
    f"""with {ORDERS}, ids as (select distinct o_orderkey::varchar as instance_id from orders),
    roles as (select instance_id, count(*) filter (role = 'context') as c, count(*) filter (role = 'test') as t from cnodes group by instance_id),
    marked as (select e.*, s.id is null as no_source, t.id is null as no_target from cedges e
               left join inside s on s.instance_id = e.instance_id and s.id = e.source left join inside t on t.instance_id = e.instance_id and t.id = e.target),
    ends as (select instance_id, source as id from cedges union select instance_id, target from cedges)
    select instance_id, 'small_context' as check_name, 'warning' as severity, 1::bigint as n from ids left join roles using (instance_id) where coalesce(c, 0) < 2
    union all select instance_id, 'no_tests', 'warning', 1 from ids left join roles using (instance_id) where coalesce(t, 0) = 0
    union all select instance_id, 'orphans', 'error', count(*) from inside anti join ends using (instance_id, id) group by instance_id
    union all select instance_id, 'broken_edges', 'error', count(*) from marked where no_source or no_target group by instance_id
    union all select instance_id, 'dangling_ends', 'error', count(distinct t) from (
      select instance_id, 'source ' || substr(source, 1, 8) as t from marked where no_source
      union all select instance_id, 'target ' || substr(target, 1, 8) from marked where no_target) group by instance_id
    union all select instance_id, 'disconnected_seeds', 'error', count(*) from (
      select distinct instance_id, id from cnodes where role = 'seed') s
      where not exists (from cedges e where e.instance_id = s.instance_id and e.source = s.id) group by instance_id
    union all select instance_id, 'seed_types', 'warning', count(*) from cnodes where role = 'seed' and type = 'file' group by instance_id
    union all select instance_id, 'ambiguous_seeds', 'error', count(*) from (
      select instance_id, label from cnodes where role = 'seed' group by all having count(distinct id) > 1) group by instance_id
    union all select instance_id, 'duplicate_edges', 'error', sum(n - 1)::bigint from (
      select instance_id, count(*) as n from cedges group by instance_id, source, target, relation having count(*) > 1) group by instance_id"""
)
def val_context_findings(spark, sf_dir):
    nodes, edges = _order_contexts(spark, sf_dir)
    ids = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("instance_id"))
    found = validate.context_findings(ids, nodes, edges)
    return found.select(F.col("owner").alias("instance_id"), F.col("check").alias("check_name"), "severity", F.col("count").alias("n"))


# --- generated sources: parsing and resolution

GEN = """
supp as (select s_suppkey as s, n_nationkey as n, n_regionkey as r from supplier join nation on s_nationkey = n_nationkey),
cust as (select c_custkey as c, n_nationkey as n from customer join nation on c_nationkey = n_nationkey),
nat as (select n_nationkey as n, n_regionkey as r from nation),
gedges(source, target, relation, confidence) as (
  select 'core/base.py', 'core/base.py::Base', 'contains', null
  union all select 'core/base.py::Base', 'core/base.py::Base.' || unnest(['__init__', 'describe', 'title', 'show']), 'contains', null
  union all select 'core/base.py', 'import json', 'imports', null
  union all select 'core/base.py::Base.describe', 'import json', 'depends_on', null
  union all select 'core/base.py::Base.show', 'core/base.py::Base.title', 'accesses', 'qualified'
  union all select f, f || '::Region' || r, 'contains', null from (select r_regionkey as r, 'regions/region_' || r_regionkey || '.py' as f from region)
  union all select f || '::Region' || r, f || '::Region' || r || '.describe', 'contains', null from (select r_regionkey as r, 'regions/region_' || r_regionkey || '.py' as f from region)
  union all select f || '::Region' || r, f || '::Region' || r || '.nation_' || n, 'contains', null from (select n, r, 'regions/region_' || r || '.py' as f from nat)
  union all select 'regions/region_' || r_regionkey || '.py', 'import core.base.Base', 'imports', null from region
  union all select 'regions/region_' || r_regionkey || '.py', 'core/base.py', 'module_depends_on', null from region
  union all select 'regions/region_' || r_regionkey || '.py::Region' || r_regionkey, 'core/base.py::Base', 'inherits', 'exact' from region
  union all select 'regions/region_' || r_regionkey || '.py::Region' || r_regionkey || '.describe', 'core/base.py::Base.describe', unnest(['calls', 'overrides']), unnest(['qualified', null]) from region
  union all select f, f || '::Nation' || n, 'contains', null from (select n, 'nations/nation_' || n || '.py' as f from nat)
  union all select f || '::Nation' || n, f || '::Nation' || n || '.' || unnest(['__init__', 'build', 'label', 'describe']), 'contains', null from (select n, 'nations/nation_' || n || '.py' as f from nat)
  union all select 'nations/nation_' || n || '.py', 'import regions.region_' || r || '.Region' || r, 'imports', null from nat
  union all select 'nations/nation_' || n || '.py', 'regions/region_' || r || '.py', 'module_depends_on', null from nat
  union all select 'nations/nation_' || n || '.py::Nation' || n, 'regions/region_' || r || '.py::Region' || r, unnest(['inherits', 'uses']), 'exact' from nat
  union all select 'nations/nation_' || n || '.py::Nation' || n || '.build', 'regions/region_' || r || '.py::Region' || r, 'calls', 'qualified' from nat
  union all select 'nations/nation_' || n || '.py::Nation' || n || '.build', 'import regions.region_' || r || '.Region' || r, 'depends_on', null from nat
  union all select 'nations/nation_' || n || '.py::Nation' || n || '.describe', 'nations/nation_' || n || '.py::Nation' || n || '.label', 'accesses', 'qualified' from nat
  union all select 'nations/nation_' || n || '.py::Nation' || n || '.describe', 'regions/region_' || r || '.py::Region' || r || '.describe', 'overrides', null from nat
  union all select 'nations/nation_' || n || '.py', 'nations/nation_' || n || '.py::supplier_' || s, 'contains', null from supp
  union all select 'nations/nation_' || n || '.py::supplier_' || s, 'regions/region_' || r || '.py::Region' || r || '.nation_' || n, 'calls', 'qualified' from supp
  union all select 'nations/nation_' || n || '.py::supplier_' || s, 'import regions.region_' || r || '.Region' || r, 'depends_on', null from supp
  union all select 'tests/test_nation_' || n || '.py', 'tests/test_nation_' || n || '.py::test_supplier_' || s, 'contains', null from supp
  union all select distinct 'tests/test_nation_' || n || '.py', 'tests/test_nation_' || n || '.py::test_all_of_' || n, 'contains', null from supp
  union all select 'tests/test_nation_' || n || '.py', 'import nations.nation_' || n || '.supplier_' || s, 'imports', null from supp
  union all select distinct 'tests/test_nation_' || n || '.py', 'nations/nation_' || n || '.py', 'module_depends_on', null from supp
  union all select 'tests/test_nation_' || n || '.py::' || t, 'nations/nation_' || n || '.py::supplier_' || s, rel, conf from (
    select s, n, unnest(['test_supplier_' || s, 'test_supplier_' || s, 'test_all_of_' || n, 'test_all_of_' || n]) as t,
           unnest(['calls', 'tests', 'calls', 'tests']) as rel, unnest(['qualified', 'exact', 'qualified', 'qualified']) as conf from supp)
  union all select 'tests/test_nation_' || n || '.py::' || unnest(['test_supplier_' || s, 'test_all_of_' || n]), 'import nations.nation_' || n || '.supplier_' || s, 'depends_on', null from supp
  union all select 'customers/customer_' || c || '.py', 'customers/customer_' || c || '.py::customer_' || c, 'contains', null from cust
  union all select 'customers/customer_' || c || '.py', 'import nations.nation_' || n || '.Nation' || n, 'imports', null from cust
  union all select 'customers/customer_' || c || '.py', 'nations/nation_' || n || '.py', 'module_depends_on', null from cust
  union all select 'customers/customer_' || c || '.py::customer_' || c, 'nations/nation_' || n || '.py::Nation' || n || '.build', 'calls', 'qualified' from cust
  union all select 'customers/customer_' || c || '.py::customer_' || c, 'nations/nation_' || n || '.py::Nation' || n || '.label', 'accesses', 'qualified' from cust
  union all select 'customers/customer_' || c || '.py::customer_' || c, 'import nations.nation_' || n || '.Nation' || n, 'depends_on', null from cust)"""


def _named(nodes: DataFrame) -> DataFrame:
    owner = F.when(F.col("class").isNotNull(), F.concat("class", F.lit("."))).otherwise("")
    name = F.coalesce("path", F.when(F.col("type") == "import", F.concat(F.lit("import "), "label")), F.concat("filepath", F.lit("::"), owner, "label"))
    return nodes.select("id", name.alias("qname"))


def _gen_edges(spark, sf_dir, *relations: str) -> DataFrame:
    graph = P.generated_graph(spark, sf_dir)
    names = _named(graph.nodes)
    edges = graph.edges.filter(F.col("relation").isin(*relations)) if relations else graph.edges
    ends = edges.join(names.select(F.col("id").alias("source"), F.col("qname").alias("s")), "source").join(names.select(F.col("id").alias("target"), F.col("qname").alias("t")), "target")
    return ends.select(F.col("s").alias("source"), F.col("t").alias("target"), "relation", "confidence", "via", "derived_from")


def _relation_query(name: str, *relations: str) -> None:
    listed = ", ".join(f"'{r}'" for r in relations)
    sql = f"with {GEN} select source, target, relation, confidence from gedges where relation in ({listed})"
    QUERIES[name] = lambda spark, sf_dir: _gen_edges(spark, sf_dir, *relations).select("source", "target", "relation", "confidence")
    ORACLES[name] = sql


for _name, _relations in {
    "parsed_contains": ("contains",),
    "parsed_imports": ("imports",),
    "depends_on": ("depends_on",),
    "resolve_calls_tiered": ("calls",),
    "resolve_accesses": ("accesses",),
    "resolve_inherits": ("inherits",),
    "resolve_tests": ("tests",),
    "uses_confidence": ("uses",),
    "overrides": ("overrides",),
    "module_depends_on": ("module_depends_on",),
}.items():
    _relation_query(_name, *_relations)


@query(f"with {GEN} select source, target from gedges where relation = 'tests' and contains(source, '::test_all_of_')")
def tests_derived(spark, sf_dir):
    return _gen_edges(spark, sf_dir, "tests").filter("derived_from = 'calls'").select("source", "target")


@query(f"with {GEN} select source, target from gedges where relation = 'calls' and target = 'core/base.py::Base.describe'")
def super_calls(spark, sf_dir):
    return _gen_edges(spark, sf_dir, "calls").filter("via = 'super'").select("source", "target")


@query("select 'Nation' || n_nationkey as start, 'core/base.py::Base.' || unnest(['show', 'title']) as found from nation")
def nearest_ancestor(spark, sf_dir):
    """Where ``show`` and ``title`` come from, seen from every nation's class."""
    graph = P.generated_graph(spark, sf_dir)
    starts = graph.nodes.filter("type = 'class' and label like 'Nation%'")
    asked = starts.select("repo", "commit", F.col("id").alias("start"), F.explode(F.array(F.lit("show"), F.lit("title"))).alias("method"))
    found = nearest_methods(asked, graph.nodes, graph.edges.filter("relation = 'inherits'").withColumns({"src_path": F.lit(""), "emit_ord": F.lit(0)}))
    names = _named(graph.nodes).select(F.col("id").alias("hit"), F.col("qname").alias("found"))
    return found.join(names, "hit").join(starts.select(F.col("id").alias("start"), "label"), "start").select(F.col("label").alias("start"), "found")


@query(
    f"""with {GEN}, ends as (select distinct unnest([source, target]) as name from gedges)
    select name, case when starts_with(name, 'import ') then 'import' when not contains(name, '::') then case when starts_with(name, 'tests/') then 'test_file' else 'file' end
      when contains(name, '::test_') then 'test_function' when contains(split_part(name, '::', 2), '.') then 'method'
      when regexp_matches(split_part(name, '::', 2), '^[A-Z]') then 'class' else 'function' end as type from ends"""
)
def parsed_nodes(spark, sf_dir):
    nodes = P.generated_graph(spark, sf_dir).nodes
    return nodes.join(_named(nodes), "id").select(F.col("qname").alias("name"), "type")


def _gen_functions(spark, sf_dir, prefix: str) -> DataFrame:
    return P.generated_graph(spark, sf_dir).nodes.filter(F.col("label").startswith(prefix) & (F.col("type") == "function"))


@query(
    f"""with {GEN} select 'supplier_' || s as name, 'def supplier_' || s || '(region: Region' || r || ', amount):' as signature,
    'region:Region' || r || ',amount:' as params, 'region.nation_' || n || '(amount)' as returns from supp"""
)
def func_signature(spark, sf_dir):
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["annotation"], F.lit("")))), ",")
    returns = F.array_join("data_flows.returns", ",")
    return _gen_functions(spark, sf_dir, "supplier_").select(F.col("label").alias("name"), "signature", params.alias("params"), returns.alias("returns"))


@query(
    """select 'customer_' || c_custkey as name, 'if order > ' || c_custkey as conditions, 1 as branches, 'ValueError(''order'')' as raises,
    'nation:7,8;order:5' as parameter_lines, 'nations.nation_' || c_nationkey || '.Nation' || c_nationkey as external_deps, 0 as caller_count from customer"""
)
def func_conditions(spark, sf_dir):
    lines = F.array_join(
        F.transform(F.array_sort(F.map_entries("data_flows.parameter_usage")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda x: x.cast("string")), ","))), ";"
    )
    said = F.array_join(F.transform("conditions", lambda c: F.concat(c["type"], F.lit(" "), c["condition"])), ",")
    return _gen_functions(spark, sf_dir, "customer_").select(
        F.col("label").alias("name"), said.alias("conditions"), "branches", F.array_join("raises", ",").alias("raises"), lines.alias("parameter_lines"),
        F.array_join("external_deps", ",").alias("external_deps"), "caller_count",
    )


@query(
    """select 'Nation' || n_nationkey as name, 'Region' || n_regionkey as bases, 'code' as attributes from nation
    union all select 'Region' || r_regionkey, 'Base', '' from region union all select 'Base', '', 'name,size'"""
)
def class_attributes(spark, sf_dir):
    classes = P.generated_graph(spark, sf_dir).nodes.filter("type = 'class'")
    return classes.select(F.col("label").alias("name"), F.array_join("bases", ",").alias("bases"), F.array_join("attributes", ",").alias("attributes"))


@query("select 'regions/region_' || r_regionkey || '.py' as path, 'REGION=' || r_regionkey as constants from region")
def file_constants(spark, sf_dir):
    # constants are facts of one file: no other file's names, and no edges, are needed
    files = P.generated_modules(spark, sf_dir).filter("size(constants) > 0")
    return files.select("path", F.array_join(F.transform(F.map_entries("constants"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("constants"))


@query(
    f"""with {GEN}, asserted as (select 'test_supplier_' || s as name, 'supplier_' || s || '(None, 1)' as patterns from supp
    union all select distinct 'test_all_of_' || n, '' from supp) select name, patterns from asserted"""
)
def assert_patterns(spark, sf_dir):
    tests = P.generated_graph(spark, sf_dir).nodes.filter("type = 'test_function'")
    return tests.select(F.col("label").alias("name"), F.array_join("assert_patterns", ",").alias("patterns"))


@query(
    f"""with {GEN}, calls as (select target, count(*) as n from gedges where relation = 'calls' group by target)
    select 'supplier_' || s as name, n::int as caller_count from supp join calls on target = 'nations/nation_' || supp.n || '.py::supplier_' || s""".replace(
        "n::int", "calls.n::int"
    )
)
def generated_call_context(spark, sf_dir):
    return _gen_functions(spark, sf_dir, "supplier_").select(F.col("label").alias("name"), "caller_count")


@query(
    f"""with {GEN}, meta as (select (1 + (select count(*) from region) + (select count(*) from nation) + (select count(distinct n) from supp) + (select count(*) from customer))::bigint as n)
    select 'gen/demo' as repo, 'c1' as base_commit, n as file_count, n as parsed_count, 1 as schema_version from meta"""
)
def graph_meta(spark, sf_dir):
    return P.generated_graph(spark, sf_dir).meta.select("repo", "base_commit", "file_count", "parsed_count", "schema_version")


# --- diffs, contexts, documents: one instance for each supplier


@query("select s_suppkey::varchar as instance_id, 'supplier_' || s_suppkey as name, cast(null as varchar) as enclosing_class from supplier")
def changed_defs(spark, sf_dir):
    return diffs.changed_definitions(P.generated_diffs(spark, sf_dir))


@query("select n_nationkey, 'nation_' || n_nationkey as function_name, 'Region' || n_regionkey as class_name from nation")
def hunk_headers(spark, sf_dir):
    head = F.lit("@@ -1,2 +1,2 @@ ")
    nation = P.table(spark, sf_dir, "nation")
    function = F.concat(head, F.lit("async def nation_"), "n_nationkey", F.lit("(self):"))
    cls = F.concat(head, F.lit("class Region"), "n_regionkey", F.lit("(Base):"))
    return nation.select("n_nationkey", diffs.header_function(function).alias("function_name"), diffs.header_class(cls).alias("class_name"))


@query(f"with {GEN} select s::varchar as instance_id, 'nations/nation_' || n || '.py::supplier_' || s as name from supp")
def seed_nodes(spark, sf_dir):
    graph = P.generated_graph(spark, sf_dir)
    return seeds_of(P.generated_diffs(spark, sf_dir), graph.nodes).join(_named(graph.nodes), "id").select("instance_id", F.col("qname").alias("name"))


def _contexts(spark, sf_dir, instance_id: str | None = None, stored: bool = True):
    graph, instances = P.generated_graph(spark, sf_dir), P.generated_diffs(spark, sf_dir)
    return graph, extract_contexts(graph.nodes, graph.edges, instances if instance_id is None else instances.filter(F.col("instance_id") == instance_id), stored=stored)


CONTEXT = f"""{GEN},
chosen as (select * from gedges where relation in ('accesses', 'calls', 'contains', 'inherits', 'tests', 'uses')),
hops as (select source as a, target as b from chosen union select target, source from chosen),
starts as (select s::varchar as instance_id, 'nations/nation_' || n || '.py::supplier_' || s as name from supp),
one as (select instance_id, b as name from starts join hops on a = name),
near as (select * from starts union select * from one),
two as (select instance_id, b as name from one join hops on a = name),
linked as (select instance_id, c.* from near join chosen c on c.source = name union select instance_id, c.* from near join chosen c on c.target = name),
imported as (select instance_id, e.* from starts join gedges e on e.source = name and e.relation in ('depends_on', 'module_depends_on')),
inside as (select * from near union select * from two union select instance_id, target from imported)"""


@query(f"with {CONTEXT} select i.instance_id, i.name, case when s.name is null then 'context' else 'seed' end as role from inside i left join starts s on s.instance_id = i.instance_id and s.name = i.name union all select l.instance_id, l.source, 'test' from linked l join starts s on s.instance_id = l.instance_id and s.name = l.target where l.relation = 'tests'")
def context_nodes(spark, sf_dir):
    graph, contexts = _contexts(spark, sf_dir, stored=False)
    return contexts.nodes.join(_named(graph.nodes), "id").select("instance_id", F.col("qname").alias("name"), "role")


@query(f"with {CONTEXT} select instance_id, source, target, relation from linked union all select instance_id, source, target, relation from imported")
def context_edges(spark, sf_dir):
    graph, names = P.generated_graph(spark, sf_dir), _named(P.generated_graph(spark, sf_dir).nodes)
    # names are joined to the graph's edges, of which there are far fewer than of all contexts'
    named = graph.edges.join(names.select(F.col("id").alias("source"), F.col("qname").alias("s")), "source").join(names.select(F.col("id").alias("target"), F.col("qname").alias("t")), "target")
    contexts = extract_contexts(graph.nodes, materialize(named, "named-edges"), P.generated_diffs(spark, sf_dir), stored=False)
    return contexts.edges.select("instance_id", F.col("s").alias("source"), F.col("t").alias("target"), "relation")


@query(f"with {CONTEXT} select l.instance_id, l.source as name from linked l join starts s on s.instance_id = l.instance_id and s.name = l.target where l.relation = 'tests'")
def seed_tests(spark, sf_dir):
    graph, contexts = _contexts(spark, sf_dir, stored=False)
    return contexts.role("test").join(_named(graph.nodes), "id").select("instance_id", F.col("qname").alias("name"))


@query(
    f"""with {GEN} select s::varchar as instance_id, 'callers' as section, unnest(['test_all_of_' || n, 'test_supplier_' || s]) as name from supp
    union all select s::varchar, 'callees', 'nation_' || n from supp
    union all select s::varchar, 'existing_tests', unnest(['test_all_of_' || n, 'test_supplier_' || s]) from supp
    union all select s::varchar, 'seed', 'supplier_' || s from supp"""
)
def prompt_sections(spark, sf_dir):
    docs = document.documents(_contexts(spark, sf_dir)[1])
    part = lambda section, names: F.transform(names, lambda n: F.struct(F.lit(section).alias("section"), n.alias("name")))
    rows = [part(s, F.col(f"context.{s}.name")) for s in ("callers", "callees", "related", "sibling_methods", "existing_tests")]
    # one reading of the documents for all sections: each more is all their joins once more
    return docs.select("instance_id", F.explode(F.concat(*rows, part("seed", F.array("seed.function_name")))).alias("row")).select("instance_id", "row.section", "row.name")


@query(
    f"""with {GEN} select s::varchar as instance_id, 'supplier_' || s as function_name, 'nations.nation_' || n as module,
    'def supplier_' || s || '(region: Region' || r || ', amount):' as signature, 4 as coverage_targets from supp"""
)
def prompt_json(spark, sf_dir):
    """Fields read back from the JSON of the documents."""
    docs = serialize(_contexts(spark, sf_dir)[1])
    seed = lambda f: F.get_json_object("json", f"$.seed.{f}").alias(f)
    targets = F.json_array_length(F.get_json_object("json", "$.instructions.coverage_targets")).alias("coverage_targets")
    return docs.select("instance_id", seed("function_name"), seed("module"), seed("signature"), targets)


@query(f"with {CONTEXT} select instance_id, relation, count(*) as n from (select instance_id, source, target, relation from linked union all select instance_id, source, target, relation from imported) group by all")
def context_histogram(spark, sf_dir):
    return _contexts(spark, sf_dir, stored=False)[1].edge_histogram()


@query(
    f"""with {CONTEXT} select s.instance_id, 1::bigint as num_seeds, (select count(*) from inside i where i.instance_id = s.instance_id) - 1 as num_context_nodes,
    (select count(*) from linked l where l.instance_id = s.instance_id) + (select count(*) from imported m where m.instance_id = s.instance_id) as num_edges, 2::bigint as num_test_nodes
    from starts s"""
)
def context_counts(spark, sf_dir):
    return _contexts(spark, sf_dir, stored=False)[1].counts().select("instance_id", "num_seeds", "num_context_nodes", "num_edges", "num_test_nodes")


# --- names that several classes have, factories, local types, handlers, docstrings

EXTRAS = """
extra as (select n_nationkey as n, 'extras/extra_' || n_nationkey || '.py' as f, 'stubs/nation_' || n_nationkey || '.py::Nation' || n_nationkey as stub from nation)"""


@query(
    f"""with {EXTRAS}
    select f || '::Keeper' || n || '.fill' as source, f || '::make_' || n as target, 'calls' as relation, 'exact' as confidence, cast(null as varchar) as source_tool from extra
    union all select f || '::make_' || n, unnest([stub, stub || '.build']), 'calls', 'qualified', null from extra
    union all select k.f || '::Keeper' || k.n, t.f || '::Twin', unnest(['inherits', 'uses']), case when (select count(*) from extra) = 1 then 'exact' else 'ambiguous' end, null from extra k, extra t
    union all select f || '::Keeper' || n, stub, 'uses', 'exact', 'pyright' from extra"""
)
def extra_edges(spark, sf_dir):
    graph = P.extra_graph(spark, sf_dir)
    names = _named(graph.nodes)
    edges = graph.edges.filter("relation in ('calls', 'inherits', 'uses', 'accesses', 'overrides')")
    ends = edges.join(names.select(F.col("id").alias("source"), F.col("qname").alias("s")), "source").join(names.select(F.col("id").alias("target"), F.col("qname").alias("t")), "target")
    return ends.select(F.col("s").alias("source"), F.col("t").alias("target"), "relation", "confidence", "source_tool")


@query(
    f"""with {EXTRAS}
    select f || '::Keeper' || n || '.fill' as name, 'Fill keeper ' || n || '.' as docstring, '' as catches, 'self.seen' as return_types, 'count' as writes, 'count=item' as changes from extra
    union all select f || '::Keeper' || n || '.twin', null, '', 'Twin()', '', '' from extra
    union all select f || '::Other' || n || '.fill', null, '', 'bool', '', '' from extra
    union all select f || '::make_' || n, 'Make nation ' || n || '.', 'ValueError', 'None,built', '', '' from extra
    union all select f || '::Twin.__init__', null, '', '', 'seen', 'seen=0' from extra"""
)
def extra_functions(spark, sf_dir):
    nodes = P.extra_graph(spark, sf_dir).nodes.filter("filepath like 'extras/%' and type in ('function', 'method')")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    changes = F.array_join(F.transform(F.map_entries("data_flows.mutates_attributes"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ",")
    return nodes.join(_named(nodes), "id").select(
        F.col("qname").alias("name"), "docstring", text("catches").alias("catches"), text("return_types").alias("return_types"), text("side_effects").alias("writes"), changes.alias("changes")
    )


@query(f"select 'extras/extra_' || n_nationkey || '.py' as path, {P.SITE[0]} as line, {P.SITE[1]} as col, 'Keeper' || n_nationkey as owner, 'Nation' || n_nationkey as type_name from nation")
def factory_sites(spark, sf_dir):
    """Assignments from factories, with what a type checker says of them."""
    found = parse.sites(parse.parse_files(P.extra_files(spark, sf_dir), max_lines=None)).join(P.extra_types(spark, sf_dir), ["repo", "commit", "path", "line", "col"])
    owners = P.extra_graph(spark, sf_dir).nodes.select(F.col("id").alias("source_id"), F.col("label").alias("owner"))
    return found.join(owners, "source_id").select("path", "line", "col", "owner", F.col("type").alias("type_name"))


@query(f"with {EXTRAS} select n::varchar as instance_id, f || '::Keeper' || n || '.fill' as name from extra")
def settled_seeds(spark, sf_dir):
    """Of two methods of one name in a file, the one in the class that the diff shows."""
    nodes = P.extra_graph(spark, sf_dir).nodes
    return seeds_of(P.extra_diffs(spark, sf_dir), nodes).join(_named(nodes), "id").select("instance_id", F.col("qname").alias("name"))


# --- stored graphs and contexts, read back


@query(f"with {GEN} select relation, coalesce(confidence, '') as confidence, count(*) as n from gedges group by all")
def stored_graph(spark, sf_dir):
    folder = new_path(spark, "stored")
    store.save_graph(P.generated_graph(spark, sf_dir), folder)
    loaded = store.load_graph(spark, folder, P.REPO, P.COMMIT)
    return loaded.edges.groupBy("relation", F.coalesce("confidence", F.lit("")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def _scratch_file(spark, label: str) -> Path:
    """A place for files that the driver writes itself, in the shared folder where that is a plain one."""
    return Path(new_path(spark, label).removeprefix("file://").removeprefix("file:"))


@query(
    f"""with {EXTRAS} select 'Twin' as label, 'class' as type, '' as docstring, count(*) as n from extra
    union all select 'Keeper' || n, 'class', '', 1 from extra union all select 'Other' || n, 'class', '', 1 from extra
    union all select 'make_' || n, 'function', 'Make nation ' || n || '.', 1 from extra union all select 'fill', 'method', 'Fill keeper ' || n || '.', 1 from extra
    union all select 'fill', 'method', '', count(*) from extra union all select 'twin', 'method', '', count(*) from extra union all select '__init__', 'method', '', count(*) from extra"""
)
def exported_graph(spark, sf_dir):
    """The graph as JSON documents, read back."""
    folder = _scratch_file(spark, "json")
    store.export_graph_json(P.extra_graph(spark, sf_dir), str(folder))
    nodes = store.import_graph_json(spark, folder.as_uri(), P.REPO, P.COMMIT).nodes.filter("filepath like 'extras/%'")
    return nodes.groupBy("label", "type", F.coalesce("docstring", F.lit("")).alias("docstring")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {CONTEXT}, asked as (select * from starts where instance_id = '1')
    select 'seed' as role, name from asked
    union all select 'context', i.name from inside i join asked s using (instance_id) where i.name <> s.name
    union all select 'test', l.source from linked l join asked s on s.instance_id = l.instance_id and s.name = l.target where l.relation = 'tests'"""
)
def stored_context(spark, sf_dir):
    graph, contexts = _contexts(spark, sf_dir, "1")  # contexts don't depend on each other
    path = _scratch_file(spark, "context") / "context.json"
    store.save_context(contexts, "1", str(path))
    return store.load_context(spark, path.as_uri()).nodes.join(_named(graph.nodes), "id").select("role", F.col("qname").alias("name"))
