"""The engine's own queries over the driver tables, each with DuckDB SQL that gives the same rows.

Queries apply an operator to graphs and programs derived from the tables (see sources.tables); ids come out as bigint
or text, sets as one row an element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import lowering
from pointweave.functions.context import POLICIES, CallString, NoContext, label
from pointweave.operators import changes, delta, fixpoint, hierarchy, lookups, rules, scc, stats, verify
from pointweave.plans import assemble, outline, pointsto
from pointweave.program import Program
from pointweave.schema import KINDS
from pointweave.sources import scope, tables
from pointweave.storage import shared_path, written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def cte(*names: str) -> str:
    return ", ".join(f'"{n}" as ({tables.SQL[n]})' for n in names)


_memo: dict = {}


def _once(spark, d: str, what: str, names: tuple[str, ...], make):
    """What several queries look at is computed once for each application and state of the tables it comes from; it lies
    in the shared folder."""
    key = (spark.sparkContext.applicationId, what, tables.fingerprint(spark, d, *names))
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


# --- points-to sets over the layered supply graph ----------------------------------------------------------------------

_SUPPLY = f"with recursive {cte('supply_seed', 'supply_edge')}, pts(node, heap) as (select node, heap from supply_seed union select dst, heap from pts join supply_edge on src = node)"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return fixpoint.points_to(written(tables.frame(spark, d, "supply_edge"), "edge"), tables.frame(spark, d, "supply_seed"))


@query(f"{_SUPPLY} select node, heap from pts")
def pts_supply(spark, d):
    return _supply(spark, d)


@query(f"{_SUPPLY} select count(distinct node) as nodes, count(*) as total from pts")
def pts_size_stats(spark, d):
    return stats.set_statistics(_supply(spark, d))


@query(f"{_SUPPLY} select node, count(*) as size from pts group by node")
def pts_sizes(spark, d):
    return stats.sizes(_supply(spark, d))


@query(f"{_SUPPLY} select node, string_agg(cast(heap as varchar), ',' order by cast(heap as varchar)) as text from pts group by node")
def pts_grouped(spark, d):
    return lookups.joined_text(_supply(spark, d), "node", "heap")


# --- cycles: the token-transition graph -------------------------------------------------------------------------------

_TOKENS = f"""with recursive {cte('token_edge')}, nodes as (select src node from token_edge union select dst from token_edge),
reach(src, dst) as (select src, dst from token_edge union select r.src, e.dst from reach r join token_edge e on e.src = r.dst),
scc as (select n.node, least(n.node, coalesce(min(a.dst), n.node)) rep from nodes n
  left join (select x.src, x.dst from reach x join reach y on y.src = x.dst and y.dst = x.src) a on a.src = n.node group by n.node),
cond as (select distinct a.rep src_rep, b.rep dst_rep from token_edge join scc a on a.node = src join scc b on b.node = dst where a.rep <> b.rep)"""


def _tokens(spark, d) -> DataFrame:
    return written(tables.frame(spark, d, "token_edge"), "edge")


@query(f"{_TOKENS} select src, dst from reach")
def reach_tokens(spark, d):
    return fixpoint.closure(_tokens(spark, d))


@query(f"{_TOKENS} select distinct dst as node from reach where src = (select min(src) from token_edge) union select min(src) from token_edge")
def reach_from_least(spark, d):
    edge = _tokens(spark, d)
    return fixpoint.reachable(edge, edge.agg(F.min("src").alias("node")).where("node is not null"))


@query(f"{_TOKENS} select node, rep from scc")
def scc_tokens(spark, d):
    return scc.components(_tokens(spark, d))


@query(f"{_TOKENS} select rep, count(*) as size from scc group by rep")
def scc_sizes(spark, d):
    return scc.components(_tokens(spark, d)).groupBy("rep").agg(F.count("node").alias("size"))


@query(f"{_TOKENS} select src_rep, dst_rep from cond")
def condensation_tokens(spark, d):
    edge = _tokens(spark, d)
    return scc.condensation(edge, scc.components(edge))


@query(f"{_TOKENS} select dst_rep as src_rep, src_rep as dst_rep from cond")
def condensation_reverse(spark, d):
    return scc.reverse(condensation_tokens(spark, d))


@query(f"{_TOKENS}, p(node, heap) as (select distinct src, src from token_edge union select dst, heap from p join token_edge on src = node) select node, heap from p")
def pts_condensed(spark, d):
    edge = _tokens(spark, d)
    return fixpoint.points_to_condensed(edge, edge.select(F.col("src").alias("node"), F.col("src").alias("heap")).distinct())


# --- change logs ------------------------------------------------------------------------------------------------------

#: Changes up to this share of the log's sequence numbers build the first state, the others are applied to it.
_CUT = "(select min(seq) + (max(seq) - min(seq)) * 6 // 10 from change)"


def _net(where: str) -> str:
    return f"(select src, dst from (select src, dst, op, row_number() over (partition by src, dst order by seq desc) rn from change where {where}) x where rn = 1 and op = 'add' and src <> dst)"


_LOG = f"""with recursive {cte('change')}, early as {_net(f'seq <= {_CUT}')}, late as {_net('true')},
lastop as (select src, dst, op from (select src, dst, op, row_number() over (partition by src, dst order by seq desc) rn from change where seq > {_CUT} and src <> dst) x where rn = 1),
seeds as (select distinct src node, src heap from change),
p0(node, heap) as (select node, heap from seeds union select dst, heap from p0 join early on src = node),
p1(node, heap) as (select node, heap from seeds union select dst, heap from p1 join late on src = node)"""


def _log(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes before the cut and after it, without self-edges, and seeds."""
    log = written(tables.frame(spark, d, "change"), "change")
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    cut = (low or 0) + ((high or 0) - (low or 0)) * 6 // 10
    seeds = log.select(F.col("src").alias("node"), F.col("src").alias("heap")).distinct()
    log = log.where("src <> dst")
    return log.where(F.col("seq") <= cut), log.where(F.col("seq") > cut), written(seeds, "seed")


def _evolved(spark, d, components: bool = False):
    def make():
        early, late, seeds = _log(spark, d)
        state = delta.start(lookups.net_edges(early), seeds, components)
        return state, *delta.apply_changes(state, late)

    return _once(spark, d, f"evolved-{components}", ("events",), make)


@query(f"{_LOG} select src, dst from late")
def net_edges(spark, d):
    return lookups.net_edges(tables.frame(spark, d, "change"))


@query(f"{_LOG} select src, dst from lastop where op = 'add' except select src, dst from early")
def edge_add_novel(spark, d):
    early, late, _ = _log(spark, d)
    return lookups.insert(lookups.net_edges(early), lookups.net_changes(late).where("op = 'add'").select("src", "dst"))[1]


@query(f"{_LOG} select src, dst from lastop where op = 'del' intersect select src, dst from early")
def edge_delete_existing(spark, d):
    early, late, _ = _log(spark, d)
    return lookups.delete(lookups.net_edges(early), lookups.net_changes(late).where("op = 'del'").select("src", "dst"))[1]


@query(f"{_LOG} select node, heap from p1")
def pts_after_changes(spark, d):
    return _evolved(spark, d)[1].pts


@query(f"{_LOG} select distinct node from ((select * from p0 except select * from p1) union (select * from p1 except select * from p0))")
def affected_after_changes(spark, d):
    return _evolved(spark, d)[2]


@query(
    f"{_LOG}, reach(src, dst) as (select src, dst from late union select r.src, e.dst from reach r join late e on e.src = r.dst), "
    "nodes as (select src node from change where src <> dst union select dst from change where src <> dst union select node from seeds) "
    "select n.node, least(n.node, coalesce(min(a.dst), n.node)) as rep from nodes n left join (select x.src, x.dst from reach x join reach y on y.src = x.dst and y.dst = x.src) a on a.src = n.node group by n.node"
)
def scc_after_changes(spark, d):
    _, after, _ = _evolved(spark, d, components=True)
    known = tables.frame(spark, d, "change").where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return known.unionByName(after.nodes).distinct().join(after.scc, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))


@query(f"{_LOG} select 'missing' as kind, node, heap from p1 where false")
def invariant_violations(spark, d):
    """The sets after the changes: no offending row."""
    _, after, _ = _evolved(spark, d, components=True)
    return verify.component_violations(after.edge, after.scc, after.seed, after.pts)


@query(
    f"{_LOG}, bad as (select node, heap from p1 where node <> heap union select max(node), -1 from p1), derived as (select distinct dst node, heap from bad join late on src = node) "
    "select 'missing' as kind, * from (select * from derived except select * from bad) union all select 'extra', * from (select * from bad except select * from derived except select * from seeds)"
)
def invariant_of_damaged_sets(spark, d):
    """The sets without what nodes hold by themselves, and with a row from nowhere: what the invariant finds."""
    _, after, _ = _evolved(spark, d, components=True)
    nowhere = after.pts.agg(F.max("node").alias("node")).select("node", F.lit(-1).cast("bigint").alias("heap"))
    return verify.union_violations(after.edge, after.seed, after.pts.where("node <> heap").unionByName(nowhere))


@query(
    f"{_LOG}, fewer as (select * from early where src > dst), p2(node, heap) as (select node, heap from seeds union select dst, heap from p2 join fewer on src = node) "
    "select 'lost' as step, * from (select * from p0 except select * from p2) union all select 'differs', node, heap from p0 where false"
)
def roundtrip_diff(spark, d):
    """The edges to greater nodes deleted together, and added again: what goes, and what differs in the end."""
    early, _, seeds = _log(spark, d)
    state = delta.start(lookups.net_edges(early), seeds)
    there = state.edge.where("src < dst")
    without, _ = delta.apply_changes(state, there.select(F.lit(0).cast("bigint").alias("seq"), F.lit("del").alias("op"), "src", "dst"))
    lost = lookups.difference(state.pts, without.pts).select(F.lit("lost").alias("step"), "node", "heap")
    return lost.unionByName(verify.round_trip(state, there)[1].select(F.lit("differs").alias("step"), "node", "heap"))


#: Of the token graph, for each edge what is derived without it; p only meets nodes of the edge's own user.
_EACH = f"""{_TOKENS}, held as (select distinct src node from token_edge), whole(node, heap) as (select node, node from held union select dst, heap from whole join token_edge on src = node),
each(s, t, node, heap) as (select src, dst, node, node from token_edge join held on node // 100 = src // 100 union select s, t, e.dst, heap from each join token_edge e on e.src = node and not (e.src = s and e.dst = t)),
lost as (select concat(src, '>', dst) id, w.node, w.heap from token_edge join whole w on w.node // 100 = src // 100 left join each x on x.s = src and x.t = dst and x.node = w.node and x.heap = w.heap where x.s is null)"""


def _each_edge(spark, d):
    edge = _tokens(spark, d)
    state = delta.start(edge, edge.select(F.col("src").alias("node"), F.col("src").alias("heap")).distinct())
    return state, edge.select(F.concat_ws(">", "src", "dst").alias("id"), "src", "dst")


@query(f"{_EACH} select distinct id, node from lost")
def affected_by_each_edge(spark, d):
    """The nodes whose sets change when an edge is deleted, for every edge of the token graph on its own."""
    state, groups = _each_edge(spark, d)
    return delta.what_if(state.edge, state.seed, state.pts, groups).select("id", "node").distinct()


@query(f"{_EACH} select id, count(*) as lost, cast(0 as bigint) as differ from lost group by id")
def roundtrip_each_edge(spark, d):
    state, groups = _each_edge(spark, d)
    return verify.round_trips(state, groups)


@query(
    f"{_TOKENS}, ends as (select min(src) lo, max(src) hi from token_edge), held as (select distinct src node from token_edge), "
    "p(node, heap) as (select node, node from held union select dst, heap from p join token_edge on src = node), "
    "q(node, heap) as (select node, heap from p union select dst, heap from q join (select * from token_edge union select hi, lo from ends) on src = node), "
    "r(node, heap) as (select node, node from held union select dst, heap from r join (select * from token_edge where src <> (select lo from ends)) on src = node) "
    "select 'points_to' as call, heap as value from p, ends where node = lo union all select 'edges', dst from token_edge, ends where src = lo "
    "union all select 'add_edge', heap from q, ends where node = lo "
    "union all select 'add_edge affects', node from (select distinct node from (select * from q except select * from p)) "
    "union all select 'delete_edge', heap from (select distinct heap from (select heap from p, ends where node = lo))"
)
def state_calls(spark, d):
    """The calls of a state: one node's set and successors, an edge added and taken away again."""
    state, _ = _each_edge(spark, d)
    lo, hi = state.edge.agg(F.min("src"), F.max("src")).first()
    said = lambda df, call, column: df.select(F.lit(call).alias("call"), F.col(column).alias("value"))
    more, touched = delta.add_edge(state, hi, lo)
    back, _ = delta.delete_edge(more, hi, lo)
    out = said(state.points_to(lo), "points_to", "heap").unionByName(said(state.edges(lo), "edges", "dst"))
    out = out.unionByName(said(more.points_to(lo), "add_edge", "heap")).unionByName(said(touched, "add_edge affects", "node"))
    return out.unionByName(said(back.points_to(lo), "delete_edge", "heap"))


@query(f"{_TOKENS}, p(node, heap) as (select distinct src, src from token_edge union select dst, heap from p join token_edge on src = node) select node, heap from p")
def pts_by_representative(spark, d):
    """Sets kept for representatives alone, copied out to all members, in a snapshot."""
    edge = _tokens(spark, d)
    found = written(scc.components(edge), "scc")
    seeds = edge.select(F.col("src").alias("node"), F.col("src").alias("heap")).distinct()
    lifted = seeds.join(found, "node").select(F.col("rep").alias("node"), "heap").distinct()
    return verify.snapshot(verify.expanded(found, fixpoint.points_to(scc.condensation(edge, found).toDF("src", "dst"), lifted)))


@query(
    f"{_TOKENS}, back as (select dst_rep src_rep, src_rep dst_rep from cond where src_rep <> (select max(src_rep) from cond)) "
    "select src_rep, dst_rep from cond where src_rep = (select max(src_rep) from cond)"
)
def inverse_violations(spark, d):
    """Of the condensation and a reverse that lacks the edges of one component: the edges that only one of the two has."""
    cond = written(condensation_tokens(spark, d), "condensation")
    last = cond.agg(F.max("src_rep").alias("src_rep"))
    return verify.inverse_violations(cond, scc.reverse(cond.join(last, "src_rep", "left_anti")))


@query(f"{_TOKENS} select node, rep from scc")
def scc_by_rounds(spark, d):
    """The components by trimming and colouring, as for graphs that no task can hold."""
    return scc.components(_tokens(spark, d), local_edges=0)


@query("select * from (values (0, ''), (1, 'round trip of each change'), (2, 'round trip of each change; union invariant after each change; arity of calls'), (3, 'round trip of each change; union invariant after each change; arity of calls; names of changes')) t(level, checks)")
def checks_by_level(spark, d):
    return spark.createDataFrame([(n, "; ".join(verify.checks(n))) for n in range(4)], "level int, checks string")


@query(
    "select event_type as op, count(*) as n, cast(sum(floor(value * 100)) as bigint) as total_ms, avg(cast(floor(value * 100) as bigint)) as mean_ms, cast(max(floor(value * 100)) as bigint) as max_ms, cast(min(floor(value * 100)) as bigint) as min_ms "
    "from events where value > 5 group by event_type"
)
def time_statistics(spark, d):
    """Of changes that affected a node; here of events, whose values stand for times and, in fives, for nodes affected."""
    ms = F.floor(F.col("value") * 100).cast("bigint")
    timings = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("op"), ms.alias("ms"), F.when(F.col("value") > 5, F.floor(F.col("value") / 5)).otherwise(0).alias("affected"))
    return stats.time_statistics(timings)


@query(f"{_LOG}, line as (select concat(src, ' -> {{', string_agg(cast(dst as varchar), ', ' order by cast(dst as varchar)), '}}') line from late group by src union all select concat(node, ' => {{', string_agg(cast(heap as varchar), ', ' order by cast(heap as varchar)), '}}') from p1 group by node) select line from line")
def graph_lines(spark, d):
    """The graph and sets after the changes as text."""
    _, after, _ = _evolved(spark, d)
    return scope.graph_text(after.edge, after.pts)


# --- scopes -----------------------------------------------------------------------------------------------------------


def _file(spark, lines: DataFrame, name: str) -> str:
    """The lines as a text file in the shared folder."""
    path = shared_path(spark, name)
    lines.select(F.concat_ws(",", *lines.columns)).write.text(path)
    return path


@query("select case when n_regionkey = 0 then 'Primordial' else 'Application' end as loader, 'Java' as language, case when n_nationkey % 2 = 0 then 'jarFile' else 'classFile' end as kind, concat('lib/', n_name) as path from nation")
def scope_files(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "jarFile").otherwise("classFile")
    lines = n.select(F.when(F.col("n_regionkey") == 0, "Primordial").otherwise("Application").alias("a"), F.lit("Java").alias("b"), kind.alias("c"), F.concat(F.lit("lib/"), "n_name").alias("d"))
    return scope.read_scope(spark, _file(spark, lines, "scope"))


@query(
    "with c as (select concat('org.n', c_nationkey, '.', lower(c_mktsegment), '.C', c_custkey) as name from customer) "
    "select name from c where not regexp_full_match(replace(name, '.', '/'), 'org/n1[0-9]/.*') and not regexp_full_match(replace(name, '.', '/'), '.*/machinery/C.*5')"
)
def classes_in_scope(spark, d):
    """Class names less those that an exclusion list names."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("org.n"), F.col("c_nationkey").cast("string"), F.lit("."), F.lower("c_mktsegment"), F.lit(".C"), F.col("c_custkey").cast("string")).alias("name"))
    path = shared_path(spark, "exclusions")
    spark.createDataFrame([("org/n1[0-9]/.*",), ("",), (" .*/machinery/C.*5 ",)], "line string").write.text(path)
    return scope.excluded(c, scope.read_exclusions(spark, path))


@query("select lower(r_name) as key, concat('/opt/', r_regionkey) as value from region")
def runtime_settings(spark, d):
    r = spark.read.parquet(f"{d}/region.parquet")
    path = shared_path(spark, "settings")
    note = spark.createDataFrame([("# where things are",), ("",)], "line string")
    note.unionByName(r.select(F.concat(F.lower("r_name"), F.lit(" = /opt/"), F.col("r_regionkey").cast("string")).alias("line"))).write.text(path)
    return spark.createDataFrame(list(scope.read_settings(spark, path).items()), "key string, value string")


@query(f"with {cte('function')} select fn_id from function where name_id in (select n_nationkey from nation)")
def entry_functions(spark, d):
    functions = tables.frame(spark, d, "function").select("fn_id", F.col("name_id").alias("method_id"))
    return scope.entry_functions(functions, spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("method_id")))


@query("select concat('scope', s_nationkey, '.txt') as scope, concat('Lorg/S', s_suppkey) as main_class from supplier")
def scope_catalog(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lines = s.select(F.concat(F.lit("scope"), F.col("s_nationkey").cast("string"), F.lit(".txt")).alias("a"), F.concat(F.lit("Lorg/S"), F.col("s_suppkey").cast("string")).alias("b"))
    return scope.catalog(spark, _file(spark, lines, "catalog"))


@query(f"{_LOG} select src, dst from early where src in (select node from seeds)")
def successors_of_seeds(spark, d):
    early, _, seeds = _log(spark, d)
    return lookups.successors(lookups.net_edges(early), seeds)


@query(
    f"{_LOG} select 'union' as op, count(*) as n from (select * from early union select * from late) union all "
    "select 'difference', count(*) from (select * from early except select * from late) union all select 'intersection', count(*) from (select * from early intersect select * from late)"
)
def set_operations(spark, d):
    early, late, _ = _log(spark, d)
    a, b = written(lookups.net_edges(early), "a"), written(lookups.net_edges(early.unionByName(late)), "b")
    made = {"union": lookups.union_sets(a, b), "difference": lookups.difference(a, b), "intersection": lookups.intersection(a, b)}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- hierarchy, contexts ----------------------------------------------------------------------------------------------

_HIER = f"""{cte('class', 'function')}, method as (select class_id, name_id selector, max(fn_id) fn_id from function where not is_static group by class_id, name_id),
anc(class_id, ancestor, depth) as (select class_id, class_id, cast(0 as bigint) from class union select a.class_id, c.super_id, a.depth + 1 from anc a join class c on c.class_id = a.ancestor where c.super_id is not null),
resolved as (select a.class_id, m.selector, arg_min(m.fn_id, a.depth) fn_id from anc a join method m on m.class_id = a.ancestor group by 1, 2)"""


@query(f"with recursive {_HIER} select class_id, ancestor, depth from anc")
def class_ancestors(spark, d):
    return fixpoint.ancestors(tables.frame(spark, d, "class"))


@query(f"with recursive {_HIER} select class_id, selector, fn_id from resolved")
def method_resolve(spark, d):
    return hierarchy.resolve(tables.frame(spark, d, "class"), hierarchy.methods(tables.frame(spark, d, "function")))


@query(f"with {cte('function')} select name_id as method, max(fn_id) as fn_id from function where is_static group by name_id")
def static_lookup(spark, d):
    return hierarchy.static_functions(tables.frame(spark, d, "function"))


def _merged(policy):
    def run(spark, d):
        f = tables.frame(spark, d, "function")
        grown = policy.merge(policy.merge(policy.initial(F.col("fn_id")), F.col("name_id")), F.col("class_id"))
        return f.select("fn_id", label(policy.initial(F.col("fn_id"))).alias("initial"), label(policy.merge(policy.initial(F.col("fn_id")), F.col("name_id"))).alias("once"), label(grown).alias("twice"))

    return run


for _n, _policy in enumerate(POLICIES):
    QUERIES[f"context_merge_{_n}"] = _merged(_policy)
    _grown = {0: "''", 1: "cast(name_id as varchar)"}.get(_n, "concat(fn_id, '.', name_id)")
    _twice = {0: "''", 1: "cast(class_id as varchar)", 2: "concat(name_id, '.', class_id)", 3: "concat(fn_id, '.', name_id, '.', class_id)"}[_n]
    _first = "''" if _n == 0 else "cast(fn_id as varchar)"
    ORACLES[f"context_merge_{_n}"] = f'with {cte("function")} select fn_id, {_first} as initial, {_grown} as once, {_twice} as twice from function'


# --- lowering ---------------------------------------------------------------------------------------------------------

_SSA = f"with {cte('raw_instr', 'ssa')}, types as (select distinct concat('T', s_suppkey % 30) type_name from supplier where s_suppkey % 30 < 25)"
_V = "concat(fn_id, '#', {0})".format
_VIRTUAL = "(is_dispatch or (is_special and not contains(signature, '<init>') and not contains(signature, '<clinit>')))"
_DEF = f"case when def_id is null then null else {_V('def_id')} end"


def _lowered(pick, columns: list[str], sql: str):
    def run(spark, d):
        types = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 30 < 25").select(F.concat(F.lit("T"), (F.col("s_suppkey") % 30).cast("string")).alias("type_name")).distinct()
        out = pick(tables.ssa(spark, d), types)
        cols = [F.array_join("args", ",").alias("args") if c == "args" else F.col(c) for c in columns]
        return out.select("fn_id", "pos", *cols)

    return run, f"{_SSA} {sql}"


for _name, _pick, _columns, _sql in (
    ("lower_array_load", lambda s, t: lowering.array_loads(s), ["target", "source", "field"], f"select fn_id, pos, {_DEF} as target, {_V('use0')} as source, 'array' as field from ssa where op = 'array_load' and not is_primitive"),
    ("lower_array_store", lambda s, t: lowering.array_stores(s), ["target", "source", "field"], f"select fn_id, pos, {_V('use0')} as target, {_V('use1')} as source, 'array' as field from ssa where op = 'array_store' and not is_primitive"),
    ("lower_return", lambda s, t: lowering.returns(s), ["source"], f"select fn_id, pos, {_V('use0')} as source from ssa where op = 'return' and not is_primitive and use1 % 7 <> 0"),
    ("lower_vcall", lambda s, t: lowering.virtual_calls(s), ["target", "source", "method", "args"], f"select fn_id, pos, {_DEF} as target, {_V('use0')} as source, selector as method, {_V('use1')} as args from ssa where op = 'invoke' and {_VIRTUAL}"),
    ("lower_scall", lambda s, t: lowering.static_calls(s), ["target", "method", "args"], f"select fn_id, pos, {_DEF} as target, signature as method, concat({_V('use0')}, ',', {_V('use1')}) as args from ssa where op = 'invoke' and not {_VIRTUAL}"),
    (
        "lower_get_field", lambda s, t: lowering.get_fields(s), ["kind", "target", "source", "field"],
        f"select fn_id, pos, case when is_static then 'assign' else 'load' end as kind, {_DEF} as target, case when is_static then concat('static:', field) else {_V('use0')} end as source, case when is_static then null else field end as field from ssa where op = 'get_field'",
    ),
    (
        "lower_put_field", lambda s, t: lowering.put_fields(s), ["kind", "target", "source", "field"],
        f"select fn_id, pos, case when is_static then 'assign' else 'store' end as kind, case when is_static then concat('static:', field) else {_V('use0')} end as target, case when is_static then {_V('use0')} else {_V('use1')} end as source, case when is_static then null else field end as field from ssa where op = 'put_field'",
    ),
    ("lower_copy", lambda s, t: lowering.casts(s), ["target", "source"], f"select fn_id, pos, {_DEF} as target, {_V('use0')} as source from ssa where op in ('check_cast', 'pi')"),
    ("lower_phi_explode", lambda s, t: lowering.phis(s), ["target", "source"], f"select fn_id, pos, {_DEF} as target, {_V('use0')} as source from ssa where op = 'phi' union all select fn_id, pos, {_DEF}, {_V('use1')} from ssa where op = 'phi'"),
    ("lower_alloc", lambda s, t: lowering.allocations(s, t), ["target", "type_name"], f"select fn_id, pos, {_DEF} as target, type_name from ssa where op = 'new' and type_name in (select type_name from types)"),
    ("lower_metadata", lambda s, t: lowering.metadata(s), ["target", "source"], f"select fn_id, pos, {_DEF} as target, concat('tok:', token) as source from ssa where op = 'metadata'"),
):
    QUERIES[_name], ORACLES[_name] = _lowered(_pick, _columns, _sql)


@query(
    f"{_SSA}, l as (select case when op = 'invoke' then case when {_VIRTUAL} then 'vcall' else 'scall' end when op in ('check_cast', 'pi', 'metadata') then 'assign' when op = 'phi' then 'assign' when op = 'new' then 'alloc' "
    "when op = 'return' then 'return' when op = 'array_load' then 'load' when op = 'array_store' then 'store' when is_static then 'assign' when op = 'get_field' then 'load' else 'store' end kind, case when op = 'phi' then 2 else 1 end n "
    "from ssa where op <> 'throw' and not (op in ('array_load', 'array_store', 'return') and is_primitive) and not (op = 'return' and use1 % 7 = 0) and not (op = 'new' and type_name not in (select type_name from types))) "
    "select kind, cast(sum(n) as bigint) as n from l group by kind"
)
def lower_all(spark, d):
    types = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 30 < 25").select(F.concat(F.lit("T"), (F.col("s_suppkey") % 30).cast("string")).alias("type_name")).distinct()
    return lowering.lower(tables.ssa(spark, d), types).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"with {cte('function')} select fn_id, case when is_static or contains(s, '<init>') then s else concat('sel', name_id) end as name, is_static or contains(s, '<init>') as is_static "
    "from (select *, concat('C', class_id, case when fn_id % 11 = 0 then '.<init>' else '.m' end, name_id) s from function)"
)
def lower_functions(spark, d):
    f = tables.frame(spark, d, "function")
    signature = F.concat(F.lit("C"), F.col("class_id").cast("string"), F.when(F.col("fn_id") % 11 == 0, F.lit(".<init>")).otherwise(F.lit(".m")), F.col("name_id").cast("string"))
    return lowering.lower_functions(f.select("fn_id", signature.alias("signature"), F.concat(F.lit("sel"), F.col("name_id").cast("string")).alias("selector"), F.col("is_static").alias("static_flag")))


@query(f"with {cte('function')} select fn_id, cast(i as int) as pos, cast(i + 1 as int) as ssa, concat('f', fn_id, '::param', i) as name from function, unnest(range(0, fn_id % 4)) t(i)")
def lower_parameters(spark, d):
    f = tables.frame(spark, d, "function")
    return lowering.parameters(f.select("fn_id", F.concat(F.lit("f"), F.col("fn_id").cast("string")).alias("signature"), (F.col("fn_id") % 4).alias("n_params")))


# --- graph rules over the derived program, all functions without contexts ---------------------------------------------

_INSTR = f"""{cte('raw_instr')}, instr as (select row_number() over (order by f, k, pk, sk) instr_id, f fn_id, k, f * 100 + pk % 20 target, f * 100 + (pk * 7 + sk) % 20 source, sk % 4 field,
  1000 + sk class_id, static_callee, pk % 5 selector from raw_instr)"""
_RULES = f"with recursive {_HIER}, {_INSTR}, static_fn as (select name_id, max(fn_id) fn_id from function where is_static group by name_id), ret as (select fn_id, source from instr where k = 7), every_method as (select distinct selector, fn_id from resolved)"


def _all_functions(spark, d):
    p = tables.program(spark, d, raw="raw_instr")
    return p, p.functions.select("fn_id", F.array().cast("array<bigint>").alias("ctx"))


@query(f"{_RULES} select concat('H', instr_id) as src, concat('V', target) as dst from instr where k = 1")
def rule_alloc_edges(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.alloc_edges(p.instr, reach)


@query(f"{_RULES} select distinct concat('V', source) as src, concat('V', target) as dst from instr where k = 2")
def rule_assign_edges(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.assign_edges(p.instr, reach).distinct()


@query(f"{_RULES} select distinct concat('F', source, '.', field) as src, concat('V', target) as dst from instr where k = 4")
def rule_load_edges(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.load_edges(p.instr, reach).distinct()


@query(f"{_RULES} select distinct concat('V', source) as src, concat('F', target, '.', field) as dst from instr where k = 3")
def rule_store_edges(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.store_edges(p.instr, reach).distinct()


@query(f"{_RULES} select distinct concat('V', case when i = 0 then source else target end) as src, concat('V', s.fn_id * 100 + i) as dst from instr join static_fn s on s.name_id = static_callee, (values (0), (1)) t(i) where k = 5")
def rule_static_arg_edges(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.static_argument_edges(rules.static_calls(p.instr, reach, p.static_functions(), NoContext()), p.params).distinct()


@query(f"{_RULES} select distinct concat('V', i.target) as src, concat('V', r.source) as dst from instr i join static_fn s on s.name_id = static_callee join ret r on r.fn_id = s.fn_id where k = 5")
def rule_static_return_edges(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.static_return_edges(rules.static_calls(p.instr, reach, p.static_functions(), NoContext()), p.instr).distinct()


@query(f"{_RULES} select distinct concat('V', r.source) as src, concat('V', i.target) as dst from instr i join static_fn s on s.name_id = static_callee join ret r on r.fn_id = s.fn_id where k = 5")
def rule_static_return_edges_corrected(spark, d):
    p, reach = _all_functions(spark, d)
    return rules.static_return_edges(rules.static_calls(p.instr, reach, p.static_functions(), NoContext()), p.instr, "corrected").distinct()


def _by_hierarchy(spark, d):
    p, reach = _all_functions(spark, d)
    return p, rules.bind_by_hierarchy(rules.virtual_sites(p.instr, reach), p.resolved(), NoContext())


@query(f"{_RULES} select distinct concat('V', source) as src, concat('V', m.fn_id * 100 + i) as dst from instr join every_method m using (selector), (values (0), (1)) t(i) where k = 6")
def rule_virtual_arg_edges_cha(spark, d):
    p, calls = _by_hierarchy(spark, d)
    return rules.virtual_argument_edges(calls, p.params).distinct()


@query(f"{_RULES} select distinct concat('V', r.source) as src, concat('V', i.target) as dst from instr i join every_method m using (selector) join ret r on r.fn_id = m.fn_id where k = 6")
def rule_virtual_return_edges_cha(spark, d):
    p, calls = _by_hierarchy(spark, d)
    return rules.virtual_return_edges(calls, p.instr).distinct()


@query(f"{_RULES} select i.instr_id, m.fn_id from instr i join every_method m using (selector) where k = 6 and 2 < 2 + m.fn_id % 4 - 1")
def arity_violations(spark, d):
    """Calls pass two values; a method takes two to five, and may do without its last one."""
    p, calls = _by_hierarchy(spark, d)
    more = p.functions.where("fn_id % 4 > 0").select("fn_id", F.explode(F.sequence(F.lit(2), (F.col("fn_id") % 4 + 1).cast("int"))).alias("pos")).withColumn("var_id", F.lit(-1).cast("bigint"))
    sized = calls.select("instr_id", F.col("callee").alias("fn_id"), F.size("args").cast("bigint").alias("n_args"))
    return hierarchy.arity_errors(sized, p.params.unionByName(more))


# --- whole programs ---------------------------------------------------------------------------------------------------


def _edges_sql(reach: str) -> str:
    """Context-free edges of the functions in reach, but for virtual calls."""
    return f"""select concat('H', instr_id) s, concat('V', target) t from instr where k = 1 and fn_id in ({reach})
  union select concat('V', source), concat('V', target) from instr where k = 2 and fn_id in ({reach})
  union select concat('V', source), concat('F', target, '.', field) from instr where k = 3 and fn_id in ({reach})
  union select concat('F', source, '.', field), concat('V', target) from instr where k = 4 and fn_id in ({reach})
  union select concat('V', case when i = 0 then source else target end), concat('V', s.fn_id * 100 + i) from instr join static_fn s on s.name_id = static_callee, (values (0), (1)) v(i) where k = 5 and instr.fn_id in ({reach})
  union select concat('V', i.target), concat('V', r.source) from instr i join static_fn s on s.name_id = static_callee join ret r on r.fn_id = s.fn_id where k = 5 and i.fn_id in ({reach})"""


#: One relation for the mutual recursion: F reached functions, P points-to rows, C bindings (call site, callee).
_SPARSE = _RULES.replace(tables.SQL["raw_instr"], tables.SQL["raw_program"])
_PROGRAM = f"""{_SPARSE},
fedge as (select i.fn_id f, s.fn_id g from instr i join static_fn s on s.name_id = static_callee where k = 5),
halloc as (select concat('H', instr_id) h, fn_id f, concat('V', target) v, class_id from instr where k = 1),
hclass as (select h, r.selector, r.fn_id g from halloc a join resolved r on r.class_id = a.class_id),
pedge as (select fn_id f, concat('V', source) s, concat('V', target) t from instr where k = 2
  union select fn_id, concat('V', source), concat('F', target, '.', field) from instr where k = 3
  union select fn_id, concat('F', source, '.', field), concat('V', target) from instr where k = 4
  union select i.fn_id, concat('V', case when n = 0 then source else target end), concat('V', s.fn_id * 100 + n) from instr i join static_fn s on s.name_id = static_callee, (values (0), (1)) v(n) where k = 5
  union select i.fn_id, concat('V', i.target), concat('V', r.source) from instr i join static_fn s on s.name_id = static_callee join ret r on r.fn_id = s.fn_id where k = 5
  union select f, h, v from halloc),
vsite as (select instr_id, fn_id f, concat('V', source) recv, concat('V', target) tgt, selector from instr where k = 6),
vedge as (select v.instr_id i, m.fn_id g, recv s, concat('V', m.fn_id * 100 + n) t from vsite v join every_method m using (selector), (values (0), (1)) x(n)
  union select v.instr_id, m.fn_id, concat('V', r.source), tgt from vsite v join every_method m using (selector) join ret r on r.fn_id = m.fn_id),
t(k, a, b) as (
  select 'F', cast(fn_id as varchar), '' from function
  union (
    select 'F', cast(e.g as varchar), '' from t x join fedge e on x.k = 'F' and x.a = cast(e.f as varchar)
    union select 'F', x.b, '' from t x where x.k = 'C'
    union select 'P', h, h from t x join halloc on x.k = 'F' and x.a = cast(f as varchar)
    union select 'P', e.t, y.b from t x join pedge e on x.k = 'F' and x.a = cast(e.f as varchar) join recurring.t y on y.k = 'P' and y.a = e.s
    union select 'P', e.t, x.b from t x join pedge e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'F' and y.a = cast(e.f as varchar)
    union select 'P', e.t, y.b from t x join vedge e on x.k = 'C' and x.a = cast(e.i as varchar) and x.b = cast(e.g as varchar) join recurring.t y on y.k = 'P' and y.a = e.s
    union select 'P', e.t, x.b from t x join vedge e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'C' and y.a = cast(e.i as varchar) and y.b = cast(e.g as varchar)
    union select 'C', cast(v.instr_id as varchar), cast(c.g as varchar) from t x join vsite v on x.k = 'F' and x.a = cast(v.f as varchar) join recurring.t y on y.k = 'P' and y.a = v.recv join hclass c on c.h = y.b and c.selector = v.selector
    union select 'C', cast(v.instr_id as varchar), cast(c.g as varchar) from t x join vsite v on x.k = 'P' and x.a = v.recv join hclass c on c.h = x.b and c.selector = v.selector join recurring.t y on y.k = 'F' and y.a = cast(v.f as varchar)))"""


@query(f"{_SPARSE}, fedge as (select i.fn_id f, s.fn_id g from instr i join static_fn s on s.name_id = static_callee where k = 5), r(fn_id) as (select fn_id from function where fn_id < 40 union select g from r join fedge on f = fn_id) select fn_id from r")
def reachable_functions(spark, d):
    """From the functions below 40."""
    return pointsto.reachable_functions(tables.program(spark, d, entries=40)).select("fn_id")


@query(
    f"{_SPARSE}, fedge as (select i.fn_id f, s.fn_id g from instr i join static_fn s on s.name_id = static_callee where k = 5 union select i.fn_id, m.fn_id from instr i join every_method m using (selector) where k = 6), "
    "r(fn_id) as (select fn_id from function where fn_id < 40 union select g from r join fedge on f = fn_id) select fn_id from r"
)
def reachable_by_hierarchy(spark, d):
    """From the functions below 40, virtual calls bound to every method of their selector."""
    return pointsto.reachable_by_hierarchy(tables.program(spark, d, entries=40)).select("fn_id")


_PROGRAM_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def _program(spark, d):
    return _once(spark, d, "program", _PROGRAM_TABLES, lambda: tables.program(spark, d))


def _built(spark, d, policy=POLICIES[0], profile: str = "reference"):
    p = _program(spark, d)
    return p, _once(spark, d, f"analysis-{policy.label}-{profile}", _PROGRAM_TABLES, lambda: pointsto.build(p, policy, profile))


def _outlined(spark, d, policy=POLICIES[0]):
    """reach and the summed sizes of the reference profile, from the program without what stays inside its functions."""
    return _once(spark, d, f"outlined-{policy.label}", _PROGRAM_TABLES, lambda: outline.build(_program(spark, d), policy))


@query(f"{_PROGRAM} select cast(a as bigint) as instr_id, cast(b as bigint) as callee from t where k = 'C'")
def call_graph_on_the_fly(spark, d):
    return _built(spark, d)[1].calls.select("instr_id", "callee")


@query(f"{_PROGRAM} select a as node, b as heap from t where k = 'P'")
def pts_program(spark, d):
    return _built(spark, d)[1].pts


@query(f"{_PROGRAM}, reached as (select cast(a as bigint) fn_id from t where k = 'F') {_edges_sql('select fn_id from reached')} union select e.s, e.t from vedge e join t on t.k = 'C' and t.a = cast(e.i as varchar) and t.b = cast(e.g as varchar)".replace(" s, concat('V', target) t from instr where k = 1", " as src, concat('V', target) as dst from instr where k = 1"))
def edges_program(spark, d):
    return _built(spark, d)[1].edge


def _affected(kind: str):
    def run(spark, d):
        return changes.edges_of_kind(_program(spark, d), kind, lambda: _built(spark, d)[1])

    return run


_REACHED = f"{_PROGRAM}, reached as (select cast(a as bigint) fn_id from t where k = 'F'), alledge as ({_edges_sql('select fn_id from reached')} union select e.s, e.t from vedge e join t on t.k = 'C' and t.a = cast(e.i as varchar) and t.b = cast(e.g as varchar))"
for _name, _cand in (
    ("assign", "select instr_id, concat('V', source) s, concat('V', target) t from instr where k = 2"),
    ("alloc", "select instr_id, concat('H', instr_id) s, concat('V', target) t from instr where k = 1"),
    ("store", "select instr_id, concat('V', source) s, concat('F', target, '.', field) t from instr where k = 3"),
    ("load", "select instr_id, concat('F', source, '.', field) s, concat('V', target) t from instr where k = 4"),
    (
        "scall",
        "select instr_id, concat('V', case when n = 0 then source else target end) s, concat('V', s.fn_id * 100 + n) t from instr join static_fn s on s.name_id = static_callee, (values (0), (1)) v(n) where k = 5 "
        "union select instr_id, concat('V', i.target), concat('V', r.source) from instr i join static_fn s on s.name_id = static_callee join ret r on r.fn_id = s.fn_id where k = 5",
    ),
    (
        "vcall",
        "select v.instr_id, v.recv s, concat('V', cast(t.b as bigint) * 100 + n) t from vsite v join t on t.k = 'C' and t.a = cast(v.instr_id as varchar), (values (0), (1)) x(n) "
        "union select v.instr_id, tgt, concat('V', r.source) from vsite v join t on t.k = 'C' and t.a = cast(v.instr_id as varchar) join ret r on t.b = cast(r.fn_id as varchar)",
    ),
):
    QUERIES[f"affected_edges_{_name}"] = _affected(_name)
    ORACLES[f"affected_edges_{_name}"] = f"{_REACHED}, cand as ({_cand}) select distinct c.instr_id, c.s as src, c.t as dst from cand c join alledge e on e.s = c.s and e.t = c.t"


_EVERY = " union all ".join(f"select '{_k}' as kind, count(*) as n from ({ORACLES[f'affected_edges_{_k}'].rpartition('), cand as (')[2].partition(') select distinct')[0]}) c where exists (select 1 from alledge e where e.s = c.s and e.t = c.t)" for _k in ("alloc", "assign", "store", "load", "scall", "vcall"))


@query(f"{_REACHED} {_EVERY} union all select 'return', 0")
def affected_edge_counts(spark, d):
    """How many edges the instructions of each kind stand for; returns stand for none."""
    p, made = _built(spark, d)
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    found = changes.affected_edges(p, made, p.instr).join(p.instr.select("instr_id", "kind"), "instr_id")
    return kinds.join(found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query(f"with {cte('raw_program', 'class', 'function')} select 'classes' as relation, count(*) as n from class union all select 'functions', count(*) from function union all select 'params', 2 * count(*) from function union all select 'instr', count(*) from raw_program union all select 'entries', count(*) from function")
def program_relations(spark, d):
    """The program written to the shared folder and read back: rows of each relation."""
    path = shared_path(spark, "program")
    _program(spark, d).write_parquet(path)
    back = Program.read_parquet(spark, path)
    out = [getattr(back, name).agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n")) for name in ("classes", "functions", "params", "instr", "entries")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query(f"{_PROGRAM} select concat('policy=No context nodes=', count(distinct a), ' total=', count(*)) as line from t where k = 'P'")
def stats_lines(spark, d):
    return scope.stats_text(stats.by_policy({NoContext.label: _outlined(spark, d).summed}))


@query(f"{_PROGRAM} select 'No context' as policy, count(distinct a) as nodes, count(*) as total from t where k = 'P'")
def stats_no_context(spark, d):
    return stats.by_policy({NoContext.label: _outlined(spark, d).summed})


def _contexts(n: int, profile: str = "reference") -> str:
    """As _PROGRAM, with contexts: a call string of n names as text after an @, in column c; nodes in a are without."""
    merge = (lambda c, x: "''") if n == 0 else (lambda c, x: f"concat('@', array_to_string(list_append(string_split(substr({c}, 2), '.'), cast({x} as varchar))[-{n}:], '.'))")
    of_callee = "" if profile == "reference" else f"""
    union select 'P', e.t, y.b, {merge("x.c", "e.m")} from t x join sarg e on x.k = 'F' and x.a = cast(e.f as varchar) join recurring.t y on y.k = 'P' and y.a = e.s and y.c = x.c
    union select 'P', e.t, x.b, {merge("x.c", "e.m")} from t x join sarg e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'F' and y.a = cast(e.f as varchar) and y.c = x.c
    union select 'P', e.t, y.b, x.c from t x join sret e on x.k = 'F' and x.a = cast(e.f as varchar) join recurring.t y on y.k = 'P' and y.a = e.s and y.c = {merge("x.c", "e.m")}
    union select 'P', e.t, x.b, y.c from t x join sret e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'F' and y.a = cast(e.f as varchar) and {merge("y.c", "e.m")} = x.c"""
    in_caller = "" if profile != "reference" else """
  union select f, s, t from sarg
  union select f, t, s from sret"""
    return f"""{_SPARSE},
scalls as (select i.fn_id f, s.fn_id g, static_callee m, target, source from instr i join static_fn s on s.name_id = static_callee where k = 5),
fedge as (select distinct f, g, m from scalls),
sarg as (select f, m, concat('V', case when n = 0 then source else target end) s, concat('V', g * 100 + n) t from scalls, (values (0), (1)) v(n)),
sret as (select f, m, concat('V', r.source) s, concat('V', c.target) t from scalls c join ret r on r.fn_id = g),
halloc as (select concat('H', instr_id) h, fn_id f, concat('V', target) v, class_id from instr where k = 1),
hclass as (select h, r.selector, r.fn_id g from halloc a join resolved r on r.class_id = a.class_id),
pedge as (select fn_id f, concat('V', source) s, concat('V', target) t from instr where k = 2
  union select fn_id, concat('V', source), concat('F', target, '.', field) from instr where k = 3
  union select fn_id, concat('F', source, '.', field), concat('V', target) from instr where k = 4{in_caller}
  union select f, h, v from halloc),
vsite as (select instr_id, fn_id f, concat('V', source) recv, concat('V', target) tgt, selector from instr where k = 6),
varg as (select v.instr_id i, m.fn_id g, recv s, concat('V', m.fn_id * 100 + n) t, selector from vsite v join every_method m using (selector), (values (0), (1)) x(n)),
vret as (select v.instr_id i, m.fn_id g, concat('V', r.source) s, tgt t, selector from vsite v join every_method m using (selector) join ret r on r.fn_id = m.fn_id),
t(k, a, b, c) as (
  select 'F', cast(fn_id as varchar), '', {"''" if n == 0 else "concat('@', name_id)"} from function
  union (
    select 'F', cast(e.g as varchar), '', {merge("x.c", "e.m")} from t x join fedge e on x.k = 'F' and x.a = cast(e.f as varchar)
    union select 'F', x.b, '', {merge("x.c", "v.selector")} from t x join vsite v on x.k = 'C' and x.a = cast(v.instr_id as varchar)
    union select 'P', h, concat(h, x.c), x.c from t x join halloc on x.k = 'F' and x.a = cast(f as varchar)
    union select 'P', e.t, y.b, x.c from t x join pedge e on x.k = 'F' and x.a = cast(e.f as varchar) join recurring.t y on y.k = 'P' and y.a = e.s and y.c = x.c
    union select 'P', e.t, x.b, x.c from t x join pedge e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'F' and y.a = cast(e.f as varchar) and y.c = x.c{of_callee}
    union select 'P', e.t, y.b, {merge("x.c", "e.selector")} from t x join varg e on x.k = 'C' and x.a = cast(e.i as varchar) and x.b = cast(e.g as varchar) join recurring.t y on y.k = 'P' and y.a = e.s and y.c = x.c
    union select 'P', e.t, x.b, {merge("x.c", "e.selector")} from t x join varg e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'C' and y.a = cast(e.i as varchar) and y.b = cast(e.g as varchar) and y.c = x.c
    union select 'P', e.t, y.b, x.c from t x join vret e on x.k = 'C' and x.a = cast(e.i as varchar) and x.b = cast(e.g as varchar) join recurring.t y on y.k = 'P' and y.a = e.s and y.c = {merge("x.c", "e.selector")}
    union select 'P', e.t, x.b, y.c from t x join vret e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'C' and y.a = cast(e.i as varchar) and y.b = cast(e.g as varchar) and {merge("y.c", "e.selector")} = x.c
    union select 'C', cast(v.instr_id as varchar), cast(h.g as varchar), x.c from t x join vsite v on x.k = 'F' and x.a = cast(v.f as varchar) join recurring.t y on y.k = 'P' and y.a = v.recv and y.c = x.c join hclass h on h.h = split_part(y.b, '@', 1) and h.selector = v.selector
    union select 'C', cast(v.instr_id as varchar), cast(h.g as varchar), x.c from t x join vsite v on x.k = 'P' and x.a = v.recv join hclass h on h.h = split_part(x.b, '@', 1) and h.selector = v.selector join recurring.t y on y.k = 'F' and y.a = cast(v.f as varchar) and y.c = x.c))"""


_COUNTED = "{0} select '{1}' as policy, count(distinct concat(a, c)) as nodes, count(*) as total from t where k = 'P'"


def _stats_of(policy):
    return lambda spark, d: stats.by_policy({policy.label: _outlined(spark, d, policy).summed})


for _n, _policy in enumerate(POLICIES[1:], 1):
    QUERIES[f"stats_{_n}_context"], ORACLES[f"stats_{_n}_context"] = _stats_of(_policy), _COUNTED.format(_contexts(_n), _policy.label)


@query(" union all ".join(f"select * from ({_COUNTED.format(_contexts(n), policy.label)})" for n, policy in enumerate(POLICIES)))
def stats_by_policy(spark, d):
    return stats.by_policy({policy.label: _outlined(spark, d, policy).summed for policy in POLICIES})


@query(f"{_contexts(2, 'corrected')} select concat(a, c) as node, b as heap from t where k = 'P'")
def pts_program_corrected_2_context(spark, d):
    return _built(spark, d, CallString(2), "corrected")[1].pts


@query(f"{_contexts(2)} select distinct cast(a as bigint) as fn_id, substr(c, 2) as ctx from t where k = 'F'")
def reach_program_2_context(spark, d):
    return _outlined(spark, d, CallString(2)).reach.select("fn_id", label(F.col("ctx")).alias("ctx"))


@query(
    f"{_contexts(1)}, node as (select distinct a, c from t where k = 'F'), e as (select f, s, t from pedge), "
    "u as (select f, s, c from e join node on a = cast(f as varchar) union select f, t, c from e join node on a = cast(f as varchar) "
    "union select vsite.f, varg.s, x.c from t x join varg on x.k = 'C' and x.a = cast(varg.i as varchar) and x.b = cast(varg.g as varchar) join vsite on vsite.instr_id = varg.i "
    "union select varg.g, varg.t, concat('@', varg.selector) from t x join varg on x.k = 'C' and x.a = cast(varg.i as varchar) and x.b = cast(varg.g as varchar) "
    "union select vret.g, vret.s, concat('@', vret.selector) from t x join vret on x.k = 'C' and x.a = cast(vret.i as varchar) and x.b = cast(vret.g as varchar) "
    "union select vsite.f, vret.t, x.c from t x join vret on x.k = 'C' and x.a = cast(vret.i as varchar) and x.b = cast(vret.g as varchar) join vsite on vsite.instr_id = vret.i), "
    "used as (select fn_id, target v from instr union select fn_id, source from instr where k <> 1 union select fn_id, fn_id * 100 + n from function, (values (0), (1)) p(n)) "
    "select distinct used.v as var_id, substr(node.c, 2) as ctx from used join node on node.a = cast(used.fn_id as varchar) join u on u.s = concat('V', used.v) and u.c = node.c"
)
def variable_contexts(spark, d):
    p, made = _built(spark, d, CallString(1))
    return pointsto.contexts_of_nodes(p, made).select("var_id", label(F.col("ctx")).alias("ctx"))


# --- from SSA form to sets --------------------------------------------------------------------------------------------

_V0, _V1 = _V("use0"), _V("use1")
_FROM_SSA = f"""with recursive {cte('raw_instr', 'ssa', 'ssa_function', 'ssa_class')},
low as (select distinct * from (
  select fn_id, pos, 'load' kind, {_DEF} target, {_V0} source, 'array' field, null type_name, null method, null a0, null a1 from ssa where op = 'array_load' and not is_primitive
  union all select fn_id, pos, 'store', {_V0}, {_V1}, 'array', null, null, null, null from ssa where op = 'array_store' and not is_primitive
  union all select fn_id, pos, 'return', null, {_V0}, null, null, null, null, null from ssa where op = 'return' and not is_primitive and use1 % 7 <> 0
  union all select fn_id, pos, 'vcall', {_DEF}, {_V0}, null, null, selector, {_V0}, {_V1} from ssa where op = 'invoke' and {_VIRTUAL}
  union all select fn_id, pos, 'scall', {_DEF}, null, null, null, signature, {_V0}, {_V1} from ssa where op = 'invoke' and not {_VIRTUAL}
  union all select fn_id, pos, case when is_static then 'assign' else 'load' end, {_DEF}, case when is_static then concat('static:', field) else {_V0} end, case when is_static then null else field end, null, null, null, null from ssa where op = 'get_field'
  union all select fn_id, pos, case when is_static then 'assign' else 'store' end, case when is_static then concat('static:', field) else {_V0} end, case when is_static then {_V0} else {_V1} end, case when is_static then null else field end, null, null, null, null from ssa where op = 'put_field'
  union all select fn_id, pos, 'assign', {_DEF}, {_V0}, null, null, null, null, null from ssa where op in ('check_cast', 'pi', 'phi')
  union all select fn_id, pos, 'assign', {_DEF}, {_V1}, null, null, null, null, null from ssa where op = 'phi'
  union all select fn_id, pos, 'alloc', {_DEF}, null, null, type_name, null, null, null from ssa where op = 'new' and type_name in (select name from ssa_class)
  union all select fn_id, pos, 'assign', {_DEF}, concat('tok:', token), null, null, null, null, null from ssa where op = 'metadata') l),
named as (select fn_id, static_flag or contains(signature, '<init>') is_static, case when static_flag or contains(signature, '<init>') then signature else selector end name, class_name from ssa_function),
static_of as (select name, max(fn_id) fn_id from named where is_static group by name),
method_of as (select class_name, name, max(fn_id) fn_id from named where not is_static group by class_name, name),
up(name, ancestor, depth) as (select name, name, 0 from ssa_class union select u.name, c.super_name, depth + 1 from up u join ssa_class c on c.name = u.ancestor where c.super_name is not null),
found as (select u.name class_name, m.name, arg_min(m.fn_id, depth) fn_id from up u join method_of m on m.class_name = u.ancestor group by 1, 2),
heap as (select fn_id f, concat(fn_id, '@', pos, ':', target, ':', type_name) h, target v, type_name from low where kind = 'alloc'),
par as (select fn_id, i, concat(fn_id, '#', i + 1) v from ssa_function, (values (0), (1)) x(i)),
ret as (select fn_id, source from low where kind = 'return'),
fedge as (select distinct l.fn_id f, s.fn_id g from low l join static_of s on s.name = l.method where kind = 'scall'),
pedge as (select fn_id f, source s, target t from low where kind = 'assign' union select fn_id, source, concat(target, '.', field) from low where kind = 'store'
  union select fn_id, concat(source, '.', field), target from low where kind = 'load' union select f, h, v from heap
  union select l.fn_id, case when i = 0 then a0 else a1 end, p.v from low l join static_of s on s.name = l.method join par p on p.fn_id = s.fn_id where kind = 'scall'
  union select l.fn_id, l.target, r.source from low l join static_of s on s.name = l.method join ret r on r.fn_id = s.fn_id where kind = 'scall' and l.target is not null),
vsite as (select row_number() over () i, * from (select distinct fn_id f, source recv, target tgt, method, a0, a1 from low where kind = 'vcall') x),
vedge as (select i, m.fn_id g, case when p.i_ = 0 then a0 else a1 end s, p.v t from vsite join (select distinct name, fn_id from found) m on m.name = method join (select fn_id, i i_, v from par) p on p.fn_id = m.fn_id
  union select i, m.fn_id, r.source, tgt from vsite join (select distinct name, fn_id from found) m on m.name = method join ret r on r.fn_id = m.fn_id where tgt is not null),
t(k, a, b) as (
  select 'F', cast(fn_id as varchar), '' from ssa_function where fn_id < 100
  union (
    select 'F', cast(e.g as varchar), '' from t x join fedge e on x.k = 'F' and x.a = cast(e.f as varchar)
    union select 'F', x.b, '' from t x where x.k = 'C'
    union select 'P', h, h from t x join heap on x.k = 'F' and x.a = cast(f as varchar)
    union select 'P', e.t, y.b from t x join pedge e on x.k = 'F' and x.a = cast(e.f as varchar) join recurring.t y on y.k = 'P' and y.a = e.s
    union select 'P', e.t, x.b from t x join pedge e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'F' and y.a = cast(e.f as varchar)
    union select 'P', e.t, y.b from t x join vedge e on x.k = 'C' and x.a = cast(e.i as varchar) and x.b = cast(e.g as varchar) join recurring.t y on y.k = 'P' and y.a = e.s
    union select 'P', e.t, x.b from t x join vedge e on x.k = 'P' and x.a = e.s join recurring.t y on y.k = 'C' and y.a = cast(e.i as varchar) and y.b = cast(e.g as varchar)
    union select 'C', cast(v.i as varchar), cast(c.fn_id as varchar) from t x join vsite v on x.k = 'F' and x.a = cast(v.f as varchar) join recurring.t y on y.k = 'P' and y.a = v.recv join heap h on h.h = y.b join found c on c.class_name = h.type_name and c.name = v.method
    union select 'C', cast(v.i as varchar), cast(c.fn_id as varchar) from t x join vsite v on x.k = 'P' and x.a = v.recv join heap h on h.h = x.b join found c on c.class_name = h.type_name and c.name = v.method join recurring.t y on y.k = 'F' and y.a = cast(v.f as varchar)))"""


def _from_ssa(spark, d):
    def make():
        functions, classes = tables.frame(spark, d, "ssa_function"), tables.frame(spark, d, "ssa_class")
        types = classes.select(F.col("name").alias("type_name"))
        lowered = lowering.lower(tables.ssa(spark, d), types)
        held = functions.select("fn_id", "class_name").join(lowering.lower_functions(functions), "fn_id")
        params = lowering.parameters(functions.select("fn_id", "signature", F.lit(2).alias("n_params")))
        return assemble.assemble(lowered, held, params, classes, functions.where("fn_id < 100").select("fn_id"))

    return _once(spark, d, "from-ssa", _PROGRAM_TABLES, make)


@query(f"{_FROM_SSA} select a as node, b as heap from t where k = 'P'")
def pts_from_ssa(spark, d):
    """Instructions in SSA form lowered, their names numbered, the program analysed, and its sets named again."""
    program, known, instr = _from_ssa(spark, d)
    return assemble.named(pointsto.build(program).pts, known, instr)


@query(f"{_FROM_SSA} select 'variable' as space, count(*) as n from (select target from low where target is not null union select source from low where source is not null union select a0 from low where a0 is not null union select a1 from low where a1 is not null union select v from par) x "
       "union all select 'field', count(distinct field) from low union all select 'class', count(*) from (select type_name from low where type_name is not null union select class_name from named union select name from ssa_class) x "
       "union all select 'method', count(*) from (select method from low where method is not null union select name from named) x")  # fmt: skip
def interned_names(spark, d):
    return _from_ssa(spark, d)[1].groupBy("space").agg(F.count(F.lit(1)).alias("n"))
