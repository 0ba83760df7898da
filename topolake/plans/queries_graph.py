"""Queries of joins, aggregates and graph operators over the derived datasets, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import element

from ..functions import contracts as K, scalars as X
from ..operators import advice, edges as E, governance, graph as G, linkage as L, merge as M, metrics as T, trend as R
from ..operators.shared import top_by, written
from . import derive as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# contract keys

_ENTRY = "case p_partkey % 6 when 0 then p_type || ' (' || p_name || ')' when 1 then '[Ghost:Read] ' || p_brand || ' (x)' when 2 then 'typing.' || p_type || ' [ ' || p_name || ' ]' when 3 then '[Generic]  list[str]' when 4 then ' None ' else 'Map< ' || p_brand || ' , int > (m)' end"


def _entries(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "part").withColumn("e", F.expr(_ENTRY.replace("'", "'"))).select("p_partkey", "e")


_E = f"x as (select p_partkey, {_ENTRY} as e from part), t as (select *, trim(e) as r from x)"
_TIDY = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '\\s*([<>{{}}()\\[\\]|,:=&?])\\s*', '\\1', 'g')"
_SIG = "case when regexp_matches({0}, '^.*?\\s*\\([^()]+\\)\\s*$') then trim(regexp_extract({0}, '^(.*?)\\s*\\(([^()]+)\\)\\s*$', 1)) else {0} end"


def _n1(name: str, demand: bool) -> str:
    body = _SIG.format("r") if demand else "r"
    value = _TIDY.format(f"regexp_replace(regexp_replace(trim({body}), '(?i)^\\[generic\\]\\s*', ''), '(?i)^typing\\.', '')")
    ghost = "or regexp_matches(r, '(?i)^\\[ghost')" if demand else ""
    return f"with {_E}, v as (select p_partkey, r, {value} as v from t) select p_partkey, case when lower(v) in ('', 'none', 'void', 'null', 'undefined') or regexp_matches(regexp_replace(lower(v), '\\s+', '', 'g'), '{K.GENERIC}') {ghost} then null else v end as key from v"


query("n1_graph_key_demand", _n1("d", True))(lambda s, d: _entries(s, d).select("p_partkey", K.key_graph(F.col("e"), True).alias("key")))
query("n1_graph_key_answer", _n1("a", False))(lambda s, d: _entries(s, d).select("p_partkey", K.key_graph(F.col("e"), False).alias("key")))
query("n2_fanout_key", f"with {_E} select p_partkey, nullif(lower(regexp_replace(regexp_replace(regexp_replace(r, '\\[[^\\]]+\\]', '', 'g'), '\\([^()]*\\)', '', 'g'), '\\s+', ' ', 'g')), '') as key from t")(
    lambda s, d: _entries(s, d).select("p_partkey", K.key_fanout(F.col("e")).alias("key"))
)
query(
    "n3_ghost_key",
    f"with {_E}, b as (select p_partkey, r, case when regexp_matches(r, '(?i)^\\[Ghost:[^\\]]+\\]\\s*.+$') then trim(regexp_extract(r, '(?i)^\\[Ghost:[^\\]]+\\]\\s*(.+)$', 1)) else r end as b from t) "
    "select p_partkey, case when r = '' or lower(r) = 'none' then null else nullif(trim(case when regexp_matches(b, '^.+?\\s*\\(') then regexp_extract(b, '^(.+?)\\s*\\(', 1) else b end), '') end as key from b",
)(lambda s, d: _entries(s, d).select("p_partkey", K.key_ghost(F.col("e")).alias("key")))
query(
    "n4_neighbour_key",
    f"with {_E}, v as (select p_partkey, r, {_TIDY.format(f'trim({_SIG.format('r')})')} as v from t) select p_partkey, case when r = '' or lower(v) in ('none', 'void', 'null', 'undefined') or regexp_matches(regexp_replace(lower(v), '\\s+', '', 'g'), '{K.GENERIC}') or regexp_matches(r, '(?i)^\\[ghost') then null else v end as key from v",
)(lambda s, d: _entries(s, d).select("p_partkey", K.key_neighbour(F.col("e"), True).alias("key")))
query(
    "n5_rollup_key",
    f"with {_E}, b as (select p_partkey, r, trim(regexp_replace(regexp_replace(r, '(?i)^\\[generic\\]\\s*', ''), '(?i)^\\[ghost:[^\\]]+\\]\\s*', '')) as b from t), k as (select *, {_SIG.format('b')} as k from b) "
    f"select p_partkey, case when k = '' or regexp_replace(lower(k), '\\s+', '', 'g') in ({', '.join(repr(K.compact_text(x)) for x in K.IGNORED_TYPES)}) then null else {_TIDY.format("regexp_replace(k, '(?i)^typing\\.', '')")} end as key from k",
)(lambda s, d: _entries(s, d).select("p_partkey", K.key_rollup(F.col("e"), False).alias("key")))


# contract graph

def _edges(s, d, until=None):
    return E.edges_of(D.answers(s, d, until), D.demands(s, d, until))


query("j1_contract_edges", f"with {D.CONTRACTS} select src, dst, contract from edges")(lambda s, d: _edges(s, d))
query("j2_adjacency", f"with {D.CONTRACTS} select distinct src, dst from edges")(lambda s, d: E.adjacency(_edges(s, d)))
query("j3_high_fanout", f"with {D.CONTRACTS} select src as node_id, count(distinct dst) as downstream_count from edges where src <> dst group by src having count(distinct dst) >= 6")(
    lambda s, d: E.fanout_counts(D.answers(s, d), D.demands(s, d), 6)
)
query("j3_fanout_lists", f"with {D.PARTS} select src as node_id, count(distinct dst) as downstream_count, array_to_string(list_sort(list(distinct dst)), ',') as downstream from n_edges where src <> dst group by src having count(distinct dst) >= 2")(
    lambda s, d: E.fanout(E.produced(D.parts(s, d)), E.required(D.parts(s, d)), 2).select("node_id", "downstream_count", F.array_join("downstream", ",").alias("downstream"))
)
query("j4_neighbourhood", f"with {D.CONTRACTS}, p as (select distinct src, dst from edges where src <> dst) select node_id, sum(o)::bigint as outgoing, sum(i)::bigint as incoming from (select src as node_id, 1 as o, 0 as i from p union all select dst, 0, 1 from p) group by node_id")(
    lambda s, d: E.neighbourhood(D.answers(s, d), D.demands(s, d))
)
_DEG = "deg as (select node_id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, (sum(i) + sum(o))::bigint as degree from (select src as node_id, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) group by node_id)"
query("a1_degrees", f"with {D.CONTRACTS}, {_DEG} select * from deg")(lambda s, d: E.degrees(_edges(s, d)))


def _hub_nodes(s, d):
    a, b = D.answers(s, d).select("node_id").distinct(), D.demands(s, d).select("node_id").distinct()
    return a.unionByName(b).withColumn("demand", F.array().cast("array<string>"))


@query("t1_risk_hubs", f"with {D.CONTRACTS}, {_DEG} select node_id, in_degree, out_degree, degree, degree as risk from deg where in_degree >= 5 or out_degree >= 5 or degree >= 8 order by risk desc, node_id limit 80")
def t1(s, d):
    """The riskiest nodes of the contract graph: contracts, equi-join, degrees, top 80."""
    return R.risk(_hub_nodes(s, d), E.degrees(_edges(s, d))).select("node_id", "in_degree", "out_degree", "degree", "risk")


query("t1_risk_parts", f"with {D.PARTS}, {_DEG.replace('from edges', 'from n_edges')}, r as (select node_id, coalesce(in_degree, 0) as in_degree, coalesce(out_degree, 0) as out_degree, coalesce(degree, 0) as degree, ghosts > 0 as ghost, contains(node_id, 'execute') as execute_like from lang left join deg using (node_id)) select *, (degree + ghost::int * 5 + execute_like::int)::bigint as risk from r where ghost or in_degree >= 5 or out_degree >= 5 or degree >= 8 order by risk desc, node_id limit 80")(
    lambda s, d: R.risk(D.parts(s, d), E.degrees(E.contract_edges(D.parts(s, d)))).select("node_id", "in_degree", "out_degree", "degree", "ghost", "execute_like", "risk")
)
query("a14_end_degree", f"with {D.RUNTIME}, {D.RUNTIME_EDGES} select node_id, count(*) as degree, count(*) filter (p) as primary_degree from (select src as node_id, type <> 'reads' as p from re union all select dst, type <> 'reads' from re) group by node_id")(
    lambda s, d: E.end_degree(D.runtime_edges(s, d), F.col("type") != "reads")
)
_MEMBERS = "g as (select distinct node_id, split_part(node_id, '.', 1) as group_id from nodes)"
_BOUND = f"""with {D.PARTS}, {_MEMBERS}, a as (select distinct group_id, contract from n_answers join g using (node_id)), dd as (select distinct group_id, contract from n_demands join g using (node_id))
select group_id, 'demand' as side, contract from dd where not exists (select 1 from a where a.group_id = dd.group_id and a.contract = dd.contract)
union all select group_id, 'answer', contract from a where not exists (select 1 from n_demands n where n.contract = a.contract) or exists (select 1 from dd where dd.contract = a.contract and dd.group_id <> a.group_id)"""


def _groups(s, d):
    return D.parts(s, d).select("node_id", F.split("node_id", r"\.")[0].alias("group_id")).distinct()


query("a8_group_boundary", _BOUND)(lambda s, d: E.group_boundary(E.produced(D.parts(s, d)), E.required(D.parts(s, d)), _groups(s, d)))
query("a8_module_rollup", f"""with {D.PARTS}, g as (select 'Module.' || replace(regexp_replace(source_path, '\\.[^./]+$', ''), '/', '.') as group_id, * from nodes),
d as (select group_id, case when x like '[Ghost%' then 'ghost:' || x else trim(split_part(x, '(', 1)) end as contract, x as text from g, unnest(demand) u(x) where x <> 'None' and x not like 'string%'),
a as (select group_id, x as contract from g, unnest(answer) u(x) where x <> 'void'),
kd as (select distinct group_id, contract, text from d where not exists (select 1 from a where a.group_id = d.group_id and a.contract = d.contract)),
ka as (select distinct group_id, contract from a where not exists (select 1 from d where d.contract = a.contract) or exists (select 1 from d where d.contract = a.contract and d.group_id <> a.group_id))
select group_id, coalesce((select string_agg(text, ',' order by text) from kd where kd.group_id = i.group_id), 'None') as demand, coalesce((select string_agg(contract, ',' order by contract) from ka where ka.group_id = i.group_id), 'void') as answer from (select distinct group_id from g) i""")(lambda s, d: E.roll_up(D.parts(s, d), E.module_id(F.col("source_path"))).select("group_id", F.array_join("demand", ",").alias("demand"), F.array_join("answer", ",").alias("answer")))
query("a9_module_union", f"with {D.PARTS}, x as (select 'Module.' || replace(regexp_replace(source_path, '\\.[^./]+$', ''), '/', '.') as group_id, demand, answer from nodes) select group_id, array_to_string(list_sort(list_distinct(flatten(list(demand)))), ',') as demand, array_to_string(list_sort(list_distinct(flatten(list(answer)))), ',') as answer from x group by group_id")(
    lambda s, d: E.module_union(D.parts(s, d), E.module_id(F.col("source_path"))).select("group_id", F.array_join("demand", ",").alias("demand"), F.array_join("answer", ",").alias("answer"))
)
query("a8_domain_ids", f"with {D.PARTS} select node_id, case when category = 'backend' then 'Domain.backend.' || split_part(source_path, '/', 2) else 'Domain.' || category || '.src' end as group_id from nodes")(
    lambda s, d: D.parts(s, d).select("node_id", E.domain_id(F.col("source_path"), F.col("category"), {"backend": ["src"], "infra": ["ops"]}).alias("group_id"))
)

# graph of nations


def _pairs(s, d):
    """Written once: a pair of nations a row, at most, which loops would join from all lines again in each of their steps."""
    return written(D.trade(s, d).select("src", "dst"))


def _nations(s, d):
    return D.table(s, d, "nation").select(F.col("n_name").alias("node_id"))


query("g1_blast_radius", f"with {D.TRADE} select a as origin, b as node from closure where a <> b")(lambda s, d: G.blast_radius(_pairs(s, d), _nations(s, d)))
query("g18_blast_risk", f"with {D.TRADE}, n as (select a as origin, count(*) as impacted from closure where a <> b group by a) select origin, impacted, case when impacted >= 5 then 'high' when impacted >= 2 then 'medium' else 'low' end as risk from n")(
    lambda s, d: G.impact(_pairs(s, d), _nations(s, d)).where("impacted > 0").withColumn("risk", X.risk_bucket(F.col("impacted")))
)
query("g19_blast_warning", f"with {D.TRADE} select count(distinct b) as impacted, count(distinct b) >= 5 as warn from closure where a in (select n_name from nation where n_nationkey < 5) and a <> b")(
    lambda s, d: G.blast_radius(_pairs(s, d), D.table(s, d, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("node_id"))).agg(F.countDistinct("node").alias("impacted")).withColumn("warn", F.col("impacted") >= 5)
)
query("g2_components", f"with {D.TRADE} select node_id, component from comp")(lambda s, d: G.components(_pairs(s, d), _nations(s, d)))
query("g2_cycles", f"with {D.TRADE}, k as (select component, list_sort(list(node_id)) as m, bool_or(node_id in (select src from trade where src = dst)) as l from comp group by component) select component, array_to_string(m, ' -> ') as signature from k where len(m) > 1 or l")(
    lambda s, d: G.cycles(_pairs(s, d), _nations(s, d)).select("component", "signature")
)
query("g5_levels", f"with {D.TRADE} select node_id, component, level::int as level from comp join levels using (component)")(lambda s, d: G.levels(_pairs(s, d), G.components(_pairs(s, d), _nations(s, d))))


# graph of parts of one brand that follow each other in an order

_CALL_CYCLES = "k as (select component, list_sort(list(node_id)) as m, bool_or(node_id in (select src from calls where src = dst)) as l from comp group by component)"


def _part_ids(s, d):
    return D.table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id")).distinct()


def _calls(s, d):
    """Written once, for operators that take it more than once."""
    return written(D.calls(s, d))


@query("g5_levels_parts", f"with {D.CALLS} select node_id, component, level::int as level from comp join levels using (component)")
def g5_parts(s, d):
    """Levels of the graph of parts."""
    calls = _calls(s, d)
    return G.levels(calls, G.components(calls, _part_ids(s, d)))


query("g1_blast_radius_parts", f"with {D.CALLS} select a as origin, b as node from closure where a <> b")(lambda s, d: G.blast_radius(D.calls(s, d), _part_ids(s, d)))
query("g18_blast_risk_parts", f"with {D.CALLS}, n as (select node_id as origin, count(b) filter (b <> node_id) as impacted from ids left join closure on a = node_id group by node_id) select origin, impacted, case when impacted >= 5 then 'high' when impacted >= 2 then 'medium' else 'low' end as risk from n")(
    lambda s, d: G.impact(D.calls(s, d), _part_ids(s, d)).withColumn("risk", X.risk_bucket(F.col("impacted")))
)
query("g19_blast_warning_parts", f"with {D.CALLS}, n as (select count(distinct b) as impacted from closure join part on a = 'p' || p_partkey where p_size = (select max(p_size) from part) and a <> b) select impacted, impacted >= 5 as warn from n")(
    lambda s, d: G.blast_radius(D.calls(s, d), _largest_parts(s, d)).agg(F.countDistinct("node").alias("impacted")).withColumn("warn", F.col("impacted") >= 5)
)
query("g2_components_parts", f"with {D.CALLS} select node_id, component from comp")(lambda s, d: G.components(D.calls(s, d), _part_ids(s, d)))
query("g2_cycles_parts", f"with {D.CALLS}, {_CALL_CYCLES} select component, array_to_string(m, ' -> ') as signature from k where len(m) > 1 or l")(
    lambda s, d: G.cycles(_calls(s, d), _part_ids(s, d)).select("component", "signature")
)


def _largest_parts(s, d):
    parts = D.table(s, d, "part")
    return parts.join(parts.agg(F.max("p_size").alias("p_size")), "p_size").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"))


def _trade_contracts(s, d, p=None):
    p = _pairs(s, d) if p is None else p
    key = F.concat_ws(">", "src", "dst")
    return p.select(F.col("src").alias("node_id"), key.alias("contract")), p.select(F.col("dst").alias("node_id"), key.alias("contract")), p.withColumn("contract", key)


_WEIGHTS = "weights as (select node_id, (1 + count(*) filter (k = 'd') + count(*) filter (k = 'a') + count(*) filter (k = 'd') + count(*) filter (k = 'a'))::bigint as weight from (select node_id, null as k from ids union all select src, 'a' from trade union all select dst, 'd' from trade) group by node_id)"
query("g6_weights", f"with {D.TRADE}, {_WEIGHTS} select * from weights")(lambda s, d: G.weights(*_trade_contracts(s, d), _nations(s, d)))
_PART = f"{_WEIGHTS}, lw as (select level, sum(weight) as w from comp join levels using (component) join weights using (node_id) group by level), part as (select list(s order by level) as p from (select level, sum(w) over (order by level desc) as s from lw))"


def _partition(s, d):
    p = _pairs(s, d)
    a, b, e = _trade_contracts(s, d, p)
    return G.partition(G.levels(p, G.components(p, _nations(s, d))), G.weights(a, b, e, _nations(s, d)))


query("g7_partition", f"with {D.TRADE}, {_PART} select array_to_string(p, ',') as partition from part")(lambda s, d: _partition(s, d).select(F.array_join(F.col("partition").cast("array<string>"), ",").alias("partition")))
_BITS = f"{_PART}, q as (select list_reverse(p) as r from part), bits as (select array_to_string(list_transform(range(1, len(r) + 1), lambda i: repeat('0', (r[i] - case when i > 1 then r[i - 1] else 0 end)::int) || '1'), '') as b from q)"
query("g8_boundary_word", f"with {D.TRADE}, {_BITS} select b as bits from bits")(lambda s, d: _partition(s, d).select(F.array_join(G.boundary_word(F.col("partition")).cast("array<string>"), "").alias("bits")))
query("g9_boundary_hash", f"with {D.TRADE}, {_BITS} select 'Maya-ID: 0x' || upper(left(sha256('maya:' || length(b) || ':' || b), 8)) as hash from bits")(lambda s, d: _partition(s, d).select(G.boundary_hash(G.boundary_word(F.col("partition"))).alias("hash")))
def _colour_sql(rounds: int) -> str:
    """Colours after the first round that splits no class; the last of `rounds` if none does."""
    side = lambda k, mine, other: f"coalesce((select sum(('0x' || substr(y.colour, 1, 15))::hugeint)::varchar || ',' || sum(('0x' || substr(y.colour, 16, 15))::hugeint)::varchar from (select distinct src, dst from trade) t join c{k} y on y.node_id = t.{other} where t.{mine} = c.node_id), '')"
    steps = [f"c{k + 1} as (select node_id, sha256(c.colour || '|o' || {side(k, 'src', 'dst')} || '|i' || {side(k, 'dst', 'src')}) as colour from c{k} c)" for k in range(rounds)]
    sizes = ", ".join(f"(select count(distinct colour) from c{k}) as n{k}" for k in range(rounds + 1))
    first = "case " + " ".join(f"when n{k} = n{k - 1} then {k}" for k in range(1, rounds + 1)) + f" else {rounds} end"
    every = " union all ".join(f"select {k} as k, * from c{k}" for k in range(1, rounds + 1))
    return f"with {D.TRADE}, c0 as (select node_id, sha256('x') as colour from ids), {', '.join(steps)}, done as (select {first} as k from (select {sizes})) select node_id, colour from ({every}) where k = (select k from done)"


query("g10_colours", _colour_sql(6))(lambda s, d: G.colours(_pairs(s, d), _nations(s, d).withColumn("colour", F.lit("x"))))


@query("a10_collapse", f"""with {D.TRADE}, big as (select component from comp group by component having count(*) > 1), g as (select node_id, component from comp join big using (component)),
k as (select src, dst, src || '>' || dst as contract from trade)
select component as group_id, 'demand' as side, contract from k join g on g.node_id = dst where not exists (select 1 from g h where h.node_id = src and h.component = g.component)
union all select component, 'answer', contract from k join g on g.node_id = src where not exists (select 1 from g h where h.node_id = dst and h.component = g.component)""")
def a10(s, d):
    """Outer contracts of each cycle, as of one node."""
    a, b, _ = _trade_contracts(s, d)
    members = G.cycles(_pairs(s, d), _nations(s, d)).where(F.size("members") > 1).select(F.col("component").alias("group_id"), F.explode("members").alias("node_id"))
    return E.group_boundary(a, b, members)


query("g4_collapse", f"with {D.TRADE}, k as (select component, list_sort(list(node_id)) as m, bool_or(node_id in (select src from trade where src = dst)) as l from comp group by component) select 'MacroNode.' || array_to_string(list_transform(m, lambda x: regexp_replace(x, '[^A-Za-z0-9]+', '_', 'g')), '__') as macro_id, len(m)::int as members from k where len(m) > 1 or l")(
    lambda s, d: G.collapse(_pairs(s, d), _nations(s, d), *_trade_contracts(s, d)[:2]).select("macro_id", F.size("members").alias("members"))
)
query("g12_fallback_partition", f"with {D.PARTS}, w as (select split_part(node_id, '.', 1) as owner, 1 + len(demand) + len(answer) as w from nodes) select owner, array_to_string(list(w order by w desc), ',') as partition from w group by owner")(
    lambda s, d: D.parts(s, d).groupBy(F.split("node_id", r"\.")[0].alias("owner")).agg(F.sort_array(F.collect_list(1 + F.size("demand") + F.size("answer")), asc=False).alias("p")).select("owner", F.array_join(F.col("p").cast("array<string>"), ",").alias("partition"))
)

# runtime graph

_RN = f"{D.RUNTIME}, {D.RUNTIME_EDGES}, rn as (select distinct id as node_id, type from rt)"


def _rn(s, d):
    return D.runtime_nodes(s, d).select(F.col("id").alias("node_id"), "type").distinct()


query("f7_known_edges", f"with {_RN} select ord, src, dst from re where src in (select node_id from rn) and dst in (select node_id from rn)")(lambda s, d: G.known_edges(D.runtime_edges(s, d), _rn(s, d)).select("ord", "src", "dst"))
query("g13_edge_index", f"with {_RN} select ord, coalesce(id, 'RuntimeEdge.' || src || '.' || type || '.' || dst) as id from re where src in (select node_id from rn) and dst in (select node_id from rn)")(
    lambda s, d: G.index_edges(D.runtime_edges(s, d), _rn(s, d)).select("ord", "id")
)
query("f13_missing_ends", f"with {_RN} select distinct dst as node_id, 'UnknownRuntime' as type from re where dst not in (select node_id from rn)")(lambda s, d: G.missing_ends(D.runtime_edges(s, d), _rn(s, d)))
query("f5_view_nodes", f"with {_RN} select node_id, type from rn where type in ('view', 'click')")(lambda s, d: G.by_view(_rn(s, d), D.runtime_edges(s, d), ["view", "click"])[0])
query("f5_view_edges", f"with {_RN}, v as (select node_id from rn where type in ('view', 'click')) select ord, src, dst from re where src in (select * from v) and dst in (select * from v)")(
    lambda s, d: G.by_view(_rn(s, d), D.runtime_edges(s, d), ["view", "click"])[1].select("ord", "src", "dst")
)
query("f6_filter_nodes", f"with {_RN}, v as (select node_id, type from rn where type in ('view', 'click', 'purchase') and contains(node_id || ' ' || type, '1')), e as (select src, dst from re where src in (select node_id from v) and dst in (select node_id from v) and type = 'calls') select * from v where node_id in (select src from e union select dst from e)")(
    lambda s, d: G.filter_graph(_rn(s, d), D.runtime_edges(s, d), ["view", "click", "purchase"], None, "1", ["calls"], True)[0]
)
query("f6_filter_edges", f"with {_RN}, v as (select node_id from rn where type in ('view', 'click', 'purchase') and contains(node_id || ' ' || type, '1')) select ord, src, dst from re where src in (select * from v) and dst in (select * from v) and type = 'calls'")(
    lambda s, d: G.filter_graph(_rn(s, d), D.runtime_edges(s, d), ["view", "click", "purchase"], None, "1", ["calls"], True)[1].select("ord", "src", "dst")
)


def _trade_edges(s, d):
    return _pairs(s, d).withColumn("id", F.concat_ws(">", "src", "dst"))


def _start(s, d):
    return _pairs(s, d).agg(F.min("src")).first()[0] or ""


_TRACE = D.TRADE + ", s as (select min(src) as n from trade)"
query("g14_trace_down", f"with {_TRACE} select n as node_id from s union select dst from trade, s where src = n union select t.dst from trade f join trade t on t.src = f.dst, s where f.src = n")(lambda s, d: G.trace(_trade_edges(s, d), _start(s, d), "downstream", 2)[0])
query("g14_trace_up", f"with {_TRACE} select n as node_id from s union select src from trade, s where dst = n")(lambda s, d: G.trace(_trade_edges(s, d), _start(s, d), "upstream", 1)[0])
query("g14_trace_edges", f"with {_TRACE}, b as (select src as a, dst as b, src || '>' || dst as id from trade union all select dst, src, src || '>' || dst from trade) select b.id from b, s where a = n union select y.id from b x join b y on y.a = x.b, s where x.a = n")(
    lambda s, d: G.trace(_trade_edges(s, d), _start(s, d), "both", 2)[1]
)
query("g15_dense_cap", f"with {_RN}, e as (select ord, 'x' || ord as id, src, dst, coalesce(confidence, 0) as c from re), n as (select e.*, x as node_id from e, unnest(list_distinct([src, dst])) u(x) where x in (select node_id from rn where type = 'view')), r as (select id, count(*) over (partition by node_id) as n, row_number() over (partition by node_id order by c desc, id) as r from n) select ord from e where id not in (select id from r where n >= 12 and r > 20)")(
    lambda s, d: G.dense_cap(D.runtime_edges(s, d).withColumn("id", F.concat(F.lit("x"), F.col("ord").cast("string"))), _rn(s, d), ["view"], 20).select("ord")
)
query("g16_edge_cap", f"with {D.RUNTIME}, {D.RUNTIME_EDGES} select ord, coalesce(confidence, 0) as confidence from (select *, 'x' || ord as i from re) order by coalesce(confidence, 0) desc, i limit 400")(
    lambda s, d: G.cap_edges(D.runtime_edges(s, d).withColumn("id", F.concat(F.lit("x"), F.col("ord").cast("string"))), 400).select("ord", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
)

# merging

_LAST = "arg_max({0}, ord) filter ({0} is not null)"
query("a15_merge_nodes", f"with {D.RUNTIME} select id, {_LAST.format('type')} as type, {_LAST.format('label')} as label, {_LAST.format('source_path')} as source_path, {_LAST.format('category')} as category, max(ord)::varchar as last, count(distinct (ord % 3)) + 1 as keys, count(distinct (ord % 4, ord % 5, type)) as evidence from rt group by id")(
    lambda s, d: M.merge_nodes(D.runtime_nodes(s, d)).select("id", "type", "label", "source_path", "category", element("metadata", "last").alias("last"), F.size("metadata").cast("long").alias("keys"), F.size("evidence").cast("long").alias("evidence"))
)
query("a15_merge_edges", f"with {D.RUNTIME}, {D.RUNTIME_EDGES} select src, type, dst, coalesce({_LAST.format('id')}, 'RuntimeEdge.' || src || '.' || type || '.' || dst) as id, max(coalesce(confidence, 0)) as confidence, max(ord)::varchar as last from re group by src, type, dst")(
    lambda s, d: M.merge_edges(D.runtime_edges(s, d)).select("src", "type", "dst", "id", "confidence", element("metadata", "last").alias("last"))
)
query("u7_dedupe_nodes", "select l_partkey % 200 as k, min(l_orderkey * 10 + l_linenumber) as ord from lineitem group by all")(
    lambda s, d: M.dedupe_nodes(D.table(s, d, "lineitem").select((F.col("l_partkey") % 200).cast("string").alias("node_id"), F.lit("a").alias("source_path"), F.lit("c").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))).select(F.col("node_id").cast("long").alias("k"), "ord")
)
query("u8_dedupe_diagnostics", "select event_type as code, user_id % 3 as lvl, min(event_id) as ord from events group by all")(
    lambda s, d: M.dedupe_diagnostics(D.table(s, d, "events").select((F.col("user_id") % 3).cast("string").alias("level"), F.col("event_type").alias("code"), F.lit("c").alias("component"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("source_path"), F.col("event_id").alias("ord"))).select("code", F.col("level").cast("long").alias("lvl"), "ord")
)
query("u9_unique_nodes", f"with {D.PARTS}, p as (select ' Svc' || (k % 300) || ' ' as id, k from (select p_partkey as k from part)) select trim(id) as node_id, min(k) as ord from p group by all")(
    lambda s, d: E.unique_nodes(D.table(s, d, "part").select(F.concat(F.lit(" Svc"), (F.col("p_partkey") % 300).cast("string"), F.lit(" ")).alias("node_id"), F.col("p_partkey").alias("ord")))
)
query("u10_merge_entries", f"with {D.PARTS}, m as (select split_part(node_id, '.', 1) as owner, list_filter(flatten(list(demand order by ord)), lambda x: x <> 'None') as d from nodes group by owner) select owner, case when len(d) = 0 then 1 else len(list_distinct(d)) end as n from m")(
    lambda s, d: D.parts(s, d).groupBy(F.split("node_id", r"\.")[0].alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "demand"))), lambda x: x["demand"]).alias("g")).select("owner", F.size(M.merge_entries(F.col("g"), "None")).cast("long").alias("n"))
)


def _changes(s, d):
    k = F.col("p_partkey")
    return D.table(s, d, "part").where(k % 13 == 0).select(k.alias("ord"), F.when(k % 2 == 0, "modify").otherwise(F.when(k % 3 == 0, "create_child").otherwise("reuse")).alias("op"), F.when(k % 3 == 0, F.concat(F.lit("New"), k.cast("string"))).otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("node_id"), F.concat(F.lit("P"), (k * 2).cast("string")).alias("parent_id"), F.when(k % 4 == 0, F.lit("other")).otherwise(F.col("p_name")).alias("problem"))


_CH = "ch as (select p_partkey as ord, case when p_partkey % 2 = 0 then 'modify' when p_partkey % 3 = 0 then 'create_child' else 'reuse' end as op, case when p_partkey % 3 = 0 then 'New' || p_partkey else 'P' || p_partkey end as node_id, 'P' || (p_partkey * 2) as parent_id, case when p_partkey % 4 = 0 then 'other' else p_name end as problem from part where p_partkey % 13 = 0), n as (select 'P' || p_partkey as node_id, p_name as problem from part)"


def _named(s, d):
    return D.table(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("problem"))


query("j18_apply_changes", f"with {_CH} select node_id, case when op in ('modify', 'create_child') then coalesce(c.problem, n.problem) else n.problem end as problem, case op when 'create_child' then 'created' when 'modify' then 'modified' when 'reuse' then 'reused' else 'unchanged' end as status from n full join ch c using (node_id)")(
    lambda s, d: M.apply_changes(_named(s, d), _changes(s, d))
)
_CHANGE_PROBLEMS = """select ord, 'missing_target' as rule from ch left join n using (node_id) where op in ('reuse', 'modify') and n.problem is null
union all select ord, 'missing_parent' from ch where op = 'create_child' and parent_id not in (select node_id from n) union all select ord, 'id_exists' from ch join n using (node_id) where op = 'create_child'
union all select ord, 'problem_changed' from ch join n using (node_id) where op = 'modify' and ch.problem <> n.problem"""
query("j19_change_problems", f"with {_CH} {_CHANGE_PROBLEMS}")(lambda s, d: M.change_problems(_changes(s, d), _named(s, d)))
query("j9_both_ways", """with l as (select 'a' as fv, 'x' || (event_id % 40) as f, 'b' as tv, 'y' || (event_id % 60) as t, round((event_id % 97) / 97.0, 4) as c from events)
select fv || '::' || f || '::r::' || tv || '::' || t as id, greatest(0.01, least(0.99, max(c))) as confidence from (select * from l union all select tv, t, fv, f, c from l) group by fv, f, tv, t""")(
    lambda s, d: M.both_ways(D.table(s, d, "events").select(F.lit("a").alias("from_view"), F.concat(F.lit("x"), (F.col("event_id") % 40).cast("string")).alias("from_id"), F.lit("b").alias("to_view"), F.concat(F.lit("y"), (F.col("event_id") % 60).cast("string")).alias("to_id"), F.lit("r").alias("relation"), F.round((F.col("event_id") % 97) / 97.0, 4).alias("confidence"), F.lit("why").alias("reason"), F.lit(None).cast("string").alias("source_path"), F.col("event_id").alias("ord"))).select("id", "confidence")
)
query("x26_rename_collisions", f"""with {D.PARTS}, r as (select distinct split_part(node_id, '.', 2) as node_id, source_path, category, split_part(source_path, '/', 2) as b, regexp_extract(source_path, '/(m\\d+)\\.', 1) as m from nodes),
p as (select *, row_number() over (partition by node_id order by source_path, category) as place from r), k as (select node_id, count(*) as n, count(distinct m) as d1, count(distinct b || '.' || m) as d2, count(distinct source_path) as paths from r group by 1)
select node_id, source_path, category, case when paths = 1 then node_id else category || '.' || case when d1 = n then m when d2 = n then b || '.' || m else b || '.' || m || '.' || place end || '.' || node_id end as new_id from p join k using (node_id)""")(lambda s, d: M.rename_collisions(D.parts(s, d).select(element(F.split("node_id", r"\."), -1).alias("node_id"), "source_path", "category")))

# set operations and drift

_VER = """oa as (select * from answers where split_part(contract, '@', 1)::int % 7 <> 0), na as (select * from answers where split_part(contract, '@', 1)::int % 5 <> 0),
oe as (select a.node_id as src, d.node_id as dst, contract from oa a join demands d using (contract)), ne as (select a.node_id as src, d.node_id as dst, contract from na a join demands d using (contract))"""


def _version(s, d, m):
    return D.answers(s, d).where(F.split("contract", "@")[0].cast("int") % m != 0)


def _sides(s, d):
    """(old answers, demands, new answers) of two versions, from tables written once: their joins would make each from all lines again."""
    every, demands = written(D.answers(s, d)), written(D.demands(s, d))
    old, new = (every.where(F.split("contract", "@")[0].cast("int") % m != 0) for m in (7, 5))
    return old, demands, new


query("j12_broken_contracts", f"with {D.CONTRACTS}, {_VER} select d.node_id, contract, array_to_string((select list_sort(list(distinct node_id)) from oa where oa.contract = d.contract), ',') as producers from demands d where contract not in (select contract from na) and contract in (select contract from oa)")(
    lambda s, d: R.broken_contracts(_version(s, d, 7), _version(s, d, 5), D.demands(s, d)).select("node_id", "contract", F.array_join("producers", ",").alias("producers"))
)
query("j13_removed_edges", f"with {D.CONTRACTS}, {_VER}, nn as (select src as n from ne union select dst from ne) select src, dst, contract from oe where src in (select n from nn) and dst in (select n from nn) except select * from ne")(
    lambda s, d: R.removed_contract_edges(*_sides(s, d))
)
query("g3_degraded", f"""with {D.CONTRACTS}, {_VER}, nn as (select src as n from ne union select dst from ne), b as (select count(*) as n from demands d where contract not in (select contract from na) and contract in (select contract from oa)),
r as (select count(*) as n from (select src, dst, contract from oe where src in (select n from nn) and dst in (select n from nn) except select * from ne)) select b.n as broken_contracts, r.n as removed_edges, b.n > 0 or r.n > 0 as degraded from b, r""")(
    lambda s, d: (lambda old, demands, new: R.degraded(s.createDataFrame([], "x string"), R.broken_contracts(old, new, demands), R.removed_contract_edges(old, demands, new)))(*_sides(s, d)).select("broken_contracts", "removed_edges", "degraded")
)
query("g3_new_cycles", f"with {D.TRADE}, k as (select list_sort(list(node_id)) as m, bool_or(node_id in (select src from trade where src = dst)) as l from comp group by component) select array_to_string(m, ' -> ') as signature from k where len(m) > 1 or l")(
    lambda s, d: R.new_cycles(_pairs(s, d).limit(0), _pairs(s, d), _nations(s, d), _nations(s, d))
)
_KEYS = "ok as (select distinct src || '::' || contract || '::' || dst as key from oe), nk as (select distinct src || '::' || contract || '::' || dst as key from ne)"


def _keys(s, d, m):
    return R.edge_keys(E.edges_of(_version(s, d, m), D.demands(s, d)))


query("u1_edge_drift", f"with {D.CONTRACTS}, {_VER}, {_KEYS} (select 'added' as change, key from nk where key not in (select key from ok) order by key limit 50) union all (select 'removed', key from ok where key not in (select key from nk) order by key limit 50)")(
    lambda s, d: R.edge_drift(_keys(s, d, 5), _keys(s, d, 7), 50)
)
query("j14_surges", f"with {D.CONTRACTS}, {_VER}, o as (select dst as node_id, count(*) as n from oe group by dst), w as (select dst as node_id, count(*) as n from ne group by dst) select node_id, coalesce(w.n, 0) as current, coalesce(o.n, 0) as previous, coalesce(w.n, 0) - coalesce(o.n, 0) as delta from o full join w using (node_id) where abs(coalesce(w.n, 0) - coalesce(o.n, 0)) >= 3")(
    lambda s, d: R.surges(*(E.edges_of(_version(s, d, m), D.demands(s, d)).groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("degree")) for m in (5, 7)))
)


def _daily(s, d):
    return D.table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _snapshot(s, d, m):
    """Contracts without one part in m; runtime rows without one event in m; diagnostics of every event, some without a code."""
    e = E.edges_of(_version(s, d, m), D.demands(s, d))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("demand", F.array().cast("array<string>"))
    diags = D.table(s, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("code"))
    return R.snapshot(nodes, e, D.runtime_nodes(s, d).where(F.col("ord") % m != 0).select("id").distinct(), D.runtime_edges(s, d).where(F.col("ord") % m != 0), diags)


query("c5_trend_report", f"""with {D.CONTRACTS}, {_VER}, {_KEYS}, {D.RUNTIME}, {D.RUNTIME_EDGES}, nd as (select node_id, count(*) as n from (select src as node_id from ne union all select dst from ne) group by 1), od as (select node_id, count(*) as n from (select src as node_id from oe union all select dst from oe) group by 1),
nio as (select node_id, sum(i) as i, sum(o) as o from (select dst as node_id, 1 as i, 0 as o from ne union all select src, 0, 1 from ne) group by 1), oio as (select node_id, sum(i) as i, sum(o) as o from (select dst as node_id, 1 as i, 0 as o from oe union all select src, 0, 1 from oe) group by 1),
nr as (select node_id from nio where i >= 5 or o >= 5 or i + o >= 8 order by i + o desc, node_id limit 80), orr as (select node_id from oio where i >= 5 or o >= 5 or i + o >= 8 order by i + o desc, node_id limit 80),
rn_k as (select distinct src || '::' || type || '::' || dst as key from re where ord % 5 <> 0), ro_k as (select distinct src || '::' || type || '::' || dst as key from re where ord % 7 <> 0),
m as (select 'edges_added' as measure, least(50, count(*)) as value from nk where key not in (select key from ok) union all select 'edges_removed', least(50, count(*)) from ok where key not in (select key from nk)
union all select 'runtime_edges_added', least(50, count(*)) from rn_k where key not in (select key from ro_k) union all select 'runtime_edges_removed', least(50, count(*)) from ro_k where key not in (select key from rn_k)
union all select 'risk_added', count(*) from nr where node_id not in (select node_id from orr) union all select 'risk_removed', count(*) from orr where node_id not in (select node_id from nr)),
t as (select 'nodes' as measure, count(*) as value from nd union all select 'edges', count(*) from ne union all select 'surges', count(*) from nd full join od using (node_id) where abs(coalesce(nd.n, 0) - coalesce(od.n, 0)) >= 3
union all select 'risk_total', count(*) from nr union all select 'runtime_nodes', count(distinct id) from rt where ord % 5 <> 0 union all select 'runtime_edges', count(*) from re where ord % 5 <> 0 union all select 'diagnostics_no_code', count(*) from events where event_type = 'error'
union all select 'execute_like_ratio', 0 union all select 'ghost_ratio', 0) select measure, value::double as value from m where value > 0 union all select measure, value::double from t""")(lambda s, d: R.report(_snapshot(s, d, 5), _snapshot(s, d, 7)))
query("c14_protocol_problems", f"""with {_CH} select ord, 'low_confidence' as rule from ch where ord % 10 < 5 union all select -1, 'focus_drift' union all {_CHANGE_PROBLEMS}""")(
    lambda s, d: M.protocol_problems(_changes(s, d).withColumn("confidence", (F.col("ord") % 10) / 10.0), _named(s, d), s.createDataFrame([("macro", "A.run", "split"), ("meso", "A.run", "Split"), ("micro", "B.run", "split")], "stage string, focus string, operation string"), 0.5)
)
query("t11_locale_order", "select n_nationkey, row_number() over (order by lower(n_name))::int as place from nation")(
    lambda s, d: D.table(s, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.collate(F.initcap("n_name"), "UNICODE"))).alias("place"))
)
query("t10_compare", "with h as (select ts::date as day, event_type, count(*) as n from events group by all) select day, event_type, n, lag(n) over w as prev_n, n - lag(n) over w as delta_n from h window w as (partition by event_type order by day)")(
    lambda s, d: R.compared(_daily(s, d), ["n"], "day", ["event_type"])
)
query("t9_history", "with h as (select ts::date as day, count(*) as n from events group by all) select * from h order by day desc limit 26")(
    lambda s, d: R.keep_newest(D.table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")), 26, "day")
)
query("u4_overlap", f"with {D.PARTS} select node_id, len(list_intersect(string_split(problem, ' '), ['red', 'small', 'ring'])) > 0 as hit from nodes")(
    lambda s, d: D.parts(s, d).select("node_id", F.arrays_overlap(F.split("problem", " "), F.array(F.lit("red"), F.lit("small"), F.lit("ring"))).alias("hit"))
)
query("t8_top_per_group", "select l_suppkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber)::int as rank from lineitem) where rank <= 3")(
    lambda s, d: top_by(D.table(s, d, "lineitem"), ["l_suppkey"], 3, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")
)
@query("c9_restructure")
def c9(s, d):
    """Proposals over the parts as nodes of one file: cycles to collapse, nodes to split, pieces to gather."""
    nodes = D.parts(s, d).withColumn("source_path", F.lit("src/all.ts"))
    sides = E.produced(nodes), E.required(nodes)
    return advice.restructure(nodes, None, E.fanout_counts(*sides), sides=sides).select("operation", "target", F.array_join("targets", ",").alias("targets"), "score")


_FAN = "fan as (select src as node_id, count(distinct dst) as downstream_count from n_edges where src <> dst group by src)"
query("a11_fragments", f"with {D.PARTS}, {_FAN} select split_part(node_id, '.', 1) || '@' || source_path as group_key, count(*) as size, count(*) filter (regexp_matches(split_part(node_id, '.', 2), '{advice.FRAGMENT}')) as helpers, 1::bigint as paths, avg(coalesce(downstream_count, 0)) as mean_fanout from nodes left join fan using (node_id) group by all having count(*) >= 1 and (count(*) filter (regexp_matches(split_part(node_id, '.', 2), '{advice.FRAGMENT}')) > 0 or avg(coalesce(downstream_count, 0)) <= 1.5)")(
    lambda s, d: advice.fragment_groups(D.parts(s, d), E.fanout_counts(E.produced(D.parts(s, d)), E.required(D.parts(s, d))), 1).select("group_key", "size", "helpers", "paths", "mean_fanout")
)
