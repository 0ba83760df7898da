"""The engine's datasets derived from the driver's tables, each with the SQL that says the same.

answers/demands: suppliers produce and customers require (part, ship month) contracts. trade: pairs of nations whose revenue
is over its 0.9 quantile. parts: a NODE row a part, with generated contracts, ghosts and paths. runtime rows: events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import element
from ..operators.shared import many


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows on all cores: a table of keys is a small file that one task reads, and texts that are made of its keys and
    extracted from would stay in that task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


def answers(spark: SparkSession, sf: str, until: int | None = None) -> DataFrame:
    li = table(spark, sf, "lineitem")
    li = li if until is None else li.where(F.year("l_shipdate") <= until)
    return li.select(F.concat(F.lit("S."), F.col("l_suppkey").cast("string")).alias("node_id"), F.concat_ws("@", F.col("l_partkey").cast("string"), _month("l_shipdate")).alias("contract")).distinct()


def demands(spark: SparkSession, sf: str, until: int | None = None) -> DataFrame:
    li = table(spark, sf, "lineitem")
    li = li if until is None else li.where(F.year("l_shipdate") <= until)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C."), F.col("o_custkey").cast("string")).alias("node_id"), F.concat_ws("@", F.col("l_partkey").cast("string"), _month("l_shipdate")).alias("contract")).distinct()


CONTRACTS = """answers as (select distinct 'S.' || l_suppkey as node_id, l_partkey || '@' || strftime(l_shipdate, '%Y-%m') as contract from lineitem),
demands as (select distinct 'C.' || o_custkey as node_id, l_partkey || '@' || strftime(l_shipdate, '%Y-%m') as contract from lineitem join orders on l_orderkey = o_orderkey),
edges as (select a.node_id as src, d.node_id as dst, contract from answers a join demands d using (contract))"""


def trade(spark: SparkSession, sf: str, quantile: float = 0.9) -> DataFrame:
    """(src, dst) of supplier and customer nations with revenue over the quantile of all pairs."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sn"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    by = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("sn", "cn").agg(F.sum("rev").alias("rev"))
    limit = by.agg(F.percentile("rev", quantile).alias("q"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    kept = by.join(F.broadcast(limit)).where("rev > q")  # one row
    a, b = n.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("dst"))
    return kept.join(a, "sn").join(b, "cn").select("src", "dst", "rev")


TRADE = """pairs as (select s_nationkey as sn, c_nationkey as cn, sum(l_extendedprice * (1 - l_discount)) as rev from lineitem join supplier on l_suppkey = s_suppkey
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all),
trade as (select a.n_name as src, b.n_name as dst, rev from pairs join nation a on a.n_nationkey = sn join nation b on b.n_nationkey = cn where rev > (select quantile_cont(rev, 0.9) from pairs)),
closure as (with recursive r(a, b) as (select src, dst from trade union select r.a, t.dst from r join trade t on r.b = t.src) select * from r),
ids as (select n_name as node_id from nation),
comp as (select node_id, least(node_id, coalesce(min(c.b), node_id)) as component from ids left join closure c on c.a = node_id and exists (select 1 from closure d where d.a = c.b and d.b = node_id) group by node_id),
dag as (select distinct x.component as cs, y.component as cd from trade join comp x on x.node_id = src join comp y on y.node_id = dst where x.component <> y.component),
levels as (with recursive w(c, l) as (select component, 0 from comp union select cd, l + 1 from w join dag on cs = c) select c as component, max(l) as level from w group by c)"""

#: Parts of one brand that follow each other in an order: a graph of as many nodes as there are parts.
CALLS = """lines as (select l_orderkey, l_linenumber, l_partkey, p_brand from lineitem join part on l_partkey = p_partkey),
calls as (select distinct src, dst from (select 'p' || l_partkey as src, 'p' || lead(l_partkey) over w as dst, p_brand, lead(p_brand) over w as next_brand from lines window w as (partition by l_orderkey order by l_linenumber, l_partkey)) where p_brand = next_brand),
ids as (select distinct 'p' || p_partkey as node_id from part),
closure as (with recursive r(a, b) as (select src, dst from calls union select r.a, t.dst from r join calls t on r.b = t.src) select * from r),
mutual as (select c.a, min(c.b) as least from closure c join closure d on d.a = c.b and d.b = c.a group by c.a),
comp as (select node_id, coalesce(least(node_id, least), node_id) as component from ids left join mutual on a = node_id),
dag as (select distinct x.component as cs, y.component as cd from calls join comp x on x.node_id = src join comp y on y.node_id = dst where x.component <> y.component),
levels as (with recursive w(c, l) as (select component, 0 from comp union select cd, l + 1 from w join dag on cs = c) select c as component, max(l) as level from w group by c)"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst) of parts of one brand that follow each other in an order."""
    lines = table(spark, sf, "lineitem").join(many(table(spark, sf, "part")), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    every = lines.select(name(F.col("l_partkey")).alias("src"), name(F.lead("l_partkey").over(w)).alias("dst"), "p_brand", F.lead("p_brand").over(w).alias("next_brand"))
    return every.where("p_brand = next_brand").select("src", "dst").distinct()


#: Methods and endings that parts are dealt by their key.
METHODS = ["execute", "build", "handle", "parse", "run", "report", "load"]
ENDINGS = ["ts", "py", "go", "java", "txt"]
CATEGORIES = ["backend", "core", "frontend"]


def parts(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """NODE rows of parts, or of other rows like those."""
    k = F.col("p_partkey")
    pick = lambda values, n: element(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    s = lambda c: c.cast("string")
    node = F.concat(F.lit("Svc"), s(F.floor(k / 7)), F.lit("."), pick(METHODS, 7))
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/m"), s(k % 50), F.lit("."), pick(ENDINGS, 5))
    demand = F.array_compact(F.array(
        F.concat(F.lit("Type"), s(F.col("p_size")), F.lit("_"), s(k % 97), F.lit(" (x)")), F.when(k % 4 == 0, F.concat(F.lit("[Ghost:Read] Db"), s(k % 3), F.lit(" (redis)"))),
        F.when(k % 5 == 0, F.lit("[Ghost:ReadWrite] unknown (ctx)")), F.when(k % 6 == 0, F.concat(F.lit("[Ghost:ReadWrite] Store (queue"), s(k % 11), F.lit(")"))), F.when(k % 9 == 0, F.lit("None")), F.when(k % 8 == 0, F.lit("string (name)")),
    ))
    answer = F.array_compact(F.array(F.concat(F.lit("Type"), s((F.col("p_size") * 7) % 50 + 1), F.lit("_"), s((k * 3) % 97)), F.when(k % 10 == 0, F.lit("void"))))
    none = "array<struct<raw:string,mode:string,target:string,value_type:string,retained:boolean,score:int>>"
    return (table(spark, sf, "part") if rows is None else rows).select(
        node.alias("node_id"), pick(CATEGORIES, 3).alias("category"), path.alias("source_path"), F.col("p_name").alias("problem"), demand.alias("demand"), answer.alias("answer"),
        F.array().cast(none).alias("ghost_reads"), F.array().cast("array<string>").alias("promotion_reasons"), F.array().cast("array<string>").alias("folded_leaves"), k.alias("ord"),
    )


def _pick(values: list[str], n: int) -> str:
    return f"['{"', '".join(values)}'][(k % {n} + 1)::int]"


PARTS = f"""nodes as (select 'Svc' || (k // 7) || '.' || {_pick(METHODS, 7)} as node_id, {_pick(CATEGORIES, 3)} as category,
    'src/' || lower(replace(p_brand, '#', '_')) || '/m' || (k % 50) || '.' || {_pick(ENDINGS, 5)} as source_path, p_name as problem,
    list_filter(['Type' || p_size || '_' || (k % 97) || ' (x)', case when k % 4 = 0 then '[Ghost:Read] Db' || (k % 3) || ' (redis)' end, case when k % 5 = 0 then '[Ghost:ReadWrite] unknown (ctx)' end,
        case when k % 6 = 0 then '[Ghost:ReadWrite] Store (queue' || (k % 11) || ')' end, case when k % 9 = 0 then 'None' end, case when k % 8 = 0 then 'string (name)' end], lambda x: x is not null) as demand,
    list_filter(['Type' || ((p_size * 7) % 50 + 1) || '_' || ((k * 3) % 97), case when k % 10 = 0 then 'void' end], lambda x: x is not null) as answer, k as ord
    from (select *, p_partkey as k from part)),
n_answers as (select distinct node_id, x as contract from (select node_id, unnest(answer) as x from nodes) where x <> 'void'),
n_demands as (select distinct node_id, trim(split_part(x, '(', 1)) as contract from (select node_id, unnest(demand) as x from nodes) where x not like '[Ghost%' and x <> 'None' and x not like 'string%'),
n_edges as (select a.node_id as src, d.node_id as dst, contract from n_answers a join n_demands d using (contract)),
lang as (select *, case when source_path like '%.ts' then 'typescript' when source_path like '%.py' then 'python' when source_path like '%.go' then 'go' when source_path like '%.java' then 'java' else 'unknown' end as language,
    len(list_filter(demand, lambda x: x like '[Ghost:%')) as ghosts from nodes)"""


def runtime_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """RT_NODE rows of events: a row an event, of 5 x 50 ids; some values are missing."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    some = lambda n, c: F.when(i % n == 0, c)
    meta = F.map_from_arrays(F.array(F.concat(F.lit("k"), (i % 3).cast("string")), F.lit("last")), F.array((i % 17).cast("string"), i.cast("string")))
    ev = F.array(F.struct(F.concat(F.lit("f"), (i % 4).cast("string"), F.lit(".py")).alias("source_path"), (i % 5).cast("int").alias("line"), F.lit(1).alias("column"), F.lit("call").alias("kind"), F.col("event_type").alias("text"), F.lit(0.5).alias("confidence")))
    return e.select(
        F.concat_ws(".", "event_type", (F.col("user_id") % 50).cast("string")).alias("id"), F.col("event_type").alias("type"), some(2, F.concat(F.lit("label"), (i % 7).cast("string"))).alias("label"), some(3, F.concat(F.lit("src/p"), (i % 9).cast("string"), F.lit(".py"))).alias("source_path"),
        some(5, F.lit("core")).alias("category"), F.lit(None).cast("string").alias("framework"), meta.alias("metadata"), ev.alias("evidence"), i.alias("ord"), "user_id", "ts", "value",
    )


RUNTIME = """rt as (select event_type || '.' || (user_id % 50) as id, event_type as type, case when event_id % 2 = 0 then 'label' || (event_id % 7) end as label,
    case when event_id % 3 = 0 then 'src/p' || (event_id % 9) || '.py' end as source_path, case when event_id % 5 = 0 then 'core' end as category, event_id as ord, user_id, ts, value from events)"""


def runtime_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(id, src, dst, type, confidence, ord) between the nodes of one user's neighbouring event kinds."""
    r = runtime_nodes(spark, sf)
    i = F.col("ord")
    to = F.concat_ws(".", element(F.array(*(F.lit(x) for x in ("view", "click", "purchase", "ghost"))), (i % 4 + 1).cast("int")), ((F.col("user_id") * 7 + i) % 60).cast("string"))
    return r.select(F.when(i % 2 == 0, F.concat(F.lit("e"), i.cast("string"))).alias("id"), F.col("id").alias("src"), to.alias("dst"), element(F.array(F.lit("calls"), F.lit("reads"), F.lit("invokes")), (i % 3 + 1).cast("int")).alias("type"), F.lit(None).cast("string").alias("label"), F.col("metadata"), F.when(i % 10 > 0, (i % 100) / 100.0).alias("confidence"), "evidence", F.col("ord"))


RUNTIME_EDGES = """re as (select case when ord % 2 = 0 then 'e' || ord end as id, id as src, ['view', 'click', 'purchase', 'ghost'][(ord % 4 + 1)::int] || '.' || ((user_id * 7 + ord) % 60) as dst,
    ['calls', 'reads', 'invokes'][(ord % 3 + 1)::int] as type, case when ord % 10 > 0 then (ord % 100) / 100.0 end as confidence, ord from rt)"""

#: Category prefixes over the paths of parts.
PREFIXES = [("frontend", "src/brand_1", 0), ("backend", "src", 1), ("core", "src/brand_11", 2), ("core", "src/brand_23/m1", 3), ("infra", "ops", 4)]


def prefixes(spark: SparkSession) -> DataFrame:
    rows = [(c, p, i) for c, p, i in PREFIXES] + [("frontend", "src/brand_12", 5), ("frontend", "src/brand_13/", 6)]
    return spark.createDataFrame(rows, "category string, prefix string, ord int")


PREFIX_SQL = "prefixes as (select * from (values ('frontend', 'src/brand_1', 0), ('backend', 'src', 1), ('core', 'src/brand_11', 2), ('core', 'src/brand_23/m1', 3), ('infra', 'ops', 4), ('frontend', 'src/brand_12', 5), ('frontend', 'src/brand_13', 6)) t(category, prefix, ord))"


def by_name(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col(rows.columns[0]).alias(name))
