"""Queries of scalar functions, filters, links, measures, coverage and gates, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import element

from ..functions import contracts as K, scalars as X
from ..operators import advice, edges as E, governance as V, linkage as L, metrics as T
from ..operators.shared import top_by
from . import derive as D
from .queries_graph import query

# scalars over urls, names and numbers

_URL = "u as (select page_id, url from pages)"
_API = "case when length({0}) > 1 then regexp_replace({0}, '/$', '') else {0} end"


def _api_sql(c: str) -> str:
    body = f"regexp_replace('/' || regexp_extract(regexp_replace(regexp_replace(trim({c}), '\\$\\{{[^}}]+\\}}', ':param', 'g'), '(?i)^https?://[^/?#]*', ''), '^([^?#]*)', 1), '/+', '/', 'g')"
    return _API.format(body)


def _pages(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "pages").select("page_id", "url")


_PARAM = "\\{[^/}]+\\}|\\[[^/\\]]+\\]|:[A-Za-z_][\\w-]*"
query("x7_api_path", f"with {_URL} select page_id, {_api_sql('url')} as path from u")(lambda s, d: _pages(s, d).select("page_id", X.api_path(F.col("url")).alias("path")))
_RAW = "case page_id % 4 when 0 then '/api/v1/items/{id}/run' when 1 then 'api/users/:user//' when 2 then '/v2/[slug]/x?q=1' else 'https://h.example/api/orders/${o.id}' end"


def _raw(s, d):
    k = F.col("page_id") % 4
    texts = ["/api/v1/items/{id}/run", "api/users/:user//", "/v2/[slug]/x?q=1", "https://h.example/api/orders/${o.id}"]
    return D.table(s, d, "pages").select("page_id", F.coalesce(*(F.when(k == i, F.lit(t)) for i, t in enumerate(texts))).alias("p"))


query("x8_comparable_path", f"with r as (select page_id, {_RAW} as p from pages) select page_id, regexp_replace({_api_sql('p')}, '{_PARAM}', ':param', 'g') as path from r")(lambda s, d: _raw(s, d).select("page_id", X.comparable_path(F.col("p")).alias("path")))
query(
    "x9_path_variants",
    "select page_id, case page_id % 4 when 0 then '/api/v1/items/{id}/run,/api/v1/items/:param/run,/items/{id}/run,/items/:param/run' when 1 then '/api/users/:user,/api/users/:param,/users/:user,/users/:param' "
    "when 2 then '/v2/[slug]/x,/v2/:param/x,/[slug]/x,/:param/x' else '/api/orders/:param,/orders/:param' end as variants from pages",
)(lambda s, d: _raw(s, d).select("page_id", F.array_join(X.path_variants(F.col("p")), ",").alias("variants")))
query("x1_slashes", "select p_partkey, replace('a\\b/' || p_name || '\\c', '\\', '/') as path from part")(lambda s, d: D.table(s, d, "part").select("p_partkey", X.slashes(F.concat(F.lit("a\\b/"), "p_name", F.lit("\\c"))).alias("path")))
query("x2_node_parts", f"with {D.PARTS} select node_id, split_part(node_id, '.', 1) as klass, split_part(node_id, '.', 2) as method from nodes")(
    lambda s, d: D.parts(s, d).withColumn("r", X.node_parts(F.col("node_id"))).select("node_id", F.col("r.class").alias("klass"), F.col("r.method").alias("method"))
)
query("x2_sole_and_prefixed", "select n_name, n_name as klass, 'execute' as method, 'core' as category from nation")(
    lambda s, d: D.table(s, d, "nation").withColumn("r", X.node_parts(F.concat(F.lit("Core."), "n_name"))).select("n_name", F.col("r.class").alias("klass"), F.col("r.method").alias("method"), F.col("r.category").alias("category"))
)
query("x3_demand_parts", "select p_partkey, case when p_partkey % 3 = 2 then null else p_type end as type, case p_partkey % 3 when 0 then p_name when 1 then 'input' || (p_partkey + 1) end as name from part")(
    lambda s, d: D.table(s, d, "part").withColumn("r", X.demand_parts(F.expr("case p_partkey % 3 when 0 then p_type || ' (' || p_name || ')' when 1 then p_type else 'None' end"), F.col("p_partkey"))).select("p_partkey", F.col("r.type").alias("type"), F.col("r.name").alias("name"))
)
query("x4_category_name", "select p_partkey, case p_partkey % 3 when 0 then 'core' when 1 then 'frontend' else lower(p_type) end as c from part")(
    lambda s, d: D.table(s, d, "part").select("p_partkey", X.category_name(F.expr("case p_partkey % 3 when 0 then ' ' when 1 then ' UI ' else p_type end"), {"ui": "frontend"}).alias("c"))
)
query("x5_runtime_id", "select p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(trim(' a\\' || p_name || '!#' || p_brand || '  x '), '\\', '/'), '\\s+', '_', 'g'), '[^\\w./:{}-]+', '_', 'g'), '_+', '_', 'g') as id from part")(
    lambda s, d: D.table(s, d, "part").select("p_partkey", X.runtime_id(F.concat(F.lit(" a\\"), "p_name", F.lit("!#"), "p_brand", F.lit("  x "))).alias("id"))
)
query("x6_line_column", "with b as (select doc_id, left(text, (doc_id * 37 % 900)::bigint) as t from documents) select doc_id, len(string_split_regex(t, '\\r?\\n'))::int as line, length(list_last(string_split_regex(t, '\\r?\\n')))::int + 1 as col from b")(
    lambda s, d: D.table(s, d, "documents").withColumn("r", X.line_column(F.col("text"), F.col("doc_id") * 37 % 900)).select("doc_id", F.col("r.line").alias("line"), F.col("r.column").alias("col"))
)
query("x10_route_id", f"with {_URL} select page_id, 'ApiRoute.GET.' || regexp_replace(regexp_replace({_api_sql('url')}, '[^\\w./:{{}}-]+', '_', 'g'), '_+', '_', 'g') as id from u")(lambda s, d: _pages(s, d).select("page_id", X.route_id(F.lit("get"), F.col("url")).alias("id")))
query("x10_service_id", "select p_partkey, case p_partkey % 3 when 0 then 'Service.OrderItemService.run' when 1 then 'Service.start' else 'Service.UserService.get_all' end as id from part")(
    lambda s, d: D.table(s, d, "part").select("p_partkey", X.service_id(F.expr("case p_partkey % 3 when 0 then 'self.order_item_service.run(' when 1 then 'start(x)' else 'userService.get_all(1)' end")).alias("id"))
)
query("x10_labels", f"with {D.PARTS} select node_id, case when source_path like '%.ts' or source_path like '%.py' then replace(regexp_extract(source_path, '/(m\\d+)\\.', 1), '_', ' ') else regexp_extract(source_path, '/(m\\d+\\.\\w+)$', 1) end as label from nodes")(
    lambda s, d: D.parts(s, d).select("node_id", X.label_of_path(F.col("source_path")).alias("label"))
)
query("x10_pascal", "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), '') as name from part")(lambda s, d: D.table(s, d, "part").select("p_partkey", X.pascal(F.col("p_name")).alias("name")))
query("x11_paths_match", "select page_id, page_id % 8 < 4 and page_id % 4 <> 3 as hit from pages")(
    lambda s, d: _raw(s, d).select("page_id", X.paths_match(F.col("p"), F.expr("case when page_id % 8 >= 4 then '/nowhere' else case page_id % 4 when 0 then '/api/v1/items/7/run' when 1 then '/api/users/9' when 2 then '/v2/home/x' else '/api/orders/7/x' end end")).alias("hit"))
)
query("x11_anchor_api", f"with {_URL} select page_id, '/api/v1/' || page_id as path from u")(lambda s, d: _pages(s, d).select("page_id", X.anchor_api(F.concat(F.lit("/app/base/api/v1/"), F.col("page_id").cast("string"))).alias("path")))
_WORDS = ", ".join(f"'{w}'" for w in X.GENERIC_WORDS)
query("x13_tokens", f"with w as (select page_id, list_distinct(list_filter(string_split_regex(lower(url), '[^a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({_WORDS}))) as t from pages) select page_id, array_to_string(list_sort(t), ',') as tokens from w")(
    lambda s, d: _pages(s, d).select("page_id", F.array_join(F.sort_array(X.tokens(F.col("url"))), ",").alias("tokens"))
)
query("x14_label_tokens", f"with {D.PARTS} select node_id, lower(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(node_id || 'FooBar', '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+'), lambda x: x <> ''), ',')) as words from nodes")(
    lambda s, d: D.parts(s, d).select("node_id", F.array_join(X.label_tokens(F.concat("node_id", F.lit("FooBar"))), ",").alias("words"))
)
_LOW, _BUS = ", ".join(f"'{w}'" for w in X.LOW_SIGNAL), ", ".join(f"'{w}'" for w in X.BUSINESS)
query("x15_label_score", f"""with l as (select event_id, event_type || case event_id % 4 when 0 then ' api route' when 1 then '.node item' when 2 then ' GET /x' else ' state' end as t from events),
w as (select *, list_filter(string_split_regex(lower(trim(regexp_replace(t, '[^A-Za-z0-9]+', ' ', 'g'))), '\\s+'), lambda x: x <> '') as ws from l),
c as (select *, len(list_distinct(ws)) as n, len(list_filter(ws, lambda x: x in ({_LOW}))) as low, len(list_filter(ws, lambda x: x in ({_BUS}))) as bus from w)
select event_id, round(greatest(1, n) - low * 1.1 + bus * 1.8 + case when contains(t, '/') or regexp_matches(t, '(?i)\\b(get|post|put|delete|patch)\\b') then 2.4 else 0 end + case when regexp_matches(t, '[.:_]') then 0.4 else 0 end, 6)::double as score, bus = 0 and low >= greatest(1, n - 1) as low_signal from c""")(
    lambda s, d: D.table(s, d, "events").withColumn("r", X.label_score(F.expr("event_type || case event_id % 4 when 0 then ' api route' when 1 then '.node item' when 2 then ' GET /x' else ' state' end"))).select("event_id", F.col("r.score").alias("score"), F.col("r.low_signal").alias("low_signal"))
)
query("t4_label_choice", "select event_id as ord, 'run_' || event_type as label, event_type = 'click' as low_signal from events")(lambda s, d: _labels(s, d))


def _labels(s, d):
    from ..operators.labels import choose_labels

    e = D.runtime_nodes(s, d)
    return choose_labels(e.select("id", "type", "label", F.create_map(F.lit("handler"), F.concat(F.lit("run_"), F.col("type"))).alias("metadata"), "ord")).select("ord", F.col("best").alias("label"), "low_signal")


query("x16_diagnostic_code", "select event_id, case when event_id % 3 = 0 then 'RUNTIME_MY_EXTRACTOR_' || upper(event_type) else regexp_replace(regexp_replace(upper(event_type || '-x! ' || event_id), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') end as code from events")(
    lambda s, d: D.table(s, d, "events").select("event_id", X.diagnostic_code(F.expr("case when event_id % 3 = 0 then ' ' else event_type || '-x! ' || event_id end"), F.lit("MyExtractor"), F.col("event_type")).alias("code"))
)
query("x17_ratio", "select n_nationkey, case when n_nationkey % 5 = 0 then 0.0 else round(n_regionkey / (n_nationkey % 5), 6) end::double as r from nation")(lambda s, d: D.table(s, d, "nation").select("n_nationkey", X.ratio(F.col("n_regionkey"), F.col("n_nationkey") % 5).alias("r")))
query("x18_confidence", "select event_id, greatest(0.01, least(0.99, round((event_id % 130) / 120.0, 4)))::double as c from events")(lambda s, d: D.table(s, d, "events").select("event_id", X.confidence((F.col("event_id") % 130) / 120.0).alias("c")))
query("x19_ratio_confidence", "select event_id, greatest(0.0, least(0.95, 0.6 + 0.25 * greatest(0.0, (event_id % 100) / 100.0 - 0.4) / 0.4))::double as c from events")(lambda s, d: D.table(s, d, "events").select("event_id", X.ratio_confidence((F.col("event_id") % 100) / 100.0, F.lit(0.4)).alias("c")))
query("x20_fingerprints", "select source || '/' || doc_id as path, sha256(text) as sha256 from documents")(lambda s, d: V.fingerprints(_files(s, d)))
query("x21_language", f"with {D.PARTS} select language, count(*) as n from lang group by language")(lambda s, d: D.parts(s, d).groupBy(X.language(F.col("source_path")).alias("language")).agg(F.count(F.lit(1)).alias("n")))
_GH = "g as (select node_id, unnest(list_filter(demand, lambda x: x like '[Ghost:%')) as raw from nodes)"
query("x23_ghost_parts", f"with {D.PARTS}, {_GH} select node_id, raw, case when raw like '[Ghost:ReadWrite]%' then 'read_write' else 'read' end as mode, trim(regexp_extract(raw, '\\]\\s*(.*?)\\s*\\(', 1)) as type, regexp_extract(raw, '\\(([^()]+)\\)', 1) as target from g")(
    lambda s, d: D.parts(s, d).select("node_id", F.explode(F.filter("demand", K.is_ghost)).alias("raw")).withColumn("g", X.ghost_parts(F.col("raw"))).select("node_id", "raw", "g.mode", "g.type", "g.target")
)
query("x24_stack_frame", "select p_partkey, 'src/m' || (p_partkey % 9) || '.ts' as path, (p_partkey % 40)::int as line, 7 as col, 'Svc.run' as symbol from part")(
    lambda s, d: D.table(s, d, "part").withColumn("f", X.stack_frame(F.expr("'   at Svc.run (/home/app/src/m' || (p_partkey % 9) || '.ts:' || (p_partkey % 40) || ':7)'"), "/home/app")).select("p_partkey", F.col("f.path").alias("path"), F.col("f.line").alias("line"), F.col("f.column").alias("col"), F.col("f.symbol").alias("symbol"))
)
query("x25_diagnosis", "with d as (select event_id, case event_id % 5 when 0 then 'contract' when 1 then 'right_branch' when 2 then 'topology' when 3 then 'left_branch' else 'unknown' end as kind from events) select event_id, kind, case when kind = 'topology' then 'manual_review' when event_id % 7 >= 3 then 'create_child' else 'modify' end as action from d")(
    lambda s, d: D.table(s, d, "events").withColumn("kind", X.diagnosis(F.expr("case event_id % 5 when 0 then 'Schema validation failed' when 1 then 'bad settings' when 2 then 'Circular import' when 3 then 'Error: boom' else 'ok' end"))).select("event_id", "kind", X.action(F.col("kind"), F.col("event_id") % 7).alias("action"))
)
query("x28_within", "select event_id, epoch_ms(timestamp '2024-01-02 00:00:00') - epoch_ms(ts) < 24 * 3600 * 1000 as recent from events")(
    lambda s, d: D.table(s, d, "events").select("event_id", X.within(F.col("ts").cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp"), 24 * 3600).alias("recent"))
)
query("x27_ordered_json", "select n_nationkey, '{\"a\":' || n_nationkey || ',\"b\":\"' || n_name || '\"}' as j from nation")(lambda s, d: D.table(s, d, "nation").select("n_nationkey", X.ordered_json(b=F.col("n_name"), a=F.col("n_nationkey")).alias("j")))

# filters and categories

_CAT = f"{D.PREFIX_SQL}, best as (select distinct source_path, arg_max(category, length(prefix) * 100 - ord) as resolved from (select distinct source_path from nodes) join prefixes on source_path = prefix or starts_with(source_path, prefix || '/') group by source_path)"


def _paths(s, d):
    return D.parts(s, d).select("source_path").distinct()


query("f1_category", f"with {D.PARTS}, {_CAT} select n.source_path, coalesce(resolved, 'unknown') as resolved from (select distinct source_path from nodes) n left join best using (source_path)")(lambda s, d: L.categories(_paths(s, d), D.prefixes(s)))
query("f1b_category_default", f"with {D.PARTS}, {_CAT} select n.source_path, coalesce(resolved, 'core') as category from (select distinct source_path from nodes) n left join best using (source_path)")(
    lambda s, d: L.categories(_paths(s, d), D.prefixes(s)).select("source_path", F.when(F.col("resolved") == "unknown", "core").otherwise(F.col("resolved")).alias("category"))
)
query("c10_canonical", f"with {D.PARTS}, {_CAT} select node_id, coalesce(resolved, 'unknown') as category from nodes left join best using (source_path)")(lambda s, d: L.canonical(D.parts(s, d), D.prefixes(s))[0].select("node_id", "category"))
query("c10_diagnostics", f"with {D.PARTS}, {_CAT} select 'CATEGORY_MISMATCH_AUTO_FIXED' as code, node_id from nodes join best using (source_path) where resolved <> category")(lambda s, d: L.canonical(D.parts(s, d), D.prefixes(s))[1].select("code", "node_id"))
_SCOPES = [
    {"name": "web", "kind": "ui", "priority": 1, "prefixes": ["src/brand_1"]}, {"name": "tasks", "kind": "tasks", "segments": ["m7.py", "brand_2"], "excludes": ["brand_22"]},
    {"name": "go", "kind": "services", "globs": ["*.go"], "includes": ["src"]}, {"name": "rest", "kind": "other", "includes": ["src"]},
]
query("f2_scan_scope", f"""with {D.PARTS}, p as (select distinct source_path from nodes), z as (select source_path, case when starts_with(source_path, 'src/brand_1/') then 1012 else 0 end as a,
case when contains(source_path, '/brand_22/') then 0 else case (contains(source_path, '/m7.py')::int + contains(source_path, '/brand_2/')::int) when 0 then 0 when 1 then 510 else 520 end end as b, case when source_path like '%.go' then 310 else 210 end as c, 210 as e from p)
select source_path, case when a = greatest(a, b, c, e) then 'web' when b = greatest(a, b, c, e) then 'tasks' when c = greatest(a, b, c, e) then 'go' else 'rest' end as scope, greatest(a, b, c, e)::int as score from z""")(
    lambda s, d: L.scan_scope(_paths(s, d), _SCOPES).select("source_path", "scope", "score")
)
_FP = "case p_partkey % 8 when 0 then 'src/tests/a.ts' when 1 then 'src/x.spec.ts' when 2 then 'src/test_a.py' when 3 then 'src/.env.local' when 4 then 'src/gen/api.ts' when 5 then 'src/a/vendor/b.go' when 6 then 'lib/ok.py' else 'src/ok' || p_partkey || '.ts' end"
query("f3_excluded", "select p_partkey, p_partkey % 8 <= 5 as gone from part")(lambda s, d: D.table(s, d, "part").select("p_partkey", L.excluded(F.expr(_FP), ["gen"]).alias("gone")))
query("f4_in_scan", "select p_partkey, p_partkey % 8 = 7 as kept from part")(lambda s, d: D.table(s, d, "part").select("p_partkey", L.in_scan(F.expr(_FP), ["src"], ["gen"]).alias("kept")))
query("f8_ghost_nodes", f"with {D.PARTS} select node_id from lang where ghosts > 0")(lambda s, d: D.parts(s, d).where(T.has_ghost(F.col("demand"))).select("node_id"))
query("f9_execute_like", f"with {D.PARTS} select node_id from nodes where contains(lower(node_id), 'execute')")(lambda s, d: D.parts(s, d).where(T.execute_like(F.col("node_id"))).select("node_id"))
query("f10_name_roles", f"with {D.PARTS}, m as (select node_id, split_part(node_id, '.', 2) as m, problem from nodes) select node_id, m in ('execute', 'run', 'handle') as leads, m in ('build', 'parse', 'load') as helps from m")(
    lambda s, d: D.parts(s, d).withColumn("m", element(F.split("node_id", r"\."), -1)).select("node_id", T.orchestrates(F.col("m"), F.col("problem")).alias("leads"), T.helps(F.col("m")).alias("helps"))
)

# measures

query("a2_ghosts_by_language", f"with {D.PARTS} select language, count(*) as nodes, count(*) filter (ghosts > 0) as ghost_nodes, round(count(*) filter (ghosts > 0) / count(*), 6)::double as ghost_ratio from lang group by language")(lambda s, d: T.ghosts_by_language(D.parts(s, d)))
query("a6_vertices", f"with {D.PARTS} select category, split_part(node_id, '.', 1) as class, source_path, array_to_string(list_sort(list_distinct(flatten(list(demand)))), ',') as demand, count(*) as n from nodes group by all")(
    lambda s, d: T.vertices(D.parts(s, d)).select("category", "class", "source_path", F.array_join("demand", ",").alias("demand"), F.size("operations").cast("long").alias("n"))
)


def _one_path(s, d):
    return D.parts(s, d).withColumns({"source_path": F.lit("src/a.ts"), "category": F.lit("core")})


query("a7_completeness", f"""with {D.PARTS}, v as (select split_part(node_id, '.', 1) as class, count(*) as n, bool_or(len(list_filter(demand, lambda x: x not like '[Ghost:%' and x not in ('None', 'string (name)'))) > 0) as telling,
bool_or(split_part(node_id, '.', 2) in ('execute', 'run', 'handle')) as lead, bool_or(split_part(node_id, '.', 2) in ('build', 'parse', 'load')) as aid from nodes group by 1)
select class, not telling and lead and n >= 2 as left_only, n >= 3 and aid and lead as mixed from v""")(lambda s, d: T.completeness(T.vertices(_one_path(s, d))).select("class", "left_only", "mixed"))


def _policy(s, rows):
    return s.createDataFrame(rows, "language string, include boolean, top_k int, min_score int")


query("t3_ghost_violations", f"""with {D.PARTS}, m as (select language || ':' || node_id || ' disallows ghost in demand' as message from lang where language = 'python' and ghosts > 0
union select language || ':' || node_id || ' ghost demand ' || ghosts || ' exceeds topK=1' from lang where language = 'typescript' and ghosts > 1 union select language || ':' || node_id || ' ghost demand ' || ghosts || ' exceeds topK=2' from lang where language not in ('python', 'typescript') and ghosts > 2)
select message from m order by message limit 50""")(lambda s, d: T.ghost_violations(D.parts(s, d), _policy(s, [("default", True, 2, 4), ("python", False, 0, 5), ("typescript", True, 1, 4)])))
query("j16_policy_lookup", f"with {D.PARTS} select node_id, language, case language when 'python' then 0 when 'typescript' then 1 else 2 end as top_k from lang")(
    lambda s, d: T.lookup_policy(D.parts(s, d).select("node_id", X.language(F.col("source_path")).alias("language")), _policy(s, [("default", True, 2, 4), ("python", False, 0, 5), ("typescript", True, 1, 4)])).select("node_id", "language", "top_k")
)
query("t2_ghost_topk", f"""with {D.PARTS}, {_GH}, z as (select g.node_id, raw, language, contains(raw, 'ReadWrite') as rw, regexp_extract(raw, '\\]\\s*(.*?)\\s*\\(', 1) as type, regexp_extract(raw, '\\(([^()]+)\\)', 1) as target,
case when contains(raw, 'Db') then 1 when contains(raw, 'unknown') then 2 else 3 end as pos, regexp_matches(g.node_id, '(?i)(handle|handler)') as named from g join lang using (node_id)),
sc as (select *, (case when rw then 2 else 0 end + case when type <> 'unknown' then 3 else 0 end + case when regexp_matches(target, '(redis|queue)') then 2 else 0 end + case when target = 'ctx' then -2 else 0 end + case when type = 'unknown' then -1 else 0 end) as score from z)
select node_id, raw, score::int as score from sc""")(lambda s, d: T.govern_ghosts(D.parts(s, d), _policy(s, V.PARSER_GHOST_POLICY)).select("node_id", "raw", "score"))


def _diags(s, d):
    return D.table(s, d, "events").select(F.lit("info").alias("level"), F.expr("case event_type when 'error' then null when 'view' then 'RUNTIME_FRONTEND_API_ROUTE_UNMATCHED' else 'X' end").alias("code"), F.lit("c").alias("component"), F.lit("m").alias("message"))


_VEC = f"""with {D.PARTS}, v as (select category, split_part(node_id, '.', 1) as class, source_path, count(*) as n, bool_or(len(list_filter(demand, lambda x: x not like '[Ghost:%' and x not in ('None', 'string (name)'))) > 0) as telling,
bool_or(split_part(node_id, '.', 2) in ('execute', 'run', 'handle')) as lead, bool_or(split_part(node_id, '.', 2) in ('build', 'parse', 'load')) as aid from nodes group by 1, 2, 3),
vec as (select (select count(*) from nodes) as nodes, (select count(*) from nodes where contains(node_id, 'execute')) as execute_like_count, (select count(*) from lang where ghosts > 0) as ghost_nodes, (select count(*) from v) as vertices,
(select count(*) from v where not telling and lead and n >= 2) as left_only_vertices, (select count(*) from v where n >= 3 and aid and lead) as scale_mixing_vertices, (select count(*) from (select distinct event_type || '.' || (user_id % 50) from events)) as runtime_nodes, (select count(*) from events) as runtime_edges,
(select count(*) from events) as diagnostics_total, (select count(*) from events where event_type = 'error') as diagnostics_no_code, (select count(*) from events where event_type = 'view') as runtime_unmatched_route_count)"""


def _vector(s, d):
    rn = D.runtime_nodes(s, d).select("id").distinct()
    return T.metric_vector(D.parts(s, d), rn, D.runtime_edges(s, d), _diags(s, d), _policy(s, [("default", True, 99, 0)]))


_COLS = ["nodes", "execute_like_count", "ghost_nodes", "vertices", "left_only_vertices", "scale_mixing_vertices", "runtime_nodes", "runtime_edges", "diagnostics_total", "diagnostics_no_code", "runtime_unmatched_route_count"]
query("a3_metric_vector", f"{_VEC} select {', '.join(_COLS)}, round(execute_like_count / nodes, 6)::double as execute_like_ratio, round(ghost_nodes / nodes, 6)::double as ghost_ratio from vec")(lambda s, d: _vector(s, d).select(*_COLS, "execute_like_ratio", "ghost_ratio"))
def _whole_vector(s, d):
    """The measures with class blueprints and focus references, under the policy of governed runs, which python parts break."""
    from .queries_files import _classes, _references

    rn = D.runtime_nodes(s, d).select("id").distinct()
    return T.metric_vector(D.parts(s, d), rn, D.runtime_edges(s, d), _diags(s, d), _policy(s, V.GHOST_POLICY), classes=_classes(s, d), references=_references(s, d))


def _verify_sql() -> str:
    from .queries_files import FOCUS

    flag = lambda x: f"case when {x} then 'pass' else 'fail' end"
    checks = {
        "diagnostics_no_code": flag("diagnostics_no_code <= 0"), "execute_like_ratio": flag("execute_like_count / nodes < 0.1"), "ghost_ratio": flag("ghost_nodes / nodes < 0.4"), "rendered_edges_consistency": "'pass'",
        "ghost_policy_compliance": flag("not exists (select 1 from lang where language in ('python', 'javascript') and ghosts > 0)"), "left_only_vertices": flag("left_only_vertices + l = 0"), "right_only_vertices": flag("r = 0"), "empty_vertices": flag("e = 0"),
        "scale_mixing_vertices": flag("scale_mixing_vertices + m = 0"), "triad_completeness": flag("left_only_vertices + l + r + e + scale_mixing_vertices + m = 0"), "protocol_focus_alignment": flag("not exists (select 1 from drift)"), "triad_focus_closure": flag("z = 0"),
        "runtime_unmatched_route_count": flag("runtime_unmatched_route_count <= 1100"),
    }
    plans = """pl as (select split_part(node_id, '.', 1) as class_name, category, count(*) filter (ord % 4 <> 0) as st, count(*) filter (ord % 5 <> 0) as dy, bool_or(ord % 5 <> 0 and split_part(node_id, '.', 2) in ('execute', 'run', 'handle')) as lead, bool_or(ord % 5 <> 0 and split_part(node_id, '.', 2) in ('build', 'parse', 'load')) as aid from nodes group by 1, 2),
    pf as (select class_name, bool_or(st = 0 and dy > 0) as l, bool_or(st > 0 and dy = 0) as r, bool_or(st = 0 and dy = 0) as e, bool_or(dy >= 2 and lead and aid) as m from pl group by 1),
    pk as (select count(*) filter (l) as l, count(*) filter (r) as r, count(*) filter (e) as e, count(*) filter (m) as m from pf)"""
    body = " union all ".join(f"select '{k}' as key, {v} as status from vec, pk, cz" for k, v in checks.items())
    return f"{_VEC}, {FOCUS}, {plans}, cz as (select count(*) as z from closed) {body}"


query("c1_verify", _verify_sql())(lambda s, d: T.verify(_whole_vector(s, d), 1000).select("key", "status"))
#: How many parts of the contract graph have six consumers or more.
_FAN = "fan as (select count(*) as wide from (select src from n_edges where src <> dst group by src having count(distinct dst) >= 6))"


def _findings(s, d):
    nodes = D.parts(s, d)
    wide = E.fanout_counts(E.produced(nodes), E.required(nodes), 6).agg(F.count(F.lit(1)).alias("wide"))
    return advice.findings(_vector(s, d).join(wide), F.col("wide"))  # one row each


query("c8_findings", f"""{_VEC}, {_FAN} select 'FINDING_EXECUTE_RATIO_HIGH' as finding, 'warning' as severity from vec where round(execute_like_count / nodes, 6) >= 0.1 union all select 'FINDING_GHOST_RATIO_HIGH', 'warning' from vec where round(ghost_nodes / nodes, 6) >= 0.4
union all select 'FINDING_RUNTIME_UNMATCHED_ROUTES', case when runtime_unmatched_route_count > 22 then 'error' else 'warning' end from vec where runtime_unmatched_route_count > 0 union all select 'FINDING_RUNTIME_DIAGNOSTICS_NO_CODE', 'error' from vec where diagnostics_no_code > 0
union all select 'FINDING_HIGH_FANOUT_CAPABILITY', 'warning' from fan where wide > 0""")(lambda s, d: _findings(s, d).select("finding", "severity"))
query("t5_proposal_ranking", f"""{_VEC}, {_FAN}, q as (select *, round(execute_like_count / nodes, 6) as er, round(ghost_nodes / nodes, 6) as gr, runtime_unmatched_route_count as n from vec),
p as (select 'DIAGNOSTICS_CONTRACT_ENFORCEMENT' as proposal, 'high' as priority, 0.95 as confidence from q where diagnostics_no_code > 0
union all select 'CAPABILITY_EXECUTE_DENOISE', 'high', least(0.92, greatest(0, least(0.95, 0.6 + 0.25 * greatest(0, er - 0.1) / 0.1))) from q where er >= 0.1 union all select 'GHOST_SIGNAL_REBALANCE', 'high', least(0.9, greatest(0, least(0.95, 0.6 + 0.25 * greatest(0, gr - 0.4) / 0.4))) from q where gr >= 0.4
union all select 'RUNTIME_ROUTE_ALIGNMENT', 'medium', least(0.88, least(0.95, 0.55 + n * 0.02)) from q where n > 0 union all select 'SPLIT_HIGH_FANOUT', 'medium', 0.79 from fan where wide > 0)
select proposal, priority, confidence::double as confidence from p where confidence >= 0.55 order by priority = 'high' desc, confidence desc, proposal limit 5""")(lambda s, d: advice.proposals(_findings(s, d)).select("proposal", "priority", "confidence"))


def _rules(s, rows):
    return s.createDataFrame(rows, "key string, op string, num double, flag boolean, must_pass boolean")


query("j17_rules", f"""{_VEC} select 'diagnostics_no_code' as key, case when diagnostics_no_code = 0 then 'pass' else 'fail' end as status from vec union all select 'execute_like_ratio', case when round(execute_like_count / nodes, 6) < 0.1 then 'pass' else 'fail' end from vec
union all select 'ghost_ratio', case when round(ghost_nodes / nodes, 6) < 0.4 then 'pass' else 'fail' end from vec union all select 'rendered_edges_consistency', 'pass' union all select 'runtime_unmatched_route_count', case when runtime_unmatched_route_count <= ceil(1000 * 1.1) then 'pass' else 'fail' end from vec union all select 'absent', 'error'""")(
    lambda s, d: V.evaluate(_rules(s, [(k, op, n, f, True) for k, op, n, f in V.REQUIRED_RULES] + [("absent", "lt", 1.0, None, True)]), T.as_metrics(_vector(s, d)), 1000.0).select("key", "status")
)
_BROKEN = "(diagnostics_no_code <> 0 or round(execute_like_count / nodes, 6) >= 0.1 or round(ghost_nodes / nodes, 6) >= 0.4 or runtime_unmatched_route_count > ceil(1000 * 1.1))"
query("c7_gate", f"{_VEC} select case when {_BROKEN} then 2 else 0 end as exit_code, not {_BROKEN} as passed from vec")(lambda s, d: V.gate(V.evaluate(_rules(s, [(k, op, n, f, True) for k, op, n, f in V.REQUIRED_RULES]), T.as_metrics(_vector(s, d)), 1000.0).unionByName(V.schema_check(_diags(s, d).na.fill("X", ["code"])))))
query("c7_gate_error", "select case when bool_or(event_type = 'error') then 5 else 0 end as exit_code, not bool_or(event_type = 'error') as passed from events")(lambda s, d: V.gate(V.schema_check(_diags(s, d))))

# coverage: documents as files

_FILES = "f as (select source || '/' || doc_id as file, source, lang, doc_id in (select doc_id from labels where quality = 1) as t, doc_id in (select doc_id from labels where toxic = 1) as r from documents)"


def _files(s, d):
    return D.table(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def _cov_files(s, d):
    return _files(s, d).select(F.col("path").alias("file"))


def _labelled(s, d, col):
    ids = D.table(s, d, "labels").where(f"{col} = 1").select("doc_id")
    return D.table(s, d, "documents").join(ids, "doc_id", "left_semi").select(F.upper(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("source_path"))


query("j5_covered", f"with {_FILES} select file from f where t")(lambda s, d: T.covered(_labelled(s, d, "quality"), _cov_files(s, d))[0])
query("j5_outside", "select 'x/' || n_nationkey as source_path from nation order by 1 limit 20")(lambda s, d: T.covered(D.table(s, d, "nation").select(F.concat(F.lit("x/"), F.col("n_nationkey").cast("string")).alias("source_path")), _cov_files(s, d))[1])


def _flagged(s, d):
    q, t = (D.table(s, d, "labels").where(f"{c} = 1").select("doc_id", F.lit(True).alias(f)) for c, f in (("quality", "t"), ("toxic", "r")))
    return D.table(s, d, "documents").join(q, "doc_id", "left").join(t, "doc_id", "left").na.fill(False, ["t", "r"]).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), "lang", "t", "r")


query("a4_buckets", f"with {_FILES} select lang as bucket, count(*) as total, count(*) filter (t) as declared, count(*) filter (r) as runtime, count(*) filter (t or r) as combined, round(count(*) filter (t or r) / count(*), 6)::double as combined_coverage, array_to_string(list_sort(list(file) filter (not (t or r)))[1:20], ',') as uncovered from f group by lang")(
    lambda s, d: T.buckets(_flagged(s, d), F.col("lang")).select("bucket", "total", "declared", "runtime", "combined", "combined_coverage", F.array_join("uncovered_samples", ",").alias("uncovered"))
)
query("u3_union_covered", f"with {_FILES} select file from f where t or r")(lambda s, d: T.covered(_labelled(s, d, "quality"), _cov_files(s, d))[0].unionByName(T.covered(_labelled(s, d, "toxic"), _cov_files(s, d))[0]).distinct())


def _roots(s):
    return s.createDataFrame([("a", "src1", 0), ("a", "src2", 1), ("b", "src1/5", 2), ("c", "nowhere", 3)], "category string, prefix string, ord int")


query("c4_coverage", f"""with {_FILES}, b as (select 'summary' as scope, 'summary' as bucket, * from f union all select 'category', case when source in ('src1', 'src2') then 'a' end, * from f where source in ('src1', 'src2') union all select 'root', source, * from f where source in ('src1', 'src2')),
w as (select * from (values ('summary', 'summary'), ('category', 'a'), ('category', 'b'), ('category', 'c'), ('root', 'src1'), ('root', 'src2'), ('root', 'src1/5'), ('root', 'nowhere')) t(scope, bucket))
select w.scope, w.bucket, count(file) as total, count(*) filter (t) as declared, count(*) filter (r) as runtime, count(*) filter (t or r) as combined from w left join b using (scope, bucket) group by all""")(
    lambda s, d: T.coverage(_cov_files(s, d), _labelled(s, d, "quality"), _labelled(s, d, "toxic"), _roots(s)).select("scope", "bucket", "total", "declared", "runtime", "combined")
)
query("j17_coverage_gates", f"with {_FILES} select 'coverage_gate.category.a' as key, case when count(*) filter (t or r) / count(*) >= 0.2 then 'pass' else 'fail' end as status from f where source in ('src1', 'src2') union all select 'coverage_gate.root.nowhere', 'fail'")(
    lambda s, d: V.coverage_gates(s.createDataFrame([("category", "a", "combined", "gte", 0.2, True), ("root", "nowhere", "runtime", "gt", 0.0, False)], "scope string, target string, metric string, op string, value double, must_pass boolean"), T.coverage(_cov_files(s, d), _labelled(s, d, "quality"), _labelled(s, d, "toxic"), _roots(s))).select("key", "status")
)
query("j15_manifest_diff", "select source || '/' || doc_id as path, case when doc_id % 10 = 0 then 'added' when doc_id % 10 = 1 then 'removed' else 'changed' end as change from documents where doc_id % 10 in (0, 1, 2)")(
    lambda s, d: V.manifest_diff(V.fingerprints(_files(s, d).where("not path like '%0'")), V.fingerprints(_files(s, d).where("not path like '%1'").withColumn("content", F.when(F.col("path").like("%2"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))))
)
query("a17_modules", f"with {D.PARTS} select split_part(node_id, '.', 1) as module, count(*) as size, arg_min(source_path, ord) as source_path from nodes group by 1")(lambda s, d: T.modules(D.parts(s, d)).select("module", "size", "source_path"))
query("a13_legend", "select event_type as label, count(*) as n from events group by 1")(lambda s, d: D.table(s, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label"))
query("a16_counters", f"with {D.PARTS} select count(*) as vertices, count(*) filter (category = 'core') as core, count(*) filter (ghosts > 0) as ghosts from lang")(
    lambda s, d: D.parts(s, d).agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("category") == "core").alias("core"), F.count_if(T.has_ghost(F.col("demand"))).alias("ghosts"))
)
query("p2_visual_size", f"with {D.RUNTIME}, {D.RUNTIME_EDGES}, g as (select x as node_id, count(*) as degree from re, unnest([src, dst]) u(x) group by x) select node_id, degree, greatest(18, least(42, 18 + floor(log2(greatest(1, degree + 1)) * 8)))::int as size from g")(
    lambda s, d: E.end_degree(D.runtime_edges(s, d)).select("node_id", "degree", F.greatest(F.lit(18), F.least(F.lit(42), 18 + F.floor(F.log2(F.greatest(F.lit(1), F.col("degree") + 1)) * 8))).cast("int").alias("size"))
)

# links

query("j6_capability_leaves", """with c as (select 'S' || (p_partkey % 80) || '.run' as capability_id, 'p' || (p_partkey % 40) as path, ['S' || (p_partkey % 33) || '.load'] as folded, p_partkey from part),
l as (select 'S' || (p_partkey % 90) || case p_partkey % 3 when 0 then '.run' when 1 then '.load' else '.x' || p_partkey end as leaf_id, 'p' || (p_partkey % 40) as path, p_partkey as ord from part),
o as (select *, row_number() over (partition by split_part(leaf_id, '.', 1), path order by ord) as rank from l),
r as (select capability_id, leaf_id, 0 as pos, 'exact' as relation from c join (select distinct leaf_id from l) on capability_id = leaf_id union all select capability_id, x, 1, 'folded_leaf' from c, unnest(folded) u(x) where x in (select leaf_id from l)
union all select capability_id, leaf_id, 2, 'owner_match' from c join o on o.path = c.path and split_part(leaf_id, '.', 1) = split_part(capability_id, '.', 1) and rank <= 12)
select capability_id, leaf_id, arg_min(relation, pos) as relation from r group by all""")(
    lambda s, d: _leaf_rows(s, d)
)


def _leaf_rows(s, d):
    return L.capability_leaves(
        D.table(s, d, "part").select(F.expr("'S' || (p_partkey % 80) || '.run'").alias("node_id"), F.expr("'p' || (p_partkey % 40)").alias("source_path"), F.array(F.expr("'S' || (p_partkey % 33) || '.load'")).alias("folded_leaves")),
        D.table(s, d, "part").select(F.expr("'S' || (p_partkey % 90) || case p_partkey % 3 when 0 then '.run' when 1 then '.load' else '.x' || p_partkey end").alias("node_id"), F.expr("'p' || (p_partkey % 40)").alias("source_path"), F.col("p_partkey").alias("ord")),
    ).select("capability_id", "leaf_id", "relation")


def _link_rows(s, d):
    k = D.dealt(D.table(s, d, "part").select("p_partkey", "p_name", "p_type"))
    caps = k.select(F.expr("'Shop.' || replace(p_name, ' ', '.') || '.m' || p_partkey").alias("node_id"), F.expr("'src/' || lower(p_type) || '/f' || (p_partkey % 23) || '.py'").alias("source_path"), F.expr("case p_partkey % 3 when 0 then 'core' when 1 then 'backend' end").alias("category"))
    run = k.select(F.expr("'Service.' || split_part(p_name, ' ', 1) || '.m' || (p_partkey * 4)").alias("id"), F.col("p_name").alias("label"), F.array(F.expr("'src/' || lower(p_type) || '/f' || (p_partkey % 23) || '.py'")).alias("source_paths"), F.expr("case p_partkey % 2 when 0 then 'core' end").alias("category"), F.expr("case when p_partkey % 5 = 0 then 'm' || (p_partkey * 8) end").alias("handler"))
    return run, caps


_J7 = f"""c as (select 'Shop.' || replace(p_name, ' ', '.') || '.m' || p_partkey as cid, 'src/' || lower(p_type) || '/f' || (p_partkey % 23) || '.py' as path, coalesce(case p_partkey % 3 when 0 then 'core' when 1 then 'backend' end, 'unknown') as cat from part),
r as (select 'Service.' || split_part(p_name, ' ', 1) || '.m' || (p_partkey * 4) as rid, p_name as label, 'src/' || lower(p_type) || '/f' || (p_partkey % 23) || '.py' as rpath, coalesce(case p_partkey % 2 when 0 then 'core' end, 'unknown') as rcat, coalesce(case when p_partkey % 5 = 0 then 'm' || (p_partkey * 8) end, '') as handler from part),
ct as (select *, list_distinct(list_filter(string_split_regex(lower(cid || ' ' || path), '[^a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({_WORDS}))) as ctok from c),
rt as (select *, list_distinct(list_filter(string_split_regex(lower(rid || ' ' || label || ' ' || rpath), '[^a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({_WORDS}))) as rtok from r),
s as (select rid, cid, case when rpath = path then 65 else 0 end + case when rcat = cat then 18 else -8 end + case when handler <> '' and contains(lower(cid), handler) then 34 else 0 end
    + case when contains(lower(cid), lower(split_part(rid, '.', 2))) and contains(lower(cid), lower(split_part(rid, '.', 3))) then 40 else 0 end + least(24, 6 * len(list_intersect(rtok, ctok))) as score from rt, ct),
linked as (select rid as runtime_id, cid as capability_id, score::int as score, row_number() over (partition by rid order by score desc, cid)::int as rank from (select distinct * from s) where score >= 35 qualify row_number() over (partition by rid order by score desc, cid) <= 6)"""
query("j7_runtime_links", f"with {_J7} select * from linked")(
    lambda s, d: L.runtime_capabilities(*_link_rows(s, d)).select("runtime_id", "capability_id", "score", "rank")
)
_CONF = "greatest(0.01, least(0.99, round({0}, 4)))::double"
_LINKS = f"""{_J7}, cl as (select a.cid, b.cid as lid, case when a.cid = b.cid then 'exact' else 'owner_match' end as relation, case when a.cid = b.cid then 0.99 else 0.78 end as conf from (select distinct cid, path from c) a
    join (select distinct cid, path from c) b on a.cid = b.cid or (a.path = b.path and regexp_replace(a.cid, '\\.[^.]+$', '') = regexp_replace(b.cid, '\\.[^.]+$', ''))),
rc as (select runtime_id as rid, capability_id as cid, score from linked where rank <= 3), rl as (select rid, lid, max({_CONF.format("score / 120.0")}) as conf from rc join cl using (cid) group by all),
one as (select 'capability' as fv, cid as f, relation, 'leaf' as tv, lid as t, conf::double as conf from cl union all select 'runtime', rid, 'runtime_capability', 'capability', cid, {_CONF.format("score / 100.0")} from rc union all select 'runtime', rid, 'runtime_leaf_derived', 'leaf', lid, conf from rl),
links as (select * from one union all select tv, t, relation, fv, f, conf from one)"""
query("j8_runtime_leaves", f"""with {_J7}, cl as (select a.cid, b.cid as lid from (select distinct cid, path from c) a join (select distinct cid, path from c) b on a.cid = b.cid or (a.path = b.path and regexp_replace(a.cid, '\\.[^.]+$', '') = regexp_replace(b.cid, '\\.[^.]+$', '')))
select runtime_id, lid as leaf_id, max({_CONF.format("score / 120.0")}) as confidence from linked join cl on cl.cid = capability_id group by all""")(lambda s, d: _runtime_leaves(s, d))
query("c6_view_map", f"with {_LINKS} select fv || '::' || f || '::' || relation || '::' || tv || '::' || t as id, relation, max(conf) as confidence from links group by all")(lambda s, d: _view_map(s, d))


def _view_rows(s, d):
    run, caps = _link_rows(s, d)
    return run, caps.withColumn("folded_leaves", F.array().cast("array<string>")), caps.withColumn("ord", F.xxhash64("node_id"))


def _runtime_leaves(s, d):
    run, caps, leaves = _view_rows(s, d)
    return L.runtime_leaves(L.runtime_capabilities(run, caps), L.owner_links(caps, leaves))


def _view_map(s, d):
    return L.view_map(*_view_rows(s, d)).select("id", "relation", "confidence")


def _view_stats(s, d):
    return L.view_stats(*_view_rows(s, d))


query("a12_link_stats", f"""with {_LINKS}, n as (select (select count(distinct rid) from r) as runtime_nodes, (select count(distinct cid) from c) as capability_nodes, (select count(distinct cid) from c) as leaf_nodes, count(*) as link_count,
count(*) filter (fv = 'runtime' and tv = 'capability') as runtime_capability_links, count(*) filter (fv = 'capability' and tv = 'leaf') as capability_leaf_links, count(*) filter (fv = 'runtime' and tv = 'leaf') as runtime_leaf_links,
count(distinct case when fv = 'runtime' and tv = 'capability' then f end) as runtime_matched, count(distinct case when fv = 'capability' and tv = 'leaf' then f end) as capability_matched, count(distinct case when fv = 'capability' and tv = 'leaf' then t end) as leaf_matched, count(distinct case when fv = 'runtime' and tv = 'leaf' then f end) as end_to_end from (select distinct fv, f, relation, tv, t from links))
select *, round(runtime_matched / runtime_nodes, 6)::double as runtime_match_rate, round(capability_matched / capability_nodes, 6)::double as capability_leaf_rate, round(leaf_matched / leaf_nodes, 6)::double as leaf_capability_rate, round(end_to_end / runtime_nodes, 6)::double as end_to_end_rate from n""")(_view_stats)
_CALLS = "case page_id % 3 when 0 then '/api/items/' || (page_id % 5) || '/run' when 1 then '/api/v1/users' else '/nope/' || page_id end"
query("j10_match_routes", "select page_id as call_id, case page_id % 3 when 0 then 'r2' else 'r1' end as route_id from pages where page_id % 3 <> 2")(
    lambda s, d: L.match_routes(
        D.table(s, d, "pages").select(F.col("page_id").alias("call_id"), F.lit("get").alias("method"), F.expr(_CALLS).alias("path")),
        s.createDataFrame([("r1", "GET", "/users", 0), ("r2", "GET", "/items/{id}/run", 1), ("r3", "POST", "/items/{id}/run", 2), ("r4", "GET", "/items/:x/:y", 3)], "route_id string, method string, path string, ord int"),
    )
)
query("u5_token_overlap", """with b as (select item_id, unnest(list_distinct(string_split(lower(text), ' '))) as w from benchmark), t as (select doc_id, unnest(list_distinct(string_split(lower(text), ' '))) as w from documents)
select item_id, doc_id, count(*) as n from b join t using (w) group by all having count(*) >= 2""")(lambda s, d: _overlap(s, d))


def _overlap(s, d):
    # words meet by equality and are counted per pair; no pair without a shared word is made
    words = lambda t, i: t.select(i, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    return words(D.table(s, d, "benchmark"), "item_id").join(words(D.table(s, d, "documents"), "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


query("c13_stage", "select p_partkey, case p_partkey % 4 when 0 then 'draft_review' when 1 then 'micro_gated' when 2 then 'meso' else 'planning' end as stage from part")(
    lambda s, d: D.table(s, d, "part").withColumn("k", F.col("p_partkey") % 4).select("p_partkey", T.stage_of(F.col("k") == 0, F.lit(False), F.col("k") == 1, F.col("k") == 2, F.lit(False), F.col("k") == 1).alias("stage"))
)
def _samples(s, d):
    told = top_by(D.table(s, d, "events").select("event_type", "user_id").distinct(), ["event_type"], 1 << 30, F.col("user_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.col("user_id")))).alias("u"))
    return told.select("event_type", "n", F.concat(F.array_join(F.col("u").cast("array<string>"), ", "), F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise("")).alias("message"))


query("a18_diagnostic_samples", "with x as (select event_type, list_sort(list(distinct user_id)) as u from events group by 1) select event_type, len(u) as n, array_to_string(u[1:5], ', ') || case when len(u) > 5 then ' (+' || (len(u) - 5) || ' more)' else '' end as message from x")(
    lambda s, d: _samples(s, d)
)
