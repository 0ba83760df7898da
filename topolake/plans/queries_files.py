"""Queries of extraction, promotion, file scans, change tracking and streams over source files derived from parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as X
from ..functions.scalars import element
from ..operators import canonical, edges as E, focus, healing, knowledge, labels
from ..operators.extract import imports, promote, rows as R, runtime as RT, signatures as SG
from ..operators.linkage import best_frame_node
from ..operators.shared import cut
from ..sources import datasets, files as FS
from ..sources.config import Parser
from ..streaming import auto_run
from . import derive as D
from .queries_graph import query

_CODE = """case p_partkey % 5
when 0 then concat('from fastapi import FastAPI', chr(10), '@router.post("/items/{id}/run', p_partkey % 7, '")', chr(10), 'async def run_', p_partkey, '(id: str) -> Result:', chr(10), '    item_service.run_item(id)', chr(10))
when 1 then concat('export function load', p_partkey, '(id) {', chr(10), '  return fetch("/api/items/12/run', p_partkey % 9, '", { method: "POST" })', chr(10), '}', chr(10))
when 2 then concat('@app.task', chr(10), 'def work_', p_partkey, '(x):', chr(10), '    order_service.go(x)', chr(10))
when 3 then concat('import redis', chr(10), 'class Store', p_partkey, 'Service:', chr(10), '    def execute(self, order: Order) -> Receipt:', chr(10), '        return redis.get(order)', chr(10), '    def _hide(self):', chr(10), '        pass', chr(10))
else concat('flow.add_node("A', p_partkey % 9, '")', chr(10), 'flow.add_edge("A', p_partkey % 9, '", "B")', chr(10)) end"""
_PATH = "case p_partkey % 5 when 0 then concat('api/f', p_partkey, '.py') when 1 then concat('frontend/pages/p', p_partkey, '.ts') when 2 then concat('tasks/t', p_partkey, '.py') when 3 then concat('stores/s', p_partkey, '.py') else concat('flows/w', p_partkey, '.ts') end"


def source_files(s: SparkSession, d: str) -> DataFrame:
    keys = D.dealt(D.table(s, d, "part").select("p_partkey"))
    rows = keys.select(F.expr(_PATH).alias("path"), F.expr(_CODE).alias("content"))
    return rows.withColumn("language", FS.file_kind(F.col("path")))


def _found(s, d, f):
    return R.run(source_files(s, d), [("x", f)])


def _nodes(s, d, f):
    return _found(s, d, f).where("kind = 'node'")


query("e1_http_routes", "select 'ApiRoute' as type, 'ApiRoute.POST./items/{id}/run' || (p_partkey % 7) as id, count(*) as n from part where p_partkey % 5 = 0 group by all union all select 'Service', 'Service.ItemService.run_item', count(*) from part where p_partkey % 5 = 0")(
    lambda s, d: _nodes(s, d, RT.http_routes).groupBy("type", "id").agg(F.count(F.lit(1)).alias("n"))
)
query("e2_frontend_calls", "select 'POST' as method, '/api/items/12/run' || (p_partkey % 9) as path, count(*) as n from part where p_partkey % 5 = 1 group by all")(
    lambda s, d: _found(s, d, RT.frontend_calls).where("kind = 'call'").groupBy(F.col("type").alias("method"), F.col("label").alias("path")).agg(F.count(F.lit(1)).alias("n"))
)
query("e2_known_routes", "select distinct 'ApiRoute.POST./items/{id}/run' || (p_partkey % 7) as id from part where p_partkey % 5 = 0")(lambda s, d: _found(s, d, RT.known_routes).where("kind = 'route'").select("id").distinct())
query("e3_task_queues", "with t as (select p_partkey as k from part where p_partkey % 5 = 2) select 'consumes' as type, count(*) as n from t union all select 'dispatches', count(*) from t union all select 'executes', count(*) from t")(
    lambda s, d: _found(s, d, RT.task_queues).where("kind = 'edge'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
)
query("e4_workflows", "with t as (select p_partkey % 9 as a, count(*) as n from part where p_partkey % 5 = 4 group by 1) select 'WorkflowNode.A' || a as id, 2 * n as n from t union all select 'WorkflowNode.B', sum(n)::bigint from t union all select 'Workflow.flow', 2 * sum(n)::bigint from t union all select 'WorkflowEdge.A' || a || '-_B', n from t")(
    lambda s, d: _nodes(s, d, RT.workflows).groupBy(F.regexp_replace("id", "->|-_+", "-_").alias("id")).agg(F.count(F.lit(1)).alias("n"))
)
query("e5_resources", """select 'reads' as type, 'Service.execute' as src, 'Cache.Redis' as dst, count(*) as n from part where p_partkey % 5 = 3 having count(*) > 0 union all select 'caches', 'Service.stores/s' || p_partkey, 'Cache.Redis', 1 from part where p_partkey % 5 = 3
union all select 'calls', 'Service.load' || p_partkey, 'ExternalApi.HTTP', 1 from part where p_partkey % 5 = 1""")(
    lambda s, d: _found(s, d, RT.resources).where("kind = 'edge'").groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
)
query("e6_infra", "select case p_partkey % 3 when 0 then 'Cache.Redis' when 1 then 'DataStore.Postgres' else 'ObjectStore.MinIO' end as id, count(*) as n from part group by 1")(
    lambda s, d: R.run(
        D.dealt(D.table(s, d, "part").select("p_partkey")).select(F.expr("concat('a', p_partkey, '/docker-compose.yml')").alias("path"), F.lit("yaml").alias("language"), F.expr("concat('services:', chr(10), '  ', case p_partkey % 3 when 0 then 'redis' when 1 then 'db' else 'minio' end, ':', chr(10), '    image: ', case p_partkey % 3 when 0 then 'redis:7' when 1 then 'postgres:16' else 'minio/minio' end, chr(10))").alias("content")), [("infra", RT.infra)]
    ).where("kind = 'node'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
)


def _fails(find):
    if find.path.endswith("0.py"):
        raise ValueError("broken plug-in")
    find.node("ok", "Service", "ok", "call", "x", 0, 0.5)


query("e7_failure_isolation", "with f as (select p_partkey % 10 = 0 as bad from part) select case when bad then 'diag' else 'node' end as kind, count(*) as n from f group by 1")(lambda s, d: R.run(source_files(s, d), [("plug-in", _fails)]).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


query("e7_topology", """with e as (select 'calls' as type, 2 * count(*) as n from part where p_partkey % 5 = 1 union all select 'invokes', count(distinct p_partkey % 7) from part where p_partkey % 5 = 0
union all select 'consumes', least(1, count(*)) from part where p_partkey % 5 = 2 union all select 'dispatches', count(*) from part where p_partkey % 5 = 2 union all select 'executes', count(*) from part where p_partkey % 5 = 2
union all select 'contains', count(distinct p_partkey % 9) * 2 from part where p_partkey % 5 = 4 union all select 'connects', count(distinct p_partkey % 9) from part where p_partkey % 5 = 4
union all select 'caches', count(*) from part where p_partkey % 5 = 3 union all select 'reads', least(1, count(*)) from part where p_partkey % 5 = 3) select type, n::bigint as n from e where n > 0""")(
    lambda s, d: RT.topology(source_files(s, d))[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))
)
query("e8_leaf_nodes", """select 'F' || p_partkey || '.run_' || p_partkey as node_id, 'str (id)' as demand, 'Result' as answer from part where p_partkey % 5 = 0 union all select 'P' || p_partkey || '.load' || p_partkey, 'unknown (id)', 'unknown' from part where p_partkey % 5 = 1
union all select 'T' || p_partkey || '.work_' || p_partkey, 'unknown (x)', 'void' from part where p_partkey % 5 = 2 union all select 'Store' || p_partkey || 'Service.execute', 'Order (order),[Ghost:Read] module (redis)', 'Receipt' from part where p_partkey % 5 = 3
union all select 'Store' || p_partkey || 'Service._hide', 'None', 'void' from part where p_partkey % 5 = 3""")(
    lambda s, d: SG.leaves(SG.extract(source_files(s, d))).select("node_id", F.array_join("demand", ",").alias("demand"), F.array_join("answer", ",").alias("answer"))
)
query("c11_sync", """select 'F' || p_partkey || '.run_' || p_partkey as node_id, 'core' as category, 'api/f' || p_partkey || '.py' as source_path, 'str (id)' as demand, 'Result' as answer from part where p_partkey % 5 = 0 union all select 'P' || p_partkey || '.load' || p_partkey, 'web', 'frontend/pages/p' || p_partkey || '.ts', 'unknown (id)', 'unknown' from part where p_partkey % 5 = 1
union all select 'T' || p_partkey || '.work_' || p_partkey, 'core', 'tasks/t' || p_partkey || '.py', 'unknown (x)', 'void' from part where p_partkey % 5 = 2 union all select 'Store' || p_partkey || 'Service.execute', 'core', 'stores/s' || p_partkey || '.py', 'Order (order),[Ghost:Read] module (redis)', 'Receipt' from part where p_partkey % 5 = 3
union all select 'Store' || p_partkey || 'Service._hide', 'core', 'stores/s' || p_partkey || '.py', 'None', 'void' from part where p_partkey % 5 = 3""")(
    lambda s, d: SG.sync(source_files(s, d), s.createDataFrame([("web", "frontend", 0), ("core", "api", 1), ("core", "tasks", 2), ("core", "stores", 3)], "category string, prefix string, ord int"))[0]
    .select("node_id", "category", "source_path", F.array_join("demand", ",").alias("demand"), F.array_join("answer", ",").alias("answer"))
)
query("e12_registrations", "select 'Item' || (p_partkey % 7) || 's' as owner, 'list_' || p_partkey as name from part")(
    lambda s, d: SG.extract(D.dealt(D.table(s, d, "part").select("p_partkey")).select(F.concat(F.lit("api/r"), F.col("p_partkey").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), F.concat(F.lit("app.get('/v/item"), (F.col("p_partkey") % 7).cast("string"), F.lit("s/:id', list_"), F.col("p_partkey").cast("string"), F.lit(")")).alias("content"), F.lit("api").alias("kind"))).select("owner", "name")
)
query("j20_imports", "select 'pkg/u' || p_partkey || '.py' as source_path, 'pkg/m' || (p_partkey % 5) || '.py' as defined_in, 'Result' as type from part")(
    lambda s, d: imports.resolve(
        D.dealt(D.table(s, d, "part").select("p_partkey")).select(F.expr("concat('pkg/u', p_partkey, '.py')").alias("path"), F.lit("python").alias("language"), F.expr("concat('from .m', p_partkey % 5, ' import go as run', chr(10))").alias("content"))
        .unionByName(s.range(5).select(F.expr("concat('pkg/m', id, '.py')").alias("path"), F.lit("python").alias("language"), F.lit("def go() -> Result: ...\n").alias("content")))
    ).select("source_path", "defined_in", "type")
)
query("f11_suppressed", "select 'Store' || p_partkey || 'Service' as owner, '_hide' as name from part where p_partkey % 5 = 3")(
    lambda s, d: promote.judged(SG.extract(source_files(s, d)).where("name is not null")).where("suppressed").select("owner", "name")
)
query("f12_promoted", "select 'Store' || p_partkey || 'Service.execute' as id, 4 as score from part where p_partkey % 5 = 3 union all select 'F' || p_partkey || '.run_' || p_partkey, 5 from part where p_partkey % 5 = 0")(
    lambda s, d: promote.judged(SG.extract(source_files(s, d)).where("name is not null")).where("promoted").select(F.concat_ws(".", "owner", "name").alias("id"), "score")
)
query("f12_scores", """select case p_partkey % 5 when 0 then 'F' || p_partkey when 1 then 'P' || p_partkey when 2 then 'T' || p_partkey else 'Store' || p_partkey || 'Service' end as owner, case p_partkey % 5 when 0 then 'run_' || p_partkey when 1 then 'load' || p_partkey when 2 then 'work_' || p_partkey else 'execute' end as name,
case p_partkey % 5 when 0 then 5 when 1 then -4 when 2 then 1 else 4 end as score, p_partkey % 5 in (0, 3) as promoted, case p_partkey % 5 when 0 then 'external_contract,runtime_signal,business_semantic' when 1 then 'business_semantic' when 2 then 'runtime_signal,business_semantic' else 'external_contract,business_semantic,cross_module_call' end as reasons
from part where p_partkey % 5 < 4 union all select 'Store' || p_partkey || 'Service', '_hide', 3, false, 'business_semantic' from part where p_partkey % 5 = 3""")(lambda s, d: promote.judged(SG.extract(source_files(s, d)).where("name is not null")).select("owner", "name", "score", "promoted", F.array_join("reasons", ",").alias("reasons")))
query("a19_folded", """select 'Store' || p_partkey || 'Service.execute' as node_id, 'Store' || p_partkey || 'Service.execute,Store' || p_partkey || 'Service._hide' as folded from part where p_partkey % 5 = 3
union all select 'F' || p_partkey || '.run_' || p_partkey, 'F' || p_partkey || '.run_' || p_partkey from part where p_partkey % 5 = 0""")(
    lambda s, d: promote.fold(promote.judged(SG.extract(source_files(s, d)).where("name is not null"))).select("node_id", F.array_join("folded_leaves", ",").alias("folded"))
)
query("a19_capabilities", """select 'Store' || p_partkey || 'Service.execute' as node_id, 'Store' || p_partkey || 'Service.execute,Store' || p_partkey || 'Service._hide' as folded from part where p_partkey % 5 = 3
union all select 'F' || p_partkey || '.run_' || p_partkey, 'F' || p_partkey || '.run_' || p_partkey from part where p_partkey % 5 = 0 union all select 'P' || p_partkey || '.module_pipeline', 'P' || p_partkey || '.load' || p_partkey from part where p_partkey % 5 = 1
union all select 'T' || p_partkey || '.module_pipeline', 'T' || p_partkey || '.work_' || p_partkey from part where p_partkey % 5 = 2""")(
    lambda s, d: promote.capabilities(promote.judged(SG.extract(source_files(s, d)).where("name is not null"))).select("node_id", F.array_join("folded_leaves", ",").alias("folded"))
)
query("x22_problem_text", f"with {D.PARTS} select node_id, problem as text from nodes")(lambda s, d: D.parts(s, d).select("node_id", promote.problem_text(F.col("node_id"), F.col("source_path"), F.col("problem")).alias("text")))
query("x22_problem_synthesis", """with p as (select p_partkey as k, 'Svc' || (p_partkey // 7) as c, regexp_extract(p_brand, '(\\d+)', 1) as b from part)
select c || '.' || ['execute', 'build', 'handle', 'parse', 'run', 'report', 'load'][k % 7 + 1] as node_id, case k % 7 when 0 then 'Execution Capability: Run ' || c when 1 then 'System Capability: Provide ' || c || ' build' when 2 then 'System Capability: Handle ' || c when 3 then 'System Capability: Analyze ' || c || ' parse'
when 4 then 'System Capability: Run ' || c when 5 then 'System Capability: Provide ' || c || ' report' else 'System Capability: Analyze ' || c || ' load' end || ' brand ' || b as text from p""")(lambda s, d: D.parts(s, d).select("node_id", promote.problem_text(F.col("node_id"), F.col("source_path"), F.lit("execute a b flow")).alias("text")))

# scans

query("s2_skipped", "select source || '/' || doc_id as path, doc_id % 4 < 2 as gone from documents")(
    lambda s, d: D.table(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), FS.skipped(F.expr("case doc_id % 4 when 0 then 'a/node_modules/x.js' when 1 then 'b/yarn.lock' when 2 then 'dist.py' else 'src/x.ts' end")).alias("gone"))
)
query("s3_runtime_files", "select source || '/' || doc_id || '.py' as path, length(text) as n from documents where strlen(text) <= 4000")(
    lambda s, d: FS.runtime_files(D.table(s, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), F.octet_length("text").alias("length"), F.col("text").alias("content")), 4000)[0].select("path", F.char_length("content").cast("long").alias("n"))
)
query("s3_size_diagnostics", "select 'RUNTIME_FILE_TOO_LARGE' as code, count(*) as n from documents where strlen(text) > 4000")(
    lambda s, d: FS.runtime_files(D.table(s, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), F.octet_length("text").alias("length"), F.col("text").alias("content")), 4000)[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))
)
query("s4_file_kind", "select p_partkey, case p_partkey % 6 when 0 then 'dockerfile' when 1 then 'python' when 2 then 'typescript' when 3 then 'yaml' when 4 then 'toml' else 'unknown' end as kind from part")(
    lambda s, d: D.table(s, d, "part").select("p_partkey", FS.file_kind(F.expr("case p_partkey % 6 when 0 then 'a/Dockerfile' when 1 then 'b.PY' when 2 then 'c.tsx' when 3 then 'd/e.yml' when 4 then 'f.toml' else 'g.txt' end")).alias("kind"))
)
query("s11_project_languages", f"with {D.PARTS} select language, count(*) as files from (select distinct source_path, language from lang) where language <> 'unknown' group by 1")(lambda s, d: FS.project_languages(D.parts(s, d).select(F.col("source_path").alias("path")).distinct()))
query("s5_language_files", f"with {D.PARTS} select distinct source_path as path, language from lang where language in ('go', 'java')")(lambda s, d: FS.by_language(D.parts(s, d).select(F.col("source_path").alias("path")).distinct(), ["go", "java"]))

# written and read again


def _folder(s: SparkSession) -> str:
    cut(s.range(1))  # makes sure that a shared folder is set
    return f"{s.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("s8_json_round_trip", f"with {D.PARTS} select node_id, category, source_path, len(demand)::int as demands, len(answer)::int as answers from nodes")
def s8(s, d):
    """NODE rows written as one JSON array and read leniently."""
    path = _folder(s)
    doc = F.to_json(F.struct(F.col("node_id").alias("nodeId"), "category", F.col("source_path").alias("sourcePath"), F.struct("problem", "demand", "answer").alias("fission")))
    rows = D.parts(s, d).select(doc.alias("j"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).coalesce(1).write.text(path)  # one document, as the format has it
    nodes, _ = datasets.read_nodes(s, path)
    return nodes.select("node_id", "category", "source_path", F.size("demand").alias("demands"), F.size("answer").alias("answers"))


@query("s8_missing_is_empty", "select 'NODE_MAP_MISSING' as code, 0::bigint as nodes")
def s8_missing(s, d):
    nodes, diags = datasets.read_nodes(s, "/no/such/file.json")
    return diags.select("code").join(nodes.agg(F.count(F.lit(1)).alias("nodes")))


@query("k4_history", "with h as (select ts::date as generated_at, count(*) as n from events group by 1) select generated_at, n from h order by generated_at desc limit 26")
def k4(s, d):
    """Two snapshot appends under a retention window of 26."""
    path = _folder(s)
    daily = D.table(s, d, "events").groupBy(F.to_date("ts").alias("generated_at")).agg(F.count(F.lit(1)).alias("n"))
    datasets.append_snapshot(daily.where(F.dayofmonth("generated_at") <= 15), path)
    return datasets.append_snapshot(daily.where(F.dayofmonth("generated_at") > 15), path)


query("k8_restore", "select p_partkey, case p_partkey % 4 when 0 then 'restored' when 1 then 'left' when 2 then 'removed' else 'left' end as change from part")(
    lambda s, d: datasets.restore(
        D.table(s, d, "part").where("p_partkey % 4 <> 3").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 4 != 2).alias("exists"), F.when(F.col("p_partkey") % 4 != 2, F.lit("old")).alias("content")),
        D.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 4 == 1, "old").otherwise("new").alias("content")),
    ).select(F.col("path").cast("long").alias("p_partkey"), "change")
)
query("c17_protocol_files", f"with {D.PARTS} select distinct source_path as path from nodes where ord % 17 = 0 and ord % 2 = 0")(
    lambda s, d: datasets.protocol_files(D.parts(s, d).where("ord % 17 = 0").select("node_id", F.when(F.col("ord") % 2 == 0, "modify").otherwise("reuse").alias("op"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("source_path")), D.parts(s, d))
)
query("p3_groups", "select n_nationkey, case n_nationkey % 3 when 0 then 'api' when 1 then 'resource' else 'other' end as grp from nation")(lambda s, d: D.table(s, d, "nation").select("n_nationkey", labels.group_of(F.expr("case n_nationkey % 3 when 0 then 'ApiRoute' when 1 then 'Cache' else 'x' end")).alias("grp")))

# failures, focus, order, display

query("e13_frames", "select event_id, 1 as f_ord, 'src/m' || (event_id % 5) || '.ts' as path, 3 as line from events")(
    lambda s, d: healing.frames(D.table(s, d, "events").select(F.col("event_id").alias("trace_id"), F.expr("'Error: x' || chr(10) || '  at Svc.run (/w/src/m' || (event_id % 5) || '.ts:3:9)' || chr(10) || 'end'").alias("text")), "/w").select(F.col("trace_id").alias("event_id"), "f_ord", "path", "line")
)


def _traces(s, d):
    text = F.expr("concat(case event_id % 3 when 0 then 'Error: cannot read x' when 1 then 'schema mismatch' else 'circular import' end, chr(10), '  at N', event_id % 25, '.run (/w/src/m', event_id % 6, '.ts:3:9)', chr(10), 'end')")
    return D.table(s, d, "events").select(F.col("event_id").alias("trace_id"), text.alias("text"))


def _nation_nodes(s, d):
    return D.table(s, d, "nation").select(F.expr("concat('N', n_nationkey, '.run')").alias("node_id"), F.expr("concat('src/M', n_nationkey % 5, '.ts')").alias("source_path"), F.col("n_nationkey").alias("ord"))


def _nation_pairs(s, d):
    return D.table(s, d, "nation").select(F.expr("concat('N', n_nationkey, '.run')").alias("src"), F.expr("concat('N', n_nationkey + 7, '.run')").alias("dst")).where("dst in ('N7.run', 'N8.run', 'N9.run', 'N10.run', 'N11.run', 'N12.run', 'N13.run', 'N14.run', 'N15.run', 'N16.run', 'N17.run', 'N18.run', 'N19.run', 'N20.run', 'N21.run', 'N22.run', 'N23.run', 'N24.run')")


_BEST = """m as (select event_id as trace_id, n_nationkey as n, 18 + case when contains('n' || (event_id % 25) || '.run', 'n' || n_nationkey) then 5 else 0 end as score from events join nation on n_nationkey % 5 = event_id % 6),
best as (select trace_id, 'N' || n || '.run' as node_id, n, score::int as score from m qualify row_number() over (partition by trace_id order by score desc, n) = 1)"""
query("j11_frame_node", f"with {_BEST} select trace_id, node_id, score from best")(lambda s, d: best_frame_node(healing.frames(_traces(s, d), "/w"), _nation_nodes(s, d)))
query("c12_diagnose", f"""with {_BEST}, k as (select event_id as trace_id, case event_id % 3 when 0 then 'left_branch' when 1 then 'contract' else 'topology' end as diagnosis, case event_id % 3 when 2 then 'manual_review' else 'modify' end as action from events),
r as (select *, coalesce((24 - n) // 7, 0)::bigint as impacted from k left join best using (trace_id)) select trace_id, diagnosis, action, node_id, score, impacted, case when impacted >= 5 then 'high' when impacted >= 2 then 'medium' else 'low' end as risk from r""")(
    lambda s, d: healing.diagnose(_traces(s, d), _nation_nodes(s, d), _nation_pairs(s, d), root="/w")
)


def _references(s, d):
    """Focus references of nations: four known sources, others, incomplete ones and ones that differ."""
    source = F.expr("concat(element_at(array('draft-protocol.json microSplit', 'micro-split.json', 'draft-protocol.json macroSplit', 'draft-protocol.json mesoSplit'), cast(n_nationkey % 4 + 1 as int)), case when n_nationkey >= 4 then concat(' ', n_nationkey) else '' end)")
    return D.table(s, d, "nation").select(source.alias("source"), F.expr("case when n_nationkey % 7 = 3 then ' ' else concat('Svc', n_nationkey % 3, '.execute@src/a.ts') end").alias("focus"), F.expr("case n_nationkey % 5 when 1 then 'Split' when 2 then ' merge ' when 4 then null else 'split' end").alias("operation"))


def _classes(s, d):
    """Class blueprints of parts: a row an artifact and class, with its branches."""
    by = D.parts(s, d).groupBy(F.col("category").alias("artifact"), F.split("node_id", r"\.")[0].alias("class_name"))
    ops = F.array_sort(F.collect_list(F.when(F.col("ord") % 5 != 0, F.struct("ord", element(F.split("node_id", r"\."), -1).alias("name"), F.col("problem").alias("responsibility")))))
    return by.agg(F.array_sort(F.collect_list(F.when(F.col("ord") % 4 != 0, F.col("problem")))).alias("static"), ops.alias("o")).select("artifact", "class_name", "static", F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["responsibility"].alias("responsibility"))).alias("dynamic"))


FOCUS = f"""refs as (select n_nationkey as n, ['draft-protocol.json microSplit', 'micro-split.json', 'draft-protocol.json macroSplit', 'draft-protocol.json mesoSplit'][n_nationkey % 4 + 1] || case when n_nationkey >= 4 then ' ' || n_nationkey else '' end as source,
    case when n_nationkey % 7 <> 3 then 'Svc' || (n_nationkey % 3) || '.execute@src/a.ts' end as focus, case n_nationkey % 5 when 1 then 'split' when 2 then 'merge' when 4 then null else 'split' end as operation from nation),
lead as (select * from refs where n = (select min(n) from refs where focus is not null and operation is not null)),
drift as (select refs.source, case when refs.focus is null or refs.operation is null then 'incomplete' else 'drift' end as problem from refs, lead where refs.focus is null or refs.operation is null or refs.focus <> lead.focus or refs.operation <> lead.operation),
cls as (select category as artifact, split_part(node_id, '.', 1) as class_name, count(*) filter (ord % 4 <> 0) as st, count(*) filter (ord % 5 <> 0) as dy, bool_or(ord % 5 <> 0 and split_part(node_id, '.', 2) = 'execute') as has from nodes group by all),
tgt as (select a.artifact, c.class_name, st, dy, has from (select distinct artifact from cls) a left join cls c on c.artifact = a.artifact and c.class_name = (select split_part(focus, '.', 1) from lead)),
closed as (select artifact, unnest(list_filter([case when class_name is null then 'missing_class' end, case when st = 0 then 'no_static' end, case when dy = 0 then 'no_dynamic' end, case when class_name is not null and not coalesce(has, false) then 'missing_method' end], lambda x: x is not null)) as problem from tgt)"""
query("c2_alignment", f"with {D.PARTS}, {FOCUS} select source, problem from drift")(lambda s, d: focus.alignment(_references(s, d)))
query("c2_closure", f"with {D.PARTS}, {FOCUS} select artifact, problem from closed")(lambda s, d: focus.closure(_references(s, d), _classes(s, d)))
query("c2_focus_gate", f"with {D.PARTS}, {FOCUS}, k as (select (select count(*) from drift) as a, (select count(*) from closed) as c) select case when a + c > 0 then 'fail' else 'pass' end as status, case when a > 0 and c > 0 then 'mixed' when a > 0 then 'protocol_focus_alignment' when c > 0 then 'focus_closure' end as failure from k")(
    lambda s, d: focus.gate(_references(s, d), _classes(s, d))
)
query("g11_canonical_order", f"""with {D.PARTS}, f as (select split_part(node_id, '.', 1) as owner, node_id, len(demand)::varchar as colour, len(answer) as weight from nodes), n as (select owner, count(*) as n from f group by owner),
s as (select owner, sha256(string_agg(colour || ':' || weight, '|' order by colour, weight)) as digest from f group by owner), w as (select owner, weight, count(*) as k from f group by owner, weight),
l as (select owner, sha256(string_agg(weight || 'x' || k, ',' order by weight desc)) as digest from w group by owner)
select f.owner, node_id, row_number() over (partition by f.owner order by colour, weight, node_id) - 1 as place, s.digest, 'strict' as mode from f join n using (owner) join s using (owner) where n <= 8
union all select f.owner, node_id, row_number() over (partition by f.owner order by node_id) - 1, l.digest, 'fallback' from f join n using (owner) join l using (owner) where n > 8""")(lambda s, d: canonical.canonical_order(D.parts(s, d).select(F.split("node_id", r"\.")[0].alias("owner"), "node_id", F.size("demand").cast("string").alias("colour"), F.size("answer").alias("weight"))))
query("g17_display_nodes", "select status, count(*) as n from (select case when ord % 13 = 0 then 'modified' else 'unchanged' end as status from (select p_partkey as ord from part)) group by 1")(
    lambda s, d: knowledge.graph(D.parts(s, d).select("node_id", "problem"), D.parts(s, d).where("ord % 13 = 0").select("node_id", F.lit("modify").alias("op"), "problem", F.lit(None).cast("string").alias("parent_id")), E.contract_edges(D.parts(s, d)))[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"))
)
query("f14_hideable", f"with {D.PARTS} select node_id from nodes where node_id not in (select src from n_edges union select dst from n_edges) and not regexp_matches(node_id, '(?i)(workflow|pipeline|service|agent|planner|orchestrator|controller|handler|api|route)')")(
    lambda s, d: knowledge.hideable_by_contracts(D.parts(s, d).select("node_id"), *E.contract_sides(D.parts(s, d)))
)

# streams


@query("w3_gated_runs")
def w3(s, d):
    """Decisions of the gated run over all events as a stream, ten projects, one state each."""
    src = f"{d}/events.parquet"
    schema = s.read.parquet(src).schema
    path = s._jvm.org.apache.hadoop.fs.Path(src)
    folder = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = s.readStream.schema(schema)
    stream = reader.parquet(src) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    events = stream.select((F.col("user_id") % 10).cast("string").alias("project"), "event_id", F.when(F.col("event_type") == "view", "sync").when(F.col("event_type") == "click", "verify").otherwise("other").alias("trigger"), F.col("ts").cast("timestamp").alias("ts"))
    out = _folder(s)
    run = auto_run.gated(events).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(auto_run.DECISION).parquet(f"{out}/rows")


@query("w1_watch")
def w1(s, d):
    """Files of a folder taken up once as a stream, as (path, sha256)."""
    out = _folder(s)
    source_files(s, d).select(F.col("content").alias("value")).repartition(5).write.option("maxRecordsPerFile", 10_000).text(f"{out}/in")
    auto_run.watch(s, f"{out}/in", lambda df: df.select("path", F.sha2("content", 256).alias("sha256")).write.mode("append").parquet(f"{out}/seen"), f"{out}/state", pattern="part-*").awaitTermination()
    return s.read.parquet(f"{out}/seen").select("sha256").distinct().select(F.count(F.lit(1)).alias("files"))
