"""Source trees in, topology and capabilities out; streams, sources and gates."""

import json

import pytest
from pyspark.sql import functions as F

from topolake import schema as S
from topolake.operators import focus, governance as V, linkage as L, metrics as M
from topolake.operators.extract import promote, rows as R, runtime as RT, signatures as SG
from topolake.sources import config, datasets, files as FS
from topolake.streaming import auto_run


def topo(spark, tree, **kw):
    rows = [(p, None, c) for p, c in tree.items()]
    df = spark.createDataFrame(rows, "path string, language string, content string").withColumn("language", FS.file_kind(F.col("path")))
    n, e, d = RT.topology(df, **kw)
    return {r.id: r for r in n.collect()}, {(r.src, r.type, r.dst) for r in e.collect()}, d.collect()


def test_route_and_service(spark):
    n, e, _ = topo(spark, {"api/r.py": 'from fastapi import APIRouter\n@router.post("/items/{id}/run")\nasync def run(id):\n    service.run_item(id)\n'})
    route = n["ApiRoute.POST./items/{id}/run"]
    assert route.framework == "fastapi" and route.metadata["handler"] == "run"
    assert any(t == "invokes" and s == route.id for s, t, _ in e)


def test_frontend_call_meets_a_prefixed_route(spark):
    tree = {"api/r.py": 'r = APIRouter(prefix="/api/v1")\n@r.post("/items/{id}/run")\ndef run(id):\n    pass\n', "web/p.ts": "apiClient.post(`/api/v1/items/${id}/run?x=1`)"}
    _, e, d = topo(spark, tree)
    assert ("FrontendEntry.web/p.ts", "calls", "ApiRoute.POST./api/v1/items/{id}/run") in e
    assert not [x for x in d if x.code == "RUNTIME_FRONTEND_API_ROUTE_UNMATCHED"]


def test_unmatched_call_is_reported(spark):
    n, _, d = topo(spark, {"web/p.ts": "fetch(`${origin}/api/nope`)"})
    lost = [x for x in d if x.code == "RUNTIME_FRONTEND_API_ROUTE_UNMATCHED"]
    assert lost and "raw=" in lost[0].message and "normalized=" in lost[0].message and any(i.startswith("ApiRoute.UNKNOWN.") for i in n)


def test_tasks_storage_compose_and_workflow(spark):
    n, e, _ = topo(spark, {"t.py": "@app.task\ndef run_workflow_task(x):\n    item_service.go(x)\n"})
    assert {"Task.run_workflow_task", "Queue.Celery", "Worker.Celery"} <= set(n) and any(t == "executes" for _, t, _ in e)
    n, e, _ = topo(spark, {"s.py": 'def load():\n    Minio("x")\n    client.get_object("a")\n    redis.set("k", 1)\n'})
    assert {"ObjectStore.MinIO", "Cache.Redis"} <= set(n) and ("Service.load", "reads", "ObjectStore.MinIO") in e and ("Service.load", "writes", "Cache.Redis") in e
    n, _, _ = topo(spark, {"docker-compose.yml": "services:\n  cache:\n    image: redis:7\n  db:\n    image: postgres:16\n  files:\n    image: minio/minio\n"})
    assert {"Cache.Redis", "DataStore.Postgres", "ObjectStore.MinIO"} <= set(n)
    n, e, _ = topo(spark, {"w.py": 'wf.add_node("A")\nwf.add_node("B")\nwf.add_edge("A", "B")\n'})
    assert {"WorkflowNode.A", "WorkflowNode.B"} <= set(n) and ("WorkflowNode.A", "connects", "WorkflowNode.B") in e and any(t == "contains" for _, t, _ in e)


def test_settings_package_and_cluster(spark):
    n, e, _ = topo(spark, {"package.json": json.dumps({"scripts": {"a": "b"}}), ".env": "API_KEY=1\nREDIS_URL=redis://x\n", "k.yaml": "kind: CronJob\nmetadata:\n  name: nightly\n", "pyproject.toml": "", "Dockerfile": "FROM x"})
    assert {"Config.PackageJson", "Secret.API_KEY", "Cache.Redis", "Config.K8s.CronJob.nightly", "Config.PyProject", "Config.Dockerfile"} <= set(n) and ("Config.API_KEY", "uses_secret", "Secret.API_KEY") in e


def test_a_broken_extractor_costs_one_diagnostic(spark):
    def bad(find):
        raise ValueError("no")

    n, _, d = topo(spark, {"a.py": "x = 1"}, extractors=[("Bad", bad), ("Http", RT.http_routes)])
    assert [(x.code, x.component) for x in d] == [("RUNTIME_EXTRACTOR_FAILED", "Bad")] and n == {}


@pytest.mark.parametrize("expression,want", [("'/api/x'", "/api/x"), ("baseUrl + '/api/u/' + id", "/api/u/:param"), ("`${h}/v/api/v1/a?b=c`", "/api/v1/a"), ("url", None)])
def test_call_paths(expression, want):
    got = RT.call_path(expression)
    assert (got[1] if got else None) == want


@pytest.mark.parametrize("language,text,want", [
    ("typescript", "export class A {\n  async run(x: Foo): Bar {\n }\n}\nexport function f(a, b = 1) {}\nconst g = (z) => z", {("A", "run", "Foo (x)", "Bar"), ("M", "f", "unknown (a),unknown (b)", "unknown"), ("M", "g", "unknown (z)", "unknown")}),
    ("java", "public class A {\n public List<B> run(C c, int d) {\n return x; }\n A() {}\n}", {("A", "run", "C (c),int (d)", "List<B>")}),
    ("go", "func (s *Svc) Run(ctx Context, n int) error {\n}\nfunc Help(a string) (int, error) {\n}", {("Svc", "Run", "Context (ctx),int (n)", "error"), ("M", "Help", "string (a)", "int, error")}),
    ("rust", "impl Svc {\n  pub fn run(&self, a: A) -> B {\n  }\n}\nfn free() {\n}", {("Svc", "run", "A (a)", "B"), ("M", "free", "None", "void")}),
    ("cpp", "int Svc::run(int a, char* b) {\n}\nvoid free(int x) {\n}", {("Svc", "run", "int (a),char* (b)", "int"), ("M", "free", "int (x)", "void")}),
    ("typescript", "function run(cb: (x: number) => void, y: Foo<A, B>): Promise<void> { if (x) { function inner() {} } }\nclass S { go(a: Map<string, (n: number) => void>): void {} }", {("M", "run", "(x: number) => void (cb),Foo<A, B> (y)", "Promise<void>"), ("S", "go", "Map<string, (n: number) => void> (a)", "void")}),
    ("typescript", "export default class B<T> extends C<{ a: T }> implements D {\n  private n = () => { return { go() {} } }\n  @dec({ x: 1 })\n  static async *each(\n    a: T[] = [],\n    { b, c }: Opts = {},\n  ): AsyncIterator<{ v: T }> {\n    if (a) { while (b) {} }\n  }\n  abstract gone(): void;\n  get size(): number { return 1 }\n  constructor(x) {}\n}\nconst h = async <T>(a: T): Promise<T | null> => a\nlet k = function (z) {}\nconst text = `function no(a) {}` // function no2() {}", {("B", "each", "T[] (a),Opts (b, c)", "AsyncIterator<{ v: T }>"), ("B", "size", "None", "number"), ("M", "h", "T (a)", "Promise<T | null>"), ("M", "k", "unknown (z)", "unknown")}),
    ("java", "@Service(\"x\")\npublic class A<T extends B<C>> implements D {\n private final Map<String, List<T>> m = new HashMap<>() {{ put(1, 2); }};\n @Override\n public <R> Map<String, R> run(@Valid final Foo<T> a, int... b) throws IOException, X {\n  for (int i = 0; i < 3; i++) { go(i); }\n }\n static class In { void x() {} }\n enum E { A(1), B(2); int f() { return 1; } }\n abstract int none(int a);\n}", {("A", "run", "Foo<T> (a),int... (b)", "Map<String, R>"), ("In", "x", "None", "void"), ("E", "f", "None", "int")}),
    ("go", "package x\n// func no() {}\nfunc (s *Svc[K]) Map(f func(a int) (string, error), m map[string]interface{}) (out []T, err error) {\n x := func(q int) {}\n}\nfunc Gen[T any](a, b T, c ...int) interface{} {\n}\ntype I interface {\n Do(a int) error\n}", {("Svc", "Map", "func(a int) (string, error) (f),map[string]interface{} (m)", "out []T, err error"), ("M", "Gen", "T (a),T (b),...int (c)", "interface{}")}),
    ("rust", "impl<'a, T: Clone> Iterator<Item<T>> for Walk<'a, T> where T: X { }\nimpl fmt::Display for Svc {\n  #[inline]\n  pub(crate) async fn each<F>(&mut self, f: F, mut m: HashMap<String, Vec<u8>>) -> Result<(), Box<dyn Error>>\n  where\n    F: Fn(&str) -> bool,\n  { let c = 'x'; fn inner() {} }\n}\nimpl Plain for Svc { fn a(&'a self, s: &'a str) {} }\ntrait T { fn no(&self); }\npub fn top(a: [u8; 4]) {}", {("Svc", "each", "F (f),HashMap<String, Vec<u8>> (m)", "Result<(), Box<dyn Error>>"), ("Plain", "a", "unknown (&'a self),&'a str (s)", "void"), ("M", "top", "[u8; 4] (a)", "void")}),
    ("cpp", "#include <map>\n#define X(a) a\nnamespace n {\nclass Svc : public Base<int> {\npublic:\n  Svc(int a) : x_{a}, y_(a) { go(); }\n  ~Svc() = default;\n  virtual std::map<std::string, std::vector<int>> get(const std::map<int, int>& m,\n      int n = f(1, 2)) const override;\n  static auto make(int a) -> std::unique_ptr<Svc> { return nullptr; }\n private:\n  int x_ = 0;\n};\n}\ntemplate <typename T>\nstd::vector<T> Svc::all(T a) {\n  if (a) { for (;;) {} }\n}\nint main() { return run(1); }", {("Svc", "get", "const std::map<int, int>& (m),int (n)", "std::map<std::string, std::vector<int>>"), ("Svc", "make", "int (a)", "std::unique_ptr<Svc>"), ("Svc", "all", "T (a)", "std::vector<T>"), ("M", "main", "None", "int")}),
    ("python", "def f(a: Map[str, int], b=g(1, 2)) -> Out:\n  return (\ndef _no(): pass", {("M", "f", "Map[str, int] (a),unknown (b)", "Out")}),
    ("python", "class A:\n  def run(self, x: Foo, *, y=1) -> Bar: ...\ndef f(): pass", {("A", "run", "Foo (x),unknown (y)", "Bar"), ("M", "f", "None", "void")}),
])
def test_signatures(language, text, want):
    got = {(r["owner"], r["name"], ",".join(r["demand"]), r["answer"][0]) for r in SG.records("m.x", language, text)}
    assert got == want


def test_script_references_join_modes():
    text = """import redis, { Pool as P } from 'x'
const CACHE: Map<string, A> = new Map()
const limit = 3
export class S<T extends { a: number }> {
  private db: Store<T> = new Store()
  n = 0
  constructor(private readonly log: Logger, x) { this.db = x }
  go(x: number, { redis: other }: Opts) {
    this.n += 1; this.n === limit
    const y = this.db, CACHE2 = { limit: 2 }
    CACHE.set(x, y); this.log.info(z => z + other); this.helper(1); this.flag = limit
    return redis.get(x)
  }
  helper(limit: number) { return limit + this.n++ }
  plain(a) { return a }
}
function free(P) { return P(redis) }
"""
    got = {(r["owner"], r["name"]): r["demand"] for r in SG.records("m.ts", "typescript", text)}
    assert got["S", "go"] == ["number (x)", "Opts (redis: other)", "[Ghost:Read] Map<string, A> (CACHE)", "[Ghost:Read] number (limit)", "[Ghost:Read] module (redis)", "[Ghost:Read] Store<T> (this.db)", "[Ghost:Write] unknown (this.flag)", "[Ghost:Read] Logger (this.log)", "[Ghost:ReadWrite] number (this.n)"]
    assert got["S", "helper"] == ["number (limit)", "[Ghost:ReadWrite] number (this.n)"] and got["S", "plain"] == ["unknown (a)"]
    assert got["M", "free"] == ["unknown (P)", "[Ghost:Read] module (redis)"]


def test_python_references_join_modes():
    text = "import redis\nCACHE = {}\nclass S:\n  def __init__(self):\n    self.db = Store()\n  def go(self, x):\n    self.n += 1\n    y = self.db\n    CACHE[x] = y\n    return redis.get(x)\n"
    got = next(r for r in SG.records("m.py", "python", text) if r["name"] == "go")["demand"]
    assert got == ["unknown (x)", "[Ghost:Read] dict (CACHE)", "[Ghost:Read] module (redis)", "[Ghost:Read] Store (self.db)", "[Ghost:ReadWrite] unknown (self.n)"]


def test_promotion_and_folding(spark):
    text = "class OrderService:\n  def execute(self, order: Order) -> Receipt: ...\n  def helper(self): ...\n  def __repr__(self): ...\nclass Plain:\n  def build(self): ...\n"
    df = spark.createDataFrame([("svc/orders.py", "python", text)], "path string, language string, content string")
    judged = promote.judged(SG.extract(df))
    got = promote.fold(judged).collect()
    assert [r.node_id for r in got] == ["OrderService.execute"] and got[0].folded_leaves == ["OrderService.execute", "OrderService.helper"]
    assert {r.name for r in judged.where("suppressed").collect()} >= {"__repr__", "build"}


def test_registrations():
    js = 'program.command("deploy <env>").description("x").action(runDeploy)\nprogram.command("list").action(() => {})\nprogram.command("bare")\n'
    got = [(r["owner"], r["name"]) for r in SG.registrations("javascript", js, "cli")]
    assert got == [("Deploy", "runDeploy"), ("List", "handler"), ("Bare", "command")]
    py = 'p = sub.add_parser("sync")\np.set_defaults(func=commands.run_sync)\n'
    assert [(r["owner"], r["name"]) for r in SG.registrations("python", py, "cli")] == [("Sync", "run_sync")]
    api = SG.registrations("typescript", "app.get('/v1/users/:id', showUser)\nrouter.post('/:x', (q) => q)", "api")
    assert [(r["owner"], r["name"], r["answer"]) for r in api] == [("Users", "showUser", ["ApiRouteHandler"]), ("Root", "root", ["ApiRouteHandler"])]
    assert SG.registrations("javascript", js, "other") == []


def test_imports_meet_definitions(spark):
    from topolake.operators.extract import imports

    tree = [("pkg/a.py", "python", "from .b import Store as S, gone\nfrom pkg.c import make\nfrom os import path\n"), ("pkg/b.py", "python", "class Store: ...\n"), ("pkg/c.py", "python", "def make() -> Result: ...\n"), ("pkg/bad.py", "python", "def (")]
    got = {r.alias: (r.defined_in, r.type) for r in imports.resolve(spark.createDataFrame(tree, "path string, language string, content string")).collect()}
    assert got == {"S": ("pkg/b.py", "Store"), "gone": (None, None), "make": ("pkg/c.py", "Result"), "path": (None, None)}


def test_sync_of_several_languages(spark):
    tree = [("web/entry.py", "python", "def run(): ..."), ("api/entry.py", "python", "def run(): ..."), ("api/x.ts", "typescript", "function go(a) {}")]
    p = spark.createDataFrame([("frontend", "web", 0), ("backend", "api", 1)], "category string, prefix string, ord int")
    nodes, diags = SG.sync(spark.createDataFrame(tree, "path string, language string, content string"), p)
    assert {(r.node_id, r.category) for r in nodes.collect()} == {("frontend.web.entry.Entry.run", "frontend"), ("backend.api.entry.Entry.run", "backend"), ("X.go", "backend")}
    assert diags.count() == 0


def test_protocol_rules(spark):
    from topolake.operators import merge

    known = spark.createDataFrame([("A", "do x"), ("B", "do y")], "node_id string, problem string")
    rows = [(0, "modify", "A", None, "do  x", 0.9), (1, "modify", "B", None, "other", 0.2), (2, "create_child", "B", "A", "n", None), (3, "reuse", "Z", None, None, 0.9), (4, "reuse", "A", None, None, 0.9), (5, "create_child", "N", "Q", "n", 0.9)]
    changes = spark.createDataFrame(rows, "ord long, op string, node_id string, parent_id string, problem string, confidence double")
    got = {(r.ord, r.rule) for r in merge.protocol_problems(changes, known, None, 0.6, True).collect()}
    assert got == {(1, "problem_changed"), (1, "low_confidence"), (2, "id_exists"), (2, "no_confidence"), (2, "target_repeated"), (3, "missing_target"), (4, "target_repeated"), (5, "missing_parent")}


def test_merged_rows_keep_what_is_known(spark):
    from topolake.operators import merge

    ev = lambda t: [(None, 1, 1, "call", t, 0.5)]
    rows = [("a", "T", "first", "p.py", None, None, {"k": "1", "x": "1"}, ev("one"), 0), ("a", "T", None, None, "core", None, {"k": "2"}, ev("one") + ev("two"), 1), ("b", "U", None, None, None, None, None, None, 2)]
    got = {r.id: r for r in merge.merge_nodes(spark.createDataFrame(rows, S.RT_NODE)).collect()}
    a, b = got["a"], got["b"]
    assert (a.label, a.source_path, a.category, a.metadata) == ("first", "p.py", "core", {"k": "2", "x": "1"}) and [e.text for e in a.evidence] == ["one", "two"]
    assert b.evidence[0].kind == "inferred" and not b.metadata


def test_longest_prefix_and_scope(spark):
    p = spark.createDataFrame([("a", "src", 0), ("b", "src/web", 1), ("c", "src/web", 2)], "category string, prefix string, ord int")
    df = spark.createDataFrame([("src/x.ts",), ("SRC\\web\\y.ts",), ("srcx/z.ts",), ("",), (None,)], "source_path string")
    assert {r.source_path: r.resolved for r in L.categories(df, p).collect()} == {"src/x.ts": "a", "SRC\\web\\y.ts": "b", "srcx/z.ts": "unknown", "": "unknown", None: "unknown"}


def test_capability_leaf_links(spark):
    caps = spark.createDataFrame([("Svc.run", "a.ts", ["Svc.help", "gone"])], "node_id string, source_path string, folded_leaves array<string>")
    leaves = spark.createDataFrame([("Svc.run", "a.ts", 0), ("Svc.help", "b.ts", 1), ("Svc.more", "a.ts", 2), ("Svc.far", "c.ts", 3)], "node_id string, source_path string, ord int")
    assert {(r.leaf_id, r.relation) for r in L.capability_leaves(caps, leaves).collect()} == {("Svc.run", "exact"), ("Svc.help", "folded_leaf"), ("Svc.more", "owner_match")}


def test_gates(spark):
    rules = spark.createDataFrame([("a", "lt", 0.1, None, True), ("b", "eq", None, True, True), ("c", "lte_baseline_factor", 1.1, None, True), ("d", "eq", 0.0, None, True)], S.RULE)
    metrics = spark.createDataFrame([("a", 0.1, None), ("b", None, True), ("c", 11.0, None)], S.METRIC)
    got = {r.key: r.status for r in V.evaluate(rules, metrics, 10.0).collect()}
    assert got == {"a": "fail", "b": "pass", "c": "pass", "d": "error"}
    code = lambda checks, **kw: V.gate(checks, **kw).first().exit_code
    checks = V.evaluate(rules, metrics, 10.0)
    assert code(checks) == 5 and code(checks, forbidden=1) == 6 and code(checks, policy_valid=False) == 3 and code(checks, artifacts=False) == 4
    fails = checks.where("key = 'a'")
    assert code(fails) == 2 and code(fails, fix=True) == 7 and code(checks.where("key = 'b'")) == 0 and code(checks.where("key = 'b'"), violations=1) == 2


def test_focus_gate(spark):
    refs = lambda rows: spark.createDataFrame(rows, "source string, focus string, operation string")
    classes = spark.createDataFrame([("micro-split.json", "Svc", ["p"], [("run", "")])], "artifact string, class_name string, static array<string>, dynamic array<struct<name:string,responsibility:string>>")
    assert focus.gate(refs([("micro-split.json", "Svc.run", "split")]), classes).first().status == "pass"
    assert focus.gate(refs([("micro-split.json", "Svc.go", "split")]), classes).first().failure == "focus_closure"
    assert focus.gate(refs([]), classes).first().status == "skip"


def test_auto_run_gates_in_order():
    cfg = config.AutoRun(min_events=2, min_hours=1, throttle_minutes=10)
    got = auto_run.replay([("x", 0), ("sync", 1), ("sync", 2), ("sync", 3), ("sync", 7300), ("sync", 7400)], cfg)
    assert got == [("skipped", "trigger_not_listed"), ("run", "completed"), ("skipped", "event_gate"), ("skipped", "time_gate"), ("run", "completed"), ("skipped", "event_gate")]
    off = config.AutoRun(enabled=False)
    assert auto_run.replay([("sync", 0)], off) == [("skipped", "disabled")]
    assert auto_run.decide((0, 0, None, None), "sync", 5.0, config.AutoRun(min_events=1), fails=True) == ((1, 1, None, 5.0), "error", "run_failed")


def test_stream_agrees_with_a_replay(spark, tmp_path):
    rows = [("p", i, "sync" if i % 3 else "other", i * 600.0) for i in range(40)]
    df = spark.createDataFrame(rows, "project string, event_id long, trigger string, s double").select("project", "event_id", "trigger", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    auto_run.gated(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [(r.status, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect()]
    assert got == auto_run.replay([(t, s) for _, _, t, s in rows], config.AutoRun())


def test_scan_skips_and_limits(spark, tmp_path):
    for p, text in {"src/a.py": "x", "src/b.ts": "y", "node_modules/c.js": "z", "yarn.lock": "l", "src/d.bin": "b", "src/e.json": "{}"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    files, diags = FS.walk(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["src/a.py", "src/b.ts", "src/e.json"] and "3" in diags.first().message
    kept, more = FS.runtime_files(files)
    assert {r.path: r.language for r in kept.collect()} == {"src/a.py": "python", "src/b.ts": "typescript", "src/e.json": "json"} and more.count() == 0
    few, said = FS.walk(spark, str(tmp_path), max_files=2)
    assert few.count() == 2 and "RUNTIME_MAX_FILES_REACHED" in {r.code for r in said.collect()}


def test_lenient_readers(spark, tmp_path):
    (tmp_path / "n.json").write_text("\ufeff" + json.dumps([{"nodeId": "A.run", "fission": {"problem": "p", "demand": ["X (x)"], "answer": ["Y"]}, "topology": {"foldedLeaves": ["A.b"]}}, {"nodeId": "B"}]))
    n, d = datasets.read_nodes(spark, str(tmp_path / "n.json"))
    assert [(r.node_id, r.demand, r.folded_leaves, r.ord) for r in n.orderBy("ord").collect()] == [("A.run", ["X (x)"], ["A.b"], 0), ("B", [], [], 1)] and d.count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert datasets.read_nodes(spark, str(tmp_path / "bad.json"))[1].first().code == "NODE_MAP_INVALID"
    (tmp_path / "r.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "T", "metadata": {"k": "v"}}], "edges": [{"from": "a", "to": "b", "type": "calls", "confidence": 0.5}], "diagnostics": [{"level": "info", "code": "", "message": "m"}]}))
    n, e, d = datasets.read_runtime(spark, str(tmp_path / "r.json"))
    assert (n.count(), e.first().dst, d.first().code) == (1, "b", "")
    (tmp_path / "d1.json").write_text('[{"level": "info", "code": "X"}]')
    (tmp_path / "d2.json").write_text('{"diagnostics": [{"level": "info", "code": "X"}]}')
    assert [datasets.read_diagnostics(spark, str(tmp_path / f)).first().code for f in ("d1.json", "d2.json")] == ["X", "X"]
    assert datasets.read_diagnostics(spark, str(tmp_path / "none.json")).count() == 0


def test_failed_write_leaves_an_empty_dataset(spark, tmp_path):
    def broken():
        raise RuntimeError("no plan")

    d = datasets.write_or_empty(broken, S.EDGE, str(tmp_path / "e"), spark)
    assert d.first().level == "error" and spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_configuration_falls_back(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"parser": {"scan_mode": "nonsense", "capability_threshold": 6}, "runtime": {"max_files": "many"}, "categories": {"web": ["src"]}}))
    c = config.load(tmp_path / "c.json")
    assert (c.parser.scan_mode, c.parser.capability_threshold, c.runtime.max_files, c.categories) == ("capability", 6, 5000, {"web": ["src"]})
    assert config.load(tmp_path / "none.json").parser.capability_threshold == 4


def test_verify_skips_without_a_baseline(spark):
    none = S.empty(spark, S.NODE)
    policy = spark.createDataFrame([("default", True, 5, 4)], "language string, include boolean, top_k int, min_score int")
    v = M.metric_vector(none, S.empty(spark, S.RT_NODE), S.empty(spark, S.RT_EDGE), S.empty(spark, S.DIAG), policy)
    assert {r.key: r.status for r in M.verify(v).collect()}["runtime_unmatched_route_count"] == "skip" and v.first().ghost_ratio == 0.0
    assert R.api_path("a//b/") == "/a/b"


def test_calls_are_read_as_tokens():
    """Brackets, texts and comments inside arguments don't end a call; owners come from one index a file."""
    from topolake.operators.extract.called import Code

    code = Code("# q.enqueue(a)\n@router.get('/x/{id}', deps=[Depends(f('))'))])\nasync def load(a, b=g(1)):\n    '''r.delay(1)'''\n    return self.item_service.run(h(a), 'x,y', k={'m': 2})\n", "python")
    said = [[code.tokens[n] for n in c.names] for c in code.calls]
    assert ["q", "enqueue"] not in said and ["r", "delay"] not in said
    run = next(c for c in code.calls if code.name(c) == "run")
    assert [code.said(*code.argument(run, k)) for k in range(4)] == ["h(a)", "'x,y'", "k={'m': 2}", ""]
    assert code.name(run, -2) == "item_service" and code.name(run, -4) == ""
    assert code.owner(code.start(run.open))[0] == "load" and code.owner(3) is None
    many = Code("\n".join(f"def f{i}():\n    redis.get({i})" for i in range(3000)), "python")
    assert [many.owner(many.start(c.open))[0] for c in many.calls if many.name(c) == "get"] == [f"f{i}" for i in range(3000)]


def test_routes_that_begin_with_a_parameter(spark):
    """10,000 routes and calls that begin with a parameter: each call meets one route a mask, and the first that fits counts."""
    from topolake.operators import linkage as L

    n = 10_000
    routes = spark.createDataFrame([(f"r{i}", "GET", f"/{{tenant}}/k{i}/run", i) for i in range(n)] + [("wide", "GET", "/{a}/{b}/{c}", n)], "route_id string, method string, path string, ord int")
    calls = [(i, "get", f"/:param/k{i}/run" if i % 2 else f"/acme/k{i}/run") for i in range(n)] + [(n, "get", "/acme/none/of"), (n + 1, "post", "/acme/k1/run"), (n + 2, "get", "/:param/:param/run"), (n + 3, "get", "/acme/k7")]
    got = {r.call_id: r.route_id for r in L.match_routes(spark.createDataFrame(calls, "call_id long, method string, path string"), routes).collect()}
    assert got == {i: f"r{i}" for i in range(n)} | {n: "wide", n + 2: "r0"}


def test_routes_against_all_pairs(spark):
    import itertools

    from topolake.operators import linkage as L

    parts = ["a", "b", ":param", "{id}"]
    paths = ["/" + "/".join(p) for k in (1, 2, 3) for p in itertools.product(parts, repeat=k)]
    routes = [(f"r{i}", "GET", p, i) for i, p in enumerate(paths[::3])]
    calls = [(i, "GET", p) for i, p in enumerate(paths)]
    r, c = spark.createDataFrame(routes, "route_id string, method string, path string, ord int"), spark.createDataFrame(calls, "call_id long, method string, path string")
    v = L.X.path_variants(L.F.col("path"))
    pairs = c.select("call_id", L.F.explode(v).alias("a")).crossJoin(r.select("route_id", "ord", L.F.explode(v).alias("b")))
    step = L.F.when(L.F.col("a") == L.F.col("b"), 0).when((L.F.col("a").contains(":param") | L.F.col("b").contains(":param")) & L.X.paths_match(L.F.col("a"), L.F.col("b")), 1)
    want = {x.call_id: x.route_id for x in L.first_by(pairs.withColumn("step", step).where("step is not null"), ["call_id"], L.F.col("step"), L.F.col("ord")).collect()}
    assert {x.call_id: x.route_id for x in L.match_routes(c, r).collect()} == want
