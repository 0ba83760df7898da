"""What grows with a table stays out of the driver and grows no faster than the table."""

from pyspark.sql import functions as F

from topolake.operators import edges as E, graph as G, knowledge as KN, linkage as L, shared as SH, trend as R
from topolake.operators.extract import imports, promote, rows as RW, signatures as SG
from topolake.operators.topk_join import feature_lists
from topolake.plans import derive as D, queries_graph as Q, queries_more as QM


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_links_are_never_broadcast(spark):
    run = spark.createDataFrame([("Service.a.run", "a b", ["src/a.py"], "core", "run")], "id string, label string, source_paths array<string>, category string, handler string")
    caps = spark.createDataFrame([("Shop.a.run", "src/a.py", "core", [], 1)], "node_id string, source_path string, category string, folded_leaves array<string>, ord long")
    ids = caps.select(F.col("node_id").alias("capability_id"), F.lower("node_id").alias("low"))
    words = spark.createDataFrame([("a", 1, "w:x", 0, 6)], "id string, row long, feature string, kind int, weight int")
    frames = [*feature_lists(words, words), L.containing(ids, run.select(F.col("handler").alias("needle"))), L.capability_leaves(caps, caps), L.runtime_capabilities(run, caps)]
    for df in frames:
        assert "BroadcastHashJoin" not in plan(df)
    assert [(r.capability_id, r.score) for r in frames[-1].collect()] == [("Shop.a.run", 65 + 18 + 34 + 40 + 2 * 6)]


def test_fanout_makes_no_pair_of_nodes(spark):
    """A contract that many answer and many demand: lists and counts against plain sets, and few rows in any step."""
    a = [(f"n{i}", c) for i in range(300) for c in (["x"] if i % 3 else ["x", "y"])] + [("lone", "z"), ("m1", "y")]
    d = [(f"n{i}", "x") for i in range(0, 200)] + [(f"m{i}", c) for i in range(50) for c in ("y", "x")] + [("m0", "z")]
    answers, demands = (spark.createDataFrame(x, "node_id string, contract string") for x in (a, d))
    want = {n: sorted({e for e, x in d if x in {c for o, c in a if o == n}} - {n}) for n, _ in a}
    counts = E.fanout_counts(answers, demands)
    assert {r.node_id: r.downstream_count for r in counts.collect()} == {n: len(v) for n, v in want.items() if v}
    assert {r.node_id: (r.downstream_count, r.downstream) for r in E.fanout(answers, demands, 2).collect()} == {n: (len(v), v) for n, v in want.items() if len(v) >= 2}
    kinds = E.kinds(answers), E.kinds(demands)
    assert E.met_kinds(kinds[0], answers, kinds[1], demands).count() == 9


def test_cycles_through_common_contracts(spark):
    """Many nodes that answer and demand a few contracts, against plain closures over pairs."""
    a = [(f"p{i}", "x") for i in range(40)] + [(f"q{i}", "y") for i in range(30)] + [("s", "z"), ("t", "w"), (" out", "y")]
    d = [(f"p{i}", "y") for i in range(40)] + [(f"q{i}", "x") for i in range(30)] + [("s", "x"), ("t", "z"), ("u", "w"), ("v", "w"), (" out", "w"), ("s", "z")]
    answers, demands = (spark.createDataFrame(x, "node_id string, contract string") for x in (a, d))
    ids = spark.createDataFrame([(n,) for n in sorted({n for n, _ in a + d} - {" out"})], "node_id string")
    got = G.contract_cycles(answers, demands, ids).collect()
    members = sorted([f"p{i}" for i in range(40)] + [f"q{i}" for i in range(30)])
    # s, t, u, v and the node outside ids, which leads back but is in no cycle of known nodes
    assert [(r.members, r.blast) for r in got] == [(members, 5)]


def test_nation_pairs_are_joined_once(spark):
    """What loops take again and again is a small table, not the join of all lines."""
    p = Q._pairs(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in p._jdf.queryExecution().optimizedPlan().toString() and "Join" not in p._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(p.collect()) == sorted(D.trade(spark, "/root/testdata/sf0.001").select("src", "dst").collect())


def test_capability_leaves_of_repeated_ids(spark):
    """A pair's first link is an aggregation: no window over all rows of one pair, and repeated capabilities count once."""
    caps = spark.createDataFrame([("S.run", "p", ["S.load"])] * 50, "node_id string, source_path string, folded_leaves array<string>")
    leaves = spark.createDataFrame([(x, "p", i) for i, x in enumerate(["S.run", "S.load", "S.x"] * 20)], "node_id string, source_path string, ord long")
    df = L.capability_leaves(caps, leaves)
    assert plan(df).count("Window [") <= 1
    assert sorted((r.leaf_id, r.relation, r.pos) for r in df.collect()) == [("S.load", "folded_leaf", 1000), ("S.run", "exact", 0), ("S.x", "owner_match", 1000003)]


def test_files_made_of_parts_are_extracted_by_all_tasks(spark, monkeypatch):
    """F8: extraction of what is made of keys is not left to the task that reads the table, and a batch holds many files' rows."""
    seen = []
    monkeypatch.setattr(RW, "run", lambda files, extractors, f=RW.run: (seen.append(files.rdd.getNumPartitions()), f(files, extractors))[1])
    Q.QUERIES["e6_infra"](spark, "/root/testdata/sf0.001")
    assert seen == [spark.sparkContext.defaultParallelism]
    assert [b.num_rows for b in RW.batches(({"id": str(i)} for i in range(4500)), RW.SCHEMA)] == [2000, 2000, 500]


def test_registrations_are_extracted_by_all_tasks(spark, monkeypatch):
    """as F8."""
    seen = []
    monkeypatch.setattr(SG, "extract", lambda files, f=SG.extract: (seen.append(files.rdd.getNumPartitions()), f(files))[1])
    Q.QUERIES["e12_registrations"](spark, "/root/testdata/sf0.001")
    assert seen == [spark.sparkContext.defaultParallelism]


def test_imports_are_extracted_once(spark, monkeypatch):
    """on all cores, and imports and definitions come from one extraction."""
    seen, files = [], spark.createDataFrame([("p/a.ts", "typescript", 'import { x } from "./b"\n'), ("p/b.ts", "typescript", "export const x = 1\nconst unasked = 2\n")], "path string, language string, content string")
    df = imports.resolve(files)
    assert "MapInArrow" not in plan(df) and [(r.alias, r.defined_in, r.type) for r in df.collect()] == [("x", "p/b.ts", "number")]
    monkeypatch.setattr(imports, "resolve", lambda files: (seen.append(files.rdd.getNumPartitions()), df)[1])
    Q.QUERIES["j20_script_imports"](spark, "/root/testdata/sf0.001")
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_capabilities_extract_once(spark):
    """folding and the rest of the files come from one extraction."""
    files = spark.createDataFrame([("a.py", "python", "def load(x): ...\n")], "path string, language string, content string")
    df = promote.capabilities(promote.judged(SG.extract(files).where("name is not null")))
    assert "MapInArrow" not in plan(df) and [r.node_id for r in df.collect()] in ([], ["A.module_pipeline"])


def sides(spark, *rows):
    return (spark.createDataFrame(x, "node_id string, contract string") for x in rows)


def test_hideable_nodes_make_no_edge(spark):
    """ends are told by contracts."""
    a, d = sides(spark, [("a", "x"), ("b", "y"), ("c", "z"), ("s", "t")], [("d", "x"), ("e", "w"), ("s", "t")])
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "e", "s", "my_service")], "node_id string")
    df = KN.hideable_by_contracts(nodes, a, d)
    assert sorted(r.node_id for r in df.collect()) == ["b", "c", "e"] == sorted(r.node_id for r in KN.hideable(nodes, E.edges_of(a, d)).collect())
    assert "Inner" not in plan(Q.QUERIES["f14_hideable"](spark, "/root/testdata/sf0.001"))


def test_removed_edges_from_sides(spark):
    """the same edges as the difference of all edges, for changed answers and changed demands."""
    oa, od, na, nd = sides(
        spark, [("p", "x"), ("p", "y"), ("q", "x"), ("gone", "x")], [("c", "x"), ("c", "y"), ("e", "x"), ("left", "y")], [("p", "y"), ("q", "x"), ("r", "y")], [("c", "x"), ("c", "y"), ("e", "y")]
    )
    for demands in (od, nd):
        new = E.edges_of(na, demands)
        want = R.removed_edges(E.edges_of(oa, od), new, new.select(F.explode(F.array("src", "dst")).alias("node_id")))
        got = R.removed_contract_edges(oa, od, na, None if demands is od else nd)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()) != []
    p = plan(Q.QUERIES["j13_removed_edges"](spark, "/root/testdata/sf0.001"))
    assert p.count("Inner") == 1 and "lineitem" not in p


def test_resync_stores_no_edge(spark, monkeypatch):
    """F16: the graph is kept as its sides, and gives the same edges as a resync of edges."""
    row = lambda n, path, d, a, o: (n, path, d, a, o)
    schema = "node_id string, path string, demand array<string>, answer array<string>, ord long"
    nodes = spark.createDataFrame([row("a", "1", ["Foo (x)"], ["Bar"], 0), row("b", "2", ["Bar (y)"], ["Foo"], 1), row("c", "3", ["Foo (x)"], ["Baz"], 2), row("c", "2", ["Bar (x)"], ["Foo"], 3)], schema)
    now = spark.createDataFrame([row("b", "2", ["Baz (y)"], ["Qux"], 1), row(" n", "2", ["Qux (y)"], ["Foo"], 4)], schema)
    changed = spark.createDataFrame([("2",)], "path string")
    got = E.resync_contracts(*E.contract_sides(nodes), nodes, changed, now)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in E.resync(E.contract_edges(nodes), nodes, changed, now).collect()) != []
    told, plain = [], SH.written
    monkeypatch.setattr(SH, "written", lambda df: told.append(df.columns) or plain(df))
    Q.QUERIES["w2_resync"](spark, "/root/testdata/sf0.001")
    assert told and not any("dst" in c for c in told)


def test_diagnostics_are_many_documents(spark, tmp_path, monkeypatch):
    """over 10,000 diagnostics are not one document."""
    spark.range(25_000).selectExpr("id as event_id", "concat('k', id % 3) as event_type").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(QM, "_folder", lambda s, n=iter(("bare", "object")): f"{tmp_path}/{next(n)}")
    got = Q.QUERIES["s9_diagnostics"](spark, str(tmp_path)).collect()
    assert {(r.layout, r.code): r.n for r in got} == {(x, f"k{i}"): 8334 if i == 0 else 8333 for x in ("bare", "object") for i in range(3)}
    assert len(list((tmp_path / "bare").glob("batch=*/*.txt"))) == 3


def test_graph_loops_send_no_table_through_the_driver(spark, monkeypatch):
    """joins of nodes and edges are by shuffles in each round, and the graph of parts is joined from lines once."""
    plans = []
    keep = lambda df: (plans.append(plan(df)), SH.written(df))[1]
    monkeypatch.setattr(G, "cut", keep)
    # a ring with a chain through it, two cycles that share nodes, a chain in, a tree out, a ring of its own, a lone node
    pairs = ["ab", "bc", "ca", "cd", "de", "ec", "xy", "yz", "za", "ef", "eg", "gh", "fh", "gi", "pq", "qr", "rp", "af", "xz"]
    df = spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string").transform(SH.written)
    ids = spark.createDataFrame([(c,) for c in "abcdefghilpqrxyz"], "node_id string").transform(SH.written)
    comp = G.components(df, ids)
    found = G.levels(df, comp)
    got = {r.node_id: (r.component, r.level) for r in found.collect()}
    assert got == {"x": ("x", 0), "y": ("y", 1), "z": ("z", 2), **dict.fromkeys("abcde", ("a", 3)), "f": ("f", 4), "g": ("g", 4), "h": ("h", 5), "i": ("i", 5), **dict.fromkeys("pqr", ("p", 0)), "l": ("l", 0)}
    monkeypatch.setattr(G, "components", lambda pairs, ids: comp if pairs is df else pairs)
    cycles = G.cycles(df, ids)
    colours = G.colours(df, ids.withColumn("colour", F.lit("x")), 2)
    impact = G.impact(df, ids)
    plans += [plan(x) for x in (found, cycles, colours, impact, D.calls(spark, "/root/testdata/sf0.001"))]
    assert len(plans) > 30 and not [p for p in plans if "Broadcast" in p]
    made = []
    monkeypatch.setattr(D, "calls", lambda s, d, f=D.calls: (made.append(d), f(s, d))[1])
    monkeypatch.setattr(G, "levels", lambda pairs, comp: (plans.append(plan(pairs)), pairs)[1])
    Q.QUERIES["g5_levels_parts"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "Join" not in plans[-1]
