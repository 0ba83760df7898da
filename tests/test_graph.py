"""Graph operators on the shapes of small node maps, and invariants on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from topolake import schema as S
from topolake.operators import advice, canonical, edges as E, graph as G, linkage as L, metrics as M, trend as T

NONE = ([], [], [])


def nodes(spark, rows):
    return spark.createDataFrame([(i, c, p, t, d, a, *NONE, n) for n, (i, c, p, t, d, a) in enumerate(rows)], S.NODE)


@pytest.fixture(scope="module")
def chain(spark):
    return nodes(spark, [("Api.handle", "core", "src/a.ts", "x", ["None"], ["Req1"]), ("Service.execute", "core", "src/b.ts", "x", ["Req1 (r)"], ["Cmd1"]), ("Adapter.apply", "core", "src/c.ts", "x", ["Cmd1 (c)"], ["void"])])


@pytest.fixture(scope="module")
def ring(spark):
    return nodes(spark, [("Alpha.execute", "core", "a", "x", ["GammaOut (x)"], ["AlphaOut"]), ("Beta.execute", "core", "b", "x", ["AlphaOut (x)"], ["BetaOut"]), ("Gamma.execute", "core", "c", "x", ["BetaOut (x)"], ["GammaOut"])])


def ids(df):
    return df.select("node_id")


def fingerprint(df):
    a, d = E.produced(df), E.required(df)
    e = E.edges_of(a, d)
    p = E.adjacency(e)
    part = G.partition(G.levels(p, G.components(p, ids(df))), G.weights(a, d, e, ids(df)))
    r = part.select("partition", F.array_join(G.boundary_word(F.col("partition")).cast("array<string>"), "").alias("bits"), G.boundary_hash(G.boundary_word(F.col("partition"))).alias("hash")).collect()[0]
    return r.partition, r.bits, r.hash


def test_chain_levels_and_fingerprint(chain):
    e = E.contract_edges(chain)
    assert {(r.src, r.dst) for r in e.collect()} == {("Api.handle", "Service.execute"), ("Service.execute", "Adapter.apply")}
    part, bits, hash_ = fingerprint(chain)
    assert (part, bits) == ([11, 8, 3], "00010000010001") and hash_ == "Maya-ID: 0x9DFC2FF6"


def test_ring_fingerprint_and_cycle(spark, ring):
    assert fingerprint(ring) == ([15], "0000000000000001", "Maya-ID: 0xA9F2C6CD")
    p = E.adjacency(E.contract_edges(ring))
    assert [r.members for r in G.cycles(p, ids(ring)).collect()] == [["Alpha.execute", "Beta.execute", "Gamma.execute"]]
    top = advice.restructure(ring, E.contract_edges(ring), E.fanout_counts(E.produced(ring), E.required(ring))).first()
    assert (top.operation, top.targets, top.score) == ("renormalize", ["Alpha.execute", "Beta.execute", "Gamma.execute"], 1060)
    assert {(r.side, r.contract) for r in E.group_boundary(E.produced(ring), E.required(ring), ids(ring).withColumn("group_id", F.lit("m"))).collect()} == set()


def test_fan_out_split(spark):
    df = nodes(spark, [("Workflow.execute", "core", "w", "run", ["None"], ["WorkflowResult"]), *((f"C{i}.use", "core", f"c{i}", "x", ["WorkflowResult (r)"], ["void"]) for i in range(6))])
    fan = E.fanout(E.produced(df, lambda c: c), E.required(df, lambda c: F.split(c, " ")[0]), 6)
    assert [(r.node_id, r.downstream_count) for r in fan.collect()] == [("Workflow.execute", 6)]
    top = advice.restructure(df, E.contract_edges(df), fan).first()
    assert (top.operation, top.target, top.score) == ("split", "Workflow.execute", 585)


def test_fragments_gather(spark):
    df = nodes(spark, [(f"Planner.{m}", "core", "src/planner.ts", "x", ["None"], ["void"]) for m in ("build", "draft", "load")])
    top = advice.restructure(df, E.contract_edges(df), E.fanout_counts(E.produced(df), E.required(df))).first()
    assert (top.operation, top.target) == ("aggregate", "Planner@src/planner.ts")


def test_a_start_where_nothing_stands_out(spark, chain):
    top = advice.restructure(chain, E.contract_edges(chain), E.fanout_counts(E.produced(chain), E.required(chain))).collect()
    assert [(r.operation, r.score) for r in top] == [("split", 100)]


def test_self_loops_and_repeated_ids(spark):
    df = nodes(spark, [("A.step", "core", "a", "x", ["State (s)"], ["State"]), ("A.step", "core", "a", "x", ["Other (o)"], ["More"])])
    got = {(r.src, r.dst, r.contract) for r in E.contract_edges(df).collect()}
    assert got == set()  # answers of both rows count, demands of the last alone
    assert E.contract_edges(df.limit(1)).count() == 1
    assert E.unique_nodes(df).count() == 1


def _scc(n, pairs):
    reach = [[i == j for j in range(n)] for i in range(n)]
    for a, b in pairs:
        reach[a][b] = True
    for k in range(n):
        for i in range(n):
            if reach[i][k]:
                reach[i] = [x or y for x, y in zip(reach[i], reach[k], strict=True)]
    return {i: min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)}, reach


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_reach_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 18
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(26)}
    name = lambda i: f"n{i:02d}"
    df = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "src string, dst string")
    every = spark.createDataFrame([(name(i),) for i in range(n)], "node_id string")
    comp, reach = _scc(n, pairs)
    assert {r.node_id: r.component for r in G.components(df, every).collect()} == {name(i): name(c) for i, c in comp.items()}
    start = spark.createDataFrame([(name(0),), (name(1),)], "node_id string")
    got = {(r.origin, r.node) for r in G.blast_radius(df, start).collect()}
    direct = {(a, b) for a, b in pairs}
    want = {(name(s), name(j)) for s in (0, 1) for j in range(n) if j != s and any(reach[b][j] for a, b in direct if a == s)}
    assert got == want
    assert G.blast_radius(df, start, is_contract_change=False).count() == 0
    lv = {r.node_id: r.level for r in G.levels(df, G.components(df, every)).collect()}
    for a, b in pairs:
        assert comp[a] == comp[b] or lv[name(a)] < lv[name(b)]


def test_trace_depths(spark):
    e = spark.createDataFrame([("e1", "route", "svc"), ("e2", "svc", "redis")], "id string, src string, dst string")
    sizes = lambda start, way, depth: tuple(df.count() for df in G.trace(e, start, way, depth))
    assert sizes("route", "downstream", 2) == (3, 2) and sizes("redis", "upstream", 1) == (2, 1) and sizes("svc", "both", 1) == (3, 2) and sizes("svc", "both", 0) == (1, 0)


def test_filters_of_the_runtime_graph(spark):
    n = spark.createDataFrame([("ApiRoute.GET", "GET x", "ApiRoute"), ("Service.ItemService", "items", "Service"), ("Cache.Redis", "Redis", "Cache"), ("Alone", "z", "Service")], "node_id string, label string, type string")
    e = spark.createDataFrame([("e1", "ApiRoute.GET", "Service.ItemService", "invokes"), (None, "Service.ItemService", "Cache.Redis", "reads"), (None, "lost", "Cache.Redis", "reads")], "id string, src string, dst string, type string")
    assert sorted(r.id for r in G.index_edges(e, n).collect()) == ["RuntimeEdge.Service.ItemService.reads.Cache.Redis", "e1"]
    a, b = G.filter_graph(n, e, query="service.itemservice")
    assert (a.count(), b.count()) == (1, 0)
    a, b = G.filter_graph(n, e, edge_types=["invokes"], hide_isolated=True)
    assert (a.count(), b.count()) == (2, 1)
    assert [r.node_id for r in G.missing_ends(e, n).collect()] == ["lost"]


def test_colours_split_what_differs(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    base = spark.createDataFrame([(v,) for v in "abcxy"], "node_id string").withColumn("colour", F.lit("1"))
    c = {r.node_id: r.colour for r in G.colours(p, base).collect()}
    assert c["a"] != c["x"] and len(set(c.values())) == 5


def test_canonical_order_ignores_input_order(spark):
    rows = [("o", "n1", "c1", 3), ("o", "n2", "c1", 1), ("o", "n3", "c0", 2)]
    digest = lambda r: canonical.canonical_order(spark.createDataFrame(r, "owner string, node_id string, colour string, weight int")).first().digest
    assert digest(rows) == digest(rows[::-1])


def test_trend_of_two_maps(spark):
    first = nodes(spark, [("ApiController.execute", "core", "a", "x", ["None"], ["RunResult"]), ("WorkflowService.dispatch", "core", "b", "x", ["None"], ["RunResult"])])
    second = first.unionByName(nodes(spark, [("WorkerNode.process", "core", "c", "x", ["RunResult (r)"], ["void"])]).withColumn("ord", F.lit(2).cast("long")))
    got = T.edge_drift(T.edge_keys(E.contract_edges(second)), T.edge_keys(E.contract_edges(first))).collect()
    assert {(r.change, r.key) for r in got} == {("added", "ApiController.execute::RunResult::WorkerNode.process"), ("added", "WorkflowService.dispatch::RunResult::WorkerNode.process")}


def test_empty_inputs(spark):
    none = S.empty(spark, S.NODE)
    assert E.contract_edges(none).count() == 0 and E.degrees(E.contract_edges(none)).count() == 0
    assert G.components(E.contract_edges(none), ids(none)).count() == 0
    assert M.ghosts_by_language(none).count() == 0


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def named(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def plain_reach(rows):
    to = {}
    for a, b in rows:
        to.setdefault(a, set()).add(b)
    out = {}
    for a in to:
        seen, left = set(), list(to[a])
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += to.get(x, ())
        out[a] = seen
    return out


@pytest.fixture
def rounds(monkeypatch):
    """How many tables a loop writes."""
    told = []
    plain = G.cut
    monkeypatch.setattr(G, "cut", lambda df: told.append(1) or plain(df))
    return told


def test_long_chain_takes_few_rounds(spark, rounds):
    n = 10_000
    rows = [(f"n{i}", f"n{i + 1}") for i in range(n - 1)]
    comp = G.components(pairs_of(spark, rows), named(spark, [f"n{i}" for i in range(n)]))
    assert comp.where("node_id <> component").isEmpty() and comp.count() == n
    assert len(rounds) < 40
    rounds.clear()
    level = {r.node_id: r.level for r in G.levels(pairs_of(spark, rows), comp).collect()}
    assert level == {f"n{i}": i for i in range(n)}
    assert len(rounds) < 40


def test_long_ring_with_tails_takes_few_rounds(spark, rounds):
    n = 300
    rows = [(f"r{i:05}", f"r{(i + 1) % n:05}") for i in range(n)] + [("a0", "r00000"), ("a1", "a0"), ("r00007", "z0"), ("z0", "z1"), ("q0", "q1"), ("q1", "q0"), ("s", "s")]
    names = {x for r in rows for x in r} | {"alone"}
    comp = {r.node_id: r.component for r in G.components(pairs_of(spark, rows), named(spark, names)).collect()}
    assert comp == {x: "r00000" if x[0] == "r" else "q0" if x[0] == "q" else x for x in names}
    assert len(rounds) < 60


@pytest.mark.parametrize("seed", [3])
def test_random_graphs_against_plain_search(spark, seed):
    r = random.Random(seed)
    n, m = 25, 34
    rows = list({(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)})
    names = [f"v{i}" for i in range(n)]
    to = plain_reach(rows)
    pairs, ids = pairs_of(spark, rows), named(spark, names)
    assert {(x.origin, x.node) for x in G.reach(pairs, ids).collect()} == {(a, b) for a in to for b in to[a]}
    assert {x.origin: x.impacted for x in G.impact(pairs, ids).collect()} == {a: len(to.get(a, set()) - {a}) for a in names}
    found = G.components(pairs, ids)
    comp = {x.node_id: x.component for x in found.collect()}
    want = {a: min([a, *(b for b in to.get(a, ()) if a in to.get(b, ()))]) for a in names}
    assert comp == want
    edges = {(want[a], want[b]) for a, b in rows if want[a] != want[b]}
    level = dict.fromkeys(want.values(), 0)
    for _ in range(n):
        for a, b in edges:
            level[b] = max(level[b], level[a] + 1)
    got = {x.node_id: x.level for x in G.levels(pairs, found).collect()}
    assert got == {a: level[want[a]] for a in names}


def test_graph_loops_on_nothing(spark):
    none, ids = pairs_of(spark, []), named(spark, ["a", "b"])
    assert G.reach(none, ids).count() == 0
    assert {(x.origin, x.impacted) for x in G.impact(none, ids).collect()} == {("a", 0), ("b", 0)}
    comp = G.components(none, ids)
    assert {(x.node_id, x.component, x.level) for x in G.levels(none, comp).collect()} == {("a", "a", 0), ("b", "b", 0)}
    assert G.components(none, ids.limit(0)).count() == 0


def linked_rows(spark, n):
    """Parts-like rows: few names and paths that very many share."""
    r = random.Random(1)
    words, kinds = ["red", "gear", "small", "hot", "cold", "old", "ring", "plate"], ["large", "economy", "standard"]
    run = [(f"Service.{r.choice(words)}.m{i * 4}", f"{r.choice(words)} {r.choice(words)}", [f"src/{r.choice(kinds)}/f{r.randrange(9)}.py"], r.choice(["core", None]), f"m{i * 8}" if i % 5 == 0 else None) for i in range(n)]
    caps = [(f"Shop.{r.choice(words)}.{r.choice(words)}.m{i}", f"src/{r.choice(kinds)}/f{r.randrange(9)}.py", r.choice(["core", "backend", None])) for i in range(n)]
    return spark.createDataFrame(run, "id string, label string, source_paths array<string>, category string, handler string"), spark.createDataFrame(caps, "node_id string, source_path string, category string")


def test_scored_links_meet_few_pairs(spark):
    """What meets is some tens of pairs a row, where each word that many share would give hundreds."""
    n = 2000
    r, c = L._linked_sides(*linked_rows(spark, n))
    assert L.link_candidates(r, c).count() < 100 * n


def test_scored_links_against_all_pairs(spark):
    run, caps = linked_rows(spark, 150)
    got = {(x.runtime_id, x.capability_id, x.score, x.rank) for x in L.runtime_capabilities(run, caps).collect()}
    whole = L.link_candidates
    try:
        L.link_candidates = lambda r, c, *_: r.select("runtime_id").crossJoin(c.select("capability_id")).distinct()
        want = {(x.runtime_id, x.capability_id, x.score, x.rank) for x in L.runtime_capabilities(run, caps).collect()}
    finally:
        L.link_candidates = whole
    assert got == want


def test_edges_after_a_change_equal_a_full_run(spark):
    r = random.Random(7)
    make = lambda i, f: (f"N{i}.run", "core", f"f{f}", "x", [f"T{r.randrange(20)} (x)"], [f"T{r.randrange(20)}"])
    before = [make(i, i % 30) for i in range(100)] + [make(3, 29), make(5, 28)]  # two nodes that two files declare
    gone = {"f3", "f7"}
    with_path = lambda rows: nodes(spark, rows).withColumn("path", F.col("source_path"))
    old, taken = with_path(before), with_path([make(i, 3) for i in (3, 33, 200, 201)]).withColumn("ord", (F.col("ord") + 1000).cast("long"))
    new = old.where(~F.col("path").isin(*gone)).unionByName(taken)
    found = E.resync(E.contract_edges(old), old, spark.createDataFrame([(g,) for g in gone], "path string"), taken)
    rows = lambda df: sorted(tuple(x) for x in df.select("src", "dst", "contract").collect())
    assert rows(found) == rows(E.contract_edges(new))


def test_canonical_order_of_alike_nodes(spark):
    """Renamed copies of a fragment of eight nodes of one colour have one digest, and the order is the least of all permutations."""
    from itertools import permutations

    r = random.Random(4)
    weights = [3, 1, 4, 1, 5, 2, 6, 5]
    rows = [(f"o{k}", f"{r.random()}", "same", w) for k in range(5) for w in r.sample(weights, 8)]
    rows += [("small", n, c, w) for n, c, w in (("a", "x", 2), ("b", "x", 1), ("c", "w", 9), ("d", "x", 1))]
    got = canonical.canonical_order(spark.createDataFrame(rows, "owner string, node_id string, colour string, weight int")).collect()
    assert len({x.digest for x in got if x.owner != "small"}) == 1
    mine = [(c, w, n) for o, n, c, w in rows if o == "small"]
    best = min((p for p in permutations(mine) if [x[0] for x in p] == sorted(x[0] for x in p)), key=lambda p: ([x[1] for x in p], [x[2] for x in p]))
    assert [x.node_id for x in sorted((x for x in got if x.owner == "small"), key=lambda x: x.place)] == [x[2] for x in best]


def test_long_ways_are_doubled(spark, rounds):
    """reach and impact of a long chain with a ring at its end take rounds of its length's logarithm; few starts give the same."""
    n = 150
    rows = [(f"n{i:03}", f"n{i + 1:03}") for i in range(n)] + [(f"n{n:03}", "r0"), ("r0", "r1"), ("r1", "r0"), ("s", "s"), ("n003", "n090")]
    to, pairs, ids = plain_reach(rows), pairs_of(spark, rows), named(spark, {x for r in rows for x in r} | {"alone"})
    assert {(x.origin, x.node) for x in G.reach(pairs, ids).collect()} == {(a, b) for a in to for b in to[a]}
    assert {x.origin: x.impacted for x in G.impact(pairs, ids).collect()} == {a: len(to.get(a, set()) - {a}) for a in {x for r in rows for x in r} | {"alone"}}
    assert len(rounds) < 30


def test_dense_graphs_are_not_doubled(spark):
    rows = [(f"v{i}", f"v{j}") for i in range(30) for j in range(30) if i != j] + [("v0", "out"), ("in", "v1")]
    to, pairs, ids = plain_reach(rows), pairs_of(spark, rows), named(spark, {x for r in rows for x in r})
    assert G._doubled(pairs, ids) is None
    assert {(x.origin, x.node) for x in G.reach(pairs, ids).collect()} == {(a, b) for a in to for b in to[a]}
