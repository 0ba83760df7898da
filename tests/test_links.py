"""Scored links of rows that are alike: the same links as all pairs give, from few rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_graph import linked_rows
from tests.test_queries import canon
from topolake.operators import linkage as L, topk_join as T

FEATURES = "id string, row long, feature string, kind int, weight int"
WEIGHTS = {0: (6, 2), 1: (65, 32), 2: (26,), 3: (34,), 4: (40,)}


def featured(r, name, n, ids):
    """Rows of ids, of which some have several, with features of five kinds."""
    of = {(k, f): r.choice(WEIGHTS[k]) for k, many in ((0, 9), (1, 5), (2, 2), (3, 4), (4, 4)) for f in range(many)} if not isinstance(r.words, dict) else r.words
    r.words = of
    return [(f"{name}{r.randrange(ids)}", i, f"{k}:{f}", k, w) for i in range(n) for (k, f), w in of.items() if r.random() < (0.4 if k else 0.6)]


@pytest.mark.parametrize(("seed", "few", "listed"), [(1, 1, 2), (2, 4, 256), (3, 0, 1), (4, 2, 6)])
def test_best_pairs_against_all_pairs(spark, monkeypatch, seed, few, listed):
    monkeypatch.setattr(T, "FEW", few, raising=False)
    monkeypatch.setattr(T, "LISTED", listed, raising=False)
    r = random.Random(seed)
    r.words = None
    left, right = featured(r, "l", 25, 25), featured(r, "r", 60, 40)
    left = [(f"l{i}", i, *x) for _, i, *x in left]  # a row of its own for each left id
    right = [(f"r{random.Random(i).randrange(40)}", i, *x) for _, i, *x in right]
    rows = lambda side: {i: (n, {f: (k, w) for a, b, f, k, w in side if b == i}) for n, i, *_ in side}

    def score(a, b):
        shared = [b[f] for f in a if f in b]
        words = sorted((w for k, w in shared if k == 0), reverse=True)[:3]
        return sum(words) + sum(max((w for k, w in shared if k == n), default=0) for n in range(1, 5)) - 8

    want = set()
    for name, mine in rows(left).values():
        best = {}
        for other, its in rows(right).values():
            best[other] = max(best.get(other, -99), score(mine, its))
        want |= {(name, x) for x in sorted((x for x in best if best[x] >= 35), key=lambda x: (-best[x], x))[:4]}
    got = {tuple(x) for x in T.best_pairs(spark.createDataFrame(left, FEATURES), spark.createDataFrame(right, FEATURES), 4, 35, -8, 3).collect()}
    assert want and want <= got


def test_links_of_alike_rows_write_few_rows(spark, monkeypatch):
    """rows that agree in what many share look for partners once, and no set of them is made for each row."""
    n, told = 2000, []
    monkeypatch.setattr(T, "cut", lambda df, f=T.cut: told.append(x := f(df)) or x)
    L.link_candidates(*L._linked_sides(*linked_rows(spark, n))).count()
    assert sum(x.count() for x in told) < 30 * n


def test_needles_of_common_runs(spark):
    """ids and needles of which all share their runs of three signs, needles of one sign, at the end and twice in an id."""
    names = [f"x.m{i}{i % 7}1111" for i in range(200)] + ["", "b", "aba"]
    asked = [f"m{i}" for i in range(0, 400, 3)] + ["1111", "11", "b", "ab", "x.m", "absent", "", "a"]
    ids, needles = spark.createDataFrame([(x, x) for x in names], "capability_id string, low string"), spark.createDataFrame([(x,) for x in [*asked, "b"]], "needle string")
    got = [tuple(x) for x in L.containing(ids, needles).collect()]
    assert sorted(got) == sorted({(x, y) for x in names for y in asked if y and y in x})


def test_services_with_a_common_name(spark):
    """of a service's name and its method the one that fewer ids hold is looked up, so a name that all ids hold makes no pair."""
    run = spark.createDataFrame([(f"Service.warehouse.m{i}", None, [], "core", None) for i in range(300)], "id string, label string, source_paths array<string>, category string, handler string")
    caps = spark.createDataFrame([(f"Shop.warehouse.m{i}", "", "core") for i in range(300)], "node_id string, source_path string, category string")
    got = {(r.runtime_id, r.capability_id): r.score for r in L.runtime_capabilities(run, caps, most=300).where(F.col("score") > 50).collect()}
    assert got == {(f"Service.warehouse.m{i}", f"Shop.warehouse.m{j}"): 18 + 40 + 6 * (1 + (i == j and i > 9)) for i in range(300) for j in range(300) if str(j).startswith(str(i))}


def owned_rows(spark, seed):
    """Ids with several paths, with no owner, folded, and linked under other paths only."""
    r = random.Random(seed)
    names = ["A.run", "A.load", "A.x", "B.run", "B.load", "lone", "B.c.run", "B.c.x"]
    caps = [(r.choice(names), r.choice(["p", "q", None]), r.sample(names, r.choice([0, 0, 0, 1])), "core") for _ in range(9)]
    leaves = [(r.choice(names), r.choice(["p", "q"]) if seed % 2 else "pq"[len(x) % 2], i) for i, x in enumerate(r.choices(names, k=12))]
    return spark.createDataFrame(caps, "node_id string, source_path string, folded_leaves array<string>, category string"), spark.createDataFrame(leaves, "node_id string, source_path string, ord long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_owner_links_against_rows(spark, seed):
    """links kept by owner and path, and their counts, are those of rows of pairs."""
    caps, leaves = owned_rows(spark, seed)
    links, rows = L.owner_links(caps, leaves), {(r.capability_id, r.leaf_id): r.relation for r in L.capability_leaves(caps, leaves, None).collect()}
    made = [(r.capability_id, r.leaf_id) for r in links.capabilities.join(links.members, "home").collect()] + [(r.capability_id, r.leaf_id) for r in links.rest.collect()]
    assert sorted(made) == sorted(rows)
    matches = [(f"r{i % 4}", c, 40 + i) for i, c in enumerate(sorted({c for c, _ in rows}) * 2)]
    want = {}
    for run, c, score in matches:
        for x in (y for o, y in rows if o == c):
            want[run, x] = max(want.get((run, x), 0), round(score / 120, 4))
    got = [((r.runtime_id, r.leaf_id), r.confidence) for r in L.runtime_leaves(spark.createDataFrame(matches, "runtime_id string, capability_id string, score int"), links).collect()]
    assert sorted(got) == sorted(want.items())
    run = spark.createDataFrame([(f"R{i}.run", c.split(".")[0], ["p"], "core", c.split(".")[-1]) for i, c in enumerate(["A.run", "B.load", "none", "A.x"])], "id string, label string, source_paths array<string>, category string, handler string")
    view = L.view_map(run, caps, leaves)
    told = view.collect()
    assert len({r.id for r in told}) == len(told) and {(r.from_id, r.to_id): r.relation for r in told if (r.from_view, r.to_view) == ("capability", "leaf")} == rows
    assert L.view_stats(run, caps, leaves).collect() == L.link_stats(view, run.select("id"), caps.select("node_id"), leaves.select("node_id")).collect()


@pytest.mark.parametrize("name", ["j8_runtime_leaves", "a12_link_stats", "c6_view_map"])
def test_large_owners_are_whole(spark, tmp_path, monkeypatch, name):
    """over twelve leaves of an owner and path are all linked, as the SQL has it, and what is stored grows with rows, not pairs."""
    spark.range(0, 60 * 23, 23).selectExpr("id as p_partkey", "'large ring' as p_name", "'SMALL' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    stored = []
    monkeypatch.setattr(L, "cut", lambda df, f=L.cut: stored.append(x := f(df)) or x, raising=False)
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = duck.sql(entry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(tuple(canon(r[c]) for c in order) for r in got) == sorted(tuple(canon(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert max(x.count() for x in stored) < 60 * 10
