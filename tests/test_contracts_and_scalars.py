"""Keys and scalars on hand-made values."""

import pytest
from pyspark.sql import functions as F

from topolake.functions import contracts as K, scalars as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("entry,want", [
    ("RunResult (input)", "RunResult"), ("[Ghost:Read] Db (x)", None), ("None", None), ("string (name)", None), ("[Generic] list[str] (x)", None), ("Map < A , B > (m)", "Map<A,B>"),
    ("typing.Foo (f)", "Foo"), ("Optional[int]", None), ("", None), (None, None), ("SimState (s)", "SimState"), ("Foo(bar)", "Foo"),
])
def test_graph_key_of_demands(spark, entry, want):
    assert one(spark, entry, lambda c: K.key_graph(c, True)) == want


@pytest.mark.parametrize("entry,want", [("string (csvText)", "string(csvText)"), ("void", None), ("RunResult", "RunResult"), ("list[str]", None)])
def test_graph_key_keeps_an_answers_name(spark, entry, want):
    assert one(spark, entry, lambda c: K.key_graph(c, False)) == want


@pytest.mark.parametrize("entry,want", [("[Ghost:Read] X (y)", "x"), ("list[T]", "list"), ("A  B", "a b"), ("(x)", None)])
def test_fanout_key(spark, entry, want):
    got = one(spark, entry, K.key_fanout)
    assert (got.strip() if got else got) == want


@pytest.mark.parametrize("entry,want", [("[Ghost:Read] Db (x)", "Db"), ("none", None), ("Type (a)", "Type"), ("Plain", "Plain")])
def test_ghost_key_counts_ghosts(spark, entry, want):
    assert one(spark, entry, K.key_ghost) == want


def test_neighbour_and_rollup_keys(spark):
    assert one(spark, "Foo (x)", lambda c: K.key_neighbour(c, False)) == "Foo"
    assert one(spark, "[Generic] Foo (x)", lambda c: K.key_neighbour(c, False)) == "[Generic]Foo"
    assert one(spark, "[Generic] Foo (x)", lambda c: K.key_rollup(c, False)) == "Foo"
    assert one(spark, "[Ghost:Read] Foo (x)", lambda c: K.key_rollup(c, True)) is None


@pytest.mark.parametrize("path,want", [("", "/"), ("/a//b/", "/a/b"), ("https://h.x/api/y?q=1#z", "/api/y"), ("/o/${o.id}/run", "/o/:param/run"), ("https://h.x", "/"), ("x", "/x")])
def test_api_path(spark, path, want):
    assert one(spark, path, X.api_path) == want


def test_path_variants(spark):
    assert one(spark, "/api/v1/items/{id}", X.path_variants) == ["/api/v1/items/{id}", "/api/v1/items/:param", "/items/{id}", "/items/:param"]
    assert one(spark, "/api", X.path_variants) == ["/api"]
    assert one(spark, "/apiary/x", X.path_variants) == ["/apiary/x"]


def test_ratio_and_confidence(spark):
    r = spark.range(1).select(X.ratio(F.lit(1), F.lit(3)).alias("a"), X.ratio(F.lit(1), F.lit(0)).alias("b"), X.confidence(F.lit(1.5)).alias("c"), X.confidence(F.lit(None).cast("double")).alias("d"), X.ratio_confidence(F.lit(0.5), F.lit(0.4)).alias("e")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == (0.333333, 0.0, 0.99, 0.5) and r.e == pytest.approx(0.6625)


@pytest.mark.parametrize("entry,want", [("[Ghost:ReadWrite] Db (self.x)", ("read_write", "Db", "self.x")), ("[Ghost:Write] Db (x)", ("read", "unknown", "Db (x)")), ("[Ghost:Read]  (x)", ("read", "unknown", "x"))])
def test_ghost_parts(spark, entry, want):
    assert tuple(one(spark, entry, X.ghost_parts)) == want


def test_node_parts(spark):
    assert tuple(one(spark, "Core.Svc.run", X.node_parts)) == ("core", "Svc", "run")
    assert tuple(one(spark, "Svc", X.node_parts)) == (None, "Svc", "execute")
    assert one(spark, "..", X.node_parts) is None


def test_stack_frame_and_diagnosis(spark):
    assert tuple(one(spark, "  at Svc.run (/w/src/a.ts:3:9)", lambda c: X.stack_frame(c, "/w"))) == ("src/a.ts", 3, 9, "Svc.run")
    assert one(spark, "  at x (/other/a.ts:3:9)", lambda c: X.stack_frame(c, "/w")) is None
    assert one(spark, "Error: schema mismatch", X.diagnosis) == "contract" and one(spark, "fine", X.diagnosis) == "unknown"
