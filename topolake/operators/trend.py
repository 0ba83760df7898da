"""Snapshots over time: risk, surges, drift and bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import ratio
from .edges import degrees, edges_of, linked
from .graph import cycles
from .metrics import execute_like, has_ghost
from .shared import many


def risk(nodes: DataFrame, degree: DataFrame, in_least: int = 5, out_least: int = 5, least: int = 8, top: int = 80) -> DataFrame:
    """The riskiest nodes: ghost, or degrees at or over the limits; risk = degree + 5 ghost + 1 execute-like."""
    rows = nodes.select("node_id", has_ghost(F.col("demand")).alias("ghost"), execute_like(F.col("node_id")).alias("execute_like")).join(degree, "node_id", "left").na.fill(0, ["in_degree", "out_degree", "degree"])
    score = F.col("degree") + F.when(F.col("ghost"), 5).otherwise(0) + F.when(F.col("execute_like"), 1).otherwise(0)
    kept = rows.where(F.col("ghost") | (F.col("in_degree") >= in_least) | (F.col("out_degree") >= out_least) | (F.col("degree") >= least))
    return kept.withColumn("risk", score.cast("long")).orderBy(F.desc("risk"), "node_id").limit(top)


def surges(now: DataFrame, before: DataFrame, least: int = 3) -> DataFrame:
    """(node_id, previous, current, delta) where (node_id, degree) changed by `least` or more; absent counts 0."""
    both = now.select("node_id", F.col("degree").alias("current")).join(before.select("node_id", F.col("degree").alias("previous")), "node_id", "full").na.fill(0, ["current", "previous"])
    return both.withColumn("delta", F.col("current") - F.col("previous")).where(F.abs("delta") >= least)


def edge_keys(edges: DataFrame) -> DataFrame:
    """Distinct keys src::contract::dst."""
    return edges.select(F.concat_ws("::", "src", "contract", "dst").alias("key")).distinct()


def edge_drift(now: DataFrame, before: DataFrame, most: int | None = 50) -> DataFrame:
    """(change, key) of keys added and removed; the first `most` of each in order, all without a limit."""
    added = now.join(before, "key", "left_anti").select(F.lit("added").alias("change"), "key")
    gone = before.join(now, "key", "left_anti").select(F.lit("removed").alias("change"), "key")
    if most is None:
        return added.unionByName(gone)
    return added.orderBy("key").limit(most).unionByName(gone.orderBy("key").limit(most))


def set_changes(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(change, key) of rows on one side only."""
    return now.join(before, key, "left_anti").select(F.lit("added").alias("change"), key).unionByName(before.join(now, key, "left_anti").select(F.lit("removed").alias("change"), key))


def broken_contracts(old_answers: DataFrame, new_answers: DataFrame, new_demands: DataFrame) -> DataFrame:
    """(node_id, contract, producers): demands nobody answers now, and who did before."""
    lost = new_demands.join(new_answers.select("contract").distinct(), "contract", "left_anti")
    had = old_answers.groupBy("contract").agg(F.sort_array(F.collect_set("node_id")).alias("producers"))
    return lost.join(had, "contract").select("node_id", "contract", "producers")


def removed_edges(old: DataFrame, new: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Edges that are gone though both their ends are still there."""
    ids = new_nodes.select(F.col("node_id").alias("_n")).distinct()
    live = old.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")
    return live.join(new, ["src", "dst", "contract"], "left_anti")


def removed_contract_edges(old_answers: DataFrame, old_demands: DataFrame, new_answers: DataFrame, new_demands: DataFrame | None = None) -> DataFrame:
    """J13 over distinct sides of contracts, the new demands the old ones if none are given: the same edges as `removed_edges`.

    An edge is gone if one of its sides is, so only sides that are gone are joined, and neither version's edges are made.
    """
    key = ["node_id", "contract"]
    ends = linked(new_answers, old_demands if new_demands is None else new_demands)
    a, d = (x.select(*key).join(many(ends), "node_id", "left_semi") for x in (old_answers, old_demands))
    gone = edges_of(a.join(many(new_answers.select(*key)), key, "left_anti"), d)
    if new_demands is None:
        return gone
    stay = a.join(many(new_answers.select(*key)), key, "left_semi")
    return gone.unionByName(edges_of(stay, d.join(many(new_demands.select(*key)), key, "left_anti")))


def new_cycles(old_pairs: DataFrame, new_pairs: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Cycles whose members did not form one before."""
    return cycles(new_pairs, new_nodes).select("signature").join(cycles(old_pairs, old_nodes).select("signature"), "signature", "left_anti")


def degraded(new_cycle_rows: DataFrame, broken: DataFrame, removed: DataFrame) -> DataFrame:
    """One row of counts, and whether any is over 0."""
    parts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((new_cycle_rows, "new_cycles"), (broken, "broken_contracts"), (removed, "removed_edges"))]
    out = parts[0].join(parts[1]).join(parts[2])  # one-row frames
    return out.withColumn("degraded", (F.col("new_cycles") > 0) | (F.col("broken_contracts") > 0) | (F.col("removed_edges") > 0))


def snapshot(nodes: DataFrame, edges: DataFrame, runtime_nodes: DataFrame | None = None, runtime_edges: DataFrame | None = None, diagnostics: DataFrame | None = None) -> dict[str, DataFrame]:
    """A snapshot as tables: `totals` (one row), `risk`, `degree` (a row a node), `keys` and `runtime_keys` (a row an edge).

    Kept as rows, not as one document, so a snapshot of any size is written, and compared by joins.
    """
    degree = degrees(edges)
    every = nodes.select("node_id").distinct().join(degree.select("node_id", "degree"), "node_id", "left").na.fill(0, ["degree"])
    ghost = F.count_if(has_ghost(F.col("demand")))
    totals = nodes.agg(F.count(F.lit(1)).alias("nodes"), ratio(F.count_if(execute_like(F.col("node_id"))), F.count(F.lit(1))).alias("execute_like_ratio"), ratio(ghost, F.count(F.lit(1))).alias("ghost_ratio")).join(edges.agg(F.count(F.lit(1)).alias("edges")))
    spark = nodes.sparkSession
    some = lambda df, schema: df if df is not None else spark.createDataFrame([], schema)
    links = some(runtime_edges, "src string, type string, dst string")
    no_code = F.count_if(F.coalesce(F.trim("code"), F.lit("")) == "")
    for part in (some(runtime_nodes, "id string").agg(F.count(F.lit(1)).alias("runtime_nodes")), links.agg(F.count(F.lit(1)).alias("runtime_edges")), some(diagnostics, "code string").agg(no_code.alias("diagnostics_no_code"))):  # one-row frames
        totals = totals.join(part)
    keys = links.select(F.concat_ws("::", "src", "type", "dst").alias("key")).distinct()
    return {"totals": totals, "risk": risk(nodes, degree), "degree": every, "keys": edge_keys(edges), "runtime_keys": keys}


def report(now: dict[str, DataFrame], before: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """(measure, value) of what is and what changed between two snapshots; edges count up to `most` a side, as they are listed."""
    drifts = lambda keys, prefix: edge_drift(now[keys], before[keys], most).groupBy(F.concat(F.lit(prefix), "change").alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    drift = drifts("keys", "edges_").unionByName(drifts("runtime_keys", "runtime_edges_"))
    shift = set_changes(now["risk"].select("node_id"), before["risk"].select("node_id"), "node_id").groupBy(F.concat(F.lit("risk_"), "change").alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    jumped = surges(now["degree"], before["degree"]).agg(F.count(F.lit(1)).alias("value")).select(F.lit("surges").alias("measure"), "value")
    risky = now["risk"].agg(F.count(F.lit(1)).alias("value")).select(F.lit("risk_total").alias("measure"), "value")
    measures = ("nodes", "edges", "runtime_nodes", "runtime_edges", "diagnostics_no_code", "execute_like_ratio", "ghost_ratio")
    size = now["totals"].select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("x")).select("x.*")
    out = drift.unionByName(shift).unionByName(jumped).unionByName(risky)
    return size.unionByName(out.select("measure", F.col("value").cast("double").alias("value")))


def keep_newest(history: DataFrame, window: int = 26, by: str = "generated_at") -> DataFrame:
    """The newest snapshots."""
    return history.orderBy(F.desc(by)).limit(window)


def compared(history: DataFrame, values: list[str], by: str = "generated_at", keys: list[str] | None = None) -> DataFrame:
    """Each snapshot with the one before it and the change of each value; per series if keys are given."""
    w = Window.partitionBy(*(keys or [])).orderBy(by)
    out = history.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values})
    return out.withColumns({f"delta_{v}": F.col(v) - F.col(f"prev_{v}") for v in values})
