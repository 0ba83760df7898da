"""One graph of nodes, planned changes and contract edges for display, with what to hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .edges import end_degree, linked
from .merge import apply_changes
from .shared import many

IMPORTANT = r"(?i)(workflow|pipeline|service|agent|planner|orchestrator|controller|handler|api|route)"


def graph(nodes: DataFrame, changes: DataFrame, edges: DataFrame, most_edges: int = 1500) -> tuple[DataFrame, DataFrame]:
    """(nodes with status, edges): changed nodes' edges come first under the cap; an edge is unique by ends and kind."""
    shown = apply_changes(nodes, changes)
    touched = shown.where("status in ('created', 'modified', 'reused')").select("node_id")
    child = changes.where("op = 'create_child'").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("branch").alias("kind"))
    base = edges.select("src", "dst", F.lit("contract").alias("kind")).distinct()
    hot = base.join(touched, F.col("src") == F.col("node_id"), "left_semi").unionByName(base.join(touched, F.col("dst") == F.col("node_id"), "left_semi")).distinct().withColumn("hot", F.lit(True))
    ranked = base.join(hot, ["src", "dst", "kind"], "left").orderBy(F.coalesce("hot", F.lit(False)).desc(), "src", "dst").limit(most_edges)
    return shown, ranked.select("src", "dst", "kind").unionByName(child).distinct()


def hideable(nodes: DataFrame, edges: DataFrame, primary: Column | None = None) -> DataFrame:
    """(node_id) without primary edges, unchanged, and of no important name."""
    return _apart(nodes, end_degree(edges, primary).where("primary_degree > 0").select("node_id"))


def hideable_by_contracts(nodes: DataFrame, answers: DataFrame, demands: DataFrame) -> DataFrame:
    """F14 where all edges are contract edges and primary: which nodes have one is told by contracts, so no edge is made."""
    return _apart(nodes, linked(answers, demands))


def _apart(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    status = F.col("status") if "status" in nodes.columns else F.lit("unchanged")
    return nodes.where((status == "unchanged") & ~F.col("node_id").rlike(IMPORTANT)).join(many(ends), "node_id", "left_anti").select("node_id")
