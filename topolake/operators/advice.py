"""Findings from measures, proposals from findings and from the shape of the contract graph, and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import element

from ..functions import scalars as X
from .graph import contract_cycles

# Words of nodes that orchestrate, beginnings of methods that are pieces.
ORCHESTRATION = r"(?i)(workflow|orchestrate|dispatch|pipeline|plan|apply|bootstrap|sync)"
FRAGMENT = r"(?i)^(build|parse|format|normalize|sanitize|validate|resolve|collect|load|save|get|set)"


def findings(vector: DataFrame, fanout_nodes: Column | int = 0) -> DataFrame:
    """(finding, severity, confidence, ord) that a one-row measure vector gives, worst first, else in rule order."""
    c = F.col
    fan = fanout_nodes if isinstance(fanout_nodes, Column) else F.lit(fanout_nodes)
    n = c("runtime_unmatched_route_count")
    rules = [
        ("FINDING_EXECUTE_RATIO_HIGH", c("execute_like_ratio") >= 0.1, F.lit("warning"), X.ratio_confidence(c("execute_like_ratio"), F.lit(0.1))),
        ("FINDING_GHOST_RATIO_HIGH", c("ghost_ratio") >= 0.4, F.lit("warning"), X.ratio_confidence(c("ghost_ratio"), F.lit(0.4))),
        ("FINDING_RUNTIME_UNMATCHED_ROUTES", n > 0, F.when(n > 22, "error").otherwise("warning"), F.greatest(F.lit(0.0), F.least(F.lit(0.95), 0.55 + n * 0.02))),
        ("FINDING_RUNTIME_RENDER_INCONSISTENT", ~c("rendered_edges_consistency"), F.lit("error"), F.lit(0.9)),
        ("FINDING_RUNTIME_DIAGNOSTICS_NO_CODE", c("diagnostics_no_code") > 0, F.lit("error"), F.lit(0.95)),
        ("FINDING_HIGH_FANOUT_CAPABILITY", fan > 0, F.lit("warning"), F.lit(0.76)),
    ]
    rows = F.array(*(F.when(ok, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("finding"), sev.alias("severity"), conf.cast("double").alias("confidence"))) for i, (name, ok, sev, conf) in enumerate(rules)))
    out = vector.select(F.explode(F.array_compact(rows)).alias("f")).select("f.*")
    return out.orderBy((F.col("severity") == "error").desc(), "ord")


#: Finding, proposal, priority, the most confidence it takes over, or its own.
PROPOSALS = [
    ("FINDING_EXECUTE_RATIO_HIGH", "CAPABILITY_EXECUTE_DENOISE", "high", 0.92, None), ("FINDING_GHOST_RATIO_HIGH", "GHOST_SIGNAL_REBALANCE", "high", 0.9, None),
    ("FINDING_RUNTIME_UNMATCHED_ROUTES", "RUNTIME_ROUTE_ALIGNMENT", "medium", 0.88, None), ("FINDING_HIGH_FANOUT_CAPABILITY", "SPLIT_HIGH_FANOUT", "medium", None, 0.79),
    ("FINDING_RUNTIME_RENDER_INCONSISTENT", "RUNTIME_RENDER_PARITY", "high", None, 0.9), ("FINDING_RUNTIME_DIAGNOSTICS_NO_CODE", "DIAGNOSTICS_CONTRACT_ENFORCEMENT", "high", None, 0.95),
]


def proposals(found: DataFrame, least: float = 0.55, most: int = 5) -> DataFrame:
    """(proposal, finding, priority, confidence) ranked by priority, confidence, name."""
    table = found.sparkSession.createDataFrame(PROPOSALS, "finding string, proposal string, priority string, cap double, own double")
    rows = found.join(F.broadcast(table), "finding").withColumn("confidence", F.coalesce("own", F.least("confidence", "cap")))
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    return rows.where(F.col("confidence") >= least).orderBy(rank.desc(), F.desc("confidence"), "proposal").limit(most).select("proposal", "finding", "priority", "confidence")


def fragment_groups(nodes: DataFrame, fan: DataFrame, least: int = 3) -> DataFrame:
    """(group_key, size, helpers, paths, mean_fanout) of nodes of one owner and path that look like pieces of one thing."""
    parts = F.filter(F.split("node_id", r"\."), lambda x: x != "")
    owner = F.when(F.size(parts) >= 2, F.get(parts, (F.size(parts) - 2).cast("int"))).otherwise(F.get(parts, F.lit(0)))
    path = F.trim(F.coalesce("source_path", F.lit("")))
    key = F.when(path != "", F.concat_ws("@", owner, path)).otherwise(owner)
    rows = nodes.join(fan.select("node_id", "downstream_count"), "node_id", "left").select(key.alias("group_key"), "node_id", element(parts, -1).alias("method"), path.alias("path"), F.coalesce("downstream_count", F.lit(0)).alias("n"))
    out = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("method").rlike(FRAGMENT)).alias("helpers"), F.countDistinct(F.when(F.col("path") != "", F.col("path"))).alias("paths"), F.avg("n").alias("mean_fanout"), F.sort_array(F.collect_list("node_id")).alias("members"))
    return out.where((F.col("size") >= least) & ((F.col("helpers") > 0) | ((F.col("paths") <= 1) & (F.col("mean_fanout") <= 1.5))))


def restructure(nodes: DataFrame, edges: DataFrame | None, fan: DataFrame, split_at: int = 6, sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(operation, target, targets, score) best first: cycles to collapse, fat nodes to split, pieces to gather; or a start.

    sides: what nodes answer and demand, each (node_id, contract), in place of edges, which grow with the pairs that share a contract.
    """
    ids = nodes.select("node_id").distinct()
    if sides is None:
        key = F.to_json(F.array("src", "dst")).alias("contract")  # an edge is a contract of its own
        sides = edges.select(F.col("src").alias("node_id"), key), edges.select(F.col("dst").alias("node_id"), key)
    loops = contract_cycles(*sides, ids)
    a = loops.select(F.lit("renormalize").alias("operation"), F.get("members", F.lit(0)).alias("target"), F.col("members").alias("targets"), (1000 + 20 * F.size("members") + F.col("blast")).cast("long").alias("score"))
    mixes = nodes.select("node_id", (F.col("node_id").rlike(ORCHESTRATION) | F.coalesce(F.col("problem").rlike(ORCHESTRATION), F.lit(False))).alias("mix"))
    b = fan.where(F.col("downstream_count") >= split_at).join(mixes, "node_id").select(F.lit("split").alias("operation"), F.col("node_id").alias("target"), F.array("node_id").alias("targets"), (500 + 10 * F.col("downstream_count") + F.when(F.col("mix"), 25).otherwise(0)).cast("long").alias("score"))
    g = fragment_groups(nodes, fan)
    c = g.select(F.lit("aggregate").alias("operation"), F.col("group_key").alias("target"), F.col("members").alias("targets"), (200 + 10 * F.col("size") + 6 * F.col("helpers") + F.greatest(F.lit(0), 5 - F.floor(F.col("mean_fanout") + 0.5))).cast("long").alias("score"))
    every = a.unionByName(b).unionByName(c)
    widest = fan.orderBy(F.desc("downstream_count"), "node_id").limit(1).select("node_id", F.lit(0).alias("o"))
    start = widest.unionByName(ids.orderBy("node_id").limit(1).withColumn("o", F.lit(1))).orderBy("o").limit(1)
    fallback = start.join(every.limit(1).select(F.lit(True).alias("_some")), F.lit(True), "left_anti").select(F.lit("split").alias("operation"), F.col("node_id").alias("target"), F.array("node_id").alias("targets"), F.lit(100).cast("long").alias("score"))
    return every.unionByName(fallback).orderBy(F.desc("score"), "target")


#: Categories that a proposal may name; others are unknown.
KNOWN_CATEGORIES = ["frontend", "backend", "core", "unknown"]


def _tidy(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(X.slashes(F.trim(F.coalesce(path, F.lit("")))), r"^\.?/", ""), "/{2,}", "/")


def consistent(plans: DataFrame, actions: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, actions, DIAG rows) with the categories that their source paths have, and what that changed.

    plans: (proposal, category, source_path); actions: (proposal, i, op, node_id, category, source_path). A proposal without a
    path (null) takes that of its first action that creates or modifies; paths that fit no category, and none, are unknown.
    """
    from .linkage import categories

    known = lambda c: F.when(F.col(c).isin(KNOWN_CATEGORIES), F.col(c)).otherwise("unknown")
    scope = F.when(F.col("op") == "create_child", "protocolDraft.actions.node").when(F.col("op") == "modify", "protocolDraft.actions")
    told = actions.withColumns({"scope": scope, "previous": known("category"), "source_path": _tidy(F.col("source_path"))})
    first = told.where("scope is not null and source_path <> ''").groupBy("proposal").agg(F.min(F.struct("i", "source_path")).alias("f")).select("proposal", F.col("f.source_path").alias("_p"))
    own = plans.join(first, "proposal", "left").select("proposal", known("category").alias("previous"), _tidy(F.coalesce("source_path", "_p")).alias("source_path"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = own.select("proposal", F.lit("proposal").alias("scope"), none("int").alias("i"), none("string").alias("op"), none("string").alias("node_id"), "previous", "source_path").unionByName(told.select("proposal", "scope", F.col("i").cast("int"), "op", "node_id", "previous", "source_path"))
    done = categories(rows, prefixes).withColumn("resolved", F.when(F.col("source_path") != "", F.col("resolved")).otherwise("unknown"))
    label = F.concat_ws(" | ", F.concat(F.lit("Proposal "), "proposal"), "scope", F.concat(F.lit("action#"), F.col("i").cast("string")), F.concat(F.lit("node="), "node_id"))
    fixed = F.when((F.col("source_path") != "") & (F.col("previous") != F.col("resolved")), F.struct(F.lit("DREAM_PROPOSAL_CATEGORY_MISMATCH_AUTO_FIXED").alias("code"), F.concat(label, F.lit(" category auto-fixed: "), "previous", F.lit(" -> "), "resolved").alias("message")))
    why = F.when(F.col("source_path") != "", " sourcePath cannot map to configured categories; category=unknown").otherwise(" has no resolvable sourcePath; category=unknown")
    lost = F.when(F.col("resolved") == "unknown", F.struct(F.lit("DREAM_PROPOSAL_CATEGORY_UNRESOLVED").alias("code"), F.concat(label, why).alias("message")))
    diags = done.where("scope is not null").select(F.explode(F.array_compact(F.array(fixed, lost))).alias("d"), "source_path").select(F.lit("warning").alias("level"), "d.code", F.lit("DreamProposalValidator").alias("component"), "d.message", F.when(F.col("source_path") != "", F.col("source_path")).alias("source_path"))
    path = F.when(F.col("source_path") != "", F.col("source_path")).alias("source_path")
    return done.where("scope = 'proposal'").select("proposal", F.col("resolved").alias("category"), path), done.where("i is not null").select("proposal", "i", "op", "node_id", F.when(F.col("scope").isNotNull(), F.col("resolved")).otherwise(F.col("previous")).alias("category"), path), diags
