"""Failures: frames of a stack trace, the node they point at, what kind of failure it is and what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as X
from .graph import reach
from .linkage import best_frame_node


def frames(traces: DataFrame, root: str = "") -> DataFrame:
    """(trace_id, f_ord, path, line, column, symbol) of each line of (trace_id, text) that names a place inside the root."""
    lines = traces.select("trace_id", F.posexplode(F.split("text", r"\r?\n")).alias("f_ord", "line"))
    return lines.withColumn("f", X.stack_frame(F.col("line"), root)).where("f is not null").select("trace_id", "f_ord", "f.path", "f.line", "f.column", "f.symbol")


def diagnose(traces: DataFrame, nodes: DataFrame, pairs: DataFrame, retries: int = 0, root: str = "") -> DataFrame:
    """A row a trace: (trace_id, diagnosis, action, node_id, score, impacted, risk); no node where no frame fits one."""
    kind = traces.select("trace_id", X.diagnosis(F.col("text")).alias("diagnosis")).withColumn("action", X.action(F.col("diagnosis"), F.lit(retries)))
    best = best_frame_node(frames(traces, root), nodes)
    hit = reach(pairs, best.select("node_id").distinct()).where("origin <> node").groupBy(F.col("origin").alias("node_id")).agg(F.count(F.lit(1)).alias("impacted"))
    return kind.join(best, "trace_id", "left").join(hit, "node_id", "left").na.fill(0, ["impacted"]).withColumn("risk", X.risk_bucket(F.col("impacted"))).select("trace_id", "diagnosis", "action", "node_id", "score", "impacted", "risk")
