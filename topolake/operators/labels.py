"""The best label of a runtime node among its metadata, its label and its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import element

from ..functions import scalars as X

#: Metadata that may name a node, best first.
KEYS = ["displayName", "name", "handler", "service", "workflow", "task", "worker", "operation", "path", "route"]


def human_id(node_id: Column) -> Column:
    """An id as words: its last dotted part; a route as method and path."""
    parts = F.split(node_id, r"\.")
    tail = F.trim(F.regexp_replace(F.regexp_replace(element(parts, -1), "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2"))
    route = (F.get(parts, F.lit(0)) == "ApiRoute") & (F.size(parts) >= 3)
    return F.when(F.coalesce(node_id, F.lit("")) == "", F.lit("unknown-runtime-node")).when(route, F.concat_ws(" ", F.get(parts, F.lit(1)), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "."))).otherwise(tail)


def choose_labels(nodes: DataFrame) -> DataFrame:
    """Rows with `best`, `source`, `low_signal`: the highest score, the first of equals; candidates are told apart by lower case."""
    meta = lambda k: F.trim(element("metadata", k))
    route = F.when(F.col("type") == "ApiRoute", F.concat_ws(" ", F.upper(meta("method")), meta("path")))
    values = [("metadata", route), *(("metadata", meta(k)) for k in KEYS), ("node_label", F.trim("label")), ("node_id", human_id(F.col("id")))]
    cands = F.array(*(F.struct(F.lit(src).alias("source"), v.alias("value"), F.lit(-i).alias("at")) for i, (src, v) in enumerate(values)))
    cands = F.filter(cands, lambda c: F.coalesce(c["value"], F.lit("")) != "")
    scored = F.transform(cands, lambda c: F.struct(X.label_score(c["value"])["score"].alias("score"), c["at"].alias("at"), c["value"].alias("value"), c["source"].alias("source"), X.label_score(c["value"])["low_signal"].alias("low")))
    return nodes.withColumn("_b", F.array_max(scored)).withColumns({"best": F.coalesce("_b.value", "id"), "source": F.coalesce("_b.source", F.lit("node_id")), "low_signal": F.coalesce("_b.low", F.lit(False))}).drop("_b")


#: Groups that runtime types are drawn in.
GROUPS = {"ApiRoute": "api", "FrontendEntry": "frontend", "FrontendComponent": "frontend", "Service": "service", "Workflow": "workflow", "WorkflowNode": "workflow", "WorkflowEdge": "workflow", "Task": "task", "Worker": "task", "Queue": "task", "Scheduler": "task", "DataStore": "resource", "Cache": "resource", "ObjectStore": "resource", "FileSystem": "resource", "ExternalApi": "external", "ExternalTool": "external", "ModelProvider": "external", "MessageProducer": "event", "EventConsumer": "event", "Config": "infra", "Secret": "infra"}


def group_of(kind: Column) -> Column:
    """Drawing group of a runtime type."""
    return F.coalesce(element(F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv)), kind), F.lit("other"))
