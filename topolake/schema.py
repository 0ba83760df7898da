"""Schemas of the datasets: nodes with contracts, runtime nodes and edges, evidence, diagnostics, links, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODE = (
    "node_id string, category string, source_path string, problem string, demand array<string>, answer array<string>, "
    "ghost_reads array<struct<raw:string,mode:string,target:string,value_type:string,retained:boolean,score:int>>, "
    "promotion_reasons array<string>, folded_leaves array<string>, ord bigint"
)
EVIDENCE = ("source_path string, line int, column int, kind string, text string, confidence double")
RT_NODE = ("id string, type string, label string, source_path string, category string, framework string, metadata map<string,string>, evidence array<struct<source_path:string,line:int,column:int,kind:string,text:string,confidence:double>>, ord bigint")
RT_EDGE = ("id string, src string, dst string, type string, label string, metadata map<string,string>, confidence double, evidence array<struct<source_path:string,line:int,column:int,kind:string,text:string,confidence:double>>, ord bigint")
DIAG = ("level string, code string, component string, message string, source_path string, node_id string")
EDGE = ("src string, dst string, contract string")
LINK = ("id string, from_view string, from_id string, to_view string, to_id string, relation string, confidence double, reason string, source_path string")
RULE = ("key string, op string, num double, flag boolean, must_pass boolean")
METRIC = ("key string, num double, flag boolean")
SNAPSHOT = (
    "generated_at timestamp, node_count bigint, edge_count bigint, execute_like_ratio double, ghost_ratio double, "
    "high_risk array<struct<node_id:string,degree:bigint,risk:bigint>>, centrality map<string,bigint>, edge_keys array<string>"
)

# The kinds of runtime nodes that each view shows.
VIEW_TYPES = {
    "workflow": ["Workflow", "WorkflowNode", "WorkflowEdge", "Task", "Worker", "Queue", "Service"],
    "request-flow": ["FrontendEntry", "FrontendComponent", "ApiRoute", "Service", "Task", "Worker", "Queue", "DataStore", "Cache", "ObjectStore", "ExternalApi"],
    "resources": ["Service", "WorkflowNode", "Task", "DataStore", "ObjectStore", "Cache", "FileSystem", "ExternalApi", "ExternalTool", "ModelProvider"],
    "events": ["MessageProducer", "EventConsumer", "Queue", "Worker", "Task"],
    "infra": ["DataStore", "ObjectStore", "Cache", "Queue", "Config", "Secret", "Scheduler"],
}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
