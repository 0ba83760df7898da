"""JSON datasets in and out: lenient readers that give empty tables and a diagnostic, and writers with fallbacks and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .. import schema as S


def diag(spark: SparkSession, level: str, code: str, component: str, message: str, path: str | None = None) -> DataFrame:
    return spark.createDataFrame([(level, code, component, message, path, None)], S.DIAG)


#: JSON names of columns, by dataset.
NODE_JSON = (
    "nodeId string, category string, sourcePath string, fission struct<problem:string,demand:array<string>,answer:array<string>,"
    "evidence:struct<ghostReads:array<struct<raw:string,mode:string,target:string,valueType:string,retainedInDemand:boolean,score:int>>,promotionReasons:array<string>>>, topology struct<foldedLeaves:array<string>>"
)
EVIDENCE_JSON = "array<struct<sourcePath:string,line:int,column:int,kind:string,text:string,confidence:double>>"
RUNTIME_JSON = (
    f"nodes array<struct<id:string,type:string,label:string,sourcePath:string,category:string,framework:string,metadata:map<string,string>,evidence:{EVIDENCE_JSON}>>, "
    f"edges array<struct<id:string,from:string,to:string,type:string,label:string,metadata:map<string,string>,confidence:double,evidence:{EVIDENCE_JSON}>>, "
    "diagnostics array<struct<level:string,code:string,extractor:string,message:string,sourcePath:string>>"
)


def _shape(spark: SparkSession, path: str) -> Row | None:
    """What a document is, as its executors see it: null where it can't be read, else its first sign and what of it is valid.

    The document itself does not come to the driver.
    """
    doc = F.regexp_replace("value", "^﻿", "")
    try:
        rows = spark.read.text(path, wholetext=True).select(F.left(F.trim(F.regexp_replace(doc, r"^\s+", "")), F.lit(1)).alias("first"), F.json_array_length(doc).isNotNull().alias("array"), F.json_object_keys(doc).alias("keys"),
            *(F.coalesce(F.left(F.trim(F.get_json_object(doc, f"$.{k}")), F.lit(1)) == "[", F.lit(False)).alias(k) for k in ("nodes", "edges"))).collect()  # one row of a few signs
    except Exception as e:  # noqa: BLE001  Spark names a missing path in several ways
        if "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e) or "does not exist" in str(e):
            return None
        raise
    return rows[0] if rows else None


def read_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """NODE rows of a node map (a JSON array), and DIAG rows: a missing file or another shape gives no nodes."""
    shape = _shape(spark, path)
    none, fine = S.empty(spark, S.NODE), S.empty(spark, S.DIAG)
    if shape is None:
        return none, diag(spark, "warning", "NODE_MAP_MISSING", "DatasetReader", f"node map missing: {path}", path)
    if not shape["array"]:
        return none, diag(spark, "error", "NODE_MAP_INVALID", "DatasetReader", f"node map is not a valid array: {path}", path)
    # the document is read again by the executors, with its schema
    rows = spark.read.schema("doc string").text(path, wholetext=True).select(F.posexplode(F.from_json(F.regexp_replace("doc", "^﻿", ""), f"array<struct<{_struct(NODE_JSON)}>>")).alias("ord", "n"))
    ghosts = F.transform("n.fission.evidence.ghostReads", lambda g: F.struct(g["raw"].alias("raw"), g["mode"].alias("mode"), g["target"].alias("target"), g["valueType"].alias("value_type"), F.coalesce(g["retainedInDemand"], F.lit(False)).alias("retained"), g["score"].alias("score")))
    none_of = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    out = rows.select(
        F.col("n.nodeId").alias("node_id"), F.col("n.category").alias("category"), F.col("n.sourcePath").alias("source_path"), F.col("n.fission.problem").alias("problem"), none_of(F.col("n.fission.demand")).alias("demand"), none_of(F.col("n.fission.answer")).alias("answer"),
        F.coalesce(ghosts, F.slice(ghosts, 1, 0), F.array().cast("array<struct<raw:string,mode:string,target:string,value_type:string,retained:boolean,score:int>>")).alias("ghost_reads"), none_of(F.col("n.fission.evidence.promotionReasons")).alias("promotion_reasons"), none_of(F.col("n.topology.foldedLeaves")).alias("folded_leaves"), F.col("ord").cast("long"),
    )
    return out, fine


def _struct(ddl: str) -> str:
    """Top-level columns of a DDL as struct fields."""
    out, depth = [], 0
    word = ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"`{name}`:{kind}")
            word = ""
        else:
            word += c
    return ",".join(out)


def read_runtime(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RT_NODE, RT_EDGE and DIAG rows of a runtime map (a JSON object); missing or misshapen gives none and a diagnostic."""
    shape = _shape(spark, path)
    n, e = S.empty(spark, S.RT_NODE), S.empty(spark, S.RT_EDGE)
    if shape is None:
        return n, e, diag(spark, "warning", "RUNTIME_MAP_MISSING", "DatasetReader", f"runtime map missing: {path}", path)
    if shape["keys"] is None or not (shape["nodes"] and shape["edges"]):
        return n, e, diag(spark, "error", "RUNTIME_MAP_INVALID", "DatasetReader", f"runtime map is not a valid object: {path}", path)
    doc = spark.read.schema("doc string").text(path, wholetext=True).select(F.from_json(F.regexp_replace("doc", "^﻿", ""), f"struct<{_struct(RUNTIME_JSON)}>").alias("d"))
    ev = lambda c: F.transform(F.col(c), lambda x: F.struct(x["sourcePath"].alias("source_path"), x["line"].alias("line"), x["column"].alias("column"), x["kind"].alias("kind"), x["text"].alias("text"), x["confidence"].alias("confidence")))
    nodes = doc.select(F.posexplode("d.nodes").alias("ord", "n")).select("n.id", "n.type", "n.label", F.col("n.sourcePath").alias("source_path"), "n.category", "n.framework", "n.metadata", ev("n.evidence").alias("evidence"), F.col("ord").cast("long"))
    edges = doc.select(F.posexplode("d.edges").alias("ord", "e")).select("e.id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.type", "e.label", "e.metadata", "e.confidence", ev("e.evidence").alias("evidence"), F.col("ord").cast("long"))
    diags = doc.select(F.explode("d.diagnostics").alias("x")).select("x.level", "x.code", F.col("x.extractor").alias("component"), "x.message", F.col("x.sourcePath").alias("source_path"), F.lit(None).cast("string").alias("node_id"))
    return nodes, edges, diags


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """DIAG rows of a bare array or of an object with a `diagnostics` array; none from anything else."""
    if _shape(spark, path) is None:
        return S.empty(spark, S.DIAG)
    item = "struct<level:string,code:string,extractor:string,message:string,sourcePath:string>"
    doc = spark.read.schema("doc string").text(path, wholetext=True).select(F.regexp_replace("doc", "^﻿", "").alias("doc"))
    bare = F.when(F.trim("doc").startswith("["), F.from_json("doc", f"array<{item}>"))
    return doc.select(F.explode(F.coalesce(bare, F.from_json("doc", f"struct<diagnostics:array<{item}>>")["diagnostics"])).alias("x")).select("x.level", "x.code", F.col("x.extractor").alias("component"), "x.message", F.col("x.sourcePath").alias("source_path"), F.lit(None).cast("string").alias("node_id"))


# sinks


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """K1, K2, K3, K5: a dataset as Parquet or JSON lines."""
    df.write.mode(mode).format(form).save(path)


def write_or_empty(build: Callable[[], DataFrame], schema: str, path: str, spark: SparkSession, code: str = "DATASET_WRITE_FAILED") -> DataFrame:
    """K7: write what `build` gives; if that fails write an empty dataset; DIAG rows say which."""
    try:
        write(build(), path)
        return S.empty(spark, S.DIAG)
    except Exception as e:  # noqa: BLE001  whatever the plan fails with is reported as data
        write(S.empty(spark, schema), path)
        return diag(spark, "error", code, "DatasetWriter", str(e).splitlines()[0][:240], path)


def append_snapshot(snapshot: DataFrame, path: str, window: int = 26) -> DataFrame:
    """K4: add a snapshot to a history and keep the newest `window`; the history is written beside and read back by version.

    Versions are folders v0, v1... under `path`; a reader takes the last. Returns the history.
    """
    spark = snapshot.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop) if s.getPath().getName()[1:].isdigit()) if fs.exists(hadoop) else []
    old = spark.read.parquet(f"{path}/v{versions[-1]}") if versions else None
    every = snapshot if old is None else old.unionByName(snapshot)
    new = f"{path}/v{(versions[-1] if versions else -1) + 1}"
    every.orderBy(F.desc("generated_at")).limit(window).write.parquet(new)
    return spark.read.parquet(new)


def snapshot_index(entries: DataFrame, keep: int = 30) -> DataFrame:
    """K8: the newest entries of a snapshot index, newest first."""
    return entries.orderBy(F.desc("created_at")).limit(keep)


def restore(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """K8: (path, content, change) that bring files back to a snapshot (path, exists, content): restored, removed or left."""
    both = snapshot.select("path", F.col("exists").alias("e"), F.col("content").alias("old")).join(now.select("path", F.col("content").alias("cur")), "path", "full")
    change = F.when(F.col("e").isNull(), "left").when(~F.col("e"), F.when(F.col("cur").isNull(), "left").otherwise("removed")).when(F.col("old").eqNullSafe(F.col("cur")), "left").otherwise("restored")
    return both.select("path", F.when(change == "restored", F.col("old")).otherwise(F.col("cur")).alias("content"), change.alias("change"))


def protocol_files(actions: DataFrame, nodes: DataFrame, fixed: list[str] = ()) -> DataFrame:
    """C17: distinct source paths that a change set touches: its own path, else its target's, else its parent's; and fixed files."""
    where = nodes.select("node_id", "source_path")
    rows = actions.where("op <> 'reuse'").join(where.withColumnRenamed("source_path", "_t"), "node_id", "left").join(where.select(F.col("node_id").alias("parent_id"), F.col("source_path").alias("_p")), "parent_id", "left")
    out = rows.select(F.coalesce("source_path", "_t", "_p").alias("path")).where("path is not null")
    if fixed:
        out = out.unionByName(actions.sparkSession.createDataFrame([(f,) for f in fixed], "path string"))
    return out.distinct()


def markdown(title: str, rows: DataFrame, columns: list[str], most: int = 30) -> str:
    """K6: a report of a small result: a title and its first rows as a list."""
    lines = [f"# {title}", ""]
    got = rows.select(*columns).limit(most).collect()
    lines += [f"- {', '.join(f'{c}={r[c]}' for c in columns)}" for r in got] or ["- None"]
    return "\n".join([*lines, ""])
