"""Whether the artifacts of a change stay on one target: aligned references, and a class that closes around the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import element

#: Sources of a focus, the one that leads first.
SOURCES = ["draft-protocol.json microSplit", "micro-split.json", "draft-protocol.json macroSplit", "draft-protocol.json mesoSplit"]


def canonical(references: DataFrame) -> DataFrame:
    """The leading complete reference (source, focus, operation), one row or none."""
    full = references.where((F.trim("focus") != "") & (F.trim("operation") != "")).select("source", F.trim("focus").alias("focus"), F.lower(F.trim("operation")).alias("operation"))
    place = F.array_position(F.array(*(F.lit(s) for s in SOURCES)), F.col("source"))
    return full.orderBy(F.when(place == 0, 99).otherwise(place), "source").limit(1)


def alignment(references: DataFrame) -> DataFrame:
    """(source, problem) of references that lack a part or differ from the leading one."""
    f, o = F.coalesce(F.trim("focus"), F.lit("")), F.lower(F.coalesce(F.trim("operation"), F.lit("")))
    lead = canonical(references).select(F.col("focus").alias("_f"), F.col("operation").alias("_o"))
    short = references.where((f == "") | (o == "")).select("source", F.lit("incomplete").alias("problem"))
    drift = references.where((f != "") & (o != "")).join(F.broadcast(lead)).where((f != F.col("_f")) | (o != F.col("_o"))).select("source", F.lit("drift").alias("problem"))  # one row
    return short.unionByName(drift)


def closure(references: DataFrame, classes: DataFrame) -> DataFrame:
    """(artifact, problem) where a focused class is missing, one-sided, or lacks the focused method.

    classes: (artifact, class_name, static array<string>, dynamic array<struct<name,responsibility>>).
    """
    node = F.split(F.col("focus"), "@")[0]
    parts = F.filter(F.split(node, r"\."), lambda x: x != "")
    target = canonical(references).select(F.when(F.size(parts) >= 2, F.get(parts, (F.size(parts) - 2).cast("int"))).otherwise(F.get(parts, F.lit(0))).alias("_owner"), F.when(F.size(parts) >= 2, element(parts, -1)).alias("_method"))
    rows = classes.join(F.broadcast(target)).groupBy("artifact", "_owner", "_method").agg(F.max(F.when(F.trim("class_name") == F.col("_owner"), F.struct("static", "dynamic"))).alias("c"))  # one target
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.slice(F.col(c), 1, 0))), F.lit(0))
    problems = F.when(F.col("c").isNull(), F.array(F.lit("missing_class"))).otherwise(F.array_compact(F.array(
        F.when(n("c.static") == 0, "no_static"), F.when(n("c.dynamic") == 0, "no_dynamic"), F.when(F.col("_method").isNotNull() & ~F.coalesce(F.exists("c.dynamic", lambda d: F.trim(d["name"]) == F.col("_method")), F.lit(False)), "missing_method"),
    )))
    return rows.select("artifact", F.explode(problems).alias("problem"))


def gate(references: DataFrame, classes: DataFrame) -> DataFrame:
    """One row (status, failure): skip without a focus, fail by alignment, closure or both, else pass."""
    a = alignment(references).agg(F.count(F.lit(1)).alias("a"))
    c = closure(references, classes).agg(F.count(F.lit(1)).alias("c"))
    k = canonical(references).agg(F.count(F.lit(1)).alias("k"))
    failure = F.when((F.col("a") > 0) & (F.col("c") > 0), "mixed").when(F.col("a") > 0, "protocol_focus_alignment").when(F.col("c") > 0, "focus_closure")
    return a.join(c).join(k).select(F.when(failure.isNotNull(), "fail").when(F.col("k") == 0, "skip").otherwise("pass").alias("status"), failure.alias("failure"))
