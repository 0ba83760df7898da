"""Merging rows that are the same thing: scalars, maps and evidence of nodes and edges, link upserts, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import confidence, runtime_id, slashes
from .shared import first_by


def last_known(value: str, ord_: str = "ord") -> Column:
    """The last non-null value in order."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(ord_)))


def merged_maps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metadata): of each map key the last value. Counted a (key, map key) at a time, so no group is gathered whole."""
    parts = rows.select(*keys, "ord", F.explode(F.map_entries("metadata")).alias("e"))
    last = parts.groupBy(*keys, F.col("e.key").alias("_k")).agg(F.max_by("e.value", "ord").alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias("metadata"))


def merged_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, evidence): distinct by kind, place and text, in the order they first came, each with its first confidence."""
    fields = ["source_path", "line", "column", "kind", "text"]
    parts = rows.select(*keys, "ord", F.posexplode("evidence").alias("pos", "e")).select(*keys, "ord", "pos", *(F.col(f"e.{f}").alias(f"_{f}") for f in fields), F.col("e.confidence").alias("_confidence"))
    first = parts.groupBy(*keys, *(f"_{f}" for f in fields)).agg(F.min(F.struct("ord", "pos", "_confidence")).alias("_at"))
    item = F.struct(F.col("_at.ord").alias("o"), F.col("_at.pos").alias("p"), F.struct(*(F.col(f"_{f}").alias(f) for f in fields), F.col("_at._confidence").alias("confidence")).alias("e"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["e"]).alias("evidence"))


def _joined(rows: DataFrame, scalars: DataFrame, keys: list[str]) -> DataFrame:
    """Scalars with the merged maps and evidence of their keys; all three are dealt by the same keys."""
    out = scalars
    for part in (merged_maps(rows, keys), merged_evidence(rows, keys)):
        out = out.join(part, keys, "left")
    return out


def with_evidence(df: DataFrame, default_confidence: Column | None = None, path: Column | None = None) -> DataFrame:
    """Rows without evidence get an inferred one."""
    inferred = F.array(F.struct(
        (path if path is not None else F.lit(None).cast("string")).alias("source_path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit("inferred").alias("kind"),
        F.lit("Inferred from runtime extraction pattern").alias("text"), (default_confidence if default_confidence is not None else F.lit(0.5)).cast("double").alias("confidence"),
    ))
    return df.withColumn("evidence", F.when(F.size(F.coalesce("evidence", F.array())) > 0, F.col("evidence")).otherwise(inferred))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """RT_NODE rows by id: last known scalars, maps and evidence merged; `ord` is the first."""
    rows = with_evidence(nodes, path=F.col("source_path"))
    scalars = rows.groupBy("id").agg(*(last_known(c).alias(c) for c in ("type", "label", "source_path", "category", "framework")), F.min("ord").alias("ord"))
    return _joined(rows, scalars, ["id"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """RT_EDGE rows by (src, type, dst): as nodes, with the greatest confidence, and an id where none was given."""
    rows, keys = with_evidence(edges, F.coalesce("confidence", F.lit(0.5))), ["src", "type", "dst"]
    scalars = rows.groupBy(*keys).agg(last_known("id").alias("id"), last_known("label").alias("label"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.min("ord").alias("ord"))
    return _joined(rows, scalars, keys).withColumn("id", F.coalesce("id", runtime_id(F.concat_ws(".", F.lit("RuntimeEdge"), "src", "type", "dst"))))


def dedupe_nodes(nodes: DataFrame, by_place: bool = True) -> DataFrame:
    """The first row of each (id, path, category), or of each id."""
    keys = [F.col("node_id")] + ([F.lower(slashes(F.col("source_path"))), F.lower(F.coalesce("category", F.lit("")))] if by_place else [])
    return first_by(nodes, keys, F.col("ord"))


def dedupe_diagnostics(diags: DataFrame) -> DataFrame:
    """U8: the first row of each (level, code, component, message, source_path)."""
    return first_by(diags, ["level", "code", "component", "message", "source_path"], F.col("ord"))


def merge_entries(groups: Column, fallback: str) -> Column:
    """Distinct entries of several lists in order, without the fallback unless nothing else is there."""
    every = F.filter(F.transform(F.flatten(groups), F.trim), lambda x: (x != "") & (F.lower(x) != fallback.lower()))
    return F.when(F.size(every) > 0, F.array_distinct(every)).otherwise(F.array(F.lit(fallback)))


def link_id(*parts: str) -> Column:
    return F.concat_ws("::", *parts)


def both_ways(links: DataFrame) -> DataFrame:
    """Links and their reverses by id: greatest confidence, reasons in order, first known path. links carry `ord`."""
    back = links.select(F.col("to_view").alias("from_view"), F.col("to_id").alias("from_id"), F.col("from_view").alias("to_view"), F.col("from_id").alias("to_id"), "relation", "confidence", "reason", "source_path", "ord")
    loops = (F.col("from_view") == F.col("to_view")) & (F.col("from_id") == F.col("to_id"))
    every = links.select(back.columns).unionByName(back.where(~loops)).withColumn("confidence", confidence(F.col("confidence"))).withColumn("id", link_id("from_view", "from_id", "relation", "to_view", "to_id"))
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]))
    return every.groupBy("id", "from_view", "from_id", "to_view", "to_id", "relation").agg(
        F.max("confidence").alias("confidence"), F.array_join(reasons, "|").alias("reason"), F.min_by("source_path", F.when(F.col("source_path").isNotNull(), F.col("ord"))).alias("source_path")
    )


def mirrored(links: DataFrame) -> DataFrame:
    """J9 for links that are told once and lead from view to view: each and its reverse, with ids; nothing is left to merge."""
    ends = lambda a, b: F.struct(F.col(f"{a}_view").alias("from_view"), F.col(f"{a}_id").alias("from_id"), F.col(f"{b}_view").alias("to_view"), F.col(f"{b}_id").alias("to_id"))
    every = links.select(F.explode(F.array(ends("from", "to"), ends("to", "from"))).alias("_e"), "relation", "confidence", "reason", "source_path").select("_e.*", "relation", "confidence", "reason", "source_path")
    return every.withColumn("id", link_id("from_view", "from_id", "relation", "to_view", "to_id"))


def apply_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes after a change set (op, node_id, <node columns>): modify replaces, create_child adds, reuse leaves.

    A created node keeps the values it names; a modified one keeps those it does not. `status` says what happened.
    """
    cols = [c for c in nodes.columns if c != "node_id"]
    delta = changes.select("node_id", "op", *(F.col(c).alias(f"_{c}") for c in cols if c in changes.columns))
    both = nodes.join(delta, "node_id", "full")
    taken = F.col("op").isin("modify", "create_child")
    values = [F.coalesce(F.when(taken, F.col(f"_{c}")), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in cols]
    status = F.when(F.col("op") == "create_child", "created").when(F.col("op") == "modify", "modified").when(F.col("op") == "reuse", "reused").otherwise("unchanged")
    exists = both.where(F.col("op").isNull() | taken | (F.col("op") == "reuse"))
    return exists.select("node_id", *values, status.alias("status"))


def change_problems(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ord, rule) a row for each rule an action breaks.

    changes: (ord, op, node_id, parent_id, problem, confidence). Rules: targets exist; created ids don't; a target is used
    once; a modification keeps its problem text.
    """
    known = nodes.select(F.col("node_id").alias("_k"), F.col("problem").alias("_problem"))
    tidy = lambda c: F.regexp_replace(F.trim(F.col(c)), r"\s+", " ")
    target = changes.join(known, changes.node_id == known._k, "left")
    parent = changes.join(known, changes.parent_id == known._k, "left_anti").where("op = 'create_child'")
    repeat = changes.withColumn("_r", F.row_number().over(Window.partitionBy("node_id").orderBy("ord"))).where("_r > 1")
    rules = [
        target.where("op in ('reuse', 'modify') and _k is null").select("ord", F.lit("missing_target").alias("rule")),
        parent.select("ord", F.lit("missing_parent").alias("rule")),
        target.where("op = 'create_child' and _k is not null").select("ord", F.lit("id_exists").alias("rule")),
        target.where((F.col("op") == "modify") & F.col("_k").isNotNull() & (tidy("problem") != tidy("_problem"))).select("ord", F.lit("problem_changed").alias("rule")),
        repeat.select("ord", F.lit("target_repeated").alias("rule")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def protocol_problems(changes: DataFrame, nodes: DataFrame, splits: DataFrame | None = None, least: float = 0.0, need_confidence: bool = False) -> DataFrame:
    """C14: J19, and (ord, rule) for confidences that lack or fall short, and for split stages that lack or name another focus.

    splits: (stage, focus, operation) of macro, meso and micro; all three or none, and all alike. Their rows have ord -1.
    """
    out = change_problems(changes, nodes)
    if "confidence" in changes.columns:
        low = changes.where(F.col("confidence") < least).select("ord", F.lit("low_confidence").alias("rule"))
        out = out.unionByName(low)
        if need_confidence:
            out = out.unionByName(changes.where(F.col("confidence").isNull()).select("ord", F.lit("no_confidence").alias("rule")))
    if splits is not None:
        kinds = splits.agg(F.countDistinct("stage").alias("n"), F.countDistinct(F.trim("focus"), F.lower(F.trim("operation"))).alias("k"))
        rule = F.when((F.col("n") > 0) & (F.col("n") < 3), "missing_stage").when(F.col("k") > 1, "focus_drift")
        out = out.unionByName(kinds.select(F.lit(-1).cast("long").alias("ord"), rule.alias("rule")).where("rule is not null"))
    return out


#: Path parts that name no namespace.
GENERIC_SEGMENTS = ["src", "app", "apps", "packages", "package", "lib", "core", "main", "index"]


def _namespace(text: Column) -> Column:
    out = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.[^.]+$", "")
    for pattern, to in ((r"[^A-Za-z0-9_]+", "."), (r"^\.+|\.+$", ""), (r"\.{2,}", ".")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(out == "", F.lit("source")).otherwise(F.lower(out))


def rename_collisions(nodes: DataFrame) -> DataFrame:
    """(node_id, source_path, category, new_id): ids that several paths share get category and namespace in front.

    The namespace is the shortest tail of path parts that tells an id's paths apart. A row is exploded to its tails, counted
    per (id, width), and the least width without a repeat is taken: joins and counts, no group in one place.
    """
    base = nodes.select("node_id", "source_path", "category").distinct()
    low = F.lower(slashes(F.coalesce("source_path", F.lit(""))))
    shared = base.groupBy("node_id").agg(F.countDistinct(low).alias("paths")).where("paths > 1").select("node_id")
    parts = F.filter(F.transform(F.filter(F.split(F.regexp_replace(slashes(F.coalesce("source_path", F.lit(""))), r"\.[^./]+$", ""), "/"), lambda x: x != ""), _namespace), lambda x: ~x.isin(GENERIC_SEGMENTS))
    rows = base.join(shared, "node_id", "left_semi").withColumn("parts", parts).withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("source_path", "category")))
    most = rows.groupBy("node_id").agg(F.greatest(F.max(F.size("parts")), F.lit(1)).alias("most"))
    tails = rows.join(most, "node_id").withColumn("width", F.explode(F.sequence(F.lit(1), F.col("most"))))
    tail = F.when(F.size("parts") == 0, F.lit("source")).otherwise(F.array_join(F.slice(F.col("parts"), F.greatest(F.size("parts") - F.col("width") + 1, F.lit(1)), F.col("width")), "."))
    tails = tails.withColumn("ns", tail)
    width = tails.groupBy("node_id", "width").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ns").alias("d")).where("n = d").groupBy("node_id").agg(F.min("width").alias("least"))
    chosen = tails.join(width, "node_id", "left").where((F.col("width") == F.col("least")) | (F.col("least").isNull() & (F.col("width") == F.col("most"))))
    ns = F.when(F.col("least").isNull(), F.concat_ws(".", "ns", F.col("place").cast("string"))).otherwise(F.col("ns"))
    new = chosen.select("node_id", "source_path", "category", F.concat_ws(".", _namespace(F.col("category")), ns, "node_id").alias("new_id"))
    rest = base.join(shared, "node_id", "left_anti").withColumn("new_id", F.col("node_id"))
    return rest.unionByName(new)
