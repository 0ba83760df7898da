"""Measures over nodes, runtime rows and files: ratios, completeness, coverage, and the checks they must pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import element

from ..functions import contracts as K, scalars as X
from .shared import first_by, small

# Names that orchestrate, names that help, and duties that orchestrate.
ORCHESTRATES = r"(?i)^(execute|run|handle|process|dispatch|apply|invoke|plan|schedule|orchestrate)$"
HELPS = r"(?i)^(build|parse|format|normalize|sanitize|validate|resolve|collect|load|save|get|set)$"
ORCHESTRATION_DUTY = r"(?i)(workflow|orchestrat|pipeline|router|dispatch|command|stage|coordinat)"
UNMATCHED = "RUNTIME_FRONTEND_API_ROUTE_UNMATCHED"


def has_ghost(demand: Column) -> Column:
    """F8: any demand is a ghost."""
    return F.coalesce(F.exists(demand, K.is_ghost), F.lit(False))


def execute_like(node_id: Column) -> Column:
    """execute anywhere in the id."""
    return F.coalesce(node_id.rlike("(?i)execute"), F.lit(False))


def orchestrates(name: Column, duty: Column) -> Column:
    """by name or by duty."""
    return F.coalesce(F.trim(name).rlike(ORCHESTRATES), F.lit(False)) | F.coalesce(F.trim(duty).rlike(ORCHESTRATION_DUTY), F.lit(False))


def helps(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(HELPS), F.lit(False))


def ghosts_by_language(nodes: DataFrame) -> DataFrame:
    """A2: (language, nodes, ghost_nodes, ghost_ratio)."""
    out = nodes.groupBy(X.language(F.col("source_path")).alias("language")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(has_ghost(F.col("demand"))).alias("ghost_nodes"))
    return out.withColumn("ghost_ratio", X.ratio(F.col("ghost_nodes"), F.col("nodes")))


def vertices(nodes: DataFrame) -> DataFrame:
    """A row a (category, class, source_path): distinct demands, and operations (name, responsibility) in order."""
    rows = nodes.withColumn("ref", X.node_parts(F.col("node_id"))).where("ref is not null")
    key = [F.coalesce("category", F.lit("core")).alias("category"), F.col("ref.class").alias("class"), F.coalesce("source_path", F.lit("")).alias("source_path")]
    ops = F.array_sort(F.collect_list(F.struct("ord", F.col("ref.method").alias("name"), F.coalesce("problem", F.lit("")).alias("responsibility"))))
    return rows.groupBy(*key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("demand")))).alias("demand"), F.transform(ops, lambda x: F.struct(x["name"].alias("name"), x["responsibility"].alias("responsibility"))).alias("operations"))


def completeness(verts: DataFrame, ignore: Iterable[str] = K.IGNORED_TYPES) -> DataFrame:
    """Vertices with flags: left_only (two operations or more, one orchestrates, no telling demand), mixed (three or more, helpers and orchestration)."""
    drop = [x for x in ({" ".join(str(i).strip().lower().split()) for i in ignore} | set(K.NONE_TOKENS)) if x]
    telling = F.size(F.filter("demand", lambda d: F.coalesce(~K.is_ghost(d) & K.key_fanout(d).isNotNull() & ~K.key_fanout(d).isin(sorted(drop)), F.lit(False))))
    lead = F.size(F.filter("operations", lambda o: orchestrates(o["name"], o["responsibility"])))
    aid = F.size(F.filter("operations", lambda o: helps(o["name"])))
    n = F.size("operations")
    return verts.withColumns({"operations_n": n, "left_only": (telling == 0) & (lead > 0) & (n >= 2), "mixed": (n >= 3) & (aid > 0) & (lead > 0)})


def blueprint_flags(classes: DataFrame) -> DataFrame:
    """A7 for class blueprints (class_name, static array<string>, dynamic array<struct<name,responsibility>>): one-sided, empty or mixed."""
    s, d = F.size(F.coalesce("static", F.array().cast("array<string>"))), F.size(F.coalesce("dynamic", F.slice("dynamic", 1, 0)))
    s, d = F.greatest(s, F.lit(0)), F.greatest(d, F.lit(0))
    lead = F.exists("dynamic", lambda o: orchestrates(o["name"], o["responsibility"]))
    aid = F.exists("dynamic", lambda o: helps(o["name"]))
    return classes.where(F.trim("class_name") != "").select("class_name", ((s == 0) & (d > 0)).alias("left_only"), ((s > 0) & (d == 0)).alias("right_only"), ((s == 0) & (d == 0)).alias("empty"), ((d >= 2) & F.coalesce(lead & aid, F.lit(False))).alias("mixed"))


def ghost_violations(nodes: DataFrame, policy: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct messages of nodes against the policy (language, include, top_k, min_score) of their language or default."""
    rows = nodes.select("node_id", X.language(F.col("source_path")).alias("language"), F.size(F.filter("demand", K.is_ghost)).alias("ghosts"), F.filter("ghost_reads", lambda g: g["retained"]).alias("kept"))
    p = lookup_policy(rows, policy)
    who = F.concat_ws(":", "language", F.coalesce("node_id", F.lit("unknown")))
    weak = element(F.filter("kept", lambda g: F.coalesce(g["score"], F.lit(0)) < F.col("min_score")), 1)
    barred = ~F.col("include") & (F.col("ghosts") > 0)
    messages = F.when(barred, F.array(F.concat(who, F.lit(" disallows ghost in demand")))).otherwise(F.array_compact(F.array(
        F.when(F.col("include") & (F.col("ghosts") > F.col("top_k")), F.concat(who, F.lit(" ghost demand "), F.col("ghosts").cast("string"), F.lit(" exceeds topK="), F.col("top_k").cast("string"))),
        F.when(weak.isNotNull(), F.concat(who, F.lit(" retained ghost score "), weak["score"].cast("string"), F.lit(" below minConfidence="), F.col("min_score").cast("string"))),
    )))
    return p.select(F.explode(messages).alias("message")).distinct().orderBy("message").limit(limit)


def lookup_policy(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows with their language's policy, the default's where it has none, and (true, 5, 4) without a default."""
    own = policy.select(F.col("language").alias("_l"), *(F.col(c).alias(f"_{c}") for c in ("include", "top_k", "min_score")))
    default = policy.where("language = 'default'").agg(F.first("include").alias("_di"), F.first("top_k").alias("_dk"), F.first("min_score").alias("_dm"))
    out = rows.join(small(own), F.col("language") == F.col("_l"), "left").join(F.broadcast(default))  # one row
    return out.withColumns({"include": F.coalesce("_include", "_di", F.lit(True)), "top_k": F.coalesce("_top_k", "_dk", F.lit(5)), "min_score": F.coalesce("_min_score", "_dm", F.lit(4))}).drop("_l", "_include", "_top_k", "_min_score", "_di", "_dk", "_dm")


def govern_ghosts(nodes: DataFrame, policy: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """(node_id, raw, score, retained): each node's ghosts by score; kept are the first top_k of min_score or more, where the
    language's policy allows it and the node's names and contracts tell something."""
    words = r"(?i)(workflow|pipeline|stage|step|node|service|task|worker|queue|scheduler|handler|controller|api|route|event|consumer)"
    ghost = lambda e: K.is_ghost(e)
    kinds = lambda c: F.filter(F.transform(c, K.without_name), lambda t: ~F.lower(F.trim(t)).isin(K.NONE_TOKENS) & ~K.is_generic(t, ignore))
    plain = F.filter("demand", lambda e: ~ghost(e))
    telling = F.concat_ws(" ", "node_id", "source_path").rlike(words) & ~F.coalesce("source_path", F.lit("")).rlike(r"(?i)(types?|schema|dto|entity|model)(/|$)")
    rich = F.size(kinds(F.concat(plain, F.col("answer")))) > 0
    rows = nodes.select("node_id", "source_path", X.language(F.col("source_path")).alias("language"), (telling & rich).alias("keep"), F.posexplode(F.filter("demand", ghost)).alias("pos", "raw"))
    rows = lookup_policy(rows, policy).withColumn("g", X.ghost_parts(F.col("raw")))
    rows = rows.withColumn("score", X.ghost_score(F.col("g"), F.col("node_id"), F.col("source_path"), K.is_generic(F.col("g.type"), ignore)))
    ok = F.col("keep") & F.col("include") & (F.col("score") >= F.col("min_score"))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc(ok.cast("int")), F.desc("score"), "pos"))
    return rows.withColumn("rank", rank).select("node_id", "raw", "score", (ok & (F.col("rank") <= F.col("top_k"))).alias("retained"))


def metric_vector(nodes: DataFrame, runtime_nodes: DataFrame, runtime_edges: DataFrame, diagnostics: DataFrame, policy: DataFrame, max_render: int | None = None, classes: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """A3: one row of all measures; each input is read once.

    classes are class blueprints and references focus references, as in `focus`; without references there is no measure of
    alignment, and without a leading one none of closure (null).
    """
    from . import focus

    spark = nodes.sparkSession
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(execute_like(F.col("node_id"))).alias("execute_like_count"), F.count_if(has_ghost(F.col("demand"))).alias("ghost_nodes"))
    v = completeness(vertices(nodes)).agg(F.count(F.lit(1)).alias("vertices"), F.count_if("left_only").alias("left_only_vertices"), F.count_if("mixed").alias("scale_mixing_vertices"))
    rn = runtime_nodes.agg(F.count(F.lit(1)).alias("runtime_nodes"))
    re = runtime_edges.agg(F.count(F.lit(1)).alias("runtime_edges"))
    d = diagnostics.agg(F.count(F.lit(1)).alias("diagnostics_total"), F.count_if(F.coalesce(F.trim("code"), F.lit("")) == "").alias("diagnostics_no_code"), F.count_if(F.coalesce(F.upper(F.trim("code")) == UNMATCHED, F.lit(False))).alias("runtime_unmatched_route_count"))
    g = ghost_violations(nodes, policy).agg(F.count(F.lit(1)).alias("ghost_policy_violations"))
    plans = classes if classes is not None else spark.createDataFrame([], CLASSES)
    flags = ("left_only", "right_only", "empty", "mixed")
    named = blueprint_flags(plans).groupBy(F.trim("class_name").alias("c")).agg(*(F.max(f).alias(f) for f in flags))
    b = named.agg(*(F.count_if(f).alias(f"_{f}") for f in flags))
    named_refs = references if references is not None else spark.createDataFrame([], REFERENCES)
    al = focus.alignment(named_refs).agg(F.count(F.lit(1)).alias("protocol_focus_alignment_violations"))
    cl = focus.closure(named_refs, plans).agg(F.count(F.lit(1)).alias("focus_closure_violations"))
    lead = focus.canonical(named_refs).agg(F.count(F.lit(1)).alias("_lead"))
    out = a
    for part in (v, rn, re, d, g, b, al, cl, lead):  # one-row frames
        out = out.join(part)
    shown = F.col("runtime_edges") if not max_render else F.least("runtime_edges", F.lit(max_render))
    out = out.withColumns({"left_only_vertices": F.col("left_only_vertices") + F.col("_left_only"), "right_only_vertices": F.col("_right_only"), "empty_vertices": F.col("_empty"), "scale_mixing_vertices": F.col("scale_mixing_vertices") + F.col("_mixed")})
    broken = F.col("left_only_vertices") + F.col("right_only_vertices") + F.col("empty_vertices") + F.col("scale_mixing_vertices")
    aligned = F.col("protocol_focus_alignment_violations") == 0 if references is not None else F.lit(None).cast("boolean")
    out = out.withColumns({
        "triad_completeness_violations": broken, "triad_completeness": broken == 0, "ghost_policy_compliance": F.col("ghost_policy_violations") == 0,
        "protocol_focus_alignment": aligned, "triad_focus_closure": F.when(F.col("_lead") > 0, F.col("focus_closure_violations") == 0),
    }).drop("_lead", *(f"_{f}" for f in flags))
    return out.withColumns({"execute_like_ratio": X.ratio(F.col("execute_like_count"), F.col("nodes")), "ghost_ratio": X.ratio(F.col("ghost_nodes"), F.col("nodes")), "rendered_runtime_edges": shown.cast("long"), "rendered_edges_consistency": shown == F.col("runtime_edges")})


#: Columns of class blueprints and of focus references.
CLASSES = "artifact string, class_name string, static array<string>, dynamic array<struct<name:string,responsibility:string>>"
REFERENCES = "source string, focus string, operation string"


def as_metrics(vector: DataFrame) -> DataFrame:
    """METRIC rows (key, num, flag) of a one-row frame."""
    rows = [F.struct(F.lit(c).alias("key"), (F.lit(None).cast("double") if t == "boolean" else F.col(c).cast("double")).alias("num"), (F.col(c) if t == "boolean" else F.lit(None).cast("boolean")).alias("flag")) for c, t in vector.dtypes]
    return vector.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


#: Thresholds of the checks.
THRESHOLDS = [
    ("diagnostics_no_code", "lte", 0.0, None), ("execute_like_ratio", "lt", 0.1, None), ("ghost_ratio", "lt", 0.4, None), ("rendered_edges_consistency", "eq", None, True), ("ghost_policy_compliance", "eq", None, True), ("left_only_vertices", "lte", 0.0, None), ("right_only_vertices", "lte", 0.0, None), ("empty_vertices", "lte", 0.0, None),
    ("scale_mixing_vertices", "lte", 0.0, None), ("triad_completeness", "eq", None, True), ("protocol_focus_alignment", "eq", None, True), ("triad_focus_closure", "eq", None, True),
]
#: Checks that are skipped where there is nothing to check.
OPTIONAL = ["protocol_focus_alignment", "triad_focus_closure"]


def verify(vector: DataFrame, baseline_unmatched: int | None = None) -> DataFrame:
    """(key, status) of the 13 checks over the measures; unmatched routes pass up to ceil(1.1 x baseline), and skip without
    one; focus checks skip without artifacts or a leading reference."""
    from .governance import evaluate

    spark = vector.sparkSession
    rules = spark.createDataFrame([(k, op, num, flag, True) for k, op, num, flag in THRESHOLDS], "key string, op string, num double, flag boolean, must_pass boolean")
    checks = evaluate(rules, as_metrics(vector))
    checks = checks.withColumn("status", F.when(F.col("key").isin(OPTIONAL) & (F.col("status") == "error"), "skip").otherwise(F.col("status")))
    if baseline_unmatched is None:
        return checks.unionByName(spark.createDataFrame([("runtime_unmatched_route_count", "skip", True)], "key string, status string, must_pass boolean"))
    limit = float(-(-baseline_unmatched * 11 // 10))
    extra = spark.createDataFrame([("runtime_unmatched_route_count", "lte", limit, None, True)], "key string, op string, num double, flag boolean, must_pass boolean")
    return checks.unionByName(evaluate(extra, as_metrics(vector)))


def covered(raw: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file) of the universe that raw paths name, by lower case, and (source_path) of up to 20 that name none."""
    key = lambda c: F.lower(F.regexp_replace(F.regexp_replace(X.slashes(F.trim(F.col(c))), r"^\.?/+", ""), "/+", "/"))
    u = files.select("file", key("file").alias("_k"))
    r = raw.select(F.col("source_path"), key("source_path").alias("_k")).where("_k <> ''").distinct()
    hit = u.join(r.select("_k").distinct(), "_k", "left_semi").select("file")
    lost = r.join(u, "_k", "left_anti").select("source_path").distinct().orderBy("source_path").limit(20)
    return hit, lost


def buckets(files: DataFrame, key: Column) -> DataFrame:
    """A4: (bucket, total, declared, runtime, combined, ratios, covered and uncovered samples) of (file, t, r) rows by a key."""
    rows = files.withColumn("bucket", key).withColumn("c", F.col("t") | F.col("r"))
    sample = lambda flag: F.slice(F.sort_array(F.collect_list(F.when(flag, F.col("file")))), 1, 20)
    out = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.count_if("t").alias("declared"), F.count_if("r").alias("runtime"), F.count_if("c").alias("combined"))
    # the first 20 of a bucket are ranked, not gathered with the rest
    from .shared import top_by

    first = top_by(rows, ["bucket", "c"], 20, F.col("file")).groupBy("bucket").agg(sample(F.col("c")).alias("covered_samples"), sample(~F.col("c")).alias("uncovered_samples"))
    ratios = {f"{c}_coverage": X.ratio(F.col(c), F.col("total")) for c in ("declared", "runtime", "combined")}
    return out.join(first, "bucket").withColumns(ratios)


def coverage(files: DataFrame, declared: DataFrame, runtime: DataFrame, prefixes: DataFrame) -> DataFrame:
    """C4, A5: buckets of all files, of each configured category (also empty ones) and of each root, which may overlap."""
    from .linkage import categories, clean_path

    hit = lambda raw: covered(raw, files)[0].distinct().withColumn("_x", F.lit(True))
    flagged = files.join(hit(declared).withColumnRenamed("_x", "t"), "file", "left").join(hit(runtime).withColumnRenamed("_x", "r"), "file", "left").na.fill(False, ["t", "r"])
    known = categories(flagged.withColumn("source_path", F.col("file")), prefixes)
    by_root = known.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(clean_path(F.col("file")), "/"))), lambda n: F.array_join(F.slice(F.split(clean_path(F.col("file")), "/"), 1, n), "/"))))
    roots = small(prefixes.select(clean_path(F.col("prefix")).alias("head")).where("head <> ''").distinct())
    parts = [buckets(flagged, F.lit("summary")).withColumn("scope", F.lit("summary")), buckets(known, F.col("resolved")).withColumn("scope", F.lit("category")), buckets(by_root.join(roots, "head"), F.col("head")).withColumn("scope", F.lit("root"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    every = prefixes.select(F.lit("category").alias("scope"), F.col("category").alias("bucket")).unionByName(roots.select(F.lit("root").alias("scope"), F.col("head").alias("bucket"))).distinct()
    wanted = every.unionByName(files.sparkSession.createDataFrame([("summary", "summary")], "scope string, bucket string"))
    return wanted.join(out, ["scope", "bucket"], "left").na.fill(0).select("scope", "bucket", "total", "declared", "runtime", "combined", "declared_coverage", "runtime_coverage", "combined_coverage")


def stage_of(draft: Column, approved: Column, micro: Column, meso: Column, macro: Column, focus_failed: Column) -> Column:
    """How far a workspace is, by what is there; a failed focus gate holds it back unless a protocol is approved."""
    gated = focus_failed & ~approved
    return (
        F.when(draft & gated, "draft_gated").when(draft, "draft_review").when(approved, "implementation").when(micro & gated, "micro_gated")
        .when(micro, "micro").when(meso, "meso").when(macro, "macro").otherwise("planning")
    )


def modules(nodes: DataFrame) -> DataFrame:
    """(module, members, source_path) by the first part of ids; the first path in order."""
    rows = nodes.withColumn("module", F.get(F.filter(F.split("node_id", r"\."), lambda x: x != ""), F.lit(0))).where("module is not null")
    first = first_by(rows, ["module"], F.col("ord")).select("module", "source_path")
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node_id")).alias("members")).join(first, "module")
