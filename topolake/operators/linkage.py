"""Cross-view links: category by longest prefix, scan scopes, capability-leaf and runtime-capability links, route matching."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as X
from ..functions.scalars import element
from .shared import first_by, many, small, top_by, written as cut
from .topk_join import best_pairs


def clean_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(X.slashes(F.coalesce(path, F.lit(""))), r"^\.?/", ""), "/+$", ""))


def categories(paths: DataFrame, prefixes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """each row of `paths` with the category of the longest prefix of its source_path, or unknown.

    prefixes: (category, prefix, ord). A path is exploded to its own leading parts, which meet the prefixes by equality: as
    many rows as parts, instead of every path with every prefix.
    """
    keys = keys or ["source_path"]
    p = prefixes.select("category", F.lower(F.regexp_replace(X.slashes(F.col("prefix")), "^/+|/+$", "")).alias("prefix"), F.col("ord").alias("p_ord")).where("prefix <> ''")
    norm = F.regexp_replace(F.lower(X.slashes(F.coalesce("source_path", F.lit("")))), "^/+", "")
    parts = F.split(norm, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = paths.select(*keys, F.explode(heads).alias("prefix")).distinct().join(small(p), "prefix")
    best = first_by(hit, keys, F.length("prefix").desc(), F.col("p_ord")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("category").alias("resolved"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return paths.join(best, on, "left").withColumn("resolved", F.coalesce("resolved", F.lit("unknown"))).drop(*(f"_{k}" for k in keys))


def canonical(nodes: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their category by path, and DIAG rows where it was another (fixed) or cannot be told (unknown)."""
    known = categories(nodes, prefixes)
    declared = F.coalesce(F.when(F.trim("category") != "", F.trim("category")), F.lit("unknown"))
    has_path = F.coalesce(F.col("source_path"), F.lit("")) != ""
    fixed = has_path & (F.col("resolved") != "unknown") & (declared != "unknown") & (F.lower(declared) != F.lower("resolved"))
    lost = has_path & (F.col("resolved") == "unknown") & (declared != "unknown")
    flagged = known.withColumn("_code", F.when(fixed, "CATEGORY_MISMATCH_AUTO_FIXED").when(lost, "CATEGORY_UNRESOLVED"))
    diags = flagged.where("_code is not null").select(F.lit("warning").alias("level"), F.col("_code").alias("code"), F.lit("canonical").alias("component"), F.lit("category does not follow from the source path").alias("message"), "source_path", "node_id")
    return flagged.withColumn("category", F.when(has_path, F.col("resolved")).otherwise(declared)).drop("resolved", "_code"), diags


def path_pattern(path: Column, pattern: str) -> Column:
    """a configured pattern: a regular expression if it has such signs, else a whole run of path parts."""
    p = pattern.strip().replace("\\\\", "/").lower()
    if any(c in p for c in "\\^$|()[]{}+?"):
        return path.rlike(f"(?i){p}")
    return (path == p) | path.startswith(p + "/") | path.endswith("/" + p) | path.contains(f"/{p}/") if p else F.lit(False)


#: Path parts and names that are never part of a scan.
HARD_SEGMENTS = [
    "db", "database", "databases", "prisma", "migration", "migrations", "test", "tests", "__tests__", "spec", "specs", ".next", "venv", ".venv",
    "__pycache__", ".pytest_cache", "script", "scripts", "env", "vendor", "logs", "uploads", "fastgpt_data", ".run_state", "tmp", "dist", "build", "target",
]
HARD_NAMES = r"^(\.env(\..+)?|diagnostic\.data)$"
TEST_NAMES = r"^(test_.*\.py|.*_test\.py|.*\.(spec|test)\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)|.*_test\.go)$"


def excluded(path: Column, patterns: list[str] = (), test_files: bool = True) -> Column:
    """whether a source path is out of scope."""
    norm = clean_path(path)
    parts = F.filter(F.split(norm, "/"), lambda x: x != "")
    base = F.coalesce(element(parts, -1), F.lit(""))
    out = F.exists(parts, lambda x: x.isin(HARD_SEGMENTS)) | base.rlike(HARD_NAMES)
    if test_files:
        out = out | base.rlike(TEST_NAMES)
    raw = F.lower(X.slashes(F.coalesce(path, F.lit(""))))
    for p in patterns:
        out = out | path_pattern(raw, p)
    return out


def in_scan(path: Column, active: list[str], patterns: list[str] = ()) -> Column:
    """not excluded, and below an active prefix if there are any."""
    norm = clean_path(path)
    below = F.lit(not active)
    for a in active:
        below = below | (norm == a) | norm.startswith(a + "/")
    return ~excluded(path, patterns) & below


def glob(pattern: str) -> str:
    """A file glob as a regular expression for a base name."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in ".+^${}()|[]\\" else c for c in pattern.strip()) + "$"


def scan_scope(paths: DataFrame, scopes: list[dict]) -> DataFrame:
    """F2: each path with the name and kind of its best scan scope, by score; the first of equals.

    scopes: dicts of name, kind, priority, prefixes, segments, globs, includes, excludes. A prefix scores 1000 and its
    length, segments 500 and 10 a hit, globs 300, includes 200; an exclusion scores nothing; priority adds.
    """
    norm = clean_path(F.col("source_path"))
    parts = F.filter(F.split(norm, "/"), lambda x: x != "")
    base = F.coalesce(element(parts, -1), norm)
    scored = []
    for i, s in enumerate(scopes):
        scores = [F.when((norm == p) | norm.startswith(p + "/"), F.lit(1000 + len(p))) for p in (x.strip("/").lower() for x in s.get("prefixes", [])) if p]
        for kind, start, hits in (("segments", 500, lambda v: F.array_contains(parts, v)), ("globs", 300, lambda v: base.rlike(glob(v))), ("includes", 200, lambda v: path_pattern(norm, v))):
            if s.get(kind):
                n = X.total([F.when(hits(v), 1).otherwise(0) for v in s[kind]])
                scores.append(F.when(n > 0, start + 10 * n))
        best = F.greatest(*(F.coalesce(c, F.lit(0)) for c in scores), F.lit(0)) if scores else F.lit(0)
        for e in s.get("excludes", []):
            best = F.when(path_pattern(norm, e), 0).otherwise(best)
        best = F.when((best > 0) & (norm != ""), best + s.get("priority", 0)).otherwise(0)
        scored.append(F.struct(best.alias("score"), F.lit(-i).alias("at"), F.lit(s["name"]).alias("scope"), F.lit(s["kind"]).alias("kind")))
    top = F.array_max(F.array(*scored))
    return paths.withColumn("_t", top).withColumn("scope", F.when(F.col("_t.score") > 0, F.col("_t.scope"))).withColumn("kind", F.when(F.col("_t.score") > 0, F.col("_t.kind"))).withColumn("score", F.col("_t.score")).drop("_t")


def owner(node_id: Column) -> Column:
    """All but the last dotted part; empty for one part."""
    parts = F.filter(F.split(F.coalesce(node_id, F.lit("")), r"\."), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).otherwise(F.lit(""))


def method(node_id: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(node_id, F.lit("")), r"\."), lambda x: x != "")
    return F.coalesce(element(parts, -1), F.lit(""))


def capability_leaves(capabilities: DataFrame, leaves: DataFrame, most: int | None = 12) -> DataFrame:
    """(capability_id, leaf_id, relation, confidence, pos): equal ids, then folded leaves, then owner and path; the first counts.

    capabilities: (node_id, source_path, folded_leaves); leaves: (node_id, source_path, ord). Of the owner's leaves the
    first `most` in order are looked at (all for None), before those already linked drop.
    """
    c = capabilities.select(F.col("node_id").alias("capability_id"), F.coalesce("source_path", F.lit("")).alias("path"), "folded_leaves").distinct()
    f = leaves.select(F.col("node_id").alias("leaf_id"), F.coalesce("source_path", F.lit("")).alias("path"), "ord")
    ids = f.select("leaf_id").distinct()
    exact = c.join(many(ids), c.capability_id == ids.leaf_id).select("capability_id", "leaf_id", F.lit("exact").alias("relation"), F.lit(0.99).alias("confidence"), F.lit(0).cast("long").alias("pos"))
    folded = c.select("capability_id", F.posexplode("folded_leaves").alias("i", "leaf_id")).join(many(ids), "leaf_id").select("capability_id", "leaf_id", F.lit("folded_leaf").alias("relation"), F.lit(0.96).alias("confidence"), (F.lit(1_000) + F.col("i")).cast("long").alias("pos"))
    co, fo = c.withColumn("o", owner(F.col("capability_id"))).where("o <> ''"), f.withColumn("o", owner(F.col("leaf_id"))).where("o <> ''")
    # an owner's first leaves are chosen once for all of its capabilities
    firsts = top_by(fo, ["o", "path"], most or 1 << 30, F.col("ord"))
    owned = co.join(many(firsts), ["o", "path"]).select("capability_id", "leaf_id", F.lit("owner_match").alias("relation"), F.lit(0.78).alias("confidence"), (F.lit(1_000_000) + F.col("rank")).cast("long").alias("pos"))
    # the first of each pair by an aggregation, which ids that many rows repeat don't gather in one task
    first = exact.unionByName(folded).unionByName(owned).groupBy("capability_id", "leaf_id").agg(F.min(F.struct("pos", "relation", "confidence")).alias("x"))
    return first.select("capability_id", "leaf_id", "x.relation", "x.confidence", "x.pos")


class OwnerLinks(NamedTuple):
    """J6 links without a row a pair: those of one owner and path link all of its capabilities to all of its members."""

    capabilities: DataFrame  # (capability_id, home)
    members: DataFrame  # (leaf_id, home): leaves that are linked through their one home only, and to themselves there
    rest: DataFrame  # (capability_id, leaf_id, relation, confidence, pos) of all other leaves


def owner_links(capabilities: DataFrame, leaves: DataFrame) -> OwnerLinks:
    """The links of `capability_leaves` for all leaves of an owner and path; pairs, which grow with the square of these, are not made.

    A leaf is no member, and its links are rows, if it has several paths or no owner, if a capability folds it, or if a
    capability of its id has other paths only.
    """
    def homes(df: DataFrame, name: str) -> DataFrame:
        o = owner(F.col("node_id"))
        return df.select(F.col("node_id").alias("id"), F.when(o != "", F.xxhash64(o, F.coalesce("source_path", F.lit("")))).alias("home"), *(F.lit(n == name).alias(n) for n in ("leaf", "capability", "folded")))

    folded = capabilities.select(F.explode("folded_leaves").alias("node_id"), F.lit(None).cast("string").alias("source_path"))
    every = homes(leaves, "leaf").unionByName(homes(capabilities, "capability")).unionByName(homes(folded, "folded"))
    told = every.groupBy("id", "home").agg(*(F.max(n).alias(n) for n in ("leaf", "capability", "folded")))
    both = F.col("leaf") & F.col("capability")
    known = cut(told.groupBy("id").agg(F.max(F.when(F.col("leaf"), F.col("home"))).alias("home"), F.count_if("leaf").alias("homes"), F.max("capability").alias("capability"), F.max("folded").alias("folded"), F.count_if(both).alias("both")))
    member = F.col("home").isNotNull() & (F.col("homes") == 1) & ~F.col("folded") & (~F.col("capability") | (F.col("both") == 1))
    others = known.where((F.col("homes") > 0) & ~member).select(F.col("id").alias("node_id"))
    asked = capabilities if not others.isEmpty() else capabilities.limit(0)
    rest = capability_leaves(asked, leaves.join(many(others), "node_id", "left_semi"), None)
    return OwnerLinks(told.where(F.col("capability") & F.col("home").isNotNull()).select(F.col("id").alias("capability_id"), "home"), known.where(member).select(F.col("id").alias("leaf_id"), "home"), rest)


def containing(ids: DataFrame, needles: DataFrame) -> DataFrame:
    """(capability_id, needle) of ids (capability_id, low) whose low contains the needle (needle), without a cross product.

    A needle's head is its first three signs, or all of fewer. Where an id has a head, the runs of the lengths of that head's
    needles begin; runs meet needles by equality, so what meets is what is contained.
    """
    low, needle = F.col("low"), F.col("needle")
    asked = needles.where(F.length(needle) > 0).select("needle").distinct()
    heads = asked.groupBy(F.substring(needle, 1, 3).alias("head")).agg(F.collect_set(F.length(needle)).alias("lengths"))  # no more than the longest is long
    at = ids.select("capability_id", "low", F.explode(F.sequence(F.lit(1), F.length(low))).alias("at")).where(F.length(low) > 0)
    held = at.select("capability_id", "low", "at", F.explode(F.array(*(F.substr(low, F.col("at"), F.lit(n)) for n in (1, 2, 3)))).alias("head")).join(small(heads), "head")
    runs = held.select("capability_id", "low", "at", F.explode("lengths").alias("n")).select("capability_id", F.substr(low, F.col("at"), F.col("n")).alias("needle"))
    return cut(runs.join(many(asked), "needle", "left_semi").distinct().select("capability_id", "needle"))


def _tail(path: Column) -> Column:
    """The last two parts of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def _linked_sides(runtime: DataFrame, capabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What J7 compares: (runtime_id, paths, r_cat, handler, r_words, svc, svc_method) and (capability_id, path, c_cat, c_words)."""
    category = F.lower(F.coalesce(F.when(F.trim("category") != "", F.trim("category")), F.lit("unknown")))
    paths = F.coalesce("source_paths", F.array().cast("array<string>"))
    r = runtime.select(F.col("id").alias("runtime_id"), paths.alias("paths"), category.alias("r_cat"), F.trim(F.coalesce("handler", F.lit(""))).alias("handler"), X.tokens(F.concat_ws(" ", "id", "label", F.array_join(paths, " "))).alias("r_words"))
    parts = F.filter(F.split("runtime_id", r"\."), lambda x: x != "")
    service = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "Service")
    r = r.withColumn("svc", F.when(service, F.lower(F.get(parts, F.lit(1))))).withColumn("svc_method", F.when(service, F.lower(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "."))))
    c = capabilities.select(F.col("node_id").alias("capability_id"), F.coalesce("source_path", F.lit("")).alias("path"), category.alias("c_cat"), X.tokens(F.concat_ws(" ", "node_id", F.coalesce("source_path", F.lit("")))).alias("c_words"))
    return r, c


def link_candidates(r: DataFrame, c: DataFrame, least: int = 35, most: int = 6) -> DataFrame:
    """(runtime_id, capability_id): all pairs that J7 may rank, by a top-k join on what each pair shares.

    Features are words, whole paths and their last parts (one of these counts), categories, and the substring signals: a
    handler, and a service with its method, which meet ids by the runs that begin with their first three signs.
    """
    name = lambda p: element(F.split(p, "/"), -1)
    single = lambda p: F.size(F.split(p, "/")) == 1
    feature = lambda mark, value, kind, weight: F.struct(F.concat(F.lit(f"{mark}:"), value).alias("feature"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    # a path of one part also meets others by its name alone: m and l are the longer and the shorter side
    of_path = lambda p, mine, others: F.array_compact(F.array(feature("e", p, 1, 65), F.when(~single(p), feature("p", _tail(p), 1, 32)), feature(mine, name(p), 1, 32), F.when(single(p), feature(others, name(p), 1, 32))))
    words = lambda w: F.transform(w, lambda x: feature("w", x, 0, 6))
    # the base of a score is that of pairs of different categories
    needle = lambda n: F.concat(F.col("svc"), F.lit(" "), F.col("svc_method")) if n == "s" else F.col("handler")
    r_all = F.concat(
        words(F.col("r_words")), F.flatten(F.transform("paths", lambda p: of_path(p, "m", "l"))), F.array(feature("c", F.col("r_cat"), 2, 26)),
        F.array_compact(F.array(F.when(F.col("handler") != "", feature("h", needle("h"), 3, 34)), F.when(F.col("svc").isNotNull(), feature("s", needle("s"), 4, 40)))),
    )
    left = cut(r.select(F.col("runtime_id").alias("id"), F.xxhash64(*r.columns).alias("row"), F.array_distinct(r_all).alias("x"))).select("id", "row", F.inline("x"))
    # handlers and services that ids hold; of a service and its method the one that fewer ids hold is looked up and the other compared
    handlers, services = r.where("handler <> ''").select(needle("h").alias("text")).distinct(), r.where("svc is not null").select("svc", "svc_method").distinct()
    ids = c.select("capability_id", F.lower("capability_id").alias("low")).distinct()
    found = containing(ids, handlers.select(F.col("text").alias("needle")).unionByName(services.select(F.explode(F.array("svc", "svc_method")).alias("needle"))))
    often = cut(found.groupBy("needle").agg(F.count(F.lit(1)).alias("n")))
    both = services.join(many(often.select(F.col("needle").alias("svc_method"), F.col("n").alias("n_m"))), "svc_method").join(many(often.select(F.col("needle").alias("svc"), F.col("n").alias("n_s"))), "svc")
    rarer = F.col("n_s") < F.col("n_m")
    both = both.select(F.when(rarer, F.col("svc")).otherwise(F.col("svc_method")).alias("needle"), F.when(rarer, F.col("svc_method")).otherwise(F.col("svc")).alias("other"), needle("s").alias("text"))
    served = found.join(many(both), "needle").where(F.lower("capability_id").contains(F.col("other"))).select("capability_id", "text", F.lit("s").alias("mark"))
    held = found.select("capability_id", F.col("needle").alias("text"), F.lit("h").alias("mark")).join(many(handlers), "text", "left_semi")
    named = c.select("capability_id", F.trim(method(F.col("capability_id"))).alias("text"), F.lit("h").alias("mark")).where("text <> ''").join(many(handlers), "text", "left_semi")
    signal = served.unionByName(held.select(*served.columns)).unionByName(named.select(*served.columns)).distinct().withColumn("x", F.struct(F.concat_ws(":", "mark", "text").alias("feature"), F.when(F.col("mark") == "h", 3).otherwise(4).alias("kind"), F.when(F.col("mark") == "h", 34).otherwise(40).alias("weight")))
    c_row = F.xxhash64("capability_id", "path", "c_cat").alias("row")
    c_all = F.concat(words(F.col("c_words")), F.when(F.col("path") != "", of_path(F.col("path"), "l", "m")).otherwise(F.array()), F.array(feature("c", F.col("c_cat"), 2, 26)))
    own = cut(c.select(F.col("capability_id").alias("id"), c_row, F.array_distinct(c_all).alias("x"))).select("id", "row", F.inline("x"))
    right = own.unionByName(cut(c.select("capability_id", c_row).join(many(signal), "capability_id").select(F.col("capability_id").alias("id"), "row", "x.*")))
    return best_pairs(left, right, most, least, -8, 4).select(F.col("left_id").alias("runtime_id"), F.col("right_id").alias("capability_id"))


def runtime_capabilities(runtime: DataFrame, capabilities: DataFrame, least: int = 35, most: int = 6) -> DataFrame:
    """(runtime_id, capability_id, score, reason, rank): additive scores over paths, category, handler, service and words.

    runtime: (id, label, source_paths, category, handler); capabilities: (node_id, source_path, category). Candidates are the
    pairs of `link_candidates`; paths fit by whole parts.
    """
    r, c = _linked_sides(runtime, capabilities)
    pairs = link_candidates(r, c, least, most).join(many(c), "capability_id").join(many(r), "runtime_id")
    split = lambda p: F.split(p, "/")
    single = lambda p: F.size(split(p)) == 1

    equal = F.exists("paths", lambda p: p == F.col("path"))
    ends = lambda a, b: (a == b) | a.endswith(F.concat(F.lit("/"), b))
    partial = F.exists("paths", lambda p: ends(p, F.col("path")) | ends(F.col("path"), p) | (~single(p) & ~single(F.col("path")) & (_tail(p) == _tail(F.col("path")))))
    path_score = F.when((F.col("path") == "") | (F.size("paths") == 0), 0).when(equal, 65).when(partial, 32).otherwise(0)
    same = F.col("r_cat") == F.col("c_cat")
    m = F.trim(method(F.col("capability_id")))
    handler = (F.col("handler") != "") & (m != "") & ((m == F.col("handler")) | F.lower("capability_id").contains(F.col("handler")))
    svc = F.coalesce(F.lower("capability_id").contains(F.col("svc")) & F.lower("capability_id").contains(F.col("svc_method")), F.lit(False))
    overlap = F.size(F.array_intersect("r_words", "c_words"))
    score = path_score + F.when(same, 18).otherwise(-8) + F.when(handler, 34).otherwise(0) + F.when(svc, 40).otherwise(0) + F.least(F.lit(24), overlap * 6)
    reason = F.concat_ws("+", F.when(path_score >= 60, "source_path_exact").when(path_score > 0, "source_path_partial"), F.when(same, "category_match"), F.when(handler, "handler_match"), F.when(svc, "service_method_match"), F.when(overlap > 0, F.concat(F.lit("token_overlap_"), overlap.cast("string"))))
    scored = pairs.select("runtime_id", "capability_id", score.alias("score"), reason.alias("reason"), "path").where(F.col("score") >= least)
    return top_by(scored, ["runtime_id"], most, F.desc("score"), F.col("capability_id"))


def runtime_homes(matches: DataFrame, links: OwnerLinks) -> DataFrame:
    """(runtime_id, home, score): the greatest score of a runtime node's capabilities in each owner and path."""
    return matches.select("runtime_id", "capability_id", "score").join(many(links.capabilities), "capability_id").groupBy("runtime_id", "home").agg(F.max("score").alias("score"))


def runtime_leaves(matches: DataFrame, links: OwnerLinks) -> DataFrame:
    """(runtime_id, leaf_id, confidence) through matched capabilities, the greatest score / 120. Members have one home, so their pairs are told once."""
    confidence = X.confidence(F.col("score") / 120.0).alias("confidence")
    plain = runtime_homes(matches, links).select("runtime_id", "home", confidence).join(many(links.members), "home").select("runtime_id", "leaf_id", "confidence")
    rest = matches.select("runtime_id", "capability_id", confidence).join(many(links.rest.select("capability_id", "leaf_id")), "capability_id").groupBy("runtime_id", "leaf_id").agg(F.max("confidence").alias("confidence"))
    return plain.unionByName(rest)


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id): the first route of the call's method that shares a variant, else the first that fits by parts.

    calls: (call_id, method, path); routes: (route_id, method, path, ord). Parts fit if they are equal or one is a parameter.
    A path's mask says which of its parts are parameters. Few masks occur, so a call is keyed for each mask that routes of
    its method and length have, and a route for each mask of calls: both masks, and the parts that are fixed under both. Of
    equal keys the first route is chosen before calls meet it, so parameters lead to no more pairs than fixed parts do.
    """
    c = calls.select("call_id", F.upper("method").alias("method"), F.explode(X.path_variants(F.col("path"))).alias("v"))
    r = routes.select("route_id", F.upper("method").alias("method"), "ord", F.explode(X.path_variants(F.col("path"))).alias("v"))
    place = F.struct("ord", "route_id")
    exact = c.join(r.groupBy("method", "v").agg(F.min(place).alias("first")), ["method", "v"]).select("call_id", "first", F.lit(0).alias("step"))

    def masked(df: DataFrame) -> DataFrame:
        parts = df.withColumn("parts", X.segments(X.comparable_path(F.col("v")))).withColumn("n", F.size("parts"))
        return parts.withColumn("mask", F.array_join(F.transform("parts", lambda x: x.rlike(X.DYNAMIC).cast("int").cast("string")), "")).withColumn("free", F.col("v").contains(":param"))

    def keyed(df: DataFrame, others: DataFrame) -> DataFrame:
        """Each path with each mask of the other side, `other`, and the parts that neither mask leaves open."""
        met = df.join(small(others.select("method", "n", F.col("mask").alias("other")).distinct()), ["method", "n"])
        one = lambda mask, i: F.substring(mask, i + 1, F.lit(1)) == "1"
        return met.withColumn("key", F.array_join(F.transform("parts", lambda x, i: F.when(one(F.col("mask"), i) | one(F.col("other"), i), "\x01").otherwise(x)), "/"))

    cm, rm = masked(c), masked(r)
    firsts = keyed(rm, cm).groupBy("method", "n", F.col("other").alias("mask"), F.col("mask").alias("other"), "key").agg(F.min(place).alias("any"), F.min(F.when(F.col("free"), place)).alias("open"))
    loose = keyed(cm, rm).join(firsts, ["method", "n", "mask", "other", "key"]).select("call_id", F.when(F.col("free"), F.col("any")).otherwise(F.col("open")).alias("first"), F.lit(1).alias("step")).where("first is not null")
    best = exact.unionByName(loose).groupBy("call_id").agg(F.min(F.struct("step", "first")).alias("best"))
    return best.select("call_id", F.col("best.first.route_id").alias("route_id"))


def best_frame_node(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trace_id, node_id, score): the node that best fits any stack frame of a trace; path must agree, method and class add.

    frames: (trace_id, path, symbol, f_ord); nodes: (node_id, source_path, ord).
    """
    f = frames.select("trace_id", F.lower(X.slashes(F.col("path"))).alias("p"), F.lower(F.coalesce("symbol", F.lit(""))).alias("symbol"), "f_ord")
    n = nodes.withColumn("ref", X.node_parts(F.col("node_id"))).select("node_id", F.lower(X.slashes(F.coalesce("source_path", F.lit("")))).alias("p"), "ref", "ord").where("p <> ''")
    score = F.lit(10) + F.when(F.col("symbol").contains(F.lower("ref.method")), 8).otherwise(0) + F.when(F.col("symbol").contains(F.lower("ref.class")), 5).otherwise(0)
    met = f.join(n, "p").select("trace_id", "node_id", score.alias("score"), "f_ord", "ord")
    return first_by(met, ["trace_id"], F.desc("score"), F.col("f_ord"), F.col("ord")).select("trace_id", "node_id", "score")


def link_stats(links: DataFrame, runtime_ids: DataFrame, capability_ids: DataFrame, leaf_ids: DataFrame) -> DataFrame:
    """One row of counts and match rates over links of both directions."""
    rc = (F.col("from_view") == "runtime") & (F.col("to_view") == "capability")
    cl = (F.col("from_view") == "capability") & (F.col("to_view") == "leaf")
    rl = (F.col("from_view") == "runtime") & (F.col("to_view") == "leaf")
    got = links.agg(
        F.count(F.lit(1)).alias("link_count"), F.count_if(rc).alias("runtime_capability_links"), F.count_if(cl).alias("capability_leaf_links"), F.count_if(rl).alias("runtime_leaf_links"),
        F.countDistinct(F.when(rc, F.col("from_id"))).alias("runtime_matched"), F.countDistinct(F.when(cl, F.col("from_id"))).alias("capability_matched"), F.countDistinct(F.when(cl, F.col("to_id"))).alias("leaf_matched"), F.countDistinct(F.when(rl, F.col("from_id"))).alias("end_to_end"),
    )
    return with_rates(got, runtime_ids, capability_ids, leaf_ids)


def with_rates(got: DataFrame, runtime_ids: DataFrame, capability_ids: DataFrame, leaf_ids: DataFrame) -> DataFrame:
    """A row of counts of links with the numbers of nodes and the match rates."""
    sizes = [df.select(F.countDistinct(df.columns[0]).alias(n)) for df, n in ((runtime_ids, "runtime_nodes"), (capability_ids, "capability_nodes"), (leaf_ids, "leaf_nodes"))]
    names = ["link_count", "runtime_capability_links", "capability_leaf_links", "runtime_leaf_links", "runtime_matched", "capability_matched", "leaf_matched", "end_to_end"]
    got = reduce(DataFrame.join, sizes, got.select(*names))  # one-row frames
    return got.withColumns({"runtime_match_rate": X.ratio(F.col("runtime_matched"), F.col("runtime_nodes")), "capability_leaf_rate": X.ratio(F.col("capability_matched"), F.col("capability_nodes")), "leaf_capability_rate": X.ratio(F.col("leaf_matched"), F.col("leaf_nodes")), "end_to_end_rate": X.ratio(F.col("end_to_end"), F.col("runtime_nodes"))})


def runtime_paths(nodes: DataFrame) -> DataFrame:
    """(id, source_paths): a runtime node's own path, then its evidence's, distinct."""
    own = F.array(F.col("source_path"))
    every = F.concat(own, F.coalesce(F.transform("evidence", lambda e: e["source_path"]), F.array().cast("array<string>")))
    return nodes.select("id", F.array_distinct(F.filter(F.transform(every, lambda p: X.slashes(F.trim(p))), lambda p: p.isNotNull() & (p != ""))).alias("source_paths"))


def _matched(runtime: DataFrame, capabilities: DataFrame, top: int) -> DataFrame:
    """(runtime_id, capability_id, score, reason, path): J7's first `top` links, one row for each pair."""
    rc = runtime_capabilities(runtime, capabilities).where(F.col("rank") <= top)
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda x: x["reason"]))  # `top` at most
    return cut(rc.groupBy("runtime_id", "capability_id").agg(F.max("score").alias("score"), F.array_join(reasons, "|").alias("reason"), F.min_by("path", "rank").alias("path")))


def view_map(runtime: DataFrame, capabilities: DataFrame, leaves: DataFrame, top: int = 3) -> DataFrame:
    """LINK rows between the three views, both ways.

    runtime: (id, label, source_paths, category, handler); others as in J6 and J7, of which all leaves count. Each pair is
    told once, so no row of the result is grouped or shuffled.
    """
    links = owner_links(capabilities, leaves)
    rc = _matched(runtime, capabilities, top)
    paths = capabilities.groupBy(F.col("node_id").alias("capability_id")).agg(F.min("source_path").alias("source_path"))
    reasons = {"exact": "capability and leaf have the same id", "folded_leaf": "the capability folds this leaf", "owner_match": "capability and leaf share path and owner"}
    same = F.col("capability_id") == F.col("leaf_id")
    owned = links.capabilities.join(many(paths), "capability_id").join(many(links.members), "home").select("capability_id", "leaf_id", F.when(same, "exact").otherwise("owner_match").alias("relation"), F.when(same, 0.99).otherwise(0.78).alias("confidence"), "source_path")
    cl = owned.unionByName(links.rest.join(many(paths), "capability_id").select(*owned.columns))
    a = cl.select(F.lit("capability").alias("from_view"), F.col("capability_id").alias("from_id"), F.lit("leaf").alias("to_view"), F.col("leaf_id").alias("to_id"), "relation", "confidence", F.coalesce(*(F.when(F.col("relation") == k, F.lit(v)) for k, v in reasons.items())).alias("reason"), "source_path")
    b = rc.select(F.lit("runtime").alias("from_view"), F.col("runtime_id").alias("from_id"), F.lit("capability").alias("to_view"), F.col("capability_id").alias("to_id"), F.lit("runtime_capability").alias("relation"), X.confidence(F.col("score") / 100.0).alias("confidence"), "reason", F.when(F.col("path") != "", F.col("path")).alias("source_path"))
    d = runtime_leaves(rc, links).select(F.lit("runtime").alias("from_view"), F.col("runtime_id").alias("from_id"), F.lit("leaf").alias("to_view"), F.col("leaf_id").alias("to_id"), F.lit("runtime_leaf_derived").alias("relation"), "confidence", F.lit("through a matched capability").alias("reason"), F.lit(None).cast("string").alias("source_path"))
    from .merge import mirrored

    return mirrored(a.unionByName(b).unionByName(d))


def view_stats(runtime: DataFrame, capabilities: DataFrame, leaves: DataFrame, top: int = 3) -> DataFrame:
    """A12 of the links of `view_map`: the same row as `link_stats` of them, counted by owners and paths without making them."""
    links = owner_links(capabilities, leaves)
    rc = _matched(runtime, capabilities, top)
    members = cut(links.members.groupBy("home").agg(F.count(F.lit(1)).alias("n")))
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    distinct = lambda *dfs: reduce(DataFrame.unionByName, dfs).agg(F.countDistinct("id"))
    rest = cut(links.rest)
    of = links.capabilities.join(many(members), "home").select("capability_id", "home", "n").transform(cut)
    led = runtime_homes(rc, links).join(many(members), "home").select("runtime_id", "n").transform(cut)
    through = rc.join(many(rest), "capability_id").select("runtime_id", "leaf_id").distinct().transform(cut)
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)))
    counted = lambda df: df.agg(F.count(F.lit(1)))
    cells = {
        "cl_n": total(of), "cl_rest": counted(rest), "rl_n": total(led), "rl_rest": counted(through), "runtime_capability_links": counted(rc), "runtime_matched": distinct(ids(rc, "runtime_id")),
        "capability_matched": distinct(ids(of, "capability_id"), ids(rest, "capability_id")), "leaf_matched": distinct(ids(links.members.join(many(of.select("home").distinct()), "home", "left_semi"), "leaf_id"), ids(rest, "leaf_id")),
        "end_to_end": distinct(ids(led, "runtime_id"), ids(through, "runtime_id")),
    }
    got = reduce(DataFrame.join, (df.toDF(n) for n, df in cells.items()))  # one-row frames
    got = got.withColumns({"capability_leaf_links": F.col("cl_n") + F.col("cl_rest"), "runtime_leaf_links": F.col("rl_n") + F.col("rl_rest")})
    # no link is within a view, so each has its reverse
    got = got.withColumn("link_count", 2 * (F.col("runtime_capability_links") + F.col("capability_leaf_links") + F.col("runtime_leaf_links")))
    return with_rates(got, runtime.select("id"), capabilities.select("node_id"), leaves.select("node_id"))
