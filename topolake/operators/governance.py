"""Rules over measures: statuses, gates and the exit code of a governed run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import small

# Exit codes, the rules a hard policy must have, and its ghost policy by language.
EXIT_CODES = {"pass": 0, "gate_fail": 2, "policy_invalid": 3, "artifact_missing": 4, "metric_unavailable": 5, "forbidden_change": 6, "not_improved": 7}
REQUIRED_RULES = [("diagnostics_no_code", "eq", 0.0, None), ("execute_like_ratio", "lt", 0.1, None), ("ghost_ratio", "lt", 0.4, None), ("rendered_edges_consistency", "eq", None, True), ("runtime_unmatched_route_count", "lte_baseline_factor", 1.1, None)]
GHOST_POLICY = [("python", False, 0, 4), ("javascript", False, 0, 4), ("typescript", True, 5, 4), ("java", True, 5, 4), ("go", True, 5, 4), ("rust", True, 8, 4)]
PARSER_GHOST_POLICY = [("default", True, 5, 4), ("python", False, 0, 5), ("javascript", False, 0, 5), ("typescript", True, 4, 4), ("java", True, 4, 4), ("go", True, 4, 4), ("rust", True, 4, 5), ("cpp", True, 3, 4)]


def evaluate(rules: DataFrame, metrics: DataFrame, baseline: float | None = None) -> DataFrame:
    """(key, status, must_pass) of each RULE (key, op, num, flag, must_pass) over METRIC (key, num, flag).

    A rule whose measure is absent or of the other kind, or that needs an absent baseline, is an error.
    """
    m = metrics.select(F.col("key").alias("_k"), F.col("num").alias("_n"), F.col("flag").alias("_f"))
    rows = rules.join(small(m), F.col("key") == F.col("_k"), "left")
    base = F.lit(baseline).cast("double")
    limit = F.greatest(F.lit(0.0), F.ceil(base * F.when(F.col("num") > 0, F.col("num")).otherwise(1.1)).cast("double"))
    holds = (
        F.when(F.col("flag").isNotNull(), F.col("_f") == F.col("flag")).when(F.col("op") == "eq", F.col("_n") == F.col("num")).when(F.col("op") == "lt", F.col("_n") < F.col("num"))
        .when(F.col("op") == "lte", F.col("_n") <= F.col("num")).when(F.col("op") == "gt", F.col("_n") > F.col("num")).when(F.col("op") == "gte", F.col("_n") >= F.col("num")).when(F.col("op") == "lte_baseline_factor", F.col("_n") <= limit)
    )
    return rows.select("key", F.when(holds.isNull(), "error").when(holds, "pass").otherwise("fail").alias("status"), "must_pass")


def coverage_gates(gates: DataFrame, covered: DataFrame) -> DataFrame:
    """(key, status, must_pass) of gates (scope, target, metric, op, value, must_pass) over coverage rows; no files fail."""
    c = covered.select("scope", F.col("bucket").alias("target"), "total", "declared_coverage", "runtime_coverage", "combined_coverage")
    rows = gates.join(c, ["scope", "target"], "left")
    actual = F.when(F.col("metric") == "declared", F.col("declared_coverage")).when(F.col("metric") == "runtime", F.col("runtime_coverage")).otherwise(F.col("combined_coverage"))
    ok = F.coalesce((F.col("total") > 0) & F.when(F.col("op") == "gt", actual > F.col("value")).otherwise(actual >= F.col("value")), F.lit(False))
    return rows.select(F.concat_ws(".", F.lit("coverage_gate"), "scope", "target").alias("key"), F.when(ok, "pass").otherwise("fail").alias("status"), "must_pass")


def schema_check(diagnostics: DataFrame) -> DataFrame:
    """(key, status, must_pass): whether all diagnostics have level, code, component and message."""
    blank = F.lit(False)
    for c in ("level", "code", "component", "message"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    return diagnostics.agg(F.count_if(blank).alias("n")).select(F.lit("runtime_diagnostics_schema_valid").alias("key"), F.when(F.col("n") > 0, "error").otherwise("pass").alias("status"), F.lit(True).alias("must_pass"))


def gate(checks: DataFrame, violations: int = 0, forbidden: int = 0, policy_valid: bool = True, artifacts: bool = True, fix: bool = False) -> DataFrame:
    """One row (exit_code, passed). Invalid policy and missing artifacts end a run; then forbidden changes, errors, failures."""
    n = checks.agg(F.count_if(F.col("status") == "error").alias("errors"), F.count_if((F.col("status") == "fail") & F.col("must_pass")).alias("fails"))
    bad = (F.col("fails") > 0) | F.lit(violations > 0)
    code = (
        F.when(F.lit(not policy_valid), EXIT_CODES["policy_invalid"]).when(F.lit(not artifacts), EXIT_CODES["artifact_missing"]).when(F.lit(forbidden > 0), EXIT_CODES["forbidden_change"])
        .when(F.col("errors") > 0, EXIT_CODES["metric_unavailable"]).when(bad, EXIT_CODES["not_improved"] if fix else EXIT_CODES["gate_fail"]).otherwise(EXIT_CODES["pass"])
    )
    return n.select(code.alias("exit_code"), (code == 0).alias("passed"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, sha256) of (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) where two manifests (path, sha256) differ: added, removed or changed."""
    both = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
