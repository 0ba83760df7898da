"""Source trees as tables: scan, skip, read, classify; and what was skipped as diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import element, language, slashes
from ..operators.linkage import path_pattern

# Directories and files that a scan never enters, and file kinds by ending.
SKIP_SEGMENTS = ["node_modules", ".git", "venv", ".venv", "__pycache__", ".pytest_cache", ".next", "dist", "build", "logs", "uploads", "fastgpt_data", ".run_state", "tmp"]
SKIP_FILES = [r"\.lock$", r"^package-lock\.json$", r"^pnpm-lock\.ya?ml$", r"^yarn\.lock$", r"\.min\.(js|css)$", r"\.map$", r"\.(png|jpg|jpeg|gif|webp|ico|pdf|zip|gz|tar|bz2|7z|exe|dll|so|dylib|bin|class|jar)$"]
KINDS = [("dockerfile", r"(^|\.)dockerfile$"), ("python", r"\.py$"), ("typescript", r"\.(ts|tsx|mts|cts)$"), ("javascript", r"\.(js|jsx|mjs|cjs)$"), ("json", r"\.json$"), ("yaml", r"\.ya?ml$"), ("toml", r"\.toml$")]
LANGUAGE_ORDER = ["typescript", "javascript", "python", "go", "rust", "cpp", "java"]


def base_name(path: Column) -> Column:
    return element(F.split(slashes(path), "/"), -1)


def skipped(path: Column, patterns: list[str] = ()) -> Column:
    """A path in a skipped directory, of a skipped file, or under a configured pattern."""
    parts = F.transform(F.split(slashes(path), "/"), F.lower)
    out = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(SKIP_SEGMENTS))
    for p in SKIP_FILES:
        out = out | base_name(path).rlike(f"(?i){p}")
    for p in patterns:
        out = out | path_pattern(F.lower(slashes(path)), p)
    return out


def file_kind(path: Column) -> Column:
    """Kind of a file by name: a language, a data format, a dockerfile, or unknown."""
    low = F.lower(base_name(path))
    return F.coalesce(*(F.when(low.rlike(p), F.lit(name)) for name, p in KINDS), F.lit("unknown"))


def walk(spark: SparkSession, root: str, patterns: list[str] = (), max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, length, content) of a tree's files, and DIAG rows of what was left out.

    Spark lists the tree in parallel; only names and sizes are read where content isn't asked for. A limit keeps the first
    paths in order.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    prefix = "^(file:)?/*" + "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in root.replace("file:", "").strip("/")) + "/"
    named = raw.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), prefix, "").alias("path"), "length", "content")
    flagged = named.withColumn("_skip", skipped(F.col("path"), patterns))
    kept = flagged.where(~F.col("_skip")).drop("_skip")
    diags = summary(flagged.where("_skip").select("path"), "RUNTIME_EXCLUDED_PATHS_SUMMARY", "info", "Skipped runtime paths by exclude rules")
    if max_files is not None:
        # only names are ordered; contents stay where they are read
        first = kept.select(F.col("path").alias("_p")).orderBy("_p").limit(max_files + 1)
        last = first.agg(F.max("_p").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if last["n"] > max_files:
            kept = kept.where(F.col("path") < last["last"])
            diags = diags.unionByName(_diag(spark, "warning", "RUNTIME_MAX_FILES_REACHED", f"Runtime source scan reached its limit of {max_files} files"))
    return kept, diags


def _diag(spark: SparkSession, level: str, code: str, message: str) -> DataFrame:
    return spark.createDataFrame([(level, code, "RuntimeSourceCollector", message, None)], "level string, code string, component string, message string, source_path string")


def summary(paths: DataFrame, code: str, level: str, text: str) -> DataFrame:
    """One DIAG row with the number of distinct paths and the first five; none for no paths."""
    p = paths.select("path").distinct()
    five = p.orderBy("path").limit(5).agg(F.sort_array(F.collect_list("path")).alias("s"))
    rows = p.agg(F.count(F.lit(1)).alias("n")).join(five).where("n > 0")  # one-row frames
    more = F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    message = F.concat(F.lit(f"{text}: "), F.col("n").cast("string"), F.lit(" ["), F.array_join("s", ", "), more, F.lit("]"))
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit("RuntimeSourceCollector").alias("component"), message.alias("message"), F.lit(None).cast("string").alias("source_path"))


def runtime_files(files: DataFrame, max_bytes: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """S3: (path, language, content) of files to extract from, and DIAG rows of those too large or binary.

    The size is filtered before content is decoded. Files of no known kind stay out, but for .env files.
    """
    known = files.withColumn("language", file_kind(F.col("path"))).where((F.col("language") != "unknown") | F.lower(base_name(F.col("path"))).rlike(r"^\.env(\..+)?$"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    sized = known.where(F.col("length") <= max_bytes).withColumn("content", text)
    binary = F.instr("content", "\0") > 0
    diag = lambda df, code, message: df.select(F.lit("info").alias("level"), F.lit(code).alias("code"), F.lit("RuntimeSourceCollector").alias("component"), message.alias("message"), F.col("path").alias("source_path"))
    diags = diag(known.where(F.col("length") > max_bytes), "RUNTIME_FILE_TOO_LARGE", F.concat(F.lit("Skipped source file above the size limit ("), F.col("length").cast("string"), F.lit(" bytes)"))).unionByName(
        diag(sized.where(binary), "RUNTIME_BINARY_SKIPPED", F.lit("Skipped binary-like source file during runtime extraction"))
    )
    return sized.where(~binary).select("path", "language", "content"), diags


def by_language(files: DataFrame, languages: list[str]) -> DataFrame:
    """Files of some programming languages, with it."""
    return files.withColumn("language", language(F.col("path"))).where(F.col("language").isin(languages))


def project_languages(files: DataFrame) -> DataFrame:
    """(language, files), most files first, then by a fixed order."""
    counted = files.select(language(F.col("path")).alias("language")).where("language <> 'unknown'").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    place = F.array_position(F.array(*(F.lit(x) for x in LANGUAGE_ORDER)), F.col("language"))
    return counted.orderBy(F.desc("files"), place)
