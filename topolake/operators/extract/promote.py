"""Which functions are capabilities: suppression, the promotion score, and folding of an owner's functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions import contracts as K
from ...functions.scalars import element, slashes, total
from ...sources.config import Parser
from ..merge import merge_entries
from ..shared import written

# Beginnings and endings of names, and words, that tell capabilities from helpers.
HARD_HELPERS = ["set", "build", "parse", "format", "normalize", "sanitize", "validate", "collect", "resolve", "prepare", "infer", "guess", "convert", "merge", "filter", "check"]
SOFT_HELPERS = ["get", "list", "create", "load", "save", "ensure", "read", "write", "sync"]
PRIMARY = ["execute", "run", "handle", "process", "invoke", "dispatch", "orchestrate", "apply", "plan", "schedule"]
ACTIONS = ["submit", "export", "import", "reconcile"]
UTILITY = ["run", "detect", "analyze", "apply"]
NODE_ENTRIES = ["execute", "run", "process"]
CONTAINERS = ["Service", "Node", "Workflow", "Pipeline", "Step", "Handler", "Controller", "Tool", "Agent", "Manager", "Orchestrator", "Router", "Planner", "Coordinator", "Dispatcher", "Executor", "Registry"]
DECORATOR = r"(?i)\b(route|get|post|put|delete|patch|task|workflow|tool|step|action|consumer|handler|command|event|rpc)\b"
EXECUTE_LIKE = r"(?i)^(execute|run|handle|process|dispatch|apply|invoke|orchestrate|schedule|plan|do)($|[_A-Z])"
WORKFLOW_LIKE = r"(?i)(workflow|pipeline|stage|step|transition|handler|controller|service|adapter|gateway|tool|worker|operator|kernel|agent|command|consumer|endpoint|orchestrator|planner|router|dispatcher|executor|registry|conversation|session|memory)"
FRONTEND_WORDS = r"(?i)(page|layout|provider|store|query|mutation|dashboard|screen|view|form|modal|dialog|panel|widget|table|chart|route)"
AGENT_WORDS = r"(?i)(chat|conversation|orchestr|planner|tool|function|memory|session|assistant|reasoning|router|dispatch|message|prompt|completion|registry|executor|coordinator)"
CLI_WORDS = r"(?i)(cli|commands?|subcommands?|handlers?|argv|option|flag|serve|start|deploy|init|main|entry|program|parser|subparser|register|load|plugin|auth|mcp)"
METHOD_WORDS = ["execute", "run", "handle", "process", "dispatch", "apply", "invoke", "call", "capability", "pipeline", "flow"]
SUBJECT_WORDS = ["module", "domain", "capability", "pipeline", "flow", "aggregate", "class", "function", "method", "index", "main"]
SOURCE_WORDS = ["index", "main", "src", "lib", "core", "app", "server", "client"]
MAGIC = ["toString", "valueOf", "toJSON", "inspect", "hashCode", "equals", "ToString"]
TYPE_PARTS = ["types", "schemas", "schema", "models", "model", "entities", "entity", "dto", "vo"]


def begins(name: Column, words: list[str]) -> Column:
    """The name is one of the words, or begins with one that a capital, underscore or digit ends."""
    return name.rlike(f"^(?i:{'|'.join(words)})($|[_A-Z0-9])")


def semantic_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-./\\:]+", " ")), r"\s+"), lambda x: x != "")


def path_tail(path: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(slashes(F.trim(F.coalesce(path, F.lit("")))), r"\.[^./]+$", ""), "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " ")


def scope_of(path: Column, kind: Column | None = None) -> Column:
    """Policy of a path: a configured scope's kind, else by its directories."""
    parts = F.split(F.lower(slashes(F.coalesce(path, F.lit("")))), "/")
    any_of = lambda names: F.exists(parts, lambda x: x.isin(names))
    by_path = F.when(any_of(["test", "tests", "__tests__"]), "tests").when(any_of(["migration", "migrations", "alembic"]), "migrations").when(any_of(TYPE_PARTS), "types").otherwise("other")
    return F.coalesce(kind, by_path) if kind is not None else by_path


def _contract_type(entry: Column) -> Column:
    raw = F.regexp_replace(F.regexp_replace(F.trim(entry), r"(?i)^\[Generic\]\s*", ""), r"(?i)^\[Ghost:[^\]]+\]\s*", "")
    return F.when(F.lower(raw).isin(K.NONE_TOKENS), F.lit("")).otherwise(F.trim(K.without_name(raw)))


def judged(records: DataFrame, config: Parser | None = None, kind: Column | None = None) -> DataFrame:
    """records with `suppressed`, `reasons`, `score`, `promoted`, `primary`, `container`.

    records: (source_path, owner, name, demand, answer, decorators, exported). Every signal is a column; the score is their sum.
    """
    cfg = config or Parser()
    name, owner, path = F.col("name"), F.coalesce("owner", F.lit("")), F.coalesce("source_path", F.lit(""))
    low_path, scope = F.lower(slashes(path)), F.col("_scope")
    decorated = F.exists("decorators", lambda d: d.rlike(DECORATOR))
    ignored = lambda t: K.is_generic(F.regexp_replace(t, r"(?i)^typing\.", ""), cfg.ignored_types)
    types = lambda c: F.filter(F.transform(c, _contract_type), lambda t: t != "")
    every = F.concat("demand", "answer")
    domain = F.exists(types(every), lambda t: ~ignored(t))
    only_generic = (F.size(types(every)) > 0) & ~domain
    primary = begins(name, list(dict.fromkeys([*PRIMARY, *cfg.entry_methods])))
    flow = name.rlike(WORKFLOW_LIKE)
    tail = path_tail(path)
    said = F.concat_ws(" ", name, owner, tail)
    first_type = F.coalesce(element(types(F.concat("answer", "demand")), 1), F.lit(""))
    ui = low_path.rlike(r"\.(tsx|jsx)$") | (scope == "ui")
    frontend = ui & (name.rlike("^(use|render)[A-Z0-9_]") | said.rlike(FRONTEND_WORDS) | low_path.rlike(r"(^|/)(page|layout|route|loading|error)\.(tsx|jsx|ts|js)$"))
    agent = (scope == "agent") & F.concat_ws(" ", said, first_type).rlike(AGENT_WORDS)
    cli = (scope == "cli") & (low_path.rlike(r"(^|/)(commands?|handlers?|parsers?|subcommands?)(/|$)") | F.concat_ws(" ", said, first_type).rlike(CLI_WORDS))
    hard, soft = begins(name, HARD_HELPERS), begins(name, SOFT_HELPERS) & ~begins(name, HARD_HELPERS)
    executes = name.rlike(EXECUTE_LIKE)
    out_ = F.coalesce("exported", F.lit(False))
    container = owner.rlike(f"({'|'.join(CONTAINERS)})$")

    allowed = (
        F.lit(cfg.helper_verb_policy == "allow")
        | F.when(scope == "api", decorated | primary | out_).when(scope == "nodes", begins(name, NODE_ENTRIES) & primary).when(scope == "tasks", primary | decorated | flow)
        .when(scope == "ui", out_ | primary | frontend | flow).when(scope == "agent", primary | decorated | agent | flow).when(scope == "cli", out_ | primary | cli | flow)
        .when(scope == "utils", begins(name, UTILITY)).when(scope == "services", domain).otherwise(primary | decorated | out_)
    )
    relaxed = hard & (scope == "agent") & (agent | flow)
    magic = F.lit(False) if not cfg.exclude_magic_methods else (name.isin(MAGIC) | name.rlike("^__.*__$"))
    private = F.lit(False) if not cfg.exclude_private_methods else name.startswith("_")
    noise = F.lit(False)
    for p in cfg.noise_names:
        noise = noise | name.rlike(f"(?i){p}")
    suppressed = (
        (F.trim(name) == "") | scope.isin("tests", "types", "migrations") | private | magic | noise | (hard & ~relaxed) | ((soft | relaxed) & ~allowed) | ((scope == "api") & ~decorated & ~primary & ~out_)
        | ((scope == "nodes") & ~begins(name, NODE_ENTRIES)) | ((scope == "tasks") & ~primary & ~decorated & ~flow) | ((scope == "utils") & ~begins(name, UTILITY) & ~decorated)
    )
    business = F.size(F.filter(semantic_words(said), lambda w: ~w.isin(SUBJECT_WORDS + METHOD_WORDS))) >= 2
    from ...functions.scalars import OWN_TARGETS, RESOURCE_WORDS, UNKNOWN_TYPES, ghost_parts

    ghosts = F.transform(F.filter("demand", lambda e: F.trim(e).rlike(r"(?i)^\[Ghost:")), ghost_parts)
    crosses = F.exists(ghosts, lambda g: ~g["target"].rlike(f"(?i){OWN_TARGETS}") & (g["target"].contains(".") | g["target"].rlike(f"(?i){RESOURCE_WORDS}") | ~F.trim(g["type"]).rlike(f"(?i){UNKNOWN_TYPES}")))
    reasons = F.array_compact(F.array(
        F.when(domain, "external_contract"), F.when(decorated | flow, "runtime_signal"), F.when(frontend, "frontend_surface"), F.when(agent, "agent_flow"),
        F.when(cli, "cli_entrypoint"), F.when(business, "business_semantic"), F.when(crosses, "cross_module_call"),
    ))
    work = flow | owner.rlike(WORKFLOW_LIKE)
    gains = [
        (out_, 1), (decorated, 3), (primary, 1), (work, 2), (frontend, 1), (agent, 1), (cli, 1), (container & ~executes, 1), (begins(name, ACTIONS), 1), (domain, 3), ((scope == "api") & decorated, 2),
        ((scope == "ui") & (frontend | out_ | work), 2), ((scope == "agent") & (agent | work | primary), 2), ((scope == "cli") & (cli | primary | out_), 2), (scope.isin("tasks", "nodes") & (primary | work), 2),
        ((scope == "services") & (domain | work), 1), ((scope == "utils") & begins(name, UTILITY), 1), (soft, -2), (only_generic, -3), (executes, -3),
    ]
    score = total([F.when(F.coalesce(ok, F.lit(False)), n).otherwise(0) for ok, n in gains])
    base = records.withColumn("_scope", scope_of(F.col("source_path"), kind))
    rows = base.withColumns({"suppressed": suppressed, "reasons": reasons, "score": score, "primary": primary, "container": container, "_ok": ~(executes & ~domain & ~decorated & ~work) & ~owner.rlike("(?i)(base|abstract|container|wrapper)")})
    return rows.withColumn("promoted", ~F.col("suppressed") & F.col("_ok") & (F.size("reasons") >= 2) & (F.col("score") >= cfg.capability_threshold)).drop("_ok")


def fold(rows: DataFrame, config: Parser | None = None) -> DataFrame:
    """(node_id, source_path, demand, answer, folded_leaves, promotion_reasons) of judged records, by owner and file.

    An owner whose first primary record is promoted is one node of that name with all its records folded in; else its
    promoted records are nodes; else a container owner with unsuppressed records is one `.capability` node.
    """
    cfg = config or Parser()
    keep = ~F.col("name").isin(MAGIC) & ~F.col("name").rlike("^__.*__$") if cfg.fold_helpers else ~F.col("suppressed")
    item = F.struct("at", "name", "demand", "answer", "promoted", "primary", "suppressed", "reasons", keep.alias("folds"))
    owners = rows.groupBy("source_path", "owner").agg(F.array_sort(F.collect_list(item)).alias("r"), F.max("container").alias("container"))  # one owner of one file
    live = F.filter("r", lambda x: ~x["suppressed"])
    entry = element(F.filter(live, lambda x: x["primary"]), 1)
    folded = F.filter("r", lambda x: x["folds"])
    merged = lambda f, none: merge_entries(F.transform(folded, lambda x: x[f]), none)
    ids = F.array_distinct(F.transform(folded, lambda x: F.concat_ws(".", F.col("owner"), x["name"])))
    one = lambda name, reasons: F.struct(F.concat_ws(".", "owner", name).alias("node_id"), merged("demand", "None").alias("demand"), merged("answer", "void").alias("answer"), ids.alias("folded_leaves"), reasons.alias("promotion_reasons"))
    none = F.array().cast("array<string>")
    several = F.transform(F.filter("r", lambda x: x["promoted"]), lambda x: F.struct(F.concat_ws(".", F.col("owner"), x["name"]).alias("node_id"), x["demand"].alias("demand"), x["answer"].alias("answer"), none.alias("folded_leaves"), x["reasons"].alias("promotion_reasons")))
    chosen = F.when(F.coalesce(entry["promoted"], F.lit(False)), F.array(one(entry["name"], entry["reasons"]))).when(F.size(several) > 0, several).when(F.col("container") & (F.size(live) > 0), F.array(one(F.lit("capability"), none)))
    return owners.select("source_path", F.explode(chosen).alias("n")).select("source_path", "n.*")


def problem_text(node_id: Column, path: Column, raw: Column) -> Column:
    """What a node is for: its own text, or kind, verb and subject where that says nothing."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    empty = (low == "") | low.rlike(r"^execute\s+.+\s+(flow|capability|pipeline)$") | low.rlike(r"^execute\s+.+\s+(aggregate|module|class)\s+capability$") | low.rlike(r"^aggregate\s+(module|domain)\s+capability\s+for\s+")
    parts = F.filter(F.split(node_id, r"\."), lambda x: x != "")
    method = F.coalesce(element(parts, -1), F.lit("capability"))
    owner = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    text, name = F.lower(F.concat_ws(" ", node_id, path, method)), F.lower(method)
    kinds = [
        ("Interface", "(api|route|endpoint|controller|handler|command|consumer|rpc|webhook)"), ("Workflow", "(workflow|pipeline|orchestrat|stage|sync|plan|apply|dispatch|handoff|protocol)"),
        ("Adapter", "(adapter|gateway|repository|storage|database|db|queue|client|filesystem|network|model)"), ("Policy", "(policy|rule|guard|auth|permission|decide|resolver|router|validator)"),
        ("Execution", "(worker|job|tool|agent|operator|kernel|execute|runner|runtime|healing)"), ("Service", "(service|usecase|manager|domain)"),
    ]
    verbs = [("Handle", "^(handle|process|dispatch|consume|receive)"), ("Plan", "^(plan|prepare|draft|protocol)"), ("Produce", "^(apply|commit|write|save|persist|upsert|generate|create)"), ("Coordinate", "^(sync|watch|heal|recover|rollback|restore)"), ("Analyze", "^(detect|analyze|diagnose|calculate|resolve|scan|parse|read|load)"), ("Run", "^(execute|run|invoke|call)")]
    kind = F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in kinds), F.lit("System"))
    verb = F.coalesce(*(F.when(name.rlike(p), F.lit(v)) for v, p in verbs), F.lit("Provide"))
    told = F.concat(semantic_words(owner), F.filter(semantic_words(method), lambda w: ~w.isin(METHOD_WORDS)), F.slice(F.filter(semantic_words(path_tail(path)), lambda w: ~w.isin(SOURCE_WORDS)), 1, 2))
    words = F.filter(F.array_distinct(told), lambda w: ~w.isin(SUBJECT_WORDS))
    subject = F.array_join(F.when(F.size(words) > 0, words).otherwise(semantic_words(method)), " ")
    subject = F.concat(F.upper(F.left(subject, F.lit(1))), F.substring(subject, 2, 1 << 20))
    vague = (F.size(F.filter(semantic_words(F.concat_ws(" ", subject, path_tail(path))), lambda w: ~w.isin(SUBJECT_WORDS))) <= 1) & name.isin(METHOD_WORDS)
    return F.when(empty, F.concat(F.when(vague, "[low_semantic_name] ").otherwise(""), kind, F.lit(" Capability: "), verb, F.lit(" "), subject)).otherwise(raw)


def capabilities(rows: DataFrame, config: Parser | None = None) -> DataFrame:
    """fold's nodes, and one of each file that gives none but has functions to show; Java and C++ have no such files."""
    rows = written(rows)  # taken three times, and each would extract from all files again
    folded = fold(rows, config)
    last = file_fallback(rows.where(~F.col("language").isin("java", "cpp")), folded)
    return folded.unionByName(last.withColumn("promotion_reasons", F.array().cast("array<string>")))


def file_fallback(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """A19 (4): one `.module_pipeline` node for files that gave none but have unsuppressed top-level functions."""
    bare = rows.where("not suppressed").join(folded.select("source_path").distinct(), "source_path", "left_anti")
    w = Window.partitionBy("source_path").orderBy("at")
    firsts = bare.withColumn("_o", F.first("owner").over(w))
    return firsts.groupBy("source_path").agg(F.min("_o").alias("owner"), F.transform(F.array_sort(F.collect_list(F.struct("at", "demand", "answer", "name"))), lambda x: x).alias("r")).select(
        "source_path", F.concat_ws(".", "owner", F.lit("module_pipeline")).alias("node_id"), merge_entries(F.transform("r", lambda x: x["demand"]), "None").alias("demand"), merge_entries(F.transform("r", lambda x: x["answer"]), "void").alias("answer"), F.transform("r", lambda x: F.concat_ws(".", F.col("owner"), x["name"])).alias("folded_leaves")
    )
