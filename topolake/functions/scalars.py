"""Scalar expressions over paths, identifiers, ratios and labels; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def element(of: Column, at: int | str | Column) -> Column:
    """The value at a place (from 1, or back from -1) or key; null where there is none."""
    return F.try_element_at(of, at if isinstance(at, Column) else F.lit(at))


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def node_parts(ref: Column, categories: list[str] = ("frontend", "backend", "core")) -> Column:
    """(category, class, method) of a dotted reference; a known category in front is cut; a sole part has method `execute`."""
    every = F.filter(F.split(F.trim(ref), r"\."), lambda x: x != "")
    known = F.lower(element(every, 1)).isin(list(categories))
    parts = F.when(known, F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(1)))).otherwise(every)
    n = F.when(known, F.size(every) - 1).otherwise(F.size(every))
    method = F.when(n >= 2, element(parts, -1)).otherwise(F.lit("execute"))
    klass = F.when(n >= 2, F.get(parts, (n - 2).cast("int"))).otherwise(F.get(parts, F.lit(0)))
    return F.when(n > 0, F.struct(F.when(known, F.lower(element(every, 1))).alias("category"), klass.alias("class"), method.alias("method")))


def demand_parts(entry: Column, index: Column) -> Column:
    """(type, name) of `Type (name)`; null for none; a missing name is input{index + 1}."""
    form = r"^(.*?)\s*\(([^()]+)\)\s*$"
    text = F.trim(entry)
    named = text.rlike(form)
    kind = F.when(named, F.trim(F.regexp_extract(text, form, 1))).otherwise(text)
    name = F.when(named, F.trim(F.regexp_extract(text, form, 2))).otherwise(F.concat(F.lit("input"), (index + 1).cast("string")))
    return F.when(~F.lower(text).startswith("none") & (text != ""), F.struct(kind.alias("type"), name.alias("name")))


def category_name(value: Column, known: dict[str, str] | None = None, default: str = "core") -> Column:
    """A label trimmed, in lower case and by the map of known names; the default where there is none."""
    low = F.lower(F.trim(value))
    mapped = F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in (known or {}).items()), low)
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit(default)).otherwise(mapped)


def runtime_id(value: Column) -> Column:
    """An identifier of word signs, dots, slashes, colons and braces, with single underscores for all else."""
    out = slashes(F.trim(value))
    for pattern, to in ((r"\s+", "_"), (r"[^\w./:{}-]+", "_"), (r"_+", "_")):
        out = F.regexp_replace(out, pattern, to)
    return out


def line_column(content: Column, index: Column) -> Column:
    """(line, column), from 1, of an offset into a text."""
    lines = F.split(F.left(content, F.greatest(index, F.lit(0)).cast("int")), r"\r?\n", -1)
    return F.struct(F.size(lines).alias("line"), (F.char_length(element(lines, -1)) + 1).alias("column"))


def api_path(value: Column) -> Column:
    """A path with :param for template parts, without host, query and fragment, one leading and no trailing slash."""
    out = F.regexp_replace(F.trim(value), r"\$\{[^}]+\}", ":param")
    out = F.regexp_replace(out, r"(?i)^https?://[^/?#]*", "")
    out = F.regexp_extract(out, r"^([^?#]*)", 1)
    out = F.regexp_replace(F.concat(F.lit("/"), out), "/+", "/")
    return F.when(F.char_length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)


def comparable_path(value: Column) -> Column:
    """api_path with every kind of parameter as :param."""
    return F.regexp_replace(api_path(value), r"\{[^/}]+\}|\[[^/\]]+\]|:[A-Za-z_][\w-]*", ":param")


def path_variants(value: Column) -> Column:
    """The path, and it without /api, /api/vN or /vN, each plain and comparable; distinct, in that order."""
    plain = api_path(value)
    rest = []
    for prefix in (r"(?i)^/api(?:/v\d+)?(/.*|$)", r"(?i)^/v\d+(/.*|$)"):
        short = F.regexp_extract(plain, prefix, 1)
        gone = plain.rlike(prefix) & (short != "")
        rest += [F.when(gone, api_path(short)), F.when(gone, comparable_path(short))]
    return F.array_distinct(F.array_compact(F.array(plain, comparable_path(plain), *rest)))


def pascal(value: Column) -> Column:
    """Parts between signs other than letters and digits, each with a capital first letter."""
    parts = F.filter(F.split(value, r"[^A-Za-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20))), "")


def route_id(method: Column, path: Column) -> Column:
    """Identifier of an API route."""
    return runtime_id(F.concat(F.lit("ApiRoute."), F.upper(method), F.lit("."), api_path(path)))


def service_id(call: Column) -> Column:
    """Identifier of the service that a call such as `x_service.run(` goes to."""
    text = F.trim(call)
    dotted, direct = r"(?:self\.)?([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\(", r"\b([A-Za-z_]\w*)\s*\("
    owner = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, dotted, 1), "(?i)_service$", ""), "(?i)service$", "")
    return runtime_id(
        F.when(text.rlike(dotted), F.concat(F.lit("Service."), pascal(owner), F.lit("Service."), F.regexp_extract(text, dotted, 2)))
        .when(text.rlike(direct), F.concat(F.lit("Service."), F.regexp_extract(text, direct, 1)))
        .otherwise(F.concat(F.lit("Service."), text))
    )


def label_of_path(path: Column) -> Column:
    """A file's base name without a known ending, dashes and underscores as spaces."""
    base = element(F.split(path, r"[\\/]"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"(?i)\.(tsx?|jsx?|py|json|ya?ml|toml)$", ""), "[-_]", " ")


DYNAMIC = r"^(:param|\{[^/}]+\}|\[[^/\]]+\]|:[A-Za-z_][\w-]*)$"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def paths_match(left: Column, right: Column) -> Column:
    """X11: as many segments, and equal or dynamic on either side one by one."""
    a, b = segments(comparable_path(left)), segments(comparable_path(right))
    same = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | x.rlike(DYNAMIC) | y.rlike(DYNAMIC), F.lit(False))), lambda x: x)
    return (F.size(a) == F.size(b)) & same


def anchor_api(path: Column) -> Column:
    """X11: the path from its first /api segment on, if that isn't its start."""
    return api_path(F.when(path.rlike("(?i)^.+?/api(/v\\d+)?(/|$)"), F.regexp_replace(path, r"(?i)^.+?(/api(?:/v\d+)?(?:/.*)?)$", "$1")).otherwise(path))


# Words that say nothing about what a node is.
GENERIC_WORDS = ["service", "workflow", "runtime", "node", "task", "worker", "method", "class", "module", "file", "api", "route", "capability", "leaf"]


def tokens(value: Column) -> Column:
    """Distinct lower-case words of three letters and digits or more, without generic ones."""
    words = F.split(F.lower(value), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(GENERIC_WORDS)))


def label_tokens(value: Column) -> Column:
    """Lower-case words, cut at signs and at capitals after small letters."""
    cut = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.trim(cut)), r"\s+"), lambda x: x != "")


# Words that make a label weak or strong.
LOW_SIGNAL = ["classlist", "dimmed", "dragging", "hover", "click", "focus", "node", "edge", "item", "list", "value", "state", "event", "data", "default", "style", "dom", "ui", "test", "tmp"]
BUSINESS = [
    "api", "route", "handler", "service", "workflow", "worker", "task", "queue", "scheduler", "cache", "redis", "postgres", "mongo", "db",
    "model", "provider", "tool", "storage", "pipeline", "executor", "command", "endpoint",
]


def label_score(value: Column) -> Column:
    """(score, low_signal) of a candidate label."""
    text = F.trim(value)
    words = label_tokens(text)
    distinct = F.size(F.array_distinct(words))
    low = F.size(F.filter(words, lambda x: x.isin(LOW_SIGNAL)))
    business = F.size(F.filter(words, lambda x: x.isin(BUSINESS)))
    route = text.contains("/") | text.rlike(r"(?i)\b(get|post|put|delete|patch)\b")
    score = F.greatest(F.lit(1), distinct) - low * 1.1 + business * 1.8 + F.when(route, 2.4).otherwise(0.0) + F.when(text.rlike("[.:_]"), 0.4).otherwise(0.0)
    return F.struct(F.round(score, 6).alias("score"), ((business == 0) & (low >= F.greatest(F.lit(1), distinct - 1))).alias("low_signal"))


def diagnostic_code(code: Column, extractor: Column, level: Column) -> Column:
    """UPPER_SNAKE code of at most 120 signs, or RUNTIME_<EXTRACTOR>_<LEVEL>."""
    own = F.left(F.regexp_replace(F.regexp_replace(F.upper(F.trim(code)), "[^A-Z0-9]+", "_"), "^_+|_+$", ""), F.lit(120))
    snake = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(extractor, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    fallback = F.when(snake == "", F.lit("RUNTIME_UNKNOWN_DIAGNOSTIC")).otherwise(F.concat(F.lit("RUNTIME_"), snake, F.lit("_"), F.upper(level)))
    return F.when(F.trim(F.coalesce(code, F.lit(""))) != "", own).otherwise(fallback)


def ratio(part: Column, total: Column) -> Column:
    """Part / total to six digits, 0 of nothing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part / total, 6))


def confidence(value: Column) -> Column:
    """To four digits within 0.01 and 0.99; 0.5 for none."""
    return F.coalesce(F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(value, 4)))), F.lit(0.5))


def ratio_confidence(actual: Column, target: Column) -> Column:
    """0.6 and up to 0.95 by how far a ratio is over its target."""
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.25) * F.greatest(F.lit(0.0), actual - target) / target))


#: File endings by language, in order of test.
LANGUAGE_ENDINGS = [("typescript", "ts|tsx|mts|cts"), ("javascript", "js|jsx|mjs|cjs"), ("python", "py"), ("go", "go"), ("rust", "rs"), ("cpp", "cc|cpp|cxx|hpp|hh|h"), ("java", "java")]


def language(path: Column) -> Column:
    """Programming language by file ending, or unknown."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(rf"\.({ends})$"), F.lit(name)) for name, ends in LANGUAGE_ENDINGS), F.lit("unknown"))


def ghost_parts(entry: Column) -> Column:
    """(mode, type, target) of a ghost demand; other modes than Read and ReadWrite read as a plain read of unknown type."""
    form = r"(?i)^\[Ghost:(ReadWrite|Read)\]\s*(.*?)\s*\(([^()]+)\)\s*$"
    text, hit = F.trim(entry), F.trim(entry).rlike(form)
    filled = lambda c: F.when(F.trim(c) == "", F.lit("unknown")).otherwise(F.trim(c))
    mode = F.when(hit & (F.lower(F.regexp_extract(text, form, 1)) == "readwrite"), "read_write").otherwise("read")
    kind = F.when(hit, F.regexp_replace(filled(F.regexp_extract(text, form, 2)), r"\s+", " ")).otherwise("unknown")
    target = F.when(hit, filled(F.regexp_extract(text, form, 3))).otherwise(filled(F.regexp_replace(text, r"(?i)^\[Ghost:[^\]]+\]\s*", "")))
    return F.struct(mode.alias("mode"), kind.alias("type"), target.alias("target"))


#: What targets and types of a ghost demand tell.
RESOURCE_WORDS = "(redis|cache|db|database|session|postgres|mysql|mongo|minio|s3|queue|worker|task|workflow|pipeline|event|topic|client|http|api|tool|model|provider)"
UNKNOWN_TYPES = "^(unknown|any|none|null|undefined|module|object|dict|map|list|array|json)$"
SERVICE_WORDS = "(service|workflow|worker|task|queue|api|route|handler|controller)"
OWN_TARGETS = "^(self|this|ctx|context|state|data)$"


def ghost_score(ghost: Column, node_id: Column, path: Column, generic: Column) -> Column:
    """Score of a parsed ghost demand; `generic` says whether its type is too general."""
    unknown = F.trim(ghost["type"]).rlike(f"(?i){UNKNOWN_TYPES}")
    gains = [
        F.when(ghost["mode"] == "read_write", 2), F.when(~generic & ~unknown, 3), F.when(ghost["target"].rlike(f"(?i){RESOURCE_WORDS}"), 2),
        F.when(F.concat_ws(" ", node_id, path).rlike(f"(?i){SERVICE_WORDS}"), 1), F.when(ghost["target"].rlike(f"(?i){OWN_TARGETS}"), -2), F.when(unknown, -1),
    ]
    return total([F.coalesce(g, F.lit(0)) for g in gains])


def stack_frame(line: Column, root: str = "") -> Column:
    """(path, line, column, symbol) of a stack-trace line inside the project root."""
    place, at = r"((?:[A-Za-z]:)?[^():\n\r]+?\.[A-Za-z0-9]+):(\d+):(\d+)", r"at\s+(.+?)\s+\("
    path = F.trim(F.regexp_replace(slashes(F.regexp_extract(line, place, 1)), r"^\s*at\s+", ""))
    inside = F.lower(path).contains(root.lower()) if root else F.lit(True)
    relative = F.regexp_replace(F.regexp_replace(path, "(?i)^" + "".join(f"\\{c}" if not c.isalnum() else c for c in root) + "/?", "") if root else path, r"^\./", "")
    frame = F.struct(relative.alias("path"), F.regexp_extract(line, place, 2).try_cast("int").alias("line"), F.regexp_extract(line, place, 3).try_cast("int").alias("column"), F.when(line.rlike(at), F.trim(F.regexp_extract(line, at, 1))).alias("symbol"))
    return F.when(line.rlike(place) & inside, frame)


#: What a failure's words say it is, in order of test.
DIAGNOSES = [
    ("contract", "(validation|schema|contract|argument mismatch|expected .* received|assignable|zod)"),
    ("right_branch", "(config|state|env|undefined.*config|missing.*config|option|settings)"),
    ("topology", "(import|dependency|module not found|circular|topology|parentnode|childnode|reuse)"),
    ("left_branch", "(exception|error|failed|cannot read|undefined|null reference|stack overflow)"),
]


def diagnosis(message: Column) -> Column:
    """Class of a failure by its first matching words, else unknown."""
    low = F.lower(message)
    return F.coalesce(*(F.when(low.rlike(words), F.lit(name)) for name, words in DIAGNOSES), F.lit("unknown"))


def action(kind: Column, retries: Column, most: int = 3) -> Column:
    """What to do about a failure of that class after so many retries."""
    return F.when(kind == "topology", F.lit("manual_review")).when(retries >= most, F.lit("create_child")).otherwise(F.lit("modify"))


def risk_bucket(impacted: Column) -> Column:
    """How risky a change is by the nodes it reaches."""
    return F.when(impacted >= 5, F.lit("high")).when(impacted >= 2, F.lit("medium")).otherwise(F.lit("low"))


def within(since: Column, now: Column, seconds: float) -> Column:
    """Whether less than so long has passed; false without a time."""
    return F.coalesce((F.unix_millis(now) - F.unix_millis(since)) < seconds * 1000, F.lit(False))


def ordered_json(**fields: Column) -> Column:
    """JSON with its keys in order."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
