"""What imported names of Python, TypeScript and JavaScript files are, by a join of imports with the definitions of the files they name."""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ...ship import ship
from ..shared import written
from .declarations import Source, declared
from .rows import batches
from .signatures import infer, type_name

_DDL = "kind string, source_path string, module string, name string, alias string, type string"
_SCHEMA = pa.schema([(c, pa.string()) for c in ("kind", "source_path", "module", "name", "alias", "type")])


def _module(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").strip("/").replace("/", ".")


def symbols(path: str, text: str) -> Iterator[dict]:
    """Imports (module, name, alias) and definitions (module, name, type) of one file; none where it can't be read."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    here = _module(path)
    package = here if path.endswith("/__init__.py") else here.rpartition(".")[0]
    for n in tree.body:
        if isinstance(n, ast.ImportFrom):
            base = ".".join(package.split(".")[: len(package.split(".")) - n.level + 1]) if n.level else ""
            module = ".".join(x for x in (base, n.module) if x)
            for a in n.names:
                yield {"kind": "import", "module": module, "name": a.name, "alias": a.asname or a.name}
        elif isinstance(n, ast.ClassDef):
            yield {"kind": "definition", "module": here, "name": n.name, "type": n.name}
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield {"kind": "definition", "module": here, "name": n.name, "type": ast.unparse(n.returns) if n.returns else "unknown"}
        elif isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    yield {"kind": "definition", "module": here, "name": t.id, "type": infer(n.value)}


_SCRIPT = re.compile(r"\.(d\.ts|[cm]?[jt]sx?)$")


def _bound(s: Source, i: int) -> str:
    """Type of a value that begins at i: what is made new, a literal's kind, else unknown."""
    t = s.token(i)
    if t == "new" and s.named(i + 1):
        return s.token(i + 1)
    return "string" if t[:1] in ("'", '"', "`") else "number" if t[:1].isdigit() else "boolean" if t in ("true", "false") else "unknown"


def script_symbols(path: str, text: str) -> Iterator[dict]:
    """Imports and definitions of a TypeScript or JavaScript file; a module is its path without an ending, or its folder for an index."""
    s = Source(text, "typescript")
    here = _SCRIPT.sub("", path)
    homes = [here, here.removesuffix("/index")] if here.endswith("/index") else [here]
    defined = {d.name: type_name(d.result) if d.result else "unknown" for d in declared(s, "typescript") if d.owner is None}
    for i, t in enumerate(s.tokens):
        if t == "import" and s.token(i + 1) not in ("(", "."):
            end = s.until(i + 1, ("from", ";"))
            source = s.token(end + 1)
            if s.token(end) != "from" or source[:1] not in ("'", '"'):
                continue
            named = source[1:-1]
            module = posixpath.normpath(posixpath.join(posixpath.dirname(path), _SCRIPT.sub("", named))) if named.startswith(".") else named
            k = i + 1 + (s.token(i + 1) == "type" and s.token(i + 2) != "from")
            while k < end:
                if s.token(k) == "*" and s.token(k + 1) == "as":
                    yield {"kind": "import", "module": module, "name": "*", "alias": s.token(k + 2)}
                    k += 3
                elif s.token(k) == "{":
                    for spec in s.inside(k).split(","):
                        words = [w for w in spec.split() if w not in ("as", "type")]
                        if words:
                            yield {"kind": "import", "module": module, "name": words[0], "alias": words[-1]}
                    k = s.ends[k] + 1
                else:
                    if s.named(k):
                        yield {"kind": "import", "module": module, "name": "default", "alias": s.token(k)}
                    k += 1
        elif t == "class" and s.named(i + 1):
            defined[s.token(i + 1)] = s.token(i + 1)
        elif t in ("const", "let", "var") and s.named(i + 1) and s.token(i + 2) == "=":
            defined.setdefault(s.token(i + 1), _bound(s, i + 3))
        if t == "default" and s.token(i - 1) == "export":
            name = next((s.token(k) for k in range(i + 1, min(i + 5, s.n)) if s.named(k) and s.token(k) not in ("async", "abstract", "class", "function")), None)
            defined["default"] = name if s.token(i + 1) in ("class", "abstract") else defined.get(name or "", "unknown")
    for home in homes:
        yield {"kind": "definition", "module": home, "name": "*", "type": "module"}
        for name, kind in defined.items():
            yield {"kind": "definition", "module": home, "name": name, "type": kind}


def resolve(files: DataFrame) -> DataFrame:
    """(source_path, alias, module, name, defined_in, type) of every import; defined_in is null for what no file defines."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {"python": symbols}
        rows = ({"source_path": p, **r} for b in it for p, t, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for r in read.get(x, script_symbols)(p or "", t or ""))
        return batches(rows, _SCHEMA)

    ship(files.sparkSession)
    # written, as imports and definitions would each extract from all files again
    found = written(files.where("language in ('python', 'typescript', 'javascript')").select("path", "content", "language").mapInArrow(each, _DDL))
    asked = found.where("kind = 'import'").select("module", "name").distinct()
    defined = found.where("kind = 'definition'").join(asked, ["module", "name"], "left_semi").groupBy("module", "name").agg(F.max_by("type", "source_path").alias("_type"), F.max("source_path").alias("defined_in"))
    return found.where("kind = 'import'").drop("type", "kind").join(defined, ["module", "name"], "left").select("source_path", "alias", "module", "name", "defined_in", F.col("_type").alias("type"))
