"""Rows that extraction gives, and running extractors over files so that one that fails costs one diagnostic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ...ship import ship
from .called import Code

DDL = (
    "kind string, id string, type string, label string, source_path string, category string, framework string, metadata map<string,string>, src string, dst string, confidence double, "
    "ev_path string, ev_line int, ev_column int, ev_kind string, ev_text string, ev_confidence double, level string, code string, component string, message string, ord long"
)
_S = pa.string()
SCHEMA = pa.schema([
    ("kind", _S), ("id", _S), ("type", _S), ("label", _S), ("source_path", _S), ("category", _S), ("framework", _S), ("metadata", pa.map_(_S, _S)), ("src", _S), ("dst", _S), ("confidence", pa.float64()),
    ("ev_path", _S), ("ev_line", pa.int32()), ("ev_column", pa.int32()), ("ev_kind", _S), ("ev_text", _S), ("ev_confidence", pa.float64()), ("level", _S), ("code", _S), ("component", _S), ("message", _S), ("ord", pa.int64()),
])


def runtime_id(text: str) -> str:
    """As functions.scalars.runtime_id, for one text."""
    out = text.strip().replace("\\", "/")
    return re.sub(r"_+", "_", re.sub(r"[^\w./:{}-]+", "_", re.sub(r"\s+", "_", out), flags=re.ASCII))


def api_path(text: str) -> str:
    out = re.sub(r"\$\{[^}]+\}", ":param", (text or "").strip())
    out = re.split(r"[?#]", re.sub(r"(?i)^https?://[^/?#]*", "", out))[0]
    out = re.sub(r"/+", "/", "/" + out)
    return out[:-1] if len(out) > 1 and out.endswith("/") else out


def route_id(method: str, path: str) -> str:
    return runtime_id(f"ApiRoute.{method.upper()}.{api_path(path)}")


def pascal(text: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", text) if p)


def service_id(call: str) -> str:
    """Service that a call goes to."""
    if m := re.search(r"(?:self\.)?([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\(", call):
        owner = re.sub(r"(?i)service$", "", re.sub(r"(?i)_service$", "", m[1]))
        return runtime_id(f"Service.{pascal(owner)}Service.{m[2]}")
    m = re.search(r"\b([A-Za-z_]\w*)\s*\(", call)
    return runtime_id(f"Service.{m[1] if m else call.strip()}")


@lru_cache(maxsize=1)
def _code(content: str, language: str) -> Code:
    """The last file's tokens; all extractors of a file ask for them one after the other."""
    return Code(content, language)


class Finder:
    """Collects the rows of one file; `code` has its tokens, read when they are first asked for."""

    def __init__(self, path: str, language: str, content: str) -> None:
        self.path, self.language, self.content = path, language, content
        self.out: list[dict] = []

    @property
    def code(self) -> Code:
        return _code(self.content, self.language)

    def _evidence(self, kind: str, text: str, at: int, confidence: float) -> dict:
        before = re.split(r"\r?\n", self.content[: max(0, at)])
        return {"ev_path": self.path, "ev_line": len(before), "ev_column": len(before[-1]) + 1, "ev_kind": kind, "ev_text": text.strip()[:240], "ev_confidence": confidence}

    def node(self, id_: str, type_: str, label: str, kind: str, text: str, at: int, confidence: float, category: str | None = None, framework: str | None = None, metadata: dict | None = None, path: bool = True) -> str:
        self.out.append({"kind": "node", "id": id_, "type": type_, "label": label, "source_path": self.path if path else None, "category": category, "framework": framework, "metadata": {k: str(v) for k, v in (metadata or {}).items()}, **self._evidence(kind, text, at, confidence)})
        return id_

    def edge(self, src: str, dst: str, type_: str, confidence: float, kind: str, text: str, at: int, metadata: dict | None = None) -> None:
        self.out.append({"kind": "edge", "src": src, "dst": dst, "type": type_, "confidence": confidence, "metadata": {k: str(v) for k, v in (metadata or {}).items()}, **self._evidence(kind, text, at, confidence)})

    def diag(self, level: str, code: str, component: str, message: str) -> None:
        self.out.append({"kind": "diag", "level": level, "code": code, "component": component, "message": message, "source_path": self.path})

    def other(self, kind: str, **values) -> None:
        self.out.append({"kind": kind, "source_path": self.path, **values})


Extractor = Callable[[Finder], None]


def batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to `most` rows of any number of files; a batch a file costs more than extraction itself."""
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) for f in schema], schema=schema)


def run(files: DataFrame, extractors: list[tuple[str, Extractor]]) -> DataFrame:
    """Rows of all extractors over (path, language, content), in order; a failure gives RUNTIME_EXTRACTOR_FAILED and no more.

    One pass over the files; rows leave in batches, so no more than one file's and one batch's are held.
    """

    def found_in(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in it:
            for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got: list[dict] = []
                for name, f in extractors:
                    find = Finder(path or "", language or "", content or "")
                    try:
                        f(find)
                    except Exception as e:  # noqa: BLE001  a plug-in may fail in any way
                        find.out = []
                        find.diag("error", "RUNTIME_EXTRACTOR_FAILED", name, str(e))
                    got += find.out
                for i, r in enumerate(got):
                    yield {"ord": i, **r, "metadata": list((r.get("metadata") or {}).items())}

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(found_in(it), SCHEMA)

    ship(files.sparkSession)
    found = files.select("path", "language", "content").mapInArrow(each, DDL)
    return found


def place(late: bool = False) -> Column:
    """Order of an extracted row over all files: by path, then place in the file; late ones come after all others."""
    return F.concat(F.lit("\U0010ffff" if late else ""), F.coalesce("ev_path", "source_path", F.lit("")), F.lit("\0"), F.lpad(F.col("ord").cast("string"), 10, "0"))


def split(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RT_NODE, RT_EDGE and DIAG rows of extraction; `ord` is a text of path and place, so order needs no numbering of files."""
    ev = F.array(F.struct(F.col("ev_path").alias("source_path"), F.col("ev_line").alias("line"), F.col("ev_column").alias("column"), F.col("ev_kind").alias("kind"), F.col("ev_text").alias("text"), F.col("ev_confidence").alias("confidence")))
    rows = found.withColumn("ord", place())
    nodes = rows.where("kind = 'node'").select("id", "type", "label", "source_path", "category", "framework", "metadata", ev.alias("evidence"), "ord")
    edges = rows.where("kind = 'edge'").select(F.lit(None).cast("string").alias("id"), "src", "dst", "type", "label", "metadata", "confidence", ev.alias("evidence"), "ord")
    diags = rows.where("kind = 'diag'").select("level", "code", "component", "message", "source_path", F.lit(None).cast("string").alias("node_id"))
    return nodes, edges, diags
