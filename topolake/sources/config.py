"""Configuration: defaults, partial files merged over them, and what each falls back to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from ..functions.contracts import IGNORED_TYPES

# Default patterns, names and limits.
EXCLUDE_PATHS = ["tests", "test", "schema", "schemas", "model", "models", "entity", "entities", "dto", "vo", "types", "types.py", "migrations", "alembic/versions", "__pycache__", "node_modules", "venv", ".venv", ".next", "dist", "build"]
ENTRY_METHODS = ["execute", "run", "handle", "process", "dispatch", "apply", "invoke", "plan", "schedule", "orchestrate"]
NOISE_NAMES = ["^(__.*__|_(?!_).*)$", "^(test_.+)$", "^__.*__$", "^(upgrade|downgrade)$"]
RUNTIME_EXCLUDES = ["node_modules", ".git", "venv", ".venv", "__pycache__", ".pytest_cache", ".next", "dist", "build", "tests", "test", "logs", "uploads", "fastgpt_data", ".run_state", "tmp"]
TRIGGERS = ["init", "sync", "runtime", "plan", "apply", "verify", "govern", "trend"]


@dataclass
class Parser:
    exclude_paths: list[str] = field(default_factory=lambda: list(EXCLUDE_PATHS))
    scan_categories: list[str] = field(default_factory=lambda: ["core"])
    scan_mode: str = "capability"
    capability_threshold: int = 4
    exclude_test_files: bool = True
    exclude_magic_methods: bool = True
    exclude_private_methods: bool = True
    helper_verb_policy: str = "suppress"
    fold_helpers: bool = True
    entry_methods: list[str] = field(default_factory=lambda: list(ENTRY_METHODS))
    noise_names: list[str] = field(default_factory=lambda: list(NOISE_NAMES))
    ignore_generic: bool = True
    ignored_types: list[str] = field(default_factory=lambda: list(IGNORED_TYPES))


@dataclass
class Runtime:
    include_frontend: bool = True
    include_infra: bool = True
    exclude_paths: list[str] = field(default_factory=lambda: list(RUNTIME_EXCLUDES))
    max_file_bytes: int = 500_000
    max_files: int = 5_000
    fail_on_extractor_error: bool = False


@dataclass
class AutoRun:
    enabled: bool = True
    auto_trigger: bool = True
    triggers: list[str] = field(default_factory=lambda: list(TRIGGERS))
    min_events: int = 5
    min_hours: float = 24
    throttle_minutes: float = 10
    min_confidence: float = 0.55
    max_proposals: int = 5
    interval_seconds: int = 180


@dataclass
class Config:
    language: str = "typescript"
    categories: dict[str, list[str]] = field(default_factory=lambda: {"core": []})
    parser: Parser = field(default_factory=Parser)
    runtime: Runtime = field(default_factory=Runtime)
    auto_run: AutoRun = field(default_factory=AutoRun)
    scan_scopes: list[dict] = field(default_factory=list)
    coverage_gates: list[dict] = field(default_factory=list)


_CHOICES = {("parser", "scan_mode"): {"leaf", "capability", "module", "domain"}, ("parser", "helper_verb_policy"): {"suppress", "allow"}}


def merged(given: dict[str, Any] | None) -> Config:
    """A partial configuration over the defaults; values of another type or outside a choice fall back to the default."""
    out = Config()
    for f in fields(Config):
        value, default = (given or {}).get(f.name), getattr(out, f.name)
        if f.name in ("parser", "runtime", "auto_run"):
            for g in fields(type(default)):
                v, d = (value or {}).get(g.name) if isinstance(value, dict) else None, getattr(default, g.name)
                numbers = isinstance(d, (int, float)) and not isinstance(d, bool) and isinstance(v, (int, float)) and not isinstance(v, bool)
                if (numbers and v >= 0) or (not numbers and isinstance(v, type(d)) and v in _CHOICES.get((f.name, g.name), {v} if not isinstance(v, list) else [v])):
                    setattr(default, g.name, v)
        elif isinstance(value, type(default)):
            setattr(out, f.name, value)
    return out


def load(path: str | Path) -> Config:
    """A JSON file's configuration; the defaults where the file is missing or not an object."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except (OSError, ValueError):
        given = None
    return merged(given if isinstance(given, dict) else None)


def as_dict(config: Config) -> dict:
    return asdict(config)
