"""References of TypeScript and JavaScript functions beyond their own names, and the types those show, from tokens.

A reference is an attribute of `this` or a name bound at file level (imports, values). Modes join: what is read and written is
ReadWrite. Names that nothing at file level binds drop; attributes without a type are `unknown`; calls of own methods are no
references.
"""

from __future__ import annotations

from .declarations import Declared, Source, _script_type
from .imports import _bound

_ACCESS = {"public", "private", "protected", "readonly", "override"}


def file_names(s: Source) -> dict[str, str]:
    """Names bound at file level: imports as themselves or module, values by what they show."""
    out: dict[str, str] = {}
    i = 0
    while i < s.n:
        t = s.token(i)
        if t == "import":
            end = s.until(i + 1, ("from", ";"))
            if s.token(end) == "from":
                for k in range(i + 1, end):
                    if s.named(k) and s.token(k) not in ("type", "as") and s.token(k + 1) != "as":
                        name = s.token(k)
                        out[name] = name if name[:1].isupper() else "module"
                i = end + 2
                continue
        if t in ("const", "let", "var") and s.named(i + 1):
            if s.token(i + 2) == ":":
                out[s.token(i + 1)] = " ".join(s.said(i + 3, _script_type(s, i + 3)).split())
            elif s.token(i + 2) == "=" and s.token(i + 3) not in ("async", "function", "(", "<") and s.token(i + 4) != "=>":
                out[s.token(i + 1)] = _bound(s, i + 3)
        i = s.ends[i] + 1
    return out


def attributes(s: Source, owner: str) -> dict[str, str]:
    """Types of a class's attributes: of its fields, and of constructor parameters that are fields."""
    out: dict[str, str] = {}
    at = next((i for i in range(s.n - 1) if s.token(i) == "class" and s.token(i + 1) == owner), None)
    if at is None:
        return out
    i = at + 2
    while i < s.n and s.token(i) != "{":
        i = max(s.angle(i), i + 1) if s.token(i) == "<" else s.ends[i] + 1
    end, i = (s.ends[i], i + 1) if i < s.n else (s.n, s.n)
    while i < end:
        name = s.token(i)
        after = i + 1 + (s.token(i + 1) in ("?", "!"))
        if name == "constructor" and s.token(i + 1) == "(":
            k = i + 2
            while k < s.ends[i + 1]:
                if s.token(k) in _ACCESS:
                    while s.token(k) in _ACCESS:
                        k += 1
                    colon = k + 1 + (s.token(k + 1) == "?")
                    out[s.token(k)] = " ".join(s.said(colon + 1, _script_type(s, colon + 1)).split()) if s.token(colon) == ":" else "unknown"
                k = s.until(k, (",",), s.ends[i + 1]) + 1
            i = s.ends[i + 1] + 1
        elif s.named(i) and s.token(after) == ":" and name not in _ACCESS:
            stop = _script_type(s, after + 1)
            out[name] = " ".join(s.said(after + 1, stop).split())
            i = max(stop, i + 1)
        elif s.named(i) and s.token(after) == "=" and name not in _ACCESS and s.token(i - 1) not in (".", "="):
            out.setdefault(name, _bound(s, after + 1))
            i = after + 1
        else:
            i = s.ends[i] + 1
    return out


def _adjacent(s: Source, i: int) -> bool:
    """Whether token i and the next one stand together."""
    return i + 1 < s.n and s.at[i][1] == s.at[i + 1][0]


def _mode(s: Source, first: int, last: int) -> set[str]:
    """How tokens first to last are used: by what comes after them, or a ++ or -- before."""
    t, u = s.token(last + 1), s.token(last + 2)
    if t in ("+", "-") and u == t and _adjacent(s, last + 1) or s.token(first - 1) in ("+", "-") and s.token(first - 2) == s.token(first - 1) and _adjacent(s, first - 2):
        return {"Read", "Write"}
    k = last + 1
    while s.token(k) in ("+", "-", "*", "/", "%", "&", "|", "^", "?", "<", ">") and _adjacent(s, k):
        k += 1
    if s.token(k) == "=" and not (s.token(k + 1) == "=" and _adjacent(s, k)) and not (k == last + 2 and s.token(last + 1) in ("<", ">")):
        return {"Write"} if k == last + 1 else {"Read", "Write"}
    return {"Read"}


def _bound_by(s: Source) -> set[str]:
    """The names that a parameter list binds."""
    out: set[str] = set()
    i = 0
    while i < s.n:
        t = s.token(i)
        if t in ("{", "["):
            out |= {s.token(k) for k in range(i + 1, s.ends[i]) if s.named(k) and s.token(k + 1) != ":"}
            i = s.ends[i] + 1
        elif t == ":":
            i = max(_script_type(s, i + 1), i + 1)
        elif t == "=":
            i = s.until(i, (",",))
        else:
            if s.named(i) and t not in _ACCESS:
                out.add(t)
            i += 1
    return out


def references(s: Source, found: Declared, scope: dict[str, str], own: dict[str, str]) -> list[tuple[str, str, str]]:
    """(label, type, mode) of what a declared function reads and writes beyond its own names, by label."""
    if not found.body:
        return []
    start, end = found.body
    local = _bound_by(Source(found.parameters, "typescript"))
    for i in range(start, end):
        t = s.token(i)
        if t in ("const", "let", "var", "function", "class"):
            if s.named(i + 1):
                local.add(s.token(i + 1))
            elif s.token(i + 1) in ("{", "["):
                local |= {s.token(k) for k in range(i + 2, s.ends[i + 1]) if s.named(k) and s.token(k + 1) != ":"}
        elif t == "=>" and s.named(i - 1):
            local.add(s.token(i - 1))
        elif t == "(" and (s.token(s.ends[i] + 1) == "=>" or s.token(i - 1) == "catch" or s.token(i - 2) == "function"):
            local |= {s.token(k) for k in range(i + 1, s.ends[i]) if s.named(k) and s.token(k - 1) in ("(", ",", "{", "[", "...")}
    seen: dict[str, tuple[str, set[str]]] = {}
    for i in range(start, end):
        t = s.token(i)
        if t == "this" and s.token(i + 1) == "." and s.named(i + 2):
            name = s.token(i + 2)
            if s.token(i + 3) == "(" and name not in own:
                continue
            label, kind, modes = f"this.{name}", own.get(name, "unknown"), _mode(s, i, i + 2)
        elif t in scope and t not in local and s.token(i - 1) != "." and not (s.token(i + 1) == ":" and s.token(i - 1) in ("{", ",")):
            label, kind, modes = t, scope[t], _mode(s, i, i)
        else:
            continue
        seen.setdefault(label, (kind, set()))[1].update(modes)
    return [(label, kind, "ReadWrite" if len(m) == 2 else next(iter(m))) for label, (kind, m) in sorted(seen.items())]
