"""Declarations of C-like languages, read as tokens: what brackets hold together stays together, whatever it says inside.

A file becomes a list of tokens without comments. Each language has a head that knows its declarations at file level and in
the bodies of its types; parameter lists, types and bodies are skipped by matching brackets, so callback types, nested
generics, default values and declarations of several lines come out whole. Bodies of functions are not looked into.

A declaration is (owner or None, name, parameters, result or None, exported).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_COMMENT = r"//[^\n]*|/\*.*?\*/"
_TEXT = r'"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`'
_QUOTED = r"'(?:\\.|[^'\\\n])*'"
_REST = r"[A-Za-z_$][\w$]*|\d[\w.]*|->|=>|::|\.\.\.|\S"
_LEXERS = {
    "rust": re.compile(rf"(?P<no>{_COMMENT})|{_TEXT}|'[A-Za-z_]\w*(?!')|{_QUOTED}|{_REST}", re.S),
    "cpp": re.compile(rf"(?P<no>{_COMMENT}|^[ \t]*#(?:\\\n|[^\n])*)|{_TEXT}|{_QUOTED}|{_REST}", re.S | re.M),
    "python": re.compile(rf"""(?P<no>\#[^\n]*)|\"{{3}}(?:\\.|[^\\])*?\"{{3}}|'{{3}}(?:\\.|[^\\])*?'{{3}}|{_TEXT}|{_QUOTED}|{_REST}""", re.S),
    "": re.compile(rf"(?P<no>{_COMMENT})|{_TEXT}|{_QUOTED}|{_REST}", re.S),
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
#: Words that look like the name of something called, but open a statement.
STATEMENTS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "else", "new", "throw", "do", "try", "sizeof", "await", "super"}


class Declared(NamedTuple):
    owner: str | None
    name: str
    parameters: str
    result: str | None
    exported: bool
    #: Tokens of the body, where it is looked at.
    body: tuple[int, int] | None = None


class Source:
    """The tokens of a text, with the place of each and of the bracket that closes it."""

    def __init__(self, text: str, language: str) -> None:
        self.text = text
        found = [m for m in _LEXERS.get(language, _LEXERS[""]).finditer(text) if m.lastgroup != "no"]
        self.tokens = [m[0] for m in found]
        self.at = [m.span() for m in found]
        self.n = len(found)
        self.ends = [self.n - 1 if t in _PAIRS else i for i, t in enumerate(self.tokens)]  # what never closes runs to the end
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t in _PAIRS:
                open_.append(i)
            elif t in (")", "]", "}"):
                while open_ and _PAIRS[self.tokens[open_[-1]]] != t:
                    open_.pop()
                if open_:
                    self.ends[open_.pop()] = i

    def token(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < self.n else ""

    def named(self, i: int) -> bool:
        return bool(_NAME.match(self.token(i)))

    def said(self, start: int, end: int) -> str:
        """The text of tokens start to end - 1, as written."""
        return self.text[self.at[start][0] : self.at[end - 1][1]] if start < end <= self.n else ""

    def inside(self, i: int) -> str:
        """What the brackets that open at i hold."""
        return self.said(i + 1, self.ends[i])

    def angle(self, i: int) -> int:
        """After the generics that open at i; i itself where there are none."""
        if self.token(i) != "<":
            return i
        depth, k = 0, i
        while k < self.n:
            t = self.tokens[k]
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return k + 1
            if t in (";", "}"):
                return i
            k = self.ends[k] + 1
        return i

    def until(self, i: int, stops: tuple[str, ...], end: int | None = None) -> int:
        """The next of some tokens outside of brackets."""
        end = self.n if end is None else end
        while i < end and self.tokens[i] not in stops:
            i = self.ends[i] + 1
        return min(i, end)


def _head_end(s: Source, i: int, stops: tuple[str, ...], end: int | None = None) -> int:
    """The next of some tokens outside of brackets and generics."""
    end = s.n if end is None else end
    while i < end and s.token(i) not in stops:
        i = max(s.angle(i), i + 1) if s.token(i) == "<" else s.ends[i] + 1
    return min(i, end)


def _script_type(s: Source, i: int) -> int:
    """After a type annotation that begins at i."""
    while i < s.n:
        t = s.token(i)
        if t in ("|", "&", "keyof", "typeof", "readonly", "asserts", "infer", "unique", "new"):
            i += 1
            continue
        if t == "<" and s.angle(i) > i:
            i = s.angle(i)
            continue
        if t in ("{", "["):
            i = s.ends[i] + 1
        elif t == "(":
            i = s.ends[i] + 1
            if s.token(i) == "=>":
                i += 1
                continue
        elif s.named(i) or t[:1] in "\"'`0123456789":
            i += 1
            while s.token(i) == "." and s.named(i + 1):
                i += 2
            i = s.angle(i)
        else:
            return i
        while s.token(i) == "[":
            i = s.ends[i] + 1
        if s.token(i) in ("|", "&", "is"):
            i += 1
            continue
        return i
    return i


def _script_signature(s: Source, i: int) -> tuple[str, str | None, int] | None:
    """(parameters, result, where it ends) of a parameter list that begins at i, after generics."""
    i = s.angle(i)
    if s.token(i) != "(":
        return None
    end = s.ends[i] + 1
    if s.token(end) != ":":
        return s.inside(i), None, end
    stop = _script_type(s, end + 1)
    return s.inside(i), s.said(end + 1, stop), stop


def _script_class(s: Source, i: int, end: int, owner: str, exported: bool) -> Iterator[Declared]:
    while i < end:
        t = s.token(i)
        if t == "@":  # a decorator
            i += 2
            while s.token(i) == "." and s.named(i + 1):
                i += 2
            i = s.ends[i] + 1 if s.token(i) == "(" else i
            continue
        if s.named(i) and s.token(i + 1) in ("(", "<", "?"):
            after = i + 1 + (s.token(i + 1) == "?")
            found = _script_signature(s, after)
            if found and s.token(found[2]) == "{":
                if t not in STATEMENTS:
                    yield Declared(owner, t, found[0], found[1], exported, (found[2] + 1, s.ends[found[2]]))
                i = s.ends[found[2]] + 1
                continue
        if t == "=":  # a field: its value may hold anything
            i = _value_end(s, i + 1, end)
            continue
        if t == ":":
            i = max(_script_type(s, i + 1), i + 1)
            continue
        i = s.ends[i] + 1


def _value_end(s: Source, i: int, end: int) -> int:
    """After a field's value: past its semicolon, or at the member that begins the next line."""
    first = i
    while i < end:
        t = s.token(i)
        if t == ";":
            return i + 1
        if i > first and "\n" in s.text[s.at[i - 1][1] : s.at[i][0]] and (s.named(i) or t in ("@", "#", "*", "[")) and not (s.token(i - 1) in _OPERATORS):
            return i
        i = s.ends[i] + 1
    return end


_OPERATORS = {"=", "+", "-", "*", "/", "%", "&", "|", "?", ":", ",", ".", "<", ">", "!", "=>", "await", "new", "typeof"}


def script(s: Source) -> Iterator[Declared]:
    i, exported = 0, False
    while i < s.n:
        t = s.token(i)
        if t == "export":
            exported = True
            i += 1 + (s.token(i + 1) == "default")
            continue
        if t == "class" and s.named(i + 1):
            body = _head_end(s, i + 2, ("{",))
            yield from _script_class(s, body + 1, s.ends[body] if body < s.n else s.n, s.token(i + 1), exported)
            i = s.ends[body] + 1 if body < s.n else s.n
        elif t == "function":
            at = i + 1 + (s.token(i + 1) == "*")
            found = _script_signature(s, at + 1) if s.named(at) else None
            if found:
                has = s.token(found[2]) == "{"
                yield Declared(None, s.token(at), found[0], found[1], exported, (found[2] + 1, s.ends[found[2]]) if has else None)
                i = s.ends[found[2]] + 1 if has else found[2]
            else:
                i += 1
        elif t in ("const", "let", "var") and s.named(i + 1):
            name, at = s.token(i + 1), i + 2
            if s.token(at) == ":":
                at = _script_type(s, at + 1)
            if s.token(at) == "=":
                at += 1 + (s.token(at + 1) == "async")
                found = _script_signature(s, at)
                if s.token(at) == "function":
                    found = _script_signature(s, at + 1 + s.named(at + 1))
                    found = found if found and s.token(found[2]) == "{" else None
                elif found and s.token(found[2]) != "=>":
                    found = None
                elif not found and s.named(at) and s.token(at + 1) == "=>":
                    found = (s.token(at), None, at + 1)
                if found:
                    at = found[2] + (s.token(found[2]) == "=>")
                    stop = s.ends[at] if s.token(at) == "{" else _value_end(s, at, s.n)
                    yield Declared(None, name, found[0], found[1], exported, (at, stop))
                at = s.ends[at] + 1 if s.token(at) == "{" else at
            i = max(at, i + 2)
        elif t in ("async", "abstract", "declare", "default"):
            i += 1
            continue
        else:
            i = s.ends[i] + 1
        exported = False


_JAVA_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed"}


def java(s: Source, i: int = 0, end: int | None = None, owner: str | None = None) -> Iterator[Declared]:
    """Methods with a body, of each class by the class they stand in."""
    end = s.n if end is None else end
    start = i  # of the member
    while i < end:
        t = s.token(i)
        if t == "@" and s.token(i + 1) != "interface":
            i += 2
            while s.token(i) == "." and s.named(i + 1):
                i += 2
            i = s.ends[i] + 1 if s.token(i) == "(" else i
            start = i
        elif t in _JAVA_MODIFIERS:
            i += 1
            start = i
        elif t in ("class", "interface", "enum", "record") and s.named(i + 1):
            body = _head_end(s, i + 2, ("{",), end)
            if body < end:
                yield from java(s, body + 1, s.ends[body], s.token(i + 1))
                i = s.ends[body] + 1
            else:
                i = end
            start = i
        elif t == "(":
            close, name = s.ends[i], s.token(i - 1)
            after = s.until(close + 1, ("{", ";"), end)
            kind = s.angle(start)  # generics of the method itself
            if owner and s.token(after) == "{" and s.named(i - 1) and kind < i - 1 and name not in STATEMENTS:
                yield Declared(owner, name, s.inside(i), s.said(kind, i - 1), False)
            i = s.ends[after] + 1 if after < end and s.token(after) == "{" else after + 1
            start = i
        elif t in (";", "{", "="):
            i = s.ends[i] + 1 if t != "=" else s.until(i, (";",), end) + 1
            start = i
        elif t == "<":
            i = max(s.angle(i), i + 1)
        else:
            i = s.ends[i] + 1


def go(s: Source) -> Iterator[Declared]:
    i = 0
    while i < s.n:
        if s.token(i) != "func":
            i = s.ends[i] + 1
            continue
        owner, at = None, i + 1
        if s.token(at) == "(" and s.named(s.ends[at] + 1):
            names = [k for k in range(at + 1, s.ends[at]) if s.named(k)]
            generic = next((k for k in range(at + 1, s.ends[at]) if s.token(k) == "["), s.ends[at])
            owner = next((s.token(k) for k in reversed(names) if k < generic), None)
            at = s.ends[at] + 1
        if not s.named(at):
            i += 1
            continue
        name, at = s.token(at), at + 1
        at = s.ends[at] + 1 if s.token(at) == "[" else at
        if s.token(at) != "(":
            i = at
            continue
        result = stop = s.ends[at] + 1
        while stop < s.n and s.token(stop) != "{" and "\n" not in s.text[s.at[stop - 1][1] : s.at[stop][0]]:
            stop = s.ends[stop + 1] + 1 if s.token(stop) in ("interface", "struct") and s.token(stop + 1) == "{" else s.ends[stop] + 1
        said = s.inside(result) if s.token(result) == "(" and s.ends[result] + 1 == stop else s.said(result, stop)
        yield Declared(owner, name, s.inside(at), said or None, name[:1].isupper())
        i = s.ends[stop] + 1 if s.token(stop) == "{" else stop


def _rust_owner(s: Source, i: int, end: int) -> str | None:
    """The first plain type that an impl head names: its trait, or the type itself where the trait is generic."""
    depth = 0
    for k in range(i, end):
        t = s.token(k)
        depth += (t == "<") - (t == ">")
        if depth == 0 and s.named(k) and t not in ("for", "dyn", "where", "unsafe") and s.token(k + 1) not in ("<", "::") and s.token(k - 1) != "::":
            return t
    return None


def rust(s: Source, i: int = 0, end: int | None = None, owner: str | None = None) -> Iterator[Declared]:
    end, shown = s.n if end is None else end, False
    while i < end:
        t = s.token(i)
        if t == "pub":
            shown, i = True, s.ends[i + 1] + 1 if s.token(i + 1) == "(" else i + 1
            continue
        if t in ("async", "const", "unsafe", "extern", "default") and s.token(i + 1) in ("fn", "async", "unsafe", "extern") or t[:1] == '"':
            i += 1
            continue
        if t == "impl" and owner is None:
            body = s.until(i, ("{",), end)
            who = _rust_owner(s, s.angle(i + 1), body)
            if who and body < end:
                yield from rust(s, body + 1, s.ends[body], who)
            i = s.ends[body] + 1 if body < end else end
        elif t == "fn" and s.named(i + 1):
            at = s.angle(i + 2)
            if s.token(at) != "(":
                i += 2
                continue
            close = s.ends[at] + 1
            stop = s.until(close, ("{", ";", "where"), end)
            yield Declared(owner, s.token(i + 1), s.inside(at), s.said(close + 1, stop) if s.token(close) == "->" else None, shown)
            stop = s.until(stop, ("{", ";"), end)
            i = s.ends[stop] + 1 if stop < end else end
        elif t == "#" and s.token(i + 1) == "[":
            i = s.ends[i + 1] + 1
            continue
        else:
            i = s.ends[i] + 1
        shown = False


_CPP_HEADS = {"inline", "static", "virtual", "explicit", "constexpr", "extern", "friend", "consteval", "public", "private", "protected", ":", "mutable"}


def cpp(s: Source, i: int = 0, end: int | None = None, owner: str | None = None) -> Iterator[Declared]:
    """Functions that are declared or defined, by the class they stand in or that their name is scoped by."""
    end = s.n if end is None else end
    start = i
    while i < end:
        t = s.token(i)
        if t == "template" and s.token(i + 1) == "<":
            i = start = max(s.angle(i + 1), i + 2)
        elif t in _CPP_HEADS and start == i:
            i = start = i + 1
        elif t == "namespace" or t == "extern" and s.token(i + 1)[:1] == '"':
            body = s.until(i, ("{", ";"), end)
            if s.token(body) == "{" and body < end:
                yield from cpp(s, body + 1, s.ends[body], owner)
            i = start = s.ends[body] + 1 if body < end else end
        elif t in ("class", "struct", "union") and start == i and s.named(i + 1):
            body = _head_end(s, i, ("{", ";", "("), end)
            if s.token(body) == "{" and body < end:
                yield from cpp(s, body + 1, s.ends[body], s.token(i + 1))
                i = start = s.until(s.ends[body] + 1, (";",), end) + 1
            else:
                i = body if s.token(body) == "(" else body + 1
                start = start if s.token(body) == "(" else i
        elif t == "enum":
            i = start = s.until(i, (";",), end) + 1
        elif t == "(":
            close = s.ends[i]
            after = s.until(close + 1, ("{", ";", "=", ":"), end)
            name, scope = i - 1, None
            if s.token(name - 1) == "::" and s.named(name - 2):
                scope, head = s.token(name - 2), name - 2
            else:
                head = name
            tilde = s.token(head - 1) == "~"
            own = scope or owner
            if s.named(name) and start < head and not tilde and s.token(name) not in STATEMENTS and s.token(name) != own and s.token(start) not in ("return", "else", "new", "using", "typedef"):
                arrow = next((k for k in range(close + 1, after) if s.token(k) == "->"), None)
                yield Declared(own, s.token(name), s.inside(i), s.said(arrow + 1, after) if arrow else s.said(start, head), False)
            if s.token(after) == ":" and after < end:  # a constructor's list of members
                after = s.until(after, ("{", ";"), end)
                while s.token(after) == "{" and s.named(after - 1) and s.token(s.ends[after] + 1) in (",", "{"):
                    after = s.until(s.ends[after] + 1, ("{", ";"), end)
            if s.token(after) == "=":
                after = s.until(after, (";",), end)
            i = start = s.ends[after] + 1 if after < end else end
        elif t == "{" or t == ";":
            i = start = s.ends[i] + 1
        elif t == "=":
            i = start = s.until(i, (";",), end) + 1
        elif t == "<":
            i = max(s.angle(i), i + 1)
        else:
            i = s.ends[i] + 1


HEADS = {"typescript": script, "javascript": script, "java": java, "go": go, "rust": rust, "cpp": cpp}


def declared(text: str | Source, language: str) -> Iterator[Declared]:
    return HEADS[language](text if isinstance(text, Source) else Source(text, language))
