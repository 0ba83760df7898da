"""Calls, decorators and owners of a source file, from its token list with matched brackets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from .declarations import Source


class Call(NamedTuple):
    """A call a.b.name(...): the tokens of its names, of its opening bracket and of the closing one."""

    names: tuple[int, ...]
    open: int
    close: int
    #: Token of the @ before it, or of `new`; -1 without.
    mark: int


class Code(Source):
    """A file's tokens with its calls, and the functions and classes that own places in it."""

    def __init__(self, text: str, language: str) -> None:
        super().__init__(text, language)
        self.calls = [self._call(i) for i, t in enumerate(self.tokens) if t == "(" and self.named(i - 1)]
        self._functions: tuple[list[int], list[tuple[int, int, int]]] | None = None

    def _names(self, last: int) -> tuple[int, ...]:
        names = [last]
        while self.token(names[0] - 1) == "." and self.named(names[0] - 2):
            names.insert(0, names[0] - 2)
        return tuple(names)

    def _call(self, i: int) -> Call:
        names = self._names(i - 1)
        return Call(names, i, self.ends[i], names[0] - 1 if self.token(names[0] - 1) in ("@", "new") else -1)

    def name(self, call: Call, k: int = -1) -> str:
        """The k-th of a call's names, empty where it has fewer."""
        return self.tokens[call.names[k]] if -len(call.names) <= k else ""

    def start(self, i: int) -> int:
        return self.at[i][0]

    def literal(self, i: int) -> str | None:
        """What a token of text says; None for other tokens."""
        t = self.token(i)
        if len(t) < 2 or t[0] not in "\"'`" or t[-1] != t[0]:
            return None
        return t[3:-3] if len(t) >= 6 and t[:3] == t[0] * 3 else t[1:-1]

    def literals(self, start: int, end: int) -> Iterator[str]:
        return (x for i in range(start, end) if (x := self.literal(i)) is not None)

    def argument(self, call: Call, k: int = 0) -> tuple[int, int]:
        """First and next token of the k-th argument; an empty range where there is none."""
        at = call.open + 1
        for _ in range(k):
            at = min(self.until(at, (",",), call.close) + 1, call.close)
        return at, self.until(at, (",",), call.close)

    def option(self, start: int, end: int, names: tuple[str, ...], sign: str) -> int | None:
        """The token after `name sign` of the first of some names between two tokens."""
        return next((i + 2 for i in range(start, end - 2) if self.tokens[i].lower() in names and self.tokens[i + 1] == sign), None)

    def opens_line(self, i: int) -> bool:
        """Whether only white space stands before a token on its line, and a line before that."""
        before = self.text.rfind("\n", 0, self.start(i))
        return before >= 0 and not self.text[before : self.start(i)].strip()

    def decorated(self, end: int, words: tuple[str, ...]) -> int | None:
        """The name of what a decorator that ends with token `end` stands on: after `async` and one of some words, if any."""
        i = end + 1
        if i >= self.n or "\n" not in self.text[self.at[end][1] : self.start(i)]:
            return None
        i += self.token(i) == "async"
        if words:
            if self.token(i) not in words:
                return None
            i += 1
        return i if self.named(i) and self.token(i + 1) == "(" else None

    def _owners(self) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Functions by the place where their head ends: (first token, name, end); built once a file."""
        if self._functions is None:
            heads = []
            for i in range(self.n - 1):
                if not self.named(i) or self.tokens[i + 1] != "(":
                    continue
                close = self.ends[i + 1]
                if self.token(i - 1) in ("def", "function"):
                    first = i - 2 if self.token(i - 1) == "def" and self.token(i - 2) == "async" else i - 1
                    heads.append((self.at[i + 1][1], (first, i, i + 2)))
                elif self.token(close + 1) == "{" and "(" not in self.tokens[i + 2 : close]:
                    heads.append((self.at[close + 1][1], (i - (self.token(i - 1) == "async"), i, close + 2)))
            heads.sort()
            self._functions = [e for e, _ in heads], [h for _, h in heads]
        return self._functions

    def owner(self, place: int) -> tuple[str, str, int] | None:
        """(name, head as written, its place) of the last function whose head ends before a place, else of the last class."""
        ends, heads = self._owners()
        k = bisect_right(ends, place)
        if k:
            first, name, end = heads[k - 1]
            return self.tokens[name], self.said(first, end), self.start(first)
        classes = [i for i in range(self.n - 1) if self.tokens[i] == "class" and self.named(i + 1) and self.at[i + 1][1] <= place]
        return (self.tokens[classes[-1] + 1], self.said(classes[-1], classes[-1] + 2), self.start(classes[-1])) if classes else None
