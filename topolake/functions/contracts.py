"""Keys that make a produced and a required contract comparable: five rules, each for the operators that name it.

All are expressions over a string column and give null where the entry stands for no contract.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Entries that mean "nothing", and types too general to tie two nodes together.
NONE_TOKENS = ["", "none", "void", "null", "undefined"]
ATOMIC_TYPES = [
    "str", "string", "std::string", "int", "integer", "short", "byte", "long", "usize", "isize", "u8", "u16", "u32", "u64", "u128",
    "i8", "i16", "i32", "i64", "i128", "double", "float", "number", "bool", "boolean", "bigint", "symbol", "dict", "list", "vec",
    "set", "tuple", "any", "unknown", "object", "json", "request", "response", "path",
]
IGNORED_TYPES = [
    "str", "string", "int", "number", "bool", "boolean", "float", "dict", "object", "list", "array", "any", "unknown", "json",
    "request", "response", "path", "void", "none", "dict[str,any]", "optional[str]", "optional[int]", "list[str]", "list[any]",
]
GHOST_PREFIX = r"(?i)^\[ghost"
GHOST_DEMAND = r"(?i)^\[Ghost:[^\]]+\]"
SIGNATURE = r"^(.*?)\s*\(([^()]+)\)\s*$"

_ATOM = "(" + "|".join(ATOMIC_TYPES) + ")"
#: A generic type as a whole, without spaces and in lower case.
GENERIC = "^(" + "|".join([
    _ATOM, rf"(dict|mapping)\[(str|string),(any|object)\]", rf"(record|map)<(str|string),(any|unknown|object)>",
    rf"(list|sequence)\[(any|object)\]", "array<(any|unknown|object)>", rf"(optional|list|sequence|vec)\[{_ATOM}\]", f"array<{_ATOM}>",
]) + ")$"


def _or_null(value: Column, *drop: Column) -> Column:
    bad = value.isNull()
    for d in drop:
        bad = bad | d
    return F.when(~bad, value)


def tidy(value: Column) -> Column:
    """Single spaces, and none around punctuation."""
    return F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r"\s*([<>{}()\[\]|,:=&?])\s*", "$1")


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"\s+", "")


def is_generic(value: Column, ignore: Iterable[str] = ()) -> Column:
    """Whether a type is too general, by the fixed list and forms or by `ignore`."""
    small = compact(value)
    own = [compact_text(x) for x in ignore if compact_text(x)]
    return small.rlike(GENERIC) | (small.isin(own) if own else F.lit(False))


def compact_text(value: str) -> str:
    return "".join(str(value).lower().split())


def is_ghost(entry: Column) -> Column:
    return F.trim(entry).rlike(GHOST_DEMAND)


def without_name(value: Column) -> Column:
    """`Type (name)` as `Type`."""
    return F.when(value.rlike(SIGNATURE), F.trim(F.regexp_extract(value, SIGNATURE, 1))).otherwise(value)


def key_graph(entry: Column, demand: bool, ignore: Iterable[str] = (), ignore_generic: bool = True) -> Column:
    """N1, for the contract graph: case stays, generic types drop; only a demand's name and ghosts are cut."""
    text = F.trim(F.coalesce(entry, F.lit("")))
    body = without_name(text) if demand else text
    body = F.regexp_replace(F.regexp_replace(F.trim(body), r"(?i)^\[generic\]\s*", ""), r"(?i)^typing\.", "")
    value = tidy(body)
    drops = [F.lower(value).isin(NONE_TOKENS)]
    if demand:
        drops.append(text.rlike(GHOST_PREFIX))
    if ignore_generic:
        drops.append(is_generic(value, ignore))
    return _or_null(value, *drops)


def key_fanout(entry: Column) -> Column:
    """N2, for fan-out and completeness: [..] and (..) are cut, lower case; generic types stay."""
    value = F.regexp_replace(F.regexp_replace(F.trim(entry), r"\[[^\]]+\]", ""), r"\([^()]*\)", "")
    value = F.lower(F.regexp_replace(value, r"\s+", " "))
    return _or_null(value, value == "")


def key_ghost(entry: Column) -> Column:
    """N3, for advice: a ghost's prefix is cut, so ghosts count; cut at the first bracket; case and generic types stay."""
    text = F.trim(entry)
    bare = F.when(text.rlike(r"(?i)^\[Ghost:[^\]]+\]\s*.+$"), F.trim(F.regexp_extract(text, r"(?i)^\[Ghost:[^\]]+\]\s*(.+)$", 1))).otherwise(text)
    value = F.trim(F.when(bare.rlike(r"^.+?\s*\("), F.regexp_extract(bare, r"^(.+?)\s*\(", 1)).otherwise(bare))
    return _or_null(value, (text == "") | F.lower(text).eqNullSafe("none") | (value == ""))


def key_neighbour(entry: Column, demand: bool, ignore: Iterable[str] = ()) -> Column:
    """N4, for neighbourhoods: as N1, but names are cut on both sides and prefixes stay."""
    text = F.trim(F.coalesce(entry, F.lit("")))
    value = tidy(F.trim(without_name(text)))
    drops = [text == "", F.lower(value).isin([t for t in NONE_TOKENS if t]), is_generic(value, ignore)]
    if demand:
        drops.append(text.rlike(GHOST_PREFIX))
    return _or_null(value, *drops)


def key_rollup(entry: Column, demand: bool, ignore: Iterable[str] = IGNORED_TYPES) -> Column:
    """N5, for roll-ups: prefixes and names are cut on both sides; configured generic types drop."""
    text = F.trim(F.coalesce(entry, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^\[generic\]\s*", ""), r"(?i)^\[ghost:[^\]]+\]\s*", ""))
    kind = without_name(bare)
    value = tidy(F.regexp_replace(kind, r"(?i)^typing\.", ""))
    small = [compact_text(x) for x in ignore]
    drops = [value == "", compact(kind).isin(small)]
    if demand:
        drops.append(text.rlike(GHOST_PREFIX))
    return _or_null(value, *drops)
