"""Patterns over text: globs, regexes and segments, as Spark Columns and as Python matchers.

A pattern that begins with `re:` is a regex searched for; one with `$` is a segment pattern matched against the whole
text; anything else is a list of globs parted by `|`. All become regexes that Java and Python read alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_VAR = re.compile(r"\$\$\$(?P<many>[A-Z_][A-Z0-9_]*)|\$\{(?P<braced>[A-Z_][A-Z0-9_]*)\}|\$(?P<one>[A-Z_][A-Z0-9_]*)")


def glob_regex(glob: str) -> str:
    """Regex of the whole path. `*` and `?` cross `/`, `**/` is any number of folders, `{a,b}` and `[..]` as usual."""
    out, at = [], 0
    while at < len(glob):
        rest = glob[at:]
        if rest.startswith("**/") and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif rest.startswith("/**") and at + 3 == len(glob):
            out.append("/.*")
            at += 3
        elif rest[0] == "*":
            run = len(rest) - len(rest.lstrip("*"))
            out.append(".*")
            at += run
        elif rest[0] == "?":
            out.append(".")
            at += 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            inner = rest[1:end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            at += end + 1
        elif rest[0] == "{" and "}" in rest:
            end = rest.index("}")
            out.append("(?:" + "|".join(glob_regex(x)[5:-1] for x in rest[1:end].split(",")) + ")")
            at += end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out.append(literal(rest[1]))
            at += 2
        else:
            out.append(literal(rest[0]))
            at += 1
    return "(?s)^" + "".join(out) + "$"


def literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", text)


def pieces(pattern: str) -> list[tuple[str, str]]:
    """(kind, text) of a segment pattern: lit, one or many; the name `_` is a wildcard."""
    out, at = [], 0
    for m in _VAR.finditer(pattern):
        if m.start() > at:
            out.append(("lit", pattern[at : m.start()]))
        out.append(("many", m["many"]) if m["many"] else ("one", m["braced"] or m["one"]))
        at = m.end()
    if at < len(pattern):
        out.append(("lit", pattern[at:]))
    return out


def segment_regex(pattern: str, bound: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """Anchored regex and the names of its groups, in order. bound: names that already have a value."""
    parts, names, out = pieces(pattern), [], []
    for i, (kind, text) in enumerate(parts):
        if kind == "lit":
            out.append(literal(text))
            continue
        following = next((t for k, t in parts[i + 1 :] if k == "lit"), None)
        if text != "_" and bound and text in bound:
            out.append(literal(bound[text]))
        elif text != "_" and text in names:
            out.append(f"\\{names.index(text) + 1}")
        else:
            body = "[^/]+?" if kind == "one" else "[\\s\\S]*?"
            if text == "_":
                out.append(f"(?:{body})")
            else:
                names.append(text)
                out.append(f"({body})")
            if kind == "one" and text != "_" and following is not None:
                out.append(f"(?={literal(following)})")
    return "^" + "".join(out) + "$(?!\\n)", names


@dataclass
class Pattern:
    """A compiled pattern. regexes: any may match; names: capture names by group number."""

    source: str
    kind: str
    regexes: list[str]
    names: list[str] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)

    def matches(self, c: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.regexp_like(c, F.lit(r)) for r in self.regexes])

    def captures(self, c: Column) -> dict[str, Column]:
        """Column per capture; null where the pattern does not match."""
        return {n: F.when(self.matches(c), F.regexp_extract(c, self.regexes[0], g)) for n, g in zip(self.names, self.groups, strict=True)}

    def bound(self, c: Column, values: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
        """(does it match, column per other capture) of a segment pattern some of whose names have a value in each row."""
        regex, names = segment_regex(self.source, {n: f"\ue000{n}\ue001" for n in values})
        quoted = lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        parts = re.split("\ue000(\\w+)\ue001", regex)
        whole = F.concat(*[quoted(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
        hit = F.regexp_like(c, whole)
        return hit, {n: F.when(hit, F.call_function("regexp_extract", c, whole, F.lit(i + 1))) for i, n in enumerate(names)}

    def match(self, text: str, bound: dict[str, str] | None = None) -> dict[str, tuple[str, int, int]] | None:
        """Captures with offsets in code points, or None."""
        if self.kind == "segment":
            regex, names = segment_regex(self.source, bound)
            m = re.match(regex, text)
            return None if not m else {n: (m[i + 1], *m.span(i + 1)) for i, n in enumerate(names)}
        for r in self.regexes:
            m = re.search(r, text) if self.kind == "regex" else re.match(r, text)
            if m:
                return {n: (m[g], *m.span(g)) for n, g in zip(self.names, self.groups, strict=True) if m[g] is not None}
        return None


def named_groups(regex: str) -> tuple[str, list[str], list[int]]:
    """Regex without group names, and the names with their numbers."""
    compiled = re.compile(regex)
    items = sorted(compiled.groupindex.items(), key=lambda x: x[1])
    return re.sub(r"\(\?P<\w+>", "(", regex), [n for n, _ in items], [g for _, g in items]


def compile_pattern(source: str) -> Pattern:
    if source.startswith("re:"):
        regex, names, groups = named_groups(source[3:])
        return Pattern(source, "regex", [regex], names, groups)
    if "$" in source:
        regex, names = segment_regex(source)
        return Pattern(source, "segment", [regex], names, list(range(1, len(names) + 1)))
    return Pattern(source, "glob", [glob_regex(g) for g in source.split("|")])


def line_pattern(source: str) -> Pattern:
    """Pattern of a line. `re:` with `$NAME` is searched for; `re:` with named groups must match the whole line."""
    if not source.startswith("re:"):
        regex, names = segment_regex(source)
        return Pattern(source, "segment", [regex], names, list(range(1, len(names) + 1)))
    body = source[3:]
    if not _VAR.search(body):
        regex, names, groups = named_groups(body)
        return Pattern(source, "regex", [f"^(?:{regex})$"], names, groups)
    kinds = {"one": r"[a-zA-Z0-9._/-]+", "many": ".+"}
    named = _VAR.sub(lambda m: _sugar(m, kinds), body)
    regex, names, groups = named_groups(named)
    return Pattern(source, "regex", [regex], names, groups)


def _sugar(m: re.Match, kinds: dict[str, str]) -> str:
    name, kind = (m["many"], "many") if m["many"] else (m["braced"] or m["one"], "one")
    if name == "_":
        return "(?:.+)" if kind == "many" else r"(?:\S+)"
    return f"(?P<{name}>{kinds[kind]})"


def allows(path: Column, include: list[str], exclude: list[str]) -> Column:
    """File filter: any include (all, if there is none) and no exclude."""
    any_of = lambda globs: reduce(lambda a, b: a | b, [compile_pattern(g).matches(path) for g in globs])
    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def resolve_filter(levels: list[dict | None]) -> dict:
    """The first filter given wins: branch, then repository, then global. It replaces the others."""
    return next((x for x in levels if x), {"include": [], "exclude": []})
