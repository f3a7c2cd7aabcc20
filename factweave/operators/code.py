"""Facts from source code by a small lexer: structural patterns, JavaScript/TypeScript modules, Rust items.

Patterns match runs of tokens: `$N` is one token or one balanced group, `$$$N` any balanced run, shortest first.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..plans.patterns import _VAR

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>r\#*"[\s\S]*?"\#*|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<word>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|\.\.\.|[^\s\w])"""
)
HASH_COMMENT = re.compile(r"#[^\n]*")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
HASHED = {"py", "python", "rb", "sh", "yaml", "yml", "toml"}


class Tokens(list):
    """(kind, text, offset) of each token; beyond the last one an empty token at the text's end, for files that break off."""

    def __init__(self, text: str):
        super().__init__()
        self.end = ("end", "", len(text))

    def __getitem__(self, i):
        return self.end if isinstance(i, int) and i >= len(self) else super().__getitem__(i)


def comment_spans(text: str, lang: str) -> list[tuple[int, int]]:
    """(begin, end) of each comment, wherever it stands in its line; marks inside strings are none."""
    out: list[tuple[int, int]] = []
    tokens(text, lang, out)
    return out


def tokens(text: str, lang: str = "", comments: list | None = None) -> Tokens:
    """Tokens without spaces and comments; the spans of the latter go to `comments`."""
    out, at = Tokens(text), 0
    while at < len(text):
        if lang in HASHED and text[at] == "#":
            end = HASH_COMMENT.match(text, at).end()
            if comments is not None:
                comments.append((at, end))
            at = end
            continue
        if lang in ("rs", "rust") and text[at] == "'" and (m := re.compile(r"'[a-z_]\w*(?!')").match(text, at)):
            out.append(("word", m[0], at))  # a lifetime
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        if m.lastgroup not in ("space", "comment"):
            out.append((m.lastgroup, m[0], at))
        elif m.lastgroup == "comment" and comments is not None:
            comments.append((at, m.end()))
        at = m.end()
    return out


def _after(toks, i: int) -> int:
    """As _group_end; a group that is never closed, or nothing, ends with the file."""
    return _group_end(toks, i) or len(toks)


def _group_end(toks, i: int) -> int | None:
    """Index after the token or balanced group that begins at i."""
    if i >= len(toks) or toks[i][1] in CLOSE:
        return None
    if toks[i][1] not in OPEN:
        return i + 1
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j][1] in OPEN) - (toks[j][1] in CLOSE)
        if depth == 0:
            return j + 1
    return None


@lru_cache(maxsize=256)
def _compiled(pattern: str, lang: str):
    """The pattern's tokens: (kind, payload)."""
    marks, text = [], pattern
    for k, m in enumerate(_VAR.finditer(pattern)):
        marks.append(("many" if m["many"] else "one", m["many"] or m["braced"] or m["one"], m[0]))
    for k, (_, _, raw) in enumerate(marks):
        text = text.replace(raw, f"ƒ{k}ƒ", 1)
    out = []
    for kind, tok, _ in tokens(text, lang):
        holes = re.findall(r"ƒ(\d+)ƒ", tok)
        if not holes:
            out.append(("lit", tok))
        elif re.fullmatch(r"ƒ\d+ƒ", tok):
            kind_, name, _ = marks[int(holes[0])]
            out.append((kind_, name))
        else:
            names = [marks[int(h)][1] for h in holes]
            out.append(("within", (re.compile(r"^" + re.sub(r"ƒ\d+ƒ", "(.+?)", re.escape(tok).replace("\\ƒ", "ƒ")) + "$"), names)))
    return out


def structural(text: str, pattern, lang: str = ""):
    """Captures with offsets of each place where the pattern, or the rule object (a dict), matches."""
    if isinstance(pattern, dict):
        limits = {n.lstrip("$"): re.compile(c["regex"]) for n, c in (pattern.get("constraints") or {}).items()}
        toks = tokens(text, pattern.get("language") or lang)
        found = _objects(text, toks, pattern["rule"], pattern.get("language") or lang)
        yield from (caps for _, _, caps in found if all(n in caps and r.search(caps[n][0]) for n, r in limits.items()))
        return
    yield from (caps for _, _, caps in _runs(text, tokens(text, lang), pattern, lang))


#: Kinds of nodes that a lexer knows.
KINDS = {"identifier": "word", "string": "string", "number": "number"}


def _span(text: str, toks, i: int, j: int):
    """(text, begin, end) of the tokens from i up to j."""
    if j <= i:
        return "", -1, -1
    end = toks[j - 1][2] + len(toks[j - 1][1])
    return text[toks[i][2] : end], toks[i][2], end


def _objects(text: str, toks, rule: dict, lang: str, among: list | None = None) -> list[tuple[int, int, dict]]:
    """(first token, token after the last, captures) of each run that a rule object takes.

    `pattern`, `any` or `all` name the runs, else those of `among`, else every token and group is one; `kind`, `regex`, `all`, `not`, `inside`, `has`,
    `follows` and `precedes` choose among them. The last four look at any distance: a run inside another, with one inside,
    after or before one of the same group. Their captures are added, those of the nearest run.
    """
    unknown = set(rule) - {"pattern", "kind", "any", "regex", "all", "not", "inside", "has", "follows", "precedes", "stopBy"}
    if unknown:
        raise ValueError(f"ast rule: unknown {sorted(unknown)}")
    if "pattern" in rule:
        runs = list(_runs(text, toks, rule["pattern"], lang))
    elif "any" in rule:
        runs = list({(i, j): (i, j, caps) for part in reversed(rule["any"]) for i, j, caps in _objects(text, toks, part, lang, among)}.values())
    elif rule.get("all"):
        runs = _objects(text, toks, rule["all"][0], lang, among)
    elif among is not None:
        runs = among
    else:
        runs = [(i, j, {}) for i in range(len(toks)) if (j := _group_end(toks, i)) is not None]
    bare = lambda: [(i, j, {}) for i, j, _ in runs]
    if "kind" in rule:
        if rule["kind"] not in KINDS:
            raise ValueError(f"ast rule: kind {rule['kind']!r} is none of {sorted(KINDS)}")
        runs = [r for r in runs if r[1] == r[0] + 1 and toks[r[0]][0] == KINDS[rule["kind"]]]
    if "regex" in rule:
        regex = re.compile(rule["regex"])
        runs = [r for r in runs if regex.search(_span(text, toks, r[0], r[1])[0])]
    if "any" in rule and "pattern" in rule:
        runs = _joined(runs, [x for part in rule["any"] for x in _objects(text, toks, part, lang, bare())], lambda r, x: r[:2] == x[:2])
    for part in rule.get("all", []):
        runs = _joined(runs, _objects(text, toks, part, lang, bare()), lambda r, x: r[:2] == x[:2])
    if "not" in rule:
        taken = {x[:2] for x in _objects(text, toks, rule["not"], lang, bare())}
        runs = [r for r in runs if r[:2] not in taken]
    depth = _parents(toks) if {"follows", "precedes"} & set(rule) else None
    tests = {
        "inside": lambda r, x: x[0] <= r[0] and r[1] <= x[1] and r[:2] != x[:2],
        "has": lambda r, x: r[0] <= x[0] and x[1] <= r[1] and r[:2] != x[:2],
        "follows": lambda r, x: x[1] <= r[0] and depth[x[0]] == depth[r[0]],
        "precedes": lambda r, x: r[1] <= x[0] and depth[x[0]] == depth[r[0]],
    }
    for name, test in tests.items():
        if name in rule:
            runs = _joined(runs, _objects(text, toks, rule[name], lang), test)
    return sorted(runs, key=lambda r: r[:2])


def _joined(runs, others, test):
    """Runs with a run of the others that the test takes and whose captures agree, the nearest such one's added."""
    out = []
    for r in runs:
        fit = [x for x in others if test(r, x) and all(r[2].get(n, v)[0] == v[0] for n, v in x[2].items())]
        if fit:
            nearest = min(fit, key=lambda x: abs(x[0] - r[0]) + abs(x[1] - r[1]))
            out.append((r[0], r[1], nearest[2] | r[2]))
    return out


def _parents(toks) -> list[int]:
    """For each token the opening token of the group around it, -1 outside any."""
    out, stack = [], [-1]
    for i in range(len(toks)):
        if toks[i][1] in CLOSE and len(stack) > 1:
            stack.pop()
        out.append(stack[-1])
        if toks[i][1] in OPEN:
            stack.append(i)
    return out


def _runs(text: str, toks, pattern: str, lang: str):
    """(first token, token after the last, captures with offsets) of each place where the pattern matches."""
    want = _compiled(pattern, lang)

    def match(i: int, k: int, caps: dict):
        if k == len(want):
            return i, caps
        kind, of = want[k]
        if kind == "many":
            j = i
            while True:
                held = caps if of == "_" else caps | {of: _span(text, toks, i, j)}
                found = match(j, k + 1, held)
                if found is not None:
                    return found
                j = _group_end(toks, j)
                if j is None:
                    return None
        if i >= len(toks):
            return None
        if kind == "lit":
            return match(i + 1, k + 1, caps) if toks[i][1] == of else None
        if kind == "within":
            m = of[0].match(toks[i][1])
            if not m:
                return None
            return match(i + 1, k + 1, caps | {n: (m[g + 1], toks[i][2] + m.start(g + 1), toks[i][2] + m.end(g + 1)) for g, n in enumerate(of[1])})
        j = _group_end(toks, i)
        if j is None:
            return None
        got = _span(text, toks, i, j)
        if of != "_" and of in caps and caps[of][0] != got[0]:
            return None
        return match(j, k + 1, caps if of == "_" else caps | {of: got})

    for i in range(len(toks)):
        found = match(i, 0, {})
        if found is not None:
            yield i, *found


def js_facts(text: str):
    """(kind, value, begin, end, parent) of imports, their names, exports and requires."""
    toks = tokens(text, "js")
    word = lambda i: toks[i][1] if i < len(toks) else ""
    bare = lambda t: (t[1][1:-1], t[2] + 1, t[2] + len(t[1]) - 1)
    site = lambda i: (toks[i][1], toks[i][2], toks[i][2] + len(toks[i][1]))
    depth, out = 0, []

    def names(i: int, kind: str, alias: str):
        """Names between braces from i on; index after the closing one."""
        found = []
        while i < len(toks) and word(i) != "}":
            if toks[i][0] in ("word", "string") and not (word(i) == "type" and toks[i + 1][0] == "word" and word(i + 1) != "as"):
                first, last = site(i), None
                if word(i + 1) == "as":
                    last = site(i + 2)
                    i += 2
                found.append((first, last))
            i += 1
        return found, i + 1

    i = 0
    while i < len(toks):
        t = word(i)
        previous = word(i - 1) if i else ""
        if t in OPEN:
            depth += 1
        elif t in CLOSE:
            depth -= 1
        if t == "import" and previous != "." and word(i + 1) not in ("(", "."):
            j = i + 1
            if word(j) == "type" and word(j + 1) not in ("from", ","):
                j += 1
            found = []
            while j < len(toks) and word(j) != "from" and toks[j][0] != "string" and word(j) != ";":
                if word(j) == "{":
                    inner, j = names(j + 1, "", "")
                    found += inner
                elif word(j) == "*" and word(j + 1) == "as":
                    found.append((("*", *site(j)[1:]), site(j + 2)))
                    j += 3
                elif toks[j][0] == "word":
                    found.append((("default", *site(j)[1:]), site(j)))
                    j += 1
                else:
                    j += 1
            if word(j) == "from":
                j += 1
            if j < len(toks) and toks[j][0] == "string":
                out.append(("import_path", *bare(toks[j]), None))
                for first, last in found:
                    out.append(("import_name", *first, None))
                    if last and last[0] != first[0]:
                        out.append(("import_alias", *last, first[0]))
            i = j + 1
            continue
        if t == "export" and depth == 0:
            j = i + 1
            if word(j) == "type" and word(j + 1) in ("{", "*"):
                j += 1
            if word(j) in ("{", "*"):
                if word(j) == "{":
                    found, j = names(j + 1, "", "")
                else:
                    found = [(("*", *site(j)[1:]), site(j + 2))] if word(j + 1) == "as" else []
                    j += 3 if found else 1
                source = word(j) == "from" and j + 1 < len(toks) and toks[j + 1][0] == "string"
                for first, last in found:
                    outer = last or first
                    out.append(("export_name", *outer, None))
                    if source:
                        out.append(("import_name", *first, None))
                    elif last and last[0] != first[0]:
                        out.append(("export_local_binding", *first, outer[0]))
                if source:
                    out.append(("import_path", *bare(toks[j + 1]), None))
                    j += 2
                i = j
                continue
            if word(j) == "default":
                out.append(("export_name", *site(j), None))
                j += 1
                while word(j) in ("async", "abstract"):
                    j += 1
                if word(j) in ("function", "class"):
                    j += 2 if word(j + 1) == "*" else 1
                if j < len(toks) and toks[j][0] == "word" and word(j) not in ("extends", "new"):
                    out.append(("export_local_binding", *site(j), "default"))
            else:
                while word(j) in ("async", "abstract", "declare"):
                    j += 1
                if word(j) in ("function", "class", "const", "let", "var", "interface", "type", "enum", "namespace"):
                    many = word(j) in ("const", "let", "var") and word(j + 1) != "enum"
                    j += 2 if word(j + 1) in ("*", "enum") else 1
                    if many and word(j) == "{":
                        found, _ = names(j + 1, "", "")
                        out += [("export_name", *first, None) for first, _ in found]
                    elif j < len(toks) and toks[j][0] == "word":
                        out.append(("export_name", *site(j), None))
            i += 1
            continue
        if t == "require" and depth == 0 and previous != "." and word(i + 1) == "(" and i + 2 < len(toks) and toks[i + 2][0] == "string" and word(i + 3) == ")":
            out.append(("import_path", *bare(toks[i + 2]), None))
        i += 1
    return [fact for fact in out if fact[1]]


def _rooted(path: list[str]) -> list[str]:
    """A use path without the `self` and `super` that it begins with."""
    k = next((k for k, part in enumerate(path) if part not in ("self", "super")), len(path))
    return path[k:]


def rust_facts(text: str):
    """(kind, value, begin, end, parent) of uses, declarations, modules and external crates."""
    toks = tokens(text, "rs")
    word = lambda i: toks[i][1] if i < len(toks) else ""
    site = lambda i: (toks[i][2], toks[i][2] + len(toks[i][1]))
    out: list[tuple] = []

    def use_tree(i: int, prefix: list[str]) -> int:
        path, begin = list(prefix), i
        while i < len(toks):
            t = word(i)
            if t == "::":
                i += 1
            elif t == "{":
                i += 1
                while i < len(toks) and word(i) != "}":
                    i = max(use_tree(i, path), i + 1)  # what is no path is passed over
                    if word(i) == ",":
                        i += 1
                return i + 1
            elif t == "*":
                out.append(("rs_use", "::".join([*_rooted(path), "*"]), *site(begin), None))
                return i + 1
            elif toks[i][0] == "word":
                # `self` in a group is the group itself
                if not (t == "self" and path):
                    path.append(t)
                i += 1
                if word(i) == "as":
                    i += 2
                if word(i) != "::":
                    out.append(("rs_use", "::".join(_rooted(path)), *site(begin), None))
                    return i
            else:
                return i
        return i

    kinds = {"fn", "struct", "enum", "union", "type", "const", "static", "trait"}
    i, stack = 0, []
    while i < len(toks):
        t = word(i)
        if t == "{":
            stack.append("block")
        elif t == "}" and stack:
            stack.pop()
        inside_body = "block" in stack
        if t == "#" and word(i + 1) == "[":
            if word(i + 2) == "path" and word(i + 3) == "=":
                held = word(i + 4)[1:-1]
                j = _after(toks, i + 1)
                while word(j) in ("pub", "("):
                    j = _after(toks, j)
                if word(j) == "mod":
                    out.append(("rs_mod", word(j + 1), *site(j + 1), held))
                    i = j + 2
                    continue
            i = _group_end(toks, i + 1) or i + 1
            continue
        if not inside_body:
            if t == "use":
                i = use_tree(i + 1, [])
                continue
            if t == "extern" and word(i + 1) == "crate":
                out.append(("dep_name", word(i + 2), *site(i + 2), None))
                i += 3
                continue
            if t == "mod" and i + 1 < len(toks) and toks[i + 1][0] == "word":
                out.append(("rs_mod", word(i + 1), *site(i + 1), None))
                if word(i + 2) == "{":
                    stack.append("mod")
                    i += 3
                    continue
                i += 2
                continue
            if t in kinds and i + 1 < len(toks) and not (t == "const" and word(i + 1) in ("fn", "unsafe", "async", "_")):
                j = i + 2 if word(i + 1) == "mut" else i + 1
                if toks[j][0] == "word":
                    out.append(("rs_declare", word(j), *site(j), None))
                    if t == "trait":
                        j = next((k for k in range(j, len(toks)) if word(k) in ("{", ";")), len(toks))
                        if word(j) == "{":
                            stack.append("trait")
                        i = j + 1
                        continue
                    i = j + 1
                    continue
            if t == "impl":
                j = next((k for k in range(i, len(toks)) if word(k) == "{"), len(toks))
                stack.append("impl")
                i = j + 1
                continue
        i += 1
    return [fact for fact in out if fact[1]]
