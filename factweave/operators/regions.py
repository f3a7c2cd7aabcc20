"""Regions and elements of text: comment markers, markdown headings and elements, lines."""

from __future__ import annotations

import re

from ..plans.patterns import _VAR, line_pattern
from .code import comment_spans

COMMENT = re.compile(r"^\s*(//|#|--|/\*|\*|<!--)")
HEADING = re.compile(r"^\s*(#{1,6})(?: (.*)|$)")
FENCE = re.compile(r"^\s*```(.*)$")


def lines_of(text: str, begin: int = 0):
    """(offset, line) of each line, without the line's end; no line after a final line end."""
    at, end = 0, len(text)
    while at < end:
        stop = text.find("\n", at)
        stop = end if stop < 0 else stop
        line = text[at:stop]
        yield begin + at, line[:-1] if line.endswith("\r") else line
        at = stop + 1


#: Languages whose comments the lexer knows, by ending.
LEXED = {"js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "rs", "go", "java", "c", "h", "cpp", "cc", "hpp", "cs", "kt", "swift", "scala", "py", "rb", "sh", "toml", "yaml", "yml"}


def comments(text: str, lang: str = "") -> list[tuple[int, int, str]]:
    """(begin, end, text) of each comment: by the lexer for known languages, else lines that begin like one."""
    if lang in LEXED:
        return [(b, e, text[b:e]) for b, e in comment_spans(text, lang)]
    return [(at, at + len(line), line) for at, line in lines_of(text) if COMMENT.match(line)]


def labelled(text: str, opening: str, closing: str | None = None, lang: str = "") -> list[tuple[int, int, str]]:
    """(begin, end, label) of the regions between marked comments; the label is what stands behind the mark."""
    found = comments(text, lang)
    mark = lambda c: re.search(opening, c)
    if closing is None:
        starts = [(b, e, c[m.end() :].strip()) for b, e, c in found if (m := mark(c))]
        return [(e, starts[i + 1][0] if i + 1 < len(starts) else len(text), label) for i, (_, e, label) in enumerate(starts)]
    out, stack = [], []
    for b, e, c in found:
        if m := mark(c):
            stack.append((b, e, c[m.end() :].strip()))
        elif re.search(closing, c) and stack:
            _, begin, label = stack.pop()
            out.append((begin, b, label))
    return sorted(out + stack)


def markers(text: str, opening: str, closing: str | None = None, lang: str = "") -> list[tuple[int, int]]:
    """Regions between marked comments: up to the next mark or the end, or paired as by a stack."""
    return [(b, e) for b, e, _ in labelled(text, opening, closing, lang)]


def heading_regions(text: str, heading: str) -> list[tuple[int, int, dict[str, str]]]:
    """Regions under headings of exactly this level, up to the next of this level or above."""
    m = re.match(r"(#{1,6})\s*(.*)$", heading.strip())
    level, title = len(m[1]), m[2].strip()
    if _VAR.search(title):
        names, out, at = [], [], 0
        for v in _VAR.finditer(title):
            out.append(re.escape(title[at : v.start()]))
            name, many = v["many"] or v["braced"] or v["one"], bool(v["many"])
            body = ".+" if many else r"\S+"
            out.append(f"(?:{body})" if name == "_" else f"({body})")
            names += [name] if name != "_" else []
            at = v.end()
        regex = re.compile("^" + "".join(out) + re.escape(title[at:]) + "$")
    else:
        names, regex = [], re.compile(re.escape(title))
    heads, fenced = [], False
    for at, line in lines_of(text):
        fenced ^= bool(FENCE.match(line))
        h = HEADING.match(line)
        if h and not fenced:
            heads.append((at, at + len(line), len(h[1]), (h[2] or "").strip()))
    found = []
    for i, (_, end, depth, name) in enumerate(heads):
        hit = regex.search(name) if depth == level else None
        if hit:
            stop = next((b for b, _, d, _ in heads[i + 1 :] if d <= level), len(text))
            found.append((min(end + 1, stop), stop, {n: hit[k + 1] for k, n in enumerate(names)}))
    return found


def elements(text: str, pattern: str):
    """(captures, begin, end) of each markdown element: list item, link, fence, table row or quotation."""
    pattern = pattern.strip()
    m = re.match(r"^[-*+] \$+\{?([A-Z_]+)\}?$", pattern)
    if m:
        return _by_line(text, r"^[ \t]*(?:[-*+]|\d+[.)]) (.+)", [m[1]])
    m = re.match(r"^\[\$+([A-Z_]+)\]\(\$+([A-Z_]+)\)$", pattern)
    if m:
        return _by_line(text, r"\[([^\]]*)\]\(([^)]*)\)", [m[1], m[2]])
    m = re.match(r"^```\$([A-Z_]+)(?:\s+\$\$\$([A-Z_]+))?", pattern)
    if m:
        return _fences(text, m[1], m[2])
    m = re.match(r"^\|\s*\$+([A-Z_]+)\s*\|$", pattern)
    if m:
        return [(c, b, e) for c, b, e in _by_line(text, r"^\s*\|(.*)\|\s*$", [m[1]], strip=True) if not re.fullmatch(r"[\s:|-]*-{3}[\s:|-]*", c[m[1]])]
    m = re.match(r"^> \$+([A-Z_]+)$", pattern)
    if m:
        return _by_line(text, r"^\s*> (.*)$", [m[1]])
    raise ValueError(f"md(): unknown element {pattern!r}")


def _by_line(text: str, regex: str, names: list[str], strip: bool = False):
    compiled = re.compile(regex)
    return [({n: m[i + 1].strip() if strip else m[i + 1] for i, n in enumerate(names)}, at + m.start(1), at + m.end(1)) for at, line in lines_of(text) for m in compiled.finditer(line)]


def _fences(text: str, lang: str, body: str | None):
    out, opened = [], None
    for at, line in lines_of(text):
        m = FENCE.match(line)
        if not m:
            continue
        if opened is None:
            opened = (m[1].strip(), at, at + len(line) + 1)
        else:
            name, begin, inner = opened
            out.append(({lang: name} | ({body: text[inner:at]} if body else {}), begin, at + len(line)))
            opened = None
    return out


def line_matches(text: str, begin: int, pattern: str):
    """(captures with offsets) of each line that matches. A match without captures gives no row."""
    compiled = line_pattern(pattern)
    for at, line in lines_of(text, begin):
        hit = compiled.match(line)
        if hit:
            yield {n: (v, at + b, at + e) for n, (v, b, e) in hit.items()}
