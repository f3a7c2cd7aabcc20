"""Edits that follow a moved file or a renamed declaration: import paths of JavaScript and Rust."""

from __future__ import annotations

import posixpath
import re

ENDINGS = (".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs")


def js_import(importer: str, old_target: str, new_target: str, specifier: str) -> str | None:
    """The specifier for the target's new path, in the old one's style; None for bare specifiers."""
    if not specifier.startswith("."):
        return None
    path = posixpath.relpath(new_target, posixpath.dirname(importer) or ".")
    ending = next((e for e in ENDINGS if path.endswith(e)), "")
    if ending and not specifier.endswith(ENDINGS):
        path = path[: -len(ending)]
        if path.endswith("/index") and not specifier.endswith("/index"):
            path = path[: -len("/index")]
    return path if path.startswith(".") else f"./{path}"


def js_import_after_own_move(old_importer: str, new_importer: str, specifier: str) -> str | None:
    """The specifier that a moved file needs for an unmoved target."""
    if not specifier.startswith("."):
        return None
    target = posixpath.normpath(posixpath.join(posixpath.dirname(old_importer), specifier))
    path = posixpath.relpath(target, posixpath.dirname(new_importer) or ".")
    return path if path.startswith(".") else f"./{path}"


def module_of(path: str) -> str | None:
    """Module path of a Rust file, from the last `src` folder."""
    parts = path.split("/")
    if "src" not in parts[:-1] or not path.endswith(".rs"):
        return None
    at = len(parts) - 2 - parts[:-1][::-1].index("src")
    inner = parts[at + 1 : -1] + [parts[-1][:-3]]
    if inner[-1] == "mod":
        inner.pop()
    elif inner in (["lib"], ["main"]):
        inner = []
    return "::".join(["crate", *inner])


def absolute(use: str, module: str) -> str | None:
    """`crate::`, `self::` and `super::` paths made absolute; None for others, or above the crate."""
    parts = use.split("::")
    if parts[0] == "crate":
        return use
    at = module.split("::")
    if parts[0] == "self":
        return "::".join(at + parts[1:])
    climbed = 0
    while climbed < len(parts) and parts[climbed] == "super":
        climbed += 1
    if not climbed or climbed >= len(at):
        return None
    return "::".join(at[: len(at) - climbed] + parts[climbed:])


def restyled(path: str, module: str, like: str) -> str:
    """An absolute path in the prefix style of `like`, if it can be said that way."""
    at, parts = module.split("::"), path.split("::")
    if like.startswith("self::") and parts[: len(at)] == at:
        return "::".join(["self", *parts[len(at) :]])
    climbs = len(re.match(r"(?:super::)*", like)[0]) // len("super::")
    if climbs and climbs < len(at) and parts[: len(at) - climbs] == at[: len(at) - climbs]:
        return "::".join(["super"] * climbs + parts[len(at) - climbs :])
    return path


def moved_use(use: str, module: str, old: str, new: str) -> str | None:
    """A `use` path after module `old` became `new`; None if it is not touched."""
    full = absolute(use, module)
    if full is None or not (full == old or full.startswith(old + "::")):
        return None
    return restyled(new + full[len(old) :], module, use)


def parent_files(path: str) -> list[str]:
    """Files that may declare a Rust module of this path."""
    folder, name = posixpath.split(path)
    if name == "mod.rs":
        folder = posixpath.dirname(folder)
    elif name in ("lib.rs", "main.rs"):
        return []
    if posixpath.basename(folder) == "src":
        return [f"{folder}/lib.rs", f"{folder}/main.rs"]
    return [f"{folder}/mod.rs", f"{folder}.rs"]


def crate_names(manifests: dict[str, dict], root: str = "Cargo.toml") -> dict[str, str]:
    """Crate name -> source folder of a workspace's members. manifests: path -> parsed manifest."""
    base, out = posixpath.dirname(root), {}
    members = manifests.get(root, {}).get("workspace", {}).get("members", [])
    for path, doc in manifests.items():
        folder = posixpath.dirname(path)
        inside = any(re.fullmatch(re.escape(posixpath.join(base, m)).replace(r"\*", "[^/]*"), folder) for m in members)
        if (inside or path == root) and "package" in doc:
            out[doc["package"]["name"].replace("-", "_")] = posixpath.join(folder, "src")
    return out


def rewrite_rust(text: str, module: str, old: str, new: str) -> str:
    """All paths of a Rust text after module `old` became `new`: in uses, in code and in macros, not in strings."""
    from ..operators.code import tokens

    toks, edits, i = tokens(text, "rs"), [], 0
    while i < len(toks):
        if toks[i][0] == "word" and toks[i][1] in ("crate", "self", "super") and (i == 0 or toks[i - 1][1] != "::"):
            j, parts = i, [toks[i][1]]
            while j + 2 < len(toks) and toks[j + 1][1] == "::" and toks[j + 2][0] == "word":
                j += 2
                parts.append(toks[j][1])
            got = moved_use("::".join(parts), module, old, new)
            if got is not None:
                edits.append((toks[i][2], toks[j][2] + len(toks[j][1]), got))
            i = j
        i += 1
    for begin, end, value in reversed(edits):
        text = text[:begin] + value + text[end:]
    return text


def plan_move(importers: list[tuple[str, str, int, int]], old: str, new: str) -> list[tuple[str, int, int, str]]:
    """Edits (file, begin, end, text) in importers (file, specifier, begin, end) of a moved file, last span first."""
    out = []
    for file, specifier, begin, end in importers:
        value = js_import(file, old, new, specifier)
        if value is not None and value != specifier:
            out.append((file, begin, end, value))
    return sorted(out, key=lambda x: (x[0], -x[1]))
