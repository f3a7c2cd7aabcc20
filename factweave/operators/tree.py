"""Tree walks over JSON, YAML and TOML documents: the general walk in Python, and a native one over VARIANT."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.patterns import compile_pattern


def load(text: str, ext: str):
    """The document as nested Python values. Raises ValueError for text that is not of the format."""
    if ext == "json":
        return json.loads(text)
    if ext == "toml":
        return tomllib.loads(text)
    import yaml

    try:
        return yaml.load(text, Loader=_yaml_loader(yaml))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None


_LOADERS: dict = {}


def _yaml_loader(yaml):
    """A loader in which only true and false are booleans, and dates stay text."""
    if "safe" not in _LOADERS:
        loader = type("Plain", (yaml.SafeLoader,), {})
        loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false|True|False|TRUE|FALSE)$"), list("tfTF"))
        _LOADERS["safe"] = loader
    return _LOADERS["safe"]


def leaf_text(value) -> str | None:
    """Text of a string, number or boolean; None for null and for anything nested."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, int | float):
        return json.dumps(value)
    return None if value is None or isinstance(value, dict | list) else str(value)


def walk(node, steps, caps=None, path=(), depth=0, parent=None):
    """(captures, path) for each way the steps match below `node`."""
    caps = caps or {}
    if not steps:
        yield caps, path
        return
    step, rest = steps[0], steps[1:]
    kind = step[0]
    if kind == "key":
        if isinstance(node, dict) and step[1] in node:
            more = {step[2]: step[1]} if len(step) > 2 and step[2] else {}
            yield from walk(node[step[1]], rest, caps | more, (*path, step[1]), depth + 1, step[1])
    elif kind == "keymatch":
        for key, child in _items(node):
            found = [compile_pattern(p).match(key) for p in step[1]]
            hit = next((m for m in found if m is not None), None)
            if hit is not None:
                more = {n: v[0] for n, v in hit.items()} | ({step[2]: key} if len(step) > 2 and step[2] else {})
                yield from walk(child, rest, caps | more, (*path, key), depth + 1, key)
    elif kind == "any":
        yield from walk(node, rest, caps, path, depth, parent)
        for key, child in _children(node):
            yield from walk(child, steps, caps, (*path, str(key)), depth + 1, str(key))
    elif kind in ("depth_min", "depth_max", "depth_eq"):
        if {"depth_min": depth >= step[1], "depth_max": depth <= step[1], "depth_eq": depth == step[1]}[kind]:
            yield from walk(node, rest, caps, path, depth, parent)
    elif kind == "parent":
        if parent is not None and compile_pattern(step[1]).match(parent) is not None:
            yield from walk(node, rest, caps, path, depth, parent)
    elif kind == "item":
        for i, child in enumerate(node if isinstance(node, list) else []):
            yield from walk(child, rest, caps, (*path, str(i)), depth + 1, str(i))
    elif kind == "array":
        for child in node if isinstance(node, list) else []:
            yield from ((c, path) for c, _ in walk(child, [*step[1], *rest], caps, path, depth + 1, parent))
    elif kind == "leaf":
        text = leaf_text(node)
        if text is not None:
            yield from walk(node, rest, caps | ({step[1]: text} if step[1] else {}), path, depth, parent)
    elif kind == "leafpattern":
        text = leaf_text(node)
        hit = compile_pattern(step[1]).match(text, caps) if text is not None else None
        if hit is not None:
            yield from walk(node, rest, caps | {n: v[0] for n, v in hit.items()}, path, depth, parent)
    elif kind == "object":
        if isinstance(node, dict):
            for found in _entries(node, step[1], caps, path, depth):
                yield from walk(node, rest, found, path, depth, parent)
    else:
        raise ValueError(f"unknown step {kind}")


def _entries(node: dict, entries, caps, path, depth):
    """Every way in which all entries match, captures flowing from each to those after it."""
    if not entries:
        yield caps
        return
    (kind, *of), steps = entries[0]
    for key, child in _items(node):
        more = {}
        if kind == "exact" and key != of[0]:
            continue
        if kind == "pattern":
            hit = compile_pattern(of[0]).match(key, caps)
            if hit is None:
                continue
            more = {n: v[0] for n, v in hit.items()}
        elif kind == "capture":
            if caps.get(of[0], key) != key:
                continue
            more = {of[0]: key}
        for found, _ in walk(child, steps, caps | more, (*path, key), depth + 1, key):
            yield from _entries(node, entries[1:], found, path, depth)


def _items(node):
    return ((str(k), v) for k, v in node.items()) if isinstance(node, dict) else ()


def _children(node):
    return node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()


def native(df: DataFrame, variant: Column, steps, keep: list[str]) -> DataFrame | None:
    """The walk as VARIANT expressions for exact keys, key captures, arrays and leaves; None if the steps need more.

    Columns `keep` are carried, one column per capture is added, and rows without a match are gone.
    """
    if not _plain(steps):
        return None
    names: list[str] = []
    out = _native(df.withColumn("v0", variant), "v0", steps, names, [0])
    return None if out is None else out.select(*keep, *names)


def _plain(steps) -> bool:
    for kind, *of in steps:
        if kind == "object":
            if not all(k[0] in ("exact", "capture") and _plain(s) for k, s in of[0]):
                return False
        elif kind == "array":
            if not _plain(of[0]):
                return False
        elif kind not in ("key", "leaf"):
            return False
    return True


def _native(df: DataFrame, at: str, steps, names: list[str], count: list[int]) -> DataFrame:
    for kind, *of in steps:
        count[0] += 1
        here = f"v{count[0]}"
        if kind == "key":
            df = df.withColumn(here, _child(at, of[0])).where(F.col(here).isNotNull())
            at = here
        elif kind == "leaf":
            shape = F.schema_of_variant(at)
            fine = F.col(at).isNotNull() & ~F.is_variant_null(at) & ~shape.startswith("OBJECT") & ~shape.startswith("ARRAY")
            text = F.try_variant_get(at, "$", "string")
            if of[0] in names:
                df = df.where(fine & (F.col(of[0]) == text))
            else:
                df = df.where(fine).withColumn(of[0], text) if of[0] else df.where(fine)
                names.extend([of[0]] if of[0] else [])
        elif kind == "array":
            df = df.where(F.schema_of_variant(at).startswith("ARRAY")).withColumn(here, F.explode(F.try_variant_get(at, "$", "array<variant>")))
            df = _native(df, here, of[0], names, count)
        else:
            df = df.where(F.schema_of_variant(at).startswith("OBJECT"))
            for key, inner in of[0]:
                count[0] += 1
                child = f"v{count[0]}"
                if key[0] == "exact":
                    df = df.withColumn(child, _child(at, key[1])).where(F.col(child).isNotNull())
                else:
                    pairs = F.map_entries(F.try_variant_get(at, "$", "map<string,variant>"))
                    df = df.withColumn("e_", F.explode(pairs)).withColumn(child, F.col("e_.value"))
                    if key[1] in names:
                        df = df.where(F.col(key[1]) == F.col("e_.key")).drop("e_")
                    else:
                        df = df.withColumn(key[1], F.col("e_.key")).drop("e_")
                        names.append(key[1])
                df = _native(df, child, inner, names, count)
    return df


def _child(at: str, key: str) -> Column:
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(at, f'$["{quoted}"]', "variant")
