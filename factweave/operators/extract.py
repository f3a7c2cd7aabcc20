"""Extraction: blobs (repo, rev, tags, path, text) and rules to rows of captures.

One Arrow pass parses each file once for all rules. Path filters that all rules agree on run before it, so that files
no rule wants are never read by Python.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension
from ..plans.language import Program, Rule, RuleError, levels, matched, variables
from ..plans.patterns import compile_pattern, line_pattern
from ..shared import new_path
from .code import js_facts, rust_facts, structural
from .regions import elements, heading_regions, labelled, line_matches
from .tree import load, walk

TREE = {"json", "yaml", "yml", "toml"}
JS = {"js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"}
ROWS = "rule string, repo string, rev string, path string, captures map<string,string>, spans map<string,struct<begin:int,end:int>>, node_path string"
FACTS = "kind string, value string, repo string, rev string, path string, span_start int, span_end int, parent_key string"


#: A context step that is one capture alone.
SLOT = re.compile(r"\$(?:\{([A-Z_][A-Z0-9_]*)\}|([A-Z_][A-Z0-9_]*))")


def _slot(kind: str, repo, rev, tags, path):
    """What a step of one capture alone takes: repository, branch or else first tag, stem of the file, path of its folder."""
    name = path.rpartition("/")[2]
    return {"repo": repo, "rev": rev or next(iter(tags or []), None), "file": name.rpartition(".")[0] or name, "folder": path.rpartition("/")[0]}[kind]


def _context(rule: Rule, repo, rev, tags, path) -> dict[str, str] | None:
    """Captures of the context steps, or None if one does not match."""
    caps: dict[str, str] = {}
    for kind, pattern in rule.context:
        slot = SLOT.fullmatch(pattern) if kind != "tag" else None
        if slot:
            name, value = slot[1] or slot[2], _slot(kind, repo, rev, tags, path)
            caps |= {name: value} if name != "_" and value is not None else {}
            continue
        if kind == "file":
            hit = compile_pattern(pattern).match(path)
        elif kind == "folder":
            hit = _folder(pattern, path)
        elif kind == "repo":
            hit = compile_pattern(pattern).match(repo or "")
        else:
            hit = next((h for h in (compile_pattern(pattern).match(x) for x in [rev or "", *(tags or [])]) if h is not None), None)
        if hit is None:
            return None
        caps |= {n: v[0] for n, v in hit.items()}
    return caps


def _folder(pattern: str, path: str):
    """Match the folder's path, or any of its leading or inner parts when the pattern has no `/`."""
    parts = path.split("/")[:-1]
    for end in range(1, len(parts) + 1):
        for begin in range(end) if "/" not in pattern and not pattern.startswith("**") else (0,):
            hit = compile_pattern(pattern).match("/".join(parts[begin:end]))
            if hit is not None:
                return hit
    return None


def regions(rule: Rule, text: str, ext: str = ""):
    """(begin, end, captures). Where no region is found the whole text passes. A marker's third part names its label's capture."""
    spans = [(0, len(text), {})]
    if rule.marker:
        opening, closing, label = [*rule.marker, None, None][:3]
        spans = [(b, e, {label: found} if label else {}) for b, e, found in labelled(text, opening, closing, ext)] or spans
    for heading in rule.headings:
        inner = [(b + x, b + y, caps | more) for b, e, caps in spans for x, y, more in heading_regions(text[b:e], heading)]
        spans = inner or spans
    return spans


def evaluate(rule: Rule, text: str, path: str, seeds: dict[str, str], docs: dict):
    """(captures with offsets or -1, node path) of one rule over one file."""
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    plain = lambda caps: {n: (v, -1, -1) for n, v in caps.items()}
    for begin, end, caps in regions(rule, text, ext):
        body = text[begin:end]
        moved = lambda found: {n: (v, begin + b if b >= 0 else b, begin + e if e >= 0 else e) for n, (v, b, e) in found.items()}
        rows: list[tuple[dict, str]] = []
        kind = rule.matcher[0] if rule.matcher else None
        if kind == "md":
            rows = [({n: (v, begin + b, begin + e) for n, v in c.items()}, "") for c, b, e in elements(body, rule.matcher[1])]
        elif kind == "ast":
            rows = [(moved(found), "") for found in structural(body, rule.matcher[1], rule.matcher[2] or ext)]
        elif kind == "json":
            key = (begin, end)
            if key not in docs:
                try:
                    docs[key] = [load(body, ext if ext in TREE else "json" if body.lstrip()[:1] in "{[" else "yaml")]
                except (ValueError, RecursionError):
                    docs[key] = []
            rows = [(plain(c), "/".join(p)) for doc in docs[key] for c, p in walk(doc, rule.matcher[1], dict(seeds))]
            rows = [({n: v for n, v in c.items() if n not in seeds}, p) for c, p in rows]
        elif rule.line is None and rule.headings:
            rows = [({}, "")] if (begin, end) != (0, len(text)) or caps else []
        if rule.line is not None:
            if kind is None:
                rows = [(found, "") for found in line_matches(body, begin, rule.line) if found]
            else:
                source = rule.line_source
                kept = []
                for c, p in rows:
                    value = c.get(source or next(reversed(c), ""), ("", 0, 0))[0]
                    hit = next((h for h in line_matches(value, 0, rule.line) if h), None)
                    if hit:
                        kept.append((c | {n: (v, -1, -1) for n, (v, *_) in hit.items()}, p))
                rows = kept
        for found, node_path in rows:
            yield plain(caps) | found, node_path


def _wanted(path, rules: list[Rule]):
    """Rows whose path some rule may want: the file globs of each rule, as one predicate."""
    each = []
    for rule in rules:
        globs = [compile_pattern(p).matches(path) for k, p in rule.context if k == "file" and not SLOT.fullmatch(p)]
        if not globs:
            return F.lit(True)
        each.append(reduce(lambda a, b: a & b, globs))
    return reduce(lambda a, b: a | b, each) if each else F.lit(False)


def byte_offsets(text: str):
    """The offset in bytes of UTF-8 of each place in a text, from one pass over it."""
    if text.isascii():
        return lambda i: min(i, len(text))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]
    return lambda i: int(sums[min(i, len(text))])


def extract(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per match of each rule. blobs: repo, rev, tags, path, text."""

    def run(batches):
        for batch in batches:
            out = []
            for repo, rev, tags, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None or path is None:
                    continue
                name = path.rpartition("/")[2]
                seeds = {"currentRepo": repo or "", "currentRev": rev or "", "currentFile": path, "currentDir": path.rpartition("/")[0], "currentStem": name.rpartition(".")[0] or name, "currentExt": name.rpartition(".")[2] if "." in name else ""}
                docs: dict = {}
                bytes_of = None
                for rule in rules:
                    context = _context(rule, repo, rev, tags, path)
                    if context is None:
                        continue
                    for caps, node_path in evaluate(rule, text, path, seeds, docs):
                        caps = caps | {n: (v, -1, -1) for n, v in context.items()}
                        if not caps and rule.columns:
                            continue
                        spans = {n: (b, e) for n, (_, b, e) in caps.items() if b >= 0}
                        bytes_of = bytes_of or byte_offsets(text)
                        out.append((rule.name, repo, rev, path, [(n, v) for n, (v, *_) in caps.items()], [(n, {"begin": bytes_of(b), "end": bytes_of(e)}) for n, (b, e) in spans.items()], node_path))
            if out:
                yield _batch(out, ["rule", "repo", "rev", "path", "captures", "spans", "node_path"], [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string()])

    wanted = blobs.where(_wanted(F.col("path"), rules))
    return wanted.select("repo", "rev", "tags", "path", "text").mapInArrow(run, ROWS)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def facts(blobs: DataFrame) -> DataFrame:
    """Facts of JavaScript, TypeScript and Rust files, spans in bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for repo, rev, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                find = rust_facts if path.endswith(".rs") else js_facts
                bytes_of = byte_offsets(text)
                for kind, value, begin, end, parent in find(text):
                    out.append((kind, value, repo, rev, path, bytes_of(begin), bytes_of(end), parent))
            if out:
                yield _batch(out, ["kind", "value", "repo", "rev", "path", "span_start", "span_end", "parent_key"], [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()])

    code = blobs.where(extension(F.col("path")).isin(*JS, "rs") & F.col("text").isNotNull())
    return code.select("repo", "rev", "path", "text").mapInArrow(run, FACTS)


def tables(blobs: DataFrame, program: Program) -> dict[str, DataFrame]:
    """A DataFrame per rule: its captures as columns, then repo, rev, path, node_path.

    A rule that refers to another is joined with it on the captures they share; levels run in order. Files are parsed once
    for all rules: the rows go to the shared folder, a folder per rule, and each rule reads its own.
    """
    rows = by_rule(extract(blobs, program.rules))
    out: dict[str, DataFrame] = {}
    for level in levels(program):
        for name in level:
            columns = program.columns(name)
            own = rows.where(F.col("rule") == name)
            refs = [ref for r in program.rules if r.name == name for ref in r.refs]
            base = own.select(*[F.col("captures").getItem(c).alias(c.lower()) for c in columns], "repo", "rev", "path", "node_path")
            for up, bindings in refs:
                given = out[up].select(*[F.col(c.lower()).alias(f"up_{v.lower()}") for c, v in bindings.items()]).distinct()
                # A capture that the body does not bind takes the value of the rule it refers to.
                bound = {v for v in bindings.values() if any(v in _own(r) for r in program.rules if r.name == name)}
                on = reduce(lambda a, b: a & b, [F.col(v.lower()) == F.col(f"up_{v.lower()}") for v in bound], F.lit(True))
                if not bound:
                    raise RuleError(f"{name}: binds no capture of {up}, so every row would meet every row")
                base = base.join(given, on)
                for v in bindings.values():
                    base = base.withColumn(v.lower(), F.coalesce(F.col(v.lower()), F.col(f"up_{v.lower()}"))).drop(f"up_{v.lower()}")
            out[name] = base
    return out


def by_rule(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    path = new_path(spark, "extracted")
    rows.write.partitionBy("rule").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _own(rule: Rule) -> set[str]:
    """Captures that the rule's own steps bind, not only a reference."""
    bound = {v for _, b in rule.refs for v in b.values()}
    said = variables(" ".join([p for _, p in rule.context] + rule.headings)) + (matched(rule.matcher) if rule.matcher else [])
    said += line_pattern(rule.line).names if rule.line else []
    return (bound & set(said)) | (set(rule.columns) - bound)


def views(blobs: DataFrame, program: Program, namespace: str = "") -> dict[str, DataFrame]:
    """`tables` with normal forms of each capture, registered as temporary views."""
    from ..functions.text import norm

    found = {}
    for name, df in tables(blobs, program).items():
        captures = [c.lower() for c in program.columns(name)]
        df = df.select(*[x for c in captures for x in (F.col(c), norm(F.col(c)).alias(f"{c}_norm"))], "repo", "rev", "path", "node_path")
        df.createOrReplaceTempView(f"{namespace}__{name}" if namespace else name)
        found[name] = df
    return found
