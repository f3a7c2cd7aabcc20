"""Scalar functions as Columns: normal forms, pieces of paths and text, hashes, fuzzy score."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def norm(c: Column) -> Column:
    """ASCII letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def norm2(c: Column, suffixes: list[str]) -> Column:
    """`norm` without the first suffix that fits; a suffix never leaves an empty text. Empty text gives null."""
    n = norm(c)
    out = n
    for suffix in reversed([re.sub("[^a-z0-9]", "", s.lower()) for s in suffixes]):
        if suffix:
            out = F.when(n.endswith(suffix) & (F.length(n) > len(suffix)), F.substring(n, F.lit(1), F.length(n) - len(suffix))).otherwise(out)
    return F.when(n != "", out)


def re_extract(text: Column, pattern: str, group: int) -> Column:
    """Group of the first match; null without a match, for a group that took no part, or for a pattern that is no regex."""
    try:
        compiled = re.compile(pattern)
    except re.error:
        return F.lit(None).cast("string")
    if group < 0 or group > compiled.groups:
        return F.lit(None).cast("string")
    found = F.regexp_extract(text, java_regex(pattern), group)
    if group == 0:
        return F.when(F.regexp_like(text, F.lit(java_regex(pattern))), found)
    # Spark gives '' for a group that took no part; only a group that can be empty needs telling apart.
    return F.when(found != "", found) if _never_empty(pattern, group) else F.when(F.regexp_like(text, F.lit(java_regex(pattern))), found)


def _never_empty(pattern: str, group: int) -> bool:
    """Whether the group's own pattern cannot match the empty text."""
    at, depth, begin, count, end = 0, 0, None, 0, None
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        if ch == "[":
            at = pattern.index("]", at + 2)
        elif ch == "(":
            if pattern[at + 1 : at + 2] != "?" or pattern.startswith("(?P<", at):
                count += 1
                if count == group:
                    begin, depth = at, 0
            depth += 1
        elif ch == ")":
            depth -= 1
            if begin is not None and end is None and depth == 0:
                end = at + 1
        at += 1
    return begin is None or re.fullmatch(pattern[begin : end or len(pattern)], "") is None


def java_regex(pattern: str) -> str:
    """Named groups become plain ones: Java refuses `(?P<` and `_` in names."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def split_part(text: Column, delimiter: str, n: Column | int) -> Column:
    """n-th piece from 1; null below 1 or past the end. An empty delimiter cuts between all characters, with empty ends."""
    n = F.lit(n) if isinstance(n, int) else n
    if delimiter == "":
        size = F.length(text)
        return F.when((n >= 1) & (n <= size + 2), F.when((n == 1) | (n == size + 2), F.lit("")).otherwise(F.substring(text, n - 1, F.lit(1))))
    return F.when(n >= 1, F.get(F.split(text, r"\Q" + delimiter + r"\E", -1), n - 1))


def fzy_score(hay: Column, needle: Column) -> Column:
    """Greedy subsequence score: 0 without one, else min(1, 0.5 + 0.5 * adjacent / (n - 1)), 1 for a single character."""
    h, n = F.lower(hay), F.lower(needle)
    state = F.struct(F.lit(1).alias("at"), F.lit(-1).alias("last"), F.lit(0).alias("adjacent"), F.lit(True).alias("ok"))

    def step(acc, ch):
        found = F.call_function("locate", ch, h, acc["at"])
        return F.struct((found + 1).alias("at"), found.alias("last"), (acc["adjacent"] + F.when(found == acc["last"] + 1, 1).otherwise(0)).alias("adjacent"), (acc["ok"] & (found > 0)).alias("ok"))

    got = F.aggregate(F.filter(F.split(n, ""), lambda c: c != ""), state, step)
    size = F.length(n)
    value = F.when(~got["ok"], 0.0).when(size == 1, 1.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * got["adjacent"] / (size - 1)))
    return F.when(hay.isNull() | needle.isNull() | (size == 0), 0.0).otherwise(value)


def is_semver(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^v?[0-9]+[-.+][0-9]+[-.+][0-9]+([-.+].*)?$"))


def git_blob_hash(content: Column) -> Column:
    """SHA-1 that git gives a blob."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(head.cast("binary"), F.unhex(F.lit("00")), content))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Name without what follows its last dot; a leading dot belongs to the name."""
    name = base_name(path)
    return F.when(F.regexp_like(name, F.lit(r"^.+\.[^.]*$")), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def extension(path: Column) -> Column:
    found = F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(F.regexp_like(base_name(path), F.lit(r"^.+\.[^.]*$")), found)


def wt_rev(rev: Column) -> Column:
    return F.concat(rev, F.lit("+wt"))


def is_wt_rev(rev: Column) -> Column:
    return rev.endswith("+wt")


def base_rev(rev: Column) -> Column:
    return F.regexp_replace(rev, r"\+wt$", "")


def package_of(specifier: Column) -> Column:
    """Package of a bare import: `@scope/name` or the first piece."""
    return F.when(F.regexp_like(specifier, F.lit("^[./]")) | (specifier == ""), None).otherwise(F.regexp_extract(specifier, "^(@[^/]+/[^/]+|[^/]+)", 1))


def expand(template: str, values: dict[str, Column]) -> Column:
    """The template with each `{name}` replaced by its value; names without a value stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    whole = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p], F.lit(f"{{{p}}}")) if p in values else F.lit(f"{{{p}}}") for i, p in enumerate(parts)]
    return F.concat(*whole)


def rust_module(path: Column) -> Column:
    """Module path of a Rust file: after its last `src`; lib and main are the crate, mod.rs its directory."""
    after = F.regexp_extract(path, r"^(?:.*/)?src/(.*)\.rs$", 1)
    inner = F.regexp_replace(F.regexp_replace(after, r"(^|/)(mod)$", ""), "^(lib|main)$", "")
    module = F.when(inner == "", F.lit("crate")).otherwise(F.concat(F.lit("crate::"), F.replace(inner, F.lit("/"), F.lit("::"))))
    return F.when(F.regexp_like(path, F.lit(r"^(?:.*/)?src/.*\.rs$")), module)


def register(spark: SparkSession) -> None:
    """SQL names of the functions that SQL has no short form for."""
    # A function of the name split_part exists; ours differs past the end, so SQL gets it under its own name.
    for statement in (
        "CREATE OR REPLACE TEMPORARY FUNCTION fw_norm(x STRING) RETURNS STRING RETURN lower(regexp_replace(x, '[^A-Za-z0-9]', ''))",
        "CREATE OR REPLACE TEMPORARY FUNCTION re_extract(x STRING, p STRING, g INT) RETURNS STRING RETURN CASE WHEN x RLIKE p THEN regexp_extract(x, p, g) END",
        "CREATE OR REPLACE TEMPORARY FUNCTION piece(x STRING, d STRING, n INT) RETURNS STRING RETURN CASE WHEN n >= 1 THEN get(split(x, '\\\\Q' || d || '\\\\E', -1), n - 1) END",
    ):
        spark.sql(statement)
