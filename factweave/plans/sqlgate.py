"""SQL from users: one read-only statement, with habits of another dialect rewritten; and checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.sinks import violations


class Refused(ValueError):
    """A statement that may not run."""


def gate(text: str, spark: SparkSession | None = None) -> str:
    """The statement, if it is a single one that only reads: its parsed plan may hold no command and no insert."""
    body = re.sub(r"^(\s+|--[^\n]*(\n|$)|/\*[\s\S]*?\*/)+", "", text).strip().removesuffix(";").strip()
    if not re.match(r"(?is)(select|with|explain)\b", body):
        raise Refused("only SELECT, WITH and EXPLAIN may run")
    spark = spark or SparkSession.getActiveSession()
    jvm = spark._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"(?is)^explain\s+(extended|codegen|cost|formatted)?\b", "", dialect(body)))
    except Exception as e:
        raise Refused(f"not one statement that can be read: {str(e).splitlines()[0]}") from None
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    writes = [jvm.java.lang.Class.forName(logical + name) for name in ("Command", "ParsedStatement")]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(kind.isInstance(node) for kind in writes):
            raise Refused("only statements that read may run")
        for below in (node.children(), node.innerChildren()):
            todo += [child for k in range(below.length()) if _is_plan(jvm, child := below.apply(k))]
    return body


def _is_plan(jvm, node) -> bool:
    return jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(node)


def dialect(text: str) -> str:
    """LIKE without regard to case, GROUP_CONCAT, GLOB, iif and json_each, outside string literals."""
    parts = re.split(r"('(?:[^']|'')*')", text)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?i)\bLIKE\b", "ILIKE", parts[i])
        parts[i] = re.sub(r"(?i)\bGROUP_CONCAT\s*\(\s*(DISTINCT\s+)?([\w.]+)\s*\)", lambda m: f"listagg({m[1] or ''}{m[2]}, ',')", parts[i])
        parts[i] = re.sub(r"(?i)\biif\s*\(", "if(", parts[i])
        parts[i] = re.sub(r"(?i)(,|\bjoin)\s*json_each\s*\(", r"\1 LATERAL json_each(", parts[i])
        parts[i] = re.sub(r'"(\w+)"', r"`\1`", parts[i])
        if i + 1 < len(parts) and re.search(r"(?i)\bGLOB\s*$", parts[i]):
            from .patterns import glob_regex

            parts[i] = re.sub(r"(?i)\bGLOB\s*$", "RLIKE ", parts[i])
            parts[i + 1] = "r'" + glob_regex(parts[i + 1][1:-1]) + "'"
    return "".join(parts)


#: Marks of a time format and what they are called here.
_TIMES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def _formatted(given: str, time: str) -> str:
    """SQL for `strftime`: each mark gives way to its part of the time, digits that hold no mark; all else is text."""
    out = given
    for mark, here in _TIMES.items():
        out = f"replace({out}, '{mark}', date_format({time}, '{here}'))"
    return out


#: Functions that users know from another dialect, each an SQL expression that is put in its place. Values of JSON are text.
FUNCTIONS = {
    "json_extract(j STRING, p STRING) RETURNS STRING": "get_json_object(j, p)",
    "json_valid(j STRING) RETURNS INT": "CAST(try_parse_json(j) IS NOT NULL AS INT)",
    "json_type(j STRING) RETURNS STRING": "CASE lower(regexp_extract(schema_of_variant(try_parse_json(j)), '^[A-Za-z]+', 0)) WHEN 'object' THEN 'object' WHEN 'array' THEN 'array' WHEN 'void' THEN 'null' WHEN 'bigint' THEN 'integer' WHEN 'decimal' THEN 'real' WHEN 'double' THEN 'real' WHEN 'string' THEN 'text' WHEN 'boolean' THEN trim(j) END",
    "json_each(j STRING) RETURNS TABLE (key STRING, value STRING)": "SELECT coalesce(e.key, CAST(e.pos AS STRING)), CAST(e.value AS STRING) FROM variant_explode(try_parse_json(j)) AS e",
    "datetime(x STRING) RETURNS STRING": "date_format(try_to_timestamp(x), 'yyyy-MM-dd HH:mm:ss')",
    "strftime(f STRING, x STRING) RETURNS STRING": _formatted("f", "try_to_timestamp(x)"),
    "unixepoch(x STRING) RETURNS BIGINT": "unix_timestamp(try_to_timestamp(x))",
    "julianday(x STRING) RETURNS DOUBLE": "unix_micros(try_to_timestamp(x)) / 86400000000D + 2440587.5D",
}


def register(spark: SparkSession) -> None:
    """The functions of the other dialect, for this session; text that is no time or no JSON gives null. Known names stay."""
    for head, body in FUNCTIONS.items():
        if not spark.catalog.functionExists(head.partition("(")[0]):
            spark.sql(f"CREATE TEMPORARY FUNCTION {head} RETURN {body}")


def sql(spark: SparkSession, text: str) -> DataFrame:
    ready = dialect(gate(text, spark))
    register(spark)
    return spark.sql(ready)


def run_check(spark: SparkSession, name: str, text: str) -> DataFrame:
    return violations(name, sql(spark, text))


def run_checks(spark: SparkSession, checks: dict[str, str]) -> tuple[bool, dict[str, DataFrame]]:
    """Whether all hold, and each check's violations."""
    found = {name: run_check(spark, name, text) for name, text in checks.items()}
    return all(df.isEmpty() for df in found.values()), found
