"""Lines and markdown as DataFrame operations, for text that needs no general rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.patterns import line_pattern

HEADING = r"^\s*(#{1,6})(?: |$)"


def lines(df: DataFrame, text: str) -> DataFrame:
    """A row per line (line_no from 0, line); no line after a final line end."""
    cut = F.split(F.col(text), "\r?\n", -1)
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(cut).alias("line_no", "line"))


def matching(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """Lines that match a line pattern, its captures as columns."""
    p = line_pattern(pattern)
    found = lines(df, text).where(p.matches(F.col("line")))
    return found.select(*keep, "line_no", *[F.regexp_extract("line", p.regexes[0], g).alias(n.lower()) for n, g in zip(p.names, p.groups, strict=True)])


def under_headings(df: DataFrame, text: str, level: int, keep: list[str]) -> DataFrame:
    """Lines under headings of exactly this level, with the heading's title, up to the next of this level or above."""
    rows = lines(df.select(*keep, text), text)
    depth = F.length(F.regexp_extract("line", HEADING, 1))
    upto = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when((depth > 0) & (depth <= level), F.struct(depth.alias("depth"), F.trim(F.regexp_replace("line", r"^\s*#{1,6}", "")).alias("title")))
    held = rows.withColumn("head", F.last(mark, ignorenulls=True).over(upto))
    return held.where((F.col("head.depth") == level) & (depth == 0)).select(*keep, "line_no", F.col("head.title").alias("title"), "line")


def _each(df, text, keep, regex, name):
    return lines(df.select(*keep, text), text).where(F.regexp_like("line", F.lit(regex))).select(*keep, F.regexp_extract("line", regex, 1).alias(name))


def items(df, text, keep):
    return _each(df, text, keep, r"^[ \t]*(?:[-*+]|\d+[.)]) (.+)", "item")


def quotes(df, text, keep):
    return _each(df, text, keep, r"^\s*> (.*)$", "quote")


def rows(df, text, keep):
    """Table rows without separators, cells trimmed at both ends."""
    return _each(df, text, keep, r"^\s*\|\s*(.*?)\s*\|\s*$", "cells").where(~F.regexp_like("cells", F.lit(r"^[\s:|-]*-{3}[\s:|-]*$")))


def links(df, text, keep):
    """All links of all lines, in parallel over both groups."""
    regex = F.lit(r"\[([^\]]*)\]\(([^)]*)\)")
    pairs = F.arrays_zip(F.regexp_extract_all("line", regex, 1).alias("text"), F.regexp_extract_all("line", regex, 2).alias("url"))
    found = lines(df.select(*keep, text), text).select(*keep, F.explode(pairs).alias("p"))
    return found.select(*keep, F.col("p.text").alias("text"), F.col("p.url").alias("url"))


def fences(df, text, keep):
    """Closed fenced blocks with language and body."""
    numbered = lines(df.select(*keep, text), text).withColumn("fence", F.regexp_like("line", F.lit(r"^\s*```")))
    order = Window.partitionBy(*keep).orderBy("line_no")
    held = numbered.withColumn("k", F.sum(F.col("fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("block", F.floor((F.col("k") - 1) / 2)).where(((F.col("k") % 2 == 1) | F.col("fence")) & (F.col("k") > 0))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("fence"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    each = held.groupBy(*keep, "block").agg(F.count_if("fence").alias("marks"), F.min_by(F.regexp_extract("line", r"^\s*```(.*)$", 1), "line_no").alias("lang"), body.alias("body"))
    return each.where("marks = 2").select(*keep, F.trim("lang").alias("lang"), "body")
