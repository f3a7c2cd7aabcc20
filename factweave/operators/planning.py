"""Edits that follow moves, renames and deletions, over tables of facts.

imports: path, value, span_start, span_end, target (the file the import resolves to).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import js_import, rewrite_rust
from .graph import rename_edits


def plan_moves(imports: DataFrame, moves: DataFrame) -> DataFrame:
    """path, begin, end, new: import paths of files that import a moved file (old_path, new_path); bare ones stay."""
    hit = imports.join(moves, F.col("target") == F.col("old_path"))
    new = hit.withColumn("new", js_import("path", "old_path", "new_path", "value"))
    return new.where("new IS NOT NULL AND new <> value").select("path", F.col("span_start").alias("begin"), F.col("span_end").alias("end"), "new")


def plan_module_moves(files: DataFrame, module: str, moves: DataFrame, most: int = 1000) -> DataFrame:
    """path, text of Rust files (path, text, column `module`) whose paths name a moved module (old_module, new_module).

    One module at a time is the rule; several moves rewrite in the order of their names. More than `most` raise.
    """
    pairs = [(r["old_module"], r["new_module"]) for r in moves.orderBy("old_module").limit(most + 1).collect()]
    if len(pairs) > most:
        raise ValueError(f"more than {most} module moves at once")
    out = F.col("text")
    for old, new in pairs:
        out = rewrite_rust(out, F.col(module), F.lit(old), F.lit(new))
    return files.select("path", F.col("text").alias("before"), out.alias("text")).where("before <> text").drop("before")


def plan_rename(names: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """path, begin, end, new for each place that names a renamed export, through re-exports.

    names: path, name, alias, target, reexport, span_start, span_end.
    """
    touched = rename_edits(names.select("path", "name", "alias", "target", "reexport"), path, old, new).select("path")
    return names.where(F.col("name") == old).join(touched, "path", "left_semi").select("path", F.col("span_start").alias("begin"), F.col("span_end").alias("end"), F.lit(new).alias("new"))


def broken_imports(imports: DataFrame, deleted: DataFrame) -> DataFrame:
    """target, broken: how many imports each deleted file (path) leaves without a target."""
    return imports.join(deleted.select(F.col("path").alias("target")), "target", "left_semi").groupBy("target").agg(F.count("*").alias("broken"))
