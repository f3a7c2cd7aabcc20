"""Index tables and sinks: interning, conflict rules, renames, violations, search, partitioned writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, norm2
from ..shared import remove


def strings(values: DataFrame, suffixes: list[str] = ()) -> DataFrame:
    """Distinct values with a stable id and their normal forms."""
    v = F.col("value")
    return values.select("value").where("value IS NOT NULL").distinct().select(F.xxhash64("value").alias("string_id"), "value", norm(v).alias("norm"), norm2(v, list(suffixes)).alias("norm2"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def without_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of files that were not deleted."""
    return rows.join(paths.select("path"), "path", "left_anti")


def upserted(rows: DataFrame, found: DataFrame, keys: list[str], scanned: DataFrame, builtin: DataFrame | None = None) -> DataFrame:
    """rows after a scan of the files `scanned` (path): what was found replaces rows of equal keys, the rest of those files goes.

    Builtin rows are there afterwards, too, unless a row of equal keys is.
    """
    kept = rows.join(scanned.select("path").distinct(), "path", "left_anti").join(found.select(*keys), keys, "left_anti")
    out = kept.select(*rows.columns).unionByName(found.select(*rows.columns))
    return out if builtin is None else out.unionByName(builtin.join(out.select(*keys), keys, "left_anti").select(*rows.columns))


def pivoted(refs: DataFrame, kinds: list[str]) -> DataFrame:
    """path, rule, site and a column per kind of the references (path, rule, site, kind, text) found at one site.

    A site's only reference, if its kind is the rule's name, is the column `value`. References without a site are left
    out. Of several of one kind the least text counts.
    """
    per = [F.min(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in kinds]
    alone = F.when(F.count("*") == 1, F.min(F.when(F.col("kind") == F.col("rule"), F.col("text")))).alias("value")
    return refs.where("site IS NOT NULL").groupBy("path", "rule", "site").agg(*per, alone)


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files with new paths where `moves` (path, new_path) has one; everything else stays."""
    held = files.join(moves.select("path", "new_path"), "path", "left")
    return held.withColumn("path", F.coalesce("new_path", "path")).select(*files.columns)


def violations(name: str, rows: DataFrame) -> DataFrame:
    """One row per violated invariant, its columns as a JSON object."""
    return rows.select(F.lit(name).alias("check_name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("violation_data"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"))


def search(rows: DataFrame, column: str, term: str, order: list[str], limit: int = 500) -> DataFrame:
    """Rows whose normal form holds the term's; terms below three characters find nothing."""
    plain = "".join(ch for ch in term if ch.isascii() and ch.isalnum()).lower()
    if len(plain) < 3:
        return rows.limit(0)
    return rows.where(F.contains(norm(F.col(column)), F.lit(plain))).orderBy(*order).limit(limit)


def write_rows(rows: DataFrame, path: str, scanned: DataFrame | None = None) -> None:
    """Replace the (repo, rev) partitions of `scanned` (default: those of `rows`); running it again changes nothing.

    Partitions that were scanned and have no rows any more are deleted.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "rev").parquet(path)
    if scanned is None:
        return
    spark = rows.sparkSession
    pairs = rows.select(F.col("repo").alias("p_"), F.col("rev").alias("v_")).distinct()
    gone = scanned.select("repo", "rev").distinct().join(pairs, F.col("repo").eqNullSafe(F.col("p_")) & F.col("rev").eqNullSafe(F.col("v_")), "left_anti")
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = lambda key, value: f"{key}=" + ("__HIVE_DEFAULT_PARTITION__" if value in (None, "") else named.escapePathName(value))
    for r in gone.toLocalIterator():
        remove(spark, f"{path}/{folder('repo', r['repo'])}/{folder('rev', r['rev'])}")


def migration(before: dict, after: dict) -> dict[str, str]:
    """What to do with each rule's table: create, rebuild (schema changed), empty (extraction changed), keep, drop."""
    out = {name: "drop" for name in before if name not in after}
    for name, (schema, extract) in after.items():
        old = before.get(name)
        out[name] = "create" if old is None else "rebuild" if old[0] != schema else "empty" if old[1] != extract else "keep"
    return out


def manifest(hashes: dict) -> str:
    return json.dumps(hashes, sort_keys=True)
