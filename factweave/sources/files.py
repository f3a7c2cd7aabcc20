"""Directories of files as blobs: repo, rev, tags, path, content_hash, content, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import directory, extension, git_blob_hash, is_semver, stem
from ..plans.patterns import allows, compile_pattern


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths below `root`, relative to it, without entries whose first part begins with a dot. Reads no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Both ends may or may not carry a scheme; the path after the root is what counts.
    plain = root.split("://", 1)[-1].rstrip("/")
    path = F.substring_index(F.col("path"), plain + "/", -1)
    return found.select(path.alias("path"), F.col("length"), F.col("modificationTime"), F.col("content")).where(~F.col("path").startswith("."))


def blobs(spark: SparkSession, root: str, repo: str, rev: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Blobs of a directory. Path filters come before the content, so filtered files are never decoded."""
    kept = listing(spark, root).where(allows(F.col("path"), list(include), list(exclude)))
    return with_text(kept.select(F.lit(repo).alias("repo"), F.lit(rev).alias("rev"), F.array().cast("array<string>").alias("tags"), "path", "content"))


def with_text(df: DataFrame) -> DataFrame:
    """Add the blob hash, the parts of the path, and the text where the content is UTF-8 (else null)."""
    text = F.col("content").cast("string")
    p = F.col("path")
    return df.select("repo", "rev", "tags", "path", stem(p).alias("stem"), extension(p).alias("ext"), directory(p).alias("dir"), git_blob_hash(F.col("content")).alias("content_hash"), "content", F.when(F.is_valid_utf8(text), text).alias("text"))


def discover(paths: DataFrame, layout: str = "{org}/{branch}/{repo}") -> DataFrame:
    """Repositories that a layout names: one row per distinct folder of its depth, dot folders left out."""
    names = [x.strip("{}") for x in layout.split("/")]
    cut = F.split("path", "/")
    parts = paths.where(F.size(cut) > len(names)).select(*[F.get(cut, i).alias(n) for i, n in enumerate(names)])
    for n in names:
        parts = parts.where(~F.col(n).startswith("."))
    return parts.distinct()


def select_revs(revs: DataFrame, wanted: list[str] = ("main",), exclude: list[str] = ()) -> DataFrame:
    """Revisions (column rev) that a repository's globs choose."""
    keep = compile_pattern("|".join(wanted)).matches(F.col("rev"))
    if exclude:
        keep = keep & ~compile_pattern("|".join(exclude)).matches(F.col("rev"))
    return revs.where(keep).withColumn("is_semver", is_semver(F.col("rev")))


def literal_source(spark: SparkSession, text: str, path: str | None = None) -> DataFrame:
    """One blob from a text; without a path the first sign tells JSON from YAML."""
    path = path or ("stdin.json" if text.lstrip()[:1] in ("{", "[") else "stdin.yaml")
    df = spark.createDataFrame([("", "", [], path, bytearray(text.encode()))], "repo string, rev string, tags array<string>, path string, content binary")
    return with_text(df)
