"""Streams of file events: changes from micro-batches, and the queries that keep tables current."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extract import facts
from ..operators.graph import nearest_spans
from ..plans.patterns import compile_pattern

EVENTS = "event_ts timestamp, repo string, op string, path string, content_hash string"
#: Parts of paths whose events are dropped.
IGNORED = ["node_modules", ".git", "target", "dist", "build", "__pycache__"]


def read_events(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(path)


def classify(events: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of a batch: repo, change_type, old_path, new_path, content_hash.

    files: repo, path, content_hash of the index. A path created though the index has it is a content change; a path
    removed and created again with another hash, too. A removal and a creation of equal hash are a move, paired in
    the order of their paths; what is left are deletions and creations. The last event of a path and kind counts.
    """
    ignored = F.exists(F.split("path", "/"), lambda x: x.isin(IGNORED))
    last = Window.partitionBy("repo", "path", "gone").orderBy(F.desc("event_ts"), F.desc("content_hash"))
    e = events.where(~ignored).withColumn("gone", F.col("op") == "removed").withColumn("k", F.row_number().over(last)).where("k = 1")
    known = files.select("repo", "path", F.col("content_hash").alias("known"))
    removed = e.where("gone").select("repo", "path").join(known, ["repo", "path"], "left")
    present = e.where("NOT gone").select("repo", "path", "content_hash").join(known, ["repo", "path"], "left")
    same = present.where("known IS NOT NULL")
    changed = same.where("content_hash <> known").select("repo", F.lit("content_change").alias("change_type"), F.lit(None).cast("string").alias("old_path"), F.col("path").alias("new_path"), "content_hash")
    gone = removed.join(present.select("repo", "path"), ["repo", "path"], "left_anti").where("known IS NOT NULL")
    came = present.where("known IS NULL")
    nth = lambda h: F.row_number().over(Window.partitionBy("repo", h).orderBy("path"))
    out = gone.select("repo", F.col("path").alias("old_path"), F.col("known").alias("content_hash"), nth("known").alias("k"))
    into = came.select("repo", F.col("path").alias("new_path"), "content_hash", nth("content_hash").alias("k"))
    pairs = out.join(into, ["repo", "content_hash", "k"], "full_outer")
    kind = F.when(F.col("old_path").isNull(), "create").when(F.col("new_path").isNull(), "delete").otherwise("move")
    return changed.unionByName(pairs.select("repo", kind.alias("change_type"), "old_path", "new_path", "content_hash"))


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The index (repo, path, content_hash) after the changes."""
    gone = changes.where("old_path IS NOT NULL").select("repo", F.col("old_path").alias("path"))
    new = changes.where("new_path IS NOT NULL").select("repo", F.col("new_path").alias("path"), "content_hash")
    kept = files.select("repo", "path", "content_hash").join(gone, ["repo", "path"], "left_anti").join(new, ["repo", "path"], "left_anti")
    return kept.unionByName(new)


#: Kinds of facts that are declarations.
DECLARED = ["export_name", "rs_declare", "rs_mod", "import_name"]


def declaration_changes(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """repo, path, kind, old_name, new_name, change of the declarations in files whose content changed.

    before, after: blobs (repo, rev, path, text) of the two states; only changed files are parsed.
    """
    touched = changes.where("change_type = 'content_change'").select("repo", F.col("new_path").alias("path")).distinct()

    def spans(blobs: DataFrame) -> DataFrame:
        found = facts(blobs.join(touched, ["repo", "path"], "left_semi")).where(F.col("kind").isin(DECLARED))
        return found.select(F.to_json(F.struct("repo", "path")).alias("file"), "kind", F.col("value").alias("name"), F.col("span_start").cast("long").alias("span"))

    found = nearest_spans(spans(before), spans(after)).withColumn("f_", F.from_json("file", "repo string, path string"))
    return found.select("f_.repo", "f_.path", "kind", "old_name", "new_name", "change")


def watch(events: DataFrame, files_path: str, out_path: str, checkpoint: str, paused=lambda: False):
    """Start the query: each batch is classified against the index at `files_path`, changes go to `out_path`.

    Index versions are folders `v=<batch>`; a batch that runs again writes the same folders again. While paused,
    batches are read and dropped.
    """

    def each(batch: DataFrame, number: int) -> None:
        if paused():
            return
        spark = batch.sparkSession
        before = spark.read.parquet(files_path).where(F.col("v") < number)
        newest = before.agg(F.max("v")).first()[0]
        files = before.where(F.col("v") == newest)
        changes = classify(batch, files).persist()
        apply_changes(files, changes).write.mode("overwrite").parquet(f"{files_path}/v={number}")
        changes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        changes.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHECKOUTS = "seq long, repo string, rev string, sha string, local_path string"


def read_checkouts(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """The stream of an event table of checkouts: Parquet files that its writer adds."""
    return spark.readStream.schema(CHECKOUTS).option("maxFilesPerTrigger", per_batch).parquet(path)


def due_checkouts(events: DataFrame, scanned: DataFrame, sources: list[tuple[str, str]] = ()) -> DataFrame:
    """The newest event of each (repo, rev) whose commit is not the one scanned (repo, rev, sha).

    sources: (glob of repositories, glob of revisions), one of which must hold; none: all hold. A checkout without a commit is due.
    """
    if sources:
        events = events.where(reduce(lambda a, b: a | b, [compile_pattern(r).matches(F.col("repo")) & compile_pattern(v).matches(F.col("rev")) for r, v in sources]))
    last = events.groupBy("repo", "rev").agg(F.max_by(F.struct("seq", "sha", "local_path"), "seq").alias("e")).select("repo", "rev", "e.*")
    known = scanned.select("repo", "rev", F.col("sha").alias("known"))
    return last.join(known, ["repo", "rev"], "left").where("sha IS NULL OR known IS NULL OR sha <> known").drop("known")


def subscribe(events: DataFrame, scanned_path: str, scan, checkpoint: str, sources: list[tuple[str, str]] = (), paused=lambda: False):
    """Start the query: each batch gives its due checkouts to `scan`, then notes them as scanned, a folder a batch.

    A batch that runs again overwrites its folder; its checkouts are scanned again, so `scan` must bear that, as Engine.save does.
    """

    def each(batch: DataFrame, number: int) -> None:
        if paused():
            return
        spark = batch.sparkSession
        noted = spark.read.schema("repo string, rev string, sha string, batch long").parquet(scanned_path).where(F.col("batch") < number)
        due = due_checkouts(batch, noted.groupBy("repo", "rev").agg(F.max_by("sha", "batch").alias("sha")), sources).persist()
        if not due.isEmpty():
            scan(due)
            due.select("repo", "rev", "sha").write.mode("overwrite").parquet(f"{scanned_path}/batch={number}")
        due.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "100 milliseconds", late: str = "1 minute") -> DataFrame:
    """Bursts of events of a repository, parted by a quiet gap."""
    timed = events.withWatermark("event_ts", late) if events.isStreaming else events
    return timed.groupBy("repo", F.session_window("event_ts", gap).alias("w")).agg(F.count("*").alias("n")).select("repo", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
