"""Exact deduplication over an extendible-hash index kept as files in the shared folder.

Texts are compared byte for byte after lower-casing A-Z. A text's 64-bit hash picks its bucket by leading bits. The
directory starts at the depth the number of texts asks for and doubles while a bucket is overfull; only overfull buckets
split. Its rows are the slots of the first depth, each with the buckets below it. Texts of one bucket whose hashes
collide form a chain, which cannot split. Owner tasks process ranges of hashes.

Building: copies collapse before the shuffle (the grouping key is the text itself, so grouping compares bytes), which
also keeps a text that a third of all rows share from filling one task. Looking up: a row's hash leads through the
directory to its bucket and there to its chain. In a chain of one, the row's text can only be that one, as the index
holds every text that is looked up; in a longer chain the row's bytes are compared with those of each entry.

Native: DataFrame functions only.

Edge cases: null text counts as empty, and empty texts equal each other. Rows that repeat an id are one document: each
carries the decision of its own text. A null id sorts below every other id. An empty table gives an empty result. Extra
columns of the input are ignored here, whatever their names; `deduplicate` returns them untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, new_path, table

BUCKET_ROWS = 4096
HASH_BITS = 64


@dataclass
class Index:
    """entries: depth, prefix (the bucket), h, chain (place), chained (length), sha, norm (where chained > 1), keep_id, group_size.

    directory: slot (leading `first` bits), buckets (array of depth and prefix). collided: h of chains above one, or None.
    """

    entries: DataFrame
    directory: DataFrame
    first: int
    bits: int
    collided: DataFrame | None


def _rows(docs: DataFrame, hash_bits: int) -> DataFrame:
    norm = ascii_lower(F.col("text"))
    return docs.select(F.col("doc_id"), norm.alias("norm")).withColumn("h", F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("norm"))


def _prefix(h, depth, bits: int):
    """The leading `depth` bits (a column) of the hash."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, F.lit(bits) - depth))


def directory(hashes: DataFrame, n: int, bucket_rows: int, bits: int) -> tuple[DataFrame, int]:
    """The directory over the hashes (h, a row per text) and its first depth. Each pass splits the overfull buckets only."""
    first = depth = min(bits, max(0, math.ceil(math.log2(max(1, n / bucket_rows)))))
    buckets, pending = None, hashes
    while True:
        held = pending.groupBy(_prefix(F.col("h"), F.lit(depth), bits).alias("prefix")).agg(F.count("*").alias("n_in"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        over = (F.col("n_in") > bucket_rows) & (F.col("lo") < F.col("hi")) & F.lit(depth < bits)
        held = materialize(held.select("prefix", F.lit(depth).alias("depth"), over.alias("over")), "dedup-buckets", n // bucket_rows)
        full = held.where("NOT over").select("depth", "prefix")
        buckets = full if buckets is None else buckets.unionByName(full)
        split = held.where("over").select(F.col("prefix").alias("p_"))
        if split.isEmpty():
            break
        pending = pending.join(split, _prefix(F.col("h"), F.lit(depth), bits) == F.col("p_"), "left_semi")
        depth += 1
    slot = F.call_function("shiftrightunsigned", F.col("prefix"), F.col("depth") - first)
    slots = buckets.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("depth", "prefix")).alias("buckets"))
    return materialize(slots, "dedup-directory", n // bucket_rows), first


def seek(rows: DataFrame, slots: DataFrame, first: int, bits: int) -> DataFrame:
    """rows (with h) and the bucket that the directory names for their hash: depth, prefix."""
    found = rows.join(slots, _prefix(F.col("h"), F.lit(first), bits) == F.col("slot"))
    own = F.get(F.filter("buckets", lambda b: _prefix(F.col("h"), b["depth"], bits) == b["prefix"]), F.lit(0))
    return found.select(*rows.columns, own["depth"].alias("depth"), own["prefix"].alias("prefix"))


def build_index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, hash_bits: int = HASH_BITS) -> Index:
    """The index of all distinct texts."""
    spark = docs.sparkSession
    rows = _rows(docs, hash_bits)
    distinct = rows.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = materialize(distinct.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size"), "dedup-entries")
    n = entries.count()
    slots, first = directory(entries.select("h"), n, bucket_rows, hash_bits)
    collided = materialize(entries.groupBy("h").count().where("count > 1").select("h"), "dedup-collided", n // bucket_rows)
    collided = None if collided.isEmpty() else collided
    path = new_path(spark, "dedup-index")
    owners = max(1, min(4096, math.ceil(n / bucket_rows)))
    chain = Window.partitionBy("h")
    placed = seek(entries, slots, first, hash_bits).repartitionByRange(owners, "h")
    placed = placed.withColumn("chain", F.row_number().over(chain.orderBy("sha"))).withColumn("chained", F.count("*").over(chain))
    if collided is None:
        placed = placed.withColumn("norm", F.lit(None).cast("string"))
    else:
        texts = rows.join(collided, "h", "left_semi").select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm").distinct()
        placed = placed.join(texts, ["h", "sha"], "left")
    placed.write.option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(placed.schema).parquet(path), slots, first, hash_bits, collided)


def look_up(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, keep_id, group_size, text_sha256, depth, prefix, chain of each row, found through directory, bucket and chain."""
    rows = _rows(docs, index.bits)
    found = ["doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), "depth", "prefix", "chain"]
    at = ["depth", "prefix", "h"]
    out = seek(rows.select("doc_id", "h"), index.directory, index.first, index.bits).join(index.entries.where("chained = 1"), at).select(*found)
    if index.collided is None:
        return out
    probe = seek(rows.join(index.collided, "h", "left_semi").select("doc_id", "h", F.col("norm").alias("own_")), index.directory, index.first, index.bits)
    many = probe.join(index.entries.where("chained > 1"), at).where(F.col("own_").cast("binary") == F.col("norm").cast("binary"))
    return out.unionByName(many.select(*found))


def assign(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, hash_bits: int = HASH_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and where the index holds the text: depth, prefix, chain."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return look_up(docs, build_index(docs, bucket_rows, hash_bits)).select("doc_id", "keep_id", "group_size", kept, "text_sha256", "depth", "prefix", "chain")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns as they were."""
    keep = build_index(docs).entries.select(F.col("keep_id").alias("k_"), F.col("sha").alias("s_"))
    sha = F.sha2(ascii_lower(docs["text"]).cast("binary"), 256)
    return docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep["k_"]) & (sha == keep["s_"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).drop("depth", "prefix", "chain")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
