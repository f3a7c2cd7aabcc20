"""Shared pieces of the training-data operators: table access, shared scratch space, prefix sums."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import new_path, settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_FILE = 1_000_000


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    rows: about how many narrow rows there are; they then go to files of ROWS_A_FILE rows, eight files at least, where
    the shuffle before would leave a small file per partition.
    """
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // ROWS_A_FILE)))
    return settled(df, tag)


#: What a Python worker makes rows, lists and sets of at a time. Spark's batches have 10,000 rows, of any length.
PART_BYTES = 4 << 20


def parts(batches):
    """Arrow batches cut into parts of about PART_BYTES, a row at least; no row is lost, the order stays."""
    for batch in batches:
        step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lean(run):
    """A function for mapInArrow that gives `run` parts of batches and, when a task ends, freed memory back to the system.

    Workers outlive their tasks, and what their allocators keep counts beside the executor's heap.
    """

    def whole(batches):
        try:
            yield from run(parts(batches))
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have no such function
    if trim:
        trim(0)


def ascii_lower(column):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def held_out(doc_id="doc_id"):
    """True for the rows kept out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def prefixed(df: DataFrame, order, sums: dict[str, str], index: str, tag: str, parts: int = 32) -> DataFrame:
    """Add a dense 0-based `index` in the given order and, for each out -> in of `sums`, the sum of all rows before.

    Rows are dealt by range; only one row per range meets in a single task.
    """
    pid = f"{index}_pid"
    dealt = materialize(df.repartitionByRange(parts, order).withColumn(pid, F.spark_partition_id()), tag)
    inside = Window.partitionBy(pid).orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(pid).agg(F.count("*").alias("n_"), *[F.sum(v).alias(f"{k}_t") for k, v in sums.items()])
    base = totals.select(
        pid,
        F.coalesce(F.sum("n_").over(across), F.lit(0)).alias("n_b"),
        *[F.coalesce(F.sum(f"{k}_t").over(across), F.lit(0)).alias(f"{k}_b") for k in sums],
    )
    ranked = dealt.select(
        "*",
        (F.row_number().over(inside) - 1).alias("n_i"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{k}_i") for k, v in sums.items()],
    )
    joined = ranked.join(base, pid)
    return joined.select(
        *df.columns, (F.col("n_i") + F.col("n_b")).cast("long").alias(index), *[(F.col(f"{k}_i") + F.col(f"{k}_b")).cast("long").alias(k) for k in sums]
    )
