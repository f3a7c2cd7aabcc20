"""The pipeline's rows against a plain version of each stage."""

import hashlib
import os

import pyarrow as pa
import pytest

import corpus_pipeline
from factweave.llm import bpe, mixing, near_dedup, quality
from factweave.llm.common import LOWER, PART_BYTES, UPPER, lean

from .test_operators import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_equals_plain_stages(spark):
    tiktoken = pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}

    good = {i: t for i, t in rows.items() if model.score(*quality.features(t, {})) >= 0.5}
    newest = {}
    for i, t in sorted(good.items()):
        newest[t.translate(str.maketrans(UPPER, LOWER))] = i
    single = {i: good[i] for i in newest.values()}
    groups = brute_classes([(i, t, None) for i, t in single.items()], 5, 80)
    heads = {i for i, (n, root) in groups.items() if n == 0 or root == i}
    left = docs.where(docs["doc_id"].isin(sorted(heads)))
    mixed = {r.doc_id for r in mixing.mix(left).where("taken > 0").collect()}

    codec = bpe.codec(*bpe.vocabulary())
    other = tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    want = set()
    for i in mixed:
        ids = other.encode_ordinary(rows[i])
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


ODD = [(1, "good words in a line", "a", 20), (1, "good words in a line", "a", 20), (1, "other words", "a", None), (None, None, None, None), (None, "no id", None, 5), (3, "", "b", 0), (4, " \n", "b", 2), (5, "word " * 30_000, "b", 150_000), (6, "GOOD words in a line", "a", 20)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_an_empty_table(spark, name):
    """Nulls, empty and long texts, repeated rows, columns with names that stages use inside, and no rows at all."""
    from collections import Counter

    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("h", "norm", "size", "mark", "keep_id", "block", "n", "digest", "y", "score", "k_", "n_")})
    got = [(r.doc_id, r.text if "text" in r else None) for r in stage(spark, docs, SF).collect()] if name != "encoding" else stage(spark, docs, SF).collect()
    rows = Counter((i, t) for i, t, *_ in ODD)
    if name == "quality":  # no labelled rows here: the smoothed share keeps every row
        assert Counter(got) == rows
    elif name == "exact dedup":
        assert Counter(got) == Counter([(1, "other words"), (None, "no id"), (3, ""), (4, " \n"), (5, "word " * 30_000), (6, "GOOD words in a line")])
    elif name == "near dedup":
        assert Counter(got) == rows - Counter([(6, "GOOD words in a line")])
    elif name == "mixing":
        left = Counter(got)
        assert left.keys() <= rows.keys() and not {t for _, t in left} & {None, "", " \n"} and all(n <= 3 * rows[r] for r, n in left.items())
    else:
        assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert stage(spark, docs.limit(0), SF).count() == 0


def worker_mb(spark) -> dict[int, float]:
    """MB of the Python workers by process, without mapped files."""

    def run(batches):
        import re
        import time

        for _ in batches:
            time.sleep(0.5)  # so that each task has a worker of its own
            with open("/proc/self/smaps_rollup") as f:
                held = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held])], names=["pid", "mb"])

    return {r.pid: r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(run, "pid long, mb double").collect()}


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_workers_give_memory_back(spark):
    """Long texts in one batch: their sets are made in parts, and a worker keeps none of it once its task is over."""
    from pyspark.sql import functions as F

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 + i) % 5000)), " ")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    worker_mb(spark)
    before = worker_mb(spark)
    assert near_dedup.shingle_sets(docs, docs.select(F.col("doc_id").alias("rep")).hint("broadcast"), 3).agg(F.sum(F.length("set"))).first()[0] == 4000 * 1998 * 8
    after = worker_mb(spark)
    assert sum(after.values()) - sum(before.get(p, 40) for p in after) < 20


def test_parts_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x" * 5000] * 3000)], names=["id", "text"])
    wide = pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(["y" * (2 * PART_BYTES)])], names=["id", "text"])
    seen = []

    def run(batches):
        for b in batches:
            seen.append(b.nbytes)
            yield b

    out = list(lean(run)([batch, batch.slice(0, 0), wide]))
    assert [i for b in out for i in b.column(0).to_pylist()] == [*range(3000), -1]
    assert len(seen) > 3 and max(seen[:-1]) <= PART_BYTES
