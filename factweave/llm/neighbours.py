"""Nearest neighbours by multi-index hashing.

Vectors get a coordinate that makes all norms equal (so the largest inner product is the least angle), are rotated by
a rotation learned by iterative quantisation on at most SAMPLE vectors, and their signs form a BITS-bit code. Each
shard of at most SHARD rows indexes PARTS substrings of its codes. Two codes within Hamming radius r agree in some
substring up to r // PARTS bits, so probing every substring's values within that distance retrieves every code within
r; candidates are checked on the whole code and reranked by inner products in double precision.

The radius is fitted on the sample: it covers RECALL of the true neighbours there, and a few bits are added. Should a
query find fewer than k codes in a shard, the shard's next radius is tried until it has k or has seen every row.
A shard is indexed once for BLOCK queries, which stream past it; k rows a query and shard come out. Rows are dealt to
shards by row, not by id, so an id that many rows share fills no shard.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, as queries or as candidates; rows that repeat an id are one candidate each, and none is found for its own id; as
queries, rows that repeat id and vector are one query, and an id with several vectors is a query for each of them; equal
vectors tie and the smaller id comes first; fewer candidates than k give fewer rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

BITS, PARTS, SAMPLE, SHARD, BLOCK, RECALL, SPARE = 64, 4, 4000, 8192, 32_768, 0.99, 2
ROUNDS = 20
_PLACES = np.uint64(1) << (np.uint64(16) * np.arange(4, dtype=np.uint64))
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


class Coder:
    """Learned rotation and the codes it gives."""

    def __init__(self, sample: np.ndarray, norm: float, bits: int = BITS):
        self.norm, self.bits = norm, bits
        x = self.lift(sample)
        self.mean = x.mean(0)
        rng = np.random.default_rng(11)
        x = x - self.mean
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        width = min(bits, len(axes))
        self.axes = axes[:width].T
        y = x @ self.axes
        self.turn = np.linalg.qr(rng.normal(size=(width, bits)).T)[0].T if bits > width else np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS if bits <= width else 0):
            u, _, w = np.linalg.svd(np.where(y @ self.turn > 0, 1.0, -1.0).T @ y, full_matrices=False)
            self.turn = (u @ w).T

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.column_stack([x, rest]) / self.norm

    def codes(self, x: np.ndarray) -> np.ndarray:
        """PARTS substrings of 16 bits per row."""
        signs = (self.lift(x) - self.mean) @ self.axes @ self.turn > 0
        if signs.shape[1] < self.bits:
            signs = np.pad(signs, ((0, 0), (0, self.bits - signs.shape[1])))
        return np.packbits(signs.reshape(len(x), self.bits // 16, 16), axis=2).view(">u2")[:, :, 0].astype(np.uint16)


def distances(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return _POP[codes ^ code].sum(1, dtype=np.int64)


class Index:
    """The substrings of one shard's codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.codes = ids, vectors, coder.codes(vectors)
        self.longest = math.sqrt(float((vectors * vectors).sum(1).max()))
        self.whole = self.codes.astype(np.uint64) @ _PLACES[: self.codes.shape[1]]
        self.parts = []
        for p in range(self.codes.shape[1]):
            values, where = np.unique(self.codes[:, p], return_inverse=True)
            order = np.argsort(where, kind="stable")
            self.parts.append((values, where, order, np.r_[0, np.cumsum(np.bincount(where, minlength=len(values)))]))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within the radius: pigeonhole probing of every substring, then the whole code."""
        near = np.zeros(len(self.ids), bool)
        for p, (values, where, order, ends) in enumerate(self.parts):
            close = _POP[values ^ code[p]] <= radius // len(self.parts)
            hit = np.flatnonzero(close)
            if len(hit) == len(values):
                near[:] = True
                break
            if len(hit) <= 16:  # few buckets: their rows; many: one pass over the rows' buckets
                for h in hit:
                    near[order[ends[h] : ends[h + 1]]] = True
            else:
                near |= close[where]
        rows = np.flatnonzero(near)
        whole = code.astype(np.uint64) @ _PLACES[: len(code)]
        return rows[np.bitwise_count(self.whole[rows] ^ whole) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int):
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= min(k, len(self.ids) - 1) or radius >= 16 * len(self.parts):
                break
            radius += len(self.parts)
        # One product finds all that can be among the k; their scores are then summed row by row, so equal vectors tie.
        rough = (self.vectors @ vector)[rows] if 2 * len(rows) > len(self.ids) else self.vectors[rows] @ vector
        if len(rows) > k:
            least = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= least - 1e-10 * self.longest * math.sqrt(float(vector @ vector))]
        scores = (self.vectors[rows] * vector).sum(1)
        best = np.lexsort([self.ids[rows], -scores])[:k]
        return self.ids[rows[best]], scores[best]


def fit(vectors: DataFrame, sample: int = SAMPLE, k: int = 20) -> tuple[Coder, int] | None:
    """The coder and the radius, from at most `sample` vectors of least hash; the norm covers all rows."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    norm = vectors.agg(F.max(square)).first()[0]
    if norm is None:
        return None
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r["v"] for r in got])
    coder = Coder(x, math.sqrt(norm) * (1 + 1e-9))
    codes, seen = coder.codes(x), []
    for i in range(0, len(x), max(1, len(x) // 200)):
        scores = (x * x[i]).sum(1)
        scores[i] = -np.inf
        top = np.argsort(-scores)[: min(k, len(x) - 1)]
        seen.extend(distances(codes[i], codes[top]))
    radius = int(np.quantile(seen, RECALL)) + SPARE if seen else BITS
    return coder, radius


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but its own id. Both inputs as `usable` gives them."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    queries = materialize(queries.groupBy("vec_id", "v").agg(F.count("*").alias("rows")).withColumn("q", F.monotonically_increasing_id()), "ann-queries")
    # Vectors of the commonest length take part; another length has no inner product with them.
    width = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], schema)
    width = width["w"]
    vectors, queries = (x.where(F.size("v") == width) for x in (vectors, queries))
    model = fit(vectors, k=k)
    shards = max(1, math.ceil(vectors.count() / shard))
    blocks = max(1, math.ceil(queries.count() / block))
    held = spark.sparkContext.broadcast(model)
    none = F.lit(None).cast("long").alias("q")
    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), none, "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b"), "q", "vec_id", "v")

    def find(batches):
        coder, radius = held.value
        key, ids, rows, index = None, [], [], None
        for batch in batches:
            s, b = (batch.column(i).to_numpy() for i in (0, 1))
            q = batch.column(2).fill_null(-1).to_numpy()
            vec_id, v = batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy().reshape(-1, width)
            cuts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1]) | ((q[1:] < 0) != (q[:-1] < 0)), True]) if len(s) else []
            out = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if (s[i], b[i]) != key:
                    key, ids, rows, index = (s[i], b[i]), [], [], None
                if q[i] < 0:  # the shard's rows come first
                    ids.append(vec_id[i:j])
                    rows.append(v[i:j])
                    continue
                if index is None and ids:
                    index, ids, rows = Index(np.concatenate(ids), np.concatenate(rows), coder), [], []
                if index is None:
                    continue
                for n, code in zip(range(i, j), coder.codes(v[i:j]), strict=True):
                    near, scores = index.nearest(vec_id[n], v[n], code, radius, k)
                    out.append((np.full(len(near), q[n]), np.full(len(near), vec_id[n]), near, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "query_id", "vec_id", "score"])

    rows = dealt.unionByName(asked).repartition("s", "b").sortWithinPartitions("s", "b", F.asc_nulls_first("q"))
    found = rows.mapInArrow(find, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 20 = 0"))
