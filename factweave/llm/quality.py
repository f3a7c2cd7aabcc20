"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the number of features.
Labels are learned from at most SAMPLE labelled rows (those of least hash of the id), never from held-out rows; every
document is scored, over its whole text. The metadata is n_chars: whether it is there, its size, and how far it agrees
with the text. Labels, lang, source and doc_id never enter a score.

Edge cases: null or empty text is scored like any other, from its length features; a null n_chars is a value of its own,
a table without the column counts as one where it agrees; rows that repeat an id are scored each; if no labelled row may be learned from, or all have one label, scores are that label's smoothed share;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, table

SAMPLE, DIM, RANK, EPOCHS, RATE = 8000, 1 << 16, 8, 6, 0.1
BINS = np.array([0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
PARTS, KINDS, STATS = 8, 9, 32
WIDTH = DIM + STATS * 16
_MEMO = 150_000

_KIND = np.full(256, 8, np.int64)
for _k, _chars in enumerate([bytes(range(97, 123)), bytes(range(65, 91)), b" \t\r\n\x0b\x0c", b"0123456789", b".,;:?'\"-()", b"!", b"#$%&*@^~", b"|"]):
    _KIND[list(_chars)] = _k


def statistics(text: str, words: list[str]) -> list[float]:
    """Shares between 0 and 1: character kinds overall and at their most in a part of the text, repetition, lengths."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = max(1, len(raw)), len(words)
    part = np.arange(len(raw)) * PARTS // n
    kinds = np.bincount(_KIND[raw] + KINDS * part, minlength=KINDS * PARTS).reshape(PARTS, KINDS) if len(raw) else np.zeros((PARTS, KINDS))
    most = (kinds / np.maximum(1, kinds.sum(1, keepdims=True))).max(0)
    step = max(1, -(-m // PARTS))
    variety = min((len(set(words[i : i + step])) / len(words[i : i + step]) for i in range(0, m, step)), default=1.0)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *(kinds.sum(0) / n),
        *most,
        variety,
        len(set(words)) / max(1, m),
        len(set(zip(words, words[1:], strict=False))) / max(1, m - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, m),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log2(1 + len(raw)) / 24),
        min(1.0, np.log2(1 + m) / 20),
        min(1.0, np.log2(1 + len(lines)) / 16),
        min(1.0, len(raw) / max(1, m) / 20),
    ]


def metadata(text: str, n_chars: int | None) -> list[float]:
    """Shares between 0 and 1: whether n_chars is known, its size, and how far it agrees with the text. -1: not given."""
    own = len(text)
    told = own if n_chars == -1 else n_chars
    if told is None or told < 0:
        return [float(told is not None), 0.0, 0.0]
    return [1.0, min(1.0, np.log2(1 + told) / 24), min(own + 1, told + 1) / max(own + 1, told + 1)]


def features(text: str | None, memo: dict[str, int], n_chars: int | None = -1) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero features."""
    text = text or ""
    words = text.split()
    seen = set(words)
    codes = []
    for word in seen:
        code = memo.get(word)
        if code is None:
            code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % DIM
            if len(memo) < _MEMO:
                memo[word] = code
        codes.append(code)
    stats = np.array(statistics(text, words) + metadata(text, n_chars))
    own = DIM + np.arange(len(stats)) * 16 + np.digitize(stats, BINS)
    index = np.concatenate([np.array(codes, np.int64), own])
    value = np.concatenate([np.full(len(codes), 1 / np.sqrt(max(1, len(codes)))), np.full(len(own), 0.5)])
    return index, value


class Machine:
    def __init__(self, seed: int = 3):
        self.w0, self.w = 0.0, np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, RANK))

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        xv = self.v[index] * value[:, None]
        sums = xv.sum(0)
        return self.w0 + self.w[index] @ value + 0.5 * float((sums * sums).sum() - (xv * xv).sum())

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Machine:
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.w0 = float(np.log(share / (1 - share)))
        if len(set(labels.tolist())) < 2:
            return self
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1.0, np.ones(WIDTH), np.ones((WIDTH, RANK))
        for _ in range(max(EPOCHS, min(60, 12_000 // len(rows)))):
            for r in rng.permutation(len(rows)):
                index, value = rows[r]
                xv = self.v[index] * value[:, None]
                sums = xv.sum(0)
                at = self.w0 + self.w[index] @ value + 0.5 * float((sums * sums).sum() - (xv * xv).sum())
                error = 1 / (1 + np.exp(-np.clip(at, -35, 35))) - labels[r]
                g0 += error * error
                self.w0 -= RATE * error / np.sqrt(g0)
                dw = error * value + 1e-5 * self.w[index]
                gw[index] += dw * dw
                self.w[index] -= RATE * 3 * dw / np.sqrt(gw[index])
                dv = error * (value[:, None] * sums - xv * value[:, None]) + 1e-5 * self.v[index]
                gv[index] += dv * dv
                self.v[index] -= RATE * dv / np.sqrt(gv[index])
        return self


def training(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """l_id, text, y and n_chars of at most `sample` labelled rows that are not held out. The bounded id list is what is broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out("l_id")).orderBy(F.xxhash64("l_id"), "l_id", "y").limit(sample)
    return docs.select("doc_id", "text", _n_chars(docs)).join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("l_id", "text", "y", "n_chars")


def _n_chars(docs: DataFrame):
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(-1).cast("long")).alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    def run(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            both = [features(t.as_py(), memo, n) for t, n in zip(batch.column(1), batch.column(3).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(2), pa.array([i.astype(np.int32) for i, _ in both], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in both], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "i", "v"])

    got = training(docs, labels, "quality", sample).withColumn("l_id", F.col("l_id").cast("long")).mapInArrow(run, "id long, y int, i array<int>, v array<float>").toArrow()
    order = np.lexsort([got["y"].to_numpy(), got["id"].to_numpy()]) if len(got) else []
    ids, values, y = got["i"].to_pylist(), got["v"].to_pylist(), got["y"].to_numpy()
    rows = [(np.array(ids[r], np.int64), np.array(values[r])) for r in order]
    return Machine().fit(rows, y[order].astype(float) if len(got) else np.zeros(0))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def run(batches):
        own = Machine.__new__(Machine)
        own.w0, own.w, own.v = held.value
        memo: dict[str, int] = {}
        for batch in batches:
            scores = [own.score(*features(t.as_py(), memo, n)) for t, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text", _n_chars(docs)).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is at least 0.5, all columns as they were; each row by its own text, in one pass without a shuffle."""
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))
    text, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        own = Machine.__new__(Machine)
        own.w0, own.w, own.v = held.value
        memo: dict[str, int] = {}
        for batch in batches:
            sizes = [-1] * batch.num_rows if size is None else batch.column(size).to_pylist()
            good = [own.score(*features(t.as_py(), memo, n)) >= 0.5 for t, n in zip(batch.column(text), sizes, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
