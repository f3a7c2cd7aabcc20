"""Near-duplicate detection by min-max hashing.

Each document is the set of its word shingles. A permutation of the 32-bit hash space gives two signature values, the
least and the greatest image, so BANDS * ROWS values take half as many hash evaluations. Values are banded so that the
two of one permutation fall into different bands; at the threshold a linked pair misses every band with probability
(1 - t^ROWS)^BANDS, 1.5e-9 for the defaults.

Equal sets collapse to one representative first. Links are confirmed on full sets (64-bit shingle hashes), in two steps:

1. Stars. Each representative is compared with the least members (heads) of its buckets, the STARS heads that share
   most buckets with it. What links is joined into classes.
2. Buckets. A bucket whose members are all in one class has nothing left to find. In every other one, members outside
   its largest class are compared with each other and with that class, in pairs of blocks of at most BLOCK_DOCS
   documents or BLOCK_SHINGLES shingles, so no task holds more than two blocks and no pair is lost. Buckets with the same
   members are done once.

So a group of m copies costs a few rows a member, not its square; only documents that share buckets without being
linked are compared pair by pair. Classes are components by hooking to the least neighbour, pointer jumping and
contraction of the links, each round written to shared storage.

Edge cases: null, empty or all-white texts have the empty set and link with nothing, also not with each other; texts
with fewer words than a shingle are one shingle; repeated rows share a class. Rows that repeat an id with other texts
are classed each by its own text; where such an id stands for two sets, links of either count. A null id names no
document: its row takes the component of the documents with the same set, else null, and links with nothing else (such
rows all stay). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, lean, materialize, table

ROWS, BANDS = 8, 64
#: Heads that a representative is compared with at first, and members of one head that go to one task.
STARS, STAR_DOCS = 3, 64
#: A block of a bucket holds about so many documents and so many shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 500, 250_000
_LOW = str.maketrans(UPPER, LOWER)
_MEMO = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, memo: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    found = re.findall(WORD, (text or "").translate(_LOW))
    if not found:
        return np.empty(0, np.uint64)
    for word in set(found):
        if word not in memo:
            if len(memo) >= _MEMO:
                memo.clear()
                return shingles(text, words, memo) if len(set(found)) < _MEMO else shingles(text, words, _Unkept())
            memo[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    codes = np.fromiter((memo[w] for w in found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        size = min(words, len(codes))
        mixed = np.full(len(codes) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(mixed)])
    return np.unique(mixed)


class _Unkept(dict):
    """A memo that keeps nothing, for a text with more distinct words than the memo may hold."""

    def __missing__(self, word):
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")

    def __contains__(self, word):
        return True


def permutations(rows: int, bands: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = (rows * bands + 1) // 2
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_keys(own: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int, bands: int) -> bytes:
    """64-bit key of each band, as bytes. Bands of minima come first, then bands of maxima."""
    x = _mix(own).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 1024):
        image = a[:, None] * x[None, i : i + 1024] + b[:, None]
        np.minimum(low, image.min(1), out=low)
        np.maximum(high, image.max(1), out=high)
    both = np.concatenate([low, high])[: rows * bands].astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + both[:, k])
    return key.tobytes()


def signatures(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, mark (of the text), n (set size), digest (of the set), keys (array of band keys; null for the empty set)."""

    def run(batches):
        a, b = permutations(rows, bands)
        memo: dict[str, int] = {}
        last: tuple[bytes | None, object] = (None, None)
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), words, memo)
                mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if mark != last[0]:
                    last = mark, np.frombuffer(band_keys(own, a, b, rows, bands), np.int64) if len(own) else None
                n.append(len(own))
                digest.append(mark)
                keys.append(last[1])
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "digest", "keys"])

    marked = docs.select(F.col("doc_id").cast("long"), _mark(), "text")
    return marked.mapInArrow(lean(run), "doc_id long, mark long, n long, digest binary, keys array<long>")


def _mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark")


def components(links: DataFrame, tag: str) -> DataFrame:
    """id, root (least id reachable) of the nodes of the links (a, b) that are not roots themselves.

    Every node hooks to its least smaller neighbour; the trees are flattened by pointer jumping and the links contracted to
    their roots, until none is left. At most half of the nodes are roots after each round.
    """

    def between(edges: DataFrame) -> DataFrame:
        edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return materialize(edges, f"{tag}-links", rows)

    rows = links.count()
    edges, found = between(links), None
    while not edges.isEmpty():
        rows = edges.count()
        hook = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), f"{tag}-hooks", rows)
        while True:
            up = hook.select(F.col("id").alias("i_"), F.col("root").alias("r_"))
            flat = hook.join(up, F.col("root") == F.col("i_"), "left")
            flat = materialize(flat.select("id", F.coalesce("r_", "root").alias("root"), F.col("r_").isNotNull().alias("moved")), f"{tag}-flat", rows)
            hook = flat.select("id", "root")
            if flat.where("moved").isEmpty():
                break
        edges = between(_mapped(_mapped(edges, hook, "a"), hook, "b"))
        found = hook if found is None else materialize(_mapped(found, hook, "root").select("id", "root").unionByName(hook), f"{tag}-roots", rows)
    return found if found is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)


def _mapped(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """rows with the roots (id, root) of a column's ids in place of them."""
    to = roots.select(F.col("id").alias("i_"), F.col("root").alias("r_"))
    return rows.join(to, F.col(column) == F.col("i_"), "left").withColumn(column, F.coalesce("r_", column)).drop("i_", "r_")


def linked(one: np.ndarray, other: np.ndarray, share: int) -> bool:
    """Whether two sorted sets are alike enough."""
    if 100 * min(len(one), len(other)) < share * max(len(one), len(other)):
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= share * (len(one) + len(other) - both)


def joins(sets: list[np.ndarray], labels: list[int], first: list[bool] | None, share: int) -> list[tuple[int, int]]:
    """Pairs of labels that links join: among all sets, or (first given) between those of the first block and the others."""
    ask = range(len(sets)) if first is None else [i for i, x in enumerate(first) if x]
    among = list(ask) if first is None else [i for i, x in enumerate(first) if not x]
    sizes = np.array([len(sets[i]) for i in among], np.int64)
    flat = np.concatenate([sets[i] for i in among]) if among else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(among)), sizes)[order]
    root = {x: x for x in labels}
    left = len(root) - 1

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in ask:
        if not left:
            break
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        runs = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
        common = np.bincount(owner[at], minlength=len(among))
        for j in np.flatnonzero((common > 0) & (100 * common >= share * (sizes + len(sets[i]) - common))):
            x, y = find(labels[i]), find(labels[among[j]])
            if x != y:
                root[max(x, y)] = min(x, y)
                left -= 1
                out.append((max(x, y), min(x, y)))
    return out


def _rows(batches):
    """Rows of Arrow batches, one at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _links(pairs):
    for i in range(0, len(pairs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs[i : i + 100_000], strict=True)], names=["a", "b"])


def stars(shared: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) of representatives with the heads that share most buckets with them. shared: rep, key, head."""
    most = Window.partitionBy("rep").orderBy(F.desc("m"), "head")
    tries = shared.where("rep <> head").groupBy("rep", "head").agg(F.count("*").alias("m"))
    tries = materialize(tries.withColumn("k", F.row_number().over(most)).where(F.col("k") <= STARS).select("rep", "head"), "near-tries")
    # A head that a third of all documents share is dealt over as many tasks as its members need.
    per = materialize(tries.groupBy("head").agg(F.ceil(F.count("*") / STAR_DOCS).alias("parts")), "near-heads", tries.count())
    members = tries.join(per, "head").select("head", F.pmod(F.xxhash64("rep"), "parts").alias("part"), "rep")
    hubs = per.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = members.join(sets, F.col("rep") == F.col("node")).select("head", "part", "rep", "set")
    rows = rows.unionByName(hubs.join(sets, F.col("head") == F.col("node")).select("head", "part", F.lit(None).cast("long").alias("rep"), "set"))

    def run(batches):
        found = []
        for _, group in groupby(_rows(batches), key=lambda r: r[:2]):
            heads = []
            for head, _, rep, raw in group:
                own = np.frombuffer(raw, np.uint64)
                if rep is None:  # heads come first
                    heads.append(own)
                elif any(linked(own, other, share) for other in heads):
                    found.append((rep, head))
            if len(found) >= 100_000:
                yield from _links(found)
                found = []
        yield from _links(found)

    dealt = rows.repartition("head", "part").sortWithinPartitions("head", "part", F.asc_nulls_first("rep"))
    return dealt.mapInArrow(lean(run), "a long, b long")


def across(labelled: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between classes of one bucket, whole and exact. labelled: key, rep, n, label."""
    sums = labelled.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.bit_xor(F.xxhash64("rep")).alias("f"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("g"))
    sums = materialize(sums, "near-sums")
    largest = F.max_by("label", F.struct("m", "all", "label"))
    each = sums.groupBy("key").agg(largest.alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("m").alias("main_m"), F.sum("m").alias("m"), F.sum("all").alias("all"), F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"))
    # Buckets with the same members find the same.
    once = each.where("lo <> hi").groupBy("f", "g", "m").agg(F.min("key").alias("key")).select("key")
    parts = lambda m, whole: F.greatest(F.lit(1), F.ceil(F.greatest(m / BLOCK_DOCS, whole / BLOCK_SHINGLES))).cast("int")
    other, main = F.col("label") != F.col("main"), F.col("label") == F.col("main")
    open_ = sums.join(each.where("lo <> hi").select("key", "main").join(once, "key"), "key").groupBy("key", "main").agg(
        parts(F.sum(F.when(other, F.col("m")).otherwise(0)), F.sum(F.when(other, F.col("all")).otherwise(0))).alias("others"), parts(F.sum(F.when(main, F.col("m")).otherwise(0)), F.sum(F.when(main, F.col("all")).otherwise(0))).alias("mains")
    )
    open_ = materialize(open_, "near-open")
    rows = labelled.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.when(other, F.col("others")).otherwise(F.col("mains"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # Blocks of the largest class are numbered from -1 downwards.
    own = F.transform(upto("others"), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    to_main = F.transform(upto("mains"), lambda o: F.struct(F.col("block").alias("x"), (-1 - o).alias("y")))
    from_main = F.transform(upto("others"), lambda o: F.struct(o.alias("x"), (-1 - F.col("block")).alias("y")))
    rows = rows.select("key", "rep", "label", F.when(other, F.col("block")).otherwise(-1 - F.col("block")).alias("own"), F.explode(F.when(other, F.concat(own, to_main)).otherwise(from_main)).alias("pair"))
    rows = rows.join(sets, F.col("rep") == F.col("node")).select("key", "pair.x", "pair.y", "own", "label", "set")

    def run(batches):
        found = []
        for (_, x, y), group in groupby(_rows(batches), key=lambda r: r[:3]):
            blocks, labels, raw = zip(*(r[3:] for r in group), strict=True)
            found += joins([np.frombuffer(r, np.uint64) for r in raw], labels, None if x == y else [b == x for b in blocks], share)
            if len(found) >= 100_000:
                yield from _links(found)
                found = []
        yield from _links(found)

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lean(run), "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, set (its sorted 64-bit shingle hashes) of the documents among `nodes` (rep)."""

    def run(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), words, memo).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "set"])

    return docs.join(nodes, F.col("doc_id") == F.col("rep")).select("doc_id", "text").mapInArrow(lean(run), "node long, set binary")


def _classed(docs: DataFrame, words: int, share: int, rows: int, bands: int) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, component_id."""
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    signed = materialize(signatures(plain, words, rows, bands), "near-signed")
    n = signed.count()
    reps = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = materialize(reps.where("rep IS NOT NULL"), "near-classes", 16 * n)
    keyed = reps.select("rep", "n", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head <> last").select("key", "head")
    shared = materialize(keyed.join(materialize(heads, "near-buckets", bands * n), "key").select("key", "rep", "n", "head"), "near-shared", bands * n)
    sets = materialize(shingle_sets(plain, shared.select("rep").distinct(), words), "near-sets")
    label = components(materialize(stars(shared, sets, share), "near-stars"), "near-star")
    labelled = materialize(_mapped(shared.select("key", "rep", "n", F.col("rep").alias("label")), label, "label"), "near-labelled", bands * n)
    more = components(materialize(across(labelled, sets, share), "near-across"), "near-class")
    label = materialize(_mapped(_mapped(reps.select("digest", F.col("rep").alias("component_id")), label, "component_id"), more, "component_id"), "near-labels", n)
    out = signed.select("doc_id", "mark", "n", "digest").join(label, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"))


def classes(docs: DataFrame, words: int = 3, share: int = 85, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. share: least similarity in hundredths."""
    found = _classed(docs, words, share, rows, bands)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, share: int = 80, rows: int = 7, bands: int = BANDS) -> DataFrame:
    """The documents that stay, one of each group, all columns as they were."""
    kept = _classed(docs, words, share, rows, bands).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("k_"), F.col("mark").alias("m_")).distinct()
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["k_"]) & (mark == kept["m_"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, greatest(2, len(l) - 1))) AS i FROM w WHERE len(l) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 3 THEN array_to_string(l, ' ') ELSE l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] END AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(id, z) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.z = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(z) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
