"""Mixing sources to target weights by blocks.

The words of each source form one stream, packed into blocks of BLOCK words. The mix is a row of output slots in
shards of SHARD slots. Each shard's source counts are a multinomial draw conditioned on the sources' totals, so that
exactly the slots that a source's target asks for are dealt out: free multinomial totals stray by their square root and
pass the three-fold limit. The draw is made by a pseudorandom permutation of all slots, whose counts per shard are what
the next step reads. A shard's slots of a source take the next indices of that source's sequence; the k-th index is
block perm(k mod blocks), perm being the source's own permutation, so a block comes again only once all have been used.
Places within a shard are permuted, too. Blocks are joined to slots by (source, block); what a document takes is counted
from the joined rows.

Documents stand in the stream in the order of a hash, and the last, incomplete round permutes only the first blocks of
the stream: a document is drawn whole or not at all in it, but for those at its end. take() can thus give out whole
documents in the same shares. Permutations are swap-or-not networks, exact on any size and computed without state:
reruns agree. As totals are fixed, the size of shards moves words between shards but changes no total.

Native: DataFrame functions only. Prefix sums run in two levels of about sqrt(rows) rows each, so that a source with
a third of all rows is dealt over many tasks, and a long document's blocks are rows of their own.

Edge cases: null or empty text has size 0 and takes nothing; a null source is a source, last in order; an empty table
gives an empty result; repeated rows and rows of a null id are mixed as separate documents; documents of equal size and
equal hash tie and stand in any order, with equal figures; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, prefixed, table

BLOCK, SHARD, SEED, ROUNDS, MOST = 64, 4096, 17, 24, 3
CHUNK = 4096


def permuted(x, n, *seed):
    """Swap-or-not: a keyed permutation of 0..n-1 applied to x."""

    def step(at, i):
        other = F.pmod(F.pmod(F.xxhash64(*seed, i), n) + n - at, n)
        return F.when(F.xxhash64(*seed, i, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    # Never null, and known as such: a join on it needs no filter that would work it out a second time.
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step), F.lit(-1).cast("long"))


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, src (rank by code point, null last), target: shares by weight, at most `most` sizes each."""
    n = sizes.count()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = prefixed(per, F.asc_nulls_last("source"), {}, "src", "mix-sources")
    src = materialize(src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most), "mix-weights", n)
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # sources above their limit stop there, the rest share what is left by weight
        capped = F.col("cap") <= F.col("w") * F.lit(level)
        c, w, n = src.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w"))), F.count_if(capped)).first()
        if n == full or not w:
            break
        level, full = (total - (c or 0)) / w, n
    return src.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(float(level))))


def draws(src: DataFrame, block: int) -> DataFrame:
    """src, blocks, draws (slots that the target asks for), first_draw (of the row of all sources' slots)."""
    plan = src.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("draws", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    plan = prefixed(plan, F.asc("src"), {"first_draw": "draws"}, "place", "mix-plan")
    return materialize(plan.where("draws > 0").select("src", "blocks", "draws", "first_draw"), "mix-draws", src.count())


def _tasks(plan: DataFrame) -> tuple[int, int]:
    """The number of slots, and how many tasks deal them."""
    total = plan.agg(F.sum("draws")).first()[0] or 0
    return total, max(1, min(20_000, math.ceil(total / (16 * CHUNK))))


def shard_counts(plan: DataFrame, shard: int, seed: int) -> DataFrame:
    """shard, src, n (its slots of the source), start (index of the first in the source's sequence), offset (in the shard)."""
    total, tasks = _tasks(plan)
    wide = plan.select("src", "draws", "first_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / CHUNK))).alias("chunk"))
    # The plan is tiny, what it unfolds to is not: the number of tasks follows the number of slots.
    wide = wide.repartition(tasks, "src", "chunk")
    k = F.sequence(F.col("chunk") * CHUNK, F.least(F.col("draws"), (F.col("chunk") + 1) * CHUNK) - 1)
    each = wide.select("src", F.explode(F.transform(k, lambda i: F.col("first_draw") + i)).alias("i"))
    slot = permuted(F.col("i"), F.lit(total).cast("long"), F.lit(seed), F.lit(-1))
    counts = each.groupBy(F.floor(slot / shard).alias("shard"), "src").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("span", F.floor(F.col("shard") / CHUNK)), "mix-shards")
    before = Window.unboundedPreceding, -1
    spans_ = counts.groupBy("src", "span").agg(F.sum("n").alias("t_"))
    base = spans_.select("src", "span", F.coalesce(F.sum("t_").over(Window.partitionBy("src").orderBy("span").rowsBetween(*before)), F.lit(0)).alias("b_"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("src", "span").orderBy("shard").rowsBetween(*before)), F.lit(0))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("src").rowsBetween(*before)), F.lit(0))
    filled = F.sum("n").over(Window.partitionBy("shard"))
    counts = counts.withColumn("o_", own).withColumn("offset", offset).withColumn("filled", filled)
    return counts.join(base, ["src", "span"]).select("shard", "src", "n", (F.col("b_") + F.col("o_")).alias("start"), "offset", "filled")


def slots(src: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """One row per output slot: shard, slot (its place in the shard), src, epoch, block."""
    plan = draws(src, block)
    counts = shard_counts(plan, shard, seed).join(plan.select("src", "blocks", "draws"), "src")
    # A row of counts unfolds to up to a shard of slots: again the number of tasks follows the slots, not the rows.
    counts = counts.repartition(_tasks(plan)[1], "shard", "src")
    each = counts.select("shard", "src", "blocks", "draws", "start", "offset", "filled", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    each = each.withColumn("k", F.col("start") + F.col("j"))
    at = F.col("k") % F.col("blocks")
    # The blocks of this round: all, or in the last one the first of the stream.
    among = F.least("blocks", F.col("draws") - F.col("k") + at)
    return each.select(
        "shard",
        permuted(F.col("offset") + F.col("j"), F.col("filled"), F.lit(seed), F.lit(-2), "shard").alias("slot"),
        "src",
        F.floor(F.col("k") / F.col("blocks")).alias("epoch"),
        permuted(at, among, F.lit(seed), F.col("src")).alias("block"),
    )


def spans(sizes: DataFrame, src: DataFrame, n: int) -> DataFrame:
    """doc_id, source's figures, size, start: where the document's words begin in its source's stream; row: unique there."""
    parts = max(1, math.isqrt(n))
    at = sizes.join(src.select(F.col("source").alias("s_"), "source_size", "src", "target"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "source")
    at = materialize(at.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))), "mix-sized", n)
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = at.groupBy("src", "part").agg(F.sum("size").alias("t_")).select("src", "part", F.coalesce(F.sum("t_").over(before), F.lit(0)).alias("b_"))
    inside = Window.partitionBy("src", "part").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "size")
    own = at.withColumn("row", F.row_number().over(inside)).withColumn("o_", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(base, ["src", "part"]).withColumn("start", F.col("b_") + F.col("o_")).drop("b_", "o_")


def pieces(doc: DataFrame, block: int) -> DataFrame:
    """The packing: a row per document and block of its source's stream that holds words of it.

    Adds block, at (of the first of these words in the block), first (of it in the document), words; a document without
    words has one row without a block.
    """
    end = F.col("start") + F.col("size")
    held = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    cover = doc.select("*", F.explode_outer(held).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    words = F.coalesce(F.least(end, (F.col("block") + 1) * block) - begin, F.lit(0))
    return cover.withColumns({"at": begin - F.col("block") * block, "first": begin - F.col("start"), "words": words})


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = materialize(docs.select("doc_id", "source", words.alias("size")), "mix-sizes")
    n = sizes.count()
    return sizes, materialize(targets(sizes), "mix-targets", n), n


def blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot, source, epoch, block, words (the block's, as an array), in any order.

    Rows that share id, source and size are given their texts in any order, each once.
    """
    sizes, src, n = _planned(docs)
    nth = F.row_number().over(Window.partitionBy("doc_id", "src", "size").orderBy("part", "row"))
    doc = pieces(spans(sizes, src, n).withColumn("nth", nth), block).where("words > 0")
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    texts = docs.select(F.col("doc_id").alias("d_"), F.col("source").alias("s_"), words.alias("w_")).withColumn("n_", F.size("w_").cast("long"))
    texts = texts.withColumn("nth_", F.row_number().over(Window.partitionBy("d_", "s_", "n_").orderBy(F.lit(0))))
    doc = doc.join(src.select(F.col("src").alias("r_"), "source"), F.col("src") == F.col("r_"))
    held = doc.join(texts.hint("merge"), doc["doc_id"].eqNullSafe(texts["d_"]) & doc["source"].eqNullSafe(texts["s_"]) & (doc["size"] == texts["n_"]) & (doc["nth"] == texts["nth_"]))
    held = held.select("src", "source", "block", "at", F.slice("w_", F.col("first").cast("int") + 1, F.col("words").cast("int")).alias("w"))
    packed = held.groupBy("src", "source", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])).alias("words"))
    return slots(src, block, shard, seed).join(packed.hint("merge"), ["src", "block"]).select("shard", "slot", "source", "epoch", "block", "words")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of the mix that are its own, repeats counted)."""
    sizes, src, n = _planned(docs)
    doc = pieces(spans(sizes, src, n), block)
    # Both sides come from unfolding small tables, whose size estimates say nothing: never broadcast them.
    drawn = doc.join(slots(src, block, shard, seed).select("src", "block", "shard").hint("merge"), ["src", "block"], "left")
    taken = F.sum(F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("taken")
    return drawn.groupBy("src", "part", "row", "doc_id", "size", "source_size", "target").agg(taken).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame) -> DataFrame:
    """The documents that the mix draws from, all columns as they were, each as often as it is drawn.

    The words given out for a source meet its target within a document and a block.
    """
    often = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("long")
    drawn = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("d_"), F.col("size").alias("s_")).agg(F.sum(often).alias("often_"), F.count("*").alias("rows_"))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    held = docs.select(F.struct("*").alias("own"), F.col("doc_id").alias("id"), words.alias("w_"))
    held = held.join(drawn.hint("merge"), F.col("id").eqNullSafe(F.col("d_")) & (F.col("w_") == F.col("s_")))
    # Rows of one id and size share their draws.
    nth = F.row_number().over(Window.partitionBy("d_", "s_").orderBy(F.lit(0)))
    held = held.withColumn("n_", F.expr("often_ div rows_") + (nth <= F.expr("often_ % rows_")).cast("long")).where("n_ > 0")
    return held.select("own", F.explode(F.sequence(F.lit(1).cast("long"), "n_"))).select("own.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
