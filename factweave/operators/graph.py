"""Iteration to a fixed point, and the joins of the import graph."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory, extension, norm, norm2, package_of, stem
from ..shared import settled


def fixpoint(seed: DataFrame, expand: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """All rows reachable from `seed`: semi-naive, each round expands only the rows that the last one found."""
    keys = seed.columns
    known = frontier = settled(seed.distinct())
    for _ in range(most):
        frontier = settled(expand(frontier).select(*keys).distinct().join(known, keys, "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise RuntimeError(f"no fixed point within {most} rounds")


def scan_rounds(seed: DataFrame, discover: Callable[[DataFrame], DataFrame], local: DataFrame, exclude: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(repo, rev, round) of each scan. Every tried pair is logged before it is scanned, so none is tried again.

    Pairs that are found in round `most` are still returned; if they lead on, RuntimeError says so instead of leaving them out.
    """
    tried = settled(seed.select("repo", "rev").distinct().withColumn("round", F.lit(0)))
    front = tried
    for k in range(1, most + 1):
        new = discover(front.select("repo", "rev")).select("repo", "rev").distinct().join(local.select("repo").distinct(), "repo", "left_semi")
        if exclude is not None:
            new = new.join(exclude.select("rev").distinct(), "rev", "left_anti")
        front = settled(new.join(tried, ["repo", "rev"], "left_anti").withColumn("round", F.lit(k)).select("repo", "rev", "round"))
        if front.isEmpty():
            return tried
        tried = tried.unionByName(front)
    raise RuntimeError(f"scans go on after {most} rounds")


def chain_root(edges: DataFrame, depth: int = 50) -> DataFrame:
    """(node, root, depth): the end of each node's parent chain. Edges are (child, parent); circles end at `depth`.

    Pointer doubling: log2(depth) rounds, each a join of the rows with themselves. Of several parents, the way that leads
    farthest counts.
    """

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        go = second.select(F.col("node").alias("n_"), F.col("root").alias("r_"), F.col("depth").alias("d_"))
        rows = first.join(go, F.col("root") == F.col("n_"), "left")
        rows = rows.select("node", F.coalesce("r_", "root").alias("root"), (F.col("depth") + F.coalesce("d_", F.lit(0))).alias("depth"))
        return settled(rows.groupBy("node", "root").agg(F.max("depth").alias("depth")), "chains")

    leap = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("node"), F.col("parent").alias("root"), F.lit(1).alias("depth")).distinct()
    found, left = None, depth
    while left:
        if left % 2:
            found = leap if found is None else then(found, leap)
        left //= 2
        if left:
            leap = then(leap, leap)
    return found.groupBy("node").agg(F.max_by("root", F.struct("depth", "root")).alias("root"), F.max("depth").alias("depth"))


def unscanned(wanted: DataFrame, have: DataFrame, keys: list[str], normed: list[str] = ()) -> DataFrame:
    """Rows of `wanted` whose keys `have` lacks; keys in `normed` compare by their normal form."""
    from ..functions.text import norm

    a, b = wanted.alias("a"), have.alias("b")
    on = [(norm(F.col(f"a.{k}")) == norm(F.col(f"b.{k}"))) if k in normed else (F.col(f"a.{k}") == F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_path of two snapshots (path, hash): added, deleted, changed; equal hashes make a rename."""
    o = old.select("path", F.col("hash").alias("old_hash"))
    n = new.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "changed")
    both = o.join(n, "path", "full_outer").withColumn("change", change).where("change IS NOT NULL")
    nth = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("path"))
    gone = both.where("change = 'deleted'").select(F.col("path").alias("old_path"), F.col("old_hash").alias("h"), nth("old_hash").alias("k"))
    came = both.where("change = 'added'").select("path", F.col("new_hash").alias("h"), nth("new_hash").alias("k"))
    moved = gone.join(came, ["h", "k"]).select("path", F.lit("renamed").alias("change"), "old_path")
    rest = both.select("path", "change", F.lit(None).cast("string").alias("old_path"))
    rest = rest.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rest.unionByName(moved)


def nearest_spans(old: DataFrame, new: DataFrame, reach: int = 64) -> DataFrame:
    """Declarations of two versions of files matched one to one: same kind, spans at most `reach` apart, nearest first.

    old, new: file, kind, name, span. Returns file, kind, old_name, new_name, change (rename, added, removed); equal
    names at matched places are no change. Greedy in the order of old spans, one file and kind at a time, so a group
    is the declarations of one source file.
    """
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).select("file", "kind", "side", "span", "name")
    # Groups are small and many: each task passes over its groups in order instead of starting one call for each.
    dealt = both.repartition("file", "kind").sortWithinPartitions("file", "kind", "side", F.asc_nulls_last("span"), F.asc_nulls_last("name"))

    def match(key, rows):
        a, b = [r[3:] for r in rows if r[2] == 0], [r[3:] for r in rows if r[2] == 1]
        free = set(range(len(b)))
        for span, name in a:
            near = [j for j in free if span is not None and b[j][0] is not None and abs(b[j][0] - span) <= reach]
            hit = min(near, key=lambda j: (abs(b[j][0] - span), j), default=None)
            if hit is None:
                yield (*key, name, None, "removed")
                continue
            free.discard(hit)
            if b[hit][1] != name:
                yield (*key, name, b[hit][1], "rename")
        for j in sorted(free):
            yield (*key, None, b[j][1], "added")

    def run(batches):
        names = ["file", "kind", "old_name", "new_name", "change"]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

        out = []
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        for key, group in groupby(rows, key=lambda r: r[:2]):
            out += match(key, list(group))
            if len(out) >= 10_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return dealt.mapInArrow(run, "file string, kind string, old_name string, new_name string, change string")


def importers(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """Files that import one of `targets` (path)."""
    return imports.join(targets.select(F.col("path").alias("target")), "target", "left_semi").select("path").distinct()


#: Endings that are tried for an import, in this order.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def _cleaned(path):
    """A path without empty and `.` parts, `..` taking the part before it."""

    def climb(acc, x):
        return F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), climb), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Add `target` to imports (repo, path, value): each way gives candidates with a rank, one join finds the files.

    Relative paths come first, then `aliases` (repo, pattern, target, nth: the `paths` of a tsconfig, one `*` at most; a
    pattern without one, then the longest beginning counts; several targets in the order of nth), then folders
    `node_modules` of the importer's folder and those above, nearest first, then `packages` (package_name, manifest_path).
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    keyed = imports.withColumn("row_", F.xxhash64("repo", "path", "value"))
    asked = keyed.select("row_", "repo", "path", "value").distinct()
    bare = asked.where(~F.col("value").startswith(".") & ~F.col("value").startswith("/"))
    rank = lambda way, of: F.struct(F.lit(way).alias("way"), F.lit(0).cast("int").alias("a") if of is None else of.cast("int").alias("a"))
    ways = [asked.where(F.col("value").startswith(".")).select("row_", "repo", _cleaned(F.concat_ws("/", folder, F.col("value"))).alias("base"), rank(0, None).alias("rank"))]
    if aliases is not None:
        star = F.instr("pattern", "*")
        before = F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern"))
        after = F.when(star > 0, F.substring_index("pattern", "*", -1)).otherwise("")
        known = aliases.select("repo", before.alias("before"), after.alias("after"), (star > 0).alias("open"), F.col("target").alias("into"), "nth")
        fits = F.when(F.col("open"), F.col("value").startswith(F.col("before")) & F.col("value").endswith(F.col("after")) & (F.length("value") >= F.length("before") + F.length("after"))).otherwise(F.col("value") == F.col("before"))
        inner = F.substring(F.col("value"), F.length("before") + 1, F.length("value") - F.length("before") - F.length("after"))
        # A repository has few aliases; its imports meet only those.
        met = bare.join(known, "repo").where(fits)
        order = F.when(F.col("open"), 100_000 - 100 * F.least(F.length("before"), F.lit(999))).otherwise(0) + F.least("nth", F.lit(99))
        ways.append(met.select("row_", "repo", _cleaned(F.when(F.col("open"), F.replace("into", F.lit("*"), inner)).otherwise(F.col("into"))).alias("base"), rank(1, order).alias("rank")))
    # Folders above the importer, nearest first, kept where they hold the package.
    above = F.transform(F.sequence(F.size(F.split("path", "/")) - 1, F.lit(0)), lambda n: F.concat(F.array_join(F.slice(F.split("path", "/"), 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    held = files.where(F.col("path").contains("node_modules/")).select("repo", F.regexp_extract("path", "^((?:.*/)?)node_modules/", 1).alias("up"), F.regexp_extract("path", "^(?:.*/)?node_modules/((?:@[^/]+/)?[^/]+)", 1).alias("package")).distinct()
    climbed = bare.select("row_", "repo", "value", package_of(F.col("value")).alias("package"), F.posexplode(above).alias("n", "up"))
    ways.append(climbed.join(held, ["repo", "up", "package"]).select("row_", "repo", F.concat("up", F.lit("node_modules/"), "value").alias("base"), rank(2, F.col("n")).alias("rank")))
    wide = reduce(DataFrame.unionByName, ways).select("row_", "repo", "rank", "base", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("nth", "ending"))
    wide = wide.select("row_", "repo", F.struct("rank", "nth").alias("rank"), F.concat("base", "ending").alias("try"))
    hit = wide.join(files.select(F.col("repo"), F.col("path").alias("try")).distinct(), ["repo", "try"]).groupBy("row_").agg(F.min_by("try", "rank").alias("target"))
    out = keyed.join(hit, "row_", "left")
    if packages is not None:
        names = packages.groupBy(F.col("package_name")).agg(F.min("manifest_path").alias("manifest_"))
        out = out.join(names, package_of(F.col("value")) == F.col("package_name"), "left").withColumn("target", F.coalesce("target", "manifest_")).drop("package_name", "manifest_")
    return out.drop("row_")


#: Links between two references: what must be equal, and what a side must be. Names of sides are `src` and `tgt`.
_EQUAL = {"norm": ("norm", "norm"), "norm2": ("norm2", "norm2"), "string": ("value", "value"), "target": ("target", "path"), "repo": ("repo", "repo"), "file": ("path", "path")}

#: Rows of one key and side that meet as a block. BLOCK * BLOCK pairs are what a task gets on average.
BLOCK = 4096
MOST_TASKS = 20_000


def _met(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """src, tgt of all rows with equal keys. sources: src and keys, targets: tgt and the same keys, none null.

    What joins put out grows with the square of a key's rows, what Spark deals tasks by only with the rows. So keys are cut
    into blocks of about BLOCK rows a side, and each pair of blocks goes to a task of its own or shares one with a few others.
    """
    keys = [c for c in sources.columns if c != "src"]
    counts = lambda: sources.groupBy(*keys).agg(F.count("*").alias("m")).join(targets.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    total = counts().agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0
    if total <= BLOCK * BLOCK:
        return sources.join(targets, keys).select("src", "tgt")
    sources, targets = settled(sources, "link-rows"), settled(targets, "link-rows")
    cut = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    each = settled(counts().select(*keys, cut("m"), cut("n")), "link-keys")
    tasks, cell = min(MOST_TASKS, math.ceil(total / (BLOCK * BLOCK))), [*keys, "x", "y"]

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        # The place in settled files, so equal and null ids spread, too, and a task that runs again finds the same.
        placed = rows.withColumn("place", F.monotonically_increasing_id()).join(each, keys)
        block = [F.pmod(F.xxhash64("place"), own).cast("int").alias("x" if own == "m" else "y"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("y" if own == "m" else "x")]
        return placed.select(rows.columns[0], *keys, *block).repartition(tasks, *cell)

    blocks = dealt(targets, "n", "m").groupBy(*cell).agg(F.collect_list(F.struct("tgt")).alias("block"))
    # Merged with the blocks as the buffered side, a task holds the pairs of one row and one block at a time.
    pairs = dealt(sources, "m", "n").join(blocks.hint("merge"), cell).select("src", F.explode("block").alias("other"))
    return pairs.select("src", F.col("other.tgt").alias("tgt"))


def linked(sources: DataFrame, targets: DataFrame, predicates: list, suffixes: list[str] = ()) -> DataFrame:
    """src, tgt (ids) of the references that all predicates link.

    sources, targets: id, kind, value, repo, path, target (file the reference resolves to). Predicates: "norm", "norm2"
    (without one of `suffixes`), "string", "target" (the source resolves to the target's file), "repo", "file";
    ("kind", side, kind); ("stem" | "ext" | "dir", side): that part of the side's path, in small letters, is the normal
    form of the other's value; ("and", [predicates]). "file" and "target" hold within a repository. Null equals nothing. At
    least one predicate must compare both sides, so that the join has a key. Rows are counted at once, joined when read.
    """
    parts = {"stem": stem, "ext": extension, "dir": directory}
    flat, todo = [], list(predicates)
    while todo:
        p = todo.pop(0)
        todo[:0] = p[1] if p[0] == "and" else []
        flat += [] if p[0] == "and" else [p]

    equal = []  # columns of the source and the target
    for p in flat:
        if p[0] in parts and not isinstance(p, str):
            equal.append((p[0], "norm") if p[1] == "src" else ("norm", p[0]))
        elif p in _EQUAL:
            equal += [_EQUAL[p], *([("repo", "repo")] if p in ("file", "target") else [])]
        elif p[0] != "kind":
            raise ValueError(f"link: unknown predicate {p!r}")
    if not equal:
        raise ValueError("link: no predicate compares the two sides, so every row would meet every row")
    equal = list(dict.fromkeys(equal))

    def side(df: DataFrame, name: str) -> DataFrame:
        whole = df.where(reduce(lambda a, b: a & b, [F.col("kind") == p[2] for p in flat if p[0] == "kind" and p[1] == name], F.lit(True)))
        value = F.col("value")
        told = {"norm": norm(value), "norm2": norm2(value, list(suffixes)), **{k: F.lower(f(F.col("path"))) for k, f in parts.items()}}
        keys = [told.get(e[name == "tgt"], F.col(e[name == "tgt"])).alias(f"key{n}") for n, e in enumerate(equal)]
        return whole.select(F.col("id").alias(name), *keys).dropna(subset=[f"key{n}" for n in range(len(equal))])

    return _met(side(sources, "src"), side(targets, "tgt"))


def relays(imports: DataFrame, wanted: DataFrame, exports: DataFrame) -> DataFrame:
    """Imports (path, name, target) of a wanted name (target, name) whose file exports that name (path, name) on."""
    hit = imports.join(wanted.select("target", "name").distinct(), ["target", "name"], "left_semi")
    return hit.join(exports.select("path", "name").distinct(), ["path", "name"], "left_semi").select(*imports.columns)


def upstream(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """target, name, first (least path of the files that import it) of the names that files import and their targets export."""
    there = exports.select(F.col("path").alias("target"), "name").distinct()
    return imports.join(there, ["target", "name"], "left_semi").groupBy("target", "name").agg(F.min("path").alias("first"))


def rename_edits(facts: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """Edits (path, old, new) for a renamed export, through re-exports; an alias ends the chain.

    Chains of any length are followed: pairs once seen are not visited again, so circles end.
    facts: path, name, alias (null: none), target (file imported from), reexport (whether the name is exported on).
    """
    spark = facts.sparkSession
    front = seen = settled(spark.createDataFrame([(path, old)], "target string, name string"))
    edits = None
    while True:
        found = settled(facts.join(front, ["target", "name"], "left_semi").select("path", "name", "alias", "reexport"))
        edits = found if edits is None else edits.unionByName(found)
        front = found.where("reexport AND (alias IS NULL OR alias = name)").select(F.col("path").alias("target"), "name").distinct().join(seen, ["target", "name"], "left_anti")
        front = settled(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return edits.select("path", F.col("name").alias("old"), F.lit(new).alias("new")).distinct()


def apply_edits(files: DataFrame, edits: DataFrame, unit: str = "codepoint") -> DataFrame:
    """path, text after all edits (path, begin, end, new). unit: what spans count, "codepoint", or "byte" as in facts and plans.

    Overlapping or outlying edits, and edits that would cut a character in two, leave null.
    """
    per = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "new"))).alias("e"))
    kind = {"codepoint": "string", "byte": "binary"}[unit]
    raw, size = F.col("raw"), F.length("raw")

    def splice(acc, e):
        good = acc["ok"] & (e["begin"] >= acc["at"]) & (e["end"] >= e["begin"]) & (e["end"] <= size)
        piece = F.substring(raw, acc["at"] + 1, e["begin"] - acc["at"])
        return F.struct(e["end"].cast("int").alias("at"), F.concat(acc["out"], F.array(piece, e["new"].cast(kind))).alias("out"), good.alias("ok"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"), F.lit(True).alias("ok"))
    joined = files.join(per, "path").withColumn("raw", F.col("text").cast(kind)).withColumn("done", F.aggregate("e", zero, splice))
    rest = F.substring(raw, F.col("done.at") + 1, size)
    whole = F.aggregate(F.concat("done.out", F.array(rest)), F.lit("").cast(kind), lambda a, x: F.concat(a, x)).cast("string")
    return joined.select("path", F.when(F.col("done.ok") & F.is_valid_utf8(whole), whole).alias("text"))
