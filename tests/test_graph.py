"""Graph operators, edits, diffs, rewriting."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as fn
from factweave.operators import graph, planning, sinks
from factweave.plans import rewrite


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalar_functions(spark):
    lit = F.lit
    for value, want in {"AuthService": "authservice", "auth_service": "authservice", "@scope/pkg-name": "scopepkgname", "v2.0.1": "v201", "": ""}.items():
        assert one(spark, n=fn.norm(lit(value))).n == want
    for value, want in {"auth-service": "auth", "payments-api": "payments", "auth-service-api": "authservice", "": None, "service": "service"}.items():
        assert one(spark, n=fn.norm2(lit(value), ["-service", "-api"])).n == want
    r = one(spark, a=fn.re_extract(lit("ab"), "(x)?b", 1), b=fn.re_extract(lit("ab"), "b", 0), c=fn.re_extract(lit("ab"), "(", 0), d=fn.re_extract(lit("ab"), "b", 3), e=fn.re_extract(lit("zz"), "b", 0))
    assert (r.a, r.b, r.c, r.d, r.e) == (None, "b", None, None, None)
    r = one(spark, a=fn.split_part(lit("a.b"), ".", 2), b=fn.split_part(lit("a.b"), ".", 3), c=fn.split_part(lit("a.b"), ".", 0), d=fn.split_part(lit("ab"), "", 2), e=fn.split_part(lit("a."), ".", 2))
    assert (r.a, r.b, r.c, r.d, r.e) == ("b", None, None, "a", "")
    score = lambda h, n: one(spark, s=fn.fzy_score(lit(h), lit(n))).s
    assert score("hello", "hello") == 1.0 and score("abc", "xyz") == 0 and 0 < score("hello world", "hwd") < 1 and score("a", "") == 0
    assert score("foobar", "foo") > score("fxoxo", "foo")
    for value, want in {"1.0.0": True, "v1.0.0": True, "v2.3.4-rc1": True, "0.1.0+build.123": True, "latest": False, "v1": False, "1.0": False, "release-2024": False}.items():
        assert one(spark, s=fn.is_semver(lit(value))).s is want
    r = one(spark, s=fn.stem(lit("a/b.c.ts")), e=fn.extension(lit("a/b.c.ts")), n=fn.extension(lit("a/Makefile")), d=fn.directory(lit("a/b/c")), h=fn.stem(lit(".env")), g=fn.git_blob_hash(lit(b"hello\n")))
    assert (r.s, r.e, r.n, r.d, r.h, r.g) == ("b.c", "ts", None, "a/b", ".env", "ce013625030ba8dba906f756967f9e9ca394464a")


def test_nearest_spans(spark):
    df = lambda rows: spark.createDataFrame([("f", k, n, s) for k, n, s in rows], "file string, kind string, name string, span long")
    case = lambda a, b: sorted((r.old_name or "", r.new_name or "", r.change) for r in graph.nearest_spans(df(a), df(b)).collect())
    assert case([("d", "A", 0)], [("d", "B", 64)]) == [("A", "B", "rename")]
    assert case([("d", "A", 0)], [("d", "B", 65)]) == [("", "B", "added"), ("A", "", "removed")]
    assert case([("d", "A", 0)], [("e", "B", 0)]) == [("", "B", "added"), ("A", "", "removed")]
    assert case([("d", "A", 0), ("d", "B", 2)], [("d", "B", 0), ("d", "A", 2)]) == [("A", "B", "rename"), ("B", "A", "rename")]


def test_nearest_span_covers_every_order(spark, tmp_path):
    from factweave import catalogue

    spark.createDataFrame([(o, n) for o in range(1, 31) for n in (1, 2, 2, 4)], "l_orderkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["j16_nearest_span"](spark, str(tmp_path)).collect())
    assert got == sorted((str(o), "declare", f"n{n}", f"m{n}", "rename") for o in range(1, 31) for n in (2, 4))


def test_snapshot_diff_finds_renames(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = sorted((r.path, r.change, r.old_path or "") for r in graph.snapshot_diff(df([("a", "1"), ("b", "2"), ("c", "3")]), df([("a", "9"), ("z", "2"), ("n", "5")])).collect())
    assert got == [("a", "changed", ""), ("c", "deleted", ""), ("n", "added", ""), ("z", "renamed", "b")]


def test_scan_rounds_follow_a_diamond(spark):
    finds = {("deploy", "main"): [("app", "v1")], ("app", "v1"): [("lib-core", "v2"), ("lib-utils", "v3.0.0")], ("lib-core", "v2"): [("lib-utils", "v3.1.0")]}
    edges = spark.createDataFrame([(a, b, c, d) for (a, b), out in finds.items() for c, d in out], "repo string, rev string, r2 string, v2 string")
    discover = lambda pairs: pairs.join(edges, ["repo", "rev"]).select(F.col("r2").alias("repo"), F.col("v2").alias("rev"))
    local = spark.createDataFrame([(x,) for x in ("app", "lib-core", "lib-utils")], "repo string")
    seed = spark.createDataFrame([("deploy", "main")], "repo string, rev string")
    got = {(r.repo, r.rev): r.round for r in graph.scan_rounds(seed, discover, local).collect()}
    assert got == {("deploy", "main"): 0, ("app", "v1"): 1, ("lib-core", "v2"): 2, ("lib-utils", "v3.0.0"): 2, ("lib-utils", "v3.1.0"): 3}
    assert ("app", "v1") not in {(r.repo, r.rev) for r in graph.scan_rounds(seed, discover, local, spark.createDataFrame([("v1",)], "rev string")).collect()}


def test_chain_root_ends_in_circles(spark):
    got = {r.node: (r.root, r.depth) for r in graph.chain_root(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "child string, parent string"), 10).collect()}
    assert got["a"] == ("c", 2) and got["b"] == ("c", 1) and got["x"][1] == 10


def test_chain_root_of_a_million_edges(spark):
    """A thousand chains of a thousand, cut at fifty; a star; several parents."""
    edges = spark.range(1_000_000).where("id % 1000 < 999").select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    got = graph.chain_root(edges)
    assert got.count() == 999_000 and got.where("root <> node + depth OR depth <> least(50, 999 - node % 1000)").count() == 0
    wide = spark.createDataFrame([(i, 0) for i in range(1, 300)] + [(0, -1), (500, 1), (500, -1)], "child long, parent long")
    rows = {r.node: (r.root, r.depth) for r in graph.chain_root(wide).collect()}
    assert rows[0] == (-1, 1) and rows[7] == (-1, 2) and rows[500] == (-1, 3)


def test_rename_edits_pass_barrels_and_stop_at_aliases(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, name string, alias string, target string, reexport boolean")
    two = df([("b1", "Foo", None, "utils", True), ("b2", "Foo", None, "b1", True), ("app", "Foo", None, "b2", False)])
    assert {r.path for r in graph.rename_edits(two, "utils", "Foo", "Bar").collect()} == {"b1", "b2", "app"}
    alias = df([("b1", "Foo", "PublicFoo", "utils", True), ("app", "PublicFoo", None, "b1", False)])
    assert {r.path for r in graph.rename_edits(alias, "utils", "Foo", "Bar").collect()} == {"b1"}


def test_rename_edits_follow_long_chains_and_circles(spark):
    hops = [(f"b{i + 1}", "Foo", None, f"b{i}", True) for i in range(23)] + [("b0", "Foo", None, "b23", True), ("app", "Foo", None, "b23", False)]
    facts = spark.createDataFrame(hops, "path string, name string, alias string, target string, reexport boolean").coalesce(1)
    assert {r.path for r in graph.rename_edits(facts, "b0", "Foo", "Bar").collect()} == {"app", *(f"b{i}" for i in range(24))}


def test_too_many_module_moves_raise(spark):
    files = spark.createDataFrame([("a.rs", "use crate::m1::T;", "crate")], "path string, text string, module string")
    moves = spark.createDataFrame([(f"crate::m{i}", f"crate::n{i}") for i in range(3)], "old_module string, new_module string")
    assert [r.text for r in planning.plan_module_moves(files, "module", moves, most=3).collect()] == ["use crate::n1::T;"]
    with pytest.raises(ValueError, match="more than 2"):
        planning.plan_module_moves(files, "module", moves, most=2)


def test_apply_edits(spark):
    files = spark.createDataFrame([("a", "héllo world"), ("b", "xyz"), ("c", "same")], "path string, text string")
    edits = spark.createDataFrame([("a", 6, 11, "you"), ("a", 0, 1, "H"), ("b", 0, 2, "q"), ("b", 1, 3, "r")], "path string, begin int, end int, new string")
    assert {r.path: r.text for r in graph.apply_edits(files, edits).collect()} == {"a": "Héllo you", "b": None}


def test_apply_edits_in_bytes(spark):
    text = "é日🙂 old é"
    files = spark.createDataFrame([("a", text), ("b", text), ("c", text), ("d", "")], "path string, text string")
    end = len(text.encode())
    edits = spark.createDataFrame([("a", 10, 13, "neu日"), ("a", 0, 2, ""), ("a", end, end, "!"), ("b", 1, 2, "x"), ("c", 0, end + 1, "x"), ("d", 0, 0, "new")], "path string, begin int, end int, new string")
    assert {r.path: r.text for r in graph.apply_edits(files, edits, "byte").collect()} == {"a": "日🙂 neu日 é!", "b": None, "c": None, "d": "new"}


def test_scan_rounds_say_when_they_do_not_end(spark):
    step = lambda pairs: pairs.select("repo", F.concat("rev", F.lit("x")).alias("rev"))
    seed = spark.createDataFrame([("r", "v")], "repo string, rev string")
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        graph.scan_rounds(seed, step, seed, most=3)


def test_resolve_imports(spark):
    imports = spark.createDataFrame([("r", "src/a/x.ts", "../b"), ("r", "src/a/x.ts", "./y"), ("r", "src/a/x.ts", "lodash/fp"), ("r", "src/a/x.ts", "./gone")], "repo string, path string, value string")
    files = spark.createDataFrame([("r", "src/b/index.ts"), ("r", "src/a/y.tsx"), ("r", "src/a/y.js")], "repo string, path string")
    packages = spark.createDataFrame([("lodash", "vendor/lodash/package.json")], "package_name string, manifest_path string")
    got = {r.value: r.target for r in graph.resolve_imports(imports, files, packages).collect()}
    assert got == {"../b": "src/b/index.ts", "./y": "src/a/y.tsx", "lodash/fp": "vendor/lodash/package.json", "./gone": None}


def test_aliases_and_module_folders(spark):
    values = ["@app/x", "@app/core/y", "@app", "dep", "@s/dep/sub", "deep", "none", "@app/"]
    imports = spark.createDataFrame([("r", "pkg/a/m.ts", v) for v in values] + [("q", "pkg/a/m.ts", "@app/x")], "repo string, path string, value string")
    files = ["src/x.ts", "lib/x.ts", "core/y.ts", "src/core/y.ts", "src/index.ts", "node_modules/dep/index.js", "pkg/node_modules/dep/index.js", "node_modules/@s/dep/sub.js", "pkg/a/b/node_modules/deep/index.js"]
    files = spark.createDataFrame([("r", f) for f in files], "repo string, path string")
    aliases = spark.createDataFrame([("r", "@app/*", "./lib/gone/*", 0), ("r", "@app/*", "./src/*", 1), ("r", "@app/core/*", "core/*", 0), ("r", "@app", "src", 0)], "repo string, pattern string, target string, nth int")
    got = {(r.repo, r.value): r.target for r in graph.resolve_imports(imports, files, aliases=aliases).collect()}
    want = {"@app/x": "src/x.ts", "@app/core/y": "core/y.ts", "@app": "src/index.ts", "dep": "pkg/node_modules/dep/index.js", "@s/dep/sub": "node_modules/@s/dep/sub.js", "deep": None, "none": None, "@app/": "src/index.ts"}
    assert got == {("r", v): t for v, t in want.items()} | {("q", "@app/x"): None}


@pytest.mark.parametrize(
    ("predicates", "want"),
    [
        (["string"], {(1, 11)}),
        (["norm"], {(1, 11), (2, 12)}),
        (["norm2"], {(1, 11), (2, 12), (3, 13)}),
        (["target"], {(1, 12)}),
        (["file"], {(2, 11)}),
        ([("stem", "tgt")], {(1, 11)}),
        ([("ext", "src")], {(1, 14), (2, 14)}),
        ([("dir", "src")], {(2, 14)}),
        (["norm", ("kind", "tgt", "export_name")], {(1, 11)}),
        ([("and", [("kind", "src", "mod"), ("and", ["norm", "repo"])])], {(2, 12)}),
    ],
)
def test_links(spark, predicates, want):
    shape = "id int, kind string, value string, repo string, path string, target string"
    a = spark.createDataFrame([(1, "import_name", "Foo", "r", "a/x.ts", "b/foo_bar.rs"), (2, "mod", "foo-bar", "r", "ts/foo.ts", None), (3, "dep", "pay-api", None, None, None)], shape)
    b = spark.createDataFrame([(11, "export_name", "Foo", "r", "ts/foo.ts", None), (12, "mod", "foo_bar", "r", "b/foo_bar.rs", None), (13, "dep", "pay-service", "q", None, None), (14, "dep", "TS", "q", None, None)], shape)
    got = {(r.src, r.tgt) for r in graph.linked(a, b, predicates, ["-api", "-service"]).collect()}
    assert got == want


def test_links_of_one_key_are_dealt_over_tasks(spark, monkeypatch):
    """A key's pairs go to tasks by blocks, repeated and null ids and keys that only one side has included."""
    monkeypatch.setattr(graph, "BLOCK", 50, raising=False)
    shape = lambda df, value: df.select("id", F.lit("k").alias("kind"), value.alias("value"), F.lit("r").alias("repo"), F.lit("p").alias("path"), F.lit(None).cast("string").alias("target"))
    named = lambda n: F.when(F.col("id") >= 900, F.concat(F.lit(f"{n}-"), F.col("id").cast("string"))).when(F.col("id") >= 890, None).when(F.col("id") >= 870, "few").otherwise("Hot")
    twice = lambda df: df.unionByName(df.where("id < 5")).unionByName(spark.range(300).select(F.lit(None).cast("long").alias("id")))
    a, b = shape(twice(spark.range(1000)), named("a")), shape(twice(spark.range(600, 1000)), named("b"))
    got = graph.linked(a, b, ["norm", "repo"])
    plain = a.alias("a").join(b.alias("b"), F.lower("a.value") == F.lower("b.value")).select(F.col("a.id").alias("src"), F.col("b.id").alias("tgt"))
    assert got.dtypes == plain.dtypes and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == (870 + 5 + 300) * (270 + 300) + 20 * 20 and max(made) <= 12 * 50 * 50


def test_a_link_needs_a_key(spark):
    a = spark.createDataFrame([(1, "k", "v", "r", "p", None)], "id int, kind string, value string, repo string, path string, target string")
    with pytest.raises(ValueError, match="every row would meet every row"):
        graph.linked(a, a, [("kind", "src", "k")])
    with pytest.raises(ValueError, match="unknown predicate"):
        graph.linked(a, a, ["near"])


def test_sinks(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), ("l", 5)], "k string, v int")
    assert {(r.k, r.v) for r in sinks.first_wins(df, ["k"], ["v"]).collect()} == {("k", 1), ("l", 5)}
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, id int")
    assert {(r.path, r.id) for r in sinks.renamed(files, spark.createDataFrame([("a", "z")], "path string, new_path string")).collect()} == {("z", 1), ("b", 2)}
    assert {r.path for r in sinks.without_paths(files, files.where("id = 1")).collect()} == {"b"}
    assert sinks.search(files, "path", "ab", ["path"]).count() == 0


@pytest.mark.parametrize(
    ("importer", "old", "new", "spec", "want"),
    [
        ("src/a.ts", "src/b.ts", "src/lib/b.ts", "./b", "./lib/b"),
        ("src/x/a.ts", "src/b.ts", "src/c/index.ts", "../b", "../c"),
        ("src/a.ts", "src/b.ts", "src/c.ts", "./b.ts", "./c.ts"),
        ("src/a.ts", "src/b.ts", "src/c.ts", "react", None),
    ],
)
def test_js_rewrites(importer, old, new, spec, want):
    assert rewrite.js_import(importer, old, new, spec) == want


def test_rust_paths():
    assert [rewrite.module_of(p) for p in ("c/src/lib.rs", "c/src/a/mod.rs", "c/src/a/b.rs", "x.py")] == ["crate", "crate::a", "crate::a::b", None]
    assert rewrite.absolute("super::x", "crate::a::b") == "crate::a::x" and rewrite.absolute("self::x", "crate::a") == "crate::a::x" and rewrite.absolute("super::super::x", "crate::a") is None
    assert rewrite.moved_use("super::old::T", "crate::a::b", "crate::a::old", "crate::a::new") == "super::new::T"
    assert rewrite.moved_use("crate::old::T", "crate::b", "crate::old", "crate::x::new") == "crate::x::new::T"
    assert rewrite.moved_use("crate::older::T", "crate::b", "crate::old", "crate::new") is None
    text = 'use crate::old::{A, B};\nfn f() { vec![crate::old::g()]; "crate::old" }'
    assert rewrite.rewrite_rust(text, "crate", "crate::old", "crate::new") == 'use crate::new::{A, B};\nfn f() { vec![crate::new::g()]; "crate::old" }'
    assert rewrite.parent_files("c/src/a/b.rs") == ["c/src/a/mod.rs", "c/src/a.rs"] and rewrite.parent_files("c/src/b.rs") == ["c/src/lib.rs", "c/src/main.rs"]
    manifests = {"Cargo.toml": {"workspace": {"members": ["crates/*"]}}, "crates/my-lib/Cargo.toml": {"package": {"name": "my-lib"}}, "other/Cargo.toml": {"package": {"name": "other"}}}
    assert rewrite.crate_names(manifests) == {"my_lib": "crates/my-lib/src"}
    assert rewrite.plan_move([("a.ts", "./b", 5, 8), ("a.ts", "react", 20, 25), ("a.ts", "./b", 40, 43)], "b.ts", "c/b.ts") == [("a.ts", 40, 43, "./c/b"), ("a.ts", 5, 8, "./c/b")]
