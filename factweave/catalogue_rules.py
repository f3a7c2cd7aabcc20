"""Queries that run rules, code extractors, change classification and planning over texts made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import query, t
from .functions import paths
from .functions import text as fn
from .operators import graph, planning, sinks
from .operators.extract import extract, facts, tables
from .plans import sqlgate
from .plans.language import Rule, from_json, parse
from .shared import new_path
from .streaming import watch


def blobs(df: DataFrame, path, text, repo="r", rev="main", tags=()) -> DataFrame:
    """Rows as virtual files."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(col(repo).alias("repo"), col(rev).alias("rev"), F.array(*map(col, tags)).cast("array<string>").alias("tags"), path.alias("path"), text.alias("text"))


def s(name: str):
    return F.col(name).cast("string")


def rule(df: DataFrame, body: str, **columns: str) -> DataFrame:
    """Captures of one rule body, renamed."""
    rows = extract(df, parse(f"rule(q) {{ {body} }};").rules)
    return rows.select(*[F.col("captures")[v].alias(k) for k, v in columns.items()])


def nations(spark, d):
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def suppliers(spark, d):
    return t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


# ---- readers and trees ---------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s12_yaml(spark, d):
    text = F.concat(F.lit("supplier:\n  name: '"), F.col("s_name"), F.lit("'\n  key: "), s("s_suppkey"), F.lit("\n  nation: '"), F.col("n_name"), F.lit("'\n"))
    return rule(blobs(suppliers(spark, d), F.concat(s("s_suppkey"), F.lit(".yaml")), text), "fs(*.yaml) > json({ supplier: { name: $N, key: $K, nation: $C } })", key="K", name="N", nation="C")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def s13_toml(spark, d):
    text = F.concat(F.lit("[supplier]\nkey = "), s("s_suppkey"), F.lit("\nname = \""), F.col("s_name"), F.lit("\"\n"))
    return rule(blobs(t(spark, d, "supplier"), F.concat(s("s_suppkey"), F.lit(".toml")), text), "fs(*.toml) > json({ supplier: { name: $N, key: $K } })", key="K", name="N")


@query("SELECT event_id || '.json' AS path FROM events WHERE event_id % 2 = 0")
def s16_dispatch(spark, d):
    ending = F.when(F.col("event_id") % 2 == 0, ".json").otherwise(".txt")
    df = blobs(t(spark, d, "events"), F.concat(s("event_id"), ending), F.col("props"))
    return extract(df, parse("rule(q) { fs(**/*.json) > json({ k: $K }) };").rules).select("path")


@query("SELECT n_nationkey || '.json' AS path, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey || '.json', n_name FROM nation")
def w4_depth(spark, d):
    text = F.to_json(F.struct(F.col("r_name").alias("top"), F.struct(F.struct("n_name", "n_nationkey").alias("b")).alias("a")))
    deep = Rule("q", context=[("file", "*.json")], matcher=("json", [("any",), ("depth_min", 3), ("leaf", "V")]), columns=["V"])
    return extract(blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".json")), text), [deep]).select("path", F.col("captures")["V"].alias("value"))


def _walked(spark, d, *steps) -> DataFrame:
    """Leaves that the steps reach in a document per nation: {top: region, a: {b: {n_name, n_nationkey}}, l: [nation, region]}."""
    text = F.to_json(F.struct(F.col("r_name").alias("top"), F.struct(F.struct("n_name", "n_nationkey").alias("b")).alias("a"), F.array("n_name", "r_name").alias("l")))
    found = Rule("q", context=[("file", "*.json")], matcher=("json", [*steps, ("leaf", "V")]), columns=["V"])
    return extract(blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".json")), text), [found]).select("path", F.col("captures")["V"].alias("value"), "node_path")


@query("SELECT n_nationkey || '.json' AS path, r_name AS value, 'top' AS node_path FROM nation JOIN region ON n_regionkey = r_regionkey")
def w5_depth_max(spark, d):
    return _walked(spark, d, ("any",), ("depth_max", 1))


@query("SELECT n_nationkey || '.json' AS path, n_name AS value, 'a/b/n_name' AS node_path FROM nation UNION ALL SELECT n_nationkey || '.json', n_nationkey || '', 'a/b/n_nationkey' FROM nation")
def w6_depth_eq(spark, d):
    return _walked(spark, d, ("any",), ("depth_eq", 3))


@query("SELECT n_nationkey || '.json' AS path, n_name AS value, 'a/b/n_name' AS node_path FROM nation")
def w7_parent_key(spark, d):
    return _walked(spark, d, ("any",), ("parent", "*_name"))


@query("SELECT n_nationkey || '.json' AS path, n_name AS value, 'l/0' AS node_path FROM nation UNION ALL SELECT n_nationkey || '.json', r_name, 'l/1' FROM nation JOIN region ON n_regionkey = r_regionkey")
def w8_array_item(spark, d):
    return _walked(spark, d, ("key", "l"), ("item",))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def w15_literal_descends(spark, d):
    key = F.when(F.col("n_nationkey") % 2 == 0, "on").otherwise("off")
    text = F.to_json(F.struct(F.col("n_name").alias("name"), F.create_map(key, F.lit(1)).alias("light")))
    return rule(blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".json")), text), "fs(*.json) > json({ name: $N, light: on })", name="N")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey % 2 = 0")
def w10_leaf_pattern(spark, d):
    ref = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("other"), F.lit(":"), s("n_nationkey"))
    df = blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".json")), F.to_json(F.struct(F.col("n_name").alias("name"), ref.alias("ref"))))
    return rule(df, 'fs(*.json) > json({ name: $N, ref: "$N:$K" })', name="N", key="K")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 1")
def w13_key_matchers(spark, d):
    key = F.when(F.col("n_nationkey") % 2 == 1, "dev-dependencies").otherwise("peers")
    df = blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".json")), F.to_json(F.create_map(key, F.create_map(F.col("n_name"), F.lit(1)))))
    return rule(df, "fs(*.json) > json({ re:^(dev-)?dependencies: { $N: $_ } })", name="N")


# ---- context and projection ----------------------------------------------------------------------------------------


@query("SELECT DISTINCT r_name AS repo, n_name AS pkg FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def p4_rev_tags(spark, d):
    n = nations(spark, d)
    df = blobs(n, F.concat(F.lit("packages/"), F.col("n_name"), F.lit("/x.json")), F.lit('{"a": 1}'), F.col("r_name"), "main", [F.concat(F.when(F.col("n_nationkey") % 2 == 0, "v").otherwise("w"), s("n_nationkey"))])
    return rule(df, "repo($R) { tag(v*) { folder(packages/$P) { fs(**/*.json) > json({ a: $_ }) } } }", repo="R", pkg="P").distinct()


@query("SELECT 'org/' || r_name AS repo, CASE WHEN n_nationkey % 2 = 0 THEN 'main' ELSE 'v' || n_nationkey END AS rev, 'a/' || n_name AS folder, 'x.y' AS stem FROM nation JOIN region ON n_regionkey = r_regionkey")
def p7_slot_captures(spark, d):
    """A context step of one capture alone: the whole repository, branch or first tag, the file's folder and stem."""
    n = nations(spark, d)
    rev = F.when(F.col("n_nationkey") % 2 == 0, "main")
    df = blobs(n, F.concat(F.lit("a/"), F.col("n_name"), F.lit("/x.y.json")), F.lit('{"k": 1}'), F.concat(F.lit("org/"), F.col("r_name")), rev, [F.concat(F.lit("v"), s("n_nationkey")), F.lit("w")])
    return rule(df, "repo($R) { rev($B) { folder($D) { fs($F) > json({ k: $_ }) } } }", repo="R", rev="B", folder="D", stem="F")


@query("SELECT s_suppkey, s_name || '@' || s_nationkey || ':{none}{' || s_suppkey || '}' AS label FROM supplier")
def p12_template(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", fn.expand("{name}@{nation}:{none}{{key}}", {"name": F.col("s_name"), "nation": s("s_nationkey"), "key": s("s_suppkey")}).alias("label"))


@query("SELECT 'named' AS rule, n_name AS name FROM nation")
def m11_no_named_group(spark, d):
    """A line pattern without named groups gives no row."""
    df = blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".txt")), F.concat(F.lit("ref "), F.col("n_name"), F.lit("\n")))
    rows = extract(df, parse("rule(named) { fs(*.txt) > line(re:^ref (?P<NAME>.+)$) }; rule(plain) { fs(*.txt) > line(re:^ref .+$) };").rules)
    return rows.select("rule", F.col("captures")["NAME"].alias("name"))


@query("SELECT p_partkey || '.txt' AS path, p_name AS name, CAST(0 AS BIGINT) AS begins, CAST(octet_length(encode(p_name)) AS BIGINT) AS ends FROM part WHERE p_size % 2 = 0")
def j2_provenance(spark, d):
    text = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "=").otherwise(":"), s("p_size"), F.lit("\n"))
    rows = extract(blobs(t(spark, d, "part"), F.concat(s("p_partkey"), F.lit(".txt")), text), parse("rule(q) { fs(*.txt) > line($N=$V) };").rules)
    return rows.select("path", F.col("captures")["N"].alias("name"), F.col("spans")["N"]["begin"].cast("long").alias("begins"), F.col("spans")["N"]["end"].cast("long").alias("ends"))


# ---- regions -------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 = 0")
def r2_marker_paired(spark, d):
    inside = F.col("n_nationkey") % 3 == 0
    text = F.concat(F.lit("fn before() {}\n// BEGIN: x\n"), F.when(inside, F.concat(F.lit("fn "), F.col("n_name"), F.lit("\n"))).otherwise(""), F.lit("// END: x\n"), F.when(~inside, F.concat(F.lit("fn "), F.col("n_name"), F.lit("\n"))).otherwise(""))
    df = blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".rs")), text)
    return rule(df, 'fs(*.rs) > marker("BEGIN:", "END:") > line(re:fn\\s+(?P<NAME>.+))', name="NAME")


@query("SELECT r_name AS heading, n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey")
def r13_nested_regions(spark, d):
    text = F.concat(F.lit("# no\n- a\n# Yes\n## "), F.col("r_name"), F.lit("\n- "), F.col("n_name"), F.lit("\n"))
    df = blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".md")), text)
    return rule(df, "fs(*.md) > md(# Yes) > md(## $$$H) > md(- $ITEM)", heading="H", item="ITEM")


# ---- code ----------------------------------------------------------------------------------------------------------


@query("SELECT 'V' || n_nationkey AS name FROM nation")
def c1_ast(spark, d):
    text = F.concat(F.lit("const x = process.env.V"), s("n_nationkey"), F.lit("; // process.env.NO\nconst y = 'process.env.NO';"))
    return rule(blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".ts")), text), "fs(*.ts) > ast(process.env.$NAME)", name="NAME")


@query("SELECT 'N' || n_nationkey AS entity FROM nation")
def c3_sub_identifier(spark, d):
    text = F.concat(F.lit("const { data } = useN"), s("n_nationkey"), F.lit("Query({ id });"))
    return rule(blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".tsx")), text), "fs(*.tsx) > ast(use${E}Query($$$A))", entity="E")


def _js(spark, d):
    """Each supplier's file imports its nation's file, renames on odd keys, and exports a constant."""
    name = F.concat(F.lit("N"), s("n_nationkey"))
    alias = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit(" as A"), s("s_suppkey"))).otherwise("")
    text = F.concat(F.lit("import { "), name, alias, F.lit(" } from '../nation/n"), s("n_nationkey"), F.lit("';\nexport const S"), s("s_suppkey"), F.lit(" = 1;\n"))
    return blobs(suppliers(spark, d), F.concat(F.lit("supplier/s"), s("s_suppkey"), F.lit(".ts")), text)


@query("SELECT 'import_path' AS kind, '../nation/n' || s_nationkey AS value, 'supplier/s' || s_suppkey || '.ts' AS path FROM supplier UNION ALL SELECT 'import_name', 'N' || s_nationkey, 'supplier/s' || s_suppkey || '.ts' FROM supplier UNION ALL SELECT 'import_alias', 'A' || s_suppkey, 'supplier/s' || s_suppkey || '.ts' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'export_name', 'S' || s_suppkey, 'supplier/s' || s_suppkey || '.ts' FROM supplier")
def c4_js_facts(spark, d):
    return facts(_js(spark, d)).select("kind", "value", "path")


@query("SELECT 'rs_use' AS kind, 'std::' || 'm' || n_nationkey || '::A' AS value FROM nation UNION ALL SELECT 'rs_use', 'std::m' || n_nationkey FROM nation UNION ALL SELECT 'rs_mod', 'x' || n_nationkey FROM nation UNION ALL SELECT 'rs_declare', 'f' || n_nationkey FROM nation")
def c9_rust_facts(spark, d):
    k = s("n_nationkey")
    text = F.concat(F.lit("use std::m"), k, F.lit("::{self, A as B};\nmod x"), k, F.lit(";\npub fn f"), k, F.lit("() { fn hidden() {} }\n"))
    return facts(blobs(nations(spark, d), F.concat(F.lit("src/n"), k, F.lit(".rs")), text)).select("kind", "value")


@query("SELECT 'supplier/s' || s_suppkey || '.ts' AS path, CASE WHEN s_nationkey % 2 = 0 THEN 'nation/n' || s_nationkey || '.ts' ELSE 'nation/n' || s_nationkey || '/index.js' END AS target FROM supplier")
def c12_resolve_imports(spark, d):
    imports = facts(_js(spark, d)).where("kind = 'import_path'").select("repo", "path", "value")
    stem = F.concat(F.lit("nation/n"), s("n_nationkey"))
    files = t(spark, d, "nation").select(F.lit("r").alias("repo"), F.concat(stem, F.when(F.col("n_nationkey") % 2 == 0, ".ts").otherwise("/index.js")).alias("path"))
    return graph.resolve_imports(imports, files).select("path", "target")


@query("SELECT 's' || s_suppkey || '.ts' AS path, CASE WHEN s_nationkey % 3 = 0 THEN 'src/exact.ts' WHEN s_nationkey % 3 = 1 THEN 'src/nation/n' || s_nationkey || '.ts' ELSE 'node_modules/n' || s_nationkey || '/index.js' END AS target FROM supplier")
def c12_resolve_aliases(spark, d):
    key, rest = s("s_nationkey"), F.col("s_nationkey") % 3
    imports = t(spark, d, "supplier").select(F.lit("r").alias("repo"), F.concat(F.lit("s"), s("s_suppkey"), F.lit(".ts")).alias("path"), F.when(rest == 0, "@n/exact").when(rest == 1, F.concat(F.lit("@n/n"), key)).otherwise(F.concat(F.lit("n"), key)).alias("value"))
    k = F.col("n_nationkey") % 3
    at = F.when(k == 0, "src/exact.ts").when(k == 1, F.concat(F.lit("src/nation/n"), s("n_nationkey"), F.lit(".ts"))).otherwise(F.concat(F.lit("node_modules/n"), s("n_nationkey"), F.lit("/index.js")))
    files = t(spark, d, "nation").select(F.lit("r").alias("repo"), at.alias("path"))
    aliases = spark.createDataFrame([("r", "@n/*", "src/nation/*", 0), ("r", "@n/exact", "src/exact", 0)], "repo string, pattern string, target string, nth int")
    return graph.resolve_imports(imports, files, aliases=aliases).select("path", "target")


@query("SELECT 'V' || n_nationkey AS name FROM nation WHERE n_nationkey % 2 = 0")
def c2_rule_object(spark, d):
    call = F.when(F.col("n_nationkey") % 2 == 0, "load").otherwise("drop")
    text = F.concat(F.lit("function a() { "), call, F.lit("(process.env.V"), s("n_nationkey"), F.lit(") }\nfunction b() { load(process.env.lower) }"))
    told = {"rule": {"pattern": "process.env.$NAME", "inside": {"pattern": "load($$$_)"}}, "constraints": {"NAME": {"regex": "^[A-Z]"}}}
    program = from_json(json.dumps({"rules": [{"name": "env", "context": [["file", "*.ts"]], "matcher": ["ast", told, None]}]}))
    rows = extract(blobs(nations(spark, d), F.concat(s("n_nationkey"), F.lit(".ts")), text), program.rules)
    return rows.select(F.col("captures").getItem("NAME").alias("name"))


# ---- joins over facts ----------------------------------------------------------------------------------------------


@query("SELECT 'supplier/s' || s_suppkey || '.ts' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def j8_importers(spark, d):
    imports = facts(_js(spark, d)).where("kind = 'import_path'").select("path", F.replace("value", F.lit("../"), F.lit("")).alias("target"))
    return graph.importers(imports, t(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("nation/n"), s("n_nationkey")).alias("path")))


@query("SELECT DISTINCT 'n' || n_nationkey AS path FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3")
def j20_rename_propagation(spark, d):
    n, sup = t(spark, d, "nation"), t(spark, d, "supplier")
    barrel = n.select(F.concat(F.lit("n"), s("n_nationkey")).alias("path"), F.lit("Foo").alias("name"), F.lit(None).cast("string").alias("alias"), F.concat(F.lit("core"), s("n_nationkey")).alias("target"), F.lit(True).alias("reexport"))
    users = sup.select(F.concat(F.lit("s"), s("s_suppkey")).alias("path"), F.lit("Foo").alias("name"), F.lit(None).cast("string").alias("alias"), F.concat(F.lit("n"), s("s_nationkey")).alias("target"), F.lit(False).alias("reexport"))
    return graph.rename_edits(barrel.unionByName(users), "core3", "Foo", "Bar").select("path")


# ---- changes -------------------------------------------------------------------------------------------------------

_CHANGES = """
SELECT 'move' AS change_type, 'o' || o_orderkey AS old_path, 'm' || o_orderkey AS new_path FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT 'delete', 'o' || o_orderkey, NULL FROM orders WHERE o_orderkey % 10 = 2
UNION ALL SELECT 'create', NULL, 'c' || o_orderkey FROM orders WHERE o_orderkey % 10 = 3
UNION ALL SELECT 'content_change', NULL, 'o' || o_orderkey FROM orders WHERE o_orderkey % 10 = 4
"""


def _changes(spark, d):
    o, k = t(spark, d, "orders"), s("o_orderkey")
    index = o.select(F.lit("r").alias("repo"), F.concat(F.lit("o"), k).alias("path"), F.concat(F.lit("h"), k).alias("content_hash"))
    kind = F.col("o_orderkey") % 10
    make = lambda rest, op, path, h: o.where(kind == rest).select(F.col("o_orderdate").alias("event_ts"), F.lit("r").alias("repo"), F.lit(op).alias("op"), F.concat(F.lit(path), k).alias("path"), (F.concat(F.lit(h), k) if h else F.lit(None).cast("string")).alias("content_hash"))
    events = make(1, "removed", "o", "").unionByName(make(1, "created", "m", "h")).unionByName(make(2, "removed", "o", "")).unionByName(make(3, "created", "c", "n"))
    events = events.unionByName(make(4, "removed", "o", "")).unionByName(make(4, "created", "o", "x")).unionByName(make(5, "modified", "o", "h"))
    return index, watch.classify(events, index)


@query(_CHANGES)
def t3_classify_changes(spark, d):
    return _changes(spark, d)[1].select("change_type", "old_path", "new_path")


@query("SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'm' ELSE 'o' END || o_orderkey AS path, CASE WHEN o_orderkey % 10 = 4 THEN 'x' ELSE 'h' END || o_orderkey AS content_hash FROM orders WHERE o_orderkey % 10 <> 2 UNION ALL SELECT 'c' || o_orderkey, 'n' || o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def k4_apply_changes(spark, d):
    index, changes = _changes(spark, d)
    return watch.apply_changes(index, changes).select("path", "content_hash")


@query("""WITH k AS (SELECT o_custkey AS path, o_orderkey AS name, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 2 = 0)
SELECT * FROM k UNION ALL SELECT -1, r_regionkey, 'builtin' FROM region WHERE r_regionkey NOT IN (SELECT name FROM k)""")
def k4_upsert_prune(spark, d):
    refs = t(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("state"))
    found = refs.where("path % 3 = 0 AND name % 2 = 0").withColumn("state", F.lit("new"))
    builtin = t(spark, d, "region").select(F.lit(-1).alias("path"), F.col("r_regionkey").alias("name"), F.lit("builtin").alias("state"))
    return sinks.upserted(refs, found, ["name"], refs.where("path % 3 = 0"), builtin)


@query("SELECT l_orderkey AS path, l_linenumber AS site, CASE WHEN l_linenumber > 1 THEN max(l_partkey) || '' END AS part, CASE WHEN l_linenumber > 1 THEN max(l_suppkey) || '' END AS supp, CASE WHEN l_linenumber = 1 THEN 'only' END AS value FROM lineitem WHERE l_linenumber < 7 GROUP BY l_orderkey, l_linenumber")
def k5_sites(spark, d):
    """Two references a line, one named like the rule on first lines, none with a site on seventh ones."""
    line = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    of = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    refs = F.when(F.col("l_linenumber") == 1, F.array(of("line", F.lit("only")))).otherwise(F.array(of("part", s("l_partkey")), of("supp", s("l_suppkey"))))
    site = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))
    wide = line.select(F.col("l_orderkey").alias("path"), F.lit("line").alias("rule"), site.alias("site"), F.inline(refs))
    return sinks.pivoted(wide, ["part", "supp"]).drop("rule")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def k7_delete_cascade(spark, d):
    gone = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    return sinks.without_paths(t(spark, d, "lineitem").withColumn("path", F.col("l_orderkey")), gone).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1 OR length(text) % 7 = 0")
def t13_stale(spark, d):
    """Changed files, and files that another scanner version read."""
    docs = t(spark, d, "documents")
    changed = docs.where("doc_id % 4 = 1").select("doc_id")
    stale = docs.where("length(text) % 7 = 0").select("doc_id").join(changed, "doc_id", "left_anti")
    return changed.unionByName(stale)


# ---- rules as tables, SQL ------------------------------------------------------------------------------------------


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u2_rule_union(spark, d):
    df = blobs(t(spark, d, "nation"), F.concat(F.lit("n/"), s("n_nationkey"), F.lit(".json")), F.to_json(F.struct("n_name"))).unionByName(blobs(t(spark, d, "region"), F.concat(F.lit("r/"), s("r_regionkey"), F.lit(".json")), F.to_json(F.struct("r_name"))))
    program = parse("rule(names) { fs(n/*) > json({ n_name: $NAME }) }; rule(names) { fs(r/*) > json({ r_name: $NAME }) };")
    return tables(df, program)["names"].select("name")


@query("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) LIKE '%a%'")
def x14_sql_gate(spark, d):
    t(spark, d, "supplier").createOrReplaceTempView("x14_supplier")
    t(spark, d, "nation").createOrReplaceTempView("x14_nation")
    return sqlgate.sql(spark, "SELECT s_name, n_name FROM x14_supplier JOIN x14_nation ON s_nationkey = n_nationkey WHERE n_name LIKE '%A%';")


@query("SELECT 'drift' AS check_name, count(*) AS n FROM part WHERE p_size > 40 AND p_retailprice < 1500")
def x13_check(spark, d):
    t(spark, d, "part").createOrReplaceTempView("x13_part")
    found = sqlgate.run_check(spark, "drift", "SELECT p_partkey FROM x13_part WHERE p_size > 40 AND p_retailprice < 1500")
    return found.groupBy("check_name").agg(F.count("*").alias("n")) if not found.isEmpty() else spark.sql("SELECT 'drift' AS check_name, 0L AS n")


# ---- paths ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'crate::a' || p_size WHEN 1 THEN 'crate::m::x' || p_size ELSE NULL END AS full_path FROM part")
def f13_absolute(spark, d):
    k = F.col("p_partkey") % 3
    use = F.when(k == 0, F.concat(F.lit("crate::a"), s("p_size"))).when(k == 1, F.concat(F.lit("super::x"), s("p_size"))).otherwise(F.concat(F.lit("std::x"), s("p_size")))
    return t(spark, d, "part").select("p_partkey", paths.absolute(use, F.lit("crate::m::n")).alias("full_path"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'super::new::T' || p_size ELSE NULL END AS moved FROM part")
def f14_moved_use(spark, d):
    use = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("super::old::T")).otherwise("super::older::T"), s("p_size"))
    return t(spark, d, "part").select("p_partkey", paths.moved_use(use, F.lit("crate::m::n"), F.lit("crate::m::old"), F.lit("crate::m::new")).alias("moved"))


@query("SELECT p_partkey, unnest(['src/a' || p_size || '/mod.rs', 'src/a' || p_size || '.rs']) AS parent FROM part")
def f15_parents(spark, d):
    path = F.concat(F.lit("src/a"), s("p_size"), F.lit("/b.rs"))
    return t(spark, d, "part").select("p_partkey", F.explode(paths.parent_files(path)).alias("parent"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '../lib/b' || p_size ELSE NULL END AS specifier FROM part")
def f16_js_import(spark, d):
    spec = F.when(F.col("p_partkey") % 2 == 0, "../b").otherwise("react")
    return t(spark, d, "part").select("p_partkey", paths.js_import(F.lit("src/x/a.ts"), F.lit("src/b.ts"), F.concat(F.lit("src/lib/b"), s("p_size"), F.lit(".ts")), spec).alias("specifier"))


@query("SELECT p_partkey, 'use crate::new::T' || p_size || '; // crate::old' AS text FROM part")
def t11_rust_rewrite(spark, d):
    text = F.concat(F.lit("use crate::old::T"), s("p_size"), F.lit("; // crate::old"))
    return t(spark, d, "part").select("p_partkey", paths.rewrite_rust(text, F.lit("crate"), F.lit("crate::old"), F.lit("crate::new")).alias("text"))


# ---- order and counts ----------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS files, sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::BIGINT AS long_files FROM documents GROUP BY lang")
def a1_counts(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 1000).alias("long_files"))


@query("SELECT DISTINCT lang, source FROM documents")
def a4_distinct(spark, d):
    return t(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT l_orderkey AS file, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) AS edits FROM lineitem GROUP BY l_orderkey")
def a8_edits_per_file(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.sort_array(F.collect_list("l_linenumber"), asc=False).alias("e"))
    return g.select("file", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("edits"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100")
def o2_order_limit(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(100)


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def o4_top_one(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("last"))


# ---- planning ------------------------------------------------------------------------------------------------------


def _resolved(spark, d):
    """Imports of suppliers' files with the nation's file they resolve to."""
    found = facts(_js(spark, d)).where("kind = 'import_path'")
    return found.select("path", "value", "span_start", "span_end", F.concat(F.replace("value", F.lit("../"), F.lit("")), F.lit(".ts")).alias("target"))


@query("SELECT 'supplier/s' || s_suppkey || '.ts' AS path, '../moved/n' || s_nationkey AS new FROM supplier WHERE s_nationkey % 2 = 0")
def t8_plan_moves(spark, d):
    n = t(spark, d, "nation").where("n_nationkey % 2 = 0")
    moves = n.select(F.concat(F.lit("nation/n"), s("n_nationkey"), F.lit(".ts")).alias("old_path"), F.concat(F.lit("moved/n"), s("n_nationkey"), F.lit(".ts")).alias("new_path"))
    return planning.plan_moves(_resolved(spark, d), moves).select("path", "new")


@query("SELECT 'supplier/s' || s_suppkey || '.ts' AS path, '// é日🙂 ' || s_name || chr(10) || 'import { N' || s_nationkey || ' } from ' || chr(39) || '../moved/n' || s_nationkey || chr(39) || ';' || chr(10) || 'export const é = 1;' AS text FROM supplier WHERE s_nationkey % 2 = 0")
def t8_moves_applied(spark, d):
    """From text to facts to plan to text, behind and before characters of several bytes."""
    text = F.concat(F.lit("// é日🙂 "), F.col("s_name"), F.lit("\nimport { N"), s("n_nationkey"), F.lit(" } from '../nation/n"), s("n_nationkey"), F.lit("';\nexport const é = 1;"))
    files = blobs(suppliers(spark, d), F.concat(F.lit("supplier/s"), s("s_suppkey"), F.lit(".ts")), text)
    found = facts(files).where("kind = 'import_path'")
    found = found.withColumn("target", F.concat(F.replace("value", F.lit("../"), F.lit("")), F.lit(".ts")))
    n = t(spark, d, "nation").where("n_nationkey % 2 = 0")
    moves = n.select(F.concat(F.lit("nation/n"), s("n_nationkey"), F.lit(".ts")).alias("old_path"), F.concat(F.lit("moved/n"), s("n_nationkey"), F.lit(".ts")).alias("new_path"))
    return graph.apply_edits(files.select("path", "text"), planning.plan_moves(found, moves), "byte")


@query("SELECT 'f' || n_nationkey AS name, 'part ' || n_name AS label, '//' AS mark FROM nation WHERE n_nationkey % 2 = 0")
def r3_trailing_comments(spark, d):
    """Marks in comments behind code and in block comments, none in strings; the label is what stands behind the mark."""
    k = s("n_nationkey")
    mark = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("let z = 1; // SECTION: part "), F.col("n_name"))).otherwise("let z = \"// SECTION: no\";")
    text = F.concat(F.lit("fn before() {}\n"), mark, F.lit("\nfn f"), k, F.lit("() {}\n/* SECTION: end */\nfn after() {}\n"))
    body = {"rules": [{"name": "q", "context": [["file", "**/*.rs"]], "marker": ["SECTION:", None, "LABEL"], "line": "re:^fn $NAME\\("}]}
    rows = extract(blobs(nations(spark, d), F.concat(F.lit("src/n"), k, F.lit(".rs")), text), from_json(json.dumps(body)).rules)
    rows = rows.select(F.col("captures")["NAME"].alias("name"), F.col("captures")["LABEL"].alias("label"))
    return rows.where("label LIKE 'part %'").withColumn("mark", F.lit("//"))


@query("SELECT 'r' AS repo, 'supplier/s' || s_suppkey || '.ts' AS path, 'export_name' AS kind, 'S' || s_suppkey AS old_name, 'T' || s_suppkey AS new_name, 'rename' AS change FROM supplier WHERE s_suppkey % 3 = 0")
def t6_declaration_diff(spark, d):
    before = _js(spark, d)
    key = F.regexp_extract("path", r"s(\d+)\.ts$", 1)
    after = before.withColumn("text", F.when(key.cast("long") % 3 == 0, F.replace("text", F.concat(F.lit("const S"), key), F.concat(F.lit("const T"), key))).otherwise(F.col("text")))
    changes = before.select("repo", F.lit("content_change").alias("change_type"), F.col("path").alias("new_path"))
    return watch.declaration_changes(changes, before, after)


@query("SELECT s_nationkey || '' AS repo, s_suppkey FROM supplier WHERE s_nationkey % 3 <> 0 OR s_nationkey % 2 = 0 AND s_suppkey % 2 = 0")
def k1_rescan(spark, d):
    """Two scans into one table: the second has fewer rows in some partitions and none any more in others."""
    path = new_path(spark, "rescan")
    every = t(spark, d, "supplier").select(s("s_nationkey").alias("repo"), F.lit("main").alias("rev"), "s_suppkey")
    sinks.write_rows(every, path)
    again = every.where("repo % 3 = 0")
    sinks.write_rows(again.where("repo % 2 = 0 AND s_suppkey % 2 = 0"), path, again)
    return spark.read.schema(every.schema).parquet(path).select("repo", "s_suppkey")


@query("SELECT 'nation/n' || s_nationkey || '.ts' AS target, count(*) AS broken FROM supplier WHERE s_nationkey < 10 GROUP BY s_nationkey")
def t10_broken_imports(spark, d):
    gone = t(spark, d, "nation").where("n_nationkey < 10").select(F.concat(F.lit("nation/n"), s("n_nationkey"), F.lit(".ts")).alias("path"))
    return planning.broken_imports(_resolved(spark, d), gone)


@query("SELECT 's' || s_suppkey AS path, CAST(9 AS BIGINT) AS begins, CAST(9 + 3 AS BIGINT) AS ends FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'n3', 9, 12")
def t9_plan_rename(spark, d):
    row = lambda df, path, target, reexport: df.select(path.alias("path"), F.lit("Foo").alias("name"), F.lit(None).cast("string").alias("alias"), target.alias("target"), F.lit(reexport).alias("reexport"), F.lit(9).alias("span_start"), F.lit(12).alias("span_end"))
    names = row(t(spark, d, "nation"), F.concat(F.lit("n"), s("n_nationkey")), F.concat(F.lit("core"), s("n_nationkey")), True)
    names = names.unionByName(row(t(spark, d, "supplier"), F.concat(F.lit("s"), s("s_suppkey")), F.concat(F.lit("n"), s("s_nationkey")), False))
    return planning.plan_rename(names, "core3", "Foo", "Bar").select("path", F.col("begin").cast("long").alias("begins"), F.col("end").cast("long").alias("ends"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey < 3) AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey)")
def j9_relay(spark, d):
    file = F.col("s_nationkey").alias("path")
    imports = t(spark, d, "supplier").select(file, F.col("s_nationkey").alias("name"), F.lit("core").alias("target"), "s_suppkey")
    wanted = t(spark, d, "nation").where("n_regionkey < 3").select(F.lit("core").alias("target"), F.col("n_nationkey").alias("name"))
    exports = t(spark, d, "customer").select(F.col("c_nationkey").alias("path"), F.col("c_nationkey").alias("name"))
    return graph.relays(imports, wanted, exports).select("s_suppkey")


@query("SELECT s_nationkey AS nation, min(s_name) AS first FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey) GROUP BY s_nationkey")
def j10_upstream(spark, d):
    imports = t(spark, d, "supplier").select(F.col("s_name").alias("path"), F.lit("N").alias("name"), F.col("s_nationkey").alias("target"))
    exports = t(spark, d, "customer").select(F.col("c_nationkey").alias("path"), F.lit("N").alias("name"))
    return graph.upstream(imports, exports).select(F.col("target").alias("nation"), "first")


@query("SELECT 'm' || o_orderkey AS new_path, 'o' || o_orderkey AS old_path FROM orders WHERE o_orderkey % 10 = 1")
def j15_move_correlation(spark, d):
    return _changes(spark, d)[1].where("change_type = 'move'").select("new_path", "old_path")


@query("SELECT kind, name FROM (SELECT 'f' AS kind, 'f' || n_nationkey AS name FROM nation UNION ALL SELECT 'rs_declare', 'f' || n_nationkey FROM nation)")
def u3_extractor_union(spark, d):
    df = blobs(nations(spark, d), F.concat(F.lit("src/n"), s("n_nationkey"), F.lit(".rs")), F.concat(F.lit("fn f"), s("n_nationkey"), F.lit("() {}\n")))
    ruled = rule(df, "fs(**/*.rs) > line(re:fn (?P<NAME>\\w+).*)", name="NAME").select(F.lit("f").alias("kind"), "name")
    return ruled.unionByName(facts(df).select("kind", F.col("value").alias("name")))


@query("SELECT p_brand AS check_name, count(*) AS n FROM part WHERE p_size > 45 GROUP BY p_brand")
def k10_violation_list(spark, d):
    rows = t(spark, d, "part").where("p_size > 45")
    found = sinks.violations("size", rows.select("p_brand", "p_partkey"))
    return found.groupBy(F.get_json_object("violation_data", "$.p_brand").alias("check_name")).agg(F.count("*").alias("n"))
