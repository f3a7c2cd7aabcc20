"""Queries over the driver's tables and their SQL twins, by operator id.

Each query shows one operator (or a few that go together) on whole tables; its twin says the same in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import graph, lines, sinks, tree
from .plans.language import parse_json
from .plans.patterns import allows, compile_pattern
from .streaming import watch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- patterns and context ------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_extract(url, '^([^/]+)://([^/]+)/(.*)$', 1) AS proto, regexp_extract(url, '^([^/]+)://([^/]+)/(.*)$', 2) AS host,
  regexp_extract(url, '^([^/]+)://([^/]+)/(.*)$', 3) AS path FROM pages WHERE regexp_matches(url, '^[^/]+://[^/]+/.*$')""")
def m5_url_segments(spark, d):
    p = compile_pattern("$PROTO://$HOST/$$$PATH")
    pages = t(spark, d, "pages").where(p.matches(F.col("url")))
    return pages.select("page_id", *[c.alias(n.lower()) for n, c in p.captures(F.col("url")).items()])


@query(r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://.*\.org/.*$') OR regexp_matches(url, '^http://.*\.com/en/.*$')""")
def m1_glob_alternatives(spark, d):
    return t(spark, d, "pages").where(compile_pattern("https://*.org/*|http://*.com/en/*").matches(F.col("url"))).select("page_id", "url")


@query(r"""SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1), '') AS lang, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS num FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+')""")
def m3_regex_groups(spark, d):
    p = compile_pattern("re:/(?P<LANG>[a-z]{2})/(?P<NUM>[0-9]+)")
    return t(spark, d, "pages").where(p.matches(F.col("url"))).select("page_id", *[c.alias(n.lower()) for n, c in p.captures(F.col("url")).items()])


@query("""SELECT s_suppkey, n_nationkey, split_part(pair, ':', 2) AS tag FROM (SELECT s_suppkey, n_nationkey, n_name, n_name || ':' || s_suppkey AS pair FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def m6_bound_segment(spark, d):
    both = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pair = F.concat_ws(":", "n_name", F.col("s_suppkey").cast("string"))
    hit, found = compile_pattern("$NATION:$TAG").bound(pair, {"NATION": F.col("n_name")})
    return both.where(hit).select("s_suppkey", "n_nationkey", found["TAG"].alias("tag"))


@query("SELECT p_partkey, regexp_extract(p_name, '^(\\S+)', 1) AS first, instr(p_name, ' ') - 1 AS first_end FROM part WHERE p_name LIKE '% %'")
def m7_capture_offsets(spark, d):
    p = compile_pattern("$FIRST $$$REST")
    part = t(spark, d, "part").where(p.matches(F.col("p_name")))
    first = p.captures(F.col("p_name"))["FIRST"]
    return part.select("p_partkey", first.alias("first"), F.octet_length(first).cast("long").alias("first_end"))


_LINES = "SELECT doc_id, i - 1 AS line_no, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (i = n AND l = '')"


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, length(l) AS n FROM ({_LINES})")
def s14_lines(spark, d):
    return lines.lines(t(spark, d, "documents"), "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n"))


@query(rf"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(l, '^([^/]+?) under (.*)$', 1) AS head, regexp_extract(l, '^([^/]+?) under (.*)$', 2) AS rest FROM ({_LINES}) WHERE regexp_matches(l, '^[^/]+? under .*$')")
def m8_line_segments(spark, d):
    return lines.matching(t(spark, d, "documents"), "text", "$HEAD under $$$REST", ["doc_id"]).withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(l, '^(?:Licensed under (.+?)\.)$', 1) AS name FROM ({_LINES}) WHERE regexp_matches(l, '^(?:Licensed under (.+?)\.)$')")
def m9_line_regex_raw(spark, d):
    return lines.matching(t(spark, d, "documents"), "text", r"re:Licensed under (?P<NAME>.+?)\.", ["doc_id"]).withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(l, 'under (\S+) (.+)', 1) AS a, regexp_extract(l, 'under (\S+) (.+)', 2) AS b FROM ({_LINES}) WHERE regexp_matches(l, 'under [a-zA-Z0-9._/-]+ .+')")
def m10_line_regex(spark, d):
    return lines.matching(t(spark, d, "documents"), "text", "re:under $A $$$B", ["doc_id"]).withColumn("line_no", F.col("line_no").cast("long"))


_PATHS = "SELECT doc_id, source, lang, lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents"


def _virtual(spark, d):
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t(spark, d, "documents").select("doc_id", "source", "lang", path.alias("path"))


@query(rf"SELECT doc_id, path FROM ({_PATHS}) WHERE regexp_matches(path, '^de/src1/.*\.txt$')")
def p1_fs_glob(spark, d):
    return _virtual(spark, d).where(compile_pattern("de/src1/*.txt").matches(F.col("path"))).select("doc_id", "path")


@query(rf"SELECT doc_id, path FROM ({_PATHS}) WHERE source = 'src1'")
def p2_folder(spark, d):
    return _virtual(spark, d).where(compile_pattern("**/src1/**").matches(F.col("path"))).select("doc_id", "path")


@query(rf"SELECT doc_id, source, lang AS repo FROM ({_PATHS}) WHERE lang IN ('en', 'de') AND source LIKE 'src1%'")
def p3_repo_rev_context(spark, d):
    keep = compile_pattern("en|de").matches(F.col("lang")) & compile_pattern("src1*").matches(F.col("source"))
    return _virtual(spark, d).where(keep).select("doc_id", "source", F.col("lang").alias("repo"))


@query(rf"SELECT lang, count(*) AS n FROM ({_PATHS}) WHERE regexp_matches(path, '^(en|fr)/.*$') AND NOT regexp_matches(path, '7\.txt$') GROUP BY lang")
def s7_filter(spark, d):
    return _virtual(spark, d).where(allows(F.col("path"), ["en/**", "fr/**"], ["**/*7.txt"])).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT r AS rev, regexp_matches(r, '^v?[0-9]+[-.+][0-9]+[-.+][0-9]+([-.+].*)?$') AS semver FROM (SELECT 'v' || (p_size % 5) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 2 = 0 THEN '.' || p_size ELSE '' END AS r FROM part)")
def s6_semver(spark, d):
    part = t(spark, d, "part")
    r = F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("."), F.col("p_size").cast("string"))).otherwise(""))
    return part.select(r.alias("rev")).distinct().withColumn("semver", fn.is_semver(F.col("rev")))


# ---- trees ---------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return t(spark, d, "events").select("event_id", F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), "props")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def w1_json_key(spark, d):
    steps, _ = parse_json("{ k: $K }")
    return tree.native(_events(spark, d), F.try_parse_json("props"), steps, ["event_id"]).withColumnRenamed("K", "k")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
def a2_topk(spark, d):
    kept = _events(spark, d).where(compile_pattern("events/*").matches(F.col("path")))
    steps, _ = parse_json("{ k: $K }")
    rows = tree.native(kept, F.try_parse_json("props"), steps, ["event_id"])
    return rows.groupBy(F.col("K").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


def _nation_docs(spark, d):
    """One JSON document per region: {region: {name, nations: [{name, key}]}, suppliers: {name: nation}}."""
    n, r, s = t(spark, d, "nation"), t(spark, d, "region"), t(spark, d, "supplier")
    nations = n.groupBy(F.col("n_regionkey").alias("nk")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))).alias("nations"))
    sup = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("sk")).agg(F.map_from_entries(F.collect_list(F.struct("s_name", "n_name"))).alias("suppliers"))
    both = r.join(nations, F.col("r_regionkey") == F.col("nk")).join(sup, F.col("r_regionkey") == F.col("sk"), "left")
    return both.select("r_regionkey", F.to_json(F.struct(F.struct(F.col("r_name").alias("name"), "nations").alias("region"), F.coalesce("suppliers", F.create_map().cast("map<string,string>")).alias("suppliers"))).alias("doc"))


@query("SELECT r_regionkey, s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def w2_key_iter(spark, d):
    steps, _ = parse_json("{ suppliers: { $SUPPLIER: $NATION } }")
    return tree.native(_nation_docs(spark, d), F.try_parse_json("doc"), steps, ["r_regionkey"]).withColumnsRenamed({"SUPPLIER": "supplier", "NATION": "nation"})


@query("SELECT r_regionkey, r_name AS region, n_name AS nation, CAST(n_nationkey AS VARCHAR) AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def w11_object(spark, d):
    steps, _ = parse_json("{ region: { name: $REGION, nations: [...{ name: $NATION, key: $KEY }] } }")
    return tree.native(_nation_docs(spark, d), F.try_parse_json("doc"), steps, ["r_regionkey"]).withColumnsRenamed({"REGION": "region", "NATION": "nation", "KEY": "key"})


@query("SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def w12_array(spark, d):
    steps, _ = parse_json("{ region: { nations: [...{ key: $KEY }] } }")
    return tree.native(_nation_docs(spark, d), F.try_parse_json("doc"), steps, ["r_regionkey"]).withColumnRenamed("KEY", "key")


@query("SELECT n_regionkey || '.json' AS path, n_name AS name, 'region/nations' AS node_path FROM nation UNION ALL SELECT r_regionkey || '.json', r_name, 'region' FROM region")
def w3_descent(spark, d):
    from .operators.extract import extract
    from .plans.language import parse

    docs = _nation_docs(spark, d)
    blobs = docs.select(F.lit("r").alias("repo"), F.lit("main").alias("rev"), F.array().cast("array<string>").alias("tags"), F.concat(F.col("r_regionkey").cast("string"), F.lit(".json")).alias("path"), F.col("doc").alias("text"))
    rows = extract(blobs, parse("rule(names) { fs(*.json) > json({ **: { name: $NAME } }) };").rules)
    # Array items keep the path of what holds them; the descent itself names the index.
    return rows.select("path", F.col("captures")["NAME"].alias("name"), F.regexp_replace("node_path", r"/\d+$", "").alias("node_path"))


@query("SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j13_cross_rule(spark, d):
    from .operators.extract import tables
    from .plans.language import parse

    pair = lambda df, kind, key, cols: df.select(F.lit("r").alias("repo"), F.lit("main").alias("rev"), F.array().cast("array<string>").alias("tags"), F.concat(F.lit(kind + "/"), F.col(key).cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(*cols)).alias("text"))
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    blobs = pair(nations, "nation", "n_nationkey", ["n_name", "n_nationkey", "r_name"]).unionByName(pair(t(spark, d, "supplier"), "supplier", "s_suppkey", ["s_suppkey", "s_nationkey"]))
    program = parse("""
      rule(nation) { fs(nation/*) > json({ n_name: $NATION, n_nationkey: $KEY, r_name: $REGION }) };
      rule(of) { nation(nation: $NATION, key: $KEY, region: $REGION) { fs(supplier/*) > json({ s_suppkey: $SUPPLIER, s_nationkey: $KEY }) } };
    """)
    return tables(blobs, program)["of"].select(F.col("supplier").cast("long").alias("s_suppkey"), "nation", "region")


# ---- regions and markdown ------------------------------------------------------------------------------------------

_MARKS = "SELECT page_id, unnest(string_split(html, '><')) AS l, generate_subscripts(string_split(html, '><'), 1) AS i FROM pages"


def _page_lines(spark, d):
    return t(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "><")).alias("line_no", "line"))


@query(f"SELECT page_id, CAST(i AS BIGINT) AS begins, CAST(lead(i) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS ends FROM ({_MARKS}) WHERE regexp_matches(l, '^!-- ')")
def r1_marker_sequential(spark, d):
    marked = _page_lines(spark, d).where(F.regexp_like("line", F.lit("^!-- ")))
    return marked.select("page_id", (F.col("line_no") + 1).cast("long").alias("begins"), (F.lead("line_no").over(Window.partitionBy("page_id").orderBy("line_no")) + 1).cast("long").alias("ends"))


@query(f"SELECT page_id, count(*) AS n FROM ({_MARKS}) WHERE regexp_matches('<' || l, '^\\s*(//|#|--|/\\*|\\*|<!--)') GROUP BY page_id")
def r4_comments(spark, d):
    return _page_lines(spark, d).where(F.regexp_like(F.concat(F.lit("<"), F.col("line")), F.lit(r"^\s*(//|#|--|/\*|\*|<!--)"))).groupBy("page_id").agg(F.count("*").alias("n"))


def _markdown(spark, d):
    """A text per region: a heading, its nations as list items and table rows, and a link and a quotation each."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    item = F.concat(F.lit("- "), F.col("n_name"), F.lit("\n| "), F.col("n_name"), F.lit(" |\n> "), F.col("n_name"), F.lit("\n["), F.col("n_name"), F.lit("](n/"), F.col("n_nationkey").cast("string"), F.lit(")\n```lang"), F.col("n_nationkey").cast("string"), F.lit("\nbody\n```\n"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("body"))
    text = F.concat(F.lit("# Top\n- before\n## "), F.col("r_name"), F.lit("\n"), F.col("body"), F.lit("## After\n- behind\n"))
    return r.join(body, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.col("r_name"), text.alias("text"))


_N = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT r_regionkey, r_name AS title, n_name AS item {_N} UNION ALL SELECT r_regionkey, 'After', 'behind' FROM region")
def r6_md_heading_scope(spark, d):
    scoped = lines.under_headings(_markdown(spark, d), "text", 2, ["r_regionkey"])
    return scoped.where(F.regexp_like("line", F.lit(r"^[ \t]*(?:[-*+]|\d+[.)]) (.+)"))).select("r_regionkey", "title", F.regexp_extract("line", r"^[ \t]*(?:[-*+]|\d+[.)]) (.+)", 1).alias("item"))


@query(f"SELECT r_regionkey, n_name AS item {_N} UNION ALL SELECT r_regionkey, unnest(['before', 'behind']) FROM region")
def r8_list(spark, d):
    return lines.items(_markdown(spark, d), "text", ["r_regionkey"])


@query(f"SELECT r_regionkey, n_name AS text, 'n/' || n_nationkey AS url {_N}")
def r9_links(spark, d):
    return lines.links(_markdown(spark, d), "text", ["r_regionkey"])


@query(f"SELECT r_regionkey, 'lang' || n_nationkey AS lang, 'body' AS body {_N}")
def r10_fence(spark, d):
    return lines.fences(_markdown(spark, d), "text", ["r_regionkey"])


@query(f"SELECT r_regionkey, n_name AS cells {_N}")
def r11_row(spark, d):
    return lines.rows(_markdown(spark, d), "text", ["r_regionkey"])


@query(f"SELECT r_regionkey, n_name AS quote {_N}")
def r12_quote(spark, d):
    return lines.quotes(_markdown(spark, d), "text", ["r_regionkey"])


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def j3_core_chain(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j4_scope_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT DISTINCT o_custkey AS repo FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 <> 0)")
def j5_unscanned(spark, d):
    wanted = t(spark, d, "orders").select(F.col("o_custkey").alias("repo")).distinct()
    have = t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("repo"))
    return graph.unscanned(wanted, have, ["repo"])


@query("SELECT DISTINCT p_brand AS repo, p_size AS rev FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 2 = 0 AND lower(regexp_replace(b.p_brand, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(a.p_brand, '[^A-Za-z0-9]', '', 'g')) AND b.p_size = a.p_size)")
def j6_pairs(spark, d):
    part = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.col("p_size").alias("rev"))
    return graph.unscanned(part.select("repo", "rev").distinct(), part.where("p_partkey % 2 = 0").select(F.upper("repo").alias("repo"), "rev"), ["repo", "rev"], ["repo"])


@query("SELECT 'no_orders' AS check_name, c_custkey AS key FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j7_check_missing(spark, d):
    missing = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("key"))
    found = sinks.violations("no_orders", missing)
    return found.select("check_name", F.get_json_object("violation_data", "$.key").cast("long").alias("key"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey >= 2), u(n, r, k) AS (SELECT c, p, 1 FROM e UNION ALL SELECT n, e.p, k + 1 FROM u JOIN e ON e.c = r WHERE k < 50) SELECT n AS node, arg_max(r, k) AS root, CAST(max(k) AS BIGINT) AS depth FROM u GROUP BY n")
def j11_chain_root(spark, d):
    edges = t(spark, d, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return graph.chain_root(edges).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def j12_theta(spark, d):
    a, b = t(spark, d, "nation").alias("a"), t(spark, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON lower(regexp_replace(a.p_name, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(b.p_name, '[^A-Za-z0-9]', '', 'g')) AND a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand")
def j14_link_norm(spark, d):
    none = F.lit(None).cast("string")
    p = t(spark, d, "part").where("p_partkey IS NOT NULL").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("value"), F.col("p_brand").alias("repo"), none.alias("path"), none.alias("target"))
    return graph.linked(p, p, ["norm", "repo"]).where("src < tgt").select(F.col("src").alias("a"), F.col("tgt").alias("b"))


@query("SELECT s_suppkey AS src, n_nationkey AS tgt FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0")
def j14_link_import(spark, d):
    name, file = F.concat(F.lit("N"), F.col("n_nationkey")), F.concat(F.lit("n/n"), F.col("n_nationkey"), F.lit(".ts"))
    n = t(spark, d, "nation")
    exports = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "rs_mod").otherwise("export_name").alias("kind"), name.alias("value"), F.lit("r").alias("repo"), file.alias("path"), F.lit(None).cast("string").alias("target"))
    users = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    imports = users.select(F.col("s_suppkey").alias("id"), F.lit("import_name").alias("kind"), name.alias("value"), F.lit("r").alias("repo"), F.concat(F.lit("s/s"), F.col("s_suppkey"), F.lit(".ts")).alias("path"), file.alias("target"))
    return graph.linked(imports, exports, [("and", [("kind", "src", "import_name"), ("kind", "tgt", "export_name"), "target", "string"])])


@query("SELECT s_suppkey AS src, n_nationkey AS tgt FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j14_link_stem(spark, d):
    n = t(spark, d, "nation")
    none = F.lit(None).cast("string")
    files = n.select(F.col("n_nationkey").alias("id"), F.lit("file").alias("kind"), none.alias("value"), F.lit("r").alias("repo"), F.concat(F.lit("n/Nation"), F.col("n_nationkey"), F.lit(".rs")).alias("path"), none.alias("target"))
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("rs_mod").alias("kind"), F.concat(F.lit("nation-"), F.col("s_nationkey")).alias("value"), F.lit("r").alias("repo"), none.alias("path"), none.alias("target"))
    return graph.linked(names, files, [("stem", "tgt"), "repo"])


@query("SELECT l_orderkey || '' AS file, 'declare' AS kind, 'n' || l_linenumber AS old_name, 'm' || l_linenumber AS new_name, 'rename' AS change FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL")
def j16_nearest_span(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.lit("declare").alias("kind"), F.col("l_linenumber").alias("n")).distinct()
    old = li.select("file", "kind", F.concat(F.lit("n"), F.col("n").cast("string")).alias("name"), (F.col("n") * 200).cast("long").alias("span"))
    new = li.select("file", "kind", F.concat(F.when(F.col("n") % 2 == 0, "m").otherwise("n"), F.col("n").cast("string")).alias("name"), (F.col("n") * 200 + 40).cast("long").alias("span"))
    return graph.nearest_spans(old, new)


@query("WITH RECURSIVE r(n) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 0 UNION SELECT n // 2 FROM r WHERE n >= 2) SELECT n AS node FROM r")
def t14_fixpoint(spark, d):
    part = t(spark, d, "part")
    edges = part.where("p_partkey >= 2").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("next"))
    return graph.fixpoint(part.where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node")), lambda front: front.join(edges, "node").select(F.col("next").alias("node")))


# ---- incremental ---------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id || '.txt' AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3),
n AS (SELECT doc_id || '.txt' AS path, md5(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4),
came AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM n WHERE path NOT IN (SELECT path FROM o)),
gone AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM o WHERE path NOT IN (SELECT path FROM n)),
pairs AS (SELECT came.path AS path, gone.path AS old_path FROM came JOIN gone ON came.h = gone.h AND came.k = gone.k)
SELECT path, 'renamed' AS change, old_path FROM pairs
UNION ALL SELECT path, 'added', NULL FROM came WHERE path NOT IN (SELECT path FROM pairs)
UNION ALL SELECT path, 'deleted', NULL FROM gone WHERE path NOT IN (SELECT old_path FROM pairs)
UNION ALL SELECT n.path, 'changed', NULL FROM n JOIN o ON n.path = o.path WHERE n.h <> o.h""")
def s5_diff(spark, d):
    docs = t(spark, d, "documents")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    old = docs.where("doc_id % 10 <> 3").select(path, F.md5("text").alias("hash"))
    new = docs.where("doc_id % 10 <> 4").select(path, F.md5(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return graph.snapshot_diff(old, new)


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 5 OR doc_id % 10 = 3")
def t12_skip_set(spark, d):
    docs = t(spark, d, "documents")
    seen = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("hash"))
    now = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return now.join(seen, ["doc_id", "hash"], "left_anti").select("doc_id")


@query("SELECT DISTINCT p_name AS value, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS norm FROM part")
def k2_intern(spark, d):
    return sinks.strings(t(spark, d, "part").select(F.col("p_name").alias("value"))).select("value", "norm")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def k3_first_wins(spark, d):
    return sinks.first_wins(t(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS click, max(CASE WHEN event_type = 'view' THEN event_id END) AS view FROM events GROUP BY user_id")
def k5_pivot(spark, d):
    return t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("event_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'moved/' || o_orderkey ELSE 'old/' || o_orderkey END AS path FROM orders")
def k8_rename(spark, d):
    files = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("old/"), F.col("o_orderkey").cast("string")).alias("path"))
    moves = files.where("o_orderkey % 7 = 0").select("path", F.concat(F.lit("moved/"), F.col("o_orderkey").cast("string")).alias("new_path"))
    return sinks.renamed(files, moves).select("o_orderkey", "path")


@query("SELECT p_partkey || '' AS path, '// é日🙂 ' || upper(substr(p_name, 1, 3)) || substr(p_name, 4) || ' é!' AS text FROM part WHERE length(p_name) >= 3")
def k14_apply_edits(spark, d):
    """Spans in bytes, behind characters of two, three and four bytes."""
    part = t(spark, d, "part").where("length(p_name) >= 3").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("// é日🙂 "), F.col("p_name"), F.lit(" é")).alias("text"), F.upper(F.substring("p_name", 1, 3)).alias("new"))
    begin, end = F.lit(len("// é日🙂 ".encode())), F.octet_length("text")
    edits = part.select("path", begin.alias("begin"), (begin + 3).alias("end"), "new").unionByName(part.select("path", end.alias("begin"), end.alias("end"), F.lit("!").alias("new")))
    return graph.apply_edits(part.drop("new"), edits, "byte")


# ---- aggregates and sets -------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents GROUP BY lang HAVING count(*) > 5")
def a3_overlap(spark, d):
    g = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.collect_set("source").alias("s"))
    return g.where("docs > 5").select("lang", "docs", F.size("s").cast("long").alias("sources"), F.array_join(F.sort_array("s"), ",").alias("names"))


@query("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT url) FROM pages) AS urls")
def a5_stats(spark, d):
    t(spark, d, "documents").createOrReplaceTempView("docs_")
    t(spark, d, "pages").createOrReplaceTempView("pages_")
    return spark.sql("SELECT (SELECT count(*) FROM docs_) AS docs, (SELECT count(*) FROM pages_) AS pages, (SELECT count(DISTINCT url) FROM pages_) AS urls")


@query("SELECT p_name AS value, string_agg(p_brand || ':' || p_partkey, ',' ORDER BY p_brand, p_partkey) AS refs, count(*) AS n FROM part WHERE contains(lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), 'al') GROUP BY p_name")
def a6_hits(spark, d):
    part = t(spark, d, "part").where(F.contains(fn.norm(F.col("p_name")), F.lit("al")))
    hits = part.groupBy(F.col("p_name").alias("value")).agg(F.sort_array(F.collect_list(F.struct("p_brand", "p_partkey"))).alias("r"), F.count("*").alias("n"))
    return hits.select("value", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["p_brand"], x["p_partkey"].cast("string"))), ",").alias("refs"), "n")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), 'apachelicense') ORDER BY lang, source, doc_id LIMIT 500")
def f8_search(spark, d):
    return sinks.search(t(spark, d, "documents"), "text", "Apache License", ["lang", "source", "doc_id"], 500).select("doc_id", "lang", "source")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT s_name, 'supplier' FROM supplier")
def u1_union(spark, d):
    each = [t(spark, d, n).select(F.col(c).alias("name"), F.lit(n).alias("kind")) for n, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def u4_difference(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return c.join(t(spark, d, "supplier"), F.col("s_nationkey") == F.col("k"), "left_anti").distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u5_intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS k, coalesce(lag(o_orderkey) OVER w, -1) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def a10_window(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("k"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1).cast("long")).alias("before"))


@query("WITH g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM g GROUP BY user_id, s")
def t1_sessions(spark, d):
    events = t(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("ts").alias("event_ts"))
    return watch.sessions(events, "6 hours").select(F.col("repo").alias("user_id"), F.col("begins").alias("first_ts"), "n")


# ---- scalar functions ----------------------------------------------------------------------------------------------


@query(r"SELECT page_id, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS page, CASE WHEN regexp_matches(url, 'https?') THEN regexp_extract(url, 'https?', 0) END AS scheme FROM pages")
def f1_re_extract(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", fn.re_extract(u, "page=([0-9]+)", 1).alias("page"), fn.re_extract(u, "https?", 0).alias("scheme"))


@query("SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 4 THEN string_split(url, '/')[4] END AS a, CASE WHEN len(string_split(url, '/')) >= 9 THEN string_split(url, '/')[9] END AS b FROM pages")
def f2_split_part(spark, d):
    return t(spark, d, "pages").select("page_id", fn.split_part(F.col("url"), "/", 4).alias("a"), fn.split_part(F.col("url"), "/", 9).alias("b"))


@query("SELECT s_suppkey, n_name AS repo_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def f3_lookup(spark, d):
    return t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("repo_name"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS norm FROM part")
def f6_norm(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.norm(F.col("p_name")).alias("norm"))


@query("WITH n AS (SELECT p_partkey, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS n FROM part) SELECT p_partkey, CASE WHEN n LIKE '_%steel' THEN n[:-6] WHEN n LIKE '_%tin' THEN n[:-4] WHEN n <> '' THEN n END AS norm2 FROM n")
def f7_norm2(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.norm2(F.col("p_type"), ["-STEEL", "tin"]).alias("norm2"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS oid FROM documents")
def f9_git_blob_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", fn.git_blob_hash(F.col("text").cast("binary")).alias("oid"))


@query(rf"SELECT doc_id, CAST(doc_id AS VARCHAR) AS stem, 'txt' AS ext, lang || '/' || source AS dir FROM ({_PATHS})")
def f10_path_parts(spark, d):
    p = F.col("path")
    return _virtual(spark, d).select("doc_id", fn.stem(p).alias("stem"), fn.extension(p).alias("ext"), fn.directory(p).alias("dir"))


@query("SELECT p_partkey, p_brand || '+wt' AS wt, p_brand AS base, true AS is_wt FROM part")
def f11_wt_rev(spark, d):
    b = F.col("p_brand")
    return t(spark, d, "part").select("p_partkey", fn.wt_rev(b).alias("wt"), fn.base_rev(fn.wt_rev(b)).alias("base"), fn.is_wt_rev(fn.wt_rev(b)).alias("is_wt"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'crate' WHEN 1 THEN 'crate::m' || p_size ELSE 'crate::m' || p_size || '::x' END AS module FROM part")
def f12_rust_module(spark, d):
    k, m = F.col("p_partkey") % 3, F.concat(F.lit("crates/c/src/m"), F.col("p_size").cast("string"))
    path = F.when(k == 0, F.lit("crates/c/src/lib.rs")).when(k == 1, F.concat(m, F.lit("/mod.rs"))).otherwise(F.concat(m, F.lit("/x.rs")))
    return t(spark, d, "part").select("p_partkey", fn.rust_module(path).alias("module"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '@s/p' || p_size ELSE 'p' || p_size END AS package FROM part")
def f17_package(spark, d):
    k, p = F.col("p_partkey") % 3, F.concat(F.lit("p"), F.col("p_size").cast("string"))
    spec = F.when(k == 0, F.concat(F.lit("./"), p)).when(k == 1, F.concat(F.lit("@s/"), p, F.lit("/deep"))).otherwise(F.concat(p, F.lit("/deep")))
    return t(spark, d, "part").select("p_partkey", fn.package_of(spec).alias("package"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^[^a]*al') THEN 1.0::DOUBLE WHEN lower(p_name) LIKE '%a%l%' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def f5_fzy(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.fzy_score(F.col("p_name"), F.lit("al")).alias("score"))
