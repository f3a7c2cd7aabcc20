"""Rules over small files: language, regions, trees, code, and the tables they make."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factweave.engine import RULES_VARIABLE, Engine, rule_files
from factweave.operators import code, regions, tree
from factweave.operators.extract import evaluate, extract, facts, tables
from factweave.plans import language, sqlgate
from factweave.plans.language import RuleError, parse

# A boat yard's files: a parts list, berths, a job sheet, a log book.
HULL = '[vessel]\nname = "tern"\nlength = "9"\n[fleet]\nberths = ["quay/north", "quay/south"]\n[fittings]\nmast = { wood = "spruce" }\nrudder = "oak"\nkeel = { wood = "elm" }\n[spare-fittings]\noar = "ash"\n'
BERTHS = "harbour:\n  pier:\n    mooring:\n      vessel: fleet/tern\n      slot: A7\n  yard:\n    mooring:\n      vessel: fleet/gull\n      slot: B2\nopen: 6\n"
JOBS = "PLANE spruce:9m AS mast\nCARRY a.list ./\nCARRY x y ./\nPLANE oak:2m\nCARRY --by=mast /yard/out /shed/in\n"
LOG = "# Voyage\nCalm\n## Loaded\nstow barrel rope\nstow barrel tar\n## Course\nstow barrel salt\nmet [buoy](n://7) and [light](n://9)\n```knots\n5\n```\n```tide\nebb\n```\n## Crew\n- mate\n- cook\n## Winds\n| n | e |\n|---|---|\n> all well\n"


def rows(chain, path, text, seeds=None):
    rule = parse(f"rule(r) {{ {chain} }};").rules[0]
    return sorted(tuple(v for v, *_ in caps.values()) for caps, _ in evaluate(rule, text, path, seeds or {}, {}))


@pytest.mark.parametrize(
    ("chain", "path", "text", "want"),
    [
        ("json({ vessel: { name: $NAME } })", "hull.toml", HULL, [("tern",)]),
        ("json({ re:^(spare-)?fittings: { $NAME: $_ } })", "hull.toml", HULL, [("keel",), ("mast",), ("oar",), ("rudder",)]),
        ("json({ fleet: { berths: [...$BERTH] } })", "hull.toml", HULL, [("quay/north",), ("quay/south",)]),
        ("json({ **: { mooring: { vessel: $V, slot: $S } } })", "berths.yaml", BERTHS, [("fleet/gull", "B2"), ("fleet/tern", "A7")]),
        ("json({ $KEY: $VAL })", "d.json", '{"sail":"red","hull":"black"}', [("hull", "black"), ("sail", "red")]),
        ('json({ radio: "$BAND-$CALL/$CHANNEL" })', "c.json", '{"radio":"vhf-GULL/16","watch":4}', [("vhf", "GULL", "16")]),
        ('json({ stores: { "^$DECK/$ITEM": $_ } })', "stores.json", '{"stores":{"rope":"1","^fore/tar":"1"}}', [("fore", "tar")]),
        ("json({ berth: $P, on: $O, none: $N })", "x.json", '{"berth":80,"on":true,"none":null}', []),
        ("json({ berth: $P, on: $O })", "x.json", '{"berth":80,"on":true}', [("80", "true")]),
        ("json({ a: $A })", "broken.json", "{", []),
        ("json({ a: $X, b: $X })", "x.json", '{"a":"1","b":"1"}', [("1",)]),
        ("line(PLANE $WOOD AS $PART)", "jobs", JOBS, [("spruce:9m", "mast")]),
        ("line(PLANE $WOOD:$SIZE)", "jobs", JOBS, [("oak", "2m"), ("spruce", "9m AS mast")]),
        ("line(re:PLANE\\s+$WOOD:$SIZE)", "jobs", JOBS, [("oak", "2m"), ("spruce", "9m")]),
        ("line(CARRY $$$THINGS $TO)", "jobs", "CARRY oars ./\nCARRY bow stern\nCARRY z\n", [("bow", "stern")]),
        ("md(## $PART)", "log.md", LOG, [("Course",), ("Crew",), ("Loaded",), ("Winds",)]),
        ("md(## Crew) > md(- $WHO)", "log.md", LOG, [("cook",), ("mate",)]),
        ("md([$MARK]($AT))", "log.md", LOG, [("buoy", "n://7"), ("light", "n://9")]),
        ("md(```$KIND)", "log.md", LOG, [("knots",), ("tide",)]),
        ("md(| $ROW |)", "log.md", LOG, [("n | e",)]),
        ("md(> $Q)", "log.md", LOG, [("all well",)]),
        ("md(## Loaded) > line(re:stow barrel $WHAT)", "log.md", LOG, [("rope",), ("tar",)]),
        ('marker("WATCH:") > line(re:bell\\s+$N)', "a.txt", "bell zero\n// WATCH: first\nbell one\nbell two\n// WATCH: dog\nbell three\n", [("one",), ("three",), ("two",)]),
        ('marker("ABOARD", "ASHORE") > line(re:bell\\s+$N)', "a.txt", "bell one\n# ABOARD\nbell two\n# ASHORE\nbell three\n", [("two",)]),
        ('marker("WATCH:") > line(re:^bell\\s+$N)', "a.rs", 'let s = "// WATCH: no";\nbell zero\nlet x = 1; // WATCH: yes\nbell one\n/* WATCH: more */ bell\nbell two\n', [("one",), ("two",)]),
        ("ast(process.env.$NAME)", "a.ts", "const a = process.env.HOME; // process.env.NO\nuse(process.env.PATH)", [("HOME",), ("PATH",)]),
        ("ast[rust](fn $NAME($$$ARGS) -> $RET { $$$BODY })", "a.rs", "fn add(a: i32, b: i32) -> i32 { a + b }", [("add", "a: i32, b: i32", "i32", "a + b")]),
        ("ast[tsx](use${ENTITY}Query($$$ARGS))", "a.tsx", "const { data } = useUserQuery({ id });", [("User", "{ id }")]),
        ('ast(import $NAME from "$PATH")', "a.ts", 'import React from "react";', [("React", "react")]),
    ],
)
def test_chains(chain, path, text, want):
    assert rows(chain, path, text) == want


def test_tree_steps():
    doc = {"a": {"b": {"c": "deep"}}, "shallow": "top", "packages": {"express@4": {"v": 1}}}
    assert [c["L"] for c, _ in tree.walk(doc, [("any",), ("depth_min", 3), ("leaf", "L")])] == ["deep", "1"]
    assert [p for _, p in tree.walk(doc, [("key", "packages", None), ("keymatch", ["$N@$V"], None), ("key", "v", None), ("leaf", "X")])] == [("packages", "express@4", "v")]
    assert [c["I"] for c, _ in tree.walk({"a": [1, 2]}, [("key", "a", None), ("item",), ("leaf", "I")])] == ["1", "2"]
    assert tree.load("a: yes\nb: 2020-01-01\nc: true", "yaml") == {"a": "yes", "b": "2020-01-01", "c": True}


def test_rules_know_their_level_and_errors():
    text = "rule(a) { fs(*) > json({ x: $X }) };\nrule(b) { a(x: $X) { fs(*) > json({ y: $Y }) } };\nrule(c) { b(y: $Y) fs(*) > json({ y: $Y, z: $Z }) };"
    assert language.levels(parse(text)) == [["a"], ["b"], ["c"]]
    with pytest.raises(RuleError, match="circle"):
        language.levels(parse("rule(a) { b(x: $X) { json({ x: $X }) } }; rule(b) { a(x: $X) { json({ x: $X }) } };"))
    for bad in ("rule(a) { nope(x: $X) { json({ x: $X }) } };",):
        with pytest.raises(RuleError):
            language.levels(parse(bad))
    for bad in ("rule(a) { json({ a: $A; b: $B }) };", "rule(a) { json({ a: $A ) };", "rule(a) { line(x) > line(y) };", "rule(a) { json({ x: $X }) > fs(*) };", "table(a) {};"):
        with pytest.raises(RuleError):
            parse(bad)
    branched = parse("rule(r) { repo($REPO) { rev(main) > json({ i: $PROD }); rev(staging) > json({ i: $STAGE }) } };")
    assert len(branched.rules) == 2 and branched.columns("r") == ["REPO", "PROD", "STAGE"]
    scans = parse("rule(s) { json({ image: { repository: repo($R), tag: rev.norm($T) } }) };")
    assert language.scan_columns(scans, "s") == ("R", "T") and scans.rules[0].normed == ["T"]


def test_hashes_tell_schema_from_extraction():
    h = lambda t: language.hashes(parse(t))["a"]
    one, other, wider = h("rule(a) { json({ x: $X }) };"), h("rule(a) { json({ y: $X }) };"), h("rule(a) { json({ x: $X, y: $Y }) };")
    assert one[0] == other[0] and one[1] != other[1] and one[0] != wider[0]
    from factweave.operators.sinks import migration

    assert migration({"a": one, "z": one}, {"a": other, "b": one}) == {"z": "drop", "a": "empty", "b": "create"}


BLOB = "repo string, rev string, tags array<string>, path string, text string"


def test_tables_join_rules_and_unite_branches(spark):
    blobs = spark.createDataFrame(
        [
            ("port", "main", ["v1.0.0"], "plan/berths.yaml", BERTHS),
            ("fleet", "main", [], "boats/small/hull.json", '{"name":"tern","fittings":{"mast":"spruce"}}'),
            ("fleet", "dev", [], "boats/small/hull.json", '{"name":"other"}'),
            ("fleet", "main", [], "bad.json", None),
        ],
        BLOB,
    )
    program = parse(
        """
        rule(mooring) { fs(**/berths.yaml) > json({ **: { mooring: { vessel: "$FLEET/$NAME", slot: $SLOT } } }) };
        rule(owner) { mooring(name: $NAME, slot: $SLOT) { fs(**/hull.json) > json({ name: $NAME, fittings: { $PART: $WOOD } }) } };
        rule(where) { repo($R) { rev(main) { folder(boats/$CLASS) { fs(**/hull.json) > json({ name: $N }) } } } };
        rule(tagged) { tag(v*) > fs(**/berths.yaml) > json({ open: $V }) };
        rule(both) { fs(**/hull.json) > json({ name: $N }) }; rule(both) { fs(**/berths.yaml) > json({ open: $N }) };
        """
    )
    got = tables(blobs, program)
    assert [(r.name, r.slot, r.part, r.wood) for r in got["owner"].collect()] == [("tern", "A7", "mast", "spruce")]
    assert [(r.r, r["class"], r.n) for r in got["where"].collect()] == [("fleet", "small", "tern")]
    assert [r.v for r in got["tagged"].collect()] == ["6"]
    assert sorted(r.n for r in got["both"].collect()) == ["6", "other", "tern"]
    # One pass of Python over the files for all rules; what is read afterwards are its rows.
    assert "MapInArrow" not in got["owner"]._jdf.queryExecution().executedPlan().toString()


def test_a_rule_must_share_a_capture_with_its_reference(spark):
    blobs = spark.createDataFrame([("a", "main", [], "x.json", '{"x":1}')], BLOB)
    program = parse("rule(a) { fs(*) > json({ x: $X }) }; rule(b) { a(x: $X) { fs(*) > json({ y: $Y }) } };")
    with pytest.raises(RuleError, match="every row"):
        tables(blobs, program)


def test_the_gate_reads_whole_statements(spark):
    spark.range(3).createOrReplaceTempView("gate_rows")
    for good in ("WITH x AS (SELECT 1 AS a) SELECT * FROM x;", "SELECT ';' AS a -- one; two\n", "/* a; b */ SELECT id FROM gate_rows WHERE id IN (SELECT id FROM gate_rows)", "EXPLAIN FORMATTED SELECT 1", "(SELECT 1)".strip("()")):
        assert sqlgate.sql(spark, good).count() > 0
    for bad in ("WITH x AS (SELECT 1 AS a) INSERT INTO tt SELECT * FROM x", "SELECT 1; SELECT 2", "EXPLAIN INSERT INTO tt SELECT 1", "WITH x AS (SELECT 1 AS a) FROM x INSERT INTO t1 SELECT a INSERT INTO t2 SELECT a", "CREATE TABLE t AS SELECT 1", "SET a=b", ""):
        with pytest.raises(sqlgate.Refused):
            sqlgate.sql(spark, bad)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("json_extract(j, '$.a.b')", "7"),
        ("json_extract(j, '$.none')", None),
        ("json_valid(j) || json_valid('{')", "10"),
        ("json_type('[1]') || json_type('3') || json_type('null') || json_type('\"x\"') || json_type(' true ')", "arrayintegernulltexttrue"),
        ("datetime(at)", "2024-02-29 13:05:09"),
        ("datetime('no time')", None),
        ("strftime('%H:%M:%S', at)", "13:05:09"),
        ("strftime('it''s %Y', at)", "it's 2024"),
        ("strftime('%Y/%m/%d at %H:%M', at)", "2024/02/29 at 13:05"),
        ("strftime('%j', at)", "060"),
        ("unixepoch('1970-01-02')", 86400),
        ("julianday('2000-01-01 12:00:00')", 2451545.0),
        ("iif(1 < 2, 'y', 'n')", "y"),
        ("'iif(' || instr('abc', 'c') || substr('abc', 2, 1) || trim(' x ')", "iif(3bx"),
    ],
)
def test_functions_of_the_other_dialect(spark, text, want):
    spark.sql("""SELECT '{"a": {"b": 7}}' AS j, '2024-02-29 13:05:09' AS at""").createOrReplaceTempView("told")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        assert sqlgate.sql(spark, f"SELECT {text} AS r FROM told").first().r == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_json_each(spark):
    spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "[5, null]"), (3, "7"), (4, None)], "id int, j string").createOrReplaceTempView("held")
    got = sqlgate.sql(spark, "SELECT id, e.key, e.value FROM held, json_each(held.j) AS e").collect()
    assert sorted((r.id, r.key, r.value) for r in got if r.value) == [(1, "a", "1"), (1, "b", "x"), (2, "0", "5")] and len(got) == 4


def test_rule_files(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(RULES_VARIABLE, raising=False)
    with pytest.raises(FileNotFoundError, match="no rules"):
        rule_files()
    (tmp_path / "rules.json").write_text('{"rules": []}')
    assert rule_files() == ["rules.json"]
    for name in ("b.weave", "a.weave"):
        (tmp_path / name).write_text(f"rule({name[0]}) {{ line($X) }};")
    assert rule_files() == ["a.weave", "b.weave"]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "c.weave").write_text("rule(c) { line($X) };")
    monkeypatch.setenv(RULES_VARIABLE, "more")
    assert rule_files() == ["more/c.weave"]
    assert rule_files("*.weave") == ["a.weave", "b.weave"] and rule_files("more/c.weave") == ["more/c.weave"]
    assert [r.name for r in Engine(spark).load(".", "more").rules] == ["a", "b", "c"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="no rules"):
        rule_files("empty")


def test_engine_views_checks_and_gate(spark):
    blobs = spark.createDataFrame([("a", "main", [], "x.json", '{"name":"Foo-Bar","v":"1"}'), ("b", "main", [], "x.json", '{"name":"foo","v":"2"}')], BLOB)
    engine = Engine(spark)
    program = parse("rule(pkg) { fs(**/*.json) > json({ name: $NAME, v: $V }) }; check(ones) { SELECT name FROM pkg WHERE v = '1' }; check(none) { SELECT name FROM pkg WHERE v = '9' };")
    engine.scan(blobs, program)
    assert {r.name_norm for r in engine.sql("SELECT name_norm FROM pkg WHERE name LIKE 'FOO%'").collect()} == {"foobar", "foo"}
    assert engine.sql("SELECT GROUP_CONCAT(DISTINCT repo) AS r FROM pkg WHERE path GLOB '*.json'").collect()[0].r in ("a,b", "b,a")
    good, found = engine.check(program)
    assert not good and [json.loads(r.violation_data) for r in found["ones"].collect()] == [{"name": "Foo-Bar"}] and found["none"].isEmpty()
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)"):
        with pytest.raises(sqlgate.Refused):
            engine.sql(bad)
    assert engine.eval("json({ name: $N })", blobs).count() == 2


def test_spans_are_bytes(spark):
    blobs = spark.createDataFrame([("a", "main", [], "x.txt", "é é\nkey=välue\n")], BLOB)
    row = extract(blobs, parse("rule(r) { fs(*.txt) > line($K=$V) };").rules).collect()[0]
    assert row.captures == {"K": "key", "V": "välue"}
    assert (row.spans["K"].begin, row.spans["K"].end, row.spans["V"].begin, row.spans["V"].end) == (6, 9, 10, 16)


def test_javascript_facts():
    text = """import def, { a, b as c } from './x'; import * as ns from "y"; import 'side';
    export { d, e as f }; export { g as h } from './z'; export * from './w'; export default function main() {}
    export const k = 1; export class L {} export type { T } from './t';
    const r = require('req'); function inner() { require('no'); } import('dynamic'); // import x from 'comment'
    """
    got = {}
    for kind, value, *_ in code.js_facts(text):
        got.setdefault(kind, []).append(value)
    assert got["import_path"] == ["./x", "y", "side", "./z", "./w", "./t", "req"]
    assert got["import_name"][:4] == ["default", "a", "b", "*"]
    assert got["import_alias"] == ["def", "c", "ns"]
    assert got["export_name"] == ["d", "f", "h", "default", "k", "L", "T"]
    assert got["export_local_binding"] == ["e", "main"]
    for kind, value, begin, end, _ in code.js_facts(text):
        if kind == "import_path":
            assert text[begin:end] == value


def test_rust_facts():
    text = """use std::{io::{self, Write}, fmt}; use crate::a::B as C; use x::*;
    extern crate serde; mod m; #[path = "other.rs"] mod p; mod inner { pub fn deep() {} struct S; }
    pub fn f() { let use_ = 1; fn hidden() {} } struct T<'a> { x: &'a str } enum E { A } const K: u8 = 1; static mut G: u8 = 0;
    trait Tr { fn method(&self); type Out; } impl Tr for T<'_> { fn method(&self) { } const Z: u8 = 2; } type Al = u8;
    """
    got = {}
    for kind, value, *_ in code.rust_facts(text):
        got.setdefault(kind, []).append(value)
    assert got["rs_use"] == ["std::io", "std::io::Write", "std::fmt", "crate::a::B", "x::*"]
    assert got["rs_mod"] == ["m", "p", "inner"] and got["dep_name"] == ["serde"]
    assert got["rs_declare"] == ["deep", "S", "f", "T", "E", "K", "G", "Tr", "method", "Out", "method", "Z", "Al"]


JS_SAMPLE = "import def, { type a, b as c } from './x';\nimport * as ns from \"y\"; export { d, e as f } from './z'; export * as g from 'w';\nexport default async function* main() {} export const { h, i: j } = k; export abstract class L {} export type { T } from './t';\nconst r = require('req'); export default class extends M {}"
RUST_SAMPLE = '#[path = "other.rs"] pub(crate) mod p; use std::{io::{self, Write as W}, fmt::*}; extern crate serde; pub static mut G: u8 = 0; trait Tr { fn m(&self); } impl Tr for T<\'_> { fn m(&self) {} } union U { a: u8 } const fn c() {}'


def test_files_that_break_off_have_facts_but_raise_nothing():
    for find, sample in ((code.js_facts, JS_SAMPLE), (code.rust_facts, RUST_SAMPLE)):
        for at in range(len(sample) + 1):
            for text in (sample[:at], sample[at:]):
                for _, value, begin, end, _ in find(text):
                    assert value and 0 <= begin <= end <= len(text)


@given(st.lists(st.sampled_from("import export default from as type { } * ( ) , ; 'x' \"y\" a b require = class function #[path = \"q\"] use :: mod pub extern crate static mut trait impl fn const self super [ ]".split()), max_size=14))
def test_any_order_of_tokens_raises_nothing(parts):
    for text in (" ".join(parts), "".join(parts)):
        code.js_facts(text)
        code.rust_facts(text)
        list(code.structural(text, "import $X from $$$Y", "ts"))


def test_uses_without_self_and_super():
    text = "use self::a::B; use super::super::c::*; use crate::d; use super::{e, f::g}; use self::h as i;"
    assert [v for k, v, *_ in code.rust_facts(text) if k == "rs_use"] == ["a::B", "c::*", "crate::d", "e", "f::g", "h"]


def test_comments_by_syntax():
    text = "a('// no'); // é one\n/* two\nlines */ b(\"/* no */\") // three"
    assert [c for *_, c in regions.comments(text, "ts")] == ["// é one", "/* two\nlines */", "// three"]
    assert [c for *_, c in regions.comments("x = '# no' # yes\n", "py")] == ["# yes"]
    assert [c for *_, c in regions.comments("x // no\n  // yes\n", "txt")] == ["  // yes"]
    text = "# M: one \nx\n# M: two\n"
    assert [(text[b:e], label) for b, e, label in regions.labelled(text, "M:", None, "py")] == [("\nx\n", "one"), ("\n", "two")]


def test_byte_offsets_of_every_place():
    from factweave.operators.extract import byte_offsets

    for text in ("plain", "é日🙂a", "", "a\ud800b"):
        at = byte_offsets(text)
        assert [at(i) for i in range(len(text) + 2)] == [len(text[:i].encode("utf-8", "surrogatepass")) for i in range(len(text) + 2)]


def test_facts_table(spark):
    blobs = spark.createDataFrame([("r", "main", [], "a.ts", "import { é } from './b';"), ("r", "main", [], "c.md", "import x from 'y'")], BLOB)
    assert [(r.kind, r.value, r.span_start) for r in facts(blobs).orderBy("span_start").collect()] == [("import_name", "é", 9), ("import_path", "./b", 20)]


def test_nested_markers():
    text = "// BEGIN a\n1\n// BEGIN b\n2\n// END\n3\n// END\n"
    assert [text[b:e].strip() for b, e in regions.markers(text, "BEGIN", "END")] == ["1\n// BEGIN b\n2\n// END\n3", "2"]


RULED = "function a(x) { load(env.KEY); drop(env.OTHER) }\nload(env.lower); let y = 'env';\n"


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ({"pattern": "env.$N"}, ["KEY", "OTHER", "lower"]),
        ({"pattern": "env.$N", "inside": {"pattern": "load($$$_)"}}, ["KEY", "lower"]),
        ({"pattern": "env.$N", "not": {"regex": "[a-z]$"}}, ["KEY", "OTHER"]),
        ({"pattern": "env.$N", "not": {"pattern": "env.OTHER"}}, ["KEY", "lower"]),
        ({"pattern": "env.$N", "regex": "[A-Z]$"}, ["KEY", "OTHER"]),
        ({"any": [{"pattern": "load(env.$N)"}, {"pattern": "drop(env.$N)"}]}, ["KEY", "OTHER", "lower"]),
        ({"all": [{"pattern": "env.$N"}, {"regex": "KEY"}]}, ["KEY"]),
        ({"pattern": "$F(env.$N)", "has": {"kind": "identifier", "regex": "^OTHER$"}}, ["OTHER"]),
        ({"pattern": "$F(env.$N)", "follows": {"pattern": "load($$$_)"}}, ["OTHER"]),
        ({"pattern": "$F(env.$N)", "precedes": {"pattern": "drop($$$_)"}}, ["KEY"]),
    ],
)
def test_rule_objects(rule, want):
    assert [c["N"][0] for c in code.structural(RULED, {"rule": rule}, "js")] == want


def test_rule_objects_bind_and_limit(tmp_path, spark):
    told = {"rule": {"pattern": "env.$N", "inside": {"pattern": "$F(env.$N)"}}, "constraints": {"N": {"regex": "^[A-Z]+$"}}, "language": "js"}
    got = [{n: v for n, (v, *_) in c.items()} for c in code.structural(RULED, told)]
    assert got == [{"N": "KEY", "F": "load"}, {"N": "OTHER", "F": "drop"}]
    assert list(code.structural(RULED, {"rule": {"kind": "string"}}, "js")) == [{}]
    for wrong in ({"kind": "call_expression"}, {"matches": "x"}):
        with pytest.raises(ValueError, match="ast rule"):
            list(code.structural(RULED, {"rule": wrong}, "js"))
    (tmp_path / "ast.yml").write_text(json.dumps({"id": "env", **told}))
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"name": "env", "context": [["file", "*.ts"]], "matcher": ["ast", {"rule_file": "ast.yml"}, None]}]}))
    program = Engine(spark).load(str(tmp_path / "rules.json"))
    assert program.rules[0].columns == ["N", "F"]
    assert language.hashes(program)["env"]
    assert [c["N"][0] for c, _ in evaluate(program.rules[0], RULED, "a.ts", {}, {})] == ["KEY", "OTHER"]


def test_json_rules_equal_the_language():
    rule = {"name": "r", "context": [["file", "**/*.json"]], "matcher": ["json", [["object", [[["exact", "packages"], [["object", [[["pattern", "$N@$V"], [["object", [[["exact", "tag"], [["leaf", "T"]]]]]]]]]]]]]]], "line": None}
    program = language.from_json(json.dumps({"rules": [rule, {"name": "l", "line": "FROM $IMAGE:$TAG"}, {"name": "m", "matcher": ["md", "- $ITEM"]}]}))
    assert [r.columns for r in program.rules] == [["N", "V", "T"], ["IMAGE", "TAG"], ["ITEM"]]
    said = parse('rule(r) { fs(**/*.json) > json({ packages: { "$N@$V": { tag: $T } } }) };').rules[0]
    assert program.rules[0].matcher == said.matcher
    doc = '{"packages": {"express@4": {"tag": "x"}}}'
    assert [{n: v for n, (v, *_) in c.items()} for c, _ in evaluate(program.rules[0], doc, "a.json", {}, {})] == [{"N": "express", "V": "4", "T": "x"}]


def test_capture_filter_and_seeds():
    assert rows("json({ image: $I }) > line($NAME:$TAG)", "a.json", '{"image": "nginx:1"}') == [("nginx:1", "nginx", "1")]
    assert rows('json({ name: "$X", version: $V })', "a.json", '{"name": "a/b", "version": "1"}') == []


def test_a_step_of_one_capture_takes_the_whole_value(spark):
    rows = [("org/port", "main", ["v1"], "a/b/x.y.json", '{"k":1}'), ("org/port", None, ["v1", "v2"], ".env", '{"k":1}'), ("org/port", None, [], "z.json", '{"k":1}'), (None, "main", None, "a/z", '{"k":1}')]
    found = extract(spark.createDataFrame(rows, BLOB), parse("rule(r) { repo($R) { rev($B) { folder($D) { fs($F) > json({ k: $K }) } } } };").rules)
    got = {r.path: {n: v for n, v in r.captures.items() if n != "K"} for r in found.collect()}
    # What is not known binds nothing.
    assert got == {"a/b/x.y.json": {"R": "org/port", "B": "main", "D": "a/b", "F": "x.y"}, ".env": {"R": "org/port", "B": "v1", "D": "", "F": ".env"}, "z.json": {"R": "org/port", "D": "", "F": "z"}, "a/z": {"B": "main", "D": "a", "F": "z"}}


def test_templates_and_sites(spark):
    from pyspark.sql import functions as F

    from factweave.functions.text import expand
    from factweave.operators.sinks import pivoted

    df = spark.createDataFrame([("{b}", "x"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(expand("{a}-{b}{c}", {"a": F.col("a"), "b": F.col("b")})).collect()] == ["{b}-x{c}", "{a}-y{c}"]
    refs = spark.createDataFrame([("p", "img", 1, "img", "one"), ("p", "img", 2, "img", "two"), ("p", "img", 2, "tag", "t"), ("p", "img", None, "tag", "lost")], "path string, rule string, site int, kind string, text string")
    assert sorted((r.site, r.tag, r.value) for r in pivoted(refs, ["tag"]).collect()) == [(1, None, "one"), (2, "t", None)]
