import io

from factweave.__main__ import main


def test_verbs(spark, tmp_path):
    root, rules = tmp_path / "root", tmp_path / "rules.txt"
    root.mkdir()
    (root / "a.json").write_text('{"name": "Alpha", "v": 1}')
    rules.write_text("rule(pkg) { fs(**/*.json) > json({ name: $NAME, v: $V }) };\ncheck(none) { SELECT name FROM pkg WHERE v = '2' };\ncheck(some) { SELECT name FROM pkg };")

    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue()

    assert run("eval", "json({ name: $N })", str(root)) == (0, "a.json\tN\teval\tAlpha\n")
    assert run("sql", str(rules), str(root), "SELECT name, v FROM pkg") == (0, "name\tv\nAlpha\t1\n(1 rows)\n")
    assert run("sql", str(rules), str(root), "DROP TABLE pkg")[0] == 2
    assert run("check", str(rules), str(root), "none")[0] == 0
    assert run("check", str(rules), str(root))[0] == 1
    assert "Alpha" in run("query", str(rules), str(root), "pkg", "alph")[1]


def test_tables_on_disk(spark, tmp_path):
    root, rules, kept = tmp_path / "root", tmp_path / "rules.weave", tmp_path / "kept"
    root.mkdir()
    kept.mkdir()
    (root / "a.json").write_text('{"name": "Alpha"}')
    (kept / "other.txt").write_text("stays")
    rules.write_text("rule(pkg) { fs(**/*.json) > json({ name: $NAME }) };\nrule(none) { fs(**/*.toml) > json({ name: $NAME }) };")

    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue()

    assert run("status", str(kept)) == (0, "rule\trepo\trev\trows\n(0 rows)\n")
    assert run("scan", str(tmp_path), str(root), str(kept))[0] == 0
    assert run("status", str(kept)) == (0, "rule\trepo\trev\trows\npkg\trepo\tmain\t1\n(1 rows)\n")
    assert run("reset", str(kept)) == (0, "none\npkg\n")
    assert [p.name for p in kept.iterdir() if not p.name.startswith(".")] == ["other.txt"]
    assert run("status", str(kept))[1].endswith("(0 rows)\n")
