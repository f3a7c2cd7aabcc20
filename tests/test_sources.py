"""File, git and stream sources."""

import json
import subprocess

import pytest

from factweave.engine import Engine
from factweave.plans.language import parse
from factweave.sources import files, git
from factweave.streaming import watch


def run(folder, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *args], cwd=folder, check=True, capture_output=True)


@pytest.fixture()
def repo(tmp_path):
    run(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_text('{"name": "v1"}')
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "one")
    run(tmp_path, "tag", "-a", "v1.0.0", "-m", "tag")
    (tmp_path / "src" / "a.json").write_text('{"name": "v2"}')
    run(tmp_path, "commit", "-qam", "two")
    return tmp_path


def test_git_source_reads_any_revision(spark, repo):
    git.register(spark)
    read = lambda **o: spark.read.format("git").options(path=str(repo), repo="r", **o).load()
    assert {r.path: bytes(r.content) for r in read(rev="v1.0.0").collect()}["src/a.json"] == b'{"name": "v1"}'
    assert {r.path: bytes(r.content) for r in read().collect()} == {"src/a.json": b'{"name": "v2"}', "bin.dat": b"\xff\xfe"}
    revs = {r.rev: (r.oid, r.is_tag) for r in read(what="revs").collect()}
    assert set(revs) == {"main", "v1.0.0"} and revs["v1.0.0"][1] and revs["v1.0.0"][0] != revs["main"][0]
    with pytest.raises(Exception, match="git"):
        read(rev="nope").collect()


def test_directory_blobs(spark, repo):
    got = {r.path: r for r in files.blobs(spark, str(repo), "r", "main").collect()}
    assert set(got) == {"src/a.json", "bin.dat"} and got["bin.dat"].text is None and got["src/a.json"].ext == "json"
    oid = subprocess.run(["git", "hash-object", "src/a.json"], cwd=repo, capture_output=True, text=True).stdout.strip()
    assert got["src/a.json"].content_hash == oid
    assert files.blobs(spark, str(repo), "r", "main", ["**/*.json"]).count() == 1


def test_layout_and_literals(spark):
    paths = spark.createDataFrame([("org/main/app/x",), ("org/main/app/y/z",), ("org/.git/app/x",), ("org/main",)], "path string")
    assert [tuple(r) for r in files.discover(paths).collect()] == [("org", "main", "app")]
    revs = spark.createDataFrame([("main",), ("v1.0.0",), ("v2.0.0",)], "rev string")
    assert {(r.rev, r.is_semver) for r in files.select_revs(revs, ["main", "v*"], ["v1.*"]).collect()} == {("main", False), ("v2.0.0", True)}
    assert Engine(spark).eval("json({ a: $A })", files.literal_source(spark, '{"a": 1}')).first().captures == {"A": "1"}


def test_save_skips_and_rebuilds(spark, tmp_path):
    blobs = spark.createDataFrame([("a", "main", [], "x.json", '{"name":"n"}')], "repo string, rev string, tags array<string>, path string, text string")
    engine, out, manifest = Engine(spark), str(tmp_path / "t"), str(tmp_path / "m.json")
    one, two = "rule(p) { fs(**) > json({ name: $N }) };", "rule(p) { fs(**) > json({ name: $N, x: $_ }) };"
    assert engine.save(blobs, parse(one), out, manifest) == {"p": "create"}
    assert engine.save(blobs, parse(one), out, manifest) == {"p": "keep"}
    assert spark.read.parquet(f"{out}/p").count() == 1
    assert engine.save(blobs, parse(two), out, manifest) == {"p": "empty"}
    assert spark.read.schema("n string").parquet(f"{out}/p").count() == 0


def test_save_deletes_what_a_rescan_no_longer_finds(spark, tmp_path):
    schema = "repo string, rev string, tags array<string>, path string, text string"
    row = lambda repo, text: (repo, "main", [], "x.json", text)
    engine, out, manifest = Engine(spark), str(tmp_path / "t"), "file://" + str(tmp_path / "m.json")
    rules = "rule(p) { fs(**) > json({ name: $N }) }; rule(q) { fs(**) > json({ other: $O }) };"
    engine.save(spark.createDataFrame([row("a/b", '{"name":"1","other":"2"}'), row("c", '{"name":"3"}'), row("d", '{"name":"4"}')], schema), parse(rules), out, manifest)
    engine.save(spark.createDataFrame([row("a/b", "{}"), row("c", '{"name":"5"}')], schema), parse(rules), out, manifest)
    got = lambda name: sorted((r.repo, r.n) for r in spark.read.schema("n string, node_path string, path string, repo string, rev string").parquet(f"{out}/{name}").collect())
    assert got("p") == [("c", "5"), ("d", "4")]
    assert engine.save(spark.createDataFrame([row("c", '{"name":"5"}')], schema), parse(rules.split(";")[0] + ";"), out, manifest)["q"] == "drop"
    assert not (tmp_path / "t" / "q").exists()


def test_classify(spark):
    index = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], "repo string, path string, content_hash string")
    events = spark.createDataFrame(
        [("2024-01-01 00:00:00", "r", "removed", "a", None), ("2024-01-01 00:00:01", "r", "created", "moved/a", "1"), ("2024-01-01 00:00:02", "r", "removed", "b", None), ("2024-01-01 00:00:03", "r", "created", "b", "9"), ("2024-01-01 00:00:04", "r", "removed", "c", None), ("2024-01-01 00:00:05", "r", "created", "new", "5"), ("2024-01-01 00:00:06", "r", "created", "target/x", "6")],
        "event_ts string, repo string, op string, path string, content_hash string",
    ).selectExpr("CAST(event_ts AS timestamp) AS event_ts", "repo", "op", "path", "content_hash")
    changes = watch.classify(events, index)
    got = {(r.change_type, r.old_path, r.new_path) for r in changes.collect()}
    assert got == {("move", "a", "moved/a"), ("content_change", None, "b"), ("delete", "c", None), ("create", None, "new")}
    assert {(r.path, r.content_hash) for r in watch.apply_changes(index, changes).collect()} == {("moved/a", "1"), ("b", "9"), ("new", "5")}


def test_watch_stream(spark, tmp_path):
    index, out, inbox = (str(tmp_path / x) for x in ("index", "out", "in"))
    spark.createDataFrame([("r", "a", "1")], "repo string, path string, content_hash string").write.parquet(f"{index}/v=-1")
    (tmp_path / "in").mkdir()
    for k, (op, path, h) in enumerate([("removed", "a", None), ("created", "b", "1"), ("modified", "b", "2")]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"event_ts": f"2024-01-01T00:00:0{k}Z", "repo": "r", "op": op, "path": path, "content_hash": h}) + "\n")
        watch.watch(watch.read_events(spark, inbox), index, out, str(tmp_path / "ck")).awaitTermination()
    got = [(r.batch, r.change_type, r.new_path) for r in spark.read.parquet(out).orderBy("batch", "change_type").collect()]
    assert got == [(0, "delete", None), (1, "create", "b"), (2, "content_change", "b")]
    bursts = watch.sessions(spark.read.schema(watch.EVENTS).json(inbox), "2 seconds").collect()
    assert [r.n for r in bursts] == [3]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from factweave import shared

    for master, good in (("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://x:7077", False), ("yarn", False)):
        context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
        if good:
            assert shared.shared_dir(session).startswith("file:///")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared.shared_dir(session)


def test_checkouts_are_scanned_once(spark, tmp_path):
    events, noted = str(tmp_path / "events"), str(tmp_path / "noted")
    seen = []

    def add(*rows):
        spark.createDataFrame(rows, watch.CHECKOUTS).coalesce(1).write.mode("append").parquet(events)

    def run(paused=lambda: False):
        stream = watch.read_checkouts(spark, events)
        watch.subscribe(stream, noted, lambda due: seen.append(sorted((r.repo, r.rev, r.sha) for r in due.collect())), str(tmp_path / "check"), [("org/*", "main")], paused).awaitTermination()

    spark.createDataFrame([("org/c", "main", "s9")], "repo string, rev string, sha string").write.parquet(noted + "/batch=-1")
    add((1, "org/a", "main", "s1", "/a"), (2, "org/a", "main", "s2", "/a"), (3, "org/b", "dev", "s1", "/b"), (4, "org/c", "main", "s9", "/c"), (5, "org/d", "main", None, "/d"))
    run()
    add((6, "org/a", "main", "s2", "/a"), (7, "org/c", "main", "s10", "/c"))
    run()
    add((8, "org/a", "main", "s3", "/a"))
    run(paused=lambda: True)
    assert seen == [[("org/a", "main", "s2"), ("org/d", "main", None)], [("org/c", "main", "s10")]]
