"""Git repositories as a Spark data source: `spark.read.format("git").option("path", ...).option("rev", ...)`.

The driver lists the tree; executors read objects in batches, so the repository must lie where they can reach it.
Option `what` is blobs (repo, rev, path, oid, content) or revs (repo, rev, oid, is_tag).
"""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOBS = "repo string, rev string, path string, oid string, content binary"
REVS = "repo string, rev string, oid string, is_tag boolean"
PER_PARTITION = 500


def git(path: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def list_revs(path: str) -> list[tuple[str, str, bool]]:
    """(name, commit, is_tag) of branches and tags; annotated tags are peeled."""
    out = git(path, "for-each-ref", "--format=%(refname)%09%(objectname)%09%(*objectname)", "refs/heads", "refs/tags").decode()
    rows = []
    for line in out.splitlines():
        ref, oid, peeled = line.split("\t")
        rows.append((ref.split("/", 2)[2], peeled or oid, ref.startswith("refs/tags/")))
    return rows


def list_tree(path: str, rev: str) -> list[tuple[str, str]]:
    """(path, oid) of all blobs at a revision."""
    out = git(path, "ls-tree", "-r", "-z", rev)
    rows = []
    for entry in filter(None, out.split(b"\0")):
        head, _, name = entry.partition(b"\t")
        _, kind, oid = head.split()[:3]
        if kind == b"blob":
            rows.append((name.decode("utf-8", "replace"), oid.decode()))
    return rows


def contents(path: str, oids: list[str]):
    """Each object's bytes, in order."""
    out, at = git(path, "cat-file", "--batch", stdin="".join(f"{o}\n" for o in oids).encode()), 0
    for _ in oids:
        end = out.index(b"\n", at)
        size = int(out[at:end].split()[2])
        yield out[end + 1 : end + 1 + size]
        at = end + 2 + size


@dataclass
class Objects(InputPartition):
    rows: list


class GitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rev = options["path"], options.get("rev", "HEAD")
        self.repo = options.get("repo") or os.path.basename(os.path.normpath(self.path))
        self.what = options.get("what", "blobs")

    def partitions(self):
        rows = list_revs(self.path) if self.what == "revs" else list_tree(self.path, self.rev)
        return [Objects(rows[i : i + PER_PARTITION]) for i in range(0, len(rows), PER_PARTITION)] or [Objects([])]

    def read(self, partition):
        if self.what == "revs":
            yield from ((self.repo, name, oid, tag) for name, oid, tag in partition.rows)
            return
        for (name, oid), content in zip(partition.rows, contents(self.path, [o for _, o in partition.rows]), strict=True):
            yield self.repo, self.rev, name, oid, content


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "git"

    def schema(self):
        return REVS if self.options.get("what") == "revs" else BLOBS

    def reader(self, schema):
        return GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
