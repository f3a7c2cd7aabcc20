"""Command line: eval, sql, check and query over directories of files.

    python -m factweave eval 'json({ name: $N })' ROOT
    python -m factweave sql RULES ROOT 'SELECT ...'
    python -m factweave check RULES ROOT [NAME]
    python -m factweave query RULES ROOT RULE TERM
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.sinks import search
from .plans.sqlgate import Refused
from .sources.files import blobs


def print_tsv(df: DataFrame, out=sys.stdout) -> int:
    """Header, a line per row with tabs, and the count; rows come one partition at a time."""
    print("\t".join(df.columns), file=out)
    n = 0
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row), file=out)
        n += 1
    print(f"({n} rows)", file=out)
    return n


def print_eval(df: DataFrame, out=sys.stdout) -> None:
    """path, rule, capture and value of each capture."""
    flat = df.select("path", "rule", F.explode("captures").alias("kind", "value"))
    for row in flat.toLocalIterator():
        print(f"{row.path}\t{row.kind}\t{row.rule}\t{row.value}", file=out)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="factweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in {"eval": ["rule", "root"], "sql": ["rules", "root", "statement"], "check": ["rules", "root"], "query": ["rules", "root", "rule", "term"], "scan": ["rules", "root", "tables"], "status": ["tables"], "reset": ["tables"]}.items():
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name)
        if verb == "check":
            sub.add_argument("name", nargs="?")
        sub.add_argument("--repo", default="repo")
        sub.add_argument("--rev", default="main")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("factweave").getOrCreate()
    engine = Engine(spark)
    if given.verb in ("status", "reset"):
        if given.verb == "status":
            print_tsv(engine.status(given.tables, f"{given.tables}/manifest.json").orderBy("rule", "repo", "rev"), out)
        else:
            for name in engine.reset(given.tables, f"{given.tables}/manifest.json"):
                print(name, file=out)
        return 0
    files = blobs(spark, given.root, given.repo, given.rev)
    if given.verb == "eval":
        print_eval(engine.eval(given.rule, files), out)
        return 0
    program = engine.load(given.rules)
    if given.verb == "scan":
        for name, action in sorted(engine.save(files, program, given.tables, f"{given.tables}/manifest.json").items()):
            print(f"{name}\t{action}", file=out)
        return 0
    found = engine.scan(files, program)
    if given.verb == "sql":
        try:
            print_tsv(engine.sql(given.statement), out)
        except Refused as e:
            print(e, file=sys.stderr)
            return 2
    elif given.verb == "query":
        df = found[given.rule]
        for c in [c.lower() for c in program.columns(given.rule)]:
            print_tsv(search(df, c, given.term, ["repo", "path", c]), out)
    else:
        good, violations = engine.check(program, given.name)
        for df in violations.values():
            print_tsv(df.select("check_name", "violation_data"), out)
        return 0 if good else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
