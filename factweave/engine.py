"""The engine: compile rules, extract, join, check and search, keep tables on disk and scan to a fixed point."""

from __future__ import annotations

import glob
import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, sinks
from .operators.extract import extract, facts, tables, views
from .plans import language, sqlgate
from .plans.language import Program
from .shared import read_small, remove, write_small


#: Names the rules where none are given.
RULES_VARIABLE = "FACTWEAVE_RULES"
ENDING = ".weave"


def rule_files(given: str | None = None) -> list[str]:
    """Files with rules, in the order of their names: of a folder, a glob or a single file.

    Where nothing is given: what $FACTWEAVE_RULES names, else rule files of the working folder, else its rules.json or
    rules.yaml. None at all is an error.
    """
    given = given or os.environ.get(RULES_VARIABLE)
    if given and os.path.isdir(given):
        found = sorted(glob.glob(os.path.join(glob.escape(given), "*" + ENDING)))
    elif given:
        found = [given] if os.path.exists(given) else sorted(glob.glob(given, recursive=True))
    else:
        found = sorted(glob.glob("*" + ENDING)) or [p for p in ("rules.json", "rules.yaml") if os.path.exists(p)][:1]
    if not found:
        raise FileNotFoundError(f"no rules in {given or 'the working folder'}")
    return found


def _read(path: str, text: str):
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _with_files(rules: dict, folder: str) -> dict:
    """Rules with the rule objects of `{"rule_file": path}`, paths being relative to the folder."""
    for rule in rules["rules"]:
        of = (rule.get("matcher") or [None, None])[1]
        if isinstance(of, dict) and "rule_file" in of:
            path = os.path.join(folder, of["rule_file"])
            with open(path) as f:
                told = _read(path, f.read())
            rule["matcher"][1] = {k: told[k] for k in ("rule", "constraints", "language") if k in told}
    return rules


class Engine:
    def __init__(self, spark: SparkSession, namespace: str = ""):
        self.spark, self.namespace = spark, namespace

    def load(self, *paths: str) -> Program:
        """Rules of files, folders and globs: JSON or YAML by ending, else the rule language. Equal names add up."""
        rules, checks = [], {}
        for path in (file for given in paths or [None] for file in rule_files(given)):
            with open(path) as f:
                text = f.read()
            if path.endswith((".yaml", ".yml", ".json")):
                program = language.from_json(json.dumps(_with_files(_read(path, text), os.path.dirname(path))))
            else:
                program = language.parse(text)
            rules += program.rules
            checks |= program.checks
        return Program(rules, checks)

    def scan(self, blobs: DataFrame, program: Program) -> dict[str, DataFrame]:
        """Views of all rules over the blobs, and of the built-in facts of source code."""
        found = views(blobs, program, self.namespace)
        code = facts(blobs)
        code.createOrReplaceTempView("facts")
        return found | {"facts": code}

    def eval(self, rule: str, blobs: DataFrame) -> DataFrame:
        """Rows of a bare rule body: path, rule, captures."""
        text = rule if rule.lstrip().startswith("rule(") else f"rule(eval) {{ {rule} }};"
        return extract(blobs, language.parse(text).rules)

    def sql(self, text: str) -> DataFrame:
        return sqlgate.sql(self.spark, text)

    def check(self, program: Program, name: str | None = None) -> tuple[bool, dict[str, DataFrame]]:
        chosen = program.checks if name is None else {name: program.checks[name]}
        return sqlgate.run_checks(self.spark, chosen)

    def save(self, blobs: DataFrame, program: Program, path: str, manifest_path: str) -> dict[str, str]:
        """Write each rule's rows by (repo, rev); rules whose hashes have not changed keep theirs for unseen partitions.

        Scanned partitions that have no rows any more are deleted, and so are the tables of rules that are gone.
        """
        told = read_small(self.spark, manifest_path)
        before = {k: tuple(v) for k, v in json.loads(told).items()} if told else {}
        after = language.hashes(program)
        actions = sinks.migration(before, after)
        scanned = blobs.select("repo", "rev").distinct()
        for name, df in tables(blobs, program).items():
            if actions[name] in ("rebuild", "empty", "create"):
                df.write.mode("overwrite").partitionBy("repo", "rev").parquet(f"{path}/{name}")
            else:
                sinks.write_rows(df, f"{path}/{name}", scanned)
        for name in (name for name, action in actions.items() if action == "drop"):
            remove(self.spark, f"{path}/{name}")
        write_small(self.spark, manifest_path, sinks.manifest(after))
        return actions

    def status(self, path: str, manifest_path: str) -> DataFrame:
        """rule, repo, rev, rows of the tables that `save` keeps."""
        told = read_small(self.spark, manifest_path)
        shape = "rule string, repo string, rev string, rows bigint"
        out = self.spark.createDataFrame([], shape)
        for name in sorted(json.loads(told)) if told else []:
            try:
                kept = self.spark.read.parquet(f"{path}/{name}")
            except AnalysisException:  # a rule without rows has no files
                continue
            out = out.unionByName(kept.groupBy("repo", "rev").agg(F.count("*").alias("rows")).select(F.lit(name).alias("rule"), F.col("repo").cast("string"), F.col("rev").cast("string"), "rows"))
        return out

    def reset(self, path: str, manifest_path: str) -> list[str]:
        """Delete the tables that the manifest names, then the manifest; returns their names. Other files stay."""
        told = read_small(self.spark, manifest_path)
        names = sorted(json.loads(told)) if told else []
        for name in names:
            remove(self.spark, f"{path}/{name}")
        remove(self.spark, manifest_path)
        return names

    def demand_scan(self, seed: DataFrame, read, program: Program, rule: str, local: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
        """Scan (repo, rev) pairs until a rule's annotated captures name no new one. read: pairs -> blobs."""
        repo, rev = language.scan_columns(program, rule)

        def discover(pairs: DataFrame) -> DataFrame:
            rows = tables(read(pairs), program)[rule]
            return rows.select(F.col(repo.lower()).alias("repo"), F.col(rev.lower()).alias("rev")).where("repo IS NOT NULL AND rev IS NOT NULL")

        return graph.scan_rounds(seed, discover, local, exclude)
