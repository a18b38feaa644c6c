"""A reviewer's results: findings as JSON lines, or a patch; and what is given to one."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINDING = "category string, file string, line int, rule_id string, description string, suggestion string"


def findings(lines: DataFrame) -> DataFrame:
    """The findings in lines of JSON; what can't be read has null fields."""
    return lines.select(F.from_json("line", FINDING).alias("x")).select("x.*")


def by(lines: DataFrame, key: str) -> DataFrame:
    """Findings by category or file, with how many rules they name."""
    return findings(lines).groupBy(key).agg(F.count("*").alias("findings"), F.countDistinct("rule_id").alias("rules"))


def patch(lines: DataFrame) -> DataFrame:
    """file, hunks, added, removed: of a patch (pos, line), the file's name being carried down from its header."""
    name = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1))
    file = F.last(name, True).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    own = lines.withColumn("file", file).where("file is not null")
    return own.groupBy("file").agg(
        F.count_if(F.col("line").startswith("@@")).alias("hunks"), F.count_if(F.col("line").rlike(r"^\+(?!\+\+ )")).alias("added"), F.count_if(F.col("line").rlike("^-(?!-- )")).alias("removed")
    )


def content_directory(args: list[str], config: str | None = None) -> str:
    """The folder to review: the first argument if it is one, else what a JSON configuration names as contentDirectory (of a list the first), else the current one."""
    if args and os.path.isdir(args[0]):
        return args[0]
    if config and os.path.isfile(config):
        try:
            with open(config, encoding="utf-8") as f:
                named = json.load(f).get("contentDirectory")
        except (ValueError, OSError):
            named = None
        if isinstance(named, list) and named:
            return named[0]
        if isinstance(named, str):
            return named
    return "."


def mode(args: list[str], changed: bool, config: str | None = None) -> tuple[str, str, str]:
    """How to review (files, git_changes, full), the format of the results (jsonl, patch), and the folder. changed: whether the folder has uncommitted changes."""
    if args and all(os.path.isfile(a) for a in args):
        top = os.path.commonpath([os.path.abspath(a) for a in args])
        return "files", "jsonl", os.path.dirname(top) if os.path.isfile(top) else top
    folder = content_directory(args, config)
    return ("git_changes", "patch", folder) if changed else ("full", "jsonl", folder)
