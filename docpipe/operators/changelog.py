"""Changelog from commits: pos (0 is the newest), hash, author, subject, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"feat": "Added", "fix": "Fixed", "refactor": "Changed", "perf": "Changed", "docs": "Documentation", "style": "skip", "test": "skip", "chore": "skip", "ci": "skip", "build": "skip"}
CONVENTIONAL = r"^([\p{L}\p{N}_]+)(?:\(([^)]*)\))?(!)?:\s*(.+)$"
PREFIX = r"^(?:feat|fix|refactor|chore|docs|perf|ci|test)(?:\([^)]*\))?!?:\s*"
NUMBER = r"\s*\(#\d+\)\s*$"
RULES = [
    (r"\bbreaking[\s_-]?change\b", "Breaking Changes"),
    (r"\b(?:security|vulnerabilit|cve-)\b", "Security"),
    (r"^(?:add|implement|introduce|create|support)\b", "Added"),
    (r"^(?:fix|resolve|patch|correct|handle|repair)\b", "Fixed"),
    (r"^(?:remove|delete|drop|deprecate|disable)\b", "Removed"),
]
ORDER = ["Breaking Changes", "Added", "Changed", "Fixed", "Removed", "Security"]
RANGE = r"^[a-zA-Z0-9_.~^/\-]+(\.\.[a-zA-Z0-9_.~^/\-]+)?$"


def conventional(commits: DataFrame) -> DataFrame:
    """pos, type, scope, breaking, description: of subjects that follow the convention."""
    part = lambda k: F.regexp_extract("subject", CONVENTIONAL, k)
    return commits.where(F.col("subject").rlike(CONVENTIONAL)).select(
        "pos", F.lower(part(1)).alias("type"), part(2).alias("scope"), (part(3) == "!").alias("breaking"), part(4).alias("description")
    )


def keyword_category(subject: Column) -> Column:
    """The category of a subject without a known type, by its first words and some anywhere; Changed if none."""
    plain = F.lower(F.trim(F.regexp_replace(subject, r"^[A-Z]+-\d+[:\s]+\s*", "")))
    out = F.when(plain.rlike(RULES[0][0]), RULES[0][1])
    for pattern, category in RULES[1:]:
        out = out.when(plain.rlike(pattern), category)
    return out.otherwise("Changed")


def classified(commits: DataFrame) -> DataFrame:
    """Commits with category and description. A breaking change wins over everything, even over kinds that are left out."""
    known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    kind = known[F.lower(F.regexp_extract("subject", CONVENTIONAL, 1))]
    loud = F.concat_ws("\n", "subject", "body").rlike(r"BREAKING[\s_-]?CHANGE")
    marked = F.regexp_extract("subject", CONVENTIONAL, 3) == "!"
    return commits.withColumn("kind", kind).select(
        *commits.columns,
        F.when(F.col("kind").isNotNull(), F.when(marked | loud, "Breaking Changes").otherwise(F.col("kind"))).when(loud, "Breaking Changes").otherwise(keyword_category(F.col("subject"))).alias("category"),
        F.when(F.col("kind").isNotNull(), F.regexp_extract("subject", CONVENTIONAL, 4)).otherwise(F.col("subject")).alias("description"),
    )


def refs(commits: DataFrame) -> DataFrame:
    """pos, prs, issues: numbers of pull requests and of issues that are closed, as sorted arrays."""
    text = F.concat_ws("\n", "subject", "body")
    prs = F.regexp_extract_all(text, F.lit(r"(?:^|\s|Merge pull request )#(\d+)"), F.lit(1))
    issues = F.regexp_extract_all(text, F.lit(r"(?i)(?:fix(?:es)?|close[sd]?|resolve[sd]?)\s+#(\d+)"), F.lit(1))
    return commits.select("pos", F.array_sort(F.array_distinct(prs)).alias("prs"), F.array_sort(F.array_distinct(issues)).alias("issues"))


def entries(commits: DataFrame) -> DataFrame:
    """One entry for each category and description, as the newest commit has it, with the numbers of all: category, pos, hash, text, prs, issues."""
    both = classified(commits).join(refs(commits), "pos").where("category not in ('skip', 'Documentation')")
    plain = F.trim(F.lower(F.regexp_replace("description", NUMBER, "")))
    both = both.withColumn("norm", F.regexp_replace(plain, PREFIX, ""))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    first = both.groupBy("category", "norm").agg(F.min_by(F.struct("pos", "hash", "description"), "pos").alias("f"), union("prs"), union("issues"))
    text = F.regexp_replace(F.regexp_replace("f.description", PREFIX, ""), NUMBER, "")
    out = first.withColumn("t", text).withColumn("t", F.concat(F.upper(F.substring("t", 1, 1)), F.expr("substr(t, 2)")))
    numbers = F.concat(F.lit(" ("), F.array_join(F.transform("prs", lambda x: F.concat(F.lit("#"), x)), ", "), F.lit(")"))
    return out.select("category", "f.pos", "f.hash", F.concat("t", F.when(F.size("prs") > 0, numbers).otherwise("")).alias("text"), F.array_join("prs", ",").alias("prs"), F.array_join("issues", ",").alias("issues"))


def summary(commits: DataFrame) -> DataFrame:
    """analysed, skipped, entries."""
    out = classified(commits).agg(F.count("*").alias("analysed"), F.count_if(F.col("category").isin("skip", "Documentation")).alias("skipped"))
    return out.crossJoin(entries(commits).agg(F.count("*").alias("entries")))


def markdown(commits: DataFrame) -> DataFrame:
    """rank, category, body: the sections of a changelog in their order."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category")).cast("int")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return entries(commits).groupBy(rank.alias("rank"), "category").agg(body.alias("body"))


HEADER = """# Changelog

All notable changes to this project will be documented in this file.

The format is based on [Keep a Changelog](https://keepachangelog.com/en/1.1.0/),
and this project adheres to [Semantic Versioning](https://semver.org/spec/v2.0.0.html).
"""


def release(commits: DataFrame, date: str) -> DataFrame:
    """entry: the whole entry of a release that isn't out, in one row; without changes its heading alone."""
    parts = markdown(commits).select("rank", F.concat(F.lit("### "), "category", F.lit("\n\n"), "body").alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")
    return parts.agg(F.rtrim(F.concat(F.lit(f"## [Unreleased] - {date}\n\n"), body), F.lit("\n")).alias("entry"))


def inserted(existing: Column, entry: Column) -> Column:
    """A changelog with an entry before its first one, at its end if it has none; of null a new changelog."""
    at = F.locate("\n## [", F.concat(F.lit("\n"), existing))
    before, after = F.substring(existing, F.lit(1), at - 1), F.substring(existing, at, F.length(existing))
    return (
        F.when(existing.isNull(), F.concat(F.lit(HEADER + "\n"), entry, F.lit("\n")))
        .when(at > 0, F.concat(before, entry, F.lit("\n\n"), after))
        .otherwise(F.concat(F.rtrim(existing, F.lit("\n")), F.lit("\n\n"), entry, F.lit("\n")))
    )
