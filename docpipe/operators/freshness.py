"""Freshness of documents: symbols that a diff changed, and the pages that mention them. Diffs: path, line, d."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BACKTICKS, fenced, found, holding

WORD = r"([\p{L}\p{N}_]+)"
FUNCTIONS = {
    r"\.(?:ts|tsx|js|jsx)$": r"^[-+]\s*(?:export\s+)?(?:async\s+)?function\s+" + WORD,
    r"\.py$": r"^[-+]\s*(?:async\s+)?def\s+" + WORD,
    r"\.go$": r"^[-+]\s*func\s+(?:\([^)]+\)\s+)?" + WORD,
}
DECLARED = [
    r"^[-+]\s*export\s+(?:const|let|var)\s+" + WORD,
    r"^[-+]\s*(?:export\s+)?class\s+" + WORD,
    r"^[-+]\s*(?:export\s+)?(?:interface|type)\s+" + WORD,
]
ENDPOINT = r"""(?:app|router)\.\s*(?:get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
ENVIRONMENT = r"""(?:process\.env\.|os\.environ\.get\(|os\.getenv\()['"]?""" + WORD
SETTING = r"""(?:config|settings|options)\s*[\[.]?\s*['"]""" + WORD
LEAST = 6


def changed(diff: DataFrame) -> DataFrame:
    """The added and removed lines: path, line, d, sign. A removed line that begins with -- looks like a header and is dropped."""
    head = F.col("d").rlike(r"^(?:diff |index |--- |\+\+\+ |@@)")
    return diff.where(~head & (F.trim("d") != "") & F.col("d").rlike("^[-+]")).select("path", "line", "d", F.substring("d", 1, 1).alias("sign"))


def defined(diff: DataFrame) -> DataFrame:
    """path, line, sign, symbol: functions by the file's language, and exported names, classes and types in any."""
    own = changed(diff)
    function = F.lit("")
    for extension, pattern in FUNCTIONS.items():
        function = F.when(F.col("path").rlike(extension), F.regexp_extract("d", pattern, 1)).otherwise(function)
    names = F.array(function, *(F.regexp_extract("d", p, 1) for p in DECLARED))
    return own.select("path", "line", "sign", F.explode(names).alias("symbol")).where(F.length("symbol") >= LEAST)


def algebra(diff: DataFrame) -> DataFrame:
    """path, symbol, change: added, removed, or modified where a file has both; one shuffle."""
    sides = defined(diff).groupBy("path", "symbol").agg(F.max(F.col("sign") == "+").alias("a"), F.max(F.col("sign") == "-").alias("r"))
    return sides.select("path", "symbol", F.when(F.col("a") & F.col("r"), "modified").when(F.col("a"), "added").otherwise("removed").alias("change"))


def endpoints(diff: DataFrame) -> DataFrame:
    """path, endpoint, sign: routes on changed lines."""
    return changed(diff).select("path", F.explode(found(F.col("d"), ENDPOINT)).alias("endpoint"), "sign").distinct()


def environment(diff: DataFrame) -> DataFrame:
    """path, name: environment variables on changed lines of either sign."""
    return changed(diff).select("path", F.explode(found(F.col("d"), ENVIRONMENT)).alias("name")).distinct()


def settings(diff: DataFrame) -> DataFrame:
    """path, name: quoted keys of config, settings and options."""
    return changed(diff).select("path", F.explode(found(F.col("d"), SETTING)).alias("name")).where(F.length("name") >= LEAST).distinct()


def tracked(diff: DataFrame) -> DataFrame:
    """symbol, type, severity, source: what is looked for; where kinds collide, a variable wins over an endpoint, that over modified, that over removed."""
    own = algebra(diff).where("change <> 'added'").select("symbol", "path", F.col("change").alias("type"))
    own = own.unionByName(endpoints(diff).where("sign = '-'").select(F.col("endpoint").alias("symbol"), "path", F.lit("removed_endpoint").alias("type")))
    own = own.unionByName(environment(diff).select(F.col("name").alias("symbol"), "path", F.lit("env_var").alias("type"))).where(F.length("symbol") >= LEAST)
    rank = F.array_position(F.array(*map(F.lit, ("removed", "modified", "removed_endpoint", "env_var"))), F.col("type"))
    each = own.groupBy("symbol", "type").agg(F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("source")).withColumn("rank", rank)
    best = each.groupBy("symbol").agg(F.max_by(F.struct("type", "source"), "rank").alias("x"))
    return best.select("symbol", "x.type", F.when(F.col("x.type").startswith("removed"), "high").otherwise("medium").alias("severity"), "x.source")


def quoted(symbol: Column) -> Column:
    """A symbol as a pattern."""
    return F.concat(F.lit("\\Q"), symbol, F.lit("\\E"))


def mentions(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, line, symbol, severity, context: where pages mention symbols; in code as words, in prose as code, else as mere words.

    Symbols have at least LEAST characters, so the lines that hold one are found by the ends of symbols, of that length; only
    these meet a pattern.
    """
    text = fenced(docs, BACKTICKS).where(F.trim("text") != "")
    pairs = holding(text, "text", symbols.select("symbol", "severity"), "symbol", LEAST)
    s = quoted(F.col("symbol"))
    whole = F.rlike("text", F.concat(F.lit(r"\b"), s, F.lit(r"\b")))
    code = F.rlike("text", F.concat(F.lit("`[^`]*"), s, F.lit("[^`]*`|"), s, F.lit(r"\s*[(=]")))
    context = F.when(F.col("inside"), F.when(whole, "code_block")).when(code, "inline_code").when(whole, "prose")
    return pairs.select("path", "line", "symbol", "severity", context.alias("context")).where("context is not null")


def stale(docs: DataFrame, diff: DataFrame) -> DataFrame:
    """path, status, score, findings: all pages; mentions in prose don't count."""
    hits = mentions(docs, tracked(diff)).where("context <> 'prose'")
    score = hits.groupBy("path").agg(F.sum(F.when(F.col("severity") == "high", 3).otherwise(1)).alias("score"), F.count("*").alias("findings"))
    status = F.when(F.col("score") >= 3, "stale").when(F.col("score") > 0, "likely_stale").otherwise("fresh")
    return docs.select("path").join(score.hint("merge"), "path", "left").select("path", status.alias("status"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("findings", F.lit(0)).alias("findings"))


def findings(docs: DataFrame, diff: DataFrame, most: int = 10) -> DataFrame:
    """The first findings of each page, by line and symbol: path, n, line, symbol, context."""
    hits = mentions(docs, tracked(diff)).where("context <> 'prose'")
    n = F.row_number().over(Window.partitionBy("path").orderBy("line", "symbol"))
    return hits.select("path", n.alias("n"), "line", "symbol", "context").where(F.col("n") <= most)


def summary(docs: DataFrame, diff: DataFrame) -> DataFrame:
    """Pages by status, and symbols tracked."""
    out = stale(docs, diff).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("stale", "likely_stale", "fresh")))
    return out.crossJoin(tracked(diff).agg(F.count("*").alias("symbols_tracked")))
