"""Columns for Markdown: lines, code fences, slugs, paths. All of them are built-in expressions inside one row, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = r"(?dm)^[ \t]*(?:```|~~~)[^\n]*"
BACKTICKS = r"(?dm)^[ \t]*```[^\n]*"
#: Rows that are read by the driver and sent to every task at most. Characters of a piece of a text in which terms are looked for.
MOST, CUT = 100_000, 64


def normalised(content: Column) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(content, "\r\n?", "\n")


def lines(docs: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return docs.select("path", F.posexplode(F.split("content", "\n", -1)).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def fenced(docs: DataFrame, marker: str = FENCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, line, text, inside: lines with whether they are in a code fence, and columns to keep; the marker lines are left out.

    A document is split at its markers, so that every other part is code, and put together again with a letter before each line:
    o outside, i inside, m for a marker. So the running state needs neither window nor shuffle, and each line is made once.
    """
    parts = F.split("content", marker, -1)
    tag = lambda i: F.when(i % 2 == 1, "i").otherwise("o")
    put = lambda x, i: F.concat(F.when(i == 0, "o").otherwise(""), F.replace(x, F.lit("\n"), F.concat(F.lit("\n"), tag(i))))
    # A part before a marker ends with the line that the marker is in.
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, i: F.concat(F.regexp_replace(put(x, i), r"[oi]\z", ""), F.lit("m")))
    last = F.transform(F.slice(parts, F.lit(-1), F.lit(1)), lambda x: put(x, F.size(parts) - 1))
    rows = docs.select("path", *keep, F.posexplode(F.split(F.array_join(F.concat(before, last), ""), "\n", -1)).alias("p", "x"))
    return rows.where(~F.col("x").startswith("m")).select("path", (F.col("p") + 1).alias("line"), F.expr("substr(x, 2)").alias("text"), F.col("x").startswith("i").alias("inside"), *keep)


def slug(title: Column) -> Column:
    """The anchor of a heading: without links, emoji and punctuation, lower case, words joined by single dashes."""
    x = F.regexp_replace(title, r"\[([^\]]+)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"[\x{10000}-\x{10ffff}\x{2000}-\x{3300}\x{fe0f}\x{200d}]", "")
    x = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s-]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def normal_path(path: Column) -> Column:
    """A path without . and with .. taken back as far as there is something to take back."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin(".", ""))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), F.array_join(kept, "/")).otherwise(path)  # most have no such part


def folder(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sent(df: DataFrame, most: int = MOST) -> DataFrame | None:
    """df, read once and to be broadcast, if it has at most so many rows; else None."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else None


def joined(df: DataFrame, most: int = MOST) -> DataFrame:
    """df as a side of a join: broadcast if it has few rows, else with a shuffle, whatever its size is estimated to be."""
    few = sent(df, most)
    return df.hint("merge") if few is None else few


def holding(texts: DataFrame, text: str, terms: DataFrame, term: str, n: int = 6, most: int = MOST) -> DataFrame:
    """texts joined with the distinct terms, of n characters at least, that a text holds.

    Every place of a text is looked up among the last n characters of terms, by their hashes; where these are, the term is
    compared, and of equal ones the first counts. The terms are broadcast, and if they are many, in parts of about `most`: so
    places of texts are never shuffled. A text is cut first, since the k-th character of a long one takes k steps to find.
    """
    few = sent(terms, most)
    if few is None:
        parts = -(-terms.count() // most)
        groups = [F.broadcast(terms.where(F.pmod(F.xxhash64(term), F.lit(parts)) == k)) for k in range(parts)]
    else:
        groups = [few]
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n},{CUT + n - 1}}})).{{1,{CUT}}}"), F.lit(1))
    places = texts.select("*", F.posexplode(pieces).alias("__k", "__piece")).select("*", F.explode(F.sequence(F.lit(1), F.length("__piece") - n + 1)).alias("__i"))
    places = places.withColumn("__tail", F.xxhash64(F.substring("__piece", F.col("__i"), F.lit(n)))).withColumn("__at", F.col("__k") * CUT + F.col("__i")).drop("__k", "__piece", "__i")
    first = F.instr(F.col(text), F.col(term)) == F.col("__at") - F.length(term) + n
    out = [places.join(g.withColumn("__tail", F.xxhash64(F.right(term, F.lit(n)))), "__tail").where(first).drop("__tail", "__at") for g in groups]
    return reduce(DataFrame.union, out)
