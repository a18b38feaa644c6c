"""Documents, source files, commits and diffs from a file system and git. Git and listings run on the driver; files are read by Spark."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised

PRUNED = ("node_modules", ".git", "dist", "build", ".next", "vendor", "__pycache__")
#: Of the scan for freshness, and of the scan for coverage: tests, fixtures and migrations are no public interface.
PRUNED_FRESHNESS = ("node_modules", ".git", "vendor", "dist", "build", ".next")
PRUNED_COVERAGE = (
    "node_modules", ".git", "vendor", "dist", "build", ".next", "__pycache__", ".pytest_cache", "coverage", ".nyc_output", "test", "tests", "__tests__", "__test__", "spec", "specs",
    "fixtures", "mocks", "__mocks__", "migrations", "seeds",
)
SOURCE = "ts,tsx,js,jsx,mjs,py,go"
SAFE_RANGE = re.compile(r"[a-zA-Z0-9_.~^/\-]+(\.\.[a-zA-Z0-9_.~^/\-]+)?")
FIELD, RECORD = "\x1f", "\x1e"
CHANGED = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".cs", ".swift", ".kt", ".scala", ".c", ".cpp", ".h")


def read(spark: SparkSession, root: str, extensions: str, pruned: tuple[str, ...] = PRUNED, hidden: bool = True) -> DataFrame:
    """path (below root), content, size: whole files, with line ends as \\n, bytes that aren't UTF-8 replaced, pruned folders left out."""
    glob = "*.{" + extensions + "}" if "," in extensions else f"*.{extensions}"
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    top = Path(root).resolve().as_posix().strip("/")
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+\\Q" + top + "\\E/", "")
    out = raw.select(path.alias("path"), normalised(F.col("value")).alias("content"), F.col("_metadata.file_size").alias("size"))
    out = out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, pruned))))
    return out if hidden else out.where(~F.col("path").rlike(r"(^|/)\.[^/]*$"))


def capped(files: DataFrame, most: int | None) -> tuple[DataFrame, bool]:
    """The first files by path, and whether the cap was reached (also when there are exactly as many)."""
    if most is None:
        return files, False
    out = files.orderBy("path").limit(most)
    return out, out.count() >= most


def documents(spark: SparkSession, root: str, most: int | None = None, hidden: bool = True, pruned: tuple[str, ...] = PRUNED) -> tuple[DataFrame, bool]:
    """Markdown pages."""
    return capped(read(spark, root, "md,mdx", pruned, hidden), most)


def first_documents(spark: SparkSession, root: str, candidates: tuple[str, ...] = ("docs", "_docs", "content", "."), most: int | None = None, pruned: tuple[str, ...] = PRUNED_FRESHNESS) -> DataFrame:
    """The pages of the first candidate folder that has any outside pruned folders; paths are below root. For coverage: PRUNED_COVERAGE."""
    for name in candidates:
        place = Path(root, name)
        if place.is_dir():
            own = documents(spark, str(place), most, pruned=pruned)[0]
            if own.head(1):
                return own if name == "." else own.withColumn("path", F.concat(F.lit(name + "/"), "path"))
    return spark.createDataFrame([], "path string, content string, size bigint")


def sources(spark: SparkSession, root: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """Source files of the known languages, without tests and the like."""
    return capped(read(spark, root, SOURCE, PRUNED_COVERAGE), most)


def git(root: str, *args: str) -> tuple[str, int]:
    """What git prints, and its exit status."""
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=False)
    return run.stdout.strip(), run.returncode


def safe_range(text: str) -> bool:
    """Whether a revision range may be handed to git."""
    return bool(SAFE_RANGE.fullmatch(text))


def changelog_range(root: str, wanted: str | None) -> str | None:
    """a..b as it is; from the tag before one revision, else 50 commits; from the last tag to HEAD; None for all."""
    if wanted and ".." in wanted:
        return wanted
    if wanted:
        tag, status = git(root, "describe", "--tags", "--abbrev=0", wanted + "~1")
        return f"{tag}..{wanted}" if not status and tag else f"{wanted}~50..{wanted}"
    tag, status = git(root, "describe", "--tags", "--abbrev=0")
    return f"{tag}..HEAD" if not status and tag else None


def freshness_range(root: str, wanted: str | None) -> str:
    """a..b as it is; one revision alone; since the last tag; the last 30 days; 30 commits."""
    if wanted:
        return wanted if ".." in wanted else f"{wanted}~1..{wanted}"
    tag, status = git(root, "describe", "--tags", "--abbrev=0")
    if not status and tag:
        return f"{tag}..HEAD"
    old, status = git(root, "log", "--since=30 days ago", "--format=%H", "--reverse")
    return f"{old.splitlines()[0]}..HEAD" if not status and old else "HEAD~30..HEAD"


def commits(spark: SparkSession, root: str, span: str | None = None, most: int | None = None) -> DataFrame:
    """pos, hash (8), author, date, subject, body: without merges, the newest first."""
    args = ["log", "--no-merges", "--format=" + FIELD.join(("%H", "%s", "%b", "%an", "%aI")) + RECORD]
    if most is not None:
        args.append(f"-{most}")
    if span is not None:
        if not safe_range(span):
            raise ValueError(f"not a revision range: {span}")
        args.append(span)
    rows = []
    for record in git(root, *args)[0].split(RECORD):
        part = record.strip("\n").split(FIELD)
        if len(part) == 5:
            rows.append((len(rows), part[0][:8], part[3], part[4], part[1], part[2].strip()))
    return spark.createDataFrame(rows, "pos int, hash string, author string, date string, subject string, body string")


def diff(spark: SparkSession, root: str, span: str, most: int | None = None) -> DataFrame:
    """path, line, d: the lines of the diff of each changed source file."""
    if not safe_range(span):
        raise ValueError(f"not a revision range: {span}")
    names = [n for n in git(root, "diff", "--name-only", span)[0].splitlines() if n.endswith(CHANGED)][:most]
    rows = [(n, k, d) for n in names for k, d in enumerate(git(root, "diff", span, "--", n)[0].split("\n"))]
    return spark.createDataFrame(rows, "path string, line int, d string")


def inside(root: str, folder: str) -> bool:
    """Whether a folder is in the root."""
    return Path(root, folder).resolve().is_relative_to(Path(root).resolve())


def report(df: DataFrame) -> str:
    """The rows of a small result as indented JSON, for people."""
    import json

    return json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2)
