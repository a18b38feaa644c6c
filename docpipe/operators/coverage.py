"""Coverage: the public names of source files (path, content), and whether documents speak of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folder, found, holding, joined, lines

WORD = r"([\p{L}\p{N}_]+)"
SCRIPT = [
    ("function", r"^export\s+(?:async\s+)?function\s+" + WORD),
    ("const_arrow", r"^export\s+(?:const|let)\s+" + WORD + r"\s*="),
    ("class", r"^export\s+(?:abstract\s+)?class\s+" + WORD),
    ("interface", r"^export\s+interface\s+" + WORD),
    ("type", r"^export\s+type\s+" + WORD),
    ("default_function", r"^export\s+default\s+(?:async\s+)?function\s+" + WORD),
    ("default_class", r"^export\s+default\s+class\s+" + WORD),
    ("module_exports_fn", r"^(?:module\.)?exports\." + WORD + r"\s*=\s*function"),
    ("module_exports_val", r"^(?:module\.)?exports\." + WORD + r"\s*="),
]
PYTHON = [("function", r"^(?:async\s+)?def\s+([a-z][\p{L}\p{N}_]+)\s*\("), ("class", r"^class\s+" + WORD)]
GO = [("function", r"^func\s+([A-Z][\p{L}\p{N}_]+)\s*\("), ("function", r"^func\s+\([^)]+\)\s+([A-Z][\p{L}\p{N}_]+)\s*\("), ("type", r"^type\s+([A-Z][\p{L}\p{N}_]+)\s+(?:struct|interface)")]
VERB = r"""(?:app|router)\.\s*(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
FLASK = r"""@(?:app|bp|blueprint)\.\s*(?:route|get|post|put|delete)\s*\(\s*['"]([^'"]+)"""
FASTAPI = r"""@(?:app|router)\.\s*(?:get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)"""
EXCLUDED = r"\.(?:test|spec|stories)\.[jt]sx?$|_test\.(?:py|go)$|test_[\p{L}\p{N}_]+\.py$|(?:conftest|setup)\.py$|\.d\.ts$"
NAMING = r"^(?:export|module|exports|async|def|class|func|type)\b|(?:app|router|bp|blueprint)\.\s*(?:route|get|post|put|delete|patch)\s*\("  # what every pattern above needs
SHORT_NAME, SHORT_TERM = 4, 6


def language(files: DataFrame) -> DataFrame:
    """files with language: typescript, python, go; others and excluded files are left out."""
    kind = F.when(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mjs)$"), "typescript").when(F.col("path").rlike(r"\.py$"), "python").when(F.col("path").rlike(r"\.go$"), "go")
    return files.where(~F.col("path").rlike(EXCLUDED)).withColumn("language", kind).where("language is not null")


def excluded(files: DataFrame) -> DataFrame:
    """The files that are tests, stories, declarations or packaging."""
    return files.where(F.col("path").rlike(EXCLUDED)).select("path")


def primary_language(files: DataFrame) -> DataFrame:
    """language: that of most files."""
    rank = F.array_position(F.array(*map(F.lit, ("typescript", "python", "go"))), F.col("language"))
    n = language(files).groupBy("language").agg(F.count("*").alias("n")).agg(F.max_by("language", F.struct("n", -rank)).alias("language"))
    return n.select(F.coalesce("language", F.lit("unknown")).alias("language"))


def _pairs(patterns: list[tuple[str, str]]):
    return F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for k, p in patterns)), lambda x: x["name"] != "")


def items(files: DataFrame) -> DataFrame:
    """path, line, name, type, has_inline_docs: public functions, components, classes, types and endpoints.

    The comment above a name is looked for in the file's own array of lines, at most 9 and then 29 lines back: no window.
    """
    own = language(files).withColumn("all", F.split("content", "\n", -1))
    # Of the lines only those that may name something are exploded, each with the lines around it that its comment may be in.
    some = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("p"), x.alias("text"))), lambda x: x["text"].rlike(NAMING))
    text = own.select("path", "language", "all", F.explode(some).alias("y")).select("path", "language", F.col("y.p").alias("line0"), "y.text", F.greatest(F.col("y.p") - 40, F.lit(0)).alias("from"), "all")
    text = text.select("path", "language", "line0", "text", F.slice("all", F.col("from") + 1, F.lit(44)).alias("all"), (F.col("line0") - F.col("from")).alias("p"))
    ts = F.col("language") == "typescript"
    py = F.col("language") == "python"
    exported = F.when(ts, _pairs(SCRIPT)).when(py, _pairs(PYTHON)).otherwise(_pairs(GO))
    verbs = F.transform(F.arrays_zip(found(F.col("text"), VERB, 1).alias("v"), found(F.col("text"), VERB, 2).alias("u")), lambda x: F.struct(F.lit("endpoint").alias("kind"), F.concat(F.upper(x["v"]), F.lit(" "), x["u"]).alias("name")))
    routes = F.transform(F.array_union(found(F.col("text"), FLASK), found(F.col("text"), FASTAPI)), lambda x: F.struct(F.lit("endpoint").alias("kind"), F.concat(F.lit("ROUTE "), x).alias("name")))
    every = F.concat(exported, F.when(ts, verbs).when(py, routes).otherwise(F.array().cast("array<struct<kind:string,name:string>>")))
    rows = text.where(F.size(every) > 0).select("path", "language", "all", "p", "line0", F.explode(every).alias("x")).where(f"x.kind = 'endpoint' or length(x.name) >= {SHORT_NAME}")
    component = F.col("path").endswith(".tsx") & F.col("x.name").rlike("^[A-Z]")
    kind = (
        F.when((F.col("language") == "typescript") & F.col("x.kind").isin("function", "const_arrow", "default_function"), F.when(component, "component").otherwise("function"))
        .when(F.col("x.kind") == "default_class", "class")
        .otherwise(F.col("x.kind"))
    )
    at = lambda k: F.trim(F.coalesce(F.get("all", F.col("p") + k), F.lit("")))
    # The nearest line above that is exactly */, with only blank and comment lines between, and above it an opening; text in between.
    above = F.transform(F.reverse(F.slice("all", F.greatest(F.col("p") - 8, F.lit(1)), F.least(F.lit(9), F.col("p")))), lambda x: F.trim(x))
    ends = F.array_position(above, "*/").cast("int")
    calm = F.forall(F.slice(above, F.lit(1), F.greatest(ends - 1, F.lit(0))), lambda x: (x == "") | x.startswith("//") | x.startswith("*"))
    close = F.col("p") - ends
    inner = F.transform(F.slice("all", F.greatest(close - 28, F.lit(1)), F.least(F.lit(29), F.greatest(close, F.lit(0)))), lambda x: F.trim(x))
    opening = F.array_position(F.transform(F.reverse(inner), lambda x: x.contains("/**")), True).cast("int")
    body = F.slice(inner, F.greatest(F.size(inner) - opening + 1, F.lit(1)), F.lit(30))
    jsdoc = (F.col("p") > 0) & (ends > 0) & calm & (opening > 0) & F.exists(body, lambda x: ~x.isin("", "/**", "*/", "*"))
    quote = lambda x: x.startswith('"""') | x.startswith("'''")
    quiet = lambda x: (x == "") | x.startswith("#")
    docstring = quote(at(1)) | (quiet(at(1)) & quote(at(2)))
    inline = F.when(F.col("x.kind") == "endpoint", F.lit(False)).when(F.col("language") == "typescript", jsdoc).when(F.col("language") == "python", docstring).otherwise(at(-1).startswith("//") & (F.col("p") > 0))
    return rows.select("path", (F.col("line0") + 1).alias("line"), F.col("x.name").alias("name"), kind.alias("type"), F.coalesce(inline, F.lit(False)).alias("has_inline_docs"))


def documented_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms that stand between two backticks of some document, wherever these are."""
    spans = docs.select(F.explode(F.expr("slice(split(content, '`', -1), 2, greatest(size(split(content, '`', -1)) - 2, 0))")).alias("span"))
    return holding(spans, "span", terms, "term", SHORT_TERM).select("term").distinct()


def status(files: DataFrame, docs: DataFrame) -> DataFrame:
    """items with status: documented, partial, undocumented, or skipped where the term is too short to be looked for. Without any document all are undocumented."""
    if not docs.where("content is not null").head(1):
        return items(files).withColumn("status", F.lit("undocumented"))
    own = items(files).withColumn("term", F.when(F.col("type") == "endpoint", F.regexp_replace("name", "^[A-Z]+ ", "")).otherwise(F.col("name")))
    terms = own.where(F.length("term") >= SHORT_TERM).select("term").distinct()
    hit = documented_terms(docs, terms).withColumn("hit", F.lit(True))
    out = F.when(F.length("term") < SHORT_TERM, "skipped").when(F.col("hit"), "documented").when(F.col("has_inline_docs"), "partial").otherwise("undocumented")
    return own.join(joined(hit), "term", "left").select("path", "line", "name", "type", "has_inline_docs", out.alias("status"))


def by(files: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """documented, partial, total and rounded percentage by type or by directory; skipped names don't count."""
    own = status(files, docs).where("status <> 'skipped'").withColumn("directory", folder(F.col("path")))
    out = own.groupBy(key).agg(F.count_if(F.col("status") == "documented").alias("documented"), F.count_if(F.col("status") == "partial").alias("partial"), F.count("*").alias("total"))
    return out.withColumn("percentage", F.bround(F.col("documented") / F.col("total") * 100).cast("int"))


def largest_directories(files: DataFrame, docs: DataFrame, most: int = 15) -> DataFrame:
    """The directories with the most names, by name where equal."""
    return by(files, docs, "directory").orderBy(F.desc("total"), "directory").limit(most)


def overall(files: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documented, partial, undocumented, total, percentage."""
    own = status(files, docs).where("status <> 'skipped'")
    out = own.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("documented", "partial", "undocumented")), F.count("*").alias("total"))
    return out.withColumn("percentage", F.when(F.col("total") > 0, F.bround(F.col("documented") / F.col("total") * 100)).otherwise(0).cast("int"))


def undocumented(files: DataFrame, docs: DataFrame, most: int = 30) -> DataFrame:
    """The first undocumented names: endpoints, then functions, classes and the rest."""
    order = F.when(F.col("type") == "endpoint", 0).when(F.col("type").isin("function", "component"), 1).when(F.col("type") == "class", 2).otherwise(3)
    return status(files, docs).where("status = 'undocumented'").withColumn("priority", order).orderBy("priority", "path", "line", "name").limit(most).select("priority", "path", "line", "name", "type")


def partial(files: DataFrame, docs: DataFrame, most: int = 15) -> DataFrame:
    """The first names with a comment but without a page, and why they are on the list."""
    own = status(files, docs).where("status = 'partial'").orderBy("path", "line", "name").limit(most)
    return own.select("path", "line", "name", "type", F.lit("Has inline docs but no page of its own").alias("reason"))


def docs_kind(docs: DataFrame) -> DataFrame:
    """kind: api_reference if a document says so or functions are mentioned more than 20 times, else product_docs."""
    said = F.max(F.col("content").rlike(r"(?i)(?:api|function|class)\s+reference"))
    calls = F.sum(F.size(found(F.col("content"), r"(`[^`]+\(\)`)")))
    return docs.agg(F.when(said | (calls > 20), "api_reference").otherwise("product_docs").alias("kind"))


def stubs(files: DataFrame, docs: DataFrame) -> DataFrame:
    """path, line, stub: a page section to fill in for each undocumented name, with the source line as its signature."""
    own = status(files, docs).where("status = 'undocumented'")
    text = lines(files)
    stub = F.concat(F.lit("## "), "name", F.lit("\n\n```\n"), F.trim("text"), F.lit("\n```\n\nDescription.\n\n### Parameters\n\n### Returns\n\n### Example\n"))
    return own.join(text.hint("merge"), ["path", "line"]).select("path", "line", "name", stub.alias("stub"))


