"""Page index for language models: title, description, section and address of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRONT = r"(?s)\A---[^\S\n]*\n(.*?)\n---[^\S\n]*\n"
SECTIONS = [
    ("API", "/api/|/reference/|/endpoints?/|/rest/|/graphql/"),
    ("Guides", "/guides?/|/tutorials?/|/how-?to/|/walkthrough/|/getting-started"),
    ("Blog", "/blog/|/_posts/|/articles/|/news/|/changelog/|/release-notes?/"),
    ("Examples", "/examples?/|/samples?/|/quickstart/|/starter/|/demo/|/recipes?/"),
]
ORDER = ["Docs", "API", "Guides", "Blog", "Examples"]
FIRST = ["getting-started", "quickstart", "installation", "overview", "introduction", "index", "readme"]
PREFIX = 5000


def front_field(content: Column, name: str) -> Column:
    """A field of the front matter, without quotes; null if there is none."""
    block = F.regexp_extract(content, FRONT, 1)
    value = F.trim(F.regexp_extract(block, rf"(?dm)^{name}[^\S\n]*:[^\S\n]*['\"]?([^\n]+?)['\"]?[^\S\n]*$", 1))
    return F.nullif(value, F.lit(""))


def pages(docs: DataFrame) -> DataFrame:
    """path, title, description, bytes. The first 5,000 characters are read; size is the whole page's."""
    own = docs.withColumn("head", F.substring("content", 1, PREFIX))
    heading = F.nullif(F.trim(F.regexp_extract("head", r"(?dm)^#\s+([^\n]+)$", 1)), F.lit(""))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", ""), "[-_]", " ")
    body = F.regexp_replace("head", FRONT, "")
    wanted = F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & ~x.startswith("#") & ~x.startswith("```"))
    return own.select(
        "path",
        F.coalesce(front_field(F.col("head"), "title"), heading, F.initcap(name)).alias("title"),
        F.coalesce(front_field(F.col("head"), "description"), F.substring(F.get(wanted, F.lit(0)), 1, 200), F.lit("")).alias("description"),
        F.octet_length("content").alias("bytes"),
    )


def section(path: Column) -> Column:
    """The section of a path below the documents' root: the first rule that matches, else Docs."""
    own = F.concat(F.lit("/"), F.lower(path))
    out = F.when(own.rlike(SECTIONS[0][1]), SECTIONS[0][0])
    for name, pattern in SECTIONS[1:]:
        out = out.when(own.rlike(pattern), name)
    return out.otherwise("Docs")


def address(path: Column, base: str | None) -> Column:
    """The URL of a page: no extension, no trailing /index, no numbers before segments; the path itself without a base."""
    if not base:
        return path
    name = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/index$", "")
    plain = F.lower(F.replace(name, F.lit(" "), F.lit("-")))
    joined = F.array_join(F.transform(F.split(plain, "/"), lambda s: F.regexp_replace(s, "^[0-9]+-", "")), "/")
    return F.regexp_replace(F.concat(F.lit(base + "/"), joined), "/+$", "")


def priority(path: Column) -> Column:
    """Place of the first keyword that a path has; 7 if none."""
    out = F.when(F.lower(path).contains(FIRST[0]), 0)
    for k, word in enumerate(FIRST[1:], 1):
        out = out.when(F.lower(path).contains(word), k)
    return out.otherwise(len(FIRST)).cast("int")


def index(docs: DataFrame, root: str, base: str | None) -> DataFrame:
    """path, section, section_rank, priority, title, description, url, bytes."""
    below = F.regexp_replace("path", f"^{root}/", "")
    rank = F.array_position(F.array(*map(F.lit, ORDER)), section(below)).cast("int")
    return pages(docs).select("path", section(below).alias("section"), rank.alias("section_rank"), priority(below).alias("priority"), "title", "description", address(below, base).alias("url"), "bytes")


def rendered(docs: DataFrame, root: str, base: str | None) -> DataFrame:
    """section_rank, section, body: a list of links for each section, by priority and path."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""))
    own = index(docs, root, base).groupBy("section_rank", "section").agg(F.array_sort(F.collect_list(F.struct("priority", F.lower("path").alias("p"), "path", line.alias("line")))).alias("x"))
    return own.select("section_rank", "section", F.array_join(F.col("x.line"), "\n").alias("body"))


def index_text(docs: DataFrame, root: str, base: str | None, name: str, description: str) -> DataFrame:
    """text: the whole index in one row: name, description, and the sections that have pages."""
    part = F.concat(F.lit("## "), "section", F.lit("\n\n"), "body")
    own = rendered(docs, root, base).agg(F.array_sort(F.collect_list(F.struct("section_rank", part.alias("part")))).alias("x"))
    return own.select(F.concat(F.lit(f"# {name}\n\n> {description}\n\n"), F.array_join("x.part", "\n\n"), F.lit("\n")).alias("text"))


def full_blocks(docs: DataFrame) -> DataFrame:
    """path, block: of each page its part of the full text, in order of path; the caller asks totals whether it is to be made."""
    return pages(docs).join(docs.select("path", "content"), "path").select("path", F.concat(F.lit("---\n\n## "), "title", F.lit("\n\n"), "content", F.lit("\n")).alias("block"))


def totals(docs: DataFrame, most_files: int = 20, most_kb: int = 200) -> DataFrame:
    """files, kb, full_export: whether all pages are few and small enough to be exported whole; full_warning: why not, else null."""
    out = docs.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b"))
    many = F.when(F.col("files") > most_files, F.concat(F.col("files").cast("string"), F.lit(f" files exceeds limit of {most_files}")))
    large = F.when(F.col("b") > most_kb * 1024, F.concat(F.floor(F.col("b") / 1024).cast("string"), F.lit(f"KB exceeds limit of {most_kb}KB")))
    why = F.concat_ws("; ", many, large)
    return out.select("files", F.bround(F.col("b") / 1024).cast("bigint").alias("kb"), (why == "").alias("full_export"), F.when(why != "", F.concat(F.lit("Cannot generate llms-full.txt: "), why)).alias("full_warning"))


PLATFORMS = [
    ("docusaurus", ["docusaurus.config.js", "docusaurus.config.ts"], r"url\s*[:=]\s*['\"]([^'\"]+)"),
    ("mintlify", ["mint.json", "mintlify.json"], r'"url"\s*:\s*"([^"]+)"'),
    ("mkdocs", ["mkdocs.yml", "mkdocs.yaml"], r"site_url\s*:\s*([^\n]+)"),
    ("gitbook", [".gitbook.yaml", "book.json"], None),
    ("vitepress", [".vitepress/config.js", ".vitepress/config.ts", ".vitepress/config.mts"], None),
    ("nextra", ["theme.config.jsx", "theme.config.tsx"], None),
    ("astro_starlight", ["astro.config.mjs", "astro.config.ts"], r"site\s*:\s*['\"]([^'\"]+)"),
]


def upwards(folder: str | None) -> list[str]:
    """A folder below the root and those above it, without the root; each with the slash that ends it."""
    parts = [p for p in (folder or "").split("/") if p not in ("", ".")]
    return ["/".join(parts[:k]) + "/" for k in range(len(parts), 0, -1)]


def platforms(files: DataFrame, docs: str | None = None) -> DataFrame:
    """project, platform, path, base_url: of each project (project, path, content) the first configuration that is there: at its root, then from the documents' folder upwards, each by the order of platforms."""
    rows = [(d, k, j, name, place + f, pattern) for d, place in enumerate(["", *upwards(docs)]) for k, (name, own, pattern) in enumerate(PLATFORMS) for j, f in enumerate(own)]
    table = files.sparkSession.createDataFrame(rows, "depth int, k int, j int, platform string, path string, pattern string")
    found = files.join(F.broadcast(table), "path").groupBy("project").agg(F.min_by(F.struct("platform", "path", "content", "pattern"), F.struct("depth", "k", "j")).alias("x"))
    value = F.expr("regexp_extract(x.content, x.pattern, 1)")
    value = F.when(F.col("x.platform") == "mkdocs", F.regexp_replace(F.trim(value), "^['\"]+|['\"]+$", "")).otherwise(value)
    url = F.when(F.col("x.pattern").isNotNull(), F.nullif(F.regexp_replace(value, "/+$", ""), F.lit("")))
    return found.select("project", "x.platform", "x.path", url.alias("base_url"))


TITLED = ["astro.config.mjs", "astro.config.ts", "docusaurus.config.js", "docusaurus.config.ts"]


def projects(files: DataFrame, docs: str | None = None) -> DataFrame:
    """project, name, description, url of each project (project, path, content).

    The name is the first heading of the README at the root, else in the documents' folder; else the title in a configuration
    near the documents; else what package.json says; else the project's own. The description is the README's first long line.
    """
    up = upwards(docs)
    head = F.substring("content", 1, 4000)
    title = F.trim(F.regexp_extract(head, r"(?dm)^#\s+([^\n]+)$", 1))
    long = F.filter(F.transform(F.split(head, "\n", -1), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & ~x.startswith("#") & ~x.startswith("---"))
    at = lambda path: F.col("path") == path
    first = lambda path, value, name: F.max(F.when(at(path), value)).alias(name)
    set_ = F.regexp_extract(F.substring("content", 1, 5000), r"title\s*:\s*['\"]([^'\"]+)", 1)
    places = [*up, ""][:5] if docs else []
    titles = [[first(place + name, set_, f"t{i}_{j}") for j, place in enumerate(places)] for i, name in enumerate(TITLED)]
    other = (up[0] if up else "") + "README.md"
    package = [first("package.json", F.coalesce(F.get_json_object("content", f"$.{k}"), F.lit("")), k) for k in ("name", "description", "homepage")]
    own = files.groupBy("project").agg(
        first("README.md", title, "n0"), first("README.md", F.coalesce(F.get(long, F.lit(0)), F.lit("")), "d0"), first(other, title, "n1"), first(other, F.coalesce(F.get(long, F.lit(0)), F.lit("")), "d1"), *[x for t in titles for x in t], *package
    )
    # Of a configuration's name the nearest file counts, whether it has a title or not.
    named = [F.nullif(F.coalesce(*(F.col(f"t{i}_{j}") for j in range(len(places)))), F.lit("")) for i in range(len(TITLED))] if places else []
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(blank("n0"), blank("n1"), *named, blank("name"), F.col("project").cast("string"))
    said = F.when(F.coalesce("n0", F.lit("")) != "", F.col("d0")).otherwise(F.coalesce(blank("d1"), F.col("d0")))
    return own.select("project", name.alias("name_"), F.coalesce(F.nullif(said, F.lit("")), "description", F.lit("")).alias("description"), F.coalesce("homepage", F.lit("")).alias("url")).withColumnRenamed("name_", "name")


def safe_base(url: Column) -> Column:
    """Whether a base URL may be used."""
    return url.rlike("^https?://")
