"""Link integrity: extraction, classification, resolution, anchors, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fenced, folder, found, lines, normal_path, slug

INLINE = r"\[([^\]]*)\]\(([^)]+)\)"
USE = r"\[([^\]]*)\]\[([^\]]*)\]"
DEFINITION = r"(?dm)^\[([^\]]+)\]:\s*([^\n]+)$"
ATTRIBUTE = r"""(?:href|src)=["']([^"']+)["']"""
HEADING = r"(?dm)^#{1,6}\s+([^\n]+)$"
IDENTIFIER = r"""(?:id|name)=["']([^"']+)["']"""
LINK = ["path", "line", "kind", "ordinal", "text", "target"]


def definitions(docs: DataFrame) -> DataFrame:
    """path, ref (lower case), target: reference definitions, of equal ids the last."""
    both = docs.select("path", F.posexplode(F.arrays_zip(found(F.col("content"), DEFINITION, 1).alias("a"), found(F.col("content"), DEFINITION, 2).alias("b"))).alias("p", "x"))
    return both.groupBy("path", F.lower("x.a").alias("ref")).agg(F.trim(F.max_by("x.b", "p")).alias("target"))


def inline(text: DataFrame) -> DataFrame:
    """Inline links and images of lines; the target is the first word in the brackets, empty ones give nothing."""
    both = text.select("path", "line", F.posexplode(F.arrays_zip(found(F.col("text"), INLINE, 1).alias("a"), found(F.col("text"), INLINE, 2).alias("b"))).alias("ordinal", "x"))
    target = F.split(F.trim("x.b"), r"\s+")[0]
    return both.select("path", "line", F.lit(0).alias("kind"), "ordinal", F.col("x.a").alias("text"), target.alias("target")).where("target <> ''")


def references(text: DataFrame, defined: DataFrame) -> DataFrame:
    """Uses of reference links that are defined in the same document; an empty id is the text."""
    both = text.select("path", "line", F.posexplode(F.arrays_zip(found(F.col("text"), USE, 1).alias("a"), found(F.col("text"), USE, 2).alias("b"))).alias("ordinal", "x"))
    uses = both.select("path", "line", F.lit(1).alias("kind"), "ordinal", F.col("x.a").alias("text"), F.lower(F.when(F.col("x.b") == "", F.col("x.a")).otherwise(F.col("x.b"))).alias("ref"))
    return uses.join(defined.hint("merge"), ["path", "ref"]).select(*LINK)


def attributes(text: DataFrame) -> DataFrame:
    """Targets of href and src."""
    own = text.select("path", "line", F.posexplode(found(F.col("text"), ATTRIBUTE)).alias("ordinal", "target"))
    return own.select("path", "line", F.lit(2).alias("kind"), "ordinal", F.lit("").alias("text"), "target")


def kind_of(target: Column) -> Column:
    """email, external, anchor, image or internal."""
    return (
        F.when(target.startswith("mailto:"), "email")
        .when(target.rlike("^https?://"), "external")
        .when(target.startswith("#"), "anchor")
        .when(target.rlike(r"(?i)\.(?:png|jpe?g|gif|svg|webp)$"), "image")
        .otherwise("internal")
    )


def links(docs: DataFrame) -> DataFrame:
    """All links outside code fences: path, line, kind (inline, reference, attribute), ordinal, text, target, type."""
    # A document's definitions, the last first, go with its lines; so there is one pass, without a join.
    ids = F.transform(F.reverse(found(F.col("content"), DEFINITION, 1)), lambda x: F.lower(x))
    places = F.transform(F.reverse(found(F.col("content"), DEFINITION, 2)), lambda x: F.trim(x))
    text = fenced(docs.select("path", "content", ids.alias("ids"), places.alias("places")), keep=("ids", "places")).where("not inside")
    row = lambda kind, i, text, target: F.struct(F.lit(kind).alias("kind"), i.alias("ordinal"), text.alias("text"), target.alias("target"))
    pairs = lambda p: F.arrays_zip(found(F.col("text"), p, 1).alias("a"), found(F.col("text"), p, 2).alias("b"))
    # Most lines have none of these, and then no pattern is tried.
    marks = [F.col("text").contains("]("), F.col("text").contains("]["), F.col("text").contains("href=") | F.col("text").contains("src=")]
    rows = [
        F.transform(pairs(INLINE), lambda x, i: row(0, i, x["a"], F.split(F.trim(x["b"]), r"\s+")[0])), F.transform(pairs(USE), lambda x, i: row(1, i, x["a"], F.lower(F.when(x["b"] == "", x["a"]).otherwise(x["b"])))),
        F.transform(found(F.col("text"), ATTRIBUTE), lambda x, i: row(2, i, F.lit(""), x)),
    ]
    none = F.array().cast("array<struct<kind:int,ordinal:int,text:string,target:string>>")
    every = F.concat(*(F.when(m, r).otherwise(none) for m, r in zip(marks, rows)))
    text = text.where(marks[0] | marks[1] | marks[2])
    out = text.select("path", "line", "ids", "places", F.explode(every).alias("x"))
    target = F.when(F.col("x.kind") == 1, F.get("places", F.array_position("ids", F.col("x.target")).cast("int") - 1)).otherwise(F.col("x.target"))
    out = out.select("path", "line", "x.kind", "x.ordinal", "x.text", target.alias("target")).where("target <> '' or kind > 0 and target is not null")
    return out.withColumn("type", kind_of(F.col("target")))


def anchors(docs: DataFrame) -> DataFrame:
    """path, anchor: of headings (fences aren't masked) and of id and name attributes."""
    heads = docs.select("path", F.explode(found(F.col("content"), HEADING)).alias("h")).select("path", slug(F.col("h")).alias("anchor"))
    marks = docs.select("path", F.explode(found(F.col("content"), IDENTIFIER)).alias("anchor"))
    return heads.union(marks).where("anchor <> ''").distinct()


def missing_anchors(docs: DataFrame) -> DataFrame:
    """Links into their own page whose anchor isn't there, whatever its case."""
    own = links(docs).where("type = 'anchor'").withColumn("anchor", F.lower(F.substring("target", 2, 1 << 30)))
    there = anchors(docs).select("path", F.lower("anchor").alias("anchor")).distinct()
    return own.join(there.hint("merge"), ["path", "anchor"], "left_anti").select("path", "line", "target", "anchor")


def suggestions(docs: DataFrame) -> DataFrame:
    """For missing anchors up to three that begin with the same five letters, and up to ten that the page has."""
    gone = missing_anchors(docs)
    there = anchors(docs).groupBy("path").agg(F.array_sort(F.collect_set("anchor")).alias("has"))
    like = F.filter("has", lambda x: F.lower(x).startswith(F.substring("anchor", 1, 5)))
    out = gone.join(there.hint("merge"), "path", "left").select("path", "line", "anchor", F.slice(F.coalesce(like, F.array().cast("array<string>")), 1, 3).alias("like"), F.slice(F.coalesce("has", F.array().cast("array<string>")), 1, 10).alias("has"))
    return out.select("path", "line", "anchor", F.array_join("like", ",").alias("suggested"), F.array_join("has", ",").alias("available"))


def resolved(docs: DataFrame) -> DataFrame:
    """Internal links and images with the page that they lead to: relative to their page, or by route; null where there is none.

    A relative target may also be a folder. What leaves the root is broken and its path isn't shown. A route begins at the
    root; a relative target that isn't there is tried as a route too, and is then a fallback. Documents without content have no links.
    """
    own = links(docs).where("type in ('internal', 'image')").withColumn("file", F.substring_index("target", "#", 1))
    own = own.withColumn("fragment", F.when(F.col("target").contains("#"), F.expr("substr(target, locate('#', target) + 1)")).otherwise(""))
    route = F.col("file").startswith("/")
    relative = normal_path(F.concat_ws("/", folder(F.col("path")), "file"))
    own = own.withColumn("at", F.when(~route, relative)).withColumn("outside", ~route & (F.col("at").startswith("../") | (F.col("at") == "..")))
    name = F.regexp_replace("file", "^/+|/+$", "")
    name = F.when(name == "", "index").otherwise(name)
    routes = [normal_path(F.concat(name, F.lit(end))) for end in (".md", ".mdx", "/index.md", "/index.mdx")]
    tries = F.array(F.when(~route, F.col("at")), *routes)
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("c"), F.lit(False).alias("page")))
    places = docs.select(F.explode(F.concat(folders, F.array(F.struct(F.col("path").alias("c"), F.lit(True).alias("page"))))).alias("x")).groupBy("x.c").agg(F.max("x.page").alias("page"))
    own = own.withColumn("key", F.struct("path", "line", "kind", "ordinal"))
    wide = own.where("not outside").select("key", F.posexplode(tries).alias("r", "c")).where("c is not null")
    hits = wide.join(places.hint("merge"), "c").where("r = 0 or page").groupBy("key").agg(F.min(F.struct("r", "c")).alias("x"))
    return own.join(hits.hint("merge"), "key", "left").select(
        "path", "line", "kind", "ordinal", "type", "target", "fragment", "outside", F.col("x.c").alias("resolved"), F.coalesce(~F.col("file").startswith("/") & (F.col("x.r") > 0), F.lit(False)).alias("fallback"),
        F.when(F.col("outside"), "broken").when(F.col("x").isNull(), "broken").otherwise("ok").alias("status"),
    )


def missing_fragments(docs: DataFrame) -> DataFrame:
    """Links to another page, found by its path or by a route of its own, that is there without the anchor."""
    own = resolved(docs).where("status = 'ok' and fragment <> '' and not fallback").withColumn("anchor", F.lower("fragment"))
    there = anchors(docs).select(F.col("path").alias("resolved"), F.lower("anchor").alias("anchor")).distinct()
    return own.join(there.hint("merge"), ["resolved", "anchor"], "left_anti").select("path", "line", "kind", "ordinal", "target", "resolved")


def page_suggestions(docs: DataFrame) -> DataFrame:
    """For broken relative links up to three pages of the wanted folder that begin with the same three letters."""
    gone = resolved(docs).where("status = 'broken' and type = 'internal' and not outside and not startswith(target, '/')")
    wanted = normal_path(F.concat_ws("/", folder(F.col("path")), F.substring_index("target", "#", 1)))
    gone = gone.select("path", "line", "target", "kind", "ordinal", folder(wanted).alias("dir"), F.lower(F.substring(F.regexp_replace(wanted, "^.*/", ""), 1, 3)).alias("three"))
    pages = docs.select(folder(F.col("path")).alias("dir"), F.regexp_replace("path", "^.*/", "").alias("name"))
    pages = pages.withColumn("three", F.lower(F.substring("name", 1, 3)))
    # Of each beginning only the first three pages can be suggested.
    few = pages.withColumn("n", F.row_number().over(Window.partitionBy("dir", "three").orderBy("name"))).where("n <= 3")
    few = few.groupBy("dir", "three").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("suggested"))
    return gone.join(few.hint("merge"), ["dir", "three"], "left").select("path", "line", "target", "kind", "ordinal", F.coalesce("suggested", F.lit("")).alias("suggested"))


def orphans(docs: DataFrame) -> DataFrame:
    """Pages that no internal link leads to by its path; front pages don't count. A route isn't a path of a page."""
    to = links(docs).where("type = 'internal' and not startswith(target, '/')").select(normal_path(F.concat_ws("/", folder(F.col("path")), F.substring_index("target", "#", 1))).alias("path")).distinct()
    return docs.select("path").join(to.hint("merge"), "path", "left_anti").where(~F.col("path").rlike(r"(?:README\.md|index\.mdx?)$"))


def http_status(code: Column) -> Column:
    """What a status code says of a link."""
    return (
        F.when(code == 200, "ok").when(code.isin(301, 302, 307, 308), "redirect").when(code == 403, "indeterminate")
        .when(code == 429, "rate_limited").when(code.isin(404, 410), "broken").otherwise("unknown")
    )


def safe_url(url: Column) -> Column:
    """Whether a URL has a host, and a scheme that may be asked."""
    return url.rlike(r"(?i)^https?://[^/?#]+")


def budgeted(docs: DataFrame, most: int = 50) -> DataFrame:
    """External links in order, with whether they are within the budget of requests."""
    own = links(docs).where("type = 'external'").select("path", "line", "kind", "ordinal", "target")
    key = F.struct("path", "line", "kind", "ordinal")
    # The last that is within the budget is one row; all others are compared with it.
    last = own.select(key.alias("key")).orderBy("key").limit(most).agg(F.max("key").alias("last"))
    return own.join(F.broadcast(last)).select(*own.columns, (key <= F.col("last")).alias("checked"))


def fixes(docs: DataFrame) -> DataFrame:
    """path, line, target, proposed: broken links that have a suggestion. Only the file, or only the anchor, is replaced."""
    pages = page_suggestions(docs).where("suggested <> ''")
    rest = F.when(F.col("target").contains("#"), F.expr("substr(target, locate('#', target))")).otherwise("")
    file = F.concat(F.regexp_replace(F.substring_index("target", "#", 1), "[^/]*$", ""), F.substring_index("suggested", ",", 1), rest)
    marks = suggestions(docs).where("suggested <> ''")
    return pages.select("path", "line", "target", file.alias("proposed")).union(
        marks.select("path", "line", F.concat(F.lit("#"), "anchor").alias("target"), F.concat(F.lit("#"), F.substring_index("suggested", ",", 1)).alias("proposed"))
    )


def summary(docs: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Links by type in one row; how many are ok, broken or redirected; and has_broken, which says whether a check fails.

    checked: target and status of the external links that were asked for; the others count as ok. E-mail is in the total alone.
    """
    every = links(docs)
    each = [F.count("*").alias("total"), *(F.count_if(F.col("type") == k).alias(k) for k in ("internal", "anchor", "image", "external", "email"))]
    states = (("broken", "broken_external"), ("redirect", "redirects"))
    if checked is None:
        kinds = every.agg(*each, *(F.lit(0).cast("bigint").alias(n) for _, n in states), F.count_if(F.col("type") == "external").alias("external_ok"))
    else:
        status = every.where("type = 'external'").select("target").join(checked.select("target", "status").distinct(), "target", "left")
        kinds = every.agg(*each).crossJoin(status.agg(*(F.count_if(F.col("status") == k).alias(n) for k, n in states), F.count_if(F.coalesce("status", F.lit("ok")) == "ok").alias("external_ok")))
    # Broken links and lost fragments of one pass; what has no fragment to look for meets no anchor, and is spread by its own page.
    own = resolved(docs).select("status", "path", "resolved", F.when((F.col("status") == "ok") & (F.col("fragment") != "") & ~F.col("fallback"), F.lower("fragment")).alias("anchor"))
    own = own.withColumn("resolved", F.coalesce("resolved", "path"))
    there = anchors(docs).select(F.col("path").alias("resolved"), F.lower("anchor").alias("anchor")).distinct().withColumn("here", F.lit(True))
    gone = own.join(there.hint("merge"), ["resolved", "anchor"], "left").agg(F.count_if((F.col("status") == "broken") | F.col("anchor").isNotNull() & F.col("here").isNull()).alias("n"))
    broken = gone.crossJoin(missing_anchors(docs).agg(F.count("*").alias("m"))).select((F.col("n") + F.col("m")).alias("broken_internal"))
    out = kinds.crossJoin(broken).crossJoin(orphans(docs).agg(F.count("*").alias("orphans")))  # single rows
    ok = F.col("internal") + F.col("anchor") + F.col("image") - F.col("broken_internal") + F.col("external_ok")
    return out.withColumn("ok", ok).withColumn("has_broken", F.col("broken_internal") + F.col("broken_external") > 0).drop("external_ok")


def page_links(pages: DataFrame) -> DataFrame:
    """Links of crawled pages by attribute: page_id, line, target, type."""
    text = lines(pages.select(F.col("page_id").alias("path"), F.col("html").alias("content")))
    return attributes(text).select(F.col("path").alias("page_id"), "line", "ordinal", "target", kind_of(F.col("target")).alias("type"))
