"""URL filter by a tree of path templates.

For each host the paths form a tree, walked from the root down. A child keeps its name only if it is frequent (at least
`least` pages), so that variable segments become *, and if its labelled pages differ
from those of its siblings together: |bad - n p| > z sqrt(n p (1 - p)) with p the parent's bad share; children that can't
be told apart are merged into the same *. The walk ends where a name can't be kept any more: below a node of too few pages,
or whose labels are all alike or missing, every segment is *. The template of a page is
host/child/child...; its purity is (good + strength * prior) / (labelled + strength), prior being the good share of
all labels that meet a page. Templates of a purity under `threshold` that have labelled pages are rejected.

Defined results: a null url, or one without scheme and host, has template null and is never rejected, nor counted. Labels
(page_id, bad) that are null or of unknown pages don't count; of repeated labels of a page, bad wins. Repeated pages count
each time. Without labels nothing is rejected and purity is null. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def starred(k: int) -> Column:
    """t with a * for each segment from the k-th on."""
    return F.concat("t", F.repeat(F.lit("/*"), F.size("s") - k))


def templates(pages: DataFrame, labels: DataFrame, least: int = 5, z: float = 1.96, strength: float = 5.0, threshold: float = 0.5) -> DataFrame:
    """page_id, template, pages, labelled, bad, purity, rejected: one row for each row of pages."""
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    own = pages.select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.regexp_extract("url", PATH, 1).alias("path"))
    own = own.withColumn("s", F.filter(F.split("path", "/"), lambda x: x != "")).drop("path")
    own = own.join(marks, "page_id", "left").withColumn("t", F.when(F.col("host") != "", F.col("host")))
    own = own.drop("host")
    k = 0
    while True:
        own = written(own.withColumn("c", F.get("s", F.lit(k))), "level")
        children = own.where("t is not null and c is not null").groupBy("t", "c").agg(F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
        parents = children.groupBy("t").agg(F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        live = written(parents.where((F.col("pn") >= least) & (F.col("pb") > 0) & (F.col("pb") < F.col("pl"))).select("t", F.lit(1).alias("live")), "live")
        if not live.head(1):
            break
        p = F.col("pb") / F.col("pl")
        named = (
            children.join(parents, "t")
            .where((F.col("n") >= least) & (F.col("pl") > 0))
            .where(F.abs(F.col("b") - F.col("l") * p) > z * F.sqrt(F.col("l") * p * (1 - p)))
            .select("t", "c", F.lit(1).alias("named"))
        )
        # Named segments are few: they have `least` pages and labels of their own. So no page is shuffled, while they fit.
        named = small(written(named, "named"), 256)
        step = F.concat("t", F.lit("/"), F.when(F.col("named") == 1, F.col("c")).otherwise("*"))
        own = own.join(named, ["t", "c"], "left").join(small(live, 128), "t", "left").select(
            "page_id", "bad", F.when(F.col("c").isNull(), F.col("t")).when(F.col("live") == 1, step).otherwise(starred(k)).alias("t"), F.when(F.col("live") == 1, F.col("s")).alias("s")
        )
        k += 1
    own = own.withColumn("t", F.when(F.col("c").isNull(), F.col("t")).otherwise(starred(k))).drop("c")
    own = written(own.drop("s"), "named")
    found = own.where("t is not null").groupBy("t").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("nbad"))
    prior = found.agg((F.sum("labelled") - F.sum("nbad")).alias("good"), F.sum("labelled").alias("all"))
    scored = found.crossJoin(prior).select(
        "t", "pages", "labelled", "nbad", F.when(F.col("all") > 0, (F.col("labelled") - F.col("nbad") + strength * (F.col("good") / F.nullif("all", F.lit(0)))) / (F.col("labelled") + strength)).alias("purity")
    )
    return own.join(scored, "t", "left").select(
        "page_id", F.col("t").alias("template"), "pages", "labelled", F.col("nbad").alias("bad"), F.round("purity", 6).alias("purity"), F.coalesce((F.col("purity") < threshold) & (F.col("labelled") > 0), F.lit(False)).alias("rejected")
    )


def kept(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of pages whose template isn't rejected, with their columns; rows of a null page_id stay."""
    out = templates(pages, labels, **options).where("rejected").select(F.col("page_id").alias("__rejected")).distinct()
    return pages.join(out, pages["page_id"] == F.col("__rejected"), "left_anti")


def sql(depth: int = 4, least: int = 5, share: float = 0.01, z: float = 1.96, strength: float = 5.0, threshold: float = 0.5) -> str:
    """The same in DuckDB's SQL, over pages and the labels of the documents that the urls name."""
    out = [
        f"""m as (select p.page_id, max(case when l.quality = 0 or l.toxic = 1 then 1 else 0 end) as bad from pages p join labels l
on l.doc_id = try_cast(regexp_extract(p.url, '{NUMBER}', 1) as bigint) where p.page_id is not null and (l.quality is not null or l.toxic is not null) group by 1),
o0 as (select p.page_id, m.bad, list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') as s,
nullif(lower(regexp_extract(url, '{HOST}', 1)), '') as t from pages p left join m using (page_id))"""
    ]
    for k in range(depth):
        name = f"s[{k + 1}]" if k < depth - 1 else f"case when len(s) > {k} then array_to_string(s[{k + 1}:], '/') end"
        out.append(f"""c{k} as (select *, {name} as c from o{k}),
n{k} as (select t, c, count(*) as n, count(bad) as l, coalesce(sum(bad), 0) as b from c{k} where t is not null and c is not null group by 1, 2),
p{k} as (select t, sum(n) as pn, sum(l) as pl, sum(b) as pb from n{k} group by 1),
k{k} as (select t, c from n{k} join p{k} using (t) where n >= {least} and n >= cast({share} as double) * pn and pl > 0
and abs(b - l * (cast(pb as double) / pl)) > cast({z} as double) * sqrt(l * (cast(pb as double) / pl) * (1 - cast(pb as double) / pl))),
o{k + 1} as (select page_id, bad, s, case when c{k}.c is null then c{k}.t else concat(c{k}.t, '/', case when k{k}.c is not null then c{k}.c else '*' end) end as t
from c{k} left join k{k} on c{k}.t = k{k}.t and c{k}.c = k{k}.c)""")
    return (
        "with "
        + ",\n".join(out)
        + f""",
f as (select t, count(*) as pages, count(bad) as labelled, cast(coalesce(sum(bad), 0) as bigint) as nbad from o{depth} where t is not null group by 1),
a as (select sum(labelled) - sum(nbad) as good, sum(labelled) as al from f),
q as (select t, pages, labelled, nbad, case when al > 0 then (labelled - nbad + cast({strength} as double) * (cast(good as double) / al)) / (labelled + cast({strength} as double)) end as purity from f, a)
select o.page_id, o.t as template, q.pages, q.labelled, q.nbad as bad, round(q.purity, 6) as purity, coalesce(q.purity < {threshold} and q.labelled > 0, false) as rejected from o{depth} o left join q on o.t = q.t"""
    )


#: The number in a url of the crawl is that of the document on the page, by which labels are found.
NUMBER = r"/([0-9]{1,18})(?:[./?#]|$)"
