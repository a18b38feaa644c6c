"""Queries over the derived corpora and the crawled pages, one for each operator or closely related group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fenced, lines, slug
from ..operators import changelog, coverage, freshness, links, pageindex, review, rules
from ..sources.corpora import corpus

BASE = "https://example.com"


def on(name: str, function):
    """A query of one corpus."""
    return lambda spark, sf_dir: function(corpus(spark, sf_dir, name))


def on_two(first: str, second: str, function):
    return lambda spark, sf_dir: function(corpus(spark, sf_dir, first), corpus(spark, sf_dir, second))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(pages(spark, sf_dir))


def page_link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy("type").agg(F.count("*").alias("links"), F.countDistinct("target").alias("targets"))


def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return pages(spark, sf_dir).select("page_id", pageindex.section(path).alias("section"), links.safe_url(F.col("url")).alias("safe"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return pageindex.pages(docs).select("path", "description", "bytes")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 301, 302, 307, 308, 403, 404, 410, 429, 500))), (F.col("event_id") % 10 + 1).cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(code.alias("code"))
    return events.groupBy("code", links.http_status(F.col("code")).alias("status")).agg(F.count("*").alias("n"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("v1.0..HEAD", "abc~5", "a b", "x;rm", "--all", "a..b..c"))), (F.col("event_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(text.alias("span")).groupBy("span").agg(F.count("*").alias("n")).withColumn("safe", F.col("span").rlike(changelog.RANGE))


def base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", pageindex.safe_base(F.col("url")).alias("safe"))


def changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of all commits put into a changelog that has entries, one that has none, and none at all."""
    entry = changelog.release(corpus(spark, sf_dir, "d_commits"), "2026-01-01")
    old = F.explode(F.array(F.lit("# Changelog\n\n## [1.0.0] - 2025-01-01\n\n- first\n\n## [0.9.0]\n"), F.lit("# Changelog\n\nNothing yet.\n"), F.lit(None).cast("string")))
    return entry.select("entry", old.alias("old")).select("old", changelog.inserted(F.col("old"), F.col("entry")).alias("new"))


def arrays(function):
    """A query whose arrays are joined to text, which both engines write alike."""
    return lambda df: function(df).select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in function(df).dtypes))


QUERIES = {
    "S_lines": on("d_docs", lines),
    "S06_excluded_files": on("d_files", coverage.excluded),
    "S12_safe_ranges": ranges,
    "L01_inline_links": on("d_docs", lambda d: links.inline(fenced(d).where("not inside"))),
    "L02_definitions": on("d_docs", links.definitions),
    "L03_reference_links": on("d_docs", lambda d: links.references(fenced(d).where("not inside"), links.definitions(d))),
    "L04_attribute_links": page_links,
    "L05_code_fences": on("d_docs", fenced),
    "L06_L07_links": on("d_docs", links.links),
    "L07_page_link_types": page_link_types,
    "L08_slugs": page_slugs,
    "L09_anchors": on("d_docs", links.anchors),
    "L10_missing_anchors": on("d_docs", links.missing_anchors),
    "L11_anchor_suggestions": on("d_docs", links.suggestions),
    "L12_L13_L14_L15_resolved": on("d_docs", links.resolved),
    "L16_http_status": statuses,
    "L18_missing_fragments": on("d_docs", links.missing_fragments),
    "L19_page_suggestions": on("d_docs", links.page_suggestions),
    "L20_orphans": on("d_docs", links.orphans),
    "L21_link_summary": on("d_docs", links.summary),
    "L22_request_budget": on("d_docs", links.budgeted),
    "L23_fixes": on("d_docs", links.fixes),
    "F01_changed_lines": on("d_diff", freshness.changed),
    "F02_F03_F08_defined": on("d_diff", freshness.defined),
    "F04_endpoints": on("d_diff", freshness.endpoints),
    "F05_environment": on("d_diff", freshness.environment),
    "F06_settings": on("d_diff", freshness.settings),
    "F07_algebra": on("d_diff", freshness.algebra),
    "F09_F10_tracked": on("d_diff", freshness.tracked),
    "F11_F12_F13_F14_mentions": on_two("d_docs", "d_diff", lambda d, x: freshness.mentions(d, freshness.tracked(x))),
    "F15_F16_stale": on_two("d_docs", "d_diff", freshness.stale),
    "F17_findings": on_two("d_docs", "d_diff", freshness.findings),
    "F18_summary": on_two("d_docs", "d_diff", freshness.summary),
    "X01_X10_items": on("d_files", coverage.items),
    "X11_X13_status": on_two("d_files", "d_docs", coverage.status),
    "X14_by_type": on_two("d_files", "d_docs", lambda f, d: coverage.by(f, d, "type")),
    "X15_by_directory": on_two("d_files", "d_docs", coverage.largest_directories),
    "X16_overall": on_two("d_files", "d_docs", coverage.overall),
    "X17_primary_language": on("d_files", coverage.primary_language),
    "X18_docs_kind": on("d_docs", coverage.docs_kind),
    "X19_X20_undocumented": on_two("d_files", "d_docs", coverage.undocumented),
    "X19_partial": on_two("d_files", "d_docs", coverage.partial),
    "X21_stubs": on_two("d_files", "d_docs", coverage.stubs),
    "C01_conventional": on("d_commits", changelog.conventional),
    "C02_C06_classified": on("d_commits", changelog.classified),
    "C07_C08_refs": on("d_commits", arrays(changelog.refs)),
    "C09_C10_entries": on("d_commits", changelog.entries),
    "C11_C13_sections": on("d_commits", changelog.markdown),
    "C13_inserted": changelogs,
    "C12_summary": on("d_commits", changelog.summary),
    "P01_P02_platforms": on("d_projects", lambda d: pageindex.platforms(d, "docs/site")),
    "P03_projects": on("d_projects", lambda d: pageindex.projects(d, "docs")),
    "P14_base_urls": base_urls,
    "P15_index_text": on("d_docs", lambda d: pageindex.index_text(d, "docs", BASE, "Parts", "All about parts")),
    "P15_full_blocks": on("d_docs", pageindex.full_blocks),
    "P04_P07_pages": on("d_docs", pageindex.pages),
    "P06_descriptions": descriptions,
    "P08_sections": page_sections,
    "P08_P11_index": on("d_docs", lambda d: pageindex.index(d, "docs", BASE)),
    "P12_P13_totals": on("d_docs", pageindex.totals),
    "P15_rendered": on("d_docs", lambda d: pageindex.rendered(d, "docs", BASE)),
    "T01_T02_banned": on("d_prose", rules.banned),
    "T03_T06_heuristics": on("d_prose", rules.heuristics),
    "T07_title_case": on("d_prose", rules.title_case),
    "T08_skipped_levels": on("d_docs", rules.skipped_levels),
    "T09_several_titles": on("d_prose", rules.several_titles),
    "T10_bare_fences": on("d_docs", rules.bare_fences),
    "T12_tables": on("d_prose", rules.tables),
    "T13_missing_sections": on("d_docs", rules.missing_sections),
    "T18_bare_code": on("d_prose", rules.bare_code),
    "T14_spelling": on("d_prose", rules.spelling),
    "T15_callouts": on("d_prose", rules.callouts),
    "T16_vague_links": on("d_prose", rules.vague_links),
    "T17_own_site_links": on("d_prose", lambda d: rules.own_site_links(d, "https://docs.example.com")),
    "T20_fixed": on("d_prose", rules.fixed),
    "T21_profile": on("d_prose", rules.profile),
    "T22_compliance": on("d_prose", rules.compliance),
    "M01_M04_terms": on("d_prose", rules.terms),
    "M05_verb_forms": on("d_prose", rules.verb_forms),
    "M06_hyphenation": on("d_prose", rules.hyphenation),
    "M08_element_terms": on("d_prose", rules.element_terms),
    "M09_plain_elements": on("d_prose", rules.plain_elements),
    "M13_undefined": on("d_prose", rules.undefined),
    "M14_M15_located": on("d_prose", rules.located),
    "M07_steps": on("d_prose", rules.steps),
    "M10_prohibited": on("d_prose", rules.prohibited),
    "M11_small_numbers": on("d_prose", rules.small_numbers),
    "M12_inconsistent": on("d_prose", rules.inconsistent),
    "M14_term_report": on("d_prose", rules.term_report),
    "M16_quick_checks": on("d_prose", rules.quick),
    "V03_by_category": on("d_findings", lambda d: review.by(d, "category")),
    "V03_by_file": on("d_findings", lambda d: review.by(d, "file")),
    "V04_patch": on("d_patch", review.patch),
}
