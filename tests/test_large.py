"""What keeps the queries in bounds when their tables grow: plans, spread rows, and searches in parts."""

import random
import time

from pyspark.sql import functions as F

from docpipe.functions.text import CUT, fenced, holding, normal_path
from docpipe.operators import coverage, freshness, links, rules
from docpipe.sources.corpora import corpus


def docs(spark, *contents):
    return spark.createDataFrame([(f"docs/p{i}.md", c) for i, c in enumerate(contents)], "path string, content string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_found_at_every_place_and_in_parts(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abé\U0001f600\n") for _ in range(r.choice((0, 5, 6, CUT - 1, CUT, CUT + 5, 3 * CUT, 1000)))) for _ in range(60)]
    terms = sorted({"".join(r.choice("abé\U0001f600\n") for _ in range(r.choice((6, 6, 7, 9)))) for _ in range(300)} | {t[k : k + 80] for t in texts for k in (0, 40) if len(t) > 500})
    wanted = sorted((t, x) for t in texts for x in terms if x in t)
    table = spark.createDataFrame([(x,) for x in terms], "term string")
    for most in (1000, 70):
        got = holding(spark.createDataFrame([(t,) for t in texts], "text string"), "text", table, "term", 6, most)
        assert "SortMergeJoin" not in plan(got) and sorted(map(tuple, got.collect())) == wanted
    assert len(wanted) > 100


def test_texts_are_neither_shuffled_nor_broadcast_for_terms(spark):
    pages = docs(spark, "`alpha_beta(x)` and alpha_beta")
    symbols = spark.createDataFrame([("alpha_beta", "high")], "symbol string, severity string")
    got = plan(freshness.mentions(pages, symbols))
    assert got.count("BroadcastHashJoin") == 1 and "BuildRight" in got and "hashpartitioning" not in got
    assert "Exchange" not in plan(holding(pages, "content", spark.createDataFrame([("alpha_beta",)], "term string"), "term")).replace("BroadcastExchange", "")


def test_sides_that_grow_are_not_broadcast(spark):
    pages = docs(spark, "# A\n[1](p1.md#b) [2](no.md) [3](#a) [x][r]\n[r]: https://a.b", "# B")
    for f in (links.links, links.resolved, links.missing_fragments, links.page_suggestions, links.orphans, links.missing_anchors, links.suggestions, links.fixes, links.summary, rules.compliance, rules.term_report):
        assert "BroadcastHashJoin" not in plan(f(pages)), f.__name__
    diff = spark.createDataFrame([("a.py", 1, "-def alpha_beta(x):")], "path string, line int, d string")
    assert plan(freshness.stale(pages, diff)).count("BroadcastHashJoin") == 1  # the symbols
    source = spark.createDataFrame([("a.py", "def alpha_beta(x):\n")], "path string, content string")
    assert plan(coverage.stubs(source, pages)).count("BroadcastHashJoin") == 1  # the terms found


def test_links_take_one_pass(spark):
    pages = docs(spark, "[A][] [b][C] [no][d] <a href='x'>\n[a]: one\n[c]: two\n[A]: three\n```\n[f](g)\n```", None)
    own = links.links(pages)
    assert "Exchange" not in plan(own) and plan(own).count("Generate ") == 2
    assert sorted((r.line, r.kind, r.ordinal, r.text, r.target) for r in own.collect()) == [(1, 1, 0, "A", "three"), (1, 1, 1, "b", "two"), (1, 2, 0, "", "x")]


def test_long_documents_without_fences(spark):
    began = time.time()
    assert fenced(docs(spark, "word\n" * 60_000)).agg(F.max("line"), F.count("*")).first()[:] == (60_001, 60_001)
    assert time.time() - began < 30


def test_rows_are_spread_before_they_become_text(spark):
    for name in ("d_docs", "d_prose", "d_files"):
        assert corpus(spark, "/root/testdata/sf0.1", name).rdd.getNumPartitions() == 3
    assert corpus(spark, "/root/testdata/sf0.1", "d_diff").rdd.getNumPartitions() == 2


def test_paths_without_dots(spark):
    cases = {"a/b": "a/b", "": "", "/": "", "a": "a", "/a": "a", "a/": "a", "a//b": "a/b", ".": "", "..a/.b/c..": "..a/.b/c..", "a/...": "a/...", "x/..": "", "../a": "../a"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", normal_path(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_term_rules_where_their_words_are_in_other_cases(spark):
    text = "The FRONT END app. A Back-End.\nUse api and apiKey, Postgres, two-factor authentication.\nCLICK HERE, in Step 3 steps"
    got = {(r.line, r.rule, r.found) for r in rules.findings(docs(spark, text)).collect()}
    assert got == {(1, "hyphenation", "front end"), (1, "hyphenation", "back-end"), (2, "term", "api"), (2, "term", "Postgres"), (3, "prohibited", "click here"), (3, "number", "steps")}
    # What removed code leaves together is looked at, too.
    assert {r.found for r in rules.bare_code(docs(spark, "go(`x`) but d.md")).collect()} == {"go()", "d.md"}
