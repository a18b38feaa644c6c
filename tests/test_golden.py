"""Small cases of behaviour that is easily got wrong, and sources from real folders and git."""

import subprocess

import pytest
from pyspark.sql import functions as F

from docpipe.functions.text import fenced, normal_path, slug
from docpipe.operators import changelog, coverage, freshness, links, pageindex, review, rules
from docpipe.sources import files


def docs(spark, *contents, path="docs/p{}.md"):
    return spark.createDataFrame([(path.format(i), c) for i, c in enumerate(contents)], "path string, content string")


def test_slugs(spark):
    cases = {"Set Up!": "set-up", "[T](#a) b": "t-b", "Über  uns": "über-uns", "a \U0001f600 b": "a-b", "--x--": "x", "C++ & D_e": "c-d_e"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", slug(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_fences(spark):
    text = "a\n```py\ncode\n~~~\nb\n  ```\nin\n"
    got = [(r.line, r.text, r.inside) for r in fenced(docs(spark, text)).orderBy("line").collect()]
    assert got == [(1, "a", False), (3, "code", True), (5, "b", False), (7, "in", True), (8, "", True)]


def test_links(spark):
    text = '[x](a_(b)) ![a](i.PNG "t") [y]( ) [z](tel:1) [R][] [q][no]\n<img src="p.gif">\n\n[r]: one\n[r]: two'
    got = {(r.text, r.target, r.type) for r in links.links(docs(spark, text)).collect()}
    assert got == {("x", "a_(b", "internal"), ("a", "i.PNG", "image"), ("z", "tel:1", "internal"), ("R", "two", "internal"), ("", "p.gif", "image")}


def test_paths_and_resolution(spark):
    cases = {"a/../b": "b", "../x": "../x", "a/./b//c": "a/b/c", "a/../../b": "../b"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", normal_path(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases
    pages = spark.createDataFrame([("d/a.md", "[1](b.md#x) [2](/d/b) [3](../../out) [4](no.md) [5](../d) [6](/e/)"), ("d/b.md", "# X"), ("e/index.mdx", "")], "path string, content string")
    got = {r.target: (r.resolved, r.status) for r in links.resolved(pages).collect()}
    assert got == {"b.md#x": ("d/b.md", "ok"), "/d/b": ("d/b.md", "ok"), "../../out": (None, "broken"), "no.md": (None, "broken"), "../d": ("d", "ok"), "/e/": ("e/index.mdx", "ok")}


def test_exports(spark):
    ts = "/** one line */\nexport function alpha() {\n/**\n * Does.\n */\nexport class Beta {\nmodule.exports.gamma = function () {\nexport const delta: T = 1\nrouter.get('/users', h)\nexport const Nope = 1\n"
    got = {(r.name, r.type, r.has_inline_docs) for r in coverage.items(docs(spark, ts, path="s{}.tsx")).collect()}
    assert got == {("alpha", "function", False), ("Beta", "class", True), ("gamma", "module_exports_fn", False), ("gamma", "module_exports_val", False), ("GET /users", "endpoint", False), ("Nope", "component", False)}
    skipped = spark.createDataFrame([("a/latest_x.py", ""), ("mysetup.py", ""), ("a.test.ts", ""), ("b.d.ts", ""), ("fine.ts", "")], "path string, content string")
    assert {r.path for r in coverage.excluded(skipped).collect()} == {"a/latest_x.py", "mysetup.py", "a.test.ts", "b.d.ts"}


def test_settings_and_signs(spark):
    diff = spark.createDataFrame([("a.py", 1, '+x = config["timeout_ms"]'), ("a.py", 2, "--- x"), ("a.py", 3, "-y = os.environ['NOT_FOUND']"), ("a.py", 4, "+z = os.getenv('FOUND_ONE')")], "path string, line int, d string")
    assert [r.name for r in freshness.settings(diff).collect()] == ["timeout_ms"]
    assert [r.name for r in freshness.environment(diff).collect()] == ["FOUND_ONE"]
    assert freshness.changed(diff).count() == 3


@pytest.mark.parametrize(
    ("subject", "body", "category"),
    [
        ("remove vulnerability", "", "Removed"), ("patch CVE-2024-1", "", "Security"), ("added x", "", "Changed"), ("chore!: drop", "", "Breaking Changes"), ("docs: x", "BREAKING CHANGE: y", "Breaking Changes"),
        ("weird: add", "", "Changed"), ("AB-1: add x", "", "Added"), ("breaking change in api", "", "Breaking Changes"), ("ci: x", "", "skip"),
    ],
)
def test_categories(spark, subject, body, category):
    commit = spark.createDataFrame([(0, "h", "a", subject, body)], "pos int, hash string, author string, subject string, body string")
    assert changelog.classified(commit).first().category == category


def test_refs(spark):
    commit = spark.createDataFrame([(0, "h", "a", "x (#1) #2", "fixed #3 fixes #4\nMerge pull request #5")], "pos int, hash string, author string, subject string, body string")
    r = changelog.refs(commit).first()
    assert (r.prs, r.issues) == (["2", "3", "4", "5"], ["4"])


def test_page_fields(spark):
    got = {r.path: r for r in pageindex.index(docs(spark, "---\ntitle: 'A b'\n---\n# H\n" + "long enough to describe it", "no heading", path="docs/01-api/{}-x_y.md"), "docs", "https://e.org").collect()}
    a, b = got["docs/01-api/0-x_y.md"], got["docs/01-api/1-x_y.md"]
    assert (a.title, a.description, a.url, a.section) == ("A b", "long enough to describe it", "https://e.org/api/x_y", "Docs")
    assert (b.title, b.description) == ("1 X Y", "")


def test_terms_longest_wins(spark):
    text = "Use two-factor authentication.\nUse two-factor only.\n```\nnodejs Github\n```\n"
    assert [(r.line, r.found) for r in rules.terms(docs(spark, text)).collect()] == [(2, "two-factor")]


def test_unreadable_finding(spark):
    got = review.findings(spark.createDataFrame([("not json",), ('{"category":"c","line":3}',)], "line string")).collect()
    assert [(r.category, r.line) for r in got] == [(None, None), ("c", 3)]


def test_folders(spark, tmp_path):
    (tmp_path / "docs" / "node_modules").mkdir(parents=True)
    (tmp_path / "docs" / "a b.md").write_bytes(b"x\r\ny\xff")
    (tmp_path / "docs" / "node_modules" / "b.md").write_text("no")
    (tmp_path / "docs" / "c.txt").write_text("no")
    (tmp_path / "m.py").write_text("def run_it(x):\n")
    rows, capped = files.documents(spark, str(tmp_path), 1)
    got = rows.collect()
    assert [(r.path, r.content, r.size) for r in got] == [("docs/a b.md", "x\ny�", 5)] and capped
    assert files.first_documents(spark, str(tmp_path)).first().path == "docs/a b.md"
    assert files.sources(spark, str(tmp_path))[0].first().path == "m.py"
    assert files.inside(str(tmp_path), "docs") and not files.inside(str(tmp_path), "../x")


def test_git(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *args], check=True, capture_output=True)

    git("init", "-q")
    for k, text in enumerate(("def alpha_one(x):\n", "def beta_two(x):\n")):
        (tmp_path / "a.py").write_text(text)
        git("add", ".")
        git("commit", "-qm", f"feat: number {k}", "-m", "fixes #7")
    log = files.commits(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.subject, r.body, len(r.hash)) for r in log] == [("feat: number 1", "fixes #7", 8), ("feat: number 0", "fixes #7", 8)]
    change = {r.symbol: r.change for r in freshness.algebra(files.diff(spark, str(tmp_path), "HEAD~1..HEAD")).collect()}
    assert change == {"alpha_one": "removed", "beta_two": "added"}
    assert files.changelog_range(str(tmp_path), None) is None and files.changelog_range(str(tmp_path), "a..b") == "a..b"
    assert files.freshness_range(str(tmp_path), "x") == "x~1..x"
    with pytest.raises(ValueError, match="range"):
        files.commits(spark, str(tmp_path), "a b; rm")


def site(spark, **pages):
    """Pages by name: a__b is docs/a/b.md."""
    return spark.createDataFrame([("docs/" + k.replace("__", "/") + ".md" if k != "top" else "b.md", v) for k, v in pages.items()], "path string, content string")


def test_fallback_begins_at_the_root_and_has_no_anchors(spark):
    pages = site(spark, a="[1](b) [2](b#zz) [3](/b#zz) [4](c.md#zz) [5](c.md#here) [6](/docs/c#here) [7](./b)", c="# Here", top="# B")
    got = {r.target: (r.resolved, r.fallback) for r in links.resolved(pages).collect()}
    assert got == {"b": ("b.md", True), "b#zz": ("b.md", True), "/b#zz": ("b.md", False), "c.md#zz": ("docs/c.md", False), "c.md#here": ("docs/c.md", False), "/docs/c#here": ("docs/c.md", False), "./b": ("b.md", True)}
    assert {r.target for r in links.missing_fragments(pages).collect()} == {"/b#zz", "c.md#zz"}


def test_routes_are_no_paths_of_pages(spark):
    pages = site(spark, a="[1](/c.md) [2](d.md)", c="x", d="[a](a.md)")
    assert {r.path for r in links.orphans(pages).collect()} == {"docs/c.md"}


def test_summary_counts_images_fragments_and_what_is_asked(spark):
    pages = site(spark, a="![x](no.png) [1](c.md#zz) [2](#none) [3](c.md) <a href='https://a.b/'> [4](https://c.d) [5](https://e.f) [6](mailto:a@b.c)", c="# C")
    plain = links.summary(pages).first()
    assert (plain.total, plain.image, plain.broken_internal, plain.ok, plain.redirects, plain.has_broken) == (8, 1, 3, 4, 0, True)
    asked = spark.createDataFrame([("https://a.b/", "broken"), ("https://c.d", "redirect"), ("https://e.f", "indeterminate")], "target string, status string")
    out = links.summary(pages, asked).first()
    assert (out.ok, out.broken_external, out.redirects) == (1, 1, 1)
    fine = links.summary(site(spark, a="[c](c.md)", c="x")).first()
    assert (fine.ok, fine.has_broken) == (1, False)


def test_fixes(spark):
    pages = site(spark, a="[1](gui__de.md#x) [2](guides.md#x) [3](#set-up-old)\n## Set up now", guide="x")
    assert {(r.target, r.proposed) for r in links.fixes(pages).collect()} == {("guides.md#x", "guide.md#x"), ("gui__de.md#x", "guide.md#x"), ("#set-up-old", "#set-up-now")}


def test_budget(spark):
    pages = site(spark, a="[1](https://a.b) [2](https://c.d)", b="[1](https://e.f)")
    assert {(r.target, r.checked) for r in links.budgeted(pages, 2).collect()} == {("https://a.b", True), ("https://c.d", True), ("https://e.f", False)}
    assert links.budgeted(site(spark, a="none")).count() == 0


def test_status_without_documents(spark):
    source = spark.createDataFrame([("a.py", 'def alpha_beta(x):\n    """Does."""\ndef tiny(x):\n')], "path string, content string")
    none = spark.createDataFrame([], "path string, content string")
    assert {(r.name, r.status) for r in coverage.status(source, none).collect()} == {("alpha_beta", "undocumented"), ("tiny", "undocumented")}
    assert {(r.name, r.status) for r in coverage.status(source, docs(spark, "no names")).collect()} == {("alpha_beta", "partial"), ("tiny", "skipped")}
    assert [(r.name, r.reason) for r in coverage.partial(source, docs(spark, "no names")).collect()] == [("alpha_beta", "Has inline docs but no page of its own")]


def test_kind_of_documents(spark):
    assert coverage.docs_kind(docs(spark, "The API  Reference")).first().kind == "api_reference"
    assert coverage.docs_kind(docs(spark, "The API\nreference")).first().kind == "api_reference"
    assert coverage.docs_kind(docs(spark, "`a\nb()` " * 21)).first().kind == "api_reference"
    assert coverage.docs_kind(docs(spark, "`a()` " * 20)).first().kind == "product_docs"


def test_pruned_folders_and_extensions(spark, tmp_path):
    for name in ("src/a.py", "src/tests/b.py", "fixtures/c.py", "migrations/d.py", "coverage/e.py", "spec/f.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path for r in files.sources(spark, str(tmp_path))[0].collect()] == ["src/a.py"]
    assert ".php" not in files.CHANGED and len(files.CHANGED) == 16
    (tmp_path / "docs" / "dist").mkdir(parents=True)
    (tmp_path / "docs" / "dist" / "no.md").write_text("x")
    (tmp_path / "content").mkdir()
    (tmp_path / "content" / "yes.md").write_text("x")
    assert [r.path for r in files.first_documents(spark, str(tmp_path)).collect()] == ["content/yes.md"]


def test_review_modes(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("a/x.md", "a/b/y.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert review.mode(["a/x.md", "a/b/y.md"], True) == ("files", "jsonl", str(tmp_path / "a"))
    assert review.mode(["a/x.md"], True) == ("files", "jsonl", str(tmp_path / "a"))
    assert review.mode(["a"], True) == ("git_changes", "patch", "a") and review.mode(["a"], False) == ("full", "jsonl", "a")
    (tmp_path / "own.json").write_text('{"contentDirectory": ["docs", "more"]}')
    assert review.mode([], False, "own.json") == ("full", "jsonl", "docs") and review.mode(["gone"], False) == ("full", "jsonl", ".")
    (tmp_path / "own.json").write_text('{"contentDirectory": "text"}')
    assert review.content_directory([], "own.json") == "text"
    (tmp_path / "own.json").write_text("not json")
    assert review.content_directory([], "own.json") == "."


def test_projects(spark):
    rows = [
        ("p", "README.md", "# Name \nshort\n---long but a rule, so it is not it\nA description that is long."), ("p", "package.json", '{"name": "n", "homepage": "https://h"}'), ("q", "docs/README.md", "# Docs"), ("q", "mkdocs.yml", "site_url: 'https://q.org/'"),
        ("r", "package.json", "{}"), ("s", "docs/astro.config.mjs", "title: 'Site', site: 'https://s.org//'"), ("s", "package.json", '{"name": "pkg", "description": "d"}'), ("t", "docs/mint.json", '{"url": "https://t.org"}'), ("t", "mint.json", "{}"),
    ]
    own = spark.createDataFrame(rows, "project string, path string, content string")
    assert {(r.project, r.name, r.description, r.url) for r in pageindex.projects(own, "docs").collect()} == {
        ("p", "Name", "A description that is long.", "https://h"), ("q", "Docs", "", ""), ("r", "r", "", ""), ("s", "Site", "d", ""), ("t", "t", "", "")
    }
    assert {(r.project, r.platform, r.path, r.base_url) for r in pageindex.platforms(own, "docs").collect()} == {
        ("q", "mkdocs", "mkdocs.yml", "https://q.org"), ("s", "astro_starlight", "docs/astro.config.mjs", "https://s.org"), ("t", "mintlify", "mint.json", None)
    }


def test_rules_of_terms(spark):
    text = "The front end app needs the back-end.\nThe front end is fine, as back-end code is.\n1. Press Save in 3 steps with the SLA.\nUse the api-key. Click the Save button.\nUse the api-key, and the SLA."
    got = {(r.rule, r.severity, r.found, r.locations) for r in rules.located(docs(spark, text)).collect()}
    assert got == {
        ("hyphenation", "warning", "front end", "line 1"), ("hyphenation", "warning", "back-end", "line 1"), ("action_verb", "warning", "press", "line 3"), ("number", "info", "steps", "line 3"), ("term", "error", "api-key", "line 4, line 5"), ("element", "info", "Save", "line 4")
    }
    assert [(r.term, r.first_use) for r in rules.undefined(docs(spark, text)).collect()] == [("SLA", 3)]
    out = rules.term_report(docs(spark, text, None, "fine")).orderBy("path").collect()
    assert [(r.errors, r.warnings, r.infos, r.compliant) for r in out] == [(2, 3, 3, False), (0, 0, 0, True), (0, 0, 0, True)]


def test_rules_of_style(spark):
    text = "# Use The API Key\nIn order to run `a.py` or b.py, call go() in [c](d.md), not Node.js.\nPlease note that it is easy."
    assert {r.found for r in rules.bare_code(docs(spark, text)).collect()} == {"b.py", "go()"}
    assert [r.fixed for r in rules.fixed(docs(spark, text)).orderBy("line").collect()] == ["# Use the API key", "To run `a.py` or b.py, call go() in [c](d.md), not Node.js.", "it is easy."]
    kinds = spark.createDataFrame([("docs/tutorials/a.md", "# Introduction\n## Before you start\n## Steps\n"), ("docs/x.md", "x"), ("docs/api/b.md", None)], "path string, content string")
    assert {(r.path, r.section) for r in rules.missing_sections(kinds).collect()} == {("docs/tutorials/a.md", "summary")} | {("docs/api/b.md", s) for s in ("description", "syntax", "parameters", "return value", "examples", "related")}
    assert [r.tables for r in rules.tables(docs(spark, "| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n")).collect()] == [1]


def test_null_content_gives_no_rows(spark):
    empty = spark.createDataFrame([("docs/a.md", None), ("docs/b.md", "")], "path string, content string")
    for f in (links.links, links.resolved, links.anchors, links.fixes, rules.findings, rules.bare_code, rules.headings, rules.banned, rules.several_titles):
        assert f(empty).count() == 0
    assert {(r.path, r.high, r.compliant) for r in rules.compliance(empty).collect()} == {("docs/a.md", 0, True), ("docs/b.md", 0, True)}
    assert links.orphans(empty).count() == 2 and links.summary(empty).first().total == 0


def test_changelog_is_inserted(spark):
    old = spark.createDataFrame([("# C\n\n## [1.0]\n- x\n",), ("# C\n",), (None,)], "t string")
    a, b, c = (r[0] for r in old.select(changelog.inserted(F.col("t"), F.lit("## [Unreleased]"))).collect())
    assert (a, b) == ("# C\n\n## [Unreleased]\n\n## [1.0]\n- x\n", "# C\n\n## [Unreleased]\n") and c == changelog.HEADER + "\n## [Unreleased]\n"
