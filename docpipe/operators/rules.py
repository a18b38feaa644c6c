"""Style and terminology: rules are rows, so that users add their own; lines outside code fences are searched.

The severity of a rule follows the rules' own tables. What needs judgement (active voice, tense, verb first) is a heuristic
and says so by needs_review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fenced
from .links import INLINE

BANNED = [
    "simply", "just", "easy", "easily", "obviously", "basically", "please note that", "in order to", "it should be noted", "as mentioned above", "as mentioned below", "etc.", "and so on", "a number of",
    "in this document we will", "this section describes", "click here", "it's worth mentioning", "we are happy to announce", "in this section we will",
]
HEURISTICS = [
    ("active_voice", r"(?i)(^|[^\p{L}])(is|are|was|were|be|been|being) [a-z]+(ed|en)([^\p{L}]|$)", "high", True),
    ("second_person", r"(^|[^\p{L}])([Uu]sers can|[Oo]ne can)([^\p{L}]|$)", "high", False),
    ("present_tense", r"(?i)(^|[^\p{L}])(will|would) [a-z]", "high", True),
    ("verb_first", r"^\s*[0-9]+\. (The|A|An|You|This|It)\s", "high", True),
]
SPELLING = [("colour", "color"), ("authorise", "authorize"), ("centre", "center"), ("analyse", "analyze")]
CALLOUTS = ["Note", "Tip", "Important", "Warning", "Caution"]
#: Term, variants that aren't right. Product names of one's own are added as rows.
TERMS = [
    ("API", ["Api", "api"]), ("CLI", ["Cli", "cli"]), ("SDK", ["Sdk", "sdk"]), ("UI", ["Ui", "ui"]), ("URL", ["Url", "url"]), ("JSON", ["Json", "json"]), ("YAML", ["Yaml", "yaml"]), ("HTML", ["Html", "html"]), ("CSS", ["Css", "css"]),
    ("API key", ["api-key", "API Key", "Api Key"]), ("access token", ["Access Token", "accesstoken"]), ("OAuth", ["Oauth", "oauth", "OAUTH"]), ("SSO", ["Sso", "sso"]), ("2FA", ["2fa", "two-factor"]), ("two-factor authentication", ["Two-Factor Authentication"]),
    ("JavaScript", ["Javascript", "javascript"]), ("TypeScript", ["Typescript", "typescript"]), ("Node.js", ["NodeJS", "Nodejs", "node.js"]), ("npm", ["NPM", "Npm"]), ("React", ["react", "REACT"]), ("REST", ["Rest", "rest"]), ("GraphQL", ["Graphql", "graphQL"]),
    ("PostgreSQL", ["Postgres", "postgres", "POSTGRESQL"]), ("MongoDB", ["Mongodb", "mongoDB"]), ("Redis", ["redis", "REDIS"]), ("GitHub", ["Github", "github"]), ("GitLab", ["Gitlab", "gitlab"]), ("VS Code", ["VSCode", "vscode"]),
    ("Kubernetes", ["kubernetes", "K8s"]), ("Docker", ["docker", "DOCKER"]), ("AWS", ["Aws", "aws"]), ("macOS", ["MacOS", "MacOs", "macos"]), ("Linux", ["linux", "LINUX"]), ("Windows", ["windows", "WINDOWS"]),
]
PROHIBITED = [("click here", "descriptive link text"), ("above", "a link to the section"), ("below", "a link to the section"), ("he/she", "they"), ("his/her", "their"), ("blacklist", "blocklist"), ("whitelist", "allowlist"), ("master/slave", "primary/replica"), ("sanity check", "quick check"), ("dummy", "placeholder")]
VERB_FORMS = [("setup", "set up"), ("login", "log in"), ("signup", "sign up"), ("checkout", "check out"), ("backup", "back up"), ("startup", "start up")]
COMPOUNDS = ["front end", "back end", "real time", "open source", "command line", "end user"]
#: What may follow a compound that is a noun.
AFTER_NOUN = ["is", "are", "was", "were", "of", "and", "or", "for", "to", "in", "on", "with", "that", "which", "can", "will", "has", "have", "by", "from", "as", "at", "but", "must", "should", "may"]
#: Element, and what it is called.
ELEMENTS = [
    ("clickable text", "link"), ("action button", "button"), ("options list", "dropdown"), ("text entry", "field"), ("on/off control", "toggle"), ("multiple selection", "checkbox"), ("single selection", "radio button"),
    ("navigation section", "tab"), ("popup window", "dialog"), ("side section", "sidebar"), ("top section", "header"), ("main content", "page"),
]
CALL = r"([A-Za-z_][A-Za-z0-9_]*\(\))"
ENDING = r"\.(?:yaml|yml|json|js|ts|py|go|md|toml|txt|sh|css|html)"
FILE = r"(?:^|[^A-Za-z0-9_./-])([A-Za-z0-9_-]+" + ENDING + ")(?:[^A-Za-z0-9_]|$)"
PLAIN_ELEMENT = r"(?:[Cc]lick|[Ss]elect|[Ee]nable|[Oo]pen) the ([A-Z][A-Za-z]*(?: [A-Za-z]+)?) (link|button|dropdown|field|toggle|checkbox|radio button|tab|dialog|sidebar|header|page)"
#: Kind of page, by its path, and the sections that it needs, each under one of several words.
KINDS = [("tutorial", "/tutorials?/"), ("how-to", "/how-?to/|/guides?/"), ("reference", "/reference/|/api/"), ("explanation", "/explanations?/|/concepts?/|/intro/")]
REQUIRED = [
    ("tutorial", "introduction", "introduction|overview|what you"), ("tutorial", "prerequisites", "prerequisite|before you"), ("tutorial", "steps", "step|set up"), ("tutorial", "summary", "summary|next steps"),
    ("how-to", "goal", "goal|overview|introduction"), ("how-to", "prerequisites", "prerequisite|before you"), ("how-to", "steps", "step|set up"), ("how-to", "verification", "verif|check"),
    ("reference", "description", "overview|description|details"), ("reference", "syntax", "syntax"), ("reference", "parameters", "parameter|argument|option"), ("reference", "return value", "return"), ("reference", "examples", "example"), ("reference", "related", "related|see also"),
    ("explanation", "context", "context|introduction|overview"), ("explanation", "core concept", "concept"), ("explanation", "how it works", "how it works|details"), ("explanation", "implications", "implication|trade-off"), ("explanation", "related", "related|see also"),
]
TABLE = r"(?dm)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$"
ACRONYM = "^[A-Z]{2,}s?$"
AVOIDED = [("make", "create"), ("add", "create"), ("generate", "create"), ("remove", "delete"), ("begin", "start"), ("initiate", "start"), ("launch", "start"), ("end", "stop"), ("terminate", "stop"), ("kill", "stop"), ("choose", "select"), ("pick", "select"), ("type", "enter"), ("input", "enter"), ("press", "click"), ("hit", "click"), ("tap", "click"), ("activate", "enable"), ("deactivate", "disable")]
KNOWN = [t for t, _ in TERMS]
QUICK = [("API key", "api-key|API Key|Api Key"), ("Node.js", r"NodeJS|node\.js|Nodejs"), ("link text", "click here"), ("blocklist", "blacklist|whitelist")]


def prose(docs: DataFrame) -> DataFrame:
    """path, line, text: lines outside code fences."""
    return fenced(docs).where("not inside").select("path", "line", "text")


def folded(docs: DataFrame) -> DataFrame:
    """prose with low, the text in lower case, which is made once for all rules."""
    return prose(docs).withColumn("low", F.lower("text"))


def held(text: Column, rows: list[tuple]) -> Column:
    """Those of a rule table's rows (word, suggestion) whose word a line holds as a word. One pass inside the row, without a join. For any case text is a line in lower case."""
    bound = lambda w: r"(?<![\p{L}\p{N}_])\Q" + w + r"\E(?![\p{L}\p{N}_])"
    table = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(x).alias("suggestion"), F.lit(bound(w)).alias("bound")) for w, x in rows))
    return F.filter(table, lambda r: text.contains(r["word"]) & F.rlike(text, r["bound"]))


def _matched(docs: DataFrame, rows: list[tuple], fold: bool) -> DataFrame:
    """path, line, word, suggestion."""
    return folded(docs).select("path", "line", F.explode(held(F.col("low" if fold else "text"), rows)).alias("x")).select("path", "line", "x.word", "x.suggestion")


def banned(docs: DataFrame) -> DataFrame:
    """path, line, phrase: banned phrases as words, in any case."""
    return _matched(docs, [(b, "") for b in BANNED], True).select("path", "line", F.col("word").alias("phrase"))


def alarms(text: Column) -> Column:
    """The heuristics that a line meets."""
    every = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(r).alias("needs_review"), text.rlike(p).alias("hit")) for n, p, s, r in HEURISTICS))
    return F.filter(every, lambda x: x["hit"])


def heuristics(docs: DataFrame) -> DataFrame:
    """path, line, rule, severity, needs_review: voice, person, tense and steps."""
    return prose(docs).select("path", "line", F.explode(alarms(F.col("text"))).alias("x")).select("path", "line", "x.rule", "x.severity", "x.needs_review")


def headings(docs: DataFrame) -> DataFrame:
    """path, line, level, title."""
    pattern = r"^(#{1,6})\s+(.+)$"
    return prose(docs).where(F.col("text").rlike(pattern)).select("path", "line", F.length(F.regexp_extract("text", pattern, 1)).alias("level"), F.trim(F.regexp_extract("text", pattern, 2)).alias("title"))


def capitals(title: Column) -> Column:
    """The capitalised words of a title after the first that aren't acronyms or known terms."""
    return F.filter(F.split(title, r"\s+"), lambda w, i: (i > 0) & w.rlike(r"^[A-Z][a-z]") & ~w.isin(KNOWN))


def title_case(docs: DataFrame) -> DataFrame:
    """Headings with capitalised words after the first that aren't acronyms or known terms."""
    return headings(docs).withColumn("n", F.size(capitals(F.col("title")))).where("n > 0").select("path", "line", "title", "n")


def skipped_levels(docs: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    before = F.lag("level").over(Window.partitionBy("path").orderBy("line"))
    return headings(docs).withColumn("before", before).where("level - before > 1").select("path", "line", "before", "level")


def several_titles(docs: DataFrame) -> DataFrame:
    """Documents with more than one first-level heading."""
    return headings(docs).where("level = 1").groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def docs_bare() -> Column:
    """How many opening code fences of a document name no language."""
    marks = F.regexp_extract_all("content", F.lit(r"(?dm)^[ \t]*(?:```|~~~)([^\n]*)"), F.lit(1))
    return F.size(F.filter(marks, lambda x, i: (i % 2 == 0) & (F.trim(x) == "")))


def bare_fences(docs: DataFrame) -> DataFrame:
    """path, n: opening code fences that name no language."""
    return docs.select("path", docs_bare().alias("n")).where("n > 0")


def spelling(docs: DataFrame) -> DataFrame:
    """British spellings: path, line, found, suggestion."""
    return _matched(docs, SPELLING, True).select("path", "line", F.col("word").alias("found"), "suggestion")


def callouts(docs: DataFrame) -> DataFrame:
    """Callouts of an unknown kind."""
    return prose(docs).withColumn("kind", F.regexp_extract("text", r"^>\s*\*\*([A-Za-z]+)\*?\*?:", 1)).where((F.col("kind") != "") & ~F.col("kind").isin(CALLOUTS)).select("path", "line", "kind")


def vague_links(docs: DataFrame) -> DataFrame:
    """Links whose text is click here, here or the like."""
    text = prose(docs).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(INLINE), F.lit(1))).alias("link"))
    return text.where(F.lower(F.trim("link")).isin("click here", "here", "this link", "this page"))


def own_site_links(docs: DataFrame, base: str) -> DataFrame:
    """Links to the documents' own site that should be relative."""
    return prose(docs).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(INLINE), F.lit(2))).alias("target")).where(F.col("target").startswith(base))


def fixed(docs: DataFrame) -> DataFrame:
    """path, line, fixed: lines that the automatic fixes change: wordy phrases, and headings in title case."""
    x = F.regexp_replace("text", r"(?<![\p{L}])In order to ", "To ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<![\p{L}])in order to ", "to "), r"(?i)please note that ", "")
    mark = F.regexp_extract("x", r"^#{1,6}\s+", 0)
    words = F.transform(F.split(F.expr("substr(x, length(regexp_extract(x, '^#{1,6}\\\\s+', 0)) + 1)"), " "), lambda w, i: F.when((i > 0) & w.rlike("^[A-Z][a-z]") & ~w.isin(KNOWN), F.lower(w)).otherwise(w))
    own = prose(docs).withColumn("x", x).withColumn("fixed", F.when(mark != "", F.concat(mark, F.array_join(words, " "))).otherwise(F.col("x")))
    return own.where("fixed <> text").select("path", "line", "fixed")


def tables(docs: DataFrame) -> DataFrame:
    """path, tables: how many tables a document has."""
    return docs.select("path", F.size(F.regexp_extract_all("content", F.lit(TABLE), F.lit(0))).alias("tables")).where("tables > 0")


def kind_of(path: Column) -> Column:
    """tutorial, how-to, reference or explanation by the path; null for others."""
    own = F.concat(F.lit("/"), F.lower(path))
    out = F.when(own.rlike(KINDS[0][1]), KINDS[0][0])
    for name, pattern in KINDS[1:]:
        out = out.when(own.rlike(pattern), name)
    return out


def missing_sections(docs: DataFrame) -> DataFrame:
    """path, kind, section: sections that a page of its kind needs and that none of its headings names."""
    titles = headings(docs).groupBy("path").agg(F.collect_list(F.lower("title")).alias("titles"))
    own = docs.select("path", kind_of(F.col("path")).alias("kind")).where("kind is not null").join(titles.hint("merge"), "path", "left")
    need = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("section"), F.lit(p).alias("pattern")) for k, n, p in REQUIRED))
    none = F.array().cast("array<string>")
    gone = F.filter(need, lambda r: (r["kind"] == F.col("kind")) & ~F.exists(F.coalesce("titles", none), lambda t: F.rlike(t, r["pattern"])))
    return own.select("path", "kind", F.explode(F.transform(gone, lambda r: r["section"])).alias("section"))


def bare_code(docs: DataFrame) -> DataFrame:
    """path, line, found: function and file names outside backticks; known terms and link targets aren't names of files."""
    plain = F.regexp_replace(F.regexp_replace("text", "`[^`]*`", ""), r"\]\([^)]*\)", "]")
    own = prose(docs).where(F.col("text").contains("(") | F.col("text").contains(".")).select("path", "line", plain.alias("plain"))
    none = F.array().cast("array<string>")
    calls = F.when(F.col("plain").contains("()"), F.regexp_extract_all("plain", F.lit(CALL), F.lit(1))).otherwise(none)
    names = F.when(F.col("plain").rlike(ENDING), F.regexp_extract_all("plain", F.lit(FILE), F.lit(1))).otherwise(none)
    return own.select("path", "line", F.explode(F.concat(calls, names)).alias("found")).where(~F.col("found").isin(KNOWN))


def violations(docs: DataFrame) -> DataFrame:
    """path, rule, severity: one row for each violation of a style rule."""
    one = lambda df, rule, severity: df.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    out = one(banned(docs), "banned_phrase", "high").union(heuristics(docs).select("path", "rule", "severity"))
    for df, rule, severity in (
        (title_case(docs), "sentence_case", "medium"), (skipped_levels(docs), "heading_levels", "medium"), (several_titles(docs), "one_title", "medium"), (bare_fences(docs), "code_language", "medium"),
        (spelling(docs), "spelling", "low"), (callouts(docs), "callout", "low"), (vague_links(docs), "link_text", "high"), (missing_sections(docs), "sections", "medium"),
    ):
        out = out.union(one(df, rule, severity))
    return out


def compliance(docs: DataFrame) -> DataFrame:
    """path, high, medium, low, compliant: all documents. One pass over the lines, and one over documents for what isn't a line's."""
    text = F.col("text")
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 1))
    title = F.trim(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 2))
    vague = F.filter(F.regexp_extract_all("text", F.lit(INLINE), F.lit(1)), lambda x: F.lower(F.trim(x)).isin("click here", "here", "this link", "this page"))
    kind = F.regexp_extract("text", r"^>\s*\*\*([A-Za-z]+)\*?\*?:", 1)
    lines = folded(docs).select(
        "path", "line", level.alias("level"),
        (F.size(held(F.col("low"), [(b, "") for b in BANNED])) + F.size(F.filter(alarms(text), lambda x: x["severity"] == "high")) + F.size(vague)).alias("high"),
        (F.when((level > 0) & (F.size(capitals(title)) > 0), 1).otherwise(0) + F.size(F.filter(alarms(text), lambda x: x["severity"] == "medium"))).alias("medium"),
        (F.size(held(F.col("low"), SPELLING)) + F.when((kind != "") & ~kind.isin(CALLOUTS), 1).otherwise(0)).alias("low"),
    )
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") > 0, F.struct("line", "level")))), lambda x: x["level"])
    own = lines.groupBy("path").agg(F.sum("high").alias("high"), F.sum("medium").alias("m"), F.sum("low").alias("low"), heads.alias("heads"))
    skipped = F.size(F.filter(F.transform("heads", lambda x, i: x - F.coalesce(F.get("heads", i - 1), x)), lambda d: d > 1))
    several = F.when(F.size(F.filter("heads", lambda x: x == 1)) > 1, 1).otherwise(0)
    bare = F.when(docs_bare() > 0, 1).otherwise(0)
    lost = missing_sections(docs).groupBy("path").agg(F.count("*").alias("lost"))
    out = docs.select("path", bare.alias("bare")).join(own.withColumn("m", F.col("m") + skipped + several).drop("heads").hint("merge"), "path", "left").join(lost.hint("merge"), "path", "left").na.fill(0)
    out = out.select("path", "high", (F.col("m") + F.col("bare") + F.col("lost")).alias("medium"), "low")
    return out.withColumn("compliant", (F.col("high") == 0) & (F.col("medium") == 0))


def profile(docs: DataFrame) -> DataFrame:
    """path and counts of second_person, third_person, numbered, bulleted, indented lines, titles, title_case, fences; and what they say: person, list_style, heading_style, code_block_style."""
    level = F.col("text").rlike(r"^#{1,6}\s+.+$")
    title = F.trim(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 2))
    n = prose(docs).groupBy("path").agg(
        F.count_if(F.col("text").rlike(r"(?i)(^|[^\p{L}])your?([^\p{L}]|$)")).alias("second_person"), F.count_if(F.col("text").rlike(r"(?i)(^|[^\p{L}])(users?|one|they)([^\p{L}]|$)")).alias("third_person"),
        F.count_if(F.col("text").rlike(r"^\s*[0-9]+\. ")).alias("numbered"), F.count_if(F.col("text").rlike(r"^\s*[-*+] ")).alias("bulleted"), F.count_if(F.col("text").rlike(r"^    \S")).alias("indented"),
        F.count_if(level).alias("titles"), F.count_if(level & (F.size(capitals(title)) > 0)).alias("title_case"),
    )
    marks = docs.select("path", F.floor((F.size(F.regexp_extract_all("content", F.lit(r"(?dm)^[ \t]*(?:```|~~~)"), F.lit(0))) + 1) / 2).cast("int").alias("fences"))
    both = lambda a, b, x, y, z: F.when((F.col(a) > 0) & (F.col(b) > 0), z).when(F.col(a) > 0, x).when(F.col(b) > 0, y)
    return n.join(marks.hint("merge"), "path").select(
        "*", both("second_person", "third_person", "second", "third", "mixed").alias("person"), both("bulleted", "numbered", "bullets", "numbers", "both").alias("list_style"),
        F.when(F.col("titles") > 0, F.when(2 * F.col("title_case") > F.col("titles"), "title").otherwise("sentence")).alias("heading_style"), F.when(F.col("fences") > 0, "fenced").when(F.col("indented") > 0, "indented").alias("code_block_style"),
    )


VARIANTS = [(v, t) for t, own in TERMS for v in own]
#: Terms and their variants, each with its term.
SPELT = [(v, t) for t, own in TERMS for v in [t, *own]]


def wrong(spelt: Column) -> Column:
    """Of the terms and variants that a line holds, in their exact case, those that aren't right, but those within a longer one."""
    return F.filter(spelt, lambda h: (h["word"] != h["suggestion"]) & ~F.exists(spelt, lambda g: g["word"].contains(h["word"]) & (F.length(g["word"]) > F.length(h["word"]))))


def spelled(docs: DataFrame) -> DataFrame:
    """folded with spelt, the terms and variants (word, suggestion) that a line holds, found once for all that asks for them."""
    spelt = F.transform(held(F.col("text"), SPELT), lambda x: F.struct(x["word"].alias("word"), x["suggestion"].alias("suggestion")))
    return folded(docs).withColumn("spelt", spelt)


def terms(docs: DataFrame) -> DataFrame:
    """path, line, found, term: variants of terms that aren't right, in their exact case; of overlapping ones the longest."""
    return spelled(docs).select("path", "line", F.explode(wrong(F.col("spelt"))).alias("x")).select("path", "line", F.col("x.word").alias("found"), F.col("x.suggestion").alias("term"))


def prohibited(docs: DataFrame) -> DataFrame:
    """path, line, found, suggestion."""
    return _matched(docs, PROHIBITED, True).select("path", "line", F.col("word").alias("found"), "suggestion")


NOUNS = [("to " + n, "to " + v) for n, v in VERB_FORMS]


def verb_forms(docs: DataFrame) -> DataFrame:
    """Nouns used as verbs, after to: path, line, found, suggestion."""
    return _matched(docs, NOUNS, True).select("path", "line", F.col("word").alias("found"), "suggestion")


def compounds(text: Column, low: Column) -> Column:
    """Compounds (word, suggestion) that a line writes the wrong way: open before a noun, with a hyphen at the end of a clause. low: the line in lower case."""
    out = []
    for c in COMPOUNDS:
        h = c.replace(" ", "-")
        after = F.lower(F.regexp_extract(text, rf"(?i)(?:^|[^\p{{L}}\p{{N}}_-]){c} ([a-z]+)", 1))
        # The patterns are tried only where the words are.
        out.append(F.when(low.contains(c), F.when(~after.isin("", *AFTER_NOUN), F.struct(F.lit(c).alias("word"), F.lit(h).alias("suggestion")))))
        out.append(F.when(low.contains(h) & text.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_-]){h}(?:[.,;:!?)]|$)"), F.struct(F.lit(h).alias("word"), F.lit(c).alias("suggestion"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def hyphenation(docs: DataFrame) -> DataFrame:
    """path, line, found, suggestion: compounds as noun and as adjective; of each compound the first of a line."""
    return folded(docs).select("path", "line", F.explode(compounds(F.col("text"), F.col("low"))).alias("x")).select("path", "line", F.col("x.word").alias("found"), "x.suggestion")


def element_terms(docs: DataFrame) -> DataFrame:
    """path, term, element, lines: on how many lines a document names each element of an interface, by its right term."""
    return _matched(docs, [(t, e) for e, t in ELEMENTS], True).groupBy("path", F.col("word").alias("term"), F.col("suggestion").alias("element")).agg(F.count("*").alias("lines"))


def plain_elements(docs: DataFrame) -> DataFrame:
    """path, line, name, element: elements of an interface that are named without bold."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(PLAIN_ELEMENT), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(PLAIN_ELEMENT), F.lit(2)).alias("b"))
    return prose(docs).select("path", "line", F.explode(both).alias("x")).select("path", "line", F.col("x.a").alias("name"), F.col("x.b").alias("element"))


def acronyms(text: Column) -> Column:
    """The acronyms of a line that aren't known terms."""
    words = F.when(text.rlike("[A-Z]{2}"), F.split(text, r"[^\p{L}\p{N}_]+")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(ACRONYM) & ~w.isin(KNOWN)))


def undefined(docs: DataFrame) -> DataFrame:
    """path, term, first_use: acronyms that aren't in the list of terms, and the line of their first use."""
    return prose(docs).select("path", "line", F.explode(acronyms(F.col("text"))).alias("term")).groupBy("path", "term").agg(F.min("line").alias("first_use"))


def hits() -> Column:
    """rule, severity, found, suggestion: what the rules of terms find in a line of spelled().

    Errors are wrong terms and prohibited ones, warnings verbs, verb forms and hyphenation, infos numbers and elements that aren't bold.
    """
    text, low = F.col("text"), F.col("low")
    row = lambda rule, severity, found, suggestion: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), found.alias("found"), suggestion.alias("suggestion"))
    of = lambda rule, severity, hits: F.transform(hits, lambda x: row(rule, severity, x["word"], x["suggestion"]))
    verb = F.lower(F.regexp_extract("text", r"^\s*[0-9]+\. ([A-Za-z]+)", 1))
    steps_ = F.filter(F.array(*(F.struct(F.lit(a).alias("word"), F.lit(b).alias("suggestion")) for a, b in AVOIDED)), lambda x: x["word"] == verb)
    number = F.regexp_extract("text", SMALL, 1)
    none = F.array().cast("array<struct<word:string,suggestion:string>>")
    numbers = F.filter(F.array(F.struct(number.alias("word"), F.lit("in words").alias("suggestion"))), lambda x: ~x["word"].isin(UNITS))
    names = F.transform(F.regexp_extract_all("text", F.lit(PLAIN_ELEMENT), F.lit(1)), lambda x: F.struct(x.alias("word"), F.concat(F.lit("**"), x, F.lit("**")).alias("suggestion")))
    # Patterns are tried only where a line has what they need.
    digit, the = text.rlike("[0-9]"), text.contains(" the ")
    return F.concat(
        of("term", "error", wrong(F.col("spelt"))), of("prohibited", "error", held(low, PROHIBITED)), of("verb_form", "warning", held(low, NOUNS)), of("action_verb", "warning", F.when(digit, steps_).otherwise(none)),
        of("hyphenation", "warning", compounds(text, low)), of("number", "info", F.when(digit, numbers).otherwise(none)), of("element", "info", F.when(the, names).otherwise(none)),
    )


def findings(docs: DataFrame) -> DataFrame:
    """path, line, rule, severity, found, suggestion of all rules of terms, in one pass over the lines."""
    return spelled(docs).select("path", "line", F.explode(hits()).alias("x")).select("path", "line", "x.*")


def located(docs: DataFrame) -> DataFrame:
    """path, rule, severity, found, suggestion, locations: each finding once for a document, with the lines where it is."""
    where = F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: F.concat(F.lit("line "), x.cast("string"))), ", ")
    return findings(docs).groupBy("path", "rule", "severity", "found", "suggestion").agg(where.alias("locations"))


def steps(docs: DataFrame) -> DataFrame:
    """Steps that begin with a verb to avoid: path, line, verb, suggestion."""
    table = F.broadcast(docs.sparkSession.createDataFrame(AVOIDED, "verb string, suggestion string"))
    return prose(docs).withColumn("verb", F.lower(F.regexp_extract("text", r"^\s*[0-9]+\. ([A-Za-z]+)", 1))).join(table, "verb").select("path", "line", "verb", "suggestion")


SMALL = r"(?:^|[^\p{L}\p{N}_.])[1-9] ([a-z]+)"
UNITS = ["", "ms", "s", "seconds", "minutes", "hours", "days", "kb", "mb", "gb", "px", "cores"]


def small_numbers(docs: DataFrame) -> DataFrame:
    """Digits that should be words: one digit before a word that is no unit."""
    return prose(docs).withColumn("word", F.regexp_extract("text", SMALL, 1)).where(~F.col("word").isin(UNITS)).select("path", "line", "word")


def inconsistent(docs: DataFrame) -> DataFrame:
    """Terms of which a document has several spellings: path, term, variants."""
    hits = _matched(docs, SPELT, False)
    return hits.groupBy("path", F.col("suggestion").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("word")), "|").alias("variants"), F.countDistinct("word").alias("n")).where("n > 1").select("path", "term", "variants")


def quick(docs: DataFrame) -> DataFrame:
    """path, check, n: lines that the quick checks find."""
    hit = F.filter(F.array(*(F.struct(F.lit(n).alias("check"), F.col("text").rlike(p).alias("hit")) for n, p in QUICK)), lambda x: x["hit"])
    return prose(docs).select("path", F.explode(hit).alias("x")).groupBy("path", F.col("x.check").alias("check")).agg(F.count("*").alias("n"))


def term_report(docs: DataFrame) -> DataFrame:
    """path, errors, warnings (with terms of several spellings), infos (with undefined terms), compliant: no errors and no warnings."""
    levels = ("error", "warning", "info")
    own = spelled(docs).select("path", "spelt", acronyms(F.col("text")).alias("open"), F.transform(hits(), lambda x: x["severity"]).alias("hits"))
    sums = [F.sum(F.size("hits") - F.size(F.array_remove("hits", s))).alias(s) for s in levels]
    # Spellings and acronyms of a document: sets of what its lines hold.
    own = own.groupBy("path").agg(*sums, F.array_distinct(F.flatten(F.collect_list("spelt"))).alias("spelt"), F.size(F.array_distinct(F.flatten(F.collect_list("open")))).alias("open"))
    names = F.transform("spelt", lambda x: x["suggestion"])
    twice = F.size(F.filter(F.array_distinct(names), lambda t: F.size(F.filter(names, lambda x: x == t)) > 1))
    out = docs.select("path").join(own.select("path", *levels, twice.alias("twice"), "open").hint("merge"), "path", "left").na.fill(0)
    out = out.select("path", F.col("error").alias("errors"), (F.col("warning") + F.col("twice")).alias("warnings"), (F.col("info") + F.col("open")).alias("infos"))
    return out.withColumn("compliant", (F.col("errors") == 0) & (F.col("warnings") == 0))
