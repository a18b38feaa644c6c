"""The same results in DuckDB's SQL, written from what the operators mean: windows where Spark splits arrays, and the like."""

from __future__ import annotations

from ..operators import rules
from ..sources.corpora import CORPORA

W = r"([\p{L}\p{N}_]+)"


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def prelude(*names: str) -> str:
    """Corpora, and of the Markdown ones lines with their state of code fences, as common tables."""
    out = []
    for name in names:
        out.append(f"{name} as ({CORPORA[name].strip()})")
    return "with " + ",\n".join(out)


def masked(source: str, out: str = "ml", tilde: bool = True) -> str:
    """Lines with inside; marker lines left out."""
    mark = "(starts_with(ltrim(text, ' ' || chr(9)), '```')" + (" or starts_with(ltrim(text, ' ' || chr(9)), '~~~'))" if tilde else ")")
    return f""",
{out}0 as (select path, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from {source}),
{out}1 as (select *, {mark} as mark from {out}0),
{out}2 as (select *, sum(case when mark then 1 else 0 end) over (partition by path order by line) % 2 = 1 as inside from {out}1),
{out} as (select path, cast(line as int) as line, text, inside from {out}2 where not mark)"""


def exploded(source: str, column: str, pattern: str, groups: int, keep: str) -> str:
    """keep, o (from 0), g1, g2: matches of a pattern in a column."""
    pick = ", ".join(f"unnest(regexp_extract_all({column}, {q(pattern)}, {k})) as g{k}" for k in range(1, groups + 1))
    return f"select {keep}, unnest(range(0, len(regexp_extract_all({column}, {q(pattern)}, 1)))) as o, {pick} from {source}"


INLINE = r"\[([^\]]*)\]\(([^)]+)\)"
USE = r"\[([^\]]*)\]\[([^\]]*)\]"
DEFINITION = r"(?m)^\[([^\]]+)\]:\s*([^\n]+)$"
ATTRIBUTE = r"""(?:href|src)=["']([^"']+)["']"""
KIND = r"""case when starts_with(target, 'mailto:') then 'email' when regexp_matches(target, '^https?://') then 'external' when starts_with(target, '#') then 'anchor'
when regexp_matches(target, '(?i)\.(png|jpe?g|gif|svg|webp)$') then 'image' else 'internal' end"""


def slug(x: str) -> str:
    """The anchor of a heading."""
    x = rf"regexp_replace({x}, '\[([^\]]+)\]\([^)]*\)', '\1', 'g')"
    x = rf"regexp_replace({x}, '[\x{{10000}}-\x{{10ffff}}\x{{2000}}-\x{{3300}}\x{{fe0f}}\x{{200d}}]', '', 'g')"
    x = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', '-', 'g')"
    return f"trim(regexp_replace({x}, '-+', '-', 'g'), '-')"


def links(source: str = "d_docs") -> str:
    """Tables inl, defs, refs, att, links, anchors."""
    return (
        masked(source)
        + f""",
pr as (select * from ml where not inside),
inl as (select path, line, 0 as kind, cast(o as int) as ordinal, g1 as text, regexp_extract(trim(g2), '^\\S+') as target from ({exploded("pr", "text", INLINE, 2, "path, line")}) where trim(g2) <> ''),
defs as (select path, lower(g1) as ref, trim(arg_max(g2, o)) as target from ({exploded(source, "content", DEFINITION, 2, "path")}) group by 1, 2),
uses as (select path, line, cast(o as int) as ordinal, g1 as text, lower(case when g2 = '' then g1 else g2 end) as ref from ({exploded("pr", "text", USE, 2, "path, line")})),
refs as (select u.path, line, 1 as kind, ordinal, text, target from uses u join defs d on u.path = d.path and u.ref = d.ref),
att as (select path, line, 2 as kind, cast(o as int) as ordinal, '' as text, g1 as target from ({exploded("pr", "text", ATTRIBUTE, 1, "path, line")})),
links as (select *, {KIND} as type from (select * from inl union all select * from refs union all select * from att)),
anchors as (select distinct path, anchor from (select path, {slug("g1")} as anchor from ({exploded(source, "content", r"(?m)^#{1,6}[ 	]+([^" + chr(92) + r"n]+)$", 1, "path")})
  union all select path, g1 from ({exploded(source, "content", r'''(?:id|name)=["']([^"']+)["']''', 1, "path")})) where anchor <> ''),
missing as (select path, line, target, lower(substr(target, 2)) as anchor from links l where type = 'anchor' and not exists (select 1 from anchors a where a.path = l.path and lower(a.anchor) = lower(substr(l.target, 2)))),
folder as (select path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir from {source}),
places as (select path as c, true as page from {source} union all select distinct array_to_string(string_split(path, '/')[1:k], '/'), false from {source}, range(1, 9) t(k) where k < len(string_split(path, '/'))),
int0 as (select l.*, dir, split_part(target, '#', 1) as file, case when contains(target, '#') then substr(target, position('#' in target) + 1) else '' end as fragment from links l join folder using (path) where type in ('internal', 'image')),
seg as (select *, starts_with(file, '/') as route, list_filter(string_split(dir || '/' || file, '/'), lambda s: s not in ('', '.')) as s from int0),
rel as (select *, list_reduce(list_transform(s, lambda x: [x]), lambda a, b: case when b[1] = '..' and len(a) > 0 and a[len(a)] <> '..' then a[1:len(a) - 1] else list_concat(a, b) end) as parts from seg),
rel2 as (select *, case when not route then array_to_string(parts, '/') end as loc from rel),
res as (select *, coalesce(not route and (starts_with(loc, '../') or loc = '..'), false) as outside, list_filter(string_split(case when trim(file, '/') = '' then 'index' else file end, '/'), lambda x: x not in ('', '.')) as t from rel2),
res2 as (select *, array_to_string(list_reduce(list_transform(t, lambda x: [x]), lambda a, b: case when b[1] = '..' and len(a) > 0 and a[len(a)] <> '..' then a[1:len(a) - 1] else list_concat(a, b) end), '/') as nm from res),
cand as (select path, line, kind, ordinal, unnest([loc, nm || '.md', nm || '.mdx', nm || '/index.md', nm || '/index.mdx']) as c, unnest([0, 1, 2, 3, 4]) as r from res2 where not outside),
hit as (select path, line, kind, ordinal, arg_min(cand.c, r) as resolved, min(r) as r from cand join places p on cand.c = p.c where r = 0 or page group by 1, 2, 3, 4),
resolved as (select path, line, kind, ordinal, type, target, fragment, outside, resolved, coalesce(not starts_with(file, '/') and r > 0, false) as fallback, case when outside or resolved is null then 'broken' else 'ok' end as status, dir, file, loc from res2 left join hit using (path, line, kind, ordinal)),
lost as (select path, line, kind, ordinal, target, resolved from resolved r where status = 'ok' and fragment <> '' and not fallback and not exists (select 1 from anchors a where a.path = r.resolved and lower(a.anchor) = lower(r.fragment))),
orphans as (select path from {source} d where not regexp_matches(path, '(README\\.md|index\\.mdx?)$') and path not in (select array_to_string(parts, '/') from rel where type = 'internal' and not starts_with(target, '/'))),
sug as (select m.path, line, m.anchor, coalesce(array_to_string((list_sort(list(a.anchor) filter (starts_with(lower(a.anchor), m.anchor[1:5]))))[1:3], ','), '') as suggested, coalesce(array_to_string((list_sort(list(a.anchor)))[1:10], ','), '') as available from missing m left join anchors a using (path) group by 1, 2, 3),
psug as (select path, line, target, kind, ordinal, coalesce((select array_to_string((list_sort(list(nm)))[1:3], ',') from (select regexp_replace(f.path, '^.*/', '') as nm from folder f where f.dir = regexp_replace(r.loc, '/[^/]*$', '') and lower(regexp_replace(f.path, '^.*/', ''))[1:3] = lower(regexp_replace(r.loc, '^.*/', ''))[1:3])), '') as suggested
  from resolved r where status = 'broken' and type = 'internal' and not outside and not starts_with(target, '/'))"""
    )


def link(select: str) -> str:
    return prelude("d_docs") + links() + "\n" + select


TS = [
    ("function", r"^export\s+(?:async\s+)?function\s+" + W), ("const_arrow", r"^export\s+(?:const|let)\s+" + W + r"\s*="), ("class", r"^export\s+(?:abstract\s+)?class\s+" + W), ("interface", r"^export\s+interface\s+" + W),
    ("type", r"^export\s+type\s+" + W), ("default_function", r"^export\s+default\s+(?:async\s+)?function\s+" + W), ("default_class", r"^export\s+default\s+class\s+" + W),
    ("module_exports_fn", r"^(?:module\.)?exports\." + W + r"\s*=\s*function"), ("module_exports_val", r"^(?:module\.)?exports\." + W + r"\s*="),
]
OTHER = [
    ("python", "function", r"^(?:async\s+)?def\s+([a-z][\p{L}\p{N}_]+)\s*\("), ("python", "class", r"^class\s+" + W), ("go", "function", r"^func\s+([A-Z][\p{L}\p{N}_]+)\s*\("),
    ("go", "function", r"^func\s+\([^)]+\)\s+([A-Z][\p{L}\p{N}_]+)\s*\("), ("go", "type", r"^type\s+([A-Z][\p{L}\p{N}_]+)\s+(?:struct|interface)"),
]
QUOTES = q("^(" + '"' * 3 + "|" + "'" * 3 + ")")
SKIPPED = r"\.(test|spec|stories)\.[jt]sx?$|_test\.(py|go)$|test_[\p{L}\p{N}_]+\.py$|(conftest|setup)\.py$|\.d\.ts$"


def items() -> str:
    """Tables items and status."""
    union = " union all ".join(
        [f"select path, line, language, {q(k)} as kind, regexp_extract(text, {q(p)}, 1) as name from cl where language = 'typescript'" for k, p in TS]
        + [f"select path, line, language, {q(k)}, regexp_extract(text, {q(p)}, 1) from cl where language = {q(l)}" for l, k, p in OTHER]
    )
    verb = r"""(?:app|router)\.\s*(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
    flask = r"""@(?:app|bp|blueprint)\.\s*(?:route|get|post|put|delete)\s*\(\s*['"]([^'"]+)"""
    fast = r"""@(?:app|router)\.\s*(?:get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)"""
    return (
        prelude("d_docs", "d_files")
        + f""",
lang as (select path, content, case when regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs)$') then 'typescript' when path like '%.py' then 'python' when path like '%.go' then 'go' end as language from d_files where not regexp_matches(path, {q(SKIPPED)})),
cl as (select path, language, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from lang where language is not null),
named as (select * from ({union}) where length(name) >= 4
  union all select path, line, language, 'endpoint', upper(g1) || ' ' || g2 from ({exploded("cl", "text", verb, 2, "path, line, language")}) where language = 'typescript'
  union all select distinct path, line, language, 'endpoint', 'ROUTE ' || g1 from (select path, line, language, g1 from ({exploded("cl", "text", flask, 1, "path, line, language")}) union all select path, line, language, g1 from ({exploded("cl", "text", fast, 1, "path, line, language")})) where language = 'python'),
close as (select n.path, n.line, max(c.line) as cline from named n join cl c on c.path = n.path and c.line < n.line and c.line >= n.line - 9 and trim(c.text) = '*/' and not exists (select 1 from cl m where m.path = n.path and m.line > c.line and m.line < n.line and trim(m.text) <> '' and not starts_with(trim(m.text), '//') and not starts_with(trim(m.text), '*')) group by 1, 2),
opened as (select k.path, k.line, k.cline, max(o.line) as oline from close k join cl o on o.path = k.path and o.line < k.cline and o.line >= k.cline - 29 and contains(o.text, '/**') group by 1, 2, 3),
js as (select distinct o.path, o.line from opened o join cl b on b.path = o.path and b.line >= o.oline and b.line <= o.cline where trim(b.text) not in ('', '/**', '*/', '*')),
near as (select path, line, lag(text) over w as before, trim(coalesce(lead(text) over w, '')) as n1, trim(coalesce(lead(text, 2) over w, '')) as n2 from cl window w as (partition by path order by line)),
items as (select n.path, cast(n.line as int) as line, name,
  case when n.language = 'typescript' and kind in ('function', 'const_arrow', 'default_function') then case when n.path like '%.tsx' and regexp_matches(name, '^[A-Z]') then 'component' else 'function' end when kind = 'default_class' then 'class' else kind end as type,
  coalesce(case when kind = 'endpoint' then false when n.language = 'typescript' then js.path is not null
    when n.language = 'python' then regexp_matches(n1, {QUOTES}) or ((n1 = '' or n1 like '#%') and regexp_matches(n2, {QUOTES})) else starts_with(trim(before), '//') end, false) as has_inline_docs
  from named n join near x on x.path = n.path and x.line = n.line left join js on js.path = n.path and js.line = n.line),
term as (select *, case when type = 'endpoint' then regexp_replace(name, '^[A-Z]+ ', '') else name end as term from items),
spans as (select distinct unnest(list_slice(string_split(content, '`'), 2, len(string_split(content, '`')) - 1)) as span from d_docs),
spoken as (select distinct t.term from (select distinct term from term where length(term) >= 6) t join spans on contains(span, t.term)),
status as (select path, line, name, type, has_inline_docs, case when (select count(content) from d_docs) = 0 then 'undocumented' when length(t.term) < 6 then 'skipped' when s.term is not null then 'documented' when has_inline_docs then 'partial' else 'undocumented' end as status from term t left join spoken s on s.term = t.term),
counted as (select *, regexp_replace(path, '/[^/]*$', '') as directory from status where status <> 'skipped')
"""
    )


def by(key: str) -> str:
    return f"select {key}, count(*) filter (status = 'documented') as documented, count(*) filter (status = 'partial') as partial, count(*) as total, cast(round_even(count(*) filter (status = 'documented') / count(*) * 100, 0) as int) as percentage from counted group by {key}"


PREFIX = r"^(?:feat|fix|refactor|chore|docs|perf|ci|test)(?:\([^)]*\))?!?:\s*"
CONVENTIONAL = r"^([\p{L}\p{N}_]+)(?:\(([^)]*)\))?(!)?:\s*(.+)$"


def commits() -> str:
    """Tables cls (classified), refs, entries."""
    rules_ = [
        (r"\bbreaking[\s_-]?change\b", "Breaking Changes"), (r"\b(security|vulnerabilit|cve-)\b", "Security"), (r"^(add|implement|introduce|create|support)\b", "Added"),
        (r"^(fix|resolve|patch|correct|handle|repair)\b", "Fixed"), (r"^(remove|delete|drop|deprecate|disable)\b", "Removed"),
    ]
    keyword = "case " + " ".join(f"when regexp_matches(plain, {q(p)}) then {q(c)}" for p, c in rules_) + " else 'Changed' end"
    return (
        prelude("d_commits")
        + f""",
kinds as (select * from (values ('feat', 'Added'), ('fix', 'Fixed'), ('refactor', 'Changed'), ('perf', 'Changed'), ('docs', 'Documentation'), ('style', 'skip'), ('test', 'skip'), ('chore', 'skip'), ('ci', 'skip'), ('build', 'skip')) t(type, kind)),
parts as (select *, regexp_extract(subject, {q(CONVENTIONAL)}, 3) = '!' as marked, regexp_extract(subject, {q(CONVENTIONAL)}, 4) as rest, lower(regexp_extract(subject, {q(CONVENTIONAL)}, 1)) as type,
  regexp_matches(subject || chr(10) || body, 'BREAKING[\\s_-]?CHANGE') as loud, lower(trim(regexp_replace(subject, '^[A-Z]+-\\d+[:\\s]+\\s*', ''))) as plain from d_commits),
cls as (select pos, hash, author, subject, body, case when kind is not null then case when marked or loud then 'Breaking Changes' else kind end when loud then 'Breaking Changes' else {keyword} end as category,
  case when kind is not null then rest else subject end as description from parts left join kinds using (type)),
refs as (select pos, list_sort(list_distinct(regexp_extract_all(subject || chr(10) || body, '(?:^|\\s|Merge pull request )#(\\d+)', 1))) as prs,
  list_sort(list_distinct(regexp_extract_all(subject || chr(10) || body, '(?i)(?:fix(?:es)?|close[sd]?|resolve[sd]?)\\s+#(\\d+)', 1))) as issues from d_commits),
norm as (select c.*, prs, issues, regexp_replace(trim(lower(regexp_replace(description, '\\s*\\(#\\d+\\)\\s*$', ''))), {q(PREFIX)}, '') as n from cls c join refs using (pos) where category not in ('skip', 'Documentation')),
grp as (select category, n, min(pos) as pos, arg_min(hash, pos) as hash, arg_min(description, pos) as d, list_sort(list_distinct(flatten(list(prs)))) as prs, list_sort(list_distinct(flatten(list(issues)))) as issues from norm group by 1, 2),
txt as (select *, regexp_replace(regexp_replace(d, {q(PREFIX)}, ''), '\\s*\\(#\\d+\\)\\s*$', '') as t from grp),
entries as (select category, pos, hash, upper(substr(t, 1, 1)) || substr(t, 2) || case when len(prs) > 0 then ' (' || array_to_string(list_transform(prs, lambda x: '#' || x), ', ') || ')' else '' end as text, array_to_string(prs, ',') as prs, array_to_string(issues, ',') as issues from txt)
"""
    )


SETTING = r"""(?:config|settings|options)\s*[\[.]?\s*['"]""" + W
ENVIRONMENT = r"""(?:process\.env\.|os\.environ\.get\(|os\.getenv\()['"]?""" + W
ENDPOINT = r"""(?:app|router)\.\s*(?:get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""


def diff(*more: str) -> str:
    """Tables chg, def, alg, ends, env, trk, and with d_docs men."""
    names = " union all ".join(
        [rf"select path, line, d, sign, case when regexp_matches(path, '\.(ts|tsx|js|jsx)$') then regexp_extract(d, '^[-+]\s*(?:export\s+)?(?:async\s+)?function\s+{W}', 1) when path like '%.py' then regexp_extract(d, '^[-+]\s*(?:async\s+)?def\s+{W}', 1) when path like '%.go' then regexp_extract(d, '^[-+]\s*func\s+(?:\([^)]+\)\s+)?{W}', 1) else '' end as symbol from chg"]
        + [f"select path, line, d, sign, regexp_extract(d, {q(p)}, 1) from chg" for p in (r"^[-+]\s*export\s+(?:const|let|var)\s+" + W, r"^[-+]\s*(?:export\s+)?class\s+" + W, r"^[-+]\s*(?:export\s+)?(?:interface|type)\s+" + W)]
    )
    return (
        prelude("d_diff", *more)
        + f""",
chg as (select path, line, d, substr(d, 1, 1) as sign from d_diff where trim(d) <> '' and d[1:1] in ('+', '-') and not starts_with(d, '--- ') and not starts_with(d, '+++ ')),
def as (select path, line, sign, symbol from ({names}) where length(symbol) >= 6),
alg as (select path, symbol, case when bool_or(sign = '+') and bool_or(sign = '-') then 'modified' when bool_or(sign = '+') then 'added' else 'removed' end as change from def group by 1, 2),
ends as (select distinct path, g1 as endpoint, sign from ({exploded("chg", "d", ENDPOINT, 1, "path, sign")})),
env as (select distinct path, g1 as name from ({exploded("chg", "d", ENVIRONMENT, 1, "path")})),
alls as (select symbol, path, change as type from alg where change <> 'added' union all select endpoint, path, 'removed_endpoint' from ends where sign = '-' union all select name, path, 'env_var' from env),
each as (select symbol, type, array_to_string(list_sort(list(distinct path)), ', ') as source from alls where length(symbol) >= 6 group by 1, 2),
rk as (select *, row_number() over (partition by symbol order by case type when 'env_var' then 0 when 'removed_endpoint' then 1 when 'modified' then 2 else 3 end) as n from each),
trk as materialized (select symbol, type, case when starts_with(type, 'removed') then 'high' else 'medium' end as severity, source from rk where n = 1)"""
        + (
            masked("d_docs", "bl", tilde=False)
            + r""",
near as materialized (select path, line, symbol, severity, inside, text from bl join trk on contains(text, symbol) where trim(text) <> ''),
esc as materialized (select distinct text, symbol, regexp_matches(text, '\b' || regexp_escape(symbol) || '\b') as w, regexp_matches(text, '`[^`]*' || regexp_escape(symbol) || '[^`]*`|' || regexp_escape(symbol) || '\s*[(=]') as c from (select distinct text, symbol from near)),
hits as materialized (select path, line, symbol, severity, inside, w, c from near join esc using (text, symbol)),
men as materialized (select path, line, symbol, severity, case when inside then case when w then 'code_block' end when c then 'inline_code' when w then 'prose' end as context from hits where case when inside then w else c or w end),
stl as (select d.path, coalesce(sum(case when severity = 'high' then 3 when severity is not null then 1 end), 0) as score, count(severity) as findings from d_docs d left join (select * from men where context <> 'prose') m using (path) group by 1),
st as (select path, case when score >= 3 then 'stale' when score > 0 then 'likely_stale' else 'fresh' end as status, cast(score as bigint) as score, findings from stl)
"""
            if "d_docs" in more
            else ""
        )
    )


FRONT = r"(?s)\A---[^\S\n]*\n(.*?)\n---[^\S\n]*\n"


def paged(source: str) -> str:
    field = lambda n: rf"nullif(trim(regexp_extract(fm, '(?m)^{n}[^\S\n]*:[^\S\n]*[''\"]?([^\n]+?)[''\"]?[^\S\n]*$', 1)), '')"
    return f""",
hd as (select path, content, substr(content, 1, 5000) as head from {source}),
fm as (select *, regexp_extract(head, {q(FRONT)}, 1) as fm, regexp_replace(head, {q(FRONT)}, '') as rest from hd),
ls as (select path, list_filter(list_transform(string_split(rest, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 20 and not starts_with(x, '#') and not starts_with(x, '```')) as w from fm),
pgs as (select f.path, coalesce({field("title")}, nullif(trim(regexp_extract(head, '(?m)^#\\s+([^\\n]+)$', 1)), '')) as title, coalesce({field("description")}, substr(w[1], 1, 200), '') as description, strlen(content) as bytes from fm f join ls using (path))
"""


SECTION = """case when regexp_matches(p, '/api/|/reference/|/endpoints?/|/rest/|/graphql/') then 'API' when regexp_matches(p, '/guides?/|/tutorials?/|/how-?to/|/walkthrough/|/getting-started') then 'Guides'
when regexp_matches(p, '/blog/|/_posts/|/articles/|/news/|/changelog/|/release-notes?/') then 'Blog' when regexp_matches(p, '/examples?/|/samples?/|/quickstart/|/starter/|/demo/|/recipes?/') then 'Examples' else 'Docs' end"""


def indexed() -> str:
    words = ["getting-started", "quickstart", "installation", "overview", "introduction", "index", "readme"]
    prio = "case " + " ".join(f"when contains(lower(below), {q(w)}) then {k}" for k, w in enumerate(words)) + " else 7 end"
    return (
        prelude("d_docs")
        + paged("d_docs")
        + f""",
bw as (select *, regexp_replace(path, '^docs/', '') as below from pgs),
sc as (select *, {SECTION} as section from (select *, '/' || lower(below) as p from bw)),
idx as (select path, section, cast(list_position(['Docs', 'API', 'Guides', 'Blog', 'Examples'], section) as int) as section_rank, {prio} as priority, title, description,
  rtrim('https://example.com/' || array_to_string(list_transform(string_split(lower(replace(regexp_replace(regexp_replace(below, '\\.[^./]*$', ''), '/index$', ''), ' ', '-')), '/'), lambda s: regexp_replace(s, '^[0-9]+-', '')), '/'), '/') as url, bytes from sc)
"""
    )


def prose() -> str:
    return prelude("d_prose") + masked("d_prose") + ",\npr as (select path, line, text from ml where not inside)"


def words(rows: list[tuple], names: str, fold: bool) -> str:
    """Lines that hold a word of a table as a word: what is left and right of it, when the line is split at it, isn't part of a word."""
    values = ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)
    text = "lower(text)" if fold else "text"
    inner = "[\\p{L}\\p{N}_]"
    left = f"case when cut[i] = '' then i = 1 or not regexp_matches(word, '{inner}$') else not regexp_matches(cut[i], '{inner}$') end"
    right = f"case when cut[i + 1] = '' then i + 1 = len(cut) or not regexp_matches(word, '^{inner}') else not regexp_matches(cut[i + 1], '^{inner}') end"
    split = f"with c as materialized (select path, line, t.*, string_split({text}, word) as cut from pr join (values {values}) t({names}) on contains({text}, word))"
    return f"select * exclude (cut) from ({split} select * from c where len(list_filter(range(1, len(cut)), lambda i: ({left}) and ({right}))) > 0)"


KNOWN = "[" + ", ".join(q(t) for t, _ in rules.TERMS) + "]"
HEURISTICS = ", ".join(f"struct_pack(rule := {q(n)}, severity := {q(s)}, needs_review := {str(r).lower()}, hit := regexp_matches(text, {q(p)}))" for n, p, s, r in rules.HEURISTICS)
HEADS = r", hs as (select path, line, length(regexp_extract(text, '^(#{1,6})\s+(.+)$', 1)) as level, trim(regexp_extract(text, '^(#{1,6})\s+(.+)$', 2)) as title from pr where regexp_matches(text, '^#{1,6}\s+.+$'))"
FENCES = "select path, cast(count(*) as int) as n from (select *, row_number() over (partition by path order by line) as k from {0}1 where mark) where k % 2 = 1 and trim(regexp_replace(text, '^\\s*(```|~~~)', '')) = '' group by 1"
TERM_ROWS = [(v, t) for t, own in rules.TERMS for v in own]
TERMS = f"""hits as materialized ({words(TERM_ROWS, "word, term", False)}), good as materialized ({words([(t,) for t, own in rules.TERMS for t in [t, *own]], "word", False)}),
covered as (select distinct h.path, h.line, h.word from hits h join good g on g.path = h.path and g.line = h.line where contains(g.word, h.word) and length(g.word) > length(h.word)),
terms as (select path, line, word as found, term from hits anti join covered using (path, line, word))"""
PROHIBITED = words(rules.PROHIBITED, "word, suggestion", True)
VERBS = words([("to " + n, "to " + v) for n, v in rules.VERB_FORMS], "word, suggestion", True)
STEPS = "select path, line, verb, suggestion from (select *, lower(regexp_extract(text, '^\\s*[0-9]+\\. ([A-Za-z]+)', 1)) as verb from pr) join (values " + ", ".join(f"({q(a)}, {q(b)})" for a, b in rules.AVOIDED) + ") t(verb, suggestion) using (verb)"
NUMBERS = r"select path, line, word from (select *, regexp_extract(text, '(?:^|[^\p{L}\p{N}_.])[1-9] ([a-z]+)', 1) as word from pr) where word not in ('', 'ms', 's', 'seconds', 'minutes', 'hours', 'days', 'kb', 'mb', 'gb', 'px', 'cores')"
AFTER = "[" + ", ".join(q(w) for w in rules.AFTER_NOUN) + "]"
HYPHENS = " union all ".join(
    f"select path, line, {q(c)} as found, {q(c.replace(' ', '-'))} as suggestion from pr where regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_-]){c} ([a-z]+)', 1) <> '' and not list_contains({AFTER}, lower(regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_-]){c} ([a-z]+)', 1)))"
    f" union all select path, line, {q(c.replace(' ', '-'))}, {q(c)} from pr where regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_-]){c.replace(' ', '-')}(?:[.,;:!?)]|$)')"
    for c in ("front end", "back end", "real time", "open source", "command line", "end user")
)
PLAIN = "(?:[Cc]lick|[Ss]elect|[Ee]nable|[Oo]pen) the ([A-Z][A-Za-z]*(?: [A-Za-z]+)?) (link|button|dropdown|field|toggle|checkbox|radio button|tab|dialog|sidebar|header|page)"
PLAINS = f"select path, line, g1 as name, g2 as element from ({exploded('pr', 'text', PLAIN, 2, 'path, line')})"
LEFT = "regexp_replace(regexp_replace(text, '`[^`]*`', '', 'g'), '\\]\\([^)]*\\)', ']', 'g')"
CALL = r"([A-Za-z_][A-Za-z0-9_]*\(\))"
FILE = r"(?:^|[^A-Za-z0-9_./-])([A-Za-z0-9_-]+\.(?:yaml|yml|json|js|ts|py|go|md|toml|txt|sh|css|html))(?:[^A-Za-z0-9_]|$)"
BANNED = words([(b,) for b in rules.BANNED], "word", True)
SPELLING = words(rules.SPELLING, "word, suggestion", True)
TITLES = f"select path, line, title, cast(n as int) as n from (select *, len(list_filter(regexp_split_to_array(title, '\\s+')[2:], lambda w: regexp_matches(w, '^[A-Z][a-z]') and not list_contains({KNOWN}, w))) as n from hs) where n > 0"
SKIPS = "select path, line, before, level from (select *, lag(level) over (partition by path order by line) as before from hs) where level - before > 1"
CALLOUTS = "select path, line, kind from (select *, regexp_extract(text, '^>\\s*\\*\\*([A-Za-z]+)\\*?\\*?:', 1) as kind from pr) where kind not in ('', 'Note', 'Tip', 'Important', 'Warning', 'Caution')"
OPEN = f"select path, w as term, min(line) as first_use from (select path, line, unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z]{{2,}}s?$') and not list_contains({KNOWN}, w))) as w from pr) group by 1, 2"
MIXED = f"select path, term, array_to_string(list_sort(list(distinct word)), '|') as variants from ({words([(v, t) for t, own in rules.TERMS for v in [t, *own]], 'word, term', False)}) group by 1, 2 having count(distinct word) > 1"
FOUND = f"""select path, line, 'term' as rule, 'error' as severity, found, term as suggestion from terms union all select path, line, 'prohibited', 'error', word, suggestion from ({PROHIBITED})
union all select path, line, 'verb_form', 'warning', word, suggestion from ({VERBS}) union all select path, line, 'action_verb', 'warning', verb, suggestion from ({STEPS}) union all select path, line, 'hyphenation', 'warning', found, suggestion from ({HYPHENS})
union all select path, line, 'number', 'info', word, 'in words' from ({NUMBERS}) union all select path, line, 'element', 'info', name, '**' || name || '**' from ({PLAINS})"""
#: Sections that kinds of pages need, written out again from the survey's rules.
NEEDS = """('tutorial', 'introduction', 'introduction|overview|what you'), ('tutorial', 'prerequisites', 'prerequisite|before you'), ('tutorial', 'steps', 'step|set up'), ('tutorial', 'summary', 'summary|next steps'),
('how-to', 'goal', 'goal|overview|introduction'), ('how-to', 'prerequisites', 'prerequisite|before you'), ('how-to', 'steps', 'step|set up'), ('how-to', 'verification', 'verif|check'),
('reference', 'description', 'overview|description|details'), ('reference', 'syntax', 'syntax'), ('reference', 'parameters', 'parameter|argument|option'), ('reference', 'return value', 'return'), ('reference', 'examples', 'example'), ('reference', 'related', 'related|see also'),
('explanation', 'context', 'context|introduction|overview'), ('explanation', 'core concept', 'concept'), ('explanation', 'how it works', 'how it works|details'), ('explanation', 'implications', 'implication|trade-off'), ('explanation', 'related', 'related|see also')"""
NEEDED = f"""kd as (select path, case when regexp_matches('/' || lower(path), '/tutorials?/') then 'tutorial' when regexp_matches('/' || lower(path), '/how-?to/|/guides?/') then 'how-to' when regexp_matches('/' || lower(path), '/reference/|/api/') then 'reference' when regexp_matches('/' || lower(path), '/explanations?/|/concepts?/|/intro/') then 'explanation' end as kind from {{0}}),
nd as (select path, kind, section from (select * from kd join (values {NEEDS}) t(kind, section, pattern) using (kind)) n where not exists (select 1 from hs where hs.path = n.path and len(list_filter(string_split(pattern, '|'), lambda x: contains(lower(hs.title), x))) > 0))"""
VAGUE = f"select path, line, g1 as link from ({exploded('pr', 'text', INLINE, 1, 'path, line')}) where lower(trim(g1)) in ('click here', 'here', 'this link', 'this page')"

_code = "element_at([200, 301, 302, 307, 308, 403, 404, 410, 429, 500], event_id % 10 + 1)".replace("element_at(", "list_extract(")
ORACLE = {
    "S_lines": prelude("d_docs") + masked("d_docs") + " select path, cast(line as int) as line, text from ml0",
    "S06_excluded_files": prelude("d_files") + f" select path from d_files where regexp_matches(path, {q(SKIPPED)})",
    "S12_safe_ranges": r"select span, count(*) as n, regexp_matches(span, '^[a-zA-Z0-9_.~^/\-]+(\.\.[a-zA-Z0-9_.~^/\-]+)?$') as safe from (select list_extract(['v1.0..HEAD', 'abc~5', 'a b', 'x;rm', '--all', 'a..b..c'], event_id % 6 + 1) as span from events) group by 1",
    "L01_inline_links": link("select * from inl"),
    "L02_definitions": link("select * from defs"),
    "L03_reference_links": link("select * from refs"),
    "L04_attribute_links": f"with ln as (select page_id, unnest(string_split(html, chr(10))) as text, unnest(range(1, len(string_split(html, chr(10))) + 1)) as line from pages) select page_id, cast(line as int) as line, cast(o as int) as ordinal, target, {KIND} as type from (select page_id, line, o, g1 as target from ({exploded('ln', 'text', ATTRIBUTE, 1, 'page_id, line')}))",
    "L05_code_fences": prelude("d_docs") + masked("d_docs") + " select * from ml",
    "L06_L07_links": link("select * from links"),
    "L07_page_link_types": f"select {KIND} as type, count(*) as links, count(distinct target) as targets from (select unnest(regexp_extract_all(html, {q(ATTRIBUTE)}, 1)) as target from pages) group by 1",
    "L08_slugs": f"select page_id, {slug("regexp_extract(html, '<title>([^<]*)</title>', 1)")} as slug from pages",
    "L09_anchors": link("select * from anchors"),
    "L10_missing_anchors": link("select * from missing"),
    "L11_anchor_suggestions": link("select * from sug"),
    "L12_L13_L14_L15_resolved": link("select path, line, kind, ordinal, type, target, fragment, outside, resolved, fallback, status from resolved"),
    "L16_http_status": f"select {_code} as code, case when {_code} = 200 then 'ok' when {_code} in (301, 302, 307, 308) then 'redirect' when {_code} = 403 then 'indeterminate' when {_code} = 429 then 'rate_limited' when {_code} in (404, 410) then 'broken' else 'unknown' end as status, count(*) as n from events group by 1, 2",
    "L18_missing_fragments": link("select * from lost"),
    "L19_page_suggestions": link("select * from psug"),
    "L23_fixes": link("""select path, line, target, regexp_replace(split_part(target, '#', 1), '[^/]*$', '') || split_part(suggested, ',', 1) || case when contains(target, '#') then substr(target, position('#' in target)) else '' end as proposed from psug where suggested <> ''
union all select path, line, '#' || anchor, '#' || split_part(suggested, ',', 1) from sug where suggested <> ''"""),
    "L20_orphans": link("select * from orphans"),
    "L21_link_summary": link("select *, internal + anchor + image - broken_internal + external - broken_external - redirects as ok, broken_internal + broken_external > 0 as has_broken from (select count(*) as total, " + ", ".join(f"count(*) filter (type = '{k}') as {k}" for k in ("internal", "anchor", "image", "external", "email")) + ", cast(0 as bigint) as broken_external, cast(0 as bigint) as redirects, (select count(*) from resolved where status = 'broken') + (select count(*) from lost) + (select count(*) from missing) as broken_internal, (select count(*) from orphans) as orphans from links)"),
    "L22_request_budget": link("select path, line, kind, ordinal, target, row_number() over (order by path, line, kind, ordinal) <= 50 as checked from links where type = 'external'"),
    "F01_changed_lines": diff() + " select * from chg",
    "F02_F03_F08_defined": diff() + " select * from def",
    "F04_endpoints": diff() + " select * from ends",
    "F05_environment": diff() + " select * from env",
    "F06_settings": diff() + f" select distinct path, g1 as name from ({exploded('chg', 'd', SETTING, 1, 'path')}) where length(g1) >= 6",
    "F07_algebra": diff() + " select * from alg",
    "F09_F10_tracked": diff() + " select * from trk",
    "F11_F12_F13_F14_mentions": diff("d_docs") + " select * from men",
    "F15_F16_stale": diff("d_docs") + " select * from st",
    "F17_findings": diff("d_docs") + " select * from (select path, cast(row_number() over (partition by path order by line, symbol) as int) as n, line, symbol, context from men where context <> 'prose') where n <= 10",
    "F18_summary": diff("d_docs") + " select count(*) filter (status = 'stale') as stale, count(*) filter (status = 'likely_stale') as likely_stale, count(*) filter (status = 'fresh') as fresh, (select count(*) from trk) as symbols_tracked from st",
    "X01_X10_items": items() + "select * from items",
    "X11_X13_status": items() + "select * from status",
    "X14_by_type": items() + by("type"),
    "X15_by_directory": items() + by("directory") + " order by total desc, directory limit 15",
    "X16_overall": items() + "select count(*) filter (status = 'documented') as documented, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'undocumented') as undocumented, count(*) as total, cast(round_even(count(*) filter (status = 'documented') / count(*) * 100, 0) as int) as percentage from counted",
    "X17_primary_language": items() + "select language from lang where language is not null group by 1 order by count(*) desc, list_position(['typescript', 'python', 'go'], language) limit 1",
    "X18_docs_kind": prelude("d_docs") + " select case when bool_or(regexp_matches(content, '(?i)(api|function|class)\\s+reference')) or sum(len(regexp_extract_all(content, '`[^`]+\\(\\)`'))) > 20 then 'api_reference' else 'product_docs' end as kind from d_docs",
    "X19_X20_undocumented": items() + "select case when type = 'endpoint' then 0 when type in ('function', 'component') then 1 when type = 'class' then 2 else 3 end as priority, path, line, name, type from status where status = 'undocumented' order by 1, 2, 3, 4 limit 30",
    "X19_partial": items() + "select path, line, name, type, 'Has inline docs but no page of its own' as reason from status where status = 'partial' order by 1, 2, 3 limit 15",
    "X21_stubs": items() + "select s.path, s.line, name, '## ' || name || chr(10) || chr(10) || '```' || chr(10) || trim(text) || chr(10) || '```' || chr(10) || chr(10) || 'Description.' || chr(10) || chr(10) || '### Parameters' || chr(10) || chr(10) || '### Returns' || chr(10) || chr(10) || '### Example' || chr(10) as stub from status s join cl on cl.path = s.path and cl.line = s.line where status = 'undocumented'",
    "C01_conventional": commits() + f"select pos, type, regexp_extract(subject, {q(CONVENTIONAL)}, 2) as scope, marked as breaking, rest as description from parts where type <> ''",
    "C02_C06_classified": commits() + "select * from cls",
    "C07_C08_refs": commits() + "select pos, array_to_string(prs, ',') as prs, array_to_string(issues, ',') as issues from refs",
    "C09_C10_entries": commits() + "select * from entries",
    "C11_C13_sections": commits() + "select cast(list_position(['Breaking Changes', 'Added', 'Changed', 'Fixed', 'Removed', 'Security'], category) as int) as rank, category, string_agg('- ' || text, chr(10) order by pos) as body from entries group by 2",
    "C13_inserted": commits() + r""", body as (select string_agg('### ' || category || chr(10) || chr(10) || b, chr(10) || chr(10) order by r) as b from (select list_position(['Breaking Changes', 'Added', 'Changed', 'Fixed', 'Removed', 'Security'], category) as r, category, string_agg('- ' || text, chr(10) order by pos) as b from entries group by 2)),
e as (select '## [Unreleased] - 2026-01-01' || chr(10) || chr(10) || b as e from body),
o as (select unnest(['# Changelog' || chr(10) || chr(10) || '## [1.0.0] - 2025-01-01' || chr(10) || chr(10) || '- first' || chr(10) || chr(10) || '## [0.9.0]' || chr(10), '# Changelog' || chr(10) || chr(10) || 'Nothing yet.' || chr(10), null]) as old)
select old, case when old is null then '# Changelog' || chr(10) || chr(10) || 'All notable changes to this project will be documented in this file.' || chr(10) || chr(10) || 'The format is based on [Keep a Changelog](https://keepachangelog.com/en/1.1.0/),' || chr(10) || 'and this project adheres to [Semantic Versioning](https://semver.org/spec/v2.0.0.html).' || chr(10) || chr(10) || e || chr(10)
when contains(old, '## [') then split_part(old, '## [', 1) || e || chr(10) || chr(10) || substr(old, position('## [' in old)) else rtrim(old, chr(10)) || chr(10) || chr(10) || e || chr(10) end as new from o, e""",
    "C12_summary": commits() + "select count(*) as analysed, count(*) filter (category in ('skip', 'Documentation')) as skipped, (select count(*) from entries) as entries from cls",
    "P04_P07_pages": prelude("d_docs") + paged("d_docs") + "select * from pgs",
    "P06_descriptions": "with src as (select doc_id || '.md' as path, text as content from documents)" + paged("src") + "select path, description, bytes from pgs",
    "P08_sections": f"select page_id, {SECTION} as section, regexp_matches(url, '(?i)^https?://[^/?#]+') as safe from (select *, '/' || lower(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1)) as p from pages)",
    "P08_P11_index": indexed() + "select * from idx",
    "P12_P13_totals": prelude("d_docs") + " select files, cast(round_even(b / 1024, 0) as bigint) as kb, files <= 20 and b <= 200 * 1024 as full_export, case when files > 20 or b > 200 * 1024 then 'Cannot generate llms-full.txt: ' || concat_ws('; ', case when files > 20 then files || ' files exceeds limit of 20' end, case when b > 200 * 1024 then cast(floor(b / 1024) as bigint) || 'KB exceeds limit of 200KB' end) end as full_warning from (select count(*) as files, sum(strlen(content)) as b from d_docs)",
    "P14_base_urls": "select page_id, regexp_matches(url, '^https?://') as safe from pages",
    "P15_index_text": indexed() + ", sec as (select section_rank, section, string_agg('- [' || title || '](' || url || ')' || case when description <> '' then ': ' || description else '' end, chr(10) order by priority, lower(path), path) as body from idx group by 1, 2) select '# Parts' || chr(10) || chr(10) || '> All about parts' || chr(10) || chr(10) || string_agg('## ' || section || chr(10) || chr(10) || body, chr(10) || chr(10) order by section_rank) || chr(10) as text from sec",
    "P15_full_blocks": prelude("d_docs") + paged("d_docs") + "select path, '---' || chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || content || chr(10) as block from pgs join d_docs using (path)",
    "P01_P02_platforms": prelude("d_projects") + r""", pc as (select *, row_number() over () as o from (values ('docusaurus', 'docusaurus.config.js'), ('docusaurus', 'docusaurus.config.ts'), ('mintlify', 'mint.json'), ('mintlify', 'mintlify.json'), ('mkdocs', 'mkdocs.yml'), ('mkdocs', 'mkdocs.yaml'), ('gitbook', '.gitbook.yaml'), ('gitbook', 'book.json'),
('vitepress', '.vitepress/config.js'), ('vitepress', '.vitepress/config.ts'), ('vitepress', '.vitepress/config.mts'), ('nextra', 'theme.config.jsx'), ('nextra', 'theme.config.tsx'), ('astro_starlight', 'astro.config.mjs'), ('astro_starlight', 'astro.config.ts')) t(platform, name)),
pl as (select d || name as path, platform, n * 100 + o as o from pc, (values (0, ''), (1, 'docs/site/'), (2, 'docs/')) t(n, d)),
hit as (select project, arg_min(struct_pack(platform := platform, path := path, content := content), o) as x from d_projects join pl using (path) group by 1),
ur as (select project, x.platform as platform, x.path as path, case x.platform when 'docusaurus' then regexp_extract(x.content, 'url\s*[:=]\s*[''"]([^''"]+)', 1) when 'mintlify' then regexp_extract(x.content, '"url"\s*:\s*"([^"]+)"', 1) when 'mkdocs' then trim(trim(regexp_extract(x.content, 'site_url\s*:\s*([^\n]+)', 1)), chr(39) || '"') when 'astro_starlight' then regexp_extract(x.content, 'site\s*:\s*[''"]([^''"]+)', 1) end as u from hit)
select project, platform, path, nullif(rtrim(u, '/'), '') as base_url from ur""",
    "P03_projects": prelude("d_projects") + r""", rd as (select project, path, trim(regexp_extract(content, '(?m)^#\s+([^\n]+)$', 1)) as h, coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20 and not starts_with(x, '#') and not starts_with(x, '---'))[1], '') as d from d_projects where path in ('README.md', 'docs/README.md')),
ti as (select project, list(t order by o) as ts from (select project, o, arg_min(regexp_extract(content, 'title\s*:\s*[''"]([^''"]+)', 1), n) as t from d_projects join (select d || name as path, n, o from (values (1, 'astro.config.mjs'), (2, 'astro.config.ts'), (3, 'docusaurus.config.js'), (4, 'docusaurus.config.ts')) a(o, name), (values (0, 'docs/'), (1, '')) b(n, d)) using (path) group by 1, 2) group by 1),
pk as (select project, content::json ->> 'name' as n, content::json ->> 'description' as d, content::json ->> 'homepage' as u from d_projects where path = 'package.json'),
pj as (select distinct project from d_projects)
select p.project, coalesce(nullif(a.h, ''), nullif(b.h, ''), list_filter(ts, lambda x: x <> '')[1], nullif(pk.n, ''), cast(p.project as varchar)) as name,
coalesce(nullif(case when a.h <> '' then a.d else coalesce(nullif(b.d, ''), a.d) end, ''), pk.d, '') as description, coalesce(pk.u, '') as url
from pj p left join rd a on a.project = p.project and a.path = 'README.md' left join rd b on b.project = p.project and b.path = 'docs/README.md' left join ti on ti.project = p.project left join pk on pk.project = p.project""",
    "P15_rendered": indexed() + "select section_rank, section, string_agg('- [' || title || '](' || url || ')' || case when description <> '' then ': ' || description else '' end, chr(10) order by priority, lower(path), path) as body from idx group by 1, 2",
    "T01_T02_banned": prose() + f" select path, line, word as phrase from ({BANNED})",
    "T03_T06_heuristics": prose() + f" select path, line, x.rule, x.severity, x.needs_review from (select path, line, unnest([{HEURISTICS}]) as x from pr) where x.hit",
    "T07_title_case": prose() + HEADS + TITLES.join((" ", "")),
    "T08_skipped_levels": prelude("d_docs") + masked("d_docs") + ", pr as (select path, line, text from ml where not inside)" + HEADS + " " + SKIPS,
    "T09_several_titles": prose() + HEADS + " select path, count(*) as n from hs where level = 1 group by 1 having count(*) > 1",
    "T10_bare_fences": prelude("d_docs") + masked("d_docs") + " " + FENCES.format("ml"),
    "T14_spelling": prose() + f" select path, line, word as found, suggestion from ({SPELLING})",
    "T15_callouts": prose() + " " + CALLOUTS,
    "T16_vague_links": prose() + " " + VAGUE,
    "T17_own_site_links": prose() + f" select path, line, g2 as target from ({exploded('pr', 'text', INLINE, 2, 'path, line')}) where starts_with(g2, 'https://docs.example.com')",
    "T12_tables": prelude("d_prose") + " select path, cast(n as int) as tables from (select path, len(regexp_extract_all(content, '(?m)^[ \t]*\\|?[ \t]*:?-{2,}:?[ \t]*(?:\\|[ \t]*:?-{2,}:?[ \t]*)+\\|?[ \t]*$')) as n from d_prose) where n > 0",
    "T13_missing_sections": prelude("d_docs") + masked("d_docs") + ", pr as (select path, line, text from ml where not inside)" + HEADS + ", " + NEEDED.format("d_docs") + " select * from nd",
    "T18_bare_code": prose() + f", lf as (select path, line, {LEFT} as plain from pr) select * from (select path, line, g1 as found from ({exploded('lf', 'plain', CALL, 1, 'path, line')}) union all select path, line, g1 from ({exploded('lf', 'plain', FILE, 1, 'path, line')})) where not list_contains({KNOWN}, found)",
    "T20_fixed": prose() + rf""", rp as (select *, regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}])In order to ', '\1To ', 'g'), '(^|[^\p{{L}}])in order to ', '\1to ', 'g'), '(?i)please note that ', '', 'g') as x from pr)
select path, line, fixed from (select *, case when regexp_matches(x, '^#{{1,6}}\s+') then regexp_extract(x, '^#{{1,6}}\s+') || array_to_string(list_transform(string_split(substr(x, length(regexp_extract(x, '^#{{1,6}}\s+')) + 1), ' '), lambda w, i: case when i > 1 and regexp_matches(w, '^[A-Z][a-z]') and not list_contains({KNOWN}, w) then lower(w) else w end), ' ') else x end as fixed from rp) where fixed <> text""",
    "T21_profile": prose() + HEADS + f""", tc as (select path, count(*) as t from ({TITLES}) group by 1), hc as (select path, count(*) as h from hs group by 1), fc as (select path, cast(ceil(count(*) / 2) as int) as f from ml1 where mark group by 1),
pf as (select path, count(*) filter (regexp_matches(text, '(?i)(^|[^\\p{{L}}])your?([^\\p{{L}}]|$)')) as second_person, count(*) filter (regexp_matches(text, '(?i)(^|[^\\p{{L}}])(users?|one|they)([^\\p{{L}}]|$)')) as third_person, count(*) filter (regexp_matches(text, '^\\s*[0-9]+\\. ')) as numbered, count(*) filter (regexp_matches(text, '^\\s*[-*+] ')) as bulleted, count(*) filter (regexp_matches(text, '^    \\S')) as indented from pr group by 1),
al as (select pf.*, coalesce(h, 0) as titles, coalesce(t, 0) as title_case, coalesce(f, 0) as fences from pf left join hc using (path) left join tc using (path) left join fc using (path))
select *, case when second_person > 0 and third_person > 0 then 'mixed' when second_person > 0 then 'second' when third_person > 0 then 'third' end as person, case when bulleted > 0 and numbered > 0 then 'both' when bulleted > 0 then 'bullets' when numbered > 0 then 'numbers' end as list_style,
case when titles > 0 then case when 2 * title_case > titles then 'title' else 'sentence' end end as heading_style, case when fences > 0 then 'fenced' when indented > 0 then 'indented' end as code_block_style from al""",
    "T22_compliance": prose() + HEADS + ", " + NEEDED.format("d_prose") + f""", v as (select path, 'high' as s from ({BANNED}) union all select path, x.severity from (select path, unnest([{HEURISTICS}]) as x from pr) where x.hit
union all select path, 'medium' from ({TITLES}) union all select path, 'medium' from ({SKIPS}) union all select path, 'medium' from (select path from hs where level = 1 group by 1 having count(*) > 1)
union all select path, 'medium' from ({FENCES.format("ml")}) union all select path, 'low' from ({SPELLING}) union all select path, 'low' from ({CALLOUTS}) union all select path, 'high' from ({VAGUE}) union all select path, 'medium' from nd)
select d.path, count(*) filter (s = 'high') as high, count(*) filter (s = 'medium') as medium, count(*) filter (s = 'low') as low, count(*) filter (s in ('high', 'medium')) = 0 as compliant from d_prose d left join v using (path) group by 1""",
    "M01_M04_terms": prose() + f", {TERMS} select * from terms",
    "M05_verb_forms": prose() + f" select path, line, word as found, suggestion from ({VERBS})",
    "M07_steps": prose() + " " + STEPS,
    "M10_prohibited": prose() + f" select path, line, word as found, suggestion from ({PROHIBITED})",
    "M11_small_numbers": prose() + " " + NUMBERS,
    "M06_hyphenation": prose() + " " + HYPHENS,
    "M08_element_terms": prose() + f" select path, word as term, element, count(*) as lines from ({words([(t, e) for e, t in rules.ELEMENTS], 'word, element', True)}) group by 1, 2, 3",
    "M09_plain_elements": prose() + " " + PLAINS,
    "M12_inconsistent": prose() + " " + MIXED,
    "M13_undefined": prose() + " " + OPEN,
    "M14_M15_located": prose() + f", {TERMS} select path, rule, severity, found, suggestion, array_to_string(list_transform(list_sort(list(distinct line)), lambda x: 'line ' || x), ', ') as locations from ({FOUND}) group by all",
    "M14_term_report": prose() + f""", {TERMS}, v as (select path, severity as s from ({FOUND}) union all select path, 'warning' from ({MIXED}) union all select path, 'info' from ({OPEN}))
select d.path, count(*) filter (s = 'error') as errors, count(*) filter (s = 'warning') as warnings, count(*) filter (s = 'info') as infos, count(*) filter (s in ('error', 'warning')) = 0 as compliant from d_prose d left join v using (path) group by 1""",
    "M16_quick_checks": prose() + " select path, x.c as check, count(*) as n from (select path, unnest([" + ", ".join(f"struct_pack(c := {q(n)}, hit := regexp_matches(text, {q(p)}))" for n, p in rules.QUICK) + "]) as x from pr) where x.hit group by 1, 2",
    "V03_by_category": prelude("d_findings") + " select line::json ->> 'category' as category, count(*) as findings, count(distinct line::json ->> 'rule_id') as rules from d_findings group by 1",
    "V03_by_file": prelude("d_findings") + " select line::json ->> 'file' as file, count(*) as findings, count(distinct line::json ->> 'rule_id') as rules from d_findings group by 1",
    "V04_patch": prelude("d_patch") + """, g as (select *, sum(case when starts_with(line, '+++ ') then 1 else 0 end) over (order by pos) as k from d_patch)
select file, count(*) filter (starts_with(line, '@@')) as hunks, count(*) filter (line[1:1] = '+' and not starts_with(line, '+++ ')) as added, count(*) filter (line[1:1] = '-' and not starts_with(line, '--- ')) as removed
from (select *, first_value(regexp_extract(line, '^\\+\\+\\+ (?:b/)?(.*)$', 1)) over (partition by k order by pos) as file from g where k > 0) group by 1""",
}
ORACLE["T07_title_case"] = prose() + HEADS + " " + TITLES
