"""Corpora of Markdown, source lines, diffs and commits derived from the tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

D_DOCS = r"""
select concat('docs/', case p_partkey % 6 when 0 then 'api' when 1 then 'guides' when 2 then 'blog' when 3 then 'examples' when 4 then 'intro' else 'reference' end, '/', cast(p_partkey as string), '.md') as path,
  concat(
    case when p_partkey % 5 = 0 then concat('---', chr(10), 'title: "Part ', cast(p_partkey as string), '"', chr(10), 'description: About ', p_name, chr(10), '---', chr(10)) else '' end,
    '# ', p_name, chr(10),
    'Call `on_', case p_partkey % 5 when 0 then 'click' when 1 then 'view' when 2 then 'signup' when 3 then 'purchase' else 'error' end, cast(p_size as string), '()` or use the prose name handle_', case p_partkey % 5 when 0 then 'click' when 1 then 'view' when 2 then 'signup' when 3 then 'purchase' else 'error' end, cast(p_size as string), ' here.', chr(10),
    '## Set up ', p_brand, chr(10),
    'See [next](', cast(p_partkey + 6 as string), '.md) and [up](../intro/', cast(p_partkey + 4 as string), '.md#set-up-brand1) and [route](/api/', cast(p_partkey - p_partkey % 6 as string), ').', chr(10),
    'Also [self](#', case when p_partkey % 14 = 0 then 'set-up-gone' when p_partkey % 7 = 0 then 'missing' else replace(lower(p_name), ' ', '-') end, '), [r][ref', cast(p_size % 3 as string), '], ![pic](img/', cast(p_size as string), '.png), <a href="https://example.com/', p_brand, '">x</a> and [mail](mailto:a@b.c).', chr(10),
    case when p_partkey % 4 = 3 then '#### Skipped level' else '### Details' end, chr(10),
    case when p_partkey % 9 = 0 then '~~~' else '```' end, case when p_size % 2 = 0 then 'python' else '' end, chr(10),
    'handle_', case p_partkey % 5 when 0 then 'click' when 1 then 'view' when 2 then 'signup' when 3 then 'purchase' else 'error' end, cast(p_size as string), '(x)', chr(10), '[hidden](none.md)', chr(10),
    case when p_partkey % 9 = 0 then '~~~' else '```' end, chr(10),
    '[ref1]: https://example.com/', p_brand, chr(10),
    case p_partkey % 4 when 0 then 'Simply click here in order to add the api-key to NodeJS.' when 1 then 'The whitelist is loaded by the Github server.' when 2 then 'Users can set 3 options.' else 'You configure the API key.' end, chr(10)) as content
from part
"""

D_DIFF = r"""
select path, line,
  concat(case when line % 40 % 3 = 0 then '-' when line % 40 % 3 = 1 then '+' when line % 80 < 40 then '-' else '+' end, text) as d
from (select concat('src/', event_type, '/f', cast(user_id % 4 as string), case event_id % 3 when 0 then '.ts' when 1 then '.py' else '.go' end) as path,
  event_id as line,
  case when event_id % 10 = 9 then case event_id % 3 when 0 then concat('router.get(''/', event_type, '/', cast(event_id % 7 as string), ''', h)') when 1 then concat('@app.route("/', event_type, '/', cast(event_id % 7 as string), '")') else concat('key := process.env.KEY_', upper(event_type)) end
  else case event_id % 3 when 0 then concat('export function on_', event_type, cast(event_id % 40 as string), '(x) {') when 1 then concat('def handle_', event_type, cast(event_id % 40 as string), '(x):') else concat('func Do', upper(event_type), cast(event_id % 40 as string), '(x int) {') end end as text
from events) c
"""

D_COMMITS = r"""
select event_id as pos, substr(md5(cast(event_id as string)), 1, 8) as hash, cast(user_id as string) as author,
  case event_id % 12 when 0 then concat('feat(ui): add ', event_type, ' view') when 1 then concat('fix: correct ', event_type, ' (#', cast(event_id % 50 as string), ')') when 2 then 'chore: bump deps'
   when 3 then concat('PROJ-', cast(user_id as string), ': fix ', event_type, ' #', cast(event_id % 9 as string)) when 4 then 'remove vulnerability' when 5 then 'patch CVE-2024-1' when 6 then concat('refactor!: drop ', event_type)
   when 7 then concat('weird: ', event_type) when 8 then concat('docs: explain ', event_type) when 9 then concat('added ', event_type) when 10 then 'Breaking change in api' else concat('Add security for ', event_type) end as subject,
  case event_id % 5 when 0 then concat('fixes #', cast(event_id % 30 as string)) when 1 then 'BREAKING CHANGE: yes' else '' end as body
from events
"""

#: Whole source files: one for each part, with and without documentation comments, tests among them.
D_FILES = r"""
select concat('src/m', cast(p_partkey % 7 as string), '/', case when p_partkey % 11 = 0 then 'test_' else '' end, 'f', cast(p_partkey as string), case p_partkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.go' else '.tsx' end) as path,
  case p_partkey % 4
    when 1 then concat('import os', chr(10), 'class Part', cast(p_size as string), ':', chr(10), case when p_partkey % 3 = 0 then concat('    ', repeat('"', 3), 'A part.', repeat('"', 3)) else '    x = 1' end, chr(10),
      'async def handle_click', cast(p_size as string), '(x):', chr(10), '    # note', chr(10), case when p_partkey % 5 = 0 then concat('    ', repeat('"', 3), 'Handles.', repeat('"', 3)) else '    return x' end, chr(10),
      'def _private(x):', chr(10), '@app.route("/parts/', cast(p_size as string), '")', chr(10), '@router.get("/parts/', cast(p_size as string), '")', chr(10), 'def run(x):', chr(10), '    return x', chr(10))
    when 2 then concat('package m', chr(10), case when p_partkey % 3 = 0 then '// DoPart does.' else '' end, chr(10), 'func DoPart', cast(p_size as string), '(x int) {', chr(10), '}', chr(10),
      'func (p *Part) Weigh', cast(p_size as string), '(x int) {', chr(10), 'type Part', cast(p_size as string), ' struct {', chr(10), 'func lower(x int) {', chr(10), 'func Map[T any](x T) {', chr(10))
    else concat(case when p_partkey % 3 = 0 then concat('/**', chr(10), ' * Loads.', chr(10), ' */', chr(10)) when p_partkey % 3 = 1 then concat('/** one line */', chr(10)) else '' end,
      'export async function on_click', cast(p_size as string), '(x) {', chr(10), '}', chr(10), 'export const Panel', cast(p_size as string), ' = (x) => x', chr(10), 'export const typed: T = 1', chr(10),
      'export abstract class Store', cast(p_size as string), ' {', chr(10), 'export interface Shape', cast(p_size as string), ' {', chr(10), 'export type Kind', cast(p_size as string), ' = string', chr(10),
      'export default function main', cast(p_size as string), '() {', chr(10), 'module.exports.legacy', cast(p_size as string), ' = function () {', chr(10), 'exports.value', cast(p_size as string), ' = 1', chr(10),
      '  router.post(''/parts/', cast(p_size as string), ''', h)', chr(10), 'const v = process.env.KEY_', cast(p_size as string), chr(10))
  end as content
from part
"""

#: Prose with what style and terminology rules look for.
D_PROSE = r"""
select concat('docs/p', cast(p_partkey as string), '.md') as path,
  concat('# Set up the ', p_name, chr(10), case when p_partkey % 6 = 0 then concat('# Another Title', chr(10)) else '' end,
    case p_partkey % 10 when 0 then 'Simply click here in order to add the api-key to NodeJS.' when 1 then 'The whitelist is loaded by the Github server.' when 2 then 'Users can set 3 options, etc.'
      when 3 then 'You configure the API key and the Api Key of the CLI.' when 4 then 'Please note that the color and the colour will change.' when 5 then 'As mentioned above, the javascript client uses JSON and json.'
      when 6 then 'A number of files were created by the macos agent.' when 7 then 'Obviously the master/slave setup needs a sanity check.' when 8 then 'One can run it on linux or Kubernetes and K8s, and has to setup it.' else 'Plain words about a part of the page.' end, chr(10),
    case when p_partkey % 4 = 3 then '#### Skipped Level' else '## Details' end, chr(10), '```', case when p_size % 2 = 0 then 'python' else '' end, chr(10), 'simply = nodejs', chr(10), '```', chr(10),
    '1. The ', p_brand, ' starts.', chr(10), '2. Press the button.', chr(10), '> **', case p_partkey % 3 when 0 then 'Note' when 1 then 'Hint' else 'Warning' end, '**: read on.', chr(10),
    'See [click here](https://docs.example.com/', cast(p_size as string), ') or [the guide](../guide.md).', chr(10),
    case p_partkey % 5 when 0 then 'The SLA needs a real time feed and the back-end.' when 1 then 'Open config.yaml and call reload() twice, says the RFC and the SLA.' when 2 then 'Click the Save button, then select the **Region** dropdown. Please note that In order to help is fine.'
      when 3 then 'The `config.yaml` file and `reload()` are open source. The open source is here, with set-up.md.' else 'An end user reads 5 MB of the command line guide, in order to learn the front end.' end, chr(10),
    case when p_partkey % 7 = 0 then concat('| Parameter | Type |', chr(10), '|---|:--|', chr(10), '| x | y |', chr(10), '    indented', chr(10)) else '' end,
    case when p_partkey % 8 = 0 then '### Use the Kubernetes Command Line' else '' end, chr(10)) as content
from part
"""

#: Files at the top of projects: front pages, packages and configurations of documentation platforms.
D_PROJECTS = r"""
select p_partkey as project, 'README.md' as path, case p_partkey % 4 when 0 then concat('# ', p_name, chr(10), 'short', chr(10), 'A library of parts by ', p_brand, ' for all.') when 1 then 'Just a long line of text without any heading.' when 2 then '---' else concat('# ', p_name, ' ', chr(10)) end as content from part
union all select p_partkey as project, 'docs/README.md' as path, case when p_partkey % 3 = 0 then 'No heading, but a line that is long enough.' else concat('intro', chr(10), '# Docs of ', p_name, chr(10), '   The documents of this project, all of them.') end as content from part
union all select p_partkey as project, case when p_partkey % 5 = 0 then 'sub/package.json' else 'package.json' end as path, concat('{"name":"pkg-', cast(p_partkey as string), '","description":"Package of parts"', case when p_partkey % 2 = 0 then concat(',"homepage":"https://pkg.org/', cast(p_partkey as string), '"') else '' end, '}') as content from part
union all select p_partkey as project, case p_partkey % 7 when 0 then 'docusaurus.config.js' when 1 then 'docs/mint.json' when 2 then 'mkdocs.yml' when 3 then 'docs/site/astro.config.mjs' when 4 then 'docs/docusaurus.config.ts' when 5 then '.gitbook.yaml' else 'docs/site/theme.config.jsx' end as path,
  concat('title: "Site ', cast(p_partkey as string), '",', chr(10), 'url: "https://d.org/', cast(p_size as string), '/",', chr(10), '"url": "https://m.org/', cast(p_size as string), '"', chr(10), 'site_url: ', chr(39), 'https://k.org/', cast(p_size as string), '//', chr(39), chr(10), 'site: "https://a.org/"', chr(10)) as content from part
union all select p_partkey as project, case when p_partkey % 2 = 0 then 'docs/mkdocs.yaml' else 'other.yaml' end as path, 'site_url: https://second.org/ ' as content from part
"""

#: Findings of a reviewer, and a patch, as lines.
D_FINDINGS = r"""
select event_id as id, concat('{"category":"', event_type, '","file":"docs/f', cast(user_id % 9 as string), '.md","line":', cast(event_id % 90 as string), ',"rule_id":"R', cast(event_id % 6 as string), '","description":"d","suggestion":"s"}') as line from events
"""

D_PATCH = r"""
select event_id as pos, case event_id % 10 when 0 then concat('diff --git a/docs/f', cast(event_id % 70 as string), '.md b/docs/f', cast(event_id % 70 as string), '.md') when 1 then concat('--- a/docs/f', cast((event_id - 1) % 70 as string), '.md') when 2 then concat('+++ b/docs/f', cast((event_id - 2) % 70 as string), '.md')
  when 3 then '@@ -1,4 +1,4 @@' when 4 then concat('-old ', event_type) when 5 then concat('+new ', event_type) when 6 then '+more' when 7 then ' same' when 8 then '@@ -9 +9 @@' else concat('-gone ', event_type) end as line from events
"""

CORPORA = {"d_docs": D_DOCS, "d_diff": D_DIFF, "d_commits": D_COMMITS, "d_files": D_FILES, "d_prose": D_PROSE, "d_findings": D_FINDINGS, "d_patch": D_PATCH, "d_projects": D_PROJECTS}


#: Tables with their keys, and how many rows give a task some MB of text. One row of part becomes a document of about 700 bytes.
TABLES = {"part": ("p_partkey", 8_000), "events": ("event_id", 80_000)}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived corpus; its table is read by path, so that no view is left behind.

    A few MB of a table, often one row group that one task reads, become a hundred times as much text. So rows are spread first.
    """
    text = CORPORA[name]
    for table, (key, rows) in TABLES.items():
        if f"from {table}" in text:
            path = f"parquet.`{sf_dir}/{table}.parquet`"
            parts = -(-spark.sql(f"select 1 from {path}").count() // rows)
            text = text.replace(f"from {table}", f"from (select /*+ repartition({parts}, {key}) */ * from {path})" if parts > 1 else f"from {path}")
    return spark.sql(text)
