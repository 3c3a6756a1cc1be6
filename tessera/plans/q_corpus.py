"""Catalog entries: corpus profile, repository status/metadata, rollup."""

from __future__ import annotations

from ..operators import corpus as C
from ..oracle.sqltext import CORPUS_DOCUMENTS
from ..sources import tables as T
from .catalog import register

PAGES = "SELECT url AS path, html AS content, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS repo FROM pages"


def _base(p):
    return f"lower(string_split({p}, '/')[-1])"


@register("s12_corpus_profile", lambda: f"""
WITH c AS ({CORPUS_DOCUMENTS}),
p AS (SELECT repo, path, content, {_base('path')} AS b, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM c)
SELECT repo, path, CAST(strlen(content) AS BIGINT) AS size, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines,
       sha256(content) AS sha256, substr(sha256(content), 1, 32) AS summary_hash,
       instr(substr(content, 1, 1024), chr(0)) > 0 AS is_binary,
       (strlen(content) >= 1 AND regexp_replace(content, '\\s', '', 'g') <> ''
        AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'vendor', '.venv', 'venv', '__pycache__',
            '.next', 'dist', 'build', 'target', '.idea', '.vscode', '.DS_Store'])
        AND NOT instr(substr(content, 1, 1024), chr(0)) > 0) AS indexable,
       coalesce(CASE ext WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
                WHEN '.mjs' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END, '') AS language,
       (suffix(b, '_test.go') OR suffix(b, '_test.py') OR suffix(b, '_test.js') OR suffix(b, '_test.ts') OR suffix(b, 'test.java')
        OR suffix(b, 'spec.rb') OR contains(b, 'test_') OR contains(b, '_spec.')) AS is_test,
       (b IN ('main.go', 'main.py', 'index.js', 'app.go', 'cmd.go') OR starts_with(b, 'main.')) AS is_entry,
       (contains(path, 'min.js') OR contains(path, '.min.')) AS is_minified,
       CASE WHEN instr(path, '/internal/') > 0 THEN substr(path, instr(path, '/internal/') + 1)
            WHEN instr(path, '/cmd/') > 0 THEN substr(path, instr(path, '/cmd/') + 1)
            WHEN instr(path, '/pkg/') > 0 THEN substr(path, instr(path, '/pkg/') + 1)
            ELSE string_split(path, '/')[-1] END AS short_path
FROM p""")
def q_s12(spark, sf):
    return C.profile(T.corpus_from_documents(spark, sf))


@register("s09_repository_status", lambda: f"""
WITH c AS ({PAGES})
SELECT repo, count(*) AS files, count(DISTINCT nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '')) AS dirs,
       CAST(sum(strlen(content)) AS BIGINT) AS bytes
FROM c GROUP BY repo""")
def q_s09(spark, sf):
    return C.repository_status(T.corpus_from_pages(spark, sf))


@register("s10_repository_metadata", lambda: f"""
WITH c AS ({CORPUS_DOCUMENTS}), t AS (SELECT *, string_split(path, '/')[1] AS top FROM c)
SELECT repo, array_to_string(list_sort(list_distinct(list(top) FILTER (WHERE NOT starts_with(top, '.')))), ',') AS top_level,
       count(*) AS total_files,
       CAST(sum(CASE WHEN instr(substr(content, 1, 1024), chr(0)) > 0 THEN NULL ELSE len(string_split(content, chr(10))) END) AS BIGINT) AS total_lines
FROM t GROUP BY repo""")
def q_s10(spark, sf):
    return C.repository_metadata(T.corpus_from_documents(spark, sf))


@register("a13_directory_rollup", lambda: f"""
WITH c AS ({CORPUS_DOCUMENTS})
SELECT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes
FROM c GROUP BY ROLLUP (repo, regexp_extract(path, '^(.*)/[^/]*$', 1))""")
def q_a13(spark, sf):
    return C.directory_rollup(T.corpus_from_documents(spark, sf))
