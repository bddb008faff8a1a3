"""DuckDB SQL that gives each registered query's result by another way.

Where a query decodes text that a view has built, the check starts from the values
the text was built from; searches are checked by testing every pair of word and
term.
"""

from __future__ import annotations

from patchlens.functions import prompts, render
from patchlens.functions.text import LANGUAGE_SUFFIXES
from patchlens.plans import views

ORACLES: dict[str, str] = {}

SPACES = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NL = "chr(10)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def joined(*parts: str) -> str:
    """SQL concatenation; parts are SQL expressions of type text."""
    return "(" + " || ".join(parts) + ")"


def num(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"


V_ELEMENTS = f"v_elements AS ({views.select_sql(views.ELEMENTS, 'documents')})"
V_QUERIES = f"v_queries AS ({views.select_sql(views.QUERIES, 'benchmark')})"
V_FILES = views.files_sql()
V_ISSUES = views.issues_sql()
V_INPUTS = f"v_inputs AS ({views.select_sql(views.REVIEW_INPUTS, 'orders')})"
V_RAW = f"v_raw AS ({views.select_sql(views.RAW_INPUTS, 'orders')})"


def with_views(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


# --- sources and filters ---------------------------------------------------------

LANGUAGE_ROWS = ", ".join(f"('{s}', '{name}')" for name, suffixes in LANGUAGE_SUFFIXES.items() for s in suffixes)


def language_sql(path: str) -> str:
    return f"coalesce((SELECT max(language) FROM (VALUES {LANGUAGE_ROWS}) l(suffix, language) WHERE ends_with({path}, suffix)), 'code')"


ORACLES["document_round_trip"] = with_views(V_ELEMENTS, select="SELECT framework, type, name, file_path, line, body, 'fmt' AS imports FROM v_elements")
ORACLES["stored_search"] = with_views(V_ELEMENTS, select="SELECT framework, count(*) AS elements FROM v_elements GROUP BY framework")
ORACLES["path_prune"] = with_views(V_ELEMENTS, select=r"""
SELECT element_id, file_path,
  NOT regexp_matches(file_path, '(^|/)(vendor|testdata|\.[^/]*)/') AND file_path LIKE '%.go' AND file_path NOT LIKE '%\_test.go' ESCAPE '\' AS indexed,
  file_path LIKE '%.md' OR file_path LIKE '%.txt' OR file_path LIKE 'vendor/%' OR file_path LIKE 'node_modules/%'
    OR file_path LIKE '%.lock' OR file_path LIKE '%.sum' AS skipped
FROM v_elements""")

ORACLES["detect_language"] = with_views(V_ELEMENTS, V_FILES, select=f"""
SELECT element_id, {language_sql('file_path')} AS language FROM v_elements
UNION ALL SELECT file_no, {language_sql('file_path')} FROM v_files""")

_n = "CAST(p_partkey AS VARCHAR)"
_pkg = "'p' || CAST(p_partkey % 10 AS VARCHAR)"
_decl = [
    ("'const'", f"'Min' || {_n}", "11", "''", f"'Limits.' || {NL}", f"'Min' || {_n} || ' = iota'", "''"),
    ("'const'", f"'Max' || {_n}", "12", "''", f"'Limits.' || {NL}", f"'Max' || {_n}", "''"),
    ("'struct'", f"'Box' || {_n}", "15", f"'type Box' || {_n} || ' struct'", "''",
     f"'Box' || {_n} || ' struct {{' || {NL} || chr(9) || 'text string // {{ open' || {NL} || '}}'", "''"),
    ("'method'", f"'Get' || {_n}", "20",
     f"'func (*Box' || {_n} || ') Get' || {_n} || '(a int, c int, f func(int) error) (string, error)'", f"'Get gives the text.' || {NL}",
     f"'func (b *Box' || {_n} || ') Get' || {_n} || '(a, c int, f func(int) error) (string, error) {{' || {NL} || chr(9) || 'return `' || {NL} || 'func no() {{` + fmt.Sprint(a), nil' || {NL} || '}}'",
     f"'*Box' || {_n}"),
]
ORACLES["extract_elements"] = " UNION ALL ".join(
    f"SELECT 'parts' AS framework, {views.SOURCES['file_path']} AS file_path, {_pkg} AS package, {kind} AS type, {name} AS name, "
    f"CAST({line} AS INTEGER) AS line, {signature} AS signature, {doc} AS doc, {body} AS body, {receiver} AS receiver, "
    f"'fmt,a/b' || {_n} AS imports FROM part WHERE p_partkey % 11 <> 0"
    for kind, name, line, signature, doc, body, receiver in _decl
)
ORACLES["quarantined_files"] = (
    f"SELECT 'parts' AS framework, {views.SOURCES['file_path']} AS file_path, 'unbalanced brackets' AS reason FROM part WHERE p_partkey % 11 = 0"
)

# Islands over numbered lines: a running count of starting lines numbers the blocks.
ORACLES["decl_blocks"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS content FROM documents),
numbered AS (
  SELECT *, sum(CASE WHEN regexp_matches(content, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block_no,
    max(line) OVER (PARTITION BY doc_id) AS last_line FROM lines)
SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CAST(min(line) AS BIGINT) AS line,
  CAST(count(*) - max(CASE WHEN line = last_line AND content = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_lines,
  string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT (line = last_line AND content = '')) AS body
FROM numbered WHERE block_no > 0 GROUP BY doc_id, block_no"""


def synthetic_diff_sql(path: str, content: str, full_path: bool) -> str:
    shown = path if full_path else f"regexp_extract({path}, '[^/]*$')"
    lines = f"string_split({content}, {NL})"
    printed = f"(CASE WHEN {content} LIKE '%' || {NL} OR {content} = '' THEN {lines}[:-2] ELSE {lines} END)" if full_path else lines
    return joined(
        "'diff --git a/'", shown, "' b/'", shown, NL, "'new file mode 100644'", NL, "'--- /dev/null'", NL, "'+++ b/'", shown, NL,
        "'@@ -0,0 +1,'", num(f"len({lines})"), "' @@'", NL,
        f"array_to_string(['+' || x || {NL} for x in {printed}], '')",
    )


ORACLES["review_inputs"] = with_views(V_RAW, select=f"""
SELECT review_id, file_no,
  CASE WHEN diff <> '' THEN diff WHEN piped_diff <> '' THEN piped_diff
       WHEN content IS NOT NULL THEN {synthetic_diff_sql("CASE WHEN file_path = '' THEN '.' ELSE file_path END", 'content', False)} ELSE '' END AS diff,
  CASE WHEN context IS NOT NULL THEN context
       WHEN coalesce(diff, '') = '' AND coalesce(piped_diff, '') = '' AND content IS NOT NULL THEN content ELSE '' END AS full_content,
  CASE WHEN coalesce(diff, '') = '' AND coalesce(piped_diff, '') = '' AND content IS NULL THEN 'no input provided' ELSE '' END AS error
FROM v_raw""")

ORACLES["request_validation"] = with_views(V_RAW, select="""
SELECT review_id, file_no,
  CASE WHEN file_path = '' OR coalesce(diff, '') = '' THEN 'file_path and diff are required' ELSE '' END AS error FROM v_raw""")

ORACLES["mr_changes"] = f"""
WITH ch AS ({views.select_sql(views.CHANGES, 'orders')})
SELECT project_id, iid, 0 AS file_no, new_path AS file_path, diff FROM ch WHERE NOT deleted_file
UNION ALL SELECT project_id, iid, 1, 'second/m' || CAST(file_no AS VARCHAR), '' FROM ch WHERE file_no % 2 <> 0"""

ORACLES["batch_files"] = f"""
SELECT o_orderkey AS review_id, o_custkey AS project_id, CAST(7 AS BIGINT) AS merge_req_id, true AS post_to_mr, n AS file_no,
  CASE n WHEN 0 THEN {views.FILES['file_path']} ELSE 'extra.go' END AS file_path, o_orderstatus AS diff, '' AS full_content
FROM orders, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(n)"""

_broken = "o_orderkey % 9 < 6"
ORACLES["bad_requests"] = f"""
SELECT o_orderkey AS review_id, CASE WHEN {_broken} THEN NULL ELSE 'a.go' END AS file_path,
  CASE WHEN {_broken} THEN CASE source WHEN 'batch' THEN 'invalid request' ELSE 'invalid merge request' END ELSE '' END AS error, source
FROM orders, (VALUES ('batch'), ('changes')) t(source)"""
ORACLES["mr_headers"] = """
SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 9 IN (0, 1, 4, 5) THEN CAST(-1 AS BIGINT) WHEN o_orderkey % 9 IN (2, 3) THEN -1 ELSE o_orderkey END AS id,
  CASE WHEN o_orderkey % 9 > 5 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 9 > 5 THEN 'opened' END AS state,
  CASE WHEN o_orderkey % 9 IN (0, 1, 4, 5) THEN 'invalid merge request' ELSE '' END AS error
FROM orders"""

ORACLES["file_contents"] = f"""
WITH ch AS ({views.select_sql(views.CHANGES, 'orders')})
SELECT project_id, 'main' AS ref, new_path AS file_path, file_no,
  CASE WHEN file_no % 3 = 0 THEN 'content of ' || CAST(file_no AS VARCHAR) END AS content FROM ch"""

ORACLES["webhook_route"] = """
SELECT event_id,
  CASE WHEN event_id % 50 <> 7 THEN user_id ELSE -1 END AS project_id,
  CASE WHEN event_id % 50 <> 7 THEN event_id ELSE -1 END AS iid,
  CASE WHEN event_id % 50 = 7 THEN '' WHEN event_type = 'view' THEN 'open' WHEN event_type = 'click' THEN 'update'
       WHEN event_type = 'signup' THEN 'reopen' ELSE 'close' END AS action,
  CASE WHEN event_id % 50 = 7 THEN 'malformed' WHEN event_type IN ('view', 'click', 'signup') THEN 'accepted' ELSE 'ignored' END AS status,
  CASE WHEN event_id % 50 = 7 THEN 'invalid JSON' WHEN event_type = 'error' THEN 'not a merge request event'
       WHEN event_type IN ('view', 'click', 'signup') THEN '' ELSE 'action not relevant' END AS reason
FROM events"""

ORACLES["repo_urls"] = """
WITH r AS (SELECT page_id, url AS page_url, 'owner' || CAST(page_id % 40 AS VARCHAR) AS owner, 'repo' || CAST(page_id AS VARCHAR) AS repo FROM pages)
SELECT page_id,
  CASE WHEN page_id % 6 < 4 THEN 'https://github.com/' || owner || '/' || repo WHEN page_id % 6 = 4 THEN repo ELSE page_url END AS url,
  CASE WHEN page_id % 6 < 4 THEN owner || '-' || repo WHEN page_id % 6 = 4 THEN repo
       ELSE string_split(page_url, '/')[-2] || '-' || string_split(page_url, '/')[-1] END AS repo_key,
  CASE page_id % 6 WHEN 0 THEN repo || '.git' WHEN 1 THEN repo || '.git' WHEN 2 THEN repo || ' ' WHEN 3 THEN repo WHEN 4 THEN repo
       ELSE string_split(rtrim(page_url, '/'), '/')[-1] END AS name
FROM r"""

# --- index and search ------------------------------------------------------------

_CAMEL = "regexp_extract_all(name, '[A-Z]?[^A-Z]+|[A-Z]')"
_DOC_WORDS = f"""SELECT framework, element_id, trim(w, '.,;:!?()[]{{}}') AS w
  FROM (SELECT framework, element_id, unnest(regexp_split_to_array(lower(doc), '{SPACES}')) AS w FROM v_elements)"""
V_TF = f"""tf AS (
  SELECT framework, term, element_id, count(*) AS tf FROM (
    SELECT framework, element_id, lower(name) AS term FROM v_elements
    UNION ALL SELECT framework, element_id, lower(unnest({_CAMEL})) FROM v_elements
    UNION ALL SELECT framework, element_id, lower(package) FROM v_elements
    UNION ALL SELECT framework, element_id, type FROM v_elements
    UNION ALL SELECT framework, element_id, w FROM ({_DOC_WORDS}) WHERE strlen(w) > 3)
  GROUP BY ALL)"""


def words_sql(source: str, keys: str, content: str) -> str:
    """Query words with counts: keys + (word, qtf)."""
    return (
        f"SELECT {keys}, word, count(*) AS qtf FROM (SELECT {keys}, trim(w, '.,;:!?()[]{{}}\"''') AS word FROM "
        f"(SELECT {keys}, unnest(regexp_split_to_array(lower({content}), '{SPACES}')) AS w FROM {source}) WHERE w <> '') GROUP BY ALL"
    )


V_QW = f"qw AS ({words_sql('v_queries', 'query_id, framework', 'query')})"
# Every term against every word of its framework.
V_SCORES = """
  vocab AS (SELECT DISTINCT framework, term FROM tf),
  asked AS (SELECT DISTINCT framework, word FROM qw),
  hits AS (SELECT v.framework, v.term, a.word, 3 + CASE WHEN v.term = a.word THEN 10 ELSE 0 END AS points
    FROM vocab v JOIN asked a ON v.framework = a.framework AND (contains(v.term, a.word) OR contains(a.word, v.term))),
  word_scores AS (SELECT h.framework, h.word, t.element_id, sum(h.points * t.tf) AS s
    FROM hits h JOIN tf t ON h.framework = t.framework AND h.term = t.term GROUP BY ALL),
  scored AS (SELECT q.query_id, q.framework, w.element_id, CAST(sum(q.qtf * w.s) AS BIGINT) AS score
    FROM qw q JOIN word_scores w ON q.framework = w.framework AND q.word = w.word GROUP BY ALL),
  firsts AS (SELECT s.*, e.type, e.name, e.package, e.doc, e.body,
      row_number() OVER (PARTITION BY query_id, e.package || '.' || e.name ORDER BY score DESC, s.element_id) AS n
    FROM scored s JOIN v_elements e ON s.element_id = e.element_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS rank FROM firsts WHERE n = 1)"""

ORACLES["camel_split"] = with_views(V_ELEMENTS, select=f"SELECT element_id, array_to_string({_CAMEL}, '|') AS words FROM v_elements")
ORACLES["doc_tokens"] = with_views(
    V_ELEMENTS, select=f"SELECT framework, element_id, w AS token, count(*) AS n FROM ({_DOC_WORDS}) WHERE strlen(w) > 3 GROUP BY ALL"
)
ORACLES["query_terms"] = with_views(V_QUERIES, V_QW, select="SELECT * FROM qw")
ORACLES["inverted_index"] = with_views(V_ELEMENTS, V_TF, select="SELECT * FROM tf")
ORACLES["framework_catalog"] = with_views(
    V_ELEMENTS,
    select="SELECT framework, count(*) AS element_count, string_agg(DISTINCT package, ',' ORDER BY package) AS packages FROM v_elements GROUP BY framework",
)
ORACLES["framework_list"] = with_views(V_ELEMENTS, select="SELECT DISTINCT framework FROM v_elements")
ORACLES["type_counts"] = with_views(V_ELEMENTS, select="SELECT framework, type, count(*) AS n FROM v_elements GROUP BY ALL")
V_PATTERNS = """patterns AS (
  SELECT framework, type AS pattern, element_id, name FROM v_elements
  UNION ALL SELECT framework, p, element_id, name FROM (SELECT *, CASE
      WHEN name LIKE 'New%' THEN 'constructor' WHEN name LIKE 'Get%' THEN 'getter' WHEN name LIKE 'Set%' THEN 'setter'
      WHEN name LIKE 'Is%' OR name LIKE 'Has%' THEN 'predicate' WHEN name LIKE '%Handler' THEN 'handler'
      WHEN name LIKE '%Service' THEN 'service' WHEN name LIKE '%Repository' THEN 'repository' WHEN name LIKE '%Error' THEN 'error' END AS p
    FROM v_elements) WHERE p IS NOT NULL)"""
ORACLES["element_patterns"] = with_views(V_ELEMENTS, V_PATTERNS, select="SELECT * FROM patterns")
ORACLES["pattern_counts"] = with_views(
    V_ELEMENTS, V_PATTERNS, select="SELECT framework, pattern, count(*) AS n FROM patterns GROUP BY ALL"
)
ORACLES["search_by_type"] = with_views(
    V_ELEMENTS, select="SELECT element_id, framework, name FROM v_elements WHERE type = 'function' ORDER BY element_id LIMIT 20"
)
ORACLES["search_by_type_per_framework"] = with_views(V_ELEMENTS, select="""
SELECT framework, position, element_id FROM (
  SELECT framework, element_id, row_number() OVER (PARTITION BY framework ORDER BY element_id) AS position FROM v_elements WHERE type = 'method')
WHERE position <= 7""")
ORACLES["keyword_search"] = with_views(
    V_ELEMENTS, V_QUERIES, V_TF, V_QW, V_SCORES,
    select="SELECT query_id, framework, rank, element_id, score FROM ranked WHERE rank <= 10",
)
ORACLES["framework_search"] = with_views(
    V_ELEMENTS, V_QUERIES, V_TF, V_QW, V_SCORES,
    select="SELECT query_id, rank, element_id, score, name, package FROM ranked WHERE rank <= 3 AND framework = 'de'",
)
ORACLES["review_context"] = with_views(
    V_ELEMENTS, V_INPUTS, V_TF, f"qw AS ({words_sql('v_inputs', 'file_no AS query_id, framework', 'diff').replace('SELECT file_no AS query_id, framework, word', 'SELECT query_id, framework, word').replace('(SELECT file_no AS query_id, framework, trim', '(SELECT query_id, framework, trim')})",
    V_SCORES,
    select="""
SELECT i.review_id, i.file_no, i.framework, count(r.element_id) AS n,
  coalesce(string_agg(r.type || ' ' || r.package || '.' || r.name, '; ' ORDER BY r.rank), '') AS context
FROM v_inputs i LEFT JOIN ranked r ON i.file_no = r.query_id AND r.rank <= 5 GROUP BY ALL""",
)
ORACLES["search_tool_text"] = with_views(
    V_ELEMENTS, V_QUERIES, V_TF, V_QW, V_SCORES,
    select=f"""
SELECT q.query_id, CASE WHEN count(r.element_id) = 0 THEN {quoted(prompts.NO_MATCH)} ELSE {quoted(prompts.FOUND)} ||
  string_agg('### ' || r.package || '.' || r.name || ' (' || r.type || ')' || {NL} || CASE WHEN r.doc <> '' THEN 'Doc: ' || r.doc || {NL} ELSE '' END
    || '```go' || {NL} || CASE WHEN length(r.body) > 300 THEN left(r.body, 300) || '...' ELSE r.body END || {NL} || '```' || {NL} || {NL}, '' ORDER BY r.rank) END AS result
FROM v_queries q LEFT JOIN ranked r ON q.query_id = r.query_id AND r.rank <= 3 GROUP BY q.query_id""",
)

# --- text and prompts ------------------------------------------------------------

ORACLES["synthetic_diff"] = with_views(
    V_ELEMENTS, select=f"SELECT element_id, {synthetic_diff_sql('file_path', 'body', False)} AS diff FROM v_elements"
)
ORACLES["synthetic_diff_full"] = with_views(
    V_ELEMENTS, select=f"SELECT element_id, {synthetic_diff_sql('file_path', 'body', True)} AS diff FROM v_elements"
)
ORACLES["truncate_body"] = with_views(V_ELEMENTS, select=f"""
SELECT element_id, CASE WHEN length(body) <= 300 THEN body ELSE left(body, 300) || '...' END AS tool_text,
  CASE WHEN length(body) <= 500 THEN body ELSE left(body, 500) || {NL} || '// ... truncated' END AS prompt_body FROM v_elements""")

_lang = language_sql("file_path")
_whole_file = f"CASE WHEN full_content <> '' THEN {NL} || 'The whole file:' || {NL} || '```' || {_lang} || {NL} || full_content || {NL} || '```' || {NL} ELSE '' END"
ORACLES["review_prompt"] = with_views(V_INPUTS, select=f"""
SELECT review_id, file_no, {joined("'Review this '", _lang, "' change.'", NL, NL, "'File: '", "file_path", NL, NL, "'```diff'", NL, "diff", NL, "'```'", NL,
    _whole_file, NL, "'Reply with JSON only.'", NL)} AS prompt FROM v_inputs""")


def _context_sql(kind: str) -> str:
    return joined(
        NL, f"'{kind} pkg.Item'", num("file_no"), NL, f"CASE WHEN file_no % 2 = 0 THEN 'Doc.' || {NL} ELSE '' END",
        "'```go'", NL, "diff", NL, "'```'", NL,
    )


ORACLES["framework_prompt"] = with_views(V_INPUTS, select=f"""
SELECT review_id, file_no, {joined(quoted(prompts.FRAMEWORK_SYSTEM_PARTS[0]), "framework", quoted(prompts.FRAMEWORK_SYSTEM_PARTS[1]))} AS system,
  {joined("'Review this '", _lang, "' change against the framework \"'", "framework", "'\".'", NL, NL, "'File: '", "file_path", NL, NL, "'```diff'", NL,
    "diff", NL, "'```'", NL,
    f"CASE WHEN file_no % 3 > 0 THEN {NL} || 'Related framework code:' || {NL} ELSE '' END",
    f"CASE WHEN file_no % 3 > 0 THEN {_context_sql('struct')} ELSE '' END", f"CASE WHEN file_no % 3 > 1 THEN {_context_sql('method')} ELSE '' END",
    _whole_file, NL, "'Compare the change with the framework code before you judge it.'", NL,
    "'Reply with JSON only.'", NL)} AS prompt
FROM v_inputs""")

ORACLES["chat_messages"] = f"""
SELECT conv_id, turn, 'system: ' || s || {NL} || 'user: ' || text AS messages, CASE WHEN s <> '' THEN s || {NL} || {NL} ELSE '' END || text AS single
FROM (SELECT *, CASE WHEN role = 'system' THEN '' ELSE role END AS s FROM conversations)"""

ORACLES["agent_prompt"] = with_views(V_INPUTS, select=f"""
SELECT review_id, file_no,
  {quoted(prompts.AGENT_SYSTEM)} || CASE WHEN framework <> '' THEN {NL} || 'The project uses the framework ''' || framework || '''.' || {NL} ELSE '' END AS system,
  {joined("'## Review, step '", num("file_no % 5 + 1"), "'/5'", NL, NL, "'File: '", "file_path", NL, NL, "'```diff'", NL, "diff", NL, "'```'", NL, NL,
    f"CASE WHEN file_no % 5 > 0 THEN '## Tool results so far' || {NL} || {NL} || '### search_framework' || {NL} || 'Args: {{\"query\":\"x\"}}' || {NL} || 'Result: none' || {NL} || {NL} ELSE '' END",
    "'## Task'", NL,
    f"CASE file_no % 5 + 1 WHEN 1 THEN {quoted(prompts.FIRST_TASK)} WHEN 4 THEN {quoted(prompts.LAST_TASK)} WHEN 5 THEN {quoted(prompts.LAST_TASK)} ELSE {quoted(prompts.MIDDLE_TASK)} END")} AS prompt
FROM v_inputs""")

ORACLES["tool_calls"] = """
SELECT o_custkey AS review_id, o_orderkey AS file_no,
  CASE o_orderkey % 9 WHEN 0 THEN 'search_framework' WHEN 1 THEN 'analyze_security' WHEN 2 THEN 'analyze_performance' WHEN 3 THEN 'suggest_fix'
    WHEN 4 THEN 'final_review' WHEN 8 THEN 'unheard_of' END AS tool,
  CASE o_orderkey % 9 WHEN 0 THEN '{"query":"get ' || o_orderstatus || '"}' WHEN 1 THEN '{"code":"f(' || CAST(o_orderkey AS VARCHAR) || ')"}'
    WHEN 2 THEN '{"code":"for {' || o_orderstatus || '}"}' WHEN 3 THEN '{"issue":"slow","original_code":"' || o_orderpriority || '"}'
    WHEN 4 THEN '{"summary":"s' || CAST(o_orderkey AS VARCHAR) || '"}' END AS args
FROM orders"""

_SEC = "'How could this code be abused?'"
_PERF = "'What does this code cost as its input grows?'"
ORACLES["tool_prompts"] = f"""
SELECT o_custkey AS review_id, o_orderkey AS file_no,
  CASE o_orderkey % 9 WHEN 1 THEN 'analyze_security' WHEN 2 THEN 'analyze_performance' ELSE 'suggest_fix' END AS tool,
  CASE o_orderkey % 9 WHEN 1 THEN {quoted(prompts.SECURITY_SYSTEM)} WHEN 2 THEN {quoted(prompts.PERFORMANCE_SYSTEM)} ELSE {quoted(prompts.FIX_SYSTEM)} END AS system,
  CASE o_orderkey % 9 WHEN 1 THEN {_SEC} || {NL} || '```' || {NL} || 'f(' || CAST(o_orderkey AS VARCHAR) || ')' || {NL} || '```' || {NL}
    WHEN 2 THEN {_PERF} || {NL} || '```' || {NL} || 'for {{' || o_orderstatus || '}}' || {NL} || '```' || {NL}
    ELSE 'Issue: slow' || {NL} || {NL} || 'Code:' || {NL} || '```' || {NL} || o_orderpriority || {NL} || '```' || {NL} END AS user
FROM orders WHERE o_orderkey % 9 IN (1, 2, 3)"""

# --- answers ---------------------------------------------------------------------

ORACLES["extract_json"] = f"""
SELECT file_no, found, CASE WHEN kind = 4 THEN '' ELSE found END AS found_plain
FROM (SELECT o_orderkey AS file_no, o_orderkey % 8 AS kind, {views.EXTRACTED} AS found FROM orders)"""

ORACLES["strip_json_comments"] = f"""
SELECT o_orderkey AS file_no, '{{"a": "http://x/' || o_orderstatus || '", ' || {NL} || '"b": "/* kept */ // kept ' || chr(92) || '" ' || CAST(o_orderkey AS VARCHAR)
  || '"}} ' || CASE WHEN o_orderkey % 2 = 0 THEN {NL} ELSE '' END AS bare FROM orders"""

ORACLES["flex_int"] = """
SELECT o_orderkey AS file_no, CAST(CASE o_orderkey % 12 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey WHEN 2 THEN o_orderkey WHEN 3 THEN o_orderkey
  WHEN 4 THEN o_orderkey WHEN 10 THEN o_orderkey WHEN 11 THEN o_orderkey ELSE 0 END AS BIGINT) AS risk_score FROM orders"""

V_ALL_ISSUES = (
    "all_issues AS (SELECT o_orderkey AS file_no, issue_no, "
    + ", ".join(f"{v} AS {k}" for k, v in views.issue_fields("issue_no").items())
    + " FROM orders, (VALUES (0), (1), (2)) n(issue_no) WHERE issue_no < o_orderkey % 4)"
)
_ISSUE_TEXT = "type || '/' || severity || '/' || CAST(line AS VARCHAR) || '/' || title || '/' || description || '/' || suggestion"
ORACLES["parse_responses"] = with_views(V_ALL_ISSUES, f"f AS (SELECT *, file_no % 8 AS kind FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in views.FILES.items())} FROM orders))", select=f"""
SELECT f.file_no,
  CASE WHEN kind = 5 THEN 'no JSON found in response' WHEN kind = 4 OR (kind = 6 AND n_issues > 0) THEN 'invalid review JSON' ELSE '' END AS error,
  CASE WHEN kind IN (4, 5) OR (kind = 6 AND n_issues > 0) THEN NULL WHEN kind = 7 THEN '' ELSE summary END AS summary,
  CASE WHEN kind IN (4, 5) OR (kind = 6 AND n_issues > 0) THEN -1 WHEN kind = 7 THEN 0 ELSE risk_score END AS risk_score,
  CASE WHEN kind IN (4, 5) OR (kind = 6 AND n_issues > 0) THEN NULL WHEN kind = 7 THEN '' ELSE recommendation END AS recommendation,
  CASE WHEN kind IN (4, 5) OR (kind = 6 AND n_issues > 0) THEN NULL WHEN kind = 7 THEN ''
    ELSE coalesce((SELECT string_agg({_ISSUE_TEXT}, '; ' ORDER BY issue_no) FROM all_issues i WHERE i.file_no = f.file_no), '') END AS issues
FROM f""")

ORACLES["answer_spellings"] = with_views(V_ALL_ISSUES, f"f AS (SELECT {', '.join(f'{v} AS {k}' for k, v in views.FILES.items())} FROM orders)", select=f"""
SELECT f.file_no, '' AS error, summary,
  coalesce((SELECT string_agg({_ISSUE_TEXT}, '; ' ORDER BY issue_no) FROM all_issues i WHERE i.file_no = f.file_no), '') AS issues
FROM f""")

# --- reviews ---------------------------------------------------------------------


def stats_sql(any_case: bool, flow: bool = False) -> str:
    """CTE s: statistics per review out of the flat files and issues."""
    severity = "upper(severity)" if any_case else "severity"
    kind = "upper(type)" if any_case else "type"
    reviewed = "count(*)" if flow else "count(*) FILTER (WHERE NOT failed)"
    return f"""
  fs AS (SELECT review_id, count(*) AS total_files, {reviewed} AS files_reviewed, count(*) FILTER (WHERE failed) AS files_with_error FROM v_files GROUP BY review_id),
  iss AS (SELECT review_id, count(*) AS total_issues, count(*) FILTER (WHERE {severity} = 'CRITICAL') AS critical, count(*) FILTER (WHERE {severity} = 'HIGH') AS high,
    count(*) FILTER (WHERE {severity} = 'MEDIUM') AS medium, count(*) FILTER (WHERE {severity} = 'LOW') AS low,
    count(*) FILTER (WHERE {kind} = 'SECURITY') AS security_issues, count(*) FILTER (WHERE {kind} = 'PERFORMANCE') AS perf_issues FROM v_issues GROUP BY review_id),
  s AS (SELECT fs.*, coalesce(total_issues, 0) AS total_issues, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
    coalesce(low, 0) AS low, coalesce(security_issues, 0) AS security_issues, coalesce(perf_issues, 0) AS perf_issues FROM fs LEFT JOIN iss USING (review_id))"""


ORACLES["review_stats"] = with_views(V_FILES, V_ISSUES, stats_sql(True), select="SELECT * FROM s")
ORACLES["batch_summary"] = with_views(V_FILES, V_ISSUES, stats_sql(False), select="""
SELECT review_id, total_files, files_reviewed, total_issues, critical AS critical_issues, high AS high_issues, medium AS medium_issues, low AS low_issues FROM s""")
ORACLES["workflow_stats"] = with_views(V_FILES, V_ISSUES, stats_sql(False, flow=True), select="""
SELECT review_id, files_reviewed, total_issues, critical, high, medium, low, review_id > 0 AS posted FROM s""")

V_MERGED = """merged AS (
  SELECT review_id, count(*) AS files_reviewed, CAST(coalesce(sum(CASE WHEN failed THEN 0 ELSE risk_score END), 0) // count(*) AS BIGINT) AS risk_score,
    coalesce(min_by(summary, file_no) FILTER (WHERE NOT failed AND summary <> ''), '')
      || CASE WHEN count(*) FILTER (WHERE NOT failed AND summary <> '') > 1 THEN ' (+ other files reviewed)' ELSE '' END AS summary,
    CASE WHEN bool_or(NOT failed AND recommendation = 'REQUEST_CHANGES') THEN 'REQUEST_CHANGES'
         WHEN bool_or(NOT failed AND recommendation = 'COMMENT') THEN 'COMMENT' ELSE 'APPROVE' END AS recommendation
  FROM v_files GROUP BY review_id)"""
ORACLES["aggregate_results"] = with_views(V_FILES, V_ISSUES, V_MERGED, select=f"""
SELECT m.review_id, files_reviewed, coalesce(n, 0) AS total_issues, risk_score, summary, recommendation
FROM merged m LEFT JOIN (SELECT review_id, count(*) AS n FROM v_issues GROUP BY review_id) i USING (review_id)""")
ORACLES["merged_issues"] = with_views(V_ISSUES, select="SELECT * REPLACE (CAST(issue_no AS BIGINT) AS issue_no) FROM v_issues")
ORACLES["critical_gate"] = with_views(V_FILES, V_ISSUES, select="""
SELECT DISTINCT review_id, review_id IN (SELECT review_id FROM v_issues WHERE severity = 'CRITICAL') AS failed FROM v_files""")
ORACLES["severity_filter"] = with_views(V_ISSUES, select="""
SELECT review_id, file_no, CAST(issue_no AS BIGINT) AS issue_no, severity FROM v_issues WHERE upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM')""")
ORACLES["severity_counts"] = f"""
WITH li AS ({views.select_sql(views.LINE_ISSUES, 'lineitem')})
SELECT type, severity, count(*) AS n FROM li WHERE upper(severity) IN ('CRITICAL', 'HIGH') GROUP BY ALL"""
ORACLES["max_files"] = with_views(V_FILES, select="""
SELECT review_id, file_no, file_path FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY file_no) AS n FROM v_files) WHERE n <= 5""")


def mark_sql(severity: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in render.SEVERITY_MARKS.items())
    return f"(CASE {severity} {arms} ELSE '{render.OTHER_MARK}' END)"


_head = joined(
    "'## 🤖 Automated Code Review'", NL, NL, "'**Files Reviewed:** '", num("files_reviewed"), "' / '", num("total_files"), NL,
    f"CASE WHEN files_with_error > 0 THEN '**Files with Errors:** ' || {num('files_with_error')} || {NL} ELSE '' END",
    "'**Issues Found:** '", num("total_issues"), NL, NL, "'### Issues by Severity'", NL, NL, "'| Severity | Count |'", NL, "'|----------|-------|'", NL,
    "'| 🔴 Critical | '", num("critical"), "' |'", NL, "'| 🟠 High | '", num("high"), "' |'", NL, "'| 🟡 Medium | '", num("medium"), "' |'", NL,
    "'| 🟢 Low | '", num("low"), "' |'", NL, NL,
    f"CASE WHEN security_issues > 0 OR perf_issues > 0 THEN '### Issue Categories' || {NL} || {NL} ELSE '' END",
    f"CASE WHEN security_issues > 0 THEN '- 🔒 Security Issues: ' || {num('security_issues')} || {NL} ELSE '' END",
    f"CASE WHEN perf_issues > 0 THEN '- ⚡ Performance Issues: ' || {num('perf_issues')} || {NL} ELSE '' END",
    f"CASE WHEN security_issues > 0 OR perf_issues > 0 THEN {NL} ELSE '' END",
)
_foot = joined("'---'", NL, "'*Automated review by Code Review Bot*'", NL)
_line = joined(
    "'- '", mark_sql("upper(severity)"), "' **['", "type", "']** '", "title", "' (line '", num("line"), "')'", NL,
    f"CASE WHEN description <> '' THEN '  - ' || description || {NL} ELSE '' END",
    f"CASE WHEN suggestion <> '' THEN '  - 💡 ' || suggestion || {NL} ELSE '' END",
)
V_SECTIONS = f"""sections AS (
    SELECT review_id, file_no, '#### 📄 `' || file_path || '`' || {NL} || {NL} || string_agg({_line}, '' ORDER BY issue_no) || {NL} AS section
    FROM v_issues GROUP BY review_id, file_no, file_path)"""


def note_sql(head: str, foot: str, shown: str = "true", sections: str = "sections", stats: str = "s") -> str:
    """Rows of notes: head and foot of every review, the sections of those that show them."""
    none = "CAST(NULL AS BIGINT) AS file_no"
    return f"""
SELECT review_id, 0 AS part, {none}, {head} AS body FROM {stats}
UNION ALL SELECT review_id, 2 AS part, {none}, {foot} AS body FROM {stats}
UNION ALL SELECT review_id, 1 AS part, file_no, section AS body FROM {sections} JOIN {stats} USING (review_id) WHERE {shown}"""


_titled = f"{_head} || CASE WHEN total_issues > 0 THEN '### Detailed Findings' || {NL} || {NL} ELSE '' END"
ORACLES["mr_summary_note"] = with_views(V_FILES, V_ISSUES, stats_sql(True), V_SECTIONS, select=note_sql(_titled, _foot, "total_issues > 0"))
_all = [v.replace(f"v_{n} AS", f"all_{n} AS", 1).replace("v_files", "all_files") for v, n in ((V_FILES, "files"), (V_ISSUES, "issues"))]
ORACLES["batch_note"] = with_views(
    *_all, "v_files AS (SELECT * FROM all_files WHERE NOT failed AND review_id % 11 <> 0)", "v_issues AS (SELECT * FROM all_issues WHERE review_id % 11 <> 0)",
    stats_sql(True), """nothing AS (
    SELECT * FROM s UNION ALL SELECT review_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT review_id FROM all_files WHERE review_id NOT IN (SELECT review_id FROM v_files)))""",
    V_SECTIONS, select=note_sql(_titled, _foot, "total_issues > 0", stats="nothing"),
)
ORACLES["mr_summary_only"] = with_views(V_FILES, V_ISSUES, stats_sql(True), V_SECTIONS, select=note_sql(_head, _foot, "false"))

_flow_line = joined(
    "'- '", mark_sql("severity"), "' **['", "type", "']** '", "title", "' (line '", num("line"), "')'", NL, "'  - '", "description", NL,
    f"CASE WHEN suggestion <> '' THEN '  - 💡 ' || suggestion || {NL} ELSE '' END",
)
_flow_head = joined(
    "'## 🤖 Automated Code Review'", NL, NL, "'**Files Reviewed:** '", num("files_reviewed"), NL,
    "'**Issues Found:** '", num("total_issues"), NL, NL, "'| Severity | Count |'", NL, "'|----------|-------|'", NL,
    "'| 🔴 Critical | '", num("critical"), "' |'", NL, "'| 🟠 High | '", num("high"), "' |'", NL, "'| 🟡 Medium | '", num("medium"), "' |'", NL,
    "'| 🟢 Low | '", num("low"), "' |'", NL, NL, f"CASE WHEN total_issues > 0 THEN '### Issues' || {NL} || {NL} ELSE '' END",
)
ORACLES["workflow_note"] = with_views(V_FILES, V_ISSUES, stats_sql(False, flow=True), f"""
  sections AS (SELECT review_id, file_no, '**' || file_path || '**' || {NL} || string_agg({_flow_line}, '' ORDER BY issue_no) || {NL} AS section
    FROM v_issues GROUP BY review_id, file_no, file_path)""", select=note_sql(_flow_head, joined(NL, "'---'", NL, "'*Automated review by Code Review Bot*'")))

_label = "(CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN '[' || severity || ']' ELSE '[INFO]' END)"
_report_line = joined("'  '", _label, "' ['", "type", "'] '", "title", "' (Line '", num("line"), "')'", NL, "'     '", "description", NL)
_rule = "repeat('=', 60)"
ORACLES["review_report"] = with_views(V_FILES, V_ISSUES, select=f"""
SELECT f.review_id, f.file_no, {joined(NL, _rule, NL, "'Risk Score: '", num("risk_score"), "'/10 | Recommendation: '", "recommendation", NL,
  "'Issues Found: '", num("n_issues"), NL, f"CASE WHEN n_issues > 0 THEN {NL} || lines ELSE '' END", NL, "'Summary: '", "summary", NL, _rule, NL)} AS report
FROM v_files f LEFT JOIN (SELECT file_no, string_agg({_report_line}, '' ORDER BY issue_no) AS lines FROM v_issues GROUP BY file_no) i USING (file_no)
WHERE NOT failed""")
_report_head = joined(
    NL, "'Files Reviewed: '", num("files_reviewed"), NL, "'Total Issues: '", num("coalesce(n, 0)"), NL, "'Recommendation: '", "recommendation", NL,
    "'Risk Score: '", num("risk_score"), "'/10'", NL, f"CASE WHEN n > 0 THEN {NL} || 'Issues:' || {NL} ELSE '' END",
)
ORACLES["workflow_report"] = with_views(V_FILES, V_ISSUES, V_MERGED, f"""
  s AS (SELECT * FROM merged LEFT JOIN (SELECT review_id, count(*) AS n FROM v_issues GROUP BY review_id) i USING (review_id)),
  sections AS (SELECT review_id, file_no, string_agg({joined("'  ['", "severity", "'] '", "type", "' (line '", num("line"), "'): '", "title", NL)}, '' ORDER BY issue_no) AS section
    FROM v_issues GROUP BY review_id, file_no)""", select=note_sql(_report_head, "''"))

_comment = joined(
    mark_sql("upper(severity)"), "' **['", "upper(type)", "'] '", "title", "'**'", NL, NL, "description",
    f"CASE WHEN suggestion <> '' THEN {NL} || {NL} || '💡 **Suggestion:** ' || suggestion ELSE '' END",
)
ORACLES["line_comments"] = with_views(V_ISSUES, select=f"""
SELECT review_id % 100 AS project_id, review_id AS iid, file_no, CAST(issue_no AS BIGINT) AS issue_no,
  CASE WHEN known THEN 'discussion' ELSE 'note' END AS kind,
  CASE WHEN known THEN '' ELSE '**' || file_path || ':' || {num('line')} || '**' || {NL} || {NL} END || {_comment} AS body,
  CASE WHEN known THEN 'b' || {num('review_id')} END AS base_sha, CASE WHEN known THEN 's' || {num('review_id')} END AS start_sha,
  CASE WHEN known THEN 'h' || {num('review_id')} END AS head_sha, CASE WHEN known THEN 'text' END AS position_type,
  CASE WHEN known THEN file_path END AS new_path, CASE WHEN known THEN line ELSE -1 END AS new_line
FROM (SELECT i.*, c_custkey IS NOT NULL AND c_custkey % 3 <> 0 AS known FROM v_issues i LEFT JOIN customer ON review_id = c_custkey) WHERE line > 0""")

ORACLES["custom_prompt"] = with_views(V_INPUTS, select="""
SELECT review_id, file_no, 'be brief' AS system, 'P ' || file_path || ' D ' || diff || ' C ' || full_content AS user FROM v_inputs""")
ORACLES["custom_tool"] = """
SELECT o_custkey AS review_id, o_orderkey AS file_no, CASE o_orderkey % 3 WHEN 0 THEN 'measure' WHEN 1 THEN 'no_such' ELSE 'suggest_fix' END AS tool,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(length(o_orderpriority) AS VARCHAR) WHEN 1 THEN 'Error: unknown tool: no_such' ELSE 'Error: invalid arguments' END AS tool_result
FROM orders"""
_canned = """CASE WHEN file_no % 7 = 0 THEN 'service unavailable' WHEN file_no % 5 = 0 THEN 'no JSON found in response' ELSE '' END"""
ORACLES["file_reviews"] = f"""
SELECT review_id, file_no, error, CASE WHEN error = '' THEN 'file ' || CAST(file_no AS VARCHAR) END AS summary,
  CASE WHEN error = '' THEN file_no % 10 ELSE -1 END AS risk_score, CASE WHEN error = '' THEN file_no % 2 ELSE -1 END AS n_issues
FROM (SELECT o_custkey AS review_id, o_orderkey AS file_no, {_canned.replace('file_no', 'o_orderkey')} AS error FROM orders)"""
ORACLES["retried_reviews"] = """
SELECT review_id, file_no, error, CASE WHEN error = '' THEN 'file ' || CAST(file_no AS VARCHAR) END AS summary, CASE WHEN error = '' THEN file_no % 10 ELSE -1 END AS risk_score
FROM (SELECT o_custkey AS review_id, o_orderkey AS file_no, CASE WHEN o_orderkey % 997 = 0 THEN 'no reply within 0.25 s' ELSE '' END AS error FROM orders)"""
ORACLES["routed_reviews"] = f"""
SELECT review_id, file_no, error,
  CASE WHEN error <> '' THEN NULL WHEN stuck THEN 'Review completed after maximum steps.' ELSE 'file ' || CAST(file_no AS VARCHAR) END AS summary,
  CASE WHEN error <> '' THEN -1 WHEN stuck THEN 0 ELSE file_no % 10 END AS risk_score,
  CASE WHEN error <> '' THEN NULL WHEN stuck THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS recommendation
FROM (SELECT review_id, file_no, agent AND file_no % 13 = 0 AS stuck,
    CASE WHEN file_no % 17 = 0 THEN 'no input provided' WHEN agent THEN CASE WHEN file_no % 11 = 0 THEN 'step 1: service unavailable' ELSE '' END ELSE {_canned} END AS error
  FROM (SELECT o_custkey AS review_id, o_orderkey AS file_no, o_orderkey % 3 = 0 AS agent FROM orders))"""
