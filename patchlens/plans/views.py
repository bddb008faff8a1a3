"""Review data derived from the driver's tables.

Each view is a list of SQL expressions that Spark SQL and DuckDB read alike, so
the queries and their checks start from the same rows. No expression contains a
backslash: the two engines treat it differently inside literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def case(of: str, values: list[str], default: str = "") -> str:
    """`of` is an integer expression, values[i] is the text for i."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {of} {arms} ELSE '{default}' END)"


NL = "chr(10)"

ELEMENTS = {
    "framework": "lang",
    "element_id": "doc_id",
    "type": case("doc_id % 7", ["function", "method", "struct", "interface", "type", "const", "var"]),
    "name": (
        case("doc_id % 6", ["New", "Get", "Set", "Is", "Has"]) + " || 'Item' || CAST(doc_id % 50 AS STRING) || "
        + case("doc_id % 5", ["Handler", "Service", "Repository", "Error"])
    ),
    "package": "source",
    "file_path": (
        "source || '/' || " + case("doc_id % 4", ["pkg", "vendor", "testdata", ".git"])
        + " || '/f' || CAST(doc_id AS STRING) || "
        + case("doc_id % 8", [".go", "_test.go", ".py", ".tsx", ".cc", ".yml", ".md", ".xyz"])
    ),
    "line": "CAST(n_chars % 500 AS INT)",
    "doc": "text",
    "body": "text",
}

QUERIES = {
    "query_id": "item_id",
    "framework": case("item_id % 3", ["en", "fr", "de"]),
    "query": "text || (CASE WHEN item_id % 4 = 0 THEN ' { item } (x) \"get\"' ELSE '' END)",
}

# One order is one reviewed file, one customer one review (or merge request).
_PATH = "'src/m' || CAST(o_orderkey AS STRING) || " + case(
    "o_orderkey % 8", [".go", ".py", ".tsx", ".sql", ".h", ".kts", ".txt", ""]
)
_FAILED = "(o_orderstatus = 'P' AND o_orderkey % 5 = 0)"
FILES = {
    "review_id": "o_custkey",
    "file_no": "o_orderkey",
    "file_path": _PATH,
    "failed": _FAILED,
    "error": f"(CASE WHEN {_FAILED} THEN 'timeout' ELSE '' END)",
    "n_issues": "CAST(o_orderkey % 4 AS INT)",
    "summary": "(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Reviewed ' || CAST(o_orderkey AS STRING) || '.' END)",
    "risk_score": "CAST(o_orderkey % 11 AS BIGINT)",
    "recommendation": (
        "(CASE o_orderpriority WHEN '1-URGENT' THEN 'REQUEST_CHANGES' WHEN '2-HIGH' THEN 'COMMENT' "
        "WHEN '3-MEDIUM' THEN 'ESCALATE' ELSE 'APPROVE' END)"
    ),
}


def issue_fields(i: str) -> dict[str, str]:
    """The fields of issue number `i` (0-based SQL expression) of an order."""
    return {
        "type": case(f"(o_orderkey + {i} * 3) % 5", ["SECURITY", "performance", "QUALITY", "Security", "FRAMEWORK"]),
        "severity": case(f"(o_orderkey + {i}) % 7", ["CRITICAL", "high", "Medium", "LOW", "HIGH", "critical", "NOTE"]),
        "line": f"CAST((o_orderkey + {i}) % 4 AS BIGINT)",
        "title": f"'Finding ' || CAST({i} + 1 AS STRING) || ' of ' || CAST(o_orderkey AS STRING)",
        "description": f"(CASE WHEN (o_orderkey + {i}) % 6 = 0 THEN '' ELSE 'Check the value {{of}} key ' || CAST(o_custkey AS STRING) || '; see http://docs/x' END)",
        "suggestion": f"(CASE WHEN (o_orderkey + {i}) % 3 = 0 THEN 'Use a bound parameter /* here */' ELSE '' END)",
    }


def _issue_json(i: int, line_as_text: bool = False) -> str:
    f = issue_fields(str(i))
    line = f"CAST({f['line']} AS STRING)"
    if line_as_text:
        line = f"'\"' || {line} || '\"'"
    texts = "".join(
        f" || ',\"{k}\":\"' || {f[k]} || '\"'" for k in ("severity", "title", "description", "suggestion")
    )
    return f"('{{\"type\":\"' || {f['type']} || '\",\"line\":' || {line}{texts} || '}}')"


def _issues_json(line_as_text: bool = False) -> str:
    items = [
        f"(CASE WHEN o_orderkey % 4 > {i} THEN '{',' if i else ''}' || {_issue_json(i, line_as_text)} ELSE '' END)"
        for i in range(3)
    ]
    return "'[' || " + " || ".join(items) + " || ']'"


def _result_json(risk: str, line_as_text: bool = False, comments: bool = False) -> str:
    note = f"'// first pass' || {NL} || " if comments else ""
    tail = " || '/* end */'" if comments else ""
    return (
        f"('{{' || {note}'\"issues\":' || {_issues_json(line_as_text)} || ',\"summary\":\"' || {FILES['summary']} || "
        f"'\",\"risk_score\":' || {risk} || ',\"recommendation\":\"' || {FILES['recommendation']} || '\"'{tail} || '}}')"
    )


_RISK = "CAST(o_orderkey % 11 AS STRING)"
RESULT_JSON = _result_json(_RISK)
RESULT_JSON_TEXT_RISK = _result_json(f"'\"risk: ' || {_RISK} || '\"'")
RESULT_JSON_TEXT_LINE = _result_json(_RISK, line_as_text=True)
RESULT_JSON_COMMENTS = _result_json(_RISK, comments=True)

RESPONSE_KIND = "o_orderkey % 8"
RESPONSES = {
    "review_id": "o_custkey",
    "file_no": "o_orderkey",
    "kind": f"CAST({RESPONSE_KIND} AS INT)",
    "response": (
        f"(CASE {RESPONSE_KIND} "
        f"WHEN 0 THEN {RESULT_JSON} "
        f"WHEN 1 THEN 'Here is the review:' || {NL} || '```json' || {NL} || {RESULT_JSON} || {NL} || '```' || {NL} || 'Done {{ok}}.' "
        f"WHEN 2 THEN 'Result: ' || {RESULT_JSON_TEXT_RISK} "
        f"WHEN 3 THEN {RESULT_JSON_COMMENTS} || ' as asked' "
        f"WHEN 4 THEN substr({RESULT_JSON}, 1, length({RESULT_JSON}) - 1) "
        f"WHEN 5 THEN '  Looks good to me.' "
        f"WHEN 6 THEN {RESULT_JSON_TEXT_LINE} "
        f"ELSE '{{\"summary\":null,\"extra\":[1,2]}}' END)"
    ),
}

EXTRACTED = (
    f"(CASE {RESPONSE_KIND} WHEN 0 THEN {RESULT_JSON} WHEN 1 THEN {RESULT_JSON} WHEN 2 THEN {RESULT_JSON_TEXT_RISK} "
    f"WHEN 3 THEN {RESULT_JSON_COMMENTS} WHEN 4 THEN substr({RESULT_JSON}, 1, length({RESULT_JSON}) - 1) "
    f"WHEN 5 THEN '' WHEN 6 THEN {RESULT_JSON_TEXT_LINE} ELSE '{{\"summary\":null,\"extra\":[1,2]}}' END)"
)

# One change per order; every customer is a merge request of project custkey % 100.
CHANGES = {
    "project_id": "CAST(o_custkey % 100 AS BIGINT)",
    "iid": "CAST(o_custkey AS BIGINT)",
    "file_no": "o_orderkey",
    "old_path": _PATH,
    "new_path": f"(CASE WHEN o_orderkey % 7 = 0 THEN 'moved/' ELSE '' END) || {_PATH}",
    "diff": f"'@@ -1 +1 @@' || {NL} || '-old ' || o_orderstatus || {NL} || '+if (x) {{ get item ' || o_orderpriority || ' }}'",
    "deleted_file": "(o_orderkey % 9 = 0)",
}

_ACTION = "(CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'reopen' ELSE 'close' END)"
_KIND = "(CASE WHEN event_type = 'error' THEN 'push' ELSE 'merge_request' END)"
WEBHOOKS = {
    "event_id": "event_id",
    "value": (
        "(CASE WHEN event_id % 50 = 7 THEN '{\"object_kind\": ' ELSE "
        f"'{{\"object_kind\":\"' || {_KIND} || '\",\"project\":{{\"id\":' || CAST(user_id AS STRING) || "
        f"'}},\"object_attributes\":{{\"iid\":' || CAST(event_id AS STRING) || ',\"action\":\"' || {_ACTION} || "
        "'\",\"source_branch\":\"f\",\"target_branch\":\"main\"}}' END)"
    ),
}

_OWNER_REPO = "'owner' || CAST(page_id % 40 AS STRING) || '/repo' || CAST(page_id AS STRING)"
REPOS = {
    "page_id": "page_id",
    "raw_url": (
        "(CASE page_id % 6 "
        f"WHEN 0 THEN 'https://github.com/' || {_OWNER_REPO} || '.git' "
        f"WHEN 1 THEN 'git@github.com:' || {_OWNER_REPO} || '.git' "
        f"WHEN 2 THEN '  github.com/' || {_OWNER_REPO} || ' ' "
        f"WHEN 3 THEN {_OWNER_REPO} "
        "WHEN 4 THEN 'repo' || CAST(page_id AS STRING) ELSE url END)"
    ),
}


def columns(view: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in view.items()]


def select_sql(view: dict[str, str], table: str) -> str:
    """The view as a SELECT that DuckDB runs."""
    return f"SELECT {', '.join(columns(view))} FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, definition: dict[str, str], name: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns(definition))


ISSUE_TYPE = "type string, severity string, line bigint, title string, description string, suggestion string"


def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, file_no, file_path, result, error): one row per order, made within the row."""
    issues = ", ".join(
        "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in issue_fields(str(i)).items()) + ")" for i in range(3)
    )
    result = (
        f"IF({_FAILED}, NULL, named_struct('issues', slice(array({issues}), 1, CAST(o_orderkey % 4 AS INT)), "
        f"'summary', {FILES['summary']}, 'risk_score', {FILES['risk_score']}, 'recommendation', {FILES['recommendation']}))"
    )
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS review_id", "o_orderkey AS file_no", f"{_PATH} AS file_path", f"{result} AS result",
        f"{FILES['error']} AS error",
    )


def files_sql() -> str:
    return f"v_files AS ({select_sql(FILES, 'orders')})"


def issues_sql() -> str:
    """DuckDB rows of every issue: (review_id, file_no, file_path, issue_no, type, ...) without failed files."""
    fields = ", ".join(f"{v} AS {k}" for k, v in issue_fields("issue_no").items())
    return (
        f"v_issues AS (SELECT o_custkey AS review_id, o_orderkey AS file_no, {_PATH} AS file_path, issue_no, {fields} "
        f"FROM orders, (VALUES (0), (1), (2)) n(issue_no) WHERE issue_no < o_orderkey % 4 AND NOT {_FAILED})"
    )


REVIEW_INPUTS = {
    "review_id": "o_custkey",
    "file_no": "o_orderkey",
    "file_path": _PATH,
    "diff": CHANGES["diff"],
    "full_content": "(CASE WHEN o_orderkey % 4 = 1 THEN 'package p' || chr(10) || 'var x = ' || o_orderstatus ELSE '' END)",
    "framework": case("o_orderkey % 6", ["en", "fr", "de", "es", "unknown"]),
    "error": "''",
}

RAW_INPUTS = {
    "review_id": "o_custkey",
    "file_no": "o_orderkey",
    "file_path": f"(CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE {_PATH} END)",
    "diff": "(CASE o_orderkey % 5 WHEN 0 THEN '+given' WHEN 1 THEN '' END)",
    "piped_diff": "(CASE o_orderkey % 4 WHEN 0 THEN '+piped' WHEN 1 THEN '' END)",
    "content": "(CASE WHEN o_orderkey % 3 > 0 THEN 'line one' || chr(10) || o_orderstatus || (CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE '' END) END)",
    "context": "(CASE WHEN o_orderkey % 7 = 0 THEN 'the context' END)",
}

COMMENTED = {
    "file_no": "o_orderkey",
    "commented": (
        "'{\"a\": \"http://x/' || o_orderstatus || '\", // note ' || o_orderpriority || chr(10) || "
        "'/* long' || chr(10) || ' note */\"b\": \"/* kept */ // kept ' || chr(92) || '\" ' || CAST(o_orderkey AS STRING) || '\"}"
        " // end' || (CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '/* open' ELSE '' END)"
    ),
}

RISK_TEXTS = {
    "file_no": "o_orderkey",
    "raw": (
        "(CASE o_orderkey % 12 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN '-' || CAST(o_orderkey AS STRING) "
        "WHEN 2 THEN '\"' || CAST(o_orderkey AS STRING) || '\"' WHEN 3 THEN '\" ' || CAST(o_orderkey AS STRING) || ' \"' "
        "WHEN 4 THEN '\"high: ' || CAST(o_orderkey AS STRING) || '/10\"' WHEN 5 THEN '\"\"' WHEN 6 THEN CAST(o_orderkey AS STRING) || '.5' "
        "WHEN 7 THEN 'true' WHEN 8 THEN 'null' WHEN 9 THEN '{\"n\":1}' WHEN 10 THEN '\"+' || CAST(o_orderkey AS STRING) || '\"' "
        "ELSE '\"0x' || CAST(o_orderkey AS STRING) || '\"' END)"
    ),
}

LINE_ISSUES = {
    "type": "(CASE l_returnflag WHEN 'A' THEN 'SECURITY' WHEN 'R' THEN 'PERFORMANCE' ELSE 'QUALITY' END)",
    "severity": case("l_linenumber", ["", "CRITICAL", "high", "Medium", "LOW", "HIGH", "critical"], "NOTE"),
}

TOOL_ANSWERS = {
    "review_id": "o_custkey",
    "file_no": "o_orderkey",
    "response": (
        "(CASE o_orderkey % 9 "
        "WHEN 0 THEN 'I will search. {\"tool\":\"search_framework\",\"args\":{\"query\":\"get ' || o_orderstatus || '\"}} then' "
        "WHEN 1 THEN '{\"tool\":\"analyze_security\",\"args\":{\"code\":\"f(' || CAST(o_orderkey AS STRING) || ')\"}}' "
        "WHEN 2 THEN '{\"tool\":\"analyze_performance\",\"args\":{\"code\":\"for {' || o_orderstatus || '}\"}}' "
        "WHEN 3 THEN '{\"tool\":\"suggest_fix\",\"args\":{\"issue\":\"slow\",\"original_code\":\"' || o_orderpriority || '\"}}' "
        "WHEN 4 THEN '{\"tool\":\"final_review\",\"args\":{\"summary\":\"s' || CAST(o_orderkey AS STRING) || '\"}}' "
        "WHEN 5 THEN '{\"tool\":\"\",\"args\":{}}' WHEN 6 THEN 'no call at all' WHEN 7 THEN '{\"tool\":\"open' "
        "ELSE '{\"tool\":\"unheard_of\"}' END)"
    ),
}

VERSIONS = {
    "project_id": "CAST(c_custkey % 100 AS BIGINT)",
    "iid": "CAST(c_custkey AS BIGINT)",
    "value": (
        "(CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE '[{\"id\":2,\"head_commit_sha\":\"h' || CAST(c_custkey AS STRING) || "
        "'\",\"base_commit_sha\":\"b' || CAST(c_custkey AS STRING) || '\",\"start_commit_sha\":\"s' || CAST(c_custkey AS STRING) || "
        "'\"},{\"id\":1,\"head_commit_sha\":\"old\",\"base_commit_sha\":\"old\",\"start_commit_sha\":\"old\"}]' END)"
    ),
}

# One Go file per part; every eleventh cannot be read.
_N = "CAST(p_partkey AS STRING)"
SOURCE_TEXT = {
    "head": f"'// Package text.' || {NL} || 'package p' || CAST(p_partkey % 10 AS STRING) || {NL} || {NL} || 'import (' || {NL} || chr(9) || '\"fmt\"' || {NL} || chr(9) || 'x \"a/b' || {_N} || '\"' || {NL} || ')' || {NL} || {NL}",
    "const": f"'// Limits.' || {NL} || 'const (' || {NL} || chr(9) || 'Min' || {_N} || ' = iota // least' || {NL} || chr(9) || 'Max' || {_N} || {NL} || ')' || {NL} || {NL}",
    "type": f"'type Box' || {_N} || ' struct {{' || {NL} || chr(9) || 'text string // {{ open' || {NL} || '}}' || {NL} || {NL}",
    "method": f"'// Get gives the text.' || {NL} || 'func (b *Box' || {_N} || ') Get' || {_N} || '(a, c int, f func(int) error) (string, error) {{' || {NL} || chr(9) || 'return `' || {NL} || 'func no() {{` + fmt.Sprint(a), nil' || {NL} || '}}' || {NL}",
    "broken": f"'func broken( {{' || {NL}",
}
SOURCES = {
    "framework": "'parts'",
    "file_path": f"'pkg' || CAST(p_partkey % 7 AS STRING) || '/f' || {_N} || '.go'",
    "content": " || ".join(SOURCE_TEXT[k] for k in ("head", "const", "type", "method"))
    + f" || (CASE WHEN p_partkey % 11 = 0 THEN {SOURCE_TEXT['broken']} ELSE '' END)",
}
