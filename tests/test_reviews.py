"""Statistics, merged results, notes, comments, inputs and completions."""

import pytest
from pyspark.sql import functions as F

from patchlens.functions import prompts
from patchlens.functions.jsontext import RESULT_TYPE
from patchlens.operators import agent, comments, inputs, notes, review, review_stats
from patchlens.operators.complete import complete, with_retries

SCHEMA = f"review_id bigint, file_no bigint, file_path string, result {RESULT_TYPE}, error string"


def issue(severity, kind="SECURITY", line=1, suggestion=""):
    return (kind, severity, line, "T", "D", suggestion)


def results_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def results(spark):
    return results_of(spark, [
        (1, 1, "a.go", ([issue("critical"), issue("HIGH", "perf")], "first", 7, "COMMENT"), ""),
        (1, 2, "b.go", None, "timeout"),
        (1, 3, "c.go", ([issue("CRITICAL", "Performance", 0)], "second", -30, "APPROVE"), ""),
        (1, 4, "d.go", ([issue("LOW")], "ignored", 1, "APPROVE"), "late error"),
        (2, 1, "e.go", ([], "", 3, "ESCALATE"), ""),
    ])


def by_review(df):
    return {r.review_id: r for r in df.collect()}


def test_three_kinds_of_statistics(results):
    r = by_review(review_stats.review_stats(results))[1]
    assert (r.total_files, r.files_reviewed, r.files_with_error, r.total_issues, r.critical, r.low) == (4, 2, 2, 3, 2, 0)
    assert (r.security_issues, r.perf_issues) == (1, 1)
    r = by_review(review_stats.batch_summary(results))[1]
    assert (r.total_files, r.files_reviewed, r.critical_issues, r.high_issues) == (4, 2, 1, 1)
    r = by_review(review_stats.flow_stats(results))[1]
    assert (r.files_reviewed, r.total_issues, r.critical, r.low) == (4, 4, 1, 1)


def test_merged_result(results):
    merged = by_review(review_stats.aggregate_results(results))
    r = merged[1]
    assert (r.risk_score, r.recommendation, r.summary, r.total_issues) == (-5, "COMMENT", "first (+ other files reviewed)", 4)
    assert (merged[2].recommendation, merged[2].summary) == ("APPROVE", "")
    rows = review_stats.merged_issues(results).orderBy("file_no", "issue_no").collect()
    assert [r.severity for r in rows] == ["critical", "HIGH", "CRITICAL", "LOW"]


def test_gate_threshold_and_limit(results):
    assert {k: r.failed for k, r in by_review(review_stats.critical_gate(results)).items()} == {1: True, 2: False}
    kept = review_stats.severity_at_least(review_stats.merged_issues(results), "HIGH")
    assert sorted(r.severity for r in kept.collect()) == ["CRITICAL", "HIGH", "critical"]
    assert sorted(r.file_no for r in review_stats.first_files(results.where("review_id = 1"), 2).collect()) == [1, 2]


def test_summary_note(results):
    body = by_review(notes.whole_notes(notes.summary_notes(results)))[1].body
    assert body == (
        "## 🤖 Automated Code Review\n\n**Files Reviewed:** 2 / 4\n**Files with Errors:** 2\n**Issues Found:** 3\n\n"
        "### Issues by Severity\n\n| Severity | Count |\n|----------|-------|\n| 🔴 Critical | 2 |\n| 🟠 High | 1 |\n| 🟡 Medium | 0 |\n| 🟢 Low | 0 |\n\n"
        "### Issue Categories\n\n- 🔒 Security Issues: 1\n- ⚡ Performance Issues: 1\n\n"
        "### Detailed Findings\n\n#### 📄 `a.go`\n\n- 🔴 **[SECURITY]** T (line 1)\n  - D\n- 🟠 **[perf]** T (line 1)\n  - D\n\n"
        "#### 📄 `c.go`\n\n- 🔴 **[Performance]** T (line 0)\n  - D\n\n#### 📄 `d.go`\n\n- 🟢 **[SECURITY]** T (line 1)\n  - D\n\n"
        "---\n*Automated review by Code Review Bot*\n"
    )
    only = by_review(notes.whole_notes(notes.summary_notes(results, summary_only=True)))[1].body
    assert "Detailed" not in only and "Categories" in only
    assert "Detailed" not in by_review(notes.whole_notes(notes.summary_notes(results)))[2].body


def test_notes_of_any_size_have_the_same_rows(spark):
    """One review of 5,000 files with sparse numbers: a head, a section each, a foot."""
    rows = [(1, n * 1_000_003, f"f{n}.go", ([issue("LOW")], "", 0, ""), "") for n in range(5_000)]
    parts = notes.summary_notes(results_of(spark, rows)).orderBy("part", "file_no").collect()
    assert [p.part for p in parts] == [0] + [1] * 5_000 + [2]
    assert [p.file_no for p in parts[1:-1]] == [n * 1_000_003 for n in range(5_000)]
    assert parts[0].body.startswith("## ") and "f4999.go" in parts[-2].body


def test_batch_note_leaves_failed_files_out(spark):
    rows = [(1, 1, "a.go", ([issue("LOW")], "", 0, ""), ""), (1, 2, "b.go", None, "timeout"), (2, 1, "c.go", None, "timeout")]
    found = {k: r.body for k, r in by_review(notes.whole_notes(notes.batch_notes(results_of(spark, rows)))).items()}
    assert "**Files Reviewed:** 1 / 1" in found[1] and "Errors" not in found[1]
    assert "**Files Reviewed:** 0 / 0" in found[2]


def test_line_comments(spark, results):
    with_keys = results.withColumn("project_id", F.lit(9)).withColumn("iid", F.col("review_id")).where("review_id = 1")
    payload = '[{"id":1,"head_commit_sha":"abc","base_commit_sha":"def","start_commit_sha":"ghi"},{"id":0,"head_commit_sha":"old"}]'
    versions = inputs.merge_request_versions(spark.createDataFrame([(9, 1, payload)], "project_id int, iid bigint, value string"))
    rows = comments.line_comments(with_keys, versions).orderBy("file_no", "issue_no").collect()
    assert [(r.file_no, r.issue_no, r.kind) for r in rows] == [(1, 0, "discussion"), (1, 1, "discussion"), (4, 0, "discussion")]
    assert rows[0].position.asDict() == {
        "base_sha": "def", "start_sha": "ghi", "head_sha": "abc", "position_type": "text", "new_path": "a.go", "new_line": 1,
    }
    assert rows[0].body == "🔴 **[SECURITY] T**\n\nD"
    none = comments.line_comments(with_keys, versions.where("iid = 0")).orderBy("file_no").first()
    assert (none.kind, none.position, none.body) == ("note", None, "**a.go:1**\n\n🔴 **[SECURITY] T**\n\nD")


def test_changes_and_headers(spark):
    payload = (
        '{"id":5,"iid":42,"title":"t","source_branch":"s","changes":[{"old_path":"a","new_path":"file.go","diff":"+added line"},'
        '{"new_path":"gone.go","deleted_file":true}]}'
    )
    df = spark.createDataFrame([(1, payload)], "project_id int, value string")
    assert [tuple(r) for r in inputs.changed_files(df).collect()] == [(1, 42, 0, "file.go", "+added line", "")]
    head = inputs.merge_request_headers(df).first()
    assert (head.iid, head.title, head.web_url) == (42, "t", None)


PROBES = [
    '{"iid":5,"changes":[7,{"new_path":"b","diff":"e"}]}', '{"iid":"x","changes":[]}', '{"iid":5,"changes":[{"new_path":"b","deleted_file":"yes"}]}',
    '{"iid":5,"changes":{"new_path":"b"}}', '{"iid":5.5}', '{"iid":5,"changes":[{"new_path":["b"]}]}', "[]", "null", "{",
]


def test_wrong_types_are_error_rows(spark):
    """One row with an error for each malformed payload, and none of its fields."""
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "project_id int, value string")
    bad = inputs.changed_files(frame(PROBES)).collect()
    assert sorted((r.project_id, r.file_path, r.error) for r in bad) == [(i, None, inputs.BAD_PAYLOAD) for i in range(len(PROBES))]
    heads = {r.project_id: (r.iid, r.error) for r in inputs.merge_request_headers(frame(['{"iid":7,"title":7}', '{"iid":7,"title":null,"other":[1]}'])).collect()}
    assert heads == {0: (None, inputs.BAD_PAYLOAD), 1: (7, "")}
    fine = inputs.changed_files(frame(['{"iid":5,"changes":[null,{"new_path":"b","diff":null,"more":{}}]}', '{"iid":6,"changes":null}'])).collect()
    assert [(r.project_id, r.iid, r.file_no, r.file_path, r.diff, r.error) for r in fine] == [(0, 5, 0, None, "", ""), (0, 5, 1, "b", "", "")]
    files = frame(['{"files":[{"file_path":1}]}', '{"files":[[]]}', '{"post_to_mr":1}', '{"merge_req_id":true}', '{"files":[{"file_path":"a"}]}'])
    got = inputs.batch_files(files.withColumnRenamed("project_id", "review_id")).collect()
    assert sorted((r.review_id, r.file_path, r.error) for r in got) == [(i, None, inputs.BAD_REQUEST) for i in range(4)] + [(4, "a", "")]


def test_job_input_and_skips(spark):
    df = spark.createDataFrame([("p/a.go", "", "x\n"), ("README.md", "+d", None)], "file_path string, diff string, content string")
    rows = {r.file_path: r for r in inputs.job_input(df).collect()}
    assert rows["p/a.go"].diff.endswith("+++ b/p/a.go\n@@ -0,0 +1,2 @@\n+x\n") and rows["p/a.go"].full_content == "x\n"
    assert rows["README.md"].diff == "+d"
    assert [r.file_path for r in inputs.reviewable(df).collect()] == ["p/a.go"]


def test_retries_ask_failed_rows_only():
    asked = []

    def flaky(batch):
        asked.append([m[0]["content"] for m in batch])
        return [("ok", None, None) if m[0]["content"] == "a" or len(asked) == 3 else (None, "busy", None) for m in batch]

    batch = [[{"role": "user", "content": c}] for c in "abc"]
    assert [r[0] for r in with_retries(flaky, batch, 3, 0.0)] == ["ok"] * 3
    assert asked == [["a", "b", "c"], ["b", "c"], ["b", "c"]]
    down = with_retries(lambda b: 1 / 0, batch[:1], 2, 0.0)
    assert down[0][:2] == (None, "division by zero")


def test_completion_stage(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "no")], "id int, t string").select("id", prompts.messages(F.lit("s"), "t").alias("messages"))

    def reply(batch):
        usage = {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}
        return [(None, "refused", None) if m[1]["content"] == "no" else (m[0]["content"] + m[1]["content"], None, usage) for m in batch]

    rows = {r.id: r for r in complete(df, reply, concurrency=2, attempts=1).collect()}
    assert (rows[1].response, rows[1].error, rows[1].usage.total_tokens) == ("shi", "", 3)
    assert (rows[2].response, rows[2].error, rows[2].usage) == (None, "refused", None)


def test_prompts_are_not_written(spark, monkeypatch):
    """Answers are stored without the prompts they answer: those may hold five whole elements a file."""
    stored = {}

    def kept(df, name):
        stored[name] = df.columns
        return df

    monkeypatch.setattr(review, "materialize", kept)
    monkeypatch.setattr(agent, "materialize", kept)
    reply = lambda batch: [('{"summary": "s"}', None, None)] * len(batch)
    files = spark.createDataFrame([(1, 2, "a.go", "+x", "", "")], "review_id int, file_no int, file_path string, diff string, full_content string, error string")
    row = review.review_files(files, reply, attempts=1).first()
    assert (row.review_id, row.file_no, row.file_path, row.result.summary, row.error) == (1, 2, "a.go", "s", "")
    calls = files.drop("error").selectExpr("*", "'analyze_security' AS tool", "'{\"code\": \"x\"}' AS args", f"CAST(array() AS ARRAY<{agent.CALL_TYPE}>) AS tool_calls")
    done = agent.run_tools(calls, reply, None, None, attempts=1).first()
    assert done.tool_calls[0].result == '{"summary": "s"}'
    assert stored.keys() == {"answers", "tool-answers"} and not {"messages", "system", "user"} & {c for cs in stored.values() for c in cs}
