"""Prompts with a text that many rows share, and how the rows of routed reviews are dealt."""

import json

import pytest
from pyspark.sql import functions as F
from test_search import ELEMENTS, elements_of

from patchlens.functions import prompts
from patchlens.operators import agent, complete, index, review, search
from patchlens.plans import canned


def echoing():
    def echo(batch):
        return [(json.dumps([m["content"] for m in messages]), None, {"total_tokens": 1}) for messages in batch]

    return echo


@pytest.mark.parametrize("rows, chars", [(2048, 1 << 25), (2, 1)])
def test_shared_texts_reach_every_prompt(spark, monkeypatch, rows, chars):
    """A text that is there, one that is missing, no name at all; names with many rows take several copies of the text."""
    monkeypatch.setattr(complete, "SHARED_ROWS", rows)
    monkeypatch.setattr(complete, "PROMPT_CHARS", chars)
    asked = spark.range(40).selectExpr(
        "id AS file_no", "concat('s', id) AS system", "concat('b', id) AS before", "concat('e', id) AS behind", "CASE id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'lost' END AS ref"
    )
    texts = spark.createDataFrame([("x", " tëxt "), ("y", " other "), ("z", " unused ")], "ref string, shared string")
    got = {r.file_no: (json.loads(r.response), r.error, r.usage.total_tokens) for r in complete.complete_shared(asked, texts, echoing(), ["file_no"]).collect()}
    middle = {0: " tëxt ", 1: " other "}
    assert got == {i: ([f"s{i}", f"b{i}{middle.get(i % 4, '')}e{i}"], "", 1) for i in range(40)}


def framework_inputs(spark):
    return spark.range(30).selectExpr(
        "id AS review_id", "id AS file_no", "concat('a', id, '.go') AS file_path", "IF(id % 2 = 0, '+ request', '+ nothing like it') AS diff",
        "IF(id % 3 = 0, 'whole', '') AS full_content", "IF(id % 5 = 0, '', 'f') AS framework",
    )


def test_framework_prompts_are_sent_whole_and_their_code_once(spark, monkeypatch):
    elements = elements_of(spark, ELEMENTS).withColumn("body", F.col("doc"))
    inputs = framework_inputs(spark)
    rows = search.attach_context(inputs, elements, index.build_index(elements))
    user = prompts.framework_prompt("file_path", "diff", "full_content", "framework", "context")
    want = {r.file_no: [r.system, r.user] for r in rows.select("file_no", prompts.framework_system_prompt("framework").alias("system"), user.alias("user")).collect()}
    sent = {}
    real = review.complete_shared

    def spied(requests, texts, *args, **options):
        sent.update(names=requests.columns, texts=texts.count())
        answered = real(requests, texts, echoing(), *args[1:], **options)
        return answered.withColumn("error", F.concat(F.lit("!"), "response"))

    monkeypatch.setattr(review, "complete_shared", spied)
    out = review.review_files_with_framework(inputs, echoing(), elements, index.build_index(elements), attempts=1)
    assert {r.file_no: json.loads(r.error[1:]) for r in out.collect()} == want
    assert sent["texts"] == 1 and "context" not in sent["names"] and "messages" not in sent["names"]


def test_routed_rows_are_dealt_over_tasks(spark, monkeypatch):
    """Inputs of one split are asked about by many tasks."""
    elements = elements_of(spark, ELEMENTS).withColumn("body", F.col("doc"))
    inputs = framework_inputs(spark).coalesce(1).withColumn("use_agent", F.lit(False)).withColumn("error", F.lit(""))
    stored = {}
    real = review.materialize

    def spied(df, name):
        stored[name] = real(df, name)
        return stored[name]

    monkeypatch.setattr(review, "materialize", spied)
    assert review.review_all(inputs, canned.canned_any, elements, index.build_index(elements), attempts=1).count() == 30
    assert len(stored["routed"].inputFiles()) > 1


@pytest.mark.parametrize("size", [1 << 25, -1])
def test_few_found_texts_go_to_the_rows(spark, monkeypatch, size):
    monkeypatch.setattr(agent, "BROADCAST_BYTES", size)
    joined = []
    real = agent.counted_join
    monkeypatch.setattr(agent, "counted_join", lambda *args: joined.append(1) or real(*args))
    call = "array(named_struct('name', 'search_framework', 'args', '', 'result', CAST(NULL AS STRING)))"
    rows = spark.range(6).selectExpr("id AS review_id", "id AS file_no", f"{call} AS tool_calls", "array(CASE id % 3 WHEN 0 THEN '0/a' WHEN 1 THEN '0/none' END) AS refs")
    texts = spark.createDataFrame([("0/a", "found it")], "ref string, found string")
    shown = {r.file_no: r.shown[0].result for r in agent._with_texts(rows, [texts]).collect()}
    assert shown == {i: ["found it", prompts.NO_MATCH, None][i % 3] for i in range(6)}
    assert bool(joined) == (size < 0)
