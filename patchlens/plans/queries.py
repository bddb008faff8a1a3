"""The registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions import jsontext, prompts, render, text as words
from patchlens.operators import (
    agent, answers, comments, extract, index, inputs, notes, review, review_stats, search,
)
from patchlens.operators.joins import dealt
from patchlens.plans import canned, views
from patchlens.session import shared_dir
from patchlens.sources import store
from patchlens.streaming import webhooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.ELEMENTS, "documents")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.QUERIES, "benchmark")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.FILES, "orders")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Go files made of parts, whose small table is one split: its keys are dealt before the texts are made, as a file takes milliseconds."""
    return dealt(views.table(spark, sf, "part").select("p_partkey"), ["p_partkey"]).selectExpr(*views.columns(views.SOURCES))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").selectExpr(*views.columns(views.REVIEW_INPUTS))


# --- sources and filters ---------------------------------------------------------


@query
def path_prune(spark, sf):
    rows = _elements(spark, sf)
    return rows.select(
        "element_id", "file_path", words.is_indexed_source("file_path").alias("indexed"), words.is_skipped("file_path").alias("skipped")
    )


@query
def detect_language(spark, sf):
    return _elements(spark, sf).select("element_id", words.language_of("file_path").alias("language")).unionByName(
        _files(spark, sf).select(c("file_no").alias("element_id"), words.language_of("file_path").alias("language"))
    )


@query
def extract_elements(spark, sf):
    """Declarations out of Go sources written from the part table, one file per part."""
    rows = extract.extract_elements(_sources(spark, sf))
    return rows.select(
        "framework", "file_path", "package", "type", "name", "line", "signature", "doc", "body", "receiver",
        F.array_join("imports", ",").alias("imports"),
    )


@query
def quarantined_files(spark, sf):
    return extract.quarantine(_sources(spark, sf))


@query
def decl_blocks(spark, sf):
    return extract.blocks(views.table(spark, sf, "documents"), ["doc_id"], "text", start="(?md)^(?=[A-Z])")


@query
def review_inputs(spark, sf):
    raw = views.table(spark, sf, "orders").selectExpr(*views.columns(views.RAW_INPUTS))
    return inputs.assemble_inputs(raw).select("review_id", "file_no", "diff", "full_content", "error")


@query
def request_validation(spark, sf):
    raw = views.table(spark, sf, "orders").selectExpr(*views.columns(views.RAW_INPUTS))
    return inputs.validate_single(raw.drop("error")).select("review_id", "file_no", "error")


@query
def mr_changes(spark, sf):
    change = "named_struct(" + ", ".join(
        f"'{k}', {views.CHANGES[k]}" for k in ("old_path", "new_path", "diff", "deleted_file")
    ) + ")"
    payloads = views.table(spark, sf, "orders").selectExpr(
        f"{views.CHANGES['project_id']} AS project_id",
        f"to_json(named_struct('iid', {views.CHANGES['iid']}, 'title', o_orderpriority, 'changes', array({change}, "
        f"named_struct('old_path', 'a', 'new_path', 'second/m' || CAST(o_orderkey AS STRING), 'diff', '', 'deleted_file', o_orderkey % 2 = 0)))) AS value",
    )
    return inputs.changed_files(payloads).drop("error")


@query
def batch_files(spark, sf):
    file = "named_struct('file_path', {p}, 'diff', o_orderstatus, 'full_content', '')"
    files = ", ".join(file.format(p=p) for p in (views.FILES["file_path"], "'extra.go'"))
    requests = views.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS review_id",
        f"to_json(named_struct('project_id', o_custkey, 'merge_req_id', 7, 'post_to_mr', true, 'files', array({files}))) AS value",
    )
    return inputs.batch_files(requests).withColumn("file_no", c("file_no").cast("bigint")).drop("error")


BROKEN = (
    "CASE o_orderkey % 9 WHEN 0 THEN '{\"files\": [' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"files\": 7, \"changes\": 7, \"iid\": 9}' "
    "WHEN 3 THEN '{\"files\":[7,{\"file_path\":\"b\"}],\"changes\":[7,{\"new_path\":\"b\",\"diff\":\"e\"}],\"iid\":5}' "
    "WHEN 4 THEN '{\"project_id\":\"x\",\"iid\":\"x\",\"id\":8,\"files\":[],\"changes\":[]}' "
    "WHEN 5 THEN '{\"post_to_mr\":\"yes\",\"iid\":2.5,\"changes\":[{\"new_path\":\"c\",\"deleted_file\":\"yes\"}]}' ELSE {good} END"
)


@query
def bad_requests(spark, sf):
    """Batch requests and change lists of which two in three are malformed or hold a value of another type: those are rows with an error."""
    files = "'{\"files\":[{\"file_path\":\"a.go\",\"diff\":\"+x\"}],\"changes\":[{\"new_path\":\"a.go\",\"diff\":\"+x\"}],\"iid\":9}'"
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey AS review_id", "o_orderkey AS project_id", f"{BROKEN.replace('{good}', files)} AS value")
    batch = inputs.batch_files(rows).select("review_id", "file_path", "error", F.lit("batch").alias("source"))
    changed = inputs.changed_files(rows).select(c("project_id").alias("review_id"), "file_path", "error", F.lit("changes").alias("source"))
    return batch.unionByName(changed)


@query
def mr_headers(spark, sf):
    header = "'{\"id\":' || CAST(o_orderkey AS STRING) || ',\"iid\":9,\"title\":\"' || o_orderpriority || '\",\"state\":\"opened\"}'"
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey AS project_id", f"{BROKEN.replace('{good}', header)} AS value")
    return inputs.merge_request_headers(rows).select("project_id", F.coalesce("id", F.lit(-1)).alias("id"), "title", "state", "error")


@query
def file_contents(spark, sf):
    """Changes joined to file contents by (project, ref, path)."""
    changes = views.view(spark, sf, views.CHANGES, "orders").select(
        "project_id", c("new_path").alias("file_path"), "file_no", F.lit("main").alias("ref")
    )
    contents = views.table(spark, sf, "orders").selectExpr(
        f"{views.CHANGES['project_id']} AS project_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'main' ELSE 'old' END AS ref", f"{views.CHANGES['new_path']} AS file_path",
        "'content of ' || CAST(o_orderkey AS STRING) AS content",
    )
    return inputs.with_file_content(changes, contents)


@query
def webhook_route(spark, sf):
    routed = webhooks.route_events(views.view(spark, sf, views.WEBHOOKS, "events")).drop("value")
    return routed.withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("project_id", "iid")})


@query
def repo_urls(spark, sf):
    url = words.repo_url("raw_url")
    return views.view(spark, sf, views.REPOS, "pages").select(
        "page_id", url.alias("url"), words.repo_key(url).alias("repo_key"), words.framework_name("raw_url").alias("name")
    )


# --- index and search ------------------------------------------------------------


@query
def camel_split(spark, sf):
    return _elements(spark, sf).select("element_id", F.array_join(words.camel_words("name"), "|").alias("words"))


@query
def doc_tokens(spark, sf):
    return index.doc_tokens(_elements(spark, sf))


@query
def query_terms(spark, sf):
    return search.query_terms(_queries(spark, sf))


@query
def inverted_index(spark, sf):
    return index.term_freq(_elements(spark, sf))


@query
def framework_catalog(spark, sf):
    return index.framework_catalog(_elements(spark, sf)).withColumn("packages", F.array_join("packages", ","))


@query
def document_round_trip(spark, sf):
    """Elements exported as JSON lines and read back."""
    elements = _elements(spark, sf).select(
        "framework", "type", "name", "package", "file_path", "line", F.lit("").alias("signature"), "doc", "body", F.lit("").alias("receiver"),
        F.array(F.lit("fmt")).alias("imports"), F.array().cast("array<string>").alias("references"),
    )
    catalog = index.framework_catalog(_elements(spark, sf)).withColumns({"repo_url": F.lit("u"), "local_path": F.lit("")})
    path = f"{shared_dir(spark).rstrip('/')}/patchlens/documents-{uuid.uuid4().hex}"
    store.export_documents(elements, catalog, path)
    return store.import_documents(spark, path, lines=True).select("framework", "type", "name", "file_path", "line", "body", F.array_join("imports", ",").alias("imports"))


@query
def stored_search(spark, sf):
    """The elements of stored frameworks, saved twice: the second save replaces, nothing is added."""
    path = f"{shared_dir(spark).rstrip('/')}/patchlens/store-{uuid.uuid4().hex}"
    elements = _elements(spark, sf)
    store.save_frameworks(elements.where("element_id % 2 = 0"), path)
    store.save_frameworks(elements, path)
    stored = store.load_elements(spark, path).groupBy("framework").agg(F.count("*").alias("elements"))
    return stored.join(store.list_frameworks(spark, path), "framework")


@query
def framework_search(spark, sf):
    """Search in the stored index of one framework: elements saved, index and elements loaded by its name."""
    path = f"{shared_dir(spark).rstrip('/')}/patchlens/store-{uuid.uuid4().hex}"
    store.save_frameworks(_elements(spark, sf), path)
    asked = _queries(spark, sf).where("framework = 'de'")
    found = search.search_elements(store.load_framework(spark, path, "de"), store.load_index(spark, path, "de"), asked, 3)
    return found.select("query_id", "rank", "element_id", "score", "name", "package")


@query
def framework_list(spark, sf):
    return _elements(spark, sf).select("framework").distinct().orderBy("framework")


@query
def type_counts(spark, sf):
    return index.type_counts(_elements(spark, sf))


@query
def element_patterns(spark, sf):
    return index.element_patterns(_elements(spark, sf)).select("framework", "pattern", "element_id", "name")


@query
def pattern_counts(spark, sf):
    return index.pattern_counts(_elements(spark, sf))


@query
def search_by_type(spark, sf):
    return index.elements_by_type(_elements(spark, sf), "function", 0).select("element_id", "framework", "name")


@query
def search_by_type_per_framework(spark, sf):
    rows = index.elements_by_type_per_framework(_elements(spark, sf), "method", 7)
    return rows.select("framework", c("position").cast("bigint").alias("position"), "element_id")


@query
def keyword_search(spark, sf):
    return search.search(index.build_index(_elements(spark, sf), scan=True), _queries(spark, sf))


@query
def review_context(spark, sf):
    elements = _elements(spark, sf)
    names = lambda context: F.transform(context, lambda e: render.fmt(e["type"], " ", e["package"], ".", e["name"]))
    rows = search.attach_context(_inputs(spark, sf), elements, index.build_index(elements, scan=True), made=names)
    listed = F.array_join("context", "; ")
    return rows.select("review_id", "file_no", "framework", F.size("context").cast("bigint").alias("n"), listed.alias("context"))


@query
def search_tool_text(spark, sf):
    """Results of the agent's search tool for the benchmark's texts."""
    elements = _elements(spark, sf)
    asked = _queries(spark, sf).select(
        c("query_id").alias("review_id"), F.lit(0).alias("file_no"), "framework", c("query").alias("diff")
    )
    rows = search.attach_context(asked, elements, index.build_index(elements, scan=True), search.TOOL_LIMIT, made=prompts.search_tool_text)
    return rows.select(c("review_id").alias("query_id"), c("context").alias("result"))


# --- text and prompts ------------------------------------------------------------


@query
def synthetic_diff(spark, sf):
    return _elements(spark, sf).select("element_id", words.synthetic_diff("file_path", "body").alias("diff"))


@query
def synthetic_diff_full(spark, sf):
    return _elements(spark, sf).select("element_id", words.synthetic_diff("file_path", "body", full_path=True).alias("diff"))


@query
def truncate_body(spark, sf):
    return _elements(spark, sf).select(
        "element_id", words.short_tool_text("body").alias("tool_text"), words.short_prompt_body("body").alias("prompt_body")
    )


@query
def review_prompt(spark, sf):
    return _inputs(spark, sf).select("review_id", "file_no", prompts.review_prompt("file_path", "diff", "full_content").alias("prompt"))


@query
def framework_prompt(spark, sf):
    """Framework prompts with one or two context elements taken from the row itself."""
    def element(kind):
        return F.struct(
            F.lit(kind).alias("type"), F.lit("pkg").alias("package"), F.concat(F.lit("Item"), c("file_no").cast("string")).alias("name"),
            F.when(c("file_no") % 2 == 0, "Doc.").otherwise("").alias("doc"), c("diff").alias("body"),
        )

    context = F.slice(F.array(element("struct"), element("method")), F.lit(1), (c("file_no") % 3).cast("int"))
    rows = _inputs(spark, sf).withColumn("context", context)
    return rows.select(
        "review_id", "file_no", prompts.framework_system_prompt("framework").alias("system"),
        prompts.framework_prompt("file_path", "diff", "full_content", "framework", "context").alias("prompt"),
    )


@query
def chat_messages(spark, sf):
    rows = views.table(spark, sf, "conversations").withColumn("system", F.when(c("role") == "system", "").otherwise(c("role")))
    shown = F.transform(prompts.messages("system", "text"), lambda m: render.fmt(m["role"], ": ", m["content"]))
    return rows.select("conv_id", "turn", F.array_join(shown, "\n").alias("messages"), prompts.single_prompt("system", "text").alias("single"))


@query
def agent_prompt(spark, sf):
    step = (c("file_no") % 5 + 1).cast("int")
    call = F.struct(F.lit("search_framework").alias("name"), F.lit('{"query":"x"}').alias("args"), F.lit("none").alias("result"))
    calls = F.when(step > 1, F.array(call)).otherwise(F.array().cast(f"array<{agent.CALL_TYPE}>"))
    rows = _inputs(spark, sf).withColumn("calls", calls)
    return rows.select(
        "review_id", "file_no", prompts.agent_system_prompt("framework").alias("system"),
        prompts.agent_step_prompt(step, "file_path", "diff", "calls").alias("prompt"),
    )


@query
def tool_calls(spark, sf):
    return agent.tool_calls(views.view(spark, sf, views.TOOL_ANSWERS, "orders")).select("review_id", "file_no", "tool", "args")


@query
def tool_prompts(spark, sf):
    calls = agent.tool_calls(views.view(spark, sf, views.TOOL_ANSWERS, "orders"))
    return agent.tool_prompts(calls).select("review_id", "file_no", "tool", "system", "user")


# --- answers ---------------------------------------------------------------------


@query
def extract_json(spark, sf):
    return views.view(spark, sf, views.RESPONSES, "orders").select(
        "file_no", jsontext.extract_json("response").alias("found"), jsontext.extract_json("response", string_aware=False).alias("found_plain")
    )


@query
def strip_json_comments(spark, sf):
    return views.view(spark, sf, views.COMMENTED, "orders").select("file_no", jsontext.strip_json_comments("commented").alias("bare"))


@query
def flex_int(spark, sf):
    rows = views.view(spark, sf, views.RISK_TEXTS, "orders").withColumn("value", F.try_parse_json("raw"))
    return rows.select("file_no", jsontext.flex_int(c("value")).alias("risk_score"))


def _issue_text(i):
    return render.fmt(i["type"], "/", i["severity"], "/", i["line"], "/", i["title"], "/", i["description"], "/", i["suggestion"])


@query
def parse_responses(spark, sf):
    rows = answers.parse_responses(views.view(spark, sf, views.RESPONSES, "orders"))
    return rows.select(
        "file_no", "error", c("result.summary").alias("summary"), F.coalesce("result.risk_score", F.lit(-1)).alias("risk_score"),
        c("result.recommendation").alias("recommendation"),
        F.array_join(F.transform("result.issues", _issue_text), "; ").alias("issues"),
    )


@query
def answer_spellings(spark, sf):
    """Answers whose field names are written in other cases, with one field given twice."""
    given = f"replace(replace(replace({views.RESULT_JSON}, '\"issues\"', '\"Issues\"'), '\"severity\"', '\"SEVERITY\"'), '\"summary\"', '\"Summary\"')"
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey AS file_no", f"'{{\"summary\":\"old\",' || substr({given}, 2) AS response")
    return answers.parse_responses(rows).select(
        "file_no", "error", c("result.summary").alias("summary"), F.array_join(F.transform("result.issues", _issue_text), "; ").alias("issues")
    )


# --- reviews ---------------------------------------------------------------------


@query
def review_stats_note(spark, sf):
    return review_stats.review_stats(views.review_results(spark, sf))


QUERIES["review_stats"] = QUERIES.pop("review_stats_note")


@query
def batch_summary(spark, sf):
    return review_stats.batch_summary(views.review_results(spark, sf))


@query
def workflow_stats(spark, sf):
    return review_stats.flow_stats(views.review_results(spark, sf), posted=c("review_id") > 0)


@query
def aggregate_results(spark, sf):
    return review_stats.aggregate_results(views.review_results(spark, sf))


@query
def merged_issues(spark, sf):
    rows = review_stats.merged_issues(views.review_results(spark, sf))
    return rows.withColumn("issue_no", c("issue_no").cast("bigint"))


@query
def critical_gate(spark, sf):
    return review_stats.critical_gate(views.review_results(spark, sf))


@query
def severity_filter(spark, sf):
    issues = review_stats.merged_issues(views.review_results(spark, sf))
    return review_stats.severity_at_least(issues, "medium").select("review_id", "file_no", c("issue_no").cast("bigint").alias("issue_no"), "severity")


@query
def severity_counts(spark, sf):
    """Issue counts by severity threshold over the line items, read as findings."""
    issues = views.view(spark, sf, views.LINE_ISSUES, "lineitem")
    return review_stats.severity_at_least(issues, "high").groupBy("type", "severity").agg(F.count("*").alias("n"))


@query
def max_files(spark, sf):
    return review_stats.first_files(_files(spark, sf), limit=5).select("review_id", "file_no", "file_path")


@query
def mr_summary_note(spark, sf):
    return notes.summary_notes(views.review_results(spark, sf))


@query
def batch_note(spark, sf):
    """Notes of batches; every review whose number is a multiple of 11 has failed files only."""
    results = views.review_results(spark, sf)
    lost = (c("review_id") % 11 == 0) & (c("error") == "")
    return notes.batch_notes(results.withColumn("error", F.when(lost, "lost").otherwise(c("error"))))


@query
def mr_summary_only(spark, sf):
    return notes.summary_notes(views.review_results(spark, sf), summary_only=True)


@query
def workflow_note(spark, sf):
    return notes.flow_notes(views.review_results(spark, sf))


@query
def review_report(spark, sf):
    return notes.file_reports(views.review_results(spark, sf))


@query
def workflow_report(spark, sf):
    return notes.review_reports(views.review_results(spark, sf))


@query
def line_comments(spark, sf):
    results = views.review_results(spark, sf).select(
        (c("review_id") % 100).alias("project_id"), c("review_id").alias("iid"), "file_no", "file_path", "result"
    )
    versions = inputs.merge_request_versions(views.view(spark, sf, views.VERSIONS, "customer"))
    rows = comments.line_comments(results, versions)
    return rows.select(
        "project_id", "iid", "file_no", c("issue_no").cast("bigint").alias("issue_no"), "kind", "body",
        "position.base_sha", "position.start_sha", "position.head_sha", "position.position_type", "position.new_path",
        F.coalesce("position.new_line", F.lit(-1)).alias("new_line"),
    )


@query
def custom_prompt(spark, sf):
    """Requests made with the caller's own templates."""
    user = lambda path, diff, content: F.concat(F.lit("P "), F.col(path), F.lit(" D "), F.col(diff), F.lit(" C "), F.col(content))
    rows = review.review_requests(_inputs(spark, sf), system="be brief", user=user)
    return rows.select("review_id", "file_no", c("messages")[0]["content"].alias("system"), c("messages")[1]["content"].alias("user"))


@query
def custom_tool(spark, sf):
    """One step of tool calls with a tool of the caller's, an unknown one and a refused one."""
    elements = _elements(spark, sf)
    calls = views.table(spark, sf, "orders").selectExpr(
        "o_custkey AS review_id", "o_orderkey AS file_no", "'' AS framework", "false AS framework_found", "'' AS response", "'' AS error",
        "CASE o_orderkey % 3 WHEN 0 THEN 'measure' WHEN 1 THEN 'no_such' ELSE 'suggest_fix' END AS tool",
        "CASE o_orderkey % 3 WHEN 0 THEN to_json(named_struct('of', o_orderpriority)) ELSE '[]' END AS args",
        f"CAST(array() AS ARRAY<{agent.CALL_TYPE}>) AS tool_calls",
    )
    measure = lambda rows: rows.withColumn("tool_result", F.length(F.get_json_object("args", "$.of")).cast("string"))
    done = agent.run_tools(calls, canned.canned_any, elements, index.build_index(elements), {"measure": measure}, attempts=1)
    call = c("tool_calls")[0]
    return done.select("review_id", "file_no", call["name"].alias("tool"), call["result"].alias("tool_result"))


@query
def file_reviews(spark, sf):
    """Prompt, completion, decoding for every file, with canned answers."""
    rows = review.review_files(_inputs(spark, sf), canned.canned_reviews, attempts=1)
    return rows.select(
        "review_id", "file_no", "error", c("result.summary").alias("summary"), F.coalesce("result.risk_score", F.lit(-1)).alias("risk_score"),
        F.coalesce(F.size("result.issues"), F.lit(-1)).cast("bigint").alias("n_issues"),
    )


@query
def retried_reviews(spark, sf):
    """Three attempts under a deadline: some files fail at first, for some the model never replies."""
    asked = canned.slow_reviews
    rows = review.review_files(_inputs(spark, sf), asked, attempts=3, first_wait=0.0, deadline_s=0.25, rows_per_call=1)
    return rows.select(
        "review_id", "file_no", "error", c("result.summary").alias("summary"), F.coalesce("result.risk_score", F.lit(-1)).alias("risk_score")
    )


@query
def routed_reviews(spark, sf):
    """Agent, framework and standard reviews side by side, with canned answers."""
    elements = _elements(spark, sf)
    rows = review.review_all(
        _inputs(spark, sf).withColumn("use_agent", c("file_no") % 3 == 0).withColumn("error", F.when(c("file_no") % 17 == 0, inputs.NO_INPUT).otherwise("")), canned.canned_any, elements, index.build_index(elements, scan=True), attempts=1
    )
    return rows.select(
        "review_id", "file_no", "error", c("result.summary").alias("summary"), F.coalesce("result.risk_score", F.lit(-1)).alias("risk_score"),
        c("result.recommendation").alias("recommendation"),
    )
