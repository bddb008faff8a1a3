"""Step-wise reviews with tools, for all open rows at once.

Each of at most five steps is one job over the rows that are still open: prompt,
completion, tool call, tool result. Completions are written to the shared folder,
so a lost executor never makes the model answer twice and the plan does not grow
from step to step. What a search found is stored once, however many rows asked for it:
the rows carry its name, and get the text when their prompt is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import prompts
from patchlens.functions.jsontext import RESULT_TYPE, decode_result, extract_json
from patchlens.functions.text import let, text, trim_space
from patchlens.operators.complete import CompleteFn, complete
from patchlens.operators.index import KeywordIndex
from patchlens.operators.joins import counted_join, dealt
from patchlens.operators.search import TOOL_LIMIT, searched_contexts
from patchlens.session import materialize

ToolFn = Callable[[DataFrame], DataFrame]
CALL_TYPE = "struct<name:string,args:string,result:string>"
MODEL_TOOLS = ["analyze_security", "analyze_performance", "suggest_fix"]
OUT_OF_STEPS = "Review completed after maximum steps."  # fixed value
FINAL_DONE = "Review completed."
BAD_ARGS = "Error: invalid arguments"
BROADCAST_BYTES = 1 << 25  # of found texts that are sent to all tasks


def tool_calls(answers: DataFrame, response: str = "response") -> DataFrame:
    """Add (tool, args): the call in each answer, both null if there is none.

    The call is the first JSON object of the answer, braces in strings counted; it
    needs a non-empty `tool`. `args` is its arguments as JSON text.
    """
    def call(value: Column) -> Column:
        tool = F.try_variant_get(value, "$.tool", "variant")
        name = F.when(F.schema_of_variant(tool) == "STRING", F.nullif(F.try_variant_get(tool, "$", "string"), F.lit("")))
        args = F.to_json(F.try_variant_get(value, "$.args", "variant"))
        return F.struct(name.alias("tool"), F.when(name.isNotNull(), args).alias("args"))

    found = let(F.try_parse_json(extract_json(trim_space(response), string_aware=False)), call)
    return answers.withColumn("_call", found).withColumns({"tool": F.col("_call.tool"), "args": F.col("_call.args")}).drop("_call")


def _argument(name: str) -> Column:
    """A text argument; '' when missing."""
    return F.coalesce(F.try_variant_get(F.try_parse_json("args"), f"$.{name}", "string"), F.lit(""))


def _arguments_are_texts(*names: str) -> Column:
    parsed = F.try_parse_json("args")
    ok = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT") | (F.schema_of_variant(parsed) == "VOID"), F.lit(False))
    for name in names:
        ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")), F.lit("VOID")).isin("STRING", "VOID")
    return ok


def tool_prompts(calls: DataFrame) -> DataFrame:
    """Add (system, user) prompts to rows that call a tool which asks the model."""
    tool = F.col("tool")
    asked = calls.where(tool.isin(MODEL_TOOLS))
    return asked.withColumn("system", prompts.tool_system_prompt(tool)).withColumn(
        "user", prompts.tool_user_prompt(tool, _argument("code"), _argument("issue"), _argument("original_code"))
    )


def _search_results(calls: DataFrame, elements: DataFrame, index: KeywordIndex, step: int) -> tuple[DataFrame, DataFrame]:
    """search_framework calls with tool_result, or with ref instead; and (ref, found), the texts of what was found."""
    indexed = F.coalesce("framework_found", F.lit(False))
    asked = calls.withColumn("_framework", F.col("framework")).withColumn("framework", F.when(indexed, F.col("framework")).otherwise(""))
    asking, contexts = searched_contexts(asked, elements, index, TOOL_LIMIT, query=_argument("query"))
    named = lambda: F.concat(F.lit(f"{step}/"), "query_id")
    texts = materialize(contexts.select(named().alias("ref"), prompts.search_tool_text("context").alias("found")), "search-texts")
    rows = asking.withColumn("framework", F.col("_framework")).drop("_framework")
    nothing = F.when(F.col("query_id").isNull(), F.when(indexed, prompts.NO_MATCH).otherwise(prompts.NO_INDEX))
    return rows.withColumns({"tool_result": nothing, "ref": named()}).drop("query_id"), texts


def _with_texts(rows: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """Stored rows with `shown`, their tool_calls with the texts that `refs` names by place."""
    rows = rows.withColumn("shown", F.col("tool_calls"))
    if not seen:
        return rows
    texts = seen[0]
    for more in seen[1:]:
        texts = texts.unionByName(more)
    # Few texts go to the rows: a join by their names would leave as many tasks as there are names.
    few = (texts.agg(F.sum(F.octet_length("found"))).first()[0] or 0) <= BROADCAST_BYTES
    places = rows.select(F.posexplode("refs").alias("at", "ref")).where("ref IS NOT NULL").select("at").distinct()
    for at in sorted(r[0] for r in places.collect()):  # as many as steps at most
        named = rows.withColumn("ref", F.coalesce(F.get("refs", F.lit(at)), F.lit("")))  # no text has the empty name
        met = named.join(F.broadcast(texts), ["ref"], "left") if few else counted_join(named, texts, ["ref"], ["review_id", "file_no"], "left")
        found = F.when(F.col("ref") != "", F.coalesce("found", F.lit(prompts.NO_MATCH)))

        def put(call: Column, i: Column) -> Column:
            result = F.when((i == at) & found.isNotNull(), found).otherwise(call["result"])
            return F.struct(call["name"].alias("name"), call["args"].alias("args"), result.alias("result"))

        rows = met.withColumn("shown", F.transform("shown", put)).drop("ref", "found")
    return rows


def agent_review(
    inputs: DataFrame, complete_fn: CompleteFn, elements: DataFrame, index: KeywordIndex, tools: dict[str, ToolFn] | None = None,
    system: Column | None = None, **options,
) -> DataFrame:
    """(review_id, file_no, file_path, result, error) of review_inputs with framework_found.

    A row ends with its final_review call, with an answer that is itself a review,
    with a failed completion, or after five steps. `tools` adds tools of the caller's
    or replaces built-in ones; `system` is the caller's system text, which should name them.
    """
    c = F.col
    empty_calls = F.array().cast(f"array<{CALL_TYPE}>")
    no_result = F.lit(None).cast(RESULT_TYPE)
    columns = ["review_id", "file_no", "file_path", "result", "error"]
    state = materialize(
        inputs.select("review_id", "file_no", "file_path", text("diff").alias("diff"), text("framework").alias("framework"), "framework_found")
        .withColumn("tool_calls", empty_calls).withColumn("refs", F.array().cast("array<string>")),
        "agent-0",
    )
    finished: list[DataFrame] = []
    seen: list[DataFrame] = []  # per step with searches: (ref, found)
    for step in range(1, prompts.MAX_STEPS + 1):
        if state.isEmpty():
            break
        requests = _with_texts(state, seen).withColumn(
            "messages",
            prompts.messages(prompts.agent_system_prompt("framework") if system is None else system, prompts.agent_step_prompt(F.lit(step), "file_path", "diff", "shown")),
        )
        answered = materialize(complete(requests, complete_fn, returned=state.columns, **options).drop("usage"), f"agent-{step}-answers")
        finished.append(answered.where(text("error") != "").withColumn("result", no_result).withColumn(
            "error", F.concat(F.lit(f"step {step}: "), c("error"))).select(*columns))

        # Written as well, else every branch below would cut and parse the answers again.
        calls = materialize(tool_calls(answered.where(text("error") == "")), f"agent-{step}-calls")
        final = calls.where(c("tool") == "final_review")
        finished.append(final.withColumn("result", F.coalesce(decode_result("args"), _out_of_steps())).select(*columns))

        silent = calls.where(c("tool").isNull())
        spoken = silent.withColumn("result", decode_result(extract_json("response", string_aware=False)))
        is_review = (text("result.summary") != "") | F.coalesce(F.size("result.issues") > 0, F.lit(False))
        finished.append(spoken.where(is_review).select(*columns))

        keep = state.columns
        idle = spoken.where(~is_review).select(*keep)
        open_calls = calls.where(c("tool").isNotNull() & (c("tool") != "final_review"))
        # Dealt again: rows that searched, whose next prompts are long, would lie together.
        after = idle.unionByName(_step(open_calls, complete_fn, elements, index, tools, seen, **options).select(*keep))
        state = materialize(dealt(after, ["review_id", "file_no"]), f"agent-{step}")
    finished.append(state.withColumn("result", _out_of_steps()).withColumn("error", F.lit("")).select(*columns))
    out = finished[0]
    for rows in finished[1:]:
        out = out.unionByName(rows)
    return out


def _out_of_steps() -> Column:
    return F.struct(
        F.array().cast(RESULT_TYPE.split("issues:")[1].split(",summary")[0]).alias("issues"),
        F.lit(OUT_OF_STEPS).alias("summary"),
        F.lit(0).cast("bigint").alias("risk_score"),
        F.lit("REQUEST_CHANGES").alias("recommendation"),
    )


def run_tools(
    calls: DataFrame, complete_fn: CompleteFn, elements: DataFrame, index: KeywordIndex, tools: dict[str, ToolFn] | None = None, **options
) -> DataFrame:
    """Rows with the call and its result appended to tool_calls.

    A tool of the caller's gets all rows that call it, with `args` as JSON text, and
    returns (review_id, file_no, tool_result); rows it leaves out have an empty result.
    """
    seen: list[DataFrame] = []
    named = calls.withColumn("refs", F.transform("tool_calls", lambda _: F.lit(None).cast("string")))
    done = _step(named, complete_fn, elements, index, tools, seen, **options)
    done = materialize(done, "tool-calls") if seen else done
    return _with_texts(done, seen).withColumn("tool_calls", F.col("shown")).drop("shown", "refs")


def _step(
    calls: DataFrame, complete_fn: CompleteFn, elements: DataFrame, index: KeywordIndex, tools: dict[str, ToolFn] | None, seen: list[DataFrame], **options
) -> DataFrame:
    """run_tools with the results of searches by their names in `refs`; their texts are appended to `seen`."""
    c = F.col
    own = tools or {}
    mine, calls = calls.where(c("tool").isin(list(own))), calls.where(~c("tool").isin(list(own)))
    searching = c("tool") == "search_framework"
    needs = {
        "search_framework": ["query"], "analyze_security": ["code"], "analyze_performance": ["code"],
        "suggest_fix": ["issue", "original_code"],
    }
    valid = F.lit(True)
    for tool, names in needs.items():
        valid = F.when(c("tool") == tool, _arguments_are_texts(*names)).otherwise(valid)
    calls = calls.withColumn("args_ok", valid)

    columns = [*(name for name in calls.columns if name not in {"response", "error", "args_ok"}), "tool_result"]
    no_ref = F.lit(None).cast("string").alias("ref")
    known = c("tool").isin(list(needs))
    refused = calls.where(~known | ~c("args_ok")).withColumn(
        "tool_result", F.when(known, BAD_ARGS).otherwise(F.concat(F.lit("Error: unknown tool: "), c("tool")))
    )
    done = refused.select(*columns, no_ref)
    for name, tool_fn in own.items():
        rows = mine.where(c("tool") == name)
        given = _with_texts(rows, seen).withColumn("tool_calls", c("shown")).drop("shown", "refs")
        found = rows.join(tool_fn(given).select("review_id", "file_no", "tool_result"), ["review_id", "file_no"], "left")
        done = done.unionByName(found.withColumn("tool_result", text("tool_result")).select(*columns, no_ref))

    # A step in which no row searches, or none asks the model, leaves those jobs out.
    searched = calls.where(searching & c("args_ok"))
    if not searched.isEmpty():
        found, texts = _search_results(searched, elements, index, len(seen))
        done = done.unionByName(found.select(*columns, "ref"))
        seen.append(texts)

    asked = tool_prompts(calls.where(c("args_ok"))).withColumn("messages", prompts.messages("system", "user"))
    if not asked.isEmpty():
        kept = [name for name in columns if name != "tool_result"]
        replies = materialize(complete(asked, complete_fn, returned=kept, **options).drop("usage"), "tool-answers")
        failed = F.concat(F.lit("Error: "), c("error"))
        replies = replies.withColumn("tool_result", F.when(text("error") != "", failed).otherwise(text("response")))
        done = done.unionByName(replies.select(*columns, no_ref))
    call = F.struct(c("tool").alias("name"), c("args").alias("args"), c("tool_result").alias("result"))
    return done.withColumns({"tool_calls": F.concat("tool_calls", F.array(call)), "refs": F.concat("refs", F.array("ref"))}).drop("ref")
