"""Reviews: prompt -> completion -> decoded result, for many files in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import prompts
from patchlens.functions.text import short_prompt_body, text
from patchlens.operators.agent import agent_review
from patchlens.operators.answers import parse_responses
from patchlens.operators.complete import CompleteFn, complete, complete_shared
from patchlens.operators.index import KeywordIndex
from patchlens.operators.joins import dealt, spread_join
from patchlens.operators.search import searched_contexts
from patchlens.session import materialize


UserPrompt = Callable[[str, str, str], Column]


def _ask(requests: DataFrame, complete_fn: CompleteFn, **options) -> DataFrame:
    """Completion written to the shared folder without its prompt, so that the model is asked once per row."""
    return _decoded(complete(requests, complete_fn, returned=["review_id", "file_no", "file_path"], **options))


def _decoded(answered: DataFrame) -> DataFrame:
    return parse_responses(materialize(answered.drop("usage"), "answers")).select("review_id", "file_no", "file_path", "result", "error")


def _carry_errors(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to review, and rows that already failed as result rows."""
    if "error" not in inputs.columns:
        return inputs, None
    failed = inputs.where(text("error") != "")
    return inputs.where(text("error") == ""), failed


def _with_failed(results: DataFrame, failed: DataFrame | None) -> DataFrame:
    if failed is None:
        return results
    none = F.lit(None).cast(results.schema["result"].dataType)
    return results.unionByName(failed.select("review_id", "file_no", "file_path", none.alias("result"), "error"))


def review_requests(inputs: DataFrame, system: str = prompts.REVIEW_SYSTEM, user: UserPrompt = prompts.review_prompt) -> DataFrame:
    """Messages of a standard review; callers may bring their own templates.

    `user` makes the text of a request out of the columns file_path, diff and full_content.
    """
    text_of = user("file_path", "diff", "full_content")
    return inputs.select("review_id", "file_no", "file_path", prompts.messages(F.lit(system), text_of).alias("messages"))


def review_files(
    inputs: DataFrame, complete_fn: CompleteFn, system: str = prompts.REVIEW_SYSTEM, user: UserPrompt = prompts.review_prompt, **options
) -> DataFrame:
    """Standard review of review_inputs(review_id, file_no, file_path, diff, full_content)."""
    inputs, failed = _carry_errors(inputs)
    requests = review_requests(dealt(inputs, ["review_id", "file_no"]), system, user)
    return _with_failed(_ask(requests, complete_fn, **options), failed)


def review_files_with_framework(
    inputs: DataFrame, complete_fn: CompleteFn, elements: DataFrame, index: KeywordIndex,
    search_content: bool = False, shorten_bodies: bool = False, **options,
) -> DataFrame:
    """Framework review: five related elements per file go into its prompt.

    By default the diff alone is searched with and bodies are whole; a single-file
    review also searches with the content and shortens bodies.
    """
    inputs, failed = _carry_errors(inputs)
    query: Column = F.concat(text("diff"), F.lit(" "), text("full_content")) if search_content else text("diff")
    body = short_prompt_body(F.col("body")) if shorten_bodies else F.col("body")
    asking, contexts = searched_contexts(inputs, elements, index, query=query, body=body)
    # The code of one search is the longest part of its prompts by far and the same in all of them.
    texts = materialize(contexts.select(F.col("query_id").alias("ref"), prompts.related_code("context").alias("shared")), "related-code")
    before, behind = prompts.framework_prompt_parts("file_path", "diff", "full_content", "framework")
    requests = asking.select(
        "review_id", "file_no", "file_path", prompts.framework_system_prompt("framework").alias("system"), before.alias("before"), behind.alias("behind"),
        F.col("query_id").alias("ref"),
    )
    answered = complete_shared(requests, texts, complete_fn, returned=["review_id", "file_no", "file_path"], **options)
    return _with_failed(_decoded(answered), failed)


def known_framework(inputs: DataFrame, elements: DataFrame, on_missing: str = "skip") -> DataFrame:
    """Blank the framework of rows whose framework is not indexed, or fail on the first one."""
    names = elements.select("framework", F.col("framework").alias("_known")).distinct()
    joined = spread_join(inputs, names, ["framework"], ["review_id", "file_no"], "left")
    if on_missing == "error":
        missing = joined.where((text("framework") != "") & F.col("_known").isNull()).select("framework").first()
        if missing:
            raise ValueError(f"framework not indexed: {missing.framework}")
    return joined.withColumn("framework_found", F.col("_known").isNotNull()).drop("_known")


def review_all(
    inputs: DataFrame, complete_fn: CompleteFn, elements: DataFrame, index: KeywordIndex, on_missing: str = "skip", **options
) -> DataFrame:
    """Send each row to the agent, framework or standard review by its flags; errors stay rows."""
    inputs, failed = _carry_errors(inputs)  # before routing: rows that failed are never asked about
    # Dealt, as the inputs may come in one file: each step of the agent is as many tasks as files are written here.
    routed = materialize(dealt(known_framework(inputs, elements, on_missing), ["review_id", "file_no"]), "routed")
    agent = routed.where("use_agent")
    rest = routed.where("NOT coalesce(use_agent, false)")
    results = (
        agent_review(agent, complete_fn, elements, index, **options)
        .unionByName(review_files_with_framework(rest.where("framework_found"), complete_fn, elements, index, **options))
        .unionByName(review_files(rest.where("NOT framework_found"), complete_fn, **options))
    )
    return _with_failed(results, failed)
