"""Answers to review prompts -> result and error columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.jsontext import RESULT_TYPE, decode_result, extract_json, strip_json_comments
from patchlens.functions.text import let, text, trim_space

NO_JSON = "no JSON found in response"
BAD_JSON = "invalid review JSON"


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add (result, error) to rows with an answer text; a row never fails the job.

    A row that brings an error of its own (a failed completion) keeps it.
    """
    none = F.lit(None).cast(RESULT_TYPE)

    def outcome(result: Column, error: Column) -> Column:
        return F.struct(result.alias("result"), error.alias("error"))

    def from_json_text(found: Column) -> Column:
        decoded = let(
            decode_result(strip_json_comments(found)), lambda r: outcome(r, F.when(r.isNull(), BAD_JSON).otherwise(""))
        )
        return F.when(found == "", outcome(none, F.lit(NO_JSON))).otherwise(decoded)

    answer = let(extract_json(trim_space(response)), from_json_text)
    if "error" in responses.columns:
        answer = F.when(text("error") != "", outcome(none, F.col("error"))).otherwise(answer)
    parsed = responses.withColumn("_answer", answer)
    return parsed.withColumns({"result": F.col("_answer.result"), "error": F.col("_answer.error")}).drop("_answer")
