"""Notes of a review as rows, so that a review of any size is assembled without gathering it.

A note is rows of (review_id, part, file_no, body): one head (part 0), a section per file
with findings (part 1) and one foot (part 2). Read in the order of part and file_no, the
bodies are the text of the note; `whole_notes` joins them where a receiver takes one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import render
from patchlens.operators.review_stats import STAT_NAMES, aggregate_results, review_stats

HEAD, SECTION, FOOT = 0, 1, 2


def note_rows(heads: DataFrame, sections: DataFrame, foot: str) -> DataFrame:
    """The rows of the notes of heads(review_id, head, shown) and sections(review_id, file_no, section).

    `shown` tells whether a review's sections belong into its note. Reviews that have
    sections but do not show them are few, so only those are kept apart, by an anti-join.
    """
    none = F.lit(None).cast(sections.schema["file_no"].dataType)
    ends = heads.select(
        "review_id", F.explode(F.array(F.struct(F.lit(HEAD).alias("part"), F.col("head").alias("body")), F.struct(F.lit(FOOT).alias("part"), F.lit(foot).alias("body")))).alias("e")
    ).select("review_id", "e.part", none.alias("file_no"), "e.body")
    hidden = heads.where(~F.col("shown")).select("review_id")
    shown = sections.join(hidden, "review_id", "left_anti")
    return ends.unionByName(shown.select("review_id", F.lit(SECTION).alias("part"), "file_no", F.col("section").alias("body")))


def whole_notes(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(review_id, body): the text of each note, for receivers that take it in one piece.

    A note must then fit one value; use it on the reviews that are to be posted.
    """
    parts = rows.groupBy(*(keys or ["review_id"])).agg(F.sort_array(F.collect_list(F.struct("part", "file_no", "body"))).alias("parts"))
    return parts.withColumn("body", F.array_join(F.transform("parts", lambda p: p["body"]), "")).drop("parts")


def _sections(results: DataFrame, section: Column) -> DataFrame:
    with_issues = results.where("result IS NOT NULL AND size(result.issues) > 0")
    return with_issues.select("review_id", "file_no", section.alias("section"))


def _columns() -> dict[str, Column]:
    return {name: F.col(name) for name in STAT_NAMES}


def summary_notes(results: DataFrame, summary_only: bool = False) -> DataFrame:
    """The merge-request note: counts, severity table, categories, findings per file."""
    stats = review_stats(results)
    shown = F.lit(not summary_only) & (F.col("total_issues") > 0)
    head = F.concat(render.note_head(_columns()), F.when(shown, render.NOTE_FINDINGS_TITLE).otherwise(""))
    heads = stats.select("review_id", head.alias("head"), shown.alias("shown"))
    # A file that has both an error and issues is not counted, and shows only if others are.
    sections = _sections(results, render.note_section(F.col("file_path"), F.col("result.issues"))).where(F.lit(not summary_only))
    return note_rows(heads, sections, render.NOTE_FOOT)


def batch_notes(results: DataFrame) -> DataFrame:
    """The note of a batch request: failed files are not handed to it, so it counts and shows the others alone.

    A batch of failed files only has a note that says that no file was reviewed.
    """
    failed = F.coalesce("error", F.lit("")) != ""
    notes = summary_notes(results.where(~failed))
    rest = results.groupBy("review_id").agg(F.bool_and(failed).alias("all_failed")).where("all_failed")
    nothing = {name: F.lit(0).cast("bigint") for name in STAT_NAMES}
    heads = rest.select("review_id", render.note_head(nothing).alias("head"), F.lit(True).alias("shown"))
    return notes.unionByName(note_rows(heads, _sections(results, F.lit("")).where(F.lit(False)), render.NOTE_FOOT))


def flow_notes(results: DataFrame) -> DataFrame:
    """The note of a review job: other layout, exact severity names, all files counted."""
    stats = review_stats(results, any_case=False, layout="flow")
    title = F.when(F.col("total_issues") > 0, render.FLOW_FINDINGS_TITLE).otherwise("")
    heads = stats.select("review_id", F.concat(render.flow_note_head(_columns()), title).alias("head"), F.lit(True).alias("shown"))
    sections = _sections(results, render.flow_note_section(F.col("file_path"), F.col("result.issues")))
    return note_rows(heads, sections, render.FLOW_NOTE_FOOT)


def file_reports(results: DataFrame) -> DataFrame:
    """Plain-text report per reviewed file."""
    return results.where("result IS NOT NULL").select(
        "review_id", "file_no", render.result_report(F.col("result")).alias("report")
    )


def review_reports(results: DataFrame) -> DataFrame:
    """Plain-text report per review: counters, then one line per issue."""
    c = F.col
    merged = aggregate_results(results)
    title = F.when(c("total_issues") > 0, "\nIssues:\n").otherwise("")
    head = render.review_report_head(c("files_reviewed"), c("total_issues"), c("recommendation"), c("risk_score"))
    heads = merged.select("review_id", F.concat(head, title).alias("head"), F.lit(True).alias("shown"))
    lines = F.array_join(F.transform("result.issues", render.review_issue_line), "")
    return note_rows(heads, _sections(results, lines), "")
