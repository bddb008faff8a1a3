"""Positioned line comments and the newest version of each merge request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import render
from patchlens.operators.joins import spread_join

POSITION_TYPE = "text"  # fixed value


def latest_versions(versions: DataFrame) -> DataFrame:
    """(project_id, iid, version): the first entry of each version list is the newest."""
    return versions.where(F.size("versions") > 0).select("project_id", "iid", F.get("versions", F.lit(0)).alias("version"))


def line_comments(results: DataFrame, versions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One comment per issue with a line number.

    `results` has project_id and iid beside the columns of review_results. With a
    known version the comment is a discussion at a position in the diff; else it is
    a general note that names the place. (project_id, iid, file_no, issue_no) keys
    the comment, so that delivery can be repeated safely; `keep` names columns of the
    results that belong to the key as well.
    """
    c = F.col
    keep = keep or []
    issues = (
        results.where("result IS NOT NULL")
        .select("project_id", "iid", *keep, "file_no", "file_path", F.posexplode("result.issues").alias("issue_no", "issue"))
        .where("issue.line > 0")
    )
    placed = spread_join(issues, latest_versions(versions), ["project_id", "iid"], ["file_no", "issue_no"], "left")
    known = c("version").isNotNull()
    comment = render.inline_comment(c("issue"))
    position = F.struct(
        c("version.base_commit_sha").alias("base_sha"),
        c("version.start_commit_sha").alias("start_sha"),
        c("version.head_commit_sha").alias("head_sha"),
        F.lit(POSITION_TYPE).alias("position_type"),
        c("file_path").alias("new_path"),
        c("issue.line").alias("new_line"),
    )
    return placed.select(
        "project_id", "iid", *keep, "file_no", "issue_no",
        F.when(known, "discussion").otherwise("note").alias("kind"),
        F.when(known, comment).otherwise(render.fmt("**", c("file_path"), ":", c("issue.line"), "**\n\n", comment)).alias("body"),
        F.when(known, position).alias("position"),
    )
