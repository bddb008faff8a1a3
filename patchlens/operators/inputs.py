"""What is to be reviewed: diffs, whole files, batches and merge-request changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.jsontext import object_error
from patchlens.functions.text import is_skipped, let, synthetic_diff, text
from patchlens.operators.joins import spread_join

NO_INPUT = "no input provided"
BAD_REQUEST = "invalid request"
BAD_PAYLOAD = "invalid merge request"
MISSING_FIELDS = "file_path and diff are required"


def assemble_inputs(rows: DataFrame) -> DataFrame:
    """Fill diff, full_content and error from (file_path, diff, piped_diff, content, context).

    The given diff wins, then the piped one, then the whole file as a diff of added
    lines; in the last case the file is also the full content. A context text
    replaces the full content. Without any diff the row gets an error.
    """
    c = F.col
    given = F.coalesce(F.nullif(c("diff"), F.lit("")), F.nullif(c("piped_diff"), F.lit("")))
    from_file = F.when(c("content").isNotNull(), synthetic_diff("file_path", "content"))
    return rows.select(
        *(name for name in rows.columns if name not in {"diff", "piped_diff", "content", "context", "full_content", "error"}),
        F.coalesce(given, from_file, F.lit("")).alias("diff"),
        F.coalesce(c("context"), F.when(given.isNull(), c("content")), F.lit("")).alias("full_content"),
        F.when(F.coalesce(given, from_file).isNull(), NO_INPUT).otherwise("").alias("error"),
    )


def job_input(rows: DataFrame) -> DataFrame:
    """Inputs of a review job over (file_path, diff, content): the full-path diff form."""
    c = F.col
    has_diff = text("diff") != ""
    return rows.withColumn("full_content", F.when(has_diff, "").otherwise(text("content"))).withColumn(
        "diff", F.when(has_diff, c("diff")).otherwise(synthetic_diff("file_path", "content", full_path=True))
    )


def validate_single(rows: DataFrame) -> DataFrame:
    """Error column of a single request: path and diff are required."""
    missing = (text("file_path") == "") | (text("diff") == "")
    return rows.withColumn("error", F.when(missing, MISSING_FIELDS).otherwise(""))


FILE_TYPE = "struct<file_path:string,diff:string,full_content:string>"
BATCH_TYPE = (
    f"struct<files:array<{FILE_TYPE}>,project_id:bigint,merge_req_id:bigint,post_to_mr:boolean>"
)


# A value of another type, at any depth, makes the whole payload malformed.
_TEXTS = lambda *names: dict.fromkeys(names, "STRING")
BATCH_SPEC = {
    "files": [_TEXTS("file_path", "diff", "full_content")], "project_id": "BIGINT", "merge_req_id": "BIGINT", "post_to_mr": "BOOLEAN",
}
HEADER_SPEC = {"id": "BIGINT", "iid": "BIGINT"} | _TEXTS("title", "description", "source_branch", "target_branch", "state", "web_url")
CHANGE_SPEC = _TEXTS("old_path", "new_path", "diff") | dict.fromkeys(["new_file", "renamed_file", "deleted_file"], "BOOLEAN")


def _kept(own: Column | None, message: Column) -> Column:
    return message if own is None else F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(message)


def _parsed(value: str, kind: str, spec: dict, message: str, own: Column | None = None) -> Column:
    """struct<r, error>: the payload read as the type, if it is a JSON object of these types. Bound by the caller, so each is read once."""
    return let(
        _kept(own, object_error(value, spec, message)),
        lambda error: F.struct(F.when(error == "", F.from_json(value, kind)).alias("r"), error.alias("error")),
    )


def batch_files(requests: DataFrame, value: str = "value", review_id: str = "review_id") -> DataFrame:
    """One row per file of each batch request (JSON text); a malformed request is one row with an error and no file."""
    file = lambda p, no, f: F.struct(
        p["r"]["project_id"].alias("project_id"), p["r"]["merge_req_id"].alias("merge_req_id"), p["r"]["post_to_mr"].alias("post_to_mr"),
        no.alias("file_no"), f.alias("f"), p["error"].alias("error"),
    )
    none = F.lit(None)
    failed = lambda p: F.struct(
        none.cast("bigint").alias("project_id"), none.cast("bigint").alias("merge_req_id"), none.cast("boolean").alias("post_to_mr"),
        none.cast("int").alias("file_no"), none.cast(FILE_TYPE).alias("f"), p["error"].alias("error"),
    )
    files = let(_parsed(value, BATCH_TYPE, BATCH_SPEC, BAD_REQUEST), lambda p: F.when(p["error"] == "", F.transform(p["r"]["files"], lambda f, no: file(p, no, f))).otherwise(F.array(failed(p))))
    rows = requests.select(F.col(review_id).alias("review_id"), F.explode(files).alias("x"))
    return rows.select("review_id", "x.project_id", "x.merge_req_id", "x.post_to_mr", "x.file_no", "x.f.*", "x.error")


CHANGE_TYPE = "struct<old_path:string,new_path:string,diff:string,new_file:boolean,renamed_file:boolean,deleted_file:boolean>"
MERGE_REQUEST_TYPE = (
    "struct<id:bigint,iid:bigint,title:string,description:string,source_branch:string,target_branch:string,"
    f"state:string,web_url:string,changes:array<{CHANGE_TYPE}>>"
)
VERSIONS_TYPE = "array<struct<id:bigint,head_commit_sha:string,base_commit_sha:string,start_commit_sha:string>>"


def merge_request_headers(payloads: DataFrame, value: str = "value") -> DataFrame:
    """(project_id, id, iid, title, ..., web_url, error) without the changes; error is '' or tells that the payload is malformed.

    Payloads that bring an error of their own, as fetched ones do, keep it.
    """
    header = MERGE_REQUEST_TYPE.replace(f",changes:array<{CHANGE_TYPE}>", "")
    own = F.col("error") if "error" in payloads.columns else None
    rows = payloads.select("project_id", F.from_json(value, header).alias("m"), _kept(own, object_error(value, HEADER_SPEC, BAD_PAYLOAD)).alias("error"))
    rows = rows.withColumn("m", F.when(F.col("error") == "", F.col("m")))  # nothing of a malformed payload is taken over
    return rows.select("project_id", "m.*", "error")


def changed_files(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Files to review of each merge request: deleted ones dropped, path is the new path.

    A malformed payload is one row with an error and no file; payloads that bring an
    error or an iid of their own, as fetched ones do, keep them.
    """
    own = F.col("error") if "error" in payloads.columns else None
    known = F.col("iid") if "iid" in payloads.columns else F.lit(None).cast("bigint")
    none = F.lit(None)
    file = lambda p, no, f: F.struct(
        p["r"]["iid"].alias("iid"), no.alias("file_no"), f["new_path"].alias("file_path"), text(f["diff"]).alias("diff"),
        F.coalesce(f["deleted_file"], F.lit(False)).alias("deleted"), p["error"].alias("error"),
    )
    failed = lambda p: F.struct(
        known.alias("iid"), none.cast("int").alias("file_no"), none.cast("string").alias("file_path"), F.lit("").alias("diff"),
        F.lit(False).alias("deleted"), p["error"].alias("error"),
    )
    changes = lambda p: F.filter(F.transform(p["r"]["changes"], lambda f, no: file(p, no, f)), lambda x: ~x["deleted"])
    parsed = _parsed(value, MERGE_REQUEST_TYPE, HEADER_SPEC | {"changes": [CHANGE_SPEC]}, BAD_PAYLOAD, own)
    rows = let(parsed, lambda p: F.when(p["error"] == "", changes(p)).otherwise(F.array(failed(p))))
    return payloads.select("project_id", F.explode(rows).alias("x")).select("project_id", "x.iid", "x.file_no", "x.file_path", "x.diff", "x.error")


def merge_request_versions(payloads: DataFrame, value: str = "value") -> DataFrame:
    """(project_id, iid, versions array), newest first as delivered."""
    return payloads.select("project_id", "iid", F.from_json(value, VERSIONS_TYPE).alias("versions"))


def with_file_content(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Left join of changes(project_id, ref, file_path) to contents of the same key."""
    content = contents.select("project_id", "ref", "file_path", "content")
    return spread_join(changes, content, ["project_id", "ref", "file_path"], [c for c in changes.columns if c not in content.columns] or ["file_path"], "left")


def reviewable(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Files outside the skip patterns."""
    return files.where(~is_skipped("file_path", patterns))
