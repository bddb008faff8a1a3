"""Counts and merged results per review.

Input everywhere: review_results(review_id, file_no, file_path, result, error), one
row per file with its issues nested. Issues are counted inside the row, so each
review is reduced on the map side and no issue is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.text import text

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]  # fixed values, gravest first
SEVERITY_RANKS = {s: rank for rank, s in enumerate(reversed(SEVERITIES), start=1)}
STAT_NAMES = [
    "total_files", "files_reviewed", "files_with_error", "total_issues",
    "critical", "high", "medium", "low", "security_issues", "perf_issues",
]


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _total(n: Column) -> Column:
    return F.coalesce(F.sum(n.cast("bigint")), F.lit(0).cast("bigint"))


def review_stats(results: DataFrame, by: list[str] | None = None, any_case: bool = True, layout: str = "note") -> DataFrame:
    """Statistics per review in one pass.

    layout "note" and "batch": files with an error are counted apart and their
    issues skipped. layout "flow": every file counts as reviewed and every present
    result is counted. Severity and type names are compared in any case or exactly.
    """
    failed = text("error") != ""
    present = F.col("result").isNotNull()
    counted = present if layout == "flow" else present & ~failed
    issues = F.when(counted, F.col("result.issues"))

    def n_where(field: str, value: str) -> Column:
        def hit(issue: Column) -> Column:
            shown = text(issue[field])
            return F.upper(shown) == value if any_case else shown == value

        return _total(F.size(F.filter(issues, hit)))

    return results.groupBy(*(by or ["review_id"])).agg(
        F.count("*").alias("total_files"),
        (F.count("*") if layout == "flow" else _count(counted)).alias("files_reviewed"),
        _count(failed).alias("files_with_error"),
        _total(F.when(counted, F.size("result.issues"))).alias("total_issues"),
        *(n_where("severity", s).alias(s.lower()) for s in SEVERITIES),
        n_where("type", "SECURITY").alias("security_issues"),
        n_where("type", "PERFORMANCE").alias("perf_issues"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Summary of a batch request: exact severity names, successes as reviewed files."""
    return review_stats(results, any_case=False, layout="batch").select(
        "review_id", "total_files", "files_reviewed", "total_issues",
        F.col("critical").alias("critical_issues"), F.col("high").alias("high_issues"),
        F.col("medium").alias("medium_issues"), F.col("low").alias("low_issues"),
    )


def flow_stats(results: DataFrame, posted: Column | None = None) -> DataFrame:
    """Output counters of a review job: exact names, all files count as reviewed."""
    stats = review_stats(results, any_case=False, layout="flow")
    return stats.select(
        "review_id", "files_reviewed", "total_issues", "critical", "high", "medium", "low",
        (F.lit(False) if posted is None else posted).alias("posted"),
    )


def merged_issues(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All issues of a review as rows; (file_no, issue_no) is their order."""
    rows = results.where("result IS NOT NULL").select(
        *(keep or ["review_id"]), "file_no", "file_path", F.posexplode("result.issues").alias("issue_no", "issue")
    )
    return rows.select(*(keep or ["review_id"]), "file_no", "file_path", "issue_no", "issue.*")


# Fixed values.
APPROVE, COMMENT, REQUEST_CHANGES = "APPROVE", "COMMENT", "REQUEST_CHANGES"
MORE_FILES = " (+ other files reviewed)"


def aggregate_results(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One merged result per review.

    Risk is the sum of all risks divided by the number of all rows, failed ones
    included, cut towards zero. Unknown recommendations count as none.

    The merged issues stay rows (see merged_issues), because a review may hold any
    number of them.
    """
    by = by or ["review_id"]
    result = F.col("result")
    summary = F.when(text(result["summary"]) != "", result["summary"])
    verdict = F.when(result["recommendation"] == REQUEST_CHANGES, 2).when(result["recommendation"] == COMMENT, 1).otherwise(0)
    merged = results.groupBy(*by).agg(
        F.count("*").alias("files_reviewed"),
        _total(F.size("result.issues")).alias("total_issues"),
        F.min(F.when(summary.isNotNull(), F.struct(F.col("file_no"), summary.alias("summary")))).alias("first"),
        F.count(summary).alias("n_summaries"),
        _total(F.coalesce(result["risk_score"], F.lit(0))).alias("risk"),
        F.max(verdict).alias("verdict"),
    )
    return merged.select(
        *by, "files_reviewed", "total_issues",
        F.expr("risk div files_reviewed").alias("risk_score"),
        F.concat(text("first.summary"), F.when(F.col("n_summaries") > 1, MORE_FILES).otherwise("")).alias("summary"),
        F.when(F.col("verdict") == 2, REQUEST_CHANGES).when(F.col("verdict") == 1, COMMENT).otherwise(APPROVE).alias("recommendation"),
    )


def critical_gate(results: DataFrame) -> DataFrame:
    """Whether any issue of a review is exactly CRITICAL."""
    hit = F.exists(F.col("result.issues"), lambda i: i["severity"] == "CRITICAL")
    return results.groupBy("review_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("failed"))


def severity_at_least(issues: DataFrame, minimum: str) -> DataFrame:
    """Issue rows at or above a severity; names outside the scale are below all."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANKS.items():
        rank = F.when(F.upper(text("severity")) == name, value).otherwise(rank)
    return issues.where(rank >= SEVERITY_RANKS[minimum.upper()])


def first_files(files: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """At most `limit` files per review in file order; cut on both sides of the shuffle."""
    order = Window.partitionBy(*(by or ["review_id"])).orderBy("file_no")
    ranked = files.withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= limit).drop("_n")
