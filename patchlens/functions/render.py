"""Markdown and plain-text pieces of notes, comments and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions.text import text

# Marks and layouts of the published notes.
SEVERITY_MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
OTHER_MARK = "ℹ️"
SEVERITY_LABELS = {"CRITICAL": "[CRITICAL]", "HIGH": "[HIGH]", "MEDIUM": "[MEDIUM]", "LOW": "[LOW]"}
OTHER_LABEL = "[INFO]"
NOTE_TITLE = "## 🤖 Automated Code Review\n\n"
NOTE_FOOT = "---\n*Automated review by Code Review Bot*\n"
FLOW_NOTE_FOOT = "\n---\n*Automated review by Code Review Bot*"
RULE = "=" * 60


def _choose(value: Column, choices: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, shown in reversed(choices.items()):
        out = F.when(value == key, shown).otherwise(out)
    return out


def severity_mark(severity: Column, any_case: bool = True) -> Column:
    value = text(severity)
    return _choose(F.upper(value) if any_case else value, SEVERITY_MARKS, OTHER_MARK)


def severity_label(severity: Column) -> Column:
    return _choose(text(severity), SEVERITY_LABELS, OTHER_LABEL)


def fmt(*parts: Column | str) -> Column:
    """Concatenate texts and columns of any type."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def only_if(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, fmt(*parts)).otherwise(F.lit(""))


def inline_comment(issue: Column) -> Column:
    return fmt(
        severity_mark(issue["severity"]), " **[", F.upper(issue["type"]), "] ", issue["title"], "**\n\n", issue["description"],
        only_if(issue["suggestion"] != "", "\n\n💡 **Suggestion:** ", issue["suggestion"]),
    )


def note_head(s: dict[str, Column]) -> Column:
    """Title, counts and tables of the merge-request note; `s` maps stats names to columns."""
    either = (s["security_issues"] > 0) | (s["perf_issues"] > 0)
    return fmt(
        NOTE_TITLE,
        "**Files Reviewed:** ", s["files_reviewed"], " / ", s["total_files"], "\n",
        only_if(s["files_with_error"] > 0, "**Files with Errors:** ", s["files_with_error"], "\n"),
        "**Issues Found:** ", s["total_issues"], "\n\n",
        "### Issues by Severity\n\n| Severity | Count |\n|----------|-------|\n",
        "| 🔴 Critical | ", s["critical"], " |\n| 🟠 High | ", s["high"], " |\n| 🟡 Medium | ", s["medium"],
        " |\n| 🟢 Low | ", s["low"], " |\n\n",
        only_if(
            either,
            "### Issue Categories\n\n",
            only_if(s["security_issues"] > 0, "- 🔒 Security Issues: ", s["security_issues"], "\n"),
            only_if(s["perf_issues"] > 0, "- ⚡ Performance Issues: ", s["perf_issues"], "\n"),
            "\n",
        ),
    )


NOTE_FINDINGS_TITLE = "### Detailed Findings\n\n"


def note_section(path: Column, issues: Column) -> Column:
    """One file's findings in the merge-request note."""
    lines = F.transform(
        issues,
        lambda i: fmt(
            "- ", severity_mark(i["severity"]), " **[", i["type"], "]** ", i["title"], " (line ", i["line"], ")\n",
            only_if(i["description"] != "", "  - ", i["description"], "\n"),
            only_if(i["suggestion"] != "", "  - 💡 ", i["suggestion"], "\n"),
        ),
    )
    return fmt("#### 📄 `", path, "`\n\n", F.array_join(lines, ""), "\n")


def flow_note_head(s: dict[str, Column]) -> Column:
    return fmt(
        NOTE_TITLE,
        "**Files Reviewed:** ", s["files_reviewed"], "\n**Issues Found:** ", s["total_issues"],
        "\n\n| Severity | Count |\n|----------|-------|\n",
        "| 🔴 Critical | ", s["critical"], " |\n| 🟠 High | ", s["high"], " |\n| 🟡 Medium | ", s["medium"],
        " |\n| 🟢 Low | ", s["low"], " |\n\n",
    )


FLOW_FINDINGS_TITLE = "### Issues\n\n"


def flow_note_section(path: Column, issues: Column) -> Column:
    lines = F.transform(
        issues,
        lambda i: fmt(
            "- ", severity_mark(i["severity"], any_case=False), " **[", i["type"], "]** ", i["title"], " (line ", i["line"],
            ")\n  - ", i["description"], "\n",
            only_if(i["suggestion"] != "", "  - 💡 ", i["suggestion"], "\n"),
        ),
    )
    return fmt("**", path, "**\n", F.array_join(lines, ""), "\n")


def result_report(result: Column) -> Column:
    """Plain-text report of one file's result."""
    lines = F.transform(
        result["issues"],
        lambda i: fmt("  ", severity_label(i["severity"]), " [", i["type"], "] ", i["title"], " (Line ", i["line"], ")\n     ", i["description"], "\n"),
    )
    return fmt(
        "\n", RULE, "\nRisk Score: ", result["risk_score"], "/10 | Recommendation: ", result["recommendation"],
        "\nIssues Found: ", F.size(result["issues"]), "\n",
        only_if(F.size(result["issues"]) > 0, "\n", F.array_join(lines, "")),
        "\nSummary: ", result["summary"], "\n", RULE, "\n",
    )


def review_issue_line(issue: Column) -> Column:
    """One issue in the report of a whole review."""
    return fmt("  [", issue["severity"], "] ", issue["type"], " (line ", issue["line"], "): ", issue["title"], "\n")


def review_report_head(files: Column, issues: Column, recommendation: Column, risk: Column) -> Column:
    return fmt(
        "\nFiles Reviewed: ", files, "\nTotal Issues: ", issues, "\nRecommendation: ", recommendation, "\nRisk Score: ", risk, "/10\n",
    )
