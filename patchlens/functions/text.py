"""Word, path and diff functions: plain Column expressions, no Python in the data path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# White space as Unicode defines it (Java's \s is ASCII only).
WHITESPACE = r"[\s\p{Z}\x85]+"
WHITESPACE_CHARS = "\t\n\v\f\r " + "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
DOC_WORD_TRIM = ".,;:!?()[]{}"
QUERY_WORD_TRIM = ".,;:!?()[]{}\"'"
DOC_WORD_MIN_BYTES = 4
PRUNED_DIRS = r"(^|/)(vendor|testdata|\.[^/]*)/"
SKIP_PATTERNS = ["*.md", "*.txt", "vendor/*", "node_modules/*", "*.lock", "*.sum"]
LANGUAGE_SUFFIXES = {
    "go": [".go"],
    "python": [".py"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "rust": [".rs"],
    "ruby": [".rb"],
    "php": [".php"],
    "csharp": [".cs"],
    "cpp": [".cpp", ".cc", ".cxx"],
    "c": [".c", ".h"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "bash": [".sh", ".bash"],
    "sql": [".sql"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "xml": [".xml"],
    "html": [".html", ".htm"],
    "css": [".css"],
    "scss": [".scss", ".sass"],
}
DEFAULT_LANGUAGE = "code"
# ----------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value inside an expression, so that it is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(c: Column | str) -> Column:
    """A string column in which null reads as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def trim_space(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE_CHARS))


def fields(c: Column | str) -> Column:
    """Split on runs of white space; no empty items."""
    return F.filter(F.split(text(c), WHITESPACE), lambda w: w != "")


def camel_words(c: Column | str) -> Column:
    """Split before every ASCII capital but the first character."""
    return F.filter(F.split(text(c), r"(?s)(?<=.)(?=[A-Z])"), lambda w: w != "")


def doc_words(c: Column | str) -> Column:
    """Words of a comment that are long enough to index."""
    words = F.transform(F.split(F.lower(text(c)), WHITESPACE), lambda w: F.btrim(w, F.lit(DOC_WORD_TRIM)))
    return F.filter(words, lambda w: F.octet_length(w) >= DOC_WORD_MIN_BYTES)


def query_words(c: Column | str) -> Column:
    """Words of a query, repeats and words trimmed to nothing included."""
    return F.transform(fields(F.lower(text(c))), lambda w: F.btrim(w, F.lit(QUERY_WORD_TRIM)))


def exploded_counts(rows: DataFrame, sorted_words: str, keep: list[str]) -> DataFrame:
    """One row per distinct item of a sorted array column: keep + (word, n, is_first).

    Equal items are neighbours, so their runs give the counts within the row and
    nothing is shuffled. The run starts are a column of their own, else each use
    of them would search the array again.
    """
    words = F.col(sorted_words)
    n = F.size(words)
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(positions, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    runs = F.transform(
        "run_starts",
        lambda s, i: F.struct(
            F.get(words, s).alias("word"),
            (F.coalesce(F.get("run_starts", i + 1), n) - s).cast("bigint").alias("n"),
            (i == 0).alias("is_first"),
        ),
    )
    return (
        rows.withColumn("run_starts", starts)
        .select(*keep, F.explode(runs).alias("run"))
        .select(*keep, F.col("run.word").alias("word"), F.col("run.n").alias("n"), F.col("run.is_first").alias("is_first"))
    )


def language_of(path: Column | str) -> Column:
    """Language name by file suffix, case-sensitive."""
    names = [part for name, suffixes in LANGUAGE_SUFFIXES.items() for s in suffixes for part in (F.lit(s), F.lit(name))]
    suffix = F.regexp_extract(text(path), r"(\.[^./]+)$", 1)
    return F.coalesce(F.try_element_at(F.create_map(*names), suffix), F.lit(DEFAULT_LANGUAGE))


def is_indexed_source(path: Column | str) -> Column:
    """True for Go sources that are neither tests nor below a pruned folder."""
    p = text(path)
    return ~p.rlike(PRUNED_DIRS) & p.endswith(".go") & ~p.endswith("_test.go")


def glob_regex(glob: str) -> str:
    """One skip pattern as a regular expression.

    A pattern with a slash is anchored at the path's start and covers all that
    lies below; one without a slash is matched against the file name.
    """
    body = "".join(".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch in "/_-" else "\\" + ch for ch in glob)
    return f"^{body}$" if "/" in glob else f"(^|/){body.replace('.*', '[^/]*')}$"


def is_skipped(path: Column | str, patterns: list[str] | None = None) -> Column:
    patterns = SKIP_PATTERNS if patterns is None else patterns
    if not patterns:
        return F.lit(False)
    return text(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def base_name(path: Column | str) -> Column:
    """Last path part; trailing slashes do not count, '' is '.'."""
    trimmed = F.regexp_replace(text(path), "/+$", "")
    return (
        F.when(text(path) == "", ".")
        .when(trimmed == "", "/")
        .otherwise(F.element_at(F.split(trimmed, "/"), -1))
    )


def synthetic_diff(path: Column | str, content: Column | str, full_path: bool = False) -> Column:
    """A whole file as a diff of added lines.

    The short form names the base file and keeps the empty line after a final
    line break; the full-path form counts that line but does not print it.
    """
    shown = text(path) if full_path else base_name(path)
    lines = F.split(text(content), "\n", -1)
    count = F.size(lines)
    if full_path:
        printed = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), count - 1)).otherwise(lines)
    else:
        printed = lines
    body = F.array_join(F.transform(printed, lambda line: F.concat(F.lit("+"), line, F.lit("\n"))), "")
    return F.concat(
        F.lit("diff --git a/"), shown, F.lit(" b/"), shown,
        F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), shown,
        F.lit("\n@@ -0,0 +1,"), count.cast("string"), F.lit(" @@\n"), body,
    )


def truncated(c: Column | str, limit: int, suffix: str) -> Column:
    """The first `limit` characters and a mark when something was left out."""
    value = col(c)
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit(suffix))).otherwise(value)


TOOL_TEXT_LIMIT, TOOL_TEXT_SUFFIX = 300, "..."
PROMPT_BODY_LIMIT, PROMPT_BODY_SUFFIX = 500, "\n// ... truncated"


def short_tool_text(c: Column | str) -> Column:
    return truncated(c, TOOL_TEXT_LIMIT, TOOL_TEXT_SUFFIX)


def short_prompt_body(c: Column | str) -> Column:
    return truncated(c, PROMPT_BODY_LIMIT, PROMPT_BODY_SUFFIX)


REPO_HOST = "github.com"


def repo_url(c: Column | str) -> Column:
    """One https spelling for the ssh, host-relative and owner/name forms."""
    url = F.regexp_replace(trim_space(text(c)), r"\.git$", "")
    ssh = f"git@{REPO_HOST}:"
    site = f"https://{REPO_HOST}/"
    return (
        F.when(url.startswith(ssh), F.concat(F.lit(site), F.substr(url, F.lit(len(ssh) + 1))))
        .when(url.startswith(f"{REPO_HOST}/"), F.concat(F.lit("https://"), url))
        .when(~url.startswith("http") & url.contains("/"), F.concat(F.lit(site), url))
        .otherwise(url)
    )


def repo_key(c: Column | str) -> Column:
    """owner-name from the last two parts of a URL."""
    url = F.regexp_replace(text(c), r"\.git$", "")
    parts = F.split(url, "/")
    return F.when(
        F.size(parts) >= 2,
        F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("-"), F.element_at(parts, -1)),
    ).otherwise(base_name(url))


def framework_name(c: Column | str) -> Column:
    return base_name(c)
