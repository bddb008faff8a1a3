"""Word, path and diff functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from patchlens.functions import text as t


def values(spark, cases, fn, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn("v").alias("out")).orderBy("i").collect()]


def test_camel_words(spark):
    cases = {
        "HandleRequest": ["Handle", "Request"], "getUserByID": ["get", "User", "By", "I", "D"], "URL": ["U", "R", "L"],
        "simple": ["simple"], "HTTPServer": ["H", "T", "T", "P", "Server"], "": [],
    }
    assert values(spark, cases, t.camel_words) == list(cases.values())


def test_languages(spark):
    cases = {
        "main.go": "go", "script.py": "python", "app.js": "javascript", "component.tsx": "typescript", "Main.java": "java",
        "lib.rs": "rust", "config.yaml": "yaml", "data.json": "json", "index.html": "html", "style.css": "css", "unknown.xyz": "code",
        "path/to/file.go": "go", "src/components/Button.tsx": "typescript", "UPPER.GO": "code", "noext": "code", "": "code",
    }
    assert values(spark, cases, t.language_of) == list(cases.values())


def test_pruning_and_skipping(spark):
    paths = ["a.go", "a_test.go", "vendor/x.go", "p/testdata/x.go", ".git/x.go", "p/.hid/x.go", "vendored/x.go", "a.py", "p/README.md", "go.sum", "x/vendor/y.md"]
    assert values(spark, paths, t.is_indexed_source) == [True, False, False, False, False, False, True, False, False, False, False]
    assert values(spark, paths, t.is_skipped) == [False, False, True, False, False, False, False, False, True, True, True]


def test_words_of_docs_and_queries(spark):
    assert values(spark, ["The (Handler), été! a\u00a0word.\tend"], t.doc_words) == [["handler", "été", "word"]]
    assert values(spark, ['func { "Quote\' } x'], t.query_words) == [["func", "", "quote", "", "x"]]
    assert values(spark, ["", None], t.query_words) == [[], []]


@pytest.mark.parametrize("content, short, full", [
    ("a\nb", ["+a", "+b"], ["+a", "+b"]), ("a\nb\n", ["+a", "+b", "+"], ["+a", "+b"]), ("", ["+"], []), ("\n", ["+", "+"], ["+"]),
])
def test_synthetic_diff(spark, content, short, full):
    df = spark.createDataFrame([("p/q/x.go", content)], "path string, content string")
    row = df.select(t.synthetic_diff("path", "content").alias("a"), t.synthetic_diff("path", "content", True).alias("b")).first()
    n = content.count("\n") + 1
    head = "diff --git a/{0} b/{0}\nnew file mode 100644\n--- /dev/null\n+++ b/{0}\n@@ -0,0 +1,{1} @@\n"
    assert row.a == head.format("x.go", n) + "".join(line + "\n" for line in short)
    assert row.b == head.format("p/q/x.go", n) + "".join(line + "\n" for line in full)


def test_truncation(spark):
    out = values(spark, ["x" * 300, "é" * 301], t.short_tool_text)
    assert out == ["x" * 300, "é" * 300 + "..."]
    assert values(spark, ["y" * 501], t.short_prompt_body) == ["y" * 500 + "\n// ... truncated"]


def test_repository_addresses(spark):
    cases = {
        "https://github.com/o/r.git": "https://github.com/o/r", " github.com/o/r ": "https://github.com/o/r",
        "git@github.com:o/r.git": "https://github.com/o/r", "o/r": "https://github.com/o/r", "http://x/y": "http://x/y", "plain": "plain",
    }
    assert values(spark, cases, t.repo_url) == list(cases.values())
    assert values(spark, ["https://github.com/o/r", "r"], t.repo_key) == ["o-r", "r"]
    assert values(spark, ["o/r", "o/r/", "", "/"], t.framework_name) == ["r", "r", ".", "/"]


def test_exploded_counts(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, [])], "id int, w array<string>")
    rows = t.exploded_counts(df, "w", ["id"]).orderBy("word").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 2, True), (1, "b", 1, False)]


def test_let_binds_once(spark):
    assert spark.range(1).select(t.let(F.lit(2), lambda x: x * x).alias("v")).first().v == 4
