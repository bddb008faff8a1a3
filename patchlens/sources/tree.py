"""Source trees as rows of (framework, file_path, content)."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions.text import is_indexed_source


def read_tree(spark: SparkSession, root: str, framework: str, glob: str = "*.go") -> DataFrame:
    """All files below root; unreadable ones are skipped.

    The listing leaves out names that start with '_' or '.', as Spark always does.
    """
    files = (
        spark.read.option("ignoreCorruptFiles", True)
        .text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    )
    base = urlparse(root).path.rstrip("/") + "/"
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    relative = F.substr(full, F.instr(full, base) + len(base))
    return files.select(F.lit(framework).alias("framework"), relative.alias("file_path"), F.col("value").alias("content"))


def read_go_tree(spark: SparkSession, root: str, framework: str) -> DataFrame:
    """Files of a tree that belong into the index: no tests, no pruned folders."""
    return read_tree(spark, root, framework).where(is_indexed_source("file_path"))
