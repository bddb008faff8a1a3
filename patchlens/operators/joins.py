"""Joins and deals that stay balanced when one key, or one file, holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.session import materialize

SPREAD = 16
KEY_ROWS = 1 << 16  # rows of one key that a task takes where keys are counted


def salts(n: Column) -> Column:
    """array<bigint> 0 .. n-1."""
    return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)


def salt_of(columns: list[str], spread: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), spread)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """Join to a side with few rows per key, with the left rows of each key over SPREAD tasks.

    The right side is repeated per salt, so it should be the narrow, deduplicated
    one. `how` is inner, left or left_semi.
    """
    salted = left.withColumn("_salt", salt_of(spread_by, F.lit(SPREAD)))
    repeated = right.withColumn("_salt", F.explode(salts(F.lit(SPREAD))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """spread_join for a right side of wide rows: they are repeated only for keys with more than KEY_ROWS left rows, once for each KEY_ROWS.

    The left side is read twice, first for its counts, so it should be stored; keys must not be null.
    """
    many = left.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS)
    many = materialize(many.select(*keys, F.ceil(F.col("n") / KEY_ROWS).alias("_salts")), "heavy-keys")
    return salted_join(left, right, keys, spread_by, many, how)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], many: DataFrame, how: str = "inner") -> DataFrame:
    """counted_join where the keys with many left rows are known: `many` is (keys, _salts), the tasks that each of these keys takes."""
    counted = left.join(many, keys, "left").withColumn("_salt", salt_of(spread_by, F.coalesce("_salts", F.lit(1)))).drop("_salts")
    repeated = right.join(many, keys, "left").withColumn("_salt", F.explode(salts(F.coalesce("_salts", F.lit(1))))).drop("_salts")
    return counted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows over as many tasks as a shuffle has, however few files or row groups they come from.

    For rows that are small beside the work on them. The number is given, so that adaptive
    execution does not put them together again by their size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
