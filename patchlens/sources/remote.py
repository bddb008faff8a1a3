"""Pluggable fetching and delivery: the two places that may call a remote service.

Both run on Arrow batches inside tasks, and both turn failures into an error column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FetchFn = Callable[[dict], str]
PostFn = Callable[[dict], None]


def fetch_payloads(keys: DataFrame, fetch_fn: FetchFn) -> DataFrame:
    """Add (value, error) to rows of keys; fetch_fn gets one row as a dict and returns JSON text."""
    schema = T.StructType([*keys.schema.fields, *T.StructType.fromDDL("value string, error string").fields])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            values: list[str | None] = []
            errors: list[str] = []
            for key in rows.to_dict("records"):
                try:
                    values.append(fetch_fn(key))
                    errors.append("")
                except Exception as failure:
                    values.append(None)
                    errors.append(str(failure) or type(failure).__name__)
            yield rows.assign(value=values, error=errors)

    return keys.mapInPandas(fetch, schema)


def deliver(rows: DataFrame, post_fn: PostFn) -> DataFrame:
    """Hand each note or comment to post_fn; adds `delivery_error`, '' when posted.

    Delivery is at least once: a task that is run again posts again, so post_fn
    should use the rows' keys to recognise what it has posted.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("delivery_error", T.StringType())])

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors: list[str] = []
            for row in batch.to_dict("records"):
                try:
                    post_fn(row)
                    errors.append("")
                except Exception as failure:
                    errors.append(str(failure) or type(failure).__name__)
            yield batch.assign(delivery_error=errors)

    return rows.mapInPandas(post, schema)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result documents as JSON lines."""
    results.write.mode(mode).json(path)
