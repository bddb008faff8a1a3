"""The completion stage: messages in, answer text or error out.

`complete_fn(list of message lists) -> list of (text, error, usage)` is supplied by
the user and is the only Python in a review; it sees one Arrow batch at a time.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.operators import joins
from patchlens.session import materialize

# Request options and the retry schedule.
TEMPERATURE = 0.1
MAX_TOKENS = 4096
ATTEMPTS = 3
FIRST_WAIT_S = 1.0
WAIT_FACTOR = 2.0
LONGEST_WAIT_S = 60.0
DEADLINE_S = 600.0
CALLS_AT_ONCE = 16

SHARED_ROWS = 2048  # rows that are asked about with one copy of a shared text
PROMPT_CHARS = 1 << 25  # of the prompts with shared texts that are made at once

Messages = list[dict[str, str]]
Usage = dict[str, int] | None
Reply = tuple[str | None, str | None, Usage]
CompleteFn = Callable[[list[Messages]], Sequence[Reply]]

USAGE_TYPE = "struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"


class Calls:
    """Calls a function in threads beside the task, several at once; a call that takes too long is given up.

    The thread of such a call is left behind with its queue, so a late reply reaches
    nobody, and a new thread takes its place: a call that hangs holds up no other.
    """

    def __init__(self, call: CompleteFn, seconds: float, at_once: int):
        self.call, self.seconds, self.at_once = call, seconds, at_once
        self.idle: list[queue.SimpleQueue] = []

    def __call__(self, batches: list[list[Messages]]) -> list[Sequence[Reply] | Exception]:
        """The replies to each batch, or why there are none; each call has the whole time from its own start."""
        results: list[Sequence[Reply] | Exception] = [TimeoutError(f"no reply within {self.seconds:g} s")] * len(batches)
        running: dict[int, tuple[float, queue.SimpleQueue]] = {}  # in the order of their ends
        started, replies = 0, queue.SimpleQueue()
        while running or started < len(batches):
            while started < len(batches) and len(running) < self.at_once:
                asked = self.idle.pop() if self.idle else self.thread()
                running[started] = time.monotonic() + self.seconds, asked
                asked.put((started, batches[started], replies))
                started += 1
            first = next(iter(running))
            try:
                at, reply = replies.get(timeout=max(0.0, running[first][0] - time.monotonic()))
            except queue.Empty:
                running.pop(first)[1].put(None)
                continue
            if at in running:  # else it is late
                results[at] = reply
                self.idle.append(running.pop(at)[1])
        return results

    def thread(self) -> queue.SimpleQueue:
        asked: queue.SimpleQueue = queue.SimpleQueue()
        threading.Thread(target=self.serve, args=(asked,), daemon=True).start()
        return asked

    def serve(self, asked: queue.SimpleQueue) -> None:
        while (task := asked.get()) is not None:
            at, batch, replies = task
            try:
                replies.put((at, self.call(batch)))
            except Exception as failure:
                replies.put((at, failure))

    def close(self) -> None:
        """Let the threads end after what they are doing."""
        while self.idle:
            self.idle.pop().put(None)


def with_retries(
    complete_fn: CompleteFn, batch: list[Messages], attempts: int, first_wait: float, deadline_s: float | None = None, rows_per_call: int | None = None
) -> list[Reply]:
    """Ask again for the failed rows only; what still fails carries its last error.

    Each call of an attempt has the deadline, and asks about `rows_per_call` rows (all of
    them if not given); the rows of a call that is late are open again. With a deadline
    up to CALLS_AT_ONCE calls wait for their replies at the same time.
    """
    replies: list[Reply] = [(None, "not asked", None)] * len(batch)
    open_rows = list(range(len(batch)))
    wait, calls = first_wait, Calls(complete_fn, deadline_s, CALLS_AT_ONCE) if deadline_s else None
    for attempt in range(attempts):
        step = rows_per_call or max(len(open_rows), 1)
        parts = [open_rows[at : at + step] for at in range(0, len(open_rows), step)]
        asked = [[batch[i] for i in rows] for rows in parts]
        for rows, got in zip(parts, calls(asked) if calls else (_tried(complete_fn, part) for part in asked)):
            try:
                if isinstance(got, Exception):
                    raise got
                if len(got) != len(rows):
                    raise ValueError(f"{len(got)} replies to {len(rows)} requests")
            except Exception as failure:  # a failing service is a row error, not a task failure
                got = [(None, str(failure) or type(failure).__name__, None)] * len(rows)
            for i, reply in zip(rows, got):
                replies[i] = reply
        open_rows = [i for i in open_rows if replies[i][1] or replies[i][0] is None]
        if not open_rows or attempt + 1 == attempts:
            break
        time.sleep(min(wait, LONGEST_WAIT_S))
        wait *= WAIT_FACTOR
    if calls:
        calls.close()
    return replies


def _tried(complete_fn: CompleteFn, batch: list[Messages]) -> Sequence[Reply] | Exception:
    try:
        return complete_fn(batch)
    except Exception as failure:
        return failure


def complete(
    requests: DataFrame, complete_fn: CompleteFn, concurrency: int | None = None, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT_S,
    deadline_s: float | None = DEADLINE_S, rows_per_call: int | None = None, returned: list[str] | None = None,
) -> DataFrame:
    """Add (response, error, usage) to rows with a `messages` column.

    `concurrency` is the number of partitions that ask at the same time. The result
    is lazy: write it before using it twice, or the model is asked twice. A call that takes
    longer than `deadline_s` counts as failed; `rows_per_call` keeps a row that hangs from
    holding up others, so calls of one task then overlap and `complete_fn` is called from several
    threads. `returned` names the columns of the requests to keep, all if not given: prompts
    that nobody reads again need not come back from the workers.
    """
    if concurrency:
        requests = requests.repartition(concurrency)
    kept = [f for f in requests.schema.fields if f.name not in {"response", "error", "usage"}]
    requests = requests.select(*(f.name for f in kept if returned is None or f.name in returned or f.name == "messages"))
    kept = [f for f in kept if returned is None or f.name in returned]
    added = T.StructType.fromDDL(f"response string, error string, usage {USAGE_TYPE}")
    schema = T.StructType([*kept, *added.fields])
    names = [f.name for f in kept]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            batch = [[dict(m) for m in row] for row in rows["messages"]]
            replies = with_retries(complete_fn, batch, attempts, first_wait, deadline_s, rows_per_call) if batch else []
            failed = [error or ("no answer" if answer is None else "") for answer, error, _ in replies]
            yield rows[names].assign(
                response=[None if error else answer for (answer, _, _), error in zip(replies, failed)],
                error=failed,
                usage=[usage for _, _, usage in replies],
            )

    return requests.mapInPandas(ask, schema)


def complete_shared(
    requests: DataFrame, texts: DataFrame, complete_fn: CompleteFn, returned: list[str], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT_S,
    deadline_s: float | None = DEADLINE_S, rows_per_call: int | None = None, concurrency: int | None = None,
) -> DataFrame:
    """`complete` for prompts with a long text in their middle that many rows share; `returned` columns + (response, error, usage).

    `requests` has system, before, behind and ref, `texts` (ref, shared) has one row for each ref at most; the user's
    message is before, the shared text if there is one, and behind. A shared text travels once for SHARED_ROWS rows, ahead
    of them, and prompts are put together in the worker, some at a time. The requests are read twice, so they should be stored.
    """
    c = F.col
    spark = requests.sparkSession
    kept = [f for f in requests.schema.fields if f.name in returned]
    names = [f.name for f in kept]
    requests = requests.withColumn("ref", F.coalesce("ref", F.lit("")))
    many = requests.groupBy("ref").agg(F.count("*").alias("n")).where(c("n") > SHARED_ROWS)
    many = materialize(many.select("ref", F.ceil(c("n") / SHARED_ROWS).alias("_salts")), "heavy-refs")
    some = F.coalesce("_salts", F.lit(1))
    asking = requests.join(many, ["ref"], "left").withColumn("_salt", joins.salt_of(names, some)).withColumn("shared", F.lit(None).cast("string"))
    given = texts.join(many, ["ref"], "left").withColumn("_salt", F.explode(joins.salts(some)))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept]
    none = [F.lit(None).cast("string").alias(name) for name in ("system", "before", "behind")]
    columns = ["ref", "_salt", "shared", "system", "before", "behind"]
    both = asking.select(*columns, F.lit(True).alias("asks"), *names).unionByName(given.select("ref", "_salt", "shared", *none, F.lit(False).alias("asks"), *absent))
    # The number of tasks is given: by their size, which is not their work, these rows would be put together.
    parts = concurrency or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "ref", "_salt").sortWithinPartitions("ref", "_salt", "asks")
    added = T.StructType.fromDDL(f"response string, error string, usage {USAGE_TYPE}")
    usage_type = pa.struct([(f.name, pa.int32()) for f in added["usage"].dataType.fields])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared = "", ""  # the text that came last
        for batch in batches:
            refs, systems, befores, behinds, asks = (batch.column(name).to_pylist() for name in ("ref", "system", "before", "behind", "asks"))
            rows: list[int] = []
            prompts: list[Messages] = []
            size = 0
            for i in range(len(refs)):
                if not asks[i]:
                    known, shared = refs[i], batch.column("shared")[i].as_py()
                    continue
                middle = shared if refs[i] == known else ""
                size += len(befores[i]) + len(middle) + len(behinds[i])
                prompts.append([{"role": "system", "content": systems[i]}, {"role": "user", "content": befores[i] + middle + behinds[i]}])
                rows.append(i)
                if size >= PROMPT_CHARS:
                    yield answered(batch, rows, prompts)
                    rows, prompts, size = [], [], 0
            if rows:
                yield answered(batch, rows, prompts)

    def answered(batch: pa.RecordBatch, rows: list[int], prompts: list[Messages]) -> pa.RecordBatch:
        replies = with_retries(complete_fn, prompts, attempts, first_wait, deadline_s, rows_per_call)
        failed = [error or ("no answer" if answer is None else "") for answer, error, _ in replies]
        out = batch.select(names).take(pa.array(rows, pa.int64()))
        columns = [
            pa.array([None if error else answer for (answer, _, _), error in zip(replies, failed)], pa.string()),
            pa.array(failed, pa.string()),
            pa.array([usage for _, _, usage in replies], usage_type),
        ]
        return pa.RecordBatch.from_arrays([*out.columns, *columns], names=[*names, "response", "error", "usage"])

    return both.mapInArrow(ask, T.StructType([*kept, *added.fields]))


def lookup_complete_fn(answers: dict[str, str], default: str | None = None) -> CompleteFn:
    """A complete_fn over canned answers for tests: the first key found in the user text wins."""

    def answer(batch: list[Messages]) -> list[Reply]:
        replies: list[Reply] = []
        for batch_messages in batch:
            user = batch_messages[-1]["content"]
            found = next((reply for key, reply in answers.items() if key in user), default)
            replies.append((found, None if found is not None else "no canned answer", None))
        return replies

    return answer


def http_complete_fn(url: str, model: str, timeout_s: float = 300.0) -> CompleteFn:
    """Example of a complete_fn over a chat endpoint; a non-200 status or no choices is an error."""

    def ask(batch: list[Messages]) -> list[Reply]:
        import json
        from urllib import request

        replies: list[Reply] = []
        for batch_messages in batch:
            body = {"model": model, "messages": batch_messages, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "stream": False}
            call = request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            try:
                with request.urlopen(call, timeout=timeout_s) as reply:
                    data = json.load(reply)
                choices = data.get("choices") or []
                if not choices:
                    replies.append((None, "no choices in response", data.get("usage")))
                else:
                    replies.append((choices[0]["message"]["content"], None, data.get("usage")))
            except Exception as failure:
                replies.append((None, str(failure), None))
        return replies

    return ask
