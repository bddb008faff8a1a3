"""Merge-request events: routing as a stream, and reviews per micro-batch.

A review is due once for each head commit of a merge request, however often its events
repeat and however the stream is cut into batches: which heads were reviewed is kept as a
table of state, keyed by (project_id, iid, head).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchlens.functions.text import text
from patchlens.operators.comments import line_comments
from patchlens.operators.complete import CompleteFn
from patchlens.operators.inputs import changed_files
from patchlens.operators.notes import summary_notes
from patchlens.operators.review import review_files

EVENT_TYPE = (
    "struct<object_kind:string,project:struct<id:bigint>,"
    "object_attributes:struct<iid:bigint,action:string,source_branch:string,target_branch:string,updated_at:string,last_commit:struct<id:string>>>"
)
# The replies to events that are not reviewed.
RELEVANT_KIND = "merge_request"
RELEVANT_ACTIONS = ["open", "update", "reopen"]
NOT_A_MERGE_REQUEST = "not a merge request event"
ACTION_NOT_RELEVANT = "action not relevant"

KEYS = ["project_id", "iid", "head"]
PAYLOAD_PARTS = 256  # folders of stored payloads, of which a batch reads those it asks for
SNAPSHOT = 50  # every so many batches the reviewed heads are written as one table


def route_events(events: DataFrame) -> DataFrame:
    """Add (project_id, iid, action, status, reason) to events with a JSON `value`.

    status is accepted, ignored, or malformed for text that is no event.
    """
    c = F.col
    parsed = events.withColumn("_e", F.from_json("value", EVENT_TYPE, {"mode": "PERMISSIVE"})).withColumn(
        "_ok", F.try_parse_json("value").isNotNull()
    )
    kind, action = text("_e.object_kind"), text("_e.object_attributes.action")
    status = (
        F.when(~c("_ok"), "malformed")
        .when((kind != RELEVANT_KIND) | ~action.isin(RELEVANT_ACTIONS), "ignored")
        .otherwise("accepted")
    )
    reason = (
        F.when(~c("_ok"), "invalid JSON")
        .when(kind != RELEVANT_KIND, NOT_A_MERGE_REQUEST)
        .when(~action.isin(RELEVANT_ACTIONS), ACTION_NOT_RELEVANT)
        .otherwise("")
    )
    return parsed.select(
        *events.columns, c("_e.project.id").alias("project_id"), c("_e.object_attributes.iid").alias("iid"), action.alias("action"),
        status.alias("status"), reason.alias("reason"),
    )


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events landed as text files, one JSON object per line."""
    return spark.readStream.text(path)


def heads(routed: DataFrame) -> DataFrame:
    """(project_id, iid, head) of the accepted events, each once.

    The head is the last commit; events that name none are told apart by their time of
    update, and failing that by their text.
    """
    event = F.from_json("value", EVENT_TYPE)["object_attributes"]
    head = F.coalesce(event["last_commit"]["id"], event["updated_at"], F.sha2("value", 256))
    return routed.where("status = 'accepted'").select("project_id", "iid", head.alias("head")).distinct()


def payload_part(project_id: Column, iid: Column) -> Column:
    return F.pmod(F.xxhash64(project_id.cast("bigint"), iid.cast("bigint")), F.lit(PAYLOAD_PARTS)).cast("int")


def store_payloads(payloads: DataFrame, path: str) -> None:
    """Write payloads (project_id, iid, ...) so that those of few merge requests are read from few folders."""
    rows = payloads.withColumn("part", payload_part(F.col("project_id"), F.col("iid")))
    rows.hint("rebalance", "part").sortWithinPartitions("part", "project_id", "iid").write.mode("overwrite").partitionBy("part").parquet(path)


def looked_up(payloads: DataFrame, wanted: DataFrame) -> DataFrame:
    """The payloads of the wanted merge requests; of stored ones only their folders are read (at most PAYLOAD_PARTS numbers reach the driver)."""
    asked = wanted.select("project_id", "iid").distinct()
    if "part" in payloads.columns:
        parts = [r[0] for r in asked.select(payload_part(F.col("project_id"), F.col("iid"))).distinct().collect()]
        payloads = payloads.where(F.col("part").isin(parts)).drop("part")
    return payloads.join(asked, ["project_id", "iid"], "left_semi")


def review_events(wanted: DataFrame, payloads: DataFrame, complete_fn: CompleteFn, **options) -> DataFrame:
    """Reviews of the files of merge requests (project_id, iid, head); their key is review_id, a struct.

    `payloads` is (project_id, iid, value) with the change list of each merge request; a
    malformed one is a row with its error.
    """
    asked = looked_up(payloads, wanted).join(wanted, ["project_id", "iid"])
    # The whole key goes along in the place of the project, as a payload may name another iid, or none.
    files = changed_files(asked.withColumn("project_id", F.struct(*KEYS))).withColumnRenamed("project_id", "review_id")
    return review_files(files.withColumn("full_content", F.lit("")), complete_fn, **options)


def outputs(results: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, comments) of written results, by project_id, iid and head."""
    keys = [F.col(f"review_id.{k}") for k in KEYS]
    notes = summary_notes(results).select(*keys, "part", "file_no", "body")
    with_keys = results.select(*keys, "file_no", "file_path", "result")
    return notes, line_comments(with_keys, looked_up(versions, with_keys), ["head"])


class BatchFolder:
    """Tables of one micro-batch under `out_dir/<table>/batch=<n>`, and marks that say which are whole."""

    def __init__(self, spark: SparkSession, out_dir: str, batch_id: int):
        self.spark, self.out_dir, self.batch_id = spark, out_dir, batch_id

    def at(self, table: str, batch_id: int | None = None) -> str:
        return f"{self.out_dir}/{table}/batch={self.batch_id if batch_id is None else batch_id}"

    def read(self, table: str, batch_id: int | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.at(table, batch_id))
        except AnalysisException:
            return None

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(table))
        return self.spark.read.schema(df.schema).parquet(self.at(table))

    def write_once(self, make: Callable[[], DataFrame], table: str) -> DataFrame:
        """What make() gives, or what an earlier run of this batch has written whole: its mark is one row in one file."""
        if self.read(f"marks/{table}") is None:
            self.write(make(), table)
            self.mark(table)
        return self.read(table)

    def mark(self, table: str) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("written_at")).coalesce(1).write.mode("overwrite").parquet(self.at(f"marks/{table}"))

    def reviewed(self) -> DataFrame | None:
        """Heads that batches before this one have reviewed: the last snapshot and the batches since."""
        first = (self.batch_id - 1) // SNAPSHOT * SNAPSHOT if self.batch_id else 0
        found = [t for n in range(first, self.batch_id) if (t := self.read("reviewed", n)) is not None]
        rows = None
        for t in found:
            rows = t if rows is None else rows.unionByName(t)
        return rows


def handle_batch(
    batch: DataFrame, batch_id: int, payloads: DataFrame, versions: DataFrame, complete_fn: CompleteFn, out_dir: str, **options
) -> tuple[DataFrame, DataFrame]:
    """Review the routed events of one micro-batch and write all its tables; returns (notes, comments) as written.

    Rejected events go to `rejected`, reviews to `results`, `notes` and `comments`, the heads
    to `reviewed`; the mark of `done` comes last, so readers that ask for it see all or
    nothing. A batch that is run again replaces its tables, but asks no model again once
    its results are whole.
    """
    folder = BatchFolder(batch.sparkSession, out_dir, batch_id)
    routed = folder.write(batch, "events")
    folder.write(routed.where("status <> 'accepted'"), "rejected")
    before = folder.reviewed()
    due = heads(routed)
    due = folder.write(due if before is None else due.join(before, KEYS, "left_anti"), "due")
    results = folder.write_once(lambda: review_events(due, payloads, complete_fn, **options), "results")
    notes, comments = outputs(results, versions)
    written = folder.write(notes, "notes"), folder.write(comments, "comments")
    folder.write(due.unionByName(before) if before is not None and batch_id % SNAPSHOT == 0 else due, "reviewed")
    folder.mark("done")
    return written


def read_done(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A table of all batches that are done."""
    done = spark.read.parquet(f"{out_dir}/marks/done").select("batch").distinct()
    return spark.read.parquet(f"{out_dir}/{table}").join(done, "batch", "left_semi")


def start_reviews(
    events: DataFrame, payloads: DataFrame, versions: DataFrame, complete_fn: CompleteFn, out_dir: str, checkpoint: str,
    on_batch: Callable[[DataFrame, DataFrame], None] | None = None, available_now: bool = False, **options,
) -> StreamingQuery:
    """Review merge requests as their events arrive; `handle_batch` says what is written. `on_batch` may deliver notes and comments."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        notes, comments = handle_batch(batch, batch_id, payloads, versions, complete_fn, out_dir, **options)
        if on_batch:
            on_batch(notes, comments)

    writer = route_events(events).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
