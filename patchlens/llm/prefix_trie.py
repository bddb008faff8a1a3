"""Trie of conversation prefixes, with totals of subtrees by depth-band rollup.

A node is a distinct sequence of turns that some conversation starts with; the root is the
empty one. Nodes are named by a chain of digests over their turns, so equal prefixes meet
without comparing texts. The chain starts anew every `BLOCK` turns and the blocks are chained
in a second step, so a conversation of any length is spread over tasks.

Totals of subtrees: the depths are cut into bands of `HEIGHT`. Every node explodes to its
ancestors within its own band only. The totals at the tops of the bands are then completed,
and every completed top explodes once to its ancestors in the band above. The tops themselves
are a trie of 1/HEIGHT of the depth, and are completed the same way; so the rounds grow with
the logarithm of the depth, and a node makes at most 2 * HEIGHT rows. Ancestors come from the
path of the conversation that names the node, joined by (conversation, band): no such key has
more than HEIGHT rows on either side, whatever is common in the corpus.

Defined cases: turns are ordered by turn (null first), ties by role, then text; null roles
and texts are empty; repeated rows are turns of their own; rows without conversation id are
left out; no conversations, no nodes; other columns are dropped.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.operators.joins import spread_join
from patchlens.session import materialize

HEIGHT = 8
BLOCK = 4096
IDS = 256  # conversation ids in one piece of a digest's input
ROOT = bytearray(16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes) of conversations (conv_id, turn, role, text); pos counts from 1.

    Rows are sorted over range partitions that may cut through a conversation; what it has
    in the partitions before is added to the positions.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("n")
    )
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "n"]  # n spreads equal rows
    marked = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")
    )

    def number(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            at = np.arange(len(ids)) - np.repeat(starts, np.diff([*starts, len(ids)]))
            if ids[0] == last:
                at[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part), pa.int64()), pa.array(at + 1, pa.int64()), *(batch.column(c) for c in ("conv_id", "digest", "n_bytes"))],
                names=["part", "at", "conv_id", "digest", "n_bytes"],
            )

    numbered = materialize(marked.mapInArrow(number, "part bigint, at bigint, conv_id bigint, digest string, n_bytes bigint"), "turns")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Each partition goes on with at most one conversation of the one before: no more rows than partitions.
    goes_on = numbered.groupBy("conv_id", "part").agg(F.max("at").alias("n")).withColumn("before", before).where("before is not null")
    return numbered.join(F.broadcast(goes_on.select("conv_id", "part", "before")), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n_bytes"
    )


def regrafted(turns: DataFrame, source: Column, head: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another: (members, turns), both by conv_id.

    The first `head` turns (an expression of conv_id, at most `longest_head`) are those of the
    conversation `source` (likewise), as many as it has; turns of its own follow after its
    first `head`.
    """
    heads = turns.where(F.col("pos") <= longest_head).withColumnRenamed("conv_id", "source")
    members = turns.select("conv_id").distinct().withColumn("head", head).withColumn("source", source)
    grown = heads.groupBy("source").agg(F.max("pos").alias("there"))
    members = materialize(members.join(grown, "source", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0)))), "members")
    first = members.join(heads, "source").where("pos <= head").select("conv_id", "pos", "digest", "n_bytes")
    own = spread_join(turns, members.select("conv_id", "head", "taken"), ["conv_id"], ["pos"]).where("pos > head")
    rest = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "digest", "n_bytes")
    return members.select("conv_id"), materialize(first.unionByName(rest), "regrafted")


def chained(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """rows with `value` replaced by the digest of the chain of its group's values up to it."""
    columns = [*group, order, value, *(c for c in rows.columns if c not in (*group, order, value))]
    sorted_rows = rows.select(*columns).repartition(*group).sortWithinPartitions(*group, order)

    def chain(batches):
        at, link = None, b""
        for batch in batches:
            made = []
            for *key, digest in zip(*(batch.column(c).to_pylist() for c in (*group, value))):
                if key != at:
                    at, link = key, b""
                link = hashlib.sha256(link + digest.encode()).digest()
                made.append(link.hex())
            spot = columns.index(value)
            yield batch.set_column(spot, value, pa.array(made, pa.string()))

    return sorted_rows.mapInArrow(chain, sorted_rows.schema)


def paths_of(members: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, n_bytes): the nodes each conversation runs through, from the root on."""
    block = F.expr(f"(pos - 1) div {BLOCK}")
    inside = materialize(chained(turns.withColumn("block", block), ["conv_id", "block"], "pos", "digest"), "chains")
    whole = inside.where(f"pos % {BLOCK} = 0").select("conv_id", "block", "digest")
    before = chained(whole, ["conv_id"], "block", "digest").select("conv_id", (F.col("block") + 1).alias("block"), F.col("digest").alias("before"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.coalesce("before", F.lit("")), "digest"), 256), 1, 32))
    below = inside.join(before, ["conv_id", "block"], "left").select("conv_id", F.col("pos").alias("depth"), name.alias("node"), "n_bytes")
    zero = F.lit(0).cast("bigint")
    return below.unionByName(members.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("node"), zero.alias("n_bytes")))


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """(node, values summed over the subtree of the node).

    nodes has node, conv_id (a conversation that runs through it), depth and the values;
    paths has conv_id, depth and node.
    """

    def placed(rows: DataFrame, unit: int) -> DataFrame:
        at = rows.where(f"depth % {unit} = 0").withColumn("q", F.expr(f"depth div {unit}"))
        return at.withColumn("band", F.expr(f"q div {height}"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(*(F.sum(v).alias(v) for v in values))

    def own_band(own: DataFrame, unit: int) -> DataFrame:
        up = placed(paths, unit).select("conv_id", "band", F.col("q").alias("above"), "node")
        return summed(placed(own.drop("node"), unit).join(up, ["conv_id", "band"]).where("above <= q").select("node", *values))

    levels, own = [], nodes
    unit = 1
    while True:
        partial = materialize(own_band(own, unit), "band-sums")
        levels.append((unit, partial))
        if deepest < unit * height:
            break
        unit *= height
        own = nodes.where(f"depth % {unit} = 0").select("node", "conv_id", "depth").join(partial, "node")
    done = levels.pop()[1]  # one band holds all
    for unit, partial in reversed(levels):
        tops = nodes.where(f"depth > 0 and depth % {unit * height} = 0").select("node", "conv_id", "depth").join(done, "node")
        up = placed(paths, unit).select("conv_id", (F.col("band") + 1).alias("band"), "node")
        lent = placed(tops.drop("node"), unit).join(up, ["conv_id", "band"]).select("node", *values)
        done = materialize(summed(partial.select("node", *values).unionByName(lent)), "band-totals")
    return done


def ends_digests(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the comma-joined ascending ids of the conversations that end at a node."""
    ends = paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    piece = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ends.groupBy("node", F.expr(f"floor(conv_id / {IDS}.0D)").alias("piece")).agg(piece.alias("ids"))

    def digest(batches):
        at = state = None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.binary()), pa.array([b for _, b in done], pa.string())], names=["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(members: DataFrame, turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    members has a conv_id of each conversation, turns (conv_id, pos, digest, n_bytes). conv_id
    of a node is the smallest member; saved_tokens sums, over the subtree, the bytes of a
    node's last text times all its members but one.
    """
    paths = materialize(paths_of(members, turns), "paths")
    deepest = paths.agg(F.max("depth")).first()[0]
    found = paths.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    found = materialize(found.join(up, ["conv_id", "depth"], "left"), "nodes")
    children = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "counted-nodes")
    own = nodes.select(
        "node", "conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    sums = subtree_sums(own, paths, ["n_leaves", "saved_tokens"], deepest or 0, height)
    whole = nodes.join(sums, "node").join(ends_digests(paths), "node", "left")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = spread_join(whole, parents, ["parent"], ["node"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return named.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
