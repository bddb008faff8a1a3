"""Near copies by word shingles: MinHash LSH forest, then exact verification.

A text is the set of its runs of five words (all of them, if fewer). Texts of equal sets are one
class from the start. For the classes

1. each of `TREES` trees orders them by a label of `DEPTH` minimum hashes;
2. classes meet in a tree as long as their labels share a prefix. Matched prefixes are
   shortened from the full label downwards, linking what agrees in enough of all hashes, to
   the length at which a pair of exactly the asked similarity is met with the target recall;
3. linked classes form candidate components, whose shingle sets are compared exactly, each
   pair once. Pairs at or above the threshold are the links.

Groups and components of more than `BLOCK` members are cut into blocks, every pair of blocks
being a unit of its own, so no task holds more than two blocks; units give one row per member
and never the pairs.

Defined cases: null, empty and blank texts have no links and are each their own class; rows
without an id have a null class and no links; rows of one id count as one document; copies
count in the number of links; a class is named by its smallest id, so ties cannot occur;
columns other than id and text are dropped.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators import joins
from patchlens.session import materialize

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.995
BLOCK = 512
BROADCAST_ROWS = 500_000  # ids that may be sent to all tasks; more are joined by a shuffle


def shortest_prefix(threshold: float, recall: float) -> int:
    """The longest prefix at which pairs of this similarity still meet in some tree with the target recall."""
    found = [p for p in range(1, DEPTH + 1) if 1 - (1 - threshold**p) ** TREES >= recall]
    return max(found, default=1)


def least_agreement(threshold: float) -> int:
    """Hashes that must agree for a pair to be compared: five standard deviations below the threshold."""
    n = TREES * DEPTH
    return int(n * (threshold - 5 * (threshold * (1 - threshold) / n) ** 0.5))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    def __init__(self):
        import xxhash

        from patchlens.llm.merges import Recent

        self.words = Recent(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 200_000)
        rng = np.random.default_rng(20_240_501)
        n = TREES * DEPTH
        self.factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.offsets = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        w = np.fromiter(map(self.words.__getitem__, text.split()), dtype=np.uint64)
        if not len(w):
            return w
        n = max(len(w) - WORDS + 1, 1)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(min(WORDS, len(w))):
            h = _mixed(h * np.uint64(0x100000001B3) + w[i : i + n])
        return np.unique(h)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest value of each hash function, 32 bits."""
        least = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048, None] * self.factors + self.offsets
            least = np.minimum(least, (part >> np.uint64(32)).min(axis=0))
        return least.astype(np.uint32)


def digest(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, own: str, text: str) -> DataFrame:
    """(own, n, digest, sig, keys): n shingles, hashes cut to 16 bits, and the matched prefix of each tree as one number."""
    prefix = shortest_prefix(THRESHOLD, RECALL)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlens.llm import near_join as nj
        from patchlens.llm.workers import tool as kept

        tool = kept(("near_join",), nj.Shingler)
        for batch in batches:
            ns, digests, sigs, keys = [], [], [], []
            for t in (x.as_py() for x in batch.column("text")):
                s = tool.shingles(t)
                ns.append(len(s))
                digests.append(nj.digest(s))
                sig = tool.signature(s)
                sigs.append(sig.astype(np.uint16).tobytes())
                label = sig.reshape(nj.TREES, nj.DEPTH)[:, :prefix].astype(np.uint64)
                h = np.arange(nj.TREES, dtype=np.uint64)
                for i in range(prefix):
                    h = nj._mixed(h * np.uint64(0x100000001B3) + label[:, i])
                keys.append(h.view(np.int64))
            flat = np.concatenate(keys) if keys else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("own"), pa.array(ns, pa.int32()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ns) + 1) * nj.TREES, pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["own", "n", "digest", "sig", "keys"],
            )

    rows = docs.select(F.col(own).cast("bigint").alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "own bigint, n int, digest binary, sig binary, keys array<bigint>")


class Sets:
    """Union-find over positions; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int):
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by the keys; a run may go on in the next batch."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = first != last
        last = tuple(c[-1] for c in columns)
        starts = np.flatnonzero(change).tolist()
        if starts and starts[0] == 0 and held:
            yield pa.concat_tables(held)
            held = []
        bounds = [*([] if starts and starts[0] == 0 else [0]), *starts, batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            held.append(table.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def descend(labels: np.ndarray, sig: np.ndarray, n: np.ndarray, block: np.ndarray, prefix: int, agree: int, threshold: float) -> Sets:
    """Link members of one prefix group, from the longest shared prefix of their labels to the shortest.

    Members of equal prefix that are already linked need no comparison when the prefix is shortened.
    """
    order = np.lexsort(labels.T[::-1])
    sets, cross = Sets(len(n)), len(np.unique(block)) > 1
    for depth in range(labels.shape[1], prefix - 1, -1):
        sorted_ = labels[order, :depth]
        cuts = np.flatnonzero((sorted_[1:] != sorted_[:-1]).any(axis=1)) + 1
        for members in np.split(order, cuts):
            if len(members) < 2:
                continue
            roots = np.array([sets.root(int(i)) for i in members])
            if (roots == roots[0]).all():
                continue
            same = np.zeros((len(members), len(members)), dtype=np.uint8)
            for column in sig[members].T:
                same += column[:, None] == column
            size = n[members].astype(np.float64)
            near = (same >= agree) & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size)) & (roots[:, None] != roots)
            if cross:
                near &= block[members][:, None] != block[members]
            for i, j in np.argwhere(np.triu(near, 1)):
                sets.join(int(members[i]), int(members[j]))
    return sets


def blocks_of(rows: DataFrame, group: str, node: str, size: str) -> DataFrame:
    """A row per unit: the pairs of blocks of each group that the row belongs to."""
    n = F.ceil(F.col(size) / BLOCK).cast("bigint")
    mine = rows.withColumn("block", F.pmod(F.xxhash64(node), n))
    others = mine.withColumn("other", F.explode(joins.salts(n)))
    return others.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): edges that connect classes which agree in enough hashes, at most one per member of a unit."""
    prefix, agree, threshold = shortest_prefix(THRESHOLD, RECALL), least_agreement(THRESHOLD), THRESHOLD
    met = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = met.join(shared, "key")
    units = blocks_of(members, "key", "node", "members").join(classes.select("node", "n", "sig"), "node")
    sorted_ = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlens.llm import near_join as nj

        out: tuple[list, list] = ([], [])

        def made():
            rows = pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
            out[0].clear()
            out[1].clear()
            return rows

        for run in nj.runs(batches, ["key", "low", "high"]):
            if run.num_rows < 2:
                continue
            node, n, block = (run.column(c).to_numpy() for c in ("node", "n", "block"))
            sig = np.frombuffer(b"".join(run.column("sig").to_pylist()), np.uint16).reshape(run.num_rows, -1)
            if run.num_rows == 2:
                near = (sig[0] == sig[1]).sum() >= agree and min(n) >= threshold * max(n)
                if near and not (block[0] == block[1] and run.column("low")[0] != run.column("high")[0]):
                    out[0].append(int(node[0]))
                    out[1].append(int(node[1]))
            else:
                tree = run.column("tree")[0].as_py()
                sets = nj.descend(sig[:, tree * nj.DEPTH : (tree + 1) * nj.DEPTH], sig, n, block, prefix, agree, threshold)
                for i in range(len(node)):
                    if (r := sets.root(i)) != i:
                        out[0].append(int(node[r]))
                        out[1].append(int(node[i]))
            if len(out[0]) > 50_000:
                yield made()
        yield made()

    return sorted_.mapInArrow(link, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node it is connected with.

    Every node is linked to the smallest of its neighbours, in turn with the larger and the
    smaller ones, until nothing changes; each step is a minimum per node and a join, with the
    edges written in between.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = materialize(small.unionByName(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct(), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        state = seen


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    common = times[column] > 1
    owner, column = owner[common], number[column[common]]
    width = int((times > 1).sum())
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), min(4096, width - at)), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total


def verified(docs: DataFrame, classes: DataFrame, components_: DataFrame, own: str, text: str) -> DataFrame:
    """(node, links, root): per member of a unit, the rows it is linked with there and the smallest member of its part."""
    sizes = components_.groupBy("root").agg(F.count("*").alias("size"))
    wanted = components_.join(sizes, "root").join(classes.select("node", "copies", F.col("digest").alias("want")), "node")
    rows = docs.select(F.col(own).cast("bigint").alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    wanted = materialize(wanted, "members")
    few = wanted.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlens.llm import near_join as nj
        from patchlens.llm.workers import tool as kept

        tool = kept(("near_join",), nj.Shingler)
        for batch in batches:
            found = [tool.shingles(t) for t in (x.as_py() for x in batch.column("text"))]
            keep = [nj.digest(s) == d for s, d in zip(found, batch.column("want").to_pylist())]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            shingles = pa.array([s.tobytes() for s, k in zip(found, keep) if k], pa.binary())
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("node", "root", "size", "copies")), shingles], names=["node", "root", "size", "copies", "shingles"])

    shingled = texts.mapInArrow(cut, "node bigint, root bigint, size bigint, copies bigint, shingles binary")
    units = blocks_of(shingled, "root", "node", "size").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")
    threshold = THRESHOLD

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlens.llm import near_join as nj

        for run in nj.runs(batches, ["root", "low", "high"]):
            node, first = np.unique(run.column("node").to_numpy(), return_index=True)  # rows that repeat an id count once
            run = run.take(first)
            copies, block = run.column("copies").to_numpy(), run.column("block").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in run.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            shared = nj.shared_counts(sets)
            near = shared >= threshold * (size[:, None] + size - shared) - 1e-9
            np.fill_diagonal(near, False)
            if run.column("low")[0] != run.column("high")[0]:
                near &= block[:, None] != block  # pairs within a block have a unit of their own
            parts = nj.Sets(len(node))
            for i, j in np.argwhere(np.triu(near, 1)):
                parts.join(int(i), int(j))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(node, pa.int64()), "links": pa.array((near * copies).sum(axis=1), pa.int64()),
                "root": pa.array([int(node[parts.root(i)]) for i in range(len(node))], pa.int64()),
            })

    return units.mapInArrow(compare, "node bigint, links bigint, root bigint")


def near_copies(docs: DataFrame, own: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: (own, class_id, n_links)."""
    signed = materialize(signatures(docs, own, text), "signatures")
    present = signed.where("own is not null and n > 0")
    by_set = present.groupBy("digest").agg(
        F.min("own").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    classes = materialize(by_set, "classes")
    components_ = components(candidates(classes))
    found = materialize(verified(docs, classes, components_, own, text), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    named = (
        classes.select("digest", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
        .select("digest", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    rows = signed.select("own", F.when(F.col("own").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
    return rows.join(named, "digest", "left").select(
        F.col("own").alias(own), F.coalesce("class_id", "own").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
