"""Quality by the votes of labelled neighbours among latent-semantic vectors.

A text is a bag of features: its words, the marks between them, the shape of each word
(capitals, figures, marks) and words that repeat the one before, hashed to `FEATURES` places.
Counts are damped and weighted by how rare a place is over the whole corpus. The labelled
sample spans a space of `DIMENSIONS` latent directions, found by subspace iteration; texts
and labelled texts are unit vectors in it.

Every document meets every labelled vector in exact blocked products. Its `NEIGHBOURS` most
similar ones, and all others as similar as the last of these, vote by their similarity; the
share of good labels counts as one vote more.

The sample has at most `SAMPLE` labelled rows, equal texts as one vector with the mean of
their labels; so the vectors and directions sent to all tasks have at most
(SAMPLE + FEATURES) * DIMENSIONS numbers, 9 MB. How rare a place is is counted over all documents.

Defined cases: a null text counts as empty; texts without features get the share of good
labels; ids labelled twice are good if either label is; without labels all scores are 0.5;
null ids have no label and count as the text "" when rows are held out; equal rows get equal
scores; columns other than id and text are dropped; an empty table gives an empty one.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.session import materialize

SAMPLE = 20_000  # labelled rows to fit on
FEATURES, DIMENSIONS = 1 << 14, 64
NEIGHBOURS = 15
SHARPNESS = 8  # power of the similarity in a vote
ROUNDS, SPARE = 6, 8  # of the subspace iteration; directions kept beside until the end
PARTS = 8  # tasks of a round, each of which sends one sum to the driver
BLOCK = 256  # documents in one product
THRESHOLD = 0.7

TOKEN = re.compile(r"\w+|[^\w\s]+")


def place_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % FEATURES


class Bags:
    """Texts as sorted places and damped counts."""

    def __init__(self):
        from patchlens.llm.merges import Recent

        self.codes, self.forms = Recent(self.places, 300_000), Recent(lambda shape: place_of("shape " + shape), 10_000)

    def places(self, token: str) -> int:
        """The place of the token and that of its shape, in one number."""
        if token.isalpha() and token[1:].islower():
            shape = "a" if token[0].islower() else "Aa"
        else:
            shape = "".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token))
        return place_of(token.lower()) * FEATURES + self.forms[shape]

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.fromiter(map(self.codes.__getitem__, TOKEN.findall(text)), np.int64)
        both = np.concatenate(np.divmod(codes, FEATURES))
        again = int((codes[1:] == codes[:-1]).sum()) if len(codes) > 1 else 0
        counts = np.bincount(both, minlength=FEATURES)
        counts[0] += again  # the place of repeats, shared with few words
        at = np.flatnonzero(counts)
        return at, np.log1p(counts[at]).astype(np.float32)


def held_out(own: Column, modulus: int = 4, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def bag_tool() -> Bags:
    from patchlens.llm import quality
    from patchlens.llm.workers import tool

    return tool(("quality",), quality.Bags)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight of each place: a row for each of FEATURES places at most reaches the driver."""

    def count(batches):
        from patchlens.llm import quality

        tool, seen, n = quality.bag_tool(), np.zeros(quality.FEATURES, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen[tool.bag(t.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"place": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([n, *seen[at].tolist()], pa.int64())})

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "place int, n bigint")
    sums = {r.place: r.n for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    total = sums.pop(-1, 0)
    seen = np.zeros(FEATURES)
    seen[list(sums)] = list(sums.values())
    return (np.log((total + 1) / (seen + 1)) + 0.1).astype(np.float32)


def labelled_bags(docs: DataFrame, labels: DataFrame, keep: Column, own: str, text: str) -> DataFrame:
    """(places, counts, good, n) of the distinct texts of at most SAMPLE labelled documents; good of n labels are 1.

    Which rows are taken depends on a hash of their ids. The ids, at most SAMPLE, are
    broadcast, so the texts of other documents are not shuffled.
    """
    marked = (
        labels.select(F.col(own).alias("own"), F.col("quality").cast("int").alias("good")).where(keep & F.col("own").isNotNull() & F.col("good").isNotNull())
        .groupBy("own").agg(F.max("good").alias("good")).orderBy(F.xxhash64("own"), "own").limit(SAMPLE)
    )
    rows = docs.select(F.col(own).alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(marked), "own")

    def make(batches):
        from patchlens.llm import quality

        tool = quality.bag_tool()
        for batch in batches:
            found = [tool.bag(t.as_py()) for t in batch.column("text")]
            starts = pa.array(np.cumsum([0, *(len(a) for a, _ in found)]), pa.int32())
            lists = [np.concatenate([x[i] for x in found]) if found else np.array([]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(starts, pa.array(lists[0], pa.int32())), pa.ListArray.from_arrays(starts, pa.array(lists[1], pa.float32())), batch.column("good")],
                names=["places", "counts", "good"],
            )

    bags = rows.select("text", "good").mapInArrow(make, "places array<int>, counts array<float>, good int")
    one = bags.where("size(places) > 0").groupBy("places", "counts").agg(F.sum((F.col("good") > 0).cast("double")).alias("good"), F.count("*").cast("double").alias("n"))
    return one.repartition(PARTS, "places").sortWithinPartitions("places", "counts")


def directions(sample: DataFrame, weights: np.ndarray) -> np.ndarray:
    """FEATURES x DIMENSIONS: the leading directions of the weighted bags.

    In each round every task multiplies its bags with the directions so far and adds up
    what they point to; PARTS sums of one bounded size reach the driver.
    """
    width = DIMENSIONS + SPARE
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((FEATURES, width)))[0].astype(np.float32)

    rows = sample.select("places", "counts").coalesce(PARTS)

    for _ in range(ROUNDS):
        sent = sample.sparkSession.sparkContext.broadcast(basis)

        def turn(batches):
            total = np.zeros(sent.value.shape, np.float32)
            for batch in batches:
                for at, counts in zip(batch.column("places"), batch.column("counts")):
                    at = at.values.to_numpy()
                    x = counts.values.to_numpy() * weights[at]
                    x = x / np.sqrt((x * x).sum())
                    total[at] += np.outer(x, x @ sent.value[at])
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

        # As Arrow, and added one by one: rows would be copied several times on their way.
        total = np.zeros((FEATURES, width))
        for part in rows.mapInArrow(turn, "total binary").toArrow().column("total"):
            total += np.frombuffer(part.as_buffer(), np.float32).reshape(FEATURES, width)
        basis, strength, _ = np.linalg.svd(total, full_matrices=False)
        basis = basis.astype(np.float32)
        del total
        sent.destroy()
    # Directions of no strength are rounding noise.
    return basis[:, :DIMENSIONS] * (strength[:DIMENSIONS] > 1e-6 * max(strength[0], 1e-30)).astype(np.float32)


def vector(at: np.ndarray, counts: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v = (counts * weights[at]) @ basis[at]
    size = float(np.sqrt((v * v).sum()))
    return v / size if size > 1e-12 else np.zeros_like(v)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, own: str = "doc_id", text: str = "text") -> dict | None:
    """The model. keep: which labels, as a condition on `own`. None without labelled texts."""
    sample = materialize(labelled_bags(docs, labels, keep, own, text), "quality-sample")
    rows = sample.select("good", "n").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    if not rows.n:
        return None
    weights = rarity(docs, text)
    basis = directions(sample, weights)
    sent = sample.sparkSession.sparkContext.broadcast(basis)

    def place(batches):
        from patchlens.llm import quality

        for batch in batches:
            made = [quality.vector(a.values.to_numpy(), c.values.to_numpy(), weights, sent.value).tobytes() for a, c in zip(batch.column("places"), batch.column("counts"))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column("good"), batch.column("n")], names=["vector", "good", "n"])

    known = sample.mapInArrow(place, "vector binary, good double, n double").toArrow()  # at most SAMPLE rows
    sent.destroy()
    vectors = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in known["vector"]])
    good = known["good"].to_numpy() / known["n"].to_numpy()
    return {"weights": weights, "basis": basis, "vectors": vectors, "good": good, "share": rows.good / rows.n}


def votes(block: np.ndarray, vectors: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Scores of unit vectors (or zeros) by their neighbours among the labelled ones."""
    like = block @ vectors.T
    k = min(NEIGHBOURS, len(vectors))
    # Similarities count as equal where five decimals are.
    least = np.round(np.partition(like, len(vectors) - k, axis=1)[:, len(vectors) - k], 5)
    row, column = np.nonzero(like >= np.maximum(least, 1e-5)[:, None] - 1e-5)
    near = np.round(like[row, column], 5)
    kept = (near >= least[row]) & (near > 0)
    row, column, near = row[kept], column[kept], near[kept]
    vote = near.astype(np.float64) ** SHARPNESS
    total = np.bincount(row, vote, len(block))
    yes = np.bincount(row, vote * good[column], len(block))
    # Ties beyond the k-th neighbour make no difference to the weight of the prior.
    voters = np.bincount(row, minlength=len(block))
    return (yes + share * total / np.maximum(voters, 1) + 1e-9 * share) / (total + total / np.maximum(voters, 1) + 1e-9)


def score(docs: DataFrame, model: dict | None, own: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, score) of every document."""
    if model is None:
        return docs.select(own, F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        from patchlens.llm import quality

        tool, m, out = quality.bag_tool(), sent.value, []
        for at in range(0, len(texts), BLOCK):
            block = np.stack([quality.vector(*tool.bag(t.as_py()), m["weights"], m["basis"]) for t in texts[at : at + BLOCK]])
            out.append(quality.votes(block, m["vectors"], m["good"], m["share"]))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.select(own, judge(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("score"))
