"""Mixing sources: raking token weights to target marginals, and sampling by them.

Tokens are counted per cell (source, language, topic). Iterative proportional fitting scales
the cells until their sums agree with the target share of every source, language and topic.
A document is then kept with a probability in proportion to what its cell gained, at most 1,
scaled so that the expected tokens are the asked share of all.

Targets that are not given follow the corpus, flattened: its shares to the power `FLATTEN`.
Topics come from clustering: documents are hashed bags of words on the unit sphere, and the
centres are moved to the mean of their documents over the whole corpus.

Defined cases: null sources, languages and texts are categories of their own (a null text has
no words and topic 0); texts without words are kept with the probability of their cell, 1 if
it has no tokens; given targets for values that do not occur are ignored and those for values
that are missing from them are 0; equal rows are kept or dropped together; an empty table
gives an empty one; other columns are kept, and outputs replace columns of the same name.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.operators import joins
from patchlens.session import materialize

TOPICS, DIMENSIONS, MOVES = 8, 64, 5
START_ROWS = 2_000  # documents among which the first centres are chosen
FLATTEN = 0.7
CYCLES, TOLERANCE = 40, 1e-6
BROADCAST_CELLS = 100_000


# --- topics -------------------------------------------------------------------------------


class Bags:
    """Texts as signed counts of hashed words, on the unit sphere."""

    def __init__(self):
        import xxhash

        from patchlens.llm.merges import Recent

        self.codes = Recent(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % (2 * DIMENSIONS), 200_000)

    def bag(self, text: str) -> tuple[int, np.ndarray]:
        codes = np.fromiter(map(self.codes.__getitem__, text.lower().split()), dtype=np.int64)
        counts = np.bincount(codes, minlength=2 * DIMENSIONS)
        v = (counts[:DIMENSIONS] - counts[DIMENSIONS:]).astype(np.float32)
        size = float(np.sqrt((v * v).sum()))
        return len(codes), v / size if size else v


def bags(docs: DataFrame, own: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, chance, source, lang, n_tokens, bag) of every document."""

    def make(batches):
        from patchlens.llm import mixing
        from patchlens.llm.workers import tool as kept

        tool = kept(("mixing",), mixing.Bags)
        for batch in batches:
            found = [tool.bag(t) for t in (x.as_py() for x in batch.column("text"))]
            flat = np.concatenate([v for _, v in found]) if found else np.array([], np.float32)
            rest = ["own", "chance", "source", "lang"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in rest), pa.array([n for n, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * mixing.DIMENSIONS, pa.int32()), pa.array(flat, pa.float32())),
                ],
                names=[*rest, "n_tokens", "bag"],
            )

    rows = docs.select(
        F.col(own).cast("bigint").alias("own"), chance(F.col(own), F.col(text)).alias("chance"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(make, "own bigint, chance double, source string, lang string, n_tokens bigint, bag array<float>")


def first_centres(made: DataFrame, topics: int) -> np.ndarray:
    """Documents far from each other, out of at most START_ROWS."""
    rows = made.where("n_tokens > 0").orderBy(F.xxhash64("bag"), "n_tokens").limit(START_ROWS).select("bag").collect()
    v = np.array([r.bag for r in rows], dtype=np.float32).reshape(-1, DIMENSIONS)
    if not len(v):
        return np.zeros((1, DIMENSIONS), dtype=np.float32)
    chosen, nearest = [0], v @ v[0]
    while len(chosen) < min(topics, len(v)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    return v[chosen]


def centres_of(made: DataFrame, topics: int = TOPICS) -> np.ndarray:
    """Topic centres over all documents; each move sums the bags of a topic per task first."""
    centres = first_centres(made, topics)
    for _ in range(MOVES):
        sent = centres

        def add(batches):
            total = np.zeros_like(sent, dtype=np.float64)
            for batch in batches:
                v = batch.column("bag").flatten().to_numpy().reshape(-1, sent.shape[1])
                np.add.at(total, np.argmax(v @ sent.T, axis=1), v)
            at = np.arange(total.size)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "s": pa.array(total.ravel(), pa.float64())})

        sums = np.zeros(centres.size)
        for r in made.select("bag").mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
            sums[r["at"]] = r["s"]
        sums = sums.reshape(centres.shape)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres).astype(np.float32)
    return centres


def topic_of(text: Column, centres: np.ndarray) -> Column:
    """struct<topic: int, n_tokens: bigint>."""

    @F.arrow_udf("struct<topic: int, n_tokens: bigint>")
    def assign(texts: pa.Array) -> pa.Array:
        from patchlens.llm import mixing
        from patchlens.llm.workers import tool as kept

        tool = kept(("mixing",), mixing.Bags)
        found = [tool.bag(t) for t in (x.as_py() for x in texts)]
        v = np.array([x for _, x in found], dtype=np.float32).reshape(-1, centres.shape[1])
        return pa.StructArray.from_arrays([pa.array(np.argmax(v @ centres.T, axis=1), pa.int32()), pa.array([n for n, _ in found], pa.int64())], ["topic", "n_tokens"])

    # Else a filter on what is made of the topic would be moved below it and tell the topics a second time, in a second worker of each task.
    return assign.asNondeterministic()(F.coalesce(text.cast("string"), F.lit("")))


# --- weights ------------------------------------------------------------------------------


def together(cells: DataFrame) -> DataFrame:
    """A table of few cells in one task, where sums over any column need no shuffle; a larger one as it is."""
    return cells.coalesce(1) if cells.count() <= BROADCAST_CELLS else cells


def rake(cells: DataFrame, targets: dict[str, dict | None], tokens: str = "tokens") -> DataFrame:
    """cells and `weight`: tokens scaled until every dimension has its target shares.

    targets: per column a share for each value, or None for the flattened shares of the cells.
    """
    now = cells
    for name, given in targets.items():
        own = F.sum(tokens).over(Window.partitionBy(name))
        if given is None:
            now = now.withColumn(f"_want_{name}", F.pow(own.cast("double"), FLATTEN))
        else:
            spark = cells.sparkSession
            listed = spark.createDataFrame([(k, float(x)) for k, x in given.items()], f"_value {cells.schema[name].dataType.simpleString()}, _share double")
            now = now.join(listed, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value").withColumn(f"_want_{name}", F.coalesce("_share", F.lit(0.0))).drop("_share")
    now = together(materialize(now.withColumn("weight", F.col(tokens).cast("double")), "cells"))
    total = now.agg(F.sum(tokens)).first()[0] or 0
    for name in targets:  # shares of the values that have tokens, as tokens
        rows = now.groupBy(name).agg(F.first(f"_want_{name}").alias("w"), F.sum(tokens).alias("t")).where("t > 0").agg(F.sum("w")).first()[0] or 1.0
        now = now.withColumn(f"_want_{name}", F.col(f"_want_{name}") * total / rows)
    for _ in range(CYCLES // 4):
        for _ in range(4):
            for name in targets:
                own = F.sum("weight").over(Window.partitionBy(name))
                now = now.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"_want_{name}") / own).otherwise(0.0))
        now = together(materialize(now, "cells"))
        worst = 0.0
        for name in targets:
            gap = now.groupBy(name).agg(F.abs(F.sum("weight") - F.first(f"_want_{name}")).alias("gap"), F.sum(tokens).alias("t")).where("t > 0")
            worst = max(worst, gap.agg(F.max("gap")).first()[0] or 0.0)
        if worst <= TOLERANCE * max(total, 1):
            break
    return now.drop(*(f"_want_{n}" for n in targets))


def calibrated(cells: DataFrame, share: float, tokens: str = "tokens") -> DataFrame:
    """cells and `probability`: in proportion to weight over tokens, at most 1, with `share` of all tokens expected.

    Where the gains are so uneven that not even probabilities of 1 reach the share, all cells with weight have 1.
    """
    gain = F.when(F.col(tokens) > 0, F.col("weight") / F.col(tokens)).otherwise(F.lit(None))
    rows = cells.withColumn("_gain", gain)
    facts = rows.agg(F.sum(tokens).alias("total"), F.max("_gain").alias("most"), F.min(F.when(F.col("_gain") > 0, F.col("_gain"))).alias("least")).first()
    low, high = 0.0, 1.0 / facts.least if facts.least else 1.0
    for _ in range(5):  # 32 sections each time: to one part in 2**25
        grid = [low + (high - low) * i / 32 for i in range(33)]
        kept = rows.agg(*(F.sum(F.least(F.lit(1.0), F.coalesce("_gain", F.lit(0.0)) * s) * F.col(tokens)).alias(f"k{i}") for i, s in enumerate(grid))).first()
        reached = [i for i in range(33) if (kept[i] or 0.0) <= share * (facts.total or 0)]
        at = reached[-1] if reached else 0
        low, high = grid[at], grid[min(at + 1, 32)]
    return rows.withColumn("probability", F.when(F.col("_gain").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("_gain") * low))).drop("_gain")


def chance(own: Column, text: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone, on the text where there is none."""
    h = F.when(own.isNotNull(), F.xxhash64(own, F.lit("mix"))).otherwise(F.xxhash64(text, F.lit("mix")))
    return F.shiftrightunsigned(h, 11) / float(1 << 53)


def nearest_topic(bag: Column, centres: np.ndarray) -> Column:
    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(np.argmax(v.flatten().to_numpy().reshape(-1, centres.shape[1]) @ centres.T, axis=1), pa.int32())

    return nearest(bag)


def fitted(docs: DataFrame, share: float, targets: dict[str, dict | None] | None, own: str, text: str) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(bags of the documents, topic centres, cells with weight and probability)."""
    made = materialize(bags(docs, own, text), "bags")
    centres = centres_of(made)
    cells = made.select("source", "lang", nearest_topic(F.col("bag"), centres).alias("topic"), "n_tokens")
    cells = cells.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    return made, centres, materialize(calibrated(rake(cells, targets or {"source": None, "lang": None, "topic": None}), share), "cells")


def with_probability(rows: DataFrame, cells: DataFrame, own: str) -> DataFrame:
    """rows of source, lang and topic with the weight of a token and the probability of a document of their cell."""
    # Null-safe keys as one value, so that the join is an equality of hashes.
    key = lambda: F.to_json(F.struct(F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l"), F.col("topic").alias("t")))
    small = cells.select(key().alias("_cell"), (F.col("weight") / F.greatest(F.col("tokens"), F.lit(1))).alias("weight"), "probability")
    rows = rows.withColumn("_cell", key())
    if small.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(small), "_cell", "left")
    else:
        joined = joins.spread_join(rows, small, ["_cell"], [own], "left")
    return joined.drop("_cell")


def weigh(docs: DataFrame, share: float = 0.5, targets: dict[str, dict | None] | None = None, own: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, source, lang, topic, n_tokens, weight, probability, kept) of every document; texts are read once."""
    made, centres, cells = fitted(docs, share, targets, own, text)
    rows = made.select("own", "chance", "source", "lang", nearest_topic(F.col("bag"), centres).alias("topic"), "n_tokens")
    found = with_probability(rows, cells, "own")
    return found.select(F.col("own").alias(own), "source", "lang", "topic", "n_tokens", "weight", "probability", (F.col("chance") < F.col("probability")).alias("kept"))


def mix(docs: DataFrame, share: float = 0.5, targets: dict[str, dict | None] | None = None, own: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and topic, n_tokens, weight, probability and kept; topics are told again from the texts, so that these need no shuffle."""
    _, centres, cells = fitted(docs, share, targets, own, text)
    found = docs.withColumn("_found", topic_of(F.col(text), centres))
    rows = found.withColumn("topic", F.col("_found.topic")).withColumn("n_tokens", F.col("_found.n_tokens")).drop("_found", "weight", "probability", "kept")
    return with_probability(rows, cells, own).withColumn("kept", chance(F.col(own), F.col(text)) < F.col("probability"))
