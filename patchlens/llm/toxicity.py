"""Toxic passages as maximum-scoring segments of a text.

Every token has a weight: the log-odds of its use in toxic against clean documents, smoothed
by a Dirichlet prior that follows its overall use; tokens without significant log-odds cost
`GAP`. All maximal segments of positive score are found in one scan. The significance of a
segment among as many tokens is read from the extreme-value law of such scores, and a
logistic curve turns a document's significances into a probability.

Words outside the lexicon fall back on their first nine to four letters, so inflected and
compounded forms of a stem are known too.

The lexicon and the curve are fitted on at most `SAMPLE` labelled rows (of which one row for
each family of near copies counts); everything else covers all rows.

Defined cases: a null text counts as empty; empty texts get the score of a text without
segments; a null id counts as the text "" when rows are held out, and has no label; an id
labelled twice is toxic if either label is; without any toxic or any clean label all scores
are 0; equal rows get equal scores; columns other than id and text are dropped.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled rows to fit on
MOST_WORDS = 20_000  # entries of the lexicon, those of the highest z
PRIOR = 2.0  # pseudo-counts of a feature, split as all counts are
LEAST_Z, LEAST_ODDS, MOST_ODDS = 3.5, 2.0, 8.0
GAP = -0.25  # of a token without log-odds
STEMS = (9, 8, 7, 6, 5, 4)  # letters of the stems, longest first
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word and its stems; a stem is marked so that it is not taken for a word."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def held_out(own: Column, modulus: int = 3, rest: int = 1) -> Column:
    return F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, left to right, in linear time.

    Candidates stand on a stack with the running total before and after each. A new positive
    item swallows candidates back to the last one that starts from a lower total, as long as
    joining gains; each candidate is pushed and swallowed once.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, candidate below with a lower start
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        start, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, i + 1, low, total, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - low) for a, b, low, after, _ in stack]


class Scanner:
    """Segments of texts for one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        class Weights(dict):
            def __missing__(self, word):
                found = next((lexicon[f] for f in features(word) if f in lexicon), 0.0)
                if len(self) > 300_000:
                    self.clear()
                self[word] = found
                return found

        self.weights = Weights()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(tokens, segments as character spans with their scores)."""
        lowered = text.lower()
        found = list(map(self.weights.__getitem__, WORD.findall(lowered)))
        at = [i for i, w in enumerate(found) if w]
        if not at:
            return len(found), []
        # A run of tokens without weight is one item of its total cost; no maximal segment ends inside it.
        items, where = [], []
        for k, i in enumerate(at):
            if k and i - at[k - 1] > 1:
                items.append(GAP * (i - at[k - 1] - 1))
                where.append(-1)
            items.append(found[i])
            where.append(i)
        whole = text if len(lowered) == len(text) else lowered
        spans = [m.span() for m in WORD.finditer(whole.lower())]
        return len(found), [(spans[where[a]][0], spans[where[b - 1]][1], s) for a, b, s in segments(items)]


def significances(n_tokens: int, found: list, decay: float, scale: float) -> list[float]:
    """-log of the expected number of segments of at least that score in a clean text of n tokens."""
    return [decay * s - math.log(scale * max(n_tokens, 1)) for _, _, s in found]


def summary(n_tokens: int, found: list, decay: float, scale: float) -> tuple[float, float]:
    bits = [max(0.0, b) for b in significances(n_tokens, found, decay, scale)]
    return max(bits, default=0.0), math.log1p(sum(bits))


# --- fitting ------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, own: str, text: str, keep: Column) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled documents, one for each family of near copies.

    Which rows are taken depends on a hash of their ids. The ids, at most SAMPLE, are
    broadcast, so the texts of all other documents are not shuffled.
    """
    marked = (
        labels.select(F.col(own).alias("own"), F.col("toxic").cast("int").alias("toxic")).where(keep & F.col("own").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("own").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("own"), "own").limit(SAMPLE)
    )
    rows = docs.select(F.col(own).alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(marked), "own")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("words", i, 5), " ")))
    families = rows.withColumn("words", words).withColumn("family", F.array_min(windows))
    return families.groupBy("family", "toxic").agg(F.min_by("text", F.struct("own", "text")).alias("text")).select("text", "toxic")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, clean, toxic): documents of either kind that have the feature."""

    def count(batches):
        from collections import Counter

        from patchlens.llm.toxicity import WORD, features

        schema = pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
        both = (Counter(), Counter())

        def rows():
            names = list(both[0].keys() | both[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in both)], schema=schema)
            both[0].clear()
            both[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                both[min(max(toxic, 0), 1)].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
                if len(both[0]) + len(both[1]) > 200_000:
                    yield rows()
        yield rows()

    partial = sample.mapInArrow(count, "feature string, clean bigint, toxic bigint")
    return partial.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def lexicon_of(counts: DataFrame, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Weights of the features whose log-odds are significant: at most MOST_WORDS of them."""
    share = n_toxic / (n_clean + n_toxic)
    y1, y0 = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * (1 - share)
    odds = F.log(y1 / y0) - math.log(n_toxic / n_clean)
    scored = counts.select("feature", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    best = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "feature").limit(MOST_WORDS)
    return {r.feature: min(MOST_ODDS, r.odds) for r in best.collect()}


def scanned(sample: DataFrame, lexicon: dict[str, float]) -> list:
    """(toxic, tokens, scores of the segments) of every sampled row: at most SAMPLE rows."""

    def scan(batches):
        from patchlens.llm.toxicity import Scanner

        tool = Scanner(lexicon)
        for batch in batches:
            found = [tool.scan(t) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"), "tokens": pa.array([n for n, _ in found], pa.int64()),
                "scores": pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64())),
            })

    return sample.mapInArrow(scan, "toxic int, tokens bigint, scores array<double>").collect()


def extreme_value_law(rows: list) -> tuple[float, float]:
    """(decay, scale) of the expected number of segments in clean text, scale * tokens * exp(-decay * score).

    No segment scores less than LEAST_ODDS, and what clean segments score beyond that decays
    exponentially: its mean gives the rate, their number the scale. One segment, of an excess
    of one, is added to what was seen. A rate of 100 counts for steeper ones, so that numbers stay finite.
    """
    clean = [s for r in rows if r.toxic <= 0 for s in r.scores]
    tokens = sum(r.tokens for r in rows if r.toxic <= 0)
    decay = min(100.0, (len(clean) + 1) / (sum(s - LEAST_ODDS for s in clean) + 1))
    scale = (len(clean) + 1) * math.exp(decay * LEAST_ODDS) / max(tokens, 1)
    return decay, scale


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights (constant first) by Newton's method with a ridge on all but the constant."""
    design = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(design.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + penalty @ beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def fit(docs: DataFrame, labels: DataFrame, keep: Column, own: str = "doc_id", text: str = "text") -> dict:
    """The model: {"lexicon", "decay", "scale", "curve"}. keep: which labels, as a condition on `own`."""
    from patchlens.session import materialize

    sample = materialize(labelled_sample(docs, labels, own, text, keep), "toxic-sample")
    sizes = {bool(r.toxic > 0): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {"lexicon": {}, "decay": 1.0, "scale": 1.0, "curve": None}
    lexicon = lexicon_of(feature_counts(sample), sizes[False], sizes[True])
    rows = scanned(sample, lexicon)
    decay, scale = extreme_value_law(rows)
    x = np.array([summary(r.tokens, [(0, 0, s) for s in r.scores], decay, scale) for r in rows])
    curve = logistic_curve(x, np.array([float(r.toxic > 0) for r in rows]))
    return {"lexicon": lexicon, "decay": decay, "scale": scale, "curve": curve}


def passages(text: Column, model: dict) -> Column:
    """struct<score, passages>: passages are the segments with character span, score and significance."""

    @F.arrow_udf("struct<score: double, passages: array<struct<start: int, end: int, score: double, significance: double>>>")
    def scan(texts: pa.Array) -> pa.Array:
        from patchlens.llm import toxicity
        from patchlens.llm.workers import tool as kept

        lexicon, curve = model["lexicon"], model["curve"]
        tool = kept(("toxicity", hash(frozenset(lexicon.items()))), lambda: toxicity.Scanner(lexicon))
        scores, passages = [], []
        for t in (x.as_py() for x in texts):
            n, found = tool.scan(t)
            bits = toxicity.significances(n, found, model["decay"], model["scale"])
            x = toxicity.summary(n, found, model["decay"], model["scale"])
            z = curve[0] + curve[1] * x[0] + curve[2] * x[1] if curve else -math.inf
            scores.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
            passages.append([{"start": a, "end": b, "score": s, "significance": e} for (a, b, s), e in zip(found, bits)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("significance", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, kind)], ["score", "passages"])

    return scan(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: dict, own: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, score, passages) of every document."""
    return docs.select(F.col(own), passages(F.col(text), model).alias("_found")).select(own, "_found.score", "_found.passages")
