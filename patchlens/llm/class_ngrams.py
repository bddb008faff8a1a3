"""Brown class-based bigrams: words get classes by exchange, and classes predict each other.

    P(word | before) = P(class(word) | class(before)) * P(word | class(word))

Text is lower-cased in A-Z and cut at blanks; a text ends with a token of its own, which is
also what stands before its first word. Words of at least `SHARE` of all tokens (so 1/SHARE of
them at most, whatever the corpus) are clustered one by one; every rarer or unknown word
belongs to the type given by its last two bytes, its length and whether it has letters
beyond ASCII, and types are clustered like words. Counts of rare words are joined, not broadcast.

Exchange clustering is spread over shards of the vocabulary: each pass counts, for every word,
the classes before and after it in the whole corpus; each shard moves its words one at a time
to the class that raises the likelihood most, from the class counts of the pass before.

Every class keeps one place for an unseen word, so the model sums to one over known words and
one unknown word per class.

Defined cases: a null text counts as empty; an empty text is one end token; null ids are kept
and hashed as the text ""; rows that repeat an id or a text are scored each; without any
training row all counts are 0 and words are as unlikely as the formulas say; columns other
than id and text are dropped.
"""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.session import materialize

SHARE = 2.0**-20  # of all tokens, from which a word is clustered by itself
CLASSES = 48  # the first is that of the end token alone
PASSES = 5
SHARD = 8_192  # words and types that are moved one after another; shards do not see each other's moves of the same pass
SMOOTHING = 5.0  # pseudo-counts of the overall class distribution behind each class
HELD = 500_000  # words a task counts before it passes them on

END = b""  # no word is empty


def tokens(text: str) -> list[bytes]:
    """Words of a text; the end token is not listed."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def type_of(word: bytes) -> bytes:
    """The type of a rare word; at most 2**18 of them. It holds a blank, as no word does."""
    return word[-2:] + (b" L" if len(word) > 8 else b" S") + (b"+" if any(b > 127 for b in word) else b"-")


def held_out(own: Column, modulus: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")) % modulus == rest


# --- counts -------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """(word binary, c) over the texts of rows; the end token is the empty word."""

    def count(batches):
        from patchlens.llm import class_ngrams as cn

        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        seen: Counter = Counter()

        def made():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)
            seen.clear()
            return out

        for batch in batches:
            for t in (x.as_py() for x in batch.column("text")):
                seen.update(cn.tokens(t))
                seen[cn.END] += 1
                if len(seen) > cn.HELD:
                    yield made()
        if seen:
            yield made()

    return rows.select("text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Numbers of the clustered words and types: 0 the end, then words, then types, last any other type."""

    def __init__(self, words: list[bytes], types: list[bytes]):
        self.packed = zlib.compress(b"\n".join([*words, *types]), 1)
        self.n_words, self.n_types = len(words), len(types)

    @property
    def size(self) -> int:
        return 2 + self.n_words + self.n_types

    def names(self) -> list[bytes]:
        whole = zlib.decompress(self.packed)
        return whole.split(b"\n") if whole else []

    def numbers(self) -> dict[bytes, int]:
        return {name: i for i, name in enumerate(self.names(), 1)}


def vocabulary_of(counts: DataFrame, least: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the counts by number. At most 1/SHARE words and 2**18 types reach the driver."""
    frequent = counts.where((F.col("c") >= least) & (F.length("word") > 0)).select("word", "c").collect()
    frequent = sorted(((-r.c, bytes(r.word)) for r in frequent))

    def types(batches):
        from patchlens.llm import class_ngrams as cn

        seen: Counter = Counter()
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                seen[cn.type_of(word)] += c
        yield pa.RecordBatch.from_pydict({"type": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})

    rare = counts.where((F.col("c") < least) & (F.length("word") > 0)).mapInArrow(types, "type binary, c bigint")
    found = sorted((-r.c, bytes(r.type)) for r in rare.groupBy("type").agg(F.sum("c").alias("c")).collect())
    ends = counts.where(F.length("word") == 0).select("c").first()
    by_number = np.array([ends.c if ends else 0, *(-c for c, _ in frequent), *(-c for c, _ in found), 0], dtype=np.int64)
    return Vocabulary([w for _, w in frequent], [t for _, t in found]), by_number


def encoded(docs: DataFrame, vocabulary: Vocabulary, own: str, text: str, train: Column) -> DataFrame:
    """(uid, own, train, ids, rare, times): ids of all tokens and, per document, the rare words with how often they occur."""
    packed = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        from patchlens.llm import class_ngrams as cn

        voc = packed.value
        numbers, other = voc.numbers(), voc.size - 1

        class Ids(dict):
            """Words by number; for a rare word the number of its type."""

            def __missing__(self, word):
                found = numbers.get(word)
                if found is None:
                    found = -numbers.get(cn.type_of(word), other)
                if len(self) > 200_000:
                    self.clear()
                self[word] = found
                return found

        known = Ids()
        for batch in batches:
            ids, starts, rare, times, rare_starts = [], [0], [], [], [0]
            for t in (x.as_py() for x in batch.column("text")):
                words = cn.tokens(t)
                row = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
                few = Counter(words[i] for i in np.flatnonzero(row < 0).tolist())
                rare += few.keys()
                times += few.values()
                rare_starts.append(len(rare))
                ids += [np.abs(row), [0]]
                starts.append(starts[-1] + len(words) + 1)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.array([], np.int32)
            offsets = pa.array(rare_starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("own"), batch.column("train"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat)),
                    pa.ListArray.from_arrays(offsets, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ],
                names=["own", "train", "ids", "rare", "times"],
            )

    rows = docs.select(F.col(own).cast("bigint").alias("own"), train.alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = rows.mapInArrow(encode, "own bigint, train boolean, ids array<int>, rare array<binary>, times array<int>")
    return made.withColumn("uid", F.monotonically_increasing_id())


# --- exchange -----------------------------------------------------------------------------


def bigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens and of what stands before each; before the first is an end."""
    ids = batch.column("ids")
    now = ids.flatten().to_numpy()
    before = np.empty_like(now)
    before[1:] = now[:-1]  # every text ends with the end token, so the one before a text's first word is the end of another
    if len(before):
        before[0] = 0
    return before, now


def start_classes(names: list[bytes], size: int) -> np.ndarray:
    """Words and types by their last two letters; the end token alone in class 0."""
    last = [name.partition(b" ")[0][-2:] for name in names]
    found = np.zeros(size, dtype=np.int16)
    found[1 : 1 + len(names)] = [1 + zlib.crc32(x) % (CLASSES - 1) for x in last]
    found[-1] = CLASSES - 1
    return found


def exchange(order: np.ndarray, left: np.ndarray, right: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Move words one at a time to their best class.

    left, right: how often each class stands before and after the word. pairs: counts of
    class pairs, updated with every move. The likelihood of a class bigram model is, up to a
    constant, sum f(pairs) - sum f(row sums) - sum f(column sums) with f(x) = x log x.
    """

    def f(x):
        return x * np.log(np.maximum(x, 1e-12))

    pairs = pairs.astype(np.float64).copy()
    for i in order:
        l, r, c = left[i].astype(np.float64), right[i].astype(np.float64), classes[i]
        n_left, n_right = l.sum(), r.sum()
        if n_left + n_right == 0:
            continue
        pairs[:, c] -= l
        pairs[c, :] -= r
        np.maximum(pairs, 0, out=pairs)  # a word beside itself is counted on both sides
        rows, columns = pairs.sum(axis=1), pairs.sum(axis=0)
        gain = (f(pairs + l[:, None]) - f(pairs)).sum(axis=0) + (f(pairs + r[None, :]) - f(pairs)).sum(axis=1)
        gain -= f(rows + n_right) - f(rows) + f(columns + n_left) - f(columns)
        gain[0] = -np.inf  # the end's own class
        c = int(np.argmax(gain))
        classes[i] = c
        pairs[:, c] += l
        pairs[c, :] += r
    return classes


def class_pass(corpus: DataFrame, classes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass of exchange over the whole corpus: (new classes, counts of class pairs before it)."""
    context = corpus.sparkSession.sparkContext
    sent = context.broadcast(classes)
    size = len(classes)

    def neighbours(batches):
        cls = sent.value
        left = np.zeros(size * CLASSES, dtype=np.int32)
        right = np.zeros(size * CLASSES, dtype=np.int32)
        for batch in batches:
            before, now = bigrams(batch)
            left += np.bincount(now.astype(np.int64) * CLASSES + cls[before], minlength=len(left)).astype(np.int32)
            right += np.bincount(before.astype(np.int64) * CLASSES + cls[now], minlength=len(right)).astype(np.int32)
        left, right = left.reshape(size, CLASSES), right.reshape(size, CLASSES)
        blocks = [zlib.compress(np.stack([left[s::shards], right[s::shards]]).tobytes(), 1) for s in range(shards)]
        yield pa.RecordBatch.from_pydict({"shard": pa.array(range(shards), pa.int32()), "block": pa.array(blocks, pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()):
                part = np.frombuffer(zlib.decompress(block), np.int32).reshape(2, -1, CLASSES)
                total[s] = total[s] + part if s in total else part.astype(np.int64)
        cls = sent.value
        for s, (left, right) in total.items():
            pairs = np.zeros((CLASSES, CLASSES), dtype=np.int64)
            np.add.at(pairs.T, cls[s::shards], left)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s], pa.int32()), "pairs": [pairs.tobytes()], "sides": [zlib.compress(np.stack([left, right]).tobytes(), 1)],
            })

    summed = corpus.select("ids").mapInArrow(neighbours, "shard int, block binary").repartition(shards, "shard")
    summed = materialize(summed.mapInArrow(add, "shard int, pairs binary, sides binary"), "profiles")
    pairs = sum(np.frombuffer(r.pairs, np.int64).reshape(CLASSES, CLASSES) for r in summed.select("pairs").collect())
    if isinstance(pairs, int):  # no text at all
        return classes, np.zeros((CLASSES, CLASSES), dtype=np.int64)

    def move(batches):
        from patchlens.llm.class_ngrams import exchange

        for batch in batches:
            for s, sides in zip(batch.column("shard").to_pylist(), batch.column("sides").to_pylist()):
                left, right = np.frombuffer(zlib.decompress(sides), np.int64).reshape(2, -1, CLASSES)
                own = sent.value[s::shards].copy()
                order = np.arange(1 if s == 0 else 0, len(own))  # number 0 is the end; the rest is in order of counts
                moved = exchange(order, left, right, own, pairs)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "classes": [moved.astype(np.int16).tobytes()]})

    new = classes.copy()
    for r in summed.select("shard", "sides").repartition(shards, "shard").mapInArrow(move, "shard int, classes binary").collect():
        new[r.shard :: shards] = np.frombuffer(r.classes, np.int16)
    return new, pairs


def pair_counts(corpus: DataFrame, classes: np.ndarray) -> np.ndarray:
    sent = corpus.sparkSession.sparkContext.broadcast(classes)

    def count(batches):
        cls, total = sent.value.astype(np.int64), np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            before, now = bigrams(batch)
            total += np.bincount(cls[before] * CLASSES + cls[now], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for r in corpus.select("ids").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        found[r.pair] = r.n
    return found.reshape(CLASSES, CLASSES)


# --- model and scores ---------------------------------------------------------------------


def score(docs: DataFrame, train: Column, own: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, train, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from those of `train`."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), train.alias("train"))
    counts = materialize(word_counts(texts.where("train")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n), int(total.v)
    least = max(2, math.ceil(n * SHARE))
    vocabulary, by_number = vocabulary_of(counts, least)
    corpus = materialize(encoded(docs, vocabulary, own, text, train), "encoded")
    learning = corpus.where("train")

    classes = start_classes(vocabulary.names(), vocabulary.size)
    shards = -(-vocabulary.size // SHARD)
    for _ in range(PASSES):
        classes, _ = class_pass(learning, classes, shards)
    pairs = pair_counts(learning, classes).astype(np.float64)

    # Distinct words of each class: one for each clustered word, the listed rare words of each type.
    tokens_of = np.bincount(classes, weights=by_number, minlength=CLASSES)
    words_of = np.bincount(classes[1 : 1 + vocabulary.n_words], minlength=CLASSES).astype(np.float64)
    words_of[0] += by_number[0] > 0
    rare = counts.where((F.col("c") < least) & (F.length("word") > 0))
    words_of += rare_words_of(rare, vocabulary, classes)

    overall = (tokens_of + words_of + 1) / (n + v + CLASSES)
    transition = np.log10((pairs + SMOOTHING * overall) / (pairs.sum(axis=1, keepdims=True) + SMOOTHING))
    room = np.log10(tokens_of + words_of + 1)  # what an emission is divided by
    weight = np.log10(by_number + 1.0)
    weight[1 + vocabulary.n_words :] = 0.0  # counts of rare words are joined
    sent = spark.sparkContext.broadcast((classes, transition, room, weight, by_number[0] > 0, vocabulary.n_words))

    def local(batches):
        cls, trans, den, gain, ends_known, n_words = sent.value
        for batch in batches:
            before, now = bigrams(batch)
            starts = batch.column("ids").offsets.to_numpy() - (batch.column("ids").offsets[0].as_py() if len(batch.column("ids").offsets) else 0)
            part = trans[cls[before], cls[now]] - den[cls[now]]
            known = (now <= n_words) & ((now > 0) | ends_known)
            sums = [np.add.reduceat(x, starts[:-1]) if len(now) else np.array([]) for x in (part, gain[now], known.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"), batch.column("own"), batch.column("train"), pa.array(np.diff(starts), pa.int64()),
                    pa.array(sums[0], pa.float64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.int64()),
                ],
                names=["uid", "own", "train", "n_tokens", "model", "gain", "known"],
            )

    mine = corpus.select("uid", "own", "train", "ids").mapInArrow(
        local, "uid bigint, own bigint, train boolean, n_tokens bigint, model double, gain double, known bigint"
    )
    uses = corpus.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("use")).select("uid", F.col("use.rare").alias("word"), F.col("use.times").alias("times"))
    looked_up = (
        uses.join(rare, "word").groupBy("uid")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_gain"), F.sum("times").cast("bigint").alias("rare_known"))
    )
    both = mine.join(looked_up, "uid", "left")
    gain = F.col("gain") + F.coalesce("rare_gain", F.lit(0.0))
    return both.select(
        F.col("own").alias(own), "train", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (gain - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), (gain + F.col("model")).alias("score"),
    )


def rare_words_of(rare: DataFrame, vocabulary: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """How many distinct rare words each class has."""
    sent = rare.sparkSession.sparkContext.broadcast((vocabulary, classes))

    def count(batches):
        from patchlens.llm import class_ngrams as cn

        voc, cls = sent.value
        numbers, total = voc.numbers(), Counter()
        for batch in batches:
            total.update(int(cls[numbers.get(cn.type_of(w), voc.size - 1)]) for w in batch.column("word").to_pylist())
        yield pa.RecordBatch.from_pydict({"class": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    found = np.zeros(CLASSES)
    for r in rare.select("word").mapInArrow(count, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        found[r["class"]] = r.n
    return found
