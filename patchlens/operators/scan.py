"""Keyword search without an index: one pass over the elements scores each of them for all queries of its framework.

The score is that of `search`. The distinct terms of some thousand elements meet the asked words,
the matches of each element's terms are summed by word, and one product of matrices makes scores
of queries out of these sums. Nothing but the elements is read, no posting is written, and each
task gives the `limit` best labels of each query.

That holds for queries that fit into a worker, `Asking.of` tells; others need the index.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions.text import exploded_counts, query_words, text
from patchlens.operators.index import element_terms
from patchlens.operators.joins import dealt
from patchlens.session import materialize

# What the queries of a job may come to, else they are searched for in an index.
FRAMEWORKS = 256
QUERIES = 4096  # of a framework
CELLS = 1 << 21  # of a framework: distinct words times queries; all frameworks together may have 16 times as many
CHARS = 1 << 18  # of the distinct words of a framework

NUMBERS = 1 << 22  # that are held at once
TERMS = 1 << 20  # words of texts that are matched at once
BYTES = 1 << 20  # of distinct terms that are looked into at once
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # of a multiplicative hash


@dataclass(frozen=True)
class Asking:
    """The queries of a scan: by framework the distinct words and, for each, the numbers of the queries that have it, and how often."""

    queries: DataFrame  # query_no, query_id, framework
    words: dict[str, tuple[list[bytes], list[tuple[int, int, int]]]]  # framework -> words, (place of the word, place of the query, times)
    numbers: dict[str, list[int]]  # framework -> query_no by place

    @staticmethod
    def of(elements: DataFrame, queries: DataFrame) -> Asking | None:
        """None if the queries are too many or too long for a worker, or if an element_id of a framework is there twice."""
        c = F.col
        named = queries.where("framework IS NOT NULL").select(F.monotonically_increasing_id().alias("query_no"), "query_id", "framework", "query")
        stored = materialize(named, "scan-queries")
        rows = stored.select("query_no", "framework", F.sort_array(query_words("query")).alias("words"))
        counted = materialize(exploded_counts(rows, "words", ["query_no", "framework"]).drop("is_first"), "scan-words")
        by_word = counted.groupBy("framework", "word").agg(F.count("*").alias("n"))
        sizes = by_word.groupBy("framework").agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + 1).alias("chars"))
        sizes = sizes.join(counted.groupBy("framework").agg(F.count_distinct("query_no").alias("queries")), "framework")
        found = sizes.select("framework", "queries", (c("words") * c("queries")).alias("cells"), "chars").limit(FRAMEWORKS + 1).collect()
        if len(found) > FRAMEWORKS or sum(r.cells for r in found) > 16 * CELLS or any(r.queries > QUERIES or r.cells > CELLS or r.chars > CHARS for r in found):
            return None
        twice = elements.where(c("framework").isin([r.framework for r in found]) & c("element_id").isNotNull()).groupBy("framework", "element_id").agg(F.count("*").alias("n")).where("n > 1")
        if not twice.isEmpty():
            return None
        words: dict[str, dict[bytes, int]] = {}
        places: dict[str, dict[int, int]] = {}
        cells: dict[str, list[tuple[int, int, int]]] = {}
        for r in counted.orderBy("framework", "query_no", "word").collect():
            known, asked = words.setdefault(r.framework, {}), places.setdefault(r.framework, {})
            cell = known.setdefault(r.word.encode(), len(known)), asked.setdefault(r.query_no, len(asked)), r.n
            cells.setdefault(r.framework, []).append(cell)
        return Asking(stored.drop("query"), {f: (list(words[f]), cells[f]) for f in words}, {f: list(asked) for f, asked in places.items()})


class Words:
    """The asked words of one framework, and which of them match a term."""

    def __init__(self, words: list[bytes]):
        self.words, self.place = words, {w: i for i, w in enumerate(words)}
        self.starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1].tolist()
        self.text = b"\n".join(words)
        # Parts of words, for terms inside of them: what is no part (of that length at most) is in no word.
        self.part = max(1, min(16, CHARS // len(self.text))) if self.text else 1
        self.parts = {w[at : at + n] for w in words for n in range(1, self.part + 1) for at in range(len(w) - n + 1)} | {b""}
        # Words of up to 8 bytes are numbers; longer ones are known by their first 8 bytes.
        self.exact = {n: self.keyed([i for i, w in enumerate(words) if len(w) == n]) for n in range(1, 9)}
        self.longer: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > 8:
                self.longer.setdefault(w[:8], []).append(i)
        self.heads = self.keyed([same[0] for same in self.longer.values()])

    def keyed(self, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64] | None:
        """Numbers of the words' first 8 bytes in order, the words' places, and a bitmap of hashes that most other numbers are not in."""
        if not places:
            return None
        keys = np.array([int.from_bytes(self.words[i][:8], "little") for i in places], np.uint64)
        order = np.argsort(keys)
        bits = min(22, max(10, len(places).bit_length() + 6))
        hashed = np.zeros(1 << bits, bool)
        hashed[(keys * FACTOR) >> np.uint64(64 - bits)] = True
        return keys[order], np.array(places, np.int64)[order], hashed, np.uint64(64 - bits)

    def inside(self, terms: list[bytes], first: int) -> list[np.ndarray]:
        """Numbers term * words + word of words inside the terms, which are numbered from `first`; some more than once."""
        w = len(self.words)
        lengths = np.array([len(t) for t in terms], np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8).astype(np.uint64)
        ends = np.cumsum(lengths)
        term = np.repeat(np.arange(first, first + len(terms)), lengths)
        rest = np.repeat(ends, lengths) - np.arange(len(data))
        found = [np.arange(first, first + len(terms)) * w + self.place[b""]] if b"" in self.place else []
        key = np.zeros(len(data), np.uint64)

        def hits(known, least: int) -> tuple[np.ndarray, np.ndarray]:
            keys, places, hashed, shift = known
            at = np.flatnonzero(hashed[(key * FACTOR) >> shift])
            at = at[rest[at] >= least]
            i = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            same = keys[i] == key[at]
            return at[same], places[i[same]]

        for n in range(1, min(8, len(data)) + 1):
            key[: len(data) - n + 1] |= data[n - 1 :] << np.uint64(8 * (n - 1))
            if self.exact[n]:
                at, place = hits(self.exact[n], n)
                found.append(term[at] * w + place)
        if self.heads and len(data) > 8:
            at, place = hits(self.heads, 9)
            more = []
            for p, i, t, left in zip(at.tolist(), place.tolist(), term[at].tolist(), rest[at].tolist()):
                whole = terms[t - first]
                p = len(whole) - left
                more += [t * w + j for j in self.longer[self.words[i][:8]] if whole.startswith(self.words[j], p)]
            found.append(np.array(more, np.int64))
        return found

    def around(self, term: bytes) -> list[int]:
        """Places of the words that hold the term."""
        if not term:
            return list(range(len(self.words)))
        found, at = [], self.text.find(term)
        while at >= 0:
            i = bisect.bisect_right(self.starts, at) - 1
            end = self.starts[i] + len(self.words[i])
            if at + len(term) <= end:
                found.append(i)
                at = self.text.find(term, end)  # the next word
            else:  # a term may hold what divides words
                at = self.text.find(term, at + 1)
        return found

    def matches(self, terms: list[bytes], exact: int, partial: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, word, points): the words that match each distinct term lie from from[term] to from[term + 1]."""
        w, found, equal, at = len(self.words), [], [], 0
        while at < len(terms):
            if len(terms[at]) > BYTES:
                found.append(np.array([at * w + i for i, word in enumerate(self.words) if word in terms[at]], np.int64))
                at += 1
                continue
            end, size = at, 0
            while end < len(terms) and size + len(terms[end]) <= BYTES:
                size += len(terms[end])
                end += 1
            found += self.inside(terms[at:end], at)
            at = end
        for i, term in enumerate(terms):
            if term[: self.part] in self.parts:
                found.append(np.array([i * w + j for j in self.around(term)], np.int64))
                if term in self.place:
                    equal.append(i * w + self.place[term])
        pairs = np.sort(np.concatenate([np.empty(0, np.int64), *found]))
        pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
        points = np.full(len(pairs), partial, np.float64)
        points[np.searchsorted(pairs, equal)] += exact
        return np.searchsorted(pairs, np.arange(len(terms) + 1) * w), pairs % w, points


class Points:
    """The scores of elements for the queries of one framework."""

    def __init__(self, words: list[bytes], cells: list[tuple[int, int, int]], exact: int, partial: int):
        self.words, self.exact, self.partial = Words(words), exact, partial
        self.width = max(q for _, q, _ in cells) + 1
        self.grid = np.zeros((len(words), self.width))  # whole numbers below 2^53, so sums are exact in any order
        for word, query, times in cells:
            self.grid[word, query] = times
        self.rows = max(1, NUMBERS // max(self.width, len(words)))

    def scores(self, terms: pa.ListArray) -> np.ndarray:
        """(element, query) of at most `rows` elements, given by the lists of their terms."""
        ends = terms.offsets.to_numpy().astype(np.int64)
        first, ends = ends[0], ends - ends[0]
        flat = terms.values.slice(first, ends[-1]).cast(pa.binary())
        width = len(self.words.words)
        by_word = np.zeros(len(terms) * width)
        row = np.repeat(np.arange(len(terms)), np.diff(ends))
        for at in range(0, len(flat), TERMS):
            coded = flat.slice(at, TERMS).dictionary_encode()
            start, word, points = self.words.matches(coded.dictionary.to_pylist(), self.exact, self.partial)
            codes = coded.indices.to_numpy()
            some = np.diff(start)[codes]  # words that each term of the texts matches
            until = np.cumsum(some)
            low = 0
            while low < len(codes):
                high = max(low + 1, int(np.searchsorted(until, until[low] - some[low] + NUMBERS, "right")))
                n = some[low:high]
                i = np.repeat(start[codes[low:high]] - (until[low:high] - n - (until[low] - some[low])), n) + np.arange(n.sum())
                cells = np.repeat(row[at + low : at + high] * width, n) + word[i]
                by_word += np.bincount(cells, points[i], len(by_word))
                low = high
        return (by_word.reshape(len(terms), width) @ self.grid).astype(np.int64)


class Leaders:
    """The best labels of each query of one framework, so far."""

    def __init__(self, width: int, limit: int):
        self.limit = limit
        self.best: list[dict[bytes, tuple[int, int]]] = [{} for _ in range(width)]  # label -> (score, -element_id)
        self.reach = np.ones(width, np.int64)  # the least score that may count

    def add(self, scores: np.ndarray, labels: pa.Array, ids: np.ndarray) -> None:
        place = np.empty(len(ids), np.int64)
        by_id = np.argsort(ids, kind="stable")
        place[by_id] = np.arange(len(ids))
        coded = labels.cast(pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        # Score and place in one number: the greater is better, and each label has one best.
        n = len(ids)
        keys = np.maximum.reduceat((scores * n + (n - 1 - place)[:, None])[order], starts, axis=0)
        if len(keys) > self.limit:
            kept = np.argpartition(keys, len(keys) - self.limit, axis=0)[len(keys) - self.limit :]
        else:
            kept = np.broadcast_to(np.arange(len(keys))[:, None], keys.shape)
        keys = np.take_along_axis(keys, kept, axis=0)
        names = coded.dictionary.to_pylist()
        codes = codes[order][starts]
        for i, query in zip(*np.nonzero(keys // n >= self.reach)):
            key = int(keys[i, query])
            self.put(int(query), names[codes[kept[i, query]]], key // n, int(ids[by_id[n - 1 - key % n]]))

    def put(self, query: int, label: bytes, score: int, element_id: int) -> None:
        best = self.best[query]
        best[label] = max(best.get(label, (score, -element_id)), (score, -element_id))
        if len(best) >= self.limit:
            if len(best) > self.limit:
                del best[min(best, key=best.get)]
            self.reach[query] = min(score for score, _ in best.values())


def best_labels(elements: DataFrame, asking: Asking, limit: int, exact: int, partial: int) -> DataFrame:
    """(query_id, framework, label, score, element_id): of each query the `limit` best labels of every task, their best elements whole."""
    c = F.col
    kind = dict(elements.dtypes)["element_id"]
    rows = elements.where(c("framework").isin(list(asking.words)) & c("element_id").isNotNull())
    # The texts are dealt before their words are cut, as a table may be one split.
    rows = dealt(rows.select("framework", c("element_id").cast("bigint").alias("element_id"), "name", "package", "type", "doc"), ["framework", "element_id"])
    rows = rows.select("framework", "element_id", F.concat(text("package"), F.lit("."), text("name")).alias("label"), element_terms(c("name"), c("package"), c("type"), c("doc")).alias("terms"))
    words, numbers = asking.words, asking.numbers
    schema = "query_no bigint, label string, score bigint, element_id bigint"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: dict[str, Points] = {}
        leaders: dict[str, Leaders] = {}
        for batch in batches:
            coded = batch.column("framework").dictionary_encode()
            for code, framework in enumerate(coded.dictionary.to_pylist()):
                if framework not in points:
                    points[framework] = Points(*words[framework], exact, partial)
                    leaders[framework] = Leaders(points[framework].width, limit)
                mine = batch.filter(pa.array(coded.indices.to_numpy() == code))
                for at in range(0, mine.num_rows, points[framework].rows):
                    part = mine.slice(at, points[framework].rows)
                    scores = points[framework].scores(part.column("terms"))
                    leaders[framework].add(scores, part.column("label"), part.column("element_id").to_numpy())
        for framework, found in leaders.items():
            out = [(numbers[framework][q], label, score, -neg_id) for q, best in enumerate(found.best) for label, (score, neg_id) in best.items()]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()).view(pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=["query_no", "label", "score", "element_id"],
                )

    found = rows.mapInArrow(score, schema).withColumn("element_id", c("element_id").cast(kind))
    return found.join(asking.queries, "query_no").select("query_id", "framework", "label", "score", "element_id")
