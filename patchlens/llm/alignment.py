"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizations of a text cover the same bytes. A byte offset at which a token of either
ends is a shared cut; between neighbouring shared cuts lies a group of tokens that cover each
other. An interval is divided at a shared cut near its middle: the walk starts from the
middle token of the side with fewer tokens, and each end it meets is looked up among the
ends of the other side by bisection. Both halves are divided again; an interval without a
shared cut inside is a group.

Both vocabularies always cut before a single blank between other characters, so texts are
divided there first, before they are encoded; what lies between two such blanks is solved
once and remembered by the worker.

Every token of one side in a group is linked to every token of the other. How many documents
link a pair of ids is counted over the corpus; a link is a best one if no other partner of
its first id is linked in more documents. The counts of the most common pairs, at most
`COMMON`, are sent to all tasks; those of all other pairs are joined by their key.

Defined cases: a null or empty text has no tokens, nor has one whose tokens' bytes differ
from the blank and the text (say, as it holds U+2581); a pair counts once for each row that
links it, also of rows that are equal or share an id; columns other than id and text are
dropped; an empty table gives an empty one.
"""

from array import array
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.session import materialize

REMEMBERED = 200_000  # pieces of text whose solutions a worker keeps
COMMON = 1 << 20  # pairs whose counts are sent to all tasks
BATCH_CHARS = 1 << 20  # characters that are encoded and put out together
LONGEST, FEW_LINKS = 64, 256  # characters of a remembered piece; links of a piece that are kept one by one
BLANK = r" (?<=\S )(?=\S)"


def shared_cut(ends: list[int], others: list[int], start: int, end: int, low: int, high: int) -> tuple[int, int] | None:
    """Positions behind a shared cut among tokens start .. end - 1 and low .. high - 1 of the other side, the nearest to the middle of the first."""
    high -= 1  # the interval's own end is no cut inside it
    middle = (start + end - 2) // 2
    j = bisect_left(others, ends[middle], low, high)
    if j < high and others[j] == ends[middle]:
        return middle + 1, j + 1
    for step in range(1, end - start):
        for i in (middle - step, middle + step):
            if start <= i <= end - 2:
                j = bisect_left(others, ends[i], low, high)
                if j < high and others[j] == ends[i]:
                    return i + 1, j + 1
    return None


def groups_of(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups in order, as token ranges (first a, last a + 1, first b, last b + 1)."""
    found, open_ = [], [(0, len(ends_a), 0, len(ends_b))]
    while open_:
        whole = a0, a1, b0, b1 = open_.pop()
        n_a, n_b, cut = a1 - a0, b1 - b0, None
        if 1 < n_a <= n_b:
            cut = shared_cut(ends_a, ends_b, a0, a1, b0, b1)
        elif 1 < n_b < n_a and (turned := shared_cut(ends_b, ends_a, b0, b1, a0, a1)):
            cut = turned[1], turned[0]
        if cut:
            open_.append((cut[0], a1, cut[1], b1))
            open_.append((a0, cut[0], b0, cut[1]))
        else:
            found.append(whole)
    return found


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in entries of a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: Solution of a text: tokens of a and b, groups, links, the groups as text, the linked pairs
#: (each as often as it is linked, or once with its number beside it), byte ends of the groups.
Solved = tuple[int, int, int, int, str, bytes, bytes, bytes]
NOTHING: Solved = (0, 0, 0, 0, "", b"", b"", b"")


class Aligner:
    """Alignments by one pair of vocabularies. Pieces of up to LONGEST characters are remembered."""

    def __init__(self, path_a: str, path_b: str, ends: bool = False):
        import os
        import re

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a, self.b, self.ends = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), ends
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for t, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.width = len(names)
        self.digits = list(map(str, range(max(len(self.bytes_a), self.width))))
        # A piece that holds a blank behind other characters would reach over the cut.
        self.divide = re.compile(BLANK if not any("▁" in p.lstrip("▁") for p in names) else r"(?!)").split
        self.known: dict[str, Solved | None] = {}
        self.older: dict[str, Solved | None] = {}

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        first = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(first, self.b.encode(texts, num_threads=1))]

    def solve(self, text: str, a: list[int], b: list[int]) -> Solved | None:
        """The alignment of a blank and the text; None if the tokens' bytes are others."""
        parts_a, parts_b = list(map(self.bytes_a.__getitem__, a)), list(map(self.bytes_b.__getitem__, b))
        raw = b" " + text.encode()
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        found, digits, width = groups_of(ends_a, ends_b), self.digits, self.width
        names, links, n_links = [], [], 0
        for a0, a1, b0, b1 in found:
            n_a, n_b = a1 - a0, b1 - b0
            n_links += n_a * n_b
            if n_a == 1 == n_b:
                x, y = a[a0], b[b0]
                names.append(f"{digits[x]}|{digits[y]}")
                links.append(x * width + y)
                continue
            names.append(f"{','.join(map(digits.__getitem__, a[a0:a1]))}|{','.join(map(digits.__getitem__, b[b0:b1]))}")
            if n_links <= FEW_LINKS:
                links += [x * width + y for x in a[a0:a1] for y in b[b0:b1]]
        times = b""
        if n_links > FEW_LINKS:
            counted: Counter = Counter()
            for a0, a1, b0, b1 in found:
                right = Counter(b[b0:b1])
                for x, n in Counter(a[a0:a1]).items():
                    for y, m in right.items():
                        counted[x * width + y] += n * m
            links, times = list(counted), np.array(list(counted.values()), np.int64).tobytes()
        ends = np.array([ends_a[a1 - 1] for _, a1, _, _ in found], np.int64).tobytes() if self.ends else b""
        return len(a), len(b), len(found), n_links, ";".join(names), array("q", links).tobytes(), times, ends

    def documents(self, texts: list[str]) -> list[tuple]:
        """(tokens of a and b, groups, links, the groups as text, distinct links, how often each occurs, byte ends) of each text."""
        divided = [self.divide(t) if t else [] for t in texts]
        need = set().union(*divided) - self.known.keys()
        self.known.update({p: self.older[p] for p in need & self.older.keys()})
        fresh = list(need - self.known.keys())
        long_ones = {}
        for p, (a, b) in zip(fresh, self.encoded(fresh)):
            (self.known if len(p) <= LONGEST else long_ones)[p] = self.solve(p, a, b)
        out = [self.joined(t, parts, [self.known[p] if len(p) <= LONGEST else long_ones[p] for p in parts]) for t, parts in zip(texts, divided)]
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        return out

    def joined(self, text: str, parts: list[str], pieces: list[Solved | None]) -> tuple:
        if None in pieces:
            pieces, parts = [self.solve(text, *self.encoded([text])[0]) or NOTHING], [text]
        n_a, n_b, groups, links, names, codes, times, ends = zip(*pieces) if pieces else zip(NOTHING)
        codes_of_all = np.frombuffer(b"".join(codes), np.int64)
        if any(times):
            weights = np.concatenate([np.frombuffer(t, np.int64) if t else np.ones(len(c) // 8, np.int64) for c, t in zip(codes, times)])
            distinct, where = np.unique(codes_of_all, return_inverse=True)
            counted = np.zeros(len(distinct), np.int64)
            np.add.at(counted, where, weights)
        else:
            distinct, counted = np.unique(codes_of_all, return_counts=True)
        cuts = np.array([], np.int64)
        if self.ends and pieces:
            starts = list(accumulate([0, *(len(x.encode()) + 1 for x in parts[:-1])]))
            cuts = np.concatenate([np.frombuffer(e, np.int64) + s for e, s in zip(ends, starts)])
        return sum(n_a), sum(n_b), sum(groups), sum(links), ";".join(names), distinct, counted, cuts


def align(docs: DataFrame, path_a: str, path_b: str, own: str = "doc_id", text: str = "text", ends: bool = False) -> DataFrame:
    """(own, n_a, n_b, n_groups, n_links, groups, codes, times, ends) of every document.

    `groups` reads a1,a2|b1;a3|b2,b3: decimal ids of either side of each group in order.
    `codes` are the distinct linked pairs, a * (size of vocabulary b) + b, and `times` how
    often each is linked. `ends` are the byte offsets, in the blank and the text, at which
    the groups end, if asked for.
    """
    fields = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]
    lists = ["codes", "times", "ends"]

    def solve(batches):
        from patchlens.llm import alignment
        from patchlens.llm.workers import tool as kept

        tool = kept(("alignment", path_a, path_b, ends), lambda: alignment.Aligner(path_a, path_b, ends))

        def batch_of(owns, rows):
            columns = [pa.concat_arrays(owns), *(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields))]
            for i in (5, 6, 7):
                starts = pa.array(np.cumsum([0, *(len(r[i]) for r in rows)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(starts, pa.array(np.concatenate([r[i] for r in rows]), pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=[own, *(n for n, _ in fields), *lists])

        for batch in batches:
            at, texts, size = 0, [], 0
            for n, x in enumerate(batch.column(1)):
                texts.append(x.as_py())
                size += len(texts[-1])
                if size > alignment.BATCH_CHARS or n + 1 == len(batch):
                    yield batch_of([batch.column(0).slice(at, len(texts))], tool.documents(texts))
                    at, texts, size = n + 1, [], 0

    kind = docs.select(own).schema[0].dataType.simpleString()
    schema = f"`{own}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, codes array<bigint>, times array<bigint>, ends array<bigint>"
    return docs.select(own, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInArrow(solve, schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(code, n, best): documents that link the pair, and whether no partner of its first id has more."""
    counts = materialize(aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "pair-counts")
    first = F.expr(f"code div {width}")
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    return counts.withColumn("a", first).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def common_pairs(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the highest counts, at most `limit`, and all others. Whole powers of two of the count go to either side."""
    power = F.floor(F.log2("n")).cast("int")
    least = 64
    taken = 0
    for row in counts.groupBy(power.alias("p")).agg(F.count("*").alias("pairs")).orderBy(F.desc("p")).collect():
        taken += row.pairs
        if taken > limit:
            break
        least = row.p
    return counts.where(power >= least), counts.where(power < least)


def with_counts(aligned: DataFrame, counts: DataFrame, own: str = "doc_id", limit: int = COMMON) -> DataFrame:
    """aligned rows (a written table) without codes and times, with n_best and count_sum."""
    common, others = common_pairs(counts, limit)
    known = common.orderBy("code").toArrow()
    table = aligned.sparkSession.sparkContext.broadcast(
        (known.column("code").to_numpy(), known.column("n").to_numpy(), known.column("best").to_numpy(zero_copy_only=False).astype(np.int64))
    )

    def look_up(batches):
        code, n, best = table.value
        for batch in batches:
            sums, rest = [], []
            for codes, times in zip(batch.column("codes"), batch.column("times")):
                c, t = codes.values.to_numpy(), times.values.to_numpy()
                at = np.searchsorted(code, c)
                found = at < len(code)
                found[found] = code[at[found]] == c[found]
                hit = at[found]
                sums.append((int((t[found] * best[hit]).sum()), int((t[found] * n[hit]).sum())))
                rest.append([{"code": x, "times": y} for x, y in zip(c[~found].tolist(), t[~found].tolist())])
            kind = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()), pa.array(rest, kind)],
                names=["_row", "n_best", "count_sum", "rest"],
            )

    rows = aligned.select("_row", "codes", "times").mapInArrow(look_up, "_row bigint, n_best bigint, count_sum bigint, rest array<struct<code: bigint, times: bigint>>")
    parts = materialize(rows, "pair-sums")
    rare = (
        parts.select("_row", F.explode("rest").alias("r")).select("_row", "r.*").join(others, "code")
        .select("_row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    )
    both = parts.select("_row", "n_best", "count_sum").unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("codes", "times").join(both, "_row").drop("_row")


def correspondences(docs: DataFrame, path_a: str, path_b: str, own: str = "doc_id", text: str = "text", limit: int = COMMON) -> DataFrame:
    """(own, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every document."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    solved = align(docs, path_a, path_b, own, text).select(own, "n_a", "n_b", "n_groups", "n_links", digest, "codes", "times")
    # Written once: the row numbers stay what they are when a task is repeated.
    aligned = materialize(solved.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    return with_counts(aligned, materialize(pair_counts(aligned, width), "pairs"), own, limit)
