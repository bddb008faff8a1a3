"""Token counts of every prefix of a text, by dynamic programming over prefixes.

For each prefix of a word exactly one token can end its encoding; the table of those last
tokens is filled left to right, and the count of a prefix is one more than that of the
prefix its last token starts from. Stored are the differences from each prefix to the next,
one signed byte per character, so a running sum answers "how many tokens has this prefix"
and "how much of the text fits" without encoding again.

Prefixes are those of the normalised text (composed, lower case; for nearly all texts the
same number of characters as the text itself).

Defined cases: a null text counts as empty; empty and blank texts have no tokens; equal rows
give equal results; other columns, whatever their names, are kept.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE = 300_000  # words whose prefixes a worker remembers
HEAD = 5  # bytes whose part of the table words share
START = -1

# How the vocabulary's own library cuts a text into words.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)\Z")


class PrefixCounter:
    """Differences of token counts along a text, for one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers

        from patchlens.llm.merges import Recent, WordMerges, common_pattern

        self.merges = WordMerges(path)
        assert self.merges.longest < 127, "a difference of counts is stored in one signed byte"
        library = Tokenizer.from_file(path)
        self.normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cut = library.pre_tokenizer
        self.cut_prefix = regex.compile(PIECES).findall
        self.pieces, self.rare = common_pattern(r"\s+|" + PIECES)
        self.special = re.compile("|".join(map(re.escape, self.merges.special)) or r"(?!)")
        self.heads: dict[bytes, tuple[list, list, list]] = {}  # tables of the first HEAD bytes of words
        self.words = Recent(self.differences, CACHE)
        self.known = Recent(self.stretch, CACHE // 2)  # differences by stretch between single blanks

    def totals(self, word: str) -> list[int]:
        """Tokens of the first 1, 2, ... characters of one word."""
        raw, m = word.encode(), self.merges
        n, step = len(raw), m.endings.at.get
        inner, final, seen, together = m.endings.first, m.endings.second, m.seen.get, m.together
        head = raw[:HEAD]
        # last, count: of the encodings that go on behind a prefix; ended: tokens of the prefix as a whole word.
        last, count, ended = map(list.copy, self.heads.get(head, ([START], [0], [0])))
        for i in range(len(last), n + 1):
            node, j, candidates = 0, i, []
            while j:
                node = step(node << 8 | raw[j - 1])
                if node is None:
                    break
                j -= 1
                t, f = inner[node], final[node]
                if t is not None or f is not None:
                    candidates.append((j, t, f))
            go_on = whole = None
            for j, t, f in reversed(candidates):
                before = last[j]
                if t is not None and go_on is None:
                    fits = seen(before << 20 | t) if j else True
                    if together(before, t) if fits is None else fits:
                        go_on, tokens = t, count[j] + 1
                if f is not None and whole is None:
                    fits = seen(before << 20 | f) if j else True
                    if together(before, f) if fits is None else fits:
                        whole = count[j] + 1
            last.append(go_on)
            count.append(tokens)
            ended.append(whole)
            if i == HEAD:
                if len(self.heads) >= CACHE // 2:
                    self.heads.clear()
                self.heads[head] = (last.copy(), count.copy(), ended.copy())
        if len(word) == n:
            return ended[1:]
        return [ended[i] for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80]

    def stretch(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def differences(self, piece: str) -> bytes:
        """The differences along one piece, the first against no tokens at all."""
        if piece.strip(" \t\n\r\x0b\x0c\x85\xa0") == "":  # blanks of the common characters; others never come here
            return bytes(len(piece))
        if CONTRACTION.match(piece):  # its prefixes are cut differently
            totals = [sum(self.totals(w)[-1] for w in self.cut_prefix(piece[:k])) for k in range(1, len(piece))]
            totals.append(self.totals(piece)[-1])
        else:
            totals = self.totals(piece)
        return bytes((b - a) & 0xFF for a, b in zip([0, *totals], totals))

    def plain(self, text: str) -> bytes:
        """The differences along a text without special strings."""
        if not self.rare(text):
            return b"\0".join(map(self.known.__getitem__, text.lower().split(" ")))
        out, at = [], 0
        text = self.normalise.normalize_str(text)
        for _, (start, end) in self.cut.pre_tokenize_str(text):
            out += [bytes(start - at), self.words[text[start:end]]]
            at = end
        return b"".join(out) + bytes(len(text) - at)

    def along(self, text: str) -> bytes:
        out, at, total, tail = [], 0, 0, ""
        for found in self.special.finditer(text):
            before = text[at : found.start()]
            out.append(self.plain(before))
            total = int(np.frombuffer(out[-1], np.int8).sum(dtype=np.int64))
            tail = re.search(r"\S*\Z", before).group()
            own = int(np.frombuffer(self.plain(tail), np.int8).sum(dtype=np.int64))
            # Inside a special string the prefix is ordinary text that may join the word before it; at its end it is one token.
            inside = [int(np.frombuffer(self.plain(tail + found.group()[:k]), np.int8).sum(dtype=np.int64)) - own for k in range(1, len(found.group()))]
            out.append(np.diff(np.array([0, *inside, 1])).astype(np.int8).tobytes())
            at = found.end()
        out.append(self.plain(text[at:]))
        return b"".join(out)


def prefix_counter(path: str) -> PrefixCounter:
    from patchlens.llm.workers import tool

    return tool(("token_counts", path), lambda: PrefixCounter(path))


def prefix_counts(text: Column, vocabulary: str, budget: int) -> Column:
    """struct<steps: binary, n_tokens: bigint, fitting: bigint>.

    steps has one signed byte per character, the tokens it adds to the prefix before it;
    fitting is the length of the longest prefix of at most `budget` tokens.
    """

    @F.arrow_udf("struct<steps: binary, n_tokens: bigint, fitting: bigint>")
    def along(texts: pa.Array) -> pa.Array:
        from patchlens.llm.token_counts import fitting, prefix_counter

        counter = prefix_counter(vocabulary)
        steps = [counter.along(t) for t in (x.as_py() for x in texts)]
        totals = [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in steps]
        fits = [fitting(d, budget) if n > budget else len(d) for d, n in zip(steps, totals)]
        return pa.StructArray.from_arrays([pa.array(steps, pa.binary()), pa.array(totals, pa.int64()), pa.array(fits, pa.int64())], ["steps", "n_tokens", "fitting"])

    return along(F.coalesce(text.cast("string"), F.lit("")))


def fitting(steps: bytes, budget: int) -> int:
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def tokens_in(differences: Column, n_chars: Column | None = None) -> Column:
    """bigint: tokens of the prefix of n_chars characters (the whole text if not given)."""

    @F.arrow_udf("bigint")
    def upto(rows: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(d, np.int8)[:n].sum(dtype=np.int64)) for d, n in zip(rows.to_pylist(), ends.to_pylist())], pa.int64())

    return upto(differences, F.length(differences).cast("bigint") if n_chars is None else n_chars.cast("bigint"))


def fitting_prefix(differences: Column, budget: int) -> Column:
    """bigint: characters of the longest prefix of at most `budget` tokens."""

    @F.arrow_udf("bigint")
    def fit(rows: pa.Array) -> pa.Array:
        from patchlens.llm.token_counts import fitting

        return pa.array([fitting(d, budget) for d in rows.to_pylist()], pa.int64())

    return fit(differences)


def with_prefix_counts(docs: DataFrame, vocabulary: str, budget: int = 2048, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs and `out`, a struct of the steps along the text, the tokens of all of it and the characters that fit the budget."""
    return docs.withColumn(out, prefix_counts(F.col(text), vocabulary, budget))
