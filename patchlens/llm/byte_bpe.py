"""Byte-level BPE as a finite-state transducer, and decoding through a UTF-8 state machine.

The transducer reads a word byte by byte. A state holds, for every place where the next token
could still start, the tokens that lead there and have not been emitted; as soon as all of
them agree on a first token, it is emitted. States and transitions are made when first
needed and kept, so reading on is one lookup per byte. How long a token can stay undecided
is bounded by the vocabulary, not by the text.

For words of up to SHORT bytes the transducer emits the last token of the bytes read so far
instead, at every byte: what comes before it need not be kept in the state, so there are far
fewer states, and the tokens are read off these from the end of the word.

Defined cases: a null text counts as empty; an empty text has no tokens; the words of special
tokens inside a text are ordinary text; null ids decode to null, unknown ids raise; equal rows
give equal results; other columns, whatever their names, are kept.
"""

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.merges import Recent

CACHE = 240_000  # words whose tokens a worker remembers
CAME = 1 << 22  # places for the words that came once
STATES = 80_000
SHORT, SHORT_STATES = 64, 200_000
PIECE_BYTES = 2 << 20  # of text that a worker takes out of a batch at a time
START = -1


class Transducer:
    """Tokens of one word after another."""

    def __init__(self, merges):
        self.merges = merges
        self.first = (START, (((), 0),))
        self.reset()

    def reset(self):
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, tuple[int, tuple]] = {}  # by state << 8 | byte
        self.start = self.number(self.first)

    def number(self, state: tuple) -> int:
        """state: (last token emitted, for each open start the tokens since and the node of the bytes since, longest bytes first)."""
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def follow(self, number: int, byte: int) -> tuple[int, tuple]:
        """(next state, tokens emitted)."""
        m, opens, ended = self.merges, [], None
        step, token_at, going_on, seen = m.trie.at.get, m.trie.first, m.trie.inner_nodes, m.seen.get
        context, before = self.states[number]
        for pending, node in before:
            node = step(node << 8 | byte)
            if node is None:
                continue
            if ended is None:
                token = token_at[node]
                if token is not None:
                    last = pending[-1] if pending else context
                    fits = last == START or seen(last << 20 | token)
                    if m.together(last, token) if fits is None else fits:
                        ended = (*pending, token)
            if node in going_on:
                opens.append((pending, node))
        opens.append((ended, 0))
        emitted = ()
        if opens[0][0]:  # else nothing is agreed on yet
            low, high = min(opens)[0], max(opens)[0]
            shared = 0
            for x, y in zip(low, high):
                if x != y:
                    break
                shared += 1
            if shared:
                emitted, context = low[:shared], low[shared - 1]
                opens = [(pending[shared:], node) for pending, node in opens]
        made = self.next[number << 8 | byte] = (self.number((context, tuple(opens))), emitted)
        return made

    def tokens(self, word: bytes) -> list[int]:
        if len(self.states) > STATES:
            self.reset()
        at, out, known = self.start, [], self.next.get
        for byte in word[:-1]:
            at, emitted = known(at << 8 | byte) or self.follow(at, byte)
            if emitted:
                out += emitted
        out += self.close(at, word[-1]) if word else ()
        return out

    def close(self, number: int, byte: int) -> tuple:
        """The tokens left at the end of a word: at its last byte only the start behind it counts, and no state is needed."""
        m = self.merges
        step, token_at, seen = m.trie.at.get, m.trie.first, m.seen.get
        context, before = self.states[number]
        for pending, node in before:
            node = step(node << 8 | byte)
            token = None if node is None else token_at[node]
            if token is not None:
                last = pending[-1] if pending else context
                fits = last == START or seen(last << 20 | token)
                if m.together(last, token) if fits is None else fits:
                    return (*pending, token)
        raise ValueError("a byte without a token")


class LastTokens:
    """The transducer for short words: what it emits at a byte is the last token of the word up to there.

    A state holds, for each place where the next token could still start, the token that ends
    there and the node of the bytes since, longest bytes first, as one 64-bit integer each. States
    are kept as bytes, a third of a tuple of integers, and the last byte of a word makes none.
    """

    def __init__(self, merges):
        self.merges = merges
        self.lengths = bytearray(max(merges.raw_of) + 1) if max(map(len, merges.raw_of.values())) < 256 else [0] * (max(merges.raw_of) + 1)
        for token, raw in merges.raw_of.items():
            self.lengths[token] = len(raw)
        self.reset()

    def reset(self):
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.next: dict[int, int] = {}  # by state << 8 | byte: next state << 20 | token emitted
        self.start = self.number(array("q", [START << 32]).tobytes())

    def number(self, state: bytes) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def follow(self, number: int, byte: int) -> int:
        m, opens, ended = self.merges, [], None
        step, token_at, going_on, seen = m.trie.at.get, m.trie.first, m.trie.inner_nodes, m.seen.get
        for place in memoryview(self.states[number]).cast("q"):
            last = place >> 32
            node = step((place & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            if ended is None:
                token = token_at[node]
                if token is not None:
                    fits = last == START or seen(last << 20 | token)
                    if m.together(last, token) if fits is None else fits:
                        ended = token
            if node in going_on:
                opens.append(last << 32 | node)
        if ended is None:
            raise ValueError("a byte without a token")
        opens.append(ended << 32)
        made = self.next[number << 8 | byte] = self.number(array("q", opens).tobytes()) << 20 | ended
        return made

    def close(self, number: int, byte: int) -> int:
        """The token that ends a word; what could start inside it is not needed."""
        m = self.merges
        step, token_at, seen = m.trie.at.get, m.trie.first, m.seen.get
        for place in memoryview(self.states[number]).cast("q"):
            node = step((place & 0xFFFFFFFF) << 8 | byte)
            token = None if node is None else token_at[node]
            if token is not None:
                last = place >> 32
                fits = last == START or seen(last << 20 | token)
                if m.together(last, token) if fits is None else fits:
                    return token
        raise ValueError("a byte without a token")

    def tokens(self, word: bytes) -> list[int]:
        if len(self.states) > SHORT_STATES:
            self.reset()
        if not word:
            return []
        at, emitted, known, lengths = self.start, [], self.next.get, self.lengths
        for byte in word[:-1]:
            made = known(at << 8 | byte)
            if made is None:
                made = self.follow(at, byte)
            emitted.append(made & 0xFFFFF)
            at = made >> 20
        made = known(at << 8 | word[-1])
        emitted.append(self.close(at, word[-1]) if made is None else made & 0xFFFFF)
        out, end = [], len(word)
        while end:
            token = emitted[end - 1]
            out.append(token)
            end -= lengths[token]
        out.reverse()
        return out


class Known(Recent):
    """Recent, where a word is remembered when it comes again: most different words come once, and would drive out others."""

    def __init__(self, make, size: int):
        super().__init__(make, size)
        self.came = bytearray(CAME)  # by hash

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found, place = self.make(key), hash(key) % CAME
            if not self.came[place]:
                self.came[place] = 1
                return found
        if len(key) <= self.longest_key:
            if len(self) >= self.size:
                self.older, self.came = dict(self), bytearray(CAME)
                self.clear()
            self[key] = found
        return found


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        from patchlens.llm.merges import RankMerges, common_pattern

        self.cut_any = regex.compile(pattern).findall
        self.cut, self.rare = common_pattern(pattern)
        self.transducer = Transducer(RankMerges(path))
        self.short = LastTokens(self.transducer.merges)
        self.known = Known(self.word, CACHE)

    def word(self, word: str) -> bytes:
        """Ids as 32-bit integers."""
        raw, merges = word.encode(), self.transducer.merges
        whole = merges.ids.get(raw)
        # A listed word is one token even where no joins lead to it.
        if whole is not None and not merges.reachable(whole):
            return array("i", [whole]).tobytes()
        reader = self.short if len(raw) <= SHORT else self.transducer
        return array("i", reader.tokens(raw)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        cut = self.cut_any if self.rare(text) else self.cut
        return np.frombuffer(b"".join(map(self.known.__getitem__, cut(text))), dtype=np.int32)


# The open part of a character: bytes still to come, and the range of the next one.
CLOSED = (0, 0, 0)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[tuple[int, int, int], int]:
    """(next state, malformed sequences ended by this byte)."""
    more, low, high = state
    if more:
        if low <= byte <= high:
            return ((more - 1, 0x80, 0xBF) if more > 1 else CLOSED), 0
        after, bad = utf8_step(CLOSED, byte)
        return after, bad + 1
    if byte < 0x80:
        return CLOSED, 0
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF), 0
    if 0xE0 <= byte <= 0xEF:  # no overlong forms, no surrogates
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), 0
    if 0xF0 <= byte <= 0xF4:  # nothing beyond the last code point
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), 0
    return CLOSED, 1


class StreamDecoder:
    """Bytes and characters of ids that arrive in pieces; a character cut by a piece waits for its rest."""

    def __init__(self, path: str, raw_of: dict[int, bytes] | None = None):
        if raw_of is None:
            with open(path, "rb") as file:
                raw_of = {int(rank): base64.b64decode(raw) for raw, rank in (line.split() for line in file if line.strip())}
        self.raw_of = raw_of
        self.raws = pa.array(map(self.raw_of.get, range(max(self.raw_of) + 1)), pa.binary())
        self.steps: dict[tuple, tuple] = {}
        self.whole = np.zeros(max(self.raw_of) + 1, dtype=bool)
        for token in self.raw_of:
            self.whole[token] = self.walk(CLOSED, token) == (CLOSED, 0)
        self.reset()

    def reset(self):
        self.state, self.held, self.malformed = CLOSED, b"", 0

    def walk(self, state: tuple, token: int) -> tuple:
        bad = 0
        for byte in self.raw_of[token]:
            state, more = utf8_step(state, byte)
            bad += more
        return state, bad

    def step(self, state: tuple, token: int) -> tuple:
        """What `walk` gives, remembered; tokens of whole characters in a closed state never come here."""
        found = self.steps.get((state, token))
        if found is None:
            found = self.steps[state, token] = self.walk(state, token)
        return found

    def joined(self, ids: np.ndarray) -> bytes:
        found = self.raws.take(pa.array(ids))
        if found.null_count:
            raise KeyError("an unknown id")
        ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
        return found.buffers()[2][ends[0] : ends[-1]].to_pybytes() if len(found) else b""

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters that these ids complete."""
        raw = self.held + self.joined(ids)
        odd = np.flatnonzero(~self.whole[ids]).tolist() if len(ids) else []
        at = 0 if self.state != CLOSED else (odd[0] if odd else len(ids))
        k = 0
        while at < len(ids):  # tokens of whole characters leave a closed state closed
            self.state, bad = self.step(self.state, int(ids[at]))
            self.malformed += bad
            at += 1
            if self.state == CLOSED:
                while k < len(odd) and odd[k] < at:
                    k += 1
                at = odd[k] if k < len(odd) else len(ids)
        wait = self.open_bytes(raw)
        self.held = raw[len(raw) - wait :]
        return raw[: len(raw) - wait]

    def open_bytes(self, raw: bytes) -> int:
        """Bytes at the end that belong to a character not yet complete."""
        more = self.state[0]
        if not more:
            return 0
        for n in range(1, 4):
            lead = raw[-n]
            if lead >= 0xC0:
                return n
        return 0

    def finish(self) -> bytes:
        """What is left of an incomplete character."""
        rest, self.malformed = self.held, self.malformed + bool(self.held)
        self.state, self.held = CLOSED, b""
        return rest


def coder(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    from patchlens.llm.workers import tool

    def both() -> tuple[Encoder, StreamDecoder]:
        encoder = Encoder(path, pattern)
        return encoder, StreamDecoder(path, encoder.transducer.merges.raw_of)

    return tool(("byte_bpe", path, pattern), both)


def decoder(path: str) -> StreamDecoder:
    from patchlens.llm.workers import tool

    return tool(("byte_bpe decoder", path), lambda: StreamDecoder(path))


def small_batches(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about PIECE_BYTES of text each, a longer text with those before it, so that results leave a worker early."""
    if not len(texts):
        yield texts
        return
    ends = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = min(len(texts), int(np.searchsorted(ends, done + PIECE_BYTES)) + 1)
        yield texts.slice(at, to - at)
        at = to


def encode(text: Column, ranks: str, pattern: str) -> Column:
    """array<int>: ids of the text, each match of the pattern by itself."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        from patchlens.llm.byte_bpe import coder

        (tool, _), starts, parts = coder(ranks, pattern), [0], []
        for t in (x.as_py() for x in texts):
            parts.append(tool.encode(t))
            starts.append(starts[-1] + len(parts[-1]))
        flat = np.concatenate(parts) if parts else np.array([], np.int32)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))

    return ids_of(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, ranks: str, piece: int = 4096) -> Column:
    """struct<bytes: binary, malformed: int>: the bytes of the ids and how many sequences in them are no UTF-8."""

    @F.arrow_udf("struct<bytes: binary, malformed: int>")
    def bytes_of(rows: pa.Array) -> pa.Array:
        from patchlens.llm.byte_bpe import decoder

        tool, out, malformed = decoder(ranks), [], []
        flat, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
        present = rows.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(rows)):
            if not present[i]:
                out.append(None)
                malformed.append(None)
                continue
            tool.reset()
            parts = [tool.feed(flat[at : min(at + piece, ends[i + 1])]) for at in range(ends[i], ends[i + 1], piece)]
            out.append(b"".join([*parts, tool.finish()]))
            malformed.append(tool.malformed)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(malformed, pa.int32())], ["bytes", "malformed"])

    return bytes_of(ids)


def round_trip(text: Column, ranks: str, pattern: str, piece: int = 4096) -> Column:
    """struct<ids: array<int>, bytes: binary, malformed: int>: the ids of the text and what these ids decode to.

    Both in one pass: as two columns, one made of the other, the encoding would run twice.
    """

    @F.arrow_udf("struct<ids: array<int>, bytes: binary, malformed: int>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from patchlens.llm.byte_bpe import coder, small_batches

        tool, reader = coder(ranks, pattern)
        for texts in (few for batch in batches for few in small_batches(batch)):
            starts, parts, raws, malformed = [0], [], [], []
            for t in (x.as_py() for x in texts):
                ids = tool.encode(t)
                parts.append(ids)
                starts.append(starts[-1] + len(ids))
                reader.reset()
                raws.append(b"".join([*(reader.feed(ids[at : at + piece]) for at in range(0, len(ids), piece)), reader.finish()]))
                malformed.append(reader.malformed)
            flat = np.concatenate(parts) if parts else np.array([], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.StructArray.from_arrays([ids, pa.array(raws, pa.binary()), pa.array(malformed, pa.int32())], ["ids", "bytes", "malformed"])

    return both(F.coalesce(text.cast("string"), F.lit("")))


def with_ids(docs: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    return docs.withColumn(out, encode(F.col(text), ranks, pattern))


def with_decoded(rows: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    return rows.withColumn(out, decode(F.col(ids), ranks))
