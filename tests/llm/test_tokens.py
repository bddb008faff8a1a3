"""Token counts and byte-level BPE against the libraries, prefix by prefix."""

import base64
import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchlens.llm import byte_bpe, token_counts
from patchlens.llm.merges import START, RankMerges, WordMerges

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "abcdefghij '\"’.!?0123éèß\n\t Σσςİ漢字́̈ñ<|>€—…🙂ÀB한 मा"
ODD = ["", " ", "\n\n", "a", "<|endoftext|>", "x<|startoftext|>y don't", "we're'll", "é" * 200, "é İ", "-" * 300, "\x1c\x1d", "word " * 2000]


def texts(seed, n):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(ALPHABET if i % 3 else "aeinorst'") for _ in range(rng.randint(0, 25))) for i in range(n)]


@pytest.fixture(scope="module")
def word_library():
    library = Tokenizer.from_file(WORDS)
    return lambda t: len(library.encode(t, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def byte_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_neighbours_may_stand_together_exactly_if_their_text_is_encoded_so():
    m, rng = RankMerges(RANKS), random.Random(3)
    some = rng.sample(sorted(m.raw_of), 300)
    for x, y in zip(some, some[1:]):
        assert m.together(x, y) == (m.reduce([*m.spelling(x), *m.spelling(y)]) == [x, y])
    assert m.together(START, some[0])
    w = WordMerges(WORDS)
    inner, final = rng.sample(sorted(w.inner.values()), 300), rng.sample(sorted(w.final.values()), 300)
    for x, y in zip(inner, final):
        assert w.together(x, y) == (w.reduce([*w.spelling(x), *w.spelling(y)]) == [x, y])


def test_every_prefix_has_the_count_of_the_library(word_library):
    counter = token_counts.prefix_counter(WORDS)
    for t in texts(1, 400):
        steps = np.cumsum(np.frombuffer(counter.along(t), np.int8), dtype=int)
        assert (steps[-1] if len(steps) else 0) == word_library(t), repr(t)
        if len(t) < 60 and t == unicodedata.normalize("NFC", t) and "İ" not in t:
            assert steps.tolist() == [word_library(t[:i]) for i in range(1, len(t) + 1)], repr(t)


def test_counts_on_spark(spark, word_library):
    rows = [(i, t) for i, t in enumerate([*texts(5, 50), None])]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("tokens", F.lit("clash"))
    found = token_counts.with_prefix_counts(df, WORDS, budget=3)
    again = found.select("doc_id", "tokens.*", token_counts.tokens_in(F.col("tokens.steps")).alias("n"), token_counts.fitting_prefix(F.col("tokens.steps"), 3).alias("f"))
    for r in again.collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.n_tokens == r.n == word_library(t)
        assert r.fitting == r.f
        if t.isascii():
            assert word_library(t[: r.fitting]) <= 3
    assert token_counts.with_prefix_counts(df.where("false"), WORDS).count() == 0


def test_transducer_gives_the_ids_of_the_library(byte_library):
    tool = byte_bpe.Encoder(RANKS, P.PATTERN)
    for t in texts(2, 1500) + ["a" * n for n in range(40)]:
        assert list(tool.encode(t)) == byte_library.encode_ordinary(t), repr(t)


def test_short_words_need_few_states(byte_library):
    """What is agreed on no longer is part of a state, so invented words share states; long words are read by the other transducer."""
    tool, rng = byte_bpe.Encoder(RANKS, P.PATTERN), random.Random(9)
    syllables = ["on", "tion", "ment", "er", "ión", "heit", "ß", "que", "st", "é", "ing", "the"]
    words = [" " + "".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(5000)]
    for w in words + ["a" * n for n in (63, 64, 65)] + ["é" * 31 + "xyz"[:n] for n in range(4)]:
        assert list(tool.encode(w)) == byte_library.encode_ordinary(w), w
    other = byte_bpe.Transducer(tool.transducer.merges)
    for w in words:
        other.tokens(w.encode())
    assert len(tool.short.states) < 0.6 * len(other.states)


def test_a_worker_of_byte_bpe_keeps_only_what_it_needs_again():
    tool, reader = byte_bpe.coder(RANKS, P.PATTERN)
    assert reader.raw_of is tool.transducer.merges.raw_of and not reader.steps  # one table of the tokens' bytes
    short, word = tool.short, " zqxvkj".encode()
    before = short.tokens(word)
    states = len(short.states)
    for last in b"abcdefgh":  # the last byte of a word makes no state
        short.tokens(word[:-1] + bytes([last]))
    assert len(short.states) == states and short.tokens(word) == before
    assert all(isinstance(state, bytes) for state in short.states)
    # A word that came once is not remembered, and has the same tokens each time.
    first = tool.known[" wjkqzx"]
    assert " wjkqzx" not in tool.known
    assert tool.known[" wjkqzx"] == first and " wjkqzx" in tool.known and tool.known[" wjkqzx"] == first
    few = byte_bpe.Known(lambda key: key.encode(), 4)
    for key in [*"abab", *"cdcd", *"efef", *"abcdef"]:
        assert few[key] == key.encode() and len(few) <= 2 and len(few.older) <= 2


def test_small_batches_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_BYTES", 5)
    for rows in ([], ["", ""], ["abc", "de", "", "x" * 100, "é", "", "abcdef"], ["x" * 20] * 3):
        parts = list(byte_bpe.small_batches(byte_bpe.pa.array(rows, byte_bpe.pa.string())))
        assert [t for part in parts for t in part.to_pylist()] == rows
        assert all(sum(len(t.encode()) for t in part.to_pylist()[:-1]) <= 5 for part in parts)


def test_transducer_decides_early():
    """A long word is emitted on the way, not kept to its end."""
    t = byte_bpe.Encoder(RANKS, P.PATTERN).transducer
    at, pending = t.start, 0
    for byte in b"international" * 30:
        step = t.next.get(at << 8 | byte) or t.follow(at, byte)
        at = step[0]
        pending = max(pending, max(len(p) for p, _ in t.states[at][1]))
    assert pending <= 12


def test_utf8_machine_and_streaming():
    for raw in [b"\xc0\xaf", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc3", b"a\xffb", b"\xf0\x9f\x99\x82", "é漢".encode()]:
        state, bad = byte_bpe.CLOSED, 0
        for byte in raw:
            state, more = byte_bpe.utf8_step(state, byte)
            bad += more
        good = raw.decode("utf-8", "ignore").encode() == raw
        assert (bad == 0 and state == byte_bpe.CLOSED) == good, raw
    decoder = byte_bpe.StreamDecoder(RANKS)
    text = "naïve 🙂 漢字 end"
    ids = byte_bpe.Encoder(RANKS, P.PATTERN).encode(text)
    decoder.reset()
    parts = [decoder.feed(ids[i : i + 1]) for i in range(len(ids))]
    for part in parts:
        part.decode()  # no piece ends inside a character
    assert b"".join(parts).decode() == text and decoder.finish() == b"" and decoder.malformed == 0


def test_unknown_ids_raise():
    decoder = byte_bpe.StreamDecoder(RANKS)
    assert decoder.feed(np.array([], np.int32)) == b""
    for bad in (1 << 30, -1):
        with pytest.raises(Exception):
            decoder.feed(np.array([70, bad], np.int32))


def test_encode_and_decode_on_spark(spark, byte_library):
    rows = [(i, t) for i, t in enumerate([*texts(7, 60), None])]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    made = byte_bpe.with_decoded(byte_bpe.with_ids(df, RANKS, P.PATTERN), RANKS).withColumn("sha", F.sha2("decoded.bytes", 256)).withColumn("both", byte_bpe.round_trip(F.col("text"), RANKS, P.PATTERN))
    for r in made.collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.ids == byte_library.encode_ordinary(t)
        assert (r.both.ids, r.both.bytes, r.both.malformed) == (r.ids, r.decoded.bytes, 0)
        assert r.sha == hashlib.sha256(t.encode()).hexdigest() and r.decoded.malformed == 0
    broken = spark.createDataFrame([([128 + 70],), (None,), ([],)], "ids array<int>")
    assert byte_bpe.with_decoded(broken, RANKS).where("ids is null and decoded.bytes is not null").count() == 0


def test_memory_of_an_earlier_tool_is_returned():
    """A worker's next tool does not come on top of what the last one took."""
    code = """
import psutil
from patchlens.llm.workers import tool
pins = []
def make():
    kept = []
    for i in range(200_000):
        kept.append(bytes(1_000))
        if i % 1_000 == 0:
            pins.append(bytes(1_000))
    return kept
tool(("first",), make)
full = psutil.Process().memory_info().rss
tool(("second",), list)
print(full - psutil.Process().memory_info().rss)
"""
    import subprocess
    import sys

    from patchlens.llm.workers import ROOT

    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert int(got) > 150 << 20
