"""Alignment of two tokenizers against whole encodings, sets of ends and counting pair by pair."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from patchlens.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in queries.ALIGNED)


def plain(texts):
    """Rows of the contract by whole encodings and sets."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    width, docs, holds = b.get_piece_size(), [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = (
            [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([b.id_to_piece(i)[3:5] and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if not text or b"".join(parts[0]) != raw or b"".join(parts[1]) != raw:
            docs.append(None)
            continue
        at = []
        for side in parts:
            total, ends = 0, []
            for x in side:
                total += len(x)
                ends.append(total)
            at.append(ends)
        cuts = sorted(set(at[0]) & set(at[1]))
        sides = [defaultdict(list), defaultdict(list)]
        for s in (0, 1):
            for i, e in zip(ids[s], at[s]):
                sides[s][next(c for c in cuts if c >= e)].append(i)
        links = Counter((x, y) for c in cuts for x in sides[0][c] for y in sides[1][c])
        holds.update(links.keys())
        docs.append((len(ids[0]), len(ids[1]), [(sides[0][c], sides[1][c]) for c in cuts], links, cuts))
    most = Counter()
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d[2])
        best = sum(n for (x, y), n in d[3].items() if holds[x, y] == most[x])
        rows.append((d[0], d[1], len(d[2]), sum(d[3].values()), best, sum(n * holds[p] for p, n in d[3].items()), hashlib.sha256(line.encode()).hexdigest()))
    return rows, [d and d[4] for d in docs], width


TEXTS = [
    "The word, the other  word\n and\tone more.", None, "", " ", "  two blanks before", "x ", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "naïve café 東京都 is 🙂🙂 — ok’s don't DON'T 12345 1 2 34", "a" * 3000, "é" * 500, "🙂" * 200 + " end", "The word, the other  word\n and\tone more.",
    "　wide blank \x1c sep \x85 next", "word " * 2000, "ab́c ﬁ ﷺ " * 5,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "y"), (None, "null id", "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_links string")


@pytest.mark.parametrize("limit", [1 << 20, 0, 40])
def test_rows_are_those_of_whole_encodings(docs, limit):
    want, _, _ = plain([r.text for r in docs.collect()])
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in alignment.correspondences(docs, A, B, limit=limit).select("doc_id", *names).collect()]
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(((i, *w) for i, w in zip(ids, want)), key=repr)


def test_groups_and_ends(docs):
    _, cuts, width = plain(TEXTS)
    rows = {r.doc_id: r for r in alignment.align(docs.where("n_links = 'x'"), A, B, ends=True).collect()}
    assert [rows[i].ends or None for i in range(len(TEXTS))] == cuts
    assert all(sum(r.times) == r.n_links and len(r.codes) == len(set(r.codes)) for r in rows.values())
    assert rows[0].groups.count(";") + 1 == rows[0].n_groups and max(rows[0].codes) % width < width


def test_driver_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = plain([r.text for r in docs])
    got = queries.QUERIES["op13_alignment"](spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *w) for r, w in zip(docs, want))


def test_walk_finds_every_shared_cut():
    import random

    chance = random.Random(5)
    for _ in range(300):
        n = chance.randint(1, 60)
        a, b = ([*sorted(chance.sample(range(1, n), chance.randint(0, n - 1))), n] for _ in range(2))
        found = alignment.groups_of(a, b)
        assert [a[g[1] - 1] for g in found] == sorted(set(a) & set(b))
        assert [g[0] for g in found] == [0, *(g[1] for g in found[:-1])] and [g[2] for g in found] == [0, *(g[3] for g in found[:-1])]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.correspondences(none, A, B).count() == 0
