"""Prefix tries against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from patchlens.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows of the contract from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        grown = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
        for d in range(len(grown) + 1):
            members[tuple(grown[:d])].append(c)
        ends[tuple(grown)].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, of in members.items():
        cost = (len(of) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += p not in children
    return sorted(
        [
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in members.items()
        ],
        key=repr,
    )


def built(spark, rows, height=prefix_trie.HEIGHT):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("clash"))
    turns = prefix_trie.ordered_turns(df)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    found = prefix_trie.trie(*prefix_trie.regrafted(turns, F.expr("conv_id - conv_id % 5"), head, 8), height=height)
    return sorted(map(tuple, found.select(*COLUMNS).collect()), key=repr)


def random_rows(seed, n):
    chance = random.Random(seed)
    rows = []
    for c in chance.sample(range(-20, 4 * n), n):
        for t in range(chance.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, chance.choice([t, t, None, 3]), chance.choice(["user", "assistant", None]), chance.choice(["a", "a", "bb", "é", "", None, "long " * 50])))
    rows += rows[:5] + [(None, 1, "user", "x")]
    return rows


@pytest.mark.parametrize("height", [8, 3])
def test_random_conversations(spark, height):
    rows = random_rows(height, 60)
    assert built(spark, rows, height) == plain(rows)


def test_deep_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = [(7, t, "user", "same") for t in range(150)] + [(c, t, "user", "same") for c in range(40, 90) for t in range(60)] + [(3, None, "user", "same")] * 70
    assert built(spark, rows, 4) == plain(rows)


def test_empty_table(spark):
    assert built(spark, []) == []


def test_driver_rows(spark, sf_dir):
    con = duck(sf_dir)
    assert difference(queries.QUERIES["op12_prefix_trie"](spark, sf_dir), con, queries.ORACLES["op12_prefix_trie"]) == ""
    assert plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()) == sorted(
        [tuple(r) for r in con.execute(queries.ORACLES["op12_prefix_trie"]).fetchall()], key=repr
    )
