"""The join against brute force, also with blocks so small that every group is cut."""

import random

import numpy as np
import pytest

from patchlens.llm import near_join as nj

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 80)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(i + 1, None), (i + 2, ""), (i + 3, "  \n"), (i + 4, "one two"), (i + 5, "one two"), (i + 6, "one two three"), (i + 7, rows[0][1]), (i + 8, " ".join(WORDS * 60))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [nj.BLOCK, 4])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = corpus(block)
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id bigint, class_id int, n string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in nj.near_copies(df).collect()}
    assert found == brute(rows)


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    text = " ".join(WORDS[:50])
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id bigint, text string")
    found = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in nj.near_copies(df).collect())
    assert found == [(-1, None, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert nj.near_copies(df.where("false")).count() == 0


def test_recall_of_the_prefix():
    p = nj.shortest_prefix(0.8, nj.RECALL)
    assert 1 - (1 - 0.8**p) ** nj.TREES >= nj.RECALL > 1 - (1 - 0.8 ** (p + 1)) ** nj.TREES


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9_000, n).astype(np.uint64)) for n in (5, 6_000, 6_000, 1, 3_000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = nj.shared_counts(sets)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a bigint, b bigint")
    roots = {r.node: r.root for r in nj.components(edges).collect()}
    assert roots == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}
