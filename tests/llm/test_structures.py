"""Small-world graphs against brute force, Merkle fingerprints against a plain one, the pipeline end to end."""

import hashlib
import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from compare import difference, duck

from patchlens.llm import hnsw, merkle, queries


def nearest_of(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            near = sorted((math.dist(v, w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out[q] = [(r, i, d) for r, (d, i) in enumerate(near, 1)]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 300)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.3, size=12)).tolist()) for i in range(1_500)]
    rows += [(5_000 + i, rows[100][1]) for i in range(200)]  # many copies of a query
    rows += [(9_000, None), (9_001, [0.0] * 12), (9_002, [None] * 12), (9_003, [math.nan] * 12), (9_100, [math.inf] * 12), (None, [1.0] * 12)]
    rows += [(9_200, [1.0, 2.0]), (9_201, [1.0, 2.5]), (9_300, [3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for r in hnsw.nearest(df, df.where("vec_id % 100 = 0"), k=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q: w for q, w in nearest_of(rows, 10).items() if w}
    assert found.keys() == want.keys()
    hits = sum(len({i for _, i, _ in found[q]} & {i for _, i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))
    assert hits >= 0.95
    vectors = dict(rows)
    for q, got in found.items():
        assert [r for r, _, _ in sorted(got)] == list(range(1, len(got) + 1))
        assert all(math.isclose(s, math.dist(vectors[q], vectors[i]), rel_tol=1e-12) for _, i, s in got)
    assert [i for _, i, _ in sorted(found[100])] == list(range(5_000, 5_010))  # ties to the smaller id
    assert found[9_200] == [(1, 9_201, 0.5)] and 9_300 not in found
    none = df.where("false")
    assert hnsw.nearest(none, none, k=10).count() == 0


def plain_print(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, written = [[]], ""
    for p in text.split("\n"):
        d, mark = sha(p), "/" if sha(p) < "4" else ","
        written += ".".join(sha(x)[:8] for x in re.findall(merkle.PIECE, p)) + mark
        sections[-1].append(d + ("" if mark == "/" else ","))
        if mark == "/":
            sections.append([])
    return sha("".join(sha("".join(s)) for s in sections)) + ":" + written


def test_fingerprints_and_edits(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 4)
    rng = random.Random(2)
    rows = [(i * 7 - 30, "\n".join(" ".join(rng.choice(["ä", "bc", "def\t"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 9)))) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "x"), (403, "🙂é" * 3_000), (17, rows[3][1])]
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id bigint, bucket int")
    found = {r.doc_id: r for r in merkle.compare_with_edits(df.where("doc_id <> 17")).collect()}
    order = sorted((r for r in rows if r[0] != 17), reverse=True)
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(t), plain_print(changed))
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1) >= (t == changed) and (r.section is None) == (t == changed)
    assert merkle.compare_with_edits(df.where("false")).count() == 0
    assert merkle.compare_with_edits(df.where("doc_id = 402")).first().near_next == 1.0


def test_neighbours_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (2, "b")], "doc_id bigint, text string")
    found = sorted(((r.own, r.text, r.next_text) for r in merkle.with_next(df).collect()), key=str)
    assert found == sorted([(2, "b", "a"), (1, "a", "a"), (1, "a", "n"), (None, "n", "b")], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name]) == ""


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "mixing", "byte_bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert sorted(after.columns) == sorted(docs.columns)
        assert after.join(kept, docs.columns, "left_anti").count() == 0  # rows are kept as they are or dropped
        kept = after
        if name == "near_copies":
            texts = [r.text for r in kept.select("text").collect()]
            assert len(set(texts)) == len(texts)
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.count() > 0 and done.where("not round_trip or size(ids) <> n_tokens").count() == 0
