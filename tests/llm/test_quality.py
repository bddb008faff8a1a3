"""Quality votes: held-out accuracy on the driver's labels, votes against brute force, defined cases."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions

from patchlens.llm import quality, queries


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    return {r.doc_id: r for r in queries.QUERIES["op11_quality"](spark, sf).collect()}, spark.read.parquet(f"{sf}/labels.parquet").collect()


def test_held_out_documents(scored):
    rows, labels = scored
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    hidden = [(rows[x.doc_id].score, x.quality) for x in labels if rows[x.doc_id].held_out]
    good, bad = ([s for s, q in hidden if q == v] for v in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97  # area under the curve
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s < 0.7 for s in bad]) > 0.8


def test_votes_against_brute_force():
    chance = np.random.default_rng(3)
    vectors = chance.standard_normal((300, 12)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[40:80] = vectors[40]  # ties
    good, block = chance.random(300), np.concatenate([vectors[38:43], vectors[200:205], np.zeros((1, 12), np.float32)])
    got = quality.votes(block, vectors, good, 0.6)
    for b, s in zip(block, got):
        like = np.array([round(float(x), 5) for x in vectors @ b])
        least = sorted(like)[-quality.NEIGHBOURS]
        near = [(x**quality.SHARPNESS, g) for x, g in zip(like, good) if x >= least and x > 0]
        if not near:
            assert s == pytest.approx(0.6)
            continue
        one = np.mean([w for w, _ in near])
        assert s == pytest.approx((sum(w * g for w, g in near) + 0.6 * one) / (sum(w for w, _ in near) + one), abs=1e-4)


def test_defined_cases(spark):
    good = ["The river runs past the old mill and the children play there."] * 3 + [f"A quiet word about house number {i} by the lake." for i in range(20)]
    bad = [f"BUY!! NOW!! CHEAP!! OFFER!! {w}!!" for w in "ABCDEFGHIJ"] + ["spam spam spam spam spam spam"] * 5
    texts = good + bad + [None, "", "   ", "word " * 300_000, "The river runs past the old mill and the children play there."]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "CHEAP!! NOW!!", 2)], "doc_id bigint, text string, score int")
    marks = [(i, int(i < len(good)), 0) for i in range(len(good) + len(bad))] + [(0, 0, 0), (None, 1, 0), (5, None, 0), (10_000, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    from pyspark.sql import functions as F

    model = quality.fit(docs, labels, keep=functions.lit(True))
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(rows) == len(texts) + 1
    n = len(good) + len(bad)
    assert rows[n] == rows[n + 1] == rows[n + 2] == pytest.approx(model["share"])
    assert rows[0] == rows[n + 4] > 0.7 and rows[None] < 0.3 and 0 <= rows[n + 3] <= 1
    nothing = quality.fit(docs, labels.where("false"), keep=functions.lit(True))
    assert nothing is None and {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.fit(docs.where("false"), labels, keep=F.lit(True)) is None


def test_all_rows_equal(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "the same words") for i in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    scores = {r.score for r in quality.score(docs, quality.fit(docs, labels, keep=F.lit(True))).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(0.5, abs=1e-6)


def test_sums_reach_the_driver_as_arrow(spark, monkeypatch):
    """No sum of a round and no vector is sent as a row, which the driver would hold several times."""
    rows = [(i, f"plain words number {i % 17} and more of them {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    frame, sent = type(docs), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.extend(t for _, t in self.dtypes) or real(self))
    model = quality.fit(docs, labels, functions.lit(True))
    assert model["vectors"].shape == (120, quality.DIMENSIONS) and "binary" not in sent
