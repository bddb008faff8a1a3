"""Language model, toxicity, mixing and licences: exact parts against brute force, learned parts on planted cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from patchlens import session
from patchlens.llm import class_ngrams, licences, mixing, toxicity

SCHEMA = "doc_id bigint, text string"


def words(rng, n, kind):
    return " ".join(rng.choice([f"{kind}{i}{rng.choice(['na', 'no'])}" for i in range(30)]) for _ in range(n))


# --- class n-grams ------------------------------------------------------------------------


def language(seed, n=300):
    """Two languages that never mix within a text; rare and repeated words, empty texts, odd blanks."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 60), "ab"[i % 2])) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t A\x0bz z Ä ä A "), (n + 3, "new" + "x" * 5_000)]


def test_counts_and_base_score_are_exact(spark):
    rows = language(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("train", F.lit("clash")).withColumn("score", F.lit(0))
    found = {r.doc_id: r for r in class_ngrams.score(df, ~class_ngrams.held_out(F.col("doc_id"))).collect()}
    cut = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(cut(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        r, tokens = found[i], cut(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(x in counts for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
    held = [r for r in found.values() if not r.train]
    per = lambda name: sum(getattr(r, name) for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score") + 0.15  # knowing the language halves the choice


def test_model_sums_to_one(spark):
    """Probabilities of all words and one unknown per class, after any class, sum to one."""
    rows = language(2, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    vocabulary = sorted({w for _, t in rows for w in (t or "").encode().lower().split()})
    ask = [(1_000 + i, w.decode()) for i, w in enumerate(vocabulary)] + [(999, "")]
    both = df.withColumn("keep", F.lit(True)).unionByName(spark.createDataFrame(ask, SCHEMA).withColumn("keep", F.lit(False)))
    found = {r.doc_id: r.score for r in class_ngrams.score(both, F.col("keep")).where("doc_id >= 999").collect()}
    assert 10 ** found[999] < 1  # the end as the first token
    # A one-word text is P(word | end) * P(end | class of word); both are probabilities, so the sum stays below one.
    assert 0 < sum(10**s for s in found.values()) <= 1


def test_exchange_separates_words_that_never_meet():
    size, rng = 40, np.random.default_rng(3)
    text = [np.concatenate([[0], rng.integers(1, 20, 30) + (19 if k % 2 else 0)]) for k in range(200)]
    flat = np.concatenate([*text, [0]])
    classes = np.array([0, *(1 + zlib.crc32(b"%d" % i) % 2 for i in range(1, size))], dtype=np.int16)
    k = class_ngrams.CLASSES
    for _ in range(4):
        left, right = (np.zeros((size, k), dtype=np.int64) for _ in range(2))
        np.add.at(left, (flat[1:], classes[flat[:-1]]), 1)
        np.add.at(right, (flat[:-1], classes[flat[1:]]), 1)
        pairs = np.zeros((k, k), dtype=np.int64)
        np.add.at(pairs.T, classes, left)
        classes = class_ngrams.exchange(np.arange(1, size), left, right, classes.copy(), pairs)
    assert not set(classes[1:20]) & set(classes[20:39])


def test_model_of_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    assert class_ngrams.score(df.where("false"), F.lit(True)).count() == 0
    r = class_ngrams.score(df, F.lit(False)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 2, 0.0)


# --- toxicity -----------------------------------------------------------------------------


def all_segments(w):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    best = max(((sum(w[a:b]), a - b, -a) for a in range(len(w)) for b in range(a + 1, len(w) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return all_segments(w[:a]) + [(a, b)] + [(x + b, y + b) for x, y in all_segments(w[b:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice([-3, -2, -1, -0.5, 1, 2, 4.25, 7.125]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(w)] == all_segments(w)


def toxic_corpus(seed, n=600):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t = words(rng, rng.randint(3, 120), "ab"[i % 2]).split()
        bad = rng.random() < 0.2
        if bad:
            at = rng.randrange(len(t) + 1)
            t[at:at] = [rng.choice(["vile", "grub" + rng.choice(["an", "el", "ost"])]) for _ in range(rng.randint(1, 4))]
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return docs, labels


def test_planted_passages_are_found(spark):
    docs, labels = toxic_corpus(5)
    extra = [(9_000, None), (9_001, ""), (9_002, "grubnever vile"), (9_003, "ab " * 40_000)]
    df = spark.createDataFrame(docs + extra, SCHEMA).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(labels[0][0], labels[0][1]), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, marks, keep=~toxicity.held_out(F.col("own")))
    found = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    truth = dict(labels)
    wrong = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1 and (found[i].score >= 0.7) != bool(truth[i])]
    assert len(wrong) <= 4 and found[9_002].score >= 0.7
    assert max(found[i].score for i in (9_000, 9_001, 9_003)) < 0.2
    assert [found[9_002].passages[0][k] for k in ("start", "end")] == [0, 14]
    none = toxicity.fit(df, marks.where("toxic = 0"), keep=F.lit(True))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.where("false"), model).count() == 0


# --- mixing -------------------------------------------------------------------------------


def test_raking_meets_given_marginals(spark):
    rows = [(s, l, t, n) for (s, l, t), n in zip(((s, l, t) for s in ("a", "b", None) for l in ("x", "y") for t in (0, 1)), [5, 70, 3, 9, 40, 2, 8, 30, 11, 6, 1, 15])]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens bigint")
    targets = {"source": {"a": 0.5, "b": 0.3, None: 0.2, "unheard": 0.4}, "lang": {"x": 0.25, "y": 0.75}, "topic": None}
    made = mixing.calibrated(mixing.rake(cells, targets), 0.4).collect()
    total = sum(r.tokens for r in made)
    by = lambda name: {k: sum(r.weight for r in made if r[name] == k) / total for k in {r[name] for r in made}}
    assert all(math.isclose(by("source")[k], x, rel_tol=1e-4) for k, x in {"a": 0.5, "b": 0.3, None: 0.2}.items())
    assert math.isclose(by("lang")["y"], 0.75, rel_tol=1e-4)
    # Brute force: the same scaling in numpy.
    w = {(r.source, r.lang, r.topic): float(r.tokens) for r in made}
    flat = {t: sum(x for k, x in w.items() if k[2] == t) ** 0.7 for t in (0, 1)}
    wants = [{"a": 0.5, "b": 0.3, None: 0.2}, {"x": 0.25, "y": 0.75}, {t: x / sum(flat.values()) for t, x in flat.items()}]
    for _ in range(300):
        for d, want in enumerate(wants):
            now = {v: sum(x for k, x in w.items() if k[d] == v) for v in want}
            w = {k: x * want[k[d]] * total / now[k[d]] for k, x in w.items()}
    assert all(math.isclose(r.weight, w[r.source, r.lang, r.topic], rel_tol=1e-3) for r in made)
    assert math.isclose(sum(r.probability * r.tokens for r in made), 0.4 * total, rel_tol=1e-4)


def test_mixture_samples_by_probability(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 20, "ab"[i % 4 == 0]), "s0" if i % 3 else "s1", "l" + str(i % 4 == 0)) for i in range(3_000)]
    rows += [(None, "a b", None, None), (7, None, "s0", "lTrue")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("topic", F.lit("clash"))
    made = mixing.mix(df, share=0.5).collect()
    weighed = mixing.weigh(df, share=0.5).collect()
    key = lambda r: (r.doc_id or -1, r.topic, r.n_tokens, r.weight, r.probability, r.kept)
    assert sorted(map(key, weighed)) == sorted(map(key, made))
    assert len(made) == len(rows) and all(r.probability is not None for r in made)
    tokens = sum(r.n_tokens for r in made)
    assert abs(sum(r.n_tokens for r in made if r.kept) / tokens - 0.5) < 0.04
    for lang in ("lTrue", "lFalse"):
        mine = [r for r in made if r.lang == lang]
        assert abs(sum(r.kept for r in mine) / len(mine) - sum(r.probability for r in mine) / len(mine)) < 0.06
    assert mixing.mix(df.where("false")).count() == 0


def test_topics_are_told_once_where_rows_are_filtered(spark):
    """A filter on `kept` is not moved below the topics: that would read every text twice, in two Python workers a task."""
    df = spark.createDataFrame([(i, f"word{i % 9} text{i % 4} of {i}", "ab"[i % 2], "en") for i in range(60)], "doc_id bigint, text string, source string, lang string")
    kept = mixing.mix(df, share=0.5).where("kept").select("doc_id", "text")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixing.weigh(df, share=0.5).where("kept").collect())


def test_rate_follows_the_clean_scores():
    class Row:
        def __init__(self, scores, toxic=0):
            self.toxic, self.tokens, self.scores = toxic, 100, scores

    rng = random.Random(6)
    for rate in (0.2, 0.7, 1.0, 3.0):
        clean = [Row([toxicity.LEAST_ODDS + rng.expovariate(rate) for _ in range(rng.randint(0, 4))]) for _ in range(2_000)]
        decay, scale = toxicity.extreme_value_law([*clean, Row([50.0] * 9, toxic=1)])
        assert abs(decay / rate - 1) < 0.1
        seen = [s for r in clean for s in r.scores]
        for s in (toxicity.LEAST_ODDS, toxicity.LEAST_ODDS + 1 / rate):  # expected and seen number of segments of at least s
            assert abs(scale * 200_000 * math.exp(-decay * s) / sum(x >= s for x in seen) - 1) < 0.1
    for rows in ([], [Row([])], [Row([toxicity.LEAST_ODDS] * 10_000)]):
        assert all(map(math.isfinite, toxicity.extreme_value_law(rows)))
    assert toxicity.extreme_value_law([Row([])])[0] == 1.0


# --- licences -----------------------------------------------------------------------------


def test_licence_lines_are_told_from_text(spark):
    rng = random.Random(8)
    docs, planted = [], {}
    families = [(f, n) for f, all_ in licences.NOTICES.items() for n in all_]
    for i in range(400):
        lines = [words(rng, rng.randint(2, 20), rng.choice("ab")) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            family, notice = families[i // 5 % len(families)]
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, notice)
            planted[i, at + 1] = family
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs + [(500, None), (501, ""), (502, "the license of the mit is not apache, version nothing")], SCHEMA).withColumn("family", F.lit("clash"))
    found = licences.scan(df, licences.fit(df)).where("doc_id < 500").collect()
    assert {(r.doc_id, r.paragraph): r.family for r in found} == planted and all(r.confirmed for r in found)
    assert licences.scan(df.where("false"), licences.fit(df.where("doc_id < 20"))).count() == 0


def licensed(n=400):
    """Texts of which every fifth holds a notice as a line."""
    rng = random.Random(8)
    notices = [n for all_ in licences.NOTICES.values() for n in all_]
    for i in range(n):
        lines = [words(rng, rng.randint(2, 20), rng.choice("ab")) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), notices[i // 5 % len(notices)])
        yield i, "\n".join(lines)


def grams(text):
    found = [w.rstrip(".") for w in re.split(r"[^a-z0-9.]+", text.lower()) if w not in ("", ".")]
    return {*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))}


def test_whole_notices_confirm_a_licence(spark):
    tricky = {502: "the license of the mit is not apache, version nothing", 503: "the apache rode on", 504: "apache license", 505: "gpl", 506: "reserved seats", 507: "mit license", 508: "cc nc", 509: "mozilla public"}
    texts = dict(licensed()) | tricky
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    found = licences.scan(df, licences.fit(df.where("doc_id < 500"))).collect()
    assert any(r.doc_id >= 500 for r in found) and sum(r.doc_id < 500 for r in found) == 80
    for r in found:
        own = grams(texts[r.doc_id].split("\n")[r.paragraph - 1])
        share = max(len(own & grams(n)) / len(grams(n)) for n in licences.NOTICES[r.family])
        assert abs(r.resemblance - share) < 1e-9 and r.confirmed == (share >= licences.CONFIRM)
        assert not (r.doc_id >= 500 and r.confirmed)


def test_words_of_the_corpus_weigh_against_a_licence(spark):
    texts = dict(licensed()) | {1000 + i: f"word{i % 7} and more\nEverything here is licensed under our terms" for i in range(200)}
    model = licences.fit(spark.createDataFrame(list(texts.items()), SCHEMA))
    weights = {r.gram: r.w for r in model.weights.collect()}
    assert any(g not in set().union(*(grams(n) for all_ in licences.NOTICES.values() for n in all_)) and w[-1] > max(w[:-1]) for g, w in weights.items())
    found = licences.scan(spark.createDataFrame(list(texts.items()), SCHEMA), model).collect()
    assert {r.doc_id for r in found} == {i for i in range(400) if i % 5 == 0}


def test_other_wordings_and_wrapped_notices_are_found(spark):
    wrapped = {
        900: (3, "apache", "words before\n\n# Licensed under the Apache\n# License, Version 2.0 (the \"License\");\n# you may not use this\n# file except in compliance\n# with the License.\n\nwords after"),
        901: (1, "mit", "Permission is\nhereby granted, free\nof charge, to any\nperson obtaining a\ncopy of this software\nand associated\ndocumentation files."),
    }
    other = {
        910: ("mit", "Published under the terms of the MIT license, see COPYING."), 911: ("apache", "We share this code under Apache License 2.0."),
        912: ("gpl", "You may copy this under the GNU General Public License v2."), 913: ("cc", "Photos are under a Creative Commons Attribution license."),
        914: ("mpl", "Code is covered by the Mozilla Public License."),
    }
    assert not {n for _, n in other.values()} & {n for all_ in licences.NOTICES.values() for n in all_}
    texts = dict(licensed()) | {i: t for i, (_, _, t) in wrapped.items()} | {i: t for i, (_, t) in other.items()} | {920: "plain\ntext a1na\n\n \nof b2no words"}
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    found = licences.scan(df.where("doc_id >= 900"), licences.fit(df.where("doc_id < 900"))).collect()
    assert {(r.doc_id, r.family) for r in found if r.doc_id >= 910} == {(i, f) for i, (f, _) in other.items()}
    for i, (no, family, _) in wrapped.items():
        assert any((r.doc_id, r.paragraph, r.family, r.confirmed) == (i, no, family, True) for r in found)
    cut = licences.paragraphs(df.where("doc_id in (900, 920)")).orderBy("own", "no", "whole").collect()
    assert [(r.own, r.no, r.whole) for r in cut] == [(900, 1, False), (900, 3, False), (900, 3, True), *((900, n, False) for n in (4, 5, 6, 7, 9)), (920, 1, False), (920, 1, True), (920, 2, False), (920, 5, False)]


def test_paragraphs_without_an_anchor_are_never_found(spark):
    tricky = {900: "under all of this", 901: "LICENSED UNDER THE APACHE LICENSE", 902: "the mit license", 903: "not any of the above", 904: "Line\nReleased under the\nGPL, version 2\n\nnext"}
    df = spark.createDataFrame(list((dict(licensed()) | tricky).items()), SCHEMA)
    model = licences.fit(df.where("doc_id < 500"))
    words = model.anchors()
    assert words and len(words) < len(model.listed)
    found = sorted(map(str, licences.scan(df, model).collect()))
    for least in (0.5, 0.9):
        model.least = least
        with_words = sorted(map(str, licences.scan(df, model).collect()))
        whole = type(model).anchors
        type(model).anchors = lambda self: None
        try:
            assert sorted(map(str, licences.scan(df, model).collect())) == with_words
        finally:
            type(model).anchors = whole
    model.offsets[0] += 100  # every paragraph is of the first family, so no word may be asked for
    assert found and model.anchors() is None


def test_licence_model_hears_every_paragraph(spark, monkeypatch):
    """A phrase in the second line of long documents counts, however little all paragraphs may weigh together."""
    texts = dict(licensed(200)) | {1000 + i: "\n".join([f"plain {i} words", "Everything here is licensed under our terms", *(f"line {i} {j} of text" for j in range(8))]) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    monkeypatch.setattr(licences, "CORPUS", 300)
    stored = {}
    real = session.materialize

    def spied(rows, name):
        stored[name] = real(rows, name)
        return stored[name]

    monkeypatch.setattr(session, "materialize", spied)
    model = licences.fit(df)
    counts = {r.word: r.n for r in stored["licence-words"].collect()}
    units = {p for t in texts.values() for p in [*t.split("\n"), *([t] if "\n" in t else [])]}
    assert counts["line"] > 400 and counts[None] > 0.4 * len(units)
    found = licences.scan(df, model).where("doc_id >= 1000").collect()
    assert not [r for r in found if r.paragraph == 2]


def test_words_without_which_no_paragraph_resembles_a_notice():
    templates = [["a", "mit", "license", "a mit", "mit license"], ["all", "rights", "reserved", "all rights", "rights reserved"]]
    words = licences.tell_tales(templates)
    for t in templates:
        assert len([g for g in t if not set(g.split(" ")) & set(words)]) < 0.5 * len(t)
