"""Search by one pass over the elements: the scores of brute force, no table of an index, and when the index is used instead."""

import random

import pytest
from test_search import ELEMENTS, brute_force, elements_of, queries_of

from patchlens.operators import index, scan, search
from patchlens.plans import queries as plans


def ranks(result, n):
    out = {i: [] for i in range(n)}
    for r in sorted(result.collect(), key=lambda r: r["rank"]):
        out[r.query_id].append((r.element_id, r.score))
    return out


def found(spark, rows, texts, limit):
    return ranks(search.search(index.build_index(elements_of(spark, rows), scan=True), queries_of(spark, texts), limit), len(texts))


@pytest.fixture
def written(monkeypatch):
    names = []
    for module in (index, scan, search):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, real=real: names.append(name) or real(df, name))
    return names


@pytest.mark.parametrize("seed, held", [(1, 1 << 20), (2, 40), (3, 1)])
def test_scan_equals_brute_force(spark, monkeypatch, written, seed, held):
    """Short and very long tokens, repeated labels, bytes outside of ASCII; tasks hold all, some or one number at once."""
    rng = random.Random(seed)
    for name in ("NUMBERS", "TERMS", "BYTES"):
        monkeypatch.setattr(scan, name, held)
    long_tokens = ["".join(rng.choice("ab") for _ in range(n)) for n in (8, 9, 63, 65, 300)]
    parts = ["get", "set", "id", "a", "ab", "item", "er", "é", "ñas", *long_tokens, *(t[3:-2] for t in long_tokens), *(t[:66] for t in long_tokens)]

    def token():
        return "".join(rng.sample(parts, rng.choice([1, 1, 1, 2])))

    rows = []
    for _ in range(60):
        name = rng.choice(["", "NewItem", "GetID", "X", token()[:80], "ItemErr"])
        doc = " ".join(rng.choice(["{%s}", "%s.", "%s"]) % token() for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice(["function", "struct"]), name, rng.choice(["", "p", "pkg", "p q"]), doc))
    texts = [" ".join(rng.choice(["%s", "{ %s", '"%s"', "%s %s"]).replace("%s", token()) for _ in range(rng.randint(1, 7))) for _ in range(12)]
    texts += ["{ ( ) }", "a", "function", "", "p q", "zzz"]
    assert found(spark, rows, texts, 3) == {i: brute_force(rows, q, 3) for i, q in enumerate(texts)}
    assert set(written) == {"scan-queries", "scan-words"}


def test_registered_searches_write_no_index(spark, sf_dir, written):
    for name in ("keyword_search", "search_tool_text", "review_context"):
        plans.QUERIES[name](spark, sf_dir).count()
    assert not {"postings", "vocabulary", "grams", "term-chunks"} & set(written)


@pytest.mark.parametrize("bound", ["QUERIES", "CELLS", "CHARS", "FRAMEWORKS"])
def test_queries_beyond_a_worker_use_the_index(spark, monkeypatch, written, bound):
    texts = ["request handler", "handler { config", "interface"]
    want = found(spark, ELEMENTS * 3, texts, 3)
    assert "postings" not in written
    monkeypatch.setattr(scan, bound, 0)
    assert found(spark, ELEMENTS * 3, texts, 3) == want
    assert "postings" in written


def test_repeated_ids_use_the_index(spark, written):
    """Rows of one id are one element to the index; a scan would rank them one by one."""
    twice = elements_of(spark, ELEMENTS).unionByName(elements_of(spark, ELEMENTS[:1]))
    asked = queries_of(spark, ["request"])
    want = ranks(search.search(index.build_index(twice), asked, 3), 1)
    assert ranks(search.search(index.build_index(twice, scan=True), asked, 3), 1) == want
    null_ids = elements_of(spark, ELEMENTS).unionByName(elements_of(spark, ELEMENTS).selectExpr("framework", "CAST(NULL AS BIGINT) AS element_id", "type", "name", "package", "doc"))
    written.clear()
    assert ranks(search.search(index.build_index(null_ids, scan=True), asked, 3), 1) == {0: brute_force(ELEMENTS, "request", 3)}
    assert "postings" not in written


def test_frameworks_do_not_mix_in_a_scan(spark):
    both = elements_of(spark, ELEMENTS, "f").unionByName(elements_of(spark, ELEMENTS[:1], "g"))
    asked = queries_of(spark, ["request"], "g").unionByName(queries_of(spark, ["request"], "none")).unionByName(queries_of(spark, ["handler"], "f"))
    rows = search.search(index.build_index(both, scan=True), asked, 1).collect()
    assert sorted((r.framework, r.element_id, r.score) for r in rows) == [("f", 3, 42), ("g", 0, 29)]
