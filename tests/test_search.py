"""Index and search: literal cases, and the join plan against brute force."""

import random

import pytest

from patchlens.operators import index, search

ELEMENTS = [
    ("function", "HandleRequest", "handlers", "Handle HTTP request"),
    ("function", "HandleResponse", "handlers", "Handle HTTP response"),
    ("struct", "RequestConfig", "config", "Configuration for requests"),
    ("interface", "Handler", "handlers", "Handler interface"),
]
SCHEMA = "framework string, element_id bigint, type string, name string, package string, doc string"


def elements_of(spark, rows, framework="f"):
    return spark.createDataFrame([(framework, i, *r) for i, r in enumerate(rows)], SCHEMA)


def queries_of(spark, texts, framework="f"):
    return spark.createDataFrame([(i, framework, q) for i, q in enumerate(texts)], "query_id bigint, framework string, query string")


def brute_force(rows, query, limit):
    """The scoring rule, pair by pair."""
    strip = ".,;:!?()[]{}"

    def camel(name):
        words, now = [], ""
        for i, ch in enumerate(name):
            if i and "A" <= ch <= "Z" and now:
                words.append(now)
                now = ""
            now += ch
        return words + ([now] if now else [])

    postings = {}
    for i, (kind, name, package, doc) in enumerate(rows):
        terms = [name.lower(), *(w.lower() for w in camel(name)), package.lower(), kind]
        terms += [w for w in (x.strip(strip) for x in doc.lower().split()) if len(w.encode()) > 3]
        for term in terms:
            postings.setdefault(term, []).append(i)
    scores = {}
    for word in query.lower().split():
        word = word.strip(strip + "\"'")
        for term, where in postings.items():
            points = (10 if term == word else 0) + (3 if word in term or term in word else 0)
            for i in where if points else ():
                scores[i] = scores.get(i, 0) + points
    out, seen = [], set()
    for i, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        label = rows[i][2] + "." + rows[i][1]
        if label not in seen and len(out) < limit:
            seen.add(label)
            out.append((i, score))
    return out


def found(spark, rows, texts, limit):
    result = search.search(index.build_index(elements_of(spark, rows)), queries_of(spark, texts), limit).collect()
    out = {i: [] for i in range(len(texts))}
    for r in sorted(result, key=lambda r: r["rank"]):
        out[r.query_id].append((r.element_id, r.score))
    return out


def test_scores_of_literal_cases(spark):
    texts = ["request", "handler", "func { handler } handler", "{ }", "xyz", ""]
    assert found(spark, ELEMENTS, texts, 10) == {
        0: [(0, 29), (2, 19)],
        1: [(3, 42), (0, 12), (1, 12)],
        2: [(3, 120), (0, 75), (1, 75), (2, 42)],
        3: [(0, 48), (1, 48), (2, 42), (3, 36)],
        4: [],
        5: [],
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, seed):
    """Random short and very long tokens, empty names, repeated labels, small limits."""
    rng = random.Random(seed)
    long_tokens = ["".join(rng.choice("ab") for _ in range(n)) for n in (63, 64, 65, 130, 300, 700)]
    parts = ["get", "set", "id", "a", "ab", "item", "er", "x" * 70, *long_tokens, *(t[10:-5] for t in long_tokens), *(t[:66] for t in long_tokens)]

    def token():
        return "".join(rng.sample(parts, rng.choice([1, 1, 1, 2])))

    rows = []
    for _ in range(60):
        name = rng.choice(["", "NewItem", "GetID", "X", token()[:80], "ItemErr"])
        doc = " ".join(rng.choice(["{%s}", "%s.", "%s"]) % token() for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice(["function", "struct"]), name, rng.choice(["", "p", "pkg"]), doc))
    texts = [" ".join(rng.choice(["%s", "{ %s", '"%s"', "%s %s"]).replace("%s", token()) for _ in range(rng.randint(1, 7))) for _ in range(12)]
    texts += ["{ ( ) }", "a", "function"]
    limit = rng.choice([2, 5])
    assert found(spark, rows, texts, limit) == {i: brute_force(rows, q, limit) for i, q in enumerate(texts)}


def texts_of(spark, texts):
    return spark.createDataFrame([("f", t) for t in texts], "framework string, text string").select("framework", index.token_key(index.F.col("text")).alias("key"), "text")


def words_of(spark, texts):
    rows = spark.createDataFrame([("f", t, i) for i, t in enumerate(sorted(texts))], "framework string, word string, word_id bigint")
    return rows.withColumn("key", index.token_key(index.F.col("word")))


def pairs_of(spark, terms, words):
    vocabulary = texts_of(spark, terms)
    only = index.KeywordIndex(None, None, vocabulary, index.grams(vocabulary))
    asked = words_of(spark, words)
    keys = {r.word_id: r.key for r in asked.collect()}
    return [(r.term_key, keys[r.word_id], r.weight) for r in search.matching_pairs(only, asked).collect()]


def test_matching_pairs_equal_nested_loop(spark):
    rng = random.Random(7)
    terms = {"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 6, 7, 40, 64, 65, 100, 255, 256, 257, 400, 900]))) for _ in range(60)}
    words = {h[i : i + n] for h in terms for i in (0, 3, len(h) // 2) for n in (1, 2, 3, 6, 10, 64, 65, 80, 300)} - {""}
    words |= {"zzz", "z" * 90, "xyzab", "", "x" + max(terms, key=len) + "yy"}
    terms |= {"", "é\U0001f642a", "\U0001f642"}
    words |= {"\U0001f642a", "zé\U0001f642ab"}
    keys = {r.text: r.key for r in texts_of(spark, terms | words).collect()}
    got = pairs_of(spark, terms, words)
    want = {(keys[t], keys[w], 13 if t == w else 3) for t in terms for w in words - {""} if w in t or t in w} | {(keys[""], keys[""], 10)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("few", [0, 3, 1_000])
def test_words_looked_for_in_terms_or_by_grams_find_the_same(spark, monkeypatch, few):
    """No word, the short ones or all of them are looked for in the terms."""
    monkeypatch.setattr(search, "FEW", few)
    terms = {"handler", "request", "a", "ab", "cab", "", "x" * 70 + "ab", "handlers"}
    words = {"a", "b", "ab", "hand", "handler", "que", "x" * 66, "", "zzz"}
    keys = {r.text: r.key for r in texts_of(spark, terms | words).collect()}
    got = pairs_of(spark, terms, words)
    want = {(keys[t], keys[w], 13 if t == w else 3) for t in terms for w in words - {""} if w in t or t in w} | {(keys[""], keys[""], 10)}
    assert len(got) == len(set(got)) and set(got) == want


def test_few_words_need_no_grams(spark, monkeypatch):
    written = []
    real = index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, name: written.append(name) or real(df, name))
    assert found(spark, ELEMENTS, ["request", "handler"], 10) == {0: [(0, 29), (2, 19)], 1: [(3, 42), (0, 12), (1, 12)]}
    assert "grams" not in written


def test_lists_are_repeated_for_terms_with_many_postings_only(spark, monkeypatch):
    from patchlens.operators import joins

    texts = ["request handler", "interface"]
    want = found(spark, ELEMENTS * 3, texts, 3)
    monkeypatch.setattr(search, "BROADCAST_PAIRS", -1)
    built = index.build_index(elements_of(spark, ELEMENTS * 3))
    assert search.ask(built, queries_of(spark, texts)).heavy.count() == 0
    monkeypatch.setattr(joins, "KEY_ROWS", 4)
    heavy = {r.term_key: r._salts for r in search.ask(built, queries_of(spark, texts)).heavy.collect()}
    assert heavy["handlers"] == 3 and "interface" not in heavy
    old = index.KeywordIndex(built.postings, built.term_chunks, built.vocabulary.drop("n"), built.grams)
    assert {r.term_key: r._salts for r in old.heavy_terms().collect()} == heavy
    assert found(spark, ELEMENTS * 3, texts, 3) == want


def test_rows_grow_with_the_length_of_a_token(spark):
    """A token of a megabyte makes a few rows for each of its characters, not one for each of its substrings."""
    rng = random.Random(3)
    long_text = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    vocabulary = texts_of(spark, [long_text, "needle"])
    assert index.grams(vocabulary).count() <= 10**3 + 100 + 10 + 10
    keys = {r.text: r.key for r in vocabulary.collect()}
    part, tail = long_text[30_000:30_200], long_text[-1:]
    got = pairs_of(spark, [long_text, "needle"], [part, tail, "xneedle"])
    assert {(t, w) for t, w, _ in got} == {(keys[long_text], texts_of(spark, [part]).first().key), (keys[long_text], tail), ("needle", "xneedle")}


def test_split_keys_change_nothing(spark, monkeypatch):
    """Tiny chunks force every split and skip; the result stays the same."""
    texts = ["request handler", "handler { config", "interface"] * 3
    want = found(spark, ELEMENTS * 5, texts, 3)
    monkeypatch.setattr(index, "CHUNK_POSTINGS", 2)
    monkeypatch.setattr(search, "FIRST_CHUNKS", 1)
    monkeypatch.setattr(search, "WORDS_PER_ROW", 2)
    assert found(spark, ELEMENTS * 5, texts, 3) == want
    monkeypatch.setattr(search, "BROADCAST_PAIRS", -1)  # lists are joined by term
    assert found(spark, ELEMENTS * 5, texts, 3) == want


def test_chunks_out_of_reach_are_not_read(spark, monkeypatch):
    """Short elements cannot reach the score of long ones: their postings are neither matched nor scored."""
    rng = random.Random(4)
    stems = ["parse", "token", "handler", "request", "buffer", "queue", "lock", "index"]
    rows = []
    for i in range(400):
        size = 60 if i % 20 == 0 else rng.randint(1, 12)
        rows.append(("function", f"Item{i}", f"p{i % 40}", " ".join(rng.choice(stems) + str(rng.randint(0, 5)) for _ in range(size))))
    texts = ["parse the token", "request handler queue", "{ buffer lock }", "index4 queue"]
    monkeypatch.setattr(index, "CHUNK_POSTINGS", 256)
    read, scored = [], []

    def spied(kind, inner, chunks_at):
        def call(*args):
            kind.append(args[chunks_at].count())
            return inner(*args)

        return call

    monkeypatch.setattr(search, "word_scores", spied(read, search.word_scores, 2))
    monkeypatch.setattr(search, "query_scores", spied(scored, search.query_scores, 3))
    bounds = []
    inner = search.first_chunks
    monkeypatch.setattr(search, "first_chunks", lambda b, limit: (bounds.append(b.count()), inner(b, limit))[1])
    got = found(spark, rows, texts, 3)
    assert got == {i: brute_force(rows, q, 3) for i, q in enumerate(texts)}
    assert sum(read) < 0.7 * bounds[0] and sum(scored) <= sum(read)


def test_frameworks_do_not_mix(spark):
    both = elements_of(spark, ELEMENTS, "f").unionByName(elements_of(spark, ELEMENTS[:1], "g"))
    rows = search.search(index.build_index(both), queries_of(spark, ["request"], "g"), 0).collect()
    assert [(r.framework, r.element_id, r.score) for r in rows] == [("g", 0, 29)]


def test_patterns_and_types(spark):
    names = ["NewClient", "NewServer", "GetUser", "SetConfig", "IsValid", "HasPermission", "RequestHandler"]
    rows = [("function", n, "p", "") for n in names] + [("struct", n, "p", "") for n in ("UserService", "UserRepository", "ValidationError")]
    counts = {r.pattern: r.n for r in index.pattern_counts(elements_of(spark, rows)).collect()}
    assert counts == {
        "function": 7, "struct": 3, "constructor": 2, "getter": 1, "setter": 1, "predicate": 2, "handler": 1, "service": 1, "repository": 1, "error": 1,
    }
    assert index.elements_by_type(elements_of(spark, ELEMENTS), "function").count() == 2


def test_context_of_inputs(spark):
    elements = elements_of(spark, ELEMENTS).withColumn("body", index.F.col("doc"))
    inputs = spark.createDataFrame(
        [(1, 1, "f", "+ request"), (1, 2, "f", "+ request"), (1, 3, "none", "request"), (2, 1, "", "request")],
        "review_id int, file_no int, framework string, diff string",
    )
    rows = search.attach_context(inputs, elements, index.build_index(elements)).collect()
    names = {(r.review_id, r.file_no): [e.name for e in r.context] for r in rows}
    assert names == {(1, 1): ["HandleRequest", "RequestConfig"], (1, 2): ["HandleRequest", "RequestConfig"], (1, 3): [], (2, 1): []}


def test_no_theta_join_and_early_top_k(spark):
    built = index.build_index(elements_of(spark, ELEMENTS))
    asked = search.ask(built, queries_of(spark, ["request"]))
    bounds = search.query_bounds(asked, search.chunk_bounds(built, asked))
    first = search.first_chunks(bounds, 3)
    words = words_of(spark, ["request"])
    steps = [
        search.search(built, queries_of(spark, ["request"])), search.matching_pairs(built, words), bounds, first,
        search.query_scores(built, asked, search.word_scores(built, asked, first), first),
    ]
    plans = [s._jdf.queryExecution().toString() for s in steps]
    assert not any("NestedLoop" in p or "CartesianProduct" in p for p in plans)
    assert "WindowGroupLimit" in plans[0] and "WindowGroupLimit" in plans[3]


def test_index_is_written_when_it_is_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(index, "materialize", lambda df, name: written.append(name) or df)
    elements = spark.createDataFrame([("f", 1, "function", "GetItem", "p", "words here")], "framework string, element_id bigint, type string, name string, package string, doc string")
    made = index.build_index(elements)
    assert written == []
    assert made.grams.count() > 0 and made.element_keys.count() == 1 and made.term_chunks.count() > 0 and made.grams.count() > 0
    assert sorted(written) == ["grams", "postings", "term-chunks", "vocabulary"]


def test_a_context_is_not_repeated_for_rows_that_share_it(spark, monkeypatch):
    from patchlens.operators import joins

    F = index.F
    wide = spark.createDataFrame([("a", "x" * 100), ("b", "y" * 100)], "k string, wide string")
    rows = spark.range(40).selectExpr("id", "IF(id < 30, 'a', IF(id < 35, 'b', '')) AS k")

    def copies() -> int:
        numbers = []
        real = joins.salts
        monkeypatch.setattr(joins, "salts", lambda n: numbers.append(n) or real(n))
        joined = joins.counted_join(rows, wide, ["k"], ["id"], "left")
        monkeypatch.setattr(joins, "salts", real)
        assert joined.count() == 40 and joined.where("wide IS NOT NULL").count() == 35
        many = rows.groupBy("k").count().select("k", F.ceil(F.col("count") / joins.KEY_ROWS).alias("_salts")).where("_salts > 1")
        return wide.join(many, "k", "left").select(F.explode(real(numbers[0]))).count()

    assert copies() == 2
    monkeypatch.setattr(joins, "KEY_ROWS", 8)
    assert copies() == 4 + 1
    elements = elements_of(spark, ELEMENTS).withColumn("body", F.col("doc"))
    inputs = spark.range(40).selectExpr("id AS review_id", "0 AS file_no", "IF(id % 4 = 0, '', 'f') AS framework", "'get request' AS diff")
    named = search.attach_context(inputs, elements, index.build_index(elements), made=lambda context: F.transform(context, lambda e: e["name"]))
    assert {r.review_id: len(r.context) for r in named.collect()} == {i: 2 * (i % 4 > 0) for i in range(40)}
