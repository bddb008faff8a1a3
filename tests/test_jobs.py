"""Jobs of several steps: reviews, the agent, the store, and the event stream."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_search import ELEMENTS, elements_of, queries_of

from patchlens.functions import prompts
from patchlens.operators import agent, index, inputs, review, search
from patchlens.operators.complete import lookup_complete_fn, with_retries
from patchlens.operators.extract import ELEMENT_COLUMNS
from patchlens.operators.inputs import merge_request_versions
from patchlens.session import shared_dir
from patchlens.sources import remote, store
from patchlens.streaming import webhooks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the scripts below run in tasks

ANSWER = '{"issues":[{"type":"SECURITY","severity":"HIGH","line":3,"title":"T"}],"summary":"s","risk_score":8,"recommendation":"COMMENT"}'


def inputs_of(spark, rows):
    return spark.createDataFrame(
        rows, "review_id bigint, file_no bigint, file_path string, diff string, full_content string, framework string, use_agent boolean"
    )


@pytest.fixture(scope="module")
def base(spark):
    elements = elements_of(spark, ELEMENTS).withColumn("body", F.col("doc"))
    return elements, index.build_index(elements)


def rows_by_file(df):
    return {r.file_no: r for r in df.collect()}


def test_standard_review_keeps_errors_as_rows(spark):
    files = inputs_of(spark, [(1, 1, "a.go", "+x", "", "", False), (1, 2, "b.go", "+y", "", "", False), (1, 3, "c.go", "", "", "", False)])
    files = files.withColumn("error", F.when(F.col("diff") == "", "no input provided").otherwise(""))
    got = rows_by_file(review.review_files(files, lookup_complete_fn({"a.go": ANSWER}), attempts=1))
    assert (got[1].result.risk_score, got[1].result.issues[0].line, got[1].error) == (8, 3, "")
    assert (got[2].result, got[2].error) == (None, "no canned answer")
    assert (got[3].result, got[3].error) == (None, "no input provided")


def test_framework_review_sees_its_context(spark, base):
    elements, stored = base
    files = inputs_of(spark, [(1, 1, "a.go", "+ request", "", "f", False)])

    def reply(batch):
        assert 'framework "f"' in batch[0][0]["content"]
        user = batch[0][1]["content"]
        found = [name for _, name, _, _ in ELEMENTS if f".{name}\n" in user]
        return [(json.dumps({"summary": ",".join(found)}), None, None)]

    got = rows_by_file(review.review_files_with_framework(files, reply, elements, stored, attempts=1))
    assert got[1].result.summary == "HandleRequest,RequestConfig"


def test_missing_framework_is_skipped_or_fails(spark, base):
    elements, stored = base
    files = inputs_of(spark, [(1, 1, "a.go", "+x", "", "nope", False)])
    got = rows_by_file(review.review_all(files, lookup_complete_fn({}, ANSWER), elements, stored, attempts=1))
    assert got[1].result.summary == "s"
    with pytest.raises(ValueError, match="nope"):
        review.review_all(files, lookup_complete_fn({}, ANSWER), elements, stored, on_missing="error")


def script(batch):
    """Replies by file name, step and what the prompt already shows."""
    replies = []
    for system, user in ((m[0]["content"], m[1]["content"]) for m in batch):
        final = {"tool": "final_review", "args": json.loads(ANSWER)}
        if not user.startswith("## Review"):
            reply = "tool says no"
        elif "search.go" in user:
            final["args"]["summary"] = "saw" if "### handlers.HandleRequest (function)" in user and "framework 'f'" in system else "blind"
            reply = json.dumps(final) if "### search_framework\n" in user else '{"tool":"search_framework","args":{"query":"request"}}'
        elif "noindex.go" in user:
            final["args"]["summary"] = "none" if "Result: No framework indexed." in user else "?"
            reply = json.dumps(final) if "### search_framework" in user else '{"tool":"search_framework","args":{"query":"request"}}'
        elif "fix.go" in user:
            final["args"]["summary"] = "fixed" if "Result: tool says no" in user else "?"
            reply = json.dumps(final) if "### suggest_fix" in user else '{"tool":"suggest_fix","args":{"issue":"i","original_code":"c"}}'
        elif "unknown.go" in user:
            final["args"]["summary"] = "told" if "Result: Error: unknown tool: fly" in user else "?"
            reply = json.dumps(final) if "### fly" in user else '{"tool":"fly","args":{}}'
        elif "badargs.go" in user:
            final["args"]["summary"] = "told" if f"Result: {agent.BAD_ARGS}" in user else "?"
            reply = json.dumps(final) if "### analyze_security" in user else '{"tool":"analyze_security","args":{"code":5}}'
        elif "plain.go" in user:
            reply = "My review: " + ANSWER
        elif "badfinal.go" in user:
            reply = '{"tool":"final_review","args":{"summary":5}}'
        elif "late.go" in user:
            reply = json.dumps(final) if "step 4/5" in user and prompts.LAST_TASK in user else "still reading"
        elif "wrapped.go" in user:
            reply = '{"tool_calls":[{"tool":"final_review","args":{}}]}'
        else:
            replies.append((None, "down", None))
            continue
        replies.append((reply, None, None))
    return replies


def test_agent(spark, base):
    elements, stored = base
    names = ["search", "noindex", "fix", "unknown", "badargs", "plain", "badfinal", "late", "wrapped", "down"]
    files = inputs_of(spark, [(1, i, f"{n}.go", "+x", "", "" if n == "noindex" else "f", True) for i, n in enumerate(names)])
    got = {r.file_path[:-3]: r for r in review.review_all(files, script, elements, stored, attempts=1).collect()}
    assert len(got) == len(names)
    summaries = {n: r.result and r.result.summary for n, r in got.items()}
    assert summaries == {
        "search": "saw", "noindex": "none", "fix": "fixed", "unknown": "told", "badargs": "told", "plain": "s",
        "badfinal": agent.OUT_OF_STEPS, "late": "s", "wrapped": agent.OUT_OF_STEPS, "down": None,
    }
    assert (got["plain"].result.risk_score, len(got["plain"].result.issues)) == (8, 1)
    over = got["wrapped"].result
    assert (over.issues, over.risk_score, over.recommendation) == ([], 0, "REQUEST_CHANGES")
    assert got["down"].error == "step 1: down" and got["search"].error == ""


def test_found_texts_are_stored_once(spark, base, monkeypatch):
    """Rows of an agent's steps carry the names of what their searches found, prompts its text."""
    elements, stored = base
    written, real = {}, agent.materialize
    monkeypatch.setattr(agent, "materialize", lambda df, name: written.setdefault(name, []).append(real(df, name)) or written[name][-1])

    def ask(batch):
        call = lambda q: json.dumps({"tool": "search_framework", "args": {"query": q}})
        done = lambda user: json.dumps({"tool": "final_review", "args": {"summary": user.split("so far")[1].split("## Task")[0]}})
        at = lambda user: int(user.split("step ")[1][0])
        return [(call("request") if at(u) == 1 else call("nothing-like-it") if at(u) == 2 else done(u), None, None) for u in (m[-1]["content"] for m in batch)]

    files = inputs_of(spark, [(1, i, f"f{i}.go", "+x", "", "f", True) for i in range(20)])
    got = review.review_all(files, ask, elements, stored, attempts=1).collect()
    assert len(got) == 20 and {r.error for r in got} == {""}
    summary = {r.result.summary for r in got}.pop()
    assert summary.count("### search_framework") == 2 and prompts.FOUND in summary and prompts.NO_MATCH in summary
    assert [t.count() for t in written["search-texts"]] == [1, 0]
    for name in ("agent-1", "agent-2", "agent-2-answers", "agent-2-calls", "agent-3-calls"):
        assert {c.result for r in written[name][0].collect() for c in r.tool_calls} == {None}


def test_tool_catalog():
    names = [name for name, _, _ in prompts.TOOLS]
    assert names == ["search_framework", "analyze_security", "analyze_performance", "suggest_fix", "final_review"]
    assert prompts.tool_schema(prompts.TOOLS[3][2])["required"] == ["issue", "original_code"]


def test_deadline_of_an_attempt():
    """A call that hangs is given up, its rows are asked again, and its late reply reaches nobody."""
    calls = []

    def ask(batch):
        names = [m[0]["content"] for m in batch]
        calls.append(names)
        if "hangs" in names or ("once" in names and sum("once" in c for c in calls) == 1):
            time.sleep(0.6)
            return [("late", None, None)] * len(batch)
        return [(f"re {n}", None, None) for n in names]

    rows = [[{"content": n}] for n in ("a", "hangs", "once", "b")]
    started = time.monotonic()
    got = with_retries(ask, rows, 3, 0.0, deadline_s=0.15, rows_per_call=1)
    assert time.monotonic() - started < 1.2
    assert [r[0] for r in got] == ["re a", None, "re once", "re b"] and got[1][1] == "no reply within 0.15 s"
    assert [c for c in calls if c == ["a"]] == [["a"]] and calls.count(["hangs"]) == 3
    whole = with_retries(ask, rows[1:], 2, 0.0, deadline_s=0.15)
    assert all(r[1] == "no reply within 0.15 s" for r in whole)
    assert with_retries(ask, rows[:1], 1, 0.0, deadline_s=5)[0][0] == "re a"


def test_hanging_calls_overlap():
    """Calls that hang are waited for together; the replies of the others keep their rows."""
    def ask(batch):
        if batch[0][0]["content"].startswith("hangs"):
            time.sleep(1.5)
        return [(f"re {m[0]['content']}", None, None) for m in batch]

    names = [f"hangs {i}" if i % 5 == 0 else f"n{i}" for i in range(50)]
    started = time.monotonic()
    got = with_retries(ask, [[{"content": n}] for n in names], 2, 0.0, deadline_s=0.3, rows_per_call=1)
    assert time.monotonic() - started < 2.4  # one after another: 6 s
    assert [r[:2] for r in got] == [(None, "no reply within 0.3 s") if n.startswith("hangs") else (f"re {n}", None) for n in names]
    assert with_retries(lambda batch: None, [[{"content": "a"}]], 1, 0.0, deadline_s=1)[0][1]


def store_rows(spark, framework, names, packages):
    rows = [(framework, i, "function", n, p, f"{p}/x.go", i, "func", "", "body", "", ["fmt"], []) for i, (n, p) in enumerate(zip(names, packages))]
    return spark.createDataFrame(
        rows,
        "framework string, element_id bigint, type string, name string, package string, file_path string, line int, signature string, "
        "doc string, body string, receiver string, imports array<string>, references array<string>",
    )


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.list_frameworks(spark, path).collect() == []
    with pytest.raises(ValueError, match="gin"):
        store.load_framework(spark, path, "gin")
    both = store_rows(spark, "a", ["GetItem", "SetItem"], ["p", "q"]).unionByName(store_rows(spark, "b", ["Run"], ["p"]))
    store.save_frameworks(both, path)
    assert [r.framework for r in store.list_frameworks(spark, path).collect()] == ["a", "b"]
    store.save_frameworks(store_rows(spark, "b", ["Stop", "Start"], ["z", "z"]), path)  # replaces b, keeps a
    assert {r.name for r in store.load_framework(spark, path, "b").collect()} == {"Stop", "Start"}
    assert {r.name for r in store.load_framework(spark, path, "a").collect()} == {"GetItem", "SetItem"}
    catalog = {r.framework: r for r in store.load_catalog(spark, path).collect()}
    assert (catalog["a"].element_count, catalog["a"].packages, catalog["b"].packages) == (2, ["p", "q"], ["z"])
    hits = search.search(store.load_index(spark, path, "a"), queries_of(spark, ["setitem"], "a")).orderBy("rank").collect()
    assert hits[0].element_id == 1
    plan = store.load_framework(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(framework" in plan


def saved_state(spark, path):
    """Everything a reader sees."""
    names = sorted((r.framework, r.name) for r in store.load_elements(spark, path).collect())
    built = store.load_index(spark, path)
    terms = sorted((r.framework, r.element_id, r.term, r.tf) for r in built.postings.collect())
    catalog = sorted((r.framework, r.element_count, r.packages) for r in store.load_catalog(spark, path).collect())
    return names, terms, catalog, sorted(map(tuple, built.vocabulary.collect())), sorted(map(tuple, built.grams.collect()))


@pytest.mark.parametrize("breaks_in", ["catalog", "postings", "term_chunks", "vocabulary", "grams", "commit"])
def test_broken_save_is_invisible(spark, tmp_path, monkeypatch, breaks_in):
    path = str(tmp_path / "store")
    old = store_rows(spark, "a", ["GetItem", "SetItem"], ["p", "q"]).unionByName(store_rows(spark, "7", ["Run"], ["p"]))
    store.save_frameworks(old, path)
    before = saved_state(spark, path)
    assert [n for n in before[0]] == [("7", "Run"), ("a", "GetItem"), ("a", "SetItem")]

    def broken(*args, **kwargs):
        raise OSError("disk full")

    writers = {"catalog": "framework_catalog", "postings": "postings", "term_chunks": "term_chunks", "vocabulary": "vocabulary", "grams": "grams", "commit": "commit"}
    with monkeypatch.context() as patch:
        patch.setattr(store, writers[breaks_in], broken)
        with pytest.raises(OSError):
            store.save_frameworks(store_rows(spark, "a", ["Lost"], ["z"]), path)
    assert saved_state(spark, path) == before
    assert {r.name for r in store.load_framework(spark, path, "a").collect()} == {"GetItem", "SetItem"}
    store.save_frameworks(store_rows(spark, "a", ["Kept"], ["z"]), path)
    assert saved_state(spark, path)[0] == [("7", "Run"), ("a", "Kept")]


def test_elements_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = store_rows(spark, "a", ["GetItem", "SetItem", "Run"], ["p", "q", "q"])
    store.save_frameworks(rows.mapInArrow(touch, rows.schema), str(tmp_path / "store"))
    assert seen.value == 3


def test_lookup_reads_asked_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ELEMENTS", 1)
    path = str(tmp_path / "store")
    names = [f"Thing{i}Word{i}" for i in range(30)]
    store.save_frameworks(store_rows(spark, "a", names, ["p"] * 30), path)
    loaded = store.load_index(spark, path, "a")
    assert loaded.buckets == 30
    asked = spark.createDataFrame([("thing7",)], "term_key string")
    plan = loaded.looked_up("postings", asked, "term_key")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    files = lambda df: len({r[0] for r in df.select(F.input_file_name()).collect()})
    assert files(loaded.looked_up("postings", asked, "term_key")) < files(loaded.postings) / 5
    texts = ["thing7 word12", "p", "g1"]
    ranked = lambda at: sorted(tuple(r) for r in search.search(at, queries_of(spark, texts, "a"), 4).collect())
    assert ranked(loaded) == ranked(index.build_index(store.load_framework(spark, path, "a"))) == ranked(store.load_index(spark, path))


def test_documents_round_trip(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = store_rows(spark, "a", [f"F{i}" for i in range(7)], ["p"] * 7)
    catalog = index.framework_catalog(rows).withColumn("repo_url", F.lit("u")).withColumn("local_path", F.lit(""))
    store.export_documents(rows, catalog, path)
    records = spark.read.json(path).collect()
    assert len(records) == 8 and [r.element_count for r in records if r.element is None] == [7]
    back = store.import_documents(spark, path, lines=True)
    assert sorted(tuple(r) for r in back.select(ELEMENT_COLUMNS).collect()) == sorted(tuple(r) for r in rows.select(ELEMENT_COLUMNS).collect())
    nested = tmp_path / "nested"
    nested.mkdir()
    (nested / "x.json").write_text(json.dumps({"name": "g", "elements": [{"type": "struct", "name": "S", "line": 4}], "extra": 1}, indent=2))
    assert [(r.framework, r.name, r.line) for r in store.import_documents(spark, str(nested)).collect()] == [("g", "S", 4)]


def test_results_are_written_as_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.go", ""), (2, "b.go", "late")], "review_id int, file_path string, error string")
    remote.write_results(rows, str(tmp_path / "results"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "results")).select(rows.columns).collect()) == sorted(tuple(r) for r in rows.collect())


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = {}
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("Context", (), {"getCheckpointDir": lambda self: type("None_", (), {"isDefined": lambda self: False})()})())

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_failed_rows_are_not_reviewed(spark):
    """Rows that bring an error keep it on every way, and the model is not asked about them."""
    elements = store_rows(spark, "a", ["GetItem"], ["p"])
    rows = [(1, i, "a.go", "" if i < 4 else "+x", "a", i % 2 == 0, "no input provided" if i < 4 else "") for i in range(6)]
    df = spark.createDataFrame(rows, "review_id bigint, file_no bigint, file_path string, diff string, framework string, use_agent boolean, error string").withColumn("full_content", F.lit(""))

    def answer(requests):
        assert all("+x" in m[-1]["content"] for m in requests)
        return [(ANSWER, None, None) for _ in requests]

    found = {r.file_no: r for r in review.review_all(df, answer, elements, index.build_index(elements), attempts=1).collect()}
    assert [found[i].error for i in range(6)] == ["no input provided"] * 4 + [""] * 2
    assert all(found[i].result is None for i in range(4))


def test_fetch_and_delivery_errors_are_rows(spark):
    keys = spark.createDataFrame([(1,), (2,)], "iid int")
    got = {r.iid: r for r in remote.fetch_payloads(keys, lambda k: {1: "{}"}[k["iid"]]).collect()}
    assert (got[1].value, got[1].error, got[2].value, got[2].error) == ("{}", "", None, "2")

    def post(row):
        if row["iid"] == 2:
            raise OSError("refused")

    assert {r.iid: r.delivery_error for r in remote.deliver(keys, post).collect()} == {1: "", 2: "refused"}


def event(kind="merge_request", action="open", iid=1, commit="c1", **more):
    about = {"iid": iid, "action": action, **({"last_commit": {"id": commit}} if commit else {}), **more}
    return json.dumps({"object_kind": kind, "project": {"id": 5}, "object_attributes": about})


CHANGE = '{"iid":%d,"changes":[{"new_path":"a.go","diff":"+x"},{"new_path":"b.go","deleted_file":true}]}'


def test_stream_does_not_depend_on_its_batches(spark, tmp_path):
    """One event file, cut into 1, 2 and 7 batches: the same reviews, notes, comments and rejected events."""
    lines = [
        event(), event(action="update"), event(action="update", commit="c2"), event(action="close", iid=2), event(kind="push", iid=3), "{broken",
        event(action="reopen", iid=4), event(), event(iid=6, commit=None, updated_at="t1"), event(iid=6, commit=None, updated_at="t1", action="update"),
        event(iid=9), "{broken", event(iid=4), event(action="update", commit="c2"),
    ]
    payloads = spark.createDataFrame([(5, i, CHANGE % i) for i in (1, 2, 4, 6)] + [(5, 9, '{"changes":7}')], "project_id bigint, iid bigint, value string")
    versions = merge_request_versions(spark.createDataFrame([(5, 1, '[{"head_commit_sha":"h"}]')], "project_id bigint, iid bigint, value string"))
    webhooks.store_payloads(payloads, str(tmp_path / "payloads"))
    stored = spark.read.parquet(str(tmp_path / "payloads"))
    asked = spark.createDataFrame([(5, 4)], "project_id bigint, iid bigint")
    plan = webhooks.looked_up(stored, asked)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters")[1].split("]")[0]
    seen = []
    for n in (1, 2, 7):
        folder, out = tmp_path / f"events{n}", str(tmp_path / f"out{n}")
        folder.mkdir()
        for i in range(n):
            (folder / f"{i}.json").write_text("\n".join(lines[i * len(lines) // n : (i + 1) * len(lines) // n]))
            os.utime(folder / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
        source = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
        query = webhooks.start_reviews(source, stored, versions, lookup_complete_fn({}, ANSWER), out, str(tmp_path / f"checkpoint{n}"), available_now=True, attempts=1)
        query.awaitTermination(300)
        assert query.exception() is None
        rows = lambda t, *names: sorted(map(str, webhooks.read_done(spark, out, t).select(*names).collect()))
        assert spark.read.parquet(f"{out}/marks/done").select("batch").distinct().count() == n
        seen.append((rows("results", "review_id", "file_path", "error"), rows("notes", *webhooks.KEYS, "part", "body"), rows("comments", *webhooks.KEYS, "kind", "body"), rows("rejected", "value", "status")))
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0][0]) == 5 and sum("invalid merge request" in r for r in seen[0][0]) == 1 and len(seen[0][3]) == 4


def test_repeated_batch_asks_no_model_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(webhooks, "SNAPSHOT", 2)
    asked = spark.sparkContext.accumulator(0)
    inner = lookup_complete_fn({}, ANSWER)

    def counting(batch):
        asked.add(len(batch))
        return inner(batch)

    payloads = spark.createDataFrame([(5, i, CHANGE % i) for i in range(9)], "project_id bigint, iid bigint, value string")
    versions = merge_request_versions(spark.createDataFrame([], "project_id bigint, iid bigint, value string"))
    out = str(tmp_path / "out")

    def run(batch_id, *iids):
        rows = webhooks.route_events(spark.createDataFrame([(event(iid=i),) for i in iids], "value string"))
        notes, _ = webhooks.handle_batch(rows, batch_id, payloads, versions, counting, out, attempts=1)
        return sorted({r.iid for r in notes.collect()})

    assert run(0, 1, 2) == [1, 2] and asked.value == 2
    monkeypatch.setattr(webhooks, "outputs", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        run(1, 2, 3)  # breaks off after the model was asked
    assert asked.value == 3 and {r.batch for r in webhooks.read_done(spark, out, "results").collect()} == {0}
    monkeypatch.undo()
    monkeypatch.setattr(webhooks, "SNAPSHOT", 2)
    assert run(1, 2, 3) == [3] and asked.value == 3
    assert [run(n, 1, n + 2) for n in (2, 3, 4)] == [[4], [5], [6]] and run(4, 1, 6) == [6] and asked.value == 6
    assert run(5, 1, 2, 3, 4, 5, 6) == [] and asked.value == 6


def test_event_stream(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    lines = [event(), event(action="update"), event(action="close", iid=2), event(kind="push", iid=3), "{broken", event(action="reopen", iid=4)]
    (events / "a.json").write_text("\n".join(lines))
    batch = webhooks.route_events(spark.read.text(str(events)))
    assert sorted(r.status for r in batch.collect()) == ["accepted"] * 3 + ["ignored"] * 2 + ["malformed"]

    stream = webhooks.route_events(webhooks.read_event_files(spark, str(events)))
    running = stream.writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    running.awaitTermination(60)
    same = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert same(spark.table("routed")) == same(batch)

    payloads = spark.createDataFrame([(5, i, CHANGE % i) for i in (1, 2, 4)], "project_id bigint, iid bigint, value string")
    versions = merge_request_versions(spark.createDataFrame([(5, 1, '[{"head_commit_sha":"h"}]')], "project_id bigint, iid bigint, value string"))
    seen = []
    query = webhooks.start_reviews(
        webhooks.read_event_files(spark, str(events)), payloads, versions, lookup_complete_fn({}, ANSWER), str(tmp_path / "out"),
        str(tmp_path / "checkpoint"), on_batch=lambda notes, comments: seen.append((notes.count(), comments.count())), available_now=True, attempts=1,
    )
    query.awaitTermination(120)
    assert query.exception() is None and seen == [(6, 2)]  # two notes of a head, a section and a foot
    written = spark.read.parquet(str(tmp_path / "out" / "comments")).collect()
    assert {(r.iid, r.kind) for r in written} == {(1, "discussion"), (4, "note")}
    heads = spark.read.parquet(str(tmp_path / "out" / "notes")).where("part = 0").collect()
    assert heads and all("**Files Reviewed:** 1 / 1" in r.body for r in heads)


def test_payloads_are_read_once(spark):
    """Files and errors come from one reading of a payload, whichever way its types are told."""
    texts = [
        '{"iid":9,"changes":[{"new_path":"a","diff":null},{"new_path":"b","deleted_file":true},null]}', '{"iid":9,"changes":[]}', '{"iid":9}',
        '{"iid":9,"other":[1],"changes":[{"new_path":"a","more":2}]}', '{"iid":9.5,"changes":[]}', '{"changes":[{"new_path":1},{"new_path":"a"}]}',
        '{"changes":[1,{"new_path":"a"}]}', "null", "[]", "{", '{"iid":1,"iid":2}', '{"iid":123456789012345678901}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "project_id int, value string")
    changed = inputs.changed_files(rows)
    assert changed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert inputs.batch_files(rows.withColumnRenamed("project_id", "review_id"))._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    got = {}
    for r in changed.collect():
        got.setdefault(r.project_id, []).append((r.iid, r.file_no, r.file_path, r.diff, r.error))
    bad = [(None, None, None, "", inputs.BAD_PAYLOAD)]
    want = {0: [(9, 0, "a", "", ""), (9, 2, None, "", "")], 3: [(9, 0, "a", "", "")]} | {i: bad for i in range(4, 12)}
    assert got == want
