"""Archives: round trip, revisits, and what survives damage."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from patchlens.llm import warc


def whole(i, payload):
    return warc.record("response", str(i), f"http://x/{i}", hashlib.sha256(payload).hexdigest(), payload, None)


def gaps_and_ids(raw):
    rows = list(warc.salvage(raw))
    assert sum(r["size"] for r in rows) == len(raw) and all(b["start"] == a["start"] + a["size"] for a, b in zip(rows, rows[1:]))
    return [(r["start"], r["size"], r["reason"]) for r in rows if r["gap"]], [r["id"] for r in rows if not r["gap"]]


PAYLOADS = [b"page %d " % i + b"x" * (50 * i) + b"\r\n\r\nWARC/1.1 in a page" for i in range(6)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_the_record_it_hits(packed):
    records = [whole(i, p) for i, p in enumerate(PAYLOADS)]
    parts = [warc.member(r) if packed else r for r in records]
    raw = b"".join(parts)
    assert gaps_and_ids(raw) == ([], [str(i) for i in range(6)])
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    for hit in range(6):
        middle = starts[hit] + len(parts[hit]) - 12  # in the payload, or the packed data
        broken = raw[:middle] + bytes([raw[middle] ^ 0xFF]) + raw[middle + 1 :]
        gaps, ids = gaps_and_ids(broken)
        assert ids == [str(i) for i in range(6) if i != hit]
        assert [(s, n) for s, n, _ in gaps] == [(starts[hit], len(parts[hit]))]
    gaps, ids = gaps_and_ids(raw[: starts[5] + 40])  # cut off
    assert ids == ["0", "1", "2", "3", "4"] and gaps[0][:2] == (starts[5], 40)
    gaps, ids = gaps_and_ids(b"junk \x1f\x8b\x08 junk" + raw)
    assert len(ids) == 6 and gaps[0][:2] == (0, len(b"junk \x1f\x8b\x08 junk"))
    assert gaps_and_ids(b"nothing here")[1] == [] and gaps_and_ids(b"") == ([], [])


def test_wrong_digest_and_length_are_quarantined():
    good, bad = whole(1, b"a" * 200), whole(2, b"b" * 200).replace(b"b" * 200, b"c" * 200)
    gaps, ids = gaps_and_ids(good + bad + good)
    assert ids == ["1", "1"] and gaps[0][1:] == (len(bad), "payload does not match its digest")
    short = whole(3, b"d" * 200).replace(b"d" * 200, b"d" * 150)
    assert gaps_and_ids(short + good)[1] == ["1"]


def test_several_records_in_one_member():
    assert [r["id"] for r in warc.salvage(warc.member(whole(1, b"a") + whole(2, b"b")))] == ["1", "2"]


def test_round_trip_on_spark(spark, tmp_path):
    page = "<p>é</p>" * 20
    rows = [(3, "u3", page), (1, "u1", page), (2, None, page), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", "y" * 300_000), (8, "u8", page + "!"), (None, "n", page)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("kind", F.lit("clash")).withColumn("digest", F.lit(1))
    written = warc.write_archives(df.repartition(3), str(tmp_path), roll=2_000).collect()
    assert sum(r.records for r in written) == 9 and all(gzip.open(tmp_path / r.file).read() for r in written)
    found = {r.id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert not any(r.gap for r in found.values()) and len(found) == 9
    kinds = {k: (r.record_type, r.refers_to) for k, r in found.items()}
    assert kinds["1"] == ("response", None) and kinds["2"] == kinds["3"] == ("revisit", "1")
    assert {kinds[k] for k in ("4", "5", "6", "7", "8")} == {("response", None)}
    for i, _, html in rows:
        payload = (html or "").encode()
        r = found["none" if i is None else str(i)]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    empty = tmp_path / "empty"
    warc.write_archives(df.where("false"), str(empty)).collect()
    assert warc.read_archives(spark, str(empty)).count() == 0
