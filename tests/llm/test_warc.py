from __future__ import annotations

import hashlib
import random

import pytest

from trialframe.llm import warc


def _pages(spark):
    r = random.Random(4)
    big = "<p>" + "".join(r.choice("abcdé <>\n") for _ in range(300_000)) + "</p>"
    html = [None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, big, big, "WARC/1.1\r\n\r\n" * 30, "WARC/1.1\r\n\r\n" * 30]
    html += ["hot " * 40] * 30 + ["".join(r.choice("ab") for _ in range(r.choice([10, 150, 4000]))) for _ in range(60)]
    rows = [(1000 - i, f"http://h/{i}?a=b: c" if i % 7 else None, h, "clash") for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def _expected(rows):
    firsts = {}
    for page, html in rows:
        p = (html or "").encode()
        if len(p) >= 100:
            firsts[p] = min(firsts.get(p, page), page)
    out = {}
    for page, html in rows:
        p = (html or "").encode()
        again = len(p) >= 100 and firsts[p] != page
        out[page] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", firsts[p] if again else None)
    return out


def test_round_trip(spark):
    pages = _pages(spark)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages.repartition(3)).collect()}
    assert got == _expected([(r.page_id, r.html) for r in pages.collect()])


@pytest.mark.parametrize("split", [700, 50_000, 64 << 20])
def test_partitions_push_down_and_skipped_payloads(spark, tmp_path, split):
    pages, path = _pages(spark), f"file://{tmp_path}/a"
    warc.write_archive(warc.records(pages).coalesce(2), path)
    stored = {r.record_id: bytes(r.payload) for r in warc.records(pages).where("record_type = 'response'").collect()}
    back = warc.read_archive(spark, path, split_bytes=split)
    rows = back.where("record_type = 'response'").collect()
    assert {r.record_id: bytes(r.payload) for r in rows} == stored and len(rows) == len(stored)
    heads = warc.read_archive(spark, path, payload=False, split_bytes=split)
    assert {r.payload for r in heads.collect()} == {None} and heads.count() == pages.count()
    urls = ["http://h/3?a=b: c", "http://h/5?a=b: c"]
    some = back.where(back.target_uri.isin(urls) & (back.record_type == "response"))
    assert {r.target_uri for r in some.collect()} <= set(urls) and some.count() >= 1
    assert back.where("target_uri is null").count() == pages.where("url is null").count()


def test_filters_are_decided_by_the_reader(spark, tmp_path):
    reader = warc._Reader({"path": "/nowhere"})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 3), warc.In(("target_uri",), ("a", "b", None)), warc.IsNotNull(("refers_to",))]))
    assert kept == [warc.EqualTo(("payload_bytes",), 3)]
    assert reader.wanted == [("WARC-Type", frozenset(["response"])), ("WARC-Target-URI", frozenset("ab")), ("WARC-Refers-To", None)]
    none = warc._Reader({"path": "/nowhere"})
    assert list(none.pushFilters([warc.In(("target_uri",), (None,))])) == [] and not none._wants({"WARC-Target-URI": "a"}) and not none._wants({})


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", chr(97 + i % 26) * (1_000_000 + i)) for i in range(12)], "page_id long, url string, html string")
    warc.write_archive(warc.records(pages).coalesce(1), str(tmp_path / "a"))
    for option, filters, rows, most in (("true", [warc.EqualTo(("target_uri",), "u3")], 1, 1_010_000), ("true", [warc.EqualTo(("record_type",), "revisit")], 0, 10_000), ("false", [], 12, 10_000)):
        reader = warc._Reader({"path": str(tmp_path / "a"), "payload": option})
        assert not list(reader.pushFilters(filters))
        found = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        assert found == rows and 0 < reader.inflated < most
    plan = warc.archive_report(spark, str(tmp_path / "a"))
    assert plan.count() == 12


def test_archives_within_payloads_are_not_records(spark, tmp_path):
    r = random.Random(1)
    inner = warc.record({"record_type": "response", "payload": b"inner " * 50} | dict.fromkeys(("record_id", "target_uri", "payload_digest", "refers_to", "payload_bytes")), b"m" * 16)
    rows = [("response", f"<{i}>", None, None, None, 0, bytearray(r.randbytes(3000) + inner + r.randbytes(3000))) for i in range(40)]
    recs = spark.createDataFrame(rows, warc.WRITE_SCHEMA)
    warc.write_archive(recs.coalesce(1), f"file://{tmp_path}/a")
    for split in (500, 5_000):
        back = warc.read_archive(spark, f"file://{tmp_path}/a", split_bytes=split).collect()
        assert sorted((x.record_id, bytes(x.payload)) for x in back) == sorted((x[1], bytes(x[6])) for x in rows)


def test_other_writers_files_are_read_whole(spark, tmp_path):
    import gzip

    texts = [b"".join((b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(p), p, b"\r\n\r\n")) for p in (b"", b"abc", b"z" * 700_000)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, texts)))
    back = warc.read_archive(spark, f"file://{tmp_path}", split_bytes=300).collect()
    assert sorted(len(x.payload) for x in back) == [0, 3, 700_000]
    assert warc.read_archive(spark, f"file://{tmp_path}").where("record_type = 'revisit'").count() == 0


def test_readers_see_whole_jobs_only(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    writer = warc._Writer({"path": path})
    rows = [{"record_type": "response", "record_id": "<a>", "target_uri": None, "payload_digest": None, "refers_to": None, "payload_bytes": 1, "payload": b"x"}]
    import pyarrow as pa

    done, lost = (writer.write(iter([pa.RecordBatch.from_pylist(rows)])) for _ in range(2))
    assert warc.read_archive(spark, path).count() == 0  # not committed yet
    writer.commit([done, None])
    assert warc.read_archive(spark, path).count() == 1  # the failed attempt's file is gone
    other = warc._Writer({"path": path})
    other.write(iter([pa.RecordBatch.from_pylist(rows)]))
    other.abort([])
    assert warc.read_archive(spark, path).count() == 1 and len(list((tmp_path / "a").rglob("*.warc.gz"))) == 1


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_many_repeated_payloads_meet_without_their_bytes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    pages = _pages(spark)
    got = {r.record_id: r.refers_to for r in warc.records(pages).collect()}
    want = _expected([(r.page_id, r.html) for r in pages.collect()])
    assert got == {f"<urn:page:{i}>": f"<urn:page:{w[3]}>" if w[3] is not None else None for i, w in want.items()}


def test_no_pages(spark):
    none = _pages(spark).where("false")
    assert warc.round_trip(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, None, "z" * 200), (3, None, "z" * 200)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(nulls).collect())
    assert got == [(0, "response", None), (0, "revisit", 3), (3, "response", None)]


def test_a_member_longer_than_the_buffer_is_found_from_any_split(spark, tmp_path):
    r = random.Random(9)
    letters = "".join(chr(c) for c in range(33, 127))
    rows = [(i, f"http://h/{i}", "".join(r.choices(letters, k=2_500_000))) for i in range(4)]  # about 2 MB compressed
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(warc.records(pages).coalesce(1), f"file://{tmp_path}/a")
    back = warc.read_archive(spark, f"file://{tmp_path}/a", split_bytes=300_000)
    assert sorted((x.target_uri, bytes(x.payload).decode()) for x in back.collect()) == [(u, h) for _, u, h in rows]
